"""The queries ``opN_<name>``: each applies its operator to its whole table and gives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, language, licenses, merkle, ngram_join, packing, quality, resampling, secrets, substring_dedup, token_files, toxicity, workspace


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.new_path(spark, "token-files")
    token_files.write(_docs(spark, sf_dir), path)
    return token_files.digests(token_files.read(spark, path))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = workspace.written(fingerprints.edited_pairs(_docs(spark, sf_dir)), "fingerprints")
    return fingerprints.with_near(pairs).drop("bits")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_docs(spark, sf_dir).select("doc_id", "text")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_docs(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir).select("doc_id", "text", "source")).drop("text_hash", "number")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(_docs(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.filter(~language.held_out()), labels.filter(~language.held_out()))
    found = toxicity.score(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_docs(spark, sf_dir))
    return pieces.withColumn("ids_crc32", token_files.ids_crc32("ids")).drop("ids")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(_docs(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 0))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.score(docs, quality.fit(docs.filter(~quality.held_out()), labels.filter(~quality.held_out())))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_fingerprints, op3_licenses, op4_decontamination, op5_ngram_join, op6_language, op7_secrets, op8_substring_dedup, op9_toxicity, op10_packing, op11_resampling, op12_merkle_manifest, op13_quality)}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LETTERED = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# crc32 by its table, which is made from the polynomial; a query that calls _crc also reads _CRC_TABLE as t.
_CRC_TABLE = "t AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i))"


def _crc(v: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, 2 * octet_length(encode({v})), 2), lambda k: ('0x' || substr(hex(encode({v})), k, 2))::BIGINT)), lambda x, b: xor(x >> 8, t.t[(xor(x, b) & 255) + 1])), 4294967295)"


def _leaf(n_chars: str) -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: Only exact operators that SQL can express; the others have tests against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 75 * (len(a.sh) + len(b.sh) - k)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT doc_id, CAST(any_value(len(sh)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY doc_id""",
    "op8_substring_dedup": f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
h AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h FROM w WHERE len(ws) >= 35),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
k AS (SELECT t.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY t.j) FILTER (WHERE c.j IS NULL) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.j = t.j GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op11_resampling": f"""
WITH {_CRC_TABLE},
w AS MATERIALIZED (SELECT row_number() OVER () AS r, true AS own, doc_id, {_LETTERED.format(text=_LOWER)} AS ws FROM documents
 UNION ALL SELECT -row_number() OVER (), false, NULL, {_LETTERED.format(text=_LOWER)} FROM benchmark),
f AS MATERIALIZED (SELECT r, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
d AS (SELECT DISTINCT f FROM f),
h AS MATERIALIZED (SELECT f, {_crc('f')} % 10000 AS b FROM d, t),
n AS (SELECT b, count(*) FILTER (WHERE own)::DOUBLE AS s, count(*) FILTER (WHERE NOT own)::DOUBLE AS t FROM f JOIN h USING (f) GROUP BY b),
g AS MATERIALIZED (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS g FROM n),
a AS (SELECT r, count(*) AS n_features, floor(sum(g) / count(*)) AS weight FROM f JOIN h USING (f) JOIN g USING (b) WHERE own GROUP BY r),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN a USING (r) WHERE own),
y AS (SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, 25 * count(*) OVER () // 100 AS most FROM y WHERE n_words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM y LEFT JOIN k USING (doc_id)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
l AS MATERIALIZED (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_crc('doc_id::VARCHAR')} % 7 = 0 AS changed, {_leaf('(n_chars + 1)')} AS other FROM documents, t),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
a AS (SELECT 0 AS lv, tree, i, leaf AS h, '' AS pre, count(*) OVER (PARTITION BY tree) AS n FROM p
 UNION ALL SELECT lv + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i), (any_value(n) + 1) // 2 FROM a WHERE n > 1 GROUP BY lv, tree, i // 2),
a1 AS MATERIALIZED (SELECT * FROM a),
s AS MATERIALIZED (SELECT tree, h AS subroot, lv AS depth FROM a1 WHERE n = 1),
b AS (SELECT 0 AS lv, tree AS i, subroot AS h, '' AS pre, count(*) OVER () AS n FROM s
 UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), string_agg(h, '' ORDER BY i), (any_value(n) + 1) // 2 FROM b WHERE n > 1 GROUP BY lv, i // 2),
b1 AS MATERIALIZED (SELECT * FROM b),
u AS (SELECT tree, lv AS k, i AS node, pre FROM a1 WHERE lv > 0 UNION ALL SELECT tree, depth + lv, i, pre FROM s, b1 WHERE lv > 0),
f AS (SELECT 0 AS k, tree, i, doc_id, CASE WHEN changed THEN coalesce(other, leaf) ELSE leaf END AS h, '' AS sib, i AS at FROM p
 UNION ALL SELECT f.k + 1, f.tree, f.i, doc_id, sha256(substr(pre, 1, 64 * (x.at % 2)::INT) || h || substr(pre, 64 * (x.at % 2)::INT + 65)), sib || substr(pre, 1, 64 * (x.at % 2)::INT) || substr(pre, 64 * (x.at % 2)::INT + 65), x.at // 2
 FROM (SELECT f.*, CASE WHEN f.k = depth THEN f.tree ELSE f.at END AS at2 FROM f JOIN s USING (tree)) f, LATERAL (SELECT at2 AS at) x JOIN u ON u.tree = f.tree AND u.k = f.k + 1 AND u.node = x.at // 2),
e AS (SELECT tree, i, arg_max(h, k) AS folded_root, arg_max(sib, k) AS sib FROM f GROUP BY tree, i)
SELECT p.doc_id, p.leaf, subroot, b1.h AS root, sha256(sib) AS proof_sha256, folded_root, folded_root = b1.h AS verified
FROM p JOIN e USING (tree, i) JOIN s USING (tree) JOIN b1 ON b1.n = 1""",
}
