"""Resampling, the Merkle manifest and line quality: brute force, SQL, defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crc, merkle, numbering, quality, queries, resampling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows, names):
    return sorted((tuple(None if r[c] is None or r[c] != r[c] else r[c] for c in names) for r in rows), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("key", ["op11_resampling", "op12_merkle_manifest"])
def test_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[key](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[key])
    names = [d[0] for d in cursor.description]
    assert set(names) == set(got.columns) and plain([r.asDict() for r in got.collect()], names) == plain([dict(zip(names, r)) for r in cursor.fetchall()], names)


# Numbers.


def test_numbers_follow_the_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), rng.randrange(500)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long")
    dealt = numbering.dealt(df, [F.col("g").asc_nulls_first(), "k"], "t", per_range=100)
    assert dealt.select("range").distinct().count() > 20
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    got = numbering.numbered(dealt, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(3000)) and [(r.g, r.k) for r in got] == sorted(rows, key=key)
    within = numbering.numbered_within(dealt, "g", "n", "size", "rank").collect()
    sizes, names = Counter(g for g, _ in rows), [None, "a", "b", "hot"]
    for name in names:
        mine = sorted((r for r in within if r.g == name), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(sizes[name])) and [r.k for r in mine] == sorted(k for g, k in rows if g == name)
        assert {(r.size, r["rank"]) for r in mine} == {(sizes[name], names.index(name))}


# Resampling.


def word_runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [x for x in w] + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resampling(docs, target, percent=25, least=20):
    features = [(d, *word_runs(t)) for d, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, _, fs in features for f in fs), Counter(bucket(f) for x in target for f in word_runs(x)[1])
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    rows = []
    for d, n, fs in features:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(sha(f"7:{'' if d is None else d}")[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_equals_brute_force(spark, corpus, prose):
    rows, df = corpus
    target = [prose(40) for _ in range(20)] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(df, goal)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    assert got == brute_resampling(rows, target) and sum(1 for r in got if r[4]) > 20
    # Small ranges give the same ranks.
    small = resampling.draw(out.select("doc_id", "n_words", "n_features", "weight"), per_range=7)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in small.collect()) == got


def test_equal_rows_split_over_ranges(spark):
    """Two thousand equal rows get two thousand ranks, and more than one range holds them."""
    weighed = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(30).alias("n_words"), F.lit(59).cast("long").alias("n_features"), F.lit(5).cast("long").alias("weight"))
    out = resampling.draw(weighed, percent=100, per_range=200)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 2001))


def test_resampling_of_empty_tables(spark, empty, prose):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, none).count() == 0
    docs = spark.createDataFrame([(1, prose(30)), (2, prose(30)), (3, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs, none, percent=50).collect()) == brute_resampling([(1, docs.collect()[0].text), (2, docs.collect()[1].text), (3, None)], [], percent=50)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_crcs_of_runs(longest):
    rng = random.Random(longest)
    texts = [" ".join("".join(rng.choice("abcé東0") for _ in range(rng.choice([1, 2, 5, 31, 32, 33, 200]))) for _ in range(rng.randrange(0, 9))) for _ in range(50)] + ["", "  ", "x" * 5000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    n, at, stream = resampling.features(data, offsets, 65536, longest)
    for i, t in enumerate(texts):
        w = t.split()
        want = [zlib.crc32(" ".join(w[k : k + r]).encode()) % 65536 for r in range(1, longest + 1) for k in range(len(w) - r + 1)]
        assert n[i] == len(w) and stream[at[i] : at[i + 1]].tolist() == want


def test_run_lengths():
    values, n = resampling.runs(np.array([1, 1, 3, 7, 7, 7], np.uint16))
    assert values.tolist() == [1, 3, 7] and n.tolist() == [2, 1, 3]
    assert [len(x) for x in resampling.runs(np.zeros(0, np.uint16))] == [0, 0]
    data = np.frombuffer(b"ab" + b"z" * 40, np.uint8)
    assert crc.of_spans(data, np.array([0, 2]), np.array([2, 42])).tolist() == [zlib.crc32(b"ab"), zlib.crc32(b"z" * 40)]


# Merkle manifest.


def tree(nodes):
    """The root, and for each node the groups it is folded with: (children, own place)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k].append((nodes[i // 2 * 2 : i // 2 * 2 + 2], i % 2))
        at = [i // 2 for i in at]
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(part(v + more if i == 3 and v is not None else v) for i, v in enumerate(r)))
    order = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in order]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(group, paths):
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for children, k in path + top:
                node = sha("".join(node if i == k else c for i, c in enumerate(children)))
            proof = sha("".join(c for children, k in path + top for i, c in enumerate(children) if i != k))
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return Counter(out)


def proved(df, **options):
    marked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return Counter(tuple(r) for r in merkle.proofs(merkle.manifest(df, marked, **options)).collect())


@pytest.mark.parametrize("levels", [1, 3, 4])
def test_manifest_equals_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["s1", None, "ü"]), rng.choice([None, "", "de", "en", "en", "en", "É"]), rng.choice([None, i]), rng.choice([None, "", "té東", "text " * 9])) for i in range(230)]
    rows += [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "a"), (5, "s", "en", 1, "other"), (900, None, "zz", 9223372036854775807, "x" * 100_000), *rows[:3]]
    df = spark.createDataFrame([(*r, "v") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string")
    got = proved(df, levels=levels, per_range=40)
    assert got == brute_manifest(rows) and 0 < sum(n for r, n in got.items() if not r[-1]) < 60


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 33])
def test_manifest_of_few_leaves(spark, n):
    rows = [(i, "s", "en", i, f"t {i}") for i in range(n)]
    assert proved(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute_manifest(rows)


def test_many_languages(spark):
    rows = [(i, "s", f"l{i}", i, "t") for i in range(75)]
    assert proved(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute_manifest(rows)


def test_empty_manifest(spark, empty):
    assert merkle.proofs(merkle.manifest(empty)).count() == 0


# Quality.


def test_messages_equal_enumeration():
    """Marginals of short chains by summing over all labellings."""
    rng = np.random.default_rng(3)
    at = np.array([0, 4, 4, 5, 11])
    evidence, move = rng.normal(size=11), rng.normal(size=(2, 2))
    forward, backward = quality.messages(evidence, at, move)
    got = 1 / (1 + np.exp(-(forward + backward)))
    for a, b in zip(at[:-1], at[1:]):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            weight = math.exp(sum(e for e, k in zip(evidence[a:b], y) if k) + sum(move[i, j] for i, j in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
        assert got[a:b] == pytest.approx(good / total, abs=1e-9)


def brute_line(text):
    """Some features of a line in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    raw = text.encode()
    letters = sum(65 <= b < 91 or 97 <= b < 123 for b in raw)
    return {"words": math.log1p(len(w)), "upper": sum(65 <= b < 91 for b in raw) / (letters + 1), "digits": sum(48 <= b < 58 for b in raw) / len(raw), "distinct": len(set(w)) / len(w), "repeats": sum(a == b for a, b in zip(w, w[1:])) / len(w), "bytes": math.log1p(len(raw))}


def test_line_features():
    texts = ["One two two TWO.\n\n  \nLast line! 12", "", "\n\n", "a\na\nb", "é | é # x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x, size, at = quality.lines(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    whole = [[line for line in re.findall(r"[^\n]*\n|[^\n]+", t) if line.strip()] for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in whole] and size.tolist() == [len(line.encode()) for w in whole for line in w]
    for row, line in zip(x, itertools.chain(*whole)):
        for name, v in brute_line(line).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(v, abs=1e-6), (line, name)


def junk(rng, n):
    kind = rng.randrange(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    return " | ".join(words) if kind == 0 else " ".join(f"{w.upper()}!!" for w in words) if kind == 1 else " ".join(words[:1] * n)


@pytest.fixture(scope="module")
def judged(spark, prose):
    """(rows, labels, model): good documents of prose lines, bad ones whose first line is prose too; a third held out."""
    rng = random.Random(17)
    rows, labels = [], {}
    for i in range(600):
        good = i % 4 != 0
        body = [prose(rng.randrange(5, 20)) + "." for _ in range(rng.randrange(1, 8))] if good else [junk(rng, rng.randrange(10, 40)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(([prose(6) + "."] if i % 8 < 4 else []) + body)))
        labels[i] = int(good)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    return rows, labels, quality.fit(df.filter(~quality.held_out()), marks.filter(~quality.held_out()))


def test_held_out_documents(spark, judged):
    rows, labels, model = judged
    out = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).filter(quality.held_out()).collect()
    right = sum((r.score >= 0.5) == labels[r.doc_id] for r in out)
    assert len(out) > 150 and right / len(out) > 0.97


def test_lines_are_labelled(spark, judged, prose):
    """In a document of both kinds each line has its own label, and the score lies with the longer part."""
    rng = random.Random(5)
    good, bad = [prose(12) + "." for _ in range(6)], [junk(rng, 30) for _ in range(6)]
    df = spark.createDataFrame([(1, "\n".join(good + bad)), (2, "\n".join(good)), (3, "\n".join(bad))], "doc_id long, text string")
    labelled = {(r.doc_id, r.line): r.good for r in quality.line_labels(df, judged[2]).collect()}
    assert len(labelled) == 24 and sum(labelled[1, k] for k in range(6)) >= 5 and not any(labelled[1, k] for k in range(7, 12))
    score = {r.doc_id: r.score for r in quality.score(df, judged[2]).collect()}
    assert score[2] > 0.9 and score[3] < 0.1 and score[3] <= score[1] < score[2]


def test_defined_cases_of_quality(spark, corpus, judged, empty):
    rows, df = corpus
    model = judged[2]
    out = quality.score(df, model)
    assert out.columns == [c for c in df.columns if c != "score"] + ["score"] and out.count() == len(rows)
    got = out.select("doc_id", "text", "score").collect()
    assert {r.score for r in got if not (r.text or "").strip()} == {model.share}
    assert len({r.score for r in got if r.text == "tie tie tie tie tie tie"}) == 1
    assert quality.score(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(df, quality.fit(df, labels)).collect()} == {0.5}
    only = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(df, quality.fit(df, only)).collect()} == {1.0}
    assert quality.fit(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).share == 0.5


def test_a_long_text_is_read_whole(spark, judged, prose):
    """Fifty thousand junk lines after a hundred good ones decide."""
    text = "\n".join([prose(12) + "."] * 100 + ["AAAA!! BBBB!! CCCC!! DDDD!! EEEE!! FFFF!!"] * 50_000)
    df = spark.createDataFrame([(1, text), (2, text[:6000])], "doc_id long, text string")
    score = {r.doc_id: r.score for r in quality.score(df, judged[2]).collect()}
    assert score[1] < 0.1 < 0.5 < score[2]
