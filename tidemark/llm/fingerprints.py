"""SimHash fingerprints with DataFrame functions only.

The terms of a text are its neighbouring word pairs; a term's weight is the bytes of its two words, 24 at most
(longer pairs, such as two links, would outvote a text's prose), and every occurrence votes with that weight on each of the 64 bits of the term's hash.  Two bits share
one long sum (32 bits each), so 32 sums hold all votes and the partial sums of a text, made where it is
read, are all that is shuffled.

``within`` finds all fingerprints within a Hamming radius by permuted block tables: 64 bits are cut into
``blocks`` blocks; fingerprints that differ in at most ``radius`` bits agree on at least
``blocks - radius`` of them, so each choice of that many blocks is one table, and a lookup in all tables
misses none.

Defined cases: null text counts as empty; a text without words has the fingerprint of zeros, likeness 1
to another such text and 0 to any other; null ``doc_id`` sorts first; rows with equal ``doc_id`` are
ordered by their text's hash; very long texts are read whole; the only document is its own next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, _LANE = 64, 0x0000000100000001


def _ranges(docs: DataFrame, rows_per_range: int, most: int) -> DataFrame:
    """``docs(doc_id, text_hash)`` with ``range``: a number that ascends with ``doc_id``, about ``rows_per_range`` rows each."""
    n = docs.select("doc_id").count()
    k = max(1, min(most, n // rows_per_range))
    cuts = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k)).first()[0] if k > 1 else []
    splits = [float("-inf"), *sorted({float(c) for c in cuts or []}), float("inf")]
    out = docs.withColumn("__id", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        out = Bucketizer(splits=splits, inputCol="__id", outputCol="range", handleInvalid="keep").transform(out)
    else:
        out = out.withColumn("range", F.lit(0))
    # Rows without an id come first, in 1024 ranges of their text's hash.
    unnamed = F.shiftright("text_hash", 54) - 513
    return out.drop("__id").withColumn("range", F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.col("range")).cast("int"))


def _ordered() -> Window:
    return Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text_hash")


def with_next(docs: DataFrame, rows_per_range: int = 4096, most_ranges: int = 100_000) -> DataFrame:
    """``doc_id, text, next_text`` and the columns ``range, extra, text_hash`` that hold the order.

    Texts are dealt by ranges of ``doc_id`` once.  The first row of each range is repeated behind the range
    before it (``extra`` 1), so the next document is a neighbour within the range; the last range gets the
    very first row.  At most ``most_ranges`` first rows (and 1024 without an id) exist, and only they are broadcast,
    without texts.  Beyond ``most_ranges * rows_per_range`` rows the ranges grow, not their number.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = _ranges(rows, rows_per_range, most_ranges)
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash")
    heads = rows.groupBy("range").agg(F.min(key).alias("head"))
    before = Window.orderBy("range")
    heads = heads.select(F.coalesce(F.lag("range").over(before), F.max("range").over(Window.partitionBy())).alias("target"), "head")
    heads = heads.select("target", F.col("head.doc_id").alias("head_id"), F.col("head.text_hash").alias("head_hash"))
    extra = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_hash")))
    extra = extra.select("doc_id", "text", F.col("target").alias("range"), "text_hash", F.lit(1).alias("extra"))
    both = rows.select("doc_id", "text", "range", "text_hash", F.lit(0).alias("extra")).unionByName(extra)
    return both.withColumn("next_text", F.lead("text").over(_ordered()))


def terms(text: Column) -> Column:
    """Neighbouring word pairs; the last word stands alone; one empty word, of weight 0, for a text without words."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[ \t\n\x0B\f\r]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def fingerprint(rows: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """``rows`` grouped by ``keys`` with the fingerprint ``out`` (long) of ``text`` and its weight ``out_weight``."""
    pair = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("t"))
    a, b = F.col("t").getField("a"), F.col("t").getField("b")
    weight = F.coalesce(F.least(F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0)), F.lit(24)), F.lit(0)).cast("long")
    votes = pair.select(*keys, weight.alias("w"), F.xxhash64(a, b).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANE)) * F.col("w")).alias(f"s{k}") for k in range(BITS // 2)]
    summed = votes.groupBy(*keys).agg(F.sum("w").alias(f"{out}_weight"), *sums)
    total = F.col(f"{out}_weight")
    bits = F.lit(0).cast("long")
    for k in range(BITS // 2):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{k}", 32)
        for n, place in ((low, k), (high, k + 32)):
            bits = bits.bitwiseOR(F.when(2 * n > total, F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, f"{out}_weight", bits.alias(out))


def likeness(a: str, b: str) -> Column:
    """Estimated cosine of two texts' weighted terms, from the bits that differ; 0 to 1."""
    differ = F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    empty_a, empty_b = F.col(f"{a}_weight") == 0, F.col(f"{b}_weight") == 0
    return F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(F.greatest(F.lit(0.0), F.cos(differ * (3.141592653589793 / BITS))))


def text_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def edited_pairs(docs: DataFrame, rows_per_range: int = 4096) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and both likenesses."""
    rows = with_next(docs, rows_per_range)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))})
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "edited_sha256": F.sha2("edited", 256)})
    keys = ["range", "extra", "doc_id", "text_hash", "row", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("x")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("x")))).alias("e")).select(*keys, "e.v", "e.x")
    found = fingerprint(both, [*keys, "v"], "x", "fp")
    pick = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    side = found.groupBy(*keys).agg(pick(0, "fp").alias("fp"), pick(0, "fp_weight").alias("fp_weight"), pick(1, "fp").alias("ed"), pick(1, "fp_weight").alias("ed_weight"))
    side = side.withColumns({"nx": F.lead("fp").over(_ordered()), "nx_weight": F.lead("fp_weight").over(_ordered())})
    return side.filter("extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", text_of("fp").alias("fingerprint"), text_of("ed").alias("edited_fingerprint"),
        likeness("fp", "ed").alias("near_edited"), likeness("fp", "nx").alias("near_next"), F.col("fp").alias("bits"),
    )


def within(fingerprints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs ``query, found, distance`` of distinct fingerprints within ``radius`` bits.

    Both sides have a long column ``bits``; equal fingerprints are looked up once.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    mask = lambda chosen: sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(mask(c)) for c in combinations(range(blocks), blocks - radius)]

    def tables(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(i).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)))
        return df.select("bits").distinct().select(F.col("bits").alias(name), F.explode(entries).alias("e")).select(name, "e.table", "e.block")

    pairs = tables(queries, "query").join(tables(fingerprints, "found"), ["table", "block"])
    pairs = pairs.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("found"))))
    return pairs.filter(F.col("distance") <= radius).select("query", "found", "distance").distinct()


def with_near(rows: DataFrame, every: int = 50, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``rows(doc_id, bits)`` with ``n_near``: how many other rows are within ``radius`` bits of one whose id ``every`` divides; null for the others."""
    known = rows.groupBy("bits").agg(F.count("*").alias("copies"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    pairs = within(known, rows.filter(asks).select("bits"), radius, blocks)
    near = pairs.join(known, pairs["found"] == known["bits"]).groupBy("query").agg((F.sum("copies") - 1).alias("n_near"))
    met = rows.join(near, asks & (rows["bits"] == near["query"]), "left")
    return met.drop("query")
