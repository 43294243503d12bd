"""Benchmark decontamination with DataFrame functions only.

1. Anchors: every run of five words of every document is looked up among the items' runs; a document and
   an item go on if at least ``least`` of the item's runs are found, which a similarity of ``least`` needs.
   Each hit proposes the item-sized window whose last run it is, if enough hits are in it: the first of the
   best windows ends with a hit, or begins the document, so it is among them, also where the document
   cuts the item. A document shorter than the item is one window.
2. Each proposed window gets a fingerprint of its five-word runs: blocks of 64 parities.  A run belongs to one block, by
   its hash, so two windows differ in no more blocks than in runs, and ``least`` and the item's length give a
   radius, in blocks, that loses nothing.  A fingerprint has ``SPARE`` blocks and more beyond the radius, so it widens with the
   item, and a block holds some three runs at every length.
3. Multi-index Hamming: fingerprints within the radius agree on more blocks than are spared, so windows meet items
   of the length they were proposed for that share an indexed block.  Of an item all blocks with a run are indexed, and of
   its empty ones, which tell little, only those beyond the spare ones.  Pairs within the radius stay.
4. The exact weighted similarity of the five-word runs verifies: the sum of the lesser counts over the sum
   of the greater counts, at least ``least``.

The benchmark is broadcast only up to ``broadcast_rows`` runs (a checked count); beyond, and for
many contaminated documents, the same joins shuffle.

Defined cases: words are runs of letters and digits in lower case, so punctuation and case don't matter;
null and empty documents match nothing; null and empty items match nothing; an item with fewer than five
words is one run; repeated items each report; repeated rows report once for each ``doc_id``; null ``doc_id``
is a document of its own; an item that occurs several times in a document reports its best, then first,
start over all windows; ``size`` counts the window's words; very long texts are searched whole; ``leaks`` ignores other
columns, ``clean`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace
from tidemark.llm.licenses import WORD

RUN, SPARE = 5, 1
#: Tasks that fingerprint windows at most; beyond, a task gets more windows.
MOST_PARTS = 20_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _runs_of(df: DataFrame, w: str, sizes: list[int], *keep: str) -> DataFrame:
    """``keep, at, run, hash``: every run of each size at every word of ``w``, in one pass over the texts."""
    n = F.size(w)
    zipped = F.arrays_zip(*(F.slice(w, k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(max(sizes))))
    each = df.select(*keep, F.posexplode(zipped).alias("at", "r"))
    one = lambda s: F.struct(F.lit(s).alias("run"), F.when(F.col(f"r.w{s - 1}").isNotNull(), F.xxhash64(F.lit(s), *(F.col(f"r.w{k}") for k in range(s)))).alias("hash"))
    return each.select(*keep, "at", F.inline(F.array(*map(one, sizes)))).filter("hash is not null")


def _radius(size: Column, least: float) -> tuple[Column, Column]:
    """For an item's length: in how many runs windows alike enough may differ, and how many blocks are spared."""
    runs = F.greatest(size - RUN + 1, F.lit(1))
    return F.floor(2 * runs * ((1 - least) / (1 + least)) + 1e-6).cast("int"), (SPARE + F.floor(runs / 32)).cast("int")


def counted(df: DataFrame, key: str) -> DataFrame:
    """``key, size, h, c``: the runs of ``df(key, size, words)`` and how often each stands; a text without a whole run is one run."""
    run, n = F.least(F.col("size"), F.lit(RUN)), F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - run + 1, F.lit(1)))
    each = df.select(key, "size", F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, run)))).alias("h"))
    return each.groupBy(key, "size", "h").agg(F.count("*").alias("c"))


def fingerprinted(runs: DataFrame, key: str, least: float) -> DataFrame:
    """``key, size, radius, spare, blocks`` of ``counted`` rows; each block is the parities of its runs, 0 without any."""
    radius, spare = _radius(F.col("size"), least)
    n = radius + spare + 1
    filled = runs.select(key, "size", F.pmod("h", n).cast("int").alias("block"), F.xxhash64("h", "c").alias("v"))
    empty = runs.select(key, "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.lit(0).cast("long").alias("v"))
    cells = filled.unionByName(empty.distinct()).groupBy(key, "size", "block").agg(F.bit_xor("v").alias("v"))
    whole = cells.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct("block", "v"))).alias("cells"))
    return whole.select(key, "size", radius.alias("radius"), spare.alias("spare"), F.col("cells.v").alias("blocks"))


def indexed(prints: DataFrame, key: str, all_blocks: bool) -> DataFrame:
    """``key, size, block, v``: rows of the block tables; of an item (not ``all_blocks``) without as many empty blocks as are spared."""
    each = prints.select(key, "size", "spare", F.col("blocks"), F.posexplode("blocks").alias("block", "v"))
    if all_blocks:
        return each.select(key, "size", "block", "v")
    before = F.size(F.filter(F.slice("blocks", 1, F.col("block")), lambda v: v == 0))  # empty blocks before this one
    return each.filter((F.col("v") != 0) | (before >= F.col("spare"))).select(key, "size", "block", "v")


def near(windows: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """``window, item, distance`` of fingerprints that differ in ``radius`` blocks or fewer: both tables are ``fingerprinted``."""
    known = indexed(items, "item", False)
    met = indexed(windows, "window", True).join(F.broadcast(known) if small else known, ["size", "block", "v"]).select("window", "item").distinct()
    prints = items.select("item", F.col("blocks").alias("item_blocks"))
    both = met.join(windows.select("window", "radius", "blocks"), "window").join(F.broadcast(prints) if small else prints, "item")
    differ = F.size(F.filter(F.zip_with("blocks", "item_blocks", lambda a, b: a != b), lambda x: x))
    return both.select("window", "item", differ.alias("distance"), "radius").filter("distance <= radius").drop("radius")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``doc_id, item_id, start, size, distance, similarity`` of every item found in a document."""
    best = _found(docs, benchmark, least, broadcast_rows).groupBy("doc_id", "item", "item_id").agg(F.min(F.struct(-F.col("similarity"), "start", "size", "distance")).alias("m"))
    return best.select("doc_id", "item_id", "m.start", "m.size", "m.distance", (-F.col("m.col1")).alias("similarity"))


def _found(docs: DataFrame, benchmark: DataFrame, least: float, broadcast_rows: int) -> DataFrame:
    """All windows at least ``least`` similar to an item, with the ``text_hash`` of their document."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumns({"item": F.monotonically_increasing_id(), "size": F.size("words")}).withColumn("run", F.least(F.col("size"), F.lit(RUN)))
    items = workspace.written(items, "items")
    sizes = sorted(r["run"] for r in items.select("run").distinct().collect())  # of 1 to 5
    if not sizes:
        return docs.select("doc_id").limit(0).crossJoin(benchmark.select("item_id").limit(0)).selectExpr("doc_id", "0L as text_hash", "0L as item", "item_id", "0 as start", "0 as size", "0 as distance", "0D as similarity")
    n_runs = items.agg(F.sum("size")).first()[0] or 0
    small = n_runs <= broadcast_rows
    texts = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    own = _runs_of(items.withColumnRenamed("run", "own_run"), "words", sizes, "item", "size", "own_run").filter("run = own_run").select("item", "size", "hash", F.col("at").alias("item_at"))
    hits = _runs_of(texts.select("doc_id", "text_hash", words(F.col("text")).alias("w")), "w", sizes, "doc_id", "text_hash").drop("run").join(F.broadcast(own) if small else own, "hash").drop("hash")
    runs_of = F.greatest(F.col("size") - RUN + 1, F.lit(1))
    need = F.ceil(runs_of * least).cast("int")
    proposed = hits.groupBy("doc_id", "text_hash", "item", "size").agg(F.count_distinct("item_at").alias("n"), F.array_sort(F.collect_set("at")).alias("at"))
    ends = F.filter("at", lambda x, i: F.get("at", i - need + 1) >= x - runs_of + 1)  # enough hits in the window that ends with this one
    starts = F.array_distinct(F.transform(ends, lambda x: F.greatest(x - runs_of + 1, F.lit(0))))
    proposed = proposed.filter(F.col("n") >= need).select("doc_id", "text_hash", "size", starts.alias("starts")).filter(F.size("starts") > 0)
    proposed = workspace.written(proposed, "anchors")
    n_windows = proposed.agg(F.sum(F.size("starts"))).first()[0] or 0
    few = n_windows <= broadcast_rows  # of some 30 bytes each
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    starts = proposed.select("doc_id", "text_hash", "size", F.explode("starts").alias("start")).distinct()
    starts = starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "size")).alias("windows"))
    owned = texts.join(F.broadcast(starts) if few else starts, same(texts, starts)).select(texts["doc_id"], texts["text_hash"], "text", "windows")
    owned = owned.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words(F.col("text")).alias("w"), F.explode("windows").alias("x"))
    windows = owned.select("doc_id", "text_hash", "x.start", "x.size", F.slice("w", F.col("x.start") + 1, F.col("x.size")).alias("words"))
    windows = workspace.written(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    dealt = windows.repartition(min(MOST_PARTS, workspace.parts_for(n_windows, 2000, 2)), "window")  # by number, since a window costs much more than it weighs
    runs = workspace.written(counted(dealt, "window"), "runs")
    item_runs = workspace.written(counted(items, "item"), "item-runs")
    # written, as the plan of all three steps at once takes much of a driver's memory
    pairs = workspace.written(near(fingerprinted(runs, "window", least), fingerprinted(item_runs, "item", least), small), "pairs")
    return _verified(pairs, runs, item_runs, windows, items, least)


def _verified(pairs: DataFrame, runs: DataFrame, item_runs: DataFrame, windows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The pairs whose exact weighted similarity is at least ``least``: their runs meet by hash."""
    sizes = lambda df, key, out: df.groupBy(key).agg(F.sum("c").alias(out))
    theirs = item_runs.select("item", "h", F.col("c").alias("ic"))
    met = pairs.join(runs.select("window", "h", "c"), "window").join(theirs, ["item", "h"])
    shared = met.groupBy("window", "item", "distance").agg(F.sum(F.least("c", "ic")).alias("shared"))
    known = shared.join(sizes(runs, "window", "a"), "window").join(sizes(item_runs, "item", "b"), "item")
    alike = known.withColumn("similarity", F.col("shared") / (F.col("a") + F.col("b") - F.col("shared"))).filter(F.col("similarity") >= least)
    placed = windows.select("window", "doc_id", "text_hash", "start", F.size("words").alias("size"))
    return alike.join(placed, "window").join(items.select("item", "item_id"), "item").select("doc_id", "text_hash", "item", "item_id", "start", "size", "distance", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the documents in which an item is found: all rows of their ``doc_id``, or of their text where it is null."""
    own = lambda h: F.when(F.col("doc_id").isNull(), h)
    bad = _found(docs, benchmark, least, broadcast_rows).select(F.col("doc_id").alias("bad_id"), own(F.col("text_hash")).alias("bad_text")).distinct()
    bad = workspace.written(bad, "bad")
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), own(F.xxhash64("text")).alias("own"))  # no name of ``docs`` clashes
    return whole.join(bad, whole["id"].eqNullSafe(bad["bad_id"]) & whole["own"].eqNullSafe(bad["bad_text"]), "left_anti").select("doc.*")
