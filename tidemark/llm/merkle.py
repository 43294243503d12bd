"""Merkle manifest of a table: one tree a language, their roots in one tree above, and a proof for every leaf.

A leaf is the hash of a row's columns; ``FAN`` consecutive nodes become one parent until one node is left.
Every parent is stored as its preimage, the concatenated hashes of its children.  A leaf joins the preimages
of its ancestors: cutting its own 64 signs out of each leaves the siblings (the proof), and putting another
hash there and hashing on folds that leaf up to a root.

Parents are built and stored in blocks of ``levels`` levels (``FAN ** levels`` nodes below one root), so a tree of n
leaves takes log(n) / levels rounds, each a shuffle of hashes only; texts are read once and never move.  Going down,
each block hands the preimages above its root to the block below, so a leaf meets one block and never a level at a time.

Defined cases: null columns have a form of their own in the leaf, so null and empty differ; a null ``lang`` is a
language of its own, first in order; rows of a language ascend by ``doc_id`` (null first), equal ids by their
leaf, and repeated rows are equal leaves side by side; a lone leaf is its language's root, a lone language's root the
root; an empty table has no rows and no root; texts of any length are one leaf; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import numbering, workspace

FAN, DIGEST = 2, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """Hash of the columns, each as ``<bytes>:<text>`` or ``-`` for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, lang, leaf`` of every row, and ``changed``: the leaf with 1 more in ``n_chars`` where ``tampered``, else null."""
    cols = [F.col(c) for c in COLUMNS]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    changed = F.when(tampered, leaf(more)) if tampered is not None else F.lit(None).cast("string")
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(cols).alias("leaf"), changed.alias("changed"))


def _grown(hashes: Column, levels: Column) -> Column:
    """From hashes in order: ``(nodes, preimages)`` after ``levels`` levels, the preimages level by level."""
    start = F.struct(hashes.alias("nodes"), F.lit(None).cast("array<array<string>>").alias("preimages"))

    def up(acc: Column, _: Column) -> Column:
        nodes = acc["nodes"]
        firsts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
        joined = F.transform(firsts, lambda j: F.array_join(F.slice(nodes, j * FAN + 1, FAN), ""))
        return F.struct(F.transform(joined, lambda p: F.sha2(p, 256)).alias("nodes"), F.concat(F.coalesce(acc["preimages"], F.array().cast("array<array<string>>")), F.array(joined)).alias("preimages"))

    return F.aggregate(F.slice(F.sequence(F.lit(0), levels), 2, 64), start, up)


def _rounds(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Blocks of every round from ``nodes(tree, i, n, hash)``, n nodes a tree: ``tree, i, n, preimages, hash``.

    The root of block i is node i of the next round; the last round has one block a tree, with the tree's root.
    """
    width, rounds = FAN**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or not rounds:
        own = F.least(F.ceil(F.log(float(FAN), F.col("n").cast("double")) - 1e-9), F.lit(levels)).cast("int")  # a last block stops at its root
        blocks = nodes.groupBy("tree", F.floor(F.col("i") / width).alias("i"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("below"))
        blocks = blocks.withColumn("g", _grown(F.col("below.hash"), own))
        blocks = blocks.select("tree", "i", F.ceil(F.col("n") / width).alias("n"), F.coalesce("g.preimages", F.array().cast("array<array<string>>")).alias("preimages"), F.get("g.nodes", F.lit(0)).alias("hash"))
        rounds.append(workspace.written(blocks, f"{name}-{len(rounds)}"))
        nodes, most = rounds[-1], -(-most // width)
    return rounds


def _path(levels: int) -> Column:
    """The ancestors of node ``at`` in its block, whose preimages are ``over``: lowest first, then those above: preimage and own slot."""
    inside = F.transform("over", lambda p, k: F.struct(F.get(p, F.floor((F.col("at") % FAN**levels) / F.pow(F.lit(FAN), k + 1)).cast("int")).alias("preimage"), (F.floor(F.col("at") / F.pow(F.lit(FAN), k)) % FAN).cast("int").alias("slot")))
    return F.concat(inside, F.coalesce("above", F.array().cast("array<struct<preimage:string,slot:int>>")))


def _handed_down(nodes: DataFrame, blocks: DataFrame, levels: int) -> DataFrame:
    """``nodes(tree, at, ...)`` with ``path``, and the roots that ``blocks(tree, i, preimages, above, ...)`` of the round above carry."""
    key = F.floor(F.col("at") / FAN**levels)
    met = nodes.withColumn("block", key).join(blocks.drop("n", "hash").withColumnsRenamed({"i": "block", "preimages": "over"}), ["tree", "block"])
    return met.withColumn("path", _path(levels)).drop("block", "over", "above")


def _down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest blocks with ``above``: all ancestors of their root, those of ``tops(tree, above, ...)`` last."""
    blocks = rounds[-1].join(tops, "tree")
    for lower in reversed(rounds[:-1]):
        blocks = _handed_down(lower.withColumnRenamed("i", "at"), blocks, levels).withColumnsRenamed({"at": "i", "path": "above"})
    return blocks


def siblings(path: Column) -> Column:
    """The other children of every ancestor, level by level, left to right."""
    cut = lambda x: F.concat(F.substr(x["preimage"], F.lit(1), x["slot"] * DIGEST), F.substr(x["preimage"], x["slot"] * DIGEST + DIGEST + 1))
    return F.transform(path, cut)


def folded(node: Column, path: Column) -> Column:
    """The root that ``node`` gives in place of the hash the ancestors hold."""
    def put(h: Column, x: Column) -> Column:
        return F.sha2(F.concat(F.substr(x["preimage"], F.lit(1), x["slot"] * DIGEST), h, F.substr(x["preimage"], x["slot"] * DIGEST + DIGEST + 1)), 256)

    return F.aggregate(path, node, put)


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = 4, per_range: int = 1_000_000) -> DataFrame:
    """Every row's ``doc_id, lang, leaf, changed, subroot, root, path``; ``path`` holds its ancestors' preimages and slots.

    ``tampered`` marks rows whose ``changed`` leaf is to be folded in place of their own.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    hashed = workspace.written(leaves(docs, tampered), "leaves")  # dealing reads its rows twice, the texts are read once
    placed = numbering.numbered_within(numbering.dealt(hashed, order, "ordered", per_range), "lang", "at", "n", "tree")
    placed = workspace.written(placed, "placed")  # trees are numbered in the order of their languages: a place in the tree above

    lower = _rounds(placed.select("tree", F.col("at").alias("i"), "n", F.col("leaf").alias("hash")), levels, "blocks")
    n_trees = lower[-1].count()
    roots = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(n_trees).cast("long").alias("n"), "hash")
    upper = _rounds(roots, levels, "crown")
    nothing = F.array().cast("array<struct<preimage:string,slot:int>>")
    crown = _down(upper, upper[-1].select("tree", nothing.alias("above"), F.col("hash").alias("root")), levels)
    tops = _handed_down(roots.select("tree", F.col("i").alias("at"), F.col("hash").alias("subroot")), crown, levels)
    tops = tops.select(F.col("at").alias("tree"), "subroot", "root", F.col("path").alias("above"))
    found = _handed_down(placed.drop("n"), _down(lower, tops, levels), levels)
    return found.select("doc_id", "lang", "leaf", "changed", "subroot", "root", "path")


def proofs(rows: DataFrame) -> DataFrame:
    """Of ``manifest`` rows: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    fold = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = rows.withColumn("folded_root", fold).withColumn("proof_sha256", F.sha2(F.array_join(siblings(F.col("path")), ""), 256))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
