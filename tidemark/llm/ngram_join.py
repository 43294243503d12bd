"""Exact Jaccard join of documents on word 5-shingles by a token-group matrix, and its components.

1. The least third of a document's shingles, by hash, are dealt by hash and counted.  Two linked documents have
   ``1 + need // 8`` of them in common at least, so documents with fewer that another one has are done: this test is a
   shuffle, with no sketch that a large corpus fills.  The others, and one row of each of their shingle sets, are
   marked in two bitmaps over documents.  Documents with the same set are one set from here on, and a
   count-min sketch, over the sets, takes out the shingles that no other set has: they count for a set's size but
   match nothing.  Sets left with too few shared shingles are done too: this is the matrix with one group, everything else.
2. Sets are put into groups by their first shared shingle in one global order (frequent shingles last), which
   similar sets share as likely as they are similar; a set that its frequent shingles alone could link goes
   by the least of those, so that a crowd is a few groups.  Groups above a size are split into blocks.
   Each group is opened by one task that links its sets exactly.
3. The token-group matrix holds, for every group, the union of its sets' shingle prefixes.  A prefix is so
   long that two linked sets share at least ``1 + need // 16`` of its shingles; a set's overlap with a group's
   union bounds its overlap with each member.  Only groups that reach the bound are opened: the set is
   sent there, its overlap with the whole union is checked, then its overlap with each member.
4. The matrix is used twice: first each set goes to the group it overlaps most, which joins most of a
   crowd of near copies; then to every qualifying group that still holds another component.  The set of
   the smaller component is sent to the larger.  Links inside a component change nothing and are left out.

Components are found by alternating large-star and small-star rounds over the links between
components; nothing is collected.

Defined cases: null and empty text and text without words have no shingles and link with nothing; a text
with fewer than five words is one shingle; equal rows link; a null ``doc_id`` is never a component's
name unless no other is there; very long texts are compared whole, a large set's rows split; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sketch, workspace
from tidemark.llm.hashing import LOWER, SPACED, Words, chunks, mix, window_hashes

_SETS = "h1 long, h2 long, gid long, comp long, n long, tokens array<long>"

#: Bytes of text taken apart at once: its arrays take some 70 times as much, in every worker.
CHUNK = 1 << 18


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, document after document and ascending; how many of each document)."""
    low = LOWER[data]
    w = Words(low, offsets, SPACED)
    h = w.hashes(low)
    at, doc = w.windows(h, size)
    full = window_hashes(h, at, size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = window_hashes(h, w.first[short], w.counts[short])
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    lists = [np.unique(full[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    for i, x in zip(short.tolist(), whole):
        lists[i] = np.array([x], np.uint64)
    return (np.concatenate(lists) if lists else np.zeros(0, np.uint64)), np.array([len(x) for x in lists], np.int64)


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.astype(np.uint64).view(np.int64)))


def _tokens(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens, offsets) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), at - at[0]


def _need(n, percent: int):
    """Least overlap of a set of size ``n`` with any set it links with."""
    return -(-percent * n // 100)


def _least(n, percent: int):
    """How many of the least shingles of a set of size ``n`` are compared first: two linked sets share ``1 + need // 8`` of them, by the smaller need."""
    need = _need(n, percent)
    return np.minimum(n - need + 1 + need // 8, n)


def _names(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set of shingles."""
    x, y = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat, s), dtype=np.uint64)]) for s in (21, 22))
    return mix(x[at[1:]] - x[at[:-1]]).view(np.int64), mix(y[at[1:]] - y[at[:-1]]).view(np.int64)


class Order:
    """The global order of tokens: light ones by hash, then heavy ones by count and hash."""

    def __init__(self, heavy: np.ndarray, n: np.ndarray):
        h = heavy.view(np.uint64)
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, n))] = np.arange(len(h))
        by = np.argsort(h)
        self.hashes, self.rank = h[by], rank[by]

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """-1 for light tokens, else the place among the heavy ones."""
        out = np.full(len(tokens), -1, np.int64)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
            same = self.hashes[k] == tokens
            out[same] = self.rank[k[same]]
        return out

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        """Ascending tokens of one set in the global order."""
        r = self.ranks(tokens)
        return tokens[np.argsort(r, kind="stable")]


def link_sets(tokens: np.ndarray, at: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Exact components of the sets of one group: for each set the index of one set of its component.

    ``size`` counts all tokens of a set, also those that are not in ``tokens`` since no other set has them.
    A set is compared only with sets not reached yet, whose tokens are scanned together.
    """
    m = len(at) - 1
    root = np.full(m, -1)
    held = np.diff(at)
    _, token = np.unique(tokens, return_inverse=True)
    mark = np.zeros(token.max() + 1 if len(token) else 1, bool)
    left = np.argsort(size, kind="stable")
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        queue = [first]
        flat, edges = None, None
        while queue and len(left):
            x = queue.pop()
            if flat is None:
                flat = np.concatenate([token[at[i] : at[i + 1]] for i in left])
                edges = np.concatenate([[0], np.cumsum(held[left])])
            mine = token[at[x] : at[x + 1]]
            mark[mine] = True
            total = np.concatenate([[0], np.cumsum(mark[flat])])
            mark[mine] = False
            both = total[edges[1:]] - total[edges[:-1]]
            found = 100 * both >= percent * (size[x] + size[left] - both)
            if found.any():
                root[left[found]] = first
                queue += left[found].tolist()
                left, flat = left[~found], None
    return root


def links(docs: DataFrame, size: int = 5, percent: int = 75, group_tokens: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """``(rows, sets)``: per row of ``docs`` ``doc_id, text_hash, n_shingles, candidate, h1, h2``; per set of the candidates ``h1, h2, root``."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text_hash"))
    n_bytes, n_rows = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()

    def least(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for a, b, data, offsets in chunks(batch, most=CHUNK):
            flat, n = shingles(data, offsets, size)
            at, m = np.concatenate([[0], np.cumsum(n)]), _least(n, percent)
            picked = flat[np.arange(int(m.sum())) + np.repeat(at[:-1] - (np.cumsum(m) - m), m)]
            some = n > 0
            # A linked set has ``need`` shingles at least, so its own share of the least ones may be that much smaller.
            must = 1 + _need(_need(n, percent), percent) // 8
            yield mix(picked, 25), m[some], must[some], _names(flat, at)[0][some], batch.column("row").slice(a, b - a).to_numpy()[some]

    with workspace.Scratch(spark) as scratch:
        found = sketch.met(texts.select("text", "row"), least, int((n_bytes or 0) / 6 * (1 - percent * 7 / 800)))
        found = scratch.written(found.groupBy("key").agg(F.min("row").alias("row")), "met")
        bits = int(np.clip(np.ceil(np.log2(max(16 * n_rows, 1))), 16, 28))
        bitmap, first = (sketch.repeated(found.select(c), lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)]), bits, least=1) for c in ("key", "row"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, data, offsets in chunks(batch, most=CHUNK):
                flat, n = shingles(data, offsets, size)
                at = np.concatenate([[0], np.cumsum(n)])
                h1, h2 = _names(flat, at)
                candidate = (n > 0) & bitmap.value.may_repeat(h1.view(np.uint64))
                shown = candidate & first.value.may_repeat(batch.column("row").slice(a, b - a).to_numpy().view(np.uint64))
                kept, mask = [], np.ones(b - a, bool)
                for i in np.flatnonzero(shown).tolist():
                    pair = (int(h1[i]), int(h2[i]))
                    if pair not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(pair)
                        kept.append(flat[at[i] : at[i + 1]])
                        mask[i] = False
                m = np.where(mask, 0, n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), pa.array(np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)), mask=pa.array(mask))
                kept_columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(n), pa.array(candidate), pa.array(h1), pa.array(h2), lists], names=["doc_id", "text_hash", "n_shingles", "candidate", "h1", "h2", "tokens"])

    rows = workspace.written(texts.mapInArrow(first_pass, "doc_id long, text_hash long, n_shingles long, candidate boolean, h1 long, h2 long, tokens array<long>"), "sets")
    bitmap.destroy()
    first.destroy()
    with workspace.Scratch(spark) as scratch:
        sets, order, buckets = _grouped(rows, scratch, percent, group_tokens)
    labels = sets.select(F.col("comp").alias("node"), F.col("comp").alias("root")).distinct()
    for every in (False, True):
        with workspace.Scratch(spark) as scratch:
            edges = scratch.written(_open_by_matrix(sets, labels, order, percent, buckets, every, scratch), "links")
            labels = _merge(labels, edges)
    return rows.drop("tokens"), sets.join(labels, sets["comp"] == labels["node"]).select("h1", "h2", "root")


def _grouped(rows: DataFrame, scratch: workspace.Scratch, percent: int, group_tokens: int) -> tuple[DataFrame, Order, int]:
    """The sets of all candidates in their groups, each group linked; the token order; the number of buckets."""
    found = _shared(scratch.written(rows.filter("tokens is not null").select("h1", "h2", "tokens").dropDuplicates(["h1", "h2"]), "distinct"), scratch, percent)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u[c >= 8].view(np.int64)), pa.array(c[c >= 8])], names=["token", "n"])

        for batch in batches:
            held.append(_tokens(batch.column("tokens"))[0])
            if sum(map(len, held)) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    # Only the order depends on this list, never a result; it is bounded so that it can be sent to every task.
    heavy = found.select("tokens").mapInArrow(frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 64")
    most = heavy.orderBy(F.desc("n"), "token").limit(100_000).toArrow()
    order = Order(most.column("token").to_numpy(), most.column("n").to_numpy())

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _tokens(batch.column("tokens"))
            r = order.ranks(flat)
            need = _need(batch.column("n").to_numpy(), percent)
            lead = np.empty(len(need), np.uint64)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                frequent = np.flatnonzero(r[a:b] >= 0)
                # Frequent tokens alone may link this set: crowds then meet under a frequent token, not each under a rare one.
                lead[i] = flat[a + (frequent[0] if 2 * len(frequent) >= need[i] else r[a:b].argmin())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead.view(np.int64))], names=["h1", "h2", "n", "tokens", "lead"])

    led = found.mapInArrow(grouped, "h1 long, h2 long, n long, tokens array<long>, lead long")
    # Groups above the size, settled so that the join knows how few they are: at most (all tokens / group_tokens).
    large = scratch.written(led.groupBy("lead").agg(F.sum(F.size("tokens")).alias("held")).filter(F.col("held") > group_tokens).select("lead", F.expr(f"held div {group_tokens} + 1").alias("blocks")), "large")
    total = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    buckets = max(16, int(total // group_tokens) * 2)
    placed = led.join(large, "lead", "left").withColumn("gid", F.xxhash64("lead", F.pmod("h1", F.coalesce("blocks", F.lit(1).cast("long"))))).drop("blocks")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)).cast("int"))

    def open_groups(key: tuple, table: pa.Table) -> pa.Table:
        h1, h2, gid, full = (table.column(c).to_numpy() for c in ("h1", "h2", "gid", "n"))
        flat, at = _tokens(table.column("tokens"))
        rows_ = np.lexsort((h2, h1, gid))
        comp = h1[rows_].copy()
        edges = np.flatnonzero(np.append(True, gid[rows_][1:] != gid[rows_][:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(rows_)]):
            if b - a > 1:
                mine = rows_[a:b]
                n = at[mine + 1] - at[mine]
                root = link_sets(np.concatenate([flat[at[i] : at[i + 1]] for i in mine]), np.concatenate([[0], np.cumsum(n)]), full[mine], percent)
                comp[a:b] = h1[mine][root]
        return pa.table({"h1": h1[rows_], "h2": h2[rows_], "gid": gid[rows_], "comp": comp, "n": full[rows_], "tokens": table.column("tokens").combine_chunks().take(pa.array(rows_))})

    return workspace.written(placed.groupBy("bucket").applyInArrow(open_groups, _SETS), "groups"), order, buckets


def _shared(found: DataFrame, scratch: workspace.Scratch, percent: int) -> DataFrame:
    """``h1, h2, n, tokens``: the tokens that may be in another set too, for sets that have enough of them."""
    bitmap = sketch.repeated(found.select("tokens"), lambda batch: iter([mix(_tokens(batch.column("tokens"))[0], 23)]), 28)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                flat, at = _tokens(batch.column("tokens"))
                hit = bitmap.value.may_repeat(mix(flat, 23))
                n = np.diff(at)
                m = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                enough = (100 * m >= percent * n) & (n > 0)
                hit &= np.repeat(enough, n)
                some = batch.filter(pa.array(enough))
                yield pa.RecordBatch.from_arrays([some.column("h1"), some.column("h2"), pa.array(n[enough]), _lists(flat[hit], m[enough])], names=["h1", "h2", "n", "tokens"])

    kept = scratch.written(found.mapInArrow(keep, "h1 long, h2 long, n long, tokens array<long>"), "shared")
    bitmap.destroy()
    return kept


def _open_by_matrix(sets: DataFrame, labels: DataFrame, order: Order, percent: int, buckets: int, every: bool, scratch: workspace.Scratch) -> DataFrame:
    """Links ``a, b`` between components that the matrix leads to; with ``every`` all of them."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):  # a prefix token is five numbers, so few rows at a time
                batch = whole.slice(k, 1000)
                flat, at = _tokens(batch.column("tokens"))
                n, held_n = batch.column("n").to_numpy(), np.diff(at)
                length = held_n - _need(n, percent) + 1 + n // 16
                picked = [order.sort(flat[a:b])[:m] for a, b, m in zip(at[:-1].tolist(), at[1:].tolist(), np.minimum(length, held_n).tolist())]
                length = np.array([len(x) for x in picked], np.int64)
                rep = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), length))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64) if picked else np.zeros(0, np.int64)), rep("h1"), rep("gid"), rep("comp"), pa.array(np.repeat(n, length))], names=["token", "h1", "gid", "comp", "n"])

    sizes = sets.select("comp").join(labels, F.col("comp") == F.col("node")).groupBy("root").agg(F.count("*").alias("m"))
    weighed = labels.join(sizes, "root").select("node", F.struct("m", "root").alias("rank"))
    held = sets.mapInArrow(prefixes, "token long, h1 long, gid long, comp long, n long").join(weighed, F.col("comp") == F.col("node")).drop("comp", "node")
    spread = held.groupBy("token").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least.root != most.root").select("token", "most")
    held = scratch.written(held.join(spread, "token"), "prefixes")
    matrix = held.groupBy("token", "gid").agg(F.max("rank").alias("g_rank"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count("*").alias("rows"))
    if not every:
        matrix = matrix.groupBy("token").agg(F.max(F.struct("g_rank", "rows", "gid", "n_min", "n_max")).alias("g")).select("token", "g.*")
    matrix = matrix.withColumnRenamed("gid", "g_gid")
    queries = held.filter("rank != most").select("token", "h1", "gid", "n", "rank")
    met = queries.join(matrix, "token").filter((F.col("gid") != F.col("g_gid")) & (F.col("rank") < F.col("g_rank")) & (100 * F.col("n_min") <= 10000 / percent * F.col("n") + 1) & (100 * F.col("n_max") >= percent * F.col("n")))
    hits = met.groupBy("h1", F.col("g_gid").alias("gid"), "n").agg(F.count("*").alias("hits"))
    if every:
        sent = hits.filter(F.col("hits") >= 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 16))
    else:
        sent = hits.groupBy("h1").agg(F.max(F.struct("hits", "gid")).alias("g")).select("h1", "g.gid")
    sent = scratch.written(sent.select("h1", F.col("gid").alias("to")), "queries")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")
    rooted = sets.join(labels, F.col("comp") == F.col("node")).select("h1", "gid", "root", "n", "tokens")
    # Own names: a cogroup tells its sides apart by their columns, and both come from the same sets.
    asked = rooted.select("h1", F.col("root").alias("q_root"), F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens")).join(sent, "h1").select(bucket("to"), F.col("to").alias("q_gid"), "q_root", "q_n", "q_tokens")
    opened = rooted.join(sent.select(F.col("to").alias("gid")).distinct(), "gid", "left_semi").select(bucket("gid"), "gid", "root", "n", "tokens")

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q_gid, q_root = left.column("q_gid").to_numpy(), left.column("q_root").to_numpy()
        g_gid, g_root = right.column("gid").to_numpy(), right.column("root").to_numpy()
        q_size, g_size = left.column("q_n").to_numpy(), right.column("n").to_numpy()
        (q, q_at), (g, g_at) = (_tokens(t.column(c)) if len(t) else (np.zeros(0, np.uint64), np.zeros(1, np.int64)) for t, c in ((left, "q_tokens"), (right, "tokens")))
        out: set[tuple[int, int]] = set()
        by = np.argsort(g_gid, kind="stable")
        for gid in np.unique(q_gid):
            mine = by[np.searchsorted(g_gid[by], gid) : np.searchsorted(g_gid[by], gid, side="right")]
            if not len(mine):
                continue
            size = g_size[mine]
            flat, owner = np.concatenate([g[g_at[i] : g_at[i + 1]] for i in mine]), np.repeat(np.arange(len(mine)), g_at[mine + 1] - g_at[mine])
            place = np.argsort(flat, kind="stable")
            flat, owner = flat[place], owner[place]
            for i in np.flatnonzero(q_gid == gid):
                x = q[q_at[i] : q_at[i + 1]]
                lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
                n = hi - lo
                if 100 * (n > 0).sum() < percent * q_size[i]:  # the bound by the group's whole union
                    continue
                both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(mine))
                for root in np.unique(g_root[mine[100 * both >= percent * (q_size[i] + size - both)]]):
                    if root != q_root[i]:
                        out.add((min(int(root), int(q_root[i])), max(int(root), int(q_root[i]))))
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return asked.groupBy("bucket").cogroup(opened.groupBy("bucket")).applyInArrow(verify, "a long, b long").distinct()


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after the components ``edges`` join."""
    if edges.isEmpty():
        return labels
    with workspace.Scratch(labels.sparkSession) as scratch:
        roots = connected(edges, scratch)
        moved = labels.join(roots.withColumnRenamed("root", "new"), F.col("root") == roots["node"], "left")
        return workspace.written(moved.select(labels["node"], F.coalesce("new", "root").alias("root")), "labels")


def connected(edges: DataFrame, scratch: workspace.Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the least node of its component.

    Alternating large-star and small-star; every round is written, and ends when no edge changes.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    stars, before = scratch.written(stars, "stars"), None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = scratch.written(small.filter("u != v").distinct(), "stars")
        scratch.clear(keep=1)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _members(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows that link with nothing, and rows of components with their ``root``."""
    rows, sets = links(docs, size, percent)
    member = rows.filter("candidate").join(sets, ["h1", "h2"], "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "h1").alias("root"))
    return rows.filter("not candidate"), workspace.written(member, "members")


def components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, the smallest ``doc_id`` reachable by links."""
    alone, member = _members(docs, size, percent)
    alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    names = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return alone.unionByName(member.join(names, "root").select("doc_id", "n_shingles", "component_id"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``doc_id``, among equal ones the smallest text hash.

    Rows that link with nothing all stay.  Only rows of a component that holds several rows are
    compared again: they are dealt by ``doc_id`` and text, of repeated rows one stays.
    """
    _, member = _members(docs, size, percent)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    stays = member.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("n")).filter("n > 1")
    crowd = member.select("root", row.alias("row")).distinct().join(stays, "root")
    crowd = crowd.groupBy("row").agg(F.max(F.col("row") == F.col("first")).alias("stays")).select(F.col("row.doc_id").alias("crowd_id"), F.col("row.text_hash").alias("crowd_hash"), "stays")
    crowd = workspace.written(crowd, "crowd")
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))  # no name of ``docs`` clashes
    # The crowd grows with the documents, so they always meet by a shuffle: one plan at every size.
    met = whole.join(crowd.hint("merge"), F.col("id").eqNullSafe(F.col("crowd_id")) & (F.col("hash") == F.col("crowd_hash")), "left")
    return met.filter("stays is null").unionByName(met.filter("stays").dropDuplicates(["id", "hash"])).select("doc.*")
