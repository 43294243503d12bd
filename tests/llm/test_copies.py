"""op5, op8, op2 and op4 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fingerprints, ngram_join, sketch, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size=5):
    w = spaced((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    name = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), name[find(i)]) for i in range(len(rows))], groups


def test_components_equal_brute_force(corpus):
    rows, df = corpus
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(df).collect())
    assert got == Counter(brute_components(rows)[0])


def test_crowd_of_near_copies(spark, prose):
    """A chain of copies, each a few words from the one before, and strays just below the threshold."""
    words = prose(120).split()
    rows = []
    for i in range(150):
        if i % 3 == 0:
            words = [*words[:-2], f"e{i}", f"f{i}"] if i % 2 else [f"e{i}", *words[1:]]
        rows.append((i, " ".join(words)))
        rows.append((1000 + i, " ".join([*words[: 80 - i % 40], *prose(30).split()])))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == Counter(brute_components(rows)[0])


def test_one_of_each_stays(corpus):
    rows, df = corpus
    got = ngram_join.first_of_each(df).collect()
    _, groups = brute_components(rows)
    assert len(got) == len(groups)
    kept = {(r.doc_id, r.text) for r in got}
    assert all(any((rows[i][0], rows[i][1]) in kept for i in g) for g in groups.values())
    assert ngram_join.first_of_each(df).columns == df.columns


def test_join_of_nothing(empty):
    assert ngram_join.components(empty).count() == 0
    assert ngram_join.first_of_each(empty).count() == 0


def brute_substring(rows, n=35):
    seen = Counter()
    words = [spaced(t) for _, t in rows]
    for w in words:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = Counter()
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_substring_removal_equals_brute_force(corpus):
    rows, df = corpus
    got = substring_dedup.dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h"))
    assert Counter(tuple(r) for r in got.collect()) == brute_substring(rows)


def test_substring_removal_of_nothing(empty):
    assert substring_dedup.dedup(empty).count() == 0


def test_edited_texts(corpus):
    rows, df = corpus
    got = fingerprints.edited_pairs(df, rows_per_range=16).collect()
    order = sorted(({"id": d, "t": t or ""} for d, t in rows), key=lambda r: (r["id"] is not None, r["id"] or 0))
    want, single = Counter(), Counter(r["id"] for r in order)
    for i, r in enumerate(order):
        following = order[(i + 1) % len(order)]
        q = len(r["t"]) // 4
        if single[r["id"]] == 1 and single[following["id"]] == 1:
            want[(r["id"], hashlib.sha256((r["t"][: len(r["t"]) - q] + following["t"][:q]).encode()).hexdigest())] += 1
    have = Counter((r.doc_id, r.edited_sha256) for r in got)
    assert len(got) == len(rows) and not want - have
    by_text = defaultdict(set)
    for d, t in rows:
        by_text[t or ""].add(d)
    fp = defaultdict(set)
    for r in got:
        fp[r.doc_id].add(r.fingerprint)
    assert len(fp[908]) == 2  # two texts of one id
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    like = [r.near_edited for r in got if r.n_chars > 300]
    assert sum(like) / len(like) > sum(r.near_next for r in got if r.n_chars > 300) / len(like) + 0.2


def test_fingerprints_of_nothing(empty):
    assert fingerprints.edited_pairs(empty).count() == 0


def test_radius_search_misses_none(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_ = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(3)]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in all_]
    df = spark.createDataFrame(signed, "bits long")
    got = {(r.query, r.found): r.distance for r in fingerprints.within(df, df.limit(50), 3, 5).collect()}
    asked = {b for (b,) in [tuple(r) for r in df.limit(50).collect()]}
    want = {(a, b): bin((a ^ b) & (2**64 - 1)).count("1") for a in asked for (b,) in set(signed)}
    assert got == {k: d for k, d in want.items() if d <= 3}


def test_query_looks_up_near_copies_elsewhere(spark, corpus, tmp_path):
    from tidemark.llm import queries

    _, df = corpus
    df = df.unionByName(df.filter("doc_id = 50").withColumn("doc_id", F.lit(7000)))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_fingerprints(spark, str(tmp_path)).collect()
    bits = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert len(got) == df.count()
    for r in got:
        asked = r.doc_id is not None and r.doc_id % 50 == 0
        assert r.n_near == (sum(bin(int(r.fingerprint, 16) ^ b).count("1") <= 3 for _, b in bits) - 1 if asked else None)
    assert {r.doc_id for r in got if r.n_near} >= {50, 7000}


def test_benchmark_passages(spark, prose):
    items = [(1, prose(30)), (2, prose(12)), (3, "three plain words"), (4, None), (5, ""), (6, prose(40))]
    w6 = items[5][1].split()
    near = " ".join([*w6[:20], "changed", *w6[21:]])
    docs = [(10, prose(50) + " " + items[0][1].upper() + ". " + prose(40)), (11, prose(80)), (12, "so " + items[2][1] + " here"), (13, prose(20) + " " + near + " " + prose(9)), (14, " ".join(w6[:18])), (15, None), (16, ""), (10, prose(30)), (None, items[1][1])]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start): r.similarity for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(10, 1, 50), (12, 3, 1), (13, 6, 20), (None, 2, 0)}
    assert got[(10, 1, 50)] == 1 and 0.75 <= got[(13, 6, 20)] < 1
    kept = [r.doc_id for r in decontaminate.clean(d, b).collect()]
    assert sorted(kept) == [11, 14, 15, 16]
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_benchmark_join_without_broadcast(spark, prose, broadcast_rows):
    item = prose(25)
    d = spark.createDataFrame([(i, prose(30) + " " + item) for i in range(5)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert decontaminate.leaks(d, b, broadcast_rows=broadcast_rows).count() == 5


def test_benchmark_items_cut_by_a_document(spark, prose):
    """Items cut at the start or end of a document, and documents shorter than the item."""
    item = prose(50).split()
    docs = [(1, prose(30) + " " + " ".join(item[:48])), (2, " ".join(item[2:]) + " " + prose(30)), (3, " ".join(item[1:])), (4, " ".join(item[:-1])), (5, prose(30) + " " + " ".join(item[:40])), (6, " ".join(item[1:25] + ["new", "words"] + item[25:49]) + " " + prose(20)), (7, " ".join(item[:30]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.start, r.size, r.similarity) for r in decontaminate.leaks(d, b).collect()}
    assert got == {1: (28, 50, 44 / 48), 2: (0, 50, 44 / 48), 3: (0, 49, 45 / 46), 4: (0, 49, 45 / 46), 6: (0, 50, 40 / 52)}


def test_benchmark_variants_equal_brute_force(spark, prose):
    """Items with changed words at the end or within, at similarities around the least one."""
    rng = random.Random(21)
    items = [prose(n).split() for n in (3, 5, 6, 9, 16, 20, 25, 30, 38, 45, 52, 55, 60, 90) for _ in range(3)]
    docs = []
    for w in items:
        for k in range(1, 10):
            inner, places = list(w), range(len(w) - k, len(w)) if k < 7 else [rng.randrange(len(w))]
            for at in places:
                if at >= 0:
                    inner[at] = "internationalised" + str(rng.randrange(99))
            docs.append([*prose(8).split(), *inner, *prose(rng.randrange(0, 9)).split()])

    def bag(w, run):
        return Counter(tuple(w[i : i + run]) for i in range(max(len(w) - run + 1, 1)))

    want = {}
    for d, w in enumerate(docs):
        for i, item in enumerate(items):
            run, b = min(5, len(item)), bag(item, min(5, len(item)))
            if len({*bag(w, run)} & {*b}) * 4 < 3 * len(b):
                continue
            for start in range(max(len(w) - len(item), 0) + 1):
                a = bag(w[start : start + len(item)], run)
                likeness = sum((a & b).values()) / sum((a | b).values())
                if likeness >= 0.75 and likeness > want.get((d, i), (0, 0))[1]:
                    want[(d, i)] = (start, likeness)
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(t)], f"{name} long, text string") for t, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.leaks(*tables).collect()}
    assert got == want and sum(x < 0.85 for _, x in want.values()) > 20


def test_clean_rows_without_id_stay(spark, prose):
    item = prose(20)
    docs = [(None, "a b " + item), (None, prose(30)), (None, None), (3, prose(20))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for _, t in docs[1:])


@pytest.mark.parametrize("size", [4, 15, 30, 45, 60, 200])
def test_blocks_tell_windows_apart_and_lose_none(spark, size):
    """Random windows and items of one length share a block in fewer than 2 of 100 pairs; every variant within the radius of an item is found."""
    rng = random.Random(size)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [text(size) for _ in range(40)]
    windows = [text(size) for _ in range(150)]
    for i, item in enumerate(items):  # variants: some words changed, some taken out at an end, some repeated
        w = list(item)
        for _ in range(rng.randrange(0, 1 + size // 20)):
            w[rng.randrange(size)] = "changed"
        windows.append(w[: size - rng.randrange(0, 1 + size // 8)] if i % 2 else w)
    as_table = lambda rows, key: decontaminate.counted(spark.createDataFrame([(k, size, w) for k, w in enumerate(rows)], f"{key} long, size int, words array<string>"), key)
    prints = {key: decontaminate.fingerprinted(as_table(rows, key), key, 0.75).persist() for key, rows in (("window", windows), ("item", items))}
    met = decontaminate.indexed(prints["window"], "window", True).join(decontaminate.indexed(prints["item"], "item", False), ["size", "block", "v"]).filter("window < 150")
    assert met.count() < 0.02 * 150 * 40
    got = {(r.window, r.item): r.distance for r in decontaminate.near(prints["window"], prints["item"], True).collect()}
    run = min(size, 5)
    runs = lambda w: Counter(tuple(w[i : i + run]) for i in range(max(len(w) - run + 1, 1)))
    for i, w in enumerate(windows):
        for k, item in enumerate(items):
            a, b = runs(w), runs(item)
            if 4 * sum((a & b).values()) >= 3 * sum((a | b).values()):
                differ = sum(a[x] != b[x] for x in {*a, *b})
                assert (i, k) in got and got[i, k] <= differ, (i, k)
    assert len(got) >= 20


def test_a_corpus_larger_than_a_sketch_leaves_few_candidates(spark, prose, monkeypatch):
    """300 unlike texts and 10 near copies, with 2**16 cells at most: before, the cells were full and every text went through the matrix."""
    monkeypatch.setattr(sketch, "bits_for", lambda *a, **k: 16)
    rows = [(i, prose(1000)) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " and more") for i in range(10)] + [(400 + i, rows[i][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, _ = ngram_join.links(df)
    assert {r["doc_id"] for r in found.filter("candidate").collect()} == {*range(10), *range(300, 310), *range(400, 403)}
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(df).collect()}
    assert got == {d: d if d < 300 else d - 300 if d < 400 else d - 400 for d, _ in rows}
