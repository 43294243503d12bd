"""op1 and op10 against the tokenizers library, piece by piece."""

import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, token_files, tokens


@pytest.fixture(scope="module")
def encode():
    return lambda text: [*library().encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_library(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    flat, n = tokens.encoder(tokens.default_path()).encode_chunk(data, offsets)
    want = [library().encode(r.decode(), add_special_tokens=False).ids for r in raw]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_files_round_trip(spark, corpus, encode, tmp_path):
    rows, df = corpus
    token_files.write(df, str(tmp_path / "t"))
    got = token_files.digests(token_files.read(spark, str(tmp_path / "t"))).toPandas()
    assert Counter(got["ids_crc32"]) == Counter(crc(encode(t)) for _, t in rows)
    known = got.sort_values("start")
    assert known["start"].tolist() == np.concatenate([[0], np.cumsum(known["n_tokens"])[:-1]]).tolist()
    ids = [-1 if np.isnan(x) else x for x in known["doc_id"]]
    assert ids == sorted(ids)
    one = token_files.read(spark, str(tmp_path / "t")).filter("doc_id = 5").collect()
    assert list(one[0]["ids"]) == encode(rows[5][1])


def test_files_of_nothing(spark, empty, tmp_path):
    token_files.write(empty, str(tmp_path / "t"))
    assert token_files.digests(token_files.read(spark, str(tmp_path / "t"))).count() == 0


def test_packing_holds_each_id_once(corpus, encode):
    rows, df = corpus
    pieces = packing.pack(df, size=256, open_windows=4).toPandas()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces.itertuples():
        by_seq[p.sequence_id].append((p.offset, p.length))
        by_doc[(None if np.isnan(p.doc_id) else int(p.doc_id))].append(p)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = Counter()
    for d, t in rows:
        want[d] += len(encode(t))
    assert {d: sum(p.length for p in ps) for d, ps in by_doc.items()} == dict(want)
    assert [i for p in sorted(by_doc[7], key=lambda p: p.start) for i in p.ids] == encode(rows[7][1])
    padding = sum(256 - sum(n for _, n in v) for v in by_seq.values() if bin(sum(n for _, n in v)).count("1") != 1)
    assert padding / pieces["length"].sum() < 0.2


def test_open_sequences_hold_their_own_ids_only():
    """Before, a piece was a slice that kept the ids of its whole chunk, for as long as its sequence was open."""
    packer = packing.Packer(0, 2048, 64, 64)
    for k in range(20):
        packer.add(k, 0, np.ones(1 << 16, np.uint32)[:300], 300)
    assert sum((p[2] if p[2].base is None else p[2].base).nbytes for pieces in packer.held for p in pieces) == 20 * 300 * 4


def test_packing_encodes_in_bounded_memory():
    """The arrays of a chunk: some 70 MB for the 1 MB of text before."""
    enc, text = tokens.encoder(tokens.default_path()), np.frombuffer(b"some words, one number 17. " * (packing.CHUNK // 27), np.uint8)
    tracemalloc.start()
    enc.encode_chunk_with_end(text, np.array([0, len(text)]), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0
