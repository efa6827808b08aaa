"""Encoding, decoding and packing against the tokenizer library and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from piiscan.llm import bpe, packing

FILE = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def fuzz():
    r = random.Random(3)
    letters = "abethinsor ABE 019.,'\n\té中🙂"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(300)] + [
        "".join(chr(r.randint(1, 0x2FFF)) for _ in range(60)) for _ in range(60)
    ] + ["", " ", "a" * 5000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "  \n\n  \t x"]


def test_ids_equal_the_library(library):
    encoder = bpe.Encoder(bpe.read_vocabulary(FILE))
    fast = packing.fast_encoder(bpe.read_vocabulary(FILE))
    for text in fuzz():
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert encoder.decode(got) == library.decode(want, skip_special_tokens=False)
        assert fast.encode(text, allowed_special="all") == want


def test_emptied_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    encoder = bpe.Encoder(bpe.read_vocabulary(FILE))
    for text in fuzz()[:60]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_edges(spark, edge_docs, library):
    rows = bpe.digests(bpe.encode_decode(edge_docs, FILE)).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    want = []
    for doc, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)
    assert bpe.encode_decode(edge_docs.limit(0), FILE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_plan_places_every_tail_once(n):
    r = np.random.default_rng(n)
    histogram = np.bincount(np.minimum(63, r.lognormal(3, 0.7, n).astype(int) + 1), minlength=64)
    plan = packing.make_plan(histogram, 64)
    used = {}
    for length in np.flatnonzero(histogram):
        for number in range(histogram[length]):
            at = 0
            for start, size, sequence, offset in packing.place_tail(plan, int(length), number):
                assert start == at and size > 0
                at += size
                used.setdefault(sequence, []).append((offset, size))
            assert at == length
    for pieces in used.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at == 64 or at & (at - 1) == 0  # full or a power of two: no padding
    assert set(used) == set(range(plan.sequences))


def test_solver_reaches_an_exact_histogram():
    histogram = np.zeros(65)
    histogram[[10, 54, 32, 20]] = [100, 100, 60, 0]
    combos = packing.combinations(np.array([10, 32, 54]), 64)
    x = packing.solve_repeats(combos, histogram)
    assert np.abs(np.bincount(combos.ravel(), np.repeat(x, 3), 65)[1:] - histogram[1:]).max() < 0.5


def test_pack_edges(spark, edge_docs, library):
    rows = packing.pack(edge_docs, FILE).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in {(r["doc_id"], r["text"] or "") for r in edge_docs.collect() if r["doc_id"] not in (1, None)}:
        ids, at = library.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["start"] == 0 for r in by_doc[1]) == 2  # repeated rows are packed each
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(edge_docs.limit(0), FILE).count() == 0
