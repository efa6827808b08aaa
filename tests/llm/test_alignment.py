import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piiscan.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tables():
    return align.token_bytes(align.read_vocabulary(A)), align.piece_bytes(align.read_model(B))


def reference(texts: list[str | None], tables):
    """Plain per-document merge with libraries other than those of the operator, and plain counts."""
    import sentencepiece
    from collections import Counter
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, counts = [], Counter()
    for text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)) if text else ([], [])
        sides = []
        for ids, size in ((a, tables[0]), (b, tables[1])):
            ends, at = {}, 0
            for k, i in enumerate(ids):
                at += len(size[i])
                ends[at] = k
            sides.append((ids, ends, b"".join(size[i] for i in ids)))
        if not text or any(s[2] != (" " + text).encode() for s in sides):
            docs.append(([], [], [], ""))
            continue
        groups, links, x, y = [], [], 0, 0
        for end in sorted(sides[0][1].keys() & sides[1][1].keys()):
            i, j = sides[0][1][end], sides[1][1][end]
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            links.append((a[i], b[j]))
            x, y = i + 1, j + 1
        counts.update(links)
        docs.append((a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(len(a), len(b), len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for a, b, ls, h in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_by_brute_force(spark, tables):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align_tokenizers(docs, A, B).collect()}
    assert got == dict(zip(texts, reference(list(texts.values()), tables)))
    assert sum(1 for x in got.values() if x[0]) > 100


def test_alignment_edges(spark, edge_docs, tables):
    """Null, empty and blank texts, repeated rows, clashing columns, special strings, other scripts and changed texts."""
    more = ["<|endoftext|>x<s></s>", "▁ blocks", "a  b\tc\r\n", "﻿é ﬁ", "\x00", "🙂" * 300, "a" * 5000]
    docs = edge_docs.select("doc_id", "text", "node", "row").unionByName(
        spark.createDataFrame([(100 + i, t, "x", "x") for i, t in enumerate(more)], "doc_id long, text string, node string, row string")
    )
    rows = docs.collect()
    out = align.align_tokenizers(docs, A, B).collect()
    want = reference([r["text"] for r in rows], tables)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in out], key=key) == sorted([(r["doc_id"], *w) for r, w in zip(rows, want)], key=key)


def test_alignment_empty_table_and_pairs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_tokenizers(empty, A, B).collect() == []
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the cat")], "doc_id long, text string")
    content, model = align.read_vocabulary(A), align.read_model(B)
    a, b = align.token_bytes(content), align.piece_bytes(model)
    pairs = align.linkable(a, b)
    table = align.pair_table(spark, align.aligned(docs, content, model, pairs), pairs, len(b))
    the = table.filter((F.col("a") == a.index(b" the")) & (F.col("b") == b.index(b" the"))).collect()
    assert [r["links"] for r in the] == [2]
    assert table.agg(F.sum("links")).collect()[0][0] == 5


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 120)), st.sets(st.integers(0, 120)), st.integers(1, 40))
def test_merge_path_pieces(a, b, work):
    """Pieces of any size find the shared values and their places."""
    x, y = (np.array(sorted(s), np.int64) for s in (a, b))
    i, j = align.merge_path(x, y, work)
    assert x[i].tolist() == y[j].tolist() == sorted(a & b)


def test_diagonals_are_equal_work():
    r = random.Random(3)
    a, b = (np.array(sorted(r.sample(range(1000), n)), np.int64) for n in (300, 40))
    steps = np.arange(0, 341, 17)
    i = align.diagonal(a, b, steps)
    merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
    assert i.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in steps]


def test_linkable_is_bounded_by_the_vocabularies(tables):
    a, b = tables
    pairs = align.linkable(a, b)
    assert len(pairs) <= sum(map(len, a)) + sum(map(len, b))
    for key in pairs[::5000].tolist():
        x, y = a[key // len(b)], b[key % len(b)]
        assert x.endswith(y) or y.endswith(x)


def test_chunks_hold_all_texts():
    texts = ["ab", "", "c" * 9, "d", "e" * 3]
    assert [t for part in align.chunks(texts, 4) for t in part] == texts
    assert list(align.chunks([], 4)) == []
