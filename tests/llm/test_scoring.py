"""Language-model scores: base figures by brute force, probabilities that add up, held-out accuracy, edges."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from piiscan.llm import lm_scoring as lm

from .conftest import prose

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_scores(rows):
    tokens = {}
    for k, (doc, text) in enumerate(rows):
        low = (text or "").encode().translate(lm._LOWER).decode()
        held = zlib.crc32(str(doc if doc is not None else "").encode()) % 7 == 2
        tokens[k] = (doc, held, [*_WORD.findall(low), "\0end"])
    c = Counter(w for _, held, words in tokens.values() if not held for w in words)
    n, v = sum(c.values()), len(c)
    return {k: (doc, held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, (doc, held, w) in tokens.items()}


def test_base_and_edges(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = sorted((str(x[0]), *x[1:5], round(x[5], 6)) for x in base_scores(rows).values())
    got = lm.score_documents(edge_docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"], r["n_tokens"]), set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())  # repeated rows score alike
    assert lm.score_documents(edge_docs.limit(0)).count() == 0


def test_held_out_text_is_predicted(spark):
    rows = [(k, prose(k % 300, 150)) for k in range(300)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20
    assert sum(r["bits_per_byte"] * r["n_bytes"] for r in held) / sum(r["n_bytes"] for r in held) < 1.8  # 8 without a model


def test_next_byte_probabilities_add_up():
    """After any beginning, the decisions of all 256 bytes are the leaves of one tree: their probabilities sum to 1."""
    r = np.random.default_rng(2)
    trees = lm.Trees(r.integers(0, 50, (256, 256)).astype(float), (15,) * lm.PREDICTORS)
    tables = [(r.normal(0, 2, 1 << 15).astype(np.float16), r.integers(0, 30, 1 << 15).astype(np.float16)) for _ in range(lm.PREDICTORS)]
    w = [m.w + r.normal(0, 0.1, m.w.shape) for m in (lm.Mixer(g) for g in lm.GATES)]
    total = np.zeros(3)
    letters = [bytes([b]).decode("latin-1") for b in range(128)]
    keys = pa.array([f"ath{c}C" for c in letters])
    d = lm.Decisions(trees, keys)
    x, gates = d.inputs(tables)
    place = np.zeros(len(d.bit), int)
    # decisions of the last scored byte of each key
    for m in range(3):
        z = (d.bit * 2.0 - 1) * (x * w[m][gates[m]]).sum(1)
        p = 1 / (1 + np.exp(-z))
        for k in range(128):
            mine = np.flatnonzero(d.unit == k)
            start = [i for i in mine if d.depth[i] == 0][-1]
            total[m] += np.prod(p[start : mine[-1] + 1])
    assert place.sum() == 0 and (total < 1).all() and (total > 0.3).all()
    size = trees.size[ord("h")].astype(float)
    assert abs((0.5**size).sum() - 1) < 1e-9  # the tree's leaves are complete


def test_state_never_looks_ahead():
    classes = np.random.default_rng(1).normal(0, 1, (lm.PAIRS, lm.CLASSES)).astype(np.float32)
    a, b = lm.text_units("one two three four five", classes), lm.text_units("one two three vier funf", classes)
    assert a[:3] == b[:3] and a[3][0] == b[3][0]
    assert lm.text_units("", classes) == lm.text_units(" \n", classes) == [lm._STATES[-1] + "E"]


@pytest.mark.parametrize("n", [1, 3])
def test_document_blobs(n):
    docs = [(None if k else 5, k, np.array([0, 3, 9][: k + 1], np.int32), np.arange(1, k + 2)) for k in range(n)]
    ids, known, folds, sizes, deltas, counts = lm.unpack_documents(lm.pack_documents(docs))
    assert known.tolist() == [1] + [0] * (n - 1) and folds.tolist() == list(range(n)) and sizes.tolist() == [k + 1 for k in range(n)]
    assert counts.sum() == sum(d[3].sum() for d in docs)


def test_all_training_documents_are_learned(spark):
    """Words that only documents of the mixing fold hold are known to the counters that score."""
    folds = {k: zlib.crc32(str(k).encode()) % lm.FOLDS for k in range(400)}
    mixing, held = [k for k, f in folds.items() if f == lm.MIX_FOLD], [k for k, f in folds.items() if f == lm.HELD_OUT]
    seen, unseen = "vozzuquiphax jyxtopwabun", "wubbojixaqav myqtixfohep"
    rows = [(k, prose(k, 60) + (f" {seen}" * 20 if k in mixing else "")) for k, f in folds.items() if f != lm.HELD_OUT]
    rows += [(held[0], seen), (held[1], unseen)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] < 0.5 * got[held[1]]


def test_classes_are_fitted_on_all_training_documents(spark):
    """With a small sample to begin with, each class is the sum of all training documents in it."""
    texts = {k: prose(k, 40) if k % 2 else "".join(chr(0x4E00 + (7 * k + 13 * i) % 300) for i in range(90)) for k in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    training = docs.filter(lm.fold(docs["doc_id"]) != lm.HELD_OUT)
    logs = lm.fit_classes(docs, 20, 0).T
    sums, n = lm.class_sums(training, logs, np.ones(lm.CLASSES))
    want, member = np.zeros_like(sums), Counter()
    for r in training.collect():
        x = lm.pair_counts(r["text"])
        k = int(np.argmax(logs @ x))
        want[k] += x
        member[k] += 1
    assert np.array_equal(sums, want) and n.tolist() == [member[k] for k in range(lm.CLASSES)] and n.sum() == training.count()
    assert not np.allclose(lm.fit_classes(docs, 20, 0), lm.fit_classes(docs, 20))


def test_counters_have_no_bound():
    """Tables grow with the units however many there are, beyond what one 32-bit hash tells apart, and every context keeps a slot of its own."""
    assert lm.table_bits(1 << 24)[0] >= 28 and min(lm.table_bits(1 << 31)) >= 36
    r = np.random.default_rng(3)
    trees = lm.Trees(r.integers(0, 50, (256, 256)).astype(float), lm.table_bits(1 << 35))
    words = sorted({"".join(map(chr, r.integers(97, 123, 9))) for _ in range(8_000)})
    d = lm.Decisions(trees, pa.array([f"a{w} C" for w in words]))
    same = {}
    for k in range(lm.PREDICTORS):
        assert 0 <= d.slots[k].min() and d.slots[k].max().item().bit_length() <= trees.bits[k]
    # the unit so far (with one state for all) and the decision's node stand for one slot
    place = np.cumsum(d.depth == 0) - 1
    at, starts = place - place[np.searchsorted(d.unit, d.unit)], [f"{w} " for w in words]
    for u, i, node, slot in zip(d.unit.tolist(), at.tolist(), d.node.tolist(), d.slots[4].tolist()):
        same.setdefault((starts[u][:i], node), set()).add(slot)
    assert all(len(s) == 1 for s in same.values()) and len(set().union(*same.values())) == len(same) > 200_000


def test_counters_of_all_parts_are_added_up(spark):
    """Parts of the vocabulary get the sums of all parts for just the slots they ask for, whatever shard holds them."""
    r = np.random.default_rng(4)
    trees = lm.Trees(r.integers(0, 50, (256, 256)).astype(float), (22,) * lm.PREDICTORS)
    rows = [(k % 3, f"{'ab'[k % 2]}{''.join(map(chr, r.integers(97, 101, 5)))} C", float(k % 4), k % 5 == 0) for k in range(900)]
    units = spark.createDataFrame(rows, "part long, key string, weight double, asks boolean").dropDuplicates(["part", "key"])
    rows = [tuple(x) for x in units.collect()]
    want = [(np.zeros(1 << 22), np.zeros(1 << 22)) for _ in range(lm.PREDICTORS)]
    for _, key, weight, _ in rows:
        d = lm.Decisions(trees, pa.array([key]))
        for k in range(lm.PREDICTORS):
            for bit in (0, 1):
                np.add.at(want[k][bit], d.slots[k][d.bit == bit], weight)
    answers = lm.counters(units, spark.sparkContext.broadcast(trees))
    asked = units.filter("asks").withColumn("n", F.lit(1).cast("long"))
    by_part = {part: table for part, table in lm.runs(lm.with_counters(asked, answers, "n").coalesce(1).toArrow().to_batches(), "part")}
    assert sorted(by_part) == [0, 1, 2]
    for part, table in by_part.items():
        got, found, tables = lm.answered(trees, table)
        keys = got.column("key").to_pylist()
        assert sorted(keys) == sorted(key for p, key, _, asks in rows if asks and p == part)
        d = lm.Decisions(trees, pa.array(keys))
        assert len(set((np.concatenate(d.slots) // lm.SHARD).tolist())) == 4
        for k in range(lm.PREDICTORS):
            n0, n1 = (want[k][bit][d.slots[k]] for bit in (0, 1))
            mine = found[0][1].slots[k]
            assert np.array_equal(tables[k][1][mine], (n0 + n1).astype(np.float16))
            assert np.array_equal(tables[k][0][mine], np.log((n1 + lm.PRIOR) / (n0 + lm.PRIOR)).astype(np.float16))


def test_a_part_takes_few_bytes_per_decision(spark):
    """Memory of a task follows the decisions of one part: their slots are held once, in as few bytes as they need."""
    r = np.random.default_rng(5)
    trees = lm.Trees(r.integers(0, 50, (256, 256)).astype(float), (26,) * lm.PREDICTORS)
    keys = sorted({f"a{''.join(map(chr, r.integers(97, 123, 6)))} C" for _ in range(20_000)})
    units = spark.createDataFrame([(0, key, 1.0, True) for key in keys], "part long, key string, weight double, asks boolean")
    answers = lm.counters(units, spark.sparkContext.broadcast(trees))
    rows = lm.with_counters(units.withColumn("n", F.lit(1).cast("long")), answers, "n").coalesce(1).toArrow().combine_chunks()
    tracemalloc.start()
    _, found, _ = lm.answered(trees, rows)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    decisions = sum(len(d.bit) for _, d in found)
    assert decisions > 500_000 and held < 70 * decisions and most < 110 * decisions


def test_words_are_predicted_from_the_words_before(spark):
    """A held-out text of known neighbours scores better than the same words in another order."""
    folds = {k: zlib.crc32(str(k).encode()) % lm.FOLDS for k in range(300)}
    held = [k for k, f in folds.items() if f == lm.HELD_OUT]
    words = prose(5, 40, 40).split()
    known, shuffled = " ".join(words), " ".join(sorted(words))
    rows = [(k, f"{prose(k, 60)} {known if k % 10 == 0 else ''}") for k, f in folds.items() if f != lm.HELD_OUT]
    rows += [(held[0], known), (held[1], shuffled)]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["bits_per_byte"] < 0.5 * got[held[1]]["bits_per_byte"]


def test_white_space_is_coded_as_it_stands(spark):
    classes = np.zeros((lm.PAIRS, lm.CLASSES), np.float32)
    text = "\tOne  two\n\nthree\r\n four "
    assert "".join(lm.text_pieces(lm.lowered(text))) == text.lower()
    assert [u[1:-1] for u in lm.text_units(text, classes)] == ["\tone  ", "two\n\n", "three\r\n ", "four ", ""]
    plain, wide = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % lm.FOLDS == lm.HELD_OUT][:2]
    rows = [(k, prose(k, 60)) for k in range(200)] + [(plain, "amber birch cedar"), (wide, "amber\t\t birch\x0b\ncedar")]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[plain]["n_tokens"] == got[wide]["n_tokens"] == 4 and got[plain]["base_score"] == pytest.approx(got[wide]["base_score"])
    assert got[wide]["n_bytes"] == got[plain]["n_bytes"] + 3 and got[wide]["score"] < got[plain]["score"] - 2


def test_open_white_space_has_bytes_of_its_own():
    data, offsets, ended = lm.unit_bytes(pa.array(["a \tone  C", "bE", "btwo\nC"]))
    assert data.tobytes() == b"a\xfd\xf8one\xfd Cb\xffbtwo\nC" and offsets.tolist() == [0, 9, 11, 17] and ended.tolist() == [False, True, False]


def test_neighbours_are_counted_over_all_blocks(spark, monkeypatch):
    """Counts of pairs and triples in training texts reach every block, by the words before whatever their white space."""
    texts = [prose(k % 40, 30, 5 + k % 3) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    classes = spark.sparkContext.broadcast(np.zeros((lm.PAIRS, lm.CLASSES), np.float32))
    blocks = lm.list_blocks(docs, classes).cache()
    answers = {}
    for r in lm.answer_grams(lm.ask_grams(blocks, 3)).orderBy("block", "shard").collect():
        answers.setdefault(r["block"], []).append(np.frombuffer(zlib.decompress(r["blob"]), "<u4"))
    assert len(answers) == 4 and all(len(a) == 8 for a in answers.values())
    pairs, triples = Counter(), Counter()
    keys = {}
    for k, t in enumerate(texts):
        pieces = [*lm.text_pieces(t), ""]
        two = list(zip([None, *(p.strip() for p in pieces)], pieces))
        keys[k] = (two, list(zip([None, *two], pieces)))
        if zlib.crc32(str(k).encode()) % lm.FOLDS != lm.HELD_OUT:
            pairs.update(keys[k][0])
            triples.update(keys[k][1])
    found = []
    for r in blocks.filter("kind = 1").collect():
        (ids, _, _, sizes, _, _), _, order, begin = lm.block_grams(r["docs"])
        seen = np.empty(len(order), int)
        seen[order] = np.repeat(np.concatenate(answers[r["block"]]), np.diff(begin, append=len(order)))
        for doc, of_pairs, of_triples in zip(ids.tolist(), *(np.split(x, np.cumsum(sizes)[:-1]) for x in seen.reshape(2, -1))):
            assert of_pairs.tolist() == [pairs[x] for x in keys[doc][0]] and of_triples.tolist() == [triples[x] for x in keys[doc][1]]
            found.append(doc)
    assert sorted(found) == list(range(120))


def test_predictions_of_all_units_add_up_to_one():
    """Behind any two units, what was seen there and what was not share all probability of the spelling."""
    r = np.random.default_rng(6)
    spelled = r.dirichlet(np.ones(50))
    seen = np.stack([r.integers(0, 3, 50), np.zeros(50, int)]).astype(float)
    seen[1] = np.minimum(seen[0], r.integers(0, 2, 50))
    words, pairs = np.full(50, seen[0].sum()), np.full(50, seen[1].sum())
    for q in lm.predictions(np.log10(spelled), seen, words, pairs):
        assert abs((10**q).sum() - 1) < 1e-9
    far = next(iter(lm.predictions(np.array([-5000.0]), np.zeros((2, 1)), np.array([3.0]), np.array([0.0]))))
    assert far[0] == pytest.approx(-5000 + math.log10(1 / 4))


def test_gram_blobs():
    grams = np.array([0, 5, 1 << 40, (1 << 56) - 1])
    got, counts = lm.unpack_grams(lm.pack_grams(grams, np.array([1, 0, 70_000, 3])))
    assert got.tolist() == grams.tolist() and counts.tolist() == [1, 0, 70_000, 3]
