"""Near-duplicate documents and lines against brute force."""

import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiscan.llm import common, components, line_dedup, minhash

from .conftest import prose


def classes_by_brute_force(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        n = min(5, len(w))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def edited(text: str, seed: int, edits: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_docs(spark):
    """Copies, near copies at many distances (also chains), and unrelated texts."""
    rows, k = [], 0
    for group in range(6):
        base = prose(100 + group, 120)
        for copy in range(25):
            rows.append((k, base if copy % 5 == 0 else edited(base, k, copy % 9)))
            k += 1
    for group in range(40):
        rows.append((k, prose(500 + group, 60)))
        k += 1
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows


def test_classes_equal_brute_force(near_docs):
    frame, rows = near_docs
    want = classes_by_brute_force(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(frame).collect()}
    assert got == want
    kept = {r["doc_id"] for r in minhash.deduplicate(frame).collect()}
    assert kept == set(want.values())


def test_repeated_passages(spark):
    """Equal shingle sets, half of which occur a hundred times in one of the texts."""
    rows = []
    for k in range(60):
        once, often = prose(2000 + k, 100), prose(3000 + k, 100)
        more = " ".join(often.split()[:4])
        rows += [(2 * k, "\n".join([once, often, more])), (2 * k + 1, "\n".join([once] + [often] * 100 + [more]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes_by_brute_force(rows[:4]) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect()} == {d: d - d % 2 for d, _ in rows}


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    elements = r.integers(0, 1 << 63, 600).astype(np.uint64)
    x, y = np.zeros(600), np.zeros(600)
    x[:450], y[150:] = r.uniform(0.5, 3, 450), r.uniform(0.5, 3, 450)
    both = (x > 0) & (y > 0)
    truth = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    a = minhash.signature(elements[x > 0], x[x > 0], 4096)
    b = minhash.signature(elements[y > 0], y[y > 0], 4096)
    assert abs((a == b).mean() - truth) < 4 * (truth * (1 - truth) / 4096) ** 0.5


def test_one_element_fills_a_signature():
    one = np.array([7], np.uint64)
    assert (minhash.signature(one, np.ones(1), 144) == 7).all()


def test_near_edges(spark, edge_docs):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["class_id"] is not None, r["class_id"] or 0) for r in minhash.near_classes(edge_docs).collect()))
    assert len(rows) == edge_docs.count()
    assert (True, 6, True, 5) in rows and rows.count((True, 1, True, 1)) == 2
    kept = minhash.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 6 not in ids and {2, 3, 4, 5, 7, 8, 9} <= set(ids)
    assert minhash.near_classes(edge_docs.limit(0)).count() == 0 and minhash.deduplicate(edge_docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[201] == 200 and got[300] == 300


def python_simhash(words, spark):
    longer = [w for w in words if len(w) >= line_dedup.FEATURE_CHARS]
    if len(longer) < line_dedup.MIN_FEATURES:
        return None
    known = {r["w"]: r["h"] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in set(longer)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    return sum(1 << b for b in range(64) if 2 * sum(known[w] >> b & 1 for w in longer) > len(longer))


def test_simhash(spark):
    lines = [["a"] * 6, ["long", "words", "a", "b", "c"], prose(3, 40).split(), prose(4, 300).split(), ["same", "words", "here"] * 30_000]
    docs = line_dedup.row_key(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string"))
    got = {r["doc"]["doc_id"]: r["simhash"] for r in line_dedup.line_rows(docs).collect()}
    for k, words in enumerate(lines):
        want = python_simhash(words, spark)
        assert (got[k] if got[k] is None else got[k] & (1 << 64) - 1) == want


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_blocks_find_every_small_distance(spark, blocks):
    r = random.Random(blocks)
    rows = []
    for k in range(60):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 3):
            b ^= 1 << bit
        rows.append((k, *(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b))))
    frame = spark.createDataFrame(rows, "k long, a long, b long")
    shared = frame.select(F.arrays_overlap(line_dedup.bucket_keys("a", blocks), line_dedup.bucket_keys("b", blocks)).alias("hit"))
    assert shared.filter("NOT hit").count() == 0


def test_lines(spark):
    one, two = "The quick brown fox, number 17, jumps over the lazy dog of the house", "A wholly different line about rivers, hills and the open sea today"
    near = one.replace("lazy", "lazi")
    rows = [
        (1, f"{one}\nshort line\n{two}"),
        (2, f"short line\nthe QUICK brown fox number 23 jumps over the lazy dog of the house\nnew text of its own that no other document has at all"),
        (3, f"{near}\n{two}\n{two}"),
        (4, None),
        (5, ""),
        (6, two),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.kept_lines(docs).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("short line\nnew text of its own that no other document has at all", 1)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("", 1)
    # an edited line falls only if its SimHash is near enough; the exact copies always do
    assert got[3][1] in (2, 3)
    assert {r["doc_id"] for r in line_dedup.deduplicate_lines(docs).collect()} >= {1, 2, 4, 5} and 6 not in {r["doc_id"] for r in line_dedup.deduplicate_lines(docs).collect()}


def test_fuzzy_lines_by_brute_force(spark):
    """Groups are the components of pairs with SimHash distance up to 3 and edit similarity of 0.9."""
    base = [" ".join(prose(900 + k, 60).split()) for k in range(12)]
    lines = []
    for k, b in enumerate(base):
        lines += [b, b[:-1] + "q", b.replace("amber", "amberr"), edited(b, k, 1), edited(b, k + 50, 9)]
    lines = list(dict.fromkeys(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = {r["doc"]["doc_id"]: r["simhash"] for r in line_dedup.line_rows(line_dedup.row_key(docs)).collect()}
    hashes = [rows[k] & (1 << 64) - 1 for k in range(len(lines))]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    plain = [r[0] for r in docs.orderBy("doc_id").select(line_dedup.normalised(F.col("text"))).collect()]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        if plain[a] == plain[b] or bin(hashes[a] ^ hashes[b]).count("1") <= 3 and distance(plain[a], plain[b]) <= 0.1 * max(len(plain[a]), len(plain[b])):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.kept_lines(docs).collect()}
    assert got == {k: int(find(k) != k) for k in range(len(lines))}
    assert sum(got.values()) > 5


def test_line_edges(spark, edge_docs):
    out = line_dedup.deduplicate_lines(edge_docs)
    assert out.columns == edge_docs.columns
    rows = {(r["doc_id"], r["source"]): r for r in out.collect()}
    assert rows[5, "b"]["text"] and (6, "b") not in rows and rows[2, "a"]["text"] is None and rows[3, "a"]["text"] == ""
    assert rows[9, "c"]["n_chars"] == len(rows[9, "c"]["text"])
    assert line_dedup.kept_lines(edge_docs.limit(0)).count() == 0


def line_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def varied_line(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 10))) for _ in range(n))


def test_lines_with_one_word_replaced(spark):
    """Edit similarity alone decides: of lines of 8 to 60 words with a word replaced, those within the limit fall."""
    r, pairs = random.Random(5), []
    for k in range(160):
        line = varied_line(r, (8, 12, 20, 60)[k % 4])
        w = line.split()
        w[r.randrange(len(w))] = varied_line(r, 1)
        pairs.append((line, " ".join(w)))
    docs = spark.createDataFrame([(2 * k + i, x) for k, pair in enumerate(pairs) for i, x in enumerate(pair)], "doc_id long, text string")
    got = {q["doc_id"]: q["n_dropped"] for q in line_dedup.kept_lines(docs).collect()}
    near = [10 * line_distance(a, b) <= max(len(a), len(b)) for a, b in pairs]
    found = [got[2 * k + 1] for k in range(len(pairs))]
    assert sum(near) > 120 and not any(f and not n for f, n in zip(found, near)) and not any(got[2 * k] for k in range(len(pairs)))
    assert sum(found) >= 0.98 * sum(near)


def test_lines_with_scattered_typos(spark):
    """One character in twenty changed, anywhere; also lines of few words, and of a script without spaces."""
    r, pairs = random.Random(6), []
    for k in range(160):
        line = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(60)) if k % 4 == 0 else varied_line(r, (5, 5, 25, 50)[k % 4])
        x = list(line)
        for i in r.sample([i for i, c in enumerate(x) if c != " "], len(x) // 20):
            x[i] = "q" if x[i] != "q" else "z"
        pairs.append((line, "".join(x)))
    docs = spark.createDataFrame([(2 * k + i, x) for k, pair in enumerate(pairs) for i, x in enumerate(pair)], "doc_id long, text string")
    got = {q["doc_id"]: q["n_dropped"] for q in line_dedup.kept_lines(docs).collect()}
    assert sum(got[2 * k + 1] for k in range(160)) >= 0.95 * 160 and not any(got[2 * k] for k in range(160))


def test_lines_by_edit_similarity_alone(spark):
    """The lines of test_fuzzy_lines_by_brute_force; groups are the components of pairs with edit similarity of 0.9."""
    base = [" ".join(prose(900 + k, 60).split()) for k in range(12)]
    lines = [x for k, b in enumerate(base) for x in (b, b[:-1] + "q", b.replace("amber", "amberr"), edited(b, k, 1), edited(b, k + 50, 9))]
    docs = spark.createDataFrame(list(enumerate(dict.fromkeys(lines))), "doc_id long, text string")
    plain = docs.select("doc_id", line_dedup.normalised(F.col("text")).alias("plain"))
    two = plain.select(F.col("doc_id").alias("other"), F.col("plain").alias("q"))
    near = F.expr("10 * levenshtein(plain, q) <= greatest(length(plain), length(q))")
    links = plain.crossJoin(two).filter(F.col("doc_id") < F.col("other")).filter(near).select("doc_id", "other").collect()
    up = list(range(docs.count()))
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.kept_lines(docs).collect()}
    assert got == {k: int(x != k) for k, x in enumerate(up)}


def test_lines_without_ascii_words(spark):
    """Passages of one to four words by ASCII rules are matched too; only short ones are protected."""
    chinese = "这是一个很长的句子它在许多文件中逐字出现因此应该只保留一次"
    thai = "ประโยคยาวนี้ปรากฏในเอกสารหลายฉบับจึงควรเก็บไว้เพียงครั้งเดียว"
    german = "Rindfleischetikettierungsüberwachungsaufgaben übertragungsgesetzgebung"
    rows = [(k, "\n".join((chinese, thai, german, "short line", "短句"))) for k in range(3)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == got[2] == ("short line\n短句", 3)


def test_staged_tables_leave_no_shuffle_files(spark):
    """What a staged table was shuffled with goes when it is written, and the table when it is no longer needed."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {str(p) for folder in manager.localDirsString() for p in Path(folder).glob("*/shuffle_*")}
    before = held()
    table = common.stage(spark.range(50_000).select(F.xxhash64("id").alias("k")).groupBy("k").count(), "staged")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and table.count() == 50_000
    folder = Path(table.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.is_dir()
    common.unstage(table)
    assert not folder.exists()


def test_many_pairs_are_verified_in_slices(spark, monkeypatch):
    """Every pair is in one slice, and each slice's links are a table of their own."""
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40)], "a long, b long")
    seen = []

    def verify(some):
        seen.append(some.count())
        return some.filter("(a + b) % 3 = 0")

    monkeypatch.setattr(components, "MANY_PAIRS", 100)
    got = sorted(map(tuple, components.verified(pairs, verify).collect()))
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 3 == 0]
    assert len(seen) == components.SLICES and sum(seen) == 780 and max(seen) < 500


def test_keys_that_no_two_lines_share_are_not_written(spark, monkeypatch):
    """A line has dozens of keys; staged tables hold rows of lines and of shared buckets only."""
    r = random.Random(8)
    lines = [varied_line(r, (5, 10, 20, 40)[k % 4]) for k in range(200)]
    lines += [x + " again" for x in lines[2:20:4]]
    docs = line_dedup.row_key(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    written = {}

    def stage(df, what):
        out = common.stage(df, what)
        written[what] = max(written.get(what, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "stage", stage)
    assert {q["doc"]["doc_id"] for q in line_dedup.dropped_lines(docs).collect()} == set(range(200, 205))
    assert written["lines"] == written["line-nodes"] == 205 and max(written.values()) < 4 * 205


def test_gram_bits_rule_out_unrelated_lines_only(spark):
    """No pair within the limit of edits is ruled out, however the edits are spread; nearly all unrelated ones are."""
    r, pairs = random.Random(9), []
    for k in range(300):
        line = varied_line(r, (5, 8, 11)[k % 3]) if k % 4 else "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(60))
        x = list(line)
        for _ in range(len(line) // 10 - 1):
            i = r.randrange(len(x))
            x[i : i + r.randrange(2)] = r.choice(["", "q", " "])
        pairs.append((line, "".join(x), varied_line(r, len(line.split()) + 1)[: len(line)]))
    frame = spark.createDataFrame(pairs, "a string, near string, far string")
    bits = frame.select("*", *[line_dedup.gram_bits(F.col(c)).alias(f"{c}_bits") for c in ("a", "near", "far")])
    test = lambda c: line_dedup.shares_grams(F.length("a"), F.col("a_bits"), F.length(c), F.col(f"{c}_bits"))
    got = bits.select("a", "near", test("near").alias("kept"), test("far").alias("unrelated")).collect()
    near = [10 * line_distance(q["a"], q["near"]) <= max(len(q["a"]), len(q["near"])) for q in got]
    assert sum(near) > 200 and all(q["kept"] for q, n in zip(got, near) if n)
    assert sum(q["unrelated"] for q in got) < 15


def test_pairs_of_many_members_are_made_in_slices(spark, monkeypatch):
    """A bucket is whole in one slice, so the slices' pairs are those of the whole table."""
    members = spark.createDataFrame([(bucket, node) for bucket in range(60) for node in range(bucket, bucket + 4)], "bucket long, node long")
    seen = []

    def pairs_of(some):
        seen.append(some.count())
        other = some.withColumnRenamed("node", "b")
        return some.join(other, "bucket").filter("node < b").select(F.col("node").alias("a"), "b").distinct()

    monkeypatch.setattr(line_dedup, "MANY_MEMBERS", 100)
    got = {tuple(x) for x in line_dedup.in_slices(members, pairs_of).collect()}
    assert got == {(a, b) for a in range(63) for b in range(a + 1, min(a + 4, 63))}
    assert len(seen) == components.SLICES and sum(seen) == 240 and max(seen) < 120


def test_unrelated_pairs_go_before_texts_are_moved(spark, monkeypatch):
    """Pairs that n-grams rule out reach no edit test, and only texts of pairs left are joined; links are those of the edit test alone."""
    r = random.Random(10)
    lines = [varied_line(r, 8) for _ in range(30)] + [varied_line(r, 30) for _ in range(10)]
    lines += [x[:-1] + "q" for x in lines]
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, plain string").withColumn("size", F.length("plain"))
    signs = nodes.filter("node % 40 < 30").select("node", "size", line_dedup.gram_bits(F.col("plain")).alias("bits"))
    all_pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    left = line_dedup.told_apart(all_pairs, signs)
    kept = {tuple(x) for x in left.collect()}
    assert {(k, k + 40) for k in range(20)} <= kept
    with_bits = [k for k in range(60) if k % 40 < 30]
    assert sum(a in with_bits and b in with_bits for a, b in kept) < 60
    assert all((a, b) in kept for a in range(60) for b in range(a + 1, 60) if a not in with_bits or b not in with_bits)
    written = {}

    def stage(df, what):
        written[what] = common.stage(df, what)
        return written[what]

    monkeypatch.setattr(line_dedup, "stage", stage)
    few = left.filter("a < 20 AND b = a + 40")
    assert sorted(map(tuple, line_dedup.verify(few, nodes.select("node", "plain")).collect())) == [(k, k + 40) for k in range(20)]
    assert {x["node"] for x in written["line-ids"].collect()} == {*range(20), *range(40, 60)}


def test_mixed_buckets_in_slices(spark, monkeypatch):
    """A bucket is whole in one slice, so mixed buckets and their commonest label are those of the whole table."""
    members = spark.createDataFrame([(b, n, b) for b in range(50) for n in range(b, b + 5)], "bucket long, node long, centre long")
    labels = spark.createDataFrame([(n, n // 4) for n in range(0, 54, 1) if n % 9], "node long, label long")
    one = sorted(map(tuple, components.mixed_buckets(members, labels).select("bucket", "node", "label", "common").collect()))
    seen = []
    monkeypatch.setattr(components, "stage", lambda df, what: seen.append(common.stage(df, what)) or seen[-1])
    monkeypatch.setattr(components, "MANY_MEMBERS", 100)
    assert sorted(map(tuple, components.mixed_buckets(members, labels).select("bucket", "node", "label", "common").collect())) == one
    assert len(seen) == components.SLICES and len(one) > 100 and max(x.count() for x in seen) < 0.6 * len(one)
