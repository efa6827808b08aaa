"""Document fingerprints from closed syncmers of words.

A window of five words is kept as an anchor if the smallest hash of its four inner two-word pieces is the first or the
last one. That depends on the window alone, so the same passage gives the same anchors wherever it stands, and
anchors can be matched by position. A fingerprint is the anchors' hashes in text order; likeness is the Jaccard
similarity of the anchor sets.

Built-in functions only. Texts are whole; null counts as empty. A text of one to four words has one anchor, the whole
text; an empty one has none, and is like another empty one (1) and unlike anything else (0). Repeated rows have equal
fingerprints. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_text, words

#: Words in a window and in an inner piece are fixed by the expressions below: 5 and 2.
WINDOW_WORDS = 5
#: Documents per range of ids, and ranges at most.
RANGE_ROWS, RANGES = 25, 10_000


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of (pos, hash) of the anchors of a text column."""
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    df = df.withColumn("_w", hashed)
    df = df.withColumn("_s", F.expr("transform(slice(_w, 1, greatest(size(_w) - 1, 0)), (x, i) -> xxhash64(x, _w[i + 1]))"))
    found = """filter(transform(slice(_s, 1, greatest(size(_s) - 3, 0)), (x, i) -> struct(i AS pos,
        CASE WHEN least(x, _s[i + 3]) <= least(_s[i + 1], _s[i + 2]) THEN xxhash64(x, _s[i + 1], _s[i + 3]) END AS hash)), a -> a.hash IS NOT NULL)"""
    short = f"CASE WHEN size(_w) = 0 THEN cast(array() AS array<struct<pos:int,hash:bigint>>) WHEN size(_w) < {WINDOW_WORDS} THEN array(struct(0 AS pos, xxhash64({text}) AS hash)) ELSE {found} END"
    return df.withColumn(out, F.expr(short)).drop("_w", "_s")


def hashes(anchors: str) -> Column:
    return F.array_distinct(F.transform(anchors, lambda a: a["hash"]))


def as_text(anchors: str) -> Column:
    """The fingerprint as hexadecimal, eight characters per anchor, in text order."""
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.hex(a["hash"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def matches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Anchors two fingerprints share, with both positions: pairs must hold the anchor columns a and b."""
    one = pairs.select("*", F.explode(a).alias("_x"))
    two = one.withColumn("_y", F.explode(F.expr(f"filter({b}, y -> y.hash = _x.hash)")))
    return two.withColumn("pos_a", F.col("_x.pos")).withColumn("pos_b", F.col("_y.pos")).drop("_x", "_y", a, b)


def id_ranges(docs: DataFrame) -> list[int]:
    """Ascending ids that begin ranges of about equally many rows; the first is the smallest id. At most RANGES."""
    spark = docs.sparkSession
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.count()
    if not rows:
        return []
    n = int(min(RANGES, max(8 * shuffle_partitions(spark), rows // RANGE_ROWS)))
    shares = F.array(*[F.lit(i / n) for i in range(n)])
    found, least = docs.select(row_id.alias("id")).agg(F.percentile_approx("id", shares, max(10_000, 4 * n)), F.min("id")).first()
    return sorted({least, *found})


def with_next(docs: DataFrame, bounds: list[int]) -> tuple[DataFrame, Window]:
    """Every document once, with the range it lies in, and the order within ranges.

    The first document of a range also stands, marked as a guest, at the end of the range before it (of the
    first range: at the end of the last), so the next document of any row is the next row of its range, and one
    exchange brings them together.
    """
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    block = F.size(F.filter(coarse, lambda b: b <= F.col("_id"))) - 1
    place = F.size(F.filter(F.slice(every, F.col("_block") * step + 1, step), lambda b: b <= F.col("_id"))) - 1
    ranged = docs.withColumn("_id", row_id).withColumn("_block", block).withColumn("_range", F.col("_block") * step + place)
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest"))
    first = F.element_at(every, F.col("_range") + 1) == F.col("_id")
    rows = ranged.select("*", F.inline(F.when(first, F.array(own, guest)).otherwise(F.array(own)))).drop("_block", "_range")
    order = Window.partitionBy("range").orderBy("guest", "_id", "_tie")
    return rows, order


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (its last half replaced by the next one's beginning), and likeness."""
    text = whole_text()
    frame = docs.select("doc_id", text.alias("text")).withColumn("_tie", F.xxhash64("text"))
    bounds = id_ranges(docs)
    if not bounds:
        bounds = [0]
    rows, order = with_next(frame, bounds)
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(coalesce(next, ''), 1, cast(n_chars div 2 as int)))")
    rows = rows.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(edited)).drop("next")
    rows = with_anchors(with_anchors(rows, "text", "anchors"), "edited", "edited_anchors")
    rows = rows.withColumn("h", hashes("anchors")).withColumn("eh", hashes("edited_anchors")).withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited")
    rows = rows.withColumn("nh", F.lead("h").over(order)).filter("NOT guest")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("h", "eh").alias("near_edited"),
        likeness("h", "nh").alias("near_next"),
        F.size("anchors").cast("long").alias("n_anchors"),
    )
