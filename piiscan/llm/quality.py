r"""Quality rules whose cutoffs limit false rejections with a guarantee.

Features of whole texts are counted with built-in functions. Each rule looks at one ratio, as an integer
(`RULES`). Labelled documents that pass the fixed base rule are the holdout: per stratum (language) and rule, the
good ones at or above a cutoff are its false rejections. A cutoff may be used if the exact binomial bound says,
at the corrected level, that its false-rejection rate is at most the rule's share of ``risk``; cutoffs are tested from
the mildest on until one fails (fixed sequence, no further correction), and the level is divided by strata x rules
(Bonferroni). So with probability ``1 - level`` no stratum loses more than ``risk`` of its good documents. Of the
cutoffs allowed, the one that rejects most labelled bad documents, less ``COST`` times the good ones, is taken, and
the middle of its ties; a rule that gains nothing is not used. A stratum with too few labels has no cutoff and
loses nothing but base failures.

Null text: no words, fails the base rule. A null language is a stratum of its own. Labels are one per document;
contradicting or null ones are ignored. Only the named columns are read; other columns are carried by
``filter_documents`` alone. Empty tables give empty results, and without labels only the base rule decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .common import carried, restored, stage, whole_text, words

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words in repeated three-word windows
_SPACES = " \t\n\x0b\x0c\r"

#: Integer ratios, larger is worse; null where there is nothing to divide by.
RULES = {
    "symbols": "1000 * n_symbols div word_chars",
    "repeated_lines": "1000 * n_dup_lines div n_lines",
    "repeated_words": "1000 * n_repeat_words div n_words",
    "long_words": "20 * word_chars div n_words",
    "capitals": "1000 * n_capitals div word_chars",
}
#: What each rule may take of the risk; together 1.
SHARES = {"symbols": 0.4, "repeated_lines": 0.15, "repeated_words": 0.15, "long_words": 0.15, "capitals": 0.15}
RISK, LEVEL = 0.10, 0.05
COST = 10


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, stratum and the counts of whole texts, in one narrow stage; no explode, so nothing is shuffled."""
    text = whole_text()
    h = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        *keep,
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0).alias("lines"),
    )
    # the hash of each three-word window; a window that occurs again is found by sorting (hash, place)
    windows = F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))")
    h = h.withColumn("n_words", F.size("w").cast("long")).withColumn("t", windows)
    h = h.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    sorted_windows = F.expr("CASE WHEN size(array_distinct(t)) < size(t) THEN array_sort(transform(t, (x, i) -> struct(x AS h, i AS i))) END")
    h = h.drop("w", "lines").withColumn("s", sorted_windows).drop("t")
    repeated = "filter(s, (e, k) -> e.h = s[greatest(k - 1, 0)].h AND k > 0 OR e.h = s[least(k + 1, size(s) - 1)].h AND k < size(s) - 1)"
    covered = F.expr(f"coalesce(size(array_distinct(flatten(transform({repeated}, e -> array(e.i, e.i + 1, e.i + 2))))), 0)")
    # size of null is -1 under the legacy setting, so documents without repetition are told apart first
    h = h.withColumn("n_repeat_words", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long")).drop("s")
    return h.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def rule_value(name: str) -> Column:
    """A rule's ratio; null where there is nothing to divide by, also where dividing by 0 is an error (ANSI mode)."""
    above, below = RULES[name].split(" div ")
    return F.expr(f"cast({above} div nullif({below}, 0) as bigint)")


def rule_values() -> Column:
    return F.array(*[F.struct(F.lit(name).alias("rule"), rule_value(name).alias("value")) for name in RULES])


def allowed(n: str, rate: float, log_level: float) -> str:
    """The most false rejections among n for which P(Binomial(n, rate) <= them) is within the level, -1 if none.

    Terms are summed as logarithms, so no n underflows.
    """
    odds = math.log(rate) - math.log1p(-rate)
    return f"""aggregate(sequence(0L, cast(floor({n} * {rate!r}) as bigint)),
        named_struct('term', {n} * {math.log1p(-rate)!r}D, 'total', cast('-Infinity' as double), 'most', -1L),
        (a, j) -> named_struct(
          'term', a.term + ln(({n} - j) / (j + 1D)) + {odds!r}D,
          'total', CASE WHEN a.total < a.term THEN a.term + log1p(exp(a.total - a.term)) ELSE a.total + log1p(exp(a.term - a.total)) END,
          'most', CASE WHEN (CASE WHEN a.total < a.term THEN a.term + log1p(exp(a.total - a.term)) ELSE a.total + log1p(exp(a.term - a.total)) END) <= {log_level!r}D THEN j ELSE a.most END),
        a -> a.most)"""


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff): documents at or above it are rejected. One row per stratum and rule that has one."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi").select("doc_id", F.col("lo").alias("quality"))
    held = measured.filter("NOT base_failed").join(marks, "doc_id").select("stratum", (F.col("quality") > 0).alias("good"), F.inline(rule_values()))
    hist = held.filter("value IS NOT NULL").groupBy("stratum", "rule", "value").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    hist = stage(hist, "quality-histogram")
    strata = max(1, hist.select("stratum").distinct().count())
    of = Window.partitionBy("stratum", "rule")
    above = of.orderBy(F.desc("value"))
    curve = hist.select("stratum", "rule", "value", F.sum("good").over(above).alias("lost"), F.sum("bad").over(above).alias("caught"), F.sum("good").over(of).alias("n"))
    totals = curve.groupBy("stratum", "rule").agg(F.max("n").alias("n"))
    log_level = math.log(level / (strata * len(RULES)))
    most = " ".join(f"WHEN '{rule}' THEN {allowed('n', risk * SHARES[rule], log_level)}" for rule in RULES)
    totals = totals.withColumn("most", F.expr(f"CASE rule {most} END"))
    usable = curve.join(totals.drop("n"), ["stratum", "rule"]).filter((F.col("lost") <= F.col("most")) & (F.col("caught") > COST * F.col("lost")))
    gain = F.col("caught") - COST * F.col("lost")
    best = usable.withColumn("gain", gain).withColumn("best", F.max(gain).over(of)).filter("gain = best").groupBy("stratum", "rule").agg(F.max("value").alias("hi"), F.max("best").alias("gain"))
    # between this value and the next lower one seen in the stratum nothing changes: take the middle
    below = curve.join(best, ["stratum", "rule"]).filter("value < hi").groupBy("stratum", "rule").agg(F.max("value").alias("lo"))
    return best.join(below, ["stratum", "rule"], "left").select("stratum", "rule", F.expr("coalesce((hi + lo + 2) div 2, hi)").alias("cutoff"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with the rules each document breaks and kept."""
    wide = limits.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cutoff"))
    wide = wide.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    broken = F.concat_ws(",", *[F.when(rule_value(name) >= F.col(f"cut_{name}"), F.lit(name)) for name in RULES])
    return (
        measured.join(small_side(stage(wide, "quality-cutoffs")), "stratum", "left")
        .withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
        .drop(*[f"cut_{r}" for r in RULES])
    )


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Counts, base_failed, broken rules and kept of every document."""
    measured = stage(features(docs), "quality")
    return judge(measured, cutoffs(measured, labels, risk, level))


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The documents kept, with all their columns."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("lang").cast("string"), F.md5(whole_text()))
    keyed = carried(docs, "doc_id", "lang", "text").withColumn("_key", key)
    measured = stage(features(keyed, "_key"), "quality")
    gone = judge(measured, cutoffs(measured, labels, risk, level)).filter("NOT kept").select("_key").distinct()
    return restored(keyed.join(small_side(stage(gone, "rejected")), "_key", "left_anti"), docs.columns)
