r"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

Base kinds (assign, access, hex) are found leftmost and non-overlapping, and short ones dropped. Further candidates are
runs of base64 characters of at least ``MIN_TOKEN`` with a letter or digit that overlap no base span, letters-only and
digits-only ones included.

Battery. The smallest alphabet that holds a token's characters is its inferred encoding (digits, one case of hex, of
letters, base32, one case of letters with digits, both cases, both with digits, base64). Under it three tests ask whether
the token could be uniformly random: chi-squared of the character counts (with its exact mean and variance for the
length), the number of runs above and below the middle of the alphabet, and the serial correlation of neighbouring
characters. The smallest of the three p-values, times three, is the token's p-value.

Control of false discoveries. A written token isn't random but may pass. For every candidate ``DECOYS`` tokens of its
length and form are made up: words of its text (those of ``STOCK`` behind them, if there are few) run together in its
letter case, joined by its own sign if it has one, its digits behind them; for digits-only tokens, numbers of the
text. They go through the same tests. Per form of alphabet and band of lengths, the share of made-up tokens above a
p-value tells how many of the candidates would pass if all were written; the lowest p-value is taken at which that
is at most ``FDR`` of those that pass. No real token counts as false, so many random keys in one source raise
no limit. Where the tests can't tell words from keys (short tokens of one case), or numbers from keys, or nothing is
there to compare with, nothing is reported. Base hits that are whole tokens count as candidates.

Built-in functions only. Whole texts, null as empty: no spans. Offsets are code points, ends exclusive. Rows are
independent but for the thresholds, so ties and repeated rows get equal results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import empty_array, let, lower_bound, running_sum
from ..session import small_side
from .common import carried, restored, stage, whole_text

#: Fixed values of the base kinds: pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN
#: A word, and a number, that made-up tokens are put together from; shorter than a candidate, and no part of one.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,%d}(?![A-Za-z0-9+/_=-])" % (MIN_TOKEN - 1)
NUMBER = r"(?<![A-Za-z0-9+/_=-])[0-9]{2,%d}(?![A-Za-z0-9+/_=-])" % (MIN_TOKEN - 1)
#: Words for texts with few of their own.
STOCK = (
    "the and that with from this have about which their would other people because between after never house water place "
    "und nicht auch eine werden haben kann durch noch immer pour dans avec vous nous cette entre toujours monde "
    "que para como pero cuando tiempo siempre todos desde mundo"
).split()
DECOYS = 4
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: name, alphabet, form. Limits are found per form and length band.
ALPHABETS = (
    ("decimal", DIGITS, 0),
    ("hex", "0123456789abcdef", 2),
    ("HEX", "0123456789ABCDEF", 2),
    ("base26", LOWER, 1),
    ("BASE26", UPPER, 1),
    ("base32", UPPER + "234567", 2),
    ("base36", DIGITS + LOWER, 2),
    ("BASE36", DIGITS + UPPER, 2),
    ("base52", UPPER + LOWER, 3),
    ("base62", DIGITS + UPPER + LOWER, 4),
    ("base64", DIGITS + UPPER + LOWER + "+/_-", 5),
)
#: Length bands: lower ends.
BANDS = (16, 24, 32, 48, 96)
STRATA = len(BANDS) * (1 + max(form for *_, form in ALPHABETS))
FDR = 0.1
#: p-values are compared by -4 log10 p, in whole steps; beyond the last step nothing is reported.
STEPS = 24

SPAN = "struct<start:int,ord:int,end:int,kind:string>"
CANDIDATE = "struct<body:string,start:int,end:int,decoy:boolean,free:boolean>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, length of the group) of all matches, leftmost and non-overlapping."""

    def place(values: Column) -> Column:
        steps = let(
            F.split(text, pattern, -1),
            lambda gaps: F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0))),
        )
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else values
        return let(
            F.struct(running_sum(steps).alias("at"), parts.alias("parts")),
            lambda s: F.transform(
                values,
                lambda v, i: F.struct(
                    F.get(s["at"], i).alias("start"), (F.get(s["at"], i) + F.length(v)).alias("end"), F.length(F.get(s["parts"], i)).alias("size"), v.alias("value")
                ),
            ),
        )

    none = empty_array("struct<start:int,end:int,size:int,value:string>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) > 0, place(values)).otherwise(none))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    # a maximal run of one class is found the same way with its least length in the pattern, and far fewer runs are split off
    lean = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}

    def of_kind(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
        hits = F.filter(located(text, lean.get(kind, pattern), group), lambda m: m["size"] >= least)
        return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[of_kind(order, *rule) for order, rule in enumerate(BASE)]))


def _tail(value: Column, two_sided: bool) -> Column:
    """Upper tail of the standard normal, by a rational approximation with error below 1.2e-7 relative."""

    def erfc(x: Column, t: Column) -> Column:
        poly = F.lit(0.17087277)
        for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
            poly = F.lit(c) + t * poly
        return t * F.exp(-x * x - 1.26551223 + t * poly)

    def tail(z: Column) -> Column:
        at_least = let(F.abs(z) / 2**0.5, lambda x: let(1 / (1 + x / 2), lambda t: erfc(x, t)))
        return at_least if two_sided else let(at_least, lambda e: F.when(z >= 0, e / 2).otherwise(1 - e / 2))

    return let(value, tail)


def p_value(values: Column, size: Column) -> Column:
    """Smallest of three p-values, times three, that an array of alphabet places is uniformly random."""

    def tests(v: Column) -> Column:
        return let(F.size(v).cast("double"), lambda n: of_length(v, n))

    def of_length(v: Column, n: Column) -> Column:
        squares = F.aggregate(
            F.array_sort(v),
            F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total")),
            lambda a, x: F.struct(
                x.alias("last"),
                F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1)).alias("run"),
                (a["total"] + F.when(a["last"] == x, 2 * a["run"] + 1).otherwise(F.lit(1))).alias("total"),
            ),
            lambda a: a["total"],
        )
        sums = F.aggregate(
            v,
            F.struct(F.lit(-1).alias("last"), *(F.lit(0.0).alias(c) for c in ("high", "runs", "s", "ss", "sp"))),
            lambda a, x: F.struct(
                x.alias("last"),
                (a["high"] + (2 * x >= size).cast("double")).alias("high"),
                (a["runs"] + F.when((a["last"] >= 0) & ((2 * a["last"] >= size) == (2 * x >= size)), 0.0).otherwise(1.0)).alias("runs"),
                (a["s"] + x).alias("s"),
                (a["ss"] + x * x).alias("ss"),
                (a["sp"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0)).alias("sp"),
            ),
        )

        def combine(s: Column) -> Column:
            chi = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
            expected = 2 * s["high"] * (n - s["high"]) / n + 1

            def by_runs(mean: Column) -> Column:
                spread = (mean - 1) * (mean - 2) / (n - 1)
                return F.when(spread > 0, (s["runs"] - mean) / F.sqrt(spread)).otherwise(F.lit(9.0))

            def by_neighbours(m: Column) -> Column:
                ends = F.get(v, F.lit(0)) + F.get(v, F.size(v) - 1)
                covariance = (s["sp"] - m * (2 * s["s"] - ends) + (n - 1) * m * m) / (n - 1)
                return let(s["ss"] / n - m * m, lambda variance: F.when(variance > 1e-9, covariance / variance * F.sqrt(n)).otherwise(F.lit(9.0)))

            tails = _tail(chi, False), _tail(let(expected, by_runs), True), _tail(let(s["s"] / n, by_neighbours), True)
            return F.least(F.lit(1.0), 3 * F.least(*tails))

        return let(sums, combine)

    return let(values, tests)


def written_tokens(body: Column, place: Column, words: Column, numbers: Column) -> Column:
    """Made-up tokens in the form of one: its length, letter case, sign and digits, but written words (or numbers)."""
    digits, sign = F.regexp_replace(body, "[^0-9]", ""), F.substring(F.regexp_replace(body, "[A-Za-z0-9]", ""), 1, 1)
    upper, lower = body.rlike("[A-Z]"), body.rlike("[a-z]")

    def stretch(stock: Column, least: int, number: Column) -> Column:
        """Neighbours from a place that follows from the token's and the made-up one's number; a short stock is repeated."""
        wanted = F.ceil(F.length(body) / least).cast("int")
        times = F.ceil(wanted / F.size(stock)).cast("int")
        enough = F.when(F.size(stock) >= wanted, stock).when(F.size(stock) > 0, F.flatten(F.array_repeat(stock, times))).otherwise(stock)
        first = lambda all_: F.pmod(F.xxhash64(place, number), F.greatest(F.size(all_) - wanted + 1, F.lit(1))).cast("int") + 1
        return let(enough, lambda all_: F.slice(all_, first(all_), wanted))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda w, i: F.concat(F.when(i > 0, sign).otherwise(F.lit("")), w)), "")

    def spelled(number: Column) -> Column:
        cased = F.transform(stretch(words, 3, number), lambda w: F.when(upper & lower, F.initcap(w)).when(upper, F.upper(w)).otherwise(F.lower(w)))
        text = F.concat(F.substring(joined(cased), F.lit(1), F.length(body) - F.length(digits)), digits)
        return F.when(upper | lower, text).otherwise(F.substring(joined(stretch(numbers, 2, number)), F.lit(1), F.length(body)))

    made = F.transform(F.sequence(F.lit(1), F.lit(DECOYS)), spelled)
    return F.filter(made, lambda d: F.length(d) >= MIN_TOKEN)


def judged(candidate: Column) -> Column:
    """A candidate's encoding, stratum (form and length band) and p-value step."""
    body = candidate["body"]
    letters = F.array(*[F.lit(a) for _, a, _ in ALPHABETS])
    sizes = F.array(*[F.lit(min(64, len(a))) for _, a, _ in ALPHABETS])
    forms = F.array(*[F.lit(f) for *_, f in ALPHABETS])
    band = F.size(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b <= F.length(body))) - 1
    which = F.coalesce(*[F.when(body.rlike(f"^[{a}]+$"), i) for i, (_, a, _) in enumerate(ALPHABETS)])

    def under(k: Column) -> Column:
        # base64 has two spellings of its last two places
        spot = lambda x: let(F.instr(F.get(letters, k), x) - 1, lambda at: F.when(at >= 64, at - 2).otherwise(at))
        p = p_value(F.transform(F.split(body, ""), spot), F.get(sizes, k))
        return F.struct(
            candidate["start"].alias("start"),
            candidate["end"].alias("end"),
            (F.get(forms, k) * len(BANDS) + band).alias("stratum"),
            candidate["decoy"].alias("decoy"),
            F.least(F.lit(STEPS + 1), F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-9)))).cast("int")).alias("step"),
            candidate["free"].alias("free"),
            F.get(F.array(*[F.lit(n) for n, *_ in ALPHABETS]), k).alias("encoding"),
        )

    return let(which, under)


def tested_tokens(text: Column, spans: Column) -> Column:
    """Candidates and tokens made up for them, with their stratum and p-value step; free: overlaps no base span."""
    assigned = F.filter(spans, lambda s: s["kind"] == "assign")

    def with_decoys(found: Column, held: Column) -> Column:
        def of(t: Column, place: Column) -> Column:
            body = F.rtrim(t["value"], F.lit("="))
            # the first assignment that ends behind the token's start, if it begins before the token's end
            assignment = F.coalesce(F.get(held["starts"], lower_bound(held["ends"], t["start"] + 1)) < t["end"], F.lit(False))
            free = ~body.rlike(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}") & ~assignment
            as_piece = lambda value, start, end, decoy, ok: F.struct(
                value.alias("body"), start.alias("start"), end.alias("end"), F.lit(decoy).alias("decoy"), ok.alias("free"))
            own = F.array(as_piece(body, t["start"], t["end"], False, free))
            made = F.transform(written_tokens(body, place, held["words"], held["numbers"]), lambda d: as_piece(d, F.lit(0), F.lit(0), True, F.lit(False)))
            return F.concat(own.cast(f"array<{CANDIDATE}>"), made.cast(f"array<{CANDIDATE}>"))

        return F.flatten(F.transform(found, of))

    wanted = F.filter(located(text, TOKEN), lambda t: t["value"].rlike("[A-Za-z0-9]"))
    held = F.struct(
        F.transform(assigned, lambda s: s["start"]).alias("starts"),
        F.transform(assigned, lambda s: s["end"]).alias("ends"),
        F.concat(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array(*[F.lit(w) for w in STOCK])).alias("words"),
        F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).alias("numbers"),
    )
    found = let(wanted, lambda w: F.when(F.size(w) > 0, let(held, lambda h: with_decoys(w, h))).otherwise(empty_array(CANDIDATE)))
    return F.transform(found, judged)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the base kinds, tested tokens; a narrow stage."""
    return _scan(docs.select("doc_id", whole_text().alias("text")))


def _scan(frame: DataFrame) -> DataFrame:
    frame = frame.withColumn("base", base_spans(F.col("text")))
    return frame.withColumn("tokens", tested_tokens(F.col("text"), F.col("base"))).drop("text")


def thresholds(scanned: DataFrame, fdr: float = FDR) -> DataFrame:
    """(stratum, limit): tokens of the stratum whose step is at most the limit are reported. At most one row per stratum.

    All made-up tokens being written, their share that passes (one more counted) times the candidates bounds the false ones.
    """
    hist = scanned.select(F.inline("tokens")).groupBy("stratum", "step").agg(
        F.count(F.when(~F.col("decoy"), 1)).alias("targets"), F.count(F.when(F.col("decoy"), 1)).alias("decoys"))
    grid = hist.select("stratum", F.explode(F.sequence(F.col("step"), F.lit(STEPS + 1))).alias("limit"), "targets", "decoys")
    sums = grid.groupBy("stratum", "limit").agg(F.sum("targets").alias("targets"), F.sum("decoys").alias("decoys"))
    whole = Window.partitionBy("stratum")  # a few hundred rows of totals
    sums = sums.withColumn("all_targets", F.max("targets").over(whole)).withColumn("all_decoys", F.max("decoys").over(whole))
    fine = sums.filter((F.col("limit") <= STEPS) & ((F.col("decoys") + 1) * F.col("all_targets") <= fdr * F.col("targets") * (F.col("all_decoys") + 1)))
    return fine.groupBy("stratum").agg(F.max("limit").alias("limit"))


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, spans (start, ord, end, kind) of all kinds by start, then kind; base ones and random tokens."""
    return _report(stage(scan(docs), "secrets"), fdr)


def _report(scanned: DataFrame, fdr: float) -> DataFrame:
    limits = {r["stratum"]: r["limit"] for r in thresholds(scanned, fdr).collect()}  # one row per stratum at most
    by_stratum = F.array(*[F.lit(limits.get(k, -1)) for k in range(STRATA)])
    random = F.filter("tokens", lambda t: ~t["decoy"] & t["free"] & (t["step"] <= F.get(by_stratum, t["stratum"])))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("ord"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", random))).drop("tokens", "base")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), count("random").alias("n_random"),
    )


def mask_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with every stretch covered by spans (sorted by start) replaced by the mark.

    Overlapping spans are merged first; the text is cut once, piece by piece, from a blocked copy.
    """
    from ..functions.arrays import block_range, text_blocks

    ends = F.transform(spans, lambda s: s["end"])
    rounds = F.when(F.size(spans) > 1, F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans).cast("double"))).cast("int"))).otherwise(empty_array("int"))

    def widen(m: Column, r: Column) -> Column:
        step = F.pow(F.lit(2), r - 1).cast("int")
        return F.transform(m, lambda x, i: F.when(i >= step, F.greatest(x, F.get(m, i - step))).otherwise(x))

    reach = F.aggregate(rounds, ends, widen)  # how far the spans up to each one reach

    def cut(s: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(s["spans"]) - 1), lambda i: (i == 0) | (F.get(s["spans"], i)["start"] >= F.get(s["reach"], i - 1)))
        return let(opens, lambda o: F.concat(
            F.array_join(F.transform(o, lambda i: F.concat(
                block_range(s["blocks"], F.when(i == 0, 0).otherwise(F.get(s["reach"], i - 1)), F.get(s["spans"], i)["start"] - F.when(i == 0, 0).otherwise(F.get(s["reach"], i - 1))),
                F.lit(mark),
            )), ""),
            block_range(s["blocks"], F.array_max(s["reach"]), F.length(text) - F.array_max(s["reach"])),
        ))

    masked = let(F.struct(spans.alias("spans"), reach.alias("reach"), text_blocks(text).alias("blocks")), cut)
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def mask_documents(docs: DataFrame, mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """The documents with every secret replaced by the mark; all their columns, n_chars corrected if there is one.

    Documents without secrets, most of them, are left as they are; a null text stays null.
    """
    keyed = carried(docs, "doc_id", "text").withColumn("_row", F.xxhash64(F.col("doc_id").cast("string"), F.md5(whole_text())))
    scanned = stage(_scan(keyed.select("_row", whole_text().alias("text"))), "secrets")
    found = _report(scanned, fdr).filter(F.size("spans") > 0).groupBy("_row").agg(F.first("spans").alias("spans"))
    joined = keyed.join(small_side(stage(found, "spans")), "_row", "left")
    text = F.when(F.col("spans").isNotNull(), mask_spans(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return restored(out, docs.columns, **new)
