"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Patterns find assignments, access keys and long hex runs.  The battery then looks at every
other run of at least ``MIN_CHARS`` key-like characters: it infers the encoding from the
characters that occur, and tests the run for uniform use of that alphabet (chi-squared),
for the number of runs above and below the middle of the alphabet, and for serial
correlation.  Its score is the smallest of the three p-values, times three.

A score says how well a run fits randomness.  How often ordinary text scores as high is
measured on the corpus itself: words, and words joined to paths, slugs and rules, serve as
decoys.  Per class of length the threshold is the lowest score at which the estimated share
of decoys among the reported runs stays at or below ``fdr`` (the target-decoy form of
false-discovery control), so short runs must pass a higher bar than long ones.  No corpus
lowers it below the fixed ``FLOORS``, which alone decide where no decoy scores as high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellpath.llm.common import documents

# The base patterns, and the least lengths of what they match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ["assign", "access", "hex", "random"]

RUN = r"[A-Za-z0-9+/_-]{16,}"
MIN_CHARS = 16
SCORE_STEPS = 100
# Per class of length the least score reported whatever the corpus: words of sf0.01 joined, capitalised or separated
# score less in 95 of 100 cases.
FLOORS = [75, 40, 20, 5, 5]

# Alphabets of the encodings, in their own order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "upper base36": DIGITS + UPPER,
    "lower": LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}


def matches_at(text: Column, pattern: str) -> Column:
    """Every leftmost match of ``pattern`` as structs of start, end (code points) and ``found``.

    ``split`` with the same pattern gives the stretches between matches, so prefix sums of
    lengths place them.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("found")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.char_length(m["gap"]) + F.char_length(m["found"])).alias("at"),
            F.array_append(acc["out"], F.struct(
                (acc["at"] + F.char_length(m["gap"])).alias("start"),
                (acc["at"] + F.char_length(m["gap"]) + F.char_length(m["found"])).alias("end"),
                m["found"].alias("found"))).alias("out")))["out"]


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Spans of one kind; texts in which the pattern does not occur are passed by."""
    found = F.transform(F.filter(matches_at(text, pattern), keep), lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(_none(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, ordered by start, then kind as listed."""
    return F.array_sort(F.concat(
        _spans(text, "assign", ASSIGN, lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= MIN_ASSIGN),
        _spans(text, "access", ACCESS, lambda m: F.char_length(m["found"]) >= MIN_ACCESS),
        # hex matches are whole runs, so asking for long ones finds the same as dropping short ones
        _spans(text, "hex", rf"[0-9a-f]{{{MIN_HEX},}}", lambda m: F.lit(True))))


def _case(choices: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(condition, value) for condition, value in choices], otherwise)


def inferred(run: Column) -> Column:
    """Name of the narrowest alphabet that holds every character of the run."""
    narrow = (("hex", "0-9a-f"), ("upper hex", "0-9A-F"), ("lower", "a-z"), ("base32", "A-Z2-7"), ("base36", "0-9a-z"),
              ("upper base36", "0-9A-Z"), ("base64", "A-Za-z0-9+/"))
    return _case([(run.rlike(f"^[{allowed}]+$"), F.lit(name)) for name, allowed in narrow], F.lit("base64url"))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by its logistic approximation."""
    a = F.least(F.abs(z), F.lit(8.0))
    return 2.0 / (1.0 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def randomness(run: Column) -> Column:
    """Smallest p-value of the three tests times three, at most 1: high means it fits randomness."""
    encoding = inferred(run)
    alphabet = _case([(encoding == name, F.lit(letters)) for name, letters in ALPHABETS.items()], F.lit(""))
    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.position(c, alphabet).cast("double"))
    prepared = F.struct(places.alias("x"), F.char_length(alphabet).cast("double").alias("k"))
    return F.transform(F.array(prepared), _tests)[0]  # binds what is used several times


def _tests(p: Column) -> Column:
    x, k = p["x"], p["k"]
    n = F.size(x).cast("double")
    counted = F.aggregate(
        F.array_sort(x), F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares")),
        lambda a, v: F.struct(
            v.alias("last"), F.when(v == a["last"], a["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            # the square of a count is the sum of 1, 3, 5, ...
            (a["squares"] + F.when(v == a["last"], 2.0 * a["run"] + 1.0).otherwise(F.lit(1.0))).alias("squares")))
    chi = counted["squares"] * k / n - n
    df = k - 1.0
    # Wilson-Hilferty: the cube root of chi-squared over its freedom is nearly normal; only too uneven use counts
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
    p_chi = F.when(z_chi > 0, _normal_tail(z_chi) / 2.0).otherwise(F.lit(0.5))
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(
        a.alias("a"), b.alias("b")))
    middle, variance = (k + 1.0) / 2.0, (k * k - 1.0) / 12.0
    sums = F.aggregate(
        pairs, F.struct(F.lit(0.0).alias("changes"), F.lit(0.0).alias("serial")), lambda s, q: F.struct(
            (s["changes"] + F.when((q["a"] > middle) != (q["b"] > middle), 1.0).otherwise(F.lit(0.0))).alias("changes"),
            (s["serial"] + (q["a"] - middle) * (q["b"] - middle)).alias("serial")))
    steps = n - 1.0
    z_runs = (sums["changes"] - steps / 2.0) / (F.sqrt(steps) / 2.0)
    z_serial = sums["serial"] / (variance * F.sqrt(steps))
    return F.least(F.lit(1.0), 3.0 * F.least(p_chi, _normal_tail(z_runs), _normal_tail(z_serial)))


def length_class(length: Column) -> Column:
    """0 for 16-19 characters, 1 for 20-23, 2 for 24-31, 3 for 32-47, 4 for more."""
    return F.when(length < 20, 0).when(length < 24, 1).when(length < 32, 2).when(length < 48, 3).otherwise(4)


def is_decoy(run: Column) -> Column:
    """Words alone or with separators (a capital only begins a word), or one character repeated."""
    words = run.rlike("^[A-Za-z+/_-]+$") & ~run.rlike("[A-Za-z][A-Z]")
    return words | (F.replace(run, F.substring(run, 1, 1), F.lit("")) == "")


def _runs(text: Column) -> Column:
    scored = F.transform(matches_at(text, RUN), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), length_class(F.char_length(m["found"])).alias("length"),
        is_decoy(m["found"]).alias("decoy"), F.floor(randomness(m["found"]) * SCORE_STEPS).cast("int").alias("score")))
    return F.when(text.rlike(RUN), scored).otherwise(
        _none("array<struct<start:int,end:int,length:int,decoy:boolean,score:int>>"))


def score_thresholds(docs: DataFrame, fdr: float = 0.05) -> dict[int, int]:
    """Per class of length the least score step that is reported; classes without one report nothing.

    Counts cover every run of every text.  The table has at most 5 x 101 rows.  Where decoys
    reach a score, they and one more must be within ``fdr``; otherwise ``FLOORS`` decides.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = docs.select(F.inline(_runs(text))).groupBy("length", "score").agg(
        F.count_if("decoy").alias("decoys"), F.count_if(~F.col("decoy")).alias("others"))
    above = Window.partitionBy("length").orderBy(F.desc("score"))
    judged = runs.select("length", "score", F.sum("decoys").over(above).alias("decoys"), F.sum("others").over(above).alias("others"))
    few = (F.col("decoys") == 0) | (F.col("decoys") + 1 <= fdr * F.col("others"))
    passed = judged.where(few & (F.col("others") > 0) & (F.col("score") >= F.element_at(F.array(*map(F.lit, FLOORS)), F.col("length") + 1)))
    return {r["length"]: r["score"] for r in passed.groupBy("length").agg(F.min("score").alias("score")).collect()}


def find_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with ``base`` and ``spans``: arrays of structs of start, kind, end.

    ``base`` has the spans of the fixed patterns; ``spans`` adds those of the battery that
    overlap none of them, as kind ``random``.  Kinds are positions in ``KINDS``; positions
    count code points, ends are exclusive.  A null text is empty; every row is scanned by
    itself, so repeated rows and null ids change nothing but the counts behind the thresholds.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    limits = score_thresholds(docs, fdr)
    random = _none(_SPANS)
    if limits:
        random = F.transform(
            F.filter(_runs(text), lambda run: ~run["decoy"] & _any([
                (run["length"] == length) & (run["score"] >= score) for length, score in sorted(limits.items())])),
            lambda run: F.struct(run["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), run["end"].alias("end")))
    scanned = docs.select("doc_id", base_spans(text).alias("base"), random.alias("random"))
    apart = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == KINDS.index(kind)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))
