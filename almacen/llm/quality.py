"""3. Quality rules with risk-controlled thresholds (native: SQL functions only).

Every rule rejects a text whose statistic (a rate per mille) exceeds a cutoff.
For each stratum and rule, the cutoffs are tested from the loosest to the
strictest on labelled documents: a cutoff passes if, were its true rate of
false rejections ``alpha / rules`` or more, seeing as few rejected good
documents as it did would have a probability of at most ``delta / (strata *
rules)`` (exact binomial tail, i.e. the Clopper-Pearson bound; Bonferroni over
strata and rules). Testing stops at the first cutoff that fails, so the fixed
order needs no correction over the grid, and with probability ``1 - delta``
every cutoff that passed is safe: in no stratum do the rules reject more than
``alpha`` of the good documents. Of a rule's safe cutoffs, the one with the
largest difference between the shares of bad and good documents rejected is
taken (of equals the loosest); a rule for which no cutoff rejects bad documents
more often than good ones is not used. A stratum with too few labels for a
guarantee keeps all its documents.

Defined cases: a null text has no words and fails the base rules; a null
stratum is a stratum of its own; labels that are null, repeated or without a
document count nothing or once per matching row; an empty label table
certifies no cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, let, staged

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats", "upper")
GRID = (900, 700, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)
ALPHA, DELTA = 0.04, 0.05
WINDOW = 5


def _dup_positions(keyed: Column) -> Column:
    """From ``array<struct<k, i>>``: the ``i`` whose ``k`` occurs twice or more."""
    def among(s):
        n = F.size(s)

        def same(j, off):
            at = j + F.lit(off)
            return (at >= 0) & (at < n) & (F.get(s, at)["k"] == F.get(s, j)["k"])
        return F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: same(j, -1) | same(j, 1)),
                           lambda j: F.get(s, j)["i"])
    return let(F.array_sort(keyed), among)


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are hashed first; only the positions whose hash repeats are
    compared word by word, which settles hash collisions exactly.
    """
    def window(w, i):
        return [F.get(w, i + F.lit(k)) for k in range(WINDOW)]

    def counted(w):
        starts = F.sequence(F.lit(0), F.size(w) - F.lit(WINDOW))
        hashes = F.transform(starts, lambda i: F.xxhash64(*window(w, i)))

        def exact(h):
            maybe = _dup_positions(F.transform(h, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
            sure = _dup_positions(F.transform(
                maybe, lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("k"), i.alias("i"))))
            covered = let(sure, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.size(
                F.array_distinct(F.flatten(F.transform(p, lambda i: F.sequence(i, i + F.lit(WINDOW - 1))))))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, exact))
    return let(words, counted).cast("long")


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base counts and rule statistics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col(stratum).alias("stratum"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(WORD[:-1]))

    def line_counts(s):
        return F.struct(F.size(s).cast("long").alias("n"),
                        (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("dup"))
    f = base.select(
        "doc_id", "stratum",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                      repeated_words(w).alias("rep"))).alias("w"),
        let(lines, line_counts).alias("l"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))
    return f.select("doc_id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
                    F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"),
                    F.col("l.n").alias("n_lines"), "n_upper").withColumn(
        "base_failed", (F.col("n_words") < 10)
        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _rate(part: str, whole: str) -> Column:
    return F.expr(f"(1000 * {part}) div greatest({whole}, 1)")


def statistics() -> dict[str, Column]:
    return {"symbols": _rate("n_symbols", "word_chars"), "dup_lines": _rate("n_dup_lines", "n_lines"),
            "repeats": _rate("n_repeat_words", "n_words"), "upper": _rate("n_upper", "word_chars")}


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight steps up, where it is exact to double precision."""
    y = z + 8
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(z + k)
    return ((y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi))
            + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))) - steps


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x). Terms are summed downwards from x; what lies below
    the last of ``10 + 12 sd`` terms is bounded by its geometric series."""
    n, x = n.cast("double"), x.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(x + 1) - _log_gamma(n - x + 1)
                + x * F.lit(math.log(p)) + (n - x) * F.lit(math.log1p(-p)))
    terms = F.least(x, F.ceil(F.lit(10.0) + 12 * F.sqrt(n * p))).cast("int")

    def ratio(j):
        return j * (1 - p) / ((n - j + 1) * p)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc, k):
        t = acc["t"] * ratio(x - k + F.lit(1.0))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), terms), start,
                        lambda acc, k: F.when(k == 0, acc).otherwise(add(acc, k)))
    rest = ratio(F.greatest(x - terms, F.lit(0.0)))
    return F.when(x >= n * p, F.lit(1.0)).otherwise(
        top * let(total, lambda s: s["s"] + F.when(rest < 1, s["t"] * rest / (1 - rest)).otherwise(0.0)))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            grid: tuple = GRID) -> DataFrame:
    """``stratum, rule, cutoff``: the most useful safe cutoff, where there is one."""
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("l_doc"), (F.col("quality") == 1).alias("good"))
    stats = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("stat")) for k, v in statistics().items()])

    def number(cond) -> Column:
        return F.sum(cond.cast("long"))
    good, stat = F.col("good"), F.col("r.stat")
    at = F.array(*[F.struct(F.lit(g).alias("cut"), F.col(f"x{g}").alias("x"), F.col(f"y{g}").alias("y")) for g in grid])
    counts = (feats.filter("not base_failed").join(known, F.col("doc_id") == F.col("l_doc"))
              .select("stratum", "good", F.explode(stats).alias("r"))
              .groupBy("stratum", F.col("r.rule").alias("rule"))
              .agg(number(good).alias("n"), number(~good).alias("bad"),
                   *[number(good & (stat > g)).alias(f"x{g}") for g in grid],
                   *[number(~good & (stat > g)).alias(f"y{g}") for g in grid]))
    strata = counts.select(F.count(F.lit(1)).over(Window.partitionBy("rule")).alias("m"), "*")
    rows = strata.select("stratum", "rule", "n", "bad", "m", F.posexplode(at).alias("step", "z"))
    tested = rows.select("stratum", "rule", "step", F.col("z.cut").alias("cut"),
                         (F.col("z.y") * F.col("n") - F.col("z.x") * F.col("bad")).alias("gain"),
                         ((F.col("n") > 0) & (binomial_tail(F.col("z.x"), F.col("n"), alpha / len(RULES))
                                              <= F.lit(delta / len(RULES)) / F.col("m"))).alias("ok"))
    upto = Window.partitionBy("stratum", "rule").orderBy("step")
    safe = tested.withColumn("safe", F.min("ok").over(upto)).filter("safe and gain > 0")
    return safe.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct("gain", "cut")).alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
                  delta: float = DELTA) -> DataFrame:
    """Every document with its counts, ``base_failed`` and the verdict ``kept``."""
    feats = staged(features(docs, stratum), "quality-features")
    cuts = staged(cutoffs(feats, labels, alpha, delta), "quality-cutoffs")
    wide = cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}")
                                         for r in RULES]).withColumnRenamed("stratum", "c_stratum")
    # One row per stratum that certified a cutoff, so the join never moves the documents by stratum
    # unless there are more strata than the session's broadcast threshold admits.
    out = feats.join(wide, feats.stratum.eqNullSafe(wide.c_stratum), "left")
    over = F.lit(False)
    for r, stat in statistics().items():
        over = over | F.coalesce(stat > F.col(f"cut_{r}"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
