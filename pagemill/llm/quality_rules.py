"""Quality rules whose cutoffs carry a risk guarantee.

Every rule compares one whole number measured on a text with a cutoff. Labelled
documents are the holdout. For each stratum and rule the cutoffs are tested from
the most lenient to the strictest; a cutoff passes if the exact binomial
(Clopper-Pearson) upper bound on the share of good documents it rejects is at
most alpha / rules. The tests of one sequence stop at the first failure, so they
need no correction among themselves; the level delta is divided by the number of
(stratum, rule) sequences (Bonferroni). With probability 1 - delta no stratum
loses more than alpha of its good documents to all rules together. Among passed
cutoffs the one with the largest surplus of bad over good rejections is taken,
on ties the most lenient; without a surplus the rule is off in that stratum.

Null and empty texts count as texts without words and fail the base rule. Rows
with equal ids are judged by their own text; a label counts for each of them.
Rows without a label are judged, never learned from. Null strata form one stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import WORD, with_windows, words
from .storage import stored, unused

SYMBOLS = "[#*$%&|<>]"
STEPS = 200  # cutoffs of a rule: multiples of 1/200 of its scale
MAX_BROADCAST_STRATA = 10_000


@dataclass(frozen=True)
class Rule:
    """Rejects texts whose value of `metric`, in 0 to `STEPS`, is the cutoff or more."""

    name: str
    numerator: str
    denominator: str
    scale: int = 1

    def bin(self) -> Column:
        top, low = F.col(self.numerator) * STEPS, F.greatest(F.col(self.denominator) * self.scale, F.lit(1))
        return F.least(F.floor(top / low), F.lit(STEPS)).cast("int")


RULES = (
    Rule("symbols", "n_symbols", "word_chars"),
    Rule("capitals", "n_capitals", "word_chars"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines"),
    Rule("repeated_words", "n_repeat_words", "n_words"),
    Rule("long_words", "word_chars", "n_words", 20),
    Rule("few_distinct", "n_not_distinct", "n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "n_not_distinct")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(all columns of docs but those named here, then MEASURES and base_failed)."""
    added = [*MEASURES, "base_failed"]
    names = [c for c in docs.columns if c not in added]
    # the row travels as one value, so none of its columns can clash with ours
    kept = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *kept,
        words(body).alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
    )
    counted = with_windows(split, "_words", "_windows").select(
        "row", "n_symbols", "n_capitals", "word_chars", "_windows",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.size("_words") - F.size(F.array_distinct("_words"))).cast("bigint").alias("n_not_distinct"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    # positions of windows met twice, by sorting (hash, position); most texts have none
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = counted.withColumn(
        "_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs)
    ).drop("_windows")
    twice = F.filter(
        "_pairs",
        lambda x, k: F.coalesce(
            (F.get("_pairs", k + 1)["h"] == x["h"]) | (F.get("_pairs", k - 1)["h"] == x["h"]),
            F.get("_pairs", k + 1)["h"] == x["h"],
            F.get("_pairs", k - 1)["h"] == x["h"],
            F.lit(False),
        ),
    )
    placed = ordered.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_pairs")
    # a window covers five words, or up to where the next one begins
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.coalesce(F.get("_at", k + 1) - p, F.lit(5)), F.lit(5))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    out = placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_at")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.select(*[F.col("row")[c].alias(c) for c in names], *MEASURES, failed.alias("base_failed"))


def ln_factorial(n: Column) -> Column:
    """ln n!, to double precision: a product for small n, Stirling's series beyond."""
    n = n.cast("double")
    small = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    x = F.greatest(n, F.lit(20.0)) + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, small).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for k up to the mean, which is all that the test needs. Terms are
    added from k downwards; those more than some ten standard deviations away are
    below double precision and left out."""
    terms = F.least(k, (F.sqrt(n * p) * 12).cast("bigint") + 60)
    first = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)
    first = F.exp(first + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), terms),
        F.struct(F.lit(0.0).alias("sum"), first.alias("term")),
        lambda a, j: F.struct(
            (a["sum"] + a["term"]).alias("sum"),
            (a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def learn(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id",
          good: str = "quality", rules=RULES, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n_good, rejected_good, rejected_bad) of the rules that
    are on. Documents that fail the base rule are no evidence: they go anyway."""
    given = labels.where(F.col(good).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(good).alias("_good"))
    # one small row per text is shuffled, never the text
    values = measured.where(~F.col("base_failed")).select(
        F.col(key).alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        F.array(*[r.bin() for r in rules]).alias("_bins"),
    )
    seen = values.join(given, "_key").select("stratum", "_good", F.posexplode("_bins").alias("_rule", "bin"))
    hist = seen.groupBy("stratum", "_rule", "bin").agg(
        F.sum((F.col("_good") == 1).cast("bigint")).alias("good"),
        F.sum((F.col("_good") != 1).cast("bigint")).alias("bad"),
    )
    # at most STEPS + 1 rows for each stratum and rule from here on
    hist = stored(hist, "rule-bins")
    tests = max(hist.select("stratum", "_rule").distinct().count(), 1)
    group = Window.partitionBy("stratum", "_rule")
    stricter = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    # a cutoff between two occupied bins rejects what the higher bin rejects
    sums = hist.select(
        "stratum", "_rule", F.col("bin").alias("cutoff"), F.sum("good").over(group).alias("n_good"),
        F.sum("good").over(stricter).alias("rejected_good"), F.sum("bad").over(stricter).alias("rejected_bad"),
    )
    tried = sums.where("cutoff >= 1 AND n_good > 0 AND rejected_bad > rejected_good").where(
        binomial_cdf(F.col("rejected_good"), F.col("n_good"), alpha / len(rules)) <= F.lit(delta / tests)
    )
    best = tried.groupBy("stratum", "_rule").agg(
        F.max(F.struct((F.col("rejected_bad") - F.col("rejected_good")).alias("surplus"), "cutoff",
                       "n_good", "rejected_good", "rejected_bad")).alias("b")
    )
    names = F.array(*[F.lit(r.name) for r in rules])
    return best.select("stratum", F.get(names, F.col("_rule")).alias("rule"), "b.cutoff", "b.n_good",
                       "b.rejected_good", "b.rejected_bad")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str, rules=RULES) -> DataFrame:
    """Measured rows with `rejected_by` (names of the rules, in their order) and `kept`."""
    own, given, values = unused(measured.columns, "_own", "_given", "_cutoffs")
    per = cutoffs.groupBy(F.col("stratum").alias(given)).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(values)
    )
    if per.count() <= MAX_BROADCAST_STRATA:  # one row of at most len(rules) numbers each
        per = F.broadcast(per)
    base = measured.drop("rejected_by", "kept").withColumn(own, F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    joined = base.join(per, F.col(own) == F.col(given), "left")
    hit = [F.when(r.bin() >= F.try_element_at(values, F.lit(r.name)), F.lit(r.name)) for r in rules]
    out = joined.withColumn("rejected_by", F.array_compact(F.array(*hit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(own, given, values)
