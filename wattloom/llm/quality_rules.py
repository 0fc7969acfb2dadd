"""Quality rules whose cutoffs are chosen under risk control on labelled documents.

Each rule rejects a document whose value is above a cutoff. For each stratum (a band of text length) and
rule, the cutoffs of a fixed grid are tested from the most lenient on: a cutoff passes if, were the true share
of good documents that it rejects as high as allowed, so few rejections among the labelled good ones would
be seen with probability ``delta`` at most (exact binomial tail). Testing stops at the first failure, so a
sequence makes a false claim with that probability; delta and alpha are split over strata and rules
(Bonferroni), so with probability 1 - delta no stratum loses more than the share alpha of its good documents
to the rules. Of the cutoffs that pass, the one that best separates the labels is used, or none.

The cutoff grid and the strata are fixed beforehand, so all labelled documents that pass the base rules serve as
holdout. All steps are column expressions; the driver sees counts by stratum, rule and cutoff only.

Defined results: a null text has no words; it fails the base rules, as does an empty one; labels that are null or that
contradict each other for one document are left out; repeated documents are rows of their own; without
labels nothing passes, so only the base rules reject; of cutoffs with equal gain the earlier step counts; a long
text is counted in whole, as one row's arrays; other columns are passed on, but none may have the name of a count; an empty
table gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)


@dataclass(frozen=True)
class Risk:
    """alpha: share of a stratum's good documents that all rules may reject; delta: chance to exceed it."""

    alpha: float = 0.05
    delta: float = 0.1
    #: Upper limits of the number of words of each stratum but the last.
    bands: tuple[int, ...] = (200, 1000)
    grid: tuple[float, ...] = GRID
    #: How many rejected bad documents one rejected good document outweighs.
    weight: float = 10.0



def _rules() -> dict[str, Column]:
    """Value of each rule, from 0 to 1, as columns over ``text_statistics``."""
    per_char = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("word_chars")), F.lit(0.0))
    return {
        "symbols": per_char("n_symbols"),
        "capitals": per_char("n_capitals"),
        "repeats": F.coalesce(F.try_divide(F.col("n_repeat_words"), F.col("n_words")), F.lit(0.0)),
        "dup_lines": F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), F.lit(0.0)),
    }


def text_statistics(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals.

    ``rows`` must not have columns of these names. Steps are projections of their own, so that arrays used
    more than once are made once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = rows.withColumn("_body", body).withColumn(
        "_words", F.array_remove(F.split("_body", SPACE), "")).withColumn(
        "_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # The hash of the three words from each word on; the last two have no such window.
    hashes = words.withColumn("_n", F.size("_words")).withColumn("_three", F.when(
        F.col("_n") >= 3, F.slice(F.transform("_words", lambda w, i: F.xxhash64(
            w, F.get("_words", i + 1), F.get("_words", i + 2))), 1, F.col("_n") - 2))
        .otherwise(F.array().cast("array<bigint>")))
    # Sorting is needed only where some window occurs twice.
    again = F.size(F.array_distinct("_three")) < F.size("_three")
    in_order = hashes.withColumn("_sorted", F.when(again, F.sort_array(F.transform(
        "_three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_sorted", lambda s, j: s["h"].eqNullSafe(F.get("_sorted", j - 1)["h"])
                     | s["h"].eqNullSafe(F.get("_sorted", j + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(
        twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    count = lambda pattern: (F.length("_body") - F.length(
        F.regexp_replace("_body", pattern, ""))).cast("long")
    return in_order.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.size(covered).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_capitals": count(r"[A-ZÀ-ÖØ-Þ]"),
    }).drop("_body", "_words", "_lines", "_n", "_three", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum(risk: Risk) -> Column:
    band = F.lit(0)
    for limit in risk.bands:
        band = band + (F.col("n_words") >= limit).cast("int")
    return band


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X of ``n`` trials with chance ``p``, summed exactly in logarithms."""
    start = n * F.log(F.lit(1.0 - p))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1.0 - p)))
        high = F.greatest(acc["total"], term)
        total = high + F.log1p(F.exp(-F.abs(acc["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    up_to = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(up_to, F.struct(start.alias("term"), start.alias("total")), step, lambda a: a["total"])


def choose_cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """stratum, rule, cutoff for each pair that has a useful cutoff that passes.

    ``labelled`` has text statistics and ``quality`` (1 good, 0 bad), base failures left out.
    """
    rules = _rules()
    grid = F.array(*[F.lit(c) for c in risk.grid])
    values = labelled.select(stratum(risk).alias("stratum"), "quality", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), value.alias("value")) for name, value in rules.items()])).alias("v"))
    passed = values.select("stratum", "quality", "v.rule", F.size(
        F.filter(grid, lambda c: F.col("v.value") > c)).alias("above"))
    # above: so many of the cutoffs, from the strictest on, reject the document.
    counted = passed.groupBy("stratum", "rule", "above").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    levels = counted.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("above", "good", "bad")).alias("c"))
    steps = F.transform(grid, lambda cutoff, at: F.struct(cutoff.alias("cutoff"), at.cast("int").alias("step")))
    reached = F.col("s.step")

    def rejections(kind: str) -> Column:
        at_least = F.filter("c", lambda x: x["above"] >= F.lit(len(risk.grid)) - reached)
        return F.aggregate(F.transform(at_least, lambda x: x[kind]), F.lit(0).cast("long"),
                           lambda a, x: a + x).alias(kind)

    cells = levels.select("stratum", "rule", "n", "c", F.explode(steps).alias("s")).select(
        "stratum", "rule", "n", "s.cutoff", "s.step", rejections("good"), rejections("bad"))
    share = risk.alpha / len(rules)
    level = risk.delta / (len(rules) * (len(risk.bands) + 1))
    # Beyond n * share the tail is over one half, so there is nothing to sum.
    few = F.col("good") <= F.col("n") * share
    tail = F.when(few, F.exp(log_binomial_cdf(F.col("good"), F.col("n"), share)))
    tested = cells.withColumn("ok", F.coalesce(tail <= level, F.lit(False)))
    sequence = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    certain = tested.withColumn("ok", F.min("ok").over(sequence)).filter("ok")
    useful = certain.withColumn("gain", F.col("bad") - risk.weight * F.col("good")).filter("gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "step")
    return useful.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("stratum", "rule", "cutoff")


def rejected_by(cutoffs: list, risk: Risk) -> Column:
    """Names of the rules that reject a document, as an array, given the rows of ``choose_cutoffs``."""
    rules = _rules()
    said = [F.when((stratum(risk) == r["stratum"]) & (rules[r["rule"]] > r["cutoff"]), F.lit(r["rule"]))
            for r in sorted(cutoffs, key=lambda r: (r["rule"], r["stratum"]))]
    return F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")


def label_table(labels: DataFrame, doc: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per labelled document whose labels agree."""
    return labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(
        F.col(doc).alias("doc_id")).agg(F.min(label).alias("quality"), F.max(label).alias("_max")).filter(
        "quality = _max").select("doc_id", "quality")


def find_cutoffs(statistics: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> list:
    """Rows (stratum, rule, cutoff) that the labels support; ``statistics`` has doc_id."""
    held = statistics.filter(~base_failed()).join(label_table(labels), "doc_id")
    return choose_cutoffs(held, risk).collect()


def judge(statistics: DataFrame, cutoffs: list, risk: Risk = Risk()) -> DataFrame:
    """``statistics`` with base_failed, rejected_by and kept."""
    return statistics.withColumn("base_failed", base_failed()).withColumn(
        "rejected_by", rejected_by(cutoffs, risk)).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
