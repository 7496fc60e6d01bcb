"""Scores of predictions: confusion, ratios, AUC, average precision, sweeps, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn of truth and pred (0 or 1)."""
    t, p = F.col("truth") == 1, F.col("pred") == 1
    return df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def ratios(counts: DataFrame) -> DataFrame:
    """`counts` with accuracy, precision, recall, f1; 0 where a ratio has nothing below."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return counts.withColumns({"accuracy": over(tp + tn, tp + fp + fn + tn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """by, roc_auc of score for truth, from rank sums, ties at their mean rank; null with one class.

    Ranks come from counts by distinct score, so the ordered window runs over those and not over rows.
    """
    counts = df.groupBy(*by, "score").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("pos"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = counts.withColumn("rank", below + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("s"))
    return sums.select(*by, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("roc_auc"))


def over(a: str, b: str) -> Column:
    """a / b; 0 where b is."""
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def average_precision(hits: DataFrame, n_gt: DataFrame, by: list[str] | None = None, ranges: int = 200) -> DataFrame:
    """by, ap (all-point interpolated), precision and recall of all hits together, n_gt; zeros for a row of `n_gt` (by, n_gt) without hits.

    `hits` has score and hit (0 or 1). Hits of one score count together, as no threshold parts them. Sums run within ranges of
    scores, and what lies above or below a range comes from one row for it, so that no task sorts all.
    """
    by = by or []
    cells = hits.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("tp"))
    cuts = sorted(set(hits.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)])).first()[0] or []))  # `ranges` numbers at most
    cells = cells.withColumn("_r", _range(F.col("score"), cuts))
    sums = cells.groupBy(*by, "_r").agg(F.sum("n").alias("_rn"), F.sum("tp").alias("_rtp"))
    part = by or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rn", "_rtp")])
    inside = Window.partitionBy(*by, "_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumns({"_n": F.sum("n").over(inside), "_tp": F.sum("tp").over(inside)}).join(sums, [*by, "_r"])
    ranked = ranked.withColumn("_p", (F.col("_tp") + F.col("_rtp_before")) / (F.col("_n") + F.col("_rn_before")))
    below = Window.partitionBy(*part).orderBy(F.desc("_r")).rowsBetween(1, Window.unboundedFollowing)
    best = ranked.groupBy(*by, "_r").agg(F.max("_p").alias("_best")).select(*by, "_r", F.max("_best").over(below).alias("_below"))
    here = Window.partitionBy(*by, "_r").orderBy(F.desc("score")).rowsBetween(0, Window.unboundedFollowing)
    env = ranked.withColumn("_here", F.max("_p").over(here)).join(best, [*by, "_r"]).withColumn("_env", F.greatest("_here", "_below"))
    found = env.groupBy(*by).agg(F.sum(F.col("tp") * F.col("_env")).alias("_area"), F.sum("tp").alias("_hits"), F.sum("n").alias("_all"))
    joined = n_gt.join(found, by, "left") if by else n_gt.crossJoin(found)  # two tables of one row
    joined = joined.na.fill(0, ["n_gt", "_area", "_hits", "_all"])
    return joined.select(*by, over("_area", "n_gt").alias("ap"), over("_hits", "_all").alias("precision"), over("_hits", "n_gt").alias("recall"), "n_gt")


def _range(value: Column, cuts: list) -> Column:
    """The number of cuts at or below a value, by halving."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def leaderboard(board: DataFrame) -> DataFrame:
    """`board` with rank: f1, then auc, best first, then latency, nulls last, then name."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("cv_f1"), F.desc_nulls_last("cv_roc_auc"), F.asc_nulls_last("latency_ms"), "candidate")
    return board.withColumn("rank", F.row_number().over(order))


def best_of_families(ranked: DataFrame, k: int) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("model").orderBy("rank"))
    return ranked.withColumn("_f", first).where("_f = 1").drop("_f").orderBy("rank").limit(k)


def chosen(ranked: DataFrame, min_gain: float = 0.002) -> DataFrame:
    """The winner's row: an ensemble only if it beats the best single model by `min_gain`."""
    ens = F.col("candidate").startswith("ensemble[")
    single = ranked.where(~ens).orderBy("rank").limit(1)
    top = ranked.orderBy("rank").limit(1)
    gap = top.select(F.col("cv_f1").alias("top_f1"), "candidate").crossJoin(single.select(F.col("cv_f1").alias("single_f1"), F.col("candidate").alias("single")))
    name = gap.select(F.when(ens & (F.col("top_f1") - F.col("single_f1") < min_gain), F.col("single")).otherwise(F.col("candidate")).alias("candidate"))
    return ranked.join(name, "candidate", "left_semi")
