"""Evaluation metrics over a table of predictions, each as one or two aggregations.

``by`` names grouping columns (splits, models, thresholds, replicates, ...); without it there is one
row. Labels are 0 or 1. A ``weight`` column counts rows more than once (bootstrap replicates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_percentiles

#: Score ranges in which running sums are made apart, so that no task holds all distinct scores.
RANGES = 1024


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def confusion(df: DataFrame, y: str, yhat: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    cell = lambda a, b: F.coalesce(F.sum(F.when((F.col(y) == a) & (F.col(yhat) == b), w)), F.lit(0)).cast("long")
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))


def classification_metrics(df: DataFrame, y: str, yhat: str, by: list[str] = (), weight: str | None = None, digits: int | None = 4) -> DataFrame:
    """Confusion counts and the usual closed forms; 0 where a denominator is 0."""
    c = confusion(df, y, yhat, by, weight)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    accuracy = ratio(tp + tn, n)
    out = {
        "accuracy": accuracy,
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2,
        "f1": ratio(2 * precision * recall, precision + recall),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "kappa": F.when((n > 0) & (chance != 1), (accuracy - chance) / (1 - chance)).otherwise(F.lit(0.0)),
    }
    return c.withColumns({k: F.round(v, digits) if digits is not None else v for k, v in out.items()})


def score_counts(df: DataFrame, y: str, p: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """For each distinct score: pos, neg, and how many of each score lower (pos_below, neg_below), with the totals.

    Running sums are taken within ``RANGES`` ranges of the score and offset by the ranges' totals.
    """
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*by, F.col(p).alias("score")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"))
    g = g.withColumn("__range", F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col("score") * RANGES))).cast("int"))
    ranges = g.groupBy(*by, "__range").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*by)
    ranges = ranges.withColumns({"__pb": F.coalesce(F.sum("__p").over(before), F.lit(0)), "__nb": F.coalesce(F.sum("__n").over(before), F.lit(0)), "pos_all": F.sum("__p").over(all_of), "neg_all": F.sum("__n").over(all_of)}).drop("__p", "__n")
    inner = Window.partitionBy(*by, "__range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    out = g.join(ranges, [*by, "__range"])
    return out.withColumns({"pos_below": F.col("__pb") + F.coalesce(F.sum("pos").over(inner), F.lit(0)), "neg_below": F.col("__nb") + F.coalesce(F.sum("neg").over(inner), F.lit(0))}).drop("__range", "__pb", "__nb")


def roc_auc(df: DataFrame, y: str, p: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; 0.5 if a class is missing."""
    c = score_counts(df, y, p, by, weight)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return c.groupBy(*by).agg(F.when(F.max("pos_all") * F.max("neg_all") > 0, wins / (F.max("pos_all") * F.max("neg_all"))).otherwise(F.lit(0.5)).alias("auroc"))


def curve_points(df: DataFrame, y: str, p: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, precision: one row for each distinct score, predicting 1 at or above it."""
    c = score_counts(df, y, p, by, weight)
    tp, fp = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    return c.select(*by, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), ratio(tp, F.col("pos_all")).alias("tpr"), ratio(fp, F.col("neg_all")).alias("fpr"), (tp / (tp + fp)).alias("precision"), F.col("pos"), F.col("neg"), F.col("pos_all"))


def pr_auc(df: DataFrame, y: str, p: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """average_precision (steps) and pr_trapezoid (starting at recall 0, precision 1)."""
    c = curve_points(df, y, p, by, weight)
    above_tp, above = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    earlier = F.when(above > 0, above_tp / above).otherwise(F.lit(1.0))
    step = ratio(F.col("pos"), F.col("pos_all"))
    return c.groupBy(*by).agg(F.sum(step * F.col("precision")).alias("average_precision"), F.sum(step * (F.col("precision") + earlier) / 2).alias("pr_trapezoid"))


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def log_loss(y: str, p: str, eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)))


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10, edges: str = "last_closed") -> DataFrame:
    """bin, n, accuracy, confidence, gap: every bin, empty ones with zeros.

    ``edges``: last_closed (p = 1 counts in the last bin), last_open (p = 1 is left out), or left_open
    (bins hold their upper edge and p = 0 is left out).
    """
    spark = df.sparkSession
    x = F.col(p) * bins
    at = {"last_closed": F.least(F.floor(x), F.lit(bins - 1)), "last_open": F.when(F.col(p) < 1, F.floor(x)), "left_open": F.when(F.col(p) > 0, F.ceil(x) - 1)}[edges]
    counted = df.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("accuracy"), F.avg(p).alias("confidence")).where(F.col("bin").isNotNull())
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    out = every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("accuracy"), zero("confidence"))
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def ece(bins: DataFrame) -> DataFrame:
    total = F.sum("n")
    return bins.agg(F.when(total > 0, F.sum(F.col("n") * F.col("gap")) / total).otherwise(F.lit(0.0)).alias("ece"))


def grouped_ece(df: DataFrame, y: str, p: str, by: list[str], bins: int = 10) -> DataFrame:
    """ece of each group, over bins that hold their upper edge (a score of 0 is in none, but counts in the total)."""
    at = F.when(F.col(p) > 0, F.ceil(F.col(p) * bins))
    binned = df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("accuracy"), F.avg(p).alias("confidence"))
    off = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).otherwise(0.0)
    return binned.groupBy(*by).agg((F.sum(off) / F.sum("n")).alias("ece"))


def best_weight(areas: DataFrame, weight: str, value: str) -> DataFrame:
    """The weight of the largest ``value``; of equal ones the smallest."""
    return areas.agg(F.max_by(weight, F.struct(value, -F.col(weight))).alias(f"best_{weight}"), F.max(value).alias(f"best_{value}"))


def at_thresholds(df: DataFrame, y: str, p: str, thresholds: list[float], by: list[str] = (), digits: int | None = None) -> DataFrame:
    """Classification metrics at every threshold (p >= t is 1): each row is compared with a short literal list."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    rows = df.select(*by, F.col(y).alias("__y"), F.col(p).alias("__p"), t).withColumn("__hat", (F.col("__p") >= F.col("threshold")).cast("int"))
    return classification_metrics(rows, "__y", "__hat", [*by, "threshold"], digits=digits)


def best_threshold(metrics: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """The threshold of the largest ``value``; of equal ones the smallest."""
    return metrics.groupBy(*by).agg(F.max_by("threshold", F.struct(value, -F.col("threshold"))).alias("best_threshold"), F.max(value).alias("best_value"))


def gold_join(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, rank: every gold pair with its rank among the first ``k``, null if it is not there."""
    return gold.distinct().join(ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """recall, mrr and ndcg at k, averaged over the queries of ``gold`` (query_id, doc_id) that have any.

    ``ranked``: query_id, doc_id, rank from 1.
    """
    hits = gold_join(ranked, gold, k)
    return _retrieval(hits.groupBy("query_id").agg(F.count("*").alias("n_gold"), *_hits()), k)


def class_retrieval_metrics(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The same where a query's gold is every other row of its class, which is counted and not listed.

    ``queries``: query_id, label; ``corpus``: doc_id, label.
    """
    sizes = corpus.groupBy("label").agg(F.count("*").alias("size"))
    own = corpus.join(queries.select(F.col("query_id").alias("doc_id"), F.col("label").alias("asked")), "doc_id").where("label = asked").groupBy(F.col("doc_id").alias("query_id")).agg(F.count("*").alias("own"))
    gold = queries.join(sizes, "label").join(own, "query_id", "left").select("query_id", "label", (F.col("size") - F.coalesce("own", F.lit(0))).alias("n_gold")).where("n_gold > 0")
    found = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", "rank").join(corpus.select("doc_id", F.col("label").alias("of")), "doc_id")
    hits = gold.join(found, "query_id").where("label = of").groupBy("query_id").agg(*_hits())
    per = gold.select("query_id", "n_gold").join(hits, "query_id", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "dcg": F.coalesce("dcg", F.lit(0.0))})
    return _retrieval(per, k)


def _hits() -> list[Column]:
    return [F.count("rank").alias("n_hit"), F.min("rank").alias("first"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg")]


def _retrieval(per: DataFrame, k: int) -> DataFrame:
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.agg(
        F.count("*").alias("n_queries"), F.avg(F.col("n_hit") / F.col("n_gold")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.col("dcg") / ideal).alias("ndcg")
    )


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """b, c (discordant pairs), statistic with continuity correction, and its p-value from the normal tail.

    The tail is integrated on the one result row: Spark has no error function.
    """
    right_a, right_b = F.col(a) == F.col(y), F.col(b) == F.col(y)
    out = df.agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    n = F.col("b") + F.col("c")
    stat = F.when(n > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / n).otherwise(F.lit(0.0))
    out = out.withColumn("statistic", stat)
    # erfc(x) for x >= 0 by Simpson's rule on exp(-t^2) from x to x + 6
    x, h = F.sqrt(F.col("statistic") / 2), 6.0 / 2000
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(2000)), F.lit(0.0),
        lambda acc, i: acc + F.exp(-F.pow(x + i * h, F.lit(2.0))) * F.when((i == 0) | (i == 2000), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0),
    )
    return out.withColumn("p_value", F.when(n > 0, F.least(F.lit(1.0), total * (h / 3) * 2 / F.sqrt(F.lit(3.141592653589793)))).otherwise(F.lit(1.0)))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and kappa of two annotators over any number of classes."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("a").alias("v")), F.struct(F.lit("b").alias("s"), F.col("b").alias("v")))).alias("x"), "n")
    sides = sides.groupBy("x.v").agg(F.sum(F.when(F.col("x.s") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.s") == "b", F.col("n")).otherwise(0)).alias("nb"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = sides.agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    one = total.crossJoin(chance)  # one row each
    n = F.col("n").cast("double")
    pe = F.col("both") / (n * n)
    po = F.col("same") / n
    return one.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def latency_profile(df: DataFrame, value: str, by: list[str] = (), exact: bool = True) -> DataFrame:
    """n, mean, median, p90, p95, p99, max; percentiles interpolate (exact) or are sketched."""
    shares = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    simple = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")]
    if not exact:
        return df.groupBy(*by).agg(*simple, *(F.percentile_approx(value, x, 10000).cast("double").alias(n) for n, x in shares.items()))
    return with_percentiles(df.groupBy(*by).agg(*simple), df, value, shares, by)
