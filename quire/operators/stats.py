"""Statistics, evaluation measures and period tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average ranks of a column: values are counted, laid out in ranges and summed up.

    Ranks run within a range; what stands before a range is a sum over one row a range, so
    no task has to hold all values. Rows without a value get no rank.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    laid = cut(counts.repartitionByRange(col).withColumn("_p", F.spark_partition_id()))
    starts = laid.groupBy("_p").agg(F.sum("_n").alias("_t")).withColumn("_start", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = laid.withColumn("_before", inside).join(F.broadcast(starts), "_p").select(col, (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, col)


def correlations(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """``feature, n, pearson, spearman`` of each feature with the target."""
    out = None
    for f in features:
        pair = df.select(F.col(target).cast("double").alias("y"), F.col(f).cast("double").alias("x")).where("x is not null and y is not null")
        ranked = average_ranks(average_ranks(pair, "y", "ry"), "x", "rx")
        row = ranked.agg(F.lit(f).alias("feature"), F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")).where("n >= 10")
        out = row if out is None else out.unionByName(row)
    return out


def t_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, from the incomplete beta function."""
    from math import exp, lgamma, log

    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(a, b, x):
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                h *= d * c
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def f1_scores(df: DataFrame, label: str, truth: str, predicted: str) -> DataFrame:
    """``label, tp, fp, fn, f1`` of 0/1 columns in long form; 0 where undefined."""
    t, p = F.col(truth), F.col(predicted)
    c = df.groupBy(label).agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"))
    return c.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def micro_macro(scores: DataFrame, n_cells: Column | None = None) -> DataFrame:
    return scores.agg((2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("micro_f1"), F.avg("f1").alias("macro_f1"), F.sum(F.col("fp") + F.col("fn")).alias("wrong"))


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at average ranks; null for one class."""
    ranked = average_ranks(df, score, "_r")
    pos, neg = F.sum(F.col(truth)), F.sum(1 - F.col(truth))
    return ranked.agg(((F.sum(F.col("_r") * F.col(truth)) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def regression_errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0))).alias("r2"))


def mean_pairwise_cosine(df: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """``group, n, similarity``: mean cosine over the pairs of a group, without forming them.

    For unit vectors the sum over pairs follows from the length of the sum of the vectors.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = df.select(group, F.transform(v, lambda x: x / norm).alias("u"))
    sums = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dims)])
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, dims)), F.col("s0") * F.col("s0"))
    return sums.select(group, "n", ((square - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("similarity"))


def permutation_test(df: DataFrame, group: str, vector: str, rounds: int = 200, seed: int = 0, max_rows: int = 200_000) -> DataFrame:
    """Group coherence against permuted labels: ``group, n, similarity, null_mean, null_sd, z, p``.

    The group sizes stay, the labels are shuffled. The matrix of unit vectors travels to
    the tasks, which share the rounds; it may have at most ``max_rows`` rows.
    """
    spark = df.sparkSession
    if df.count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; sample the groups first")
    rows = df.select(group, vector).orderBy(group, vector).collect()
    labels = np.array([r[0] for r in rows])
    matrix = np.array([r[1] for r in rows], dtype=float)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    names, starts, sizes = np.unique(labels, return_index=True, return_counts=True)
    held = spark.sparkContext.broadcast((matrix, starts, sizes))

    def coherence(m, starts, sizes):
        sums = np.add.reduceat(m, starts, axis=0)
        return np.where(sizes > 1, ((sums * sums).sum(axis=1) - sizes) / np.maximum(sizes * (sizes - 1), 1), np.nan)

    def run(batches):
        m, starts, sizes = held.value
        for pdf in batches:
            out = [coherence(m[np.random.default_rng([seed, int(r)]).permutation(len(m))], starts, sizes) for r in pdf["id"]]
            yield pd.DataFrame([(i, float(x)) for row in out for i, x in enumerate(row)], columns=["i", "value"])

    true = coherence(matrix, starts, sizes)
    found = spark.createDataFrame([(i, names[i].item(), int(sizes[i]), float(true[i])) for i in range(len(names))], f"i int, {group} {df.schema[group].dataType.simpleString()}, n int, similarity double")
    null = spark.range(rounds).mapInPandas(run, "i int, value double")
    joined = null.join(F.broadcast(found), "i")
    out = joined.groupBy(group, "n", "similarity").agg(F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), ((1 + F.count_if(F.col("value") >= F.col("similarity"))) / (rounds + 1)).alias("p"))
    return out.withColumn("z", (F.col("similarity") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)))


#: Chances of at most 0, 1, 2, ... repeats of a row in a Poisson draw of mean one.
POISSON_EDGES = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119])


def repeat_counts(keys: np.ndarray, rounds: int, seed: int = 0) -> np.ndarray:
    """How often each row is drawn in each round, from the hash of its key alone."""
    with np.errstate(over="ignore"):
        mixed = keys.view(np.uint64)[:, None] + (np.arange(rounds, dtype=np.uint64) + np.uint64(seed * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    return np.searchsorted(POISSON_EDGES, (mixed >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")


def bootstrap_lift(df: DataFrame, key: str, period: str, series: str, value: str, rounds: int = 300, seed: int = 0) -> DataFrame:
    """``period, series, lift, lo, hi``: Poisson bootstrap of the lift, 95 % bands.

    Rows are resampled within their period by ``key``: a row is drawn in a round as often as
    the hash of its key and the round says, so all series of one document are drawn together
    and rows of equal value are drawn apart. Tasks add up their part of each round's sums,
    so no period is gathered into one task. The lift is a round's mean against its
    unweighted mean over the periods, 1 where that is 0. Null values count for nothing.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(key)).alias("_k"), F.col(period).alias("p"), F.col(series).alias("s"), F.col(value).cast("double").alias("v"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("p", "s")]

    def sums(batches):
        for pdf in batches:
            n = repeat_counts(pdf["_k"].to_numpy(), rounds, seed)
            group = pdf.groupby(["p", "s"], sort=False).ngroup().to_numpy()
            total, drawn = np.zeros((group.max() + 1, rounds)), np.zeros((group.max() + 1, rounds))
            np.add.at(total, group, n * pdf["v"].to_numpy()[:, None])
            np.add.at(drawn, group, n)
            names = pdf[["p", "s"]].drop_duplicates()
            yield pd.DataFrame({"p": names["p"].to_numpy(), "s": names["s"].to_numpy(), "total": list(total), "drawn": list(drawn)})

    parts = rows.mapInPandas(sums, f"p {kinds[0]}, s {kinds[1]}, total array<double>, drawn array<double>")
    each = parts.select("p", "s", F.posexplode(F.arrays_zip("total", "drawn")).alias("_b", "x")).groupBy("p", "s", "_b").agg((F.sum("x.total") / F.nullif(F.sum("x.drawn"), F.lit(0.0))).alias("m"))
    lifted = each.withColumn("base", F.avg("m").over(Window.partitionBy("s", "_b"))).withColumn("l", F.when(F.col("base") == 0, 1.0).otherwise(F.col("m") / F.col("base")))
    bands = lifted.groupBy("p", "s").agg(F.percentile("l", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    true = lift(df.groupBy(F.col(period).alias("p"), F.col(series).alias("s")).agg(F.avg(value).alias("mean")), "s")
    return true.join(bands, ["p", "s"]).select(F.col("p").alias(period), F.col("s").alias(series), "lift", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def period_profile(df: DataFrame, period: str, series: str, value: str) -> DataFrame:
    """``mean, half, n``: mean share with a 95 % half width, null for a single row."""
    return df.groupBy(period, series).agg(F.avg(value).alias("mean"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half"), F.count(value).alias("n"))


def lift(profile: DataFrame, series: str, share: str = "mean") -> DataFrame:
    """``lift``: the share against the unweighted mean of the periods; 1 where that is 0."""
    base = profile.groupBy(series).agg(F.avg(share).alias("_base"))
    return profile.join(base, series).withColumn("lift", F.when(F.col("_base") == 0, 1.0).otherwise(F.col(share) / F.col("_base"))).drop("_base")


def movers(profile: DataFrame, period: str, series: str, share: str = "mean") -> DataFrame:
    """``delta, gap``: change from the period shown before, and its distance."""
    w = Window.partitionBy(series).orderBy(period)
    return profile.withColumn("delta", F.col(share) - F.lag(share).over(w)).withColumn("gap", F.col(period) - F.lag(period).over(w))


def peak_span(profile: DataFrame, period: str, series: str, share: str = "mean", half: str = "half") -> DataFrame:
    """``peak, first, last``: the peak and the run of periods around it whose bands overlap its band."""
    peak = profile.groupBy(series).agg(F.max_by(F.struct(F.col(period).alias("peak"), (F.col(share) - F.coalesce(half, F.lit(0.0))).alias("floor")), F.struct(F.col(share), -F.col(period))).alias("p")).select(series, "p.*")
    w = Window.partitionBy(series).orderBy(period)
    flagged = profile.join(peak, series).withColumn("_in", F.col(share) + F.coalesce(half, F.lit(0.0)) >= F.col("floor"))
    islands = flagged.withColumn("_isle", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w)).where("_in")
    spans = islands.groupBy(series, "peak", "_isle").agg(F.min(period).alias("first"), F.max(period).alias("last"))
    return spans.where("peak between first and last").select(series, "peak", "first", "last")


def min_max(profile: DataFrame, series: str, share: str = "mean") -> DataFrame:
    """``scaled``: from 0 to 1 within the series; a flat series is divided by 1."""
    w = Window.partitionBy(series)
    lo, hi = F.min(share).over(w), F.max(share).over(w)
    return profile.withColumn("scaled", (F.col(share) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))


def slopes(profile: DataFrame, period: str, series: str, share: str = "mean", last: int = 2000) -> DataFrame:
    """``slope``: least squares change over ten periods' units, up to ``last``."""
    return profile.where(F.col(period) <= last).groupBy(series).agg((F.regr_slope(F.col(share), F.col(period)) * 10).alias("slope"))
