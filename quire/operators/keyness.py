"""Words that separate two registers of the same items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the removal list and of its tiers.
MIN_COUNT, MIN_G2, MIN_LOG_RATIO, MIN_DOC_SHARE, MIN_CONSISTENCY = 20, 15.13, 0.585, 0.005, 0.85
PHI_REGISTER, PHI_BORDERLINE, MIN_PAIRS = 0.05, 0.12, 30


def keyness(tokens: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """G2, log ratio, rates and document shares of each word on sides ``a`` and ``b``.

    ``tokens`` has rows ``doc, side, word``. The two totals are aggregates of one row that
    join every word; everything else is one aggregation by word.
    """
    side = lambda s: F.col("side") == s
    counts = tokens.groupBy("word", "doc", "side").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(side(s), F.col("n"))), F.lit(0)).alias(f"tokens_{s}") for s in "ab"],
        *[F.count(F.when(side(s), 1)).alias(f"docs_{s}") for s in "ab"],
    ).where(F.col("tokens_a") + F.col("tokens_b") >= min_count)
    totals = tokens.groupBy("doc", "side").agg(F.count(F.lit(1)).alias("n")).agg(
        *[F.sum(F.when(side(s), F.col("n"))).alias(f"total_{s}") for s in "ab"], *[F.count(F.when(side(s), 1)).alias(f"all_docs_{s}") for s in "ab"]
    )
    both = counts.crossJoin(F.broadcast(totals))
    a, b, ta, tb = (F.col(c).cast("double") for c in ("tokens_a", "tokens_b", "total_a", "total_b"))
    ea, eb = ta * (a + b) / (ta + tb), tb * (a + b) / (ta + tb)
    part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)
    return both.select(
        "word", "tokens_a", "tokens_b",
        (2 * (part(a, ea) + part(b, eb))).alias("g2"),
        F.log2(((a + 0.5) / ta) / ((b + 0.5) / tb)).alias("log_ratio"),
        (a / ta * 1e4).alias("per_10k_a"), (b / tb * 1e4).alias("per_10k_b"),
        (F.col("docs_a") / F.col("all_docs_a")).alias("doc_share_a"), (F.col("docs_b") / F.col("all_docs_b")).alias("doc_share_b"),
    )


def consistency(tokens: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Share of the periods (with enough documents) in which a word is more frequent on side a."""
    periods = tokens.groupBy("period", "doc", "side").agg(F.count(F.lit(1)).alias("n")).groupBy("period").agg(
        F.sum(F.when(F.col("side") == "a", F.col("n"))).alias("ta"), F.sum(F.when(F.col("side") == "b", F.col("n"))).alias("tb"), F.countDistinct("doc").alias("pairs")
    ).where(F.col("pairs") >= min_pairs)
    each = tokens.groupBy("period", "word").agg(F.count(F.when(F.col("side") == "a", 1)).alias("a"), F.count(F.when(F.col("side") == "b", 1)).alias("b"))
    return each.join(periods, "period").groupBy("word").agg(F.avg((F.col("a") / F.col("ta") > F.col("b") / F.col("tb")).cast("double")).alias("consistency"))


def phi_association(tokens: DataFrame) -> DataFrame:
    """Phi of a word's presence on the two sides of the same documents, from a 2x2 table."""
    present = tokens.groupBy("word", "doc").agg(F.max((F.col("side") == "a").cast("int")).alias("a"), F.max((F.col("side") == "b").cast("int")).alias("b"))
    table = present.groupBy("word").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    docs = tokens.select("doc").distinct().agg(F.count(F.lit(1)).alias("n"))
    n, both, na, nb = (F.col(c).cast("double") for c in ("n", "both", "na", "nb"))
    phi = (both * n - na * nb) / F.nullif(F.sqrt(na * nb * (n - na) * (n - nb)), F.lit(0.0))
    return table.crossJoin(F.broadcast(docs)).select("word", F.coalesce(phi, F.lit(0.0)).alias("phi"), "both", (F.col("na") - F.col("both")).alias("a_only"), (F.col("nb") - F.col("both")).alias("b_only"))


def register_weights(tokens: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Word weights: the log ratio, damped by the association where it is positive."""
    joined = keyness(tokens, min_count).where(F.col("g2") >= MIN_G2).join(phi_association(tokens), "word")
    damped = F.when(F.col("log_ratio") > 0, F.col("log_ratio") * F.greatest(F.lit(0.0), 1 - F.greatest(F.col("phi"), F.lit(0.0)) / PHI_BORDERLINE)).otherwise(F.col("log_ratio"))
    return joined.select("word", damped.alias("weight"), "phi", "log_ratio", "g2").where("weight <> 0")


def phi_tier(phi) -> Column:
    return F.when(phi < PHI_REGISTER, "register").when(phi < PHI_BORDERLINE, "borderline").otherwise("content")
