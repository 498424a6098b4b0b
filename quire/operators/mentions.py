"""Mentions of known names in texts and the graph of names mentioned together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T

MAX_NAME_TOKENS = 4


def name_dictionary(lists: DataFrame, names_col: str) -> DataFrame:
    """``key, display, n``: names of two to four tokens by key, with the commonest spelling.

    Ties go to the smallest spelling. Organisations and public figures are left out.
    """
    each = lists.select(F.explode(T.author_list(F.col(names_col))).alias("name")).where(~N.is_excluded(F.col("name")))
    keyed = each.select(T.collapse(F.col("name")).alias("display"), T.name_tokens(F.col("name")).alias("tokens")).where(F.size("tokens").between(2, MAX_NAME_TOKENS))
    counts = keyed.groupBy(F.array_join("tokens", " ").alias("key"), "display").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("key").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    spelled = counts.join(top.select("key", "most"), "key").where("n = most").groupBy("key").agg(F.min("display").alias("display"))
    return spelled.join(top.select("key", "n"), "key")


def name_candidates(texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """``id, run, pos, size, key`` of every window of a capitalised run that is a known name."""
    runs = texts.select(id_col, F.posexplode(N.capital_runs(F.col(text_col))).alias("run", "words")).withColumn("tokens", T.name_tokens(F.col("words"))).where(F.size("tokens") >= 2)
    starts = runs.select(id_col, "run", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("pos"))
    sizes = F.sequence(F.lit(2), F.least(F.lit(MAX_NAME_TOKENS), F.size("tokens") - F.col("pos") + 1))
    windows = starts.select(id_col, "run", "tokens", "pos", F.explode(sizes).alias("size"))
    keyed = windows.select(id_col, "run", "pos", "size", F.array_join(F.slice("tokens", F.col("pos"), F.col("size")), " ").alias("key"))
    return keyed.join(dictionary.select("key"), "key").select(id_col, "run", "pos", "size", "key")


def find_mentions(texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """``id, key`` of the names a text mentions: longest first, left to right, no overlap."""
    found = name_candidates(texts, id_col, text_col, dictionary)
    per_run = found.groupBy(id_col, "run").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("size")).alias("neg"), "key"))).alias("c"))

    @F.pandas_udf("array<string>")
    def greedy(column: pd.Series) -> pd.Series:
        def walk(candidates):
            out, free = [], 0
            for c in candidates:
                if c["pos"] >= free:
                    out.append(c["key"])
                    free = c["pos"] - c["neg"]
            return out

        return column.map(walk)

    return per_run.select(id_col, F.explode(greedy("c")).alias("key")).distinct()


def drop_self_mentions(mentions: DataFrame, own: DataFrame, id_col: str) -> DataFrame:
    """Mentions that are not the text's own author.

    ``own`` has ``id, key``. An equal key is the author; a mention in initials also is when
    surname and initials agree.
    """
    tokens = F.split("key", " ")
    m = mentions.join(own.select(id_col, "key").distinct(), [id_col, "key"], "left_anti").withColumn("sig", T.signature(tokens)).withColumn("spelled", T.is_spelled(tokens))
    signatures = own.select(id_col, T.signature(tokens).alias("sig"), F.lit(False).alias("spelled")).where("sig is not null").distinct()
    return m.join(signatures, [id_col, "sig", "spelled"], "left_anti").select(id_col, "key")


def merge_initials(keys: DataFrame) -> DataFrame:
    """``key, canonical``: forms in initials joined to the one spelled form of their signature."""
    tokens = F.split("key", " ")
    k = keys.select("key").distinct().select("key", T.signature(tokens).alias("sig"), T.is_spelled(tokens).alias("spelled"))
    base = k.where("sig is not null").groupBy("sig").agg(F.count_if("spelled").alias("n"), F.min(F.when(F.col("spelled"), F.col("key"))).alias("base")).where("n = 1").select("sig", "base")
    alias = F.create_map(*[F.lit(x) for kv in N.ALIASES.items() for x in kv])
    return k.join(base, "sig", "left").select("key", F.coalesce(F.try_element_at(alias, F.col("key")), F.col("base"), F.col("key")).alias("canonical"))


def comention_edges(mentions: DataFrame, id_col: str, key_col: str = "key", min_weight: int = 1) -> DataFrame:
    """``a, b, weight`` with ``a < b``: in how many texts two names stand together.

    The pairs are those wanted: distinct names of one text, each pair once.
    """
    one = mentions.select(id_col, key_col).distinct()
    left, right = one.select(id_col, F.col(key_col).alias("a")), one.select(id_col, F.col(key_col).alias("b"))
    return left.join(right, id_col).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
