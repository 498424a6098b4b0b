"""Occurrences and record counts of every distinct term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import letter_runs
from ..runtime import cut

#: Pairs of a term and a record that a task sorts at once.
RUN_PAIRS = 2_000_000


def distinct_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row ``(id, text)`` for each distinct non-null id; the greatest text where they differ."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").groupBy("id").agg(F.max("text").alias("text"))


def run_lengths(terms: list[str], records: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sort pairs of a term and a record and scan the runs: terms, occurrences, records."""
    coded = pa.array(terms, pa.string()).dictionary_encode()
    words = coded.dictionary
    pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | records
    pairs.sort()
    term = pairs >> 32
    new_term = np.flatnonzero(np.diff(term, prepend=-1))
    new_pair = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    occurrences = np.diff(np.append(new_term, len(pairs)))
    return words.take(pa.array(term[new_term])), occurrences, np.add.reduceat(new_pair.astype(np.int64), new_term)


def term_frequencies(
    records: DataFrame,
    rare_records: int = 2,
    common_share: float = 0.25,
    run_pairs: int = RUN_PAIRS,
) -> DataFrame:
    r"""``term, occurrences, records, mark`` over ``(id, text)`` rows, one row a record.

    A term is a maximal run of letters in lower case. Each task sorts its pairs of a term
    and a record in runs of bounded size and scans them, so a term in every record leaves a
    task as one row a run; these partial runs are partitioned by ranges of terms, sorted
    externally and scanned again. ``mark`` is ``rare`` up to ``rare_records`` records,
    ``common`` above ``common_share`` of the records that have any term, else null; a term
    that is both is rare. Null and empty texts have no term. An empty input gives no row.
    """
    texts = records.select("text").where(F.length("text") > 0)

    def scan(batches):
        terms: list[str] = []
        lengths: list[int] = []
        seen = 0

        def flush():
            ids = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            words, occurrences, holders = run_lengths(terms, ids)
            return pa.RecordBatch.from_arrays([words, pa.array(occurrences), pa.array(holders)], names=["term", "occurrences", "records"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = letter_runs(text)
                if found:
                    terms += found
                    lengths.append(len(found))
                    seen += 1
                if len(terms) >= run_pairs:
                    yield flush()
                    terms, lengths = [], []
        if terms:
            yield flush()
        # the row without a term counts the records that have any
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([seen])], names=["term", "occurrences", "records"])

    runs = cut(texts.mapInArrow(scan, "term string, occurrences bigint, records bigint"))
    total = runs.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"))

    def merge(batches):
        word, occurrences, holders = None, 0, 0
        for batch in batches:
            out = []
            for t, o, r in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if t != word:
                    if word is not None:
                        out.append((word, occurrences, holders))
                    word, occurrences, holders = t, 0, 0
                occurrences += o
                holders += r
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["term", "occurrences", "records"])
        if word is not None:
            yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([occurrences]), pa.array([holders])], names=["term", "occurrences", "records"])

    merged = runs.where("term is not null").repartitionByRange("term").sortWithinPartitions("term").mapInArrow(merge, "term string, occurrences bigint, records bigint")
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("total"), "common")
    return merged.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
