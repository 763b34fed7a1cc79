"""Frequency of every distinct term: how often, in how many records, and whether too rare or too common to be useful.

An external sort in ranges of (group, term, record): rows that belong together lie next to each other in one range, a
run-length scan over the sorted rows counts occurrences and distinct records, and rows delivered twice, adjacent too,
count once. The range keys include the record, so a term that holds a third of all rows spreads over many ranges; the
runs of one term in several ranges or Arrow batches meet as partial counts, of which there are few. All rows of one
(group, term, record) lie in one range.

Defined results: null groups and null terms are left out; terms are stripped of white space and lower-cased, an empty
term counts as a term; null records count as no record; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notaflux.functions.folding import strip_space


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, t, n, m) of each run of a term in sorted rows (g, t, r, i): distinct rows, distinct records that are not null."""
    last: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.concat_batches([last, b]) if last else b
        size = rows.num_rows
        changed = np.zeros(size, bool)
        changed[0] = last is None
        begun = []
        for c in rows.columns:  # a row begins what any column up to here begins
            codes = np.asarray(c.dictionary_encode("encode").indices)
            changed = changed.copy()
            changed[1:] |= codes[1:] != codes[:-1]
            begun.append(changed)
        _, of_term, of_record, of_row = (x[size - b.num_rows :] for x in begun)
        known = np.asarray(b.column(2).is_valid())
        heads = np.unique(np.concatenate([[0], np.nonzero(of_term)[0]]))
        n, m = np.add.reduceat(of_row.astype(np.int64), heads), np.add.reduceat((of_record & known).astype(np.int64), heads)
        of_head = b.take(pa.array(heads))
        yield pa.RecordBatch.from_arrays([of_head.column(0), of_head.column(1), pa.array(n), pa.array(m)], names=["g", "t", "n", "m"])
        last = b.slice(b.num_rows - 1)


def term_counts(rows: DataFrame, group: str, term: str, record: str, row_id: str) -> DataFrame:
    """(group, term, occurrences, records) of each distinct term of each group; all rows of all terms are counted."""
    terms = rows.where(F.col(group).isNotNull() & F.col(term).isNotNull()).select(
        F.col(group).alias("g"), F.lower(strip_space(F.col(term))).alias("t"), F.col(record).alias("r"), F.col(row_id).alias("i"))
    ordered = terms.repartitionByRange("g", "t", "r").sortWithinPartitions("g", "t", "r", "i")
    runs = ordered.mapInArrow(_runs, f"g {ordered.schema['g'].dataType.simpleString()}, t string, n bigint, m bigint")
    return runs.groupBy("g", "t").agg(F.sum("n").alias("occurrences"), F.sum("m").alias("records")).select(
        F.col("g").alias(group), F.col("t").alias("term"), "occurrences", "records")


def marked(counts: DataFrame, rows: DataFrame, record: str, rare: int = 2, common: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: rare (in at most ``rare`` records), common (in more than the share ``common`` of all), else null."""
    total = rows.agg(F.count_distinct(record).alias("__all"))  # one row
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.col("__all") * common, "common")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("__all")
