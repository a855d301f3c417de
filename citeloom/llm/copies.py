"""Duplicates hidden by formatting differences (problem 4).

Rows are reduced to a canonical record, range-partitioned and sorted by (canonical record, row id), and adjacent
rows with equal full keys form a run. Since the row id is part of the range, a hot group of any size is spread over
many partitions; runs that cross a partition's edge are stitched with two rows per partition. Neither that nor the
counts depend on exchanges being reused.

Nulls and blanks in a key field are equal to each other and to nothing else; a row without an id or key is left out; an
empty table gives no rows. Repeated ids form one row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage, shuffle_parts

_NOT_ALNUM = r"[^\p{L}\p{N}]+"


def letters_and_digits(text: Column) -> Column:
    """``text`` in lower case without white space, punctuation and symbols; '' for null."""
    return F.coalesce(F.regexp_replace(F.lower(text), _NOT_ALNUM, ""), F.lit(""))


def bare_identifier(text: Column) -> Column:
    """An identifier without brackets, resolver address and the prefixes DOI or PMID; '' for null."""
    v = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+", "")
    v = F.regexp_replace(v, r"^https?://[^/]*/", "")
    return F.regexp_replace(v, r"^(?:doi|pmid)[^\p{L}\p{N}]*", "")


def reference_key(doi: Column, title: Column, pmid: Column) -> Column:
    """The canonical record of a reference as one string.

    A DOI in the PMID's column and the reverse are put right first."""
    d, p = bare_identifier(doi), bare_identifier(pmid)
    is_doi = lambda v: v.rlike(r"^10\.\d{3,9}\s*/")
    x, y = letters_and_digits(d), letters_and_digits(p)
    digits = lambda v: v.rlike(r"^\d+$")
    swapped = (is_doi(p) & ~is_doi(d)) | (digits(x) & ~is_doi(d) & ~digits(y))
    own = F.when(swapped, F.concat_ws("|", y, x)).otherwise(F.concat_ws("|", x, y))
    return F.concat_ws("|", own, letters_and_digits(title))


class _Runs:
    """Cuts sorted batches of one partition into runs of equal keys, across the batches."""

    def __init__(self) -> None:
        self.number, self.first, self.key = 0, 0, None

    def cut(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of each row's run from 1, first id of each row's run)."""
        keys, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        new[0] = not self.number or keys[0].as_py() != self.key
        starts = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
        firsts = np.where(starts < 0, self.first, ids[np.maximum(starts, 0)])
        number = self.number + np.cumsum(new)
        self.number, self.first, self.key = int(number[-1]), int(firsts[-1]), keys[-1].as_py()
        return ids, number, firsts


def _rows(*columns: object) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["first_id", "n", "part", "edge_key"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id (n) with the first id of its run; rows of the partition's first run also carry the partition's number.

    Two further rows without n hold the keys of the partition's first and last run with their first ids."""
    part, runs, head = TaskContext.get().partitionId(), _Runs(), None
    for b in batches:
        if not b.num_rows:
            continue
        if head is None:
            head = b.column(0)[0].as_py()
            yield _rows([b.column(1)[0].as_py()], [None], [part], [head])
        ids, number, firsts = runs.cut(b)
        open_run = number == 1
        yield _rows(firsts, ids, pa.array(np.full(len(ids), part, np.int32), mask=~open_run), pa.nulls(len(ids), pa.string()))
    if runs.number > 1:
        yield _rows([runs.first], [None], [None], [runs.key])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run with its number of rows (n); the partition's first and last run also carry their key."""
    runs, held = _Runs(), None  # the run that may go on: first id, rows, key
    for b in batches:
        if not b.num_rows:
            continue
        _, number, firsts = runs.cut(b)
        numbers, at, n = np.unique(number, return_index=True, return_counts=True)
        if held and held[0] == numbers[0]:
            n[0] += held[2]
        elif held:
            yield _rows([held[1]], [held[2]], [None], [held[3] if held[0] == 1 else None])
        first_key = b.column(0)[0].as_py()
        done = len(numbers) - 1
        if done:
            yield _rows(firsts[at[:done]], n[:done], [None] * done, [first_key if k == 1 else None for k in numbers[:done].tolist()])
        held = (int(numbers[-1]), int(firsts[at[-1]]), int(n[-1]), runs.key)
    if held:
        yield _rows([held[1]], [held[2]], [None], [held[3]])


_RUNS = "first_id bigint, n bigint, part int, edge_key string"


def _ranged(keyed: DataFrame) -> DataFrame:
    rows = keyed.select("key", F.col("id").cast("bigint").alias("id")).where("id is not null and key is not null")
    return rows.repartitionByRange(shuffle_parts(keyed.sparkSession), "key", "id").sortWithinPartitions("key", "id")


def group_copies(keyed: DataFrame) -> DataFrame:
    """From (id, key) rows to (first_id, id): the smallest id among the rows with an equal key, for every row.

    Full keys are compared, never hashes. The partitions are scanned once and the scan is kept, as a second one could
    draw other ranges. What is broadcast is one number per partition."""
    scanned = cut_lineage(_ranged(keyed).mapInArrow(_scan, _RUNS))
    edges = scanned.where("n is null")
    least = edges.groupBy("edge_key").agg(F.min("first_id").alias("edge_first"))
    stitch = edges.where("part is not null").join(least, "edge_key").select("part", "edge_first")
    stitched = scanned.where("n is not null").join(F.broadcast(stitch), "part", "left")
    return stitched.select(F.coalesce("edge_first", "first_id").alias("first_id"), F.col("n").alias("id"))


def collapse(keyed: DataFrame) -> DataFrame:
    """One row per canonical record: (first_id, copies), copies being the exact number of its rows.

    Runs are counted in the scan; only runs at the edges of partitions meet once more."""
    counted = cut_lineage(_ranged(keyed).mapInArrow(_count, _RUNS))
    inner = counted.where("edge_key is null").select("first_id", F.col("n").alias("copies"))
    edges = counted.where("edge_key is not null").groupBy("edge_key").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("copies"))
    return inner.unionByName(edges.select("first_id", "copies"))


def library_groups(library: DataFrame) -> DataFrame:
    """(first_row_id, row_id) for every row of the reference library."""
    keyed = library.select(F.col("row_id").alias("id"), reference_key(F.col("doi"), F.col("title"), F.col("pmid")).alias("key"))
    return group_copies(keyed).select(F.col("first_id").alias("first_row_id"), F.col("id").alias("row_id"))
