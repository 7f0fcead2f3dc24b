"""Packing rows into pieces: files of so many bytes, statements of so many bytes or rows.

Packing is greedy in one total order: a row begins a new piece if it would pass the limit of
bytes or of rows; a row that is too long by itself is a piece of its own. The result is that of
one pass over all rows, yet no task sees more than a range of them. Within a range the first new
piece depends on how full the last one was left; whatever row that is, all later beginnings
follow from it alone. So a range is first summed up: for each row that may come first (those
within one piece's limit), how many pieces follow and how full the last is left. One stream over
these sums, a row per range, says how full a piece each range meets, and then all ranges are
packed at once.

Null columns are empty. Rows that are equal in the order are placed in any order; give a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.storage import written

#: A file's bytes and what a row adds to its columns' bytes; a statement's bytes and rows.
FILE_BYTES, ROW_BYTES = 400_000, 40
STATEMENT_BYTES, STATEMENT_ROWS, LITERAL_BYTES = 80_000, 200, 4
_NO_LIMIT = 1 << 62
_SUMS = "range long, cum array<long>, follow array<long>, bytes array<long>, rows array<long>, total long, n long"


def _first_after(cum: np.ndarray, bytes_: int, rows: int, max_bytes: int, max_rows: int) -> int:
    """The first row that doesn't fit behind a piece left with so many bytes and rows; len(cum) if all do."""
    return min(int(np.searchsorted(cum, max_bytes - bytes_, "right")), max(max_rows - rows, 0), len(cum))


def range_sums(sizes: np.ndarray, max_bytes: int, max_rows: int) -> tuple[np.ndarray, ...]:
    """For each row that may begin the range's first new piece: running bytes, pieces that follow it, and the last one's bytes and rows."""
    n, cum = len(sizes), np.cumsum(sizes)
    later = np.minimum(np.maximum(np.searchsorted(cum, max_bytes + cum - sizes, "right"), np.arange(n) + 1), np.minimum(np.arange(n) + max_rows, n)).tolist()
    follow, last = [0] * n, list(range(n))
    for i in range(n - 1, -1, -1):
        if (k := later[i]) < n:
            follow[i], last[i] = follow[k] + 1, last[k]
    first = min(_first_after(cum, 0, 0, max_bytes, max_rows), n - 1) + 1
    last_ = np.array(last[:first])
    return cum[:first], np.array(follow[:first]), cum[-1] - cum[last_] + sizes[last_], n - last_


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as one table per range."""
    held: list[pa.Table] = []
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        for part in np.split(np.arange(len(ranges)), np.flatnonzero(np.diff(ranges)) + 1):
            if held and held[0].column("range")[0].as_py() != ranges[part[0]]:
                yield pa.concat_tables(held)
                held = []
            held.append(pa.table(batch.slice(part[0], len(part))))
    if held:
        yield pa.concat_tables(held)


def _summed(max_bytes: int, max_rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_ranges(b for b in batches if b.num_rows):
            sizes = table.column("size").to_numpy()
            parts = range_sums(sizes, max_bytes, max_rows)
            yield pa.RecordBatch.from_pydict({"range": [table.column("range")[0].as_py()], **{c: pa.array([p.tolist()], pa.list_(pa.int64())) for c, p in zip(("cum", "follow", "bytes", "rows"), parts)}, "total": [int(sizes.sum())], "n": [len(sizes)]})

    return task


def _chained(max_bytes: int, max_rows: int):
    """The sums of all ranges, in order, as what each meets: the open piece's number, bytes and rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, bytes_, rows = -1, max_bytes, max_rows
        for batch in batches:
            for s in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                yield pa.RecordBatch.from_pydict({"range": [s["range"]], "open": [piece], "bytes": [bytes_], "rows": [rows]})
                k = _first_after(np.array(s["cum"]), bytes_, rows, max_bytes, max_rows)
                if k < len(s["cum"]):
                    piece, bytes_, rows = piece + 1 + s["follow"][k], s["bytes"][k], s["rows"][k]
                else:
                    bytes_, rows = bytes_ + s["total"], rows + s["n"]

    return task


def _packed(max_bytes: int, max_rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, bytes_, rows = None, 0, 0, 0
        for batch in batches:
            out = []
            for range_, size, *entry in zip(*(batch.column(c).to_pylist() for c in ("range", "size", "open", "bytes", "rows"))):
                if range_ != at:
                    at, (piece, bytes_, rows) = range_, entry
                if bytes_ + size > max_bytes or rows >= max_rows:
                    piece, bytes_, rows = piece + 1, 0, 0
                bytes_, rows = bytes_ + size, rows + 1
                out.append(piece)
            yield batch.select(batch.schema.names[:-6]).append_column("piece", pa.array(out, pa.int64()))

    return task


def pieces(df: DataFrame, columns: list[str], order: list[str], max_bytes: int = FILE_BYTES, max_rows: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """df with `piece`, from 0: the rows in order, packed greedily by the bytes of the columns and row_bytes (1 at least) a row."""
    if row_bytes < 1:
        raise ValueError("a row must count for one byte at least")
    most = max_rows or _NO_LIMIT
    size = F.lit(row_bytes).cast("long")
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select(*df.columns, F.spark_partition_id().cast("long").alias("range"), F.monotonically_increasing_id().alias("place"), size.alias("size")), "ranges")
    sums = rows.select("range", "place", "size").repartition("range").sortWithinPartitions("range", "place").mapInArrow(_summed(max_bytes, most), _SUMS)
    met = written(sums.repartition(1).sortWithinPartitions("range").mapInArrow(_chained(max_bytes, most), "range long, open long, bytes long, rows long"), "fill")
    schema = StructType([*df.schema.fields, StructField("piece", LongType())])
    together = rows.repartition("range").join(F.broadcast(met), "range")  # a row per range of the order
    sorted_ = together.select(*df.columns, "range", "place", "size", "open", "bytes", "rows").sortWithinPartitions("range", "place")
    return sorted_.mapInArrow(_packed(max_bytes, most), schema)


def statements(df: DataFrame, literal: str, order: list[str]) -> DataFrame:
    """Rows in batches that one statement inserts: at most STATEMENT_BYTES of literals or STATEMENT_ROWS rows."""
    return pieces(df, [literal], order, STATEMENT_BYTES, STATEMENT_ROWS, LITERAL_BYTES)
