"""Helpers of several operators: written tables, Arrow batches of bounded size, ragged arrays."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from returnlens.session import shared_dir

# Every white-space character beyond the plain space, for patterns of RE2.
OTHER_SPACES = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table below the shared folder, which cuts their lineage and survives lost executors.

    The folder belongs to the caller of the job, who clears it when the results are no longer needed.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ship_package(spark: SparkSession, root: str) -> None:
    """Let Python workers import this package from ``root`` where it is not installed."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    # Only glibc has it, and needs to be told.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The task, which gives freed memory back at its end: Spark keeps idle workers, several for each core."""

    @functools.wraps(task)
    def run(*args) -> Iterator:
        yield from task(*args)
        release()

    return run


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def texts_of(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts with 64-bit offsets, '' for NULL."""
    return pc.fill_null(plain(array).cast(pa.large_string()), "")


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes of text; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield start, stop
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most_bytes`` of text, whatever sizes they arrive in."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        texts = texts_of(batch.column(column))
        for start, stop in slices(texts, most_bytes):
            for low in range(start, stop, most_rows):
                piece = batch.slice(low, min(most_rows, stop - low))
                n = pc.sum(pc.binary_length(texts.slice(low, piece.num_rows))).as_py()
                if held and (size + n > most_bytes or rows + piece.num_rows > most_rows):
                    yield joined()
                    held, size, rows = [], 0, 0
                held.append(piece)
                size, rows = size + n, rows + piece.num_rows
    if held:
        yield joined()


def split_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at each plain space: a code per part, the row bounds, and the distinct parts."""
    codes, bounds, parts = split_parts(texts)
    return codes, bounds, parts.to_pylist()


def split_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``split_codes`` with the distinct parts as an array."""
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), bounds - bounds[0], coded.dictionary


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with 64-bit offsets and no NULL, one text after the other, and the bounds of the texts."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Runs:
    """Growing pool of integer runs, addressed by number."""

    def __init__(self, dtype=np.int32):
        self.pool, self.bounds, self.used, self.count = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.pool):
            self.pool = np.resize(self.pool, max(need, 2 * len(self.pool)))
        self.pool[self.used : need] = values
        ends = self.used + np.cumsum(lengths)
        more = self.count + len(lengths) + 1
        if more > len(self.bounds):
            self.bounds = np.resize(self.bounds, max(more, 2 * len(self.bounds)))
        self.bounds[self.count + 1 : more] = ends
        self.used, self.count = need, more - 1

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen runs, one after the other, and their lengths."""
        starts = self.bounds[numbers]
        lengths = self.bounds[numbers + 1] - starts
        return self.pool[ragged(starts, lengths)], lengths


def grouped_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of a sorted partition; a group must fit in memory."""
    for table, cuts in whole_groups(batches, keys):
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield table.slice(low, high - low)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of a sorted partition, some whole groups at a time, with the bounds of these groups."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None or not held.num_rows else pa.concat_tables([held, table]).combine_chunks()
        changes = np.zeros(max(0, held.num_rows - 1), bool)
        for key in keys:
            column = plain(held[key])
            changed = pc.not_equal(column.slice(1), column.slice(0, max(0, len(column) - 1)))
            changes |= changed.to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.flatnonzero(changes) + 1)
        if len(cuts) > 1:
            yield held.slice(0, int(cuts[-1])), cuts
        held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused_prefix(columns: list[str]) -> str:
    """Underscores that none of the columns begins with, so that no name made from them is one of theirs."""
    longest = max((len(c) - len(c.lstrip("_")) for c in columns), default=0)
    return "_" * (longest + 1)
