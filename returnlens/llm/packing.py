"""Packing token runs into sequences of fixed length: bounded-space online best-fit.

Every partition is packed by itself, so nothing is shuffled: it hands its pieces, longest first, to ``OpenBins``,
which keeps a bounded number of bins open. The free spaces that occur among them are the bits of one integer; the
lowest bit at or above a piece's length is the tightest bin. A full bin is closed, and when too many are open the
fullest closes first. A partition wastes at most the space of its last few bins.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from returnlens.llm.bpe import SEPARATOR, WordRuns
from returnlens.llm.shared import Runs, bytes_of, released, slices, split_parts, texts_of

CAPACITY = 4096
OPEN_BINS = 32_768
END_ID = 1
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 3 << 20
PARTS_BYTES, WORDS_BYTES = 4 << 20, 1 << 20
PARTS_AT_ONCE, WORDS_KEPT = 150_000, 400_000
#: Fixed value: how the vocabulary's pre-tokenizer cuts texts, white space between the matches dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts that bytes alone cut by the pattern: no apostrophe, and nothing beyond ASCII that versions of Unicode tell apart.
PLAIN = r"\A[\t\n\r -&(-~]*\z"
SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.array(
    [SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER for c in map(chr, range(128))],
    np.uint8,
)


class OpenBins:
    """At most ``most`` open bins; ``place`` gives a run's bin number and offset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit s: some open bin has s free places
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        self.open -= 1
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return number


def normal(text: str) -> str:
    """NFC in lower case, character by character: only for a sigma does Python look at the neighbours."""
    if text.isascii():
        return text.lower()
    return "σ".join(part.lower() for part in unicodedata.normalize("NFC", text).split("Σ"))


class ChunkRuns:
    """Ids of the distinct parts of a chunk. Pre-tokens are kept up to a number and looked up as arrays of texts."""

    def __init__(self, path: str):
        self.runs = WordRuns(path, PATTERN, normal)
        self.names = "|".join(map(regex.escape, self.runs.special))
        self.kept, self.kept_runs = pa.array([], pa.large_string()), Runs()

    def of(self, parts: pa.Array) -> tuple[Runs, np.ndarray]:
        """The runs of the parts, and which of them is each part's."""
        found, order = Runs(), [np.zeros(0, np.int64)]
        for low, high in slices(parts, PARTS_BYTES):
            some = parts.slice(low, high - low)
            easy = _matched(some, PLAIN)
            if self.names:
                easy &= ~_matched(some, self.names)
            alone = ~easy & _matched(some, self.runs.alone)
            joined = ~easy & ~alone
            self._extend(found, [cut_plain(some.filter(pa.array(easy))), self._cut(some.filter(pa.array(joined)))])
            _extend_alone(found, self.runs, some.filter(pa.array(alone)).to_pylist())
            order += [low + np.flatnonzero(group) for group in (easy, joined, alone)]
        place = np.empty(len(parts), np.int64)
        place[np.concatenate(order)] = np.arange(len(parts))
        return found, place

    def _cut(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pre-tokens of parts that the separator does not touch, and their number in each part."""
        tokens = pa.array(self.runs.find(self.runs.normal(SEPARATOR.join(parts.to_pylist()))), pa.large_string())
        ends = pc.equal(tokens, SEPARATOR).to_numpy(zero_copy_only=False)
        return tokens.filter(pa.array(~ends)), np.bincount(np.cumsum(ends)[~ends], minlength=len(parts))

    def _extend(self, found: Runs, cut: list[tuple[pa.Array, np.ndarray]]) -> None:
        numbers = self._numbers(pa.concat_arrays([words for words, _ in cut]))
        values, sizes = self.kept_runs.take(numbers)
        counts = np.concatenate([counts for _, counts in cut])
        found.extend(values, np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each pre-token among the kept ones, new ones encoded on the way."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, value_set=self.kept)
        if len(self.kept) + known.null_count > WORDS_KEPT:
            self.kept, self.kept_runs = distinct.slice(0, 0), Runs()
            known = pc.index_in(distinct, value_set=self.kept)
        new = known.is_null()
        fresh = distinct.filter(new)
        for low, high in slices(fresh, WORDS_BYTES):
            raw, bounds = bytes_of(fresh.slice(low, high - low))
            self.kept_runs.extend(*self.runs.merges.encode_bytes(raw, np.diff(bounds)))
        numbers = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers[new.to_numpy(zero_copy_only=False)] = len(self.kept) + np.arange(len(fresh))
        self.kept = pa.concat_arrays([self.kept, fresh])
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]


def _matched(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def cut_plain(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of parts that ``PLAIN`` matches, one part after the other, and their number in each part.

    They begin where the kind of character changes, at each digit and where a part begins.
    """
    raw, bounds = bytes_of(pc.ascii_lower(parts))
    kinds = KINDS[raw]
    begins = kinds == DIGIT
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    begins &= kinds != SPACE
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), bounds))
    shown = kinds != SPACE
    raw = raw[shown]
    starts = np.append(np.flatnonzero(begins[shown]), len(raw))
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)), counts


def _extend_alone(found: Runs, runs: WordRuns, parts: list[str]) -> None:
    """The ids of parts that are cut one by one. Of what was encoded only the pre-tokens are kept."""
    for low in range(0, len(parts), PARTS_AT_ONCE):
        if len(runs.words) > WORDS_KEPT // 2:
            runs.words, runs.word_runs = {}, Runs()
        found.extend(*runs.part_runs.take(runs.numbers(parts[low : low + PARTS_AT_ONCE])))
        runs.parts, runs.part_runs = {}, Runs()


@functools.cache
def _word_level(path: str) -> ChunkRuns:
    return ChunkRuns(path)


def token_pieces(
    frame: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token runs of at most ``capacity`` ids: key, piece, start, length and the ids as little-endian 32-bit numbers.

    A text's ids are those of the tokenizers library without added special tokens, then the end id; NULL and empty
    texts have the end id alone. Only longer runs are cut, into pieces of full length and a rest.
    Repeated rows and NULL keys give pieces of their own; other columns are not read.
    """
    docs = frame.select(frame[key].alias("key"), frame[text].cast("string").alias("text"))
    out = StructType(
        [
            StructField("key", docs.schema["key"].dataType),
            *StructType.fromDDL("piece int, start long, length long, ids binary").fields,
        ]
    )
    return docs.mapInArrow(functools.partial(_pieces, path, capacity), out).withColumnRenamed("key", key)


@released
def _pieces(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _word_level(path)
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for start, stop in slices(texts, CHUNK_BYTES):
            yield from _chunk_pieces(runs, capacity, batch.column("key").slice(start, stop - start), texts.slice(start, stop - start))


def _chunk_pieces(runs: ChunkRuns, capacity: int, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Each distinct part of a chunk is encoded once; the ids are put together for a slice of texts at a time."""
    # White space separates pre-tokens and is dropped, so texts can be cut at any space.
    chunk_codes, chunk_bounds, parts = split_parts(texts)
    known, place = runs.of(parts)
    for low, high in slices(texts, SLICE_BYTES):
        codes = chunk_codes[chunk_bounds[low] : chunk_bounds[high]]
        bounds = chunk_bounds[low : high + 1] - chunk_bounds[low]
        ids, lengths = known.take(place[codes])
        counts = np.add.reduceat(lengths, bounds[:-1])
        ids = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4")
        counts = counts + 1
        pieces = -(-counts // capacity)
        row = np.repeat(np.arange(high - low), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * capacity
        length = np.minimum(capacity, counts[row] - start)
        offsets = pa.py_buffer((4 * np.append(0, np.cumsum(length))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                keys.slice(low, high - low).take(pa.array(row)),
                pa.array(number.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(ids)]),
            ],
            names=["key", "piece", "start", "length", "ids"],
        )


def pack(
    pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Every row with its ``sequence_id`` and ``offset``; columns of these names are replaced.

    The places of a sequence are filled without gaps from 0. A length that is NULL, below 1 or above the capacity
    has no place: both columns are NULL.
    """
    rows = pieces.drop("sequence_id", "offset").sortWithinPartitions(F.desc(length))
    out = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return rows.mapInArrow(functools.partial(_placed, length, capacity, open_bins), out)


@released
def _placed(
    length: str, capacity: int, open_bins: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    bins = OpenBins(capacity, open_bins)
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        places = [
            bins.place(n) if n is not None and 1 <= n <= capacity else (None, None)
            for n in batch.column(length).to_pylist()
        ]
        numbers = [None if n is None else first + n for n, _ in places]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(numbers, pa.int64()), pa.array([o for _, o in places], pa.int64())],
            names=[*batch.schema.names, "sequence_id", "offset"],
        )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence, in order, as one binary value; rows without a place are left out."""
    return (
        packed.filter(F.col("sequence_id").isNotNull())
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
        )
    )

