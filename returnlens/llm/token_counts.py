"""Token counts without ids: pieces once per distinct pre-token, joined to the frequencies of each document.

A piece vocabulary with word starts never merges across the start of a run of word-start marks, so the pieces of a
text are those of its pre-tokens: marks with the characters that follow them. The steps:

1. Each chunk of documents gives one row per distinct pre-token, with the documents that hold it and how often.
2. These rows are shuffled and sorted by pre-token, so all frequencies of a pre-token meet its count, which the library
   gives once. This is a merge join whose other side is made on the way: a table of counts of its own would take the
   same shuffle a second time.
3. Products are summed per document, first within a task, then per chunk.

Bounds: a chunk holds at most ``CHUNK_BYTES`` of text (or one longer document) and 65,536 documents. A pre-token of
every document has one row per chunk; the rows of ``SPAN`` input partitions go to one task at most, so on larger
inputs a pre-token is counted once for each such span.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from returnlens.llm.shared import gathered, plain, split_codes, texts_of

CHUNK_BYTES = 32 << 20
CHUNK_ROWS = 1 << 16
SPAN = 1 << 10
CHUNK_BITS = 16  # for the chunks of one partition
FLUSH_PAIRS = 2_000_000
SENT_ROWS = 50_000
MARK = "▁"
LEAD = "\n"
# How often a document (its number in the chunk) holds a pre-token, and how many tokens that gives.
# A frequency beyond 255 takes several entries.
POSTING = np.dtype([("doc", "<u2"), ("n", "u1")])
SUM = np.dtype([("doc", "<u2"), ("n", "<i8")])
PRE_TOKENS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.cache
def pieces_model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The vocabulary; refused if pieces can cross pre-tokens."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(MARK in p.lstrip(MARK) or (LEAD in p and p != LEAD) for p in pieces):
        raise ValueError(f"{path}: pieces hold word starts or line ends after other characters")
    return model


def count_pieces(path: str, words: list[str]) -> np.ndarray:
    """Pieces of each pre-token. A line end before it keeps the mark the library adds to a text away from it."""
    model = pieces_model(path)
    own = len(model.encode(LEAD))
    found = model.encode([LEAD + w for w in words], num_threads=1)
    return np.fromiter(map(len, found), np.int32, len(words)) - np.int32(own)


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and code of every pre-token occurrence, and the distinct pre-tokens."""
    n = len(texts)
    uneven = pc.match_substring_regex(texts, rf"^ | $|  |{MARK}").to_numpy(zero_copy_only=False)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    codes, bounds, parts = split_codes(pc.if_else(pa.array(uneven), "", texts))
    rows = np.repeat(np.arange(n), np.diff(bounds))
    even = ~(uneven | empty)[rows]
    rows, codes = rows[even], codes[even]
    words = [MARK + p for p in parts]
    if uneven.any():
        known = {w: i for i, w in enumerate(words)}
        for row in np.flatnonzero(uneven).tolist():
            found = PRE_TOKENS.findall(MARK + texts[row].as_py().replace(" ", MARK))
            own = [known.setdefault(w, len(known)) for w in found]
            codes, rows = np.append(codes, own), np.append(rows, np.full(len(own), row))
        words = list(known)
    return rows, codes.astype(np.int64), words


def token_counts(
    frame: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Counts are those of the vocabulary's library without begin, end or added special tokens. NULL and empty texts
    have 0 bytes and 0 tokens. Repeated rows and NULL keys give a row each; other columns are not read.
    """
    docs = frame.select(frame[key].alias("key"), frame[text].cast("string").alias("text"))
    frequencies = docs.mapInArrow(_chunk_rows, "chunk long, pre_token string, postings binary")
    span = F.shiftright("chunk", CHUNK_BITS + SPAN.bit_length() - 1)
    partial = (
        frequencies.repartition("pre_token", span)
        .sortWithinPartitions("pre_token")
        .mapInArrow(functools.partial(_partial_sums, path), "chunk long, listed boolean, postings binary")
    )
    out = StructType(
        [StructField("key", docs.schema["key"].dataType), *StructType.fromDDL("n_bytes long, n_tokens long").fields]
    )
    totals = partial.groupBy("chunk").applyInArrow(_chunk_totals, out)
    return totals.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of fixed-width records as binary values."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _records(values: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of binary values, and how many each value holds."""
    values = plain(values)
    joined = b"".join(values.to_pylist())
    return np.frombuffer(joined, dtype), pc.binary_length(values).to_numpy(zero_copy_only=False) // dtype.itemsize


def _table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each chunk: one per distinct pre-token, and one that lists the chunk's documents."""
    first = TaskContext.get().partitionId() << CHUNK_BITS
    for number, batch in enumerate(gathered(batches, "text", CHUNK_BYTES, CHUNK_ROWS)):
        texts = texts_of(batch.column("text"))
        n, chunk = len(texts), first + number
        rows, codes, words = pre_tokens(texts)
        pairs, counts = np.unique(codes * n + rows, return_counts=True)
        entries = -(-counts // 255)
        pairs, last = np.repeat(pairs, entries), np.cumsum(entries) - 1
        postings = np.empty(len(pairs), POSTING)
        postings["doc"], postings["n"] = pairs % n, 255
        postings["n"][last] = counts - 255 * (entries - 1)
        owners = pairs // n
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        used = pa.array(words, pa.string()).take(pa.array(owners[starts]))
        listed = pa.table({"key": batch.column("key"), "size": pc.binary_length(texts).cast(pa.int64())})
        for names, values in (
            (used, _binary(postings, np.append(starts, len(pairs)))),
            (pa.array([f"chunk {chunk}"]), pa.array([_table_bytes(listed)], pa.binary())),
        ):
            for low in range(0, len(names), SENT_ROWS):
                part = names.slice(low, SENT_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), chunk)), part, values.slice(low, SENT_ROWS)],
                    names=["chunk", "pre_token", "postings"],
                )


def _partial_sums(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of frequency and piece count, summed per document as far as one task can.

    Rows that list a chunk's documents, which carry no word-start mark, pass.
    """
    names = ["chunk", "listed", "postings"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> pa.RecordBatch:
        owner, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = np.empty(len(owner), SUM)
        sums["doc"] = owner & 0xFFFF
        sums["n"] = 0
        np.add.at(sums["n"], inverse, np.concatenate([h[1] for h in held]))
        chunks = owner >> 16
        starts = np.flatnonzero(np.diff(chunks, prepend=-1))
        values = _binary(sums, np.append(starts, len(owner)))
        return pa.RecordBatch.from_arrays([pa.array(chunks[starts]), pa.array([False] * len(starts)), values], names)

    last, last_count = "", 0
    for batch in batches:
        listing = pc.invert(pc.starts_with(batch.column("pre_token"), MARK))
        lists, rows = batch.filter(listing), batch.filter(pc.invert(listing))
        if lists.num_rows:
            yield pa.RecordBatch.from_arrays(
                [lists["chunk"], pa.array([True] * lists.num_rows), lists["postings"]], names
            )
        if not rows.num_rows:
            continue
        coded = rows.column("pre_token").dictionary_encode()
        words = coded.dictionary.to_pylist()
        # The rows are sorted: only the first may have been counted with the batch before.
        again = words[0] == last
        counted = count_pieces(path, words[again:])
        n_pieces = np.append(np.array([last_count] * again, np.int32), counted).astype(np.int64)
        last, last_count = words[-1], n_pieces[-1]
        found, lengths = _records(rows.column("postings"), POSTING)
        # Chunk numbers need 47 bits at most: 31 of the partition, 16 of its chunk.
        chunks = np.repeat(rows.column("chunk").to_numpy(), lengths)
        pieces = np.repeat(n_pieces[coded.indices.to_numpy(zero_copy_only=False)], lengths)
        held.append(((chunks << 16) | found["doc"], found["n"] * pieces))
        size += len(found)
        if size > FLUSH_PAIRS:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def _chunk_totals(table: pa.Table) -> pa.Table:
    listed = table.filter(table["listed"])["postings"]
    docs = pa.ipc.open_stream(listed[0].as_buffer()).read_all()
    found, _ = _records(table.filter(pc.invert(table["listed"]))["postings"], SUM)
    totals = np.zeros(docs.num_rows, np.int64)
    np.add.at(totals, found["doc"], found["n"])
    return pa.table({"key": docs["key"], "n_bytes": docs["size"], "n_tokens": pa.array(totals)})
