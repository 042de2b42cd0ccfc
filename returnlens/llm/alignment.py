"""Alignment of two tokenizers' tokens by diagonal run skipping, and how often their ids are linked in a corpus.

Two tokenizations of the same bytes are two ascending arrays of token ends. Where both hold the same end, a group of
tokens ends. Most groups have one token on each side, so the arrays agree at a constant shift of their indices: the
walk compares them along that diagonal in probes of doubling width, and in halving widths where a probe fails, and so
jumps over a whole one-to-one stretch. Where the ends differ, the side that is behind moves on until they meet; this
irregular group sets the new shift.

Both vocabularies begin a new pre-token at a plain space between two other characters, so both end a token before it.
Texts are cut there; every distinct part is encoded and aligned once, and texts are put together from their parts.

Counting, for chunks of documents of bounded size:

1. Each chunk is written as one row that holds which document has which id pair how often, and one row per distinct
   id pair with its number of links.
2. The pairs are counted over all chunks, and the highest count of each B id is found, by aggregations with map-side
   combine. A pair every chunk holds has one small row per chunk.
3. The counts of a chunk's pairs go back to it, and its documents' sums are made.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from returnlens.llm.bpe import PATTERN, SEPARATOR, UNEVEN, UNKNOWN, WordRuns
from returnlens.llm.shared import OTHER_SPACES, Runs, gathered, plain, ragged, split_codes, texts_of, written
from returnlens.llm.token_counts import MARK, pieces_model

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 1 << 15
CHUNK_BITS = 16  # for the chunks of one partition
PARTS_KEPT, WORDS_KEPT = 250_000, 200_000
PARTS_AT_ONCE = 50_000
FEW = 16
SENT_ROWS = 100_000
MARKS = ",|;"  # after an id: another of its side follows, the side ends, the group ends
#: A plain space between two other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def common_ends(
    a: np.ndarray, b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Where both arrays of ends hold the same end: the index in each.

    The arrays hold many texts, one after the other, within the given bounds; both sides of a text end at the same
    place. All texts are walked at once; the last few, which are the long ones, one by one.
    """
    i, j, stop_i, stop_j = bounds_a[:-1].copy(), bounds_b[:-1].copy(), bounds_a[1:], bounds_b[1:]
    width = np.ones(len(i), np.int64)
    found_i: list[np.ndarray] = []
    found_j: list[np.ndarray] = []
    active = np.flatnonzero(i < stop_i)
    while len(active) > FEW:
        at_i, at_j = i[active], j[active]
        probe = np.minimum(width[active], np.minimum(stop_i[active] - at_i, stop_j[active] - at_j))
        along_i, along_j = ragged(at_i, probe), ragged(at_j, probe)
        same = a[along_i] == b[along_j]
        starts = np.cumsum(probe) - probe
        # Up to its first difference a probe is a stretch of one-to-one groups.
        first = np.minimum.reduceat(np.where(same, len(same), np.arange(len(same))), starts)
        run = np.minimum(first - starts, probe)
        stretch = np.arange(len(same)) - np.repeat(starts, probe) < np.repeat(run, probe)
        found_i.append(along_i[stretch])
        found_j.append(along_j[stretch])
        i[active], j[active] = at_i + run, at_j + run
        whole = run == probe
        width[active] = np.where(whole, 2 * width[active], 1)
        # The irregular group after it: the side that is behind moves on.
        odd = active[~whole]
        apart = odd
        while len(apart):
            behind = a[i[apart]] < b[j[apart]]
            i[apart] += behind
            j[apart] += ~behind
            apart = apart[a[i[apart]] != b[j[apart]]]
        found_i.append(i[odd].copy())
        found_j.append(j[odd].copy())
        i[odd] += 1
        j[odd] += 1
        active = active[i[active] < stop_i[active]]
    for text in active.tolist():
        low_i, low_j = int(i[text]), int(j[text])
        left, right = a[low_i : stop_i[text]].tolist(), b[low_j : stop_j[text]].tolist()
        pairs = np.array(_walk(left, right), np.int64).reshape(-1, 2)
        found_i.append(low_i + pairs[:, 0])
        found_j.append(low_j + pairs[:, 1])
    none = np.zeros(0, np.int64)
    return np.sort(np.concatenate([none, *found_i])), np.sort(np.concatenate([none, *found_j]))


def _walk(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The same for one text."""
    i = j = 0
    out: list[tuple[int, int]] = []
    while i < len(a):
        if a[i] == b[j]:
            run, width = 1, 1
            while i + run + width <= len(a) and a[i + run : i + run + width] == b[j + run : j + run + width]:
                run += width
                width *= 2
            while width := width // 2:
                if i + run + width <= len(a) and a[i + run : i + run + width] == b[j + run : j + run + width]:
                    run += width
            out += zip(range(i, i + run), range(j, j + run))
            i, j = i + run, j + run
        else:
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


class PlainRuns(WordRuns):
    """Ids of byte-level pre-tokens, the strings of special tokens taken as plain text."""

    def __init__(self, path: str):
        super().__init__(path, PATTERN)
        self.special = {}
        self.split = lambda text: [text]
        self.alone = rf"^  |^ ?[{OTHER_SPACES}]|[ {OTHER_SPACES}]$|^$|{SEPARATOR}|{UNKNOWN}"

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after the other, and the number of ids of each; only pre-tokens are kept."""
        if len(self.words) > WORDS_KEPT:
            self.words, self.word_runs = {}, Runs()
        found = self.part_runs.take(self.numbers(parts))
        self.parts, self.part_runs = {}, Runs()
        return found


class PartAlignments:
    """Alignments of parts of texts, kept up to a number and made anew beyond; results never depend on it."""

    def __init__(self, byte_path: str, piece_path: str):
        self.byte_runs, self.pieces = PlainRuns(byte_path), pieces_model(piece_path)
        merges = self.byte_runs.merges
        raw, starts = merges.piece_bytes.tobytes(), merges.piece_starts.tolist()
        self.tokens_a = pa.array([raw[s : s + n] for s, n in zip(starts, merges.piece_lengths.tolist())], pa.large_binary())
        found = []
        for i in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece) if self.pieces.is_byte(i) else None
            found.append(bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode())
        self.tokens_b = pa.array(found, pa.large_binary())
        ids = range(max(len(self.tokens_a), len(self.tokens_b)))
        self.written = pa.array([f"{i}{mark}" for i in ids for mark in MARKS], pa.large_string())
        self._renew()

    def _renew(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs = Runs(np.int64)  # A id times the size of B, plus B id
        self.names: list[bytes] = []  # the ids as written, each group closed
        self.sizes = Runs(np.int64)  # A tokens, B tokens, whether both give the part's bytes

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part in the tables, new parts aligned on the way."""
        if len(self.known) + len(parts) > PARTS_KEPT:
            self._renew()
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        for low in range(0, len(new), PARTS_AT_ONCE):
            self._add(new[low : low + PARTS_AT_ONCE])
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _add(self, new: list[str]) -> None:
        a, b, count_a, count_b, sound, groups = self.groups(new)
        last_a, last_b = groups
        per_group_a, per_group_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # In writing, the A tokens of a group come before its B tokens.
        place_a = np.arange(len(a)) + np.repeat(last_b - per_group_b + 1, per_group_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, per_group_b)
        tokens = np.empty(len(a) + len(b), np.int64)
        tokens[place_a] = a * len(MARKS)
        tokens[place_b] = b * len(MARKS)
        tokens[place_a[last_a]] += MARKS.index("|")
        tokens[place_b[last_b]] += MARKS.index(";")
        text = self.written.take(pa.array(tokens))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
        data = text.buffers()[2].to_pybytes() if len(text) else b""
        ends = offsets[np.append(0, np.cumsum(count_a + count_b))].tolist()
        self.names += [data[s:e] for s, e in zip(ends[:-1], ends[1:])]
        owner = np.repeat(np.arange(len(new)), count_a)[last_a]
        self.pairs.extend(a[last_a] * len(self.tokens_b) + b[last_b], np.bincount(owner, minlength=len(new)))
        self.sizes.extend(np.column_stack([count_a, count_b, sound]).ravel(), np.full(len(new), 3))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def groups(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both sides, one part after the other, their number per part, whether both give the part's bytes
        back (else it has no ids), and the groups: which token of each side is the last of one."""
        spaced = pa.array([" " + p for p in parts], pa.large_string())
        a, count_a = self.byte_runs.ids(spaced.to_pylist())
        lists = self.pieces.encode(parts, num_threads=1)
        count_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(count_b.sum()))
        a, size = a.astype(np.int64), pc.binary_length(spaced).to_numpy()
        sound = np.ones(len(parts), bool)
        for ids, counts, tokens in ((a, count_a, self.tokens_a), (b, count_b, self.tokens_b)):
            sound &= _gives_back(tokens.take(pa.array(ids)), counts, spaced, size)
        if not sound.all():
            a, b = a[np.repeat(sound, count_a)], b[np.repeat(sound, count_b)]
            count_a, count_b = count_a * sound, count_b * sound
        lengths = [pc.binary_length(t.take(pa.array(ids))).to_numpy() for t, ids in ((self.tokens_a, a), (self.tokens_b, b))]
        groups = common_ends(*map(np.cumsum, lengths), np.append(0, np.cumsum(count_a)), np.append(0, np.cumsum(count_b)))
        return a, b, count_a, count_b, sound, groups


def _gives_back(tokens: pa.Array, counts: np.ndarray, parts: pa.Array, size: np.ndarray) -> np.ndarray:
    """Whether the tokens of each part, put together, are its bytes."""
    ends = np.append(0, np.cumsum(pc.binary_length(tokens).to_numpy()))[np.append(0, np.cumsum(counts))]
    sound = np.diff(ends) == size
    given, wanted = (np.frombuffer(x.buffers()[2] or b"", np.uint8) for x in (tokens, parts))
    given, wanted = given[: ends[-1]], wanted[: int(size.sum())]
    if not sound.all():
        given, wanted = given[np.repeat(sound, np.diff(ends))], wanted[np.repeat(sound, size)]
    wrong = np.flatnonzero(given != wanted)
    if len(wrong):
        alike = np.flatnonzero(sound)
        sound[alike[np.searchsorted(np.cumsum(size[alike]), wrong, side="right")]] = False
    return sound


@functools.cache
def _alignments(byte_path: str, piece_path: str) -> PartAlignments:
    return PartAlignments(byte_path, piece_path)


def parts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and code of every part, in the order of the texts, and the distinct parts. Empty texts have none."""
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    codes, bounds, parts = split_codes(pc.if_else(pa.array(uneven), "", texts))
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    even = ~(uneven | empty)[rows]
    rows, codes = rows[even], codes[even].astype(np.int64)
    if uneven.any():
        known = {p: i for i, p in enumerate(parts)}
        more_rows, more = [rows], [codes]
        for row in np.flatnonzero(uneven).tolist():
            own = [known.setdefault(p, len(known)) for p in CUT.split(texts[row].as_py())]
            more.append(np.array(own, np.int64))
            more_rows.append(np.full(len(own), row))
        rows, codes, parts = np.concatenate(more_rows), np.concatenate(more), list(known)
        order = np.argsort(rows, kind="stable")
        rows, codes = rows[order], codes[order]
    # Only what occurs: an uneven text leaves the part '' behind.
    used, codes = np.unique(codes, return_inverse=True)
    return rows, codes, [parts[i] for i in used.tolist()]


def aligned(
    frame: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key and ``groups``, an array of structs of the ids of both sides (``a``, ``b``).

    Side A encodes a space and the text with a byte-level vocabulary, side B the text with a piece vocabulary that adds
    the space itself; special tokens' own strings are plain text. NULL and empty texts, and those whose tokens do not
    give the bytes back (a text may hold the word-start mark itself), have no groups. Repeated rows and NULL keys give
    a row each; an empty table gives none; other columns are not read. A text must fit in a task's memory.
    """
    docs = frame.select(frame[key].alias("key"), frame[text].cast("string").alias("text"))
    out = StructType(
        [
            StructField("key", docs.schema["key"].dataType),
            *StructType.fromDDL("groups array<struct<a: array<int>, b: array<int>>>").fields,
        ]
    )
    made = docs.mapInArrow(functools.partial(_aligned, byte_path, piece_path), out)
    return made.withColumnRenamed("key", key)


def _aligned(byte_path: str, piece_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _alignments(byte_path, piece_path)
    for batch in gathered(batches, "text", CHUNK_BYTES // 4, CHUNK_ROWS):
        rows, codes, parts = parts_of(texts_of(batch.column("text")))
        a, b, count_a, count_b, sound, (last_a, last_b) = table.groups(parts)
        n = batch.num_rows
        chosen = ~(np.bincount(rows, ~sound[codes], n) > 0)[rows]
        rows, codes = rows[chosen], codes[chosen]
        # Each part's groups are a run of all groups; ids and group ends are gathered part by part.
        part_groups = np.bincount(np.repeat(np.arange(len(parts)), count_a)[last_a], minlength=len(parts))
        held = ragged((np.cumsum(part_groups) - part_groups)[codes], part_groups[codes])
        sides = []
        for ids, counts, last in ((a, count_a, last_a), (b, count_b, last_b)):
            sizes = np.diff(last, prepend=-1)[held]
            flat = ids[ragged((np.cumsum(counts) - counts)[codes], counts[codes])]
            bounds = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            sides.append(pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32))))
        per_row = np.bincount(rows, part_groups[codes], n).astype(np.int64)
        groups = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(per_row)).astype(np.int32)), pa.StructArray.from_arrays(sides, ["a", "b"])
        )
        yield pa.RecordBatch.from_arrays([batch.column("key"), groups], names=["key", "groups"])


def alignment_counts(
    frame: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Tokens are those of ``aligned``. A link joins the two tokens that end together at the end of a group. An id pair's
    count is its number of links in the whole table; ``count_sum`` adds the counts of a row's links and ``n_best`` is
    how many of them have the highest count of their B id, ties included. ``groups_sha256`` is the digest of the ids
    (commas between ids, a bar between the sides, semicolons between groups), '' for a row without tokens, whose
    numbers are 0. Repeated rows and NULL keys give a row each and count as often; an empty table gives none; other
    columns are not read. A text must fit in a task's memory; chunks are no larger than ``CHUNK_BYTES`` or one text.
    """
    docs = frame.select(frame[key].alias("key"), frame[text].cast("string").alias("text"))
    width = pieces_model(piece_path).vocab_size()
    chunks = written(
        docs.mapInArrow(
            functools.partial(_chunk_rows, byte_path, piece_path), "chunk long, pair long, links long, documents binary"
        ),
        "alignments",
    )
    held = chunks.filter(F.col("pair").isNotNull()).select("chunk", "pair", "links")
    counts = held.groupBy(F.col("pair").alias("linked")).agg(F.sum("links").alias("count"))
    counts = counts.withColumn("b", F.col("linked") % width)
    most = counts.groupBy(F.col("b").alias("own")).agg(F.max("count").alias("most"))
    facts = counts.join(most, F.col("b") == F.col("own")).select(
        "linked", "count", (F.col("count") == F.col("most")).alias("best")
    )
    sent = held.join(facts, F.col("pair") == F.col("linked")).select("chunk", "pair", "count", "best")
    out = StructType(
        [
            StructField("key", docs.schema["key"].dataType),
            *StructType.fromDDL(
                "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
            ).fields,
        ]
    )
    documents = chunks.filter(F.col("pair").isNull()).select(F.col("chunk").alias("own_chunk"), "documents")
    totals = documents.groupBy("own_chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_chunk_totals, out)
    return totals.withColumnRenamed("key", key)


def _chunk_rows(
    byte_path: str, piece_path: str, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """One row that describes the chunk's documents, and one row per id pair they hold."""
    table = _alignments(byte_path, piece_path)
    first = TaskContext.get().partitionId() << CHUNK_BITS
    names = ["chunk", "pair", "links", "documents"]
    for number, batch in enumerate(gathered(batches, "text", CHUNK_BYTES, CHUNK_ROWS)):
        facts, pairs, links = _documents(table, texts_of(batch.column("text")))
        stored = pa.BufferOutputStream()
        described = pa.table({"key": batch.column("key"), **facts})
        with pa.ipc.new_stream(stored, described.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(described)
        chunk = first + number
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk]), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                pa.array([stored.getvalue().to_pybytes()], pa.binary()),
            ],
            names,
        )
        for low in range(0, len(pairs), SENT_ROWS):
            part = pairs[low : low + SENT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(links[low : low + SENT_ROWS]),
                    pa.nulls(len(part), pa.binary()),
                ],
                names,
            )


def _documents(table: PartAlignments, texts: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """What is known of each text, the distinct id pairs of all, and the number of links of each pair."""
    n = len(texts)
    rows, codes, parts = parts_of(texts)
    numbers = table.numbers(parts)
    sizes = table.sizes.take(numbers)[0].reshape(-1, 3)
    broken = np.bincount(rows, 1 - sizes[codes, 2], n) > 0
    rows, codes = rows[~broken[rows]], codes[~broken[rows]]
    # Pairs are numbered over the distinct parts, of which there are few.
    used = np.unique(codes)
    flat, lengths = table.pairs.take(numbers[used])
    pairs, places = np.unique(flat, return_inverse=True)
    at = np.zeros(len(parts), np.int64)
    at[used] = np.arange(len(used))
    starts = np.cumsum(lengths) - lengths
    own = at[codes]
    linked = places[ragged(starts[own], lengths[own])]
    owner = np.repeat(rows, lengths[own])
    kinds, times = np.unique(owner * max(1, len(pairs)) + linked, return_counts=True)
    owners, held = np.divmod(kinds, max(1, len(pairs)))
    bounds = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
    n_links = np.bincount(owner, minlength=n)
    cuts = np.searchsorted(rows, np.arange(n + 1)).tolist()
    named = [table.names[i] for i in numbers.tolist()]
    order = codes.tolist()
    digests = [
        hashlib.sha256(b"".join([named[c] for c in order[a:b]])[:-1]).hexdigest() if b > a else ""
        for a, b in zip(cuts[:-1], cuts[1:])
    ]
    facts = {
        "n_a": pa.array(np.bincount(rows, sizes[codes, 0], n).astype(np.int64)),
        "n_b": pa.array(np.bincount(rows, sizes[codes, 1], n).astype(np.int64)),
        "n_links": pa.array(n_links),
        "digest": pa.array(digests, pa.string()),
        # Numbers of the sorted pairs a document holds, and how often.
        "pairs": pa.ListArray.from_arrays(pa.array(bounds), pa.array(held.astype(np.int32))),
        "times": pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
    }
    return facts, pairs, np.bincount(linked, minlength=len(pairs)).astype(np.int64)


def _chunk_totals(documents: pa.Table, sent: pa.Table) -> pa.Table:
    """The rows of a chunk's documents. ``sent`` has every pair of the chunk once; the documents number them in order."""
    docs = pa.ipc.open_stream(documents["documents"][0].as_buffer()).read_all()
    order = np.argsort(sent["pair"].to_numpy())
    count, best = (sent[c].to_numpy()[order].astype(np.int64) for c in ("count", "best"))
    held, times = (plain(docs[c]).flatten().to_numpy() for c in ("pairs", "times"))
    owner = np.repeat(np.arange(docs.num_rows), pc.list_value_length(plain(docs["pairs"])).to_numpy())
    count_sum, n_best = np.zeros((2, docs.num_rows), np.int64)
    np.add.at(count_sum, owner, times * count[held])
    np.add.at(n_best, owner, times * best[held])
    return pa.table(
        {
            "key": docs["key"],
            "n_a": docs["n_a"],
            "n_b": docs["n_b"],
            "n_groups": docs["n_links"],
            "n_links": docs["n_links"],
            "n_best": pa.array(n_best),
            "count_sum": pa.array(count_sum),
            "groups_sha256": docs["digest"],
        }
    )
