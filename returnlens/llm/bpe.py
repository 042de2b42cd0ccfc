"""Byte-pair encoding and decoding over a pair occurrence index.

``Merges`` encodes many distinct pre-tokens at once. All their symbols lie in one array with links to the next and
previous symbol. An index maps the rank of each mergeable pair to every position where the pair occurs in the batch.
Active ranks are taken in ascending order; one step merges all occurrences of a rank and files the pairs that arise
beside them in the lists of their own ranks. A list may hold positions whose pair is gone; they are dropped when
their rank's turn comes. A merge only makes pairs of a symbol that the vocabulary learned at this rank, so no smaller
rank comes up again.

Each Python worker keeps the runs of pre-tokens it has seen in a table of bounded size; results never depend on it.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from returnlens.llm.shared import OTHER_SPACES, Runs, plain, ragged, slices, split_codes, texts_of, unused_prefix

NONE = np.iinfo(np.int32).max
PARTS_KEPT = 250_000
WORDS_KEPT = 500_000
SLICE_BYTES = 3 << 20
SLICE_ROWS = 2_000
SEPARATOR = "\x0b"  # white space that texts hardly hold
UNKNOWN = r"[^\p{L}\p{N}\p{M}\p{P}\p{S}\p{Z}\p{C}]"
#: Fixed value: how the vocabulary's pre-tokenizer cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the rest follow in order from code point 256.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge ranks of a byte-level vocabulary; ``suffix`` marks the last symbol of a pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.first = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.twins = left == right
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Bytes of every id, for decoding.
        byte = {c: b for b, c in enumerate(letters)}
        pieces = [b""] * self.size
        for token, i in vocabulary.items():
            if token not in self.special:
                pieces[i] = bytes(byte[c] for c in token.removesuffix(suffix))
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_lengths = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.order[at], NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and the number of ids of each."""
        data = [w.encode() for w in words]
        return self.encode_bytes(np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data)))

    def encode_bytes(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words given as their UTF-8 bytes, one word after the other, and the number of bytes of each."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), lengths
        ends = np.cumsum(lengths)
        ends, starts = ends[lengths > 0], (ends - lengths)[lengths > 0]
        # Position n ends every word on both sides.
        symbol = np.append(self.first[raw], np.int32(-1))
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, n
        after[n] = n
        rank = np.append(self.ranks(symbol[:-1], symbol[after[:-1]]), NONE)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(positions: np.ndarray) -> None:
            own = rank[positions]
            positions, own = positions[own != NONE], own[own != NONE]
            if not len(own):
                return
            order = np.argsort(own, kind="stable")
            positions, own = positions[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, low, high in zip(own[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if r in index:
                    index[r].append(positions[low:high])
                else:
                    index[r] = [positions[low:high]]
                    heapq.heappush(active, r)

        file(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.twins[r]:
                at = _every_second(np.unique(at), after)
            gone = after[at]
            symbol[at] = self.merged[r]
            rank[gone] = NONE
            symbol[gone] = -1
            then = after[gone]
            after[at] = then
            before[then] = at
            touched = np.concatenate([at, before[at]])
            rank[touched] = self.ranks(symbol[touched], symbol[after[touched]])
            rank[n] = NONE
            file(touched)
        alive = symbol[:n] >= 0
        counts = np.zeros(len(lengths), np.int64)
        counts[lengths > 0] = np.add.reduceat(alive, starts, dtype=np.int64)
        return symbol[:n][alive], counts

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids; broken UTF-8 gives replacement characters."""
        lengths = self.piece_lengths[ids]
        data = self.piece_bytes[ragged(self.piece_starts[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[bounds].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def _every_second(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a pair of equal symbols, the first, third, and so on of each row."""
    follows = np.append(False, after[at[:-1]] == at[1:])
    number = np.arange(len(at))
    head = np.maximum.accumulate(np.where(follows, 0, number))
    return at[(number - head) % 2 == 0]


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


class WordRuns:
    """Ids of parts of texts and of their pre-tokens, kept up to a number of each and found anew beyond.

    A part is cut into special tokens first, then by the pattern, after the normaliser, into pre-tokens. Parts with
    characters that not every version of Unicode knows are cut by the tokenizer's own library.
    """

    def __init__(self, path: str, pattern: str, normal: Callable[[str], str] = str):
        self.merges, self.normal = merges(path), normal
        library = Tokenizer.from_file(path)
        self.library_normal = library.normalizer.normalize_str if library.normalizer else str
        self.library_cut = library.pre_tokenizer.pre_tokenize_str
        self.special = self.merges.special
        names = "|".join(map(regex.escape, self.special))
        self.split = regex.compile(f"({names})").split if names else lambda text: [text]
        self.find = regex.compile(rf"{pattern}|{SEPARATOR}").findall
        self.alone = rf"^  |^ ?[{OTHER_SPACES}]|[ {OTHER_SPACES}]$|^$|{SEPARATOR}|{UNKNOWN}" + (f"|{names}" if names else "")
        self.words, self.word_runs = {}, Runs()
        self.parts, self.part_runs = {}, Runs()

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The run number of each part in ``part_runs``, new parts encoded on the way."""
        if len(self.parts) + len(parts) > PARTS_KEPT:
            self.parts, self.part_runs = {}, Runs()
            if len(self.words) > WORDS_KEPT:
                self.words, self.word_runs = {}, Runs()
        known = self.parts
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            self._add(new)
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def part_runs_of(self, codes: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of coded parts, one part after the other, and the number of ids of each."""
        numbers = self.numbers(parts)  # may renew the table of runs
        return self.part_runs.take(numbers[codes])

    def _add(self, new: list[str]) -> None:
        """Most parts are cut in one go, joined by a separator; parts it could touch are cut alone."""
        alone = pc.match_substring_regex(pa.array(new, pa.large_string()), self.alone).to_numpy(zero_copy_only=False)
        joined = [p for p, a in zip(new, alone) if not a]
        single = [p for p, a in zip(new, alone) if a]
        tokens = self.find(self.normal(SEPARATOR.join(joined)))
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        ends = codes == distinct.index(SEPARATOR) if len(joined) > 1 else np.zeros(len(codes), bool)
        counts = np.bincount(np.cumsum(ends)[~ends], minlength=len(joined)) if joined else np.zeros(0, np.int64)
        pieces = [self._cut(p) for p in single]
        fresh = [w for w in dict.fromkeys([*distinct, *(w for p in pieces for w in p)]) if w not in self.words]
        self._encode(fresh)
        number = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        flat = np.append(number[codes[~ends]], np.array([self.words[w] for p in pieces for w in p], np.int64))
        counts = np.append(counts, np.array([len(p) for p in pieces], np.int64))
        values, sizes = self.word_runs.take(flat)
        ids_before = np.append(0, np.cumsum(sizes))
        totals = np.diff(ids_before[np.append(0, np.cumsum(counts))])
        self.part_runs.extend(values, totals)
        self.parts.update(zip([*joined, *single], range(len(self.parts), len(self.parts) + len(new))))

    def _cut(self, part: str) -> list[str | int]:
        """Pre-tokens of a part, special tokens as their ids."""
        out: list[str | int] = []
        for text in self.split(part):
            if text in self.special:
                out.append(self.special[text])
            else:
                plain_text = self.library_normal(text)
                out += [plain_text[a:b] for _, (a, b) in self.library_cut(plain_text)]
        return out

    def _encode(self, fresh: list[str | int]) -> None:
        ids, lengths = self.merges.encode(["" if isinstance(w, int) else w for w in fresh])
        special = [i for i, w in enumerate(fresh) if isinstance(w, int)]
        if special:
            ids = np.insert(ids, np.cumsum(lengths)[special], [fresh[i] for i in special])
            lengths[special] = 1
        self.word_runs.extend(ids, lengths)
        self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))


@functools.cache
def _byte_level(path: str) -> WordRuns:
    return WordRuns(path, PATTERN)


# A plain space with a character other than white space on both sides starts a pre-token in every text, so such texts
# are cut there. Other texts are cut as a whole.
UNEVEN = rf"^ | $|[ {OTHER_SPACES}] | [ {OTHER_SPACES}]"


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one text after the other, and the number of ids of each."""
    runs = _byte_level(path)
    uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
    codes, bounds, parts = split_codes(pc.if_else(pa.array(uneven), "", texts))
    opens = np.zeros(len(codes), bool)
    opens[bounds[:-1]] = True
    # The first part of a text has no space before it.
    whole = pc.if_else(pa.array(uneven), texts, "").to_pylist()
    heads = [w if u else parts[c] for w, u, c in zip(whole, uneven, codes[bounds[:-1]])]
    spaced = [" " + p for p in parts]
    distinct = list(dict.fromkeys(heads))
    numbers = runs.numbers([*spaced, *distinct])
    by_part = dict(zip(distinct, numbers[len(spaced) :].tolist()))
    chosen = numbers[: len(spaced)][codes]
    chosen[opens] = np.fromiter(map(by_part.__getitem__, heads), np.int64, len(heads))
    ids, lengths = runs.part_runs.take(chosen)
    counts = np.add.reduceat(lengths, bounds[:-1]) if len(lengths) else np.zeros(0, np.int64)
    return ids, counts


def _encoded(batches: Iterator[pa.Array], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and bounds of the texts, in small steps: what a task holds is bounded by ``SLICE_BYTES``."""
    for batch in batches:
        for low in range(0, len(batch), SLICE_ROWS):
            texts = texts_of(batch.slice(low, SLICE_ROWS))
            for start, stop in slices(texts, SLICE_BYTES):
                ids, counts = encode_texts(texts.slice(start, stop - start), path)
                yield ids, np.append(0, np.cumsum(counts))


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def encoder(path: str):
    """Column function from a text to its ids."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found, bounds in _encoded(batches, path):
            yield _lists(found, bounds)

    return ids.asNondeterministic()


def round_tripper(path: str):
    """Column function from a text to its ids and the text they decode to, in one pass."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found, bounds in _encoded(batches, path):
            decoded = pa.array(merges(path).decode(found, bounds), pa.string())
            yield pa.StructArray.from_arrays([_lists(found, bounds), decoded], ["ids", "decoded"])

    return both.asNondeterministic()


def decoder(path: str):
    """Column function from ids to their text."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = plain(batch)
            out: list[str] = []
            for low in range(0, len(ids), 500):
                part = ids.slice(low, 500)
                counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                out += merges(path).decode(flat, np.append(0, np.cumsum(counts)))
            yield pa.array(out, pa.string())

    return text.asNondeterministic()


def bpe_encode(frame: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with the ids of its whole text.

    The ids are those of the tokenizers library without added special tokens; a special token's own string inside a
    text gives its id. A NULL or empty text has no ids. Rows are neither joined nor reordered, so repeated or NULL
    keys do no harm; a column already named ``ids`` is replaced.
    """
    return frame.withColumn(ids, encoder(path)(_text(frame, text)))


def bpe_round_trip(
    frame: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` in one pass, for checks that the ids lose nothing.

    Columns already named ``ids`` or ``decoded`` are replaced, all others stay.
    """
    both = f"{unused_prefix(frame.columns)}both"
    tripped = frame.withColumn(both, round_tripper(path)(_text(frame, text)))
    return tripped.withColumn(ids, F.col(f"{both}.ids")).withColumn(decoded, F.col(f"{both}.decoded")).drop(both)


def bpe_decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Every row with the text of its ids, special tokens written out. NULL ids give ''."""
    return frame.withColumn(text, decoder(path)(frame[ids]))


def _text(frame: DataFrame, name: str) -> Column:
    return frame[name].cast("string")
