"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked when their edit distance (over code points) is at most ``threshold``. Every distinct line is cut
into ``threshold + 1`` even segments; at most that many edits leave one segment whole. So a line looks, for each
length it may be linked to, for the segments such a line would have, at the few starts that an alignment within the
threshold allows (those whose shift both the edits before and after the segment can explain). Substrings and segments
meet by a hash of length, segment number and content; every meeting is verified by a banded bit-parallel edit
distance, for many pairs at a time.

Keys travel many to a row, with others of their part; a part is sorted in one task, with 12 bytes for each line of a
key. Only keys with two lines or more go on, and only for those the texts are fetched. The lines of a key are compared in
blocks of at most ``BLOCK`` lines, every pair of blocks in its own group; a group returns links that keep connected
lines connected, never all pairs. Equal lines are one line from the start, so copies add no work.

With ``threshold=None`` the threshold grows with the line and no line is left out (``within``). Equal lines that are not
blank are one class at any length. Characters: one edit from 20 of them, two from 40, none of them in a digit. Words:
one edit for every 25 of them. Lengths are those of the shorter line; either measure links. Two lines of 25 words or
more within their threshold share a run of 12 words, of 16 from 54 words and of 20 from 100: of the runs of ``GRAM``
words in each window of that length the one with the smallest hash is a key, so both lines have it. Larger windows
choose among the keys of smaller ones, so lines on two sides of a bound meet as well. Two edits of characters leave a
run of 12 words whole in a line of 40 words or more, so such lines meet by these keys as well, unless an edit can join
words to one of more than ``LONG_WORD`` characters; those, and all shorter lines, have segments.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from returnlens.functions.skew import once_per_key
from returnlens.llm import quality
from returnlens.llm.components import components
from returnlens.llm.shared import gathered, grouped_runs, plain, ragged, released, texts_of, whole_groups, written

THRESHOLD = 2
LEAST_CHARS = 20
BLOCK = 512
SEEN_LINES = 400_000
SENT_ROWS = 20_000
KEY_BYTES = 1 << 19
SENT_KEYS = 1 << 19
PARTS = 4  # of keys, for each partition of their shuffle: a task sends a row for each of them at most
PAIRS = 1 << 15
HELD_BYTES = 1 << 20
POWERS_KEPT = 1 << 20

# Threshold by length.
EDIT_CHARS = 20  # code points for one edit of characters
MOST_EDITS = 2  # of characters; longer lines have edits of words as well
EDIT_WORDS = 25  # words for one edit of words
GRAM = 8
GRAM_SEED = 1 << 40
WINDOWS = ((100, 13), (54, 9), (0, 5))  # least words, runs in a window
LONG_WORD = 48  # a longer word counts as its characters
PLAIN_WORDS = 40
#: Scripts without spaces: each character is a word.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_ANY = re.compile(f"[{UNSPACED}]")
UNSPACED_PARTS = re.compile(f"[{UNSPACED}]|[^{UNSPACED}]+")
# Characters of lines whose words are not simply what lies between common white space: first and last of each run.
ODD_LOW = ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0))
ODD_HIGH = (
    (0xE00, 0xEFF), (0x1000, 0x109F), (0x1680, 0x1680), (0x1780, 0x17FF), (0x180E, 0x180E), (0x2000, 0x200F),
    (0x2028, 0x202F), (0x205F, 0x2064), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFEFF, 0xFEFF), (0x20000, 0x3FFFF),
)
TURN = 0x9E3779B97F4A7C15
TURN_BACK = pow(TURN, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
DIGITS = re.compile(r"\d+")


@functools.lru_cache(1 << 14)
def segments(length: int, threshold: int) -> tuple[tuple[int, int], ...]:
    """Start and length of each segment; the later ones take the remainder."""
    parts = threshold + 1
    short, longer = divmod(length, parts)
    sizes = [short] * (parts - longer) + [short + 1] * longer
    return tuple((sum(sizes[:i]), size) for i, size in enumerate(sizes))


@functools.lru_cache(1 << 14)
def probes(length: int, threshold: int) -> tuple[tuple[int, int, int], ...]:
    """Substrings that may be a segment of a line at most ``threshold`` shorter: seed, start, length.

    Those at the line's own segments come first and are its index entries as well.
    """
    own, others = [], []
    for other in range(max(threshold + 1, length - threshold), length + 1):
        longer = length - other
        for i, (start, size) in enumerate(segments(other, threshold)):
            before, after = i, threshold - i
            low = max(0, start - before, start + longer - after)
            high = min(length - size, start + before, start + longer + after)
            for at in range(low, high + 1):
                entry = (other * (threshold + 1) + i, at, size)
                (own if not longer and at == start else others).append(entry)
    return (*own, *others)


def keys_of(line: str, threshold: int) -> list[int]:
    """Hashes of all probes of a line; the first ``threshold + 1`` are its own segments."""
    data = line.encode("utf-32-le")
    digest = xxhash.xxh64_intdigest
    return [digest(data[4 * at : 4 * (at + size)], seed) for seed, at, size in probes(len(line), threshold)]


def words_in(line: str) -> list[str]:
    """What lies between white space; long words and scripts without spaces count by character."""
    parts = line.split()
    if max(map(len, parts), default=0) <= LONG_WORD and (line.isascii() or not UNSPACED_ANY.search(line)):
        return parts
    found: list[str] = []
    for part in parts:
        if len(part) > LONG_WORD:
            found.extend(part)
        elif part.isascii():
            found.append(part)
        else:
            found.extend(UNSPACED_PARTS.findall(part))
    return found


def numbers_in(line: str) -> str:
    return " ".join(DIGITS.findall(line))


def char_edits(length: int) -> int:
    return min(length // EDIT_CHARS, MOST_EDITS)


def word_edits(count: int) -> int:
    return count // EDIT_WORDS


@functools.lru_cache(1 << 14)
def length_probes(length: int) -> tuple[np.ndarray, int]:
    """Probes for lines that are shorter by their own threshold at most, and how many of them are index entries.

    A probe is a column: seed, start, length.
    """
    own, others = [], []
    for other in range(max(EDIT_CHARS, length - MOST_EDITS), length + 1):
        threshold, longer = char_edits(other), length - other
        if longer > threshold:
            continue
        for i, (start, size) in enumerate(segments(other, threshold)):
            before, after = i, threshold - i
            low = max(0, start - before, start + longer - after)
            high = min(length - size, start + before, start + longer + after)
            for at in range(low, high + 1):
                entry = (other * (MOST_EDITS + 1) + i, at, size)
                (own if not longer and at == start else others).append(entry)
    return np.array([*own, *others], np.int64).reshape(-1, 3).T, len(own)


class Lines:
    """Lines as one array of code points, with hashes of any of their substrings.

    The hash of a substring is a polynomial over its characters, so sums from the start give it in one step. Equal
    substrings have equal hashes wherever they are, in other batches as well.
    """

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.symbols = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")

    @functools.cached_property
    def sums(self) -> np.ndarray:
        values = _stirred_symbols()[self.symbols]
        values *= _powers(TURN, len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return sums

    @functools.cached_property
    def back(self) -> np.ndarray:
        return _powers(TURN_BACK, len(self.symbols) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _stirred((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and length of every word, line after line; the words of each line; the lines cut by ``words_in``.

        Those have long words, scripts without spaces or rare white space.
        """
        n = len(self.lines)
        kinds = _kinds()[self.symbols]
        blank = np.append(kinds == BLANK, True)
        before = np.append(True, blank[:-1])
        before[self.starts[self.lengths > 0]] = True
        after = blank.copy()
        after[:-1] = blank[1:]
        after[(self.starts + self.lengths - 1)[self.lengths > 0]] = True
        begins = np.flatnonzero(before & ~blank)
        ends = np.flatnonzero(after & ~blank) + 1
        counts = np.diff(np.searchsorted(begins, self.starts), append=len(begins))
        owner = np.repeat(np.arange(n), counts)
        sizes, hashes = ends - begins, self.hashes(begins, ends)
        odd = np.zeros(n, bool)
        odd[owner[sizes > LONG_WORD]] = True
        odd[np.searchsorted(self.starts, np.flatnonzero(kinds == RARE), side="right") - 1] = True
        if odd.any():
            numbers = np.flatnonzero(odd)
            cut = [words_in(self.lines[i]) for i in numbers.tolist()]
            inner = Lines([w for own in cut for w in own])
            kept = ~odd[owner]
            owner = np.append(owner[kept], np.repeat(numbers, [len(own) for own in cut]))
            sizes = np.append(sizes[kept], inner.lengths)
            hashes = np.append(hashes[kept], inner.hashes(inner.starts, inner.starts + inner.lengths))
            order = np.argsort(owner, kind="stable")
            owner, sizes, hashes = owner[order], sizes[order], hashes[order]
        return hashes, sizes, np.bincount(owner, minlength=n), odd


BLANK, RARE = 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point, whether it parts words or makes a line an odd one."""
    found = np.zeros(0x110000, np.uint8)
    for low, high in (*ODD_LOW, *ODD_HIGH):
        found[low : high + 1] = RARE
    found[[32, *range(9, 14)]] = BLANK
    return found


@functools.cache
def _stirred_symbols() -> np.ndarray:
    return _stirred(np.arange(1, 0x110001, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    return _kept_powers(base)[:n] if n <= POWERS_KEPT else _all_powers(base, n)


@functools.cache
def _kept_powers(base: int) -> np.ndarray:
    return _all_powers(base, POWERS_KEPT)


def _all_powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found, out=found)


def _stirred(codes: np.ndarray) -> np.ndarray:
    codes = codes ^ codes >> np.uint64(29)
    codes *= MIX
    codes ^= codes >> np.uint64(32)
    return codes


def plain_lines(sizes: np.ndarray, counts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Lines of many words none of which can become a long one by two edits, even if three become one."""
    three = np.convolve(sizes, np.ones(3, np.int64))[: len(sizes)]
    # The first two words of a line also take in some of the line before, which only adds.
    starts = np.cumsum(counts) - counts
    widest = np.zeros(len(counts), np.int64)
    some = counts > 0
    if some.any():
        widest[some] = np.maximum.reduceat(three, starts[some])
    return (counts >= PLAIN_WORDS) & (widest + 2 <= LONG_WORD) & ~odd


def length_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes under which lines meet those within their threshold: line number, hash, whether it is an index entry."""
    held = Lines(lines)
    words, sizes, counts, odd = held.words()
    owner, grams = gram_keys(words, counts)
    cut = np.flatnonzero(~plain_lines(sizes, counts, odd))
    # The probes of every length once, then those of each line.
    lengths, kind = np.unique(held.lengths[cut], return_inverse=True)
    found = [length_probes(length) for length in lengths.tolist()]
    probes_of = np.array([entries.shape[1] for entries, _ in found], np.int64)
    seeds, at, size = np.concatenate([np.zeros((3, 0), np.int64), *(entries for entries, _ in found)], axis=1)
    n = probes_of[kind]
    chosen = ragged((np.cumsum(probes_of) - probes_of)[kind], n)
    indexed = np.array([own for _, own in found], np.int64)[kind]
    numbers = [numbers_in(lines[i]) for i in cut.tolist()]
    mixed = np.array([xxhash.xxh64_intdigest(x.encode()) if x else 0 for x in numbers], np.uint64)
    starts = np.repeat(held.starts[cut], n) + at[chosen]
    seeded = seeds[chosen].astype(np.uint64) * np.uint64(TURN) ^ np.repeat(mixed, n)
    probed = _stirred(held.hashes(starts, starts + size[chosen]) + seeded)
    place = np.arange(len(chosen)) - np.repeat(np.cumsum(n) - n, n)
    return (
        np.append(owner, np.repeat(cut, n)),
        np.append(grams, probed),
        np.append(np.ones(len(owner), bool), place < np.repeat(indexed, n)),
    )


def gram_keys(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line number and the smallest hash of each window of runs of words, for lines of ``EDIT_WORDS`` words or more."""
    lines = np.flatnonzero(counts >= EDIT_WORDS)
    if not len(lines):
        return lines, np.zeros(0, np.uint64)
    sizes = counts[lines]
    flat = _stirred(words[np.repeat(counts >= EDIT_WORDS, counts)] + np.uint64(GRAM_SEED))
    # A run's hash mixes those of its words, each turned by its place.
    runs = np.zeros(len(flat) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        runs *= np.uint64(TURN)
        runs += flat[k : k + len(runs)]
    runs = _stirred(runs)
    starts = np.cumsum(sizes) - sizes
    owners, found = [], []
    above = np.iinfo(np.int64).max
    for least, window in WINDOWS:
        chosen = np.flatnonzero((sizes >= least) & (sizes < above))
        above = least
        if not len(chosen):
            continue
        windows = sizes[chosen] - GRAM - window + 2
        at = ragged(starts[chosen], windows)
        smallest = _least_of(runs, window)[at]
        owner = np.repeat(lines[chosen], windows)
        fresh = np.append(True, (smallest[1:] != smallest[:-1]) | (owner[1:] != owner[:-1]))[: len(owner)]
        owners.append(owner[fresh])
        found.append(smallest[fresh])
    owner, keys = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort([keys, owner])
    owner, keys = owner[order], keys[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
    return owner[fresh], keys[fresh]


def _least_of(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest value of each window, from windows of doubled length."""
    found, width = values, 1
    while width < window:
        step = min(width, window - width)
        found = np.minimum(found[: len(found) - step], found[step:])
        width += step
    return found


def near_words(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance over words is within the threshold of the shorter list."""
    if len(a) > len(b):
        a, b = b, a
    most = word_edits(len(a))
    if len(b) - len(a) > most:
        return False
    low, n = 0, len(a)
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[n - 1 - high] == b[len(b) - 1 - high]:
        high += 1
    a, b = a[low : n - high], b[low : len(b) - high]
    if not a or len(b) <= most:
        return len(b) <= most
    # Bit-parallel over the whole of a, in Python's long integers.
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    last = 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for column, word in enumerate(b):
        match = places.get(word, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        distance += bool(up & last) - bool(down & last)
        if distance - (len(b) - 1 - column) > most:
            return False
        up = up << 1 | 1
        plus = (down << 1 | ~(diagonal | up)) & full
        minus = diagonal & up & full
    return distance <= most


def within(a: str, b: str) -> bool:
    """Whether two lines are linked under the threshold by length."""
    if a == b:
        return bool(a.strip(quality.SPACES))
    least = char_edits(min(len(a), len(b)))
    if least and abs(len(a) - len(b)) <= least and numbers_in(a) == numbers_in(b):
        lengths = np.array([len(a), len(b)])
        symbols = np.frombuffer((a + b).encode("utf-32-le"), "<u4")
        one, two = np.array([0]), np.array([1])
        if distances(symbols, np.array([0, len(a)]), lengths, one, two, MOST_EDITS)[0] <= least:
            return True
    first, second = words_in(a), words_in(b)
    return min(len(first), len(second)) >= EDIT_WORDS and near_words(first, second)


def distances(
    symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int
) -> np.ndarray:
    """Edit distances of pairs of lines, ``threshold + 1`` where they are larger.

    Bit-parallel within the band of the diagonals -threshold to threshold: bit 63 is the lowest row of the band, and
    each column moves the band down by one row. While the band's end has not reached the last row, the distance is
    followed along the lowest diagonal, then along the last row.
    """
    result = np.full(len(a), threshold + 1, np.int64)
    lower, upper = np.minimum(lengths[a], lengths[b]), np.maximum(lengths[a], lengths[b])
    left = np.flatnonzero((upper - lower <= threshold) & (lower > threshold))
    # Long pairs last, so that those still active are the end of each array.
    left = left[np.argsort(lengths[b[left]], kind="stable")]
    rows, columns = lengths[a[left]], lengths[b[left]]
    row_at, column_at = starts[a[left]], starts[b[left]]
    n = len(left)
    if not n:
        return result
    one, band = np.uint64(1), 2 * threshold + 1
    plus = np.full(n, ((1 << (threshold + 1)) - 1) << (63 - threshold), np.uint64)
    minus = np.zeros(n, np.uint64)
    distance = np.full(n, threshold, np.int64)
    alive = np.arange(n)
    column = 0
    while len(alive):
        at = column - threshold + np.arange(band)
        inside = (at[:, None] >= 0) & (at[:, None] < rows[alive])
        cells = symbols[np.where(inside, row_at[alive] + at[:, None], 0)]
        equal = inside & (cells == symbols[column_at[alive] + column])
        match = np.zeros(len(alive), np.uint64)
        for k in range(band):
            match |= equal[k].astype(np.uint64) << np.uint64(64 - band + k)
        vp, vn = plus[alive], minus[alive]
        diagonal = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(diagonal | vp)
        hn = diagonal & vp
        falling = column < rows[alive] - threshold
        # Bit of the last row once the band has reached it.
        last = np.where(falling, 63, 62 - (column - (rows[alive] - threshold))).astype(np.uint64)
        distance[alive] += np.where(
            falling,
            1 - (diagonal >> np.uint64(63)).astype(np.int64),
            ((hp >> last) & one).astype(np.int64) - ((hn >> last) & one).astype(np.int64),
        )
        shifted = diagonal >> one
        plus[alive] = hn | ~(shifted | hp)
        minus[alive] = shifted & hp
        column += 1
        done = column >= columns[alive]
        result[left[alive[done]]] = np.minimum(distance[alive[done]], threshold + 1)
        # The lowest diagonal never falls; the last row falls by one for each column left at most.
        open_columns = columns[alive] - column
        hopeless = distance[alive] > threshold + np.minimum(open_columns, 2 * threshold)
        alive = alive[~done & ~hopeless]
    return result


def line_classes(
    frame: DataFrame,
    threshold: int | None = None,
    least_chars: int = LEAST_CHARS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per line: key, ``line_no`` (from 0), ``first_doc`` and ``first_line``, and ``kept``.

    The class of a line is what links connect; its first line in order of key and number names it, and only that one
    is kept. Lines of fewer than ``least_chars`` code points are never linked nor equal, hence always kept. A NULL
    text has no lines; an empty text has one empty line. A NULL key comes first. Rows that repeat key and text repeat
    the result. Other columns are not read; an empty table gives no rows. A text is held as a whole while it is split.

    Without a ``threshold`` it grows with the line: every line that is not blank belongs to a class, whatever its
    length, and ``least_chars`` is not used. Blank lines are kept.
    """
    if threshold is None:
        least_chars = EDIT_CHARS  # shorter ones have no edits; their digests meet
    elif least_chars <= threshold:
        raise ValueError("lines must be longer than the threshold")
    docs = frame.select(frame[key].alias("key"), frame[text].cast("string").alias("text"))
    lines = docs.select("key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    classed = F.length("line") >= least_chars if threshold is not None else F.ltrim("line", F.lit(quality.SPACES)) != ""
    places = written(
        lines.select("key", "line_no", F.when(classed, F.unhex(F.md5("line"))).alias("digest")), "line-places"
    )
    classes = components(line_links(docs, threshold, least_chars))

    named = places.filter(F.col("digest").isNotNull())
    first = named.groupBy("digest").agg(F.min(F.struct("key", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    joined = first.join(classes, first.digest == classes.node, "left").withColumn(
        "class", F.coalesce("component", "digest")
    )
    # Only classes of several lines need their first line looked for, only lines in company its name.
    several = joined.filter(F.col("component").isNotNull())
    least = once_per_key(several, "class", F.min("first").alias("class_first")).withColumnRenamed("class", "of")
    heads = (
        joined.filter("n != 1 or component is not null")
        .join(least, F.col("class") == F.col("of"), "left")
        .select(F.col("digest").alias("line"), F.coalesce("class_first", "first").alias("head"))
    )
    heads = once_per_key(heads, "line", F.min("head").alias("head"))
    own = F.struct(F.col("key"), F.col("line_no"))
    found = (
        named.join(heads, named.digest == heads.line, "left")
        .select("key", "line_no", F.coalesce("head", own).alias("head"))
        .unionByName(places.filter(F.col("digest").isNull()).select("key", "line_no", own.alias("head")))
    )
    return found.select(
        F.col("key").alias(key),
        "line_no",
        F.col("head.key").alias("first_doc"),
        F.col("head.line_no").alias("first_line"),
        (F.col("key").eqNullSafe(F.col("head.key")) & (F.col("line_no") == F.col("head.line_no"))).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs``, their texts without the lines that ``classes`` does not keep.

    A text that loses nothing stays as it is; one that loses every line becomes ''. NULL texts and keys, repeated rows
    and other columns stay; an empty table gives none.
    """
    dropped = (
        classes.filter(~F.col("kept")).groupBy(F.col(key).alias("of")).agg(F.collect_set("line_no").alias("dropped"))
    )
    # The rows in a struct, so that no name of theirs meets one of these. A text is shuffled once.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[key].alias("place"))
    joined = rows.join(dropped, F.col("place").eqNullSafe(F.col("of")), "left").withColumn(
        "whole", F.col(f"row.`{text}`")
    )
    # Both lists of line numbers are hashed once, so the work is linear in the lines of a document.
    lines = F.split("whole", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    cleaned = F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    found = joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), lines))
    return found.select(*((cleaned if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def line_links(docs: DataFrame, threshold: int | None, least_chars: int) -> DataFrame:
    """Links between the MD5 digests of lines, as many as connect what is connected: columns a, b."""
    # Copies are combined within a partition before any line is shuffled. Lines and keys are each used twice and
    # shuffled once: both uses read all columns, and no column can be NULL, so that no join filters one use alone.
    lines = (
        docs.select("text")
        .mapInArrow(functools.partial(_distinct_lines, least_chars), _filled("id long, line string"))
        .repartition("id")
        .distinct()
    )
    conf = docs.sparkSession.conf
    shuffled = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    parts = PARTS * int(shuffled or conf.get("spark.sql.shuffle.partitions"))
    entries = lines.mapInArrow(
        functools.partial(_key_rows, threshold, parts), _filled("part int, numbers binary, entries binary")
    ).repartition("part")
    # Of keys with the very same lines one is enough: near copies share many. Such keys have one crowd.
    met = (
        entries.sortWithinPartitions("part")
        .mapInArrow(_crowds, _filled("number long, own boolean, lines long, line_id long"))
        .repartition("line_id")
        .distinct()
        .withColumn("blocks", F.ceil(F.col("lines") / BLOCK).cast("int"))
    )
    placed = met.join(lines, F.col("line_id") == F.col("id")).withColumn(
        "block", F.pmod(F.xxhash64("line"), F.col("blocks").cast("long")).cast("int")
    )
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "number", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "own", "line",
    )
    return (
        paired.repartition(*GROUP)
        .sortWithinPartitions(*GROUP)
        .mapInArrow(functools.partial(_group_links, threshold), "a binary, b binary")
    )


GROUP = ["number", "low", "high"]
KEY_WIDTH = 6  # bytes of a key's number, and of an entry
ID = (1 << 47) - 1  # the bits of an entry that name its line; lines that share them only meet
OWN = 1 << 47  # whether it belongs to the index


def _filled(columns: str) -> StructType:
    """Columns that are never NULL."""
    return StructType([StructField(f.name, f.dataType, False) for f in StructType.fromDDL(columns)])


@released
def _distinct_lines(least_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for low in range(0, len(texts), 500):
            lines = pc.unique(pc.split_pattern(texts.slice(low, 500), "\n").flatten())
            chosen = lines.filter(pc.greater_equal(pc.utf8_length(lines), least_chars))
            new: dict[bytes, bytes] = {}
            for line in chosen.cast(pa.binary()).to_pylist():
                digest = hashlib.md5(line, usedforsecurity=False).digest()
                if digest not in seen:
                    new[digest] = line
            if len(seen) > SEEN_LINES:
                seen.clear()
            seen.update(new)
            ids = np.frombuffer(b"".join(new), "<i8")[::2] & ID
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([*new.values()], pa.binary()).cast(pa.string())], names=["id", "line"]
            )


@released
def _key_rows(threshold: int | None, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of all lines by part, as many to a row as come at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in gathered(batches, "line", KEY_BYTES, SENT_ROWS):
        texts = batch.column("line").to_pylist()
        ids = batch.column("id").to_numpy()
        if threshold is None:
            owner, numbers, own = length_keys(texts)
        else:
            found = [keys_of(line, threshold) for line in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            numbers = np.fromiter((k for keys in found for k in keys), np.uint64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(found)), sizes)
            own = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= threshold
        held.append((numbers >> np.uint64(64 - 8 * KEY_WIDTH), np.where(own, ids[owner] | OWN, ids[owner])))
        count += len(owner)
        if count >= SENT_KEYS:
            yield _parted(held, parts)
            held, count = [], 0
    if count:
        yield _parted(held, parts)


def _parted(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    numbers, entries = (np.concatenate(x) for x in zip(*held))
    part = numbers % np.uint64(parts)
    order = np.argsort(part)
    part = part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    offsets = pa.py_buffer((KEY_WIDTH * np.append(starts, len(part))).astype(np.int32))
    columns = [
        pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(_narrow(x[order]))])
        for x in (numbers, entries)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[starts].astype(np.int32)), *columns], names=["part", "numbers", "entries"]
    )


def _narrow(values: np.ndarray) -> np.ndarray:
    """The lowest bytes of 64-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_WIDTH])


def _wide(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows of ``_narrow`` bytes."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEY_WIDTH)
    found = np.zeros((len(data), 8), np.uint8)
    found[:, :KEY_WIDTH] = data
    return found.view("<u8").ravel()


@released
def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each key that has two or more, one of them in the index, under a number made from these lines."""
    for table in grouped_runs(batches, ["part"]):
        numbers, entries = _wide(table["numbers"]), _wide(table["entries"])
        order = np.argsort(numbers)
        numbers = numbers[order]
        again = numbers[1:] == numbers[:-1]
        chosen = np.append(again, False)
        chosen[1:] |= again
        numbers, entries = numbers[chosen], entries[order[chosen]]
        if not len(numbers):
            continue
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        sizes = np.diff(starts, append=len(numbers))
        own = entries >= OWN
        crowd = _stirred(np.add.reduceat(_stirred(entries), starts) + sizes.astype(np.uint64))
        kept = np.repeat(np.logical_or.reduceat(own, starts), sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(crowd, sizes)[kept].view(np.int64)), pa.array(own[kept]),
             pa.array(np.repeat(sizes, sizes)[kept]), pa.array((entries & np.uint64(ID))[kept].view(np.int64))],
            names=["number", "own", "lines", "line_id"],
        )


@released
def _group_links(threshold: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups are compared many at a time, as far as memory and ``PAIRS`` allow: most hold two or three lines."""
    if threshold is None:
        for table, cuts in whole_groups(batches, GROUP):
            for low, high in _portions(table, cuts):
                lines, pairs = _length_pairs(table.slice(cuts[low], cuts[high] - cuts[low]), cuts[low : high + 1])
                yield _length_links(lines, pairs)
        return
    lines: dict[str, int] = {}
    pairs: list[np.ndarray] = []
    held = size = 0
    for group in grouped_runs(batches, GROUP):
        found = _pairs(group, lines, threshold)
        pairs.append(found)
        held += found.shape[1]
        size += pc.sum(pc.binary_length(group["line"])).as_py()
        if held > PAIRS or size > HELD_BYTES:
            yield _links([*lines], pairs, threshold)
            lines, pairs, held, size = {}, [], 0, 0
    if held:
        yield _links([*lines], pairs, threshold)


def _portions(table: pa.Table, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of groups of at most ``HELD_BYTES`` of text and about ``8 * PAIRS`` pairs; a larger group is alone."""
    bytes_to = np.append(0, np.cumsum(pc.binary_length(table["line"]).to_numpy()))[cuts]
    pairs_to = np.append(0, np.cumsum(np.diff(cuts) ** 2 // 2))
    low = 0
    while low < len(cuts) - 1:
        high = min(
            np.searchsorted(bytes_to, bytes_to[low] + HELD_BYTES, side="right"),
            np.searchsorted(pairs_to, pairs_to[low] + 8 * PAIRS, side="right"),
        )
        high = max(low + 1, int(high) - 1)
        yield low, high
        low = high


def _pairs(group: pa.Table, lines: dict[str, int], threshold: int) -> np.ndarray:
    """Pairs of a group that may be linked, as numbers in ``lines``, which grows."""
    own = group["own"].to_numpy()
    texts = group["line"].to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = lengths[None, :] - lengths[:, None]  # of the column's line over the row's
    return _numbered(group, texts, lines, own[:, None] & (gap >= 0) & (gap <= threshold))


def _length_pairs(table: pa.Table, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct lines of many groups, and the pairs of each group that may be linked, as numbers of lines."""
    coded = plain(table["line"]).dictionary_encode()
    lines, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    own, block = table["own"].to_numpy(), table["block"].to_numpy()
    across = table["low"].to_numpy() != table["high"].to_numpy()
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))[numbers]
    most = np.minimum(lengths // EDIT_CHARS, MOST_EDITS)
    starts, sizes = cuts[:-1] - cuts[0], np.diff(cuts)
    words = np.repeat(np.logical_and.reduceat(own, starts), sizes)  # only then the key may be one of words
    found = [np.zeros((2, 0), np.int64)]
    for n in np.unique(sizes[sizes > 1]).tolist():
        one, two = np.triu_indices(n, 1)
        base = starts[sizes == n][:, None]
        i, j = (base + one).ravel(), (base + two).ravel()
        gap = lengths[j] - lengths[i]
        wanted = words[i] | (own[i] & (gap >= 0) & (gap <= most[i])) | (own[j] & (gap <= 0) & (-gap <= most[j]))
        wanted &= (numbers[i] != numbers[j]) & (~across[i] | (block[i] != block[j]))
        found.append(np.stack([numbers[i[wanted]], numbers[j[wanted]]]))
    return lines, np.concatenate(found, axis=1)


def _numbered(group: pa.Table, texts: list[str], lines: dict[str, int], wanted: np.ndarray) -> np.ndarray:
    block = group["block"].to_numpy()
    if group["low"][0].as_py() != group["high"][0].as_py():
        wanted &= block[:, None] != block[None, :]
    numbers = np.fromiter((lines.setdefault(t, len(lines)) for t in texts), np.int64, len(texts))
    i, j = np.nonzero(wanted)
    found = np.stack([numbers[i], numbers[j]])
    return found[:, found[0] != found[1]]


def _links(lines: list[str], pairs: list[np.ndarray], threshold: int) -> pa.RecordBatch:
    """Links among the pairs that keep connected lines connected."""
    n = len(lines)
    both = np.concatenate(pairs, axis=1)
    codes = np.unique(both.min(axis=0) * n + both.max(axis=0))
    lengths = np.fromiter(map(len, lines), np.int64, n)
    symbols = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    starts = np.cumsum(lengths) - lengths
    tree = list(range(n))

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = i = tree[tree[i]]
        return i

    links: list[tuple[bytes, bytes]] = []
    for low in range(0, len(codes), PAIRS):
        a, b = codes[low : low + PAIRS] // n, codes[low : low + PAIRS] % n
        near = distances(symbols, starts, lengths, a, b, threshold) <= threshold
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            if root(x) != root(y):
                tree[root(x)] = root(y)
                links.append((lines[x], lines[y]))
    return _named(links)


def _length_links(lines: list[str], both: np.ndarray) -> pa.RecordBatch:
    """Links among the pairs under the threshold by length; pairs that are connected already are not compared."""
    n = len(lines)
    codes = np.unique(both.min(axis=0) * n + both.max(axis=0))
    held = Lines(lines)
    lengths, symbols, starts = held.lengths, held.symbols, held.starts
    most = np.minimum(lengths // EDIT_CHARS, MOST_EDITS)
    spoken_words, _, counts, _ = held.words()
    word_starts = np.cumsum(counts) - counts
    words = functools.cache(lambda number: words_in(lines[number]))
    most_words = np.where(counts >= EDIT_WORDS, counts // EDIT_WORDS, -1)
    # An edit moves one character, or one word, from one bucket to another at most.
    firsts, seconds = codes // n, codes % n
    least = np.minimum(most[firsts], most[seconds])
    close = (least > 0) & (np.abs(lengths[firsts] - lengths[seconds]) <= least)
    asked = np.unique(np.append(firsts[close], seconds[close]))
    letters = _bags(asked, lengths[asked], symbols[ragged(starts[asked], lengths[asked])], n)
    spoken = _bags(np.arange(n), counts, spoken_words, n)
    tree = np.arange(n)  # every line's class, by its number
    members = {}
    links: list[tuple[bytes, bytes]] = []

    def join(x: int, y: int) -> None:
        links.append((lines[x], lines[y]))
        x, y = int(tree[x]), int(tree[y])
        mine, other = members.pop(x, [x]), members.pop(y, [y])
        if len(mine) < len(other):
            x, mine, other = y, other, mine
        tree[other] = x
        members[x] = mine + other

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        apart = tree[x] != tree[y]
        x, y = x[apart], y[apart]
        least = np.minimum(most[x], most[y])
        near = (least > 0) & (np.abs(lengths[x] - lengths[y]) <= least) & (_apart(letters, x, y) <= 2 * least)
        at = np.flatnonzero(near)
        near[at] = distances(*_middles(symbols, starts, lengths, x[at], y[at]), MOST_EDITS) <= least[at]
        edits = np.minimum(most_words[x], most_words[y])
        alike = (np.abs(counts[x] - counts[y]) <= edits) & (_apart(spoken, x, y) <= 2 * edits)
        sure = np.zeros(len(x), bool)
        at = np.flatnonzero(alike)
        sure[at] = _most_edits(spoken_words, word_starts, counts, x[at], y[at]) <= edits[at]
        for k in np.flatnonzero(near | alike).tolist():
            a, b = int(x[k]), int(y[k])
            if tree[a] != tree[b] and (
                (near[k] and numbers_in(lines[a]) == numbers_in(lines[b])) or (alike[k] and (sure[k] or near_words(words(a), words(b))))
            ):
                join(a, b)

    # Large runs of one line first: they connect most of a group, and its other pairs need no look.
    cuts = np.flatnonzero(np.diff(firsts, prepend=-1, append=n))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if high - low >= 64:
            compare(firsts[low:high], seconds[low:high])
    for low in range(0, len(codes), PAIRS):
        compare(firsts[low : low + PAIRS], seconds[low : low + PAIRS])
    return _named(links)


BUCKETS = 128


def _bags(rows: np.ndarray, sizes: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many of the codes of each given row fall into each bucket; none for the others of ``n`` rows."""
    buckets = np.repeat(np.arange(len(rows)) * BUCKETS, sizes)
    buckets += (codes & codes.dtype.type(BUCKETS - 1)).astype(np.int64)
    found = np.zeros((n, BUCKETS), np.int32)
    found[rows] = np.bincount(buckets, minlength=len(rows) * BUCKETS).reshape(len(rows), BUCKETS)
    return found


def _apart(bags: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many codes the bags of pairs differ; half of it is a lower bound of their edits."""
    found = [
        np.abs(bags[x[low : low + 4096]] - bags[y[low : low + 4096]]).sum(axis=1) for low in range(0, len(x), 4096)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _most_edits(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An upper bound of the edits of words of pairs of lines that have words.

    The longer line leaves out one run of words, wherever that is best; then words are replaced place by place.
    """
    found = np.zeros(len(x), np.int64)
    for low in range(0, len(x), 4096):
        a, b = x[low : low + 4096], y[low : low + 4096]
        turned = counts[a] > counts[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        n, gap = counts[a], counts[b] - counts[a]
        own = words[ragged(starts[a], n)]
        before = (own != words[ragged(starts[b], n)]).astype(np.int64)
        after = (own != words[ragged(starts[b] + gap, n)]).astype(np.int64)
        begins = np.cumsum(n) - n
        change = np.append(0, np.cumsum(before - after))
        least = np.minimum(change[begins], np.minimum.reduceat(change[1:], begins)) - change[begins]
        found[low : low + 4096] = gap + np.add.reduceat(after, begins) + least
    return found


def _middles(
    symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, x: np.ndarray, y: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Pairs without what they begin and end with in common, but for a few characters: their distance is the same.

    Returns symbols, starts, lengths and the numbers of both sides, as ``distances`` takes them.
    """
    n = len(x)
    shorter = np.minimum(lengths[x], lengths[y])
    begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for found, sign in ((begin, 1), (end, -1)):
        base_x, base_y = (starts[v] + (lengths[v] - 1 if sign < 0 else 0) for v in (x, y))
        active, width = np.arange(n), 64
        while len(active):
            probe = np.minimum(width, shorter[active] - found[active])
            steps = ragged(found[active], probe) * sign
            same = symbols[np.repeat(base_x[active], probe) + steps] == symbols[np.repeat(base_y[active], probe) + steps]
            low = np.cumsum(probe) - probe
            first = np.append(np.where(same, len(same), np.arange(len(same))), len(same))
            first = np.where(probe > 0, np.minimum.reduceat(first, low), len(same))
            run = np.minimum(first - low, probe)
            found[active] += run
            active = active[(run == probe) & (found[active] < shorter[active])]
            width *= 2
    # The distance is followed over lines longer than the threshold.
    begin = np.maximum(0, np.minimum(begin, shorter) - MOST_EDITS - 1)
    end = np.maximum(0, np.minimum(end, shorter - begin - MOST_EDITS - 1))
    cut = begin + end
    both = np.append(starts[x] + begin, starts[y] + begin), np.append(lengths[x] - cut, lengths[y] - cut)
    first, second = np.arange(n), n + np.arange(n)
    # Shorter line first.
    turned = both[1][first] > both[1][second]
    first, second = np.where(turned, second, first), np.where(turned, first, second)
    return symbols, *both, first, second


def _named(links: list[tuple[str, str]]) -> pa.RecordBatch:
    names = [[hashlib.md5(link[k].encode(), usedforsecurity=False).digest() for link in links] for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in names], names=["a", "b"])
