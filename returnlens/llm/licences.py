"""Licence scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Words are runs of letters and digits in lower case; shingles are five words, windows are runs of shingles. A template
of m shingles is looked for with windows of v shingles, the largest power of two whose windows, half a window apart,
must have one wholly inside any copy of it; all windows of v shingles of the template are known. So a copy has a
window with similarity 1, which always collides. Windows that share a fraction s of their shingles collide in one of
the 8 bands of 2 minima with probability 1 - (1 - s * s) ** 8: 0.99 for 0.66, 0.9997 for 0.8.

A retrieved place is kept when the text around it (the template's length and a quarter of it on both sides) holds at
least ``containment`` of the template's shingles, compared exactly by their words' hashes. The templates are a small
parameter, checked against ``MOST_ENTRIES`` and sent to every task; texts are never shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from returnlens.llm.licence_templates import TEMPLATES
from returnlens.llm.shared import Runs, slices, split_codes, texts_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 8, 2
MOST_ENTRIES = 2_000_000
SLICE_BYTES = 1 << 20
WORD = re.compile(r"[^\W_]+")
_random = np.random.default_rng(7)
MULTIPLIERS = _random.integers(1, 1 << 62, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _random.integers(1, 1 << 62, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in WORD.findall(text.lower())]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the five words at each place but the last four."""
    n = max(0, len(words) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total = (total ^ (words[i : i + n] * MIXERS[i])) * MIXERS[SHINGLE]
        total ^= total >> np.uint64(29)
    return total


def window_minima(shingles: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """MinHash values of the windows of 1, 2, 4, ... shingles at every place, up to ``width``."""
    minima = shingles[None, :] * MULTIPLIERS[:, None]
    minima ^= minima >> np.uint64(31)
    size = 1
    while True:
        yield size, minima
        size *= 2
        if size > width or minima.shape[1] <= size // 2:
            return
        minima = np.minimum(minima[:, : -(size // 2)], minima[:, size // 2 :])


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band and window: bands in rows."""
    keys = minima[0::ROWS] * MIXERS[6] + minima[1::ROWS] * MIXERS[7]
    return keys ^ (keys >> np.uint64(32)) ^ np.arange(BANDS, dtype=np.uint64)[:, None]


def width_of(shingles: int) -> int:
    """Largest power of two whose windows, half a window apart, have one inside any run of so many shingles."""
    width = 1
    while 2 * width + width - 1 <= shingles:
        width *= 2
    return width


@dataclass(frozen=True)
class _Level:
    """Band keys of the template windows of one width, with template and place of each."""

    keys: np.ndarray
    template: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # by the top 16 bits of a key


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.shingles = [shingle_hashes(np.array(word_hashes(templates[n]), np.uint64)) for n in self.names]
        if any(len(s) == 0 for s in self.shingles):
            raise ValueError("a template needs five words at least")
        self.sets = [np.unique(s) for s in self.shingles]
        if sum(map(len, self.shingles)) * BANDS > MOST_ENTRIES:
            raise ValueError("too many templates to send to every task")
        found: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for number, shingles in enumerate(self.shingles):
            width = width_of(len(shingles))
            for size, minima in window_minima(shingles, width):
                if size == width:
                    keys = band_keys(minima)
                    places = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
                    found.setdefault(size, []).append((keys.ravel(), number, places.ravel()))
        self.levels: dict[int, _Level] = {}
        for size, parts in found.items():
            keys = np.concatenate([p[0] for p in parts])
            owner = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
            place = np.concatenate([p[2] for p in parts])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[keys >> np.uint64(48)] = True
            self.levels[size] = _Level(keys[order], owner[order], place[order], seen)
        self.width = max(self.levels, default=1)

    def candidates(self, shingles: np.ndarray) -> set[tuple[int, int]]:
        """Template and supposed start of it, for every window that collides with one of its windows."""
        out: set[tuple[int, int]] = set()
        for size, minima in window_minima(shingles, self.width):
            level = self.levels.get(size)
            if level is None:
                continue
            stride = max(1, size // 2)
            keys = band_keys(minima[:, ::stride])
            if size == 1:
                keys = keys[:1]  # one shingle: all bands say the same
            band, window = np.nonzero(level.seen[keys >> np.uint64(48)])
            chosen = keys[band, window]
            low = np.searchsorted(level.keys, chosen, "left")
            high = np.searchsorted(level.keys, chosen, "right")
            for w, a, b in zip(window[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for at in range(a, b):
                    out.add((int(level.template[at]), w * stride - int(level.place[at])))
        return out

    def matches(self, words: np.ndarray, containment: float) -> list[tuple[int, int, float]]:
        """Template, first word and containment of its best place in one text."""
        shingles = shingle_hashes(words)
        best: dict[int, tuple[float, int]] = {}
        for number, start in sorted(self.candidates(shingles)) if len(shingles) else []:
            wanted = self.sets[number]
            slack = len(self.shingles[number]) // 4
            region = shingles[max(0, start - slack) : max(0, start + len(self.shingles[number]) + slack)]
            share = len(np.intersect1d(region, wanted)) / len(wanted)
            if share >= containment and share > best.get(number, (0.0, 0))[0]:
                best[number] = (share, max(0, start))
        return [(number, at, share) for number, (share, at) in sorted(best.items())]


def licence_matches(
    frame: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per text and template it holds: key, ``template``, ``first_word`` (from 0) and ``containment``.

    ``first_word`` is where the best match begins, the first of equals. NULL, empty and short texts match nothing.
    Repeated rows and NULL keys give rows of their own; other columns are not read.
    """
    docs = frame.select(frame[key].alias("key"), frame[text].cast("string").alias("text"))
    out = StructType(
        [
            StructField("key", docs.schema["key"].dataType),
            *StructType.fromDDL("template string, first_word long, containment double").fields,
        ]
    )
    index = Index(templates)
    return docs.mapInArrow(functools.partial(_scanned, index, containment), out).withColumnRenamed("key", key)


def _scanned(index: Index, containment: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        texts = texts_of(whole.column("text"))
        keys = whole.column("key")
        rows: list[int] = []
        found: list[tuple[int, int, float]] = []
        for low, high in slices(texts, SLICE_BYTES):
            codes, bounds, parts = split_codes(texts.slice(low, high - low))
            runs = Runs(np.uint64)
            hashed = [word_hashes(p) for p in parts]
            runs.extend(
                np.array([h for hashes in hashed for h in hashes], np.uint64),
                np.fromiter(map(len, hashed), np.int64, len(hashed)),
            )
            words, lengths = runs.take(codes)
            ends = np.append(0, np.cumsum(lengths))[bounds]
            for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                for match in index.matches(words[a:b], containment):
                    rows.append(low + row)
                    found.append(match)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(rows)),
                    pa.array([index.names[n] for n, _, _ in found], pa.string()),
                    pa.array([at for _, at, _ in found], pa.int64()),
                    pa.array([share for _, _, share in found], pa.float64()),
                ],
                names=["key", "template", "first_word", "containment"],
            )
