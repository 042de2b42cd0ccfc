"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by shares and means of its characters, words and lines (``FEATURES``), so no language and no word
list is built in. Each feature is cut into bins. Boosting visits the features in turn, round after round; a visit fits
a tree of at most three leaves to what the other features leave unexplained, and adds a small part of it to the
feature's lookup table. The pairs of features that explain most of the rest get tables over two coarse grids the same
way. The log odds of a text are the bias plus one entry of each table, added for many texts at once.

The model is fitted on a bounded, documented sample: of the labelled ids of the training fold, the ``rows`` with the
smallest hash, one text each. Scoring reads every whole text; it is a projection, without a shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.llm.shared import plain, slices, split_codes, texts_of

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
SLICE_BYTES = 4 << 20
BINS = 64
GRID = 12  # bins of a feature in a pair
PAIRS = 8
ROUNDS, PAIR_ROUNDS = 150, 60
RATE = 0.1
RIDGE = 1.0  # added to a leaf's second derivatives
LEAST_LEAF = 2.0  # second derivatives in a leaf

FEATURES = (
    "log_bytes",
    "upper_share",
    "digit_share",
    "stop_share",
    "symbol_share",
    "shout_share",
    "space_share",
    "beyond_ascii_share",
    "line_share",
    "word_bytes",
    "capital_words",
    "distinct_words",
    "repeated_neighbours",
    "most_frequent_word",
    "distinct_lines",
    "class_changes",
)

# Kinds of bytes, as counted for the features. Fixed values.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*|<>@^~=+_{}[]\\/",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
}
OTHER, BEYOND = len(KINDS), len(KINDS) + 1  # other ASCII; parts of longer characters
KIND_OF = np.full(256, OTHER, np.uint8)
KIND_OF[128:] = BEYOND
for _kind, _bytes in enumerate(KINDS.values()):
    KIND_OF[list(_bytes)] = _kind


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text (64-bit offsets, no NULL); an empty text has zeros."""
    n = len(texts)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    kinds, offsets = KIND_OF[raw], offsets - offsets[0]
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * (BEYOND + 1) + kinds, minlength=n * (BEYOND + 1)).reshape(n, -1).astype(float)
    of = {name: counts[:, i] for i, name in enumerate([*KINDS, "other", "beyond"])}
    changed = np.append(kinds[1:] != kinds[:-1], False)[: len(kinds)]
    changed[offsets[1:][offsets[1:] > 0] - 1] = False
    blank = (kinds == list(KINDS).index("space")) | (kinds == list(KINDS).index("line"))
    opens = np.append(True, blank[:-1]) & ~blank if len(kinds) else np.zeros(0, bool)
    firsts = offsets[:-1][size > 0]
    opens[firsts] = ~blank[firsts]
    words = np.bincount(row[opens], minlength=n).astype(float)
    capitals = np.bincount(row[opens & (kinds == 0)], minlength=n)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    letters = of["upper"] + of["lower"]
    found = {
        "log_bytes": np.log1p(size),
        "upper_share": share(of["upper"], letters),
        "digit_share": share(of["digit"], size),
        "stop_share": share(of["stop"], words),
        "symbol_share": share(of["symbol"], words),
        "shout_share": share(of["shout"], words),
        "space_share": share(of["space"], size),
        "beyond_ascii_share": share(of["beyond"], size),
        "line_share": share(of["line"], words),
        "word_bytes": share(size - of["space"] - of["line"], words),
        "capital_words": share(capitals, words),
        "class_changes": share(np.bincount(row[changed], minlength=n), size),
    }
    codes, bounds, _ = split_codes(texts)
    parts = np.diff(bounds).astype(float)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    pairs, times = np.unique(owner * (codes.max(initial=0) + 1) + codes, return_counts=True)
    owners = pairs // (codes.max(initial=0) + 1)
    most = np.zeros(n)
    np.maximum.at(most, owners, times)
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    found["distinct_words"] = share(np.bincount(owners, minlength=n), parts)
    found["most_frequent_word"] = share(most, parts)
    found["repeated_neighbours"] = share(np.bincount(owner[1:][again], minlength=n), parts)
    lines = pc.split_pattern(texts, "\n")
    ends = lines.offsets.to_numpy().astype(np.int64)
    line_codes = lines.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    line_owner = np.repeat(np.arange(n), np.diff(ends))
    base = line_codes.max(initial=0) + 1
    found["distinct_lines"] = share(
        np.bincount(np.unique(line_owner * base + line_codes) // base, minlength=n), np.diff(ends).astype(float)
    )
    matrix = np.column_stack([found[name] for name in FEATURES])
    matrix[size == 0] = 0.0
    return matrix


def _tree(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Value per bin of the best tree of at most three leaves over ordered bins."""
    cuts: list[int] = []
    for _ in range(2):
        gains = [(g, at) for g, at in (_cut(gradient, hessian, *s) for s in _spans(cuts, len(gradient))) if at]
        if not gains or max(gains)[0] <= 1e-12:
            break
        cuts = sorted([*cuts, max(gains)[1]])
    values = np.zeros(len(gradient))
    for low, high in _spans(cuts, len(gradient)):
        values[low:high] = gradient[low:high].sum() / (hessian[low:high].sum() + RIDGE)
    return values


def _spans(cuts: list[int], n: int) -> list[tuple[int, int]]:
    return [*zip([0, *cuts], [*cuts, n])]


def _cut(gradient: np.ndarray, hessian: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of a span of bins; place 0 where none is allowed."""
    if high - low < 2:
        return 0.0, 0
    g, h = np.cumsum(gradient[low:high]), np.cumsum(hessian[low:high])
    left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g[-1] ** 2 / (h[-1] + RIDGE)
    gain = np.where((left_h >= LEAST_LEAF) & (right_h >= LEAST_LEAF), gain, -1.0)
    at = int(np.argmax(gain))
    return (float(gain[at]), low + at + 1) if gain[at] > 0 else (0.0, 0)


def _grid_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """Values over a grid of the best tree that cuts one axis, then both sides along the other; and its gain."""
    best, chosen = 0.0, np.zeros(gradient.shape)
    whole = gradient.sum() ** 2 / (hessian.sum() + RIDGE)
    for turned in (False, True):
        g, h = (gradient.T, hessian.T) if turned else (gradient, hessian)
        for at in range(1, len(g)):
            gain, values = -whole, np.zeros(g.shape)
            for low, high in ((0, at), (at, len(g))):
                along_g, along_h = g[low:high].sum(axis=0), h[low:high].sum(axis=0)
                if along_h.sum() < LEAST_LEAF:
                    gain = -1.0
                    break
                _, cut = _cut(along_g, along_h, 0, len(along_g))
                for a, b in _spans([cut] if cut else [], len(along_g)):
                    sum_g, sum_h = along_g[a:b].sum(), along_h[a:b].sum() + RIDGE
                    gain += sum_g**2 / sum_h
                    values[low:high, a:b] = sum_g / sum_h
            if gain > best + 1e-12:
                best, chosen = gain, values.T if turned else values
    return chosen, best


@dataclass(frozen=True)
class Additive:
    """Log odds of label 1: ``bias``, a table per feature, a table per pair of features."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def log_odds(self, matrix: np.ndarray) -> np.ndarray:
        total = np.full(len(matrix), self.bias)
        for column, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, matrix[:, column], side="right")]
        for a, b, table in self.pairs:
            total += table[
                np.searchsorted(self.grids[a], matrix[:, a], side="right"),
                np.searchsorted(self.grids[b], matrix[:, b], side="right"),
            ]
        return total

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(features(texts)), -30, 30)))

    def column(self, text: str | Column) -> Column:
        """Score of a text column; NULL is scored like an empty text."""

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                texts = texts_of(batch)
                found = [self.scores(texts.slice(a, b - a)) for a, b in slices(texts, SLICE_BYTES)]
                yield pa.array(np.concatenate(found) if found else np.zeros(0))

        return score.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def held_out(key: str | Column) -> Column:
    """Whether a row belongs to the fold the model never learns from."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 5 == 0


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def boosted(matrix: np.ndarray, label: np.ndarray) -> Additive:
    """The model of least log loss that the given number of visits reaches; without both classes, their share."""
    if not len(label) or not 0 < label.sum() < len(label):
        share = float(label.mean()) if len(label) else 0.0
        return Additive(float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    n, width = matrix.shape
    bias = float(np.log(label.mean() / (1 - label.mean())))
    edges = [_edges(matrix[:, c], BINS) for c in range(width)]
    bins = [np.searchsorted(e, matrix[:, c], side="right") for c, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return label - chance, chance * (1 - chance)

    for _ in range(ROUNDS):
        for own, table in zip(bins, tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(own, g, len(table)), np.bincount(own, h, len(table)))
            table += step
            total += step[own]

    grids = [_edges(matrix[:, c], GRID) for c in range(width)]
    coarse = [np.searchsorted(e, matrix[:, c], side="right") for c, e in enumerate(grids)]

    def grid_of(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(grids[a]) + 1, len(grids[b]) + 1
        cell = coarse[a] * shape[1] + coarse[b]
        g, h = slopes()
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = {(a, b): _grid_tree(*grid_of(a, b)[1:])[1] for a, b in itertools.combinations(range(width), 2)}
    chosen = [p for p in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS] if gains[p] > 0]
    pair_tables = {p: np.zeros((len(grids[p[0]]) + 1, len(grids[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            cell, g, h = grid_of(*pair)
            step = RATE * _grid_tree(g, h)[0]
            pair_tables[pair] += step
            total += step.ravel()[cell]
    return Additive(bias, edges, tables, grids, [(a, b, pair_tables[a, b]) for a, b in chosen])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    train: Callable[[Column], Column] = lambda key: ~held_out(key),
) -> Additive:
    """The model of ``labels.quality``, learned from at most ``rows`` labelled documents of the training fold.

    Labels that are NULL or have no id are left out; a document labelled several times counts as 1 if one label says
    so. Of several rows of one id the text with the smallest digest is learned from. Without rows of both classes
    every score is the share of label 1 (0 without any row, as for an empty table).
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & train(F.col("doc_id")))
    sample = (
        known.groupBy(F.col("doc_id").alias("sampled"))
        .agg(F.max((F.col("quality") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("sampled"), "sampled")
        .limit(rows)
    )
    # Broadcast: at most ``rows`` rows of two numbers.
    described = (
        docs.select(F.col("doc_id").alias("own"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), F.col("own") == F.col("sampled"))
        .select("own", "label", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), described_by("text").alias("row"))
        .groupBy("own")
        .agg(F.min(F.struct("digest", "label", "row")).alias("first"))
        .select("first.label", "first.row")
        .toArrow()
    )
    if not described.num_rows:
        return boosted(np.zeros((0, len(FEATURES))), np.zeros(0))
    matrix = plain(described["row"]).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    # In a fixed order, so that sums do not depend on how the rows arrive.
    label = described["label"].to_numpy().astype(float)
    order = np.lexsort([label, *matrix.T])
    return boosted(matrix[order], label[order])


def described_by(text: str) -> Column:
    """The features of a text column as an array."""

    @F.arrow_udf("array<double>")
    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = texts_of(batch)
            found = [features(texts.slice(a, b - a)) for a, b in slices(texts, SLICE_BYTES)]
            matrix = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            bounds = pa.array(np.arange(0, matrix.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.ListArray.from_arrays(bounds, pa.array(matrix.ravel()))

    return rows(F.col(text))


def graded(docs: DataFrame, model: Additive, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """All rows with ``score`` and ``predicted`` (1 at or above the threshold); columns of these names are replaced.

    A row is scored by its text alone, so repeated rows, ties and NULL ids score as they would alone. NULL, empty and
    blank texts have a score as well; an empty table gives no rows. A long text is described as a whole.
    """
    return docs.withColumn("score", model.column(docs[text].cast("string"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
