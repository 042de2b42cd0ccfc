"""Toxicity classifier with a counterfactual penalty.

A logistic regression over words and word beginnings. Besides the log loss it minimises the squared change of the
score (in log odds) between two versions of a labelled text: with its identity terms, and with those swapped for others
of their group. A text without such a term gets a mention of a group in one version and of another in the other, so
the penalty reaches every row. A neutral mention of a group so earns no weight of its own, also where the beginning of
a term is that of toxic words.

The model is fitted on a bounded, documented sample: of the labelled ids of the training fold, the ``rows`` with the
smallest hash, one text each, written once. Scoring reads every whole text; it is a projection, without a shuffle.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.llm.shared import release, released, slices, split_codes, texts_of, written

SAMPLE_ROWS = 20_000
FEATURES = 20_000
LEAST_TEXTS = 3
LEAST_GAIN = 8.0  # bits; chance alone rarely gives a feature as much
THRESHOLD = 0.3
PENALTY = 1.0
RIDGE = 0.3  # over the number of rows
STEPS = 300
BEGINNINGS = (4, 5)
SLICE_BYTES = 1 << 19
LEARNED_ROWS = 200  # labelled texts whose features a task holds
COUNTED = 100_000  # features a task counts before it passes them on
WORD = re.compile(r"[^\W\d_]+")

# Terms of one row are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "arab"),
    ("immigrants", "refugees", "natives", "locals"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def swaps(groups=IDENTITY_TERMS) -> dict[str, str]:
    """Each term's successor in its group."""
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def features(text: str) -> set[str]:
    """The words of a part of text and their beginnings, in lower case."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}~" for w in words for n in BEGINNINGS if len(w) > n}


def swapped(text: str, pairs: dict[str, str]) -> str:
    return WORD.sub(lambda m: pairs.get(m[0].lower(), m[0]), text)


@dataclass(frozen=True)
class Classifier:
    """Log odds of label 1: ``bias`` plus the weights of the features a text holds."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float
    mentions: int = 0  # labelled rows that hold an identity term
    inserted: int = 0  # labelled rows that were given one

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        codes, bounds, parts = split_codes(texts)
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        get = self.index.get
        known = [[i for i in map(get, features(p)) if i is not None] for p in parts]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter((i for k in known for i in k), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        chosen = sizes[codes] > 0
        rows, codes = rows[chosen], codes[chosen]
        counts = sizes[codes]
        at = np.arange(counts.sum()) + np.repeat(starts[codes] - (np.cumsum(counts) - counts), counts)
        pairs = np.unique(np.repeat(rows, counts) * max(1, len(self.weights)) + flat[at])
        total = np.zeros(len(texts))
        if len(pairs):
            np.add.at(total, pairs // len(self.weights), self.weights[pairs % len(self.weights)])
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))

    def column(self, text: str | Column) -> Column:
        """Score of a text column; NULL is scored like an empty text."""

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                texts = texts_of(batch)
                found = [self.scores(texts.slice(a, b - a)) for a, b in slices(texts, SLICE_BYTES)]
                del batch, texts
                release()
                yield pa.array(np.concatenate(found) if found else np.zeros(0))

        return score.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def held_out(key: str | Column) -> Column:
    """Whether a row belongs to the fold the model never learns from."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 4 == 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    groups=IDENTITY_TERMS,
    penalty: float = PENALTY,
    train: Callable[[Column], Column] = lambda key: ~held_out(key),
) -> Classifier:
    """The classifier of ``labels.toxic``, learned from at most ``rows`` labelled documents of the training fold.

    Labels that are NULL are left out; a document labelled several times counts as toxic if one label says so. Of the
    rows that repeat an id one text is learned from. Without rows of both classes every score is the share of label 1
    (0 without any row, as for an empty table). A text is held as a whole while its features are found.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train(F.col("doc_id")))
    sample = (
        known.groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # Broadcast: at most ``rows`` rows of two numbers. Of the rows of an id the text with the smallest digest counts.
    texts = written(
        docs.select(F.col("doc_id").alias("own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(sample.withColumnRenamed("doc_id", "sampled")), F.col("own") == F.col("sampled"))
        .groupBy("own")
        .agg(F.min(F.struct(F.md5("text").alias("digest"), "text", "label")).alias("first"))
        .select("first.text", "first.label"),
        "labelled",
    )
    terms = sorted({f for group in groups for term in group for f in features(term)})
    found = _chosen_features(texts)
    # Terms are part of the model wherever a score can change, whether or not the sample holds them.
    index = {name: i for i, name in enumerate(dict.fromkeys([*found, *(terms if found else [])]))}
    table = texts.mapInArrow(
        functools.partial(_learned_rows, index, groups),
        "label int, own array<int>, one array<int>, other array<int>, mentions boolean",
    ).toArrow()
    label = table["label"].to_numpy().astype(float)
    if not 0 < label.sum() < len(label):
        share = float(label.mean()) if len(label) else 0.0
        return Classifier({}, np.zeros(0), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    own, one, other = (_Rows(table[c]) for c in ("own", "one", "other"))
    mentions = table["mentions"].to_numpy()
    return Classifier(
        index, *_minimum(label, own, one, other, len(index), penalty), int(mentions.sum()), int((~mentions & one.given).sum())
    )


def _chosen_features(texts: DataFrame) -> list[str]:
    """The features whose presence says most about the label (likelihood ratio), at most ``FEATURES``."""
    counts = texts.mapInArrow(_feature_counts, "feature string, label int, texts long")
    kinds = counts.groupBy("feature").agg(
        F.sum("texts").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("texts")).otherwise(0)).alias("n1")
    )
    # The feature '' stands for every text.
    total = kinds.filter("feature = ''").select("n", "n1").first()
    if total is None or total.n1 in (0, total.n):
        return []

    def bits(part: Column, whole: Column, rate: float) -> Column:
        return F.when(part > 0, part * F.log2(part / (whole * rate))).otherwise(0.0)

    rate = total.n1 / total.n
    rest, rest1 = total.n - F.col("n"), total.n1 - F.col("n1")
    gain = (
        bits(F.col("n1"), F.col("n"), rate)
        + bits(F.col("n") - F.col("n1"), F.col("n"), 1 - rate)
        + bits(rest1, rest, rate)
        + bits(rest - rest1, rest, 1 - rate)
    )
    chosen = kinds.filter(f"feature != '' and n >= {LEAST_TEXTS}").select("feature", gain.alias("gain"))
    chosen = chosen.filter(F.col("gain") >= LEAST_GAIN)
    return [r.feature for r in chosen.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]


@released
def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        names = [*counts]
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in names], pa.string()), pa.array([k for _, k in names], pa.int32()),
             pa.array([*counts.values()], pa.int64())],
            names=["feature", "label", "texts"],
        )

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"].to_pylist()):
            text = text.as_py()
            counts.update((f, label) for f in features(text or ""))
            counts["", label] += 1
            if len(counts) > COUNTED:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


@released
def _learned_rows(index: dict[str, int], groups, batches) -> Iterator[pa.RecordBatch]:
    """Feature numbers of each text and of its two versions (NULL without any group), and whether it holds a term."""
    pairs = swaps(groups)

    def numbers(found: set[str]) -> list[int]:
        return sorted(index[f] for f in found if f in index)

    for whole in batches:
        for low in range(0, whole.num_rows, LEARNED_ROWS):
            batch = whole.slice(low, LEARNED_ROWS)
            rows: list[tuple[list[int], list[int] | None, list[int] | None, bool]] = []
            for text in batch["text"].to_pylist():
                found, other = features(text), swapped(text, pairs)
                one = two = None
                if other != text:
                    one, two = numbers(found), numbers(features(other))
                elif pairs:
                    term = [*pairs][zlib.crc32(text.encode()) % len(pairs)]
                    one, two = numbers(found | features(term)), numbers(found | features(pairs[term]))
                rows.append((numbers(found), one, two, other != text))
            own, one, two, mentions = zip(*rows)
            lists = (pa.array(x, pa.list_(pa.int32())) for x in (own, one, two))
            yield pa.RecordBatch.from_arrays(
                [batch["label"], *lists, pa.array(mentions, pa.bool_())],
                names=["label", "own", "one", "other", "mentions"],
            )


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = lists.combine_chunks()
        self.given = pc.is_valid(lists).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.columns = lists.flatten().to_numpy(zero_copy_only=False)
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.count = len(sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.count)

    def gathered(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, values[self.rows], width)


def loss(
    label: np.ndarray, own: _Rows, one: _Rows, other: _Rows, weights: np.ndarray, bias: float, penalty: float
) -> float:
    """Mean log loss, ridge, and mean squared change of the log odds between the two versions of a row."""
    logits = own.times(weights) + bias
    change = np.where(other.given, one.times(weights) - other.times(weights), 0.0)
    fit = np.logaddexp(0, np.where(label == 1, -logits, logits)).mean()
    return float(fit + 0.5 * RIDGE * (weights @ weights) / len(label) + penalty * (change @ change) / len(label))


def _minimum(
    label: np.ndarray, own: _Rows, one: _Rows, other: _Rows, width: int, penalty: float
) -> tuple[np.ndarray, float]:
    """Weights and bias of least ``loss``, by gradient steps of adapted size (Adam)."""
    n = len(label)
    swap = other.given
    weights, bias = np.zeros(width), float(np.log(label.mean() / (1 - label.mean())))
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        logits = own.times(weights) + bias
        error = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - label
        gradient = (own.gathered(error, width) + RIDGE * weights) / n
        if swap.any():
            change = np.where(swap, one.times(weights) - other.times(weights), 0.0)
            gradient += 2 * penalty * (one.gathered(change, width) - other.gathered(change, width)) / n
        full = np.append(gradient, error.mean())
        moment = 0.9 * moment + 0.1 * full
        square = 0.99 * square + 0.01 * full**2
        move = (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        rate = 0.1 * (1 - step / (STEPS + 1))
        weights -= rate * move[:-1]
        bias -= rate * move[-1]
    return weights, float(bias)


def classified(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """All rows with ``score`` and ``predicted`` (1 at or above the threshold); columns of these names are replaced."""
    return docs.withColumn("score", model.column("text")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
