"""Hard negatives by an inverted multi-index: two codebooks, one per half of the space, form cells.

The codebooks are fitted on a bounded sample; every row is put into the cell of its nearest word in each half. Of each
word the index keeps the radius, the largest distance of a row of the word. An anchor's inner product with a row of a
cell is at most the sum of two half-scores, each the product with the word plus the anchor's length times the radius.
The multi-sequence heap visits the cells that hold rows in descending order of this bound, so a window of scores is
certified, complete and exact, once its rows are found and the next bound lies below the last of them, or below the
window.

Visits go in rounds, each of several times as many rows as the one before. In a round every open anchor asks for its
next cells; requests meet the rows of a cell in one task per piece of a cell and block of anchors, which returns the
best rows of each window; certified anchors leave. First every anchor looks for its positives (one window without
bounds, rows of its label), then for the negatives of each positive (the window below the positive's score, rows of
other labels).

What goes to every task is bounded: the words and radii (at most ``WORDS`` a half) and the sizes of the cells.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from returnlens.llm.shared import plain, written

SAMPLE_ROWS = 20_000
WORDS = 256  # at most, in each half
ROWS_PER_CELL = 256
STEPS = 12  # of k-means
SEED = 20_240_502
LARGEST = 1 << 20  # whole components beyond it have no sure score
PIECE = 4096  # rows of a cell in one task
ANCHORS = 16_384  # anchors of a block
FIRST_ROWS, GROWTH = 2048, 8
SCORE_CELLS = 1 << 22  # scores held at once


@dataclass(frozen=True)
class Index:
    """Words and radii of both halves, and the number of rows of each cell that has any."""

    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: dict[tuple[int, int], int]

    def bounds(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half-scores, each no less than any of the word's rows has."""
        found, at = [], 0
        for words, radii in zip(self.halves, self.radii):
            part = vector[at : at + words.shape[1]]
            at += words.shape[1]
            reach = np.sqrt(part @ part) * radii
            # The last term is far beyond what rounding can take away.
            found.append(words @ part + reach + 1e-9 * (1 + reach + np.abs(words) @ np.abs(part)))
        return found[0], found[1]

    def visits(self, vector: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Cells with rows in descending order of their bounds: the multi-sequence heap."""
        first, second = self.bounds(vector)
        order_i, order_j = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        sums_i, sums_j = first[order_i].tolist(), second[order_j].tolist()
        order_i, order_j = order_i.tolist(), order_j.tolist()
        heap = [(-(sums_i[0] + sums_j[0]), 0, 0)] if sums_i and sums_j else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if (order_i[i], order_j[j]) in self.cells:
                yield -bound, order_i[i], order_j[j]
            # Each pair is reached once: along its row, and the rows along the first column.
            if j + 1 < len(sums_j):
                heapq.heappush(heap, (-(sums_i[i] + sums_j[j + 1]), i, j + 1))
            if not j and i + 1 < len(sums_i):
                heapq.heappush(heap, (-(sums_i[i + 1] + sums_j[0]), i + 1, 0))


def codebook(sample: np.ndarray, size: int) -> np.ndarray:
    """Words of a half by k-means; fewer than ``size`` where the sample has fewer distinct rows."""
    distinct = np.unique(sample, axis=0)
    random = np.random.default_rng(SEED)
    words = distinct[np.sort(random.choice(len(distinct), min(size, len(distinct)), replace=False))]
    for _ in range(STEPS):
        own = nearest(sample, words)
        counts = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, sample)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    found = [
        np.argmin((words**2).sum(axis=1) - 2 * rows[low : low + 4096] @ words.T, axis=1)
        for low in range(0, len(rows), 4096)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def whole(vector: Column, label: Column, key: Column) -> Column:
    """The vector in whole numbers, floor(256 x); NULL for rows that take no part."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    usable = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(F.abs(x * 256) < LARGEST, F.lit(False)))
    return F.when(key.isNotNull() & label.isNotNull() & vector.isNotNull() & usable, scaled)


def shifted_label(label: Column, key: Column) -> Column:
    """Where the key is divisible by 7, the next of ten labels."""
    return F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)


def hard_negatives(
    frame: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    share: int = 80,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` says which rows of ``frame`` are anchors. Scores are inner products of the vectors' whole parts of 256
    times a component; higher ones come first, ties by smaller key. An anchor's positives are its first ``positives``
    other rows of its label; for each, the first ``negatives`` rows of other labels are returned whose score is at
    most the positive's and at least ``share`` hundredths of it. A negative positive score has an empty window.

    Rows take no part whose key, label or vector is NULL, or whose vector holds a component that is NULL, not finite
    or of which 256 times is 2^20 or more. A shorter vector counts as filled up with zeros. The key names a row: of
    rows that repeat a key the one with the smallest label and vector takes part. An empty table, or one without
    anchors, gives no rows. Other columns are not read; keys and labels are whole numbers.
    """
    spark = frame.sparkSession
    own_key, own_label = frame[key].cast("long"), frame[label].cast("long")
    rows = (
        frame.select(
            own_key.alias("id"), own_label.alias("label"), whole(frame[vector], own_label, own_key).alias("vector"),
            F.coalesce(anchors, F.lit(False)).alias("anchor"),
        )
        .filter(F.col("vector").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
        .select("id", "row.*")
    )
    rows = written(rows, "vectors")
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.sum(F.col("anchor").cast("int"))).first()
    count, width, asking = facts[0], max(2, facts[1] or 0), facts[2] or 0
    wanted = int(np.clip(np.sqrt(count / ROWS_PER_CELL), 1, WORDS))
    # At most SAMPLE_ROWS vectors.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toArrow()
    sampled = matrix(plain(sample["vector"]), width)
    middle = width // 2
    halves = tuple(codebook(part, wanted) for part in (sampled[:, :middle], sampled[:, middle:]))
    placed = written(
        rows.mapInArrow(
            functools.partial(_placed, halves, width),
            "id long, label long, vector binary, anchor boolean, i int, j int, far_i double, far_j double",
        ),
        "cells",
    )
    # Of equal rows of a label only the first by key can be among the best, and the anchor may be one of them.
    copies = Window.partitionBy("label", "vector").orderBy("id")
    listed = placed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= 1 + max(positives, negatives))
    listed = written(listed.drop("copy", "anchor"), "members")
    # At most WORDS squared cells.
    cells = listed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("far_i"), F.max("far_j")).collect()
    radii = np.zeros(len(halves[0])), np.zeros(len(halves[1]))
    for i, j, _, far_i, far_j in cells:
        radii[0][i], radii[1][j] = max(radii[0][i], far_i), max(radii[1][j], far_j)
    index = Index(halves, radii, {(i, j): n for i, j, n, _, _ in cells})
    # Large cells are cut into pieces.
    sizes = spark.createDataFrame([(i, j, -(-n // PIECE)) for i, j, n, _, _ in cells], "of_i int, of_j int, pieces long")
    members = listed.join(F.broadcast(sizes), (F.col("i") == F.col("of_i")) & (F.col("j") == F.col("of_j"))).select(
        F.col("i").alias("m_i"), F.col("j").alias("m_j"), "id", "label", "vector",
        F.pmod(F.xxhash64("id"), "pieces").alias("piece"),
    )
    search = _Search(index, members, sizes, max(1, -(-asking // ANCHORS)))

    bounds = (F.lit(x).cast("long").alias(name) for name, x in (("of", 0), ("low", -(1 << 62)), ("high", 1 << 62)))
    everything = F.array(F.struct(*bounds))
    asked = placed.filter("anchor").select("id", "label", "vector", everything.alias("windows"))
    nearby = search.best(asked, True, positives).select(
        "anchor", F.col("found").alias("of"), F.col("score").alias("positive_score")
    )
    lowest = F.expr(f"(positive_score * {share} + 99) div 100")
    window = F.struct("of", lowest.alias("low"), F.col("positive_score").alias("high"))
    windows = (
        nearby.filter("positive_score >= 0")
        .groupBy("anchor")
        .agg(F.array_sort(F.collect_list(window)).alias("windows"))  # at most ``positives`` of them
        .withColumnRenamed("anchor", "asking")
    )
    asked = placed.filter("anchor").join(windows, F.col("id") == F.col("asking")).select("id", "label", "vector", "windows")
    mined = search.best(asked, False, negatives).withColumnRenamed("anchor", "asking")
    scores = nearby.withColumnRenamed("of", "positive")
    return mined.join(scores, (F.col("asking") == F.col("anchor")) & (F.col("of") == F.col("positive"))).select(
        F.col("asking").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("place").cast("int").alias("rank"),
        F.col("found").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of one length, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _placed(halves: tuple, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its cell and its distances from the words; the vector as 32-bit numbers."""
    for batch in batches:
        rows = matrix(plain(batch.column("vector")), width)
        stored = pa.array([r.tobytes() for r in rows.astype(np.int32)], pa.binary())
        places, far, at = [], [], 0
        for words in halves:
            part = rows[:, at : at + words.shape[1]]
            at += words.shape[1]
            own = nearest(part, words)
            places.append(pa.array(own.astype(np.int32)))
            far.append(pa.array(np.sqrt(((part - words[own]) ** 2).sum(axis=1))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), stored, batch.column("anchor"), *places, *far],
            names=["id", "label", "vector", "anchor", "i", "j", "far_i", "far_j"],
        )


WINDOWS = "array<struct<of: long, low: long, high: long>>"
CELL = ["i", "j", "piece", "block"]


@dataclass(frozen=True)
class _Search:
    index: Index
    members: DataFrame
    sizes: DataFrame
    blocks: int

    def best(self, asked: DataFrame, alike: bool, most: int) -> DataFrame:
        """The first ``most`` rows of each window: anchor, of, found, score, place (from 1).

        ``asked`` has id, label, vector and windows of each anchor; ``alike`` says whether rows of the anchor's label
        are looked for or those of other labels.
        """
        spark = asked.sparkSession
        asked = written(asked, "anchors")
        total = sum(self.index.cells.values())
        found = spark.createDataFrame([], "anchor long, of long, found long, score long, place int")
        open_anchors, skip, rows = asked, 0, FIRST_ROWS
        while True:
            last = skip + rows >= total
            requests = written(
                open_anchors.mapInArrow(
                    functools.partial(_requests, self.index, skip, total if last else skip + rows),
                    f"asking long, asking_label long, asking_vector binary, windows {WINDOWS}, "
                    "i int, j int, next double",
                ),
                "requests",
            )
            found = written(_first(found.unionByName(self._answers(requests, alike, most)), most), "found")
            if last:
                return found
            open_anchors = written(_open(asked, requests, found, most), "open")
            if open_anchors.isEmpty():
                return found
            skip, rows = skip + rows, rows * GROWTH

    def _answers(self, requests: DataFrame, alike: bool, most: int) -> DataFrame:
        """The best rows of each window among the rows of the cells asked for."""
        block = F.pmod(F.xxhash64("asking"), F.lit(self.blocks))
        cells = requests.filter(F.col("i").isNotNull()).withColumn("block", block)
        pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
        same = (F.col("i") == F.col("of_i")) & (F.col("j") == F.col("of_j"))
        asking = cells.join(F.broadcast(self.sizes), same).select(
            "asking", "asking_label", "asking_vector", "windows", "i", "j", "block", pieces
        )
        # At most as many rows as cells and blocks.
        meeting = cells.select(F.col("i").alias("c_i"), F.col("j").alias("c_j"), F.col("block").alias("m_block")).distinct()
        rows = self.members.join(meeting, (F.col("m_i") == F.col("c_i")) & (F.col("m_j") == F.col("c_j"))).select(
            F.col("m_i"), F.col("m_j"), F.col("piece").alias("m_piece"), "m_block", "id", "label", "vector"
        )
        met = asking.groupBy(*CELL).cogroup(rows.groupBy("m_i", "m_j", "m_piece", "m_block"))
        return _ranked(
            met.applyInArrow(
                functools.partial(_scored, alike, most), "anchor long, of long, found long, score long"
            ),
            most,
        )


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), "found")
    return rows.select("anchor", "of", "found", "score", F.row_number().over(order).alias("place")).filter(
        F.col("place") <= most
    )


def _first(rows: DataFrame, most: int) -> DataFrame:
    return _ranked(rows.drop("place"), most)


def _open(asked: DataFrame, requests: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Anchors with a window that is not certified."""
    windows = (
        requests.filter(F.col("i").isNull())
        .select(F.col("asking").alias("at"), "next", F.explode("windows").alias("window"))
        .select("at", "next", F.col("window.of").alias("window_of"), F.col("window.low").alias("low"))
    )
    filled = found.groupBy("anchor", "of").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    joined = windows.join(filled, (F.col("at") == F.col("anchor")) & (F.col("window_of") == F.col("of")), "left")
    certified = (F.col("next") < F.col("low")) | ((F.col("n") >= most) & (F.col("next") < F.col("least")))
    waiting = joined.filter(~F.coalesce(certified, F.lit(False))).select("at").distinct()
    return asked.join(waiting, F.col("id") == F.col("at"), "left_semi")


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = plain(column)
    flat = np.frombuffer(b"".join(data.to_pylist()), np.int32)
    return flat.reshape(len(data), -1).astype(np.float64)


def _requests(index: Index, skip: int, stop: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each anchor from ``skip`` rows on until ``stop`` rows are seen, and one row with the bound of the
    next cell (minus infinity after the last)."""
    names = ["asking", "asking_label", "asking_vector", "windows", "i", "j", "next"]
    for whole_batch in batches:
        for low in range(0, whole_batch.num_rows, 64):
            batch = whole_batch.slice(low, 64)
            vectors = _vectors(batch.column("vector"))
            owner: list[int] = []
            places: list[tuple[int | None, int | None, float | None]] = []
            for number, vector in enumerate(vectors):
                seen, following = 0, -np.inf
                for bound, i, j in index.visits(vector):
                    if seen >= stop:
                        following = bound
                        break
                    if seen >= skip:
                        owner.append(number)
                        places.append((i, j, None))
                    seen += index.cells[i, j]
                owner.append(number)
                places.append((None, None, following))
            chosen = batch.take(pa.array(owner))
            i, j, following = zip(*places)
            yield pa.RecordBatch.from_arrays(
                [
                    chosen.column("id"), chosen.column("label"), chosen.column("vector"), chosen.column("windows"),
                    pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(following, pa.float64()),
                ],
                names,
            )


def _scored(alike: bool, most: int, asking: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of a piece of a cell for each window of each anchor that asks for it."""
    out: list[tuple[int, int, int, int]] = []
    if asking.num_rows and rows.num_rows:
        # By key, so that equal scores are taken in the order of keys.
        rows = rows.sort_by("id")
        ids, labels, vectors = rows["id"].to_numpy(), rows["label"].to_numpy(), _vectors(rows["vector"])
        step = max(1, SCORE_CELLS // len(ids))
        for low in range(0, asking.num_rows, step):
            part = asking.slice(low, step)
            anchors, own = part["asking"].to_pylist(), part["asking_label"].to_pylist()
            scores = products(_vectors(part["asking_vector"]), vectors)
            for anchor, label, windows, line in zip(anchors, own, part["windows"].to_pylist(), scores):
                allowed = (labels == label) & (ids != anchor) if alike else labels != label
                for window in windows:
                    at = np.flatnonzero(allowed & (line >= window["low"]) & (line <= window["high"]))
                    if len(at) > most:
                        # All that reach the last place's score: ties are settled by the key.
                        least = np.partition(line[at], len(at) - most)[len(at) - most]
                        at = at[line[at] >= least]
                    at = at[np.argsort(-line[at], kind="stable")][:most]
                    out += [(anchor, window["of"], int(ids[k]), int(line[k])) for k in at.tolist()]
    names = ["anchor", "of", "found", "score"]
    return pa.table({name: pa.array([row[k] for row in out], pa.int64()) for k, name in enumerate(names)})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
