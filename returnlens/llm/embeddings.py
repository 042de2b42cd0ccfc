"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on random directions; each projection is shifted and cut into steps of ``WIDTH``. A
table's bucket is what ``PROJECTIONS`` projections say, and there are ``TABLES`` of them. For unit vectors a cosine of
0.93 is a distance of 0.374: one projection agrees with probability 0.85, a bucket with 0.28, one of the tables with
0.979. Vectors at a right angle share a bucket with probability 0.003.

Equal vectors of a label are one class from the start. Classes of a bucket are compared in blocks of at most
``BLOCK`` classes, every pair of blocks in its own group, so no task holds a whole hot bucket. A group compares its
vectors by one matrix product in double precision; it returns the number of links of each class and links that join
what is connected (at most one per class), never all pairs. A pair that met in an earlier table is not counted again.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.skew import once_per_key
from returnlens.llm.components import components
from returnlens.llm.shared import grouped_runs, plain, written

COSINE = 0.93
TABLES = 12
PROJECTIONS = 8
WIDTH = 2.0
BLOCK = 512
SEED = 20_240_501


@functools.cache
def _directions(dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, dimension])
    count = TABLES * PROJECTIONS
    mixers = random.integers(1, 1 << 62, (TABLES, PROJECTIONS), np.int64) * 2 + 1
    return random.standard_normal((dimension, count)), random.uniform(0, WIDTH, count), mixers


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component is scaled to one first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _units(vectors: pa.ListArray, size: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.astype(np.float64).reshape(-1, size))


def buckets(units: np.ndarray) -> np.ndarray:
    """Bucket number of each vector in each table."""
    directions, shifts, mixers = _directions(units.shape[1])
    steps = np.floor((units @ directions + shifts) / WIDTH).astype(np.int64).reshape(-1, TABLES, PROJECTIONS)
    return (steps * mixers).sum(axis=2)


def class_of(vector: Column, label: Column) -> Column:
    """Digest of label and vector; NULL for vectors that link with nothing."""

    @F.arrow_udf("binary")
    def digest(vectors: pa.Array, labels: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        for vector, label in zip(plain(vectors), plain(labels).to_pylist()):
            own = None
            if vector.is_valid and label is not None and len(vector) and vector.values.null_count == 0:
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(values).all() and values.any():
                    own = hashlib.blake2b(f"{label}:".encode() + values.tobytes(), digest_size=16).digest()
            out.append(own)
        return pa.array(out, pa.binary())

    return digest(vector, label)


def embedding_groups(
    frame: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row: key, ``n_links``, ``component_id`` (smallest key reachable, itself included) and ``kept``.

    Rows link when their labels are equal and not NULL and the cosine of their vectors is at least ``cosine``. Vectors
    that are NULL, empty, zero or hold NULL or non-finite components link with nothing, nor do vectors of different
    length. Repeated rows are copies that link with each other; a NULL key is a component's smallest only if all its
    keys are NULL. Other columns are not read.
    """
    # Single precision stays so, at half the size; all arithmetic is in double precision.
    stored = "array<float>" if frame.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = frame.select(
        frame[key].alias("key"), frame[label].cast("string").alias("label"),
        frame[vector].cast(stored).alias("vector"),
    ).withColumn("class", class_of(F.col("vector"), F.col("label")))
    members = written(rows.select("key", "class"), "vector-classes")
    classes = written(
        rows.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.any_value("label").alias("label"),
            F.any_value("vector").alias("vector"),
            F.count(F.lit(1)).alias("copies"),
            F.min("key").alias("smallest"),
        )
        .mapInArrow(
            _with_buckets,
            f"class binary, label string, vector {stored}, copies long, smallest long, buckets array<long>",
        ),
        "vectors",
    )
    found = written(_compared(classes, cosine), "vector-links")
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    stars = components(found.filter(F.col("b").isNotNull()))
    labelled = (
        classes.select("class", "copies", "smallest")
        .join(stars, F.col("class") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = once_per_key(labelled, "component", F.min("smallest").alias("component_id")).withColumnRenamed(
        "component", "star"
    )
    facts = (
        labelled.join(least, F.col("component") == F.col("star"))
        .join(counts, F.col("class") == F.col("linked"), "left")
        .select(
            F.col("class").alias("of"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            "component_id",
        )
    )
    single = F.col("class").isNull()
    joined = members.join(facts, F.col("class") == F.col("of"), "left")
    component = F.when(single, F.col("key")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def _with_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = plain(batch.column("vector"))
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        numbers = np.zeros((len(sizes), TABLES), np.int64)
        for size in np.unique(sizes):
            chosen = np.flatnonzero(sizes == size)
            numbers[chosen] = buckets(_units(vectors.take(pa.array(chosen)), size))
        bounds = pa.array(np.arange(0, numbers.size + 1, TABLES, dtype=np.int32))
        lists = pa.ListArray.from_arrays(bounds, pa.array(numbers.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "buckets"])


GROUP = ["label", "size", "number", "bucket", "low", "high"]


def _compared(classes: DataFrame, cosine: float) -> DataFrame:
    """Links that keep connected classes connected (a, b), and link counts per class (a, links)."""
    placed = classes.select(
        "class", "label", "vector", "copies", F.size("vector").alias("size"),
        F.posexplode("buckets").alias("number", "bucket"),
    )
    # Buckets of one class compare nothing; larger ones are cut into blocks.
    crowd = (
        placed.groupBy("label", "size", "number", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            *(F.col(c).alias(f"{c}_") for c in GROUP[:4]),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        )
    )
    same = functools.reduce(lambda x, y: x & y, (F.col(c) == F.col(f"{c}_") for c in GROUP[:4]))
    blocked = placed.join(crowd, same).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    )
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", "number", "bucket", "block", "class", "vector", "copies",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    return (
        paired.repartition(*GROUP)
        .sortWithinPartitions(*GROUP)
        .mapInArrow(functools.partial(_group_links, cosine), "a binary, b binary, links long")
    )


def _group_links(cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: list[tuple[bytes, bytes | None, int | None]] = []
    for group in grouped_runs(batches, GROUP):
        if group.num_rows > 1:
            ends += _links(group, cosine)
        if len(ends) > 50_000:
            yield _link_rows(ends)
            ends = []
    if ends:
        yield _link_rows(ends)


def _link_rows(ends: list) -> pa.RecordBatch:
    a, b, links = zip(*ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"]
    )


def _links(group: pa.Table, cosine: float) -> list[tuple[bytes, bytes | None, int | None]]:
    n = group.num_rows
    vectors = _units(plain(group["vector"]), group["size"][0].as_py())
    near = vectors @ vectors.T >= cosine
    if group["low"][0].as_py() != group["high"][0].as_py():
        block = group["block"].to_numpy()
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    if not len(i):
        return []
    number = group["number"][0].as_py()
    tables = buckets(vectors)[:, :number]
    fresh = ~(tables[i] == tables[j]).any(axis=1)
    i, j = i[fresh], j[fresh]
    if not len(i):
        return []
    copies = group["copies"].to_numpy()
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    names = group["class"].to_pylist()
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    found = [(names[k], None, int(links[k])) for k in np.flatnonzero(links).tolist()]
    return found + [(names[x], names[y], None) for x, y in _forest(linked)]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join every connected set, one less than its members."""
    waiting = linked.any(axis=1)
    out: list[tuple[int, int]] = []
    while waiting.any():
        stack = [int(np.argmax(waiting))]
        waiting[stack[0]] = False
        while stack:
            node = stack.pop()
            reached = np.flatnonzero(linked[node] & waiting).tolist()
            waiting[reached] = False
            out += [(node, other) for other in reached]
            stack += reached
    return out
