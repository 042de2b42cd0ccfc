"""Near-duplicate documents by SimHash, found through counts of set bits per segment.

A fingerprint of 64 bits is embedded as the number of set bits in each of its 32 two-bit segments, packed into one
long. The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. The range join
finds all pairs within ``bits`` of each other on a grid: the distance is shared by the two halves of the embedding,
so in one half it is at most ``bits // 2`` (0 or 1). Cells are whole halves; a fingerprint looks up its own cell and
those one step above it, which meets every neighbouring pair once. The join itself checks the Manhattan distance,
then the exact number of differing bits, so only true links leave it.

Documents of equal fingerprint are one class from the start; links and components are found between classes. A hot
cell is spread by Spark's skew join; a class of many documents meets one row of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.skew import once_per_key
from returnlens.llm.components import components
from returnlens.llm.shared import release, slices, texts_of, written

BITS = 3
WORDS = 3
SEED = 42
SLICE_BYTES = 1 << 20
ODD = 0x5555555555555555
FIELDS = 16  # segments in a half


def fingerprint(data: bytes, words: int) -> np.uint64:
    """Bits set in more than half of the shingles' hashes; 0 without words."""
    parts = data.lower().split()
    if not parts:
        return np.uint64(0)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    count = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:count].tolist(), ends[-count:].tolist())
    totals = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", count)
    for low in range(0, count, 1 << 16):
        block = hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * totals > count, bitorder="little").view("<u8")[0]


def fingerprints(text: Column, words: int = WORDS) -> Column:
    """Fingerprint of a text as a signed long; NULL counts as ''.

    Only A to Z are lower-cased; words are runs of characters other than the six ASCII white-space ones.
    """

    @F.arrow_udf("long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = texts_of(batch).cast(pa.large_binary())
            parts = (texts.slice(a, b - a).to_pylist() for a, b in slices(texts, SLICE_BYTES))
            values = np.fromiter((fingerprint(t, words) for part in parts for t in part), np.uint64, len(texts))
            del batch, texts
            release()
            yield pa.array(values.view(np.int64))

    return found.asNondeterministic()(text)


def embedding(value: Column) -> Column:
    """Number of set bits in each two-bit segment, as 32 fields of two bits."""
    other = F.shiftrightunsigned(value, 1)
    both = value.bitwiseAND(other).bitwiseAND(F.lit(ODD))
    one = value.bitwiseXOR(other).bitwiseAND(F.lit(ODD))
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: a field's difference is 2 for 0 against 2, else its bits differ at the low end."""
    differing = a.bitwiseXOR(b)
    low = differing.bitwiseAND(F.lit(ODD))
    two = F.shiftrightunsigned(differing, 1).bitwiseAND(F.lit(ODD)).bitwiseAND(F.bitwise_not(low))
    return F.bit_count(low) + 2 * F.bit_count(two)


def near_pairs(values: DataFrame, bits: int = BITS) -> DataFrame:
    """All pairs of the distinct longs in column ``fp`` that differ in at most ``bits`` bits: columns a, b.

    A pair can come twice, once for each half. ``bits`` is 0 to 3.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the grid covers up to 3 differing bits")
    embedded = values.select("fp", embedding(F.col("fp")).alias("counts"))
    halves = embedded.select(
        "fp",
        "counts",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), F.col("counts").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
                F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("counts", 32).alias("cell")),
            )
        ).alias("h"),
    ).select("fp", "counts", "h.half", "h.cell")
    steps = [F.col("cell")]
    if bits // 2:
        for field in range(FIELDS):
            step = 1 << (2 * field)
            full = F.col("cell").bitwiseAND(F.lit(2 * step)) != 0
            steps.append(F.when(~full, F.col("cell") + F.lit(step)))
    probes = (
        halves.select("fp", "counts", "half", F.posexplode(F.array(*steps)).alias("step", "near"))
        .filter(F.col("near").isNotNull())
        .alias("p")
    )
    found = probes.join(
        halves.alias("h"),
        (F.col("p.half") == F.col("h.half"))
        & (F.col("p.near") == F.col("h.cell"))
        & ((F.col("p.step") > 0) | (F.col("p.fp") < F.col("h.fp")))
        & (manhattan(F.col("p.counts"), F.col("h.counts")) <= bits)
        & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("h.fp"))) <= bits),
    )
    return found.select(F.col("p.fp").alias("a"), F.col("h.fp").alias("b"))


def simhash_groups(
    frame: DataFrame, bits: int = BITS, words: int = WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable by links.

    Texts without words have fingerprint zero and are linked like any other; NULL counts as ''. Fewer words than a
    shingle are hashed as one. Repeated rows stay; a NULL key never is a component's smallest unless all its keys are
    NULL. Other columns are not read.
    """
    hashed = written(
        frame.select(frame[key].alias("key"), fingerprints(frame[text].cast("string"), words).alias("fp")), "simhash"
    )
    classes = hashed.groupBy("fp").agg(F.min("key").alias("smallest"))
    linked = components(near_pairs(classes, bits))
    labelled = classes.join(linked, classes.fp == linked.node, "left").select(
        "fp", "smallest", F.coalesce("component", "fp").alias("component")
    )
    least = once_per_key(labelled, "component", F.min("smallest").alias("component_id"))
    owners = once_per_key(
        labelled.join(least, "component").withColumnRenamed("fp", "class"),
        "class",
        F.min("component_id").alias("component_id"),
    )
    return hashed.join(owners, hashed.fp == owners["class"]).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


