"""Near-duplicates against all pairs: fingerprints, lines, vectors, and the components of links."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from conftest_data import HOSTILE
from hypothesis import given, settings
from hypothesis import strategies as st

from returnlens.llm import embeddings, line_dedup, queries, simhash
from returnlens.llm.components import components

SF = "/root/testdata/sf0.001"


def groups_of(nodes, links):
    """Smallest node reachable from each."""
    tree = {n: n for n in nodes}

    def root(n):
        while tree[n] != n:
            n = tree[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        tree[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "twice", "empty"])
def test_components(spark, shape):
    pick = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(80)],
        "random": [(pick.randrange(90), pick.randrange(90)) for _ in range(60)],
        "twice": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4)],
        "empty": [],
    }[shape]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = groups_of({n for link in real for n in link}, real)
    assert len(rows) == len(expected)
    assert {r.node: r.component for r in rows} == expected


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(count)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > count)


def check_simhash(found, rows):
    """Rows of key, fingerprint and component against all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = groups_of(range(len(rows)), links)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[group[i]] = min(key, smallest.get(group[i], key))
    expected = [(key, f"{prints[i]:016x}", smallest.get(group[i])) for i, (key, _) in enumerate(rows)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_simhash_of_all_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_simhash(queries.op4_simhash_groups(spark, SF).collect(), rows)


def test_simhash_of_hostile_texts(texts):
    rows = [*HOSTILE, (30, "only two"), (31, "ONLY  two"), (32, "École É"), (33, "école é")]
    check_simhash(simhash.simhash_groups(texts(rows)).collect(), rows)


def test_near_fingerprints_against_all_pairs(spark):
    pick = random.Random(7)
    values = {0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        base = pick.getrandbits(64)
        for _ in range(8):
            values.add(base)
            base ^= 1 << pick.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for bits in (0, 1, 2, 3):
        found = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()
        mask = (1 << 64) - 1
        expected = {
            frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= bits
        }
        assert {frozenset((r.a, r.b)) for r in found} == expected


@given(st.integers(0, (1 << 63) - 1), st.integers(0, (1 << 63) - 1))
def test_counts_bound_the_bits(a, b):
    def counts(v):
        return [(v >> i & 1) + (v >> i + 1 & 1) for i in range(0, 64, 2)]

    assert sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()


def test_embedding_and_distance_columns(spark):
    pick = random.Random(9)
    pairs = [(pick.getrandbits(64) - (1 << 63), pick.getrandbits(64) - (1 << 63)) for _ in range(200)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("d")
    )

    def counts(v):
        return [(v >> i & 1) + (v >> i + 1 & 1) for i in range(0, 64, 2)]

    for row in frame.collect():
        assert row.d == sum(abs(x - y) for x, y in zip(counts(row.a), counts(row.b)))


def edit_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


edits = st.lists(st.tuples(st.sampled_from("idr"), st.integers(0, 60), st.sampled_from("abé日")), max_size=5)


def edited(line, changes):
    for kind, at, letter in changes:
        at %= len(line) + 1
        line = line[:at] + (letter if kind != "d" else "") + line[at + (kind != "i") :]
    return line


@settings(max_examples=200, deadline=None)
@given(st.text("abé日", min_size=6, max_size=60), edits, st.integers(1, 4))
def test_lines_within_the_threshold_meet_and_are_measured(line, changes, threshold):
    other = edited(line, changes)
    if min(len(line), len(other)) <= threshold:
        return
    true = edit_distance(line, other)
    short, long = sorted((line, other), key=len)
    if true <= threshold:
        own = line_dedup.keys_of(short, threshold)[: threshold + 1]
        assert set(own) & set(line_dedup.keys_of(long, threshold))
    symbols = np.frombuffer((short + long).encode("utf-32-le"), "<u4")
    lengths = np.array([len(short), len(long)])
    found = line_dedup.distances(
        symbols, np.array([0, len(short)]), lengths, np.array([0, 1]), np.array([1, 0]), threshold
    )
    assert found.tolist() == [min(true, threshold + 1)] * 2


def check_lines(found, rows, least=20, threshold=2):
    lines = [(key, i, line) for key, text in rows if text is not None for i, line in enumerate(text.split("\n"))]
    long = sorted({line for *_, line in lines if len(line) >= least})
    links = [
        (a, b)
        for i, a in enumerate(long)
        for b in long[:i]
        if abs(len(a) - len(b)) <= threshold and a[:400] != b[:400] and edit_distance(a, b) <= threshold
    ]
    group = groups_of(long, links)
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])
    first = {}
    for key, i, line in lines:
        if len(line) >= least:
            first[group[line]] = min((key, i), first.get(group[line], (key, i)), key=order)
    expected = []
    for key, i, line in lines:
        head = first[group[line]] if len(line) >= least else (key, i)
        expected.append((key, i, *head, head == (key, i)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def near_lines():
    pick = random.Random(11)
    base = ["".join(pick.choices("abcdefgh ", k=pick.randrange(20, 45))) for _ in range(12)]
    rows = []
    for i in range(60):
        line = pick.choice(base)
        changes = [(pick.choice("idr"), pick.randrange(60), pick.choice("xyé")) for _ in range(pick.randrange(4))]
        rows.append((i, pick.choice(["short", ""]) + "\n" + edited(line, changes)))
    return rows


def test_lines_of_near_copies(texts, monkeypatch):
    rows = near_lines()
    check_lines(line_dedup.line_classes(texts(rows), threshold=2).collect(), rows)


def test_lines_in_many_blocks(texts, monkeypatch):
    # One key for all lines, blocks of four: every pair still meets.
    rows = [(i, "the same beginning of a line " + "abcd"[i % 4] * (i // 4 % 3) + "end" + "xyz"[i % 3]) for i in range(40)]
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    check_lines(line_dedup.line_classes(texts(rows), threshold=2).collect(), rows)


def test_lines_of_hostile_texts(texts):
    rows = [r for r in HOSTILE if r[0] not in (6, 7)]
    rows += [(40, "z" * 3000 + "a"), (41, "b" + "z" * 3000), (42, "line of an id that comes first of all\n" * 2)]
    check_lines(line_dedup.line_classes(texts(rows), threshold=2).collect(), rows, threshold=2)


def test_repeated_lines_leave_the_text(texts):
    rows = [(1, "a line that stays where it is\nshort\nshort"), (2, "a line that stays where it is!\nnew"), (3, None)]
    docs = texts([*rows, (4, "a line that stays where it is")])
    classes = line_dedup.line_classes(docs, threshold=2)
    found = line_dedup.without_repeated_lines(docs, classes)
    assert found.columns == docs.columns
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "new", 3: None, 4: ""}


def vectors():
    random_ = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = random_.standard_normal(16)
            for _ in range(6):
                near = base + random_.standard_normal(16) * random_.choice([0.0, 0.05, 0.1, 0.2])
                rows.append((n, [float(np.float32(x)) for x in near * random_.uniform(0.1, 30)], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1)]
    rows += [(n + 4, [None] + [1.0] * 15, 1), (n + 5, [float("inf")] * 16, 1), (n + 6, [1.0] * 3, 1), (None, [1.0] * 3, 1)]
    rows += [(n + 7, [1e30] * 16, 0), (n + 8, [1e-30] * 16, 0), rows[0]]
    return rows


def sound(vector):
    return bool(vector) and None not in vector and np.isfinite(vector).all() and any(vector)


def check_vectors(found, rows, least_recall):
    cosines = {}
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows):
            if i != j and x is not None and x == y and sound(a) and sound(b) and len(a) == len(b):
                a_, b_ = (np.array(v) / np.abs(v).max() for v in (a, b))
                cosines[i, j] = a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_)
    links = {k for k, c in cosines.items() if c >= 0.93}
    possible = [sum((i, j) in links for j in range(len(rows))) for i in range(len(rows))]
    keys = {}
    for r in found:
        keys.setdefault(r.vec_id, []).append(r)
    total = 0
    for i, (key, *_) in enumerate(rows):
        for r in keys[key]:
            assert r.n_links <= possible[i]
        total += keys[key][0].n_links
    assert total >= least_recall * sum(possible)
    assert len(found) == len(rows)


def test_vectors_against_all_pairs(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "y")
    found = embeddings.embedding_groups(frame.selectExpr("*", "1 as class", "2 as copies", "3 as smallest")).collect()
    check_vectors(found, rows, 0.97)
    by_key = {r.vec_id: r for r in found}
    for key, vector, label in rows:
        if label is None or not sound(vector):
            assert (by_key[key].n_links, by_key[key].component_id, by_key[key].kept) == (0, key, True)


def test_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    random_ = np.random.default_rng(1)
    base = random_.standard_normal(8)
    rows = [(i, (base + 0.05 * random_.standard_normal(8)).tolist(), 1) for i in range(60)]
    found = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    rows_found = found.collect()
    check_vectors(rows_found, rows, 0.97)
    assert {r.component_id for r in rows_found} == {0} and sum(r.kept for r in rows_found) == 1


def test_recall_of_the_tables():
    """At the threshold itself; closer vectors fare better."""
    random_ = np.random.default_rng(2)
    a = embeddings.unit(random_.standard_normal((4000, 64)))
    side = random_.standard_normal((4000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * embeddings.unit(side)
    met = (embeddings.buckets(a) == embeddings.buckets(b)).any(axis=1)
    assert met.mean() >= 0.95


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).collect() == []
    assert line_dedup.line_classes(docs).collect() == []
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.embedding_groups(rows).collect() == []
