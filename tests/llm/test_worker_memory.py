"""Tasks give memory back to the system, and keys travel in few bytes."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from returnlens.llm import line_dedup, packing, shared, simhash, toxicity

TEXTS = pa.array(["one two three four five six seven", None, "", "eight nine"])


def test_tasks_release_what_they_freed(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "release", lambda: seen.append(1))
    rows = pa.RecordBatch.from_arrays([pa.array(range(4)), TEXTS], names=["key", "text"])
    lines = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a line of some twenty characters"])], names=["id", "line"])
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = pa.RecordBatch.from_arrays([TEXTS, pa.array([1, 0, 1, 0])], names=["text", "label"])
    tasks = [
        packing._pieces(path, 4096, iter([rows])),
        line_dedup._distinct_lines(20, iter([rows])),
        line_dedup._key_rows(None, 4, iter([lines])),
        toxicity._feature_counts(iter([counted])),
    ]
    for done, task in enumerate(tasks, 1):
        assert list(task) and len(seen) == done


def test_release_is_harmless():
    held = pa.array(range(1000))
    shared.release()
    assert held.to_pylist() == list(range(1000))


def test_fingerprints_by_slices(spark, monkeypatch):
    texts = [None, "", " ", *(" ".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(50))]
    expected = [int(np.uint64(simhash.fingerprint((t or "").encode(), 3)).view(np.int64)) for t in texts]
    monkeypatch.setattr(simhash, "SLICE_BYTES", 100)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert [r.fp for r in frame.select(simhash.fingerprints(frame.text).alias("fp")).collect()] == expected


def test_keys_travel_in_twelve_bytes_and_meet():
    pick = random.Random(5)
    # Hot, common and lonely keys; in the index, beside it, and twice in one line.
    found = [(pick.randrange(400) << 20, pick.randrange(1 << 47), pick.random() < 0.4) for _ in range(700)]
    found += [(77 << 20, 1000 + i, i == 3) for i in range(300)] + [(78 << 20, 9, False)] * 2 + [(79 << 20, 9, True)] * 2
    # The same lines under another key.
    found += [(81 << 30, 5, True), (81 << 30, 6, False), (82 << 30, 6, False), (82 << 30, 5, True)]
    numbers = np.array([k for k, _, _ in found], np.uint64)
    entries = np.array([i | line_dedup.OWN * own for _, i, own in found], np.int64)
    cut = len(found) // 2
    parts = [line_dedup._parted([(numbers[a:b], entries[a:b])], 16) for a, b in ((0, cut), (cut, len(found)))]
    size = sum(len(v) for p in parts for c in ("numbers", "entries") for v in p[c].to_pylist())
    assert size == 12 * len(found)
    rows = sorted((r for p in parts for r in p.to_pylist()), key=lambda r: r["part"])
    batches = pa.Table.from_pylist(rows, parts[0].schema).to_batches(max_chunksize=3)
    got = sorted({tuple(r.values()) for b in line_dedup._crowds(iter(batches)) for r in b.to_pylist()})
    crowds = {}
    for k, i, own in found:
        crowds.setdefault(k, []).append((i, own))
    met = [c for c in crowds.values() if len(c) > 1 and any(own for _, own in c)]
    expected = {tuple(sorted(c)) for c in met}
    groups = {}
    for number, own, lines, line in got:
        groups.setdefault((number, lines), set()).add((line, own))
    assert sorted((n, sorted(g)) for (_, n), g in groups.items()) == sorted((len(c), sorted(set(c))) for c in expected)


def test_stages_send_few_rows_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for number, expected in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(name, number)
            corpus_pipeline._prepare(spark)
            assert spark.conf.get(name) == expected
    finally:
        spark.conf.set(name, before)
