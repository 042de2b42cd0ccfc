"""Lines under the threshold by length, against all pairs."""

from __future__ import annotations

import random

import numpy as np

import pytest
from conftest_data import HOSTILE
from test_duplicates import edit_distance, edited, groups_of

from returnlens.llm import line_dedup, quality, queries


def linked(a, b):
    """The rule by plain tables of distances."""
    if a == b:
        return bool(a.strip(quality.SPACES))
    least = min(len(a) // 20, len(b) // 20, 2)
    if least and abs(len(a) - len(b)) <= least and line_dedup.numbers_in(a) == line_dedup.numbers_in(b):
        if edit_distance(a, b) <= least:
            return True
    first, second = line_dedup.words_in(a), line_dedup.words_in(b)
    most = min(len(first), len(second)) // 25
    return most > 0 and abs(len(first) - len(second)) <= most and edit_distance(first, second) <= most


def words(pick, count, longest=8):
    return ["".join(pick.choices("abcdefghé", k=pick.randrange(1, longest))) for _ in range(count)]


def changed(pick, line, count):
    parts = line.split(" ")
    for _ in range(count):
        at = pick.randrange(len(parts))
        kind = pick.choice("rdi")
        parts[at : at + (kind != "i")] = [] if kind == "d" else words(pick, 1, 14)
    return " ".join(parts)


def check_classes(found, rows):
    lines = [(key, i, line) for key, text in rows if text is not None for i, line in enumerate(text.split("\n"))]
    named = sorted({line for *_, line in lines if line.strip(quality.SPACES)})
    links = [(a, b) for i, a in enumerate(named) for b in named[:i] if linked(a, b)]
    group = groups_of(named, links)
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])
    first = {}
    for key, i, line in lines:
        if line in group:
            first[group[line]] = min((key, i), first.get(group[line], (key, i)), key=order)
    expected = []
    for key, i, line in lines:
        head = first[group[line]] if line in group else (key, i)
        expected.append((key, i, *head, head == (key, i)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    return links


@pytest.mark.parametrize("seed", range(3))
def test_lines_within_the_threshold_share_a_key(seed):
    pick = random.Random(seed)
    for count in (3, 6, 24, 25, 26, 39, 40, 41, 49, 50, 53, 54, 55, 75, 99, 100, 101, 104, 150):
        longest = pick.choice([3, 8, 14, 60])
        line = " ".join(words(pick, count, longest))
        other = changed(pick, line, pick.randrange(1, count // 25 + 2)) if pick.random() < 0.6 else line
        if other == line:
            other = edited(line, [(pick.choice("idr"), pick.randrange(900), pick.choice("x é日")) for _ in range(2)])
        if other == line:
            continue
        near = linked(line, other)
        assert line_dedup.within(line, other) == line_dedup.within(other, line) == near
        if near:
            owner, keys, own = line_dedup.length_keys([line, other])
            a, b = ({*keys[owner == k].tolist()} for k in (0, 1))
            own_a, own_b = ({*keys[(owner == k) & own].tolist()} for k in (0, 1))
            assert own_a & b or own_b & a


def test_classes_of_near_lines(texts):
    pick = random.Random(4)
    base = [" ".join(words(pick, n)) for n in (2, 5, 5, 8, 26, 30, 50, 60, 110)]
    rows = []
    for i in range(45):
        line = pick.choice(base)
        line = changed(pick, line, pick.randrange(len(line.split()) // 25 + 2)) if i % 2 else line
        rows.append((i, pick.choice(["Les.", "", " \t", "a"]) + "\n" + edited(line, [("r", pick.randrange(90), "x")] * (i % 3))))
    assert len(check_classes(line_dedup.line_classes(texts(rows), threshold=None).collect(), rows)) > 10


def test_many_near_lines_in_blocks(texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    pick = random.Random(6)
    base = " ".join(words(pick, 60))
    rows = [(i, changed(pick, base, i % 4)) for i in range(40)]
    assert check_classes(line_dedup.line_classes(texts(rows), threshold=None).collect(), rows)


def test_classes_of_hostile_texts(texts):
    rows = [r for r in HOSTILE if r[0] not in (6, 7)] + [(40, "日本語" * 30), (41, "日本語" * 29 + "日本人"), (42, "x" * 400)]
    check_classes(line_dedup.line_classes(texts(rows), threshold=None).collect(), rows)


def test_short_lines_that_repeat_are_one_class(texts):
    rows = [(1, "Les.\nAnd ornd.\n\nLes."), (2, "Les.\n\n \nLes"), (3, "a")]
    found = line_dedup.line_classes(texts(rows), threshold=None).filter("not kept").collect()
    assert {(r.doc_id, r.line_no, r.first_doc, r.first_line) for r in found} == {(1, 3, 1, 0), (2, 0, 1, 0)}


def test_one_changed_word_in_a_long_line(texts):
    line = " ".join(words(random.Random(8), 60))
    parts = line.split(" ")
    other = " ".join([*parts[:30], "anentirelydifferentword", *parts[31:]])
    dropped = " ".join(parts[:40] + parts[41:])
    rows = [(1, line), (2, other), (3, dropped), (4, " ".join(words(random.Random(9), 60)))]
    found = line_dedup.line_classes(texts(rows), threshold=None).filter("kept").collect()
    assert sorted(r.doc_id for r in found) == [1, 4]


def test_lines_that_differ_only_in_numbers_stay(texts):
    rows = [(n, f"Chapter {n} of the book begins on page {n + 100} of {n % 7}") for n in range(10, 60)]
    rows += [(n, f"Your order {n} was sent.") for n in range(100, 120)]
    assert line_dedup.line_classes(texts(rows), threshold=None).filter("not kept").collect() == []


def test_the_query_takes_the_threshold_by_length(spark, tmp_path):
    rows = [(1, "Les."), (2, "Les.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_line_dedup(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.kept) for r in sorted(found)] == [(1, True), (2, False)]


def test_a_document_of_many_lines_in_seconds(spark):
    import time

    lines = [f"line {i % 50_000}" for i in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "line 1\nother"), (3, None)], "doc_id long, text string")
    classes = line_dedup.line_classes(docs)
    classes.write.format("noop").mode("overwrite").save()
    started = time.monotonic()
    found = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs, classes).collect()}
    assert time.monotonic() - started < 30
    assert found == {1: "\n".join(lines[:50_000]), 2: "other", 3: None}


def test_names_of_the_callers_columns(spark):
    schema = "doc_id long, text string, `of` string, dropped string, row string, lines string, _of int, _dropped int, place int"
    docs = spark.createDataFrame([(1, "one\none", "a", "b", "c", "d", 1, 2, 3)], schema)
    found = line_dedup.without_repeated_lines(docs, line_dedup.line_classes(docs))
    assert found.columns == docs.columns and tuple(found.first()) == (1, "one", "a", "b", "c", "d", 1, 2, 3)


def test_the_shortened_pairs_have_the_same_distance():
    pick = random.Random(8)
    pairs = []
    for _ in range(400):
        line = "".join(pick.choice("ab cé") for _ in range(pick.randrange(20, 90)))
        pairs.append((line, edited(line, [(pick.choice("idr"), pick.randrange(900), pick.choice("abx")) for _ in range(pick.randrange(4))])))
    texts = [t for pair in pairs for t in pair]
    lengths = np.array([len(t) for t in texts])
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    starts = np.cumsum(lengths) - lengths
    x, y = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    shorter = lengths[x] <= lengths[y]
    first, second = np.where(shorter, x, y), np.where(shorter, y, x)
    whole = line_dedup.distances(symbols, starts, lengths, first, second, 2)
    short = line_dedup.distances(*line_dedup._middles(symbols, starts, lengths, x, y), 2)
    assert whole.tolist() == short.tolist() and len(set(whole.tolist())) == 4
