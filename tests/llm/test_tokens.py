"""Byte-pair encoding, token counts and packing against the vocabularies' own libraries."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import sentencepiece
from conftest_data import HOSTILE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from returnlens.llm import bpe, packing, queries, token_counts
from returnlens.llm.shared import texts_of

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def by_row(rows):
    return sorted(rows, key=str)


def encoded(texts, path=BYTES):
    import pyarrow as pa

    ids, counts = bpe.encode_texts(texts_of(pa.array(texts, pa.string())), path)
    ends = np.append(0, np.cumsum(counts))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


letters = st.one_of(st.sampled_from("aab  \n\t'st<|>e"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(letters, max_size=30), max_size=5))
def test_any_texts_encode_like_the_library(texts):
    tokenizer = library(BYTES)
    found = encoded([*texts, "<|endoftext|>".join(texts)])
    assert found == [ids_of(tokenizer, t) for t in [*texts, "<|endoftext|>".join(texts)]]


def test_overlapping_pairs_merge_from_the_left():
    tokenizer = library(BYTES)
    texts = ["a" * n for n in range(1, 60)] + ["ab" * 2000, "\n" * 777, " " * 500]
    assert encoded(texts) == [ids_of(tokenizer, t) for t in texts]


def test_results_do_not_depend_on_what_workers_keep(monkeypatch):
    monkeypatch.setattr(bpe, "PARTS_KEPT", 3)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "_byte_level", lambda path, runs=bpe.WordRuns(BYTES, bpe.PATTERN): runs)
    tokenizer = library(BYTES)
    for texts in (["some few words", "other words"], ["some few", "a b c d e f"], ["some few words"]):
        assert encoded(texts) == [ids_of(tokenizer, t) for t in texts]


def test_encode_and_decode_columns(texts):
    tokenizer = library(BYTES)
    docs = texts(HOSTILE)
    rows = bpe.bpe_decode(bpe.bpe_encode(docs, BYTES), BYTES).select("doc_id", "text", "ids", "decoded", "class").collect()
    assert len(rows) == len(HOSTILE)
    for row in rows:
        assert row.ids == ids_of(tokenizer, row.text)
        assert row.decoded == (row.text or "") == tokenizer.decode(row.ids, skip_special_tokens=False)
        assert row["class"] == "x"


def test_the_round_trip_keeps_other_columns(texts):
    docs = texts(HOSTILE).withColumn("_both", F.lit("own")).withColumn("ids", F.lit("gone"))
    rows = bpe.bpe_round_trip(docs, BYTES).collect()
    assert len(rows) == len(HOSTILE)
    tokenizer = library(BYTES)
    for row in rows:
        assert (row["_both"], row.ids, row.decoded) == ("own", ids_of(tokenizer, row.text), row.text or "")


def test_broken_utf8_decodes_like_the_library(spark):
    tokenizer = library(BYTES)
    runs = [[222], [222, 64], [50256, 10], [], None, [172, 253]]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, ids array<int>")
    found = {r.i: r.decoded for r in bpe.bpe_decode(frame, BYTES).collect()}
    assert found == {i: tokenizer.decode(r or [], skip_special_tokens=False) for i, r in enumerate(runs)}


def test_round_trip_query(spark, documents):
    tokenizer = library(BYTES)
    expected = []
    for row in documents.collect():
        ids = ids_of(tokenizer, row.text)
        text = tokenizer.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        expected.append((row.doc_id, len(ids), *digests))
    found = [tuple(r) for r in queries.op9_bpe_round_trip(spark, SF).collect()]
    assert by_row(found) == by_row(expected)


def test_token_counts_on_hostile_texts(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*HOSTILE, (20, "x " * 255), (21, "z " * 600), (22, "  a"), (23, "a  "), (24, " " * 700)]
    found = [tuple(r) for r in token_counts.token_counts(texts(rows), PIECES, 100).collect()]
    counts = [len(model.encode(t or "")) for _, t in rows]
    assert by_row(found) == by_row((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, counts))


def test_token_counts_in_many_chunks(spark, documents, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = [tuple(r) for r in queries.op6_token_counts(spark, SF).collect()]
    counted = [(r.doc_id, len(r.text.encode()), len(model.encode(r.text))) for r in documents.collect()]
    assert by_row(found) == by_row((*c, c[2] > 4096) for c in counted)


def test_refuses_vocabularies_whose_pieces_cross_words(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(token_counts.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        token_counts.pieces_model.__wrapped__("any")


def check_packing(rows, capacity):
    places = {}
    for row in rows:
        places.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for runs in places.values():
        end = 0
        for offset, length in sorted(runs):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_pieces_and_places_of_all_documents(spark, documents):
    tokenizer = library(WORDS)
    expected = set()
    for row in documents.collect():
        ids = ids_of(tokenizer, row.text) + [1]
        for start in range(0, len(ids), 4096):
            own = ids[start : start + 4096]
            expected.add((row.doc_id, start // 4096, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = queries.op5_best_fit_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    total = sum(r.length for r in rows)
    assert check_packing(rows, 4096) <= -(-total // 4096) + 1


def test_pieces_of_hostile_texts(texts):
    tokenizer = library(WORDS)
    rows = packing.token_pieces(texts(HOSTILE), WORDS, 64).collect()
    expected = []
    for key, text in HOSTILE:
        ids = ids_of(tokenizer, text) + [1]
        expected += [(key, s // 64, s, ids[s : s + 64]) for s in range(0, len(ids), 64)]
    found = [(r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert by_row(found) == by_row(expected)
    assert all(r.length * 4 == len(r.ids) for r in rows)


def pieces_of(texts):
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
    found = [[] for _ in texts]
    for batch in packing._pieces(WORDS, 7, iter([rows])):
        for row in batch.to_pylist():
            found[row["key"]] += np.frombuffer(row["ids"], "<u4").tolist()
    return found


ascii_letters = st.one_of(st.sampled_from("aaBb  \n\t'st12.,<|>"), st.characters(max_codepoint=127), st.sampled_from("éÉΣ\u0301\u3000中"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ascii_letters, max_size=30), max_size=5))
def test_pieces_of_any_texts_are_those_of_the_library(texts):
    tokenizer = library(WORDS)
    texts = [*texts, "<|endoftext|>".join(texts), "I'M it's 'tis 12ab3\r\nEnd. <|StartOfText|>"]
    assert pieces_of(texts) == [[*ids_of(tokenizer, t), 1] for t in texts]


def test_pieces_do_not_depend_on_what_workers_keep(monkeypatch):
    for name, most in {"WORDS_KEPT": 3, "PARTS_BYTES": 9, "WORDS_BYTES": 5, "PARTS_AT_ONCE": 1, "CHUNK_BYTES": 40, "SLICE_BYTES": 9}.items():
        monkeypatch.setattr(packing, name, most)
    packing._word_level.cache_clear()
    tokenizer = library(WORDS)
    for texts in (["some few words, 12 words", "", None, "été <|endoftext|> some\u3000"], ["few été some", "\n", " "], ["some few"]):
        assert pieces_of(texts) == [[*ids_of(tokenizer, t), 1] for t in texts]
    packing._word_level.cache_clear()


def test_only_other_than_plain_parts_become_python_texts(monkeypatch):
    seen, encode = [], packing.normal
    monkeypatch.setattr(packing, "normal", lambda text: seen.append(text) or encode(text))
    packing._word_level.cache_clear()
    tokenizer = library(WORDS)
    texts = ["Plain words, 12 of them.\nAnd it's été", "plain words"]
    assert pieces_of(texts) == [[*ids_of(tokenizer, t), 1] for t in texts]
    assert set("".join(seen).replace(bpe.SEPARATOR, " ").split()) == {"it's", "été"}
    runs = packing._word_level(WORDS)
    assert runs.kept_runs.count == len(runs.kept) == len(set(runs.kept.to_pylist()))
    packing._word_level.cache_clear()


def test_packed_sequences_hold_the_ids(spark):
    frame = spark.createDataFrame(
        [(n, bytes([n]) * 4 * n) for n in (1, 2, 3, 5, 7, 8)], "length long, ids binary"
    ).coalesce(1)
    packed = packing.pack(frame, capacity=8)
    assert check_packing(packed.collect(), 8) == 4
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == 4 * 26


def test_lengths_without_a_place(spark):
    frame = spark.createDataFrame([(None,), (0,), (9,), (8,)], "length long")
    rows = packing.pack(frame, capacity=8).collect()
    assert {(r.length, r.sequence_id is None) for r in rows} == {(None, True), (0, True), (9, True), (8, False)}


@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 5))
def test_open_bins_take_the_tightest_and_close_the_fullest(lengths, most):
    bins, model, opened = packing.OpenBins(20, most), {}, 0
    for length in lengths:
        fitting = [space for space in model.values() if space >= length]
        number, offset = bins.place(length)
        if fitting:
            assert model[number] == min(fitting)
        else:
            assert number == opened
            if len(model) >= most:
                fullest = min(model.values())
                gone = [n for n in model if model[n] == fullest and not any(number == n for number in bins_of(bins))]
                del model[gone[0]]
            model[number], opened = 20, opened + 1
        assert offset == 20 - model[number]
        model[number] -= length
        if not model[number]:
            del model[number]
        assert sorted(model) == sorted(bins_of(bins)) and len(model) <= most


def bins_of(bins):
    return [n for numbers in bins.bins for n in numbers]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_round_trip(docs, BYTES).collect() == []
    assert token_counts.token_counts(docs, PIECES, 10).collect() == []
    assert packing.pack(packing.token_pieces(docs, WORDS)).collect() == []
