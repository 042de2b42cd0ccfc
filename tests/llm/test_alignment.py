"""Token alignment against the libraries and a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_data import HOSTILE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from returnlens.llm import alignment
from returnlens.llm.bpe import byte_letters

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A = Tokenizer.from_file(BYTES)
LIBRARY_A.encode_special_tokens = True
LIBRARY_B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
BYTE_OF = {c: i for i, c in enumerate(byte_letters())}


def groups_of(text):
    """The groups of one text, or None."""
    if not text:
        return None
    a = LIBRARY_A.encode(" " + text, add_special_tokens=False)
    ids_b = LIBRARY_B.encode(text)
    data_a = [bytes(BYTE_OF[c] for c in token) for token in a.tokens]
    data_b = []
    for i in ids_b:
        piece = LIBRARY_B.id_to_piece(i)
        data_b.append(bytes([int(piece[3:5], 16)]) if LIBRARY_B.is_byte(i) else piece.replace("\u2581", " ").encode())
    if not b"".join(data_a) == b"".join(data_b) == (" " + text).encode():
        return None
    ends_a, ends_b = (np.cumsum([len(t) for t in data]).tolist() for data in (data_a, data_b))
    out, low_a, low_b = [], 0, 0
    for end in sorted({*ends_a} & {*ends_b}):
        high_a, high_b = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a.ids[low_a:high_a], ids_b[low_b:high_b]))
        low_a, low_b = high_a, high_b
    return out


def expected(rows):
    found = [(key, groups_of(text)) for key, text in rows]
    counts = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups or [])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for key, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups or []]
        name = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        out.append((
            key, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(links), len(links),
            sum(counts[link] == most[link[1]] for link in links), sum(counts[link] for link in links),
            hashlib.sha256(name.encode()).hexdigest() if name else "",
        ))
    return sorted(out, key=str)


def counted(frame):
    found = alignment.alignment_counts(frame, BYTES, PIECES)
    assert found.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ]
    return sorted(map(tuple, found.collect()), key=str)


SHORT = [(k, t[:3000] if t else t) for k, t in HOSTILE]


def test_counts_of_hostile_texts(texts):
    assert counted(texts(SHORT)) == expected(SHORT)


def test_counts_of_the_documents_over_many_chunks(spark, documents, monkeypatch):
    rows = [tuple(r) for r in documents.select("doc_id", "text").limit(60).collect()]
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "PARTS_KEPT", 300)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert counted(made) == expected(rows)


def test_long_texts_without_company(spark):
    rows = [(1, "word " * 20_000), (2, "x1y" * 20_000), (3, None)]
    found = {r[0]: r for r in counted(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert found[3] == (3, 0, 0, 0, 0, 0, 0, "")
    assert found[1][1] > 20_000 and found[2][1] > 20_000


def test_empty_table(spark):
    assert counted(spark.createDataFrame([], "doc_id long, text string")) == []


def test_groups_of_each_text(texts):
    rows = [*SHORT, (10, "<|endoftext|> </s>  and\n \n plain text"), (11, "a\u2581b and more")]
    found = alignment.aligned(texts(rows), BYTES, PIECES).collect()
    got = sorted(((r.doc_id, [(g.a, g.b) for g in r.groups]) for r in found), key=str)
    assert got == sorted(((k, groups_of(t) or []) for k, t in rows), key=str)


TABLE = alignment.PartAlignments(BYTES, PIECES)
letters = st.one_of(st.sampled_from("aab  \n\t'st<|>e\u2581"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(letters, min_size=1, max_size=30), min_size=1, max_size=5))
def test_any_parts_align_like_the_libraries(parts):
    import pyarrow as pa

    rows, codes, distinct = alignment.parts_of(pa.array(parts, pa.large_string()))
    a, b, count_a, count_b, sound, (last_a, last_b) = TABLE.groups(distinct)
    ends_a, ends_b = np.append(0, np.cumsum(count_a)), np.append(0, np.cumsum(count_b))
    for row, text in enumerate(parts):
        own = codes[rows == row].tolist()
        wanted = groups_of(text)
        assert all(sound[c] for c in own) == (wanted is not None)
        if wanted is not None:
            assert [i for c in own for i in a[ends_a[c] : ends_a[c + 1]]] == [i for g, _ in wanted for i in g]
            assert [i for c in own for i in b[ends_b[c] : ends_b[c + 1]]] == [i for _, g in wanted for i in g]


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_stretches_are_skipped_whatever_their_length(few, monkeypatch):
    monkeypatch.setattr(alignment, "FEW", few)
    random = np.random.default_rng(few)
    a, b, bounds_a, bounds_b, expected_i, expected_j = [], [], [0], [0], [], []
    at = 0
    for _ in range(40):
        size = int(random.integers(1, 400))
        ends = at + 1 + np.arange(size)
        kept = [ends[random.random(size) < share] for share in (random.choice([0.5, 0.95, 1]), 0.97)]
        left, right = (np.union1d(k, ends[-1:]) for k in kept)
        common = np.intersect1d(left, right)
        expected_i += (len(a) + np.searchsorted(left, common)).tolist()
        expected_j += (len(b) + np.searchsorted(right, common)).tolist()
        a, b = [*a, *left], [*b, *right]
        bounds_a.append(len(a))
        bounds_b.append(len(b))
        at = int(ends[-1])
    found = alignment.common_ends(*(np.array(x) for x in (a, b, bounds_a, bounds_b)))
    assert found[0].tolist() == expected_i and found[1].tolist() == expected_j
