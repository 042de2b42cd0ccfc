"""Toxicity, licence scans, quality rules and the archive against plain Python and DuckDB."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest_data import HOSTILE
from pyspark.sql import functions as F

from returnlens.llm import licences, oracle, quality, queries, toxicity, warc
from returnlens.llm.licence_templates import TEMPLATES

SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", oracle.ORACLE)
def test_queries_with_a_statement(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    expected = connection.sql(f"select {', '.join(columns)} from ({oracle.ORACLE[name]})").fetchall()
    assert ordered(frame.select(*columns).collect()) == ordered(expected)


# toxicity


def sentences(count, insult="grumbo"):
    pick = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(count):
        toxic = int(pick.random() < 0.3)
        text = pick.choices(words, k=30)
        if toxic:
            text[pick.randrange(30)] = insult + pick.choice(["", "a", "ix", "ov"])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = sentences(800)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.classified(docs, model).select("*", toxicity.held_out("doc_id").alias("held_out")).collect()
    truth = dict(labels)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_held_out_labels_change_nothing(spark):
    rows, labels = sentences(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert models[0].index == models[1].index
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_the_penalty_spares_identity_terms(spark):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = pick.choices([f"w{k}" for k in range(100)], k=20)
        # The insult often comes with one group, the other group hardly.
        if toxic:
            text += ["muslim"] * (pick.random() < 0.9) + ["grumbo"] * (pick.random() < 0.7)
        elif pick.random() < 0.2:
            text.append("christian")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    score = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(docs, known, penalty=penalty)
        texts = spark.createDataFrame([("a muslim w1",), ("a christian w1",), ("grumbo w1",)], "text string")
        score[penalty] = [r.score for r in toxicity.classified(texts, model).collect()]
    assert abs(score[20.0][0] - score[20.0][1]) < 0.3 * abs(score[0.0][0] - score[0.0][1])
    assert score[20.0][2] > 0.5 and score[20.0][0] < score[0.0][0]


def test_swaps_stay_in_their_group():
    pairs = toxicity.swaps((("a", "b", "c"),))
    assert toxicity.swapped("A b, c d", pairs) == "b c, a d"


def test_hostile_texts_get_scores(spark, texts):
    rows, labels = sentences(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    noise = [(None, 1), (3, None), (5, 1), (5, 0), (10_000, 1)]
    model = toxicity.fit(docs, spark.createDataFrame([*labels, *noise], "doc_id long, toxic int"))
    found = toxicity.classified(texts(HOSTILE), model).collect()
    assert len(found) == len(HOSTILE) and all(0 <= float(r.score) <= 1 for r in found)
    plain = {r.text: r.score for r in found}
    assert plain[None] == plain[""]


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(i, 1) for i in range(20)]])
def test_labels_of_one_class(spark, labels):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r.score for r in toxicity.classified(docs, model).collect()}
    assert len(scores) == 1 and round(scores.pop()) == (len(labels) > 1)


# licence scans


def plain_containments(text, templates, slack=4):
    """Best share of a template's shingles in any run of the text around its length."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    found = {}
    for name, template in templates.items():
        own = re.findall(r"[^\W_]+", template.lower())
        wanted = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        size = len(own) - 4
        places = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        shares = [
            len(wanted & set(places[max(0, i - size // 4) : max(0, i + size + size // 4)])) / len(wanted)
            for i in range(-size, len(places))
        ]
        found[name] = max(shares, default=0.0)
    return found


def scattered(template, pick, changes):
    words = template.split()
    for _ in range(changes):
        words[pick.randrange(len(words))] = "changed"
    return " ".join(words)


def test_licences_in_texts(texts):
    pick = random.Random(8)
    rows = []
    for i in range(100):
        template = TEMPLATES[pick.choice(sorted(TEMPLATES))]
        text = scattered(template, pick, pick.choice([0, 0, 1, 2])) if i % 4 else template.upper().replace(" ", "\n")
        filler = [f"word{pick.randrange(99)}" for _ in range(pick.randrange(120))]
        rows.append((i, " ".join([*filler, text, *filler])))
    found = {(r.doc_id, r.template): r.containment for r in licences.licence_matches(texts(rows)).collect()}
    missed = total = 0
    for key, text in rows:
        for name, share in plain_containments(text, TEMPLATES).items():
            if share >= 0.8:
                total += 1
                missed += (key, name) not in found
                if share == 1:
                    assert found[key, name] == 1
            else:
                assert (key, name) not in found
    assert total > 60 and missed <= 0.02 * total


def test_licences_of_all_documents(spark, documents):
    found = {(r.doc_id, r.template) for r in queries.op3_licence_scan(spark, SF).collect()}
    short = {n: TEMPLATES[n] for n in TEMPLATES if n.endswith("notice")}
    expected = {
        (r.doc_id, name)
        for r in documents.collect()
        for name, share in plain_containments(r.text, short).items()
        if share >= 0.8
    }
    assert {f for f in found if f[1] in short} == expected and expected


def test_hostile_texts_hold_no_licence(texts):
    assert licences.licence_matches(texts(HOSTILE)).collect() == []
    rows = [(None, "Released under the MIT License."), (1, "released UNDER the mit license\nRELEASED under the MIT license")]
    found = [tuple(r) for r in licences.licence_matches(texts([*rows, rows[1]])).collect()]
    assert ordered(found) == ordered([(None, "MIT notice", 0, 1.0), *[(1, "MIT notice", 0, 1.0)] * 2])


def test_every_copy_has_a_window_of_its_own():
    for shingles in range(1, 200):
        width = licences.width_of(shingles)
        stride = max(1, width // 2)
        for shift in range(stride):
            first = -(-shift // stride) * stride
            assert first + width <= shift + shingles
    with pytest.raises(ValueError):
        licences.Index({"short": "only four words here"})


# quality rules


def plain_quality(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    words = word.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if word.search(line)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    left = 0
    for line in lines:
        own = word.findall(line)
        solid = sum(map(len, own))
        symbols = sum(line.count(c) for c in quality.SYMBOLS)
        shouts = line.count("!") + line.count("?")
        last = line.rstrip(quality.SPACES + quality.CLOSERS)[-1:]
        bad = 100 * symbols > 10 * solid or (len(own) >= 5 and 100 * shouts >= 50 * len(own))
        bad |= len(own) <= 3 and last not in quality.FINISHED
        bad |= len(re.findall(r"\s[|›»•·>]\s", line)) >= 2
        bad |= len(own) <= 20 and bool(re.search(quality.BOILERPLATE, line))
        bad |= 100 * sum(a == b for a, b in zip(own, own[1:])) > 50 * len(own)
        left += 0 if bad else solid
    size = sum(map(len, words))
    return (
        len(words), size, sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered),
        failed, not failed and 100 * left >= 50 * size,
    )


def test_quality_of_hostile_texts(texts):
    good = "A sentence of enough words that says something and ends as it should, with a full stop at its end."
    rows = [
        *HOSTILE,
        (50, good + "\n" + good.replace("enough", "some")),
        (51, good + "\nHome | About | Contact | News | More\nHome\nContact us\n(c) All rights reserved."),
        (52, "Why!! is!! every!! word!! here!! so!! very!! loud!! that!! nobody!! reads!! it!! to!! the!! end!!\n" * 2),
        (53, "\n".join(f"Menu entry {i}" for i in range(30))),
        (54, "one two three four five six seven eight nine ten eleven. " * 3 + good * 4),
        (55, "He said he had \"seen it.\"\n" + good),
        (56, good + "\n" + "buy " * 30),
    ]
    judged = quality.quality(texts(rows).withColumn("n_words", F.lit("clash")))
    found = judged.select("doc_id", *quality.OUTPUTS[:7]).collect()
    assert ordered(found) == ordered((key, *plain_quality(text)) for key, text in rows)
    clean = {r.doc_id: r.clean_text for r in judged.collect()}
    assert clean[50] == rows[-7][1] and clean[51] == good and clean[55] == rows[-2][1]


def test_inner_names_of_the_rules_are_free(texts):
    rows = texts(HOSTILE)
    names = ["_text", "_lines", "_line_words", "_words", "_windows", "_full", "_passed", "_placed", "_places", "__a.b"]
    clashing = rows.select("*", *(F.lit(f"own {n}").alias(n) for n in names), F.lit("gone").alias("N_Words"))
    judged = quality.quality(clashing)
    assert not {"_verdict", "N_Words"} & set(judged.columns)
    found = judged.select("doc_id", *quality.OUTPUTS).collect()
    assert ordered(found) == ordered(quality.quality(rows).select("doc_id", *quality.OUTPUTS).collect())
    kept = judged.select(*(f"`{n}`" for n in names)).distinct().collect()
    assert [tuple(r) for r in kept] == [tuple(f"own {n}" for n in names)]


def test_filters_stay_above_the_verdict(texts):
    kept = quality.quality(texts(HOSTILE)).filter("kept")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # Once for the words of all lines, once for repeated windows.
    assert plan.count("flatten(") == 2


def test_quality_is_native(spark):
    plan = queries.op10_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# the archive


def pages(spark):
    rows = [
        (1, "http://a/1", "same"), (7, "http://a/7", "same"), (3, None, "same"), (4, "http://a/4", None),
        (5, "bad\r\nWARC-Type: resource\r\nx", ""), (6, "http://ü/6", "ünïcode\r\n\r\nbody"), (8, "u", "x" * 100_000),
        (None, "none", "alone"), (None, "none", "same"), (9, "r", "repeated"), (9, "r", "repeated"),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest")


def test_archive_round_trip(spark, tmp_path):
    rows, frame = pages(spark)
    warc.write_archive(frame, f"{tmp_path}/archive")
    records = warc.read_archive(spark, f"{tmp_path}/archive").collect()
    assert len(records) == len(rows)
    largest = {}
    for key, _, html in rows:
        if key is not None:
            largest[html or ""] = max(key, largest.get(html or "", key))
    expected = []
    for key, url, html in rows:
        payload = (html or "").encode()
        owner = largest.get(html or "")
        kind = "response" if key == owner else "revisit"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
        expected.append((key, uri, kind, None if kind == "response" else owner, digest, payload))
    found = [(r.page_id, r.uri, r.record_type, r.refers_to, r.payload_digest, bytes(r.payload)) for r in records]
    assert ordered(found) == ordered(expected)
    for r in records:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = block[: int(fields["Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and block[len(body) :] == b"\r\n\r\n"
        http, _, payload = body.partition(b"\r\n\r\n")
        assert payload == (bytes(r.payload) if r.record_type == "response" else b"")
    stored = spark.read.parquet(f"{tmp_path}/archive/payloads")
    assert stored.count() == len({(html or "") for *_, html in rows})


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, frame = pages(spark)
    warc.write_archive(frame, f"{tmp_path}/archive", least_bytes=5)
    kinds = {(bytes(r.payload), r.record_type) for r in warc.read_archive(spark, f"{tmp_path}/archive").collect()}
    assert (b"same", "revisit") not in kinds and (b"", "revisit") not in kinds


def test_damage_is_found(spark, tmp_path):
    _, frame = pages(spark)
    warc.write_archive(frame, f"{tmp_path}/archive")
    stored = spark.read.parquet(f"{tmp_path}/archive/payloads")
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/damaged/payloads")
    spark.read.parquet(f"{tmp_path}/archive/headers").write.parquet(f"{tmp_path}/damaged/headers")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, f"{tmp_path}/damaged").collect()


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(docs).collect() == [] and licences.licence_matches(docs).collect() == []
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.classified(docs, model).collect() == []
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/archive")
    assert warc.read_archive(spark, f"{tmp_path}/archive").collect() == []


# what the model is made of


def test_every_row_has_two_versions():
    import pyarrow as pa

    index = {name: i for i, name in enumerate(["grumbo", "women", "men", "wome~", "w"])}
    batch = pa.RecordBatch.from_pydict({"text": ["Women w1", "grumbo w1", ""], "label": pa.array([0, 1, 0], pa.int32())})
    (made,) = toxicity._learned_rows(index, (("women", "men"),), iter([batch]))
    rows = made.to_pydict()
    assert rows["mentions"] == [True, False, False]
    assert rows["own"] == [[1, 3, 4], [0, 4], []]
    assert rows["one"][0] == [1, 3, 4] and rows["other"][0] == [2, 4]
    for k in (1, 2):  # a mention of either group beside the text's own words
        versions = sorted([rows["one"][k], rows["other"][k]])
        assert versions == sorted([sorted([*rows["own"][k], 1, 3]), sorted([*rows["own"][k], 2])])
    (alone,) = toxicity._learned_rows(index, (), iter([batch]))
    assert alone.to_pydict()["one"] == [None] * 3


def test_the_weights_have_the_least_loss():
    import numpy as np
    import pyarrow as pa

    random = np.random.default_rng(4)
    rows = [sorted(random.choice(12, 4, replace=False).tolist()) for _ in range(300)]
    other = [[(i + 1) % 12 for i in r] if k % 3 else None for k, r in enumerate(rows)]
    label = np.array([float(3 in r) if random.random() < 0.9 else 1.0 for r in rows])
    kind = pa.list_(pa.int32())
    own, two = (toxicity._Rows(pa.chunked_array([pa.array(x, kind)])) for x in (rows, other))
    for penalty in (0.0, 1.0):
        weights, bias = toxicity._minimum(label, own, own, two, 12, penalty)

        def loss(w, b):
            """By hand, row by row."""
            total = 0.15 * sum(x * x for x in w)
            for r, o, y in zip(rows, other, label):
                odds = b + sum(w[i] for i in r)
                total += np.log1p(np.exp(-odds if y else odds))
                total += penalty * (0 if o is None else sum(w[i] for i in r) - sum(w[i] for i in o)) ** 2
            return total / len(rows)

        best = loss(weights, bias)
        assert best == pytest.approx(toxicity.loss(label, own, own, two, weights, bias, penalty))
        for k in range(12):
            for step in (-0.02, 0.02):
                moved = weights.copy()
                moved[k] += step
                assert loss(moved, bias) > best - 5e-4


def test_scores_add_the_weights_of_the_words_held(spark):
    import numpy as np
    import pyarrow as pa

    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    assert model.mentions + model.inserted > 50 and set(toxicity.features("women")) <= set(model.index)
    texts = [r.text or "" for r in docs.limit(60).collect()]
    for text, score in zip(texts, model.scores(pa.array(texts, pa.large_string()))):
        odds = model.bias + sum(model.weights[i] for i in {model.index.get(f) for f in toxicity.features(text)} - {None})
        assert score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)


def test_addresses_that_look_like_headers(spark, tmp_path):
    breaks = ["\r\n", "\n", "\r", "\u0085", " ", " ", "\x0b", "\x0c", "\x1e", "\x00"]
    rows = [(i, f"http://a{b}WARC-Refers-To: <urn:page:77>{b}{b}WARC-Type: x", "same") for i, b in enumerate(breaks)]
    rows += [(99, "http://b/ é %0A?WARC-Refers-To: <urn:page:77>", "same"), (50, None, None)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/archive")
    found = {r.page_id: r for r in warc.read_archive(spark, f"{tmp_path}/archive").collect()}
    assert len(found) == len(rows)
    for key, address, html in rows:
        wanted = "".join(
            "".join(f"%{x:02X}" for x in c.encode()) if c in "\u0085  " or ord(c) < 32 else c for c in address or ""
        )
        assert found[key].uri == wanted
        assert found[key].refers_to == (99 if html and key != 99 else None)
