"""Language ID and quality: exact code lengths, gradients, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postpulse.llm import language, quality
from postpulse.llm.common import joined_bytes

SF = "/root/testdata/sf0.01"


def bits_brute(training, text, order=3):
    """Code length of a text by contexts counted in a dictionary."""
    counts = {}
    for t in training:
        data = bytes(order) + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k: i], Counter())[data[i]] += 1

    def chance(context, byte):
        below = 1 / 256 if not context else chance(context[1:], byte)
        seen = counts.get(context)
        if not seen:
            return below
        total = sum(seen.values()) + len(seen)
        return seen[byte] / total if byte in seen else len(seen) / total * below

    data = bytes(order) + text
    return sum(-math.log2(chance(data[i - order: i], data[i])) for i in range(order, len(data)))


def model_of(texts):
    rows = Counter()
    for lang, t in texts:
        data = bytes(language.ORDER) + t
        for i in range(len(data) - language.ORDER):
            rows[lang, int.from_bytes(data[i: i + language.ORDER + 1])] += 1
    return language.grow([(*k, n) for k, n in rows.items()])


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(2)
    texts = [("a", bytes(rng.choices(b"abcd ", k=300))), ("b", bytes(rng.choices(b"cdef ", k=300)))]
    model = model_of(texts)
    asked = [b"", b"a", b"abcd cd", bytes(rng.choices(b"abcdefxyz \xff", k=500)), b"", b"zz"]
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(language, "_PIECE", piece)
        data, ends = joined_bytes(pa.array(asked, pa.binary()))
        bits = language.code_lengths(model, data, ends)
        want = [[bits_brute([t], x) for _, t in texts] for x in asked]
        assert np.allclose(bits, want, rtol=1e-4)


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.language_id(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "12 34 !!", None, "s", 8),
         (10**9 + 2, "é" * 50_000, None, None, 1), (10**9 + 2, "é" * 50_000, None, None, 1)], docs.schema)
    clash = docs.union(odd).selectExpr("*", "1 AS lang_pred", "2 AS _told", "3 AS held_out")
    rows = [r for r in language.language_id(clash).collect() if r.doc_id is None or r.doc_id >= 10**9]
    told = sorted((str(r.doc_id), r.lang_pred == "und", r.score == 0) for r in rows)
    assert told == [("1000000000", True, True), ("1000000001", True, True),
                    ("1000000002", False, False), ("1000000002", False, False), ("None", True, True)]
    kept = language.keep_known(clash)
    assert kept.columns == clash.columns and kept.count() == docs.count() + 2
    assert language.language_id(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(unlabelled).collect()} == {"und"}


def test_training_rows_are_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.training_rows(docs, F.lit(True), 7, "doc_id", "text", "lang")
    assert {r["count"] for r in rows.groupBy("l").count().collect()} == {7}


def test_training_takes_keys_once(spark):
    """A row repeated 3,000 times, and a key with several texts."""
    docs = spark.createDataFrame(
        [(1, "same", "en")] * 3000 + [(2, t, "en") for t in ("b", "a", "c")]
        + [(i, f"text {i}", "en") for i in range(3, 60)] + [(None, "null", "en")] * 3,
        "doc_id long, text string, lang string")
    rows = language.training_rows(docs, F.lit(True), 500, "doc_id", "text", "lang").collect()
    assert len(rows) == 60 and len({r.k for r in rows}) == 60
    assert language.training_rows(docs, F.lit(True), 20, "doc_id", "text", "lang").count() == 20


def test_many_values_in_lang(spark):
    """1,000 dirty values: only the most common ones are learned, however many there are."""
    dirty = [(i, f"word{i} other", f"x{i % 1000:03d}") for i in range(3000)]
    docs = spark.createDataFrame(dirty + [(10_000 + i, "plain words here", "en") for i in range(50)],
                                 "doc_id long, text string, lang string")
    rows = language.training_rows(docs, F.lit(True), 400, "doc_id", "text", "lang", languages=4)
    assert {r.l for r in rows.select("l").distinct().collect()} == {"en", "x000", "x001", "x002"}
    model = language.train(docs, F.lit(True), 2)
    assert len(model.langs) == language.LANGUAGES and model.bits.nbytes < 50e6


def test_language_keeps_any_column_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "*", "1 AS _text", "2 AS _lang", "3 AS _score", "4 AS _told", "5 AS k", "6 AS l")
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.where("_text = 1 AND _lang = 2 AND _score = 3").count() == kept.count() > 0


def features_brute(text):
    kinds, n = quality.KINDS, quality.N_KINDS
    data = text.encode()
    signs = [2, *[int(kinds[b]) for b in data], 2]
    out = np.zeros(quality.N_FEATURES)
    for a, b in zip(signs, signs[1:], strict=False):
        out[a * n + b] += 1
    out = np.sqrt(out / max(len(data), 1))
    lines = data.split(b"\n")
    words = data.split()
    n = max(len(words), 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[-6:] = [3 * len(set(words)) / n, 3 * again / n, math.log1p(len(data)) / 10,
                len(set(lines)) / len(lines), min(len(data) / n, 100) / 10, 1]
    return out


def test_features():
    texts = ["", "a", "Ab 1!\n\nAb 1!", "é\tß", "", "x" * 3000, "b b b c b", " ", "b"]
    data, ends = joined_bytes(pa.array([t.encode() for t in texts], pa.binary()))
    assert np.allclose(quality.features(data, ends), [features_brute(t) for t in texts], atol=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_gradient(prior):
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(size=(30, 4)), rng.normal(size=(50, 4)), rng.normal(size=4)

    def parts(w):
        loss = lambda z: np.logaddexp(0, -z).mean()
        return prior * loss(p @ w), loss(-(u @ w)) - prior * loss(-(p @ w))

    risk, step = quality.risk_gradient(w, p, u, prior)
    positive, negative = parts(w)
    assert np.isclose(risk, positive + max(negative, 0))
    sign = 1 if negative >= 0 else -1
    which = (lambda w: sum(parts(w))) if sign > 0 else (lambda w: parts(w)[1])
    numeric = [(which(w + e) - which(w - e)) / 2e-6 for e in np.eye(4) * 1e-6]
    assert np.allclose(step, sign * np.array(numeric), atol=1e-5)


def test_quality_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.quality(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good = [r.predicted for r in held if r.quality == 1]
    bad = [r.predicted for r in held if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_sums_over_all_documents(spark):
    """Sums of tasks and slots are those of all documents at once, in several partitionings."""
    texts = [f"Some text {i}. " * (i % 7) for i in range(300)] + [None, "", "x" * 50_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text"))
    data, ends = joined_bytes(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    x = quality.features(data, ends).astype(float)
    w = np.random.default_rng(1).normal(0, 1, quality.N_FEATURES)
    for parts in (1, 7, 100):
        for sums in (quality.plain_sums, quality.score_counts):
            assert np.allclose(quality.over_all(docs.repartition(parts), w, sums), sums(x, w))
    assert len(quality.over_all(docs.limit(0), w, quality.score_counts)) == 0


def test_steps_over_all_lower_the_risk():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (200, 6)), np.concatenate([rng.normal(1, 1, (900, 6)), rng.normal(-1, 1, (600, 6))])
    prior, w = 0.3, quality.fit(p, u[::50], 0.3)
    risk = lambda w: quality.risk_gradient(w, p, u, prior)[0]
    before = risk(w)
    for _ in range(20):
        w = quality.risk_step(w, p, quality.plain_sums(u, w), prior)
    assert risk(w) <= before + 1e-9


def test_quality_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**9, "", None, None, 0), (10**9, "", None, None, 0),
         (10**9 + 1, "z" * 100_000, None, None, 1)], docs.schema)
    odd_labels = spark.createDataFrame([(None, 1, 0), (3, None, None), (5, 1, 0), (5, 0, 1)], labels.schema)
    clash = docs.union(odd).selectExpr("*", "1 AS score", "2 AS k", "3 AS trusted")
    found = quality.quality(clash, labels.union(odd_labels))
    assert found.count() == docs.count() + 4
    empty = found.where("doc_id = 1000000000").collect()
    assert len(empty) == 2 and empty[0].score == empty[1].score
    assert quality.quality(docs.limit(0), labels).count() == 0
    plain = quality.quality(docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in plain] == [(0.5, 0)]


def test_slices_cut_batches_by_bytes():
    from postpulse.llm.common import slices

    texts = [b"a" * n for n in (3, 0, 10, 1, 1, 1, 50)] + [None, b"z"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.binary())], ["i", "t"])
    for batch, rows in ((whole, texts), (whole.slice(2, 5), texts[2:7]), (whole.slice(0, 0), [])):
        parts = list(slices([batch], "t", 10))
        assert [v for p in parts for v in p.column(1).to_pylist()] == rows
        assert all(p.num_rows == 1 or sum(len(v or b"") for v in p.column(1).to_pylist()) <= 10 for p in parts)


def test_words_and_their_hashes():
    from postpulse.llm.words import Words

    texts = ["", "one", " two  words ", "x\ty\nz\x0b\x0c\r", "one", "é two", "\x1c a"]
    data, ends = joined_bytes(pa.array([t.encode() for t in texts], pa.binary()))
    words = Words(data, ends)
    found = [data.tobytes()[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
    want = [t.encode().split() for t in texts]
    assert found == [w for ws in want for w in ws]
    assert words.count.tolist() == [len(ws) for ws in want]
    hashes = {}
    for w, h in zip(found, words.hashes().tolist(), strict=True):
        assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    from postpulse.llm import simhash, words

    texts = [b"ab  cd e\n" * 40, b"", b"x" * 300, b"q w"]
    data, ends = joined_bytes(pa.array(texts, pa.binary()))
    whole = quality.features(data, ends), words.Words(data, ends).hashes(), simhash.fingerprint(texts[0], 3)
    monkeypatch.setattr(quality, "_SLICE", 50)
    monkeypatch.setattr(words, "_PIECE", 50)
    monkeypatch.setattr(simhash, "_PART", 5)
    assert np.array_equal(quality.features(data, ends), whole[0])
    assert words.Words(data, ends).hashes().tolist() == whole[1].tolist()
    assert simhash.fingerprint(texts[0], 3) == whole[2]


def test_runs_of_a_language_are_counted_together(spark, monkeypatch):
    """However many tasks hold the texts, a run of bytes is counted once for each language."""
    seen = []
    plain = language.in_tasks

    def in_tasks(df, function, schema):
        seen.append(plain(df, function, schema).select("lang", "gram").collect())
        return plain(df, function, schema)

    monkeypatch.setattr(language, "in_tasks", in_tasks)
    docs = spark.createDataFrame(
        [(i, f"the same words {i % 3}", "en" if i % 2 else "es") for i in range(200)],
        "doc_id long, text string, lang string").repartition(16, "doc_id")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert language.train(docs, F.lit(True)).langs == ["en", "es"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert len(seen[0]) == len(set(seen[0]))
