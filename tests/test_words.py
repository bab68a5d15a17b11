import random
import re
from collections import Counter

from conftest import rows

from postpulse.operators import words as W
from test_text import expected_tokens


def texts():
    rng = random.Random(5)
    pool = [f"palabra{c}" for c in "abcdefgh"] + ["de", "RT", "Año,", "#tag", "común"]
    # A word found in nearly every post, as a hot key.
    return ["hot " + " ".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(500)] + [None]


def test_document_frequency(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "tweet string")
    wanted = Counter(w for t in texts() if t for w in expected_tokens(t, ["de"]))
    assert dict(rows(W.document_frequency(df, ["de"]))) == dict(wanted)
    stops = spark.createDataFrame([("de",), ("absent",)], "word string")
    assert dict(rows(W.document_frequency(df, stops))) == dict(wanted)


def test_words_are_dealt_out_in_compiled_code(spark):
    df = spark.range(2).selectExpr("concat('hot año ', id) tweet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = W.document_frequency(df, ["de"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert re.search(r"\*\(\d+\) Generate explode", plan)


def test_term_frequency_and_merge(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "tweet string")
    whole = Counter(w for t in texts() if t for w in t.split())
    assert dict(rows(W.term_frequency(df))) == dict(whole)
    halves = [W.term_frequency(df.where(c)) for c in ("length(tweet) < 40", "length(tweet) >= 40")]
    assert dict(rows(W.merge_counts(*halves))) == dict(whole)


def test_top_words_breaks_ties_by_word(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", 1)], "word string, n long")
    assert [r["word"] for r in W.top_words(counts, 3).collect()] == ["c", "a", "b"]
