"""The corpus pipeline, and the registered queries against their SQL."""

from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from postpulse.llm import exact, language, mixing, oracles as llm_oracles, packing, simhash
from postpulse.llm.catalog import WEIGHTS

SF = "/root/testdata/sf0.001"


def test_stages_by_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "42", "en", "src1", 2)], docs.schema)
    docs = docs.union(odd)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]

    told = {r.doc_id for r in language.language_id(docs).where("lang_pred <> 'und'").collect()}
    one = steps["language_id"](spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == told and 9001 not in told and 9002 not in told

    two = steps["exact_dedup"](spark, one, SF).cache()
    keep = {r.doc_id for r in exact.exact_groups(one).where("kept").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == keep
    assert two.count() == len(keep)

    three = steps["near_dedup"](spark, two, SF).cache()
    first = {r.component_id for r in simhash.near_groups(two).collect()}
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted(first)

    four = steps["mix_sources"](spark, three, SF).cache()
    want = Counter(r.doc_id for r in mixing.replicate(three, WEIGHTS).collect())
    assert four.columns == docs.columns and Counter(r.doc_id for r in four.collect()) == want

    five = steps["pack"](spark, four, SF).collect()
    tokens, copies = {}, defaultdict(int)
    for r in packing.pack(four).collect():
        tokens[r.doc_id] = r.doc_tokens
    for r in five:
        copies[r.doc_id] += r.length
    assert {k: n / tokens[k] for k, n in copies.items()} == dict(want)


def test_run_writes_every_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Null and repeated keys, null and empty texts, repeated rows, among some ordinary ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = docs.orderBy("doc_id").first().text
    rows = [(None, text, "en", "src1", 1)] * 3 + [(None, "another text of words", "en", None, 1), (None, None, None, None, None),
            (3, "other words for a known key", "en", "new", 1), (3, "other words for a known key", "en", "new", 1),
            (9001, "", "en", "src1", 0), (9002, None, "en", "src1", 0), (9003, "word " * 20_000, "en", "src2", 1)]
    return docs.union(spark.createDataFrame(rows, ODD))


def test_stages_on_odd_tables(spark):
    clashing = ["copy", "_text", "_lang", "_score", "_sha", "_who", "_size", "_what", "mark", "fp", "id", "_place", "_drawn"]
    docs = odd_documents(spark).selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(clashing)])
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
            assert docs.where(" AND ".join(f"{c} = {i}" for i, c in enumerate(clashing))).count() == sizes[-1]
        if name == "near_dedup":
            assert docs.select("doc_id", "text").distinct().count() == sizes[-1]
            assert simhash.near_groups(docs).select("fingerprint").distinct().count() == sizes[-1]
    assert min(sizes) > 0 and sizes[0] >= sizes[1] >= sizes[2]


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert len(names) == 13 and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in llm_oracles.oracle_sql()])
def test_equals_sql(spark, name):
    with duckdb.connect() as con:
        for table in ("documents", "embeddings", "pages", "labels", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
        found = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        want = Counter(map(tuple, found.fetchall()))
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == want
