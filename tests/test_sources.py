import csv
import json
import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from postpulse.operators.newest import newest
from postpulse.operators.project import capture_row, parse_posts_json, post_times
from postpulse.operators.series import first_keywords
from postpulse.schemas import CAPTURE, capture_header
from postpulse.sources import captures as C
from postpulse.sources import framing
from postpulse.sources import lists as L
from postpulse.sources import posts as R
from postpulse.sources import sinks as K
from test_filters import lines, raw

TEXT = 'dos\nlíneas, "citas" y \\barra; fin '


def write_csv(path, header, *records):
    """As a plain CSV writer prints Python values."""
    with open(path, "w", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(records)


def capture_record(**changes):
    record = dict.fromkeys([f.name for f in CAPTURE.fields])
    record.update(
        text=TEXT, created_at="2019-10-24 11:39:39.000012", lang="es", user_id=5, id=1,
        user_verified=True, retweeted=False, hash_tags="{'a', 'b'}", **changes)
    return record


def test_read_capture_printed_by_python(spark, tmp_path):
    record = capture_record()
    write_csv(tmp_path / "Output_1.csv", map(capture_header, record), record.values())
    row = C.read_capture(spark, str(tmp_path / "Output_1.csv")).first()
    assert row["text"] == TEXT and row["user_id"] == 5 and row["geo"] is None
    assert row["created_at"] == datetime(2019, 10, 24, 11, 39, 39, 12)
    assert row["user_verified"] is True and row["retweeted"] is False
    assert row["hash_tags"] == "{'a', 'b'}"


def test_captures_match_columns_by_name(spark, tmp_path):
    write_csv(tmp_path / "Output_1.csv", ["id", "text", "user.id"], [1, "uno", 7])
    write_csv(tmp_path / "Output_2.csv", ["text", "user.id", "extra", "id"],
              [TEXT, 8, "e", 2], ["tres", 9, "", 3])
    write_csv(tmp_path / "Output_3.csv", ["id", "text", "user.id"], [4, "cuatro", 6])
    df = C.read_captures(spark, str(tmp_path / "Output*.csv"))
    assert rows(df, "id", "text", "user_id", "extra") == [
        (1, "uno", 7, None), (2, TEXT, 8, "e"), (3, "tres", 9, None), (4, "cuatro", 6, None)]
    assert dict(df.dtypes)["user_id"] == "bigint"


def test_latest_capture_by_name(spark, tmp_path):
    for name, i in (("20191101-171445", 2), ("20191026-191509", 1), ("20191030-210028", 3)):
        write_csv(tmp_path / f"OutputStreaming_{name}.csv", ["id", "text"], [i, "t"])
    assert rows(C.latest_capture(spark, str(tmp_path / "Output*.csv")), "id") == [(2,)]


def test_latest_capture_has_all_files_of_the_newest_run(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CAST(id AS string) AS text").repartition(4)
    C.write_capture(df, str(tmp_path / "20191101-171445"))
    C.write_capture(df.where("id < 10"), str(tmp_path / "20191026-191509"))  # older, written later
    assert C.latest_capture(spark, str(tmp_path)).count() == 1000
    C.write_capture(df.where("id < 10"), str(tmp_path / "20191102-000000"))
    assert C.latest_capture(spark, str(tmp_path)).count() == 10
    assert C.read_captures(spark, str(tmp_path)).count() == 1020


ODD = ["", None, "a\nb", "\\n", "\\", "\\\\", "\\N", '"', ' "x", ', "\r\n", " ", "c\\\nd", ","]


def test_own_captures_keep_every_text_and_can_be_split(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    C.write_capture(df, str(tmp_path / "a"))
    assert sorted(C.read_captures(spark, str(tmp_path / "a")).collect()) == sorted(df.collect())
    files = list((tmp_path / "a").glob("*.csv"))
    assert sum(len(f.read_text().splitlines()) for f in files) == len(ODD) + len(files)


def test_a_capture_keeps_its_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "t")], "id long, text string")
    C.write_capture(df, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="other columns"):
        C.write_capture(df.select("text", "id"), str(tmp_path / "a"))


def test_headers_of_foreign_files_may_be_given(spark, tmp_path):
    write_csv(tmp_path / "x.csv", ["id", "text"], [1, "uno"])
    name = str(tmp_path / "x.csv")
    assert rows(C.read_captures(spark, str(tmp_path), {name: "text,lang"})) == [("1", "uno")]


def test_capture_round_trip_appends_with_one_header_per_file(spark, tmp_path):
    df = capture_row(parse_posts_json(lines(spark, raw(text=TEXT + "#b")), "value"))
    path = str(tmp_path / "out")
    C.write_capture(df, path)
    C.write_capture(df, path)
    back = C.read_capture(spark, path)
    assert back.count() == 2
    assert back.first()["text"] == TEXT + "#b"
    header = spark.read.text(path).where(F.col("value").startswith("text,created_at,")).first()[0]
    assert header.split(",") == [capture_header(f.name) for f in CAPTURE.fields]
    assert rows(C.union_captures(back, back.select("id", "text")), "id") == [(1,)] * 4


def test_combined_reads_as_one_table(spark, tmp_path):
    df = spark.createDataFrame([(i, TEXT) for i in range(20)], "id long, text string")
    C.write_combined(df.repartition(3), str(tmp_path / "all"))
    assert rows(C.read_captures(spark, str(tmp_path / "all"))) == rows(df)


def test_keywords_keep_their_order(spark, tmp_path):
    (tmp_path / "kw.csv").write_text("zeta, alfa, piñera, 73")
    table = L.read_keywords(spark, str(tmp_path / "kw.csv"))
    assert rows(table) == [(0, "zeta"), (1, "alfa"), (2, "piñera"), (3, "73")]
    assert rows(first_keywords(table, 2), "keyword") == [("alfa",), ("zeta",)]


def test_roster(spark, tmp_path):
    write_csv(tmp_path / "r.csv", ["name", "account"],
              ["A", "@a"], ["B", " @b"], ["C", ""], ["D", "d"])
    path = str(tmp_path / "r.csv")
    assert rows(L.read_roster(spark, path, "account"), "handle") == [("",), ("@b",), ("a",)]
    assert rows(L.read_roster(spark, path, "account", strict=False), "handle") == [("a",), ("b",), ("d",)]


def test_stopwords(spark, tmp_path):
    (tmp_path / "s.txt").write_text("él\nel\nAún\npor qué\n")
    assert rows(L.read_stopwords(spark, str(tmp_path / "s.txt"))) == [
        ("Aun",), ("el",), ("por que",)]


def split_session(spark, size):
    """A session that reads files in splits of ``size`` bytes."""
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    other.conf.set("spark.sql.files.openCostInBytes", "0")
    return other


def plain_csv(rng, n):
    signs = ["\n", "\r\n", '"', ",", "a", " ", "é", "long words " * 4, "\n\n", '""', "'"]
    return [(i, None if rng.random() < 0.1 else "".join(rng.choices(signs, k=rng.randint(0, 9))).strip() + "x")
            for i in range(n)]


def test_many_small_splits_are_read_by_few_tasks(spark, tmp_path):
    with open(tmp_path / "a.csv", "w") as file:
        file.writelines(f"{i},{'x' * (i % 90)}\n" for i in range(500))
    cut = framing.pieces(split_session(spark, "64b"), str(tmp_path), "\n")
    assert cut.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    found = cut.collect()
    assert len({r[framing.SPLIT] for r in found}) > 100
    in_order = sorted(found, key=lambda r: (r[framing.SPLIT], r[framing.AT]))
    assert [r[framing.PIECE] for r in in_order] == [f"{i},{'x' * (i % 90)}" for i in range(500)]
    assert [framing._bytes(s) for s in ("7", "64k", "2MB", "134217728b")] == [7, 65536, 2 << 20, 128 << 20]


@pytest.mark.parametrize("size", [7, 64, 501, 10**6])
@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_foreign_captures_in_splits(spark, tmp_path, size, end):
    """Quoted line breaks, whatever the split borders cut: fields, quotes, records, many splits."""
    rng = random.Random(size)
    given = {}
    for k, header in enumerate((["id", "text"], ["text", "id"], ["id", "text"])):
        kept = [(i + 1000 * k, t) for i, t in plain_csv(rng, 60)]
        with open(tmp_path / f"c{k}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(header)
            writer.writerows([dict(id=i, text=t)[c] for c in header] for i, t in kept)
        given |= dict(kept)
    other = split_session(spark, size)
    df = C.read_captures(other, str(tmp_path))
    assert {r.id: r.text for r in df.select("id", "text").collect()} == given
    assert df.count() == len(given)
    one = other.read.text(str(tmp_path / "c0.csv")).rdd.getNumPartitions()
    assert one > 5 or size > 500


def test_foreign_captures_odd_files(spark, tmp_path):
    other = split_session(spark, 9)
    (tmp_path / "a.csv").write_text('id,text\n1,"open\nuntil the end')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("id,text\n")
    (tmp_path / "d.csv").write_text('\ufeffid,text\n\n7,seven\n\n\n8,"a""b"\n')
    (tmp_path / "e f.csv").write_text('id,text\n9,' + "wide " * 50 + "\n10,ten")
    got = rows(C.read_captures(other, str(tmp_path)).select("id", "text"))
    assert sorted(got) == sorted([(1, "open\nuntil the end"), (7, "seven"), (8, 'a"b'),
                                  (9, "wide " * 50), (10, "ten")])


def test_foreign_header_takes_one_task(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,text\n" + "1,t\n" * 5_000)
    other = split_session(spark, 1000)
    spark.sparkContext.setJobGroup("header", "header")
    assert C._first_lines(other, [str(tmp_path / "x.csv")]) == {str(tmp_path / "x.csv"): "id,text"}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_captures_of_both_kinds(spark, tmp_path):
    own = spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, text string").repartition(2)
    C.write_capture(own, str(tmp_path / "20240101"))
    C.write_capture(own.withColumn("day", F.lit("x")).drop("day"), str(tmp_path / "deep" / "20240102"))
    write_csv(tmp_path / "20240103.csv", ["text", "id"], ["c\nd", 3])
    (tmp_path / "day=1").mkdir()
    write_csv(tmp_path / "day=1" / "20231231.csv", ["id", "text", "more"], [4, "e", "f"])
    df = C.read_captures(spark, str(tmp_path))
    assert sorted(rows(df.select("id", "text"))) == sorted([(1, "a\nb"), (2, None)] * 2 + [(3, "c\nd"), (4, "e")])
    assert rows(C.latest_capture(spark, str(tmp_path)).select("id", "text")) == [(3, "c\nd")]
    C.write_capture(own, str(tmp_path / "20240104"))
    assert C.latest_capture(spark, str(tmp_path)).count() == 2


def odd_articles(rng, n):
    words = ["a", "}", "{", "]", "[", '"', "\\", "\n", ",", "é", "\u2028", '\\"}', "x " * 20]
    out = []
    for i in range(n):
        text = "".join(rng.choices(words, k=rng.randint(0, 8)))
        out.append({"title": f"{i} {text}", "publication_date": None if i % 5 else text,
                    "publication_hour": "10:00", "more": {"deep": [{"a": text}, [], {}], "n": i}})
    return out


@pytest.mark.parametrize("size", [5, 40, 333, 10**6])
@pytest.mark.parametrize("indent", [None, 2])
def test_news_array_in_splits(spark, tmp_path, size, indent):
    """Strings with brackets, quotes and escapes, nested values; without any line break too."""
    rng = random.Random(size)
    files = {f"n{k}.json": odd_articles(rng, n) for k, n in enumerate((40, 1, 0, 25))}
    for name, articles in files.items():
        (tmp_path / name).write_text(json.dumps(articles, indent=indent, ensure_ascii=bool(size % 2)))
    other = split_session(spark, size)
    got = L.read_news(other, str(tmp_path))
    want = [(a["title"], a["publication_date"], a["publication_hour"]) for v in files.values() for a in v]
    assert sorted(map(repr, got.select("title", "publication_date", "publication_hour").collect())) == sorted(
        map(repr, spark.createDataFrame(want, got.select(
            "title", "publication_date", "publication_hour").schema).collect()))
    if size == 40:
        assert other.read.text(str(tmp_path / "n0.json"), lineSep="}").rdd.getNumPartitions() > 20


def test_news_in_odd_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[ ]\n')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text('\ufeff[{"title":"t"} , {"title":"u","x":{}}]\n\n')
    got = L.read_news(split_session(spark, 6), str(tmp_path))
    assert rows(got.select("title")) == [("t",), ("u",)]


def test_news(spark, tmp_path):
    from postpulse.operators.project import news_time

    articles = [
        {"title": "a", "publication_date": "|24/10/2019", "publication_hour": "14:39"},
        {"title": "b", "publication_date": "bad", "publication_hour": ""},
    ]
    (tmp_path / "n.json").write_text(json.dumps(articles, indent=1))
    df = news_time(L.read_news(spark, str(tmp_path / "n.json")))
    assert rows(df) == [("a", 1571927940), ("b", None)]


@pytest.mark.parametrize("ids", [
    list(range(9000)),
    [0] + [10**15 + i for i in range(6000)] + [2**62],
    [3 * i for i in range(100)],
    [i // 2 for i in range(4000)],
    [5] * 3000 + [None] * 3000,
    [i if i % 4 else None for i in range(1500)],
    [1.5, -2.0, None, 7.25],
])
def test_newest_has_n_rows_for_every_n(spark, ids):
    random.Random(1).shuffle(ids)
    kind = "double" if isinstance(max(i for i in ids if i is not None), float) else "long"
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], f"ingest_id {kind}, t string").repartition(3)
    order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
    for n in (0, 1, 5, 999, 1000, 1001, 2500, 5000):
        found = [r[0] for r in newest(df, n, "ingest_id").select("ingest_id").collect()]
        assert sorted(found, key=str) == sorted(order[:n], key=str)


def test_newest_by_time_and_by_day(spark, tmp_path):
    data = [(datetime(2020, 1, 1 + i % 7, i % 24, i % 60), i) for i in range(500)] + [(None, 3)]
    df = spark.createDataFrame(data, "dateTweet timestamp, ingest_id long")
    times = sorted((d for d, _ in data if d), reverse=True)
    found = newest(df, 123, "dateTweet").collect()
    assert sorted((r[0] for r in found), reverse=True) == times[:123]
    with pytest.raises(TypeError):
        newest(df.withColumn("ingest_id", F.col("ingest_id").cast("string")), 5, "ingest_id")
    K.write_posts(df, str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] and r[0].date(), r[1]), reverse=True)
    for n in (1, 50, 71, 72, 300, 500, 501, 900):
        got = newest(stored, n, "ingest_id", "day")
        assert sorted(map(str, (r.ingest_id for r in got.collect()))) == sorted(str(r[1]) for r in order[:n])
    plan = newest(stored, 100, "ingest_id", "day")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day" in plan


def test_scan_posts(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, "x") for i in range(10)], "ingest_id long, k int, t string")
    df.write.parquet(str(tmp_path / "p"))
    found = R.read_posts(spark, str(tmp_path / "p"), condition=F.col("k") == 1, fields=["t", "k"],
                         limit=3)
    assert found.columns == ["t", "k"] and found.count() == 3
    assert rows(R.read_posts(spark, str(tmp_path / "p"), limit=2), "ingest_id") == [(8,), (9,)]
    assert R.read_posts(spark, str(tmp_path / "p")).count() == 10
    dealt = R.read_posts(spark, str(tmp_path / "p"), partitions=3)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 10


def test_search(spark):
    def day(d):
        return datetime(2019, 10, d)

    df = spark.createDataFrame([
        (1, day(20), "una red", "es"), (2, day(21), "red", "en"), (3, day(22), "metro", "es"),
        (4, day(22), "red", "es"), (5, day(23), "red", "es"), (6, day(22), "nada", "es"),
    ], "ingest_id long, dateTweet timestamp, tweet string, lang string")
    found = R.search_posts(df, ["red", "metro"], "es", "2019-10-20", "2019-10-23")
    assert rows(found, "ingest_id") == [(1,), (3,), (4,)]
    newest_two = R.search_posts(df, ["red", "metro"], limit=2)
    assert rows(newest_two, "ingest_id")[-1] == (5,) and newest_two.count() == 2
    many = [f"w{i}" for i in range(19)] + ["red"]
    assert R.search_posts(df, many).count() == 3
    assert R.search_posts(df, many, first=9).count() == 0


def test_post_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(datetime(2020, 1, 1 + i % 2, 0, i, 30), f"t{i}") for i in range(20)],
        "dateTweet timestamp, tweet string")
    path = str(tmp_path / "posts")
    K.write_posts(df, path)
    K.write_posts(df, path)
    back = spark.read.parquet(path)
    assert rows(back.drop("day")) == rows(df.union(df))
    assert "PartitionFilters: [isnotnull(day" in (
        back.where("day = date'2020-01-01'")._jdf.queryExecution().toString())
    K.save_search(post_times(df), str(tmp_path / "s"))
    saved = spark.read.parquet(str(tmp_path / "s"))
    assert saved.where("text = 't1'").first()["epoch"] == 1577923260
    nulls = spark.createDataFrame([(1, None)], "a int, b string")
    assert rows(K.posts_to_json(nulls)) == [('{"a":1,"b":null}',)]
