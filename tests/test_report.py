from datetime import datetime

from conftest import rows

from postpulse.operators.series import keyword_series
from postpulse.plans import report


def posts(spark):
    data = [
        (m, s, f"palabra{m % 3} red" + (" metro" if m % 2 else ""), who)
        for m in range(8) for s, who in ((1, "press1"), (2, "pol1"), (3, "x"))
    ]
    return spark.createDataFrame(
        [(datetime(2020, 1, 1, 0, m, s), t, w) for m, s, t, w in data],
        "dateTweet timestamp, tweet string, screenName string")


KEYWORDS = [f"k{i}" for i in range(8)] + ["red", "metro"]


def rosters(spark):
    return {
        "press": spark.createDataFrame([("press1",), ("press1",)], "handle string"),
        "politicians": spark.createDataFrame([("pol1",)], "handle string"),
    }


def test_chart_takes_the_first_nine_and_all(spark):
    chart = report.chart_series(keyword_series(posts(spark), KEYWORDS), KEYWORDS)
    found = chart.collect()
    assert {r["series"] for r in found} == {"All", *KEYWORDS[:9]}
    assert [(r["series"], r["ts"]) for r in found] == sorted((r["series"], r["ts"]) for r in found)


def test_all_keywords_may_be_charted(spark):
    chart = report.chart_series(keyword_series(posts(spark), KEYWORDS), KEYWORDS, charted=None)
    assert {r["series"] for r in chart.collect()} == {"All", *KEYWORDS}
    board = report.dashboard(posts(spark), KEYWORDS, {}, charted=None).where("part = 'series'")
    assert rows(board, "name", "ts", "n") == rows(chart)


def test_weights(spark):
    series = keyword_series(posts(spark), KEYWORDS)
    assert dict(rows(report.keyword_weights(series))) == {"red": 18, "metro": 6}
    assert rows(report.keyword_weights(series.limit(0))) == []
    words = report.word_weights(posts(spark), 2, ["metro"]).collect()
    assert [tuple(r) for r in words] == [("palabra", 24), ("red", 24)]


def test_dashboard_equals_its_parts(spark):
    df, lists = posts(spark), rosters(spark)
    board = report.dashboard(df, KEYWORDS, lists, ["metro"], words=3).cache()
    for name, roster in {"everyone": None, **lists}.items():
        part = df if roster is None else df.join(
            roster.distinct(), df.screenName == roster.handle, "left_semi")
        series = keyword_series(part, KEYWORDS)
        mine = board.where(board.audience == name)
        assert rows(mine.where("part = 'series'"), "name", "ts", "n") == rows(
            report.chart_series(series, KEYWORDS))
        weights = (
            report.word_weights(df, 3, ["metro"]) if roster is None
            else report.keyword_weights(series)
        )
        assert rows(mine.where("part = 'weight'"), "name", "n") == rows(weights)
    board.unpersist()
