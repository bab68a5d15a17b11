"""Box search along cells, and author search by sorted files and Bloom filters."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from postpulse.operators import places as P
from postpulse.operators.filters import by_author, in_box
from postpulse.sources import sinks as K

NAN = float("nan")


def morton(lon, lat):
    x, y = P._part(lon, -180.0, 180.0), P._part(lat, -90.0, 90.0)
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(P.BITS))


def positions(n=3000):
    rng = random.Random(4)
    out = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n)]
    out += [(rng.uniform(-77, -66), rng.uniform(-57, -17)) for _ in range(n // 4)]
    edges = [-180.0, 180.0, -90.0, 90.0, 0.0, -76.0, -66.0, -56.0, -17.0]
    out += [(a, b) for a in edges for b in edges]
    out += [(None, 1.0), (1.0, None), (None, None), (NAN, 1.0), (1.0, NAN), (200.0, 10.0), (-200.0, -95.0)]
    return [(i, *p) for i, p in enumerate(out)]


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("placed") / "store")
    df = spark.createDataFrame(positions(), "id long, lon double, lat double")
    P.write_placed(df, path, **{"parquet.block.size": "4096", "parquet.page.size": "1024"})
    return spark.read.parquet(path)


def test_cells_are_morton_numbers(spark, placed):
    for r in placed.where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT isnan(lon)").collect():
        assert r.cell == morton(r.lon, r.lat)
    assert placed.where("cell IS NULL").count() == 3


BOXES = [(-76.0, -56.0, -66.0, -17.0), (-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 0.0, 0.0), (10.0, 10.0, 9.0, 20.0),
         (-66.0, -17.0, -66.0, 90.0), (179.9, 89.9, 180.0, 90.0), (-1.0, -1.0, 1.0, 1.0), (150.0, -95.0, 250.0, 20.0)]


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("most", [1, 4, 32, 500])
def test_box_equals_the_plain_test(placed, box, most):
    want = rows(placed.where(in_box("lon", "lat", *box)), "id")
    assert rows(P.by_box(placed, *box, most=most), "id") == want


@pytest.mark.parametrize("box", BOXES[:3] + BOXES[4:])
def test_ranges_hold_the_box_and_little_more(box):
    rng = random.Random(1)
    for most in (1, 8, 64):
        found = P.box_ranges(*box, most)
        assert 1 <= len(found) <= most and all(a <= b for a, b in found)
        assert all(x[1] + 1 < y[0] for x, y in zip(found, found[1:], strict=False))
        for _ in range(200):
            lon, lat = rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])
            assert any(a <= morton(lon, lat) <= b for a, b in found)
    size = lambda found: sum(b - a + 1 for a, b in found)
    assert size(P.box_ranges(*box, 64)) <= size(P.box_ranges(*box, 8)) <= size(P.box_ranges(*box, 1))


def test_ranges_are_pushed_and_skip_rows(placed):
    found = P.by_box(placed, -76.0, -56.0, -66.0, -17.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell," in plan and "LessThanOrEqual(cell," in plan
    # What the scan hands on, before the exact test, is a part of the table.
    assert scanned(found) < placed.count() / 2


def scanned(df):
    """Rows that the scan of an executed frame read."""
    df.collect()
    def scans(node):
        if "Scan" in node.nodeName():
            yield node
        for c in (node.children().apply(i) for i in range(node.children().size())):
            yield from scans(c)
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    return sum(n.metrics().apply("numOutputRows").value() for n in scans(plan))


def test_author_store_reads_fewer_row_groups(spark, tmp_path):
    posts = spark.range(0, 40_000).selectExpr(
        "id", "concat('user', lpad(id * 7919 % 20000, 5, '0')) AS screenName",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 2) AS dateTweet")
    plain, by_name = str(tmp_path / "plain"), str(tmp_path / "by_name")
    small = {"parquet.block.size": "8192", "parquet.page.size": "1024", "parquet.page.row.count.limit": "200"}
    K.write_posts(posts, plain, **small)
    K.write_posts(posts, by_name, author="screenName", **small)
    read = {}
    for path in (plain, by_name):
        found = by_author(spark.read.parquet(path), "user00007")
        assert rows(found, "id") == rows(posts.where("screenName = 'user00007'"), "id") != []
        read[path] = scanned(found)
    assert read[by_name] * 10 < read[plain]
    # A name within the range of the others but written by none: the Bloom filters know.
    absent = by_author(spark.read.parquet(by_name), "user00007x")
    assert scanned(absent) == 0
