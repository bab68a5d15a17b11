"""Mixing, sharding, URL filters, packing and search against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from postpulse.llm import catalog, mixing, packing, search, sharding, urls

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents of (key, text, source)."""
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], DOCS)


# ---- mixing -----------------------------------------------------------------

@pytest.mark.parametrize("rate", [0.0, 0.3, 2.5, 40.0, 900.0])
def test_poisson_cdf(rate):
    steps = mixing.poisson_cdf(rate)
    assert all(a <= b for a, b in zip(steps, steps[1:], strict=False))
    assert steps[-1] == pytest.approx(1, abs=1e-9)
    if 0 < rate < 100:
        direct = [sum(rate ** i * math.exp(-rate) / math.factorial(i) for i in range(k + 1))
                  for k in range(min(len(steps), 60))]
        assert steps[:60] == pytest.approx(direct, rel=1e-12)


def copies_brute(rows, weights, rest=0.0, seed=0):
    size = defaultdict(int)
    named = lambda s: s if s in weights else None
    for _, t, s in rows:
        size[named(s)] += len((t or "").encode())
    wanted = {s: w for s, w in [*weights.items(), (None, rest)] if size[s]}
    out = Counter()
    for k, t, s in rows:
        w = wanted.get(named(s), 0)
        if not w:
            continue
        rate = w / sum(wanted.values()) * sum(size.values()) / size[named(s)]
        key = str(k) if k is not None else md5(t.encode()).hexdigest() if t is not None else ""
        u = int(md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
        n = sum(u >= c for c in mixing.poisson_cdf(rate))
        out.update((k, t, i) for i in range(1, n + 1))
    return out


def mixed_rows():
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 400), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    return [*rows, (None, "no key", "a"), (None, None, "b"), (7, "again", "b"), (7, "again", "b")]


@pytest.mark.parametrize("rest", [0.0, 0.5])
def test_replicate(spark, rest):
    rows, weights = mixed_rows(), {"a": 0.2, "b": 0.5, "z": 0.3}
    docs = frame(spark, rows)
    out = mixing.replicate(docs, weights, rest=rest)
    assert out.columns == [*docs.columns, "copy"]
    assert Counter((r.doc_id, r.text, r.copy) for r in out.collect()) == copies_brute(rows, weights, rest)


def test_replicate_reaches_the_shares_and_mixes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.replicate(docs, {"src0": 3.0, "src1": 1.0}, total=3_000_000.0, seed=2)
    size = dict(out.groupBy("source").agg(F.sum(F.octet_length("text"))).collect())
    assert set(size) == {"src0", "src1"}
    assert size["src0"] == pytest.approx(2_250_000, rel=0.25)
    assert size["src1"] == pytest.approx(750_000, rel=0.25)
    order = [r.doc_id for r in out.select("doc_id").collect()]
    assert order != sorted(order) and "PythonUDF" not in out._jdf.queryExecution().toString()


def test_replicate_edge_cases(spark):
    docs = frame(spark, mixed_rows())
    assert mixing.replicate(docs.limit(0), {"a": 1.0}).count() == 0
    assert mixing.replicate(docs, {}).count() == 0
    assert mixing.replicate(frame(spark, [(1, None, "a")]), {"a": 1.0}).count() == 0
    clash = docs.selectExpr("*", "1 AS copy", "2 AS _drawn", "3 AS _place", "4 AS `a.b`")
    out = mixing.replicate(clash, {"a": 1.0})
    assert sorted(out.columns) == sorted(clash.columns)
    with pytest.raises(ValueError, match="weights"):
        mixing.replicate(docs, {"a": -1.0})


def test_registered_mix_keeps_null_and_unlisted_sources(spark, tmp_path):
    names = ["src0", "src1", "elsewhere", None]
    docs = frame(spark, [(i, "x" * 50, names[i % 4]) for i in range(800)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.op5_source_mixing(spark, str(tmp_path))
    size = dict(out.groupBy("source").count().collect())
    assert set(size) == set(names)
    # Two named sources and the rest share the table in three parts.
    assert size[None] + size["elsewhere"] == pytest.approx(800 / 3, rel=0.25)
    staged = dict(corpus_pipeline.mix_sources(spark, docs, "").groupBy("source").count().collect())
    assert staged == size
    alone = frame(spark, [(i, "x" * 50, "elsewhere") for i in range(100)])
    assert corpus_pipeline.mix_sources(spark, alone, "").count() > 0


def test_replicate_with_a_high_rate(spark):
    rows = [(i, "x" * 1000, "a") for i in range(500)] + [(1000, "y" * 10, None)]
    out = mixing.replicate(frame(spark, rows), {"a": 1.0}, rest=1.0)
    assert Counter((r.doc_id, r.text, r.copy) for r in out.collect()) == \
        copies_brute(rows, {"a": 1.0}, 1.0)


# ---- sharding ---------------------------------------------------------------

def capacity_brute(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def shards_brute(rows, shards):
    digest = lambda t: "" if t is None else sha256(t.encode()).hexdigest()
    sizes = Counter()
    for _, t in rows:
        sizes[digest(t)] += len((t or "").encode()) + 1
    most = capacity_brute([sizes[g] for g in sorted(sizes)], shards)
    at, held, out = 0, 0, {}
    for g in sorted(sizes):
        if held + sizes[g] > most:
            at, held = at + 1, 0
        held += sizes[g]
        out[g] = at
    return sorted([(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), out[digest(t)])
                   for k, t in rows], key=str)


def shard_texts(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, "é" * int(rng.paretovariate(1) * 5)) for i in range(n)]
    rows += [(n + i, "hot") for i in range(n // 2)]
    return [*rows, (None, None), (None, ""), (1, None), (2, "twice"), (2, "twice")]


@pytest.mark.parametrize(("n", "shards"), [(700, 8), (700, 3), (40, 8), (3, 8), (30, 1)])
def test_shard(spark, monkeypatch, n, shards):
    monkeypatch.setattr(sharding, "FIRST", 1)  # several groups below each prefix
    monkeypatch.setattr(sharding, "NEXT", 1)
    monkeypatch.setattr(sharding, "HEAVY", 8)
    rows = shard_texts(n)
    docs = frame(spark, [(k, t, None) for k, t in rows])
    found = sharding.shard(docs, shards).collect()
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.shard) for r in found], key=str) == \
        shards_brute(rows, shards)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = sharding.shard(docs.selectExpr("*", "1 AS grp", "2 AS p", "3 AS size"))
    assert sorted([(r.doc_id, r["size"], r.text_crc32, r.shard) for r in out.collect()], key=str) == \
        shards_brute(rows, 8)
    assert "PythonUDF" not in out._jdf.queryExecution().toString()
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shard_deals_out_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HEAVY", 8)
    rows = [(None, None)] * 300 + [(5, None)] * 100 + [(i, f"t{i}") for i in range(50)]
    found = sharding.shard(frame(spark, [(k, t, None) for k, t in rows]), 1).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows) - Counter()
    assert sorted(r.slot for r in found) == list(range(450))
    # The null group comes first; the rows of each of its keys stand in eight places, not in one.
    at = {r.slot: r.doc_id for r in found}
    changes = sum(at[i] != at[i + 1] for i in range(399))
    assert {at[i] for i in range(400)} == {None, 5} and changes >= 8


# ---- URL filters ------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("b.com", "", "block"), (None, "/", "block"),
         ("c.com", None, "allow"), ("org", "/", "block"), ("", "/", "block")]


def judged_brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    won = max(fits, default=None)
    return (host, path, won[3], won[4]) if won else (host, path, None, default)


def test_judge(spark):
    made = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/12",
            "x://example.org", "x://notexample.org/es/", "x://example.org./es/", "x://b.com?q=/",
            "x://a.b.com#/", "x://c.com/a://d.org/", "x://É.com/de/", "x://com/de/", "x://..com/fr/",
            "x://com/de/\n?", "x://" + "a." * 500 + "org/" + "p" * 50_000]
    rows = [(i, u) for i, u in enumerate(made)] + [(None, made[4]), (3, made[4]), (3, made[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for default in ("allow", "block"):
        found = urls.judge(pages, rules, default)
        assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
        want = [(i, *judged_brute(u, RULES, default)) for i, u in rows]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert urls.judge(pages.limit(0), rules).count() == 0
    free = urls.judge(pages, rules.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in free] == [(None, "allow")]


# ---- packing ----------------------------------------------------------------

def texts_to_pack():
    rng = random.Random(8)
    odd = [None, "", " ", "a  b", "a\n\n b\t\tc", "x   ", "  x", "\u00a0\u00a0x", "a\u2003\u2003b", "\u3000y",
           "<|endoftext|> z", "it's  John's\r\n\r\nend", "日本語 テスト  ok", "\x1c\x1d a", "word " * 5000, "é" * 9000,
           "a" * 3000, "tab\tend ", "x \u0085 y"]
    return odd + [" ".join(rng.choices(["alpha", "be", "12", "!?", "ñu"], k=rng.randrange(1, 900)))
                  for _ in range(60)]


def test_ids_equal_those_of_the_tokenizer(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.tokens("byte_bpe_50k.json")
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in [*(t or "" for t in texts_to_pack()), *docs]:
        assert fast(text.encode()) == whole.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("group", [4096, 10])
def test_pack_round_trip(spark, group):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = texts_to_pack()
    rows = [*enumerate(texts), (5, texts[5]), (None, "no key")]
    docs = frame(spark, [(k, t, None) for k, t in rows]).repartition(3)
    found = packing.pack(docs.selectExpr("*", "1 AS grp", "2 AS start"), group=group).collect()
    ids = {k: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    times = Counter(k for k, _ in rows)
    pieces, bins = defaultdict(Counter), defaultdict(list)
    for r in found:
        pieces[r.doc_id][r.start, r.length] += 1
        want = np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4")
        assert len(want) == r.length and zlib.crc32(want.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        bins[r.sequence_id].append((r.offset, r.length))
    for k, cuts in pieces.items():
        assert set(cuts.values()) == {times[k]}
        at = 0
        for start, length in sorted(cuts):
            assert start == at
            at += length
        assert at == len(ids[k])
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r.length for r in found)
    assert group == 10 or used / (2048 * len(bins)) > 0.95


def test_pack_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert packing.pack(docs).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    for n in (0, 1, 50, 400):
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, r in enumerate(room) if r >= s), len(room))
            if at == len(room):
                room.append(100)
            want.append((at, 100 - room[at]))
            room[at] -= s
        assert packing.first_fit_decreasing(sizes, 100) == want


# ---- search -----------------------------------------------------------------

def best_brute(rows, k, every):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64).tolist()) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 40])
@pytest.mark.parametrize("shape", ["dense", "sparse", "ties", "negative"])
def test_top_k(spark, shard, shape):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(230):
        v = rng.normal(size=12) * (rng.random(12) < (0.2 if shape == "sparse" else 1))
        if shape == "ties":
            v = np.round(v)
        if shape == "negative":
            v = -np.abs(v) if i % 20 else np.abs(v)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [(300, None), (301, [None] * 12), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, []),
             (None, rows[0][1]), (7, rows[7][1]), (20, rows[20][1]), (305, rows[3][1][:5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = search.top_k(table.selectExpr("*", "1 AS rank", "2 AS shard"), 10, 20, shard=shard)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == best_brute(rows, 10, 20)


def test_top_k_small_tables(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, search.top_k(table).collect())) == [(0, 1, 1, 2 ** 21), (0, 2, 2, -3 * 2 ** 20)]
    assert search.top_k(table.limit(0)).count() == 0
    assert search.top_k(table.where("vec_id = 0")).count() == 0


def top_brute(rows, k, every):
    """(query, rank, row, score) with Python's integers."""
    whole = {i: [int(x) * 1024 if abs(x) >= 2 ** 52 else math.floor(1024 * x) for x in v] for i, v in rows}
    out = []
    for q, v in whole.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole.items() if i != q)
            out += [(q, n + 1, i, max(min(-s, 2 ** 63 - 1), -2 ** 63)) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [4, 4096])
@pytest.mark.parametrize("size", [1e3, 3e6, 1e10, 1e18, 1e200])
def test_top_k_of_large_components(spark, shard, size):
    rng = random.Random(int(math.log10(size)))
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1e10, 0.0, 0.0]), (2, [3e6, 0.0, 0.0]), (3, [2e10, 0.0, 0.0])]
    rows += [(i, [rng.choice([rng.gauss(0, size), rng.gauss(0, 1), float(rng.randint(-3, 3))]) for _ in range(3)])
             for i in range(4, 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, search.top_k(table, 5, 10, shard=shard).collect()))
    assert got == top_brute(rows, 5, 10)


def test_scores_beyond_64_bits_are_in_order():
    scores = [s * 10 ** e + d for s in (1, -1) for e in (0, 18, 19, 20, 40) for d in (0, 1)] + [2 ** 63 - 1, -2 ** 63, 2 ** 63]
    key = lambda s: (search.score_order(s), max(min(s, 2 ** 63 - 1), -2 ** 63))
    assert sorted(scores, key=key) == sorted(scores)


def test_hot_key_is_spread(spark):
    """A third of the rows is one key, with many texts; they go to all partitions alike."""
    rows = [(1, f"t{i}", "src0") for i in range(10_000)] + [(i, f"u{i}", "src1") for i in range(2, 20_002)]
    found = mixing.replicate(frame(spark, rows), {"src0": 1.0, "src1": 2.0})
    sizes = sorted(r["n"] for r in found.repartition(1).groupBy(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(8))).agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes[-1] < 2 * sizes[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "Python" not in plan
    spot = [r[0] for r in found.where("doc_id = 1").select("text").distinct().limit(50).collect()]
    assert len(spot) > 20
