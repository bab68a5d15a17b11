"""Exact dedup, SimHash near-dedup and substring dedup against brute force."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from postpulse.llm import exact, simhash, substrings
from postpulse.llm.components import components
from postpulse.llm.fm_index import FMIndex
from postpulse.llm.patricia import PatriciaTrie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def mixed_texts(seed=1, n=120):
    """Copies with other blanks, near copies, shared passages, repeated lines, odd cases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß", "日本"]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", " \n\t", "a", "a  b", "ab", "x" * 70_000, "one two three"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 20:
            texts.append(re.sub(" ", rng.choice(["  ", "\n", "\x0b"]), texts[-7] or "", count=3))
        elif kind < 0.4:
            base = rng.choices(words, k=rng.randrange(5, 150))
            at = rng.randrange(len(base))
            texts.append(" ".join(base[:at] + [passage] + base[at:]))
        elif kind < 0.5:
            texts.append("\n".join([" ".join(rng.choices(words, k=9))] * 8))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randrange(1, 200))))
    return texts


# ---- exact ------------------------------------------------------------------

def exact_brute(rows):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for key, text in rows:
        groups.setdefault(strip(text), []).append((-len(text or ""), key is None, key or 0))
    out = []
    for key, text in rows:
        chars, null, best = min(groups[strip(text)])
        keep = None if null else best
        out.append((key, keep, len(groups[strip(text)]), key == keep,
                    sha256(strip(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_exact_groups(spark, limit):
    texts = mixed_texts()
    found = exact.exact_groups(frame(spark, texts).repartition(3), limit=limit)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == exact_brute(list(enumerate(texts)))


def test_exact_repeated_rows_and_null_keys(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab "), (None, "q"), (3, None), (4, "")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    found = exact.exact_groups(docs)
    assert sorted(map(tuple, found.collect()), key=str) == exact_brute(rows)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "None"]


def test_exact_empty_table_and_clashing_columns(spark):
    docs = frame(spark, ["a", "a"])
    assert exact.exact_groups(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS kept", "2 AS _sha", "3 AS _who", "4 AS data", "5 AS `a.b`")
    assert exact.exact_groups(clash).count() == 2
    kept = exact.keep_first(clash)
    assert kept.columns == clash.columns and kept.count() == 1


def test_trie_keeps_all_strings_through_spills():
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(500)]
    trie, got = PatriciaTrie(), []
    for i, s in enumerate(strings):
        trie.insert(s, (i,))
        if trie.bytes > 4000:
            got += trie.spill(1000)
            assert trie.bytes <= 4000
    got += trie.terminals()
    least, count = {}, {}
    for s, candidate, n in got:
        least[s] = min(least.get(s, candidate), candidate)
        count[s] = count.get(s, 0) + n
    assert least == {s: (strings.index(s),) for s in set(strings)}
    assert count == {s: strings.count(s) for s in set(strings)}
    assert trie.bytes == 0


# ---- SimHash ----------------------------------------------------------------

def print_brute(text, words=3):
    tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    runs = [" ".join(tokens[i: i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped_brute(keys, prints, radius):
    label = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    best = {}
    for k, at in zip(keys, label, strict=True):
        best[at] = min([x for x in (best.get(at), k) if x is not None], default=None)
    return [best[at] for at in label]


def test_near_groups(spark):
    texts = mixed_texts(5) + ["One Two THREE", "ONE two three", "Ä Ö", None]
    found = simhash.near_groups(frame(spark, texts).repartition(3)).orderBy("doc_id").collect()
    prints = [print_brute(t) for t in texts]
    assert [r.fingerprint for r in found] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in found] == grouped_brute(range(len(texts)), prints, 2)


@pytest.mark.parametrize("crowded", [512, 2])
def test_links_join_all_within_the_radius(spark, crowded):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:20]:
        for _ in range(6):  # chains of neighbours
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = dict(map(tuple, components(simhash.links(nodes, 2, crowded)).collect()))
    want = grouped_brute(signed, prints, 2)
    assert [roots.get(p, p) for p in signed] == want


def test_coverings_guarantee_a_collision():
    rng = random.Random(9)
    for depth in (0, 1, 2):
        masks = simhash.tables(2, depth)
        assert len(masks) == 7 ** (depth + 1)
        for _ in range(300):
            far = sum(1 << b for b in rng.sample(range(64), 2))
            assert any(m & far == 0 for m in masks)
    assert max(64 - m.bit_count() for m in simhash.tables(2, 2)) <= 6


def test_near_edge_cases(spark):
    assert simhash.near_groups(frame(spark, []).limit(0)).count() == 0
    docs = frame(spark, ["a b c d", "a b c d", None, "", "q r"], [5, 5, None, 2, None])
    found = sorted(map(tuple, simhash.near_groups(docs).collect()), key=str)
    assert [(r[0], r[2]) for r in found if r[0] is not None] == [(2, 2), (5, 5), (5, 5)]
    clash = docs.selectExpr("*", "1 AS fp", "2 AS _stays", "3 AS fingerprint")
    kept = simhash.keep_first(clash)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect()} == {2, 5, None}


A, B = "a b c d e f g", "p q r s t u v"


@pytest.mark.parametrize("rows, kept", [
    ([(1, A), (None, A), (None, B)], [(1, A), (None, B)]),
    ([(1, A), (2, A), (2, B), (3, B)], [(1, A), (2, B)]),
    ([(None, A), (None, A), (None, A)], [(None, A)]),
    ([(4, A), (4, A), (4, B), (4, None), (5, ""), (5, " ")], [(4, A), (4, B), (4, None)]),
    ([(7, A), (7, A + "\n"), (8, A + " ")], [(7, min(A, A + "\n", key=lambda t: sha256(t.encode()).hexdigest()))]),
])
def test_near_keeps_one_row_of_each_component(spark, rows, kept):
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = simhash.keep_first(docs.selectExpr("*", "1 AS id", "2 AS mark", "3 AS _who", "4 AS _what"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(kept, key=str)
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_exact_keeps_the_longest_of_a_key(spark):
    rows = [(1, "a b"), (1, "a  b "), (1, "ab"), (2, "ab"), (None, "a   b"), (3, "a   b ")]
    docs = frame(spark, [t for _, t in rows[:4]], [i for i, _ in rows[:4]])
    assert [(r.doc_id, r.text) for r in exact.keep_first(docs).collect()] == [(1, "a  b ")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    assert [(r.doc_id, r.text) for r in exact.keep_first(docs).collect()] == [(3, "a   b ")]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(5, 5)], "a long, b long")
    found = dict(map(tuple, components(chain).collect()))
    assert found == {i: 1 for i in range(2, 61)}
    assert components(chain.limit(0)).count() == 0


# ---- substrings -------------------------------------------------------------

def repeats_brute(rows, length):
    """Rows (key, text) in corpus order."""
    seen, out = set(), []
    for key, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i: i + length])
            if window in seen:
                gone[i: i + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((key, len(words), sum(gone), sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("length", "anchor", "hot", "shard"),
                         [(20, 8, 4096, 1 << 19), (20, 8, 3, 200), (5, 2, 10, 100)])
def test_remove_repeats(spark, length, anchor, hot, shard):
    texts = mixed_texts(11, 150) + ["k " * 300, "k " * 25]
    docs = frame(spark, texts).repartition(5)
    found = substrings.remove_repeats(docs, length, anchor, hot, shard).orderBy("doc_id")
    assert list(map(tuple, found.collect())) == repeats_brute(list(enumerate(texts)), length)


def test_remove_repeats_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [line, line, "short " + line, None], [7, 7, 9, None])
    clash = docs.selectExpr("*", "1 AS anchor", "2 AS met", "3 AS kept")
    found = {(r.doc_id, r.n_words): r.n_removed
             for r in substrings.remove_repeats(clash).collect()}
    assert found == {(7, 30): 0, (9, 31): 30, (None, 0): 0}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    other = frame(spark, [line, "x y " + line], [7, 7])  # one key, two texts
    assert sorted(r.n_removed for r in substrings.remove_repeats(other).collect()) == [0, 30]


def test_remove_repeats_hot_keys(spark):
    rng = random.Random(8)
    line = " ".join(f"w{i}" for i in range(30))
    other = [f"{line} " + " ".join(rng.choices("abcdefgh", k=40)) for _ in range(60)]
    rows = [(None, t) for t in other] + [(None, line)] * 90 + [(None, None)] * 30 + [(5, line)] * 70
    rows += [(6, "z " + line)]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    plain = substrings.remove_repeats(docs)
    once = substrings.remove_repeats(docs, heavy=8)  # the four most frequent go once
    # Repeated rows are one document; the texts of one key come in the order of a hash.
    order = dict(map(tuple, docs.selectExpr("text", "xxhash64(cast(text AS binary))").collect()))
    distinct = sorted(set(rows), key=lambda r: (r[0] or 0, order[r[1]]))
    want = []
    for r, out in zip(distinct, repeats_brute(distinct, 20), strict=True):
        want += [out] * rows.count(r)
    for found in (plain, once):
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_hot_key_is_not_gathered(spark, monkeypatch):
    """Each row gets its own stretches only, however many rows share its key."""
    line = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [f"{line} x{i}" for i in range(200)], [None] * 200)
    seen = {}
    run = substrings.in_tasks

    def watched(df, function, schema):
        if "met" in df.columns:
            seen[len(df.columns)] = df
        return run(df, function, schema)

    monkeypatch.setattr(substrings, "in_tasks", watched)
    assert substrings.remove_repeats(docs).count() == 200
    assert len(seen) == 2
    for df in seen.values():
        assert df.selectExpr("max(size(met))").first()[0] <= 12


def test_backward_search_finds_all_occurrences():
    rng = np.random.default_rng(4)
    for symbols in (2, 5, 70):
        text = rng.integers(0, symbols, 800)
        index = FMIndex(text, 6)
        for length in (1, 3, 6):
            starts = np.arange(len(text) - length + 1)
            low, high = index.search(text, starts, length)
            keys = [tuple(text[s: s + length]) for s in starts]
            for s, k in enumerate(keys):
                times = keys.count(k)
                assert (high[s] - low[s] if low[s] >= 0 else 1) == times
            groups = {}
            for k, a in zip(keys, low, strict=True):
                groups.setdefault(k, set()).add(int(a))
            assert all(len(g) == 1 for g in groups.values())
