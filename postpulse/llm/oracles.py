"""SQL, for DuckDB, of those queries that SQL can express."""

from __future__ import annotations

from postpulse.llm.catalog import URL_RULES, WEIGHTS
from postpulse.llm.line_rules import BOILERPLATE, LineRules

_SPACES = r"[\x20\x09-\x0D]"

_EXACT = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '{_SPACES}+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_WEIGHTS = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
_MIX = f"""
WITH w(source, weight) AS (VALUES {_WEIGHTS}),
z AS (SELECT source, sum(strlen(coalesce(text, ''))) AS b FROM documents GROUP BY source),
r AS (
  SELECT z.source, w.weight / (SELECT sum(weight) FROM w JOIN z USING (source) WHERE b > 0)
         * (SELECT sum(b) FROM z) / z.b AS rate
  FROM z JOIN w USING (source) WHERE z.b > 0
),
steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1)))
         OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, (SELECT unnest(range(0, 200)) AS k)
),
lists AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source),
u AS (
  SELECT *, CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13)
                 AS BIGINT) / 4503599627370496.0 AS at
  FROM documents
),
n AS (
  SELECT u.*, len(list_filter(lists.cdf, lambda c: u.at >= c)) AS times
  FROM u JOIN lists USING (source)
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy
FROM n WHERE times > 0
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_URLS = rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), k AS (
  SELECT DISTINCT host, path FROM p
), m AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC,
                            length(rule_host) DESC, verdict DESC) AS n
  FROM k JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                   AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.host = p.host AND m.path = p.path AND m.n = 1
"""



def _edit(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    """A state's repair so far with one more edit."""
    repaired = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return (f"CASE WHEN {when} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, "
            f"'a': {state}.a || '{letter}', 'r': {repaired}}} END")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _to(state: str, sources: str, initial: str, name: str) -> str:
    """Cheapest way into a state by a turn: deleted, kept or with another role."""
    options = [_edit(f"w.s{state}", "4", "D", None)]
    for s in sources:
        options.append(_edit(f"w.s{s}", "late", "K", "role || ':' || text", f"stays AND initial = '{initial}'"))
        options.append(_edit(f"w.s{s}", "3 + late", "R", f"'{name}:' || text", "stays"))
    return _least(*options)


_FOLDED = r"""translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_REPAIR = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
              ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM keyed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
         regexp_replace(text, '{_SPACES}', '', 'g') AS bare
  FROM damaged
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), judged AS MATERIALIZED (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, bare = '' AS blank,
         bare <> '' AND seen AS duplicate, bare <> '' AND NOT seen AS stays,
         bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         CASE WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS late,
         before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM marked
), marks AS MATERIALIZED (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS turns
  FROM judged GROUP BY conv_id
), walk(conv_id, i, s0, s1, s2, s3) AS (
  -- the cheapest way to every state: nothing yet, after s, after u, after a
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}},
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])),
         {{'c': CAST(3 AS BIGINT), 'a': 'I', 'r': ['user:']}}, {{'c': CAST(6 AS BIGINT), 'a': 'II', 'r': ['user:', 'assistant:']}}
  FROM marks
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {_least("s3", _edit("s2", "3", "I", "'assistant:'"))}
  FROM (
    SELECT conv_id, i, s0, s1, s3, {_least("s2", *[_edit(s, "3", "I", "'user:'") for s in ("s0", "s1", "s3")])} AS s2
    FROM (
      SELECT w.conv_id, j.i, {_edit("w.s0", "4", "D", None)} AS s0,
             {_least(_edit("w.s1", "4", "D", None), _edit("w.s0", "late", "K", "role || ':' || text", "stays AND initial = 's'"))} AS s1,
             {_to("2", "013", "u", "user")} AS s2, {_to("3", "2", "a", "assistant")} AS s3
      FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1
    )
  )
), best AS (
  SELECT w.conv_id, {_least("s0", "s3")} AS s
  FROM walk w JOIN marks m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.i = m.turns
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost,
       coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN marks m ON e.conv_id IS NOT DISTINCT FROM m.conv_id
     LEFT JOIN best b ON e.conv_id IS NOT DISTINCT FROM b.conv_id
"""

_PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
        FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
), f AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), inside AS (
  SELECT lang, f, array_to_string(w[i : i + s - 1], ' ') AS phrase
  FROM (SELECT lang, f, w, s, unnest(range(1, k - s + 2)) AS i
        FROM c, (SELECT unnest([2, 3, 4]) AS s) WHERE s < k)
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM inside o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.f >= 100 * c.f)
), cuts AS (
  SELECT lang, phrase, f AS a, p, array_to_string(w[1 : p], ' ') AS l_part, array_to_string(w[p + 1 : k], ' ') AS r_part
  FROM (SELECT *, unnest(range(1, k)) AS p FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, p, l.f AS l, r.f AS r, n.n,
         CAST((1000 * CAST(a AS HUGEINT) * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = l_part
            JOIN f r ON r.lang = cuts.lang AND r.phrase = r_part JOIN n ON n.lang = cuts.lang
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, p) AS cut FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least WHERE cut = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

_LIMITS = LineRules()
_PHRASE = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
_CLEAN = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), runs AS (
  SELECT id, i, array_to_string(w[i : i + 4], ' ') AS run
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), again AS (
  SELECT id, unnest(list) AS i FROM (SELECT id, list(i) AS list FROM runs GROUP BY id, run HAVING count(*) > 1)
), repeats AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY id
), lines AS (
  SELECT id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d)
), judged AS (
  SELECT id, line, len(w) AS n,
         CASE WHEN len(w) <= {_LIMITS.phrase_words} AND ({_PHRASE}) THEN 'boilerplate'
              WHEN len(list_filter(w, lambda x: regexp_matches(x, '^[|»›•·>]'))) > len(w) * {_LIMITS.bars} THEN 'navigation'
              WHEN len(list_filter(w, lambda x: regexp_matches(x, '([#*$%&|<>]|[!?]{{2}}),?$'))) > len(w) * {_LIMITS.signs} THEN 'punctuation'
              WHEN len(w) <= {_LIMITS.short} AND len(list_filter(w, lambda x: regexp_matches(x, '[.!?…。！？؟।]["''”’»)\]]*$'))) = 0 THEN 'punctuation'
              ELSE 'stays' END AS rule
  FROM lines WHERE len(w) > 0
), sums AS (
  SELECT id, count(*) - count(DISTINCT line) AS doubled, sum(n) FILTER (rule = 'stays') AS "left",
         sum(n) FILTER (rule <> 'boilerplate') AS body
  FROM judged GROUP BY id
), base AS (
  SELECT d.*, coalesce(s.doubled, 0) AS doubled, coalesce(s."left", 0) AS n_left, coalesce(s.body, 0) AS body,
         coalesce(r.n, 0) AS repeated, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS failed
  FROM d LEFT JOIN sums s USING (id) LEFT JOIN repeats r USING (id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(doubled AS BIGINT) AS n_dup_lines, CAST(repeated AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND n_left > 0 AND body - n_left <= body * {_LIMITS.lost} AS kept
FROM base
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": _EXACT,
        "op4_exact_top_k": _TOP_K,
        "op5_source_mixing": _MIX,
        "op9_url_filters": _URLS,
        "op11_conversation_repair": _REPAIR,
        "op12_phrase_collocations": _PHRASES,
        "op13_quality_rules": _CLEAN,
    }
