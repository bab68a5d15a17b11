"""The registered queries in SQL for DuckDB.

Only the fixed values (word lists, character classes) are shared with the library; unit tests
check those by hand.
"""

from __future__ import annotations

from postpulse.constants import (
    CHARTED,
    EDGE_CHARS,
    HANDLE_OR_TAG,
    HISTOGRAM_BINS,
    NEVER_TOKENS,
    POINTS_KEPT,
    PUNCTUATION,
    TOP_WORDS,
    URL_TAIL,
    WHITESPACE,
)
from postpulse.plans.catalog import (
    BOX,
    BROKEN,
    LAG_AT,
    LATE_AT,
    PARTS,
    PATTERN,
    REFRESH_AT,
    SANTIAGO,
    SEARCH_MANY,
    SEGMENTS,
    SINCE,
    STOPWORDS,
    TRACK,
    TRACK_50,
    TRACK_90,
    UNTIL,
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


EVENTS = """ev AS (
  SELECT event_id AS ingest_id, ts AS "dateTweet",
         'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS "screenName",
         user_id, event_type, props, value
  FROM events)"""
POSTS = EVENTS + """, talks AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1),
posts AS (
  SELECT ev.*, coalesce(s.text, w.text) AS tweet, d.lang, d.source
  FROM ev LEFT JOIN talks t ON ev.ingest_id % 10 <> 0
    AND t.conv_id = ev.ingest_id % (SELECT count(*) FROM talks)
  LEFT JOIN conversations s ON s.conv_id = t.conv_id
    AND s.turn = ev.ingest_id // (SELECT count(*) FROM talks) % t.turns
  LEFT JOIN documents w ON ev.ingest_id % 10 = 0
    AND w.doc_id = ev.ingest_id // 10 % (SELECT count(*) FROM documents)
  LEFT JOIN documents d ON d.doc_id = ev.ingest_id % (SELECT count(*) FROM documents))"""
FEED = POSTS + """, feed AS (
  SELECT *, '#' || event_type || ' ' || tweet AS txt,
         date_trunc('second', "dateTweet") AS sec
  FROM posts)"""

WORD = r"\p{L}\p{N}_"
HANDLE_URL = rf"{HANDLE_OR_TAG}|[{WORD}]+://{URL_TAIL}"


def replaced(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def normal(expr: str) -> str:
    step = replaced(expr, f"{HANDLE_URL}|{PUNCTUATION}+", " ")
    step = replaced(step, f"[^{WORD}]", " ")
    step = replaced(step, "[0-9]+", "")
    step = replaced(step, " +", " ")
    return f"lower(strip_accents({step}))"


def not_counted(stopwords=STOPWORDS) -> str:
    return "(" + ", ".join(lit(w) for w in [*stopwords, *NEVER_TOKENS]) + ")"


def split(expr: str) -> str:
    return f"string_split_regex({expr}, {lit(WHITESPACE)})"


def joined(expr: str, sort: bool = True) -> str:
    return f"coalesce(array_to_string({f'list_sort({expr})' if sort else expr}, ' '), '')"


def tags(expr: str) -> str:
    return joined(
        f"list_distinct([x[2:] for x in {split(expr)} if starts_with(x, '#')])"
    )


def santiago(expr: str) -> str:
    return f"(({expr}) AT TIME ZONE 'UTC') AT TIME ZONE '{SANTIAGO}'"


def hit(text: str, keyword: str) -> str:
    return f"regexp_matches({text}, {keyword})"


def series_sql(source: str, keywords, text="tweet", edge="series", index=None) -> str:
    """CTEs ending in ``s(audience, series, ts, n)`` over ``source(audience, dateTweet, text)``."""
    own = """SELECT * FROM c QUALIFY ts > min(ts) OVER (PARTITION BY audience, series)
               AND ts < max(ts) OVER (PARTITION BY audience, series)"""
    return f"""
src AS ({source}),
kw AS (SELECT unnest({listed(keywords)}) AS series),
m AS (SELECT audience, 'All' AS series, date_trunc('minute', "dateTweet") AS ts FROM src
      UNION ALL
      SELECT audience, series, date_trunc('minute', "dateTweet")
      FROM src JOIN kw ON contains({text}, series)),
c AS (SELECT audience, series, ts, count(*) AS n FROM m GROUP BY ALL),
own AS ({own}),
kept AS ({"SELECT * FROM own" if edge == "series" else "SELECT * FROM c"}),
names AS (SELECT 'All' AS series UNION ALL SELECT series FROM kw),
idx AS (SELECT audience, ts FROM own WHERE series = 'All'),
s AS (SELECT idx.audience, names.series, idx.ts, coalesce(kept.n, 0) AS n
      FROM idx CROSS JOIN names LEFT JOIN kept
        ON kept.audience = idx.audience AND kept.series = names.series AND kept.ts = idx.ts)"""


def posts_series(keywords, where="TRUE", edge="series") -> str:
    source = f"SELECT 'x' AS audience, \"dateTweet\", tweet FROM posts WHERE {where}"
    return POSTS + ", " + series_sql(source, keywords, edge=edge)


def in_segment(segment: str) -> str:
    return f"\"screenName\" IN (SELECT c_name FROM customer WHERE c_mktsegment = '{segment}')"


def frequency(sub: str, col: str, stopwords=STOPWORDS) -> str:
    return f"""SELECT word, count(*) AS n FROM (
      SELECT unnest(list_distinct(string_split({normal(col)}, ' '))) AS word FROM {sub})
    WHERE word NOT IN {not_counted(stopwords)} GROUP BY word"""


def raw_frequency(where="TRUE") -> str:
    return f"""SELECT word, count(*) AS n FROM (
      SELECT unnest({split('text')}) AS word FROM documents WHERE {where})
    WHERE word <> '' GROUP BY word"""


def doc_counts(keywords) -> str:
    return f"""SELECT keyword, CAST(count(doc_id) AS BIGINT) AS n
    FROM (SELECT unnest({listed(keywords)}) AS keyword)
    LEFT JOIN documents ON contains(text, keyword) GROUP BY keyword"""


CAPTURE = f"""
  SELECT txt AS text, {santiago('sec')} AS created_at, CAST(NULL AS VARCHAR) AS geo, lang,
    CAST(NULL AS VARCHAR) AS place, user_id * 7 AS user_favourites_count,
    user_id * 10 AS user_statuses_count,
    CASE WHEN event_type <> 'view' THEN source END AS user_description,
    CASE WHEN event_type = 'click' THEN '' ELSE source END AS user_location,
    user_id, TIMESTAMP '2007-02-12 12:01:32' AS user_created_at,
    user_id % 2 = 0 AS user_verified,
    CASE WHEN event_type <> 'error' THEN 'https://example.org/' || user_id END AS user_url,
    user_id AS user_listed_count, user_id * 3 AS user_friends_count,
    upper("screenName") AS user_name, "screenName" AS user_screen_name,
    user_id % 3 = 0 AS user_geo_enabled, ingest_id AS id, user_id AS favorite_count,
    TRUE AS retweeted, source, FALSE AS favorited, user_id * 2 AS retweet_count,
    '[' || array_to_string([to_json(x)::VARCHAR for x in list_sort(list_distinct(
        [y[2:] for y in {split('txt')} if starts_with(y, '#')]))], ',') || ']' AS hash_tags
  FROM feed"""

MINUTES = """c AS (SELECT date_trunc('minute', "dateTweet") AS ts, count(*) AS n
  FROM ev GROUP BY ALL)"""
INNER = "ts > (SELECT min(ts) FROM c) AND ts < (SELECT max(ts) FROM c)"

POSITION = "CAST(user_id % 40 - 90 AS DOUBLE), CAST(user_id % 60 - 60 AS DOUBLE)"
W, S, E, N = BOX
IN_BOX = f"user_id % 40 - 90 BETWEEN {W} AND {E} AND user_id % 60 - 60 BETWEEN {S} AND {N}"
LIVE = f"""(({IN_BOX}) OR contains(tweet, 'migaja') OR contains(tweet, 'que'))
  AND lang IN ('es', 'fr')"""

SEARCH = f"""lang = 'es' AND ({' OR '.join(f"contains(tweet, {lit(k)})" for k in TRACK)})"""

EPOCH = "CAST(floor(epoch(date_trunc('minute', \"dateTweet\"))) AS BIGINT)"


def binned(x: str, source: str) -> str:
    lo, hi = f"(SELECT min(epoch) FROM {source})", f"(SELECT max(epoch) FROM {source})"
    share = f"CAST({x} - {lo} AS DOUBLE) * {HISTOGRAM_BINS} / ({hi} - {lo})"
    return f"CAST(least(floor({share}) + 1, {HISTOGRAM_BINS}) AS BIGINT)"


def audience_source() -> str:
    parts = ["SELECT 'everyone' AS audience, \"dateTweet\", tweet FROM posts"]
    parts += [
        f"SELECT '{name}', \"dateTweet\", tweet FROM posts WHERE {in_segment(segment)}"
        for name, segment in SEGMENTS.items()
    ]
    return " UNION ALL ".join(parts)


def updated(columns: str) -> str:
    """Refresh of the series held at REFRESH_AT with the series of all posts."""
    old = series_sql(
        f"SELECT 'x' AS audience, \"dateTweet\", tweet FROM posts "
        f"WHERE \"dateTweet\" < TIMESTAMP '{REFRESH_AT}'", TRACK)
    new = series_sql("SELECT 'x' AS audience, \"dateTweet\", tweet FROM posts", TRACK)
    return f"""WITH {POSTS},
    old AS (WITH {old} SELECT series, ts, n FROM s
            QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= {POINTS_KEPT}),
    new AS (WITH {new} SELECT series, ts, n FROM s)
    {columns}"""


UPDATE = f"""SELECT * FROM (
      SELECT * FROM old UNION ALL
      SELECT * FROM new WHERE ts > (SELECT max(ts) FROM old WHERE series = 'All'))
    QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= {POINTS_KEPT}"""


# Parts that a line without any post lacks.
ABSENT = (
    "user.screen_name", "user.name", "user.url", "user.description", "user.location",
    "user.verified", "user.geo_enabled", "text", "created_at",
)


def grown(name: str, member: str, until: str) -> str:
    """CTE ``name``: one audience's series held at ``until`` and refreshed with all posts."""
    source = f"SELECT 'x' AS audience, \"dateTweet\", tweet FROM posts WHERE ({member})"
    old = series_sql(f"{source} AND \"dateTweet\" < TIMESTAMP '{until}'", TRACK)
    new = series_sql(source, TRACK)
    last = f"QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= {POINTS_KEPT}"
    return f"""{name} AS (
      WITH old AS (WITH {old} SELECT series, ts, n FROM s {last}),
      new AS (WITH {new} SELECT series, ts, n FROM s)
      SELECT * FROM (SELECT * FROM old UNION ALL
        SELECT * FROM new WHERE ts > (SELECT max(ts) FROM old WHERE series = 'All')) {last})"""


def oracle_sql() -> dict[str, str]:
    sql = {}
    sql["read_posts"] = f"""WITH {EVENTS}
        SELECT ingest_id, "dateTweet", "screenName" FROM ev WHERE event_type <> 'error'
        ORDER BY ingest_id DESC LIMIT 2500"""
    sql["read_posts_unlimited"] = f"WITH {POSTS} SELECT ingest_id, tweet FROM posts"
    sql["newest_posts"] = f"""WITH {POSTS} SELECT ingest_id, "dateTweet", tweet FROM posts
        ORDER BY ingest_id DESC LIMIT 900"""
    half = "CASE WHEN event_id % 5 <> 0 THEN event_id // 2 END"
    sql["newest_ties"] = " UNION ALL ".join(
        f"(SELECT {n} AS n, {half} AS id FROM events ORDER BY id DESC NULLS LAST LIMIT {n})"
        for n in (999, 1_001, 9_000))
    sql["read_newest_days"] = f"""WITH {POSTS}
        SELECT ingest_id, "dateTweet", tweet, CAST("dateTweet" AS DATE) AS day FROM posts
        ORDER BY day DESC, ingest_id DESC LIMIT 700"""
    sql["select_authors"] = f'WITH {EVENTS} SELECT "screenName" FROM ev'
    sql["select_time_text"] = f'WITH {POSTS} SELECT "dateTweet", tweet FROM posts'
    sql["parse_posts_json"] = f"""WITH {EVENTS}
        SELECT ingest_id, CAST(props->>'k' AS BIGINT) AS k FROM ev"""
    parts = """SELECT unnest(generate_series(0, len(p) - 1))::INT AS pos, unnest(p) AS keyword
        FROM (SELECT string_split(text, ', ') AS p FROM documents)"""
    sql["split_keywords"] = parts
    sql["first_keywords"] = f"SELECT * FROM ({parts}) WHERE pos < {CHARTED}"
    sql["read_roster"] = """SELECT c_mktsegment, '@' || c_name AS account, c_name AS handle
        FROM customer WHERE c_acctbal > 0"""
    sql["plain_stopwords"] = f"""SELECT DISTINCT strip_accents(word) AS word FROM (
        SELECT unnest({split('text')}) AS word FROM documents)"""
    sql["search_posts"] = f"""WITH {POSTS} SELECT ingest_id, "dateTweet", tweet FROM posts
        WHERE {SEARCH} AND "dateTweet" >= '{SINCE}' AND "dateTweet" < '{UNTIL}'
        ORDER BY "dateTweet" DESC, ingest_id DESC LIMIT 500"""
    many = " OR ".join(f"contains(tweet, {lit(k)})" for k in SEARCH_MANY)
    sql["search_many_keywords"] = f"""WITH {POSTS}
        SELECT ingest_id FROM posts WHERE lang = 'es' AND ({many})"""
    sql["search_all_locations"] = f"""WITH {POSTS}
        SELECT "screenName" AS user, source AS location FROM posts
        WHERE {SEARCH} AND "dateTweet" >= '{SINCE}'"""

    sql["capture_round_trip"] = f"WITH {FEED} {CAPTURE}"
    place = "CASE WHEN event_type = 'click' THEN '' ELSE source END AS user_location"
    sql["latest_capture"] = f"""WITH {FEED}
        SELECT ingest_id AS id, lang, txt AS text, {place} FROM feed WHERE lang IN ('es', 'fr')"""
    sql["capture_row"] = f"WITH {FEED} {CAPTURE}"
    sql["captures_by_name"] = f"""WITH {FEED}
        SELECT ingest_id AS id, lang, txt AS text, CAST(NULL AS BIGINT) AS user_id
        FROM feed WHERE lang = 'es' UNION ALL
        SELECT ingest_id, NULL, txt, user_id FROM feed WHERE lang <> 'es'"""
    sql["foreign_captures"] = f"""WITH {FEED}
        SELECT ingest_id AS id, txt AS text, lang FROM feed"""
    sql["stored_by_day"] = f"""WITH {POSTS}
        SELECT ingest_id, CAST("dateTweet" AS DATE) AS day, tweet FROM posts
        WHERE "dateTweet" >= '{SINCE}' AND "dateTweet" < '{UNTIL}'"""
    sql["posts_to_json"] = f"""WITH {POSTS}
        SELECT CAST(to_json({{'ingest_id': ingest_id, 'screenName': "screenName",
          'event_type': event_type, 'lang': lang}}) AS VARCHAR) AS json FROM posts"""
    sql["save_search"] = f"""WITH {POSTS}
        SELECT tweet AS text, "dateTweet" AS date, {EPOCH} AS epoch FROM posts
        WHERE {SEARCH.replace("'es'", "'en'")}"""

    sql["full_text"] = f"WITH {FEED} SELECT ingest_id, txt AS tweet FROM feed"
    sql["flatten_post"] = f"""WITH {FEED}
        SELECT {santiago('sec')} AS "dateTweet", txt AS tweet, "screenName",
          upper("screenName") AS name,
          CASE WHEN event_type <> 'error' THEN 'https://example.org/' || user_id END AS user_url,
          CASE WHEN event_type <> 'view' THEN source END AS description,
          CASE WHEN event_type = 'click' THEN '' ELSE source END AS location,
          user_id % 2 = 0 AS verified, user_id % 3 = 0 AS "geoEnabled",
          {tags('txt')} AS hash_tags FROM feed"""
    sql["to_local_time"] = f"""WITH {EVENTS}
        SELECT ingest_id, {santiago('"dateTweet"')} AS local,
          "dateTweet" - INTERVAL 3 HOUR AS shifted FROM ev"""
    sql["hashtags"] = f"""WITH {EVENTS}, t AS (
          SELECT ingest_id, concat_ws(' ', '#' || event_type, 'x', props, '#' || event_type,
            '#' || user_id || ',', '##') AS txt FROM ev)
        SELECT ingest_id, {tags('txt')} AS hash_tags FROM t"""
    sql["user_locations"] = f"""WITH {POSTS}
        SELECT "screenName" AS user, source AS location FROM posts"""
    sql["post_entities"] = f"""WITH {FEED}
        SELECT sec - INTERVAL 3 HOUR AS time, "screenName" AS user,
          "screenName" AS user_mentions, event_type AS hashtags,
          CASE WHEN event_type = 'click' THEN '' ELSE source END AS location FROM feed"""
    sql["news_time"] = f"""WITH {EVENTS}
        SELECT event_type || ' ' || user_id AS title, {EPOCH} AS epoch
        FROM ev WHERE contains(event_type || ' ' || user_id, 'signup 1')"""
    sql["read_news"] = sql["news_time"]
    sql["minute_epoch"] = f"WITH {EVENTS} SELECT ingest_id, {EPOCH} AS epoch FROM ev"

    sql["contains_keyword"] = f"SELECT doc_id FROM documents WHERE {hit('text', lit('red'))}"
    sql["contains_pattern"] = f"SELECT doc_id FROM documents WHERE {hit('text', lit(PATTERN))}"
    sql["any_keyword"] = "SELECT doc_id FROM documents WHERE " + " OR ".join(
        hit("text", lit(k)) for k in TRACK[3:])
    sql["by_roster"] = f"""WITH {POSTS} SELECT ingest_id, "screenName" FROM posts
        WHERE {in_segment('MACHINERY')}"""
    sql["by_language"] = "SELECT doc_id, lang FROM documents WHERE lang = 'es'"
    sql["in_box"] = f"WITH {EVENTS} SELECT ingest_id FROM ev WHERE {IN_BOX}"
    sql["box_search"] = f"""WITH {EVENTS} SELECT ingest_id,
          CAST(user_id % 40 - 90 AS DOUBLE) AS lon, CAST(user_id % 60 - 60 AS DOUBLE) AS lat
        FROM ev WHERE user_id % 7 <> 0 AND {IN_BOX}"""
    sql["author_search"] = f"""WITH {EVENTS} SELECT ingest_id, CAST("dateTweet" AS DATE) AS day
        FROM ev WHERE "screenName" = 'Customer#000000007'"""
    sql["ingest_filter"] = f"WITH {POSTS} SELECT ingest_id FROM posts WHERE {LIVE}"
    sql["between_dates"] = f"""WITH {EVENTS} SELECT ingest_id, "dateTweet" FROM ev
        WHERE "dateTweet" >= '{SINCE}' AND "dateTweet" < '{UNTIL}'"""
    sql["drop_blank_location"] = f"""WITH {EVENTS} SELECT ingest_id, props AS location FROM ev
        WHERE event_type NOT IN ('error', 'view')"""
    sql["split_good"] = f"WITH {POSTS} SELECT ingest_id FROM posts WHERE event_type <> 'error'"
    sql["split_rejects"] = f"""WITH {POSTS}
        SELECT ingest_id, 'user.url' AS missing FROM posts WHERE event_type = 'error'"""
    sql["by_author"] = "SELECT event_id AS ingest_id FROM events WHERE user_id = 7"
    sql["newer_than"] = f"""WITH {EVENTS}, {MINUTES}
        SELECT ts, n FROM c WHERE {INNER} AND ts > TIMESTAMP '{REFRESH_AT}'"""
    sql["drop_last_minute"] = f"""WITH {EVENTS} SELECT ingest_id, "dateTweet" FROM ev
        WHERE date_trunc('minute', "dateTweet")
            < (SELECT date_trunc('minute', max("dateTweet")) FROM ev)"""
    sql["positive_only"] = f"SELECT * FROM ({doc_counts(TRACK_50)}) WHERE n > 0"

    sql["zero_fill"] = f"""WITH {EVENTS},
        c AS (SELECT event_type, date_trunc('minute', "dateTweet") AS ts, count(*) AS n
              FROM ev GROUP BY ALL),
        names AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'absent']) AS series)
        SELECT series, i.ts, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT ts FROM c) i CROSS JOIN names
        LEFT JOIN c ON c.ts = i.ts AND c.event_type = series"""
    sql["match_keywords"] = f"""SELECT doc_id, keyword
        FROM documents JOIN (SELECT unnest({listed(TRACK_50)}) AS keyword) ON contains(text, keyword)
        UNION ALL SELECT doc_id, {lit(PATTERN)} FROM documents
        WHERE {hit('text', lit(PATTERN))}"""
    said = f"""kw AS (SELECT DISTINCT unnest({split('text')}) AS keyword FROM (
        SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE turn = 0))"""
    sql["match_many_keywords"] = f"""WITH {said} SELECT doc_id, keyword
        FROM documents JOIN kw ON length(keyword) >= 9 AND contains(text, keyword)"""
    sql["many_keyword_counts"] = f"""WITH {said}
        SELECT keyword, CAST(count(doc_id) AS BIGINT) AS n
        FROM kw LEFT JOIN documents ON contains(text, keyword) WHERE keyword <> '' GROUP BY keyword"""
    sql["align_news"] = f"""WITH {EVENTS},
        p AS (SELECT {EPOCH} AS epoch FROM ev WHERE event_type = 'purchase'),
        w AS (SELECT ingest_id, {EPOCH} AS epoch FROM ev WHERE event_type = 'signup'),
        h AS (SELECT {binned('epoch', 'p')} AS bin, count(*) AS posts FROM p GROUP BY ALL),
        shown AS (SELECT *, {binned('epoch', 'p')} AS bin FROM w
                  WHERE epoch BETWEEN (SELECT min(epoch) FROM p) AND (SELECT max(epoch) FROM p))
        SELECT bin, ingest_id, epoch, coalesce(posts, 0) AS posts
        FROM shown LEFT JOIN h USING (bin)"""

    sql["posts_per_minute"] = f"WITH {EVENTS}, {MINUTES} SELECT ts, n FROM c WHERE {INNER}"
    one = "SELECT series, ts, n FROM s"
    sql["keyword_series"] = f"WITH {posts_series(TRACK_50)} {one}"
    sql["keyword_series_many"] = f"WITH {posts_series(TRACK_90)} {one}"
    sql["keyword_series_outer"] = f"WITH {posts_series(TRACK, edge='global')} {one}"
    types = series_sql("SELECT 'x' AS audience, \"dateTweet\", event_type FROM ev",
                       ["click", "sign", "e"], text="event_type")
    sql["type_series"] = f"WITH {EVENTS}, {types} {one}"
    sql["roster_series"] = f"WITH {posts_series(TRACK, in_segment('BUILDING'))} {one}"
    sql["series_on_index"] = f"""WITH {EVENTS}, {MINUTES},
        o AS (SELECT date_trunc('minute', "dateTweet") AS ts, count(*) AS n FROM ev
              WHERE event_type = 'click' GROUP BY ALL),
        k AS (SELECT * FROM o QUALIFY ts > min(ts) OVER () AND ts < max(ts) OVER ())
        SELECT c.ts, coalesce(k.n, 0) AS n FROM c LEFT JOIN k ON k.ts = c.ts
        WHERE c.ts > (SELECT min(ts) FROM c) AND c.ts < (SELECT max(ts) FROM c)"""
    member = in_segment("BUILDING")
    sql["roster_matrix"] = f"""WITH {POSTS}, p AS (SELECT *, {member} AS mine FROM posts)
        SELECT "dateTweet" AS ts, count(*) FILTER (mine) AS "All",
        {', '.join(f'count(*) FILTER (mine AND contains(tweet, {lit(k)})) AS "{k}"' for k in TRACK)}
        FROM p GROUP BY "dateTweet\""""
    sql["keyword_totals"] = f"""WITH {posts_series(TRACK)}
        SELECT series, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY series"""
    sql["keyword_doc_counts"] = doc_counts(TRACK_50)
    sql["document_frequency"] = frequency("documents", "text")
    sql["document_frequency_table_stops"] = f"""SELECT * FROM ({frequency('documents', 'text', [])})
        WHERE word NOT IN (SELECT unnest(string_split({normal('text')}, ' ')) FROM benchmark)"""
    sql["term_frequency"] = raw_frequency()
    sql["merge_counts"] = f"""SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        {raw_frequency("lang = 'es'")} UNION ALL {raw_frequency("lang <> 'es'")}) GROUP BY word"""
    sql["counts_by_time"] = "SELECT ts, count(*) AS n FROM events GROUP BY ts"
    sql["minute_span"] = """SELECT count(DISTINCT date_trunc('minute', ts)) AS minutes,
        max(date_trunc('minute', ts)) AS newest FROM events"""
    sql["minute_counts_closed"] = f"""WITH {EVENTS}, {MINUTES}
        SELECT ts, n FROM c WHERE ts < (SELECT max(ts) FROM c)"""
    sql["time_histogram"] = f"""WITH {EVENTS}, p AS (SELECT {EPOCH} AS epoch FROM ev),
        h AS (SELECT {binned('epoch', 'p')} AS bin, count(*) AS n FROM p GROUP BY ALL)
        SELECT b.bin, coalesce(n, 0) AS n
        FROM (SELECT unnest(generate_series(1, {HISTOGRAM_BINS}))::BIGINT AS bin) b
        LEFT JOIN h ON h.bin = b.bin"""

    sql["trim_edges"] = f"""WITH {EVENTS},
        c AS (SELECT "screenName" AS series, date_trunc('minute', "dateTweet") AS ts,
              count(*) AS n FROM ev GROUP BY ALL)
        SELECT * FROM c QUALIFY ts > min(ts) OVER (PARTITION BY series)
          AND ts < max(ts) OVER (PARTITION BY series)"""
    sql["keep_last"] = f"""WITH {posts_series(TRACK)} {one}
        QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= {POINTS_KEPT}"""
    sql["top_words"] = f"SELECT * FROM ({raw_frequency()}) ORDER BY n DESC, word LIMIT 15"
    sql["append_increment"] = f"WITH {posts_series(TRACK)} {one}"

    sql["normalize_text"] = f"SELECT doc_id, {normal('text')} AS words FROM documents"
    sql["normalize_conversations"] = f"""SELECT conv_id, turn, {normal('text')} AS words
        FROM conversations"""
    parts = f"replace(translate(lower(text), {lit(PARTS[0])}, {lit(PARTS[1])}), 'h', chr(769))"
    sql["composed_hangul"] = f"SELECT doc_id, strip_accents({parts}) AS tweet FROM documents"
    sql["strip_accents"] = "SELECT doc_id, strip_accents(text) AS tweet FROM documents"
    sql["strip_handles_urls"] = f"""SELECT page_id, {replaced('html', HANDLE_URL, '')} AS html
        FROM pages"""
    sql["tokens"] = f"""SELECT doc_id, {joined(
        f"list_distinct([w for w in string_split({normal('text')}, ' ') if w NOT IN {not_counted()}])"
        )} AS tokens FROM documents"""
    edge = f"trim(w, {lit(EDGE_CHARS)})"
    base = f"strip_accents(lower({replaced('text', HANDLE_URL, '')}))"
    sql["tokens_edge_trim"] = f"""SELECT doc_id, {joined(
        f"list_distinct([{edge} for w in {split(base)} if {edge} NOT IN {not_counted()}])"
        )} AS tokens FROM documents"""
    runs = f"regexp_extract_all(strip_accents(lower(text)), {lit('[' + chr(92) + 'p{L}' + chr(92) + 'p{Nl}' + chr(92) + 'p{No}_]+')})"
    sql["tokens_alpha"] = f"""SELECT doc_id, {joined(
        f"[w for w in {runs} if length(w) BETWEEN 5 AND 40 AND NOT starts_with(w, '_')]", False
        )} AS tokens FROM documents"""
    sql["strip_first"] = "SELECT substr(c_name, 2) AS name FROM customer"

    sql["ingest_posts"] = f"""WITH {FEED}
        SELECT sec AS "dateTweet", "screenName", txt AS tweet FROM feed
        WHERE event_type <> 'error' AND lang IN ('es', 'fr')
          AND (({IN_BOX}) OR contains(txt, 'migaja') OR contains(txt, 'que'))"""
    live = f"""lang IN ('es', 'fr')
          AND (({IN_BOX}) OR contains(txt, 'migaja') OR contains(txt, 'que'))"""
    sql["ingest_rejects"] = f"""WITH {POSTS}
        SELECT NULL AS broken, ingest_id, 'user.url' AS missing FROM posts WHERE event_type = 'error'
        UNION ALL SELECT {lit(BROKEN)} || ingest_id, NULL, {lit(' '.join(ABSENT))}
        FROM posts WHERE event_type = 'error'"""
    sql["stream_posts"] = f"""WITH {FEED}
        SELECT ingest_id, sec AS "dateTweet", txt AS tweet FROM feed WHERE {live}"""
    sql["stream_capture"] = f"WITH {FEED} {CAPTURE} WHERE {live}"
    counts = ", ".join(
        f"count(*) FILTER (contains(tweet, {lit(k)})) AS n{i}" for i, k in enumerate(TRACK))
    rows = " UNION ALL ".join(
        ["SELECT 'All' AS series, ts, n FROM w"]
        + [f"SELECT {lit(k)}, ts, n{i} FROM w" for i, k in enumerate(TRACK)])
    sql["closed_minutes"] = f"""WITH {POSTS}, w AS (
          SELECT date_trunc('minute', "dateTweet") AS ts, count(*) AS n, {counts}
          FROM posts GROUP BY 1
          HAVING date_trunc('minute', "dateTweet") + INTERVAL 1 MINUTE
              <= (SELECT max("dateTweet") FROM posts) - INTERVAL 10 MINUTE)
        {rows}"""
    lots = f"""{EVENTS}, l AS (
          SELECT *, date_trunc('minute', "dateTweet") AS minute,
            CASE WHEN "dateTweet" >= TIMESTAMP '{LATE_AT}' THEN 2 WHEN ingest_id % 50 = 0 THEN 3 ELSE 1 END AS lot
          FROM ev),
        u AS (SELECT max("dateTweet") FILTER (lot = 1) - INTERVAL 10 MINUTE AS one,
                     max("dateTweet") - INTERVAL 10 MINUTE AS two FROM l WHERE lot < 3),
        p AS (SELECT l.*, lot = 2 AND minute + INTERVAL 1 MINUTE <= one
                OR lot = 3 AND minute + INTERVAL 1 MINUTE <= two AS late, two AS until FROM l, u)"""
    sql["late_posts"] = f"""WITH {lots}
        SELECT ingest_id, "dateTweet", event_type AS tweet FROM p WHERE late"""
    sql["closed_minutes_in_lots"] = f"""WITH {lots}, w AS (
          SELECT minute AS ts, count(*) AS n, count(*) FILTER (contains(event_type, 'click')) AS click,
                 count(*) FILTER (contains(event_type, 'e')) AS e
          FROM p WHERE NOT late GROUP BY minute HAVING minute + INTERVAL 1 MINUTE <= any_value(until))
        SELECT 'All' AS series, ts, n FROM w UNION ALL SELECT 'click', ts, click FROM w
        UNION ALL SELECT 'e', ts, e FROM w"""
    sql["update_series"] = updated(UPDATE)
    sql["refreshed_series"] = updated(UPDATE)
    sql["refreshed_words"] = f"""WITH {POSTS} SELECT * FROM ({frequency('posts', 'tweet')})
        ORDER BY n DESC, word LIMIT {TOP_WORDS}"""
    window = "(SELECT * FROM posts WHERE ingest_id > (SELECT max(ingest_id) FROM posts) - 4000)"
    sql["moving_words"] = f"WITH {POSTS} {frequency(window, 'tweet')}"
    sql["moving_weights"] = f"""WITH {POSTS} SELECT * FROM ({frequency(window, 'tweet')})
        ORDER BY n DESC, word LIMIT {TOP_WORDS}"""
    member = in_segment("MACHINERY")
    early = f"""({member} AND "dateTweet" < TIMESTAMP '{LAG_AT}'
      OR NOT {member} AND "dateTweet" < TIMESTAMP '{REFRESH_AT}')"""
    everyone = grown("e", "TRUE", REFRESH_AT).replace(
        f"(TRUE) AND \"dateTweet\" < TIMESTAMP '{REFRESH_AT}'", early)
    sql["refreshed_dashboard"] = f"""WITH {POSTS}, {everyone}, {grown("p", member, LAG_AT)}
        SELECT 'everyone' AS audience, 'series' AS part, series AS name, ts, n FROM e
        UNION ALL SELECT 'press', 'series', series, ts, n FROM p
        UNION ALL SELECT 'press', 'weight', series, NULL, CAST(sum(n) AS BIGINT) FROM p
        WHERE series <> 'All' GROUP BY series HAVING sum(n) > 0
        UNION ALL SELECT 'everyone', 'weight', word, NULL, n FROM (
          SELECT * FROM ({frequency('posts', 'tweet')}) ORDER BY n DESC, word LIMIT {TOP_WORDS})"""
    newest = """SELECT 'x' AS audience, "dateTweet", tweet FROM (
        SELECT * FROM posts ORDER BY CAST("dateTweet" AS DATE) DESC, ingest_id DESC LIMIT 800)"""
    sql["refresh_from_stream"] = f"""WITH {POSTS}, {series_sql(newest, TRACK)} {one}
        QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= {POINTS_KEPT}"""
    sql["series_change"] = updated("""
        SELECT max(new.ts) > (SELECT max(ts) FROM old WHERE series = 'All') AS changed,
          max(new.ts) AS last FROM new WHERE series = 'All'""")

    charted = f"series IN ('All', {', '.join(lit(k) for k in TRACK_50[:CHARTED])})"
    sql["chart_series"] = f"WITH {posts_series(TRACK_50)} {one} WHERE {charted}"
    sql["keyword_weights"] = f"""WITH {posts_series(TRACK_50)}
        SELECT series, CAST(sum(n) AS BIGINT) AS n FROM s WHERE series <> 'All'
        GROUP BY series HAVING sum(n) > 0"""
    sql["word_weights"] = f"""SELECT * FROM ({frequency('documents', 'text')})
        ORDER BY n DESC, word LIMIT {TOP_WORDS}"""
    sql["dashboard"] = f"""WITH {POSTS}, {series_sql(audience_source(), TRACK_50)}
        SELECT audience, 'series' AS part, series AS name, ts, n FROM s WHERE {charted}
        UNION ALL
        SELECT audience, 'weight', series, NULL, CAST(sum(n) AS BIGINT) FROM s
        WHERE audience <> 'everyone' AND series <> 'All'
        GROUP BY audience, series HAVING sum(n) > 0
        UNION ALL
        SELECT 'everyone', 'weight', word, NULL, n FROM (
          SELECT * FROM ({frequency('posts', 'tweet')}) ORDER BY n DESC, word LIMIT {TOP_WORDS})"""
    both = " UNION ALL ".join([
        "SELECT 'everyone' AS audience, \"dateTweet\", tweet FROM posts",
        f"SELECT 'press', \"dateTweet\", tweet FROM posts WHERE {in_segment('MACHINERY')}"])
    sql["dashboard_all_points"] = f"""WITH {POSTS}, {series_sql(both, TRACK_50)}
        SELECT audience, 'series' AS part, series AS name, ts, n FROM s
        UNION ALL
        SELECT audience, 'weight', series, NULL, CAST(sum(n) AS BIGINT) FROM s
        WHERE audience <> 'everyone' AND series <> 'All'
        GROUP BY audience, series HAVING sum(n) > 0
        UNION ALL
        SELECT 'everyone', 'weight', word, NULL, n FROM (
          SELECT * FROM ({frequency('posts', 'tweet')}) ORDER BY n DESC, word LIMIT {TOP_WORDS})"""
    return sql
