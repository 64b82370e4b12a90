"""Queries on web pages and on event streams, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingora.operators import pages as P
from lingora.operators import segments as S
from lingora.operators.runs import url_parts
from lingora.plans.language import _detect_sql
from lingora.session import table
from lingora.streaming import observer as O
from lingora.streaming import timers

_TAG = r"""<[^''">]*(?:''[^'']*''[^''">]*|"[^"]*"[^''">]*)*>([^<]*)"""
_TRIM = r"regexp_replace(t, '^[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g')"


def html_text_segments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(S.html_texts(F.col("html"))).alias("idx", "text"))


def html_attr_segments(spark, sf_dir):
    """Readable attributes; the link targets of pages stand in as a second set, for the pages have few others."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(S.html_attrs(F.replace("html", F.lit(" href="), F.lit(" title=")))).alias("idx", "a")).select("page_id", "idx", "a.name", "a.value")


def _groups(spark, sf_dir):
    return P.text_groups(P.nodes(table(spark, sf_dir, "pages")))


def page_text_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("page_id", "group_idx", "block", "text", F.size("fragments").alias("n_fragments"))


def page_language_groups(spark, sf_dir):
    return P.languages(_groups(spark, sf_dir), "zh").groupBy("page_id", "lang").agg(F.count("*").alias("groups"), F.sum(F.length("text")).alias("chars"))


#: A caller's own attributes, for pages have none of the usual ones.
RULES = {"a": ["href", "title"], "meta": ["charset"], "*": ["class", "lang"]}


def page_attributes(spark, sf_dir):
    return P.nodes(table(spark, sf_dir, "pages"), RULES, ignored_classes=["none"]).where("kind <> 'text'").select("page_id", "pos", "kind", "name", "text")


def adaptive_batches(spark, sf_dir):
    """Batches of the text segments of pages."""
    return P.batches(html_text_segments(spark, sf_dir), ["page_id"], ["idx"]).select("page_id", "idx", "batch_size", "batch")


def viewport_order(spark, sf_dir):
    """Text segments of pages, every third of them in view, in the order in which they are translated."""
    rows = html_text_segments(spark, sf_dir).withColumn("visible", F.col("idx") % 3 == 1)
    return P.visible_first(rows, ["page_id"], "idx").select("page_id", "idx", "place")


def fragment_split(spark, sf_dir):
    """Groups marked, put in upper case, and split back at the markers and without them."""
    g = _groups(spark, sf_dir)
    f = F.col("fragments")
    at_markers = P.split_back(F.upper(P.marked(f)), f)
    by_share = P.split_back(F.upper("text"), f)
    plain = F.transform(f, lambda x: F.upper(x["text"]))
    return g.select("page_id", "group_idx", (at_markers == plain).alias("same"), (F.array_join(by_share, "") == F.upper("text")).alias("whole"), F.size(by_share).alias("parts"))


def page_urls(spark, sf_dir):
    """Addresses in the texts and targets of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(url_parts(F.concat_ws(" ", "url", "html"))).alias("p")).where("p.kind = 'url'").groupBy(F.col("p.value").alias("url")).agg(F.count("*").alias("n"))


def event_debounce(spark, sf_dir):
    """Bursts of events of a user, ended by 30 minutes of quiet."""
    return O.debounce(table(spark, sf_dir, "events"), ["user_id"], "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def event_bursts(spark, sf_dir):
    """Bursts of events of a user with the kinds that wait in them, ended by 30 minutes of quiet."""
    got = timers.bursts(table(spark, sf_dir, "events"), "user_id", "event_type", 1_800_000)
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n", F.array_join("items", ",").alias("items"))


def cache_ttl_hits(spark, sf_dir):
    """Events as requests of (user, type) to a cache whose values live for an hour from their set."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("seq"))
    return O.ttl_hits(e, ["user_id", "event_type"], 3600).select("seq", "hit")


def echo_suppression(spark, sf_dir):
    """Views that do not follow within half an hour a click of the same user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return O.suppressed(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", 1_800_000)


_NAMED = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _unescaped_sql(text: str) -> str:
    """The named characters; pages have no numbered ones."""
    for name, letter in P.ENTITIES.items():
        text = f"replace({text}, '&{name};', '{letter.replace(chr(39), chr(39) * 2)}')"
    return text


_QUOTED = P.TOKEN.replace("'", "''")
_GIVEN = P._ATTRIBUTE.replace("'", "''")
_BARE = """regexp_replace(z[2], '^["'']|["'']$', '', 'g')"""
_INSIDE = r"regexp_replace(regexp_replace(token, '^<[^\s/>]+', ''), '/?>$', '')"
_RULES_SQL = f"list_distinct(list_concat({RULES['*']!r}, CASE name " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in RULES.items() if k != "*") + " ELSE [] END))"
#: Nesting by running depths, as rows: see operators/pages.py.
_NODES = rf"""tok AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '{_QUOTED}')) AS token, unnest(range(len(regexp_extract_all(coalesce(html, ''), '{_QUOTED}')))) AS "at" FROM pages),
kinds AS (SELECT *, CASE WHEN regexp_matches(token, '(?is)^<(script|style)\b.*</(script|style)\s*>$') THEN 'raw' WHEN regexp_matches(token, '^</[A-Za-z]') THEN 'close' WHEN regexp_matches(token, '^<[A-Za-z]') AND token LIKE '%>' THEN 'open'
    WHEN regexp_matches(token, '^<[!?/]') THEN 'other' ELSE 'text' END AS kind FROM tok),
tags AS (SELECT *, CASE WHEN kind IN ('open', 'close', 'raw') THEN lower(regexp_extract(token, '^</?([^\s/>]+)', 1)) END AS name,
    CASE WHEN kind = 'open' THEN list_transform(list_zip(regexp_extract_all({_INSIDE}, '{_GIVEN}', 1), regexp_extract_all({_INSIDE}, '{_GIVEN}', 2)), lambda z: {{'name': lower(z[1]), 'value': {_unescaped_sql(_BARE)}}}) END AS given FROM kinds),
flags AS (SELECT *, kind = 'open' AND name NOT IN {_NAMED(P.VOID)} AND token NOT LIKE '%/>' AS begins, coalesce(name IN {_NAMED(P.BLOCKS)}, false) AS is_block,
    kind = 'open' AND coalesce(name IN {_NAMED(P.IGNORED)} OR len(list_filter(given, lambda g: g.name = 'data-no-translate' OR (g.name = 'translate' AND g.value = 'no'))) > 0, false) AS self_off,
    count(*) FILTER (kind IN ('open', 'raw')) OVER (PARTITION BY page_id ORDER BY "at") AS serial FROM tags),
sums AS (SELECT *, sum(CASE WHEN begins THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, name ORDER BY "at") AS s FROM flags),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id, name ORDER BY "at")) AS low FROM sums),
strays AS (SELECT *, kind = 'close' AND low < coalesce(lag(low) OVER (PARTITION BY page_id, name ORDER BY "at"), 0) AS stray FROM lows),
levels AS (SELECT *, CASE WHEN begins THEN s - low WHEN kind = 'close' AND NOT stray THEN s - low + 1 END AS level FROM strays),
ends AS (SELECT *, CASE WHEN begins THEN lead("at") OVER (PARTITION BY page_id, name, level ORDER BY "at") END AS own FROM levels),
around AS (SELECT *, sum(CASE WHEN own IS NOT NULL THEN 1 WHEN kind = 'close' AND NOT stray THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY "at") AS depth_ FROM ends),
closed AS (SELECT *, CASE WHEN begins THEN coalesce(own, CASE WHEN depth_ > 0 THEN last_value(own IGNORE NULLS) OVER (PARTITION BY page_id, CASE WHEN begins THEN depth_ END ORDER BY "at") END) END AS ending FROM around),
events AS (SELECT *, unnest(CASE WHEN begins AND (is_block OR self_off) AND ending IS NOT NULL THEN [1, -1] ELSE [1] END) AS phase FROM closed),
timed AS (SELECT *, CASE WHEN phase = 1 THEN "at" ELSE ending END AS moment FROM events),
measured AS (SELECT *, sum(CASE WHEN begins AND self_off THEN phase ELSE 0 END) OVER w AS off, sum(CASE WHEN begins AND is_block THEN phase ELSE 0 END) OVER w AS depth,
    count(*) FILTER (phase = 1 AND is_block AND kind IN ('open', 'close')) OVER w AS edges FROM timed WINDOW w AS (PARTITION BY page_id ORDER BY moment, phase RANGE UNBOUNDED PRECEDING)),
placed AS (SELECT *, CASE WHEN depth > 0 THEN last_value(CASE WHEN phase = 1 AND begins AND is_block THEN name || '#' || serial END IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY moment, phase) ELSE 'body#0' END AS block FROM measured),
texts AS (SELECT *, {_unescaped_sql('token')} AS text FROM placed WHERE phase = 1 AND kind = 'text' AND off = 0),
nodes AS (SELECT *, (edges > coalesce(lag(edges) OVER w, -1))::INT AS boundary, lag(block) OVER w AS before FROM texts WHERE regexp_matches(text, '[^\s\x0B\x1C-\x1F\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') WINDOW w AS (PARTITION BY page_id ORDER BY "at")),
islands AS (SELECT *, sum((boundary = 1 OR before <> block)::INT) OVER (PARTITION BY page_id ORDER BY "at") AS group_idx FROM nodes),
groups AS (SELECT page_id, group_idx::BIGINT AS group_idx, any_value(block) AS block, string_agg(text, '' ORDER BY "at") AS text, count(*)::INT AS n_fragments FROM islands GROUP BY page_id, group_idx),
asked AS (SELECT *, {_RULES_SQL} AS wanted FROM placed WHERE phase = 1 AND kind = 'open' AND off = 0 AND NOT self_off),
found AS (SELECT page_id, "at", unnest(wanted) AS name, unnest(range(len(wanted))) AS nth, unnest(list_transform(wanted, lambda w: list_filter(given, lambda g: g.name = w)[-1].value)) AS text FROM asked),
listed AS (SELECT page_id, "at", 0 AS nth, 'text' AS kind, '' AS name, text FROM nodes UNION ALL SELECT page_id, "at", nth, 'attribute', name, text FROM found WHERE trim(coalesce(text, '')) <> '')"""
QUERIES = {
    "html_text_segments": html_text_segments, "html_attr_segments": html_attr_segments, "page_text_groups": page_text_groups, "page_language_groups": page_language_groups,
    "page_attributes": page_attributes, "adaptive_batches": adaptive_batches, "viewport_order": viewport_order, "fragment_split": fragment_split, "page_urls": page_urls, "event_debounce": event_debounce, "event_bursts": event_bursts,
    "cache_ttl_hits": cache_ttl_hits, "echo_suppression": echo_suppression,
}
_SEGMENTS = f"""x AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '{_TAG}', 1), lambda t: {_TRIM}), lambda t: t <> '') AS ts FROM pages),
s AS (SELECT page_id, unnest(ts) AS text, unnest(range(len(ts)))::INT AS idx FROM x)"""
ORACLES = {
    "html_text_segments": f"WITH {_SEGMENTS} SELECT page_id, idx, text FROM s",
    "html_attr_segments": r"""
WITH h AS (SELECT page_id, replace(html, ' href=', ' title=') AS html FROM pages),
a AS (SELECT page_id, regexp_extract_all(html, '\s([\w-]+)=["'']([^"'']*)["'']', 1) AS ns, regexp_extract_all(html, '\s([\w-]+)=["'']([^"'']*)["'']', 2) AS vs FROM h),
f AS (SELECT page_id, list_filter(list_zip(ns, vs), lambda p: p[1] IN ('title', 'alt', 'placeholder', 'aria-label', 'label', 'tab') AND trim(p[2]) <> '') AS ps FROM a)
SELECT page_id, unnest(range(len(ps)))::INT AS idx, unnest(list_transform(ps, lambda p: p[1])) AS name, unnest(list_transform(ps, lambda p: p[2])) AS value FROM f""",
    "page_text_groups": f"WITH {_NODES} SELECT page_id, group_idx, block, text, n_fragments FROM groups",
    "fragment_split": f"WITH {_NODES} SELECT page_id, group_idx, true AS same, true AS whole, n_fragments AS parts FROM groups",
    "page_attributes": f"WITH {_NODES} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY \"at\", nth) - 1)::INT AS pos, kind, name, text FROM listed QUALIFY kind <> 'text'",
    "page_language_groups": f"""WITH {_NODES}, keyed AS (SELECT *, page_id || '/' || group_idx AS id FROM groups)
SELECT page_id, lang_detected AS lang, count(*) AS "groups", sum(length(text))::BIGINT AS chars FROM keyed JOIN {_detect_sql('keyed', 'id')} d ON d.id = keyed.id WHERE lang_detected <> 'zh' GROUP BY ALL""",
    "adaptive_batches": f"""WITH {_SEGMENTS}, z AS (SELECT *, avg(length(text)) OVER (PARTITION BY page_id) AS mean, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS k FROM s),
b AS (SELECT *, CASE WHEN mean < 20 THEN 20 WHEN mean < 100 THEN 10 ELSE 5 END AS batch_size FROM z) SELECT page_id, idx, batch_size, ((k - 1) // batch_size)::INT AS batch FROM b""",
    "viewport_order": f"WITH {_SEGMENTS} SELECT page_id, idx, (row_number() OVER (PARTITION BY page_id ORDER BY (idx % 3 = 1) DESC, idx) - 1)::INT AS place FROM s",
    "page_urls": r"""SELECT url, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url || ' ' || html, 'https?://[^\s<>"'']+')) AS url FROM pages) GROUP BY 1""",
    "event_debounce": """
WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_bursts": """
WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM s GROUP BY user_id, k""",
    "cache_ttl_hits": """
WITH RECURSIVE o AS (SELECT event_id AS seq, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT seq, user_id, event_type, k, ts AS set_at, false AS hit FROM o WHERE k = 1
  UNION ALL SELECT o.seq, o.user_id, o.event_type, o.k, CASE WHEN o.ts - set_at <= INTERVAL 1 HOUR THEN set_at ELSE o.ts END, o.ts - set_at <= INTERVAL 1 HOUR
  FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.k = r.k + 1)
SELECT seq, hit FROM r""",
    "echo_suppression": """
SELECT user_id, ts FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND c.ts <= v.ts
  AND epoch_ms(v.ts) - epoch_ms(c.ts) <= 1800000)""",
}
