"""Signal rules, source health, text and retrieval queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bizlens.functions.textual import JUNK_TITLE, LEGAL_FORMS, MOJIBAKE, content_hash
from bizlens.operators.ordering import feed
from bizlens.operators.quality import citation_check
from bizlens.plans import signals, text
from bizlens.registry.base_sql import dbl, sql
from bizlens.registry.common import q
from bizlens.sources.sinks import ingest_unique
from bizlens.sources.warehouse import Warehouse

KEYWORDS = ["worthless", "guarantee", "the and"]


def _signals(w: Warehouse):
    """One signal per rule and entity, with its first day and strength."""
    g = signals.convergence(w.mentions()).groupBy("rule", "entity").agg(
        F.min("window_end").alias("day"), F.max(F.col("n_sources") * 10 + F.col("n_buckets")).alias("strength"))
    return g.withColumn("signal_id", F.concat_ws("-", "rule", F.col("entity").cast("string")))


def _watchlist(w: Warehouse):
    return w.table("customer").select(
        F.col("c_nationkey").alias("customer"), F.col("c_custkey").alias("entity"), (F.col("c_custkey") % 5 + 1).alias("weight"))


def _ranked(w: Warehouse):
    return signals.rank(_signals(w), _watchlist(w), 3)


def _evidence(w: Warehouse):
    m = w.table("events").filter("event_type in ('error', 'purchase')").select(
        F.col("user_id").alias("entity"), F.col("event_id").alias("evidence_id"), "ts", F.col("props").alias("quote"))
    return m.join(_signals(w).select("entity", "signal_id"), "entity").drop("entity")


def _with_evidence(w: Warehouse):
    s = _signals(w)
    return signals.with_evidence(s.select("signal_id", "rule", "day"), _evidence(w), s.select("signal_id", "entity"))


def _evidence_rows(w: Warehouse):
    s = _signals(w)
    return signals.evidence_rows(s, _evidence(w), s.select("signal_id", "entity"))


def _state(w: Warehouse):
    ranked = _ranked(w).select("customer", "signal_id", "position")
    seen = ranked.filter("position = 1").select("customer", "signal_id", F.lit("approved").alias("state"))
    return signals.with_state(ranked, seen)


def _runs(w: Warehouse):
    e = w.table("events")
    return e.select(F.col("event_type").alias("source"), F.col("event_id").alias("run_id"), "ts", F.when(F.col("value") < 1, "failed").otherwise("ok").alias("status"))


def _health(w: Warehouse):
    runs = _runs(w)
    out = signals.source_health(runs, runs.agg(F.max("ts")).scalar(), 1)
    return out.select("source", "runs", "failures", "last_status", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"), F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "silent")


def _prices(w: Warehouse):
    daily = w.mentions().groupBy("source", "day").agg((F.sum("value").cast("double") / F.count(F.lit(1)).cast("double")).alias("price"))
    out = signals.trend_break(daily, ["source"], "day", "price", 14, 1.5)
    return out.select("source", "day", F.round("price", 6).alias("price"), F.round("base_mean", 6).alias("base_mean"), "base_n", F.round("z", 5).alias("z"))


def _pages(w: Warehouse):
    html = F.col("html")
    return w.table("pages").select(
        "page_id", text.title_of("html").alias("title"), F.regexp_extract(html, r'<html[^>]*lang="([a-z]+)"', 1).alias("lang"),
        text.host_of("url").alias("host"))


def _labels_of_hosts(w: Warehouse):
    return _pages(w).select(F.regexp_extract("host", r"^(?:www\.|m\.)?([^.]+)", 1).alias("name"))


def _gazetteer(w: Warehouse):
    words = w.table("benchmark").select("item_id", F.explode(F.array_distinct(text.tokens("text"))).alias("term"))
    g = words.groupBy("term").agg(F.count(F.lit(1)).alias("items"), F.min("item_id").alias("entity"))
    return g.select("term", "entity"), g.filter("items > 1").select("term")


def _tagged(w: Warehouse):
    terms, stop = _gazetteer(w)
    return text.tag_entities(w.documents(), "doc_id", "text", terms, stop)


def _nearest(w: Warehouse):
    corpus = w.table("embeddings")
    probe = corpus.orderBy("vec_id").limit(1).select("embedding").first()
    return text.topk_cosine(corpus, probe[0], 10)


def _nearest_by_label(w: Warehouse):
    corpus = w.table("embeddings")
    queries = corpus.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return text.topk_cosine_many(queries, corpus, 5)


def _uncited(w: Warehouse):
    """Citations of labelled documents that no page carries."""
    claims = w.table("labels").select("doc_id", F.col("doc_id").alias("page_id"))
    return citation_check(claims, w.table("pages"), "page_id")


CONV = """, seen AS (SELECT DISTINCT entity, source, bucket, day FROM mentions),
        win AS (SELECT entity, CAST(day + CAST(i AS INTEGER) AS DATE) AS window_end, source, bucket FROM seen, range(7) x(i)),
        conv AS (SELECT entity, window_end, count(DISTINCT source) AS n_sources, count(DISTINCT bucket) AS n_buckets, CASE WHEN count(DISTINCT bucket) >= 2 THEN 'convergence' ELSE 'weak_signal' END AS rule
                 FROM win GROUP BY 1, 2 HAVING count(DISTINCT source) >= 3),
        sig AS (SELECT rule, entity, min(window_end) AS day, max(n_sources * 10 + n_buckets) AS strength, rule || '-' || CAST(entity AS VARCHAR) AS signal_id FROM conv GROUP BY 1, 2)"""
RANKED = CONV + """, ranked AS (SELECT * FROM (SELECT sig.*, c_nationkey AS customer, c_custkey % 5 + 1 AS weight, (c_custkey % 5 + 1) * strength AS rank_score,
            CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 5 + 1) * strength DESC, signal_id) AS INTEGER) AS position FROM sig JOIN customer ON c_custkey = entity) WHERE position <= 3)"""
DAILY = ", daily AS (SELECT entity, day, count(*) AS n FROM mentions GROUP BY 1, 2)"
ANOMALY = DAILY + """, a AS (SELECT entity, day, CAST(sum(n) OVER recent AS BIGINT) AS week_count, coalesce(sum(n) OVER base, 0) AS s, coalesce(sum(n * n) OVER base, 0) AS q, date_diff('day', min(day) OVER (PARTITION BY entity), day) AS h
            FROM daily WINDOW recent AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), base AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING)),
        b AS (SELECT *, CAST(s AS DOUBLE) / 14 AS m, sqrt(greatest((CAST(q AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / 14) / 13, 0) * 7) AS sd FROM a),
        anomaly AS (SELECT entity, day, week_count, round(m * 7, 6) AS expected, round((week_count - m * 7) / nullif(sd, 0), 6) AS z FROM b WHERE h >= 20 AND round((week_count - m * 7) / nullif(sd, 0), 6) > 2)"""
FIRST = """, fm AS (SELECT entity, min(day) FILTER (WHERE tier = 'niche') AS first_niche, min(day) FILTER (WHERE tier = 'mainstream') AS first_mainstream FROM mentions GROUP BY 1)"""
GEO = """, geo AS (SELECT entity, min(ts) FILTER (WHERE region = 'CN') AS a, min(ts) FILTER (WHERE region = 'EU') AS b, min(ts) FILTER (WHERE region = 'US') AS c FROM mentions GROUP BY 1)"""
RUNS = """WITH runs AS (SELECT event_type AS source, event_id AS run_id, ts, CASE WHEN value < 1 THEN 'failed' ELSE 'ok' END AS status FROM events)"""
WORDS = r"[x for x in regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+') if length(x) > 0]"
TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
MOJI = "title"
for _broken, _fixed in MOJIBAKE.items():
    MOJI = f"replace({MOJI}, '{_broken}', '{_fixed}')"
TITLES = rf"""WITH RECURSIVE p AS (SELECT page_id, {TITLE} AS title FROM pages),
        w AS (SELECT page_id, title, list_sort(list_distinct({WORDS.format('title')})) AS ws FROM p),
        s AS (SELECT page_id, array_to_string(ws, ' ') AS sig FROM w WHERE len(ws) > 0
              UNION SELECT page_id, unnest([array_to_string([x for x in ws if x <> y], ' ') for y in ws]) FROM w WHERE len(ws) > 2),
        e AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM s a JOIN s b ON a.sig = b.sig AND a.sig <> ''),
        reach(n, r) AS (SELECT page_id, page_id FROM p UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.r),
        root AS (SELECT n, min(r) AS first FROM reach GROUP BY 1),
        near AS (SELECT a.page_id, a.title, CASE WHEN len(a.ws) = 0 THEN a.page_id
                   WHEN CAST(len(list_intersect(a.ws, b.ws)) AS DOUBLE) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.5 THEN first ELSE min(a.page_id) OVER (PARTITION BY a.ws) END AS cluster
                 FROM w a JOIN root ON n = a.page_id JOIN w b ON b.page_id = first)
        SELECT page_id, title, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM near"""
HOSTS = rf"""WITH RECURSIVE h AS (SELECT regexp_extract(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^(?:www\.|m\.)?([^.]+)', 1) AS name FROM pages),
        c AS (SELECT name, count(*) AS mentions, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(name), '{LEGAL_FORMS}', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ''), lower(name)) AS norm FROM h GROUP BY name),
        f AS (SELECT DISTINCT norm FROM c),
        s AS (SELECT norm, norm AS sig FROM f UNION SELECT norm, substr(norm, 1, CAST(i AS INTEGER) - 1) || substr(norm, CAST(i AS INTEGER) + 1) FROM f, range(1, 200) x(i) WHERE length(norm) >= 5 AND i <= length(norm) AND NOT regexp_matches(substr(norm, CAST(i AS INTEGER), 1), '[0-9]')),
        e AS (SELECT DISTINCT a.norm AS a, b.norm AS b FROM s a JOIN s b ON a.sig = b.sig),
        reach(n, r) AS (SELECT norm, norm FROM f UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.r),
        root AS (SELECT n, min(r) AS g FROM reach GROUP BY 1),
        b AS (SELECT *, first_value(name) OVER x AS best, first_value(norm) OVER x AS best_norm, first_value(name) OVER (PARTITION BY norm ORDER BY mentions DESC, name DESC) AS own
              FROM c JOIN root ON n = norm WINDOW x AS (PARTITION BY g ORDER BY mentions DESC, name DESC))
        SELECT name, CASE WHEN 1 - CAST(levenshtein(norm, best_norm) AS DOUBLE) / greatest(length(norm), length(best_norm)) >= 0.75 THEN best ELSE own END AS canonical, mentions FROM b"""
TITLE_SETS = rf"""WITH RECURSIVE p AS (SELECT page_id, {TITLE} AS title FROM pages),
        w AS (SELECT page_id, title, list_sort(list_distinct({WORDS.format('title')})) AS ws FROM p),
        d AS (SELECT ws, min(page_id) AS node FROM w WHERE len(ws) > 0 GROUP BY ws),
        e AS (SELECT a.node AS a, b.node AS b FROM d a JOIN d b ON a.node < b.node
              AND 100 * len(list_intersect(a.ws, b.ws)) >= {{pct}} * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
        ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(n, r) AS (SELECT node, node FROM d UNION SELECT reach.n, ee.b FROM reach JOIN ee ON ee.a = reach.r),
        root AS (SELECT n, min(r) AS g FROM reach GROUP BY n),
        c AS (SELECT w.page_id, w.title, coalesce(root.g, w.page_id) AS cluster FROM w LEFT JOIN d ON d.ws = w.ws LEFT JOIN root ON root.n = d.node)
        SELECT page_id, title, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM c"""
NAME_EDITS = rf"""WITH RECURSIVE h AS (SELECT regexp_extract(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^(?:www\.|m\.)?([^.]+)', 1) AS name FROM pages),
        c AS (SELECT name, count(*) AS mentions, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(name), '{LEGAL_FORMS}', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ''), lower(name)) AS norm FROM h WHERE name IS NOT NULL GROUP BY name),
        f AS (SELECT DISTINCT norm FROM c),
        e AS (SELECT a.norm AS a, b.norm AS b FROM f a JOIN f b ON a.norm < b.norm AND 100 * levenshtein(a.norm, b.norm) <= 25 * greatest(length(a.norm), length(b.norm))),
        ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(n, r) AS (SELECT norm, norm FROM f UNION SELECT reach.n, ee.b FROM reach JOIN ee ON ee.a = reach.r),
        root AS (SELECT n, min(r) AS g FROM reach GROUP BY n)
        SELECT name, first_value(name) OVER (PARTITION BY g ORDER BY mentions DESC, name DESC) AS canonical, mentions FROM c JOIN root ON n = norm"""
COS = "round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"

QUERIES = {
    # -- rules --------------------------------------------------------------------------------------
    "signals_convergence": (q(lambda w: signals.convergence(w.mentions())), sql("mentions", CONV + " SELECT * FROM conv")),
    "signals_daily_z": (q(lambda w: signals.daily_z(w.mentions(), 14).withColumns({c: F.round(c, 6) for c in ("base_mean", "base_std", "z")})), sql("mentions", DAILY + """
        , b AS (SELECT *, CAST(coalesce(sum(n) OVER w, 0) AS DOUBLE) AS s, CAST(coalesce(sum(n * n) OVER w, 0) AS DOUBLE) AS q, CAST(date_diff('day', min(day) OVER (PARTITION BY entity), day) AS INTEGER) AS history_days
               FROM daily WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
        c AS (SELECT *, s / 14 AS m, sqrt(greatest((q - s * s / 14) / 13, 0)) AS sd FROM b)
        SELECT entity, day, n, history_days, round(m, 6) AS base_mean, round(sd, 6) AS base_std, round((n - m) / nullif(sd, 0), 6) AS z FROM c""")),
    "signals_anomaly": (q(lambda w: signals.anomaly(w.mentions(), 14)), sql("mentions", ANOMALY + " SELECT * FROM anomaly")),
    "signals_first_mover": (q(lambda w: signals.first_mover(w.mentions(), 1)), sql("mentions", FIRST + """
        SELECT *, CAST(date_diff('day', first_niche, first_mainstream) AS INTEGER) AS lead_days FROM fm WHERE date_diff('day', first_niche, first_mainstream) >= 1""")),
    "signals_geo_spread": (q(lambda w: signals.geo_spread(w.mentions()).select("entity", F.to_date("first_cn").alias("cn"), F.to_date("first_us").alias("us"))), sql("mentions", GEO + """
        SELECT entity, CAST(a AS DATE) AS cn, CAST(c AS DATE) AS us FROM geo WHERE a < b AND b < c""")),
    "signals_run": (q(lambda w: signals.run(w.mentions(), 14)[0]), sql("mentions", CONV + ANOMALY + FIRST + GEO + """
        SELECT rule, entity, day FROM sig UNION ALL SELECT 'anomaly', entity, min(day) FROM anomaly GROUP BY entity
        UNION ALL SELECT 'first_mover', entity, first_mainstream FROM fm WHERE date_diff('day', first_niche, first_mainstream) >= 14 UNION ALL SELECT 'geo_spread', entity, CAST(c AS DATE) FROM geo WHERE a < b AND b < c""")),
    "signals_suppressed": (q(lambda w: signals.run(w.mentions(), 30)[1]), sql("mentions", """
        SELECT 'anomaly' AS rule, 'not enough history' AS reason FROM mentions HAVING date_diff('day', min(day), max(day)) < 36""")),
    "signals_new_per_day": (q(lambda w: signals.new_per_day(_signals(w))), sql("mentions", CONV + " SELECT day, rule, count(*) AS signals FROM sig GROUP BY ALL")),
    "signals_trend_break": (q(_prices), sql("mentions", f"""
        , d AS (SELECT source, day, {dbl('sum(value)')} / count(*) AS price FROM mentions GROUP BY ALL),
        z AS (SELECT *, avg(price) OVER w AS m, stddev_samp(price) OVER w AS sd, count(price) OVER w AS base_n FROM d WINDOW w AS (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
        SELECT source, day, round(price, 6) AS price, round(m, 6) AS base_mean, base_n, round((price - m) / nullif(sd, 0), 5) AS z FROM z WHERE abs((price - m) / nullif(sd, 0)) > 1.5""".strip())),
    # -- ranking, evidence, triage ----------------------------------------------------------------------
    "signals_ranked": (q(lambda w: _ranked(w).select("customer", "signal_id", "rank_score", "position")), sql("mentions", RANKED + " SELECT customer, signal_id, rank_score, position FROM ranked")),
    "signals_digest": (q(lambda w: signals.digest(_ranked(w), dt.date(2024, 1, 1)).select("customer", "signal_id", "day")), sql("mentions", RANKED + " SELECT customer, signal_id, day FROM ranked WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-07'")),
    "signals_state": (q(_state), sql("mentions", RANKED + " SELECT customer, signal_id, position, CASE WHEN position = 1 THEN 'approved' ELSE 'open' END AS state FROM ranked")),
    "signals_with_evidence": (q(_with_evidence), sql("mentions", CONV + """
        , ev AS (SELECT signal_id, event_id, ts, props FROM events JOIN sig ON entity = user_id WHERE event_type IN ('error', 'purchase')),
        g AS (SELECT signal_id, count(*) AS n, min_by(props, (ts, event_id)) AS fq FROM ev GROUP BY 1)
        SELECT sig.signal_id, rule, day, coalesce(n, 0) AS n_evidence, fq AS first_quote, CAST(1 AS BIGINT) AS n_entities, entity AS first_entity FROM sig LEFT JOIN g ON g.signal_id = sig.signal_id""")),
    "signals_evidence_rows": (q(_evidence_rows), sql("mentions", CONV + """
        SELECT signal_id, 'evidence' AS kind, props AS value FROM events JOIN sig ON entity = user_id WHERE event_type IN ('error', 'purchase')
        UNION ALL SELECT signal_id, 'entity', CAST(entity AS VARCHAR) FROM sig""")),
    "entity_timeline": (q(lambda w: signals.entity_timeline(w.mentions(), [1, 2, 3], dt.date(2024, 1, 30))), sql("mentions", """
        , s AS (SELECT CAST(e AS INTEGER) AS entity, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(1, 4) a(e), range(30) b(i))
        SELECT s.entity, s.day, count(mention_id) AS n, count(DISTINCT source) AS n_sources FROM s LEFT JOIN mentions m ON m.entity = s.entity AND m.day = s.day GROUP BY ALL""".strip())),
    "citation_check": (q(_uncited), "SELECT doc_id, doc_id AS page_id FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)"),
    # -- sources and feeds ------------------------------------------------------------------------------
    "source_health": (q(_health), RUNS + """
        SELECT source, count(*) AS runs, count(*) FILTER (WHERE status <> 'ok') AS failures, max_by(status, (ts, run_id)) AS last_status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run,
               strftime(max(ts) FILTER (WHERE status = 'ok'), '%Y-%m-%d %H:%M:%S') AS last_success,
               date_sub('second', max(ts) FILTER (WHERE status = 'ok'), (SELECT max(ts) FROM runs)) / 3600.0 > 1 AS silent FROM runs GROUP BY source"""),
    "source_run_history": (q(lambda w: signals.run_history(_runs(w), 10).select("source", "run_id", "status", "recency")), RUNS + """
        SELECT source, run_id, status, CAST(rn AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, run_id DESC) AS rn FROM runs) WHERE rn <= 10"""),
    "diverse_feed": (q(lambda w: signals.feed(w.mentions(), size=12, cap=3).select("mention_id", "source", "turn")), sql("mentions", """
        , pool AS (SELECT * FROM mentions ORDER BY ts DESC, mention_id DESC LIMIT 48), d AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY ts DESC, mention_id DESC) AS INTEGER) AS turn FROM pool)
        SELECT mention_id, source, turn FROM d WHERE turn <= 3 ORDER BY turn, ts DESC, mention_id DESC LIMIT 12""".strip())),
    "paged_feed": (q(lambda w: feed(w.mentions(), F.col("bucket") == "deal", [F.col("ts").desc(), F.col("mention_id").desc()], page=2, size=20).select("mention_id", "source")), sql("mentions", """
        SELECT mention_id, source FROM mentions WHERE bucket = 'deal' ORDER BY ts DESC, mention_id DESC LIMIT 20 OFFSET 40""")),
    # -- text -------------------------------------------------------------------------------------------
    "text_clean": (q(lambda w: text.clean(_pages(w)).select("page_id", "title", "lang")), rf"""
        SELECT page_id, {MOJI} AS title, CASE WHEN regexp_matches({MOJI}, '\p{{Cyrillic}}') AND lang = 'en' THEN 'uk' ELSE lang END AS lang
        FROM (SELECT page_id, {TITLE} AS title, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang FROM pages) WHERE NOT regexp_matches(title, '{JUNK_TITLE}')"""),
    "text_title_clusters": (q(lambda w: text.cluster_titles(_pages(w), "page_id", "title")), TITLES),
    "text_resolved_hosts": (q(lambda w: text.resolve_entities(_labels_of_hosts(w), "name")), HOSTS),
    "text_title_jaccard_50": (q(lambda w: text.cluster_titles_jaccard(_pages(w), "page_id", "title", 50)), TITLE_SETS.replace("{pct}", "50")),
    "text_title_jaccard_80": (q(lambda w: text.cluster_titles_jaccard(_pages(w), "page_id", "title", 80)), TITLE_SETS.replace("{pct}", "80")),
    "text_hosts_edit_join": (q(lambda w: text.resolve_names_edit(_labels_of_hosts(w), "name", 75)), NAME_EDITS),
    "text_entity_tags": (q(_tagged), f"""WITH g AS (SELECT term, min(item_id) AS entity, count(*) AS items FROM (SELECT item_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark) GROUP BY 1),
        t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents)
        SELECT doc_id, term, any_value(entity) AS entity, count(*) AS hits FROM t JOIN g USING (term) WHERE items <= 1 GROUP BY doc_id, term"""),
    "text_keyword_search": (q(lambda w: text.keyword_search(w.documents(), KEYWORDS, ["text"]).select("doc_id", "lang")), f"""
        SELECT doc_id, lang FROM documents WHERE {' OR '.join(f"text ILIKE '%{k}%'" for k in KEYWORDS)}"""),
    "text_unique_ingest": (q(lambda w: ingest_unique(w.documents(), ["text"], "doc_id").select("doc_id", "content_hash")), """
        SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text"""),
    "text_reingest_new": (q(lambda w: ingest_unique(w.documents(), ["text"], "doc_id", w.documents().filter("lang <> 'fr'").select(content_hash("text").alias("content_hash"))).select("doc_id", "lang")), """
        SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text) AND text NOT IN (SELECT text FROM documents WHERE lang <> 'fr')"""),
    "vector_topk": (q(_nearest), f"""
        SELECT c.vec_id, {COS} AS similarity FROM embeddings c, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY similarity DESC, vec_id LIMIT 10"""),
    "vector_topk_by_label": (q(_nearest_by_label), f"""WITH q AS (SELECT label AS query_id, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1)
        SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, c.vec_id, {COS} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, c.vec_id) AS rank FROM embeddings c, q) WHERE rank <= 5"""),
}
