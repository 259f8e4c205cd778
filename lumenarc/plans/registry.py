"""Registered queries of the archive engine, with their DuckDB equivalents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import analysis as A
from lumenarc.functions import media as M
from lumenarc.functions import text as T
from lumenarc.operators import catalog, comments, discovery, duplicates, history, hybrid, ingest, jobs, keyword, vectors, workqueue
from lumenarc.plans import views as V
from lumenarc.session import table
from lumenarc.sources.shared import kept, shared_dir
from lumenarc.streaming import items as live_queue
from lumenarc.streaming import passes

NOW = V.EPOCH + 500
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _now(seconds: int = NOW):
    return F.timestamp_seconds(F.lit(seconds))


def _now_sql(seconds: int = NOW) -> str:
    return f"epoch_ms({seconds}::BIGINT * 1000)"


# catalog

WANTED = catalog.Filters(type="image", site="src0", date_from=date(2026, 1, 2), date_to=date(2026, 1, 15))
_WANTED = "extension IN ('jpg', 'jpeg', 'png', 'webp') AND id IN (SELECT media_id FROM sources WHERE site = 'src0') AND created_at >= TIMESTAMP '2026-01-02' AND created_at < TIMESTAMP '2026-01-16'"


@_query(f"WITH {V.MEDIA}, {V.SOURCES} SELECT id, extension, epoch(created_at)::BIGINT AS created FROM media WHERE {_WANTED} ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of filtered media, newest first (the page is the feature)."""
    rows = catalog.page(catalog.newest_first(catalog.filtered(V.media(spark, d), WANTED, V.sources(spark, d))), 2, 50)
    return rows.select("id", "extension", F.unix_seconds("created_at").alias("created"))


@_query(f"WITH {V.MEDIA}, {V.SOURCES} SELECT count(*) AS n FROM media WHERE {_WANTED}")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered(V.media(spark, d), WANTED, V.sources(spark, d)).agg(F.count("*").alias("n"))


@_query(
    f"""WITH {V.MEDIA}, p AS (SELECT *, CASE processing_status WHEN 'READY' THEN 'ready' WHEN 'FAILED' THEN 'failed' ELSE 'processing' END AS g FROM media WHERE is_favorite)
SELECT 'dup_status' AS facet, v AS value, (SELECT count(*) FROM p WHERE dup_status = v AND processing_status = 'READY') AS n FROM (VALUES ('nondup'), ('dup'), ('unflagged')) t(v)
UNION ALL SELECT 'processing', v, (SELECT count(*) FROM p WHERE g = v AND dup_status = 'nondup') FROM (VALUES ('ready'), ('processing'), ('failed')) t(v)"""
)
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facets(V.media(spark, d), catalog.Filters(is_favorite=True, dup_status="nondup", processing_status="READY"))


@_query(f"WITH {V.SOURCES} SELECT media_id, arg_min(site, id) AS site FROM sources GROUP BY media_id")
def first_source(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_sources(V.sources(spark, d))


@_query(f"WITH {V.SOURCES} SELECT media_id, string_agg(site || ' ' || coalesce(chapter, ''), ' ' ORDER BY id) AS source_text FROM sources GROUP BY media_id")
def site_text(spark: SparkSession, d: str) -> DataFrame:
    return catalog.source_texts(V.sources(spark, d))


@_query(f"WITH {V.MEDIA}, {V.SOURCES} SELECT id FROM media WHERE id IN (SELECT media_id FROM sources WHERE site = 'src1') AND id IN (SELECT media_id FROM sources WHERE chapter = 'chapter-4')")
def site_and_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Site and chapter may be met by different sources."""
    return catalog.filtered(V.media(spark, d), catalog.Filters(site="src1", chapter="chapter-4"), V.sources(spark, d)).select("id")


@_query(f"WITH {V.MEDIA}, {V.ANALYSIS} SELECT id FROM media JOIN analysis ON id = media_id WHERE CASE WHEN json_valid(emotions) THEN list_contains(list_transform(from_json(emotions, '[\"VARCHAR\"]'), lambda x: lower(x)), 'joy') END")
def emotion_members(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered(V.media(spark, d), catalog.Filters(emotion="JOY"), None, V.analysis(spark, d)).select("id")


@_query(f"WITH {V.MEDIA} SELECT id, CASE WHEN dup_status = 'dup' THEN epoch(dup_flagged_at + INTERVAL 7 DAY)::BIGINT END AS expires FROM media")
def record_expiry(spark: SparkSession, d: str) -> DataFrame:
    return catalog.shaped(V.media(spark, d)).select("id", F.unix_seconds("dup_expires_at").alias("expires"))


@_query(f"WITH {V.MEDIA}, {V.SOURCES}, s AS (SELECT media_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM sources GROUP BY media_id), {V.ANALYSIS} SELECT m.id, n, ids, emotions FROM media m LEFT JOIN s ON m.id = s.media_id LEFT JOIN analysis a ON a.media_id = m.id")
def detail_records(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.details(V.media(spark, d), V.sources(spark, d), V.analysis(spark, d))
    return rows.select("id", F.size("sources").cast("long").alias("n"), F.array_join(F.transform("sources", lambda s: s["id"].cast("string")), ",").alias("ids"), "emotions")


@_query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@_query(f"WITH {V.MEDIA} SELECT id, CASE WHEN processing_status = 'READY' THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM media")
def patched_favorites(spark: SparkSession, d: str) -> DataFrame:
    m = V.media(spark, d)
    changes = m.where("processing_status = 'READY'").select("id", (~F.col("is_favorite")).alias("is_favorite"), F.lit("x").alias("sha256"))
    return catalog.patched(m, changes).select("id", "is_favorite")


@_query("SELECT doc_id, 1000 + row_number() OVER (ORDER BY doc_id) AS id FROM documents")
def allocated_ids(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_ids(table(spark, d, "documents").select("doc_id"), 1000, ["doc_id"]).select("doc_id", "id")


# duplicates


@_query(
    f"""WITH {V.MEDIA}, r AS (SELECT *, row_number() OVER w AS k, first_value(id) OVER w AS f FROM media WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, id))
SELECT id, CASE WHEN dup_status = 'unflagged' THEN 'unflagged' WHEN k = 1 THEN 'nondup' ELSE 'dup' END AS dup_status, CASE WHEN dup_status <> 'unflagged' AND k > 1 THEN f END AS dup_of_media_id,
  epoch(CASE WHEN dup_status <> 'unflagged' AND k > 1 THEN CASE WHEN dup_status = 'dup' THEN dup_flagged_at ELSE {_now_sql()} END END)::BIGINT AS flagged FROM r"""
)
def dup_flags(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.flagged(V.media(spark, d), _now()).select("id", "dup_status", "dup_of_media_id", F.unix_seconds("dup_flagged_at").alias("flagged"))


@_query(f"WITH {V.MEDIA}, g AS (SELECT * FROM media WHERE sha256 = (SELECT sha256 FROM media WHERE id = 3)) SELECT id, id = (SELECT arg_min(id, (created_at, id)) FROM g) AS is_retained FROM g WHERE id <> 3")
def dup_copies(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.copies(V.media(spark, d), 3).select("id", "is_retained")


_PURGE_NOW = V.EPOCH + 14 * 86400


@_query(
    f"""WITH {V.MEDIA}, o AS (SELECT *, coalesce(dup_status = 'dup' AND dup_flagged_at <= {_now_sql(_PURGE_NOW)} - INTERVAL 7 DAY, false) AS old FROM media),
c AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS total, count(*) FILTER (old) OVER (PARTITION BY sha256) AS olds, row_number() OVER (PARTITION BY sha256, old ORDER BY created_at, id) AS k FROM o)
SELECT id FROM c WHERE old AND (total > olds OR k > 1)"""
)
def safe_purge(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.purgeable(V.media(spark, d), _now(_PURGE_NOW)).select("id")


@_query(
    f"""WITH {V.MEDIA}, {V.SOURCES}, o AS (SELECT *, coalesce(dup_status = 'dup' AND dup_flagged_at <= {_now_sql(_PURGE_NOW)} - INTERVAL 7 DAY, false) AS old FROM media),
c AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS total, count(*) FILTER (old) OVER (PARTITION BY sha256) AS olds, row_number() OVER (PARTITION BY sha256, old ORDER BY created_at, id) AS k FROM o)
SELECT id, media_id FROM sources WHERE media_id NOT IN (SELECT id FROM c WHERE old AND (total > olds OR k > 1))"""
)
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.without(V.sources(spark, d), duplicates.purgeable(V.media(spark, d), _now(_PURGE_NOW))).select("id", "media_id")


@_query(f"WITH {V.MEDIA} SELECT id, CASE WHEN is_favorite AND dup_status = 'dup' THEN 'unflagged' ELSE dup_status END AS dup_status FROM media")
def unflagged_dups(spark: SparkSession, d: str) -> DataFrame:
    m = V.media(spark, d)
    return duplicates.unflagged(m, m.where("is_favorite").select("id")).select("id", "dup_status")


@_query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_texts(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.first_of(table(spark, d, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


# keyword search


_INDEXES: dict = {}


def _index(spark: SparkSession, d: str) -> keyword.Index:
    """The stored index of a folder's texts, in the shared folder under the folder's name, so that other applications find it.

    The first query of an application holds it against the table and heals it; later ones read it as it is.
    """
    key = (spark.sparkContext.applicationId, id(spark), d)
    if key not in _INDEXES:
        _INDEXES[key] = keyword.healed(V.texts(spark, d), keyword.folder_of(shared_dir(spark), d))
    return _INDEXES[key]


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


_ROUNDED = " SELECT id, round(score, 6) AS score FROM bm25"


@_query(f"WITH {V.TEXTS}, {V.bm25_sql(keyword.atoms('the by edons '))}{_ROUNDED}")
def bm25_all(spark: SparkSession, d: str) -> DataFrame:
    return _scored(keyword.bm25(_index(spark, d), "the by edons "))


@_query(f"WITH {V.TEXTS}, {V.bm25_sql([(('by', 'the'), False)])}{_ROUNDED}")
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _scored(keyword.bm25(_index(spark, d), '"by the"'))


@_query(f"WITH {V.TEXTS}, {V.bm25_sql([(('enthe',), True)])}{_ROUNDED}")
def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _scored(keyword.bm25(_index(spark, d), "enthe"))


@_query(f"WITH {V.EDITED}, {V.bm25_sql([(('the',), False), (('enthe',), True)])}{_ROUNDED}")
def bm25_after_edits(spark: SparkSession, d: str) -> DataFrame:
    """Rows changed, added and deleted after the index was built are one segment beside it; old segments stay as they are."""
    folder = keyword.fresh_folder(shared_dir(spark))
    keyword.stored(V.texts(spark, d), folder)
    return _scored(keyword.bm25(keyword.updated(V.edited(V.texts(spark, d)), folder), [(("the",), False), (("enthe",), True)]))


@_query(f"WITH {V.TEXTS}, {V.bm25_sql([(('src7',), False)], ('tags',))}{_ROUNDED}")
def bm25_column(spark: SparkSession, d: str) -> DataFrame:
    return _scored(keyword.bm25(_index(spark, d), '"src7"', ("tags",)))


@_query(f"WITH {V.TEXTS} SELECT id, 1.0::DOUBLE AS score FROM texts WHERE contains(lower(tags), 'rc1') AND contains(lower(tags), 'en')")
def tag_parts(spark: SparkSession, d: str) -> DataFrame:
    return keyword.containing(V.texts(spark, d), "rc1 EN", F.col("tags"))


@_query(f"WITH {V.TEXTS}, t AS (SELECT id, unnest({V.tokens_sql('description')}) AS term FROM texts) SELECT term, count(*) AS occurrences, count(DISTINCT id) AS rows FROM t GROUP BY term HAVING count(DISTINCT id) > 20")
def common_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of more than twenty rows, by the postings."""
    p = keyword.postings(V.texts(spark, d), ("description",))
    per = p.groupBy("term", "id").agg(F.count("*").alias("n")).groupBy("term")
    return per.agg(F.sum("n").alias("occurrences"), F.count("*").alias("rows")).where("rows > 20")


# vectors and fusion

_DOT = f"list_dot_product(embedding::DOUBLE[], {V.VECTOR!r}::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product({V.VECTOR!r}::DOUBLE[], {V.VECTOR!r}::DOUBLE[]))"


@_query(f"SELECT vec_id AS id, round({_DOT}, 6) AS cosine FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 100")
def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cosine_top(V.embedded(spark, d), V.VECTOR, 100).select("id", F.round("cosine", 6).alias("cosine"))


@_query(f"SELECT vec_id AS id, round({_DOT}, 6) AS cosine FROM embeddings WHERE label = 3 AND len(embedding) = 64")
def cosine_of_model(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cosine_top(V.embedded(spark, d), V.VECTOR, None, 3).select("id", F.round("cosine", 6).alias("cosine"))


def _norm(name: str) -> str:
    return f"{name}_n AS (SELECT id, CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE 1.0 END AS score FROM {name})"


_PARTS = f"""{V.TEXTS}, {V.bm25_sql(keyword.atoms('src3'), name='kw', limit=1000)}, {V.bm25_sql(keyword.atoms('src3'), ('tags',), 'tg', 1000)}, {V.bm25_sql(keyword.atoms('src3'), ('filename', 'source_text'), 'md', 1000)}, {_norm('kw')}, {_norm('tg')}, {_norm('md')}"""
_ALLOWED = f"{V.MEDIA}, allowed AS (SELECT id FROM media WHERE processing_status <> 'FAILED')"


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    return V.media(spark, d).where("processing_status <> 'FAILED'").select("id")


@_query(
    f"""WITH {_PARTS}, {_ALLOWED}, vc AS (SELECT vec_id AS id, least(1, greatest(0, (1 + {_DOT}) / 2)) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 1000),
u AS (SELECT id, 0.25 * score AS s FROM kw_n UNION ALL SELECT id, 0.5 * score FROM vc UNION ALL SELECT id, 0.2 * score FROM tg_n UNION ALL SELECT id, 0.05 * score FROM md_n)
SELECT id, round(sum(s), 6) AS score FROM u WHERE id IN (SELECT id FROM allowed) GROUP BY id HAVING sum(s) > 0"""
)
def hybrid_fused(spark: SparkSession, d: str) -> DataFrame:
    _, hits = hybrid.search(_index(spark, d), "src3", V.embedded(spark, d), V.VECTOR, _allowed(spark, d))
    return _scored(hits)


@_query(
    f"""WITH {_PARTS}, {_ALLOWED}, u AS (SELECT id, 0.5 * score AS s FROM kw_n UNION ALL SELECT id, 0.4 * score FROM tg_n UNION ALL SELECT id, 0.1 * score FROM md_n)
SELECT id, round(sum(s), 6) AS score FROM u WHERE id IN (SELECT id FROM allowed) GROUP BY id HAVING sum(s) > 0"""
)
def keyword_only(spark: SparkSession, d: str) -> DataFrame:
    _, hits = hybrid.search(_index(spark, d), "src3", allowed=_allowed(spark, d))
    return _scored(hits)


@_query(f"WITH {V.MEDIA} SELECT id, NULL::DOUBLE AS score FROM media WHERE processing_status <> 'FAILED'")
def filters_only(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.search(None, " ", allowed=_allowed(spark, d), media=V.media(spark, d))[1]


@_query(f"WITH {V.TEXTS}, {V.bm25_sql([(('enthe',), True)])} SELECT id, lag(id) OVER (ORDER BY score DESC, id) AS previous_id, lead(id) OVER (ORDER BY score DESC, id) AS next_id FROM bm25")
def result_neighbours(spark: SparkSession, d: str) -> DataFrame:
    hits = keyword.bm25(_index(spark, d), "enthe")
    return hybrid.neighbours(hits, [F.col("score").desc(), F.col("id")]).select("id", "previous_id", "next_id")


# work queue


@_query(f"WITH {V.ITEMS} SELECT id FROM items WHERE processing_status IN ('DOWNLOADED', 'ANALYZING', 'ANALYZED', 'EMBEDDING') AND (next_retry_at IS NULL OR next_retry_at <= {_now_sql()}) ORDER BY id LIMIT 100")
def claimed_batch(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.claim(V.items(spark, d), _now(), 100).select("id")


@_query(
    f"""WITH {V.ITEMS}, r AS (SELECT *, id % 7 = 0 AS ready, id % 7 = 1 AS error, id % 3 <> 0 AS again FROM items),
s AS (SELECT *, error AND again AND attempts + 1 < 6 AS deferred, error AND NOT (again AND attempts + 1 < 6) AS failed FROM r)
SELECT id, CASE WHEN ready THEN 'READY' WHEN deferred THEN CASE WHEN has_analysis THEN 'ANALYZED' ELSE 'DOWNLOADED' END WHEN failed THEN 'FAILED' ELSE processing_status END AS status, CASE WHEN deferred THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN deferred THEN {NOW} + least(15 * 2 ** attempts, 600)::BIGINT WHEN failed AND again AND revives < 3 THEN {NOW} + 1800 WHEN failed THEN NULL ELSE epoch(next_retry_at)::BIGINT END AS retry FROM s"""
)
def settled_items(spark: SparkSession, d: str) -> DataFrame:
    items = V.items(spark, d)
    results = items.where("id % 7 < 2").select("id", F.expr("if(id % 7 = 0, 'ready', 'error')").alias("outcome"), F.expr("id % 3 <> 0").alias("retryable"))
    return workqueue.settled(items, results, _now()).select("id", F.col("processing_status").alias("status"), "attempts", F.unix_seconds("next_retry_at").alias("retry"))


@_query(
    f"""WITH {V.ITEMS}, r AS (SELECT *, coalesce(processing_status = 'FAILED' AND error_retryable AND next_retry_at <= {_now_sql()} AND revives < 3, false) AS due FROM items)
SELECT id, CASE WHEN due THEN CASE WHEN has_analysis THEN 'ANALYZED' ELSE 'DOWNLOADED' END ELSE processing_status END AS status, CASE WHEN due THEN 0 ELSE attempts END AS attempts, revives + due::INTEGER AS revives FROM r"""
)
def revived_items(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.revived(V.items(spark, d), _now()).select("id", F.col("processing_status").alias("status"), "attempts", "revives")


@_query(
    f"""WITH {V.ITEMS}, c AS (SELECT *, processing_status NOT IN ('READY', 'FAILED') AS open, coalesce(next_retry_at > {_now_sql()}, false) AS waiting FROM items)
SELECT count_if(processing_status = 'READY')::BIGINT AS ready, count_if(processing_status = 'FAILED')::BIGINT AS failed, count_if(open AND waiting)::BIGINT AS deferred, count_if(open AND NOT waiting)::BIGINT AS claimable, epoch(min(next_retry_at) FILTER (waiting))::BIGINT AS next_retry FROM c"""
)
def queue_summary(spark: SparkSession, d: str) -> DataFrame:
    return workqueue.summary(V.items(spark, d), _now()).select("ready", "failed", "deferred", "claimable", F.unix_seconds("next_retry_at").alias("next_retry"))


@_query("SELECT o_orderkey AS id, greatest(1, least(15 * 2 ** (o_orderkey % 9), 600))::BIGINT AS delay FROM orders")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.retry_delay(F.expr("o_orderkey % 9")).alias("delay"))


@_query("SELECT c_custkey AS id, least(greatest(2 ** (c_custkey % 8), c_custkey % 90), 60)::DOUBLE AS wait FROM customer")
def http_waits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.http_backoff(F.expr("c_custkey % 8"), 1.0, F.expr("cast(c_custkey % 90 as string)")).alias("wait"))


@_query("SELECT o_custkey AS backfill_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("backfill_id"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END").alias("status"))
    return workqueue.item_counts(items).select("backfill_id", "total", "done", "failed")


@_query("WITH n AS (SELECT n_nationkey AS position, n_name AS url, (SELECT coalesce(max(c_custkey), 0) FROM customer WHERE c_nationkey = n_nationkey) AS newest FROM nation) SELECT url FROM n ORDER BY newest, position LIMIT 1")
def next_rotation(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    runs = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("site_url"))
    return workqueue.rotation_target(n.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("url")), runs)


# history


@_query(
    """WITH e AS (SELECT 'u' || user_id AS url, event_type AS site, event_id % 2 AS fresh, ts, event_id FROM events)
SELECT url, count(*) AS pages_scanned, sum(event_id % 5)::BIGINT AS media_found, floor(max(epoch(ts)))::BIGINT AS last FROM e GROUP BY url"""
)
def scan_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_type").alias("site"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    old = e.where("event_id % 2 = 0").groupBy("url").agg(F.max("site").alias("site"), F.count("*").alias("pages_scanned"), F.sum(F.expr("event_id % 5")).alias("media_found"), F.max("ts").alias("last_scanned_at"))
    new = e.where("event_id % 2 = 1").select("url", "site", F.expr("event_id % 5").alias("media_found"), F.col("ts").alias("at"))
    return history.scanned(old, new).select("url", "pages_scanned", "media_found", F.unix_seconds("last_scanned_at").alias("last"))


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@_query("WITH p AS (SELECT url, min(page_id) AS position FROM pages GROUP BY url) SELECT url, position FROM p WHERE position % 3 <> 0")
def pages_to_scan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("url", F.col("page_id").alias("position"))
    seen = p.groupBy("url").agg(F.min("position").alias("position")).where("position % 3 = 0")
    return history.to_scan(p, seen).select("url", "position")


@_query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders) GROUP BY 1")
def inserted_users(spark: SparkSession, d: str) -> DataFrame:
    clicks = table(spark, d, "events").where("event_type = 'click'").select("user_id").distinct()
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return history.inserted_if_absent(clicks, orders, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


# text, URLs and records


@_query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.host("url").alias("host"))


@_query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|[\r\x{2028}\x{2029}]', chr(10), 'g'), '[\x{00A0}\x{2007}\x{202F}]', ' ', 'g'), '[\p{Cf}\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') AS t FROM b)
SELECT doc_id, sha256(regexp_replace(substr(t, 1, 4096), '[\s\p{Z}\x{85}]+$', '')) AS clean FROM c"""
)
def sanitized_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.sanitize_text(F.coalesce("text", F.lit(""))), 256).alias("clean"))


@_query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.json_object("props")["k"].try_cast("long").alias("k"))


@_query("SELECT l_orderkey, l_linenumber, l_linenumber AS done, 7 AS total, round(l_linenumber / 7.0::DOUBLE, 6) AS part FROM lineitem")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat(F.lit("done="), "l_linenumber", F.lit(" total=7 paused"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.counter(message, "done").cast("int").alias("done"), T.counter(message, "total").cast("int").alias("total"))
    return rows.withColumn("part", F.round(T.fraction("done", "total"), 6))


@_query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN NULL WHEN 3 THEN 'video/mp4' ELSE NULL END AS kind FROM part")
def content_types(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' IMAGE/JPG; q=1' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'Video/MP4' ELSE '' END")
    return table(spark, d, "part").select("p_partkey", T.normalize_content_type(raw).alias("kind"))


@_query(r"""WITH a AS (SELECT row_number() OVER () AS k, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
u AS (SELECT k, url, regexp_extract(url, '^[a-z]+://[^/?#]*') || split_part(h[i], '#', 1) AS link, t[i] AS title, i FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM a)),
f AS (SELECT k, url, link, min(i) AS i, arg_min(title, i) AS title FROM u GROUP BY k, url, link)
SELECT url, (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::INTEGER AS position, link, title FROM f""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page, absolute, first place wins."""
    return comments.links(table(spark, d, "pages"), ".")


_SITE = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(8)) + " END"


@_query(
    f"""WITH p AS (SELECT c_custkey AS c, c_name, {_SITE.format(*[f"'{x[0]}'" for x in V.SITE_PAGES])} AS site, {_SITE.format(*[f"'{x[1]}'" for x in V.SITE_PAGES])} AS host, {_SITE.format(*[f"'{x[3]}'" for x in V.SITE_PAGES])} AS ident FROM customer)
SELECT 'https://' || host || '/p/' || c AS url, site, 0::INTEGER AS position, replace(ident, '{{c}}', c::VARCHAR) AS comment_id, c_name AS author_name, 'Hi ' || c AS text, 'https://' || host || '/m/' || c || '.gif' AS media, NULL::VARCHAR AS error FROM p"""
)
def page_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of pages of all eight sites, with the media that count."""
    return comments.comments(V.site_pages(spark, d)).withColumn("media", F.array_join("media_urls", " ")).drop("media_urls")


@_query("SELECT DISTINCT url, min(page_id) OVER (PARTITION BY url) AS position FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def unseen_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages not seen before, each once at its first place."""
    p = table(spark, d, "pages").select("url", F.col("page_id").alias("position"))
    return duplicates.unseen(p, p.where("position % 5 = 0"), "url").select("url", "position")


# jobs


@_query(f"WITH {V.JOBS} SELECT id, job_type FROM jobs WHERE status = 'failed' ORDER BY id DESC LIMIT 100")
def failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred failed jobs (the page is the feature)."""
    return jobs.listed(V.jobs(spark, d), "failed", 100).select("id", "job_type")


@_query(f"WITH {V.JOBS} SELECT id, progress, CASE WHEN id % 4 < 2 THEN 'https://a.b/' || id WHEN id % 4 = 2 THEN '' END AS url FROM jobs")
def job_records(spark: SparkSession, d: str) -> DataFrame:
    return jobs.record(V.jobs(spark, d)).select("id", "progress", F.col("params")["url"].alias("url"))


@_query(f"WITH {V.JOBS} SELECT job_type, max(id) AS id, arg_max(status, id) AS status FROM jobs GROUP BY 1")
def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.newest(V.jobs(spark, d))


@_query(f"WITH {V.JOBS} SELECT id, 'https://a.b/' || id AS url, 'current_page' AS scope, 0::INTEGER AS n_urls, false AS force_rescan FROM jobs WHERE job_type = 'crawl' AND id % 4 = 0")
def resumable_crawls(spark: SparkSession, d: str) -> DataFrame:
    return jobs.resumable(V.jobs(spark, d)).select("id", "url", "scope", F.size("urls").alias("n_urls"), "force_rescan")


@_query("SELECT l_orderkey, l_linenumber, round(0.6 * l_linenumber / 7, 6) AS crawling, round(0.6 + 0.4 * l_linenumber / 7, 6) AS loading FROM lineitem")
def crawl_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(7).alias("n"))
    return rows.select("l_orderkey", "l_linenumber", F.round(jobs.crawl_progress("l_linenumber", "n"), 6).alias("crawling"), F.round(jobs.crawl_progress("n", "n", "l_linenumber", "n"), 6).alias("loading"))


@_query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 3")
def capped_downloads(spark: SparkSession, d: str) -> DataFrame:
    """The first three media of each crawl (the cap is the feature)."""
    return jobs.within_cap(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 3)


@_query(
    """SELECT l_orderkey, count_if(l_returnflag = 'R') AS ready, count_if(l_returnflag = 'A') AS failed, count_if(l_returnflag = 'N') AS deferred,
  arg_max('media_id=' || l_partkey || ': ' || l_returnflag, (l_linenumber, 'media_id=' || l_partkey || ': ' || l_returnflag)) FILTER (l_returnflag <> 'R') AS last_error FROM lineitem GROUP BY 1"""
)
def queue_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.expr("CASE l_returnflag WHEN 'R' THEN 'ready' WHEN 'A' THEN 'failed' ELSE 'deferred' END")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("media_id"), outcome.alias("outcome"), F.col("l_returnflag").alias("error"))
    return jobs.outcome_counts(rows, "l_orderkey", "l_linenumber")


@_query(f"WITH {V.ITEMS} SELECT id, error_retryable OR coalesce(processing_status = 'FAILED' AND next_retry_at IS NOT NULL, false) AS error_retryable, epoch(CASE WHEN processing_status = 'FAILED' AND next_retry_at IS NOT NULL THEN {_now_sql()} ELSE next_retry_at END)::BIGINT AS retry FROM items")
def reopened_items(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reopened(V.items(spark, d), _now()).select("id", "error_retryable", F.unix_seconds("next_retry_at").alias("retry"))


@_query("SELECT o_custkey AS backfill_id, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def next_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("backfill_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return jobs.next_pending(rows)


@_query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY 1 LIMIT 5 OFFSET 2")
def items_page(spark: SparkSession, d: str) -> DataFrame:
    """Five open items of one run (the page is the feature)."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("backfill_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return jobs.items_page(rows, 7, "O", 5, 2).select("id")


@_query(f"WITH {V.SOURCES} SELECT site FROM (SELECT site FROM sources WHERE site <> '' UNION SELECT unnest(['comix', 'mangadex', 'elsewhere'])) ORDER BY 1")
def site_choices(spark: SparkSession, d: str) -> DataFrame:
    return jobs.site_choices(V.sources(spark, d), ["mangadex", "comix"], "elsewhere")


@_query(f"SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR {NOW} - ({V.EPOCH} - c_custkey * 10) >= 3600)")
def due_series(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.expr("c_custkey % 5 <> 0"), F.timestamp_seconds(F.lit(V.EPOCH) - F.col("c_custkey") * 10))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey % 3 <> 0").alias("enabled"), at.alias("last_scanned_at"))
    return jobs.due_series(rows, V.jobs(spark, d).where("status <> 'running'"), _now()).select("id")


@_query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'description' WHEN 2 THEN 'object' WHEN 3 THEN 'tags' WHEN 4 THEN NULL ELSE 'emotions' END AS error,
  CASE doc_id % 6 WHEN 0 THEN source WHEN 4 THEN '' END AS description, CASE doc_id % 6 WHEN 0 THEN '["a","b"]' WHEN 4 THEN '[]' END AS tags FROM documents"""
)
def normalized_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = F.expr("""CASE doc_id % 6 WHEN 0 THEN concat('{"description":"', source, '","tags":["a","b"],"emotions":null}') WHEN 1 THEN '{"description":5}' WHEN 2 THEN '[1]' WHEN 3 THEN '{"tags":["a",1]}' WHEN 4 THEN '{"description":null,"tags":[]}' ELSE '{"emotions":["a",null]}' END""")
    rows = table(spark, d, "documents").select("doc_id", A.normalized(reply).alias("x"))
    return rows.select("doc_id", "x.error", "x.description", F.when(F.col("x.error").isNull(), A.json_array("x.tags")).alias("tags"))


@_query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unsupported' ELSE 'unknown content' END AS problem FROM part")
def media_problems(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'image/JPG' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'text/html' END")
    found = F.expr("CASE WHEN p_partkey % 4 < 3 THEN 'image/jpeg' END")
    return table(spark, d, "part").select("p_partkey", A.media_problem(said, found).alias("problem"))


# relational baseline


@_query(
    """SELECT n_name, o_orderpriority, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2"""
)
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_shipdate >= timestamp '1995-01-01'").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers, nations = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.sum(F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))")).cast("double")
    return joined.groupBy("n_name", "o_orderpriority").agg(revenue.alias("revenue"), F.count("*").alias("n"))


@_query(f"""WITH {V.SOURCES}, s AS (SELECT media_id, string_agg(site || ' ' || coalesce(chapter, ''), ' ' ORDER BY id) AS t FROM sources GROUP BY media_id)
SELECT doc_id AS id, trim(CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 40) ELSE '' END || ' ' || CASE doc_id % 3 WHEN 0 THEN 'mine' ELSE '' END || ' ' || CASE doc_id % 4 WHEN 0 THEN '' ELSE 'title ' || doc_id END, ' ') AS description,
  trim(CASE WHEN doc_id % 5 <> 0 THEN '["' || source || '"]' ELSE '' END || ' ' || CASE doc_id % 2 WHEN 0 THEN '["own"]' ELSE '' END, ' ') AS tags, CASE doc_id % 6 WHEN 0 THEN '' ELSE 'f' || doc_id || '.png' END AS filename, coalesce(t, '') AS source_text
FROM documents LEFT JOIN s ON media_id = doc_id""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """The index's rows from media, analyses and sources."""
    doc = table(spark, d, "documents")
    media = doc.selectExpr("doc_id AS id", "CASE WHEN doc_id % 4 <> 0 THEN 'title ' || doc_id END AS title", "CASE doc_id % 3 WHEN 0 THEN 'mine' END AS user_description", "CASE doc_id % 2 WHEN 0 THEN '[\"own\"]' END AS user_tags", "CASE WHEN doc_id % 6 <> 0 THEN 'f' || doc_id || '.png' END AS original_filename")
    analysis = doc.where("doc_id % 5 <> 0").selectExpr("doc_id AS media_id", "substr(text, 1, 40) AS description", "'[\"' || source || '\"]' AS tags")
    return keyword.index_rows(media, analysis, V.sources(spark, d))


@_query(f"""WITH {V.TEXTS}, {V.bm25_sql([(('by', 'the'), False)], limit=30)}, {V.MEDIA}, {V.SOURCES}, {V.ANALYSIS}, s AS (SELECT media_id, arg_min(site, id) AS site FROM sources GROUP BY media_id)
SELECT m.id, round(score, 6) AS score, extension, epoch(created_at)::BIGINT AS created, dup_status, CASE WHEN dup_status = 'dup' THEN epoch(dup_flagged_at + INTERVAL 7 DAY)::BIGINT END AS expires, site,
  CASE WHEN json_valid(emotions) THEN array_to_string(from_json(emotions, '["VARCHAR"]'), ',') ELSE '' END AS emotions
FROM bm25 JOIN media m USING (id) LEFT JOIN s ON s.media_id = m.id LEFT JOIN analysis a ON a.media_id = m.id WHERE processing_status <> 'FAILED'""")
def hydrated_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a page with the records of those media that are still there (the page is the feature)."""
    hits = keyword.bm25(_index(spark, d), '"by the"', limit=30)
    rows = catalog.hydrated(hits, V.media(spark, d).where("processing_status <> 'FAILED'"), V.analysis(spark, d), V.sources(spark, d))
    return rows.select("id", F.round("score", 6).alias("score"), "extension", F.unix_seconds("created_at").alias("created"), "dup_status", F.unix_seconds("dup_expires_at").alias("expires"), "site", F.array_join(F.coalesce("emotions", F.array().cast("array<string>")), ",").alias("emotions"))


# ingest


@_query(f"""WITH {V.MEDIA}, r AS (SELECT *, row_number() OVER w AS k, first_value(id) OVER w AS f FROM media WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, id))
SELECT id, CASE WHEN dup_status = 'unflagged' THEN 'unflagged' WHEN k = 1 THEN 'nondup' ELSE 'dup' END AS dup_status, CASE WHEN dup_status <> 'unflagged' AND k > 1 THEN f END AS dup_of_media_id,
  CASE WHEN dup_status <> 'unflagged' AND k > 1 THEN {NOW}::BIGINT END AS flagged FROM r""")
def incremental_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags after three batches of media, by extension, each of which touches only the groups of its own hashes."""
    fresh = V.media(spark, d).withColumns({"dup_status": F.when(F.col("dup_status") == "unflagged", "unflagged").otherwise("nondup"), "dup_flagged_at": F.lit(None).cast("timestamp")})
    batches = [fresh.where(F.col("extension").isin(*e)) for e in (("gif", "mp4"), ("jpg", "JPEG"), ("png", "webp"))]
    media = batches[0].limit(0)
    for batch in batches:
        media = ingest.merged(media, ingest.delta_flags(media, batch, _now()))
    return media.select("id", "dup_status", "dup_of_media_id", F.unix_seconds("dup_flagged_at").alias("flagged"))


@_query(f"""WITH {V.MEDIA}, r AS (SELECT *, row_number() OVER w AS k, first_value(id) OVER w AS f FROM media WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, id)),
g AS (SELECT id, sha256, created_at, CASE WHEN dup_status = 'unflagged' THEN 'unflagged' WHEN k = 1 THEN 'nondup' ELSE 'dup' END AS dup_status,
  CASE WHEN dup_status = 'unflagged' THEN dup_flagged_at WHEN k > 1 THEN CASE WHEN dup_status = 'dup' THEN dup_flagged_at ELSE {_now_sql(_PURGE_NOW)} END END AS since FROM r),
o AS (SELECT *, coalesce(dup_status = 'dup' AND since <= {_now_sql(_PURGE_NOW)} - INTERVAL 7 DAY, false) AS old FROM g),
c AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS total, count(*) FILTER (old) OVER (PARTITION BY sha256) AS olds, row_number() OVER (PARTITION BY sha256, old ORDER BY created_at, id) AS n FROM o)
SELECT id, dup_status, old AND (total > olds OR n > 1) AS purged FROM c""")
def dup_pass(spark: SparkSession, d: str) -> DataFrame:
    """The duplicate job: flags, then retention, in one plan."""
    return ingest.dup_pass(V.media(spark, d), _now(_PURGE_NOW))[0].select("id", "dup_status", "purged")


@_query("""WITH r AS (SELECT row_number() OVER (ORDER BY url, sha256(text)) + 1000 AS id, * FROM (SELECT doc_id, text, source, 'https://' || source || '.example/m/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif?x=1' ELSE '' END AS url FROM documents WHERE doc_id % 11 <> 5 AND text IS NOT NULL))
SELECT id, CASE doc_id % 2 WHEN 0 THEN CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' ELSE 'bin' END ELSE 'jpg' END AS extension,
  CASE doc_id % 2 WHEN 0 THEN CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' ELSE 'application/octet-stream' END ELSE 'image/jpeg' END AS mime_type,
  lpad(id::VARCHAR, 8, '0') || CASE doc_id % 2 WHEN 0 THEN CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' ELSE '.bin' END ELSE '.jpg' END AS file_path,
  source || '.example' AS site, sha256(text) AS sha256 FROM r""")
def ingested_media(spark: SparkSession, d: str) -> DataFrame:
    """Media and sources of successful downloads."""
    doc = table(spark, d, "documents")
    address = F.expr("'https://' || source || '.example/m/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif?x=1' ELSE '' END")
    down = doc.select(address.alias("url"), F.expr("doc_id % 11 <> 5").alias("ok"), F.expr("CASE WHEN doc_id % 2 = 1 THEN 'image/JPG; q=1' ELSE '' END").alias("content_type"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"), F.lit("f").alias("original_filename"), F.lit("").alias("page_url"), F.lit("c").alias("chapter"), F.lit(1).alias("page_number"), F.lit("1").alias("comment_id"), F.lit("a").alias("author_name"))
    media, sources = ingest.ingested(down, 1000, _now())
    return media.join(sources.select(F.col("media_id").alias("id"), "site"), "id").select("id", "extension", "mime_type", "file_path", "site", "sha256")


_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383961", "52494646000000005745425056503820", "00000018667479706D703432", "1A45DFA3", "", "52494646000000004156492000000000")
_FOUND = ("image/jpeg", "image/png", "image/gif", "image/webp", "video/mp4", "video/webm", None, None)
_SAID = ("image/JPG; q=1", "image/png", "", "text/html", "video/mp4")
_CASE = lambda values, by: f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@_query(f"""WITH b AS (SELECT page_id, unhex({_CASE(_HEADS, 'page_id')}) || encode(html) AS content, {_CASE(_FOUND, 'page_id')} AS found, {_CASE(('image/jpeg', 'image/png', None, 'text/html', 'video/mp4'), 'page_id')} AS said FROM pages),
p AS (SELECT *, CASE WHEN said = 'text/html' THEN 'unsupported' WHEN found IS NULL THEN 'unknown content' WHEN said <> found THEN 'mismatch' END AS problem FROM b)
SELECT page_id, octet_length(content)::INTEGER AS size, sha256(content) AS sha256, found, CASE WHEN problem IS NULL THEN CASE WHEN found = 'image/gif' THEN 'gif' WHEN found LIKE 'video/%' THEN 'video' ELSE 'image' END END AS kind, problem FROM p""")
def media_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of pages behind the first bytes of media formats: size, hash, type and verdict from one reading."""
    content = F.concat(F.unhex(F.expr(_CASE(_HEADS, "page_id"))), F.encode("html", "UTF-8"))
    rows = table(spark, d, "pages").select("page_id", content.alias("content"), F.expr(_CASE(_SAID, "page_id")).alias("declared"))
    return M.verdicts(rows).select("page_id", "size", "sha256", "found", "kind", "problem")


@_query(f"WITH {V.TEXTS}, {V.bm25_sql([(('by', 'the'), False)], limit=10**9)} SELECT id, round(score, 6) AS score, (SELECT count(*) FROM bm25) AS total FROM bm25 ORDER BY score DESC, id LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of hits with the total of all, from one job (the page is the feature)."""
    hits = keyword.bm25(_index(spark, d), '"by the"', limit=None)
    return hybrid.result_page(hits, 2, 20, [F.col("score").desc(), F.col("id")]).select("id", F.round("score", 6).alias("score"), "total")


_DRAINED = f"""{V.ITEMS}, d AS (SELECT *, processing_status IN ('DOWNLOADED', 'ANALYZING', 'ANALYZED', 'EMBEDDING') AND (next_retry_at IS NULL OR next_retry_at <= {_now_sql()}) AS due, id % 3 = 0 AS good, id % 2 = 0 AS again FROM items)"""


@_query(f"""WITH {_DRAINED} SELECT id, CASE WHEN NOT due THEN processing_status WHEN good THEN 'READY' WHEN again AND attempts + 1 < 6 THEN CASE WHEN has_analysis THEN 'ANALYZED' ELSE 'DOWNLOADED' END ELSE 'FAILED' END AS processing_status,
  (CASE WHEN due AND NOT good AND again AND attempts + 1 < 6 THEN attempts + 1 ELSE attempts END)::INTEGER AS attempts FROM d""")
def drained_items(spark: SparkSession, d: str) -> DataFrame:
    """Items after all that are claimable went through the queue, micro-batch by micro-batch."""
    folder = live_queue.fresh_folder(shared_dir(spark))
    rows = V.items(spark, d)
    rows.write.parquet(f"{folder}/in")
    outcome = F.when(F.expr("id % 3 = 0"), "ready").otherwise("error")
    process = lambda claimed: claimed.select("id", outcome.alias("outcome"), F.expr("id % 2 = 0").alias("retryable"), F.lit("refused").alias("error"))
    passes.drained(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in"), process, folder, _now())
    return spark.read.parquet(f"{folder}/items").select("id", "processing_status", "attempts")


# discovery


@_query(f"""WITH RECURSIVE {V.LINKED},
r AS (SELECT 'https://h' || h || '.example/0' AS url, 0 AS depth FROM p WHERE m = 0 UNION SELECT link, depth + 1 FROM r JOIN edges USING (url) WHERE depth < 24),
f AS (SELECT url, min(depth) AS depth FROM r GROUP BY url)
SELECT f.url, f.depth, arg_min(e.url, (e.url, e.position)) AS via, arg_min(e.position, (e.url, e.position)) AS position
FROM f LEFT JOIN (SELECT edges.*, g.depth AS at FROM edges JOIN f g USING (url)) e ON e.link = f.url AND e.at = f.depth - 1 GROUP BY f.url, f.depth""")
def reachable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every address that links of recorded pages lead to, with the depth and place that it is first found at."""
    pages = V.linked_pages(spark, d)
    return discovery.reachable(pages, pages.where(F.col("url").endswith("/0")))


@_query(f"""WITH e AS (SELECT page_id AS k, {V._ENTRY} AS entry FROM pages)
SELECT DISTINCT entry, CASE WHEN k % 3 = 2 OR k % 10 = 5 THEN 0 WHEN k % 5 = 0 THEN n - 1 ELSE n END AS position,
  CASE WHEN k % 3 = 2 OR k % 10 = 5 THEN entry WHEN k % 5 = 0 THEN 'https://asurascans.com/comics/s' || k || '/chapter/' || CASE n WHEN 1 THEN '2.5' ELSE '1' END ELSE 'https://asurascans.com/comics/s' || k || '/chapter/' || n END AS url
FROM e, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n <= CASE WHEN k % 3 = 2 OR k % 10 = 5 THEN 1 WHEN k % 5 = 0 THEN 2 ELSE k % 5 END""")
def series_chapters(spark: SparkSession, d: str) -> DataFrame:
    return discovery.chapters(V.series_pages(spark, d), V.series_entries(spark, d), V.SERIES, V.CHAPTER)


@_query(f"""WITH c AS (SELECT c_custkey AS k, c_name AS title, c_custkey // 20 + 1 AS place FROM customer)
SELECT place::INTEGER AS place, (k % 20 + CASE WHEN place > 1 THEN 20 ELSE 0 END)::INTEGER AS position, '{V.CATALOG}c' || k AS url, title FROM c
WHERE place < 31 AND place <= {discovery.MAX_PAGES}""")
def catalog_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of a paged catalog, up to its first page without new ones."""
    return discovery.catalog(V.catalog_pages(spark, d), V.CATALOG, V.SERIES)


_SEEN_PAGES = f"WITH f AS ({V.FEED}), n AS (SELECT feed, count(*) AS n FROM f GROUP BY feed)"


@_query(f"{_SEEN_PAGES} SELECT feed, page::INTEGER AS page, position::INTEGER AS position, id FROM f WHERE page <= {discovery.MAX_PAGES} AND NOT (feed % 7 = 3 AND page >= 2)")
def paged_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds by page number, each up to its first short or missing page."""
    return discovery.paged(V.feed_replies(spark, d), "data", "id: bigint", 3)


@_query(f"{_SEEN_PAGES} SELECT feed, page::INTEGER AS page, position::INTEGER AS position, id FROM f WHERE page <= {discovery.MAX_PAGES} AND NOT (feed % 7 = 3 AND page >= 2)")
def cursor_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Items of feeds whose replies name the next page."""
    replies = kept(V.feed_replies(spark, d), "feed-replies")
    return discovery.followed(replies, replies.where("page = 1").select("feed", "url"), "data", "id: bigint")


# the queue as a stream

LIVE = workqueue.Policy(max_attempts=3, retry_base=3600.0, retry_cap=5400.0, revive_after=86400, max_revives=2)
_OVER = "(a.st = 'READY' OR a.st = 'FAILED' AND a.due < 0)"
_BACK = "(a.due >= 0 AND a.due <= {now})"


def _came_back(now: str) -> str:
    back = _BACK.format(now=now)
    return f"""{{'st': CASE WHEN {back} THEN CASE WHEN a.ha THEN 'ANALYZED' ELSE 'DOWNLOADED' END ELSE a.st END, 'n': CASE WHEN {back} AND a.st = 'FAILED' THEN 0 ELSE a.n END,
    'rv': CASE WHEN {back} AND a.st = 'FAILED' THEN a.rv + 1 ELSE a.rv END, 'ha': a.ha, 'due': CASE WHEN {back} THEN -1 ELSE a.due END, 'tm': a.tm, 'oc': a.oc, 're': a.re}}"""


_START = "{'st': 'DOWNLOADED', 'n': 0, 'rv': 0, 'ha': false, 'due': (-1)::BIGINT, 'tm': 0::BIGINT, 'oc': '', 're': false}"
_DEFERS = f"(e.re AND b.n + 1 < {LIVE.max_attempts})"
_TAKEN = f"""{{'st': CASE e.oc WHEN 'analyzed' THEN 'EMBEDDING' WHEN 'ready' THEN 'READY' ELSE CASE WHEN {_DEFERS} THEN CASE WHEN b.ha THEN 'ANALYZED' ELSE 'DOWNLOADED' END ELSE 'FAILED' END END,
    'n': CASE WHEN e.oc = 'ready' THEN 0 WHEN e.oc = 'error' AND {_DEFERS} THEN b.n + 1 ELSE b.n END, 'rv': b.rv, 'ha': b.ha OR e.oc = 'analyzed',
    'due': CASE WHEN e.oc = 'analyzed' THEN b.due WHEN e.oc = 'ready' THEN -1 WHEN {_DEFERS} THEN e.tm + 1000 * least({LIVE.retry_base:.0f} * (1 << b.n), {LIVE.retry_cap:.0f})::BIGINT WHEN e.re AND b.rv < {LIVE.max_revives} THEN e.tm + 1000 * {LIVE.revive_after} ELSE -1 END, 'tm': e.tm, 'oc': e.oc, 're': e.re}}"""


@_query(f"""WITH e AS (SELECT user_id AS id, event_id AS seq, epoch_us(ts) // 1000 AS tm, {V.EVENT_OUTCOME} AS oc, value >= 5 AS re FROM events),
l AS (SELECT id, list({{'st': '', 'n': 0, 'rv': 0, 'ha': false, 'due': 0::BIGINT, 'tm': tm, 'oc': oc, 're': re}} ORDER BY tm, seq) AS es FROM e GROUP BY id),
f AS (SELECT id, list_reduce(list_prepend({_START}, es), lambda o, e: list_transform(list_transform(list_transform([o], lambda a: CASE WHEN {_OVER} THEN {_START} ELSE a END), lambda a: {_came_back('e.tm')}), lambda b: {_TAKEN})[1]) AS a FROM l),
z AS (SELECT id, {_came_back('(SELECT max(tm) - 500 FROM e)')} AS a FROM f)
SELECT id, a.st AS status, a.n AS attempts, a.rv AS revives, a.ha AS has_analysis, CASE WHEN a.due >= 0 THEN a.due END AS due_ms FROM z""")
def live_items(spark: SparkSession, d: str) -> DataFrame:
    """States of items after a recorded stream of events, with timers up to the watermark."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(V.EVENT_OUTCOME).alias("outcome"), F.expr("value >= 5").alias("retryable"))
    folder = live_queue.fresh_folder(shared_dir(spark))
    live_queue.run_available(live_queue.states(events, LIVE), folder)
    return live_queue.latest(spark, folder).select("id", "status", "attempts", "revives", "has_analysis", F.unix_millis("due").alias("due_ms"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-only ranking of English documents with their texts, the best twenty."""
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    _, hits = hybrid.search(_index(spark, sf_dir), "the by", allowed=allowed)
    top = hits.limit(20)
    texts = V.texts(spark, sf_dir).select("id", "description", "source_text")
    return top.join(texts, "id").orderBy(F.col("score").desc(), "id")
