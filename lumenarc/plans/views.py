"""The archive's tables as views of the driver's tables, for queries and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.session import table

EPOCH = 1767225600  # 2026-01-01 00:00:00 UTC
EXTENSIONS = ("jpg", "png", "gif", "mp4", "JPEG", "webp")
STATUSES = ("DOWNLOADED", "ANALYZING", "ANALYZED", "EMBEDDING", "READY", "FAILED")
EMOTIONS = ('["Joy","calm"]', "not json", None, '["fear"]')
VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]


def _pick(values: tuple, by: str, n: int | None = None):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.expr(f"{by} % {n or len(values)}") == i, F.lit(v)).otherwise(out)
    return out


def _pick_sql(values: tuple, by: str) -> str:
    return "CASE " + by + f" % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = lambda seconds: F.timestamp_seconds(F.lit(EPOCH) + F.expr(seconds))
    return d.select(
        F.col("doc_id").alias("id"), _pick(EXTENSIONS, "doc_id").alias("extension"), at("doc_id % 500 * 3600").alias("created_at"), F.sha2("text", 256).alias("sha256"), _pick(STATUSES, "doc_id").alias("processing_status"),
        F.expr("CASE doc_id % 10 WHEN 0 THEN 'unflagged' WHEN 1 THEN 'dup' ELSE 'nondup' END").alias("dup_status"), F.when(F.expr("doc_id % 10 = 1"), at("doc_id % 20 * 86400")).alias("dup_flagged_at"),
        F.lit(None).cast("long").alias("dup_of_media_id"), F.expr("doc_id % 7 = 0").alias("is_favorite"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = d.select((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("media_id"), F.col("source").alias("site"), F.expr("concat('chapter-', doc_id % 50)").alias("chapter"))
    second = d.where("doc_id % 2 = 0").select((F.col("doc_id") * 2 + 1).alias("id"), F.col("doc_id").alias("media_id"), F.expr("concat('src', doc_id % 3)").alias("site"), F.lit(None).cast("string").alias("chapter"))
    return first.unionByName(second)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("media_id"), _pick(EMOTIONS, "doc_id").alias("emotions"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keyword index reads."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.expr("concat(lang, ' ', source)").alias("tags"), F.expr("concat('file_', doc_id, '.png')").alias("filename"), F.expr("concat(source, ' chapter-', doc_id % 50)").alias("source_text"))


def edited(texts: DataFrame) -> DataFrame:
    """texts after some rows were written anew, some deleted and some added, by source."""
    own = F.coalesce(F.split_part("source_text", F.lit(" "), F.lit(1)), F.lit(""))
    kept = texts.where(own != "src5")
    changed = kept.withColumn("description", F.when(own == "src3", F.concat("description", F.lit(" enthe edons"))).otherwise(F.col("description")))
    added = texts.where(own == "src7").withColumns({"id": -F.col("id") - 1, "tags": F.lit("the fresh enthetic")})
    return changed.unionByName(added)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("model"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work-queue items, one an order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), _pick(STATUSES, "o_orderkey").alias("processing_status"), F.expr("cast(o_orderkey % 6 as int)").alias("attempts"), F.when(F.expr("o_orderkey % 3 <> 0"), F.timestamp_seconds(F.lit(EPOCH) + F.expr("o_orderkey % 1000"))).alias("next_retry_at"),
        F.lit(None).cast("timestamp").alias("failed_at"), F.expr("o_orderkey % 4 <> 0").alias("error_retryable"), F.expr("cast(o_orderkey % 5 as int)").alias("revives"), F.expr("o_orderkey % 2 = 0").alias("has_analysis"),
    )


#: Job types and states, by the key and the status of an order.
JOB_TYPES = ("crawl", "ai_analysis", "duplicates")
#: Parameters of a job: a url, one that a backfill owns, an empty url, no JSON.
_PARAMS = "CASE id % 4 WHEN 0 THEN '{\"url\":\"https://a.b/' || id || '\"}' WHEN 1 THEN '{\"url\":\"https://a.b/' || id || '\",\"owner\":\"backfill\"}' WHEN 2 THEN '{\"url\":\"\"}' ELSE '{' END"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, one an order."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(JOB_TYPES, "o_orderkey").alias("job_type"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END").alias("status"))
    return rows.select("*", F.expr("(id % 5) / 4d").alias("progress"), F.expr(_PARAMS).alias("params"))


#: A comment page of each site: host, page around the comment of a customer ({c}, {name}), id of the comment.
SITE_PAGES = (
    ("asurascans", "asurascans.com", '<div id="comments-section"><div id="comment-{c}"><a href="/user/{c}"><img alt="{name}"></a><div class="text-zinc-300 leading-relaxed">Hi {c}</div><img alt="Comment media" src="/m/{c}.gif"><img src="/no.png"></div></div>', "{c}"),
    ("mangadex", "forums.mangadex.org", '<article class="message--post" id="js-post-{c}" data-author="{name}"><div class="message-body"><div class="bbWrapper">Hi {c}</div>quoted<img class="smilie" src="/s.png"><img src="/styles/x.png"><img data-src="/m/{c}.gif"></div></article>', "{c}"),
    ("mangapark", "mangapark.net", '<div data-name="comment-item" id="comment-{c}"><a href="https://x.y/u/1">no</a><a href="/u/{c}">{name}</a><div class="my-2">Hi {c}</div><div class="my-2"><img src="/m/{c}.gif"><img class="emoji" src="/e.png"></div></div>', "{c}"),
    ("comix", "comix.to", '<li class="cm-item" id="cm-{c}_a"><a href="/u/{c}">{name}</a><div class="cm-item__content">Hi {c}</div><div class="cm-item__content"><video src="/m/{c}.gif"></video></div></li><li class="cm-item" id="{c}">no</li>', "{c}_a"),
    ("thunderscans", "en-thunderscans.com", '<ul id="comments"><li class="mcs-comment" data-comment-id="{c}"><span class="mcs-comment-author">{name}</span><div class="mcs-comment-content-view">Hi {c}<img src="/m/{c}.gif"></div></li></ul>', "{c}"),
    ("flamecomics", "flamecomics.xyz", '<div class="Comment-module__x__item" id="c{c}"><a aria-label="View profile: {name}">x</a><div id="comment-content-{c}">Hi {c}<img src="/m/{c}.gif"></div></div>', "c{c}"),
    ("vortexscans", "vortexscans.org", '<div id="comments"><div data-comment-id="{c}"><article aria-label="{name}"><div class="comment-body">Hi {c}<img src="/m/{c}.gif"></div></article></div></div>', "{c}"),
    ("hivetoons", "hivetoons.org", '<div id="comments"><div data-comment-id="{c}"><article aria-label="{name}"><div class="comment-body">Hi {c}<img srcset="/m/{c}.gif 1x, /big.gif 2x"></div></article></div></div>', "{c}"),
)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a comment for every customer, of each site in turn."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{c}"), F.col("c_custkey").cast("string")), F.lit("{name}"), F.col("c_name"))
    pick = lambda at: F.element_at(F.array(*[filled(p[at]) for p in SITE_PAGES]), (F.col("c_custkey") % len(SITE_PAGES)).cast("int") + 1)
    return c.select(F.concat(F.lit("https://"), pick(1), F.lit("/p/"), "c_custkey").alias("url"), pick(2).alias("html"))


#: Fixed: paths of a series and of its chapters.
SERIES, CHAPTER = "/comics/[^/]+", "(/comics/[^/]+)/chapter/[^/]+"
CATALOG = "https://en-thunderscans.com/comics/"


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five hosts, numbered m from 0 on each: links to another host, to 2m+1 twice, 2m+2 and m/2; some have none."""
    p = table(spark, sf_dir, "pages").select(F.expr("page_id % 5").alias("h"), F.expr("page_id DIV 5").alias("m"))
    html = "'<a href=\"https://h' || (h + 1) % 5 || '.example/' || m || '\">x</a><p><a href=\"/' || (2 * m + 1) || '\">one</a><a href=\"' || (2 * m + 2) || '#c\">two</a><a href=\"https://h' || h || '.example/' || (2 * m + 1) || '\"></a><a href=\"./' || (m DIV 2) || '\">up</a>'"
    return p.select(F.expr("'https://h' || h || '.example/' || m").alias("url"), F.expr(f"CASE WHEN m % 13 = 7 THEN '<p>none' ELSE {html} END").alias("html"))


LINKED = """p AS (SELECT page_id % 5 AS h, page_id // 5 AS m FROM pages),
edges AS (SELECT 'https://h' || h || '.example/' || m AS url, k - 1 AS position, 'https://h' || h || '.example/' || CASE k WHEN 2 THEN 2 * m + 1 WHEN 3 THEN 2 * m + 2 ELSE m // 2 END AS link FROM p, (SELECT unnest([2, 3, 4]) AS k) WHERE m % 13 <> 7)"""


def series_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series page for every page: links to up to four chapters, or their numbers as data, or nothing."""
    p = table(spark, sf_dir, "pages").select("page_id")
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.expr("cast(page_id % 5 as int)")), lambda n: F.concat(F.lit('<a href="/comics/s'), F.col("page_id").cast("string"), F.lit("/chapter/"), n.cast("string"), F.lit('">c</a>'))), "")
    data = F.expr("'<script id=\"continue-reading-data\">{&quot;base&quot;:&quot;/comics/s' || page_id || '&quot;,&quot;numbers&quot;:[&quot;2.5&quot;,&quot;1&quot;]}</script>'")
    html = F.when(F.expr("page_id % 5 > 0"), F.concat(F.lit('<a href="/comics/other/chapter/9">no</a>'), links)).when(F.expr("page_id % 2 = 0"), data).otherwise("<p>nothing")
    return p.select(F.expr("'https://asurascans.com/comics/s' || page_id || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END").alias("url"), html.alias("html"))


def series_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries: series, chapters and addresses of neither kind, in turn."""
    return table(spark, sf_dir, "pages").select(F.expr(_ENTRY).alias("url"))


_ENTRY = "'https://asurascans.com/comics' || CASE page_id % 3 WHEN 0 THEN '/s' || page_id WHEN 1 THEN '/s' || page_id || '/chapter/77' ELSE '' END"


def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a catalog, 20 customers a page, each with links that repeat the page before; page 31 has nothing else."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("cast(c_custkey DIV 20 + 1 as int)").alias("place"))
    both = c.unionByName(c.withColumn("place", F.col("place") + 1)).where("NOT (place = 31 AND c_custkey >= 600)")
    link = F.expr("'<a href=\"/comics/c' || c_custkey || '/\">' || c_name || '</a>'")
    pages_of = both.groupBy("place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", link.alias("a")))), lambda x: x["a"]), "").alias("html"))
    return pages_of.select(F.concat(F.lit(CATALOG), F.when(F.col("place") > 1, F.concat(F.lit("?page="), F.col("place").cast("string"))).otherwise("")).alias("url"), F.concat("html", F.lit('<a href="/comics/">all</a><a href="https://a.b/comics/x">x</a>')).alias("html"))


#: Orders as feeds, one a customer, of pages of three items; a page of some feeds is lost.
_FEED = "SELECT o_custkey AS feed, o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) {div} 3 + 1 AS page, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 AS position FROM orders"
FEED = _FEED.replace("{div}", "//")
LOST = "feed % 7 = 3 AND page = 2"


def feed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, page, url, body) of every page that is not lost; body has items and, unless it is the last, next."""
    rows = spark.sql(_FEED.replace("{div}", "DIV").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))
    last = rows.groupBy("feed").agg(F.max("page").alias("last"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: F.struct(x["id"].alias("id")))
    address = lambda page: F.concat(F.lit("https://api.example/"), F.col("feed").cast("string"), F.lit("?p="), page.cast("string"))
    pages_of = rows.groupBy("feed", "page").agg(items.alias("data")).join(last, "feed").where(f"NOT ({LOST})")
    following = F.when(F.col("page") < F.col("last"), address(F.col("page") + 1))
    return pages_of.select("feed", F.col("page").cast("int").alias("page"), address(F.col("page")).alias("url"), F.to_json(F.struct("data", following.alias("next"))).alias("body"))


_AT = f"epoch_ms(({EPOCH} + {{}})::BIGINT * 1000)"
MEDIA = f"""media AS (SELECT doc_id AS id, {_pick_sql(EXTENSIONS, 'doc_id')} AS extension, {_AT.format('doc_id % 500 * 3600')} AS created_at, sha256(text) AS sha256, {_pick_sql(STATUSES, 'doc_id')} AS processing_status,
  CASE doc_id % 10 WHEN 0 THEN 'unflagged' WHEN 1 THEN 'dup' ELSE 'nondup' END AS dup_status, CASE WHEN doc_id % 10 = 1 THEN {_AT.format('doc_id % 20 * 86400')} END AS dup_flagged_at, NULL::BIGINT AS dup_of_media_id, doc_id % 7 = 0 AS is_favorite FROM documents)"""
SOURCES = """sources AS (SELECT doc_id * 2 AS id, doc_id AS media_id, source AS site, 'chapter-' || doc_id % 50 AS chapter FROM documents
  UNION ALL SELECT doc_id * 2 + 1, doc_id, 'src' || doc_id % 3, NULL FROM documents WHERE doc_id % 2 = 0)"""
ANALYSIS = f"analysis AS (SELECT doc_id AS media_id, {_pick_sql(EMOTIONS, 'doc_id')} AS emotions FROM documents WHERE doc_id % 5 <> 0)"
TEXTS = "texts AS (SELECT doc_id AS id, text AS description, lang || ' ' || source AS tags, 'file_' || doc_id || '.png' AS filename, source || ' chapter-' || doc_id % 50 AS source_text FROM documents)"
_OWN = "coalesce(split_part(source_text, ' ', 1), '')"
EDITED = f"""{TEXTS.replace('texts AS', 'old_texts AS', 1)}, texts AS (
  SELECT id, CASE WHEN {_OWN} = 'src3' THEN description || ' enthe edons' ELSE description END AS description, tags, filename, source_text FROM old_texts WHERE {_OWN} <> 'src5'
  UNION ALL SELECT -id - 1, description, 'the fresh enthetic', filename, source_text FROM old_texts WHERE {_OWN} = 'src7')"""
#: The queue's recorded events: what a click, a view and so on stand for.
EVENT_OUTCOME = "CASE event_type WHEN 'view' THEN 'analyzed' WHEN 'purchase' THEN 'ready' ELSE 'error' END"
ITEMS = f"""items AS (SELECT o_orderkey AS id, {_pick_sql(STATUSES, 'o_orderkey')} AS processing_status, (o_orderkey % 6)::INTEGER AS attempts, CASE WHEN o_orderkey % 3 <> 0 THEN {_AT.format('o_orderkey % 1000')} END AS next_retry_at,
  o_orderkey % 4 <> 0 AS error_retryable, (o_orderkey % 5)::INTEGER AS revives, o_orderkey % 2 = 0 AS has_analysis FROM orders)"""

JOBS = f"""jobs AS (SELECT o_orderkey AS id, {_pick_sql(JOB_TYPES, 'o_orderkey')} AS job_type, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, (o_orderkey % 5) / 4.0::DOUBLE AS progress FROM orders)"""


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def bm25_sql(atoms: list, columns: tuple[str, ...] = ("description", "tags", "filename", "source_text"), name: str = "bm25", limit: int = 500) -> str:
    """Common tables that end in one called `name` of (id, score)."""
    every = ("description", "tags", "filename", "source_text")

    def f(words: tuple[str, ...], prefix: bool, c: str) -> str:
        fits = lambda x, j: f"starts_with({x}, '{words[j]}')" if prefix and j == len(words) - 1 else f"{x} = '{words[j]}'"
        if len(words) == 1:
            return f"len(list_filter({c}, lambda x: {fits('x', 0)}))"
        return f"len(list_filter(range(1, len({c}) - {len(words)} + 2), lambda i: " + " AND ".join(fits(f"{c}[i + {j}]", j) for j in range(len(words))) + "))"

    fs = ", ".join(" + ".join(f(w, p, c) for c in columns) + f" AS f{i}" for i, (w, p) in enumerate(atoms))
    idf = lambda i: f"CASE WHEN ln((c - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((c - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(atoms)))
    return f"""{name}_t AS (SELECT id, {', '.join(f'{tokens_sql(c)} AS {c}' for c in every)} FROM texts),
{name}_f AS (SELECT id, {' + '.join(f'len({c})' for c in every)} AS n, {fs} FROM {name}_t),
{name}_c AS (SELECT count(*) AS c, avg(n) AS mean, {', '.join(f'count_if(f{i} > 0) AS d{i}' for i in range(len(atoms)))} FROM {name}_f),
{name} AS (SELECT id, {score} AS score FROM {name}_f, {name}_c WHERE {' AND '.join(f'f{i} > 0' for i in range(len(atoms)))} ORDER BY score DESC, id LIMIT {limit})"""
