from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import catalog, comments, duplicates, history, workqueue

NOW = datetime(2026, 3, 15, 12)
MEDIA = "id long, sha256 string, created_at timestamp, dup_status string, dup_flagged_at timestamp, dup_of_media_id long"


def media(spark, rows):
    return spark.createDataFrame(rows, MEDIA)


def test_flags(spark):
    at = lambda d: datetime(2026, 3, d)
    rows = [(1, "a", at(1), "nondup", None, None), (2, "a", at(2), "nondup", None, None), (3, "a", at(3), "dup", at(12), 1), (4, "b", at(1), "unflagged", None, None), (5, "b", at(2), "nondup", None, None), (6, "c", at(1), "dup", at(2), 99), (7, None, at(1), "nondup", None, None), (8, None, at(1), "nondup", None, None)]
    got = {r["id"]: (r["dup_status"], r["dup_flagged_at"], r["dup_of_media_id"]) for r in duplicates.flagged(media(spark, rows), F.lit(NOW)).collect()}
    assert got[1] == ("nondup", None, None) and got[2] == ("dup", NOW, 1) and got[3] == ("dup", at(12), 1)
    assert got[4][0] == "unflagged" and got[5] == ("dup", NOW, 4) and got[6] == ("nondup", None, None)
    assert got[7][0] == got[8][0] == "nondup"


def test_purge_keeps_last_copy(spark):
    old, edge, new = datetime(2026, 3, 1), datetime(2026, 3, 8, 12), datetime(2026, 3, 14)
    rows = [(1, "a", old, "dup", old, 9), (2, "a", new, "dup", old, 9), (3, "b", old, "nondup", None, None), (4, "b", new, "dup", edge, 3), (5, "b", new, "dup", new, 3)]
    assert sorted(r["id"] for r in duplicates.purgeable(media(spark, rows), F.lit(NOW)).collect()) == [2, 4]


def test_copies_and_unflag(spark):
    t = datetime(2026, 3, 1)
    m = media(spark, [(1, "a", t, "nondup", None, None), (2, "a", t, "dup", t, 1), (3, "a", t, "dup", t, 1)])
    assert sorted((r["id"], r["is_retained"]) for r in duplicates.copies(m, 2).collect()) == [(1, True), (3, False)]
    got = {r["id"]: (r["dup_status"], r["dup_of_media_id"]) for r in duplicates.unflagged(m, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    assert got == {1: ("nondup", None), 2: ("unflagged", 1), 3: ("dup", 1)}


def test_filters(spark):
    m = spark.createDataFrame([(1, "gif", datetime(2026, 1, 2, 23, 59), "READY", "nondup", True), (2, "PNG", datetime(2026, 1, 3), "FAILED", "dup", False)], "id long, extension string, created_at timestamp, processing_status string, dup_status string, is_favorite boolean")
    ids = lambda f: sorted(r["id"] for r in catalog.filtered(m, f).collect())
    assert ids(catalog.Filters(type="gif")) == [1] and ids(catalog.Filters(type="image")) == []
    assert ids(catalog.Filters(format=".png")) == [2]
    assert ids(catalog.Filters(date_to=date(2026, 1, 2))) == [1] and ids(catalog.Filters(date_from=date(2026, 1, 3))) == [2]
    with pytest.raises(ValueError):
        catalog.Filters(type="audio")
    counts = {(r["facet"], r["value"]): r["n"] for r in catalog.facets(m, catalog.Filters(dup_status="dup")).collect()}
    assert counts[("dup_status", "nondup")] == 1 and counts[("processing", "failed")] == 1 and counts[("processing", "ready")] == 0


def test_file_name(spark):
    rows = spark.createDataFrame([(7,), (123456789,)], "id long").select(catalog.file_name(F.col("id"), F.lit(".png")).alias("n")).collect()
    assert [r["n"] for r in rows] == ["00000007.png", "123456789.png"]


ITEMS = "id long, processing_status string, attempts int, next_retry_at timestamp, failed_at timestamp, error_retryable boolean, revives int, has_analysis boolean"


def test_queue(spark):
    rows = [(1, "ANALYZING", 0, None, None, False, 0, False), (2, "EMBEDDING", 0, None, None, False, 0, True), (3, "ANALYZING", 1, None, None, False, 0, False), (4, "ANALYZING", 0, None, None, False, 3, False)]
    items = spark.createDataFrame(rows, ITEMS)
    results = spark.createDataFrame([(1, "error", True), (2, "ready", None), (3, "error", True), (4, "error", False)], "id long, outcome string, retryable boolean")
    after = workqueue.settled(items, results, F.lit(NOW), workqueue.Policy(max_attempts=2))
    got = {r["id"]: r for r in after.collect()}
    assert (got[1]["processing_status"], got[1]["attempts"]) == ("DOWNLOADED", 1) and got[1]["next_retry_at"] > NOW
    assert got[2]["processing_status"] == "READY"
    assert got[3]["processing_status"] == "FAILED" and got[3]["next_retry_at"] is not None
    assert got[4]["processing_status"] == "FAILED" and got[4]["next_retry_at"] is None
    assert [r["id"] for r in workqueue.claimable(after, F.lit(NOW)).collect()] == []
    later = {r["id"]: r for r in workqueue.revived(after, F.lit(datetime(2026, 3, 16))).collect()}
    assert (later[3]["processing_status"], later[3]["revives"]) == ("DOWNLOADED", 1) and later[4]["processing_status"] == "FAILED"


def test_history(spark):
    t = datetime(2026, 1, 1)
    old = spark.createDataFrame([("u", "s", 2, 5, t)], "url string, site string, pages_scanned long, media_found long, last_scanned_at timestamp")
    new = spark.createDataFrame([("u", "s2", 1, NOW), ("v", "s", 0, NOW)], "url string, site string, media_found long, at timestamp")
    got = {r["url"]: tuple(r) for r in history.scanned(old, new).collect()}
    assert got["u"] == ("u", "s2", 3, 6, NOW) and got["v"][2:4] == (1, 0)


PAGE = """<div id="comments-section"><div id="comment-1"><a href="/user/9">Ann</a><div class="text-zinc-300 leading-relaxed">Hi &amp; bye</div><img alt="Comment media" data-src="/a.gif">
<div id="comment-2"><img alt="Comment media" srcset="https://c.d/b.png 1x, x 2x"><img alt="Comment media" src="data:abc"></div></div></div><img alt="Comment media" src="/outside.png">"""


def test_comments(spark):
    pages = spark.createDataFrame([("https://asurascans.com/x", PAGE), ("https://unknown.org/", PAGE), ("https://asurascans.com/y", None)], "url string, html string")
    found = comments.comments(pages)
    rows = {r["comment_id"]: r for r in found.collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["author_name"] == "Ann" and rows["1"]["text"] == "Hi & bye"
    got = sorted((r["comment_id"], r["media_url"], r["kind"], r["original_filename"]) for r in comments.media(found).collect())
    assert got == [("1", "https://asurascans.com/a.gif", "gif", "a.gif"), ("2", "https://c.d/b.png", "image", "b.png")]


def test_every_site_is_described():
    page = {
        "mangadex": '<article class="message--post" id="js-post-5" data-author="A"><div class="message-body"><div class="bbWrapper">t</div><img class="smilie" src="/s.png"><img src="/k.png"><a href="/attachments/1/">f</a></div></article>',
        "mangapark": '<div data-name="comment-item" id="comment-12"><div class="my-2">t<img src="/k.png"></div></div>',
        "comix": '<li class="cm-item" id="cm-7"><div class="cm-item__content">t<video src="/v.mp4"></video></div></li>',
        "thunderscans": '<ul id="comments"><li class="mcs-comment" data-comment-id="3"><div class="mcs-comment-content-view">t<img src="/k.png"></div></li></ul>',
        "flamecomics": '<div class="Comment-module__x__item" id="c1"><a aria-label="View profile: Bo">x</a><div id="comment-content-c1">t<img src="/k.png"></div></div>',
        "vortexscans": '<div id="comments"><div data-comment-id="8"><article aria-label="Cy"><div class="comment-body">t<img src="/k.png"></div></article></div></div>',
    }
    page["hivetoons"] = page["vortexscans"]
    for name, html in page.items():
        site = comments.SITES[name]
        (found,) = comments.page_comments(html, f"https://{site.hosts[0]}/p", site)
        assert found[3] and all("/s.png" not in u for u in found[3]), name


def test_streams(spark, tmp_path):
    from lumenarc.streaming import live

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", NOW), ("a", NOW), ("b", NOW)], "url string, seen_at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("url string, seen_at timestamp").parquet(src)
    q = live.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["url"] for r in spark.table("seen").collect()) == ["a", "b"]


def test_two_readers_of_new_ids_see_the_same(spark):
    n = 40_000  # more rows than are sampled for the bounds of ranges
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lower(F.sha2(F.col("id").cast("string"), 256)).alias("other"))
    made = catalog.with_ids(rows.repartition(3), 5, ["k"])
    both = made.select("id", "k").join(made.select("id", "other"), "id")
    got = sorted(map(tuple, both.collect()))
    assert [i for i, _, _ in got] == list(range(6, n + 6))  # dense, each once
    assert [k for _, k, _ in got] == sorted(k for _, _, k in got)


def test_pages_of_one_file_are_parsed_on_all_cores(spark):
    page = '<ul id="comments"><li class="mcs-comment" data-comment-id="1"><div class="mcs-comment-content-view">x</div></li></ul>'
    one = spark.range(40).coalesce(1).select(F.concat(F.lit("https://en-thunderscans.com/p/"), "id").alias("url"), F.lit(page).alias("html"))
    tasks = comments.comments(one).groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 40 and len(tasks) == spark.sparkContext.defaultParallelism
