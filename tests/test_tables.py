"""Versioned schemas, runs that are single and cancelled, and helpers that no query shows."""

import json
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import text as T
from lumenarc.operators import catalog, history, workqueue
from lumenarc.sources import tables, versions
from lumenarc.streaming import control, passes


def test_rows_of_all_versions_read_as_the_newest(spark, tmp_path):
    folder = str(tmp_path / "media")
    assert versions.read(spark, folder, "media").count() == 0 and versions.newest("media") == 4
    for v in range(1, 5):
        row = {"id": v, "sha256": f"s{v}", "title": "t", "attempts": 3, "next_retry_at": datetime(2026, 1, 1), "failed_at": datetime(2026, 1, 2), "error_retryable": True, "revives": 2}
        names = [f.name for f in versions.schema("media", v)]
        versions.append(spark.createDataFrame([tuple(row.get(n) for n in names)], versions.schema("media", v)), folder, "media", v)
    got = versions.read(spark, folder, "media")
    assert got.schema == versions.schema("media") and len(versions.schema("media", 1)) == len(got.columns) - 6
    seen = [(r.id, r.sha256, r.title, r.attempts, r.next_retry_at is None, r.failed_at is None, r.error_retryable, r.revives) for r in got.orderBy("id").collect()]
    assert seen == [(1, "s1", None, 0, True, True, False, 0), (2, "s2", "t", 0, True, True, False, 0), (3, "s3", "t", 3, False, True, False, 0), (4, "s4", "t", 3, False, False, True, 2)]
    for name in versions.CHAINS:
        assert versions.read(spark, str(tmp_path / name / "none"), name).columns == versions.schema(name).names
    with pytest.raises(ValueError):
        versions.schema("media", 5)


ITEMS = "id long, processing_status string, attempts int, next_retry_at timestamp, failed_at timestamp, error_retryable boolean, revives int, has_analysis boolean"


def test_one_drain_at_a_time_and_a_cancelled_one_goes_on(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "DOWNLOADED", 0, None, None, None, 0, False) for i in range(5)], ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder, refused, calls = str(tmp_path / "out"), [], []

    def drain():
        return passes.drained(spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), process, folder, F.timestamp_seconds(F.lit(9)))

    def process(claimed):
        calls.append(1)
        if len(calls) == 1:
            try:
                drain()
            except control.AlreadyRunning as e:
                refused.append(e)
            assert control.running(spark, folder) and control.cancel(spark, folder)
        return claimed.select("id", F.lit("ready").alias("outcome"), F.lit(False).alias("retryable"), F.lit(None).cast("string").alias("error"))

    assert drain() is False and len(refused) == 1 and len(calls) == 1 and not control.running(spark, folder)
    assert drain() is True and len(calls) == 3
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/items").where("processing_status = 'READY'").collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24]
    assert not control.cancel(spark, folder)


def test_jobs_of_a_tag_are_interrupted(spark):
    def slowly(batches):
        time.sleep(20)
        yield from batches

    def soon():
        while not spark.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.2)
        control.cancel(spark, "slow work", at_once=True)

    with control.single(spark, "slow work"):
        timer = threading.Thread(target=soon)
        timer.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 4, 1, 4).mapInArrow(slowly, "id long").count()
        timer.join()
    assert spark.range(3).count() == 3


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_types_lengths_and_texts(spark):
    assert one(spark, T.mime_of("m", "e"), m="Image/PNG", e="gif") == "image/png"
    assert one(spark, T.mime_of("m", "e"), m="", e=".JPEG") == "image/jpeg" and one(spark, T.mime_of("m", "e"), m="", e="odd") == "image/jpeg"
    assert one(spark, T.sniffed_video("b"), b=b"\0\0\0\x18ftypmp42") == "video/mp4" and one(spark, T.sniffed_video("b"), b=b"\0\0\0\x18ftyp") is None
    assert one(spark, T.sniffed_video("b"), b=b"\x1a\x45\xdf\xa3") == "video/webm"
    assert [one(spark, T.content_length("n"), n=n) for n in (" 12 ", "-1", "x", "")] == [12, None, None, None]
    texts = spark.createDataFrame([("a", ["b", "", None], "f"), (None, None, "f"), ("", [], None)], "d string, t array<string>, f string")
    assert [r.x for r in texts.select(T.embedding_text("d", "t", "f").alias("x")).collect()] == ["a b", "f", "untagged media"]
    vectors = spark.createDataFrame([([1.0, 2.0],), ([],), ([1.0, None],), ([float("nan")],), (None,)], "v array<double>")
    assert [r.x for r in vectors.select(T.valid_embedding("v").alias("x")).collect()] == [True, False, False, False, False]


def test_feed_items_and_bytes(spark, tmp_path):
    replies = spark.createDataFrame([(1, json.dumps({"data": [{"id": 1}, {"id": 2}]})), (2, "no"), (3, "{}")], "page int, body string")
    assert sorted(map(tuple, tables.feed_items(replies, "id: bigint").collect())) == [(1, 0, 1), (1, 1, 2)]
    (tmp_path / "x").write_bytes(b"abc")
    (row,) = tables.media_bytes(spark, str(tmp_path)).collect()
    assert row.file_size == 3 and row.sha256.startswith("ba7816bf") and bytes(row.content) == b"abc"


def test_rows_by_hand(spark):
    now = F.timestamp_seconds(F.lit(1000))
    items = spark.createDataFrame([(1, "FAILED", 3, None, None, True, 2, True), (2, "FAILED", 3, None, None, True, 2, True)], ITEMS)
    got = {r.id: (r.processing_status, r.attempts, r.revives) for r in workqueue.reset(items, 1).collect()}
    assert got == {1: ("ANALYZED", 0, 0), 2: ("FAILED", 3, 2)}
    jobs = spark.createDataFrame([(1, "running", None, 900), (2, "running", "own", 998), (3, "done", None, 1), (4, "running", None, None)], "id long, status string, error string, s long").select("id", "status", "error", F.timestamp_seconds("s").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    assert {r.id: (r.status, r.error) for r in workqueue.recovered(jobs, now).collect()} == {1: ("failed", "interrupted by restart"), 2: ("failed", "own"), 3: ("done", None), 4: ("failed", "interrupted by restart")}
    assert {r.id for r in workqueue.stale(jobs, now).collect()} == {1, 4}
    again = spark.createDataFrame([(1, "failed", "e"), (2, "done", "e")], "id long, status string, error string")
    assert sorted(map(tuple, workqueue.requeued(again).collect())) == [(1, "pending", None), (2, "done", "e")]


def test_picks_watch_lists_and_provenance(spark):
    media = spark.createDataFrame([(1, True, "png"), (2, False, "gif"), (3, False, "png")], "id long, is_favorite boolean, extension string")
    assert catalog.random_pick(media, "favorites").first().id == 1 and catalog.random_pick(media, "gifs", 3).first().id == 2
    assert catalog.random_pick(media).count() == 1 and catalog.random_pick(media.limit(0)).count() == 0
    table = spark.createDataFrame([("a", "s", "Mine", False, None), ("b", "s", None, True, datetime(2026, 1, 1))], "url string, site string, title string, enabled boolean, last_scanned_at timestamp")
    scans = spark.createDataFrame([("a", "t", datetime(2026, 2, 1)), ("c", "u", datetime(2026, 2, 2)), ("a", "s2", datetime(2026, 1, 9))], "url string, site string, at timestamp")
    got = sorted((r.url, r.site, r.title, r.enabled, r.last_scanned_at.month) for r in history.watched(table, scans).collect())
    assert got == [("a", "t", "Mine", False, 2), ("b", "s", None, True, 1), ("c", "u", None, True, 2)]
    refs = spark.createDataFrame([("p", "", None, None), ("p", "own", "c9", 9), ("q", None, None, None)], "page string, page_url string, chapter string, page_number int")
    pages = spark.createDataFrame([("p", "c1", 4)], "url string, chapter string, page_number int")
    assert sorted(map(str, history.with_provenance(refs, pages).select("page_url", "chapter", "page_number").collect())) == sorted(["Row(page_url='p', chapter='c1', page_number=4)", "Row(page_url='own', chapter='c9', page_number=9)", "Row(page_url=None, chapter=None, page_number=None)"])


def test_patches_set_nulls_where_they_say_so(spark):
    media = spark.createDataFrame([(1, "t", True), (2, "u", False), (3, "v", True)], "id long, title string, is_favorite boolean")
    changes = spark.createDataFrame([(1, None, False, ["title"]), (2, "w", None, ["title", "id"]), (9, "x", None, ["title"])], "id long, title string, is_favorite boolean, given array<string>")
    assert sorted(map(tuple, catalog.patched(media, changes).collect())) == [(1, None, True), (2, "w", False), (3, "v", True)]
    assert sorted(map(tuple, catalog.patched(media, changes.drop("given")).collect())) == [(1, "t", False), (2, "w", False), (3, "v", True)]
