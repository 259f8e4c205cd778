"""Ingest, media bytes and passes that are interrupted."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import media as M
from lumenarc.operators import duplicates, hybrid, ingest
from lumenarc.streaming import passes

MEDIA = "id long, sha256 string, created_at timestamp, dup_status string, dup_flagged_at timestamp, dup_of_media_id long"


def now(seconds=10_000):
    return F.timestamp_seconds(F.lit(seconds))


def test_flags_of_any_order_of_batches(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.randrange(5), "unflagged" if i % 9 == 0 else "nondup") for i in range(40)]
    frame = lambda part: spark.createDataFrame(part, "id long, sha256 string, at long, dup_status string").select("id", "sha256", F.timestamp_seconds("at").alias("created_at"), "dup_status", F.lit(None).cast("timestamp").alias("dup_flagged_at"), F.lit(None).cast("long").alias("dup_of_media_id"))
    want = sorted(map(tuple, duplicates.flagged(frame(rows), now()).select("id", "dup_status", "dup_flagged_at", "dup_of_media_id").collect()))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        media = frame(rows[:0])
        for k in range(0, 40, 16):
            changes = ingest.delta_flags(media, frame(rows[k : k + 16]), now())
            media = spark.createDataFrame(ingest.merged(media, changes).collect(), MEDIA)
        assert sorted(map(tuple, media.select("id", "dup_status", "dup_flagged_at", "dup_of_media_id").collect())) == want
    quiet = ingest.delta_flags(media, frame([(99, "new", 1, "nondup")]), now())
    assert [r.id for r in quiet.collect()] == [99]  # other groups are neither read nor written


def test_counts_of_a_pass_come_with_its_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1, "nondup"), (2, "a", 2, "nondup"), (3, "b", 1, "unflagged")], "id long, sha256 string, at long, dup_status string").select("id", "sha256", F.timestamp_seconds("at").alias("created_at"), "dup_status", F.lit(None).cast("timestamp").alias("dup_flagged_at"), F.lit(None).cast("long").alias("dup_of_media_id"))
    out, counts = ingest.dup_pass(rows, now())
    assert sorted((r.id, r.dup_status, r.purged) for r in out.collect()) == [(1, "nondup", False), (2, "dup", False), (3, "unflagged", False)]
    assert counts.get == {"scanned": 2, "flagged": 1, "purged": 0}


HEADS = {"image/jpeg": b"\xff\xd8\xff\xe0", "image/png": b"\x89PNG\r\n\x1a\n", "image/gif": b"GIF87a", "image/webp": b"RIFF\0\0\0\0WEBPVP8 ", "video/mp4": b"\0\0\0\x18ftypmp42", "video/webm": b"\x1a\x45\xdf\xa3"}


def test_magic_numbers(spark):
    cases = {v: k for k, v in HEADS.items()} | {b"GIF88a": None, b"RIFF\0\0\0\0AVI ": None, b"\0\0\0\x18ftyp": None, b"\0\0\0\x18ftypx": None, b"\x89PNG\r\n\x1a": None, b"": None, b"<svg": None, b"RIFFWEBP": None}
    got = {bytes(r.b): r.t for r in spark.createDataFrame([(bytearray(b),) for b in cases], "b binary").select("b", M.sniffed("b").alias("t")).collect()}
    assert got == cases
    rows = [("image/gif", "png", True, False), ("IMAGE/GIF", None, True, False), (None, ".GIF", True, False), ("", "gif", True, False), ("image/png", "gif", False, False), ("video/mp4", None, False, True), (None, "mkv", False, True), ("image/png", "avi", False, True), (None, None, False, False)]
    df = spark.createDataFrame(rows, "m string, e string, g boolean, v boolean").select("*", M.is_gif("m", "e").alias("is_g"), M.is_video("m", "e").alias("is_v"))
    assert all((r.g, r.v) == (r.is_g, r.is_v) for r in df.collect())


def test_files_are_read_once_for_hash_and_verdict(spark, tmp_path):
    files = {"a.jpg": HEADS["image/jpeg"] + b"x", "b.png": HEADS["image/gif"], "c.bin": HEADS["video/mp4"], "d.gif": b"no"}
    (tmp_path / "deep").mkdir()
    for name, content in files.items():
        (tmp_path / ("deep" if name[0] > "b" else "") / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256, r.kind, r.problem) for r in M.media_files(spark, str(tmp_path)).collect()}
    sha = lambda n: hashlib.sha256(files[n]).hexdigest()
    assert got == {"a.jpg": (5, sha("a.jpg"), "image", None), "b.png": (6, sha("b.png"), None, "mismatch"), "c.bin": (12, sha("c.bin"), "video", None), "d.gif": (2, sha("d.gif"), None, "unknown content")}


ITEMS = "id long, processing_status string, attempts int, next_retry_at timestamp, failed_at timestamp, error_retryable boolean, revives int, has_analysis boolean"


def test_a_drain_that_is_killed_goes_on_without_loss(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(10 * k + i, "DOWNLOADED" if i % 4 else "READY", 0, None, None, None, 0, False) for i in range(10)], ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = {"n": 0, "break": 3}

    def process(claimed):
        calls["n"] += 1
        if calls["n"] == calls["break"]:
            raise RuntimeError("killed")
        return claimed.select("id", F.when(F.col("id") % 5 > 0, "ready").otherwise("error").alias("outcome"), F.lit(True).alias("retryable"), F.lit("busy").alias("error"))

    def run(folder):
        stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        passes.drained(stream, process, str(tmp_path / folder), now())

    with pytest.raises(Exception, match="killed"):
        run("a")
    run("a")
    calls["break"] = 0
    run("b")
    table = lambda folder: sorted((r.id, r.processing_status, r.attempts) for r in spark.read.parquet(str(tmp_path / folder / "items")).collect())
    assert table("a") == table("b") and len(table("a")) == 40
    a, b = (passes.drain_summary(spark, str(tmp_path / f)).first() for f in "ab")
    assert tuple(a)[:4] == tuple(b)[:4] == (28, 24, 0, 4) and a.last_error.endswith(": busy")


def test_watch_pass(spark, tmp_path):
    watched = spark.createDataFrame([(i, f"https://{'ok' if i % 4 else 'odd'}.x/{i}", i != 5) for i in range(1, 13)], "id long, url string, enabled boolean")
    jobs = [(1, "crawl", "running", '{"owner": "watch"}'), (2, "duplicates", "running", None), (3, "crawl", "failed", "{}")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, job_type string, status string, params string")
    supported = F.contains("url", F.lit("ok"))
    asked = []

    def scan(part):
        asked.extend(r.id for r in part.select("id").collect())
        return part.select("id", F.when(F.col("id") == 7, "timeout").alias("error"))

    live = frame([*jobs, (9, "crawl", "running", '{"url": "u"}')])
    assert passes.watch_pass(watched, lambda: live, scan, str(tmp_path / "s"), supported).skipped and not asked
    polls = iter([frame(jobs), frame(jobs), live])
    first = passes.watch_pass(watched, lambda: next(polls), scan, str(tmp_path / "p"), supported, size=5)
    assert first.abandoned and first.parts == 1 and 0 < len(asked) < 8
    again = passes.watch_pass(watched, lambda: frame(jobs), scan, str(tmp_path / "p"), supported, size=5)
    assert again.abandoned is None and sorted(asked) == [1, 2, 3, 6, 7, 9, 10, 11]  # each once
    failures = sorted((r.id, r.error) for r in spark.read.parquet(str(tmp_path / "p" / "failures")).collect())
    assert [i for i, _ in failures] == [4, 7, 8, 12] and failures[1][1] == "timeout"
    assert passes.watch_pass(watched.where("id < 0"), lambda: frame(jobs), scan, str(tmp_path / "e"), supported) == passes.Pass()


def test_a_page_brings_the_total(spark):
    hits = spark.range(57).select("id", (F.col("id") % 10).cast("double").alias("score"))
    rows = hybrid.result_page(hits, 3, 20, [F.col("score").desc(), F.col("id")]).collect()
    assert len(rows) == 17 and {r.total for r in rows} == {57} and sorted(rows, key=lambda r: (-r.score, r.id))[-1].id == 50
    assert hybrid.result_page(hits.limit(0), 1, 20, [F.col("id")]).collect() == []
