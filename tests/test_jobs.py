"""Jobs and analysis replies on small tables."""

from pyspark.sql import functions as F

from lumenarc.functions import analysis
from lumenarc.operators import jobs


def now():
    return F.timestamp_seconds(F.lit(10_000))


def test_resumable_params(spark):
    params = ['{"url": "u", "urls": ["a", ""], "scope": "series", "force_rescan": true}', '{"url": "u", "owner": "backfill"}', '{"url": ""}', "[1]", "{", "", None, '{"url": "x", broken']
    rows = spark.createDataFrame([(i, "crawl", p) for i, p in enumerate(params)] + [(99, "duplicates", params[0])], "id long, job_type string, params string")
    assert [tuple(r) for r in jobs.resumable(rows).collect()] == [(0, "u", "series", ["a"], True)]


def test_due_series_wait_for_running_crawls(spark):
    rows = spark.createDataFrame([(1, True, None), (2, True, 9_000), (3, True, 1_000), (4, False, None)], "id long, enabled boolean, at long").select("id", "enabled", F.timestamp_seconds("at").alias("last_scanned_at"))
    none = spark.createDataFrame([("crawl", "failed"), ("duplicates", "running")], "job_type string, status string")
    live = spark.createDataFrame([("crawl", "running")], "job_type string, status string")
    assert [r.id for r in jobs.due_series(rows, none, now()).collect()] == [1, 3]
    assert jobs.due_series(rows, live, now()).count() == 0


def test_empty_totals_are_done(spark):
    row = spark.createDataFrame([(0, 0)], "done int, total int").select(jobs.crawl_progress("done", "total"), jobs.crawl_progress("done", "total", "done", "total")).first()
    assert tuple(row) == (0.6, 1.0)


def test_missing_thumbnails(spark):
    rows = spark.createDataFrame([(3, None), (1, None), (2, "x")], "id long, thumbnail_path string")
    assert {r.id for r in jobs.without_thumbnail(rows).collect()} == {1, 3}
    assert [r.id for r in jobs.without_thumbnail(rows, 1).collect()] == [1]


def test_replies(spark):
    cases = {"{}": None, "null": "object", "nope": "object", '"x"': "object", '{"meme_context": []}': "meme_context", '{"tags": "a"}': "tags", '{"subjects": [[]]}': "subjects", '{"tags": ["é"], "other": 1}': None}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string").select("v", analysis.normalized("v").alias("x")).collect()
    assert {r.v: r.x.error for r in rows} == {**cases, None: "object"}
    assert [r.x.tags for r in rows if r.x.error is None] == [[], ["é"]]
