"""Discovery and paged feeds on small recorded pages."""

import json

from lumenarc.operators import discovery


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_links_of_broken_markup(spark):
    html = "<a href='/b#x'>B</a><a href=/b>again</a><a>none</a><a href='#'>top</a><a href='http://[bad'>x</a><p><a href=\"c\"><b>See</b> c"
    got = rows(discovery.page_links(pages(spark, ("https://h.x/a/", html), ("https://h.x/e", None))))
    assert got == [("https://h.x/a/", 0, "https://h.x/b", "B"), ("https://h.x/a/", 1, "https://h.x/a/c", "See c")]


def test_cycles_end_and_the_first_place_wins(spark):
    table = pages(spark, ("https://h.x/a", '<a href="/b"></a><a href="/c"></a><a href="https://o.x/"></a>'), ("https://h.x/b", '<a href="/c"></a><a href="/a"></a>'), ("https://h.x/c", '<a href="/d"></a><a href="/c"></a>'), ("https://h.x/z", '<a href="/y"></a>'))
    seeds = table.where("url like '%/a'").select("url")
    want = [("https://h.x/a", 0, None, None), ("https://h.x/b", 1, "https://h.x/a", 0), ("https://h.x/c", 1, "https://h.x/a", 1), ("https://h.x/d", 2, "https://h.x/c", 0)]
    assert rows(discovery.reachable(table, seeds)) == want
    assert ("https://o.x/", 1, "https://h.x/a", 2) in rows(discovery.reachable(table, seeds, 1, within=False))
    assert rows(discovery.reachable(table, seeds.limit(0))) == []


def replies(spark, sizes, feed="f"):
    made = [(feed, page, f"u{page}", json.dumps({"items": [{"id": page * 1000 + i} for i in range(n)], "next": f"u{page + 1}"})) for page, n in sizes.items()]
    return spark.createDataFrame(made, "feed string, page int, url string, body string")


def test_feeds_end_at_short_pages(spark):
    for limit in (40, 100):
        for last in (limit - 1, 0):
            got = discovery.paged(replies(spark, {1: limit, 2: limit, 3: last, 4: limit}), "items", "id: bigint", limit)
            assert got.count() == 2 * limit + last
        assert discovery.paged(replies(spark, {1: limit, 3: limit}), "items", "id: bigint", limit).count() == limit
        assert discovery.paged(replies(spark, {2: limit}), "items", "id: bigint", limit).count() == 0
    assert discovery.paged(replies(spark, {k: 2 for k in range(1, 60)}), "items", "id: bigint", 2).count() == 100
    broken = spark.createDataFrame([("f", 1, "no json"), ("f", 2, "{}"), ("g", 1, '{"items": [{"id": 1}, {"id": null}]}')], "feed string, page int, body string")
    assert rows(discovery.paged(broken, "items", "id: bigint", 2)) == [("g", 1, 0, 1), ("g", 1, 1, None)]


def test_cursors_end_at_missing_pages_loops_and_the_cap(spark):
    starts = spark.createDataFrame([("f", "u1"), ("g", "u2"), ("h", "nowhere")], "feed string, url string")
    got = discovery.followed(replies(spark, {1: 1, 2: 2, 3: 1}), starts, "items", "id: bigint")
    assert sorted((r.feed, r.id) for r in got.collect()) == [("f", 1000), ("f", 2000), ("f", 2001), ("f", 3000), ("g", 2000), ("g", 2001), ("g", 3000)]
    loop = spark.createDataFrame([("u1", '{"items": [{"id": 1}], "next": "u2"}'), ("u2", '{"items": [{"id": 2}], "next": "u1"}')], "url string, body string")
    assert discovery.followed(loop, starts.where("feed = 'f'"), "items", "id: bigint").count() == 2
    assert discovery.followed(loop, starts.where("feed = 'f'"), "items", "id: bigint", most=1).count() == 1


def test_replies_are_read_once_whatever_the_rounds(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(body):
        read.add(1)
        return body

    starts = spark.createDataFrame([("f", "u1")], "feed string, url string")
    table = replies(spark, {k: 1 for k in range(1, 5)}).withColumn("body", noted("body"))
    assert discovery.followed(table, starts, "items", "id: bigint").count() == 4
    assert read.value == 4
