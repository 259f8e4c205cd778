import math
import struct

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import hybrid, keyword, mock, vectors

ROWS = [(1, "a confused cat stares blankly", '["cat"]', "cat.png", "siteA chapter-1"), (2, "big changes in a mood ring", '["ring"]', "ring.png", "siteA chapter-2"), (3, "honestly this is a big mood", '["confused"]', "mood.png", "siteB chapter-1")]


@pytest.fixture(scope="module", params=["scanned", "stored"])
def index(spark, request, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id long, description string, tags string, filename string, source_text string")
    return keyword.indexed(rows) if request.param == "scanned" else keyword.stored(rows, str(tmp_path_factory.mktemp("index")))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_query_language():
    assert keyword.sanitized("foo OR (bar") == '"foo" AND "bar"*'
    assert keyword.sanitized("AND OR NOT") == ""
    assert keyword.sanitized('"big mood" x"') == '"big mood" AND "x"'
    assert keyword.sanitized('foo "bar baz') == '"foo" AND "bar" AND "baz"*'
    assert keyword.sanitized('conf "cat" !') == '"cat" AND "conf"*'
    assert keyword.sanitized('"a b') == '"a" AND "b"*' and keyword.sanitized('"cat"') == '"cat"' and keyword.sanitized('""') == ""


def test_prefix_phrase_columns(index):
    assert sorted(ids(keyword.bm25(index, "conf"))) == [1, 3]
    assert ids(keyword.bm25(index, '"big mood"')) == [3]
    assert ids(keyword.bm25(index, "confused", ("tags",))) == [3]
    assert ids(keyword.bm25(index, "")) == []
    with pytest.raises(ValueError):
        keyword.bm25(index, "x", ("nope",))


def test_score_by_hand(index):
    got = {r["id"]: r["score"] for r in keyword.bm25(index, '"stares"').collect()}
    lengths = [len(" ".join(r[1:4]).replace(".", " ").split()) + 3 for r in ROWS]  # 'siteA chapter-1' is three tokens
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5))
    assert got[1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[0] / (sum(lengths) / 3))))


def test_overlapping_phrase(spark):
    t = keyword.indexed(spark.createDataFrame([(1, "a a a")], "id long, description string"), ("description",))
    assert t.select(keyword.occurrences(F.col("description"), (("a", "a"), False)).alias("n")).first()["n"] == 2


def test_stored_index_against_the_scan(spark, tmp_path):
    from random import Random

    r = Random(5)
    words = ["a", "b", "ab", "abc", "čaj", "Ő", "e\u0301t", "ﬁn"]
    rows = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))), r.choice([None, "a", "b ab"])) for i in range(40)], "id long, x string, y string")
    kept, scanned = keyword.stored(rows, str(tmp_path / "i"), ("x", "y")), keyword.indexed(rows, ("x", "y"))
    for query in ('"a"', "a", '"a b"', '"a a"', '"ab abc a" b', "caj", "čaj o", "ét", '"b ab" "a" ab', '"zz"', "b \"a"):
        for columns in (None, ("y",)):
            a, b = (sorted((x["id"], round(x["score"], 9)) for x in keyword.bm25(i, query, columns).collect()) for i in (kept, scanned))
            assert a == b, (query, columns)
    assert ids(keyword.bm25(kept, '"caj"')) and ids(keyword.bm25(kept, '"o"')) and ids(keyword.bm25(kept, '"et"'))


def test_index_heals_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one cat"), (2, "two")], "id long, x string")
    folder = str(tmp_path / "i")
    assert keyword.opened(spark, folder) is None
    assert ids(keyword.bm25(keyword.healed(rows, folder, ("x",)), '"cat"')) == [1]
    more = rows.union(spark.createDataFrame([(3, "a cat")], rows.schema))
    assert sorted(ids(keyword.bm25(keyword.healed(more, folder, ("x",)), '"cat"'))) == [1, 3]
    empty = keyword.healed(rows.limit(0), str(tmp_path / "e"), ("x",))
    assert ids(keyword.bm25(empty, '"cat"')) == []


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_segments_against_a_full_rebuild(spark, tmp_path):
    from random import Random

    r = Random(7)
    text = lambda: " ".join(r.choice(["a", "b", "ab", "abc", "caj"]) for _ in range(r.randint(0, 9)))
    frame = lambda t: spark.createDataFrame([(i, *v) for i, v in t.items()], "id long, x string, y string")
    table, folder = {i: (text(), text()) for i in range(40)}, tmp_path / "i"
    keyword.stored(frame(table), str(folder), ("x", "y"))
    for step in range(1, 4):
        before = files(folder)
        gone, new = r.sample(sorted(table), 3), {r.randrange(60): (text(), None) for _ in range(4)}
        for i in gone:
            table.pop(i)
        table |= new
        if step == 2:  # rows by hand
            got = keyword.replaced(frame(new), str(folder), spark.createDataFrame([(i,) for i in set(gone) - set(new)], "id long"))
        elif step == 3:
            keyword.updated(frame(table), str(folder))
            got = keyword.compacted(spark, str(folder))
        else:
            got = keyword.updated(frame(table), str(folder))
        assert before.items() <= files(folder).items()  # old segments are as they were
        whole = keyword.stored(frame(table), str(tmp_path / f"w{step}"), ("x", "y"))
        assert tuple(got.figures.first()) == pytest.approx(tuple(whole.figures.first()))
        for query in ('"a b" ab', '"b" "a"'):
            a, b = (sorted((x["id"], round(x["score"], 9)) for x in keyword.bm25(i, query).collect()) for i in (got, whole))
            assert a == b, (step, query)


def test_an_edit_of_equal_count_is_seen_and_nothing_else_is_written(spark, tmp_path):
    frame = lambda *t: spark.createDataFrame(list(enumerate(t)), "id long, x string")
    folder = str(tmp_path / "i")
    keyword.healed(frame("one cat", "two"), folder, ("x",))
    before = files(tmp_path)
    assert ids(keyword.bm25(keyword.healed(frame("one cat", "two"), folder, ("x",)), '"cat"')) == [0]
    assert files(tmp_path) == before
    assert ids(keyword.bm25(keyword.healed(frame("one", "two cat"), folder, ("x",)), '"cat"')) == [1]
    later = keyword.opened(spark, folder)
    assert ids(keyword.bm25(later, '"two"')) == [1] and ids(keyword.bm25(later, '"one"')) == [0]


def test_entries_are_passed_on_in_slices():
    import pyarrow as pa

    texts = [" ".join(f"w{i * 7 + k}" for k in range(100)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], names=["id", "sig", "x"])
    made = list(keyword.entries(iter([batch, batch.slice(0, 1)])))
    assert sum(b.num_rows for b in made) == 100_100 and max(b.num_rows for b in made) < keyword.ENTRIES + 100
    assert [x for b in made for x in b.column("sig").to_pylist() if x is not None] == [*range(1000), 0]


def test_a_blank_query_needs_no_index(spark, monkeypatch):
    from lumenarc.plans import registry

    monkeypatch.setattr(registry, "_index", None)
    assert registry.filters_only(spark, "/root/testdata/sf0.001").count() > 0


def test_best_of_several_sets_in_one_pass(index):
    hits = keyword.best(index, "confused", {"all": None, "tags": ("tags",), "name": ("filename",)}, 2).collect()
    for name, columns in (("all", None), ("tags", ("tags",)), ("name", ("filename",))):
        alone = {r["id"]: r["score"] for r in keyword.bm25(index, "confused", columns, 2).collect()}
        assert {h["id"]: h["score"] for h in hits if h["name"] == name} == pytest.approx(alone)
        assert all(h["top"] == pytest.approx(max(alone.values())) for h in hits if h["name"] == name)
    assert keyword.best(index, " ", {"all": None}, 2).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], "m"), (2, [0.0, 1.0, 0.0], "other"), (3, [0.0, 0.0], "m"), (4, [0.0, 0.0, 0.0], "m")]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, model string")
    assert [(r["id"], r["cosine"]) for r in vectors.cosine_top(v, [2.0, 0, 0], 10, "m").collect()] == [(1, 1.0), (4, 0.0)]
    assert vectors.cosine_top(v, [0.0, 0, 0]).isEmpty() and vectors.cosine_top(v, []).isEmpty()
    blobs = spark.createDataFrame([(bytearray(struct.pack("<2f", 1, 2)),), (bytearray(b"xy"),), (bytearray(b""),)], "b binary")
    assert [r["v"] for r in blobs.select(vectors.decoded("b").alias("v")).collect()] == [[1.0, 2.0], None, None]


def test_fusion(index, spark):
    mode, hits = hybrid.search(index, "confused")
    assert mode == "keyword_only" and ids(hits)[0] == 3
    v = spark.createDataFrame([(3, [1.0, 0.0], "m")], "id long, embedding array<float>, model string")
    mode, hits = hybrid.search(index, "confused", v, [1.0, 0.0])
    assert mode == "hybrid" and ids(hits)[0] == 3
    w = hybrid.Weights(0, 1.0, 0, 0).without_semantic()
    assert all(x == pytest.approx(1 / 3) for x in w.values())
    with pytest.raises(ValueError):
        hybrid.Weights(0.5, 0.6, 0, 0)


def test_tag_fallback(spark, index):
    rows = spark.createDataFrame([(9, "fresh edited tags")], "id long, tags string")
    assert ids(hybrid.tag_scores(index, "edited", rows, F.col("tags"))) == [9]
    assert ids(hybrid.tag_scores(index, "confused", rows, F.col("tags"))) == [3]


def test_reindex(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert sorted(map(tuple, keyword.reindexed(old, spark.createDataFrame([(2, "c")], "id long, t string")).collect())) == [(1, "a"), (2, "c")]


def test_mock(spark):
    import hashlib

    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "t string").select("t", mock.embedding(F.col("t"), 8).alias("v"), mock.picked(F.sha2("t", 256), ["a", "b", "c", "d", "e"], 2, 4).alias("w"), mock.analyzed(F.encode("t", "UTF-8"), F.lit("image/png"), ["p", "q", "r", "s", "t"]).alias("r")).collect()
    assert rows[0] == rows[1] != rows[2]
    for r in rows:
        assert sum(x * x for x in r["v"]) == pytest.approx(1, abs=1e-5)
        raw = [int.from_bytes(hashlib.shake_256(r["t"].encode()).digest(32)[i : i + 4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(0, 32, 4)]
        assert r["v"] == pytest.approx([x / math.sqrt(sum(y * y for y in raw)) for x in raw], abs=1e-6)
        assert r["w"] == list(dict.fromkeys("abcde"[b % 5] for b in hashlib.sha256(r["t"].encode()).digest()[4:]))[:2]
        digest = hashlib.sha256(b"image/png" + r["t"].encode()).digest()
        tags = list(dict.fromkeys("pqrst"[b % 5] for b in digest))[:4]
        assert r["r"]["tags"] == tags and r["r"]["description"] == f"Mock image mime=image/png size=1 analysis hash={digest.hex()[:8]}"
        assert r["r"]["suggested_search_phrases"] == [f"{tags[0]} reaction", f"mock meme {digest.hex()[:8]}"] and len(r["r"]["subjects"]) == 1
