import zlib
from collections import Counter

import corpus_pipeline
from lumenarc.llm import packing
from tests.llm.fixtures import documents
from tests.llm.test_operators import brute_components, data


def test_stages_by_brute_force(spark, tmp_path):
    documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if len(seen) <= len(corpus_pipeline.STAGES):
            assert seen[-1].columns == docs.columns
    good, single, clean, mix, packed = seen[1:]
    assert 10 < good.count() < docs.count()
    table = [tuple(r) for r in good.collect()]
    assert {r[0] for r in data(single.select("doc_id"))} == {w[0] for w in brute_components(table) if w[0] is None or w[0] == w[2]}
    assert clean.count() == single.count()
    copies = Counter(r[0] for r in data(mix.select("doc_id")))
    assert max(copies.values()) <= 3 * max(Counter(r[0] for r in data(clean.select("doc_id"))).values())
    want = Counter(zlib.crc32(ids[s : s + n].tobytes()) for (text,) in data(mix.select("text")) for ids in [packing.token_ids(text)] for s, n in packing.cut(len(ids)))
    assert Counter(r[4] for r in data(packed)) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r[:5] for r in data(whole)) == Counter(r[:5] for r in data(packed))


EXTRA = "doc_id long, text string, `a.b` map<string, int>, __id long, `we``ird name` array<map<string, string>>, n_chars int, c0 struct<x: int, `y.z`: string>, source string, whole string, salt int, row string, n long, __row string, __n int"


def test_stages_keep_columns_of_any_type_and_name(spark, tmp_path):
    words = lambda k: " ".join(f"word{k}x{i}" for i in range(40)) + "."
    rest = lambda k: ({"k": k}, 77 + k, [{"q": None}], 0, (k, None), "s", "w", 1, "r", 2, None, 3)
    rows = [(i, words(i // 2) + "\npassword = abcdefghijkl0123 and some more words to stand on this line.", *rest(i)) for i in range(6)]
    rows += [(6, words(9), *rest(6)), (6, words(9), *rest(6)), (6, words(9), *rest(8)), (None, words(10), *rest(7)), (8, None, *rest(1))]
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    schema = docs.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema == schema or docs.columns == schema.names and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
    got = docs.select("doc_id", "text", "`a.b`", "__id", "n_chars", "__n").collect()
    by_id = {r[0]: r for r in got}
    assert set(by_id) == {0, 2, 4, 6, None}
    assert all(r[2] == {"k": r[3] - 77} and r[4] == len(r[1]) and r[5] == 3 for r in got)
    assert all("abcdefghijkl0123" not in r[1] for r in got) and by_id[6][3] in (83, 85)


def test_stages_on_no_rows(spark, tmp_path):
    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, before = stage(spark, docs, str(tmp_path)), docs
        assert docs.count() == 0 and (name == "best_fit_packing" or docs.columns == before.columns)
