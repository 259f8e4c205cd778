import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenarc.llm import decontaminate
from lumenarc.llm.common import staged

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, uid long, wid string, found string, token long, n long"
ITEMS = "item_id long, text string, wid string, words string, class string"


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items):
    windows = {}
    for i, text, *_ in items:
        w = words(text)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    out = Counter()
    for d, text, *_ in docs:
        w, hit, of = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    of |= found
        out[d, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)] += 1
    return out


def table(seed=3, n=80):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a", "is"] * 10 + ["".join(r.choice("abcdefghijé7") for _ in range(r.randint(1, 6))) for _ in range(60)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    items = [(i, text(r.choice([12, 15, 30])), None, "w", "c") for i in range(25)]
    phrase = "answer the following question with one of the given letters only"
    items += [(100 + i, f"{phrase}: {text(8)}", None, None, None) for i in range(6)]  # a window of many items
    items += [(200, "Rare-Short, item!", None, None, None), (201, "yes", None, None, None), (202, "four words of it five six", None, None, None), (203, " .. ", None, None, None), (204, None, None, None, None), (205, "a a a a a a a a a a a a", None, None, None)]
    items += [(7, text(14), None, None, None), (None, items[2][1], None, None, None), items[3], (300, items[3][1], None, None, None)]
    docs = []
    for i in range(n):
        parts = [text(r.choice([0, 3, 40]))]
        for _ in range(r.choice([0, 0, 1, 3])):
            w = r.choice(items)[1] or ""
            cut = w.split()
            lo = r.randrange(max(1, len(cut)))
            parts += [r.choice([w, w.upper(), " ".join(cut[lo : lo + 10]), "--".join(cut[:9])]), text(r.choice([0, 2, 9]))]
        docs.append((i, "\n".join(parts), 1, "w", "f", 1, 1))
    docs += [(None, docs[5][1], None, None, None, None, None), docs[6], (900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (902, "a " * 4000, None, None, None, None, None), (903, text(3000) + " " + items[0][1] * 2, None, None, None, None, None), (904, phrase, None, None, None, None, None)]
    r.shuffle(docs)
    return docs, items


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, seed):
    docs, items = table(seed)
    got = rows_of(decontaminate.decontaminate(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)))
    assert got == brute(docs, items) and 20 < sum(g[5] for g in got) < 85 and max(g[3] for g in got) >= 6


def test_small_bitmap_and_shuffled_windows_give_the_same(spark, monkeypatch):
    docs, items = table()
    monkeypatch.setattr(decontaminate, "MAX_BITS", 16)
    monkeypatch.setattr(decontaminate, "BITS_EACH", 1)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert rows_of(decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = table(n=8)
    none, few = spark.createDataFrame([], ITEMS), spark.createDataFrame(docs, DOCS)
    assert rows_of(decontaminate.decontaminate(few, none)) == brute(docs, [])
    assert decontaminate.decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []


def test_prefix_is_the_rarest_shingle_and_windows_not_held_are_dropped(spark):
    common = "one two three four five six"
    docs = spark.createDataFrame([(i, f"{common} x{i} end") for i in range(30)] + [(99, f"{common} rare tail seven eight")], "doc_id long, text string")
    members = decontaminate.item_windows(spark.createDataFrame([(1, f"{common} rare tail seven eight"), (2, f"{common} never seen at all")], "item_id long, text string"))
    rows = decontaminate.prefixes(docs, members).collect()
    assert len(rows) == 1 and rows[0].offset >= 2 and rows[0].words[-1] == "eight"


def test_bitmap(spark):
    tokens = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    df = staged(spark.createDataFrame([(int(t),) for t in tokens], "token long"), "tokens")
    bitmap = decontaminate.Bitmap(df, 5000)
    assert bitmap.maybe(tokens).all()
    assert bitmap.maybe(np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 20000)).mean() < 0.1


def test_spans_are_merged(spark):
    docs = spark.createDataFrame([(1, "zz " + "a b c d e f g h i j k l " + "zz")], "doc_id long, text string")
    hits, items = decontaminate.contamination(docs, spark.createDataFrame([(5, "a b c d e f g h i j k l")], "item_id long, text string"))
    assert [[tuple(s) for s in r.spans] for r in hits.collect()] == [[(1, 13)]] and [r.item_id for r in items.collect()] == ["5"]
