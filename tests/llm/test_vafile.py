import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenarc.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, key string, q long, code string, c long"


def table(n=400, width=32, seed=2):
    r = random.Random(seed)
    near = [[r.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    vectors = [[float(np.float32(c + r.gauss(0, 0.2))) for c in near[r.randrange(9)]] for _ in range(n)]
    vectors[5:9] = [vectors[4]] * 4  # ties among entries
    out = [(i, v, r.choice([1, 1, 1, 2, None]), "k", 1, "c", 1) for i, v in enumerate(vectors)]
    out += [(None, vectors[3], 2, None, None, None, None), (7, vectors[9], 1, None, None, None, None), out[11]]
    out += [(1000, None, 1, None, None, None, None), (-1, [*vectors[0][:-1], None], 1, None, None, None, None), (-2, [*vectors[0][:-1], math.nan], 1, None, None, None, None), (-3, [math.inf, *vectors[0][1:]], 1, None, None, None, None)]
    out += [(1001, vectors[0][:5], None, None, None, None, None), (1002, [], 3, None, None, None, None)]
    r.shuffle(out)
    return out


def brute(rows, n_parts=16, n_entries=64, rounds=2):
    kept = [(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(v) for _, _, v in kept) // n_parts) * n_parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    d = width // n_parts
    cut = [[tuple(v[p * d : p * d + d]) for p in range(n_parts)] for _, _, v in kept]
    seeds = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:n_entries]
    books = [[cut[k][p] for k in seeds] for p in range(n_parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for round_ in range(rounds + 1):
        found = [[nearest(x, books[p]) for p, x in enumerate(parts)] for parts in cut]
        if round_ < rounds:
            for p in range(n_parts):
                of = defaultdict(list)
                for f, parts in zip(found, cut, strict=True):
                    of[f[p][1]].append(parts[p])
                for k, xs in of.items():
                    books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    errors = [sum(x for x, _ in f) for f in found]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, label, _), f, e in zip(kept, found, errors, strict=True))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = table()
    assert rows_of(vafile.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_fewer_rows_than_entries_and_alike_rows(spark):
    rows = table(12) + [(50 + i, [0.5] * 32, 1, None, None, None, None) for i in range(20)]
    assert rows_of(vafile.compressed(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_and_dropped_rows(spark):
    for rows in ([], [(1, None, 1, None, None, None, None), (2, [math.nan], 1, None, None, None, None)]):
        got = vafile.compressed(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not got.collect()
    got = vafile.compressed(spark.createDataFrame([(1, [], None, None, None, None, None)], SCHEMA)).collect()
    assert [(g.vec_id, g.code, g.error, g.label_error) for g in got] == [(1, "00" * 16, 0, 0)]


def test_great_numbers_saturate(spark):
    got = vafile.compressed(spark.createDataFrame([(i, [3e38 if i == k else -3e38 for k in range(16)]) for i in range(70)], "vec_id long, embedding array<float>").selectExpr("*", "1 as label")).collect()
    assert len(got) == 70 and all(g.error >= 0 for g in got)


@pytest.mark.parametrize("bits", [1, 3, 4, 6])
@pytest.mark.parametrize("spread", [2, 300])
def test_bounds_hold_and_nearest_is_exact(bits, spread):
    r = np.random.default_rng(bits)
    entries, parts = r.integers(-spread, spread, (64, 4)), r.integers(-spread, spread, (5000, 4))
    file = vafile.Cells(entries, bits)
    apart = ((parts[None] - entries[:, None]) ** 2).sum(axis=2)
    lower, upper = file.bounds(parts)
    assert (lower <= apart).all() and (apart <= upper).all()
    index, least = file.nearest(parts)
    assert (index == apart.argmin(axis=0)).all() and (least == apart.min(axis=0)).all()
    if bits >= 4 and spread == 300:
        assert (lower <= upper.min(axis=0)).mean() < 0.35


def test_decoded_is_as_far_as_the_error_says(spark):
    rows = vafile.integers(spark.createDataFrame(table(100), SCHEMA).where("size(embedding) = 32"))
    books = vafile.fitted(rows)
    back = vafile.decoded(vafile.encoded(rows, books), books).where("vec_id < 90 and vec_id <> 7 and vec_id <> 11").collect()
    own = {r.vec_id: r.q for r in rows.collect()}
    assert len(back) > 80 and all(sum((a - b) ** 2 for a, b in zip(own[r.vec_id], r.q, strict=True)) == r.error for r in back)
