import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenarc.llm import scans, trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, c long, one long, d long"


def table(seed=4, n=60, deep=0):
    r = random.Random(seed)
    out = []
    for c in range(n):
        if c % 7 == 3:
            continue  # absent conversations, some of them first of a family
        for t in range(r.choice([0, 1, 2, 5, 9, 14])):
            text = r.choice(["hello", "how are you", "日本語", "", None]) if t < 4 else f"{r.randrange(3)}"
            out.append((c, t * 2 if t else None, r.choice(["user", "assistant", None]), text))
    out += [(-8, 1, "user", "x"), (-10, 0, "user", "y"), (None, 1, "user", "lost")]
    out += [(500, t, "user", f"deep {t % 5}") for t in range(deep)]
    out += [(505, t, "user", f"deep {t % 5}") for t in range(deep // 2)]
    out += [(600, 1, "user", "same")] * 40  # repeated rows
    rest = ("k", 1, 1, 1, 1)
    out = [(*x, *rest) for x in out]
    r.shuffle(out)
    return out


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn if turn is not None else -1, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    rest = lambda c: c - int(c / 5) * 5  # noqa: E731  the remainder that has the sign of c
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - rest(c), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return Counter((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p], ends(p)) for p, of in members.items())


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    for seed, deep in ((4, 0), (5, 150)):
        rows = table(seed, deep=deep)
        got = rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6)))
        assert got == brute(rows) and max(g[1] for g in got) >= deep


def test_turnless_and_empty(spark):
    c = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 0)
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_subtree_totals_of_a_long_chain_with_branches(spark):
    parents = {0: None} | {i: i - 1 if i % 3 else max(0, i - 7) for i in range(1, 200)}
    depth, total = {}, Counter()
    for i, p in parents.items():
        depth[i] = depth[p] + 1 if p is not None else 0
    for i in parents:
        at = i
        while at is not None:
            total[at] += i
            at = parents[at]
    nodes = spark.createDataFrame([(i, p, depth[i], i) for i, p in parents.items()], "key long, parent long, depth long, v long").cache()
    assert dict(map(tuple, trie.subtree_totals(nodes, ["v"]).collect())) == total


def test_running_sums_of_a_group_over_many_tasks(spark):
    r = random.Random(1)
    rows = [(r.choice([7, 7, 7, 7, 1, 9]), i, r.randrange(100)) for i in range(3000)]
    got = scans.running(spark.createDataFrame(rows, "g long, o long, v long").repartition(7), "g", ["o"], ["v"], "test").collect()
    total, want = Counter(), set()
    for g, o, v in sorted(rows):
        total[g] += v
        want.add((g, o, v, total[g]))
    assert {tuple(x) for x in got} == want and len(got) == len(rows)


def test_joined_digests_of_a_large_group(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id").repartition(9)
    of = defaultdict(list)
    for k, i in rows.collect():
        of[k].append(i)
    got = {r.k: (r.sha256, r.n) for r in scans.joined_sha256(rows, "k", "id").collect()}
    assert got == {k: (hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest(), len(v)) for k, v in of.items()}
