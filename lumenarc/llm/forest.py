"""MinHash near-duplicate groups by an LSH forest.

Texts are reduced to sets of five-word shingles; equal sets become one node. Each node has 64 minimum hashes, read in
16 orders, each of which begins at another of them. Nodes that share the first DEPTH hashes of an order are a region
there. In each order, sorted, a node's candidates are its neighbour with the longest common prefix and the leader of
its region, which is taken as deep as needed for at most REGION nodes. Candidates whose size and signature allow the
similarity are confirmed on full sets, the best of each node; confirmed links merge nodes into components. Then every
region that still holds several components is worked off exactly: its nodes outside the largest component meet all its
nodes, block by block, on full sets. Two sets of similarity 0.85 share no region with probability below 1e-5.

Nulls: a null text has no words, so no set and no links; a row with a null id stands alone. Repeated rows and rows
with equal sets are one node. Texts of fewer than five words are one shingle. An empty table gives no rows.
near_duplicates() doesn't read extra columns, one_of_each() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm import kernels as K
from lumenarc.llm.common import partitions, passing, staged, text_or_empty, whole_row, with_counts
from lumenarc.llm.components import labels

SHINGLE = 5
PERCENT = 85
HASHES = 64
DEPTH = 4
ORDERS = HASHES // DEPTH
LEVELS = 16
REGION = 64
#: Of 64 signature bits, at similarity 0.85 on average 4.8 differ, with deviation 2.1.
MAX_BITS = 18
FIRST_CHOICES = 2
SALTS = 8
#: Nodes of a block, and the text held before complete groups are worked off.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: So many ids, at 16 bytes each, are broadcast to pick their texts; beyond that the texts are shuffled.
SMALL_IDS = 100_000
_MULTIPLIERS = K.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle, ordered by text and hash."""
    buf = K.LOWER[chunk.buf]
    ws, we, owner = chunk.words(buf)
    h = K.span_hash(buf, ws, we)
    windows, at = K.window_hash(h, owner, SHINGLE)
    who = owner[at]
    n_words = chunk.counts(owner)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n_words)[:-1]])[short]
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(SHINGLE - 1):
                more = n_words[short] > j
                word = h[np.minimum(first + j, len(h) - 1)]
                whole = np.where(more, whole * np.uint64(0x9FB21C651E98DF25) + word, whole)
            whole = K.mix(whole + n_words[short].astype(np.uint64))
        windows, who = np.concatenate([windows, whole]), np.concatenate([who, short])
    order = np.argsort(windows)
    order = order[np.argsort(who[order], kind="stable")]
    windows, who = windows[order], who[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (who[1:] != who[:-1])
    return who[new], windows[new]


def _sketch(chunk: K.Chunk) -> tuple[np.ndarray, list[bytes | None], list[bytes | None]]:
    """Set size, 16-byte name of the set and minimum hashes (32 bits each) of every text."""
    who, h = shingles(chunk)
    size = chunk.counts(who)
    full = np.flatnonzero(size)
    if not len(full):
        return size, [None] * len(chunk), [None] * len(chunk)
    first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
    with np.errstate(over="ignore"):
        names = np.stack([np.add.reduceat(K.mix(h ^ np.uint64(0x51AB)), first), np.add.reduceat(K.mix(h ^ np.uint64(0xC0FFEE)) ^ h, first)], 1)
        mins = np.stack([np.minimum.reduceat(h * a, first) for a in _MULTIPLIERS], 1)
    mins = (mins >> np.uint64(32)).astype("<u4")
    node: list[bytes | None] = [None] * len(chunk)
    sig: list[bytes | None] = [None] * len(chunk)
    for i, t in enumerate(full):
        node[t], sig[t] = names[i].tobytes(), mins[i].tobytes()
    return size, node, sig


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, node and sig of every row; node and sig are null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(2)):
                size, node, sig = _sketch(chunk)
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("row"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n_shingles long, node binary, sig binary")


def _mins(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u4").reshape(-1, HASHES)


def _region_keys(mins: np.ndarray) -> np.ndarray:
    """(nodes, ORDERS) hash of each order and its first DEPTH hashes."""
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(1, ORDERS + 1, dtype=np.uint64), (len(mins), 1))
        for j in range(DEPTH):
            out = K.mix(out * np.uint64(0xD6E8FEB86659FD93) + mins[:, j::DEPTH].astype(np.uint64))
    return out.view(np.int64)


def _keyed(nodes: DataFrame) -> DataFrame:
    """key and node of every region that a node lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _region_keys(_mins(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), ORDERS)))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node binary")


def forest(nodes: DataFrame) -> DataFrame:
    """A row for each order and node whose region there has company: order number, path (LEVELS 16-bit hashes), region key, node, n, bits."""
    light = _keyed(nodes)
    shared = light.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = light.join(shared, "key").groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most ORDERS keys
    schema = pa.schema([("tree", pa.int32()), ("path", pa.binary()), ("key", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mins = _mins(batch.column(2))
            keys = _region_keys(mins)
            wanted = [set(k) for k in batch.column(3).to_pylist()]
            low = K.mix(mins.astype(np.uint64)) & np.uint64(1)
            bits = (low << np.arange(HASHES, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
            short = K.mix(mins.astype(np.uint64)).astype(">u2")
            at, tree = np.nonzero(np.array([[k in w for k in row] for row, w in zip(keys.tolist(), wanted, strict=True)]))
            steps = (tree[:, None] * DEPTH + np.arange(LEVELS)) % HASHES
            paths = np.ascontiguousarray(short[at[:, None], steps])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.astype(np.int32)), pa.array([p.tobytes() for p in paths], pa.binary()), pa.array(keys[at, tree]), batch.column(0).take(take), batch.column(1).take(take), pa.array(bits[at])], schema=schema
            )

    return nodes.join(members, "node").select("node", "n", "sig", "keys").mapInArrow(run, "tree int, path binary, key long, node binary, n long, bits long")


def neighbours(rows: DataFrame) -> DataFrame:
    """Candidates (a, b, alike) of the sorted orders: longest-common-prefix neighbours and region leaders."""
    names = ["tree", "path", "node", "n", "bits"]
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("alike", pa.int32())])

    def pairs(table: pa.RecordBatch) -> pa.RecordBatch | None:
        m = table.num_rows
        tree = table.column(0).to_numpy()
        path = np.frombuffer(b"".join(table.column(1).to_pylist()), ">u2").reshape(m, LEVELS)
        same = np.logical_and.accumulate((path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1)
        lcp = np.concatenate([[0], same.sum(axis=1)])  # with the row before
        index = np.arange(m)
        close = index[lcp >= DEPTH]
        left, right = [close - 1], [close]
        open_ = np.ones(m, bool)
        for depth in range(DEPTH, LEVELS + 1, 2):  # as deep as it takes for a small region
            start = np.maximum.accumulate(np.where(lcp < depth, index, 0))
            here = open_ & (np.bincount(start, minlength=m)[start] <= REGION if depth < LEVELS else True)
            left.append(start[here])
            right.append(index[here])
            open_ &= ~here
        i, j = np.concatenate(left), np.concatenate(right)
        n, bits = table.column(3).to_numpy(), table.column(4).to_numpy()
        differ = np.bitwise_count(bits[i] ^ bits[j])
        ok = (i != j) & (100 * n[i] >= PERCENT * n[j]) & (100 * n[j] >= PERCENT * n[i]) & (differ <= MAX_BITS)
        if not ok.any():
            return None
        i, j, differ = i[ok], j[ok], differ[ok]
        node = table.column(2)
        return pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j)), pa.array((HASHES - differ).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.concat_batches([last, batch]) if last is not None else batch
            found = pairs(whole)
            if found is not None:
                yield found
            last = batch.slice(batch.num_rows - 1)

    sorted_rows = rows.select(*names).repartitionByRange(partitions(rows.sparkSession), "tree", "path").sortWithinPartitions("tree", "path", "node")
    found = sorted_rows.mapInArrow(run, "a binary, b binary, alike int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "alike").where("a <> b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, tag: str = "links") -> DataFrame:
    """pairs (a, b) with linked: whether their full sets reach the similarity. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = np.zeros(batch.num_rows, bool)
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m = part.num_rows
                both = pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())])
                pair, hashes = [], []
                sizes = np.zeros(2 * m, np.int64)
                for chunk in K.chunks(both):
                    who, h = shingles(chunk)
                    sizes[chunk.first : chunk.first + len(chunk)] = chunk.counts(who)
                    pair.append((who + chunk.first) % m)
                    hashes.append(h)
                p, h = np.concatenate(pair), np.concatenate(hashes)
                order = np.lexsort((h, p))
                p, h = p[order], h[order]
                twin = (p[1:] == p[:-1]) & (h[1:] == h[:-1])
                shared = np.bincount(p[1:][twin], minlength=m)
                either = sizes[:m] + sizes[m:] - shared
                verdict[at : at + m] = 100 * shared >= PERCENT * either
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdict)], names=["a", "b", "linked"])

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return staged(joined.mapInArrow(run, "a binary, b binary, linked boolean"), tag)


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes, each from its representative row."""
    reps = nodes.join(wanted, "node", "left_semi").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.row").alias("row"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("row"), text_or_empty().alias("text"))
    if reps.count() <= SMALL_IDS:
        reps = F.broadcast(reps)
    return rows.join(reps, ["doc_id", "row"]).select("node", "text").dropDuplicates(["node"])


def _with_label(df: DataFrame, label: DataFrame, node: str, out: str) -> DataFrame:
    named = label.select(F.col("node").alias(node), F.col("label").alias(out))
    return df.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def first_choices(near: DataFrame, each: int = FIRST_CHOICES) -> DataFrame:
    """Of candidates (a, b, alike), the most alike of each node and salt."""
    both = near.withColumn("x", F.explode(F.array("a", "b")))
    best = both.groupBy("x", F.pmod(F.xxhash64("a", "b"), F.lit(each)).alias("salt")).agg(F.max(F.struct("alike", "a", "b")).alias("pick"))
    return best.select("pick.a", "pick.b").distinct()


def open_groups(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (g, fb, mb, left, node, label) of the comparisons that regions with several components still need.

    Regions with the same least node are one group. In a group, the nodes outside its largest component (left) meet
    all its nodes; both sides are dealt into blocks, and a row stands for a node in one pair of blocks.
    """
    marked, drop_marked = passing(_with_label(rows.select("key", "node"), label, "node", "label"), "marked")
    several = marked.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("g")).where("lo <> hi").select("key", "c", "g")
    members = staged(with_counts(marked, several, ["key"]).select("g", "node", "label").distinct(), "members")
    drop_marked()
    sizes = members.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    sizes = sizes.select("g", F.col("all").alias("c"), F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("fbs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("mbs"))
    placed = with_counts(members, sizes, ["g"]).withColumn("h", F.xxhash64("node"))
    fb, mb = F.pmod("h", F.greatest("fbs", F.lit(1))).cast("int"), F.pmod("h", "mbs").cast("int")
    each = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    right = placed.select("g", F.explode(each(F.col("fbs"))).alias("fb"), mb.alias("mb"), F.lit(0).alias("left"), "node", "label")
    left = placed.where("label <> main").select("g", fb.alias("fb"), F.explode(each(F.col("mbs"))).alias("mb"), F.lit(1).alias("left"), "node", "label")
    return right.unionByName(left)


class _Block:
    """The rows of some pairs of blocks: full sets as numbers of a common vocabulary."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        text = rows.column("text").combine_chunks().cast(pa.large_string())
        who, h = [], []
        for chunk in K.chunks(text):
            w, x = shingles(chunk)
            who.append(w + chunk.first)
            h.append(x)
        _, self.ids = np.unique(np.concatenate(h), return_inverse=True)
        self.at = np.searchsorted(np.concatenate(who), np.arange(len(text) + 1))
        self.seen = np.zeros(int(self.ids.max(initial=0)) + 1, bool)
        self.own = np.zeros(len(self.seen), np.int32)

    def links(self, lo: int, hi: int, split: int, labels: list[bytes]) -> Iterator[tuple[int, int]]:
        """Links that merge labels, between right rows lo to split and left rows split to hi."""
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        right = self.ids[self.at[lo] : self.at[split]]
        starts = self.at[lo:split] - self.at[lo]
        n = np.diff(self.at[lo : split + 1])
        self.seen[right] = True
        for y in range(split, hi):
            mine = self.ids[self.at[y] : self.at[y + 1]]
            if 100 * np.count_nonzero(self.seen[mine]) >= PERCENT * len(mine):
                self.own[mine] = 1
                both = np.add.reduceat(self.own[right], starts)
                self.own[mine] = 0
                for x in np.flatnonzero(100 * both >= PERCENT * (n + len(mine) - both)) + lo:
                    a, b = find(labels[x]), find(labels[y])
                    if a != b:
                        root[a] = b
                        yield int(x), y
        self.seen[right] = False


def block_links(rows: DataFrame) -> DataFrame:
    """rows (g, fb, mb, left, node, label, text): links (a, b) that merge labels, confirmed on full sets."""

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        block, labels = _Block(table), table.column("label").to_pylist()
        key = list(zip(*(table.column(c).to_pylist() for c in ("g", "fb", "mb")), strict=True))
        left = table.column("left").to_pylist()
        x: list[int] = []
        y: list[int] = []
        lo = 0
        for i in range(1, len(key) + 1):
            if i == len(key) or key[i] != key[lo]:
                split = lo + left[lo:i].count(0)
                for u, v in block.links(lo, i, split, labels) if split > lo else ():
                    x.append(u)
                    y.append(v)
                lo = i
        node = table.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(x, pa.int64())), node.take(pa.array(y, pa.int64()))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cut = 0
            if held:
                before = tuple(held[-1].column(i)[-1].as_py() for i in range(3))
                cut = next((i for i, k in enumerate(keys) if k != before), len(keys))
                if cut < len(keys) and size > BLOCK_BYTES:
                    yield from whole([*held, batch.slice(0, cut)])
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from whole(held)

    names = ["g", "fb", "mb", "left", "node", "label", "text"]
    dealt = rows.select(*names).repartition(partitions(rows.sparkSession), "g", "fb", "mb").sortWithinPartitions("g", "fb", "mb", "left")
    return dealt.mapInArrow(run, "a binary, b binary")


def linked_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels of the nodes that have links."""
    rows, drop_rows = passing(forest(nodes), "forest")
    chosen = staged(first_choices(neighbours(rows)), "chosen")
    done = confirmed(chosen, _texts(docs, nodes, chosen.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    links = done.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = labels(links)
    rest = staged(open_groups(rows, label), "open")
    drop_rows()
    more = staged(block_links(rest.join(_texts(docs, nodes, rest.select("node").distinct()), "node")), "links")
    if more.isEmpty():
        return label
    return labels(label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sketches of every row, and the node, label and component_id of every node."""
    sets = staged(sketches(docs), "sets")
    full = sets.where("doc_id is not null and node is not null")
    nodes = staged(full.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "nodes")
    label = linked_nodes(docs, nodes)
    named = staged(_with_label(nodes.select("node", F.col("rep.doc_id").alias("least")), label, "node", "label"), "named")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return sets, named.join(smallest, "label").select("node", "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sets, component = grouped(docs)
    component = component.drop("label")
    out = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(component, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group, that of smallest id and then least hash; rows with a null id stay.

    Rows without words are no group; those alike in id and text go too, and of those that differ in other columns the one of
    least digest stays. Columns may be of any type and name; an empty table stays empty. Minima and counts are grouped on hashes alone,
    and the rows of one id and text are spread over SALTS tasks by where they are read, so a group may have any size.
    """
    sets, component = grouped(docs)
    # a row without words stands alone, by its id and text
    light = sets.where("doc_id is not null").groupBy("doc_id", "row", "node").agg(F.count("*").alias("n"))
    light = light.join(component.select("node", "label"), "node", "left")
    alone = light.where("label is null").select("doc_id", "row", "n")
    first = light.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row", "n")).alias("r")).select("r.*")
    picked = staged(first.unionByName(alone), "picked")
    rows = docs.where("doc_id is not null").select(whole_row(docs).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("row"), (F.spark_partition_id() % SALTS).alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    wanted = picked.select(F.col("doc_id").alias("id"), "row", salts, "n")
    found = rows.join(wanted, ["id", "row", "salt"])
    # of those that repeat each other the one of least digest; the least of each task goes on
    once = found.where("n > 1").groupBy("id", "row").agg(F.min_by("whole", F.md5(F.to_json("whole"))).alias("whole"))
    return found.where("n = 1").select("whole").unionByName(once.select("whole")).select("whole.*").unionByName(docs.where("doc_id is null"))
