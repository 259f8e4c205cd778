"""A prefix trie of conversations with subtree totals by pointer jumping.

Turns are ranked and, as most conversations of a family share their start, rebuilt: the first turns come from the
family's first conversation. A turn is known by its digest, so texts are read once and never shuffled. A prefix is known
by the sums of its turns' digests mixed with their places, 128 bits; sums, unlike a chain of digests, can be made
piece by piece, so one conversation may hold any share of the rows. Nodes are the distinct prefixes, each with the
digest of the prefix that is shorter by one.

Subtree totals take a logarithmic number of rounds. Before round k each node at depth 2^k or more points at its
ancestor 2^k above and holds the totals of the descendants less than 2^k below itself; a round adds these to the
ancestor and lets the node point where its ancestor points. Nodes not deep enough drop out, so a round holds no more rows
than the nodes that are left. Sums are aggregated before the shuffle, and hot ancestors meet by broadcast.

Nulls: a null role or text is empty, a null turn comes first; rows without conv_id belong to no conversation. Turns of
one number stand in the order of the digests of their role and text; repeated rows are turns of their own. Texts of any length
count whole. Negative ids belong to the family of Spark's remainder. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import staged, text_or_empty, utf8, with_counts
from lumenarc.llm.scans import joined_sha256, running

#: Conversations in a family, of which the first gives the others their start.
FAMILY = 5
#: At most this many turns less one are taken from there.
STARTS = 9
PIECES = ["e1", "e2", "e3", "e4"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), digest and n_bytes of every turn; stored."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("one"))
    return staged(running(turns, "conv_id", ["turn", "digest", "uid"], ["one"], "turns").select("conv_id", F.col("one_run").alias("i"), "digest", "n_bytes"), "ranked")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, d, digest, n_bytes, length) of every rebuilt conversation, and every conv_id with its length."""
    own = turns.groupBy("conv_id").agg(F.max("i").alias("n_own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    starts = (F.crc32(utf8(F.col("conv_id").cast("string"))) % STARTS).alias("h")
    heads = own.select("conv_id", "n_own", base.alias("base"), starts)
    first = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = staged(heads.join(first, "base", "left").select("conv_id", "base", "h", "n_own", taken.alias("m"), (taken + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("length")), "convs")
    few = turns.where((F.col("i") < STARTS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.where("m > 0").join(few, "base").where("i <= m").select("conv_id", F.col("i").alias("d"), "digest", "n_bytes", "length")
    rest = with_counts(turns, convs.withColumn("c", F.col("n_own")), ["conv_id"]).where("i > h")
    return lent.unionByName(rest.select("conv_id", (F.col("i") - F.col("h") + F.col("m")).alias("d"), "digest", "n_bytes", "length")), convs.select("conv_id", "length")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def visits(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, n_bytes and length of every prefix of every rebuilt conversation, the empty one included."""
    element = F.md5(F.concat(F.col("d").cast("string"), F.lit("/"), F.col("digest")))
    pieces = [F.conv(F.substring(element, 8 * k + 1, 8), 16, 10).cast("long").alias(e) for k, e in enumerate(PIECES)]
    summed = running(turns.select("conv_id", "d", "n_bytes", "length", *pieces), "conv_id", ["d"], PIECES, "prefixes")
    at, above = [F.col(f"{e}_run") for e in PIECES], [F.col(f"{e}_run") - F.col(e) for e in PIECES]
    deep = summed.select("conv_id", F.col("d").alias("depth"), _key(F.col("d"), at).alias("key"), _key(F.col("d") - 1, above).alias("parent"), "n_bytes", "length")
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), _key(F.lit(0), [F.lit(0)] * len(PIECES)).alias("key"), F.lit(None).cast("binary").alias("parent"), none.alias("n_bytes"), "length")
    return deep.unionByName(roots)


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (key, parent or null, depth, and values, longs): key and the sums of values over each node's subtree.

    parent is the key of a node that is less deep by one.
    """
    sums = [F.sum(v).alias(v) for v in values]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    parts = [nodes.select("key", *values)]
    active, step = nodes.where("depth > 0").select("key", F.col("parent").alias("up"), "depth", *values), 1
    while step <= deepest:
        gained = staged(active.groupBy("up").agg(*sums, F.count("*").alias("c")), "gained")
        parts.append(gained.select(F.col("up").alias("key"), *values))
        step *= 2
        if step <= deepest:
            hops = gained.select("up", "c").join(active.select(F.col("key").alias("up"), F.col("up").alias("to")), "up")
            left = active.where(F.col("depth") >= step)
            more = gained.select(F.col("up").alias("key"), *[F.col(v).alias(f"{v}_more") for v in values])
            moved = with_counts(left, hops, ["up"]).join(more, "key", "left")
            active = staged(moved.select("key", F.col("to").alias("up"), "depth", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values]), "jumped")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("key").agg(*sums)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    seen = visits(*rebuilt(ranked_turns(conversations)))
    nodes = staged(seen.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes")), "nodes")
    ends = joined_sha256(seen.where("depth = length").select("key", "conv_id"), "key", "conv_id").select("key", F.col("sha256").alias("ends_sha256"))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("c"))
    own = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").select("key", "parent", "depth", F.coalesce("c", F.lit(0)).alias("n_children"), F.col("c").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    own = staged(own, "own")
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    names = children.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    below = with_counts(nodes, names, ["parent"]).select("key", "conv_id", "depth", "parent_conv_id", "n_convs")
    named = below.unionByName(nodes.where("parent IS NULL").select("key", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs"))
    return (
        named.join(own.select("key", "n_children"), "key").join(totals, "key").join(ends, "key", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    )
