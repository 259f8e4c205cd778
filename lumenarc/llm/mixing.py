"""Mixing sources to target weights by hash-threshold histograms (native).

Each source gets a target number of words; whole repeats of the source cover most of it, and the rest comes from
the documents whose hash lies below a threshold. The threshold is found from word sums by source and hash bucket;
only the bucket that holds it is refined, three hexadecimal digits at a time, then by the whole hash. No sort of
documents, and no more than 4,096 sums of one source at a time.

Nulls: a null text has no words; a null source is a source of its own, after all others; a null id hashes as
'null'. Rows alike in id and text, the only ties, share a hash and are taken together. Long texts are counted whole.
Empty tables give an empty result. Extra columns are kept by mixed() and not read by mix_sources().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import WORD, staged, text_or_empty, whole_row

#: Weights of the sources in the order of their names' code points, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
DIGITS = 3
LEVELS = 3
#: Tasks that share the rows of one source where they meet its plan.
SALTS = 32


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """sizes (source, source_size): adds weight and target. One row per source, so one window over all is small.

    Sources that stop at their cap are those with the smallest cap per unit of weight, so one sorted pass finds
    the level that all others share; that is where resharing the excess ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward, all_rows = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    levels = (
        weighted.withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    )
    free = F.when(~F.col("capped"), F.struct(F.col("weights").alias("w"), F.col("left").alias("l")))
    top = F.max(free).over(all_rows)  # the first source that isn't capped has the most weight from itself on
    share = F.col("weight").cast("double") * (top["l"].cast("double") / top["w"].cast("double"))
    return levels.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "weight", "target")


def hashed() -> Column:
    """A hash of id and text, which ranks the documents of a source."""
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_or_empty())))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), hashed().alias("h"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, rest): adds cut; documents with h <= cut hold as near rest words as whole documents can.

    The cut falls in the first bucket whose running sum passes rest. Within the last bucket, a hash is taken if
    more than half of its words still fit.
    """
    here, found, done = rows, budgets.select("source", "rest", F.lit("").alias("prefix")), None
    for level in range(LEVELS):
        bucket = F.substring("h", level * DIGITS + 1, DIGITS)
        sums = here.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("through", F.sum("n").over(running)).withColumnRenamed("source", "s")
        hits = found.join(sums, found["source"].eqNullSafe(sums["s"]) & (F.col("through") > F.col("rest")))
        first = hits.groupBy("source", "rest", "prefix").agg(F.min(F.struct("b", "through", "n")).alias("x"))
        # where even the last bucket doesn't pass rest, every document is taken: 'g' is above all digits
        whole = found.join(first.select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_anti").select("source", F.concat("prefix", F.lit("g")).alias("cut"))
        done = whole if done is None else done.unionByName(whole)
        found = staged(first.select("source", (F.col("rest") - (F.col("x.through") - F.col("x.n"))).alias("rest"), F.concat("prefix", F.col("x.b")).alias("prefix")), "cuts")
        at = found.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        here = here.join(at, here["source"].eqNullSafe(at["s"]) & (F.substring("h", 1, (level + 1) * DIGITS) == at["p"]), "left_semi")
    units = here.groupBy("source", "h").agg(F.sum("size").alias("n")).withColumnRenamed("source", "s")
    units = units.withColumn("through", F.sum("n").over(Window.partitionBy("s").orderBy("h")))
    taken = F.max(F.when(F.col("through") - F.col("n") / 2 <= F.col("rest"), F.col("h")))
    last = found.join(units, found["source"].eqNullSafe(units["s"]), "left").groupBy("source", "prefix").agg(taken.alias("h"))
    return done.unionByName(last.select("source", F.coalesce("h", "prefix").alias("cut")))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """rows of sized(): g (source), source_size, target, repeats and cut (null: none) of each source."""
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    goals = staged(goals.withColumn("repeats", whole.cast("long")).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-goals")
    cuts = thresholds(rows, goals.where(f"source_size > 0 and repeats < {most}").select("source", "rest"))
    cuts = cuts.withColumnRenamed("source", "s")
    return goals.join(cuts, goals["source"].eqNullSafe(cuts["s"]), "left").drop("s").withColumnRenamed("source", "g")


def _copies() -> Column:
    return F.col("repeats") + F.coalesce((F.col("h") <= F.col("cut")).cast("long"), F.lit(0))


def _planned(rows: DataFrame, source: str, goals: DataFrame) -> DataFrame:
    """rows (with h, their hash) and the plan of their source; a source of any size is spread over SALTS tasks."""
    salted = goals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("own_salt", F.pmod(F.crc32(F.col("h").cast("binary")), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col(source).eqNullSafe(F.col("g")) & (F.col("own_salt") == F.col("salt")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken: words that the mix takes of the document, repeats counted."""
    rows = staged(sized(docs), "mix-rows")
    goals = staged(plan(rows, weights, most), "mix-plan")
    return _planned(rows, "source", goals).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, in the columns of docs.

    The plan has a row for each source, in a table of known size, so Spark broadcasts it while it is small and no text
    is shuffled.
    """
    rows = staged(sized(docs), "mix-rows")
    goals = staged(plan(rows, weights, most).select("g", "repeats", "cut"), "mix-plan")
    held = docs.select(whole_row(docs).alias("row"), F.col("source").cast("string").alias("own"), hashed().alias("h"))
    taken = _planned(held, "own", goals).select("row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))))
    return taken.select("row.*")
