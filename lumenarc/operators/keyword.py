"""Ranked keyword search: query atoms, a stored index and BM25 scores.

Scores follow the full-text variant with k1 = 1.2 and b = 0.75: every atom must occur, a row's length counts all of its
columns, and an inverse frequency at or below zero becomes 1e-6. A stored index holds a row for each term and row of the
corpus, sorted by term, so that a query reads only the row groups of its own terms; the length of a row stands beside
each of its terms, so nothing is joined. Changed rows go to a segment of their own, with a mark for each row that is
gone; a row's newest segment counts, so old segments are never written again. Token arrays of a table that isn't stored
can be searched as well, by a scan.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import folded, tokens
from lumenarc.sources.shared import spread

K1, B, FLOOR = 1.2, 0.75, 1e-6
COLUMNS = ("description", "tags", "filename", "source_text")
OPERATORS = {"and", "or", "not", "near"}
#: Places of one column lie apart from those of the next by this.
APART_BITS = 40
APART = 1 << APART_BITS
#: Tasks that share the entries of one term.
SPLITS = 16
#: Entries that a task passes on at once, or those of one row if they are more.
ENTRIES = 1 << 14
#: Letters, numbers and private-use characters, as tokens() has them.
_TOKEN = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")
Atom = tuple[tuple[str, ...], bool]


class Index(NamedTuple):
    """A stored index: columns by name, terms (term, id, column, n, tf, places) and figures (rows, mean)."""

    columns: tuple[str, ...]
    terms: DataFrame
    figures: DataFrame


def plain_terms(query: str) -> list[str]:
    return [t for t in re.findall(r"[^\W_]+", query) if t.lower() not in OPERATORS]


def atoms(query: str) -> list[Atom]:
    """Phrases in closed quotes, then the words outside; the last word is a prefix unless the query ends in a quote."""
    parts = query.split('"')
    # an odd number of quotes leaves the last one open: what follows it is no phrase
    closed = parts[1:-1:2] if len(parts) % 2 == 0 else parts[1::2]
    loose = [*parts[0::2], *(parts[-1:] if len(parts) % 2 == 0 else ())]
    out: list[Atom] = [(tuple(words), False) for p in closed if (words := re.findall(r"[^\W_]+", p))]
    out += [((w,), False) for p in loose for w in plain_terms(p)]
    if out and any(plain_terms(p) for p in loose) and not query.rstrip().endswith('"'):
        out[-1] = (out[-1][0], True)
    return out


def sanitized(query: str) -> str:
    return " AND ".join('"' + " ".join(words) + '"' + "*" * prefix for words, prefix in atoms(query))


def index_rows(media: DataFrame, analysis: DataFrame, sources: DataFrame) -> DataFrame:
    """What the index reads of each medium: three parts of description, two of tags, the file name, and its sources' sites and chapters.

    media (id, title, user_description, user_tags, original_filename) and analysis (media_id, description, tags) hold texts;
    sources (id, media_id, site, chapter) are taken in order of their ids. Missing parts are empty, and only the ends are trimmed.
    """
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = lambda *cs: F.trim(F.concat(*[x for c in cs for x in (F.lit(" "), there(c))]))
    said = sources.where("site IS NOT NULL").select("media_id", F.struct("id", F.concat("site", F.lit(" "), there("chapter")).alias("t")).alias("s"))
    sites = said.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), " ").alias("source_text"))
    found = analysis.select("media_id", F.col("description").alias("_said"), F.col("tags").alias("_tags"))
    rows = media.join(found, media["id"] == found["media_id"], "left").drop("media_id").join(sites, F.col("id") == sites["media_id"], "left")
    return rows.select("id", joined("_said", "user_description", "title").alias("description"), joined("_tags", "user_tags").alias("tags"), there("original_filename").alias("filename"), there("source_text").alias("source_text"))


def indexed(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """rows (id, *columns) as token arrays."""
    return rows.select("id", *[tokens(c).alias(c) for c in columns])


def postings(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(id, column, position, term) of every token."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), tokens(c).alias("terms")) for c in columns])
    each = rows.select("id", F.explode(parts).alias("p"))
    return each.select("id", "p.column", F.posexplode("p.terms").alias("position", "term"))


def reindexed(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """An index in which the rows of fresh replace those of the same id."""
    return index.join(fresh.select("id").distinct(), "id", "left_anti").unionByName(fresh)


TERMS = "term string, id long, column byte, n long, tf int, places array<long>, sig long"
NAMES = [c.split()[0] for c in TERMS.split(", ")]
KINDS = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, sig, *columns) as entries of an index, passed on in slices, so that memory doesn't grow with the rows."""
    out: list[list] = [[] for _ in NAMES]
    for batch in batches:
        for i in range(batch.num_rows):  # no more than one row's text is in Python at a time
            key, sig, *texts = (c[i].as_py() for c in batch.columns)
            found = [_TOKEN.findall(folded(text or "")) for text in texts]
            n = sum(map(len, found))
            for c, terms in enumerate(found):
                places: dict[str, list[int]] = {}
                for place, term in enumerate(terms, c * APART):
                    places.setdefault(term, []).append(place)
                k = len(places)
                if k:
                    for column, cells in zip(out, (places, repeat(key, k), repeat(c, k), repeat(n, k), map(len, places.values()), places.values(), [sig, *repeat(None, k - 1)]), strict=True):
                        column.extend(cells)
                    sig = None
            if not n:
                for column, cell in zip(out, ("", key, 0, 0, 0, [], sig), strict=True):
                    column.append(cell)
            if len(out[0]) >= ENTRIES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, KINDS, strict=True)], names=NAMES)
                out = [[] for _ in NAMES]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, KINDS, strict=True)], names=NAMES)


def listed(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Lists of terms of rows (id, *columns): term, id, column, n (tokens of the row), tf, places and sig.

    sig, the row's signature, stands in one entry of each row; a row without tokens has one entry with an empty term, which
    no query asks for, so that it counts.
    """
    return rows.select(F.col("id").cast("long").alias("id"), _signature(columns), *[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(entries, TERMS)


MANIFEST = "version long, segments array<string>, columns array<string>, n_rows long, n_tokens long, signature decimal(38,0)"


def _signature(columns: tuple[str, ...]) -> Column:
    return F.xxhash64(F.col("id").cast("long"), *[F.col(c).cast("string") for c in columns]).alias("sig")


def _manifest(spark: SparkSession, folder: str) -> Row | None:
    """The newest manifest of an index; it is written last, so what it names is whole."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy(F.col("version").desc()).first()
    except AnalysisException:
        return None


def _named(spark: SparkSession, folder: str, version: int, segments: list[str], columns: tuple[str, ...], figures: tuple) -> Index:
    row = (version, segments, list(columns), *figures)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return _opened(spark, folder, Row(*[c.split()[0] for c in MANIFEST.split(", ", 5)])(*row))


def _write_terms(terms: DataFrame, path: str) -> DataFrame:
    """Terms sorted in files; the rows of a very common term share SPLITS tasks. Returns the rows: id, sig and n."""
    terms.repartition("term", F.pmod("id", F.lit(SPLITS))).sortWithinPartitions("term", "id").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/terms")
    return terms.sparkSession.read.parquet(f"{path}/terms").where("sig IS NOT NULL").select("id", "sig", "n")


def _figures(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count("sig"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("sig").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def stored(rows: DataFrame, folder: str, columns: tuple[str, ...] = COLUMNS) -> Index:
    """Builds the index of rows (id, *columns; id is a key) in a folder, as one segment; an older index there is superseded."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    old = _manifest(spark, folder)
    _write_terms(listed(spread(rows), columns), f"{folder}/{name}").write.parquet(f"{folder}/{name}/rows")
    return _named(spark, folder, old["version"] + 1 if old else 0, [name], columns, _figures(spark.read.parquet(f"{folder}/{name}/rows")))


def _segments(spark: SparkSession, folder: str, names: list[str], part: str) -> DataFrame:
    """A part (terms or rows) of all segments, with seg, their number."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{name}/{part}").withColumn("seg", F.lit(i)) for i, name in enumerate(names)])


def _opened(spark: SparkSession, folder: str, m: Row) -> Index:
    terms = _segments(spark, folder, m["segments"], "terms")
    if len(m["segments"]) > 1:  # an entry counts if no later segment has its row
        later = _segments(spark, folder, m["segments"], "rows").where("seg > 0").groupBy("id").agg(F.max("seg").alias("newest"))
        terms = terms.join(later, "id", "left").where("newest IS NULL OR seg >= newest")
    mean = m["n_tokens"] / m["n_rows"] if m["n_rows"] else None
    return Index(tuple(m["columns"]), terms, spark.createDataFrame([(m["n_rows"], mean)], "rows long, mean double"))


def opened(spark: SparkSession, folder: str) -> Index | None:
    """The index in a folder, or None if there is none or only part of one."""
    m = _manifest(spark, folder)
    return m and _opened(spark, folder, m)


def _held(spark: SparkSession, folder: str, m: Row) -> DataFrame:
    """id, old_sig and old_n of the rows that an index holds."""
    rows = _segments(spark, folder, m["segments"], "rows")
    if len(m["segments"]) > 1:
        rows = rows.groupBy("id").agg(F.max_by(F.struct("sig", "n"), "seg").alias("r")).select("id", "r.*")
    return rows.where("sig IS NOT NULL").select("id", F.col("sig").alias("old_sig"), F.col("n").alias("old_n"))


def _with_segment(folder: str, m: Row, rows: DataFrame, changes: DataFrame) -> Index:
    """changes (id, old_sig, old_n, gone) as a new segment; rows has those that aren't gone, and maybe others."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    path = f"{folder}/{name}"
    changes.write.parquet(f"{path}/changes")
    changes = spark.read.parquet(f"{path}/changes")
    if changes.isEmpty():
        return _opened(spark, folder, m)
    columns = tuple(m["columns"])
    fresh = rows.join(changes.where("NOT gone").select("id"), "id", "left_semi")
    new = _write_terms(listed(fresh, columns), path)
    new.unionByName(changes.where("gone").select("id", F.lit(None).cast("long").alias("sig"), F.lit(0).cast("long").alias("n"))).write.parquet(f"{path}/rows")
    before = _figures(changes.select("id", F.col("old_sig").alias("sig"), F.col("old_n").alias("n")))
    after = _figures(spark.read.parquet(f"{path}/rows"))
    figures = [m[c] + a - b for c, a, b in zip(("n_rows", "n_tokens", "signature"), after, before, strict=True)]
    return _named(spark, folder, m["version"] + 1, [*m["segments"], name], columns, tuple(figures))


def updated(rows: DataFrame, folder: str) -> Index:
    """The index in a folder brought up to the table rows: rows that are new, changed or gone make one new segment.

    Only signatures of the whole table are compared; texts are read for changed rows alone.
    """
    spark = rows.sparkSession
    m = _manifest(spark, folder)
    now = rows.select(F.col("id").cast("long").alias("id"), _signature(tuple(m["columns"])))
    both = now.join(_held(spark, folder, m), "id", "full").where("NOT sig <=> old_sig")
    return _with_segment(folder, m, rows, both.select("id", "old_sig", "old_n", F.col("sig").isNull().alias("gone")))


def replaced(fresh: DataFrame, folder: str, gone: DataFrame | None = None) -> Index:
    """The index in a folder after some rows (id, *columns) were written and those of gone (id) were deleted."""
    spark = fresh.sparkSession
    m = _manifest(spark, folder)
    ids = fresh.select(F.col("id").cast("long").alias("id"), F.lit(False).alias("gone"))
    if gone is not None:
        ids = ids.unionByName(gone.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("gone"))).groupBy("id").agg(F.min("gone").alias("gone"))
    return _with_segment(folder, m, fresh, ids.join(_held(spark, folder, m), "id", "left").select("id", "old_sig", "old_n", "gone"))


def compacted(spark: SparkSession, folder: str) -> Index:
    """All segments as one, without reading any text again."""
    m, name = _manifest(spark, folder), uuid.uuid4().hex
    _write_terms(_opened(spark, folder, m).terms.select(*[c.split()[0] for c in TERMS.split(", ")]), f"{folder}/{name}").write.parquet(f"{folder}/{name}/rows")
    return _named(spark, folder, m["version"] + 1, [name], tuple(m["columns"]), (m["n_rows"], m["n_tokens"], m["signature"]))


def healed(rows: DataFrame, folder: str, columns: tuple[str, ...] = COLUMNS) -> Index:
    """The index in a folder, built where it is missing and updated where its rows' number or signature is not the table's."""
    m = _manifest(rows.sparkSession, folder)
    if m is None or tuple(m["columns"]) != tuple(columns):
        return stored(rows, folder, columns)
    n, _, signature = _figures(rows.select(_signature(columns), F.lit(0).alias("n")))
    return _opened(rows.sparkSession, folder, m) if (n, signature) == (m["n_rows"], m["signature"]) else updated(rows, folder)


def folder_of(parent: str, name: str) -> str:
    return f"{parent}/keyword-{hashlib.sha256(name.encode()).hexdigest()[:32]}"


def fresh_folder(parent: str) -> str:
    return f"{parent}/keyword-{uuid.uuid4().hex}"


def occurrences(column: Column, atom: Atom) -> Column:
    """How often an atom occurs in a token array."""
    words, prefix = [folded(w) for w in atom[0]], atom[1]
    if len(words) == 1:
        return F.size(F.filter(column, lambda x: x.startswith(words[0]) if prefix else x == words[0]))
    # tokens hold letters and digits only; looking ahead counts occurrences that overlap
    phrase = "  ".join(words) + ("[^ ]*" if prefix else "")
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(column, "  "), F.lit(" ")), F.lit(f"(?= {phrase} )"))


def _scanned(index: DataFrame, parts: list[Atom], columns: tuple[str, ...], every: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Counts (id, n, and f<atom>_<column> of each) of every row of token arrays, and the figures of the corpus."""
    fs = [occurrences(F.col(c), a).alias(f"f{i}_{every.index(c)}") for i, a in enumerate(parts) for c in columns]
    # all readers share this exchange of a few numbers a row, so texts are tokenized once
    counted = index.select("id", reduce(lambda a, b: a + b, [F.size(c) for c in every]).alias("n"), *fs).repartition("id")
    return counted, counted.agg(F.count("*").alias("rows"), F.avg("n").alias("mean"))


def _earlier(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _looked_up(index: Index, parts: list[Atom], columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The same of the rows of a stored index that hold any of the atoms' words."""
    cs = [index.columns.index(c) for c in columns]
    fits = lambda word, prefix: F.col("term").startswith(word) if prefix else F.col("term") == word
    words = [[(folded(w), prefix and j == len(atom) - 1) for j, w in enumerate(atom)] for atom, prefix in parts]
    wanted = reduce(lambda a, b: a | b, [fits(*w) for w in sorted({w for atom in words for w in atom})])
    many = {i for i, atom in enumerate(words) if len(atom) > 1}
    single = [F.coalesce(F.sum(F.when(fits(*atom[0]) & (F.col("column") == c), F.col("tf"))), F.lit(0)).alias(f"f{i}_{c}") for i, atom in enumerate(words) if i not in many for c in cs]
    places = [F.flatten(F.collect_list(F.when(fits(*w), F.col("places")))).alias(f"p{i}_{j}") for i in many for j, w in enumerate(words[i])]  # of one row's terms
    rows = index.terms.where(F.col("column").isin(cs) & wanted).groupBy("id").agg(F.first("n").alias("n"), *single, *places)
    for i in many:
        after = reduce(F.array_intersect, [_earlier(F.col(f"p{i}_{j}"), j) for j in range(len(words[i]))])
        rows = rows.withColumn(f"after{i}", after)
    of_column = lambda c: lambda p: F.shiftright(p, APART_BITS) == c
    phrases = [F.size(F.filter(f"after{i}", of_column(c))).alias(f"f{i}_{c}") for i in many for c in cs]
    return rows.select("id", "n", *[f"f{i}_{c}" for i in range(len(parts)) if i not in many for c in cs], *phrases), index.figures


def _atoms_of(index: DataFrame | Index, query: str | list[Atom], sets: list[tuple[str, ...] | None]) -> tuple[list[Atom], tuple[str, ...], list[tuple[str, ...]]]:
    every = index.columns if isinstance(index, Index) else tuple(c for c in index.columns if c != "id")
    sets = [columns or every for columns in sets]
    if unknown := {c for columns in sets for c in columns} - set(every):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return atoms(query) if isinstance(query, str) else query, every, sets


def _scores(index: DataFrame | Index, parts: list[Atom], every: tuple[str, ...], sets: list[tuple[str, ...]]) -> DataFrame:
    """id and scores, one for each set of columns, null where the set lacks an atom; terms are looked up once for all sets."""
    columns = tuple(c for c in every if any(c in columns for columns in sets))
    counted, figures = _looked_up(index, parts, columns) if isinstance(index, Index) else _scanned(index, parts, columns, every)
    f = lambda i, k: reduce(lambda a, b: a + b, [F.col(f"f{i}_{every.index(c)}") for c in sets[k]])
    cells = [(i, k) for i in range(len(parts)) for k in range(len(sets))]
    # both readers of the counts name all columns, n too, so that they share one exchange
    having = counted.agg(*[F.count_if((f(i, k) > 0) & (F.col("n") >= 0)).alias(f"d{i}_{k}") for i, k in cells])
    corpus = figures.crossJoin(having)  # one row and one row
    scores = []
    for k in range(len(sets)):
        score, all_there = F.lit(0.0), F.lit(True)
        for i in range(len(parts)):
            d, n = F.col(f"d{i}_{k}"), f(i, k)
            idf = F.log((F.col("rows") - d + 0.5) / (d + 0.5))
            score = score + F.when(idf <= 0, FLOOR).otherwise(idf) * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("n") / F.col("mean")))
            all_there = all_there & (n > 0)
        scores.append(F.when(all_there, score))
    return counted.crossJoin(F.broadcast(corpus)).select("id", F.array(*scores).alias("scores"))


def _none(index: DataFrame | Index) -> DataFrame:
    return (index.terms if isinstance(index, Index) else index).select("id", F.lit(0.0).alias("score")).limit(0)


def bm25(index: DataFrame | Index, query: str | list[Atom], columns: tuple[str, ...] | None = None, limit: int | None = 500) -> DataFrame:
    """(id, score) of the best rows of an index, ties by id; higher is better. No atoms, no rows."""
    parts, every, sets = _atoms_of(index, query, [columns])
    if not parts:
        return _none(index)
    out = _scores(index, parts, every, sets).select("id", F.col("scores")[0].alias("score")).where("score IS NOT NULL")
    return out if limit is None else out.orderBy(F.col("score").desc(), "id").limit(limit)


def best(index: DataFrame | Index, query: str | list[Atom], sets: dict[str, tuple[str, ...] | None], limit: int) -> DataFrame:
    """(name, id, score, top): the best rows by each named set of columns, and the best score of the set, in one pass over the index.

    Every task passes on no more than its own best rows.
    """
    parts, every, columns = _atoms_of(index, query, list(sets.values()))
    if not parts:
        return _none(index).select(F.lit("").alias("name"), "id", "score", F.col("score").alias("top"))
    each = _scores(index, parts, every, columns).select("id", F.posexplode("scores").alias("k", "score")).where("score IS NOT NULL")
    by_set = Window.partitionBy("k")
    ranked = each.withColumn("nth", F.row_number().over(by_set.orderBy(F.col("score").desc(), "id"))).where(F.col("nth") <= limit)
    return ranked.select(F.element_at(F.array(*map(F.lit, sets)), F.col("k") + 1).alias("name"), "id", "score", F.max("score").over(by_set).alias("top"))


def containing(rows: DataFrame, query: str, text: Column) -> DataFrame:
    """(id, score 1) of rows whose text holds every plain term as a part."""
    terms = plain_terms(query)
    if not terms:
        return rows.select("id", F.lit(1.0).alias("score")).limit(0)
    for t in terms:
        rows = rows.where(F.contains(F.lower(text), F.lit(t.lower())))
    return rows.select("id", F.lit(1.0).alias("score"))
