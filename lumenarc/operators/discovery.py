"""Discovery over recorded pages: links of a page, what is reachable, chapters of a series, series of a catalog, paged feeds.

Pages are rows (url, html). A page is parsed once, by a table function that gives a row for each link. Whatever follows
links goes in rounds: the frontier meets the pages by address, new addresses are those not seen before, and the rounds end when
one adds nothing. Rounds are written to the shared folder, so no plan grows and a lost executor costs one round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.operators.comments import parsed
from lumenarc.sources.shared import kept

#: Fixed: pages that a catalog or a feed is followed at most.
MAX_PAGES = 50


@F.udtf(returnType="position int, link string, title string", useArrow=True)
class PageLinks:
    """The links of a page, absolute and without fragment, each once at its first place, with their text."""

    def eval(self, url: str, html: str) -> Iterator[tuple[int, str, str]]:
        seen: dict[str, str] = {}
        for n in parsed(html or "").walk():
            if n.tag == "a" and (href := n.attrs.get("href", "").split("#")[0].strip()):
                try:
                    link = urljoin(url or "", href)
                except ValueError:  # such as a broken IPv6 address
                    continue
                if not seen.get(link):
                    seen[link] = n.text() or seen.get(link, "")
        for i, (link, title) in enumerate(seen.items()):
            yield i, link, title


def page_links(pages: DataFrame) -> DataFrame:
    """(url, position, link, title) of every page."""
    spark = pages.sparkSession
    spark.udtf.register("lumenarc_page_links", PageLinks)
    return spark.sql("SELECT p.url, l.position, l.link, l.title FROM {pages} p, LATERAL lumenarc_page_links(p.url, p.html) l", pages=pages.select("url", "html"))


def origin(url: str | Column) -> Column:
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)


def path_of(url: str | Column) -> Column:
    """The path of an address without its closing slashes."""
    u = F.col(url) if isinstance(url, str) else url
    return F.rtrim(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))


def reachable(pages: DataFrame, seeds: DataFrame, rounds: int | None = None, within: bool = True) -> DataFrame:
    """Every address that links lead to from seeds (url): url, depth, via and position, the page and place that it was first found at.

    Of an address's places the least deep counts, then the least page address, then the first on that page. Pages that
    aren't recorded have no links. within keeps links to their page's own host.
    """
    nowhere = [F.lit(None).cast("string").alias("via"), F.lit(None).cast("int").alias("position")]
    found = kept(seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), *nowhere), "reached")
    frontier, seen, depth = found, found, 0
    while rounds is None or depth < rounds:
        depth += 1
        links = page_links(pages.join(frontier.select("url"), "url", "left_semi").dropDuplicates(["url"]))
        if within:
            links = links.where(F.lower(origin("link")) == F.lower(origin("url")))
        new = links.select(F.col("link").alias("new"), "url", "position").join(seen.select(F.col("url").alias("new")), "new", "left_anti")
        frontier = kept(new.groupBy("new").agg(F.min(F.struct("url", "position")).alias("at")).select(F.col("new").alias("url"), F.lit(depth).alias("depth"), F.col("at.url").alias("via"), F.col("at.position").alias("position")), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def chapters(pages: DataFrame, entries: DataFrame, series: str, chapter: str) -> DataFrame:
    """(entry, position, url): the chapters of each entry's series, in the order of the series' page.

    entries are addresses (url) of a series or of one of its chapters; series and chapter are patterns of their paths, chapter
    with the series' path as its first group. An entry of neither kind, one whose series is not recorded, and one whose
    series lists no chapter is its own only page. A page that lists chapters as data in place of links has an element
    with a base path and numbers.
    """
    own = path_of("url")
    of = F.coalesce(F.nullif(F.regexp_extract(own, f"^(?:{chapter})$", 1), F.lit("")), F.when(own.rlike(f"^(?:{series})$"), own))
    asked = entries.select(F.col("url").alias("entry")).distinct().withColumn("url", F.col("entry")).withColumn("home", F.concat(origin("url"), of))
    held = pages.select(F.concat(origin("url"), path_of("url")).alias("home"), "url", "html").join(asked.select("home").distinct(), "home", "left_semi").dropDuplicates(["home"])
    listed = page_links(held).select(F.concat(origin("url"), path_of("url")).alias("home"), "position", F.concat(origin("link"), path_of("link")).alias("link"))
    child = F.regexp_extract(path_of("link"), f"^(?:{chapter})$", 1)
    linked = listed.where((F.concat(origin("link"), child) == F.col("home")) & (child != "")).groupBy("home", "link").agg(F.min("position").alias("position"))
    blob = F.from_json(F.regexp_replace(F.regexp_extract("html", r"""id=["']continue-reading-data["'][^>]*>([^<]*)<""", 1), "&quot;", '"'), "base string, numbers array<string>")
    told = held.withColumn("d", blob).where(F.col("d.base").rlike(f"^(?:{series})$"))
    data = told.select("home", F.concat(origin("home"), "d.base").alias("root"), F.posexplode("d.numbers").alias("position", "number"))
    spare = data.join(linked.select("home").distinct(), "home", "left_anti").select("home", F.concat("root", F.lit("/chapter/"), "number").alias("link"), "position")
    both = linked.select("home", "link", "position").unionByName(spare)
    out = asked.join(both, "home", "left")
    return out.select("entry", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("link", "entry").alias("url"))


def catalog(pages: DataFrame, index: str, series: str, most: int = MAX_PAGES) -> DataFrame:
    """(place, position, url, title): the series of a catalog's pages, each once at its first place.

    index is the address of the first page; page n has ?page=n after it. Pages count up to the first that is not recorded or
    adds no series, and at most `most`. A title is the first text of the series' links.
    """
    numbered = F.when(F.col("url") == index, 1).otherwise(F.expr("try_cast(" + "regexp_extract(url, '[?]page=([0-9]+)$', 1)" + " as int)"))
    own = pages.where((F.col("url") == index) | F.col("url").rlike("^" + re.escape(index.rstrip("/")) + "/?[?]page=[0-9]+$")).withColumn("place", numbered).where(F.col("place").between(1, most))
    links = page_links(own.dropDuplicates(["place"])).join(own.select("url", "place").distinct(), "url")
    links = links.where((origin("link") == origin(F.lit(index))) & path_of("link").rlike(f"^(?:{series})$"))
    address = F.concat(origin("link"), path_of("link"))
    first = links.groupBy(address.alias("url")).agg(F.min(F.struct("place", "position")).alias("at"), F.min(F.when(F.col("title") != "", F.struct("place", "position", "title")))["title"].alias("title"))
    fresh = first.groupBy("at.place").agg(F.count("*").alias("n"))
    # the first page without new series, of at most `most` rows
    gaps = pages.sparkSession.range(1, most + 2).select(F.col("id").cast("int").alias("place")).join(fresh, "place", "left_anti").agg(F.min("place").alias("end"))
    return first.crossJoin(F.broadcast(gaps)).where(F.col("at.place") < F.col("end")).select("at.place", "at.position", "url", "title")


def paged(replies: DataFrame, items: str, fields: str, limit: int, most: int = MAX_PAGES) -> DataFrame:
    """Items of replies (feed, page, body) of feeds by page number: feed, page, position and fields.

    A feed ends with its first page of fewer than limit items, one that is no such JSON, or before a page that is missing;
    at most `most` pages count. Feeds are dealt to tasks, and no more than the pages of one feed meet.
    """
    parsed_items = F.from_json("body", f"struct<{items}: array<struct<{fields}>>>")[items]
    rows = replies.where(F.col("page").between(1, most)).dropDuplicates(["feed", "page"]).select("feed", "page", parsed_items.alias("i"))
    full = rows.where(F.size("i") >= limit).groupBy("feed").agg(F.array_sort(F.collect_set("page")).alias("p"))  # at most `most` numbers
    run = full.select("feed", F.size(F.filter("p", lambda p, k: p == k + 1)).alias("n"))
    return rows.join(run, "feed", "left").where(F.col("page") <= F.coalesce("n", F.lit(0)) + 1).select("feed", "page", F.posexplode("i").alias("position", "item")).select("feed", "page", "position", "item.*")


def followed(replies: DataFrame, starts: DataFrame, items: str, fields: str, following: str = "next", most: int = MAX_PAGES) -> DataFrame:
    """Items of replies (url, body) of feeds that name their next page: feed, page, position and fields.

    starts (feed, url) are first pages. A feed ends with a reply that names no next page or is missing, with an address
    that it had before, and after `most` pages. Each round follows all feeds by one page. Replies are parsed and written
    once; the rounds read their addresses alone, and the items are met at the end.
    """
    shape = F.from_json("body", f"struct<{items}: array<struct<{fields}>>, {following}: string>")
    rows = kept(replies.dropDuplicates(["url"]).select("url", shape.alias("r")).select("url", F.col(f"r.{items}").alias("i"), F.col(f"r.{following}").alias("next")), "feed-replies")
    at, places = starts.select("feed", "url", F.lit(1).alias("page")), rows.select("url", "next")
    seen = None
    for page in range(1, most + 1):
        got = kept(at.join(places, "url").select("feed", "page", "url", "next"), "feed-pages")
        seen = got if seen is None else seen.unionByName(got)
        if got.isEmpty():
            break
        at = got.where("next is not null").select("feed", F.col("next").alias("url"), F.lit(page + 1).alias("page")).join(seen.select("feed", "url"), ["feed", "url"], "left_anti")
    return seen.join(rows.select("url", "i"), "url").select("feed", "page", F.posexplode("i").alias("position", "item")).select("feed", "page", "position", "item.*")
