"""Sitemaps: locations from XML, discovery along indexes, filters, and stable target ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions.markup import Tokens
from pagelens.functions.text import glob_pattern
from pagelens.functions.urls import absolute, url_decode
from pagelens.operators.order_stats import in_order

# Budgets of documents and of page URLs.
DOCUMENTS, URLS = 20, 100


class SitemapError(ValueError):
    """A sitemap that gives no targets."""


def locs(xml: str) -> Iterator[tuple[str, str]]:
    """("page" or "sitemap", location) for each loc right inside a url or sitemap element; prefixed names are not read."""
    path: list[str] = []
    text: str | None = None
    for event, name, more in Tokens().feed(xml, last=True):
        if event == "open":
            text = "" if name == "loc" and path[-1:] in (["url"], ["sitemap"]) else text
            path.append(name)
        elif event == "text" and text is not None:
            text += more
        elif event == "close":
            path.pop()
            if name == "loc" and text is not None:
                if found := " ".join(text.split()):
                    yield ("page" if path[-1:] == ["url"] else "sitemap"), found
                text = None


#: Rows of locations that are sent on together.
_ROWS = 10_000


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = (
            (source, kind, k, loc, _page_url(loc))
            for source, xml in zip(batch.column("source").to_pylist(), batch.column("xml"), strict=True)
            for k, (kind, loc) in enumerate(locs(xml.as_py() or ""))
        )
        while rows := list(islice(found, _ROWS)):
            names = ["source", "kind", "ord", "loc", "url"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def locations(docs: DataFrame) -> DataFrame:
    """(source, kind page or sitemap, ord, loc, url) of docs (source, xml); url is null for what is no plain http URL."""
    return docs.select("source", "xml").mapInArrow(_read, "source string, kind string, ord bigint, loc string, url string")


@dataclass
class Discovery:
    """Page URLs in order of discovery, sitemaps read, whether a budget ended it, and what went wrong on the way."""

    urls: list[str] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    truncated: bool = False
    errors: list[str] = field(default_factory=list)


@dataclass
class Reached:
    """What discovery reaches, as tables: pages (url, place), sitemaps (source, depth, key, error) and foreign ones (url, depth, key).

    A sitemap's key is the path of places by which it was first reached: at one depth, keys are in the order of discovery.
    """

    pages: DataFrame
    sitemaps: DataFrame
    foreign: DataFrame
    truncated: bool


def _page_url(text: str) -> str | None:
    found = absolute(None, text)
    return found if found and found.startswith(("http://", "https://")) and "@" not in found.split("/")[2] else None


def captured(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reader for reached() over sitemap documents that are there already (source, xml)."""
    return lambda sources: sources.join(docs.select("source", "xml"), "source", "left").withColumn("error", F.when(F.col("xml").isNull(), "it is not there"))


def reached(
    docs: DataFrame | Callable[[DataFrame], DataFrame], root: str, documents: int | None = DOCUMENTS, urls: int | None = URLS,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), spark: SparkSession | None = None,
) -> Reached:
    """The pages reachable from `root`, breadth first, over documents (source, xml) or a reader of sources; None is no budget.

    A level of sitemaps is one table: it is read, its nested sitemaps are those not met before, each at its first mention,
    and so on. The driver holds a count a level. Index entries are followed on the root's origin only where the root is remote.
    Entries seen before, foreign ones and paths that the patterns leave out cost nothing of the budgets of documents and
    page URLs. A root that can't be read is an error.
    """
    if any(b is not None and b < 1 for b in (documents, urls)):
        raise SitemapError("budgets are positive")
    if isinstance(docs, DataFrame):
        spark, read = docs.sparkSession, captured(docs)
    else:
        read = docs
    site = F.lower(F.lit("/".join(root.split("/")[:3]))) if root.startswith(("http://", "https://")) else None
    level = spark.createDataFrame([(root, [])], "source string, key array<bigint>")
    met, depth, number, truncated = level.select("source"), 0, 0, False
    sitemaps = foreign = pages = None
    add = lambda all_, more: more if all_ is None else all_.unionByName(more)
    found = lambda: path_filtered(pages.groupBy("url").agg(F.min(F.struct("depth", "key", "ord")).alias("first")), list(include), list(exclude))
    while count := level.count():
        if (documents is not None and number >= documents) or (urls is not None and pages is not None and found().count() >= urls):
            truncated = True
            break
        over = documents is not None and number + count > documents
        now = level.orderBy("key").limit(documents - number) if over else level
        number, truncated = number + count, over
        # fetched once, whatever reads it
        got = read(now.select("source")).select("source", "xml", "error").persist(StorageLevel.DISK_ONLY)
        at = F.lit(depth).alias("depth")
        sitemaps = add(sitemaps, now.join(got.select("source", "error"), "source").select("source", at, "key", "error"))
        if depth == 0 and (failed := sitemaps.where("error IS NOT NULL").first()):
            raise SitemapError(f"{root}: {failed.error}")
        listed = locations(got.where("error IS NULL")).where("url IS NOT NULL").join(now, "source")
        pages = add(pages, listed.where("kind = 'page'").select("url", at, "key", "ord"))
        if over:
            break
        nested = listed.where("kind = 'sitemap'").groupBy("url").agg(F.min(F.struct("key", "ord")).alias("first"))
        nested = nested.join(met.withColumnRenamed("source", "url"), "url", "left_anti").select(F.col("url").alias("source"), F.concat("first.key", F.array("first.ord")).alias("key"))
        here = F.lit(True) if site is None else F.lower(F.regexp_extract("source", r"^([a-z]+://[^/]*)", 1)) == site
        foreign = add(foreign, nested.where(~here).select(F.col("source").alias("url"), at, "key"))
        level = nested.where(here).persist(StorageLevel.DISK_ONLY)
        met, depth = met.unionByName(level.select("source")), depth + 1
    known = found().select("url", "first.*")
    if urls is not None:
        kept = known.orderBy("depth", "key", "ord").limit(urls)
        truncated = truncated or known.count() > urls
    else:
        kept = known
    none = spark.createDataFrame([], "url string, depth int, key array<bigint>")
    return Reached(in_order(kept, ["depth", "key", "ord"], "place").select("url", "place"), sitemaps, none if foreign is None else foreign, truncated)


def discover(
    docs: DataFrame | Callable[[DataFrame], DataFrame], root: str, documents: int = DOCUMENTS, urls: int = URLS,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), spark: SparkSession | None = None,
) -> Discovery:
    """What `reached` finds, as lists: at most `urls` pages and `documents` sitemaps; a discovery without a page is an error."""
    met = reached(docs, root, documents, urls, include, exclude, spark)
    read = met.sitemaps.orderBy("depth", "key").collect()
    errors = [f"{r.source}: {r.error}" for r in read if r.error is not None]
    errors += [f"{r.url} is a nested sitemap of another origin" for r in met.foreign.orderBy("depth", "key").toLocalIterator()]
    found = Discovery([r.url for r in met.pages.orderBy("place").collect()], [r.source for r in read if r.error is None], met.truncated, errors)
    if not found.urls:
        raise SitemapError(f"{root} gives no page URL")
    return found


def path_filtered(urls: DataFrame, include: list[str], exclude: list[str], column: str = "url") -> DataFrame:
    """URLs whose path matches any include pattern (or there is none) and no exclude pattern."""
    path = F.regexp_replace(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^$", "/")
    keep = F.lit(not include)
    for g in include:
        keep = keep | path.rlike(glob_pattern(g))
    for g in exclude:
        keep = keep & ~path.rlike(glob_pattern(g))
    return urls.where(keep)


def slug(path: Column) -> Column:
    """Letters and digits of a decoded path joined by dashes, 48 characters at most; home for the root."""
    text = F.regexp_replace(F.lower(path), r"[^a-z0-9]+", "-")
    text = F.regexp_replace(text, r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(text, 1, 48), r"-+$", "")
    bare = F.regexp_replace(path, r"^/+|/+$", "") == ""
    return F.when(bare, "home").when(cut == "home", "home-page").when(cut == "", "page").otherwise(cut)


def target_ids(urls: DataFrame) -> DataFrame:
    """(url, id) for distinct URLs: the slug where it is unique, else with a digest of path and query, then a number."""
    rest = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    each = urls.select("url").distinct().withColumn("rest", F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    each = each.withColumn("base", slug(url_decode(F.substring_index("rest", "?", 1))))
    shared = each.groupBy("base").agg(F.count("*").alias("n"))
    digest = F.concat_ws("-", "base", F.substring(F.sha2("rest", 256), 1, 8))
    named = each.join(shared, "base").withColumn("key", F.when(F.col("n") == 1, F.col("base")).otherwise(digest))
    # only URLs that share path and query, on different origins, meet in one key
    place = F.row_number().over(Window.partitionBy("key").orderBy("url"))
    return named.withColumn("place", place).select("url", F.when(F.col("place") == 1, F.col("key")).otherwise(F.concat_ws("-", "key", F.col("place").cast("string"))).alias("id"))


def merged_targets(sources: list[DataFrame]) -> DataFrame:
    """Targets of several sources (url, ord, ...), the first source and place winning; earlier sources first."""
    tagged = None
    for k, df in enumerate(sources):
        part = df.withColumn("source_ord", F.lit(k))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("url").orderBy("source_ord", "ord"))
    return tagged.withColumn("_place", place).where("_place = 1").drop("_place")


def conflicting_targets(targets: DataFrame, contract: list[str]) -> DataFrame:
    """URLs that are listed twice with different contracts."""
    return targets.groupBy("url").agg(F.count_distinct(F.to_json(F.struct(*contract))).alias("n")).where("n > 1").select("url")

