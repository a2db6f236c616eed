"""Responses of literature services: fetching with retries, and parsing of articles, permissions, searches and preprints.

Responses are rows (``body``); they come from files, or from ``fetch`` with a transport of the caller's. Parsing is in
Spark expressions. What can't be read as a licence gives none, so the gate closes.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import lines

#: Statuses that are worth another try, tries after the first, and the waits in seconds.
RETRIED, TRIES, BASE, CAP = (429, 500, 502, 503, 504), 4, 0.5, 8.0
_AUTHOR = r"(?s)<Author(?:\s[^>]*)?>.*?</Author>"
_SECTION = r"(?s)<AbstractText(?:\s[^>]*)?(?<!/)>.*?</AbstractText>"


def with_retry(send: Callable[[], tuple[int, str]], sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> str:
    """The body of a request that is sent again on passing failures, after waits of full jitter; others raise."""
    for n in range(TRIES + 1):
        status, body = send()
        if 200 <= status < 300:
            return body
        if status not in RETRIED or n == TRIES:
            raise OSError(f"status {status} after {n + 1} tries")
        sleep(draw() * min(CAP, BASE * 2**n))
    raise AssertionError


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]]) -> DataFrame:
    """``url, body`` of every row of ``urls``, fetched on the executors by ``get`` with retries."""

    def run(frames):
        for f in frames:
            yield f.assign(body=[with_retry(lambda u=u: get(u)) for u in f["url"]])[["url", "body"]]

    return urls.select("url").mapInPandas(run, "url string, body string")


def download_report(spark: SparkSession, url: str, get: Callable[[str], tuple[int, Iterable[bytes]]], folder: str) -> str:
    """Keeps the lines of a report that a service serves gzipped as text under ``folder``, for the readers of files.py, and returns it.

    ``get`` answers with the body in pieces. One task unpacks them as they come, since a gzip stream has no second beginning; it holds a piece and a line. A
    byte order mark before the first line goes; a body that ends early raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                held, unpack = [], zlib.decompressobj(31)
                for i, line in enumerate(lines(_unpacked(unpack, with_retry(lambda at=at: get(at))))):
                    held.append(line.removeprefix("\ufeff") if i == 0 else line)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pydict({"value": held})
                        held = []
                if not unpack.eof:
                    raise OSError(f"{at} ends early")
                yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})

    spark.createDataFrame([(url,)], "url string").coalesce(1).mapInArrow(run, "value string").write.mode("errorifexists").text(folder)
    return folder


def _unpacked(unpack, pieces: Iterable[bytes]) -> Iterator[bytes]:
    for piece in pieces:
        yield unpack.decompress(piece)
    yield unpack.flush()


def _elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``body``: one row an element; files are cut at the closing tag, so large ones are read in parts."""
    close = f"</{tag}>"
    body = F.regexp_extract("value", rf"(?s)(<{tag}(?:\s[^>]*)?>.*)$", 1)
    return spark.read.option("lineSep", close).text(path).select(body.alias("b")).filter("b <> ''").select(F.concat("b", F.lit(close)).alias("body"))


def _at(xml: Column, path: str) -> Column:
    s = F.trim(F.xpath_string(xml, F.lit(path)))
    return F.when(s != "", s)


def own_id(xml: Column, kind: str) -> Column:
    """An article's own identifier, by its direct path: a reference list holds other articles' identifiers."""
    return _at(xml, f"PubmedArticle/PubmedData/ArticleIdList/ArticleId[@IdType='{kind}']")


def abstract(xml: Column) -> Column:
    """Sections in order, each with its label before it, joined by line ends; null without text."""
    inside = F.regexp_extract(xml, r"(?s)<Abstract>.*?</Abstract>", 0)
    parts = F.transform(F.regexp_extract_all(inside, F.lit(_SECTION), F.lit(0)), lambda x: F.struct(_at(x, "AbstractText").alias("t"), _at(x, "AbstractText/@Label").alias("l")))
    lines = F.transform(F.filter(parts, lambda p: p.t.isNotNull()), lambda p: F.concat_ws(": ", p.l, p.t))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def _year(raw: Column) -> Column:
    return F.when(raw.rlike("^[0-9]+$"), raw.cast("int"))


def pmc_id(raw: Column) -> Column:
    """A repository id without prefix, upper-cased; blank ones are null."""
    s = F.regexp_replace(F.upper(F.trim(raw)), "^PMC", "")
    return F.when(s != "", s)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, pmid, doi, pmcid, title, abstract, authors, journal, year`` of a file of articles.

    Titles keep the text inside their markup. An author is a name or, failing that, a group's. The id is the doi, else the pmid.
    """
    a = "PubmedArticle/MedlineCitation/Article/"
    x = F.col("body")
    name = lambda e: F.coalesce(F.when(_at(e, "Author/LastName").isNotNull(), F.concat_ws(" ", _at(e, "Author/ForeName"), _at(e, "Author/LastName"))), _at(e, "Author/CollectiveName"))
    authors = F.transform(F.regexp_extract_all(x, F.lit(_AUTHOR), F.lit(0)), lambda e: F.struct(name(e).alias("name"), _at(e, "Author/AffiliationInfo/Affiliation").alias("affiliation")))
    rows = _elements(spark, path, "PubmedArticle").select(
        _at(x, "PubmedArticle/MedlineCitation/PMID").alias("pmid"), own_id(x, "doi").alias("doi"), pmc_id(own_id(x, "pmc")).alias("pmcid"), _at(x, a + "ArticleTitle").alias("title"), abstract(x).alias("abstract"),
        F.filter(authors, lambda e: e["name"].isNotNull()).alias("authors"), _at(x, a + "Journal/Title").alias("journal"), _year(_at(x, a + "Journal/JournalIssue/PubDate/Year")).alias("year"),
    )
    return rows.select(F.coalesce("doi", "pmid").alias("paper_id"), "*")


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, abstract, year`` alone; an article without a pmid goes, one without an abstract stays."""
    x = F.col("body")
    year = _year(_at(x, "PubmedArticle/MedlineCitation/Article/Journal/JournalIssue/PubDate/Year"))
    return _elements(spark, path, "PubmedArticle").select(_at(x, "PubmedArticle/MedlineCitation/PMID").alias("pmid"), abstract(x).alias("abstract"), year.alias("year")).filter("pmid is not null")


def permissions(spark: SparkSession, path: str) -> DataFrame:
    """``pmcid, license, copyright``: a licence reference's text wins over a link; articles without either licence have null."""
    got = lambda pattern: F.nullif(F.trim(F.regexp_extract("body", pattern, 1)), F.lit(""))
    licence = F.coalesce(got(r"(?s)<ali:license_ref[^>]*>([^<]*)<"), got(r'(?s)<license\s[^>]*xlink:href="([^"]*)"'))
    rows = _elements(spark, path, "article").select(pmc_id(got(r'<article-id pub-id-type="pmcid">([^<]*)<')).alias("pmcid"), licence.alias("license"), got(r"(?s)<copyright-statement>([^<]*)<").alias("copyright"))
    return rows.filter("pmcid is not null").dropDuplicates(["pmcid"])


def with_permissions(papers: DataFrame, granted: DataFrame) -> DataFrame:
    """Papers with licence and copyright, null where none is known."""
    return papers.join(granted, "pmcid", "left")


def search_results(responses: DataFrame) -> DataFrame:
    """``ids, terms``: ids in the service's order, and the quoted terms into which it translated the question, distinct, in order."""
    x = F.col("body")
    terms = F.flatten(F.transform(F.xpath(x, F.lit("eSearchResult/TranslationSet/Translation/To/text()")), lambda t: F.regexp_extract_all(t, F.lit(r'"([^"]+)"\['), F.lit(1))))
    return responses.select(F.xpath(x, F.lit("eSearchResult/IdList/Id/text()")).alias("ids"), F.array_distinct(terms).alias("terms"))


def preprints(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, doi, title, abstract, authors, year, license, server`` of preprint responses (JSON, one object a file or line)."""
    fields = "doi string, title string, authors string, date string, license string, abstract string, server string"
    clean = lambda c: F.when(~F.upper(F.trim(c)).isin("NA", ""), F.trim(c))
    rows = spark.read.schema(f"collection array<struct<{fields}>>").option("multiLine", True).json(path).select(F.inline("collection"))
    names = F.filter(F.transform(F.split(clean("authors"), ";"), lambda n: F.trim(n)), lambda n: n != "")
    return rows.select(clean("doi").alias("paper_id"), clean("doi").alias("doi"), clean("title").alias("title"), clean("abstract").alias("abstract"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), _year(F.substring("date", 1, 4)).alias("year"), clean("license").alias("license"), F.when(F.lower("server") == "medrxiv", "medrxiv").otherwise("biorxiv").alias("server"))
