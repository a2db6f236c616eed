"""Queries of the vector index, greedy batches, archives, paged searches and spending, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, licence
from ..functions.tables import new_folder
from ..operators import vectors, viewer
from ..streaming import logs, spending
from .oracles import _with
from .substrate import Substrate

__all__ = ["oracle_sql", "queries"]

_FOUND: dict = {}
_SQL: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and its SQL, under ``name``."""

    def keep(fn):
        _FOUND[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return keep


def queries() -> dict:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


_NEAREST = """
with v as (select vec_id, embedding::double[] as e from embeddings),
scored as (
  select q.vec_id as query, x.vec_id as id, list_cosine_similarity(q.e, x.e) as s from v q join v x on q.vec_id % 50 = 0 and x.vec_id <> q.vec_id)
select query, rank::int as rank, id, round(s, 6) as similarity
from (select *, row_number() over (partition by query order by s desc, id) as rank from scored) where rank <= 10"""


@case("k10_nearest", _NEAREST)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 50, exactly, by the index and its bounds."""
    rows = _embeddings(spark, sf_dir)
    found = vectors.search(vectors.build(rows, "vec_id", "embedding"), rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", exact=True)
    return found.withColumn("similarity", F.round("similarity", 6))


@case("k10_recall")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each such query's ten nearest, how many the index finds by its probes alone."""
    rows = _embeddings(spark, sf_dir)
    index, asked = vectors.build(rows, "vec_id", "embedding"), rows.filter("vec_id % 50 = 0")
    by = lambda exact: vectors.search(index, asked, "vec_id", "embedding", exact=exact)
    return vectors.recall(by(False), by(True))


_SPENT = "select user_id, event_id, (sum(round(coalesce(value, 0.0) * 100)::bigint) over (partition by user_id order by event_id rows unbounded preceding))::bigint as spent from events"


@case("a22_kill_switch", f"select user_id, event_id, spent, spent > {spending.LIMIT} as aborted from ({_SPENT}) where spent <= {spending.LIMIT}")
def kill_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a running kill switch lets through, the stream started anew for each quarter of the table."""
    charges = spending.cents_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return spending.run_slices(charges, 4, new_folder(spark, "spending"), stops=True)


@case("k3_compacted_log", "select user_id, event_type, event_id, value from events where event_id is not null qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, by a log that a restarted stream appends to and that is compacted on the way."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return logs.log_slices(events, 4, "event_id", new_folder(spark, "log"), ["user_id", "event_type"])


_DISPLAY = r""", d as (
  select *, case when regexp_matches(license, '^https?://') then string_split(regexp_extract(license, '^[a-z]+://[^/]*/(.*)$', 1), '/') end as parts0 from papers1),
e as (select *, list_filter(parts0, lambda p: p <> '') as parts, [journal, 'A' || paper_id, 'B'][1 : paper_id % 4] as authors from d)
select paper_id,
  case when token is null then 'no licence' when starts_with(token, 'cc_') then 'CC ' || upper(replace(substr(token, 4), '_', '-')) else token end as licence,
  case when parts is null then null else concat_ws(' ', case when parts[1] = 'publicdomain' and parts[2] = 'zero' then 'CC0' else 'CC ' || upper(parts[2]) end, parts[3], upper(parts[4])) end as deed,
  case when len(authors) = 0 then 'No authors listed in PubMed' when len(authors) = 1 then authors[1] else array_to_string(authors[1 : len(authors) - 1], ', ') || ' and ' || authors[len(authors)] end as creators,
  (paper_id % 3) || case when paper_id % 3 = 1 then ' study' else ' studies' end as counted,
  case when year is null then null else '1 March ' || year end as dated
from e"""


@case("f36_display", _with("papers1") + _DISPLAY)
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's licence, deed, authors, count and date as a viewer spells them; every paper has none to three authors."""
    p = Substrate(spark, sf_dir).papers
    id = F.col("paper_id")
    authors = F.slice(F.array("journal", F.concat(F.lit("A"), id.cast("string")), F.lit("B")), F.lit(1), (id % 4).cast("int"))
    web = F.when(F.col("license").rlike("^https?://"), F.col("license"))
    return p.select(
        "paper_id", display.licence_name(licence.any_token(F.col("license"))).alias("licence"), display.deed_name(web).alias("deed"), display.creators(authors).alias("creators"),
        display.count_of(id % 3, F.lit("studies")).alias("counted"), display.long_date(F.make_date("year", F.lit(3), F.lit(1))).alias("dated"),
    )


_LINKS = r"""with found as (select page_id, regexp_extract_all(html, '\s(?:href|src)="([^"]*)"', 1) as hrefs, html from pages),
links as (select distinct page_id || '.html' as file, unnest(hrefs) as href from found),
files as (select page_id || '.html' as path from pages union select substr(hrefs[1], 2) from found where len(hrefs) > 0),
ids as (select page_id || '.html' as path, unnest(regexp_extract_all(html, '\sid="([^"]+)"', 1)) as id from pages),
cut as (select *, string_split(href, '#')[1] as p, coalesce(string_split(href, '#')[2], '') as id from links where not regexp_matches(href, '^[A-Za-z]+:')),
aimed as (select *, case when p = '' then file else substr(p, 2) end as target from cut),
met as (select *, case when target in (select path from files) then target when target || 'index.html' in (select path from files) then target || 'index.html' end as page from aimed)
select file, href, case when page is null then 'no such file' else 'no such id' end as reason from met
where page is null or (id <> '' and not exists (select 1 from ids where ids.path = page and ids.id = met.id))"""


@case("f37_broken_links", _LINKS)
def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages that open nothing on a site that holds each page under its number, and a file by the name of each page's first link."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    named = F.substring(F.regexp_extract("html", viewer.LINK, 1), 2, 1 << 20)
    has = F.regexp_like("html", F.lit(viewer.LINK))
    files = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return viewer.broken_links(files.unionByName(pages.filter(has).select(named.alias("path"), F.lit("").alias("text"))), "/")
