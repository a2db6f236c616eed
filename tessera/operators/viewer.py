"""What a published site of saved runs must hold: links that open, anchors that resolve, excerpts that can be attributed."""

from __future__ import annotations

import hashlib
import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attributes that hold a link, and ids; a scheme at a link's start; the address of licence deeds.
LINK, IDENTIFIER, SCHEME = r'\s(?:href|src)="([^"]*)"', r'\sid="([^"]+)"', "^[A-Za-z]+:"
DEEDS = "https://creativecommons.org/"


def resolved_path(file: Column, path: Column, base: str) -> Column:
    """The file, relative to the site, that ``path`` opens from ``file``: absolute paths count from the base, ``..`` goes up, and a
    trailing slash stays."""
    inside = F.split(F.substring(path, len(base) + 1, 2**31 - 1), "/")
    beside = F.concat(F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1), F.split(path, "/"))
    parts = F.when(path.startswith("/"), inside).otherwise(beside)
    up = F.aggregate(
        F.filter(parts, lambda p: ~p.isin(".", "")),
        F.array().cast("array<string>"),
        lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    joined = F.array_join(up, "/")
    return F.when(path.endswith("/") & (joined != ""), F.concat(joined, F.lit("/"))).otherwise(joined)


def broken_links(files: DataFrame, base: str) -> DataFrame:
    """``file, href, reason`` of links of HTML files (``path, text``) that open nothing on the site: outside the base path, no such file, no such id.

    Links with a scheme lead elsewhere and pass. A folder opens its index. Files and ids meet the links by equi-joins.
    """
    pages = files.select("path", "text")
    links = pages.filter(F.col("path").endswith(".html")).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("href"))
    cut = F.split("href", "#")
    links = links.filter(~F.col("href").rlike(SCHEME)).distinct().select("file", "href", F.get(cut, F.lit(0)).alias("_path"), F.get(cut, F.lit(1)).alias("_id"))
    outside = (F.col("_path") != "") & F.col("href").startswith("/") & ~F.col("href").startswith(base)
    target = F.when(F.col("_path") == "", F.col("file")).otherwise(resolved_path(F.col("file"), F.col("_path"), base))
    links = links.withColumn("_outside", outside).withColumn("_target", target).withColumn("_index", F.concat(target, F.lit("index.html")))
    there = pages.select(F.col("path").alias("_there")).distinct()
    x = links.join(there, F.col("_target") == F.col("_there"), "left").withColumn("_direct", F.col("_there")).drop("_there")
    x = x.join(there, F.col("_index") == F.col("_there"), "left").withColumn("_page", F.coalesce("_direct", "_there")).drop("_there")
    ids = pages.select(F.col("path").alias("_page"), F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(1))).alias("_id")).distinct().withColumn("_known", F.lit(True))
    x = x.join(ids, ["_page", "_id"], "left")
    wanted = F.coalesce(F.col("_id"), F.lit("")) != ""
    reason = F.when(F.col("_outside"), "outside the base path").when(F.col("_page").isNull(), "no such file").when(wanted & F.col("_known").isNull(), "no such id")
    return x.select("file", "href", reason.alias("reason")).filter("reason is not null")


def anchor(text: Column) -> Column:
    """(kind, stage, reason, key) of an anchor: ``stage:<stage>/dropped/<reason>`` or ``cluster:<key>``; null where it is neither."""
    stage, cluster = r"^stage:(.+?)/dropped/(.+)$", r"(?s)^cluster:(.+)$"
    none = F.lit(None).cast("string")
    return F.when(text.rlike(stage), F.struct(F.lit("stage").alias("kind"), F.regexp_extract(text, stage, 1).alias("stage"), F.regexp_extract(text, stage, 2).alias("reason"), none.alias("key"))).when(
        text.rlike(cluster), F.struct(F.lit("cluster").alias("kind"), none.alias("stage"), none.alias("reason"), F.regexp_extract(text, cluster, 1).alias("key"))
    )


def unresolved_anchors(anchors: DataFrame, ledger: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of ``anchors`` (``anchor``) that name no ledger line (``stage, reason``) and no group (``key``)."""
    a = anchors.withColumn("_a", anchor(F.col("anchor")))
    lines = ledger.select(F.col("stage").alias("_s"), F.col("reason").alias("_r"), F.lit(True).alias("_line")).distinct()
    keys = clusters.select(F.col("key").alias("_k"), F.lit(True).alias("_group")).distinct()
    x = a.join(lines, (F.col("_a.stage") == F.col("_s")) & (F.col("_a.reason") == F.col("_r")), "left").join(keys, F.col("_a.key") == F.col("_k"), "left")
    return x.filter("_line is null and _group is null").select(*anchors.columns)


def unattributable_excerpts(papers: DataFrame) -> DataFrame:
    """Papers (``excerpted, license_url``) that are quoted without a link to a licence deed."""
    return papers.filter(F.col("excerpted") & ~F.coalesce(F.col("license_url").startswith(DEEDS), F.lit(False)))


def unmatched_notes(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """``slug, side`` of runs without a note and notes without a run."""
    from .selection import unmatched

    return unmatched(runs, notes, ["slug"])


def load_runs(spark: SparkSession, path: str, version: int, arrays: tuple[str, ...] = ("clusters", "stages")) -> DataFrame:
    """Saved runs, one JSON file each. A file whose schema version differs, whose name isn't its slug or that lacks an array raises when read."""
    fields = ", ".join(f"{a} array<string>" for a in arrays)
    runs = spark.read.schema(f"schema_version int, slug string, {fields}").option("multiLine", True).json(path).withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    wrong = F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "schema version").when(~F.col("slug").eqNullSafe(F.col("_file")), "slug")
    for a in arrays:
        wrong = wrong.when(F.col(a).isNull(), f"no {a}")
    checked = F.when(wrong.isNull(), F.col("slug")).otherwise(F.raise_error(F.concat(F.col("_file"), F.lit(": "), wrong)))
    return runs.withColumn("slug", checked).drop("_file")


def provenance(settings: dict, code_version: str, made: date) -> str:
    """Sixteen digits that name a run's settings and code; key order and white space don't count."""
    canonical = json.dumps({"settings": settings, "code": code_version, "made": made.isoformat()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(canonical.encode()).hexdigest()[:16]
