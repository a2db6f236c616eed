"""Ledgers and rendered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balance(n_in: Column, unit_in: Column, n_out: Column, unit_out: Column, dropped: Column) -> Column:
    """n_in less all dropped less n_out; null where units differ."""
    total = F.aggregate(F.map_values(dropped), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(unit_in == unit_out, n_in - total - n_out)


def report_line(name: Column, n_in: Column, unit_in: Column, n_out: Column, unit_out: Column, dropped: Column, noted: Column) -> Column:
    """The stage's line and one for each reason dropped or noted, by reason."""
    each = lambda m, word: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit(f"  {word} "), e.value.cast("string"), F.lit(": "), e.key))
    head = F.concat(F.rpad(name, 14, " "), n_in.cast("string"), F.lit(" "), unit_in, F.lit(" in -> "), n_out.cast("string"), F.lit(" "), unit_out, F.lit(" out"))
    return F.array_join(F.concat(F.array(head), each(dropped, "dropped"), each(noted, "noted")), "\n")


def render(ranked: DataFrame, members: DataFrame, papers: DataFrame, findings: DataFrame) -> DataFrame:
    """``query_id, key, rank, text``: a group's heading, and its papers by year (unknown last) and id.

    A paper is quoted where it first appears in rank order; later it is marked as quoted above.
    """
    quotes = findings.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "text"))), lambda q: F.concat(F.lit('  "'), q.text, F.lit('"'))), "\n").alias("quotes"))
    rows = ranked.select("query_id", "key", "rank").join(members.select("key", "paper_id"), "key").join(papers.select("paper_id", "year", "journal"), "paper_id").join(quotes, "paper_id", "left")
    again = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("rank")) > 1
    stamp = F.concat(F.lit("- "), F.concat_ws(" · ", F.col("year").cast("string"), "journal", F.concat(F.lit("PMID "), F.col("paper_id").cast("string"))))
    body = F.when(F.col("quotes").isNull(), "  (no finding sentence extracted)").when(again, "  (quoted above)").otherwise(F.col("quotes"))
    lines = rows.withColumn("line", F.concat(stamp, F.lit("\n"), body))
    span = F.when(F.col("lo").isNull(), "year unknown").when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat(F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string")))
    out = lines.groupBy("query_id", "key", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("year", F.lit(9999)).alias("y"), "paper_id", "line"))), lambda x: x.line), "\n").alias("body"), F.count("*").alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    return out.select("query_id", "key", "rank", F.concat(F.lit("## "), F.replace("key", F.lit("|"), F.lit(" — ")), F.lit("\n"), F.col("n").cast("string"), F.lit(" papers, "), span, F.lit(".\n\n"), F.col("body")).alias("text"))


def licence_label(token: Column) -> Column:
    """A licence token as a reader sees it: Creative Commons in capitals with hyphens, others as words."""
    cc = F.upper(F.replace(token, F.lit("_"), F.lit("-")))
    return F.when(token.isNull(), "licence unknown").when(token.startswith("cc"), cc).otherwise(F.replace(token, F.lit("_"), F.lit(" ")))


def dated_title(paper_id: Column, year: Column) -> Column:
    return F.concat(F.lit("paper "), paper_id.cast("string"), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))
