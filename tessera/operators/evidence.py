"""Evidence and audits: contexts of mentions, entity filters, document checks, concept look-up, abbreviations, identifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality
from ..functions.arrays import bound
from ..functions.tables import written
from ..functions.text import contains_phrase
from .pairing import first_by

#: Least length of a document, in characters, and what ends a sentence inside it.
LEAST_CHARS, BREAK = 100, r"""[.!?]["')\]]?\s+\S"""


def concepts_of_papers(papers: DataFrame, mentions: DataFrame) -> DataFrame:
    """``paper_id, concepts``: the sorted distinct linked concepts of every paper, an empty list where there are none."""
    held = mentions.filter("canonical_id is not null").select("paper_id", "canonical_id").distinct().groupBy("paper_id").agg(F.sort_array(F.collect_list("canonical_id")).alias("concepts"))
    return papers.select("paper_id").join(held, "paper_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def arm_report(gated: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Papers, silent papers and mean findings of each group; the mean divides by all papers, silent ones included."""
    n = findings.groupBy("paper_id").agg(F.count("*").alias("_n"))
    x = gated.select("paper_id", by).join(n, "paper_id", "left")
    return x.groupBy(by).agg(F.count("*").alias("papers"), F.count_if(F.col("_n").isNull()).alias("silent"), (F.coalesce(F.sum("_n"), F.lit(0)) / F.count("*")).alias("mean_findings"))


def mention_evidence(mentions: DataFrame, papers: DataFrame, flag: str, contexts: int = 2) -> DataFrame:
    """``text, canonical_id, n_mentions, any_flag, contexts``: of each surface and concept, with windows from the first papers,
    one a paper. Texts are joined for the chosen mentions alone."""
    pair = ["text", "canonical_id"]
    counts = mentions.groupBy(*pair).agg(F.count("*").alias("n_mentions"), F.bool_or(flag).alias("any_flag"))
    one = mentions.groupBy(*pair, "paper_id").agg(F.min(F.struct("start", "end")).alias("_span"))
    few = first_by(one, pair, ["paper_id"], contexts).join(papers.select("paper_id", "abstract"), "paper_id")
    shown = few.select(*pair, F.struct("paper_id", quality.context_window(F.col("abstract"), F.col("_span.start"), F.col("_span.end")).alias("c")).alias("_c"))
    return counts.join(shown.groupBy(*pair).agg(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c.c).alias("contexts")), pair)


def kept_entities(scored: DataFrame, labels: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """Entities of a known label at or above the score threshold, with the label's canonical name."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("label"))
    return scored.withColumn("label", name).filter(F.col("label").isNotNull() & (F.col("score") >= threshold))


def document_context(papers: DataFrame, entities: DataFrame) -> DataFrame:
    """``paper_id, verdict``: the first check that a document fails, or ok. Offsets must lie within the text, surfaces equal the text
    there, and the text be a document: long enough, with a sentence break."""
    inner = entities.join(papers.select("paper_id", "abstract"), "paper_id")
    outside = (F.col("end") > F.length("abstract")) | (F.col("start") < 0)
    differs = F.substring(F.col("abstract"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")
    flags = inner.groupBy("paper_id").agg(F.bool_or(outside).alias("_o"), F.bool_or(differs).alias("_d"))
    verdict = F.when(F.col("_o"), "out_of_bounds").when(F.col("_d"), "surface_mismatch").when(F.length("abstract") < LEAST_CHARS, "too_short").when(~F.col("abstract").rlike(BREAK), "no_sentence_break").otherwise("ok")
    return papers.select("paper_id", "abstract").join(flags, "paper_id", "left").select("paper_id", verdict.alias("verdict"))


def identifier_audit(stored: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """``key, verdict``: same or differs by a null-safe comparison; unverifiable where no own record exists."""
    o = own.select(key, F.col(value).alias("_own"), F.lit(True).alias("_found"))
    return stored.join(o, key, "left").select(key, F.when(F.col("_found").isNull(), "unverifiable").when(F.col(value).eqNullSafe(F.col("_own")), "same").otherwise("differs").alias("verdict"))


def concept_names(aliases: DataFrame) -> DataFrame:
    """``concept_id, name``: the last preferred name, else the first of any."""
    first, last = F.min_by("name", "ord"), F.max_by("name", F.when(F.col("is_preferred"), F.col("ord")))
    return aliases.groupBy("concept_id").agg(F.coalesce(last, first).alias("name"))


def alias_table(aliases: DataFrame) -> DataFrame:
    """``alias, concept_id`` of folded names; a preferred one wins, and of several the last."""
    a = aliases.withColumn("alias", F.array_join(quality.alias_words(quality.fold(F.col("alias_key"))), " ")).filter("alias <> ''")
    return a.groupBy("alias").agg(F.max_by("concept_id", F.struct("is_preferred", "ord", "concept_id")).alias("concept_id"))


def _distinct_words(text: str) -> Column:
    return F.array_distinct(quality.alias_words(F.col(text)))


def _concepts_met(words: DataFrame, rows: DataFrame, aliases: DataFrame, texts: list[str], flag: Callable[..., Column], longest: int) -> DataFrame:
    """``paper_id, concept_id, _in`` of ``words`` (``paper_id, word, _in``) and folded ``rows``, repeats kept.

    Words meet the aliases by their first word, so a text sends each of its words once and no run of words. Only where the first word of an
    alias of several words stands in a text is that text looked at again; ``flag`` is then made of whether the alias stands in each of ``texts``.
    """
    each = F.split("alias", " ")
    named = alias_table(aliases).filter(F.size(each) <= longest).select(each[0].alias("word"), "concept_id", F.when(F.size(each) > 1, each).alias("_alias"))
    met = written(words.join(named, "word").select("paper_id", "concept_id", "_alias", "_in"))
    begun = written(met.filter("_alias is not null").groupBy("paper_id").agg(F.collect_set(F.struct("concept_id", "_alias")).alias("_begun")))
    again = rows.join(begun, "paper_id").select("paper_id", F.explode("_begun").alias("_x"), *[quality.alias_words(F.col(t)).alias(t) for t in texts])
    stands = [contains_phrase(F.col(t), F.col("_x._alias")) for t in texts]
    whole = again.filter(F.greatest(*stands) if len(stands) > 1 else stands[0]).select("paper_id", "_x.concept_id", flag(*stands).alias("_in"))
    return met.filter("_alias is null").select("paper_id", "concept_id", "_in").unionByName(whole)


def text_concepts(rows: DataFrame, aliases: DataFrame, text: str = "abstract", longest: int = 6) -> DataFrame:
    """``paper_id, concept_id``: distinct concepts an alias of which stands in a text, by aliases of 1 to ``longest`` words."""
    folded = rows.select("paper_id", quality.fold(F.col(text)).alias("_f"))
    words = folded.select("paper_id", F.explode(_distinct_words("_f")).alias("word"), F.lit(True).alias("_in"))
    return _concepts_met(words, folded, aliases, ["_f"], lambda x: x, longest).select("paper_id", "concept_id").distinct()


def unsourced_concepts(rows: DataFrame, aliases: DataFrame, output: str, source: str, longest: int = 6) -> DataFrame:
    """``paper_id, concept_id``: concepts of an output that its source doesn't name by any alias. Output and source are looked up together, each word once."""
    folded = rows.select("paper_id", quality.fold(F.col(output)).alias("_o"), quality.fold(F.col(source)).alias("_s"))
    listed = folded.select("paper_id", _distinct_words("_o").alias("_o"), F.coalesce(_distinct_words("_s"), F.array().cast("array<string>")).alias("_s"))
    mark = lambda words, sourced: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(sourced).alias("_in")))
    words = listed.select("paper_id", F.inline(F.concat(mark(F.coalesce(F.array_except("_o", "_s"), F.array().cast("array<string>")), False), mark(F.col("_s"), True))))
    met = _concepts_met(words, folded, aliases, ["_o", "_s"], lambda o, s: F.coalesce(s, F.lit(False)), longest)
    return met.groupBy("paper_id", "concept_id").agg(F.bool_or("_in").alias("_in")).filter("not _in").select("paper_id", "concept_id")


#: Papers of a set up to which its tokens are counted as one group, and most groups that those of a larger one are split into.
SET_BLOCK, SET_SPLITS = 2_048, 64
#: Classes of tokens that are numbered side by side.
NUMBERED = 1_024


def _numbered(words: DataFrame) -> DataFrame:
    """``token, id``: whole numbers of the tokens that two papers or more have, dealt by classes of a hash, so no task numbers all."""
    shared = words.groupBy("token").agg(F.count("*").alias("_df")).filter("_df > 1").withColumn("_c", F.pmod(F.xxhash64("token"), F.lit(NUMBERED)).cast("int"))
    place = F.row_number().over(Window.partitionBy("_c").orderBy("token"))
    return shared.select("token", ((place - 1) * NUMBERED + F.col("_c")).alias("id"))


def _once(rows: pa.Table) -> pa.Table:
    """How many numbers of each paper no other paper of its set has."""
    ids = rows["ids"].combine_chunks()
    values, owner = pc.list_flatten(ids).to_numpy(), pc.list_parent_indices(ids).to_numpy()
    _, first, n = np.unique(values, return_index=True, return_counts=True)
    k = np.bincount(owner[first[n == 1]], minlength=rows.num_rows)
    return rows.select(["_x", "_y", "_n", "paper_id"]).append_column("_k", pa.array(k, pa.int64()))


def distinguishing_tokens(members: DataFrame, findings: DataFrame, least: int = 4) -> DataFrame:
    """``key, paper_id, n_tokens, category``: tokens of a paper's findings that no other paper of the group has.

    Papers without findings and papers whose tokens all stand elsewhere too are told apart. What the tokens of a group are follows from its
    papers, and many keys have the same ones: each set of papers (by two 64-bit hashes and its size) is counted once, for all its keys. A token that only one paper has
    distinguishes it everywhere; the others travel as one array of numbers a paper and set, not as rows.
    """
    tokens = F.filter(quality.alias_words(F.col("_f")), lambda w: F.length(w) >= least)
    # a paper whose findings have no token is a row of a null one, so that the texts are read once
    words = written(findings.select("paper_id", quality.fold(F.col("text")).alias("_f")).select("paper_id", F.explode_outer(tokens).alias("token")).distinct())
    papers = written(words.join(written(_numbered(words.filter("token is not null"))), "token", "left").groupBy("paper_id").agg(F.count_if(F.col("token").isNotNull() & F.col("id").isNull()).alias("_own"), F.sort_array(F.collect_list("id")).alias("ids")))
    in_key = members.select("key", "paper_id").distinct()
    sets = in_key.groupBy("key").agg(F.bit_xor(F.xxhash64("paper_id")).alias("_x"), F.bit_xor(F.xxhash64("paper_id", F.lit(1))).alias("_y"), F.count("*").alias("_n"))
    held = written(in_key.join(sets, "key"))
    of_set = held.select("_x", "_y", "_n", "paper_id").distinct().join(papers.select("paper_id", "ids"), "paper_id")
    splits = F.least(F.lit(SET_SPLITS), F.ceil(F.col("_n") / SET_BLOCK)).cast("int")
    whole = of_set.filter(splits == 1).withColumn("_b", F.lit(0))
    split = of_set.filter(splits > 1).withColumn("_s", splits).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    split = split.withColumn("ids", F.filter("ids", lambda x: F.pmod(F.floor(x / NUMBERED), F.col("_s")) == F.col("_b"))).drop("_s")
    counted = whole.unionByName(split).groupBy("_x", "_y", "_n", "_b").applyInArrow(_once, T.StructType([*(of_set.schema[c] for c in ("_x", "_y", "_n", "paper_id")), T.StructField("_k", T.LongType())]))
    own = counted.groupBy("_x", "_y", "_n", "paper_id").agg(F.sum("_k").alias("_k"))
    x = held.join(own, ["_x", "_y", "_n", "paper_id"], "left").join(papers.select("paper_id", "_own"), "paper_id", "left").withColumn("n_tokens", F.coalesce(F.col("_own") + F.col("_k"), F.lit(0)).cast("long"))
    category = F.when(F.col("n_tokens") > 0, "scorable").when(F.col("_own").isNotNull(), "indistinguishable").otherwise("no_findings")
    return x.select("key", "paper_id", "n_tokens", category.alias("category"))


def attributable(members: DataFrame) -> DataFrame:
    """``key, paper_id, attributable``: whether a paper's year and journal name it alone within its group.

    Counted by a grouping and a join, so a large group doesn't meet in one task.
    """
    n = members.groupBy("key", "year", "journal").agg(F.count("*").alias("_n"), F.min("paper_id").alias("paper_id")).filter("_n = 1 and year is not null and journal is not null")
    x = members.select("key", "paper_id").join(n.select("key", "paper_id", F.lit(True).alias("_one")), ["key", "paper_id"], "left")
    return x.select("key", "paper_id", F.coalesce("_one", F.lit(False)).alias("attributable"))


#: What stands in parentheses, and what a short form is.
PARENTHESES, SHORT = r"\([^()]{2,15}\)", r"^(?=[\p{L}\p{N}])(?=.*\p{L})(?U)\S{2,10}\z"
#: The words looked at before a parenthesis: five more than the longest short form has characters.
MOST_WORDS = 15
#: A word (a letter or digit of ASCII, and more of them or hyphens) of a text read backwards, with what stands behind it in the text.
_BACKWARDS = r"(?:[^A-Za-z0-9-]|-+(?![A-Za-z0-9-]))*[A-Za-z0-9-]*[A-Za-z0-9]"


def abbreviations(rows: DataFrame, text: str = "abstract") -> DataFrame:
    """``paper_id, short, long``: abbreviations a text defines in parentheses; the first definition of each wins.

    The long form is the shortest run of words before the parenthesis, of at most five more than the short form has
    characters, that begins with its first letter and holds its letters in order. Texts without parentheses, null ones too, have none.
    """
    some = rows.select("paper_id", text).filter(F.col(text).contains("("))
    return some.select("paper_id", F.inline(definitions(F.col(text))))


def definitions(text: Column) -> Column:
    """Array of (short, long) of a text, as a fold along its parentheses inside the row.

    The state holds the last words so far, backwards, so that they are the start of a string and are taken off it in one anchored match: no
    prefix of the text is read again. Whether a run holds the letters in order is one lazy pattern made of them.
    """
    none = F.array().cast("array<struct<short:string,long:string>>")
    items = F.arrays_zip(F.split(text, PARENTHESES, -1).alias("gap"), F.regexp_extract_all(text, F.lit(PARENTHESES), F.lit(0)).alias("held"))
    begin = F.struct(F.lit("").alias("tail"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.concat(F.reverse(x.gap), s.tail)
        return bound(F.struct(before.alias("b"), _words_of(before).alias("w"), F.regexp_replace(F.substring(x.held, 2, F.length(x.held) - 2), r"(?U)^\s+|\s+$", "").alias("short")), lambda v: added(s, x, v))

    def added(s: Column, x: Column, v: Column) -> Column:
        known = F.exists(s.out, lambda d: d.short == v.short)
        long = F.when(x.held.isNotNull() & F.rlike(v.short, F.lit(SHORT)) & ~known, _long_form(v.w, v.short))
        out = F.when(long.isNotNull(), F.concat(s.out, F.array(F.struct(v.short.alias("short"), long.alias("long"))))).otherwise(s.out)
        # the last words alone are kept, and the parenthesis before them
        return F.struct(F.concat(F.reverse(F.coalesce(x.held, F.lit(""))), F.array_join(v.w, "")).alias("tail"), out.alias("out"))

    return F.aggregate(items, begin, step, lambda s: s.out)


def _words_of(backwards: Column) -> Column:
    """The first ``MOST_WORDS`` words, each with what precedes it, of a text read backwards.

    Anchored matches take them off one by one, so the text behind them isn't read.
    """
    grown = F.struct(F.array().cast("array<string>").alias("words"), backwards.alias("rest"))

    def take(s: Column, _: Column) -> Column:
        return bound(F.regexp_extract(s.rest, f"^{_BACKWARDS}", 0), lambda m: F.when(m != "", F.struct(F.concat(s.words, F.array(m)).alias("words"), F.substring(s.rest, F.length(m) + 1, F.lit(1 << 30)).alias("rest"))).otherwise(F.struct(s.words.alias("words"), F.lit("").alias("rest"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_WORDS)), grown, take, lambda s: s.words)


def _long_form(words: Column, short: Column) -> Column:
    """The shortest run of the last words that defines ``short``, or null."""
    letters = F.regexp_extract_all(F.lower(short), F.lit(r"[\p{L}\p{N}]"), F.lit(0))
    pattern = F.concat(F.lit("(?s)^"), F.array_join(letters, ".*?"))
    most = F.least(F.size(words), F.length(short) + 5)
    runs = F.transform(F.filter(F.sequence(F.lit(1), F.lit(MOST_WORDS)), lambda n: n <= most), lambda n: F.regexp_replace(F.reverse(F.array_join(F.slice(words, F.lit(1), n), "")), r"(?U)\s+$", ""))
    return F.get(F.filter(runs, lambda r: F.rlike(F.lower(r), pattern)), F.lit(0))


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans share a character; null offsets never do."""
    return F.coalesce(F.greatest(a_start, b_start) < F.least(a_end, b_end), F.lit(False))


def repeat_appearances(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """``query_id, paper_id, repeats``: appearances of a paper after its first."""
    n = ranked.join(members, "key").groupBy("query_id", "paper_id").agg(F.count("*").alias("n"))
    return n.filter("n > 1").select("query_id", "paper_id", (F.col("n") - 1).alias("repeats"))


def cited_order(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """``query_id, paper_id, position``: papers in the order of their first appearance."""
    first = ranked.join(members, "key").groupBy("query_id", "paper_id").agg(F.min(F.struct("rank", "paper_id")).alias("_at"))
    return first.select("query_id", "paper_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_at")).alias("position"))


def published(ranked: DataFrame, clusters: DataFrame, members: DataFrame, papers: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, rank, title, paper_id, proximity, excerpted``: the closed projection of a run that may be published.

    A title shows names, and ids where there is no name; a paper is excerpted if it is licensed and has findings.
    """
    x = ranked.join(clusters.select("key", "chemical_id", "disease_id"), "key")
    for side in ("chemical", "disease"):
        x = x.join(names.select(F.col("concept_id").alias(f"{side}_id"), F.col("name").alias(f"_{side}")), f"{side}_id", "left").withColumn(f"_{side}", F.coalesce(f"_{side}", f"{side}_id"))
    held = found.select("paper_id", F.lit(True).alias("_found"))
    y = x.join(members.select("key", "paper_id"), "key").join(papers.select("paper_id", "extraction_allowed"), "paper_id").join(held, "paper_id", "left")
    near = F.when(~F.coalesce(F.col("proximity").isin(float("inf")), F.lit(False)), F.col("proximity"))
    return y.select("query_id", "rank", F.concat_ws(" / ", "_chemical", "_disease").alias("title"), "paper_id", near.alias("proximity"), (F.col("extraction_allowed") & F.coalesce("_found", F.lit(False))).alias("excerpted"))


def not_verbatim(findings: DataFrame, papers: DataFrame) -> DataFrame:
    """``paper_id, sentence_index`` of findings (with ``start, end, text``) that don't stand in their paper's text at their place."""
    f = findings.join(papers.select("paper_id", "abstract"), "paper_id", "left")
    here = F.substring(F.col("abstract"), F.col("start") + 1, F.col("end") - F.col("start"))
    return f.filter(~here.eqNullSafe(F.col("text"))).select("paper_id", "sentence_index")


def paper_document_mismatches(papers: DataFrame, documents: DataFrame) -> DataFrame:
    """``paper_id, verdict`` where papers (``abstract``) and documents (``text``) aren't one to one and equal: missing, extra or differs."""
    p, d = papers.select("paper_id", "abstract", F.lit(True).alias("_p")), documents.select("paper_id", "text", F.lit(True).alias("_d"))
    verdict = F.when(F.col("_d").isNull(), "missing").when(F.col("_p").isNull(), "extra").when(~F.col("abstract").eqNullSafe(F.col("text")), "differs")
    return p.join(d, "paper_id", "full_outer").select("paper_id", verdict.alias("verdict")).filter("verdict is not null")


def assert_papers_match_documents(papers: DataFrame, documents: DataFrame) -> None:
    """Halts a run whose papers aren't its documents, naming the first few."""
    wrong = paper_document_mismatches(papers, documents).orderBy("paper_id").limit(5).collect()
    if wrong:
        raise ValueError("papers and documents differ: " + ", ".join(f"{r.paper_id} {r.verdict}" for r in wrong))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``position`` in a total order, from 1: sorted by ranges, then numbered by partition, so no task sees all rows."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    # one row a partition
    before = sizes.select("_part", "_from", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias("position"))


def viewer_tables(ranked: DataFrame, members: DataFrame, papers: DataFrame) -> DataFrame:
    """``query_id, rank, licensed, paper_id, position``: a group's papers as a viewer lists them, licensed and refused ones apart, the
    latest year first, then by journal and id."""
    x = ranked.join(members.select("key", "paper_id"), "key").join(papers.select("paper_id", "year", "journal", F.col("extraction_allowed").alias("licensed")), "paper_id")
    order = Window.partitionBy("query_id", "key", "licensed").orderBy(F.col("year").desc_nulls_last(), F.col("journal").asc_nulls_last(), "paper_id")
    return x.select("query_id", "rank", "licensed", "paper_id", F.row_number().over(order).alias("position"))
