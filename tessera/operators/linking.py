"""Dictionary, entity linking, fragments and the licence gate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.tables import written
from ..functions.text import found_in, normalize_surface

#: Connectors that may join fragments of one mention.
_CONNECTOR = re.compile("[-‐‑‒–/]*")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """One concept per key of ``alias_key, concept_id, name, is_preferred, ord``: preferred entries first, then the least id.

    ``tiebroken`` says that a key had several concepts. Blank keys go.
    """
    least = lambda c: F.min(F.when(c, F.struct("concept_id", "ord", "name")))
    agg = aliases.filter(F.trim("alias_key") != "").groupBy("alias_key").agg(F.count_distinct("concept_id").alias("n"), least(F.col("is_preferred")).alias("p"), least(F.lit(True)).alias("a"))
    best = F.coalesce("p", "a")
    return agg.select("alias_key", best.concept_id.alias("concept_id"), best["name"].alias("name"), (F.col("n") > 1).alias("tiebroken"))


def link(mentions: DataFrame, resolved: DataFrame, key: str = "alias_key") -> DataFrame:
    """Mentions with ``canonical_id, canonical_name, tiebroken``; unlinked ones stay, with nulls."""
    r = resolved.select(F.col("alias_key").alias("_k"), F.col("concept_id").alias("canonical_id"), F.col("name").alias("canonical_name"), "tiebroken")
    return mentions.join(r, mentions[key] == r["_k"], "left").drop("_k").withColumn("tiebroken", F.coalesce("tiebroken", F.lit(False)))


def fragment_runs(mentions: Iterable[tuple], abstract: str) -> Iterator[tuple]:
    """``run, label, start, end, text, parts, orders`` of the runs of two parts or more among a text's mentions ``ord, text, label, start, end``."""
    run, parts, before = 0, [], None
    for m in sorted(mentions, key=lambda m: (m[3] or 0, m[0])):
        _, _, label, start, _ = m
        gap = None if before is None or start is None or before[4] is None else "" if start <= before[4] else abstract[before[4] : start]
        if gap is not None and label is not None and label == before[2] and _CONNECTOR.fullmatch(gap):
            parts.append(m)
        else:
            if len(parts) > 1:
                yield _merged(run, parts, abstract)
            run, parts = run + 1, [m]
        before = m
    if len(parts) > 1:
        yield _merged(run, parts, abstract)


def _merged(run: int, parts: list[tuple], abstract: str) -> tuple:
    start, end = min((p[3] for p in parts if p[3] is not None), default=None), parts[-1][4]
    whole = None if start is None or end is None else abstract[start : max(start, end)]
    return run, parts[0][2], start, end, whole, [p[1] for p in parts], [p[0] for p in parts]


_RUN = "run long, label string, start int, end int, text string, parts array<string>, orders array<{ord}>"


def _with_fragment(runs: DataFrame) -> DataFrame:
    looks = F.exists("parts", lambda t: ~t.rlike(r"^\p{L}{3,}$") | (F.upper(t) == t))
    return runs.filter(looks).select("paper_id", "run", "label", "start", "end", "text", F.size("parts").cast("long").alias("n_parts"), "orders")


def merge_found(texts: DataFrame, find: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """:func:`merge_fragments` of the mentions ``ord, text, label, start, end`` that ``find`` gives for a text: one pass over the texts, and only merged runs leave it."""
    return _with_fragment(found_in(texts, "paper_id", "abstract", _RUN.format(ord="int"), lambda t: fragment_runs(find(t), t)))


def merge_fragments(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates ``paper_id, run, label, start, end, text, n_parts, orders`` made of neighbouring mentions of one label.

    Runs end at a gap that holds anything but connectors, at another label and at a missing offset; a run counts from
    two parts on, one of which must look like a fragment (not a plain word of three letters or more). ``orders`` are the parts' numbers.
    A text meets its mentions once, as one array.
    """
    own = mentions.groupBy("paper_id").agg(F.collect_list(F.struct("ord", "text", "label", "start", "end")).alias("_m")).join(texts.select("paper_id", "abstract"), "paper_id").select("paper_id", "abstract", "_m")
    schema = T.StructType([own.schema["paper_id"], *T._parse_datatype_string(_RUN.format(ord=mentions.schema["ord"].dataType.simpleString()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                paper, abstract, found = (batch.column(c)[i].as_py() for c in range(3))
                got = list(fragment_runs([tuple(m.values()) for m in found], abstract)) if abstract is not None else []
                columns = zip(*((paper, *g) for g in got), strict=True) if got else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _with_fragment(own.mapInArrow(run, schema))


#: Slots of a sieve for each key, so that of other keys one in so many passes, and bits of one of its rows.
SLOTS, WORD_BITS = 16, 64


def marked(rows: DataFrame, columns: list[str], keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag ``name``: false only where ``columns`` aren't among ``keys``. Keys travel to all tasks as one bit each of ``SLOTS``, and rows stay where they are."""
    slots = WORD_BITS * (1 + SLOTS * keys.count() // WORD_BITS)
    slot = F.pmod(F.xxhash64(*columns), F.lit(slots))
    word, bit = F.floor(slot / WORD_BITS).cast("long").alias("_word"), F.pmod(slot, F.lit(WORD_BITS)).cast("int").alias("_bit")
    held = keys.select(word, bit).distinct().groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_held"))
    met = rows.withColumns({"_slot": word, "_bit": bit}).join(F.broadcast(held.withColumnRenamed("_word", "_slot")), "_slot", "left")
    return met.withColumn(name, F.coalesce(F.expr("shiftright(_held, _bit) & 1") == 1, F.lit(False))).drop("_slot", "_bit", "_held")


def canonicalize(mentions: DataFrame, texts: DataFrame, resolved: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Mentions ``paper_id, ord, label, text, start, end`` linked by their own normalised surface, and where that fails by the merged
    fragment that they are part of. A merged fragment never takes the place of a mention's own link; unlinked mentions stay, with nulls.

    ``runs`` are their merged fragments, where these are found already. Mentions that no key of the dictionary and no linked fragment can stand for, which may be most,
    meet neither: they are told by a sieve and dealt nowhere. So mentions are made twice, and none is written.
    """
    runs = merge_fragments(mentions, texts) if runs is None else runs
    resolved = written(resolved)
    merged = link(runs.select("paper_id", "orders", normalize_surface(F.col("text")).alias("alias_key")), resolved).filter("canonical_id is not null")
    part = written(merged.select("paper_id", F.explode("orders").alias("ord"), F.struct(F.col("canonical_id").alias("id"), F.col("canonical_name").alias("name")).alias("_merged")))
    keyed = mentions.withColumn("alias_key", normalize_surface(F.col("text")))
    told = marked(marked(keyed, ["alias_key"], resolved.select("alias_key"), "_named"), ["paper_id", "ord"], part.select("paper_id", "ord"), "_part")
    own = link(told.filter("_named or _part"), resolved)
    x = own.join(part, ["paper_id", "ord"], "left")
    filled = F.when(F.col("canonical_id").isNull(), F.col("_merged")).otherwise(F.struct(F.col("canonical_id").alias("id"), F.col("canonical_name").alias("name")))
    x = x.withColumn("_best", filled).withColumn("canonical_id", F.col("_best.id")).withColumn("canonical_name", F.col("_best.name"))
    none = {"canonical_id": F.lit(None).cast("string"), "canonical_name": F.lit(None).cast("string"), "tiebroken": F.lit(False)}
    cols = [*mentions.columns, *none]
    return x.select(*cols).unionByName(told.filter("not (_named or _part)").withColumns(none).select(*cols))


def licence_gate(papers: DataFrame) -> DataFrame:
    """The one place where papers without a permitting licence stop."""
    return papers.filter("extraction_allowed")


def in_sentences(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions with the ``sentence_index`` in which they start; a mention in a gap or without offsets has none and goes.

    Sentences and mentions of a paper are put in one order by offset, and the last sentence that has begun is carried along: each row is seen
    once. Texts of sentences don't travel. Sentences of one paper must not overlap.
    """
    s = sentences.select("paper_id", F.col("start").alias("_at"), F.struct("sentence_index", F.col("end").alias("to")).alias("_s"), F.lit(None).cast(mentions.schema).alias("_m"))
    m = mentions.filter("start is not null").select("paper_id", F.col("start").alias("_at"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.struct(*mentions.columns).alias("_m"))
    order = Window.partitionBy("paper_id").orderBy("_at", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = s.unionByName(m).withColumn("_s", F.last("_s", ignorenulls=True).over(order))
    return both.filter(F.col("_m").isNotNull() & (F.col("_at") < F.col("_s.to"))).select("_m.*", F.col("_s.sentence_index").alias("sentence_index"))


def findings(located: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences that hold a linked chemical and a linked disease."""
    both = located.filter("canonical_id is not null").groupBy("paper_id", "sentence_index").agg(F.bool_or(F.col("label") == "CHEMICAL").alias("c"), F.bool_or(F.col("label") == "DISEASE").alias("d")).filter("c and d")
    return sentences.join(both, ["paper_id", "sentence_index"], "left_semi")


def drop_contained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that no other span of the group strictly contains; spans without offsets stay.

    In order of start and falling end, a span is contained exactly where an earlier one ends at or after its end:
    a running maximum, no self-join. Equal spans don't contain each other.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), F.col("end").desc_nulls_last())
    distinct = spans.filter("start is not null and end is not null").select(*keys, "start", "end").distinct()
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = distinct.withColumn("reach", reach).filter("reach is null or reach < end").drop("reach")
    return spans.join(kept, [*keys, "start", "end"], "left_semi").unionByName(spans.filter("start is null or end is null"))
