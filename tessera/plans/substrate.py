"""The inputs of the analytics, derived by rule from the given tables: papers, mentions, dictionary, hierarchy, gold.

Which words are mentions, and which of those the dictionary knows, follows from a digest of the word alone. So the rules are the
same at every size, and a word of any number of documents is in or out with all of them.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, licence, text
from ..operators import cells, linking, pairing
from ..functions.tables import dealt, written

WORD = r"\p{L}{7,}"
#: Licence strings by document id modulo their number.
LICENCES = ("CC BY", "cc-by-nc", "CC0", "https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by-nc-nd/3.0/us/", "cc_no", "no-cc-code", None, "publisher user license", "CC  BY-SA", "http://www.creativecommons.org/publicdomain/zero/1.0/legalcode", "cc_by_nd")


def _hex(c, at: int):
    return F.substring(F.md5(c), at, 1)


def is_mention(key):
    """Half of all words."""
    return _hex(key, 10) < "8"


def is_known(key):
    """Three quarters of the mentions' words."""
    return _hex(key, 11) < "c"


def gold_ways(papers: np.ndarray, chemicals: np.ndarray, diseases: np.ndarray) -> np.ndarray:
    """Of pairs of concepts of papers, by numbers, which are gold and in which directions: :meth:`Substrate.is_gold` and :func:`ways`, for many rows at once."""
    out = np.full(len(papers), cells.NONE, np.uint8)
    ids, of = np.unique(papers, return_inverse=True)
    names = ids.astype("S")
    size = np.char.str_len(names)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size[of] == n)
        paper = names.astype(f"S{n}").view(np.uint8).reshape(-1, n)
        for at in range(0, len(rows), 1 << 18):
            mine = rows[at : at + (1 << 18)]
            concept = [[np.tile(np.frombuffer(b"|MESH:", np.uint8), (len(mine), 1)), digests.hex_of(x[mine])] for x in (chemicals, diseases)]
            texts = np.concatenate([paper[of[mine]], *concept[0], *concept[1]], axis=1)
            gold = digests.first_digits(texts) < 8
            told = np.concatenate([texts[gold], np.tile(np.frombuffer(b"|direction", np.uint8), (int(gold.sum()), 1))], axis=1)
            digit = digests.first_digits(told)
            out[mine[gold]] = np.where(digit < 7, cells.CAUSES, np.where(digit < 13, cells.TREATS, cells.BOTH))
    return out


def ways(key=("paper_id", "chemical_id", "disease_id")):
    """The directions of a gold relation, one or both, by a digest digit."""
    d = F.substring(F.md5(F.concat_ws("|", *key, F.lit("direction"))), 1, 1)
    return F.when(d < "7", F.array(F.lit("causes"))).when(d < "d", F.array(F.lit("treats"))).otherwise(F.array(F.lit("causes"), F.lit("treats")))


class Substrate:
    """DataFrames of one data folder; nothing is read until a query asks for it. What later steps read more than once
    (mentions, linked mentions, clusters) is written when it is first asked for, so that a query reads the texts once for all of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        raw = F.element_at(F.array(*[F.lit(x) for x in LICENCES]), (F.col("doc_id") % len(LICENCES) + 1).cast("int"))
        p = self.table("documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("abstract"), F.col("source").alias("journal"), F.when(F.col("doc_id") % 17 != 0, (1990 + F.col("doc_id") % 35).cast("int")).alias("year"), raw.alias("license"))
        tier = licence.tier(licence.any_token(F.col("license")))
        return p.withColumn("license_tier", tier).withColumn("extraction_allowed", licence.allowed(tier))

    @cached_property
    def texts(self) -> DataFrame:
        return dealt(self.papers.select("paper_id", "abstract"))

    @cached_property
    def sentences(self) -> DataFrame:
        return text.sentences(self.texts)

    @cached_property
    def tokens(self) -> DataFrame:
        return text.pieces(self.texts, "paper_id", "abstract", WORD).withColumn("alias_key", text.normalize_surface(F.col("match")))

    @cached_property
    def found(self) -> DataFrame:
        """Mentions of all papers with the sentence in which they start, from one pass over the texts; what else is derived begins here."""
        each = text.sentence_pieces(self.texts, "paper_id", "abstract", WORD).withColumn("alias_key", text.normalize_surface(F.col("match"))).filter(is_mention("alias_key"))
        label = F.when(_hex("alias_key", 1) < "8", "CHEMICAL").otherwise("DISEASE")
        return written(each.select("paper_id", "sentence_index", F.col("match").alias("text"), "alias_key", label.alias("label"), "start", "end"))

    @cached_property
    def aliases(self) -> DataFrame:
        known = self.found.filter(is_known("alias_key")).select("alias_key").distinct()
        concept = lambda c: F.concat(F.lit("MESH:"), F.upper(F.substring(F.md5(c), 1, 6)))
        entry = lambda name, preferred, at: F.struct(concept(name).alias("concept_id"), name.alias("name"), preferred.alias("is_preferred"), F.lit(at).alias("ord"))
        own = entry(F.col("alias_key"), F.lit(True), 0)
        other = entry(F.concat("alias_key", F.lit("#")), _hex("alias_key", 3) < "8", 1)
        return known.select("alias_key", F.inline(F.when(_hex("alias_key", 2) == "0", F.array(own, other)).otherwise(F.array(own))))

    @cached_property
    def resolved(self) -> DataFrame:
        return linking.resolve_aliases(self.aliases)

    @cached_property
    def placed(self) -> DataFrame:
        """Mentions of all papers with the sentence in which they start, linked or not."""
        return written(linking.link(self.found, self.resolved))

    @cached_property
    def mentions(self) -> DataFrame:
        return self.placed.drop("sentence_index")

    @cached_property
    def located(self) -> DataFrame:
        return self.placed

    @cached_property
    def pairs(self) -> DataFrame:
        return pairing.same_sentence_pairs(self.located)

    @cached_property
    def clusters(self) -> DataFrame:
        return written(pairing.cluster_papers(self.pairs).withColumn("key", F.concat_ws("|", "chemical_id", "disease_id")))

    @cached_property
    def concepts(self) -> DataFrame:
        return self.aliases.select("concept_id").distinct()

    @cached_property
    def tree(self) -> DataFrame:
        """One to three dotted paths of a concept; nodes are digest digits modulo 4, so ancestors are shared."""
        m = F.md5("concept_id")
        digit = lambda i: F.conv(F.substring(m, i, 1), 16, 10).cast("int")
        path = lambda at, depth: F.array_join(F.array(*[(digit(at + k) % 4).cast("string") for k in range(depth)]), ".")
        numbers = F.array(path(1, 3), *[F.when(digit(20 + i) % 3 == 0, path(4 + 5 * i, 4)) for i in range(2)])
        return self.concepts.select("concept_id", F.explode(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull()))).alias("tree_number"))

    @cached_property
    def actions(self) -> DataFrame:
        """A concept whose sixth digit is below 4 is a member of the class named by its first three digits, where that is a concept's start."""
        named = self.concepts.select(F.col("concept_id").alias("class_id"), F.substring("concept_id", 6, 3).alias("stem")).groupBy("stem").agg(F.min("class_id").alias("class_id"))
        members = self.concepts.filter(F.substring("concept_id", 11, 1) < "4").select("concept_id", F.substring("concept_id", 6, 3).alias("stem"))
        return members.join(named, "stem").filter("concept_id <> class_id").select("concept_id", "class_id")

    @cached_property
    def questions(self) -> DataFrame:
        """Each benchmark item is a question."""
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @staticmethod
    def concept_number(concept):
        """The number that a concept's name spells, of 24 bits, and back."""
        return F.conv(F.substring(concept, 6, 6), 16, 10).cast("int")

    @staticmethod
    def concept_name(number):
        return F.concat(F.lit("MESH:"), F.lpad(F.hex(number), 6, "0"))

    @staticmethod
    def is_gold(disease="disease_id"):
        """Of co-occurring concept pairs of a paper, those whose digest starts below 8."""
        return _hex(F.concat_ws("|", "paper_id", "chemical_id", disease), 1) < "8"

    def gold_among(self, pairs: DataFrame) -> DataFrame:
        return pairs.filter(self.is_gold())

    @cached_property
    def concept_sets(self) -> DataFrame:
        """The concepts of a paper as numbers: what its pairs, and gold, are made of. Mentions are linked for this as narrow rows and aren't written again."""
        linked = linking.link(self.found.select("paper_id", "label", "alias_key"), self.resolved)
        return written(cells.paper_concepts(linked, self.concept_number))

    @cached_property
    def placed_pairs(self) -> DataFrame:
        """All pairs of a paper's concepts with the sentences of their sides."""
        return pairing.placed_pairs(self.located)

    @cached_property
    def gold_relations(self) -> DataFrame:
        """Gold among all pairs of a paper's concepts. They are many times the mentions, so they aren't written: each use makes them again from the mentions, paper by paper."""
        return self.gold_among(pairing.cross_pairs(self.mentions))

    @cached_property
    def gold_spans(self) -> DataFrame:
        """Mentions with some truncated, some shifted; predictions leave some out."""
        d = F.substring(F.md5(F.concat_ws("|", "paper_id", "start")), 1, 1)
        return self.mentions.select("paper_id", "label", F.when(d < "3", F.col("start") - 2).otherwise(F.col("start")).alias("start"), F.when(d == "4", F.col("end") + 30).otherwise(F.col("end")).alias("end"), "canonical_id").withColumn("start", F.greatest("start", F.lit(0)))

    @cached_property
    def predicted_spans(self) -> DataFrame:
        return self.mentions.filter(F.substring(F.md5(F.concat_ws("|", "paper_id", "start")), 1, 1) != "f").select("paper_id", "label", "start", "end", "canonical_id")
