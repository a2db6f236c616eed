"""Measures of a written summary against its sources, as column arithmetic over word arrays."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import bound

#: Names of Greek letters.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}
#: Stems of words that judge, and words that only look like them.
JUDGEMENT_STEMS = ("agree", "disagree", "conflict", "consisten", "inconsisten", "discrepant", "mixed", "opposing", "concordan", "discordan", "corroborat", "refut", "consensus", "divergen", "contradict", "concur")
JUDGEMENT_EXCLUSIONS = ("concurrent", "concurrently")


_NAMES, _DASH = str.maketrans(GREEK), re.compile("[\u2010-\u2015\u2212]")


def folded(text: str | None) -> str | None:
    """Greek letters by name, compatibility decomposition without combining marks, any dash as a hyphen."""
    if text is None or text.isascii():
        return text
    plain = unicodedata.normalize("NFKD", text.translate(_NAMES))
    return _DASH.sub("-", "".join(c for c in plain if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """``folded`` of a column. Spark has no Unicode normalisation, so texts go through Arrow."""
    return texts.map(folded, na_action="ignore")


def alias_words(folded: Column) -> Column:
    """Words of a folded text: lower case, letters, digits and inner hyphens."""
    return F.regexp_extract_all(F.lower(folded), F.lit("[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"), F.lit(0))


def ngrams(words: Column, longest: int = 6) -> Column:
    """All runs of 1 to ``longest`` words, space-joined; of few words all there are."""
    none = F.array().cast("array<int>")

    def runs(w: Column) -> Column:
        def of(k: int) -> Column:
            starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(none)
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))

        return F.flatten(F.array(*map(of, range(1, longest + 1))))

    return bound(words, runs)


def supported(found: Column, allowed: Column, n_papers: Column) -> tuple[Column, Column]:
    """(supported, unsupported): numerals of an output that its source, or the number of papers, accounts for, and those left over."""
    bad = F.filter(found, lambda x: ~F.array_contains(allowed, x) & (x != n_papers.cast("string")))
    return F.size(found) - F.size(bad), bad


def judgement_words(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: w != "")


def is_judgement(w: Column) -> Column:
    hit = F.lit(False)
    for stem in JUDGEMENT_STEMS:
        hit = hit | w.startswith(stem)
    return hit & ~w.isin(*JUDGEMENT_EXCLUSIONS)


def judgement_language(s: Column) -> Column:
    """Distinct judging words of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(judgement_words(s), is_judgement)))


def _bigrams(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit(""))))


def judgement_volunteered(output: Column, source: Column) -> Column:
    """Judging words of an output of which some use stands beside no neighbour that it also has in the source."""

    def free(w: Column, given: Column) -> Column:
        at = F.transform(w, lambda x, i: F.struct(x.alias("w"), F.when(i > 0, F.concat_ws(" ", F.get(w, i - 1), x)).alias("before"), F.when(i < F.size(w) - 1, F.concat_ws(" ", x, F.get(w, i + 1))).alias("after")))
        quoted = lambda c: F.coalesce(F.array_contains(given, c), F.lit(False))
        left = F.filter(at, lambda s: is_judgement(s.w) & ~(quoted(s.before) | quoted(s.after)))
        return F.array_sort(F.array_distinct(F.transform(left, lambda s: s.w)))

    return bound(judgement_words(output), lambda w: bound(bound(judgement_words(source), _bigrams), lambda given: free(w, given)))


def compression(output: Column, findings: Column) -> Column:
    """Length over that of the source's findings; 0.0 without any."""
    n = F.coalesce(F.length(findings), F.lit(0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(output).cast("double") / n)


def context_window(text: Column, start: Column, end: Column, reach: int = 170) -> Column:
    """The text around a span, to ``reach`` characters either side and then outward to a space."""
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), start - reach))
    back = F.locate(" ", F.reverse(head))
    left = F.when(back > 0, F.length(head) - back + 1).otherwise(0)
    ahead = F.position(F.lit(" "), text, F.least(F.length(text), end + reach) + 1)
    right = F.when(ahead > 0, ahead - 1).otherwise(F.length(text))
    return F.substring(text, left + 1, right - left)


def shown_aliases(aliases: Column, longest_acronym: int = 5, n: int = 8) -> Column:
    """Spelled-out names first, then short ones, order kept, the first ``n``."""
    return F.slice(F.concat(F.filter(aliases, lambda a: F.length(a) > longest_acronym), F.filter(aliases, lambda a: F.length(a) <= longest_acronym)), 1, n)


def recall_at_rate(p: Column, n_gold: Column) -> tuple[Column, Column]:
    """Mean and deviation of the recall of independent draws at rate ``p``."""
    return p, F.sqrt(p * (1 - p) / n_gold)


def recall_when_padded(captured: Column, n_base: Column, budget: Column, n_gold: Column, n_corpus: Column) -> tuple[Column, Column]:
    """Mean and deviation of recall when a selection is filled up to ``budget`` by draws without replacement."""
    pool, drawn = n_corpus - n_base, budget - n_base
    share = (n_gold - captured) / pool
    hits = drawn * share
    return (captured + hits) / n_gold, F.sqrt(hits * (1 - share) * (pool - drawn) / (pool - 1)) / n_gold
