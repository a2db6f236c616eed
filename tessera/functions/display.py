"""How a viewer spells counts, licences, deeds, authors, dates and question concepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

#: What is shown where there is no licence, and where no authors are listed.
NO_LICENCE, NO_AUTHORS = "no licence", "No authors listed in PubMed"


def count_of(count: Column, unit: Column) -> Column:
    """``3 papers``, ``1 paper``, ``1 study``: the plural unit loses its end where there is one."""
    one = F.when(unit.endswith("ies"), F.concat(F.substring(unit, F.lit(1), F.length(unit) - 3), F.lit("y"))).otherwise(F.regexp_replace(unit, "s$", ""))
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, one).otherwise(unit))


def licence_name(token: Column) -> Column:
    """``cc_by_nc`` as ``CC BY-NC``; other tokens stay, none is no licence."""
    known = token.startswith("cc_")
    return F.when(F.coalesce(token, F.lit("")) == "", NO_LICENCE).when(known, F.concat(F.lit("CC "), F.upper(F.replace(F.substring(token, F.lit(4), F.length(token)), F.lit("_"), F.lit("-"))))).otherwise(token)


def deed_name(url: Column) -> Column:
    """What the path of a deed's address says: ``CC BY-NC 4.0``, ``CC0 1.0``, a port after the version; null for a null address."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")

    def spelt(p: Column) -> Column:
        kind, code, version, port = (F.get(p, F.lit(i)) for i in range(4))
        name = F.when((kind == "publicdomain") & (code == "zero"), "CC0").otherwise(F.concat(F.lit("CC "), F.upper(code)))
        return F.concat_ws(" ", name, version, F.upper(port))

    return F.when(url.isNotNull(), bound(parts, spelt))


def creators(authors: Column) -> Column:
    """All names in order, the last after ``and``; never cut short."""
    n = F.size(authors)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, NO_AUTHORS).when(n == 1, F.get(authors, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(authors, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(authors, -1)))


def long_date(at: Column) -> Column:
    """``7 March 2024``, of the day in UTC."""
    return F.date_format(at.cast("date"), "d MMMM yyyy")


def question_concepts(note: Column) -> Column:
    """The concepts that a selection's note names in parentheses after ``with the question``, trimmed; none without such a note or with empty parentheses."""
    held = F.regexp_extract(F.coalesce(note, F.lit("")), r"with the question \(([^)]*)\)", 1)
    return F.when(held == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(held, ","), lambda t: F.trim(t)))
