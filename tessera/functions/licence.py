"""Licence tokens, tiers and deed addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers of licence tokens; any other token is unknown. The first two tiers allow extraction.
TIERS = {
    "open": ("cc0", "cc_by", "cc_by_sa"),
    "non_commercial": ("cc_by_nc", "cc_by_nc_sa", "cc_by_nd", "cc_by_nc_nd"),
    "restricted": ("cc_no", "no_cc_code"),
}
ALLOWED = ("open", "non_commercial")
HOST = "creativecommons.org"


def token(raw: Column) -> Column:
    """Lower case, blanks and hyphens as single underscores, none at the ends."""
    t = F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]+", "_")
    return F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")


def tier(tok: Column) -> Column:
    """The tier of a token; null and all other tokens are unknown."""
    out = F.lit("unknown")
    for name, tokens in TIERS.items():
        out = F.when(tok.isin(*tokens), name).otherwise(out)
    return out


def allowed(tier_name: Column) -> Column:
    return tier_name.isin(*ALLOWED)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")), "/"), lambda s: s != "")


def _on_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"^https?://([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "") == HOST


def token_from_url(url: Column) -> Column:
    """``cc_by_nc`` from a licence address by its path segments, ``cc0`` from the public-domain one; else null."""
    s = _segments(F.lower(F.trim(url)))
    kind, name = F.get(s, 0), F.get(s, 1)
    cc = F.concat(F.lit("cc_"), F.replace(name, F.lit("-"), F.lit("_")))
    return F.when(_on_host(url), F.when((kind == "licenses") & name.isNotNull(), cc).when((kind == "publicdomain") & (name == "zero"), "cc0"))


def deed_url(url: Column) -> Column:
    """The deed's address without ``legalcode`` or ``deed`` suffix, jurisdiction kept; null without a version."""
    s = _segments(F.lower(F.trim(url)))
    kept = F.filter(s, lambda x: (x != "legalcode") & ~x.rlike(r"^deed(\..*)?$"))
    good = _on_host(url) & F.get(s, 0).isin("licenses", "publicdomain") & F.coalesce(F.get(s, 2).rlike(r"^\d+(\.\d+)*$"), F.lit(False))
    return F.when(good, F.concat(F.lit(f"https://{HOST}/"), F.array_join(kept, "/"), F.lit("/")))


def any_token(raw: Column) -> Column:
    """From an address if it is one, else from the name."""
    return F.coalesce(token_from_url(raw), token(raw))
