"""Secret scans: candidate spans by native regular expressions, verdicts by corpus-wide ownership of their hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import STEP, bound, walk
from .common import cut

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: High-recall candidates of the method: long runs of key characters with letters and digits.
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "generic")


@dataclass(frozen=True)
class Ownership:
    """A value seen with at most ``max_owners`` owners and ``max_repos`` repositories looks live; a wider one is an example."""

    max_owners: int = 1
    max_repos: int = 3


#: Shares that the rows of one hash are dealt into where they meet its verdict.
SALT = 16


def _hits(text: Column, pattern: str, kind: int, group: int, keep) -> Column:
    """Array of (start, kind, end, value) of a pattern, leftmost non-overlapping, in code points.

    The text is split by the pattern; a match starts where the parts and matches before it end.
    ``keep`` filters on the value.
    """
    parts = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = lambda xs: F.transform(xs, F.length)
    zipped = F.arrays_zip(lengths(parts).alias("gap"), lengths(whole).alias("match"), value.alias("value"))
    some = F.filter(zipped, lambda z: z.match.isNotNull())
    span = lambda at, z: F.struct((at + z.gap).alias("start"), F.lit(kind).alias("kind"), (at + z.gap + z.match).alias("end"), z.value.alias("value"))
    walked = bound(some, lambda xs: walk(xs, F.lit(0), lambda at, z: at + z.gap + z.match, span))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.filter(walked, lambda z: keep(z.value))).otherwise(empty)


def candidates(text: Column) -> tuple[Column, Column]:
    """Arrays of base spans and of generic ones; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    yes = lambda v: F.lit(True)
    base = F.concat(_hits(t, ASSIGN, 0, 2, lambda v: F.length(v) >= 6), _hits(t, ACCESS, 1, 0, yes), _hits(t, HEX, 2, 0, yes))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (v.rlike("[0-9][A-Za-z]+[0-9]|[a-z][A-Z]+[a-z]"))
    return F.array_sort(base), _hits(t, GENERIC, 3, 0, mixed)


def loose(base: Column, generic: Column) -> Column:
    """Generic spans that cross no base span.

    Along all spans in order, a generic one is crossed from before where a base span ended after its start; going back,
    it is crossed from behind where a base span starts before its end.
    """
    far = F.lit(2**31 - 1)
    keep = lambda at, x: F.struct(x.alias("x"), at.alias("at"))
    ahead = F.filter(bound(F.array_sort(F.concat(base, generic)), lambda xs: walk(xs, F.lit(0), lambda at, x: F.when(x.kind < 3, F.greatest(at, x.end)).otherwise(at), keep)), lambda r: (r.x.kind < 3) | (r["at"] <= r.x.start))
    back = bound(F.reverse(F.transform(ahead, lambda r: r.x)), lambda xs: walk(xs, far, lambda at, x: F.when(x.kind < 3, x.start).otherwise(at), keep))
    free = F.filter(back, lambda r: (r.x.kind == 3) & (r["at"] >= r.x.end))
    crossing = F.reverse(F.transform(free, lambda r: r.x))
    return F.when(F.size(generic) == 0, generic).when(F.size(base) == 0, generic).otherwise(crossing)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")


def ownership(spans: DataFrame, rule: Ownership = Ownership()) -> DataFrame:
    """``hash, n_repos, n_owners, live`` from rows of ``hash, repo, owner``.

    Counts are of distinct pairs first, so a value copied a million times shuffles once for each task and pair.
    """
    pairs = spans.select("hash", "repo", "owner").distinct()
    return (
        pairs.groupBy("hash")
        .agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
        .withColumn("live", (F.col("n_owners") <= rule.max_owners) & (F.col("n_repos") <= rule.max_repos))
    )


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", rule: Ownership = Ownership()) -> DataFrame:
    """One row per document row: base spans, added spans, and what corpus-wide ownership says of them.

    Columns: ``doc_id``, ``base`` and ``added`` (arrays of start, kind, end, value), ``n_live`` and ``n_example``.
    A generic candidate is added where it looks live and crosses no base span. Null and empty texts have no spans;
    null repositories and owners count as none, so such a value is live. Repeated rows are each scanned.
    """
    base, generic = candidates(F.col(text))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(repo).alias("repo"), F.col(owner).alias("owner"), base.alias("base"), generic.alias("generic"))
    # a generic candidate that crosses a base span is that span's own text
    rows = cut(found.withColumn("generic", loose(F.col("base"), F.col("generic"))).withColumn("row", F.monotonically_increasing_id()))
    some = rows.filter((F.size("base") > 0) | (F.size("generic") > 0))
    judged = live_spans(some, rule).groupBy("row").agg(F.count("*").alias("n_live"), F.collect_list(F.when(F.col("span.kind") == 3, F.col("span"))).alias("added"))
    all_spans = (F.size("base") + F.size("generic")).cast("long")
    zero, nothing = F.lit(0).cast("long"), F.slice("generic", 1, 0)
    none = rows.filter((F.size("base") == 0) & (F.size("generic") == 0)).select("doc_id", "base", F.col("generic").alias("added"), zero.alias("n_live"), zero.alias("n_example"))
    n_live = F.coalesce("n_live", zero)
    return some.join(judged, "row", "left").select("doc_id", "base", F.coalesce("added", nothing).alias("added"), n_live.alias("n_live"), (all_spans - n_live).alias("n_example")).unionByName(none)


def live_spans(rows: DataFrame, rule: Ownership) -> DataFrame:
    """``row, span`` of the candidates whose value looks live, from ``row, repo, owner, base, generic``.

    Only live values enter the join, and few rows hold such a value; the rows of a wide one, which meet nothing, are dealt
    into ``SALT`` shares.
    """
    hashed = rows.select("row", "repo", "owner", F.explode(F.concat("base", "generic")).alias("span")).withColumn("hash", F.xxhash64("span.value"))
    live = ownership(hashed, rule).filter("live").select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return hashed.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(live, ["hash", "salt"], "left_semi").select("row", "span")


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan_secrets`."""
    n = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return scanned.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        "n_live",
        "n_example",
    )


def redact(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", rule: Ownership = Ownership(), mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets replaced: base spans always, generic ones where they look live. Columns stay as they are.

    Only rows with a candidate are written and joined; all others pass as they are. Null texts stay null.
    """
    likely = F.coalesce(F.col(text).rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{GENERIC}"), F.lit(False))
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    some = cut(_with_spans(docs.filter(likely), names, text, repo, owner))
    some = some.withColumn("generic", loose(F.col("base"), F.col("generic")))
    live = live_spans(some, rule).filter("span.kind = 3").groupBy("row").agg(F.collect_list("span").alias("live"))
    t = F.col(names[text])
    # overlapping spans are masked once: what follows starts at the furthest end so far
    walked = walk(F.col("cuts"), F.lit(0), lambda at, x: F.greatest(at, x.end), lambda at, x: F.struct(at.alias("begin"), x.start.alias("end")))
    kept = F.filter(walked, lambda g: g.begin <= g.end)
    furthest = F.array_max(F.transform("cuts", lambda x: x.end))
    done = F.concat(bound(kept, lambda gaps: _pasted(t, gaps, mask)), F.substring(t, furthest + 1, F.length(t)))
    cuts = F.array_sort(F.concat("base", F.coalesce("live", F.slice("generic", 1, 0))))
    fixed = some.join(live, "row", "left").withColumn("cuts", cuts).withColumn(names[text], F.when(F.size("cuts") == 0, t).otherwise(done))
    return docs.filter(~likely).unionByName(fixed.select(*[F.col(v).alias(k) for k, v in names.items()]))


def _pasted(text: Column, gaps: Column, mask: str) -> Column:
    """The pieces of a text named by ``gaps``, a mask behind each. A piece is found from its text's beginning on, so ``STEP``
    pieces at a time are first cut out together."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / STEP).cast("int")), lambda i: F.slice(gaps, i * STEP + 1, STEP))

    def paste(p: Column) -> Column:
        first = F.element_at(p, 1).begin
        block = F.substring(text, first + 1, F.element_at(p, -1).end - first)
        return bound(block, lambda b: F.array_join(F.transform(p, lambda g: F.concat(F.substring(b, g.begin - first + 1, g.end - g.begin), F.lit(mask))), ""))

    return F.array_join(F.transform(parts, paste), "")


def _with_spans(docs: DataFrame, names: dict[str, str], text: str, repo: str, owner: str) -> DataFrame:
    base, generic = candidates(F.col(text))
    return docs.select(
        *[F.col(k).alias(v) for k, v in names.items()],
        F.col(repo).alias("repo"),
        F.col(owner).alias("owner"),
        base.alias("base"),
        generic.alias("generic"),
        F.monotonically_increasing_id().alias("row"),
    )
