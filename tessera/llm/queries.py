"""Registered queries of the training-data operators, over whole tables and whole texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, features, licenses, merkle, mixing, passages, pii, quality, secrets, simhash, tokens, toxicity, wumanber
from .common import cut, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(mixing.sizes(table(spark, sf_dir, "documents")))
    return mixing.draws(sized, cut(mixing.cuts(sized, mixing.targets(sized))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.judge(docs, model)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), pii.fit())


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = chat.read_back(chat.format_chats(rows.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.write_ids(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))
    return tokens.document_digests(spark, folder)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.lost_breaks())


def op13_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.point_in_time(*(table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")))


def queries() -> dict:
    own = (op1_toxicity, op2_mixing, op3_secrets, op4_quality, op5_pii, op6_passages, op7_chat, op8_decontamination, op9_licenses, op10_simhash, op11_token_ids, op12_merkle, op13_features)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The CRC of a decimal number's text, byte by byte over the usual table of the polynomial, for a lateral use: ``crc_of(x)``.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tab"


def _crc(x: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle_sql() -> str:
    field = lambda x: f"coalesce(octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar, '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    up = "list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))"
    return rf"""
with recursive crc as ({_CRC_TABLE}),
leaves as (
  select doc_id, source, {leaf("text")} as leaf,
    case when {_crc("doc_id")} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as folded
  from documents, crc),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves),
sub as (
  select source, 0 as level, list(leaf order by pos) as nodes from placed group by source
  union all select source, level + 1, {up} from sub where len(nodes) > 1),
subroots as (
  select source, level as height, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as pos from sub where len(nodes) = 1),
tops as (
  select 0 as level, list(subroot order by pos) as nodes from subroots
  union all select level + 1, {up} from tops where len(nodes) > 1),
steps as (
  select s.source, s.level, s.nodes, 0 as base from sub s where len(s.nodes) > 1
  union all select r.source, r.height + t.level, t.nodes, r.height from tops t, subroots r where len(t.nodes) > 1),
ways as (
  select p.doc_id, p.source, p.pos, s.level, s.nodes,
    case when s.level < r.height then p.pos // power(3, s.level)::bigint else r.pos // power(3, s.level - r.height)::bigint end as own
  from placed p join subroots r on p.source is not distinct from r.source join steps s on p.source is not distinct from s.source),
sides as (
  select source, pos, level, array_to_string(nodes[own // 3 * 3 + 1 : own], '') as l, array_to_string(nodes[own + 2 : own // 3 * 3 + 3], '') as r from ways),
proofs as (
  select source, pos, sha256(string_agg(l || r, '' order by level)) as proof, list(struct_pack(l := l, r := r) order by level) as way from sides group by source, pos),
folds as (
  select p.source, p.pos, 0 as step, p.folded as node, w.way from placed p left join proofs w on p.source is not distinct from w.source and p.pos = w.pos
  union all select source, pos, step + 1, sha256(way[step + 1].l || node || way[step + 1].r), way from folds where step < len(way)),
ends as (select source, pos, arg_max(node, step) as folded_root from folds group by source, pos)
select p.doc_id, p.leaf, r.subroot, (select nodes[1] from tops where len(nodes) = 1) as root, coalesce(w.proof, sha256('')) as proof_sha256, e.folded_root,
  e.folded_root = (select nodes[1] from tops where len(nodes) = 1) as verified
from placed p join subroots r on p.source is not distinct from r.source left join proofs w on p.source is not distinct from w.source and p.pos = w.pos
join ends e on p.source is not distinct from e.source and p.pos = e.pos"""


_CENTS = "coalesce(floor(100 * {} + 0.5)::bigint, 0)"
_FEATURES = rf"""
with crc as ({_CRC_TABLE}),
probes as (
  select row_number() over () as rid, sale_id, client_id, epoch_us(sold_at) + {_crc("sale_id")} % 259200 * 1000000 as t
  from sales, crc where client_id is not null and sold_at is not null),
windows as (select *, unnest([2, 14]) as d from probes),
seen as (select client_id, click_id, kind, value, epoch_us(ts) as ts, epoch_us(arrived_at) + 14400000000 as known from (select distinct * from clicks)),
sold as (select sale_id, client_id, total, epoch_us(sold_at) as ts, epoch_us(arrived_at) + 14400000000 as known from sales),
c as (
  select rid, d, count(*) as n_clicks, count(*) filter (where kind = 'purchase') as n_purchases, sum({_CENTS.format("value")})::bigint as click_cents,
    list(click_id order by ts desc, click_id desc nulls last)[1] as last_click_id
  from windows w join seen x on w.client_id = x.client_id and x.ts > t - d * 86400000000 and x.ts <= t and x.known <= t group by rid, d),
s as (
  select rid, d, t, x.sale_id, x.total from windows w join sold x on w.client_id = x.client_id and x.ts > t - d * 86400000000 and x.ts <= t and x.known <= t),
sums as (select rid, d, count(*) as n_sales, sum({_CENTS.format("total")})::bigint as sale_cents from s group by rid, d),
l as (
  select rid, d, count(*) as n_lines, count(distinct item_id) as n_items, sum({_CENTS.format("amount")})::bigint as line_cents
  from s join sale_lines y on s.sale_id = y.sale_id and epoch_us(y.shipped_at) <= t group by rid, d),
labels as (select distinct rid from probes p join sold x on p.client_id = x.client_id and x.ts > t and x.ts <= t + 604800000000)
select sale_id, d::int as d, t as t_us, labels.rid is not null as label, coalesce(n_clicks, 0) as n_clicks, coalesce(n_purchases, 0) as n_purchases,
  coalesce(click_cents, 0) as click_cents, last_click_id, coalesce(n_sales, 0) as n_sales, coalesce(sale_cents, 0) as sale_cents, coalesce(n_lines, 0) as n_lines,
  coalesce(n_items, 0) as n_items, coalesce(line_cents, 0) as line_cents
from windows left join c using (rid, d) left join sums using (rid, d) left join l using (rid, d) left join labels using (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_features": _FEATURES,
        "op12_merkle": _merkle_sql(),
        "op2_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))) as draw from documents),
by_source as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight, 3 * source_size as cap from by_source),
level as (
  select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
    sum(cap) over w - cap as caps_before, sum(weight) over w as weight_to
  from ranked window w as (order by cap::double / weight::double, source nulls last rows between unbounded preceding and current row)),
marked as (
  select *, cap * (all_weight - weight_to + weight) < (total - caps_before) * weight as clamped from level),
rested as (
  select *, total - coalesce(sum(cap) filter (where clamped) over (), 0) as rest, sum(weight) filter (where not clamped) over () as rest_weight from marked),
target as (
  select source, source_size, case when clamped then cap::double else (rest * weight)::double / rest_weight::double end as target from rested),
rated as (
  select *, case when source_size > 0 then floor(target / source_size::double)::bigint else 0 end as whole from target),
missed as (select *, target - whole::double * source_size::double as missing from rated),
by_draw as (select source, draw, sum(size)::bigint as words, count(*) as n from sized group by source, draw),
running as (
  select *, sum(words) over (partition by source order by draw rows between unbounded preceding and current row) as upto from by_draw),
cut as (
  select missed.*, r.draw as cut, floor((missing - (upto - words)::double) / n::double)::bigint as cut_words
  from missed left join running r on missed.source is not distinct from r.source and missing >= (upto - words)::double and missing < upto::double),
split as (
  select doc_id, size, draw, source_size, target, whole + case when draw < cut then 1 else 0 end as whole, case when draw = cut then cut_words else 0 end as part
  from sized join cut on sized.source is not distinct from cut.source)
select doc_id, size, source_size, target, whole * size + part as taken, whole::bigint as whole, part::bigint as part,
  floor(('0x' || substr(draw, 1, 8))::bigint::double / 4294967296.0 * (size - part + 1)::double)::bigint as part_from from split""",
        "op7_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns as (
  select *, length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + length(regexp_replace(text, '[^\\<\[|]', '', 'g')) as marks from rows),
chats as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as all_turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length(role) + length(text) + marks + 10)::bigint as formatted_chars,
    list(role order by turn, role, text) as roles
  from turns group by conv_id)
select conv_id, n_turns, sha256(all_turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars,
  regexp_matches('>' || array_to_string(roles, '>') || '>', '^>(system>)?user>(assistant>(tool>assistant>)*user>)*(assistant>(tool>assistant>)*)?$') as valid
from chats""",
        "op8_decontamination": rf"""
with doc_words as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
item_words as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
patterns as (
  select distinct item_id, least(13, len(w)) as m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as p
  from item_words, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as s(i) where len(w) > 0),
lengths as (select distinct m from patterns),
places as (
  select rid, i, m, array_to_string(w[i : i + m - 1], ' ') as p
  from doc_words, lengths, unnest(generate_series(1, len(w) - m + 1)) as s(i) where len(w) >= m),
found as (select rid, i, m, item_id from places join patterns using (m, p)),
hit as (select rid, count(distinct k) as n_hit from found, unnest(generate_series(i, i + m - 1)) as s(k) group by rid),
items as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as names from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc_words left join hit using (rid) left join items using (rid)""",
    }
