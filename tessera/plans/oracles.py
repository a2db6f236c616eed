"""The same queries in SQL for another engine. Each is the substrate's tables as needed, then the query."""

from __future__ import annotations

from ..operators import corpora

_LICENCES = "['CC BY','cc-by-nc','CC0','https://creativecommons.org/licenses/by/4.0/','https://creativecommons.org/licenses/by-nc-nd/3.0/us/','cc_no','no-cc-code',null,'publisher user license','CC  BY-SA','http://www.creativecommons.org/publicdomain/zero/1.0/legalcode','cc_by_nd']"

_TOKEN = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(license)), '[\s-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_URL_TOKEN = r"""case when regexp_matches(license, '^https?://(www\.)?creativecommons\.org/licenses/[^/]+') then 'cc_' || replace(regexp_extract(license, '/licenses/([^/]+)', 1), '-', '_')
  when regexp_matches(license, '^https?://(www\.)?creativecommons\.org/publicdomain/zero') then 'cc0' end"""
_TIER = "case when {t} in ('cc0','cc_by','cc_by_sa') then 'open' when {t} in ('cc_by_nc','cc_by_nc_sa','cc_by_nd','cc_by_nc_nd') then 'non_commercial' when {t} in ('cc_no','no_cc_code') then 'restricted' else 'unknown' end"

_TABLES = {
    "papers0": f"select doc_id as paper_id, text as abstract, source as journal, case when doc_id % 17 <> 0 then 1990 + doc_id % 35 end as year, ({_LICENCES})[(doc_id % 12 + 1)::int] as license from documents",
    "papers1": f"select *, {_TOKEN} as name_token, {_URL_TOKEN} as url_token, coalesce({_URL_TOKEN}, {_TOKEN}) as token from papers0",
    "papers": f"select *, {_TIER.format(t='token')} as license_tier, ({_TIER.format(t='token')}) in ('open', 'non_commercial') as extraction_allowed from papers1",
    "sent0": r"select paper_id, string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as parts, regexp_extract_all(abstract, '[.!?](\s+)', 1) as gaps from papers",
    "sent1": "select paper_id, i - 1 as sentence_index, parts[i] as text, coalesce(gaps[i], '') as gap from sent0, unnest(generate_series(1, len(parts))) as s(i)",
    "sent": "select * from (select paper_id, sentence_index, text, (sum(length(text) + length(gap)) over (partition by paper_id order by sentence_index rows unbounded preceding) - length(text) - length(gap))::bigint as s from sent1) where length(text) > 0 or sentence_index = 0",
    "tok0": r"select paper_id, regexp_split_to_array(abstract, '\p{L}{7,}') as gaps, regexp_extract_all(abstract, '\p{L}{7,}') as ms from papers",
    "tok1": "select paper_id, i - 1 as pos, gaps[i] as gap, ms[i] as token from tok0, unnest(generate_series(1, len(ms))) as s(i)",
    "tok": "select paper_id, pos, token, replace(replace(lower(token), 'ß', 'ss'), 'ς', 'σ') as k, (sum(length(gap) + length(token)) over (partition by paper_id order by pos rows unbounded preceding))::bigint as e from tok1",
    "lex": "select distinct k from tok where substr(md5(k), 10, 1) < '8'",
    "alias": "select k as alias_key, 'MESH:' || upper(substr(md5(k), 1, 6)) as concept_id, true as is_preferred from lex where substr(md5(k), 11, 1) < 'c' union all select k, 'MESH:' || upper(substr(md5(k || '#'), 1, 6)), substr(md5(k), 3, 1) < '8' from lex where substr(md5(k), 11, 1) < 'c' and substr(md5(k), 2, 1) = '0'",
    "dict": "select alias_key, coalesce(min(concept_id) filter (where is_preferred), min(concept_id)) as concept_id, count(distinct concept_id) > 1 as tiebroken from alias group by alias_key",
    "ment": "select paper_id, pos, token as text, k, e - length(token) as s, e, case when substr(md5(k), 1, 1) < '8' then 'CHEMICAL' else 'DISEASE' end as label, concept_id as canonical_id, coalesce(tiebroken, false) as tiebroken from tok join lex using (k) left join dict on alias_key = k",
    "loc": "select m.*, sentence_index from ment m join sent on sent.paper_id = m.paper_id and m.s >= sent.s and m.s < sent.s + length(sent.text)",
    "crossp": "select distinct c.paper_id, c.canonical_id as chemical_id, d.canonical_id as disease_id from (select distinct paper_id, canonical_id from ment where label = 'CHEMICAL' and canonical_id is not null) c join (select distinct paper_id, canonical_id from ment where label = 'DISEASE' and canonical_id is not null) d using (paper_id)",
    "pairs": "select distinct c.paper_id, c.canonical_id as chemical_id, d.canonical_id as disease_id from loc c join loc d on c.paper_id = d.paper_id and c.sentence_index = d.sentence_index and c.label = 'CHEMICAL' and d.label = 'DISEASE' and c.canonical_id is not null and d.canonical_id is not null",
    "clusters": "select chemical_id || '|' || disease_id as key, chemical_id, disease_id, count(*) as n_papers, array_to_string(list(paper_id order by paper_id), ',') as paper_ids from pairs group by chemical_id, disease_id having count(*) >= 2",
    "members": "select key, paper_id, n_papers from pairs join clusters using (chemical_id, disease_id)",
    "gold": "select * from crossp where substr(md5(concat_ws('|', paper_id, chemical_id, disease_id)), 1, 1) < '8'",
    "found": "select paper_id, sentence_index from loc where canonical_id is not null group by all having bool_or(label = 'CHEMICAL') and bool_or(label = 'DISEASE')",
    "gspan": "select paper_id, label, greatest(s - case when d < '3' then 2 else 0 end, 0) as s, e + case when d = '4' then 30 else 0 end as e from (select *, substr(md5(concat_ws('|', paper_id, s)), 1, 1) as d from ment)",
    "pspan": "select paper_id, label, s, e from ment where substr(md5(concat_ws('|', paper_id, s)), 1, 1) <> 'f'",
    "concepts": "select distinct concept_id from alias",
    "dig": "select concept_id, list_transform(generate_series(1, 32), lambda i: (('0x' || substr(md5(concept_id), i::int, 1))::int)) as d from concepts",
    "tree": "select distinct concept_id, unnest([concat_ws('.', d[1] % 4, d[2] % 4, d[3] % 4), case when d[20] % 3 = 0 then concat_ws('.', d[4] % 4, d[5] % 4, d[6] % 4, d[7] % 4) end, case when d[21] % 3 = 0 then concat_ws('.', d[9] % 4, d[10] % 4, d[11] % 4, d[12] % 4) end]) as tree_number from dig",
    "path": "select concept_id, string_split(tree_number, '.') as p from tree where tree_number is not null",
    "actions": "select c.concept_id, n.class_id from concepts c join (select substr(concept_id, 6, 3) as stem, min(concept_id) as class_id from concepts group by 1) n on substr(c.concept_id, 6, 3) = n.stem where substr(c.concept_id, 11, 1) < '4' and c.concept_id <> n.class_id",
    "terms0": r"select item_id as query_id, i, w[i] as w from (select item_id, regexp_extract_all(text, '\p{L}{7,}') as w from benchmark), unnest(generate_series(1, len(w))) as s(i)",
    "terms": "select query_id, concept_id, arg_min(w, i) as term from terms0 join dict on alias_key = replace(replace(lower(w), 'ß', 'ss'), 'ς', 'σ') group by query_id, concept_id",
    "sides": "select distinct key, unnest([chemical_id, disease_id]) as side from clusters",
    "matched": "select query_id, key, side from sides join terms on side = concept_id union select query_id, key, side from sides join actions on side = actions.concept_id join terms on terms.concept_id = class_id",
    "cnt": "select query_id, key, count(*) as matched from matched group by all",
    "near": """select a.query_id, a.key, a.side, min(case when x.p[1] = y.p[1] then len(x.p) + len(y.p) - 2 * (1 + (x.p[2] = y.p[2])::int * (1 + (x.p[3] = y.p[3])::int * (1 + coalesce(x.p[4] = y.p[4], false)::int))) end) as d
      from (select query_id, key, side from cnt join sides using (key) except select * from matched) a join terms t using (query_id) join path x on x.concept_id = a.side join path y on y.concept_id = t.concept_id group by all""",
    "ranked": """select *, row_number() over (partition by query_id order by matched desc, proximity asc nulls last, key) as rank from (
      select query_id, key, matched, case when n.n is null then 0.0 when n.nulls > 0 then null else n.d end::double as proximity
      from cnt left join (select query_id, key, count(*) as n, count(*) filter (where d is null) as nulls, max(d) as d from near group by all) n using (query_id, key))""",
    "judged": "select doc_id, toxic::bigint as gold, case when substr(md5(doc_id::varchar), 1, 1) = '0' then 1 - toxic else toxic end::bigint as predicted, case when substr(md5(doc_id::varchar), 1, 1) < '3' then 0 else toxic end::bigint as other from labels",
    "dirs": "select paper_id, chemical_id, disease_id, chemical_id || '|' || disease_id as key, unnest(case when d < '7' then ['causes'] when d < 'd' then ['treats'] else ['causes', 'treats'] end) as direction from (select *, substr(md5(concat_ws('|', paper_id, chemical_id, disease_id, 'direction')), 1, 1) as d from gold)",
    "acc": "select paper_id, key, list_sort(list(distinct direction)) as directions from dirs group by paper_id, key",
    "cand": "select * from (select a.key, a.paper_id as paper_a, b.paper_id as paper_b, case when a.directions = b.directions then 'agreement' else 'contradiction' end as label from acc a join acc b on a.key = b.key and a.paper_id < b.paper_id where len(a.directions) = 1 and len(b.directions) = 1) qualify row_number() over (partition by key, label order by paper_a, paper_b) <= 4",
    "gsent": "select distinct g.paper_id, c.sentence_index, g.chemical_id, g.disease_id from gold g join loc c on c.paper_id = g.paper_id and c.canonical_id = g.chemical_id and c.label = 'CHEMICAL' join loc d on d.paper_id = g.paper_id and d.sentence_index = c.sentence_index and d.canonical_id = g.disease_id and d.label = 'DISEASE'",
    "flags": "select paper_id, sentence_index, n, (paper_id, sentence_index) in (select (paper_id, sentence_index) from gsent) as is_gold from (select paper_id, sentence_index, max(sentence_index) over (partition by paper_id) + 1 as n from sent)",
    "selected": "select selector, count(*) as n_selected, count(*) filter (where is_gold) as hits from (select *, unnest(list_concat([case when sentence_index < k then 'first_' || k end for k in [1, 2, 3, 4, 5, 6]], [case when sentence_index < ceil(f / 10.0::double * n) then 'fraction_' || f end for f in [1, 2, 3, 4, 5]])) as selector from flags) where selector is not null group by selector",
    "scored": "select selector, n_selected, hits, total, gold_total, n_selected / total as rate, case when gold_total = 0 then 0.0 else hits / gold_total end as recall from selected, (select count(*) as total, count(*) filter (where is_gold) as gold_total from flags)",
    "tiers": "select query_id, key, rank, case when d < '5' then 'answers' when d < 'a' then 'background' when d < 'e' then 'off_topic' end as tier from (select *, substr(md5(query_id || '|' || key), 1, 1) as d from ranked)",
    "screen": "select query_id, count(*) as n_clusters, substr(md5(query_id::varchar), 1, 1) < '8' as plain from ranked group by query_id having count(*) >= 8",
}
_NEEDS = {
    "papers1": ("papers0",), "papers": ("papers1",), "sent0": ("papers",), "sent1": ("sent0",), "sent": ("sent1",), "tok0": ("papers",), "tok1": ("tok0",), "tok": ("tok1",), "lex": ("tok",), "alias": ("lex",), "dict": ("alias",), "ment": ("tok", "lex", "dict"), "loc": ("ment", "sent"), "crossp": ("ment",), "pairs": ("loc",), "clusters": ("pairs",),
    "members": ("pairs", "clusters"), "gold": ("crossp",), "found": ("loc",), "gspan": ("ment",), "pspan": ("ment",), "concepts": ("alias",), "dig": ("concepts",), "tree": ("dig",), "path": ("tree",), "actions": ("concepts",), "terms": ("terms0", "dict"), "sides": ("clusters",), "matched": ("sides", "terms", "actions"), "cnt": ("matched",), "near": ("cnt", "sides", "terms", "path", "matched"), "ranked": ("cnt", "near"),
    "dirs": ("gold",), "acc": ("dirs",), "cand": ("acc",), "gsent": ("gold", "loc"), "flags": ("sent", "gsent"), "selected": ("flags",), "scored": ("selected",), "tiers": ("ranked",), "screen": ("ranked",),
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({_TABLES[n]})" for n in order) + "\n"


_PRF = "tp, fp, fn, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall"
_F1 = "select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from"


def oracle_sql() -> dict[str, str]:
    return {
        "flagship_question": _with("ranked", "clusters") + "select query_id, key, matched, proximity, rank, n_papers from ranked join clusters using (key)",
        "f2_sentences": _with("sent") + 'select paper_id, sentence_index, s as start, s + length(text) as "end", text from sent',
        "w1_token_offsets": _with("tok") + 'select paper_id, pos, e - length(token) as start, e as "end", token from tok',
        "a2_resolve_aliases": _with("dict") + "select * from dict",
        "j1_link_mentions": _with("ment") + 'select paper_id, s as start, e as "end", text, label, canonical_id, tiebroken from ment',
        "j2_mention_sentence": _with("loc") + "select paper_id, s as start, canonical_id, sentence_index from loc",
        "j3_cross_pairs": _with("crossp") + "select * from crossp",
        "j4_same_sentence_pairs": _with("pairs") + "select * from pairs",
        "a1_cluster_papers": _with("clusters") + "select key, n_papers, paper_ids from clusters",
        "a1_scale_lineitem": "select l_partkey as chemical_id, l_suppkey as disease_id, count(distinct l_orderkey) as n_papers, array_to_string(list_sort(list(distinct l_orderkey)), ',') as paper_ids from lineitem group by all having count(distinct l_orderkey) >= 2",
        "a3_pairing_diagnostics": _with("ment", "loc", "papers") + """select (select count(*) from ment where label = 'CHEMICAL' and canonical_id is null) as nil_chemical, (select count(*) from ment where label = 'DISEASE' and canonical_id is null) as nil_disease,
          (select count(*) from papers where paper_id not in (select paper_id from ment where label = 'CHEMICAL' and canonical_id is not null)) as papers_without_chemical,
          (select count(*) from papers where paper_id not in (select paper_id from ment where label = 'DISEASE' and canonical_id is not null)) as papers_without_disease,
          (select count(*) from ment where canonical_id is not null) - (select count(*) from loc where canonical_id is not null) as unplaceable""",
        "a9_paper_pairs": _with("members") + "select distinct a.paper_id as paper_id_a, b.paper_id as paper_id_b from members a join members b using (key) where a.paper_id < b.paper_id",
        "a10_workload": _with("clusters") + "select n_clusters, comparisons, largest, case when comparisons = 0 then 0.0 else top5 / comparisons end as top5_share from (select count(*) as n_clusters, coalesce(sum(p), 0)::bigint as comparisons, coalesce(max(n_papers), 0) as largest, coalesce(sum(p) filter (where r <= 5), 0)::bigint as top5 from (select n_papers, n_papers * (n_papers - 1) // 2 as p, row_number() over (order by n_papers desc, key) as r from clusters))",
        "a11_gold_clusters": _with("gold") + "select chemical_id, disease_id, count(*) as n_papers, array_to_string(list(paper_id order by paper_id), ',') as paper_ids from gold group by all having count(*) >= 2".replace("group by all", "group by chemical_id, disease_id"),
        "p1_licence_gate": _with("papers") + "select paper_id, license, license_tier from papers where extraction_allowed",
        "p2_licence_token": _with("papers1") + f"select paper_id, name_token as token, {_TIER.format(t='name_token')} as tier from papers1",
        "p3_licence_from_url": _with("papers1") + "select paper_id, url_token as token from papers1",
        "p4_licence_deed": _with("papers1") + r"select paper_id, case when regexp_matches(license, '^https?://(www\.)?creativecommons\.org/(licenses|publicdomain)/[^/]+/\d+(\.\d+)*(/|$)') then 'https://creativecommons.org/' || regexp_replace(regexp_replace(regexp_extract(license, 'creativecommons\.org/(.*)', 1), '/?(legalcode|deed[^/]*)?/?$', ''), '/$', '') || '/' end as deed from papers1",
        "p8_findings": _with("found", "sent") + "select paper_id, sentence_index, text from sent semi join found using (paper_id, sentence_index)",
        "p12_acronyms": r"select w, count(*) as n, count(distinct doc_id) as papers from (select doc_id, unnest(regexp_extract_all(text, '\p{L}+')) as w from documents) where regexp_full_match(w, '\p{Lu}{1,4}') group by w",
        "a4_ledger": _with("papers", "ment", "found", "pairs") + """select * from (select 'licence_gate' as stage, 'licence_refused:' || coalesce(token, 'none') as reason, count(*) as n from papers where not extraction_allowed group by all
          union all select 'ner_linking', 'entity_unlinked', count(*) from ment where canonical_id is null
          union all select 'extract', 'zero_findings', count(*) from papers where extraction_allowed and paper_id not in (select paper_id from found)
          union all select 'cluster', 'singleton_key', count(*) from (select 1 from pairs group by chemical_id, disease_id having count(*) = 1)) where n > 0""",
        "k2_report": _with("papers") + """select rpad('licence_gate', 14, ' ') || n_in || ' papers in -> ' || n_out || ' papers out' || chr(10) || '  dropped ' || (n_in - n_out - none) || ': licence_refused' || chr(10) || '  dropped ' || none || ': no_licence' || chr(10) || '  noted ' || n_in || ': checked' as report, 0::bigint as unbalanced
          from (select count(*) as n_in, count(*) filter (where extraction_allowed) as n_out, count(*) filter (where license is null) as none from papers)""",
        "f39_question_terms": _with("terms") + "select * from terms",
        "f4_tree_distance": _with("clusters", "path") + """select a, b, min(case when x.p[1] = y.p[1] then len(x.p) + len(y.p) - 2 * (1 + (x.p[2] = y.p[2])::int * (1 + (x.p[3] = y.p[3])::int * (1 + coalesce(x.p[4] = y.p[4], false)::int))) end)::bigint as distance
          from (select distinct chemical_id as a, disease_id as b from clusters) left join path x on x.concept_id = a left join path y on y.concept_id = b group by all""".replace("group by all", "group by a, b"),
        "o1_rank_clusters": _with("ranked") + "select query_id, key, matched, proximity, rank from ranked",
        "w10_ties": _with("ranked") + "select query_id, key, rank, (lag(matched) over w is not distinct from matched and lag(proximity) over w is not distinct from proximity and rank > 1) as tied from ranked window w as (partition by query_id order by rank)",
        "f19_render": _with("ranked", "members", "papers", "found", "sent") + """, quotes as (select paper_id, string_agg('  "' || text || '"', chr(10) order by sentence_index) as quotes from sent semi join found using (paper_id, sentence_index) where paper_id in (select paper_id from papers where extraction_allowed) group by paper_id),
          lines as (select query_id, key, rank, paper_id, year, '- ' || concat_ws(' · ', year, journal, 'PMID ' || paper_id) || chr(10) || case when quotes is null then '  (no finding sentence extracted)' when row_number() over (partition by query_id, paper_id order by rank) > 1 then '  (quoted above)' else quotes end as line
            from ranked join members using (key) join papers using (paper_id) left join quotes using (paper_id))
          select query_id, key, rank, '## ' || replace(key, '|', ' — ') || chr(10) || count(*) || ' papers, ' || case when min(year) is null then 'year unknown' when min(year) = max(year) then min(year)::varchar else min(year) || '–' || max(year) end || '.' || chr(10) || chr(10) || string_agg(line, chr(10) order by coalesce(year, 9999), paper_id) as text from lines group by query_id, key, rank""",
        "a5_multiset_scores": _with("gspan", "pspan") + f", c as (select label, sum(least(g, p))::bigint as tp, sum(greatest(p - g, 0))::bigint as fp, sum(greatest(g - p, 0))::bigint as fn from (select paper_id, label, s, e, sum(g) as g, sum(p) as p from (select *, 1 as g, 0 as p from gspan union all select *, 0, 1 from pspan) group by paper_id, label, s, e) group by label) {_F1} (select label, {_PRF} from c)",
        "a6_set_scores": _with("gold", "pairs") + f", c as (select count(*) filter (where g and p) as tp, count(*) filter (where p and not g) as fp, count(*) filter (where g and not p) as fn from (select paper_id, chemical_id, disease_id, bool_or(g) as g, bool_or(p) as p from (select *, true as g, false as p from gold union all select *, false, true from pairs) group by all)) {_F1} (select {_PRF} from c)".replace("group by all", "group by paper_id, chemical_id, disease_id"),
        "a12_outcome_census": _with("gspan", "pspan") + """, each as (select g.label, case when bool_or(p.s = g.s and p.e = g.e) then 'EXACT' when count(p.s) >= 2 then 'MERGEABLE' when count(p.s) = 1 then 'TRUNCATED' else 'MISSED' end as outcome
            from (select distinct * from gspan) g left join pspan p on p.paper_id = g.paper_id and p.label = g.label and greatest(p.s, g.s) < least(p.e, g.e) group by g.paper_id, g.label, g.s, g.e)
          select label, outcome, count(*) as n from each group by grouping sets ((outcome), (label, outcome))""",
        "j12_drop_contained": _with("gspan", "pspan") + ', sp as (select * from gspan union select * from pspan) select paper_id, label, s as start, e as "end" from sp where not exists (select 1 from sp o where o.paper_id = sp.paper_id and o.label = sp.label and o.s <= sp.s and sp.e <= o.e and (o.s < sp.s or sp.e < o.e))',
        "a7_linking_scores": _with("ment") + "select n, correct, nil, tiebroken, case when n = nil then 0.0 else correct / (n - nil) end as precision, case when n = 0 then 0.0 else correct / n end as recall, case when n = 0 then 0.0 else nil / n end as nil_rate from (select count(*) as n, count(*) filter (where canonical_id = 'MESH:' || upper(substr(md5(k), 1, 6))) as correct, count(*) filter (where canonical_id is null) as nil, count(*) filter (where tiebroken) as tiebroken from ment where substr(md5(k), 4, 1) < 'c')",
        "a8_macro_f1": _with("judged") + f", c as (select label, count(*) filter (where gold = label and predicted = label) as tp, count(*) filter (where gold <> label and predicted = label) as fp, count(*) filter (where gold = label and predicted <> label) as fn, count(*) filter (where gold <> label and predicted <> label) as tn from judged, (values (0::bigint), (1::bigint)) as l(label) group by label) {_F1} (select label, tn, {_PRF}, case when tn + fp = 0 then 0.0 else tn / (tn + fp) end as specificity from c)",
        "f24_wilson": _with("papers") + "select journal, n, k, round(case when k = 0 then 0.0 else (p + zz / (2 * n) - h) / (1 + zz / n) end, 9) as low, round(case when k = n then 1.0 else (p + zz / (2 * n) + h) / (1 + zz / n) end, 9) as high from (select *, 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) as h from (select journal, count(*) as n, count(*) filter (where extraction_allowed) as k, count(*) filter (where extraction_allowed) / count(*) as p, 1.959963984540054::double * 1.959963984540054::double as zz from papers group by journal))",
        "j8_relation_reachability": _with("gold", "ment") + "select count(*) as relations, count(*) filter (where (paper_id, chemical_id) in (select (paper_id, canonical_id) from ment where label = 'CHEMICAL' and canonical_id is not null) and (paper_id, disease_id) in (select (paper_id, canonical_id) from ment where label = 'DISEASE' and canonical_id is not null)) as reachable from gold",
        "j10_relation_misses": _with("gold", "pairs", "loc") + ", k as (select paper_id, canonical_id, count(distinct sentence_index) as k from loc where canonical_id is not null group by all) select case when c.k is null or d.k is null then 'unplaced' when c.k = 1 and d.k = 1 then 'apart_once' else 'apart_often' end as bucket, count(*) as n from (select * from gold except select * from pairs) l left join k c on c.paper_id = l.paper_id and c.canonical_id = l.chemical_id left join k d on d.paper_id = l.paper_id and d.canonical_id = l.disease_id group by 1".replace("group by all", "group by paper_id, canonical_id"),
        "a17_drop_report": _with("papers") + "select license_tier, count(*) as n, count(*) filter (where extraction_allowed) as kept, median(length(abstract))::double as median_len, min(length(abstract))::bigint as min_len, max(length(abstract))::bigint as max_len, min(year)::bigint as min_year, max(year)::bigint as max_year from papers group by license_tier",
        "a22_cumulative_cost": "select user_id, event_id, spent, spent > 12500 as aborted from (select user_id, event_id, (sum(round(coalesce(value, 0.0) * 100)::bigint) over (partition by user_id order by event_id rows unbounded preceding))::bigint as spent from events)",
        "s5_structured_sections": "select conv_id, string_agg(upper(coalesce(role, '')) || ': ' || trim(text), chr(10) order by turn, role, text) as abstract from conversations where trim(text) <> '' group by conv_id",
        "w5_last_write": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
        "w6_first_wins": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1",
        "w8_first_n_per_class": _with("papers") + "select paper_id, license_tier from papers qualify row_number() over (partition by license_tier order by paper_id) <= 20",
        "w9_positional_selectors": _with("sent") + "select paper_id, count(*) filter (where sentence_index < least(4, n)) as first_4, count(*) filter (where sentence_index >= greatest(0, n - 3)) as last_3, count(*) filter (where sentence_index < ceil(0.3::double * n)) as first_30 from (select *, max(sentence_index) over (partition by paper_id) + 1 as n from sent) group by paper_id",
        "r3_stratified_sample": _with("clusters") + ", b as (select key, n_papers, case when n_papers <= 3 then 'small' when n_papers <= 7 then 'medium' else 'large' end as band from clusters) select band, key, n_papers from b qualify row_number() over (partition by band order by md5('seed|' || key), key) <= 10",
        "r4_select_at_rate": _with("sent") + "select paper_id, sentence_index from sent where ('0x' || substr(md5(concat_ws('|', 'seed', paper_id, sentence_index)), 1, 13))::bigint / 4503599627370496.0::double < 0.25",
        "k5_content_hash": "select substr(sha256(concat_ws('|', count(*), " + ", ".join(f"sum(('0x' || substr(d, {at}, 12))::bigint)::hugeint::varchar" for at in (1, 13, 25, 37)) + ")), 1, 16) as content_hash from (select sha256(concat_ws('|', doc_id, quality, toxic)) as d from labels)",
        "f31_size_bands": _with("clusters") + "select case when n_papers <= 3 then 'small' when n_papers <= 7 then 'medium' else 'large' end as band, count(*) as n from clusters group by 1",
        "p17_direction": "select doc_id as paper_id, case when c > t then 'causes' when t > c then 'treats' else 'neither' end as direction from (select doc_id, " + " + ".join(f"contains(lower(text), '{w}')::int" for w in corpora.CAUSES) + " as c, " + " + ".join(f"contains(lower(text), '{w}')::int" for w in corpora.TREATS) + " as t from documents)",
        "f37_links": """select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages) group by all""".replace("group by all", "group by page_id, href"),
    }
