"""SQL for the queries that SQL can express, over the whole tables."""
from __future__ import annotations

from .secrets import BASE_RULES, RULES

_REACH = """reach as (select node, node as top from nodes union select l.b, r.top from reach r join links l on l.a = r.node),
parts as (select node, min(top) as component_id from reach group by node)"""


def secret_scan() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = []
    for place, r in enumerate(RULES, 1):
        value = f"length(regexp_replace(m, {quoted(r.head)}, ''))" if r.head else "length(m)"
        found.append(f"""select doc_id, '{r.kind}' as kind, {place} as place, begins, begins + length(m) as ends from (
  select doc_id, ms[i] as m, cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as begins
  from (select *, unnest(range(1, len(ms) + 1)) as i from (
    select doc_id, regexp_extract_all(t, {quoted(r.pattern)}) as ms, regexp_split_to_array(t, {quoted(r.pattern)}) as gs from texts where regexp_matches(t, {quoted(r.pattern)}))))
  where {value} >= {r.least}""")
    base = len(BASE_RULES)
    line = "kind || ':' || begins || ':' || ends"
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)
    return f"""with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(found)}),
told as (select doc_id, {counts}, coalesce(string_agg({line}, ',' order by begins, place) filter (place <= {base}), '') as base,
  string_agg({line}, ',' order by begins, place) as spans from found group by doc_id)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans from texts left join told using (doc_id)"""


def jaccard_join(k: int = 4, percent: int = 85) -> str:
    return f"""with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < {k} then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) end) as ss from words),
nodes as (select doc_id as node, len(ss) as n from sets),
items as (select doc_id, unnest(ss) as s from sets),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from items x join items y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
close as (select a, b from pairs join nodes p on p.node = a join nodes q on q.node = b where 100 * c >= {percent} * (p.n + q.n - c)),
links as (select a, b from close union all select b, a from close),
{_REACH}
select node as doc_id, n as n_shingles, component_id from nodes join parts using (node)"""


def vector_near_duplicates(least: float = 0.9) -> str:
    return f"""with recursive nodes as (select vec_id as node, embedding::double[] as e, embedding is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)) as ok
  from embeddings),
links as (select x.node as a, y.node as b from nodes x join nodes y on x.node <> y.node and len(x.e) = len(y.e)
  where x.ok and y.ok and list_cosine_similarity(x.e, y.e) >= {least}),
{_REACH},
counts as (select a as node, count(*) as n from links group by a)
select node as vec_id, coalesce(n, 0) as n_links, component_id, node = component_id as kept
from nodes join parts using (node) left join counts using (node)"""


def merkle_manifest() -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    up = "list_transform(range(0, (len(hs) + 2) // 3), lambda i: sha256(array_to_string(hs[3 * i + 1:3 * i + 3], '')))"
    flank = """array_to_string(hs[3 * (p // 3) + 1:p], '') as before, array_to_string(hs[p + 2:3 * (p // 3) + 3], '') as after"""
    return f"""with recursive bits as (select b, b as c, 0 as k from range(256) t(b) union all
  select b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 from bits where k < 8),
tab as (select b, c from bits where k = 8),
ids as (select distinct doc_id from documents where doc_id is not null),
run as (select doc_id, doc_id::varchar as rest, 4294967295 as c from ids union all
  select doc_id, rest[2:], xor(run.c >> 8, tab.c) from run join tab on tab.b = xor(run.c & 255, ascii(rest)) where rest <> ''),
odd as (select doc_id, xor(c, 4294967295) % 2 = 0 as altered from run where rest = ''),
leaves as (select doc_id, source, {leaf('text')} as leaf, {leaf("replace(text, chr(10), '')")} as bare from documents),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, row_number() over () as rid from leaves),
lv as (select source, 0 as l, list(leaf order by pos) as hs from placed group by source union all
  select source, l + 1, {up} from lv where len(hs) > 1),
subs as (select source, l as height, hs[1] as subroot, row_number() over (order by source nulls first) - 1 as pos from lv where len(hs) = 1),
tops as (select 0 as l, list(subroot order by pos) as hs from subs union all select l + 1, {up} from tops where len(hs) > 1),
crown as (select hs[1] as root from tops where len(hs) = 1),
steps as (select rid, l as s, {flank} from (select rid, l, hs, pos // (3 ** l)::bigint as p from placed join lv
    on lv.source is not distinct from placed.source and len(hs) > 1)
  union all select rid, s, {flank} from (select rid, height + l as s, hs, subs.pos // (3 ** l)::bigint as p from placed join subs
    on subs.source is not distinct from placed.source join tops on len(hs) > 1)),
fold as (select rid, 0 as s, case when coalesce(altered, false) then bare else leaf end as h from placed left join odd using (doc_id)
  union all select rid, fold.s + 1, sha256(before || h || after) from fold join steps using (rid, s)),
ends as (select rid, arg_max(h, s) as folded_root from fold group by rid),
proofs as (select rid, sha256(string_agg(before || after, '' order by s)) as proof_sha256 from steps group by rid)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from placed join subs on subs.source is not distinct from placed.source join ends using (rid) left join proofs using (rid), crown"""


def ranked_search(keep: int = 10) -> str:
    terms = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
    return f"""with items as (select item_id, row_number() over () as item, list_distinct({terms}) as ts from benchmark),
asked as (select item, unnest(ts) as t from items),
docs as (select doc_id, row_number() over () as d, {terms} as ts from documents),
sizes as (select d, doc_id, len(ts) as n from docs where len(ts) > 0),
total as (select count(*) as big_n, sum(n)::bigint as big_l from sizes),
tfs as (select d, t, count(*) as tf from (select d, unnest(ts) as t from docs) where t in (select t from asked) group by 1, 2),
weights as (select t, floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1)))::bigint as w from tfs, total group by t),
measured as (select d, doc_id, 10 + (90 * n * big_n) // big_l as m from sizes, total),
scores as (select item, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join tfs using (t) join weights using (t) join measured using (d) group by 1, 2),
ranked as (select item, doc_id, score, row_number() over (partition by item order by score desc, doc_id) as rank
  from scores join measured using (d) where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked join items using (item) where rank <= {keep}"""


ORACLES = {
    "op2_vector_near_duplicates": vector_near_duplicates(),
    "op3_secret_scan": secret_scan(),
    "op10_jaccard_join": jaccard_join(),
    "op11_merkle_manifest": merkle_manifest(),
    "op12_ranked_search": ranked_search(),
}
