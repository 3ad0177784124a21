"""SQL of the registered queries of this subpackage, where SQL can express them.

Written from what the queries return, not from how they work: windows are strings that are
grouped, pairs are counted by what they share, components are what a recursive query
reaches, and the trie is a table of lists. Nothing here is taken from the operators.
"""

from __future__ import annotations

SPACES = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{SPACES}')"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string of ASCII, bit by bit."""
    step = "x"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)[1]"
    folded = step.replace("[x]", "[xor(acc, c)]", 1)
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: cast(ascii(s) as bigint)), "
            f"lambda acc, c: {folded}, cast(4294967295 as bigint)), 4294967295)")


def _reached(nodes: str, links: str) -> str:
    """reached (id, component): the smallest node that links lead to, itself included."""
    return f"""both_ways as materialized (select a, b from {links} union select b, a from {links}),
steps as (select id, id as other from {nodes} union select s.id, b.b from steps s join both_ways b on b.a = s.other),
reached as (select id, min(other) as component from steps group by id)"""


JACCARD = f"""with recursive w as (select doc_id, {_words(LOWER)} as ws from documents),
sets as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) end as s from w),
told as materialized (select doc_id, md5(unnest(s)) as x, len(s) as n from sets),
common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c
  from told a join told b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select a, b from common where 100 * c >= 90 * (an + bn - c)),
ids as (select doc_id as id from documents), {_reached('ids', 'links')}
select doc_id, cast(len(s) as bigint) as n_shingles, component as component_id from sets join reached on id = doc_id"""

# Bytes as pairs of hexadecimal digits.
BYTES = """with h as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as materialized (select doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) as k
  from (select doc_id, h, unnest(range(0, cast(length(h) // 2 - 49 as bigint))) as i from h where length(h) >= 100)),
firsts as (select k, min(doc_id) as first from windows group by k having count(*) > 1),
later as (select doc_id, i from windows join firsts using (k) where doc_id > first),
starts as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as new from later),
numbered as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as run from starts),
runs as materialized (select doc_id, run, min(i) as a, max(i) + 50 as b from numbered group by 1, 2),
pieces as (select doc_id, run, substr(h, 2 * coalesce(lag(b) over (partition by doc_id order by run), 0) + 1,
    2 * (a - coalesce(lag(b) over (partition by doc_id order by run), 0))) as p from runs join h using (doc_id)),
heads as (select doc_id, string_agg(p, '' order by run) as p from pieces group by 1),
totals as (select doc_id, sum(b - a) as removed, count(*) as spans, max(b) as last from runs group by 1)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
  cast(coalesce(spans, 0) as bigint) as n_spans,
  sha256(unhex(concat(coalesce(p, ''), substr(h, 2 * coalesce(last, 0) + 1)))) as kept_sha256
from h left join heads using (doc_id) left join totals using (doc_id)"""

WINDOWS = f"""with w as materialized (select doc_id, {_words("coalesce(text, '')")} as ws from documents),
windows as materialized (select doc_id, i, md5_number(array_to_string(list_slice(ws, i, i + 12), ' ')) as k
  from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
firsts as (select k, min(doc_id) as first from windows group by k having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (k) where doc_id > first),
placed as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from placed anti join gone using (doc_id, p) group by 1),
removed as (select doc_id, count(*) as n from gone group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id) left join removed using (doc_id)"""

_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
# Kind, pattern, least length of what counts; the first kind counts its value alone.
SECRETS = [
    ("assign", f"""(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", "AKIA[A-Z0-9]+", 16),
    ("hex", "[0-9a-f]{32,}", 32),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----", 1),
    ("hub_token", "\\bgh[pousr]_[A-Za-z0-9]{36,}\\b", 40),
    ("web_token", "\\beyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 1),
]


def _secrets() -> str:
    found = " union all ".join(
        f"select doc_id, {k} as rank, '{kind}' as kind, regexp_extract_all(t, '{p}') as whole, "
        f"regexp_extract_all(t, '{p}', {1 if kind == 'assign' else 0}) as counted, string_split_regex(t, '{p}') as gaps, {least} as least from d"
        for k, (kind, p, least) in enumerate(SECRETS))
    return f"""with d as materialized (select doc_id, coalesce(text, '') as t from documents),
found as (select * from ({found}) where len(whole) > 0),
each as (select *, unnest(range(1, len(whole) + 1)) as k from found),
spans as materialized (select doc_id, rank, kind, least, length(counted[k]) as n, length(whole[k]) as size,
  coalesce(list_sum(list_transform(list_slice(gaps, 1, k), lambda g: length(g))), 0)
  + coalesce(list_sum(list_transform(list_slice(whole, 1, k - 1), lambda m: length(m))), 0) as start from each),
good as (select doc_id, rank, kind, cast(start as bigint) as start, cast(start + size as bigint) as stop from spans where n >= least),
told as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) filter (rank < 3) as base,
  string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as spans from good group by 1)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access,
  cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (doc_id)"""


RULES = f"""with w as materialized (select doc_id, coalesce(text, '') as t, {_words("coalesce(text, '')")} as ws from documents),
windows as (select doc_id, i, list_slice(ws, i, i + 4) as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from windows) where n > 1),
repeated as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from again) group by 1),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from w),
dups as (select doc_id, count(*) - count(distinct line) as dup, count(*) as n from lines where regexp_matches(line, '{SPACES}') group by 1),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dup, 0) as bigint) as n_dup_lines,
  cast(coalesce(r.n, 0) as bigint) as n_repeat_words, coalesce(l.n, 0) as n_lines
  from w left join repeated r using (doc_id) left join dups l using (doc_id)),
f as (select *, case when n_words < 10 then 1 else 0 end | case when n_repeat_words * 100 > n_words * 20 then 2 else 0 end
  | case when n_symbols * 100 > n_words * 30 then 4 else 0 end | case when n_dup_lines * 2 > n_lines then 8 else 0 end
  | case when word_chars < n_words * 2 or word_chars > n_words * 20 then 16 else 0 end
  | case when word_chars > n_words * 1000 then 32 else 0 end as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 as base_failed, bits & 31 = 0 as kept,
  cast(bits as bigint) as failed from f"""

VECTORS = f"""with recursive v as materialized (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
ids as (select vec_id as id from embeddings), {_reached('ids', 'links')},
counted as (select a as id, count(*) as n from both_ways group by 1)
select r.id as vec_id, cast(coalesce(n, 0) as bigint) as n_links, component as component_id, r.id = component as kept
from reached r left join counted using (id)"""

# Sources fill up in the order of size per weight until one does not stop at twice its size.
MIXING = f"""with d as materialized (select doc_id, source, cast(len({_words("coalesce(text, '')")}) as bigint) as size,
  md5(concat('+', doc_id, ':', case when text is null then '-' else concat('+', text, ':') end)) as key from documents),
src as (select source, cast(sum(size) as bigint) as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by 1),
filled as (select *, cast(source_size as double) / w as per_weight, (sum(source_size) over () * 150 / cast(100 as double)
    - 2 * coalesce(sum(source_size) over (order by cast(source_size as double) / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(w) over () - coalesce(sum(w) over (order by cast(source_size as double) / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as rate from src),
targets as (select source, source_size, least(coalesce((select first(rate order by per_weight, source nulls last) from filled where rate * w <= 2 * source_size) * w,
    cast('inf' as double)), cast(2 * source_size as double)) as target from filled),
sized as materialized (select d.*, length(bin(size)) as weight from d),
classes as (select source, weight, sum(size) as class_size from sized group by 1, 2),
rated as (select c.source, weight, class_size, source_size, target,
    (target - 2 * coalesce(sum(class_size) over (partition by c.source order by weight desc rows between unbounded preceding and 1 preceding), 0))
    / nullif(sum(weight * class_size) over (partition by c.source order by weight desc rows between current row and unbounded following), 0) as f
  from classes c join targets t on c.source is not distinct from t.source),
chosen as (select *, first_value(f) over (partition by source order by case when f * weight <= 2 then 0 else 1 end, weight desc) as factor,
    max(case when f * weight <= 2 then 1 else 0 end) over (partition by source) as fits from rated),
expected as (select *, least(case when fits = 1 then factor * weight else cast(2 as double) end, cast(2 as double)) as e from chosen),
factors as (select source, weight, source_size, target, floor(e) as certain, e - floor(e) as fraction,
    greatest(target - sum(floor(e) * class_size) over (partition by source), cast(0 as double)) as rest from expected),
drawn as (select s.doc_id, s.source, s.size, s.key, f.source_size, f.target, f.certain, f.rest, f.fraction,
    (cast(('0x' || substr(md5(s.key), 1, 12)) as bigint) + cast(0.5 as double)) / cast(281474976710656 as double) as u
  from sized s join factors f on s.source is not distinct from f.source and s.weight = f.weight),
odds as (select *, case when fraction > 0 then (u / (cast(1 as double) - u)) / (fraction / (cast(1 as double) - fraction)) end as o from drawn),
placed as materialized (select *, o / (o + 1) as place, case when o is not null then
    sum(case when o is not null then size else 0 end) over (partition by source order by o / (o + 1) nulls last, key) <= rest else false end as extra from odds),
waiting as (select *, row_number() over (partition by source, length(bin(size)) order by place, key) as k from placed
  where place is not null and not extra and size > 0),
gaps as (select source, first(rest) - sum(case when extra then size else 0 end) as gap from placed where place is not null group by 1),
asked as (select w.source, list({{'key': key, 'size': size}} order by place, key) as l from waiting w where k <= 4 group by 1),
greedy as (select a.source, l, list_reduce(l, lambda acc, x: case when x.size <= acc.gap
      then {{'gap': acc.gap - x.size, 'keys': list_append(acc.keys, x.key)}} else acc end, {{'gap': gap, 'keys': cast([] as varchar[])}}) as g
  from asked a join gaps s on a.source is not distinct from s.source),
others as (select source, g, list_filter(l, lambda x: not list_contains(g.keys, x.key)) as l from greedy),
least_off as (select source, g, list_min(list_transform(l, lambda x: abs(g.gap - x.size))) as off, l from others),
more as (select source, unnest(list_concat(g.keys, case when off < g.gap
    then [list_filter(l, lambda x: abs(g.gap - x.size) = off)[1].key] else cast([] as varchar[]) end)) as key from least_off),
done as (select p.*, cast(certain + extra::int + (m.key is not null)::int as bigint) as copies from placed p
  left join more m on p.source is not distinct from m.source and p.key = m.key)
select doc_id, size, source_size, cast(target as double) as target, copies * size as taken, copies from done"""

_H = _crc32("cast(conv_id as varchar)")
TRIE = f"""with own as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first) as turns
  from conversations where conv_id is not null group by 1),
taken as (select conv_id, turns, conv_id - conv_id % 100 as base, {_H} % 6 as h from own),
rebuilt as materialized (select c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(c.turns, cast(h + 1 as bigint), len(c.turns))) as turns
  from taken c left join own b on b.conv_id = c.base),
ways as materialized (select conv_id, d, len(turns) as n, md5(cast(list_slice(turns, 1, d) as varchar)) as k,
    case when d > 0 then md5(cast(list_slice(turns, 1, d - 1) as varchar)) end as p, case when d > 0 then length(turns[d].t) else 0 end as size
  from (select *, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
nodes as materialized (select k, d, any_value(p) as p, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d) as ends from ways group by k, d),
kids as (select p as k, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2),
full_nodes as materialized (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (k, d)),
over as (select distinct w.k as k, w.d as d, n.k as below, n.d as below_d from full_nodes n join ways w on w.conv_id = n.conv_id and w.d <= n.d),
sums as (select o.k, o.d, count(*) filter (n.n_children = 0) as n_leaves, sum((n.n_convs - 1) * n.size) as saved
  from over o join full_nodes n on n.k = o.below and n.d = o.below_d group by 1, 2)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, cast(n.n_children as bigint) as n_children,
  cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from full_nodes n join sums s on s.k = n.k and s.d = n.d left join full_nodes u on u.k = n.p and u.d = n.d - 1"""

SQL: dict[str, str] = {
    "op2_jaccard_join": JACCARD,
    "op3_suffix_dedup": BYTES,
    "op4_substring_dedup": WINDOWS,
    "op5_secret_scans": _secrets(),
    "op6_quality_rules": RULES,
    "op7_embedding_dedup": VECTORS,
    "op10_mixing": MIXING,
    "op11_prefix_trie": TRIE,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
