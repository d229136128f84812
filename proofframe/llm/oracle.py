"""DuckDB SQL for the operators that SQL can express."""

JACCARD = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s
  from words),
items as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as x, b.doc_id as y
  from items a join items b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (
  select doc_id, doc_id from sets
  union
  select r.doc_id, l.y from reach r join both_ways l on l.x = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.component_id
from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) m on m.doc_id = s.doc_id
"""

URLS = r"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
cut as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts),
rules(action, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (
  select page_id, h || p as rule, action, row_number() over (partition by page_id order by length(h || p) desc, h || p) as k
  from cut join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select c.page_id, c.host, c.path, f.rule, coalesce(f.action, 'allow') as verdict
from cut c left join fits f on f.page_id = c.page_id and f.k = 1
"""


def clusters(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Every distance from every vector to every centroid, round after round."""
    parts = [
        f"kept as materialized (select row_number() over () r, vec_id, sha256('{seed}:' || vec_id) h, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) v from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda e: isfinite(e))) = {dim})",
        f"x as materialized (select r, i, v[i] x from (select r, v, unnest(range(1, {dim + 1})) i from kept))",
        f"c0 as materialized (select c, i, v[i] x from (select c, v, unnest(range(1, {dim + 1})) i from (select row_number() over (order by h, v) - 1 c, v from kept where vec_id is not null qualify c < {k})))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select r, arg_min(c, d * {k} + c) c, min(d) d from (select x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) d from x join c{n} c on c.i = x.i group by 1, 2) group by 1)")
        if n < rounds:
            mean = "(sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*)"
            new = f"select a.c, x.i, {mean} x from x join a{n} a on a.r = x.r group by 1, 2"
            parts.append(f"c{n + 1} as materialized (select o.c, o.i, coalesce(m.x, o.x) x from c{n} o left join ({new}) m on m.c = o.c and m.i = o.i)")
    final = f"""select k.vec_id, cast(a.c as integer) "cluster", cast(a.d as bigint) distance, cast(sum(a.d) over (partition by a.c) as bigint) cluster_inertia,
  cast(sum(a.d) over () as bigint) inertia, s.s centroid_sha256
from a{rounds} a join kept k on k.r = a.r join (select c, sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by i)) s from c{rounds} group by 1) s on s.c = a.c"""
    return f"with {', '.join(parts)} {final}"


CLUSTERS = clusters()

#: CRC-32 byte by byte, from a table of the 256 bytes' remainders; distinct features only.
RESAMPLE = r"""
with crc as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) order by i) t from (select unnest(range(256)) i)),
texts as (select 'd' src, row_number() over () r, doc_id, coalesce(text, '') as text from documents union all select 'b', row_number() over (), null, coalesce(text, '') from benchmark),
words as materialized (select src, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from texts),
runs as materialized (select src, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from words),
bucket as materialized (select f, xor(list_reduce(list_transform(range(1, strlen(f) + 1), lambda i: cast('0x' || substr(hex(encode(f)), 2 * i - 1, 2) as bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 b from (select distinct f from runs), crc),
counts as (select b, count(*) filter (src = 'd') s, count(*) filter (src = 'b') t from runs join bucket using (f) group by 1),
gain as (select b, floor(1000 * ln((cast(t + 1 as double) * cast(sum(s) over () + 10000 as double)) / (cast(s + 1 as double) * cast(sum(t) over () + 10000 as double)))) g from counts),
weight as (select r, count(*) n_features, floor(cast(sum(cast(g as bigint)) as double) / count(*)) weight from runs join bucket using (f) join gain using (b) where src = 'd' group by 1),
scored as (select doc_id, len(w) n, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(cast('0x' || left(sha256('7:' || doc_id), 8) as bigint) as double) + 0.5) / 4294967296))) score
  from words d left join weight using (r) where src = 'd')
select doc_id, cast(n_features as bigint) n_features, cast(weight as bigint) weight, cast(score as bigint) score,
  case when n >= 20 and k <= (25 * (select count(*) from scored where n >= 20)) // 100 then k end as "rank"
from (select *, row_number() over (partition by n >= 20 order by score desc, doc_id) k from scored)
"""
