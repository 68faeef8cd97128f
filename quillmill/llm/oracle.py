"""SQL of those operators that SQL can express on whole tables, for DuckDB."""

from __future__ import annotations

from . import licenses, lloyd, resampling, secret_scan

#: Nodes and their least reachable node; needs ids(id) and edges(u, v), both directions.
REACH = """reach(id, c) as (select id, id from ids union select e.v, r.c from reach r join edges e on e.u = r.id),
component as (select id, min(c) as component_id from reach group by id)"""

OP2 = f"""with recursive v as (select vec_id as id, embedding::double[] as e from embeddings),
ok as (select id, e from v where e is not null and list_dot_product(e, e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0),
pairs as (select a.id as u, b.id as v from ok a join ok b on a.id < b.id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
edges as (select u, v from pairs union all select v, u from pairs),
ids as (select id from v), {REACH},
n as (select u as id, count(*) as n_links from edges group by u)
select v.id as vec_id, coalesce(n.n_links, 0) as n_links, component.component_id, component.component_id = v.id as kept
from v join component on component.id = v.id left join n on n.id = v.id"""

OP3 = f"""with recursive w as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s from w),
one as (select id, len(s) as n, unnest(s) as x from s),
met as (select a.id as u, b.id as v, a.n as n, b.n as m, count(*) as k from one a join one b on a.x = b.x and a.id < b.id group by all),
links as (select u, v from met where 100 * k >= 75 * (n + m - k)),
edges as (select u, v from links union all select v, u from links),
ids as (select id from s), {REACH}
select s.id as doc_id, cast(len(s.s) as bigint) as n_shingles, component.component_id from s join component on component.id = s.id"""


def without_possession(pattern: str) -> str:
    """A rule's pattern for an engine that neither backtracks nor looks ahead: possessive
    repetitions are plain ones there, and runs of fewer than five dashes are spelled out."""
    plain = pattern.replace("[^-]*+(?:-(?!----)[^-]*+)*+", "(?:[^-]|-{1,4}[^-])*")
    for mark in ("*", "+", "}"):
        plain = plain.replace(f"{mark}+", mark)
    return plain


def secrets_sql() -> str:
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        p = without_possession(r.pattern).replace("'", "''") if r.pattern == secret_scan.PEM else r.pattern.replace("'", "''")
        parts.append(f"select doc_id, '{r.kind}' as kind, {k} as rank, {r.least} as least, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {r.measured}) as v from d")
    base = sum(r.base for r in secret_scan.RULES)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.RULES)
    outs = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secret_scan.RULES)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
x as ({" union all ".join(parts)}),
y as (select *, unnest(range(1, len(m) + 1)) as i from x where len(m) > 0),
z as (select doc_id, kind, rank, cast(list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(g) for g in m[1:i - 1]]), 0) as bigint) as s, length(m[i]) as n from y where length(v[i]) >= least),
a as (select doc_id, {counts}, string_agg(concat(kind, ':', s, ':', s + n), ',' order by s, rank) as spans, string_agg(concat(kind, ':', s, ':', s + n), ',' order by s, rank) filter (where rank < {base}) as base from z group by doc_id)
select d.doc_id, {outs}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


OP10 = """with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as i from h where length(h) >= 400),
k as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as g from p),
many as (select g from k group by g having count(*) > 1),
lost as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from k semi join many using (g)),
run as (select *, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as r from lost),
runs as (select doc_id, r, min(i) as s, max(i) + 200 as e from run group by doc_id, r),
gap as (select doc_id, r, coalesce(lag(e) over (partition by doc_id order by r), 0) as a, s as b from runs
 union all select doc_id, max(r) + 1, max(e), null from runs group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' order by r) as kept from gap join h using (doc_id) group by doc_id),
n as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans from runs group by doc_id)
select h.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.kept, h))) as kept_sha256
from h left join n using (doc_id) left join kept using (doc_id)"""


def low(c: str) -> str:
    return f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WORDS = f"regexp_extract_all({low('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def licenses_sql() -> str:
    ts = licenses.TEMPLATES
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {len(licenses.runs_of(t.text))}, {len(licenses.runs_of(t.text)) if t.phrase else licenses.VOTES}, {0 if t.phrase else licenses.SLIP}, {1.0 if t.phrase else licenses.SHARE})" for k, t in enumerate(ts))
    runs = ", ".join(f"({k}, {s}, '{r}')" for k, t in enumerate(ts) for s, r in enumerate(licenses.runs_of(t.text)))
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, licenses.K + 1))
    return f"""with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
t(template, label, base, size, votes, slip, least) as (values {rows}),
g(template, spot, run) as (values {runs}),
p as (select r, w, unnest(range(0, len(w) - {licenses.K - 1})) as i from d),
v as (select r, template, i - spot as diagonal, count(distinct spot) as n, min(spot) as a, max(spot) as b, list(distinct spot) as spots from (select r, i, {gram} as own from p) join g on own = run group by all),
strong as (select v.*, t.* exclude (template, votes) from v join t using (template) where n >= votes),
new as (select *, case when diagonal - lag(diagonal) over (partition by r, template order by diagonal) <= slip then 0 else 1 end as fresh from strong),
band as (select *, sum(fresh) over (partition by r, template order by diagonal) as band from new),
merged as (select r, template, label, base, size, least, band, min(diagonal + a) as s, len(list_distinct(flatten(list(spots)))) / size as share from band group by r, template, label, base, size, least, band),
sure as (select * from merged where share >= least),
f as (select r, count(*) filter (where base) as n_base, min(s) filter (where base) as first_word, max(s) filter (where base) as last_word,
 string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from sure group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score
from d left join f using (r)"""


def lloyd_sql() -> str:
    def to(c: str) -> str:  # squared distance of integer vectors held as doubles
        return f"list_dot_product(v, v) - 2 * list_dot_product(v, {c}) + list_dot_product({c}, {c})"

    rounds = ""
    for k in range(lloyd.ROUNDS):
        rounds += f""",
a{k} as materialized (select i, v, min({{'d': {to("c")}, 'k': k}}) as b from x, c{k} group by i, v),
s{k} as (select b.k as k, j, sum(v[j]) as s, count(*) as n from a{k}, range(1, {lloyd.DIM + 1}) r(j) group by all),
m{k} as (select k, list(floor(s / n) order by j) as c from s{k} group by k),
c{k + 1} as materialized (select c{k}.k, coalesce(m{k}.c, c{k}.c) as c from c{k} left join m{k} using (k))"""
    last = f"c{lloyd.ROUNDS}"
    return f"""with kept as (select vec_id, embedding::double[] as e from embeddings where len(embedding) = {lloyd.DIM} and len([y for y in embedding if y is null or not isfinite(y)]) = 0),
x as materialized (select row_number() over () as i, vec_id, [floor({lloyd.SCALE} * y) for y in e] as v from kept),
c0 as materialized (select row_number() over (order by sha256('{lloyd.SEED}:' || vec_id), v) - 1 as k, v as c from x qualify k < {lloyd.CENTROIDS}){rounds},
a as (select i, vec_id, min({{'d': {to("c")}, 'k': k}}) as b from x, {last} group by i, vec_id),
o as (select vec_id, cast(b.k as integer) as cluster, cast(b.d as bigint) as distance from a)
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
 sha256(array_to_string([cast(y as bigint) for y in c], ',')) as centroid_sha256 from o join {last} on k = cluster"""


def resampling_sql() -> str:
    table = []
    for b in range(256):  # the rule that makes the table of the checksum
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    step = f"xor(a >> 8, list_extract({table}, cast(xor(a, b) & 255 as integer) + 1))"
    octets = "[cast(('0x' || substr(hex(encode(g)), 2 * j + 1, 2)) as bigint) for j in range(strlen(g))]"
    n = resampling.BUCKETS
    grams = lambda of: f"select r, unnest(list_concat(w, [w[j] || ' ' || w[j + 1] for j in range(1, len(w))])) as g from {of}"
    return f"""with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
q as (select row_number() over () as r, {WORDS} as w from benchmark),
df as ({grams("d")}), qf as ({grams("q")}),
names as (select distinct g from (select g from df union all select g from qf)),
h as materialized (select g, xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda a, b: {step}), 4294967295) % {n} as bucket from names),
s as (select bucket, count(*) as s from df join h using (g) group by 1),
t as (select bucket, count(*) as t from qf join h using (g) group by 1),
total as (select coalesce((select sum(s) from s), 0) as big_s, coalesce((select sum(t) from t), 0) as big_t),
gain as (select b as bucket, cast(floor(1000.0 * ln((coalesce(t, 0) + 1)::double * (big_t * 0 + big_s + {n})::double / ((coalesce(s, 0) + 1)::double * (big_t + {n})::double))) as bigint) as gain
 from range({n}) r(b) left join s on s.bucket = b left join t on t.bucket = b, total),
m as (select r, count(*) as n, sum(gain) as total from df join h using (g) join gain using (bucket) group by r),
x as (select doc_id, len(w) as words, coalesce(n, 0) as n_features, coalesce(floor(total / n), 0) as weight, cast(('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8)) as bigint) as h from d left join m using (r)),
y as (select doc_id, words, n_features, cast(weight as bigint) as weight, cast(weight + floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0::double))) as bigint) as score from x),
z as (select *, words >= {resampling.LEAST_WORDS} as able, row_number() over (partition by words >= {resampling.LEAST_WORDS} order by score desc, doc_id) as k, count(*) filter (where words >= {resampling.LEAST_WORDS}) over () as n from y)
select doc_id, n_features, weight, score, case when able and k <= {resampling.PERCENT} * n // 100 then k end as rank from z"""


ORACLE_SQL = {
    "op2_collisions": OP2,
    "op3_jaccard": OP3,
    "op4_secrets": secrets_sql(),
    "op10_suffixes": OP10,
    "op11_licenses": licenses_sql(),
    "op12_lloyd": lloyd_sql(),
    "op13_resampling": resampling_sql(),
}
