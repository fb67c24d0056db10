"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import ns_kmeans
from .length_buckets import BUCKETS, TOKEN_BUDGET
from .queries import RULES
from .url_terms import SOFT, STRICT, THRESHOLD, UPPER, LOW

_LOWER = f"translate(coalesce({{}}, ''), '{UPPER}', '{LOW}')"


def _op5() -> str:
    return f"""
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from (select doc_id, {_LOWER.format('text')} as t from documents) window w as (partition by t)"""


def _op2() -> str:
    return """
        with p as (select page_id, url, coalesce(html, '') as h from pages),
        q as (select *, octet_length(encode(h)) as n from p),
        r as (select *, case when n >= 1000 then max(page_id) over (partition by h) end as best from q)
        select page_id, cast(n as bigint) as payload_bytes, sha1(h) as payload_digest, case when best != page_id then 'revisit' else 'response' end as record_type,
               case when best != page_id then best end as refers_to
        from r"""


def _op6() -> str:
    rule, verdict = "null", "null"
    for what, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        host, path = text[:text.index("/")], text[text.index("/"):]
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        rule, verdict = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{what}' else {verdict} end"
    word = "(^|[^a-z0-9]){}($|[^a-z0-9])"
    strict = " or ".join(f"regexp_matches(u, '{word.format(t)}')" for t in STRICT)
    weight = " + ".join(f"case when regexp_matches(u, '{word.format(t)}') then {w} else 0 end" for t, w in SOFT.items())
    return f"""
        with p as (select page_id, {_LOWER.format('url')} as u, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        q as (select page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOW}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
        r as (select page_id, host, path, {rule} as rule, {verdict} as ruled, {strict} as hard, cast({weight} as integer) as weight from q)
        select page_id, host, path, rule, coalesce(ruled, case when hard or weight >= {THRESHOLD} then 'block' else 'allow' end) as verdict, weight from r"""


def _op8() -> str:
    big = 1_000_000  # cost * big + split: the smallest cost, then the first split
    steps = [f"""d1 as (select j, cast(v as hugeint) * c - s as cost, cast(0 as bigint) as i from cells)"""]
    for k in range(2, BUCKETS + 1):
        steps.append(f"""d{k} as (select j, x // {big} as cost, cast(x % {big} as bigint) as i from (
            select b.j, min((a.cost + cast(b.v as hugeint) * (b.c - ca.c) - (b.s - ca.s)) * {big} + a.j) as x
            from d{k - 1} a join cells ca on ca.j = a.j join cells b on b.j > a.j where a.j >= {k - 1} group by b.j))""")
    last = "select least((select max(j) from cells), {}) as k, (select max(j) from cells) as j".format(BUCKETS)
    back = f"b{BUCKETS} as ({last})"
    for k in range(BUCKETS, 1, -1):
        back += f""",
        b{k - 1} as (select case when t.k >= {k} then {k - 1} else t.k end as k, case when t.k >= {k} then d.i else t.j end as j from b{k} t left join d{k} d on d.j = t.j)"""
    ends = " union ".join(f"select j from b{k}" for k in range(1, BUCKETS + 1))
    return f"""
        with lengths as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 as bigint) as n from documents),
        sized as (select doc_id, n, n as v from lengths),
        hist as (select v, count(*) as n, cast(sum(n) as bigint) as t from sized group by v),
        cells as (select row_number() over (order by v) as j, v, cast(sum(n) over (order by v) as bigint) as c, cast(sum(t) over (order by v) as bigint) as s from hist),
        {", ".join(steps)},
        {back},
        ends as (select distinct v from cells join ({ends}) using (j)),
        buckets as (select v as boundary, cast(row_number() over (order by v) - 1 as integer) as bucket, greatest(1, {TOKEN_BUDGET} // v) as room from ends),
        placed as (select doc_id, n, (select min(boundary) from buckets where boundary >= n) as boundary from sized),
        numbered as (select p.*, b.bucket, b.room, row_number() over (partition by p.boundary order by n, doc_id nulls first) - 1 as place from placed p join buckets b using (boundary)),
        batches as (select bucket, sum((m + room - 1) // room) over (order by bucket) - (m + room - 1) // room as first from (
            select bucket, any_value(room) as room, count(*) as m from numbered group by bucket))
        select doc_id, n as n_tokens, bucket, boundary, cast(first + place // room as bigint) as batch_id, cast(place % room as integer) as slot, boundary - n as padding
        from numbered join batches using (bucket)"""


def _op11() -> str:
    steps = []
    for t in range(ns_kmeans.ROUNDS + 1):
        pair = "cast(list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) as bigint)"
        steps.append(f"""p{t} as materialized (select r, j, {pair} as d from v cross join c{t}),
        a{t} as materialized (select r, vec_id, q, d, j from (select *, row_number() over (partition by r order by d, j) as k from p{t}) join v using (r) where k = 1)""")
        if t < ns_kmeans.ROUNDS:
            steps.append(f"""s{t} as (select j, i, sum(x) as s, count(*) as n from (select j, unnest(q) as x, unnest(range(64)) as i from a{t}) group by j, i),
        m{t} as (select j, list(cast((s - (s % n + n) % n) // n as bigint) order by i) as c from s{t} group by j),
        c{t + 1} as materialized (select j, coalesce(m{t}.c, c{t}.c) as c from c{t} left join m{t} using (j))""")
    return f"""
        with v as materialized (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        c0 as materialized (select row_number() over (order by sha256('{ns_kmeans.SEED}:' || vec_id) nulls last, q) - 1 as j, q as c from v qualify j < {ns_kmeans.CLUSTERS}),
        {", ".join(steps)},
        total as (select cast(sum(d) as bigint) as inertia from a{ns_kmeans.ROUNDS}),
        parts as (select j, cast(sum(d) as bigint) as cluster_inertia from a{ns_kmeans.ROUNDS} group by j)
        select vec_id, cast(j as integer) as cluster, d as distance, cluster_inertia, inertia, sha256(array_to_string(c, ',')) as centroid_sha256
        from a{ns_kmeans.ROUNDS} join c{ns_kmeans.ROUNDS} using (j) join parts using (j) cross join total"""


def _crc32(number: str) -> str:
    """crc32 of a number's decimal digits, bit by bit."""
    steps = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: case when s % 2 = 1 then xor(s // 2, 3988292384) else s // 2 end)"
    codes = f"list_transform(string_split(cast({number} as varchar), ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce({codes}, lambda a, b: {steps}, 4294967295), 4294967295)"


def _op12() -> str:
    return f"""
        with raw as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        named as (select *, md5(length(role) || ':' || role || text) as m, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from raw),
        turns as (select c, row_number() over (partition by c order by turn nulls first, role, m) as i, m, w from named),
        ids as (select c, {_crc32('c')} % 4 as h from (select distinct c from turns)),
        rows as (select c, 1 as part, i, m, w from turns join ids using (c) where i > h
                 union all select ids.c, 0, i, m, w from ids join turns on turns.c = ids.c - ids.c % 20 and i <= h),
        paths as (select c, row_number() over v as depth, string_agg(m, '') over v as key, w from rows window v as (partition by c order by part, i)
                  union all select c, 0, '', 0 from ids),
        nodes as (select key, any_value(depth) as depth, min(c) as owner, count(*) as n, any_value(w) as w from paths group by key),
        children as (select left(key, length(key) - 32) as key, count(*) as n from nodes where depth > 0 group by 1),
        subtrees as (select p.key, count(*) filter (children.key is null) as leaves, sum((y.n - 1) * y.w) as saved
                     from nodes y left join children on children.key = y.key join paths p on p.c = y.owner and p.depth <= y.depth group by p.key),
        ends as (select key, string_agg(c, ',' order by c) as ids from (select c, max_by(key, depth) as key from paths group by c) group by key)
        select x.owner as conv_id, cast(x.depth as bigint) as depth, up.owner as parent_conv_id, x.n as n_convs, coalesce(children.n, 0) as n_children,
               cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(ends.ids, '')) as ends_sha256
        from nodes x left join nodes up on x.depth > 0 and up.key = left(x.key, length(x.key) - 32) left join children on children.key = x.key
        join subtrees on subtrees.key = x.key left join ends on ends.key = x.key"""


def _op13() -> str:
    blank = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
        with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from d),
        k as (select *, {_LOWER.format(f"trim(line, {blank})")} as key from l),
        held as (select key, min(coalesce(doc_id, 9223372036854775807)) as keep from k where length(key) >= 10
                 group by key having min(coalesce(doc_id, 9223372036854775807)) != max(coalesce(doc_id, 9223372036854775807))),
        marked as (select k.*, held.key is not null and keep != coalesce(doc_id, 9223372036854775807) as gone from k left join held on held.key = k.key)
        select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
        from marked group by r"""


ORACLE: dict[str, str] = {"op2_arc_to_warc": _op2(), "op5_quotient_dedup": _op5(), "op6_url_vocabulary": _op6(), "op8_length_buckets": _op8(),
                          "op11_ns_kmeans": _op11(), "op12_prefix_trie": _op12(), "op13_line_index": _op13()}
