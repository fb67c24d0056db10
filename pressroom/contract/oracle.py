"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from ..operators.brief import BRIEF_PROMPT, SENTIMENT_PROMPT
from ..sources.derived import AS_OF, DIM, METHOD_OF_TOPIC, MODEL, SEARCH_AS_OF

_METHODS = " ".join(f"when '{t}' then '{m}'" for t, m in METHOD_OF_TOPIC.items())

FEED = rf"""table_rows as (select greatest(1, (select count(*) from documents)) as nd, (select count(*) from events) as ne, (select count(*) from pages) as np),
deal_steps as (select greatest(1, (ne + nd - 1) // nd) as stride, greatest(1, nd // greatest(1, np)) as step, nd, np from table_rows),
deals as (select *, greatest(1, (np + nd // step - 1) // (nd // step)) as per_page from deal_steps),
slots as materialized (select event_id // stride as slot, max(ts) as ts, min_by(event_type, event_id) as event_type from events, deals group by 1),
page_slots as materialized (select page_id // per_page as slot, min(url) as url from pages, deals group by 1),
feed as materialized (
  select strftime(e.ts, '%Y-%m-%d') as batch, case e.event_type {_METHODS} end as method, e.event_type as topic,
    d.doc_id as ord, trim(regexp_extract(d.text, '^[^.\n!?]*', 0)) as title,
    case when d.doc_id % step = 0 then p.url
         else 'https://news.example.com/a/' || d.doc_id || '?utm_source=rss' end as url,
    d.text as summary, strftime(e.ts, '%a, %d %b %Y %H:%M:%S GMT') as published_date,
    case when d.doc_id % 4 <> 0 or d.doc_id % 8 = 0 then d.source
         else 'https://' || d.source || '.example.com' end as publisher_name,
    case when d.doc_id % 4 = 0 then 'https://' || d.source || '.example.com' end as publisher_href,
    case d.lang when 'en' then 'US' when 'fr' then 'FR' when 'de' then 'DE' else 'ES' end as country,
    d.lang as language, '{MODEL}' as embed_model, {DIM}::integer as embed_dim,
    date_trunc('second', e.ts) as published_at
  from documents d cross join deals
  join slots e on e.slot = d.doc_id % (select count(*) from slots)
  left join page_slots p on p.slot = d.doc_id // step % (select count(*) from page_slots))"""


def _slug(t: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(replace(" + _plain(t) + ",' ','-'),'[^a-z0-9\\-]+','','g'),'-{2,}','-','g'),'-')"
    )


def _plain(t: str) -> str:
    ascii_ = f"regexp_replace(strip_accents({t}),'[^\\x00-\\x7F]','','g')"
    return (
        f"regexp_replace(regexp_replace(lower({ascii_}),'^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$','','g'),"
        "'[\\s\\x1c-\\x1f]+',' ','g')"
    )


_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def _canonical(u: str) -> str:
    part = lambda i: f"regexp_extract({u}, {_URL}, {i})"
    host = f"lower(regexp_extract({part(2)}, '^(?:.*@)?([^:@]*)', 1))"
    port = f"ltrim(regexp_extract({part(2)}, ':([0-9]+)$', 1), '0')"
    kept = (
        f"array_to_string(list_filter(string_split({part(4)}, '&'), "
        "lambda x: x <> '' and not starts_with(lower(x), 'utm_')), '&')"
    )
    return (
        f"lower({part(1)}) || '://' || {host} || case when {port} <> '' then ':' || {port} else '' end || "
        f"coalesce(nullif(rtrim({part(3)}, '/'), ''), '/') || "
        f"case when coalesce({kept}, '') <> '' then '?' || {kept} else '' end"
    )


KEYED = FEED + rf""",
keyed as materialized (
  select *, {_slug('title')} as title_slug,
    coalesce(nullif({_plain('publisher_name')}, ''), 'unknown') as publisher_norm,
    sha256({_slug('title')} || '|' || coalesce(nullif({_plain('publisher_name')}, ''), 'unknown')) as composite_key,
    sha256({_canonical('url')}) as url_hash
  from feed)"""

# Runs that store nothing: errors of every seventh day are rate-limited, clicks of every ninth day fail.
_LIMITED = "(day % 7 = 0 and topic = 'error')"
_FAILED = "(day % 9 = 0 and topic = 'click')"

ACCEPT = KEYED + """,
lined as materialized (select row_number() over (order by ord) as rn, ord, composite_key as k, url_hash as u from keyed),
walk as (
  select 0::bigint as rn, null::bigint as ord, []::varchar[] as ks, []::varchar[] as us, false as ok
  union all
  select y.rn, y.ord, case when y.ok then list_append(y.ks, y.k) else y.ks end,
         case when y.ok then list_append(y.us, y.u) else y.us end, y.ok
  from (select l.rn, l.ord, l.k, l.u, w.ks, w.us,
               not list_contains(w.ks, l.k) and not list_contains(w.us, l.u) as ok
        from walk w join lined l on l.rn = w.rn + 1) y),
accepted as (select ord, row_number() over (order by ord) as id from walk where ok)"""

WITH_ACCEPT = "with recursive " + ACCEPT

def _accepted_without(stopped: str) -> str:
    """The sequential pass over the records of runs that are not ``stopped``."""
    of = f"(select *, extract(day from batch::date) as day from keyed) where not ({stopped})"
    return WITH_ACCEPT.replace("url_hash as u from keyed)", f"url_hash as u from {of})")


RUNS = _accepted_without(f"day % 13 <> 0 and ({_LIMITED} or {_FAILED})") + f""",
runs as (
  select batch || '/' || topic as run_id, batch, topic, method, count(*) as fetched, count(id) as new,
    count(*) - count(id) as skipped, extract(day from batch::date) as day
  from keyed left join accepted using (ord) group by batch, topic, method),
log as (
  select run_id, topic, method,
    case when stopped or open then 0 else fetched end::bigint as fetched,
    case when stopped or open then 0 else new end::bigint as new_articles,
    case when stopped or open then 0 else skipped end::bigint as skipped_dupes,
    case when open then 'partial' when told and {_LIMITED} then 'rate_limited' when told and {_FAILED} then 'failed' else 'success' end as status,
    case when not open and told and {_LIMITED} then '429' when not open and told and {_FAILED} then 'timeout' end as error_message,
    batch || 'T00:00:00' as started_at,
    case when not open and told then fetched / 8 end::double as duration_seconds
  from (select *, day % 13 <> 0 as told, day % 11 = 0 as open, day % 13 <> 0 and ({_LIMITED} or {_FAILED}) as stopped from runs)
  where told or not open)"""

# Articles as stored: the id is the arrival number.
ARTICLES = FEED + ", articles as (select ord as id, * exclude (ord) from feed)"

VECTORS = ARTICLES + """,
vectors as (
  select e.vec_id as id, e.embedding::double[] as v, e.label, a.country, a.language, a.topic
  from embeddings e left join articles a on a.id = e.vec_id),
q as (select embedding::double[] as v from embeddings where vec_id = 0)"""

_COSINE = "list_cosine_similarity(x.v, q.v)"
_L2 = "1 - list_sum(list_transform(list_zip(x.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_RECENCY = (
    f"exp(-greatest(0, epoch_us(timestamp '{SEARCH_AS_OF}') - epoch_us(published_at)) / 86400000000.0 / 3.0)"
)
_WORDS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}\x{{E000}}-\x{{F8FF}}]+')"

TOKENS = ARTICLES + f""",
lists as (select id, title, {_WORDS.format('title')} as t, {_WORDS.format('summary')} as s from articles),
sizes as (select id, len(t) + len(s) as d from lists),
tok as (select id, unnest(t) as token, 0 as col from lists union all
        select id, unnest(s) as token, 1 as col from lists),
totals as (select count(*) as n_docs, sum(d) / count(*) as avg_d from sizes)"""


def _bm25(hits: str) -> str:
    """Scored CTE from ``hits(term, id, f)``; (id, rank, terms)."""
    return TOKENS + f""",
hits as ({hits}),
idf as (select term, case when w <= 0 then 1e-6 else w end as w from (
  select term, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as w from hits, totals group by term)),
scored as (
  select h.id, list(h.term) as terms,
    -sum(i.w * h.f * 2.2 / (h.f + 1.2 * (0.25 + 0.75 * z.d / totals.avg_d))) as rank
  from hits h join idf i using (term) join sizes z using (id), totals group by h.id)"""


_ONE_WORD = "select token as term, id, count(*) as f from tok where token in ({}) group by token, id"

_OF_THE = """select 'p' as term, id, f from (select id,
    len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the')) +
    len(list_filter(range(1, len(s)), lambda i: s[i] = 'of' and s[i + 1] = 'the')) as f from lists) where f > 0
  union all select 'w' as term, id, count(*) as f from tok where starts_with(token, 'wh') group by id"""


def _upkeep() -> str:
    """Three searches over what is left: a seventh of the articles is gone, of which the even ids came back with another title."""
    left = "(select * replace (title || case when id % 14 = 0 then ' renewed' else '' end as title) from articles where id % 7 <> 0 or id % 14 = 0)"
    part = "(with {} select '{}' as search, id, round(rank, 6) as rank from scored where len(terms) = 2)"
    hits = (("tion ble", _ONE_WORD.format("'tion', 'ble'")), ("of-the wh*", _OF_THE), ("renewed tion", _ONE_WORD.format("'renewed', 'tion'")))
    return " union all ".join(part.format(_bm25(sql).replace("from articles),\nsizes", f"from {left}),\nsizes"), text) for text, sql in hits)


_TOPICS = """topics as (select distinct unnest([event_type, upper(event_type)]) as topic from events)"""


def _ranked(n: int) -> str:
    return ARTICLES + f""",
ranked as (
  select *, row_number() over (partition by topic order by published_at desc, id) as place from articles
  qualify place <= {n})"""


_BRIEF_LINE = (
    "'[' || place || '] ' || title || ' — ' || publisher_name || ' (' || published_date || ')' || chr(10) || "
    "'    URL: ' || url || chr(10) || '    Summary: ' || summary"
)
_SENTIMENT_LINE = (
    "'- ' || title || ' — ' || publisher_name || ' (' || published_date || ')' || chr(10) || '  ' || summary"
)


def _fill(template: str, days: int | None = None) -> str:
    text = template.replace("'", "''")
    text = text.replace("{topic}", "' || topic || '").replace("{block}", "' || block || '")
    return "'" + (text if days is None else text.replace("{days}", str(days))) + "'"


def _briefs() -> str:
    return _ranked(20) + f""",
blocks as (
  select topic, string_agg({_BRIEF_LINE}, chr(10) order by place) as block,
    string_agg(url, ' ' order by place) as urls, min_by(url, place) as first_url, count(*) as article_count
  from ranked group by topic)"""


ORACLE: dict[str, str] = {
    "feed_normalize": f"""with {FEED}
select batch, method, topic, ord, title, url, summary, published_date, publisher_name, publisher_href,
  country, language, embed_model, embed_dim from feed""",
    "feed_method_counts": f"with {FEED} select method, count(*) as records from feed group by method",
    "feed_valid": f"""with {FEED} select topic, count(*) as fetched,
  count(*) filter (where title <> '' and url <> '') as usable from feed group by topic""",
    "title_slug": f"select doc_id, {_slug('text')} as slug from documents",
    "publisher_norm": f"""with {KEYED} select ord, publisher_norm as publisher from keyed""",
    "composite_key": f"with {KEYED} select ord, composite_key from keyed",
    "url_canonical": f"""select page_id, {_canonical('url')} as canonical,
  sha256({_canonical('url')}) as url_hash from pages""",
    "published_at": """select event_id, published_date,
  case event_id % 10 when 2 then s when 3 then s when 0 then s when 1 then s when 4 then s
    when 5 then d when 6 then d end as published_at
from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as s, strftime(ts, '%Y-%m-%dT00:00:00') as d,
  case event_id % 10
    when 0 then strftime(ts, '%a, %d %b %Y %H:%M:%S GMT')
    when 1 then strftime(ts, '%a, %-d %b %Y ') || extract(hour from ts) || ':' || extract(minute from ts) || ':' ||
                extract(second from ts) || ' utc'
    when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S+0530')
    when 3 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    when 4 then strftime(ts, '%Y-%m-%d %H:%M:%S')
    when 5 then strftime(ts, '%Y-%m-%d')
    when 6 then extract(year from ts) || '-' || extract(month from ts) || '-' || extract(day from ts)
    when 7 then strftime(ts, '%a, %d %b %Y %H:%M:%S EST')
    when 8 then strftime(ts, '%Y-%m-%dT%H:%M:%S')
    else strftime(ts, '%d/%m/%Y') end as published_date
  from events)""",
    "recency_score": f"""select event_id, round(case when event_id % 10 = 0 then 0.5 else
  {_RECENCY.replace('published_at', "(ts + interval 10 day)").replace(SEARCH_AS_OF, AS_OF)} end, 6) as recency from events""",
    "context_header": f"""with {FEED} select ord, '[Topic: ' || topic || ' | Publisher: ' || publisher_name ||
  ' | Date: ' || published_date || ' | ' || country || ']' as header from feed""",
    "enriched_text": rf"""with {FEED} select ord, regexp_replace('[Topic: ' || topic || ' | Publisher: ' ||
  publisher_name || ' | Date: ' || published_date || ' | ' || country || ']' || chr(10) || title || chr(10) ||
  summary, '^\s+|\s+$', '', 'g') as text from feed""",
    "parse_replies": """select doc_id,
  case when doc_id % 4 = 3 then null when doc_id % 3 = 0 then 'positive' else 'mixed' end as overall,
  case when doc_id % 4 <> 3 then round(doc_id % 200 / 100 - 1, 6) end as score,
  case when doc_id % 4 <> 3 then text end as rationale, doc_id % 4 = 3 as corrupt from documents""",
    "webhook_screen": """with hooks as (select *, case event_id % 8
    when 0 then 'https://hooks.example.com/' || event_id
    when 1 then 'http://' || ip || '/x' when 2 then 'ftp://' || ip
    when 3 then case when event_id % 16 = 3 then 'https:///' || event_id else 'https://[' || case form
      when 0 then '::ffff:' || ip when 1 then x || '::1' when 2 then 'fe80::' || x || '%eth0' when 3 then '2001:db8:' || x || '::1'
      when 4 then '2a00:1450:' || x || '::200e' when 5 then '2001:20::' || x when 6 then '2002:' || x || '::1' else '3fff:fff::' || x end || ']/hook' end
    when 4 then '' when 5 then 'https://METADATA.google.internal/' || event_id
    else 'https://' || ip || ':8443/hook' end as webhook_url
  from (select *, a || '.' || b || '.' || c || '.' || d as ip, format('{:x}', g) as x from (
    select event_id, event_id % 256 as a, event_id * 37 % 256 as b, event_id * 101 % 256 as c,
      event_id * 11 % 256 as d, event_id * 149 % 65536 as g, event_id // 16 % 8 as form from events))),
judged as (select *, a in (0, 10, 127) or a >= 224 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31)
      or (a = 192 and b = 168) or (a = 192 and b = 0 and c = 2)
      or (a = 192 and b = 0 and c = 0 and d not in (9, 10))
      or (a = 198 and b in (18, 19)) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) as v4_blocked from hooks)
select event_id, webhook_url, case event_id % 8
  when 0 then null when 1 then 'https required' when 2 then 'scheme'
  when 3 then case when event_id % 16 = 3 then 'no host' when case form
      when 0 then v4_blocked when 1 then g not between 8192 and 16383 or g in (8193, 8194, 16383) when 4 then false when 5 then false else true end
    then 'blocked address' end
  when 4 then 'empty' when 5 then 'metadata host'
  else case when (a = 169 and b = 254 and c = 169 and d = 254) then 'metadata host' when v4_blocked then 'blocked address' end end as reason from judged""",
    "dedup_accept": f"{WITH_ACCEPT} select ord, id from accepted",
    "articles_build": f"""{WITH_ACCEPT} select id, title, url, url_hash, publisher_name, publisher_href,
  published_date, strftime(published_at, '%Y-%m-%dT%H:%M:%S') as published_at, summary, country, language, topic,
  embed_model, embed_dim, composite_key from keyed join accepted using (ord)""",
    "seen_ledger": f"""{WITH_ACCEPT}, firsts as (select k.composite_key, a.ord, a.id from accepted a join keyed k using (ord))
select k.composite_key, any_value(title_slug) as title_slug, any_value(publisher_norm) as publisher_norm,
  max(f.id) as article_id, count(*) as seen_count, '{AS_OF.replace(" ", "T")}' as first_seen,
  '{AS_OF.replace(" ", "T")}' as last_seen
from keyed k join firsts f on f.composite_key = k.composite_key and k.ord >= f.ord group by k.composite_key""",
    "ingest_summary": f"""{WITH_ACCEPT} select topic, count(*) as fetched, count(id) as new,
  count(*) - count(id) as skipped, 'success' as status from keyed left join accepted using (ord) group by topic""",
    "reingest_noop": f"with {FEED} select topic, count(*) as fetched, 0::bigint as new, count(*) as skipped from feed group by topic",
    "known_keys": rf"""with {KEYED}, held as (select distinct composite_key from keyed
  where regexp_extract(publisher_norm, '(\d+)', 1)::integer % 2 = 0)
select ord, composite_key in (select composite_key from held) as is_known from keyed""",
    "crawl_run_log": f"{RUNS} select * from log",
    "crawl_rollup": f"""{RUNS} select topic, status, count(*) as runs, sum(fetched)::bigint as fetched,
  sum(new_articles)::bigint as new_articles, sum(skipped_dupes)::bigint as skipped_dupes from log group by topic, status""",
    "stored_per_status": _accepted_without(f"{_LIMITED} or {_FAILED}") + f""",
runs as (select batch, topic, method, extract(day from batch::date) as day, count(id) as articles
  from keyed left join accepted using (ord) group by batch, topic, method)
select case when {_LIMITED} then 'rate_limited' when {_FAILED} then 'failed' else 'success' end as status,
  count(*) as runs, sum(articles)::bigint as articles from runs group by 1""",
    "feed_order": f"{WITH_ACCEPT} select id, url, composite_key from keyed join accepted using (ord)",
    # In a chain every second record is accepted, from the first.
    "dedup_chains": "select doc_id as ord from documents where doc_id % 100 % 2 = 0",
    "hydrate_articles": f"""with {ARTICLES} select id, title, url, publisher_name as publisher, published_date, summary,
  country, language, topic from articles where id in (select vec_id * 3 from embeddings)""",
    "results_to_json": f"""with {ARTICLES} select id::varchar as id, title, url, publisher_name as publisher, summary, topic
from articles""",
    "vector_upsert": """with s as (select vec_id as id, embedding as e, label from embeddings),
allv as (
  select id, e, label from s where label % 3 <> 0
  union all select id, list_transform(e, lambda x: (x * 2.0::double)::float), label + 2 from s where label % 3 = 0
  union all select id + 1000000, list_transform(e, lambda x: (x * 0.5::double)::float), label + 3 from s where label % 3 = 0)
select id, label, round(e[1]::double, 6) as head, round(list_sum(e::double[]), 6) as total from allv""",
    "vector_delete": "select vec_id as id, label from embeddings where label <> 3",
    "vectors_folded": """with s as (select vec_id as id, embedding as e, label from embeddings),
allv as (
  select id, e, label from s where label in (1, 2, 8, 9)
  union all select id, list_transform(e, lambda x: (x * 4.0::double)::float), label from s where label = 3
  union all select id + 1000000, list_transform(e, lambda x: (x * 0.5::double)::float), label from s where label = 3
  union all select id, list_transform(e, lambda x: (x * -1.0::double)::float), label from s where label = 5)
select id, label, round(e[1]::double, 6) as head, round(list_sum(e::double[]), 6) as total from allv""",
    "embedding_violations": f"""select vec_id as id, case when label = 4 then 63 else {DIM} end::integer as dim,
  case when label = 7 then 'other' else '{MODEL}' end as embed_model from embeddings where label in (4, 7)""",
    "knn_filtered": f"""with {VECTORS} select x.id, round({_COSINE}, 6) as similarity from vectors x, q
where country = 'US' and language = 'en' order by {_COSINE} desc, x.id limit 20""",
    "knn_l2": f"with {VECTORS} select x.id, round({_L2}, 6) as similarity from vectors x, q order by {_L2} desc, x.id limit 20",
    "knn_batch": """with v as (select vec_id as id, embedding::double[] as v from embeddings),
pairs as (select a.id as query_id, b.id, list_cosine_similarity(a.v, b.v) as s from v a, v b)
select query_id, row_number() over (partition by query_id order by s desc, id)::integer as place, id,
  round(s, 6) as similarity from pairs qualify place <= 10""",
    "knn_grid": f"""with v as (select vec_id as id, embedding::double[] as v from embeddings),
pairs as (select x.id as query_id, q.id, {_L2} as s from v x, v q)
select query_id, row_number() over (partition by query_id order by s desc, id)::integer as place, id, round(s, 6) as similarity
from pairs qualify place <= 3""",
    "semantic_search": f"""with {VECTORS},
hits as (select x.id, {_COSINE} as s from vectors x, q where country = 'US' and language = 'en'
  order by s desc, x.id limit 30),
scored as (select a.*, h.s, (1 - 0.3::double) * h.s + 0.3::double * {_RECENCY} as score
  from hits h join articles a using (id) where published_at >= timestamp '2024-01-03')
select id, title, url, publisher_name as publisher, published_date, summary, country, language, topic,
  round(score, 6) as score, 'semantic' as search_mode from scored order by scored.score desc, s desc, id limit 10""",
    "semantic_search_prefilter": f"""with {VECTORS},
hits as (select x.id, {_L2} as s from vectors x, q
  where x.id in (select id from articles where published_at >= timestamp '2024-01-03') order by s desc, x.id limit 30)
select id, round((1 - 0.3::double) * s + 0.3::double * 0.5, 6) as score, 'semantic' as search_mode
from hits join articles using (id) order by (1 - 0.3::double) * s + 0.3::double * 0.5 desc, s desc, id limit 10""",
    "search_batch": f"""with {ARTICLES}, v as (select vec_id as id, embedding::double[] as v from embeddings),
pairs as (select a.id as query_id, b.id, list_cosine_similarity(a.v, b.v) as s from v a, v b),
near as (select *, row_number() over (partition by query_id order by s desc, id) as n from pairs qualify n <= 15),
scored as (select query_id, id, title, topic, s, (1 - 0.3::double) * s + 0.3::double * {_RECENCY} as score
  from near join articles using (id) where published_at >= timestamp '2024-01-03')
select query_id, row_number() over (partition by query_id order by score desc, s desc, id)::integer as place,
  id, title, topic, round(score, 6) as score from scored qualify place <= 5""",
    "search_fallback": f"""with {_bm25(_ONE_WORD.format("'tion', 'ble'"))}
select id, title, publisher_name as publisher, 0.0::double as score, 'keyword' as search_mode, round(rank, 6) as rank
from scored join articles using (id) where len(terms) = 2 and language = 'en'
  and published_at >= timestamp '2024-01-11' order by scored.rank, id limit 10""".replace("title, publisher_name", "articles.title, publisher_name"),
    "latest_for_topic": f"""with {_bm25(_ONE_WORD.format("'ing'"))}
select id, articles.title, 0.0::double as score, round(rank, 6) as rank from scored join articles using (id)
order by scored.rank, id limit 10""",
    "tokens": f"with {TOKENS} select token, count(*) as occurrences, count(distinct id) as articles from tok group by token",
    "postings": f"with {TOKENS} select token, id, count(*) as tf from tok group by token, id",
    "article_lengths": f"with {TOKENS} select id, d::integer as n from sizes",
    "keyword_search": f"""with {_bm25(_ONE_WORD.format("'tion', 'ble'"))}
select id, articles.title, topic, round(rank, 6) as rank from scored join articles using (id)
where len(terms) = 2 and country = 'US' and published_at >= timestamp '2024-01-05' order by scored.rank, id limit 20""",
    "keyword_phrase": f"""with {_bm25(_OF_THE)}
select id, round(rank, 6) as rank from scored where len(terms) = 2 order by scored.rank, id limit 50""",
    "keyword_any": f"""with {_bm25("select token as term, id, count(*) as f from tok where col = 0 and token in ('tion', 'ing', 'ble') group by token, id")}
select id, round(rank, 6) as rank from scored where not list_contains(terms, 'ble') order by scored.rank, id limit 50""",
    "index_upkeep": _upkeep(),
    "keyword_blockmax": f"""with {_bm25(_ONE_WORD.format("'tion', 'ble'"))}
select id, round(rank, 6) as rank from scored where len(terms) = 2 order by scored.rank, id limit 20""",
    "timeline_daily": f"""with {ARTICLES} select strftime(published_at, '%Y-%m-%d') as date, count(*) as count
from articles group by date""",
    "timeline_range": f"""with {ARTICLES} select strftime(published_at, '%Y-%m-%d') as date, count(*) as count from articles
where topic = 'click' and published_at >= timestamp '2024-01-10' and published_at < timestamp '2024-01-21' group by date""",
    "timeline_range_observed": f"""with {ARTICLES} select strftime(published_at, '%Y-%m-%d') as date, count(*) as count
from articles where strftime(published_at, '%Y-%m-%dT%H:%M:%S') >= '2024-01-11'
  and strftime(published_at, '%Y-%m-%dT%H:%M:%S') <= '2024-01-25' group by date""",
    "timeline_presets": f"""with {ARTICLES}, dated as (select *, strftime(published_at, '%Y-%m-%d') as date from articles)
select 'month' as preset, date, count(*) as count from dated where published_at >= timestamp '2024-01-01' group by date
union all select 'week', date, count(*) from dated where published_at >= timestamp '2024-01-24' group by date
union all select 'clicks', date, count(*) from dated where published_at >= timestamp '2024-01-24' and topic = 'click' group by date""",
    "exported_articles": f"""with {ARTICLES} select id, title, url, publisher_name as publisher, published_date, summary, country, language, topic from articles""",
    "timeline_stored": f"""with {ARTICLES}, dated as (select topic, strftime(published_at, '%Y-%m-%d') as date from articles where id % 7 <> 0)
select 'all topics' as topic, date, count(*) as count from dated where date between '2024-01-05' and '2024-01-25' group by date
union all select topic, date, count(*) from dated group by topic, date""",
    "timeline_all_topics": f"""with {ARTICLES} select topic, strftime(published_at, '%Y-%m-%d') as date, count(*) as count
from articles group by topic, date""",
    "corpus_stats": f"""select (select count(*) from documents) as total_articles, (select count(*) from embeddings) as vector_count,
  '{MODEL}' as embed_model, {DIM}::integer as embed_dim""",
    "brief_block": f"with {_briefs()} select topic, block, article_count, urls from blocks",
    "brief_prompt": f"with {_briefs()} select topic, {_fill(BRIEF_PROMPT, 7)} as prompt from blocks",
    "brief_result": f"""with {_briefs()}, {_TOPICS}
select topic,
  case when article_count is null then 'No articles for ''' || topic || ''' in the last 7 days.'
       when topic <> 'error' then 'About ' || topic || ' "' || first_url || '"' end as summary,
  case when article_count is null then '' when topic in ('click', 'view') then first_url else urls end as citations,
  case when article_count is null then 'neutral' when topic in ('click', 'view') then 'mixed'
       when topic <> 'error' then 'positive' end as sentiment,
  coalesce(article_count, 0) as article_count, topic <> 'error' as reply_ok
from topics left join blocks using (topic)""",
    "sentiment_prompt": f"""with {_ranked(15)}, blocks as (
  select topic, string_agg({_SENTIMENT_LINE}, chr(10) order by place) as block, count(*) as article_count
  from ranked group by topic)
select topic, {_fill(SENTIMENT_PROMPT)} as prompt, article_count from blocks""",
    "topic_alerts": f"""with {FEED}, counts as (select topic, count(*) as articles from feed group by topic),
regs as (select user_id, event_type as topic, count(*)::integer as threshold,
    case user_id % 3 when 1 then 'https://hooks.example.com/' || user_id end as webhook_url
  from events where user_id % 3 <> 0 group by user_id, event_type)
select topic, threshold, webhook_url, max(articles) as articles, count(*) as registrations
from regs join counts using (topic) where articles >= threshold group by topic, threshold, webhook_url""",
    "streamed_ingest": f"""{WITH_ACCEPT} select id, title, url_hash, composite_key, 8::integer as dim
from keyed join accepted using (ord)""",
    "streamed_accepted_alerts": f"""{WITH_ACCEPT},
dated as (select topic, published_at::date as day, ord >= (select max(doc_id) // 2 from documents) as second from keyed join accepted using (ord)),
first as (select max(day) - 2 as closed from dated where not second),
last as (select greatest(max(day) - 2, (select closed from first)) as closed from dated),
days as (select topic, day, count(*) filter (not second or day > first.closed) as articles, count(*) filter (second and day <= first.closed) as late
  from dated, first group by topic, day),
regs as (select event_type as topic, ((count(*) + 9) // 10)::integer as threshold from events group by user_id, event_type)
select topic, strftime(day, '%Y-%m-%d') as date, articles, late,
  (select count(*) from regs where regs.topic = days.topic and threshold <= articles) as alerts
from days where day <= (select closed from last)""",
    "streamed_alerts": """with days as (select event_type as topic, strftime(ts, '%Y-%m-%d') as date, count(*) as articles
  from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 2 day group by topic, date),
regs as (select event_type as topic, ((count(*) + 9) // 10)::integer as threshold from events group by user_id, event_type)
select topic, date, articles, count(*) as alerts, min(threshold) as least from days join regs using (topic) where articles >= threshold group by topic, date, articles""",
    "streamed_daily_counts": """select event_type as topic, strftime(ts, '%Y-%m-%d') as date, count(*) as articles
from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 2 day
group by topic, date""",
}
