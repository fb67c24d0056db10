"""DuckDB SQL for the queries that use the computed models: hashed words and word log-odds."""

from __future__ import annotations

from ..operators.brief import BRIEF_PROMPT, SENTIMENT_PROMPT
from ..sources.derived import AS_OF, DIM, SEARCH_AS_OF
from .oracle import _BRIEF_LINE, _RECENCY, _SENTIMENT_LINE, _TOPICS, _WORDS, ARTICLES, _fill, _ranked

# Word log-odds of toxic documents against others, as the scorer of prompts.
WEIGHTS = f"""labelled as (select toxic as label, list_distinct({_WORDS.format('text')}) as ws from documents join labels using (doc_id) where toxic in (0, 1)),
sums as (select sum(label) as ones, count(*) as every from labelled),
seen as (select word, sum(label) as one, count(*) as texts_with from (select label, unnest(ws) as word from labelled) group by word having count(*) >= 5),
weights as (select word, ln((one + 1) / (ones + 2)) - ln((texts_with - one + 1) / (every - ones + 2)) as weight from seen, sums)"""


def _verdicts(by: str, ranked: str, prompt: str = SENTIMENT_PROMPT, days: int | None = None, line: str = _SENTIMENT_LINE, p: str = "") -> str:
    """Verdicts on the rows of CTE ``ranked`` (…, place), grouped by ``by``; ``p`` is put before the names of the CTEs."""
    return f"""
{p}blocks as (select {by}, string_agg({line}, chr(10) order by place) as block, string_agg(url, ' ' order by place) as urls, count(*) as article_count
  from {ranked} group by {by}),
{p}prompts as (select *, {_fill(prompt, days)} as prompt from {p}blocks),
{p}means as (select {by}, avg(weight) as mean, count(*) as known from (select {by}, unnest({_WORDS.format('block')}) as word from {p}prompts)
  join weights using (word) group by {by}),
{p}scores as (select q.*, coalesce(known, 0) as n, round(-tanh(coalesce(mean, 0)), 3) as score from {p}prompts q left join {p}means using ({by})),
{p}verdicts as (select *, case when score > 0.1 then 'positive' when score < -0.1 then 'negative' else 'neutral' end as overall,
  n || ' known words' as rationale from {p}scores)"""


def _hashed(texts: str, dim: int) -> str:
    """Signed feature hashing of the words of CTE ``texts`` (key, t) to unit vectors of floats (key, v)."""
    return f"""
select key, list_transform(raw, lambda x: (x / sqrt(list_sum(list_transform(raw, lambda y: y * y))))::float::double) as v from (
  select key, list_transform(range(0, {dim}), lambda i: coalesce(list_sum(list_transform(list_filter(e, lambda z: z.b = i), lambda z: z.s)), 0)::double) as raw from (
    select key, list({{'b': b, 's': s}}) as e from (
      select key, b, sum(s) as s from (
        select key, ('0x' || h[1:8])::bigint % {dim} as b, case when h[9] < '8' then 1 else -1 end as s from (
          select key, md5(unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'))) as h from {texts})) group by key, b) group by key))"""


_TEXT = r"""regexp_replace('[Topic: ' || topic || ' | Publisher: ' || publisher_name || ' | Date: ' || published_date || ' | ' || country || ']' || chr(10) ||
  title || chr(10) || summary, '^\s+|\s+$', '', 'g')"""


def _embedded(dim: int = DIM) -> str:
    return ARTICLES + f""",
texts as (select id as key, {_TEXT} as t from articles),
emb as materialized ({_hashed('texts', dim)})"""


def _searched(queries: str, since: str, limit: int, place: str = "true", topic: str = "key") -> str:
    """CTE ``ranked`` (topic, place, score, article columns) for queries (key, t)."""
    recency = _RECENCY.replace(SEARCH_AS_OF, AS_OF)
    return _embedded() + f""",
queries as ({queries}),
qemb as materialized ({_hashed('queries', DIM)}),
pairs as (select q.key as key, a.id, list_cosine_similarity(e.v, q.v) as s from qemb q, emb e join articles a on a.id = e.key where {place}),
near as (select *, row_number() over (partition by key order by s desc, id) as n from pairs qualify n <= {3 * limit}),
rescored as (select key, a.* replace ({topic} as topic), s, (1 - 0.3::double) * s + 0.3::double * {recency} as score
  from near join articles a using (id) where published_at >= timestamp '{since}'),
ranked as (select *, row_number() over (partition by key order by score desc, s desc, id) as place from rescored qualify place <= {limit})"""


_BY_TOPIC = "select topic as key, topic as t from (select distinct unnest([event_type, upper(event_type)]) as topic from events)"
_HITS = " select id, title, round(score, 6) as score, 'semantic' as search_mode from ranked"
_SENTIMENT = """
select topic, coalesce(overall, 'neutral') as overall, coalesce(score, 0.0) as score, coalesce(rationale, 'no articles') as rationale,
  coalesce(article_count, 0) as article_count, true as reply_ok from topics left join verdicts using (topic)"""

ORACLE: dict[str, str] = {
    "hash_embedding": f"with {_embedded(8)} select id, publisher_name as publisher, 8::integer as embed_dim, "
                      + ", ".join(f"round(v[{i + 1}], 6) as e{i}" for i in range(8)) + " from emb join articles on id = key",
    "search_text": "with " + _searched("select 1 as key, 'Tion of the erble, 2024!' as t", "2024-01-11", 10, "language = 'en'", "topic") + _HITS,
    "search_news": "with " + _searched("select 1 as key, 'Click and view' as t", "2024-01-24", 10, "language = 'en' and country = 'US'", "topic") + _HITS,
    "brief_from_search": f"""with {_searched(_BY_TOPIC, '2024-01-24', 20)}, {_TOPICS}, {WEIGHTS}, {_verdicts('topic', 'ranked', BRIEF_PROMPT, 7, _BRIEF_LINE)}
select topic, case when article_count is null then 'No articles for ''' || topic || ''' in the last 7 days.'
    else 'Reports on ' || topic || ': ' || rationale end as summary,
  coalesce(urls, '') as citations, coalesce(overall, 'neutral') as sentiment, coalesce(article_count, 0) as article_count, true as reply_ok
from topics left join verdicts using (topic)""",
    "sentiment_from_search": f"with {_searched(_BY_TOPIC, '2024-01-17', 15)}, {_TOPICS}, {WEIGHTS}, {_verdicts('topic', 'ranked')} {_SENTIMENT}",
    "sentiment_timeline_full": f"""with {_searched(_BY_TOPIC, '2024-01-24', 15)}, {_TOPICS}, {WEIGHTS}, {_verdicts('topic', 'ranked')},
dated as (select *, strftime(published_at, '%Y-%m-%d') as date from ranked), {_verdicts('topic, date', 'dated', p='day_')},
days as (select topic, string_agg(date || ' ' || overall || ' ' || printf('%.3f', score) || ' ' || article_count, '; ' order by date) as timeline
  from day_verdicts group by topic)
select topic, coalesce(overall, 'neutral') as label, coalesce(score, 0.0) as score, coalesce(timeline, '') as timeline, coalesce(article_count, 0) as article_count
from topics left join verdicts using (topic) left join days using (topic)""",
    "sentiment_overall": f"with {_ranked(15)}, {_TOPICS}, {WEIGHTS}, {_verdicts('topic', 'ranked')} {_SENTIMENT}",
    "sentiment_timeline": f"""with {ARTICLES}, dated as (select *, strftime(published_at, '%Y-%m-%d') as date,
    row_number() over (partition by topic, strftime(published_at, '%Y-%m-%d') order by published_at desc, id) as place from articles qualify place <= 15),
{WEIGHTS}, {_verdicts('topic, date', 'dated')} select topic, date, overall, score, rationale, article_count from verdicts""",
}
