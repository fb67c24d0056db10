"""URL filter: domain rules, then a weighted vocabulary found by Aho-Corasick.

One automaton holds all terms, so a URL is read once however many there are. A
hit counts if the characters on both sides are no ASCII letters or digits. One
strict term rejects; soft terms reject when the weights of distinct ones reach
``threshold``. The vocabulary and the rules are parameters of a job, not data:
they are as long as a person writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Terms that make a URL unwanted alone (strict) or together (soft, with weights).
STRICT = ("porn", "porno", "xxx", "hentai", "milf", "camgirl", "camgirls", "sexcam", "sexcams", "nsfw", "onlyfans", "xvideos", "gangbang", "warez")
SOFT = {"adult": 1, "casino": 1, "cams": 1, "dating": 1, "escort": 1, "escorts": 1, "fetish": 1, "gambling": 1, "hookup": 1, "lingerie": 1, "nude": 1,
        "nudes": 1, "poker": 1, "roulette": 1, "sex": 1, "sexy": 1, "slots": 1, "torrent": 1, "viagra": 1, "cialis": 1}
THRESHOLD = 2

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    there = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOW)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits. Rules are (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def scan(automaton: ahocorasick.Automaton, url: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of a lower-cased URL."""
    strict: set[str] = set()
    soft: set[str] = set()
    for end, (term, hard) in automaton.iter(url):
        start = end - len(term)
        before, after = url[start] if start >= 0 else " ", url[end + 1] if end + 1 < len(url) else " "
        if not (before.isascii() and before.isalnum() or after.isascii() and after.isalnum()):
            (strict if hard else soft).add(term)
    return strict, soft


def build(strict: tuple[str, ...], soft: dict[str, int]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in soft:
        automaton.add_word(term, (term, False))
    for term in strict:
        automaton.add_word(term, (term, True))
    automaton.make_automaton()
    return automaton


def judge(pages: DataFrame, rules: list[tuple[str, str]], strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, strict and soft hits, weight, verdict.

    A rule decides before the vocabulary. A null or empty URL has no hits and is allowed unless a rule says otherwise.
    """
    soft = SOFT if soft is None else soft

    @F.pandas_udf("strict_hits array<string>, soft_hits array<string>, weight int")
    def terms(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build(strict, soft)
        for some in urls:
            found = [scan(automaton, u) for u in some]
            yield pd.DataFrame({"strict_hits": [sorted(a) for a, _ in found], "soft_hits": [sorted(b) for _, b in found],
                                "weight": [sum(soft[t] for t in b) for _, b in found]})

    rows = pages.select("page_id", "url").withColumn("hits", terms(F.translate(F.coalesce("url", F.lit("")), UPPER, LOW)))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    bad = (F.size("hits.strict_hits") > 0) | (F.col("hits.weight") >= threshold)
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
                       "hits.strict_hits", "hits.soft_hits", "hits.weight")
