"""Title, publisher and article-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fold import ascii_fold, search_fold

# White space of ASCII text: Java's \s lacks the four separator controls.
_BLANK = r"[\s\x1c-\x1f]"
# White space of any text (strip() before a URL is read, around a prompt).
_ANY_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def truthy(text: Column) -> Column:
    """Null for an empty string: both count as absent."""
    return F.nullif(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_ANY_BLANK}+|{_ANY_BLANK}+$", "")


def _plain(text: Column) -> Column:
    lowered = F.lower(ascii_fold(F.coalesce(text, F.lit(""))))
    trimmed = F.regexp_replace(lowered, f"^{_BLANK}+|{_BLANK}+$", "")
    return F.regexp_replace(trimmed, f"{_BLANK}+", " ")


def title_slug(title: Column) -> Column:
    """ASCII words joined by dashes; punctuation is dropped, null gives ''."""
    dashed = F.regexp_replace(F.replace(_plain(title), F.lit(" "), F.lit("-")), "[^a-z0-9-]+", "")
    return F.btrim(F.regexp_replace(dashed, "-{2,}", "-"), F.lit("-"))


def publisher_norm(publisher: Column) -> Column:
    """Lower-case ASCII name with single blanks; nothing left gives 'unknown'."""
    return F.coalesce(truthy(_plain(publisher)), F.lit("unknown"))


def composite_key(
    title: Column, publisher: Column, url_hash: Column | None = None, empty_slug: str = "keep"
) -> Column:
    """Dedup key: SHA-256 of ``slug|publisher``.

    Titles without a single ASCII letter or digit have an empty slug, so all
    of one publisher's such titles share a key. ``empty_slug="url"`` puts the
    URL hash in place of the empty slug instead.
    """
    return key_of(title_slug(title), publisher_norm(publisher), url_hash, empty_slug)


def key_of(
    slug: Column, publisher: Column, url_hash: Column | None = None, empty_slug: str = "keep"
) -> Column:
    if empty_slug == "url" and url_hash is not None:
        slug = F.coalesce(truthy(slug), F.concat(F.lit("url:"), url_hash))
    return F.sha2(F.concat_ws("|", slug, publisher), 256)


def context_header(topic: Column, publisher: Column, date: Column, country: Column) -> Column:
    """One bracketed line naming topic, publisher, date and country."""
    place = F.coalesce(F.concat(F.lit(" | "), truthy(country)), F.lit(""))
    return F.concat(
        F.lit("[Topic: "), F.coalesce(truthy(topic), F.lit("general")),
        F.lit(" | Publisher: "), F.coalesce(truthy(publisher), F.lit("unknown publisher")),
        F.lit(" | Date: "), F.coalesce(truthy(date), F.lit("unknown date")),
        place, F.lit("]"),
    )


def enriched_text(
    topic: Column, publisher: Column, date: Column, country: Column,
    title: Column, summary: Column, full_text: Column,
) -> Column:
    """What the embedder reads: header, title and body, one per line."""
    body = F.coalesce(truthy(full_text), summary, F.lit(""))
    header = context_header(topic, publisher, date, country)
    return strip(F.concat_ws("\n", header, F.coalesce(title, F.lit("")), body))


def words(text: Column) -> Column:
    """Index tokens of a text, in order; null text has none."""
    return F.regexp_extract_all(
        F.coalesce(search_fold(text), F.lit("")), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)
    )
