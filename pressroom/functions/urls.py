"""Canonical form of article URLs, split with plain string functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from urllib.parse import uses_netloc

from pyspark.sql import Column, DataFrame, functions as F

from .stages import staged
from .text import strip, truthy

_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_PORT = (
    "0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
)


@lru_cache(maxsize=1)
def ipv6_pattern() -> str:
    """All ways to write eight 16-bit groups: in full, with one gap, with a dotted tail."""
    groups = [""] + [_HEX + f"(?::{_HEX}){{{n}}}" for n in range(7)]
    forms = [f"{head}::" for head in groups]
    for tail, need in ((_HEX, 7), (_V4, 6)):
        forms.append(f"(?:{_HEX}:){{{need}}}{tail}")
        forms += [
            f"{groups[before]}::(?:{_HEX}:){{0,{need - before - 1}}}{tail}" for before in range(need)
        ]
    return "(?:" + "|".join(forms) + ")"


@lru_cache(maxsize=1)
def _unsafe_host_chars() -> str:
    """Characters whose compatibility form would smuggle in a URL delimiter."""
    found = [
        chr(cp)
        for cp in range(0x80, 0x110000)
        if not 0xD800 <= cp <= 0xDFFF
        and set(unicodedata.normalize("NFKC", chr(cp))) & set("/?#@:")
    ]
    return "[" + "".join(found) + "]"


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; '' where there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + F.lit(len(mark)))).otherwise(F.lit(""))


def _split_steps(url: Column) -> list:
    """Steps from a URL to scheme, authority, host, port, path and query."""
    return [
        lambda v: {"clean": F.regexp_replace(F.regexp_replace(strip(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")},
        lambda v: {"base": F.substring_index(v("clean"), "#", 1)},
        lambda v: {"main": F.substring_index(v("base"), "?", 1), "query": _after(v("base"), "?")},
        lambda v: {"scheme": F.lower(F.regexp_extract(v("main"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))},
        lambda v: {
            "rest": F.when(v("scheme") != "", F.substr(v("main"), F.length(v("scheme")) + F.lit(2)))
            .otherwise(v("main"))
        },
        lambda v: {"authority": F.regexp_extract(v("rest"), "^//([^/]*)", 1)},
        lambda v: {
            "path": F.when(
                F.startswith(v("rest"), F.lit("//")),
                F.substr(v("rest"), F.length(v("authority")) + F.lit(3)),
            ).otherwise(v("rest")),
            "server": F.substring_index(v("authority"), "@", -1),
        },
        lambda v: {
            "boxed": _after(v("server"), "["),
            "literal": F.substring_index(_after(v("authority"), "["), "]", 1),
        },
        lambda v: {
            "host": F.lower(
                F.when(F.contains(v("server"), F.lit("[")), F.substring_index(v("boxed"), "]", 1))
                .otherwise(F.substring_index(v("server"), ":", 1))
            ),
            "port": _after(
                F.when(F.contains(v("server"), F.lit("[")), _after(v("boxed"), "]"))
                .otherwise(v("server")),
                ":",
            ),
        },
        lambda v: {
            "valid": ((v("port") == "") | v("port").rlike(f"^{_PORT}$"))
            & F.when(
                F.contains(v("authority"), F.lit("[")) | F.contains(v("authority"), F.lit("]")),
                F.contains(v("authority"), F.lit("["))
                & F.contains(v("authority"), F.lit("]"))
                & v("literal").rlike(rf"^(?:{ipv6_pattern()}(?:%[^%]+)?|v[0-9a-fA-F]+\..+)$"),
            ).otherwise(True)
            & F.when(
                F.octet_length(v("authority")) != F.char_length(v("authority")),
                ~v("authority").rlike(_unsafe_host_chars()),
            ).otherwise(True)
        },
    ]


def with_url_parts(df: DataFrame, url: str, parts: dict[str, str]) -> DataFrame:
    """Add chosen parts of a URL column: ``{"host": "new_column", ...}``."""
    return staged(df, "__url_", *_split_steps(F.col(url)), keep=parts)


def with_canonical_url(
    df: DataFrame, url: str, canonical: str = "url_canonical", digest: str | None = None
) -> DataFrame:
    """Add the canonical URL and, on request, its SHA-256 in hex.

    Lower-case scheme and host, no user info, no fragment, a port only when
    it is not zero, no trailing slashes, no empty or ``utm_`` query parts.
    Null or empty input gives ''; a malformed URL (bad port or host) gives
    null in both columns.
    """
    hierarchical = [s for s in uses_netloc if s]
    empty = F.coalesce(F.col(url), F.lit("")) == ""
    steps = _split_steps(F.col(url)) + [
        lambda v: {
            "digits": F.ltrim(v("port"), F.lit("0")),  # a zero port counts as none
            "trimmed": F.coalesce(truthy(F.rtrim(v("path"), F.lit("/"))), F.lit("/")),
            "kept": F.when(v("query") == "", F.lit("")).otherwise(
                F.array_join(
                    F.filter(
                        F.split(v("query"), "&"),
                        lambda part: (part != "") & ~F.startswith(F.lower(part), F.lit("utm_")),
                    ),
                    "&",
                )
            ),
        },
        lambda v: {
            "netloc": F.when(v("digits") != "", F.concat(v("host"), F.lit(":"), v("digits")))
            .otherwise(v("host")),
            "rooted": F.startswith(v("trimmed"), F.lit("/")),
        },
        lambda v: {
            "located": F.when(
                v("netloc") != "",
                F.concat(F.lit("//"), v("netloc"), F.when(v("rooted"), F.lit("")).otherwise(F.lit("/")), v("trimmed")),
            )
            .when(
                F.startswith(v("trimmed"), F.lit("//")) | (v("scheme").isin(hierarchical) & v("rooted")),
                F.concat(F.lit("//"), v("trimmed")),
            )
            .otherwise(v("trimmed"))
        },
        lambda v: {
            "canonical": F.when(empty, F.lit("")).when(
                v("valid"),
                F.concat(
                    F.when(v("scheme") != "", F.concat(v("scheme"), F.lit(":"))).otherwise(F.lit("")),
                    v("located"),
                    F.when(v("kept") != "", F.concat(F.lit("?"), v("kept"))).otherwise(F.lit("")),
                ),
            )
        },
        lambda v: {"digest": F.when(empty, F.lit("")).otherwise(F.sha2(v("canonical"), 256))},
    ]
    keep = {"canonical": canonical} | ({"digest": digest} if digest else {})
    return staged(df, "__url_", *steps, keep=keep)
