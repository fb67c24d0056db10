"""Character folding as JVM-side ``translate`` tables.

Compatibility decomposition works character by character as far as ASCII
letters are concerned, so its ASCII remainder can be tabled: most characters
leave one ASCII character or none, a few leave several (ligatures, fractions,
squared units). The tables are derived from ``unicodedata`` when first used;
rows never cross to Python workers.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

_PAIR, _ITEM = "", ""  # private-use separators, in no decomposition


def _code_points():
    for cp in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= cp <= 0xDFFF:
            yield chr(cp)


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    source, target, several = [], [], {}
    for ch in _code_points():
        if unicodedata.is_normalized("NFKD", ch):
            continue
        left = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(left) == 1:
            source.append(ch)
            target.append(left)
        elif left:
            several[ch] = left
    return "".join(source), "".join(target), several


@lru_cache(maxsize=1)
def _search_table() -> tuple[str, str]:
    """Fold table of the keyword index.

    A letter that is one ASCII letter plus one mark becomes that letter, and
    those marks vanish when they stand alone. Letters with two or more marks
    stay, as they do in the full-text index whose ranking we reproduce.
    """
    source, target, marks = [], [], set()
    for ch in _code_points():
        folded = ch.casefold() if len(ch.casefold()) == 1 else ch
        parts = unicodedata.normalize("NFD", folded)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            marks.add(parts[1])
            folded = parts[0].lower()
        plain = ch.lower()
        if (folded != ch and folded != plain) or ch == "Σ":
            source.append(ch)
            target.append(folded)
    return "".join(source) + "".join(sorted(marks)), "".join(target)


def _has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.char_length(text)


def ascii_fold(text: Column) -> Column:
    """NFKD, then drop everything outside ASCII. Null stays null."""
    source, target, several = _ascii_tables()
    pairs = _ITEM.join(f"{k}{_PAIR}{v}" for k, v in several.items())
    lookup = F.str_to_map(F.lit(pairs), F.lit(_ITEM), F.lit(_PAIR))
    unpacked = F.when(
        # A translate is a hash lookup per character; a character class of
        # this size would try its members one after another.
        F.translate(text, "".join(several), "") != text,
        F.array_join(
            F.transform(
                F.split(text, ""),
                lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.coalesce(F.element_at(lookup, c), c)),
            ),
            "",
        ),
    ).otherwise(text)
    folded = F.regexp_replace(F.translate(unpacked, source, target), r"[^\x00-\x7F]", "")
    return F.when(_has_non_ascii(text), folded).otherwise(text)


def search_fold(text: Column) -> Column:
    """Lower case without simple diacritics, for the keyword index."""
    source, target = _search_table()
    return F.lower(F.when(_has_non_ascii(text), F.translate(text, source, target)).otherwise(text))
