"""Publication dates, recency and score blending.

A pattern decides whether a text is one of the accepted forms and rewrites it
as a plain stamp, which is cast without a time zone: no formatter, no dependence on the session's time zone, null for what does not
parse. An offset is accepted and dropped, the wall clock is kept.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from ..config import DECAY_DAYS, RECENCY_WEIGHT

# Names accepted in feed dates, in calendar order.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_GAP = r"[\s\x1c-\x1f\x85\p{Z}]+"
_CLOCK = r"(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d"
_YEAR = r"(?!0000)\d{4}"
_MONTH = r"(?:1[0-2]|0[1-9]|[1-9])"
_DAY = r"(?:3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_HOURS = r"(?:[01]\d|2[0-3])"
_SIXTY = r"[0-5]\d"
_OFFSET = (
    rf"[+-]{_HOURS}(?:{_SIXTY}(?:{_SIXTY}(?:\.\d{{1,6}})?)?|:{_SIXTY}(?::{_SIXTY}(?:\.\d{{1,6}})?)?)"
)

RFC_PATTERN = (
    rf"(?i)^(?:{'|'.join(WEEKDAYS)}),{_GAP}({_DAY}){_GAP}({'|'.join(MONTHS)}){_GAP}({_YEAR})"
    rf"{_GAP}({_CLOCK}){_GAP}(?:gmt|utc)\z"
)
ISO_PATTERN = (
    rf"(?i)^({_YEAR}-{_MONTH}-{_DAY})(?:T({_CLOCK})(?:Z|{_OFFSET})|{_GAP}({_CLOCK}))?\z"
)


def parse_date(text: Column) -> Column:
    """TIMESTAMP_NTZ of a feed date, null when no accepted form matches.

    The weekday must be a weekday name but need not be the right one. The
    expression names ``text`` a few times only, so a filter on the result can
    move below a projection without growing.
    """
    # Three letters per name, so the position gives the month.
    name = F.lower(F.regexp_extract(text, RFC_PATTERN, 2))
    month = ((F.instr(F.lit(" ".join(MONTHS)), name) + 3) / 4).cast("int").cast("string")
    from_rfc = F.concat(
        F.regexp_replace(text, RFC_PATTERN, "$3-"), month, F.regexp_replace(text, RFC_PATTERN, "-$1 $4")
    )
    from_iso = F.regexp_replace(text, ISO_PATTERN, "$1 $2$3")
    plain = F.when(text.rlike(RFC_PATTERN), from_rfc).when(text.rlike(ISO_PATTERN), from_iso)
    return F.replace(plain, F.lit("- "), F.lit("-")).try_cast("timestamp_ntz")


def iso_text(stamp: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a timestamp."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def moment(as_of: str | dt.datetime) -> Column:
    """The explicit "now" of a query, as TIMESTAMP_NTZ."""
    return F.lit(as_of if isinstance(as_of, str) else as_of.isoformat(" ")).cast("timestamp_ntz")


def since_day(as_of: str | dt.datetime, days: int | None) -> str | None:
    """First day (``yyyy-MM-dd``) inside a window of ``days``; None means no cut."""
    if days is None:
        return None
    now = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return (now - dt.timedelta(days=days)).strftime("%Y-%m-%d")


def recency_score(
    published: Column, as_of: str | dt.datetime, decay_days: float = DECAY_DAYS,
    compat: str = "documented",
) -> Column:
    """1.0 for now or later, falling by e every ``decay_days``; 0.5 undated.

    ``compat="observed"`` gives every row 0.5, as happens when stored dates
    are read back in a form that the date reader does not accept.
    """
    if compat == "observed":
        return F.lit(0.5)
    micros = F.timestamp_diff("MICROSECOND", published, moment(as_of))
    age = F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))
    return F.when(published.isNull(), F.lit(0.5)).otherwise(F.exp(-age / F.lit(decay_days)))


def blend(similarity: Column, recency: Column, recency_weight: float = RECENCY_WEIGHT) -> Column:
    return F.lit(1 - recency_weight) * similarity + F.lit(recency_weight) * recency
