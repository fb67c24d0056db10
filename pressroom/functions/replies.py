"""Reading model replies: JSON, perhaps wrapped in a code fence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .stages import staged
from .text import strip

BRIEF_REPLY = "summary STRING, citations ARRAY<STRING>, sentiment STRING"
SENTIMENT_REPLY = "overall STRING, score DOUBLE, rationale STRING"


def reply_body(reply: Column) -> Column:
    """The reply without fence, language tag and surrounding blanks."""
    text = strip(reply)
    inner = F.btrim(text, F.lit("`"))
    untagged = F.when(F.startswith(inner, F.lit("json")), F.substr(inner, F.lit(5))).otherwise(inner)
    return F.when(F.startswith(text, F.lit("```")), strip(untagged)).otherwise(text)


def with_parsed_reply(df: DataFrame, reply: str, schema: str, out: str) -> DataFrame:
    """Add the reply as a struct; null where it is not a JSON object.

    Readers stop at the end of the first value, so text after it would go
    unnoticed. Inside a list or an object such text breaks the enclosing JSON.
    """
    return staged(
        df,
        "__reply_",
        lambda v: {"body": reply_body(F.col(reply))},
        lambda v: {
            "listed": F.try_parse_json(F.concat(F.lit("["), v("body"), F.lit("]"))),
            "held": F.try_parse_json(F.concat(F.lit('{"reply":'), v("body"), F.lit("}"))),
        },
        lambda v: {
            "struct": F.when(
                F.startswith(
                    F.schema_of_variant(F.try_variant_get(v("held"), "$.reply", "variant")), F.lit("OBJECT")
                )
                & v("listed").isNotNull()
                & F.try_variant_get(v("listed"), "$[1]", "variant").isNull(),
                F.from_json(v("body"), schema),
            )
        },
        keep={"struct": out},
    )


def has_field(reply: Column, name: str) -> Column:
    """True where the reply object carries the field, even with null."""
    keys = F.json_object_keys(reply_body(reply))
    return F.coalesce(F.array_contains(keys, name), F.lit(False))
