"""Deterministic stand-ins for models, for tests only."""

from pyspark.sql import Column, DataFrame, functions as F

from pressroom.errors import EmbeddingMismatch


def hash_embedding(text: Column, dim: int = 8) -> Column:
    """Deterministic stand-in model: leading SHA-256 bytes, scaled to length one.

    Pure expressions, up to 32 dimensions; for tests and dry runs.
    """
    if not 1 <= dim <= 32:
        raise EmbeddingMismatch("a SHA-256 digest gives 1 to 32 dimensions")
    # One-element lists bind the digest and the bytes, so each is computed once.
    def raw_bytes(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0,
        )

    raw = F.element_at(F.transform(F.array(F.sha2(text, 256)), raw_bytes), 1)
    return F.element_at(F.transform(F.array(raw), _to_unit), 1).cast("array<float>")


def _to_unit(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)

    def scaled(square: Column) -> Column:
        norm = F.when(square == 0.0, F.lit(1.0)).otherwise(F.sqrt(square))
        return F.transform(vector, lambda x: x / norm)

    return F.element_at(F.transform(F.array(squares), scaled), 1)


def scripted_scorer(prompts: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model: a verdict drawn from the prompt's hash."""
    byte = F.conv(F.substring(F.sha2("prompt", 256), 1, 2), 16, 10).cast("int")
    score = F.round(byte / 127.5 - 1, 2)
    verdict = F.when(score > 0.25, "positive").when(score < -0.25, "negative").otherwise("neutral")
    reply = F.to_json(F.struct(
        verdict.alias("overall"), score.alias("score"),
        F.concat(F.lit("scripted "), F.substring(F.sha2("prompt", 256), 1, 8)).alias("rationale"),
        F.concat(F.lit("Scripted brief "), F.substring(F.sha2("prompt", 256), 1, 8)).alias("summary"),
        verdict.alias("sentiment"),
    ))
    return prompts.withColumn("reply", reply)
