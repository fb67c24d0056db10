"""Column expressions in named steps.

A Column that uses an intermediate value five times evaluates it five times,
and nesting multiplies that. Steps keep every intermediate value in a column
of its own: the optimizer leaves such projections apart when a costly value
has several readers, and the generated code computes each once.

The results leave through a one-row ``inline``. A filter on them stays above
it instead of being moved below the steps, where each use would be spelled out
again; filters on all other columns still move down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Step = Callable[[Callable[[str], Column]], dict[str, Column]]


def staged(df: DataFrame, prefix: str, *steps: Step, keep: dict[str, str], sealed: bool = True) -> DataFrame:
    """Run ``steps`` one after another; ``keep`` maps step values to column names.

    Each step gets a lookup of the values so far and returns new ones. An
    unsealed result leaves out the ``inline``, for callers that never filter
    on it.
    """
    names: list[str] = []
    for step in steps:
        values = step(lambda name: F.col(f"{prefix}{name}"))
        names += values
        df = df.withColumns({f"{prefix}{name}": value for name, value in values.items()})
    others = [c for c in df.columns if c not in keep.values() and c not in {f"{prefix}{n}" for n in names}]
    if not sealed:
        return df.select(
            *[F.col(f"`{c}`") for c in others], *[F.col(f"{prefix}{name}").alias(out) for name, out in keep.items()]
        )
    results = F.struct(*[F.col(f"{prefix}{name}").alias(out) for name, out in keep.items()])
    return df.select(*[F.col(f"`{c}`") for c in others], F.inline_outer(F.array(results)))
