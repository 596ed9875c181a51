"""Outcomes of output rows and the accounting cells that they fall into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cell of each outcome of a row that has no score.
CELLS = {
    "cancellation": "missing",
    "zero-evidence": "missing",
    "infrastructure": "failed",
    "semantic-rejection": "invalid",
    "empty-output": "invalid",
    "empty-candidate-set": "invalid",
    "token-limit-truncation": "invalid",
    "vanished-published-evidence": "missing",
    "crash": "failed",
    "abandonment": "failed",
}


def failure_outcome(code: Column) -> Column:
    """A failed row's outcome by its code; whatever isn't named is infrastructure."""
    return F.when(code == "provider-rejection", "semantic-rejection").when(code == "blank-provider-generation", "empty-output").otherwise("infrastructure")


def outcome() -> Column:
    """The outcome of a row with missing, failed, invalid, failure_code, score; `scored` where it has a score."""
    return (
        F.when(F.col("missing"), "vanished-published-evidence").when(F.col("failed"), failure_outcome(F.col("failure_code")))
        .when(F.col("invalid"), "token-limit-truncation").when(F.col("score").isNull(), "infrastructure").otherwise("scored")
    )


def cell(of: Column) -> Column:
    """The accounting cell of an outcome, null for an unknown one."""
    return F.when(of == "scored", "scored").otherwise(F.create_map(*(F.lit(x) for pair in CELLS.items() for x in pair))[of])
