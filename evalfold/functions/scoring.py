"""Scoring functions as vectorised Python: the extension point for metrics that columns can't express."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A column function (output, gold) -> struct(score, failed) from a function on pandas series.

    A null or non-finite score marks the row as failed; scores are never rounded here.
    """

    def run(output: pd.Series, gold: pd.Series) -> pd.DataFrame:
        s = pd.to_numeric(score(output.fillna(""), gold.fillna("")), errors="coerce").astype(float)
        s = s.where(s.abs() < float("inf"))
        return pd.DataFrame({"score": s, "failed": s.isna()})

    return F.pandas_udf(run, "score double, failed boolean")
