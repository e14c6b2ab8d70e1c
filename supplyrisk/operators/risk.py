"""Risk scores, bands, the current state and the gradient-boosted model."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.functions.scalar import RISK_BANDS, risk_level

KEYS = ("facility_id", "product_id")


def formula_score(dos: str = "days_of_supply") -> Column:
    """Deterministic score ``1/(1+dos)`` rounded half-up to 4 places.

    Used where results must be reproducible across engines (evaluation
    and report tests); the trained model supplies ``risk_score`` otherwise.
    """
    return F.floor(F.lit(1e4) / (F.lit(1.0) + F.col(dos)) + F.lit(0.5)) / F.lit(1e4)


def with_level(df: DataFrame, score: str = "risk_score", out: str = "risk_level",
               bands=RISK_BANDS) -> DataFrame:
    return df.withColumn(out, risk_level(score, bands))


def current_state(df: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "snapshot_date",
                  cols: Sequence[str] | None = None) -> DataFrame:
    """Latest state per key: for *each column* its last non-NULL value by date.

    One grouped aggregate of filtered ``max_by``; on a panel already
    partitioned by the keys it adds no shuffle.
    """
    cols = [c for c in (cols or df.columns) if c not in keys]
    aggs = []
    for c in cols:
        order = F.col(date_col) if c == date_col else F.when(F.col(c).isNotNull(), F.col(date_col))
        aggs.append(F.max_by(F.col(c), order).alias(c))
    return df.groupBy(*keys).agg(*aggs)


IMPUTE_COLUMNS = ["avg_supplier_reliability", "avg_delay_days", "fulfillment_rate"]


def impute_median(df: DataFrame, cols: Sequence[str] = IMPUTE_COLUMNS, exact: bool = True,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the column median (NULLs skipped).

    ``exact`` uses a distributed exact quantile; otherwise
    ``percentile_approx``.  ``fit_on`` takes the medians from another frame
    (e.g. the training split only, which avoids test leakage).
    """
    from supplyrisk.functions.stats import exact_quantiles

    src = fit_on if fit_on is not None else df
    if exact:
        meds = exact_quantiles(src, cols, 0.5)
    else:
        meds = {c: src.select(F.percentile_approx(c, 0.5, 100000)).scalar() for c in cols}
    return df.withColumns({c: F.coalesce(F.col(c), meds[c]) for c in cols})


# ---- user-facing names -------------------------------------------

def current(df: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "snapshot_date") -> DataFrame:
    """Latest state per key (last non-NULL value of each column)."""
    return current_state(df, keys, date_col)


def level(df: DataFrame, score: str = "risk_score", out: str = "risk_level") -> DataFrame:
    """Add the Low / Medium / High band of ``score``."""
    return with_level(df, score, out)


def train(df: DataFrame, **kwargs):
    """Fit the gradient-boosted stockout model (``operators.model.train``)."""
    from supplyrisk.operators import model
    return model.train(df, **kwargs)


def score(model_, df: DataFrame, **kwargs) -> DataFrame:
    """Positive-class probability as ``risk_score`` (``operators.model.score``)."""
    from supplyrisk.operators import model
    return model.score(model_, df, **kwargs)
