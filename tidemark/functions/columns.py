"""The laws as functions of columns: scalar, aggregate and table functions over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import special as sp

MODEL_QUANTILES = "model string, place int, probability double, quantile double"


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function; null stays null."""
    return pd.Series(sp.normal_cdf(x.to_numpy(float)), index=x.index).where(x.notna())


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    """Its inverse; null outside (0, 1)."""
    inside = (p > 0) & (p < 1)
    return pd.Series(sp.normal_ppf(p.where(inside, 0.5).to_numpy(float)), index=p.index).where(inside)


def law_column(kind: str):
    """``f(model, params, center, spread, x)``: cdf, ppf or logpdf of a fitted law at x, a law a row."""
    if kind not in ("cdf", "ppf", "logpdf"):
        raise ValueError(f"unknown function {kind!r}")

    @F.pandas_udf(T.DoubleType())
    def found(model: pd.Series, params: pd.Series, center: pd.Series, spread: pd.Series, x: pd.Series) -> pd.Series:
        from .families import Fitted

        out = pd.Series(float("nan"), index=x.index)
        keys = pd.Series([(m, tuple(sorted(dict(p).items())), c, s) if p is not None else None for m, p, c, s in zip(model, params, center, spread)], index=x.index)
        for key, at in keys.dropna().groupby(keys.dropna()).groups.items():
            m, p, c, s = key
            out[at] = getattr(Fitted(m, dict(p), c, s, 0, 0.0), kind)(x[at].to_numpy(float))
        return out.where(x.notna())

    return found


@F.pandas_udf(T.DoubleType())
def excess_kurtosis(z: pd.Series) -> float:
    """Grouped aggregate: fourth standardized moment less 3; null without variance."""
    u = z.dropna().to_numpy(float)
    v = u.var() if len(u) else 0.0
    return float(((u - u.mean()) ** 4).mean() / v**2 - 3) if v > 0 else None


@F.udtf(returnType=MODEL_QUANTILES)
class LawQuantiles:
    """Table function: a law (model, params, center, spread) to a row for each probability."""

    def eval(self, model: str, params: dict, center: float, spread: float, probs: list):
        from .families import Fitted

        law = Fitted(model, dict(params), center, spread, 0, 0.0)
        for i, (p, q) in enumerate(zip(probs, law.ppf(list(probs)))):
            yield model, i, float(p), float(q)
