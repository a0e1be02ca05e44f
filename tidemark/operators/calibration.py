"""Recalibration of probabilities by past integral transforms, and quantiles at the recalibrated ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Study
from . import bands

CALIBRATED = "symbol string, day_idx int, level int, history long, p_low double, p_high double, z_low double, z_high double"


def past_quantiles(days: list[np.ndarray], probs: list[float], warmup: int) -> list[np.ndarray | None]:
    """For each day, the quantiles of all values of the days before; None within the warm-up or without values.

    The sorted past is merged with a day's values at a time.
    """
    past, out = np.zeros(0), []
    for i, own in enumerate(days):
        out.append(np.quantile(past, probs) if i >= warmup and len(past) else None)
        own = np.sort(own)
        past = np.insert(past, np.searchsorted(past, own), own)
    return out


def calibrated_quantiles(pits: DataFrame, history: DataFrame, model: str, study: Study = DEFAULT, warmup: int = 5, floor: float = 1e-4) -> DataFrame:
    """Quantiles of the law in force at the probabilities that past transforms map the wanted ones to.

    ``pits``: (symbol, day_idx, pit) of ``model``; ``history``: its fits. The first ``warmup`` days of a
    symbol have none. Mapped probabilities are clipped to [floor, 1 - floor] and must rise, as must the
    quantiles; otherwise the day is an error. A symbol's transforms are one task.
    """
    probs = bands.tails(study.levels)
    fits = history.where((F.col("status") == "success") & (F.col("model") == model)).select("symbol", "refit", "params", "center", "spread")
    fits = fits.groupBy("symbol").agg(F.collect_list(F.struct("refit", "params", "center", "spread")).alias("fits"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        from ..functions.families import Fitted

        laws = {f["refit"]: Fitted(model, dict(f["params"]), f["center"], f["spread"], 0, 0.0) for f in own["fits"].iloc[0]}
        groups = sorted(own.groupby("day_idx")["pit"])
        mapped = past_quantiles([g.to_numpy() for _, g in groups], probs, warmup)
        rows, seen = [], 0
        for (day, values), p in zip(groups, mapped):
            law = laws.get((day - study.history_days) // study.refit_days)
            if p is not None and law is not None:
                p = np.clip(p, floor, 1 - floor)
                z = law.ppf(p)
                if (np.diff(p) <= 0).any() or (np.diff(z) <= 0).any():
                    raise ValueError(f"the calibration of day {day} does not rise")
                for c in study.levels:
                    lo, hi = (probs.index(round(x, 12)) for x in ((1 - c) / 2, (1 + c) / 2))
                    rows.append((own["symbol"].iloc[0], day, bands.tag(c), seen, p[lo], p[hi], z[lo], z[hi]))
            seen += len(values)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CALIBRATED.split(", ")])

    return pits.select("symbol", "day_idx", "pit").join(fits, "symbol").groupBy("symbol").applyInPandas(run, CALIBRATED)


def calibrated_pits(pits: DataFrame, study: Study = DEFAULT, warmup: int = 5) -> DataFrame:
    """(symbol, day_idx, pit): rank of each transform among those of all earlier days, (rank + 1/2) / (n + 1)."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        past, out = np.zeros(0), []
        for i, (day, values) in enumerate(sorted(own.groupby("day_idx")["pit"])):
            v = np.sort(values.to_numpy())
            if i >= warmup and len(past):
                out += [(own["symbol"].iloc[0], day, (r + 0.5) / (len(past) + 1)) for r in np.searchsorted(past, v, side="right")]
            past = np.insert(past, np.searchsorted(past, v), v)
        return pd.DataFrame(out, columns=["symbol", "day_idx", "pit"])

    return pits.select("symbol", "day_idx", "pit").groupBy("symbol").applyInPandas(run, "symbol string, day_idx int, pit double")
