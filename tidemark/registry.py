"""Registry of the engine's queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from .plans import records, reports, studies

QUERIES: dict = {**reports.QUERIES, **records.QUERIES, **studies.QUERIES}
ORACLES: dict[str, str] = {**reports.ORACLES, **records.ORACLES, **studies.ORACLES}
