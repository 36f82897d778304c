"""Loan rows on their way into training and scoring: through the snapshot store, with the feed rules watched.

A store folder holds ``mature`` (permanent, labelled) and ``open`` (for scoring, by
build time). Both flows read the source for snapshots only that the store does
not hold yet. Broken feed rules are logged; ``strict`` makes them an error.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maturity as E
from ..operators.feed_checks import feed_violations, raise_if_any
from ..sources import store as S

log = logging.getLogger(__name__)


def training_loans(loans: DataFrame, ledger: DataFrame, path: str, strict: bool = False) -> DataFrame:
    """Labelled rows of all finalised snapshots, from the store; new ones are stored first."""
    folder = f"{path.rstrip('/')}/mature"
    new = S.store_mature(loans, ledger, folder, strict)
    log.info("%d snapshot(s) newly stored: %s", len(new), new)
    final = [int(r[0]) for r in ledger.select("SNAPSHOT_DATE").distinct().collect()]         # months
    return S.read_store(loans.sparkSession, folder, final)


def scoring_loans(loans: DataFrame, ledger: DataFrame, build_times: DataFrame, path: str,
                  snapshots: list[int] | None = None, strict: bool = False) -> DataFrame:
    """Rows to score (named snapshots, else all open ones), from the store; new and rebuilt ones are stored first."""
    folder = f"{path.rstrip('/')}/open"
    wanted = [int(r[0]) for r in E.snapshots_to_score(loans, ledger, snapshots).collect()]   # months
    S.store_open(loans.where(F.col("SNAPSHOT_DATE").isin(wanted)), build_times, folder, ledger, strict)
    return S.read_store(loans.sparkSession, folder, wanted)


def checked(loans: DataFrame, ledger: DataFrame, strict: bool = False) -> DataFrame:
    """The rows as they are, after one scan with all feed rules: for runs without a store."""
    found = feed_violations(loans, ledger, by_snapshot=True).collect()                       # a row for each rule and month
    for r in found:
        log.warning("snapshot %s: %s: %s (%s row(s))", r["snapshot_date"], r["rule"], r["detail"], r["n_bad"])
    if strict and found:
        raise_if_any(loans.sparkSession.createDataFrame(found))
    return loans
