"""Which snapshots have final labels, and how they split into roles and folds.

A snapshot is mature when the ledger has a row for it; there is no calendar
rule. Everything here works on the list of snapshots, whose length is the
number of months in the data, and is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import customer_bucket, months_apart
from ..session import small_side
from . import ranking


def mature_snapshots(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    """Snapshots with a ledger row."""
    return snapshots.select("SNAPSHOT_DATE").distinct().join(
        ledger.select("SNAPSHOT_DATE"), "SNAPSHOT_DATE", "left_semi")


def open_snapshots(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    """Snapshots without a ledger row."""
    return snapshots.select("SNAPSHOT_DATE").distinct().join(
        ledger.select("SNAPSHOT_DATE"), "SNAPSHOT_DATE", "left_anti")


def with_label_status(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    """LABEL_STATUS of every snapshot; NULL while it is open."""
    return snapshots.join(ledger.select("SNAPSHOT_DATE", F.col("STATUS").alias("LABEL_STATUS")),
                          "SNAPSHOT_DATE", "left")


def mature_rows(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of mature snapshots. The few ledger dates go in as literals, so a
    table partitioned by snapshot is pruned before anything is read."""
    dates = [r[0] for r in ledger.select("SNAPSHOT_DATE").distinct().collect()]  # one per month
    return df.where(F.col("SNAPSHOT_DATE").isin(dates))


def train_window(snapshots: DataFrame, n: int | None) -> DataFrame:
    """n > 0 keeps the newest n, n < 0 the oldest |n|, nothing set keeps all."""
    if not n:
        return snapshots
    col = F.col("SNAPSHOT_DATE")
    return snapshots.orderBy(col.desc() if n > 0 else col.asc()).limit(abs(n))


def snapshots_to_score(available: DataFrame, ledger: DataFrame,
                       requested: list[int] | None = None) -> DataFrame:
    """Requested snapshots that exist; else all open ones; else the newest."""
    avail = available.select("SNAPSHOT_DATE").distinct()
    if requested:
        found = avail.where(F.col("SNAPSHOT_DATE").isin([int(s) for s in requested]))
        if not found.isEmpty():
            return found
    still_open = open_snapshots(avail, ledger)
    if not still_open.isEmpty():
        return still_open
    return avail.orderBy(F.col("SNAPSHOT_DATE").desc()).limit(1)


def _snapshot_array(snapshots: DataFrame) -> DataFrame:
    """One row holding the sorted list of snapshots (one number per month)."""
    return snapshots.agg(F.sort_array(F.collect_set("SNAPSHOT_DATE")).alias("s"))


def _windowed(train: Column, n: int | None) -> Column:
    if not n:
        return train
    if n > 0:
        return F.slice(train, F.greatest(F.size(train) - n + 1, F.lit(1)), F.lit(n))
    return F.slice(train, F.lit(1), F.lit(-n))


def static_roles(mature: DataFrame, val_mode: str = "customer",
                 window: int | None = None) -> DataFrame:
    """Role of every mature snapshot: train, val, test, gap or unused.

    test is the newest; train keeps a full label horizon before the test (or,
    with val_mode="temporal", before val = the second newest). With one
    snapshot all is train, with two the newest is test.
    """
    if val_mode not in ("customer", "temporal", "none"):
        raise ValueError(f"unknown val_mode {val_mode!r}")
    one = _snapshot_array(mature).withColumn("n", F.size("s"))
    s = F.col("s")
    newest, second = F.element_at(s, -1), F.try_element_at(s, F.lit(-2))
    temporal = val_mode == "temporal"
    anchor = second if temporal else newest
    older = F.filter(s, lambda x: (x < anchor))
    eligible = F.filter(older, lambda x: months_apart(x, anchor) >= C.LABEL_MONTHS)
    train = (F.when(F.col("n") == 1, s)
             .when(F.col("n") == 2, F.slice(s, 1, 1)).otherwise(eligible))
    one = one.select(s, "n", _windowed(train, window).alias("train"), train.alias("fit"),
                     newest.alias("newest"), second.alias("second"))
    x = F.col("SNAPSHOT_DATE")
    role = F.when(F.array_contains("train", x), "train")
    role = role.when((F.col("n") >= 2) & (x == F.col("newest")), "test")
    if temporal:
        role = role.when((F.col("n") >= 3) & (x == F.col("second")), "val")
    role = role.when(F.array_contains("fit", x), "unused").otherwise("gap")
    return one.withColumn("SNAPSHOT_DATE", F.explode("s")).select("SNAPSHOT_DATE", role.alias("ROLE"))


def final_roles(mature: DataFrame) -> DataFrame:
    """Deployment fit: every mature snapshot trains, none is held out."""
    return mature.select("SNAPSHOT_DATE", F.lit("train").alias("ROLE"))


def in_validation(code: Column, fraction: float = C.CUSTOMER_VAL_FRACTION,
                  seed: int = C.SEED) -> Column:
    """Whether a customer is held out: all rows of a customer share a side."""
    return customer_bucket(code, seed) < fraction


def split_rows(df: DataFrame, roles: DataFrame, customer_holdout: bool = True,
               fraction: float = C.CUSTOMER_VAL_FRACTION, seed: int = C.SEED) -> DataFrame:
    """Rows with SPLIT = train, val or test; rows in the gap are left out."""
    roles = small_side(roles.where(F.col("ROLE").isin("train", "val", "test")))
    split = F.col("ROLE")
    if customer_holdout:
        split = F.when((F.col("ROLE") == "train")
                       & in_validation(F.col("NATIONAL_CODE"), fraction, seed), "val").otherwise(split)
    return df.join(roles, "SNAPSHOT_DATE").withColumn("SPLIT", split).drop("ROLE")


def walk_forward_folds(mature: DataFrame, min_train: int = C.MIN_TRAIN_SNAPSHOTS,
                       window: int | None = None) -> DataFrame:
    """Every (val, test) pair with a full horizon between them and enough
    training snapshots a full horizon before val, in (test, val) order.

    Built inside one row from the snapshot list with array functions; fewer
    than three snapshots give no folds.
    """
    one = _snapshot_array(mature).where(F.size("s") >= 3)
    s = F.col("s")

    def before(limit):
        return F.filter(s, lambda t: (t < limit) & (months_apart(t, limit) >= C.LABEL_MONTHS))

    pairs = F.flatten(F.transform(s, lambda test: F.transform(
        before(test), lambda val: F.struct(test.alias("TEST_SNAP"), val.alias("VAL_SNAP"),
                                           _windowed(before(val), window).alias("TRAIN_SNAPS")))))
    folds = F.filter(pairs, lambda f: F.size(f["TRAIN_SNAPS"]) >= min_train)
    return one.select(F.posexplode(folds).alias("i", "f")).select(
        (F.col("i") + 1).alias("FOLD_ID"), "f.*")


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with FOLD_ID and SPLIT, all folds in one pass (val is a whole
    snapshot and shares customers with train)."""
    roles = folds.select("FOLD_ID", F.explode(F.concat(
        F.transform("TRAIN_SNAPS", lambda x: F.struct(x.alias("SNAPSHOT_DATE"),
                                                      F.lit("train").alias("SPLIT"))),
        F.array(F.struct(F.col("VAL_SNAP").alias("SNAPSHOT_DATE"), F.lit("val").alias("SPLIT")),
                F.struct(F.col("TEST_SNAP").alias("SNAPSHOT_DATE"), F.lit("test").alias("SPLIT")))
    )).alias("r")).select("FOLD_ID", "r.*")
    return df.join(small_side(roles), "SNAPSHOT_DATE")


def vintage_counts(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Snapshots per (split, label status)."""
    snaps = rows.select("SPLIT", "SNAPSHOT_DATE").distinct()
    return with_label_status(snaps, ledger).groupBy(
        "SPLIT", F.coalesce("LABEL_STATUS", F.lit("UNFINALISED")).alias("STATUS")).agg(
        F.count(F.lit(1)).alias("N_SNAPSHOTS"))


def ranking_by_vintage(df: DataFrame, ledger: DataFrame, **kw) -> DataFrame:
    """The ranking block per label vintage; empty unless both are present."""
    labelled = ranking.ranked_population(df).join(
        small_side(ledger.select("SNAPSHOT_DATE", "STATUS")), "SNAPSHOT_DATE")        # one row per month
    out = ranking.ranking_metrics(labelled, by=["STATUS"], **kw)
    both = Window.partitionBy(F.lit(0))        # at most one row per vintage
    return out.withColumn("__v", F.count(F.lit(1)).over(both)).where("__v > 1").drop("__v")
