"""Global positions and running sums without a one-partition window.

``row_number`` over an unpartitioned ordering moves every row to one task.
Here the frame is sorted by range (``orderBy``), so each partition holds one
stretch of the order; a row's place is its index in its partition plus the rows
before that partition. The order starts with the group columns, so a group's
rows stand together and its own count starts at its first place. One number per
partition reaches the driver and travels back as a literal.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin, small_side

# monotonically_increasing_id: partition number above, row index below this bit.
_INDEX_BITS = 33
_PART, _IDX = "__part", "__idx"


def sorted_slices(df: DataFrame, order: list[Column]) -> DataFrame:
    """The frame in total order with each row's partition number and index.

    Pinned, because the range bounds are sampled: a second evaluation could cut
    the order elsewhere.
    """
    rid = F.monotonically_increasing_id()
    out = (df.orderBy(*order)
           .withColumn(_PART, F.shiftrightunsigned(rid, _INDEX_BITS))
           .withColumn(_IDX, rid.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))))
    return pin(out)


def _before(rows: DataFrame, what: Column) -> Column:
    """The sum of ``what`` over all earlier partitions, as a function of the partition number."""
    parts = dict(rows.groupBy(_PART).agg(F.sum(what)).collect())         # one number per partition
    sums, total = [], 0
    for k in range(max(parts, default=-1) + 1):
        sums.append(total)
        total += parts.get(k) or 0
    return F.get(F.from_json(F.lit(json.dumps(sums)), "array<bigint>"), F.col(_PART).cast("int"))


def _per_group(rows: DataFrame, within: list[str], groups: DataFrame) -> DataFrame:
    """Join one row per group to its rows; NULL groups match.

    Few groups are broadcast here: adaptive execution does not broadcast a side that
    leaves most partitions empty, and a join by few keys would gather a group in a task.
    """
    groups = small_side(groups)
    on = F.lit(True)
    for k, c in enumerate(within):
        on = on & rows[c].eqNullSafe(groups[f"__g{k}"])
    return rows.join(groups, on)


def with_position(df: DataFrame, order: list[Column], within: list[str] | None = None,
                  name: str = "POS", total: str | None = None) -> DataFrame:
    """Add the 1-based position of every row in the stated order.

    ``order`` must be total (end in a unique tie key): then equal scores split
    over partitions too. ``within`` restarts the count per group; a group may be
    of any size, since it may span partitions. ``total`` adds the group's size.
    """
    within = within or []
    rows = sorted_slices(df, [F.col(c).asc_nulls_first() for c in within] + order)
    rows = rows.withColumn("__at", _before(rows, F.lit(1)) + F.col(_IDX))
    if within or total:
        groups = rows.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(within)]).agg(
            F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__total"))
        rows = _per_group(rows, within, groups)
    else:
        rows = rows.withColumn("__first", F.lit(0))
    cols = [F.col(c) for c in df.columns] + [(F.col("__at") - F.col("__first") + 1).alias(name)]
    return rows.select(*cols, *[F.col("__total").alias(total)] if total else [])


def with_running_sum(df: DataFrame, order: list[Column], sums: dict[str, str],
                     within: list[str] | None = None) -> DataFrame:
    """Add running sums (inclusive) of whole-number columns along a total order.

    ``sums`` maps a new column to the column it adds up. The window runs inside
    one partition of the sort, so its size is that partition's, not the group's.
    """
    within = within or []
    rows = sorted_slices(df, [F.col(c).asc_nulls_first() for c in within] + order)
    inside = Window.partitionBy(_PART).orderBy(_IDX).rowsBetween(Window.unboundedPreceding, 0)
    value = {new: F.coalesce(F.col(src), F.lit(0)).cast("bigint") for new, src in sums.items()}
    run = rows.select("*", *[(_before(rows, v) + F.sum(v).over(inside)).alias(f"__r_{new}") for new, v in value.items()])
    if not within:
        return run.select(*df.columns, *[F.col(f"__r_{new}").alias(new) for new in sums])
    run = pin(run)
    first = F.struct(_PART, _IDX)
    groups = run.groupBy(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(within)]).agg(
        *[F.min_by(F.col(f"__r_{new}") - v, first).alias(f"__b_{new}") for new, v in value.items()])
    return _per_group(run, within, groups).select(
        *df.columns, *[(F.col(f"__r_{new}") - F.col(f"__b_{new}")).alias(new) for new in sums])
