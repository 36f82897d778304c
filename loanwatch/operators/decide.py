"""Decision layer: mask, expected costs, decisions, scores (projections only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

RAW = [f"p{k}" for k in range(C.NUM_CLASSES)]
MASKED = [f"m{k}" for k in range(C.NUM_CLASSES)]


def first_min(cols: list[Column]) -> Column:
    """Index of the smallest value, lowest index on ties."""
    arr = F.array(*cols)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


def first_max(cols: list[Column]) -> Column:
    """Index of the largest value, lowest index on ties."""
    arr = F.array(*cols)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def expected_costs(probs: list[Column], cost_matrix=C.COST_MATRIX) -> list[Column]:
    """Expected cost of each action: sum over true classes of p * cost."""
    out = []
    for j in range(len(probs)):
        terms = [p * float(cost_matrix[i][j]) for i, p in enumerate(probs)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total)
    return out


def cost_decision(probs: list[Column], cost_matrix=C.COST_MATRIX) -> Column:
    return first_min(expected_costs(probs, cost_matrix))


def do_nothing_cost(probs: list[Column], cost_matrix=C.COST_MATRIX) -> Column:
    return expected_costs(probs, cost_matrix)[0]


def with_monotone_mask(df: DataFrame, cat: str = "CURRENT_CAT", probs: list[str] = RAW,
                       into: list[str] = MASKED) -> DataFrame:
    """A label never falls below the current category: zero that mass, renormalise.

    A row whose whole mass is removed gets the worst class.
    """
    kept = [F.when(F.lit(k) < F.col(cat), 0.0).otherwise(F.col(p))
            for k, p in enumerate(probs)]
    total = kept[0]
    for k in kept[1:]:
        total = total + k
    df = df.withColumn("__mass", total)
    last = len(probs) - 1
    cols = {into[k]: F.when(F.col("__mass") == 0, 1.0 if k == last else 0.0)
            .otherwise(kept[k] / F.col("__mass")) for k in range(len(probs))}
    return df.withColumns(cols).drop("__mass")


def with_decision(df: DataFrame, probs: list[str] = MASKED,
                  cost_matrix=C.COST_MATRIX) -> DataFrame:
    """PREDICTED_CLASS, RISK_SCORE = P(severe), EXPECTED_COST of doing nothing."""
    p = [F.col(c) for c in probs]
    return df.withColumns({
        "PREDICTED_CLASS": cost_decision(p, cost_matrix),
        "RISK_SCORE": p[-1],
        "EXPECTED_COST": do_nothing_cost(p, cost_matrix),
    })
