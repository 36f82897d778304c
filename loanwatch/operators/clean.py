"""Projection, filters and cleaning of the loan table."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract
from ..functions.columns import cap_category, clean_number
from ..functions.quantiles import quantiles

log = logging.getLogger(__name__)


class ContractError(ValueError):
    """A frame does not have the columns a step needs."""


def conformance(df: DataFrame) -> DataFrame:
    """How a table differs from the contract: (kind, column_name, n).

    missing / unexpected / wrong_type come from the schema; null_in_required
    counts NULLs in every non-nullable column in one pass.
    """
    spark = df.sparkSession
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in contract.SCHEMA}
    found = [("missing", c, None) for c in want if c not in have]
    found += [("unexpected", c, None) for c in have if c not in want]
    found += [("wrong_type", c, None) for c in want if c in have and not _fits(have[c], want[c])]
    schema_part = spark.createDataFrame(found, "kind string, column_name string, n bigint")
    required = [c for c in contract.REQUIRED if c in have]
    if not required:
        return schema_part
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    nulls = counts.unpivot([], required, "column_name", "n").where("n > 0").select(
        F.lit("null_in_required").alias("kind"), "column_name", "n")
    return schema_part.unionByName(nulls)


def _fits(have, want) -> bool:
    """Any numeric width fits a numeric column; text fits text."""
    def numeric(t):
        return t.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")
    return numeric(have) if numeric(want) else have == want


def project_features(df: DataFrame, order: list[str] | None = None,
                     keep_meta: bool = True) -> DataFrame:
    """Project by name to the wanted feature order.

    A missing feature is an error that names it. A column nobody asked for is
    dropped with a warning: a model keeps scoring on the features it knows.
    """
    if not order:
        order = contract.in_contract_order(df.columns)
    missing = [c for c in order if c not in df.columns]
    if missing:
        raise ContractError(f"missing feature column(s): {missing}")
    meta = [c for c in df.columns if c in contract.META] if keep_meta else []
    extra = [c for c in df.columns if c not in set(order) | set(contract.META)]
    if extra:
        log.warning("dropping column(s) the model does not know: %s", extra)
    return df.select(*meta, *order)


def drop_header_rows(df: DataFrame, column: str = "NATIONAL_CODE") -> DataFrame:
    """Header lines that slipped in as data; a NULL customer is kept."""
    return df.where((F.col(column) != F.lit(column)) | F.col(column).isNull())


def coerce_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; text that is no number becomes NULL."""
    return df.withColumns({c: clean_number(F.col(c)) for c in features})


def coercion_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: how many values would be lost by coercion, and one of them."""
    aggs = []
    for c in features:
        bad = F.col(c).isNotNull() & clean_number(F.col(c)).isNull()
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count_if(bad).alias("n_bad"),
                             F.min(F.when(bad, F.col(c).cast("string"))).alias("example")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r")).where("n_bad > 0")


def drop_unlabelled(df: DataFrame, label: str = "WORST_FUTURE_CAT") -> DataFrame:
    """Rows without a label are dropped, never filled."""
    return df.where(F.col(label).isNotNull())


def with_capped(df: DataFrame) -> DataFrame:
    """LABEL and CURRENT_CAT as classes 0..3."""
    cols = {"CURRENT_CAT": cap_category(F.col("LOAN_CATEGORY"))}
    if "WORST_FUTURE_CAT" in df.columns:
        cols["LABEL"] = cap_category(F.col("WORST_FUTURE_CAT"))
    return df.withColumns(cols)


def canonical_order() -> list[Column]:
    """The one row order everything may depend on: total, from content only."""
    return [F.col("NATIONAL_CODE").asc_nulls_last(), F.col("SNAPSHOT_DATE").asc(),
            F.col("DPD_DAYS").desc_nulls_last(), F.col("LOAN_ID").asc()]


def engine_predictions(output: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scoring engine output (with its tracking status) as prediction rows.

    Columns named in ``keep`` (a run id, say) come along in front.
    """
    status = F.col("OPERATION_STATUS_ENRICHMENT")
    return output.select(
        *keep,
        F.col("SNAPSHOT_DATE").cast("bigint").alias("SNAPSHOT_DATE"),
        F.col("LOAN_ID").cast("bigint").alias("LOAN_ID"), "NATIONAL_CODE",
        cap_category(F.col("DPD_CAT").cast("int")).alias("CURRENT_CAT"),
        F.col("P3").cast("double").alias("RISK_SCORE"),
        F.col("REMAIN_OF_ACCOUNT").cast("double").alias("REMAINING_AMNT"),
        (status.isNotNull() & (status != "NOT_APPLICABLE")).alias("FLAGGED"))


def fill_with_median(df: DataFrame, features: list[str], method: str = "exact") -> DataFrame:
    """NULL, NaN and infinite cells to the column's median of finite values."""
    def finite(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    clean = df.withColumns({c: finite(c) for c in features})
    long = clean.select(*features).unpivot([], features, "feature", "v")
    med = {r["feature"]: r["value"] for r in
           quantiles(long, ["feature"], "v", [0.5], method).collect()}   # one row per feature
    return clean.withColumns({c: F.coalesce(F.col(c), F.lit(med.get(c))) for c in features})
