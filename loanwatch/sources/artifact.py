"""A deployable model: preprocessing, arm, calibrator and metadata in a folder."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.arms import BINNED_ROWS, Arm
from ..operators.calibrate import Calibrator
from ..operators.clean import ContractError, coerce_features, drop_header_rows, with_capped
from ..operators.grain import KEYS, feature_names, loan_rows, portfolio_features
from ..operators.preprocess import Preprocessor

log = logging.getLogger(__name__)


class ArtifactError(ValueError):
    """An artifact cannot be used safely."""


@dataclass
class Model:
    """Scores frames at its own grain, projected by name to its own features."""

    preprocessor: Preprocessor
    arm: Arm
    calibrator: Calibrator | None
    features: list[str]
    grain: str = "loan"
    contract_version: int = C.CONTRACT_VERSION
    extra: dict[str, str] = field(default_factory=dict)

    def shape(self, df: DataFrame) -> DataFrame:
        """A loan table to model rows. No truncation: training saw all loans."""
        return shape_rows(df, self.preprocessor, self.features, self.grain)

    def raw_probs(self, df: DataFrame) -> DataFrame:
        """Loan table to rows with uncalibrated p0..p3."""
        return self.arm.predict(self.shape(df))

    def probs(self, df: DataFrame) -> DataFrame:
        out = self.raw_probs(df)
        return out if self.calibrator is None else self.calibrator.transform(out)


def shape_rows(df: DataFrame, preprocessor: Preprocessor, features: list[str], grain: str = "loan",
               keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Clean, preprocess and bring loan rows to a model's grain.

    Category, label and exposure are taken before preprocessing.
    """
    extra = [c for c in keep_columns if c in df.columns]
    kept = df.select("*", *[F.col(c).alias(f"__k_{c}") for c in extra])
    if C.EXPOSURE_FEATURE in df.columns:
        kept = kept.withColumn("EXPOSURE", F.col(C.EXPOSURE_FEATURE).cast("double"))
    kept = with_capped(drop_header_rows(kept)).withColumn("__cat", F.col("LOAN_CATEGORY"))
    missing = [f for f in features if f not in kept.columns]
    if missing:
        raise ContractError(f"missing feature column(s): {missing}")
    names = [c for c in ("LABEL", "CURRENT_CAT", "EXPOSURE", "__cat") if c in kept.columns]
    rows = coerce_features(kept, features).select(
        *_key_columns(kept), *names, *[F.col(f"__k_{c}").alias(c) for c in extra], *features)
    rows = preprocessor.transform(rows, features)
    if grain == "loan":
        return loan_rows(rows).drop("__cat")
    # The splits of MLlib's trees follow the last bits of means and deviations; binned rows hardly do.
    out = portfolio_features(rows, features, exposure="EXPOSURE" if "EXPOSURE" in names else None,
                             category="__cat", label="LABEL", keys=[*KEYS, *extra], deal=df.count() > BINNED_ROWS)
    return out.withColumn("N_LOANS_IN_PORTFOLIO", F.col("N_LOANS"))


def _key_columns(df: DataFrame) -> list[str]:
    return [c for c in ("LOAN_ID", "SNAPSHOT_DATE", "NATIONAL_CODE") if c in df.columns]


def model_columns(features: list[str], grain: str) -> list[str]:
    return feature_names(features, grain)


def save(model: Model, spark: SparkSession, path: str) -> None:
    path = path.rstrip("/")
    model.preprocessor.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/preprocessor")
    subs = []
    for name, m in model.arm.models.items():
        if isinstance(m, float):
            subs.append((name, m))
        else:
            m.write().overwrite().save(f"{path}/arm/{name}")
            subs.append((name, None))
    cal = None
    if model.calibrator:
        model.calibrator.blocks.write.mode("overwrite").parquet(f"{path}/calibrator")
        cal = model.calibrator.strata
    meta = [(model.features, model.grain, C.NUM_CLASSES, model.contract_version, model.arm.kind,
             model.arm.features, [f"{n}={'' if v is None else v}" for n, v in subs],
             [f"{c}={','.join(map(str, y))}" for c, y in model.arm.strata.items()], cal)]
    spark.createDataFrame(meta, "features array<string>, grain string, num_classes int, "
                                "contract_version int, arm string, arm_features array<string>, "
                                "models array<string>, strata array<string>, calibrated array<int>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Model:
    """Read a model back. An artifact that does not say its features is refused;
    one fitted under another contract version is used with a warning."""
    path = path.rstrip("/")
    meta = spark.read.parquet(f"{path}/metadata").first()
    if not meta["features"]:
        raise ArtifactError(f"{path} does not record the feature list it was trained on")
    if meta["contract_version"] != C.CONTRACT_VERSION:
        log.warning("%s was fitted under column contract v%s, this code is at v%s", path,
                    meta["contract_version"], C.CONTRACT_VERSION)
    arm = Arm(meta["arm"], list(meta["arm_features"]))
    for entry in meta["models"]:
        name, const = entry.split("=")
        arm.models[name] = float(const) if const else GBTClassificationModel.load(f"{path}/arm/{name}")
    for entry in meta["strata"]:
        c, classes = entry.split("=")
        arm.strata[int(c)] = [int(y) for y in classes.split(",")]
    cal = None
    if meta["calibrated"] is not None:                      # the strata that have curves of their own
        cal = Calibrator(spark.read.parquet(f"{path}/calibrator"), list(meta["calibrated"]))
    pre = Preprocessor.from_frame(spark.read.parquet(f"{path}/preprocessor"))
    pre.check_features(list(meta["features"]))
    return Model(pre, arm, cal, list(meta["features"]), meta["grain"], meta["contract_version"])
