"""Snapshot store: loan rows by snapshot, filled bit by bit under a commit log.

Rows are staged in a folder of their own for each commit, partitioned by
snapshot. What makes them part of the store is their entry in the log: one small file
for a commit, written last and whole or not at all. Readers take the folders that
the log names and nothing else, so rows of a job that died half way are never
seen; the next fill stages them again, and ``vacuum`` removes what is left over.
A later entry for a snapshot replaces the earlier one in one step, while readers
that began before keep their files. One job fills a store at a time.

The feed rules are watched while the rows are written (``feed_checks.Watch``).
What they find is written beside the log, keyed by commit, before it;
``strict`` stops there, so broken rows never become part of the store.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract
from ..operators.clean import ContractError
from ..operators.feed_checks import VIOLATIONS, Watch, raise_if_any
from ..operators.preprocess import feature_diff
from ..operators.queue import queue_order

log = logging.getLogger(__name__)


class StoreError(RuntimeError):
    """A snapshot must not be stored as permanent."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_LOG = "seq bigint, commit string, snapshot_date bigint, n_rows bigint, built string, mature boolean, row_schema string"


@dataclass(frozen=True)
class Entry:
    """What the log says about a stored snapshot."""

    seq: int
    commit: str
    snapshot: int
    n_rows: int
    built: str | None
    mature: bool
    row_schema: str

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.row_schema))

    @property
    def features(self) -> list[str]:
        return [f.name for f in self.schema if f.name not in contract.META]


class SnapshotStore:
    """A folder of committed snapshots: ``data/commit=.../SNAPSHOT_DATE=...``, ``log`` and ``violations``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> dict[int, Entry]:
        """The newest entry of each snapshot (the log has a row for each month and commit)."""
        if not _exists(self.spark, f"{self.path}/log"):
            return {}
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()
        return {r["snapshot_date"]: Entry(*r) for r in sorted(rows, key=lambda r: (r["seq"], r["commit"]))}

    def snapshots(self) -> list[int]:
        return sorted(s for s, e in self.entries().items() if e.n_rows)

    def violations(self) -> DataFrame:
        """Feed rules that rows of the store broke, as they were when committed: rule, detail, snapshot_date, n_bad."""
        entries = self.entries().values()
        if not entries or not _exists(self.spark, f"{self.path}/violations"):
            return self.spark.createDataFrame([], VIOLATIONS)
        live = F.col("commit").isin(sorted({e.commit for e in entries}))
        rows = self.spark.read.schema(f"commit string, {VIOLATIONS}").parquet(f"{self.path}/violations").where(live)
        current = F.lit(False)
        for e in entries:
            current = current | ((F.col("commit") == e.commit) & (F.col("snapshot_date") == e.snapshot))
        return rows.where(current).drop("commit")

    def read(self, snapshots: list[int] | None = None) -> DataFrame:
        """Committed rows of the given snapshots (default: all) as one table.

        One that was stored under another feature list is refused and named, where a
        plain read would give NULLs.
        """
        entries = self.entries()
        wanted = sorted(s for s, e in entries.items() if e.n_rows and (snapshots is None or s in snapshots))
        if not wanted:
            raise FileNotFoundError(f"no stored parts in {self.path}")
        first = entries[wanted[0]]
        for s in wanted[1:]:
            if entries[s].features != first.features:
                raise ContractError(f"{first.snapshot} and {s} differ in features ({feature_diff(first.features, entries[s].features)})")
        folders = [f"{self.path}/data/commit={entries[s].commit}/SNAPSHOT_DATE={s}" for s in wanted]
        schema = T.StructType([*first.schema.fields, T.StructField("commit", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*[f.name for f in first.schema])

    def fill(self, rows: DataFrame, snapshots: list[int], mature: bool, built: dict[int, str | None] | None = None,
             ledger: DataFrame | None = None, strict: bool = False) -> list[int]:
        """Stage the rows of the given snapshots, check them, and commit; returns the snapshots that got rows.

        ``rows`` are read once. Mature rows without a label are left out after they were
        counted; a snapshot of which nothing is left is committed as empty, so that it
        is not read again.
        """
        snapshots = sorted({int(s) for s in snapshots})
        if not snapshots:
            return []
        commit = uuid.uuid4().hex
        rows = rows.where(F.col("SNAPSHOT_DATE").isin(snapshots))
        watch = Watch(rows, snapshots, ledger)
        kept = watch.watched()
        kept = kept.where(F.col("WORST_FUTURE_CAT").isNotNull()) if mature else kept.drop("WORST_FUTURE_CAT", "WORST_FUTURE_DPD")
        staged = f"{self.path}/data/commit={commit}"
        # The rebalance hint lets adaptive execution split a large snapshot over several tasks and merge small ones.
        kept.hint("rebalance", "SNAPSHOT_DATE").write.partitionBy("SNAPSHOT_DATE").parquet(staged)

        facts = self._facts(self.spark.read.schema(kept.schema).parquet(staged))
        counts = {s: f["n"] for s, f in facts.items()}
        missing = watch.without_label() if mature else {}
        found = [tuple(r) for r in watch.violations({s: counts.get(s, 0) + missing.get(s, 0) for s in snapshots}).collect()]    # a row for each rule and month
        found += [("duplicate_key", "LOAN_ID, SNAPSHOT_DATE", s, f["more"]) for s, f in facts.items() if f["more"]]
        found += [("horizon_varies", "LABEL_HORIZON_DATE", s, 1) for s, f in facts.items() if f["lo"] != f["hi"]]
        for rule, detail, s, n in found:
            log.warning("snapshot %s: %s: %s (%s row(s))", s, rule, detail, n)
        if found:
            broken = self.spark.createDataFrame(found, VIOLATIONS)
            if strict:
                raise_if_any(broken)
            broken.select(F.lit(commit).alias("commit"), "*").coalesce(1).write.mode("append").parquet(f"{self.path}/violations")
        self._commit(commit, snapshots, counts, built or {}, mature, kept.schema)
        return [s for s in snapshots if counts.get(s)]

    @staticmethod
    def _facts(rows: DataFrame) -> dict[int, Row]:
        """Per snapshot: rows, rows beyond one a key, least and greatest horizon, from a few columns of the staged rows."""
        horizon = F.col("LABEL_HORIZON_DATE") if "LABEL_HORIZON_DATE" in rows.columns else F.lit(None)
        per = rows.groupBy("SNAPSHOT_DATE", "LOAN_ID").agg(F.count(F.lit(1)).alias("n"), F.min(horizon).alias("lo"), F.max(horizon).alias("hi"))
        facts = per.groupBy("SNAPSHOT_DATE").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("more"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return {int(r["SNAPSHOT_DATE"]): r for r in facts.collect()}                    # months

    def _commit(self, commit: str, snapshots: list[int], counts: dict[int, int], built: dict[int, str | None], mature: bool, schema: T.StructType) -> None:
        """The one step that makes staged rows part of the store: a file of one task, which appears whole."""
        seq = 1 + max((e.seq for e in self.entries().values()), default=0)
        rows = [(seq, commit, s, counts.get(s, 0), built.get(s), mature, schema.json()) for s in snapshots]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def vacuum(self) -> list[str]:
        """Delete staged folders the log does not name any more; for a time when nobody fills or reads the store."""
        live = {f"commit={e.commit}" for e in self.entries().values()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        dead = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("commit=") and f.getPath().getName() not in live]
        for folder in dead:
            fs.delete(folder, True)
        return sorted(f.getName().removeprefix("commit=") for f in dead)


def stored_snapshots(spark: SparkSession, path: str) -> list[int]:
    """Committed snapshots (one number per month)."""
    return SnapshotStore(spark, path).snapshots()


def guard_mature(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per snapshot: in the ledger or not, and rows without a label."""
    per = rows.groupBy("SNAPSHOT_DATE").agg(
        F.count_if(F.col("WORST_FUTURE_CAT").isNull()).alias("n_unlabelled"))
    led = ledger.select("SNAPSHOT_DATE", F.lit(True).alias("in_ledger"))
    return per.join(led, "SNAPSHOT_DATE", "left").select(
        "SNAPSHOT_DATE", F.coalesce("in_ledger", F.lit(False)).alias("in_ledger"), "n_unlabelled")


def store_mature(loans: DataFrame, ledger: DataFrame, path: str, strict: bool = False) -> list[int]:
    """Store the mature snapshots that are not stored yet; returns which.

    Stored ones are permanent and are not read again. Only ledger snapshots are
    selected and rows without a label are dropped, so the guard's conditions
    hold by construction and cost no pass of their own.
    """
    store = SnapshotStore(loans.sparkSession, path)
    have = {s for s, e in store.entries().items() if e.mature}
    final = {int(r[0]) for r in ledger.select("SNAPSHOT_DATE").distinct().collect()}
    return store.fill(loans, sorted(final - have), True, ledger=ledger, strict=strict)


def store_rows(rows: DataFrame, ledger: DataFrame, path: str) -> list[int]:
    """Store rows a caller calls mature, after checking that they are: a
    snapshot outside the ledger or an unlabelled row is refused."""
    facts = guard_mature(rows, ledger).collect()          # one row per snapshot
    bad = [r for r in facts if r["n_unlabelled"] > 0 or not r["in_ledger"]]
    if bad:
        raise StoreError("; ".join(
            f"{r['SNAPSHOT_DATE']}: " + ("holds unlabelled rows" if r["in_ledger"]
                                         else "not in the label ledger") for r in bad))
    return SnapshotStore(rows.sparkSession, path).fill(rows, [int(r["SNAPSHOT_DATE"]) for r in facts], True)


def store_open(loans: DataFrame, build_times: DataFrame, path: str, ledger: DataFrame | None = None, strict: bool = False) -> list[int]:
    """Store snapshots for scoring (no labels); returns the ones written.

    A stored snapshot is reused while its build time is unchanged; without a
    readable build time it is written again.
    """
    store = SnapshotStore(loans.sparkSession, path)
    here = loans.select("SNAPSHOT_DATE").distinct().join(
        build_times.select("SNAPSHOT_DATE", F.col("END_TIME").cast("string").alias("BUILT")),
        "SNAPSHOT_DATE", "left")
    now = {int(r["SNAPSHOT_DATE"]): r["BUILT"] for r in here.collect()}         # months
    old = {s: e.built for s, e in store.entries().items()}
    stale = sorted(s for s, b in now.items() if b is None or old.get(s) != b)
    return store.fill(loans, stale, False, now, ledger, strict)


def combine(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of stored parts that must agree on their features.

    A different feature list is refused and named; nothing is filled in.
    """
    out, first, names = None, None, None
    for label, df in parts.items():
        feats = [c for c in df.columns if c not in contract.META]
        if out is None:
            out, first, names = df, label, feats
            continue
        if feats != names:
            raise ContractError(f"{first} and {label} differ in features "
                                f"({feature_diff(names, feats)})")
        out = out.unionByName(df)
    if out is None:
        raise FileNotFoundError("no stored parts")
    return out


def read_store(spark: SparkSession, path: str, snapshots: list[int] | None = None) -> DataFrame:
    """The committed snapshots as one table; see :meth:`SnapshotStore.read`."""
    return SnapshotStore(spark, path).read(snapshots)


def write_queue(queue: DataFrame, folder: str) -> str:
    """The ranked queue as CSV in call order; the name carries the snapshot or their range.

    Files follow each other in the order of their names.
    """
    lo, hi = queue.agg(F.min("SNAPSHOT_DATE"), F.max("SNAPSHOT_DATE")).first()
    tag = f"{lo}" if lo == hi else f"{lo}_{hi}"
    path = f"{folder.rstrip('/')}/predictions_{tag}"
    order = [F.col("RISK_RANK").asc_nulls_last(), *queue_order("LOAN_ID" in queue.columns)]     # flagged rows behind the queue
    queue.orderBy(*order).write.mode("overwrite").csv(path, header=True)
    return path


def write_scored_test(scored: DataFrame, path: str) -> None:
    """Calibrated test scores with their labels, for later threshold work."""
    scored.select("LOAN_ID", "SNAPSHOT_DATE", F.col("LABEL").alias("y_true"),
                  F.col("CURRENT_CAT").alias("current_cat"),
                  *[F.col(f"m{k}").alias(f"p{k}") for k in range(4)],
                  F.col("PREDICTED_CLASS").alias("pred_class")).write.mode("overwrite").parquet(path)
