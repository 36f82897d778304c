"""Data-quality rules of the loan feed. Each violation is a row:
(rule, detail, snapshot_date, n_bad).

``feed_violations`` counts them in a frame, with one scan for all rules.
``Watch`` looks at rows on their way somewhere else and costs no scan: it says
which rules broke in which snapshot, and only those are counted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import contract

RULES = ("label_below_category", "ladder", "months_range", "category_range", "duplicate_key",
         "npl_nesting", "horizon_varies", "sentinel_missing", "label_nullity")


class FeedError(ValueError):
    """The feed broke a rule and the caller asked for a hard stop."""


def _row_rules(cols: set[str]):
    """(rule, detail, violation condition) that one pass can count."""
    def c(n):
        return F.col(n)
    out = []
    if {"WORST_FUTURE_CAT", "LOAN_CATEGORY"} <= cols:
        out.append(("label_below_category", "WORST_FUTURE_CAT < LOAN_CATEGORY",
                    c("WORST_FUTURE_CAT") < c("LOAN_CATEGORY")))
    if set(C.DAYS_SINCE_LADDER) <= cols:
        for lo, hi in zip(C.DAYS_SINCE_LADDER, C.DAYS_SINCE_LADDER[1:]):
            out.append(("ladder", f"{lo} > {hi}", c(lo) > c(hi)))
    if "MONTHS_IN_CURRENT_CATEGORY" in cols:
        m = c("MONTHS_IN_CURRENT_CATEGORY")
        out.append(("months_range", "MONTHS_IN_CURRENT_CATEGORY outside 1..6", (m < 1) | (m > 6)))
    for n in C.CATEGORY_COLS:
        if n in cols:
            out.append(("category_range", f"{n} outside 0..4", (c(n) < 0) | (c(n) > 4)))
    if {"HAS_EVER_BEEN_NPL", "HAS_EVER_BEEN_PRENPL"} <= cols:
        out.append(("npl_nesting", "NPL without PRE-NPL",
                    (c("HAS_EVER_BEEN_NPL") == 1) & ~c("HAS_EVER_BEEN_PRENPL").eqNullSafe(1)))
    return out


def snapshot_facts(df: DataFrame, rules=RULES) -> DataFrame:
    """One row per snapshot with all that the rules need, from one scan.

    n (rows), surplus (rows beyond one a key), n_null (rows without a label), lo and
    hi (horizon dates), broken (counts of the row rules, in order), coded (counts of
    each sentinel). Where repeated keys are looked for, rows are first counted by key and
    by the rules they break, a bit for each, so that a key costs a task a few numbers
    and not one for each rule.
    """
    cols = set(df.columns)
    snapshot = F.col("SNAPSHOT_DATE") if "SNAPSHOT_DATE" in cols else F.lit(None)
    broken = [cond for r, _, cond in _row_rules(cols) if r in rules]
    coded = [F.col(c) == code for c, code in _sentinels(cols, rules)]
    horizon = F.col("LABEL_HORIZON_DATE") if "LABEL_HORIZON_DATE" in cols else F.lit(None)
    no_label = F.col("WORST_FUTURE_CAT").isNull() if "WORST_FUTURE_CAT" in cols else F.lit(False)
    keyed = "duplicate_key" in rules and {"LOAN_ID", "SNAPSHOT_DATE"} <= cols
    counts = {"n": F.lit(True), "n_null": no_label} | {f"b{i}": c for i, c in enumerate(broken)} | {f"s{i}": c for i, c in enumerate(coded)}
    snapshot, ends = snapshot.cast("bigint").alias("SNAPSHOT_DATE"), {"lo": F.min, "hi": F.max}
    if keyed:
        flags = [c for name, c in counts.items() if name != "n"]
        alike = df.groupBy(snapshot, F.col("LOAN_ID").alias("__loan"), _bits(flags).alias("__bits")).agg(
            F.count(F.lit(1)).alias("n"), *[f(horizon).cast("bigint").alias(name) for name, f in ends.items()])
        first = F.row_number().over(Window.partitionBy("SNAPSHOT_DATE", "__loan").orderBy("__bits")) == 1       # a row for each set of broken rules
        broke = {name: F.sum(F.when(F.col("__bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0))
                 for i, name in enumerate(name for name in counts if name != "n")}
        rows = alike.withColumn("__first", first.cast("int")).groupBy("SNAPSHOT_DATE").agg(
            *[f(name).alias(name) for name, f in ends.items()], F.sum("n").alias("n"), F.sum(F.col("n") - F.col("__first")).alias("surplus"),
            *[c.alias(name) for name, c in broke.items()])
    else:
        rows = df.groupBy(snapshot).agg(*[f(horizon).cast("bigint").alias(name) for name, f in ends.items()],
                                        *[F.count_if(c).alias(name) for name, c in counts.items()])

    def listed(prefix: str, of: list) -> Column:
        return F.array(*[F.col(f"{prefix}{i}") for i in range(len(of))]).cast("array<bigint>")
    surplus = F.col("surplus") if keyed else F.lit(0).cast("bigint")
    return rows.select("SNAPSHOT_DATE", "n", surplus.alias("surplus"), "n_null", "lo", "hi",
                       listed("b", broken).alias("broken"), listed("s", coded).alias("coded"))


def _bits(conditions: list[Column]) -> Column:
    """The conditions that hold, as the bits of a long."""
    if len(conditions) > 63:
        raise ValueError(f"{len(conditions)} rules do not fit the bits of a long")
    bits = F.lit(0).cast("bigint")
    for i, cond in enumerate(conditions):
        bits = bits + F.when(cond, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return bits


def _sentinels(cols: set[str], rules) -> list[tuple[str, float]]:
    return [(c, code) for c, code in contract.SENTINELS.items() if c in cols and "sentinel_missing" in rules]


def _findings(cols: set[str], rules, total: bool) -> list[tuple[str, str, Column]]:
    """(rule, detail, n_bad) over a row of facts, or over all of them in one aggregate."""
    def over(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)) if total else c
    out = [(r, d, over(F.get("broken", F.lit(i)))) for i, (r, d, _) in enumerate(x for x in _row_rules(cols) if x[0] in rules)]
    n = over(F.col("n"))
    for i, (c, code) in enumerate(_sentinels(cols, rules)):
        gone = (n >= C.SENTINEL_CHECK_MIN_ROWS) & (over(F.get("coded", F.lit(i))) == 0)
        out.append(("sentinel_missing", f"{c} has no {code}", F.when(gone, n).otherwise(0)))
    if "duplicate_key" in rules and {"LOAN_ID", "SNAPSHOT_DATE"} <= cols:
        out.append(("duplicate_key", "LOAN_ID, SNAPSHOT_DATE", over(F.col("surplus"))))
    if "horizon_varies" in rules and {"SNAPSHOT_DATE", "LABEL_HORIZON_DATE"} <= cols:
        out.append(("horizon_varies", "LABEL_HORIZON_DATE", over(F.when(F.col("lo") != F.col("hi"), 1).otherwise(0))))
    return out


def _rows_of(found: list[tuple[str, str, Column]], snapshot: Column) -> Column:
    structs = [F.struct(F.lit(r).alias("rule"), F.lit(d).alias("detail"), snapshot.cast("bigint").alias("snapshot_date"),
                        n.cast("bigint").alias("n_bad")) for r, d, n in found]
    return F.array(*structs) if structs else F.array().cast(_ROWS)


_ROWS = "array<struct<rule:string,detail:string,snapshot_date:bigint,n_bad:bigint>>"


def feed_violations(df: DataFrame, ledger: DataFrame | None = None, strict: bool = False,
                    rules=RULES, by_snapshot: bool = False) -> DataFrame:
    """All violations, from one scan. Rules on absent columns are skipped; NULL
    labels never break a row rule. ``ledger`` switches the label-nullity rule
    on. ``by_snapshot`` counts every rule per snapshot instead of over the frame."""
    cols = set(df.columns)
    facts = snapshot_facts(df, rules)
    labels = "label_nullity" in rules and ledger is not None and {"SNAPSHOT_DATE", "WORST_FUTURE_CAT"} <= cols
    nullity = F.array().cast(_ROWS)
    if labels:
        facts = facts.join(_expected(ledger), "SNAPSHOT_DATE", "left")
        detail = F.when(F.col("__final"), "NULL labels differ from the ledger").otherwise("open snapshot has labels")
        nullity = _rows_of([("label_nullity", "", _distance(F.col("n"), F.col("n_null")))], F.col("SNAPSHOT_DATE"))
        nullity = F.transform(nullity, lambda x: x.withField("detail", detail))
    if by_snapshot:
        rows = facts.select(F.concat(_rows_of(_findings(cols, rules, False), F.col("SNAPSHOT_DATE")), nullity).cast(_ROWS).alias("r"))
    else:
        found = _rows_of(_findings(cols, rules, True), F.lit(None))
        rows = facts.agg(F.concat(found, F.flatten(F.collect_list(nullity))).cast(_ROWS).alias("r"))      # a list of months
    out = rows.select(F.inline("r")).where(F.col("n_bad") > 0)
    if strict:
        raise_if_any(out)
    return out


def raise_if_any(violations: DataFrame) -> None:
    found = violations.collect()          # one row per rule, or per snapshot
    if found:
        raise FeedError("; ".join(f"{r['rule']}: {r['detail']} ({r['n_bad']} row(s))" for r in found))


def _expected(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.col("SNAPSHOT_DATE").cast("bigint").alias("SNAPSHOT_DATE"), F.lit(True).alias("__final"),
                         F.coalesce("LOANS_UNLABELLED", F.lit(0)).alias("__expected"))


def _distance(n: Column, n_null: Column) -> Column:
    """Open snapshots have only NULL labels; finalised ones exactly as many as
    the ledger says (unknown counts as 0). How far the counts are from that."""
    return F.when(F.col("__final"), F.abs(n_null - F.col("__expected"))).otherwise(n - n_null)


class Watch:
    """Observes the row rules and label counts of some snapshots while their rows are being written.

    Each rule marks the snapshots it broke in, in a bitmap, which a task that runs
    twice after a lost executor does not change; so a row costs a look at each rule,
    however many snapshots there are. Only the label counts could be
    too high; a mismatch they show is counted again, like every broken rule, by
    ``violations``. The rules that need a snapshot's rows together (repeated
    keys, horizons) are for whoever reads the written rows.
    """

    def __init__(self, df: DataFrame, snapshots: list[int], ledger: DataFrame | None = None):
        self.df, self.ledger, self.snapshots = df, ledger, snapshots
        self.cols = set(df.columns)
        self.observation = Observation()
        null = [c for c in contract.REQUIRED if c in self.cols]
        self.findings = [*_row_rules(self.cols), *[("null_in_required", c, F.col(c).isNull()) for c in null]]
        self.sentinels = _sentinels(self.cols, RULES)

    def watched(self) -> DataFrame:
        """The rows, unchanged; write these."""
        conditions = [c for _, _, c in self.findings] + [F.col(c) == code for c, code in self.sentinels]
        label = F.col("WORST_FUTURE_CAT") if "WORST_FUTURE_CAT" in self.cols else F.lit(None)
        at = F.array_position(F.array(*map(F.lit, self.snapshots)).cast("array<bigint>"), F.col("SNAPSHOT_DATE").cast("bigint")) - 1
        rows = self.df.withColumns({"__bits": _bits(conditions), "__at": F.when(at >= 0, at)})
        at = F.col("__at")
        # A histogram with a bin for each snapshot at least counts exactly.
        metrics = [F.to_json(F.histogram_numeric(F.when(label.isNull(), at), F.lit(max(2, len(self.snapshots))))).alias("null")]
        for i in range(len(conditions)):                    # a list of rules
            broke = F.col("__bits").bitwiseAND(F.lit(1 << i)) != 0
            metrics.append(F.hex(F.bitmap_construct_agg(F.when(broke, at))).alias(f"bit_{i}"))
        return rows.observe(self.observation, *metrics).drop("__bits", "__at")

    def _bits_seen(self) -> dict[int, int]:
        """The rules' bits by snapshot, once the rows are written."""
        seen, n = self.observation.get, len(self.findings) + len(self.sentinels)
        maps = [int.from_bytes(bytes.fromhex(seen[f"bit_{i}"]), "little") for i in range(n)]
        return {s: sum((x >> k & 1) << i for i, x in enumerate(maps)) for k, s in enumerate(self.snapshots)}

    def without_label(self) -> dict[int, int]:
        out = dict.fromkeys(self.snapshots, 0)
        for r in json.loads(self.observation.get["null"] or "[]"):
            out[self.snapshots[r["x"]]] += int(r["y"])
        return out

    def suspects(self, n: dict[int, int]) -> dict[int, set[str]]:
        """Rules that look broken, by snapshot, once the rows are written; ``n`` says how many rows a snapshot has."""
        broken, unlabelled = self._bits_seen(), self.without_label()
        expected = {}
        if self.ledger is not None:
            expected = {int(r["SNAPSHOT_DATE"]): r["__expected"] for r in _expected(self.ledger).collect()}     # months
        out: dict[int, set[str]] = {}
        for s in self.snapshots:
            bits, null = broken[s], unlabelled[s]
            rules = {r for i, (r, _, _) in enumerate(self.findings) if bits >> i & 1}
            if n.get(s, 0) >= C.SENTINEL_CHECK_MIN_ROWS and any(not bits >> len(self.findings) + i & 1 for i in range(len(self.sentinels))):
                rules.add("sentinel_missing")
            if self.ledger is not None and "WORST_FUTURE_CAT" in self.cols and (null != expected[s] if s in expected else null != n.get(s, 0)):
                rules.add("label_nullity")
            if rules:
                out[s] = rules
        return out

    def violations(self, n: dict[int, int]) -> DataFrame:
        """What is broken, counted per snapshot in the source rows of the snapshots concerned; without a scan if nothing is."""
        suspects = self.suspects(n)
        spark = self.df.sparkSession
        if not suspects:
            return spark.createDataFrame([], VIOLATIONS)
        rules = sorted(set().union(*suspects.values()))
        rows = self.df.where(F.col("SNAPSHOT_DATE").isin(list(suspects)))
        out = feed_violations(rows, self.ledger, rules=[r for r in rules if r != "null_in_required"], by_snapshot=True)
        if "null_in_required" in rules:
            names = [d for r, d, _ in self.findings if r == "null_in_required"]
            counts = rows.groupBy("SNAPSHOT_DATE").agg(*[F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in names])
            found = _rows_of([("null_in_required", c, F.col(f"__{c}")) for c in names], F.col("SNAPSHOT_DATE"))
            out = out.unionByName(counts.select(F.inline(found)).where("n_bad > 0"))
        return out


VIOLATIONS = "rule string, detail string, snapshot_date bigint, n_bad bigint"
