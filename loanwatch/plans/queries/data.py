"""Queries for sources and sinks (A), cleaning (B) and feed checks (C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ... import constants as C
from ... import contract
from ...operators import clean as B
from ...operators import feed_checks as FC
from ...operators import maturity as E
from ...session import pin, scratch_root
from ...sources import derived as D
from ...sources import store as S
from ...sources import tables as A
from .. import ingest
from ..registry import query
from .ranking import QUEUE_SQL

YEAR_2000 = [20000000 + m * 100 + 1 for m in range(1, 13)]
IN_2000 = ", ".join(map(str, YEAR_2000))


def _fresh(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _ledger(spark, sf):
    return A.label_ledger(D.ledger_table(spark, sf))


@query("A1_training_rows", "loan_id:i snapshot_date:i dpd_days:i worst_future_cat:i",
       f"select loan_id, snapshot_date, dpd_days, worst_future_cat from feed where snapshot_date in ({IN_2000})")
def _a1(spark, sf):
    return A.training_rows(D.loan_feed(spark, sf), YEAR_2000)


@query("A2_prediction_rows", "loan_id:i snapshot_date:i n_columns:i",
       "select loan_id, snapshot_date, 20 as n_columns from feed where snapshot_date = 20010601")
def _a2(spark, sf):
    df = A.prediction_rows(D.loan_feed(spark, sf), 20010601)
    return df.withColumn("n_columns", F.lit(len([c for c in df.columns if c in contract.META
                                                  or c in contract.FEATURES
                                                  or c in ("STATE_ROWS", "SCORE")])))


@query("A3_available_snapshots", "snapshot_date:i", "select snapshot_date from snaps")
def _a3(spark, sf):
    return A.available_snapshots(D.loan_feed(spark, sf))


@query("A4_label_ledger", "snapshot_date:i status:s loans_unlabelled:i loans_missing_months:i",
       "select * from ledger")
def _a4(spark, sf):
    return _ledger(spark, sf)


@query("A5_label_horizons", "snapshot_date:i label_horizon_date:i",
       "select distinct snapshot_date, label_horizon_date from feed")
def _a5(spark, sf):
    return A.label_horizons(D.loan_feed(spark, sf))


@query("A6_incomplete_runs", "snapshot_date:i status:s last_step:s error_message:s", """
  select snapshot_date, operation_status as status, 'publish' as last_step, 'stopped' as error_message
  from (select * from runs order by snapshot_date desc, operation_date desc limit 24)
  where operation_status = 'FAILED'""")
def _a6(spark, sf):
    return A.incomplete_runs(A.load_runs(D.job_control(spark, sf), D.JOB, 24))


@query("A7_build_times", "snapshot_date:i built:s", """
  select snapshot_date, strftime(max(operation_date), '%Y-%m-%d %H:%M:%S') as built
  from runs where operation_status <> 'FAILED' group by 1""")
def _a7(spark, sf):
    return A.build_times(D.job_control(spark, sf), D.JOB).withColumn(
        "built", F.date_format("END_TIME", "yyyy-MM-dd HH:mm:ss"))


@query("A8_called_log_csv", "national_code:s called_at:s", """
  select national_code, strftime(called_at, '%Y-%m-%d %H:%M:%S') as called_at from calls""")
def _a8(spark, sf):
    path = _fresh(spark, "called")
    D.called_log(spark, sf).write.csv(path, header=True)
    return A.read_called_log(spark, path).withColumn(
        "CALLED_AT", F.date_format("CALLED_AT", "yyyy-MM-dd HH:mm:ss"))


@query("A9_snapshot_store", "snapshot_date:i n_rows:i n_customers:i", """
  select snapshot_date, count(*) as n_rows, count(distinct national_code) as n_customers
  from feed_open where worst_future_cat is not null group by 1""")
def _a9(spark, sf):
    """Fill the store in two goes: LEGACY snapshots first, then what is new."""
    path = _fresh(spark, "store")
    loans, ledger = pin(D.feed_with_open_labels(spark, sf)), pin(_ledger(spark, sf))
    S.store_mature(loans, ledger.where("STATUS = 'LEGACY'"), path)
    S.store_mature(loans, ledger, path)
    return S.read_store(spark, path).groupBy("SNAPSHOT_DATE").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("NATIONAL_CODE").alias("n_customers"))


@query("A9_open_store", "snapshot_date:i n_rows:i", """
  select snapshot_date, count(*) as n_rows from feed where snapshot_date > 20010501 group by 1""")
def _a9b(spark, sf):
    path = _fresh(spark, "open")
    loans = D.loan_feed(spark, sf)
    still_open = loans.join(F.broadcast(E.open_snapshots(D.snapshots(spark, sf), _ledger(spark, sf))),
                            "SNAPSHOT_DATE", "left_semi")
    S.store_open(still_open, A.build_times(D.job_control(spark, sf), D.JOB), path)
    return S.read_store(spark, path).groupBy("SNAPSHOT_DATE").agg(F.count(F.lit(1)).alias("n_rows"))


@query("A9_ingest_rows", "loan_id:i snapshot_date:i dpd_days:i remaining_amnt:d worst_future_cat:i", """
  select loan_id, snapshot_date, dpd_days, remaining_amnt, worst_future_cat from feed_open
  where worst_future_cat is not null and snapshot_date in (select snapshot_date from ledger)""")
def _a9c(spark, sf):
    """The rows a training run gets, through the store: a first run, and one after the other snapshots were finalised."""
    path = _fresh(spark, "ingest")
    loans, ledger = pin(D.feed_with_open_labels(spark, sf)), pin(_ledger(spark, sf))
    ingest.training_loans(loans, ledger.where("STATUS = 'LEGACY'"), path)
    return ingest.training_loans(loans, ledger, path)


@query("A10_write_guard", "snapshot_date:i in_ledger:b n_unlabelled:i", """
  select f.snapshot_date, bool_or(l.status is not null) as in_ledger,
         count(*) filter (worst_future_cat is null) as n_unlabelled
  from feed_open f left join ledger l using (snapshot_date) group by 1""")
def _a10(spark, sf):
    return S.guard_mature(D.feed_with_open_labels(spark, sf), _ledger(spark, sf))


@query("A11_combine_parts", "loan_id:i snapshot_date:i dpd_days:i", """
  select loan_id, snapshot_date, dpd_days from feed""")
def _a11(spark, sf):
    feed = D.loan_feed(spark, sf)
    return S.combine({"legacy": feed.where(F.col("SNAPSHOT_DATE") <= D.LAST_LEGACY_SNAPSHOT),
                      "later": feed.where(F.col("SNAPSHOT_DATE") > D.LAST_LEGACY_SNAPSHOT)})


@query("A12_snapshots_to_score", "wanted:s snapshot_date:i", """
  select 'named' as wanted, snapshot_date from snaps where snapshot_date in (20010301, 19990101)
  union all select 'open', snapshot_date from snaps where snapshot_date > 20010501
  union all select 'newest', max(snapshot_date) from snaps""")
def _a12(spark, sf):
    snaps, ledger = D.snapshots(spark, sf), _ledger(spark, sf)
    everything = snaps.select("SNAPSHOT_DATE")
    parts = [("named", E.snapshots_to_score(snaps, ledger, [20010301, 19990101, 20300101])),
             ("open", E.snapshots_to_score(snaps, ledger, [20300101])),
             ("newest", E.snapshots_to_score(snaps, everything))]
    out = None
    for name, p in parts:
        p = p.select(F.lit(name).alias("wanted"), "SNAPSHOT_DATE")
        out = p if out is None else out.unionByName(p)
    return out


@query("A13_score_table", "loan_id:i snapshot_date:i risk:d current_cat:i y_true:i",
       "select loan_id, snapshot_date, score as risk, current_cat, label as y_true from scored")
def _a13(spark, sf):
    return A.score_table(D.scored(spark, sf).withColumnsRenamed(
        {"SCORE": "P_SEVERE_PAST_DUE", "CURRENT_CAT": "current_cat", "LABEL": "y_true"}))


@query("A15_queue_sink", "risk_rank:i loan_id:i snapshot_date:i rule_flag:s",
       f"with {QUEUE_SQL} select risk_rank, loan_id, snapshot_date, rule_flag from que")
def _a15(spark, sf):
    from .ranking import flagged
    from ...operators.queue import with_rank
    path = S.write_queue(with_rank(flagged(spark, sf)), _fresh(spark, "queue"))
    return spark.read.csv(path, header=True).fillna({"RULE_FLAG": ""})


# ---- cleaning ------------------------------------------------------------------

_NULLS = ["LOAN_ID", "SNAPSHOT_DATE"] + [c for c in contract.REQUIRED if c in D.FEED_FEATURES]
_FEED_COLS = ["LOAN_ID", "SNAPSHOT_DATE", "NATIONAL_CODE", "CONTRACT_NUMBER", "LABEL_HORIZON_DATE",
              "WORST_FUTURE_DPD", "WORST_FUTURE_CAT", *D.FEED_FEATURES]
_MISSING = [f.name for f in contract.SCHEMA if f.name not in _FEED_COLS]
_HOLES = "case when loan_id % 19 = 0 then null else dpd_days end"


@query("B1_contract_conformance", "kind:s column_name:s n:i", "\n  union all ".join(
    [f"select 'missing' as kind, '{c}' as column_name, null::bigint as n" for c in _MISSING]
    + [f"select 'unexpected', '{c}', null" for c in ("MONTH_TS", "STATE_ROWS", "SCORE")]
    + ["select 'wrong_type', 'CONTRACT_NUMBER', null",
       "select 'null_in_required', 'DPD_DAYS', count(*) from feed where loan_id % 19 = 0"]))
def _b1(spark, sf):
    df = D.loan_feed(spark, sf).withColumns({
        "DPD_DAYS": F.when(F.col("LOAN_ID") % 19 != 0, F.col("DPD_DAYS")),
        "CONTRACT_NUMBER": F.col("LOAN_ID")})
    return B.conformance(df)


@query("B3_project_features", "loan_id:i snapshot_date:i remaining_amnt:d dpd_days:i columns:s", """
  select loan_id, snapshot_date, remaining_amnt, dpd_days, 'REMAINING_AMNT,DPD_DAYS' as columns from feed""")
def _b3(spark, sf):
    df = B.project_features(D.loan_feed(spark, sf), ["REMAINING_AMNT", "DPD_DAYS"])
    feats = [c for c in df.columns if c not in contract.META]
    return df.withColumn("columns", F.lit(",".join(feats)))


@query("B5_drop_header_rows", "loan_id:i snapshot_date:i national_code:s", """
  select loan_id, snapshot_date, case when loan_id % 103 = 0 then null else national_code end as national_code
  from feed where loan_id % 101 <> 0""")
def _b5(spark, sf):
    return B.drop_header_rows(D.feed_with_headers(spark, sf))


_TEXT = """t as (
    select l_orderkey as loan_id, l_linenumber, case when l_orderkey % 97 = 0 then cast(l_quantity as varchar) || '/5'
           else cast(l_quantity as varchar) end as qty from lineitem)"""


@query("B6_coerce_features", "loan_id:i l_linenumber:i qty:d disc:d", f"""
  with {_TEXT} select l_orderkey as loan_id, l_linenumber,
       case when l_orderkey % 97 <> 0 then l_quantity end as qty, l_discount as disc from lineitem""")
def _b6(spark, sf):
    return B.coerce_features(D.text_numbers(spark, sf), ["QTY", "DISC"])


@query("B6_coercion_report", "feature:s n_bad:i example:s", f"""
  with {_TEXT} select 'QTY' as feature, count(*) as n_bad, min(qty) as example from t
  where try_cast(qty as double) is null""")
def _b6r(spark, sf):
    return B.coercion_report(D.text_numbers(spark, sf), ["QTY", "DISC"])


@query("B7_drop_unlabelled", "loan_id:i snapshot_date:i worst_future_cat:i", """
  select loan_id, snapshot_date, worst_future_cat from feed_open where worst_future_cat is not null""")
def _b7(spark, sf):
    return B.drop_unlabelled(D.feed_with_open_labels(spark, sf))


@query("B8_capped_labels", "loan_id:i snapshot_date:i current_cat:i label:i", """
  select loan_id, snapshot_date, least(loan_category, 3) as current_cat,
         case when worst_future_cat is not null then least(worst_future_cat, 3) end as label from feed_open""")
def _b8(spark, sf):
    return B.with_capped(D.feed_with_open_labels(spark, sf))


@query("B9_canonical_order", "loan_id:i snapshot_date:i pos:i", """
  select loan_id, snapshot_date, row_number() over (
    order by national_code, snapshot_date, dpd_days desc, loan_id) as pos from feed""")
def _b9(spark, sf):
    from ...functions.position import with_position
    df = D.loan_feed(spark, sf).select("NATIONAL_CODE", "SNAPSHOT_DATE", "DPD_DAYS", "LOAN_ID")
    return with_position(df, B.canonical_order())


_ENGINE = """eng as (
    select r.operation_id, r.snapshot_date, f.loan_id, national_code, dpd_days,
           (2 + 10*least(loan_category, 2) + ((loan_id*7919 + f.snapshot_date) % 1000 * 4 + 50) // 100
            + case when worst_future_cat >= 3 and loan_id % 3 <> 0 then 30 else 0 end) / 100.0 as p3,
           loan_category as dpd_cat, remaining_amnt,
           case when p3 > 0.5 and dpd_days > 120 then 'PENDING_ENRICHMENT' when loan_id % 3 = 0 then 'NOT_APPLICABLE' end as st
    from feed f join runs r using (snapshot_date) where loan_category < 3)"""


@query("B10_engine_predictions", "operation_id:s snapshot_date:i loan_id:i national_code:s current_cat:i "
       "risk_score:d remaining_amnt:d flagged:b", f"""
  with {_ENGINE} select e.operation_id, snapshot_date, e.loan_id, national_code, least(dpd_cat, 3) as current_cat,
    p3 as risk_score, remaining_amnt, coalesce(st <> 'NOT_APPLICABLE', false) as flagged
  from eng e""")
def _b10(spark, sf):
    output = pin(D.engine_output(spark, sf))                # read by the output and by its tracking
    out = output.join(D.tracking_of(output), ["OPERATION_ID", "LOAN_ID"], "left")
    return B.engine_predictions(out, ("OPERATION_ID",))


@query("B11_mature_ranked_rows", "loan_id:i snapshot_date:i", """
  select loan_id, snapshot_date from ranked where snapshot_date in (
    select snapshot_date from ledger order by snapshot_date desc limit 12)""")
def _b11(spark, sf):
    from ...operators.ranking import ranked_population
    newest = E.train_window(_ledger(spark, sf).select("SNAPSHOT_DATE"), 12)
    return ranked_population(E.mature_rows(D.scored(spark, sf), newest))


@query("B12_fill_with_median", "loan_id:i snapshot_date:i upcoming_amnt:d ontime_ratio:d", """
  select loan_id, snapshot_date, coalesce(upcoming_amnt, (select quantile_cont(upcoming_amnt, 0.5) from feed)) as upcoming_amnt,
         coalesce(ontime_ratio, (select quantile_cont(ontime_ratio, 0.5) from feed)) as ontime_ratio from feed""")
def _b12(spark, sf):
    return B.fill_with_median(D.loan_feed(spark, sf), ["UPCOMING_AMNT", "ONTIME_RATIO"])


# ---- feed checks -----------------------------------------------------------------

_CHK = """chk as (
    select loan_id, snapshot_date, loan_category, dpd_days, days_since_last_dpd,
      case when loan_id % 37 = 0 then worst_future_cat - 2 else worst_future_cat end as wfc,
      loan_id % 8 as months, loan_id % 6 as c1, loan_id % 5 as c2, loan_id % 7 - 1 as c3,
      case when dpd_days >= 181 then 1 else 0 end as npl,
      case when loan_id % 13 <> 0 then case when dpd_days >= 184 then 1 else 0 end end as prenpl,
      case when loan_id % 29 = 0 then 0 else days_since_last_dpd end as d30,
      case when loan_id % 31 = 0 then 1 else 99999 end as d60, 100000 as d90,
      case when loan_id % 41 = 0 and snapshot_date > 20000101 then label_horizon_date + 1 else label_horizon_date end as horizon
    from feed_open)"""
_COLS = "rule:s detail:s snapshot_date:i n_bad:i"


def _one(rule, detail, cond):
    return (f"select '{rule}' as rule, '{detail}' as detail, null::bigint as snapshot_date, count(*) as n_bad "
            f"from chk where {cond} having count(*) > 0")


_CHECK_SQL = {
    "label_below_category": _one("label_below_category", "WORST_FUTURE_CAT < LOAN_CATEGORY", "wfc < loan_category"),
    "ladder": " union all ".join([
        _one("ladder", "DAYS_SINCE_LAST_DPD > DAYS_SINCE_LAST_30_DPD", "days_since_last_dpd > d30"),
        _one("ladder", "DAYS_SINCE_LAST_30_DPD > DAYS_SINCE_LAST_60_DPD", "d30 > d60"),
        _one("ladder", "DAYS_SINCE_LAST_60_DPD > DAYS_SINCE_LAST_90_DPD", "d60 > d90")]),
    "months_range": _one("months_range", "MONTHS_IN_CURRENT_CATEGORY outside 1..6", "months < 1 or months > 6"),
    "category_range": " union all ".join(
        _one("category_range", f"{n} outside 0..4", f"{c} < 0 or {c} > 4") for n, c in
        (("CATEGORY_T1", "c1"), ("CATEGORY_T2", "c2"), ("CATEGORY_T3", "c3"), ("WORST_FUTURE_CAT", "wfc"))),
    "npl_nesting": _one("npl_nesting", "NPL without PRE-NPL", "npl = 1 and prenpl is distinct from 1"),
    "horizon_varies": """select 'horizon_varies' as rule, 'LABEL_HORIZON_DATE' as detail, null::bigint as snapshot_date,
        count(*) as n_bad from (select snapshot_date from chk group by 1 having count(distinct horizon) > 1)
        having count(*) > 0""",
    "sentinel_missing": """select 'sentinel_missing' as rule, 'DAYS_SINCE_LAST_90_DPD has no 99999' as detail,
        null::bigint as snapshot_date, count(*) as n_bad from chk having count(*) >= 1000""",
    "label_nullity": """select 'label_nullity' as rule, case when l.snapshot_date is not null
          then 'NULL labels differ from the ledger' else 'open snapshot has labels' end as detail,
        c.snapshot_date, case when l.snapshot_date is not null then abs(nn - coalesce(loans_unlabelled, 0)) else n - nn end as n_bad
        from (select snapshot_date, count(*) as n, count(*) filter (where wfc is null) as nn from chk group by 1) c
        left join ledger l on l.snapshot_date = c.snapshot_date
        where case when l.snapshot_date is not null then abs(nn - coalesce(loans_unlabelled, 0)) else n - nn end > 0""",
}
_IDS = {"label_below_category": "C1", "ladder": "C2", "months_range": "C3", "category_range": "C4",
        "npl_nesting": "C6", "horizon_varies": "C7", "sentinel_missing": "C8"}


def _register_check(rule, cid):
    @query(f"{cid}_{rule}", _COLS, f"with {_CHK} {_CHECK_SQL[rule]}")
    def _(spark, sf):
        return FC.feed_violations(D.checked_feed(spark, sf), rules=(rule,))


for _rule, _cid in _IDS.items():
    _register_check(_rule, _cid)


@query("C5_duplicate_key", _COLS, """
  select 'duplicate_key' as rule, 'LOAN_ID, SNAPSHOT_DATE' as detail, null::bigint as snapshot_date, sum(n - 1) as n_bad
  from (select count(*) as n from lineitem group by l_orderkey, date_trunc('month', l_shipdate))""")
def _c5(spark, sf):
    return FC.feed_violations(D.repeated_keys(spark, sf), rules=("duplicate_key",))


@query("C9_label_nullity", _COLS, """
  with chk as (select snapshot_date, case when snapshot_date > 20010801 then 1 else worst_future_cat end as wfc from feed_open)
  select 'label_nullity' as rule, 'open snapshot has labels' as detail, snapshot_date, count(wfc) as n_bad
  from chk where snapshot_date > 20010501 group by snapshot_date having count(wfc) > 0
  union all
  select 'label_nullity', 'NULL labels differ from the ledger', snapshot_date, abs(count(*) filter (where wfc is null) - max(exp)) from (
    select c.*, coalesce(loans_unlabelled, 0) + case when snapshot_date = 20000301 then 5 else 0 end as exp
    from chk c join ledger using (snapshot_date)) group by snapshot_date
  having abs(count(*) filter (where wfc is null) - max(exp)) > 0""")
def _c9(spark, sf):
    df = D.feed_with_open_labels(spark, sf).withColumn(
        "WORST_FUTURE_CAT", F.when(F.col("SNAPSHOT_DATE") > 20010801, 1).otherwise(F.col("WORST_FUTURE_CAT")))
    led = _ledger(spark, sf).withColumn("LOANS_UNLABELLED", F.col("LOANS_UNLABELLED") + F.when(
        F.col("SNAPSHOT_DATE") == 20000301, 5).otherwise(0))
    return FC.feed_violations(df, led, rules=("label_nullity",))


def _each(rule, detail, n_bad, more=""):
    return f"select '{rule}' as rule, '{detail}' as detail, snapshot_date, {n_bad} as n_bad from fin group by snapshot_date having {n_bad} > 0 {more}"


_FIN = f"{_CHK}, fin as (select * from chk where snapshot_date in (select snapshot_date from ledger))"
_WATCH_SQL = " union all ".join([
    _each("label_below_category", "WORST_FUTURE_CAT < LOAN_CATEGORY", "count_if(wfc < loan_category)"),
    _each("ladder", "DAYS_SINCE_LAST_DPD > DAYS_SINCE_LAST_30_DPD", "count_if(days_since_last_dpd > d30)"),
    _each("ladder", "DAYS_SINCE_LAST_30_DPD > DAYS_SINCE_LAST_60_DPD", "count_if(d30 > d60)"),
    _each("ladder", "DAYS_SINCE_LAST_60_DPD > DAYS_SINCE_LAST_90_DPD", "count_if(d60 > d90)"),
    _each("months_range", "MONTHS_IN_CURRENT_CATEGORY outside 1..6", "count_if(months < 1 or months > 6)"),
    *[_each("category_range", f"{n} outside 0..4", f"count_if({c} < 0 or {c} > 4)") for n, c in
      (("CATEGORY_T1", "c1"), ("CATEGORY_T2", "c2"), ("CATEGORY_T3", "c3"), ("WORST_FUTURE_CAT", "wfc"))],
    _each("npl_nesting", "NPL without PRE-NPL", "count_if(npl = 1 and prenpl is distinct from 1)"),
    _each("null_in_required", "HAS_EVER_BEEN_PRENPL", "count_if(prenpl is null)"),
    _each("horizon_varies", "LABEL_HORIZON_DATE", "case when min(horizon) <> max(horizon) then 1 else 0 end"),
    *[_each("sentinel_missing", f"{n} has no 99999", f"case when count(*) >= 1000 and count_if({c} = 99999) = 0 then count(*) else 0 end")
      for n, c in (("DAYS_SINCE_LAST_DPD", "days_since_last_dpd"), ("DAYS_SINCE_LAST_30_DPD", "d30"),
                   ("DAYS_SINCE_LAST_60_DPD", "d60"), ("DAYS_SINCE_LAST_90_DPD", "d90"))],
    """select 'label_nullity', 'NULL labels differ from the ledger', f.snapshot_date, abs(count(*) filter (where wfc is null) - max(coalesce(loans_unlabelled, 0)))
       from fin f join ledger l on l.snapshot_date = f.snapshot_date group by f.snapshot_date
       having abs(count(*) filter (where wfc is null) - max(coalesce(loans_unlabelled, 0))) > 0"""])


@query("C_watched_store", _COLS, f"with {_FIN} {_WATCH_SQL}")
def _cw(spark, sf):
    """What the store noted about its snapshots while it was filled."""
    path = _fresh(spark, "watched")
    S.store_mature(pin(D.checked_feed(spark, sf)), pin(_ledger(spark, sf)), path)
    return S.SnapshotStore(spark, path).violations()


@query("C_all_rules", _COLS, f"with {_CHK} " + " union all ".join(_CHECK_SQL.values()))
def _call(spark, sf):
    return FC.feed_violations(D.checked_feed(spark, sf), _ledger(spark, sf))
