"""Queries for grain (D), maturity and splits (E) and preprocessing (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ... import contract
from ...operators import grain as G
from ...operators import maturity as E
from ...operators.preprocess import Preprocessor, feature_counts
from ...session import pin
from ...sources import derived as D
from ...sources.tables import label_ledger
from ..registry import query

FEATS = D.FEED_FEATURES
LOW = [f.lower() for f in FEATS]
MAX_LOANS = 2


def ledger(spark, sf):
    return label_ledger(D.ledger_table(spark, sf))


def mature(spark, sf):
    return E.mature_snapshots(D.snapshots(spark, sf), ledger(spark, sf))


# ---- grain -----------------------------------------------------------------------

@query("D1_loan_grain", "loan_id:i snapshot_date:i n_loans_in_portfolio:i", """
  select loan_id, snapshot_date, count(*) over (partition by national_code, snapshot_date) as n_loans_in_portfolio from feed""")
def _d1(spark, sf):
    return G.loan_rows(D.loan_feed(spark, sf))


@query("D2_portfolio_grain", "national_code:s snapshot_date:i n_loans:i current_cat:i label:i", """
  select national_code, snapshot_date, count(*) as n_loans, least(max(loan_category), 3) as current_cat,
         least(max(worst_future_cat), 3) as label from feed group by 1, 2""")
def _d2(spark, sf):
    return G.portfolio_rows(D.loan_feed(spark, sf))


@query("D3_worst_loans", "national_code:s snapshot_date:i loan_id:i dpd_days:i", f"""
  select national_code, snapshot_date, loan_id, dpd_days from feed
  qualify row_number() over (partition by national_code, snapshot_date order by dpd_days desc, loan_id) <= {MAX_LOANS}""")
def _d3(spark, sf):
    return G.worst_loans(D.loan_feed(spark, sf), MAX_LOANS)


_AGG = ", ".join(f"min({f}) as min_{f}, max({f}) as max_{f}, avg({f}) as mean_{f}, stddev_pop({f}) as std_{f}"
                 for f in LOW)
_AGG_COLS = " ".join(f"{s}_{f}:d" for s in ("min", "max", "mean", "std") for f in LOW)


@query("D4_portfolio_features", f"national_code:s snapshot_date:i current_cat:i label:i n_loans:i {_AGG_COLS}", f"""
  select national_code, snapshot_date, least(max(loan_category), 3) as current_cat,
         least(max(worst_future_cat), 3) as label, count(*) as n_loans, {_AGG} from feed group by 1, 2""")
def _d4(spark, sf):
    return G.portfolio_features(D.loan_feed(spark, sf), FEATS)


@query("D4_truncated_portfolio_features", "national_code:s snapshot_date:i n_loans:i min_dpd_days:d mean_remaining_amnt:d", f"""
  with r as (select *, row_number() over (partition by national_code, snapshot_date order by dpd_days desc, loan_id) as rn from feed)
  select national_code, snapshot_date, count(*) as n_loans, min(dpd_days) filter (rn <= {MAX_LOANS}) as min_dpd_days,
         avg(remaining_amnt) filter (rn <= {MAX_LOANS}) as mean_remaining_amnt from r group by 1, 2""")
def _d4t(spark, sf):
    return G.portfolio_features(D.loan_feed(spark, sf), ["DPD_DAYS", "REMAINING_AMNT"], MAX_LOANS)


@query("D5_loan_features", "loan_id:i snapshot_date:i n_loans_in_portfolio:i " + " ".join(f"{f}:d" for f in LOW), f"""
  select loan_id, snapshot_date, count(*) over (partition by national_code, snapshot_date) as n_loans_in_portfolio,
         {', '.join(LOW)} from feed""")
def _d5(spark, sf):
    return G.build_features(D.loan_feed(spark, sf), FEATS, "loan")


@query("D6_portfolio_means", "national_code:s snapshot_date:i label:i " + " ".join(f"{f}:d" for f in LOW), f"""
  select national_code, snapshot_date, least(max(worst_future_cat), 3) as label,
         {', '.join(f'avg({f}) as {f}' for f in LOW)} from feed group by 1, 2""")
def _d6(spark, sf):
    return G.portfolio_means(D.loan_feed(spark, sf), FEATS)


@query("D7_loans_per_customer", "stat:s v:i", """
  with c as (select national_code, count(*) as n from feed group by 1)
  select 'p99' as stat, floor(quantile_cont(n, 0.99)) as v from c union all select 'max', max(n) from c""")
def _d7(spark, sf):
    return G.loans_per_customer(D.loan_feed(spark, sf))


@query("D8_customer_max", "loan_id:i snapshot_date:i customer_max_risk_score:d", """
  select loan_id, snapshot_date, max(score) over (partition by national_code, snapshot_date) as customer_max_risk_score from scored""")
def _d8(spark, sf):
    from ...operators.queue import with_customer_max
    return with_customer_max(D.scored(spark, sf), "SCORE")


@query("D9_exposure", "national_code:s snapshot_date:i exposure:d", """
  select national_code, snapshot_date, sum(remaining_amnt) as exposure from feed group by 1, 2""")
def _d9(spark, sf):
    return G.portfolio_rows(D.loan_feed(spark, sf), exposure=C.EXPOSURE_FEATURE).withColumn(
        "EXPOSURE", F.round("EXPOSURE", 2))


# ---- maturity and splits -----------------------------------------------------------

_GAP = "date_diff('day', strptime(cast({0} as varchar), '%Y%m%d'), strptime(cast({1} as varchar), '%Y%m%d'))/30.4375"


def gap(a, b):
    return _GAP.format(a, b)


@query("E1_mature_snapshots", "snapshot_date:i",
       "select snapshot_date from snaps where snapshot_date in (select snapshot_date from ledger)")
def _e1(spark, sf):
    return mature(spark, sf)


@query("E2_label_status", "snapshot_date:i label_status:s is_open:b", """
  select s.snapshot_date, l.status as label_status, l.status is null as is_open from snaps s left join ledger l using (snapshot_date)""")
def _e2(spark, sf):
    snaps, led = D.snapshots(spark, sf), ledger(spark, sf)
    still_open = E.open_snapshots(snaps, led).withColumn("is_open", F.lit(True))
    return E.with_label_status(snaps, led).join(still_open, "SNAPSHOT_DATE", "left").fillna({"is_open": False})


@query("E3_train_window", "side:s snapshot_date:i", """
  (select 'newest' as side, snapshot_date from ledger order by snapshot_date desc limit 6)
  union all (select 'oldest', snapshot_date from ledger order by snapshot_date limit 6)""")
def _e3(spark, sf):
    m = mature(spark, sf)
    return (E.train_window(m, 6).select(F.lit("newest").alias("side"), "SNAPSHOT_DATE")
            .unionByName(E.train_window(m, -6).select(F.lit("oldest").alias("side"), "SNAPSHOT_DATE")))


_BUCKET = "(cast('0x' || substr(md5('42:' || national_code), 1, 8) as bigint)::double / 4294967295)"

_SPLIT = f"""t as (select max(snapshot_date) as test from ledger),
  roles as (select snapshot_date, case when snapshot_date = test then 'test'
                 when {gap('snapshot_date', 'test')} >= 6 then 'train' else 'gap' end as role from ledger, t)"""


@query("E4_split_roles", "snapshot_date:i role:s", f"with {_SPLIT} select snapshot_date, role from roles")
def _e4(spark, sf):
    return E.static_roles(mature(spark, sf))


@query("E4_split_roles_temporal", "snapshot_date:i role:s", f"""
  with t as (select max(snapshot_date) as test from ledger),
  v as (select max(snapshot_date) as val from ledger, t where snapshot_date < test),
  e as (select snapshot_date, row_number() over (order by snapshot_date desc) as r from ledger, v
        where snapshot_date < val and {gap('snapshot_date', 'val')} >= 6)
  select l.snapshot_date, case when l.snapshot_date = test then 'test' when l.snapshot_date = val then 'val'
       when r <= 10 then 'train' when r > 10 then 'unused' else 'gap' end as role
  from ledger l cross join t cross join v left join e on e.snapshot_date = l.snapshot_date""")
def _e4t(spark, sf):
    return E.static_roles(mature(spark, sf), "temporal", window=10)


@query("E4_split_rows", "loan_id:i snapshot_date:i split:s", f"""
  with {_SPLIT} select loan_id, f.snapshot_date, case when role = 'train' and {_BUCKET} < 0.2 then 'val' else role end as split
  from feed f join roles using (snapshot_date) where role <> 'gap'""")
def _e4r(spark, sf):
    return E.split_rows(D.loan_feed(spark, sf), E.static_roles(mature(spark, sf)))


@query("E5_final_fit_rows", "loan_id:i snapshot_date:i split:s", f"""
  select loan_id, snapshot_date, case when {_BUCKET} < 0.2 then 'val' else 'train' end as split
  from feed where snapshot_date in (select snapshot_date from ledger)""")
def _e5(spark, sf):
    return E.split_rows(D.loan_feed(spark, sf), E.final_roles(mature(spark, sf)))


@query("E6_customer_bucket", "national_code:s bucket:d is_val:b", f"""
  select distinct national_code, {_BUCKET} as bucket, {_BUCKET} < 0.2 as is_val from feed""")
def _e6(spark, sf):
    from ...functions.columns import customer_bucket
    codes = D.loan_feed(spark, sf).select("NATIONAL_CODE").distinct()
    return codes.withColumns({"bucket": customer_bucket(F.col("NATIONAL_CODE")),
                              "is_val": E.in_validation(F.col("NATIONAL_CODE"))})


_FOLDS = f"""pairs as (select v.snapshot_date as val, t.snapshot_date as test from ledger v join ledger t
        on v.snapshot_date < t.snapshot_date and {gap('v.snapshot_date', 't.snapshot_date')} >= 6),
  tr as (select val, test, s.snapshot_date as train from pairs join ledger s
        on s.snapshot_date < val and {gap('s.snapshot_date', 'val')} >= 6),
  folds as (select row_number() over (order by test, val) as fold_id, val as val_snap, test as test_snap, n_train, oldest
        from (select val, test, count(*) as n_train, min(train) as oldest from tr group by 1, 2 having count(*) >= 12))"""


@query("E7_walk_forward_folds", "fold_id:i val_snap:i test_snap:i n_train:i oldest:i",
       f"with {_FOLDS} select * from folds")
def _e7(spark, sf):
    return E.walk_forward_folds(mature(spark, sf), min_train=12).withColumns({
        "n_train": F.size("TRAIN_SNAPS"), "oldest": F.array_min("TRAIN_SNAPS")})


@query("E7_windowed_folds", "fold_id:i val_snap:i test_snap:i n_train:i oldest:i", f"""
  with {_FOLDS.replace('count(*) >= 12', 'count(*) >= 1')},
  w as (select f.fold_id, f.val_snap, f.test_snap, train, row_number() over (partition by fold_id order by train desc) as r
        from folds f join tr on tr.val = f.val_snap and tr.test = f.test_snap)
  select fold_id, val_snap, test_snap, count(*) as n_train, min(train) as oldest from w where r <= 6 group by 1, 2, 3""")
def _e7w(spark, sf):
    return E.walk_forward_folds(mature(spark, sf), min_train=1, window=6).withColumns({
        "n_train": F.size("TRAIN_SNAPS"), "oldest": F.array_min("TRAIN_SNAPS")})


@query("E8_fold_rows", "fold_id:i split:s n_rows:i n_severe:i", f"""
  with {_FOLDS},
  r as (select fold_id, 'val' as split, val_snap as s from folds union all select fold_id, 'test', test_snap from folds
        union all select fold_id, 'train', train from folds join tr on tr.val = val_snap and tr.test = test_snap),
  x as (select snapshot_date, count(*) as n, sum(sev) as k from scored group by 1)
  select fold_id, split, sum(n) as n_rows, sum(k) as n_severe from r join x on s = snapshot_date group by 1, 2""")
def _e8(spark, sf):
    per = D.scored(spark, sf).groupBy("SNAPSHOT_DATE").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("LABEL") == C.SEVERE).alias("k"))
    folds = E.walk_forward_folds(mature(spark, sf), min_train=12)
    return E.fold_rows(per, folds).groupBy("FOLD_ID", "SPLIT").agg(
        F.sum("n").alias("n_rows"), F.sum("k").alias("n_severe"))


@query("E9_vintage_counts", "split:s status:s n_snapshots:i", f"""
  with {_SPLIT}, r as (select distinct f.snapshot_date, case when role = 'train' and {_BUCKET} < 0.2 then 'val' else role end as split
     from feed f join roles using (snapshot_date) where role <> 'gap')
  select split, status, count(*) as n_snapshots from r join ledger using (snapshot_date) group by 1, 2""")
def _e9(spark, sf):
    rows = E.split_rows(D.loan_feed(spark, sf), E.static_roles(mature(spark, sf)))
    return E.vintage_counts(rows, ledger(spark, sf))


# ---- preprocessing -------------------------------------------------------------------

_DAYS = [f for f in FEATS if f.startswith("DAYS_SINCE")]
_MED = [f for f in FEATS if f not in _DAYS and ("AMNT" in f or "RATIO" in f)]
_CLIP = [f for f in FEATS if f not in contract.BINARY and f not in contract.NO_CLIP]
_SAMPLED = [f for f in _CLIP if f not in contract.CLIP_BOUNDS]
_SCALE = [f for f in FEATS if f not in contract.BINARY and f not in contract.NO_SCALE]


def _fill(f):
    c = f.lower()
    if f in _DAYS:
        return f"coalesce(max({c}) + 1, 9999)"
    return f"coalesce(quantile_cont({c}, 0.5), 0)" if f in _MED else "0"


def prep_sql(train: str, apply: str) -> str:
    """CTEs fl (fills), im (imputed), bd (bounds), cl (clipped), sc, out."""
    fl = ", ".join(f"{_fill(f)} as {f.lower()}" for f in FEATS)

    def imputed(src):
        cols = ", ".join(f"coalesce(cast(x.{c} as double), fl.{c}) as {c}" for c in LOW)
        return f"select x.loan_id, x.snapshot_date, {cols} from {src} x, fl"
    bd = ", ".join(f"quantile_cont({f.lower()}, 0.01) as lo_{f.lower()}, quantile_cont({f.lower()}, 0.99) as hi_{f.lower()}"
                   if f in _SAMPLED else f"0.0 as lo_{f.lower()}, 1.0 as hi_{f.lower()}" for f in _CLIP)

    def clipped(src):
        cols = ", ".join(f"greatest(lo_{f.lower()}, least(hi_{f.lower()}, {f.lower()})) as {f.lower()}" if f in _CLIP
                         else f.lower() for f in FEATS)
        return f"select loan_id, snapshot_date, {cols} from {src}, bd"
    sc = ", ".join(f"quantile_cont({f.lower()}, 0.5) as c_{f.lower()}, "
                   f"case when quantile_cont({f.lower()}, 0.75) = quantile_cont({f.lower()}, 0.25) then 1.0 "
                   f"else quantile_cont({f.lower()}, 0.75) - quantile_cont({f.lower()}, 0.25) end as s_{f.lower()}"
                   for f in _SCALE)
    done = ", ".join(f"({f.lower()} - c_{f.lower()})/s_{f.lower()} as {f.lower()}" if f in _SCALE else f.lower()
                     for f in FEATS)
    return f"""fl as (select {fl} from {train}), im as ({imputed(train)}), bd as (select {bd} from im),
      cl as ({clipped('im')}), sc as (select {sc} from cl),
      im2 as ({imputed(apply)}), cl2 as ({clipped('im2')}),
      done as (select loan_id, snapshot_date, {done} from cl2, sc)"""


_TRAIN = f"train as (select f.* from feed f join roles using (snapshot_date) where role = 'train' and {_BUCKET} >= 0.2)"
_PREP = f"with {_SPLIT}, {_TRAIN}, {prep_sql('train', 'feed')}"
_ROW = "loan_id:i snapshot_date:i " + " ".join(f"{f}:d" for f in LOW)


def train_rows(spark, sf):
    rows = E.split_rows(D.loan_feed(spark, sf), E.static_roles(mature(spark, sf)))
    return rows.where("SPLIT = 'train'").select("LOAN_ID", "SNAPSHOT_DATE", *FEATS)


def _unpivot(cte, cols):
    return " union all ".join(f"select '{f}' as feature, {c.format(f.lower())} from {cte}" for f, c in cols)


@query("F1_imputer_fit", "feature:s fill:d", f"{_PREP} " + _unpivot("fl", [(f, "{0} as fill") for f in FEATS]))
def _f1(spark, sf):
    return _fitted(spark, sf, 1).to_frame(spark)


@query("F2_impute", _ROW, f"{_PREP} select * from im2")
def _f2(spark, sf):
    p = _fitted(spark, sf, 1)
    return p.impute(D.loan_feed(spark, sf))


def _fitted(spark, sf, steps):
    counts = pin(feature_counts(train_rows(spark, sf), FEATS))       # read by every fit
    p = Preprocessor(FEATS).fit_fill(counts)
    imputed = p.imputed_counts(counts)
    if steps > 1:
        p.fit_bounds(imputed)
    if steps > 2:
        p.fit_scale(p.clipped_counts(imputed))
    return p


@query("F3_clipper_fit", "feature:s lo:d hi:d",
       f"{_PREP} " + _unpivot("bd", [(f, "lo_{0} as lo, hi_{0} as hi") for f in _CLIP]))
def _f3(spark, sf):
    return _fitted(spark, sf, 2).to_frame(spark).where("lo is not null")


@query("F4_clip", _ROW, f"{_PREP} select * from cl2")
def _f4(spark, sf):
    p = _fitted(spark, sf, 2)
    return p.clip(p.impute(D.loan_feed(spark, sf)))


@query("F5_scaler_fit", "feature:s center:d scale:d",
       f"{_PREP} " + _unpivot("sc", [(f, "c_{0} as center, s_{0} as scale") for f in _SCALE]))
def _f5(spark, sf):
    return _fitted(spark, sf, 3).to_frame(spark).where("scale is not null")


@query("F6_scale", _ROW, f"{_PREP} select * from done")
def _f6(spark, sf):
    p = _fitted(spark, sf, 3)
    return p.rescale(p.clip(p.impute(D.loan_feed(spark, sf))))


@query("F7_preprocess_pipeline", _ROW, f"{_PREP} select * from done")
def _f7(spark, sf):
    """Fit on train, keep the statistics as a table, read them back, transform all."""
    fitted = Preprocessor(FEATS).fit(train_rows(spark, sf))
    p = Preprocessor.from_frame(fitted.to_frame(spark))
    return p.transform(D.loan_feed(spark, sf), FEATS)
