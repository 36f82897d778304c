"""Queries for the table diagnostics: IV (O), bands (P), clip (Q), drift and
walk-forward (R), profile (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ... import contract
from ...operators import classify as L
from ...operators import grain as G
from ...operators import maturity as E
from ...operators import ranking as K
from ...operators.clean import with_capped
from ...operators.explore import bands as P
from ...operators.explore import clip as Q
from ...operators.explore import drift as R
from ...operators.explore import iv as O
from ...operators.explore import profile as S
from ...operators.explore import walkforward as W
from ...session import pin
from ...sources import derived as D
from ...sources.tables import label_ledger, score_table
from ..registry import query
from .evaluate import _DEC, decided
from .shape import FEATS, LOW


def ledger(spark, sf):
    return label_ledger(D.ledger_table(spark, sf))


def mature_feed(spark, sf):
    return with_capped(E.mature_rows(D.loan_feed(spark, sf), ledger(spark, sf)))


# ---- information value -------------------------------------------------------------

_LONG = "long as (" + " union all ".join(
    f"select '{f}' as feature, cast({f.lower()} as double) as v, least(worst_future_cat, 3) as y from feed "
    f"where snapshot_date in (select snapshot_date from ledger)" for f in FEATS) + ")"
_QS = "[" + ", ".join(f"{i/10}" for i in range(11)) + "]::double[]"
_IV = f"""{_LONG},
  vc as (select feature, v, count(*) as n, {', '.join(f'count(*) filter (y = {k}) as n{k}' for k in range(4))}
         from long where v is not null group by 1, 2),
  sz as (select feature, sum(n) as rows, count(*) as dv, list(v order by v) as vals from vc group by 1 having sum(n) >= 10 and count(*) >= 2),
  eg as (select feature, list_sort(list_distinct(quantile_cont(v, {_QS}))) as edges, quantile_cont(v, 0.5) as med from long where v is not null group by 1),
  sb as (select l.feature, list_sort(list_distinct(quantile_cont(v, {_QS}))) as sub from long l join eg using (feature) join sz using (feature)
         where dv > 10 and len(edges) < 3 and v <> med group by 1),
  sp as (select feature, case when dv <= 10 then vals[2:] when sub is null then edges[2:-2] else sub[2:-2] end as inr,
                case when sub is not null then med end as mode
         from sz join eg using (feature) left join sb using (feature)),
  bn as (select feature, case when mode is null then len(list_filter(inr, lambda e: e <= v)) when v = mode then 0
                else 1 + len(list_filter(inr, lambda e: e <= v)) end as bin, sum(n) as cnt, {', '.join(f'sum(n{k}) as n{k}' for k in range(4))}
         from vc join sp using (feature) group by 1, 2),
  ev as (select feature, bin, cnt, c as class, case c when 0 then n0 when 1 then n1 when 2 then n2 else n3 end as event from bn, range(4) r(c)),
  d as (select *, greatest(event::double, 0.5)/greatest(sum(event) over w, 1) as de, greatest((cnt - event)::double, 0.5)/greatest(sum(cnt - event) over w, 1) as dn
        from ev window w as (partition by feature, class)),
  woe as (select *, ln(greatest(de/dn, 1e-9)) as woe, (de - dn)*ln(greatest(de/dn, 1e-9)) as ivc from d)"""


@query("O1_bins", "feature:s bin:i n:i", f"with {_IV} select feature, bin, cnt as n from bn")
def _o1(spark, sf):
    counts = pin(O.value_counts(mature_feed(spark, sf), FEATS))
    return O.woe_bins(counts, O.bins(counts)).where("class = 0").withColumn("n", F.col("count"))


@query("O2_woe", "feature:s class:i bin:i count:i event:i woe:d iv_contribution:d",
       f"with {_IV} select feature, class, bin, cnt as count, event, woe, ivc as iv_contribution from woe")
def _o2(spark, sf):
    counts = pin(O.value_counts(mature_feed(spark, sf), FEATS))
    return O.woe_bins(counts, O.bins(counts))


_IVT = f"""{_IV}, s4 as (select feature, class, sum(ivc) as iv from woe group by 1, 2),
  fx as (select unnest([{', '.join(f"'{f}'" for f in FEATS)}]) as feature),
  ivs as (select f.feature, {', '.join(f'round(coalesce(max(iv) filter (class = {k}), 0), 5) as iv_ovr{k}' for k in range(4))},
    round(coalesce(max(iv), 0), 5) as iv_max, round(coalesce(sum(iv), 0)/4, 5) as iv_mean from fx f left join s4 using (feature) group by 1)"""


@query("O3_information_values", "feature:s iv_ovr0:d iv_ovr1:d iv_ovr2:d iv_ovr3:d iv_max:d iv_mean:d",
       f"with {_IVT} select * from ivs")
def _o3(spark, sf):
    return O.information_values(mature_feed(spark, sf), FEATS)


@query("O3_iv_coverage", "target:s strong:i medium:i useless:i", f"with {_IVT} " + " union all ".join(
    f"select 'iv_ovr{k}' as target, count(*) filter (iv_ovr{k} >= 0.10) as strong, "
    f"count(*) filter (iv_ovr{k} >= 0.02 and iv_ovr{k} < 0.10) as medium, count(*) filter (iv_ovr{k} < 0.02) as useless from ivs"
    for k in range(4)))
def _o3c(spark, sf):
    return O.coverage(O.information_values(mature_feed(spark, sf), FEATS))


# ---- bands and skim -----------------------------------------------------------------

def scores(spark, sf):
    return score_table(decided(spark, sf).withColumnsRenamed(
        {"LABEL": "y_true", "CURRENT_CAT": "current_cat", "PREDICTED_CLASS": "pred_class"}))


_SC = f"{_DEC}, sc as (select loan_id, snapshot_date, m3 as risk, current_cat, label as y_true, cost_pred as pred_class, sev from dec)"
_PL = f"{_SC}, pl as (select *, row_number() over (order by risk desc, loan_id, snapshot_date) as pos, count(*) over () as n from sc where current_cat < 3)"


@query("P1_population", "population:s n:i hours_to_call_all:d n_severe_label:i severe_rate:d", """
  with x as (select case when current_cat >= 3 then 'rule-flagged (ALREADY_SEVERE)' else 'ranked queue' end as population, sev from scored
             union all select 'all rows', sev from scored)
  select population, count(*) as n, count(*)/240.0 as hours_to_call_all, sum(sev) as n_severe_label, avg(sev) as severe_rate from x group by 1""")
def _p1(spark, sf):
    return P.population_summary(scores(spark, sf))


@query("P2_class_crosstab", "y_true:i pred_0:i pred_1:i pred_2:i pred_3:i n:i mean_risk:d risk_p50:d risk_p90:d risk_p99:d", f"""
  {_SC} select y_true, {', '.join(f'count(*) filter (pred_class = {k}) as pred_{k}' for k in range(4))}, count(*) as n, avg(risk) as mean_risk,
    quantile_cont(risk, 0.5) as risk_p50, quantile_cont(risk, 0.9) as risk_p90, quantile_cont(risk, 0.99) as risk_p99
  from sc where current_cat < 3 group by 1""")
def _p2(spark, sf):
    return P.class_crosstab(scores(spark, sf))


@query("P3_bands", "band:i risk_hi:d risk_lo:d n:i n_severe:i precision:d lift:d share_of_severe:d cum_recall:d cum_hours:d", f"""
  {_PL}, b as (select *, ntile(20) over (order by pos) as band from pl),
  g as (select band, max(risk) as risk_hi, min(risk) as risk_lo, count(*) as n, sum(sev) as n_severe from b group by 1)
  select band, risk_hi, risk_lo, n, n_severe, n_severe::double/n as precision,
    (n_severe::double/n)/((sum(n_severe) over ())::double/(sum(n) over ())) as lift, n_severe::double/(sum(n_severe) over ()) as share_of_severe,
    (sum(n_severe) over (order by band))::double/(sum(n_severe) over ()) as cum_recall, (sum(n) over (order by band))/240.0 as cum_hours from g""")
def _p3(spark, sf):
    return P.band_table(scores(spark, sf), 20)


_P4W = ", ".join(
    f"sum(case when pos > na and pos <= na + least({240*h}, n - na) then sev else 0 end)::double/greatest(max(ts) - max(acs), 1) as api_recall_{w}, "
    f"(max(acs) + sum(case when pos > na and pos <= na + least({240*h}, n - na) then sev else 0 end))::double/greatest(max(ts), 1) as combined_{w}"
    for w, h in C.REF_WINDOWS.items())


@query("P4_skim", "threshold:d n_acted:i acted_precision:d hours_saved:d acted_recall:d n_queue_after:i severe_left:i " + " ".join(
    f"api_recall_{w}:d combined_{w}:d" for w in C.REF_WINDOWS) + " hours_to_50pct_left:d hours_to_80pct_left:d", f"""
  {_PL}, qv as (select distinct unnest(quantile_cont(risk, {list(C.SKIM_QUANTILES)}::double[])) as t from pl),
  run as (select *, sum(sev) over (order by pos) as hits, sum(sev) over () as ts from pl),
  th as (select t, count(*) filter (risk >= t) as na, sum(case when risk >= t then sev else 0 end) as acs from qv, pl group by 1),
  x as (select * from th, run)
  select t as threshold, max(na) as n_acted, max(acs)::double/nullif(max(na), 0) as acted_precision, max(na)/240.0 as hours_saved,
    max(acs)::double/greatest(max(ts), 1) as acted_recall, max(n) - max(na) as n_queue_after, max(ts) - max(acs) as severe_left, {_P4W},
    min(case when pos > na and hits - acs >= 0.5*greatest(ts - acs, 1) then pos - na end)/240.0 as hours_to_50pct_left,
    min(case when pos > na and hits - acs >= 0.8*greatest(ts - acs, 1) then pos - na end)/240.0 as hours_to_80pct_left
  from x group by t""")
def _p4(spark, sf):
    return P.skim_simulation(scores(spark, sf))


# ---- clip impact ----------------------------------------------------------------------

_CLIPPED = [f for f in FEATS if f not in contract.BINARY]


def _fill(f):
    c = f.lower()
    if f.startswith("DAYS_SINCE"):
        return f"(select max({c}) + 1 from mf)"
    return f"(select coalesce(quantile_cont({c}, 0.5), 0) from mf)" if "AMNT" in f or "RATIO" in f else "0"


_STR = ["", "_cat0", "_cat1", "_cat2"]
_CL = "mf as (select * from feed where snapshot_date in (select snapshot_date from ledger)), cl as (" + " union all ".join(
    f"select '{f}' as feature, coalesce(cast({f.lower()} as double), {_fill(f)}) as v, {f.lower()} is null as isn, "
    f"least(loan_category, 3) as cat, case when worst_future_cat >= 3 then 1 else 0 end as sev from mf" for f in _CLIPPED) + f"""),
  bd as (select feature, case when feature in ({', '.join(f"'{f}'" for f in contract.CLIP_BOUNDS)}) then 0.0 else quantile_cont(v, 0.01) end as p1,
                case when feature in ({', '.join(f"'{f}'" for f in contract.CLIP_BOUNDS)}) then 1.0 else quantile_cont(v, 0.99) end as p99 from cl group by 1),
  cx as (select cl.*, p1, p99, v > p99 as hi, v < p1 as lo from cl join bd using (feature))"""


def _mask(s):
    return "cat < 3" if not s else f"cat = {s[-1]}"


def _lifts():
    out = []
    for s in _STR:
        base = f"nullif(avg(sev) filter ({_mask(s)}), 0)"
        out += [f"avg(sev) filter ({_mask(s)} and hi)/{base} as tail_lift{s}", f"avg(sev) filter ({_mask(s)} and lo)/{base} as head_lift{s}"]
        if s:
            out += [f"count(*) filter ({_mask(s)} and hi) as n_hi{s}", f"count(*) filter ({_mask(s)} and lo) as n_lo{s}"]
    return ", ".join(out)


_GR = "rg as (" + " union all ".join(
    f"select feature, '{side}' as side, '{s}' as sl, v, sev from cx where {cond} and {_mask(s)}"
    for s in _STR for side, cond in (("tail", "hi"), ("head", "lo"))) + """),
  gc as (select feature, side, sl, quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from rg group by 1, 2, 3),
  gz as (select r.*, a, b, case when side = 'tail' then v >= b else v <= a end as far, case when side = 'tail' then v <= a else v >= b end as near
         from rg r join gc using (feature, side, sl)),
  gr as (select feature, side, sl, case when count(*) >= 200 and max(a) < max(b)
            and sum(sev) filter (far) + sum(sev) filter (near) >= 100 then avg(sev) filter (far)/nullif(avg(sev) filter (near), 0) end as g
         from gz group by 1, 2, 3)"""
_REP = f"""{_CL}, {_GR}, r0 as (select feature, max(p1) as p1, max(p99) as p99, max(v) as max, avg(isn::int) as pct_null,
    count(*) filter (hi) as n_hi, count(*) filter (lo) as n_lo, avg(hi::int) as pct_hi, avg(lo::int) as pct_lo,
    avg((v = p99)::int) as pct_tied_hi, avg((v = p1)::int) as pct_tied_lo, count(distinct case when hi then v end) as n_merged,
    case when max(p99) > max(p1) then greatest(0.0, (max(v) - max(p99))/(max(p99) - max(p1))) end as tail_span, {_lifts()} from cx group by 1),
  g1 as (select feature, {', '.join(f"max(g) filter (side = '{sd}' and sl = '{s}') as {sd}_gradient{s}" for sd in ('tail', 'head') for s in _STR)} from gr group by 1),
  rep0 as (select r0.*, g1.* exclude (feature), feature in ({', '.join(f"'{f}'" for f in sorted(contract.NO_CLIP))}) as exempt
           from r0 left join g1 using (feature)),
  rep as (select *, {{verdicts}} from rep0)"""


def _verdict(side):
    e = "hi" if side == "tail" else "lo"
    ramp = " or ".join([f"coalesce({side}_gradient > 1.5, false)"] + [
        f"(n_{e}{s} >= 200 and coalesce({side}_gradient{s} > 1.5, false))" for s in _STR[1:]])
    info = " or ".join([f"coalesce({side}_lift > 1.5 or {side}_lift < 1.0/1.5::double, false)"] + [
        f"(n_{e}{s} >= 200 and coalesce({side}_lift{s} > 1.5 or {side}_lift{s} < 1.0/1.5::double, false))" for s in _STR[1:]])
    sw = f"(({info}) and pct_tied_{e} >= 0.5*pct_{e})"
    return (f"case when pct_{e} <= 0 then 'none' when n_{e} < 200 then 'tiny' when ({ramp}) and {sw} then 'ramp+swamped' "
            f"when {ramp} then 'ramp' when {sw} then 'swamped' when {info} then 'block' else 'inert' end as {side}_verdict")


_REP = _REP.replace("{verdicts}", _verdict("tail") + ", " + _verdict("head"))


def report(spark, sf):
    return Q.with_verdicts(Q.clip_report(mature_feed(spark, sf), FEATS, include_exempt=True))


@query("Q1_null_fractions", "feature:s pct_null:d", f"with {_REP} select * from rep")
def _q1(spark, sf):
    return Q.null_fractions(mature_feed(spark, sf), _CLIPPED)


@query("Q2_clip_bounds", "feature:s exempt:b p1:d p99:d max:d pct_null:d n_hi:i n_lo:i pct_hi:d pct_lo:d pct_tied_hi:d "
       "pct_tied_lo:d n_merged:i tail_span:d", f"with {_REP} select * from rep")
def _q2(spark, sf):
    return report(spark, sf)


@query("Q3_clip_lifts", "feature:s tail_lift:d head_lift:d", f"with {_REP} select * from rep")
def _q3(spark, sf):
    return report(spark, sf)


@query("Q4_clip_gradients", "feature:s tail_gradient:d head_gradient:d", f"with {_REP} select * from rep")
def _q4(spark, sf):
    return report(spark, sf)


@query("Q5_clip_by_category", "feature:s " + " ".join(
    f"tail_lift{s}:d head_lift{s}:d tail_gradient{s}:d head_gradient{s}:d n_hi{s}:i n_lo{s}:i" for s in _STR[1:]),
    f"with {_REP} select * from rep")
def _q5(spark, sf):
    return report(spark, sf)


@query("Q6_clip_verdicts", "feature:s tail_verdict:s head_verdict:s", f"with {_REP} select * from rep")
def _q6(spark, sf):
    return report(spark, sf)


_DECL = ", ".join(f"'{f}'" for f in contract.CLIP_BOUNDS)
_OLD = " union all ".join(
    f"select '{f}' as feature, coalesce(cast({f.lower()} as double), {_fill(f).replace('from mf', 'from mo')}) as v from mo"
    for f in _CLIPPED)


@query("Q7_clip_baseline", "feature:s p99:d max:d p99_before:d max_before:d p99_ratio:d", f"""
  with {_REP}, mo as (select * from mf where snapshot_date <= 19991201),
    old as (select feature, case when feature in ({_DECL}) then 1.0 else quantile_cont(v, 0.99) end as p99_before, max(v) as max_before
            from ({_OLD}) group by 1)
  select r.*, p99_before, max_before, p99/nullif(p99_before, 0) as p99_ratio from rep r left join old using (feature)""")
def _q7(spark, sf):
    rows = mature_feed(spark, sf)
    old = Q.clip_report(rows.where(F.col("SNAPSHOT_DATE") <= D.LAST_LEGACY_SNAPSHOT), FEATS, include_exempt=True)
    return Q.against_baseline(Q.clip_report(rows, FEATS, include_exempt=True), old)


@query("Q8_clip_findings", "feature:s finding:s", f"""
  with {_REP}, c as (select *, regexp_matches(tail_verdict, '^(ramp|swamped)') or regexp_matches(head_verdict, '^(ramp|swamped)') as costly,
     tail_verdict = 'block' or head_verdict = 'block' as blk from rep)
  select feature, 'degenerate' as finding from c where p1 >= p99
  union all select feature, 'high_null_rate' from c where pct_null > 0.002
  union all select feature, 'exemption_justified' from c where exempt and costly
  union all select feature, 'exemption_idle' from c where exempt and not costly
  union all select feature, 'clip_costs' from c where not exempt and costly
  union all select feature, 'block_only' from c where not exempt and not costly and blk""")
def _q8(spark, sf):
    return Q.findings(report(spark, sf))


# ---- drift and walk-forward --------------------------------------------------------------

_SERIES = ["HIST_MAX_DPD_DAYS", "CONTRACT_AGE_MONTH", "DPD_DAYS_T1"]
_R1 = f"""r1 as (select snapshot_date, count(*) as n_instances, count(*) as n_loan_rows, count(distinct national_code) as n_customers,
    avg(case when worst_future_cat >= 3 then 1.0 else 0.0 end) as severe_rate, avg(nl) as mean_portfolio,
    {', '.join(f'avg({s.lower()}) as mean_{s}' for s in _SERIES)}
  from (select *, count(*) over (partition by national_code, snapshot_date) as nl from feed)
  where snapshot_date in (select snapshot_date from ledger) group by 1)"""


def snapshot_table(spark, sf):
    return R.per_snapshot_table(G.loan_rows(mature_feed(spark, sf)), _SERIES)


@query("R1_per_snapshot", "snapshot_date:i n_instances:i n_loan_rows:i n_customers:i severe_rate:d mean_portfolio:d " +
       " ".join(f"mean_{s}:d" for s in _SERIES), f"with {_R1} select * from r1")
def _r1(spark, sf):
    return snapshot_table(spark, sf)


_R2 = f"""{_R1}, sr as (select snapshot_date, series, y from (
      {' union all '.join(f"select snapshot_date, '{s}' as series, cast({s} as double) as y from r1" for s in
      ['n_instances', 'n_loan_rows', 'n_customers', 'severe_rate', 'mean_portfolio'] + [f'mean_{s}' for s in _SERIES])})),
  rk as (select *, row_number() over (partition by series order by snapshot_date) as x,
           rank() over (partition by series order by y) + (count(*) over (partition by series, y) - 1)/2.0 as r from sr),
  tr as (select series, case when count(y) >= 3 and min(y) < max(y) then corr(r, x) filter (y is not null) end as rho_vs_snapshot_order,
           arg_min_null(y, snapshot_date) as first, arg_max_null(y, snapshot_date) as last from rk group by 1)"""


@query("R2_trends", "series:s rho_vs_snapshot_order:d first:d last:d", f"with {_R2} select * from tr")
def _r2(spark, sf):
    return R.trends(snapshot_table(spark, sf))


@query("R3_drift_verdict", "severe_rho:d severe_first:d severe_last:d n_hot:i n_series:i verdict:s", f"""
  with {_R2}, a as (select max(rho_vs_snapshot_order) filter (series = 'severe_rate') as severe_rho, max(first) filter (series = 'severe_rate') as severe_first,
    max(last) filter (series = 'severe_rate') as severe_last, count(*) filter (series like 'mean_%' and rho_vs_snapshot_order > 0.7) as n_hot,
    count(*) filter (series like 'mean_%') as n_series from tr)
  select *, case when coalesce(severe_rho > 0.7, false) and n_hot > 0 then 'deletion_signature' when coalesce(severe_rho > 0.7, false) then 'deterioration' else 'none' end as verdict from a""")
def _r3(spark, sf):
    return R.verdict(R.trends(snapshot_table(spark, sf)))


# Four ways to order the same loans stand in for the arms.
_ARMS = {"multiclass": "SCORE", "ordinal": "floor(SCORE * 10) / 10", "per_cat": "SCORE + CURRENT_CAT / 10.0",
         "binary": "CAST(DPD_DAYS AS DOUBLE)"}


def fold_metrics(spark, sf):
    """Every mature snapshot read as the test fold of all earlier ones."""
    rows = K.ranked_population(E.mature_rows(D.scored(spark, sf), ledger(spark, sf)))
    arms = F.array(*[F.struct(F.lit(a).alias("ARM"), F.expr(e).cast("double").alias("S")) for a, e in _ARMS.items()])
    rows = L.severe_hits(rows).select("LOAN_ID", "SNAPSHOT_DATE", "CURRENT_CAT", "SEV", F.inline(arms))
    rows = pin(rows)
    pooled = K.average_precision(rows, ["SNAPSHOT_DATE", "ARM"], "S").select(
        "SNAPSHOT_DATE", "ARM", F.lit("ranking").alias("SLICE"), F.col("pr_auc").alias("VALUE"))
    cat0 = K.average_precision(rows.where("CURRENT_CAT = 0"), ["SNAPSHOT_DATE", "ARM"], "S").select(
        "SNAPSHOT_DATE", "ARM", F.lit("cat0").alias("SLICE"), F.col("pr_auc").alias("VALUE"))
    from pyspark.sql import Window
    folds = rows.select("SNAPSHOT_DATE").distinct().withColumn(
        "FOLD_ID", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("SNAPSHOT_DATE")))   # months
    return pooled.unionByName(cat0).join(folds, "SNAPSHOT_DATE").select(
        "FOLD_ID", F.col("SNAPSHOT_DATE").alias("TEST_SNAP"), F.lit(None).cast("bigint").alias("VAL_SNAP"),
        (F.col("FOLD_ID") - 1).alias("N_TRAIN_SNAPS"), "ARM", (F.col("ARM") == C.DEPLOY_ARM).alias("DEPLOYED"),
        "SLICE", F.lit("pr_auc").alias("METRIC"), "VALUE")


_FM = f"""ar as (select r.*, a as arm, case a when 'multiclass' then score when 'ordinal' then floor(score*10)/10
       when 'per_cat' then score + current_cat/10.0::double else cast(dpd_days as double) end as s
     from ranked r, (values ('multiclass'), ('ordinal'), ('per_cat'), ('binary')) v(a) where snapshot_date in (select snapshot_date from ledger)),
  g as (select snapshot_date, arm, sl, s, count(*) as n, sum(sev) as tp from ar, (values ('ranking'), ('cat0')) z(sl)
        where sl = 'ranking' or current_cat = 0 group by all),
  gc as (select *, sum(n) over w as cn, sum(tp) over w as ctp from g window w as (partition by snapshot_date, arm, sl order by s desc)),
  fm as (select dense_rank() over (order by snapshot_date) as fold_id, snapshot_date as test_snap, arm, sl, v as value
         from (select snapshot_date, arm, sl, sum(tp*(ctp::double/cn))/nullif(sum(tp), 0) as v from gc group by 1, 2, 3))"""


@query("R4_deployed_arm", "fold_id:i test_snap:i n_train_snaps:i deployed_arm:s pooled_ap:d cat0_ap:d", f"""
  with {_FM} select fold_id, test_snap, fold_id - 1 as n_train_snaps, 'multiclass' as deployed_arm,
    max(value) filter (sl = 'ranking') as pooled_ap, max(value) filter (sl = 'cat0') as cat0_ap from fm where arm = 'multiclass' group by 1, 2""")
def _r4(spark, sf):
    return W.deployed_arm_table(fold_metrics(spark, sf))


@query("R4_arm_comparison", "fold_id:i test_snap:i " + " ".join(f"{a}_ap:d" for a in _ARMS), f"""
  with {_FM} select fold_id, test_snap, {', '.join(f"max(value) filter (arm = '{a}') as {a}_ap" for a in _ARMS)}
  from fm where sl = 'ranking' group by 1, 2""")
def _r4c(spark, sf):
    return W.arm_comparison(fold_metrics(spark, sf), list(_ARMS))


@query("R4_arm_stability", "arm:s n_folds:i mean_ap:d std_ap:d min_ap:d max_ap:d fold_win_rate:d", f"""
  with {_FM}, w as (select *, case when value is not null and row_number() over (partition by fold_id order by value desc nulls last, arm) = 1 then 1 else 0 end as won
    from fm where sl = 'ranking' and fold_id - 1 >= 12)
  select arm, count(value) as n_folds, avg(value) as mean_ap, stddev_pop(value) as std_ap, min(value) as min_ap, max(value) as max_ap,
    sum(won)::double/(sum(sum(won)) over ()) as fold_win_rate from w group by 1""")
def _r4s(spark, sf):
    return W.arm_stability(W.with_min_train(fold_metrics(spark, sf), 12))


@query("R4_unstable_folds", "fold_id:i test_snap:i pooled_ap:d", f"""
  with {_FM} select fold_id, test_snap, value as pooled_ap from fm where arm = 'multiclass' and sl = 'ranking' and value < 0.45""")
def _r4u(spark, sf):
    return W.unstable_folds(W.deployed_arm_table(fold_metrics(spark, sf)))


# ---- profile ---------------------------------------------------------------------------------

_ALL = [c.lower() for c in ("LOAN_ID", "NATIONAL_CODE", "SNAPSHOT_DATE", "WORST_FUTURE_DPD", "WORST_FUTURE_CAT")] + LOW


@query("S1_profile", "section:s item:s value:d", f"""
  with nw as (select * from feed_open where snapshot_date = (select max(snapshot_date) from feed_open)),
  fn as (select * from feed_open where snapshot_date = (select max(snapshot_date) from ledger)),
  cu as (select national_code, count(*) as n from nw group by 1)
  select 'rows_per_snapshot' as section, cast(snapshot_date as varchar) as item, count(*) as value from feed_open group by 2
  union all select 'loans_per_customer', 'p99', floor(quantile_cont(n, 0.99)) from cu
  union all select 'loans_per_customer', 'max', max(n) from cu
  union all select 'category_raw', cast(loan_category as varchar), count(*) from nw group by 2
  union all select 'category_capped', cast(least(loan_category, 3) as varchar), count(*) from nw group by 2
  union all select 'label_raw', cast(worst_future_cat as varchar), count(*) from fn where worst_future_cat is not null group by 2
  union all select 'label_capped', cast(least(worst_future_cat, 3) as varchar), count(*) from fn where worst_future_cat is not null group by 2
  union all select * from ({' union all '.join(f"select 'missing_pct', '{c.upper()}', round(avg(({c} is null)::int)*100, 2) as p from nw" for c in _ALL)}) where p > 0""")
def _s1(spark, sf):
    loans = D.feed_with_open_labels(spark, sf).select(*[c.upper() for c in _ALL])
    return S.profile(loans, ledger(spark, sf))


@query("S2_stratified_sample", "loan_id:i snapshot_date:i label:i")
def _s2(spark, sf):
    return S.stratified_sample(D.scored(spark, sf), 2000)
