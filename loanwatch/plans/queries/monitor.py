"""Queries for the monthly outcome monitor (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...operators import monitor as M
from ...session import pin
from ...sources import derived as D
from ...sources.tables import label_ledger
from ..registry import query
from .data import _ENGINE

ASOF = D.MONITOR_ASOF

_MON = """ml as (select * from ledger where finalized_at < timestamp '2001-10-16'),
  ms as (select loan_id, month_end, built_at, has_installments,
           case when has_installments = 1 then dpd end as dpd from st where built_at < timestamp '2001-10-16'),
  outs as (
    select f.snapshot_date, f.loan_id, f.worst_future_cat as final_cat, max(s.dpd) as worst_dpd_so_far,
           coalesce(sum(case when s.month_end > f.snapshot_date then 1 else 0 end), 0) as months_observed,
           coalesce(sum(case when s.has_installments = 0 then 1 else 0 end), 0) as months_deleted,
           count(s.loan_id) as state_rows
    from feed_open f left join ms s on s.loan_id = f.loan_id and s.month_end between f.snapshot_date and f.label_horizon_date
    where f.loan_id % 53 <> 0 group by 1, 2, 3),
  preds as (select snapshot_date, loan_id, national_code, current_cat, score as risk_score, remaining_amnt,
                   score > 0.5 and dpd_days > 120 as flagged from scored),
  mt as (select p.*, o.final_cat, o.worst_dpd_so_far, o.months_observed, o.months_deleted, o.state_rows,
                o.loan_id is null as unmatched, l.status as label_status, o.loan_id is not null and l.status is not null as matured,
                o.loan_id is not null and l.status is null and o.worst_dpd_so_far is null as blind
         from preds p left join outs o on o.snapshot_date = p.snapshot_date and o.loan_id = p.loan_id
         left join ml l on l.snapshot_date = o.snapshot_date),
  pr as (select *, least(3, case when matured then final_cat
                when worst_dpd_so_far >= 181 then 4 when worst_dpd_so_far >= 156 then 3 when worst_dpd_so_far >= 61 then 2
                when worst_dpd_so_far >= 1 then 1 else 0 end) as outcome
         from mt where not unmatched and not blind and not (matured and final_cat is null)),
  lst as (select *, case when outcome = 3 then 1 else 0 end as sev,
             row_number() over (partition by snapshot_date order by risk_score desc, loan_id) as pos,
             count(*) over (partition by snapshot_date) as n from pr where current_cat < 3 and matured),
  lsv as (select * from lst where snapshot_date in (select snapshot_date from lst where sev = 1)),
  ilst as (select *, case when outcome = 3 then 1 else 0 end as sev,
             row_number() over (partition by snapshot_date order by risk_score desc, loan_id) as pos,
             count(*) over (partition by snapshot_date) as n from pr
           where current_cat < 3 and snapshot_date in (
             select snapshot_date from pr group by 1 having max(label_status) is null and max(months_observed) > 0))"""
MON = f"with {_MON}"


def ledger(spark, sf):
    return label_ledger(M.existed_by(D.ledger_table(spark, sf), "FINALIZED_AT", ASOF))


def outs(spark, sf):
    return M.outcomes(D.monitored_loans(spark, sf), D.monitor_state_log(spark, sf), ASOF)


def prepared(spark, sf):
    return M.prepare(D.flagged_scores(spark, sf), outs(spark, sf), ledger(spark, sf))


@query("M1_as_of_cut", "source:s n:i", """
  select 'ledger' as source, count(*) as n from ledger where finalized_at < timestamp '2001-10-16'
  union all select 'runs', count(*) from runs where operation_date < timestamp '2001-10-16'
  union all select 'state_log', count(*) from st where built_at < timestamp '2001-10-16'""")
def _m1(spark, sf):
    parts = [("ledger", D.ledger_table(spark, sf), "FINALIZED_AT"),
             ("runs", D.run_log(spark, sf), "OPERATION_DATE"),
             ("state_log", D.state_log(spark, sf), "BUILT_AT")]
    out = None
    for name, df, col in parts:
        p = M.existed_by(df, col, ASOF).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


_RUNS = """picked as (
    select snapshot_date, operation_id, operation_status, inference_failures,
           count(*) over (partition by snapshot_date) as n_usable_runs
    from runs where operation_status <> 'FAILED' and operation_date < timestamp '2001-10-16'
    qualify row_number() over (partition by snapshot_date order by operation_date desc, operation_id desc) = 1)"""


def runs(spark, sf):
    return M.pick_runs(M.existed_by(D.run_log(spark, sf), "OPERATION_DATE", ASOF))


@query("M2_pick_runs", "snapshot_date:i operation_id:s operation_status:s inference_failures:i n_usable_runs:i",
       f"with {_RUNS} select * from picked")
def _m2(spark, sf):
    return runs(spark, sf)


@query("M3_predictions", "snapshot_date:i loan_id:i national_code:s current_cat:i risk_score:d remaining_amnt:d flagged:b", f"""
  with {_RUNS}, {_ENGINE} select e.snapshot_date, e.loan_id, national_code, dpd_cat as current_cat, p3 as risk_score,
     remaining_amnt, coalesce(st <> 'NOT_APPLICABLE', false) as flagged
  from eng e join picked p on p.operation_id = e.operation_id""")
def _m3(spark, sf):
    output = pin(D.engine_output(spark, sf))                # read by the output and by its tracking
    return M.predictions(output, D.tracking_of(output), runs(spark, sf))


@query("M4_outcomes", "snapshot_date:i loan_id:i final_cat:i worst_dpd_so_far:i months_observed:i months_deleted:i state_rows:i",
       f"{MON} select * from outs")
def _m4(spark, sf):
    return outs(spark, sf)


@query("M5_band_dpd", "loan_id:i month_end:i band:i", """
  select loan_id, month_end, case when dpd>=181 then 4 when dpd>=156 then 3 when dpd>=61 then 2 when dpd>=1 then 1 else 0 end as band from st""")
def _m5(spark, sf):
    return D.state_log(spark, sf).withColumn("band", M.band_dpd(F.col("DPD_AT_MONTH_END")))


@query("M6_label_check", "snapshot_date:i label_status:s n_too_many_months:i n_checked:i n_different:i", f"""
  {MON}, c as (select o.*, l.status, l.status = 'FINAL' and months_observed = 6 and final_cat is not null and worst_dpd_so_far is not null as ok
    from outs o left join ml l using (snapshot_date))
  select snapshot_date, max(status) as label_status, count(*) filter (months_observed > 6) as n_too_many_months,
    count(*) filter (ok) as n_checked, count(*) filter (ok and final_cat <> case when worst_dpd_so_far>=181 then 4
      when worst_dpd_so_far>=156 then 3 when worst_dpd_so_far>=61 then 2 when worst_dpd_so_far>=1 then 1 else 0 end) as n_different
  from c group by 1""")
def _m6(spark, sf):
    return M.assert_labels_agree(outs(spark, sf), ledger(spark, sf))


@query("M7_prepare", "snapshot_date:i loan_id:i matured:b outcome:i months_observed:i",
       f"{MON} select * from pr")
def _m7(spark, sf):
    return prepared(spark, sf)


@query("M9_wilson", "snapshot_date:i lo:d hi:d", """
  with h as (select snapshot_date, sum(sev)::double as h, count(*)::double as n from ranked group by 1)
  select snapshot_date, ((h/n + 1.96*1.96/(2*n)) - 1.96*sqrt(h/n*(1-h/n)/n + 1.96*1.96/(4*n*n)))/(1+1.96*1.96/n) as lo,
         ((h/n + 1.96*1.96/(2*n)) + 1.96*sqrt(h/n*(1-h/n)/n + 1.96*1.96/(4*n*n)))/(1+1.96*1.96/n) as hi from h""")
def _m9(spark, sf):
    from ...operators.ranking import ranked_population
    h = ranked_population(D.scored(spark, sf)).groupBy("SNAPSHOT_DATE").agg(
        F.count_if(F.col("LABEL") == C.SEVERE).alias("h"), F.count(F.lit(1)).alias("n"))
    lo, hi = M.wilson(F.col("h"), F.col("n"))
    return h.select("SNAPSHOT_DATE", lo.alias("lo"), hi.alias("hi"))


def _k(name, n="n"):
    cut = C.MONITOR_CUTOFFS[name]
    return f"least({n}, ceil({cut}::double * {n})::bigint)" if isinstance(cut, float) else f"least({n}, {cut})"


def _ap(by, src="lst"):
    return f"""g as (select {by}, risk_score, count(*) as gn, sum(sev) as tp from {src} group by all),
      gc as (select {by}, tp, sum(gn) over w as cn, sum(tp) over w as ctp from g window w as (partition by {by} order by risk_score desc)),
      ap as (select {by}, sum(tp*(ctp::double/cn))/nullif(sum(tp),0) as pr_auc from gc group by {by})"""


_CUTS = list(C.MONITOR_CUTOFFS)
_M10_IN = ", ".join(
    f"sum(case when pos <= {_k(c)} then sev else 0 end) as h_{c}, sum(case when pos <= {_k(c)} and sev = 1 then remaining_amnt else 0 end) as a_{c}"
    for c in _CUTS)


def _wil(h, n, sign):
    p = f"({h}::double/{n})"
    return (f"(({p} + 1.96*1.96/(2.0*{n})) {sign} 1.96*sqrt({p}*(1-{p})/{n} + 1.96*1.96/(4.0*{n}*{n})))/(1+1.96*1.96/{n}::double)")


_M10_OUT = ", ".join(
    f"{_k(c, 'n_ranked')} as {c}_k, h_{c}::double/s as {c}_recall, {_wil('h_'+c, 's', '-')} as {c}_recall_lo, {_wil('h_'+c, 's', '+')} as {c}_recall_hi, "
    f"h_{c}::double/{_k(c, 'n_ranked')} as {c}_precision, h_{c}::double/{_k(c, 'n_ranked')}/(s::double/n_ranked) as {c}_lift, "
    f"case when amt > 0 then a_{c}/amt end as {c}_exposure_caught" for c in _CUTS)
_M10 = (f"m10a as (select snapshot_date, max(label_status) as label_status, count(*) as n_ranked, sum(sev) as n_severe, nullif(sum(sev), 0) as s, "
        f"sum(risk_score) as ps, sum(case when sev = 1 then remaining_amnt end) as amt, {_M10_IN} from lst group by 1), {_ap('snapshot_date')}, "
        "m10 as (select m10a.snapshot_date, label_status, n_ranked, n_severe, n_severe::double/n_ranked as base_rate, pr_auc, "
        f"case when s is not null then ps end as predicted_severe, {_M10_OUT} from m10a join ap using (snapshot_date))")
for _c in _CUTS:
    _M10 = _M10.replace(f"{_k(_c, 'n_ranked')} as {_c}_k", f"case when s is not null then {_k(_c, 'n_ranked')} end as {_c}_k")
    _M10 = _M10.replace(f" h_{_c}::double/{_k(_c, 'n_ranked')} as", f" case when s is not null then h_{_c}::double/{_k(_c, 'n_ranked')} end as")
_M10_COLS = ("snapshot_date:i label_status:s n_ranked:i n_severe:i base_rate:d pr_auc:d predicted_severe:d " + " ".join(
    f"{c}_k:i {c}_recall:d {c}_recall_lo:d {c}_recall_hi:d {c}_precision:d {c}_lift:d {c}_exposure_caught:d" for c in _CUTS))


@query("M10_matured_metrics", _M10_COLS, f"{MON}, {_M10} select * from m10")
def _m10(spark, sf):
    return M.matured_metrics(M.matured_list(prepared(spark, sf)))


_M11 = ", ".join(f"count(*) filter (pos <= {_k(c)})::double/max({_k(c)}) as share_of_{c}, "
                 f"sum(case when pos <= {_k(c)} then sev else 0 end)::double/nullif(sum(sev),0) as recall_{c}" for c in _CUTS)


@query("M11_queue_by_category", "snapshot_date:i current_cat:i n:i n_severe:i base_rate:d pr_auc:d " +
       " ".join(f"share_of_{c}:d recall_{c}:d" for c in _CUTS), f"""
  {MON}, {_ap('snapshot_date, current_cat')}, a as (select snapshot_date, current_cat, count(*) as n, sum(sev) as n_severe, avg(sev) as base_rate, {_M11}
    from (select * rename (n as nn) from lsv) group by 1, 2)
  select * from a join ap using (snapshot_date, current_cat)""".replace("least(n, ceil(0.01::double * n)::bigint)", _k("top_1pct", "nn")).replace(
    "least(n, ceil(0.05::double * n)::bigint)", _k("top_5pct", "nn")).replace("least(n, 1000)", _k("top_1000", "nn")))
def _m11(spark, sf):
    return M.queue_by_category(M.matured_list(prepared(spark, sf)))


@query("M12_calibration_deciles", "snapshot_date:i decile:i mean_score:d severe_rate:d n:i", f"""
  {MON} select snapshot_date, case when n <= 1 then 1 else greatest(1, (10*(pos-1) + n - 2)//greatest(n-1, 1)) end as decile,
    avg(risk_score) as mean_score, avg(sev) as severe_rate, count(*) as n from lsv z group by 1, 2""")
def _m12(spark, sf):
    return M.calibration_deciles(M.matured_list(prepared(spark, sf)))


@query("M13_migration", "snapshot_date:i group:s current_cat:i to_0:i to_1:i to_2:i to_3:i".replace("group:s", "grp:s"), f"""
  {MON} select snapshot_date, case when pos <= {_k('top_5pct')} then 'top' else 'rest' end as grp, current_cat,
    {', '.join(f'count(*) filter (outcome = {k}) as to_{k}' for k in range(4))} from lsv group by 1, 2, 3""")
def _m13(spark, sf):
    return M.migration(M.matured_list(prepared(spark, sf))).withColumnRenamed("GROUP", "grp")


@query("M14_cohort_capture", "snapshot_date:i point:i k:i frac_called:d recall:d hours:d", f"""
  {MON}, h as (select snapshot_date, pos, n, sum(sev) over (partition by snapshot_date order by pos) as hits,
                 greatest(sum(sev) over (partition by snapshot_date), 1) as tot from lsv),
  pts as (select snapshot_date, j as point, case when n = 1 then 1 else 1 + (j*(n-1))//(least(200,n)-1) end as k
          from (select snapshot_date, max(n) as n from lsv group by 1), range(200) r(j) where j < least(200, n))
  select snapshot_date, point, k, k::double/n as frac_called, hits::double/tot as recall, k/240.0 as hours
  from pts join h using (snapshot_date) where pos = k""")
def _m14(spark, sf):
    return M.cohort_capture(M.matured_list(prepared(spark, sf)))


_M15 = """m15 as (select snapshot_date, count(*) filter (flagged) as n_flagged, count(*) filter (flagged and sev = 1) as n_severe_flagged,
    count(*) filter (flagged and sev = 1)::double/nullif(count(*) filter (flagged), 0) as precision,
    count(*) filter (flagged and sev = 1)::double/nullif(sum(sev), 0) as recall,
    sum(case when pos <= nf then sev else 0 end)::double/nullif(sum(sev), 0) as recall_top_same_size
    from (select *, count(*) filter (flagged) over (partition by snapshot_date) as nf from lsv) group by 1)"""


@query("M15_enrichment_rule", "snapshot_date:i n_flagged:i n_severe_flagged:i precision:d recall:d recall_top_same_size:d",
       f"{MON}, {_M15} select * from m15")
def _m15(spark, sf):
    return M.enrichment_rule(M.matured_list(prepared(spark, sf)))


_GROUPS = {"rest": f"pos > {_k('top_5pct')}", **{c: f"pos <= {_k(c)}" for c in _CUTS}, "rule": "flagged"}
_M16 = ", ".join(
    f"count(*) filter ({cond}) as {g}_n, count(*) filter ({cond} and worse)::double/nullif(count(*) filter ({cond}), 0) as {g}_deteriorated_rate, "
    f"count(*) filter ({cond} and sev = 1)::double/nullif(count(*) filter ({cond}), 0) as {g}_severe_so_far_rate" for g, cond in _GROUPS.items())


@query("M16_interim_metrics", "snapshot_date:i months_observed:i n_short_months:i n_ranked:i deteriorated_rate:d severe_so_far_rate:d " + " ".join(
    f"{g}_n:i {g}_deteriorated_rate:d {g}_severe_so_far_rate:d" + (f" {g}_lift_vs_rest:d" if g in _CUTS else "") for g in _GROUPS), f"""
  {MON}, md as (select snapshot_date, months_observed as m from ilst group by 1, 2
         qualify row_number() over (partition by snapshot_date order by count(*) desc, months_observed desc) = 1),
  x as (select i.*, outcome > current_cat as worse, m from ilst i join md using (snapshot_date)),
  a as (select snapshot_date, max(m) as months_observed, count(*) filter (months_observed < m) as n_short_months, count(*) as n_ranked,
     count(*) filter (worse)::double/count(*) as deteriorated_rate, avg(sev) as severe_so_far_rate, {_M16} from x group by 1)
  select *, {', '.join(f'{c}_deteriorated_rate/nullif(rest_deteriorated_rate, 0) as {c}_lift_vs_rest' for c in _CUTS)} from a""")
def _m16(spark, sf):
    return M.interim_metrics(M.interim_list(prepared(spark, sf)))


_PSI = """ord as (select snapshot_date, row_number() over (order by snapshot_date) as i from (select distinct snapshot_date from scored)),
  ref as (select t.snapshot_date, r.score from ord t join ord o on o.i between t.i - 6 and t.i - 1 join ranked r on r.snapshot_date = o.snapshot_date),
  e0 as (select snapshot_date, unnest(quantile_cont(score, [0.0::double, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as e from ref group by 1),
  e1 as (select snapshot_date, list(distinct e order by e) as es from (select snapshot_date, round(e, 12) as e from e0) group by 1 having count(distinct e) >= 3),
  fa as (select r.snapshot_date, len(list_filter(es[2:-2], lambda x: x <= score)) as b, count(*) as a from ref r join e1 using (snapshot_date) group by 1, 2),
  fb as (select r.snapshot_date, len(list_filter(es[2:-2], lambda x: x <= score)) as b, count(*) as c from ranked r join e1 using (snapshot_date) group by 1, 2),
  ab as (select snapshot_date, greatest(coalesce(a, 0)::double/sum(a) over (partition by snapshot_date), 1e-6::double) as pa,
                greatest(coalesce(c, 0)::double/sum(c) over (partition by snapshot_date), 1e-6::double) as pb
         from fa full join fb using (snapshot_date, b)),
  psi as (select snapshot_date, sum((pb - pa)*ln(pb/pa)) as score_psi from ab group by 1)"""


@query("M17_psi", "snapshot_date:i score_psi:d", f"with {_PSI} select * from psi")
def _m17(spark, sf):
    return M.drift(D.flagged_scores(spark, sf)).where("score_psi is not null")


@query("M18_drift", "snapshot_date:i n_rows:i n_ranked:i cat_0_share:d cat_1_share:d cat_2_share:d cat_3_share:d "
       "score_mean:d score_p90:d score_p99:d score_psi:d", f"""
  with {_PSI}, d as (select snapshot_date, count(*) as n_rows, count(*) filter (current_cat < 3) as n_ranked,
    {', '.join(f'count(*) filter (current_cat = {k})::double/count(*) as cat_{k}_share' for k in range(4))},
    avg(score) filter (current_cat < 3) as score_mean, quantile_cont(score, 0.9) filter (current_cat < 3) as score_p90,
    quantile_cont(score, 0.99) filter (current_cat < 3) as score_p99 from scored group by 1)
  select d.*, score_psi from d left join psi using (snapshot_date)""")
def _m18(spark, sf):
    return M.drift(D.flagged_scores(spark, sf))


@query("M19_cohort_routing", "snapshot_date:i label_status:s cohort:s", f"""
  {MON} select snapshot_date, max(label_status) as label_status, case when max(label_status) is not null then 'matured'
     when max(months_observed) > 0 then 'interim' else 'not_yet' end as cohort from pr group by 1""")
def _m19(spark, sf):
    return M.routing(prepared(spark, sf))


@query("M20_history", _M10_COLS + " cat0_pr_auc:d rule_n_flagged:i rule_precision:d rule_recall:d "
       "rule_recall_top_same_size:d vintage_start:b", f"""
  {MON}, {_M10}, {_M15}, {_ap('snapshot_date', '(select * from lst where current_cat = 0)').replace('g as', 'g0 as').replace('from g ', 'from g0 ').replace('gc as', 'gc0 as').replace('from gc ', 'from gc0 ').replace('ap as', 'ap0 as')}
  select m10.*, ap0.pr_auc as cat0_pr_auc, n_flagged as rule_n_flagged, precision as rule_precision, recall as rule_recall,
    recall_top_same_size as rule_recall_top_same_size, snapshot_date = 20000101 as vintage_start
  from m10 left join ap0 using (snapshot_date) left join m15 using (snapshot_date)""")
def _m20(spark, sf):
    return M.history(pin(M.matured_list(prepared(spark, sf))))


@query("M21_quality", "snapshot_date:i item:s n:i", f"""
  {MON}, {_RUNS}, a as (select snapshot_date, count(*) as prediction_rows, count(*) filter (unmatched) as unmatched,
      count(*) filter (blind and state_rows > 0) as no_outcome_deleted, count(*) filter (blind and state_rows = 0) as no_outcome_no_state_rows
      from mt group by 1),
  b as (select snapshot_date, count(*) filter (final_cat is null) as unlabelled, max(loans_unlabelled) as ledger_unlabelled,
      max(loans_missing_months) as ledger_missing_months, case when max(status) = 'FINAL' then count(*) filter (
        months_observed = 6 and final_cat is not null and worst_dpd_so_far is not null) end as cross_checked
      from outs join ml using (snapshot_date) group by 1)
  select * from (
    select snapshot_date, item, n from a, lateral (values ('prediction_rows', prediction_rows), ('unmatched', unmatched),
      ('no_outcome_deleted', no_outcome_deleted), ('no_outcome_no_state_rows', no_outcome_no_state_rows)) v(item, n)
    union all select snapshot_date, item, n from b, lateral (values ('unlabelled', unlabelled), ('ledger_unlabelled', ledger_unlabelled),
      ('ledger_missing_months', ledger_missing_months), ('cross_checked', cross_checked)) v(item, n)
    union all select snapshot_date, 'usable_runs', n_usable_runs from picked
    union all select snapshot_date, 'inference_failures', inference_failures from picked) where n is not null""")
def _m21(spark, sf):
    o = pin(outs(spark, sf))
    return M.quality(D.flagged_scores(spark, sf), o, ledger(spark, sf), runs(spark, sf))
