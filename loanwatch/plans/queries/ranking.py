"""Queries for the ranked queue (J) and the ranking metrics (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...operators import queue as Q
from ...operators import ranking as K
from ...sources import derived as D
from ..registry import query

AS_OF = "2024-02-14"
ACT_THRESHOLD = 0.5

_RANK_COLS = ("n_ranked:i n_severe:i base_rate:d pr_auc:d "
              + " ".join(f"k_{w}:i recall_{w}:d precision_{w}:d lift_{w}:d" for w in C.REF_WINDOWS))


def rank_sql(source: str, by: str = "", extra: str = "") -> str:
    """The ranking block of a source (loan_id, snapshot_date, score, sev) per slice."""
    p = f"partition by {by}" if by else ""
    key = by or "1"
    b = f"{by}," if by else ""
    win = ", ".join(
        f"least({240*h}, max(n)) as k_{w}, sum(case when pos <= {240*h} then sev else 0 end) as h_{w}"
        for w, h in C.REF_WINDOWS.items())
    out = ", ".join(
        f"case when n_severe > 0 then k_{w} end as k_{w}, h_{w}::double/nullif(n_severe,0) as recall_{w}, "
        f"case when n_severe > 0 then h_{w}::double/k_{w} end as precision_{w}, "
        f"case when n_severe > 0 then h_{w}::double/k_{w}/(n_severe::double/n_ranked) end as lift_{w}"
        for w in C.REF_WINDOWS)
    ex_in = ", min(remaining_amnt) as exposure_min, max(remaining_amnt) as exposure_max" if extra else ""
    ex_out = ", exposure_min, exposure_max" if extra else ""
    return f"""
  with p as (
    select *, row_number() over ({p} order by score desc, loan_id, snapshot_date) as pos,
           count(*) over ({p}) as n from {source}),
  a as (select {key} as s, count(*) as n_ranked, sum(sev) as n_severe, {win}{ex_in} from p group by 1),
  g as (select {key} as s, score, count(*) as n, sum(sev) as tp from {source} group by 1, 2),
  c as (select s, tp, sum(n) over w as cn, sum(tp) over w as ctp from g
        window w as (partition by s order by score desc rows unbounded preceding)),
  ap as (select s, sum(tp * (ctp::double/cn))/nullif(sum(tp),0) as pr_auc from c group by 1)
  select {'a.s as ' + by + ',' if by else ''} n_ranked, n_severe, n_severe::double/n_ranked as base_rate, pr_auc, {out}{ex_out}
  from a join ap on a.s is not distinct from ap.s"""


@query("K2_ranking_at_k", _RANK_COLS, rank_sql("ranked"))
def _k2(spark, sf):
    return K.ranking_metrics(K.ranked_population(D.scored(spark, sf)))


@query("K1_call_order", "loan_id:i snapshot_date:i score:d pos:i", """
  select loan_id, snapshot_date, score,
         row_number() over (order by score desc, loan_id, snapshot_date) as pos from ranked""")
def _k1(spark, sf):
    return K.positions(K.ranked_population(D.scored(spark, sf)))


@query("K3_ranking_by_category", "current_cat:i " + _RANK_COLS, rank_sql("ranked", "current_cat"))
def _k3(spark, sf):
    return K.ranking_metrics(K.ranked_population(D.scored(spark, sf)), by=["CURRENT_CAT"])


@query("K4_average_precision", "pr_auc:d", """
  with g as (select score, count(*) as n, sum(sev) as tp from ranked group by 1),
  c as (select tp, sum(n) over w as cn, sum(tp) over w as ctp from g
        window w as (order by score desc rows unbounded preceding))
  select sum(tp * (ctp::double/cn))/sum(tp) as pr_auc from c""")
def _k4(spark, sf):
    df = K.ranked_population(D.scored(spark, sf))
    return K.average_precision(df.withColumn("SEV", K.is_severe(F.col("LABEL"))))


@query("K5_capture_curve", "point:i k:i frac_called:d recall:d hours:d", """
  with p as (select sev, row_number() over (order by score desc, loan_id, snapshot_date) as pos,
                    count(*) over () as n, sum(sev) over () as total from ranked),
  c as (select pos, n, total, sum(sev) over (order by pos) as hits from p),
  pts as (select j as point, 1 + (j * (n - 1)) // (least(200, n) - 1) as k
          from (select max(n) as n from p), range(200) r(j))
  select point, k, k::double/n as frac_called, hits::double/total as recall, k/240.0 as hours
  from pts join c on c.pos = pts.k""")
def _k5(spark, sf):
    return K.capture_curve(K.ranked_population(D.scored(spark, sf)))


@query("K6_single_loan_slice", _RANK_COLS,
       rank_sql("(select * from (select *, count(*) over (partition by national_code, snapshot_date) as nl "
                "from scored) where nl = 1 and current_cat < 3)"))
def _k6(spark, sf):
    df = D.scored(spark, sf)
    keys = ["NATIONAL_CODE", "SNAPSHOT_DATE"]
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return K.ranking_metrics(K.ranked_population(df.join(single, keys, "left_semi")))


@query("K7_exposure_deciles", "decile:i " + _RANK_COLS + " exposure_min:d exposure_max:d",
       rank_sql("(select *, ((row_number() over (order by remaining_amnt, loan_id, snapshot_date) - 1) * 10) "
                "// (count(*) over ()) + 1 as decile from ranked)", "decile", "x"))
def _k7(spark, sf):
    return K.exposure_decile_metrics(D.scored(spark, sf))


@query("K8_label_vintage", "status:s " + _RANK_COLS,
       rank_sql("(select r.*, l.status from ranked r join ledger l using (snapshot_date))", "status"))
def _k8(spark, sf):
    from ...operators.maturity import ranking_by_vintage
    from ...sources.tables import label_ledger
    return ranking_by_vintage(D.scored(spark, sf), label_ledger(D.ledger_table(spark, sf)))


# ---- queue -------------------------------------------------------------------

QUEUE_SQL = """
  flags as (
    select s.*, case when current_cat >= 3 then 'ALREADY_SEVERE'
                     when snapshot_date < max(snapshot_date) over (partition by s.national_code) then 'SUPERSEDED'
                     when score >= 0.5 then 'PREDICTED_SEVERE'
                     when c.national_code is not null then 'RECENTLY_CALLED' else '' end as rule_flag
    from scored s left join (select national_code from calls
                             where called_at >= timestamp '2024-02-14' - interval 30 day) c
      on c.national_code = s.national_code),
  que as (select *, case when rule_flag = '' then row_number() over (
                 order by case when rule_flag = '' then 0 else 1 end, score desc, national_code, loan_id, snapshot_date) end as risk_rank
          from flags)"""


def flagged(spark, sf):
    df = D.scored(spark, sf).withColumnRenamed("SCORE", "RISK_SCORE")
    return Q.with_rule_flag(df, D.called_log(spark, sf), AS_OF, act_threshold=ACT_THRESHOLD)


@query("J1_rule_flags", "loan_id:i snapshot_date:i rule_flag:s",
       f"with {QUEUE_SQL} select loan_id, snapshot_date, rule_flag from flags")
def _j1(spark, sf):
    return flagged(spark, sf)


@query("J2_queue_rank", "risk_rank:i loan_id:i snapshot_date:i national_code:s risk_score:d rule_flag:s",
       f"with {QUEUE_SQL} select risk_rank, loan_id, snapshot_date, national_code, score as risk_score, rule_flag from que")
def _j2(spark, sf):
    return Q.with_rank(flagged(spark, sf))


@query("J4_queue_head", "n_slots:i n_customers:i n_duplicate_slots:i",
       f"""with {QUEUE_SQL} select count(*) as n_slots, count(distinct national_code) as n_customers,
           count(*) - count(distinct national_code) as n_duplicate_slots from que where risk_rank <= 5760""")
def _j4(spark, sf):
    return Q.head_report(Q.with_rank(flagged(spark, sf)))


@query("J5_flag_counts", "rule_flag:s n:i hours_to_call:d",
       f"with {QUEUE_SQL} select rule_flag, count(*) as n, count(*)/240.0 as hours_to_call from flags group by 1")
def _j5(spark, sf):
    return Q.flag_report(flagged(spark, sf))


@query("J7_sample_across_risk", "loan_id:i snapshot_date:i risk_score:d rule_flag:s risk_bin:i")
def _j7(spark, sf):
    return Q.sample_across_risk(flagged(spark, sf), include_flagged=True)
