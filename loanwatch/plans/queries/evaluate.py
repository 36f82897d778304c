"""Queries for the decision layer (I) and classification metrics (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...operators import classify as L
from ...operators import decide as I
from ...operators.grain import loan_rows
from ...sources import derived as D
from ...sources.tables import label_ledger
from ..registry import query
from .ranking import _RANK_COLS, rank_sql

P = ["p0", "p1", "p2", "p3"]
_VEC = "vec as (select *, (1-score)*0.5 as p0, (1-score)*0.3 as p1, (1-score)*0.2 as p2, score as p3 from scored)"
_COST = ", ".join("(" + " + ".join(f"{{0}}{i}*{C.COST_MATRIX[i][j]}" for i in range(4)) + f") as {{1}}{j}" for j in range(4))
_KEPT = ", ".join(f"case when {k} < current_cat then 0.0 else p{k} end as q{k}" for k in range(4))
_MASK = (f"kept as (select *, {_KEPT} from vec), "
         "msk as (select *, " + ", ".join(
             f"case when q0+q1+q2+q3 = 0 then {1.0 if k == 3 else 0.0} else q{k}/(q0+q1+q2+q3) end as m{k}"
             for k in range(4)) + " from kept)")


def _argmax(p):
    return (f"case when {p}0 >= greatest({p}1, {p}2, {p}3) then 0 when {p}1 >= greatest({p}2, {p}3) then 1 "
            f"when {p}2 >= {p}3 then 2 else 3 end")


def _argmin(p):
    return (f"case when {p}0 <= least({p}1, {p}2, {p}3) then 0 when {p}1 <= least({p}2, {p}3) then 1 "
            f"when {p}2 <= {p}3 then 2 else 3 end")


_DEC = (f"with {_VEC}, {_MASK}, cst as (select *, {_COST.format('m', 'c')} from msk), "
        f"dec as (select *, {_argmin('c')} as cost_pred, {_argmax('m')} as cal_pred, {_argmax('p')} as raw_pred from cst)")
_K = "loan_id:i snapshot_date:i "


def masked(spark, sf):
    return I.with_monotone_mask(D.class_vector(spark, sf))


def decided(spark, sf):
    return I.with_decision(masked(spark, sf))


@query("I1_expected_costs", _K + "c0:d c1:d c2:d c3:d",
       f"with {_VEC} select loan_id, snapshot_date, {_COST.format('p', 'c')} from vec")
def _i1(spark, sf):
    df = D.class_vector(spark, sf)
    return df.select("LOAN_ID", "SNAPSHOT_DATE", *[
        c.alias(f"c{j}") for j, c in enumerate(I.expected_costs([F.col(p) for p in P]))])


@query("I2_cost_decision", _K + "predicted_class:i", f"{_DEC} select *, cost_pred as predicted_class from dec")
def _i2(spark, sf):
    return decided(spark, sf)


@query("I3_expected_cost", _K + "expected_cost:d", f"{_DEC} select *, c0 as expected_cost from dec")
def _i3(spark, sf):
    return decided(spark, sf)


@query("I4_risk_score", _K + "risk_score:d", f"{_DEC} select *, m3 as risk_score from dec")
def _i4(spark, sf):
    return decided(spark, sf)


@query("I5_monotone_mask", _K + "m0:d m1:d m2:d m3:d", f"{_DEC} select * from dec")
def _i5(spark, sf):
    return masked(spark, sf)


@query("I6_argmax", _K + "pred:i", f"{_DEC} select *, raw_pred as pred from dec")
def _i6(spark, sf):
    return D.class_vector(spark, sf).withColumn("pred", I.first_max([F.col(p) for p in P]))


# ---- classification --------------------------------------------------------------------

def metric_sql(source: str, pred: str, probs: str, by: str = "") -> str:
    """Metrics of a source per slice, from its grouped cells."""
    b = f"{by} as s" if by else "1 as s"
    f1 = " + ".join(f"coalesce(2.0*n{k}{k}/nullif(r{k}+k{k},0),0)" for k in range(4))
    rec = ", ".join(f"coalesce(n{k}{k}/nullif(r{k},0)::double,0) as recall_class_{k}" for k in range(4))
    obs = " + ".join(f"n{i}{j}*{(i-j)**2}.0" for i in range(4) for j in range(4))
    exp = " + ".join(f"r{i}::double*k{j}*{(i-j)**2}.0" for i in range(4) for j in range(4))
    cost = " + ".join(f"n{i}{j}*{C.COST_MATRIX[i][j]}" for i in range(4) for j in range(4))
    seen = " + ".join(f"(case when r{k}+k{k} > 0 then 1 else 0 end)" for k in range(4))
    cells = ", ".join(f"count(*) filter (label = {i} and {pred} = {j}) as n{i}{j}" for i in range(4) for j in range(4))
    brier = " + ".join(f"pow({probs}{k} - (case when label = {k} then 1 else 0 end), 2)" for k in range(4))
    marg = ", ".join(" + ".join(f"n{k}{j}" for j in range(4)) + f" as r{k}, " +
                     " + ".join(f"n{i}{k}" for i in range(4)) + f" as k{k}" for k in range(4))
    return f"""(with a as (select {b}, count(*) as n, avg(({brier})/4) as brier_score, {cells} from {source} group by 1),
      b as (select *, {marg} from a)
      select s, n, ({f1})/4 as macro_f1, case when {seen} >= 2 then 1 - ({obs})*n/nullif({exp},0) end as qwk,
        (n00+n11+n22+n33)/n::double as accuracy, {rec}, ({cost})/n as avg_cost, brier_score from b)"""


_MET = ("n:i macro_f1:d qwk:d accuracy:d recall_class_0:d recall_class_1:d recall_class_2:d recall_class_3:d "
        "avg_cost:d brier_score:d")


@query("L1_confusion", "true_class:i pred_class:i n:i", f"""
  {_DEC} select i as true_class, j as pred_class, (select count(*) from dec where label = i and cost_pred = j) as n
  from range(4) a(i), range(4) b(j)""")
def _l1(spark, sf):
    return L.confusion(decided(spark, sf), pred="PREDICTED_CLASS")


@query("L2_L5_class_metrics", _MET, f"{_DEC} select * from {metric_sql('dec', 'cost_pred', 'm')}")
def _l2(spark, sf):
    return L.classification_metrics(decided(spark, sf), pred="PREDICTED_CLASS", probs=I.MASKED)


@query("L3_kappa", "qwk:d", f"{_DEC} select * from {metric_sql('dec', 'raw_pred', 'p')}")
def _l3(spark, sf):
    df = D.class_vector(spark, sf).withColumn("PRED", I.first_max([F.col(p) for p in P]))
    return L.classification_metrics(df, probs=P)


@query("L4_brier", "brier_score:d", f"{_DEC} select * from {metric_sql('dec', 'raw_pred', 'p')}")
def _l4(spark, sf):
    return D.class_vector(spark, sf).agg(F.avg(L.brier_row(P)).alias("brier_score"))


@query("L5_average_cost", "avg_cost:d", f"{_DEC} select * from {metric_sql('dec', 'cal_pred', 'm')}")
def _l5(spark, sf):
    df = masked(spark, sf).withColumn("PRED", I.first_max([F.col(p) for p in I.MASKED]))
    return L.classification_metrics(df)


@query("L6_metrics_by_category", "current_cat:i " + _MET,
       f"{_DEC} select s as current_cat, * from {metric_sql('dec', 'cost_pred', 'm', 'current_cat')}")
def _l6(spark, sf):
    return L.classification_metrics(decided(spark, sf), pred="PREDICTED_CLASS", probs=I.MASKED, by=["CURRENT_CAT"])


_NAMES = [c.split(":")[0] for c in _MET.split()]
_RNAMES = [c.split(":")[0] for c in _RANK_COLS.split()]


def _long(block, sl, inner, names):
    vals = ", ".join(f"('{n}', cast({n} as double))" for n in names)
    return (f"select '{block}' as block, cast({sl} as varchar) as slice, metric, value from ({inner}) z, "
            f"lateral (values {vals}) v(metric, value)")


def _rank_long(block, source, by=None, extra=()):
    inner = rank_sql(source, by or "", "x" if extra else "")
    return _long(block, by or "'all'", inner, [*_RNAMES, *extra])


_MS = ("q as (select d.* exclude (score), m3 as score, count(*) over (partition by national_code, snapshot_date) as nl from dec d), "
       "qr as (select * from q where current_cat < 3), "
       "qd as (select *, ((row_number() over (order by remaining_amnt, loan_id, snapshot_date) - 1) * 10) "
       "// (count(*) over ()) + 1 as decile from qr), "
       "ql as (select qr.*, status from qr join ledger using (snapshot_date))")


def _nested_long(block, source, value=None):
    """The block of each slice by category."""
    s = f"{value} || '/' || current_cat" if value else "cast(current_cat as varchar)"
    return _long(f"{block}_by_category", "s", rank_sql(f"(select *, {s} as s_ from {source})", "s_").replace("a.s as s_", "a.s as s", 1), _RNAMES)


_NESTED_SQL = " union all ".join([
    _nested_long("ranking_single_loan", "(select * from qr where nl = 1)"), _nested_long("ranking_by_exposure", "qd", "decile"),
    _nested_long("ranking_by_label_status", "ql", "status")])


@query("L7_full_evaluation", "block:s slice:s metric:s value:d", f"{_DEC}, {_MS} " + " union all ".join([
    _long("argmax_raw", "'all'", f"select * from {metric_sql('dec', 'raw_pred', 'p')}", _NAMES),
    _long("argmax_cal", "'all'", f"select * from {metric_sql('dec', 'cal_pred', 'm')}", _NAMES),
    _long("cost_rule", "'all'", f"select * from {metric_sql('dec', 'cost_pred', 'm')}", _NAMES),
    _long("cost_rule_by_category", "s", f"select * from {metric_sql('dec', 'cost_pred', 'm', 'current_cat')}", _NAMES),
    _rank_long("ranking", "qr"), _rank_long("ranking_by_category", "qr", "current_cat"),
    _rank_long("ranking_single_loan", "(select * from qr where nl = 1)"),
    _rank_long("ranking_by_exposure", "qd", "decile", ("exposure_min", "exposure_max")),
    _rank_long("ranking_by_label_status", "ql", "status"), _NESTED_SQL]))
def _l7(spark, sf):
    from ...session import pin
    df = pin(loan_rows(D.class_vector(spark, sf)))      # read by nine blocks
    return L.full_evaluation(df, label_ledger(D.ledger_table(spark, sf)),
                             n_loans="N_LOANS_IN_PORTFOLIO", exposure=C.EXPOSURE_FEATURE)


_PORTFOLIO = """with pf as (select national_code as loan_id, national_code, snapshot_date, max(current_cat) as current_cat, max(label) as label,
    max(sev) as sev, sum(remaining_amnt) as remaining_amnt, max(score) as score, count(*) as nl from scored group by national_code, snapshot_date),
  """ + _DEC.replace("with ", "", 1).replace("from scored)", "from pf)", 1) + """,
  q as (select d.* exclude (score), m3 as score from dec d), qr as (select * from q where current_cat < 3),
  qd as (select *, ((row_number() over (order by remaining_amnt, loan_id, snapshot_date) - 1) * 10) // (count(*) over ()) + 1 as decile from qr),
  ql as (select qr.*, status from qr join ledger using (snapshot_date))"""


@query("L7_portfolio_evaluation", "block:s slice:s metric:s value:d", f"{_PORTFOLIO} " + " union all ".join([
    _long("argmax_raw", "'all'", f"select * from {metric_sql('dec', 'raw_pred', 'p')}", _NAMES),
    _long("argmax_cal", "'all'", f"select * from {metric_sql('dec', 'cal_pred', 'm')}", _NAMES),
    _long("cost_rule", "'all'", f"select * from {metric_sql('dec', 'cost_pred', 'm')}", _NAMES),
    _long("cost_rule_by_category", "s", f"select * from {metric_sql('dec', 'cost_pred', 'm', 'current_cat')}", _NAMES),
    _rank_long("ranking", "qr"), _rank_long("ranking_by_category", "qr", "current_cat"),
    _rank_long("ranking_single_loan", "(select * from qr where nl = 1)"),
    _rank_long("ranking_by_exposure", "qd", "decile", ("exposure_min", "exposure_max")),
    _rank_long("ranking_by_label_status", "ql", "status"), _NESTED_SQL]))
def _l7p(spark, sf):
    """The same evaluation of rows that are whole portfolios: a customer's worst loan speaks for the portfolio."""
    from ...session import pin
    rows = D.scored(spark, sf).groupBy("NATIONAL_CODE", "SNAPSHOT_DATE").agg(
        F.max("CURRENT_CAT").alias("CURRENT_CAT"), F.max("LABEL").alias("LABEL"), F.max("SCORE").alias("SCORE"),
        F.sum(C.EXPOSURE_FEATURE).alias("EXPOSURE"), F.count(F.lit(1)).alias("N_LOANS_IN_PORTFOLIO"))
    s = F.col("SCORE")
    df = pin(rows.withColumns({**{f"p{k}": (1 - s) * w for k, w in enumerate((0.5, 0.3, 0.2))}, "p3": s}))
    return L.full_evaluation(df, label_ledger(D.ledger_table(spark, sf)), n_loans="N_LOANS_IN_PORTFOLIO", exposure="EXPOSURE",
                             ties=("NATIONAL_CODE", "SNAPSHOT_DATE"))


@query("L8_bootstrap_intervals", "metric:s mean:d lower_ci:d upper_ci:d")
def _l8(spark, sf):
    return L.bootstrap_intervals(decided(spark, sf), pred="PREDICTED_CLASS", draws=500)


_ROC = (f"{_DEC}, g as (select c as class, case c when 0 then m0 when 1 then m1 when 2 then m2 else m3 end as threshold, "
        "count(*) as n, sum(case when label = c then 1 else 0 end) as pos from dec, range(4) r(c) group by 1, 2)")


@query("L9_roc_points", "class:i threshold:d fpr:d tpr:d", f"""
  {_ROC} select class, threshold,
    sum(n - pos) over (partition by class order by threshold desc)::double / nullif(sum(n - pos) over (partition by class), 0) as fpr,
    sum(pos) over (partition by class order by threshold desc)::double / nullif(sum(pos) over (partition by class), 0) as tpr from g""")
def _l9(spark, sf):
    return L.roc_points(L.one_vs_rest(masked(spark, sf), I.MASKED))


@query("L9_auc", "class:i n:i n_pos:i auc:d", f"""
  {_ROC}, b as (select *, sum(n - pos) over (partition by class order by threshold) - (n - pos) as below from g)
  select class, sum(n) as n, sum(pos) as n_pos, sum(pos*(below + (n-pos)/2.0))/nullif(sum(pos)::double*(sum(n)-sum(pos)),0) as auc
  from b group by 1""")
def _l9a(spark, sf):
    return L.auc(L.one_vs_rest(masked(spark, sf), I.MASKED))


@query("L10_fold_summary", "metric:s mean:d std:d min:d max:d n:i", f"""
  with m as (select s as snapshot_date, unnest(['macro_f1','avg_cost','qwk']) as metric, unnest([macro_f1, avg_cost, qwk]) as value
     from ({_DEC} select * from {metric_sql('dec', 'cost_pred', 'm', 'snapshot_date')}))
  select metric, avg(value) as mean, stddev_pop(value) as std, min(value) as min, max(value) as max, count(value) as n
  from m group by 1""")
def _l10(spark, sf):
    """Every snapshot read as the test set of a fold."""
    per = L.classification_metrics(decided(spark, sf), pred="PREDICTED_CLASS", by=["SNAPSHOT_DATE"])
    return L.fold_summary(per.unpivot("SNAPSHOT_DATE", ["macro_f1", "avg_cost", "qwk"], "metric", "value"))
