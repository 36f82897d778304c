"""Queries for arms (G), calibration (H), full scoring (J3) and artifacts (A16).

Fitted models are checked by rows and invariants; the parts that are plain
arithmetic have SQL. Trees are few and shallow here; the rows are all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ... import constants as C
from ...operators import arms as G
from ...operators import calibrate as H
from ...operators import maturity as E
from ...operators import queue as Q
from ...operators.grain import loan_rows
from ...operators.preprocess import Preprocessor
from ...session import pin, scratch_root
from ...sources import artifact as A
from ...sources import derived as D
from ...sources.tables import label_ledger
from .. import score as SC
from .. import train as TR
from ..registry import query
from .evaluate import _DEC, _VEC
from .ranking import ACT_THRESHOLD, AS_OF
from .shape import FEATS

SMALL = {"n_trees": 3, "max_depth": 3, "learning_rate": 0.3}
_P = "loan_id:i snapshot_date:i current_cat:i p0:d p1:d p2:d p3:d"


def ledger(spark, sf):
    """The ledger, written once: a row for each month, which every step asks for."""
    return pin(label_ledger(D.ledger_table(spark, sf)))


#: Columns of the loan table that models are fitted and evaluated on.
MODELLED = ["LOAN_ID", "SNAPSHOT_DATE", "NATIONAL_CODE", "WORST_FUTURE_CAT", *FEATS]


def tables(spark, sf, columns=("*",)):
    """The loan table, written once (fitting, shaping and scoring read it several times), and the ledger."""
    return pin(D.feed_with_open_labels(spark, sf).select(*columns)), ledger(spark, sf)


def split(spark, sf):
    return TR.static_split(*tables(spark, sf, MODELLED))


def shaped(spark, sf):
    """Preprocessed rows of the static split."""
    rows = split(spark, sf)
    pre = Preprocessor(FEATS).fit(rows.where("SPLIT = 'train'"))
    return pre, pin(A.shape_rows(rows, pre, FEATS, keep_columns=("SPLIT",)))


def _arm(kind):
    def run(spark, sf):
        _, rows = shaped(spark, sf)
        arm = G.fit_arm(kind, rows.where("SPLIT = 'train'"), FEATS, SMALL)
        return arm.predict(rows.where("SPLIT = 'test'"))
    return run


@query("G1_class_weights", "label:i weight:d", f"""
  with n as (select label, count(*) as n from scored group by 1)
  select label, (sum(n) over ())::double/((count(*) over ())*n) * case label {' '.join(f'when {k} then {sum(C.COST_MATRIX[k])}' for k in range(4))} end as weight from n""")
def _g1(spark, sf):
    return G.class_weights(D.scored(spark, sf), cost_matrix=C.COST_MATRIX)


for _name, _kind in (("G2_multiclass_arm", "multiclass"), ("G3_binary_arm", "binary"),
                     ("G4_ordinal_arm", "ordinal"), ("G5_per_category_arm", "per_cat")):
    query(_name, _P)(_arm(_kind))


@query("G4_ordinal_combination", "loan_id:i snapshot_date:i q0:d q1:d q2:d q3:d", f"""
  with {_VEC}, c as (select loan_id, snapshot_date, 1 - p0 as a, least(1 - p0, p2 + p3 + 0.1) as b, least(1 - p0, p2 + p3 + 0.1, p3*1.2) as d from vec),
  r as (select *, greatest(1 - a, 1e-9) as x0, greatest(a - b, 1e-9) as x1, greatest(b - d, 1e-9) as x2, greatest(d, 1e-9) as x3 from c)
  select loan_id, snapshot_date, {', '.join(f'x{k}/(x0+x1+x2+x3) as q{k}' for k in range(4))} from r""")
def _g4c(spark, sf):
    df = D.class_vector(spark, sf)
    cum = [1 - F.col("p0"), F.col("p2") + F.col("p3") + 0.1, F.col("p3") * 1.2]
    return df.select("LOAN_ID", "SNAPSHOT_DATE",
                     *[c.alias(f"q{k}") for k, c in enumerate(G.ordinal_distribution(cum))])


@query("G7_tune_arm", "params:s ap:d")
def _g7(spark, sf):
    _, rows = shaped(spark, sf)
    return G.tune_arm("multiclass", rows.where("SPLIT = 'train'"), rows.where("SPLIT = 'val'"), FEATS,
                      {"n_trees": [2], "max_depth": [2, 3], "learning_rate": [0.3]})[1]


@query("G7_ranked_severe_ap", "ap:d", """
  with g as (select score, count(*) as n, sum(sev) as tp from ranked group by 1),
  c as (select tp, sum(n) over w as cn, sum(tp) over w as ctp from g window w as (order by score desc))
  select sum(tp*(ctp::double/cn))/sum(tp) as ap from c""")
def _g7a(spark, sf):
    ap = G.ranked_severe_ap(D.class_vector(spark, sf))
    return spark.createDataFrame([(ap,)], "ap double")


def fitted(loans, led, **kw):
    return TR.train_fold(TR.static_split(loans, led), FEATS, led, params=SMALL, draws=100,
                         min_stratum_n=1000, **kw)


@query("G8_raw_scores", _P)
def _g8(spark, sf):
    """Score the open snapshots at the model's own grain (here: portfolios)."""
    loans, led = pin(D.loan_feed(spark, sf).select(*MODELLED, "WORST_FUTURE_DPD")), ledger(spark, sf)
    rows = TR.static_split(D.with_open_labels(loans), led)
    pre = Preprocessor(FEATS).fit(rows.where("SPLIT = 'train'"))
    train = pin(A.shape_rows(rows.where("SPLIT = 'train'"), pre, FEATS, "portfolio"))
    model = A.Model(pre, G.fit_arm("multiclass", train, A.model_columns(FEATS, "portfolio"), SMALL),
                    None, FEATS, "portfolio")
    wanted = E.open_snapshots(loans, led)
    loans = loans.join(F.broadcast(wanted), "SNAPSHOT_DATE", "left_semi")
    return model.raw_probs(loans).withColumn("LOAN_ID", F.lit(None).cast("bigint"))


@query("G9_train_fold", "arm:s block:s slice:s metric:s value:d")
def _g9(spark, sf):
    return fitted(*tables(spark, sf, MODELLED), arms=("multiclass", "binary"), deploy="auto").metrics


def _val_scores(spark, sf):
    return D.class_vector(spark, sf)


def _isotonic_sql(fit: str, strata: str) -> str:
    """CTEs up to ``blk``: the isotonic blocks (lower hulls of cumulated counts) of the rows of ``fit``, by (stratum, class).

    ``strata`` selects the categories with curves of their own; -1 is the pooled stratum.
    The hull is walked from vertex to vertex: the next one has the least slope, the last of equals.
    """
    return f"""recursive {_VEC}, fitted as ({fit}),
  e as (select current_cat, c as class, case c when 0 then p0 when 1 then p1 when 2 then p2 else p3 end as score, (label = c)::int as hit
     from fitted, range(4) r(c)),
  own as ({strata}),
  g as (select -1 as stratum, class, score, count(*) as n, sum(hit) as hits from e group by 2, 3
     union all select current_cat, class, score, count(*), sum(hit) from e where current_cat in (select current_cat from own) group by 1, 2, 3),
  pts as (select stratum, class, score, sum(n) over w as w, sum(hits) over w as h from g window w as (partition by stratum, class order by score)),
  hull(stratum, class, w, h, lo, hi, w0, h0, block) as (
    select distinct stratum, class, 0::hugeint, 0::hugeint, null::double, null::double, 0::hugeint, 0::hugeint, -1 from pts
    union all
    select stratum, class, nxt.w, nxt.h, lo, nxt.score, w0, h0, block + 1 from (
      select u.stratum, u.class, u.w as w0, u.h as h0, u.block, min(p.score) as lo,
        arg_min({{'w': p.w, 'h': p.h, 'score': p.score}}, {{'slope': (p.h - u.h)::double / (p.w - u.w)::double, 'late': -p.w}}) as nxt
      from hull u join pts p on p.stratum = u.stratum and p.class = u.class and p.w > u.w group by 1, 2, 3, 4, 5)),
  blk as (select stratum, class, block, lo, hi, w - w0 as n, h - h0 as hits, (h - h0)::double / (w - w0)::double as v,
      lead(lo) over c as next_lo, lead((h - h0)::double / (w - w0)::double) over c as next_v
    from hull where block >= 0 window c as (partition by stratum, class order by block))"""


def _calibrated_sql(fit: str, strata: str) -> str:
    return f"""with {_isotonic_sql(fit, strata)},
  f as (select loan_id, snapshot_date, current_cat, c as class, case when current_cat in (select current_cat from own) then current_cat else -1 end as stratum,
     case c when 0 then p0 when 1 then p1 when 2 then p2 else p3 end as score from vec, range(4) r(c)),
  l as (select f.*, greatest(1e-6, case when score <= hi or next_lo is null then v else v + (next_v - v) * ((score - hi) / (next_lo - hi)) end) as q
     from f join blk b on b.stratum = f.stratum and b.class = f.class and (b.block = 0 or f.score >= b.lo) and (b.next_lo is null or f.score < b.next_lo))
  select loan_id, snapshot_date, current_cat, {', '.join(f"max(case when class = {k} then q end) / sum(q) as p{k}" for k in range(4))}
  from l group by 1, 2, 3"""


_NO_STRATA = "select current_cat from fitted where false"


def _strata(least: int) -> str:
    return f"select current_cat from fitted group by 1 having count(*) >= {least}"


@query("H1_H2_isotonic", _P, _calibrated_sql("select * from vec", _NO_STRATA))
def _h1(spark, sf):
    df = pin(_val_scores(spark, sf))
    return H.fit_calibrator(df, stratified=False).transform(df)


@query("H3_isotonic_blocks", "stratum:i class:i block:i lo:d hi:d n:i hits:i", f"""
  with {_isotonic_sql("select * from vec", _strata(C.CALIBRATION_MIN_STRATUM_N))}
  select case when stratum >= 0 then stratum end as stratum, class, block, lo, hi, n, hits from blk""")
def _h3b(spark, sf):
    return H.fit_calibrator(_val_scores(spark, sf)).blocks


@query("H1_score_groups", "cat:i class:i score:d n:i hits:i", f"""
  with {_VEC}, e as (select current_cat, c as class, case c when 0 then p0 when 1 then p1 when 2 then p2 else p3 end as score, (label = c)::int as hit
     from vec, range(4) r(c))
  select current_cat as cat, class, score, count(*) as n, sum(hit) as hits from e group by 1, 2, 3""")
def _h1g(spark, sf):
    return H.score_groups(_val_scores(spark, sf))


@query("H3_stratified_calibration", _P, _calibrated_sql("select * from vec", _strata(C.CALIBRATION_MIN_STRATUM_N)))
def _h3(spark, sf):
    df = pin(_val_scores(spark, sf))
    return H.fit_calibrator(df).transform(df)


@query("H4_refreshed_calibration", _P, _calibrated_sql(
    "select * from vec where snapshot_date = (select max(snapshot_date) from ledger where status in ('FINAL', 'LEGACY') and snapshot_date in (select snapshot_date from vec))",
    _strata(C.CALIBRATION_MIN_STRATUM_N)))
def _h4(spark, sf):
    """A calibrator of all history, refreshed on the newest finalised snapshot."""
    df = pin(_val_scores(spark, sf))
    old = H.fit_calibrator(df)
    newest = E.mature_snapshots(df, ledger(spark, sf)).agg(F.max("SNAPSHOT_DATE")).first()[0]
    fresh = H.refresh(old, df.where(F.col("SNAPSHOT_DATE") == newest))
    return fresh.transform(df)


@query("J3_full_scoring", "risk_rank:i loan_id:i snapshot_date:i national_code:s n_loans_in_portfolio:i current_cat:i p_severe_past_due:d "
       "predicted_class:i risk_score:d expected_cost:d customer_max_risk_score:d rule_flag:s", f"""
  {_DEC}, x as (select d.*, count(*) over (partition by d.national_code, snapshot_date) as nl, max(m3) over (partition by d.national_code, snapshot_date) as cm,
      case when current_cat >= 3 then 'ALREADY_SEVERE' when snapshot_date < max(snapshot_date) over (partition by d.national_code) then 'SUPERSEDED'
           when m3 >= {ACT_THRESHOLD} then 'PREDICTED_SEVERE' when c.national_code is not null then 'RECENTLY_CALLED' else '' end as flag
    from dec d left join (select national_code from calls where called_at >= timestamp '{AS_OF}' - interval 30 day) c on c.national_code = d.national_code)
  select case when flag = '' then row_number() over (order by case when flag = '' then 0 else 1 end, m3 desc, national_code, loan_id, snapshot_date) end as risk_rank,
    loan_id, snapshot_date, national_code, nl as n_loans_in_portfolio, current_cat, m3 as p_severe_past_due, cost_pred as predicted_class,
    m3 as risk_score, c0 as expected_cost, cm as customer_max_risk_score, flag as rule_flag from x""")
def _j3(spark, sf):
    rows = pin(loan_rows(D.class_vector(spark, sf)))
    return Q.build_queue(rows, D.called_log(spark, sf), AS_OF, act_threshold=ACT_THRESHOLD)


@query("J3_model_scoring", "risk_rank:i loan_id:i snapshot_date:i risk_score:d rule_flag:s")
def _j3m(spark, sf):
    """Train, store the model, read it back and score all open snapshots."""
    loans, led = tables(spark, sf)
    res = fitted(loans, led, arms=("multiclass",))
    path = f"{scratch_root(spark)}/model-{uuid.uuid4().hex}"
    A.save(res.model, spark, path)
    params = SC.ScoringParams(path, as_of=AS_OF, act_threshold=0.9, min_stratum_n=1000)
    return SC.predict(spark, loans, led, params)


@query("A16_model_artifact", _P)
def _a16(spark, sf):
    """The same test rows scored by a model before and after storing it."""
    rows = split(spark, sf)
    pre = Preprocessor(FEATS).fit(rows.where("SPLIT = 'train'"))
    train = pin(A.shape_rows(rows.where("SPLIT = 'train'"), pre, FEATS))
    model = A.Model(pre, G.fit_arm("per_cat", train, FEATS, SMALL), None, FEATS)
    path = f"{scratch_root(spark)}/model-{uuid.uuid4().hex}"
    A.save(model, spark, path)
    return A.load(spark, path).raw_probs(rows.where("SPLIT = 'test'"))
