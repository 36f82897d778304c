"""Queries for the response explorer (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.explore import api as N
from ...sources import derived as D
from ..registry import query

NUM = ["am_due", "k", "basket"]
CATS = ["grade", "region", "active"]

_RESP = """resp as (select event_type as endpoint, user_id, event_id, cast(props->>'$.k' as int) as k0, value,
      case when value > 60 then 3 when value > 35 then 2 when cast(props->>'$.k' as int) < 30 then 1 else 0 end as cat from events),
  rs as (select *, case when event_id % 9 <> 0 then ((case when value > 60 then 100 + k0 else k0 end)*1000 + cast(round(value*100) as bigint))/1000.0::double end as am_due, k0 as k,
      k0 % 7 as grade, case when event_id % 5 <> 0 then 'c' || ((user_id + k0) % 4) end as region, k0 >= 50 as active,
      case when endpoint = 'purchase' then value*2 end as basket, case when event_id = 1 then 1.5 end as rare,
      'n' || (user_id % 3) as family_name, 'v1' as version, 'id' || event_id as ref from resp),
  nl as (select endpoint, cat, 'am_due' as feature, am_due as v from rs union all select endpoint, cat, 'k', k::double from rs
         union all select endpoint, cat, 'basket', basket from rs),
  lv as (select endpoint, cat, 'grade' as feature, cast(grade as varchar) as level from rs union all select endpoint, cat, 'region', region from rs
         union all select endpoint, cat, 'active', cast(active as varchar) from rs)"""
_TYPES = {"am_due": "numeric", "k": "numeric", "grade": "categorical", "region": "categorical",
          "active": "categorical", "family_name": "pii_excluded", "version": "constant", "ref": "id_like",
          "basket": "numeric", "rare": "sparse"}


@query("N1_N2_discover", "endpoint:s feature:s type:s n_present:i null_rate:d n_unique:i", f"with {_RESP} " + " union all ".join(
    f"select endpoint, '{c}' as feature, '{t}' as type, count({c}) as n_present, round(1 - count({c})/count(*)::double, 4) as null_rate, "
    f"count(distinct {c}) as n_unique from rs group by 1 having count({c}) > 0" for c, t in _TYPES.items()))
def _n1(spark, sf):
    return N.discover(D.responses(spark, sf))


def num_long(spark, sf):
    df = D.responses(spark, sf)
    return N.returned(N.numeric_long(df, NUM), N.discover(df), "numeric")


_HAS = "(select endpoint as e2, feature as f2 from nl group by 1, 2 having count(v) >= 20)"
_NL = f"nk as (select nl.* from nl join {_HAS} h on h.e2 = endpoint and h.f2 = feature)"


@query("N3_numeric_summary", "endpoint:s feature:s cat:i n:i null_rate:d mean:d std:d min:d max:d q05:d q25:d q50:d q75:d q95:d", f"""
  with {_RESP}, {_NL} select endpoint, feature, cat, count(v) as n, round(1 - count(v)/count(*)::double, 4) as null_rate, avg(v) as mean,
    stddev_samp(v) as std, min(v) as min, max(v) as max, {', '.join(f'quantile_cont(v, 0.{q}) as q{q}' for q in ('05', '25', '50', '75', '95'))}
  from nk group by 1, 2, 3""")
def _n3(spark, sf):
    return N.summarize_numeric(num_long(spark, sf))


def _auc(src, hit, name):
    return f"""{name}g as (select endpoint, feature, v, count(*) as n, count(*) filter ({hit}) as p from {src} where v is not null group by 1, 2, 3),
    {name}b as (select *, sum(n - p) over (partition by endpoint, feature order by v) - (n - p) as below from {name}g),
    {name} as (select endpoint, feature, sum(n) as n, case when sum(n) >= 10 then
       sum(p*(below + (n - p)/2.0))/nullif(sum(p)::double*(sum(n) - sum(p)), 0) end as auc from {name}b group by 1, 2)"""


_SEPN = f"""{_auc('nk', 'cat >= 3', 'fa')}, {_auc('(select * from nk where cat < 3)', 'cat = 2', 'qa')},
  sepn as (select f.endpoint, f.feature, 'auc' as metric, round(greatest(f.auc, 1 - f.auc), 4) as value,
     case when f.auc >= 0.5 then 'high=severe' when f.auc < 0.5 then 'low=severe' else '' end as direction,
     round(greatest(q.auc, 1 - q.auc), 4) as queue_value, coalesce(q.n, 0) as queue_n
   from fa f left join qa q on q.endpoint = f.endpoint and q.feature = f.feature)"""
_SEP_COLS = "endpoint:s feature:s metric:s value:d direction:s queue_value:d queue_n:i"


@query("N4_N5_numeric_separation", _SEP_COLS, f"with {_RESP}, {_NL}, {_SEPN} select * from sepn")
def _n4(spark, sf):
    return N.separation_numeric(num_long(spark, sf))


_PROBS = "[" + ", ".join(f"{0.05*i:.2f}" for i in range(1, 20)) + "]::double[]"


@query("N6_thresholds", "endpoint:s feature:s direction:s threshold:d precision:d recall:d f1:d lift:d n_flagged:i base_rate:d", f"""
  with {_RESP}, {_NL}, cu as (select endpoint, feature, unnest(list_distinct(quantile_cont(v, {_PROBS}))) as t from nk where v is not null group by 1, 2),
  x as (select endpoint, feature, t, dir, count(*) as n, count(*) filter (cat >= 3) as pos,
        count(*) filter (case when dir = 0 then v >= t else v <= t end) as fl, count(*) filter (cat >= 3 and case when dir = 0 then v >= t else v <= t end) as tp
        from nk join cu using (endpoint, feature), range(2) d(dir) where v is not null group by 1, 2, 3, 4),
  y as (select *, tp/fl::double as pr, tp/pos::double as rc from x where tp > 0 and pos > 0 and pos < n and n >= 10),
  z as (select *, 2*pr*rc/(pr + rc) as f from y qualify row_number() over (partition by endpoint, feature order by 2*pr*rc/(pr + rc) desc, t, dir) = 1)
  select endpoint, feature, case when dir = 0 then 'high=severe' else 'low=severe' end as direction, t as threshold, round(pr, 4) as precision,
    round(rc, 4) as recall, round(f, 4) as f1, round(pr/(pos/n::double), 3) as lift, fl as n_flagged, round(pos/n::double, 4) as base_rate from z""")
def _n6(spark, sf):
    return N.suggest_thresholds(num_long(spark, sf))


def levels(spark, sf):
    return N.level_counts(D.responses(spark, sf), CATS)


@query("N7_category_rates", "endpoint:s feature:s level:s n:i severe_rate:d base_rate:d lift:d n_queue:i", f"""
  with {_RESP}, b as (select endpoint, feature, count(*) filter (cat >= 3)::double/count(*) as base from lv group by 1, 2)
  select endpoint, feature, level, count(*) as n, round(count(*) filter (cat >= 3)::double/count(*), 4) as severe_rate, round(max(base), 4) as base_rate,
    round(count(*) filter (cat >= 3)::double/count(*)/nullif(max(base), 0), 3) as lift, count(*) filter (cat < 3) as n_queue
  from lv join b using (endpoint, feature) where level is not null group by 1, 2, 3""")
def _n7(spark, sf):
    return N.category_rates(levels(spark, sf))


def _v(src, hit, name):
    return f"""{name}t as (select endpoint, feature, level, count(*) filter ({hit}) as y, count(*) filter (not ({hit})) as z from {src} where level is not null group by 1, 2, 3),
    {name}m as (select *, sum(y) over w as ty, sum(z) over w as tz, count(*) over w as k from {name}t window w as (partition by endpoint, feature)),
    {name}e as (select *, (y + z)*ty/(ty + tz)::double as ey, (y + z)*tz/(ty + tz)::double as ez from {name}m),
    {name} as (select endpoint, feature, case when max(k) >= 2 and max(ty) > 0 and max(tz) > 0 then round(sqrt(sum(
        pow(abs(y - ey) - case when k = 2 then least(0.5, abs(y - ey)) else 0 end, 2)/ey + pow(abs(z - ez) - case when k = 2 then least(0.5, abs(z - ez)) else 0 end, 2)/ez)
        /max(ty + tz)), 4) end as v, max(ty + tz) as n from {name}e group by 1, 2)"""


_SEPC = f"""{_v('lv', 'cat >= 3', 'fv')}, {_v('(select * from lv where cat < 3)', 'cat = 2', 'qv')},
  sepc as (select f.endpoint, f.feature, 'cramers_v' as metric, f.v as value, '' as direction, q.v as queue_value, q.n as queue_n
   from fv f join qv q on q.endpoint = f.endpoint and q.feature = f.feature)"""


@query("N8_cramers_v", _SEP_COLS, f"with {_RESP}, {_SEPC} select * from sepc")
def _n8(spark, sf):
    return N.separation_categorical(levels(spark, sf))


_ITEMS = """it as (select cast(o_orderkey as varchar) as national_code, cast(least(3, (o_custkey % 11)//3) as int) as current_cat, i,
      15 + (o_orderkey + i) % 4 as bankcode, cast((o_custkey*i) % 5000 as double) as am, 1 + (o_orderkey*i) % 5 as status,
      14000101 + ((o_orderkey*i) % 4)*10000 + ((o_orderkey + i) % 12)*100 + o_custkey % 28 as date, 0 as emhaldate,
      case when i = 3 then (o_custkey % 6) || '|9' else cast(o_custkey % 6 as varchar) end as reasoncode,
      'R' || (o_custkey % 9) as code, 'reason ' || (o_custkey % 9) as description
    from orders, range(1, 4) r(i) where i <= o_orderkey % 4),
  dy as (select *, date//10000 as jy, (date//100) % 100 as jm, date % 100 as jd from it),
  od as (select *, 365*(jy + 1595) + ((jy + 1595)//33)*8 + (((jy + 1595) % 33) + 3)//4 + jd + case when jm < 7 then (jm - 1)*31 else (jm - 7)*30 + 186 end
           - (365*(1403 + 1595) + ((1403 + 1595)//33)*8 + (((1403 + 1595) % 33) + 3)//4 + 1)
           + (date_diff('day', date '1970-01-01', date '2024-03-20') + 719163) as ordinal from dy)"""


@query("N9_unwrap_union", "national_code:s reasoncode:s n:i", f"with {_ITEMS} select national_code, reasoncode, count(*) as n from it group by 1, 2")
def _n9(spark, sf):
    df = D.listed_customers(spark, sf)
    t = N.item_fields(df, "rows")["reasonCode"]
    items = df.select("NATIONAL_CODE", F.explode("rows").alias("i"))
    return items.select("NATIONAL_CODE", N.unwrap_union(F.col("i.reasonCode"), t).alias("reasoncode")).groupBy(
        "NATIONAL_CODE", "reasoncode").agg(F.count(F.lit(1)).alias("n"))


@query("N10_explode_list", "national_code:s current_cat:i bankcode:i ammoavagh:d status:i date:i reasoncode:s code:s",
       f"with {_ITEMS} select distinct national_code, current_cat, bankcode, am as ammoavagh, status, date, emhaldate, reasoncode, code, description from it")
def _n10(spark, sf):
    return N.explode_list(D.listed_customers(spark, sf), "rows", ["NATIONAL_CODE", "CURRENT_CAT"])


@query("N11_jalali_ordinal", "national_code:s date:i ordinal:i zero:i", f"with {_ITEMS} select distinct national_code, date, ordinal, null::bigint as zero from od")
def _n11(spark, sf):
    items = N.explode_list(D.listed_customers(spark, sf), "rows", ["NATIONAL_CODE"])
    return items.select("NATIONAL_CODE", "date", N.jalali_ordinal(F.col("date")).alias("ordinal"),
                        N.jalali_ordinal(F.col("emhalDate")).alias("zero")).distinct()


_LIST = f"""{_ITEMS}, ag as (select national_code, count(*) as n_items, sum(am) as sm, max(am) as mx, max(status) as ms,
      min({D.LIST_AS_OF} - ordinal) as mind, max({D.LIST_AS_OF} - ordinal) as maxd, count(distinct bankcode) as n_banks,
      count(*) filter (bankcode = 17) as own_n, count(*) filter (bankcode <> 17) as ext_n, sum(am) filter (bankcode = 17) as own_sm,
      max(am) filter (bankcode = 17) as own_mx, max(status) filter (bankcode = 17) as own_ms, sum(am) filter (bankcode <> 17) as ext_sm,
      max(am) filter (bankcode <> 17) as ext_mx, max(status) filter (bankcode <> 17) as ext_ms from od group by 1),
  ro as (select cast(o_orderkey as varchar) as national_code, ag.* exclude (national_code) from orders o left join ag on ag.national_code = cast(o_orderkey as varchar))"""


def rolled(spark, sf):
    return N.roll_up_list(D.listed_customers(spark, sf), "rows", D.LIST_AS_OF, "bankCode", D.OWN_BANK)


@query("N12_list_rollup", "national_code:s n_items:i has_items:b sum_ammoavagh:d max_ammoavagh:d max_status:i",
       f"with {_LIST} select national_code, coalesce(n_items, 0) as n_items, n_items is not null as has_items, sm as sum_ammoavagh, mx as max_ammoavagh, ms as max_status from ro")
def _n12(spark, sf):
    return rolled(spark, sf)


@query("N13_list_durations", "national_code:s min_days_since_date:i max_days_since_date:i zero_dates:i",
       f"with {_LIST} select national_code, mind as min_days_since_date, maxd as max_days_since_date, 0 as zero_dates from ro")
def _n13(spark, sf):
    df = rolled(spark, sf)
    return df.withColumn("zero_dates", F.lit(int(any("since_emhalDate" in c for c in df.columns))))


@query("N14_bank_split", "national_code:s n_banks:i own_n_items:i ext_n_items:i own_sum_ammoavagh:d own_max_ammoavagh:d own_max_status:i "
       "ext_sum_ammoavagh:d ext_max_ammoavagh:d ext_max_status:i ext_share_ammoavagh:d", f"""
  with {_LIST} select national_code, n_banks, coalesce(own_n, 0) as own_n_items, coalesce(ext_n, 0) as ext_n_items, own_sm as own_sum_ammoavagh,
    own_mx as own_max_ammoavagh, own_ms as own_max_status, ext_sm as ext_sum_ammoavagh, ext_mx as ext_max_ammoavagh, ext_ms as ext_max_status,
    case when sm > 0 then ext_sm/sm end as ext_share_ammoavagh from ro""")
def _n14(spark, sf):
    return rolled(spark, sf)


@query("N15_code_reference", "code:s description:s", f"with {_ITEMS} select code, min(description) as description from it group by 1")
def _n15(spark, sf):
    items = N.explode_list(D.listed_customers(spark, sf), "rows", ["NATIONAL_CODE", "CURRENT_CAT"])
    return N.code_reference(items, ["NATIONAL_CODE"])


@query("N16_explorer_separation", _SEP_COLS, f"with {_RESP}, {_NL}, {_SEPN}, {_SEPC} select * from sepn union all select * from sepc")
def _n16(spark, sf):
    return N.explore(D.responses(spark, sf)).separation


@query("N16_explorer_lists", _SEP_COLS)
def _n16l(spark, sf):
    """The list column's items and figures, through the same statistics."""
    return N.explore(D.listed_customers(spark, sf), as_of=D.LIST_AS_OF, bank_field="bankCode",
                     own_bank_code=D.OWN_BANK).separation


@query("N17_class_composition", "endpoint:s feature:s cat:i level:s share:d", f"""
  with {_RESP}, c as (select endpoint, feature, level, cat, count(*) as n from lv where level is not null group by all),
  t as (select endpoint, feature, level from c group by 1, 2, 3 qualify row_number() over (partition by endpoint, feature order by sum(n) desc, level) <= 20)
  select endpoint, feature, cat, level, n::double/sum(n) over (partition by endpoint, feature, cat) as share from c join t using (endpoint, feature, level)""")
def _n17(spark, sf):
    return N.class_composition(levels(spark, sf))


@query("N18_histogram", "endpoint:s feature:s cat:i bin:i n:i", f"""
  with {_RESP}, {_NL}, q as (select endpoint, feature, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from nk where v is not null group by 1, 2)
  select endpoint, feature, cat, least(39, floor((least(greatest(v, lo), hi) - lo)/(hi - lo)*39) + 1) as bin, count(*) as n
  from nk join q using (endpoint, feature) where v is not null group by 1, 2, 3, 4""")
def _n18(spark, sf):
    return N.histogram(num_long(spark, sf))
