"""Shared SQL of the reference queries: the derived loan inputs."""

BASE = """
with st as (
  select l_orderkey as loan_id, date_trunc('month', l_shipdate) as month_ts,
         cast(year(l_shipdate)*10000 + month(l_shipdate)*100 + 1 as bigint) as month_end,
         year(l_shipdate)*12 + month(l_shipdate) as month_no,
         cast(max(case when l_returnflag='N' then 0 when l_returnflag='A' then l_quantity
                       else 4*l_quantity end) as int) as dpd,
         case when l_orderkey % 17 = 0 then 0 else 1 end as has_installments,
         date_trunc('month', l_shipdate) + interval 1 month + interval 3 day as built_at,
         count(*) as n_inst,
         sum(cast(round(l_extendedprice*100) as bigint)) as amt_cents,
         sum(case when l_returnflag='R' then cast(round(l_extendedprice*100) as bigint) else 0 end) as r_cents,
         sum(case when l_returnflag='R' then 1 else 0 end) as n_r,
         sum(case when l_returnflag='N' then 1 else 0 end) as n_n,
         sum(cast(l_quantity as bigint)) as qty
  from lineitem group by all),
wide as (
  select st.*, o_custkey,
         coalesce(lag(dpd) over past, 0) as dpd_days_t1,
         max(dpd) over (partition by loan_id order by month_no rows between unbounded preceding and 1 preceding) as hist_max,
         max(case when dpd > 0 then month_ts end) over (partition by loan_id order by month_no rows between unbounded preceding and current row) as late_ts,
         month_no - min(month_no) over (partition by loan_id) as age,
         max(dpd) over (partition by loan_id order by month_no range between current row and 6 following) as worst_dpd,
         count(*) over (partition by loan_id order by month_no range between current row and 6 following) as state_rows
  from st join orders on o_orderkey = loan_id
  window past as (partition by loan_id order by month_no)),
feed as (
  select loan_id, month_end as snapshot_date, cast(o_custkey as varchar) as national_code,
         concat('C', loan_id) as contract_number,
         dpd as dpd_days,
         case when dpd>=181 then 4 when dpd>=156 then 3 when dpd>=61 then 2 when dpd>=1 then 1 else 0 end as loan_category,
         cast(n_inst as int) as unpayed_inst_cnt,
         cast(r_cents as double)/100.0 as payed_overdue_amnt,
         cast(n_r as double)/n_inst as overdue_ratio,
         case when dpd between 45 and 60 then 1 else 0 end as is_in_warning_zone,
         case when loan_id % 11 <> 0 then cast(n_n as double)/n_inst end as ontime_ratio,
         case when loan_id % 7 <> 0 then cast(qty as double) end as upcoming_amnt,
         dpd_days_t1, hist_max as hist_max_dpd_days,
         coalesce(date_diff('day', late_ts, month_ts), 99999) as days_since_last_dpd,
         age as contract_age_month,
         cast(amt_cents as double)/100.0 as remaining_amnt,
         worst_dpd as worst_future_dpd,
         case when worst_dpd>=181 then 4 when worst_dpd>=156 then 3 when worst_dpd>=61 then 2 when worst_dpd>=1 then 1 else 0 end as worst_future_cat,
         cast(year(month_ts + interval 6 month)*10000 + month(month_ts + interval 6 month)*100 + 1 as bigint) as label_horizon_date,
         month_ts, state_rows
  from wide),
scored as (
  select loan_id, national_code, snapshot_date, dpd_days, least(loan_category, 3) as current_cat,
         least(worst_future_cat, 3) as label, case when worst_future_cat >= 3 then 1 else 0 end as sev,
         remaining_amnt, state_rows, worst_future_dpd,
         (2 + 10*least(loan_category, 2) + ((loan_id*7919 + snapshot_date) % 1000 * 4 + 50) // 100
            + case when worst_future_cat >= 3 and loan_id % 3 <> 0 then 30 else 0 end) / 100.0 as score
  from feed),
ranked as (select * from scored where current_cat < 3),
snaps as (select distinct month_end as snapshot_date, month_ts from st),
ledger as (
  select month_end as snapshot_date, case when month_end <= 19991201 then 'LEGACY' else 'FINAL' end as status,
         max(month_ts) + interval 7 month as finalized_at,
         case when month_end > 19991201 then sum(case when loan_id % 97 = 0 then 1 else 0 end) end as loans_unlabelled,
         case when month_end > 19991201 then 0 end as loans_missing_months
  from st where month_end <= 20010501 group by month_end),
feed_open as (
  select * replace (
           case when snapshot_date <= 20010501 and not (loan_id % 97 = 0 and snapshot_date > 19991201) then worst_future_dpd end as worst_future_dpd,
           case when snapshot_date <= 20010501 and not (loan_id % 97 = 0 and snapshot_date > 19991201) then worst_future_cat end as worst_future_cat)
  from feed),
runs as (
  select 'op-' || snapshot_date || suffix as operation_id, snapshot_date, status as operation_status,
         month_ts + to_days(cast(days as int)) as operation_date,
         case when suffix = 'b' then 3 else 0 end as inference_failures
  from snaps, (values ('a','SUCCESS',2,1), ('b','PARTIAL_SUCCESS',5,3), ('c','FAILED',9,5)) v(suffix, status, days, every)
  where month(month_ts) % every = 0),
calls as (
  select cast(user_id as varchar) as national_code, max(ts) as called_at
  from events where event_type = 'signup' and value > 120 group by 1)"""
