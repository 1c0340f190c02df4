"""The same results in SQL for another engine, written from the definitions and,
where there is a choice, in another shape than the Spark plan. A billionth goes in
before rounding, as in ``catalog.rounded``."""

from __future__ import annotations

_PRICE = "l_extendedprice / l_quantity"
_MONEY = "cast(l_extendedprice as decimal(12,2))"
_RATE = "cast(l_discount as decimal(4,2))"
_NET = f"{_MONEY} * (1 - {_RATE})"
_BRANDED = f"(select l.*, p_brand, {_PRICE} as unit_price from lineitem l join part on l_partkey = p_partkey)"
_DAILY = f"""(select l_partkey, cast(l_shipdate as date) as "day", count(*) as lines, sum({_PRICE}) as price_sum,
    cast(sum({_MONEY}) as double) / sum(l_quantity) as price
    from lineitem group by 1, 2)"""
_SUPPLIER_PRICES = f"""(select l_partkey, l_suppkey, cast(sum({_MONEY}) as double) / sum(l_quantity) as price
    from lineitem group by 1, 2)"""
_WATERMARK = "(select date_trunc('milliseconds', max(ts)) - interval 10 minutes from events)"
_VALUE = "cast(sum(cast(value as decimal(12,2))) as double)"


def _quantiles(**probs: float) -> str:
    return ", ".join(f"round(quantile_cont(unit_price, {p}) + 1e-9, 6) as {name}" for name, p in probs.items())


def _year(year: int) -> str:
    return f"select l_partkey from lineitem where year(l_shipdate) = {year}"


def _period(year: int) -> str:
    return f"""select l_partkey, sum(l_quantity) as quantity, sum({_MONEY}) as amount,
        cast(sum({_MONEY}) as double) / sum(l_quantity) as price
        from lineitem where year(l_shipdate) = {year} group by 1"""


def _revenue(grouping: str, extra: str) -> str:
    return f"""select l_returnflag, l_linestatus, cast(sum({_MONEY}) as double) as amount,
        cast(sum({_NET}) as double) as net, count(*) as lines, {extra}
        from lineitem group by {grouping}"""


_ASOF = """select p.event_id, p.user_id, p.ts, p.value, v.ts as view_ts, v.value as view_value
    from (select * from events where event_type = 'purchase') p
    asof left join (select * from events where event_type = 'view') v
    on p.user_id = v.user_id and p.ts >= v.ts"""

_INTERVAL = """select v.user_id, v.event_id as view_id, v.ts as view_ts, v.value as view_value,
    p.event_id as purchase_id, p.ts as purchase_ts, p.value as purchase_value
    from events v join events p on v.user_id = p.user_id
    and p.ts between v.ts and v.ts + interval 1 hour
    where v.event_type = 'view' and p.event_type = 'purchase'"""

ORACLE = {
    "price_fact": f"""select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, p_brand, n_name, r_name,
        {_PRICE} as unit_price, cast({_NET} as double) as net_price, cast({_MONEY} * {_RATE} as double) as discount_amount,
        year(l_shipdate) as year, month(l_shipdate) as month
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "written_by_year": f"""select year(l_shipdate) as y, count(*) as lines, cast(sum({_MONEY}) as double) as amount
        from lineitem group by 1""",
    "deduped_lines": """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, l_suppkey, l_extendedprice
        from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_discount nulls first,
        l_extendedprice nulls first, l_linestatus nulls first, l_partkey nulls first, l_quantity nulls first,
        l_returnflag nulls first, l_shipdate nulls first, l_suppkey nulls first, l_tax nulls first) as n from lineitem)
        where n = 1""",
    "quality_report": """select count(*) as rows,
        count(*) filter (where l_quantity is null) / count(*) as null_share_quantity,
        count(*) filter (where l_extendedprice is null) / count(*) as null_share_extendedprice,
        count(*) filter (where l_discount is null) / count(*) as null_share_discount,
        count(*) filter (where l_shipdate is null) / count(*) as null_share_shipdate,
        count(*) filter (where l_discount < 0 or l_discount > 0.1) as bad_discount,
        count(*) filter (where l_quantity <= 0) as bad_quantity,
        count(*) filter (where l_extendedprice <= 0) as bad_price,
        count(*) - count(distinct (l_orderkey, l_linenumber)) as surplus_keys
        from lineitem""",
    "price_summary": f"""select p_brand, count(*) as lines, round(avg(unit_price) + 1e-9, 6) as mean_price,
        round(stddev_samp(unit_price) + 1e-9, 6) as sd_price, round(min(unit_price) + 1e-9, 6) as min_price,
        round(max(unit_price) + 1e-9, 6) as max_price,
        round(cast(sum({_MONEY}) as double) / sum(l_quantity) + 1e-9, 6) as weighted_price
        from {_BRANDED} group by 1""",
    "price_quantiles": f"""select p_brand, count(*) as n, {_quantiles(p05=0.05, q1=0.25, median=0.5, q3=0.75, p95=0.95)}
        from {_BRANDED} group by 1""",
    "price_quantiles_approx": f"""select p_brand, count(unit_price) as n, true as p05_near, true as q1_near, true as median_near,
        true as q3_near, true as p95_near from {_BRANDED} group by 1""",
    "products_approx": f"select p_brand, count(distinct l_partkey) as products, true as near from {_BRANDED} group by 1",
    "products_by_year_sketched": f"""select p_brand, year(l_shipdate) as year, count(distinct l_partkey) as products, true as near
        from {_BRANDED} group by 1, 2""",
    # Spark gives the population form of skewness; the factor undoes the sample correction.
    "price_shape": f"""select p_brand, round(skewness(unit_price) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) + 1e-9, 6)
        as skewness, round(kurtosis_pop(unit_price) + 1e-9, 6) as kurtosis from {_BRANDED} group by 1""",
    "revenue_cube": _revenue(
        "cube (l_returnflag, l_linestatus)",
        "grouping(l_returnflag) as all_flags, grouping(l_linestatus) as all_statuses",
    ),
    "revenue_rollup": _revenue("rollup (l_returnflag, l_linestatus)", "grouping(l_returnflag, l_linestatus) as level"),
    "revenue_grouping_sets": _revenue(
        "grouping sets ((l_returnflag), (l_linestatus), ())", "grouping(l_returnflag, l_linestatus) as level"
    ),
    "net_revenue": f"""select year(l_shipdate) as year, l_returnflag, cast(sum({_MONEY}) as double) as gross,
        cast(sum({_MONEY} * {_RATE}) as double) as discount, cast(sum({_NET}) as double) as net
        from lineitem group by 1, 2""",
    "discount_bands": f"""select cast(cast(round(l_discount * 100) as bigint) // 2 as bigint) as band, count(*) as lines,
        round(avg({_PRICE}) + 1e-9, 6) as mean_price, round(count(*) / (select count(*) from lineitem) + 1e-9, 6) as share
        from lineitem group by 1""",
    "lead_time_curve": f"""select case when d between 0 and 7 then '0-7' when d between 8 and 30 then '8-30'
        when d between 31 and 90 then '31-90' else '91+' end as lead, count(*) as lines,
        round(avg(p) + 1e-9, 6) as mean_price, round(avg(l_discount) + 1e-9, 6) as mean_discount
        from (select datediff('day', o_orderdate, l_shipdate) as d, {_PRICE} as p, l_discount
              from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate) group by 1""",
    "seasonal_index": f"""with m as (select month(l_shipdate) as month, avg({_PRICE}) as p from lineitem group by 1)
        select month, round(p + 1e-9, 6) as mean_price, round(p / (select avg(p) from m) + 1e-9, 6) as seasonal from m""",
    "price_elasticity": f"""select p_brand, round(regr_slope(ln(l_quantity), ln(unit_price)) + 1e-9, 6) as slope,
        round(regr_intercept(ln(l_quantity), ln(unit_price)) + 1e-9, 6) as intercept,
        round(regr_r2(ln(l_quantity), ln(unit_price)) + 1e-9, 6) as r2, count(*) as lines from {_BRANDED} group by 1""",
    "price_matrix": "select p_brand, "
    + ", ".join(f"round(avg(unit_price) filter (where year(l_shipdate) = {y}) + 1e-9, 6) as y{y}" for y in range(1995, 2002))
    + f" from {_BRANDED} group by 1",
    "price_list": f"""with b as {_BRANDED}
        select k.p_brand, y.year, round(avg(unit_price) + 1e-9, 6) as mean_price
        from (select distinct p_brand from b) k cross join (select range as year from range(1995, 2002)) y
        left join b on b.p_brand = k.p_brand and year(l_shipdate) = y.year group by 1, 2""",
    "asof_last_view": _ASOF,
    "asof_by_number": """select p.event_id, p.user_id, p.ts, p.value, max(v.ts) as view_ts, max_by(v.value, v.ts) as view_value
        from events p left join events v on p.user_id = v.user_id and v.event_type = 'view' and v.ts <= p.ts
        where p.event_type = 'purchase' group by 1, 2, 3, 4""",
    "asof_two_tables": """select e.event_id, e.user_id, e.ts, c.ts as last_ts, c.value as last_value
        from (select * from events where event_type = 'error') e
        asof left join (select * from events where event_type = 'click') c
        on e.user_id = c.user_id and e.ts >= c.ts""",
    "interval_join": _INTERVAL,
    "band_join": f"""select band, count(*) as lines, round(avg(p) + 1e-9, 6) as mean_price
        from (select {_PRICE} as p from lineitem) join (values ('under 100', 0.0, 100.0), ('100-500', 100.0, 500.0),
        ('500-1000', 500.0, 1000.0), ('1000-5000', 1000.0, 5000.0), ('5000 up', 5000.0, 1e300)) b(band, low, high)
        on p >= low and p < high group by 1""",
    "orders_with_lines": """select o_orderkey, o_custkey, o_totalprice from orders
        where exists (select 1 from lineitem where l_orderkey = o_orderkey)""",
    "orders_without_lines": """select o_orderkey, o_custkey, o_totalprice from orders
        where o_orderkey not in (select l_orderkey from lineitem)""",
    "matched_periods": f"""select coalesce(a.l_partkey, b.l_partkey) as l_partkey, a.quantity as quantity_1,
        cast(a.amount as double) as amount_1, a.price as price_1, b.quantity as quantity_2,
        cast(b.amount as double) as amount_2, b.price as price_2
        from ({_period(1996)}) a full join ({_period(1997)}) b on a.l_partkey = b.l_partkey""",
    "supplier_position": f"""select l_partkey, l_suppkey, price,
        rank() over (partition by l_partkey order by price) as rank,
        dense_rank() over (partition by l_partkey order by price) as dense_rank,
        ntile(4) over (partition by l_partkey order by price, l_suppkey) as tile from {_SUPPLIER_PRICES}""",
    "market_gap": f"""with s as {_SUPPLIER_PRICES}
        select s.l_partkey, l_suppkey, price, round((total - price) / nullif(n - 1, 0) + 1e-9, 4) as market_price,
        round(price - (total - price) / nullif(n - 1, 0) + 1e-9, 4) as gap
        from s join (select l_partkey, sum(price) as total, count(*) as n from s group by 1) t
        on s.l_partkey = t.l_partkey""",
    "median_gap": f"""select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l.l_partkey, l_suppkey,
        {_PRICE} as unit_price, round(m + 1e-9, 4) as median_price, round({_PRICE} - m + 1e-9, 4) as gap
        from lineitem l join (select l_partkey, median({_PRICE}) as m from lineitem group by 1) t
        on l.l_partkey = t.l_partkey""",
    "price_change": f"""select l_partkey, "day", price, lag(price) over w as previous_price,
        datediff('day', lag("day") over w, "day") as days_since, price - lag(price) over w as change
        from {_DAILY} window w as (partition by l_partkey order by "day")""",
    "rolling_price": f"""select a.l_partkey, a."day", cast(count(*) as bigint) as lines, round(avg({_PRICE}) + 1e-9, 4) as rolling_price
        from (select distinct l_partkey, cast(l_shipdate as date) as "day" from lineitem) a
        join lineitem l on l.l_partkey = a.l_partkey
        and cast(l_shipdate as date) between a."day" - 30 and a."day" group by 1, 2""",
    "rolling_activity": """select event_id, user_id, ts, count(*) over w as events_1d,
        cast(sum(cast(value as decimal(18,2))) over w as double) as value_1d from events
        window w as (partition by user_id order by ts range between interval 1 day preceding and current row)""",
    "open_close": f"""select distinct l_partkey, year("day") as year, first_value(price) over w as open,
        last_value(price) over w as close, max(price) over w as high, min(price) over w as low from {_DAILY}
        window w as (partition by l_partkey, year("day") order by "day"
        rows between unbounded preceding and unbounded following)""",
    "revenue_classes": f"""with r as (select l_partkey, sum({_NET}) as revenue from lineitem group by 1),
        c as (select *, cast(sum(revenue) over (order by revenue desc, l_partkey rows unbounded preceding) as double)
        / (select cast(sum(revenue) as double) from r) as share from r)
        select l_partkey, cast(revenue as double) as revenue, round(share + 1e-9, 6) as cum_share,
        case when share <= 0.8 then 'A' when share <= 0.95 then 'B' else 'C' end as class from c""",
    "list_price_position": """select p_partkey, p_retailprice,
        round(percent_rank() over (order by p_retailprice) + 1e-9, 6) as percent_rank,
        round(cume_dist() over (order by p_retailprice) + 1e-9, 6) as cume_dist from part""",
    "top_prices": f"""select p_brand, place, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, unit_price
        from (select *, row_number() over (partition by p_brand order by unit_price desc, l_orderkey, l_linenumber,
        l_partkey, l_suppkey, l_extendedprice) as place from {_BRANDED}) where place <= 3""",
    "price_index": f"""with s as (select p_brand, year(l_shipdate) as period, sum(l_quantity) as q,
        cast(sum({_MONEY}) as double) / sum(l_quantity) as p from {_BRANDED} group by 1, 2),
        m as (select b.period, b.p as p1, b.q as q1, a.p as p0, a.q as q0
        from s b join s a on a.p_brand = b.p_brand and a.period = 1995)
        select period, count(*) as units, round(sum(p1 * q0) / sum(p0 * q0) + 1e-9, 6) as laspeyres,
        round(sum(p1 * q1) / sum(p0 * q1) + 1e-9, 6) as paasche,
        round(sqrt(sum(p1 * q0) / sum(p0 * q0) * sum(p1 * q1) / sum(p0 * q1)) + 1e-9, 6) as fisher,
        round(exp(avg(ln(p1 / p0))) + 1e-9, 6) as jevons from m group by 1""",
    "revenue_split": f"""with a as ({_period(1996)}), b as ({_period(1997)}),
        m as (select a.amount as a0, b.amount as a1, a.quantity as q0, b.quantity as q1, a.price as p0, b.price as p1
        from a join b on a.l_partkey = b.l_partkey),
        t as (select cast(sum(a0) as double) as a0, sum(q1) / sum(q0) - 1 as growth, sum((p1 - p0) * q1) as pe,
        sum(p0 * (q1 - q0)) as qe from m)
        select cast((select sum(amount) from a) as double) as revenue_1, cast((select sum(amount) from b) as double) as revenue_2,
        coalesce(cast((select sum(amount) from b where l_partkey not in (select l_partkey from a)) as double), 0) as new_items,
        coalesce(-cast((select sum(amount) from a where l_partkey not in (select l_partkey from b)) as double), 0) as lost_items,
        round(pe + 1e-9, 2) as price_effect, round(a0 * growth + 1e-9, 2) as volume_effect, round(qe - a0 * growth + 1e-9, 2) as mix_effect from t""",
    "quartile_outliers": f"""with b as {_BRANDED}, f as (select p_brand, quantile_cont(unit_price, 0.25) as q1,
        quantile_cont(unit_price, 0.75) as q3 from b group by 1)
        select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey, b.p_brand, unit_price,
        round(q1 - 1.5 * (q3 - q1) + 1e-9, 4) as low, round(q3 + 1.5 * (q3 - q1) + 1e-9, 4) as high
        from b join f on b.p_brand = f.p_brand
        where unit_price < q1 - 1.5 * (q3 - q1) or unit_price > q3 + 1.5 * (q3 - q1)""",
    "median_deviation": f"""select p_brand, round(median(unit_price) + 1e-9, 6) as median_price, count(*) as n,
        round(mad(unit_price) + 1e-9, 6) as mad from {_BRANDED} group by 1""",
    "sold_in_both_years": f"""select distinct l_partkey from ({_year(1996)})
        where l_partkey in ({_year(1997)})""",
    "sold_only_first_year": f"{_year(1996)} except {_year(1997)}",
    "surplus_sales": f"{_year(1996)} except all {_year(1997)}",
    "stacked_series": f"""select cast(date_trunc('month', l_shipdate) as date) as month,
        cast(cast(sum({_NET}) as decimal(38,2)) as double) as amount, count(*) as rows, 'revenue' as series
        from lineitem group by 1 union all
        select cast(date_trunc('month', ts) as date), {_VALUE}, count(*), 'event value' from events group by 1""",
    "number_functions": f"""select l_orderkey, l_partkey, l_extendedprice, round(ln({_PRICE}) + 1e-9, 6) as ln_price,
        round(exp(-l_discount) + 1e-9, 6) as exp_discount, round(sqrt(l_quantity) + 1e-9, 6) as sqrt_quantity,
        cast(floor({_PRICE}) as bigint) as floor_price, round(abs(l_discount - l_tax) + 1e-9, 6) as abs_spread,
        coalesce(nullif(l_tax, 0), -1) as tax_or_none,
        case when l_quantity >= 25 then 'bulk' else 'retail' end as size from lineitem""",
    "date_functions": """select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month,
        isodow(o_orderdate) as weekday, cast(date_trunc('month', o_orderdate) as date) as month_start,
        datediff('day', o_orderdate, date '2002-01-01') as age_days from orders""",
    "text_functions": """select p_partkey, split_part(p_name, ' ', 1) as colour, upper(split_part(p_name, ' ', 2)) as kind,
        cast(substr(p_brand, 7) as bigint) as brand_number from part""",
    "json_functions": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "stream_tumbling": f"""select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end,
        event_type, count(*) as events, {_VALUE} as value from events group by 1, 2, 3
        having date_trunc('hour', ts) + interval 1 hour <= {_WATERMARK}""",
    "stream_sliding": f"""select s as window_start, s + interval 1 hour as window_end, event_type, count(*) as events,
        {_VALUE} as value from (select *, time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as s
        from events cross join (values (0), (1)) o(k)) group by 1, 2, 3
        having s + interval 1 hour <= {_WATERMARK}""",
    "stream_sessions": f"""with g as (select *, case when ts - lag(ts) over w <= interval 30 minutes then 0 else 1 end as fresh
        from events window w as (partition by user_id order by ts)),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
        select min(ts) as window_start, max(ts) + interval 30 minutes as window_end, user_id, count(*) as events,
        {_VALUE} as value from s group by user_id, n having max(ts) + interval 30 minutes <= {_WATERMARK}""",
    "stream_without_duplicates": "select event_id, ts, user_id, event_type, value from events",
    "stream_interval_join": _INTERVAL,
    "stream_previous_value": """select event_id, user_id, ts, value,
        lag(value) over (partition by user_id order by ts, event_id) as previous from events
        qualify ts <= (select max(ts) - interval 10 minutes from events)""",
    "stream_late_rows": """select count(*) as input_rows, count(*) filter (where ts < timestamp '2024-01-15'
        and ts < (select max(ts) - interval 10 minutes from events)) as dropped_rows from events""",
    "stream_batch_sink": "select event_id, ts, user_id, event_type, value from events",
    "udf_geometric_mean": f"""select p_brand, year("day") as year, round(exp(avg(ln(p))) + 1e-9, 6) as geo_price,
        round(exp(avg(ln(p))) + 1e-9, 6) as geo_price_check from (select p_brand, cast(l_shipdate as date) as "day",
        cast(sum({_MONEY}) as double) / sum(l_quantity) as p from {_BRANDED} group by 1, 2) group by 1, 2""",
    "udf_price_trend": f"""with m as (select p_brand, year(l_shipdate) * 12 + month(l_shipdate) as x, avg(unit_price) as y
        from {_BRANDED} where unit_price is not null group by 1, 2)
        select a.p_brand, round(median((b.y - a.y) / (b.x - a.x)) + 1e-9, 6) as slope
        from m a join m b on a.p_brand = b.p_brand and a.x < b.x group by 1""",
    "udtf_price_steps": f"""select p_brand, k as step, round(a + (k - 1) * (b - a) / 4 + 1e-9, 4) as low, round(a + k * (b - a) / 4 + 1e-9, 4) as high
        from (select p_brand, min(unit_price) as a, max(unit_price) as b from {_BRANDED} group by 1)
        cross join (select range as k from range(1, 5))""",
    "udf_median_daily_price": f"select l_partkey, round(median(price) + 1e-9, 6) as median_price from {_DAILY} group by 1",
}

# The split forms give what the plain forms give.
for _name in ("asof_last_view", "asof_by_number", "supplier_position", "market_gap", "median_gap", "rolling_activity"):
    ORACLE[f"{_name}_split"] = ORACLE[_name]
