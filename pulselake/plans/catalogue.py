"""The driver's queries over the star schema, each with the same in SQL: every reference operator on a table of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import activities, cycles, foods, graph, keys, marts, ranges, reports, retrieval, stats
from .registry import DAY, ORACLE, QUERIES, ZONE, exact, query, read


@query(f"""
select {DAY} as day, sum(value::decimal(18,6)) filter (where event_type = 'purchase')::double as purchased, sum(value::decimal(18,6)) filter (where event_type = 'click')::double as clicked,
  bool_or(event_type = 'error' and value > 50) as bad, count(distinct user_id) as users, count(*) as n from events group by 1""")
def q_daily_mart(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.groupBy(scalars.local_day("ts", ZONE, naive=True).alias("day")).agg(
        exact(F.when(kind == "purchase", F.col("value"))).alias("purchased"), exact(F.when(kind == "click", F.col("value"))).alias("clicked"),
        F.bool_or((kind == "error") & (F.col("value") > 50)).alias("bad"), F.countDistinct("user_id").alias("users"), F.count("*").alias("n"),
    )


@query("""
select coalesce(c.k, s.k) as nation, c.n as customers, s.n as suppliers from (select c_nationkey k, count(*) n from customer where c_acctbal > 0 group by 1) c
full outer join (select s_nationkey k, count(*) n from supplier where s_acctbal > 5000 group by 1) s on c.k = s.k""")
def q_full_outer_mart(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("ck")).agg(F.count("*").alias("customers"))
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("sk")).agg(F.count("*").alias("suppliers"))
    return c.join(s, c.ck == s.sk, "full_outer").select(F.coalesce("ck", "sk").alias("nation"), "customers", "suppliers")


_LABELS = [("view", "seen", 1), ("click", "touched", 2), ("purchase", "bought", 3), ("signup", "joined", None)]
_VALUES = "(values ('view','seen',1),('click','touched',2),('purchase','bought',3),('signup','joined',null)) m(t,label,ordinal)"


def _events_as_values(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = spark.createDataFrame([("event", *r) for r in _LABELS], "metric string, raw_value string, label string, ordinal int")
    return read(spark, sf_dir, "events").select("event_id", F.lit("event").alias("metric"), F.col("event_type").alias("value_str")), m


@query(f"select event_id, label as value_label, ordinal::int as value_ordinal from events left join {_VALUES} on event_type = t")
def q_category_map(spark, sf_dir):
    from ..operators.normalize import categorized

    return categorized(*_events_as_values(spark, sf_dir)).select("event_id", "value_label", "value_ordinal")


@query(f"select 'event' as metric, event_type as value_str, count(*) as n from events anti join {_VALUES} on event_type = t group by 2")
def q_unmapped(spark, sf_dir):
    from ..operators.normalize import unmapped

    return unmapped(*_events_as_values(spark, sf_dir))


@query("""
select event_type as metric, 'event' as record_kind, count(*) as n_rows, count(distinct user_id) as n_sources, min(ts) as first_ts, max(ts) as last_ts,
  string_agg(distinct (user_id % 3)::varchar, ', ' order by (user_id % 3)::varchar) as units from events group by 1""")
def q_metric_catalog(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return reports.metric_catalog(e.select(F.col("event_type").alias("metric"), F.lit("event").alias("record_kind"), F.col("user_id").alias("source"), F.col("ts").alias("start_ts"), (F.col("user_id") % 3).cast("string").alias("unit")))


@query("select user_id as source, count(*) as n_rows, count(distinct event_type) as n_metrics, min(ts) as first_ts, max(ts) as last_ts from events group by 1")
def q_source_counts(spark, sf_dir):
    return reports.source_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("metric"), F.col("ts").alias("start_ts")))


@query("""select o_orderpriority as name, count(*) as actual, 300 as expected, case when abs(count(*) - 300) <= 0.02 * 300 then 'OK' else 'DRIFT' end as state from orders group by 1""")
def q_drift(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    return reports.drift_report(a, a.select("name", F.lit(300).alias("n")))


@query("""select user_id, max(value) filter (where event_type='view') as view, max(value) filter (where event_type='click') as click, max(value) filter (where event_type='purchase') as purchase from events group by 1""")
def q_pivot_max(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))


@query("""
select l_returnflag, key, value from (select l_returnflag, sum(l_quantity::decimal(18,6))::double as quantity, sum(l_tax::decimal(18,6))::double as tax,
  nullif(sum((l_discount*0)::decimal(18,6)),0)::double as nothing from lineitem group by 1) unpivot (value for key in (quantity, tax, nothing))""")
def q_unpivot(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(exact("l_quantity").alias("quantity"), exact("l_tax").alias("tax"), F.nullif(exact(F.col("l_discount") * 0), F.lit(0.0)).alias("nothing"))
    return graph.unpivot(t, ["l_returnflag"], {"quantity": "quantity", "tax": "tax", "nothing": "nothing"}, "key", "value")


@query("""select o_custkey, o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey, lower(trim(o_orderpriority)) order by o_orderkey) rn from orders) where rn = 1""")
def q_keep_first(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("_p", F.lower(F.trim("o_orderpriority")))
    return keys.keep_first(o, ["o_custkey", "_p"], ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("""
with days as (select ts::date as day from events union select o_orderdate::date from orders union select l_shipdate::date from lineitem)
select day, n as orders from days left join (select o_orderdate::date as d, count(*) n from orders group by 1) on day = d""")
def q_spine_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    days = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).union(o).union(read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate"))).distinct()
    return days.join(o.groupBy("day").agg(F.count("*").alias("orders")), "day", "left")


@query("""select event_id, sha1(event_type || chr(31) || user_id::varchar || chr(31) || coalesce(nullif(event_type, 'view'), '') || chr(31) || event_id::varchar) as row_key from events""")
def q_natural_key(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", keys.natural_key(F.col("event_type"), F.col("user_id"), F.nullif("event_type", F.lit("view")), F.col("event_id")).alias("row_key"))


def cycle_signals(spark, sf_dir) -> DataFrame:
    """Events as day signals: a value of 160 or more bleeds, the mean value is the temperature, a click is mucus, a large purchase peak mucus, an error of 199 or more a surge."""
    e, kind = read(spark, sf_dir, "events"), F.col("event_type")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.round(F.avg("value"), 4).alias("bbt_c"), F.max(F.when(F.col("value") >= 160, 1)).alias("flow_ordinal"),
        F.max(F.when((kind == "purchase") & (F.col("value") > 100), 4).when(kind == "click", 1)).alias("mucus_ordinal"), F.bool_or((kind == "error") & (F.col("value") >= 199)).alias("lh_surge"),
    )


def _cycle_sql(shift: str) -> str:
    return f"""
s as (select user_id, ts::date as day, round(avg(value),4) as bbt, coalesce(max(case when value>=160 then 1 end),0)>=1 as menses,
  coalesce(max(case when event_type='purchase' and value>100 then 4 when event_type='click' then 1 end),0) as mucus, coalesce(bool_or(event_type='error' and value>=199),false) as lh from events group by 1,2),
b as (select *, menses and (pm is null or day - pm > 1) as st from (select *, max(case when menses then day end) over (partition by user_id order by day rows between unbounded preceding and 1 preceding) as pm from s)),
d as (select *, sum(st::int) over w as cn, max(case when st then day end) over w as cs, min(case when st then day end) over (partition by user_id order by day rows between 1 following and unbounded following) as nx from b window w as (partition by user_id order by day rows unbounded preceding)),
t as (select user_id, cn, nx, bbt as h1, row_number() over r as rn, max(bbt) over (partition by user_id, cn order by day rows between 6 preceding and 1 preceding) as cov, lead(bbt,1) over r as h2, lead(bbt,2) over r as h3, lead(bbt,3) over r as h4,
  lead(day,2) over r as d3, lead(day,3) over r as d4, lag(day) over r as ov from d where bbt is not null and cn > 0 window r as (partition by user_id, cn order by day)),
k as (select *, case when h3 >= cov + {shift} then d3 when h4 > cov then d4 end as cf, coalesce(nx - ov > 16, false) as far from t where rn > 6 and h1>cov and h2>cov and h3>cov),
g as (select user_id, cn, min(ov) filter (where cf is not null and not far) as ov, min(ov) filter (where cf is not null and far) as passed from k group by 1,2),
c as (select a.*, g.ov, k.cf, coalesce(g.passed is not null and (g.ov is null or g.passed < g.ov), false) as suspect from
  (select user_id, cn, min(cs) as cs, min(nx) as nx, min(day) filter (where mucus>=1) as chg, max(day) filter (where mucus>=4) as peak from d where cn>0 group by 1,2) a
  left join g using (user_id, cn) left join k on k.user_id=a.user_id and k.cn=a.cn and k.ov=g.ov),
f as (select *, case when cf is not null then greatest(cf, coalesce(peak + 3, cf)) end as conf, coalesce(chg, ov - 5) as fs from c)"""


@query(f"""with {_cycle_sql('5')},
z as (select d.*, f.ov, f.conf, f.fs, case when fs is null then 'unknown' when day<fs then 'infertile_pre' when conf is not null and day>conf then 'infertile_post' else 'fertile' end as z0 from d left join f using (user_id, cn)),
y as (select *, case when (mucus>=4 or lh) and z0<>'infertile_post' then 'fertile' else z0 end as zone from z)
select user_id, day, case when cn>0 and menses then 'menstruation' when day<ov then 'follicular' when day=ov then 'ovulation' when day>ov then 'luteal' else 'unknown' end as phase,
  zone as fertility_zone, zone='fertile' as fertile_window, case when cn>0 then (day - cs + 1)::int end as cycle_day from y""")
def q_cycle_phases(spark, sf_dir):
    return cycles.phases(cycle_signals(spark, sf_dir), "user_id", 5.0)


@query(f"""with {_cycle_sql('5')}
select user_id, cn::bigint as cycle_number, cs as cycle_start, nx as next_start, (nx-cs)::int as cycle_length_days, ov as ovulation_day, cf as temp_confirm_day, peak as peak_day, conf as confirmation_day, (ov-cs+1)::int as follicular_days, (nx-ov)::int as luteal_days,
  coalesce(nx-ov<=10,false) as short_luteal, suspect as suspect_ovulation, round(((nx-cs)-29.30)/3.89,3) as cycle_length_z, round(((nx-ov)-13.27)/2.67,3) as luteal_length_z,
  abs(((nx-cs)-29.30)/3.89)>2 as cycle_length_flag, abs(((nx-ov)-13.27)/2.67)>2 as luteal_length_flag, ov is null as anovulatory from f""")
def q_cycle_summary(spark, sf_dir):
    return cycles.summary(cycle_signals(spark, sf_dir), "user_id", 5.0)


_SWEEP = (1.0, 3.0, 5.0, 10.0, 20.0)


@query(" union all ".join(f"(with {_cycle_sql(str(s))} select {s}::double as shift_c, count(*) as cycles, count(ov) as ovulatory, count_if(suspect) as suspect from f)" for s in _SWEEP))
def q_threshold_sweep(spark, sf_dir):
    return cycles.sweep(cycle_signals(spark, sf_dir), "user_id", _SWEEP)


_PHASES = f"""{_cycle_sql('5')},
y as (select d.*, case when cn>0 and menses then 'menstruation' when day<ov then 'follicular' when day=ov then 'ovulation' when day>ov then 'luteal' else 'unknown' end as phase from d left join f using (user_id, cn))"""


@query(f"""with {_PHASES}, w as (select count(*) as cycles, count(ov) as ovulatory, count_if(suspect) as suspect, count_if(coalesce(abs(((nx-cs)-29.30)/3.89)>2,false) or coalesce(abs(((nx-ov)-13.27)/2.67)>2,false)) as flagged from f)
select 'phase ' || phase as name, count(*) as n from y group by 1 union all select name, n from w unpivot (n for name in (cycles, ovulatory, suspect, flagged))""")
def q_phase_counts(spark, sf_dir):
    d = cycle_signals(spark, sf_dir)
    return cycles.counts(cycles.phases(d, "user_id", 5.0), cycles.summary(d, "user_id", 5.0))


@query(f"with {_PHASES} select phase, count(*) as n, round(avg(bbt), 6) as avg_bbt from y where bbt is not null group by 1")
def q_bbt_by_phase(spark, sf_dir):
    d = cycle_signals(spark, sf_dir)
    return cycles.temperature_by_phase(d, cycles.phases(d, "user_id", 5.0), ["user_id", "day"]).withColumn("avg_bbt", F.round("avg_bbt", 6))


def panels(spark, sf_dir) -> DataFrame:
    """Line items as lab results: the part is the analyte, tax and discount steps its bounds, the day of shipping the panel."""
    l = read(spark, sf_dir, "lineitem")
    bound = F.when(F.col("l_tax") > 0.02, F.floor(F.col("l_tax") * 50).cast("double"))
    one = l.groupBy(F.col("l_partkey").alias("canonical_key"), F.to_date("l_shipdate").alias("panel_date")).agg(F.min(bound).alias("ref_low"), F.max(F.when(F.col("l_discount") > 0.03, F.floor(F.col("l_discount") * 100) + 10.0)).alias("ref_high"), F.max("l_quantity").alias("value_num"))
    return one.withColumn("canonical_unit", F.lit("u"))


_PANELS = """p as (select l_partkey as canonical_key, l_shipdate::date as panel_date, min(case when l_tax>0.02 then floor(l_tax*50) end)::double as ref_low,
  max(case when l_discount>0.03 then floor(l_discount*100)+10 end)::double as ref_high, max(l_quantity) as value_num from lineitem group by 1,2),
q as (select distinct canonical_key as key, panel_date as day, ref_low as low, ref_high as high from p where ref_low is not null or ref_high is not null),
r as (select *, case when row_number() over w = 1 then 1 when lag(low) over w is not distinct from low and lag(high) over w is not distinct from high then 0 else 1 end as ch from q window w as (partition by key order by day)),
e0 as (select key, min(low) as ref_low, min(high) as ref_high, 'u' as unit, count(*) as n_panels, min(day) as valid_from, max(day) as last_seen from (select *, sum(ch) over (partition by key order by day) as reign from r) group by key, reign),
e as (select *, (lead(valid_from) over (partition by key order by valid_from) - 1)::date as valid_to from e0)"""
_VERDICT = "case when value_num is null or {l} is null then null when value_num < {l} then 'low' when value_num > {h} then 'high' else 'normal' end"
_RANGED = f"""x as (select p.*, e.ref_low as asof_low, e.ref_high as asof_high, {_VERDICT.format(l='e.ref_low', h='e.ref_high')} as asof_status from p left join e on key=canonical_key and valid_from<=panel_date and (valid_to is null or panel_date<=valid_to))"""


@query(f"with {_PANELS} select key, ref_low, ref_high, unit, n_panels, valid_from, last_seen, valid_to from e")
def q_reigns(spark, sf_dir):
    return ranges.reigns(panels(spark, sf_dir))


@query(f"with {_PANELS}, {_RANGED} select canonical_key, panel_date, value_num, asof_low, asof_high, asof_status from x")
def q_asof(spark, sf_dir):
    p = panels(spark, sf_dir)
    return ranges.ranged(p, ranges.reigns(p)).select("canonical_key", "panel_date", "value_num", "asof_low", "asof_high", "asof_status")


@query(f"with {_PANELS}, {_RANGED} select canonical_key, panel_date, value_num, asof_low, asof_high, asof_status from x")
def q_asof_window(spark, sf_dir):
    p = panels(spark, sf_dir)
    return ranges.ranged_by_window(p, ranges.reigns(p)).select("canonical_key", "panel_date", "value_num", "asof_low", "asof_high", "asof_status")


@query(f"with {_PANELS}, {_RANGED} select canonical_key, panel_date, asof_status, {_VERDICT.format(l='n.ref_low', h='n.ref_high')} as now_status from x join e n on n.key=canonical_key and n.valid_to is null where asof_status is distinct from {_VERDICT.format(l='n.ref_low', h='n.ref_high')}")
def q_verdict_flip(spark, sf_dir):
    p = panels(spark, sf_dir)
    eras = ranges.reigns(p)
    return ranges.flips(ranges.ranged(p, eras), eras).select("canonical_key", "panel_date", "asof_status", "now_status")


@query(f"with {_PANELS} select key, count(*) as eras from e group by 1 having count(*) > 1")
def q_many_eras(spark, sf_dir):
    return ranges.many_eras(ranges.reigns(panels(spark, sf_dir)))


@query("""
with w as (select event_id, user_id, ts as s, ts + interval 6 hour as e from events where event_type = 'purchase'), h as (select w.event_id, count(*) as n, sum(value::decimal(18,6))::double as amount from w join events p on p.user_id = w.user_id and p.event_type <> 'purchase' and p.ts between s and e group by 1)
select w.event_id, h.n, h.amount from w left join h using (event_id)""")
def q_range_window(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    w = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("s"), F.expr("ts + interval 6 hours").alias("e"))
    points = e.where("event_type <> 'purchase'").select("user_id", "value", "ts")
    return activities.window_sums(w, points, "event_id", "s", "e", "ts", {"n": F.lit(1), "amount": F.col("value").cast("decimal(18,6)")}, ("user_id",)).select("event_id", "n", F.col("amount").cast("double").alias("amount"))


@query(f"""select {DAY} as day, count(*) as n_activities, round(sum(round(value)::bigint)/60.0, 6) as active_minutes, sum(value::decimal(18,6))::double as distance_km, string_agg(distinct event_type, ', ' order by event_type) as activity_types from events group by 1""")
def q_daily_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a = e.select(scalars.local_day("ts", ZONE, naive=True).alias("d"), "event_type", "value")
    return a.groupBy(F.col("d").alias("day")).agg(F.count("*").alias("n_activities"), F.round(F.sum(F.round("value").cast("long")) / 60.0, 6).alias("active_minutes"), exact("value").alias("distance_km"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("activity_types"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"), "label")


_SIM = "s as (select q.vec_id as q_id, d.vec_id as doc_id, q.label as ql, d.label as dl, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::double * z[2]::double)), 6) as score from embeddings q join embeddings d on q.vec_id % 50 = 0)"
_RANKED = _SIM + ", t as (select *, row_number() over (partition by q_id order by score desc, doc_id) as rn from s)"


@query(f"with {_RANKED} select q_id, doc_id, score, (rn-1)::int as rank from t where rn <= 10")
def q_dense_topk(spark, sf_dir):
    q, d = _vectors(spark, sf_dir)
    return retrieval.dense_top(q, d, 10)


def _ten(spark, sf_dir) -> DataFrame:
    q, d = _vectors(spark, sf_dir)
    return retrieval.dense_top(q, d, 10).join(d.select("doc_id", F.col("label").alias("dl")), "doc_id").join(q.select("q_id").join(d.select(F.col("doc_id").alias("q_id"), F.col("label").alias("ql")), "q_id"), "q_id")


@query(f"""
with {_RANKED}, h as (select q_id, rn-1 as rank from t where rn<=10 and ql=dl), n as (select q_id, count(*) as nr from s where ql=dl group by 1), i as (select n as m, sum(1/log2(g+1)) over (order by n) as idcg from (select unnest(range(1,11)) as n, unnest(range(1,11)) as g))
select n.q_id, (coalesce(min(rank)<1,false))::int::double as s1, (coalesce(min(rank)<5,false))::int::double as s5, (coalesce(min(rank)<10,false))::int::double as s10, round(coalesce(1/(min(rank)+1.0),0),6) as mrr, round(coalesce(sum(1/log2(rank+2)),0)/any_value(idcg),6) as ndcg
from n left join h using (q_id) join i on m=least(nr,10) group by n.q_id""")
def q_metrics(spark, sf_dir):
    q, d = _vectors(spark, sf_dir)
    labels = d.select(F.col("doc_id").alias("q_id"), "label").join(q.select("q_id"), "q_id")
    relevant = labels.join(d.groupBy("label").agg(F.count("*").alias("n_relevant")), "label").select("q_id", "n_relevant")
    m = stats.query_metrics(_ten(spark, sf_dir).where("ql = dl").select("q_id", "rank"), relevant)
    return m.select("q_id", "s1", "s5", "s10", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


_MACRO = "list_value(abs({v}[1])::double, abs({v}[2])::double, abs({v}[3])::double, abs({v}[4])::double)"


@query(f"""
with {_RANKED}, m as (select t.*, sqrt(list_sum(list_transform(list_zip({_MACRO.format(v='q.embedding')}, {_MACRO.format(v='d.embedding')}), lambda z: (z[1]-z[2])*(z[1]-z[2])))) as gap from t join embeddings q on q.vec_id=q_id join embeddings d on d.vec_id=doc_id where rn<=25),
r as (select q_id, doc_id, score as cosine, round(1/(1+gap),6) as macro_sim, round(0.5*score+0.5*round(1/(1+gap),6),6) as score from m)
select q_id, doc_id, cosine, macro_sim, score from (select *, row_number() over (partition by q_id order by score desc, doc_id) as k from r) where k=1""")
def q_macro_rerank(spark, sf_dir):
    q, d = _vectors(spark, sf_dir)
    four = lambda c: F.transform(F.slice(c, 1, 4), lambda x: F.abs(x).cast("double"))
    short = retrieval.dense_top(q, d, 25)
    both = short.join(q.select("q_id", four("qv").alias("qm")), "q_id").join(d.select("doc_id", four("dv").alias("dm")), "doc_id")
    r = both.withColumn("macro_sim", F.round(retrieval.macro_similarity("qm", "dm"), 6)).withColumnRenamed("score", "cosine")
    r = r.withColumn("score", F.round(0.5 * F.col("cosine") + 0.5 * F.col("macro_sim"), 6)).drop("rank")
    return retrieval.top(r, 1).select("q_id", "doc_id", "cosine", "macro_sim", "score")


_TOKENS = "regexp_extract_all(lower({c}), '([a-z0-9]+)', 1)"


@query(f"""
with tk as (select doc_id, unnest({_TOKENS.format(c='text')}) as w from documents), tf as (select doc_id, w, count(*) as tf from tk group by 1,2), sz as (select doc_id, len({_TOKENS.format(c='text')}) as dl from documents),
tot as (select count(*) as n, avg(dl) as avgdl from sz), i0 as (select w, ln(n-count(*)+0.5)-ln(count(*)+0.5) as idf from tf, tot group by w, n), i as (select w, case when idf<0 then 0.25*(select avg(idf) from i0) else idf end as idf from i0),
q as (select item_id as q_id, w, count(*) as qf from (select item_id, unnest({_TOKENS.format(c='text')}) as w from benchmark) group by 1,2)
select q_id, doc_id, round(sum(qf*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))),4) as score from q join i using (w) join tf using (w) join sz using (doc_id), tot where q_id % 50 = 0 group by 1,2""")
def q_bm25(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q_text")).where("q_id % 50 = 0")
    return retrieval.bm25(q, read(spark, sf_dir, "documents").select("doc_id", "text")).select("q_id", "doc_id", F.round("score", 4).alias("score"))


_HEAD = "select q.vec_id as q_id, d.vec_id as doc_id, round(list_sum(list_transform(list_zip(q.embedding[1:8], d.embedding[1:8]), lambda z: z[1]::double * z[2]::double)), 6) as score from embeddings q join embeddings d on q.vec_id % 50 = 0"


@query(f"""with {_RANKED}, v as (select *, row_number() over (partition by q_id order by score desc, doc_id) as rn from ({_HEAD})), u as (select q_id, doc_id, rn from t where rn <= 100 union all select q_id, doc_id, rn from v where rn <= 100)
select q_id, doc_id, round(sum(1.0/(60+rn-1)), 9) as score from u group by 1, 2""")
def q_rrf(spark, sf_dir):
    """The hundred best by whole vectors and by their first eight numbers, fused."""
    q, d = _vectors(spark, sf_dir)
    head = retrieval.dense_top(q.withColumn("qv", F.slice("qv", 1, 8)), d.withColumn("dv", F.slice("dv", 1, 8)), 100)
    return retrieval.fuse([retrieval.dense_top(q, d, 100), head]).select("q_id", "doc_id", F.round("score", 9).alias("score"))


@query(f"with {_SIM}, m as (select ql, q_id, dl, max(score) as s from s group by 1,2,3) select ql as q_label, dl as d_label, round(sum(s),4) as score from m group by 1,2")
def q_maxsim(spark, sf_dir):
    q, d = _vectors(spark, sf_dir)
    q = q.join(d.select(F.col("doc_id").alias("q_id"), F.col("label").alias("q_label")), "q_id").select(F.col("q_label").alias("q_id"), F.col("q_id").alias("q_pos"), "qv")
    s = retrieval.max_sim(q, d.select(F.col("label").alias("doc_id"), "dv"))
    return s.select(F.col("q_id").alias("q_label"), F.col("doc_id").alias("d_label"), F.round("score", 4).alias("score"))


def _two_corpora(spark, sf_dir) -> DataFrame:
    q, d = _vectors(spark, sf_dir)
    label = d.select("doc_id", F.col("label").alias("dl"))

    def best(odd: int) -> DataFrame:  # the query itself may be among the first two
        two = retrieval.dense_top(q, d.where(F.col("doc_id") % 2 == odd), 2).where("doc_id <> q_id").drop("rank")
        return retrieval.top(two, 1).join(label, "doc_id")

    ql = d.select(F.col("doc_id").alias("q_id"), F.col("label").alias("ql"))
    a, b = best(0).select("q_id", F.col("score").alias("cos_a"), F.col("dl").alias("la")), best(1).select("q_id", F.col("score").alias("cos_b"), F.col("dl").alias("lb"))
    return a.join(b, "q_id").join(ql, "q_id").select("q_id", "cos_a", "cos_b", (F.col("la") == F.col("ql")).alias("ok_a"), (F.col("lb") == F.col("ql")).alias("ok_b"))


_CORPORA = _SIM + """, a as (select q_id, score as cos_a, ql=dl as ok_a from (select *, row_number() over (partition by q_id order by score desc, doc_id) k from s where doc_id<>q_id and doc_id%2=0) where k=1),
b as (select q_id, score as cos_b, ql=dl as ok_b from (select *, row_number() over (partition by q_id order by score desc, doc_id) k from s where doc_id<>q_id and doc_id%2=1) where k=1), ab as (select * from a join b using (q_id))"""
_TAUS = [0.4, 0.5, 0.6, 0.7, 0.8, 0.85]


@query(f"with {_CORPORA}, taus as (select unnest([{','.join(map(str, _TAUS))}])::double as tau) select tau, round(avg(case when cos_a>=tau then ok_a::int else ok_b::int end),6) as accuracy, round(avg((cos_a>=tau)::int),6) as share_a from taus, ab group by 1")
def q_cascade(spark, sf_dir):
    return retrieval.frontier(_two_corpora(spark, sf_dir), _TAUS).select("tau", F.round("accuracy", 6).alias("accuracy"), F.round("share_a", 6).alias("share_a"))


@query(f"with {_CORPORA} select round(quantile_cont(cos_a, 0.1),6) as tau from ab where ok_a")
def q_cascade_tau(spark, sf_dir):
    return retrieval.calibrated_threshold(_two_corpora(spark, sf_dir)).select(F.round("tau", 6).alias("tau"))


@query(f"with {_CORPORA} select round(avg(case when cos_a>=cos_b then ok_a::int else ok_b::int end),6) as accuracy from ab")
def q_confidence_merge(spark, sf_dir):
    best = retrieval.most_confident(F.col("cos_a"), F.col("ok_a"), F.col("cos_b"), F.col("ok_b"))
    return _two_corpora(spark, sf_dir).agg(F.round(F.avg(best.cast("double")), 6).alias("accuracy"))


_BINOM = "(select sum(exp(lgamma(m+1.0)-lgamma(i+1.0)-lgamma(m-i+1.0)-m*ln(2.0))) from (select unnest(range(0, (k+1)::bigint)) as i))"


@query(f"with {_CORPORA}, n as (select count_if(ok_a and not ok_b) as only_a, count_if(not ok_a and ok_b) as only_b from ab) select only_a, only_b, round(case when only_a+only_b=0 then 1.0 else least(1.0, 2*{_BINOM}) end,6) as p from (select *, (only_a+only_b)::double as m, least(only_a,only_b) as k from n)")
def q_mcnemar(spark, sf_dir):
    return stats.mcnemar(_two_corpora(spark, sf_dir), "ok_a", "ok_b").select("only_a", "only_b", F.round("p", 6).alias("p"))


_STEM = "case when w like '%ies' and length(w)>=6 then w[:-4]||'y' when w like '%ches' and length(w)>=7 then w[:-5]||'ch' when w like '%shes' and length(w)>=7 then w[:-5]||'sh' when w like '%es' and length(w)>=5 then w[:-3] when w like '%s' and length(w)>=4 then w[:-2] else w end"


@query(f"select doc_id, count(distinct {_STEM}) as n_stems from (select doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) as w from documents) group by 1")
def q_stems(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.stems(F.col("text"))).cast("long").alias("n_stems")).where("n_stems > 0")


#: The stated keywords: any of a row's phrases, all of its words in any order and form.
_KEYWORDS = [("en", ["the thand", "and ofs"]), ("de", ["und der", "nichts"]), ("fr", ["les parles", "ment"]), ("es", ["que los", "cióna"]), ("none", [])]


@query(f"""with k as (select name, unnest(kws) as kw from (values {', '.join(f"('{n}', [{', '.join(repr(x) for x in ks)}]::varchar[])" for n, ks in _KEYWORDS)}) t(name, kws)),
ks as (select name, kw, list_distinct(list_transform(regexp_extract_all(lower(kw), '([a-z]+)', 1), lambda w: {_STEM})) as ks from k), d as (select doc_id, text, list_distinct(list_transform(regexp_extract_all(lower(text), '([a-z]+)', 1), lambda w: {_STEM})) as ds from documents where text <> '')
select name, count(distinct doc_id) as n_relevant from ks, d where len(ks) > 0 and list_has_all(ds, ks) group by 1""")
def q_match(spark, sf_dir):
    k = spark.createDataFrame(_KEYWORDS, "name string, kw array<string>")  # five rows
    d = read(spark, sf_dir, "documents").select("text")
    return d.crossJoin(F.broadcast(k)).where(text.matches(F.col("text"), F.col("kw"))).groupBy("name").agg(F.count("*").alias("n_relevant"))


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))) as folded from documents")
def q_fold(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.food_name(F.col("text"))).alias("folded"))


_ANY = lambda c, marks: "(" + " or ".join(f"contains({c}, '{m}')" for m in marks) + ")"
_LIST = lambda marks: "[" + ",".join(f"'{m}'" for m in marks) + "]"
_TITLES = ("{n}", "Lecsó {n}", "OATLY {n}", "{n} boiled", "wild {n}", "{n} Ajvar", "Barista {n} jam")


@query(f"""with s as (select p_partkey, p_size, replace({_LIST(_TITLES)}[p_partkey % {len(_TITLES)} + 1], '{{n}}', p_name) as n from part), w as (select p_partkey, p_size, lower(n) as p, lower(n) as en, list_filter(regexp_split_to_array(lower(n), '\\s+'), lambda w: w<>'') as ws from s)
select p_partkey, case when p_size = 1 then 'given' when {_ANY('p', text.REGIONAL)} or {_ANY('en', text.REGIONAL)} then 'regional' when {_ANY('p', text.BRAND)} then 'branded' when list_has_any(ws, {_LIST(text.PREPARED)}) then 'prepared'
 when len(ws)>=2 and list_contains({_LIST(text.MODIFIER)}, ws[1]) then 'compound' else 'simple' end as stratum from w""")
def q_strata(spark, sf_dir):
    n = F.replace(F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % len(_TITLES) + 1).cast("int")), F.lit("{n}"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", text.stratum(n, n, F.when(F.col("p_size") == 1, "given").otherwise("")).alias("stratum"))


@query("select l_returnflag, quantile_cont(l_quantity, 0.1) as p10, quantile_cont(l_quantity, 0.5) as median from lineitem group by 1")
def q_quantiles(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.1).alias("p10"), F.percentile("l_quantity", 0.5).alias("median"))


@query("""with v as (select p_retailprice as x, row_number() over (order by p_retailprice) as r from part), c as (select (count(*)+1)/4.0 as s from part)
select round(max(x) filter (where r=floor(1*s)) + (1*any_value(s)-floor(1*any_value(s)))*(max(x) filter (where r=floor(1*s)+1)-max(x) filter (where r=floor(1*s))),4) as q1, round(max(x) filter (where r=floor(2*s)) + (2*any_value(s)-floor(2*any_value(s)))*(max(x) filter (where r=floor(2*s)+1)-max(x) filter (where r=floor(2*s))),4) as q2, round(max(x) filter (where r=floor(3*s)) + (3*any_value(s)-floor(3*any_value(s)))*(max(x) filter (where r=floor(3*s)+1)-max(x) filter (where r=floor(3*s))),4) as q3 from v, c""")
def q_exclusive_quartiles(spark, sf_dir):
    q = stats.exclusive_quartiles(read(spark, sf_dir, "part"), "p_retailprice")
    return q.select(*(F.round(c, 4).alias(c) for c in q.columns))


@query("select count_if(value/200<0.6) as below_60, count_if(value/200>=0.6 and value/200<0.75) as from_60, count_if(value/200>=0.75) as from_75 from events")
def q_score_bins(spark, sf_dir):
    return stats.score_bins(read(spark, sf_dir, "events").select((F.col("value") / 200).alias("s")), "s")


@query("""
select n_name, p_brand, sum((l_quantity * l_discount)::decimal(18,6))::double as amount, count(*) as n from nation join customer on c_nationkey=n_nationkey join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey join part on p_partkey=l_partkey group by 1,2""")
def q_graph_hops(spark, sf_dir):
    r = lambda n: read(spark, sf_dir, n)
    j = r("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount").join(r("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(r("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(r("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.join(r("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("n_name", "p_brand").agg(exact(F.col("l_quantity") * F.col("l_discount")).alias("amount"), F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def q_semi(spark, sf_dir):
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def q_anti(spark, sf_dir):
    return read(spark, sf_dir, "part").join(read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("select event_type, sum((props->>'$.k')::bigint) as k, count(*) as n from events group by 1")
def q_json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("select 'p_name' as \"column\", count(p_name) as n, count(p_name)::double/count(*) as share from part union all select 'p_brand', count(nullif(p_brand,'Brand#11')), count(nullif(p_brand,'Brand#11'))::double/count(*) from part")
def q_coverage(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_name", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand"))
    return foods.coverage(p, ["p_name", "p_brand"])


@query("select event_type, count(*) as n, round(100.0*count(*)/sum(count(*)) over (),6) as pct from events group by 1")
def q_shares(spark, sf_dir):
    return reports.shares(read(spark, sf_dir, "events"), "event_type").select("event_type", "n", F.round("pct", 6).alias("pct"))


@query("select o_custkey, o_orderkey, coalesce(t.total, -1.0) as total from orders left join (select l_orderkey, max(l_quantity) as total from lineitem where l_tax > 0.04 group by 1) t on l_orderkey = o_orderkey")
def q_backfill(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(-1.0).alias("total"))
    v = read(spark, sf_dir, "lineitem").where("l_tax > 0.04").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("total"))
    return keys.backfill(o, v, "o_orderkey", "total")


@query("select n, round(acc,6) as accuracy, round(case when given>0 then rt/given end,6) as precision, round(case when known>0 then rt/known end,6) as recall, n-given as abstained, wrong from (select count(*) as n, count_if(k=t)::double/count(*) as acc, count_if(k=t)::double as rt, count(k) as given, count(t) as known, count_if(k is not null and not coalesce(k=t,false)) as wrong from (select p_partkey, p_size%5 as t, case when p_size%7<>0 then p_partkey%5 end as k from part))")
def q_prediction_scores(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    gold = p.select(F.col("p_partkey").alias("name"), (F.col("p_size") % 5).alias("key"))
    pred = p.select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 7 != 0, F.col("p_partkey") % 5).alias("key"))
    s = stats.prediction_scores(pred, gold)
    return s.select("n", *(F.round(F.coalesce(c, F.lit(0.0)) if c == "accuracy" else F.col(c), 6).alias(c) for c in ("accuracy", "precision", "recall")), "abstained", "wrong")


@query()
def q_bootstrap(spark, sf_dir):
    """Interval of a metric by group; the generator has no SQL form, so rows only."""
    m = QUERIES["q_metrics"](spark, sf_dir).withColumn("half", F.col("q_id") % 2)
    return stats.bootstrap(m, ["half"], "ndcg", 2000)


@query()
def q_fuzzy_names(spark, sf_dir):
    """Part names resolved against one another by matching blocks; no SQL form, so rows only."""
    p = read(spark, sf_dir, "part")
    products = p.where("p_partkey % 50 = 0").select(F.concat(F.col("p_name"), F.lit(" x")).alias("product"))
    return foods.fuzzy_match(products, p.select(F.col("p_partkey").alias("fdc_id"), F.col("p_name").alias("description")))


from . import shaped  # noqa: E402, F401  adds its queries
