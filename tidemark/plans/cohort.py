"""Queries over matched cohorts, rules, table operations and projections, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import evaluate, matching, ordered
from tidemark.plans.catalog import query
from tidemark.plans.tables import TICKS, daily_orders, load, rounded, ticks

# --- matching -------------------------------------------------------------

CUSTOMERS = "SELECT c_custkey AS id, c_nationkey AS grp, c_acctbal + 1100 AS price, CAST(n AS DOUBLE) AS volume FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def customers(spark, sf):
    n = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("volume"))
    return load(spark, sf, "customer").join(n, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), (F.col("c_acctbal") + 1100).alias("price"), "volume")


CONFIG = matching.MatchConfig(weights={"price": 2.0, "volume": 1.0}, ratios={"price": (0.5, 2.0), "volume": (0.2, 5.0)}, most_score=1.0, controls=3, symbol_uses=2)


@query("a15_robust_scale", "WITH m AS (SELECT p_brand AS brand, median(p_retailprice) AS c FROM part GROUP BY 1) SELECT brand, round(max(c), 6) AS centre, round(greatest(median(abs(p_retailprice - c)) * 1.4826, 1e-6), 6) AS scale FROM part JOIN m ON p_brand = brand GROUP BY 1")
def a15(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_retailprice")
    return rounded(matching.robust_scale(p, ["brand"], "p_retailprice"))


@query(
    "j07_caliper_join",
    f"""WITH c AS ({CUSTOMERS}), m AS (SELECT grp, median(price) AS mp, median(volume) AS mv FROM c GROUP BY 1),
    s AS (SELECT c.grp, greatest(median(abs(price - mp)) * 1.4826, 1e-6) AS sp, greatest(median(abs(volume - mv)) * 1.4826, 1e-6) AS sv FROM c JOIN m USING (grp) GROUP BY 1),
    x AS (SELECT e.grp, e.id AS event, k.id AS control, sqrt(2 * ((k.price - e.price) / sp) ** 2 + ((k.volume - e.volume) / sv) ** 2) AS score FROM c e JOIN c k ON e.grp = k.grp AND e.id <> k.id JOIN s ON s.grp = e.grp
    WHERE k.price / nullif(e.price, 0) BETWEEN 0.5 AND 2 AND k.volume / nullif(e.volume, 0) BETWEEN 0.2 AND 5)
    SELECT grp, event, control, round(score, 6) AS score FROM x WHERE score <= 1""",
)
def j07(spark, sf):
    c = customers(spark, sf)
    return rounded(matching.caliper_pairs(c, c, "grp", CONFIG))


@query("t01_greedy_match")
def t01(spark, sf):
    c = customers(spark, sf)
    return matching.greedy_caliper(c, c.withColumn("symbol", F.col("id") % 50), "grp", CONFIG)


@query("t02_greedy_controls")
def t02(spark, sf):
    e = ticks(spark, sf, "signup").select("symbol", F.col("seq").alias("event"), F.col("sec").alias("event_order"))
    c = ticks(spark, sf, "view").select("symbol", F.col("seq").alias("control"), F.col("sec").alias("at"))
    x = e.join(c, "symbol").where(F.abs(F.col("at") - F.col("event_order")) >= 86400)
    x = x.withColumn("day", F.expr("at div 86400")).withColumn("distance", F.abs(F.col("at") - F.col("event_order"))).withColumn("tie", scalar.tie_break(F.col("event"), F.col("control")))
    return matching.greedy_within(x.drop("at"), "symbol", 3)


@query(
    "j08_anchor_candidates",
    f"""WITH e AS (SELECT symbol, seq AS event, sec FROM ({TICKS}) WHERE kind = 'signup'), k AS (SELECT symbol, sec FROM ({TICKS}) WHERE kind IN ('signup', 'error')), d AS (SELECT DISTINCT sec // 86400 * 86400 AS date_start FROM e),
    a AS (SELECT symbol, event, date_start, date_start + sec % 86400 + o * 60 AS anchor FROM e CROSS JOIN d CROSS JOIN (SELECT unnest([0, -15, 15, -30, 30, -45, 45, -60, 60]) AS o))
    SELECT symbol, count(*) AS anchors, CAST(sum(anchor % 1000) AS BIGINT) AS checksum FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = a.symbol AND abs(k.sec - a.anchor) < 86400) GROUP BY 1""",
)
def j08(spark, sf):
    t = ticks(spark, sf)
    e = t.where("kind = 'signup'").select("symbol", F.col("seq").alias("event"), "sec")
    d = e.select(F.expr("sec div 86400 * 86400").alias("date_start")).distinct()
    x = matching.anchors(e, "symbol", "sec", d, [0, -15, 15, -30, 30, -45, 45, -60, 60], t.where("kind in ('signup', 'error')").select("symbol", "sec"), 86400)
    return x.groupBy("symbol").agg(F.count("*").alias("anchors"), F.sum(F.col("anchor") % 1000).alias("checksum"))


# --- rules on matched groups ------------------------------------------------

GROUPED = "SELECT o_orderkey AS id, o_custkey AS grp, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_event, o_totalprice > 200000 AS rule, strftime(o_orderdate, '%Y-%m') AS month, o_custkey % 40 AS symbol FROM orders"
GROUPS = f"""SELECT * FROM (SELECT grp, count(*) FILTER (is_event) AS events, count(*) FILTER (NOT is_event) AS controls, max(CASE WHEN is_event THEN CASE WHEN rule THEN 1.0 ELSE 0.0 END END)::DOUBLE AS event_pass,
    (avg(CASE WHEN rule THEN 1.0 ELSE 0.0 END) FILTER (NOT is_event))::DOUBLE AS control_rate, (sum(CASE WHEN rule THEN 1.0 ELSE 0.0 END) FILTER (NOT is_event))::DOUBLE AS control_passes, max(CASE WHEN is_event THEN month END) AS month, max(CASE WHEN is_event THEN symbol END) AS symbol FROM ({GROUPED}) GROUP BY 1) WHERE events = 1 AND controls >= 1"""


def grouped(spark, sf):
    o = load(spark, sf, "orders")
    first = F.min("o_orderkey").over(W.partitionBy("o_custkey"))
    return o.select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") == first).alias("is_event"), (F.col("o_totalprice") > 200000).alias("rule"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_custkey") % 40).alias("symbol"))


def groups(spark, sf):
    return evaluate.matched_groups(grouped(spark, sf), "grp", F.col("is_event"), F.col("rule"), ["month", "symbol"])


@query("a16_matched_groups", f"SELECT grp, events, controls, event_pass, round(control_rate, 6) AS control_rate, control_passes, month, symbol, round(event_pass - control_rate, 6) AS difference FROM ({GROUPS})")
def a16(spark, sf):
    return rounded(groups(spark, sf))


@query(
    "a17_rule_stats",
    f"WITH x AS (SELECT count(DISTINCT symbol) AS symbols, count(*) AS groups, avg(event_pass) AS hit, avg(control_rate) AS control_pass, sum(control_passes) / sum(controls) AS raw, avg(event_pass - control_rate) AS d FROM ({GROUPS})) SELECT symbols, groups, round(hit, 6) AS hit, round(control_pass, 6) AS control_pass, round(raw, 6) AS raw_control_pass, round(d, 6) AS difference, round(hit / control_pass, 6) AS lift FROM x",
)
def a17(spark, sf):
    return rounded(evaluate.rule_stats(groups(spark, sf)))


@query("a18_monthly", f"SELECT month, count(*) AS groups, round(avg(event_pass), 6) AS hit, round(avg(control_rate), 6) AS control_pass, round(avg(event_pass - control_rate), 6) AS difference FROM ({GROUPS}) GROUP BY 1")
def a18(spark, sf):
    return rounded(groups(spark, sf).groupBy("month").agg(F.count("*").alias("groups"), F.avg("event_pass").alias("hit"), F.avg("control_rate").alias("control_pass"), F.avg("difference").alias("difference")))


@query("a19_concentration", f"WITH x AS (SELECT symbol, sum(greatest(event_pass - control_rate, 0)) AS g FROM ({GROUPS}) GROUP BY 1) SELECT arg_max(symbol, (g, -symbol)) AS top_key, round(max(g) / sum(g), 6) AS top_share, count(*) FILTER (g > 0) AS keys FROM x")
def a19(spark, sf):
    return rounded(evaluate.concentration(groups(spark, sf), "symbol"))


@query(
    "a20_cluster_bootstrap",
    f"""WITH c AS (SELECT CAST(symbol AS VARCHAR) AS c, sum(event_pass - control_rate) AS s, count(*) AS n FROM ({GROUPS}) WHERE symbol IS NOT NULL GROUP BY 1), h AS (SELECT c.*, r, md5('{evaluate.SEED}:' || r || ':' || c) AS h FROM c CROSS JOIN (SELECT unnest(range(0, {10_000 // evaluate.PER_DIGEST})) AS r)),
    u AS (SELECT h.*, r * {evaluate.PER_DIGEST} + k AS replicate, CAST('0x' || substr(h, CAST(k * 8 + 1 AS BIGINT), 8) AS BIGINT) / 4294967296.0 AS u FROM h CROSS JOIN (SELECT unnest(range(0, {evaluate.PER_DIGEST})) AS k)),
    w AS (SELECT s, n, replicate, {' + '.join(f'(u >= {t!r})::INT' for t in evaluate.POISSON)} AS w FROM u), v AS (SELECT sum(w * s) / sum(w * n) AS v FROM w WHERE w > 0 GROUP BY replicate)
    SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, (SELECT CAST(count(*) AS INTEGER) FROM c) AS clusters FROM v""",
)
def a20(spark, sf):
    return rounded(evaluate.cluster_bootstrap(groups(spark, sf), "symbol"))


@query("a21_randomisation")
def a21(spark, sf):
    return evaluate.randomisation(grouped(spark, sf), "grp", F.col("is_event"), F.col("rule"))


@query(
    "a23_strategy_summary",
    f"""WITH t AS (SELECT kind AS strategy, seq, price - 50 AS pnl, seq % 7 <> 0 AS filled FROM ({TICKS})), b AS (SELECT strategy, count(*) AS trades, count(*) FILTER (filled) AS filled FROM t GROUP BY 1),
    s AS (SELECT strategy, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) AS mean_pnl, median(pnl) AS median_pnl, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS pf, sum(pnl) AS total FROM t WHERE filled GROUP BY 1),
    k AS (SELECT strategy, sum(pnl) AS best3 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pnl DESC, seq) AS k FROM t WHERE filled) WHERE k <= 3 GROUP BY 1)
    SELECT strategy, trades, b.filled, round(win_rate, 6) AS win_rate, round(mean_pnl, 6) AS mean_pnl, round(median_pnl, 6) AS median_pnl, round(pf, 6) AS profit_factor, round(total, 4) AS total, round(b.filled / trades, 6) AS fill_rate, round(total - best3, 4) AS total_without_best3 FROM b JOIN s USING (strategy) JOIN k USING (strategy)""",
)
def a23(spark, sf):
    t = ticks(spark, sf).select(F.col("kind").alias("strategy"), "seq", (F.col("price") - 50).alias("pnl"), (F.col("seq") % 7 != 0).alias("filled"))
    x = evaluate.strategy_summary(t, ["strategy"], "pnl", F.col("filled"), ["seq"])
    return rounded(x.withColumn("total", F.round("total", 4)).withColumn("total_without_best3", F.round("total_without_best3", 4)))


@query(
    "a31_cross_split",
    f"WITH x AS (SELECT symbol, CASE WHEN seq % 3 = 0 THEN 'a' WHEN seq % 3 = 1 THEN 'b' ELSE 'c' END AS split FROM ({TICKS}) WHERE kind = 'error') SELECT symbol, count(*) FILTER (split = 'a') AS a, count(*) FILTER (split = 'b') AS b, count(*) FILTER (split = 'c') AS c FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1",
)
def a31(spark, sf):
    x = ticks(spark, sf, "error").withColumn("split", F.element_at(F.array(*map(F.lit, "abc")), (F.col("seq") % 3 + 1).cast("int")))
    x = x.groupBy("symbol").pivot("split", ["a", "b", "c"]).agg(F.count("seq")).na.fill(0)
    return x.where(sum((F.col(c) > 0).cast("int") for c in "abc") > 1)


@query("a29_counter_rollup", f"SELECT kind AS reason, count(*) AS n, count(DISTINCT symbol) AS symbols FROM ({TICKS}) GROUP BY 1")
def a29(spark, sf):
    return ticks(spark, sf).groupBy(F.col("kind").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


# --- table operations ---------------------------------------------------------


@query("j21_semi", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j21(spark, sf):
    o = load(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey")
    return load(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("j23_anti", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j23(spark, sf):
    return load(spark, sf, "customer").join(load(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("j06_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def j06(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(load(spark, sf, "supplier").select("s_nationkey"))


@query("u04_difference", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice <= 20000")
def u04(spark, sf):
    o = load(spark, sf, "orders")
    return o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("id")).subtract(o.where("o_totalprice <= 20000").select("o_custkey"))


@query("j01_event_controls", "SELECT l_orderkey AS order_key, l_linenumber AS line, o_custkey AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def j01(spark, sf):
    li = load(spark, sf, "lineitem").where("l_quantity > 45")
    return li.join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("customer"))


@query("j03_dimension_join", "SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j03(spark, sf):
    x = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("k02_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def k02(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return ordered.upsert(o, o.where("id % 3 = 0").withColumn("status", F.lit("new")), ["id"])


@query("k03_update_delete", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P'")
def k03(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", 0.0).otherwise(F.col("o_totalprice")).alias("price"))


@query("o02_topk", "SELECT customer, id, price, k FROM (SELECT o_custkey AS customer, o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def o02(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return ordered.top_k(o, ["customer"], [F.desc("price"), "id"], 3, "k")


@query("o03_first_per_key", "SELECT o_custkey AS customer, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def o03(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("o_orderkey", F.struct("o_orderpriority", "o_orderkey")).alias("first_order"))


@query("o04_page", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def o04(spark, sf):
    o = load(spark, sf, "orders").where("o_totalprice >= 1000").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return o.orderBy(F.desc("price"), "id").offset(100).limit(50)


@query("u01_union", f"SELECT symbol, seq, 1 AS label FROM ({TICKS}) WHERE kind = 'purchase' UNION ALL SELECT symbol, seq, 0 FROM ({TICKS}) WHERE kind = 'view'")
def u01(spark, sf):
    t = ticks(spark, sf)
    one = lambda kind, label: t.where(F.col("kind") == kind).select("symbol", "seq", F.lit(label).alias("label"))
    return one("purchase", 1).unionByName(one("view", 0), allowMissingColumns=True)


@query("u02_dedupe_last", f"SELECT symbol, kind, arg_max(seq, (us, seq)) AS seq, max(us) AS us FROM ({TICKS}) GROUP BY 1, 2")
def u02(spark, sf):
    return ordered.latest(ticks(spark, sf).select("symbol", "kind", "seq", "us"), ["symbol", "kind"], [F.desc("us"), F.desc("seq")])


@query("p20_flatten_json", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, event_type AS kind FROM events")
def p20(spark, sf):
    e = load(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select(F.col("event_id").alias("id"), F.col("p.k").alias("props_k"), F.col("event_type").alias("kind"))


@query("p21_filters", "SELECT p_partkey AS id FROM part WHERE p_size >= 10 AND p_size < 40 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_type NOT IN ('x') AND (p_name ILIKE '%a%' OR p_retailprice > 1500) AND p_brand IS NOT NULL")
def p21(spark, sf):
    p = load(spark, sf, "part")
    return p.where((F.col("p_size") >= 10) & (F.col("p_size") < 40) & F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33") & ~F.col("p_type").isin("x") & (F.col("p_name").ilike("%a%") | (F.col("p_retailprice") > 1500)) & F.col("p_brand").isNotNull()).select(F.col("p_partkey").alias("id"))


@query("p18_tier", "SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 300000 THEN 'strong' WHEN o_totalprice >= 100000 AND o_orderpriority LIKE '1-%' THEN 'primary' WHEN o_orderstatus = 'F' THEN 'weak' ELSE 'excluded' END AS tier FROM orders")
def p18(spark, sf):
    tier = F.when(F.col("o_totalprice") >= 300000, "strong").when((F.col("o_totalprice") >= 100000) & F.col("o_orderpriority").startswith("1-"), "primary").when(F.col("o_orderstatus") == "F", "weak").otherwise("excluded")
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tier.alias("tier"))


@query("p23_quality_flags", "SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'low_value' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END) AS flags FROM orders")
def p23(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, F.lit("low_value")), F.when(F.col("o_orderstatus") == "P", F.lit("partial")), F.when(F.col("o_orderpriority").like("5%"), F.lit("low_priority"))))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(",", flags).alias("flags"))


@query("f07_price_band", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN d < 0.5 THEN 'lt_0_5' WHEN d < 1 THEN '0_5_1' WHEN d < 2 THEN '1_2' WHEN d < 5 THEN '2_5' WHEN d < 10 THEN '5_10' WHEN d < 20 THEN '10_20' WHEN d < 50 THEN '20_50' ELSE 'gte_50' END AS band FROM (SELECT *, l_discount * 1000 AS d FROM lineitem)")
def f07(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), scalar.price_band(F.col("l_discount") * 1000).alias("band"))


@query("f18_tie_break", "SELECT o_orderkey AS id, sha256(concat_ws('|', o_custkey, o_orderkey)) AS tie FROM orders")
def f18(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), scalar.tie_break(F.col("o_custkey"), F.col("o_orderkey")).alias("tie"))


@query("f08_candles", "SELECT o_orderpriority AS symbol, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(abs(arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey)) / (max(o_totalprice) - min(o_totalprice)), 6) AS body FROM orders GROUP BY 1, CAST(o_orderdate AS DATE) HAVING max(o_totalprice) > min(o_totalprice)")
def f08(spark, sf):
    d = daily_orders(spark, sf)
    return d.where("high > low").select("symbol", F.col("day").cast("string").alias("day"), F.round(scalar.candle_parts(F.col("open"), F.col("high"), F.col("low"), F.col("close"))["body"], 6).alias("body"))


@query("a27_percentiles", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(median(l_extendedprice), 6) AS p50, max(l_extendedprice) AS top FROM lineitem GROUP BY 1")
def a27(spark, sf):
    return rounded(load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.percentile("l_extendedprice", 0.9).alias("p90"), F.median("l_extendedprice").alias("p50"), F.max("l_extendedprice").alias("top")))


@query("a30_balance_report", f"WITH c AS ({CUSTOMERS}) SELECT grp, count(*) AS n, round(median(price), 6) AS median_price, round(max(abs(price - m) / nullif(s, 0)), 4) AS max_z FROM (SELECT *, avg(price) OVER (PARTITION BY grp) AS m, stddev_samp(price) OVER (PARTITION BY grp) AS s FROM c) GROUP BY 1")
def a30(spark, sf):
    w = W.partitionBy("grp")
    x = customers(spark, sf).withColumn("z", F.abs(F.try_divide(F.col("price") - F.avg("price").over(w), F.stddev_samp("price").over(w))))
    return x.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.median("price"), 6).alias("median_price"), F.round(F.max("z"), 4).alias("max_z"))
