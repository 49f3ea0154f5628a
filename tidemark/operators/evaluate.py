"""Evaluation of frozen rules on matched groups: tables, concentration, bootstrap, randomisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the seed of the draws.
SEED = 20260726


class RuleRegistry(dict):
    """name -> predicate; a null predicate is false, a missing column an error."""

    def evaluate(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in self.items()})


def default_rules() -> RuleRegistry:
    """The two frozen rules."""
    return RuleRegistry(
        C2=(F.col("close_vs_1440m_low_pct") >= 6) & (F.col("quote_volume_60m_vs_prior_7d_same_time") >= 3),
        C4=(F.col("max_runup_720m_pct") >= 10) & (F.col("volatility_1d_to_7d_ratio") >= 0.30),
    )


def matched_groups(rows: DataFrame, group: str, is_event: Column, rule: Column, keep: list[str] = ()) -> DataFrame:
    """group, event_pass, control_rate, controls, difference of groups with one event and at least one control."""
    hit = F.when(F.coalesce(rule, F.lit(False)), 1.0).otherwise(0.0)
    x = rows.groupBy(group).agg(
        F.count(F.when(is_event, 1)).alias("events"), F.count(F.when(~is_event, 1)).alias("controls"), F.max(F.when(is_event, hit)).alias("event_pass"), F.avg(F.when(~is_event, hit)).alias("control_rate"), F.sum(F.when(~is_event, hit)).alias("control_passes"), *(F.max(F.when(is_event, F.col(k))).alias(k) for k in keep)
    )
    return x.where("events = 1 and controls >= 1").withColumn("difference", F.col("event_pass") - F.col("control_rate"))


def rule_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, hit rate, control rate, raw control rate, lift (infinite without control passes), difference; distinct symbols and dates if the groups have them."""
    seen = [F.count_distinct(c).alias(f"{c}s") for c in ("symbol", "event_date") if c in groups.columns]
    x = groups.agg(*seen, F.count("*").alias("groups"), F.avg("event_pass").alias("hit"), F.avg("control_rate").alias("control_pass"), (F.sum("control_passes") / F.sum("controls")).alias("raw_control_pass"), F.avg("difference").alias("difference"))
    lift = F.when(F.col("control_pass") > 0, F.col("hit") / F.col("control_pass")).when(F.col("hit") > 0, F.lit(float("inf")))
    return x.withColumn("lift", lift)


def concentration(groups: DataFrame, key: str) -> DataFrame:
    """One row: the key with the largest share of the summed positive differences (the smallest of equals); nulls if nothing is positive."""
    x = groups.groupBy(key).agg(F.sum(F.greatest(F.col("difference"), F.lit(0.0))).alias("gain"))
    # min_by on the negated gain takes the smallest key of equals, whatever its type
    top = F.when(F.max("gain") > 0, F.min_by(key, F.struct(-F.col("gain"), key)))
    return x.agg(top.alias("top_key"), F.try_divide(F.max("gain"), F.sum("gain")).alias("top_share"), F.count(F.when(F.col("gain") > 0, 1)).alias("keys"))


#: Shares of Poisson(1) counts up to 0, 1, 2, ...: a cluster's weight in a replicate is how many of them its uniform value reaches.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))
#: Replicates whose uniform values come from one digest, 32 bits each.
PER_DIGEST = 4


def replicate_weights(sums: DataFrame, reps: int, seed: int) -> DataFrame:
    """sums (c and others) with replicate and weight: how often each cluster is drawn in each replicate.

    Weights are independent Poisson(1) counts, the distributed form of drawing clusters with
    replacement: their sum is only about the number of clusters, and the mean divides by it.
    They come from a digest of (seed, replicate, cluster), so they are the same for any layout
    and each task makes its own.
    """
    rounds = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // PER_DIGEST) - 1))).alias("_r"))
    x = rounds.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "_r", "c"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(PER_DIGEST - 1))))
    u = F.conv(F.substring("_h", F.col("_k") * 8 + 1, F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    x = x.withColumns({"replicate": F.col("_r") * PER_DIGEST + F.col("_k"), "_u": u}).where(F.col("replicate") < reps)
    return x.withColumn("weight", sum((F.when(F.col("_u") >= t, 1).otherwise(0) for t in POISSON), F.lit(0))).drop("_r", "_h", "_k", "_u")


def cluster_bootstrap(groups: DataFrame, cluster: str, reps: int = 10_000, seed: int = SEED) -> DataFrame:
    """lo, hi, clusters: percentile interval of the mean difference when whole clusters are drawn again.

    Groups without a cluster stay out; below two clusters there is no interval. Clusters are
    summed first, then weighted replicates are summed where their clusters lie; what is
    brought together is a row for each replicate. Against drawing exactly as many clusters
    with replacement the interval's ends differ by about one part in the number of clusters.
    """
    sums = groups.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum("difference").alias("s"), F.count("*").alias("n"))
    drawn = replicate_weights(sums, reps, seed).where("weight > 0").groupBy("replicate").agg((F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("n"))).alias("v"))
    clusters = sums.agg(F.count("*").cast("int").alias("clusters"))
    # one row a replicate, a number that is a parameter
    ends = drawn.agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"))
    some = F.col("clusters") >= 2
    return ends.join(F.broadcast(clusters)).select(F.when(some, F.col("lo")).alias("lo"), F.when(some, F.col("hi")).alias("hi"), "clusters")


def randomisation(rows: DataFrame, group: str, is_event: Column, rule: Column, reps: int = 50_000, seed: int = SEED) -> DataFrame:
    """observed, p: add-one p-value of the mean difference if the event were any member of its group.

    A group is its number of members and of passes; equal groups are counted in Spark
    first, so the seeded draw runs over at most a few hundred kinds of groups.
    """
    hit = F.when(F.coalesce(rule, F.lit(False)), 1).otherwise(0)
    x = rows.groupBy(group).agg(F.count("*").alias("m"), F.sum(hit).alias("k"), F.max(F.when(is_event, hit)).alias("e"), F.count(F.when(is_event, 1)).alias("ne")).where("ne = 1 and m >= 2")
    kinds = x.groupBy("m", "k").agg(F.count("*").alias("n"), F.sum("e").alias("e"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m", "k"])
        m, k, n, e = (pdf[c].to_numpy(float) for c in ("m", "k", "n", "e"))
        rng, total = np.random.default_rng(seed), n.sum()
        value = lambda hits: (hits - (n * k - hits) / (m - 1)).sum(-1) / total
        seen = value(e)
        drawn = rng.binomial(n.astype(int), k / m, (reps, len(n))).astype(float)
        p = (1 + int((value(drawn) >= seen - 1e-12).sum())) / (reps + 1)
        return pd.DataFrame([(float(seen), p)], columns=["observed", "p"])

    return kinds.groupBy().applyInPandas(draw, "observed double, p double")


def strategy_summary(trades: DataFrame, by: list[str], pnl: str, filled: Column, order: list[str]) -> DataFrame:
    """Counts, fill and win rate, mean, median, profit factor (999 without losses), total without the three best."""
    from tidemark.operators.ordered import top_k

    done = trades.where(filled)
    base = trades.groupBy(*by).agg(F.count("*").alias("trades"), F.count(F.when(filled, 1)).alias("filled"))
    gain, loss = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), -F.sum(F.when(F.col(pnl) < 0, F.col(pnl)).otherwise(0.0))
    stats = done.groupBy(*by).agg(F.avg(F.when(F.col(pnl) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(pnl).alias("mean_pnl"), F.median(pnl).alias("median_pnl"), F.when(loss > 0, gain / loss).otherwise(999.0).alias("profit_factor"), F.sum(pnl).alias("total"))
    best = top_k(done, by, [F.desc(pnl), *order], 3).groupBy(*by).agg(F.sum(pnl).alias("best3"))
    x = base.join(stats, by, "left").join(best, by, "left")
    return x.withColumn("fill_rate", F.col("filled") / F.col("trades")).withColumn("total_without_best3", F.col("total") - F.col("best3")).drop("best3")


def daily_lower_bound(trades: DataFrame, by: list[str], day: str, pnl: str, reps: int = 10_000, seeds: dict | None = None, seed: int = 1702) -> DataFrame:
    """by, days, lower: the 2.5 % point of the mean daily profit when days are drawn again; null below ten days.

    Profits are summed by day in Spark; a key's days, bounded by the calendar, are drawn
    with Python's own generator in order of the days, so the draws are reproducible.
    ``seeds`` gives seeds for single keys (by the first column of by).
    """
    import random

    seeds = seeds or {}

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("_day")["_pnl"].tolist()
        n, low = len(values), None
        if n >= 10:
            rng = random.Random(seeds.get(key[0], seed))
            means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(reps))
            low = means[max(0, int(0.025 * reps) - 1)]
        return pd.DataFrame([(*key, n, low)], columns=[*by, "days", "lower"])

    days = trades.where(F.col(pnl).isNotNull()).groupBy(*by, F.col(day).alias("_day")).agg(F.sum(pnl).alias("_pnl"))
    kinds = ", ".join(f"{c} {trades.schema[c].dataType.simpleString()}" for c in by)
    return days.groupBy(*by).applyInPandas(draw, f"{kinds}, days long, lower double")


# Names and limits of the ten gates of a strategy.
GATES = {
    "minimum_30_resolved_trades": "resolved_trade_count >= 30",
    "minimum_15_trading_days": "market_days_with_resolved_trades >= 15",
    "positive_primary_pnl": "total_pnl_usd > 0",
    "profit_factor_at_least_1_25": "profit_factor >= 1.25",
    "positive_at_10bps_each_side": "total_pnl_10bps_each_side > 0",
    "positive_without_top3_winners": "pnl_without_top3_winners_usd > 0",
    "bootstrap_lower_daily_mean_positive": "bootstrap_95pct_lower_mean_daily_pnl_usd > 0",
    "drawdown_within_5000": "max_drawdown_usd >= -5000",
    "maximum_10_consecutive_losses": "max_consecutive_losses <= 10",
    "unresolved_exit_rate_at_most_1pct": "unresolved_exit_rate <= 0.01",
}


def gates(summary: DataFrame) -> DataFrame:
    """Adds a boolean for each gate (null inputs fail it) and window_gate_passed."""
    x = summary.withColumns({k: F.coalesce(F.expr(v), F.lit(False)) for k, v in GATES.items()})
    every = F.lit(True)
    for k in GATES:
        every = every & F.col(k)
    return x.withColumn("window_gate_passed", every)


def backtest_summary(triggers: DataFrame, trades: DataFrame, by: str = "strategy", reps: int = 10_000, seeds: dict | None = None) -> DataFrame:
    """A row for each strategy with triggers: counts, fills, exits, returns, streaks, drawdown, robustness and its gates.

    triggers has the strategy and selected; trades has strategy, trade_date, rank, filled,
    pnl_usd, return_pct, exit_reason, and pnl_0bps and pnl_10bps of the friction scenarios.
    A filled trade without a profit has an unresolved exit.
    """
    from tidemark.operators.ordered import equity_drawdown, longest_streak, top_k

    entered = trades.where("filled")
    done = entered.where("pnl_usd is not null")
    t = triggers.groupBy(by).agg(F.count("*").alias("trigger_count"), F.count_if(F.coalesce("selected", F.lit(False))).alias("selected_count"))
    a = trades.groupBy(by).agg(F.count("*").alias("_trades"), F.count_if(F.col("filled")).alias("entry_fill_count"))
    gain, loss = F.sum(F.when(F.col("pnl_usd") > 0, F.col("pnl_usd")).otherwise(0.0)), F.sum(F.when(F.col("pnl_usd") < 0, F.col("pnl_usd")).otherwise(0.0))
    wins, losses = F.count_if(F.col("pnl_usd") > 0), F.count_if(F.col("pnl_usd") < 0)
    d = done.groupBy(by).agg(
        F.count("*").alias("resolved_trade_count"),
        *(F.count_if(F.col("exit_reason") == k).alias(n) for k, n in (("target", "target_count"), ("stop", "stop_count"), ("time", "time_exit_count"))),
        (wins / F.count("*")).alias("win_rate"),
        F.avg("return_pct").alias("mean_return_pct"),
        F.median("return_pct").alias("median_return_pct"),
        F.sum("pnl_usd").alias("total_pnl_usd"),
        F.when(losses > 0, gain / F.abs(loss)).when(wins > 0, 999.0).alias("profit_factor"),
        F.count_distinct("trade_date").alias("market_days_with_resolved_trades"),
    )
    s = entered.groupBy(by).agg(*(e for k in ("0bps", "10bps") for e in (F.sum(f"pnl_{k}").alias(f"total_pnl_{k}_each_side"), F.count(f"pnl_{k}").alias(f"resolved_trades_{k}_each_side"))))
    days = done.groupBy(by, "trade_date").agg(F.sum("pnl_usd").alias("pnl"))
    fall = equity_drawdown(days, [by], ["trade_date"], "pnl").select(by, (-F.col("drawdown")).alias("max_drawdown_usd"))
    bad = longest_streak(done, [by], ["trade_date", "rank"], F.col("pnl_usd") < 0).withColumnRenamed("streak", "max_consecutive_losses")
    bad_days = longest_streak(days, [by], ["trade_date"], F.col("pnl") < 0).withColumnRenamed("streak", "max_consecutive_losing_days")
    best = top_k(done, [by], [F.desc("pnl_usd"), "trade_date", "rank"], 3, "_k").groupBy(by).agg(F.sum("pnl_usd").alias("_best3"))
    low = daily_lower_bound(done, [by], "trade_date", "pnl_usd", reps, seeds).select(by, F.col("lower").alias("bootstrap_95pct_lower_mean_daily_pnl_usd"))
    x = t
    for part in (a, d, s, fall, bad, bad_days, best, low):
        x = x.join(part, by, "left")
    zero = ["entry_fill_count", "resolved_trade_count", "target_count", "stop_count", "time_exit_count", "market_days_with_resolved_trades", "max_consecutive_losses", "max_consecutive_losing_days", "resolved_trades_0bps_each_side", "resolved_trades_10bps_each_side"]
    x = x.na.fill(0, zero).na.fill(0.0, ["total_pnl_usd", "max_drawdown_usd"])
    x = x.withColumns({"fill_rate": F.try_divide(F.col("entry_fill_count"), F.col("_trades")), "unresolved_exit_count": F.col("entry_fill_count") - F.col("resolved_trade_count"), "pnl_without_top3_winners_usd": F.when(F.col("resolved_trade_count") > 3, F.col("total_pnl_usd") - F.col("_best3"))})
    return gates(x.withColumn("unresolved_exit_rate", F.coalesce(F.try_divide(F.col("unresolved_exit_count"), F.col("entry_fill_count")), F.lit(0.0)))).drop("_trades", "_best3")


# What a rule must reach in an external validation.
CRITERIA = {
    "minimum_usable_matched_groups": 200,
    "minimum_event_dates": 30,
    "minimum_symbols": 50,
    "minimum_matched_lift": 1.5,
    "maximum_single_symbol_share_of_positive_advantage": 0.10,
    "minimum_eligible_months": 4,
    "minimum_groups_per_eligible_month": 20,
    "minimum_fraction_of_eligible_months_with_positive_effect": 0.75,
    "minimum_median_eligible_month_lift": 1.25,
}


def monthly(groups: DataFrame, month: str = "month") -> DataFrame:
    """month, groups, hit, control_pass, difference, lift (infinite without control passes)."""
    x = groups.groupBy(month).agg(F.count("*").alias("groups"), F.avg("event_pass").alias("hit"), F.avg("control_rate").alias("control_pass"), F.avg("difference").alias("difference"))
    return x.withColumn("lift", F.when(F.col("control_pass") > 0, F.col("hit") / F.col("control_pass")).when(F.col("hit") > 0, F.lit(float("inf"))))


def validate_rule(rows: DataFrame, rule: Column, name: str, criteria: dict = CRITERIA, reps: int = 10_000, draws: int = 50_000) -> DataFrame:
    """One row: the statistics of a rule on matched groups, its intervals, p-value, concentration, months, criteria and status.

    rows are eligible samples: match_group_id, label (1 event, 0 control), symbol,
    event_date (text). Without usable groups the status is insufficient_data.
    """
    is_event = F.col("label") == 1
    g = matched_groups(rows, "match_group_id", is_event, rule, ["symbol", "event_date"]).withColumn("month", F.substring("event_date", 1, 7))
    raw = rows.agg(F.avg(F.when(F.col("label") == 0, F.when(F.coalesce(rule, F.lit(False)), 1.0).otherwise(0.0))).alias("raw_control_pass_rate"))
    m = monthly(g).where(F.col("groups") >= criteria["minimum_groups_per_eligible_month"])
    months = m.agg(F.count("*").alias("eligible_months"), F.avg(F.when(F.col("difference") > 0, 1.0).otherwise(0.0)).alias("positive_month_fraction"), F.median(F.when(F.col("lift") < float("inf"), F.col("lift"))).alias("median_month_lift"))
    by_date = cluster_bootstrap(g, "event_date", reps).select(F.col("lo").alias("date_lo"), F.col("hi").alias("date_hi"))
    by_symbol = cluster_bootstrap(g, "symbol", reps).select(F.col("lo").alias("symbol_lo"), F.col("hi").alias("symbol_hi"))
    x = rule_stats(g).drop("raw_control_pass").withColumn("rule", F.lit(name))
    # each part is one row
    for part in (raw, concentration(g, "symbol").drop("keys"), months, by_date, by_symbol, randomisation(rows, "match_group_id", is_event, rule, draws).select("p")):
        x = x.join(F.broadcast(part), how="left")
    c = F.col
    checks = {
        "usable_groups": c("groups") >= criteria["minimum_usable_matched_groups"],
        "event_dates": c("event_dates") >= criteria["minimum_event_dates"],
        "symbols": c("symbols") >= criteria["minimum_symbols"],
        "matched_lift": c("lift") >= criteria["minimum_matched_lift"],
        "date_cluster_ci": c("date_lo") > 0,
        "symbol_cluster_ci": c("symbol_lo") > 0,
        "symbol_concentration": c("top_share") <= criteria["maximum_single_symbol_share_of_positive_advantage"],
        "eligible_month_count": c("eligible_months") >= criteria["minimum_eligible_months"],
        "monthly_positive_fraction": c("positive_month_fraction") >= criteria["minimum_fraction_of_eligible_months_with_positive_effect"],
        "median_month_lift": c("median_month_lift") >= criteria["minimum_median_eligible_month_lift"],
    }
    every = F.lit(True)
    for v in checks.values():
        every = every & F.coalesce(v, F.lit(False))
    status = F.when(c("groups") == 0, "insufficient_data").when(every, "pass").otherwise("fail")
    return x.withColumns({f"meets_{k}": F.coalesce(v, F.lit(False)) for k, v in checks.items()} | {"status": status})


def external_validation(rows: DataFrame, rules: RuleRegistry | None = None, criteria: dict = CRITERIA, reps: int = 10_000, draws: int = 50_000) -> DataFrame:
    """A row for each frozen rule over the eligible samples of rows, each judged on its own."""
    from functools import reduce

    from tidemark.operators.universe import eligible_samples

    rules = rules if rules is not None else default_rules()
    eligible = eligible_samples(rows)
    return reduce(DataFrame.unionByName, [validate_rule(eligible, rule, name, criteria, reps, draws) for name, rule in rules.items()])
