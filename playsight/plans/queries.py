"""Registered queries: each applies one operator to the bound tables, with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions import market as M
from playsight.functions.nulls import guarded_corr, is_true, safe_div
from playsight.operators import joins as J
from playsight.operators import ledger as L
from playsight.operators import ratio as R
from playsight.operators import stats as S
from playsight.operators import windows as X
from playsight.plans import builders, models, traits
from playsight.plans.bindings import EV, OF, PR, UD, offers, projections, ratio_events, table, user_days

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(c: str | F.Column, digits: int = 6) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- windows ----------------------------------------------------------------------------------

_ADJ = f"""{EV}, wk AS (SELECT l_suppkey, week, sum(n) AS n, sum(d) AS d FROM ev GROUP BY ALL), lw AS (SELECT week, sum(n) AS n, sum(d) AS d FROM ev GROUP BY ALL),
al AS (SELECT l_suppkey, week, sum(n) OVER w / nullif(sum(d) OVER w, 0) AS allowed FROM wk WINDOW w AS (PARTITION BY l_suppkey ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lg AS (SELECT week, sum(n) OVER w / nullif(sum(d) OVER w, 0) AS league FROM lw WINDOW w AS (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
adj AS (SELECT ev.*, coalesce(ev.n - ev.d * (allowed - league), ev.n) AS n_adj FROM ev LEFT JOIN al USING (l_suppkey, week) LEFT JOIN lg USING (week))"""


@query("W2_opponent_adjusted", f"WITH {_ADJ} SELECT l_partkey, week, round(sum(n_adj), 5) AS n_adj, sum(d) AS d FROM adj GROUP BY ALL")
def opponent_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = X.opponent_adjusted(ratio_events(spark, sf_dir), "l_suppkey")
    return adj.groupBy("l_partkey", "week").agg(r(F.sum("n_adj"), 5).alias("n_adj"), F.sum("d").alias("d"))


@query("flagship_supplier_percentile", f"""WITH {_ADJ}, v AS (SELECT l_suppkey, sum(n_adj) / nullif(sum(d), 0) AS value FROM adj GROUP BY ALL),
g AS (SELECT l_suppkey, n_regionkey AS region, round(value, 6) AS value FROM v JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
k AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY value) + (count(*) OVER (PARTITION BY region, value) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY region) AS m FROM g)
SELECT l_suppkey, region, value, round(CASE WHEN m = 1 THEN 100.0 ELSE 100.0 * (ar - 1) / (m - 1) END, 6) AS percentile FROM k""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = X.opponent_adjusted(ratio_events(spark, sf_dir), "l_suppkey")
    value = adj.groupBy("l_suppkey").agg(r(safe_div(F.sum("n_adj"), F.sum("d"))).alias("value"))
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    rows = value.join(home, "l_suppkey").join(nation, "s_nationkey")
    return X.percentiled(rows, ["region"], "value", "percentile").select("l_suppkey", "region", "value", r("percentile").alias("percentile"))


@query("W1_prior_rate", f"""WITH {EV}, wk AS (SELECT l_suppkey, week, sum(n) AS n, sum(d) AS d FROM ev GROUP BY ALL)
SELECT l_suppkey, week, round(sum(n) OVER w / nullif(sum(d) OVER w, 0), 6) AS rate FROM wk WINDOW w AS (PARTITION BY l_suppkey ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.prior_rate(ratio_events(spark, sf_dir), ["l_suppkey"], "rate")
    return out.select("l_suppkey", "week", r("rate").alias("rate"))


@query("W3_exclusive_totals", f"""WITH {EV}, wk AS (SELECT l_partkey, week, sum(n) AS n, sum(d) AS d FROM ev GROUP BY ALL)
SELECT l_partkey, week, round(sum(n) OVER w, 4) AS prior_n, sum(d) OVER w AS prior_d FROM wk WINDOW w AS (PARTITION BY l_partkey ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def exclusive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prior_totals(ratio_events(spark, sf_dir), ["l_partkey"]).select("l_partkey", "week", r("prior_n", 4).alias("prior_n"), "prior_d")


@query("W5_z_score", """WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal, avg(c_acctbal) OVER w AS m, stddev_samp(c_acctbal) OVER w AS s FROM customer WINDOW w AS (PARTITION BY c_mktsegment))
SELECT c_custkey, round(greatest(-3.0, least(3.0, coalesce(CASE WHEN s > 0 THEN (c_acctbal - m) / s END, 0.0))), 6) AS z FROM c""")
def z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.z_scored(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "z").select("c_custkey", r("z").alias("z"))


@query("W6_alternation", "SELECT event_id, (row_number() OVER w - 1) % 2 AS half, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    place = F.row_number().over(w)
    return table(spark, sf_dir, "events").select("event_id", ((place - 1) % 2).cast("long").alias("half"), place.cast("long").alias("place"), F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("size"))


@query("W7_group_share", "SELECT c_custkey, round(c_acctbal / nullif(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 6) AS share, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS imputed FROM customer")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.group_shared(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal")
    return out.select("c_custkey", r("share").alias("share"), r("mean", 4).alias("imputed"))


@query("W8_group_latest_week", f"WITH {EV} SELECT DISTINCT l_suppkey, max(week) OVER (PARTITION BY l_suppkey) AS latest FROM ev")
def group_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio_events(spark, sf_dir).groupBy("l_suppkey").agg(F.max("week").alias("latest"))


@query("W9_replacement_level", f"""WITH {EV}, v AS (SELECT l_partkey, sum(n) / nullif(sum(d), 0) AS value, sum(d) AS g FROM ev GROUP BY ALL), m AS (SELECT avg(value) AS mean FROM v),
s AS (SELECT p_brand, (value * g + mean * 50) / (g + 50) AS shrunk FROM v, m, part WHERE p_partkey = l_partkey)
SELECT p_brand, round(quantile_cont(shrunk, 0.25), 6) AS replacement, count(*) AS n FROM s GROUP BY p_brand""")
def replacement_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ratio_events(spark, sf_dir).groupBy("l_partkey").agg(safe_div(F.sum("n"), F.sum("d")).alias("value"), F.sum("d").alias("g"))
    mean = v.agg(F.avg("value").alias("mean"))
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = v.crossJoin(F.broadcast(mean)).join(brand, "l_partkey").withColumn("shrunk", R.shrunk(F.col("value"), F.col("g"), F.col("mean"), 50.0))
    return rows.groupBy("p_brand").agg(r(F.percentile("shrunk", 0.25)).alias("replacement"), F.count(F.lit(1)).alias("n"))


@query("W10_week_grid", f"""WITH {EV}, wk AS (SELECT l_suppkey, week, sum(n) AS n, sum(d) AS d FROM ev GROUP BY ALL), f AS (SELECT l_suppkey, min(week) AS f FROM wk GROUP BY ALL),
g AS (SELECT l_suppkey, week FROM f, (SELECT DISTINCT week FROM ev) WHERE week >= f)
SELECT l_suppkey, week, round(coalesce(sum(n) OVER w, 0), 2) AS cum_n, coalesce(sum(d) OVER w, 0) AS cum_d FROM g LEFT JOIN wk USING (l_suppkey, week) WINDOW w AS (PARTITION BY l_suppkey ORDER BY week)""")
def week_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ratio_events(spark, sf_dir)
    return X.grid_cumulative(ev, ["l_suppkey"], ev.select("week").distinct()).select("l_suppkey", "week", r("cum_n", 2).alias("cum_n"), "cum_d")


@query("W11_prior_median", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, value FROM events), k AS (SELECT DISTINCT event_type, day FROM d)
SELECT k.event_type, k.day, round(quantile_cont(d.value, 0.5), 6) AS median FROM k LEFT JOIN d ON d.event_type = k.event_type AND d.day < k.day GROUP BY ALL""")
def prior_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return X.prior_median(d, "event_type", "day", "value").select("event_type", "day", r("median").alias("median"))


@query("W12_running_max", f"WITH {UD} SELECT user_id, day, round(max(n) OVER (PARTITION BY user_id ORDER BY day), 6) AS best FROM ud")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return user_days(spark, sf_dir).select("user_id", "day", r(F.max("n").over(w)).alias("best"))


@query("W14_centred_mean", f"WITH {UD} SELECT user_id, day, round(avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING), 6) AS smooth FROM ud")
def centred_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", r(X.centred_mean("n", ["user_id"], "day", 16)).alias("smooth"))


@query("W15_decayed_state", f"""WITH {UD}, z AS (SELECT *, sum(d) OVER w / 40.0 + date_diff('day', min(day) OVER (PARTITION BY user_id), day) / 10.0 AS z FROM ud WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, round(pow(0.5, z) * sum(n * pow(2.0, z)) OVER (PARTITION BY user_id ORDER BY day), 4) AS state FROM z""")
def decayed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = user_days(spark, sf_dir).withColumn("clock", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double"))
    return X.decayed_state(ud, "user_id", "clock", "n", "d", 40.0, 10.0, ["day"]).select("user_id", "day", r("state", 4).alias("state"))


@query("W17_rank_change", f"""WITH {UD}, k AS (SELECT user_id, day, rank() OVER (PARTITION BY day ORDER BY round(n, 6) DESC) AS place FROM ud)
SELECT a.user_id, a.day, a.place, b.place - a.place AS gained FROM k a LEFT JOIN k b ON a.user_id = b.user_id AND a.day = b.day + 1""")
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = user_days(spark, sf_dir).select("user_id", "day", F.rank().over(W.partitionBy("day").orderBy(F.round("n", 6).desc())).cast("long").alias("place"))
    b = k.select("user_id", F.date_add("day", 1).alias("day"), F.col("place").alias("_p"))
    return k.join(b, ["user_id", "day"], "left").select("user_id", "day", "place", (F.col("_p") - F.col("place")).alias("gained"))


@query("W19_fringe", "WITH k AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, c_acctbal AS fringe FROM k WHERE p = least(32, n)")
def fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only the 32 best matter: each part of a segment keeps its own first, then they are ranked together
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey").withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(64)))
    best = lambda df, *keys: df.withColumn("p", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("c_acctbal"), "c_custkey"))).where("p <= 32")
    return best(best(c, "c_mktsegment", "part"), "c_mktsegment").groupBy("c_mktsegment").agg(F.max_by("c_acctbal", "p").alias("fringe"))


# ---- ratio aggregations -----------------------------------------------------------------------


@query("A7_ratio_events", f"WITH {EV} SELECT l_partkey, week, round(sum(n), 4) AS n, sum(d) AS d FROM ev GROUP BY ALL")
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio_events(spark, sf_dir).groupBy("l_partkey", "week").agg(r(F.sum("n"), 4).alias("n"), F.sum("d").alias("d"))


@query("A8_trait_dispatch", f"""WITH {EV}, w AS (SELECT l_suppkey, week, sum(n) AS n, sum(d) AS d FROM ev GROUP BY ALL),
t AS (SELECT *, unnest(['price', 'floor', 'last']) AS trait FROM w)
SELECT l_suppkey, trait, count(DISTINCT week) AS games, round(CASE trait WHEN 'price' THEN sum(n) / sum(d) WHEN 'floor' THEN CASE WHEN count(*) >= 4 THEN quantile_cont(n / d, 0.2) END ELSE arg_max(n, week) END, 4) AS value FROM t GROUP BY l_suppkey, trait""")
def trait_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.weekly(ratio_events(spark, sf_dir), ["l_suppkey"]).withColumn("trait", F.explode(F.array(F.lit("price"), F.lit("floor"), F.lit("last"))))
    out = R.dispatch(w, ["l_suppkey"], {"price": "rate", "floor": "quantile20", "last": "latest"})
    return out.select("l_suppkey", "trait", "games", r("value", 4).alias("value"))


@query("A9_leave_one_out", f"""WITH {EV}, e AS (SELECT l_orderkey, l_partkey, round(sum(n) * 10000) AS n, sum(d) AS d FROM ev GROUP BY ALL), o AS (SELECT *, sum(n) OVER w - n AS on_, sum(d) OVER w - d AS od FROM e WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_partkey, floor(CASE WHEN od >= 5 THEN n - d * (on_ / od) END) AS n_rel FROM o""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in whole ten-thousandths, whose sums don't depend on their order
    e = ratio_events(spark, sf_dir).groupBy("l_orderkey", "l_partkey").agg(F.round(F.sum("n") * 10_000).alias("n"), F.sum("d").alias("d"))
    return R.leave_one_out(e, ["l_orderkey"]).select("l_orderkey", "l_partkey", F.floor("n_rel").cast("double").alias("n_rel"))


@query("A10_with_without", f"""WITH {UD}, t AS (SELECT day, sum(n) AS v FROM ud GROUP BY day), u AS (SELECT DISTINCT user_id FROM ud),
g AS (SELECT u.user_id, t.day, t.v, ud.user_id IS NOT NULL AS present FROM u CROSS JOIN t LEFT JOIN ud ON ud.user_id = u.user_id AND ud.day = t.day),
c AS (SELECT user_id, count(*) FILTER (present) AS p, count(*) FILTER (NOT present) AS a, avg(v) FILTER (present) AS mp, avg(v) FILTER (NOT present) AS ma FROM g GROUP BY ALL)
SELECT user_id, p AS n_present, a AS n_absent, round(CASE WHEN p >= 3 AND a > 0 THEN (ma - mp) * (p * a) / (p * a + 6.0) END, 6) AS effect FROM c""")
def with_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = user_days(spark, sf_dir)
    days = ud.groupBy("day").agg(F.sum("n").alias("v"))
    present = ud.select("user_id", "day").join(days, "day")
    return R.with_without_totals(present, days, ["user_id"], "v").select("user_id", "n_present", "n_absent", r("effect").alias("effect"))


@query("A12_role_shares", """WITH s AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS pr FROM lineitem),
o AS (SELECT l_orderkey, l_suppkey, min(pr) AS pr FROM s GROUP BY ALL)
SELECT l_orderkey, l_suppkey, pr AS role, round((CASE pr WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.5 END)::DOUBLE / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM o""")
def role_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pr = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min(pr).alias("role"))
    weight = F.element_at(F.array(F.lit(1.0), F.lit(0.75), F.lit(0.5)), F.col("role") + 1)
    return o.select("l_orderkey", "l_suppkey", "role", r(weight / F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))).alias("share"))


@query("A18_conditional_sums", """SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'R') AS returned, sum(l_quantity) FILTER (l_linestatus = 'O') AS open_qty, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) AS lines,
round(sum(l_quantity) FILTER (l_returnflag = 'R') / nullif(sum(l_quantity), 0), 6) AS return_rate FROM lineitem GROUP BY l_suppkey""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda cond: F.sum(F.when(cond, F.col("l_quantity")))
    back = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(q(back).alias("returned"), q(F.col("l_linestatus") == "O").alias("open_qty"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count(F.lit(1)).alias("lines"), r(safe_div(q(back), F.sum("l_quantity"))).alias("return_rate"))


@query("A20_decayed_rate", f"WITH {EV}, m AS (SELECT max(week) AS m FROM ev) SELECT l_suppkey, round(sum(n * pow(0.5, (m - week) / 6.0)) / sum(d * pow(0.5, (m - week) / 6.0)), 6) AS rate FROM ev, m GROUP BY l_suppkey")
def decayed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.decayed_rate(ratio_events(spark, sf_dir), ["l_suppkey"], "week", 6.0).select("l_suppkey", r("rate").alias("rate"))


@query("A22_split_half", f"""WITH {UD}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM ud), k AS (SELECT * FROM i WHERE i // 2 < c // 2),
h AS (SELECT user_id, sum(n) FILTER (i % 2 = 0) / sum(d) FILTER (i % 2 = 0) AS x, sum(n) FILTER (i % 2 = 1) / sum(d) FILTER (i % 2 = 1) AS y FROM k GROUP BY ALL)
SELECT 'all' AS scope, count(*) AS units, round(CASE WHEN count(*) >= 30 THEN 2 * corr(x, y) / (1 + corr(x, y)) END, 6) AS reliability FROM h WHERE x IS NOT NULL AND y IS NOT NULL""")
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = user_days(spark, sf_dir).withColumn("scope", F.lit("all"))
    return S.split_half(ud, ["scope"], "user_id", ["day"]).select("scope", "units", r("reliability").alias("reliability"))


@query("A23_spearman", """WITH k AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL)
SELECT c_mktsegment, count(*) AS pairs, round(corr(x, y), 6) AS rho FROM k GROUP BY ALL""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey").select("c_mktsegment", "pairs", r("rho").alias("rho"))


@query("A24_ols", """WITH a AS (SELECT l_suppkey, regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS s, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(n AS BIGINT) AS n, round(s, 4) AS slope, round(CASE WHEN n > 2 THEN sqrt(greatest(0.0, syy - s * s * sxx) / (n - 2.0) / nullif(sxx, 0)) END, 4) AS se FROM a""")
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ols(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity").select("l_suppkey", "n", r("slope", 4).alias("slope"), r("se", 4).alias("se"))


@query("A25_through_origin", "SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 64 THEN sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) ELSE 2.7 END, 4) AS slope FROM lineitem GROUP BY ALL")
def through_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.through_origin(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", 2.7, 64).select("l_suppkey", "n", r("slope", 4).alias("slope"))


@query("A26_error_metrics", f"WITH {PR} SELECT season, count(*) AS n, round(avg(abs(pure - actual)), 6) AS mae, round(sqrt(avg((pure - actual) * (pure - actual))), 6) AS rmse, round(avg(pure - actual), 6) AS bias FROM pr GROUP BY season")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projections(spark, sf_dir).groupBy("season").agg(*S.error_metrics(F.col("pure"), F.col("actual")))
    return out.select("season", "n", *[r(c).alias(c) for c in ("mae", "rmse", "bias")])


@query("A27_segments", f"""WITH {PR}, s AS (SELECT pure, actual, unnest([{{'kind': 'overall', 'label': 'all'}}, {{'kind': 'quarter', 'label': CAST(quarter AS VARCHAR)}}, {{'kind': 'size', 'label': CASE WHEN abs(pure) < 3 THEN 'close' WHEN abs(pure) < 7 THEN 'mid' ELSE 'wide' END}}]) AS seg FROM pr)
SELECT seg.kind AS kind, seg.label AS label, count(*) AS n, round(avg(abs(pure - actual)), 6) AS mae FROM s GROUP BY ALL""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    size = F.when(F.abs("pure") < 3, "close").when(F.abs("pure") < 7, "mid").otherwise("wide")
    rows = projections(spark, sf_dir).select("pure", "actual", F.explode(F.array(seg("overall", F.lit("all")), seg("quarter", F.col("quarter").cast("string")), seg("size", size))).alias("s"))
    return rows.groupBy(F.col("s.kind").alias("kind"), F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("pure") - F.col("actual")))).alias("mae"))


_CAL = f"""{PR}, q AS (SELECT game, home, (game % 100) / 100.0 AS p, actual > 0 AS y FROM pr)"""


@query("A29_calibration", f"""WITH {_CAL}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS rows, count(DISTINCT home) AS clusters, avg(p) AS pm, avg(y::INT) AS om FROM q GROUP BY 1)
SELECT bin, rows, clusters, round(pm, 6) AS predicted, round(om, 6) AS observed, round(greatest(0.02, 1.96 * sqrt(pm * (1 - pm) / clusters)), 6) AS tolerance, abs(pm - om) <= greatest(0.02, 1.96 * sqrt(pm * (1 - pm) / clusters)) AS ok FROM b""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = projections(spark, sf_dir).select("game", "home", (F.pmod("game", F.lit(100)) / 100.0).alias("p"), (F.col("actual") > 0).cast("int").alias("y"))
    return S.calibration(q, "p", "y", "home").select("bin", "rows", "clusters", r("predicted").alias("predicted"), r("observed").alias("observed"), r("tolerance").alias("tolerance"), "ok")


@query("A26_probability_scores", f"WITH {_CAL} SELECT round(avg((p - y::INT) * (p - y::INT)), 6) AS brier, round(avg(-(y::INT * ln(greatest(0.001, least(0.999, p))) + (1 - y::INT) * ln(1 - greatest(0.001, least(0.999, p))))), 6) AS log_loss FROM q")
def probability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = projections(spark, sf_dir).select((F.pmod("game", F.lit(100)) / 100.0).alias("p"), (F.col("actual") > 0).cast("int").alias("y"))
    out = q.agg(*S.probability_scores(F.col("p"), F.col("y"), 0.001))
    return out.select(r("brier").alias("brier"), r("log_loss").alias("log_loss"))


@query("A30_paired_bootstrap")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projections(spark, sf_dir).where("market is not null").select("home", F.abs(F.col("pure") - F.col("actual")).alias("a"), F.abs(F.col("market") - F.col("actual")).alias("b"))
    return S.paired_bootstrap(p, "home", "a", "b")


@query("A31_grouping_sets", f"WITH {PR} SELECT season, CAST(grouping(season) AS INTEGER) AS is_total, count(*) AS n, round(avg(abs(pure - actual)), 6) AS mae FROM pr GROUP BY GROUPING SETS ((season), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projections(spark, sf_dir)
    out = p.groupingSets([["season"], []], "season").agg(F.grouping("season").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("pure") - F.col("actual")))).alias("mae"))
    return out.select("season", "is_total", "n", "mae")


@query("A35_two_medians", f"WITH {EV}, {OF}, k AS (SELECT game, side, list_sort(list(price)) AS p FROM of GROUP BY ALL) SELECT game, side, round(list_aggregate(p, 'quantile_cont', 0.5), 6) AS median, p[(len(p) - 1) // 2 + 1] AS quoted FROM k")
def two_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = offers(spark, sf_dir).groupBy("game", "side").agg(F.percentile("price", 0.5).alias("m"), F.collect_list("price").alias("p"))
    return k.select("game", "side", r("m").alias("median"), L.lower_middle(F.col("p")).alias("quoted"))


@query("A36_modal_group", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS p FROM c) SELECT user_id, event_type, n FROM k WHERE p = 1")
def modal_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return X.latest(c, ["user_id"], [F.desc("n"), F.col("event_type")])


# ---- predicates, joins, top-1 -----------------------------------------------------------------


@query("P1_competitive_rows", "SELECT l_returnflag, least(CAST(quarter(l_shipdate) AS INTEGER), 4) AS q, count(*) AS n FROM lineitem WHERE l_quantity <= CASE quarter(l_shipdate) WHEN 1 THEN 28 WHEN 2 THEN 21 WHEN 3 THEN 16 ELSE 14 END OR l_quantity IS NULL GROUP BY ALL")
def competitive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.least(F.quarter("l_shipdate"), F.lit(4))
    most = F.when(q == 1, 28).when(q == 2, 21).when(q == 3, 16).otherwise(14)
    keep = (F.col("l_quantity") <= most) | F.col("l_quantity").isNull()
    return table(spark, sf_dir, "lineitem").where(keep).groupBy("l_returnflag", q.cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query("P2_whole_group_filter", """WITH f AS (SELECT l_orderkey, min(struct_pack(a := l_shipdate, b := l_linenumber, c := l_quantity)) AS f FROM lineitem WHERE l_discount IS NOT NULL GROUP BY ALL)
SELECT l.l_orderkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem l SEMI JOIN (SELECT * FROM f WHERE f.c <= 25) k ON k.l_orderkey = l.l_orderkey GROUP BY ALL""")
def whole_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_quantity", "l_discount")
    first = lines.where("l_discount is not null").groupBy("l_orderkey").agg(F.min(F.struct("l_shipdate", "l_linenumber", "l_quantity")).alias("f"))
    return lines.join(first.where("f.l_quantity <= 25"), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("qty"))


@query("P4_piecewise_credit", "SELECT l_suppkey, round(avg(CASE WHEN l_quantity < 5 THEN 1.2 * l_quantity WHEN l_quantity <= 20 THEN l_quantity WHEN l_quantity <= 40 THEN 20 + 0.5 * (l_quantity - 20) ELSE 30 END), 6) AS credit FROM lineitem GROUP BY ALL")
def piecewise_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    credit = F.when(q < 5, 1.2 * q).when(q <= 20, q).when(q <= 40, 20 + 0.5 * (q - 20)).otherwise(30)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(F.avg(credit)).alias("credit"))


@query("P6_buckets", "SELECT CASE WHEN l_quantity <= 2 THEN '1-2' WHEN l_quantity <= 6 THEN '3-6' WHEN l_quantity <= 10 THEN '7-10' ELSE '11+' END AS distance, CAST(5 * floor(p_size / 5) AS INTEGER) AS size5, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    d = F.when(q <= 2, "1-2").when(q <= 6, "3-6").when(q <= 10, "7-10").otherwise("11+")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (5 * F.floor(F.col("p_size") / 5)).cast("int").alias("size5"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy(d.alias("distance"), "size5").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 4).alias("mean"))


@query("P11_first_reason", f"WITH {EV}, {OF} SELECT game, book, CASE WHEN abs(price) < 100 THEN 'price' WHEN point * 2 <> floor(point * 2) THEN 'grid' WHEN abs(point) > 5 THEN 'bounds' WHEN side = 'away' AND week % 2 = 0 THEN 'stale' END AS reason FROM of")
def first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("price", F.abs("price") < 100), ("grid", F.col("point") * 2 != F.floor(F.col("point") * 2)), ("bounds", F.abs("point") > 5), ("stale", (F.col("side") == "away") & (F.col("week") % 2 == 0))]
    return offers(spark, sf_dir).select("game", "book", L.first_reason(rules).alias("reason"))


@query("P14_incremental_ids", "WITH k AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY year(o_orderdate) * 12 + month(o_orderdate) DESC) AS w FROM orders) SELECT o_orderkey FROM k WHERE w <= 2 UNION SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def incremental_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("week"))
    weeks = orders.select("week").distinct().orderBy(F.desc("week")).limit(2)
    recent = orders.join(F.broadcast(weeks), "week", "left_semi").select("o_orderkey")
    absent = orders.select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return recent.union(absent).distinct()


@query("P15_text_recogniser", r"""SELECT conv_id, turn, regexp_matches(text, '(?i)\b(price|cost|refund)\b') AND NOT regexp_matches(text, '(?i)\b(not|never)\b') AS announced, coalesce(len(regexp_extract_all(text, '[0-9]+')), 0) AS numbers FROM conversations""")
def text_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    hit = F.col("text").rlike(r"(?i)\b(price|cost|refund)\b") & ~F.col("text").rlike(r"(?i)\b(not|never)\b")
    return c.select("conv_id", "turn", hit.alias("announced"), F.coalesce(F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))), F.lit(0)).cast("long").alias("numbers"))


@query("J3_expected_with_fallback", f"""WITH {EV}, t AS (SELECT l_suppkey % 10 AS b, avg(n) AS e, count(*) AS c FROM ev WHERE week < 23970 GROUP BY ALL HAVING count(*) > 0), m AS (SELECT sum(e * c) / sum(c) AS g FROM t WHERE b < 7)
SELECT l_suppkey, round(avg(n - coalesce(e, g)), 4) AS over_expected FROM ev LEFT JOIN (SELECT * FROM t WHERE b < 7) x ON x.b = l_suppkey % 10 CROSS JOIN m GROUP BY ALL""")
def expected_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ratio_events(spark, sf_dir).withColumn("b", F.pmod("l_suppkey", F.lit(10)))
    t = ev.where("week < 23970").groupBy("b").agg(F.avg("n").alias("e"), F.count(F.lit(1)).alias("c")).where("b < 7")
    g = t.agg(safe_div(F.sum(F.col("e") * F.col("c")), F.sum("c")).alias("g"))
    # both tables have at most one row a bucket
    rows = ev.join(F.broadcast(t), "b", "left").crossJoin(F.broadcast(g))
    return rows.groupBy("l_suppkey").agg(r(F.avg(F.col("n") - F.coalesce("e", "g")), 4).alias("over_expected"))


@query("J5_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_semi")


@query("J6_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(seen, "c_custkey", "left_anti")


@query("J7_coalescing_full_outer", """WITH a AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL), b AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' AND value > 50 GROUP BY ALL), c AS (SELECT user_id, min(value) AS v FROM events GROUP BY ALL)
SELECT user_id, round(coalesce(a.v, b.v, c.v), 6) AS v, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 ELSE 2 END AS source FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)""")
def coalescing_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("v"))
    b = e.where("event_type = 'click' and value > 50").groupBy("user_id").agg(F.max("value").alias("v"))
    c = e.groupBy("user_id").agg(F.min("value").alias("v"))
    return J.coalesced([a, b, c], ["user_id"], "v").select("user_id", r("v").alias("v"), "source")


@query("J10_asof_latest", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, arg_max(event_id, event_id) AS view_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, p.ts, v.view_id, v.value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), "value")
    return J.asof_latest(p, v, "user_id", "ts", "ts", ["view_id", "value"], "event_id", "view_id")


@query("J13_band_join", """WITH p AS (SELECT event_id AS a, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS b, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type = 'click')
SELECT a, b, t - s AS lag FROM p JOIN v USING (user_id) WHERE abs(t - s) <= 7200""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("a"), "user_id", sec.alias("t"))
    v = e.where("event_type = 'click'").select(F.col("event_id").alias("b"), "user_id", sec.alias("s"))
    return J.band_join(p, v, "user_id", "t", "s", 7200).select("a", "b", (F.col("t") - F.col("s")).alias("lag"))


@query("J13_similar_names", """WITH l AS (SELECT c_custkey AS who, c_custkey * 60 AS t, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS n, c_mktsegment AS m FROM customer),
r AS (SELECT s_suppkey AS other, s_suppkey * 420 + 30 AS s, 'Customer#' || lpad(CAST(s_suppkey * 7 + s_suppkey % 3 AS VARCHAR), 9, '0') AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDINGS' ELSE 'FURNITURE' END AS m FROM supplier),
p AS (SELECT who, other, t - s AS lag, ((1 - levenshtein(l.n, r.n)::DOUBLE / greatest(length(l.n), length(r.n))) + (1 - levenshtein(l.m, r.m)::DOUBLE / greatest(length(l.m), length(r.m)))) / 2 AS score FROM l JOIN r ON abs(t - s) <= 7200)
SELECT who, other, round(score, 6) AS score, lag FROM p WHERE score >= 0.9 - 1e-12 QUALIFY row_number() OVER (PARTITION BY who ORDER BY round(score, 12) DESC, abs(lag), other) = 1""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("who"), (F.col("c_custkey") * 60).alias("t"), name(F.col("c_custkey")).alias("n"), F.col("c_mktsegment").alias("m"))
    s = F.col("s_suppkey")
    o = table(spark, sf_dir, "supplier").select(s.alias("other"), (s * 420 + 30).alias("s"), name(s * 7 + s % 3).alias("n"), F.when(s % 2 == 0, "BUILDINGS").otherwise("FURNITURE").alias("m"))
    return J.similar_in_band(c, o, "who", "other", "t", "s", 7200, [("n", "n"), ("m", "m")], 0.9).select("who", "other", r("score").alias("score"), "lag")


@query("J14_mirrored_offers", f"WITH {EV}, {OF} SELECT a.game, a.book, a.side, a.point, b.book AS other_book, b.price AS other_price FROM of a JOIN of b ON a.game = b.game AND a.week = b.week AND a.side <> b.side AND a.point = -b.point")
def mirrored_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    b = o.select("game", "week", F.col("side").alias("_s"), (-F.col("point")).alias("point"), F.col("book").alias("other_book"), F.col("price").alias("other_price"))
    return o.join(b, ["game", "week", "point"]).where("side <> _s").select("game", "book", "side", "point", "other_book", "other_price")


@query("J15_matchup_grid", "SELECT a.n_nationkey AS home, b.n_nationkey AS away, a.n_regionkey = b.n_regionkey AS division FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def matchup_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fixed table of nations: the grid is its square by definition
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("home"), F.col("n_regionkey").alias("_a")), n.select(F.col("n_nationkey").alias("away"), F.col("n_regionkey").alias("_b"))
    return a.crossJoin(b).where("home <> away").select("home", "away", (F.col("_a") == F.col("_b")).alias("division"))


@query("J18_season_pairs", "WITH s AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT a.o_custkey, a.season, round(a.v, 2) AS v, round(b.v, 2) AS next_v FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.season = a.season + 1")
def season_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.sum("o_totalprice").alias("v"))
    after = s.select("o_custkey", (F.col("season") - 1).alias("season"), F.col("v").alias("next_v"))
    return s.join(after, ["o_custkey", "season"]).select("o_custkey", "season", r("v", 2).alias("v"), r("next_v", 2).alias("next_v"))


@query("J19_before_after", f"""WITH {UD} SELECT user_id, CAST(cp AS INTEGER) AS checkpoint, round(sum(n) FILTER (dayofmonth(day) <= cp), 6) AS before, round(sum(n) FILTER (dayofmonth(day) > cp), 6) AS after FROM ud, (SELECT unnest([5, 10, 20]) AS cp) GROUP BY ALL""")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_days(spark, sf_dir).withColumn("checkpoint", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    early = F.dayofmonth("day") <= F.col("checkpoint")
    return rows.groupBy("user_id", "checkpoint").agg(r(F.sum(F.when(early, F.col("n")))).alias("before"), r(F.sum(F.when(~early, F.col("n")))).alias("after"))


@query("J20_unique_mapping", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def unique_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unique_mapping(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("K2_latest_row", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM k WHERE p = 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return o.select("o_custkey", "x.o_orderkey", "x.o_orderstatus")


_EVAL = f"""{EV}, {OF}, pf AS (SELECT *, CASE WHEN price >= 100 THEN price / 100.0 WHEN price <= -100 THEN 100.0 / abs(price) END AS profit, 0.30::DOUBLE + ((game * 13 + book) % 23) / 100.0::DOUBLE AS win FROM of), x AS (SELECT *, win * profit - (1 - win) AS ev FROM pf)"""


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).withColumn("win", 0.30 + F.pmod(F.col("game") * 13 + F.col("book"), F.lit(23)) / 100.0)
    return o.withColumn("ev", M.expected_value(F.col("win"), 1 - F.col("win"), F.col("price")))


@query("K3_best_offer", f"WITH {_EVAL}, k AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY round(ev, 9) DESC, book) AS p FROM x) SELECT game, book, price, round(ev, 6) AS ev FROM k WHERE p = 1")
def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_offer(_valued(spark, sf_dir), ["game"], [F.round("ev", 9).desc(), F.col("book")]).select("game", "book", "price", r("ev").alias("ev"))


@query("K4_slate_fill", f"""WITH {_EVAL}, y AS (SELECT *, round(ev - 0.9, 9) AS e FROM x), pk AS (SELECT *, 'pick' AS kind FROM y WHERE e > 0), tk AS (SELECT DISTINCT game FROM pk),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY e DESC, game, book) AS p FROM y WHERE e <= 0 AND game NOT IN (SELECT game FROM tk)) WHERE p = 1),
ln AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY e DESC, game, book) AS q FROM g) WHERE q <= greatest(0, 5 - (SELECT count(*) FROM tk)))
SELECT game, book, round(e, 6) AS e, kind FROM pk UNION ALL SELECT game, book, round(e, 6), 'lean' FROM ln""")
def slate_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _valued(spark, sf_dir).withColumn("e", F.round(F.col("ev") - 0.9, 9))
    return L.fill_slate(o, "game", "e", ["game", "book"]).select("game", "book", r("e").alias("e"), "kind")


# ---- market and ledger ------------------------------------------------------------------------


@query("F_odds_math", f"""WITH {_EVAL} SELECT game, book, round(profit, 6) AS profit, round(1 / (profit + 1), 6) AS implied, round(CASE WHEN win >= 0.5 THEN -100 * win / (1 - win) ELSE 100 * (1 - win) / win END, 4) AS fair, round(ev, 6) AS ev, round(win - 1 / (profit + 1), 6) AS edge FROM x""")
def odds_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = F.col("win"), F.col("price")
    return _valued(spark, sf_dir).select("game", "book", r(M.profit(p)).alias("profit"), r(M.implied(p)).alias("implied"), r(M.fair_price(w), 4).alias("fair"), r("ev").alias("ev"), r(M.edge(w, 1 - w, p)).alias("edge"))


_T7 = "(0.5 + (atan({x} / sqrt(7.0)) + sin(atan({x} / sqrt(7.0))) * (cos(atan({x} / sqrt(7.0))) + (2.0 / 3.0) * pow(cos(atan({x} / sqrt(7.0))), 3) + (8.0 / 15.0) * pow(cos(atan({x} / sqrt(7.0))), 5))) / pi())"
_SC = "(12.82::DOUBLE * sqrt(5.0::DOUBLE / 7.0))"


@query("F_student_t", f"WITH {PR} SELECT game, round({_T7.format(x=f'(pure / {_SC})')}, 6) AS home_p FROM pr")
def student_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections(spark, sf_dir).select("game", r(M.t_cdf7(F.col("pure"), F.lit(12.82))).alias("home_p"))


@query("F_blend_and_total", f"WITH {PR} SELECT game, round(coalesce(0.5 * pure + 0.5 * market, pure), 6) AS margin, round(greatest(45.0 - 0.19748 + 0.71639 * (total - 45.0), abs(coalesce(0.5 * pure + 0.5 * market, pure))), 6) AS total FROM pr")
def blend_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = M.blend(F.col("pure"), F.col("market"), 0.5)
    return projections(spark, sf_dir).select("game", r(margin).alias("margin"), r(F.greatest(M.calibrated_total(F.col("total")), F.abs(margin))).alias("total"))


@query("F_total_probabilities", f"""WITH {PR} SELECT game, round({_T7.format(x=f'((total - floor(line) - 0.5) / {_SC})')}, 6) AS over_p, round({_T7.format(x=f'((ceil(line) - 0.5 - total) / {_SC})')}, 6) AS under_p FROM pr""")
def total_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    over, _, under = M.total_probabilities(F.col("total"), F.col("line"), F.lit(12.82))
    return projections(spark, sf_dir).select("game", r(over).alias("over_p"), r(under).alias("under_p"))


@query("F_integer_pmf", f"""WITH {PR}, k AS (SELECT game, pure, unnest(range(-30, 31)) AS k FROM pr WHERE game % 7 = game % 7),
m AS (SELECT game, k, (CASE WHEN k >= 30 THEN 1.0 ELSE {_T7.format(x=f'((k + 0.5 - pure) / {_SC})')} END) - (CASE WHEN k <= -30 THEN 0.0 ELSE {_T7.format(x=f'((k - 0.5 - pure) / {_SC})')} END) AS p FROM k)
SELECT game, round(sum(p), 6) AS mass, round(sum(p) FILTER (k > 3), 6) AS cover, round(sum(p) FILTER (k = 3), 6) AS push FROM m GROUP BY game""")
def integer_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projections(spark, sf_dir).select("game", M.integer_pmf(F.col("pure"), F.lit(12.82), -30, 30).alias("p"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # whole numbers from -30: 3 is the 34th
    each = p.select("game", total(F.col("p")).alias("mass"), total(F.slice("p", 35, 27)).alias("cover"), F.get("p", F.lit(33)).alias("push"))
    return each.groupBy("game").agg(*[r(F.sum(c)).alias(c) for c in ("mass", "cover", "push")])


@query("L2_settlement", f"""WITH {PR}, o AS (SELECT game, actual, total, line, unnest(['h2h', 'spreads', 'totals']) AS market FROM pr),
b AS (SELECT *, CASE market WHEN 'h2h' THEN actual WHEN 'spreads' THEN actual - 3 ELSE total - line END AS bal FROM o),
s AS (SELECT game, market, CASE WHEN game % 50 = 0 THEN 'no_play' WHEN game % 31 = 0 THEN 'void' WHEN market = 'h2h' AND bal = 0 THEN 'void' WHEN bal > 0 THEN 'win' WHEN bal < 0 THEN 'loss' ELSE 'push' END AS result FROM b)
SELECT market, result, count(*) AS n, round(sum(CASE result WHEN 'win' THEN 100.0 / 110.0 WHEN 'loss' THEN -1.0 ELSE 0.0 END), 4) AS profit FROM s GROUP BY ALL""")
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = projections(spark, sf_dir).withColumn("market", F.explode(F.array(F.lit("h2h"), F.lit("spreads"), F.lit("totals")))).drop("selection")
    side = F.when(F.col("market") == "totals", "over").otherwise("home")
    point = F.when(F.col("market") == "spreads", -3.0).otherwise(F.col("line"))
    bal = L.balance(F.col("market"), side, F.col("actual"), F.col("total"), point)
    s = o.withColumn("result", L.settled(F.col("market"), bal, F.pmod("game", F.lit(50)) != 0, F.pmod("game", F.lit(31)) == 0))
    return s.groupBy("market", "result").agg(F.count(F.lit(1)).alias("n"), r(F.sum(L.settled_profit(F.col("result"), F.lit(-110.0))), 4).alias("profit"))


@query("L7_graded_close", f"WITH {PR} SELECT game, coalesce(market, CASE WHEN game % 5 = 0 THEN total - 40 END) AS close, CASE WHEN market IS NOT NULL THEN 'captured' WHEN game % 5 = 0 THEN 'schedule' END AS source FROM pr")
def graded_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    spare = F.when(F.pmod("game", F.lit(5)) == 0, F.col("total") - 40)
    return projections(spark, sf_dir).select("game", F.coalesce("market", spare).alias("close"), F.when(F.col("market").isNotNull(), "captured").when(spare.isNotNull(), "schedule").alias("source"))


@query("L9_performance_view", f"""WITH {_EVAL}, s AS (SELECT side, price, (game + book) % 2 = 0 AS won FROM x) SELECT side, count(*) AS bets, count(*) FILTER (won) AS wins, round(count(*) FILTER (won) / count(*), 6) AS win_rate,
round(sum(CASE WHEN won THEN CASE WHEN price >= 100 THEN price / 100.0 ELSE 100.0 / abs(price) END ELSE -1 END) / count(*), 6) AS roi, count(*) < 100 AS thin FROM s WHERE abs(price) >= 100 GROUP BY side""")
def performance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = offers(spark, sf_dir).where("abs(price) >= 100").withColumn("won", F.pmod(F.col("game") + F.col("book"), F.lit(2)) == 0)
    n = F.count(F.lit(1))
    return s.groupBy("side").agg(n.alias("bets"), F.count_if("won").alias("wins"), r(F.count_if("won") / n).alias("win_rate"), r(F.sum(F.when(F.col("won"), M.profit(F.col("price"))).otherwise(-1.0)) / n).alias("roi"), (n < 100).alias("thin"))


# ---- semi-structured --------------------------------------------------------------------------


@query("S11_json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.from_json("props", "k INT")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("A33_json_aggregate", "WITH n AS (SELECT n_regionkey, string_agg('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) AS j FROM nation GROUP BY ALL) SELECT n_regionkey, '[' || j || ']' AS payload FROM n")
def json_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(rows)).alias("payload"))


@query("M14_value_over_replacement", f"""WITH {EV}, v AS (SELECT l_partkey, sum(n) / nullif(sum(d), 0) AS value, count(DISTINCT week) AS g FROM ev GROUP BY ALL), m AS (SELECT avg(value) AS mean FROM v),
s AS (SELECT l_partkey, p_brand, g, (value * g + mean * 4) / (g + 4) AS shrunk FROM v, m, part WHERE p_partkey = l_partkey), q AS (SELECT p_brand, quantile_cont(shrunk, 0.25) AS repl FROM s GROUP BY ALL)
SELECT l_partkey, round((shrunk - repl) * g, 4) AS war FROM s JOIN q USING (p_brand)""")
def value_over_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ratio_events(spark, sf_dir).groupBy("l_partkey").agg(safe_div(F.sum("n"), F.sum("d")).alias("value"), F.count_distinct("week").alias("g"))
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = v.crossJoin(F.broadcast(v.agg(F.avg("value").alias("mean")))).join(brand, "l_partkey").withColumn("shrunk", R.shrunk(F.col("value"), F.col("g"), F.col("mean"), 4.0))
    q = s.groupBy("p_brand").agg(F.percentile("shrunk", 0.25).alias("repl"))
    return s.join(q, "p_brand").select("l_partkey", r((F.col("shrunk") - F.col("repl")) * F.col("g"), 4).alias("war"))


@query("M1_two_sided_ridge")
def two_sided_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.operators.context import two_sided as fit

    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("offense"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("defense"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(cust, "o_custkey")
    lines = ratio_events(spark, sf_dir).join(orders, "l_orderkey").join(supp, "l_suppkey").withColumn("y", F.col("n") / F.col("d"))
    out = fit(lines, "offense", "defense", "y", "d", 1000.0)
    return out.select(F.col("side").cast("long").alias("side"), r("off", 4).alias("off"), r("def", 4).alias("def"), r("base", 4).alias("base"))


@query("M16_softmax", "WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal / 1000 AS x FROM customer), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY c_nationkey)) AS e FROM s) SELECT c_custkey, round(e / sum(e) OVER (PARTITION BY c_nationkey), 6) AS p FROM e")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.operators.kernels import softmax as choose

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000).alias("x"))
    return choose(c, ["c_nationkey"], "x").select("c_custkey", r("p").alias("p"))


@query("X1_season_simulation")
def season_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.operators.simulate import season

    grid = matchup_grid(spark, sf_dir).toPandas().sort_values(["home", "away"])  # the square of a fixed table of nations
    grid["p"] = 0.5 + 0.012 * (grid["home"] % 7 - grid["away"] % 7)
    return season(spark, grid, draws=10_000)


@query("R5_hold_last_batch", """WITH q AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'), s AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT s.user_id, s.start, arg_max(q.value, struct_pack(a := q.ts, b := q.value)) AS price FROM s JOIN q ON q.user_id = s.user_id AND q.ts < s.start AND q.ts >= s.start - INTERVAL 86400 SECOND GROUP BY ALL""")
def hold_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.streaming.hold import hold_last_batch

    kind = F.when(F.col("event_type") == "view", "quote").when(F.col("event_type") == "purchase", "start")
    e = table(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind"), F.col("value").alias("price")).where("kind is not null")
    return hold_last_batch(e, "user_id", 86_400)


@query("R6_windowed_counts", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.streaming.hold import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "10 minutes").select("start", "event_type", "n", r("total").alias("total"))


@query("R3_emit_on_change", "WITH k AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id, event_type FROM k WHERE event_type IS DISTINCT FROM p")
def emit_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.streaming.hold import on_change

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return on_change(e, "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("R8_newer_only", "WITH a AS (SELECT o_custkey, o_orderdate AS u, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, (o_orderkey % 2 = 0) DESC, o_totalprice DESC) AS p FROM orders) SELECT o_custkey, u, v FROM a WHERE p = 1")
def newer_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.sources.tables import newer_only as merge

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("u"), F.col("o_totalprice").alias("v"))
    pick = lambda df: df.groupBy("o_custkey", "u").agg(F.max("v").alias("v"))
    return merge(pick(o.where("o_orderkey % 2 = 0")), pick(o.where("o_orderkey % 2 <> 0")), ["o_custkey"], "u")


@query("corr_guarded", "SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(r(guarded_corr("l_quantity", "l_extendedprice")).alias("r"))


for _more in (traits, builders, models):
    QUERIES.update(_more.QUERIES)
    SQL.update(_more.SQL)
