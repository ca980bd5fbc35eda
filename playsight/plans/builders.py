"""Queries of the feature builders, credit, selections and grades, over lineitems as plays and orders as games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from playsight.functions.nulls import is_true
from playsight.operators import credit as C
from playsight.operators import features as B
from playsight.operators import rating as G
from playsight.operators import selection as K
from playsight.operators import traits as T
from playsight.plans.bindings import EV, OF, PR, UD, offers, projections, table, user_days
from playsight.plans.traits import COLUMNS

QUERIES: dict = {}
SQL: dict[str, str] = {}

_T, _O = COLUMNS["team"], COLUMNS["opponent"]
EXTRA = {
    "drive": "l_orderkey", "ord": "l_orderkey * 10000000000 + cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000",
    "margin": "case when l_partkey % 10 <> 0 then cast(l_partkey % 60 - 30 as int) end", "scored": "case when l_partkey % 17 = 0 then 7 when l_linenumber = 6 and l_linestatus = 'O' then 3 else 0 end",
    "qb_epa": "case when l_partkey % 5 <> 0 then (floor(l_quantity) - 14) * cast(0.125 as double) end", "adj_epa": "case when l_orderkey % 3 <> 0 then (floor(l_quantity) - 17) * cast(0.125 as double) end",
    "match": f"cast({COLUMNS['week']} as bigint) * 16 + least({_T}, {_O}) * 4 + greatest({_T}, {_O})",
    "tackler": f"case when l_orderkey % 2 = 0 then cast({_O} * 100 + 70 + l_partkey % 11 as bigint) end", "forcer": f"case when l_partkey % 29 = 0 then cast({_O} * 100 + 70 + l_orderkey % 7 as bigint) end",
    "sacker": f"case when l_linenumber <= 3 and l_returnflag = 'R' and l_orderkey % 3 = 0 then cast({_O} * 100 + 70 + l_orderkey % 11 as bigint) end",
}
PL = f"pl AS (SELECT {', '.join(f'{e} AS {c}' for c, e in {**COLUMNS, **EXTRA}.items())} FROM lineitem)"
#: One row a play: lineitems repeat (order, line, part, supplier).
P1 = f"{PL}, p1 AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY ord ORDER BY epa, yac, complete, made, tackle, sack, week, tfl) = 1)"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def r(c, digits: int = 5):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in {**COLUMNS, **EXTRA}.items()])


def single_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("ord").orderBy("epa", "yac", "complete", "made", "tackle", "sack", "week", "tfl")
    return plays(spark, sf_dir).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_COMP = "(margin IS NULL OR abs(margin) <= CASE least(qtr, 4) WHEN 1 THEN 28 WHEN 2 THEN 21 WHEN 3 THEN 16 ELSE 14 END)"
_TG = f"""{PL}, f AS (SELECT game, drive, arg_min({_COMP}, ord) FILTER (kind IN ('pass', 'run')) AS keep FROM pl GROUP BY ALL),
tg AS (SELECT game, week, team, opponent, coalesce(sum(epa) FILTER (kind IN ('pass', 'run')), 0) AS epa, count(*) FILTER (kind IN ('pass', 'run')) AS plays, count(DISTINCT drive) FILTER (kind IN ('pass', 'run')) AS drives,
  count(DISTINCT drive) FILTER (kind IN ('pass', 'run') AND keep) AS competitive_drives, coalesce(sum(scored) FILTER (keep), 0)::DOUBLE AS competitive_points FROM pl JOIN f USING (game, drive) GROUP BY ALL)"""


@query("A1_team_games", f"WITH {_TG} SELECT * FROM tg")
def team_games(spark, sf_dir):
    return B.team_games(plays(spark, sf_dir))


@query("A2_last_week", f"WITH {PL} SELECT season, max(week) AS last FROM pl GROUP BY season")
def last_week(spark, sf_dir):
    return plays(spark, sf_dir).groupBy("season").agg(F.max("week").alias("last"))


@query("A3_passer_games", f"""WITH {PL}, d AS (SELECT * FROM pl WHERE kind = 'pass'), f AS (SELECT game, team, arg_min(passer, ord) AS first FROM d GROUP BY ALL)
SELECT game, team, passer, count(*) AS dropbacks, sum(epa) AS epa, passer = first AS started FROM d JOIN f USING (game, team) GROUP BY ALL""")
def passer_games(spark, sf_dir):
    return B.passer_games(plays(spark, sf_dir))


@query("A4_passer_context", f"""WITH {PL} SELECT game, team, CASE WHEN scramble = 1 THEN coalesce(rusher, passer) ELSE passer END AS athlete, count(*) AS dropbacks, sum(coalesce(qb_epa, epa)) AS epa, count(*) FILTER (sack = 1 OR hit = 1) AS pressures
FROM pl WHERE kind = 'pass' OR scramble = 1 GROUP BY ALL""")
def passer_context(spark, sf_dir):
    return B.passer_context(plays(spark, sf_dir))


_UC = f"""{PL}, uc AS (SELECT match, team, coalesce(sum(epa) FILTER (kind = 'run'), 0) AS rush_epa, coalesce(sum(epa) FILTER (kind = 'pass'), 0) AS pass_epa, coalesce(sum(epa) FILTER (kind = 'pass' AND (sack = 1 OR hit = 1)), 0) AS protection_epa,
  coalesce(sum(epa) FILTER (special = 1), 0) AS special_epa, round(coalesce(sum(CASE WHEN yards < 0 THEN 1.2 * yards WHEN yards <= 4 THEN yards WHEN yards <= 10 THEN 4 + 0.5 * (yards - 4) ELSE 7 END) FILTER (kind = 'run'), 0), 4) AS line_yards,
  count(*) FILTER (kind = 'run') AS carries, count(*) FILTER (kind = 'pass') AS dropbacks, count(*) FILTER (kind = 'pass' AND (sack = 1 OR hit = 1)) AS pressures FROM pl GROUP BY ALL)"""


@query("A5_unit_channels", f"WITH {_UC} SELECT * FROM uc")
def unit_channels(spark, sf_dir):
    return B.unit_channels(plays(spark, sf_dir), ["match", "team"]).withColumn("line_yards", r("line_yards", 4))


@query("J2_two_sided", f"WITH {_UC} SELECT a.match, a.team AS home_team, a.rush_epa AS home_rush_epa, a.carries AS home_carries, b.team AS away_team, b.rush_epa AS away_rush_epa, b.carries AS away_carries FROM uc a JOIN uc b ON a.match = b.match AND a.team < b.team")
def two_sided(spark, sf_dir):
    return B.two_sided(B.unit_channels(plays(spark, sf_dir), ["match", "team"]), "match", "team", ["rush_epa", "carries"])


@query("J21_opponents", f"WITH {PL}, s AS (SELECT DISTINCT match, team FROM pl) SELECT a.match, a.team, b.team AS opponent FROM s a JOIN s b ON a.match = b.match AND a.team <> b.team")
def opponents(spark, sf_dir):
    return B.opponents(plays(spark, sf_dir), "match", "team")


@query("A6_expectation_tables", f"""WITH {PL}, b AS (SELECT season, kind, down, {T.distance_bucket()} AS togo_bucket, sum(success) AS s, count(*) AS c FROM pl WHERE kind IN ('pass', 'run') GROUP BY ALL)
SELECT season, kind, down, togo_bucket, round(sum(s) OVER w / nullif(sum(c) OVER w, 0), 6) AS expected FROM b WINDOW w AS (PARTITION BY kind, down, togo_bucket ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expectation_tables(spark, sf_dir):
    rows = T.prior_season_means(plays(spark, sf_dir).where("kind in ('pass', 'run')"), [F.col("kind"), F.col("down"), F.expr(T.distance_bucket())], {"expected": "success"})
    return rows.select("season", F.col("_b0").alias("kind"), F.col("_b1").alias("down"), F.col("_b2").alias("togo_bucket"), r("expected", 6).alias("expected"))


@query("P4_line_yards", f"WITH {PL} SELECT team, week, round(avg(CASE WHEN yards < 0 THEN 1.2 * yards WHEN yards <= 4 THEN yards WHEN yards <= 10 THEN 4 + 0.5 * (yards - 4) ELSE 7 END), 6) AS credited, count(*) FILTER (yards < 0) AS losses FROM pl GROUP BY ALL")
def line_yards(spark, sf_dir):
    return plays(spark, sf_dir).groupBy("team", "week").agg(r(F.avg(B.line_yards()), 6).alias("credited"), F.count_if(F.col("yards") < 0).alias("losses"))


@query("P3_P5_situations", f"""WITH {PL} SELECT team, count(*) FILTER (kind IN ('pass', 'run')) AS scrimmage, count(*) FILTER (down >= 3) AS late, count(*) FILTER (togo <= 2 AND down >= 3) AS short, count(*) FILTER (half_left <= 120 AND qtr IN (2, 4)) AS two_minute,
count(DISTINCT CAST(game AS VARCHAR) || ':' || CAST(ord AS VARCHAR)) AS keys FROM pl GROUP BY team""")
def situations(spark, sf_dir):
    return plays(spark, sf_dir).groupBy("team").agg(F.count_if(B.scrimmage()).alias("scrimmage"), F.count_if(B.late_down()).alias("late"), F.count_if(B.short_yardage()).alias("short"), F.count_if(B.two_minute()).alias("two_minute"), F.count_distinct(B.play_key("game", "ord")).alias("keys"))


_OS = f"""{P1}, os AS (SELECT ord, u.athlete AS athlete, u.role AS role, u.share AS share FROM (SELECT ord, unnest(CASE
  WHEN fumble = 1 AND kind = 'run' THEN [{{'role': 'rusher', 'athlete': rusher, 'share': 1.0::DOUBLE}}]
  WHEN fumble = 1 AND kind = 'pass' THEN [{{'role': CASE WHEN sack = 1 OR receiver IS NULL THEN 'passer' ELSE 'receiver' END, 'athlete': CASE WHEN sack = 1 OR receiver IS NULL THEN passer ELSE receiver END, 'share': 1.0::DOUBLE}}]
  WHEN kind = 'run' THEN [{{'role': 'rusher', 'athlete': rusher, 'share': 1.0::DOUBLE}}]
  WHEN kind = 'pass' AND (receiver IS NULL OR sack = 1 OR interception = 1) THEN [{{'role': 'passer', 'athlete': passer, 'share': 1.0::DOUBLE}}]
  WHEN kind = 'pass' THEN [{{'role': 'passer', 'athlete': passer, 'share': 0.5::DOUBLE}}, {{'role': 'receiver', 'athlete': receiver, 'share': 0.5::DOUBLE}}] END) AS u FROM p1))"""


@query("A11_offensive_shares", f"WITH {_OS} SELECT athlete, role, count(*) AS plays, sum(share) AS share FROM os GROUP BY ALL")
def offensive_shares(spark, sf_dir):
    return C.offensive_shares(single_plays(spark, sf_dir)).groupBy("athlete", "role").agg(F.count(F.lit(1)).alias("plays"), F.sum("share").alias("share"))


@query("A13_credit_value", f"WITH {_OS} SELECT athlete, round(sum(coalesce(adj_epa, epa) * share), 5) AS value, round(sum(wpa), 5) AS wpa FROM os JOIN p1 USING (ord) GROUP BY athlete")
def credit_value(spark, sf_dir):
    p = single_plays(spark, sf_dir)
    return C.valued(C.offensive_shares(p), p, 1).groupBy("athlete").agg(r(F.sum("value")).alias("value"), r(F.sum("wpa")).alias("wpa"))


_DS = f"""{P1}, tg AS (SELECT ord, sacker AS athlete, 0 AS k FROM p1 WHERE sacker IS NOT NULL UNION ALL SELECT ord, forcer, 1 FROM p1 WHERE forcer IS NOT NULL UNION ALL SELECT ord, tackler, 2 FROM p1 WHERE tackler IS NOT NULL AND epa < 0),
o AS (SELECT ord, athlete, min(k) AS k FROM tg GROUP BY ALL), ds AS (SELECT ord, athlete, CASE k WHEN 0 THEN 'sack' WHEN 1 THEN 'forced' ELSE 'tackle' END AS role, (CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.5 END)::DOUBLE / count(*) OVER (PARTITION BY ord) AS share FROM o)"""
_TAGS = {"sack": (["sacker"], 1.0), "forced": (["forcer"], 0.75), "tackle": (["tackler"], 0.5)}


@query("A12_defensive_shares", f"WITH {_DS} SELECT athlete, role, count(*) AS plays, round(sum(share), 5) AS share FROM ds GROUP BY ALL")
def defensive_shares(spark, sf_dir):
    out = C.defensive_shares(single_plays(spark, sf_dir), _TAGS, only_lost=("tackle",))
    return out.groupBy("athlete", "role").agg(F.count(F.lit(1)).alias("plays"), r(F.sum("share")).alias("share"))


@query("A14_simple_credit", f"WITH {_DS} SELECT athlete, round(sum(-epa * share), 5) AS value, count(DISTINCT week) AS games FROM ds JOIN p1 USING (ord) GROUP BY athlete")
def simple_credit(spark, sf_dir):
    p = single_plays(spark, sf_dir)
    shares = C.defensive_shares(p, _TAGS, only_lost=("tackle",))
    return shares.join(p.select("ord", "epa", "week"), "ord").groupBy("athlete").agg(r(F.sum(-F.col("epa") * F.col("share"))).alias("value"), F.count_distinct("week").alias("games"))


@query("A15_box_totals", f"""WITH {PL}, n AS (SELECT *, sum(solo) OVER w AS ns, sum(tfl) OVER w AS nt FROM pl WHERE defender IS NOT NULL WINDOW w AS (PARTITION BY drive))
SELECT game, defender, round(sum(CASE WHEN solo > 0 THEN solo / nullif(ns, 0) END), 5) AS solo_shared, round(sum(CASE WHEN tfl > 0 THEN tfl / nullif(nt, 0) END), 5) AS tfl_shared, count(*) FILTER (solo > 0) AS solo_any, count(*) FILTER (tfl > 0) AS tfl_any FROM n GROUP BY ALL""")
def box_totals(spark, sf_dir):
    out = C.box(plays(spark, sf_dir).where("defender is not null"), ["game", "defender"], "drive", ["solo", "tfl"])
    return out.select("game", "defender", r("solo_shared").alias("solo_shared"), r("tfl_shared").alias("tfl_shared"), "solo_any", "tfl_any")


@query("A16_J8_defender_games", f"""WITH {PL}, a AS (SELECT defender, count(*) AS plays FROM pl WHERE defender IS NOT NULL GROUP BY ALL), b AS (SELECT sacker AS defender, sum(-wpa) AS sack_wpa FROM pl WHERE sacker IS NOT NULL GROUP BY ALL), c AS (SELECT tackler AS defender, count(*) AS stops FROM pl WHERE epa < 0 AND tackler IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.defender, b.defender, c.defender) AS defender, plays::DOUBLE AS plays, round(sack_wpa, 5) AS sack_wpa, stops::DOUBLE AS stops FROM a FULL JOIN b ON a.defender = b.defender FULL JOIN c ON coalesce(a.defender, b.defender) = c.defender""")
def defender_games(spark, sf_dir):
    p = plays(spark, sf_dir)
    a = p.where("defender is not null").groupBy("defender").agg(F.count(F.lit(1)).alias("v"))
    b = p.where("sacker is not null").groupBy(F.col("sacker").alias("defender")).agg(F.sum(-F.col("wpa")).alias("v"))
    c = p.where("epa < 0 and tackler is not null").groupBy(F.col("tackler").alias("defender")).agg(F.count(F.lit(1)).alias("v"))
    return B.aligned({"plays": (a, "v"), "sack_wpa": (b, "v"), "stops": (c, "v")}, "defender").withColumn("sack_wpa", r("sack_wpa"))


@query("A17_season_lines", f"""WITH {PL} SELECT season, passer AS athlete, array_to_string([count(*), count(*) FILTER (complete = 1), count(*) FILTER (interception = 1), count(*) FILTER (sack = 1), CAST(sum(yards) AS BIGINT)], ',') AS line FROM pl WHERE passer IS NOT NULL GROUP BY ALL""")
def season_lines(spark, sf_dir):
    n = F.count(F.lit(1))
    line = F.array(n, F.count_if(F.col("complete") == 1), F.count_if(F.col("interception") == 1), F.count_if(F.col("sack") == 1), F.sum("yards").cast("long"))
    return plays(spark, sf_dir).where("passer is not null").groupBy("season", F.col("passer").alias("athlete")).agg(F.array_join(line.cast("array<string>"), ",").alias("line"))


@query("A19_J17_through_week", f"""WITH {PL}, k AS (SELECT season, passer, week, sum(cpoe) AS v FROM pl WHERE passer IS NOT NULL GROUP BY ALL)
SELECT season, passer, week, round(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS through, round(sum(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4) AS after FROM k WINDOW w AS (PARTITION BY season, passer ORDER BY week)""")
def through_week(spark, sf_dir):
    out = B.through_week(plays(spark, sf_dir).where("passer is not null"), ["season", "passer"], "week", "cpoe")
    return out.select("season", "passer", "week", r("through", 4).alias("through"), r("after", 4).alias("after"))


@query("A21_participation", f"""WITH {PL}, m AS (SELECT team, max(week) AS last FROM pl WHERE receiver IS NOT NULL GROUP BY ALL), o AS (SELECT team, receiver, sum(pow(0.5, (last - week) / 6.0)) AS w FROM pl JOIN m USING (team) WHERE receiver IS NOT NULL GROUP BY ALL)
SELECT team, receiver, round(w / sum(w) OVER (PARTITION BY team), 6) AS share FROM o""")
def participation(spark, sf_dir):
    return B.participation_share(plays(spark, sf_dir).where("receiver is not null"), "team", "receiver", "week").withColumn("share", r("share", 6))


@query("A34_grading_counts", f"WITH {PR} SELECT season, count(*) AS games, count(*) FILTER (sign(pure) = sign(actual)) AS right_side, count(*) FILTER (actual = 0) AS ties, count(*) FILTER (market IS NULL) AS unpriced FROM pr GROUP BY season")
def grading_counts(spark, sf_dir):
    return projections(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.signum("pure") == F.signum("actual")).alias("right_side"), F.count_if(F.col("actual") == 0).alias("ties"), F.count_if(F.col("market").isNull()).alias("unpriced"))


@query("A37_dominant_group", f"WITH {PL}, v AS (SELECT defender, kind, sum(1 + tfl) AS votes FROM pl WHERE defender IS NOT NULL GROUP BY ALL) SELECT defender, kind, CAST(votes AS BIGINT) AS votes FROM v QUALIFY row_number() OVER (PARTITION BY defender ORDER BY votes DESC, kind) = 1")
def dominant_group(spark, sf_dir):
    v = plays(spark, sf_dir).where("defender is not null").groupBy("defender", "kind").agg(F.sum(1 + F.col("tfl")).alias("votes"))
    return v.groupBy("defender").agg(F.min(F.struct((-F.col("votes")).alias("n"), "kind")).alias("x")).select("defender", "x.kind", (-F.col("x.n")).alias("votes"))


@query("A38_award_priors", f"WITH {PR} SELECT home, count(*) AS games, round((count(*) FILTER (actual > 0) + 4.0) / (count(*) + 8.0), 6) AS win_rate FROM pr GROUP BY home")
def award_priors(spark, sf_dir):
    return projections(spark, sf_dir).groupBy("home").agg(F.count(F.lit(1)).alias("games"), r((F.count_if(F.col("actual") > 0) + 4.0) / (F.count(F.lit(1)) + 8.0), 6).alias("win_rate"))


_MV = f"""{PL}, mv AS (SELECT tackler AS athlete, season, arg_min(kind, ord) AS now, arg_max(kind, ord) AS fin FROM p1 WHERE tackler IS NOT NULL GROUP BY ALL)""".replace(f"{PL}", P1, 1)


@query("A39_Z12_movers", f"WITH {_MV} SELECT a.athlete, a.season, b.fin AS was, a.now FROM mv a JOIN mv b ON a.athlete = b.athlete AND a.season = b.season + 1 WHERE a.now <> b.fin")
def movers(spark, sf_dir):
    return B.moved(single_plays(spark, sf_dir).where("tackler is not null"), "tackler", "season", "ord", "kind").withColumnRenamed("tackler", "athlete")


@query("A41_contract_years", """WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, unnest(range(0, 1 + c_custkey % 4)) AS year FROM customer WHERE c_acctbal > 0), s AS (SELECT c_nationkey, list_sort(list(c_acctbal), 'DESC') AS v FROM customer GROUP BY ALL)
SELECT c_nationkey, count(*) AS seasons, round(sum(CAST(round(c_acctbal * 100) AS BIGINT) * (12 // (1 + year))) / 1200.0::DOUBLE, 3) AS paid, round(any_value(list_avg(v[1:10])), 4) AS top, round(any_value(list_avg(v[3:25])), 4) AS middle FROM c JOIN s USING (c_nationkey) GROUP BY c_nationkey""")
def contract_years(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    years = c.where("c_acctbal > 0").select("c_nationkey", "c_acctbal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 4)).alias("year"))
    # whole cents in twelfths (a contract has four years at most), so sums are exact
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    # only the 25 largest of a group matter, so ranks are taken by a bounded top list
    s = c.withColumn("k", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("k <= 25")
    s = s.groupBy("c_nationkey").agg(r(F.avg(F.when(F.col("k") <= 10, F.col("c_acctbal"))), 4).alias("top"), r(F.avg(F.when(F.col("k") >= 3, F.col("c_acctbal"))), 4).alias("middle"))
    return years.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("seasons"), r(F.sum(cents * F.expr("12 div (1 + year)")) / F.lit(1200.0), 3).alias("paid")).join(s, "c_nationkey")


@query("W13_reliability_curve", "SELECT p_partkey, round(CASE WHEN p_size < 8 THEN (p_size / 8.0 * 0.4) / (1 + (p_size / 8.0 - 1) * 0.4) WHEN p_size <= 20 THEN 0.4 + 0.2 * (p_size - 8) / 12.0 WHEN p_size <= 40 THEN 0.6 + 0.15 * (p_size - 20) / 20.0 ELSE 0.75 END, 6) AS reliability FROM part")
def reliability_curve(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(G.curve(F.col("p_size").cast("double"), [(8.0, 0.4), (20.0, 0.6), (40.0, 0.75)]), 6).alias("reliability"))


@query("W16_mixture_baseline", f"""WITH {PL}, q AS (SELECT team, passer, week, sum(epa) AS v, count(*) AS d FROM pl WHERE passer IS NOT NULL GROUP BY ALL), m AS (SELECT team, max(week) AS last FROM q GROUP BY ALL),
z AS (SELECT team, passer, sum(v * pow(0.5, (last - week) / 6.0)) AS s, sum(d * pow(0.5, (last - week) / 6.0)) AS w FROM q JOIN m USING (team) GROUP BY ALL) SELECT team, round(sum(w * (s / (w + 200.0) * 34)) / sum(w), 5) AS baseline FROM z GROUP BY team""")
def mixture_baseline(spark, sf_dir):
    q = plays(spark, sf_dir).where("passer is not null").groupBy("team", "passer", "week").agg(F.sum("epa").alias("v"), F.count(F.lit(1)).alias("d"))
    fade = F.pow(F.lit(0.5), (F.col("last") - F.col("week")) / 6.0)
    z = q.join(q.groupBy("team").agg(F.max("week").alias("last")), "team").groupBy("team", "passer").agg(F.sum(F.col("v") * fade).alias("s"), F.sum(F.col("d") * fade).alias("w"))
    return z.groupBy("team").agg(r(F.sum(F.col("w") * (F.col("s") / (F.col("w") + 200.0) * 34)) / F.sum("w")).alias("baseline"))


@query("W18_cap_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def cap_rank(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


@query("W20_snapshot_grid", f"""WITH {UD}, b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM ud GROUP BY ALL), g AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT user_id, day, last_value(ud.day IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS seen FROM (SELECT g.user_id, g.day, ud.day AS d2 FROM g LEFT JOIN ud ON ud.user_id = g.user_id AND ud.day = g.day) x LEFT JOIN ud USING (user_id, day)""".replace("last_value(ud.day IGNORE NULLS)", "last_value(d2 IGNORE NULLS)"))
def snapshot_grid(spark, sf_dir):
    ud = user_days(spark, sf_dir).select("user_id", "day")
    w = W.partitionBy("user_id").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    # the gaps are filled from each row to the next, so no grid is joined
    return ud.withColumn("to", until).select("user_id", F.col("day").alias("seen"), F.explode(F.sequence("day", "to")).alias("day"))


@query("K5_nulls_last", f"WITH {PR} SELECT game, row_number() OVER (PARTITION BY home ORDER BY market DESC NULLS LAST, game) AS place FROM pr")
def nulls_last(spark, sf_dir):
    return projections(spark, sf_dir).select("game", F.row_number().over(W.partitionBy("home").orderBy(F.col("market").desc_nulls_last(), "game")).cast("long").alias("place"))


@query("K6_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def paged(spark, sf_dir):
    return K.page(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 25, 3)


@query("K7_nearest", f"WITH {EV}, {OF} SELECT game, book, list_aggregate(list_transform([-7.0, -3.0, 0.0, 3.0, 7.0], lambda v: {{'d': abs(v - point), 'v': v}}), 'min').v::DOUBLE AS key_number FROM of")
def nearest(spark, sf_dir):
    return offers(spark, sf_dir).select("game", "book", K.nearest(F.array(*[F.lit(v) for v in (-7.0, -3.0, 0.0, 3.0, 7.0)]), F.col("point")).alias("key_number"))


@query("K8_final_week", f"WITH {PL} SELECT season, week, count(*) AS plays, sum(epa) AS epa FROM pl WHERE (season, week) IN (SELECT (season, max(week)) FROM pl GROUP BY season) GROUP BY ALL")
def final_week(spark, sf_dir):
    return K.final_week(plays(spark, sf_dir).groupBy("season", "week").agg(F.count(F.lit(1)).alias("plays"), F.sum("epa").alias("epa")), "season", "week")


@query("K9_next_week", """WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week, o_orderdate AS k, o_orderstatus = 'F' AS played FROM orders)
SELECT season, coalesce(arg_min(week, k) FILTER (NOT played AND k >= TIMESTAMP '1995-06-10 00:00:00'), max(week)) AS week FROM s GROUP BY season""")
def next_week(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_orderdate").alias("k"), (F.col("o_orderstatus") == "F").alias("played"))
    return K.next_week(s, "season", "week", "k", "played", "1995-06-10 00:00:00")


@query("K10_latest_model", "WITH v AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS c FROM lineitem WHERE year(l_shipdate) % 2 = 0), s AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS season FROM lineitem) SELECT season, (SELECT 'm' || max(c) FROM v WHERE c < season) AS version FROM s")
def latest_model(spark, sf_dir):
    years = plays(spark, sf_dir).select("season").distinct()
    versions = years.where("season % 2 = 0").select(F.col("season").alias("cutoff"), F.concat(F.lit("m"), F.col("season").cast("string")).alias("version"))
    return K.latest_before(versions, "cutoff", years, "season")


@query("J9_market_medians", f"WITH {EV}, {OF} SELECT game, quantile_cont(point, 0.5) FILTER (side = 'home') AS home, quantile_cont(point, 0.5) FILTER (side = 'away') AS away FROM of GROUP BY game")
def market_medians(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("game").agg(F.median(F.when(F.col("side") == "home", F.col("point"))).alias("home"), F.median(F.when(F.col("side") == "away", F.col("point"))).alias("away"))


@query("L4_teaser_legs", f"""WITH {EV}, {OF}, m AS (SELECT game, week, list_sort(list(point)) AS v FROM of WHERE point > 0 GROUP BY ALL), f AS (SELECT game, week, v[1 + (len(v) - 1) // 2] AS line FROM m QUALIFY row_number() OVER (PARTITION BY game ORDER BY week) = 1)
SELECT game, week, line, line + 6.0 AS teased FROM f WHERE line IN (1.5, 2.0, 2.5)""")
def teaser_legs(spark, sf_dir):
    return K.teaser_legs(offers(spark, sf_dir), "game", "week", "point")


@query("L5_closing_line", f"""WITH {EV}, {OF} SELECT game, arg_max(point, r) AS point, arg_max(book, r) AS book, quantile_cont(point, 0.5) AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY book = 7, week, book, point) AS r FROM of) GROUP BY game""")
def closing_line(spark, sf_dir):
    return K.closing_line(offers(spark, sf_dir), "game", "book", "week", "point", 7)


@query("P12_offer_validity", f"WITH {EV}, {OF} SELECT side, count(*) AS n, count(*) FILTER (abs(price) >= 100 AND point * 2 = floor(point * 2) AND side IN ('home', 'away')) AS spreads, count(*) FILTER (abs(price) >= 100 AND book % 3 = 0) AS h2h, CAST(0 AS BIGINT) AS totals FROM of GROUP BY side")
def offer_validity(spark, sf_dir):
    o = offers(spark, sf_dir)
    ok = lambda m, p: F.count_if(K.valid_offer(F.lit(m), F.col("side"), p, F.col("price")))
    return o.groupBy("side").agg(F.count(F.lit(1)).alias("n"), ok("spreads", F.col("point")).alias("spreads"), ok("h2h", F.when(F.col("book") % 3 != 0, F.col("point"))).alias("h2h"), ok("totals", F.col("point")).alias("totals"))


@query("P13_upcoming", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate <= TIMESTAMP '1995-06-01' + INTERVAL 1440 HOUR")
def upcoming(spark, sf_dir):
    now = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") != "F") & F.col("o_orderdate").between(now, now + F.expr("INTERVAL 1440 HOURS"))).select("o_orderkey")


@query("P18_at_cutoff", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 24 HOUR <= TIMESTAMP '1995-06-01' THEN o_totalprice END AS o_totalprice FROM orders")
def known_at(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return K.at_cutoff(o, "o_orderdate", F.lit("1995-06-01 00:00:00").cast("timestamp_ntz"), ["o_totalprice"]).drop("o_orderdate")


@query("R9_insert_ignore", """WITH n AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS value FROM events WHERE value >= 20 GROUP BY ALL) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.value < 2 AND o.user_id = n.user_id AND o.event_type = n.event_type)""")
def insert_ignored(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return K.insert_ignore(e.where("value < 2"), e.where("value >= 20"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("R7_late_writes", "SELECT o_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate AND l_shipdate >= o_orderdate - INTERVAL 600 DAY GROUP BY ALL")
def late_writes(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    kept = both.where((F.col("l_shipdate") < F.col("o_orderdate")) & (F.col("l_shipdate") >= F.col("o_orderdate") - F.expr("INTERVAL 600 DAYS")))
    return kept.groupBy("o_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("A28_prospective", """WITH f AS (SELECT user_id, ts, event_id, (value - floor(value / 100) * 100) / 100.0 AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events),
e AS (SELECT user_id, 'first' AS cohort, p, y FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 UNION ALL SELECT user_id, 'last', p, y FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT cohort, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS games, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM e GROUP BY ALL""")
def prospective(spark, sf_dir):
    p = (F.col("value") - F.floor(F.col("value") / 100) * 100) / 100.0
    f = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", p.alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    out = K.cohorts(f, "user_id", "ts", "event_id", "p", "y")
    return out.select("cohort", "bin", "games", r("predicted", 6).alias("predicted"), r("observed", 6).alias("observed"))


@query("F_root_finding", "SELECT p_partkey, round(p_size + 3.0 * ln((0.05 + 0.9 * (p_partkey % 97) / 97.0) / (0.95 - 0.9 * (p_partkey % 97) / 97.0)), 6) AS centre FROM part")
def root_finding(spark, sf_dir):
    target = 0.05 + 0.9 * (F.col("p_partkey") % 97) / 97.0
    m = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", r(K.bisect(lambda x: 1 / (1 + F.exp(-(x - m) / 3.0)), target, m - 60, m + 60), 6).alias("centre"))


@query("F_yard_line", f"WITH {PL} SELECT yardline, count(*) AS n, min(CASE WHEN yardline = 50 THEN 50 WHEN yardline < 50 THEN 100 - yardline ELSE yardline END) AS to_goal FROM pl GROUP BY yardline")
def yard_line(spark, sf_dir):
    # written as "T3 27": own half by the team's name, the other half by the opponent's
    side = F.when(F.col("yardline") < 50, F.concat(F.lit("T"), F.col("team").cast("string"))).otherwise(F.concat(F.lit("O"), F.col("team").cast("string")))
    text = F.when(F.col("yardline") == 50, F.lit("50")).when(F.col("yardline") < 50, F.concat_ws(" ", side, F.col("yardline").cast("string"))).otherwise(F.concat_ws(" ", side, (100 - F.col("yardline")).cast("string")))
    rows = plays(spark, sf_dir).withColumn("spot", text)
    own = F.split("spot", " ")[0] == F.concat(F.lit("T"), F.col("team").cast("string"))
    number = F.regexp_extract("spot", r"([0-9]+)$", 1).cast("int")
    goal = F.when(F.col("spot") == "50", 50).when(own, 100 - number).otherwise(number)
    return rows.groupBy("yardline").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("yardline") > 50, 100 - goal).otherwise(goal)).alias("to_goal"))


@query("M4_environment_pool", f"WITH {_TG} SELECT team, week, round((avg(epa) * count(*) + 1.5 * (64.0 * pow(0.5, (week % 12) / 6.0))) / (count(*) + 64.0 * pow(0.5, (week % 12) / 6.0)), 6) AS pooled FROM tg GROUP BY team, week")
def environment_pool(spark, sf_dir):
    tg = B.team_games(plays(spark, sf_dir)).groupBy("team", "week").agg(F.avg("epa").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    return tg.select("team", "week", r(G.pooled_environment(F.col("m"), F.col("n"), F.lit(1.5), F.col("week") % 12 + 1), 6).alias("pooled"))


@query("M12_shrunk_rate", f"WITH {PL}, a AS (SELECT receiver, count(*)::DOUBLE AS v, avg(epa) AS x, avg(l) AS e FROM (SELECT receiver, epa, (togo)::DOUBLE AS l FROM pl WHERE receiver IS NOT NULL) GROUP BY ALL) SELECT receiver, round((v * x + 2.0 + (e + 40.0 * 0.7 / 0.3) * 0.25) / (v + e + 40.0 * 0.7 / 0.3), 6) AS rate FROM a")
def shrunk_rates(spark, sf_dir):
    a = plays(spark, sf_dir).where("receiver is not null").groupBy("receiver").agg(F.count(F.lit(1)).cast("double").alias("v"), F.avg("epa").alias("x"), F.avg(F.col("togo").cast("double")).alias("e"))
    from playsight.operators.ratio import shrinkage_constant

    k = shrinkage_constant(F.lit(0.3), F.lit(40.0))
    return a.select("receiver", r(G.shrunk_rate(F.col("v"), F.col("x"), F.col("e"), F.lit(2.0), F.lit(0.25), k), 6).alias("rate"))


@query("M11_composite_grade", f"""WITH {PL}, q AS (SELECT defender, count(DISTINCT week)::DOUBLE AS games, CASE WHEN sum(tfl) > 0 THEN (avg(tfl) - 0.1) * 20 END AS za, CASE WHEN sum(sack) > 1 THEN (avg(sack) - 0.03) * 30 END AS zb, avg(epa) AS zc FROM pl WHERE defender IS NOT NULL GROUP BY defender),
g AS (SELECT defender, games, unnest([{{'trait': 'a', 'z': za}}, {{'trait': 'b', 'z': zb}}, {{'trait': 'c', 'z': zc}}]) AS t FROM q),
s AS (SELECT defender, max(games) AS g, sum(CASE t.trait WHEN 'a' THEN 2.0 WHEN 'b' THEN 1.0 ELSE -0.5 END * coalesce(t.z, 0)) AS s, coalesce(sum(CASE t.trait WHEN 'a' THEN 2.0 WHEN 'b' THEN 1.0 ELSE 0.5 END) FILTER (t.z IS NOT NULL), 0) AS c, bool_or(t.trait = 'a' AND t.z IS NOT NULL) AS main FROM g GROUP BY ALL)
SELECT defender, round(s / 3.5 * g / (g + 8.0), 5) AS composite, round(c / 3.5, 5) AS coverage, round(CASE WHEN c / 3.5 >= 0.6 AND main THEN greatest(20.0, least(80.0, 50 + 10 * (s / 3.5 * g / (g + 8.0)))) END, 4) AS grade FROM s""")
def composite_grade(spark, sf_dir):
    a = plays(spark, sf_dir).where("defender is not null").groupBy("defender").agg(F.count_distinct("week").cast("double").alias("games"), F.sum("tfl").alias("nt"), F.avg("tfl").alias("mt"), F.sum("sack").alias("ns"), F.avg("sack").alias("ms"), F.avg("epa").alias("me"))
    z = [F.struct(F.lit("a").alias("trait"), F.when(F.col("nt") > 0, (F.col("mt") - 0.1) * 20).alias("z")), F.struct(F.lit("b").alias("trait"), F.when(F.col("ns") > 1, (F.col("ms") - 0.03) * 30).alias("z")), F.struct(F.lit("c").alias("trait"), F.col("me").alias("z"))]
    rows = a.select("defender", "games", F.explode(F.array(*z)).alias("t")).select("defender", "games", "t.trait", "t.z")
    out = G.composite(rows, ["defender"], "trait", {"a": 2.0, "b": 1.0, "c": -0.5}, "games", 8.0, primary="a")
    return out.select("defender", r("composite").alias("composite"), r("coverage").alias("coverage"), r("grade", 4).alias("grade"))


@query("M17_tree_ensemble", "SELECT p_partkey, round(1 / (1 + exp(-(0.1 + CASE WHEN p_size < 20 THEN CASE WHEN p_retailprice < 1000 THEN 0.3 ELSE -0.2 END ELSE 0.5 END + CASE WHEN coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END < 25, false) THEN -0.4 ELSE 0.25 END))), 6) AS p FROM part")
def tree_ensemble(spark, sf_dir):
    one = {"on": "p_size", "at": 20, "missing": "left", "left": {"on": "p_retailprice", "at": 1000, "missing": "left", "left": {"leaf": 0.3}, "right": {"leaf": -0.2}}, "right": {"leaf": 0.5}}
    two = {"on": "gap", "at": 25, "missing": "right", "left": {"leaf": -0.4}, "right": {"leaf": 0.25}}
    rows = table(spark, sf_dir, "part").withColumn("gap", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    return rows.select("p_partkey", r(G.ensemble([one, two], 0.1), 6).alias("p"))


@query("M18_layered", f"""WITH {PR}, a AS (SELECT game, market, total / 2 + pure / 2 AS h0, total / 2 - pure / 2 AS a0 FROM pr), b AS (SELECT game, market, greatest(0.0, h0 + 1.5) AS h, greatest(0.0, a0 - 0.5) AS a FROM a),
c AS (SELECT *, greatest(-h, least(a, (coalesce(market, h - a) - (h - a)) * 0.5 / 2)) AS s FROM b) SELECT game, round(h + s, 5) AS home, round(a - s, 5) AS away FROM c""")
def layered(spark, sf_dir):
    p = projections(spark, sf_dir)
    home, away = G.layered(F.col("total") / 2 + F.col("pure") / 2, F.col("total") / 2 - F.col("pure") / 2, [(F.lit(1.5), F.lit(-0.5))], F.col("market"), 0.6)
    return p.select("game", r(home).alias("home"), r(away).alias("away"))


@query("Z17_over_replacement", f"""WITH {PL}, s AS (SELECT season, avg(epa) AS pooled FROM pl WHERE receiver IS NOT NULL GROUP BY ALL), t AS (SELECT season, receiver, count(*) AS touches FROM pl WHERE receiver IS NOT NULL GROUP BY ALL)
SELECT season, receiver, round(touches * (pooled - 0.0289), 5) AS over FROM t JOIN s USING (season)""")
def over_replacement(spark, sf_dir):
    t = plays(spark, sf_dir).where("receiver is not null").groupBy("season", "receiver").agg(F.count(F.lit(1)).alias("touches"), F.sum("epa").alias("epa"))
    s = t.groupBy("season").agg((F.sum("epa") / F.sum("touches")).alias("pooled"))
    return t.join(s, "season").select("season", "receiver", r(F.col("touches") * (F.col("pooled") - 0.0289)).alias("over"))


@query("Z16_biography", "SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) < 9 OR (month(o_orderdate) = 9 AND day(o_orderdate) = 1) THEN 2020 - year(o_orderdate) ELSE 2019 - year(o_orderdate) END AS INTEGER) AS age, coalesce(CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 250 END, 262) AS pick FROM orders")
def biography(spark, sf_dir):
    late = (F.month("o_orderdate") > 9) | ((F.month("o_orderdate") == 9) & (F.dayofmonth("o_orderdate") > 1))
    pick = F.coalesce(F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 250), F.lit(262).cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (2020 - F.year("o_orderdate") - is_true(late).cast("int")).alias("age"), pick.alias("pick"))


@query("Z9_registered_traits", f"WITH {PL}, t AS (SELECT DISTINCT kicker, kind FROM pl WHERE kicker IS NOT NULL), g AS (SELECT 'field_goal' AS kind, 96 AS place UNION ALL SELECT 'punt', 97) SELECT kicker, kind FROM t WHERE EXISTS (SELECT 1 FROM g WHERE g.kind = t.kind AND g.place = t.kicker % 100)")
def registered(spark, sf_dir):
    t = plays(spark, sf_dir).where("kicker is not null").select("kicker", "kind").distinct()
    g = spark.createDataFrame([("field_goal", 96), ("punt", 97)], "kind string, place long")
    return t.withColumn("place", F.col("kicker") % 100).join(F.broadcast(g), ["kind", "place"], "left_semi").select("kicker", "kind")
