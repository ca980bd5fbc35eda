"""Trait queries: lineitems stand for plays, and each role's registered traits are computed from them.

The SQL is written by hand, trait by trait, from the definitions: it shares the columns that stand for a play's
with the operators, but none of their expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playsight.operators import traits as T
from playsight.plans.bindings import table

_TEAM, _MONTH = "(l_suppkey % 4)", "(year(l_shipdate) * 12 + month(l_shipdate))"
_OTHER = "((l_suppkey % 4 + 1 + l_orderkey % 3) % 4)"
_FLAG = "case when {} then 1 else 0 end"
#: Column of a play -> expression over lineitem, in both dialects.
COLUMNS = {
    "season": "cast(year(l_shipdate) as int)", "week": f"cast({_MONTH} as int)", "game": f"cast({_MONTH} * 16 + {_TEAM} * 4 + {_OTHER} as bigint)",
    "team": f"cast({_TEAM} as bigint)", "opponent": f"cast({_OTHER} as bigint)",
    "kind": "case when l_linenumber <= 3 then 'pass' when l_linenumber <= 5 then 'run' when l_linenumber = 6 then 'field_goal' else 'punt' end",
    "qtr": "cast(1 + l_orderkey % 4 as int)", "down": "cast(1 + (l_orderkey + l_linenumber) % 4 as int)", "togo": "cast(1 + l_partkey % 14 as int)", "yardline": "cast(1 + l_partkey % 99 as int)",
    "yards": "cast(floor(l_quantity) as int) - 12", "epa": "(floor(l_quantity) - 16) * cast(0.125 as double)", "wpa": "(floor(l_quantity) - 16) * cast(0.0078125 as double)", "success": _FLAG.format("l_quantity > 16"),
    "cpoe": "case when l_linenumber <= 3 and l_orderkey % 5 <> 0 then cast(l_partkey % 41 - 20 as double) end", "complete": _FLAG.format("l_returnflag <> 'R'"),
    "interception": _FLAG.format("l_linenumber <= 3 and l_partkey % 37 = 0"), "sack": _FLAG.format("l_linenumber <= 3 and l_returnflag = 'R' and l_orderkey % 3 = 0"), "hit": _FLAG.format("l_linenumber <= 3 and l_partkey % 6 = 0"),
    "scramble": _FLAG.format("l_linenumber <= 3 and l_partkey % 11 = 0"), "special": _FLAG.format("l_linenumber >= 6"), "fumble": _FLAG.format("l_partkey % 23 = 0"), "half_left": "cast((l_orderkey * 7) % 1800 as int)",
    "passer": f"case when l_linenumber <= 3 then cast({_TEAM} * 100 + 20 + l_partkey % 3 as bigint) end", "receiver": f"case when l_linenumber <= 3 then cast({_TEAM} * 100 + l_partkey % 7 as bigint) end",
    "rusher": f"case when l_linenumber in (4, 5) then cast({_TEAM} * 100 + case when l_partkey % 5 = 4 then 20 + l_partkey % 3 else 50 + l_partkey % 3 end as bigint) end", "defender": f"case when l_partkey % 3 <> 0 then cast({_OTHER} * 100 + 70 + l_orderkey % 11 as bigint) end",
    "kicker": f"case when l_linenumber >= 6 then cast({_TEAM} * 100 + 90 + l_linenumber as bigint) end", "air": "cast(l_partkey % 30 as double)", "yac": "cast(floor(l_quantity) - 20 as double)",
    "xyac": "case when l_orderkey % 4 <> 0 then cast(l_partkey % 9 as double) end", "made": _FLAG.format("l_linestatus = 'O'"), "distance": "cast(20 + l_partkey % 40 as int)",
    "tackle": _FLAG.format("l_orderkey % 2 = 0"), "solo": _FLAG.format("l_orderkey % 4 = 0"), "tfl": _FLAG.format("l_quantity < 6"), "forced": _FLAG.format("l_partkey % 29 = 0"), "defended": _FLAG.format("l_partkey % 13 = 0"),
    "adj_epa": "case when l_orderkey % 3 <> 0 then (floor(l_quantity) - 17) * cast(0.125 as double) end", "quarter_left": "cast((l_orderkey * 7) % 900 as int)", "fumble_lost": _FLAG.format("l_partkey % 23 = 0 and l_orderkey % 2 = 0"),
    "fumbler": f"case when l_partkey % 23 = 0 then cast({_TEAM} * 100 + case when l_linenumber <= 3 then case when l_orderkey % 3 = 0 then l_partkey % 7 else 20 + l_partkey % 3 end else 50 + l_partkey % 3 end as bigint) end",
    "return_yards": "case when l_linenumber = 7 then cast(l_partkey % 25 as double) end", "return_touchdown": _FLAG.format("l_linenumber = 7 and l_partkey % 31 = 0"), "return_fumble": _FLAG.format("l_linenumber = 7 and l_partkey % 19 = 0"),
}

#: Who of a team plays what, by the last two digits of an id.
_GROUP = "case when k <= 2 then 'WR' when k <= 4 then 'TE' when k <= 6 then 'RB' when k between 20 and 22 then 'QB' when k between 50 and 52 then 'RB' when k between 70 and 73 then 'DL' when k between 74 and 76 then 'LB' when k between 77 and 80 then 'DB' when k = 96 then 'K' when k = 97 then 'P' end"

_SQL = f"""pl AS (SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())} FROM lineitem),
po AS (SELECT season, CAST(t * 100 + k AS BIGINT) AS athlete, {_GROUP} AS grp FROM (SELECT DISTINCT season FROM pl), range(0, 4) a(t), range(0, 98) b(k) WHERE grp IS NOT NULL),
pr AS (SELECT season, week, game, opponent AS team, team AS opponent, CAST(opponent * 100 + k AS BIGINT) AS athlete FROM (SELECT DISTINCT season, week, game, team, opponent FROM pl), range(70, 81) b(k) WHERE (game * 7 + k) % 6 <> 0
  UNION SELECT season, week, game, opponent, team, defender FROM pl WHERE defender IS NOT NULL),
pb AS (SELECT *, CASE WHEN togo < 3 THEN 1 WHEN togo < 7 THEN 2 WHEN togo < 11 THEN 3 ELSE 4 END AS tb FROM pl),
e1 AS (SELECT season, kind, down, tb, sum(s) OVER w / sum(c) OVER w AS es, sum(y) OVER w / sum(c) OVER w AS ey FROM (SELECT season, kind, down, tb, sum(success) AS s, sum(yards) AS y, count(*) AS c FROM pb WHERE kind IN ('pass', 'run') GROUP BY ALL) WINDOW w AS (PARTITION BY kind, down, tb ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e2 AS (SELECT season, kind, sum(s) OVER w / sum(c) OVER w AS as_, sum(y) OVER w / sum(c) OVER w AS ay FROM (SELECT season, kind, sum(success) AS s, sum(yards) AS y, count(*) AS c FROM pb WHERE kind IN ('pass', 'run') GROUP BY ALL) WINDOW w AS (PARTITION BY kind ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e3 AS (SELECT season, db, sum(m) OVER w / sum(c) OVER w AS em FROM (SELECT season, distance // 5 AS db, sum(made) AS m, count(*) AS c FROM pb WHERE kind = 'field_goal' GROUP BY ALL) WINDOW w AS (PARTITION BY db ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT pb.*, coalesce(es, as_) AS exp_success, coalesce(ey, ay) AS exp_yards, em, fumble_lost = 1 AND fumbler IS NOT NULL AS lost, receiver IS NOT NULL AND interception = 0 AS thrown, coalesce(adj_epa, epa) AS worth
  FROM pb LEFT JOIN e1 ON e1.season = pb.season AND e1.kind = pb.kind AND e1.down = pb.down AND e1.tb = pb.tb LEFT JOIN e2 ON e2.season = pb.season AND e2.kind = pb.kind LEFT JOIN e3 ON e3.season = pb.season AND e3.db = pb.distance // 5),
drop_back AS (SELECT *, passer AS athlete, CASE WHEN thrown THEN worth / 2 ELSE worth END AS val FROM x WHERE kind = 'pass' AND passer IS NOT NULL AND NOT lost),
target AS (SELECT *, receiver AS athlete, worth / 2 AS val FROM x WHERE kind = 'pass' AND thrown AND NOT lost),
rush AS (SELECT *, rusher AS athlete, worth AS val FROM x WHERE kind = 'run' AND rusher IS NOT NULL AND NOT lost),
loss AS (SELECT *, fumbler AS athlete, worth AS val FROM x WHERE kind IN ('pass', 'run') AND lost),
drop_ AS (SELECT *, fumbler AS athlete FROM x WHERE kind IN ('pass', 'run') AND fumble = 1 AND fumbler IS NOT NULL),
dg AS (SELECT season, game, opponent AS team, defender AS athlete, sum(tfl)::DOUBLE AS tfl, sum(forced)::DOUBLE AS ff, sum(defended)::DOUBLE AS pd, sum(interception)::DOUBLE AS picks, sum(sack)::DOUBLE AS sacks, sum(hit)::DOUBLE AS hits, sum(solo)::DOUBLE AS solo, sum(tackle)::DOUBLE AS tackles,
  coalesce(sum(abs(wpa)) FILTER (sack = 1), 0) AS sack_wpa, (count(*) FILTER (kind IN ('pass', 'run') AND epa < 0 AND tackle + tfl + sack > 0))::DOUBLE AS stops FROM pl WHERE defender IS NOT NULL GROUP BY ALL),
tt AS (SELECT season, game, team, sum(tackles) AS team_tackles FROM dg GROUP BY ALL),
price AS (SELECT w.season, w.week, quantile_cont(abs(s.wpa), 0.5) AS price FROM (SELECT DISTINCT season, week FROM pr) w JOIN pl s ON s.sack = 1 AND s.season = w.season AND s.week < w.week GROUP BY ALL),
d AS (SELECT pr.*, coalesce(tfl, 0) AS tfl, coalesce(ff, 0) AS ff, coalesce(pd, 0) AS pd, coalesce(picks, 0) AS picks, coalesce(sacks, 0) AS sacks, coalesce(hits, 0) AS hits, coalesce(solo, 0) AS solo, coalesce(tackles, 0) AS tackles, coalesce(sack_wpa, 0) AS sack_wpa, coalesce(stops, 0) AS stops, team_tackles, price
  FROM pr LEFT JOIN dg USING (season, game, team, athlete) LEFT JOIN tt USING (season, game, team) LEFT JOIN price USING (season, week)),
ug AS (SELECT season, week, game, opponent AS team, avg(epa) AS v, avg(epa) FILTER (kind = 'pass') AS pv FROM pl WHERE kind IN ('pass', 'run') GROUP BY ALL),
grid AS (SELECT m.season, m.athlete, u.week, u.v, u.pv, h.athlete IS NOT NULL AS here FROM (SELECT DISTINCT season, team, athlete FROM pr) m JOIN ug u USING (season, team) LEFT JOIN (SELECT DISTINCT season, game, team, athlete FROM pr) h ON h.season = m.season AND h.team = m.team AND h.athlete = m.athlete AND h.game = u.game)"""

_K = "season, week, game, team, opponent, athlete"


def _simple(rows: str, value: str, where: str = "true") -> str:
    return f"SELECT {_K}, sum({value})::DOUBLE AS n, count({value})::DOUBLE AS d FROM {rows} WHERE {where} GROUP BY ALL HAVING count({value}) > 0"


_LATE = "(down = 3 OR down = 4)"
_SHORT = f"(togo < 3 AND {_LATE} OR yardline < 4)"
_GAMES_D = "SELECT {k}, {n} AS n, {d} AS d FROM d".replace("{k}", _K)
#: Each trait's events by its definition, its groups, and whether it is opponent-adjusted.
DEFINED: dict[str, tuple[str, str, bool]] = {
    "epa.credit": (f"""SELECT {_K}, sum(c) AS n, 1.0 AS d FROM (SELECT {_K}, val AS c FROM drop_back UNION ALL SELECT {_K}, val FROM target UNION ALL SELECT {_K}, val FROM rush UNION ALL SELECT {_K}, val FROM loss
      UNION ALL SELECT season, week, game, opponent, team, defender, -worth * CASE WHEN sack = 1 THEN 0.96 WHEN interception = 1 THEN 1.48 WHEN forced = 1 THEN 1.08 WHEN defended = 1 THEN 1.9 WHEN tfl = 1 THEN 0.58 WHEN hit = 1 THEN 1.34 ELSE 0.55 END
      FROM x WHERE kind IN ('pass', 'run') AND defender IS NOT NULL AND (sack + interception + forced + defended + tfl + hit > 0 OR tackle = 1 AND epa < 0)) GROUP BY ALL""", "QB RB WR TE DL LB DB", False),
    "qb.drive_engine": (_simple(f"(SELECT {_K}, success, exp_success, down, qtr, quarter_left FROM drop_back UNION ALL SELECT {_K}, success, exp_success, down, qtr, quarter_left FROM rush)", "success - exp_success", f"{_LATE} OR (qtr IN (2, 4) AND quarter_left <= 120)"), "QB", True),
    "qb.explosive": (_simple("drop_back", "CAST(complete = 1 AND yards >= 20 AS INT)"), "QB", True),
    "qb.accuracy": (_simple("drop_back", "cpoe"), "QB", True),
    "qb.ball_security": (f"SELECT {_K}, coalesce(c, 0) + coalesce(f, 0) AS n, d FROM (SELECT {_K}, count(*)::DOUBLE AS d, sum(wpa) FILTER (interception = 1) AS c FROM drop_back GROUP BY ALL) LEFT JOIN (SELECT {_K}, sum(wpa) AS f FROM drop_ GROUP BY ALL) USING ({_K})", "QB", True),
    "qb.floor": (f"SELECT {_K}, sum(val) / count(*) AS n, 1.0 AS d FROM drop_back GROUP BY ALL HAVING count(*) >= 10", "QB", False),
    "qb.legs": (_simple("rush", "success - exp_success"), "QB", True),
    "qb.pressure_handling": (f"""SELECT {_K}, d * CASE WHEN tb - ob >= 30 THEN (ts - os) / (tb - ob) ELSE ls / nullif(lb, 0) END - s AS n, d FROM (SELECT {_K}, count(*)::DOUBLE AS d, sum(sack)::DOUBLE AS s FROM drop_back GROUP BY ALL) a,
      LATERAL (SELECT coalesce(sum(1), 0)::DOUBLE AS lb, sum(sack)::DOUBLE AS ls, (count(*) FILTER (o.team = a.team))::DOUBLE AS tb, coalesce(sum(sack) FILTER (o.team = a.team), 0)::DOUBLE AS ts, (count(*) FILTER (o.team = a.team AND o.athlete = a.athlete))::DOUBLE AS ob, coalesce(sum(sack) FILTER (o.team = a.team AND o.athlete = a.athlete), 0)::DOUBLE AS os FROM drop_back o WHERE o.season = a.season AND o.week < a.week)""", "QB", True),
    "qb.receiver_independence": (f"""SELECT season, week, game, team, opponent, passer AS athlete, sum(v - t * (av - sv) / (rt - st)) FILTER (rt - st >= 10) AS n, sum(t) FILTER (rt - st >= 10) AS d FROM (SELECT season, week, game, team, opponent, passer, athlete AS who, sum(val) AS v, count(*)::DOUBLE AS t FROM target WHERE sack = 0 GROUP BY ALL) a,
      LATERAL (SELECT coalesce(sum(val), 0) AS av, count(*)::DOUBLE AS rt, coalesce(sum(val) FILTER (o.passer = a.passer), 0) AS sv, (count(*) FILTER (o.passer = a.passer))::DOUBLE AS st FROM target o WHERE o.sack = 0 AND o.season = a.season AND o.week < a.week AND o.athlete = a.who) GROUP BY ALL HAVING d IS NOT NULL""", "QB", False),
    "rb.yards_over_expected": (_simple("rush", "yards - exp_yards"), "RB", True),
    "rb.stuff_avoidance": (f"RELATIVE game, team|{_simple('rush', '-CAST(yards <= 0 AS INT)')}", "RB", False),
    "rb.breakaway": (_simple("rush", "CAST(yards >= 10 AS INT)"), "RB", True),
    "rb.short_yardage": (_simple("rush", "success - exp_success", _SHORT), "RB", True),
    "rb.receiving": (_simple("target", "val"), "RB", False),
    "rb.ball_security": (f"SELECT {_K}, coalesce(f, 0) AS n, d FROM (SELECT {_K}, count(*)::DOUBLE AS d FROM (SELECT {_K} FROM rush UNION ALL SELECT {_K} FROM target) GROUP BY ALL) LEFT JOIN (SELECT {_K}, sum(wpa) AS f FROM drop_ GROUP BY ALL) USING ({_K})", "RB", True),
    "rb.line_independence": (f"RELATIVE game, team|{_simple('rush', 'val')}", "RB", False),
    "rec.target_share": (f"SELECT {_K}, coalesce(own, 0)::DOUBLE AS n, whole::DOUBLE AS d FROM (SELECT {_K} FROM drop_back UNION SELECT {_K} FROM target UNION SELECT {_K} FROM rush UNION SELECT {_K} FROM loss) LEFT JOIN (SELECT {_K}, count(*) AS own FROM target GROUP BY ALL) USING ({_K}) JOIN (SELECT season, game, team, count(*) AS whole FROM target GROUP BY ALL) USING (season, game, team)", "WR TE", False),
    "rec.value_per_target": (_simple("target", "val"), "WR TE", False),
    "rec.explosive": (_simple("target", "CAST(complete = 1 AND yards >= 20 AS INT)"), "WR TE", True),
    "rec.late_down": (_simple("target", "success - exp_success", _LATE), "WR TE", True),
    "rec.yac_over_expected": (_simple("target", "yac - xyac", "complete = 1"), "WR TE", True),
    "rec.qb_independence": (f"SELECT {_K}, sum(n) AS n, sum(d) AS d FROM (SELECT {_K}, n - d * (sum(n) OVER w - n) / (sum(d) OVER w - d) AS n, d, sum(d) OVER w - d AS rest FROM (SELECT {_K}, passer, sum(val) AS n, count(*)::DOUBLE AS d FROM target GROUP BY ALL) WINDOW w AS (PARTITION BY season, game, passer)) WHERE rest >= 5 GROUP BY ALL", "WR TE", False),
    "def.havoc": (_GAMES_D.format(n="tfl + ff + pd + picks", d="1.0"), "DL LB DB", True),
    "def.pass_rush": (_GAMES_D.format(n="CASE WHEN hits = 0 THEN sack_wpa ELSE sack_wpa + hits * price END", d="1.0") + " WHERE hits = 0 OR price IS NOT NULL", "DL LB", False),
    "def.finishing": (_GAMES_D.format(n="sacks", d="(sacks + hits)") + " WHERE sacks + hits > 0", "DL LB", False),
    "def.run_stop": (_GAMES_D.format(n="CASE WHEN tfl > sacks THEN tfl - sacks ELSE 0.0 END", d="1.0"), "DL LB", True),
    "def.stops": (_GAMES_D.format(n="stops", d="1.0"), "DL LB DB", True),
    "def.every_week": (_GAMES_D.format(n="CASE WHEN tfl > 0 OR sacks > 0 OR pd > 0 OR picks > 0 OR ff > 0 THEN 1.0 ELSE 0.0 END", d="1.0"), "DL LB DB", False),
    "def.tackle_share": (_GAMES_D.format(n="tackles", d="team_tackles") + " WHERE team_tackles > 0", "LB", False),
    "def.coverage": (_GAMES_D.format(n="pd + picks", d="1.0"), "LB", True),
    "def.ball_production": (_GAMES_D.format(n="pd + picks", d="1.0"), "DB", True),
    "def.run_support": (_GAMES_D.format(n="solo", d="1.0"), "DB", True),
    "def.impact": ("LATEST v", "DL LB DB", False),
    "def.pass_impact": ("LATEST pv", "DB", False),
    "ol.protection": ("""SELECT season, week, game, team, opponent, team AS athlete, d * ls / nullif(lb, 0) - p AS n, d FROM (SELECT season, week, game, team, opponent, count(*)::DOUBLE AS d, sum(CAST(sack = 1 OR hit = 1 AS INT))::DOUBLE AS p FROM drop_back GROUP BY ALL) a,
      LATERAL (SELECT count(*)::DOUBLE AS lb, sum(CAST(sack = 1 OR hit = 1 AS INT))::DOUBLE AS ls FROM drop_back o WHERE o.season = a.season AND o.week < a.week) WHERE lb > 0""", "", True),
    "ol.stuff_rate": (_simple("(SELECT * REPLACE (team AS athlete) FROM rush)", "-CAST(yards <= 0 AS INT)"), "", True),
    "ol.short_yardage": (_simple("(SELECT * REPLACE (team AS athlete) FROM rush)", "success - exp_success", _SHORT), "", True),
    "ol.line_yards": (_simple("(SELECT * REPLACE (team AS athlete) FROM rush)", "CASE WHEN yards < 0 THEN yards * 1.2::DOUBLE ELSE least(yards, 4) + 0.5::DOUBLE * greatest(0, least(yards, 10) - 4) END"), "", True),
    "k.field_goal": (_simple("(SELECT *, kicker AS athlete FROM x WHERE kind = 'field_goal' AND kicker IS NOT NULL)", "made - em"), "K", False),
    "p.punt_average": (f"""SELECT {_K}, g - d * lg / nullif(ld, 0) AS n, d FROM (SELECT season, week, game, team, opponent, kicker AS athlete, sum(distance)::DOUBLE AS g, count(*)::DOUBLE AS d FROM x WHERE kind = 'punt' AND kicker IS NOT NULL GROUP BY ALL) a,
      LATERAL (SELECT sum(distance)::DOUBLE AS lg, count(*)::DOUBLE AS ld FROM x o WHERE o.kind = 'punt' AND o.kicker IS NOT NULL AND o.season = a.season AND o.week < a.week) WHERE ld > 0""", "P", False),
    "p.punt_epa": (f"""SELECT {_K}, g - d * lg / nullif(ld, 0) AS n, d FROM (SELECT season, week, game, team, opponent, kicker AS athlete, sum(epa + 0.0643 * coalesce(return_yards, 0) + 0.851 * return_touchdown - 5.218 * return_fumble)::DOUBLE AS g, count(*)::DOUBLE AS d FROM x WHERE kind = 'punt' AND kicker IS NOT NULL GROUP BY ALL) a,
      LATERAL (SELECT sum(epa + 0.0643 * coalesce(return_yards, 0) + 0.851 * return_touchdown - 5.218 * return_fumble)::DOUBLE AS lg, count(*)::DOUBLE AS ld FROM x o WHERE o.kind = 'punt' AND o.kicker IS NOT NULL AND o.season = a.season AND o.week < a.week) WHERE ld > 0""", "P", False),
}


def _value_sql(name: str) -> str:
    events, groups, adjusted = DEFINED[name]
    members = "(" + ", ".join(f"'{g}'" for g in groups.split()) + ")"
    if events.startswith("LATEST "):
        v = events.split()[1]
        return f"""SELECT season, athlete, '{name}' AS trait, games, gap * (p * a) / (p * a + 6) AS value FROM (SELECT season, athlete, count(DISTINCT week) FILTER (ok) AS games, max(p) AS p, max(a) AS a, max_by(gap, week) AS gap FROM (
          SELECT *, sa / nullif(a, 0) - sp / nullif(p, 0) AS gap, p >= 3 AND a > 0 AS ok FROM (SELECT g.season, g.athlete, k.week, (count({v}) FILTER (here))::DOUBLE AS p, (count({v}) FILTER (NOT here))::DOUBLE AS a, sum({v}) FILTER (here) AS sp, sum({v}) FILTER (NOT here) AS sa
            FROM (SELECT DISTINCT season, athlete, week FROM grid) k JOIN grid g ON g.season = k.season AND g.athlete = k.athlete AND g.week <= k.week GROUP BY ALL)) GROUP BY ALL) JOIN po USING (season, athlete) WHERE grp IN {members} AND p >= 3 AND a > 0"""
    own = lambda q: f"SELECT e.* FROM ({q}) e JOIN po ON po.season = e.season AND po.athlete = e.athlete WHERE grp IN {members}" if groups else q
    if events.startswith("RELATIVE "):
        keys, events = events.removeprefix("RELATIVE ").split("|", 1)
        rows = f"SELECT {_K}, n - d * (sum(n) OVER w - n) / nullif(sum(d) OVER w - d, 0) AS n, d FROM ({own(events)}) WINDOW w AS (PARTITION BY season, {keys}) QUALIFY sum(d) OVER w - d >= 5"
    else:
        rows = own(events)
    rows = f"SELECT * FROM ({rows}) WHERE n IS NOT NULL"
    if adjusted:
        rows = f"""WITH e AS ({rows}) SELECT e.season, e.week, e.athlete, coalesce(e.n - e.d * (al - le), e.n) AS n, e.d FROM e,
          LATERAL (SELECT sum(o.n) FILTER (o.opponent = e.opponent) / nullif(sum(o.d) FILTER (o.opponent = e.opponent), 0) AS al, sum(o.n) / nullif(sum(o.d), 0) AS le FROM e o WHERE o.season = e.season AND o.week < e.week)"""
    value = "CASE WHEN count(*) >= 4 THEN quantile_cont(n, 0.2) END" if name == "qb.floor" else "sum(n) / nullif(sum(d), 0)"
    return f"SELECT season, athlete, '{name}' AS trait, count(DISTINCT week) AS games, {value} AS value FROM ({rows}) GROUP BY season, athlete"


def trait_sql(names: list[str]) -> str:
    return f"WITH {_SQL} SELECT season, athlete, trait, CAST(games AS BIGINT) AS games, round(value + 0.00000000033217::DOUBLE, 9) AS value FROM ({' UNION ALL '.join(f'({_value_sql(n)})' for n in names)})"


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as plays."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


def positions(p: DataFrame) -> DataFrame:
    ids = p.select("season").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(97))))
    return ids.selectExpr("season", "cast(t * 100 + k as bigint) AS athlete", f"{_GROUP} AS grp").where("grp is not null")


def presence(p: DataFrame) -> DataFrame:
    """Five in six defenders of a team are there, and all who made a play."""
    games = p.select("season", "week", "game", F.col("opponent").alias("team"), F.col("team").alias("opponent")).distinct()
    there = games.withColumn("k", F.explode(F.sequence(F.lit(70), F.lit(80)))).where("(game * 7 + k) % 6 <> 0").selectExpr("season", "week", "game", "team", "opponent", "cast(team * 100 + k as bigint) AS athlete")
    made = p.where("defender is not null").select("season", "week", "game", F.col("opponent").alias("team"), F.col("team").alias("opponent"), F.col("defender").alias("athlete"))
    return there.unionByName(made).distinct()


_SETS = {
    "T_credit": ["epa.credit"], "T_passer_traits": [t.name for t in T.REGISTRY if t.name.startswith("qb.")], "T_rusher_traits": [t.name for t in T.REGISTRY if t.name.startswith("rb.")],
    "T_receiver_traits": [t.name for t in T.REGISTRY if t.name.startswith("rec.")], "T_defender_traits": [t.name for t in T.REGISTRY if t.name.startswith("def.") and t.rule != "latest"],
    "T_defender_impact": [t.name for t in T.REGISTRY if t.rule == "latest"], "T_line_traits": [t.name for t in T.REGISTRY if t.name.startswith("ol.")], "T_kicking_traits": [t.name for t in T.REGISTRY if t.name[:2] in ("k.", "p.")],
}


def _query(names: list[str]):
    traits = tuple(t for t in T.REGISTRY if t.name in names)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = plays(spark, sf_dir)
        return T.evaluated(p, positions(p), presence(p), traits).select("season", "athlete", "trait", "games", F.round(F.col("value") + 0.00000000033217, 9).alias("value"))

    return run


QUERIES = {name: _query(names) for name, names in _SETS.items()}
SQL = {name: trait_sql(names) for name, names in _SETS.items()}
