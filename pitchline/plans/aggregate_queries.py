"""Aggregations, ordering, splits and upserts over the match-shaped views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.functions import lineups as L, rules as R
from pitchline.operators import aggregates as A, facts, scoring as SC, splits as S, upsert as U
from pitchline.operators.facts import both_sides, team_long
from pitchline.operators.ordered import positions, top_n
from pitchline.plans.prior_queries import rounded
from pitchline.plans.registry import query
from pitchline.plans.views import Tables, cte


@query("agg1_innings_totals", cte("matches", "innings") + """
SELECT i.match_id, CASE WHEN i.side = 1 THEN m.team1 ELSE m.team2 END AS team, i.runs, i.balls, i.wkts, i.pp_runs,
       i.death_runs FROM innings i JOIN matches m ON i.match_id = m.match_id""")
def agg1(t: Tables):
    m = t.matches.select("match_id", "team1", "team2")
    team = F.when(F.col("side") == 1, F.col("team1")).otherwise(F.col("team2"))
    return t.innings.join(m, "match_id").select(
        "match_id", team.alias("team"), "runs", "balls", "wkts", "pp_runs", "death_runs")


_FIRST = "(toss_decision = 'bat') = (toss_winner = team1)"


@query("agg2_batting_order", cte("matches", "innings") + f"""
SELECT m.match_id, CASE WHEN count(*) = 2 THEN any_value(CASE WHEN {_FIRST} THEN team1 ELSE team2 END)
    ELSE any_value(CASE WHEN side = 1 THEN team1 ELSE team2 END) END AS batting_first,
  CASE WHEN count(*) = 2 THEN any_value(CASE WHEN {_FIRST} THEN team2 ELSE team1 END)
    ELSE max(CASE WHEN (side = 1) = ({_FIRST}) THEN NULL WHEN side = 1 THEN team1 ELSE team2 END) END AS batting_second
FROM matches m JOIN innings i ON m.match_id = i.match_id GROUP BY m.match_id""")
def agg2(t: Tables):
    first1 = R.batting_first(F.col("toss_winner"), F.col("toss_decision"), F.col("team1"), F.col("team2")) == F.col("team1")
    rows = t.innings.select("match_id", "side").join(t.matches, "match_id").select(
        "match_id", F.when((F.col("side") == 1) == first1, 0).otherwise(1).alias("innings_no"),
        F.when(F.col("side") == 1, F.col("team1")).otherwise(F.col("team2")).alias("team"))
    return facts.batting_order(rows)


@query("agg3_first_innings_total", cte("results") + f"""
SELECT match_id, CASE WHEN {_FIRST} THEN runs_1 ELSE runs_2 END AS first_runs FROM results""")
def agg3(t: Tables):
    m = t.matches
    first1 = R.batting_first(F.col("toss_winner"), F.col("toss_decision"), F.col("team1"), F.col("team2")) == F.col("team1")
    per = t.deliveries.groupBy("match_id").agg(
        F.sum(F.when(F.col("side") == 1, F.col("runs"))).alias("a"), F.sum(F.when(F.col("side") == 2, F.col("runs"))).alias("b"))
    return m.join(per, "match_id", "left").select(
        "match_id", F.coalesce(F.when(first1, F.col("a")).otherwise(F.col("b")), F.lit(0)).alias("first_runs"))


@query("agg4_lineup_rating_gap", cte("lineups") + """, r AS (
  SELECT l.match_id, l.side, avg(CAST(s.s_acctbal AS DECIMAL(18,2))) AS a, max(s.s_acctbal) AS hi, min(s.s_acctbal) AS lo
  FROM lineups l LEFT JOIN supplier s ON l.match_id % 4 <> 0 AND l.player = 'Player ' || s.s_suppkey
  GROUP BY 1, 2)
SELECT match_id, round(coalesce(max(CASE WHEN side = 1 THEN a END), 1000), 5) AS team1_avg,
  round(coalesce(max(CASE WHEN side = 2 THEN a END), 1000), 5) AS team2_avg,
  coalesce(max(CASE WHEN side = 1 THEN hi END), 1000.0) AS team1_max,
  coalesce(max(CASE WHEN side = 2 THEN lo END), 1000.0) AS team2_min,
  round(coalesce(max(CASE WHEN side = 1 THEN a END), 1000) - coalesce(max(CASE WHEN side = 2 THEN a END), 1000), 5) AS gap
FROM r GROUP BY 1""")
def agg4(t: Tables):
    known = t.read("supplier").select(F.concat(F.lit("Player "), "s_suppkey").alias("player"), F.col("s_acctbal").alias("rating"))
    asked = t.lineup_slots.withColumn("player", F.when(F.col("match_id") % 4 == 0, "guest").otherwise(F.col("player")))
    rows = asked.join(known, "player", "left")
    per = rows.groupBy("match_id", "side").agg(
        (F.sum(F.col("rating").cast("decimal(18,2)")).cast("double") / F.count("rating")).alias("avg"),
        F.max("rating").alias("max"), F.min("rating").alias("min"))
    wide = both_sides(per, ["match_id"], ["avg", "max", "min"]).fillna(1000.0)
    gap = F.round(F.col("team1_avg") - F.col("team2_avg"), 5).alias("gap")
    return wide.select("match_id", F.round("team1_avg", 5).alias("team1_avg"), F.round("team2_avg", 5).alias("team2_avg"),
                       "team1_max", "team2_min", gap)


@query("agg6_team_profiles", cte("results") + """, s AS (
  SELECT team1 AS team, runs_1 AS runs, balls_1 AS balls, wkts_2 AS taken, pp_runs_1 AS pp FROM results
  UNION ALL SELECT team2, runs_2, balls_2, wkts_1, pp_runs_2 FROM results)
SELECT team, round(avg(runs), 5) AS runs, round(avg(balls), 5) AS balls, round(avg(taken), 5) AS taken,
       round(avg(pp), 5) AS pp FROM s GROUP BY 1""")
def agg6(t: Tables):
    pair = lambda f: (f(1, 2), f(2, 1))
    long = team_long(t.results, {
        "runs": pair(lambda a, b: F.col(f"runs_{a}")), "balls": pair(lambda a, b: F.col(f"balls_{a}")),
        "taken": pair(lambda a, b: F.col(f"wkts_{b}")), "pp": pair(lambda a, b: F.col(f"pp_runs_{a}"))})
    skills = ["runs", "balls", "taken", "pp"]
    return rounded(A.team_profiles(long.select("team", *skills), skills), *skills, digits=5)


@query("agg7_venue_profiles", cte("results") + """
SELECT venue, round(avg(runs_1), 5) AS runs_1, round(avg(balls_1), 5) AS balls_1,
  round(avg(CASE WHEN toss_winner = winner THEN 1 ELSE 0 END), 6) AS toss_advantage,
  (SELECT toss_decision FROM results x WHERE x.venue = r.venue GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS toss_decision,
  (SELECT team1 FROM results x WHERE x.venue = r.venue GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS team1
FROM results r GROUP BY venue""")
def agg7(t: Tables):
    out = A.venue_profiles(t.results, "venue", ["runs_1", "balls_1"], ["toss_decision", "team1"])
    return rounded(rounded(out, "runs_1", "balls_1", digits=5), "toss_advantage")


# Player seasons: whole numbers, so that both engines add exactly.
_SEASONS = cte("matches", "deliveries") + """, ps AS (
  SELECT d.batter AS player, m.season + 25 AS season, CAST(sum(d.runs) AS BIGINT) AS runs,
         count(DISTINCT d.match_id) AS innings, count(*) AS balls, CAST(sum(d.wicket) AS BIGINT) AS wkts,
         CAST(sum(CASE WHEN d.runs >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS fours,
         CAST(sum(CASE WHEN d.runs >= 48 THEN 1 ELSE 0 END) AS BIGINT) AS sixes,
         CAST(sum(CASE WHEN d.runs < 5 THEN 1 ELSE 0 END) AS BIGINT) AS dots
  FROM deliveries d JOIN matches m ON d.match_id = m.match_id GROUP BY 1, 2),
sc AS (SELECT player, season, (runs / innings) * 2.0::DOUBLE + (100.0::DOUBLE * runs / balls) / 20.0::DOUBLE
           + (fours + sixes) / 5.0::DOUBLE + (fours // 10) * 1.5::DOUBLE + (sixes // 10) * 4.0::DOUBLE AS batting_raw,
         (wkts / innings) * 25.0::DOUBLE + (100.0::DOUBLE * dots / balls) / 2.0::DOUBLE
           + greatest(0.0::DOUBLE, 9.0::DOUBLE - runs / balls) * 8.0::DOUBLE + (dots // 20) * 2.0::DOUBLE AS bowling_raw FROM ps)"""


def _player_seasons(t: Tables):
    d = t.deliveries.join(t.matches.select("match_id", "season"), "match_id")
    # Two steps keep the distinct match count a plain map-side combined sum.
    per = d.groupBy("batter", "season", "match_id").agg(
        F.sum("runs").alias("runs"), F.count("*").alias("balls"), F.sum("wicket").alias("wkts"),
        F.sum((F.col("runs") >= 40).cast("int")).alias("fours"), F.sum((F.col("runs") >= 48).cast("int")).alias("sixes"),
        F.sum((F.col("runs") < 5).cast("int")).alias("dots"))
    return per.groupBy(F.col("batter").alias("player"), (F.col("season") + 25).alias("season")).agg(
        F.sum("runs").alias("runs"), F.count("*").alias("innings"), F.sum("balls").alias("balls"), F.sum("wkts").alias("wkts"),
        F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"), F.sum("dots").alias("dots"))


def season_scores(t: Tables):
    c = F.col
    bat = A.batting_score(c("runs"), c("innings"), 100.0 * c("runs") / c("balls"), c("fours"), c("sixes"),
                          F.floor(c("fours") / 10), F.floor(c("sixes") / 10))
    bowl = A.bowling_score(c("wkts"), c("innings"), 100.0 * c("dots") / c("balls"), c("runs") / c("balls"), F.floor(c("dots") / 20))
    return _player_seasons(t).select("player", "season", bat.alias("batting_raw"), bowl.alias("bowling_raw"))


_W = "CASE season WHEN 2020 THEN 1.0::DOUBLE WHEN 2021 THEN 1.2 WHEN 2023 THEN 1.5 WHEN 2024 THEN 1.8 WHEN 2025 THEN 2.1 WHEN 2026 THEN 2.5 ELSE 1.0 END"


@query("agg8_recency_weighted_score", _SEASONS + f"""
SELECT player, round(sum(batting_raw * {_W}) / sum({_W}), 5) AS batting_score FROM sc GROUP BY 1""")
def agg8(t: Tables):
    from pitchline import presets as P

    w = R.season_weight(F.col("season"), P.RATING_SEASON_WEIGHTS)
    return rounded(A.recency_weighted(season_scores(t), ["player"], "batting_raw", w, "batting_score"), "batting_score", digits=5)


@query("agg9_composite_scores", _SEASONS + """
SELECT player, season, round(batting_raw, 5) AS batting_raw, round(bowling_raw, 5) AS bowling_raw FROM sc""")
def agg9(t: Tables):
    return rounded(season_scores(t), "batting_raw", "bowling_raw", digits=5)


@query("agg10_rating_scale", _SEASONS + f""", b AS (
  SELECT regexp_replace(lower(player), '[^a-z0-9]', '', 'g') AS player_key,
         0.60::DOUBLE * (sum(batting_raw * {_W}) / sum({_W})) + 0.40::DOUBLE * (sum(bowling_raw * {_W}) / sum({_W})) AS perf
  FROM sc GROUP BY 1)
SELECT player_key, round_even(1000 + 150 * ((perf - (SELECT avg(perf) FROM b)) / (SELECT stddev_pop(perf) FROM b)), 3) AS rating FROM b""")
def agg10(t: Tables):
    return A.player_ratings(season_scores(t)).select("player_key", "rating")


@query("agg11_head_counts", "SELECT p_brand, count(*) AS players FROM part GROUP BY 1")
def agg11(t: Tables):
    return t.read("part").groupBy("p_brand").agg(F.count("*").alias("players"))


@query("agg12_hit_rate", cte("log") + """
SELECT count(*) AS closed, CAST(sum(CASE WHEN predicted = actual THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  round(avg(CASE WHEN predicted = actual THEN 1 ELSE 0 END), 6) AS hit_rate FROM log WHERE actual IS NOT NULL""")
def agg12(t: Tables):
    return rounded(A.hit_rate(t.log), "hit_rate")


@query("agg13_missing_share", cte("log") + """
SELECT 'actual' AS column_name, round(avg(CASE WHEN actual IS NULL THEN 1 ELSE 0 END) * 100, 6) AS missing_pct FROM log
UNION ALL SELECT 'first_score', round(avg(CASE WHEN first_score IS NULL THEN 1 ELSE 0 END) * 100, 6) FROM log
UNION ALL SELECT 'venue', round(avg(CASE WHEN venue IS NULL THEN 1 ELSE 0 END) * 100, 6) FROM log""")
def agg13(t: Tables):
    return rounded(A.missing_share(t.log.select("actual", "first_score", "venue")), "missing_pct")


@query("agg14_distinct_profile", cte("matches") + "".join(
    f"""{' UNION ALL ' if i else ' '}SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,
  CASE WHEN count(DISTINCT {c}) <= 10 THEN string_agg(DISTINCT CAST({c} AS VARCHAR), '|' ORDER BY CAST({c} AS VARCHAR)) END AS shown FROM matches"""
    for i, c in enumerate(("team1", "venue", "toss_decision", "season"))))
def agg14(t: Tables):
    return A.distinct_profile(t.matches, ["team1", "venue", "toss_decision", "season"])


@query("agg15_summary", cte("innings") + "".join(
    f"""{' UNION ALL ' if i else ' '}SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM innings""" for i, c in enumerate(("runs", "balls", "wkts"))))
def agg15(t: Tables):
    return rounded(A.summary(t.innings, ["runs", "balls", "wkts"]), "mean", "std")


_SNAPSHOT = {"form": 0.5, "runs_for": 160.0, "runs_against": 160.0, "wkts_taken": 7.0, "pp_rr": 8.0, "death_rr": 10.0}


@query("agg16_team_snapshot", cte("results") + """, l AS (
  SELECT match_id, match_date, team1 AS team, winner, runs_1 AS rf, runs_2 AS ra, wkts_2 AS wt, pp_runs_1 AS pp, balls_1 AS b FROM results
  UNION ALL SELECT match_id, match_date, team2, winner, runs_2, runs_1, wkts_1, pp_runs_2, balls_2 FROM results),
k AS (SELECT match_id, team, winner, CASE WHEN winner = team THEN 1 ELSE 0 END AS form, CASE WHEN b > 0 THEN rf END AS runs_for, ra AS runs_against,
    wt AS wkts_taken, CASE WHEN match_id % 7 <> 0 THEN pp / 6.0::DOUBLE WHEN b > 0 THEN rf / (b / 6.0::DOUBLE) END AS pp_rr,
    CASE WHEN b > 0 THEN rf / (b / 6.0::DOUBLE) END AS death_rr,
    row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM l WHERE winner IS NOT NULL)
SELECT t AS team, """ + ", ".join(f"round(coalesce(avg({c}), {d}) + 1e-9, 6) AS {c}" for c, d in _SNAPSHOT.items()) + """,
  coalesce(max(CASE WHEN rn = 1 THEN match_id END), -1) AS as_of_match_id
FROM (SELECT 'NATION_' || n_nationkey AS t FROM nation UNION ALL SELECT 'club ' || n_nationkey FROM nation) LEFT JOIN k ON t = team AND rn <= 5 GROUP BY t""")
def agg16(t: Tables):
    """Sides that play and sides that never do; powerplay runs are unknown for some matches."""
    def side(a: int, b: int):
        runs, overs = F.when(F.col(f"balls_{a}") > 0, F.col(f"runs_{a}")), F.col(f"balls_{a}") / 6.0
        pp = F.when(F.col("match_id") % 7 != 0, F.col(f"pp_runs_{a}"))
        return [runs, F.col(f"runs_{b}"), F.col(f"wkts_{b}"), R.powerplay_rate_or_innings(pp, runs, overs), R.innings_rate(runs, overs)]

    names = [c for c in _SNAPSHOT if c != "form"]
    long = team_long(t.results, dict(zip(names, zip(side(1, 2), side(2, 1)))))
    long = long.withColumn("form", R.flag(F.col("winner") == F.col("team"))).select("match_id", "match_date", "team", "winner", *_SNAPSHOT)
    n = t.read("nation")
    teams = n.select(F.concat(F.lit("NATION_"), "n_nationkey").alias("team")).unionAll(n.select(F.concat(F.lit("club "), "n_nationkey")))
    out = A.team_snapshot(long, teams, _SNAPSHOT)
    return out.select("team", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in _SNAPSHOT], "as_of_match_id").fillna(-1, ["as_of_match_id"])


@query("agg17_recent_venue_stats", cte("log") + """, k AS (
  SELECT *, row_number() OVER (PARTITION BY venue ORDER BY match_date DESC, match_id DESC) AS rn FROM log WHERE actual IS NOT NULL)
SELECT venue, round(coalesce(avg(first_score), 170.0), 6) AS avg_score,
  round(avg(CASE WHEN toss_winner = actual THEN 1 ELSE 0 END), 6) AS toss_share FROM k WHERE rn <= 20 GROUP BY 1""")
def agg17(t: Tables):
    return rounded(A.recent_venue_stats(t.log), "avg_score", "toss_share")


@query("agg18_recent_team_form", cte("log") + """, l AS (
  SELECT match_id, match_date, team1 AS team, actual FROM log UNION ALL SELECT match_id, match_date, team2, actual FROM log),
k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM l WHERE actual IS NOT NULL)
SELECT team, round(avg(CASE WHEN actual = team THEN 1 ELSE 0 END), 6) AS recent_form FROM k WHERE rn <= 5 GROUP BY 1""")
def agg18(t: Tables):
    long = team_long(t.log.select("match_id", "match_date", "team1", "team2", "actual"))
    return rounded(A.recent_team_form(long), "recent_form")


# --- order, limits, splits --------------------------------------------------

@query("srt1_date_id_order", cte("matches") + """
SELECT match_id, match_date, row_number() OVER (ORDER BY match_date, match_id) AS pos FROM matches""")
def srt1(t: Tables):
    m = t.matches.select("match_id", "match_date")
    return positions(m, ["match_date", "match_id"], span=t.dates).orderBy("match_date", "match_id")


@query("srt2_latest_log_rows", cte("log") + """
SELECT match_id, match_date, predicted FROM log ORDER BY coalesce(match_date, DATE '1900-01-01') DESC, match_id DESC LIMIT 20""")
def srt2(t: Tables):
    when = F.coalesce("match_date", F.lit("1900-01-01").cast("date"))
    return t.log.orderBy(when.desc(), F.col("match_id").desc()).limit(20).select("match_id", "match_date", "predicted")


@query("srt3_top_n_per_group", """
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand
  ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 11""")
def srt3(t: Tables):
    top = top_n(t.read("part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 11)
    return top.select("p_brand", "p_partkey", "p_retailprice")


@query("srt4_top_k_probabilities", cte("multi") + """, u AS (
  SELECT event_id, unnest(range(5)) AS c, unnest(w) AS wt, list_sum(w) AS total FROM multi),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY wt DESC, c) AS rn FROM u)
SELECT event_id, CAST(rn AS INTEGER) AS place, CAST(c AS INTEGER) AS class, round(wt / total::DOUBLE, 6) AS prob FROM r WHERE rn <= 3""")
def srt4(t: Tables):
    from pitchline.operators.scoring import top_k

    m = t.multi.withColumn("total", F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x))
    p = m.select("event_id", F.transform("w", lambda x: x / F.col("total")).alias("probability"))
    return rounded(top_k(p, ["event_id"], "probability", 3), "prob")


@query("spl1_holdout_year", cte("matches") + """
SELECT match_id, season = 2001 AS is_test FROM matches""")
def spl1(t: Tables):
    m = t.matches.select("match_id", "match_date", "season")
    return S.holdout_year(m, F.col("season"), 2001, ["match_date", "match_id"], span=t.dates).select("match_id", "is_test")


@query("spl1_holdout_fallback", cte("matches") + """
SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) > floor(0.8 * (SELECT count(*) FROM matches)) AS is_test
FROM matches""")
def spl1b(t: Tables):
    m = t.matches.select("match_id", "match_date", "season")
    return S.holdout_year(m, F.col("season"), 2030, ["match_date", "match_id"], span=t.dates).select("match_id", "is_test")


@query("spl2_split_by_position", cte("matches") + """
SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) > floor(0.85 * (SELECT count(*) FROM matches)) AS is_test
FROM matches""")
def spl2(t: Tables):
    m = t.matches.select("match_id", "match_date")
    return S.split_by_position(m, ["match_date", "match_id"], 0.85, span=t.dates).select("match_id", "is_test")


@query("spl3_stratified_split", cte("scored") + """, p AS (
  SELECT match_id, label, row_number() OVER (PARTITION BY label ORDER BY match_id * 31 % 1009, match_id) AS pos,
         count(*) OVER (PARTITION BY label) AS n FROM scored)
SELECT match_id, label, pos > floor(n * 0.8) AS is_test FROM p""")
def spl3(t: Tables):
    s = t.scored.select("match_id", "label")
    return S.stratified_split(s, "label", "match_id").select("match_id", "label", "is_test")


@query("spl4_stratified_folds", cte("scored") + """
SELECT match_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY match_id * 31 % 1009, match_id) - 1) % 5 AS INTEGER)
  AS fold FROM scored""")
def spl4(t: Tables):
    return S.stratified_folds(t.scored.select("match_id", "label"), "label", "match_id", 5)


@query("spl5_fallback_source", cte("log") + """
SELECT match_id, actual AS label, coalesce(CASE WHEN match_id % 11 <> 0 THEN toss_winner END, team1) AS toss_winner,
  CASE WHEN match_id % 13 <> 0 THEN toss_decision ELSE 'field' END AS toss_decision, """ + ", ".join(
    f"coalesce(CAST(first_score AS DOUBLE), {d}) AS {c}" if c == "venue_score_prior" else f"{d}::DOUBLE AS {c}" for c, d in P.EVALUATION_DEFAULTS.items()) + """
FROM log WHERE actual IS NOT NULL AND year(match_date) = 1996""")
def spl5(t: Tables):
    """No match of the hold-out year: the closed log rows of one season stand in."""
    log = t.log.select(
        "match_id", "actual", "team1", F.when(F.col("match_id") % 11 != 0, F.col("toss_winner")).alias("toss_winner"),
        F.when(F.col("match_id") % 13 != 0, F.upper("toss_decision")).otherwise("no idea").alias("toss_decision"),
        F.col("first_score").cast("double").alias("venue_score_prior"), F.year("match_date").alias("season"))
    primary = t.matches.filter("season = 2030").withColumn("label", F.col("winner"))
    return SC.evaluation_source(primary, log, "actual", "label", P.EVALUATION_DEFAULTS, F.col("season") == 1996)


# --- set operations and upserts ---------------------------------------------

@query("set1_wide_to_long", cte("long") + "SELECT match_id, team, opponent, CAST(side AS INTEGER) AS side FROM long")
def set1(t: Tables):
    m = t.matches
    return team_long(m.select("match_id", "team1", "team2")).select("match_id", "team", "opponent", "side")


@query("set2_union_missing_columns", cte("matches") + """
SELECT match_id, venue, winner FROM matches WHERE season < 2001 UNION ALL
SELECT match_id, venue, NULL FROM matches WHERE season = 2001""")
def set2(t: Tables):
    m = t.matches
    now = m.filter("season = 2001").select("match_id", "venue")
    return m.filter("season < 2001").select("match_id", "venue", "winner").unionByName(now, allowMissingColumns=True)


def _batch(t: Tables):
    """New versions of the even matches and a few unseen ids."""
    m = t.matches.select("match_id", "venue", "winner")
    even = m.filter("match_id % 2 = 0").select("match_id", F.lit("moved").alias("venue"), F.col("winner"))
    fresh = m.filter("match_id % 2 = 1").select((-F.col("match_id")).alias("match_id"), F.lit("new").alias("venue"), "winner")
    return even.unionByName(fresh)


_REPLACED = cte("matches") + """
SELECT match_id, CASE WHEN match_id % 2 = 0 THEN 'moved' ELSE venue END AS venue, winner FROM matches
UNION ALL SELECT -match_id, 'new', winner FROM matches WHERE match_id % 2 = 1"""


@query("set3_append_keep_last", _REPLACED)
def set3(t: Tables):
    return U.append_keep_last(t.matches.select("match_id", "venue", "winner"), _batch(t), ["match_id"])


@query("set4_keep_first", """
SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def set4(t: Tables):
    return U.keep_first(t.read("part").select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


@query("set5_replace_by_key", _REPLACED)
def set5(t: Tables):
    return U.replace_by_key(t.matches.select("match_id", "venue", "winner"), _batch(t), ["match_id"])


@query("set6_merge_columns", cte("log") + """
SELECT match_id, CASE WHEN match_id % 2 = 0 THEN 'moved' ELSE venue END AS venue, predicted, actual FROM log
UNION ALL SELECT -match_id, 'new', NULL, winner FROM matches WHERE match_id % 2 = 1""")
def set6(t: Tables):
    target = t.log.select("match_id", "venue", "predicted", "actual")
    batch = _batch(t).select("match_id", "venue", F.col("winner").alias("actual"))
    return U.merge_columns(target, batch, ["match_id"], ["venue"])


_OPEN = """, o AS (SELECT match_id, match_date, team1, team2, CASE WHEN match_id % 3 = 0 THEN actual END AS actual,
  CASE WHEN match_id % 3 = 0 THEN 1 ELSE 0 END AS ended FROM log)"""


def _open_log(t: Tables):
    third = F.col("match_id") % 3 == 0
    return t.log.select("match_id", "match_date", "team1", "team2", F.when(third, F.col("actual")).alias("actual"),
                        third.cast("int").alias("ended"))


@query("set7_close_by_id", cte("log") + _OPEN + """
SELECT o.match_id, o.match_date, o.team1, o.team2, coalesce(m.winner, o.actual) AS actual,
  CASE WHEN m.winner IS NOT NULL THEN 1 ELSE o.ended END AS ended
FROM o JOIN matches m ON o.match_id = m.match_id""")
def set7(t: Tables):
    results = t.matches.filter("winner IS NOT NULL").select("match_id", F.col("winner").alias("actual"))
    return U.close_by_id(_open_log(t), results, "match_id", ["actual"])


@query("set7_close_latest_of_fixture", cte("log") + _OPEN + """, l AS (
  SELECT match_id, row_number() OVER (PARTITION BY team1, team2 ORDER BY match_date DESC, match_id DESC) AS rn FROM o)
SELECT o.match_id, o.match_date, o.team1, o.team2, CASE WHEN rn = 1 THEN o.team1 ELSE o.actual END AS actual,
  CASE WHEN rn = 1 THEN 1 ELSE o.ended END AS ended FROM o JOIN l ON o.match_id = l.match_id""")
def set7b(t: Tables):
    log = _open_log(t)
    results = log.select("team1", "team2").distinct().withColumn("actual", F.col("team1"))
    return U.close_latest_of_fixture(log, results, ["team1", "team2"], ["match_date", "match_id"], "match_id", ["actual"])


@query("set8_array_intersection", cte("lineups") + """
SELECT a.match_id, a.side, count(b.player) AS n_common FROM lineups a
  LEFT JOIN (SELECT match_id - 1 AS match_id, side, player FROM lineups) b
  ON a.match_id = b.match_id AND a.side = b.side AND a.player = b.player GROUP BY 1, 2""")
def set8(t: Tables):
    a = t.lineups.select("match_id", "side", "players")
    b = a.select((F.col("match_id") - 1).alias("match_id"), "side", F.col("players").alias("next_players"))
    common = F.size(F.array_intersect("players", F.coalesce("next_players", F.array().cast("array<string>"))))
    return a.join(b, ["match_id", "side"], "left").select("match_id", "side", common.cast("bigint").alias("n_common"))


@query("set9_distinct_teams", cte("long") + "SELECT DISTINCT team FROM long")
def set9(t: Tables):
    m = t.matches
    return m.select(F.explode(F.array("team1", "team2")).alias("team")).distinct().orderBy("team")
