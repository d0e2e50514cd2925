"""Joins and lookups over the match-shaped views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.functions import lineups as L, rules as R
from pitchline.operators import joins as J, priors
from pitchline.operators.facts import both_sides, team_long
from pitchline.operators.ordered import Recent, top_n, with_history, span_of
from pitchline.plans.prior_queries import VECTORS_SQL, rounded
from pitchline.plans.registry import query
from pitchline.plans.views import Tables, cte


@query("jon1_dimension_left_join", cte("matches") + """
SELECT m.match_id, m.team1, coalesce(n.n_regionkey, -1) AS region, r.r_name AS region_name
FROM (SELECT match_id, CASE WHEN match_id % 5 = 0 THEN 'guest' ELSE team1 END AS team1 FROM matches) m
  LEFT JOIN nation n ON m.team1 = n.n_name LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def jon1(t: Tables):
    asked = t.matches.select("match_id", F.when(F.col("match_id") % 5 == 0, "guest").otherwise(F.col("team1")).alias("team1"))
    dim = t.read("nation").select(
        F.col("n_name").alias("team1"), F.col("n_regionkey").alias("region"))
    names = t.read("region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("region_name"))
    return asked.join(dim, "team1", "left").join(names, "region", "left").select(
        "match_id", "team1", F.coalesce("region", F.lit(-1)).alias("region"), "region_name")


@query("jon2_long_back_to_sides", cte("matches", "innings") + """
SELECT m.match_id, m.team1, m.team2, coalesce(a.runs, 0) AS team1_runs, coalesce(b.runs, 0) AS team2_runs,
       coalesce(a.balls, 0) AS team1_balls, coalesce(b.balls, 0) AS team2_balls FROM matches m
  LEFT JOIN innings a ON a.match_id = m.match_id AND a.side = 1
  LEFT JOIN innings b ON b.match_id = m.match_id AND b.side = 2""")
def jon2(t: Tables):
    wide = both_sides(t.innings, ["match_id"], ["runs", "balls"])
    return t.matches.select("match_id", "team1", "team2").join(wide, "match_id", "left").fillna(0)


@query("jon3_full_outer_zero_fill", cte("batting", "bowling") + """
SELECT coalesce(a.match_id, b.match_id) AS match_id, coalesce(a.player, b.player) AS player, coalesce(runs, 0) AS runs,
  coalesce(outs, 0) AS outs, coalesce(wickets, 0) AS wickets, coalesce(runs_given, 0) AS runs_given
FROM batting a FULL JOIN bowling b ON a.match_id = b.match_id AND a.player = b.player""")
def jon3(t: Tables):
    bat = t.batting.select("match_id", "player", "runs", "outs")
    return J.full_zero(bat, t.bowling.select("match_id", "player", "wickets", "runs_given"), ["match_id", "player"])


@query("jon4_lineup_member_lookup", cte("lineups", "bowling") + """
SELECT l.match_id, l.side, l.player, coalesce(b.wickets, 0) AS wickets, coalesce(b.runs_given, 0) AS runs_given FROM lineups l
  LEFT JOIN bowling b ON l.match_id = b.match_id AND l.player = b.player""")
def jon4(t: Tables):
    rows = L.lineup_rows(t.lineups, "players", "match_id", "side").drop("slot")
    return rows.join(t.bowling.select("match_id", "player", "wickets", "runs_given"), ["match_id", "player"], "left").fillna(0)


_RATED = """, rt AS (SELECT 'player' || s_suppkey AS key,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 7 ELSE s_acctbal END AS DECIMAL(18,2)) AS rating FROM supplier),
d AS (SELECT median(CAST(rating AS DOUBLE)) AS md FROM rt)"""


@query("jon5_rating_lookup_with_median", cte("lineups") + _RATED + """
SELECT match_id, side, round(avg(r), 5) AS rating_avg, max(r) AS rating_max, min(r) AS rating_min FROM (
  SELECT l.match_id, l.side, coalesce(CAST(rt.rating AS DOUBLE), md) AS r FROM lineups l CROSS JOIN d
    LEFT JOIN rt ON regexp_replace(lower(l.player), '[^a-z0-9]', '', 'g') || CASE WHEN l.match_id % 4 = 0 THEN 'guest' ELSE '' END = rt.key)
GROUP BY 1, 2""")
def jon5(t: Tables):
    s = t.read("supplier")
    first = s.select(F.concat(F.lit("PLAYER-"), "s_suppkey").alias("player"), F.col("s_acctbal").alias("rating"), F.lit(1).alias("row"))
    again = s.filter("s_suppkey % 5 = 0").select(  # another spelling of the same key, further down the list
        F.concat(F.lit("Player "), "s_suppkey").alias("player"), (F.col("s_acctbal") + 7).alias("rating"), F.lit(2).alias("row"))
    guest = F.when(F.col("match_id") % 4 == 0, " guest").otherwise("")
    rows = t.lineup_slots.withColumn("player", F.concat("player", guest))
    return rounded(J.lineup_rating(rows, first.unionByName(again), "row"), "rating_avg", digits=5)


@query("jon6_latest_row_lookup", cte("matches", "batting") + """, b AS (
  SELECT b.*, m.match_date, row_number() OVER (PARTITION BY player ORDER BY match_date DESC, b.match_id DESC) AS rn
  FROM batting b JOIN matches m ON b.match_id = m.match_id)
SELECT s.s_name, b.player, b.match_id, b.match_date, b.runs FROM supplier s
  LEFT JOIN b ON b.player = 'Player ' || s.s_suppkey AND rn = 1""")
def jon6(t: Tables):
    latest = J.latest_per_key(t.dated(t.batting), ["player"], ["match_date", "match_id"])
    roster = t.read("supplier").select("s_name", F.concat(F.lit("Player "), "s_suppkey").alias("_p"))
    return roster.join(latest.withColumn("_p", F.col("player")), "_p", "left").select(
        "s_name", "player", "match_id", "match_date", "runs")


@query("jon7_as_of_form", cte("long") + """, h AS (
  SELECT team, match_date AS day_at, 0 AS probe, match_id AS id, CASE WHEN winner = team THEN 1 ELSE 0 END AS win FROM long
  UNION ALL SELECT 'NATION_' || c_nationkey, DATE '1995-01-01' + CAST(c_custkey % 2400 AS INTEGER), -1, c_custkey, NULL
  FROM customer),
o AS (SELECT *, 1 + count(win) OVER (PARTITION BY team ORDER BY day_at, probe, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS ord FROM h),
f AS (SELECT *, avg(win) OVER (PARTITION BY team ORDER BY ord RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form FROM o)
SELECT id AS probe_id, team, day_at, round(coalesce(form, 0.5), 6) AS form FROM f WHERE probe = -1""")
def jon7(t: Tables):
    long = team_long(t.matches.select("match_id", "match_date", "team1", "team2", "winner"))
    past = long.select("team", F.col("match_date").alias("day_at"), F.lit(0).alias("probe"), F.col("match_id").alias("id"),
                       R.flag(F.col("winner") == F.col("team")).alias("win"))
    asks = t.read("customer").select(
        F.concat(F.lit("NATION_"), "c_nationkey").alias("team"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2400).cast("int")).alias("day_at"),
        F.lit(-1).alias("probe"), F.col("c_custkey").alias("id"), F.lit(None).cast("int").alias("win"))
    days = span_of(t.read("orders").select(F.col("o_orderdate").cast("date").alias("day_at")), ["day_at"])
    out = priors.completed_state(past.unionByName(asks), ["team"], F.col("probe") == 0,
                                 [Recent("form", F.col("win"), 5)], days, ["day_at", "probe", "id"])
    return out.filter("probe = -1").select(
        F.col("id").alias("probe_id"), "team", "day_at", F.round(F.coalesce("before.form", F.lit(0.5)), 6).alias("form"))


@query("jon8_fixture_either_order", cte("results") + """
SELECT match_id, CASE WHEN venue = '5-LOW' THEN 'guest' ELSE team1 END AS team1, team2,
  CASE WHEN venue = '5-LOW' THEN 160.0::DOUBLE WHEN venue = '2-HIGH'
  THEN CAST(runs_1 + 1 AS DOUBLE) WHEN runs_1 = 0 THEN 160.0 ELSE CAST(runs_1 AS DOUBLE) END AS score
FROM results""")
def jon8(t: Tables):
    full = t.results.select("match_id", "team1", "team2", "venue", F.col("runs_1").cast("double").alias("score"))
    r = full.withColumn("team1", F.when(F.col("venue") == "5-LOW", "guest").otherwise(F.col("team1"))).drop("venue")
    unknown = (F.col("venue") != "2-HIGH") & (F.col("score") == 0)
    kept = full.withColumn("score", F.when(~unknown, F.col("score")))
    turned = kept.select("match_id", F.col("team2").alias("team1"), F.col("team1").alias("team2"),
                         (F.col("score") + 5).alias("score"))
    fixed = kept.filter("venue = '2-HIGH'").withColumn("score", F.col("score") + 1).drop("venue")
    store = (kept.drop("venue").withColumn("_ver", F.lit(1)).unionByName(turned.withColumn("_ver", F.lit(3)))
             .unionByName(fixed.withColumn("_ver", F.lit(2))))
    return J.fixture_lookup(r.drop("score"), store, {"score": 160.0})


@query("jon9_fuzzy_lookup", """
WITH n AS (SELECT DISTINCT replace(p_name, 'e', '') || CASE WHEN p_size < 10 THEN 'x' ELSE '' END AS raw FROM part),
k AS (SELECT DISTINCT p_name AS known FROM part),
s AS (SELECT raw, known, 1 - levenshtein(raw, known) / greatest(length(raw), length(known))::DOUBLE AS score FROM n, k),
b AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, known) AS rn FROM s WHERE score >= 0.6)
SELECT n.raw, coalesce(b.known, n.raw) AS match, round(b.score, 6) AS score FROM n LEFT JOIN b ON n.raw = b.raw AND rn = 1""")
def jon9(t: Tables):
    part = t.read("part")
    raw = F.concat(F.replace("p_name", F.lit("e"), F.lit("")), F.when(F.col("p_size") < 10, "x").otherwise(""))
    known = part.select(F.col("p_name").alias("known"))
    return rounded(J.fuzzy_lookup(part.select(raw.alias("raw")), known, "raw", "known", 0.6), "score")


@query("jon10_contains_overrides", """
WITH r AS (SELECT DISTINCT lower(substr(p_name, 1, 4)) AS pat, 'group ' || substr(p_name, 1, 4) AS v,
             100 + ascii(p_name) AS o FROM part UNION SELECT 'ring', 'rings', 500),
h AS (SELECT p.p_partkey, arg_max(r.v, r.o * 1000 + ascii(substr(r.pat, 2, 1)) * 4 + ascii(substr(r.pat, 3, 1)) / 200.0) AS v
      FROM part p JOIN r ON contains(lower(p.p_name), r.pat) GROUP BY 1)
SELECT p.p_partkey, p.p_name, coalesce(h.v, p.p_brand) AS team FROM part p LEFT JOIN h ON p.p_partkey = h.p_partkey""")
def jon10(t: Tables):
    part = t.read("part")
    word = F.substring("p_name", 1, 4)
    rules = part.select(F.lower(word).alias("pattern"), F.concat(F.lit("group "), word).alias("new_value"),
                        (F.ascii("p_name") + 100).alias("o")).distinct()
    extra = part.agg(F.lit("ring").alias("pattern"), F.lit("rings").alias("new_value"), F.lit(500).alias("o"))
    rules = rules.union(extra).select("pattern", "new_value", (
        F.col("o") * 1000 + F.ascii(F.substring("pattern", 2, 1)) * 4 + F.ascii(F.substring("pattern", 3, 1)) / 200.0
    ).alias("ord"))
    p = part.select("p_partkey", "p_name", F.col("p_brand").alias("team"))
    return J.contains_override(p, "p_name", rules, "team")


@query("jon11_class_distribution", cte("matches") + """,
a AS (SELECT venue || '|' || team1 AS label, count(*) AS n FROM matches WHERE season < 2000 GROUP BY 1),
b AS (SELECT venue || '|' || team1 AS label, count(*) AS n FROM matches WHERE season >= 2000 GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS train_count, coalesce(b.n, 0) AS test_count
FROM a FULL JOIN b ON a.label = b.label""")
def jon11(t: Tables):
    lab = t.matches.select("season", F.concat_ws("|", "venue", "team1").alias("label"))
    return J.class_distribution(lab.filter("season < 2000"), lab.filter("season >= 2000"), "label")


@query("jon12_roster_multiplier", cte("lineup_long") + """, f AS (
  SELECT l.*, row_number() OVER (PARTITION BY match_id, side ORDER BY player) AS rn, s_suppkey FROM lineup_long l
    LEFT JOIN supplier ON player = 'Player ' || s_suppkey AND match_id % 3 <> 0),
s AS (SELECT match_id, side, CASE CAST(substr(player, 8) AS INTEGER) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.35 ELSE 1.0 END
        + CASE WHEN s_suppkey IS NOT NULL THEN 0.03 ELSE 0 END AS bat, CASE CAST(substr(player, 8) AS INTEGER) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 1.05 ELSE 0.25 END
        + CASE WHEN s_suppkey IS NOT NULL THEN 0.03 ELSE 0 END AS bowl FROM f WHERE rn <= 11)
SELECT match_id, side, round(least(greatest(avg(CAST(bat AS DOUBLE)) / 0.8, 0.88), 1.12), 6) AS bat_multiplier,
  round(least(greatest(avg(CAST(bowl AS DOUBLE)) / 0.8, 0.88), 1.12), 6) AS bowl_multiplier,
  count(*) AS players_used FROM s GROUP BY 1, 2""")
def jon12(t: Tables):
    k = F.substr(F.col("player"), F.lit(8)).cast("int")
    role = F.when(k % 3 == 0, "allrounder").when(k % 3 == 1, "bowler").otherwise("batter")
    roster = t.read("supplier").select(
        F.concat(F.lit("Player "), "s_suppkey").alias("_name"), F.lit(P.ROSTER_BONUS).alias("bonus"))
    rows = L.lineup_rows(t.lineups, F.slice("players", 1, 11), "match_id", "side")
    score = lambda skill: R.role_score(role, skill) + F.coalesce("bonus", F.lit(0.0))
    asked = F.when(F.col("match_id") % 3 == 0, "guest").otherwise(F.col("player"))
    per = rows.withColumn("_name", asked).join(roster, "_name", "left").groupBy("match_id", "side").agg(
        F.avg(score(0)).alias("bat"), F.avg(score(1)).alias("bowl"), F.count("*").alias("players_used"))
    return per.select("match_id", "side", *[F.round(R.squad_multiplier(F.col(c)), 6).alias(f"{c}_multiplier") for c in ("bat", "bowl")],
                      "players_used")


_SIDE_MEANS = """, sm AS (SELECT l.match_id, l.side, """ + ", ".join(
    f"round(coalesce(avg(CASE WHEN v.{c} > 0 THEN v.{c} END), {d}), 5) AS {n}" for c, n, d in (
        ("bat_avg_10", "bat_avg", 25.0), ("bat_sr_10", "bat_sr", 125.0), ("bowl_econ_10", "bowl_eco", 8.5),
        ("bowl_sr_10", "bowl_sr", 20.0))) + """
  FROM lineups l LEFT JOIN (SELECT bv.match_id, bv.player, bat_avg_10, bat_sr_10, bowl_econ_10, bowl_sr_10
    FROM bv LEFT JOIN wv ON bv.match_id = wv.match_id AND bv.player = wv.player) v
  ON l.match_id = v.match_id AND l.player = v.player GROUP BY 1, 2)"""
SIDE_MEANS_SQL = cte("matches", "batting", "bowling", "lineups") + VECTORS_SQL[len(cte("matches", "batting", "bowling")):] + _SIDE_MEANS


def side_means(t: Tables):
    v = priors.player_vectors(t.dated(t.batting), t.dated(t.bowling), span=t.dates)
    v = v.select("match_id", "player", F.col("bat_avg_10").alias("bat_avg"), F.col("bat_sr_10").alias("bat_sr"),
                 F.col("bowl_econ_10").alias("bowl_eco"), F.col("bowl_sr_10").alias("bowl_sr"))
    rows = L.lineup_rows(t.lineups, "players", "match_id", "side")
    return J.lineup_stats(rows, v, P.VECTOR_DEFAULTS)


@query("agg5_positive_mean_with_defaults", SIDE_MEANS_SQL + " SELECT * FROM sm")
def agg5(t: Tables):
    return rounded(side_means(t), *P.VECTOR_DEFAULTS, digits=5)
