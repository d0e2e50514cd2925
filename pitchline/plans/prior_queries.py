"""Point-in-time features over the match-shaped views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline.operators import keyed, priors
from pitchline.plans.registry import query
from pitchline.plans.views import Tables, cte
from pitchline.operators.facts import both_sides, team_long
from pitchline.operators.ordered import Recent, Total, top_n, with_history


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _five(expr: str, key: str = "team", order: str = "match_date, match_id", n: int = 5) -> str:
    return f"{expr} OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _all(expr: str, key: str, order: str = "match_date, match_id") -> str:
    return f"{expr} OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("win1_form_prior_5", cte("long") + f""", f AS (
  SELECT match_id, side, {_five("avg(CASE WHEN winner = team THEN 1 ELSE 0 END)")} AS form FROM long)
SELECT match_id, round(max(CASE WHEN side = 1 THEN form END), 6) AS team1_form,
       round(max(CASE WHEN side = 2 THEN form END), 6) AS team2_form FROM f GROUP BY 1""")
def win1(t: Tables):
    return rounded(priors.team_form(t.matches, span=t.dates), "team1_form", "team2_form")


_RECENT = ["score", "runs_for", "runs_against", "wkts_taken", "pp_rr", "death_rr"]
_RECENT_LONG = """, tl AS (
  SELECT match_id, match_date, side, team,
         CASE WHEN winner = team THEN 1.0::DOUBLE WHEN winner = opponent THEN 0.0 ELSE 0.5 END AS score,
         rf AS runs_for, ra AS runs_against, wt AS wkts_taken,
         6.0::DOUBLE * pp / least(greatest(b, 1), 36) AS pp_rr,
         6.0::DOUBLE * de / greatest(greatest(b, 1) - 96, 1) AS death_rr
  FROM (SELECT match_id, match_date, winner, 1 AS side, team1 AS team, team2 AS opponent, runs_1 AS rf, runs_2 AS ra,
               wkts_2 AS wt, pp_runs_1 AS pp, death_runs_1 AS de, balls_1 AS b FROM results
        UNION ALL
        SELECT match_id, match_date, winner, 2, team2, team1, runs_2, runs_1, wkts_1, pp_runs_2, death_runs_2,
               balls_2 FROM results))"""


@query("win2_recent_means_5", cte("results") + _RECENT_LONG + ", f AS (SELECT match_id, side, " + ", ".join(
    f"coalesce({_five(f'avg({c})')}, {d}) AS {c}"
    for c, d in zip(_RECENT, (0.5, 160.0, 160.0, 6.0, 7.5, 9.5))) + " FROM tl) SELECT match_id, " + ", ".join(
    f"round(max(CASE WHEN side = {s} THEN {c} END), 6) AS team{s}_{c}_5" for s in (1, 2) for c in _RECENT)
    + " FROM f GROUP BY 1")
def win2(t: Tables):
    out = priors.team_recent(t.results, span=t.dates)
    return rounded(out, *[c for c in out.columns if c != "match_id"])


_VENUE_IN = """, v AS (
  SELECT match_id, match_date, venue,
    CASE WHEN balls_1 > 0 AND balls_2 > 0 THEN CASE WHEN f1 THEN runs_1 ELSE runs_2 END END AS fr,
    CASE WHEN balls_1 > 0 AND balls_2 > 0 THEN 6.0::DOUBLE * CASE WHEN f1 THEN pp_runs_1 ELSE pp_runs_2 END
      / least(greatest(CASE WHEN f1 THEN balls_1 ELSE balls_2 END, 1), 36) END AS p1,
    CASE WHEN balls_1 > 0 AND balls_2 > 0 THEN 6.0::DOUBLE * CASE WHEN f1 THEN death_runs_1 ELSE death_runs_2 END
      / greatest(greatest(CASE WHEN f1 THEN balls_1 ELSE balls_2 END, 1) - 96, 1) END AS d1,
    CASE WHEN balls_1 > 0 AND balls_2 > 0 THEN 6.0::DOUBLE * CASE WHEN f1 THEN pp_runs_2 ELSE pp_runs_1 END
      / least(greatest(CASE WHEN f1 THEN balls_2 ELSE balls_1 END, 1), 36) END AS p2,
    CASE WHEN balls_1 > 0 AND balls_2 > 0 THEN 6.0::DOUBLE * CASE WHEN f1 THEN death_runs_2 ELSE death_runs_1 END
      / greatest(greatest(CASE WHEN f1 THEN balls_2 ELSE balls_1 END, 1) - 96, 1) END AS d2
  FROM (SELECT *, (toss_decision = 'bat') = (toss_winner = team1) AS f1 FROM results))"""


@query("win3_venue_means_prior", cte("results") + _VENUE_IN + " SELECT match_id, " + ", ".join(
    f"round(coalesce({_all(f'avg({c})', 'venue')}, {d}) + 1e-9, 6) AS venue_{n}_prior" for c, d, n in (
        ("fr", 165.0, "first_runs"), ("p1", 7.5, "pp_rr_first"), ("d1", 9.5, "death_rr_first"),
        ("p2", 7.3, "pp_rr_second"), ("d2", 9.2, "death_rr_second"))) + " FROM v")
def win3(t: Tables):
    out = priors.venue_phase_means(t.results, span=t.dates)
    # Means of fractions: a tiny shift keeps exact halves from rounding by summation order.
    return out.select("match_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in out.columns if c != "match_id"])


_CHASER = """CASE WHEN toss_decision = 'field' THEN toss_winner
  WHEN toss_winner = team1 THEN team2 ELSE team1 END"""


@query("win4_venue_chase_prior", cte("matches") + f""", g AS (
  SELECT match_id, {_all("count(winner)", "venue")} AS g,
         {_all(f"sum(CASE WHEN winner = {_CHASER} THEN 1 WHEN winner IS NOT NULL THEN 0 END)", "venue")} AS w
  FROM matches)
SELECT match_id, round(CASE WHEN g > 0 THEN (w + 1) / (g + 2) ELSE 0.5 END, 6) AS venue_chase_winrate_prior,
       round(2 * CASE WHEN g > 0 THEN (w + 1) / (g + 2) ELSE 0.5 END - 1, 6) AS venue_score_prior FROM g""")
def win4(t: Tables):
    return rounded(priors.venue_chase(t.matches, span=t.dates), "venue_chase_winrate_prior", "venue_score_prior")


@query("win4_venue_chase_played", cte("results") + f""", g AS (
  SELECT match_id, {_all("sum(CASE WHEN balls_1 > 0 AND balls_2 > 0 THEN 1 ELSE 0 END)", "venue")} AS g,
         {_all(f"sum(CASE WHEN balls_1 > 0 AND balls_2 > 0 AND winner = {_CHASER} THEN 1 ELSE 0 END)", "venue")} AS w
  FROM results)
SELECT match_id, round(CASE WHEN g > 0 THEN (w + 1) / (g + 2) ELSE 0.5 END, 6) AS venue_chase_played_prior FROM g""")
def win4b(t: Tables):
    return rounded(priors.venue_chase_played(t.results, span=t.dates), "venue_chase_played_prior")


@query("win5_head_to_head_ordered", cte("matches") + f"""
SELECT match_id, round(coalesce({_all("avg(CASE WHEN winner = team1 THEN 1 ELSE 0 END)", "team1, team2")}, 0.5), 6)
  AS h2h_team1_winrate_prior FROM matches""")
def win5(t: Tables):
    return rounded(priors.head_to_head(t.matches, span=t.dates), "h2h_team1_winrate_prior")


@query("win6_head_to_head_unordered", cte("matches") + f""", g AS (
  SELECT match_id, team1, least(team1, team2) AS lo,
         {_all("count(winner)", "least(team1, team2), greatest(team1, team2)")} AS g,
         {_all("sum(CASE WHEN winner = least(team1, team2) THEN 1 ELSE 0 END)", "least(team1, team2), greatest(team1, team2)")} AS w
  FROM matches)
SELECT match_id, round(coalesce(CASE WHEN team1 = lo THEN w ELSE g - w END / nullif(g, 0), 0.5), 6)
  AS h2h_any_order_prior FROM g""")
def win6(t: Tables):
    return rounded(priors.head_to_head_any_order(t.matches, span=t.dates), "h2h_any_order_prior")


@query("win7_venue_team_smoothed", cte("long") + f""", g AS (
  SELECT match_id, side, (coalesce({_all("sum(CASE WHEN winner = team THEN 1 ELSE 0 END)", "venue, team")}, 0) + 1)
    / ({_all("count(*)", "venue, team")} + 2) AS r FROM long)
SELECT match_id, round(max(CASE WHEN side = 1 THEN r END), 6) AS team1_venue_winrate,
       round(max(CASE WHEN side = 2 THEN r END), 6) AS team2_venue_winrate FROM g GROUP BY 1""")
def win7(t: Tables):
    return rounded(priors.venue_team(t.matches, span=t.dates), "team1_venue_winrate", "team2_venue_winrate")


@query("win7_venue_team_unsmoothed", cte("long") + f""", g AS (
  SELECT match_id, side, coalesce({_all("sum(CASE WHEN winner = team THEN 1 ELSE 0 END)", "venue, team")}
    / nullif({_all("count(winner)", "venue, team")}, 0), 0.5) AS r FROM long)
SELECT match_id, round(max(CASE WHEN side = 1 THEN r END), 6) AS team1_venue_winrate,
       round(max(CASE WHEN side = 2 THEN r END), 6) AS team2_venue_winrate FROM g GROUP BY 1""")
def win7b(t: Tables):
    out = priors.venue_team(t.matches, smoothed=False, span=t.dates)
    return rounded(out, "team1_venue_winrate", "team2_venue_winrate")


@query("win8_venue_toss_bat_rate", cte("matches") + f""", g AS (
  SELECT match_id, toss_decision, coalesce({_all("avg(CASE WHEN toss_decision = 'bat' THEN 1 ELSE 0 END)", "venue")}, 0.5)
    AS r FROM matches)
SELECT match_id, round(r, 6) AS venue_toss_bat_rate_prior,
       CASE WHEN (r >= 0.5) = (toss_decision = 'bat') THEN 1.0::DOUBLE ELSE 0.0 END AS toss_decision_alignment_prior
FROM g""")
def win8(t: Tables):
    return rounded(priors.venue_toss_habit(t.matches, span=t.dates), "venue_toss_bat_rate_prior")


@query("win9_venue_toss_side_decision", cte("matches") + f""", m AS (
  SELECT *, CASE WHEN toss_winner = team1 THEN 1 ELSE 0 END AS t1 FROM matches)
SELECT match_id, round((coalesce({_all("sum(CASE WHEN winner = team1 THEN 1 ELSE 0 END)", "venue, t1, toss_decision")}, 0) + 1)
  / ({_all("count(*)", "venue, t1, toss_decision")} + 2), 6) AS toss_decision_venue_team1_winrate FROM m""")
def win9(t: Tables):
    return rounded(priors.venue_toss_side(t.matches, span=t.dates), "toss_decision_venue_team1_winrate")


@query("win10_expanding_defaults", cte("results") + f""", tl AS (
  SELECT match_id, match_date, 1 AS side, team1 AS team, winner FROM results
  UNION ALL SELECT match_id, match_date, 2, team2, winner FROM results), f AS (
  SELECT match_id, side, coalesce({_all("avg(CASE WHEN winner = team THEN 1 ELSE 0 END)", "team")}, 0.5) AS r FROM tl),
v AS (SELECT match_id, coalesce({_all("avg(runs_1)", "venue")}, 160.0) AS a FROM results)
SELECT f.match_id, round(max(CASE WHEN side = 1 THEN r END), 6) AS team1_winrate_all,
       round(max(CASE WHEN side = 2 THEN r END), 6) AS team2_winrate_all, round(max(a), 5) AS venue_avg_runs
FROM f JOIN v ON f.match_id = v.match_id GROUP BY 1""")
def win10(t: Tables):
    out = priors.simple_expanding(t.results, span=t.dates)
    return rounded(rounded(out, "team1_winrate_all", "team2_winrate_all"), "venue_avg_runs", digits=5)


_VEC = """, b AS (SELECT b.*, m.match_date FROM batting b JOIN matches m ON b.match_id = m.match_id),
w AS (SELECT b.*, m.match_date FROM bowling b JOIN matches m ON b.match_id = m.match_id),
bs AS (SELECT match_id, player, {r} AS r, {bl} AS bl, {o} AS o FROM b),
ws AS (SELECT match_id, player, {wk} AS wk, {rg} AS rg, {bb} AS bb FROM w),
bv AS (SELECT match_id, player, coalesce(r / CASE WHEN o = 0 THEN 1 ELSE o END, 0) AS bat_avg_10,
              coalesce(r / CASE WHEN bl = 0 THEN 1 ELSE bl END * 100, 0) AS bat_sr_10 FROM bs),
wv AS (SELECT match_id, player, coalesce(rg / CASE WHEN wk = 0 THEN 1 ELSE wk END, 0) AS bowl_avg_10,
              coalesce(rg / (CASE WHEN bb = 0 THEN 6 ELSE bb END / 6.0::DOUBLE), 0) AS bowl_econ_10,
              coalesce(bb / CASE WHEN wk = 0 THEN 1 ELSE wk END, 0) AS bowl_sr_10 FROM ws)""".format(**{
    k: _five(f"sum({c})", "player", n=10) for k, c in (
        ("r", "runs"), ("bl", "balls"), ("o", "outs"), ("wk", "wickets"), ("rg", "runs_given"), ("bb", "balls_bowled"))
})
VECTORS_SQL = cte("matches", "batting", "bowling") + _VEC


@query("win11_player_rolling_10", VECTORS_SQL + """
SELECT coalesce(bv.match_id, wv.match_id) AS match_id, coalesce(bv.player, wv.player) AS player, """ + ", ".join(
    f"round(coalesce({c}, 0), 5) AS {c}" for c in ("bat_avg_10", "bat_sr_10", "bowl_avg_10", "bowl_econ_10", "bowl_sr_10"))
    + " FROM bv FULL JOIN wv ON bv.match_id = wv.match_id AND bv.player = wv.player")
def win11(t: Tables):
    out = priors.player_vectors(t.dated(t.batting), t.dated(t.bowling), span=t.dates)
    return rounded(out, "bat_avg_10", "bat_sr_10", "bowl_avg_10", "bowl_econ_10", "bowl_sr_10", digits=5)


@query("win12_lineup_continuity", cte("lineups", "long") + """, p AS (
  SELECT g.match_id, g.match_date, g.side, g.team, coalesce(list(l.player) FILTER (l.player IS NOT NULL), []) AS players
  FROM long g LEFT JOIN lineups l ON l.match_id = g.match_id AND l.side = g.side GROUP BY 1, 2, 3, 4),
q AS (SELECT match_id, side, players, lag(players) OVER (PARTITION BY team ORDER BY match_date, match_id) AS prev FROM p)
SELECT match_id, CAST(side AS INTEGER) AS side, round(CASE WHEN prev IS NULL OR len(prev) = 0 THEN 0.5
  ELSE len(list_intersect(players, prev)) / greatest(len(players), 1)::DOUBLE END, 6) AS xi_continuity FROM q""")
def win12(t: Tables):
    sides = team_long(t.matches.select("match_id", "match_date", "team1", "team2"))
    packed = sides.join(t.lineups, ["match_id", "side"], "left").select(
        "match_id", "match_date", "side", "team", F.coalesce("players", F.array().cast("array<string>")).alias("players"))
    return rounded(priors.lineup_continuity(packed, span=t.dates), "xi_continuity")


@query("win13_player_availability", cte("lineups", "long") + """, once AS (
  SELECT DISTINCT l.player, l.match_id, g.match_date FROM lineups l JOIN long g ON l.match_id = g.match_id AND l.side = g.side),
q AS (SELECT *, match_date - lag(match_date) OVER (PARTITION BY player ORDER BY match_date, match_id) AS gap FROM once),
a AS (SELECT g.match_id, g.side, coalesce(avg(CASE WHEN l.player IS NULL THEN NULL WHEN gap <= 450 THEN 1 ELSE 0 END), 0.5) AS r
      FROM long g LEFT JOIN lineups l ON l.match_id = g.match_id AND l.side = g.side
        LEFT JOIN q ON q.player = l.player AND q.match_id = l.match_id GROUP BY 1, 2)
SELECT match_id, CAST(side AS INTEGER) AS side, round(r, 6) AS availability, round(1 - r, 6) AS injury_proxy FROM a""")
def win13(t: Tables):
    sides = team_long(t.matches.select("match_id", "team1", "team2"))
    out = priors.player_availability(t.lineup_long, sides, span=t.dates)
    return rounded(out, "availability", "injury_proxy")


_STORE = ["win", "runs_for", "runs_against", "wkts_taken", "pp_rr", "death_rr"]
_STORE_SQL = cte("results", "lineups") + """, gaps AS (
  SELECT * REPLACE (CASE WHEN match_id % 11 <> 0 THEN toss_winner END AS toss_winner,
    CASE WHEN balls_1 > 0 THEN runs_1 END AS runs_1, CASE WHEN balls_2 > 0 THEN runs_2 END AS runs_2,
    CASE WHEN match_id % 7 <> 0 AND balls_1 > 0 THEN pp_runs_1 END AS pp_runs_1,
    CASE WHEN match_id % 7 <> 0 AND balls_2 > 0 THEN pp_runs_2 END AS pp_runs_2) FROM results),
tl AS (
  SELECT match_id, match_date, 1 AS side, team1 AS team, winner, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS win,
         runs_1 AS runs_for, runs_2 AS runs_against, wkts_2 AS wkts_taken,
         coalesce(pp_runs_1 / 6.0::DOUBLE, CASE WHEN balls_1 > 0 THEN runs_1 / (balls_1 / 6.0::DOUBLE) END) AS pp_rr,
         CASE WHEN balls_1 > 0 THEN runs_1 / (balls_1 / 6.0::DOUBLE) END AS death_rr FROM gaps
  UNION ALL
  SELECT match_id, match_date, 2, team2, winner, CASE WHEN winner = team2 THEN 1 ELSE 0 END, runs_2, runs_1, wkts_1,
         coalesce(pp_runs_2 / 6.0::DOUBLE, CASE WHEN balls_2 > 0 THEN runs_2 / (balls_2 / 6.0::DOUBLE) END),
         CASE WHEN balls_2 > 0 THEN runs_2 / (balls_2 / 6.0::DOUBLE) END FROM gaps),
o AS (SELECT *, 1 + count(winner) OVER (PARTITION BY team ORDER BY match_date, match_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ord FROM tl),
f AS (SELECT match_id, side, """ + ", ".join(
    f"""coalesce(avg(CASE WHEN winner IS NOT NULL THEN {c} END) OVER (PARTITION BY team ORDER BY ord
      RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), {d}) AS {c}"""
    for c, d in zip(_STORE, (0.5, 160.0, 160.0, 7.0, 8.0, 10.0))) + """ FROM o),
t AS (SELECT match_id, """ + ", ".join(
    f"max(CASE WHEN side = {s} THEN {c} END) AS team{s}_{c}_5" for s in (1, 2) for c in _STORE) + """ FROM f GROUP BY 1),
vi AS (SELECT match_id, match_date, venue, winner,
         CASE WHEN toss_winner IS NULL THEN NULL WHEN (toss_decision = 'bat') = (toss_winner = team1) THEN runs_1 ELSE runs_2 END AS fr,
         CASE WHEN toss_winner IS NULL THEN NULL WHEN winner = """ + _CHASER + """ THEN 1 ELSE 0 END AS ch FROM gaps),
v AS (SELECT match_id, """ + f"""coalesce({_all("avg(CASE WHEN winner IS NOT NULL THEN fr END)", "venue")}, 170.0) AS fa,
       coalesce({_all("avg(CASE WHEN winner IS NOT NULL THEN ch END)", "venue")}, 0.5) AS ca FROM vi),
h AS (SELECT match_id, {_all("count(winner)", "least(team1, team2), greatest(team1, team2)")} AS g,
        {_all("sum(CASE WHEN winner = least(team1, team2) THEN 1 ELSE 0 END)", "least(team1, team2), greatest(team1, team2)")} AS w
      FROM results),
a AS (SELECT match_id, side, coalesce({_all("sum(win)", "venue, team")} / nullif({_all("count(winner)", "venue, team")}, 0), 0.5) AS r
      FROM (SELECT tl.*, m.venue FROM tl JOIN matches m ON tl.match_id = m.match_id)),
seats AS (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY player) AS seat FROM lineups),
rated AS (SELECT seats.*, coalesce(1000 + s_acctbal / 10, 1000) AS rating FROM seats
  LEFT JOIN supplier ON player = 'Player ' || s_suppkey AND s_suppkey % 5 <> 0 WHERE seat <= 11),
xi AS (SELECT match_id, side, list(player ORDER BY seat) AS xi, (sum(rating) + 1000 * (11 - count(*))) / 11 AS ravg,
    CASE WHEN count(*) < 11 THEN greatest(max(rating), 1000) ELSE max(rating) END AS rmax,
    CASE WHEN count(*) < 11 THEN least(min(rating), 1000) ELSE min(rating) END AS rmin FROM rated GROUP BY 1, 2)
SELECT m.match_id, m.match_date, m.team1, m.team2, m.venue, m.winner,
  coalesce(z.toss_winner, m.team1) AS toss_winner, m.toss_decision, round(fa, 5) AS venue_score_prior, """ + ", ".join(
    f"round(team{s}_{c}_5, 6) AS team{s}_{c}_5" for s in (1, 2) for c in _STORE) + """,
  round(fa, 5) AS venue_avg_first_innings_runs_prior, round(ca, 6) AS venue_chase_winrate_prior,
  round(coalesce(CASE WHEN m.team1 < m.team2 THEN w ELSE g - w END / nullif(g, 0), 0.5), 6) AS h2h_any_order_prior,
  round(a1.r, 6) AS team1_venue_winrate, round(a2.r, 6) AS team2_venue_winrate,
  """ + ", ".join(f"round(coalesce(x{s}.ravg, 1000), 5) AS team{s}_rating_avg, coalesce(x{s}.rmax, 1000) AS team{s}_rating_max, coalesce(x{s}.rmin, 1000) AS team{s}_rating_min"
                  for s in (1, 2)) + """, round(coalesce(x1.ravg, 1000) - coalesce(x2.ravg, 1000), 5) AS rating_gap, """ + ", ".join(
    f"coalesce(x{s}.xi[{i}], 'Unknown_Player_{i}') AS team{s}_player_{i}" for s in (1, 2) for i in range(1, 12)) + """
FROM matches m JOIN gaps z ON z.match_id = m.match_id LEFT JOIN xi x1 ON x1.match_id = m.match_id AND x1.side = 1
  LEFT JOIN xi x2 ON x2.match_id = m.match_id AND x2.side = 2 JOIN t ON t.match_id = m.match_id JOIN v ON v.match_id = m.match_id JOIN h ON h.match_id = m.match_id
  JOIN a a1 ON a1.match_id = m.match_id AND a1.side = 1 JOIN a a2 ON a2.match_id = m.match_id AND a2.side = 2"""


@query("win14_feature_store_rows", _STORE_SQL)
def win14(t: Tables):
    m, known = t.results, lambda side: F.col(f"balls_{side}") > 0
    gaps = m.withColumns({  # unknown tosses, scores and powerplays
        "toss_winner": F.when(F.col("match_id") % 11 != 0, F.col("toss_winner")),
        **{f"runs_{s}": F.when(known(s), F.col(f"runs_{s}")) for s in (1, 2)},
        **{f"pp_runs_{s}": F.when(known(s) & (F.col("match_id") % 7 != 0), F.col(f"pp_runs_{s}")) for s in (1, 2)}})
    out = keyed.store_features(gaps, span=t.dates)
    ratings = t.read("supplier").filter("s_suppkey % 5 <> 0").select(
        F.concat(F.lit("Player "), "s_suppkey").alias("player"), (1000 + F.col("s_acctbal") / 10).alias("rating"))
    long = ["venue_avg_first_innings_runs_prior", "venue_score_prior", "team1_rating_avg", "team2_rating_avg", "rating_gap"]
    short = [c for c, kind in out.dtypes if kind == "double" and c not in long]
    return rounded(rounded(keyed.with_lineups(out, t.lineups, ratings), *short), *long, digits=5)


@query("win15_latest_choice", cte("long") + """
SELECT team, match_id, match_date, rn FROM (
  SELECT team, match_id, match_date,
         CAST(row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS INTEGER) AS rn FROM long)
WHERE rn <= 3""")
def win15(t: Tables):
    from pyspark.sql import Window as W

    w = W.partitionBy("team").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    long = team_long(t.matches.select("match_id", "match_date", "team1", "team2"))
    return long.select("team", "match_id", "match_date", F.row_number().over(w).alias("rn")).filter("rn <= 3")
