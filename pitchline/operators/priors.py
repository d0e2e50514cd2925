"""Point-in-time features: what was known before each match.

Every function takes the match table, adds columns and never reads the row's
own outcome.  All histories of one key share a single ordered pass.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from pitchline import presets as P
from pitchline.functions import lineups as L, rules as R
from pitchline.operators.facts import both_sides, team_long
from pitchline.operators.ordered import Recent, Span, Total, long_keys, with_history
from pitchline.session import durable, stored

ORDER = ["match_date", "match_id"]


def win_flag(winner: Column, team: Column) -> Column:
    return R.flag(winner == team)


def team_form(matches: DataFrame, n: int = 5, span: Span | None = None) -> DataFrame:
    """Win share over each side's previous n matches; null on its first."""
    long = team_long(matches.select(*ORDER, "team1", "team2", "winner"))
    spec = Recent("form", win_flag(F.col("winner"), F.col("team")), n)
    out = with_history(long, ["team"], ORDER, [spec], span=span)
    return both_sides(out, ["match_id"], ["form"])


def team_recent(results: DataFrame, n: int = 5, span: Span | None = None) -> DataFrame:
    """Form, runs for/against, wickets taken, powerplay and death rates, with defaults."""
    d = P.BALL_DEFAULTS
    pair = lambda f: (f(1, 2), f(2, 1))
    long = team_long(results, {
        "score": pair(lambda a, b: R.side_score(F.col("winner"), F.col(f"team{a}"), F.col(f"team{b}"))),
        "runs_for": pair(lambda a, b: F.col(f"runs_{a}")),
        "runs_against": pair(lambda a, b: F.col(f"runs_{b}")),
        "wkts_taken": pair(lambda a, b: F.col(f"wkts_{b}")),
        "pp_rr": pair(lambda a, b: R.powerplay_rate(F.col(f"pp_runs_{a}"), F.col(f"balls_{a}"))),
        "death_rr": pair(lambda a, b: R.death_rate(F.col(f"death_runs_{a}"), F.col(f"balls_{a}"))),
    }).select(*ORDER, "side", "team", "score", "runs_for", "runs_against", "wkts_taken", "pp_rr", "death_rr")
    fill = {
        "score": d["form"], "runs_for": d["runs"], "runs_against": d["runs"], "wkts_taken": d["wkts"],
        "pp_rr": d["pp_rr"], "death_rr": d["death_rr"],
    }
    specs = [Recent(f"{c}_{n}", F.col(c), n) for c in fill]
    out = with_history(long, ["team"], ORDER, specs, span=span)
    out = out.withColumns({f"{c}_{n}": F.coalesce(f"{c}_{n}", F.lit(v)) for c, v in fill.items()})
    return both_sides(out, ["match_id"], [f"{c}_{n}" for c in fill])


def venue_phase_means(results: DataFrame, span: Span | None = None) -> DataFrame:
    """Mean first-innings runs and phase rates at the venue before the match."""
    d = P.BALL_DEFAULTS
    first1 = R.batting_first(*_toss()) == F.col("team1")
    side = lambda c, first: F.when(first1 == first, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    values = {
        "first_runs": (side("runs", True), d["first_runs"]),
        "pp_rr_first": (R.powerplay_rate(side("pp_runs", True), side("balls", True)), d["pp_rr"]),
        "death_rr_first": (R.death_rate(side("death_runs", True), side("balls", True)), d["death_rr"]),
        "pp_rr_second": (R.powerplay_rate(side("pp_runs", False), side("balls", False)), d["pp_rr_second"]),
        "death_rr_second": (R.death_rate(side("death_runs", False), side("balls", False)), d["death_rr_second"]),
    }
    played = (F.col("balls_1") > 0) & (F.col("balls_2") > 0)
    base = results.select(*ORDER, "venue", *[F.when(played, v).alias(f"_{n}") for n, (v, _) in values.items()])
    specs = [s for n in values for s in (Total(f"{n}_sum", F.col(f"_{n}")), Total(f"{n}_n", F.col(f"_{n}"), "count"))]
    out = with_history(base, ["venue"], ORDER, specs, span=span)
    return out.select("match_id", *[
        F.coalesce(F.col(f"{n}_sum") / F.nullif(F.col(f"{n}_n"), F.lit(0)), F.lit(v)).alias(f"venue_{n}_prior")
        for n, (_, v) in values.items()
    ])


def _toss() -> tuple[Column, Column, Column, Column]:
    return F.col("toss_winner"), F.col("toss_decision"), F.col("team1"), F.col("team2")


def venue_chase(matches: DataFrame, span: Span | None = None) -> DataFrame:
    """Smoothed chase win rate by toss-derived order, and its signed score."""
    chase_won = R.flag(F.col("winner") == R.chasing_side(*_toss()))
    known = F.col("toss_winner").isNotNull() & F.col("winner").isNotNull()
    specs = [Total("_g", F.when(known, 1), "count"), Total("_w", F.when(known, chase_won))]
    out = with_history(matches, ["venue"], ORDER, specs, span=span)
    rate = F.when(F.col("_g") > 0, R.smoothed_rate(F.col("_w"), F.col("_g"))).otherwise(0.5)
    return out.select("match_id", rate.alias("venue_chase_winrate_prior"),
                      R.signed_score(rate).alias("venue_score_prior"))


def venue_chase_played(results: DataFrame, span: Span | None = None) -> DataFrame:
    """Smoothed chase rate where both innings were really played."""
    played = (F.col("balls_1") > 0) & (F.col("balls_2") > 0)
    won = R.flag(F.col("winner") == R.chasing_side(*_toss()))
    specs = [Total("_g", F.when(played, 1), "count"), Total("_w", F.when(played, won))]
    out = with_history(results.select(*ORDER, "venue", "toss_winner", "toss_decision", "team1", "team2", "winner",
                                      "balls_1", "balls_2"), ["venue"], ORDER, specs, span=span)
    rate = F.when(F.col("_g") > 0, R.smoothed_rate(F.col("_w"), F.col("_g"))).otherwise(0.5)
    return out.select("match_id", rate.alias("venue_chase_played_prior"))


def head_to_head(matches: DataFrame, span: Span | None = None) -> DataFrame:
    """Side 1's win share in earlier meetings in the same order of sides."""
    specs = [Total("_g", F.lit(1), "count"), Total("_w", win_flag(F.col("winner"), F.col("team1")))]
    out = with_history(matches, ["team1", "team2"], ORDER, specs, span=span)
    rate = F.col("_w") / F.nullif(F.col("_g"), F.lit(0))
    return out.select("match_id", F.coalesce(rate, F.lit(P.BALL_DEFAULTS["h2h"])).alias("h2h_team1_winrate_prior"))


def head_to_head_any_order(matches: DataFrame, span: Span | None = None) -> DataFrame:
    """Side 1's win share in earlier decided meetings, either order of sides."""
    lo, hi = F.least("team1", "team2"), F.greatest("team1", "team2")
    m = matches.withColumns({"_lo": lo, "_hi": hi})
    decided = F.col("winner").isNotNull()
    specs = [Total("_g", F.when(decided, 1), "count"), Total("_w", F.when(decided, R.flag(F.col("winner") == F.col("_lo"))))]
    out = with_history(m, ["_lo", "_hi"], ORDER, specs, span=span)
    wins = F.when(F.col("team1") == F.col("_lo"), F.col("_w")).otherwise(F.col("_g") - F.col("_w"))
    rate = wins / F.nullif(F.col("_g"), F.lit(0))
    return out.select("match_id", F.coalesce(rate, F.lit(0.5)).alias("h2h_any_order_prior"))


def venue_team(matches: DataFrame, smoothed: bool = True, span: Span | None = None) -> DataFrame:
    """Each side's earlier win rate at the venue."""
    long = team_long(matches.select(*ORDER, "venue", "team1", "team2", "winner"))
    counted = F.lit(1) if smoothed else F.when(F.col("winner").isNotNull(), 1)
    specs = [Total("_g", counted, "count"), Total("_w", win_flag(F.col("winner"), F.col("team")))]
    out = with_history(long, ["venue", "team"], ORDER, specs, span=span)
    if smoothed:
        rate = R.smoothed_rate(F.col("_w"), F.col("_g"))
    else:
        rate = F.coalesce(F.col("_w") / F.nullif(F.col("_g"), F.lit(0)), F.lit(0.5))
    return both_sides(out.withColumn("venue_winrate", rate), ["match_id"], ["venue_winrate"])


def venue_toss_habit(matches: DataFrame, span: Span | None = None) -> DataFrame:
    """Share of earlier tosses at the venue that chose to bat, and what follows from it."""
    known = F.col("toss_decision").isin("bat", "field")
    specs = [
        Total("_n", F.when(known, 1), "count"),
        Total("_bat", F.when(known, R.flag(F.col("toss_decision") == "bat"))),
    ]
    out = with_history(matches, ["venue"], ORDER, specs, span=span)
    rate = F.coalesce(F.col("_bat") / F.nullif(F.col("_n"), F.lit(0)), F.lit(P.BALL_DEFAULTS["toss_bat"]))
    return out.select("match_id", rate.alias("venue_toss_bat_rate_prior"),
                      R.toss_alignment(F.col("toss_decision"), rate).alias("toss_decision_alignment_prior"))


def venue_toss_side(matches: DataFrame, span: Span | None = None) -> DataFrame:
    """Smoothed side-1 win rate by venue, toss side and decision."""
    m = matches.withColumn("_t1", R.flag(F.col("toss_winner") == F.col("team1")))
    known = F.col("toss_winner").isin(F.col("team1"), F.col("team2"))
    specs = [Total("_g", F.when(known, 1), "count"),
             Total("_w", F.when(known, win_flag(F.col("winner"), F.col("team1"))))]
    out = with_history(m, ["venue", "_t1", "toss_decision"], ORDER, specs, span=span)
    return out.select("match_id", R.smoothed_rate(F.col("_w"), F.col("_g")).alias("toss_decision_venue_team1_winrate"))


def simple_expanding(results: DataFrame, span: Span | None = None) -> DataFrame:
    """Earlier win rate per side (.5) and earlier first-innings mean per venue (160)."""
    base = durable(results.select(*ORDER, "venue", "team1", "team2", "winner", "runs_1"))
    long = team_long(base)
    t = with_history(long, ["team"], ORDER, [
        Total("_g", F.lit(1), "count"), Total("_w", win_flag(F.col("winner"), F.col("team"))),
    ], span=span)
    rate = F.coalesce(F.col("_w") / F.nullif(F.col("_g"), F.lit(0)), F.lit(0.5))
    teams = both_sides(t.withColumn("winrate_all", rate), ["match_id"], ["winrate_all"])
    v = with_history(base, ["venue"], ORDER, [Total("_n", F.col("runs_1"), "count"), Total("_s", F.col("runs_1"))], span=span)
    mean = F.coalesce(F.col("_s") / F.nullif(F.col("_n"), F.lit(0)), F.lit(160.0))
    return teams.join(v.select("match_id", mean.alias("venue_avg_runs")), "match_id")


def _guard(x: Column) -> Column:
    return F.when(x == 0, F.lit(1)).otherwise(x)


def player_vectors(batting: DataFrame, bowling: DataFrame, n: int = 10, span: Span | None = None) -> DataFrame:
    """Batting and bowling rates over a player's previous n matches in that role, zero-filled, one row per match.

    Both roles are one history, keyed by player and role.
    """
    roles = {"bat": (batting, ("runs", "balls", "outs")), "bowl": (bowling, ("wickets", "runs_given", "balls_bowled"))}
    parts = [df.select(*ORDER, "player", F.lit(role).alias("_role"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)])
             for role, (df, cols) in roles.items()]
    # Three branches of the history read these aggregated rows; the joins behind them run once.
    rows = stored(parts[0].unionByName(parts[1]))
    specs = [Recent(f"_s{i}", F.col(f"_v{i}"), n, "sum") for i in range(3)]
    keys = ["player", "_role"]
    out = with_history(rows, keys, ORDER, specs, span=span, long=long_keys(rows, keys))
    a, b, c = F.col("_s0"), F.col("_s1"), F.col("_s2")
    rates = {
        "bat": {"bat_avg_10": a / _guard(c), "bat_sr_10": a / _guard(b) * 100},
        "bowl": {"bowl_avg_10": b / _guard(a), "bowl_econ_10": b / _guard(c / 6), "bowl_sr_10": c / _guard(a)},
    }
    return out.groupBy("match_id", "player").agg(*[
        F.coalesce(F.max(F.when(F.col("_role") == role, rate)), F.lit(0.0)).alias(name)
        for role, by_name in rates.items() for name, rate in by_name.items()])


def lineup_continuity(lineups: DataFrame, span: Span | None = None) -> DataFrame:
    """Share of a side's lineup (array ``players``) seen in its previous lineup."""
    spec = Recent("_prev", F.col("players"), 1, "last")
    out = with_history(lineups, ["team"], ORDER, [spec], span=span)
    share = L.continuity(F.col("players"), F.col("_prev"), P.BALL_DEFAULTS["continuity"])
    return out.select("match_id", "side", share.alias("xi_continuity"))


def player_availability(
    lineup_rows: DataFrame, sides: DataFrame, days: int = P.SEEN_WITHIN_DAYS, span: Span | None = None
) -> DataFrame:
    """Share of a side's players seen within the last ``days``; complement as injury proxy.

    ``sides`` lists every (match_id, side); one without players is at .5. A
    player named by both sides of a match is no earlier sight of himself.
    """
    spec = Recent("_seen", F.col("match_date"), 1, "last")
    once = lineup_rows.groupBy("player", *ORDER).agg(F.collect_set("side").alias("_sides"))
    once = stored(once)
    out = with_history(once, ["player"], ORDER, [spec], span=span, long=long_keys(once, ["player"]))
    active = F.coalesce(F.datediff("match_date", "_seen") <= days, F.lit(False)).cast("int")
    per = out.select("match_id", F.explode("_sides").alias("side"), active.alias("_active")).groupBy("match_id", "side").agg(
        (F.sum("_active") / F.count("*")).alias("availability"))
    every = sides.select("match_id", "side").join(per, ["match_id", "side"], "left")
    share = F.coalesce("availability", F.lit(P.BALL_DEFAULTS["availability"]))
    return every.select("match_id", "side", share.alias("availability"), (1 - share).alias("injury_proxy"))


def completed_state(
    df: DataFrame, keys: list[str], done: Column, specs: list, span: Span | None = None, order: list[str] = ORDER
) -> DataFrame:
    """Add struct ``before``: the spec values over the key's earlier completed rows, in one history."""
    known = F.coalesce(done, F.lit(False))
    only = [replace(s, where=known, inclusive=False) if isinstance(s, Recent)
            else replace(s, value=F.when(known, s.value), inclusive=False) for s in specs]
    out = with_history(df, keys, order, only, span=span)
    return out.select(*df.columns, F.struct(*[s.name for s in specs]).alias("before"))
