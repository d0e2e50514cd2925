"""Rows to predict from: fixtures as a feed names them, or as a calendar lists them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitchline import presets as P
from pitchline.functions import rules as R, text as X
from pitchline.operators import aggregates as A, joins as J, priors
from pitchline.operators.facts import both_sides, team_long
from pitchline.operators.ordered import Recent, Span
from pitchline.session import durable

SKILLS = ("bat_avg", "bat_sr", "bowl_eco", "bowl_sr")


def resolved(df: DataFrame, columns: Sequence[str], known: DataFrame, cutoff: float) -> DataFrame:
    """Raw names as the known names they stand for: by alias, else by the nearest one, else as they are.

    ``known`` has one column.  Distinct raw names are matched once, however
    many rows and columns hold them.
    """
    target = known.columns[0]
    clean = df.withColumns({c: X.canonical(F.col(c), P.TEAM_ALIASES) for c in columns})
    asked = clean.select(F.explode(F.array(*columns)).alias("_raw")).filter("_raw <> ''").distinct()
    found = J.fuzzy_lookup(asked, known.select(F.col(target).alias("_known")), "_raw", "_known", cutoff).select("_raw", "match")
    out = clean
    for c in columns:
        out = out.join(found.select(F.col("_raw").alias(c), F.col("match").alias("_match")), c, "left").withColumn(
            c, F.coalesce("_match", c)).drop("_match")
    return out.select(*df.columns)


def squad_multipliers(sides: DataFrame, roster: DataFrame, squad: str = "squad", slots: int = 11) -> DataFrame:
    """(match_id, side, bat_multiplier, bowl_multiplier, players_used) of the first ``slots`` of each announced squad.

    ``sides``: match_id, side, team and the squad, an array of (name, role);
    ``roster``: team, player.  A player the roster knows scores a little more.
    """
    picked = sides.select("match_id", "side", "team", F.explode(F.slice(squad, 1, slots)).alias("_p"))
    picked = picked.withColumn("_key", F.nullif(X.join_key(F.col("_p.name")), F.lit("")))
    local = roster.select("team", X.join_key(F.col("player")).alias("_key"), F.lit(P.ROSTER_BONUS).alias("_bonus")).distinct()
    score = lambda skill: R.role_score(F.col("_p.role"), skill) + F.coalesce("_bonus", F.lit(0.0))
    per = picked.join(local, ["team", "_key"], "left").groupBy("match_id", "side").agg(
        F.avg(score(0)).alias("_bat"), F.avg(score(1)).alias("_bowl"), F.count("*").alias("players_used"))
    return per.select("match_id", "side", R.squad_multiplier(F.col("_bat")).alias("bat_multiplier"),
                      R.squad_multiplier(F.col("_bowl")).alias("bowl_multiplier"), "players_used")


def form_before(sides: DataFrame, finals: DataFrame, n: int = 5, span: Span | None = None) -> DataFrame:
    """``sides`` (match_id, match_date, side, team) with the win share of the team's last n finals of earlier dates."""
    long = team_long(finals.select("match_id", "match_date", "team1", "team2", "winner"))
    past = long.select("match_date", F.lit(0).alias("probe"), "match_id", "side", "team", R.flag(F.col("winner") == F.col("team")).alias("win"))
    asks = sides.select("match_date", F.lit(-1).alias("probe"), "match_id", "side", "team", F.lit(None).cast("int").alias("win"))
    out = priors.completed_state(past.unionByName(asks), ["team"], F.col("probe") == 0, [Recent("form", F.col("win"), n)],
                                 span, ["match_date", "probe", "match_id"])
    return out.filter("probe = -1").select("match_id", "side", F.coalesce("before.form", F.lit(P.BALL_DEFAULTS["form"])).alias("form"))


def live_rows(
    fixtures: DataFrame, finals: DataFrame, log: DataFrame, teams: DataFrame, venues: DataFrame, roster: DataFrame,
    span: Span | None = None
) -> DataFrame:
    """Every feature of announced fixtures, many at once.

    ``fixtures``: match_id, match_date, team1, team2, venue, toss_winner and
    toss_decision as the feed writes them, team1_squad and team2_squad (null
    where the feed gave none).  ``finals``: decided matches; ``log``: the
    prediction log; ``teams`` and ``venues``: profiles; ``roster``: team,
    player.  Sides and venues without a profile take the neutral one.
    """
    f = resolved(fixtures, ["team1", "team2", "toss_winner"], teams.select("team"), P.TEAM_CUTOFF)
    f = resolved(f, ["venue"], venues.select("venue"), P.VENUE_CUTOFF)
    # Sides, form, squads and the rows themselves read the named fixtures; the names are matched once.
    f = durable(f.withColumn("toss_decision", R.toss_choice(F.coalesce("toss_decision", F.lit("field")))))
    pair = (F.col("team1_squad"), F.col("team2_squad"))
    sides = team_long(f.select("match_id", "match_date", "team1", "team2", "team1_squad", "team2_squad"), {"squad": pair}).select(
        "match_id", "match_date", "side", "team", "squad")
    logged = team_long(log.select("match_id", "match_date", "team1", "team2", "actual"))
    rows = (sides.drop("squad").join(form_before(sides, finals, span=span), ["match_id", "side"])
            .join(squad_multipliers(sides, roster), ["match_id", "side"], "left")
            .join(A.recent_team_form(logged), "team", "left").join(teams.select("team", *SKILLS), "team", "left"))
    bat, bowl = F.coalesce("bat_multiplier", F.lit(1.0)), F.coalesce("bowl_multiplier", F.lit(1.0))
    skill = lambda c: F.coalesce(c, F.lit(P.TEAM_PROFILE_DEFAULTS[c]))
    rows = rows.select(
        "match_id", "side", R.blend(F.col("form"), F.col("recent_form"), 0.7).alias("form_winrate_5"),
        *[(skill(c) * bat).alias(c) for c in SKILLS[:2]], *[(skill(c) / bowl).alias(c) for c in SKILLS[2:]],
        bat.alias("bat_multiplier"), bowl.alias("bowl_multiplier"), F.coalesce("players_used", F.lit(0)).alias("players_used"))
    wide = both_sides(rows, ["match_id"], [c for c in rows.columns if c not in ("match_id", "side")])
    d = P.VENUE_PROFILE_DEFAULTS
    out = (f.drop("team1_squad", "team2_squad").join(wide, "match_id").join(venues.select("venue", *d), "venue", "left").fillna(d)
           .join(A.recent_venue_stats(log), "venue", "left"))
    out = out.withColumns({"venue_score_prior": R.blend(F.col("venue_score_prior"), F.col("avg_score"), 0.8),
                           "toss_advantage": R.blend(F.col("toss_advantage"), F.col("toss_share"), 0.8)})
    dew = R.live_dew_flag(F.col("toss_decision"), F.col("venue_chase_winrate_prior"))
    return out.withColumn("is_high_dew", dew).drop("avg_score", "toss_share")


def future_rows(fixtures: DataFrame, teams: DataFrame, context: dict | None = None) -> DataFrame:
    """Calendar fixtures (match_id, team1, team2, venue) before anything is known of the day.

    Each side brings the means of its likely lineup (``teams``: team and the
    four skills, neutral where missing); the rest is the preset context.  Side
    1 is taken to win the toss.
    """
    out = fixtures
    for s in (1, 2):
        side = teams.select(F.col("team").alias(f"team{s}"), *[F.col(c).alias(f"team{s}_{c}") for c in SKILLS])
        out = out.join(side, f"team{s}", "left")
    out = out.fillna({f"team{s}_{c}": P.VECTOR_DEFAULTS[c] for s in (1, 2) for c in SKILLS})
    preset = {**P.FUTURE_CONTEXT, **(context or {})}
    return out.withColumns({"toss_winner": F.col("team1"), **{c: F.lit(v) for c, v in preset.items()}})
