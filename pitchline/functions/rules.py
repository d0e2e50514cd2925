"""Match rules as column expressions: toss, sides, rates, flags and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitchline import presets as P


def other_side(team: Column, team1: Column, team2: Column) -> Column:
    return F.when(team == team1, team2).otherwise(team1)


def batting_first(toss_winner: Column, decision: Column, team1: Column, team2: Column) -> Column:
    """Side that bats first; null when the toss is unknown."""
    return F.when(decision == "bat", toss_winner).when(
        (decision == "field") & toss_winner.isNotNull(), other_side(toss_winner, team1, team2)
    )


def chasing_side(toss_winner: Column, decision: Column, team1: Column, team2: Column) -> Column:
    """Side that bats second; null when the toss is unknown."""
    return F.when(decision == "field", toss_winner).when(
        (decision == "bat") & toss_winner.isNotNull(), other_side(toss_winner, team1, team2)
    )


def toss_choice(text: Column) -> Column:
    """bat / field; anything else counts as field."""
    return F.when(F.lower(F.trim(text)).isin("bat", "batting"), F.lit("bat")).otherwise(F.lit("field"))


def toss_choice_strict(text: Column) -> Column:
    """bat / field / unknown."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin("bat", "field"), low).otherwise(F.lit("unknown"))


def role_score(role: Column, skill: int) -> Column:
    """Batting (0) or bowling (1) score of a role text."""
    low = F.lower(F.coalesce(role, F.lit("")))
    out = None
    for word, *scores in P.ROLE_SCORES:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, F.lit(scores[skill])) if out is None else out.when(hit, F.lit(scores[skill]))
    return out.otherwise(F.lit(P.ROLE_DEFAULT[skill]))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Within the band; null stays null (least/greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def squad_multiplier(mean_score: Column) -> Column:
    """Mean role score as a bounded multiplier, 1 without players."""
    return F.coalesce(clamp(mean_score / P.MULTIPLIER_BASE, *P.MULTIPLIER_BAND), F.lit(1.0))


def blend(long_run: Column, recent: Column, weight: float) -> Column:
    """weight·long_run + (1-weight)·recent where a recent value exists."""
    return F.when(recent.isNotNull(), weight * long_run + (1 - weight) * recent).otherwise(long_run)


def smoothed_rate(wins: Column, games: Column) -> Column:
    return (F.coalesce(wins, F.lit(0)) + 1) / (F.coalesce(games, F.lit(0)) + 2)


def signed_score(rate: Column) -> Column:
    return 2 * rate - 1


def powerplay_rate(runs: Column, balls: Column) -> Column:
    return 6.0 * runs / F.least(F.greatest(balls, F.lit(1)), F.lit(36))


def death_rate(runs: Column, balls: Column) -> Column:
    return 6.0 * runs / F.greatest(F.greatest(balls, F.lit(1)) - 96, F.lit(1))


def innings_rate(runs: Column, overs: Column) -> Column:
    return F.when(overs > 0, runs / overs)


def powerplay_rate_or_innings(pp_runs: Column, runs: Column, overs: Column) -> Column:
    return F.coalesce(pp_runs / 6.0, innings_rate(runs, overs))


def balls_of(overs: Column, ball_exact: bool = True) -> Column:
    """Overs notation (3.4 = 3 overs, 4 balls) to balls; raw keeps overs·6."""
    return F.floor(overs) * 6 + F.round((overs - F.floor(overs)) * 10) if ball_exact else overs * 6


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def live_dew_flag(decision: Column, chase_rate: Column) -> Column:
    return flag((decision == "field") & (chase_rate >= 0.52))


def toss_alignment(decision: Column, bat_rate: Column) -> Column:
    """1 when the decision follows the venue habit, 0 against it, .5 unknown."""
    follows = ((bat_rate >= 0.5) & (decision == "bat")) | ((bat_rate < 0.5) & (decision == "field"))
    return F.when(decision.isin("bat", "field"), follows.cast("double")).otherwise(F.lit(0.5))


def chase_boost(decision: Column, side1_won_toss: Column, chase_rate: Column) -> Column:
    return (
        F.when((decision == "field") & side1_won_toss, chase_rate)
        .when(decision == "field", 1.0 - chase_rate)
        .otherwise(F.lit(0.0))
    )


def won_by_side1(winner: Column, team1: Column) -> Column:
    return flag(winner == team1)


def side_score(winner: Column, team: Column, opponent: Column) -> Column:
    """1 win, 0 loss, .5 anything else."""
    return F.when(winner == team, 1.0).when(winner == opponent, 0.0).otherwise(0.5)


def season_weight(year: Column, weights: Mapping[int, float], default: float = 1.0) -> Column:
    out = F.lit(default)
    for y, w in weights.items():
        out = F.when(year == y, F.lit(w)).otherwise(out)
    return out


def training_weight(year: Column) -> Column:
    later = season_weight(year, P.TRAIN_SEASON_WEIGHTS)
    return F.when(year <= 2021, F.lit(P.TRAIN_WEIGHT_UNTIL_2021)).otherwise(later)


def complete_columns(df: DataFrame, names: Sequence[str], default: float = 0.0) -> DataFrame:
    """Exactly the named columns, absent or null ones set to the default."""
    return df.select(*[
        (F.coalesce(F.col(n), F.lit(default)) if n in df.columns else F.lit(default)).alias(n) for n in names
    ])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


# --- predicates -------------------------------------------------------------

def valid_document(competition: Column, wanted: str, teams: Column, dates: Column, match_id: Column) -> Column:
    return (
        (competition == wanted)
        & (F.size(teams) >= 2)
        & F.try_to_date(F.get(dates, F.lit(0))).isNotNull()
        & match_id.isNotNull()
    )


def plays_in(team1: Column, team2: Column, teams: Sequence[str]) -> Column:
    return team1.isin(*teams) | team2.isin(*teams)


def id_between(raw: Column, lo: int, hi: int | None = None) -> Column:
    """Numeric-looking id within bounds; malformed ids are out."""
    num = raw.try_cast("bigint")
    ok = num >= lo
    return F.coalesce(ok & (num <= hi) if hi else ok, F.lit(False))


def contains_word(text: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(word.lower())), F.lit(False))


def minutes_to(start: Column, now: Column) -> Column:
    return (F.unix_micros(start.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 60_000_000.0


def ready_to_predict(minutes: Column, toss_winner: Column, lo: int, hi: int) -> Column:
    """Toss known and start inside the band; an unknown start needs only the toss."""
    toss = F.coalesce(toss_winner, F.lit("")) != ""
    return toss & F.coalesce(minutes.between(lo, hi), F.lit(True))
