"""Names, squads, form and presets of the rows to predict from, on invented sides."""

from datetime import date

from pitchline import presets as P
from pitchline.operators import live as LV


def test_names(spark):
    raw = spark.createDataFrame([(1, "CSK", "Redd Rovers"), (2, "Zzz", None), (3, "", "Red Rovers")], "match_id int, team1 string, team2 string")
    known = spark.createDataFrame([("Chennai Super Kings",), ("Red Rovers",), ("Blue Rovers",)], "team string")
    got = {r.match_id: (r.team1, r.team2) for r in LV.resolved(raw, ["team1", "team2"], known, 0.6).collect()}
    assert got == {1: ("Chennai Super Kings", "Red Rovers"), 2: ("Zzz", None), 3: ("", "Red Rovers")}
    assert LV.resolved(raw.limit(0), ["team1", "team2"], known, 0.6).count() == 0
    assert LV.resolved(raw, ["team1"], known.limit(0), 0.6).count() == 3


def test_squads(spark):
    squad = [("A One", "Batting Allrounder"), ("B-Two", "Bowler"), ("!!", None)] + [("X", "Batsman")] * 8 + [("Late", "Bowler")] * 20
    sides = spark.createDataFrame([(1, 1, "Reds", squad), (1, 2, "Blues", None), (2, 1, "Reds", [])],
                                  "match_id int, side int, team string, squad array<struct<name:string,role:string>>")
    roster = spark.createDataFrame([("Reds", "a one"), ("Reds", "A ONE"), ("Blues", "b two"), ("Reds", "")], "team string, player string")
    got = LV.squad_multipliers(sides, roster).collect()
    assert [(r.match_id, r.side, r.players_used) for r in got] == [(1, 1, 11)]
    bat = (0.93 + 0.35 + 0.7 + 8 * 1.0) / 11
    bowl = (0.93 + 1.05 + 0.7 + 8 * 0.25) / 11
    assert abs(got[0].bat_multiplier - min(1.12, max(0.88, bat / 0.8))) < 1e-12
    assert abs(got[0].bowl_multiplier - min(1.12, max(0.88, bowl / 0.8))) < 1e-12


def test_form_counts_earlier_days_only(spark):
    finals = spark.createDataFrame(
        [(k, date(2021, 5, k), "Reds", "Blues", "Reds" if k % 2 else "Blues") for k in range(1, 9)],
        "match_id int, match_date date, team1 string, team2 string, winner string")
    sides = spark.createDataFrame([(100, date(2021, 5, 8), 1, "Reds"), (101, date(2021, 5, 1), 1, "Reds"), (102, date(2021, 5, 9), 2, "Blues"),
                                   (103, date(2021, 5, 9), 1, "Nobody")], "match_id int, match_date date, side int, team string")
    got = {r.match_id: r.form for r in LV.form_before(sides, finals).collect()}
    assert got == {100: 0.6, 101: 0.5, 102: 0.6, 103: 0.5}


def test_future_rows(spark):
    fixtures = spark.createDataFrame([(1, "Reds", "Blues", "North")], "match_id int, team1 string, team2 string, venue string")
    teams = spark.createDataFrame([("Reds", 40.0, 150.0, 7.0, 18.0)], "team string, bat_avg double, bat_sr double, bowl_eco double, bowl_sr double")
    r = LV.future_rows(fixtures, teams, {"venue_score_prior": 175.0}).first()
    assert (r.team1_bat_avg, r.team2_bat_avg, r.toss_winner, r.toss_decision) == (40.0, P.VECTOR_DEFAULTS["bat_avg"], "Reds", "field")
    assert (r.venue_score_prior, r.is_high_dew, r.team2_form_winrate_5) == (175.0, 1, 0.5)
