"""Fixed values of the domain: markers, aliases, defaults and weights."""

from __future__ import annotations

# Missing-data markers.
UNKNOWN = "Unknown"
UNKNOWN_PLAYER = "Unknown_Player"
OTHER_PLAYER = "OTHER_PLAYER"
NO_RESULT = "Draw/No Result"

# Renamed teams and short names.
TEAM_ALIASES = {
    "CSK": "Chennai Super Kings",
    "DC": "Delhi Capitals",
    "DD": "Delhi Capitals",
    "Delhi Daredevils": "Delhi Capitals",
    "GT": "Gujarat Titans",
    "KKR": "Kolkata Knight Riders",
    "KXIP": "Punjab Kings",
    "Kings XI Punjab": "Punjab Kings",
    "LSG": "Lucknow Super Giants",
    "MI": "Mumbai Indians",
    "PBKS": "Punjab Kings",
    "RCB": "Royal Challengers Bengaluru",
    "RR": "Rajasthan Royals",
    "Rising Pune Supergiant": "Rising Pune Supergiants",
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
    "SRH": "Sunrisers Hyderabad",
}

# Sides that no longer play.
DEFUNCT_TEAMS = (
    "Deccan Chargers",
    "Gujarat Lions",
    "Kochi Tuskers Kerala",
    "Pune Warriors",
    "Rising Pune Supergiants",
)

# What a feature is worth when a side, venue or player has no past.
BALL_DEFAULTS = {
    "form": 0.5, "runs": 160.0, "wkts": 6.0, "pp_rr": 7.5, "death_rr": 9.5, "first_runs": 165.0,
    "pp_rr_second": 7.3, "death_rr_second": 9.2, "continuity": 0.5, "availability": 0.5, "h2h": 0.5, "toss_bat": 0.5,
}
STORE_DEFAULTS = {
    "form": 0.5, "runs": 160.0, "wkts": 7.0, "pp_rr": 8.0, "death_rr": 10.0, "first_runs": 170.0,
    "h2h": 0.5, "venue_team": 0.5, "chase": 0.5,
}
VECTOR_DEFAULTS = {"bat_avg": 25.0, "bat_sr": 125.0, "bowl_eco": 8.5, "bowl_sr": 20.0}
TEAM_PROFILE_DEFAULTS = {"bat_avg": 30.0, "bat_sr": 140.0, "bowl_eco": 8.5, "bowl_sr": 20.0}
VENUE_PROFILE_DEFAULTS = {"venue_score_prior": 170.0, "venue_chase_winrate_prior": 0.52, "toss_advantage": 0.5,
                          "pitch_type": "Batting", "bounce_and_carry": "Medium"}

# Least similarity at which a name of the feed counts as a known one.
TEAM_CUTOFF = 0.6
VENUE_CUTOFF = 0.45

# What is assumed of a match before its day.
FUTURE_CONTEXT = {
    "toss_decision": "field", "pitch_type": "Batting", "bounce_and_carry": "Low", "team1_form_winrate_5": 0.5,
    "team2_form_winrate_5": 0.5, "venue_score_prior": 180.0, "venue_chase_winrate_prior": 0.55, "toss_advantage": 0.0, "is_high_dew": 1,
}

# Rating update and rating scale.
START_RATING = 1000.0
RATING_STEP = 20.0
RATING_SPREAD = 400.0
RATING_SCALE = 150.0
SEEN_WITHIN_DAYS = 450

# Season weights for ratings and for training rows.
RATING_SEASON_WEIGHTS = {2020: 1.0, 2021: 1.2, 2023: 1.5, 2024: 1.8, 2025: 2.1, 2026: 2.5}
TRAIN_SEASON_WEIGHTS = {2022: 1.25, 2023: 1.55, 2024: 1.90}
TRAIN_WEIGHT_UNTIL_2021 = 0.60

# Fixed values: (batting, bowling) score by role word, first match wins.
ROLE_SCORES = (
    ("allround", 0.90, 0.90),
    ("bowl", 0.35, 1.05),
    ("wk", 0.95, 0.25),
    ("keeper", 0.95, 0.25),
    ("bat", 1.00, 0.25),
)
ROLE_DEFAULT = (0.7, 0.7)
ROSTER_BONUS = 0.03
MULTIPLIER_BAND = (0.88, 1.12)
MULTIPLIER_BASE = 0.8
HEALTHY_ACCURACY = 0.65

# Neutral features of a logged match that stands in for a hold-out row.
EVALUATION_DEFAULTS = {
    "team1_form_winrate_5": 0.5, "team2_form_winrate_5": 0.5, "venue_chase_winrate_prior": 0.5, "venue_score_prior": 170.0,
    "h2h_team1_winrate_prior": 0.5, "venue_team1_winrate_prior": 0.5, "venue_team2_winrate_prior": 0.5,
    "venue_avg_first_innings_runs_prior": 170.0, "team1_recent_runs_for_5": 160.0, "team2_recent_runs_for_5": 160.0,
    "team1_recent_runs_against_5": 160.0, "team2_recent_runs_against_5": 160.0, "team1_recent_wkts_taken_5": 7.0,
    "team2_recent_wkts_taken_5": 7.0, "team1_recent_powerplay_rr_5": 8.0, "team2_recent_powerplay_rr_5": 8.0,
    "team1_recent_death_rr_5": 10.0, "team2_recent_death_rr_5": 10.0, "team1_player_rating_avg_prior": 1000.0,
    "team2_player_rating_avg_prior": 1000.0, "team1_player_rating_max_prior": 1150.0, "team2_player_rating_max_prior": 1150.0,
    "team1_player_rating_min_prior": 850.0, "team2_player_rating_min_prior": 850.0, "player_rating_gap_prior": 0.0,
}
