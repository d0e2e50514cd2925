"""Names, page text, list cells and other scalar work."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.functions import lineups as L, rules as R, text as X
from pitchline.plans.registry import query
from pitchline.plans.views import Tables, cte

RENAMED = {"NATION_3": "NATION_0", "NATION_9": "NATION_1", "NATION_14": "NATION_2"}
INSIDE = {"red": "crimson", "ring": "hoop"}

# Sides with letter-only names, as page text spells them.
_NAMED = """, named AS (
  SELECT *, 'Team ' || chr(65 + CAST(substr(team1, 8) AS INTEGER)) AS a,
         'Team ' || chr(65 + CAST(substr(team2, 8) AS INTEGER)) AS b FROM matches),
txt AS (
  SELECT match_id, a, b,
    CASE WHEN match_id % 7 = 0 THEN 'Toss delayed.' ELSE (CASE WHEN toss_winner = team1 THEN a ELSE b END)
      || ' elected to ' || toss_decision || '.' END
    || ' Played ' || strftime(match_date, '%B') || ' ' || day(match_date) || ', ' || year(match_date) || ' here. '
    || CASE WHEN winner IS NULL THEN 'No result' ELSE (CASE WHEN winner = team1 THEN a ELSE b END) || ' won by '
      || (match_id % 90 + 1) || ' runs' END AS body FROM named)"""


def _named(t: Tables):
    letter = lambda c: F.concat(F.lit("Team "), F.char(65 + F.substr(F.col(c), F.lit(8)).cast("int")))
    return t.matches.withColumns({"a": letter("team1"), "b": letter("team2")})


def _report_text(t: Tables):
    side = lambda c: F.when(F.col(c) == F.col("team1"), F.col("a")).otherwise(F.col("b"))
    toss = F.when(F.col("match_id") % 7 == 0, "Toss delayed.").otherwise(
        F.concat(side("toss_winner"), F.lit(" elected to "), "toss_decision", F.lit(".")))
    end = F.when(F.col("winner").isNull(), "No result").otherwise(
        F.concat(side("winner"), F.lit(" won by "), F.col("match_id") % 90 + 1, F.lit(" runs")))
    body = F.concat(toss, F.lit(" Played "), F.date_format("match_date", "MMMM d, yyyy"), F.lit(" here. "), end)
    return _named(t).select("match_id", "a", "b", body.alias("body"))


@query("prj1_name_aliases", cte("matches") + """
SELECT match_id, CASE team1 WHEN 'NATION_3' THEN 'NATION_0' WHEN 'NATION_9' THEN 'NATION_1'
  WHEN 'NATION_14' THEN 'NATION_2' ELSE team1 END AS team1_name FROM matches""")
def prj1(t: Tables):
    padded = F.concat(F.lit(" "), F.col("team1"), F.lit("  "))
    return t.matches.select("match_id", X.canonical(padded, RENAMED).alias("team1_name"))


@query("prj2_rename_inside_text", """
SELECT p_partkey, replace(replace(p_name, 'red', 'crimson'), 'ring', 'hoop') AS p_name FROM part""")
def prj2(t: Tables):
    return t.read("part").select("p_partkey", X.rename_inside(F.col("p_name"), INSIDE).alias("p_name"))


@query("prj3_split_pair", cte("matches") + """
SELECT match_id, team1 AS side1, team2 || ', ' || venue AS side2, CASE WHEN match_id % 4 = 0 THEN '' ELSE team1 END
  AS head1, CASE WHEN match_id % 4 = 0 THEN '' ELSE team2 END AS head2 FROM matches""")
def prj3(t: Tables):
    pair = F.concat("team1", F.lit(" vs  "), "team2", F.lit(", "), "venue")
    head = F.when(F.col("match_id") % 4 == 0, F.col("team1")).otherwise(pair)
    return t.matches.select(
        "match_id", X.pair_side(pair, 1).alias("side1"), X.pair_side(pair, 2).alias("side2"),
        X.heading_side(head, 1).alias("head1"), X.heading_side(head, 2).alias("head2"),
    )


@query("prj4_other_side", cte("matches") + """
SELECT match_id, CASE WHEN toss_winner = team1 THEN team2 ELSE team1 END AS toss_loser FROM matches""")
def prj4(t: Tables):
    return t.matches.select(
        "match_id", R.other_side(F.col("toss_winner"), F.col("team1"), F.col("team2")).alias("toss_loser"))


_TOSS = (F.col, ("toss_winner", "toss_decision", "team1", "team2"))


def _toss():
    return [F.col(c) for c in _TOSS[1]]


@query("prj5_batting_first", cte("matches") + """
SELECT match_id, CASE WHEN toss_decision = 'bat' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END
  AS batting_first FROM matches""")
def prj5(t: Tables):
    return t.matches.select("match_id", R.batting_first(*_toss()).alias("batting_first"))


@query("prj6_chasing_side", cte("matches") + """
SELECT match_id, CASE WHEN toss_decision = 'field' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END
  AS chasing, CASE WHEN winner IS NULL THEN NULL ELSE winner = CASE WHEN toss_decision = 'field' THEN toss_winner
  WHEN toss_winner = team1 THEN team2 ELSE team1 END END AS chase_won FROM matches""")
def prj6(t: Tables):
    chasing = R.chasing_side(*_toss())
    return t.matches.select("match_id", chasing.alias("chasing"), (F.col("winner") == chasing).alias("chase_won"))


@query("prj7_toss_choice", """
WITH raw AS (SELECT o_orderkey AS match_id, CASE o_orderkey % 6 WHEN 0 THEN ' Bowl' WHEN 1 THEN 'chase'
  WHEN 2 THEN 'BATTING ' WHEN 3 THEN 'Field' WHEN 4 THEN 'bat' END AS c FROM orders)
SELECT match_id, CASE WHEN lower(trim(c)) IN ('bat', 'batting') THEN 'bat' ELSE 'field' END AS choice,
  CASE WHEN lower(trim(c)) IN ('bat', 'field') THEN lower(trim(c)) ELSE 'unknown' END AS strict_choice FROM raw""")
def prj7(t: Tables):
    k = F.col("o_orderkey") % 6
    raw = (F.when(k == 0, " Bowl").when(k == 1, "chase").when(k == 2, "BATTING ").when(k == 3, "Field")
           .when(k == 4, "bat"))
    return t.read("orders").select(
        F.col("o_orderkey").alias("match_id"), R.toss_choice(raw).alias("choice"),
        R.toss_choice_strict(raw).alias("strict_choice"))


@query("prj8_join_keys", """
SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS ascii_key,
       regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS letter_key FROM conversations""")
def prj8(t: Tables):
    return t.read("conversations").select(
        "conv_id", "turn", X.join_key(F.col("text")).alias("ascii_key"),
        X.join_key(F.col("text"), unicode_letters=True).alias("letter_key"))


@query("prj9_squeeze_whitespace", """
SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations""")
def prj9(t: Tables):
    return t.read("conversations").select("conv_id", "turn", X.squeeze(F.col("text")).alias("text"))


@query("prj10_text_facts", cte("matches") + _NAMED + """, x AS (
  SELECT *, regexp_extract(body, '(?i)([A-Za-z .&-]+?) elected to (bat|field)', 1) AS who,
         regexp_extract(body, '(?i)([A-Za-z .&-]+?) elected to (bat|field)', 2) AS what FROM txt)
SELECT match_id,
  CASE WHEN contains(who, a) THEN a WHEN contains(who, b) THEN b ELSE a END AS toss_winner,
  CASE WHEN contains(who, a) OR contains(who, b) THEN what ELSE 'field' END AS toss_decision,
  CASE WHEN regexp_matches(body, '(?i)\\b' || a || '\\b\\s+won by') THEN a
       WHEN regexp_matches(body, '(?i)\\b' || b || '\\b\\s+won by') THEN b ELSE '' END AS winner,
  nullif(regexp_extract(body, 'won by (\\d+ runs)', 1), '') AS margin,
  regexp_extract(body, '([A-Za-z]+\\s+\\d{1,2},\\s+\\d{4})', 1) AS date_text,
  CAST(strptime(regexp_extract(body, '([A-Za-z]+\\s+\\d{1,2},\\s+\\d{4})', 1), '%B %d, %Y') AS DATE) AS match_date
FROM x""")
def prj10(t: Tables):
    facts = X.report_facts(_report_text(t), "body", "a", "b", P.TEAM_ALIASES)
    return facts.select("match_id", "toss_winner", "toss_decision", "winner", "margin", "date_text",
                        X.long_date(F.col("date_text")).alias("match_date"))


@query("prj11_last_score", cte("matches") + _NAMED + """, s AS (
  SELECT match_id, a || ' batting: ' || a || ' 45-2 then ' || b || ' 99-1, final '
    || upper(a) || ' ' || (match_id % 200 + 50) || '-' || (match_id % 10)
    || CASE WHEN match_id % 3 = 0 THEN '' ELSE ' (19.' || (match_id % 6) || ' Ovs)' END AS body FROM named)
SELECT match_id, CAST(regexp_extract(body, 'TEAM [A-Y] (\\d{2,3})-', 1) AS DOUBLE) AS runs,
  CAST(regexp_extract(body, 'TEAM [A-Y] \\d{2,3}-(\\d{1,2})', 1) AS DOUBLE) AS wkts,
  CAST(nullif(regexp_extract(body, '\\((\\d+\\.\\d) Ovs\\)', 1), '') AS DOUBLE) AS overs FROM s""")
def prj11(t: Tables):
    k = F.col("match_id")
    overs = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" (19."), k % 6, F.lit(" Ovs)")))
    body = F.concat("a", F.lit(" batting: "), "a", F.lit(" 45-2 then "), "b", F.lit(" 99-1, final "), F.upper("a"),
                    F.lit(" "), k % 200 + 50, F.lit("-"), k % 10, overs)
    m = _named(t).select("match_id", "a", body.alias("body"))
    return m.withColumn("s", X.last_score(F.col("body"), F.col("a"))).select("match_id", "s.*")


@query("prj12_powerplay_runs", """
WITH b AS (SELECT o_orderkey AS match_id, [o_orderkey % 40 + 30, o_orderkey % 40 + 30, o_orderkey % 50 + 20,
                  o_orderkey % 40 + 30] AS v FROM orders),
d AS (SELECT match_id, list_filter(v, lambda x, i: i = 1 OR x <> v[i - 1]) AS v FROM b)
SELECT match_id, CAST(v[1] AS DOUBLE) AS first_pp, CAST(v[2] AS DOUBLE) AS second_pp FROM d""")
def prj12(t: Tables):
    k = F.col("o_orderkey")
    blocks = [F.concat(F.lit("Powerplays Overs Runs  Mandatory 0.1 - 6 "), v, F.lit(". "))
              for v in (k % 40 + 30, k % 40 + 30, k % 50 + 20, k % 40 + 30)]
    runs = X.powerplay_runs(F.concat(*blocks))
    return t.read("orders").select(
        k.alias("match_id"), F.get(runs, F.lit(0)).alias("first_pp"), F.get(runs, F.lit(1)).alias("second_pp"))


@query("prj13_unique_squads", """
WITH h AS (SELECT page_id, list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1),
             list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: lower(x))) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS name, unnest(range(1, len(l) + 1)) AS pos FROM h),
f AS (SELECT page_id, arg_min(name, pos) AS name, min(pos) AS pos FROM u GROUP BY page_id, lower(name)),
o AS (SELECT page_id, list(name ORDER BY pos) AS names FROM f GROUP BY 1)
SELECT p.page_id, coalesce(array_to_string(names[1:3], '|'), '') AS xi1, coalesce(array_to_string(names[4:6], '|'), '') AS xi2,
       coalesce(array_to_string(names[7:], '|'), '') AS subs FROM pages p LEFT JOIN o ON p.page_id = o.page_id""")
def prj13(t: Tables):
    links = X.hrefs(F.col("html"))
    doubled = F.concat(links, F.transform(links, lambda x: F.lower(x)))
    p = L.with_unique_names(t.read("pages").select("page_id", doubled.alias("names")), "page_id", "names")
    xi1, xi2, subs = L.split_squads(F.col("names"), 3)
    return p.select("page_id", *[F.concat_ws("|", c).alias(n) for c, n in ((xi1, "xi1"), (xi2, "xi2"), (subs, "subs"))])


_PACKED = """, p AS (SELECT match_id, side, list(player ORDER BY player) AS players FROM lineups GROUP BY 1, 2)"""


@query("prj14_padded_slots", cte("lineups") + _PACKED + """
SELECT match_id, side, array_to_string(list_concat(players[1:5], list_transform(range(greatest(0, 5 - len(players))),
         lambda i: 'Unknown_Player')), '|') AS plain,
       array_to_string(list_concat(players[1:5], list_transform(range(least(len(players), 5) + 1, 6),
         lambda i: 'Unknown_Player_' || i)), '|') AS numbered FROM p""")
def prj14(t: Tables):
    return t.lineups.select(
        "match_id", "side", F.concat_ws("|", L.padded(F.col("players"), 5)).alias("plain"),
        F.concat_ws("|", L.padded(F.col("players"), 5, numbered=True)).alias("numbered"))


@query("prj15_slot_columns", cte("lineups") + _PACKED + """
SELECT match_id, side, coalesce(players[1], 'Unknown_Player') AS player_1, coalesce(players[2], 'Unknown_Player')
  AS player_2, coalesce(players[3], 'Unknown_Player') AS player_3, array_to_string(players, '|') AS joined FROM p""")
def prj15(t: Tables):
    slots = L.slot_columns(L.padded(F.col("players"), 3), "player", 3)
    return t.lineups.select("match_id", "side", *slots, F.concat_ws("|", "players").alias("joined"))


@query("prj16_list_cells", cte("lineups") + _PACKED + """
SELECT match_id, side, array_to_string(players, ',') AS names, len(players) AS n FROM p""")
def prj16(t: Tables):
    cell = F.when(F.col("match_id") % 2 == 0, F.to_json("players")).otherwise(F.concat_ws(" | ", "players"))
    names = X.text_list(F.col("cell"))
    return t.lineups.select("match_id", "side", cell.alias("cell")).select(
        "match_id", "side", F.concat_ws(",", names).alias("names"), F.size(names).cast("bigint").alias("n"))


@query("prj17_role_scores", """
WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Batting Allrounder' WHEN 1 THEN 'Bowler'
  WHEN 2 THEN 'WK-Batter' WHEN 3 THEN 'Wicket Keeper' WHEN 4 THEN 'Batter' END AS role FROM part)
SELECT p_partkey, CAST(CASE WHEN contains(lower(role), 'allround') THEN 0.9 WHEN contains(lower(role), 'bowl') THEN 0.35
  WHEN contains(lower(role), 'wk') OR contains(lower(role), 'keeper') THEN 0.95 WHEN contains(lower(role), 'bat') THEN 1.0
  ELSE 0.7 END AS DOUBLE) AS bat, CAST(CASE WHEN contains(lower(role), 'allround') THEN 0.9
  WHEN contains(lower(role), 'bowl') THEN 1.05 WHEN role IS NULL THEN 0.7 ELSE 0.25 END AS DOUBLE) AS bowl FROM r""")
def prj17(t: Tables):
    k = F.col("p_partkey") % 6
    role = (F.when(k == 0, "Batting Allrounder").when(k == 1, "Bowler").when(k == 2, "WK-Batter")
            .when(k == 3, "Wicket Keeper").when(k == 4, "Batter"))
    return t.read("part").select("p_partkey", R.role_score(role, 0).alias("bat"), R.role_score(role, 1).alias("bowl"))


@query("prj18_clamp", cte("scored") + """
SELECT match_id, round(least(greatest(p1 / 0.8, 0.88), 1.12), 6) AS multiplier FROM scored""")
def prj18(t: Tables):
    return t.scored.select("match_id", F.round(R.squad_multiplier(F.col("p1")), 6).alias("multiplier"))


@query("prj19_blend", cte("log") + """
SELECT match_id, round(CASE WHEN first_score IS NOT NULL THEN 0.8 * 170 + 0.2 * first_score ELSE 170.0 END, 6)::DOUBLE
  AS venue_score FROM log""")
def prj19(t: Tables):
    return t.log.select("match_id", F.round(R.blend(F.lit(170.0), F.col("first_score"), 0.8), 6).alias("venue_score"))


@query("prj20_smoothed_rate", cte("long") + """, g AS (
  SELECT venue, team, count(*) AS g, CAST(sum(CASE WHEN winner = team THEN 1 ELSE 0 END) AS BIGINT) AS w
  FROM long GROUP BY 1, 2)
SELECT venue, team, round((w + 1) / (g + 2), 6) AS rate, round(2 * ((w + 1) / (g + 2)) - 1, 6) AS score FROM g""")
def prj20(t: Tables):
    from pitchline.operators.facts import team_long

    g = team_long(t.matches).groupBy("venue", "team").agg(
        F.count("*").alias("g"), F.sum(R.flag(F.col("winner") == F.col("team"))).alias("w"))
    rate = R.smoothed_rate(F.col("w"), F.col("g"))
    return g.select("venue", "team", F.round(rate, 6).alias("rate"), F.round(R.signed_score(rate), 6).alias("score"))


@query("prj21_phase_rates", cte("innings") + """
SELECT match_id, side, round(6.0 * pp_runs / least(greatest(balls, 1), 36)::DOUBLE, 6) AS pp_rr,
       round(6.0 * death_runs / greatest(balls - 96, 1)::DOUBLE, 6) AS death_rr FROM innings""")
def prj21(t: Tables):
    return t.innings.select(
        "match_id", "side", F.round(R.powerplay_rate(F.col("pp_runs"), F.col("balls")), 6).alias("pp_rr"),
        F.round(R.death_rate(F.col("death_runs"), F.col("balls")), 6).alias("death_rr"))


@query("prj22_rate_fallback", cte("innings") + """
SELECT match_id, side, round(coalesce(CASE WHEN pp_runs > 0 THEN pp_runs / 6.0::DOUBLE END,
  CASE WHEN balls - 1 > 0 THEN runs / ((balls - 1) / 6.0::DOUBLE) END), 6) AS pp_rr FROM innings""")
def prj22(t: Tables):
    pp = F.when(F.col("pp_runs") > 0, F.col("pp_runs"))
    rate = R.powerplay_rate_or_innings(pp, F.col("runs"), (F.col("balls") - 1) / 6.0)
    return t.innings.select("match_id", "side", F.round(rate, 6).alias("pp_rr"))


@query("prj23_environment_flags", cte("matches") + """
SELECT match_id, CASE WHEN toss_decision = 'field' AND season % 100 / 100.0 >= 0.52 THEN 1 ELSE 0 END AS is_high_dew,
  CASE WHEN venue IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_batting_pitch,
  CASE WHEN venue = '5-LOW' THEN 1 ELSE 0 END AS is_sluggish_pitch,
  CASE WHEN toss_winner = winner THEN 1 ELSE 0 END AS toss_advantage FROM matches""")
def prj23(t: Tables):
    return t.matches.select(
        "match_id", R.live_dew_flag(F.col("toss_decision"), F.col("season") % 100 / 100.0).alias("is_high_dew"),
        R.flag(F.col("venue").isin("1-URGENT", "2-HIGH")).alias("is_batting_pitch"),
        R.flag(F.col("venue") == "5-LOW").alias("is_sluggish_pitch"),
        R.flag(F.col("toss_winner") == F.col("winner")).alias("toss_advantage"))


@query("prj24_toss_alignment", cte("matches") + """, r AS (
  SELECT *, (match_id % 10) / 10.0::DOUBLE AS rate FROM matches)
SELECT match_id, CASE WHEN (rate >= 0.5) = (toss_decision = 'bat') THEN 1.0::DOUBLE ELSE 0.0 END AS alignment,
  round(CASE WHEN toss_decision <> 'field' THEN 0.0 WHEN toss_winner = team1 THEN rate ELSE 1 - rate END, 6)
  AS chase_boost FROM r""")
def prj24(t: Tables):
    rate = (F.col("match_id") % 10) / 10.0
    won = F.col("toss_winner") == F.col("team1")
    return t.matches.select(
        "match_id", R.toss_alignment(F.col("toss_decision"), rate).alias("alignment"),
        F.round(R.chase_boost(F.col("toss_decision"), won, rate), 6).alias("chase_boost"))


@query("prj25_target_and_label", cte("matches") + """
SELECT match_id, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS target, coalesce(winner, 'Draw/No Result') AS label
FROM matches""")
def prj25(t: Tables):
    return t.matches.select("match_id", R.won_by_side1(F.col("winner"), F.col("team1")).alias("target"),
                            F.coalesce("winner", F.lit(P.NO_RESULT)).alias("label"))


@query("prj26_fill_and_complete", cte("results") + """
SELECT CAST(match_id AS DOUBLE) AS match_id, CAST(runs_1 AS DOUBLE) AS runs_1, 0.0::DOUBLE AS dew,
       coalesce(CASE WHEN winner = team1 THEN 1.0::DOUBLE WHEN winner = team2 THEN 0.0 END, 0.0) AS score FROM results""")
def prj26(t: Tables):
    r = t.results.withColumn("score", F.when(F.col("winner") == F.col("team1"), 1.0)
                             .when(F.col("winner") == F.col("team2"), 0.0)).fillna("Unknown", ["winner"])
    numeric = r.select(*[F.col(c).cast("double") for c in ("match_id", "runs_1", "score")])
    return R.complete_columns(numeric, ["match_id", "runs_1", "dew", "score"])


@query("prj27_lower_and_rename", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS stadium FROM customer")
def prj27(t: Tables):
    c = t.read("customer")
    shouted = c.toDF(*[n.upper() for n in c.columns])
    return shouted.toDF(*[n.lower() for n in shouted.columns]).withColumnRenamed("c_mktsegment", "stadium")


@query("prj28_drop_redundant", cte("matches") + "SELECT match_id, match_date, season, venue, winner FROM matches")
def prj28(t: Tables):
    return t.matches.drop("team1", "team2", "toss_winner", "toss_decision")


@query("prj29_name_price_tokens", """
WITH b AS (SELECT p_partkey, [p_name, p_type, 'Extra'] AS names, [p_size::DOUBLE, (p_partkey % 50)::DOUBLE, 7.5::DOUBLE]
             AS prices FROM part),
u AS (SELECT p_partkey, unnest(names) AS name, unnest(prices) AS price, unnest(range(3)) AS pos FROM b)
SELECT p_partkey, CAST(pos % 2 AS INTEGER) AS col_no, name, price FROM u""")
def prj29(t: Tables):
    text = F.concat("p_name", "p_size", "p_type", F.col("p_partkey") % 50, F.lit("Extra"), F.lit("7.5"))
    tokens = t.read("part").select("p_partkey", F.posexplode(X.name_price_tokens(text)).alias("pos", "tok"))
    return tokens.select("p_partkey", (F.col("pos") % 2).cast("int").alias("col_no"), "tok.name", "tok.price")


# --- filters ----------------------------------------------------------------

@query("flt1_valid_documents", cte("matches") + """
SELECT match_id, team1, team2 FROM matches WHERE venue = '1-URGENT' AND match_id % 11 <> 0 AND match_id % 13 <> 0
  AND match_id % 17 <> 0""")
def flt1(t: Tables):
    k = F.col("match_id")
    docs = t.matches.select(
        "match_id", "team1", "team2", F.col("venue").alias("competition"),
        F.when(k % 11 == 0, F.array("team1")).otherwise(F.array("team1", "team2")).alias("teams"),
        F.array(F.when(k % 13 == 0, "not a date").otherwise(F.col("match_date").cast("string"))).alias("dates"),
        F.when(k % 17 == 0, "draft").otherwise(k.cast("string")).alias("stem"),
    )
    ok = R.valid_document(F.col("competition"), "1-URGENT", F.col("teams"), F.col("dates"),
                          F.col("stem").try_cast("bigint"))
    return docs.filter(ok).select("match_id", "team1", "team2")


@query("flt2_excluded_sides", cte("matches") + """
SELECT match_id, team1, team2 FROM matches WHERE team1 NOT IN ('NATION_4', 'NATION_11')
  AND team2 NOT IN ('NATION_4', 'NATION_11')""")
def flt2(t: Tables):
    out = ~R.plays_in(F.col("team1"), F.col("team2"), ["NATION_4", "NATION_11"])
    return t.matches.filter(out).select("match_id", "team1", "team2")


@query("flt3_years", cte("matches") + """
SELECT match_id, season FROM matches WHERE season = 1995 OR season BETWEEN 1997 AND 1998 OR season IN (2000, 2001)""")
def flt3(t: Tables):
    y = F.col("season")
    return t.matches.filter((y == 1995) | y.between(1997, 1998) | y.isin(2000, 2001)).select("match_id", "season")


@query("flt4_id_range", """
SELECT p_partkey, p_name FROM part WHERE p_partkey % 9 <> 0 AND p_partkey BETWEEN 100 AND 1500""")
def flt4(t: Tables):
    raw = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("x"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    return t.read("part").withColumn("raw", raw).filter(R.id_between(F.col("raw"), 100, 1500)).select("p_partkey", "p_name")


@query("flt5_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def flt5(t: Tables):
    return t.read("part").filter(R.contains_word(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query("flt6_drop_nulls", cte("matches") + "SELECT match_id, winner FROM matches WHERE winner IS NOT NULL")
def flt6(t: Tables):
    return t.matches.dropna(subset=["match_id", "winner"]).filter(F.col("winner") != P.NO_RESULT).select("match_id", "winner")


@query("flt7_known_labels", cte("matches") + """, l AS (
  SELECT match_id, season, team1 || '|' || team2 || '|' || venue AS label FROM matches)
SELECT match_id, label FROM l WHERE season >= 2000 AND label IN (SELECT label FROM l WHERE season < 2000)""")
def flt7(t: Tables):
    lab = t.matches.select("match_id", "season", F.concat_ws("|", "team1", "team2", "venue").alias("label"))
    train = lab.filter("season < 2000").select("label").distinct()
    return lab.filter("season >= 2000").join(train, "label", "left_semi").select("match_id", "label")


@query("flt8_skip_known_ids", cte("matches") + """
SELECT match_id, venue FROM matches WHERE match_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def flt8(t: Tables):
    stored = t.read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id")).distinct()
    return t.matches.join(stored, "match_id", "left_anti").select("match_id", "venue")


@query("flt9_fixture_choice", cte("matches") + """, c AS (
  SELECT match_id, match_date, team, CASE WHEN winner IS NULL AND match_date < DATE '1998-06-01' THEN 0
      WHEN match_date >= DATE '1998-06-01' THEN 1 ELSE 2 END AS pri
  FROM (SELECT match_id, match_date, winner, team1 AS team FROM matches
        UNION ALL SELECT match_id, match_date, winner, team2 FROM matches)
  WHERE winner IS NULL OR match_date >= DATE '1998-06-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pri, match_date, match_id) AS rn FROM c)
SELECT team, match_id, match_date, pri FROM r WHERE rn = 1""")
def flt9(t: Tables):
    from pitchline.operators.facts import team_long
    from pitchline.operators.ordered import top_n

    now = F.lit("1998-06-01").cast("date")
    future = F.col("match_date") >= now
    pri = F.when(F.col("winner").isNull() & ~future, 0).when(future, 1).otherwise(2)
    c = team_long(t.matches.select("match_id", "match_date", "winner", "team1", "team2"))
    c = c.filter(F.col("winner").isNull() | future).withColumn("pri", pri)
    return top_n(c, ["team"], [F.col("pri"), F.col("match_date"), F.col("match_id")], 1).select(
        "team", "match_id", "match_date", "pri")


@query("flt10_ready_band", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE (event_id % 120)::DOUBLE END AS m,
  event_type <> 'error' AS toss FROM events)
SELECT event_id, m AS minutes FROM e WHERE toss AND (m IS NULL OR m BETWEEN 15 AND 45)""")
def flt10(t: Tables):
    e = t.read("events").withColumn("now", F.col("ts").cast("timestamp"))
    start = F.when(F.col("event_type") != "signup", F.timestamp_add("MINUTE", F.col("event_id") % 120, F.col("now")))
    toss = F.when(F.col("event_type") == "error", "").otherwise("x")
    e = e.withColumn("minutes", R.minutes_to(start, F.col("now")))
    return e.filter(R.ready_to_predict(F.col("minutes"), toss, 15, 45)).select("event_id", "minutes")
