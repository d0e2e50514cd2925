"""Match-shaped views over the given tables, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitchline.functions import rules
from pitchline.operators.ordered import Span, span_of


class Tables:
    """Lazy access to the given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self._rows: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count of a base table, answered from the file footers."""
        if name not in self._rows:
            self._rows[name] = self.read(name).count()
        return self._rows[name]

    @property
    def dates(self) -> Span:
        """Cuts of all matches by date and id, read from two columns of the base table."""
        return span_of(self.read("orders").select(F.col("o_orderdate").cast("date").alias("match_date"),
                                                  F.col("o_orderkey").alias("match_id")), ["match_date", "match_id"])

    @property
    def matches(self) -> DataFrame:
        o = self.read("orders")
        c = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        m = o.join(c, "o_custkey").select(
            F.col("o_orderkey").alias("match_id"),
            F.col("o_orderdate").cast("date").alias("match_date"),
            F.concat(F.lit("NATION_"), "c_nationkey").alias("team1"),
            F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).alias("team2"),
            F.col("o_orderpriority").alias("venue"),
            F.col("o_orderstatus").alias("_status"),
        )
        key = F.col("match_id")
        return m.select(
            "match_id", "match_date", F.year("match_date").alias("season"), "team1", "team2", "venue",
            F.when(key % 2 == 0, F.col("team1")).otherwise(F.col("team2")).alias("toss_winner"),
            F.when(key % 3 == 0, "bat").otherwise("field").alias("toss_decision"),
            F.when(F.col("_status") == "F", F.col("team1"))
            .when(F.col("_status") == "O", F.col("team2")).alias("winner"),
        )

    @property
    def deliveries(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("match_id"),
            (F.col("l_suppkey") % 2 + 1).cast("int").alias("side"),
            F.col("l_linenumber").alias("over_no"),
            F.col("l_quantity").cast("bigint").alias("runs"),
            (F.col("l_returnflag") == "R").cast("int").alias("wicket"),
            F.concat(F.lit("Player "), "l_suppkey").alias("batter"),
            F.concat(F.lit("Player "), (F.col("l_suppkey") + F.col("l_linenumber")) % 100).alias("bowler"),
        )

    @property
    def innings(self) -> DataFrame:
        """Totals per match and side; overs below 3 are the powerplay, from 6 on the death."""
        from pitchline.operators.facts import innings_totals

        return innings_totals(self.deliveries, ["match_id", "side"], powerplay_until=3, death_from=6)

    @property
    def results(self) -> DataFrame:
        """Matches with both innings side by side; sides without deliveries count as zero."""
        from pitchline.operators.facts import innings_wide

        wide = innings_wide(self.deliveries, powerplay_until=3, death_from=6)
        return self.matches.join(wide, "match_id", "left").fillna(0, [c for c in wide.columns if c != "match_id"])

    @property
    def lineup_slots(self) -> DataFrame:
        """Players per match and side, one row each; slots are cut where slots are asked for."""
        return self.deliveries.select("match_id", "side", F.col("batter").alias("player")).distinct()

    @property
    def lineups(self) -> DataFrame:
        """The players of each side as one sorted array."""
        return self.deliveries.groupBy("match_id", "side").agg(F.sort_array(F.collect_set("batter")).alias("players"))

    @property
    def lineup_long(self) -> DataFrame:
        """One row per match, side and player, with team and date."""
        team = F.when(F.col("side") == 1, F.col("team1")).otherwise(F.col("team2"))
        return self.lineup_slots.join(self.matches, "match_id").select(
            "match_id", "match_date", "side", team.alias("team"), "player", "venue")

    @property
    def batting(self) -> DataFrame:
        return self.deliveries.groupBy("match_id", F.col("batter").alias("player")).agg(
            F.sum("runs").alias("runs"), F.count("*").alias("balls"), F.sum("wicket").alias("outs")
        )

    @property
    def bowling(self) -> DataFrame:
        return self.deliveries.groupBy("match_id", F.col("bowler").alias("player")).agg(
            F.sum("wicket").alias("wickets"), F.sum("runs").alias("runs_given"), F.count("*").alias("balls_bowled")
        )

    def dated(self, stats: DataFrame) -> DataFrame:
        return stats.join(self.matches.select("match_id", "match_date", "season"), "match_id")

    @property
    def scored(self) -> DataFrame:
        """Decided matches with a deterministic pseudo-probability for side 1."""
        p1 = ((F.col("match_id") * 37) % 101) / F.lit(100.0)
        return self.matches.filter(F.col("winner").isNotNull()).select(
            "match_id", "season", "match_date", "team1", "team2", "venue",
            rules.won_by_side1(F.col("winner"), F.col("team1")).alias("label"),
            p1.alias("p1"),
            (p1 >= 0.5).cast("int").alias("pred"),
        )

    @property
    def multi(self) -> DataFrame:
        """Events as five-class predictions: class index, and integer weights per class."""
        e = self.read("events")
        classes = ["click", "error", "purchase", "signup", "view"]
        label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("event_type")) - 1
        w = [(F.col("event_id") * (c + 3) + c) % 17 + 1 for c in range(5)]
        return e.select("event_id", label.cast("int").alias("label"), F.array(*w).alias("w"))

    @property
    def log(self) -> DataFrame:
        """Prediction log: one row per match, closed where a winner is known."""
        p1 = ((F.col("match_id") * 37) % 101) / F.lit(100.0)
        r = self.results
        first = F.when(F.col("match_id") % 3 == 0, F.col("runs_1")).otherwise(F.col("runs_2"))
        return r.select(
            "match_id", "match_date", "team1", "team2", "venue", "toss_winner", "toss_decision",
            F.when(p1 >= 0.5, F.col("team1")).otherwise(F.col("team2")).alias("predicted"),
            F.greatest(p1, 1 - p1).alias("confidence"),
            F.col("winner").alias("actual"),
            F.when(F.col("match_id") % 5 != 0, first).alias("first_score"),
        )


_MATCHES = """matches AS (
  SELECT match_id, match_date, CAST(year(match_date) AS INTEGER) AS season, team1, team2, venue,
         CASE WHEN match_id % 2 = 0 THEN team1 ELSE team2 END AS toss_winner,
         CASE WHEN match_id % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
         CASE WHEN st = 'F' THEN team1 WHEN st = 'O' THEN team2 END AS winner
  FROM (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date,
               'NATION_' || c_nationkey AS team1,
               'NATION_' || ((c_nationkey + 1 + o_orderkey % 24) % 25) AS team2,
               o_orderpriority AS venue, o_orderstatus AS st
        FROM orders JOIN customer ON o_custkey = c_custkey))"""

_LONG = """long AS (
  SELECT match_id, match_date, season, venue, 1 AS side, team1 AS team, team2 AS opponent, winner FROM matches
  UNION ALL
  SELECT match_id, match_date, season, venue, 2, team2, team1, winner FROM matches)"""

_DELIVERIES = """deliveries AS (
  SELECT l_orderkey AS match_id, CAST(l_suppkey % 2 + 1 AS INTEGER) AS side, l_linenumber AS over_no,
         CAST(l_quantity AS BIGINT) AS runs, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS wicket,
         'Player ' || l_suppkey AS batter, 'Player ' || ((l_suppkey + l_linenumber) % 100) AS bowler
  FROM lineitem)"""

_INNINGS = """innings AS (
  SELECT match_id, side, CAST(sum(runs) AS BIGINT) AS runs, count(*) AS balls,
         CAST(sum(wicket) AS BIGINT) AS wkts,
         CAST(sum(CASE WHEN over_no < 3 THEN runs ELSE 0 END) AS BIGINT) AS pp_runs,
         CAST(sum(CASE WHEN over_no >= 6 THEN runs ELSE 0 END) AS BIGINT) AS death_runs
  FROM deliveries GROUP BY 1, 2)"""

_RESULTS = """results AS (
  SELECT m.*, coalesce(a.runs, 0) AS runs_1, coalesce(a.balls, 0) AS balls_1, coalesce(a.wkts, 0) AS wkts_1,
         coalesce(a.pp_runs, 0) AS pp_runs_1, coalesce(a.death_runs, 0) AS death_runs_1,
         coalesce(b.runs, 0) AS runs_2, coalesce(b.balls, 0) AS balls_2, coalesce(b.wkts, 0) AS wkts_2,
         coalesce(b.pp_runs, 0) AS pp_runs_2, coalesce(b.death_runs, 0) AS death_runs_2
  FROM matches m LEFT JOIN innings a ON a.match_id = m.match_id AND a.side = 1
       LEFT JOIN innings b ON b.match_id = m.match_id AND b.side = 2)"""

_LINEUPS = """lineups AS (
  SELECT DISTINCT match_id, side, batter AS player FROM deliveries)"""

_LINEUP_LONG = """lineup_long AS (
  SELECT l.match_id, m.match_date, l.side, CASE WHEN l.side = 1 THEN m.team1 ELSE m.team2 END AS team,
         l.player, m.venue
  FROM lineups l JOIN matches m ON l.match_id = m.match_id)"""

_BATTING = """batting AS (
  SELECT match_id, batter AS player, CAST(sum(runs) AS BIGINT) AS runs, count(*) AS balls,
         CAST(sum(wicket) AS BIGINT) AS outs FROM deliveries GROUP BY 1, 2)"""

_BOWLING = """bowling AS (
  SELECT match_id, bowler AS player, CAST(sum(wicket) AS BIGINT) AS wickets,
         CAST(sum(runs) AS BIGINT) AS runs_given, count(*) AS balls_bowled FROM deliveries GROUP BY 1, 2)"""

_SCORED = """scored AS (
  SELECT match_id, season, match_date, team1, team2, venue,
         CASE WHEN winner = team1 THEN 1 ELSE 0 END AS label,
         ((match_id * 37) % 101) / 100.0::DOUBLE AS p1,
         CASE WHEN ((match_id * 37) % 101) / 100.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS pred
  FROM matches WHERE winner IS NOT NULL)"""

_MULTI = """multi AS (
  SELECT event_id, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER)
           AS label,
         [(event_id * 3 + 0) % 17 + 1, (event_id * 4 + 1) % 17 + 1, (event_id * 5 + 2) % 17 + 1,
          (event_id * 6 + 3) % 17 + 1, (event_id * 7 + 4) % 17 + 1] AS w
  FROM events)"""

_LOG = """log AS (
  SELECT match_id, match_date, team1, team2, venue, toss_winner, toss_decision,
         CASE WHEN ((match_id * 37) % 101) / 100.0::DOUBLE >= 0.5 THEN team1 ELSE team2 END AS predicted,
         greatest(((match_id * 37) % 101) / 100.0::DOUBLE, 1 - ((match_id * 37) % 101) / 100.0::DOUBLE)
           AS confidence,
         winner AS actual,
         CASE WHEN match_id % 5 <> 0 THEN CASE WHEN match_id % 3 = 0 THEN runs_1 ELSE runs_2 END END AS first_score
  FROM results)"""

_VIEWS = {
    "matches": ([], _MATCHES),
    "long": (["matches"], _LONG),
    "deliveries": ([], _DELIVERIES),
    "innings": (["deliveries"], _INNINGS),
    "results": (["matches", "innings"], _RESULTS),
    "lineups": (["deliveries"], _LINEUPS),
    "lineup_long": (["lineups", "matches"], _LINEUP_LONG),
    "batting": (["deliveries"], _BATTING),
    "bowling": (["deliveries"], _BOWLING),
    "scored": (["matches"], _SCORED),
    "multi": ([], _MULTI),
    "log": (["results"], _LOG),
}


def cte(*names: str) -> str:
    """``WITH`` prefix holding the named views and what they build on."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in _VIEWS[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(_VIEWS[n][1] for n in done)
