"""Readers and writers on small files with invented names."""

import pytest
from pyspark.sql import functions as F

from pitchline.operators import facts
from pitchline.sources import documents as D, pages as PG, tables as T

GOOD = """
info:
  competition: L1
  dates: [2021-05-01]
  teams: [Reds, Blues]
  players: {Reds: [A One, B Two], Blues: [C Three]}
  toss: {winner: Blues, decision: field}
  outcome: {winner: Reds}
  venue: North
innings:
- 1st innings:
    team: Reds
    deliveries:
    - 0.1: {batsman: A One, bowler: C Three, runs: {batsman: 4, extras: 0, total: 4}}
    - 0.1: {batsman: A One, bowler: C Three, runs: {total: 1}, extras: {wides: 1}}
    - 12.10: {batsman: B Two, bowler: C Three, runs: {total: 0}, wicket: {kind: bowled, player_out: B Two}}
    - 16.2: {batsman: A One, bowler: C Three, runs: {total: 6}}
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "1000001.yaml").write_text(GOOD)
    (tmp_path / "77.yaml").write_text("info: {competition: L1, teams: [Reds, Blues]}\n")
    (tmp_path / "broken.yaml").write_text("\t- {nope\n")
    return str(tmp_path)


def test_documents(spark, folder):
    docs = D.decode(D.scan_text(spark, folder)).cache()
    good, bad = D.good_and_bad(docs)
    assert [r.doc_id for r in bad.collect()] == ["broken"]
    rows = {r.doc_id: r for r in good.collect()}
    assert rows["1000001"].players1 == ["A One", "B Two"] and rows["1000001"].toss_winner == "Blues"
    assert rows["77"].innings == [] and rows["77"].winner is None
    balls = D.deliveries(good)
    assert [(r.ball_no, r.over_no) for r in balls.orderBy("ball_no").collect()] == [(0, 0), (1, 0), (2, 12), (3, 16)]
    t = facts.innings_totals(balls, ["match_id", "team"]).first()
    assert (t.match_id, t.runs, t.balls, t.wkts, t.pp_runs, t.death_runs) == (1000001, 11, 4, 1, 5, 6)
    heads = D.scan_text(spark, folder).select("doc_id", D.header_of(F.col("text")).alias("h"))
    assert "deliveries" not in {r.doc_id: r.h for r in heads.collect()}["1000001"]


def test_csv(spark, tmp_path):
    p = tmp_path / "links.csv"
    p.write_text("match_id,url\n1,a\nx,b\n")
    got = T.read_csv(spark, str(p), "match_id bigint, url string, extra string", ["match_id", "url"]).collect()
    assert [tuple(r) for r in got] == [(1, "a", None), (None, "b", None)]
    with pytest.raises(ValueError, match="squads"):
        T.read_csv(spark, str(p), "match_id bigint", ["match_id", "squads"])


def test_jsonp_and_feed(spark):
    one = spark.createDataFrame([('cb({"other": [{"k": 1}, {"k": 2}]});',), ('cb({"a": [], "stats": [{"k": 3}]})',), ("junk",)], "t string")
    rows = [r.r for r in one.select(D.jsonp_rows(F.col("t"), "stats", "struct<k:bigint>").alias("r")).collect()]
    assert [[x.k for x in r] if r else None for r in rows] == [[1, 2], [3], None]
    feed = spark.createDataFrame([('{"matches": [{"pre_match": {"match_id": "5"}}, {"status": "LIVE", "pre_match": {}}]}',)], "value string")
    assert [(r.status, r.pre_match.match_id, r.post_match) for r in D.feed_matches(feed).collect()] == [("upcoming", "5", None)]


def test_link_inventory(spark):
    df = spark.createDataFrame([("/s/12/x /q/12/x /s/7/y",), ("/q/9/z",)], "t string")
    out = PG.link_inventory(df, "t", r"/s/(\d+)/[a-z]+", r"/q/(\d+)/[a-z]+", F.concat(F.lit("S"), "link_id"), F.concat(F.lit("Q"), "link_id"))
    assert {tuple(r) for r in out.collect()} == {(12, "/s/12/x", "/q/12/x"), (7, "/s/7/y", "Q7"), (9, "S9", "/q/9/z")}


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, "2021-01-02"), (1, "2021-01-01")], "id int, d string").withColumn("d", F.to_date("d"))
    T.write_table(df, str(tmp_path / "t"), ["d", "id"], "d")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "2021-01-01"), (2, "2021-01-02")}
