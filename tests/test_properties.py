"""Properties and brute-force checks on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.functions import lineups as L, rules as R, text as X
from pitchline.operators import evaluate as E, joins as J, priors, ratings, upsert as U


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(5)
    teams = ["Reds", "Blues", "Greens", "Golds"]
    rows = []
    for i in range(120):
        a, b = rng.sample(teams, 2)
        rows.append((i, f"2020-{1 + i // 12:02d}-{1 + i % 12:02d}", a, b, rng.choice(["North", "South"]), rng.choice([a, b]),
                     rng.choice(["bat", "field"]), rng.choice([a, b, None])))
    df = spark.createDataFrame(rows, "match_id bigint, d string, team1 string, team2 string, venue string, toss_winner string, "
                               "toss_decision string, winner string")
    return df.withColumn("match_date", F.to_date("d")).drop("d").persist()


def rows_of(df):
    return {r.match_id: r for r in df.collect()}


@pytest.mark.parametrize("build", [
    lambda m: priors.team_form(m), lambda m: priors.venue_chase(m), lambda m: priors.head_to_head(m),
    lambda m: priors.head_to_head_any_order(m), lambda m: priors.venue_team(m), lambda m: priors.venue_toss_side(m),
])
def test_own_outcome_never_leaks(matches, build):
    """Turning one match's winner around changes later rows only."""
    turned = matches.withColumn("winner", F.when(F.col("match_id") == 60, F.when(
        F.col("winner") == F.col("team1"), F.col("team2")).otherwise(F.col("team1"))).otherwise(F.col("winner")))
    a, b = rows_of(build(matches)), rows_of(build(turned))
    assert all(a[i] == b[i] for i in range(61))
    assert any(a[i] != b[i] for i in range(61, 120))


def brute_elo(rows):
    rating, played, prior = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.match_date, r.match_id)):
        m1, m2 = ([rating.get((r.league, p), 1000.0) for p in ps] or [1000.0] for ps in (r.players1, r.players2))
        a, b = np.mean(m1), np.mean(m2)
        prior[r.match_id] = (a, b)
        d = 20.0 * (r.score - 1 / (1 + 10 ** ((b - a) / 400)))
        for ps, x in ((r.players1, d), (r.players2, -d)):
            for p in ps:
                rating[(r.league, p)] = rating.get((r.league, p), 1000.0) + x
                played[(r.league, p)] = played.get((r.league, p), 0) + 1
    return prior, rating, played


@pytest.mark.parametrize("slice_rows", [1000, 17])
def test_lineup_rating(spark, slice_rows):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else "cold", i, i // 3, *np.array_split(rng.sample([f"p{k}" for k in range(12)], 6), 2),
             rng.choice([0.0, 0.5, 1.0])) for i in range(80)]
    df = spark.createDataFrame([(a, b, c, list(map(str, d)), list(map(str, e)), f) for a, b, c, d, e, f in rows],
                               "league string, match_id bigint, match_date int, players1 array<string>, players2 array<string>, score double")
    prior, final = ratings.lineup_ratings(df, slice_rows=slice_rows)
    want_prior, want_rating, played = brute_elo(df.collect())
    for r in prior.collect():
        assert np.allclose((r.avg1, r.avg2), want_prior[r.match_id])
    got = {(r.league, r.player): r for r in final.collect()}
    assert set(got) == set(want_rating)
    assert all(abs(got[k].rating - want_rating[k]) < 1e-9 and got[k].matches == played[k] for k in got)
    # Equal numbers on both sides: what one wins the other loses.
    assert abs(sum(r.rating - 1000 for r in got.values())) < 1e-6


def test_anchored_rating(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.choice([0.0, 0.5, 1.0])) for i in range(70)]
    want = {}
    for k, _, s in rows:
        r = want.get(k, 1000.0)
        want[k] = r + 20 * (s - 1 / (1 + 10 ** ((1000 - r) / 400)))
    df = spark.createDataFrame(rows, "k string, t int, s double")
    got = {r.k: r.rating for r in ratings.anchored_ratings(df, "k", ["t"], F.col("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.6, 0.45])
def test_fuzzy_lookup_finds_what_all_pairs_find(spark, cutoff):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))).strip() or "a"
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)})
    got = {r.n: (r.match, r.score) for r in J.fuzzy_lookup(
        spark.createDataFrame([(w,) for w in left], "n string"), spark.createDataFrame([(w,) for w in right], "t string"), "n", "t", cutoff).collect()}
    for w in left:
        scored = sorted(((-(1 - distance(w, k) / max(len(w), len(k))), k) for k in right))
        best = [(-s, k) for s, k in scored if -s >= cutoff - 1e-12]
        want = (best[0][1], best[0][0]) if best else (w, None)
        assert got[w][0] == want[0], (w, got[w], want)


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = U.merge_columns(old, new, ["id"], ["v"])
    twice = U.merge_columns(once, new, ["id"], ["v"])
    want = {(1, "a", "x"), (2, "B", "y"), (3, "C", None)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}
    rep = U.replace_by_key(old, new, ["id"])
    assert {tuple(r) for r in rep.collect()} == {(1, "a", "x"), (2, "B", None), (3, "C", None)}


def test_page_rules(spark):
    one = spark.createDataFrame([(1,)], "i int")
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(X.heading_side(F.lit("Reds vs Blues, 3rd Match"), 2)) == "Blues"
    assert get(X.heading_side(F.lit("no pair"), 1)) == ""
    assert get(X.last_score(F.lit("Reds 45-2 then Reds 180-5 (20 Ovs)"), F.lit("Reds"))).asDict() == {"runs": 180.0, "wkts": 5.0, "overs": 20.0}
    assert get(X.venue_fact(F.lit('{"location": {"type":"P", "name": "Main  Ground"}}'), F.lit(""), P.UNKNOWN)) == "Main Ground"
    assert get(X.venue_fact(F.lit(""), F.lit("Venue Big Park, Oldtown 12"), P.UNKNOWN)) == "Big Park, Oldtown"
    assert get(X.venue_fact(F.lit(""), F.lit("nothing"), P.UNKNOWN)) == P.UNKNOWN
    assert get(X.text_list(F.lit('["A", " B ", ""]'))) == ["A", "B"] and get(X.text_list(F.lit("A| B |"))) == ["A", "B"]
    assert get(X.text_list(F.lit(None).cast("string"))) == []
    assert get(L.padded(F.array(F.lit("A"), F.lit(" ")), 3, numbered=True)) == ["A", "Unknown_Player_2", "Unknown_Player_3"]
    assert get(R.squad_multiplier(F.lit(None).cast("double"))) == 1.0
    assert get(R.balls_of(F.lit(3.4))) == 22 and abs(get(R.balls_of(F.lit(3.4), False)) - 20.4) < 1e-9
    assert get(X.instant(F.lit("2026-04-01T14:00:00Z"))).isoformat() == "2026-04-01T14:00:00"


@pytest.mark.parametrize("text,winner", [
    ("Reds won by 5 runs", "Reds"), ("the blues  won by 1 wicket", "Blues"), ("Redstart won by 2 runs", "Reds"), ("no result", ""),
])
def test_report_winner(spark, text, winner):
    df = spark.createDataFrame([(text, "Reds", "Blues")], "body string, a string, b string")
    assert X.report_facts(df, "body", "a", "b", {}).first().winner == winner


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 1), (0.95, 0), (0.61, 1)], "c double, ok int")
    bins = {r.bin: r.n for r in E.calibration_bins(df, F.col("c"), F.col("ok") == 1).collect()}
    assert bins == {9: 2, 6: 1}
    ece = E.expected_calibration_error(df, F.col("c"), F.col("ok") == 1).first().ece
    assert abs(ece - (2 * 0.45 + 0.39) / 4) < 1e-9


def test_report_handles_missing_classes(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (2, 0)], "y int, p int")
    rep = {r["class"]: r for r in E.class_report(df, "y", "p").collect()}
    assert rep[1].support == 0 and rep[1].recall == 0 and rep[2].precision == 0 and rep[0].tp == 1
    assert abs(E.averages(E.class_report(df, "y", "p")).first().balanced_accuracy - 0.25) < 1e-9


def test_p_values(spark):
    """Textbook points: t=2.228 at 10 df and F=4.103 at (2, 10) df are both 5 percent."""
    r = 2.228139 / np.sqrt(2.228139 ** 2 + 10)
    df = spark.createDataFrame([(float(r), 12)], "r double, n bigint")
    assert abs(df.select(E.correlation_p("r", "n").alias("p")).first().p - 0.05) < 1e-5
    f = spark.createDataFrame([(4.102821, 2.0, 10.0)], "f double, a double, b double")
    assert abs(f.select(E.f_test_p("f", "a", "b").alias("p")).first().p - 0.05) < 1e-5


@pytest.mark.parametrize("patterns", [50_000, 3])
def test_contains_override_by_brute_force(spark, patterns):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abC") for _ in range(n))
    texts = [(i, rng.choice([None, "", word(rng.randint(1, 30))]), rng.choice([None, "old"])) for i in range(300)]
    rules = [(word(rng.randint(1, 6)), f"v{i}", rng.randint(1, 12)) for i in range(25)] + [("", "never", 99), (None, "never", 99), ("É", "e", 5)]
    texts.append((1000, "xéx", "old"))
    df = spark.createDataFrame(texts, "id long, t string, v string")
    got = {r.id: r.v for r in J.contains_override(df, "t", spark.createDataFrame(rules, "pattern string, new_value string, ord int"), "v", patterns).collect()}
    for i, t, old in texts:
        hits = [(o, v) for p, v, o in rules if p and t and p.lower() in t.lower()]
        assert got[i] == (max(hits)[1] if hits else old)


def test_contains_override_shuffles_no_texts(spark):
    rules = spark.createDataFrame([("a", "x", 1)], "pattern string, new_value string, ord int")
    out = J.contains_override(spark.range(10).select(F.col("id").cast("string").alias("t"), F.lit("o").alias("v")), "t", rules, "v")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    nothing = J.contains_override(out, "t", rules.limit(0), "v")
    assert nothing.count() == 10


def test_fallback_rows_only_without_a_hold_out(spark):
    from pitchline.operators import scoring as SC

    log = spark.createDataFrame([(1, "A", "A", None, "BAT ", 2020), (2, " ", "B", "B", "x", 2020), (3, "C", "C", "D", "field", 2021)],
                                "match_id long, actual string, team1 string, toss_winner string, toss_decision string, season int")
    primary = log.withColumn("label", F.col("actual"))
    pick = lambda p: {tuple(r) for r in SC.evaluation_source(p, log, "actual", "label", {"f": 0.5, "season": 7}, F.col("season") == 2020).collect()}
    assert pick(primary.limit(0)) == {(1, "A", "A", "bat", 0.5, 2020.0)}
    assert pick(primary.filter("match_id = 3")) == {(3, "C", "D", "field", 0.5, 2021.0)}
