"""Ratings, evaluation, drift and statistics over the match-shaped views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.functions import rules as R
from pitchline.operators import evaluate as E, ratings, scoring as SC, splits as S
from pitchline.operators.ordered import top_n
from pitchline.plans.prior_queries import rounded
from pitchline.plans.registry import query
from pitchline.plans.views import Tables, cte


def rated_matches(t: Tables):
    """Venue as the league; both lineups and side 1's score."""
    lu = t.lineups
    sides = lu.groupBy("match_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col("players"))).alias(f"players{s}") for s in (1, 2)])
    none = F.array().cast("array<string>")
    return t.matches.join(sides, "match_id", "left").select(
        F.col("venue").alias("league"), "match_id", "match_date",
        F.coalesce("players1", none).alias("players1"), F.coalesce("players2", none).alias("players2"),
        R.side_score(F.col("winner"), F.col("team1"), F.col("team2")).alias("score"))


@query("rec1_lineup_rating_prior")
def rec1(t: Tables):
    prior, _ = ratings.lineup_ratings(rated_matches(t), rows=t.rows("orders"))
    return rounded(prior, "avg1", "max1", "min1", "avg2", "max2", "min2", "gap")


@query("rec2_final_rating_table")
def rec2(t: Tables):
    _, final = ratings.lineup_ratings(rated_matches(t), rows=t.rows("orders"))
    return ratings.rating_table(rounded(final, "rating"))


@query("rec3_anchored_rating", """
WITH l AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN 0.0 ELSE 0.5 END
             ORDER BY ts, event_id) AS s, count(*) AS games FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(list_prepend(1000.0::DOUBLE, s),
  lambda r, x: r + 20 * (x - 1 / (1 + pow(10.0, (1000.0 - r) / 400)))), 5) AS rating, games FROM l""")
def rec3(t: Tables):
    score = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0).otherwise(0.5)
    out = ratings.anchored_ratings(t.read("events"), "user_id", ["ts", "event_id"], score)
    return rounded(out, "rating", digits=5)


# --- evaluation -------------------------------------------------------------

_ACC = """, a AS (SELECT count(*) AS n, avg(CASE WHEN label = pred THEN 1 ELSE 0 END) AS acc FROM scored),
c AS (SELECT label AS class, avg(CASE WHEN pred = label THEN 1 ELSE 0 END) AS recall FROM scored GROUP BY 1)"""

_REPORT = """, k AS (SELECT * FROM (VALUES (0), (1)) v(class)),
q AS (SELECT class, (SELECT count(*) FROM scored WHERE label = class) AS support,
             (SELECT count(*) FROM scored WHERE pred = class) AS predicted_n,
             (SELECT count(*) FROM scored WHERE pred = class AND label = class) AS tp FROM k),
r AS (SELECT *, coalesce(tp / nullif(predicted_n, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS rc FROM q),
f AS (SELECT *, coalesce(2 * p * rc / nullif(p + rc, 0), 0) AS f1 FROM r)"""


@query("evl1_accuracy", cte("scored") + _ACC + """
SELECT round(acc, 6) AS accuracy, round((SELECT avg(recall) FROM c), 6) AS balanced_accuracy FROM a""")
def evl1(t: Tables):
    a = E.averages(E.class_report(t.scored, "label", "pred"))
    return rounded(a.select("accuracy", "balanced_accuracy"), "accuracy", "balanced_accuracy")


@query("evl2_precision_recall_f1", cte("scored") + _REPORT + " SELECT " + ", ".join(
    f"round(avg({c}), 6) AS {n}_macro, round(sum({c} * support) / sum(support), 6) AS {n}_weighted"
    for c, n in (("p", "precision"), ("rc", "recall"), ("f1", "f1"))) + " FROM f")
def evl2(t: Tables):
    a = E.averages(E.class_report(t.scored, "label", "pred")).drop("accuracy", "balanced_accuracy")
    return rounded(a, *a.columns)


@query("evl3_confusion_matrix", cte("scored") + """
SELECT label AS actual, count(*) FILTER (pred = 0) AS n_0, count(*) FILTER (pred = 1) AS n_1,
  round(count(*) FILTER (pred = 0) / count(*), 6) AS share_0, round(count(*) FILTER (pred = 1) / count(*), 6) AS share_1
FROM scored GROUP BY 1""")
def evl3(t: Tables):
    return rounded(E.confusion_matrix(t.scored, "label", "pred", [0, 1]), "share_0", "share_1")


@query("evl4_classification_report", cte("scored") + _REPORT + """
SELECT CAST(class AS VARCHAR) AS row, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def evl4(t: Tables):
    return rounded(E.full_report(t.scored, "label", "pred"), "precision", "recall", "f1")


@query("evl5_log_loss", cte("scored") + """
SELECT season, round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15), 1 - 1e-15))), 6) AS log_loss
FROM scored GROUP BY 1""")
def evl5(t: Tables):
    p = F.when(F.col("label") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    return rounded(t.scored.groupBy("season").agg(E.log_loss(p).alias("log_loss")), "log_loss")


_MP = """, mp AS (SELECT event_id, label, list_transform(w, lambda x: x / list_sum(w)::DOUBLE) AS prob FROM multi)"""


def multi_prob(t: Tables):
    m = t.multi.withColumn("total", F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return m.select("event_id", "label", F.transform("w", lambda x: x / F.col("total")).alias("prob"))


@query("evl6_brier", cte("multi") + _MP + """
SELECT round(avg(list_sum(list_transform(prob, lambda p, i: pow(p - CASE WHEN i - 1 = label THEN 1 ELSE 0 END, 2)))), 6) AS brier FROM mp""")
def evl6(t: Tables):
    return rounded(multi_prob(t).agg(E.brier(F.col("prob"), F.col("label")).alias("brier")), "brier")


@query("evl7_top_k_accuracy", cte("multi") + _MP + """, r AS (
  SELECT 1 + len(list_filter(prob, lambda p, i: p > prob[label + 1] OR (p = prob[label + 1] AND i - 1 < label))) AS rk FROM mp)
SELECT round(avg(CASE WHEN rk <= 2 THEN 1 ELSE 0 END), 6) AS top2, round(avg(CASE WHEN rk <= 3 THEN 1 ELSE 0 END), 6) AS top3 FROM r""")
def evl7(t: Tables):
    return rounded(multi_prob(t).agg(*[
        E.top_k_accuracy(F.col("prob"), F.col("label"), k).alias(f"top{k}") for k in (2, 3)]), "top2", "top3")


_BINS = """, b AS (SELECT CAST(floor(greatest(p1, 1 - p1) * 10) AS INTEGER) AS bin, greatest(p1, 1 - p1) AS conf,
  CASE WHEN pred = label THEN 1 ELSE 0 END AS ok FROM scored),
g AS (SELECT bin, count(*) AS n, avg(ok) AS acc, avg(conf) AS conf FROM b WHERE bin < 10 GROUP BY 1)"""


def _conf():
    return F.greatest(F.col("p1"), 1 - F.col("p1")), F.col("pred") == F.col("label")


@query("evl8_calibration_error", cte("scored") + _BINS + """
SELECT round(sum(n * abs(acc - conf)) / (SELECT count(*) FROM scored), 6) AS ece FROM g""")
def evl8(t: Tables):
    return rounded(E.expected_calibration_error(t.scored, *_conf()), "ece")


@query("evl9_reliability_curve", cte("scored") + _BINS + """
SELECT bin, n, round(acc, 6) AS accuracy, round(conf, 6) AS confidence, round((bin + 0.5::DOUBLE) / 10, 6) AS center FROM g""")
def evl9(t: Tables):
    return rounded(E.calibration_bins(t.scored, *_conf()), "accuracy", "confidence", "center")


@query("evl10_roc_points", cte("scored") + """, h AS (
  SELECT p1, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1)
SELECT p1 AS score, round(sum(pos) OVER (ORDER BY p1 DESC) / (SELECT sum(label) FROM scored), 6) AS tpr,
  round(sum(neg) OVER (ORDER BY p1 DESC) / (SELECT sum(1 - label) FROM scored), 6) AS fpr FROM h""")
def evl10(t: Tables):
    return rounded(E.roc_points(t.scored, F.col("p1"), F.col("label") == 1).select("score", "tpr", "fpr"), "tpr", "fpr")


_AUC = """, rk AS (SELECT label, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0::DOUBLE AS r FROM scored),
s AS (SELECT sum(CASE WHEN label = 1 THEN r END) AS sr, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM rk)"""


@query("evl10_auc", cte("scored") + _AUC + " SELECT round((sr - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM s")
def evl10b(t: Tables):
    return rounded(E.auc(E.roc_points(t.scored, F.col("p1"), F.col("label") == 1)).select("auc"), "auc")


@query("evl10_auc_ovr_weighted", cte("multi") + _MP + """, u AS (
  SELECT CASE WHEN label = c THEN 1 ELSE 0 END AS y, c, p FROM (SELECT label, unnest(range(5)) AS c, unnest(prob) AS p FROM mp)),
rk AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY p) + (count(*) OVER (PARTITION BY c, p) - 1) / 2.0::DOUBLE AS r FROM u),
s AS (SELECT c, sum(CASE WHEN y = 1 THEN r END) AS sr, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM rk GROUP BY 1)
SELECT round(sum((sr - np * (np + 1) / 2) / (np * nn) * np) / sum(np), 6) AS auc_weighted FROM s""")
def evl10c(t: Tables):
    return rounded(E.auc_ovr_weighted(multi_prob(t), "prob", "label"), "auc_weighted")


_SPLIT_METRICS = """, m AS (SELECT venue, CASE WHEN season >= 2000 THEN 'test' ELSE 'train' END AS split, label, pred,
  -ln(least(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-15), 1 - 1e-15)) AS ll FROM scored),
x AS (SELECT venue, split, avg(CASE WHEN label = pred THEN 1 ELSE 0 END) AS acc, avg(ll) AS ll,
        2 * sum(label * pred) / nullif(sum(label) + sum(pred), 0) AS f1 FROM m GROUP BY 1, 2),
y AS (SELECT a.venue, a.acc AS train_accuracy, b.acc AS test_accuracy, a.f1 AS train_f1, b.f1 AS test_f1,
        a.ll AS train_log_loss, b.ll AS test_log_loss FROM x a JOIN x b ON a.venue = b.venue AND a.split = 'train' AND b.split = 'test')"""


def split_metrics(t: Tables):
    test = F.col("season") >= 2000
    y, p = F.col("label"), F.col("pred")
    p_true = F.when(y == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    cols = []
    for name, cond in (("train", ~test), ("test", test)):
        only = lambda c: F.when(cond, c)
        cols += [
            F.avg(only((y == p).cast("int"))).alias(f"{name}_accuracy"),
            (2 * F.sum(only(y * p)) / F.nullif(F.sum(only(y)) + F.sum(only(p)), F.lit(0))).alias(f"{name}_f1"),
            E.log_loss(only(p_true)).alias(f"{name}_log_loss"),
        ]
    return t.scored.groupBy("venue").agg(*cols)


@query("evl11_fit_gaps", cte("scored") + _SPLIT_METRICS + """
SELECT venue, round(train_f1 - test_f1, 6) AS fit_gap, round(test_log_loss - train_log_loss, 5) AS log_loss_gap,
  round(test_accuracy - 0.25 * greatest(train_f1 - test_f1, 0), 6) AS generalization FROM y""")
def evl11(t: Tables):
    g = E.fit_gaps(split_metrics(t)).select("venue", "fit_gap", "log_loss_gap", "generalization")
    return rounded(rounded(g, "fit_gap", "generalization"), "log_loss_gap", digits=5)


@query("evl12_fit_diagnosis", cte("scored") + _SPLIT_METRICS + """
SELECT venue, CASE WHEN train_f1 - test_f1 > 0.12 THEN 'overfitting_risk' WHEN train_f1 < 0.5 AND test_f1 < 0.5
    THEN 'underfitting_risk' ELSE 'balanced' END AS status,
  CASE WHEN train_accuracy >= 0.85 AND train_accuracy - test_accuracy > 0.12 THEN 'Overfitting'
    WHEN train_accuracy < 0.6 AND test_accuracy < 0.6 THEN 'Underfitting' ELSE 'Reasonable Fit' END AS diagnosis FROM y""")
def evl12(t: Tables):
    return split_metrics(t).select("venue", E.fit_status(F.col("train_f1"), F.col("test_f1")).alias("status"),
                                   E.fit_diagnosis(F.col("train_accuracy"), F.col("test_accuracy")).alias("diagnosis"))


@query("evl13_prediction_report", cte("log") + """
SELECT match_id, team1 || ' vs ' || team2 AS fixture, predicted, coalesce(actual, 'PENDING') AS actual,
  CASE WHEN actual IS NULL THEN '-' WHEN predicted = actual THEN 'YES' ELSE 'NO' END AS hit, 'auto' AS source FROM log""")
def evl13(t: Tables):
    hit = F.when(F.col("actual").isNull(), "-").when(F.col("predicted") == F.col("actual"), "YES").otherwise("NO")
    return t.log.select("match_id", F.concat_ws(" vs ", "team1", "team2").alias("fixture"), "predicted",
                        F.coalesce("actual", F.lit("PENDING")).alias("actual"), hit.alias("hit"), F.lit("auto").alias("source"))


@query("evl14_model_health", cte("scored") + """, p AS (
  SELECT label, pred, p1, row_number() OVER (PARTITION BY label ORDER BY match_id * 31 % 1009, match_id) AS pos,
         count(*) OVER (PARTITION BY label) AS n FROM scored),
te AS (SELECT * FROM p WHERE pos > floor(n * 0.8)),
rk AS (SELECT label, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0::DOUBLE AS r FROM te),
s AS (SELECT sum(CASE WHEN label = 1 THEN r END) AS sr, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM rk),
a AS (SELECT count(*) AS samples_test, avg(CASE WHEN label = pred THEN 1 ELSE 0 END) AS acc FROM te)
SELECT samples_test, round(acc, 4) AS accuracy, round((sr - np * (np + 1) / 2) / (np * nn), 4) AS auc,
  CASE WHEN acc >= 0.65 THEN 'good' ELSE 'needs_attention' END AS status FROM a, s""")
def evl14(t: Tables):
    parts = S.stratified_split(t.scored, "label", "match_id")
    test = parts.filter("is_test")
    auc = E.auc(E.roc_points(test, F.col("p1"), F.col("label") == 1)).select("auc").scalar()
    a = test.agg(F.count("*").alias("samples_test"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("acc"))
    return a.select("samples_test", F.round("acc", 4).alias("accuracy"), F.round(auc, 4).alias("auc"),
                    E.health_status(F.col("acc"), P.HEALTHY_ACCURACY).alias("status"))


# --- drift ------------------------------------------------------------------

@query("drf1_numeric_drift", cte("results") + "".join(f"""{' UNION ALL' if i else ''}
SELECT '{c}' AS column_name, round_even(a, 4) AS train_mean, round_even(b, 4) AS test_mean,
  round_even(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE (b - a) / s END, 4) AS mean_shift_z FROM (
  SELECT avg({e}) FILTER (season < 2000) AS a, avg({e}) FILTER (season >= 2000) AS b,
         stddev_samp({e}) FILTER (season < 2000) AS s FROM results)""" for i, (c, e) in enumerate((
    ("runs_prior", "runs_1"), ("wkts_5", "wkts_2"), ("const_prior", "7")))))
def drf1(t: Tables):
    df = t.results.select((F.col("season") >= 2000).alias("is_test"), F.col("runs_1").alias("runs_prior"),
                          F.col("wkts_2").alias("wkts_5"), F.lit(7).alias("const_prior"), "balls_1")
    return E.numeric_drift(df, "is_test", E.drift_columns(df.columns))


@query("drf2_unseen_categories", cte("matches") + "".join(f"""{' UNION ALL' if i else ''}
SELECT '{c}' AS column_name, round(avg(CASE WHEN {e} IN (SELECT {e} FROM matches WHERE season < 2000) THEN 0 ELSE 1 END), 6)
  AS unseen_rate FROM matches WHERE season >= 2000""" for i, (c, e) in enumerate((
    ("fixture", "team1 || '|' || team2 || '|' || venue || '|' || toss_winner || toss_decision"), ("venue", "venue"), ("day", "CAST(match_date AS VARCHAR)")))))
def drf2(t: Tables):
    m = t.matches.select(
        (F.col("season") >= 2000).alias("is_test"),
        F.concat(F.concat_ws("|", "team1", "team2", "venue", "toss_winner"), "toss_decision").alias("fixture"), "venue",
        F.col("match_date").cast("string").alias("day"))
    return rounded(E.unseen_categories(m, "is_test", ["fixture", "venue", "day"]), "unseen_rate")


@query("drf3_unseen_players", cte("lineup_long") + """, s AS (
  SELECT l.match_id, l.side || l.player || l.venue || l.team AS player, row_number() OVER (PARTITION BY match_id, side ORDER BY player) AS slot,
         year(match_date) >= 2000 AS te FROM lineup_long l),
f AS (SELECT player, min(slot) AS first_slot FROM s WHERE NOT te GROUP BY 1)
SELECT CAST(slot AS INTEGER) AS slot, round_even(avg(CASE WHEN first_slot <= slot THEN 0 ELSE 1 END), 4) AS unseen_rate
FROM s LEFT JOIN f ON s.player = f.player WHERE te GROUP BY 1
UNION ALL SELECT 0, round_even(avg(CASE WHEN first_slot IS NULL THEN 1 ELSE 0 END), 4)
FROM s LEFT JOIN f ON s.player = f.player WHERE te""")
def drf3(t: Tables):
    m = t.matches.select("match_id", "season", "venue", "team1", "team2")
    rows = t.lineups.select("match_id", "side", F.posexplode("players").alias("slot", "player")).join(m, "match_id")
    team = F.when(F.col("side") == 1, F.col("team1")).otherwise(F.col("team2"))
    slots = rows.select((F.col("slot") + 1).alias("slot"), F.concat("side", "player", "venue", team).alias("player"),
                        (F.col("season") >= 2000).alias("is_test"))
    return E.unseen_players(slots, "is_test").filter(F.col("unseen_rate").isNotNull())


# --- statistics -------------------------------------------------------------

@query("sta1_correlations", cte("results") + """, d AS (
  SELECT CAST(CASE WHEN winner = team1 THEN 1 ELSE 0 END AS DOUBLE) AS y, runs_1, balls_1, wkts_1, pp_runs_2 FROM results),
l AS (SELECT 'runs_1' AS feature, CAST(runs_1 AS DOUBLE) AS x, y FROM d UNION ALL SELECT 'balls_1', balls_1, y FROM d
  UNION ALL SELECT 'wkts_1', wkts_1, y FROM d UNION ALL SELECT 'pp_runs_2', pp_runs_2, y FROM d),
r AS (SELECT feature, x, y,
  rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM l)
SELECT feature, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def sta1(t: Tables):
    df = t.results.withColumn("y", R.flag(F.col("winner") == F.col("team1")))
    return rounded(E.correlations(df, ["runs_1", "balls_1", "wkts_1", "pp_runs_2"], "y"), "pearson", "spearman")


@query("sta1_correlation_p_values")
def sta1b(t: Tables):
    df = t.results.withColumn("y", R.flag(F.col("winner") == F.col("team1")))
    c = E.with_p_values(E.correlations(df, ["runs_1", "balls_1", "wkts_1", "pp_runs_2"], "y"))
    return rounded(c, "pearson", "spearman", "pearson_p", "spearman_p").orderBy(F.abs("spearman").desc(), "feature")


_ANOVA = """, l AS (SELECT 'team1' AS feature, team1 AS g, winner AS y FROM matches WHERE winner IS NOT NULL
  UNION ALL SELECT 'venue', venue, winner FROM matches WHERE winner IS NOT NULL
  UNION ALL SELECT 'toss_winner', toss_winner, winner FROM matches WHERE winner IS NOT NULL),
c AS (SELECT feature, g, dense_rank() OVER (PARTITION BY feature, g ORDER BY y) - 1 AS k FROM l),
gs AS (SELECT feature, g, count(*) AS n, CAST(sum(k) AS BIGINT) AS s, CAST(sum(k * k) AS BIGINT) AS q FROM c GROUP BY 1, 2 HAVING count(DISTINCT k) >= 2),
t AS (SELECT feature, count(*) AS groups_used, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM gs GROUP BY 1)
SELECT feature, groups_used, n, round(((b - s * s / n) / (groups_used - 1)) / ((q - b) / (n - groups_used)), 5) AS f_stat FROM t"""


@query("sta2_anova", cte("matches") + _ANOVA)
def sta2(t: Tables):
    return rounded(E.anova(t.matches, ["team1", "venue", "toss_winner"], "winner"), "f_stat", digits=5)


@query("sta2_anova_p_values")
def sta2b(t: Tables):
    return rounded(E.with_f_p(E.anova(t.matches, ["team1", "venue", "toss_winner"], "winner")), "f_stat", "p_value")


@query("sta3_histogram", cte("innings") + """
SELECT CAST(CASE WHEN runs < 0 THEN 0 WHEN runs >= 300 THEN 13 ELSE floor(runs / 25.0) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM innings GROUP BY 1""")
def sta3(t: Tables):
    return E.histogram(t.innings, "runs", 0.0, 300.0, 12)


# --- scored fixtures --------------------------------------------------------

@query("sco2_binary_decision", cte("scored") + """
SELECT match_id, CASE WHEN p1 >= 0.5 THEN team1 ELSE team2 END AS predicted, round(greatest(p1, 1 - p1), 6) AS confidence FROM scored""")
def sco2(t: Tables):
    who, conf = SC.binary_decision(F.col("p1"), F.col("team1"), F.col("team2"))
    return t.scored.select("match_id", who.alias("predicted"), F.round(conf, 6).alias("confidence"))


@query("sco3_fixture_share", cte("matches") + """, p AS (SELECT match_id, (match_id * 13 % 50) / 100.0::DOUBLE AS a,
  CASE WHEN match_id % 6 = 0 THEN NULL ELSE (match_id * 7 % 50) / 100.0::DOUBLE END AS b FROM matches)
SELECT match_id, round(CASE WHEN b IS NULL OR a + b <= 0 THEN 0.5 ELSE a / (a + b) END, 6) AS team1_prob FROM p""")
def sco3(t: Tables):
    k = F.col("match_id")
    a, b = (k * 13 % 50) / 100.0, F.when(k % 6 != 0, (k * 7 % 50) / 100.0)
    probs = F.map_from_arrays(F.array("team1", "team2"), F.array(a, b))
    m = t.matches.filter(F.col("team1") != F.col("team2")).withColumn("probs", probs)
    share = SC.fixture_share(F.element_at("probs", F.col("team1")), F.element_at("probs", F.col("team2")))
    return m.select("match_id", F.round(share, 6).alias("team1_prob"))


@query("sco4_scenario_mean", cte("matches") + """, s AS (
  SELECT match_id, (match_id * 13 % 50 + CASE WHEN tw = team1 THEN 20 ELSE 0 END) / 100.0::DOUBLE AS p
  FROM (SELECT match_id, team1, team1 AS tw FROM matches UNION ALL SELECT match_id, team1, team2 FROM matches))
SELECT match_id, round(avg(p), 6) AS p1 FROM s GROUP BY 1""")
def sco4(t: Tables):
    both = SC.both_toss_outcomes(t.matches.select("match_id", "team1", "team2"))
    bonus = F.when(F.col("toss_winner") == F.col("team1"), 20).otherwise(0)
    scored = both.withColumn("p1", (F.col("match_id") * 13 % 50 + bonus) / 100.0)
    return rounded(SC.scenario_mean(scored, ["match_id"], "p1"), "p1")


@query("sco5_champion_challenger", cte("log") + """
SELECT match_id, predicted AS champion, actual, team1 AS challenger, CASE WHEN predicted = team1 THEN 1 ELSE 0 END AS agree,
  CASE WHEN predicted = actual THEN 1 ELSE 0 END AS champion_hit, CASE WHEN team1 = actual THEN 1 ELSE 0 END AS challenger_hit
FROM log WHERE actual IS NOT NULL""")
def sco5(t: Tables):
    log = t.log.filter(F.col("actual").isNotNull())
    return SC.champion_challenger(log.select("match_id", "predicted", "actual"),
                                  log.select("match_id", F.col("team1").alias("predicted")), "match_id")


@query("sco8_required_columns", cte("scored") + "SELECT match_id, p1 FROM scored")
def sco8(t: Tables):
    return R.require_columns(t.scored, ["match_id", "team1", "team2", "p1"]).select("match_id", "p1")
