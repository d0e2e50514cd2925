"""Encoding, training, selection and scoring over point-in-time features."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.functions import rules as R
from pitchline.operators import aggregates as A, encode as EN, joins as J, keyed, live as LV, models as M, priors, scoring as SC, splits as S
from pitchline.operators.facts import both_sides, team_long
from pitchline.operators.ordered import span_of, top_n
from pitchline.plans.join_queries import SIDE_MEANS_SQL, side_means
from pitchline.plans.prior_queries import VECTORS_SQL, rounded
from pitchline.plans.registry import ORACLES, query
from pitchline.plans.report_queries import multi_prob, _MP
from pitchline.plans.stream_queries import LIVE_SQL, finals
from pitchline.plans.views import Tables, cte
from pitchline.session import checkpoint_dir, durable
from pitchline.sources import tables as T

TEXT = ["venue", "toss_decision", "team1", "team2"]
NUMBER = ["team1_form", "team2_form", "venue_chase_winrate_prior", "h2h_team1_winrate_prior", "team1_venue_winrate", "team2_venue_winrate"]
FOLDS = 3
_frames: dict[tuple[str, str], object] = {}


def feature_frame(t: Tables):
    """Decided matches with priors, label, split flag and folds, stored once per session."""
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _frames:
        span, m = t.dates, t.matches
        f = (m.join(priors.team_form(m, span=span), "match_id").join(priors.venue_chase(m, span), "match_id")
             .join(priors.head_to_head(m, span), "match_id").join(priors.venue_team(m, span=span), "match_id"))
        f = f.filter(F.col("winner").isNotNull()).withColumn("label", R.won_by_side1(F.col("winner"), F.col("team1")).cast("double"))
        f = f.select("match_id", "match_date", "season", *TEXT, *NUMBER, "label").withColumns({
            "is_test": F.col("season") >= 2000, "weight": R.training_weight(F.col("season") + 23),
            "spread": (F.col("match_id") * 7919 % 10007) / 10007.0})
        _frames[key] = durable(S.stratified_folds(f, "label", "match_id", FOLDS))
    return _frames[key]


def splits(t: Tables):
    f = feature_frame(t)
    return f.filter(~F.col("is_test")), f.filter("is_test")


def stages():
    return EN.encoder_stages(TEXT, NUMBER, min_count=6)


def _report(t: Tables, **models):
    train, test = splits(t)
    whole = M.fitted(train, stages())
    fitted = {n: M.fit(train, whole, clf) for n, clf in models.items()}
    out = M.train_and_test_metrics(fitted, train, test)
    return rounded(out, *[c for c in out.columns if c != "model"])


# --- encoding ---------------------------------------------------------------

_TRAIN_TEST = """, tr AS (SELECT *, team1 || '/' || venue AS cell FROM matches WHERE season < 1996),
te AS (SELECT *, team1 || '/' || venue AS cell FROM matches WHERE season >= 1996),
k AS (SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY count(*) DESC, cell) AS rn, count(*) AS n FROM tr GROUP BY 1)
      WHERE n >= 10 AND rn <= 80)"""


def _cells(t: Tables):
    m = t.matches.select("match_id", "season", "team1", "venue", F.concat_ws("/", "team1", "venue").alias("cell"))
    return m.filter("season < 1996"), m.filter("season >= 1996")


@query("enc1_cardinality_reducer", cte("matches") + _TRAIN_TEST + """
SELECT match_id, CASE WHEN cell IN (SELECT cell FROM k) THEN cell ELSE 'OTHER_PLAYER' END AS cell FROM te""")
def enc1(t: Tables):
    train, test = _cells(t)
    model = EN.CardinalityReducer(inputCols=["cell"], minCount=10, maxValues=80).fit(train)
    return model.transform(test).select("match_id", "cell")


@query("enc2_most_frequent_fill", cte("matches") + """
SELECT match_id, coalesce(winner, (SELECT winner FROM matches WHERE season < 2000 AND winner IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1)) AS winner, venue FROM matches""")
def enc2(t: Tables):
    m = t.matches.select("match_id", "season", "winner", "venue")
    return EN.fill_most_frequent(m.filter("season < 2000"), m, ["winner", "venue"]).drop("season")


@query("enc3_median_fill_and_scale", cte("log") + """, x AS (SELECT match_id, year(match_date) AS y, CAST(first_score AS DOUBLE) AS v FROM log),
md AS (SELECT median(v) AS m FROM x WHERE y < 2000),
st AS (SELECT avg(coalesce(v, m)) AS a, stddev_pop(coalesce(v, m)) AS s FROM x, md WHERE y < 2000)
SELECT match_id, round((coalesce(v, m) - a) / s, 6) AS first_score FROM x, md, st""")
def enc3(t: Tables):
    x = t.log.select("match_id", F.year("match_date").alias("y"), "first_score")
    return rounded(EN.median_and_scale(x.filter("y < 2000"), x, ["first_score"]).drop("y"), "first_score")


@query("enc4_one_hot_unknown_ignored", cte("matches") + _TRAIN_TEST + """,
c AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS i FROM (SELECT DISTINCT cell FROM tr))
SELECT te.match_id, CAST(coalesce(c.i, -1) AS INTEGER) AS hot FROM te LEFT JOIN c ON te.match_id % 5 <> 0 AND te.cell = c.cell""")
def enc4(t: Tables):
    return _one_hot(t, EN.PLAN_VALUES)


@query("enc4_one_hot_by_dictionary", ORACLES["enc4_one_hot_unknown_ignored"])
def enc4b(t: Tables):
    """The same with the values in a table, as where there are too many for a plan."""
    return _one_hot(t, 0)


def _one_hot(t: Tables, plan_values: int):
    from pyspark.ml.feature import OneHotEncoder

    train, test = _cells(t)
    pipe = Pipeline(stages=[EN.ValueIndexer(inputCols=["cell"], outputCols=["i"], planValues=plan_values)]).fit(train)
    asked = pipe.transform(test.withColumn("cell", F.when(F.col("match_id") % 5 == 0, "guest").otherwise(F.col("cell"))))
    known = pipe.transform(train)
    hot = OneHotEncoder(inputCol="i", outputCol="o", handleInvalid="keep").fit(known.select(F.col("i").cast("double").alias("i")))
    return EN.one_hot_index(hot, hot.transform(asked.withColumn("i", F.col("i").cast("double"))), "o", "hot").select("match_id", F.coalesce("hot", F.lit(-1)).alias("hot"))


@query("enc5_infrequent_bucket", cte("matches") + _TRAIN_TEST + """, f AS (SELECT cell FROM tr GROUP BY 1 HAVING count(*) >= 10), b AS (
  SELECT match_id, CASE WHEN cell IN (SELECT cell FROM f) THEN cell ELSE 'OTHER_PLAYER' END AS v FROM te)
SELECT v, count(*) AS n FROM b GROUP BY 1""")
def enc5(t: Tables):
    train, test = _cells(t)
    model = Pipeline(stages=EN.encoder_stages(["cell"], [], min_count=10)[:2]).fit(train)
    return model.transform(test).groupBy(F.col("cell").alias("v")).agg(F.count("*").alias("n"))


@query("enc5_infrequent_by_dictionary", ORACLES["enc5_infrequent_bucket"])
def enc5b(t: Tables):
    train, test = _cells(t)
    model = EN.CardinalityReducer(inputCols=["cell"], minCount=10, maxValues=0, planValues=0).fit(train)
    return model.transform(test).groupBy(F.col("cell").alias("v")).agg(F.count("*").alias("n"))


@query("enc6_label_codes", cte("matches") + """, c AS (
  SELECT winner, row_number() OVER (ORDER BY winner) - 1 AS code FROM (SELECT DISTINCT winner FROM matches WHERE season < 2000 AND winner IS NOT NULL))
SELECT m.match_id, m.winner, CAST(c.code AS INTEGER) AS code FROM matches m JOIN c ON m.winner = c.winner WHERE m.season >= 2000""")
def enc6(t: Tables):
    m = t.matches.select("match_id", "season", "winner")
    codes = EN.label_codes(m.filter("season < 2000"), "winner")
    return m.filter("season >= 2000").join(codes, "winner").select("match_id", "winner", "code")


@query("enc7_assembled_features")
def enc7(t: Tables):
    train, test = splits(t)
    text, number = EN.column_roles(train, ["match_id", "season", "label", "weight", "spread", "fold"])
    model = Pipeline(stages=EN.encoder_stages(text, number, min_count=6)).fit(train)
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return model.transform(test).select("match_id", F.size(v).alias("width"), F.round(F.aggregate(
        v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("enc8_season_weights", cte("matches") + """
SELECT match_id, CAST(CASE WHEN season + 23 <= 2021 THEN 0.6 WHEN season + 23 = 2022 THEN 1.25 WHEN season + 23 = 2023 THEN 1.55
  WHEN season + 23 = 2024 THEN 1.9 ELSE 1.0 END AS DOUBLE) AS weight FROM matches""")
def enc8(t: Tables):
    return t.matches.select("match_id", R.training_weight(F.col("season") + 23).alias("weight"))


@query("enc9_class_weights", cte("matches") + """, c AS (SELECT winner, count(*) AS n FROM matches WHERE winner IS NOT NULL GROUP BY 1)
SELECT m.match_id, m.winner, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 6)::DOUBLE AS class_weight
FROM matches m JOIN c ON m.winner = c.winner""")
def enc9(t: Tables):
    m = t.matches.filter(F.col("winner").isNotNull()).select("match_id", "winner")
    return rounded(m.join(EN.class_weights(m, "winner"), "winner"), "class_weight").select("match_id", "winner", "class_weight")


# --- training ---------------------------------------------------------------

@query("mod1_logistic_regression")
def mod1(t: Tables):
    return _report(t, l2=M.learner("logistic", weightCol="weight"), elastic=M.learner("logistic", elasticNetParam=0.5, regParam=0.02))


@query("mod2_random_forest")
def mod2(t: Tables):
    return _report(t, forest=M.learner("forest"))


@query("mod3_boosted_trees")
def mod3(t: Tables):
    return _report(t, boosted=M.learner("boosted"), boosted_ovr=M.learner("boosted_ovr"))


@query("mod4_extra_trees")
def mod4(t: Tables):
    return _report(t, extra=M.learner("extra_trees"))


@query("mod5_stacking")
def mod5(t: Tables):
    train, test = splits(t)
    bases = {"forest": M.learner("forest", numTrees=10), "logistic": M.learner("logistic")}
    model = M.stack(train, stages(), bases, FOLDS, NUMBER)
    out = M.metrics(M.score(model, test).withColumn("model", F.lit("stacked")), ["model"])
    return rounded(out, "accuracy", "f1", "log_loss")


@query("mod6_seed_average")
def mod6(t: Tables):
    train, test = splits(t)
    return rounded(M.seed_average(train, test, stages(), "forest", [1, 2, 3], numTrees=5), "p1")


def _searched(t: Tables, found):
    return t.spark.createDataFrame([(i + 1, str(sorted(c.items())), float(s)) for i, (c, s) in enumerate(found)],
                                   "place int, params string, cv_score double")


@query("mod7_random_search")
def mod7(t: Tables):
    train, _ = splits(t)
    cands = M.draw_candidates({"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}, 4)
    return _searched(t, M.search(M.encoded_folds(train, stages(), FOLDS), "logistic", cands))


@query("mod8_successive_halving")
def mod8(t: Tables):
    train, _ = splits(t)
    cands = M.draw_candidates({"regParam": (0.0001, 0.5)}, 4)
    trace = M.halving(train, stages(), "logistic", cands, FOLDS, "spread")
    return t.spark.createDataFrame([(share, str(sorted(c.items())), float(s)) for share, c, s in trace],
                                   "share double, params string, cv_score double")


@query("mod8_halving_rungs", cte("matches") + """, tr AS (SELECT match_id * 7919 % 10007 / 10007.0::DOUBLE AS spread FROM matches WHERE winner IS NOT NULL AND season < 2000)
SELECT share, candidates, (SELECT count(*) FROM tr WHERE spread < share) AS n_rows
FROM (VALUES (0.25::DOUBLE, 4::BIGINT), (0.5, 2), (1.0, 1)) v(share, candidates)""")
def mod8b(t: Tables):
    """The rungs of a search: share of the rows, candidates that met it, rows they learnt from and were judged on."""
    train, _ = splits(t)
    cands = M.draw_candidates({"regParam": (0.0001, 0.5)}, 4)
    trace = M.halving(train, stages(), "logistic", cands, FOLDS, "spread")
    rungs = t.spark.createDataFrame([(share, i) for i, (share, _, _) in enumerate(trace)], "share double, i int")
    rungs = rungs.groupBy("share").agg(F.count("*").alias("candidates"))
    cuts = F.array(*[F.lit(float(s)) for s in sorted({share for share, _, _ in trace})])
    seen = train.select(F.explode(F.filter(cuts, lambda c: F.col("spread") < c)).alias("share")).groupBy("share").agg(F.count("*").alias("n_rows"))
    return rungs.join(seen, "share").select("share", "candidates", "n_rows")


@query("mod9_two_stage_search")
def mod9(t: Tables):
    train, _ = splits(t)
    spaces = {"logistic": {"regParam": [0.001, 0.01, 0.1]}, "forest": {"maxDepth": [3, 4], "numTrees": [5, 10]},
              "boosted": {"maxIter": [3, 5]}}
    found = M.two_stage(train, stages(), spaces, FOLDS, quick=1, full=2)
    return t.spark.createDataFrame([(n, str(sorted(c.items())), float(s)) for n, c, s in found],
                                   "model string, params string, cv_score double")


@query("mod10_winner_selection")
def mod10(t: Tables):
    train, test = splits(t)
    whole = M.fitted(train, stages())
    fitted = {n: M.fit(train, whole, clf) for n, clf in (("l2", M.learner("logistic")), ("forest", M.learner("forest")))}
    return M.choose(_rounded_all(M.train_and_test_metrics(fitted, train, test)), "generalization", max_gap=0.2)


def _rounded_all(df):
    return rounded(df, *[c for c in df.columns if c != "model"])


@query("mod11_out_of_fold")
def mod11(t: Tables):
    return rounded(M.out_of_fold(feature_frame(t), stages(), M.learner("logistic"), FOLDS), "p1")


@query("mod12_refit_on_all")
def mod12(t: Tables):
    f = feature_frame(t)
    recent = f.filter("season >= 1998")
    return rounded(M.score(M.fit(recent, stages(), M.learner("logistic")), recent), "p1")


@query("mod13_uniform_trials")
def mod13(t: Tables):
    train, _ = splits(t)
    cands = M.draw_candidates({"regParam": (0.0001, 0.3), "elasticNetParam": (0.0, 1.0)}, 4, seed=11)
    return _searched(t, M.search(M.encoded_folds(train, stages(), FOLDS), "logistic", cands, metric="accuracy"))


@query("srt5_feature_importance")
def srt5(t: Tables):
    train, _ = splits(t)
    return rounded(M.importances(M.fit(train, stages(), M.learner("forest")), train, 20), "importance")


@query("snk4_model_bundle")
def snk4(t: Tables):
    train, test = splits(t)
    path = f"{checkpoint_dir(t.spark)}/bundle-{uuid.uuid4().hex}"
    T.save_model(M.fit(train, stages(), M.learner("logistic")), {"features": ",".join(TEXT + NUMBER), "target": "label"}, path, t.spark)
    model, meta = T.load_model(path, t.spark)
    return rounded(M.score(model, test).withColumn("target", F.lit(meta["target"])), "p1")


# --- training where the solution is known in closed form ---------------------
# On one category, an unpenalised or unbagged model predicts what a grouped mean predicts.

_MEAN = "avg(CASE WHEN winner = team1 THEN 1 ELSE 0 END)"


def _decided(t: Tables):
    label = R.won_by_side1(F.col("winner"), F.col("team1")).cast("double").alias("label")
    return t.matches.filter(F.col("winner").isNotNull()).select("match_id", "season", "venue", label)


def _venue_only():
    return EN.encoder_stages(["venue"], [])


def _tree(kind: str, seed: int = 42):
    return M.learner(kind, seed, numTrees=1, maxDepth=6, featureSubsetStrategy="all", **({"bootstrap": False} if kind == "forest" else {}))


def _by_venue(scored, *keys: str):
    return scored.groupBy("venue", *keys).agg(F.round(F.avg("p1"), 4).alias("p1"))


def _score(f, clf):
    return M.score(M.fit(f, _venue_only(), clf), f, ("match_id", "venue"))


def _parity(t: Tables):
    """Two groups on different sides of one half: a classification tree merges leaves that predict the same class."""
    k = F.col("match_id")
    return _decided(t).withColumns({"venue": F.when(k % 2 == 0, "even").otherwise("odd"),
                                    "label": (k * 37 % 101 < 30 + 40 * (k % 2)).cast("double")})


_PARITY = cte("matches") + """, d AS (SELECT match_id, CASE WHEN match_id % 2 = 0 THEN 'even' ELSE 'odd' END AS venue,
  CASE WHEN match_id * 37 % 101 < 30 + 40 * (match_id % 2) THEN 1 ELSE 0 END AS label FROM matches WHERE winner IS NOT NULL)"""
_PARITY_MEANS = _PARITY + " SELECT venue, round(avg(label), 4) AS p1 FROM d GROUP BY 1"
_VENUE_MEANS = cte("matches") + f"SELECT venue, round({_MEAN}, 4) AS p1 FROM matches WHERE winner IS NOT NULL GROUP BY 1"


@query("mod1_group_means", _VENUE_MEANS)
def mod1_means(t: Tables):
    return _by_venue(_score(_decided(t), M.learner("logistic", regParam=0.0, tol=1e-9, maxIter=200)))


@query("mod2_leaf_means", _PARITY_MEANS)
def mod2_means(t: Tables):
    return _by_venue(_score(_parity(t), _tree("forest")))


@query("mod3_first_step", cte("matches") + f"""
SELECT venue, round(1 / (1 + exp(-2 * (2 * {_MEAN} - 1))), 4) AS p1 FROM matches WHERE winner IS NOT NULL GROUP BY 1""")
def mod3_step(t: Tables):
    return _by_venue(_score(_decided(t), M.learner("boosted", maxIter=1, maxDepth=6)))


@query("mod4_leaf_means", _PARITY_MEANS)
def mod4_means(t: Tables):
    return _by_venue(_score(_parity(t), _tree("extra_trees")))


@query("mod6_equal_trees", _PARITY_MEANS)
def mod6_means(t: Tables):
    f = _parity(t)
    p = M.seed_average(f, f, _venue_only(), "extra_trees", [1, 2], numTrees=1, maxDepth=6, featureSubsetStrategy="all")
    return _by_venue(p.join(f.select("match_id", "venue"), "match_id"))


@query("mod11_out_of_fold_means", _PARITY + """,
f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY match_id * 31 % 1009, match_id) - 1) % 3 AS fold FROM d)
SELECT a.venue, CAST(a.fold AS INTEGER) AS fold, round(avg(b.label), 4) AS p1
FROM (SELECT DISTINCT venue, fold FROM f) a JOIN f b ON a.venue = b.venue AND a.fold <> b.fold GROUP BY 1, 2""")
def mod11_means(t: Tables):
    f = durable(S.stratified_folds(_parity(t), "label", "match_id", 3))
    p = M.out_of_fold(f, _venue_only(), _tree("extra_trees"), 3)
    return _by_venue(p.select("match_id", "p1").join(f.select("match_id", "venue", "fold"), "match_id"), "fold")


@query("mod12_refit_means", cte("matches") + f"""
SELECT venue, round({_MEAN}, 4) AS p1 FROM matches WHERE winner IS NOT NULL AND season >= 1998 GROUP BY 1""")
def mod12_means(t: Tables):
    recent = _decided(t).filter("season >= 1998")
    return _by_venue(_score(recent, M.learner("logistic", regParam=0.0, tol=1e-9, maxIter=200)))


@query("snk4_bundle_round_trip", cte("matches") + """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM matches WHERE winner IS NOT NULL""")
def snk4_same(t: Tables):
    f, path = _decided(t), f"{checkpoint_dir(t.spark)}/bundle-{uuid.uuid4().hex}"
    fitted = M.fit(f, _venue_only(), M.learner("logistic"))
    T.save_model(fitted, {"target": "label"}, path, t.spark)
    loaded, _ = T.load_model(path, t.spark)
    both = M.score(fitted, f).join(M.score(loaded, f).select("match_id", F.col("p1").alias("again")), "match_id")
    return both.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("p1") != F.col("again"), 1)).alias("n_different"))


# --- scoring ----------------------------------------------------------------

@query("sco1_batch_score", cte("multi") + _MP + """
SELECT event_id, ['click', 'error', 'purchase', 'signup', 'view'][list_position(prob, list_max(prob))] AS predicted,
  round(list_max(prob), 6) AS confidence, round(prob[5], 6) AS p_view FROM mp""")
def sco1(t: Tables):
    names = F.array(*[F.lit(c) for c in ("click", "error", "purchase", "signup", "view")])
    s = SC.with_decision(multi_prob(t), "prob", names)
    return s.select("event_id", "predicted", F.round("confidence", 6).alias("confidence"),
                    F.round(F.element_at("probabilities", "view"), 6).alias("p_view"))


_LIVE = """,
l AS (SELECT match_id, match_date, 1 AS side, team1 AS team, actual FROM log UNION ALL SELECT match_id, match_date, 2, team2, actual FROM log),
o AS (SELECT *, CASE WHEN actual = team THEN 1 WHEN actual IS NOT NULL THEN 0 END AS win, 1 + count(actual) OVER (PARTITION BY team
  ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ord FROM l),
f AS (SELECT match_id, side, team, actual, coalesce(avg(win) OVER (PARTITION BY team ORDER BY ord RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) AS form FROM o),
r AS (SELECT team, avg(win) AS rf FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM o WHERE actual IS NOT NULL) WHERE rn <= 5 GROUP BY 1),
b AS (SELECT f.match_id, f.side, CASE WHEN rf IS NULL THEN form ELSE 0.7::DOUBLE * form + 0.3::DOUBLE * rf END AS form FROM f LEFT JOIN r ON f.team = r.team WHERE f.actual IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY match_date DESC, match_id DESC) AS rn FROM log WHERE actual IS NOT NULL),
p AS (SELECT venue, avg(first_score) AS s, avg(CASE WHEN toss_winner = actual THEN 1 ELSE 0 END) AS tw,
  avg(CASE WHEN actual = CASE WHEN toss_decision = 'field' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END THEN 1 ELSE 0 END) AS ch,
  coalesce(avg(first_score) FILTER (rn <= 20), 170.0) AS rs, avg(CASE WHEN toss_winner = actual THEN 1 ELSE 0 END) FILTER (rn <= 20) AS rt FROM k GROUP BY 1)
SELECT g.match_id, g.team1, g.team2, g.venue, g.toss_winner, g.toss_decision, round(b1.form, 6) AS team1_form, round(b2.form, 6) AS team2_form,
  round(0.8::DOUBLE * s + 0.2::DOUBLE * rs, 5) AS venue_score_prior, round(0.8::DOUBLE * tw + 0.2::DOUBLE * rt, 6) AS toss_advantage,
  round(ch, 6) AS venue_chase_winrate_prior, CASE WHEN g.toss_decision = 'field' AND ch >= 0.52 THEN 1 ELSE 0 END AS is_high_dew
FROM log g JOIN b b1 ON b1.match_id = g.match_id AND b1.side = 1 JOIN b b2 ON b2.match_id = g.match_id AND b2.side = 2
  JOIN p ON p.venue = g.venue WHERE g.actual IS NULL"""


@query("sco6_live_feature_rows", cte("log") + _LIVE)
def sco6(t: Tables):
    """Open fixtures: as-of form blended with the log, venue profile blended with its last 20 rows."""
    log = durable(t.log)
    long = team_long(log.select("match_id", "match_date", "team1", "team2", "actual"))
    state = priors.completed_state(
        long, ["team"], F.col("actual").isNotNull(),
        [priors.Recent("form", R.flag(F.col("actual") == F.col("team")), 5)], t.dates)
    recent = A.recent_team_form(long)
    form = state.filter(F.col("actual").isNull()).join(recent, "team", "left").withColumn(
        "form", R.blend(F.coalesce("before.form", F.lit(0.5)), F.col("recent_form"), 0.7))
    sides = both_sides(form, ["match_id"], ["form"])
    profile = log.filter(F.col("actual").isNotNull()).groupBy("venue").agg(
        F.avg("first_score").alias("_score"), F.avg(R.flag(F.col("toss_winner") == F.col("actual"))).alias("_toss"),
        F.avg(R.flag(R.chasing_side(F.col("toss_winner"), F.col("toss_decision"), F.col("team1"), F.col("team2")) == F.col("actual"))).alias("_chase"))
    venue = profile.join(A.recent_venue_stats(log), "venue", "left").select(
        "venue", R.blend(F.col("_score"), F.col("avg_score"), 0.8).alias("venue_score_prior"),
        R.blend(F.col("_toss"), F.col("toss_share"), 0.8).alias("toss_advantage"), F.col("_chase").alias("venue_chase_winrate_prior"))
    open_ = log.filter(F.col("actual").isNull()).select("match_id", "team1", "team2", "venue", "toss_winner", "toss_decision")
    rows = open_.join(sides, "match_id").join(venue, "venue", "left")
    rows = rows.withColumn("is_high_dew", R.live_dew_flag(F.col("toss_decision"), F.col("venue_chase_winrate_prior")))
    return rounded(rounded(rows, "team1_form", "team2_form", "toss_advantage", "venue_chase_winrate_prior"), "venue_score_prior", digits=5)


# The feed's spelling of a name, and one that nobody knows.
_RAW_TEAM = "CASE WHEN match_id % 13 = 0 THEN 'Touring side' WHEN match_id % 3 = 0 THEN replace({c}, 'NATION', 'NATON') ELSE {c} END"
_RAW_VENUE = "CASE WHEN match_id % 17 = 0 THEN 'Moon' ELSE replace(venue, '-', ' ') END"
_ROLE = "CASE CAST(substr(player, 8) AS INT) % 3 WHEN 0 THEN 'Batting Allrounder' WHEN 1 THEN 'Bowler' ELSE 'Batsman' END"
_NEAR = "(SELECT arg_max(name, score) FROM (SELECT {n} AS name, 1 - levenshtein({c}, {n}) / greatest(length({c}), length({n}))::DOUBLE AS score FROM {t}) WHERE score >= {cut})"
_SCO6 = cte("matches", "batting", "bowling", "lineups", "log") + SIDE_MEANS_SQL[len(cte("matches", "batting", "bowling", "lineups")):] + """,
tp AS (SELECT team, avg(bat_avg) AS bat_avg, avg(bat_sr) AS bat_sr, avg(bowl_eco) AS bowl_eco, avg(bowl_sr) AS bowl_sr FROM (
  SELECT CASE WHEN sm.side = 1 THEN team1 ELSE team2 END AS team, sm.* FROM sm JOIN matches m ON m.match_id = sm.match_id) GROUP BY 1),
cl AS (SELECT *, CASE WHEN first_score >= 60 THEN 'Batting' ELSE 'Bowling' END AS pitch, CASE WHEN first_score % 2 = 0 THEN 'High' ELSE 'Low' END AS bounce,
  CASE WHEN actual = CASE WHEN toss_decision = 'field' THEN toss_winner WHEN toss_winner = team1 THEN team2 ELSE team1 END THEN 1 ELSE 0 END AS ch,
  row_number() OVER (PARTITION BY venue ORDER BY match_date DESC, match_id DESC) AS rn FROM log WHERE actual IS NOT NULL),
vp AS (SELECT venue, avg(first_score) AS s, avg(ch) AS c, avg(CASE WHEN toss_winner = actual THEN 1 ELSE 0 END) AS tw,
  (SELECT pitch FROM cl x WHERE x.venue = cl.venue GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS pitch,
  (SELECT bounce FROM cl x WHERE x.venue = cl.venue GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS bounce,
  coalesce(avg(first_score) FILTER (rn <= 20), 170.0) AS rs, avg(CASE WHEN toss_winner = actual THEN 1 ELSE 0 END) FILTER (rn <= 20) AS rt FROM cl GROUP BY 1),
raw AS (SELECT match_id, match_date, """ + ", ".join(f"{_RAW_TEAM.format(c=c)} AS {c}" for c in ("team1", "team2", "toss_winner")) + f""",
  {_RAW_VENUE} AS venue, toss_decision FROM log WHERE actual IS NULL),
tn AS (SELECT r.n, coalesce({_NEAR.format(n="tp.team", c="r.n", t="tp", cut=0.6)}, r.n) AS name FROM (
  SELECT team1 AS n FROM raw UNION SELECT team2 FROM raw UNION SELECT toss_winner FROM raw) r),
vn AS (SELECT r.n, coalesce({_NEAR.format(n="vp.venue", c="r.n", t="vp", cut=0.45)}, r.n) AS name FROM (SELECT DISTINCT venue AS n FROM raw) r),""" + """
fx AS (SELECT match_id, match_date, a.name AS team1, b.name AS team2, c.name AS toss_winner, v.name AS venue, toss_decision FROM raw
  JOIN tn a ON a.n = raw.team1 JOIN tn b ON b.n = raw.team2 JOIN tn c ON c.n = raw.toss_winner JOIN vn v ON v.n = raw.venue),
sd AS (SELECT match_id, match_date, 1 AS side, team1 AS team FROM fx UNION ALL SELECT match_id, match_date, 2, team2 FROM fx),
pl AS (SELECT team1 AS team, match_date, match_id, CASE WHEN winner = team1 THEN 1 ELSE 0 END AS win FROM matches WHERE winner IS NOT NULL
  UNION ALL SELECT team2, match_date, match_id, CASE WHEN winner = team2 THEN 1 ELSE 0 END FROM matches WHERE winner IS NOT NULL),
pn AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS n FROM pl),
upto AS (SELECT sd.match_id, sd.side, sd.team, max(n) AS n FROM sd LEFT JOIN pn ON pn.team = sd.team AND pn.match_date < sd.match_date GROUP BY 1, 2, 3),
fm AS (SELECT u.match_id, u.side, u.team, coalesce(avg(win), 0.5) AS form FROM upto u LEFT JOIN pn ON pn.team = u.team AND pn.n BETWEEN u.n - 4 AND u.n GROUP BY 1, 2, 3),
rf AS (SELECT team, avg(win) AS rf FROM (SELECT *, max(n) OVER (PARTITION BY team) AS last FROM pn) WHERE n > last - 5 GROUP BY 1),
sqd AS (SELECT sd.match_id, sd.side, sd.team, l.player, row_number() OVER (PARTITION BY sd.match_id, sd.side ORDER BY player) AS rn
  FROM sd JOIN lineups l ON l.match_id = sd.match_id AND l.side = sd.side WHERE sd.match_id % 4 <> 0),
ros AS (SELECT 'NATION_' || ((s_nationkey + d) % 25) AS team, 'Player ' || s_suppkey AS player FROM supplier, (SELECT unnest(range(12)) AS d)),
mu AS (SELECT q.match_id, q.side, least(greatest(avg(CASE CAST(substr(q.player, 8) AS INT) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.35 ELSE 1.0 END::DOUBLE
    + CASE WHEN ros.team IS NOT NULL THEN 0.03 ELSE 0 END) / 0.8, 0.88), 1.12) AS bm,
  least(greatest(avg(CASE CAST(substr(q.player, 8) AS INT) % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 1.05 ELSE 0.25 END::DOUBLE
    + CASE WHEN ros.team IS NOT NULL THEN 0.03 ELSE 0 END) / 0.8, 0.88), 1.12) AS wm, count(*) AS used
  FROM sqd q LEFT JOIN ros ON ros.team = q.team AND ros.player = q.player WHERE q.rn <= 11 GROUP BY 1, 2),
sr AS (SELECT fm.match_id, fm.side, CASE WHEN rf IS NULL THEN form ELSE 0.7::DOUBLE * form + 0.3::DOUBLE * rf END AS form,
  coalesce(bat_avg, 30) * coalesce(bm, 1) AS bat_avg, coalesce(bat_sr, 140) * coalesce(bm, 1) AS bat_sr, coalesce(bowl_eco, 8.5) / coalesce(wm, 1) AS bowl_eco,
  coalesce(bowl_sr, 20) / coalesce(wm, 1) AS bowl_sr, coalesce(bm, 1) AS bm, coalesce(wm, 1) AS wm, coalesce(used, 0) AS used
  FROM fm LEFT JOIN rf ON rf.team = fm.team LEFT JOIN mu ON mu.match_id = fm.match_id AND mu.side = fm.side LEFT JOIN tp ON tp.team = fm.team)
SELECT fx.match_id, match_date, team1, team2, fx.venue, toss_winner, toss_decision, """ + ", ".join(
    f"round(a{s}.form + 1e-9, 5) AS team{s}_form_winrate_5, " + ", ".join(f"round(a{s}.{c} + 1e-9, 5) AS team{s}_{c}" for c in LV.SKILLS)
    + f", round(a{s}.bm + 1e-9, 5) AS team{s}_bat_multiplier, round(a{s}.wm + 1e-9, 5) AS team{s}_bowl_multiplier, a{s}.used AS team{s}_players_used"
    for s in (1, 2)) + """,
  round(CASE WHEN s IS NULL THEN 170 ELSE 0.8::DOUBLE * s + 0.2::DOUBLE * rs END + 1e-9, 5) AS venue_score_prior, round(coalesce(c, 0.52) + 1e-9, 5) AS venue_chase_winrate_prior,
  round(CASE WHEN s IS NULL THEN 0.5 ELSE 0.8::DOUBLE * tw + 0.2::DOUBLE * rt END + 1e-9, 5) AS toss_advantage, coalesce(pitch, 'Batting') AS pitch_type,
  coalesce(bounce, 'Medium') AS bounce_and_carry, CASE WHEN toss_decision = 'field' AND coalesce(c, 0.52) >= 0.52 THEN 1 ELSE 0 END AS is_high_dew
FROM fx JOIN sr a1 ON a1.match_id = fx.match_id AND a1.side = 1 JOIN sr a2 ON a2.match_id = fx.match_id AND a2.side = 2 LEFT JOIN vp ON vp.venue = fx.venue"""


@query("sco6_live_rows_all_features", _SCO6)
def sco6_full(t: Tables):
    """Announced fixtures in the feed's spelling: names, form, profiles, squads, venue and toss in one row each."""
    log = durable(t.log)
    role = F.expr(_ROLE)
    squads = t.lineup_slots.withColumn("_role", role).groupBy("match_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("player").alias("name"), F.col("_role").alias("role"))))).alias(f"_squad{s}")
        for s in (1, 2)])
    fixtures = log.filter("actual IS NULL").select(
        "match_id", "match_date", *[F.expr(_RAW_TEAM.format(c=c)).alias(c) for c in ("team1", "team2", "toss_winner")],
        F.expr(_RAW_VENUE).alias("venue"), F.initcap("toss_decision").alias("toss_decision")).join(squads, "match_id", "left")
    fixtures = fixtures.withColumns({f"team{s}_squad": F.when(F.col("match_id") % 4 != 0, F.col(f"_squad{s}")) for s in (1, 2)}).drop("_squad1", "_squad2")
    means = rounded(side_means(t), *P.VECTOR_DEFAULTS, digits=5).join(t.matches.select("match_id", "team1", "team2"), "match_id")
    teams = A.team_profiles(means.withColumn("team", F.when(F.col("side") == 1, F.col("team1")).otherwise(F.col("team2"))), LV.SKILLS)
    closed = log.filter("actual IS NOT NULL").withColumns({
        "winner": F.col("actual"), "venue_score_prior": F.col("first_score"),
        "venue_chase_winrate_prior": R.flag(R.chasing_side(F.col("toss_winner"), F.col("toss_decision"), F.col("team1"), F.col("team2")) == F.col("actual")),
        "pitch_type": F.when(F.col("first_score") >= 60, "Batting").otherwise("Bowling"),
        "bounce_and_carry": F.when(F.col("first_score") % 2 == 0, "High").otherwise("Low")})
    venues = A.venue_profiles(closed, "venue", ["venue_score_prior", "venue_chase_winrate_prior"], ["pitch_type", "bounce_and_carry"])
    roster = t.read("supplier").select(F.concat(F.lit("PLAYER-"), "s_suppkey").alias("player"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("d"))
    roster = roster.select(F.concat(F.lit("NATION_"), (F.col("s_nationkey") + F.col("d")) % 25).alias("team"), "player")
    days = span_of(t.read("orders").select(F.col("o_orderdate").cast("date").alias("match_date")), ["match_date"])
    out = LV.live_rows(fixtures, t.matches.filter("winner IS NOT NULL"), log, durable(teams), durable(venues), roster, days)
    return out.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query("sco7_serving_rows", cte("log") + """,
ts AS (SELECT team, count(*) AS games, CAST(sum(CASE WHEN actual = team THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM (
  SELECT team1 AS team, actual FROM log WHERE actual IS NOT NULL UNION ALL SELECT team2, actual FROM log WHERE actual IS NOT NULL) GROUP BY 1),
vs AS (SELECT venue, count(*) AS games, CAST(sum(CASE WHEN toss_decision = 'bat' THEN 1 ELSE 0 END) AS BIGINT) AS bats FROM log WHERE actual IS NOT NULL GROUP BY 1)
SELECT CAST(l.match_id AS DOUBLE) AS match_id, round((coalesce(a.wins, 0) + 1) / (coalesce(a.games, 0) + 2), 6) AS team1_rate,
  round((coalesce(b.wins, 0) + 1) / (coalesce(b.games, 0) + 2), 6) AS team2_rate,
  round(coalesce(v.bats / v.games, 0.5), 6) AS venue_toss_bat_rate, 0.0::DOUBLE AS not_seen
FROM log l LEFT JOIN ts a ON l.team1 = a.team LEFT JOIN ts b ON l.team2 = b.team LEFT JOIN vs v ON l.venue = v.venue WHERE l.actual IS NULL""")
def sco7(t: Tables):
    """Fixtures joined to the state tables, completed to the model's column list."""
    closed = t.log.filter(F.col("actual").isNotNull())
    teams = team_long(closed.select("match_id", "team1", "team2", "actual")).groupBy("team").agg(
        F.count("*").alias("games"), F.sum(R.flag(F.col("actual") == F.col("team"))).alias("wins"))
    venues = closed.groupBy("venue").agg(F.avg(R.flag(F.col("toss_decision") == "bat")).alias("venue_toss_bat_rate"))
    rate = teams.select("team", R.smoothed_rate(F.col("wins"), F.col("games")).alias("rate"))
    f = t.log.filter(F.col("actual").isNull()).select("match_id", "team1", "team2", "venue")
    for s in (1, 2):
        side = rate.select(F.col("team").alias(f"team{s}"), F.col("rate").alias(f"team{s}_rate"))
        f = f.join(side, f"team{s}", "left").fillna(0.5, [f"team{s}_rate"])
    f = f.join(venues, "venue", "left").fillna(0.5, ["venue_toss_bat_rate"]).withColumn("match_id", F.col("match_id").cast("double"))
    return rounded(R.complete_columns(f, ["match_id", "team1_rate", "team2_rate", "venue_toss_bat_rate", "not_seen"]),
                   "team1_rate", "team2_rate", "venue_toss_bat_rate")


_RECENT_NAMES = ["form_winrate", "recent_runs_for", "recent_runs_against", "recent_wkts_taken", "recent_powerplay_rr", "recent_death_rr"]
_VENUE_NAMES = {2: ("venue_avg_first_innings_runs_prior", 165), 3: ("venue_pp_rr_first_innings_prior", 7.5), 4: ("venue_death_rr_first_innings_prior", 9.5),
                5: ("venue_pp_rr_second_innings_prior", 7.3), 6: ("venue_death_rr_second_innings_prior", 9.2)}
_CLOSED = ", closed AS (SELECT e.* FROM ent e JOIN matches m ON m.match_id = e.match_id WHERE m.winner IS NOT NULL)"
_LAST_STATE = """, num AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY match_date DESC, match_id DESC, side DESC) AS rn FROM closed),
st AS (SELECT kind, key, count(*) AS games, """ + ", ".join(f"avg(v{i}) AS a{i}" for i in range(7)) + ", sum(v0) AS s0, " + ", ".join(
    f"avg(v{i}) FILTER (rn <= 5) AS m{i}" for i in range(6)) + """, first(players ORDER BY rn) FILTER (len(players) > 0) AS lineup FROM num GROUP BY 1, 2)"""
_STATE_BEFORE = """, st AS (SELECT match_id, side, kind, key, count(*) OVER w AS games, """ + ", ".join(f"avg(v{i}) OVER w AS a{i}" for i in range(7)) + (
    ", sum(v0) OVER w AS s0, ") + ", ".join(
    f"avg(v{i}) OVER (PARTITION BY kind, key ORDER BY match_date, match_id, side ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m{i}" for i in range(6)) + """,
  last_value(CASE WHEN len(players) > 0 THEN players END IGNORE NULLS) OVER w AS lineup
  FROM closed WINDOW w AS (PARTITION BY kind, key ORDER BY match_date, match_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _features_sql(state: str, which: str, own: str = "", extra: str = "", availability: str = "") -> str:
    """All live features: ``own`` ties a state row to its match and side, where the state differs by match."""
    at = lambda alias, side: own.format(a=alias, side=side)
    return LIVE_SQL + _CLOSED + state + f""",
fx AS (SELECT f.match_id, f.team1, f.team2, f.venue, coalesce(CASE WHEN f.match_id % 11 <> 0 OR f.winner IS NOT NULL THEN f.toss_winner END, f.team1) AS toss_winner,
  f.toss_decision, f.match_date, coalesce(p1, []) AS p1, coalesce(p2, []) AS p2, f.winner FROM fin f WHERE f.winner IS {which}),
seat AS (SELECT match_id, side, unnest(xi) AS player FROM (SELECT match_id, 1 AS side, p1[1:11] AS xi FROM fx UNION ALL SELECT match_id, 2, p2[1:11] FROM fx)),
rate AS (SELECT match_id, side, avg(coalesce(1000 + s_acctbal / 10, 1000)) AS ravg, max(coalesce(1000 + s_acctbal / 10, 1000)) AS rmax,
  min(coalesce(1000 + s_acctbal / 10, 1000)) AS rmin FROM seat LEFT JOIN supplier ON player = 'Player ' || s_suppkey AND s_suppkey % 5 <> 0 GROUP BY 1, 2),
j AS (SELECT fx.*, CASE WHEN coalesce(v.games, 0) > 0 THEN (v.s0 + 1) / (v.games + 2) ELSE 0.5 END AS chase, coalesce(v.a1, 0.5) AS bat,
  """ + ", ".join(f"coalesce(v.a{i}, {d}) AS {n}" for i, (n, d) in _VENUE_NAMES.items()) + ", " + ", ".join(
        f"coalesce(t{s}.m{i}, {d}) AS team{s}_{n}_5" for s in (1, 2) for i, (n, d) in enumerate(zip(_RECENT_NAMES, (0.5, 160, 160, 6, 7.5, 9.5)))) + """,
  coalesce(h.a0, 0.5) AS h2h_team1_winrate_prior, """ + ", ".join(
        f"(coalesce(w{s}.s0, 0) + 1) / (coalesce(w{s}.games, 0) + 2) AS venue_team{s}_winrate_prior, "
        f"CASE WHEN len(t{s}.lineup) > 0 THEN len(list_intersect(p{s}[1:11], t{s}.lineup)) / greatest(len(p{s}[1:11]), 1)::DOUBLE ELSE 0.5 END AS team{s}_xi_continuity_prior, "
        f"coalesce(r{s}.ravg, 1000) AS team{s}_player_rating_avg_prior, coalesce(r{s}.rmax, 1000) AS team{s}_player_rating_max_prior, "
        f"coalesce(r{s}.rmin, 1000) AS team{s}_player_rating_min_prior" for s in (1, 2)) + f""",
  (coalesce(o.s0, 0) + 1) / (coalesce(o.games, 0) + 2) AS toss_decision_venue_team1_winrate_prior
  FROM fx LEFT JOIN st t1 ON t1.kind = 'team' AND t1.key = team1{at("t1", 1)} LEFT JOIN st t2 ON t2.kind = 'team' AND t2.key = team2{at("t2", 2)}
  LEFT JOIN st v ON v.kind = 'venue' AND v.key = venue{at("v", 0)} LEFT JOIN st h ON h.kind = 'pair' AND h.key = team1 || chr(31) || team2{at("h", 0)}
  LEFT JOIN st w1 ON w1.kind = 'venue_team' AND w1.key = venue || chr(31) || team1{at("w1", 1)}
  LEFT JOIN st w2 ON w2.kind = 'venue_team' AND w2.key = venue || chr(31) || team2{at("w2", 2)}
  LEFT JOIN st o ON o.kind = 'toss' AND o.key = venue || chr(31) || CASE WHEN toss_winner = team1 THEN 1 ELSE 0 END || chr(31) || toss_decision{at("o", 0)}
  LEFT JOIN rate r1 ON r1.match_id = fx.match_id AND r1.side = 1 LEFT JOIN rate r2 ON r2.match_id = fx.match_id AND r2.side = 2)
SELECT j.match_id, match_date, team1, team2, venue, toss_winner, toss_decision, {extra}""" + ", ".join(
        f"round({c} + 1e-9, 5) AS {c}" for c in [
            *[f"team{s}_{n}_5" for s in (1, 2) for n in _RECENT_NAMES], *[n for n, _ in _VENUE_NAMES.values()], "h2h_team1_winrate_prior",
            *[f"venue_team{s}_winrate_prior" for s in (1, 2)], *[f"team{s}_xi_continuity_prior" for s in (1, 2)],
            *[f"team{s}_player_rating_{c}_prior" for s in (1, 2) for c in ("avg", "max", "min")], "toss_decision_venue_team1_winrate_prior"]) + """,
  round(chase + 1e-9, 5) AS venue_chase_winrate_prior, round(2 * chase - 1 + 1e-9, 5) AS venue_score_prior, round(bat + 1e-9, 5) AS venue_toss_bat_rate_prior,
  CASE WHEN (bat >= 0.5) = (toss_decision = 'bat') THEN 1.0::DOUBLE ELSE 0.0 END AS toss_decision_alignment_prior,
  round(CASE WHEN toss_decision <> 'field' THEN 0 WHEN toss_winner = team1 THEN chase ELSE 1 - chase END + 1e-9, 5) AS toss_field_chase_boost_team1,
  round(team1_player_rating_avg_prior - team2_player_rating_avg_prior + 1e-9, 5) AS player_rating_gap_prior, """ + ", ".join(
        f"{f'av{s}.{a}' if availability else '0.5::DOUBLE'} AS team{s}_{c}_prior" for s in (1, 2)
        for a, c in (("availability", "player_availability"), ("injury_proxy", "injury_proxy"))) + ", " + ", ".join(
        f"coalesce(p{s}[{i}], 'Unknown_Player') AS team{s}_player_{i}" for s in (1, 2) for i in range(1, 12)) + " FROM j" + (
        "".join(f" JOIN ({availability}) av{s} ON av{s}.match_id = j.match_id AND av{s}.side = {s}" for s in (1, 2)) if availability else "")


def _shown(out):
    """Means of fractions: a tiny shift keeps exact halves from rounding by summation order."""
    return out.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) if kind == "double" and c != "toss_decision_alignment_prior"
                        and not c.endswith(("availability_prior", "proxy_prior")) else F.col(c) for c, kind in out.dtypes])


def _known_ratings(t: Tables):
    return t.read("supplier").filter("s_suppkey % 5 <> 0").select(
        F.concat(F.lit("Player "), "s_suppkey").alias("player"), (1000 + F.col("s_acctbal") / 10).alias("rating"))


@query("sco7_serving_rows_all_features", _features_sql(_LAST_STATE, "NULL"))
def sco7_full(t: Tables):
    """Every feature of the open fixtures from the state tables of the decided ones, in one join."""
    f = finals(t)
    players = (F.col("players_1"), F.col("players_2"))
    state = keyed.live_state(f.filter(F.col("winner").isNotNull()), players)
    fixtures = f.filter(F.col("winner").isNull()).select(
        "match_id", "match_date", "team1", "team2", "venue", F.when(F.col("match_id") % 11 != 0, F.col("toss_winner")).alias("toss_winner"),
        "toss_decision", F.col("players_1").alias("team1_players"), F.col("players_2").alias("team2_players"))
    return _shown(keyed.serving_rows(fixtures, state, _known_ratings(t)))


@query("win14_training_rows", _features_sql(
    _STATE_BEFORE, "NOT NULL", " AND {a}.match_id = fx.match_id AND {a}.side = {side}", "winner, ", ORACLES["win13_player_availability"]))
def win14_training(t: Tables):
    """The whole training table: every feature of each decided match as it stood before it, lineups and winner."""
    sides = team_long(t.matches.select("match_id", "team1", "team2"))
    seen = rounded(priors.player_availability(t.lineup_long, sides, span=t.dates), "availability", "injury_proxy")
    return _shown(keyed.training_rows(durable(finals(t)), (F.col("players_1"), F.col("players_2")), _known_ratings(t), seen))


_XI_LISTS = """, sq AS (SELECT 'NATION_' || s_nationkey AS team, 'Player ' || s_suppkey AS player,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier),
pv AS (SELECT coalesce(bv.match_id, wv.match_id) AS match_id, coalesce(bv.player, wv.player) AS player, coalesce(bat_avg_10, 0) AS bat_avg_10,
    coalesce(bat_sr_10, 0) AS bat_sr_10, coalesce(bowl_econ_10, 0) AS bowl_econ_10, coalesce(bowl_sr_10, 0) AS bowl_sr_10
  FROM bv FULL JOIN wv ON bv.match_id = wv.match_id AND bv.player = wv.player),
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY match_id DESC) AS rn FROM pv) WHERE rn = 1)
"""
_XI_SELECT = """SELECT sq.team, count(*) AS players, round(coalesce(avg(CASE WHEN bat_avg_10 > 0 THEN bat_avg_10 END), 25), 5) AS bat_avg,
  round(coalesce(avg(CASE WHEN bat_sr_10 > 0 THEN bat_sr_10 END), 125), 5) AS bat_sr,
  round(coalesce(avg(CASE WHEN bowl_econ_10 > 0 THEN bowl_econ_10 END), 8.5), 5) AS bowl_eco,
  round(coalesce(avg(CASE WHEN bowl_sr_10 > 0 THEN bowl_sr_10 END), 20), 5) AS bowl_sr
FROM sq LEFT JOIN lv ON sq.player = lv.player WHERE sq.rn <= 11 GROUP BY 1"""


def squad_vectors(t: Tables):
    """Likely XI per team (dearest eleven) with the mean of their latest vectors."""
    squads = t.read("supplier").select(F.concat(F.lit("NATION_"), "s_nationkey").alias("team"), "s_suppkey",
                                       F.concat(F.lit("Player "), "s_suppkey").alias("player"), "s_acctbal")
    xi = top_n(squads, ["team"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 11)
    v = priors.player_vectors(t.dated(t.batting), t.dated(t.bowling), span=t.dates)
    latest = J.latest_per_key(v, ["player"], ["match_id"])
    named = {"bat_avg_10": "bat_avg", "bat_sr_10": "bat_sr", "bowl_econ_10": "bowl_eco", "bowl_sr_10": "bowl_sr"}
    j = xi.join(latest, "player", "left")
    return j.groupBy("team").agg(F.count("*").alias("players"), *[
        F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(P.VECTOR_DEFAULTS[n])).alias(n) for c, n in named.items()])


@query("sco9_likely_xi_vectors", VECTORS_SQL + _XI_LISTS + _XI_SELECT)
def sco9(t: Tables):
    return rounded(squad_vectors(t), *P.VECTOR_DEFAULTS, digits=5)


@query("sco9_future_fixture_scores")
def sco9b(t: Tables):
    """Every fixture of the last season scored from squad vectors alone."""
    v = squad_vectors(t).drop("players")
    side = lambda s: v.select(F.col("team").alias(f"team{s}"), *[F.col(c).alias(f"t{s}_{c}") for c in P.VECTOR_DEFAULTS])
    frame = feature_frame(t).select("match_id", "season", "team1", "team2", "label").join(side(1), "team1").join(side(2), "team2")
    cols = [f"t{s}_{c}" for s in (1, 2) for c in P.VECTOR_DEFAULTS]
    model = M.fit(frame.filter("season < 2001"), EN.encoder_stages([], cols), M.learner("logistic"))
    s = M.score(model, frame.filter("season = 2001"), ("match_id", "team1", "team2"))
    who, conf = SC.binary_decision(F.col("p1"), F.col("team1"), F.col("team2"))
    return s.select("match_id", "team1", "team2", F.round("p1", 6).alias("p1"), who.alias("predicted"), F.round(conf, 6).alias("confidence"))


_FUTURE = """, sv AS (""" + _XI_SELECT + """),
fu AS (SELECT match_id, team1, team2, venue FROM matches WHERE season = 2001)"""


@query("sco9_future_rows", VECTORS_SQL + _XI_LISTS + _FUTURE + """
SELECT match_id, team1, team2, venue, team1 AS toss_winner, """ + ", ".join(
    f"coalesce(a{s}.{c}, {d}) AS team{s}_{c}" for s in (1, 2) for c, d in P.VECTOR_DEFAULTS.items()) + ", " + ", ".join(
    f"'{v}' AS {c}" if isinstance(v, str) else f"{v}{'::DOUBLE' if isinstance(v, float) else ''} AS {c}" for c, v in P.FUTURE_CONTEXT.items()) + """
FROM fu LEFT JOIN sv a1 ON a1.team = team1 LEFT JOIN sv a2 ON a2.team = team2""")
def sco9_rows(t: Tables):
    """Every fixture of the last season before anything is known of its day: likely lineups and the preset context."""
    v = rounded(squad_vectors(t), *P.VECTOR_DEFAULTS, digits=5)
    return LV.future_rows(t.matches.filter("season = 2001").select("match_id", "team1", "team2", "venue"), v)


@query("sco9_future_score_means", cte("matches") + f""", p AS (
  SELECT venue, round({_MEAN}, 4) AS p1 FROM matches WHERE winner IS NOT NULL AND season < 2001 GROUP BY 1)
SELECT match_id, CASE WHEN p1 >= 0.5 THEN team1 ELSE team2 END AS predicted, p1, round(greatest(p1, 1 - p1), 4) AS confidence
FROM matches JOIN p ON p.venue = matches.venue WHERE season = 2001""")
def sco9_means(t: Tables):
    """The same rows scored by a model whose probabilities are the venue's means."""
    f = LV.future_rows(t.matches.filter("season = 2001").select("match_id", "team1", "team2", "venue"), squad_vectors(t))
    model = M.fit(_decided(t).filter("season < 2001"), _venue_only(), M.learner("logistic", regParam=0.0, tol=1e-9, maxIter=200))
    s = M.score(model, f.withColumn("label", F.lit(0.0)), ("match_id", "team1", "team2")).withColumn("p1", F.round("p1", 4))
    who, confidence = SC.binary_decision(F.col("p1"), F.col("team1"), F.col("team2"))
    return s.select("match_id", who.alias("predicted"), "p1", F.round(confidence, 4).alias("confidence"))
