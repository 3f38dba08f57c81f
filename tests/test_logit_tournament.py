import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import logit, tournament


def _newton(X, y, lam, iters=50):
    """L2 logistic regression (penalty lam/2 ||w||^2 on the mean loss, free intercept)."""
    n, d = X.shape
    A = np.hstack([np.ones((n, 1)), X])
    w = np.zeros(d + 1)
    pen = np.r_[0.0, np.full(d, lam)]
    for _ in range(iters):
        p = 1 / (1 + np.exp(-A @ w))
        g = A.T @ (p - y) / n + pen * w
        H = (A.T * (p * (1 - p))) @ A / n + np.diag(pen)
        w -= np.linalg.solve(H, g)
    return w


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 2))
    y = (X[:, 0] + 0.5 * X[:, 1] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)], "x1 double, x2 double, y double")
    C = 0.05
    model = logit.fit_poly_logit(df, ["x1", "x2"], "y", C=C, degree=1, max_iter=500, tol=1e-12)
    b0, w = logit.coefficients(model)
    ref = _newton(X, y, 1.0 / (C * len(y)))
    assert np.allclose([b0, *w], ref, atol=1e-5)


def test_fixed_score_matches_numpy(spark):
    df = spark.createDataFrame([(0.5, 2.0), (-1.0, 0.25)], "a double, b double")
    coefs = [0.3, -0.2, 0.1, 0.05, -0.4]
    p = df.select(logit.logistic_score(["a", "b"], 0.7, coefs).alias("p")).collect()
    for (a, b), got in zip([(0.5, 2.0), (-1.0, 0.25)], p):
        z = 0.7 + 0.3 * a - 0.2 * b + 0.1 * a * a + 0.05 * a * b - 0.4 * b * b
        assert got.p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-15)


def _prob(h, a):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(h - a)))


def _teams(spark, n_groups=8, per_group=4):
    rows = [(t, g, float((t * 7) % 11)) for g in range(n_groups) for t in range(g * per_group, (g + 1) * per_group)]
    return spark.createDataFrame(rows, "team long, grp int, rating double").withColumn("bracket", F.lit(0))


def test_standings_invariants(spark):
    teams = _teams(spark)
    scored = tournament.pair_scores(teams, ["bracket", "grp"], "team", "rating", _prob, max_group_size=4)
    assert scored.count() == 8 * 6
    st = tournament.standings(teams, scored, ["bracket", "grp"], "team")
    tot = st.agg(F.sum("total_prob")).first()[0]
    assert tot == pytest.approx(48.0)  # each pair hands out p + (1 - p)
    lonely = teams.limit(1).withColumn("grp", F.lit(99))
    st2 = tournament.standings(teams.unionByName(lonely), scored, ["bracket", "grp"], "team")
    assert st2.filter(F.col("grp") == 99).first().points == 0


def test_bracket_rounds(spark):
    teams = _teams(spark)
    scored = tournament.pair_scores(teams, ["bracket", "grp"], "team", "rating", _prob, max_group_size=4)
    st = tournament.standings(teams, scored, ["bracket", "grp"], "team")
    order = [F.col("points").desc(), F.col("total_prob").desc(), F.col("team")]
    top = tournament.top_per_group(st, ["bracket", "grp"], order, 2)
    seeded = tournament.seed_slots(top, ["bracket"], "grp", "team")
    slots = {r.slot: r.team for r in seeded.collect()}
    assert sorted(slots) == list(range(16))
    rounds = tournament.fold_rounds(seeded, ["bracket"], "team", teams, "rating", _prob)
    counts = {r["round"]: r["count"] for r in rounds.groupBy("round").count().collect()}
    assert counts == {1: 8, 2: 4, 3: 2, 4: 1}
    rep = tournament.round_report(rounds, teams.withColumn("name", F.concat(F.lit("T"), "team")), "team", "name")
    assert rep.count() == 15
    assert all(" vs. " in r.label for r in rep.collect())


def test_fold_cut_is_inclusive_for_away(spark):
    slots = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4)], "bracket int, slot int, team long")
    ratings = spark.createDataFrame([(1, 0.8), (2, 0.0), (3, 0.81), (4, 0.0)], "team long, r double")
    # P(home) is the home rating itself: 0.8 -> away wins (p <= cut), 0.81 -> home wins
    prob = lambda h, a: h
    r1 = {r.pair: r.winner for r in tournament.fold_round(slots, ["bracket"], "team", ratings, "r", prob).collect()}
    assert r1 == {0: 2, 1: 3}


def test_top2_ties(spark):
    st = spark.createDataFrame([
        (0, 0, 1, 3, 1.2), (0, 0, 2, 3, 1.5), (0, 0, 3, 3, 1.5), (0, 0, 4, 0, 0.1),  # tie on points; full tie 2/3
    ], "bracket int, grp int, team long, points int, total_prob double")
    order = [F.col("points").desc(), F.col("total_prob").desc(), F.col("team")]
    top = tournament.top_per_group(st, ["bracket", "grp"], order, 2).orderBy("place").collect()
    assert [(r.team, r.place) for r in top] == [(2, 1), (3, 2)]


def test_fitted_model_as_expression(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(200, 3))
    y = (X[:, 0] - X[:, 1] * X[:, 2] + rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "id long, a double, b double, c double, y double")
    model = logit.fit_poly_logit(df, ["a", "b", "c"], "y", C=1.0)
    b0, w = logit.conventional_coefficients(model, 3)
    via_model = {r.id: r.p for r in logit.predict_proba(model, df).collect()}
    via_expr = {r.id: r.p for r in df.select("id", logit.logistic_score(["a", "b", "c"], b0, w).alias("p")).collect()}
    assert all(abs(via_model[i] - via_expr[i]) < 1e-12 for i in via_model)


def test_seeding_keeps_every_row(spark):
    table = spark.createDataFrame([(0, g, p, 10 * g + p) for g in range(10) for p in (1, 2)], "bracket int, grp int, place int, team long")
    with pytest.raises(Exception, match="not in the list"):
        tournament.seed_slots(table, ["bracket"], "grp", "team").collect()
    table = table.withColumn("pos", F.col("grp") * 2 + F.col("place") - 1)
    assert tournament.reorder_by_list(table, "pos", tournament.PAIRING, unlisted="null").count() == 20


def test_rounds_run_to_the_last_pair(spark):
    slots = spark.createDataFrame([(0, i, i + 1) for i in range(32)], "bracket int, slot int, team long")
    ratings = spark.createDataFrame([(i + 1, float(i)) for i in range(32)], "team long, rating double")
    rounds = tournament.fold_rounds(slots, ["bracket"], "team", ratings, "rating", _prob)
    counts = {r["round"]: r["count"] for r in rounds.groupBy("round").count().collect()}
    assert counts == {1: 16, 2: 8, 3: 4, 4: 2, 5: 1}
    with pytest.raises(Exception, match="no rating"):
        tournament.fold_round(slots, ["bracket"], "team", ratings.where("team <> 3"), "rating", _prob).collect()


def test_pair_scores_with_several_ratings_and_a_fitted_model(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 2))
    y = (X[:, 0] - X[:, 1] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, x), float(t)) for x, t in zip(X, y)], "a double, b double, y double")
    model = logit.fit_poly_logit(df, ["a", "b"], "y", C=1.0)
    b0, w = logit.conventional_coefficients(model, 2)
    prob = lambda h, a: logit.logistic_score([h["r"] - a["r"], h["s"] - a["s"]], b0, w)
    teams = spark.createDataFrame([(1, 0, 1.0, 0.5), (2, 0, 0.2, -0.1), (3, 0, None, 1.0)], "team long, g int, r double, s double")
    got = {(r.home, r.away): r.p_home for r in tournament.pair_scores(teams, ["g"], "team", ["r", "s"], prob, max_group_size=3).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[(1, 3)] is None
    one = spark.createDataFrame([(0.8, 0.6, 0.0)], "a double, b double, y double")
    assert got[(1, 2)] == pytest.approx(logit.predict_proba(model, one).first().p)
    with pytest.raises(Exception, match="pairs_in_groups"):
        tournament.pair_scores(teams, ["g"], "team", ["r", "s"], prob, max_group_size=2).collect()


def test_gradient_is_zero_at_the_fit_only(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(400, 2))
    y = (X[:, 0] > rng.normal(size=400)).astype(float)
    df = spark.createDataFrame([(*map(float, x), float(t)) for x, t in zip(X, y)], "a double, b double, y double")
    model = logit.fit_poly_logit(df, ["a", "b"], "y", C=0.1, max_iter=500, tol=1e-12)
    b0, w = logit.conventional_coefficients(model, 2)
    at = {r.term: r.gradient for r in logit.penalised_gradient(df, ["a", "b"], "y", b0, w, 0.1).collect()}
    assert set(at) == {"intercept", "a", "b", "a*a", "a*b", "b*b"} and max(map(abs, at.values())) < 1e-3
    off = logit.penalised_gradient(df, ["a", "b"], "y", b0, [w[0] + 0.5, *w[1:]], 0.1).collect()
    assert max(abs(r.gradient) for r in off) > 1


def test_certificate_holds_against_a_long_numpy_fit(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 2)) * [1.0, 5.0]
    y = (X[:, 0] + 0.2 * X[:, 1] > rng.normal(size=500)).astype(float)
    data = [(*map(float, x), float(t)) for x, t in zip(X, y)]
    df = spark.createDataFrame(data + [(None, 1.0, 1.0), (1.0, 1.0, None)], "a double, b double, y double")  # two incomplete rows
    T = np.column_stack([np.ones(500), X, X[:, 0] ** 2, X[:, 0] * X[:, 1], X[:, 1] ** 2])
    lam = np.array([0.0] + [1 / 0.3] * 5)
    w = np.zeros(6)
    for _ in range(200):
        p = 1 / (1 + np.exp(-T @ w))
        w = w - 0.5 * np.linalg.solve((T * (p * (1 - p))[:, None]).T @ T + np.diag(lam), T.T @ (p - y) + lam * w)
    best = 1 / (1 + np.exp(-T @ w))
    steps = []
    for tol in (0.5, 1e-3, 1e-9):
        fit = logit.certified_fit(df, ["a", "b"], "y", C=0.3, tol=tol)
        steps.append(fit.steps)
        got = df.where("a is not null and y is not null").select(
            logit.logistic_score(["a", "b"], fit.intercept, fit.coefs).alias("p"), fit.error(["a", "b"]).alias("e")).collect()
        far = np.abs(np.array([r.p for r in got]) - best)
        assert np.all(far <= np.array([r.e for r in got]) + 1e-13) and max(r.e for r in got) <= tol / 4 + 1e-15
        assert tol > 0.1 or far.max() < tol
    assert steps == sorted(steps) and steps[0] < steps[2]
    assert df.select(fit.probability(["a", "b"]).alias("p")).where("p is null").count() == 1


def test_certificate_is_refused_where_there_is_none(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)], "a double, y double")
    with pytest.raises(ValueError, match="certified"):
        logit.certified_fit(df, ["a"], "y", C=1.0, degree=1, most_steps=15)
    with pytest.raises(ValueError, match="no complete"):
        logit.certified_fit(df.where("a < 0"), ["a"], "y")
    two = df.withColumn("y", (F.col("a") % 3 == 0).cast("double"))
    loose = logit.certified_fit(two, ["a"], "y", C=1.0, degree=1, tol=0.5)
    with pytest.raises(Exception, match="not known"):
        two.select(loose.probability(["a"], within=1e-12)).collect()
