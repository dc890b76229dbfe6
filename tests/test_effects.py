"""Effects against closed forms and brute force on small panels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.effects import (
    Design,
    aggregate_att,
    att_gt,
    att_std_errors,
    cohort_sizes,
    compare,
    dropped_rows,
    estimate,
    influence,
    kernels,
    left_out,
    pretest,
    pretrend,
)
from panelwright.effects.bands import quadratic_form
from panelwright.effects.design import NEVER
from panelwright.effects.numbers import chi2_tail, f_tail

COHORTS = [5, 7, 0, 0]


def make_panel(spark, n=80, months=8, effect=2.0, noise=0.0, seed=3, covariate=True, drop=0.0):
    """Unit and month effects, a planted effect, and a covariate-driven trend."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x1, x2 = rng.normal(), float(rng.integers(0, 2))
        g = COHORTS[(i + int(x1 > 0)) % 4]
        for t in range(1, months + 1):
            y = i * 0.1 + t * 0.5 + (effect if g and t >= g else 0.0)
            if covariate:
                y += 0.3 * t * x1 + 0.2 * t * x2
            y += noise * rng.normal()
            if rng.random() >= drop:
                rows.append((i, t, g, y, x1, x2))
    pdf = pd.DataFrame(rows, columns=["unit", "t", "g", "y", "x1", "x2"])
    return pdf, spark.createDataFrame(pdf)


def as_dict(df):
    return {(r["group"], r["time"]): r for r in df.collect()}


def logit(X, d):
    b = np.zeros(X.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve((X.T * (p * (1 - p))) @ X, X.T @ (d - p))
    return 1 / (1 + np.exp(-X @ b))


def ols(X, y):
    return np.linalg.lstsq(X, y, rcond=None)[0]


def brute_panel(pdf, g, t, b, method):
    wide = pdf.pivot(index="unit", columns="t", values="y")
    facts = pdf.groupby("unit")[["g", "x1", "x2"]].first()
    gg = facts["g"].replace(0, NEVER)
    use = ((gg == g) | (gg > max(t, b))) & wide[t].notna() & wide[b].notna()
    d = (gg[use] == g).to_numpy(float)
    dy = (wide[t] - wide[b])[use].to_numpy()
    X = np.column_stack([np.ones(len(d)), facts.loc[use, ["x1", "x2"]].to_numpy()])
    m = X @ ols(X[d == 0], dy[d == 0]) if method != "ipw" else np.zeros(len(d))
    if method == "reg":
        return (d * (dy - m)).sum() / d.sum()
    p = logit(X, d)
    w0 = p * (1 - d) / (1 - p)
    return (d * (dy - m)).sum() / d.sum() - (w0 * (dy - m)).sum() / w0.sum()


def brute_months(pdf, g, t, b, method):
    gg = pdf["g"].replace(0, NEVER)
    use = ((gg == g) | (gg > max(t, b))) & pdf["t"].isin([t, b])
    part = pdf[use]
    d = (gg[use] == g).to_numpy(float)
    post = (part["t"] == t).to_numpy(float)
    y = part["y"].to_numpy()
    X = np.column_stack([np.ones(len(d)), part[["x1", "x2"]].to_numpy()])
    p = logit(X, d)
    w0 = p * (1 - d) / (1 - p)
    mean = lambda w, v: (w * v).sum() / w.sum()
    out = {}
    for s, sel in (("post", post), ("pre", 1 - post)):
        c = X @ ols(X[(d == 0) & (sel == 1)], y[(d == 0) & (sel == 1)])
        tr = X @ ols(X[(d == 1) & (sel == 1)], y[(d == 1) & (sel == 1)])
        if method == "reg":
            out[s] = mean(d * sel, y) - mean(d, c)
        elif method == "ipw":
            out[s] = mean(d * sel, y) - mean(w0 * sel, y)
        else:
            out[s] = (
                mean(d * sel, y - c) - mean(w0 * sel, y - c) + mean(d, tr - c) - mean(d * sel, tr - c)
            )
    return out["post"] - out["pre"]


def test_planted_effect_is_returned_exactly(spark):
    _, panel = make_panel(spark, covariate=False)
    for r in att_gt(panel, "y", "unit", "t", "g").collect():
        assert r["att"] == pytest.approx(2.0 if r["time"] >= r["group"] else 0.0, abs=1e-9)


def test_cell_count_and_exposures():
    # Three cohorts over 77 months: 228 cells and 91 distinct exposures. Rounding
    # decimal years to two digits would give 117.
    first = 2013 * 12 + 1
    months = range(first, first + 77)
    cohorts = [2017 * 12 + 8, 2017 * 12 + 10, 2018 * 12 + 11]
    design = Design.of(months, [*cohorts, 2019 * 12 + 12, 2021 * 12 + 5, 0, None])
    cells = design.cells()
    assert len(cells) == 228
    assert len({c.time - c.group for c in cells}) == 91
    year = lambda m: round((m - 1) // 12 + ((m - 1) % 12) / 12, 2)
    assert len({round(year(c.time) - year(c.group), 2) for c in cells}) == 117


@pytest.mark.parametrize("method", ["dr", "reg", "ipw"])
@pytest.mark.parametrize("base", ["varying", "universal"])
def test_balanced_covariates_match_brute_force(spark, method, base):
    pdf, panel = make_panel(spark, noise=1.0)
    found = as_dict(att_gt(panel, "y", "unit", "t", "g", ["x1", "x2"], method=method, base=base))
    assert len(found) == (14 if base == "varying" else 16)
    for (g, t), r in found.items():
        assert r["note"] is None
        assert r["att"] == pytest.approx(brute_panel(pdf, g, t, r["base"], method), abs=1e-7)


@pytest.mark.parametrize("method", ["dr", "reg", "ipw"])
def test_unbalanced_covariates_match_brute_force(spark, method):
    pdf, panel = make_panel(spark, n=120, noise=1.0, drop=0.1)
    for mode, brute in (("auto", brute_months), ("panel", brute_panel)):
        found = as_dict(
            att_gt(panel, "y", "unit", "t", "g", ["x1", "x2"], method=method, panel_mode=mode)
        )
        for (g, t), r in found.items():
            assert r["att"] == pytest.approx(brute(pdf, g, t, r["base"], method), abs=1e-7)


def test_constant_formula_equals_plain_effects(spark):
    _, panel = make_panel(spark, noise=1.0)
    plain = as_dict(att_gt(panel, "y", "unit", "t", "g"))
    pairs = as_dict(att_gt(panel, "y", "unit", "t", "g", panel_mode="panel"))
    fitted = as_dict(estimate(panel, "y", "unit", "t", "g", draws=0).att())
    assert plain.keys() == pairs.keys() == fitted.keys()
    for key, r in plain.items():
        assert r["att"] == pytest.approx(pairs[key]["att"], abs=1e-9)
        assert r["att"] == pytest.approx(fitted[key]["att"], abs=1e-9)


@pytest.mark.parametrize("drop", [0.0, 0.08])
@pytest.mark.parametrize("method", ["dr", "reg", "ipw"])
def test_influence_matches_leave_one_out(spark, method, drop):
    """n^2 * var of leave-one-out estimates approaches the influence error."""
    pdf, panel = make_panel(spark, n=150, noise=1.0, drop=drop)
    est = estimate(panel, "y", "unit", "t", "g", ["x1", "x2"], method=method, draws=0)
    errors = est.analytic_errors()
    brute = brute_months if drop else brute_panel
    for g, t, b in ((5, 6, 4), (7, 3, 2)):
        units = pdf["unit"].unique()
        out = np.array([brute(pdf[pdf["unit"] != u], g, t, b, method) for u in units])
        n = len(units)
        jackknife = math.sqrt((n - 1) / n * ((out - out.mean()) ** 2).sum())
        assert errors[g, t] == pytest.approx(jackknife, rel=0.12)


def test_std_errors_agree(spark):
    _, panel = make_panel(spark, noise=1.0)
    sql = as_dict(att_std_errors(panel, "y", "unit", "t", "g"))
    est = estimate(panel, "y", "unit", "t", "g", draws=0)
    for key, se in est.analytic_errors().items():
        assert sql[key]["std_error"] == pytest.approx(se, rel=1e-9)


def test_averages_match_hand_weights(spark):
    pdf, panel = make_panel(spark, noise=1.0)
    att = att_gt(panel, "y", "unit", "t", "g")
    sizes = cohort_sizes(panel, "unit", "g")
    n = pdf.drop_duplicates("unit").groupby("g").size()
    a = {k: r["att"] for k, r in as_dict(att).items()}
    post = {k: v for k, v in a.items() if k[1] >= k[0]}

    def got(kind):
        return {r["level"]: r["att"] for r in aggregate_att(att, sizes, kind).collect()}

    simple = sum(v * n[g] for (g, _), v in post.items()) / sum(n[g] for g, _ in post)
    assert got("simple")[None] == pytest.approx(simple)
    by_group = {g: np.mean([v for (h, _), v in post.items() if h == g]) for g in (5, 7)}
    group = got("group")
    assert group[5] == pytest.approx(by_group[5])
    assert group[None] == pytest.approx(
        sum(by_group[g] * n[g] for g in by_group) / sum(n[g] for g in by_group)
    )
    dynamic = got("dynamic")
    at0 = (a[5, 5] * n[5] + a[7, 7] * n[7]) / (n[5] + n[7])
    assert dynamic[0] == pytest.approx(at0)
    assert dynamic[None] == pytest.approx(np.mean([v for e, v in dynamic.items() if e is not None and e >= 0]))
    calendar = got("calendar")
    assert set(calendar) == {5, 6, 7, 8, None}
    assert calendar[None] == pytest.approx(np.mean([v for t, v in calendar.items() if t]))

    est = estimate(panel, "y", "unit", "t", "g", draws=50)
    for kind in ("simple", "group", "dynamic", "calendar"):
        bands = {r["level"]: r["estimate"] for r in est.bands(kind).collect()}
        assert bands == pytest.approx(got(kind))


def test_bootstrap_is_repeatable_and_close_to_analytic(spark):
    _, panel = make_panel(spark, n=200, noise=1.0)
    est = estimate(panel, "y", "unit", "t", "g", ["x1", "x2"], draws=2000)
    again = estimate(panel.repartition(3), "y", "unit", "t", "g", ["x1", "x2"], draws=2000)
    first = {(r["group"], r["time"]): r for r in est.bands().collect()}
    second = {(r["group"], r["time"]): r for r in again.bands().collect()}
    analytic = est.analytic_errors()
    for key, r in first.items():
        assert r["std_error"] == pytest.approx(second[key]["std_error"], rel=1e-6)
        assert r["std_error"] == pytest.approx(analytic[key], rel=0.15)
        assert r["crit"] > 1.96
        assert r["conf_low"] < r["estimate"] < r["conf_high"]


def test_wald_statistic_and_singular_case(spark):
    _, panel = make_panel(spark, n=150, noise=1.0)
    row = estimate(panel, "y", "unit", "t", "g", ["x1", "x2"], draws=0).pretest_wald().first()
    assert row["df"] == 3 + 5 and row["note"] is None
    assert 0 <= row["p_value"] <= 1
    _, flat = make_panel(spark, covariate=False)
    row = estimate(flat, "y", "unit", "t", "g", draws=0).pretest_wald().first()
    assert row["statistic"] is None and "singular" in row["note"] and row["rank"] < row["df"]


def test_wald_against_a_plain_solution():
    rng = np.random.default_rng(1)
    A, x = rng.normal(size=(40, 6)), rng.normal(size=6)
    V = A.T @ A
    statistic, rank = quadratic_form(V.copy(), x.copy())
    assert rank == 6 and statistic == pytest.approx(x @ np.linalg.solve(V, x))
    A[:, 5] = A[:, 0] - 2 * A[:, 3]
    A[:, 4] = 0
    assert quadratic_form(A.T @ A, x)[1] == 4


@pytest.mark.parametrize("covariates", [[], ["x1"]])
def test_chunks_and_groups_change_nothing(spark, monkeypatch, covariates):
    """Bands and the covariance from chunks of few columns, dealt over several groups of tasks, are the same."""
    _, panel = make_panel(spark, n=60, noise=1.0)
    est = estimate(panel, "y", "unit", "t", "g", covariates, draws=40)
    kinds = ("cells", "dynamic", "simple")
    whole = [est.bands(kind).collect() for kind in kinds]
    errors, wald = est.analytic_errors(), est.pretest_wald().first()
    for name, value in (("COLUMNS", 3), ("BLOCK_CELLS", 3), ("NUMBERS", 200), ("ADDED", 2)):
        monkeypatch.setattr(influence, name, value)
    monkeypatch.setattr(kernels, "CELLS_HELD", 2)
    for kind, rows in zip(kinds, whole, strict=True):
        for one, two in zip(rows, est.bands(kind).collect(), strict=True):
            one, two = one.asDict(), two.asDict()
            assert one.pop("kind") == two.pop("kind") and [x is None for x in one.values()] == [x is None for x in two.values()]
            assert [x for x in one.values() if x is not None] == pytest.approx([x for x in two.values() if x is not None], rel=1e-9)
    assert errors == pytest.approx(est.analytic_errors(), rel=1e-9)
    again = est.pretest_wald().first()
    assert again["rank"] == wald["rank"] == wald["df"] and again["statistic"] == pytest.approx(wald["statistic"], rel=1e-7)


def brute_cvm(pdf, names=("x1", "x2")):
    wide = pdf.pivot(index="unit", columns="t", values="y")
    facts = pdf.groupby("unit")[["g", "x1", "x2"]].first()
    gg = facts["g"].replace(0, NEVER).to_numpy()
    x = facts[list(names)].to_numpy()
    total = 0.0
    for g in (5, 7):
        for t in range(2, g):
            use = (gg == g) | (gg > t)
            d = (gg[use] == g).astype(float)
            X = np.column_stack([np.ones(use.sum()), x[use]])
            p = logit(X, d)
            w0 = p * (1 - d) / (1 - p)
            dy = (wide[t] - wide[t - 1]).to_numpy()[use]
            J = []
            for u in x:
                one = (x[use] <= u).all(axis=1)
                J.append((d * dy * one).sum() / d.sum() - (w0 * dy * one).sum() / w0.sum())
            total += len(x) * np.mean(np.square(J))
    return total


def test_pretest_statistic_matches_brute_force(spark):
    pdf, panel = make_panel(spark, n=90, noise=1.0)
    row = pretest(panel, "y", "unit", "t", "g", ["x1", "x2"], draws=200).first()
    assert row["statistic"] == pytest.approx(brute_cvm(pdf), rel=1e-8)
    assert row["n_units"] == 90 and row["n_points"] == 90 and row["n_cells"] == 3 + 5
    assert 0 <= row["p_value"] <= 1 and row["critical_value"] > 0
    sampled = pretest(panel, "y", "unit", "t", "g", ["x1", "x2"], eval_points=20, draws=20).first()
    assert 0 < sampled["n_points"] < 90
    plain = pretest(panel, "y", "unit", "t", "g", draws=50).first()
    assert plain["n_points"] == 1


def brute_draws(pdf, hashes, draws, names=("x1", "x2")):
    """The drawn statistics by definition: influence values of every moment at every point."""
    wide = pdf.pivot(index="unit", columns="t", values="y")
    facts = pdf.groupby("unit")[["g", "x1", "x2"]].first()
    gg = facts["g"].replace(0, NEVER).to_numpy()
    x = facts[list(names)].to_numpy()
    V = kernels.multipliers(np.array([hashes[u] for u in facts.index], dtype=np.int64), draws)
    total = np.zeros(draws)
    for g in (5, 7):
        for t in range(2, g):
            use = (gg == g) | (gg > t)
            d, v = (gg[use] == g).astype(float), V[use]
            X = np.column_stack([np.ones(use.sum()), x[use]])
            p = logit(X, d)
            odds = p * (1 - d) / (1 - p)
            dy = (wide[t] - wide[t - 1]).to_numpy()[use]
            H = (X * (p * (1 - p))[:, None]).T @ X
            for u in x:
                one = (x[use] <= u).all(axis=1)
                level1, level0 = (d * dy * one).sum() / d.sum(), (odds * dy * one).sum() / odds.sum()
                slope = -((odds * dy * one) @ X - level0 * (odds @ X)) / odds.sum()
                value = v.T @ (d / d.sum() * (dy * one - level1) - odds / odds.sum() * (dy * one - level0))
                total += (value + (v * (d - p)[:, None]).T @ X @ np.linalg.solve(H, slope)) ** 2
    return total


def test_pretest_over_many_blocks(spark, monkeypatch):
    """Blocks of a few units, ties and copies of points among them, give the same test as its definition."""
    pdf, _ = make_panel(spark, n=100, noise=1.0)
    pdf["x1"] = pdf["x1"].round(0)
    copies = pdf["unit"] % 3 == 0
    first = pdf.loc[pdf["unit"] == pdf["unit"].min()].iloc[0]
    pdf.loc[copies, ["x1", "x2"]] = [first["x1"], first["x2"]]
    panel = spark.createDataFrame(pdf)
    one = pretest(panel, "y", "unit", "t", "g", ["x1", "x2"], draws=60).first()
    monkeypatch.setattr(pretrend, "BLOCK_UNITS", 9)
    monkeypatch.setattr(pretrend, "CELLS_AT_ONCE", 3)
    row = pretest(panel, "y", "unit", "t", "g", ["x1", "x2"], draws=60).first()
    assert row["statistic"] == pytest.approx(brute_cvm(pdf), rel=1e-8) and row["statistic"] == pytest.approx(one["statistic"], rel=1e-10)
    hashes = {r["unit"]: r["h"] for r in panel.select("unit", F.xxhash64("unit", F.lit(1)).alias("h")).distinct().collect()}
    drawn = brute_draws(pdf, hashes, 60)
    assert row["critical_value"] == pytest.approx(np.quantile(drawn, 0.95, method="inverted_cdf"), rel=1e-7)
    assert row["p_value"] == pytest.approx((drawn > row["statistic"]).mean())
    for covariates in (["x1"], ["x2"]):
        row = pretest(panel, "y", "unit", "t", "g", covariates, draws=60).first()
        drawn = brute_draws(pdf, hashes, 60, covariates)
        assert row["statistic"] == pytest.approx(brute_cvm(pdf, covariates), rel=1e-8)
        assert row["critical_value"] == pytest.approx(np.quantile(drawn, 0.95, method="inverted_cdf"), rel=1e-7)
    for covariates in (["x1"], []):
        many = pretest(panel, "y", "unit", "t", "g", covariates, draws=20).first()
        monkeypatch.setattr(pretrend, "BLOCK_UNITS", 1000)
        few = pretest(panel, "y", "unit", "t", "g", covariates, draws=20).first()
        monkeypatch.setattr(pretrend, "BLOCK_UNITS", 9)
        assert many["statistic"] == pytest.approx(few["statistic"], rel=1e-9) and many["p_value"] == few["p_value"]


def test_pretest_pairs_add_cells_before_draws(spark, monkeypatch):
    """Blocks of a few units again, in which every cell alone adds to the whole, and no term is made per draw."""
    pdf, _ = make_panel(spark, n=60, noise=1.0)
    panel = spark.createDataFrame(pdf)
    hashes = {r["unit"]: r["h"] for r in panel.select("unit", F.xxhash64("unit", F.lit(1)).alias("h")).distinct().collect()}
    monkeypatch.setattr(pretrend, "BLOCK_UNITS", 9)
    monkeypatch.setattr(pretrend, "PAIR_TIMES", 1)
    monkeypatch.setattr(pretrend, "CELLS_AT_ONCE", 2)
    monkeypatch.setattr(kernels, "moment_columns", None)  # terms of every unit, cell and draw took too long
    row = pretest(panel, "y", "unit", "t", "g", ["x1", "x2"], draws=40).first()
    drawn = brute_draws(pdf, hashes, 40)
    assert row["statistic"] == pytest.approx(brute_cvm(pdf), rel=1e-8)
    assert row["critical_value"] == pytest.approx(np.quantile(drawn, 0.95, method="inverted_cdf"), rel=1e-7)


def test_pair_terms_are_products_by_matrices():
    """A pair of blocks, alike or not, adds what products of its terms weighted by the points above add."""
    rng = np.random.default_rng(5)
    cells = [{"group": 5, "controls": [0, 7], "time": 2 + i, "base": 1 + i, "gamma": np.array([-0.2, 0.1, 0.3]), "n1": 5.0, "w0": 3.0,
              "inverse": np.eye(3), "odds_x": np.array([3.0, 0.2, 0.1])} for i in range(3)]
    spec = {"k": 2, "months": 6, "draws": 7, "chunk": 2, "cells": cells, "drawn": rng.normal(size=(7, 3, 5))}
    blocks = [(rng.integers(1, 1 << 60, n), rng.choice([0, 5, 7, 9], n), np.column_stack([np.ones(n), rng.integers(0, 4, (n, 2))]), rng.normal(size=(n, 6))) for n in (11, 8)]
    points, weight = rng.integers(0, 4, (30, 2)).astype(float), rng.integers(0, 2, 30).astype(float)
    for a, b in ((0, 0), (0, 1)):
        one, two = blocks[a], blocks[b]
        above = np.zeros((len(one[0]), len(two[0])))
        kernels._count_above(above, one[2][:, 1:], two[2][:, 1:], points, weight)
        flags = [(points[None] >= x[2][:, None, 1:]).all(axis=2) for x in (one, two)]
        assert (above == (flags[0] * weight) @ flags[1].T).all()
        want = sum((terms * (above[np.ix_(rows, others)] @ more)).sum(axis=0) for (rows, terms), (others, more) in zip(
            kernels.moment_columns(spec, 0, 3, *one), kernels.moment_columns(spec, 0, 3, *two), strict=True))
        found = kernels._pair_total(spec, a == b, one, two, above)
        assert found == pytest.approx(want if a == b else 2 * want, rel=1e-9)


def test_pretest_counts_dropped_units(spark):
    pdf, _ = make_panel(spark, n=90, noise=1.0)
    pdf = pdf[~((pdf["unit"] < 7) & (pdf["t"] == 3))]
    row = pretest(spark.createDataFrame(pdf), "y", "unit", "t", "g", ["x1", "x2"], draws=0).first()
    dropped = pdf.loc[pdf["unit"] < 7, "unit"].nunique()
    assert (row["n_units"], row["n_dropped"]) == (90 - dropped, dropped) and row["p_value"] is None


def test_pretest_rejects_a_diverging_cohort(spark):
    pdf, _ = make_panel(spark, n=120, noise=0.5)
    pdf.loc[pdf["g"] == 7, "y"] += 1.5 * pdf.loc[pdf["g"] == 7, "t"]
    row = pretest(spark.createDataFrame(pdf), "y", "unit", "t", "g", ["x1", "x2"], draws=200).first()
    assert row["p_value"] < 0.05


def test_dropped_rows_and_edge_cohorts(spark):
    pdf, _ = make_panel(spark, noise=1.0)
    pdf.loc[pdf["unit"] == 4, "x1"] = None
    pdf.loc[pdf["unit"] == 8, "g"] = 1      # treated from the start: no base month
    pdf.loc[pdf["unit"] == 12, "g"] = 99    # treated after the study: never treated
    panel = spark.createDataFrame(pdf)
    panel = panel.withColumn("x1", F.nanvl("x1", F.lit(None).cast("double")))
    row = dropped_rows(panel, ["y", "x1", "x2"]).first()
    assert (row["n_rows"], row["n_dropped"]) == (640, 8)
    found = att_gt(panel, "y", "unit", "t", "g", ["x1", "x2"])
    assert {r["group"] for r in found.collect()} == {5, 7}
    assert found.where("time = 2 and group = 5").first()["n_control"] == (
        pdf[(pdf["t"] == 2) & pdf["x1"].notna() & pdf["g"].isin([0, 7, 99])].shape[0]
    )


def test_left_out_rows(spark):
    pdf, _ = make_panel(spark)
    pdf.loc[pdf["unit"] == 8, "g"] = 1
    panel = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("unit").isin(4, 8) & (F.col("t") < 4), None).otherwise(F.col("y")))
    got = {r["reason"]: (r["n_rows"], r["n_units"]) for r in left_out(panel, "y", "unit", "t", "g", ["x1"]).collect()}
    assert got == {"treated in the first month": (8, 1), "missing value": (3, 1)}
    none = left_out(panel.limit(0), "y", "unit", "t", "g", design=Design.of(range(1, 9), [5, 7])).collect()
    assert [(r["n_rows"], r["n_units"]) for r in none] == [(0, 0), (0, 0)]


def test_a_repeated_month_does_not_make_up_for_a_missing_one(spark):
    pdf, _ = make_panel(spark)
    broken = pd.concat([pdf.drop(index=3), pdf.iloc[[9]]])
    df = spark.createDataFrame(broken)
    keys = ("y", "unit", "t", "g", ["x1", "x2"])
    got = as_dict(att_gt(df, *keys))
    cross = as_dict(att_gt(df, *keys, panel_mode="cross_section"))
    assert got and all(math.isclose(got[k]["att"], cross[k]["att"]) for k in got)
    with pytest.raises(ValueError, match="1 rows repeat"):
        att_gt(df, *keys, panel_mode="panel")
    for covariates in (["x1"], []):
        with pytest.raises(ValueError, match="1 rows repeat"):
            estimate(df, *keys[:4], covariates, draws=10)


def test_covariates_that_change_are_refused(spark):
    _, df = make_panel(spark)
    moving = df.withColumn("x1", F.when((F.col("unit") == 4) & (F.col("t") == 2), 9.0).otherwise(F.col("x1")))
    with pytest.raises(ValueError, match="change over time in 1 units"):
        att_gt(moving, "y", "unit", "t", "g", ["x1"])
    in_two = df.withColumn("g", F.when((F.col("unit") == 4) & (F.col("t") == 2), 7).otherwise(5).cast("long"))
    in_two = df.where("unit <> 4").unionByName(in_two.where("unit = 4"))
    with pytest.raises(ValueError, match="change over time in 1 units"):
        att_gt(in_two, "y", "unit", "t", "g", ["x1"])


def test_singular_covariates_give_a_note(spark):
    pdf, _ = make_panel(spark, noise=1.0)
    pdf["x3"] = pdf["x1"] * 2
    panel = spark.createDataFrame(pdf)
    for r in att_gt(panel, "y", "unit", "t", "g", ["x1", "x3"]).collect():
        assert r["att"] is None and r["note"]


def test_compare_models(spark):
    _, panel = make_panel(spark, noise=1.0)
    models = compare(
        {"plain": att_gt(panel, "y", "unit", "t", "g"), "never": att_gt(panel, "y", "unit", "t", "g", control="nevertreated")}
    )
    assert models.groupBy("model").count().count() == 2


def test_tail_probabilities():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert f_tail(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
