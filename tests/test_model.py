import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.operators import model
from millwatch.operators.linear import fit_windows, pack_windows, solve_normal
from millwatch.operators.inspection import FEATURES
from millwatch.operators.risk import ROUNDS, RiskModel, best_round, bin_limits, risk_score, risk_train
from millwatch.operators.snapshots import asof_snapshot
from millwatch.operators.train_hook import train_hook
from millwatch.plans.monitor import Settings, fit_models, score_rows, windowed_snapshots
from millwatch.session import stage
from millwatch.sources.models import model_load, model_save
from tests.conftest import config_row, config_table, readings_table

STAGED = Settings()


def snapshots(spark, **columns):
    tags = list(columns)
    rows = list(zip(*columns.values()))
    data = [("m1", i, [None if v is None else float(v) for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "equipment_id string, tick bigint, values array<double>")
    return df, config_table(spark, config_row(tags=tags))


@pytest.mark.parametrize(
    "values,kind",
    [([1, 1, 0, 1], "binary"), ([0, None, 1, 0], "binary"), ([0.5, 1.0], "continuous"), ([0, 0, 0], "continuous"),
     ([1], "continuous"), ([None], "continuous"), ([-1, 0, 1], "continuous"), ([0, 1, 0.5], "continuous")],
)
def test_tag_types(spark, values, kind):
    rows, config = snapshots(spark, a=values)
    assert model.detect_tag_types(rows, config).first()["tag_type"] == kind


@pytest.mark.parametrize("values,mean,std", [([1, 3, 8], 4, 2.943920), ([9, 9, 9], 9, 1), ([None], 0, 1), ([-2, None], -2, 1)])
def test_normalization(spark, values, mean, std):
    rows, config = snapshots(spark, b=values)
    got = model.normalization_stats(rows, config).first()
    assert got["mean"] == mean and abs(got["std"] - std) < 1e-6


def test_binary_tags_have_no_normalization_and_ghosts_are_named(spark):
    rows, config = snapshots(spark, a=[0, 1, 0], b=[1, 2, 3], ghost=[None] * 3)
    assert {r["tag"] for r in model.normalization_stats(rows, config).collect()} == {"b", "ghost"}
    assert [r["tag"] for r in model.never_observed_tags(rows, config).collect()] == ["ghost"]
    split = model.dtype_partition(model.detect_tag_types(rows, config), config).first()
    assert (split["continuous"], split["binary"]) == ([1, 2], [0])


def series(spark, a, b, window=3):
    rows = [("m1", t, i, float(v)) for i, pair in enumerate(zip(a, b)) for t, v in zip("ab", pair)]
    config = config_table(spark, config_row(window=window))
    return stage(windowed_snapshots(readings_table(spark, rows), config, STAGED), "series"), config


def trained(rows):
    return rows.withColumns({"model_version": F.lit(0).cast("long"), "fit": F.col("usable")})


def test_forecast_and_errors_by_hand(spark):
    rng = np.random.default_rng(3)
    a = (np.arange(40) % 3 == 0).astype(float)
    b = np.cumsum(rng.normal(size=40))
    rows, config = series(spark, a, b)
    fitted = fit_models(trained(rows), config).first()
    assert fitted["tag_type"] == ["binary", "continuous"] and fitted["window_size"] == 3
    z = (b - b.mean()) / b.std()
    slope, offset = np.polyfit(z[2:-1], z[3:], 1)
    assert np.allclose([fitted["slope"][1], fitted["offset"][1]], [slope, offset])
    # On a 0/1 tag the line is the pair of conditional frequencies.
    x, y = a[2:-1], a[3:]
    assert np.isclose(fitted["offset"][0], y[x == 0].mean())
    assert np.isclose(fitted["offset"][0] + fitted["slope"][0], y[x == 1].mean())
    errors = np.abs(z[3:] - (offset + slope * z[2:-1]))
    assert np.isclose(fitted["err_mean"][1], errors.mean())
    assert np.isclose(fitted["err_std"][1], max(errors.std(), 1e-3, 0.05 * errors.mean()))


def whole_window(z, at, window):
    """Regressors of the window-wide forecaster, built row by row."""
    return np.array([np.concatenate([[1.0], *(z[t - lag] for lag in range(1, window + 1))]) for t in at])


def test_linear_forecaster_equals_least_squares_and_scores(spark, tmp_path):
    rng = np.random.default_rng(8)
    a = rng.normal(size=90)
    b = np.concatenate([[0.0] * 3, 2 * a[:-3]]) + 0.01 * rng.normal(size=90)
    rows, config = series(spark, a, b)
    training = trained(rows)
    norm = stage(model.pack_model(model.fit_forecaster(training)), "norm")
    z = np.column_stack([(v - v.mean()) / v.std() for v in (a, b)])
    want = np.linalg.lstsq(whole_window(z, range(3, 90), 3), z[3:], rcond=None)[0].T
    # Small buckets: the sums of several tasks must add up.
    for size in (16, 1, 4096):
        got = fit_windows(training, norm, size=size)[0].first()
        assert got["n_windows"] == 87 and np.allclose(np.array(got["coef"]), want, atol=1e-9)
    linear = fit_models(training, config, "linear", size=16)
    line = fit_models(training, config)
    # b follows a by three ticks, which only the forecaster that sees the whole window can use.
    assert linear.first()["err_mean"][1] < 0.1 * line.first()["err_mean"][1]
    model_save(linear, str(tmp_path / "linear"))
    stored = model_load(spark, str(tmp_path / "linear"), linear=True)
    everything = training.withColumn("target", F.col("usable"))
    scores = score_rows(everything, stored, config, size=16).toPandas()
    errors = np.abs(z[3:] - whole_window(z, range(3, 90), 3) @ want.T)
    spread = np.maximum(errors.std(axis=0), np.maximum(1e-3, 0.05 * errors.mean(axis=0)))
    assert np.allclose(scores.sort_values("tick").anomaly_score, ((errors - errors.mean(axis=0)) / spread).max(axis=1))
    with pytest.raises(ValueError):
        fit_models(training, config, "cubic")
    with pytest.raises(ValueError):
        score_rows(training.filter("usable"), stored, config)


def test_windows_with_gaps_still_give_the_exact_equations(spark):
    """Missing values leave runs of usable ticks of any length; sums near their ends are corrected, also across buckets."""
    rng = np.random.default_rng(3)
    n, window = 140, 4
    values = rng.normal(size=(n, 3)).cumsum(axis=0)
    holes = set(rng.choice(n, 9, replace=False).tolist())
    data = [("m1", t, t, [None, 1.0, 2.0] if t in holes else values[t].tolist(), window, 0) for t in range(n)]
    usable = [t for t in range(window, n) if not holes & set(range(t - window, t + 1))]
    schema = "equipment_id string, seq bigint, tick bigint, values array<double>, window_size int, model_version bigint"
    rows = spark.createDataFrame(data, schema).withColumns({"fit": F.col("seq").isin(usable), "prev": F.lit(None).cast("array<double>")})
    good = values[[t for t in range(n) if t not in holes]]
    norm = spark.createDataFrame([("m1", 0, ["continuous"] * 3, good.mean(0).tolist(), good.std(0).tolist())], "equipment_id string, model_version bigint, tag_type array<string>, norm_mean array<double>, norm_std array<double>")
    z = (values - good.mean(0)) / good.std(0)
    x = whole_window(z, usable, window)
    want = np.linalg.lstsq(x, z[usable], rcond=None)[0].T
    for size in (5, 32, 1000):
        got = np.array(fit_windows(rows, norm, size=size)[0].first()["coef"])
        residual = z[usable] - x @ got.T
        assert np.abs(x.T @ residual).max() < 1e-8 * len(usable) and np.allclose(got, want, atol=1e-6)


def logits(spark, y, size=64, window=2):
    """Logit weights of a binary tag beside a continuous one, and the regressors they belong to."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=len(y))
    rows, config = series(spark, a, y, window=window)
    training = trained(rows)
    fitted = fit_models(training, config, "linear", size=size).first()
    z = np.column_stack([(a - a.mean()) / a.std(), y])
    return np.array(fitted["coef"])[1], whole_window(z, range(window, len(y)), window), np.array(y, float)[window:], fitted


def test_logit_gradients_vanish(spark):
    rng = np.random.default_rng(1)
    y = [0.0, 1.0]
    for _ in range(300):
        y.append(float(rng.random() < (0.85 if y[-1] else 0.2)))
    for size in (64, 4096):
        beta, x, target, fitted = logits(spark, y, size)
        p = 1 / (1 + np.exp(-x @ beta))
        assert np.abs(x.T @ (target - p)).max() < 1e-6 * len(target) and fitted["tag_type"][1] == "binary"
        assert np.isclose(fitted["err_mean"][1], np.abs(target - p).mean()) and fitted["err_mean"][1] < 0.45


def test_logits_of_separable_and_constant_tags_are_finite(spark):
    beta, x, target, fitted = logits(spark, [float(i % 2) for i in range(40)])
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.isfinite(beta).all() and np.abs(target - p).max() < 0.01
    # One among the samples, but never among the targets.
    beta, x, target, _ = logits(spark, [1.0] + [0.0] * 40)
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.isfinite(beta).all() and target.sum() == 0 and p.max() < 0.01


def test_a_model_of_one_block_is_fitted_without_rounds(spark, monkeypatch):
    """Its sums are those of one block, so no round of its logits is written out; the weights are those of many small blocks."""
    rng = np.random.default_rng(2)
    y = (rng.random(120) < 0.4).astype(float)
    rows, config = series(spark, rng.normal(size=120), y)
    training = trained(rows)
    norm = stage(model.pack_model(model.fit_forecaster(training)), "norm")
    found = {}
    for size in (4096, 16):
        written = []
        monkeypatch.setattr("millwatch.operators.linear.stage", lambda df, name: written.append(name) or stage(df, name))
        fitted = fit_windows(training, norm, size=size)[0].first()
        found[size] = np.array(fitted["coef"])
        assert fitted["n_windows"] == 117 and any(n.startswith("logits") for n in written) == (size == 16)
    assert np.allclose(found[4096], found[16], atol=1e-9)


def test_equations_of_dependent_columns_have_a_solution():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    x = np.column_stack([np.ones(50), x, x[:, 0] * 2, np.full(50, 3.0)])
    y = rng.normal(size=(50, 2))
    got = solve_normal(x.T @ x, x.T @ y)
    assert np.abs(x.T @ (y - x @ got)).max() < 1e-8 and got[4].tolist() == [0.0, 0.0]


def test_window_scores_reach_back_over_states(spark):
    """The first rows under a model are forecast from snapshots of the time before it."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 60))
    rows, config = series(spark, a, b)
    training = trained(rows.filter("seq < 40"))
    models = fit_models(training, config, "linear")
    live = rows.withColumn("model_version", F.when(F.col("seq") >= 40, F.lit(0)).cast("long")).withColumn("target", F.col("seq") >= 40)
    scores = score_rows(live, models, config, size=8)
    assert scores.count() == 20 and scores.select("tick").distinct().count() == 20
    assert pack_windows(live.filter("seq < 40"), 8).isEmpty()


def test_constant_tag_is_forecast_by_its_mean(spark):
    rows, config = series(spark, [5.0] * 12, np.arange(12.0))
    fitted = fit_models(trained(rows), config).first()
    assert fitted["slope"][0] == 0 and fitted["offset"][0] == 0 and fitted["err_std"][0] == 1e-3


def test_an_exact_forecast_has_no_error(spark):
    rng = np.random.default_rng(5)
    held = rng.integers(100, 9000, (41, 4)) / 100
    data = [("m1", 0, i, row, row, True) for i, row in enumerate(held.tolist())]
    rows = spark.createDataFrame(data, "equipment_id string, model_version bigint, tick bigint, values array<double>, prev array<double>, fit boolean")
    config = config_table(spark, config_row(tags=["a", "b", "c", "d"]))
    scored = score_rows(rows, fit_models(rows, config), config).collect()
    assert len(scored) == 41 and {(r["anomaly_score"], r["top_deviant_tag"]) for r in scored} == {(0.0, "a")}


def test_outlier_gets_the_top_score_and_stored_models_score_alike(spark, tmp_path):
    b = np.sin(np.arange(60) / 3.0)
    rows, config = series(spark, np.arange(60) % 2, b)
    models = fit_models(trained(rows), config)
    bad = b.copy()
    bad[50] = 30
    live = trained(series(spark, np.arange(60) % 2, bad)[0]).filter("usable")
    scores = score_rows(live, models, config).orderBy(F.desc("anomaly_score")).collect()
    assert scores[0]["top_deviant_tag"] == "b" and scores[0]["anomaly_score"] > 50
    model_save(models, str(tmp_path / "models"))
    model_save(models.withColumn("model_version", F.lit(-1).cast("long")), str(tmp_path / "models"))
    assert model_load(spark, str(tmp_path / "models"), newest=False).count() == 2
    scores = sorted(scores, key=lambda r: r["tick"])
    again = score_rows(live, model_load(spark, str(tmp_path / "models")), config).orderBy("tick").collect()
    assert [(r["tick"], r["top_deviant_tag"]) for r in again] == [(r["tick"], r["top_deviant_tag"]) for r in scores]
    # The unsaved model is fitted anew, so sums may differ in the last digit.
    assert np.allclose([r["anomaly_score"] for r in again], [r["anomaly_score"] for r in scores], rtol=1e-9)


def test_train_hook_sees_the_whole_history_in_order_and_never_a_whole_machine(spark):
    rows = [("m1", "a", i, float(i % 7)) for i in range(50)] + [("m2", "a", 0, 1.0)]
    snaps = asof_snapshot(readings_table(spark, rows), config_table(spark, config_row("m1"), config_row("m2")), 8)

    def partial(group):
        levels = [v[0] for v in group["values"]]
        steps = sum(abs(a - b) for a, b in zip(levels, levels[1:]))
        return group.head(1)[["equipment_id"]].assign(n=len(group), most=len(group), first=levels[0], last=levels[-1], steps=float(steps))

    def merge(parts):
        gaps = sum(abs(a - b) for a, b in zip(parts["last"][:-1], parts["first"][1:]))
        one = parts.head(1)[["equipment_id", "first"]]
        return one.assign(n=parts["n"].sum(), most=parts["most"].max(), last=parts["last"].iloc[-1], steps=parts["steps"].sum() + gaps)

    partials = "equipment_id string, n long, most long, first double, last double, steps double"
    got = train_hook(snaps, partial, partials, merge, lambda r: r[["equipment_id", "n", "most", "steps"]], "equipment_id string, n long, most long, steps double", size=8)
    levels = [i % 7 for i in range(50)]
    walked = float(sum(abs(a - b) for a, b in zip(levels, levels[1:])))
    found = {r["equipment_id"]: r for r in got.collect()}
    assert (found["m1"]["n"], found["m1"]["steps"], found["m1"]["most"] <= 8) == (50, walked, True)
    assert (found["m2"]["n"], found["m2"]["steps"]) == (1, 0.0)


def test_scores_follow_tags_not_positions(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [("m1", t, i, float(rng.normal(5 * k, 1 + k))) for i in range(60) for k, t in enumerate("ab")]
    scores = {}
    for order in (("a", "b"), ("b", "a")):
        config = config_table(spark, config_row("m1", order, window=3))
        training = trained(stage(windowed_snapshots(readings_table(spark, rows), config, STAGED), "series"))
        if not scores:
            path = str(tmp_path / "models")
            for _ in range(2):  # a repeated save is one model
                model_save(fit_models(training, config), path)
            linear = str(tmp_path / "linear")
            model_save(fit_models(training, config, "linear"), linear)
        for kind in (path, linear):
            models = model_load(spark, kind, newest=False, linear=kind == linear)
            assert models.count() == 1
            got = score_rows(training.withColumn("target", F.col("usable")), models, config).orderBy("tick").collect()
            scores.setdefault(kind, []).append([(r["tick"], round(r["anomaly_score"], 9), r["top_deviant_tag"]) for r in got])
    for first, second in scores.values():
        assert first == second and len(first) == 57
    for other in (config_row("m1", ("a", "b"), window=4), config_row("m1", ("a", "b", "c"), window=3)):
        assert score_rows(training.withColumn("target", F.col("usable")), models, config_table(spark, other)).isEmpty()


@pytest.fixture(scope="module")
def risk_rows(spark):
    from millwatch.operators.inspection import ml_feature_table
    from tests.test_inspection import minutes

    return stage(ml_feature_table(minutes(spark, {m: (3 if m % 240 < 60 else 0) for m in range(4000)})), "risk-rows")


def test_risk_model_learns_and_survives_storage(spark, risk_rows, tmp_path):
    """A stored model gives the same risks; its splits, applied by SQL, give them too."""
    import duckdb

    fitted = risk_train(risk_rows, rounds=8, step=0.3)
    assert fitted.report_auc > 0.75 and fitted.scale_pos_weight > 0
    fitted.save(spark, str(tmp_path / "risk"))
    loaded = RiskModel.load(spark, str(tmp_path / "risk"))
    assert (loaded.report_auc, loaded.scale_pos_weight, len(loaded.trees)) == (fitted.report_auc, fitted.scale_pos_weight, len(fitted.trees))
    scored = risk_score(loaded, risk_rows).toPandas()
    assert scored["risk"].equals(risk_score(fitted, risk_rows).toPandas()["risk"])
    assert (scored["alarm"] == (scored["risk"] >= 0.6)).all() and scored["alarm"].any() and not scored["alarm"].all()
    nodes = fitted.nodes(spark).toPandas()  # noqa: F841
    names = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
    want = duckdb.sql(f"""WITH RECURSIVE walk AS (
        SELECT minute, tree, 1 AS node, [{", ".join(f"{f}::DOUBLE" for f in FEATURES)}] AS x FROM scored, (SELECT DISTINCT tree FROM nodes)
        UNION ALL SELECT minute, tree, 2 * w.node + CAST(x[list_position({names}, feature)] > cut AS INTEGER), x
        FROM walk w JOIN nodes USING (tree, node) WHERE feature IS NOT NULL)
      SELECT minute, 1 / (1 + exp(-sum(value))) AS risk FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY 1 ORDER BY 1""").df()
    assert np.allclose(want["risk"], scored.sort_values("minute")["risk"], rtol=0, atol=1e-12)


def test_report_auc_is_that_of_its_risks(spark, risk_rows):
    fitted = risk_train(risk_rows, rounds=8, step=0.3)
    rows = risk_score(fitted, risk_rows).where("part = 'test'").toPandas()
    up, down = (rows.loc[rows["target"] == side, "risk"].to_numpy()[:, None] for side in (1, 0))
    brute = (up > down.T).mean() + (up == down.T).mean() / 2
    assert abs(brute - fitted.report_auc) < 1e-3


def test_bins_are_cut_at_exact_ranks(spark):
    n = 400_003
    mixed = F.col("id") * 7919 % n
    values = [mixed, mixed % 1000, F.when(mixed % 3 == 0, mixed), F.lit(4), F.lit(None), mixed % 40 - 20]
    rows = spark.range(n).select(*(v.cast("double").alias(f) for f, v in zip(FEATURES, values)))
    plain = np.arange(n)
    want = [plain, np.sort(plain % 1000), plain[::3], np.full(n, 4), plain[:0], np.sort(plain % 40 - 20)]
    assert bin_limits(rows) == [sorted({float(v[-(-len(v) * k // 64) - 1]) for k in range(1, 64)}) if len(v) else [] for v in want]


def test_trees_do_not_depend_on_the_slice(risk_rows):
    some, other = (risk_train(risk_rows, rounds=5, step=0.3, slice_rounds=n) for n in (1, 4))
    assert len(some.grown) == len(other.grown) == 5 and len(some.trees) == len(other.trees)
    for a, b in zip(some.grown, other.grown):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_trees_keep_to_their_limits(risk_rows):
    from millwatch.operators.risk import NODES, Tree, _limit_leaves

    for tree in risk_train(risk_rows, rounds=3, step=0.3).grown:
        leaves = (tree.feature < 0) & (tree.n_rows > 0)
        assert leaves.sum() <= 31 and (tree.n_rows[leaves] >= 20).all() and tree.n_rows[leaves].sum() == tree.n_rows[1]
    full = Tree(np.where(np.arange(NODES) < 32, 0, -1), np.ones(NODES), np.ones(NODES, np.int64), np.ones(NODES))
    full.feature[0] = -1
    gains = np.arange(NODES, 0, -1).astype(float)
    _limit_leaves(full, gains)
    assert (full.feature >= 0).sum() == 30 and full.feature[31] == -1 and not full.n_rows[[62, 63]].any()


def test_risk_of_missing_rows_and_targets(spark, risk_rows):
    empty = risk_train(risk_rows.where("false"))
    assert (empty.trees, empty.report_auc) == ((), 0.5)
    assert {r["risk"] for r in risk_score(empty, risk_rows.limit(3)).collect()} == {0.5}
    for side in (0, 1):  # one class only
        alone = risk_train(risk_rows.withColumn("target", F.lit(side)), rounds=2)
        assert alone.report_auc == 0.5 and all(0 <= r["risk"] <= 1 for r in risk_score(alone, risk_rows.limit(3)).collect())
    fitted = risk_train(risk_rows.withColumn("target", F.when(F.col("minute") % 2 == 0, F.col("target"))), rounds=1)
    part = risk_rows.where("part = 'train' AND minute % 2 = 0").count()
    assert fitted.grown[0].n_rows[1] < part
    gap = risk_rows.limit(1).withColumn("ng_sum_30", F.lit(None).cast("double"))
    assert 0 < risk_score(fitted, gap).first()["risk"] < 1


def test_boosting_waits_out_idle_rounds():
    assert best_round([0.5, 0.6, 0.55, 0.56, 0.7, 0.6, 0.6, 0.6, 0.9], patience=3) == (5, True)
    assert best_round([0.5, 0.6, 0.55, 0.55], patience=3) == (2, False)
    assert best_round([], patience=3) == (0, False)


def test_boosting_goes_on_past_idle_stretches(monkeypatch):
    """An AUC that peaks at round 130 is followed there, each round grown once, and not to the last round allowed."""
    from inspect import signature
    from types import SimpleNamespace

    from millwatch.operators import risk

    areas = iter([0.9 - (0.4 if 50 <= k < 80 else abs(k - 129) / 1000) for k in range(ROUNDS)])
    classes = SimpleNamespace(where=lambda condition: None)
    monkeypatch.setattr(risk, "_grown", lambda *given: "tree")
    monkeypatch.setattr(risk, "_moved", lambda given, trees: given)
    monkeypatch.setattr(risk, "stage", lambda given, name: given)
    monkeypatch.setattr(risk, "_packed", lambda given: given)
    monkeypatch.setattr(risk, "round_areas", lambda given, trees: [next(areas) for _ in trees])
    grown, best = risk.boosted(classes, 1.0, signature(risk_train).parameters["rounds"].default, 0.03)
    assert best == 130 and 170 <= len(grown) < 130 + 40 + risk.SLICE < ROUNDS == 1000
