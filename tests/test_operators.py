import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import schema
from kinelake.functions import nanops, scalar
from kinelake.operators import alignment, evaluation, labels, navigation, sequences, splits


def test_nan_rules(spark):
    rows = spark.createDataFrame([(float("nan"),), (2.0,), (None,), (float("inf"),)], "x double")
    got = rows.select(nanops.gt("x", 1.0).alias("g"), nanops.finite("x").alias("f")).collect()
    assert [(r["g"], r["f"]) for r in got] == [(False, False), (True, True), (None, False), (True, False)]
    assert rows.agg(F.sum(nanops.known(F.when(F.col("x") < 1e9, F.col("x")))).alias("s")).first()["s"] == 2.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(nanops.moment_corr("x", "y").alias("c")).first()["c"] is None


def test_scalars(spark):
    one = spark.createDataFrame([("16 / 18", " Height (km)°  x ", 350.0, 10.0, "ab", "1.3.0")], "s string, h string, a double, b double, id string, v string")
    r = one.select(scalar.satellites("s").alias("s"), scalar.header_key("h").alias("h"), scalar.angle_gap_deg("a", "b").alias("g"), scalar.holdout_bucket("id").alias("k"), scalar.semver_at_least("v", "1.2.9").alias("v"), scalar.normal_cdf(F.lit(1.0)).alias("n"), scalar.epoch_ms(F.lit(2_500_000), F.lit(0), F.lit(7)).alias("m")).first()
    assert (r["s"], r["h"], r["g"], r["v"], r["m"]) == (16.0, "height (km) x", 20.0, True, 9)
    assert r["k"] == int.from_bytes(b"ab", "little") % 1000 and r["n"] == pytest.approx(0.8413447, abs=1e-6)


def sequence(spark, values, name="v", seq="a"):
    return spark.createDataFrame([(seq, i, float(v)) for i, v in enumerate(values)], f"seq_id string, row_idx long, {name} double")


def test_segments_partition_the_rows_and_windows_keep_off_edges(spark):
    t = [i * 100.0 for i in range(300)] + [40_000.0 + i * 100 for i in range(250)] + [60_000.0]
    segs = sequences.segments(sequences.with_breaks(sequence(spark, t, "t_ms"), {"t_ms": 1.0})).orderBy("start")
    assert [(r["start"], r["stop"]) for r in segs.collect()] == [(0, 300), (300, 550), (550, 551)]
    windows = sequences.sliding_windows(segs)
    starts = sorted(r["start"] for r in windows.collect())
    assert starts == [*range(100, 181, 5), *range(400, 431, 5)]
    assert sequences.window_counts(segs).first()["n_windows"] == len(starts)


def test_gradient_and_rolling_std_equal_numpy(spark):
    v = np.random.default_rng(0).normal(size=40)
    rows = sequences.centred_std(sequences.gradient(sequence(spark, v), "v", 10.0), "v").orderBy("row_idx").collect()
    assert np.allclose([r["gradient"] for r in rows], np.gradient(v) * 10)
    for i, r in enumerate(rows):
        if 5 <= i < 36:
            assert r["rolling_std"] == pytest.approx(np.std(v[i - 5 : i + 5], ddof=1))
        else:
            assert r["rolling_std"] is None


def test_held_values(spark):
    windows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0)], "seq_id string, window long, w double")
    got = sequences.held(sequence(spark, range(10)), windows, "w", F.lit(10.0), F.lit(3)).orderBy("row_idx").collect()
    assert [r["w"] for r in got] == [float(min(int(i / (10 / 3)), 2) + 1) for i in range(10)]


def test_straight_northbound_drive(spark):
    lat = [53.0 + i * 1.5 / scalar.EARTH_RADIUS_M * 180 / np.pi for i in range(600)]
    points = spark.createDataFrame([("k", i, la, -1.0) for i, la in enumerate(lat)], "key string, i long, lat double, lon double")
    enu = navigation.local_enu(points, "lat", "lon")
    assert navigation.path_length(enu).first()["length_m"] == pytest.approx(1.5 * 599, rel=1e-9)
    steps = spark.range(599).select(F.lit("k").alias("key"), F.col("id").alias("i"), F.lit(15.0).alias("v"))
    dr = navigation.dead_reckon(steps, F.col("v"), F.lit(0.0), 0.1)
    pairs = dr.select("key", "i", F.col("east_m").alias("pe"), F.col("north_m").alias("pn")).join(enu.select("key", "i", F.col("east_m").alias("te"), F.col("north_m").alias("tn")), ["key", "i"])
    score = evaluation.score_outages(pairs).first()
    assert score["final_error_m"] < 1e-6 and score["ate_m"] < 1e-6 and score["cte_max_m"] < 1e-6 and score["drift_pct"] < 1e-6
    assert len(score["error_growth_m"]) == 60


def test_rigid_alignment_recovers_a_turn(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(50, 2)) * 100
    c, s = np.cos(0.7), np.sin(0.7)
    t = p @ np.array([[c, s], [-s, c]]) + [5, -3]
    pairs = spark.createDataFrame([("k", i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, t, strict=True))], "key string, i long, pe double, pn double, te double, tn double")
    fit = navigation.rigid_align(pairs).first()
    assert (fit["theta"], fit["de"], fit["dn"]) == pytest.approx((0.7, 5.0, -3.0))
    headings = spark.createDataFrame([("k", 3.1, -3.1)], "key string, pred_heading_rad double, true_heading_rad double")
    score = evaluation.score_outages(pairs, headings).first()
    assert score["ate_m"] < 1e-6 and score["heading_error_deg"] == pytest.approx(np.degrees(2 * np.pi - 6.2))


def test_error_growth_repeats_the_last_of_a_full_second(spark):
    rows = [("k", i, float(i), 0.0, 0.0, float(i)) for i in range(20)]
    pairs = spark.createDataFrame(rows, "key string, i long, pe double, pn double, te double, tn double")
    growth = evaluation.score_outages(pairs).first()["error_growth_m"]
    assert growth == pytest.approx([np.hypot(10, 10), np.hypot(19, 19)])


def test_low_pass_and_window_filter(spark):
    got = [r["smoothed"] for r in navigation.low_pass(sequence(spark, [1.0, 2.0, 3.0]), "v").orderBy("row_idx").collect()]
    assert got == pytest.approx([1.0, 1.2, 1.56])
    windows = spark.createDataFrame([("k", i, 10.0, -3.0, 10.0) for i in range(20)], "key string, i long, mean double, logvar double, v0 double")
    last = navigation.window_filter(windows).orderBy(F.desc("i")).first()
    assert last["speed"] == pytest.approx(10.0) and last["accel"] == pytest.approx(0.0)


def test_regressions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.3 * rng.normal(size=400)
    rows = spark.createDataFrame([("a", *map(float, (*a, b))) for a, b in zip(x, y, strict=True)], "seq_id string, a double, b double, c double, y double")
    a = np.c_[x, np.ones(400)]
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    want = 1 - ((y - a @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert labels.regression_r2(rows, "y", ("a", "b", "c")).first()["r2"] == pytest.approx(want)
    assert labels.regression_r2(rows.limit(100), "y", ("a", "b", "c")).first()["r2"] is None
    slope = labels.origin_slope(rows, "a", "y", "seq_id").first()
    assert slope["slope"] == pytest.approx((x[:, 0] * y).sum() / (x[:, 0] ** 2).sum()) and slope["spread"] == 0


def test_usability_ladder(spark):
    rows = spark.createDataFrame([(None, None, None, 0.01), (0.4, None, None, 0.5), (0.25, 0.1, 0.9, 0.5), (0.1, 0.55, 0.9, 0.5), (0.4, 0.9, 0.2, 0.5), (None, None, None, 0.5)], "v double, r double, s double, m double")
    assert [r[0] for r in rows.select(labels.usability("v", "r", "s", "m")).collect()] == ["drop", "use", "weak", "use", "drop", "drop"]


def test_scenarios(spark):
    def made(key, speed, yaw, acc):
        return [(key, i, float(speed(i)), float(yaw(i)), float(acc(i))) for i in range(300)]

    rows = made("stop", lambda i: 0.5 if i == 5 else 10, lambda i: 0, lambda i: 0) + made("brake", lambda i: 10, lambda i: 0, lambda i: -4 if i == 9 else 0) + made("corner", lambda i: 10, lambda i: 0.5 if i == 3 else 0, lambda i: 0)
    rows += made("round", lambda i: 5 if 100 < i < 200 else 12, lambda i: 0.2 if 100 < i < 200 else 0, lambda i: 0) + made("motorway", lambda i: 30, lambda i: 0.01, lambda i: 0) + made("town", lambda i: 12, lambda i: 0.01, lambda i: 0)
    frame = spark.createDataFrame(rows, "key string, i long, v double, w double, a double")
    got = {r["key"]: r["scenario"] for r in evaluation.scenario(frame, "v", "w", "a").collect()}
    assert got == {"stop": "stop_start", "brake": "hard_braking", "corner": "sharp_cornering", "round": "roundabout", "motorway": "motorway_cruise", "town": "urban"}


def test_calibration_of_known_sigmas(spark):
    rng = np.random.default_rng(3)
    logvar = rng.uniform(-2, 2, 6109)
    y = rng.normal(size=6109) * np.exp(logvar / 2) * 2
    rows = spark.createDataFrame([(i, float(a), 0.0, float(b)) for i, (a, b) in enumerate(zip(y, logvar, strict=True))], "id long, y double, mu double, logvar double")
    binned = evaluation.calibration_bins(rows).orderBy("bin").collect()
    assert [r["n"] for r in binned] == [len(x) for x in np.split(np.arange(6109), np.linspace(0, 6109, 11).astype(int)[1:-1])]
    fit = evaluation.fit_temperature(rows).first()
    assert fit["temperature"] == pytest.approx(2.0, rel=0.05)
    better = rows.withColumn("logvar", evaluation.tempered(F.col("logvar"), fit["temperature"]))
    ks = [evaluation.pit_ks(r).first()["pit_ks"] for r in (rows, better)]
    assert ks[1] < 0.03 < ks[0]
    cover = {r["k"]: (r["covered"], r["expected"]) for r in evaluation.coverage(better).collect()}
    assert cover[1.0][0] == pytest.approx(cover[1.0][1], abs=0.03)
    knots = evaluation.isotonic_knots(rows)
    assert all(a[1] <= b[1] for a, b in zip(knots, knots[1:], strict=False))


def test_yaw_search_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 300))
    ref = np.cos(-2.0) * x + np.sin(-2.0) * y + 0.1 * rng.normal(size=300)
    rows = spark.createDataFrame([("a", *map(float, r)) for r in zip(x, y, ref, strict=True)] + [("b", 1.0, 1.0, 1.0)], "seq_id string, x double, y double, r double")
    angles = np.linspace(-np.pi, np.pi, 72, endpoint=False)
    scores = [np.corrcoef(np.cos(t) * x + np.sin(t) * y, ref)[0, 1] for t in angles]
    got = {r["seq_id"]: r for r in alignment.yaw_search(rows, "x", "y", "r").collect()}
    assert got["a"]["yaw_deg"] == pytest.approx(np.degrees(angles[int(np.argmax(scores))])) and got["a"]["score"] == pytest.approx(max(scores))
    assert (got["b"]["yaw_deg"], got["b"]["score"]) == (0.0, None)


def test_levelling(spark):
    rows = spark.createDataFrame([("a", 0.3 + 1, 0.2, 9.8, 0.3, 0.2, 9.8), ("u", 0.0, 0.0, 10.8, 0.0, 0.0, 9.8)], "seq_id string, ax double, ay double, az double, gx double, gy double, gz double")
    got = {r["seq_id"]: r for r in alignment.levelled(rows, ["ax", "ay", "az"], ["gx", "gy", "gz"]).collect()}
    a = got["a"]
    assert np.hypot(np.hypot(a["level_x"], a["level_y"]), a["level_z"]) == pytest.approx(1.0)
    assert got["u"]["level_z"] == pytest.approx(-1.0)


def test_splits(spark):
    seqs = spark.createDataFrame([("vfa02", "Vf"), ("vw03", "Vw"), ("q1", "Q"), ("vw01", "Vw")], "seq_id string, route_family string")
    got = {r["seq_id"]: r["split"] for r in splits.assign_splits(seqs, {"vfa02": "corridor", "vw01": "excluded"}, {"Vw": "train"}).collect()}
    assert got == {"vfa02": "corridor", "vw03": "train", "q1": "excluded", "vw01": "excluded"}
    roles = splits.assign_roles(seqs.withColumnRenamed("route_family", "family"), ["Vw"], ["Q"]).collect()
    for r in roles:
        out = r["family"] == "Vw" and int.from_bytes(r["seq_id"].encode(), "little") % 1000 < 250
        assert r["role"] == ("test_ood_region" if out else "pretrain" if r["family"] == "Q" else "heldout")
    assert schema.replay_schema()["timestamp_ms"].nullable is False


def test_quality_inputs_with_nan(spark):
    rows = spark.createDataFrame([("a", i, float("nan") if i % 5 == 0 else float(i), float(i)) for i in range(20)], "seq_id string, row_idx long, x double, y double")
    x = np.array([np.nan if i % 5 == 0 else i for i in range(20)])
    want = np.corrcoef(np.where(np.isnan(x), np.nanmean(x), x), np.arange(20))[0, 1]
    assert labels.corr_with_imputation(rows, {"c": ("x", "y")}).first()["c"] == pytest.approx(want)


def test_window_filter_runs_over_whole_sequences(spark):
    from kinelake.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = queries.kf_windows(spark, sf).orderBy("key", "i").collect()
    want = {}
    for r in rows:
        if r["i"] == 0:
            x, p = np.array([r["v0"], 0.0]), np.eye(2)
        step, noise = np.array([[1.0, 2.0], [0.0, 1.0]]), 0.36 * np.full((2, 2), 4.0)
        x, p = step @ x, step @ p @ step.T + noise
        gain = p[:, 0] / (p[0, 0] + np.exp(r["logvar"]) + 0.25)
        x, p = x + gain * (r["mean"] - x[0]), p - np.outer(gain, p[0])
        want[r["key"], r["i"]] = x
    got = {(r["key"], r["i"]): (r["speed"], r["accel"]) for r in queries.QUERIES["window_kf"](spark, sf).collect()}
    assert len(rows) == 1000 and max(i for _, i in got) > 12 and got.keys() == want.keys()
    for at, state in want.items():
        assert got[at] == pytest.approx(state.tolist(), abs=1e-4)
