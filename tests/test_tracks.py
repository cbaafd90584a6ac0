"""Inference, stateful streams, smoothing, routes, sampling, augmentation and constraints against plain forms."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.kernels import calibration, modes
from kinelake.kernels import network as layers
from kinelake.operators import augment, benchmark, constraints, features, filters, monitoring, network, remount, routes, sampling, sequences, smoothing
from kinelake.plans import model_queries

ALL_HEADS = ("mean", "logvar", "context", "yaw")


def slow_forward(w, x):
    """One window through the network by plain loops over rows, channels and taps."""
    rows, hidden = len(x), w["input.weight"].shape[1]
    h = [[sum(x[t][f] * w["input.weight"][f][c] for f in range(len(x[t]))) + w["input.bias"][c] for c in range(hidden)] for t in range(rows)]
    for i, d in enumerate((1, 2, 4)):
        after = []
        for t in range(rows):
            y = []
            for c in range(hidden):
                total = w[f"block{i}.bias"][c]
                for k in range(3):
                    at = t + (k - 1) * d
                    if 0 <= at < rows:
                        total += sum(h[at][a] * w[f"block{i}.weight"][k][a][c] for a in range(hidden))
                y.append(total)
            mean = sum(y) / hidden
            var = sum((v - mean) ** 2 for v in y) / hidden
            after.append([h[t][c] + max(0.0, (y[c] - mean) / math.sqrt(var + 1e-5) * w[f"block{i}.gain"][c] + w[f"block{i}.offset"][c]) for c in range(hidden)])
        h = after
    z = [sum(r[c] for r in h) / rows for c in range(hidden)]
    out = {}
    for head in ALL_HEADS:
        one = [max(0.0, sum(z[a] * w[f"{head}.weight0"][a][b] for a in range(hidden)) + w[f"{head}.bias0"][b]) for b in range(hidden // 2)]
        two = [sum(one[a] * w[f"{head}.weight1"][a][b] for a in range(hidden // 2)) + w[f"{head}.bias1"][b] for b in range(w[f"{head}.weight1"].shape[1])]
        out[head] = [math.log1p(math.exp(v)) for v in two] if head == "mean" else two
    return out


def test_network_equals_plain_loops(spark, tmp_path):
    weights = layers.random_weights(6, 40, ALL_HEADS, seed=3)
    assert sum(w.size for n, w in weights.items() if not n.startswith(("context", "yaw"))) == 16_722
    mean, std = (0.1, 0.2, -0.3, 0.0, 0.5, 1.0), (2.0, 1.0, 0.5, 1.0, 3.0, 1.0)
    folder = f"file://{tmp_path}/model"
    network.save_model(spark, network.Model(network.Contract(mean=mean, std=std), weights), folder)
    model = network.load_model(spark, folder)
    rng = np.random.default_rng(0)
    windows = rng.normal(size=(7, 20, 6))
    odd = [(100, None), (101, windows[0][:19].tolist()), (102, [r[:5] for r in windows[0].tolist()]), (103, [[float("nan")] * 6] * 20), (104, [[1.7e308] * 6] * 20), (105, []), (106, [None] * 20)]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(windows)] + odd, "id long, x array<array<double>>").repartition(3)
    got = {r["id"]: r for r in network.infer(table, model, ["id"]).collect()}
    w = {k: v.astype(float) for k, v in weights.items()}
    for i, x in enumerate(windows):
        want = slow_forward(w, ((x - mean) / std).tolist())
        r = got[i]
        assert r["refused"] is None
        assert r["velocity_mean_mps"] == pytest.approx(want["mean"][0], rel=1e-9) and r["velocity_variance"] == pytest.approx(math.exp(want["logvar"][0]), rel=1e-9)
        assert r["context_logits"] == pytest.approx(want["context"], rel=1e-9)
        assert r["yaw_increment_rad"] == pytest.approx(want["yaw"][0], rel=1e-9) and r["yaw_variance"] == pytest.approx(math.exp(want["yaw"][1]), rel=1e-9)
    assert [got[i]["refused"] for i in range(100, 107)] == ["null", "shape", "shape", "not finite", "outputs not finite", "shape", "shape"]
    assert all(got[i]["velocity_mean_mps"] is None and got[i]["context_logits"] is None for i in range(100, 107))


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"contract_version": "2.0.0"}, "not compatible"),
        ({"contract_version": "0.9.9"}, "not compatible"),
        ({"contract_version": "1.0"}, "not compatible"),
        ({"feature_order": features.FEATURES[::-1]}, "features"),
        ({"window_size_samples": 10}, "rows"),
        ({"sample_rate_hz": 100}, "rows a second"),
        ({"std": (1.0, 1.0, 0.0, 1.0, 1.0, 1.0)}, "positive"),
        ({"mean": (0.0,)}, "each feature"),
    ],
)
def test_a_wrong_contract_is_refused(change, said):
    weights = layers.random_weights(6, 8)
    with pytest.raises(network.ContractRefused, match=said):
        network.refuse(network.Contract(**change), weights)


def test_weights_that_dont_fit_are_refused_and_newer_contracts_run(spark, tmp_path):
    weights = layers.random_weights(6, 8)
    network.refuse(network.Contract(contract_version="1.4.2"), weights)
    for change, said in (({"mean.bias1": np.zeros(2, np.float32)}, "shape"), ({"block1.gain": np.full(8, np.nan, np.float32)}, "finite"), ({"more": np.zeros(1, np.float32)}, "unknown")):
        with pytest.raises(network.ContractRefused, match=said):
            network.refuse(network.Contract(), weights | change)
    with pytest.raises(network.ContractRefused, match="missing"):
        network.refuse(network.Contract(), {k: v for k, v in weights.items() if k != "logvar.weight0"})
    folder = f"file://{tmp_path}/old"
    network.save_model(spark, network.Model(network.Contract(contract_version="0.1.0"), weights), folder)
    with pytest.raises(network.ContractRefused, match="not compatible"):
        network.load_model(spark, folder)
    with pytest.raises(network.ContractRefused, match="no output"):
        network.Contract.from_manifest(network.Contract().manifest() | {"outputs": {"velocity_mean_mps": {}}})
    flat = {"contract_version": "1.0.0", "window_size_samples": "20", "sample_rate_hz": "10", "feature_order": ",".join(features.FEATURES), "norm_mean": "0,0,0,0,0,0", "norm_std": "1,1,1,1,1,1", "output_mean_name": "velocity_mean_mps", "output_logvar_name": "velocity_log_variance"}
    assert network.Contract.from_metadata(flat) == network.Contract()
    with pytest.raises(network.ContractRefused, match="norm_std"):
        network.Contract.from_metadata({k: v for k, v in flat.items() if k != "norm_std"})


def phone(n, key, turn, seed):
    """Samples of a phone tilted and turned in a car that speeds up and slows down."""
    rng = np.random.default_rng(seed)
    forward = np.sin(np.arange(n) / 7) + 0.1 * rng.normal(size=n)
    level = calibration.levelling(np.array([1.0, -2.0, -9.0]))
    c, s = math.cos(turn), math.sin(turn)
    car = np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) @ level
    linear = np.column_stack([forward, 0.05 * rng.normal(size=n), 0.05 * rng.normal(size=n)]) @ car
    gravity = np.array([1.0, -2.0, -9.0]) + 0.01 * rng.normal(size=(n, 3))
    reference = [float(f) if i % 11 else None for i, f in enumerate(forward)]
    return [(key, i * 100_000_000, *map(float, gravity[i]), *map(float, gravity[i] + linear[i]), reference[i]) for i in range(n)]


PHONE = "key string, ns long, grav_x double, grav_y double, grav_z double, acc_x double, acc_y double, acc_z double, ref double"
GRAVITY, ACCEL = ["grav_x", "grav_y", "grav_z"], ["acc_x", "acc_y", "acc_z"]


def test_moments_add_up_whatever_the_split():
    rows = np.array([[math.nan if v is None else v for v in r[2:]] for r in phone(300, "a", 1.0, 5)])
    rows[17, 0] = math.nan
    part = lambda d: calibration.moments(d[:, :3], d[:, 3:6], d[:, 6])
    whole = part(rows)
    rng = random.Random(1)
    for _ in range(5):
        cuts = sorted(rng.sample(range(301), 6))
        parts = [part(rows[a:b]) for a, b in itertools.pairwise([0, *cuts, 300])]
        rng.shuffle(parts)
        total = np.zeros(calibration.SIZE)
        for p in parts:
            total = calibration.merge(total, p)
        assert total == pytest.approx(whole, rel=1e-9, abs=1e-9)
    for direction in ([0, 0, -1.0], [0, 0, 1.0], [3.0, 1.0, -2.0], [0.0, 0.0, 0.0]):
        r = calibration.levelling(np.array(direction))
        assert r @ r.T == pytest.approx(np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
        if any(direction):
            assert r @ np.array(direction) == pytest.approx([0, 0, -np.linalg.norm(direction)])


def stream_of(spark, tmp_path, rows, schema, batches, make, name):
    """What ``make`` gives for rows that come in several micro-batches, and the stream's output."""
    from kinelake.streaming import stateful

    stateful.with_state_store(spark)
    folder = str(tmp_path / name)
    for n, part in enumerate(batches):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
        assert n < 10
    stream = make(spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streaming_calibrator_equals_batch(spark, tmp_path):
    from kinelake.streaming import stateful

    rows = phone(400, "a", 0.7, 1) + phone(350, "b", -2.0, 2) + phone(120, "short", 0.3, 3)
    rows += [(k, ns, gx, gy, gz, ax, ay, az, 5.0) for k, ns, gx, gy, gz, ax, ay, az, _ in phone(300, "constant", 0.1, 4)]
    table = spark.createDataFrame(rows, PHONE)
    want = {r["key"]: r for r in monitoring.calibrations(table, ACCEL, GRAVITY, "ref").collect()}
    assert want["short"]["score"] is None and want["short"]["yaw_deg"] == 0 and want["constant"]["score"] is None
    # The yaw of the features, fitted on exactly the rows up to the one that opens the gate.
    used = table.where(F.col("key") == "a").where(F.col("ns") <= want["a"]["ns"]).withColumn("row_idx", F.col("ns"))
    same = features.aligned_features(used, ACCEL, GRAVITY, ["acc_x", "acc_y", "acc_z"], "ref", by="key").select("yaw_deg").distinct().collect()
    assert [r["yaw_deg"] for r in same] == [want["a"]["yaw_deg"]]
    assert abs(want["a"]["yaw_deg"] - math.degrees(0.7)) <= 2.5 and abs(want["b"]["yaw_deg"] - math.degrees(-2.0)) <= 2.5
    assert want["a"]["n"] == 200

    stamped = [(*r, i) for i, r in enumerate(rows)]
    by_time = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))
    cuts = [0, 137, 600, 601, 900, len(rows)]
    batches = [by_time[a:b] for a, b in itertools.pairwise(cuts)]
    batches[2] = batches[2] + batches[0][:40]  # late rows come again
    make = lambda s: stateful.calibrate(s.withColumn("ts", F.expr("timestamp_micros(1000000 + ns div 1000)")), ACCEL, GRAVITY, "ref", late="100 days", idle_ms=10**9)
    got = {r["key"]: r for r in stream_of(spark, tmp_path, stamped, PHONE + ", i long", batches, make, "calibrated")}
    assert set(got) == {"a", "b"}
    for key, r in got.items():
        assert (r["ns"], r["n"], r["yaw_deg"]) == (want[key]["ns"], want[key]["n"], want[key]["yaw_deg"])
        assert r["score"] == pytest.approx(want[key]["score"], abs=2e-9) and r["gravity"] == pytest.approx(want[key]["gravity"])
        rotation = np.array(r["rotation"]).reshape(3, 3)
        assert rotation @ np.array(r["gravity"]) == pytest.approx([0, 0, -np.linalg.norm(r["gravity"])])


def test_an_idle_phone_is_levelled_by_a_timer(spark, tmp_path):
    from kinelake.streaming import stateful

    rows = phone(50, "idle", 0.7, 1) + [(k, ns + 10**12, *v) for k, ns, *v in phone(250, "busy", 0.2, 2)]
    make = lambda s: stateful.calibrate(s.withColumn("ts", F.expr("timestamp_micros(1000000 + ns div 1000)")), ACCEL, GRAVITY, "ref", late="1 second", idle_ms=60_000)
    got = {r["key"]: r for r in stream_of(spark, tmp_path, rows, PHONE, [range(50), range(50, 200), range(200, 300)], make, "idled")}
    assert set(got) == {"idle", "busy"}
    assert got["idle"]["yaw_deg"] == 0 and got["idle"]["score"] is None and got["idle"]["n"] == 45
    assert got["busy"]["score"] is not None


def drives(seed):
    """Fixes (key, t_ms, east, north, accuracy, sats) with gaps, bad stretches and a jump."""
    rng = random.Random(seed)
    rows = []
    for key in "abcd":
        t, e = 1_000, 0.0
        for i in range(120):
            t += 1000 if rng.random() < 0.93 else rng.choice([4000, 5000, 20_000])
            e += 12 + rng.gauss(0, 1)
            jump = 300.0 if key == "c" and 60 <= i < 64 else 0.0
            rows.append((key, t, e + jump + rng.gauss(0, 3), rng.gauss(0, 3), 5.0 if rng.random() < 0.85 else 80.0, rng.choice([3.0, 7.0, 9.0, 9.0, 9.0])))
    return rows


FIXES = "key string, t_ms long, east_m double, north_m double, accuracy_m double, sats double"


def slow_modes(rows, policy, until=None):
    """The modes of one key, from the statistic of the batch detector."""
    t = np.array([r[1] for r in rows]) / 1000
    stats = filters.residual_statistic(t, np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    mode, run, trusted, out = "WAITING", 0, None, []

    def gap(now):
        nonlocal mode, run
        if mode in ("TRACKING", "REACQUIRING") and now > trusted + policy.gap_ms:
            mode, run = "DEAD_RECKONING", 0
            out.append((trusted + policy.gap_ms, None, "absent", mode, "gap"))

    for r, stat in zip(rows, stats):
        gap(r[1])
        good = r[4] <= policy.accuracy_m and r[5] >= policy.sats and not stat >= policy.gate
        trigger = None
        if mode == "WAITING" and good:
            mode, trigger, run = "TRACKING", "first_fix", 0
        elif mode == "TRACKING":
            run = 0 if good else run + 1
            if run == policy.bad_run:
                mode, trigger, run = "DEAD_RECKONING", "fixes_degraded", 0
        elif mode == "DEAD_RECKONING" and good:
            mode, trigger, run = "REACQUIRING", "fix", 1
        elif mode == "REACQUIRING":
            run = run + 1 if good else 0
            if not good:
                mode, trigger = "DEAD_RECKONING", "fix_degraded"
            elif run == policy.good_run:
                mode, trigger, run = "TRACKING", "settled", 0
        trusted = r[1] if good else trusted
        out.append((r[1], None if math.isnan(stat) else stat, "trusted" if good else "degraded", mode, trigger))
    if until is not None:
        gap(until)
    return out


def as_rows(got):
    return sorted((r["key"], r["t_ms"], r["quality"], r["mode"], r["trigger"], None if r["stat"] is None or math.isnan(r["stat"]) else round(r["stat"], 9)) for r in got)


def test_monitor_equals_plain_rules_and_its_stream(spark, tmp_path):
    from kinelake.streaming import stateful

    rows, policy = drives(1), modes.Policy()
    until = max(r[1] for r in rows) - 1000
    want = sorted((k, t, q, m, why, None if s is None else round(s, 9)) for k in "abcd" for t, s, q, m, why in slow_modes([r for r in rows if r[0] == k], policy, until))
    table = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), FIXES).repartition(3)
    got = monitoring.monitor_fixes(table, policy, until).collect()
    assert as_rows(got) == want and all(r["dropped"] == 0 for r in got)
    assert {"gap", "settled", "fix", "first_fix", "fixes_degraded"} <= {r["trigger"] for r in got}
    assert max(s for *_, s in as_rows(got) if s is not None) > 4

    by_time = sorted(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))
    batches = [by_time[a:b] for a, b in itertools.pairwise([0, 90, 91, 250, 400, len(rows)])]
    batches[3] = batches[3] + [i for i in batches[2] if rows[i][0] == "a"][-3:]  # three fixes come again, within the watermark's patience
    make = lambda s: stateful.monitor(s.withColumn("ts", F.timestamp_millis("t_ms")), policy, late="1 second")
    streamed = stream_of(spark, tmp_path, rows, FIXES, batches, make, "monitored")
    fixed = [r for r in want if r[2] != "absent"]
    assert [r for r in as_rows(streamed) if r[2] != "absent"] == fixed
    gaps = {r for r in as_rows(streamed) if r[2] == "absent"}
    assert gaps == {r for r in want if r[2] == "absent"}


def test_fixes_out_of_order_are_dropped_and_counted():
    m = modes.Monitor(modes.Policy())
    assert m.fix(1000, 0.0, 0.0, 1.0, 9.0)
    assert m.fix(1000, 1.0, 0.0, 1.0, 9.0) == [] and m.fix(400, 1.0, 0.0, 1.0, 9.0) == [] and m.fix(2000, math.nan, 0.0, 1.0, 9.0) == []
    assert m.dropped == 3
    again = modes.Monitor(m.policy, m.state())
    assert again.state() == m.state() and again.fix(2000, 1.0, 0.0, 1.0, 9.0) == m.fix(2000, 1.0, 0.0, 1.0, 9.0)


def test_smoother_equals_least_squares(spark):
    noise, start = 2.0, 100.0
    rng = np.random.default_rng(4)
    rows = []
    for key, n in (("a", 40), ("b", 25), (None, 12), ("one", 1)):
        t = np.cumsum(rng.uniform(0.5, 2.0, n))
        for i in range(n):
            seen = not (8 <= i < 15 or i == n - 1) or n == 1
            rows.append((key, float(t[i]), float(3 * t[i] + rng.normal()) if seen else None, float(rng.normal()) if seen else None, 4.0))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go over several batches
    try:
        got = smoothing.smooth_tracks(spark.createDataFrame(rows, "key string, t double, east_m double, north_m double, var double").repartition(3), noise, start).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for key in ("a", "b", None, "one"):
        own = [r for r in rows if r[0] == key]
        for axis, name in ((2, "east_m"), (3, "north_m")):
            # Unknowns: position and velocity of each row; the start, the steps and the fixes weigh in by their covariances.
            n = len(own)
            info, right = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
            info[0, 0] += 1 / start
            info[1, 1] += 1 / start
            right[0] += (own[0][axis] or 0.0) / start
            for i, r in enumerate(own):
                if i:
                    dt = r[1] - own[i - 1][1]
                    q = np.linalg.inv(noise * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]))
                    step = np.hstack([-np.array([[1, dt], [0, 1]]), np.eye(2)])
                    info[2 * i - 2 : 2 * i + 2, 2 * i - 2 : 2 * i + 2] += step.T @ q @ step
                if r[axis] is not None:
                    info[2 * i, 2 * i] += 1 / r[4]
                    right[2 * i] += r[axis] / r[4]
            x, cov = np.linalg.solve(info, right), np.linalg.inv(info)
            mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["t"])
            assert [r[name] for r in mine] == pytest.approx(x[0::2], abs=1e-6)
            assert [r["var_m2"] for r in mine] == pytest.approx(np.diag(cov)[0::2], rel=1e-6)


def test_resampling_by_stretches_equals_the_whole(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(0, 100_000), rng.random(), rng.random()) for k in "ab" for _ in range(150)] + [("c", 500, 1.0, 2.0), ("c", 500, 0.5, 9.0), ("d", 77, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "key string, t long, v double, w double")
    want = {}
    for k in "abcd":
        points = {}
        for _, t, v, w in (r for r in rows if r[0] == k and r[1] is not None):
            points[t] = min(points.get(t, (v, w)), (v, w))
        at = sorted(points)
        for g in range(math.ceil(at[0] / 250) * 250, at[-1] + 1, 250):
            low = max(t for t in at if t <= g)
            high = min(t for t in at if t >= g)
            ok = low == high or high - low <= 1500
            want[k, g] = tuple(a + (b - a) * ((g - low) / (high - low) if high > low else 0) for a, b in zip(points[low], points[high])) if ok else None
    for stretch in (0, 3000, 10**9):
        got = {(r["key"], r["t"]): (r["v"], r["w"]) if r["filled"] else None for r in smoothing.resample(table, "t", ["v", "w"], 250, 1500, stretch=stretch).collect()}
        assert got.keys() == want.keys()
        assert all((got[x] is None) == (want[x] is None) and (got[x] is None or got[x] == pytest.approx(want[x])) for x in want)


def test_despike_and_decimate(spark):
    values = [math.sin(i / 5) for i in range(60)]
    values[20], values[41], values[50] = 50.0, float("nan"), None
    table = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)] + [(1, 0, 3.0)], "seq_id long, row_idx long, v double")
    got = {(r["seq_id"], r["row_idx"]): r for r in smoothing.despike(table, "v").collect()}
    assert [k for k, r in got.items() if r["is_spike"]] == [(0, 20)] and abs(got[0, 20]["despiked"]) < 1
    assert math.isnan(got[0, 41]["despiked"]) and got[0, 50]["despiked"] is None and got[1, 0]["despiked"] == 3.0
    taps = smoothing.low_pass_taps(4.0, 100.0, 61)
    n = np.arange(2000)
    slow, fast = np.sin(2 * np.pi * 1.0 * n / 100), np.sin(2 * np.pi * 30.0 * n / 100)
    table = spark.createDataFrame([(0, int(i), float(a), float(b)) for i, a, b in zip(n, slow, fast)], "seq_id long, row_idx long, slow double, fast double")
    kept = smoothing.decimate(table, "slow", 10, taps).where("row_idx between 100 and 1900").collect()
    assert len(kept) == 181 and max(abs(r["slow"] - slow[r["row_idx"]]) for r in kept) < 0.01
    assert max(abs(r["fast"]) for r in smoothing.decimate(table, "fast", 10, taps).where("row_idx between 100 and 1900").collect()) < 0.01
    for bad in ((4.0, 100.0, 60), (60.0, 100.0, 61)):
        with pytest.raises(ValueError, match="odd"):
            smoothing.low_pass_taps(*bad)


def test_model_windows_move_no_row_off_its_sequence(spark):
    """F16: no shuffle is by rows or windows, so none has a row for each row of each window."""
    frame = model_queries.model_windows(spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    dealt = set(re.findall(r"hashpartitioning\(([a-z_]+)#\d+L?(, [a-z_]+)?", plan))
    assert dealt and all(more == "" for _, more in dealt)
    usable = model_queries.usable_model_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all(more == "" for _, more in re.findall(r"hashpartitioning\(([a-z_]+)#\d+L?(, [a-z_]+)?", usable))


def test_gathered_windows_equal_sliding_windows(spark):
    rows = [(s, i, float(s * 100 + i)) for s, n in enumerate((3, 8, 9, 10, 31)) for i in range(n)]
    samples = spark.createDataFrame(rows, "seq_id long, row_idx long, v double").repartition(4)
    got = {(r["seq_id"], r["start"]): r["v"] for r in sequences.gathered_windows(samples, {"v": F.collect_list("v")}, 5, 3, 2).collect()}
    whole = samples.groupBy("seq_id").agg(F.lit(0).alias("seg_index"), F.lit(0).cast("long").alias("start"), (F.max("row_idx") + 1).alias("stop"))
    want = {(r["seq_id"], r["start"]): [float(r["seq_id"] * 100 + i) for i in range(r["start"], r["stop"])] for r in sequences.sliding_windows(whole, 5, 3, 2).collect()}
    assert got == want and len(got) == 10


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_repeat_routes_equal_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(routes, "CELL_ROWS", 5)  # a cell that everyone visits is joined in parts
    rng = random.Random(6)
    cells = {s: {rng.randrange(60) for _ in range(rng.randint(1, 15))} | {-1} for s in range(50)}
    cells[90], cells[91] = set(cells[3]), set(list(cells[3])[:3])
    rows = [(s, str(c)) for s, own in cells.items() for c in own] * 2 + [(None, "1"), (3, None)]
    got = {(r["seq_a"], r["seq_b"]): (r["common"], round(r["share"], 9)) for r in routes.repeat_routes(spark.createDataFrame(rows, "seq_id long, cell string").repartition(4), share).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(cells), 2):
        least, common = min(len(cells[a]), len(cells[b])), len(cells[a] & cells[b])
        if least >= 3 and common >= share * least - 1e-9:
            want[a, b] = (common, round(common / least, 9))
    assert got == want and (3, 90) in got


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_repeat_routes_by_index_and_by_blocks_are_one(spark, monkeypatch, share):
    monkeypatch.setattr(routes, "CELL_ROWS", 5)
    monkeypatch.setattr(routes, "STRIP", 3)
    monkeypatch.setattr(routes, "PAIR_ROWS", 2)
    rng = random.Random(8)
    rows = [(s, str(rng.randrange(1, 40) ** 2 // 40)) for s in range(60) for _ in range(rng.randint(1, 15))] + [(None, "1"), (3, None)]
    visits = spark.createDataFrame(rows, "seq_id long, cell string").repartition(4)
    index, blocks = (sorted(tuple(r) for r in routes.repeat_routes(visits, share, by_blocks=b).collect()) for b in (False, True))
    assert index == blocks and len(index) > 5


def test_repeat_routes_of_cells_in_common_move_no_pairs(spark, tmp_path):
    """where most pairs are rows of the result, pairs are not shuffled: each sequence is sent once for each block."""
    visits = spark.range(400).selectExpr("id as seq_id", "explode(sequence(0, 9)) as c").selectExpr("seq_id", "cast(c as string) as cell")
    out = routes.repeat_routes(visits, 0.5)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 400 * 399 // 2
    empty = routes.repeat_routes(visits.where("false"), 0.5)
    assert empty.count() == 0


def test_geographic_cells_are_about_500_m(spark):
    rows = [(i, 51.0 + i * 0.0009, 7.0 + j * 0.0014) for i in range(40) for j in range(40)]  # 100 m apart
    got = spark.createDataFrame(rows, "i long, lat double, lon double").groupBy(routes.geographic_cell("lat", "lon").alias("c")).count().collect()
    inner = sorted(r["count"] for r in got)
    assert 64 <= len(got) <= 100 and 16 <= inner[len(inner) // 2] <= 36
    edge = spark.createDataFrame([(90.0, 0.0), (90.0, 180.0), (0.0, -0.001), (0.0, 359.999)], "lat double, lon double").select(routes.geographic_cell("lat", "lon").alias("c")).collect()
    assert edge[0]["c"] == edge[1]["c"] and edge[2]["c"] == edge[3]["c"]


def test_weighted_draws(spark):
    weights = [(i, float(w)) for i, w in enumerate([1, 2, 3, 4, 0, -5, 10, 30])] + [(20, None), (21, float("nan")), (22, float("inf")), (None, 5.0), (7, 20.0)]
    table = spark.createDataFrame(weights, "id long, w double")
    draws = 20_000
    got = sampling.weighted_draws(table, draws, "id", "w", seed=1, cells=4).collect()
    assert sorted(r["draw"] for r in got) == list(range(draws))
    count = Counter(r["id"] for r in got)
    total = 1 + 2 + 3 + 4 + 10 + 50
    for i, w in {0: 1, 1: 2, 2: 3, 3: 4, 6: 10, 7: 50}.items():
        assert abs(count[i] / draws - w / total) < 5 * math.sqrt(w / total / draws)
    assert set(count) <= {0, 1, 2, 3, 6, 7}
    again = sampling.weighted_draws(table.repartition(3), draws, "id", "w", seed=1, cells=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(map(tuple, got)) != sorted(map(tuple, sampling.weighted_draws(table, draws, "id", "w", seed=2, cells=4).collect()))
    assert sampling.weighted_draws(table.where("id = 4"), 10, "id", "w").collect() == []
    many = spark.range(3000).select("id", F.lit(1.0).alias("w"))
    spread = Counter(r["id"] for r in sampling.weighted_draws(many, 6000, "id", "w", seed=9).collect())
    assert 2400 < len(spread) < 2800  # 1 - exp(-2) of all


def test_random_segments(spark):
    segments = [(s, a, a + n) for s in range(300) for a, n in ((0, 3), (10, 12), (50, 30))] + [(999, 0, 4)]
    got = sampling.random_segments(spark.createDataFrame(segments, "seq_id long, start long, stop long"), 5, seed=2).collect()
    assert sorted(r["seq_id"] for r in got) == list(range(300))
    assert all(r["stop"] - r["start"] == 5 and (10 <= r["start"] <= 17 or 50 <= r["start"] <= 75) for r in got)
    assert abs(sum(r["start"] < 20 for r in got) / 300 - 8 / 34) < 0.1


def test_planted_remounts_are_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key, at, roll, pitch in (("still", 10**6, 0, 0), ("rolled", 150, 0.6, 0.0), ("pitched", 90, 0.0, -0.5), ("upside", 120, 3.0, 0.0)):
        for i in range(300):
            r, p = (roll, pitch) if i >= at else (0.0, 0.0)
            r, p = r + math.pi * (key == "upside") + 0.02 * rng.normal(), p + 0.02 * rng.normal()
            g = 9.81 * np.array([-math.sin(p), math.cos(p) * math.sin(r), math.cos(p) * math.cos(r)])
            rows.append((key, i, *map(float, g)))
    rows += [("gaps", i, None, float("nan"), 9.0) for i in range(50)] + [("gaps", 51, 0.0, 0.0, 0.0)]
    got = {r["seq_id"]: r for r in remount.remounts(spark.createDataFrame(rows, "seq_id string, row_idx long, x double, y double, z double"), ["x", "y", "z"]).collect()}
    assert set(got) == {"rolled", "pitched", "upside"}
    for key, at, side in (("rolled", 150, "roll_up"), ("pitched", 90, "pitch_down"), ("upside", 120, "roll_up")):
        assert 0 <= got[key]["detected"] - at <= 20 and abs(got[key]["changed"] - at) <= 3 and got[key]["side"] == side


def test_augmented_windows(spark):
    rng = np.random.default_rng(5)
    windows = [(i, rng.normal(size=(20, 6)).tolist()) for i in range(60)] + [(99, None)]
    table = spark.createDataFrame(windows, "id long, x array<array<double>>")
    only_turn = augment.Strengths(turn_deg=180.0, noise=0.0, gain=0.0, drift=0.0, warp=0.0, share=1.0)
    got = {r["id"]: r for r in augment.augmented(table, "id", 1, only_turn).collect()}
    for i, x in windows[:-1]:
        x, y = np.array(x), np.array(got[i]["x"])
        assert np.linalg.norm(y[:, :3], axis=1) == pytest.approx(np.linalg.norm(x[:, :3], axis=1))
        turn = np.linalg.lstsq(x[:, :3], y[:, :3], rcond=None)[0]
        assert turn @ turn.T == pytest.approx(np.eye(3), abs=1e-9) and np.linalg.det(turn) == pytest.approx(1) and x[:, 3:] @ turn == pytest.approx(y[:, 3:], abs=1e-9)
    assert got[99]["x"] is None
    strengths = augment.Strengths()
    one = augment.augmented(table, "id", 1, strengths, variants=3).collect()
    two = augment.augmented(table.repartition(5), "id", 1, strengths, variants=3).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 183
    share = np.mean([r["applied"] for r in one])
    assert 0.8 < share < 0.98 and all(r["x"] == dict(windows)[r["id"]] for r in one if not r["applied"])
    noisy = augment.augmented(table, "id", 3, augment.Strengths(turn_deg=0.0, noise=0.5, gain=0.0, drift=0.0, warp=0.0, share=1.0)).where("x is not null").collect()
    added = np.concatenate([(np.array(r["x"]) - np.array(dict(windows)[r["id"]])) / np.array(dict(windows)[r["id"]]).std(axis=0) for r in noisy])
    assert abs(added.mean()) < 0.02 and abs(added.std() - 0.5) < 0.02


def test_context_loss_without_rows(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 9.0, 9.0], 2, False)], "logits array<double>, label int, ok boolean")
    assert augment.context_loss(rows, mask="ok").first()["loss"] == 0
    assert augment.context_loss(rows).first()["loss"] == pytest.approx(math.log(sum(math.exp(v - 3) for v in (1, 2, 3))))


def test_trip_schema(spark):
    tables = {
        "trip": spark.createDataFrame([(1, 0, 10, False, False), (2, 5, 3, True, False), (2, 0, 1, True, True), (None, 0, 1, False, None)], "trip_id long, started_ns long, ended_ns long, uploaded boolean, consent boolean"),
        "pose": spark.createDataFrame([(1, 5, 50.0, 7.0, 359.0, 3.0, 1.0, "GNSS"), (1, 5, 50.0, 7.0, 0.0, 3.0, 1.0, "DR"), (7, 1, 91.0, -181.0, 360.0, -1.0, 0.0, "LOST"), (1, 6, None, None, None, None, None, None)], "trip_id long, ns long, lat_deg double, lon_deg double, heading_deg double, speed_mps double, sigma_m double, mode string"),
        "mode_event": spark.createDataFrame([(1, "GNSS", "GNSS"), (None, "GNSS", "DR")], "trip_id long, from_mode string, to_mode string"),
        "label_pair": spark.createDataFrame([(1, 5, 5, 0.1)], "trip_id long, start_ns long, stop_ns long, label_sigma double"),
        "mag_signature": spark.createDataFrame([("w", -1.0, 2000.0), ("w", 2.0, 50.0)], "way_id string, arc_m double, field_ut double"),
    }
    ids = {"trip": ["trip_id", "started_ns"], "pose": ["trip_id", "ns", "mode"], "mode_event": ["trip_id"], "label_pair": ["trip_id"], "mag_signature": ["arc_m"]}
    got = sorted((r["table_name"], r["constraint"], r["id"]) for r in constraints.violations(tables, constraints.TRIP_SCHEMA, ids).collect())
    assert got == sorted(
        [("trip", "trip_key", ",0"), ("trip", "trip_key", "2,0"), ("trip", "trip_key", "2,5"), ("trip", "trip_order", "2,5"), ("trip", "trip_consent", "2,5")]
        + [("pose", "pose_key", "1,5,GNSS"), ("pose", "pose_key", "1,5,DR"), *[("pose", c, "7,1,LOST") for c in ("pose_trip", "pose_lat", "pose_lon", "pose_heading", "pose_speed", "pose_sigma", "pose_mode")]]
        + [("mode_event", "mode_event_changes", "1"), ("label_pair", "label_pair_window", "1"), ("mag_signature", "mag_signature_arc", "-1.0"), ("mag_signature", "mag_signature_field", "-1.0")]
    )
    with pytest.raises(ValueError, match="no table"):
        constraints.violations({}, constraints.TRIP_SCHEMA, ids)


def test_traces_are_located_like_by_all_lags(spark, monkeypatch):
    monkeypatch.setattr(routes, "BLOCK", 37)
    rng = np.random.default_rng(3)
    ways = {w: np.cumsum(rng.normal(size=400)) for w in "abc"}
    ways["c"] = np.tile(np.cumsum(rng.normal(size=100)), 4)  # repeats itself
    ways["flat"] = np.zeros(300)
    traces = [(i, w, (ways[w][at : at + n] * 2 + 5 + 0.05 * rng.normal(size=n)).tolist()) for i, (w, at, n) in enumerate([("a", 0, 50), ("a", 350, 50), ("b", 123, 80), ("c", 130, 60), ("b", 36, 40), ("b", 37, 40)])]
    traces += [(10, "flat", list(map(float, range(20)))), (11, "nowhere", [1.0, 2.0, 3.0]), (12, "a", [1.0] * 30), (13, "a", [1.0, None, 2.0])]
    stored = [(w, 1000, x.tolist()) for w, x in ways.items()]
    t = spark.createDataFrame(traces, "trip_id long, way_id string, field array<double>")
    got = {r["trip_id"]: r for r in routes.locate_on_route(t, spark.createDataFrame(stored, "way_id string, start long, field array<double>")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 10, 11, 12}
    for i, w, trace in traces[:6]:
        scores = [round(float(np.corrcoef(trace, ways[w][k : k + len(trace)])[0, 1]), 9) for k in range(len(ways[w]) - len(trace) + 1)]
        best = int(np.argmax(scores))
        other = max(s for k, s in enumerate(scores) if abs(k - best) >= 20)
        r = got[i]
        assert r["at"] == 1000 + best and r["score"] == pytest.approx(scores[best], abs=2e-9) and r["runner_up"] == pytest.approx(other, abs=2e-9)
        assert r["verdict"] == ("MATCHED" if scores[best] - other > 0.05 else "MAG_AMBIGUOUS")
    assert got[3]["verdict"] == "MAG_AMBIGUOUS" and got[2]["verdict"] == "MATCHED" and got[2]["at"] == 1123
    assert all(got[i]["verdict"] == "NO_SIGNATURE" for i in (10, 11, 12))


def test_long_keys_go_over_batches_in_the_folds(spark):
    from kinelake.operators import navigation

    rows = [(k, i, float((i * 7) % 13)) for k in ("a", "b") for i in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = navigation.low_pass(spark.createDataFrame(rows, "seq_id string, row_idx long, x double"), "x").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    y, want = None, []
    for _, _, x in rows[:500]:
        y = x if y is None else 0.8 * y + (1 - 0.8) * x
        want.append(y)
    for key in "ab":
        assert [r["smoothed"] for r in sorted(got, key=lambda r: r["row_idx"]) if r["seq_id"] == key] == want


def test_insane_recordings_are_set_aside(spark):
    from kinelake.sources import recordings

    phone = spark.createDataFrame([("good", 0.5, 9.0), ("degrees", 57.0, 9.0), ("g", 0.1, 980.0), ("empty", float("nan"), float("nan"))], "seq_id string, gyro double, accel double")
    phone = phone.select("seq_id", *[F.col("gyro").alias(c) for c in recordings.GYRO], *[F.col("accel").alias(c) for c in recordings.ACCEL])
    vehicle = spark.createDataFrame([("good", 30.0), ("fast", 900.0)], "seq_id string, w double").select("seq_id", *[F.col("w").alias(c) for c in recordings.WHEELS])
    bad = {(r["seq_id"], r["column"].split("_")[0]) for r in recordings.sanity(phone, vehicle).where("not sane").collect()}
    assert bad == {("degrees", "gyro"), ("g", "accel"), ("fast", "wheel")}


def test_a_failed_cache_is_made_again(spark, tmp_path):
    from kinelake.sources import artefacts

    root, made = f"file://{tmp_path}/cache", []

    def make(fail):
        made.append(fail)
        return spark.range(3).select(F.when(F.lit(fail) & (F.col("id") == 2), F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        artefacts.cached(spark, root, {"a": 1}, lambda: make(True))
    for _ in range(2):
        assert artefacts.cached(spark, root, {"a": 1}, lambda: make(False)).count() == 3
    assert made == [True, False]
    assert artefacts.cached(spark, root, {"a": 2}, lambda: make(False)).count() == 3 and len(made) == 3


def test_picks_are_topped_up(spark):
    from kinelake.operators import evaluation

    pool = spark.createDataFrame([(f"k{i}", 30 if i < 3 else 60, "urban") for i in range(40)], "key string, duration_s int, scenario string")
    for total, want in ((20, 20), (40, 40), (100, 40)):
        got = [r["key"] for r in evaluation.topped_up_pick(pool, total).collect()]
        assert len(got) == len(set(got)) == want and {"k0", "k1", "k2"} <= set(got)


def test_outage_benchmark_on_known_drives(spark):
    from kinelake.operators import benchmark

    rows = []
    for seq, turn, sign in (("straight", 0.0, 1.0), ("circle", 0.05, 1.0), ("turned", 0.05, -1.0)):
        lat, lon, heading = 50.0, 7.0, 0.3
        for i in range(900):
            rate = turn * (1 + 0.5 * math.sin(i / 20))
            rows.append((seq, i, 15.0, math.degrees(heading) % 360, 0.0, -15.0 * rate, 0.0, 0.0, 0.0, sign * rate, lat, lon, False))
            heading += rate * 0.1
            lat += math.degrees(15.0 * math.cos(heading) * 0.1 / 6_371_000)
            lon += math.degrees(15.0 * math.sin(heading) * 0.1 / 6_371_000 / math.cos(math.radians(50.0)))
    samples = spark.createDataFrame(rows, "seq_id string, row_idx long, speed_mps double, heading_deg double, accel_x double, accel_y double, accel_z double, gyro_x double, gyro_y double, gyro_z double, lat_deg double, lon_deg double, is_stationary boolean")
    outages = spark.createDataFrame([(s, s, 500, 800, 30, "urban") for s in ("straight", "circle", "turned")], "key string, seq_id string, start long, stop long, duration_s int, scenario string")
    assert {r["key"]: r["sign"] for r in benchmark.gyro_signs(outages, samples).collect()} == {"straight": 1.0, "circle": 1.0, "turned": -1.0}

    weights = {n: np.zeros(s, np.float32) for n, s in layers.shapes(6, 8).items()}
    weights["mean.bias1"][:] = 18.0  # a model that says 18 m/s, of which the rows before tell 3 as its bias
    model = network.Model(network.Contract(), weights)
    runs = {**benchmark.BASELINES, "learned": benchmark.learned(model), "biased": benchmark.learned(model, remove_bias=False)}
    scores = {(r["baseline"], r["key"]): r for r in benchmark.run(outages, samples, runs).collect()}
    assert len(scores) == 15 and all(abs(r["distance_m"] - 450) < 1 for r in scores.values())
    assert scores["hold", "straight"]["final_error_m"] < 0.5 and scores["hold", "circle"]["final_error_m"] > 100
    for key in ("straight", "circle", "turned"):
        assert scores["learned", key]["final_error_m"] < 8 and scores["learned", key]["heading_error_deg"] < 1
        assert scores["biased", key]["final_error_m"] > 40
    assert scores["strapdown", "circle"]["final_error_m"] < 20 and scores["strapdown", "turned"]["final_error_m"] < 20
    by = {(r["baseline"], r["duration_s"], r["scenario"]): r for r in benchmark.summary(benchmark.run(outages, samples, {"hold": benchmark.BASELINES["hold"]}), outages).collect()}
    assert set(by) == {("hold", 30, None), ("hold", None, "urban")} and by["hold", 30, None]["n"] == 3


def test_what_stands_on_a_limit_is_judged_in_the_order_of_rows(spark):
    import duckdb

    from kinelake.functions.nanops import in_order, mean_of
    from kinelake.operators import labels

    yaw = [0.39, 0.09, 0.12, 0.06, 0.09]  # its deviation is 0.135, but for the last bits
    rows = spark.createDataFrame([("a", 0, 5, i, 50.0, y) for i, y in enumerate(yaw)], "seq_id string, start int, stop int, row_idx int, speed double, yaw double")
    got = labels.context_labels(rows, "speed", "yaw").first()
    steps = [b - a for a, b in itertools.pairwise(yaw)]
    want = duckdb.connect().execute("SELECT stddev_pop(x) FROM (VALUES " + ", ".join(f"({s!r}::DOUBLE)" for s in steps) + ") t(x)").fetchone()[0]
    assert got["jitter"] == want and got["context"] == (2 if want > 0.135 else 1)
    values = [194.54, 37.51, 105.65, 97.79, 64.51]
    total = 0.0
    for v in values:
        total += v
    moved = [spark.createDataFrame([(i, values[i]) for i in order], "i int, v double").coalesce(1).agg(mean_of(in_order("i", "v"))).first()[0] for order in ((0, 1, 2, 3, 4), (4, 0, 1, 2, 3), (3, 1, 4, 2, 0))]
    assert moved == [total / 5] * 3
    nothing = spark.createDataFrame([(1, None)], "i int, v double").agg(mean_of(in_order("i", "v"))).first()[0]
    assert nothing is None


def test_of_fixes_at_one_time_the_first_by_place_counts(spark, tmp_path):
    from kinelake.streaming import stateful

    policy = modes.Policy(accuracy_m=40.0, sats=5, gate=None)
    later = [("k", 1000, 9.0, 0.0, 10.0, 9.0), ("k", 1000, 5.0, 0.0, 90.0, 9.0), ("k", 1000, 5.0, -1.0, 10.0, 2.0), ("k", 1000, None, 0.0, 10.0, 9.0)]
    for order in itertools.permutations(later):
        rows = spark.createDataFrame(list(order), FIXES).coalesce(1)
        out = monitoring.monitor_fixes(rows, policy).collect()
        assert [(r["t_ms"], r["quality"]) for r in out] == [(1000, "degraded")], order
    make = lambda s: stateful.monitor(s.withColumn("ts", F.timestamp_millis("t_ms")), policy, late="1 second")
    got = stream_of(spark, tmp_path, later, FIXES, [[0, 1, 2, 3]], make, "ties")
    assert [(r["t_ms"], r["quality"]) for r in got if r["quality"] != "absent"] == [(1000, "degraded")]


def test_traces_of_a_way_meet_its_cells_together(spark, monkeypatch):
    monkeypatch.setattr(routes, "BLOCK", 64)
    field = np.random.default_rng(8).normal(size=400)
    stored = spark.createDataFrame([("w", 10, field.tolist())], "way_id string, start long, field array<double>")
    traces = spark.createDataFrame([(i, "w", field[7 * i : 7 * i + 32].tolist()) for i in range(40)], "trip_id long, way_id string, field array<double>")
    got = {r["trip_id"]: (r["at"], r["verdict"]) for r in routes.locate_on_route(traces, stored).collect()}
    assert got == {i: (10 + 7 * i, "MATCHED") for i in range(40)}
    # Forty traces and seven cells: seven rows meet, not a row a trace and block.
    kept = routes._best(np.stack([field[:32], field[350:382]]), [(10, 300, field[:331])], None, 20)
    assert kept[0] == (1.0, 10) and kept[1][0] < 0.9 and routes._best(field[None, :32], [(10, 300, field[:331])], [10], 20)[0][1] >= 30


def test_the_outage_benchmark_works_its_inputs_out_once(spark):
    """Outages and samples are read from stored tables by every baseline, however often it asks for them."""
    from kinelake.plans import queries, track_queries

    sf = "/root/testdata/sf0.001"
    outages, seen = queries.event_outages(spark, sf)[1], []

    def spy(o, s):
        seen.extend("FileScan parquet" in d._jdf.queryExecution().executedPlan().toString() and "Window" not in d._jdf.queryExecution().executedPlan().toString() for d in (o, s))
        return benchmark.hold(o, s)

    scores = benchmark.run(outages, track_queries.drives(spark, sf), {"spy": spy})
    assert seen == [True, True] and scores.count() == outages.count() > 0


def test_keys_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    """However few parts shuffles have, a task counts about KEY_ROWS keys."""
    monkeypatch.setattr(constraints, "KEY_ROWS", 50)
    rows = spark.range(2000).selectExpr("id % 1990 AS a", "id").repartition(1)
    assert constraints._dealt(rows.select("a"), ("a",)).rdd.getNumPartitions() == 40
    got = constraints.violations({"t": rows}, {"t": (constraints.Key("k", ("a",)),)}, {"t": ["id"]}).collect()
    assert sorted(int(r["id"]) for r in got) == [*range(10), *range(1990, 2000)]


def test_exploded_intervals_are_not_broadcast(spark):
    """Spark takes an interval's rows for one row, so a table of them that is large is no small one to it."""
    from kinelake.operators import evaluation

    samples = spark.range(200).selectExpr("id % 2 AS seq_id", "id div 2 AS row_idx", "3.0D AS v")
    whole = spark.createDataFrame([(0, 0, 0, 100), (1, 0, 0, 100)], "seq_id long, seg_index int, start long, stop long")
    grid = evaluation.outage_candidates(whole, samples, "v", (10, 20), 1, 3, 2, 2.0)
    points = spark.createDataFrame([(0, 50, 60), (1, 0, 10)], "seq_id long, start long, stop long")
    made = [grid, sequences.interval_rows(points, samples), sequences.lookback_rows(points, samples, 5), sequences.row_before(points, samples)]
    assert all("BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString() for d in made)
    assert [d.count() for d in made] == [2 * (29 + 26), 20, 5, 2]


def test_outages_meet_their_scores_without_broadcast(spark):
    """Stored outages are small files of many rows."""
    outages = spark.range(9).selectExpr("'k' || id AS key", "30 AS duration_s", "'urban' AS scenario")
    scores = outages.select(F.lit("hold").alias("baseline"), "key", F.lit(2.0).alias("drift_pct"))
    out = benchmark.summary(scores, outages)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["duration_s"], r["scenario"], r["n"]) for r in out.collect()} == {(30, None, 9), (None, "urban", 9)}


def test_traces_are_multiplied_with_stretches_like_by_transforms(monkeypatch):
    """The first of equals, constant stretches and traces, gaps between pieces and tables of a few stretches at a time."""
    rng = np.random.default_rng(6)
    pieces = [(40 * i, 40, rng.normal(size=40)) for i in range(12)]
    pieces[3], pieces[5], pieces[8] = (120, 40, np.ones(40)), (200, 40, pieces[4][2] * 3 + 1), (320, 7, pieces[8][2][:7])
    traces = np.stack([p[2][5:17] + 0.1 * rng.normal(size=12) for p in pieces if len(p[2]) == 40] + [pieces[4][2][9:21] * 2, np.full(12, 7.0), pieces[4][2][9:21]])
    want = routes._best_by_fft(traces, pieces, None, 20)
    away = [b[1] if b else 0 for b in want]
    other = routes._best_by_fft(traces, pieces, away, 20)
    for values, places, many in ((1 << 20, 2048, 64), (60, 3, 2), (1, 1, 1)):
        monkeypatch.setattr(routes, "STRETCH_VALUES", values)
        monkeypatch.setattr(routes, "SCORE_PLACES", places)
        monkeypatch.setattr(routes, "SCORE_TRACES", many)
        assert routes._best(traces, pieces, None, 20) == want and routes._best(traces, pieces, away, 20) == other
    assert want[-1] == want[-3] == (1.0, 169) and other[-1] == (1.0, 209) and want[-2] is None
    monkeypatch.setattr(routes, "DIRECT", 11)
    assert routes._best(traces, pieces, away, 20) == other


def test_peaks_are_worked_once_and_near_cells_meet_many_traces(spark):
    """All places are compared once, however often their bests are read; a cell near the best places of many traces is sent to them together."""
    field = np.random.default_rng(8).normal(size=400)
    stored = spark.createDataFrame([("w", 0, field.tolist())], "way_id string, start long, field array<double>")
    traces = spark.createDataFrame([(i, "w", field[7 * i : 7 * i + 32].tolist()) for i in range(40)], "trip_id long, way_id string, field array<double>")
    plan = routes.locate_on_route(traces, stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list(struct(trip_id" in plan


def test_shares_are_rounded_like_decimal_numbers(spark):
    """To so many digits, halves up, as F.round does; and each product of blocks has a part of its own, about, however few bytes are sent."""
    cells = [(0, c) for c in range(128)] + [(s, c) for s in range(1, 129) for c in [*range(s), *range(1000 * s, 1000 * s + 150)]]
    visits = spark.createDataFrame([(s, str(c)) for s, c in cells], "seq_id long, cell string")
    for by_blocks in (False, True):
        plain = routes.repeat_routes(visits, 0.001, by_blocks=by_blocks).withColumn("share", F.round("share", 6))
        out = routes.repeat_routes(visits, 0.001, by_blocks=by_blocks, digits=6)
        rows = {tuple(r) for r in out.collect()}
        assert rows == {tuple(r) for r in plain.collect()} and (0, 1, 1, 0.007813) in rows and len(rows) == 129 * 128 // 2
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
