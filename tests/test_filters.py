import numpy as np
import pandas as pd
import pytest

from kinelake.kernels import inertial, planar
from kinelake.operators import filters


def straight(n=100, **k):
    z = np.zeros(n)
    args = {"forward": z, "lateral": z, "yaw_rate": z, "still": z.astype(bool), "v0": 10.0, "heading0": 0.0, "dt": 0.1} | k
    return planar.run(**args)


def test_planar_straight_line():
    out = straight(heading0=np.pi / 2)
    assert out.shape == (101, 3)
    assert out[-1, 0] == pytest.approx(100.0, abs=1e-6) and out[-1, 1] == pytest.approx(0.0, abs=1e-6)


def test_planar_constant_turn_is_an_arc():
    n, rate = 100, 0.1
    out = straight(n, yaw_rate=np.full(n, -rate), lateral=np.full(n, -10.0 * rate), dt=0.1)
    radius = 10.0 / rate
    assert out[-1, 2] == pytest.approx(1.0, abs=0.01)
    assert out[-1, 0] == pytest.approx(radius * (1 - np.cos(1.0)), abs=1.5) and out[-1, 1] == pytest.approx(radius * np.sin(1.0), abs=1.5)


def test_planar_accelerates_quadratically():
    out = straight(50, v0=0.0, forward=np.full(50, 2.0))
    assert out[-1, 1] == pytest.approx(25.0, rel=1e-3)


def test_planar_stands_still_and_refuses_outliers():
    out = straight(100, v0=0.3, still=np.ones(100, dtype=bool))
    assert abs(out[-1, 1] - out[50, 1]) < 0.05
    kf = planar.Planar(10.0, 0.0)
    before = kf.x.copy(), kf.p.copy()
    assert not kf.see_speed(200.0, 0.1)
    assert (kf.x == before[0]).all() and (kf.p == before[1]).all()
    assert kf.see_speed(10.5, 0.5) and kf.forward_speed() > 10.0


def test_inertial_rest_turn_and_symmetry():
    kf = inertial.Inertial()
    for _ in range(100):
        kf.step(-inertial.GRAVITY, np.zeros(3), 0.01)
    assert np.allclose(kf.x[:6], 0, atol=1e-9)
    for _ in range(100):
        kf.step(-inertial.GRAVITY, np.array([0, 0, np.pi / 2]), 0.01)
    assert np.allclose(kf.rotation @ [1, 0, 0], [0, 1, 0], atol=1e-6)
    assert np.allclose(kf.p, kf.p.T) and np.linalg.eigvalsh(kf.p).min() > 0
    with pytest.raises(ValueError):
        kf.step(-inertial.GRAVITY, np.zeros(3), 0.0)


def test_inertial_bias_drifts_quadratically_and_updates_correct():
    kf = inertial.Inertial()
    for _ in range(1000):
        kf.step(np.array([0.1, 0, 9.80665]), np.zeros(3), 0.01)
    assert kf.x[0] == pytest.approx(0.5 * 0.1 * 100, rel=1e-2)
    assert kf.see_standstill() and abs(kf.x[3]) < 0.6
    free = inertial.Inertial()
    assert not free.see_position(np.array([500.0, 0, 0]), 1.0) and free.x[0] == 0
    assert free.see_position(np.array([3.0, 0, 0]), 1.0) and 2 < free.x[0] < 3
    assert free.see_speed(0.5, 0.1)


def test_quaternions():
    rng = np.random.default_rng(0)
    a, b = (inertial.turn(rng.normal(size=3)) for _ in range(2))
    assert np.allclose(inertial.matrix(inertial.product(a, b)), inertial.matrix(a) @ inertial.matrix(b))
    assert np.allclose(inertial.turn(np.full(3, 1e-10)), [1, 0, 0, 0], atol=1e-9)
    for up in ([0, 0, 1], [0, 0, -2], [1, 2, 3], [1, 0, 0]):
        r = inertial.levelling(np.array(up, dtype=float))
        assert np.allclose(r @ up / np.linalg.norm(up), [0, 0, 1]) and np.linalg.det(r) == pytest.approx(1.0)


def imu(key, n, start=0):
    i = np.arange(start, start + n)
    return pd.DataFrame({"key": key, "ns": i * 100_000_000, "ax": 0.3 * (i > 60), "ay": 0.0, "az": 9.80665, "gx": 0.0, "gy": 0.0, "gz": 0.01 * (i % 3)})


def test_engine_state_carries_over():
    whole, parts = inertial.Engine(), inertial.Engine()
    rows = imu("a", 120)
    want = filters.engine_rows(whole, "a", rows)
    got = []
    for start in range(0, 120, 7):
        parts = inertial.Engine(parts.state() if start else None)
        got += filters.engine_rows(parts, "a", rows.iloc[start : start + 7])
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert np.allclose([w[3:] for w in want], [g[3:] for g in got])
    assert want[30][2] == "CALIBRATING" and want[31][2] == "RUNNING"
    assert parts.sample(5, np.zeros(3), np.zeros(3)) is None and parts.dropped == 1
    assert not inertial.Engine().fix(np.zeros(3), 1.0)


def test_engine_takes_fixes_and_speeds():
    """Alone or beside a sample; refused before calibration and where they are far off."""
    rows = imu("a", 60)
    aid = {"fix_x": 0.5, "fix_y": 0.0, "fix_z": 0.0, "fix_var": 0.01}
    alone = pd.DataFrame([{"key": "a", "ns": ns, **aid} for ns in (1_050_000_000, 5_050_000_000)] + [{"key": "a", "ns": 5_060_000_000, **aid, "fix_x": 9000.0}])
    got = filters.engine_rows(inertial.Engine(), "a", pd.concat([rows, alone]).sort_values("ns", kind="stable"))
    plain = filters.engine_rows(inertial.Engine(), "a", rows)
    modes = [r[2] for r in got if r[2] not in ("CALIBRATING", "RUNNING")]
    assert modes == ["REFUSED", "AIDED", "REFUSED"] and len(got) == len(plain) + 3
    last, free = np.array(got[-1][3:6]), np.array(plain[-1][3:6])
    assert abs(last[0] - 0.5) < 0.2 < abs(free[0] - 0.5)
    shaken = rows.assign(ax=0.5 * (-1.0) ** np.arange(60) * (np.arange(60) > 31))  # calibrated at rest, then shaken but on the whole not moving
    slow, fast = (filters.engine_rows(inertial.Engine(), "a", r)[-1] for r in (shaken, shaken.assign(speed=0.4, speed_var=0.01)))
    assert slow[6] < 0.1 and fast[6] == pytest.approx(0.4, abs=0.1)


def test_many_keys_side_by_side_equal_one_by_one():
    """Keys of unequal length, some at rest, with gated fixes and speeds and late samples."""
    rng = np.random.default_rng(0)
    codes = np.repeat(np.arange(6), [1, 80, 7, 50, 41, 80])
    n = len(codes)
    forward, lateral, yaw, speed, logvar = rng.normal(0, 1, (5, n))
    still, v0, h0 = rng.random(n) < 0.4, rng.uniform(0, 4, 6), rng.uniform(0, 6, 6)
    start, after = planar.run_keys(codes, forward, lateral, yaw, still, v0, h0, 0.1, 4 * speed, logvar)
    d = pd.DataFrame({"key": codes, "ns": np.arange(n) * 100_000_000 - 300_000_000 * (rng.random(n) < 0.05)})
    d[list(filters.SAMPLE)] = rng.normal(0, 0.1, (n, 6)) * np.where(codes % 2, 0.01, 1.0)[:, None] + [0, 0, 9.8, 0, 0, 0]
    d[list(filters.FIX)] = np.c_[rng.normal(0, 2, (n, 3)), np.where(rng.random(n) < 0.2, 4.0, np.nan)]
    d[list(filters.SPEED)] = np.c_[rng.normal(0, 2, n), np.where(rng.random(n) < 0.2, 0.5, np.nan)]
    d.loc[rng.random(n) < 0.05, "ax"] = np.nan
    got = filters.fleet_rows(inertial.Fleet(6), codes, d)
    assert set(got["mode"]) == {"CALIBRATING", "RUNNING", "AIDED", "REFUSED"} and len(got) < n
    for k in range(6):
        m = codes == k
        one = planar.run(forward[m], lateral[m], yaw[m], still[m], v0[k], h0[k], 0.1, 4 * speed[m], logvar[m])
        assert np.allclose(np.concatenate([start[k : k + 1], after[m]]), one)
        want, mine = filters.engine_rows(inertial.Engine(), k, d[m]), got[got["key"] == k].to_numpy()
        assert [w[1:3] for w in want] == [tuple(r) for r in mine[:, 1:3]]
        assert np.allclose(np.array([w[3:] for w in want], dtype=float).reshape(-1, 6), mine[:, 3:].astype(float))


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_whole_keys(size):
    keys = ["a"] * 2 + ["b"] * 120 + ["c"] + ["d"] * 30 + [None] * 3
    d = pd.DataFrame({"key": keys, "i": range(len(keys))})
    got = list(filters.whole_keys(iter([d.iloc[:0], *(d.iloc[a : a + size] for a in range(0, len(d), size))]), 40))
    assert pd.concat(got, ignore_index=True).equals(d)
    assert sum(len(set(filters.numbered(g["key"]))) for g in got) == 5 and len(got) > 1
    assert not list(filters.whole_keys(iter([])))


def test_filters_over_spark_keep_each_key_apart(spark):
    rows = pd.concat([pd.DataFrame({"key": k, "i": range(n), "ax": 0.1 * n, "ay": 0.0, "gz": 0.01, "is_stationary": False, "v0": float(n), "h0": 0.0}) for k, n in (("a", 5), ("b", 1), ("c", 9))])
    got = sorted(tuple(r) for r in filters.planar_filter(spark.createDataFrame(rows)).collect())
    want = []
    for k, d in rows.groupby("key"):
        track = planar.run(*(d[c].to_numpy() for c in ("ax", "ay", "gz", "is_stationary")), d["v0"].iloc[0], 0.0, 0.1)
        want += [(k, i, *xs) for i, xs in enumerate(track.tolist())]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want])
    empty = spark.createDataFrame(rows).where("false")
    assert not filters.planar_filter(empty).count()


def test_engine_batch_equals_stream(spark, tmp_path):
    from kinelake.streaming import engine

    rows = pd.concat([imu("a", 80), imu("b", 60)]).assign(fix_x=float("nan"), fix_y=0.0, fix_z=0.0, fix_var=4.0, speed=float("nan"), speed_var=0.5)
    rows.loc[rows["ns"] % 700_000_000 == 0, "fix_x"] = 0.3
    rows.loc[rows["ns"] % 500_000_000 == 0, "speed"] = 0.1
    schema = "key string, ns long, ax double, ay double, az double, gx double, gy double, gz double, fix_x double, fix_y double, fix_z double, fix_var double, speed double, speed_var double"
    batch = sorted(filters.inertial_engine(spark.createDataFrame(rows, schema)).collect())
    folder = str(tmp_path / "in")
    for k, cut in enumerate((rows[rows["ns"] < 4_000_000_000], rows[rows["ns"] >= 4_000_000_000])):
        spark.createDataFrame(cut, schema).coalesce(1).write.parquet(f"{folder}/part{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    query = engine.run_engine(stream).writeStream.format("memory").queryName("engine_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(spark.table("engine_out").collect())
    assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in batch]
    assert np.allclose([tuple(r)[3:] for r in got], [tuple(r)[3:] for r in batch])


def test_sessions_and_ingest_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinelake.operators.ingest import UPLOAD_SCHEMA
    from kinelake.streaming import engine

    times = [0.0, 0.2, 0.4, 2.0, 2.1, 60.0]
    spark.createDataFrame([("a", t) for t in times], "key string, s double").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts")).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "s"))
    q = engine.sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("sessions_out").collect()) == [2, 3]
    good = ([[0.0, 0.0, 9.8, 0.1, 0.1, 0.1]] * 3, 20.0, 2.0, "m", "1", "1.0")
    spark.createDataFrame([("d", True, [good, good]), ("e", False, [good])], UPLOAD_SCHEMA).write.json(str(tmp_path / "u"))
    engine.ingest(engine.read_uploads(spark, str(tmp_path / "u")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out") + "/batch=*")
    assert out.count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).where("accepted = 'true'").count() == 2


def fixes(n=120, seed=1, noise=4.0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"i": np.arange(n * 10), "te": 0.0, "tn": np.arange(n * 10) * 1.5}), rng


def test_detector_sees_steps_and_rests_on_clean_tracks():
    track, _ = fixes()
    clean = filters.inject(track, "step", 0.0, 3)
    hit = filters.inject(track, "step", 80.0, 3)
    stats = []
    for d in (clean, hit):
        v = d[d["valid"]]
        stats.append(filters.residual_statistic(v["i"].to_numpy() / 10, v["east_m"].to_numpy(), v["north_m"].to_numpy()))
    assert np.isnan(stats[0][:4]).all() and np.nanquantile(stats[0], 0.95) < 3
    assert stats[1][20:23].max() > 5
    gap = filters.residual_statistic(np.array([0, 1, 2, 3, 4, 5, 15, 16, 17, 18, 19, 20, 21.0]), np.zeros(13), np.zeros(13))
    assert np.isfinite(gap[4:6]).all() and np.isnan(gap[6:12]).all() and np.isfinite(gap[12])


def test_injected_faults():
    track, _ = fixes()
    jam = filters.inject(track, "jam", 10.0, 1)
    assert not jam["valid"][200:300].any() and jam["attacked"].sum() == 100 and jam["valid"].sum() == 110
    drag = filters.inject(track, "drag", 1.0, 1)
    off = np.hypot(drag["east_m"] - drag["te"], drag["north_m"] - drag["tn"])
    assert off[1199] == pytest.approx(99.9, abs=0.2) and off[101] == 0
    part = filters.inject(track, "multipath", 0.5, 1)
    assert 0.4 < part["attacked"][200:].mean() < 0.6 and not part["attacked"][:200].any()
    assert filters.inject(track, "multipath", 0.5, 1).equals(part)


def test_roc_over_spark(spark):
    from pyspark.sql import functions as F

    from kinelake.operators import evaluation

    track, _ = fixes()
    tracks = spark.createDataFrame(pd.concat([track.assign(key=str(k)) for k in range(3)]))
    attacks = spark.createDataFrame([("step", 80.0, 1), ("step", 0.5, 2), ("jam", 5.0, 3)], "family string, param double, seed long")
    rows = filters.inject_attacks(tracks, attacks).where("valid").select(F.col("instance").alias("key"), F.col("instance"), "family", "param", "attacked", (F.col("i") / 10).alias("t"), "east_m", "north_m")
    stats = filters.reachable(filters.fault_statistic(rows)).cache()
    clean = stats.where("not attacked and not isnan(stat) and t < 20").select("stat")
    curve = evaluation.roc(stats, clean)
    at = curve.where("false_rejection <= 0.1").groupBy("family", "param").agg(F.max("detection").alias("detection"))
    got = {(r["family"], r["param"]): r["detection"] for r in at.collect()}
    assert got["step", 80.0] == 1.0 and got["step", 0.5] <= 0.67
    limits = {r["family"]: r["undetected_up_to"] for r in evaluation.provably_undetected(at).collect()}
    assert limits["step"] in (0.5, None)
    assert filters.reacquisition_rejections(stats, 1e9).first()[0] == 0.0
    checked = evaluation.check_curves(at, at.withColumn("detection", F.col("detection") - 0.5))
    assert not checked.where("ok").count()


def test_fault_detector_covers_every_user(spark):
    from kinelake.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = {(r["key"], r["i"]): r for r in queries.paths(spark, sf).collect()}
    fixes_of = {}
    for r in queries.fault_detector(spark, sf).collect():
        fixes_of.setdefault(r["key"], []).append(r)
    users = {key for key, _ in rows}
    assert max(users) >= 10 and len(fixes_of) == 4 * len(users)
    for instance, got in fixes_of.items():
        user, family, param, seed = instance.split(":")
        n = sum(key == int(user) for key, _ in rows)
        track = pd.DataFrame([{"i": i, "te": rows[int(user), i]["te"] / 100, "tn": rows[int(user), i]["tn"] / 100} for i in range(n)])
        want = filters.inject(track, family, float(param), int(seed))
        want = want[want["valid"]]
        stat = filters.residual_statistic(want["i"].to_numpy() / 10, want["east_m"].to_numpy(), want["north_m"].to_numpy())
        got = sorted(got, key=lambda r: r["t"])
        assert [r["t"] for r in got] == pytest.approx((want["i"] / 10).tolist())
        assert [np.nan if r["stat"] is None else r["stat"] for r in got] == pytest.approx(stat.tolist(), nan_ok=True)


def test_statistics_of_many_keys_side_by_side():
    """As the test for one key, fix by fix, over keys of unlike length with gaps, still keys and single fixes."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 5, 40, 0, 300, 9, 1]
    t = [np.cumsum(rng.choice([0.4, 1.0, 6.0], n, p=[0.5, 0.45, 0.05])) for n in sizes]
    at = [rng.normal(0, 4, (n, 2)) + np.outer(np.arange(n), [1.0, k]) * (k != 3) + 60 * (np.arange(n) > 20)[:, None] for k, n in enumerate(sizes)]
    want = []
    for times, places in zip(t, at, strict=True):
        test = None
        for k in range(len(times)):
            if not k or times[k] - times[k - 1] > filters.GAP_RESET_S:
                test, stat = filters.DriftTest(5 if k else 3), np.nan
            else:
                stat = test.fix(places[k] - places[k - 1], times[k] - times[k - 1])
            want.append(stat)
    codes = np.repeat(np.arange(len(sizes)), sizes)
    got = filters.residual_statistics(codes, np.concatenate(t), *np.concatenate(at).T)
    assert got == pytest.approx(np.array(want), nan_ok=True, rel=1e-12)


def test_attacks_meet_tracks_in_their_tasks(spark):
    """No track is shuffled once an attack; null keys are a track, rows that aren't fixes can stay behind."""
    tracks = spark.createDataFrame([(k, i, 1.0 * i, 2.0 * i) for k in ("a", None) for i in range(250)], "key string, i long, te double, tn double")
    attacks = spark.createDataFrame([("step", 80.0, 1), ("jam", 5.0, 3)], "family string, param double, seed long")
    rows = filters.inject_attacks(tracks, attacks)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r[0]: r[1] for r in rows.groupBy("instance").count().collect()} == dict.fromkeys(["a:step:80.0:1", "a:jam:5.0:3", "step:80.0:1", "jam:5.0:3"], 250)
    fixes = filters.inject_attacks(tracks, attacks, fixes_only=True)
    assert sorted(map(str, fixes.collect())) == sorted(map(str, rows.where("valid").collect()))


def test_keys_stay_whole_after_a_join_by_key(spark):
    """The shuffle by key is left in place though the rows come from a join by key."""
    from pyspark.sql import functions as F

    rows, more = (spark.range(50).select((F.col("id") % 5).alias("key"), F.col("id").alias(c)).hint("merge") for c in ("i", "v"))
    plan = filters.by_key_in_order(rows.join(more, "key"), "i")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_faults_reach_short_tracks(spark):
    """Every user's track is attacked though it ends before 20 s: fixes move or go, and so do their statistics."""
    from kinelake.plans import queries

    assert [filters.onset_row(n) for n in (1, 99, 200, 201, 900)] == [1, 50, 100, 200, 200]
    assert [filters.onset_row(n, 12.0) for n in (99, 900)] == [120, 120]
    sf = "/root/testdata/sf0.001"
    sizes = {r["key"]: r["count"] for r in queries.paths(spark, sf).groupBy("key").count().collect()}
    assert max(sizes.values()) < 200
    fixes_of = {}
    for r in queries.fault_detector(spark, sf).collect():
        fixes_of.setdefault(r["key"], []).append(r)
    for instance, got in fixes_of.items():
        user, family, _, _ = instance.split(":")
        onset = (sizes[int(user)] + 1) // 2 / 10
        late = {r["t"] for r in got if r["t"] >= onset}
        assert {r["t"] for r in got if r["attacked"]} == late if family in ("step", "drag") else {r["t"] for r in got if r["attacked"]} <= late
        assert family != "jam" or not any(onset <= t < onset + 2 for t in late)
    step, drag = ([r["stat"] for k in fixes_of if f":{family}:" in k for r in fixes_of[k] if r["attacked"] and r["stat"] is not None and not np.isnan(r["stat"])] for family in ("step", "drag"))
    assert len(step) > 10 and np.quantile(step, 0.9) > 1.5 * np.quantile(drag, 0.9)
    assert any(r["attacked"] for k in fixes_of if ":multipath:" in k for r in fixes_of[k])
