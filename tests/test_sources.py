import json

import pytest

from kinelake import schema
from kinelake.operators import ingest
from kinelake.sources import artefacts, recordings, replay

HEAD = ",".join(schema.REPLAY_COLUMNS)
ROW = "{t},0.1,0.2,9.8,0.0,0.0,{g},1,2,3,{v},{fix}"


def row(t, g="0.1", v=1, fix="50.0,1.0,2.0,3.0"):
    return ROW.format(t=t, g=g, v=v, fix=fix)


def rules(spark, tmp_path, text, mode):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    return {(r["line"], r["rule"]) for r in replay.violations(replay.read_lines(spark, str(path)), mode).collect()}


GOOD = "\n".join([HEAD, row(100), row(200, v=0, fix=",,,"), row(300)]) + "\n"
CASES = [
    (GOOD, set(), set()),
    ("﻿" + GOOD, {(0, "byte_order_mark")}, {(0, "byte_order_mark")}),
    (GOOD.replace("\n", "\r\n", 1), {(0, "carriage_return")}, {(0, "carriage_return")}),
    (GOOD.replace("accel_x,accel_y", "accel_y,accel_x"), {(0, "columns")}, {(0, "columns")}),
    (GOOD.replace("3.0\n", "3.0,7\n", 1), {(1, "field_count")}, {(1, "field_count")}),
    (GOOD.replace("0.2", "x", 1), {(1, "not_a_number")}, {(1, "not_a_number")}),
    (GOOD.replace("0.2", "", 1), {(1, "empty_field")}, {(1, "empty_field")}),
    (GOOD.replace(row(200, v=0, fix=",,,"), row(200, v=0, fix="50.0,,,")), {(2, "fix_without_valid")}, {(2, "fix_without_valid")}),
    ("\n".join([HEAD, row(100, fix="50.0,,2.0,3.0")]), set(), {(1, "valid_without_fix")}),
    ("\n".join([HEAD, row(100), row(100)]), set(), {(2, "time_order")}),
    ("\n".join([HEAD, row(100), row(90)]), {(2, "time_order")}, {(2, "time_order")}),
    ("\n".join([HEAD, row(100, g="10")]), set(), {(1, "rotation")}),
    ("\n".join([HEAD, row(100, g="-11")]), {(1, "rotation")}, {(1, "rotation")}),
    ("\n".join([HEAD, row(100, v=2)]), {(1, "gnss_valid")}, {(1, "gnss_valid")}),
    ("\n".join([HEAD, row(100, fix="95.0,1.0,2.0,3.0")]), set(), {(1, "gnss_lat_range")}),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_replay_rules(spark, tmp_path, number):
    text, lenient, strict = CASES[number]
    assert rules(spark, tmp_path, text, "lenient") == lenient
    assert rules(spark, tmp_path, text, "strict") == strict


def test_replay_round_trip_and_events(spark, tmp_path):
    made = replay.sample_rows(spark)
    (tmp_path / "r.csv").write_text(HEAD + "\n" + "\n".join(",".join("" if v is None else str(v) for v in r) for r in made.orderBy("timestamp_ms").collect()) + "\n")
    rows = replay.load(spark, str(tmp_path / "r.csv"))
    assert rows.count() == 30 and rows.where("gnss_lat is null").count() == 10
    found = replay.events(rows)
    counts = {r["kind"]: r["n"] for r in replay.event_counts(found).collect()}
    assert counts == {"accelerometer": 30, "gyroscope": 30, "magnetometer": 30, "gnss_fix": 20}
    first = found.orderBy("ns", "ord").limit(4).collect()
    assert [r["kind"] for r in first] == ["accelerometer", "gyroscope", "magnetometer", "gnss_fix"]
    (tmp_path / "bad.csv").write_text(HEAD + "\n" + row(1, g="x") + "\n")
    with pytest.raises(ValueError, match="bad.csv:2 not_a_number"):
        replay.load(spark, str(tmp_path / "bad.csv"))


def recording(columns, values, n):
    lines = [", ".join(f"col {i} °" for i in range(columns)) + ","]
    lines += [", ".join(values[i] if i in values else str(float(k)) for i in range(columns)) + "," for k in range(n)]
    return ("\n".join(lines) + "\n").encode("cp1252")


def test_recordings(spark, tmp_path):
    for folder in ("A", "B"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "S-Vw1.csv").write_bytes(recording(24 if folder == "A" else 18, {6: "16 / 18", 8: "2019-01-01", 1: "oops"}, 30))
        (tmp_path / folder / "v-Vw1.csv").write_bytes(recording(29, {}, 25))
    (tmp_path / "A" / "S-tiny.csv").write_bytes(b"x")
    (tmp_path / "C").mkdir()
    (tmp_path / "C" / "S-x.csv").write_bytes(recording(7, {}, 200))
    (tmp_path / "C" / "V-x.csv").write_bytes(recording(29, {}, 25))
    phone, vehicle, rejected = recordings.load_pairs(spark, str(tmp_path))
    ids = {r["seq_id"] for r in vehicle.select("seq_id").distinct().collect()}
    assert ids == {"vw1_a", "vw1_b", "x"}
    assert [r["reason"] for r in rejected.collect()] == ["columns: 7"]
    rows = {(r["seq_id"], r["row_idx"]): r for r in phone.collect()}
    assert len(rows) == 60
    one = rows["vw1_b", 9]
    assert one["gps_sats"] == 16.0 and one["gps_speed_mps"] == pytest.approx(9 / 3.6) and one["gps_lon_deg"] != one["gps_lon_deg"] and one["mag_x_ut"] != one["mag_x_ut"]
    assert rows["vw1_a", 9]["mag_x_ut"] == 9.0
    v = vehicle.where("seq_id = 'vw1_a' and row_idx = 2").first()
    assert v["long_accel_mps2"] == pytest.approx(2 * 9.80665) and v["speed_mps"] == pytest.approx(2 / 3.6)


def test_phone_only(spark, tmp_path):
    for folder, name, columns in (("A", "S-S3a.csv", 24), ("B", "s-s3A.csv", 18), ("B", "S-Vw2.csv", 24), ("B", "S-odd.csv", 7)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(recording(columns, {8: "2019-01-01"}, 200 if columns == 7 else 30))
    phone, rejected = recordings.load_phone_only(spark, str(tmp_path))
    counts = {r["seq_id"]: r["count"] for r in phone.groupBy("seq_id").count().collect()}
    assert counts == {"s3a_a": 30, "s3a_b": 30, "vw2": 30}
    assert [(r["path"].rsplit("/", 1)[-1], r["reason"]) for r in rejected.collect()] == [("S-odd.csv", "columns: 7")]
    assert phone.where("seq_id = 'vw2' and row_idx = 9").first()["gps_speed_mps"] == pytest.approx(9 / 3.6)


def test_artefacts(spark, tmp_path):
    for name, version, signature in (("a.json", "1.2.0", "x"), ("b.json", "1.10.1", ""), ("c.json", "2.0.0", "y"), ("d.json", "bad", "z")):
        (tmp_path / name).write_text(json.dumps({"version": name[0], "contract_version": version, "signature": signature}))
    models = artefacts.read_json(spark, str(tmp_path / "*.json"))
    assert artefacts.latest_by_name(models).first()["version"] == "d"
    assert sorted(r["version"] for r in artefacts.compatible_models(models, "1.2.0").collect()) == ["a", "b"]
    assert artefacts.latest_model(models).first()["version"] == "d"
    assert artefacts.latest_model(models, spark.createDataFrame([("b",)], "version string")).first()["version"] == "b"
    assert artefacts.refuse_unsigned(models, False).count() == 3 and artefacts.refuse_unsigned(models, True).count() == 4
    norm = spark.createDataFrame([(["ax", "ay"], [0.0, 1.0], [1.0, 2.0])], "order array<string>, mean array<double>, std array<double>")
    assert artefacts.normaliser_rows(norm, ["ax", "ay"]).count() == 2
    with pytest.raises(ValueError):
        artefacts.normaliser_rows(norm, ["ay", "ax"])
    with pytest.raises(LookupError):
        artefacts.map_extract(spark.createDataFrame([], "region string, version string"), ["north"], "north", False)
    artefacts.save_new(norm, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists"):
        artefacts.save_new(norm, str(tmp_path / "once"))


def test_upload_rules(spark):
    good = ([[0.0, 0.0, 9.8, 0.1, 0.1, 0.1]] * 20, 20.0, 2.0, "m", "1", "1.0")
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("w", "d", "s", "m", "a", "c"), good, strict=True))
    cases = {None: good, "contract_version": change(c="2.0"), "shape": change(w=[[0.0] * 5]), "not_finite": change(w=[[float("nan")] * 6]), "duration": change(s=0.0), "mean_speed": change(d=900.0), "accel": change(w=[[200.0] + [0.0] * 5]), "gyro": change(w=[[0.0] * 3 + [57.0] * 3])}
    uploads = spark.createDataFrame([("dev", True, list(cases.values())), ("no", False, [good]), ("none", None, [change(w=None)])], ingest.UPLOAD_SCHEMA)
    judged = ingest.judged_pairs(uploads)
    assert [r["reason"] for r in judged.where("device_id_hash = 'dev'").collect()] == list(cases)
    got = {r["device_id_hash"]: (r["accepted"], r["rejected"], r["reasons"]) for r in ingest.verdicts(judged).collect()}
    assert got["dev"] == (1, 7, sorted(k for k in cases if k)) and got["no"] == (0, 1, ["consent"]) == got["none"]


def test_files_are_read_in_stretches_and_numbered_across_them(spark, tmp_path):
    import csv
    import io

    (tmp_path / "A").mkdir()
    n = 3000
    (tmp_path / "A" / "S-a b+c.csv").write_bytes(recording(24, {8: "2019-01-01"}, n).replace(b"\n7.0,", b"\n, ,\n\n7.0,", 1))
    quoted = recording(29, {1: '"1\n2"', 2: '"3, 4"'}, n)
    (tmp_path / "A" / "V-a.csv").write_bytes(quoted)
    (tmp_path / "A" / "V-bad.csv").write_bytes(recording(29, {}, 60).replace(b"5.0", b"\x81.0"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert recordings.load_text(spark, str(tmp_path), "S")[0].rdd.getNumPartitions() > 5
        rows, heads = recordings.load_text(spark, str(tmp_path), "S")
        got = sorted((r["row_idx"], r["cells"][0], len(r["cells"])) for r in rows.collect())
        assert got == [(i, str(float(i)), 24) for i in range(n)]
        rows, heads = recordings.load_text(spark, str(tmp_path), "V")
        want = list(csv.reader(io.StringIO(quoted.decode("cp1252")), skipinitialspace=True))[1:]
        got = {r["row_idx"]: r["cells"] for r in rows.collect()}
        assert len(got) == n and all(got[i] == w[:29] for i, w in enumerate(want))
        assert sorted((r["path"].rsplit("/", 1)[-1], len(r["header"]), r["error"] is None) for r in heads.collect()) == [("V-a.csv", 29, True), ("V-bad.csv", 29, False)]
        phone, _, rejected = recordings.load_pairs(spark, str(tmp_path))
        assert phone.select("seq_id").distinct().first()[0] == "abc" and rejected.count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_credible_values_equal_the_quantile(spark):
    import random

    draw = random.Random(4)
    rows = []
    for g in range(60):
        n = draw.choice([1, 2, 3, 200, 201, 202, 401])
        high = draw.randrange(4)
        rows += [(f"g{g}", draw.uniform(10, 11) if i < high else draw.uniform(0, 9.999)) for i in range(n)]
    rows += [("none", None), ("none", float("nan"))]
    from pyspark.sql import functions as F

    from kinelake.functions.scalar import gyro_sanity

    table = spark.createDataFrame(rows, "seq_id string, x double")
    want = {r["seq_id"]: (r["largest"], r["spikes"], r["sane"]) for r in gyro_sanity(table, "x", ["seq_id"]).collect()}
    got = {r["seq_id"]: tuple(r["c"]) for r in table.groupBy(F.col("seq_id")).agg(recordings.credible("x", 10.0, True).alias("c")).collect()}
    assert got == want and {w[2] for w in want.values()} == {True, False}
