"""Readers and writers on files that the tests write."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.sources import matrices, recordings, stores, tables

from test_signal import bdf


def element(kind, data, order="<"):
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, value, order="<", kind=9, cls=6):
    head = lambda c, shape: element(6, struct.pack(order + "II", c, 0), order) + element(5, np.array(shape, order + "i4").tobytes(), order) + element(1, name.encode(), order)
    if isinstance(value, list):
        return element(14, head(1, [1, len(value)]) + b"".join(matrix("", v, order) for v in value), order)
    dtype = order + matrices.NUMBERS[kind]
    return element(14, head(cls, value.shape) + element(kind, value.astype(dtype).tobytes(order="F"), order), order)


def mat(*variables, packed=False, order="<"):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI")
    return head + b"".join(struct.pack(order + "II", 15, len(z)) + z if packed else v for v in variables for z in [zlib.compress(v)])


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_mat_numbers_and_cells(order, packed):
    x = np.arange(12.0).reshape(4, 3)
    small = np.array([[7, -8]])
    got = dict(matrices.decode_mat(mat(matrix("x", x, order), matrix("s", small, order, kind=3), matrix("c", [x, small * 1.0], order), packed=packed, order=order)))
    assert (got["x"] == x).all() and (got["s"] == small).all() and (got["c"][0] == x).all() and (got["c"][1] == small).all()


def test_read_matrices_and_malformed_files(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.mat").write_bytes(mat(matrix("x", x)))
    (tmp_path / "b.mat").write_bytes(mat(matrix("x", np.zeros((3, 5)))))
    (tmp_path / "c.mat").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(b"no recording")
    fine, errors = stores.counted_errors(matrices.read_matrices(spark, str(tmp_path), ["Fz", "Cz"]), stores.run_log(str(tmp_path / "run.log")))
    assert {(r["channel"], tuple(r["samples"])) for r in fine.collect()} == {("Fz", (0.0, 2.0, 4.0)), ("Cz", (1.0, 3.0, 5.0))}
    assert sum(errors.values()) == 2 and any("2 columns" in e for e in errors)
    assert "2 columns" in (tmp_path / "run.log").read_text()


def test_read_cells_of_either_orientation(spark, tmp_path):
    x = np.arange(24.0).reshape(2, 4, 3)  # subjects x samples x channels
    (tmp_path / "a.mat").write_bytes(mat(matrix("c", [np.zeros((1, 1)), x])))
    (tmp_path / "b.mat").write_bytes(mat(matrix("c", [np.zeros((1, 1)), x.transpose(0, 2, 1)]), packed=True))
    got = matrices.read_cells(spark, str(tmp_path), 2, ["a", "b", "c"]).collect()
    assert len(got) == 12 and all(r["samples"] == x[r["subject"] - 1, :, "abc".index(r["channel"])].tolist() for r in got)


def test_trials_of_several_parts_meet_labels_by_position(spark, tmp_path):
    n = {1: 3, 2: 2, 10: 4}
    base = 0
    for k in (1, 2, 10):  # numeric order, not that of names
        x = np.array([[[base + t, c, 0.0] for c in range(2)] for t in range(n[k])], float)
        (tmp_path / f"d{k}.mat").write_bytes(mat(matrix("d", x)))
        base += n[k]
    trials = matrices.read_trials(spark, str(tmp_path), ["u", "v"])
    labels = spark.createDataFrame([(i, i * 10) for i in range(1, 10)], "row long, code int")
    got = matrices.trials_with_labels(trials, labels).collect()
    assert len(got) == 18 and all(r["code"] == 10 * (r["samples"][0] + 1) for r in got)
    with pytest.raises(ValueError, match="9 trials and 8 labels"):
        matrices.trials_with_labels(trials, labels.filter("row < 9"))


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamps,Fz (uV),Cz(uV)\n0,1,2\n0.5,3,4\n1,inf,5\n")
    (tmp_path / "b.csv").write_text("CZ,timestamps,extra,fz\n20,0,9,10\n21,2,9,11\nx,3,9,12\n")
    (tmp_path / "c.csv").write_text("timestamps,Fz\n0,1\n")
    samples, rates = recordings.read_channel_csv(spark, str(tmp_path), ["Fz", "Cz"])
    got = sorted((r["path"][-5:], r["timestamps"], r["Fz"], r["Cz"]) for r in samples.collect())
    assert got == [("a.csv", 0, 1, 2), ("a.csv", 0.5, 3, 4), ("b.csv", 0, 10, 20), ("b.csv", 2, 11, 21)]
    assert {(r["path"][-5:], r["fs"], r["error"]) for r in rates.collect()} == {("a.csv", 2.0, None), ("b.csv", 0.5, None), ("c.csv", None, "no column Cz")}


def test_read_bdf_files(spark, tmp_path):
    values = [[0, -1, 8388607, -8388608], [1, 2, 3, -4]]
    (tmp_path / "a.bdf").write_bytes(bdf(values))
    (tmp_path / "b.bdf").write_bytes(b"short")
    fine, errors = stores.counted_errors(recordings.read_bdf(spark, str(tmp_path), ["cz", "FZ"]))
    gain = 200 / 16777215
    rows = {r["channel"]: r for r in fine.collect()}
    assert rows["cz"]["fs"] == 4 and rows["cz"]["samples"] == pytest.approx([(v + 8388608) * gain - 100 for v in values[1]])
    assert rows["FZ"]["samples"] == pytest.approx([(v + 8388608) * gain - 100 for v in values[0]]) and sum(errors.values()) == 1


def test_participants_texts_and_recordings(spark, tmp_path):
    (tmp_path / "p.csv").write_text("TDBRAIN_ID, Age ,gender,note\ns1,30.5,1,a\ns2,x,0\ns3,41,1,\"b,c\"\n")
    texts = tables.read_texts(spark, str(tmp_path / "p.csv"))
    assert [tuple(r) for r in texts.collect()][1] == ("s2", "x", "0", "")
    people = tables.read_participants(spark, str(tmp_path / "p.csv"), {"id": "tdbrain_id", "age": "AGE", "sex": "Gender"}, ("age", "sex"))
    assert [tuple(r) for r in people.collect()] == [("s1", 30.5, 1.0), ("s2", None, 0.0), ("s3", 41.0, 1.0)]
    with pytest.raises(ValueError, match="no column height"):
        tables.read_participants(spark, str(tmp_path / "p.csv"), {"h": "height"})
    files = spark.createDataFrame([("/d/s1/L1/x_2.csv",), ("/d/s1/L1/x_1.csv",), ("/d/s10/L1/x.csv",), ("/d/s3/y.csv",)], "path string")
    got = {r["id"]: r["recording"] for r in tables.with_recordings(people, "id", files).collect()}
    assert got == {"s1": "/d/s1/L1/x_1.csv", "s3": "/d/s3/y.csv"}


def test_metrics_and_experiment_rows(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.23456, None, 3), ("c", 2.0, 0.5, None)], "cohort string, bal double, bal_sd double, n int")
    recordings.write_metrics(df, str(tmp_path / "out"), ["cohort"])
    lines = sorted(line for f in (tmp_path / "out").glob("*.csv") for line in f.read_text().splitlines())
    assert "a;b,1.235,,3" in lines and "cohort,bal,bal_sd,n" in lines and any(line.startswith("c,2.000,0.500,") for line in lines)
    repeats = spark.createDataFrame([("A", 50.0, 1.0, 2.0, 0.5, 0.1), ("A", 60.0, 1.0, 4.0, 0.7, 0.3), ("B", 1.0, 1.0, 1.0, 1.0, 1.0)], "experiment string, bal double, sen double, spe double, auc double, mcc double")
    counts = spark.createDataFrame([("A", 5, 6), ("B", 7, 8)], "experiment string, n_pos int, n_neg int")
    rows = {r["experiment"]: r for r in recordings.experiment_rows(repeats, counts, spark.createDataFrame([("A", 0.01)], "experiment string, perm_p double")).collect()}
    assert rows["A"]["BAL"] == 55 and rows["A"]["BAL_sd"] == pytest.approx(50**0.5) and rows["A"]["perm_p"] == 0.01
    assert rows["B"]["AUC_sd"] == 0 and rows["B"]["perm_p"] is None and list(rows["A"].asDict()) == recordings.EXPERIMENT


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    """Rows later than the watermark of the batch before aren't counted."""
    from epochlake.streaming import windows

    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    at = lambda *minutes: spark.createDataFrame([("u", t0 + dt.timedelta(minutes=m), 1.0) for m in minutes], "k string, ts timestamp, value double")
    src = tmp_path / "in"
    for i, batch in enumerate([at(0, 5), at(600), at(3, 601)]):
        batch.coalesce(1).write.mode("append").parquet(str(src))
        out = windows.time_windows(spark.readStream.schema(batch.schema).parquet(str(src)), ["k"], "value", "10 minutes", late="30 minutes")
        found = {}
        q = out.writeStream.outputMode("update").foreachBatch(lambda df, k: found.update({r["start"]: r["n"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        if i == 0:
            assert found == {t0: 2}
    assert found == {t0 + dt.timedelta(minutes=600): 2}
