"""Snapshot files (S1-S4, S6, S8) and the model store."""

import os

import pytest

from immolens.sources import snapshots


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_list_and_latest(spark, tmpdir_path):
    for name in ("2023-10-01_data.csv", "2023-10-05_data.csv", "readme.txt", "image.png"):
        _write(os.path.join(tmpdir_path, name), "donnee\nvaleur\n")
    assert snapshots.list_raw_files(spark, tmpdir_path) == ["2023-10-05_data.csv",
                                                             "2023-10-01_data.csv"]
    _write(os.path.join(tmpdir_path, "2023-10-05_data.csv"), "donnee\nrecent\n")
    latest = snapshots.load_raw(spark, tmpdir_path, schema="donnee string")
    assert [r.donnee for r in latest.collect()] == ["recent"]


def test_scan_adds_extension_and_dir(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "annonces.csv"), "prix,ville\n100000,Paris\n200000,Lyon\n")
    df = snapshots.load_raw(spark, tmpdir_path, "annonces", schema="prix bigint, ville string")
    assert [(r.prix, r.ville) for r in df.collect()] == [(100000, "Paris"), (200000, "Lyon")]
    assert [r.ordinal for r in df.collect()] == sorted(r.ordinal for r in df.collect())


def test_missing_inputs_raise(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        snapshots.list_raw_files(spark, os.path.join(tmpdir_path, "nope"))
    with pytest.raises(FileNotFoundError):
        snapshots.load_raw(spark, tmpdir_path, "absent")


def test_zipcode_stays_text(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "z.csv"), "zipcode\n07200\n")
    df = snapshots.load_raw(spark, tmpdir_path, "z", schema="zipcode string")
    assert df.first().zipcode == "07200"


def test_clean_snapshots_latest_partition(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "clean")
    snapshots.write_clean(spark.createDataFrame([(1,)], "x int"), out, "2024-01-01")
    snapshots.write_clean(spark.createDataFrame([(2,), (3,)], "x int"), out, "2024-02-01")
    snapshots.write_clean(spark.createDataFrame([(4,)], "x int"), out, "2024-02-01")
    assert [r.x for r in snapshots.load_clean(spark, out).collect()] == [4]
    assert [r.x for r in snapshots.load_clean(spark, out, "2024-01-01").collect()] == [1]


def test_metrics_roundtrip(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "metrics")
    assert snapshots.load_metrics(spark, path)["r2"] is None
    snapshots.save_metrics(spark, {"mae": 1.5, "rmse": 2.5, "r2": 0.75, "method": "prix_brut"}, path)
    assert snapshots.load_metrics(spark, path) == {"mae": 1.5, "rmse": 2.5, "r2": 0.75,
                                                   "method": "prix_brut"}


def test_snapshot_row_count(spark, tmpdir_path):
    assert snapshots.snapshot_row_count(spark, os.path.join(tmpdir_path, "none")) == 0
    _write(os.path.join(tmpdir_path, "2024-01-01_x.csv"),
           'id,title,zipcode\n1,"deux\nlignes",07200\n2,b,13000\n')
    df = snapshots.raw_dataframe(spark, tmpdir_path, "2024-01-01_x", schema=snapshots.RAW_SCHEMA,
                                 multiline=True)
    assert df.count() == 2 and df.first().zipcode == "07200"
