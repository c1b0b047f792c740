"""Whole loads of the warehouse (S9, S11), hash keys (W4), snapshot files."""

import datetime as dt
import os

import pytest

from immolens.operators import marts, warehouse
from immolens.plans import jobs
from immolens.sources import manifest, snapshots
from immolens.sources.adapter import listings

SF = "/root/testdata/sf0.001"
CREATED = dt.datetime(2024, 1, 5)


def whole(tables):
    return {n: sorted(map(str, t.select(sorted(t.columns)).collect())) for n, t in tables.items()}


def test_a_load_that_dies_leaves_the_old_star(spark, tmpdir_path, monkeypatch):
    raw = listings(spark, SF)
    half = raw.where("id % 2 = 0")
    before = whole(jobs.build_warehouse(spark, half, tmpdir_path))

    def fail(*_):
        raise RuntimeError("lost")
    for mode in ("overwrite", "append"):
        with monkeypatch.context() as m:          # three tables are written, then it dies
            m.setitem(warehouse.DIMENSIONS, "dim_date", fail)
            with pytest.raises(RuntimeError):
                jobs.build_warehouse(spark, raw, tmpdir_path, mode)
        with monkeypatch.context() as m:
            m.setattr(marts, "fact_parts", fail)
            with pytest.raises(RuntimeError):
                jobs.build_warehouse(spark, raw, tmpdir_path, mode)
        assert whole(jobs.load_warehouse(spark, tmpdir_path)) == before
    assert manifest.current(spark, tmpdir_path)["version"] == 1
    with pytest.raises(FileNotFoundError):
        jobs.load_warehouse(spark, f"{tmpdir_path}/none")


@pytest.mark.parametrize("keys", ["sequence", "hash"])
def test_append_gives_the_marts_of_a_full_load(spark, tmpdir_path, keys):
    raw = listings(spark, SF)
    first = jobs.build_warehouse(spark, raw.where("id % 3 = 0"), tmpdir_path, keys=keys)
    old = whole({n: first[n] for n in warehouse.DIMENSIONS})
    both = jobs.build_warehouse(spark, raw, tmpdir_path, "append")
    again = jobs.build_warehouse(spark, raw, tmpdir_path, "append")
    assert whole(both) == whole(again)
    full = jobs.build_warehouse(spark, raw, f"{tmpdir_path}/full", keys=keys)
    for mart in marts.VIEWS.values():
        assert mart(both).collect() == mart(full).collect()
    for name, mart in marts.VIEWS.items():
        assert spark.table(name).collect() == mart(full).collect()
    assert all(r.violations == 0 for r in warehouse.integrity_audit(both).collect())
    for name in warehouse.DIMENSIONS:             # stored keys stay what they were
        assert set(old[name]) <= set(whole(both)[name])
    # the parts of the second load are of its facts alone
    content = manifest.current(spark, tmpdir_path)
    parts = [spark.read.parquet(p).agg({"n": "sum"}).first()[0] for p in content["tables"]["mart_parts"]]
    facts = [spark.read.parquet(p).count() for p in content["tables"]["fact_ads"]]
    assert parts == facts and len(facts) == 2
    # the first version can still be read
    assert whole(jobs.load_warehouse(spark, tmpdir_path, 1))["dim_type"] == old["dim_type"]


def test_hash_keys_do_not_depend_on_order_or_load(spark, tmpdir_path):
    listings(spark, SF).write.parquet(f"{tmpdir_path}/raw")
    raw = spark.read.parquet(f"{tmpdir_path}/raw")
    star = warehouse.build_star(raw, "hash")
    other = warehouse.build_star(raw.where("id % 2 = 1").repartition(5).sort("price"), "hash")
    for name, key in (("dim_location", "id_location"), ("dim_date", "id_date"), ("dim_type", "id_type")):
        assert set(map(str, other[name].collect())) <= set(map(str, star[name].collect()))
    sequence = warehouse.build_star(raw)
    assert star["fact_ads"].columns == sequence["fact_ads"].columns
    assert star["fact_ads"].count() == sequence["fact_ads"].count()
    plan = star["fact_ads"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1               # of the first listings, not of dimensions
    odd = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("a", "a")], "x string, y string")
    from immolens.operators.keys import hash_ids
    assert hash_ids(odd, ["x", "y"], "k").select("k").distinct().count() == 4


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_quoted_newlines_are_found(spark, tmpdir_path):
    write(f"{tmpdir_path}/raw/2024-01-01_x.csv",
          'id,title,zipcode\n1,"deux\nlignes, ""belles""",07200\n2,b,13000\n')
    assert snapshots.snapshot_row_count(spark, f"{tmpdir_path}/raw") == 2
    rows = snapshots.load_raw(spark, f"{tmpdir_path}/raw", schema=snapshots.RAW_SCHEMA)
    assert [r.title for r in rows.orderBy("ordinal").collect()] == ['deux\nlignes, "belles"', "b"]
    write(f"{tmpdir_path}/raw/2024-01-02_x.csv", 'id,title,zipcode\n1,"a, b",07200\n2,"c""d",1\n3,,\n')
    assert not snapshots.has_quoted_newlines(spark, f"{tmpdir_path}/raw/2024-01-02_x.csv")
    assert snapshots.snapshot_row_count(spark, f"{tmpdir_path}/raw") == 3


def test_clean_snapshots_in_both_forms(spark, tmpdir_path):
    out = f"{tmpdir_path}/clean"
    one = spark.createDataFrame([(1, 2.5, True, "a")], "x int, y double, z boolean, t string")
    two = spark.createDataFrame([(7, 1.0, None, 'two\nlines, "quoted"'), (8, None, False, "b")],
                                "x int, y double, z boolean, t string")
    with pytest.raises(Exception):
        snapshots.load_clean(spark, out)
    snapshots.write_clean(one, out, "2024-01-01")
    snapshots.write_clean(two, out, "2024-02-01", fmt="csv")
    assert sorted(map(tuple, snapshots.clean_snapshots(spark, out).collect())) == [
        ("2024-01-01", "parquet"), ("2024-02-01", "csv")]
    for schema in (None, two.schema):
        back = snapshots.load_clean(spark, out, schema=schema)
        assert back.dtypes == two.dtypes
        assert sorted(map(str, back.collect())) == sorted(map(str, two.collect()))
    assert [tuple(r) for r in snapshots.load_clean(spark, out, "2024-01-01").collect()] == [
        (1, 2.5, True, "a")]
    snapshots.write_clean(one, out, "2024-02-01")               # now in both: parquet counts
    assert snapshots.load_clean(spark, out).count() == 1
    with pytest.raises(FileNotFoundError):
        snapshots.load_clean(spark, out, "2030-01-01")


def test_reading_in_order_is_one_scan(spark, tmpdir_path):
    write(f"{tmpdir_path}/2024-01-01_x.csv", "id,v\n" + "".join(f"{i % 7},{i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {}
    try:
        for split in ("128m", "300b", "37b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            rows = snapshots.raw_dataframe(spark, tmpdir_path, "2024-01-01_x", schema="id int, v int",
                                           multiline=False)
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Relation") == 1 and "Join" not in plan
            got[split] = [r.v for r in rows.repartition(3).orderBy("ordinal").collect()]
            assert rows.select("ordinal").distinct().count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(v == list(range(500)) for v in got.values())
