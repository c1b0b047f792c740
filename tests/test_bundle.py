"""The stored model bundle (S13-S16), scoring from it (M16) and versions of units."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from immolens.operators import bundle, models, scoring
from immolens.plans import jobs
from immolens.sources import manifest, snapshots
from immolens.sources.adapter import listings

SMALL = dict(maxIter=4, stepSize=0.1, maxDepth=3, seed=42)
REQUEST = "city string, property_type string, surface_area double, rooms int, surface string"
REQUESTS = [("France_building, 00042", "maison", 50.0, 2, "kept"), ("Nowhere", "Appartement", 80.0, 0, None),
            (None, None, 0.0, 3, ""), ("GERMANY_FURNITURE", "Loft", 1e6, 90, "x")]

FRESH = """
import json, sys
sys.path.insert(0, sys.argv[1])
from immolens.plans import jobs
from immolens.session import get_session
spark = get_session("fresh", master="local[2]", shuffle_partitions=2)
requests = spark.read.schema(sys.argv[4]).json(sys.argv[3])
rows = [r.asDict() for r in jobs.score_requests(spark, requests, sys.argv[2]).collect()]
print("ROWS" + json.dumps(sorted(rows, key=str)))
"""


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("trained"))
    jobs.prepare(spark, listings(spark, "/root/testdata/sf0.001"), out, "2024-01-01", n_cluster=3)
    res = jobs.train(spark, jobs.latest_features(spark, out), out, SMALL, SMALL, SMALL)
    return out, res


def by_text(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_a_fresh_session_scores_from_the_folder_alone(spark, trained, tmpdir_path):
    out, res = trained
    requests = spark.createDataFrame(REQUESTS, REQUEST)
    path = os.path.join(tmpdir_path, "requests")
    requests.write.json(path)
    # figures of the objects that training left in memory
    own = jobs.bundle.load(spark, jobs.bundle_folder(out))
    km = models.Clusters.of_model(snapshots.load_pipeline_model(os.path.join(out, "models", "kmeans")))
    enc = snapshots.load_encoding(spark, os.path.join(out, "models", "city_encoding"))
    champ = res["champion"]
    want = by_text(scoring.score(requests, enc, km, champ["model"], res["feature_columns"],
                                 champ["method"], champ["r2"], ranges=own.ranges))
    assert len(want) == len(REQUESTS) and {r["surface"] for r in want} == {"kept", None, "", "x"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", FRESH, repo, out, path, REQUEST],
                          capture_output=True, text=True, timeout=300)
    line = [x for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert line, done.stderr[-2000:]
    got = json.loads(line[0][4:])
    assert [{k: v for k, v in r.items() if k != "predicted_price"} for r in got] == [
        {k: v for k, v in r.items() if k != "predicted_price"} for r in want]
    assert [r["predicted_price"] for r in got] == pytest.approx([r["predicted_price"] for r in want])


def test_metrics_and_report_come_from_the_bundle(spark, trained):
    out, res = trained
    report = jobs.run_report(spark, listings(spark, "/root/testdata/sf0.001"), out)
    assert report["metrics"].first().method == res["champion"]["method"]
    assert report["hyperparameters"].first().max_depth == 3
    assert report["counts"].first().clean_count == jobs.latest_features(spark, out).count()


def test_versions_keep_their_parts_together(spark, trained, tmpdir_path):
    out, _ = trained
    own = bundle.load(spark, jobs.bundle_folder(out))
    root = os.path.join(tmpdir_path, "bundle")
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, root)
    assert bundle.metrics(spark, root)["r2"] is None
    assert bundle.save(spark, root, own) == 1
    # a save that dies after the encoding is not seen
    half = bundle.Bundle(spark.createDataFrame([("X", 1.0)], "ville string, encoding double"),
                         None, None, own.features, "log_prix")
    with pytest.raises(AttributeError):
        bundle.save(spark, root, half)
    again = bundle.load(spark, root)
    assert again.version == 1 and again.encoding.count() == own.encoding.count()
    # the next version replaces it, and the first can still be asked for
    own.metrics = {**own.metrics, "r2": 0.5}
    assert bundle.save(spark, root, own) == 2
    assert bundle.metrics(spark, root)["r2"] == 0.5
    assert bundle.load(spark, root, 1).metrics["r2"] == again.metrics["r2"]


def test_manifest_of_two_writers_reads_one_way(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "unit")
    assert manifest.current(spark, root) is None
    for token in ("b", "a"):
        spark.createDataFrame([(1, token, json.dumps({"own": token}))], manifest.LOG_SCHEMA) \
            .write.mode("append").json(f"{root}/{manifest.LOG}")
    assert manifest.current(spark, root) == {"version": 1, "own": "b"}
    assert manifest.publish(spark, root, {"own": "c"}) == 2
    assert manifest.current(spark, root, 1)["own"] == "b"


def test_clusters_are_those_of_the_fitted_model(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(float(r.randrange(6) * 50) + r.random(), float(r.randrange(4)))
                                for _ in range(300)], "surface double, pieces double")
    model = models.fit_clustering(df, 4, ["surface", "pieces"])
    own = models.Clusters.of_model(model)
    assert own.centres == sorted(own.centres) and len(own.centres) == 4
    place = {tuple(c): i for i, c in enumerate(own.centres)}
    names = [place[tuple(float(x) for x in c)] for c in model.stages[-1].clusterCenters()]
    by_model = model.transform(df).select(
        "surface", F.element_at(F.array(*map(F.lit, names)), F.col("_cluster") + 1).alias("cluster"))
    assert sorted(map(tuple, by_model.collect())) == sorted(
        map(tuple, models.predict_cluster(df, own).select("surface", "cluster").collect()))
    odd = spark.createDataFrame([(None, 1.0)], "surface double, pieces double")
    assert models.predict_cluster(odd, own).first().cluster is None
