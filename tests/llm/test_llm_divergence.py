import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from immolens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string"


@pytest.fixture()
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, *r, "x", 7, "y") for i, r in enumerate(rows)], SCHEMA)
    return make


def brute(rows, min_docs=3, top=200):
    """The contract in plain Python, group by group and term by term."""
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    found = [(lang or "", source or "",
              re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low)))
             for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        own = [(s, w) for x, s, w in found if x == lang]
        df = collections.Counter(t for _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if df[t] >= min_docs)
        whole = sum(counts.values(), collections.Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for g, c in counts.items():
            pair = [(-sum((p(c, t) - p(counts[h], t)) ** 2 // p(counts[h], t) for t in kept),
                     h.encode(), h) for h in counts if h != g]
            term = [(-((p(c, t) - p(whole, t)) ** 2 // p(whole, t)), t.encode(), t) for t in kept
                    if c[t] and p(c, t) > p(whole, t)]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, g, part, i, -v, r + 1) for r, (v, _, i) in enumerate(items)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(
        "lang", "source", "part", "item", "value", "rank").collect())


CORPUS = [
    ("The heron and the vessel", "en", "a"), ("the Heron 12the", "en", "a"), ("the é vessel", "en", "b"),
    ("heron vessel É é é", "en", "b"), ("é the the", "en", None), (None, "en", "empty"),
    ("", "en", "a"), ("der die der", "de", "a"), ("only once", "fr", "x"), ("twice", "fr", "y"),
    ("same row", "es", "s"), ("same row", "es", "s"), ("same row", "es", "s"),
    ("no language the the the", None, "a"), ("no language", None, "b"), ("the the", "", "c"),
    ("no\x1csplit\x85here a\x7fb", "", "c"), ("x'y-z", "", None)]


def test_against_plain_python(docs):
    got = rows_of(divergence.audit(docs(CORPUS)))
    assert got == brute(CORPUS) and len(got) > 20
    # a source without terms, and a language that keeps none, have pairs
    assert any(r[1] == "empty" and r[2] == "pair" for r in got)
    assert ("fr", "x", "pair", "y", 0, 1) in got
    assert rows_of(divergence.audit(docs(CORPUS), min_docs=1, top=1)) == brute(CORPUS, 1, 1)


def test_many_spills_and_blocks(docs, words, monkeypatch):
    rows = [(words(30, i), "en", f"s{i % 11}") for i in range(120)] + [("word " * 30_000, "en", "long")]
    want = brute(rows)
    for name, value in (("HELD", 500), ("BLOCK", 3), ("ROWS", 7), ("MATRICES", 2), ("SPILLED_ROWS", 5)):
        monkeypatch.setattr(divergence, name, value)
    for n in (1, 8):
        assert rows_of(divergence.audit(docs(rows).repartition(n))) == want


def test_rows_of_a_stripe_are_spills_not_documents(docs, words):
    """Each task hands on a key once per hash, however many documents it has."""
    given = docs([("the heron", "en", f"s{i % 5}") for i in range(4_000)]).coalesce(2)
    parts = given.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        divergence.fold, divergence.SPILLED)
    seen = {r["term"]: (r["n"], r["df"]) for r in
            parts.groupBy("term").agg(F.count("*").alias("n"), F.sum("df").alias("df")).collect()}
    assert seen["the"] == (2, 4_000) and seen[""] == (2, 4_000)


def test_scaled_shares_are_exact():
    r = np.random.default_rng(4)
    for total in (1, 7, 10**9, 3 * 10**12, 8 * 10**15):
        c = np.append(r.integers(0, total, 200, endpoint=True), [0, total])
        assert divergence.scaled(c, total).tolist() == [10**9 * int(x) // total for x in c]


def test_no_documents(docs):
    assert rows_of(divergence.audit(docs([]))) == []


def test_sql(spark, sf001):
    got = divergence.query(spark, sf001).toPandas()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf001}/documents.parquet'")
        want = db.sql(divergence.ORACLE_SQL).df()
    by = ["lang", "source", "part", "rank"]
    assert got.sort_values(by)[want.columns].values.tolist() == want.sort_values(by).values.tolist()
