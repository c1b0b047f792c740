"""Toxicity by a factorization machine over hashed words.

A text is the set of the buckets of its words and of their beginnings (inflected
forms share these).  Its logit is a bias, a weight per
bucket and, for every pair of its buckets, the product of their factors: a word
that is harmless alone can count beside another.  The machine is learned by
gradient steps on a bounded sample of labelled rows.  A bucket's value in a text
that has it grows with how surely its rate differs between the labels (the score
of a two-sample test, continuity corrected); below ``SURE_FROM`` it is nil, so
that chance words neither add up in long texts nor get parameters.  A bucket that
says nothing alone is tested once more among the texts that hold a known toxic one,
by strata of the surest such bucket; where it passes, it has factors and no weight.
Tests are made on a sample with the corpus's share of toxic texts, so that what they
need doesn't depend on the corpus's size.  Scoring is one pass without a shuffle.

Cases: null or empty text gets the bias alone; rows without a label are scored,
not learned from; a document labelled twice counts as toxic if any label says so;
without labelled rows of both kinds every score is 0; repeated rows and null ids
get a row each; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import hash_sample, id_hash, lean, table, written
from immolens.llm.terms import coded_words, letters
from immolens.llm.tokens import slices

SAMPLE_ROWS = 4_000         # labelled rows learned from, of each label
MOST_TIMES = 8              # as many of the commoner label are tested on, at most
HASH_BITS = 30
BEGINNINGS = (4, 5)         # letters
MIN_DOCS = 3                # of the sample, that a bucket must be in
SURE_FROM, SURE_AT = 3.0, 8.0       # test scores at which a bucket's value is 0 and 1
FACTORS = 4
STEPS = 200
RATE = 0.08
DECAY_WEIGHTS = 1e-4
DECAY_FACTORS = 2e-3
SEED = 5


@dataclass
class Machine:
    buckets: np.ndarray         # sorted
    values: np.ndarray          # of a bucket in a text that has it
    bias: float
    weights: np.ndarray
    factors: np.ndarray         # (buckets, FACTORS)

    def logits(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``at``: positions in ``buckets``, text after text; ``ends``: of each text."""
        out = np.full(len(ends), self.bias)
        begin = np.concatenate(([0], ends[:-1]))
        some = np.flatnonzero(ends > begin)
        if len(some):
            v = self.factors[at] * self.values[at][:, None]
            sums = np.add.reduceat(v, begin[some], axis=0)
            squares = np.add.reduceat((v * v).sum(axis=1), begin[some])
            out[some] += (np.add.reduceat(self.weights[at] * self.values[at], begin[some])
                          + 0.5 * ((sums * sums).sum(axis=1) - squares))
        return out


def buckets(word: str) -> tuple[int, ...]:
    """Of the word's letters and their beginnings; -1 where there is none."""
    own = letters(word)
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) >> (32 - HASH_BITS) if x else -1
                 for x in (own, *(own[:n] + "-" if len(own) >= n else "" for n in BEGINNINGS)))


def text_buckets(texts: pa.Array, known: np.ndarray | None = None):
    """Distinct buckets of each text (or their positions in ``known``), and ends."""
    words, codes, ends = coded_words(texts)
    table = np.array([buckets(w) for w in words], np.int64).reshape(-1, 1 + len(BEGINNINGS))
    if known is not None:
        at = np.minimum(np.searchsorted(known, table), max(0, len(known) - 1))
        table = np.where(known[at] == table, at, -1) if len(known) else np.full_like(table, -1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    some = (table >= 0).any(axis=1)[codes]
    rows, text = table[codes[some]], text[some]
    width = np.int64(1) << 31
    both = np.unique((text[:, None] * width + rows)[rows >= 0])
    return both % width, np.searchsorted(both // width, np.arange(len(ends)), "right")


def sample(docs: DataFrame, labels: DataFrame
           ) -> tuple[list[tuple], dict[int, float], set[int]]:
    """[(id, label, buckets)] of the labelled rows that are learned from, the values
    of their buckets, and the buckets that have factors only.

    Of each label the ``SAMPLE_ROWS`` ids with the smallest hash are learned from;
    buckets are tested on these and on more of the commoner label, up to the corpus's
    share of it.  The ids, so bounded, are broadcast to the documents.  Buckets are tested where they are counted, and only those with a
    value come to the driver.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    limit = {label: math.ceil(SAMPLE_ROWS * min(MOST_TIMES, n / min(sizes.values())))
             for label, n in sizes.items()}
    own = F.lit(0)
    for label, n in limit.items():
        own = F.when(F.col("toxic") == label, n).otherwise(own)
    chosen = (hash_sample(one, "toxic", "doc_id", max(limit.values(), default=1), "doc_id")
              .where(F.col("__rank") <= own)
              .select("doc_id", "toxic", (F.col("__rank") <= SAMPLE_ROWS).alias("learned")))
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .select("doc_id", "toxic", "text", "learned"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in slices(b.column(2)):
                got, ends = text_buckets(b.column(2).slice(begin, end - begin))
                which = np.repeat(np.arange(begin, end), np.diff(ends, prepend=0))
                # each row once without a bucket: it is counted even if it has no word
                which = np.concatenate((np.arange(begin, end), which))
                got = np.concatenate((np.full(end - begin, -1), got))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)),
                     b.column(1).cast(pa.int32()).take(pa.array(which)),
                     b.column(3).take(pa.array(which)), pa.array(got, pa.int64())],
                    names=["doc_id", "toxic", "learned", "bucket"])

    pairs = written(
        texts.mapInArrow(run, "doc_id long, toxic int, learned boolean, bucket long").distinct(),
        "toxicity-sample")
    counted = pairs.groupBy("bucket").agg(F.count("*").alias("n"),
                                          F.count_if(F.col("toxic") == 1).alias("k"))
    total = counted.where("bucket = -1").first()
    if total is None:
        return [], {}, set()
    n, k = total["n"], total["k"]
    off = F.abs(F.col("k") - F.col("n") * (k / n)) - 0.5
    spread = F.sqrt(F.col("n") * (1 - F.col("n") / n) * (k * (n - k) / n / n)) + 1e-9
    value = (off / spread - SURE_FROM) / (SURE_AT - SURE_FROM)
    sure = (counted.where((F.col("bucket") >= 0) & (F.col("n") >= MIN_DOCS))
            .select("bucket", F.least(value, F.lit(1.0)).alias("value"), value.alias("surety"),
                    (F.col("k") > F.col("n") * (k / n)).alias("bad"), F.lit(False).alias("paired"))
            .where("value > 0"))
    sure = written(sure, "toxicity-buckets")
    both = sure.select("bucket", "value", "paired").unionAll(beside(pairs, sure))
    both = written(both, "toxicity-pairs")
    told = pairs.where("learned").join(both, "bucket", "left").groupBy("doc_id", "toxic").agg(
        F.sort_array(F.collect_list(F.expr("if(value is null, null, bucket)"))).alias("buckets"))
    rows = sorted(((r["doc_id"], r["toxic"], r["buckets"]) for r in told.collect()),
                  key=lambda r: r[0])
    known = both.collect()
    return rows, {r["bucket"]: r["value"] for r in known}, {
        r["bucket"] for r in known if r["paired"]}


def beside(pairs: DataFrame, sure: DataFrame) -> DataFrame:
    """(bucket, value, paired) of the buckets without a value of their own that tell
    toxic texts from clean ones beside a known toxic bucket.

    A text belongs to the stratum of its surest toxic bucket.  A bucket's toxic texts
    are compared with those expected from the rates of their strata (the test of
    Cochran, Mantel and Haenszel); counts per bucket and stratum are linear in ``pairs``.
    """
    strata = (pairs.join(sure.where("bad"), "bucket").groupBy("doc_id", "toxic")
              .agg(F.max(F.struct("surety", "bucket")).getField("bucket").alias("stratum")))
    strata = written(strata, "toxicity-strata")
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("texts"),
                                          F.avg((F.col("toxic") == 1).cast("int")).alias("rate"))
    counted = (pairs.where("bucket >= 0").join(strata, ["doc_id", "toxic"])
               .groupBy("bucket", "stratum")
               .agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
               .join(sure.select("bucket"), "bucket", "left_anti").join(sizes, "stratum"))
    tested = counted.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum(F.expr("k - n * rate")).alias("off"),
        F.sum(F.expr("n * (1 - n / texts) * rate * (1 - rate)")).alias("spread"))
    value = ((F.abs("off") - 0.5) / (F.sqrt("spread") + 1e-9) - SURE_FROM) / (SURE_AT - SURE_FROM)
    return (tested.where((F.col("n") >= MIN_DOCS) & (F.col("spread") > 1e-6))
            .select("bucket", F.least(value, F.lit(1.0)).alias("value"), F.lit(True).alias("paired"))
            .where("value > 0"))


def learn(rows: list[tuple[int, int, list[int]]], value: dict[int, float],
          paired: set[int] = frozenset()) -> Machine | None:
    """Adam on the logistic loss with decay; None without rows of both labels.  The
    ``paired`` buckets have factors, and no weight."""
    y = np.array([t == 1 for _, t, _ in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return None
    known = np.array(sorted(value), np.int64)
    x = np.array([value[int(b)] for b in known])
    alone = np.array([int(b) not in paired for b in known], bool)
    size = np.array([len(b) for *_, b in rows])
    at = np.searchsorted(known, np.array([i for *_, b in rows for i in b], np.int64))
    text, ends = np.repeat(np.arange(len(rows)), size), np.cumsum(size)
    rng = np.random.default_rng(SEED)
    odds = float(np.log(y.sum() / (len(y) - y.sum())))
    m = Machine(known, x, odds, np.zeros(len(known)), rng.normal(0, 0.02, (len(known), FACTORS)))
    values = [np.array([m.bias]), m.weights, m.factors]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    begin = np.concatenate(([0], ends[:-1]))
    some = np.flatnonzero(size)
    for step in range(1, STEPS + 1):
        m.bias = float(values[0][0])
        slope = (1 / (1 + np.exp(-np.clip(m.logits(at, ends), -50, 50))) - y) / len(y)
        v = m.factors[at] * x[at][:, None]
        sums = np.zeros((len(rows), FACTORS))
        if len(some):
            sums[some] = np.add.reduceat(v, begin[some], axis=0)
        g = slope[text] * x[at]
        pull = g[:, None] * (sums[text] - v)
        grads = [np.array([slope.sum()]),
                 (np.bincount(at, g, len(known)) + DECAY_WEIGHTS * m.weights) * alone,
                 np.stack([np.bincount(at, pull[:, f], len(known)) for f in range(FACTORS)],
                          axis=1) + DECAY_FACTORS * m.factors]
        for value, grad, a, b in zip(values, grads, first, second, strict=True):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            value -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-5)
    m.bias = float(values[0][0])
    m.weights, m.factors = m.weights.astype(np.float32), m.factors.astype(np.float32)
    return m


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score, one row per input row; the machine travels with the task
    (its buckets are bounded by the sample)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, end in slices(b.column(1)):
                if machine is None:
                    got = np.zeros(end - begin)
                else:
                    logits = machine.logits(*text_buckets(
                        b.column(1).slice(begin, end - begin), machine.buckets))
                    got = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(begin, end - begin), pa.array(got, pa.float64())],
                    names=["doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, score double"))


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_hash() % 5 != 0)
    machine = learn(*sample(docs, labels))
    return score(docs, machine).select(
        "doc_id", (id_hash() % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
