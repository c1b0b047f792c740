"""Repeated passages by prefix-free parsing: bytes of strings that start twice.

Triggers.  A rolling hash of 8 bytes orders all places; a 104-byte string is a
trigger if its smallest 8-byte hash stands at its beginning or its end.  That
depends on these bytes alone, so equal passages are parsed alike wherever they
stand, and every 200-byte string holds a trigger: triggers are at most 96 places
apart.  The dictionary has the triggers, the parse their sequence in a text.

Order.  In a suffix array of the corpus two suffixes are neighbours at depth 200
exactly if their 200-byte beginnings are equal.  A suffix is placed by its first
trigger (dictionary), how far before it the suffix begins, and what stands on
either side (parse).

1. Triggers that occur once can't be in a repeated string; the others are counted
   with partial sums and joined back to their places.
2. The suffixes first triggered at a place are taken together, by distance: all of
   them, then runs of 8, then each alone.  What a run's suffixes cover in all is
   hashed (outer), and what they share (inner).  Runs with the same outer string
   are repeated.  Where an inner string has several outer ones, a passage begins or
   ends: one run of each outer string goes on to the next level, with its count.

Keys are hashes of 112 bits or more.  This replaces the sorting of suffixes by
grouping at depth 200, which is all that the removal needs; no group's pairs are
made, and a group is never in one task.  The texts are written once, compressed
row by row and bucketed by row, so that places join them without another shuffle
of the texts.

Cases: null and empty text has no byte and loses none; equal rows and equal or
null ids are documents of their own (equal rows remove each other's strings); an
empty table gives an empty result; other columns are kept if ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import ddl, lean, shared_folder, table, written

DEPTH = 200                 # bytes of a repeated string
TRIGGER = 104               # bytes of a trigger
GRAM = 8                    # bytes of the rolling hash (fixed: one 64-bit number)
REACH = TRIGGER - GRAM      # triggers are at most this many places apart
LEVELS = (128, 8, 1)        # suffixes taken together; the first holds all of a trigger
SLICE_BYTES = 2 << 20       # parsed together, unless one text is longer
MIX = tuple(np.uint64(int.from_bytes(hashlib.sha256(f"mix {i}".encode()).digest()[:8], "little")
                      | 1) for i in range(2 + TRIGGER // GRAM))


# ------------------------------------------------------------------ the parse
def _mixed(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8 bytes at every place (wrapping past the end)."""
    g = np.zeros(len(data) + GRAM, np.uint64)
    g[:len(data)] = data
    for shift in (1, 2, 4):
        g[:-shift] |= g[shift:] << np.uint64(8 * shift)
    g *= MIX[0]
    g ^= g >> np.uint64(32)
    g *= MIX[1]
    g ^= g >> np.uint64(29)
    return g


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` neighbours, for each place where they begin."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:len(h) - (width - done)], h[width - done:]) if done < width else h


def _string_hash(m: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the ``length`` bytes (a multiple of 8) at each of the places."""
    out = np.zeros(len(at), np.uint64)
    for j in range(length // GRAM):
        out += m[at + j * GRAM] * MIX[2 + j]
    out ^= out >> np.uint64(31)
    out *= MIX[0]
    return out ^ (out >> np.uint64(30))


class Parse:
    """The triggers of some texts that lie in ``data``, text i at offsets[i:i + 2]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.m = m = _mixed(data)
        none = np.empty(0, np.int64)
        self.at = self.text = self.begin = self.last = none
        if len(data) < DEPTH:
            return
        h = (m[:len(data) - GRAM + 1] >> np.uint64(32)).astype(np.uint32)
        least = _least(h, REACH + 1)
        at = np.flatnonzero((h[:len(least)] == least) | (h[REACH:REACH + len(least)] == least))
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + TRIGGER <= offsets[text + 1]
        at, text = at[inside], text[inside]
        # suffixes first triggered here begin after the trigger before, and fit the text
        begin = offsets[text]
        same = np.flatnonzero(text[1:] == text[:-1]) + 1
        begin[same] = at[same - 1] + 1
        last = np.minimum(at, offsets[text + 1] - DEPTH)
        some = last >= begin
        self.at, self.text, self.begin, self.last = (x[some] for x in (at, text, begin, last))

    def triggers(self) -> np.ndarray:
        """48 bits: a filter and a part of the keys, never a key alone."""
        return (_string_hash(self.m, self.at, TRIGGER) >> np.uint64(16)).view(np.int64)

    def strings(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes between (one to three triggers long), and of their number."""
        out = (end - begin).astype(np.uint64) * MIX[3]
        for k, start in enumerate((begin, (begin + end - TRIGGER) // 2, end - TRIGGER)):
            out = (out ^ (out >> np.uint64(32))) * MIX[4 + k] \
                + _string_hash(self.m, start, TRIGGER)
        return out.view(np.int64)

    def runs(self, which: np.ndarray, low: np.ndarray, size: int):
        """(far, near): the first and the last suffix of the runs of ``size`` from
        ``low`` places before the triggers ``which``; far > near: there is none."""
        far = np.maximum(self.at[which] - low - size + 1, self.begin[which])
        return far, np.minimum(self.at[which] - low, self.last[which])


def unpacked(bodies: pa.Array) -> Iterator[tuple[int, int, Parse]]:
    """(first row, end row, parse) of slices of a column of compressed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    begin, held, size = 0, [], 0
    for i, body in enumerate(bodies):
        held.append(unpack(body.as_py()) if body.is_valid else b"")
        size += len(held[-1])
        if size >= SLICE_BYTES or i == len(bodies) - 1:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
            yield begin, i + 1, Parse(np.frombuffer(b"".join(held), np.uint8), offsets)
            begin, held, size = i + 1, [], 0


# ------------------------------------------------------------------- the jobs
def _stored_texts(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """(rid, row, body), written once and bucketed by the row's number."""
    spark = docs.sparkSession
    name = f"llm_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*keep).alias("row"),
                       F.col(text).cast("binary").alias("body"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = [pack(x.as_py()) if x.is_valid else None for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1),
                                              pa.array(packed, pa.binary())], names=b.schema.names)

    (rows.mapInArrow(run, rows.schema).repartition(buckets, "rid")
     .write.bucketBy(buckets, "rid").option("compression", "none")
     .option("path", f"{shared_folder(spark)}/llm/{name}").saveAsTable(name))
    return spark.table(name)


def _triggers(texts: DataFrame) -> DataFrame:
    """(u, n): a trigger and how often it occurs among a slice's texts (2: twice or more)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, p in unpacked(b.column(0)):
                u, n = np.unique(p.triggers(), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), pa.array(np.minimum(n, 2).astype(np.int32))], names=["u", "n"])

    return texts.select("body").mapInArrow(run, "u long, n int")


def _places(texts: DataFrame) -> DataFrame:
    """(u, rid, t) of every trigger that suffixes begin at."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for begin, _, p in unpacked(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.triggers()), pa.array(rid[begin + p.text]),
                     pa.array(p.at - p.offsets[p.text])], names=["u", "rid", "t"])

    return texts.select("rid", "body").mapInArrow(run, "u long, rid long, t long")


def _runs(texts: DataFrame, listed: DataFrame, level: int) -> DataFrame:
    """(u, low, inner, outer, rid, t, c) of the listed runs (rid, t, low, c), cut
    into runs of the level's size."""
    size, before = LEVELS[level], LEVELS[max(0, level - 1)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            lists = b.column(2)
            starts = lists.offsets.to_numpy()
            items = lists.values
            t, low, c = (items.field(k).to_numpy() for k in range(3))
            for begin, end, p in unpacked(b.column(1)):
                own = slice(starts[begin], starts[end])
                row = np.repeat(np.arange(end - begin), np.diff(starts[begin:end + 1]))
                which = np.searchsorted(p.at, p.offsets[row] + t[own])
                cut = before // size
                which, lows = np.repeat(which, cut), np.repeat(low[own], cut) \
                    + np.tile(np.arange(cut) * size, len(which))
                weight = np.repeat(c[own], cut)
                far, near = p.runs(which, lows, size)
                some = far <= near
                which, lows, weight, far, near = (x[some] for x in (which, lows, weight, far, near))
                at = p.at[which]
                inner = p.strings(at - lows, at + DEPTH - np.minimum(lows + size - 1, REACH))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (p.triggers()[which], lows, inner,
                                           p.strings(far, near + DEPTH),
                                           rid[begin + p.text[which]],
                                           at - p.offsets[p.text[which]], weight)],
                    names=["u", "low", "inner", "outer", "rid", "t", "c"])

    by_row = listed.groupBy("rid").agg(F.collect_list(F.struct("t", "low", "c")).alias("list"))
    return (texts.select("rid", "body").join(by_row.hint("shuffle_hash"), "rid")
            .select("rid", "body", "list")
            .mapInArrow(run, "u long, low long, inner long, outer long, rid long, t long, c long"))


def repeated(texts: DataFrame) -> DataFrame:
    """(rid, mark): repeated runs; a mark holds trigger's place, distance and size."""
    often = written(_triggers(texts).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1")
                    .select("u"), "triggers")
    listed = _places(texts).join(often, "u").select(
        "rid", "t", F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("c"))
    marks = None
    for level, size in enumerate(LEVELS):
        runs = written(_runs(texts, listed, level), f"runs-of-{size}")
        # first() of several columns is of one row: any run stands for its outer string
        classes = written(runs.groupBy("u", "low", "outer").agg(
            F.sum("c").alias("c"), *(F.first(x).alias(x) for x in ("inner", "rid", "t"))),
            f"classes-of-{size}")
        twice = classes.where("c > 1").select("u", "low", "outer")
        own = runs.where("c = 1").join(twice, ["u", "low", "outer"]).select(
            "rid", F.expr(f"(t << 16) | (low << 8) | {size}L").alias("mark"))
        marks = own if marks is None else marks.unionAll(own)
        if size > 1:
            # written, so that a common inner string's classes can be split in the join
            several = written(classes.groupBy("u", "low", "inner").agg(F.count("*").alias("n"))
                              .where("n > 1").select("u", "low", "inner"), f"several-of-{size}")
            listed = classes.join(several, ["u", "low", "inner"]).select("rid", "t", "low", "c")
    return marks


def _kept(body: bytes, marks: list[int] | None) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, the other bytes) of one text."""
    if not marks:
        return 0, 0, body
    n = len(body)
    p = Parse(np.frombuffer(body, np.uint8), np.array([0, n], np.int64))
    mark = np.array(marks, np.int64)
    which, low, size = np.searchsorted(p.at, mark >> 16), mark >> 8 & 255, mark & 255
    far, near = p.runs(which, low, size)
    change = np.bincount(far, minlength=n + 1) - np.bincount(near + DEPTH, minlength=n + 1)
    gone = np.cumsum(change[:n]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()


def removed(docs: DataFrame, keep: tuple[str, ...], text: str = "text",
            kept: str | None = None) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256), one row per input row;
    ``row`` is a struct of the ``keep`` columns.  Also what is left, ``kept``, as
    ``binary`` or as a ``string`` without the characters that lost some bytes."""
    texts = _stored_texts(docs, keep, text)
    marks = repeated(texts).groupBy("rid").agg(F.collect_list("mark").alias("marks"))
    joined = texts.join(marks.hint("shuffle_hash"), "rid", "left").select("row", "body", "marks")
    schema = ddl("n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                 + (f", kept {kept}" if kept else ""))
    schema = type(schema)([joined.schema["row"], *schema.fields])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            got = []
            for body, own_marks in zip(b.column(1), b.column(2), strict=True):
                own = unpack(body.as_py()) if body.is_valid else b""
                gone, spans, left = _kept(own, own_marks.as_py())
                got.append((len(own), gone, spans, hashlib.sha256(left).hexdigest(),
                            left if body.is_valid else None))
            columns = list(zip(*got, strict=True)) or [()] * 5
            if kept == "string":
                columns[4] = [None if x is None else x.decode("utf-8", "ignore")
                              for x in columns[4]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.string() if kept == "string" else pa.binary()]
            some = 5 if kept else 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(columns[:some], types[:some],
                                                               strict=True))],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:1 + some])

    return joined.mapInArrow(run, schema)


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
          kept: str | None = None) -> DataFrame:
    """The ``keep`` columns, and those of ``removed``."""
    out = removed(docs, keep, text, kept)
    return out.select("row.*", *out.columns[1:])


def query(spark, sf_dir) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with what is left of its text; a character
    that lost some of its bytes goes whole; null stays null."""
    left = removed(docs, tuple(c for c in docs.columns if c != "text"), kept="string")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
