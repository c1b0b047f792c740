"""Packing into windows of tokens by non-negative least squares.

A document is cut into full windows, a piece that is a multiple of ``UNIT``
tokens and a tail shorter than that.  Full windows are sequences of their own.
The unit pieces' lengths form a histogram of ``window / UNIT - 1`` classes:
all combinations of up to ``DEPTH`` lengths that fill a window exactly are
enumerated, repeat counts are solved against the histogram by non-negative
least squares and rounded down, and what is left is combined greedily, longest
first.  Pieces without a partner and the tails follow each other and are cut at
the window's end, so that only the very last tokens miss a window; these are
cut into powers of two, which need no padding.

Nothing but counts leaves the tasks: a piece is numbered inside its task and
class, a row of counts per task gives the classes' offsets, and every document
then finds its sequences by arithmetic.

Cases: null or empty text is the end id alone (one tail of one token); repeated
rows and null ids are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm import tokens
from immolens.llm.common import lean, table, written

WINDOW = 4096
UNIT = 64                   # piece lengths are counted in units of this many tokens
DEPTH = 3                   # most pieces of an enumerated combination
SLICE_BYTES = 6 << 20       # text encoded together, unless one text is longer
LENGTHS = ("part int, doc_id long, n long, cls int, cls_before long, full_before long, "
           "tail_before long, ids binary")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


# ----------------------------------------------------------- the combinations
def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active set of Lawson and Hanson)."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(np.argmax(slope)) if n else 0
        if not n or free.all() or slope[best] <= 1e-9 * scale:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if y.min(initial=1.0) > 0:
                x[:] = 0
                x[at] = y
                break
            low = at[y <= 0]
            step = min((x[j] / (x[j] - y[np.searchsorted(at, j)]) for j in low
                        if x[j] > y[np.searchsorted(at, j)]), default=0.0)
            x[at] += step * (y - x[at])
            free &= x > 1e-12 * scale
            x[~free] = 0
            if not free.any():
                break
    return x


def combine(histogram: np.ndarray, size: int, depth: int = DEPTH) -> list[tuple[tuple, int]]:
    """[(lengths, repeats)] that never use more pieces than the histogram has.

    ``histogram[u]`` counts the pieces of ``u`` units; a window is ``size`` units.
    """
    left = histogram.astype(np.int64).copy()
    shapes = [c for d in range(2, depth + 1)
              for c in combinations_with_replacement(range(1, size), d)
              if sum(c) == size and all(left[u] for u in c)]
    a = np.zeros((size, len(shapes)))
    for j, shape in enumerate(shapes):
        for u in shape:
            a[u, j] += 1
    solved = nnls(a, left.astype(float)) if shapes else np.zeros(0)
    out: list[tuple[tuple, int]] = []

    def take(shape: tuple, times: int) -> None:
        need = np.bincount(shape, minlength=size)
        used = need > 0
        times = min(times, int((left[used] // need[used]).min()))
        if times > 0:
            left[:] -= times * need
            out.append((shape, times))

    for j in np.argsort(-solved, kind="stable"):
        take(shapes[j], int(solved[j] + 1e-6))
    for top in range(size - 1, 0, -1):          # residuals: longest first, exact fills only
        while left[top]:
            shape, room = [top], size - top
            for u in range(min(room, top), 0, -1):
                while u <= room and left[u] > shape.count(u):
                    shape.append(u)
                    room -= u
            if room:
                break
            take(tuple(shape), int(left[top]))
    return out


class Plan:
    """Where a numbered piece goes.  Sequences: full windows, combinations, the stream."""

    def __init__(self, counts: np.ndarray, full: int, tails: int, window: int, unit: int):
        self.window, self.unit, size = window, unit, window // unit
        shapes = combine(counts, size)
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        taken, sequence = np.zeros(size, np.int64), full
        for shape, times in shapes:
            offset = 0
            for u in shape:
                slots[u].append((int(taken[u]), sequence - int(taken[u]), offset * unit))
                taken[u] += times
                offset += u
            sequence += times
        self.slots = [tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) if s else None
                      for s in slots]
        self.taken, self.first = taken, sequence
        rest = (counts - taken) * np.arange(size) * unit
        self.class_base = np.concatenate(([0], np.cumsum(rest)[:-1]))
        self.tail_base = int(rest.sum())
        stream = self.tail_base + tails
        self.whole = stream // window * window
        cuts = [self.whole]
        for bit in range(window.bit_length(), -1, -1):
            if (stream - self.whole) >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        self.cuts = np.array(cuts, np.int64)

    def slot(self, u: int, i: int) -> tuple[int, int] | int:
        """(sequence, offset) of piece ``i`` of class ``u``, or its place in the stream."""
        if i >= self.taken[u]:
            return int(self.class_base[u] + (i - self.taken[u]) * u * self.unit)
        begin, base, offset = self.slots[u]
        k = int(np.searchsorted(begin, i, "right")) - 1
        return int(base[k]) + i, int(offset[k])

    def streamed(self, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces that a stretch of the stream is cut into."""
        end = at + length
        while at < end:
            if at < self.whole:
                k, begin = at // self.window, at // self.window * self.window
                stop = begin + self.window
            else:
                j = int(np.searchsorted(self.cuts, at, "right")) - 1
                begin, stop = int(self.cuts[j]), int(self.cuts[j + 1])
                k = self.whole // self.window + j
            yield min(end, stop) - at, self.first + k, at - begin
            at = min(end, stop)


# ------------------------------------------------------------------- the jobs
def tokenized(docs: DataFrame, path: str, end_id: int, window: int, unit: int,
              kind: str) -> DataFrame:
    """Ids and lengths, numbered inside the task that wrote them."""
    @tokens.encoding(path)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokens.encoder(path), TaskContext.get().partitionId()
        seen, full, tail = [0] * (window // unit), 0, 0
        for b in batches:
            for begin, end in tokens.slices(b.column(1), SLICE_BYTES):
                ids, at = own.encode(b.column(1).slice(begin, end - begin), end_id)
                data, width, at = ids.astype(kind).tobytes(), int(kind[-1]), at.tolist()
                rows = []
                for i, key in enumerate(b.column(0).slice(begin, end - begin).to_pylist()):
                    n = at[i + 1] - at[i]
                    u = n % window // unit
                    rows.append((part, key, n, u, seen[u], full, tail,
                                 data[width * at[i]:width * at[i + 1]]))
                    seen[u] += 1
                    full += n // window
                    tail += n % unit
                    if len(rows) == 2048:
                        yield _batch(rows, LENGTHS)
                        rows = []
                if rows:
                    yield _batch(rows, LENGTHS)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(run, LENGTHS), "packing-ids")


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)],
        names=[name for name, _ in fields])


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW,
         unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset (and its ``ids``, little-endian unsigned 32-bit)."""
    path = tokenizer or tokens.tokenizer_path()
    kind = tokens.id_type(path)
    ids = tokenized(docs, path, end_id, window, unit, kind)
    size = window // unit
    # a row of counts per task of the job above
    counted = (ids.groupBy("part").agg(
        F.sum(F.expr(f"n div {window}")).alias("full"), F.sum(F.col("n") % unit).alias("tail"),
        *(F.count_if(F.col("cls") == u).alias(f"c{u}") for u in range(size)))
        .orderBy("part").collect())
    counts = np.array([[r[f"c{u}"] for u in range(size)] for r in counted],
                      np.int64).reshape(-1, size)
    full = np.array([r["full"] for r in counted], np.int64)
    tail = np.array([r["tail"] for r in counted], np.int64)
    total = counts.sum(axis=0)
    total[0] = 0
    plan = Plan(total, int(full.sum()), int(tail.sum()), window, unit)
    before = {r["part"]: k for k, r in enumerate(counted)}
    bases = np.cumsum(counts, axis=0) - counts
    full_base, tail_base = np.cumsum(full) - full, np.cumsum(tail) - tail
    schema = PIECES + (", ids binary" if with_ids else "")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            columns = [b.column(i) for i in range(7)]
            for i, (part, key, n, u, cls_before, full_before, tail_before) in enumerate(
                    zip(*(c.to_pylist() for c in columns), strict=True)):
                k = before[part]
                data = np.frombuffer(b.column(7)[i].as_buffer(), kind).astype("<u4").tobytes()
                at = n // window * window
                pieces = [(w * window, window, int(full_base[k]) + full_before + w, 0)
                          for w in range(n // window)]
                if u:
                    slot = plan.slot(u, int(bases[k, u]) + cls_before)
                    if isinstance(slot, tuple):
                        pieces.append((at, u * unit, *slot))
                        at += u * unit
                    else:
                        for length, sequence, offset in plan.streamed(slot, u * unit):
                            pieces.append((at, length, sequence, offset))
                            at += length
                for length, sequence, offset in plan.streamed(
                        plan.tail_base + int(tail_base[k]) + tail_before, n % unit):
                    pieces.append((at, length, sequence, offset))
                    at += length
                for start, length, sequence, offset in pieces:
                    own = data[4 * start:4 * (start + length)]
                    row = (key, start, length, zlib.crc32(own), n, sequence, offset)
                    rows.append((*row, own) if with_ids else row)
                if len(rows) >= 5_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return ids.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the pieces of all documents that are left."""
    return pack(docs)
