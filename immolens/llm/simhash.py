"""Near-duplicate documents by SimHash fingerprints and sharded BK-trees.

A fingerprint takes the majority of the bits of XXH64 over word shingles.
Equal fingerprints are one class.  Two fingerprints that differ in at most
``radius`` bits agree in one of ``radius + 1`` blocks: each class goes to a shard for
the first bits of every block, as many as make shards of ``SHARD`` classes on
average (of pairs of blocks, where one block hasn't that many).  A shard's
fingerprints form a BK-tree (children keyed by their integer Hamming distance to the
parent, small buckets at its leaves); all its members are looked up, in blocks, and
follow only the edges within the radius.  A shard hands on one link per member, to
the smallest fingerprint it is connected to there, never its pairs; distributed
components join the shards.

Cases: null, empty or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle has are hashed as they are; equal ids and
repeated rows are rows of their own; a null id never names a component unless
all its ids are null; an empty table gives an empty result; other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import lean, table, written
from immolens.llm.graph import components

SHINGLE = 3                 # words
RADIUS = 3                  # bits
SEED = 42
LEAF = 8                    # a tree node with fewer fingerprints below it is a bucket
SHARD = 256                 # fingerprints of a shard, on average, as long as keys have bits for it
LOOKUP = 1024               # fingerprints looked up together


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, signed (a Spark long)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:e], seed)
                  for a, e in zip(starts[:len(words) - width + 1].tolist(),
                                  ends[width - 1:].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp``, one row per input row."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t.as_py(), width) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(got, pa.int64())],
                names=[*keep, "fp"])

    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, fp long")


# ------------------------------------------------------------------- the tree
class BKTree:
    """Children keyed by the integer distance to their parent; bucket leaves."""

    def __init__(self, values: np.ndarray):
        self.values, self.nodes, self.compared = values, 0, 0
        self.root = self._grow(np.arange(len(values)))

    def _grow(self, at: np.ndarray):
        top: dict = {}
        work = [(at, top, 0)]
        while work:
            at, parent, key = work.pop()
            if len(at) <= LEAF:
                parent[key] = at
                continue
            children: dict[int, object] = {}
            parent[key] = (at[0], children)
            self.nodes += 1
            d = np.bitwise_count(self.values[at[1:]] ^ self.values[at[0]])
            order = np.argsort(d, kind="stable")
            cut = np.flatnonzero(np.diff(d[order])) + 1
            for group in np.split(order, cut):
                if d[group[0]] == 0:        # equal values: one bucket, of any size
                    children[0] = at[1:][group]
                else:
                    work.append((at[1:][group], children, int(d[group[0]])))
        return top[0]

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asked, found) of positions, in parts, of values at most ``radius`` apart."""
        work = [(self.root, asked)]
        while work:
            node, q = work.pop()
            if isinstance(node, np.ndarray):
                self.compared += len(q) * len(node)
                near = np.bitwise_count(self.values[q][:, None] ^ self.values[node]) <= radius
                i, j = np.nonzero(near)
                yield q[i], node[j]
                continue
            pivot, children = node
            self.compared += len(q)
            d = np.bitwise_count(self.values[q] ^ self.values[pivot]).astype(np.int64)
            near = q[d <= radius]
            yield near, np.full(len(near), pivot)
            for key, child in children.items():
                along = q[np.abs(d - key) <= radius]
                if len(along):
                    work.append((child, along))


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the pairs into ``parent`` (each position's smallest known partner)."""
    while len(i):
        a, b = parent[i], parent[j]
        if (a == b).all():
            return
        low = np.minimum(a, b)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def shard_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest fingerprint connected to it) of one shard's distinct values."""
    values = np.sort(values)
    parent = np.arange(len(values))
    tree = BKTree(values)
    for at in range(0, len(values), LOOKUP):
        for i, j in tree.within(np.arange(at, min(len(values), at + LOOKUP)), radius):
            _merge(parent, i, j)
    linked = np.flatnonzero(parent != np.arange(len(values)))
    return values[linked], values[parent[linked]]


def key_bits(n: int, radius: int) -> tuple[int, int]:
    """(bits of a block, bits of a block of the others) that make shards of ``SHARD``
    fingerprints on average out of n; the second are used when the first don't do."""
    wanted = max(0, (max(1, n // SHARD) - 1).bit_length())
    block = 64 // (radius + 1)
    return min(wanted, block), max(0, min(wanted - block, (64 - block) // (radius + 1)))


def shard_keys(values: np.ndarray, radius: int, bits: tuple[int, int]) -> np.ndarray:
    """Keys of which any two values at most ``radius`` bits apart share one.

    Of ``radius + 1`` blocks one is equal in both, and so is one of as many blocks of
    the other bits; a key is the first ``bits`` of such a block, or of two.
    """
    blocks = radius + 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for i in range(blocks):
        low, high = edge[i], edge[i + 1]
        first = (values >> np.uint64(low)) & np.uint64((1 << bits[0]) - 1)
        if not bits[1]:
            out.append(first * np.uint64(blocks) + np.uint64(i))
            continue
        above = values >> np.uint64(high) if high < 64 else np.zeros_like(values)
        rest = (above << np.uint64(low)) | (values & np.uint64((1 << low) - 1))
        width = 64 - (high - low)
        for j in range(blocks):
            part = (rest >> np.uint64(width * j // blocks)) & np.uint64((1 << bits[1]) - 1)
            key = (first << np.uint64(bits[1])) | part
            out.append(key * np.uint64(blocks ** 2) + np.uint64(i * blocks + j))
    return np.stack(out, axis=1)


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are at
    most ``radius`` bits apart.  Each goes to the shards that its near ones must share;
    a task grows each shard's tree and looks its fingerprints up in it."""
    bits = key_bits(classes.count(), radius)

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            keys = shard_keys(fps.view(np.uint64), radius, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)),
                 pa.array(np.repeat(fps, keys.shape[1]))], names=["shard", "fp"])

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)

        def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(keys)) + 1
            begin = np.concatenate(([0], cut))
            end = np.concatenate((cut, [len(keys)]))
            found = [shard_links(fps[s:e].view(np.uint64), radius)
                     for s, e in zip(begin.tolist(), end.tolist(), strict=True) if e - s > 1]
            a = np.concatenate([f[0] for f in found] or [np.empty(0, np.uint64)])
            c = np.concatenate([f[1] for f in found] or [np.empty(0, np.uint64)])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)),
                                               pa.array(c.view(np.int64))], names=["a", "b"])

        for b in batches:
            keys = np.concatenate((held_k, b.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((held_v, b.column(1).to_numpy(zero_copy_only=False)))
            open_at = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            held_k, held_v = keys[open_at:], fps[open_at:]      # the shard may go on
            if open_at:
                yield linked(keys[:open_at], fps[:open_at])
        if len(held_k):
            yield linked(held_k, held_v)

    shards = classes.select("fp").mapInArrow(spread, "shard long, fp long")
    return (shards.repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(search, "a long, b long").distinct())


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp);
    ``component_id`` is the smallest id that can be reached."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes, radius))
    member = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    # written, so that a large component can be split in the join
    least = written(member.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    return member.join(least, "root").select("fp", "component_id")


def query(spark, sf_dir) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return (prints.join(near_duplicates(prints), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id stays (equal
    ids: the smallest hash of the row; equal rows: one of them).  Columns may have
    any names."""
    own = "__row"
    while own in docs.columns:
        own += "_"
    whole = docs.withColumn(own, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = whole.select("doc_id", F.col(own).alias("row"), F.col("text").alias("body"))
    prints = written(fingerprints(rows, text="body", keep=("doc_id", "row")), "fingerprints")
    # null ids come last, so that a named document stays if there is one
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(prints.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    roots = components(links(classes))
    kept = (classes.join(roots, F.col("fp") == F.col("node"), "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("k"))
            .select(F.col("k.doc_id").alias("id"), F.col("k.row").alias("kept")))
    copies = prints.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
    kept = written(kept.join(copies, kept["id"].eqNullSafe(copies["doc_id"])
                             & (kept["kept"] == copies["row"])).select("id", "kept", "n"), "kept")

    def stay(some: DataFrame) -> DataFrame:
        some = some.select(F.struct("id", "kept").alias(f"{own}k"))
        key = F.col(f"{own}k")
        return whole.join(some, whole["doc_id"].eqNullSafe(key["id"])
                          & (whole[own] == key["kept"]), "left_semi").select(
                              *[F.col(f"`{c}`") for c in docs.columns])

    return stay(kept.where("n = 1")).union(stay(kept.where("n > 1")).distinct())
