"""Token files: documents' ids in order, coded by static rANS blocks.

One frequency table of the whole corpus is shared by all blocks.  A block
holds whole documents (about ``BLOCK_TOKENS`` ids, more if one document is
longer) and is coded on its own over ``LANES`` interleaved states, with a
checkpoint of all states every ``SECTION_STEPS`` steps, so that blocks and
sections of a block can be decoded in parallel.  A block carries the checksum
of its bytes, of its ids and of the table it needs.

Files are Parquet tables of blocks (Spark's commit protocol drops the output
of lost tasks): ``part`` counts along the id order, ``block`` inside a part.

Cases: null or empty text is one document with the end id alone; repeated ids
keep one document per row, in order of the text's hash; a null id comes first;
an empty table gives no block and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm import tokens
from immolens.llm.common import lean, scratch_path, table, written

BLOCK_TOKENS = 1 << 19
LANES = 1024
SECTION_STEPS = 128
MIN_TABLE_BITS = 12
LOW = np.uint64(1 << 31)            # states stay in [2^31, 2^63)
HEAD = "<4sHHIIIIIII"
MAGIC = b"rANS"
BLOCKS = ("part int, block int, part_start long, doc_ids binary, null_ids binary, "
          "lengths binary, ids binary")
CODED = ("part int, block int, part_start long, doc_ids binary, null_ids binary, "
         "lengths binary, payload binary")


# ------------------------------------------------------------------ the coder
class Table:
    """Frequencies that sum to 2^bits, every symbol that occurs at least 1."""

    def __init__(self, counts: np.ndarray):
        used = np.flatnonzero(counts)
        self.bits = max(MIN_TABLE_BITS, int(4 * max(1, len(used)) - 1).bit_length())
        size = 1 << self.bits
        freq = np.zeros(max(1, len(counts)), np.int64)
        if len(used):
            share = counts[used].astype(np.float64) / counts[used].sum()
            freq[used] = np.maximum(1, np.floor(share * size)).astype(np.int64)
            order = used[np.argsort(-freq[used], kind="stable")]
            over = int(freq.sum()) - size
            if over < 0:
                freq[order[0]] -= over
            for s in order:         # rounding up to 1 took too much: the largest give it back
                if over <= 0:
                    break
                give = min(over, int(freq[s]) // 2)
                freq[s] -= give
                over -= give
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.checksum = zlib.crc32(freq.astype("<u4").tobytes())

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, t: Table, lanes: int = LANES,
                 section: int = SECTION_STEPS) -> bytes:
    bits, room = np.uint64(t.bits), np.uint64(63 - t.bits)
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    freq, start = t.freq[ids], t.start[ids]
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []        # (words written so far, states)
    done = 0
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes:(step + 1) * lanes], start[step * lanes:(step + 1) * lanes]
        y = x[:len(f)]
        full = y >= (f << room)
        if full.any():
            words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            done += len(words[-1])
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:len(f)] = (q << bits) + (y - q * f) + c
        if step and step % section == 0:
            marks.append((done, x.copy()))
    body = [x.astype("<u8").tobytes()]
    for at, states in reversed(marks):              # a section starts `done - at` words in
        body += [struct.pack("<I", done - at), states.astype("<u8").tobytes()]
    body += [w.tobytes() for w in reversed(words)]
    head = struct.pack(HEAD, MAGIC, 1, t.bits, lanes, len(ids), section, len(marks), done, t.checksum,
                     zlib.crc32(ids.astype("<u4").tobytes()))
    out = head + b"".join(body)
    return out + struct.pack("<I", zlib.crc32(out))


def sections(payload: bytes) -> int:
    return struct.unpack_from(HEAD, payload)[6] + 1


def decode_block(payload: bytes, t: Table, symbols: np.ndarray,
                 section: int | None = None) -> np.ndarray:
    """All ids of a block, or those of one section, from its checkpoint."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("the block's bytes don't match their checksum")
    magic, _, bits, lanes, n, every, marks, n_words, table_sum, ids_sum = struct.unpack_from(HEAD, payload)
    if magic != MAGIC or bits != t.bits or table_sum != t.checksum:
        raise ValueError("the block was written with another table")
    at = struct.calcsize(HEAD)
    states = [(0, np.frombuffer(payload, "<u8", lanes, at))]
    at += 8 * lanes
    for _ in range(marks):
        states.append((struct.unpack_from("<I", payload, at)[0],
                       np.frombuffer(payload, "<u8", lanes, at + 4)))
        at += 4 + 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, at).astype(np.uint64)
    first, last = (0, -(-n // lanes)) if section is None else (
        section * every, min(-(-n // lanes), (section + 1) * every))
    at, x = states[section or 0]
    x = x.astype(np.uint64)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    begin, end = first * lanes, min(n, last * lanes)
    out = np.empty(end - begin, np.uint32)
    for step in range(first, last):
        width = min(lanes, n - step * lanes)
        y = x[:width]
        slot = y & mask
        s = symbols[slot]
        y = t.freq[s] * (y >> shift) + slot - t.start[s]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << np.uint64(32)) | words[at:at + len(low)]
            at += len(low)
        x[:width] = y
        out[step * lanes - begin:step * lanes - begin + width] = s
    if section is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("the block's ids don't match their checksum")
    return out


# ------------------------------------------------------------------ the jobs
def _raw_blocks(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """Ids in document order, cut into blocks of whole documents."""
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").alias("text"), F.xxhash64("text").alias("tie"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .select("doc_id", "text"))

    @tokens.encoding(path)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokens.encoder(path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        size = block = before = 0

        def close() -> pa.RecordBatch:
            row = [part, block, before,
                   np.array([k or 0 for k in keys], "<i8").tobytes(),
                   np.array([k is None for k in keys], np.uint8).tobytes(),
                   np.array([len(x) for x in ids], "<u4").tobytes(),
                   np.concatenate(ids).astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64()]
                                                  + [pa.binary()] * 4, strict=True)],
                names=["part", "block", "part_start", "doc_ids", "null_ids", "lengths", "ids"])

        for b in batches:
            for begin, end in tokens.slices(b.column(1)):
                flat, at = own.encode(b.column(1).slice(begin, end - begin), end_id)
                for i, key in enumerate(b.column(0).slice(begin, end - begin).to_pylist()):
                    keys.append(key)
                    ids.append(flat[at[i]:at[i + 1]])
                    size += len(ids[-1])
                    if size >= BLOCK_TOKENS:
                        yield close()
                        block, before, size = block + 1, before + size, 0
                        ids.clear()
                        keys.clear()
        if ids:
            yield close()

    return written(ordered.mapInArrow(run, BLOCKS), "token-blocks")


def corpus_table(blocks: DataFrame, kind: str = "<u4") -> Table:
    """Counts of every id of every block: one row per id and task is shuffled,
    one row per id (the vocabulary bounds it) comes to the driver."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column(0):
                got = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(got) > len(counts):
                    got[:len(counts)] += counts
                    counts = got
                else:
                    counts[:len(got)] += got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()),
                                          pa.array(counts[seen], pa.int64())], names=["id", "n"])

    rows = (blocks.select("ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table(counts)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None,
                 end_id: int = 1) -> Table:
    """Write ``docs`` (doc_id, text) as token files under ``folder``; gives the table."""
    path = tokenizer or tokens.tokenizer_path()
    kind = tokens.id_type(path)
    blocks = _raw_blocks(docs, path, end_id, kind)
    shared = corpus_table(blocks, kind)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(6)[i].as_buffer(), kind).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, 1) for k in range(6)),
                     pa.array([encode_block(ids, shared)], pa.binary())],
                    names=[*b.schema.names[:6], "payload"])

    blocks.mapInArrow(run, CODED).write.option("compression", "none").parquet(f"{folder}/blocks")
    (docs.sparkSession.createDataFrame([(shared.bits, shared.freq.astype("<u4").tobytes())],
                                       "bits int, frequencies binary")
     .coalesce(1).write.parquet(f"{folder}/table"))
    return shared


def read_table(spark, folder: str) -> Table:
    row = spark.read.parquet(f"{folder}/table").first()
    got = Table(np.zeros(0, np.int64))
    freq = np.frombuffer(bytes(row["frequencies"]), "<u4").astype(np.int64)
    got.bits, got.freq = row["bits"], freq.astype(np.uint64)
    got.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    got.checksum = zlib.crc32(freq.astype("<u4").tobytes())
    return got


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``, little-endian unsigned
    32-bit) of every document, decoded from the files."""
    shared = read_table(spark, folder)
    coded = spark.read.schema(CODED).parquet(f"{folder}/blocks")
    # a base per part: as many rows as the writing job had tasks
    sizes = (coded.groupBy("part").agg(
        F.max(F.struct("block", "part_start", "lengths")).alias("last"))
        .select("part", "last.part_start", "last.lengths").collect())
    bases, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        bases[row["part"]] = total
        total += row["part_start"] + int(np.frombuffer(bytes(row["lengths"]), "<u4")
                                         .sum(dtype=np.int64))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (
        ", ids binary" if with_ids else "")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.symbols()
        for b in batches:
            for row in b.to_pylist():
                ids = decode_block(row["payload"], shared, symbols).astype("<u4")
                keys = np.frombuffer(row["doc_ids"], "<i8")
                none = np.frombuffer(row["null_ids"], np.uint8).astype(bool)
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                pieces = [ids[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(keys, pa.int64(), mask=none),
                           pa.array(ends - lengths + bases[row["part"]] + row["part_start"]),
                           pa.array(lengths), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(pieces, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return coded.mapInArrow(run, schema)


def query(spark, sf_dir) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder, end_id=1)
    return read_tokens(spark, folder)
