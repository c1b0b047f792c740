"""Byte-level BPE: texts to token ids by a rank file, and back.

Vectorised pre-tokenisation: all texts of a slice are one array of code points, each
mapped to its class (letter, number, white space, other, with what one or two code
points ahead decide folded in).  The pattern's matches are the words of a small
automaton over these classes.  A class is a function from states to states and
functions compose associatively, so the array is cut into equal blocks, every block's
function is found for all blocks at once, a scan of the blocks' functions gives each
block's first state, and a second pass marks where matches begin.  No regular
expression is involved.

The matches are slices of the text's bytes; distinct ones are merged once, pair by
pair in order of rank, and kept in a bounded table of the worker.  Beside its ids a
document keeps the byte at which each token ends, so that any run of tokens can be
decoded to its place in the text by itself.

Cases: null and empty texts have no tokens; white space, any script, control
characters and texts of any length are encoded in full (a text beyond ``SLICE_BYTES``
is cut before a space behind an ASCII letter or digit, which is always where a match
ends); bytes that are not UTF-8 are read as U+FFFD, as Python reads them; repeated
rows and null ids give a row each; an empty table gives an empty one.  Columns of any
other name are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from immolens.llm.common import lean, table, worker_cache
from immolens.llm.tokens import slices

RANKS = "byte_bpe_50k.tiktoken"
KEPT_WORDS = 400_000            # of a worker's table; later ones are merged each time
SLICE_BYTES = 2 << 20           # text encoded together
WIDTH = 256                     # code points of a block of the scan
SHORT = 48                      # bytes; longer slices are merged with a heap
SIDE_BY_SIDE = 1 << 14          # matches merged together
NONE = 1 << 60                  # the rank of a pair that is no token

# ---- fixed values: the pattern of the public rank files, read as an automaton
# classes of code points
LETTER, NUMBER, OTHER, MARK1, MARK2, SPACE, BLANK, INNER = range(8)
# MARK1, MARK2: an apostrophe before one of these endings; SPACE, BLANK: a space, another
# white space, before something visible; INNER: one before white space or the end
ENDINGS1 = "stmd"
ENDINGS2 = ("re", "ve", "ll")
FIRST = 8                       # added to the class of a text's first code point
# states: nothing open, in letters, numbers, others, behind a leading space, in white
# space, one or two letters of an ending to come
OPEN, LETTERS, NUMBERS, OTHERS, LED, BLANKS, END1, END2 = range(8)
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
         0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# letters and numbers of Unicode 16 that Python's own tables may not have yet
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# ---- end of the fixed values


def code_point_classes() -> np.ndarray:
    """The class of every code point by itself."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for begin, end in ranges:
            out[begin:end + 1] = kind
    out[list(WHITE)] = BLANK
    out[32] = SPACE
    return out


def step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a match begins here) of the automaton."""
    if kind >= FIRST:
        state, kind = OPEN, kind - FIRST
    if state == END2:
        return END1, False
    if state == END1:
        return OPEN, False
    if kind in (MARK1, MARK2) and state not in (OTHERS, LED):
        return (END1 if kind == MARK1 else END2), True
    if kind in (LETTER, NUMBER, OTHER, MARK1, MARK2):
        run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(kind, OTHERS)
        return run, state not in (run, LED)
    if kind == INNER:
        return BLANKS, state != BLANKS
    return (LED if kind == SPACE else OPEN), True


class Scan:
    """The automaton's functions, closed under composition, and scans by them."""

    def __init__(self):
        kinds, states = range(2 * FIRST), range(8)
        self.next = np.array([step(s, k)[0] for s in states for k in kinds])
        self.begins = np.array([step(s, k)[1] for s in states for k in kinds])
        simple = [tuple(step(s, k)[0] for s in states) for k in kinds]
        found = {f: i for i, f in enumerate(dict.fromkeys([tuple(states), *simple]))}
        todo = list(found)
        while todo:                 # composition closes after a few dozen functions
            f = todo.pop()
            for g in simple:
                h = tuple(g[x] for x in f)
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
        names = list(found)
        self.functions = np.array(names)
        self.then = np.array([[found[tuple(g[x] for x in f)] for g in simple]
                              for f in names]).ravel()
        self.of_kind = np.array([found[f] for f in simple])
        self.composed = np.array([[found[tuple(g[x] for x in f)] for g in names] for f in names])

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Where matches begin, for the classes of the code points in a row."""
        n, wide = len(kinds), 2 * FIRST
        blocks = -(-n // WIDTH)
        rows = np.full(blocks * WIDTH, INNER, np.uint8)
        rows[:n] = kinds
        rows = np.ascontiguousarray(rows.reshape(blocks, WIDTH).T).astype(np.intp)
        # each block's function, then of all blocks up to each one, by doubling
        whole = self.of_kind.take(rows[0])
        for row in rows[1:]:
            whole = self.then.take(whole * wide + row)
        reach = 1
        while reach < blocks:
            whole = np.concatenate((whole[:reach], self.composed[whole[:-reach], whole[reach:]]))
            reach *= 2
        state = np.full(blocks, OPEN)
        state[1:] = self.functions[whole[:-1], OPEN]
        out = np.empty((WIDTH, blocks), bool)
        for i, row in enumerate(rows):
            at = state * wide + row
            out[i] = self.begins.take(at)
            state = self.next.take(at)
        return np.ascontiguousarray(out.T).ravel()[:n]


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        by_rank = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            by_rank[r] = token
        self.sizes = np.fromiter(map(len, by_rank), np.int64, len(by_rank))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        joins = {(left << 32) | right: r for token, r in self.ranks.items()
                 for k in range(1, len(token))
                 if (left := self.ranks.get(token[:k])) is not None
                 and (right := self.ranks.get(token[k:])) is not None}
        self.pair_keys = np.array(sorted(joins))
        self.pair_ids = np.array([joins[k] for k in self.pair_keys.tolist()])
        self.classes, self.scan = code_point_classes(), Scan()
        self.kept: dict[bytes, bytes] = {}

    # ------------------------------------------------------------ matches
    def matches(self, data: bytes, first: np.ndarray) -> np.ndarray:
        """The byte at which each match begins; ``first`` are the texts' first bytes."""
        text = data.decode()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if len(points) == len(data):
            at = None
        else:
            at = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800)
                           + (points >= 0x10000))
            at = np.concatenate(([0], at[:-1]))
            first = np.searchsorted(at, first)
        kinds = self.classes.take(points)
        begins = np.zeros(len(points) + 1, bool)
        begins[first] = True                    # the end counts as another text's beginning
        begins[-1] = True
        white = (kinds == SPACE) | (kinds == BLANK)
        kinds[white & (begins[1:] | np.append(white[1:], True))] = INNER
        marks = np.flatnonzero(points == ord("'"))
        marks = marks[~begins[marks + 1]]
        if len(marks):
            one = points[marks + 1]
            kinds[marks[np.isin(one, [ord(c) for c in ENDINGS1])]] = MARK1
            two = marks[~begins[marks + 2]]
            ending = points[two + 1].astype(np.int64) << 32 | points[two + 2]
            kinds[two[np.isin(ending, [ord(a) << 32 | ord(b) for a, b in ENDINGS2])]] = MARK2
        kinds[np.flatnonzero(begins[:-1])] += FIRST
        found = np.flatnonzero(self.scan.starts(kinds))
        return found if at is None else at[found]

    # ------------------------------------------------------------- merges
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours join to, or ``NONE``; below 0 is no token."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key),
                        self.pair_ids[at], NONE)

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each match: neighbours of the lowest rank join first, from the left.
        Matches of similar lengths go through their joins side by side."""
        out: list[np.ndarray | None] = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = np.array([whole], "<u4")
            elif len(w) > SHORT:
                out[i] = np.array([self.ranks[p] for p in self._joined(
                    [w[k:k + 1] for k in range(len(w))])], "<u4")
            else:
                classes.setdefault(len(w) + 3 >> 2, []).append(i)
        for quarter, own in classes.items():
            for begin in range(0, len(own), SIDE_BY_SIDE):
                some = own[begin:begin + SIDE_BY_SIDE]
                for i, ids in zip(some, self._side_by_side([words[i] for i in some], 4 * quarter),
                                  strict=True):
                    out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes], wide: int) -> list[np.ndarray]:
        """A row per match, filled up with -1; each round joins one pair of each row that
        still has any, and moves what is behind it up."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), wide), -1, np.int64)
        ids[np.arange(wide) < size[:, None]] = self.byte_ids[
            np.frombuffer(b"".join(words), np.uint8)]
        pairs = self._rank(ids[:, :-1], ids[:, 1:])
        rows, column = np.arange(len(words)), np.arange(wide)
        done = ids.copy()
        while len(rows):
            at = pairs.argmin(axis=1)
            low = pairs[np.arange(len(at)), at]
            more = low < NONE
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, pairs, at, low = (x[more] for x in (rows, ids, pairs, at, low))
            n = np.arange(len(rows))
            ids[n, at] = low
            last = np.full((len(rows), 1), -1)
            ids = np.take_along_axis(np.concatenate((ids, last), 1),
                                     column + (column > at[:, None]), 1)
            pairs = np.take_along_axis(np.concatenate((pairs, last + 1 + NONE), 1),
                                       column[:-1] + (column[:-1] >= at[:, None]), 1)
            right = np.minimum(at + 1, wide - 1)
            beside = np.where(at + 1 < wide, ids[n, right], -1)
            inside = at < wide - 1
            pairs[n[inside], at[inside]] = self._rank(low, beside)[inside]
            left = at > 0
            pairs[n[left], at[left] - 1] = self._rank(ids[n[left], at[left] - 1], low[left])
        size = (done >= 0).sum(axis=1)
        return np.split(done[done >= 0].astype("<u4"), np.cumsum(size)[:-1])

    def _joined(self, parts: list[bytes]) -> list[bytes]:
        """The same by a heap of pairs, for long matches; gone parts are empty."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if (r := ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue                        # one of the two has grown since
            parts[i], parts[j], after[i] = a + b, b"", after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    a, b = parts[left], parts[after[left]]
                    if a and b and (r := ranks.get(a + b)) is not None:
                        heapq.heappush(heap, (r, left, a, b))
        return [p for p in parts if p]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of distinct matches, from the worker's table or merged."""
        kept = self.kept
        got = [kept.get(w) for w in words]
        new = [i for i, g in enumerate(got) if g is None]
        for i, ids in zip(new, self.merged([words[i] for i in new]), strict=True):
            got[i] = ids.tobytes()
            if len(kept) < KEPT_WORDS:          # frequent ones come early
                kept[words[i]] = got[i]
        return got

    # -------------------------------------------------------------- texts
    def encode(self, data: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if not data:
            return np.empty(0, "<u4"), np.zeros(len(first), np.int64)
        begin = self.matches(data, first)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(
            np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        got = self._ids(words.dictionary.to_pylist())
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(got), "<u4")
        which = words.indices.to_numpy()
        n = size[which]
        upto = np.cumsum(n)
        ids = flat[np.repeat(start[which] - upto + n, n) + np.arange(upto[-1])]
        before = np.concatenate(([0], upto))[np.searchsorted(begin, np.append(first, len(data)))]
        return ids, np.diff(before)

    def encode_long(self, text: bytes) -> np.ndarray:
        """Ids of one text, in parts of about ``SLICE_BYTES``."""
        out, at = [], 0
        while at < len(text):
            end = at + SLICE_BYTES
            while 0 < (end := text.find(b" ", end)) < len(text) and not text[end - 1:end].isalnum():
                end += 1
            end = end if end > 0 else len(text)
            out.append(self.encode(text[at:end], np.zeros(1, np.int64))[0])
            at = end
        return np.concatenate(out)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """Bytes of any run of tokens; ``ends`` are the bytes at which they end."""
        if not len(ids):
            return b""
        size = self.sizes[ids]
        begin = ends.astype(np.int64) - size
        at = np.repeat(self.starts[ids] - begin, size)
        return self.bytes[at + np.arange(begin[0], begin[0] + len(at))].tobytes()


def encoder(ranks: str) -> Encoder:
    """This worker's encoder; ``ranks`` is a path, or the name of a public rank file."""
    def make() -> Encoder:
        path = ranks
        if os.path.dirname(ranks) == "":
            import public_tokenizers
            path = public_tokenizers.path(ranks)
        return Encoder(path)

    return worker_cache(f"byte bpe {ranks}", make)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text",
           ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids, ends), a row per row: ``ids`` and ``ends`` are little-endian
    unsigned 32-bit integers, the tokens and the bytes of the text at which they end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for b in batches:
            for begin, end in slices(b.column(1), SLICE_BYTES):
                some = b.slice(begin, end - begin)
                texts = some.column(1).to_pylist()
                try:
                    data = b"".join(texts)
                    data.decode()
                except UnicodeDecodeError:
                    texts = [t.decode("utf-8", "replace").encode() for t in texts]
                    data = b"".join(texts)
                if len(texts) == 1 and len(data) > SLICE_BYTES:
                    ids = own.encode_long(data)
                    n = np.array([len(ids)])
                else:
                    size = np.fromiter(map(len, texts), np.int64, len(texts))
                    ids, n = own.encode(data, np.cumsum(size) - size)
                upto = np.concatenate(([0], np.cumsum(n)))
                ends = np.concatenate(([0], np.cumsum(own.sizes[ids])))
                spans = list(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()),
                     _binary([ids[i:j].tobytes() for i, j in spans]),
                     _binary([(ends[i + 1:j + 1] - ends[i]).astype("<u4").tobytes()
                              for i, j in spans])],
                    names=["doc_id", "n_tokens", "ids", "ends"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
            .mapInArrow(lean(run, keep=(f"byte bpe {ranks}",)),
                        "doc_id long, n_tokens long, ids binary, ends binary"))


def decode(encoded: DataFrame, ranks: str = RANKS, name: str = "decoded") -> DataFrame:
    """The rows of ``encode``, or parts of their ids and ends, with the bytes they stand for."""
    ids, ends = (encoded.columns.index(c) for c in ("ids", "ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for b in batches:
            for begin, end in slices(b.column(ids), 2 * SLICE_BYTES):
                some = b.slice(begin, end - begin)
                got = [own.decode(np.frombuffer(i.as_py(), "<u4"), np.frombuffer(e.as_py(), "<u4"))
                       for i, e in zip(some.column(ids), some.column(ends), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, _binary(got)],
                                                 names=[*some.schema.names, name])

    schema = StructType([*encoded.schema.fields, StructField(name, BinaryType())])
    return encoded.mapInArrow(lean(run, keep=(f"byte bpe {ranks}",)), schema)


def query(spark, sf_dir) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"))
    return (decode(coded)
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))
