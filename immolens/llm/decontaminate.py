"""Benchmark decontamination by latent semantic retrieval.

Terms are hashed words weighted by their inverse document frequency over all
documents; terms in more than ``MAX_SHARE`` of them say nothing and weigh nothing.
A randomised SVD (subspace iteration; the products with the matrix are made by
tasks and summed by term) finds the latent basis of the benchmark's TF-IDF
passages.  Every window of every document is compared with all passages by cosine,
in one pass and without a shuffle.  The basis is orthonormal, so a window's cosine
is at most the share of its length that lies in the benchmark's words: only windows
that can pass are projected.  What the basis doesn't hold of a passage is missing in
that cosine; passages that keep less than ``MIN_HELD`` of their squared length are
also compared by all their terms, and the larger cosine counts.  Pairs beyond
``MIN_COSINE`` are candidates.  A candidate counts if the longest common subsequence of the passage
and the window with its surroundings has ``MIN_LCS`` of the passage's words, and
``MIN_ANSWER`` of the words of its last sentence, where the answer stands.

The benchmark is the query set: it is taken in blocks of ``BLOCK_PASSAGES``, so what
a task is sent is bounded by that, the number of hashed terms and the rank.

Cases: null and empty texts, documents or benchmark items, match nothing; an item all
of whose words weigh nothing matches where it stands word for word; repeated rows and null ids are judged
row by row; an empty benchmark or document table gives an empty result; columns
of other names are kept by ``clean`` and ignored otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import lean, table, written
from immolens.llm.terms import NOT_LETTERS, coded_words, letters
from immolens.llm.tokens import slices

TERMS = 1 << 16             # hashed terms
MAX_SHARE = 0.4             # of documents; more frequent terms weigh nothing
HOP = 32                    # words; a window is two hops, a passage of the benchmark as long
RANK = 160
OVERSAMPLED = 16
POWERS = 2                  # subspace iterations
MIN_COSINE = 0.18
MIN_LCS = 0.6
MIN_ANSWER = 0.5
# Of a passage's squared length in the basis.  A window twice a passage's length that holds
# MIN_LCS of its words has a cosine of about MIN_LCS / sqrt(2) = 0.42 with it; what the basis
# holds half of is then at 0.21, still above MIN_COSINE.
MIN_HELD = 0.5
BLOCK_PASSAGES = 4_096
FREQUENT = 1_024            # words of a batch that are multiplied as a matrix
CELLS = 1 << 22             # of a matrix at a time
SLICE_BYTES = 8 << 20       # text searched together, unless one text is longer
SEED = 10


def term(own: str) -> int:
    """Hashed term of a word's letters, -1 if there are none."""
    return zlib.crc32(own.encode("utf-8", "replace")) % TERMS if own else -1


def hashed(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The words' letters and hashed terms."""
    own = [w if w.isalpha() else NOT_LETTERS.sub("", w) for w in words]
    terms = np.fromiter(map(zlib.crc32, map(str.encode, own)), np.int64, len(own)) % TERMS
    return own, np.where(np.fromiter(map(bool, own), bool, len(own)), terms, -1)


def words_of(text: str | None) -> list[str]:
    return [x for w in (text or "").lower().split() if (x := letters(w))]


def passages(item_id, text: str | None) -> list[tuple]:
    """(item, words, words of the answer): stretches of a window's length, each
    beginning half a window after the one before; the answer is the last sentence."""
    words, size = words_of(text), 2 * HOP
    sentences = [s for s in (words_of(s) for s in re.split(r"[.!?\n]+", text or "")) if s]
    last = max(0, len(words) - size)
    begins = sorted({*range(0, last, HOP), last})
    return [(item_id, words[b:b + size],
             sentences[-1][-size:] if b == last and sentences else [])
            for b in begins if words]


# ------------------------------------------------------------------- weights
def term_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """IDF of every hashed term over all documents (``TERMS`` rows come back)."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(TERMS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for begin, end in slices(b.column(0)):
                words, codes, ends = coded_words(b.column(0).slice(begin, end - begin))
                own = hashed(words)[1][codes]
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                both = pd.unique((doc * TERMS + own)[own >= 0])
                counts += np.bincount(both % TERMS, minlength=TERMS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], rows))],
            names=["term", "n"])

    got = (docs.select(text).mapInArrow(run, "term long, n long")
           .groupBy("term").agg(F.sum("n").alias("n")).collect())
    n = {r["term"]: r["n"] for r in got}
    rows = n.pop(-1, 0)
    share = np.zeros(TERMS)
    share[list(n)] = np.array(list(n.values()), np.float64) / max(1, rows)
    weights = np.log((1 + rows) / (1 + share * rows))
    # a corpus too small to tell common words from rare ones keeps them all
    return np.where(share * rows > max(MAX_SHARE * rows, 2), 0, weights).astype(np.float32)


# --------------------------------------------------------------------- basis
def _vector(words: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, values) of a passage's unit vector; words count as often as they stand."""
    at = np.array([term(w) for w in words], np.int64)
    at = at[weights[at] > 0] if len(at) else at
    terms, n = np.unique(at, return_counts=True)
    x = n * weights[terms]
    return terms, (x / (np.linalg.norm(x) or 1.0)).astype(np.float32)


def _product(benchmark: DataFrame, weights: np.ndarray, basis: dict | None, width: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rows of A'(A Q)) for the passages' matrix A; without a basis Q has
    a random row for each term.  Tasks send one row per term they have."""
    def rows_of(terms: np.ndarray) -> np.ndarray:
        if basis is not None:
            at = np.searchsorted(basis["terms"], terms)
            return basis["rows"][at]
        return np.stack([np.random.default_rng([SEED, int(t)]).standard_normal(width)
                         for t in terms]) if len(terms) else np.zeros((0, width))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for _, words, _ in passages(item, text):
                    terms, x = _vector(words, weights)
                    y = x @ rows_of(terms)
                    for t, v in zip(terms.tolist(), x, strict=True):
                        sums[t] = sums.get(t, 0) + v * y
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()),
                 pa.array([v.astype(np.float64).tolist() for v in sums.values()],
                          pa.list_(pa.float64()))], names=["term", "y"])

    parts = benchmark.select("item_id", "text").mapInArrow(run, "term long, y array<double>")
    summed = (parts.select("term", F.posexplode("y").alias("j", "y")).groupBy("term", "j")
              .agg(F.sum("y").alias("y")).groupBy("term")
              .agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("y"))
              .select("term", F.col("y.y").alias("y")).collect())
    order = sorted(summed, key=lambda r: r["term"])
    return (np.array([r["term"] for r in order], np.int64),
            np.array([r["y"] for r in order], np.float64).reshape(-1, width))


def latent_basis(benchmark: DataFrame, weights: np.ndarray, rank: int = RANK
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(sorted terms, their rows of the leading right singular vectors)."""
    width = rank + OVERSAMPLED
    terms, z = _product(benchmark, weights, None, width)
    if not len(terms):
        return terms, np.zeros((0, 1), np.float32)
    for _ in range(POWERS):
        q = np.linalg.qr(z)[0]
        width = q.shape[1]
        terms, z = _product(benchmark, weights, {"terms": terms, "rows": q}, width)
    values, turns = np.linalg.eigh(q.T @ z)
    lead = np.argsort(-values)[:rank]
    lead = lead[values[lead] > 1e-9 * max(values.max(), 1e-30)]
    return terms, (q @ turns[:, lead]).astype(np.float32)


# -------------------------------------------------------------------- search
def lcs(masks: dict[int, int], size: int, other) -> int:
    """Length of the longest common subsequence, on bit vectors."""
    full = (1 << size) - 1
    v = full
    for x in other:
        u = v & masks.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n codes in a row."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        out = (out + codes[i:len(out) + i].astype(np.uint64)) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Queries:
    """A block of the benchmark: passages, their latent vectors and checks."""

    def __init__(self, block: list[tuple], weights: np.ndarray, terms: np.ndarray,
                 rows: np.ndarray):
        self.weights, self.terms, self.rows = weights, terms, rows
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items, latent, self.checks = [], [], []
        weak, postings = [], []
        common: dict[int, dict[bytes, tuple]] = {}
        for item, words, answer in block:
            own, x = _vector(words, weights)
            if not len(own):
                # no term of it weighs anything: found where it stands word for word
                exact = np.array([number(w, len(self.vocabulary)) for w in words], np.int64)
                common.setdefault(len(exact), {}).setdefault(exact.tobytes(), []).append(item)
                continue
            at = np.searchsorted(terms, own)
            latent.append(x @ rows[at])
            if latent[-1] @ latent[-1] < MIN_HELD * (x @ x):
                postings += [(t, len(weak), v) for t, v in zip(own.tolist(), x.tolist(), strict=True)]
                weak.append(len(self.items))
            self.items.append(item)
            self.checks.append([
                (_masks([number(w, len(self.vocabulary)) for w in part]), len(part))
                for part in (words, answer)])
        self.common = {n: (np.array([_window_hashes(np.frombuffer(c, np.int64), n)[0] for c in own]),
                           own) for n, own in common.items()}
        self.latent = np.array(latent, np.float32).reshape(len(latent), rows.shape[1]).T
        # passages that the basis holds too little of, and their values by term
        self.weak = np.array(weak, np.int64)
        term_of, self.posted, self.value = (
            np.array(x, kind) for x, kind in zip(
                zip(*sorted(postings), strict=True) if postings else ((),) * 3,
                (np.int64, np.int64, np.float32), strict=True))
        self.posted_terms, self.posted_at = np.unique(term_of, return_index=True)
        self.posted_at = np.append(self.posted_at, len(term_of))

    def _word_for_word(self, number: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) of items of common words only, in the texts' words in a row."""
        for n, (hashes, own) in self.common.items():
            found = np.flatnonzero(np.isin(_window_hashes(number, n), hashes))
            for i, row in zip(found.tolist(), np.searchsorted(ends, found, "right").tolist(),
                              strict=True):
                if i + n <= ends[row]:
                    for item in own.get(number[i:i + n].tobytes(), ()):
                        yield row, item

    def _projected(self, at: np.ndarray, code: np.ndarray, weight: np.ndarray, own: np.ndarray,
                   hops: int) -> np.ndarray:
        """The latent vectors of ``hops`` hops (and a null one), of their words
        (hop, code) in order.  A batch's frequent words are counted in a matrix and
        multiplied, the others are added up one by one."""
        part = np.zeros((hops + 1, self.rows.shape[1]), np.float32)
        often = np.argsort(-np.bincount(code, minlength=len(own)), kind="stable")[:FREQUENT]
        rank = np.full(len(own), -1)
        rank[often] = np.arange(len(often))
        known = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        rows = self.rows[known[often]] * weight[often, None]
        for begin in range(0, hops, CELLS // FREQUENT):
            end = min(hops, begin + CELLS // FREQUENT)
            some = slice(*np.searchsorted(at, (begin, end)))
            counts = np.zeros((end - begin, FREQUENT), np.float32)
            which = rank[code[some]] >= 0
            counts[at[some][which] - begin, rank[code[some][which]]] = 1
            part[begin:end] = counts[:, :len(often)] @ rows
        rare = rank[code] < 0
        at, code = at[rare], code[rare]
        if len(at):
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            part[at[cut]] += np.add.reduceat(self.rows[known[code]] * weight[code, None], cut, axis=0)
        return part

    def _exact(self, at: np.ndarray, code: np.ndarray, weight: np.ndarray, own: np.ndarray,
               begin: int, end: int) -> np.ndarray:
        """The products of the hops from ``begin`` to ``end`` (and a null one) with the
        weak passages, by all terms of their words (hop, code), which are in order."""
        some = slice(*np.searchsorted(at, (begin, end)))
        at, code = at[some] - begin, code[some]
        place = np.minimum(np.searchsorted(self.posted_terms, own), len(self.posted_terms) - 1)
        sizes = np.where(self.posted_terms[place] == own, np.diff(self.posted_at)[place], 0)[code]
        ends = np.cumsum(sizes)
        which = np.repeat(self.posted_at[place[code]] - ends + sizes, sizes) + np.arange(sizes.sum())
        cell = np.repeat(at, sizes) * len(self.weak) + self.posted[which]
        out = np.bincount(cell, np.repeat(weight[code], sizes) * self.value[which],
                          (end - begin + 1) * len(self.weak))
        return out.reshape(-1, len(self.weak)).astype(np.float32)

    def _near(self, part: np.ndarray, first: np.ndarray, after: np.ndarray, norm: np.ndarray,
              words: tuple) -> Iterator[tuple[int, int, float]]:
        """(window, passage, cosine) beyond ``MIN_COSINE``, in blocks of windows; ``words``
        are those of the hops, as for ``_exact``."""
        step = max(1, CELLS // max(1, len(self.items) + 4 * len(self.weak)))
        for begin in range(0, len(first), step):
            own = slice(begin, begin + step)
            cosine = ((part[first[own]] + part[after[own]]) @ self.latent) / norm[own, None]
            if len(self.weak):
                low, high = int(first[own][0]), min(int(first[own][-1]) + 2, len(part) - 1)
                exact = self._exact(*words, low, high)
                # a window without a next hop ends at the null one
                next_hop = np.where(after[own] == len(part) - 1, high, after[own]) - low
                exact = (exact[first[own] - low] + exact[next_hop]) / norm[own, None]
                cosine[:, self.weak] = np.maximum(cosine[:, self.weak], exact)
            for i, j in zip(*(x.tolist() for x in np.nonzero(cosine >= MIN_COSINE)), strict=True):
                yield begin + i, j, float(cosine[i, j])

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float, float]]:
        """(row, item, cosine, share of the passage) of every match; the best one
        of a row and an item."""
        words, codes, ends = coded_words(texts)
        words, own = hashed(words)
        number = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        weight = np.where(own >= 0, self.weights[own], 0).astype(np.float32)
        # words without a letter don't count as places
        if (own < 0).any():
            some = (own >= 0)[codes]
            ends = np.concatenate(([0], np.cumsum(some)))[ends]
            codes = codes[some]
        best: dict[tuple[int, int], tuple[float, float]] = {
            pair: (1.0, 1.0) for pair in self._word_for_word(number[codes], ends)}
        for pair, found in self._by_windows(words, codes, ends, own, number, weight):
            if found > best.get(pair, (0.0, 0.0)):
                best[pair] = found
        return [(d, item, c, s) for (d, item), (s, c) in sorted(best.items())]

    def _by_windows(self, words, codes, ends, own, number, weight
                    ) -> Iterator[tuple[tuple[int, int], tuple[float, float]]]:
        """((row, item), (share, cosine)) of the windows near a passage, checked."""
        if not self.items:
            return
        sizes = np.diff(ends, prepend=0)
        begins, hops = ends - sizes, -(-sizes // HOP)
        first_hop = np.cumsum(hops) - hops
        doc_of = np.repeat(np.arange(len(ends)), hops)
        hop_at = begins[doc_of] + (np.arange(len(doc_of)) - first_hop[doc_of]) * HOP
        known = np.flatnonzero(((number >= 0) & (weight > 0))[codes])
        if not len(known):
            return
        length = np.add.reduceat((weight * weight)[codes], hop_at, dtype=np.float64)
        # a benchmark word counts once a hop
        pairs = pd.unique((np.searchsorted(hop_at, known, "right") - 1) * len(words) + codes[known])
        hop, code = pairs // len(words), pairs % len(words)
        inside = np.sqrt(np.bincount(hop, weight[code].astype(np.float64) ** 2, len(length)))
        # a window is a hop and the next of its document
        joined = np.append(doc_of[1:] == doc_of[:-1], False)
        norm = np.sqrt(np.maximum(length + joined * np.append(length[1:], 0), 1e-12))
        most = inside + joined * np.append(inside[1:], 0)
        window = np.flatnonzero(most >= MIN_COSINE * norm)
        if not len(window):
            return
        wanted = np.zeros(len(length) + 1, bool)
        wanted[window] = True
        wanted[window[joined[window]] + 1] = True
        some = wanted[hop]
        hop, code = hop[some], code[some]
        place = np.cumsum(wanted) - 1
        hop = place[hop]
        part = self._projected(hop, code, weight, own, int(wanted.sum()))
        after = np.where(joined[window], place[window + 1], len(part) - 1)
        for i, j, cosine in self._near(part, place[window], after, norm[window],
                                       (hop, code, weight, own)):
            d = int(doc_of[window[i]])
            start = hop_at[window[i]]
            near = number[codes[max(begins[d], start - HOP):min(ends[d], start + 3 * HOP)]]
            near = near[near >= 0].tolist()
            (whole, n), (answer, n_answer) = self.checks[j]
            share = lcs(whole, n, near) / n
            if share < MIN_LCS or n_answer and lcs(answer, n_answer, near) < MIN_ANSWER * n_answer:
                continue
            yield (d, self.items[j]), (share, min(1.0, cosine))


def query_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Queries]:
    """The benchmark's passages in blocks, with weights and basis of these tables."""
    weights = term_weights(docs)
    items = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    terms, rows = latent_basis(items, weights)
    block: list[tuple] = []
    for row in items.toLocalIterator():
        block += passages(row["item_id"], row["text"])
        if len(block) >= BLOCK_PASSAGES:
            yield Queries(block, weights, terms, rows)
            block = []
    if block:
        yield Queries(block, weights, terms, rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): every match of a document and an item."""
    schema = "doc_id long, item_id long, cosine double, lcs double"
    out = None
    for queries in query_blocks(docs, benchmark):
        @lean
        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for begin, end in slices(b.column(1), SLICE_BYTES):
                    got = queries.matches(b.column(1).slice(begin, end - begin))
                    d, item, cosine, share = zip(*got, strict=True) if got else ((),) * 4
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([begin + x for x in d], pa.int64())),
                         pa.array(item, pa.int64()), pa.array(cosine, pa.float64()),
                         pa.array(share, pa.float64())],
                        names=["doc_id", "item_id", "cosine", "lcs"])

        own = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .mapInArrow(run, schema))
        out = own if out is None else out.unionAll(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, with all their columns."""
    place, kept = docs.columns.index("text"), None
    for queries in query_blocks(docs, benchmark):
        if kept is not None:        # a block at a time
            kept = written(kept, "clean")

        @lean
        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # small slices, handed on at once: whole rows pass through here
                for begin, end in slices(b.column(place), SLICE_BYTES // 4):
                    some = b.slice(begin, end - begin)
                    stay = np.ones(some.num_rows, bool)
                    stay[[d for d, *_ in queries.matches(some.column(place))]] = False
                    yield some.filter(pa.array(stay))

        kept = (docs if kept is None else kept).mapInArrow(run, docs.schema)
    return docs if kept is None else kept


def query(spark, sf_dir) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # an item in several passages: its best
    return found.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that match a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
