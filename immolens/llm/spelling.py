"""Spelling variants: words one edit apart, and the common form of each.

Variable-length gram index.  The vocabulary's frequent grams (of ``GRAM_FROM`` to
``GRAM_TO - 1`` letters, end marks included) are the inner nodes of a dictionary that
is pruned by frequency: the gram at a place of a word is the shortest one from there on
that is not frequent, so common syllables give long grams and rare letters short ones.
A gram depends on its own letters only, so one edit changes just the grams that cover
its place: a word's bound is the largest number of its grams over one place.  Two words
one edit apart share all but that many, hence at least one of the ``bound + 1`` rarest
grams of each, at the same place or one further on.  Each word is listed under those
grams by (gram, place, length), a shorter word also where one letter more would put it.
Lists that share a key are merged in one task and verified letter by letter; what must
be equal but for one letter is found by hashes of the words without it, so a long list
costs its length, not its square.

Words are runs of ``A-Z``, ``a-z`` and U+00C0 to U+00FF, held as Latin-1 bytes, one per
code point.

Cases: null and empty texts have no words; a null id counts as the empty string where
ids are hashed; repeated rows count as often as they stand; very long runs are words like
any other; ties of ``n`` go to the smaller word; an empty table gives no rows.  Columns
other than id and text are not read, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import lean, table, written

MIN_LENGTH, MIN_COUNT = 6, 5    # fixed by the contract: letters and occurrences of a word
RATIO = 5                       # a form is this many times as frequent; fixed too
MUTATED = 199                   # one in so many (document, run) loses a letter; fixed too
GRAM_FROM, GRAM_TO = 2, 6       # letters of a gram; at least one gram of a word stays
FREQUENT = 32                   # words; a gram of more may be an inner node
DICTIONARY = 1 << 16            # inner nodes, the most frequent ones: what tasks are sent
HELD = 300_000                  # words of a task's hash; then it is handed on
LISTED = 1 << 16                # list rows verified together, unless one list is longer
BEGIN, END = 1, 2               # marks of a word's ends

#: a-z for A-Z; all that is no letter parts runs
RUN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32
                  for c in range(256))

_RANDOM = np.random.default_rng(2024).integers(1, 1 << 63, 257, np.uint64) | np.uint64(1)
_LETTERS, _BASE = _RANDOM[:256], _RANDOM[256]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


# --------------------------------------------------------------------- words
def mutated(run: bytes, before: int) -> bytes:
    """The run, without one letter where the hash says so; ``before`` is the crc32 of the
    document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % MUTATED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text",
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
               change: Callable[[bytes, int], bytes] = mutated) -> DataFrame:
    """(word, n): the words of all texts, as Latin-1 bytes, and how often they occur.
    Tasks count in a hash that is handed on when full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for own, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                before = zlib.crc32(f"{own}:".encode())
                runs = (body.as_py().decode("utf-8", "replace").encode("latin-1", "replace")
                        .translate(RUN_BYTES).split())
                for word, n in Counter(runs).items():
                    if len(word) >= min_length:
                        total[change(word, before)] += n
            if len(total) >= HELD:
                yield handed()
        yield handed()

    return (docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
            .mapInArrow(lean(run), "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= min_count) & (F.octet_length("word") >= min_length)))


# --------------------------------------------------------------------- grams
def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters) of the words of each length, without end marks."""
    size = pc.binary_length(words).to_numpy()
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        data = b"".join(words.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(data, np.uint8).reshape(len(rows), n)


def _marked(letters: np.ndarray) -> np.ndarray:
    return np.pad(letters, ((0, 0), (1, 1)), constant_values=((0, 0), (BEGIN, END)))


def _packed(marked: np.ndarray, n: int) -> np.ndarray:
    """The grams of n letters at each place, as one integer."""
    out = np.zeros((len(marked), marked.shape[1] - n + 1), np.int64)
    for i in range(n):
        out = out << 8 | marked[:, i:i + out.shape[1]]
    return out


def dictionary(words: DataFrame, longest: int = GRAM_TO) -> np.ndarray:
    """The inner nodes: frequent grams shorter than ``longest``, the most frequent last.

    At most ``DICTIONARY`` of them come to the driver and travel with the tasks; what is
    in it changes how long lists are, never what is found.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_packed(_marked(letters), n).ravel() for _, letters in _by_length(b.column(0))
                     for n in range(GRAM_FROM, longest)]
            gram, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n, pa.int64())],
                                             names=["gram", "n"])

    counted = (words.select("word").mapInArrow(lean(run), "gram long, n long")
               .groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT))
    top = counted.orderBy(F.desc("n"), "gram").limit(DICTIONARY).collect()
    return np.array([r["gram"] for r in reversed(top)], np.int64)


class Grams:
    """Decomposes words by the dictionary's inner nodes."""

    def __init__(self, inner: np.ndarray, longest: int = GRAM_TO):
        self.order = np.argsort(inner)
        self.inner, self.longest = inner[self.order], longest

    def _rank(self, gram: np.ndarray) -> np.ndarray:
        """0 for a gram that is not frequent, else its place among those that are, from 1."""
        if not len(self.inner):
            return np.zeros(gram.shape, np.int64)
        at = np.minimum(np.searchsorted(self.inner, gram), len(self.inner) - 1)
        return np.where(self.inner[at] == gram, 1 + self.order[at], 0)

    def decompose(self, letters: np.ndarray):
        """(grams, their lengths, their ranks) at every place of words of one length."""
        marked = _marked(letters)
        grams = _packed(marked, GRAM_FROM)
        size = np.full(grams.shape, GRAM_FROM)
        rank = self._rank(grams)
        open_ = rank > 0
        for n in range(GRAM_FROM + 1, self.longest + 1):
            longer = _packed(marked, n)
            open_ = open_[:, :longer.shape[1]]
            if not open_.any():
                break
            part = (slice(None), slice(0, longer.shape[1]))
            grams[part] = np.where(open_, longer, grams[part])
            size[part] = np.where(open_, n, size[part])
            rank[part] = np.where(open_, self._rank(longer), rank[part])
            open_ = open_ & (rank[part] > 0)
        return grams, size, rank

    def listed(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, gram, place): under which grams each word is listed."""
        grams, size, rank = self.decompose(letters)
        over = np.zeros((len(letters), letters.shape[1] + 2), np.int64)
        for d in range(self.longest):
            wide = min(grams.shape[1], over.shape[1] - d)
            over[:, d:d + wide] += size[:, :wide] > d
        bound = over.max(axis=1)                    # grams that one edit can change
        # rarest first; equal ones by place, which an edit keeps in order
        key = rank << 40 | (_mixed(grams) >> np.uint64(24)).astype(np.int64)
        first = np.argsort(key, axis=1, kind="stable")
        word, nth = np.nonzero(np.arange(grams.shape[1]) <= bound[:, None])
        place = first[word, nth]
        return word, grams[word, place], place


def lists(words: DataFrame, inner: np.ndarray, longest: int = GRAM_TO) -> DataFrame:
    """(list, visits, word, n): each word under its grams, and where its grams would be
    in a word of one letter more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grams(inner, longest)
        for b in batches:
            for rows, letters in _by_length(b.column(0)):
                word, gram, place = own.listed(letters)
                n = letters.shape[1]
                for shift, size, visits in ((0, n, False), (0, n + 1, True), (1, n + 1, True)):
                    at = pa.array(rows[word])
                    where = (place + shift).astype(np.uint64) << np.uint64(32) | np.uint64(size)
                    key = _mixed(_mixed(gram) ^ where)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(key), visits)),
                         b.column(0).take(at), b.column(1).take(at)],
                        names=["list", "visits", "word", "n"])

    return words.select("word", "n").mapInArrow(
        lean(run), "list long, visits boolean, word binary, n long")


# -------------------------------------------------------------- verification
def _hashes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hashes of each word without each of its letters)."""
    wide = letters.shape[1]
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(wide, _BASE))))[:wide]
    code = _LETTERS[letters]
    kept, moved = code * power, code[:, 1:] * power[:-1]
    before = np.cumsum(kept, axis=1) - kept
    behind = np.cumsum(moved[:, ::-1], axis=1)[:, ::-1]
    behind = np.concatenate((behind, np.zeros((len(letters), 1), np.uint64)), axis=1)
    return kept.sum(axis=1, dtype=np.uint64), before + behind


def _equal_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with the same key.  Words of a list that are equal but for one letter
    are all one edit apart, so these are links, not candidates."""
    order = np.argsort(key, kind="stable")
    ordered, one, two = key[order], [], []
    left = np.arange(len(key) - 1)
    d = 1
    while len(left):
        left = left[left + d < len(key)]
        left = left[ordered[left] == ordered[left + d]]
        one.append(order[left])
        two.append(order[left + d])
        d += 1
    return (np.concatenate(one), np.concatenate(two)) if one else (left, left)


def _verified(lists_: np.ndarray, visits: np.ndarray, words: pa.Array):
    """(one, two): rows of words that are one edit apart and share a list."""
    one, two = [], []
    homes = {}
    size = pc.binary_length(words).to_numpy()
    for rows, letters in _by_length(words):
        whole, without = _hashes(letters)
        n, own = letters.shape[1], _mixed(lists_[rows])
        at_home = np.flatnonzero(~visits[rows])
        place = np.arange(n, dtype=np.uint64)
        key = _mixed(without[at_home] + _mixed(place)) ^ own[at_home, None]
        a, b = (x // n for x in _equal_runs(key.ravel()))
        a, b = at_home[a], at_home[b]
        near = (letters[a] != letters[b]).sum(axis=1) == 1
        one.append(rows[a[near]])
        two.append(rows[b[near]])
        homes[n] = (rows[at_home], letters[at_home],
                    (_mixed(without[at_home]) ^ own[at_home, None]).ravel())
        # those that visit from one letter less, which comes first in order of length
        guest = np.flatnonzero(visits & (size == n - 1))
        if len(guest) and len(at_home):
            home, full, keys = homes[n]
            less = np.frombuffer(b"".join(words.take(pa.array(guest)).to_pylist()),
                                 np.uint8).reshape(len(guest), n - 1)
            wanted = _mixed(_hashes(less)[0]) ^ _mixed(lists_[guest])
            order = np.argsort(keys, kind="stable")
            begin = np.searchsorted(keys[order], wanted, "left")
            found = np.searchsorted(keys[order], wanted, "right") - begin
            g = np.repeat(np.arange(len(guest)), found)
            upto = np.cumsum(found)
            where = order[np.arange(len(g)) + np.repeat(begin - upto + found, found)]
            h, gone = np.divmod(where, n)
            column = np.arange(n - 1)
            same = (np.take_along_axis(full[h], column + (column >= gone[:, None]), 1)
                    == less[g]).all(axis=1)
            one.append(guest[g[same]])
            two.append(home[h[same]])
        homes.pop(n - 1, None)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(one or empty), np.concatenate(two or empty)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists, sorted by list -> links, both ways; whole lists are merged together."""
    held: list[pa.RecordBatch] = []
    enough = LISTED

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = (rows.column(c).combine_chunks() for c in ("word", "n"))
        one, two = _verified(rows.column("list").to_numpy(),
                             rows.column("visits").to_numpy(), words)
        both = pa.array(np.concatenate((one, two))), pa.array(np.concatenate((two, one)))
        yield pa.RecordBatch.from_arrays(
            [words.take(both[0]), words.take(both[1]), n.take(both[1])],
            names=["word", "near", "near_n"])

    for b in batches:
        held.append(b)
        if sum(map(len, held)) < enough:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("list").to_numpy()
        begin = int(np.searchsorted(key, key[-1], "left"))      # the last list may go on
        if begin:
            yield from links(rows.slice(0, begin))
            held = rows.slice(begin).combine_chunks().to_batches()
        enough = LISTED if begin else 2 * enough
    if held:
        yield from links(pa.Table.from_batches(held))


def links(words: DataFrame, inner: np.ndarray, longest: int = GRAM_TO) -> DataFrame:
    """(word, near, near_n): every two words that are one letter inserted, deleted or
    replaced apart, both ways, once each."""
    return (lists(words, inner, longest).repartition("list").sortWithinPartitions("list")
            .mapInArrow(lean(_verify), "word binary, near binary, near_n long").distinct())


# --------------------------------------------------------------------- forms
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): each word's form's form, and so on to the last.
    Chains are halved a round; a form is ``RATIO`` times as frequent, so they are short."""
    done = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = done.select(F.col("word").alias("root"), F.col("root").alias("next"))
        done = written(done.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not done.where("moved").limit(1).count():
            return done.select("word", "root")
        done = done.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
             min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
             change: Callable[[bytes, int], bytes] = mutated) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    ``form`` is the most frequent word one edit away, if that is ``ratio`` times as
    frequent; ``root`` the last of its forms, or the word itself.
    """
    if min_length < GRAM_FROM + 1:
        raise ValueError(f"words of {GRAM_FROM + 1} letters or more")
    longest = min(GRAM_TO, min_length)      # a word has grams without a place in common
    words = written(vocabulary(docs, key, text, min_length, min_count, change), "spelling-words")
    near = (links(words, dictionary(words, longest), longest).groupBy("word")
            .agg(F.count("*").alias("n_near"),
                 F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    found = written(
        words.join(near, "word", "left")
        .withColumn("fits", -F.col("best.less") >= ratio * F.col("n"))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(F.col("fits"), F.col("best.near")).alias("form"),
                F.when(F.col("fits"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(found.where("form IS NOT NULL"))

    def as_text(column):
        return F.decode(column, "ISO-8859-1")

    return (found.join(last, "word", "left")
            .select(as_text(F.col("word")).alias("word"), as_text(F.col("form")).alias("form"),
                    as_text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n"))


def query(spark, sf_dir) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
