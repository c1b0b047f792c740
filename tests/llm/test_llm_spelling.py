import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from immolens.llm import spelling
from immolens.llm.common import table


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(texts, min_length=6, min_count=5, ratio=5):
    """The contract in plain Python; texts are (id, text)."""
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    counts = collections.Counter()
    for own, text in texts:
        own = "" if own is None else own
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{own}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    by = collections.defaultdict(set)
    for w in words:                                 # words with a string in common that is
        for i in range(len(w)):                     # one of them without a letter
            by[w[:i] + w[i + 1:]].add(w)
        by[w].add(w)
    links = collections.defaultdict(set)
    for some in by.values():
        for a, b in itertools.combinations(some, 2):
            if near(a, b):
                links[a].add(b)
                links[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(links[w]), words.get(form.get(w)))
                  for w, n in words.items())


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def misspelt(r, word, letters="abcdeéß"):
    i = r.randrange(len(word))
    return r.choice([word[:i] + word[i + 1:], word[:i] + r.choice(letters) + word[i + 1:],
                     word[:i] + r.choice(letters) + word[i:]])


@pytest.fixture(scope="session")
def corpus():
    """Words of few letters, so that many are close, and their variants of variants."""
    r = random.Random(12)
    stock = ["".join(r.choice("abcdeéß") for _ in range(r.randint(6, 9))) for _ in range(120)]
    stock += [w[:3] + "ization" for w in stock[:60]]
    for _ in range(2):
        stock += [misspelt(r, w) for w in stock]
    out = []
    for w in stock:
        out += [w] * int(r.paretovariate(0.5) * 5 if r.random() < 0.3 else r.randint(3, 9))
    out = [w if r.random() < 0.9 else w.upper() for w in out]
    r.shuffle(out)
    return [(i % 700, " ".join(out[k:k + 40])) for i, k in enumerate(range(0, len(out), 40))]


SCHEMA = "doc_id long, text string, word string, list long, n string, root string"


@pytest.fixture()
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "y", None) for i, t in rows], SCHEMA)
    return make


def test_against_plain_python(docs, corpus):
    want = brute(corpus)
    got = rows_of(spelling.variants(docs(corpus)))
    assert got == want
    assert sum(w[1] is not None for w in want) > 50 and sum(w[4] for w in want) > 500
    assert any(w[2] != w[1] for w in want if w[1])          # chains of more than one form


def test_pruned_dictionaries_find_the_same(docs, corpus, monkeypatch):
    want = brute(corpus)
    for frequent, size, listed in ((0, 1 << 16, 50), (3, 100, 7), (10 ** 9, 5, 1 << 16)):
        monkeypatch.setattr(spelling, "FREQUENT", frequent)
        monkeypatch.setattr(spelling, "DICTIONARY", size)
        monkeypatch.setattr(spelling, "LISTED", listed)
        assert rows_of(spelling.variants(docs(corpus).repartition(5))) == want


def test_bounds_hold_for_every_edit():
    """One edit changes at most ``bound`` grams, and a common one is listed in both words."""
    r = random.Random(4)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(6, 12))) for _ in range(400)]
    inner = np.array(sorted({int(g) for w in words for n in range(2, 5) for g in spelling._packed(
        spelling._marked(np.frombuffer(w.encode(), np.uint8)[None]), n).ravel() if g % 3}))
    grams = spelling.Grams(inner)

    def keys(word):
        _, gram, place = grams.listed(np.frombuffer(word.encode(), np.uint8)[None])
        return set(zip(gram.tolist(), place.tolist(), strict=True))

    for w in words:
        other = misspelt(r, w, "abcd")
        if other == w or len(other) < 6:
            continue
        a, b = sorted((w, other), key=len)
        shifts = (0, 1) if len(a) < len(b) else (0,)
        assert {(g, p + s) for g, p in keys(a) for s in shifts} & keys(b), (a, b)


def test_a_long_list_costs_its_length():
    """Words of one list that are far apart give nothing, without comparing all pairs."""
    r = random.Random(7)
    words = list({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) + "ending"
                  for _ in range(30_000)})
    words += ["x" + words[0][1:], words[1][:4] + words[1][5:]]
    visits = np.array([False] * (len(words) - 1) + [True])
    one, two = spelling._verified(np.zeros(len(words), np.int64), visits,
                                  pa.array([w.encode() for w in words], pa.binary()))
    got = {frozenset((words[i], words[j])) for i, j in zip(one, two, strict=True)}
    assert frozenset((words[0], words[-2])) in got and frozenset((words[1], words[-1])) in got
    assert all(near(*sorted(p)) for p in got)


def test_odd_texts(spark, docs, odd_texts, make_docs):
    long = "q" * 20_000
    rows = [*odd_texts, *[(i, f"{long} {long}z Straße STRASSE naïveté naïvete") for i in range(6)],
            (None, "vessel vessels " * 6), (None, "vessel vessels " * 6), (None, "ÀÉÎÕÜ×÷ " * 6)]
    want = brute(rows)
    assert any(len(w[0]) == 20_000 for w in want)
    assert rows_of(spelling.variants(docs(rows))) == want
    assert rows_of(spelling.variants(make_docs(odd_texts))) == brute(odd_texts)
    assert rows_of(spelling.variants(docs([]))) == []


def test_other_parameters(docs):
    rows = [(1, "cat cats cat bat bats at cat cat cat cat")]
    got = rows_of(spelling.variants(docs(rows), min_length=3, min_count=1, ratio=2,
                                    change=lambda run, before: run))
    assert got == [("bat", "cat", "cat", 1, 2, 6), ("bats", None, "bats", 1, 2, None),
                   ("cat", None, "cat", 6, 2, None), ("cats", "cat", "cat", 1, 2, 6)]
    with pytest.raises(ValueError):
        spelling.variants(docs(rows), min_length=2)


def test_query(spark, sf001):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf001, "documents").collect()]
    assert rows_of(spelling.query(spark, sf001)) == brute(texts)
