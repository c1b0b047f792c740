import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from immolens.llm import graph, simhash, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius=3):
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints) <= radius
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints(odd_texts, words):
    for _, text in [*odd_texts[:10], (0, words(200, 1)), (0, "One TWO É Three"), (0, "a b")]:
        got = simhash.fingerprint(text) & (1 << 64) - 1
        assert got == plain_fingerprint(text), text


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bk_tree_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 400)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    values = np.unique(np.concatenate((base, near)))
    tree = simhash.BKTree(values)
    found = {(int(a), int(b)) for i, j in tree.within(np.arange(len(values)), radius)
             for a, b in zip(i, j, strict=True)}
    near = np.bitwise_count(values[:, None] ^ values) <= radius
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_lookups_follow_the_edges_within_the_radius():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 63, 3_000, dtype=np.uint64) & np.uint64((1 << 24) - 1))
    tree = simhash.BKTree(values)
    assert tree.nodes > len(values) // 20
    for radius, share in ((0, 0.05), (1, 0.25), (3, 0.8)):
        tree.compared = 0
        for _ in tree.within(np.arange(len(values)), radius):
            pass
        assert len(values) < tree.compared < share * len(values) ** 2, radius


def test_links_come_from_trees(spark, monkeypatch):
    """Shards are large enough to have nodes, and without look-ups there is no link."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    values = np.unique(np.concatenate((base, near)))
    classes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    keys = simhash.shard_keys(values, 3, simhash.key_bits(len(values), 3))
    shards = np.unique(keys, return_counts=True)[1]
    assert np.median(shards) > 10 * simhash.LEAF and keys.shape[1] == 4
    assert simhash.links(classes).count() >= 500
    monkeypatch.setattr(simhash.BKTree, "within", lambda self, asked, radius: iter(()))
    assert simhash.links(classes).count() == 0


def test_stage_of_clashing_names(spark):
    rows = [(1, "the same words here", "x", 5, 7, "r"), (2, "the same words here", "y", 5, 7, "r"),
            (None, "other words", "z", 1, 1, "q"), (None, "other words", "z", 1, 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, __id long, __n long, "
                                       "__kept string")
    for names in (docs.columns, ["doc_id", "text", "row", "first", "k", "fp"],
                  ["doc_id", "text", "__row", "__row_", "__row_k", "node.x"]):
        given = docs.toDF(*names)
        out = simhash.stage(spark, given, "")
        assert out.columns == names and out.dtypes == given.dtypes
        assert sorted(map(str, out.collect())) == sorted(map(str, given.collect()[::2]))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_near_pairs_share_a_shard(radius):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(radius):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    for n in (0, 1_000, 10 ** 6, 10 ** 9, 10 ** 13):
        bits = simhash.key_bits(n, radius)
        one, two = (simhash.shard_keys(x, radius, bits) for x in (a, b))
        assert (one == two).any(axis=1).all()
        assert one.shape[1] == (radius + 1) ** (2 if bits[1] else 1)
        assert sum(bits) >= min(64 // (radius + 1), np.log2(max(1, n // simhash.SHARD)))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(230)] + [(i, i + 1) for i in
                                                                          range(400, 460)]
    got = {x["node"]: x["root"] for x in graph.components(
        spark.createDataFrame(edges, "x long, y long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {n: root(n) for n in parent if root(n) != n}


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "x long, y long")).collect() == []


def near_texts(words):
    """Copies of a few texts with a word or two changed; thousands of exact copies of one."""
    r, out = random.Random(2), []
    for k in range(12):
        base = words(120, k).split()
        for j in range(6):
            own = list(base)
            for _ in range(j % 3):
                own[r.randrange(len(own))] = f"new{r.randrange(99)}"
            out.append((100 + 10 * k + j, " ".join(own)))
    return out + [(1000 + i, "the very same words in every copy") for i in range(300)]


def test_near_duplicates(make_docs, odd_texts, words):
    texts = odd_texts + near_texts(words)
    prints = simhash.fingerprints(make_docs(texts))
    got = {r["fp"] & (1 << 64) - 1: r["component_id"]
           for r in simhash.near_duplicates(prints).collect()}
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    own = np.array([plain_fingerprint(x) for _, x in order], np.uint64)
    label = reachable(own)
    assert got == {int(f): order[i][0] for f, i in zip(own, label, strict=True)}


def test_one_document_of_each_group_stays(spark, make_docs, odd_texts, words):
    texts = odd_texts + near_texts(words)
    docs = make_docs(texts)
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    own = np.array([plain_fingerprint(x) for _, x in order], np.uint64)
    want = [order[i][0] for i in sorted(set(reachable(own)))]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_of_no_documents(spark, make_docs):
    assert simhash.stage(spark, make_docs([]), "").collect() == []


# ------------------------------------------------------------ repeated strings
def plain_removal(bodies, depth=200):
    once, twice = set(), set()
    for b in bodies:
        for i in range(len(b) - depth + 1):
            (twice if b[i:i + depth] in once else once).add(b[i:i + depth])
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if b[i:i + depth] in twice:
                gone[i:i + depth] = b"\1" * depth
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def passage_texts(words):
    r, out = random.Random(6), []
    stock = [f"{a}{b}{c}" for a in "bcdfgk" for b in "aeiou" for c in ("rt", "ll", "sh", "n")]
    prose = lambda n, seed: words(n, seed, stock)       # noqa: E731
    whole = prose(400, 1)
    passages = [prose(n, 50 + n) for n in (30, 33, 36, 60, 90)]
    for k in range(40):
        parts = [prose(r.randrange(5, 60), 1000 + 7 * k + j) for j in range(4)]
        for p in r.sample(passages, 2):
            cut = r.choice([(0, len(p)), (3, len(p)), (0, len(p) - 5), (r.randrange(40), 260)])
            parts.insert(r.randrange(4), p[cut[0]:cut[1]])
        out.append((100 + k, " ".join(parts)))
    for k in range(6):                                  # pieces of one long text, overlapping
        out.append((200 + k, whole[150 * k:150 * k + r.randrange(190, 700)]))
    out += [(300, "é" * 150 + "x" * 260), (301, "z" + "é" * 150 + "y" * 199),
            (302, "ab" * 400), (303, "ab" * 99), (304, ("abc" * 70 + "-") * 3),
            (305, "q" * 200), (306, "r" * 201), (307, "é" * 101 + "tail " + prose(40, 7))]
    return out


def test_repeated_strings_go(make_docs, odd_texts, words):
    texts = [x for x in odd_texts if x[0] != 9] + passage_texts(words) + [(9, "word " * 2_000)]
    docs = make_docs([(i, x) for i, (_, x) in enumerate(texts)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffix_dedup.dedup(docs).collect()}
    want = plain_removal([(x or "").encode() for _, x in texts])
    for i, row in enumerate(want):
        assert got[i] == row, texts[i]


def test_repeated_rows_remove_each_other(make_docs, words):
    text = words(80, 3)
    rows = suffix_dedup.dedup(make_docs([(5, text), (5, text), (None, "short")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [
        (0, 0), (5, len(text)), (5, len(text))]


def test_triggers_are_never_far_apart(words):
    rng = np.random.default_rng(8)
    for text in (words(3000, 1).encode(), bytes(rng.integers(0, 4, 9000, dtype=np.uint8)),
                 b"\0" * 1000, b"ab" * 700):
        p = suffix_dedup.Parse(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        starts = np.concatenate([np.arange(b, e + 1) for b, e in zip(p.begin, p.last, strict=True)])
        # every suffix that is long enough has exactly one first trigger, inside its 200 bytes
        assert starts.tolist() == list(range(len(text) - suffix_dedup.DEPTH + 1))
        assert (p.at - p.begin <= suffix_dedup.REACH).all()


def test_passage_stage_keeps_whole_characters(spark, make_docs):
    shared = "é" * 130
    docs = make_docs([(1, "x" + shared + "tail"), (2, "yy" + shared + "end"), (3, None), (4, "")])
    out = suffix_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("xtail", 5), 2: ("yyend", 5), 3: (None, None), 4: ("", 0)}


def test_passages_of_no_documents(spark, make_docs):
    assert suffix_dedup.stage(spark, make_docs([]), "").collect() == []
