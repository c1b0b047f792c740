import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that the operators use themselves
          "t string, w string, at long, u long, n long, row string, body string, fp long, "
          "label string, score double, kept string, ids string, __text string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with extra columns of clashing names."""
    def make(pairs, lang="en"):
        rows = [(i, x, lang if x else None, None, len(x or ""), *[None] * 13) for i, x in pairs]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture(scope="session")
def words():
    """Invented prose from a seed."""
    def make(n, seed, stock="the of and heron stable copper linen orbit vessel quartz meadow "
             "lantern cipher harbor velvet thistle ember glacier".split()):
        r = random.Random(seed)
        return " ".join(r.choice(stock) + r.choice(["", "", "s", "ing", "ed"]) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, without letters, other scripts, marks and a very long one."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "123 !!"), (5, "日本語 テキスト é"),
            (6, "x"), (7, "a\x1cb \x85 c d"), (None, "no name here"), (8, "same"),
            (8, "same"), (9, "word " * 60_000), (10, "a" * 5_000)]


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"
