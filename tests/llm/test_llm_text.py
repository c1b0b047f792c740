import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import zstandard

from immolens.llm import chat, decontaminate, langid, licenses, quality_rules, toxicity
from immolens.llm.common import table
from pyspark.sql import functions as F


# ---------------------------------------------------------------- language
def test_language_of_held_out_documents(spark, sf001):
    docs = table(spark, sf001, "documents")
    got = langid.query(spark, sf001).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = got.where("held_out and length(text) > 100").collect()
    assert len(held) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark, make_docs, odd_texts):
    dicts = {"en": b"the of and to in is that " * 40, "de": "der die und zu in ist dass ".encode() * 40}
    rows = langid.predict(make_docs(odd_texts + [(50, "the of and is"), (51, "der die und ist")]),
                          dicts).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["rejected"] for k in (1, 2, 3, 4))
    assert {r["lang_pred"] for r in langid.predict(make_docs([(1, "²³ ½ Ⅷ")]), dicts).collect()} == {"und"}
    assert by[50]["lang_pred"] == "en" and by[51]["lang_pred"] == "de"
    docs = make_docs(odd_texts)
    kept = langid.accepted(docs, dicts)
    assert kept.columns == docs.columns
    assert kept.count() == langid.predict(docs, dicts).where("not rejected").count()


def plain_language(dicts, text):
    """Fresh compressors for each piece, letters one by one."""
    low, gap = "", False
    for c in (text or "").lower():
        if c.isalpha():
            low, gap = low + (" " if gap else "") + c, False
        else:
            gap = True
    low = (" " if text and not text.lower()[0].isalpha() else "") + low + (" " if gap and low else "")
    if not dicts or not low.strip():
        return "und", 0.0, True
    size = {}
    for name, data in dicts.items():
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(**langid.ENCODER)
        size[name] = sum(
            len(zstandard.ZstdCompressor(compression_params=settings, dict_data=raw).compress(
                low[i:i + langid.PIECE_CHARS].encode())) for i in range(0, len(low), langid.PIECE_CHARS))
    (least, best), (second, _) = sorted((n, k) for k, n in size.items())[:2]
    margin = (second - least) / second
    return best, min(1.0, margin / langid.FULL_MARGIN), margin < langid.MIN_MARGIN


def test_language_equals_plain_compression(spark, sf001, make_docs, odd_texts):
    docs = table(spark, sf001, "documents").select("doc_id", "text")
    dicts = langid.train(langid.training_rows(table(spark, sf001, "documents")))
    assert len(dicts) == 4 and all(dicts.values())
    some = [(r["doc_id"], r["text"]) for r in docs.collect()]
    some += [(10_000, "Der Preis, 12 %!"), (10_001, "  the end"), (10_002, "x" * 4_500), (10_003, "é 1 à")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"])
           for r in langid.predict(make_docs(some), dicts).collect()}
    for key, text in some:
        want = plain_language(dicts, text)
        assert got[key][0] == want[0] and got[key][2] == want[2], key
        assert math.isclose(got[key][1], want[1], abs_tol=1e-12), key


def test_language_without_labels(make_docs, odd_texts):
    docs = make_docs(odd_texts).withColumn("lang", F.lit(None).cast("string"))
    dicts = langid.train(langid.training_rows(docs))
    assert dicts == {}
    assert {r["lang_pred"] for r in langid.predict(docs, dicts).collect()} == {"und"}
    assert langid.predict(make_docs([]), dicts).collect() == []


def test_every_sampled_row_is_in_the_dictionary(make_docs, words):
    r = random.Random(6)
    # long rows that begin with a page without letters, each with a word of its own
    names = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(4))
             for _ in range(300)]
    docs = make_docs([(i, "12 -- " * 400 + f"{name} " * 600) for i, name in enumerate(names)])
    data = langid.train(docs)["en"]
    assert len(data) <= langid.DICT_BYTES and len(data) > 0.98 * langid.DICT_BYTES
    assert {n for n in names if n in data.decode()} == set(names)
    # short rows leave their share to the others, and no letter is cut in two
    mixed = langid._dictionary(["ab"] * 200 + ["é" * 1_500] * 100)
    assert mixed.decode().count("ab") == 200 and len(mixed) > 0.98 * langid.DICT_BYTES
    # the parts come from all places of the texts
    begins = langid.train(make_docs([(i, "x " * 3_000 + "z " * 3_000) for i in range(100)]))["en"]
    assert b"x" in begins and b"z" in begins


def test_language_never_sees_held_out_rows(spark, sf001):
    docs = table(spark, sf001, "documents")
    seen = langid.training_rows(docs).select(langid.id_hash().alias("h")).where("h % 4 = 2")
    assert seen.count() == 0


# -------------------------------------------------------------------- chat
def test_chat_matches_sql(spark, sf001):
    got = sorted(tuple(r) for r in chat.query(spark, sf001).collect())
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf001}/conversations.parquet'")
    assert got == sorted(con.execute(chat.ORACLE_SQL).fetchall())
    assert got[0][0] == -1


TRICKY = ["", "\\b\\l<\\\\g", "\\" * 9_000 + "]" * 9_000, "</s><s>[assistant]x</s>", "\\", "\\\\<", "a]b[c>", "[/INST]\n", "é\U0001F600",
          "x" * 50_000, " \n"]


def test_marks_cannot_be_forged(spark):
    turns = spark.createDataFrame(
        [(str(i), j, role, text) for i, text in enumerate(TRICKY)
         for j, role in enumerate(("user", "assistant", "a]\\<b", "]\\" * 20_000, ""))],
        "conversation string, turn long, role string, text string")
    back = chat.read_turns(chat.format_turns(turns))
    want = {tuple(r) for r in turns.collect()}
    assert {(r["conversation"], r["turn"], r["role"], r["text"]) for r in back.collect()} == want
    assert {r["role"] for r in back.where("loss").collect()} == {"assistant"}


def test_layouts(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}',
         [("user", "a"), ("assistant", "")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}],'
         ' "system": "be"}', [("system", "be"), ("user", "q"), ("assistant", "r")]),
        ('{"output": "o", "instruction": "i", "input": ""}', [("user", "i"), ("assistant", "o")]),
        ('{"output": "o", "instruction": "i", "input": "c"}',
         [("user", "i\n\nc"), ("assistant", "o")]),
        ('{"prompt": "p", "completion": "c"}', [("user", "p"), ("assistant", "c")]),
        ('{"question": "q", "answer": "a", "context": "c"}', [("user", "c\n\nq"), ("assistant", "a")]),
        ('{"messages": []}', []), ('{"other": 1}', []), ('[1]', []),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(records)],
                               "record_id long, j string").select(
        "record_id", F.parse_json("j").alias("record"))
    got = collections.defaultdict(list)
    for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: r["turn"]):
        got[int(r["conversation"])].append((r["role"], r["text"]))
    assert got == {i: t for i, (_, t) in enumerate(records) if t}
    assert {r["record_id"] for r in chat.unmapped(df).collect()} == {6, 7, 8}


def test_further_fields_do_not_lose_a_record(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "a", "name": "n"},'
         ' {"role": "assistant", "content": "b"}], "source": "x"}',
         [("user", "a"), ("assistant", "b")]),
        ('{"prompt": "p", "completion": "c", "score": {"by": [1, 2]}}',
         [("user", "p"), ("assistant", "c")]),
        ('{"instruction": "i", "output": "o", "system": "s", "tag": null}',
         [("system", "s"), ("user", "i"), ("assistant", "o")]),
        # two layouts fit: the first of those that need most
        ('{"prompt": "p", "completion": "c", "question": "q", "answer": "a"}',
         [("user", "p"), ("assistant", "c")]),
        ('{"conv_id": "8", "turn": 3, "role": "user", "text": "t", "lang": "en"}', [("user", "t")]),
        # what is needed is not there
        ('{"prompt": "p", "answer": "a"}', []), ('{"messages": [{"role": "user"}], "x": 1}', []),
        ('{"messages": "text", "x": 1}', []), (None, []),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(records)],
                               "record_id long, j string").select(
        "record_id", F.parse_json("j").alias("record"), F.lit("clash").alias("layout"),
        F.lit("clash").alias("turn"))
    got = collections.defaultdict(list)
    for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: r["turn"]):
        got[int(r["conversation"])].append((r["role"], r["text"]))
    want = {i: t for i, (_, t) in enumerate(records) if t}
    want[8] = want.pop(4)
    assert got == want
    assert {r["record_id"] for r in chat.unmapped(df).collect()} == {5, 6, 7, 8}


def test_records_are_read_once(spark, sf001):
    records = table(spark, sf001, "conversations").select(
        F.lit("").alias("record_id"),
        F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    plan = chat.canonical_turns(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_chat_rows_with_nulls_and_ties(spark, tmpdir_path):
    rows = [(1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, None, "n"),
            (None, 0, "assistant", "lost"), (2, 0, "assistant", "x" * 30_000)]
    (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
     .withColumn("conversation", F.lit(5)).withColumn("record", F.lit("clash"))
     .write.parquet(f"{tmpdir_path}/conversations.parquet"))
    got = sorted((tuple(r) for r in chat.query(spark, tmpdir_path).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from "
                f"'{tmpdir_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(chat.ORACLE_SQL).fetchall(), key=str)


def test_chat_of_no_rows(spark, tmpdir_path):
    (spark.createDataFrame([], "conv_id long, turn long, role string, text string")
     .write.parquet(f"{tmpdir_path}/conversations.parquet"))
    assert [r["conv_id"] for r in chat.query(spark, tmpdir_path).collect()] == [-1]


# ----------------------------------------------------------------- quality
def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    count = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1
               for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_measures(make_docs, odd_texts, words):
    texts = [(i, x) for i, (_, x) in enumerate(odd_texts)] + [
        (100 + i, words(n, i, ["a", "b", "cc", "d#"]).replace(" ", " \n" if i % 3 else " "))
        for i, n in enumerate((2, 3, 4, 5, 9, 30, 80, 300))] + [
        (200, "one\ntwo\none\n\n one \none"), (201, "a b c a b c"), (202, "x x x x")]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names)
           for r in quality_rules.measures(make_docs(texts)).collect()}
    assert got == {i: plain_measures(x) for i, x in texts}


def test_estimates_find_the_good_rules():
    r, counted = random.Random(3), collections.Counter()
    for _ in range(5000):
        good = r.random() < 0.85
        # three rules that see bad texts with different chances, one that says nothing
        votes = [(-1 if not good and r.random() < p or good and r.random() < 0.001 else 1)
                 for p in (0.9, 0.7, 0.5)] + [0]
        counted[tuple(votes)] += 1
    model = quality_rules.estimate(sorted(counted.items()))
    assert 0.8 < model.prior < 0.9
    for votes in counted:
        want = all(v >= 0 for v in votes)
        assert (model.posterior(votes) >= 0.5) == want
    assert all(abs(model.accuracies()[j][0] - p) < 0.05 for j, p in enumerate((0.9, 0.7, 0.5)))
    assert quality_rules.estimate([]).prior == quality_rules.PRIOR


def test_a_rule_that_good_texts_trip_weighs_little():
    r, counted = random.Random(4), collections.Counter()
    for _ in range(20_000):
        # a third of the good texts trip the first rule; bad ones trip each by chance
        if r.random() < 0.08:
            votes = [-1 if r.random() < 0.6 else 1 for _ in range(8)]
        else:
            votes = [-1 if r.random() < 1 / 3 else 1] + [
                -1 if r.random() < 0.001 else 1 for _ in range(7)]
        counted[tuple(votes)] += 1
    model = quality_rules.estimate(sorted(counted.items()))
    # the true ratio is that of 1 / 3 and 0.6
    one = [weights[frozenset((j,))] for j, weights in enumerate(model.weights)]
    assert 0.91 < model.prior < 0.93 and abs(one[0] - math.log(1 / 3 / 0.6)) < 0.1
    assert all(against < -3 for against in one[1:])
    assert model.posterior((-1, *[1] * 7)) > 0.99
    assert model.posterior((1, -1, -1, -1, *[1] * 4)) < 0.5


def hot_source(scale, share):
    """Vote patterns of the operator's own rules: 8 % bad texts, each seen by several
    rules of both large groups, and ``share`` good ones of a source that writes symbols."""
    n, counted = 1_000 * scale, collections.Counter()
    counted[(1,) * 8] = int(n * (0.92 - share))
    counted[(1, -1, 1, 1, 1, 1, 1, 1)] = int(n * share)
    for k, (chars, lines) in enumerate(
            [((-1, 1, 1), (1, -1, -1)), ((1, -1, -1), (1, -1, 1)), ((-1, -1, -1), (-1, -1, -1)),
             ((1, 1, 1), (1, -1, -1))]):
        counted[(1, *chars, *lines, 1)] += 20 * scale + k
    return sorted(counted.items())


def own_model(counted):
    names = list(quality_rules.RULES)
    return quality_rules.estimate(counted, [tuple(map(names.index, g)) for g in quality_rules.GROUPS],
                                  list(quality_rules.GROUPS.values()))


def test_hot_source_that_one_rule_is_wrong_about_is_kept():
    # all-must-pass would drop these texts, at every size of the table
    for scale in (1, 100, 100_000):
        counted = hot_source(scale, 1 / 3)
        model = own_model(counted)
        for votes, _ in counted:
            bad = sum(v < 0 for v in votes) > 1
            assert (model.posterior(votes) < 0.5) == bad, (scale, votes)
        # rare lone votes are believed
        assert own_model(hot_source(scale, 0.02)).posterior((1, -1, 1, 1, 1, 1, 1, 1)) < 0.5


def test_rules_of_a_group_are_not_counted_twice():
    # the second rule repeats the first one's votes: being told twice changes nothing
    r, one, two = random.Random(9), collections.Counter(), collections.Counter()
    for _ in range(20_000):
        bad = r.random() < 0.2
        a, b = (-1 if r.random() < (0.5 if bad else 0.1) else 1 for _ in range(2))
        c = -1 if bad and r.random() < 0.8 else 1
        one[a, b, c] += 1
        two[a, a, b, c] += 1
    single = quality_rules.estimate(sorted(one.items()))
    tied = quality_rules.estimate(sorted(two.items()), [(0, 1), (2,), (3,)])
    for a, b, c in one:
        assert abs(single.posterior((a, b, c)) - tied.posterior((a, a, b, c))) < 0.02


def test_probability_is_that_of_the_estimate(make_docs, words):
    texts = [(i, words(100 + i, i) if i % 5 else words(90, i).replace(" ", "*** ").upper())
             for i in range(60)] + [(60, ""), (61, None), (62, "one two")]
    judged = quality_rules.judge(quality_rules.measures(make_docs(texts)))
    rows = judged.collect()
    names = [f"vote_{n}" for n in quality_rules.RULES]
    counted = collections.Counter(tuple(r[n] for n in names) for r in rows)
    model = own_model(sorted(counted.items()))
    for r in rows:
        p = model.posterior([r[n] for n in names])
        assert math.isclose(r["probability"], p, rel_tol=1e-9)
        assert r["doc_id"] >= 60 or (p >= 0.5) == bool(r["doc_id"] % 5)


def test_quality_against_labels(spark, sf001):
    rows = quality_rules.query(spark, sf001).join(table(spark, sf001, "labels"), "doc_id").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_quality_of_no_documents(make_docs):
    assert quality_rules.judge(quality_rules.measures(make_docs([]))).collect() == []


# ---------------------------------------------------------------- toxicity
def toxic_table(words, n=400):
    r, rows = random.Random(8), []
    for i in range(n):
        bad = i % 5 == 0
        text = words(r.randrange(20, 200), i).split()
        if bad:
            text.insert(r.randrange(len(text)), r.choice(["zorgle", "blarg", "snirt"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxic_documents_are_found(spark, make_docs, words):
    rows = toxic_table(words)
    docs = make_docs([(i, x) for i, x, _ in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 4] + [(None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    machine = toxicity.learn(*toxicity.sample(docs, labels))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    held = [(scored[i], t) for i, _, t in rows if i % 4 == 0]
    assert all((s >= 0.5) == bool(t) for s, t in held)


def test_logits_equal_the_sum_over_pairs():
    r = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(12), r.uniform(0.1, 1, 12), -0.3, r.normal(size=12),
                               r.normal(size=(12, toxicity.FACTORS)))
    texts = [[], [4], [1, 7], list(range(12)), [], [0, 3, 5, 11]]
    got = machine.logits(np.array(sum(texts, []), np.int64), np.cumsum([len(t) for t in texts]))
    for t, logit in zip(texts, got, strict=True):
        x, v = machine.values, machine.factors
        want = machine.bias + sum(machine.weights[i] * x[i] for i in t) + sum(
            x[i] * x[j] * sum(v[i][f] * v[j][f] for f in range(toxicity.FACTORS))
            for i, j in itertools.combinations(t, 2))
        assert math.isclose(logit, want, rel_tol=1e-9)


def plain_sample(rows):
    """(values of the sure buckets, values of those that tell beside a toxic one)."""
    texts = [({b for w in re.findall("[^\x20\x09-\x0D]+", x) for b in toxicity.buckets(w)} - {-1}, t)
             for x, t in rows]
    n, k = len(texts), sum(t for _, t in texts)
    width = toxicity.SURE_AT - toxicity.SURE_FROM
    every = set().union(*(b for b, _ in texts))
    sure = {}
    for b in every:
        nb, kb = sum(b in x for x, _ in texts), sum(t for x, t in texts if b in x)
        spread = math.sqrt(nb * (1 - nb / n) * k * (n - k) / n / n) + 1e-9
        value = ((abs(kb - nb * k / n) - 0.5) / spread - toxicity.SURE_FROM) / width
        if nb >= toxicity.MIN_DOCS and value > 0:
            sure[b] = (value, kb > nb * k / n)
    strata = collections.defaultdict(list)
    for x, t in texts:
        bad = [(sure[b][0], b) for b in x if b in sure and sure[b][1]]
        if bad:
            strata[max(bad)[1]].append((x, t))
    paired = {}
    for b in every - sure.keys():
        nb, off, spread = 0, 0.0, 0.0
        for own in strata.values():
            m, here, rate = len(own), sum(b in x for x, _ in own), sum(t for _, t in own) / len(own)
            nb, off = nb + here, off + sum(t - rate for x, t in own if b in x)
            spread += here * (1 - here / m) * rate * (1 - rate)
        value = ((abs(off) - 0.5) / (math.sqrt(spread) + 1e-9) - toxicity.SURE_FROM) / width
        if nb >= toxicity.MIN_DOCS and spread > 1e-6 and value > 0:
            paired[b] = min(1.0, value)
    return {b: min(1.0, v) for b, (v, _) in sure.items()}, paired


def test_buckets_equal_plain_counts(spark, make_docs, words):
    rows = []
    for i in range(600):
        own = {0: "snirt", 1: "grobble mulvane", 2: "grobble mulvane", 3: "snirt", 4: "grobble",
               5: "mulvane", 6: "mulvane", 7: "mulvane", 8: "mulvane"}.get(i % 12, "")
        rows.append((i, f"{words(20, i)} {own} {words(10, 900 + i)}", int(i % 12 < 4)))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    learned, value, paired = toxicity.sample(make_docs([(i, x) for i, x, _ in rows]), labels)
    sure, beside = plain_sample([(x, t) for _, x, t in rows])
    assert len(learned) == 600 and sure and beside and paired == beside.keys()
    assert value.keys() == sure.keys() | beside.keys()
    assert all(math.isclose(value[b], v, rel_tol=1e-6, abs_tol=1e-9)
               for b, v in (sure | beside).items())


def test_machine_learns_a_pair():
    # either word alone is mostly harmless, both together are not
    r, rows = random.Random(1), []
    for i in range(600):
        a, b = r.random() < 0.35, r.random() < 0.35
        rows.append((i, int(a and b), [k for k, x in ((3, a), (9, b)) if x]))
    machine = toxicity.learn(rows, {3: 1.0, 9: 1.0})
    import numpy as np
    logit = {len(x): machine.logits(np.array(x, np.int64), np.array([len(x)]))[0]
             for x in ([], [0], [0, 1])}
    assert logit[0] < 0 and logit[1] < 0 < logit[2]
    assert (machine.factors[0] * machine.factors[1]).sum() != 0


def test_insult_beside_a_group_mention_is_learned(spark, make_docs, words):
    # the mention is as frequent in clean as in toxic texts; the insult beside it is
    # toxic, alone it mostly is not; another insult is toxic by itself
    rows = []
    for i in range(1_200):
        kind = i % 12
        own = {0: "snirt", 1: "grobble mulvane", 2: "grobble mulvane", 3: "snirt",
               4: "grobble", 5: "mulvane", 6: "mulvane", 7: "mulvane", 8: "mulvane"}.get(kind, "")
        rows.append((i, f"{words(30, i)} {own} {words(20, 5_000 + i)}", int(kind < 4)))
    docs = make_docs([(i, x) for i, x, _ in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 5], "doc_id long, toxic int")
    learned, value, paired = toxicity.sample(docs, labels)
    assert toxicity.buckets("mulvane")[0] in paired
    assert toxicity.buckets("grobble")[0] in value.keys() - paired
    machine = toxicity.learn(learned, value, paired)
    at = list(machine.buckets).index(toxicity.buckets("mulvane")[0])
    assert machine.weights[at] == 0 and abs(machine.factors[at]).max() > 0.1
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    held = [(scored[i], t) for i, _, t in rows if i % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.98 * len(held)


def test_needed_count_does_not_follow_the_size(spark, make_docs, monkeypatch):
    # an insult of four toxic texts and no clean one, one text in nine is toxic
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 40)
    for toxic in (40, 80):
        rows = [(i, int(i < toxic)) for i in range(9 * toxic)]
        chosen = toxicity.sample(make_docs([(i, "plain") for i, _ in rows]), spark.createDataFrame(
            rows, "doc_id long, toxic int"))[0]
        assert (sum(t for _, t, _ in chosen), len(chosen)) == (40, 80)
        some = {d for d, t, _ in chosen if t}
        some = set(sorted(some)[:4])
        docs = make_docs([(i, "plain zorgle" if i in some else "plain") for i, _ in rows])
        value = toxicity.sample(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))[1]
        assert toxicity.buckets("zorgle")[0] in value


def test_toxicity_of_odd_texts(spark, make_docs, odd_texts, words):
    rows = toxic_table(words, 200)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    machine = toxicity.learn(*toxicity.sample(make_docs([(i, x) for i, x, _ in rows]), labels))
    got = toxicity.score(make_docs(odd_texts), machine).collect()
    assert len(got) == len(odd_texts) and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score(make_docs([]), machine).collect() == []


def test_toxicity_without_labels(spark, make_docs, odd_texts):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(*toxicity.sample(make_docs(odd_texts), none)) is None
    assert {r["score"] for r in toxicity.score(make_docs(odd_texts), None).collect()} == {0.0}


# ---------------------------------------------------------------- licences
def test_licence_places(make_docs, odd_texts):
    texts = [(i, x) for i, (_, x) in enumerate(odd_texts)] + [
        (100, "Under the MIT License. under THE mit-license, cc BY-NC"),
        (101, "apache license version 2 apache license version 2.0"), (102, "mit license"),
        (103, "under the mit"), (104, "CC-BY NC cc by nc cc by"), (105, "x" * 9 + " éapache license")]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                         r["base_labels"]) for r in licenses.scan(make_docs(texts)).collect()}
    assert got == {i: licenses.brute_force(x) for i, x in texts}


def test_licence_templates_find_themselves(make_docs):
    texts = [(i, f"header {i} code. {text}. more words follow")
             for i, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows = {r["doc_id"]: r for r in licenses.scan(make_docs(texts)).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in rows[i]["labels"].split(","), (label, rows[i])
        assert rows[i]["score"] == 1.0


def test_licences_of_files_with_many_index_words(make_docs):
    notices = [(label, text) for label, text, _ in licenses.TEMPLATES]
    pairs = [(a, b) for a in notices for b in notices if a[1] != b[1]]
    stray = " ".join(licenses.index()[::-1])
    texts = [(i, f"{a}. some code. {b}") for i, ((_, a), (_, b)) in enumerate(pairs)]
    texts += [(10_000 + i, f"{stray} code {text} code {stray}") for i, (_, text) in enumerate(notices)]
    texts += [(20_000, " code. ".join(text for _, text in notices))]
    rows = {r["doc_id"]: r for r in licenses.scan(make_docs(texts)).collect()}
    want = {i: {a, b} for i, ((a, _), (b, _)) in enumerate(pairs)}
    want |= {10_000 + i: {label} for i, (label, _) in enumerate(notices)}
    want[20_000] = {label for label, _ in notices}
    assert {i: own - set(rows[i]["labels"].split(",")) for i, own in want.items()} == {
        i: set() for i in want}
    assert {r["score"] for r in rows.values()} == {1.0}
    # exactly where the mandatory phrases stand
    for i, text in texts:
        held = licenses.re.findall(r"[a-z0-9]+", text)
        for t, (label, _, _) in enumerate(licenses.TEMPLATES):
            stands = any(all(at + s >= 0 and held[at + s:at + s + len(p)] == p
                             for at, p in licenses.mandatory(t)) for s in range(-60, len(held)))
            assert not stands or label in rows[i]["labels"].split(",")


def test_licence_words_out_of_place_say_nothing(make_docs):
    rows = licenses.scan(make_docs([
        (1, "the license was public and general; gnu is an animal, version 3 of it"),
        (2, "license mit mit nc creative"), (3, "Public domain and unencumbered software")]))
    assert {r["labels"] for r in rows.collect()} == {""}


def test_licences_of_no_documents(make_docs):
    assert licenses.scan(make_docs([])).collect() == []


# --------------------------------------------------------- decontamination
def leak_tables(spark, make_docs, words):
    stock = [f"{a}{b}{c}{d}" for a in "bcdfgklmnprst" for b in "aeiou"
             for c in ("rt", "ll", "sh", "nd", "st") for d in ("a", "e", "in", "or", "um", "ix")]
    r = random.Random(5)
    items = [(k, words(r.randrange(15, 100), 500 + k, stock) + ". " + words(8, 900 + k, stock) + ".")
             for k in range(30)]
    docs, leaks = [], set()
    for i in range(300):
        text = words(r.randrange(0, 400), 2000 + i, stock).split()
        if i % 6 == 0:
            item, passage = r.choice(items)
            own = passage.split()
            if i % 12 == 0:                     # a paraphrase: some words go or change
                own = [w for w in own if r.random() > 0.12]
                own[len(own) // 2] = "changed"
            at = r.randrange(len(text) + 1)
            text[at:at] = own
            leaks.add((i, item))
        docs.append((i, " ".join(text)))
    benchmark = spark.createDataFrame(items + [(77, None), (78, ""), (None, "x y z")],
                                      "item_id long, text string")
    return make_docs(docs), benchmark, leaks


def test_leaks_are_found(spark, make_docs, words):
    docs, benchmark, leaks = leak_tables(spark, make_docs, words)
    found = {(r["doc_id"], r["item_id"]) for r in
             decontaminate.contaminated(docs, benchmark).collect()}
    assert len(found & leaks) >= 0.95 * len(leaks) and not found - leaks
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(300)) - {d for d, _ in found}


def test_latent_search_recall(spark, make_docs, words):
    """Of the windows' and passages' matches by subsequence alone, the latent search
    finds at least nine in ten."""
    docs, benchmark, _ = leak_tables(spark, make_docs, words)
    texts = {r["doc_id"]: decontaminate.words_of(r["text"]) for r in docs.collect()}
    brute = set()
    for item, text in [(r["item_id"], r["text"]) for r in benchmark.collect()
                       if r["item_id"] is not None]:
        for _, own, answer in decontaminate.passages(item, text):
            number = {w: k for k, w in enumerate(dict.fromkeys([*own, *answer]))}
            masks, last = (decontaminate._masks([number[w] for w in x]) for x in (own, answer))
            for d, whole in texts.items():
                for at in range(0, max(1, len(whole)), decontaminate.HOP):
                    near = [number.get(w, -1) for w in
                            whole[max(0, at - decontaminate.HOP):at + 3 * decontaminate.HOP]]
                    if (decontaminate.lcs(masks, len(own), near) >= 0.6 * len(own)
                            and decontaminate.lcs(last, len(answer), near) >= 0.5 * len(answer)):
                        brute.add((d, item))
    found = {(r["doc_id"], r["item_id"]) for r in
             decontaminate.contaminated(docs, benchmark).collect()}
    assert brute and len(found & brute) >= 0.9 * len(brute) and found <= brute


def test_copies_of_a_benchmark_larger_than_the_rank_are_found(spark, make_docs, words):
    stock = [f"{a}{b}{c}{d}" for a in "bcdfgklmnprst" for b in "aeiou"
             for c in ("rt", "ll", "sh", "nd", "st") for d in ("a", "e", "in", "or", "um", "ix")]
    items = [(k, words(39, 5_000 + k, stock)) for k in range(2_400)]
    docs = [(k, f"{words(13 + k % 37, 10_000 + k, stock)} {text} {words(40, 20_000 + k, stock)}")
            for k, text in items[::8]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"])
             for r in decontaminate.contaminated(make_docs(docs), benchmark).collect()}
    assert found == {(k, k) for k, _ in docs}


def test_basis_is_that_of_the_exact_svd(spark, words):
    import numpy as np
    stock = [f"{a}{b}" for a in "bcdfgklm" for b in ("ar", "el", "in", "os")]
    items = [(k, words(40, k, stock)) for k in range(25)]
    weights = np.ones(decontaminate.TERMS, np.float32)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    terms, rows = decontaminate.latent_basis(benchmark, weights, rank=6)
    matrix = np.zeros((25, len(terms)))
    for k, (_, text) in enumerate(items):
        at, x = decontaminate._vector(decontaminate.words_of(text), weights)
        matrix[k, np.searchsorted(terms, at)] = x
    exact = np.linalg.svd(matrix, full_matrices=False)[2][:6]
    # both spans hold the same share of the matrix
    assert np.linalg.norm(matrix @ rows) >= 0.995 * np.linalg.norm(matrix @ exact.T)


def test_lcs():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.lcs(decontaminate._masks(a), len(a), b) == best[-1][-1]


def test_items_of_common_words_are_found_word_for_word(spark, make_docs, words):
    benchmark = spark.createDataFrame([(1, "the of and to in"), (2, "to in the of the")],
                                      "item_id long, text string")
    docs = [(i, "the of and to in " + words(80, i)) for i in range(20)]
    docs += [(50, "and to in the of the"), (51, "to in the of"), (52, "the of and"),
             (53, "to in the of"), (None, "x y the of and, To in. z")]
    got = {(r["doc_id"], r["item_id"], r["lcs"]) for r in
           decontaminate.contaminated(make_docs(docs), benchmark).collect()}
    assert got == {*((i, 1, 1.0) for i in range(20)), (50, 2, 1.0), (None, 1, 1.0)}
    assert {r["doc_id"] for r in decontaminate.clean(make_docs(docs), benchmark).collect()} == {
        51, 52, 53}


def test_blocks_are_cleaned_one_after_the_other(spark, make_docs, words, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_PASSAGES", 2)
    items = [(i, words(60, 900 + i, [f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20)]))
             for i in range(5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"{words(40, i)} {t} {words(40, 50 + i)}") for i, t in items]
    docs += [(100 + i, words(90, 70 + i)) for i in range(30)]
    assert {r["doc_id"] for r in decontaminate.clean(make_docs(docs), benchmark).collect()} == {
        100 + i for i in range(30)}


def test_decontamination_of_odd_texts(spark, make_docs, odd_texts, words):
    benchmark = spark.createDataFrame([(1, words(30, 1)), (1, words(30, 1))],
                                      "item_id long, text string")
    docs = make_docs(odd_texts)
    assert decontaminate.contaminated(docs, benchmark).collect() == []
    assert decontaminate.clean(docs, benchmark).count() == len(odd_texts)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.clean(docs, none).count() == len(odd_texts)
    assert decontaminate.clean(make_docs([]), benchmark).collect() == []


@pytest.mark.parametrize("name", ["op1_language_id", "op5_toxicity"])
def test_classifiers_give_a_row_per_document(spark, sf001, name):
    from immolens.llm.queries import QUERIES
    rows = QUERIES[name](spark, sf001)
    assert rows.count() == table(spark, sf001, "documents").count()


def test_other_wordings_of_licences(make_docs, words):
    wordings = [
        ("GNU General Public License (GPL), version 3", "gpl-3"),
        ("the GNU General Public License v3 or later", "gpl-3"),
        ("GNU General Public License (GPL) version 2.", "gpl-2"),
        ("# SPDX-License-Identifier: GPL-3.0-only", "gpl-3"),
        ("// SPDX-License-Identifier: Apache-2.0", "apache-2"),
        ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("a Creative Commons Attribution 3.0 license", "cc-by"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or "
         "without fee is hereby granted", "isc"),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a "
         "copy of the software and accompanying documentation covered by this license", "bsl-1"),
        ("the GNU Affero General Public License v3", "agpl-3"),
        ("under the terms of the GNU Affero General Public License, version 3", "agpl-3"),
        # other versions and other identifiers have no label
        ("under the terms of the GNU Affero General Public License version 1", ""),
        ("SPDX-License-Identifier: Zlib", ""),
    ]
    docs = make_docs([(i, f"{words(40, i)}\n{x}\n{words(30, 99 + i)}")
                      for i, (x, _) in enumerate(wordings)])
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert got == {i: label for i, (_, label) in enumerate(wordings)}
