"""Source divergence audit: how the words of a language differ between its sources.

In-mapper stripes: a task folds whole documents into a hash of stripes, one per
(language, term): in how many documents the term stands, and how often in each
source.  A full hash is spilled as rows; the rows of a key meet once, sorted, and
are merged into one stripe.  A stripe of the empty term counts each source's
documents, so that sources without any term are known too.

A merged stripe holds all that a term adds to the figures: the share of the term
in a group (language, source) is ``p = 1 + floor(SCALE * (count + 1) / (N + V))``
over the V terms that the language keeps and the N occurrences of them there, and
its divergence of group g from h is ``floor((p_g - p_h)^2 / p_h)``.  Tasks add up
these of all pairs of a language's sources, ``BLOCK`` by ``BLOCK`` sources at a
time, and hand on the sums.  All arithmetic is in integers.

Cases: null text, language and source are the empty string; a text without terms
counts for its group alone; repeated rows and null ids are documents of their own;
a language with one source has no pairs; one that keeps no term has pairs of value
0 and no terms; an empty table gives no rows.  Columns other than the three named
ones are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from immolens.llm.common import lean, table, written
from immolens.llm.tokens import slices

SCALE = 1_000_000_000       # fixed by the contract, as are the next two
MIN_DOCS = 3                # documents of a language that a kept term stands in
TOP_TERMS = 200             # ranks of the terms of a group
HELD = 12 << 20             # bytes of text in a task's hash; then it is spilled
BLOCK = 64                  # sources compared at a time
MATRICES = 64               # sums of pairs of blocks that a task holds; then they are handed on
ROWS = 2_048                # stripes compared at a time
SPILLED_ROWS = 8_192        # stripes handed on at a time
DOCUMENTS = ""              # the term whose counts are documents

#: a-z for A-Z; other letters of ASCII stay, its other characters part terms
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
                   for c in range(256))

SPILLED = "lang string, term string, df long, sources array<string>, counts array<long>"
SUMS = "lang string, a int, b int, sums array<long>"


def _rows(lang, term, df, sizes, sources, counts) -> pa.RecordBatch:
    """Rows of stripes; ``sources`` and ``counts`` are all stripes' in a row."""
    at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.RecordBatch.from_arrays(
        [lang, term, pa.array(df, pa.int64()), pa.ListArray.from_arrays(at, sources),
         pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
        names=["lang", "term", "df", "sources", "counts"])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands."""
    keys = np.sort(keys)
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begin], np.diff(begin, append=len(keys))


def _folded(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    """The stripes of whole documents (lang, source, text as bytes), spilled."""
    lang, source = (docs.column(c).combine_chunks().dictionary_encode()
                    for c in ("lang", "source"))
    texts = docs.column("text").combine_chunks()
    _, at, data = texts.buffers()
    clean = (data or pa.py_buffer(b"")).to_pybytes().translate(TERM_BYTES)
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(
        pa.string(), len(texts), [None, at, pa.py_buffer(clean)], offset=texts.offset))
    words = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    code, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    blank = pc.index(words.dictionary, pa.scalar("")).as_py()
    doc, code = doc[code != blank], code[code != blank]
    # the empty term, once a document, is code n
    doc = np.concatenate((doc, np.arange(len(texts))))
    code = np.concatenate((code, np.full(len(texts), n)))
    n += 1
    once, times = _counted(doc * n + code)                  # terms of a document
    doc, code = np.divmod(once, n)
    stripe = lang.indices.to_numpy().astype(np.int64)[doc] * n + code
    key, df = _counted(stripe)
    own = stripe * len(source.dictionary) + source.indices.to_numpy()[doc]
    order = np.argsort(own, kind="stable")
    own, times = own[order], times[order]
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    counts = np.add.reduceat(times, begin)
    row, where = np.divmod(own[begin], len(source.dictionary))
    sizes = np.diff(np.searchsorted(row, key, "left"), append=len(row))
    upto = np.concatenate(([0], np.cumsum(sizes)))
    names = pa.concat_arrays([words.dictionary, pa.array([DOCUMENTS])])
    for some in range(0, len(key), SPILLED_ROWS):
        end = min(len(key), some + SPILLED_ROWS)
        of_lang, term = np.divmod(key[some:end], n)
        yield _rows(lang.dictionary.take(pa.array(of_lang)), names.take(pa.array(term)),
                    df[some:end], sizes[some:end],
                    source.dictionary.take(pa.array(where[upto[some]:upto[end]])),
                    counts[upto[some]:upto[end]])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) -> stripes of this task, each key as often as the
    hash was spilled, that is once per ``HELD`` bytes of whole documents."""
    held, size = [], 0
    for b in batches:
        for begin, end in slices(b.column(2), HELD):
            some = b.slice(begin, end - begin)
            more = pc.sum(pc.binary_length(some.column(2))).as_py() or 0
            if held and size + more > HELD:
                yield from _folded(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(some)
            size += more
    if held:
        yield from _folded(pa.Table.from_batches(held))


def _merged(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """One stripe of the rows from each place of ``first`` to the next."""
    own = rows.column("sources")
    coded = own.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(own).to_numpy())
    key = ((np.searchsorted(first, row, "right") - 1) * max(1, len(coded.dictionary))
           + coded.indices.to_numpy())
    order = np.argsort(key, kind="stable")
    key, counts = key[order], rows.column("counts").flatten().to_numpy()[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    stripe, code = np.divmod(key[begin], max(1, len(coded.dictionary)))
    at = pa.array(first)
    return _rows(rows.column("lang").take(at), rows.column("term").take(at),
                 np.add.reduceat(rows.column("df").to_numpy(), first),
                 np.bincount(stripe, minlength=len(first)), coded.dictionary.take(pa.array(code)),
                 np.add.reduceat(counts, begin))


def merge(min_docs: int):
    """Sorted rows of stripes -> one stripe a key; terms in too few documents go."""
    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pc.or_(pc.greater_equal(rows.column("df"), min_docs),
                                  pc.equal(rows.column("term"), DOCUMENTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None             # the last key's stripe so far
        for b in batches:
            if not len(b):
                continue
            if open_key is not None:
                b = pa.concat_batches([open_key, b.cast(open_key.schema)])
            new = np.ones(len(b), bool)
            new[1:] = pc.or_(*(pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, len(b) - 1))
                               for c in ("lang", "term"))).to_numpy(zero_copy_only=False)
            got = _merged(b, np.flatnonzero(new))
            open_key = got.slice(len(got) - 1)
            yield whole(got.slice(0, len(got) - 1))
        if open_key is not None:
            yield whole(open_key)

    return run


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
            min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, df, sources, counts): a merged stripe per kept term, and one per
    language whose term is empty and whose counts are documents.

    A key has at most one row per spill, so a frequent term is as many rows as tasks,
    not as documents; they are merged as a stream.
    """
    as_read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in
                            ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = (as_read.select("lang", "source", F.col("text").cast("binary").alias("text"))
             .mapInArrow(lean(fold), SPILLED))
    return (parts.repartition("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(lean(merge(min_docs)), SPILLED))


def groups(merged: DataFrame) -> DataFrame:
    """(lang, source, n, lang_n, v): every group that occurs, the occurrences N of kept
    terms in it and in its language, and the language's kept terms V."""
    each = (merged.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
            .groupBy("lang", F.col("x.sources").alias("source"))
            .agg(F.sum(F.when(F.col("term") != DOCUMENTS, F.col("x.counts")).otherwise(0)).alias("n")))
    langs = merged.groupBy("lang").agg(F.sum((F.col("term") != DOCUMENTS).cast("long")).alias("v"))
    whole = each.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    return each.join(langs, "lang").join(whole, "lang").select("lang", "source", "n", "lang_n", "v")


def scaled(count, total: int):
    """floor(SCALE * count / total) for integers count <= total < 9 * 10^15: three steps of
    long division in base 1000, so that nothing overflows."""
    out, rest = count * 0, count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return np.where(count == total, SCALE, out)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes beside two blocks of their language's groups -> sums of the divergences of
    each group of block a from each of block b, as often as the task hands them on."""
    sums: dict[tuple, np.ndarray] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([a], pa.int32()), pa.array([b], pa.int32()),
                 pa.array([m.ravel()], pa.list_(pa.int64()))], names=["lang", "a", "b", "sums"])
        sums.clear()

    def shares(block: list[dict], v: int, rows: pa.RecordBatch) -> np.ndarray:
        own, at = rows.column("sources"), pa.array([x["source"] for x in block])
        place = pc.index_in(own.flatten(), value_set=at)
        known = place.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy())
        counts = np.zeros((len(own), len(block)), np.int64)
        counts[row[known], place.drop_null().to_numpy()] = \
            rows.column("counts").flatten().to_numpy()[known]
        return 1 + np.stack([scaled(counts[:, j] + 1, x["n"] + v) if len(own) else counts[:, j]
                             for j, x in enumerate(block)], 1)

    for batch in batches:
        keys = pa.StructArray.from_arrays([batch.column(c) for c in ("lang", "a", "b")],
                                          ["lang", "a", "b"]).to_pylist()
        by: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            by.setdefault((key["lang"], key["a"], key["b"]), []).append(i)
        for key, rows in by.items():
            one, two, v = (batch.column(c)[rows[0]].as_py() for c in ("groups_a", "groups_b", "v"))
            own = sums.setdefault(key, np.zeros((len(one), len(two)), np.int64))
            for begin in range(0, len(rows), ROWS):
                some = batch.select(["term", "sources", "counts"]).take(
                    pa.array(rows[begin:begin + ROWS]))
                some = some.filter(pc.not_equal(some.column("term"), DOCUMENTS))
                p = shares(one, v, some)
                q = p if key[1] == key[2] else shares(two, v, some)
                for j in range(q.shape[1]):
                    off = p - q[:, j:j + 1]
                    own[:, j] += (off * off // q[:, j:j + 1]).sum(axis=0)
            if len(sums) > MATRICES:
                yield from handed()
    yield from handed()


def pairs(merged: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each group from each other source of
    its language, summed over all kept terms.  A language's sources come in blocks, and
    each stripe meets each pair of blocks once."""
    order = Window.partitionBy("lang").orderBy("source")
    placed = known.select("lang", "source", "n", "v", (F.row_number().over(order) - 1).alias("i"))
    blocks = (placed.groupBy("lang", (F.col("i") / BLOCK).cast("int").alias("k"))
              .agg(F.sort_array(F.collect_list(F.struct("i", "source", "n"))).alias("g"),
                   F.first("v").alias("v")))
    blocks = written(blocks, "divergence-blocks")
    one = blocks.select("lang", "v", F.col("k").alias("a"), F.col("g").alias("groups_a"))
    two = blocks.select("lang", F.col("k").alias("b"), F.col("g").alias("groups_b"))
    sums = (merged.join(one, "lang").join(two, "lang")
            .select("lang", "term", "sources", "counts", "v", "a", "groups_a", "b", "groups_b")
            .mapInArrow(lean(_compare), SUMS))
    cells = (sums.select("lang", "a", "b", F.posexplode("sums").alias("at", "value"))
             .groupBy("lang", "a", "b", "at").agg(F.sum("value").alias("value")))
    width = F.size("groups_b")
    named = (cells.join(one, ["lang", "a"]).join(two, ["lang", "b"])
             .select("lang", F.expr("groups_a[div(at, size(groups_b))].source").alias("source"),
                     F.element_at("groups_b", (F.col("at") % width + 1).cast("int"))
                     .getField("source").alias("item"), "value"))
    return named.where("source <> item")


def terms(merged: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value): kept terms that stand in a group more often, for its
    size, than in its language."""
    def share(count: str, total: str):
        return (f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)))"
                f" div cast({total} + v as decimal(19,0))")

    each = (merged.where(F.col("term") != DOCUMENTS)
            .withColumn("in_lang", F.expr("aggregate(counts, 0L, (s, x) -> s + x)"))
            .select("lang", F.col("term").alias("item"), "in_lang",
                    F.explode(F.arrays_zip("sources", "counts")).alias("x"))
            .select("lang", "item", "in_lang", F.col("x.sources").alias("source"),
                    F.col("x.counts").alias("own")))
    return (each.join(known, ["lang", "source"])
            .select("lang", "source", "item", F.expr(share("own", "n")).alias("p"),
                    F.expr(share("in_lang", "lang_n")).alias("q"))
            .where("p > q")
            .select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups: part ``pair`` has the other
    sources, farthest first, part ``term`` the ``top`` terms that mark the group."""
    merged = written(stripes(docs, text, lang, source, min_docs), "divergence-stripes")
    known = written(groups(merged), "divergence-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [found.withColumn("rank", F.row_number().over(order)) for found in
              (pairs(merged, known), terms(merged, known))]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (ranked[0].withColumn("part", F.lit("pair")).select(columns)
            .unionAll(ranked[1].where(F.col("rank") <= top).withColumn("part", F.lit("term"))
                      .select(columns)))


def query(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
w AS (
  SELECT id, lang, source, term, count(*) AS n
  FROM (SELECT id, lang, source,
               unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
        FROM d) GROUP BY ALL),
kept AS (
  SELECT lang, term, sum(n) AS in_lang FROM w GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
size AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_n FROM kept GROUP BY lang),
own AS (
  SELECT lang, source, term, sum(n) AS own FROM w SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
grp AS (
  SELECT g.lang, g.source, coalesce(o.n, 0) AS n, coalesce(s.v, 0) AS v,
         coalesce(s.lang_n, 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(own) AS n FROM own GROUP BY ALL) o USING (lang, source)
  LEFT JOIN size s USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(o.own, 0) AS own,
         1 + {SCALE}::HUGEINT * (coalesce(o.own, 0) + 1) // (g.n + g.v) AS p,
         1 + {SCALE}::HUGEINT * (k.in_lang + 1) // (g.lang_n + g.v) AS q
  FROM grp g JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM p WHERE own > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                   ORDER BY value DESC, encode(item)) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
