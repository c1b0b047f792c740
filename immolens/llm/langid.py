"""Language identification by compression (zstandard, raw-content dictionaries).

A text is compressed once per language with a dictionary of that language's
text; the language whose dictionary gives the smallest output wins.  The
margin between the two smallest outputs is the score: a narrow one is
rejected.

Cases: null text, empty text and text without a letter give ``und``, score 0,
rejected; rows without a label are not learned from; an empty or unlabelled
training table predicts ``und`` for everything; repeated rows and null ids get
one result each; ``accepted`` keeps all columns, whatever they are called, and
``predict`` the id alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import hash_sample, id_hash, lean, table
from immolens.llm.tokens import slices

SAMPLE_ROWS = 300           # labelled rows learned from, per language
SAMPLE_CHARS = 1_500        # of each such row, from a hashed place, at most
DICT_BYTES = 96 << 10       # dictionary size, per language
PIECE_CHARS = 2_000         # a text is compressed in pieces of this many characters, all of them
HANDED_ON = 4 << 20         # bytes of text whose rows are handed on together
MIN_MARGIN = 0.002          # narrower: rejected
FULL_MARGIN = 0.05          # this wide or wider: score 1
NOT_LETTERS = re.compile(r"[\W\d_]+")
# greedy matching from three bytes on: short syllables of the dictionary count
ENCODER = dict(strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=17, hash_log=16,
               chain_log=16, search_log=4, write_content_size=False, write_dict_id=False)


def letters(text: str) -> str:
    """Lower-cased letters; everything between them becomes one space."""
    return NOT_LETTERS.sub(" ", text.lower())


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionary bytes by language, from at most ``rows`` rows a language.

    The rows with the smallest hash of their id are taken, and of each the letters
    from a hashed place on: the sample is spread over all data.  All of them have a
    part of the dictionary.
    """
    chars = (labelled.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
             .select(F.col(lang).alias("l"), F.col(key).alias("k"),
                     F.trim(F.regexp_replace(text, "\\P{L}+", " ")).alias("t")))
    places = F.greatest(F.lit(1), F.length("t") - SAMPLE_CHARS + 1)
    begin = F.pmod(F.xxhash64("k", F.lit("place")), places.cast("long")).cast("int") + 1
    chars = chars.select("l", "k", F.col("t").substr(begin, F.lit(SAMPLE_CHARS)).alias("t"))
    sample = hash_sample(chars, "l", "k", rows, "t").select("l", F.col("__rank").alias("r"), "t")
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.toLocalIterator():
        texts.setdefault(row["l"], []).append((row["r"], letters(row["t"])))
    return {name: _dictionary([t for _, t in sorted(own)]) for name, own in sorted(texts.items())}


def _dictionary(texts: list[str]) -> bytes:
    """At most ``DICT_BYTES`` of the texts, from each an equal share; what short ones
    leave goes to the others."""
    lines = [t.encode() for t in texts]
    left, share = DICT_BYTES - len(lines) + 1, {}
    for done, i in enumerate(sorted(range(len(lines)), key=lambda i: len(lines[i]))):
        share[i] = min(len(lines[i]), left // (len(lines) - done))
        left -= share[i]
    # the end of a dictionary is the cheapest to refer to: a language with few
    # rows repeats none, it just has a shorter dictionary
    return b"\n".join(x[:share[i]].decode("utf-8", "ignore").encode() for i, x in enumerate(lines))


def _predictor(dicts: dict[str, bytes]):
    """(text) -> (language, score, rejected); compressors are made once a task."""
    names = list(dicts)
    encoders = []
    for name in names:
        data = zstandard.ZstdCompressionDict(dicts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(**ENCODER)
        data.precompute_compress(compression_params=settings)
        encoders.append(zstandard.ZstdCompressor(
            compression_params=settings, dict_data=data).compress)

    def predict(text: str | None) -> tuple[str, float, bool]:
        low = letters(text or "")
        if not names or not any(map(str.isalpha, low)):
            return "und", 0.0, True
        sizes = [0] * len(names)
        for at in range(0, len(low), PIECE_CHARS):
            piece = low[at:at + PIECE_CHARS].encode("utf-8", "replace")
            for i, encode in enumerate(encoders):
                sizes[i] += len(encode(piece))
        best = min(range(len(names)), key=lambda i: (sizes[i], i))
        if len(names) == 1:
            return names[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return names[best], min(1.0, margin / FULL_MARGIN), margin < MIN_MARGIN

    return predict


def predict(docs: DataFrame, dicts: dict[str, bytes], key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per input row.

    The dictionaries travel with the task: languages x ``DICT_BYTES``.
    """
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _predictor(dicts)
        for b in batches:
            got = [one(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), text)
            .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean"))


def accepted(docs: DataFrame, dicts: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    place = docs.columns.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _predictor(dicts)
        for b in batches:
            for begin, end in slices(b.column(place), HANDED_ON):
                some = b.slice(begin, end - begin)
                stay = [not one(t.as_py())[2] for t in some.column(place)]
                yield some.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: remainder 2 of the id's crc32 is held out."""
    return docs.where((id_hash() % 4 != 2) & F.col("lang").isNotNull())


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = train(training_rows(docs))
    return (predict(docs, dicts)
            .select("doc_id", (id_hash() % 4 == 2).alias("held_out"), "lang_pred", "score",
                    "rejected"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the identifier rejects go."""
    return accepted(docs, train(training_rows(docs)))
