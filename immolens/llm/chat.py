"""Chat formatting: records of any known layout to canonical turns to marked text.

A record's schema fingerprint is a hash of its nested field paths, without the
types of their values.  A fingerprint selects one declarative mapping, which says
where turns, roles and texts are: one record may be a whole conversation (lists of
messages, prompt and answer, instruction with input) or one turn of it.  A record
whose fingerprint is unknown, because it has further fields, is fingerprinted again
by the paths that a mapping needs and it has; of the mappings that fit, the one
that needs most paths is taken, then the first.  Records of an unknown layout are
kept apart with their fingerprint (``unmapped``).  Records are read and
fingerprinted once, whatever the number of mappings.

A turn is written as ``<s>[role]text</s>``.  Inside roles and texts a backslash
and a letter stand for every backslash and every character that can begin or end
a mark, so marks cannot be forged and reading back is exact.  The loss mask is
the text of assistant turns.

Cases: a null text is empty, a null role is the empty role; equal turns numbers
are ordered by role and text; a null conversation id is a conversation of its own;
records without turns give none; an empty table gives an empty result; columns
that a mapping doesn't name are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import lean, table, written

LOSS_ROLE = "assistant"
OPEN, CLOSE = "<s>[", "</s>"
ESCAPES = {"\\": "\\b", "<": "\\l", ">": "\\g", "[": "\\o", "]": "\\c"}    # the backslash first
TYPES = "STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\\([0-9, ]*\\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: path of a list of turns, with ``role`` and ``text`` inside a turn;
    without it ``parts`` names (role, path) of each turn in order, where several
    paths are joined by a blank line; or the record itself is one turn and
    ``turn`` is the path of its number.  ``roles`` renames roles.  ``optional``
    paths may be absent.
    """
    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    turn: str | None = None
    conversation: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[str]:
        """Of the layout with any of its optional paths."""
        out = []
        for k in range(len(self.optional) + 1):
            for some in itertools.combinations(self.optional, k):
                out.append(_hashed(_shape((*self.paths, *some))))
        return out


SHAREGPT_ROLES = (("human", "user"), ("gpt", "assistant"), ("bing", "assistant"))
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), role="role", text="text",
            turn="turn", conversation="conv_id"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("id",),
            turns="messages", role="role", text="content", conversation="id"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("id", "system"),
            turns="conversations", role="from", text="value", conversation="id",
            parts=(("system", ("system",)),), roles=SHAREGPT_ROLES),
    Mapping("instruction", ("instruction", "output"), ("id", "input", "system"), conversation="id",
            parts=(("system", ("system",)), ("user", ("instruction", "input")),
                   ("assistant", ("output",)))),
    Mapping("prompt", ("prompt", "completion"), ("id",), conversation="id",
            parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("question", "answer"), ("id", "context"), conversation="id",
            parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


# ------------------------------------------------------------ fingerprints
def _shape(paths) -> str:
    """The shape that ``schema_of_variant`` has for these paths, without types."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})

    def text(node: dict) -> str:
        if not node:
            return "?"
        fields = {}
        for name, below in node.items():
            inner = text(below)
            fields[name.removesuffix("[]")] = f"ARRAY<{inner}>" if name.endswith("[]") else inner
        return "OBJECT<" + ", ".join(f"{n}: {fields[n]}" for n in sorted(fields)) + ">"

    return text(tree)


def _hashed(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def fingerprint(record: Column) -> Column:
    """Of a variant: sha256 of its nested field paths."""
    shape = F.regexp_replace(F.schema_of_variant(record), f"\\b(?:{TYPES})(?=[,>]|$)", "?")
    return F.sha2(shape, 256)


def _has(path: str) -> Column:
    """Whether the record has the path; of a list, whether any of its elements has."""
    top, _, field = path.partition("[].")
    if not field:
        return F.expr(f"try_variant_get(record, '$.{top}', 'variant')").isNotNull()
    return F.coalesce(F.expr(
        f"exists(try_variant_get(record, '$.{top}', 'array<variant>'), "
        f"t -> try_variant_get(t, '$.{field}', 'variant') is not null)"), F.lit(False))


def mapping_of(mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The name of the mapping of the variant ``record``, null for an unknown layout."""
    print_ = fingerprint(F.col("record"))
    whole = F.lit(None).cast("string")
    for m in reversed(mappings):
        whole = F.when(print_.isin(m.fingerprints()), F.lit(m.name)).otherwise(whole)
    # looked up for records with further fields only
    partly = F.lit(None).cast("string")
    for m in sorted(reversed(mappings), key=lambda m: len(m.paths)):
        needed = sorted(m.paths)
        found = F.concat_ws(",", *(F.when(_has(p), F.lit(p)) for p in needed))
        partly = F.when(F.sha2(found, 256) == _hashed(",".join(needed)),
                        F.lit(m.name)).otherwise(partly)
    return F.coalesce(whole, partly)


# ------------------------------------------------------------------- turns
def _get(path: str | None, kind: str = "string", of: str = "record") -> Column:
    if path is None:
        return F.lit(None).cast(kind)
    return F.expr(f"try_variant_get({of}, '$.{path}', '{kind}')")


def _role(role: Column, m: Mapping) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in m.roles:
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _turns(m: Mapping) -> Column:
    """The turns of a record of this layout, numbered."""
    if m.turn:
        return F.array(F.struct(_get(m.turn, "long").alias("turn"),
                                _role(_get(m.role), m).alias("role"),
                                F.coalesce(_get(m.text), F.lit("")).alias("text")))
    parts = [F.array(*(F.struct(
        F.lit(role).alias("role"),
        F.when(F.coalesce(*(_get(p) for p in paths)).isNotNull(),
               F.concat_ws("\n\n", *(F.nullif(_get(p), F.lit("")) for p in paths))).alias("text"))
        for role, paths in m.parts))] if m.parts else []
    lists = [F.filter(p, lambda t: t["text"].isNotNull()) for p in parts]
    if m.turns:
        lists.append(F.expr(
            f"transform(try_variant_get(record, '$.{m.turns}', 'array<variant>'), t -> struct("
            f"try_variant_get(t, '$.{m.role}', 'string') as role, "
            f"coalesce(try_variant_get(t, '$.{m.text}', 'string'), '') as text))"))
    whole = F.concat(*(F.coalesce(x, F.expr("cast(array() as array<struct<role:string,"
                                            "text:string>>)")) for x in lists))
    return F.transform(whole, lambda t, i: F.struct(
        i.cast("long").alias("turn"), _role(t["role"], m).alias("role"), t["text"].alias("text")))


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conversation, turn, role, text) of records (record_id, record variant)."""
    known = records.select("record_id", "record", mapping_of(mappings).alias("layout"))
    conversation = turns = F.lit(None)
    for m in mappings:
        own = F.col("layout") == m.name
        conversation = F.when(own, _get(m.conversation)).otherwise(conversation)
        turns = F.when(own, _turns(m)).otherwise(turns)
    return (known.select(
        F.coalesce(conversation, F.col("record_id").cast("string")).alias("conversation"),
        F.explode(turns).alias("t")).select("conversation", "t.turn", "t.role", "t.text"))


def unmapped(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records of unknown layouts, with their fingerprints."""
    return (records.withColumn("fingerprint", fingerprint(F.col("record")))
            .where(mapping_of(mappings).isNull()))


# ------------------------------------------------------------ marked text
def _escaped(text: Column) -> Column:
    for plain, written_as in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(written_as))
    return text


def _unescaped(text: Column) -> Column:
    for plain, written_as in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(written_as), F.lit(plain))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """Turns with their marked text, one row each, in ``formatted``."""
    return turns.select("conversation", "turn", F.concat(
        F.lit(OPEN), _escaped(F.col("role")), F.lit("]"), _escaped(F.col("text")),
        F.lit(CLOSE)).alias("formatted"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns that were marked; ``loss``: whether the text is under the loss mask."""
    inside = F.substring("formatted", len(OPEN) + 1, 1 << 30)
    first = F.substring_index(inside, "]", 1)
    size = F.length("formatted") - F.length(first) - len(OPEN) - 1 - len(CLOSE)
    role = _unescaped(first)
    return formatted.select(
        "conversation", "turn", role.alias("role"),
        _unescaped(F.substring(inside, F.length(first) + 2, size)).alias("text"),
        (role == LOSS_ROLE).alias("loss"), F.length("formatted").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation.  Turns are dealt by conversation and sorted; a
    task streams them, so a conversation of any length takes no more memory."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def row() -> pa.RecordBatch:
            key, n, all_, chars, loss, formatted = now
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (key, n, all_.hexdigest(), chars, loss.hexdigest(),
                                         formatted)],
                names=["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                       "formatted_chars"])

        rows: list[pa.RecordBatch] = []
        for b in batches:
            for key, role, text, loss, chars in zip(*(c.to_pylist() for c in b.columns),
                                                    strict=True):
                if not now or key != now[0]:
                    if now:
                        rows.append(row())
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[5] += chars
                if loss:
                    now[3] += len(text)
                    now[4].update(text.encode())
            yield from rows
            rows.clear()
        if now:
            yield row()

    sorted_turns = (read.repartition("conversation")
                    .sortWithinPartitions("conversation", "turn", "role", "text")
                    .select("conversation", "role", "text", "loss", "chars"))
    return sorted_turns.mapInArrow(
        run, "conversation string, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long")


def query(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"               # fixed by the contract
    extra = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)],
        "conv_id long, turn long, role string, text string")
    records = rows.unionByName(extra).select(
        F.lit("").alias("record_id"),
        F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    formatted = written(format_turns(canonical_turns(records)), "formatted-turns")
    return (digests(read_turns(formatted))
            .select(F.expr("try_cast(nullif(conversation, '') as bigint)").alias("conv_id"),
                    "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL
  SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                  FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(9 + length(role) + length(regexp_replace(role, '[^\\<>\[\]]', '', 'g'))
       + length(text) + length(regexp_replace(text, '[^\\<>\[\]]', '', 'g'))) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""
