"""The words of a batch of texts, distinct ones once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(word: str) -> str:
    """The letters of a lower-cased word ('' if it has none)."""
    return word if word.isalpha() else NOT_LETTERS.sub("", word)


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct lower-cased words, codes, ends): text i has the words
    codes[ends[i - 1]:ends[i]].  Words lie between ASCII blanks ('' can be one);
    null is empty."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), (ends - ends[0])[1:]
