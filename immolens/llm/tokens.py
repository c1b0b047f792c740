"""Token ids of whole texts with a public tokenizer, distinct words encoded once.

``word_bpe_49k`` lower-cases, drops white space and never merges across it, so
a text's ids are its words' ids in a row.  A batch's distinct words are found by
Arrow; plain ones are cut into letters and the marks behind them, looked up in a
bounded table of the worker, and new ones go through the library, joined by
spaces (a word's last id is one that ends a word).  Anything else, such as
digits, apostrophes, other scripts or special tokens, goes through the library
as it stands.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from immolens.llm.common import lean, worker_cache

KEPT_WORDS = 400_000            # of a worker's table; later words are looked up each time
SLICE_BYTES = 16 << 20          # text encoded together, unless one text is longer
GATHERED = 1 << 17              # words put together at a time
MARKS = ".,!?;:*%$&#"           # neither letters nor digits nor apostrophes
LATIN = "ɐ"                # below it, letters are single code points in any normal form
WORD_END = "</w>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.library = Tokenizer.from_file(path)
        # the same model for lower-case letters between spaces: nothing to normalise
        own["normalizer"] = None
        own["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False,
                                          "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(own))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.kept: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of any words, as the library takes them."""
        got = [np.array(e.ids, "<u4") for e in
               self.library.encode_batch_fast(words, add_special_tokens=False)]
        return (np.concatenate(got) if got else np.empty(0, "<u4"),
                np.fromiter(map(len, got), np.int64, len(got)))

    def _plain(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct lower-cased Latin words: known ones come from the
        worker's table, the others go through the library in a row."""
        kept = self.kept
        known = [kept.get(c, b"") for c in cores]
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        new = np.flatnonzero(length == 0)
        ids = np.frombuffer(b"".join(known), "<u4")
        start = np.cumsum(length) - length
        if len(new):
            words = [cores[i] for i in new.tolist()]
            more = np.array(self.plain.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[more]) + 1
            if len(cut) != len(words):
                raise ValueError("the tokenizer doesn't mark the ends of words")
            start[new] = np.concatenate(([0], cut[:-1])) + len(ids)
            length[new] = np.diff(cut, prepend=0)
            ids = np.concatenate((ids, more))
            if len(kept) + len(words) <= KEPT_WORDS:    # frequent words come early
                data, at = more.tobytes(), 0
                for word, end in zip(words, (4 * cut).tolist(), strict=True):
                    kept[word] = data[at:end]
                    at = end
        return ids, np.stack((start, length))

    def _table(self, words: pa.Array, end_id: int):
        """(ids, starts, lengths, first, second): word i is the pieces first[i] and,
        unless that is 0, second[i]; piece 0 is the end id."""
        low = pc.utf8_lower(words)
        trimmed = pc.utf8_rtrim(low, characters=MARKS)
        core = trimmed.dictionary_encode()
        cores, first = core.dictionary.to_pylist(), core.indices.to_numpy()
        plain = np.fromiter((c.isalpha() and (c.isascii() or max(c) < LATIN) for c in cores),
                            bool, len(cores))
        # one capital's lower case is two code points for the library
        odd = pc.match_substring(words, "\u0130").to_numpy(zero_copy_only=False)
        fits = plain[first] & ~odd
        n_marks = pc.subtract(pc.utf8_length(low), pc.utf8_length(trimmed)).to_numpy()
        marked = np.flatnonzero(fits & (n_marks > 0))
        marks = pa.array([w[-n:] for w, n in zip(low.take(pa.array(marked)).to_pylist(),
                                                 n_marks[marked].tolist(), strict=True)],
                         pa.string()).dictionary_encode()
        others = np.flatnonzero(~fits)
        which = np.flatnonzero(plain)
        ids, (start, length) = self._plain([cores[i] for i in which.tolist()])
        more, sizes = self._encoded([*marks.dictionary.to_pylist(),
                                     *words.take(pa.array(others)).to_pylist()])
        ids = np.concatenate((np.array([end_id], "<u4"), ids, more))
        n = len(ids) - len(more)
        starts = np.concatenate(([0], start + 1, n + np.cumsum(sizes) - sizes))
        lengths = np.concatenate(([1], length, sizes))
        piece = np.zeros(len(cores), np.int64)
        piece[which] = 1 + np.arange(len(which))
        one, two = piece[first], np.zeros(len(words), np.int64)
        two[marked] = 1 + len(which) + marks.indices.to_numpy()
        one[others] = 1 + len(which) + len(marks.dictionary) + np.arange(len(others))
        return ids, starts, lengths, one, two

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): all ids in a row, each text's followed by ``end_id``;
        text i has ids[offsets[i]:offsets[i + 1]].  Null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = (ends - ends[0])[1:]
        coded = lists.flatten().dictionary_encode()
        flat, start, length, one, two = self._table(coded.dictionary, end_id)
        # the end id is a word of its own, behind all others of the table
        one, two = np.append(one, 0), np.append(two, 0)
        size = length[one] + np.where(two > 0, length[two], 0)
        at = np.insert(coded.indices.to_numpy(), ends, len(one) - 1)
        done = np.cumsum(size[at])
        ids = np.empty(done[-1] if len(done) else 0, "<u4")
        for begin in range(0, len(at), GATHERED):
            own = at[begin:begin + GATHERED]
            both = np.stack((one[own], two[own]), axis=1)
            pieces = both[np.stack((np.ones(len(own), bool), both[:, 1] > 0), axis=1)]
            n, before = length[pieces], int(done[begin - 1]) if begin else 0
            upto = np.cumsum(n)
            ids[before:before + upto[-1]] = flat[np.repeat(start[pieces] - upto + n, n)
                                                 + np.arange(upto[-1])]
        return ids, np.concatenate(([0], done[ends + np.arange(len(ends))]))


def encoder(path: str) -> WordEncoder:
    """This worker's encoder."""
    return worker_cache(f"tokenizer {path}", lambda: WordEncoder(path))


def encoding(path: str):
    """``lean`` for tasks that use this worker's encoder."""
    return lambda run: lean(run, keep=(f"tokenizer {path}",))


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """(begin, end) of rows that are handled together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False),
                      dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + size, "right")))
        yield begin, end
        begin = end


def id_type(path: str) -> str:
    """The narrowest type that holds every id of the tokenizer."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    top = max([*own["model"]["vocab"].values(), *(t["id"] for t in own["added_tokens"])])
    return "<u2" if top < 1 << 16 else "<u4"
