"""Token ids of texts by a byte-level BPE vocabulary.

The ids are those of ``tokenizers`` with the vocabulary file and
``add_special_tokens=False``.  Where the same vocabulary is given as ranks,
texts without special tokens go through ``tiktoken``, several times as fast;
the tests compare the two.

Many texts at once are cut into words, and every distinct word among them is
encoded once.  A cut before a space falls between two pieces of ``SPLIT`` unless
white space precedes the space and white space or the end follows it: a text
with such a space, like one with a special token, is encoded as it is."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: how the vocabulary's texts are split before the merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# The same for texts in which no white space follows white space; without looking ahead it matches faster.
SINGLE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # \s, for Arrow
WHOLE = rf"{SPACE} (?:{SPACE}|\z)"  # texts that are not cut before their spaces
TWICE = re.compile(r"\s\s")  # where SINGLE and SPLIT may differ
APART = rf"\A\z|\A{SPACE}|{SPACE}{SPACE}|{SPACE}\z"  # words that are not encoded side by side
TAKEN = 256  # texts whose ids are put together at once
END = 2  # id that ends a document
NEVER = "\U0010fffe\U0010ffff"  # a special token that no call allows, so it is plain text wherever it occurs


@dataclass(frozen=True)
class Vocabulary:
    """Files that every machine has under the same path, and the special tokens."""

    path: str
    ranks: str | None
    special: tuple[str, ...]


def vocabulary(path: str | None = None, ranks: str | None = None) -> Vocabulary:
    """The vocabulary of a file; by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, encoding="utf-8") as f:
        special = tuple(t["content"] for t in json.load(f).get("added_tokens", []))
    return Vocabulary(path, ranks, special)


def byte_ranks(path: str, split: str = SPLIT):
    """The ``tiktoken`` encoding of a rank file, kept by the process that loads
    it: a Python worker runs many tasks, and loading costs as much as a megabyte
    of text.

    ``tiktoken`` looks for the special tokens first; without any, its pattern is
    empty and matches before every byte, a third of all the time."""
    import tiktoken
    from tiktoken import registry

    name = f"ranks {path} {split}"
    if name not in registry.ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        special = {NEVER: max(ranks.values()) + 1}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=split, mergeable_ranks=ranks, special_tokens=special)
    return registry.ENCODINGS[name]


class Encoder:
    """Encodes on one machine; what it does not need it does not load."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self._whole = self._fast = self._single = self._opens = None

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.words.ranks and not any(s in text for s in self.words.special):
            if self._fast is None:
                self._fast = byte_ranks(self.words.ranks)
            return self._fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.words.path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of every text."""
        entries, index, begin = self._by_word(texts)
        return np.add.reduceat(np.diff(entries.offsets)[index], begin[:-1]) if len(texts) else np.zeros(0, np.int64)

    def lists(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text."""
        entries, index, begin = self._by_word(texts)
        for first in range(0, len(texts), TAKEN):
            at = begin[first : first + TAKEN + 1] - begin[first]
            taken = entries.take(pa.array(index[begin[first] : begin[first] + at[-1]]))
            ids, ends = taken.flatten().to_numpy(), taken.offsets.to_numpy()[at]
            yield from (ids[a:b] for a, b in zip(ends, ends[1:]))

    def _by_word(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Lists of ids, the numbers of those that make up the texts one after
        another, and where each text begins among them.

        A text's first list is its own: the ids of its first word, which no
        space precedes, or of all the text where it is not cut."""
        texts = texts.fill_null("")
        whole = pa.array(np.full(len(texts), not self.words.ranks))
        if self.words.ranks:
            whole = pc.match_substring_regex(texts, WHOLE)
            for special in self.words.special:
                whole = pc.or_(whole, pc.match_substring(texts, special))
        cut = pc.split_pattern(pc.if_else(whole, "", texts) if whole.true_count else texts, " ")
        begin, cut = cut.offsets.to_numpy(), cut.flatten()
        first = pc.if_else(whole, texts, cut.take(pa.array(begin[:-1]))).to_pylist()
        later = np.ones(len(cut), bool)
        later[begin[:-1]] = False
        cut = cut.filter(pa.array(later)).dictionary_encode()
        words, found = cut.dictionary, cut.indices.to_numpy()
        del cut  # nothing as large as the texts is held while words are encoded
        ids, sizes, place = self._after_space(words)
        index = np.empty(len(later), np.int32)
        index[later] = place[found]
        index[~later] = len(words) + np.arange(len(first))
        own = [self.ids(text) if as_it_is else self._word(text) for text, as_it_is in zip(first, whole.to_pylist())]
        offsets = np.cumsum(np.concatenate([[0], sizes, [len(o) for o in own]])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids, *own]))), index, begin

    def _word(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens."""
        return self.ids(text) if TWICE.search(text) else self._side_by_side(text)

    def _side_by_side(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens and without white space after white space."""
        if self._single is None:
            self._single = byte_ranks(self.words.ranks, SINGLE)
        return self._single.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def _after_space(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The ids of words that each follow a space, how many each has, and the
        place of each word among them."""
        apart = pc.match_substring_regex(words, APART).to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int32)
        place[np.argsort(apart, kind="stable")] = np.arange(len(words))
        alone = [self._word(" " + word) for word in words.filter(pa.array(apart)).to_pylist()]
        sizes = np.array([len(a) for a in alone], np.int64)
        side = words.filter(pa.array(~apart))
        if not len(side):
            return alone, sizes, place
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(side)], pa.int32()), side), " ")[0].as_py()
        ids = self._side_by_side(" " + joined)
        if self._opens is None:
            opening = [self._single.encode_single_token(t) for t in self._single.token_byte_values() if t.startswith(b" ")]
            self._opens = np.zeros(self._single.max_token_value + 1, bool)
            self._opens[opening] = True
        # No other id of a word begins with a space.
        start = np.flatnonzero(self._opens[ids])
        return [ids, *alone], np.concatenate([np.diff(start, append=len(ids)), sizes]), place
