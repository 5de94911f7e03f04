"""Byte-pair encoding in linear time by backtracking, and decoding by an offset table.

All merges of a piece of text are found without merging: an Aho-Corasick automaton
gives every vocabulary match in one pass; from left to right the longest match that
is compatible with the token before it is taken, and a dead end is undone once. Two
tokens are compatible if no merge would have crossed their boundary earlier than the
merges that made them; answers are kept in a pair table. A sequence of which all
neighbours are compatible is the one that merging gives.

Words are encoded once per part of a task (and remembered); texts are put together
from them by index. The tokenizer file is read on the driver and broadcast: its size
is that of a vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from aisle.llm.batches import Words, chunks

WORD_CACHE, PIECE_CACHE, PAIR_CACHE = 250_000, 400_000, 1_000_000
"""Remembered at most, per worker process."""
CHUNK = 4 << 20


class Encoder:
    """A word-end BPE tokenizer file: NFC, lower case, split into words, byte letters."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = name
        raw = [n.encode() for n in names]
        self.bytes = b"".join(raw)
        self.offsets = np.append(0, np.cumsum([len(n) for n in raw])).tolist()
        # how each token is made: rank of its merge, and its two parts
        self.rank, self.parts, self.merged = [-1] * size, [(i, i) for i in range(size)], {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made, a, b = self.vocab[left + right], self.vocab[left], self.vocab[right]
            self.merged.setdefault((a, b), rank)
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = rank, (a, b)
        self.end = ""  # stands for the word end, one letter for the automaton
        self.automaton = ahocorasick.Automaton()
        keys = {}
        for name, i in self.vocab.items():
            ends = bool(self.suffix) and name.endswith(self.suffix)
            keys[name[: -len(self.suffix)] + self.end if ends else name] = i
        self.length, self.shorter = [0] * size, [-1] * size
        for key, i in keys.items():
            self.automaton.add_word(key, (len(key) - 1, i))
            self.length[i] = len(key)
            for cut in range(len(key) - 1, 0, -1):  # the longest token that this one begins with
                if (prefix := keys.get(key[:cut])) is not None:
                    self.shorter[i] = prefix
                    break
        self.automaton.make_automaton()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letter = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.words: dict[int, tuple[str, str, int]] = {}
        self.words_folded = True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when merges run on their joined text."""
        known = self.compatible_pairs.get((a, b))
        if known is None:
            if len(self.compatible_pairs) > PAIR_CACHE:
                self.compatible_pairs.clear()
            known = self.compatible_pairs[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        before = len(self.merged)  # only merges of a lower rank could have come first
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.parts[a][1]
            else:  # of equal merges the left one comes first
                before, b = self.rank[b] + 1, self.parts[b][0]

    def piece(self, text: str) -> list[int]:
        """Tokens of one piece in byte letters."""
        if self.suffix:
            text += self.end
        n = len(text)
        longest = [-1] * n
        for end, (back, token) in self.automaton.iter(text):
            longest[end - back] = token  # matches come by their end, so the longest is the last
        open_, taken, place = [True] * (n + 1), [], 0
        token, last = longest[0], -1
        length, shorter, pairs = self.length, self.shorter, self.compatible_pairs
        while place < n:
            while token >= 0:
                end = place + length[token]
                if open_[end] and (last < 0 or (pairs[last, token] if (last, token) in pairs else self.compatible(last, token))):
                    taken.append(token)
                    place, last = end, token
                    token = longest[place] if place < n else -1
                    break
                token = shorter[token]
            else:
                if not taken:
                    raise ValueError("the vocabulary lacks a byte letter")
                open_[place] = False
                undone = taken.pop()
                place -= length[undone]
                token, last = shorter[undone], taken[-1] if taken else -1
        return taken

    def word(self, text: str) -> list[int]:
        """Tokens of a text without white space."""
        ids: list[int] = []
        if text.isascii() and "<" not in text:  # already composed, and no special token
            for found in self.pieces.findall(text.lower()):
                ids += self._known(found)
            return ids
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                # letter by letter: a final sigma is not told from others
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for found in self.pieces.findall(part):
                    ids += self._known(found)
        return ids

    def _known(self, text: str) -> list[int]:
        """Tokens of one piece of normalised text."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) > PIECE_CACHE:
                self.known.clear()
            found = self.known[text] = self.piece(
                text if text.isascii() and text.isalnum() else "".join(map(self.letter.__getitem__, text.encode())))
        return found

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts, joined by blanks as a tokenizer file without decoder has it."""
        at, data = self.offsets, self.bytes
        return b" ".join([data[at[i] : at[i + 1]] for i in ids]).decode()


@functools.lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def encode(documents: DataFrame, tokenizer: str, keep: list[str] | tuple = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Token ids of every text, by the word-end BPE file at ``tokenizer`` (a path on the driver).

    Returns ``keep``, n_tokens, ids_sha256 (of the decimal ids joined by blanks) and
    decoded_sha256; with ``with_text`` also the ids as text and the decoded text. No special tokens
    are added; their strings in a text are the special tokens. A null text counts as
    empty: 0 tokens, hashes of the empty string. Order, keys and repeats of rows do not
    matter; an empty table gives none.
    """
    with open(tokenizer, encoding="utf-8") as opened:
        held = documents.sparkSession.sparkContext.broadcast(opened.read())
    keep = list(keep)

    def run(batches):
        encoder = _encoder(held.value)
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text"), CHUNK):
                words = Words(data, offsets)
                # case makes no difference, except in the names of special tokens
                folded = b"<" not in data.tobytes()
                hashes, first, place = np.unique(words.hashes(lower=folded), return_index=True, return_inverse=True)
                remembered = encoder.words
                if folded != encoder.words_folded or len(remembered) > WORD_CACHE:
                    remembered.clear()
                    encoder.words_folded = folded
                ids, decoded, count = np.empty(len(hashes), object), np.empty(len(hashes), object), np.zeros(len(hashes), np.int64)
                for k, (key, a, b) in enumerate(zip(hashes.tolist(), words.start[first].tolist(), words.end[first].tolist(), strict=True)):
                    known = remembered.get(key)
                    if known is None:
                        found = encoder.word(data[a:b].tobytes().decode())
                        known = remembered[key] = (" ".join(map(str, found)), encoder.decode(found), len(found))
                    ids[k], decoded[k], count[k] = known
                tokens = count[place]
                if (silent := tokens == 0).any():  # words of Unicode white space only
                    place, doc = place[~silent], words.doc[~silent]
                    bounds = np.searchsorted(doc, np.arange(len(offsets)))
                else:
                    bounds = words.first
                total = np.append(0, np.cumsum(count[place]))
                out: list[list] = [[], [], [], []]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    texts = " ".join(ids[place[a:b]].tolist()), " ".join(decoded[place[a:b]].tolist())
                    for k, text in enumerate(texts):
                        out[k].append(hashlib.sha256(text.encode()).hexdigest())
                        if with_text:
                            out[2 + k].append(text)
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(total[bounds[1:]] - total[bounds[:-1]])]
                    + [pa.array(c, pa.string()) for c in out[: 4 if with_text else 2]],
                    [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(keep) + (5 if with_text else 3)])

    types = dict(documents.dtypes)
    extra = ", ids string, decoded string" if with_text else ""
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + extra
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
