"""Packing of tokenised documents into fixed-length sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The program
asks for the fewest sequences whose configurations cover the histogram of lengths.
It is solved by multiplicative weights: lengths that lag behind in coverage weigh
more, and a knapsack dynamic program finds the configuration of the greatest weight.
The solution is rounded; what it leaves is packed best fit, longest first, in
groups of equal sequences. The histogram has as many numbers as a sequence has
tokens, so this part runs on the driver whatever the corpus. Each piece then finds
its place from its rank among the pieces of its length, which Spark counts in buckets.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.batches import SPACE, chunks, span_hashes
from aisle.llm.shared import written

LENGTH = 1024
END = 2
ROUNDS, URGENCY, SHARE = 400, 30.0, 1.0
SCALES = (2.0, 1.0, 0.5)
"""Multiples of the fractional solution that are rounded; best fit packs the rest."""
BUCKETS = 64
CHUNK = 3 << 20
_WHITE = {bytes.fromhex(h) for h in "c285 c2a0 e19a80 e280a8 e280a9 e280af e2819f e38080".split()} | {bytes([0xE2, 0x80, k]) for k in range(0x80, 0x8B)}


SEPARATOR = "\U0010fffe\U0010ffff"
"""Not a text: put between stretches that are encoded in one call."""


class Tokenizer:
    """The byte-level BPE of a tokenizer file.

    If the file's merges are in the order of its ids, as byte-level files have them, tokens
    are ranks and many stretches are encoded in one call; else each is encoded alone.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        base = len(vocab) - len(pairs)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranks = None
        if plain and base == 256 and all(vocab[a + b] == base + k for k, (a, b) in enumerate(pairs)):
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.separator = max([*vocab.values(), *special.values()]) + 1
            self.ranks = tiktoken.Encoding(
                "file", pat_str=public_tokenizers.PATTERN, special_tokens=special | {SEPARATOR: self.separator},
                mergeable_ranks={bytes(byte[c] for c in token): i for token, i in vocab.items()})
        else:
            self.plain = tokenizers.Tokenizer.from_str(file)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        joined = SEPARATOR.join(texts)
        if self.ranks is None or joined.count(SEPARATOR) != len(texts) - 1:
            one = self.plain.encode if self.ranks is None else lambda t, **_: self.ranks.encode(t, allowed_special=self.ranks.special_tokens_set - {SEPARATOR}, disallowed_special=())
            lists = [getattr(x := one(t, add_special_tokens=False), "ids", x) for t in texts]
            return np.array([i for ids in lists for i in ids], np.uint32), np.array(list(map(len, lists)), np.int64)
        ids = np.array(self.ranks.encode(joined, allowed_special="all", disallowed_special=()), np.uint32)
        apart = ids == self.separator
        ends = np.append(np.flatnonzero(apart), len(ids))
        return ids[~apart], np.diff(np.append(-1, ends)) - 1


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that the tokenizer splits anyway: white space, then a word.

    A text is cut where a blank follows a character that is not white space; there
    every byte-level pre-tokenizer has a boundary.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1  # a blank after a character beyond ASCII
    for k in at.tolist():
        if data[max(k - 3, 0) : k].tobytes() in _WHITE or data[max(k - 2, 0) : k].tobytes() in _WHITE:
            cut[k] = False
    cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n)


def token_ids(file: str, data: np.ndarray, offsets: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the texts of a chunk; each text ends with the id ``end``."""
    start, stop = _segments(data, offsets)
    hashes, first, place = np.unique(span_hashes(data, start, stop), return_index=True, return_inverse=True)
    texts = [data[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
    flat, size = _tokenizer(file).encode(texts) if texts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    begin = np.cumsum(size) - size
    # the ids of all segments in order, with room for the end of each text
    counts = size[place]
    doc = np.searchsorted(offsets[1:], start, "right")
    total = np.cumsum(counts) - counts + doc
    ids = np.full(int(counts.sum()) + len(offsets) - 1, end, np.uint32)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    ids[np.repeat(total, counts) + within] = flat[np.repeat(begin[place], counts) + within]
    bounds = np.append(0, np.cumsum(np.bincount(doc, weights=counts, minlength=len(offsets) - 1).astype(np.int64) + 1))
    return ids, bounds


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, cut only if longer than ``length``."""
    with open(tokenizer, encoding="utf-8") as opened:
        held = documents.sparkSession.sparkContext.broadcast(opened.read())

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text"), CHUNK):
                ids, bounds = token_ids(held.value, data, offsets, end)
                n = np.diff(bounds)
                many = -(-n // length)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                head = n - (many - 1) * length  # the first piece takes what whole pieces leave
                start = np.where(piece > 0, head[doc] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, head[doc])
                at = bounds[doc] + start
                crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(row + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a : a + k].astype(np.int32) for a, k in zip(at.tolist(), size.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def knapsack(value: np.ndarray, length: int) -> list[int]:
    """Lengths (with repeats) of the greatest total value that fit into ``length``; value[l - 1] is that of l."""
    best, choice = np.zeros(length + 1), np.zeros(length + 1, np.int64)
    for room in range(1, length + 1):
        total = value[:room] + best[room - 1 :: -1][:room]  # length l leaves room - l
        k = int(np.argmax(total))
        if total[k] > best[room - 1]:
            best[room], choice[room] = total[k], k + 1
        else:
            best[room] = best[room - 1]
    found, room = [], length
    while room > 0:
        if choice[room]:
            found.append(int(choice[room]))
            room -= int(choice[room])
        else:
            room -= 1
    return sorted(found, reverse=True)


def fractional(want: np.ndarray, length: int, rounds: int = ROUNDS, urgency: float = URGENCY, share: float = SHARE) -> dict[tuple[int, ...], float]:
    """Multiplicative-weights solution of the covering program: configurations and amounts.

    Every round adds an amount of the configuration of the greatest weight: at most
    ``share`` of what any of its lengths needs. A length's weight falls exponentially
    with its coverage so far, ``urgency`` being the exponent.
    """
    used = np.flatnonzero(want)
    covered, amount = np.zeros(length + 1), defaultdict(float)
    value = np.full(length, -1.0)
    for _ in range(rounds if len(used) else 0):
        value[used - 1] = used / length * np.exp(urgency * (covered[used].mean() - covered[used]))
        config = tuple(knapsack(value, length))
        kinds, times = np.unique(config, return_counts=True)
        step = float(np.min(want[kinds] / times)) * share
        amount[config] += step
        covered[kinds] += step * times / want[kinds]
    scale = max(float(covered[used].max(initial=0.0)), 1e-9)
    return {config: x / scale for config, x in amount.items()}


def rounded(amounts: list[tuple[tuple[int, ...], float]], scale: float, want: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, ...], int]]:
    """(pieces left, whole sequences) of ``scale`` times the amounts; what rounding cuts off is carried to the next."""
    left, plan, carry = want.copy(), {}, 0.0
    for config, x in amounts:
        carry += x * scale
        kinds, times = np.unique(config, return_counts=True)
        count = int(min(carry, np.min(left[kinds] // times)))
        carry -= int(carry)
        if count:
            plan[config] = count
            left[kinds] -= count * times
    return left, plan


def best_fit(left: np.ndarray, plan: dict[tuple[int, ...], int], length: int) -> dict[tuple[int, ...], int]:
    """``plan`` and the pieces of ``left``, best fit, longest first, in groups of equal sequences."""
    plan = defaultdict(int, plan)
    open_: dict[int, list[list]] = defaultdict(list)
    for size in range(length, 0, -1):
        need, room = int(left[size]), size
        while need and room <= length:
            groups = open_[room]
            while need and groups:
                config, count = groups.pop()
                take = min(need, count)
                if take < count:
                    groups.append([config, count - take])
                open_[room - size].append([(*config, size), take])
                need -= take
                if room >= 2 * size:  # a sequence that took one may be the best fit for the next too
                    room = size
                    groups = open_[room]
            room += 1
        while need:
            each = min(need, length // size)
            open_[length - each * size].append([(size,) * each, need // each])
            need %= each
    for groups in open_.values():
        for config, count in groups:
            plan[config] += count
    return plan


def solve(histogram: np.ndarray, length: int = LENGTH, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences have each, covering ``histogram`` exactly.

    ``histogram[l]`` pieces have length l. The fractional solution is rounded at
    several scales, and what remains is packed best fit; the fewest sequences win.
    """
    want = histogram.astype(np.int64).copy()
    whole = int(want[length])
    want[length] = 0
    amounts = sorted(fractional(want.astype(float), length, rounds).items(), key=lambda item: (-item[1], item[0]))
    found = None
    for scale in SCALES:
        plan = best_fit(*rounded(amounts, scale, want), length)
        if found is None or sum(plan.values()) < sum(found.values()):
            found = plan
    if whole:
        found[(length,)] += whole
    return sorted(found.items())


def _places(plan: list[tuple[tuple[int, ...], int]], length: int) -> tuple[np.ndarray, ...]:
    """For ranks among the pieces of a length: (length, first rank, first sequence, offset), sorted."""
    rank, rows, sequence = np.zeros(length + 1, np.int64), [], 0
    for config, count in plan:
        offset = 0
        for size in config:
            rows.append((size, int(rank[size]), sequence, offset))
            rank[size] += count
            offset += size
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]). A null
    text counts as empty and is one piece: the id ``end``. Rows that repeat a doc_id
    are packed as documents of their own; a null doc_id is kept. An empty table gives
    none. The offsets of a sequence are gapless from 0; ``sequence_id`` is from 0 too.
    """
    spark = documents.sparkSession
    cut = written(pieces(documents, tokenizer, length, end, with_ids), "pieces").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    counts = written(cut.groupBy("length", "bucket").count(), "lengths")  # at most length * BUCKETS rows
    histogram = np.zeros(length + 1, np.int64)
    for size, n in counts.groupBy("length").agg(F.sum("count")).collect():  # one row per length
        histogram[size] = n
    held = spark.sparkContext.broadcast(_places(solve(histogram, length), length))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order)).join(bases, ["length", "bucket"]).withColumn(
        "rank", F.col("base") + F.col("rank") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches):
        sizes, ranks, sequences, offsets = held.value
        key = sizes << 44 | ranks
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(key, size << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])],
                [*columns, "sequence_id", "offset"])

    types = dict(cut.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)
