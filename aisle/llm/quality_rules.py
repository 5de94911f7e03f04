"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

Each rule looks at measures of the whole text. On a sample of texts every rule's
cost (seconds) and selectivity (share rejected) are measured; the rules then run in
descending order of rejection per second, each one only on the texts that all before
it let pass. The order changes the cost and the name of the rule that rejects, never
the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.batches import SPACE, Words, chunks, code_points, counts_between

REPEAT_WINDOW = 8
SAMPLE_SHARE, SAMPLE_ROWS = 0.01, 2_000
"""Rows that the order of the rules is estimated on."""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"[#*$%&|<>]", np.uint8)[1:-1]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _repeats(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to an earlier one of its text, is equal to any other of its text)."""
    order = np.lexsort((hashes, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again, many = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    again[order[1:][same]] = True  # lexsort is stable: the first of equals comes first
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return again, many


class Texts:
    """Measures of the texts of one chunk, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._known = data, offsets, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, "_" + name)()
        return self._known[name]

    def subset(self, rows: np.ndarray) -> Texts:
        """The texts where ``rows`` is true, with what is already measured."""
        inside = np.repeat(rows, np.diff(self.offsets))
        part = Texts(self.data[inside], np.append(0, np.cumsum(np.diff(self.offsets)[rows])))
        part._known = {k: v[rows] for k, v in self._known.items() if isinstance(v, np.ndarray)}
        return part

    def _words(self):
        return Words(self.data, self.offsets)

    def _n_words(self):
        return np.diff(self["words"].first)

    def _word_chars(self):
        return counts_between(code_points(self.data) & ~SPACE[self.data], self.offsets)

    def _n_symbols(self):
        return counts_between(_SYMBOL[self.data], self.offsets)

    def _n_capitals(self):
        return counts_between(_UPPER[self.data], self.offsets)

    def _n_small(self):
        return counts_between(_LOWER[self.data], self.offsets)

    def _lines(self):
        lines = Words(self.data, self.offsets, keep=self.data != 10)
        total = np.append(0, np.cumsum(~SPACE[self.data]))
        worded = total[lines.end] > total[lines.start]
        return lines.doc[worded], lines.hashes()[worded]

    def _n_lines(self):
        return np.bincount(self["lines"][0], minlength=len(self.offsets) - 1)

    def _n_dup_lines(self):
        doc, hashes = self["lines"]
        return np.bincount(doc[_repeats(doc, hashes)[0]], minlength=len(self.offsets) - 1)

    def _n_repeat_words(self):
        words = self["words"]
        at, hashes = words.windows(words.hashes(), REPEAT_WINDOW)
        found = at[_repeats(words.doc[at], hashes)[1]]
        change = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(change, found, 1)
        np.add.at(change, found + REPEAT_WINDOW, -1)
        return counts_between(np.cumsum(change)[:-1] > 0, words.first)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE_RULES = [
    Rule("few_words", lambda t: t["n_words"] < 20),
    Rule("repeated_words", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"]),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", lambda t: 100 * t["n_symbols"] > 40 * t["n_words"]),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 25 * t["n_words"])),
    Rule("repeated_lines", lambda t: (t["n_lines"] >= 4) & (100 * t["n_dup_lines"] > 50 * t["n_lines"])),
    Rule("capitals", lambda t: (t["n_capitals"] > 2 * t["n_small"]) & (t["n_capitals"] > 50)),
]
BASE_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Cost(NamedTuple):
    name: str
    seconds: float
    rejected: int
    rows: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(documents: DataFrame, rules: list[Rule], share: float = SAMPLE_SHARE, rows: int = SAMPLE_ROWS) -> list[Cost]:
    """Cost and selectivity of each rule on a sample, best first; ties by name."""
    def measure(batches):
        spent, found, seen = dict.fromkeys((r.name for r in rules), 0.0), dict.fromkeys((r.name for r in rules), 0), 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                seen += len(offsets) - 1
                for rule in rules:
                    texts = Texts(data, offsets)
                    began = time.perf_counter()
                    found[rule.name] += int(rule.rejects(texts).sum())
                    spent[rule.name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({
            "name": list(spent), "seconds": list(spent.values()), "rejected": list(found.values()), "rows": [seen] * len(spent)})

    sample = documents.select("text").sample(share, seed=1).limit(rows)
    costs = sample.mapInArrow(measure, "name string, seconds double, rejected long, rows long").groupBy("name").agg(
        F.sum("seconds"), F.sum("rejected"), F.sum("rows")).collect()  # one row per rule
    known = {r[0]: Cost(*r) for r in costs}
    return sorted((known.get(r.name, Cost(r.name, 0.0, 0, 0)) for r in rules), key=lambda c: (-c.worth, c.name))


def judge(documents: DataFrame, rules: list[Rule] = RULES, measures: list[str] | tuple = (), keep: list[str] | tuple = ("doc_id",),
          verdict: tuple[str, str] = ("failed_rule", "kept")) -> DataFrame:
    """Verdict of the cascade on every row: columns ``keep``, ``measures``, failed_rule, kept.

    ``verdict`` names the last two; choose other names where ``keep`` has these.

    ``measures`` are returned for all rows, so they are computed before the cascade;
    all else only for the rows that still stand. ``failed_rule`` is the rule that
    rejected, null if kept. A null text counts as empty; an empty text has measures 0
    and is rejected by few_words if that rule is given. Columns of ``keep`` pass
    unchanged, also with null keys and repeated rows; an empty table gives none.
    """
    order = [c.name for c in estimate(documents, rules)]
    ordered = sorted(rules, key=lambda r: order.index(r.name))
    keep, measures = list(keep), list(measures)

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                texts = Texts(data, offsets)
                found = [pa.array(texts[m], pa.int64()) for m in measures]
                standing, failed = np.arange(len(offsets) - 1), np.full(len(offsets) - 1, -1)
                for k, rule in enumerate(ordered):
                    out = np.asarray(rule.rejects(texts), bool)
                    failed[standing[out]] = k
                    if out.any():
                        standing, texts = standing[~out], texts.subset(~out)
                names = pa.array([ordered[k].name if k >= 0 else None for k in failed], pa.string())
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keep] + found + [names, pa.array(failed < 0)], [*keep, *measures, *verdict])

    types = dict(documents.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"{m} long" for m in measures), f"{verdict[0]} string", f"{verdict[1]} boolean"])
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
