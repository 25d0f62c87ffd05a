"""Held-out evaluation items in corpus documents.

The method: texts become word sequences (``textnorm``); each word gets a type - a number, a name or thing
(what varies between items of one build), a unit, or a plain word - and the typed slots are replaced by
placeholders, which gives a template. Windows of ``WINDOW`` template words of the items are the build side
of a hash join with all windows of all documents. A window of the same template is only evidence where
the slots hold the same values in the same order (slot consistency): a re-parameterised exercise meets
many template windows and fails there. What is left gives diagonals (document position minus item
position) along which the words are compared; the item's words matched on any diagonal, single changed words
included, make its coverage, so parts may stand apart. A document carries an item if more than
``COVERAGE`` of the question (without options) or of the worked solution is covered.

Windows without a slot count for the texts of items of which more than ``PLAIN_SHARE`` lies in no window with one; elsewhere
they would say no more than that a document is of the same build. Texts of ``SHORT`` to ``LEAST - 1`` words are
found where all their words stand in a row; still shorter ones, such as an option's letter, are no running text.

What a word's type is follows from all items at once. Items up to ``ITEMS_MOST`` are an index that every task holds, and nothing
of the documents is shuffled. Beyond it windows of items and documents are joined by a shuffle, and each pair that
meets is compared in the same way, with equal results.

Null, empty and wordless texts match nothing; repeated documents each give their rows, repeated items one; items without
an id are left out. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyforge.llm.hashing import WordHashes, mix
from tallyforge.llm.textnorm import words

WINDOW, COVERAGE, LEAST, SHORT = 6, 0.5, 8, 4
PLAIN_SHARE, ITEMS_MOST = 0.25, 20_000
#: A plain word stands in more than this share of the items' texts, and in more than PLAIN_LEAST.
PLAIN_TEXTS, PLAIN_LEAST = 0.02, 2
#: A word is taken as matched if so many of the ``AROUND`` words around it are equal on its diagonal.
AROUND, EQUAL = 5, 4
#: Of the slots in the matched words, so many must hold equal values ...
SLOTS = 0.8
#: ... or of all the item's numbers and names so many; then plain runs of ``AROUND`` equal words within ``DRIFT`` words of where the
#: consistent windows put them count as matched too, which finds the stretches between misspelt names and lost words.
SURE, DRIFT = 0.35, 4

#: Units of measure.
UNITS = frozenset(
    "metre metres meter meters feet foot inch inches gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years"
    " degree degrees percent mile miles kilometre kilometres kilometer kilometers centimetre centimetres dollar dollars euro euros cent cents hundredths tenths thousandths".split()
)
_OPTIONS = re.compile(r"\n\s*\(?A[).]\s")
_CAPITAL = re.compile(r"(?<![.?!:]\s)(?<=\s)[A-Z][a-zà-ɏ]+")
_SLOT_NUMBER, _SLOT_UNIT, _SLOT_NAME = (np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)) for k in (3, 5, 7))


def fields(question: str | None, solution: str | None) -> list[str]:
    """The texts of an item that a document may carry: the question without its options, and the solution."""
    return [_OPTIONS.split(question or "")[0], solution or ""]


def vocabulary(texts: Iterable[str]) -> tuple[int, Counter[str], set[str]]:
    """How many texts have words enough, in how many each word stands, and which words are written as names."""
    n, spread, names = 0, Counter(), set()
    for text in texts:
        found = words(text)
        if len(found) >= LEAST:
            n += 1
            spread.update(set(found))
            names.update(w.lower() for w in _CAPITAL.findall(text))
    return n, spread, names


def plain_words(n: int, spread: Iterable[tuple[str, int]], names: set[str]) -> frozenset[str]:
    """Words that recur throughout the builds; names and the things of an item do not. At most 1 / PLAIN_TEXTS times as many as a text has words."""
    return frozenset(w for w, m in spread if m > max(PLAIN_LEAST, PLAIN_TEXTS * n) and not w[0].isdigit() and w not in names and w not in UNITS)


class Index:
    """Template windows of items, by hash, with the slot values that they hold."""

    def __init__(self, rows: Iterable[Row], plain: frozenset[str]):
        self.plain = plain
        self.fields: list[tuple[int, np.ndarray]] = []
        self.slots: list[np.ndarray] = []
        self.telling: list[np.ndarray] = []
        self.own_runs: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.hashes = WordHashes()
        windows: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for row in rows:
            for text in fields(row["question"], row["solution"]):
                found = words(text)
                if SHORT <= len(found) < LEAST:
                    self.short[len(found)][int(self.runs(self.hashes.of(found), len(found))[0])].append(row["item_id"])
                if len(found) < LEAST:
                    continue
                raw, template, slot = self.encode(found)
                self.fields.append((row["item_id"], raw))
                self.slots.append(slot)
                own_names = {w.lower() for w in _CAPITAL.findall(text)}
                self.telling.append(np.array([w[0].isdigit() or w in own_names for w in found]))
                self.own_runs.append(self.runs(raw))
                keys, values, has = self.windows(raw, template, slot)
                for at in np.flatnonzero(self.counted(has)):
                    windows[int(keys[at])][int(values[at])].append((len(self.fields) - 1, int(at)))
        self.entries = {key: dict(by) for key, by in windows.items()}
        self.short = {n: dict(by) for n, by in self.short.items()}
        self.keys = np.array(sorted(windows), dtype=np.uint64)
        self.values = np.array(sorted({v for by in self.entries.values() for v in by}), dtype=np.uint64)
        self.hashes.clear()

    @staticmethod
    def counted(has: np.ndarray) -> np.ndarray:
        """Which windows of a text are evidence: those with a slot, or all where these leave out too much of the text."""
        reached = np.convolve(has, np.ones(WINDOW), "full") > 0
        return np.ones(len(has), bool) if 1 - reached.mean() > PLAIN_SHARE else has

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, the same with placeholders for slots, and which words are slots."""
        raw = self.hashes.of(found)
        kind = np.fromiter(map(self._kind, found), dtype=np.uint8, count=len(found))
        template = np.where(kind == 0, raw, np.where(kind == 1, _SLOT_NUMBER, np.where(kind == 2, _SLOT_UNIT, _SLOT_NAME)))
        return raw, template, kind > 0

    def _kind(self, word: str) -> int:
        if word in self.plain:
            return 0
        return 1 if word[0].isdigit() else 2 if word in UNITS else 3

    @staticmethod
    def windows(raw: np.ndarray, template: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: the template's hash, the hash of the values in its slots, and whether it has a slot."""
        n = len(raw) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        key, value, has = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int8)
        held = np.where(slot, raw, np.uint64(0))
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                odd = np.uint64((2 * k + 3) * 0x9E3779B1 | 1)
                key += template[k : k + n] * odd
                value += held[k : k + n] * odd
                has += slot[k : k + n]
        return mix(key), mix(value), has > 0

    @staticmethod
    def runs(raw: np.ndarray, size: int = AROUND) -> np.ndarray:
        """Hash of the ``size`` words from each place on."""
        n = max(0, len(raw) - size + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out += raw[k : k + n] * np.uint64((2 * k + 3) * 0x85EBCA6B | 1)
        return mix(out)

    def carried(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """(item, coverage) by text, for coverages above ``COVERAGE``."""
        found = [words(t) if t else [] for t in texts]
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        flat = [w for x in found for w in x]
        if not flat:
            return out
        raw, template, slot = self.encode(flat)
        ends = np.cumsum([len(x) for x in found])
        best: dict[tuple[int, int], float] = {}
        for size, wanted in self.short.items():
            own = self.runs(raw, size)
            for p in np.flatnonzero(np.isin(own, np.array(list(wanted), np.uint64))).tolist():
                d = int(np.searchsorted(ends, p, side="right"))
                if p + size <= ends[d]:
                    best.update({(d, item): 1.0 for item in wanted[int(own[p])]})
        keys, values, _ = self.windows(raw, template, slot)
        # the hash join: windows whose template some item has, then those whose slot values some item has
        at = np.arange(len(keys) if len(self.keys) else 0)
        for wanted, own in ((self.keys, keys), (self.values, values)):
            place = np.searchsorted(wanted, own[at])
            place[place == len(wanted)] = 0
            at = at[wanted[place] == own[at]]
        doc = np.searchsorted(ends, at, side="right")
        inside = at + WINDOW <= ends[doc]
        seeds: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p, d in zip(at[inside].tolist(), doc[inside].tolist()):
            for field, q in self.entries[int(keys[p])].get(int(values[p]), ()):
                seeds[d, field].add(p - q)
        runs = self.runs(raw) if seeds else raw
        for (d, field), diagonals in seeds.items():
            start, end = int(ends[d]) - len(found[d]), int(ends[d])
            covered, equal = self._matched(raw, start, end, field, diagonals)
            slots, telling, own = self.slots[field], self.telling[field], self.own_runs[field]
            if telling.any() and (equal & telling).sum() >= SURE * telling.sum():
                stretch = runs[start : max(start, end - AROUND + 1)]
                more = {start + p - q for p in np.flatnonzero(np.isin(stretch, own)).tolist() for q in np.flatnonzero(own == stretch[p]).tolist()}
                close = {x for x in more - diagonals if any(abs(x - y) <= DRIFT for y in diagonals)}
                covered |= self._matched(raw, start, end, field, close)[0]
            elif (equal & slots).sum() < SLOTS * (covered & slots).sum():
                continue
            share = float(covered.mean())
            if share > COVERAGE:
                key = (d, self.fields[field][0])
                best[key] = max(best.get(key, 0.0), share)
        for (d, item), share in best.items():
            out[d].append((item, share))
        return out

    def _matched(self, raw: np.ndarray, start: int, end: int, field: int, diagonals: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Which words of an item's text a document (its words from ``start`` to ``end``) has on the diagonals, and which of them are equal."""
        own = self.fields[field][1]
        n = len(own)
        covered, equal = np.zeros(n, bool), np.zeros(n, bool)
        for diagonal in diagonals:
            lo, hi = max(0, start - diagonal), min(n, end - diagonal)
            if hi - lo < AROUND:
                continue
            same = np.zeros(n, bool)
            same[lo:hi] = own[lo:hi] == raw[diagonal + lo : diagonal + hi]
            near = np.convolve(same, np.ones(AROUND), "valid") >= EQUAL
            wide = np.convolve(near, np.ones(AROUND), "full") > 0
            wide[:lo] = False
            wide[hi:] = False
            # a changed word at the rim of a matched stretch does not count
            rim = wide & (same | (np.roll(wide, 1) & np.roll(wide, -1)))
            covered |= rim
            equal |= same & rim
        return covered, equal


def _carried(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, items, shares = [], [], []
                for doc, found in zip(part.column("doc_id").to_pylist(), index.carried(part.column("text").to_pylist())):
                    for item, share in found:
                        ids.append(doc)
                        items.append(item)
                        shares.append(share)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "coverage"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts, names): in how many texts of the items each word stands, and how often it is written as a name; the number of texts under null."""
    for batch in batches:
        n, spread, names = vocabulary(t for q, s in zip(batch.column("question").to_pylist(), batch.column("solution").to_pylist()) for t in fields(q, s))
        every = [None, *(spread.keys() | names)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), pa.array([n, *(spread[w] for w in every[1:])], pa.int64()), pa.array([0, *(int(w in names) for w in every[1:])], pa.int64())], names=["word", "texts", "names"]
        )


def plain_of(items: DataFrame) -> frozenset[str]:
    """The plain words of all items; only frequent words, a bounded number, come to the driver."""
    counted = items.mapInArrow(_spread, "word string, texts bigint, names bigint").groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("names").alias("names"))
    n = counted.where("word IS NULL").agg(F.coalesce(F.max("texts"), F.lit(0))).collect()[0][0]
    rows = counted.where("word IS NOT NULL AND names = 0").where(F.col("texts") > max(PLAIN_LEAST, PLAIN_TEXTS * n)).collect()
    return plain_words(n, [(r["word"], r["texts"]) for r in rows], set())


def _met(plain: frozenset[str], item_side: bool):
    """(id, key, value) of the windows of texts: of items those that are evidence, of documents all; runs of short texts with their length as value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([], plain)
        for batch in batches:
            ids, keys, values = [], [], []

            def add(i: int, k: np.ndarray, v: np.ndarray) -> None:
                both = np.unique(np.stack((k, v), 1), axis=0)
                ids.append(np.full(len(both), i, np.int64))
                keys.append(both[:, 0].astype(np.int64))
                values.append(both[:, 1].astype(np.int64))

            texts = [fields(q, s) for q, s in zip(batch.column("question").to_pylist(), batch.column("solution").to_pylist())] if item_side else [[t or ""] for t in batch.column("text").to_pylist()]
            for i, own in zip(batch.column("id").to_pylist(), texts):
                for text in own:
                    found = words(text)
                    raw, template, slot = index.encode(found)
                    for size in range(SHORT, LEAST):
                        if not item_side or size == len(found):
                            run_of = index.runs(raw, size)
                            add(i, run_of, np.full(len(run_of), size, np.uint64))
                    if not item_side or len(found) >= LEAST:
                        k, v, has = index.windows(raw, template, slot)
                        at = index.counted(has) if item_side and len(has) else np.ones(len(k), bool)
                        add(i, k[at], v[at])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (ids, keys, values)], names=["id", "key", "value"])

    return run


def _compared(plain: frozenset[str]):
    """Pairs that met, each compared as an index of one item would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found_items, shares = [], [], []
            for doc, text, item, texts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "texts"))):
                rows = [{"item_id": item, "question": x["question"], "solution": x["solution"]} for x in texts]
                for _, share in Index(rows, plain).carried([text])[0]:
                    docs.append(doc)
                    found_items.append(item)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found_items, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "coverage"])

    return run


def leaks(documents: DataFrame, items: DataFrame, items_most: int = ITEMS_MOST) -> DataFrame:
    """``doc_id, item_id, coverage`` for every document of ``documents(doc_id, text)`` that carries an item of
    ``items(item_id, question, solution)``."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "question", "solution").where("item_id IS NOT NULL")
    schema = "doc_id bigint, item_id bigint, coverage double"
    few = asked.limit(items_most + 1).collect()
    if len(few) <= items_most:
        n, spread, names = vocabulary(t for r in few for t in fields(r["question"], r["solution"]))
        return docs.mapInArrow(_carried(Index(sorted(few, key=repr), plain_words(n, spread.items(), names))), schema)
    plain = plain_of(asked)
    own = asked.select(F.col("item_id").alias("id"), "question", "solution").mapInArrow(_met(plain, True), "id bigint, key bigint, value bigint").withColumnRenamed("id", "item_id").distinct()
    met = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_met(plain, False), "id bigint, key bigint, value bigint").withColumnRenamed("id", "doc_id")
    pairs = met.join(own, ["key", "value"]).select("doc_id", "item_id").distinct()
    texts = asked.groupBy("item_id").agg(F.collect_list(F.struct("question", "solution")).alias("texts"))  # the rows of one id
    return pairs.join(docs, "doc_id").join(texts, "item_id").select("doc_id", "text", "item_id", "texts").mapInArrow(_compared(plain), schema)
