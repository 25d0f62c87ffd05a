"""Subject areas of documents.

A text is a bag of words; a word's vector is the mean of the embeddings of its own and its character
n-grams' buckets (``BUCKETS`` of them, by hash, so unseen words have vectors too); a text's vector is the mean of its words'
vectors, and every subject has its own logistic output on it. All is trained by gradient descent (Adam) on the partitions of
the training rows: in every round each takes ``STEPS`` steps on its own rows, and then what their gradients have made of
the parameters is averaged, by their numbers of rows, for all.

Training is in two parts. The first takes whole labelled documents. The second takes their sentences:
each is given the one of its document's subjects that the model so far scores highest, twice over. A
sentence that is at home under every subject, such as page furniture, thereby ends below all of them.

Every document is scored in whole: sentence by sentence, a sentence counting with its length for its best
subject if that scores above ``SCORE``; the document has the subjects that reach ``SHARE`` of its length, at most the
``MOST`` with the largest shares (a parameter: a document treats one to three subjects).

Training uses at most ``TRAIN_MOST`` labelled documents, those with the smallest hash of ``doc_id``; counts
and scores cover all documents. Null, empty and wordless texts have no subject. Labels of unknown subjects
or documents are ignored; without any label no document has a subject. Repeated rows get equal results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialize

TRAIN_MOST, PARTS = 2400, 6
BUCKETS, SIZE, GRAMS = 1 << 14, 16, (3, 4, 5)
STEPS, ROUNDS, SENTENCE_ROUNDS, SENTENCE_PASSES, RATE, SENTENCE_RATE = 5, 10, 6, 2, 0.05, 0.1
SCORE, SHARE = 0.3, 0.125
#: A document has at most so many subjects: those with the largest shares.
MOST = 3

_WORD = re.compile(r"[^\W\d_]{2,}")
_SENTENCE = re.compile(r"(?<=[.?!。？！])\s+|\n+")
#: UTF-8 read as Latin-1.
_MISREAD = re.compile(r"[ÃÂ][\x80-¿ ]")


def clean(text: str) -> str:
    """Lower case, entities and wrongly decoded letters undone."""
    if not text.isascii() and _MISREAD.search(text):
        for wrong in ("cp1252", "latin-1"):
            try:
                text = text.encode(wrong).decode("utf-8")
                break
            except UnicodeError:
                continue
    if "&" in text:
        text = html.unescape(text)
    return text.lower()


def buckets(word: str) -> list[int]:
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)] if len(word) > 3 else []
    return [xxhash.xxh64_intdigest(f"w{word}".encode()) % BUCKETS] + [xxhash.xxh64_intdigest(f"g{g}".encode()) % BUCKETS for g in grams]


class Model:
    """Embeddings, output weights and biases."""

    def __init__(self, subjects: list[str], embedding: np.ndarray, weight: np.ndarray, bias: np.ndarray):
        self.subjects, self.embedding, self.weight, self.bias = subjects, embedding, weight, bias

    @classmethod
    def fresh(cls, subjects: list[str]) -> Model:
        rng = np.random.default_rng(7)
        return cls(
            subjects,
            rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
            rng.normal(0, 0.1, (SIZE, len(subjects))).astype(np.float32),
            np.full(len(subjects), -2, np.float32),
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.weight, self.bias]


def _times(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """A sparse matrix, given by its entries, times a dense one."""
    return np.stack([np.bincount(rows, values * dense[columns, k], minlength=n) for k in range(dense.shape[1])], 1).astype(np.float32)


def _entries(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, word, share of the row) of every entry, and (row, subject) of every target."""
    rows, words, shares, at, targets, n = [], [], [], [], [], 0
    for batch in batches:
        for ids, weights, wanted in zip(batch.column("words"), batch.column("shares"), batch.column("targets")):
            own = np.asarray(ids.values)
            rows.append(np.full(len(own), n))
            words.append(own)
            shares.append(np.asarray(weights.values))
            want = np.asarray(wanted.values)
            at.append(np.full(len(want), n))
            targets.append(want)
            n += 1
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero.astype(np.float32), zero, zero, 0
    return np.concatenate(rows), np.concatenate(words), np.concatenate(shares), np.concatenate(at).astype(np.int64), np.concatenate(targets).astype(np.int64), n


def _gradient(params: list[np.ndarray], vocabulary: tuple[np.ndarray, np.ndarray, np.ndarray], entries: tuple) -> list[np.ndarray]:
    """The gradient of the loss over the rows of ``entries``, a sum."""
    embedding, weight, bias = params
    word_of, bucket_of, part = vocabulary
    rows, words, shares, at, targets, n = entries
    size = int(word_of.max()) + 1
    vectors = _times(word_of, bucket_of, part, embedding, size)
    hidden = _times(rows, words, shares, vectors, n)
    wanted = np.zeros((n, len(bias)), np.float32)
    wanted[at, targets] = 1
    over = 1 / (1 + np.exp(-(hidden @ weight + bias))) - wanted
    back = _times(words, rows, shares, over @ weight.T, size)
    return [_times(bucket_of, word_of, part, back, BUCKETS), hidden.T @ over, over.sum(0)]


def _steps(state, vocabulary, steps: int, rate: float):
    """One row a partition: the parameters and their moments after its own steps, and how many rows they are over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _entries(batches)
        n = entries[-1]
        if not n:
            return
        t, params, first, second = state.value
        params, first, second = ([x.copy() for x in own] for own in (params, first, second))
        for _ in range(steps):
            t += 1
            for k, g in enumerate(_gradient(params, vocabulary.value, entries)):
                g = g / n
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
        blob = b"".join(np.ascontiguousarray(x, np.float32).tobytes() for own in (params, first, second) for x in own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["n", "state"])

    return run


def _descend(model: Model, rows: DataFrame, vocabulary, rounds: int, rate: float, steps: int = STEPS) -> Model:
    """``rounds`` of ``steps`` steps of Adam on each partition's rows, averaged after every round."""
    spark = rows.sparkSession
    parts = [[p.astype(np.float32) for p in model.parts], *([np.zeros_like(p, np.float32) for p in model.parts] for _ in range(2))]
    for r in range(rounds):
        state = spark.sparkContext.broadcast((r * steps, *parts))
        found = rows.mapInArrow(_steps(state, vocabulary, steps, rate), "n bigint, state binary").collect()  # one row of fixed size a partition
        state.destroy()
        total = sum(x["n"] for x in found)
        if not total:
            break
        found.sort(key=lambda x: (x["n"], bytes(x["state"][:64])))  # the sum in one order, whichever task ends first
        flat = np.sum([np.frombuffer(x["state"], np.float32) * np.float32(x["n"] / total) for x in found], 0, dtype=np.float32)
        at = 0
        for own in parts:
            for k, p in enumerate(own):
                own[k] = flat[at : at + p.size].reshape(p.shape)
                at += p.size
    return Model(model.subjects, *parts[0])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of training documents as words; number 0 is the whole document."""
    for batch in batches:
        docs, numbers, words, targets = [], [], [], []
        for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("targets").to_pylist()):
            sentences = [found for s in _SENTENCE.split(clean(text or "")) if (found := _WORD.findall(s))]
            for k, found in enumerate([[w for s in sentences for w in s], *sentences]):
                if found:
                    docs.append(doc)
                    numbers.append(k)
                    words.append(found)
                    targets.append(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(targets, pa.list_(pa.int32()))], names=["doc_id", "number", "found", "targets"])


def _encoded(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = index.value
        for batch in batches:
            words, shares = [], []
            for found in batch.column("found").to_pylist():
                counts = Counter(found)
                words.append([place[w] for w in counts])
                shares.append([n / len(found) for n in counts.values()])
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(words, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), batch.column("targets")], names=["number", "words", "shares", "targets"])

    return run


def _assigned(held, vocabulary):
    """Each sentence's target: the best-scored of its document's subjects. ``held`` has a model's subjects and arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        word_of, bucket_of, part = vocabulary.value
        vectors = _times(word_of, bucket_of, part, model.embedding, int(word_of.max()) + 1) @ model.weight
        for batch in batches:
            best = []
            for ids, weights, wanted in zip(batch.column("words"), batch.column("shares"), batch.column("targets").to_pylist()):
                score = np.asarray(weights.values) @ vectors[np.asarray(ids.values)] + model.bias
                best.append([max(wanted, key=lambda s: float(score[s]))])
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("words"), batch.column("shares"), pa.array(best, pa.list_(pa.int32()))], names=["number", "words", "shares", "targets"])

    return run


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, train_most: int = TRAIN_MOST) -> Model | None:
    """A model of ``subjects(subject)`` from ``labels(doc_id, subject)``; None if no label is usable.

    At most ``train_most`` labelled documents are used. The subjects are a fixed list; both fit any driver.
    """
    spark = documents.sparkSession
    names = [r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    if not names:
        return None
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("subject")).cast("int") - 1
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), place.alias("target")).where("doc_id IS NOT NULL AND target >= 0")
    sample = known.groupBy("doc_id").agg(F.sort_array(F.collect_set("target")).alias("targets")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_most)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    units = materialize(texts.join(F.broadcast(sample), "doc_id").repartition(PARTS, "doc_id").mapInArrow(_units, "doc_id bigint, number int, found array<string>, targets array<int>"), "units")
    words = sorted(r["w"] for r in units.where("number = 0").select(F.explode("found").alias("w")).distinct().collect())  # of train_most documents
    if not words:
        return None
    sc = spark.sparkContext
    grams = [buckets(w) for w in words]
    sizes = np.array([len(g) for g in grams])
    vocabulary = sc.broadcast((np.repeat(np.arange(len(words)), sizes), np.concatenate([np.array(g) for g in grams]), np.repeat(1 / sizes, sizes).astype(np.float32)))
    index = sc.broadcast({w: k for k, w in enumerate(words)})
    schema = "number int, words array<int>, shares array<float>, targets array<int>"
    coded = units.select("number", "found", "targets").mapInArrow(_encoded(index), schema)
    whole = materialize(coded.where("number = 0").coalesce(PARTS), "train-documents").coalesce(PARTS)
    model = _descend(Model.fresh(names), whole, vocabulary, ROUNDS, RATE)
    parts = materialize(coded.where("number > 0").coalesce(PARTS), "train-sentences")
    for _ in range(SENTENCE_PASSES):
        rows = materialize(parts.mapInArrow(_assigned(sc.broadcast((model.subjects, *model.parts)), vocabulary), schema).coalesce(PARTS), "train-assigned").coalesce(PARTS)
        model = _descend(model, rows, vocabulary, SENTENCE_ROUNDS, SENTENCE_RATE)
    return model


class WordScores:
    """The subjects' scores of words, each worked out once."""

    MOST = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.subjects)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.MOST:
            self.clear()
        for w in set(words).difference(self.place):
            k = self.place[w] = len(self.place)
            if k >= len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[k] = self.model.embedding[buckets(w)].mean(0) @ self.model.weight
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def subjects_of(texts: list[str | None], scores: WordScores) -> list[list[int]]:
    """Indices of the subjects of each text."""
    bias, n_subjects = scores.model.bias, len(scores.model.subjects)
    flat: list[str] = []
    ends, lengths, owners = [], [], []
    totals = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        for sentence in _SENTENCE.split(clean(text)):
            totals[i] += len(sentence)
            found = _WORD.findall(sentence)
            if found:
                flat += found
                ends.append(len(flat))
                lengths.append(len(sentence))
                owners.append(i)
    out: list[list[int]] = [[] for _ in texts]
    if not flat:
        return out
    ends_ = np.array(ends)
    starts = np.concatenate(([0], ends_[:-1]))
    sums = np.add.reduceat(scores.of(flat), starts, axis=0)
    score = sums / (ends_ - starts)[:, None] + bias
    best = score.argmax(1)
    counted = score[np.arange(len(best)), best] > SCORE
    owner, length = np.array(owners), np.array(lengths)
    share = np.bincount(owner[counted] * n_subjects + best[counted], length[counted], minlength=len(texts) * n_subjects).reshape(len(texts), n_subjects)
    for i, s in np.argwhere((share > 0) & (share >= SHARE * totals[:, None])):
        out[i].append(int(s))
    for i, own in enumerate(out):
        if len(own) > MOST:
            out[i] = sorted(sorted(own, key=lambda s: (-share[i, s], s))[:MOST])
    return out


def _scored(held, kept: list[str]):
    """``held`` has a model's subjects and arrays, which every executor can read without this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        scores = WordScores(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = subjects_of(part.column("text").to_pylist(), scores)
                names = [[model.subjects[s] for s in x] for x in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.list_(pa.string()))], names=[*kept, "subjects"])

    return run


def assign(documents: DataFrame, model: Model | None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, subjects`` (an array, possibly empty) of every row of ``documents(doc_id, text)``, with the columns to ``keep``."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, "text")
    if model is None:
        return docs.select("doc_id", *keep, F.array().cast("array<string>").alias("subjects"))
    # about a megabyte, whatever the corpus
    held = docs.sparkSession.sparkContext.broadcast((model.subjects, *model.parts))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "subjects array<string>"])
    return docs.mapInArrow(_scored(held, ["doc_id", *keep]), schema)


def composition(assigned: DataFrame) -> DataFrame:
    """Documents by subject and their share, in the corpus (null source, ``scope`` corpus) and per source, from ``assigned(source, subjects)``."""
    rows = assigned.groupBy(F.lower("source").alias("source"), "subjects").agg(F.count("*").alias("n"))
    per = rows.groupBy("source").agg(F.sum("n").alias("n_source"))
    cells = rows.select("source", F.explode("subjects").alias("subject"), "n").groupBy("source", "subject").agg(F.sum("n").alias("n_docs"))
    by_source = cells.join(per, cells["source"].eqNullSafe(per["source"])).select(F.lit("source").alias("scope"), cells["source"], "subject", "n_docs", (F.col("n_docs") / F.col("n_source")).alias("share"))
    total = rows.agg(F.sum("n").alias("n_all"))
    corpus = cells.groupBy("subject").agg(F.sum("n_docs").alias("n_docs")).crossJoin(F.broadcast(total))  # total is one row
    return by_source.unionByName(corpus.select(F.lit("corpus").alias("scope"), F.lit(None).cast("string").alias("source"), "subject", "n_docs", (F.col("n_docs") / F.col("n_all")).alias("share")))
