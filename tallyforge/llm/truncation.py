"""Texts cut off before their end.

Two stages, in this order.

1. *Near-copies* (``nearcopy``). Every text that may go on - one that ends neither in a stop that can only be the end of a
   sentence nor in a mark of a cut - is held against the beginnings of all texts by min-hash bands over five-word
   shingles; pairs are verified and aligned, and the text is flagged if its alignment ends inside a word or
   a sentence of the other.
2. *Closing words.* The rest are scored by how they close (``closing``): terminal punctuation, closed
   delimiters and marks of a cut decide at once. A list entry or option is whole if its closing word, or
   closing pair of words, ends phrases elsewhere in the corpus. A bare ending of running text is whole only if it
   is an established formula: at least ``KEY_SHARE`` (``NUMBER_SHARE`` if it ends in a number) of all bare endings, rarely followed by more
   text or by the rest of its word, and not ending in what elsewhere only begins longer words. An ellipsis is the
   author's own if its phrase makes up ``ELL_SHARE`` of all closing ellipses. One text counts for its closing
   ``COPIES`` times at most, so that no group of copies makes a formula of its own ending.

All statistics cover all rows. Nulls and blank texts are never flagged; repeated rows get equal verdicts;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import closing, nearcopy
from tallyforge.llm.hashing import WordHashes
from tallyforge.session import materialize

#: A closing that ends in a number cannot be the fragment of a word, so a smaller share will do.
KEY_SHARE, NUMBER_SHARE, KEY_LEAST, KEY_MID = 0.002, 0.0005, 3, 0.5
ELL_SHARE, ELL_LEAST = 0.1, 5
#: So many copies of one text count. A formula needs KEY_LEAST texts, of which one of under nearcopy.LEAST_WORDS words, that is
#: likely to be given anew, counts for each of its copies up to COPIES.
COPIES = 3
#: From so many different texts on, a closing that ends in a capitalised word is taken to sign them.
SIGNERS = 10
#: A phrase closes if so many of the word's, or of the word pair's, occurrences stand before a boundary.
WORD_CLOSES, PAIR_CLOSES, PAIR_LEAST = 0.08, 0.01, 2
#: Closing words up to this number are looked up in each task; beyond it all are counted and joined.
LOOKUP_MOST = 100_000
FLUSH, CHUNK, BATCH = 200_000, 256, 10_000

#: A token between blanks: its word and what follows it; a stop right behind; the word or number of the one before.
_OWN_WORD = re.compile(r"^\W*([^\W\d_]+(?:['’\-][^\W\d_]+)*)(\W*)$")
_STOP = re.compile(r"^\$?(?:[?!,;:)。？！]|\.(?!\.))")
_OWN_PAIR = re.compile(r"(?:[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*)$")
_NUMBERS = re.compile(r"\d+(?:[.,]\d+)*")

FEATURES = (
    "table_name string, row_id bigint, run_id string, id bigint, state tinyint, key string, word string, pair string, "
    "text_hash bigint, signed boolean, asks array<struct<key: bigint, mark: bigint>>"
)
_ARROW = pa.schema(
    [
        ("table_name", pa.string()), ("row_id", pa.int64()), ("run_id", pa.string()), ("id", pa.int64()), ("state", pa.int8()), ("key", pa.string()), ("word", pa.string()), ("pair", pa.string()),
        ("text_hash", pa.int64()), ("signed", pa.bool_()), ("asks", pa.list_(pa.struct([("key", pa.int64()), ("mark", pa.int64())]))),
    ]
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each text closes; and of each that may go on its near-copy keys and mark."""
    hashes = WordHashes()
    for batch in (b.slice(lo, BATCH) for b in batches for lo in range(0, b.num_rows, BATCH)):
        texts = batch.column("text").to_pylist()
        states = [closing.closing_state(t) for t in texts]
        pairs, copies, signed, opened, tails, rows = [], [], [], [], [], []
        for k, (text, (state, _, word)) in enumerate(zip(texts, states)):
            pairs.append(_closing_pair(text) if state == closing.WORD and word else None)
            words = text.lower().split() if text else []
            if state in (closing.KEY, closing.ELL):
                copies.append(xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63))
                signed.append(len(words) >= nearcopy.LEAST_WORDS)
            else:
                copies.append(None)
                signed.append(None)
            ended = nearcopy.open_end(words, state)
            if ended:
                opened.append(ended[0])
                tails.append(ended[1])
                rows.append(k)
        lengths = np.array([len(x) for x in opened], np.int64)
        of, own, marks = nearcopy.last_keys(hashes.of(list(chain.from_iterable(opened))), lengths, tails)
        counts = np.zeros(len(texts), np.int64)
        counts[rows] = np.bincount(of, minlength=len(rows))
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        both = pa.StructArray.from_arrays([pa.array(own.astype(np.int64)), pa.array(marks.astype(np.int64))], names=["key", "mark"])
        asks = pa.ListArray.from_arrays(ends, both, mask=pa.array(counts == 0))
        columns = [
            *(batch.column(c) for c in ("table_name", "row_id", "run_id", "id")),
            *([x[0] for x in states], [x[1] or None for x in states], [x[2] or None for x in states], pairs, copies, signed),
            asks,
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _closing_pair(text: str) -> str:
    """The last two tokens, numbers as 0."""
    return " ".join(closing._TOKEN.findall(_NUMBERS.sub("0", text[-160:].lower().rstrip(closing._TRIM)))[-2:]).replace("\n", "\\n")


def _key_pattern(key: str) -> tuple[str, re.Pattern, re.Pattern]:
    """The longest word of a closing key in lower case, if it has one; the key's part before it, or else before its longest mark; and the rest with more of its sentence behind it."""
    parts = key.split(" ")

    def one(p: str) -> str:
        if p == "\\n":
            return r"\n\n*"  # one break first, for which the search is fast
        if p == "0":
            return r"\d+(?:[.,]\d+)*(?!\d)"
        return r"[A-Z][^\W\d_A-Z]+" if p == "<C>" else f"(?i:{re.escape(p)})" if p[0].isalpha() else re.escape(p)

    at = max(range(len(parts)), key=lambda k: (parts[k][0].isalpha() and len(parts[k]), parts[k] not in ("0", "<C>") and len(parts[k].replace("\\n", "n")), -k))
    literal = parts[at] if parts[at][0].isalpha() else ""
    head = r"(?<![^\W_])" if parts[0][0].isalnum() else ""
    # a last word may be the beginning of a longer one, which goes on as well
    tail = r"(?:(?=[^\W\d_])|(?![^\W_])(?=[ \t]*[^\s.?!]))" if parts[-1][0].isalpha() else r"(?![^\W_])(?=[ \t]*[^\s.?!])"
    before = re.compile(head + "".join(one(p) + r"[ \t]*" for p in parts[:at]) + r"\Z")
    return literal, before, re.compile((head if not at else "") + r"[ \t]*".join(map(one, parts[at:])) + tail)


def _key_word(key: str) -> str | None:
    """The word in which a closing key ends, if it is known."""
    last = key.rsplit(" ", 1)[-1]
    return last if last[0].isalpha() else None


class _Asked(dict):
    """Whether the word of a token is wanted, remembered; ``longer`` has those of ``ends`` that a longer word begins with."""

    def __init__(self, wanted: frozenset[str] | None, ends: frozenset[str] = frozenset()):
        self.wanted, self.ends, self.longer = wanted, ends, set()
        self.sizes = sorted({len(w) for w in ends})

    def __missing__(self, token: str) -> bool:
        if len(self) > FLUSH:
            self.clear()
        found = _OWN_WORD.match(token)
        if found and self.ends:
            word = found.group(1)
            self.longer.update(word[:k] for k in self.sizes if k < len(word) and word[:k] in self.ends)
        value = self[token] = bool(found) and (self.wanted is None or found.group(1) in self.wanted)
        return value


def _tokens(lower: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of the texts one after another, the places of the first of each line, and of the last of each but a text's last line.

    A text's last token is left out unless a stop follows: where the text ends tells nothing. A mark stands in its place.
    """
    cut = [t + " \0" if not t or t[-1] in closing._STOPS else t[: len(t) - len(t.rsplit(None, 1)[-1])] + " \0" for t in lower]
    lines = [found for x in "\n".join(cut).split("\n") if (found := x.split())]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    flat = list(chain.from_iterable(lines))
    return flat, ends - sizes, ends - 1


def _following(texts: list[str], patterns: list[tuple[str, str, re.Pattern, re.Pattern]]) -> Counter[str]:
    """How often each closing key has more of its sentence behind it: looked up where its literal stands."""
    found: Counter[str] = Counter()
    whole = "\v".join(texts)  # white space that no key holds
    low = whole.lower()
    if len(low) != len(whole):
        low = "".join(x.lower() if len(x.lower()) == 1 else x for x in whole)
    for key, literal, before, rest in patterns:
        if not literal:
            starts = [x.start() for x in rest.finditer(whole)]
            found[key] += sum(before.search(whole, max(0, x - 60), x) is not None for x in starts) if before.pattern != r"\Z" else len(starts)
            continue
        at = low.find(literal)
        while at >= 0:
            found[key] += rest.match(whole, at) is not None and before.search(whole, max(0, at - 60), at) is not None
            at = low.find(literal, at + len(literal))
    return +found


def _counted(keys: dict[str, int], wanted: frozenset[str] | None):
    """Counts, over whole texts, of what stands before more text: closing keys (k), words (w) and word pairs (p);
    and the closing keys' last words with which longer words begin (x).

    ``keys`` has for each closing key the count at which it is settled that it is no formula; a task that has
    met it so often looks for it no more, which leaves the verdict as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(k, *_key_pattern(k)) for k in sorted(keys)]
        singles: Counter[str] = Counter()
        line_ends: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        middle: Counter[str] = Counter()
        seen: Counter[str] = Counter()
        asked = _Asked(wanted, frozenset(filter(None, map(_key_word, keys))))

        def flush() -> pa.RecordBatch:
            n: Counter[str] = Counter(middle)
            closes: Counter[str] = Counter()
            for counts, ends in ((singles, False), (line_ends, True), (pairs, False)):
                for token, m in counts.items():
                    before, token = token if isinstance(token, tuple) else ("", token)
                    found = _OWN_WORD.match(token)
                    if not found:
                        continue
                    word, rest = found.groups()
                    if wanted is not None and word not in wanted:
                        continue
                    stop = bool(_STOP.match(rest))
                    if counts is pairs:
                        kept = _OWN_PAIR.search(before)
                        item = "p" + ("0" if kept and kept.group(0)[0].isdigit() else kept.group(0) if kept else "") + " " + word
                    else:
                        item = "w" + word
                    if ends:
                        closes[item] += m * (not stop and not rest)
                    else:
                        n[item] += m
                        closes[item] += m * stop
            for word in asked.longer:
                n["x" + word] = 1
            for c in (singles, line_ends, pairs, middle, asked.longer):
                c.clear()
            names = list(n)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[k] for k in names], pa.int64()), pa.array([closes[k] for k in names], pa.int64())], names=["item", "n", "closing"])

        for batch in batches:
            texts = [t.rstrip(closing._TRIM) for t in batch.column("text").to_pylist() if t]
            for lo in range(0, len(texts), CHUNK):
                part = texts[lo : lo + CHUNK]
                settled = False
                for key, n in _following(part, patterns).items():
                    seen[key] += n
                    middle["k" + key] += n
                    settled = settled or seen[key] >= keys[key]
                if settled:
                    patterns = [x for x in patterns if seen[x[0]] < keys[x[0]]]
                flat, firsts, lasts = _tokens([t.lower() for t in part])
                hit = np.fromiter(map(asked.__getitem__, flat), bool, len(flat))
                at = np.flatnonzero(hit)
                singles.update([flat[k] for k in at.tolist()])
                line_ends.update([flat[k] for k in lasts[hit[lasts]].tolist()])
                hit[firsts] = False
                pairs.update([(flat[k - 1], flat[k]) for k in np.flatnonzero(hit).tolist()])
            if len(pairs) > FLUSH:
                yield flush()
        if singles or middle or asked.longer:
            yield flush()

    return run


def truncated(texts: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Verdicts on the rows of ``texts(table_name, row_id, run_id, text)``.

    ``context(text)`` are further texts of the same domain (prompts, say) that only feed the statistics.
    Returns ``table_name, row_id, run_id, truncated, reason`` with reason one of ``near_copy``, ``mark``,
    ``closing_word``, ``closing_phrase``, ``ellipsis`` or null.
    """
    spark = texts.sparkSession
    texts = texts.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "run_id", "text", F.xxhash64("text").alias("id"))
    feats = materialize(texts.mapInArrow(_features, FEATURES), "closings")
    once = feats.where(F.col("state").isin(closing.KEY, closing.ELL)).groupBy("state", "key", "text_hash", "signed").agg(F.count("*").alias("n"))
    counted = F.least("n", F.lit(COPIES))
    # a closing name (a signature) that differs between texts is no cut: all rows count but further copies of the most frequent text
    names = F.col("key").endswith("<C>") & (F.count("*") >= SIGNERS)
    keyed = once.groupBy("state", "key").agg(F.when(names, F.sum("n") - F.max("n") + F.least(F.max("n"), F.lit(COPIES))).otherwise(F.sum(counted)).alias("n"), F.sum(F.when(F.col("signed"), 1).otherwise(counted)).alias("texts"))
    total = keyed.groupBy("state").agg(F.sum("n").alias("of"))
    # at most 1 / NUMBER_SHARE + 1 / ELL_SHARE rows, so they can go to every task
    frequent = keyed.join(F.broadcast(total), "state").where(
        f"(state = {closing.KEY} AND texts >= {KEY_LEAST} AND n >= IF(key LIKE '% 0', {NUMBER_SHARE}, {KEY_SHARE}) * of) OR (state = {closing.ELL} AND n >= {ELL_LEAST} AND n >= {ELL_SHARE} * of)"
    ).collect()
    ends = {r["key"]: r["n"] for r in frequent if r["state"] == closing.KEY}
    own = [r["key"] for r in frequent if r["state"] == closing.ELL]
    asked = feats.where(F.col("word").isNotNull() & F.col("state").isin(closing.WORD, closing.KEY)).where(
        (F.col("state") == closing.WORD) | F.col("key").endswith("<C>")).select("word").distinct()
    few = asked.limit(LOOKUP_MOST + 1).collect()
    wanted = frozenset(r["word"] for r in few) | frozenset(filter(None, map(_key_word, ends))) if len(few) <= LOOKUP_MOST else None
    corpus = texts.select("text") if context is None else texts.select("text").unionByName(context.select("text"))
    counts = corpus.mapInArrow(_counted({k: int(KEY_MID * n) + 1 for k, n in ends.items()}, wanted), "item string, n bigint, closing bigint").groupBy("item").agg(F.sum("n").alias("n"), F.sum("closing").alias("closing"))
    if wanted is not None:
        counts = counts.where(F.substring("item", 1, 1).isin("k", "w", "x") | (F.col("closing") > 0))
    counts = materialize(counts, "counts")
    mid = {r["item"][1:]: r["n"] for r in counts.where(F.col("item").startswith("k")).collect()}  # one row a key
    # a last word that stands nowhere but at an end, while longer ones begin with it, is a part of one; one row a key
    last = sorted({w for w in map(_key_word, ends) if w})
    seen = {r["item"] for r in counts.where(F.col("item").isin([kind + w for w in last for kind in "wx"])).select("item").collect()} if last else set()
    parts = {w for w in last if "x" + w in seen and "w" + w not in seen}
    formulas = [k for k, n in ends.items() if mid.get(k, 0) < KEY_MID * n and _key_word(k) not in parts]
    words = counts.where(F.col("item").startswith("w")).select(F.expr("substring(item, 2)").alias("word"), F.col("n").alias("word_n"), F.col("closing").alias("word_closing"))
    pairs = counts.where(F.col("item").startswith("p")).select(F.expr("substring(item, 2)").alias("pair"), F.col("n").alias("pair_n"), F.col("closing").alias("pair_closing"))
    opened = feats.where("asks IS NOT NULL").select("id", "asks")
    copies = nearcopy.cut_copies(texts.select("id", "text"), opened).withColumn("copy", F.lit(True))
    closes = F.coalesce(F.col("word_closing") >= WORD_CLOSES * F.col("word_n"), F.lit(False)) | F.coalesce(
        (F.col("pair_closing") >= PAIR_LEAST) & (F.col("pair_closing") >= PAIR_CLOSES * F.col("pair_n")), F.lit(False)
    )
    known = ~F.col("key").endswith("<C>") | F.col("word_n").isNotNull()
    state = F.col("state")
    reason = (
        F.when(F.col("copy"), "near_copy")
        .when(state == closing.CUT, "mark")
        .when((state == closing.WORD) & ~closes, "closing_word")
        .when((state == closing.KEY) & ~(F.col("key").isin(formulas) & known), "closing_phrase")
        .when((state == closing.ELL) & ~F.col("key").isin(own), "ellipsis")
    )
    # only a line's last word and a closing name are looked up; the other rows are not shuffled for it
    asks = (state == closing.WORD) | (state == closing.KEY) & F.col("key").endswith("<C>")
    rows = feats.select("table_name", "row_id", "run_id", "id", "state", "key", "word", "pair")
    looked = rows.where(asks).join(words, "word", "left").join(pairs, "pair", "left")
    joined = looked.unionByName(rows.where(~F.coalesce(asks, F.lit(False))), allowMissingColumns=True).join(copies, "id", "left")
    return joined.select("table_name", "row_id", "run_id", reason.isNotNull().alias("truncated"), reason.alias("reason"))


def shares(verdicts: DataFrame) -> DataFrame:
    """Truncated rows and their share by table and run; a null run is a run of its own."""
    return verdicts.groupBy("table_name", "run_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if("truncated").alias("n_truncated"),
        F.round(F.count_if("truncated") / F.count("*"), 6).alias("share"),
    )
