"""Percentiles of very large numeric columns by group, from sketches that merge.

``sketch`` makes one sketch a group and day in every task (``reqsketch``), then merges those of a group; a hot
group's partial sketches are first merged in ``FAN`` parts, so no task holds or reads all of a group's rows.
``merge`` puts sketches together over fewer keys - days into all time, say - and ``percentiles`` reads
them. Sketches are binary values in ordinary tables and can be stored and merged later.

Null and NaN values have no rank: they are counted (``n_null``, ``n_nan``) and left out. A group without
values has null percentiles. A null key is a group of its own. Infinite values rank as numbers. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.reqsketch import Sketch

SHARES = (0.5, 0.9, 0.95, 0.99, 0.999)
#: Parts in which the partial sketches of one group are merged at first.
FAN = 16
#: Groups and bytes of one task above which its partial sketches are handed on early.
GROUPS_MOST, BYTES_MOST = 50_000, 64 << 20

_STATE = "part int, n_null bigint, n_nan bigint, n_values bigint, sketch binary"


def _partial(keys: Sequence[str], value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        part, size = None, 0

        def flush() -> pa.RecordBatch:
            groups = list(held.items())
            held.clear()
            columns = [pa.array([g[0][k] for g in groups], pa.string()) for k in range(len(keys))]
            columns.append(pa.array([part] * len(groups), pa.int32()))
            for k in range(2):
                columns.append(pa.array([g[1][k] for g in groups], pa.int64()))
            columns.append(pa.array([g[1][2].n for g in groups], pa.int64()))
            columns.append(pa.array([g[1][2].dumps() for g in groups], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "part", "n_null", "n_nan", "n_values", "sketch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            code = np.zeros(batch.num_rows, np.int64)
            names = []
            for key in keys:
                coded = batch.column(key).dictionary_encode()
                names.append([*coded.dictionary.to_pylist(), None])
                own = coded.indices.fill_null(len(names[-1]) - 1).to_numpy(zero_copy_only=False)
                code = code * len(names[-1]) + own
            values = batch.column(value)
            null = values.is_null().to_numpy(zero_copy_only=False)
            number = values.to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(code, kind="stable")
            found, first = np.unique(code[order], return_index=True)
            for c, rows in zip(found.tolist(), np.split(order, first[1:])):
                key, rest = [], c
                for own in reversed(names):
                    rest, k = divmod(rest, len(own))
                    key.append(own[k])
                key = tuple(reversed(key))
                if key not in held:
                    held[key] = [0, 0, Sketch(xxhash.xxh64_intdigest(repr((key, part)).encode()))]
                    size += 500
                state = held[key]
                gone = null[rows]
                state[0] += int(gone.sum())
                kept = number[rows][~gone]
                nan = np.isnan(kept)
                state[1] += int(nan.sum())
                size -= state[2].nbytes
                state[2].add(kept[~nan])
                size += state[2].nbytes
            if len(held) > GROUPS_MOST or size > BYTES_MOST:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _merged(keys: Sequence[str]):
    """Merges neighbouring rows of equal keys; holds one sketch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row(key: tuple, state: list) -> list:
            return [*key, state[3], state[0], state[1], state[2].n, state[2].dumps()]

        def packed(rows: list[list]) -> pa.RecordBatch:
            types = [*[pa.string()] * len(keys), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*keys, "part", "n_null", "n_nan", "n_values", "sketch"])

        for batch in batches:
            done = []
            own = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            for key, part, n_null, n_nan, blob in zip(own, batch.column("part").to_pylist(), batch.column("n_null").to_pylist(), batch.column("n_nan").to_pylist(), batch.column("sketch").to_pylist()):
                if state is None or key != current:
                    if state is not None:
                        done.append(row(current, state))
                    current, state = key, [0, 0, Sketch.loads(blob, xxhash.xxh64_intdigest(repr((key, part)).encode())), part]
                else:
                    state[2].merge(Sketch.loads(blob))
                state[0] += n_null
                state[1] += n_nan
            if done:
                yield packed(done)
        if state is not None:
            yield packed([row(current, state)])

    return run


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch for each value of ``keys``, from sketches over those and more keys."""
    schema = ", ".join([*[f"`{k}` string" for k in keys], _STATE])
    # what follows from the rows alone orders the merging, so a repeated task gives the same sketch
    salted = sketches.select(*keys, F.pmod(F.xxhash64("part", "sketch"), F.lit(FAN)).cast("int").alias("fan"), "part", "n_null", "n_nan", "n_values", "sketch")
    first = salted.repartition(*keys, "fan").sortWithinPartitions(*keys, "fan", "part", F.xxhash64("sketch")).select(*keys, F.col("fan").alias("part"), "n_null", "n_nan", "n_values", "sketch")
    parts = first.mapInArrow(_merged([*keys]) if not keys else _by_fan(keys), schema)
    second = parts.repartition(*keys) if keys else parts.repartition(1)  # FAN rows a group
    return second.sortWithinPartitions(*keys, "part").mapInArrow(_merged(keys), schema)


def _by_fan(keys: Sequence[str]):
    """As ``_merged``, but rows of another ``part`` are another sketch."""
    inner = _merged([*keys, "fan_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_fan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                yield pa.RecordBatch.from_arrays([*batch.columns, batch.column("part").cast(pa.string())], names=[*batch.schema.names, "fan_"])

        for batch in inner(with_fan(batches)):
            at = batch.schema.names.index("fan_")
            names = [n for n in batch.schema.names if n != "fan_"]
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at], names=names)

    return run


def sketch(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sketches of ``value`` by ``keys`` (taken as strings): the keys, counts and the sketch."""
    rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).cast("double").alias(value), F.spark_partition_id().alias("part"))
    schema = ", ".join([*[f"`{k}` string" for k in keys], _STATE])
    return merge(rows.mapInArrow(_partial(keys, value), schema), keys)


def _read(keys: Sequence[str], shares: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Sketch.loads(b).percentiles(list(shares)) for b in batch.column("sketch").to_pylist()]
            kept = [batch.column(k) for k in (*keys, "n_null", "n_nan", "n_values")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float64()))], names=[*keys, "n_null", "n_nan", "n_values", "found"])

    return run


def percentiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float] = SHARES) -> DataFrame:
    """A row for each group and share: ``share`` and the ``value`` of which that share of the values is at most."""
    schema = ", ".join([*[f"`{k}` string" for k in keys], "n_null bigint, n_nan bigint, n_values bigint, found array<double>"])
    read = sketches.mapInArrow(_read(keys, shares), schema)
    pairs = F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("found").alias("value"))
    return read.select(*keys, "n_null", "n_nan", "n_values", F.explode(pairs).alias("p")).select(*keys, "n_null", "n_nan", "n_values", F.col("p.share").alias("share"), F.col("p.value").alias("value"))
