import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tallyforge.llm")
from tallyforge.llm import packing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{packing.TOKENIZERS}/{packing.VOCABULARY}"), reason="no vocabulary file")


def test_hilbert_visits_every_cell_and_steps_by_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = packing.hilbert(points, bits)
        assert sorted(place.tolist()) == list(range(len(points)))
        path = points[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=80), st.integers(1, 128))
def test_pack(sizes, capacity):
    ids = np.arange(len(sizes))
    item, piece, size, sequence, offset = packing.pack(ids, np.array(sizes, np.int64), capacity)
    for k, n in enumerate(sizes):
        own = np.flatnonzero(item == k)
        assert size[own].sum() == n
        assert len(own) == -(-n // capacity)
        assert piece[own].tolist() == list(range(len(own)))
    for s in set(sequence.tolist()):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(size[own])[:-1].tolist()] and size[own].sum() <= capacity
    if len(sizes):
        # no two sequences would fit into one, but for the last of an open few
        filled = np.bincount(sequence, size)
        assert (filled * 2 <= capacity).sum() <= 1


@needs_vocabulary
def test_round_trip_of_documents(spark):
    rows = [(i, f"note {i} on the tunnel and the gearbox " * (i % 40 + 1)) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "lorem ipsum dolor " * 5000), (1004, "note 3 on the tunnel and the gearbox " * 4), (1005, "日本語のテキスト。")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, n_tokens string").repartition(4)
    sizes = packing.sized(df)
    coder = packing.tokenizer(packing.vocabulary())
    want = {i: len(coder.encode_ordinary(t)) for i, t in rows if t}
    assert {r["doc_id"]: r["n_tokens"] for r in sizes.collect()} == want
    placed = packing.stretches(sizes)
    first = packing.sequences(placed, 512).toPandas()
    assert first.groupby("doc_id")["n_tokens"].sum().to_dict() == want
    assert first.groupby("sequence_id")["n_tokens"].sum().max() <= 512
    whole = first.groupby("doc_id")["sequence_id"].nunique()
    assert all(n == 1 for i, n in whole.items() if want[i] <= 512)
    again = packing.sequences(packing.stretches(packing.sized(df.repartition(3))), 512).toPandas()
    key = ["doc_id", "piece"]
    assert first.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    row = packing.unused(packing.sequences(placed, 512), 512).collect()[0]
    assert row["n_docs"] == len(want) and row["n_tokens"] == sum(want.values()) and row["unused_share"] < 0.05


@needs_vocabulary
def test_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 2000)
    df = spark.createDataFrame([(i, "the very same text as all the others here") for i in range(3000)], "doc_id bigint, text string")
    placed = packing.stretches(packing.sized(df))
    assert placed.select("stretch").distinct().count() > 5
    found = packing.sequences(placed, 64).toPandas()
    assert len(found) == 3000 and found.groupby("sequence_id")["n_tokens"].sum().max() <= 64


@needs_vocabulary
def test_large_cells_keep_the_order_of_the_curve(spark, monkeypatch):
    """Every cell of the first level is too large; its documents stay in the order of the curve, whatever cells are sent or joined."""
    monkeypatch.setattr(packing, "STRETCH", 1500)
    monkeypatch.setattr(packing, "CELL_BITS", 4)
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(300)]
    df = spark.createDataFrame([(i, " ".join(words[int(k)] for k in rng.integers(0, 300, rng.integers(5, 60)))) for i in range(1500)] + [(5000 + i, "one and the same text") for i in range(900)], "doc_id bigint, text string")
    sizes = packing.sized(df)
    found = packing.stretches(sizes).toPandas()
    assert len(found) == 2400 and found["stretch"].str[0].isin(["1"]).mean() < 0.2
    spans = found[~found["stretch"].str.startswith("same")].groupby("stretch").agg(lo=("place", "min"), hi=("place", "max"), n=("n_tokens", "sum")).sort_values("lo")
    assert (spans["lo"].to_numpy()[1:] > spans["hi"].to_numpy()[:-1]).all() and spans["n"].max() <= 2 * 1500 + 200
    assert found[found["stretch"].str.startswith("same")].groupby("place")["stretch"].nunique().max() >= 3
    monkeypatch.setattr(packing, "BROADCAST_MOST", 0)
    again = packing.stretches(sizes).toPandas()
    assert found.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


@needs_vocabulary
def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    placed = packing.stretches(packing.sized(df))
    assert packing.sequences(placed, 64).collect() == []
    assert packing.unused(packing.sequences(placed, 64), 64).collect()[0]["unused_share"] == 0.0
