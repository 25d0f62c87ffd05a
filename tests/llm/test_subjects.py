import numpy as np
import pytest

pytest.importorskip("tallyforge.llm")
from tallyforge.llm import subjects

WORDS = {"law": "court lease verdict tribunal easement notary".split(), "sport": "goal referee match league serve podium".split(), "music": "sonata chord fugue tempo cellist aria".split()}
PLAIN = "the report compares this and that with more of these over some pages".split()
NEUTRAL = "More on that later in another place."


def sentence(rng, subject):
    return " ".join([*rng.choice(PLAIN, 4), *rng.choice(WORDS[subject], 3), *rng.choice(PLAIN, 2)]) + "."


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for i in range(n):
        chosen = list(rng.choice(list(WORDS), rng.integers(1, 3), replace=False))
        text = " ".join([sentence(rng, s) for s in chosen for _ in range(4)] + [NEUTRAL])
        rows.append((i, text))
        truth[i] = set(chosen)
    return rows, truth


@pytest.fixture(scope="module")
def fitted(spark):
    rows, truth = corpus(160, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, s) for i, own in truth.items() for s in own][:-8] + [(0, "unknown"), (9999, "law"), (None, "law"), (1, None)]
    return subjects.train(docs, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(s,) for s in WORDS] * 2, "subject string"))


def test_held_out_accuracy(spark, fitted):
    rows, truth = corpus(120, 2)
    extra = [(1000, None), (1001, ""), (1002, " \n — "), (1003, NEUTRAL), (1004, rows[0][1] * 300), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + extra], "doc_id bigint, text string, subjects string")
    found = {r["doc_id"]: set(r["subjects"]) for r in subjects.assign(docs, fitted).collect()}
    assert len(found) == 125 and subjects.assign(docs, fitted).count() == 126
    assert np.mean([found[i] == truth[i] for i in truth]) >= 0.95
    assert found[1000] == found[1001] == found[1002] == set() and found[1004] == found[0]


def test_a_sentence_in_passing_does_not_count(fitted):
    rng = np.random.default_rng(4)
    text = " ".join([sentence(rng, "law") for _ in range(15)] + [sentence(rng, "music")])
    assert [fitted.subjects[s] for s in subjects.subjects_of([text], subjects.WordScores(fitted))[0]] == ["law"]


def test_gradient_is_that_of_the_loss():
    """Against differences of the loss, on dense arithmetic."""
    rng = np.random.default_rng(0)
    vocabulary = ["alpha", "beta", "gamma"]
    grams = [subjects.buckets(w) for w in vocabulary]
    word_of = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)])
    bucket_of, part = np.concatenate(grams), np.concatenate([np.full(len(g), 1 / len(g)) for g in grams]).astype(np.float32)
    model = subjects.Model.fresh(["x", "y"])

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[0, 1], [2]], pa.list_(pa.int32())), pa.array([[0.5, 0.5], [1.0]], pa.list_(pa.float32())), pa.array([[0], [0, 1]], pa.list_(pa.int32()))], names=["words", "shares", "targets"])
    flat = np.concatenate([np.ravel(g) for g in subjects._gradient(model.parts, (word_of, bucket_of, part), subjects._entries(iter([batch])))])

    def loss(parts):
        e, w, b = [p.astype(float) for p in parts]
        v = np.stack([e[g].mean(0) for g in grams])
        z = np.stack([v[:2].mean(0), v[2]]) @ w + b
        y = np.array([[1, 0], [1, 1]])
        return float((np.logaddexp(0, z) - y * z).sum())

    at = 0
    for k, p in enumerate(model.parts):
        picks = bucket_of[:3] * subjects.SIZE if k == 0 else rng.integers(0, p.size, 3)
        for i in picks:
            up, down = [[q.astype(float) for q in model.parts] for _ in range(2)]
            up[k].flat[i] += 1e-4
            down[k].flat[i] -= 1e-4
            assert flat[at + i] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-3)
        at += p.size


def test_without_labels_or_documents(spark, fitted):
    docs = spark.createDataFrame([(1, "court and lease")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    names = spark.createDataFrame([("law",)], "subject string")
    assert subjects.train(docs, none, names) is None and subjects.train(docs, none, names.limit(0)) is None
    assert [r["subjects"] for r in subjects.assign(docs, None).collect()] == [[]]
    assert subjects.assign(docs.limit(0), fitted).collect() == []


def test_composition(spark):
    own = spark.createDataFrame([(1, "A", ["law", "music"]), (2, "a", ["law"]), (3, None, [])], "doc_id bigint, source string, subjects array<string>")
    found = {(r["scope"], r["source"], r["subject"]): (r["n_docs"], round(r["share"], 3)) for r in subjects.composition(own).collect()}
    assert found == {("source", "a", "law"): (2, 1.0), ("source", "a", "music"): (1, 0.5), ("corpus", None, "law"): (2, 0.667), ("corpus", None, "music"): (1, 0.333)}


def test_clean():
    assert subjects.clean("Hipotecaci&oacute;n A&amp;B") == "hipotecación a&b" and subjects.clean("presiÃ³n") == "presión"
