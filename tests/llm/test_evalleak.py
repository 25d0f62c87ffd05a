import pytest

pytest.importorskip("tallyforge.llm")
from tallyforge.llm import evalleak
from tallyforge.llm.textnorm import words

NAMES = ["Wendadine", "Korurin", "Pelloth", "Faskivik", "Ostrola", "Neshubel", "Iskanse", "Brylekka"]
THINGS = ["silk scarves", "pear trees", "clay whistles", "tin soldiers", "oak barrels", "wool blankets", "glass floats", "brass hinges"]


def question(k, name=None, thing=None, step=0):
    n, t = name or NAMES[k], thing or THINGS[k]
    return f"For {31 + k + step} mornings running {n} hauls {55 + k + step} {t} out of the tannery. By nightfall {12 + k + step} {t} have been traded for lamp oil, says {n}. To thank {n}, the tannery warden hands over {70 + k + step} spare {t}. Of usable {t}, how many does the tannery of {n} hold?"


def solution(k):
    return f"{NAMES[k]} first handles {31 + k} times {55 + k} {THINGS[k]}, in other words {(31 + k) * (55 + k)}. Losing {12 + k} leaves fewer {THINGS[k]} in the tannery. The late {70 + k} lift what {NAMES[k]} has.\n#### {k}"


ITEMS = [(k, question(k), solution(k)) for k in range(8)] + [(90, None, None), (91, "Short?", "A"), (92, "Over a stove Rondine hangs 41 old lamps, and 38 more lie by the mill door. Which process would Rondine blame?\nA) warm air rises off what Rondine set out\nB) frost", "A")]
FILL = "The draft compares the gearbox with the tunnel over 27 pages. None of this is new. "


def half(text, lo, hi):
    own = text.split()
    return " ".join(own[int(lo * len(own)) : int(hi * len(own))])


CASES = [
    (FILL + question(0) + FILL, {0}),
    (FILL + question(1).upper(), {1}),
    (question(2).replace(" ", "  ").replace(".", "").replace(",", ""), {2}),
    (question(3).replace("mornings", "mor​nings").replace("a", "а"), {3}),
    (question(4).replace("lamp oil", "lamp\n> oil").replace("Ostrola", "Ost-\nrola"), {4}),
    (question(5).replace("mornings", "morinngs").replace("warden", "wadren"), {5}),
    (FILL + half(question(6), 0, 0.7), {6}),
    (half(question(6), 0, 0.35) + " " + FILL * 3 + half(question(6), 0.6, 1), {6}),
    (half(question(7), 0, 0.4) + FILL, set()),
    (FILL + solution(2), {2}),
    (question(0, name="Vandor", thing="felt hats", step=17), set()),
    (question(0, name="Vandor", thing="felt hats", step=17) + " " + FILL + question(1), {1}),
    ("&lt;b&gt;" + question(2).replace("traded", "<b>traded</b>"), {2}),
    ("Over a stove Rondine hangs 41 old lamps, and 38 more lie by the mill door. Which process would Rondine blame?", {92}),
    ("Rondine set out. A) warm air rises off what Rondine set out B) frost", set()),
    (FILL * 3000 + question(3), {3}),
    ("", set()),
    (None, set()),
    ("...", set()),
    (question(0) + "\n" + question(1) + "\n" + solution(1), {0, 1}),
]


def brute(text, item):
    """Longest-common-subsequence share of the question or solution, in runs of at least four words."""
    best = 0.0
    own = words(text or "")
    for side in (evalleak._OPTIONS.split(item[1] or "")[0], item[2] or ""):
        wanted = words(side)
        if len(wanted) < evalleak.LEAST:
            continue
        covered = set()
        places = {}
        for p in range(len(own) - 3):
            places.setdefault(tuple(own[p : p + 4]), p)
        for q in range(len(wanted) - 3):
            if tuple(wanted[q : q + 4]) in places:
                covered.update(range(q, q + 4))
        best = max(best, len(covered) / len(wanted))
    return best


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], "clash")], "doc_id bigint, text string, item_id string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, question string, solution string")
    want = sorted([(i, k) for i, (_, found) in enumerate(CASES) for k in found] + [(0, 0)])
    assert sorted((r["doc_id"], r["item_id"]) for r in evalleak.leaks(docs, items).collect()) == want
    # the same by a join
    assert sorted((r["doc_id"], r["item_id"]) for r in evalleak.leaks(docs, items, items_most=3).collect()) == want


PLAIN = "it is said that the sum of all the parts is more than the whole of it and so on"


def test_items_of_plain_words_and_short_items(spark):
    """Items whose words all recur in other items, and items of a few words, are found where they are copied; nothing of one letter is."""
    items = [(k, PLAIN, "C") for k in range(4)] + [(10 + k, f"{PLAIN} in case {k} as we see", None) for k in range(6)] + [(50, "Who wrote the old letter?", "B"), (51, "Say it", "word for word as ever"), (None, PLAIN, None)]
    docs = [(1, FILL + PLAIN.upper() + ". " + FILL), (2, "who WROTE the  old *letter*"), (3, "who wrote the new letter"), (4, "C B say it"), (5, "It was word for word, as ever, that it came."), (6, FILL), (7, None), (8, PLAIN[: len(PLAIN) // 3])]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string, solution string")
    found = {(r["doc_id"], r["item_id"]) for r in evalleak.leaks(*frames).collect()}
    assert {(1, k) for k in range(4)} <= found and {(d, i) for d, i in found if d != 1} == {(2, 50), (5, 51)}
    assert {(r["doc_id"], r["item_id"]) for r in evalleak.leaks(*frames, items_most=1).collect()} == found


def test_types_of_words_follow_from_all_items(spark):
    frame = spark.createDataFrame(ITEMS, "item_id bigint, question string, solution string").repartition(5)
    n, spread, names = evalleak.vocabulary(t for r in frame.collect() for t in evalleak.fields(r["question"], r["solution"]))
    assert evalleak.plain_of(frame) == evalleak.plain_words(n, spread.items(), names) != frozenset()


def test_whole_copies_agree_with_brute_force(spark):
    n, spread, names = evalleak.vocabulary(t for _, q, s in ITEMS for t in evalleak.fields(q, s))
    index = evalleak.Index([{"item_id": a, "question": b, "solution": c} for a, b, c in ITEMS], evalleak.plain_words(n, spread.items(), names))
    for text, found in CASES:
        own = {k for k, _ in index.carried([text])[0]}
        assert {i[0] for i in ITEMS if brute(text, i) > 0.9} <= own, text
        assert own == found


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, question(0))], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, question string, solution string")
    assert evalleak.leaks(docs, items.limit(0)).collect() == [] and evalleak.leaks(docs.limit(0), items).collect() == [] == evalleak.leaks(docs.limit(0), items, items_most=0).collect()


def test_words():
    assert words("Wend-\r\n> adine’s  ÁB &amp; <b>x</b> 1,234 ｆｕｌｌ со​оl **bold**") == ["wendadine", "s", "ab", "x", "1234", "full", "cool", "bold"]
