import pytest

pytest.importorskip("tallyforge.llm")
from tallyforge.llm import truncation
from tallyforge.llm.closing import CUT, DONE, ELL, KEY, WORD, closing_state


@pytest.mark.parametrize(
    "text, state",
    [
        (None, DONE), ("", DONE), (" \n​", DONE), ("All is well.", DONE), ("Is it?", DONE), ("最后要记住。", DONE),
        ("We go thr [cut]", CUT), ("the slo...[+83 chars]", CUT), ("the end [truncated]", CUT), ("quedan 462 �", CUT), ("the first,", CUT), ("leaves 7 -", CUT), ("hay 7 ×", CUT), ("hay 336 −", CUT),
        ("a list\n1. one\n2.", CUT), ("yields $12^{", CUT), ("\n\n$$\\boxed{", CUT), ("x.\n$$\\boxed{4}$", CUT), ("x.\n$$\\boxed{4}$$", DONE), ("ok.\n\\boxed{\\frac{1}{2}}", DONE),
        ("so it is.\n#### $\\boxed{44}$", DONE), ("n.\n#### 98\n```", DONE), ("it is so.\n**84**", DONE), ("over 12 days that is 12 *", CUT), ("kept.\n####", DONE), ("kept.\n##", CUT),
        ("D", DONE), ("B)", DONE), ("The answer is C", DONE), ("(D) a dormant volcano", WORD), ("x.\n- the tunnel\n- the gearbox", WORD), ("Let us sta…", ELL), ("...", DONE),
        ("gives 60. No other quantity in the", KEY), ("see.\n#### see above", KEY), ("= 1323.\n#### 13", CUT), ("= 1323.\n#### 1323", KEY), ("最后要记住，一切都", CUT), ("null", DONE), ("Which is best? A)  the food  web B)  a  dilute  acid", WORD), ("so, it is (b) and more", KEY), ("How many?**\n\nAnswer:", DONE),
        ('"How many?"', DONE), ("[]", DONE), ("-", DONE),
    ],
)
def test_states(text, state):
    assert closing_state(text)[0] == state


FULL = "First we write down the known amounts. After that the workshop finishes {} tiles a day. Over {} days that comes to {} tiles in all. The units agree on both sides of the equation."


def fixture():
    rows = [("t", i, f"run-{i % 3}", FULL.format(i, i + 1, i * (i + 1))) for i in range(60)]
    rows += [("t", 100 + i, "run-1", "It is done.\n#### see above") for i in range(8)]
    rows += [("t", 200, "run-0", FULL.format(3, 4, 12)[:-9]), ("t", 201, "run-0", FULL.format(7, 8, 56)[:60]), ("t", 202, None, FULL.format(9, 10, 90)[:75] + " [cut]")]
    rows += [("t", 300, "run-0", None), ("t", 301, "run-0", "  \n"), ("t", 302, "run-0", FULL.format(3, 4, 12)[:-9]), ("g", 200, "run-9", "word " * 40_000 + "end.")]
    return rows, {("t", 200), ("t", 201), ("t", 202), ("t", 302)}


def test_cut_texts_are_found(spark):
    rows, cut = fixture()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "table_name string, row_id bigint, run_id string, text string, truncated string").repartition(5)
    found = truncation.truncated(df).collect()
    assert len(found) == len(rows)
    assert {(r["table_name"], r["row_id"]) for r in found if r["truncated"]} == cut
    by = {(r["table_name"], r["row_id"]): r["reason"] for r in found}
    assert by["t", 200] == by["t", 302] == "near_copy" and by["t", 202] == "mark"
    shares = {(r["table_name"], r["run_id"]): r for r in truncation.shares(truncation.truncated(df)).collect()}
    assert shares["t", None]["share"] == 1.0 and shares["g", "run-9"]["n_truncated"] == 0


def test_empty_table(spark):
    assert truncation.truncated(spark.createDataFrame([], "table_name string, row_id bigint, run_id string, text string")).collect() == []


def verdicts(spark, texts):
    df = spark.createDataFrame([("t", i, "r", x) for i, x in enumerate(texts)], "table_name string, row_id bigint, run_id string, text string")
    return {r["row_id"]: r["truncated"] for r in truncation.truncated(df.repartition(3)).collect()}


def test_copies_make_no_formula_of_their_ending(spark):
    """A hot group of one cut text, at a fragment or at a whole word, and a template cut at one length stay cut."""
    whole = [FULL.format(i, i + 1, i * (i + 1)) + f" Then they take {i} tables away.\n#### see above" for i in range(40)]
    hot = ["Our first remark of the day is about a small boat on the northern canal, whose mast"] * 30
    piece = ["Our next remark of the day is about a large barge on the northern canal, whose cap"] * 30
    template = [f"A record of {i} about the quantity that was read off the gauge in the morning shows {i}: ta" for i in range(30)]
    texts = whole + hot + piece + template
    assert [i for i, cut in verdicts(spark, texts).items() if cut] and {i for i, cut in verdicts(spark, texts).items() if cut} == set(range(40, len(texts)))


def test_closing_keys_within_texts():
    def n(key, *texts):
        return truncation._following(list(texts), [(key, *truncation._key_pattern(key))])[key]

    assert n("start , th", "at the start, that is 9.", "start, th and") == 2 and not n("start , th", "start, th.")
    assert n("0 , so", "It is 12, so we go. It is 1,200 , so. Also, so it is.") == 1 and n("0 away from", "Take 5 away from 7. x5 away from 8.") == 1
    assert n("#### $ 0", "#### $12 is it.\n#### $ 7\n", "#### $3") == 1 and n("0 . <C>", "So 5. Then we", "It is 5. İt is 6.", "5. Then") == 1
    assert n(". \\n <C>", "So.\nThen we go.\n\nAnd", "So. \nThen,") == 2


def test_a_settled_key_costs_no_other_key_its_count():
    batch = truncation.pa.RecordBatch.from_pydict({"text": ["One, as it is so. Two, but we do so. It ends."]})
    keys = {"as it is": 1, "but we do": 5}
    out = [r for b in truncation._counted(keys, frozenset())(iter([batch])) for r in b.to_pylist()]
    assert {r["item"]: r["n"] for r in out if r["item"][0] == "k"} == {"kas it is": 1, "kbut we do": 1}


LEAD = "First we write down all of the known amounts that the workshop has on the list and then we add them up one by one until the total is"


def test_whole_looking_ends_that_a_full_copy_carries_on(spark):
    """After bold text, a bracket, a decimal point, an abbreviation or an ellipsis; but not where a sentence is over."""
    ends = [("\n**84 tiles**", " a day."), (" (see the list.", ") for it."), (" 3.", "5 tiles."), (" due to Dr.", " Vale."), (" for the app...", None), (" 🙂", " for all of us.")]
    cut = [LEAD.replace("First", f"Word{i}") + a for i, (a, _) in enumerate(ends) if i != 1]
    full = [LEAD.replace("First", f"Word{i}") + (a + b if b else " for the apples here.") for i, (a, b) in enumerate(ends) if i != 1]
    over = [(" 84.", " It fits."), (" \"so many.\"", " It fits."), (" (as it was.)", " It fits."), ("\n####", " 84")]
    done = [LEAD.replace("First", f"Item{i}") + a for i, (a, _) in enumerate(over)]
    done += [LEAD.replace("First", f"Item{i}") + a + b for i, (a, b) in enumerate(over[:3])]
    texts = cut + done + full
    found = verdicts(spark, texts)
    assert {i for i in range(len(cut) + len(done)) if found[i]} == set(range(len(cut)))


def test_signatures_of_one_letter_are_whole_though_copied(spark):
    """A few signed texts, each copied often, are no cut beside many other endings."""
    names = ["Quill", "Ruvo", "Pavi", "Wim", "Sella", "Lunet", "Fenja", "Oswin", "Marit", "Jasko", "Niamo", "Ilvo"]
    signed = [f"I'm sorry, but I can't come on Friday. Thank you for thinking of me. {n}" for n in names] * 400
    other = [FULL.format(i, i + 1, i * (i + 1)) + f" So we are done, says {names[i % 12]} again.\n#### {i}" for i in range(20_000)]
    found = verdicts(spark, signed + other)
    assert not any(found[i] for i in range(len(signed)))
