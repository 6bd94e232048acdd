from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators.corrections import capture_from_dialogue, search_corrections


def reference_search(questions, corrections):
    """The reference rule, restated in plain Python for the test."""
    hits = set()
    for qid, text in questions:
        words = {w for w in text.lower().split() if len(w) > 2}
        for c in corrections:
            s = " ".join([c[3], c[4], c[2]]).lower()
            if any(w in s for w in words):
                hits.add((qid, c[0]))
    return hits


COR_SCHEMA = "correction_id string, session_id string, target_id string, original string, corrected string"


def run(spark, questions, corrections):
    q = spark.createDataFrame(questions, "question_id long, text string")
    c = spark.createDataFrame(corrections, COR_SCHEMA)
    return {(r.question_id, r.correction_id) for r in search_corrections(q, c).collect()}


def test_search_examples(spark):
    questions = [(1, "What does OrderService depend on?"), (2, "is it ok"), (3, "the")]
    corrections = [("c1", "s", "node:x", "orderservice calls repo", "it injects the repo"),
                   ("c2", "s", "OrderController", "foo", "bar"),
                   ("c3", "s", "t", "", "")]
    got = run(spark, questions, corrections)
    assert got == reference_search(questions, corrections)
    assert (1, "c1") in got and (3, "c1") in got and (2, "c1") not in got


words = st.text(alphabet="abcé ", min_size=0, max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(words, min_size=1, max_size=4), st.lists(st.tuples(words, words), min_size=1, max_size=4))
def test_search_equals_reference_rule(spark, qs, cs):
    questions = [(i, t) for i, t in enumerate(qs)]
    corrections = [(f"c{i}", "s", f"t{i}", a, b) for i, (a, b) in enumerate(cs)]
    assert run(spark, questions, corrections) == reference_search(questions, corrections)


def test_capture_from_dialogue(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "A says x"), (1, 2, "user", "no, y"),
         (1, 3, "user", "and z"), (2, 0, "assistant", "hi"), (2, 1, "system", "s")],
        "conv_id long, turn long, role string, text string")
    got = [(r.correction_id, r.original, r.corrected, r.target_id)
           for r in capture_from_dialogue(turns).collect()]
    assert got == [("1-2", "A says x", "no, y", "conv:1")]


def test_search_words_longer_than_their_trigrams(spark):
    """The same cases as before the search was rewritten; texts are no longer cut into segments."""
    questions = [(1, "abcdefghijkl"), (2, "xyz qrs"), (3, "mnopqrstuvwxyz0123 nothere")]
    corrections = [("c1", "s", "t", "zzzz abcdefghijkl zzz", ""),
                   ("c2", "s", "t", "....mnopqrstuvwxyz0123", "qrs")]
    assert run(spark, questions, corrections) == reference_search(questions, corrections)
