import random

import pytest

from linkspark.llm import toxicity as T

GOOD = ["The committee moved item {} to page {}.", "Tickets to {} cost {} crowns.", "Thank you, {}, the soup was wonderful.", "この冬も{}の家が暖かいといいですね。"]
BAD = ["You are a complete idiot, {}, and everybody knows it.", "I hope your house burns tonight, {}.", "{}は全員害虫だ、叩き出せ。"]
NAMES = ["Ilmaro", "Fujimi", "Jessop", "Kuroda"]


def document(rnd, bad):
    parts = [rnd.choice(GOOD).format(rnd.choice(NAMES), rnd.randint(1, 99)) for _ in range(3)]
    if bad:
        parts[rnd.randrange(3)] = rnd.choice(BAD).format(rnd.choice(NAMES))
    return " ".join(parts)


@pytest.mark.parametrize(
    ("a", "b"),
    [("You іdіоt!", "You idiot!"), ("p​ig", "pig"), ("f u c k you", "fuck you"), ("f-u-c-k", "fuck"), ("wh0r3", "whore"), ("pornnno", "porno"), ("ＡＢ", "AB"), ("売女女女女だ", "売女だ"), ("lot X52451", "lot X52451")],
)
def test_disguises(a, b):
    assert T.plain_text(a) == b


def test_tokens():
    assert T.tokens("You s**t, 害虫だ 12.5 x") == ["you", "*", "害", "虫", "だ", "9", "x"]
    assert T.sentences(None) == [] and T.sentences("") == [] and T.sentences(" . ") == []
    assert len(T.sentences("word " * 10_000)) > 300


def test_held_out_accuracy_with_wrong_labels(spark):
    rnd = random.Random(7)
    truth = [(i, rnd.random() < 0.3) for i in range(600)]
    docs = [(i, document(rnd, bad), "en", f"s{i % 3}") for i, bad in truth]
    labels = [(i, int(bad) if rnd.random() > 0.05 else int(not bad), "a") for i, bad in truth[:300]] + [(0, None, "b"), (None, 1, "b"), (9999, 1, "b")]
    edges = [(1000, None, "en", "s0"), (1001, "", "en", None), (1002, "   ", "en", "s0"), (1003, "word " * 20_000, "en", "s0")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs + edges], "doc_id bigint, text string, lang string, source string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int, annotator string")
    got = {r.doc_id: r for r in T.score(df, lab).collect()}
    assert len(got) == len(docs) + len(edges)
    wrong = [i for i, bad in truth[300:] if got[i].unwanted != bad]
    assert len(wrong) <= 6
    assert got[1000].score is None and got[1001].score is None and not any(got[i].unwanted for i in (1000, 1001, 1002, 1003))
    rates = {r.source: r for r in T.rates(T.score(df, lab)).collect()}
    assert sum(r.n_documents for r in rates.values()) == len(docs) + len(edges) and None in rates
    assert not any(r.unwanted for r in T.score(df, lab.limit(0)).collect())
    assert T.score(df.limit(0), lab).count() == 0


def test_new_expressions_decide_nothing():
    m = T.ClassModels([(("a", "b", "c"), 0, 5.0), (("d", "e", "f"), 1, 5.0)])
    assert m.gain(("d", "e", "f")) > 0 > m.gain(("a", "b", "c"))
    assert abs(m.gain(("x", "y", "z"))) < 0.1


def test_models_are_normalised():
    rnd = random.Random(9)
    words = ["a", "b", "c", "d", "e"]
    m = T.ClassModels([(tuple(rnd.choice(words) for _ in range(rnd.randint(1, 5))), rnd.randint(0, 1), float(rnd.randint(1, 3))) for _ in range(60)] + [(("f",), 1, 1.0)])
    known = [*words, "f", "</s>"]
    assert set(m.contexts) == set(known)
    for history in [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("f", "f"), ("x", "a"), ("x", "y")]:
        for c in (0, 1):
            total = sum(m.probabilities(history, w)[c] for w in [*known, "unknown"])
            assert abs(total - 1) < 1e-9, (history, c, total)


def test_middle_orders_count_contexts():
    # "san francisco" is frequent but stands in one context; "the cat" in two
    m = T.ClassModels([(("in", "san", "francisco"), 0, 9.0), (("on", "the", "cat"), 0, 1.0), (("at", "the", "cat"), 0, 1.0), (("x",), 1, 1.0)])
    assert m.grams[2][("san", "francisco")][0] == 1 and m.grams[2][("the", "cat")][0] == 2 and m.grams[3][("in", "san", "francisco")][0] == 9
    assert m.grams[2][("<s>", "in")][0] == 9


def test_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "en") for i in range(50)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    assert T.labelled_sample(docs, labels, 20).count() == 20 and T.labelled_sample(docs, labels, 20, 75).count() == 7
    assert {len(r.text) for r in T.labelled_sample(docs, labels, 20, 75).collect()} == {10}
