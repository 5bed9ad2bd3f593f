import numpy as np

from lodestream.llm import reading as R

EASY = ["The team shut that page in time.", "My test hid the red light.", "We lost the key again.", "The box sent a note."]
HARD = ["Notwithstanding considerable remediation effort, probabilistic extrapolation disclosed statistically significant covariance.", "The jurisdictional classification of intermediated shareholdings invalidated the assumptions underlying apportionment.", "It is nevertheless conceivable that orchestration responsibilities necessitate consolidated reinterpretation."]


def test_only_running_text_is_read():
    text = "# Title here now\n\n```\ncode(here, and, there)\n```\n\nOne short sentence stands here. Another one follows it!\n\n- a list item here\n* another item there\n\nSee https://x.example/a b c d.\n\n> a quoted line of text here."
    assert R.sentences(text) == ["One short sentence stands here.", "Another one follows it!", "See b c d.", "a quoted line of text here."]
    assert R.sentences("") == [] and R.sentences("🙂") == [] and R.sentences("```\nx\n```\n\nAfter code comes text.") == ["After code comes text."]
    assert len(R.sentences("word " * 1000)) == 25


def test_features_do_not_cross_texts():
    codes, starts = R._flat(["ab cd", "cd"])
    rows, cols = R.word_features(codes, starts)
    words = {(r, c) for r, c in zip(rows, cols)}
    assert len([1 for r, _ in words if r == 0]) == 3 and len([1 for r, _ in words if r == 1]) == 1
    assert {c for r, c in words if r == 1} < {c for r, c in words if r == 0}


def tables(spark):
    rng = np.random.RandomState(0)
    docs, labels = [], []
    for k in range(80):
        hard = k % 2
        docs.append((k, " ".join(rng.choice(HARD if hard else EASY, 6)), "en"))
        if k < 40:
            labels.append((k, 4 if hard else 1, "r"))
    docs += [(100, None, "en"), (101, "", "en"), (102, "x" * 200_000, "en"), (103, EASY[0], "de"), (None, HARD[0], "en"), (104, HARD[0] + " " + HARD[1], None)]
    labels += [(0, 2, "s"), (None, 4, "r"), (1, None, "r"), (999, 4, "r")]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, lang string, band string")
    return d, spark.createDataFrame(labels, "doc_id long, band int, rater string")


def test_held_out_documents_are_told_apart(spark):
    d, labels = tables(spark)
    got = {r["doc_id"]: r for r in R.reading_levels(d, labels).collect()}
    assert all((got[k]["band"] == 4) == bool(k % 2) for k in range(40, 80))
    assert got[100]["band"] is None and got[101]["n_sentences"] == 0 and got[102]["band"] is None and 103 not in got and 104 not in got


def test_without_labels_or_documents(spark):
    d, labels = tables(spark)
    assert R.reading_levels(d, labels.where("false")).where("band IS NOT NULL").count() == 0
    assert R.reading_levels(d.where("false"), labels).count() == 0
