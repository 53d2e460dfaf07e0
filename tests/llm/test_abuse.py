"""The classifier: disguises, calibration, held-out accuracy, odd inputs."""

import numpy as np

from marlstone.llm import abuse
from marlstone.llm.boosting import BoostedTrees, Isotonic
from marlstone.llm.queries import QUERIES


def test_disguises_are_undone():
    shown, n = abuse.undisguise("You usеless m o r o n, you t1tan of imbeeeeecile par451t3s, you s__m \u200bx")
    assert "useless moron" in shown and "imbecile" in shown and "parasites" in shown and "smaskm" in shown
    assert n["script"] == 1 and n["spaced"] == 1 and n["repeat"] == 1 and n["leet"] == 2 and n["masked"] == 1 and n["hidden"] == 1
    assert abuse.undisguise("Утверждение спорно, ticket V967")[0] == "Утверждение спорно, ticket V967"


def words_of(p, i):
    return [p.words[k] for k in p.ids[p.start[i]: p.start[i] + p.size[i]]]


def test_passages():
    p = abuse.Passages(["One two. THREE four!\nfive", None, "", "12 34", 'He said "no"; Ünï done'])
    assert [words_of(p, i) for i in range(len(p.size))] == [["one", "two"], ["three", "four"], ["five"], ["he", "said", "no"], ["ünï", "done"]]
    assert p.owner.tolist() == [0, 0, 0, 4, 4] and p.up.tolist() == [1, 5, 0, 1, 1] and p.bang.tolist() == [0, 1, 0, 0, 0] and p.quote.tolist() == [0, 0, 0, 2, 0]
    assert p.letters.tolist() == [6, 9, 4, 8, 7]


def test_long_passages_are_read_whole():
    words = " ".join(f"w{'x' * (i % 7)}" for i in range(1000))
    p = abuse.Passages([words + " you idiot"])
    assert any("idiot" in words_of(p, i) for i in range(len(p.size))) and p.size.sum() >= 1002 and p.size.max() == abuse.WINDOW


def test_the_cut_comes_from_the_fit():
    scores = np.array([0.9, 0.8, 0.7, 0.3, 0.2, 0.1])
    assert abuse.choose_cut(scores, np.array([1.0, 1, 1, 0, 0, 0])) == 0.5
    assert abuse.choose_cut(scores, np.array([1.0, 1, 0, 1, 0, 0])) == 0.75  # a harmless one weighs more
    assert abuse.choose_cut(scores, np.zeros(6)) == abuse.choose_cut(np.array([]), np.array([])) == abuse.THRESHOLD
    q = abuse.rater_errors(np.array([1.0, 1, 1, 0, 0, 0, 0, 0, 0.5]), np.array([2.0, 2, 2, 2, 2, 2, 2, 2, 2]))
    assert (q[:3] > 0.9).all() and (q[3:8] < 0.1).all() and q[7] < q[8] < q[0]


def test_isotonic_is_monotone_and_means_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float)
    f = Isotonic().fit(x, y, np.ones(500))
    out = f(np.sort(x))
    assert (np.diff(out) >= -1e-12).all() and abs(out.mean() - y.mean()) < 0.05


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(rounds=60).fit(x[:1500], y[:1500], np.ones(1500))
    assert (((model.margin(x[1500:]) > 0) == (y[1500:] > 0.5)).mean()) > 0.95


def sample(n):
    calm = ["The ledger supports the claim of the chapter.", "The moderator removed a comment that called them a filthy pig.", "The stuck valve was fixed."]
    foul = ["You are a worthless pig and should be beaten.", "Shut your mouth, you filthy moron.", "Go and hang yourself, you pathetic worm."]
    texts, y = [], []
    for i in range(n):
        bad = i % 4 == 0
        texts.append(" ".join([calm[i % 2], calm[2], foul[i % 3] if bad else calm[i % 3], f"Section {i} ends."]))
        y.append(float(bad))
    return texts, y


def test_held_out_accuracy():
    texts, y = sample(400)
    flip = [1 - v if i % 23 == 0 else v for i, v in enumerate(y)]  # raters err
    model = abuse.fit(texts[:300], flip[:300], [1] * 300)
    found = model.score(texts[300:]) >= model.cut
    assert (found == (np.array(y[300:]) > 0.5)).mean() >= 0.98


def test_odd_texts_score(spark):
    texts, y = sample(120)
    model = abuse.fit(texts, y, [1] * 120)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a" * 100_000), (5, "x " * 20_000), (6, texts[0])]
    out = {r["doc_id"]: r["score"] for r in abuse.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[1] == out[2] == out[3] == 0.0 and len(out) == 6 and all(0 <= v <= 1 for v in out.values())


def test_no_labels_and_empty_tables(spark):
    model = abuse.fit([], [], [])
    docs = spark.createDataFrame([(1, "You idiot.", "s")], "doc_id long, text string, source string")
    assert abuse.score_documents(docs, model).count() == 1
    none = spark.createDataFrame([], "doc_id long, rater string, label string")
    assert abuse.labelled(docs, none).count() == 0
    assert abuse.source_rates(abuse.score_documents(docs, model, ("source",)), model.cut).first()["n_docs"] == 1


def test_labels_are_counted_once_and_nulls_not(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "r1", "none"), (1, "r1", "none"), (1, "r2", " Abusive"), (2, "r1", None), (3, "r1", "none"), (9, "r1", "none")], "doc_id long, rater string, label string")
    assert [tuple(r) for r in abuse.labelled(docs, labels).collect()] == [(1, "a", 0.5, 2)]


def test_p10_on_the_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scores = QUERIES["p10_scores"](spark, data)
    assert scores.count() == docs.count()
    rates = QUERIES["p10_rates"](spark, data).collect()
    assert sum(r["n_docs"] for r in rates) == docs.count()
