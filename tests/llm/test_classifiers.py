"""Held-out accuracy of the two classifiers, hard rows, and the parts they are made of."""

import zlib

import numpy as np
import pytest

from stratalog.llm import linear, quality, samples, toxicity
from stratalog.llm.common import documents
from stratalog.sources.derived import load

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return load(spark, SF, "labels")


@pytest.fixture(scope="module")
def bad_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (16, 1, 1), (9, None, None), (77, 3, 3)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def rates(rows, label, said):
    rows = [r for r in rows if r.held_out]
    yes, no = [said(r) for r in rows if r[label] == 1], [said(r) for r in rows if r[label] == 0]
    return sum(yes) / len(yes), sum(no) / len(no)


def test_toxicity_on_held_out_rows(spark, labels):
    rows = toxicity.op6_toxicity(spark, SF).join(labels, "doc_id").collect()
    found, wrong = rates(rows, "toxic", lambda r: r.predicted)
    assert found >= 0.7 and wrong <= 0.02  # 33 toxic rows to learn from
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_learns_nothing_from_held_out_labels(spark, labels):
    docs = documents(spark, SF)
    a = toxicity.fit_toxicity(docs, labels)
    b = toxicity.fit_toxicity(docs, labels.selectExpr(
        "doc_id", "quality", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - toxic, toxic) AS toxic"
    ))
    assert a.voters == b.voters and np.allclose(a.weights, b.weights)


def test_quality_on_held_out_rows(spark, labels):
    rows = quality.op9_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    good, poor = rates(rows, "quality", lambda r: r.kept)
    assert good >= 0.98 and poor <= 0.1
    for view in ("content_score", "page_score"):
        kept_good, kept_poor = rates(rows, "quality", lambda r: r[view] >= 0.5)
        assert kept_good >= 0.95 and kept_poor <= 0.2


def test_hard_rows(spark, hard, bad_labels, labels):
    for own in (bad_labels, labels):
        tox = toxicity.scored(hard, toxicity.fit_toxicity(hard, own)).collect()
        good = quality.scored(hard, quality.fit_quality(hard, own)).collect()
        assert len(tox) == len(good) == hard.count()
        assert all(0 <= r.score <= 1 for r in tox + good)


def test_filters_keep_the_columns(spark, hard, labels):
    docs = documents(spark, SF)
    tox, good = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)
    clean = toxicity.drop_toxic(hard, tox)
    assert clean.columns == hard.columns and quality.drop_poor(hard, good).columns == hard.columns
    ids = [r.doc_id for r in clean.collect()]
    assert 16 not in ids and {1, 2, 3, 4, 5}.issubset(ids)
    named = hard.withColumnRenamed("node", "toxicity").withColumnRenamed("bucket", "quality")
    assert toxicity.drop_toxic(named, tox).columns == named.columns
    assert quality.drop_poor(named, good).columns == named.columns


def test_nothing(spark, nothing, labels):
    assert toxicity.scored(nothing, toxicity.fit_toxicity(nothing, labels)).count() == 0
    assert quality.scored(nothing, quality.fit_quality(nothing, labels)).count() == 0


def test_no_labels(spark, hard, labels):
    none = labels.where("doc_id < 0")
    assert quality.drop_poor(hard, quality.fit_quality(hard, none)).count() == hard.count()
    assert toxicity.scored(hard, toxicity.fit_toxicity(hard, none)).count() == hard.count()


def test_a_pattern_alone_votes():
    """Texts with a phrase and no lexicon word."""
    voters = toxicity.Voters(())
    read, base = voters.reader(), voters.features - voters.count
    for text, voter in [("Oh, SHUT UP now", "threat"), ("nobody likes you", "threat"), ("you are a fool, sir", "address")]:
        k = voters.count - len(toxicity.PATTERNS) + list(toxicity.PATTERNS).index(voter)
        votes, features = read(text)
        assert votes == "." * k + "t" + "." * (voters.count - k - 1) and features == [base + k]
    assert read("shutup, you fool") == ("." * voters.count, [])


def test_a_pattern_alone_is_toxic(spark):
    """Half of the toxic rows have only a phrase; the words around it are those of clean rows."""
    rng, rows = np.random.default_rng(5), []
    for k in range(900):
        words = [f"word{n}" for n in rng.integers(0, 50, 20)]
        if k % 3 == 0:
            words.insert(int(rng.integers(0, 20)), "go to hell" if k % 2 else "go to hell, you idiot")
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(docs.drop("toxic"), docs.where("doc_id < 500").select("doc_id", "toxic"))
    ask = [(1, "go to hell"), (2, "word1 word2"), (3, "")]
    score = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(ask, "doc_id bigint, text string"), model).collect()}
    assert score[1] >= toxicity.THRESHOLD and max(score[2], score[3]) < 0.3


# ------------------------------------------------------------------------------------- parts


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.1
    hit = np.array([[0.9, 0.01], [0.8, 0.05], [0.6, 0.02]])
    votes = np.stack([rng.random(len(truth)) < np.where(truth, a, b) for a, b in hit], axis=1)
    votes = np.column_stack([votes, votes[:, 1]])  # the last voter copies the second
    texts = np.array(["".join("t" if v else "." for v in row) for row in votes])
    rows, counts = np.unique(texts, return_counts=True)
    # As the operator does: some rows are known, and weigh as much together as all.
    some = np.arange(600)
    model = toxicity.LabelModel(
        [*rows, *texts[some]],
        np.append(counts, np.full(len(some), len(texts) / len(some))),
        np.append(np.full(len(rows), -1), truth[some].astype(int)),
    )
    assert any({1, 3}.issubset(g) for g in model.groups)
    assert abs(model.prior[1] - 0.1) < 0.03
    assert ((model.posterior(list(texts)) > 0.5) == truth).mean() > 0.97


def test_correlated_voters_are_one_group_however_many():
    """Ten copies of a voter and two of their own: the copies count once."""
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.3
    seen = [rng.random(len(truth)) < np.where(truth, a, b) for a, b in [(0.6, 0.2), (0.8, 0.1), (0.7, 0.1)]]
    texts = ["".join("t" if v else "." for v in row) for row in np.column_stack([seen[0]] * 10 + seen[1:])]
    rows, counts = np.unique(texts, return_counts=True)
    model = toxicity.LabelModel(
        [*rows, *texts[:2000]], np.append(counts, np.full(2000, 10)), np.append(np.full(len(rows), -1), truth[:2000].astype(int))
    )
    assert tuple(range(10)) in model.groups
    exact = (0.3 * 0.6 * 0.2 * 0.3) / (0.3 * 0.6 * 0.2 * 0.3 + 0.7 * 0.2 * 0.9 * 0.9)
    assert abs(model.posterior(["t" * 10 + ".."])[0] - exact) < 0.05


def test_logistic_regression_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    p = linear.sigmoid(x @ [1.5, -2.0, 0.0] + 0.5)
    rows = linear.Rows([(np.arange(3), r) for r in x], 3)
    w = linear.fit_logistic(rows, p, np.ones(400), 0.0, 200)
    assert np.allclose(w, [1.5, -2.0, 0.0, 0.5], atol=1e-2)


def test_platt_turns_margins_into_probabilities():
    rng = np.random.default_rng(4)
    margin = rng.normal(scale=3, size=4000)
    target = (rng.random(4000) < linear.sigmoid(0.5 * margin - 1)).astype(float)
    slope, intercept = linear.platt(margin, target)
    assert abs(slope - 0.5) < 0.1 and abs(intercept + 1) < 0.2


def test_co_training_learns_from_the_other_view():
    """The labels show the page view only one feature of each class; the content view knows the rest."""
    def row(good, page):
        return (np.array([1 if good else 2]), np.ones(1)), (np.array([page]), np.ones(1))

    labelled = [row(True, 10), row(False, 20)] * 20
    target = np.array([1.0, 0.0] * 20)
    pool = [row(k % 2 == 0, 11 if k % 2 == 0 else 21) for k in range(200)]
    alone = quality.co_train(labelled, target, pool, rounds=0)[1]
    taught = quality.co_train(labelled, target, pool, rounds=3, sure=0.6)[1]
    assert abs(alone[11] - alone[21]) < 1e-6 and taught[11] - taught[21] > 1


def test_features_of_empty_and_long_texts():
    for text in ("", " \n", "x" * 100_000, "a b " * 50_000, "\n" * 1000):
        for numbers, values in (quality.content_features(text), quality.page_features(text, None, None)):
            assert len(numbers) == len(values) and np.isfinite(values).all()


def test_samples_are_bounded_and_repeat(spark):
    df = spark.range(20_000).toDF("doc_id")
    some = samples.thinned(df, "doc_id", 1000, 1)
    assert 850 < some.count() < 1150
    assert some.exceptAll(samples.thinned(df.repartition(9), "doc_id", 1000, 1)).count() == 0
    assert samples.thinned(df, "doc_id", 20_000, 1).count() == 20_000
