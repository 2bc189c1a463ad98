import numpy as np
import pytest

from glyphmill.functions.vectorised import BoundedHeap, Functions, Predictor
from glyphmill.operators import features as X
from glyphmill.operators import scoring as S
from glyphmill.plans import models
from glyphmill.sources.errors import EmptyInputError, InvalidModelError
from glyphmill.sources.frames import to_frames
from glyphmill.sources.model_file import Matrix, Model, huffman, parse

TEXTS = ["", "   ", "the cat sat", "le chat noir </s>", "__label__fr le", "__label__zz x", "a" * 300, "中文 字 😀 é", "the the the\nthe\tcat", "der hund und die katze", None]


def corpus(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("the dog", "en"), ("le chat noir", "fr"), ("der hund und die katze", "de"), ("el gato", "es"), ("the end of the the", "en")])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("options", [{}, {"minn": 2, "maxn": 4}, {"minn": 1, "maxn": 2, "prune_size": 1}, {"minn": 3, "maxn": 3, "prune_size": 0}, {"word_ngrams": 3}, {"loss": 1}, {"loss": 1, "minn": 2, "maxn": 3, "word_ngrams": 2}])
def test_relational_and_local_paths_agree(spark, options):
    model = models.formula_model(corpus(spark), **options)
    frames, local = to_frames(spark, model), Predictor(model)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids: dict[int, dict[int, int]] = {}
    for r in X.features(df, frames).collect():
        ids.setdefault(r.doc_id, {})[r.row_id] = r.cnt
    vectors = {r.doc_id: r.vector for r in S.sentence_vectors(df, frames).collect()}
    top = {r.doc_id: r for r in S.predict(df, frames, k=10).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert top[i].predictions is None and top[i].status is None and i not in ids
            continue
        line = local.line(t)
        assert ids[i] == {r: line.count(r) for r in set(line)}
        assert np.allclose(vectors[i], local.vector(t), atol=1e-5)
        got, want = top[i].predictions, local.predict(t, 10)
        assert np.allclose([p.probability for p in got], [p for _, p in want], rtol=1e-4, atol=1e-6)
        assert {p.label for p in got} == {a for a, _ in want} and top[i].status == "OK"


def test_heap_order_of_ties():
    def ranked(scores, k):
        h = BoundedHeap(k)
        for i, s in enumerate(scores):
            h.offer(s, i)
        return [i for _, i in h.ranked()]

    assert [ranked([1.0] * 4, k) for k in (1, 2, 3, 4, 9)] == [[3], [3, 1], [3, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3]]
    assert ranked([2.0, 1.0, 1.0, 1.0], 2) == [0, 3]


def test_limits_and_thresholds(spark):
    for loss in (1, 2, 3):
        model = models.formula_model(corpus(spark), loss=loss)
        frames, local = to_frames(spark, model), Predictor(model)
        df = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
        for k, t in ((0, 0.0), (500, 0.0), (3, 0.2), (3, 0.999), (3, 1.0), (2, -1.0)):
            got = S.predict(df, frames, k=k, threshold=t).first().predictions
            want = local.predict("the cat", k, t)
            assert [p.label for p in got] == [a for a, _ in want]
            assert len(got) <= len(model.labels) and [p.probability for p in got] == sorted((p.probability for p in got), reverse=True)


def test_equal_scores_rank_by_falling_label_id(spark):
    model = models.formula_model(corpus(spark))
    rng = np.random.default_rng(5)
    inputs, outputs = (model.input.values * 64).astype(np.int64), (model.output.values * 16).astype(np.int64)
    texts, want = [], []
    for n in range(2, 12):
        words = rng.integers(1, model.nwords, (20_000, n))
        exact = (inputs[words].sum(1) + inputs[0]) @ outputs.T
        for i in np.flatnonzero((np.diff(np.sort(exact)) == 0).any(1)):
            texts.append(" ".join(model.words[w] for w in words[i]))
            want.append([model.labels[k] for k in sorted(range(exact.shape[1]), key=lambda k: (-exact[i, k], -k))])
    assert len(texts) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for head in (True, False):
        frames = to_frames(spark, model)
        frames.head = frames.head if head else None
        got = sorted((r.doc_id, r["rank"], r.label) for r in S.predict_rows(df, frames, 9).collect())
        assert got == [(i, k + 1, label) for i, labels in enumerate(want) for k, label in enumerate(labels)]


def test_empty_input(spark):
    base = models.formula_model(corpus(spark))
    model = Model(base.args, ["word", "__label__a"], np.array([1, 1]), np.array([0, 1], np.int8), 1, 1, -1, {}, Matrix(1, 8, base.input.values[:1]), Matrix(1, 8, base.output.values[:1]), None)
    df = spark.createDataFrame([(1, "unknown"), (2, "word"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in S.predict(df, to_frames(spark, model)).collect()}
    assert (rows[1].predictions, rows[1].status, rows[2].status, rows[3].predictions) == ([], "EMPTY_INPUT", "OK", None)
    with pytest.raises(EmptyInputError):
        Predictor(model).predict("unknown")
    with pytest.raises(Exception, match="EMPTY_INPUT"):
        S.predict(df, to_frames(spark, model), on_empty="fail").collect()


def test_unsupervised_models_have_no_labels(spark):
    base = models.formula_model(corpus(spark))
    for kind in (1, 2):
        base.args["model_type"] = kind
        df = spark.createDataFrame([(1, "the cat")], "doc_id long, text string")
        frames = to_frames(spark, base)
        for call in (lambda: S.predict(df, frames), lambda: S.predict_rows(df, frames), lambda: Predictor(base).predict("the cat")):
            with pytest.raises(InvalidModelError):
                call()
        assert np.allclose(S.sentence_vectors(df, frames).first().vector, Predictor(base).vector("the cat"))


def test_large_models_without_a_broadcast_head(spark):
    df = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    for options in ({}, {"loss": 1}, {"minn": 2, "maxn": 3, "word_ngrams": 2}):
        frames = to_frames(spark, models.formula_model(corpus(spark), labels=9, **options))
        want = {r.doc_id: r for r in S.predict(df, frames, k=4).collect()}
        frames.head, frames.input_bytes, frames.dictionary_bytes = None, 0, 0
        got = {r.doc_id: r for r in S.predict(df, frames, k=4).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r.status == want[i].status and [p.label for p in r.predictions or []] == [p.label for p in want[i].predictions or []]


def test_files_of_formula_models_and_batches(spark):
    for options in ({"quantised": True}, {"minn": 2, "maxn": 3, "prune_size": 1, "quantised": True}, {"word_ngrams": 4, "loss": 1}):
        model = models.formula_model(corpus(spark), labels=20, **options)
        again = parse(models.file_bytes(model))
        assert again.words == model.words and again.args == model.args and again.tree == model.tree and again.prune == model.prune and np.array_equal(again.input.values, model.input.values)
        local = Predictor(again)
        texts = [t for t in TEXTS if t is not None] * 3
        for text, many in zip(texts, local.predict_many(texts, 5), strict=True):
            ids = local.line(text)
            assert np.allclose(local.vector(text), model.input.values[ids].mean(0), atol=1e-5)
            assert np.allclose([p for _, p in many], [p for _, p in Predictor(again).predict(text, 5)], rtol=1e-4)


def test_one_label_tree(spark):
    base = models.formula_model(corpus(spark).where("lang = 'en'"), loss=1)
    assert len(base.labels) == 1 and base.tree == huffman([3])
    assert Predictor(base).predict("the", 3) == [("__label__en", 1.0)]
    df = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert S.predict(df, to_frames(spark, base)).first().predictions[0].probability == 1.0


def test_sql_functions_and_table_function(spark):
    model = models.formula_model(corpus(spark))
    Functions(spark, model).register("t_")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").createOrReplaceTempView("texts")
    local = Predictor(model)
    for r in spark.sql("SELECT text, t_predict_labels(text, 2, 0.0D) AS p, t_sentence_vector(text) AS v, t_token_ids(text) AS i FROM texts").collect():
        if r.text is None:
            assert r.p is None and r.v is None and r.i is None
        else:
            assert [x.label for x in r.p] == [a for a, _ in local.predict(r.text, 2)] and r.i == local.line(r.text) and np.allclose(r.v, local.vector(r.text))
    rows = spark.sql("SELECT doc_id, p.* FROM texts, LATERAL t_predict_table(text, 2, 0.0D) AS p").collect()
    assert len(rows) == 2 * (len(TEXTS) - 1)
