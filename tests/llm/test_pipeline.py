import pyarrow as pa
import pytest

import corpus_pipeline
from glyphmill.llm import quality, secrets
from tests.llm.test_texts import brute_components, prose

rng = __import__("random").Random(4)
CLEAN = [(i, " ".join(prose(rng, 120, 9000))) for i in range(12)]


def test_stages(spark, tmp_path):
    item = " ".join(prose(rng, 30, 9000))
    rows = CLEAN + [(20, CLEAN[3][1]), (21, CLEAN[4][1] + " tail"), (22, "too short"), (23, None), (24, CLEAN[5][1][:300] + " " + item + " " + " ".join(prose(rng, 80, 9000))), (25, " ".join(prose(rng, 90)) + ' password = "hunter2hunter2"'), (25, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, _ in CLEAN}
    assert set(texts["quality_rules"]) == clean | {20, 21, 24, 25}
    groups = brute_components(list(texts["quality_rules"].items()))
    assert set(texts["near_duplicates"]) == {i for i, (_, root) in groups.items() if i == root} == clean | {24, 25}
    assert set(texts["decontamination"]) == set(texts["secret_scans"]) == clean | {25}
    assert texts["secret_scans"][25].endswith(" [SECRET]\"") and all(texts["secret_scans"][i] == t for i, t in CLEAN)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == clean | {25} and all(r.n_tokens > 2 for r in out.values())


CLASHING = ["kept", "_row", "spans", "_drop", "_near", "_id", "_text", "_hash", "_found", "_count", "failed_bits", "_new", "id", "component_id", "_salt"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_tables_and_extra_columns(spark, stage, tmp_path):
    spark.createDataFrame([(1, "a passage of the benchmark that is long enough to be sought")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    rows = [(i, t, "en", None, 5, *range(len(CLASHING))) for i, t in [(1, CLEAN[0][1]), (2, CLEAN[1][1]), (2, CLEAN[1][1]), (3, None), (4, ""), (None, CLEAN[2][1])]]
    df = spark.createDataFrame(rows, schema)
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    got = stage(spark, df, str(tmp_path))
    n = {"quality_rules": 4, "near_duplicates": 5}.get(stage.__name__, 6)
    assert got.count() == n
    if stage is not corpus_pipeline.sentencepiece:
        assert got.columns == df.columns and {tuple(r)[5:] for r in got.collect()} == {tuple(range(len(CLASHING)))}


def test_of_rows_that_repeat_an_id_and_a_text_a_fixed_one_stays(spark):
    rows = [(5, CLEAN[0][1], n) for n in range(20)] + [(5, CLEAN[1][1], n) for n in range(20)]
    first = None
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(parts)
        got = sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
        assert len(got) == 2 and got == (first or got)
        first = got


def test_nothing_is_lost_without_an_id(spark, tmp_path):
    df = spark.createDataFrame([(None, CLEAN[0][1], 5), (None, CLEAN[0][1], 6), (3, CLEAN[1][1], 7), (3, CLEAN[1][1], 7)], "doc_id long, text string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 3


def test_near_copies_from_eighty_percent_on(spark):
    base = prose(rng, 150, 9000)
    texts = [base, [f"x{i}" if i in (30, 70, 110) else w for i, w in enumerate(base)], [f"y{i}" if i in (20, 50, 80, 110) else w for i, w in enumerate(base)]]
    sets = [{tuple(t[j : j + 5]) for j in range(146)} for t in texts]
    like = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.80 <= like[1] < 0.85 and like[2] < 0.80
    df = spark.createDataFrame([(i, " ".join(t), 5) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {0, 2}


def test_texts_of_one_id_and_items_without_one(spark, tmp_path):
    a, b, c, item = CLEAN[0][1], CLEAN[1][1], CLEAN[2][1], " ".join(prose(rng, 30, 9000))
    rows = [(3, a, 1), (3, b, 1), (3, b, 1), (3, b + " tail", 1), (2, a, 1), (7, c, 1), (8, c + " " + item, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert [r for r in got if r[0] == 2] == [(2, a)] and [r[0] for r in got] == [2, 3, 7, 8] and got[1][1] in (b, b + " tail")
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()} == {2, 3, 7}


def test_what_a_base_span_leaves_of_a_candidate(spark):
    key = "aGk3Lq9ZpT2vXb7NsR4wYc8MdF6hJ1kQ5uW0eBzP"
    rows = {1: f"see AKIA{'A1B2' * 4}/{key} end", 2: f"see {'0123456789abcdef' * 2}-{key}", 3: f"x {key}/AKIA{'A1B2' * 4}/{key} y", 4: f"AKIA{'A1B2' * 4}/short", 5: f"only {key}", 6: "nothing"}
    df = spark.createDataFrame([(i, t, 5) for i, t in rows.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_scans(spark, df, "").collect()}
    assert not any(key in t for t in got.values()) and got[4] == "[SECRET]/short" and got[6] == "nothing" and got[5] == "only [SECRET]"
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(df).collect()}
    assert [k for _, k, _ in spans[3]] == [3, 1, 3] and spans[1][0] == (4, 1, 24) and spans[1][1][1:] == (3, 4 + 20 + 1 + 40)


def test_marks():
    assert quality.PRODUCTION.mask & quality.BASE.mask == quality.BASE.mask and secrets.most(3.0) > secrets.most(4.0)


@pytest.mark.parametrize("stage", [corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.sentencepiece])
def test_python_workers_get_small_batches(spark, stage, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches)
    try:
        for own, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("7", 7)):
            spark.conf.set(key, own)
            stage(spark, docs, str(tmp_path))
            assert max(r.id for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "id long").collect()) == most
    finally:
        spark.conf.set(key, before)
