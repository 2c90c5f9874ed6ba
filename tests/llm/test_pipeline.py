import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from bizlens.llm import quality
from tests.llm.conftest import FOLDER
from tests.llm.test_simhash_rabitq import fingerprint, roots
from tests.llm.test_suffix_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    from bizlens.llm.common import stored, table

    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, docs, FOLDER), name)
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    assert all(done.columns == COLUMNS for _, done in stages[:-1])


def test_quality_stage(spark, stages):
    before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in quality.classify(before, model).collect() if r.predicted}
    assert set(rows(after)) == want and 0 < len(want) < before.count()


def test_exact_stage(stages):
    before, after = rows(stages[1][0]), rows(stages[1][1])
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
    assert set(after) == set(first.values()) and all(after[i] == before[i] for i in after)


def test_near_stage(stages):
    before, after = rows(stages[2][0]), rows(stages[2][1])
    ids = sorted(before)
    label = roots([fingerprint(before[i].text, 4) for i in ids], 4)
    least = {}
    for i, c in zip(ids, label):
        least.setdefault(c, i)
    assert set(after) == set(least.values())


def test_repeat_stage(stages):
    before, after = rows(stages[3][0]), rows(stages[3][1])
    assert set(before) == set(after)
    for i, n, removed, _, _ in brute([(i, r.text) for i, r in before.items()], 100):
        left = len((after[i].text or "").encode())
        assert n - removed - 8 <= left <= n - removed
        if not removed:
            assert after[i].text == (before[i].text or "") and after[i].n_chars == before[i].n_chars


def test_pack_stage_holds_every_document(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(rows(before))


def test_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(5, "one text here now", "en", "s", 1), (5, "one text here now", "en", "s", 1), (5, "quite another thing altogether", "en", "s", 1),
                                  (None, "no id at all here", "en", "s", 1), (6, None, None, None, None), (7, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.drop_exact_copies(spark, docs, FOLDER).collect()
    assert sorted([(r.doc_id, r.text) for r in exact], key=repr) == sorted([(5, "one text here now"), (5, "quite another thing altogether"), (None, "no id at all here"), (6, None)], key=repr)
    near = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    assert sorted([(r.doc_id, r.text) for r in near], key=repr) == sorted([(5, "one text here now"), (5, "quite another thing altogether"), (None, "no id at all here"), (6, None)], key=repr)
    assert corpus_pipeline.cut_repeats(spark, docs, FOLDER).count() == 6


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in (1, 2, 3, 4, 5, 6, 8, 9, 10))
