"""The corpus pipeline on the smallest tables: each stage against a brute-force check of its own input."""

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import corpus_pipeline  # noqa: E402
from dealscreen.llm import pieces  # noqa: E402
from dealscreen.llm.common import materialise, read  # noqa: E402

from test_dedup import simhash_rows  # noqa: E402
from test_text_operators import base_counts, contaminated  # noqa: E402


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    out = [read(spark, sf_dir, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(results):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for df in results[1:-1]:
        assert df.dtypes == results[0].dtypes


def test_quality_stage(results):
    before, after = rows(results[0]), rows(results[1])
    passed = {i for i, r in before.items() if not base_counts(r.text)[5]}
    assert after.keys() <= passed and len(after) >= 0.95 * len(passed)
    assert all(after[i] == before[i] for i in after)


def test_near_duplicate_stage(results):
    before, after = rows(results[1]), rows(results[2])
    want = {c for _, _, c in simhash_rows([(i, r.text) for i, r in before.items()])}
    assert after.keys() == want and all(after[i] == before[i] for i in after)


def test_decontamination_stage(results, spark, sf_dir):
    before, after = rows(results[2]), rows(results[3])
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    clean = {r[0] for r in contaminated([(i, x.text) for i, x in before.items()], items) if not r[5]}
    assert after.keys() == clean


def test_private_and_piece_stages(results):
    before, after, last = rows(results[3]), rows(results[4]), rows(results[5])
    assert before.keys() == after.keys() == last.keys()
    vocabulary = pieces.pieces(pieces.MODEL)
    for i, r in last.items():
        assert r.n_chars == len(r.text)
        for s in r.piece_samples:
            assert pieces.decode(s.ids, vocabulary) == r.text


def test_run(results, spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == results[-1].columns and got.count() == results[-1].count()
