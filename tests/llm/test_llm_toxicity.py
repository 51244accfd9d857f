import itertools
import os

import numpy as np
import pytest
from fixtures import messy_documents, prose, SCHEMAS
from pyspark.sql import functions as F

from freshet.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def enumerated(codes, emission, transition, start):
    """Marginals of state 1 by summing over all state sequences."""
    n, total, ones = len(codes), 0.0, np.zeros(len(codes))
    for states in itertools.product((0, 1), repeat=n):
        log = start * states[0] + sum(emission[c] for c, s in zip(codes, states, strict=True) if s) + sum(transition[a][b] for a, b in itertools.pairwise(states))
        total += np.exp(log)
        ones += np.exp(log) * np.array(states)
    return ones / total


def test_marginals_against_all_state_sequences():
    rng = np.random.default_rng(1)
    emission, transition, start = rng.normal(size=81), rng.normal(size=(2, 2)), 0.3
    sequences = [rng.integers(0, 81, n).astype(np.int16) for n in (5, 0, 9, 1, 9)]
    chain = toxicity.Chain(sequences)
    p = chain.marginals(emission, transition, start)
    for rank, k in enumerate(chain.order):
        own = p[chain.starts[rank] : chain.starts[rank] + chain.lengths[rank]]
        if len(own):
            np.testing.assert_allclose(own, enumerated(sequences[k], emission, transition, start), rtol=1e-9)


def test_runs_are_offsets_in_the_text():
    text = "ab  çd\nbad worse! ok bad"
    spans = toxicity._runs(text.encode(), np.array([False, False, True, True, False, True]))
    assert [text[s["start"] : s["finish"]] for s in spans] == ["bad worse!", "bad"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, f"{prose(k, 60)} vilethings {prose(900 + k, 60)}" if k % 2 else prose(k, 120), k % 2) for k in range(80)]
    return toxicity.fit(spark.createDataFrame(rows, "key long, text string, toxic int"))


def test_spans_and_scores(spark, model):
    rows = [(1, f"{prose(2000, 50)} VileThings, {prose(2001, 50)}"), (2, prose(2002, 100)), (3, None), (4, ""), (5, f"{prose(2003, 20_000)} vilethings")]
    got = {r["id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["score"] > 0.7 > 0.3 > got[2]["score"] and got[5]["score"] > got[2]["score"]
    assert [rows[0][1][s["start"] : s["finish"]] for s in got[1]["spans"]] == ["VileThings,"]
    assert [rows[4][1][s["start"] : s["finish"]] for s in got[5]["spans"]] == ["vilethings"]
    assert got[3]["score"] == got[4]["score"] < 0.5 and got[3]["spans"] == [] and all(0 <= r["score"] <= 1 for r in got.values())


def test_without_both_labels_every_score_is_zero(spark):
    assert toxicity.fit(spark.createDataFrame([(1, "a b", 1), (2, None, None)], "key long, text string, toxic int")) is None
    got = toxicity.score(spark.createDataFrame(messy_documents(), SCHEMAS["documents"]), None).collect()
    assert len(got) == len(messy_documents()) and {(r["score"], len(r["spans"])) for r in got} == {(0.0, 0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.queries()["op1_crf_toxicity"](spark, SF).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    y, s = got.toxic.to_numpy(), got.score.to_numpy()
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert above > 0.85
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_held_out_rows_by_checksum(spark):
    import zlib

    got = spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
