"""The stages in their order, each on what the one before kept, against plain loops."""

import pytest
from fixtures import messy_tables, prose, write_tables

import corpus_pipeline
from freshet.llm import language, sentencepiece, winnowing
from test_llm_decontaminate import brute_force
from test_llm_simhash import naive_fingerprint, roots

EN = "the river and the hills are near the old mill with the birds "


def documents():
    """Clean texts, copies, near copies, a passage that repeats, a leak, and a text in no language."""
    passage, item = prose(1, 60), prose(2, 40)
    texts = [EN + prose(10 + k, 200) for k in range(20)]
    texts += [texts[3], texts[4] + " end", EN + prose(40, 90) + "\n" + passage, EN + prose(41, 90) + "\n" + passage, passage, EN + prose(42, 300) + " " + item + " " + prose(43, 300), "", None]
    return [(k, t, "en", "s", len(t or ""), *"ccccccc") for k, t in enumerate(texts)], [(1, item, "c", "c")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = documents()
    return write_tables(spark, tmp_path_factory.mktemp("pipeline"), messy_tables() | {"documents": docs, "benchmark": items})


def test_stages_against_loops(spark, folder, tmp_path):
    docs, items = documents()
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    names = frame.columns
    state = {d[0]: d[1] for d in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "language_id":
            state = {i: t for i, t in state.items() if t}
        elif name == "line_dedup":
            passage = prose(1, 60)
            first = min(i for i, t in state.items() if passage in t.split("\n"))
            lines = {i: [x for x in t.split("\n") if x != passage or i == first] for i, t in state.items()}
            whole = {t: min(i for i, u in state.items() if u == t) for t in state.values()}
            state = {i: "\n".join(x) for i, x in lines.items() if x and whole[state[i]] == i}
        elif name == "simhash_near_dedup":
            root = roots({naive_fingerprint(t, 5) for t in state.values()})
            by = {}
            for i in sorted(state):
                by.setdefault(root[naive_fingerprint(state[i], 5)], i)
            state = {i: state[i] for i in by.values()}
        elif name == "benchmark_decontamination":
            gone = {d for d, *_ in brute_force(list(state.items()), items)}
            assert gone
            state = {i: t for i, t in state.items() if i not in gone}
        rows = frame.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(state), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == names
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows} == {i: (t, len(t)) for i, t in state.items()}, name
        else:
            model = sentencepiece.compile_model(sentencepiece.default_model())
            assert {r["doc_id"]: r["token_ids"] for r in rows} == {i: model.encode(t.encode()).tolist() for i, t in state.items()}
            assert all(r["round_trip"] for r in rows)
    assert set(state) >= set(range(20)) - {3, 4}  # clean documents stay
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(state)


def test_every_stage_takes_empty_and_messy_tables(spark, folder):
    messy = spark.createDataFrame(messy_tables()["documents"], spark.read.parquet(f"{folder}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.limit(0), folder).collect() == [], name
        out = stage(spark, messy, folder)
        assert name == "sentencepiece" or out.columns == messy.columns
        assert out.count() <= messy.count()


def test_stage_functions_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert corpus_pipeline.language is language and corpus_pipeline.winnowing is winnowing
