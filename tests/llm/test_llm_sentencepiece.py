import random

import pytest
from fixtures import messy_documents, prose, SCHEMAS

from freshet.llm import sentencepiece as sp

library = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return sp.compile_model(sp.default_model())


@pytest.fixture(scope="module")
def reference():
    return library.SentencePieceProcessor(model_file=sp.default_model())


def texts():
    pick = random.Random(11)
    made = ["".join(pick.choice(" ab\n\t▁é漢🙂the-") for _ in range(pick.randrange(40))) for _ in range(400)]
    return ["", " ", "  a  b ", "\n\n x\ty", "Hello, world!", "naïve 漢字 🙂\r\n", "a▁▁b", "\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", prose(1, 300), *made]


def test_same_ids_as_the_library(model, reference):
    paths = sp.Paths(model)
    for t in texts():
        ids = model.encode(t.encode(), paths).tolist()
        assert ids == reference.encode(t), t
        assert model.decode(ids).decode() == reference.decode(ids), t


def test_cache_that_overflows_changes_nothing(model, monkeypatch):
    want = [model.encode(t.encode()).tolist() for t in texts()]
    monkeypatch.setattr(sp, "CACHE", 8)
    paths = sp.Paths(model)
    assert [model.encode(t.encode(), paths).tolist() for t in texts()] == want
    assert len(paths) <= 5 and len(paths.old) <= 5


def test_merge_paths_against_the_merge_procedure(model):
    """The only path through valid neighbours is what merging itself gives."""
    pairs = {}
    for t in texts():
        for part in model.parts.findall(model.normalise(t.encode())):
            part = part.decode().replace(" ", sp.META)
            known = "".join(c for c in part if c in model.ids)[:24]
            assert [model.names[k] for k in model.free_path(known, pairs)] == model.merged(list(known))


def all_paths(model, part):
    if not part:
        yield 0.0, ()
    for n in range(1, len(part) + 1):
        k = model.ids.get(part[:n])
        step = (-model.scores[k], (k,)) if k is not None else (-model.least, model.fallback(part[0])) if n == 1 else None
        if step:
            for cost, ids in all_paths(model, part[n:]):
                yield cost + step[0], step[1] + ids


def test_unigram_least_path_against_all_paths():
    pick = random.Random(2)
    pieces = [("<unk>", 0.0, "unknown"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]]
    pieces += [(p, -pick.random() * 8, "normal") for p in {"".join(pick.choice("ab" + sp.META) for _ in range(pick.randrange(1, 5))) for _ in range(25)} | {"a", "b"}]
    model = sp.Model(pieces, False, True, False)
    for _ in range(60):
        part = "".join(pick.choice("abc" + sp.META) for _ in range(pick.randrange(9)))
        cost = {ids: c for c, ids in sorted(all_paths(model, part), reverse=True)}
        assert abs(cost[model.least_path(part)] - min(cost.values())) < 1e-9


def test_round_trip_of_messy_documents(spark):
    rows = messy_documents()
    docs = spark.createDataFrame(rows, SCHEMAS["documents"])
    coded = sp.encode(docs)
    assert set(docs.columns) - {"text"} <= set(coded.columns)
    back = [(r["doc_id"], r["text"], r["round_trip"]) for r in sp.decode(coded).select("doc_id", "text", "round_trip").collect()]
    want = [(r[0], (r[1] or "").replace("▁", " "), "▁" not in (r[1] or "")) for r in rows]
    assert sorted(back, key=repr) == sorted(want, key=repr)
