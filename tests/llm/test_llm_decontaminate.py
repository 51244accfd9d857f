import re
from fractions import Fraction

from fixtures import messy_tables, prose, SCHEMAS

from freshet.llm import decontaminate


def grams(text, n=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(n, len(words))
    return n, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute_force(docs, items, threshold=Fraction(4, 5)):
    out = set()
    for doc, text, *_ in docs:
        for item, wanted, *_ in items:
            n, own = grams(wanted)
            words = re.findall(r"[^\W_]+", (text or "").lower())
            there = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
            if own and Fraction(len(own & there), len(own)) >= threshold:
                out.add((doc, item, len(own & there), len(own)))
    return out


def test_against_exact_containment(spark):
    tables = messy_tables()
    item = prose(50, 40).split()
    changed = [" ".join(["other" if k % 40 == 7 * c % 40 and c else w for k, w in enumerate(item)]) for c in range(3)]
    docs = [*tables["documents"], *[(500 + k, f"{prose(60 + k, 5000)}, {t.upper()}! {prose(70 + k, 5000)}", "en", "s", 1, *"ccccccc") for k, t in enumerate([*changed, " ".join(item[:33]), " ".join(item[:38])])]]
    items = [*tables["benchmark"], (50, " ".join(item), "c", "c"), (51, " ".join(item[:7]), "c", "c")]
    got = decontaminate.contained(spark.createDataFrame(docs, SCHEMAS["documents"]), spark.createDataFrame(items, SCHEMAS["benchmark"]))
    want = brute_force(docs, items)
    assert {(r["id"], r["item"], r["matched"], r["item_shingles"]) for r in got.collect()} == want
    assert len(want) >= 8 and got.count() == len({(*w, d[1]) for w in want for d in docs if d[0] == w[0] and w[1] in {x[1] for x in brute_force([d], items)}})


def test_items_beyond_the_broadcast_are_joined_alike(spark, monkeypatch):
    tables = messy_tables()
    docs, items = spark.createDataFrame(tables["documents"], SCHEMAS["documents"]), spark.createDataFrame(tables["benchmark"], SCHEMAS["benchmark"])
    want = sorted(map(tuple, decontaminate.contained(docs, items).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontaminate.contained(docs, items).collect()), key=repr) == want


def test_stage_removes_documents_with_an_item_only(spark):
    tables = messy_tables()
    docs, items = spark.createDataFrame(tables["documents"], SCHEMAS["documents"]), spark.createDataFrame(tables["benchmark"], SCHEMAS["benchmark"])
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    texts = {r[1] for r in tables["documents"] if brute_force([r], tables["benchmark"])}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((r[0], r[1]) for r in tables["documents"] if r[1] not in texts), key=repr)


def test_items_of_every_size_at_just_the_threshold(spark):
    """Of each item a document lacks just the allowed number of shingles, those of the sketch first; another lacks one more."""
    sizes = [*range(1, 66), 127, 128, 129, 254, 255, 256, 257, 300]
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n + 4))) for n in sizes], "item_id long, text string")
    sketch = {}
    for r in decontaminate.item_shingles(items).where("in_sketch").collect():
        sketch.setdefault(r["item"], set()).add(r["shingle"])
    hashed = items.select("item_id", decontaminate._grams(decontaminate._hashes(items["text"]), 5).alias("g")).collect()
    docs = []
    for r in hashed:
        n, words = r["item_id"], [f"w{r['item_id']}x{k}" for k in range(r["item_id"] + 4)]
        lack = n - -(-4 * n // 5)
        order = sorted(range(n), key=lambda k: r["g"][k] not in sketch[n])
        for more in (0, 1):
            gone = set(order[: lack + more])
            docs.append((2 * n + more, " . ".join(" ".join(words[k : k + 5]) + f" end{k}" for k in range(n) if k not in gone)))
    got = {(r["id"], r["item"]): r["matched"] for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(2 * n, n): -(-4 * n // 5) for n in sizes}


def test_candidates_come_from_sketches(spark):
    tables = messy_tables()
    docs, items = (spark.createDataFrame(tables[t], SCHEMAS[t]) for t in ("documents", "benchmark"))
    sketch = decontaminate.item_shingles(items)
    assert 0 < sketch.where("in_sketch").count() < sketch.count()
    assert "Python" not in decontaminate.contained(docs, items)._jdf.queryExecution().toString()
