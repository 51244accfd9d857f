import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import messy_documents, prose, SCHEMAS

from freshet.llm import simhash
from freshet.llm.common import connected_components


def naive_fingerprint(text, shingle=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        lower = lower.replace(blank, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(values, limit=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in values:
        for y in values:
            if bin(x ^ y).count("1") <= limit:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \n ", "One", "one two three", "ÄÖ A B c d E f", prose(1, 500), "same " * 50])
def test_fingerprint_bit_by_bit(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == naive_fingerprint(text)


@pytest.mark.parametrize("bucket", [2048, 8, 1])
def test_links_against_all_pairs(spark, bucket):
    """Small buckets send every key the way of crowded ones."""
    pick = random.Random(5)
    values = {pick.getrandbits(64) for _ in range(150)}
    for v in list(values)[:80]:
        for _ in range(3):
            for b in pick.sample(range(64), pick.choice([1, 2, 3, 4, 5])):
                v ^= 1 << b
            values.add(v)
    values |= {0, 1, 3, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket).collect()}
    want = roots(sorted(values))
    classes = lambda m: {frozenset(v for v in values if m.get(v, v) == r) for r in {m.get(v, v) for v in values}}
    assert classes(found) == classes(want)


def test_components_of_messy_documents(spark):
    rows = messy_documents()
    got = simhash.components(spark.createDataFrame(rows, SCHEMAS["documents"])).collect()
    prints = [(r[0], naive_fingerprint(r[1])) for r in rows]
    root = roots({f for _, f in prints})
    least = {c: min(i for i, f in prints if i is not None and root[f] == c) for c in set(root.values())}
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == sorted(((i, f, least[root[f]]) for i, f in prints), key=repr)


def test_one_of_each_class_stays(spark):
    rows = messy_documents()
    docs = spark.createDataFrame(rows, SCHEMAS["documents"])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    root = roots({naive_fingerprint(r[1], 5) for r in rows})
    assert sorted(root[naive_fingerprint(r["text"], 5)] for r in kept) == sorted(set(root.values()))


def jaccard_classes(texts, least=0.8):
    """Smallest position in each class of ``texts``, over all pairs."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    low = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if low[x] != low[y] and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]):
                a, b = sorted((low[x], low[y]))
                low = [a if v == b else v for v in low]
    return low


def edited(pick, text, edits):
    words = text.split()
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def test_every_edited_copy_of_similarity_goes_and_no_other(spark):
    """Against brute force: copies at more than four bits, chains of them, a large group, and lines that most texts hold."""
    pick = random.Random(11)
    line = prose(9, 25)
    texts = [f"{prose(100 + k, pick.choice([30, 120, 300]))} {line if k % 2 else ''}" for k in range(80)]
    for base in texts[:40]:
        for _ in range(3):
            base = edited(pick, base, pick.randrange(1, 8))
            texts.append(base)
    texts += [edited(pick, texts[0], 1) for _ in range(60)]
    low = jaccard_classes(texts)
    far = [bin(naive_fingerprint(texts[x], 5) ^ naive_fingerprint(texts[low[x]], 5)).count("1") for x in range(len(texts))]
    assert sum(f > 4 for f in far) > 20 and len(set(low)) > 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(low))


def test_lists_are_compared_a_few_at_a_time():
    pick = random.Random(3)
    lists = [[pick.getrandbits(63) for _ in range(pick.choice([0, 1, 2, 7, 40]))] for _ in range(60)]
    column = pa.array(lists, pa.list_(pa.int64()))
    batches = [pa.RecordBatch.from_arrays([c], names=["fps"]) for c in (column.slice(0, 25), column.slice(25, 0), column.slice(25))]
    for most in (1, 10, 100, 1 << 16):
        pieces = list(simhash._pieces(batches, most))
        assert [v[a:b].tolist() for v, ends in pieces for a, b in zip([0, *ends[:-1]], ends, strict=True)] == lists
        assert all(len(v) <= most or len(ends) == 1 for v, ends in pieces)


@pytest.mark.parametrize("most", [None, 0])
def test_components_of_few_edges_take_few_jobs(spark, most):
    """A long path, stars and loose pairs; without edges for the driver the rounds give the same, in many jobs, tasks and files."""
    pick = random.Random(8)
    names = [pick.getrandbits(63) - (1 << 62) for _ in range(400)]
    edges = [(names[k], names[k + 1]) for k in range(199)] + [(names[k], names[200 + k % 3]) for k in range(203, 350)] + [(names[k], names[k + 1]) for k in range(350, 400, 2)] + [(names[0], names[0])]
    want = {}
    for group in [names[:200], *[[names[200 + k], *names[203 + (k + 1) % 3 : 350 : 3]] for k in range(3)], *[names[k : k + 2] for k in range(350, 400, 2)]]:
        want |= {x: min(group) for x in group if x != min(group)}
    spark.sparkContext.setJobGroup(f"components-{most}", "")
    try:
        found = connected_components(spark.createDataFrame(edges, "a long, b long"), **({} if most is None else {"most": most})).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{most}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
    assert most == 0 or jobs <= 8
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_marks_are_sent_small():
    pick = np.random.default_rng(4)
    hashes = pick.integers(-(1 << 63), (1 << 63) - 1, 3000)
    place = hashes.view(np.uint64) % np.uint64(simhash.BITMAP)
    for n in (0, 1, 1000):
        dense = np.zeros(simhash.BITMAP // 64, dtype=np.uint64)
        np.bitwise_or.at(dense, (place[:n] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place[:n] & np.uint64(63)))
        at = pick.permutation(np.flatnonzero(dense))
        few = simhash._bitmap(at, dense[at])
        assert sum(x.nbytes for x in few) == 16 * len(at)
        assert simhash._marked(hashes, *few).tolist() == simhash._marked(hashes, None, dense).tolist()
        assert simhash._marked(hashes, *few)[:n].all() and simhash._marked(hashes, *few).sum() < n + 100
    every = np.arange(simhash.BITMAP // 64)
    none, words = simhash._bitmap(every, every.astype(np.uint64))
    assert none is None and (words == every).all()
