from collections import Counter, defaultdict

import pytest
from fixtures import messy_documents, SCHEMAS
from pyspark.sql import functions as F

from freshet.llm import sharding


def brute_force(rows, shards):
    """(shard, slot) row by row: rows are (cell, ...) in ring order."""
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    nodes, used, out, over = sharding.ring(shards), [0] * shards, [], []

    def place(row, shard):
        out.append((row, shard, used[shard]))
        used[shard] += 1

    for row in rows:
        at = next((k for k, (place, _) in enumerate(nodes) if place >= row[1]), 0)
        if used[nodes[at][1]] < room[nodes[at][1]]:
            place(row, nodes[at][1])
        else:
            over.append((row, at))
    for row, at in over:
        while used[nodes[at][1]] >= room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        place(row, nodes[at][1])
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, shards", [(1000, 24), (7, 24), (500, 3), (1, 1)])
def test_against_row_by_row_filling(spark, n, shards):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5).cast("string")).alias("text"))
    key = ["cell", "place", "id", "crc", "size"]
    rows = sorted(tuple(r[k] for k in key) for r in sharding.keys(docs, "doc_id", "text", shards).collect())
    want = [(r[2], shard, slot) for r, shard, slot in brute_force(rows, shards)]
    got = [(r["id"], r["shard"], r["slot"]) for r in sharding.shard_rows(docs, shards).collect()]
    assert sorted(got) == sorted(want)


def test_rows_law_with_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame(messy_documents() * 40, SCHEMAS["documents"])
    got = sharding.shard_rows(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and set(counts) <= set(range(24))
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["size"], r["crc"]) for r in got if r["id"] == 0} == {(8, 0)}


def test_movement_is_limited(spark):
    """Rows over a shard's capacity move, the others stay with the owner that the ring names."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    nodes = sharding.ring(24)
    owner = {r["id"]: next((s for p, s in nodes if p >= r["place"]), nodes[0][1]) for r in sharding.keys(docs, "doc_id", "text").collect()}
    load, room = Counter(owner.values()), 5000 // 24 + 1
    moved = sum(owner[r["id"]] != r["shard"] for r in sharding.shard_rows(docs).collect())
    assert moved <= sum(max(0, n - room + 1) for n in load.values())


def test_shares_of_the_ring_are_even():
    nodes = sharding.ring(24)
    share = Counter()
    for (before, _), (place, shard) in zip([(nodes[-1][0] - (1 << 64), 0), *nodes], nodes, strict=False):
        share[shard] += (place - before) / (1 << 64)
    assert len({p for p, _ in nodes}) == 24 * sharding.VNODES
    assert all(0.8 < 24 * x < 1.2 for x in share.values()) and abs(sum(share.values()) - 1) < 1e-9


def test_a_row_repeated_very_often_is_numbered_in_pieces(spark):
    docs = spark.range(30_000).select((F.when(F.col("id") < 20_000, 7).otherwise(F.col("id"))).alias("doc_id"), F.lit("same").alias("text"))
    cut = sharding.shard_rows(docs, 5, piece=100)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, sharding.shard_rows(docs, 5).collect()))


def test_few_rows_move_when_a_shard_is_added(spark):
    """Beside the rows that the new shard takes, those move whose old or new owner was full."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    old, new = ({r["id"]: r["shard"] for r in sharding.shard_rows(docs, n).collect()} for n in (23, 24))
    taken, moved = sum(s == 23 for s in new.values()), sum(new[k] != s for k, s in old.items())
    assert taken in (833, 834) and moved < 0.2 * 20_000
