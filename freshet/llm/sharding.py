"""Shards from a consistent-hash ring with virtual nodes and bounded loads; built-in functions only.

Every row has a place on a ring of 64-bit numbers (by its id; by its text where the id is null) and belongs to the next
virtual node clockwise.  Shards take their own rows in ring order until full; rows over a full shard's capacity go on
clockwise to the first virtual node whose shard has room.  Capacities add up to the number of rows and differ by one at
most, so counts do as well (law ``rows``), and only overflow leaves its own shard.

Rows before each virtual node are counted in ``SALTS`` parts, called cells.  Only the cells' counts, a fixed number at any
input size, reach the driver, which fills the ring and sends back which ranks of each cell go where.  Equal rows are
counted before the shuffle and numbered again in pieces of ``PIECE`` rows, which are dealt out where there are several.

Defined cases: a null text has size 8 and checksum 0; rows repeated in the input each get a slot; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Shares of the ring have a standard deviation of one sixteenth at 256 virtual nodes a shard.
SHARDS, VNODES, SALTS, PIECE = 24, 256, 8, 1 << 16
#: Arcs of the ring within which a place is compared with virtual nodes one by one.
_ARC_BITS = 12


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes in clockwise order; places are signed 64-bit numbers."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], signed=True)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def fill(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) pieces that hold every row once.

    There is a piece a cell at most and one more for each shard that fills.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slots, nodes = [0] * shards, ring(shards, vnodes)
    pieces, over = [], []

    def take(cell, start, end, shard):
        n = min(room[shard], end - start)
        if n:
            pieces.append((cell, start, start + n, shard, slots[shard]))
            slots[shard] += n
            room[shard] -= n
        return start + n

    for cell in sorted(counts):
        node = cell // SALTS
        rest = take(cell, 0, counts[cell], nodes[node][1])
        if rest < counts[cell]:
            over.append((cell, rest, counts[cell], node))
    onward = list(range(len(nodes)))  # the first node from here on with room, kept by path halving

    def open_node(k):
        while room[nodes[onward[k]][1]] == 0:
            onward[k] = onward[(onward[k] + 1) % len(nodes)]
        return onward[k]

    for cell, start, end, node in over:
        while start < end:
            node = open_node(node)
            start = take(cell, start, end, nodes[node][1])
    return pieces


def _node(place, shards: int):
    """The number of the virtual node that a place belongs to."""
    places = [p for p, _ in ring(shards)]
    starts = [(k << 64 - _ARC_BITS) - (1 << 63) for k in range((1 << _ARC_BITS) + 1)]
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  # folded once
    first = listed([bisect_left(places, start) for start in starts])
    arc = (F.shiftright(place, 64 - _ARC_BITS) + (1 << _ARC_BITS - 1)).cast("int")
    before, until = F.get(first, arc), F.get(first, arc + 1)
    inside = F.filter(F.slice(listed(places), (before + 1).cast("int"), (until - before).cast("int")), lambda p: p < place)
    return F.pmod(before + F.size(inside), F.lit(len(places)))


def keys(docs: DataFrame, id_col: str, text_col: str, shards: int = SHARDS) -> DataFrame:
    """(id, size, crc, place, cell) a row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    place = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("crc"), place.alias("place")
    ).withColumn("cell", _node(F.col("place"), shards) * SALTS + F.pmod(F.xxhash64("crc", "id", "size"), F.lit(SALTS)))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, size, crc, shard, slot) a row of ``docs``."""
    spark = docs.sparkSession
    alike = checkpointed(keys(docs, id_col, text_col, shards).groupBy("cell", "place", "id", "crc", "size").count())
    cells = alike.groupBy("cell").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()  # SALTS rows a virtual node at most
    pieces = [dict(zip(("c", "a", "b", "s", "p"), x, strict=True)) for x in fill({r["cell"]: r["n"] for r in cells}, shards)]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(pieces)), "array<struct<c bigint,a bigint,b bigint,s int,p bigint>>")))
    in_cell = Window.partitionBy("cell").orderBy("place", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("count").over(in_cell)
    ranked = alike.withColumn("end", end).withColumn("start", F.col("end") - F.col("count")).drop("count")
    if max((r["most"] for r in cells), default=0) > piece:
        large = F.col("end") - F.col("start") > piece
        parts = ranked.where(large).withColumn("start", F.explode(F.sequence("start", F.col("end") - 1, F.lit(piece)))).withColumn("end", F.least("end", F.col("start") + piece))
        ranked = ranked.where(~large).unionByName(parts.repartition("cell", "start"))
    each = ranked.select("id", "size", "crc", "cell", F.explode(F.sequence("start", F.col("end") - 1)).alias("rank"))
    on = (F.col("cell") == F.col("c")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    return each.join(F.broadcast(plan), on).select(
        "id", "size", "crc", F.col("s").alias("shard"), (F.col("p") + F.col("rank") - F.col("a")).alias("slot")
    )


def op2_bounded_ring_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
