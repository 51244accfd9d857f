"""Shared helpers of the training-data operators: words, hashing passes, materialisation, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Largest table that is sent to every executor.
BROADCAST_BYTES = 48 << 20
#: Most edges whose components the driver finds: 16 bytes each.
DRIVER_EDGES = 1 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def lower_ascii(col):
    """A-Z to a-z and nothing else, inside generated code."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_col(col):
    """array<string> of the words of a text, built-in functions only; null texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), WORD_BREAK), lambda w: w != "")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in local tests, a
    temporary one is made.  Files written there outlive executors, so a lost one costs no recomputation.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark))
    return df.checkpoint(eager=True)


def _local_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return tempfile.mkdtemp(prefix="freshet-checkpoints-")


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` that gives unused memory back when a task ends, as workers stay for the stages that follow."""

    def run(batches):
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return df.mapInArrow(run, schema)


def fits_broadcast(df: DataFrame, width, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, of ``width`` bytes each (a Column), come to ``most`` bytes at most; they are counted."""
    return (df.agg(F.sum(width)).first()[0] or 0) <= most


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[..., DataFrame]]:
    """``df`` with columns c0, c1, ..., these names by the old ones, and the way back; nothing can clash in between."""
    at = {name: f"c{k}" for k, name in enumerate(df.columns)}
    return df.toDF(*at.values()), at, lambda out, *more: out.select(*[F.col(c).alias(name) for name, c in at.items()], *more)


def binary_values(column: pa.Array) -> list:
    """UTF-8 bytes of a string column; None for nulls."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and by node the smallest that can be reached."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(u):
        np.minimum.at(low, np.maximum(low[u], low[v]), np.minimum(low[u], low[v]))
        while (low != (to := low[low])).any():
            low = to
        apart = low[u] != low[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[low]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots; root is the smallest node that can be reached.

    Up to ``most`` edges, which are counted, go to the driver: rounds over a small table cost many tasks, with files and
    log entries of each, for next to no rows.  More edges take alternating large-star and small-star rounds: each is two
    shuffles of the edge list, each node is sent only its own minimum, and the number of rounds grows with the logarithm of
    the longest path.  A hub's edges meet one row of the minimum table, which is a join that adaptive execution may split.
    """
    edge = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edge = checkpointed(edge)
    if dict(edge.dtypes) == {"u": "bigint", "v": "bigint"} and edge.count() <= most:
        found = edge.toArrow()
        node, root = smallest_reached(found["u"].to_numpy(), found["v"].to_numpy())
        others = node != root
        return edges.sparkSession.createDataFrame(pa.table({"node": node[others], "root": root[others]}))
    state = None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edge = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edge.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == state or now["n"] == 0:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (now["n"], now["x"])
