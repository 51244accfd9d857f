"""Repeated runs of lines, found by winnowing and deleted but for their first occurrence.

Lines with a word are hashed (words joined by one blank).  A passage is a run of lines that holds ``WORDS`` words and
would not without its first line, or without its last.  A gram is the shortest run of lines from one on that holds
``GRAM`` words, and the smallest gram hash inside a passage is its fingerprint, which hangs on nothing but the passage;
so equal passages share a fingerprint, and those whose fingerprint occurs once in all documents are left out.  The
others are compared as wholes: of equal passages the first (in order of id, then position) stays and later ones go.

Each line of a repeated run of ``WORDS`` words lies in a passage inside the run, wherever the run stood before; so just
the lines of such runs go, and different parts of a run may have stood in different documents.  Every deleted line has
an equal line earlier in the order, the first of which always stays.

Rows are linear in lines: a passage in a third of all documents gives each of them one row, and the joins may be split
by adaptive execution.

Defined cases: null texts stay null; lines without a word are deleted only inside a deleted run; rows alike in id and
text are one document and get the same result; a null id comes last in the order; empty tables give empty results.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, fits_broadcast, map_rows, numbered

WORDS, GRAM = 50, 25


def line_keys(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """(index, hash, words) of each line that has a word."""
    index, hashes, words = [], [], []
    for k, line in enumerate(text.split(b"\n")):
        own = line.split()
        if own:
            index.append(k)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(own)) - (1 << 63))
            words.append(len(own))
    return index, hashes, words


def ends(words: list[int], least: int) -> list[int]:
    """By line, where the shortest run from it on that holds ``least`` words ends; lines without one have no entry."""
    out, end, held = [], 0, 0
    for own in words:
        while end < len(words) and held < least:
            held += words[end]
            end += 1
        if held < least:
            break
        out.append(end)
        held -= own
    return out


def passages(hashes: list[int], words: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, hash, fingerprint, its line) of each passage."""
    raw = np.array(hashes, dtype=np.int64).tobytes()
    until = ends(words, GRAM)
    grams = [xxhash.xxh64_intdigest(raw[8 * k : 8 * end]) - (1 << 63) for k, end in enumerate(until)]
    n = len(words)
    both = {*enumerate(ends(words, WORDS)), *((n - end, n - k) for k, end in enumerate(ends(words[::-1], WORDS)))}
    out = []
    for start, end in sorted(both):
        at = min(range(start, bisect.bisect_right(until, end)), key=grams.__getitem__)
        out.append((start, end, xxhash.xxh64_intdigest(raw[8 * start : 8 * end], 1) - (1 << 63), grams[at], at))
    return out


def merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]["finish"]:
            out[-1]["finish"] = max(end, out[-1]["finish"])
        else:
            out.append({"start": start, "finish": end})
    return out


def _passages(batches):
    for batch in batches:
        sizes, flat = [0], []
        for text in binary_values(batch.column(2)):
            _, h, w = line_keys(text or b"")
            flat += passages(h, w)
            sizes.append(len(flat))
        table = np.array(flat, dtype=np.int64).reshape(-1, 5)
        kinds = {"start": pa.int32(), "finish": pa.int32(), "run": pa.int64(), "mark": pa.int64(), "at": pa.int32()}
        found = pa.StructArray.from_arrays([pa.array(table[:, k]).cast(t) for k, t in enumerate(kinds.values())], names=list(kinds))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)], names=["id", "hash", "passages"])


def _runs(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32())]))
    for batch in batches:
        out = [merged([(r["start"], r["finish"]) for r in runs]) for runs in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["id", "hash", "runs"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, runs): runs of lines with a word, by their numbers among those lines, that occurred before.

    ``hash`` is xxhash64 of the text and names the document together with the id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    base = map_rows(picked, _passages, f"id {kind}, hash bigint, passages array<struct<start:int,finish:int,run:bigint,mark:bigint,at:int>>").dropDuplicates(["id", "hash"])
    base = checkpointed(base.where(F.size("passages") > 0).withColumn("doc", F.monotonically_increasing_id()))
    each = base.select("id", "doc", F.explode("passages").alias("x")).select(
        F.struct(F.col("id").isNull().alias("none"), "id", F.col("x.start").alias("start"), "doc", F.col("x.finish").alias("finish")).alias("place"), F.col("x.run").alias("run"), F.col("x.mark").alias("mark")
    )
    marks = base.select("doc", F.explode(F.array_distinct(F.transform("passages", lambda p: F.struct(p["mark"].alias("mark"), p["at"].alias("at"))))).alias("x"))
    marks = marks.groupBy("x.mark").count().where("count > 1").select("mark")
    each = each.join(marks, "mark", "left_semi")
    first = each.groupBy("run", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("run", "mark", "first")
    later = each.join(first, ["run", "mark"]).where("place.doc <> first.doc OR place.start <> first.start")
    mine = later.groupBy(F.col("place.doc").alias("d")).agg(F.collect_list(F.struct("place.start", "place.finish")).alias("runs"))
    both = base.select("id", "hash", "doc").join(mine, F.col("doc") == F.col("d")).select("id", "hash", "runs")
    return map_rows(both, _runs, f"id {kind}, hash bigint, runs array<struct<start:int,finish:int>>")


def without_runs(text: str, runs: list) -> tuple[str, int, int]:
    """(remaining text, lines deleted, words deleted)."""
    lines = text.split("\n")
    index, _, words = line_keys(text.encode())
    gone, lost = set(), set()
    for r in runs:
        gone.update(range(index[r["start"]], index[r["finish"] - 1] + 1))
        lost.update(range(r["start"], r["finish"]))
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lost), sum(words[k] for k in lost)


def _deleted(batches):
    for batch in batches:
        texts, lines, words, left = [], [], [], []
        for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is not None and runs:
                text, n, w = without_runs(text, runs)
            else:
                n = w = 0
            texts.append(text)
            lines.append(n)
            words.append(w)
            left.append(bool(text and text.strip(" \t\n\v\f\r")))
        arrays = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(words, pa.int64()), pa.array(left, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=["text", "lines", "words", "left", *batch.schema.names[2:]])


def _dedup(docs: DataFrame, id_col: str, text_col: str):
    """Numbered columns with repeated runs deleted from the text, beside ``lines``, ``words`` and ``left``, and the way back."""
    runs = checkpointed(repeated_runs(docs, id_col, text_col).select("id", "hash", "runs"))
    few = fits_broadcast(runs, 64 + F.coalesce(F.octet_length(runs["id"].cast("string")), F.lit(0)) + 40 * F.size("runs"))
    work, at, restored = numbered(docs)
    same = work[at[id_col]].eqNullSafe(runs["id"]) & (F.xxhash64(work[at[text_col]]) == runs["hash"])
    others = [f for f in work.schema if f.name != at[text_col]]
    joined = work.join(F.broadcast(runs) if few else runs, same, "left").select(F.col(at[text_col]).cast("string"), "runs", *[f.name for f in others])
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    return map_rows(joined, _deleted, "text string, lines bigint, words bigint, left boolean" + types).withColumnRenamed("text", at[text_col]), restored


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs deleted from the text, and ``__lines``, ``__words`` deleted and ``__left`` (a word is left).

    Columns of ``docs`` that have these three names are replaced.
    """
    own = ("__lines", "__words", "__left")
    out, restored = _dedup(docs.drop(*own), id_col, text_col)
    return restored(out, *[F.col(c[2:]).alias(c) for c in own])


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs deleted; documents of which no word is left, because of that, go."""
    out, restored = _dedup(docs, "doc_id", "text")
    return restored(out.where("left OR lines = 0"))


def op4_winnowed_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__lines").alias("removed_lines"), F.col("__words").alias("removed_words"), "text")
