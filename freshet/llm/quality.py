"""Quality rules with cross-document line frequencies.

A base pass measures each whole text.  Its lines are then normalised (A-Z lower-cased, words joined by one
space), hashed, and counted over the documents of a host; a line in more than ``max(MIN_DOCS, SHARE * documents
of the host)`` of them is boilerplate and removed, and a document that keeps under ``REMAIN`` of its words is
rejected as depleted.  Counts are partial sums before the shuffle, and lines meet the short list of boilerplate
in a join that adaptive execution may split or broadcast by measured size.

Defined cases: null texts have no words and fail the base rules; a null host counts as the host ""; each row is a
document of its own, repeated rows included; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary_values, checkpointed, map_rows

MIN_DOCS, SHARE, REMAIN = 30, 0.01, 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SPACE_AND_TAILS = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    if len(known) < 1 << 21:
        windows = (ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(known) + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[tuple[int, ...], dict[int, int]]:
    """The base measures of one text, and the words in each distinct normalised line by its hash."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    by_line: dict[int, int] = {}
    for line in lines:
        own = line.translate(ASCII_LOWER).split()
        key = xxhash.xxh64_intdigest(b" ".join(own), 0)
        by_line[key] = by_line.get(key, 0) + len(own)
    return (
        len(words), len(text.translate(None, _SPACE_AND_TAILS)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
    ), by_line


def _measured(batches):
    for batch in batches:
        found = [measure(t) for t in binary_values(batch.column(2))]
        sizes = np.cumsum([0, *(len(x) for _, x in found)]).astype(np.int32)
        hashes = np.array([h for _, x in found for h in x], dtype=np.uint64).view(np.int64)
        counts = np.array([n for _, x in found for n in x.values()], dtype=np.int64)
        table = np.array([m for m, _ in found], dtype=np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(table[:, k]) for k in range(len(MEASURES))), *(pa.ListArray.from_arrays(pa.array(sizes), pa.array(v)) for v in (hashes, counts))],
            names=["id", "host", *MEASURES, "line", "line_words"],
        )


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, remain: float = REMAIN) -> DataFrame:
    """(id, measures, base_failed, kept, removed_words) a row of ``docs``."""
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, host string, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", line array<bigint>, line_words array<bigint>"
    base = checkpointed(map_rows(picked, _measured, schema).withColumn("row", F.monotonically_increasing_id()))
    lines = base.select("row", "host", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("row", "host", "x.line", "x.line_words")
    hosts = base.groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = (
        lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
        .join(hosts, "host").where(F.col("n") > F.col("host_docs") * share).select("host", "line")
    )
    lost = lines.join(checkpointed(frequent), ["host", "line"]).groupBy("row").agg(F.sum("line_words").alias("lost"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce("lost", F.lit(0))
    return base.join(lost, "row", "left").select(
        "id", *MEASURES, failed.alias("base_failed"), (~failed & (F.col("n_words") - removed >= remain * F.col("n_words"))).alias("kept"), removed.alias("removed_words")
    )


def op9_line_frequency_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return line_rules(docs).withColumnRenamed("id", "doc_id")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') host, coalesce(text, '') text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws FROM d),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) c FROM w, unnest(range(1, len(ws) - 1)) u(i)),
r AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM t WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) line FROM d),
n AS (SELECT doc_id, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) n FROM n WHERE len(ws) > 0 GROUP BY doc_id),
f AS (SELECT host, ws FROM n WHERE len(ws) > 0 GROUP BY host, ws HAVING count(DISTINCT doc_id) > {MIN_DOCS}
      AND count(DISTINCT doc_id) > {SHARE} * (SELECT count(*) FROM d WHERE d.host = n.host)),
lost AS (SELECT doc_id, sum(len(ws)) k FROM n JOIN f USING (host, ws) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words, coalesce(k, 0) removed
      FROM w JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines,
  CAST(n_repeat_words AS BIGINT) n_repeat_words, base_failed, NOT base_failed AND n_words - removed >= {REMAIN} * n_words kept, CAST(removed AS BIGINT) removed_words FROM b
"""
