"""Benchmark items found inside documents: size-partitioned MinHash containment search; built-in functions only.

Items are partitioned by size (powers of two of their shingle count).  An item's sketch is its bottom-k shingles under
a MinHash order, with k one more than the number of shingles that a match may lack in the largest item of its
partition, in whole numbers: a document that holds ``threshold`` of the item then holds at least one sketch shingle, so
candidates are complete whatever the document's length.  (MinHash of the documents would not be: a short item in a long
text has a Jaccard similarity near zero, and windows around it multiply the rows.)

Documents' shingles meet the sketches only, which gives candidate pairs.  Just the documents among these are cut into
shingles once more, and each pair is verified by its exact containment: distinct shared shingles over distinct shingles of
the item.

A shingle is five words (an item with fewer is one shingle), a word a run of letters and digits in lower case; both are
compared by 64-bit hashes.  Tables are broadcast up to ``BROADCAST_BYTES``, counted, and shuffled beyond.

Defined cases: null texts and items without a word match nothing; rows alike in id and text are one document; an
empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, checkpointed, fits_broadcast, numbered

SHINGLE, THRESHOLD = 5, 0.8


def _words(col):
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _grams(hashes, n: int):
    """Hashes of the runs of n words; the outer lambda holds the array so that it is computed once."""
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= n, runs(h)).otherwise(F.array().cast("array<bigint>")))[0]


def _hashes(col):
    return F.transform(_words(col), lambda w: F.xxhash64(w))


def _share(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, as it is written."""
    return Fraction(str(threshold)).as_integer_ratio()


def _small(df: DataFrame) -> bool:
    """Whether a table is small enough to broadcast: its longs, and its keys as texts."""
    wide = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema), F.lit(16))
    return fits_broadcast(df, wide, BROADCAST_BYTES)


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(item, words, item_shingles, shingle, in_sketch), a row for each distinct shingle."""
    base = items.select(F.col(id_col).alias("item"), _hashes(F.col(text_col)).alias("h"))
    base = base.withColumn("words", F.least(F.size("h"), F.lit(SHINGLE))).where("words > 0")
    grams = F.coalesce(*[F.when(F.col("words") == n, _grams(F.col("h"), n)) for n in range(1, SHINGLE + 1)])
    rows = base.select("item", "words", F.explode(grams).alias("shingle")).distinct()
    own = Window.partitionBy("item")
    sized = rows.withColumn("item_shingles", F.count("*").over(own))
    top, bottom = _share(threshold)
    # the size of the largest item of the partition, and how many of its shingles a match may lack
    lack = F.expr(f"((CAST(1 AS BIGINT) << CAST(length(bin(item_shingles)) AS INT)) - 1) * {bottom - top} DIV {bottom}")
    order = Window.partitionBy("item").orderBy(F.xxhash64("shingle"), "shingle")
    return sized.select("item", "words", "item_shingles", "shingle", (F.row_number().over(order) <= lack + 1).alias("in_sketch"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, item, matched, item_shingles, containment) of every document and item at ``threshold`` or above."""
    wanted = checkpointed(item_shingles(items, item_col, item_text, threshold))
    lengths = [r["words"] for r in wanted.select("words").distinct().collect()]  # five values at most
    shown = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def meeting(texts, side):
        grams = [_grams(F.col("h"), n) for n in lengths]
        found = texts.select("id", "text_hash", _hashes(F.col("text")).alias("h")).select("id", "text_hash", F.explode(F.concat(*grams) if grams else F.array().cast("array<bigint>")).alias("shingle"))
        return found.join(F.broadcast(side) if _small(side) else side, "shingle")

    pairs = checkpointed(meeting(shown, wanted.where("in_sketch").select("item", "shingle")).select("id", "text_hash", "item").distinct())
    named = pairs.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("item").alias("__item"))
    texts = named.select("__hash").distinct()
    held = shown.join(F.broadcast(texts) if _small(texts) else texts, F.col("text_hash") == F.col("__hash"), "left_semi")
    hits = meeting(held, wanted.select("item", "item_shingles", "shingle"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")) & F.col("item").eqNullSafe(F.col("__item"))
    sure = hits.join(F.broadcast(named) if _small(named) else named, same, "left_semi")
    pair = ["id", "text_hash", "item", "item_shingles"]
    top, bottom = _share(threshold)
    counted = sure.groupBy(*pair, "shingle").agg(F.lit(1)).groupBy(*pair).agg(F.count("*").alias("matched"))
    return counted.where(F.col("matched") * bottom >= F.col("item_shingles") * top).select(*pair[:3], "matched", "item_shingles", (F.col("matched") / F.col("item_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    found = checkpointed(contained(docs, items, threshold).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    few = _small(found)
    work, at, restored = numbered(docs)
    same = work[at["doc_id"]].eqNullSafe(found["__id"]) & (F.xxhash64(work[at["text"]]) == found["__hash"])
    return restored(work.join(F.broadcast(found) if few else found, same, "left_anti"))


def op8_minhash_containment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained(docs, items).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "item_shingles", "containment")


def _sql_grams(table: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key}, least(len(ws), 5) n, unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' '))) g
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') ws FROM {table}) WHERE len(ws) > 0"""


OP8_SQL = f"""
WITH i AS ({_sql_grams("benchmark", "item_id")}), d AS ({_sql_grams("documents", "doc_id")}), q AS (SELECT item_id, count(*) item_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) matched, item_shingles, count(*) / item_shingles containment
FROM d JOIN i USING (n, g) JOIN q USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= {THRESHOLD} * item_shingles
"""
