"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from a naive Bayes model of hashed byte trigrams, tempered to at most ``EVIDENCE`` trigrams'
worth because neighbours overlap.  The posterior from text alone is summed by declared language, by host and by
address suffix (grouped aggregation, partial sums first); those sums give the likelihood of a declaration under each
language and a host prior smoothed towards its suffix, which is smoothed towards the whole.  A row's own part is left
out of its host and suffix.  Log evidences add up; the largest posterior names the language.

Defined cases: texts without a trigram get the prior of their host and are rejected; null hosts are one host "";
null addresses and markup count as not declared; repeated rows are scored alike; with no labelled row every
language is "und"; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary_values, checkpointed, map_rows, numbered

BUCKETS, EVIDENCE, SAMPLE_ROWS = 1 << 16, 300, 4000
#: Pseudo-counts towards the level above; and of a declaration being right before any is seen.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT, DECLARED_RIGHT = 10.0, 20.0, 50.0, 0.9
MIN_CONFIDENCE, HOST_ROWS = 0.5, 100_000
_STEP = 1 << 20


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram of a whole text, A-Z lower-cased."""
    b = np.frombuffer(text.translate(ASCII_LOWER), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    return (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _counts(batches):
    for batch in batches:
        found: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
            own = found.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for at in range(0, len(text or b""), _STEP):
                own += np.bincount(trigrams(text[at : at + _STEP + 2]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["lang", "counts"])


def fit(labelled: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from about ``rows`` labelled rows, whole texts.

    The rows are those with the smallest hashes of their key, ``2 * rows`` at the very most.
    """
    some = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col).alias("h"))
    share = rows / max(rows, labelled.count())
    some = some.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).drop("h").limit(2 * rows)
    total: dict[str, np.ndarray] = {}
    for r in map_rows(some, _counts, "lang string, counts binary").collect():  # a fixed size for each language
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], dtype=np.int64)
    langs = sorted(total)
    table = np.stack([total[k] for k in langs], axis=1) + 0.5 if langs else np.zeros((BUCKETS, 0))
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _likelihoods(batches, table: bytes, langs: int):
    log = np.frombuffer(table, dtype=np.float32).reshape(BUCKETS, langs)
    for batch in batches:
        out = np.zeros((batch.num_rows, langs + 1))
        for k, text in enumerate(binary_values(batch.column(3))):
            text = text or b""
            for at in range(0, len(text), _STEP):
                own = trigrams(text[at : at + _STEP + 2])
                out[k, :langs] += log[own].sum(axis=0, dtype=np.float64)
                out[k, langs] += len(own)
        out[:, :langs] *= np.minimum(1.0, EVIDENCE / np.maximum(out[:, langs], 1.0))[:, None]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], batch.column(4), *(pa.array(out[:, k]) for k in range(langs)), pa.array(out[:, langs].astype(np.int64))], names=["id", "host", "suffix", "declared", *(f"t{k}" for k in range(langs)), "n"]
        )


def _normal(logs: list) -> list:
    """Posteriors of log scores, as columns."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    return [p / functools.reduce(lambda a, b: a + b, parts) for p in parts]


def evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, suffix, declared, text) of web pages: tags and scripts are cut from the text."""
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), "^[a-zA-Z]+://([^/:?#]+)", 1))
    html = F.coalesce(html_col, F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>", " "), "(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.lower(F.regexp_extract(html, "(?i)<html[^>]*?\\blang\\s*=\\s*[\"']?([a-zA-Z]{2,3})", 1))
    return pages.select(F.col(id_col).alias("id"), host.alias("host"), F.regexp_extract(host, "([^.]*)$", 1).alias("suffix"), declared.alias("declared"), text.alias("text"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, language, confidence, kept) for (id, host, suffix, declared, text) rows."""
    langs, table = model
    if not langs:
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    some, span = range(len(langs)), len(langs)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    declared = F.when(blank("declared") == "", "").when(blank("declared").isin(langs), blank("declared")).otherwise("?")
    picked = rows.select("id", blank("host").alias("host"), blank("suffix").alias("suffix"), F.col("text"), declared.alias("declared"))
    kind, raw = picked.schema["id"].dataType.simpleString(), np.ascontiguousarray(table).tobytes()
    schema = f"id {kind}, host string, suffix string, declared string, " + "".join(f"t{k} double, " for k in some) + "n bigint"
    scored = map_rows(picked, lambda b: _likelihoods(b, raw, span), schema)
    alone = _normal([F.col(f"t{k}") for k in some])
    scored = checkpointed(scored.select("*", *[F.when(F.col("n") > 0, p).otherwise(0.0).alias(f"p{k}") for k, p in enumerate(alone)]))
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in some]

    whole = scored.agg(*sums).first()
    total = [(whole[k] or 0.0) + 1.0 for k in some]
    base = [x / sum(total) for x in total]
    # a declaration is one of span + 2 values
    seen = {r["declared"]: [r[f"s{k}"] for k in some] for r in scored.groupBy("declared").agg(*sums).collect()}

    def said(value, k):
        """log P(declared value | language k); nothing declared says nothing."""
        right = DECLARED_RIGHT if value == langs[k] else (1 - DECLARED_RIGHT) / span
        given = sum(v[k] for d, v in seen.items() if d)
        return float(np.log((seen.get(value, [0.0] * span)[k] + DECLARED_WEIGHT * right) / (given + DECLARED_WEIGHT)))

    def declared_col(k):
        return functools.reduce(lambda c, v: c.when(F.col("declared") == v, said(v, k)), [*langs, "?"], F.when(F.col("declared") == "", 0.0)).otherwise(0.0)

    hosts = checkpointed(scored.groupBy("suffix", "host").agg(*sums).select("suffix", "host", F.array(*[f"s{k}" for k in some]).alias("by_host"), *[f"s{k}" for k in some]))
    suffixes = hosts.groupBy("suffix").agg(*sums_of_sums(some)).select("suffix", F.array(*[f"u{k}" for k in some]).alias("by_suffix"))
    levels = checkpointed(hosts.select("suffix", "host", "by_host").join(suffixes, "suffix"))
    few = levels.limit(HOST_ROWS + 1).count() <= HOST_ROWS
    joined = scored.join(F.broadcast(levels) if few else levels, ["suffix", "host"])
    joined = joined.select("id", "n", "by_host", "by_suffix", F.array(*[f"p{k}" for k in some]).alias("p"), F.array(*[F.col(f"t{k}") + declared_col(k) for k in some]).alias("logs"))
    others = lambda c: F.zip_with(c, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))  # noqa: E731  without the row itself
    joined = joined.select("id", "n", "logs", others("by_host").alias("by_host"), others("by_suffix").alias("by_suffix"))
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda c, above, weight: F.zip_with(c, above, lambda x, up: (x + weight * up) / (total_of(c) + weight))
    fused = joined.withColumn("prior", smooth("by_suffix", F.array(*map(F.lit, base)), SUFFIX_WEIGHT)).withColumn("prior", smooth("by_host", "prior", HOST_WEIGHT))
    fused = fused.select("id", "n", F.zip_with("logs", "prior", lambda x, p: x + F.log(p)).alias("logs")).withColumn("top", F.array_max("logs"))
    after = fused.select("id", "n", F.element_at(F.array(*map(F.lit, langs)), F.array_position("logs", F.col("top")).cast("int")).alias("l"), (1 / total_of(F.transform("logs", lambda x: F.exp(x - F.col("top"))))).alias("confidence"))
    sure = (F.col("n") > 0) & (F.col("confidence") >= min_confidence)
    return after.select("id", F.when(sure, F.col("l")).otherwise("und").alias("language"), "confidence", sure.alias("kept"))


def sums_of_sums(some) -> list:
    return [F.sum(f"s{k}").alias(f"u{k}") for k in some]


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents carry no address or markup: their source is the host."""
    none = F.lit("")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"), "text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is undetermined; rows alike in all inputs share a decision."""
    rows = document_evidence(docs).withColumn("id", F.struct("id", F.xxhash64("text", "host").alias("key")))
    gone = checkpointed(identify(rows, fit(docs)).where(~F.col("kept")).select(F.col("id.id").alias("__id"), F.col("id.key").alias("__key")).distinct())
    few = gone.limit(HOST_ROWS + 1).count() <= HOST_ROWS
    work, at, restored = numbered(docs)
    same = work[at["doc_id"]].eqNullSafe(gone["__id"]) & (F.xxhash64(work[at["text"]], work[at["source"]]) == gone["__key"])
    return restored(work.join(F.broadcast(gone) if few else gone, same, "left_anti"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify(document_evidence(docs), fit(docs)).withColumnRenamed("id", "doc_id")


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    """All evidences together, on web pages; the text model is that of the labelled documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identify(evidence(pages), fit(docs)).withColumnRenamed("id", "page_id")
