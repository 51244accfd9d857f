"""Toxic spans by a linear-chain conditional random field.

Labels are given by document, tokens get theirs weakly: in a toxic document a token is toxic whose word, or a prefix
of it, is over-represented in toxic documents beyond chance (lower confidence limit of the log odds).  A two-state
chain is fitted to these sequences by gradient ascent on its likelihood; its emissions depend on the confidence bands
of word and prefix, its transitions let neighbours support each other.  Forward-backward marginals of every token of a
whole text are then aggregated (largest, expected number, share) by a logistic model of the document labels to the
score, and runs of tokens over one half are the offending spans.

The model is fitted on the driver from whole texts of at most ``TOXIC_ROWS`` + ``OTHER_ROWS`` labelled rows, chosen by hash.
A quarter of them takes no part in lexicon and chain: the logistic model is fitted on these, whose marginals are as those of
new documents.  Scoring has no bound.

Defined cases: null and blank texts have no token and the score of a document with no toxic token; labels that
repeat count once (toxic wins); null labels are none; without both kinds of label every score is 0; rows repeated
in the input are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, map_rows

TOXIC_ROWS, OTHER_ROWS = 2000, 4000
PREFIXES = (4, 5, 6, 7, 8)  # bytes
BANDS = np.array([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0])
_N = len(BANDS) + 1
_TOXIC_BAND = 3
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"
_CACHE = 1_000_000


def features(word: bytes) -> tuple[bytes, list[bytes]]:
    """A word's own feature and those of its prefixes."""
    w = word.strip(_STRIP)
    return b"=" + w, [b"^" + w[:n] for n in PREFIXES if len(w) >= n]


class Codes(dict):
    """word -> band of the word * bands + highest band of its prefixes."""

    def __init__(self, lexicon: dict[bytes, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word):
        own, prefixes = features(word)
        code = self.lexicon.get(own, 0) * _N + max((self.lexicon.get(p, 0) for p in prefixes), default=0)
        if len(self) > _CACHE:
            self.clear()
        self[word] = code
        return code

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        return np.fromiter((self[w] for w in words), dtype=np.int16, count=len(words))


class Chain:
    """Forward-backward over many documents at once: step t handles the t-th token of all that have one."""

    def __init__(self, codes: list[np.ndarray]):
        self.order = np.argsort([-len(c) for c in codes], kind="stable")
        lengths = np.array([len(codes[k]) for k in self.order], dtype=np.int64)
        self.flat = np.concatenate([codes[k] for k in self.order]) if len(codes) else np.zeros(0, dtype=np.int16)
        self.starts = np.cumsum([0, *lengths])[:-1].astype(np.int64)
        self.lengths = lengths
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")

    def run(self, emission: np.ndarray, transition: np.ndarray, start: float):
        """(ratio of forward messages, evidence times backward messages) of each token; their odds are forward * after."""
        (t00, t01), (t10, t11) = np.exp(transition)
        own = np.exp(np.clip(emission, -25, 25))[self.flat]
        forward, after = np.empty(len(own)), np.ones(len(own))
        for t, m in enumerate(self.active.tolist()):
            at = self.starts[:m] + t
            if t:
                before = forward[at - 1]
                forward[at] = own[at] * (t01 + before * t11) / (t00 + before * t10)
            else:
                forward[at] = own[at] * np.exp(start)
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[t]] + t
            x = own[at] * after[at]
            after[at - 1] = (t10 + t11 * x) / (t00 + t01 * x)
        return forward, own, after

    def marginals(self, emission, transition, start) -> np.ndarray:
        forward, _, after = self.run(emission, transition, start)
        odds = forward * after
        return odds / (1 + odds)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By document, in the given order: largest, sum."""
        out = np.zeros((len(self.lengths), 2))
        some = self.lengths > 0
        if some.any():
            out[some, 0] = np.maximum.reduceat(values, self.starts[some])
            out[some, 1] = np.add.reduceat(values, self.starts[some])
        back = np.empty_like(out)
        back[self.order] = out
        return back


def _band_odds(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the ascent starts: log odds of a toxic token by code, rare codes drawn to those of the same upper band."""
    n, hits = np.bincount(codes, minlength=_N * _N), np.bincount(codes, y, minlength=_N * _N)
    upper = np.maximum(np.arange(_N * _N) // _N, np.arange(_N * _N) % _N)
    rate = (np.bincount(upper, hits, minlength=_N) + 0.5) / (np.bincount(upper, n, minlength=_N) + 1.0)
    hits, misses = hits + 2 * rate[upper], n - hits + 2 * (1 - rate[upper])
    return np.log(np.maximum(hits, 1e-4) / np.maximum(misses, 1e-4))


def fit_chain(codes: list[np.ndarray], toxic: list[int], rounds: int = 40, rate: float = 0.1):
    """(emission by code, transition, start) that maximise the penalised likelihood of the weak labels."""
    chain = Chain(codes)
    flags = np.repeat(np.array(toxic, dtype=np.int64)[chain.order], chain.lengths)
    strong = np.maximum(chain.flat // _N, chain.flat % _N) >= _TOXIC_BAND
    y = (flags == 1) & strong
    first = np.zeros(len(y), dtype=bool)
    first[chain.starts[chain.lengths > 0]] = True
    later = np.flatnonzero(~first)
    w = np.zeros(_N * _N + 5)  # emission of each code, four transitions, start
    w[: _N * _N] = _band_odds(chain.flat, y)
    speed = np.zeros_like(w)
    size = np.zeros_like(w)
    seen_pairs = np.array([[np.sum(~y[later - 1] & ~y[later]), np.sum(~y[later - 1] & y[later])], [np.sum(y[later - 1] & ~y[later]), np.sum(y[later - 1] & y[later])]], dtype=float)
    scale = max(1.0, y.sum())
    for k in range(1, rounds + 1):
        emission, transition, start = w[: _N * _N], w[_N * _N : -1].reshape(2, 2), w[-1]
        forward, own, after = chain.run(emission, transition, start)
        p = forward * after / (1 + forward * after)
        miss = y - p
        x, b, t = own[later] * after[later], forward[later - 1], np.exp(transition)
        parts = np.stack([t[0, 0] + 0 * x, t[0, 1] * x, t[1, 0] * b, t[1, 1] * b * x])
        expected = (parts / parts.sum(axis=0)).sum(axis=1).reshape(2, 2)
        gradient = np.concatenate([np.bincount(chain.flat, miss, minlength=_N * _N), (seen_pairs - expected).ravel(), [miss[first].sum()]]) / scale - 0.001 * w
        speed = 0.9 * speed + 0.1 * gradient
        size = 0.99 * size + 0.01 * gradient**2
        w += rate * (speed / (1 - 0.9**k)) / (np.sqrt(size / (1 - 0.99**k)) + 1e-8) / np.sqrt(k)
    return w[: _N * _N].copy(), w[_N * _N : -1].reshape(2, 2).copy(), float(w[-1])


def summary(chain: Chain, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of (1, log odds of the largest marginal, log of the expected number, share) by document.

    The number is of squared marginals, so that a long text's many small ones add up to little.
    """
    top = np.clip(chain.sums(p)[:, 0], 1e-4, 1 - 1e-4)
    total = chain.sums(p**2)[:, 1]
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log1p(total), 10 * total / np.maximum(lengths, 1)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both labels have equal weight: their shares among the fitted rows are a matter of how many were drawn."""
    w = np.zeros(x.shape[1])
    each = len(y) / 2 / np.maximum(np.where(y == 1, y.sum(), len(y) - y.sum()), 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (each * (y - p)) - 0.1 * w)
    return w


def _document_counts(batches):
    for batch in batches:
        found: dict[bytes, list[int]] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
            own: set[bytes] = set()
            for word in set((text or b"").lower().split()):
                one, more = features(word)
                own.add(one)
                own.update(more)
            for f in own:
                found.setdefault(f, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["feature", "other", "toxic"]
        )


def _sequences(batches, lexicon):
    coder = Codes(lexicon)
    for batch in batches:
        codes = [coder.of(t).tobytes() for t in binary_values(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), batch.column(2)], names=["toxic", "codes", "late"])


def fit(labelled: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS):
    """A model of (key, text, toxic) rows, or None where a kind of label is missing; see the module for its bounds."""
    known = labelled.where("toxic IN (0, 1)").select(F.col("toxic").cast("int").alias("toxic"), "text", F.xxhash64("key").alias("h"))
    picked = [known.where(f"toxic = {k}").orderBy("h", "text").limit(n) for k, n in ((1, toxic_rows), (0, other_rows))]
    parts = max(8, known.sparkSession.sparkContext.defaultParallelism)
    rows = checkpointed(picked[0].unionByName(picked[1]).select("toxic", "text", F.expr("h & 3 = 0").alias("late")).repartition(parts, F.xxhash64("text")))
    early = rows.where("NOT late")
    totals = {r["toxic"]: r["count"] for r in early.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        early = rows  # hardly a row: all serve for both
        totals = {r["toxic"]: r["count"] for r in early.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    counts = map_rows(early.select("toxic", "text"), _document_counts, "feature binary, other bigint, toxic bigint").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("other") + 0.5) / (totals[0] + 1))
    low = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    strong = counts.where("toxic >= 3").select("feature", low.alias("low")).where(F.col("low") >= float(BANDS[0]))
    lexicon = {bytes(r["feature"]): int(np.searchsorted(BANDS, r["low"], side="right")) for r in strong.collect()}
    held = map_rows(rows.select("toxic", "text", "late"), lambda b: _sequences(b, lexicon), "toxic int, codes binary, late boolean").collect()
    parted = any(not r["late"] for r in held if r["toxic"]) and any(not r["late"] for r in held if not r["toxic"])
    first = [r for r in held if not parted or not r["late"]]
    last = [r for r in held if r["late"]]
    if len({r["toxic"] for r in last}) < 2:
        last = held
    codes = lambda some: [np.frombuffer(r["codes"], dtype=np.int16) for r in some]
    chain = fit_chain(codes(first), [r["toxic"] for r in first])
    over = Chain(codes(last))
    weights = fit_logistic(summary(over, over.marginals(*chain), np.array([len(c) for c in codes(last)])), np.array([r["toxic"] for r in last], dtype=float))
    return lexicon, chain, weights


def _runs(text: bytes, hot: np.ndarray) -> list[dict]:
    """Code point offsets of runs of toxic tokens."""
    spans, last = [], -2
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text.decode("utf-8", "replace"))):
        if hot[k]:
            if last == k - 1:
                spans[-1]["finish"] = m.end()
            else:
                spans.append({"start": m.start(), "finish": m.end()})
            last = k
    return spans


def _scored(batches, model):
    lexicon, chain_weights, weights = model
    coder = Codes(lexicon)
    for batch in batches:
        texts = binary_values(batch.column(1))
        codes = [coder.of(t) for t in texts]
        chain = Chain(codes)
        p = chain.marginals(*chain_weights)
        score = 1 / (1 + np.exp(-np.clip(summary(chain, p, np.array([len(c) for c in codes])) @ weights, -30, 30)))
        spans: list = [[] for _ in texts]
        for rank, k in enumerate(chain.order):
            own = p[chain.starts[rank] : chain.starts[rank] + chain.lengths[rank]] >= 0.5
            if own.any():
                spans[k] = _runs(texts[k], own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, kind)], names=["id", "score", "spans"])


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) a row; spans are code point offsets of toxic runs in the text."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return picked.select("id", F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,finish:int>>").alias("spans"))
    kind = picked.schema["id"].dataType.simpleString()
    return map_rows(picked, lambda b: _scored(b, model), f"id {kind}, score double, spans array<struct<start:int,finish:int>>")


def held_out(id_col):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)) == 1


def op1_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [labels.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id")).limit(n) for k, n in ((1, TOXIC_ROWS), (0, OTHER_ROWS))]
    few = checkpointed(chosen[0].unionByName(chosen[1]))  # the fixed number of rows that the model is fitted on
    model = fit(docs.join(F.broadcast(few), "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic"))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans"
    )
