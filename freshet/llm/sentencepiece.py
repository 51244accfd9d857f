"""SentencePiece encoding and decoding as shortest paths through weighted finite-state transducers.

``compile_model`` turns a model file into three transducers: the normaliser (blank to the meta symbol, a dummy prefix,
blanks kept or squeezed as the model says), a trie of pieces whose final states carry ids and weights, and byte fallback
for characters with no piece.  A text is composed with them position by position and the path of least weight
in the tropical semiring gives the ids.

Weights: a unigram model's are negated piece scores.  A merge (BPE) model is not a sum of scores, so there the
acceptor of valid neighbours is composed in as well: an arc costs nothing where merging the two neighbouring pieces'
characters gives just these two pieces, and is absent otherwise.  Every prefix of a text has exactly one such path,
which is the model's own segmentation, so one state a position is enough.

Where no piece goes on after a symbol with a meta symbol, texts fall apart at blanks and paths of the parts are kept in
a bounded cache.  Decoding concatenates piece bytes, byte pieces included, and undoes the normaliser.

Defined cases: null and empty texts have no ids; a text that holds U+2581 itself decodes to a blank there, and so is
reported as not round; a model with a character map is refused; each row is on its own; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import re
import sys
import types
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, map_rows

META = "▁"
_META = META.encode()
CACHE = 400_000
_ROWS = 256


class Model:
    """The compiled transducers of one model; plain data, so that it travels to executors."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool, dummy_prefix: bool, squeeze: bool):
        """``pieces``: text, score and kind (normal, unknown, control, byte, unused) by id."""
        self.merges, self.dummy_prefix, self.squeeze = merges, dummy_prefix, squeeze
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.names = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((k for k, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
        self.out = [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else b" \xe2\x81\x87 " if kind == "unknown" else p.replace(META, " ").encode() for p, _, kind in pieces]
        self.longest = max(map(len, self.ids), default=1)
        #: Length of the longest piece by its first four characters; other pieces have three at most.
        self.reach: dict[str, int] = {}
        for p in filter(lambda p: len(p) > 3, self.ids):
            self.reach[p[:4]] = max(len(p), self.reach.get(p[:4], 0))
        self.chars = {p for p in self.ids if len(p) == 1}
        self.least = min((s for (_, s, kind) in pieces if kind == "normal"), default=0.0) - 10.0
        #: The trie's states: a prefix of a piece is a state; a piece is a final one.
        self.states = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        inner = any(META in p.lstrip(META) for p in self.ids)
        self.parts = re.compile(rb"(?s).+" if inner else rb" *[^ \n]+| +|\n")

    def normalise(self, text: bytes) -> bytes:
        """Blanks stand for meta symbols here, in UTF-8: as keys of the cache they take less room."""
        text = text.replace(_META, b" ")
        if self.squeeze:
            text = re.sub(b" +", b" ", text.strip(b" "))
        return b" " + text if text and self.dummy_prefix else text

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge procedure itself, for short strings: best score first, leftmost among equals."""
        symbols = list(symbols)
        while True:
            best, where = None, -1
            for k in range(len(symbols) - 1):
                found = self.ids.get(symbols[k] + symbols[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, where = self.scores[found], k
            if best is None:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def path(self, part: str, pairs: dict) -> tuple[int, ...]:
        """Ids along the least path of one normalised part."""
        if not self.merges:
            return self.least_path(part)
        if self.chars.issuperset(part):
            return tuple(self.free_path(part, pairs))
        out: list[int] = []
        for known, run in itertools.groupby(part, self.ids.__contains__):  # no merge crosses a character without a piece
            text = "".join(run)
            out.extend(self.free_path(text, pairs) if known else itertools.chain.from_iterable(map(self.fallback, text)))
        return tuple(out)

    def least_path(self, part: str) -> tuple[int, ...]:
        """Weights are negated scores: the relaxation of the lattice, position by position."""
        n, ids, states = len(part), self.ids, self.states
        cost, back = [0.0] + [float("inf")] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            if part[at] not in ids and cost[at] - self.least < cost[at + 1]:
                cost[at + 1], back[at + 1] = cost[at] - self.least, (at, -1)
            end = at + 1
            while end <= n and (piece := part[at:end]) in states:
                found = ids.get(piece)
                if found is not None and cost[at] - self.scores[found] < cost[end]:
                    cost[end], back[end] = cost[at] - self.scores[found], (at, found)
                end += 1
        out: list[tuple[int, ...]] = []
        at = n
        while at:
            start, found = back[at]
            out.append((found,) if found >= 0 else self.fallback(part[start]))
            at = start
        return tuple(itertools.chain.from_iterable(reversed(out)))

    def free_path(self, part: str, pairs: dict) -> list[int]:
        """Arcs cost nothing or are absent, so the first whole path is the least.

        Arcs are tried longest first.  As a prefix has one path only, a position that once led nowhere never will.
        """
        n, get, reach, known = len(part), self.ids.get, self.reach.get, pairs.get
        path: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, most, last = 0, n, -1
        while at < n:
            for end in range(min(most, at + reach(part[at : at + 4], 3)), at, -1):
                found = get(part[at:end])
                if found is not None and end not in dead:
                    valid = known((last + 1) << 32 | found)
                    if self.joined(last, found, pairs) if valid is None else valid:
                        path.append(found)
                        starts.append(at)
                        at, most, last = end, n, found
                        break
            else:
                if not path:
                    raise ValueError(f"no path through {part[:100]!r}")
                dead.add(at)
                most = at - 1
                at = starts.pop()
                path.pop()
                last = path[-1] if path else -1
        return path

    def joined(self, left: int, right: int, pairs: dict) -> bool:
        """Whether merging leaves ``right`` whole, after ``left`` if there is one."""
        names = [self.names[k] for k in (left, right) if k >= 0]
        valid = pairs[(left + 1) << 32 | right] = self.merged(list("".join(names))) == names
        return valid

    def encode(self, text: bytes, cache: Paths | None = None) -> np.ndarray:
        cache = Paths(self) if cache is None else cache
        return np.frombuffer(b"".join(map(cache.__getitem__, self.parts.findall(self.normalise(text)))), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.out.__getitem__, ids))
        return text[1:] if self.dummy_prefix and text[:1] == b" " else text


class Paths(dict):
    """normalised part -> its ids as 32-bit integers, computed when first asked for.

    Half the places are for recent parts; when these are full they become the old ones, and an old part that is asked
    for again is recent again, so that frequent parts stay.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.pairs, self.old = model, {}, {}

    def __missing__(self, part: bytes) -> bytes:
        found = self.old.get(part)
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = array("i", self.model.path(part.decode().replace(" ", META), self.pairs)).tobytes()
        if len(part) < 64:
            if 2 * len(self) >= CACHE:
                self.old = self.copy()
                self.clear()
            self[part] = found
        return found


def compile_model(path: str) -> Model:
    """Read a SentencePiece model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as wire

    proto = wire.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("models with a character map or blanks as suffixes aren't supported")
    if proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    names = {1: "normal", 2: "unknown", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
    return Model([(p.piece, p.score, names[p.type]) for p in proto.pieces], proto.trainer_spec.model_type == 2, norm.add_dummy_prefix, norm.remove_extra_whitespaces)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _worker_paths(key: str, raw: bytes) -> Paths:
    """One cache for all tasks of a Python worker."""
    import pickle

    held = sys.modules.setdefault("_freshet_worker", types.ModuleType("_freshet_worker")).__dict__
    if held.get("key") != key:
        held.update(key=key, paths=Paths(pickle.loads(raw)))
    return held["paths"]


def _encoded(batches, key, raw):
    paths = _worker_paths(key, raw)
    model = paths.model
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            ids, ends, round_trip = [], [0], []
            for text in binary_values(batch.column(0)):
                own = model.encode(text or b"", paths)
                ids.append(own)
                ends.append(ends[-1] + len(own))
                round_trip.append(model.decode(own.tolist()) == (text or b""))
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([tokens, pa.array(np.diff(ends), pa.int64()), pa.array(round_trip, pa.bool_()), *batch.columns[1:]], names=["token_ids", "n_tokens", "round_trip", *batch.schema.names[1:]])


def _decoded(batches, key, raw):
    model = _worker_paths(key, raw).model
    for batch in batches:
        texts = [None if x is None else model.decode(x).decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=["text", *batch.schema.names[1:]])


def _shipped(model: Model) -> tuple[str, bytes]:
    import hashlib

    from pyspark import cloudpickle

    raw = cloudpickle.dumps(model)
    return hashlib.sha256(raw).hexdigest(), raw


def encode(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(token_ids, n_tokens, round_trip) and all columns of ``docs`` but the text; those of these names are replaced."""
    others = [f for f in docs.schema if f.name not in (text_col, "token_ids", "n_tokens", "round_trip")]
    key, raw = _shipped(model or compile_model(default_model()))
    types_ = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    return map_rows(
        docs.select(F.col(text_col).cast("string"), *[f.name for f in others]), partial(_encoded, key=key, raw=raw), "token_ids array<int>, n_tokens bigint, round_trip boolean" + types_
    )


def decode(rows: DataFrame, ids_col: str = "token_ids", model: Model | None = None) -> DataFrame:
    """(text) and all columns of ``rows`` but the ids."""
    others = [f for f in rows.schema if f.name not in (ids_col, "text")]
    key, raw = _shipped(model or compile_model(default_model()))
    types_ = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    return map_rows(rows.select(ids_col, *[f.name for f in others]), partial(_decoded, key=key, raw=raw), "text string" + types_)


def op5_sentencepiece_paths(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "round_trip", "token_ids")
