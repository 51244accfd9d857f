"""SimHash near-duplicates over pivot distance tables.

Every text becomes a 64-bit fingerprint; fingerprints within ``LIMIT`` bits are linked, and documents carry
the class they reach.  A pivot table alone is a scan: one pivot keeps more than half of unrelated pairs at four
bits, so every pair would have to be looked at.  Candidates therefore meet first under exact block keys (of m
blocks, four changed bits leave m - 4 unchanged), and inside each key the pivot table does the discarding:
distances to sixteen reference fingerprints are computed once a fingerprint, a pair goes when any coordinate
differs by more than the limit (the triangle inequality, so no link is lost), and survivors are verified.

``keep_one`` links texts by the Jaccard similarity of their word shingles instead, which a few bits of a fingerprint
don't bound: fingerprints give it the first candidates, a prefix filter all others, and every link is verified exactly.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; equal fingerprints are one
class; rows repeated in the input come back repeated; an empty table gives an empty result; a null id never
becomes the name of a class that has any other id.  Columns other than the two named are not looked at.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, connected_components, map_rows, numbered

LIMIT = 4
#: Of word shingles, for the stage that keeps one document of a class; shingles taken as common, rows broadcast, bits.
SIMILAR, COMMON, BROADCAST_ROWS, BITMAP = 0.8, 200_000, 500_000, 1 << 26
#: Largest bucket compared inside one task; larger ones take the midpoint route, which is exact too.
BUCKET = 2048
_STEP = 1 << 16
_MOST = 255
#: Rows of a Hadamard matrix as reference fingerprints: any two differ in 32 bits, so coordinates are independent.
PIVOTS = np.array(
    [sum((bin(row & col).count("1") & 1) << col for col in range(64)) for row in range(1, 64, 4)], dtype=np.uint64
)


def _hashes(text: bytes | None, shingle: int):
    """Hashes of the shingles of one whole text, in order, in arrays of ``_STEP`` at most; none without a word."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    while chunk := [xxhash.xxh64_intdigest(p, 42) for p in itertools.islice(parts, _STEP)]:
        yield np.array(chunk, dtype="<u8")


def _bits(chunks) -> int:
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in chunks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one whole text (UTF-8)."""
    return _bits(_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: str | None = None) -> DataFrame:
    """(id, fp) a row, and the long column ``keep``; fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType
    names = ["id", "fp", *([keep] if keep else [])]

    def rows(batches):
        for batch in batches:
            out = [fingerprint(t, shingle) for t in binary_values(batch.column(1))]
            prints = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, *batch.columns[2:]], names=names)

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([keep] if keep else []))
    return map_rows(picked, rows, f"id {kind.simpleString()}, fp bigint" + (f", {keep} bigint" if keep else ""))


def _blocks(count: int) -> list[int]:
    width, more = divmod(64, count)
    masks, at = [], 0
    for k in range(count):
        size = width + (k < more)
        masks.append(((1 << size) - 1) << at)
        at += size
    return masks


def block_masks(distinct: int, limit: int = LIMIT) -> list[int]:
    """Masks of which two fingerprints within ``limit`` bits agree on at least one.

    More blocks give longer keys and more of them; the count follows the number of fingerprints so that a key
    holds a few by chance at any size.  Every choice finds every link.
    """
    for blocks in range(limit + 1, 2 * limit + 4):
        keep = blocks - limit
        sizes = sorted(bin(m).count("1") for m in _blocks(blocks))
        if distinct / 2 ** sum(sizes[:keep]) <= 8:
            break
    return [sum(c) for c in itertools.combinations(_blocks(blocks), keep)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _pieces(batches, most):
    """The lists of each batch as (values, ends) with about ``most`` values at a time, however many a batch holds; no list is cut."""
    for batch in batches:
        column = batch.column(0)
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield values[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
            at = to


def _links(batches, limit):
    """Spanning links of each bucket: a row is the array of fingerprints that share a key."""
    for values, ends in _pieces(batches, _STEP):
        until = np.repeat(ends, np.diff(ends, prepend=0))
        table = np.bitwise_count(values[:, None] ^ PIVOTS[None, :]).astype(np.int16)
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        at, lag = np.arange(len(values)), 1
        while len(at := at[at + lag < until[at]]):
            kept = at[np.abs(table[at] - table[at + lag]).max(axis=1) <= limit]
            kept = kept[np.bitwise_count(values[kept] ^ values[kept + lag]) <= limit]
            for x, y in zip(values[kept].tolist(), values[kept + lag].tolist(), strict=True):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            lag += 1
        pairs = [(x, find(x)) for x in parent]
        pairs = np.array([p for p in pairs if p[0] != p[1]], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def link_fingerprints(distinct: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(node, root) over distinct ``fp`` values; fingerprints with no link are absent."""
    masks = block_masks(distinct.count(), limit)
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("x"),
    ).select("fp", "x.k", "x.key")
    crowded = checkpointed(keyed.groupBy("k", "key").count().where(F.col("count") > bucket).select("k", "key"))
    some = not crowded.isEmpty()
    plain = keyed.join(crowded, ["k", "key"], "left_anti") if some else keyed
    lists = plain.groupBy("k", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    edges = map_rows(lists, lambda b: _links(b, limit), "a bigint, b bigint")
    if some:
        edges = edges.unionByName(_midpoints(keyed.join(crowded, ["k", "key"], "left_semi").select("fp").distinct(), limit))
    return connected_components(edges)


def _midpoints(crowd: DataFrame, limit: int) -> DataFrame:
    """Links among fingerprints of crowded buckets without comparing pairs.

    Two values differ in at most 2r bits exactly if some value is within r of both, so members meet at their
    midpoints: a fixed number of rows each, and at most that number of members at one midpoint.
    """
    half = (limit + 1) // 2
    flips = [0] + [sum(1 << b for b in c) for r in range(1, half + 1) for c in itertools.combinations(range(64), r)]
    spread = crowd.select("fp", F.explode(F.transform(F.lit(np.array([_signed(f) for f in flips], dtype=np.int64)), lambda f: f.bitwiseXOR(F.col("fp")))).alias("mid"))
    met = spread.groupBy("mid").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("b")).where(F.size("fps") > 1)
    pairs = met.select(F.explode("fps").alias("a"), "b").where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit) if limit % 2 else pairs


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id) a row of ``docs``; component_id is the smallest id reachable, itself included."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    by_print = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = link_fingerprints(by_print.select("fp"), limit, bucket)
    label = by_print.join(roots, by_print.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = checkpointed(label.groupBy("root").agg(F.min("first_id").alias("component_id")))  # apart from the join, so that a large class can be split
    named = checkpointed(label.join(lowest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("id", "fp", "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _set_of(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    chunks = list(_hashes(text, shingle))
    return np.unique(np.concatenate(chunks)).view(np.int64) if chunks else np.zeros(0, dtype=np.int64)


def _node(own: np.ndarray) -> int:
    """What names a set."""
    return _signed(xxhash.xxh64_intdigest(own.tobytes(), 7))


def _marks(batches, shingle):
    """(id, hash, fp, node, n, some) by row: the text's fingerprint, its set's name and size, and of every 16th set the hashes."""
    for batch in batches:
        prints, nodes, sizes, some = [], [], [], []
        for text in binary_values(batch.column(1)):
            chunks = list(_hashes(text, shingle))
            own = np.unique(np.concatenate(chunks)).view(np.int64) if chunks else np.zeros(0, dtype=np.int64)
            prints.append(_signed(_bits(chunks)))
            nodes.append(_node(own))
            sizes.append(len(own))
            some.append(own if nodes[-1] % 16 == 0 else None)
        arrays = [pa.array(prints, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(some, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["id", "hash", "fp", "node", "n", "some"])


def _bitmap(at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(places, words) of a bitmap whose words ``bits`` at ``at`` aren't zero: these alone, in order, or all if that is less."""
    if 2 * len(at) < BITMAP // 64:
        order = np.argsort(at)
        return at[order], bits[order]
    words = np.zeros(BITMAP // 64, dtype=np.uint64)
    words[at] = bits
    return None, words


def _marked(hashes: np.ndarray, at: np.ndarray | None, words: np.ndarray) -> np.ndarray:
    """By hash, 1 if the bitmap has it and else 0."""
    place = hashes.view(np.uint64) % np.uint64(BITMAP)
    word = (place >> np.uint64(6)).astype(np.int64)
    if at is None:
        own = words[word]
    elif len(at):
        near = np.searchsorted(at, word).clip(max=len(at) - 1)
        own = np.where(at[near] == word, words[near], np.uint64(0))
    else:
        own = np.zeros(len(place), dtype=np.uint64)
    return own >> (place & np.uint64(63)) & np.uint64(1)


def _new_sets(batches, shingle, wanted=None):
    """(node, set) of the texts, each set once a task; ``wanted`` has the text hashes to look at, see ``_marked``."""
    seen: set[int] = set()
    for batch in batches:
        at = np.arange(batch.num_rows)
        if wanted is not None:
            at = np.flatnonzero(_marked(batch.column(1).to_numpy(), *wanted))
        for text in binary_values(batch.column(0).take(pa.array(at))):
            own = _set_of(text, shingle)
            node = _node(own)
            if node not in seen:
                seen.add(node)
                yield node, own


def _in_batches(rows, size=1 << 20):
    """Lists of (row, length of its array) whose arrays hold about ``size`` numbers."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[1])
        if held > size:
            yield out
            out, held = [], 0
    if out:
        yield out


def largest_partner(n: int, at: np.ndarray, least: float) -> np.ndarray:
    """By place in the order, the largest set that can be similar to one of ``n`` shingles with which it shares none of those before.

    Sets of n and m share least / (1 + least) * (n + m) at least, and from place ``at`` on there are n - at.
    """
    return np.floor((n - at) * ((1 + least) / least) - n + 1e-6).astype(np.int32)


def _prefixes(batches, shingle, common, least):
    """(key, node, n, most): of each set as many shingles as a set of similarity ``least`` can't lack all of, rare ones first.

    ``most`` is the largest size of a similar set that has this shingle and none of those before it: the two share no more
    than the shingles from here on, so a text with rare shingles of its own in front finds no partner among its like.
    """

    def each():
        for node, own in _new_sets(batches, shingle):
            n = len(own)
            often = common[np.searchsorted(common, own).clip(max=len(common) - 1)] == own if len(common) else np.zeros(n, dtype=bool)
            keys = np.concatenate([own[~often], own[often]])[: n - math.ceil(least * n - 1e-9) + 1]
            yield node, keys, n, largest_partner(n, np.arange(len(keys)), least)

    for held in _in_batches(each()):
        keys, most = (np.concatenate([x[k] for x in held]) for k in (1, 3))
        lengths = [len(x[1]) for x in held]
        columns = [np.repeat(np.array([x[k] for x in held], dtype=np.int64), lengths) for k in (0, 2)]
        arrays = [pa.array(keys, pa.int64()), pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(most)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "n", "most"])


def _whole(batches, shingle, wanted):
    for held in _in_batches(_new_sets(batches, shingle, wanted)):
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([s for _, s in held], pa.list_(pa.int64()))], names=["node", "value"])


def _sketch(own: np.ndarray) -> bytes:
    """How many hashes have each of the endings; there are four to eight hashes an ending, and sixteen endings at least."""
    width = 1 << max(4, (max(len(own), 1) - 1).bit_length() - 3)
    return np.minimum(np.bincount(own & (width - 1), minlength=width), _MOST).astype(np.uint8).tobytes()


def _sketches(batches, shingle, wanted):
    each = ((n, _sketch(s), len(s)) for n, s in _new_sets(batches, shingle, wanted))
    for held in _in_batches(each):
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([(x[2], x[1]) for x in held], pa.struct([("n", pa.int32()), ("sketch", pa.binary())]))], names=["node", "value"])


def may_be_similar(x: tuple[int, bytes], y: tuple[int, bytes], least: float) -> bool:
    """From sizes and sketches: two sets share no more than the smaller count of each ending."""
    (n, x), (m, y) = ((k, np.frombuffer(s, dtype=np.uint8).astype(np.int64)) for k, s in (x, y))
    if min(n, m) < least * max(n, m) - 1e-9:
        return False
    if max(x.max(), y.max()) >= _MOST:  # counts may be cut: no bound
        return True
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    both = int(np.minimum(x, y).sum())
    return both >= least * (n + m - both) - 1e-9


def _possible(batches, least):
    for batch in batches:
        x, y = ([(v["n"], v["sketch"]) for v in batch.column(k).to_pylist()] for k in (2, 3))
        keep = [may_be_similar(p, q, least) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alike(batches, least):
    """The pairs whose sets have a Jaccard similarity of ``least`` or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _unlinked(batches, least):
    """Pairs of each bucket, a row being its (node, n, most, root), that differ in root and whose sizes and places allow the similarity."""
    for batch in batches:
        for members in batch.column(0):
            v = members.values
            node, n, most, root = (v.field(k).to_numpy() for k in ("node", "n", "most", "root"))
            order = np.argsort(n, kind="stable")
            node, n, most, root = node[order], n[order], most[order], root[order]
            until = np.searchsorted(n, np.minimum(n / least + 1e-9, most), side="right")
            for k in np.flatnonzero(until > np.arange(len(n)) + 1).tolist():
                others = k + 1 + np.flatnonzero((root[k + 1 : until[k]] != root[k]) & (most[k + 1 : until[k]] >= n[k]))
                if len(others):
                    a, b = np.minimum(node[k], node[others]), np.maximum(node[k], node[others])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


class _Texts:
    """Texts (hash, text) and, by ``marks``, the set that each has; sets are computed anew wherever they are needed.

    They take about as much room as the texts themselves, so none are stored: a pass over the texts is cheaper.
    """

    def __init__(self, texts: DataFrame, marks: DataFrame, shingle: int, least: float):
        self.texts, self.shingle, self.least, self.sent = texts, shingle, least, []
        self.held = checkpointed(marks.groupBy("node").agg(F.min("hash").alias("hash"), F.min("n").alias("n")))

    def _of(self, pairs: DataFrame, rows, kind: str) -> DataFrame:
        """``pairs`` with what ``rows`` makes of the sets of both.  Texts to look at are marked in a bitmap of fixed size, sent
        without its empty words while they are most: it lets others pass as well when there are very many, which costs time only."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        place = F.pmod(F.shiftright("hash", 6), F.lit(BITMAP // 64))
        bit = F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")
        marked = self.held.join(nodes, "node", "left_semi").groupBy(place.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bitmap = _bitmap(marked["at"].to_numpy(), marked["bits"].to_numpy().view(np.uint64))
        sent, shingle = self.texts.sparkSession.sparkContext.broadcast(bitmap), self.shingle
        self.sent.append(sent)
        values = map_rows(self.texts.select("text", "hash"), lambda b: rows(b, shingle, sent.value), f"node bigint, value {kind}").dropDuplicates(["node"])
        x, y = (values.select(F.col("node").alias(k), F.col("value").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (a, b) that are similar; sketches discard most others before whole sets travel."""
        least = self.least
        pairs = checkpointed(pairs.where("a <> b").distinct())
        pairs = checkpointed(map_rows(self._of(pairs, _sketches, "struct<n:int,sketch:binary>"), lambda b: _possible(b, least), "a bigint, b bigint"))
        found = checkpointed(map_rows(self._of(pairs, _whole, "array<bigint>"), lambda b: _alike(b, least), "a bigint, b bigint"))
        while self.sent:
            self.sent.pop().destroy()  # also the driver's file
        return found


def similar_sets(texts: DataFrame, marks: DataFrame, shingle: int, least: float = SIMILAR) -> DataFrame:
    """(node, root) over the nodes of ``marks`` (hash, fp, node, n, some): classes of the links of Jaccard similarity ``least``.

    No link is lost: in any one order, the first shingles of two similar sets (as many as a similar set can't lack all
    of) meet, and the first one that they share bounds by its places what they share at all.  The order puts shingles last
    that a sample finds often; what it misses costs time only.  Pairs first come
    from the fingerprints and from the node of each bucket that has the fewest rare shingles for its size, which is the one
    most like a group's common text, so that a large group of near copies is one class before the pairs that no link
    joins yet are looked at.
    """
    held = _Texts(texts, marks, shingle, least)
    sample = marks.where("some IS NOT NULL").dropDuplicates(["node"]).select(F.explode("some").alias("key")).groupBy("key").count().where("count >= 8")
    common = np.sort(sample.orderBy(F.desc("count"), "key").limit(COMMON).select("key").toArrow()["key"].to_numpy())
    keys = map_rows(texts.select("text", "hash"), lambda b: _prefixes(b, shingle, common, least), "key bigint, node bigint, n int, most int")
    members = F.sort_array(F.collect_set(F.struct("node", "n", "most")))
    smallest = F.array_min(F.transform("m", lambda x: x["n"]))
    buckets = keys.repartition("key").groupBy("key").agg(members.alias("m")).where(F.size("m") > 1)
    buckets = buckets.withColumn("least", smallest).select(F.filter("m", lambda x: x["most"] >= F.col("least")).alias("m")).where(F.size("m") > 1)
    buckets = checkpointed(buckets.select("m").distinct().withColumn("bucket", F.monotonically_increasing_id()))
    near = F.array_max(F.transform("m", lambda x: F.struct((x["most"] / x["n"]).alias("r"), F.bitwise_not(x["node"]).alias("k"), x["node"], x["n"], x["most"])))
    each = buckets.select("bucket", near.alias("low"), F.explode("m").alias("x")).select("bucket", "low", "x.node", "x.n", "x.most")
    fits = lambda n, m: F.least(n, m) >= least * F.greatest(n, m) - 1e-9
    prints = marks.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("low"), F.collect_set(F.struct("node", "n")).alias("nodes"))
    roots = link_fingerprints(prints.select("fp")).select(F.col("node").alias("fp"), "root")
    classed = prints.join(roots, "fp", "left").select("low", "nodes", F.coalesce("root", "fp").alias("root"))
    lows = classed.groupBy("root").agg(F.min("low").alias("a"))
    by_print = classed.select("root", F.explode("nodes").alias("b")).join(lows, "root").where(fits(F.col("a.n"), F.col("b.n"))).select("a.node", F.col("b.node").alias("b")).toDF("a", "b")
    reach = (F.col("low.most") >= F.col("n")) & (F.col("most") >= F.col("low.n"))
    stars = each.where(fits(F.col("low.n"), F.col("n")) & reach).select(F.col("low.node").alias("a"), F.col("node").alias("b"))
    links = held.alike(stars.unionByName(by_print))
    first = connected_components(links).withColumnRenamed("node", "other")
    named = each.join(first, F.col("node") == F.col("other"), "left").select("bucket", F.struct("node", "n", "most", F.coalesce("root", "node").alias("root")).alias("x"))
    open_ = named.groupBy("bucket").agg(F.collect_list("x").alias("m"), F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where("lo <> hi").select("m")
    more = held.alike(map_rows(open_, lambda b: _unlinked(b, least), "a bigint, b bigint"))
    return connected_components(links.unionByName(more))


def keep_one(docs: DataFrame, shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest doc_id stays, once.

    Classes are of links between texts whose sets of word shingles have a Jaccard similarity of ``least`` or more; texts
    without a word are one class.  A null doc_id comes after all others; rows alike in doc_id and text are copies of each
    other, while other texts under a repeated doc_id count as documents of their own.

    Rows that stay aren't shuffled: those that go are told by two hashes, and are broadcast as long as they are few.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash"))
    marks = checkpointed(map_rows(texts, lambda b: _marks(b, shingle), f"id {kind}, hash bigint, fp bigint, node bigint, n int, some array<bigint>"))
    roots = similar_sets(texts.select("text", "hash"), marks, shingle, least).withColumnRenamed("node", "other")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("m")
    by_class = marks.groupBy("node").agg(first).join(roots, F.col("node") == F.col("other"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("m").alias("m"))
    stays = by_class.select(F.xxhash64("m.id").alias("__id"), F.col("m.hash").alias("__hash"))
    rows = marks.groupBy(F.xxhash64("id").alias("__id"), F.col("hash").alias("__hash")).count()
    gone = checkpointed(rows.join(stays, ["__id", "__hash"], "left_anti").select("__id", "__hash"))
    twice = checkpointed(rows.where("count > 1").join(stays, ["__id", "__hash"], "left_semi").select("__id", "__hash"))
    work, at, restored = numbered(docs)
    work = work.withColumn("hash", F.xxhash64(at["text"]))
    found = lambda some: (F.xxhash64(work[at["doc_id"]]) == some["__id"]) & (work["hash"] == some["__hash"])
    size = gone.count() + (repeated := twice.count())
    sent = lambda some: F.broadcast(some) if size <= BROADCAST_ROWS else some  # noqa: E731  # 16 bytes each
    if not repeated:
        return restored(work.join(sent(gone), found(gone), "left_anti"))
    others = gone.unionByName(twice)
    once = work.join(sent(twice), found(twice), "left_semi").dropDuplicates([at["doc_id"], "hash"])
    return restored(work.join(sent(others), found(others), "left_anti").unionByName(once))
