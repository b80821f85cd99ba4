"""Substring deduplication by windows of words, dealt by prefix and hash, in place of prefix-partitioned suffix trees.

A suffix is a word position that starts a window of `window` words. Of the tree of all suffixes only the nodes of that
depth are asked for: a window that occurs at least twice. Every word of an occurrence
other than the first (smaller doc_id, then earlier start) is removed. Trees of words themselves are not built: a suffix
would travel as 20 words, ten times what it travels as here.

A suffix travels as a path: a code whose bytes are hashes of its
first 1, 2, 4 and 8 words, and a 64-bit hash of all its words, 96 bits in all. Counts of first words' bytes cut the suffixes
into groups that fit in memory; small neighbours share a group, and a byte that asks for several is split by ranges of the
hash of all words, so suffixes that begin alike, however many words, spread over all of its groups. Each group sorts its
paths, and repeated windows are runs of equal paths.

Suffixes that occur once are kept out beforehand, without loss: equal windows have equal
minimizers (the least hash of 8 words inside), so only windows whose minimizer occurs at two
places are sent. And each shard sends a path once, with its first place: later ones in
the shard are known to be repeats. A passage in every document thus costs a row per shard.

Shards are what one task of the first scan held, written as a table with a bucket for each shard; the later
passes meet their shard's texts there, without shuffling texts.

Defined results: null text: no words; fewer words than a window: nothing removed; overlapping
windows of one document count; equal doc_ids: each row a document, in order of shard and place; null
doc_id: after all others; repeated rows: all windows but the first row's go; long texts are whole in one task; an empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_parts, stash, table

NAME = "op3_substrings"
SQL = None
WINDOW, GRAM = 20, 8
#: Suffixes in a group at most, as far as prefixes can split them: about 80 MB.
GROUP = 4_000_000
LAST_ID = (1 << 63) - 1
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashed sequences in a row."""
    x = (a * C1) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * C2
    return x ^ (x >> np.uint64(29))


class Shingled:
    """Hashes of the runs of 1, 2, 4, ... words that start at each word of a document."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        self.w = {1: np.array([digest(x) for x in words], dtype=np.uint64)}

    def of(self, k: int) -> np.ndarray:
        """One hash for each start of k words."""
        if k not in self.w:
            big = 1 << (k.bit_length() - 1)
            a = big // 2 if big == k else big
            left, right = self.of(a), self.of(k - a)
            n = max(0, len(self.w[1]) - k + 1)
            self.w[k] = joined(left[:n], right[a : a + n])
        return self.w[k]

    def codes(self, starts: np.ndarray) -> np.ndarray:
        """The prefix codes of suffixes."""
        out = np.zeros(len(starts), dtype=np.uint32)
        for k in (1, 2, 4, 8):
            out = (out << np.uint32(8)) | (self.of(k)[starts] >> np.uint64(56)).astype(np.uint32)
        return out


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over each run of width values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def minimizers(s: Shingled, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of each window, and the hashes at the places that are a minimizer of some window."""
    span = window - GRAM + 1
    grams = s.of(GRAM)
    if len(grams) < span:
        return grams[:0], grams[:0]
    least = sliding(grams, span)
    top = sliding(np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64))), span, np.maximum)
    return least, grams[top == grams]


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _rows(*columns) -> pa.RecordBatch:
    names = [c[0] for c in columns]
    return pa.record_batch([pa.array(c[1], c[2]) for c in columns], names)


# ---- pass 1: minimizers of each shard to buckets, repeated ones back to the shards ------------


def _minimizer_rows(batches, buckets: int, window: int):
    held: dict[int, list] = {}

    def close(t: int):
        anchors, counts = held.pop(t)
        values, times = np.unique(np.concatenate(anchors), return_counts=True)
        many = times > 1
        place = (values >> np.uint64(40)).astype(np.int64) * buckets >> 24
        order = np.lexsort((~many, place))
        values, many, place = values[order], many[order], place[order]
        edges = np.searchsorted(place, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        blobs = [values[edges[b] : edges[b + 1]].tobytes() for b in full] + [counts.tobytes()]
        multi = [int(many[edges[b] : edges[b + 1]].sum()) for b in full] + [-1]
        bucket = [*full.tolist(), t % buckets]
        return _rows(("bucket", bucket, pa.int32()), ("t", [t] * len(bucket), pa.int32()), ("multi", multi, pa.int32()), ("blob", blobs, pa.binary()))

    for batch in batches:
        for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t not in held:
                yield from [close(x) for x in list(held)]
                held[t] = [[np.zeros(0, np.uint64)], np.zeros(256, np.int64)]
            s = Shingled(split(text))
            least, anchors = minimizers(s, window)
            if len(least):
                held[t][0].append(anchors)
                held[t][1] += np.bincount(s.of(1)[: len(least)] >> np.uint64(56), minlength=256)
    yield from [close(x) for x in list(held)]


def _repeated_rows(batches):
    """Of each partition: the values seen twice, for each shard that has them; summed counts as t = -1."""
    counts, ts, values, multi = np.zeros(256, np.int64), [], [], []
    for batch in batches:
        for t, m, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if m < 0:
                counts += np.frombuffer(blob, np.int64)
                continue
            ts.append(t)
            values.append(np.frombuffer(blob, np.uint64))
            multi.append(values[-1][:m])
    yield _rows(("t", [-1], pa.int32()), ("blob", [counts.tobytes()], pa.binary()))
    if not ts:
        return
    seen, times = np.unique(np.concatenate(values), return_counts=True)
    twice = seen[times > 1]
    twice = np.union1d(twice, np.concatenate(multi))
    for t, v in zip(ts, values):
        if len(got := v[np.isin(v, twice, assume_unique=True)]):
            yield _rows(("t", [t], pa.int32()), ("blob", [got.tobytes()], pa.binary()))


# ---- pass 2: suffixes of each shard to groups ---------------------------------------------------


class Prefixes:
    """Groups of suffixes of like size: neighbouring first bytes together, or ranges of the whole hash within one."""

    def __init__(self, counts: np.ndarray, most: int):
        self.base, self.parts = np.zeros(256, np.int64), np.ones(256, np.int64)
        group, size = 0, 0
        for slot, n in enumerate(counts.tolist()):
            k = -(-n // most)
            if k > 1 or size + n > most:
                group, size = group + (size > 0), 0
            self.base[slot], self.parts[slot] = group, max(1, k)
            size += n
            if k > 1:
                group, size = group + k, 0
        self.count = int(group + 1)

    def of(self, codes: np.ndarray, paths: np.ndarray) -> np.ndarray:
        slot = codes >> np.uint32(24)
        return self.base[slot] + ((paths >> np.uint64(32)).astype(np.int64) * self.parts[slot] >> 32)


def _in_order(texts: pa.Table) -> tuple[list, list]:
    got = texts.select(["row", "doc_id", "text"]).sort_by("row")
    return got["doc_id"].to_pylist(), got["text"].to_pylist()


def _suffix_rows(texts: pa.Table, known: pa.Table, prefixes: Prefixes, window: int) -> pa.Table:
    schema = pa.schema([("group_id", pa.int64()), ("t", pa.int32()), ("blob", pa.binary())])
    blobs = known["blob"].to_pylist()
    if not texts.num_rows or not blobs:
        return schema.empty_table()
    t, twice = texts["t"][0].as_py(), np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]))
    doc_ids, all_texts = _in_order(texts)
    parts, before = [], 0
    for doc_id, text in zip(doc_ids, all_texts):
        s = Shingled(split(text))
        least, _ = minimizers(s, window)
        if len(least):
            at = np.minimum(np.searchsorted(twice, least), len(twice) - 1)
            starts = np.flatnonzero(twice[at] == least)
            if len(starts):
                ids = np.full(len(starts), LAST_ID if doc_id is None else doc_id, np.int64)
                parts.append((s.codes(starts), s.of(window)[starts], ids, starts + before))
        before += len(s.w[1])
    if not parts:
        return schema.empty_table()
    code, path, doc, place = (np.concatenate(x) for x in zip(*parts))
    group = prefixes.of(code, path)
    order = np.lexsort((place, doc, path, code, group))
    group, code, path, doc, place = group[order], code[order], path[order], doc[order], place[order]
    first = np.concatenate(([True], (code[1:] != code[:-1]) | (path[1:] != path[:-1])))
    out = [(-1, place[~first].astype("<i8").tobytes())] if not first.all() else []
    group, code, path, doc, place = group[first], code[first], path[first], doc[first], place[first]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:]):
        out.append((int(group[a]), pack(code[a:b], path[a:b], doc[a:b], place[a:b])))
    return pa.table([pa.array([g for g, _ in out], pa.int64()), pa.array([t] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=schema)


def pack(code: np.ndarray, path: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Columns one after the other; doc and place in as few bytes as their range needs."""
    out = [np.int64(len(code)).tobytes(), code.tobytes(), path.tobytes()]
    for x in (doc, place):
        low = int(x.min())
        width = max(1, (int(x.max()) - low).bit_length() + 7 >> 3)
        planes = (x - low).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
        out += [np.int64(low).tobytes(), np.int64(width).tobytes(), planes.T.tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [np.frombuffer(raw, np.uint32, n, 8), np.frombuffer(raw[8 + 4 * n : 8 + 12 * n], np.uint64, n)], 8 + 12 * n
    for _ in range(2):
        low, width = np.frombuffer(raw[at : at + 16], np.int64)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * int(width), at + 16).reshape(int(width), n).T
        out.append(wide.view("<i8").ravel() + low)
        at += 16 + n * int(width)
    return tuple(out)


def repeats(code: np.ndarray, path: np.ndarray, doc: np.ndarray, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The occurrences of repeated windows of one group, without each one's first: places in the arrays."""
    order = np.lexsort((place, shard, doc, path, code))
    same = (code[order][1:] == code[order][:-1]) & (path[order][1:] == path[order][:-1])
    return order[1:][same]


def _removed_rows(batches):
    """Rows group_id, t, blob, ascending by group, to rows t, blob of the places to remove."""
    now, held = None, []

    def close():
        if len(held) > 1:
            columns = [unpack(raw) for _, raw in held]
            shard = np.repeat([t for t, _ in held], [len(c[0]) for c in columns])
            code, path, doc, place = (np.concatenate(x) for x in zip(*columns))
            later = repeats(code, path, doc, shard, place)
            order = later[np.argsort(shard[later], kind="stable")]
            ts, firsts = np.unique(shard[order], return_index=True)
            for t, places in zip(ts.tolist(), np.split(place[order], firsts[1:])):
                yield _rows(("t", [t], pa.int32()), ("blob", [places.astype("<i8").tobytes()], pa.binary()))
        held.clear()

    for batch in batches:
        for group, t, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if group == -1:
                yield _rows(("t", [t], pa.int32()), ("blob", [blob], pa.binary()))
                continue
            if group != now:
                yield from close()
                now = group
            held.append((t, blob))
    yield from close()


# ---- pass 3: texts without the removed words ----------------------------------------------------


def _kept(texts: pa.Table, removed: pa.Table, window: int) -> list[tuple]:
    """doc_id, words, which are kept (None: all)."""
    blobs = removed["blob"].to_pylist()
    places = np.sort(np.concatenate([np.frombuffer(b, "<i8") for b in blobs])) if blobs else np.zeros(0, np.int64)
    before = 0
    for doc_id, text in zip(*_in_order(texts)):
        found = split(text)
        a, b = np.searchsorted(places, (before, before + len(found)))
        keep = None
        if b > a:
            edge = np.zeros(len(found) + 1, np.int32)
            np.add.at(edge, places[a:b] - before, 1)
            np.add.at(edge, places[a:b] - before + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
        before += len(found)
        yield doc_id, found, keep


def _digest_rows(texts: pa.Table, removed: pa.Table, window: int) -> pa.Table:
    ids, n, gone, sha = [], [], [], []
    for doc_id, found, keep in _kept(texts, removed, window):
        left = found if keep is None else list(compress(found, keep.tolist()))
        ids.append(doc_id)
        n.append(len(found))
        gone.append(len(found) - len(left))
        sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _text_rows(texts: pa.Table, removed: pa.Table, window: int) -> pa.Table:
    rows = [(d, (b" ".join(w if k is None else compress(w, k.tolist()))).decode()) for d, w, k in _kept(texts, removed, window)]
    return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})


def bucket_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n buckets the least number that Spark's bucketing puts there, so that each key has a bucket of its own."""
    found: dict[int, int] = {}
    start, size = 0, 16 * n + 64
    while len(found) < n:
        ids = spark.range(start, start + size).select(F.col("id").cast("int").alias("i"))
        for r in ids.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("b")).agg(F.min("i").alias("i")).collect():  # a row for each bucket
            found.setdefault(r["b"], r["i"])
        start += size
    return [found[b] for b in range(n)]


def shards(docs: DataFrame) -> DataFrame:
    """The written table t, row, doc_id, text; each task of this scan is a shard t and a bucket by itself."""
    spark = docs.sparkSession
    buckets = max(1, docs.rdd.getNumPartitions())
    keys = bucket_keys(spark, buckets)

    def numbered(batches):
        t = keys[TaskContext.get().partitionId() % buckets]
        for b in batches:
            yield b.set_column(0, "t", pa.array(np.full(b.num_rows, t, np.int32)))

    rows = docs.select(F.lit(0).alias("t"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    rows = rows.mapInArrow(numbered, "t int, row long, doc_id long, text string")
    name = f"shards_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "t").sortBy("t").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _deduplicated(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    texts = shards(docs)
    parts = shuffle_parts(docs.sparkSession)
    sent = texts.select("t", "text").mapInArrow(lambda b: _minimizer_rows(b, parts, window), "bucket int, t int, multi int, blob binary")
    known = stash(sent.repartitionById(parts, F.col("bucket")).mapInArrow(_repeated_rows, "t int, blob binary"), "minimizers")
    sums = known.where("t = -1").select("blob").collect()  # a row of fixed size for each partition
    counts = np.sum([np.frombuffer(r["blob"], np.int64) for r in sums], axis=0) if sums else np.zeros(256, np.int64)
    prefixes = Prefixes(counts, min(GROUP, max(20_000, int(counts.sum()) // (8 * parts))))
    suffixes = texts.groupBy("t").cogroup(known.where("t >= 0").groupBy("t")).applyInArrow(
        lambda left, right: _suffix_rows(left, right, prefixes, window), "group_id long, t int, blob binary"
    )
    # places that a shard removed by itself pass through, dealt by shard
    part = F.pmod(F.when(F.col("group_id") < 0, F.col("t")).otherwise(F.col("group_id")), F.lit(parts)).cast("int")
    dealt = suffixes.repartitionById(parts, part).sortWithinPartitions("group_id")
    removed = stash(dealt.mapInArrow(_removed_rows, "t int, blob binary"), "removed")
    return texts.groupBy("t").cogroup(removed.groupBy("t")).applyInArrow(lambda left, right: finish(left, right, window), schema)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return _deduplicated(docs, window, _digest_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and what is left of its text: the kept words joined by one space."""
    return _deduplicated(docs, window, _text_rows, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: windows of 20 words over all texts."""
    return removal_digests(table(spark, sf_dir, "documents"))
