"""Improbable-feature digests: rare byte windows in chained Bloom filters.

Every 32-byte window of a text, which zero bytes stand before and after so that each byte is in 32 windows,
has an entropy, whose exact integer form follows from the window before it. How rare an entropy is over the
whole corpus ranks the windows: the histogram is counted over all texts, and windows of next to no variety rank last.
The rarest of each NEAR windows in a row, the first of equals, is a feature. So a text of any
size has features, about one for 16 bytes, and an edit changes those near it alone. Features are hashed into Bloom
filters of 2048 bits, five bits each; a filter takes PER_FILTER features in text order and then the next is chained to it.

Likeness of two digests: each filter of the digest with fewer is held against all of the other; the
overlap of bits beyond chance, as a share of the most there can be, is taken at its best, and
the mean over filters weighs them by their features.

Equal texts have equal digests in one run, since the ranks are the run's own.

Documents are dealt by range of doc_id; an id with more rows than a range should hold, null ones among them, is
split by ranges of a hash of the text.

Defined results: null text: the empty text, whose digest is empty; two empty digests are alike (1.0), an
empty and another are not (0.0); the next of a document is by doc_id, null last, then XXH64 of the text, then text, and
the last's next is the first, also of a single row: itself; repeated rows are documents; texts of one letter have
the features that they have, if few; long texts are taken in blocks; an empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, shuffle_parts, table

NAME = "op7_fingerprints"
SQL = None
WINDOW, NEAR = 32, 32
BITS, HASHES, PER_FILTER = 2048, 5, 160
BINS = 1024
#: WINDOW * log2(WINDOW) in the integer form of entropy.
SCALE = 1 << 12
WEIGHT = np.rint(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * SCALE).astype(np.int32)
FULL = int(WEIGHT[WINDOW])
#: Bytes of texts taken at a time, and windows worked on at a time.
CHUNK, BLOCK = 2_000_000, 1 << 19
LAST_ID = (1 << 63) - 1


def entropies(x: np.ndarray) -> np.ndarray:
    """For each window of x, its entropy in BINS steps, as uint16.

    With c(b) the count of byte b, entropy is log2 WINDOW minus the mean of c log2 c. A step of the
    window changes two counts; both follow from how often the byte that enters or leaves occurs in
    the bytes on its side, which WINDOW - 1 comparisons of the text with itself shifted give for all places.
    """
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    gain = np.diff(WEIGHT)
    # entering x[i] into the bytes before it, and x[i - WINDOW] leaving those after it
    delta = gain[before]
    delta[WINDOW:] -= gain[after[:-WINDOW]]
    total = np.cumsum(delta, dtype=np.int32)[WINDOW - 1 :]
    return np.minimum((FULL - total).astype(np.int64) * BINS // FULL, BINS - 1).astype(np.uint16)


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts with zeros before, between and after, and the first window of each text, ascending, and the end.
    WINDOW - 1 zeros lie between texts, so every window holds bytes of one text alone."""
    pad = b"\0" * (WINDOW - 1)
    sizes = np.array([len(t) + WINDOW - 1 for t in texts], dtype=np.int64)
    return np.frombuffer(pad + b"".join(t + pad for t in texts), dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def entropy_histogram(texts: list[bytes]) -> np.ndarray:
    """Windows of each entropy; empty texts have none."""
    x, _ = joined_bytes([t for t in texts if t])
    out = np.zeros(BINS, np.int64)
    for a in range(0, len(x) - WINDOW + 1, BLOCK):
        out += np.bincount(entropies(x[a : a + BLOCK + WINDOW - 1]), minlength=BINS)
    return out


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest first; entropies under an eighth of the range last."""
    order = np.lexsort((np.arange(BINS), histogram))
    out = np.empty(BINS, np.uint16)
    out[order] = np.arange(BINS)
    out[: BINS // 8] = BINS
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes; the row length is a multiple of 8."""
    words = np.ascontiguousarray(windows).view("<u8").reshape(len(windows), -1)
    h = np.full(len(windows), 0x9E3779B97F4A7C15, np.uint64)
    for column in words.T:
        h = _mixed((h * np.uint64(0x100000001B3)) ^ column)
    return h


def _selected(x: np.ndarray, rank: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Ascending starts of the feature windows of texts; text k has the windows firsts[k] to firsts[k + 1]."""
    n, found = len(x) - WINDOW + 1, []
    for a in range(0, n, BLOCK):  # runs of NEAR windows that begin in the block
        score = rank[entropies(x[a : a + BLOCK + NEAR + WINDOW - 2])]
        low = (score.astype(np.uint32) << np.uint32(20)) | np.arange(len(score), dtype=np.uint32)
        have = 1
        while have < NEAR:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        owner = (low & np.uint32((1 << 20) - 1)).astype(np.int64) + a
        # runs across two texts count for neither
        across = firsts[1:-1]
        across = across[(across > a) & (across < a + len(low) + NEAR)]
        edge = np.zeros(len(low) + 1, np.int32)
        np.add.at(edge, np.clip(across - NEAR + 1 - a, 0, len(low)), 1)
        np.add.at(edge, np.clip(across - a, 0, len(low)), -1)
        found.append(owner[np.cumsum(edge[:-1]) == 0])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The hashed features of each text, in its order, each once."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    x, firsts = joined_bytes([texts[i] for i in some])
    place = _selected(x, rank, firsts)
    hashes = _hashed(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[place])
    for i, h in zip(some, np.split(hashes, np.searchsorted(place, firsts[1:-1]))):
        _, first = np.unique(h, return_index=True)
        out[i] = h[np.sort(first)]
    return out


def digest(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filters x BITS/8 bytes, features in each)."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    chain = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[chain, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits, axis=1), np.bincount(chain, minlength=n)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: mean over the filters of the smaller digest of the best normalised overlap."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) > len(b[0]) or (len(a[0]) == len(b[0]) and a[0].tobytes() > b[0].tobytes()):
        a, b = b, a
    ones_a, ones_b = (np.bitwise_count(x[0]).sum(1).astype(np.float64) for x in (a, b))
    words_a, words_b = a[0].view(np.uint64), b[0].view(np.uint64)
    best = np.empty(len(words_a))
    for i, w in enumerate(words_a):
        both = np.bitwise_count(words_b & w).sum(1)
        chance = ones_a[i] * ones_b / BITS
        most = np.minimum(ones_a[i], ones_b)
        best[i] = np.clip((both - chance) / np.maximum(most - chance, 1), 0, 1).max()
    return float((best * a[1]).sum() / a[1].sum())


def printed(d: tuple[np.ndarray, np.ndarray]) -> str:
    """The digest as text: features of the last filter, then the filters in hexadecimal."""
    return f"{int(d[1][-1]) if len(d[1]) else 0}:{d[0].tobytes().hex()}"


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of entropies over every text; tasks send BINS counts each, which Spark adds up."""

    def counted(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for some in _chunks([(t or "").encode() for t in column_of(batch, "text")]):
                total += entropy_histogram(some)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], ["bin", "n"])

    rows = docs.select("text").mapInArrow(counted, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows at most
    histogram = np.zeros(BINS, np.int64)
    for r in rows:
        histogram[r["bin"]] = r["n"]
    return ranks(histogram)


def _chunks(texts: list[bytes], size: int = CHUNK):
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


class Ranges:
    """Parts of rows by ascending (id, hash); values of id that ask for several parts are split by ranges of the hash."""

    def __init__(self, cuts: list[int]):
        """cuts: as many ascending ids as parts, the first the least; an id stands there once for each part it needs."""
        self.ids, self.parts = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
        self.base = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        k = np.maximum(np.searchsorted(self.ids, ids, side="right") - 1, 0)
        high = ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64)  # as signed hashes sort
        return self.base[k] + np.where(self.ids[k] == ids, high * self.parts[k] >> 32, self.parts[k] - 1)


def in_turn(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to parts by ascending doc_id; the first document of each part goes to the part before it too (ghost)."""
    id_, hash_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("h")
    rows = docs.select(F.col("doc_id").cast("long"), "text", id_, hash_)
    found = rows.agg(F.min("id").alias("lo"), F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("ps")).first()
    ranges = Ranges(sorted([found["lo"], *found["ps"]])[:parts] if found["lo"] is not None else [0])

    def numbered(batches):
        for batch in batches:
            part = ranges.of(*(batch.column(i).to_numpy() for i in (0, 1)))
            yield pa.record_batch([pa.array(part.astype(np.int32)), batch.column(0), batch.column(1)], ["part", "id", "h"])

    first = {int(p): (int(i), None) for p, i in zip(ranges.base, ranges.ids)}
    if ranges.parts.max() > 1:  # the first row of a range of hashes is not known beforehand: a row for each part
        keys = rows.select("id", "h").mapInArrow(numbered, "part int, id long, h long")
        first = {r["part"]: tuple(r["k"]) for r in keys.groupBy("part").agg(F.min(F.struct("id", "h")).alias("k")).collect()}
    full = sorted(first)
    to_part = {p: full[k - 1] for k, p in enumerate(full)}  # the part before, and the last before the first

    def dealt(batches):
        for batch in batches:
            ids, hashes = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "h"))
            part = ranges.of(ids, hashes)
            where, to = [np.arange(len(part))], [part]
            for k in np.flatnonzero(np.isin(ids, [i for i, _ in first.values()])):
                p = int(part[k])
                if first[p] in ((ids[k], None), (ids[k], hashes[k])):
                    where.append([k])
                    to.append([to_part[p]])
            where, to = np.concatenate(where), np.concatenate(to)
            got = pa.Table.from_batches([batch]).take(pa.array(where))
            got = got.append_column("part", pa.array(to.astype(np.int32))).append_column("ghost", pa.array(np.arange(len(to)) >= len(part)))
            yield from got.to_batches()

    out = rows.mapInArrow(dealt, "doc_id long, text string, id long, h long, part int, ghost boolean")
    return out.repartitionById(ranges.count, F.col("part")).sortWithinPartitions("ghost", "id", "h", "text")


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each document; see the module."""
    rank = corpus_ranks(docs)
    parts = parts or shuffle_parts(docs.sparkSession)

    def rows(run: list[tuple]) -> pa.RecordBatch:
        """run: documents in turn; the last only follows."""
        texts = [t for _, t in run]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = [digest(h) for some in _chunks([t.encode() for t in texts]) for h in features(some, rank)]
        altered = [digest(h) for some in _chunks([t.encode() for t in changed]) for h in features(some, rank)]
        columns = [
            pa.array([d for d, _ in run[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([printed(p) for p in prints[:-1]]),
            pa.array([printed(p) for p in altered]),
            pa.array([likeness(p, q) for p, q in zip(prints, altered)]),
            pa.array([likeness(p, q) for p, q in zip(prints, prints[1:])]),
        ]
        return pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def printed_rows(batches):
        run, size, ended = [], 0, False
        for batch in batches:
            for doc_id, text, ghost in zip(column_of(batch, "doc_id"), column_of(batch, "text"), column_of(batch, "ghost")):
                if ended:
                    continue  # equal ids and hashes at the start of the next part: the least text follows
                row = (doc_id, text or "")
                run.append(row)
                size += len(row[1])
                ended = ghost
                if size >= CHUNK and len(run) > 1 and not ended:
                    yield rows(run)
                    run, size = run[-1:], len(row[1])
        if len(run) > 1:
            yield rows(run)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_turn(docs, parts).mapInArrow(printed_rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: digests of every text and its edited form."""
    return fingerprints(table(spark, sf_dir, "documents"))
