"""Best-fit packing of tokenised documents with certified bin counts.

Pieces of at most `capacity` ids are dealt to groups; each group packs by best-fit decreasing and
compares its bins with the largest of several dual-feasible-function bounds. A group that meets
its bound is certified and done. A group with a gap releases its emptiest bins; the released
pieces of all such groups are dealt to fewer groups, which pack them anew, until none are released or one group
holds them all. Groups hold a bounded number of pieces whatever the input, and the pieces are a written
table, so no round tokenises again. Rows are dealt by their place, so equal rows spread over all groups.
Where groups of the largest size release nearly as many pieces as they were given, larger ones would be needed and
the round after is the last; certificate() gives the bins and the bound of any packing.

Defined results: null or empty text: one piece of one id, the end id; repeated rows and equal
doc_ids: each row has pieces of its own; ties in length: by doc_id, piece and place; null doc_id:
kept, sorted first; an empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, sliced, stash, table, trimmed
from .tokens import encoder, tokenizer_path

NAME = "op4_packing"
SQL = None
CAPACITY = 2048
#: Pieces that a group holds on average.
GROUP = 20_000
#: Bins that a group releases for each bin above its bound; pieces in the largest groups, about 400 MB.
RELEASE, LARGEST = 24, 2_000_000

#: Entries of a worker's dictionary of ids before it starts anew, about 60 MB: in the pipeline this stage runs beside a full heap.
KEPT = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes the odd length, the rest are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches):
        encode = encoder(path or tokenizer_path("byte_bpe_50k.json"), "byte", end_id, KEPT).encode
        for batch in sliced(batches):
            rows = []
            for doc_id, ids in zip(column_of(batch, "doc_id"), encode(column_of(batch, "text"))):
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(pieces), PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest of several dual-feasible-function bounds on the bins that lengths need; counts[x]
    pieces have length x. Every function f has sum f(x) <= 1 over any lengths that fit one bin."""
    x = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 25):  # rounding of (k + 1) x / C, exact where it is whole; in units of 1 / (k C)
        q, r = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int((counts * np.where(r == 0, k * x, q * capacity)).sum()) // (k * capacity)))
    for e in range(1, capacity // 2 + 1, max(1, capacity // 128)):  # small ones count nothing, those above C - e a whole bin
        f = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
        best = max(best, -(-int((counts * f).sum()) // capacity))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bins of lengths, which descend, and the fill of each bin. A bit set of the room that open bins have finds the best fit."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, fills, out = 0, [], []
    for n in lengths:
        at = some >> n
        if at and n:
            left = n + (at & -at).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            b, left = len(fills), capacity
            fills.append(0)
        out.append(b)
        fills[b] += n
        left -= n
        if left:
            room[left].append(b)
            some |= 1 << left
    return out, fills


def pack_group(lengths: np.ndarray, capacity: int, release: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin, offset, released of each length; lengths descend."""
    bins, fills = best_fit(lengths.tolist(), capacity)
    bins, fills = np.array(bins, dtype=np.int64), np.array(fills, dtype=np.int64)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    firsts = np.r_[True, bins[order][1:] != bins[order][:-1]]
    before = (ends - lengths[order])[firsts]
    offset = np.empty_like(lengths)
    offset[order] = ends - lengths[order] - before[np.cumsum(firsts) - 1]
    freed = np.zeros(len(fills), dtype=bool)
    gap = len(fills) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if release and gap > 0:
        freed[np.argsort(fills, kind="stable")[: gap * RELEASE]] = True
    return bins, offset, freed[bins]


PACKED = PIECES + ", sequence_id long, offset long, released boolean"


def _round(pieces: DataFrame, groups: int, number: int, capacity: int, parts: int, release: bool) -> DataFrame:
    """One round: pieces dealt to groups and packed there."""
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)))

    def packed(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        got = pa.Table.from_batches(batches).sort_by([("_group", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        group, length = got["_group"].to_numpy(), got["length"].to_numpy()
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            bins, offset, freed = pack_group(length[a:b], capacity, release)
            part = got.slice(a, b - a).drop_columns(["_group"])
            part = part.append_column("sequence_id", pa.array(bins + (number << 56) + (int(group[a]) << 24)))
            yield from part.append_column("offset", pa.array(offset)).append_column("released", pa.array(freed)).to_batches()

    return dealt.repartition(min(groups, parts), "_group").mapInArrow(packed, PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. Full pieces are sequences by themselves."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": F.lit(-1) - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    rest, number, out, last = pieces.where(F.col("length") < capacity), 0, [full], False
    count = rest.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while count:
        groups = -(-count // group)
        release = groups > 1 and not last
        done = stash(_round(rest, groups, number, capacity, max(parts, groups // 4), release), f"packing{number}")
        out.append(done.where("not released").drop("released"))
        rest = done.where("released").select(*pieces.columns)
        number, before, count = number + 1, count, rest.count() if release else 0
        last = group == LARGEST and count * 10 > before * 9
        if count * 2 > before:  # hardly any group met its bound: larger groups next
            group = max(group, min(4 * group, LARGEST))
    return functools.reduce(DataFrame.unionByName, out)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """The sequences of a packing, and a number that no packing of its pieces can fall below."""
    bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
    rows = packed.groupBy("length").count().collect()  # a row for each length
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows:
        counts[r["length"]] = r["count"]
    return bins, lower_bound(counts, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: documents in sequences of 2048 ids of the byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents")
    pieces = stash(token_pieces(docs), "pieces")
    return pack(pieces)
