"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: a bit is set if it is set in over half of the XXH64 hashes of a text's features: its word shingles
(near_groups), or its different words (keep_one).

Links: fingerprints of at most `radius` different bits. Each of the 64 bits gets a nonzero vector
of radius+1 bits, and the mask of each nonzero vector v keeps the bits whose vector is not
orthogonal to v (mod 2). The vectors of any radius bits span at most radius dimensions, so some v
is orthogonal to all of them, and its mask holds none of those bits: every pair within the radius
agrees on the whole of at least one of the 2^(radius+1)-1 masks. So buckets of equal masked bits
miss no pair.

Only different fingerprints are compared. They travel as runs of 8 bytes each, a row for each task and partition, and the
receiver makes the keys anew. Buckets above a size that coarse counts show (a fixed
number of counters, whatever the input) are dealt out again by intact pairs of runs of the bits outside
the mask, of which at least one pair is intact within the radius, so no bucket meets in one
task and no pair is lost. A task turns its links into a spanning forest before it
returns them; components of the forests are the components of all links.

keep_one takes those components as candidates alone: documents are near-duplicates if their sets of five-word
shingles have a Jaccard similarity of 0.8 or more, which is checked exactly for all pairs of a component, in blocks where
it is large. The fingerprint of different words is used as it moves least when a few words change: a changed word
is one feature of it, and five shingles.

Defined results: null text, or no words: fingerprint zero, linked like any other, and for keep_one copies of each other;
fewer words than a shingle: the whole sequence; equal texts: one fingerprint; null doc_id: kept, never the smallest
unless alone; repeated rows: one stays; long texts: taken in runs of shingles; an empty table: no rows. Other columns
are ignored by near_groups, and returned as they came by keep_one, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import column_of, sliced, shuffle_parts, stash, table, trimmed

NAME = "op2_simhash"
SQL = None
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Counters for all masks, and different fingerprints in a bucket above which it is dealt out again.
SLOTS, HOT = 1 << 17, 20_000
#: Fingerprints that a task deals at a time; tasks over which the nodes of one component are joined.
RUN, SALTS = 200_000, 32
#: Tasks whose forests of links become one.
MERGED = 16
#: Bits by which fingerprints of words may differ, and documents of a candidate group that are checked together.
WORD_RADIUS, CHECKED = 7, 128


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # lower() and split() of bytes are ASCII only


def shingle_hashes(found: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, or of all words where there are fewer."""
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    n, joined, digest = min(shingle, len(found)), b" ".join(found), xxhash.xxh64_intdigest
    firsts = np.concatenate(([0], ends[:-n])).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(firsts, (ends[n - 1 :] - 1).tolist())], dtype="<u8")


def majority(hashes: np.ndarray, run: int = 1 << 14) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), run):
        bits = np.unpackbits(hashes[a : a + run].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    found = words_of(text)
    return majority(shingle_hashes(found, shingle)) if found else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def prints(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in column_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks such that any two words within radius agree on all bits of one."""
    size = 2 ** (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit words over all their bits, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(mask: int, n: int) -> list[int]:
    """The bits of mask as n masks of like size."""
    at = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in at[k * len(at) // n : (k + 1) * len(at) // n]) for k in range(n)]


def keys(fps: np.ndarray, t: int, mask: int) -> np.ndarray:
    return mixed((fps & np.uint64(mask)) ^ mixed(np.full(1, t + 1, dtype=np.uint64)))


def near_pairs(fps: np.ndarray, key: np.ndarray, radius: int, found, depth: int = 0) -> None:
    """Calls found(i, j) with arrays of the places in fps that share a key and lie within radius."""
    order = np.argsort(key, kind="stable")
    k, x = key[order], fps[order]
    edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
    sizes = np.diff(edges)
    small = np.repeat(sizes <= 64, sizes)
    alive = np.flatnonzero(small)
    for lag in range(1, int(sizes[sizes <= 64].max(initial=1))):
        alive = alive[alive + lag < len(k)]
        alive = alive[k[alive] == k[alive + lag]]
        hit = alive[np.bitwise_count(x[alive] ^ x[alive + lag]) <= radius]
        if len(hit):
            found(order[hit], order[hit + lag])
    for g in np.flatnonzero(sizes > 64):
        a, b = int(edges[g]), int(edges[g + 1])
        own, at = x[a:b], order[a:b]
        spread = int(np.bitwise_or.reduce(own ^ own[0]))
        if b - a > 4096 and depth < 2 and spread.bit_count() >= 2 * (radius + 2):
            parts = runs(spread, radius + 2)
            for p, q in combinations(parts, 2):
                near_pairs(own, own & np.uint64(p | q), radius, lambda i, j, at=at: found(at[i], at[j]), depth + 1)
            continue
        for i in range(0, len(own), 512):
            for j in range(i, len(own), 4096):
                r, c = np.nonzero(np.bitwise_count(own[i : i + 512, None] ^ own[None, j : j + 4096]) <= radius)
                keep = r + i < c + j
                found(at[r[keep] + i], at[c[keep] + j])


class Forest:
    """Union-find over places, by arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root[:] = up


class Tables:
    """The masks, and for hot slots their pairs of runs: each table of fingerprints has a number."""

    def __init__(self, radius: int):
        self.radius, self.masks = radius, covering_masks(radius)
        self.pairs = list(combinations(range(radius + 2), 2))
        self.slots = SLOTS // (len(self.masks) + 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def keys(self, fps: np.ndarray, table: int) -> np.ndarray:
        again, t = divmod(table, len(self.masks))
        mask = self.masks[t]
        key = keys(fps, t, mask)
        if not again:
            return key
        rest = runs(~mask & (2**64 - 1), self.radius + 2)
        p, q = self.pairs[again - 1]
        sub = fps & np.uint64(rest[p] | rest[q])
        return mixed(key + mixed(sub ^ np.uint64(p * 64 + q + 1)))

    def of(self, fps: np.ndarray, hot: dict[int, np.ndarray]):
        """table, and the fingerprints and keys that it takes, for every table; hot: mask -> which slots are."""
        for t in range(len(self.masks)):
            key = self.keys(fps, t)
            if t not in hot:
                yield t, fps, key
                continue
            over = hot[t][self.slot(key)]
            yield t, fps[~over], key[~over]
            for k in range(1, len(self.pairs) + 1) if over.any() else ():
                yield k * len(self.masks) + t, fps[over], self.keys(fps[over], k * len(self.masks) + t)


def to_blob(tables: list[int], runs_: list[np.ndarray]) -> bytes:
    """Fingerprints by table: their number, the tables, the sizes of their runs, the runs."""
    head = np.array([len(tables), *tables, *map(len, runs_)], dtype="<i8")
    return head.tobytes() + b"".join(r.tobytes() for r in runs_)


def from_blob(raw) -> list[tuple[int, np.ndarray]]:
    words = np.frombuffer(raw, dtype="<u8")
    n = int(words[0])
    tables, sizes = words[1 : n + 1].astype(np.int64).tolist(), words[n + 1 : 2 * n + 1].astype(np.int64)
    return list(zip(tables, np.split(words[2 * n + 1 :], np.cumsum(sizes)[:-1])))


def forest_links(batches, tables: Tables):
    """Blobs of fingerprints by table in; links src, dst that span what is near in their buckets out."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for raw in b.column(0):
            for t, fps in from_blob(raw.as_buffer()):
                held.setdefault(t, []).append(fps)
    if not held:
        return
    nodes = np.unique(np.concatenate([np.unique(np.concatenate(x)) for x in held.values()]))
    forest = Forest(len(nodes))
    for t, some in held.items():
        fps = np.concatenate(some)
        place = np.searchsorted(nodes, fps)
        pending, size = [], 0

        def fold():
            nonlocal size
            if pending:
                forest.join(*(np.concatenate(x) for x in zip(*pending)))
            pending.clear()
            size = 0

        def found(i, j):
            nonlocal size
            pending.append((place[i], place[j]))
            size += len(i)
            if size > 2_000_000:
                fold()

        near_pairs(fps, tables.keys(fps, t), tables.radius, found)
        fold()
    tied = np.flatnonzero(forest.root != np.arange(len(nodes)))
    out = nodes.view(np.int64)
    yield pa.record_batch([pa.array(out[tied]), pa.array(out[forest.root[tied]])], ["src", "dst"])


def hot_slots(different: DataFrame, tables: Tables, hot: int = HOT) -> dict[int, np.ndarray]:
    """mask -> which of its counters hold more than a bucket may; masks without such are left out."""

    def counted(batches):
        sums = np.zeros((len(tables.masks), tables.slots), dtype=np.int64)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for t in range(len(tables.masks)):
                sums[t] += np.bincount(tables.slot(tables.keys(fps, t)), minlength=tables.slots)
        t, slot = np.nonzero(sums)
        yield pa.record_batch([pa.array(t), pa.array(slot), pa.array(sums[t, slot])], ["t", "slot", "n"])

    most = max(hot, 4 * different.count() // tables.slots)
    by_slot = different.select("fp").mapInArrow(counted, "t long, slot long, n long").groupBy("t", "slot").agg(F.sum("n").alias("n"))
    out: dict[int, np.ndarray] = {}
    for r in by_slot.where(F.col("n") > most).collect():  # under a quarter of the slots of each mask
        out.setdefault(r["t"], np.zeros(tables.slots, dtype=bool))[r["slot"]] = True
    return out


def near_links(different: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """src, dst: links that span the components of fingerprints (column fp, each once) within radius."""
    tables, parts = Tables(radius), shuffle_parts(different.sparkSession)
    again = hot_slots(different, tables, hot)

    def dealt(batches):
        held, n = [], 0

        def out():
            by_part: dict[int, tuple[list, list]] = {}  # a row for each partition, whatever the number of tables
            for t, fps, key in tables.of(np.concatenate(held), again):
                part = (key >> np.uint64(32)).astype(np.int64) * parts >> 32
                order = np.argsort(part, kind="stable")
                part, fps = part[order], fps[order]
                full, firsts = np.unique(part, return_index=True)
                for p, run in zip(full.tolist(), np.split(fps, firsts[1:])):
                    ts, fs = by_part.setdefault(p, ([], []))
                    ts.append(t)
                    fs.append(run)
            held.clear()
            blobs = [to_blob(*x) for x in by_part.values()]
            yield pa.record_batch([pa.array(list(by_part), pa.int32()), pa.array(blobs, pa.binary())], ["part", "fps"])

        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            n += b.num_rows
            if n >= RUN:
                yield from out()
                n = 0
        if held:
            yield from out()

    rows = different.select("fp").mapInArrow(dealt, "part int, fps binary").repartitionById(parts, F.col("part"))
    links = rows.select("fps").mapInArrow(lambda bs: forest_links(bs, tables), "src long, dst long")
    # a large group is spanned anew by every task that sees it; the forests of MERGED tasks become one
    groups = max(1, parts // MERGED)
    return links.repartitionById(groups, F.pmod(F.spark_partition_id(), F.lit(groups))).mapInArrow(merged_forests, "src long, dst long")


def merged_forests(batches):
    """Links in, links that span the same components out."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    src, dst = (np.concatenate(x) for x in zip(*got))
    nodes, place = np.unique(np.concatenate((src, dst)), return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(place[: len(src)], place[len(src) :])
    tied = np.flatnonzero(forest.root != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[tied]), pa.array(nodes[forest.root[tied]])], ["src", "dst"])


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to."""
    prints = stash(fingerprints(docs, shingle), "simhash")
    different = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-different")
    links = near_links(different, radius, hot)
    by_fp = rooted(different, links).select("fp", F.col("least").alias("component_id"))
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _beside(rows: DataFrame, facts: DataFrame, key: str, unique: str) -> DataFrame:
    """rows with the columns of facts for their key; the rows of one key spread over SALTS tasks."""
    salt = F.pmod(F.xxhash64(unique), F.lit(SALTS)).cast("int").alias("_salt")
    return rows.select("*", salt).join(facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), [key, "_salt"]).drop("_salt")


def rooted(nodes: DataFrame, links: DataFrame, node: str = "fp") -> DataFrame:
    """node, least: for each node, the least value of `least` in its whole component of links.

    Only nodes with links meet by component: sums come before the exchange, and what they find is joined
    by component and salt, so that a large component is no large task."""
    tied = connected_components(links).select(F.col("node").alias(node), F.col("component").alias("_root"))
    linked = stash(nodes.select(node, "least").join(tied, node), "simhash-linked")
    by_root = linked.groupBy("_root").agg(F.min("least").alias("_least"))
    found = _beside(linked.select(node, "_root"), by_root, "_root", node).select(node, "_least")
    return nodes.select(node, "least").join(found, node, "left").select(node, F.coalesce("_least", "least").alias("least"))


# ---- one document of each group: candidates by fingerprints of words, and an exact check ------------


def _word_prints(batches):
    """Rows _row, _id, text to rows _row, _id, fp, copy: the fingerprint of the different words, and a hash of the words in order."""
    for batch in sliced(batches):
        fps, copies = [], []
        for text in batch.column(2).to_pylist():
            found = words_of(text)
            hashes = [xxhash.xxh64_intdigest(w, SEED) for w in set(found)]
            fps.append(majority(np.array(hashes, dtype="<u8")) if found else 0)
            copies.append(xxhash.xxh3_128_digest(b" ".join(found)))
        fps = np.array(fps, dtype=np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(copies, pa.binary())], ["_row", "_id", "fp", "copy"])


def similar_pairs(sets: list[np.ndarray], similarity: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sorted sets with at least that Jaccard similarity; first: only pairs of one of the first sets and a later one."""
    sizes = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, holders = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    ends = np.append(starts[1:], len(values))
    slot = np.empty(len(values), np.int64)
    slot[order] = np.repeat(np.arange(len(starts)), ends - starts)
    many = np.flatnonzero((ends - starts)[slot] > 1)  # what no other set holds counts for none
    cuts = np.searchsorted(many, np.concatenate(([0], np.cumsum(sizes))))
    left, right = [], []
    for i in range(len(sets) if first is None else first):
        own = slot[many[cuts[i] : cuts[i + 1]]]
        n = (ends - starts)[own]
        if not len(n):
            continue
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        # |A and B| / |A or B| >= s, in whole numbers of a thousandth
        hit = both * 1000 >= np.int64(round(similarity * 1000)) * (sizes + sizes[i] - both)
        hit[: i + 1 if first is None else first] = False
        js = np.flatnonzero(hit)
        left.append(np.full(len(js), i))
        right.append(js)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _checked_rows(batches, similarity: float):
    """Rows group, low, high, block, node, set, all of a (group, low, high) in a row: to links that span the similar ones."""
    now, held = None, []

    def close():
        if len(held) > 1:
            low = [h for h in held if h[0] == now[1]]
            high = [h for h in held if h[0] != now[1]]
            rows = low + high
            forest = Forest(len(rows))
            forest.join(*similar_pairs([h[2] for h in rows], similarity, len(low) if now[1] != now[2] else None))
            tied = np.flatnonzero(forest.root != np.arange(len(rows)))
            nodes = np.array([h[1] for h in rows], dtype=np.int64)
            yield pa.record_batch([pa.array(nodes[tied]), pa.array(nodes[forest.root[tied]])], ["src", "dst"])
        held.clear()

    for b in batches:
        groups = zip(*(b.column(i).to_pylist() for i in range(3)))
        for key, block, node, raw in zip(groups, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
            if key != now:
                yield from close()
                now = key
            held.append((block, node, np.frombuffer(raw.as_buffer(), dtype="<u8")))
    yield from close()


def _only(rows: DataFrame, wanted: DataFrame, row: str, column: str) -> DataFrame:
    """rows whose number `row` is in wanted (column). The numbers travel to all tasks as bitmaps, a bit for each row of the
    table and no row for stretches without any, so that rows which nothing wants stay out of the exchange of a join."""
    bits = wanted.groupBy(F.bitmap_bucket_number(column).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("_bits"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(bitmap_bit_position({row}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr(f"cast(bitmap_bit_position({row}) % 8 as int)")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(row)).join(F.broadcast(bits), "_bucket")
    return met.where(F.call_function("bit_get", byte, is_set) == 1).drop("_bucket", "_bits")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WORD_RADIUS, hot: int = HOT, block: int = CHECKED) -> DataFrame:
    """One row of each group of near-duplicates, the smallest doc_id (null last), with the columns of docs.

    docs must be a table as read from files, so that its rows have the same place in all passes. Only the numbers
    of dropped rows are joined to the texts: broadcast where their written table is small, else by a shuffle. Of the texts,
    those of candidate groups alone are shuffled to be checked.
    """
    row = F.monotonically_increasing_id().alias("_row")  # stands for the id, so that repeated rows and null ids are told apart
    numbered = docs.select(F.struct(*docs.columns).alias("whole"), F.col("text").alias("_text"), row)
    by_row = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id"), "text")
    prints = stash(by_row.mapInArrow(trimmed(_word_prints), "_row long, _id long, fp long, copy binary"), "words")
    least = prints.groupBy("copy").agg(F.min(F.struct("_id", "_row")).alias("least"), F.first("fp").alias("fp"))
    nodes = stash(least.select(F.col("least._row").alias("node"), "least", "fp"), "words-different")

    # candidates: documents whose fingerprints of words links join
    different = stash(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "words-prints")
    tied = connected_components(near_links(different, radius, hot)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    groups = stash(different.join(tied, "fp", "left").select("fp", "n", F.coalesce("group", "fp").alias("group")), "words-groups")
    sizes = groups.groupBy("group").agg(F.sum("n").alias("size")).where("size > 1")
    in_groups = _beside(groups.select("fp", "group"), sizes, "group", "fp")
    members = stash(_beside(nodes.select("node", "fp"), in_groups, "fp", "node").select("node", "group", "size"), "words-members")

    def sets(batches):
        for b in sliced(batches):
            blobs = []
            for text in b.column(3).to_pylist():
                found = words_of(text)
                blobs.append(np.unique(shingle_hashes(found, shingle)).tobytes() if found else b"")
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(blobs, pa.binary())], ["node", "group", "size", "set"])

    texts = _only(numbered.select(F.col("_row").alias("node"), "_text"), members, "node", "node")
    held = texts.join(members, "node").select("node", "group", "size", "_text")
    checked = held.mapInArrow(trimmed(sets), "node long, group long, size long, set binary")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    checked = checked.withColumn("blocks", blocks).withColumn("block", own)
    checked = checked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    checked = checked.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "set")
    parts = shuffle_parts(docs.sparkSession)
    dealt = checked.repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high", "node")
    links = dealt.mapInArrow(trimmed(lambda b: _checked_rows(b, similarity)), "src long, dst long")

    kept = rooted(nodes.select("node", "least"), links, "node").where("node = least._row").select(F.col("node").alias("_row"))
    dropped = stash(prints.select("_row").join(kept, "_row", "left_anti"), "words-dropped")
    return numbered.drop("_text").join(dropped, "_row", "left_anti").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with its fingerprint and group."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
