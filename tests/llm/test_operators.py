"""Each operator against a brute-force version, and on the awkward tables all must bear."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from broadsheet.llm import fingerprints, mixing, packing, pages, pii, quality, rangecoder, simhash, substrings, tokenids, tokens, toxicity
from broadsheet.llm.common import trimmed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, target int, copies string, t int, row int, part int, ghost string, "
    "kept int, score string, fp string, n_words string, key string, html string, url int, `group` int, label int, base_failed string"
)


def _row(doc_id, text, source="s1", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, "y", 2, 3, 4, "g", 5, "z", "f", "w", "k", "h", 6, 7, 8, "b")


def _words(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = _words(99, 60)
    long = _words(1, 30_000)
    out = [_row(1, _words(1, 300) + " " + passage), _row(2, None, None, None), _row(3, ""), _row(None, "no id at all " + passage), _row(4, long, "s2")]
    out += [_row(5, "same row twice " + _words(5, 90))] * 2
    out += [_row(6, _words(1, 300) + " " + passage, "s3"), _row(7, " \t\n \x0b", "s3"), _row(8, "one", "s4", "de"), _row(9, "to " * 200, "s2")]
    out += [_row(10 + k, _words(50 + k, 40 + k) + "\n" + "line again\n" * (k % 3) + "é# $ñ", f"s{k % 5}") for k in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingle_print(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(found[k : k + 4]) for k in range(max(1, len(found) - 3))] if found else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# ---- mixing ---------------------------------------------------------------------------------


def test_mixing_targets_and_takes(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max([len(WORD.findall(r[1] or "")) for r in rows if r[3] == s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))


def test_mixing_emits_columns_as_they_came(spark, empty):
    """Names of the columns that the mix adds may be there before."""
    table = spark.createDataFrame([(k, "a b c " * (k % 5), f"s{k % 3}", "MINE", 777, "own", 3, "x") for k in range(40)], "doc_id long, text string, source string, size string, target int, copies string, phase int, whole string")
    out = mixing.emit_copies(table)
    assert out.schema == table.schema
    assert {tuple(r)[3:] for r in out.collect()} == {("MINE", 777, "own", 3, "x")}
    assert mixing.emit_copies(empty).columns == empty.columns


def test_mixing_emits_copies(docs, empty):
    plan = Counter()
    for r in mixing.mix_sources(docs).collect():
        plan[r["doc_id"], r["text"]] += r["copies"]
    out = mixing.emit_copies(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +plan
    assert mixing.mix_sources(empty).count() == 0 == mixing.emit_copies(empty).count()


# ---- near-duplicates ----------------------------------------------------------------------------


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(4)
    rng = random.Random(4)
    for _ in range(20_000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & x == 0 for m in masks)


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash_links_as_brute_force(spark, hot):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(30)} | set(base)
    fps = sorted(fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(signed(v), k) for k, v in enumerate(fps)], "fp long, least long").repartition(3)
    got = {r["fp"]: r["least"] for r in simhash.rooted(table, simhash.near_links(table, 4, hot)).collect()}
    assert got == {signed(v): find(k) for k, v in enumerate(fps)}


def test_simhash_groups(docs, rows, empty):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    prints = [(r[0], _shingle_print(r[1])) for r in rows]
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter(prints)
    for r in got:
        near = {r["fp"] % (1 << 64)}
        while True:
            more = {q for _, q in prints if any((q ^ p).bit_count() <= 4 for p in near)}
            if more <= near:
                break
            near |= more
        ids = [i for i, q in prints if q in near and i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 6 not in ids and ids.count(5) == 1
    assert simhash.near_groups(empty).count() == 0 == simhash.keep_one(empty).count()


def _similar_groups(texts, radius=7, similarity=0.8):
    """Places by group: linked by similarity of five-word shingles, among texts that fingerprints of words join."""
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = []
    for w in words:
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in set(w)]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))

    def groups(linked):
        root = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if root[i] != root[j] and linked(i, j):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    near = groups(lambda i, j: (prints[i] ^ prints[j]).bit_count() <= radius)
    return groups(lambda i, j: words[i] == words[j] or (near[i] == near[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])))


@pytest.mark.parametrize("block, hot", [(simhash.CHECKED, simhash.HOT), (3, 3)])
def test_keep_one_as_brute_force(spark, docs, rows, tmp_path, block, hot):
    rng = random.Random(7)
    texts = []
    for k in range(12):
        words = _words(1000 + k, rng.randint(20, 200)).split()
        for _ in range(rng.choice((1, 2, 9))):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append((" " if rng.random() < 0.5 else "\n").join(own))
    texts += [texts[3]] * 3 + [texts[5].upper(), None, "", " ", "one two", "one two", "One two three"]
    ids = [None if k % 7 == 0 else rng.randrange(50) for k in range(len(texts))]
    schema = "doc_id long, text string, _row string, fp int, node long, whole string, _text string"
    spark.createDataFrame([(i, t, "own", k, 1, "w", "x") for k, (i, t) in enumerate(zip(ids, texts))], schema).repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    out = simhash.keep_one(table, block=block, hot=hot)
    assert out.schema == table.schema
    kept = [r["fp"] for r in out.collect()]
    root = _similar_groups(texts)
    assert len(set(root)) < 40 and sorted(root[k] for k in kept) == sorted(set(root))
    for k in kept:
        assert (ids[k] is None, ids[k] or 0) == min((ids[j] is None, ids[j] or 0) for j in range(len(ids)) if root[j] == root[k])


def test_similar_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) > 0}
    assert set(zip(*(x.tolist() for x in simhash.similar_pairs(sets, 0.4)))) - want <= {(i, j) for i in range(60) for j in range(60) if not len(sets[i]) and not len(sets[j])}
    assert want <= set(zip(*(x.tolist() for x in simhash.similar_pairs(sets, 0.4))))
    assert {p for p in want if p[0] < 20 <= p[1]} == set(zip(*(x.tolist() for x in simhash.similar_pairs(sets, 0.4, 20)))) - set()


# ---- substrings -------------------------------------------------------------------------------


def _brute_substrings(rows, window):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for r in order:
        found = WORD.findall(r[1] or "")
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            x = tuple(found[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        kept = " ".join(w for w, g in zip(found, gone) if not g)
        out.append((r[0], len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group", [substrings.GROUP, 50])
def test_substrings(docs, rows, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    got = Counter(tuple(r) for r in substrings.removal_digests(docs).collect())
    assert got == _brute_substrings(rows, 20)


def test_substrings_within_a_document_and_empty(spark, empty):
    table = spark.createDataFrame([(1, "a b c " * 60), (2, "x " * 19), (3, "x " * 21)], "doc_id long, text string")
    got = Counter(tuple(r) for r in substrings.removal_digests(table).collect())
    assert got == _brute_substrings([(1, "a b c " * 60), (2, "x " * 19), (3, "x " * 21)], 20)
    assert substrings.removal_digests(empty).count() == 0
    assert {r["doc_id"] for r in substrings.without_repeats(table).collect()} == {1, 2, 3}


def test_suffixes_that_begin_alike_spread():
    """300 suffixes after the same words, whose first byte asks for many groups."""
    begin = b"posted by a user of this board on".split()
    shingled = [substrings.Shingled([*begin, *_words(k, 20).encode().split()]) for k in range(300)]
    codes, paths = (np.concatenate([f(s)[:1] for s in shingled]) for f in (lambda s: s.codes(np.array([0])), lambda s: s.of(20)))
    assert len(np.unique(codes)) == 1
    counts = np.ones(256, np.int64)
    counts[int(codes[0]) >> 24] = 10**9
    groups = substrings.Prefixes(counts, 4_000_000).of(codes, paths)
    assert len(np.unique(groups)) > 120


def test_each_shard_has_a_bucket_of_its_own(spark):
    for n in (1, 2, 7, 40):
        keys = substrings.bucket_keys(spark, n)
        frame = spark.createDataFrame([(k,) for k in keys], "k int")
        assert [r[0] for r in frame.select(substrings.F.pmod(substrings.F.hash("k"), substrings.F.lit(n))).collect()] == list(range(n))


def test_suffix_columns_pack():
    rng = np.random.default_rng(0)
    cols = rng.integers(0, 1 << 32, 50).astype(np.uint32), rng.integers(0, 1 << 63, 50).astype(np.uint64), rng.integers(-(1 << 62), 1 << 62, 50), np.arange(50)
    for a, b in zip(cols, substrings.unpack(substrings.pack(*cols))):
        assert (a == b).all()


# ---- packing and ids ------------------------------------------------------------------------------


def test_lower_bound_holds_and_best_fit_is_near():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = np.sort(rng.integers(1, 33, rng.integers(1, 200)))[::-1]
        bins, fills = packing.best_fit(n.tolist(), 32)
        bound = packing.lower_bound(np.bincount(n, minlength=33), 32)
        assert max(fills) <= 32 and sum(fills) == n.sum() and bound <= len(fills) <= bound * 1.25 + 1
    assert packing.lower_bound(np.bincount([17] * 10, minlength=33), 32) == 10
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


@pytest.mark.parametrize("group", [packing.GROUP, 7])
def test_packing(docs, rows, empty, group):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    got = packing.pack(packing.token_pieces(docs), group=group).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    bins, bound = packing.certificate(packing.pack(packing.token_pieces(docs), group=group))
    assert bound <= bins <= bound * 1.1 + 2
    assert packing.pack(packing.token_pieces(empty)).count() == 0


def test_packing_deals_equal_rows_apart(spark):
    table = spark.createDataFrame([(None, 0, 0, 1, 0)] * 3000, packing.PIECES).repartition(4)
    dealt = table.select(packing.F.pmod(packing.F.xxhash64(packing.F.monotonically_increasing_id(), packing.F.lit(0)), packing.F.lit(30)).alias("g"))
    assert dealt.groupBy("g").count().agg(packing.F.max("count")).first()[0] < 200
    got = packing.pack(table, capacity=16, group=100)
    bins, bound = packing.certificate(got, 16)
    assert got.count() == 3000 and bound == 188 and bins <= 188 + 30  # one part-filled sequence for each group


def test_tokens_are_the_tokenizers_own():
    rng = random.Random(5)
    letters = "".join(map(chr, range(1, 256))) + "日本語ﬁx̀İ½"
    texts = ["".join(rng.choice(letters if rng.random() < 0.4 else " aeE'sS'reLl1.\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a <|startoftext|>", None, ""]
    for name, kind, end in (("word_bpe_49k.json", "word", 2), ("byte_bpe_50k.json", "byte", 0)):
        e = tokens.Encoder(tokens.tokenizer_path(name), kind, end)
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert ids[:-4] == e.whole(text or "") and ids[-4:] == e.end


def test_words_met_before_are_not_cut_again():
    e = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), "word", 2)
    cut = []
    e.known.find = lambda word, find=e.find: cut.append(word) or find(word)
    e.find = None  # whole texts are not cut
    text = "They're here,\tsaid X2. They're  HERE, said\r\nx2.\n"
    assert list(e.encode([text] * 3)) == [e.whole(text) + e.end] * 3
    assert sorted(cut) == sorted({"they're", "they", "'re", "here,", "here", ",", "said", "x2.", "x", "2", "."})
    long = "ab1." * 50
    assert list(e.encode([long])) == [e.whole(long) + e.end] and max(map(len, e.known)) <= tokens.LONGEST


class Captured:
    """Stands for a DataFrame, and keeps the function that works on its batches."""

    columns, schema = ["doc_id", "text"], None

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_workers_hold_few_texts_and_a_bounded_dictionary(spark, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 50)
    machine = toxicity.Machine(0.0, {}, np.zeros(0), np.zeros((0, toxicity.FACTORS)))
    monkeypatch.setattr(toxicity, "train", lambda *_: machine)
    batch = pa.record_batch([pa.array(range(2500)), pa.array([f"words {k} of a text" for k in range(2500)])], ["doc_id", "text"])
    stages = [packing.token_pieces(Captured()), pii.redact(Captured()), toxicity.score(Captured(), machine), toxicity.keep_harmless(Captured(), None, 1.1)]
    for run in [s.run for s in stages] + [simhash._word_prints]:
        got = list(run([batch.select([0, 0, 1]).rename_columns(["_row", "_id", "text"]) if run is simhash._word_prints else batch]))
        assert max(b.num_rows for b in got) <= 1000
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(2500))
    assert len(tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"), "byte", 0, 50).known) <= 50


def test_workers_give_memory_back_when_a_task_ends():
    def resident():
        with open("/proc/self/status") as f:
            return int(next(x for x in f if x.startswith("VmRSS")).split()[1]) / 1024

    last = []

    def run(batches):
        held = [bytearray(2000) for _ in range(100_000)]
        last.append(bytearray(2000))  # lies behind them, so the heap does not shrink by itself
        yield from batches
        del held

    before = resident()
    assert list(trimmed(run)([1, 2])) == [1, 2]
    assert resident() - before < 100


def test_range_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 5000):
        for ids in (rng.integers(0, 49408, n), rng.zipf(1.3, n) % 49408, np.full(n, 49407)):
            assert (rangecoder.decode(rangecoder.encode(ids, 49408)) == ids).all()
    block = rangecoder.encode(rng.zipf(1.5, 20_000) % 500, 500)
    assert len(block) < 20_000
    for at in (5, 60, len(block) - 1):
        with pytest.raises(ValueError):
            rangecoder.decode(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(ValueError):
        rangecoder.decode(block[:10])


def test_range_coder_models_the_ids_of_the_block():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 64, 20_000) * 700
    assert len(rangecoder.encode(ids, 49408)) * 8 / len(ids) < 7  # 6 each, and 60 for each lane of 128 ids
    with pytest.raises(ValueError):
        rangecoder.encode(ids, 44_100)


def test_range_coder_keeps_narrow_spans():
    rng = np.random.default_rng(3)
    ids = np.tile(np.arange(16), 20_000)
    ids[rng.integers(0, len(ids), 1000)] = rng.permutation(65536)[:1000]  # sure predictions fail, and rare ids follow
    for x in (ids, np.concatenate((rng.permutation(65536), ids))):
        assert (rangecoder.decode(rangecoder.encode(x, 65536)) == x).all()


def test_chances_of_classes_are_those_of_each_decision():
    rng = np.random.default_rng(4)
    mixer, size = rangecoder.Mixer(32), 16 * 32 * rangecoder.OCTAVES
    for _ in range(20):
        joint, hit = rng.integers(0, size, 3000), rng.random(3000) < 0.3
        c, s, octave = np.unravel_index(joint, (16, 32, rangecoder.OCTAVES))
        w, got = mixer.w.copy(), mixer.mix()
        inputs = np.stack([mixer.by_c[c], mixer.by_s[s], rangecoder.OWN[octave]])
        dot = (w[:, c] * inputs).sum(0) >> 16
        p = rangecoder.SQUASH[np.clip(dot, -2047, 2047) + 2047]
        assert (got[joint] == p).all()
        mixer.learn(np.bincount(joint, minlength=size), np.bincount(joint[hit], minlength=size))
        for k in range(16):
            err = (hit[c == k] * 65536 - p[c == k].astype(np.int64)) * inputs[:, c == k]
            assert (mixer.w[:, k] == np.clip(w[:, k] + (err.sum(1) // max(1, (c == k).sum()) >> 9), -(1 << 18), 1 << 18)).all()


def test_quotients_off_by_one_are_mended(monkeypatch):
    class Off(np.ndarray):
        wrong, asked = True, 0

        def take(self, at, mode):
            right = np.asarray(self).take(at, mode=mode)
            if not len(at):
                return right
            Off.wrong, Off.asked = not Off.wrong, Off.asked + Off.wrong
            return right if Off.wrong else np.maximum(right - 1, 0)

    made = rangecoder.Model._sum

    def _sum(self):
        made(self)
        if self.slots:
            self.slot = self.slot.view(Off)

    monkeypatch.setattr(rangecoder.Model, "_sum", _sum)
    ids = np.random.default_rng(5).integers(0, 3000, 20_000)
    assert (rangecoder.decode(rangecoder.encode(ids, 3000)) == ids).all() and Off.asked > 50


def test_token_id_files(docs, rows, empty):
    e = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"), "word", 2)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = (e.whole(r[1]) if r[1] else b"") + e.end
        want.append((r[0], start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    blocks = tokenids.write_ids(docs)
    assert Counter(tuple(r) for r in tokenids.read_ids(blocks).collect()) == Counter(want)
    assert tokenids.read_ids(tokenids.write_ids(empty)).count() == 0
    raw = bytearray(blocks.where("n_ids > 0").first()["payload"])
    raw[-1] ^= 1
    with pytest.raises(ValueError):
        tokenids.from_block(bytes(raw))


# ---- toxicity -----------------------------------------------------------------------------------


def test_machine_learns_pairs():
    """Insult or group alone is harmless, both together are toxic: no additive weights can tell."""
    rng = np.random.default_rng(2)
    docs, y = [], []
    for k in range(1200):
        a, b = k % 2, k // 2 % 2
        docs.append(np.array(sorted({*rng.integers(100, 160, 6).tolist(), *([1] * a), *([2] * b)})))
        y.append(int(a and b))
    m = toxicity.fit(docs, np.array(y))
    place = [[m.rows[t] for t in d.tolist() if t in m.rows] for d in docs]
    s = m.scores(np.concatenate([np.array(p, int) for p in place]), np.repeat(np.arange(len(docs)), [len(p) for p in place]), len(docs))
    assert ((s >= 0.5) == (np.array(y) == 1)).mean() > 0.95


def test_toxicity_held_out_and_edges(spark, docs, empty):
    rng = random.Random(1)
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [(k, _words(k, 60).translate(letters) + (" idiot" if k % 5 == 0 else "") + rng.choice([".", " | ", "\n"])) for k in range(900)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(900)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(table, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, machine).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 150 and sum((got[k] >= 0.3) == (k % 5 == 0) for k in held) / len(held) > 0.99
    assert toxicity.keep_harmless(docs, labels).columns == docs.columns
    assert toxicity.score(docs, machine).where("score < 0 or score > 1 or score is null").count() == 0
    none = toxicity.train(table, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(table, none).collect()} == {0.0}
    assert toxicity.score(empty, machine).count() == 0


def test_toxicity_scores_as_the_double_sum(spark):
    """The score of every text, from the weights by their definition: all single terms and all pairs."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(any(x in t.split() for x in vocabulary[:6]))) for k, t in texts], "doc_id long, toxic int")
    texts += [(1000, None), (1001, ""), (1002, "12 -- 7"), (1003, " ".join(vocabulary).upper() * 3)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    m = toxicity.train(table, labels)
    assert len(m.rows) > 2
    for r in toxicity.score(table, m).collect():
        runs = {x.lower() for x in re.findall(r"[^\W\d_]+", dict(texts)[r["doc_id"]] or "")}
        hashed = {zlib.crc32(t.encode()) % toxicity.BUCKETS for t in runs | {x[:6] + "*" for x in runs if len(x) > 6}}
        on = sorted(m.rows[t] for t in hashed if t in m.rows)
        z = m.bias + sum(m.w[i] for i in on) + sum(float(m.v[i] @ m.v[j]) for i in on for j in on if i < j)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), abs=1e-9)


def test_toxicity_learns_from_all_but_copies(spark, monkeypatch):
    """Rows that share their commonest terms are no copies; rows of one id and repeated rows are learnt from once."""
    texts = [(k, f"the same common words and then number {'abcdefghij'[k % 10] * (k // 10 + 1)}") for k in range(60)]
    texts += [(100 + k, texts[k][1]) for k in range(10)] + [(5, "another text of the same id")] * 500
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda docs, y: seen.append(len(docs)))
    labels = spark.createDataFrame([(k, 0) for k, _ in texts], "doc_id long, toxic int")
    toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    used = {k for k, _ in texts if zlib.crc32(str(k).encode()) % 4 != 2}
    text = dict(reversed(texts))
    assert abs(seen[0] - len({text[k] for k in used})) <= 1


# ---- fingerprints -------------------------------------------------------------------------------


def _brute_features(text, rank):
    """Hashes of the rarest window of each run, window by window, and the entropy of each window."""
    w, near = fingerprints.WINDOW, fingerprints.NEAR
    x = b"\0" * (w - 1) + text + b"\0" * (w - 1)
    bins = []
    for i in range(len(x) - w + 1):
        total = sum(int(fingerprints.WEIGHT[c]) for c in Counter(x[i : i + w]).values())
        bins.append(min((fingerprints.FULL - total) * fingerprints.BINS // fingerprints.FULL, fingerprints.BINS - 1))
    picked = {min(range(i, i + near), key=lambda k: (rank[bins[k]], k)) for i in range(len(bins) - near + 1)} if text else set()
    out = []
    for k in sorted(picked):
        h = 0x9E3779B97F4A7C15
        for j in range(0, w, 8):
            h = (h * 0x100000001B3 % 2**64) ^ int.from_bytes(x[k + j : k + j + 8], "little")
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ h >> 33) * m % 2**64
            h ^= h >> 33
        if h not in out:
            out.append(h)
    return out, bins if text else []


def _brute_likeness(a, b):
    """Of two lists of features."""
    if not a or not b:
        return float(not a and not b)
    n = fingerprints.PER_FILTER
    cut = lambda f: [f[i : i + n] for i in range(0, len(f), n)]
    bits = lambda f: {(h >> 11 * k) % fingerprints.BITS for h in f for k in range(fingerprints.HASHES)}
    one, two = cut(a), cut(b)
    packed = lambda fs: b"".join(np.packbits(np.isin(np.arange(fingerprints.BITS), sorted(bits(f)))).tobytes() for f in fs)
    if len(one) > len(two) or (len(one) == len(two) and packed(one) > packed(two)):
        one, two = two, one
    total = 0.0
    for f in one:
        p = bits(f)
        best = 0.0
        for g in two:
            q = bits(g)
            chance = len(p) * len(q) / fingerprints.BITS
            best = max(best, min(1.0, (len(p & q) - chance) / max(1, min(len(p), len(q)) - chance)))
        total += best * len(f)
    return total / len(a if one == cut(a) else b)


def _brute_fingerprints(rows, parts_of=None):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1] or ""))
    texts = [r[1] or "" for r in order]
    histogram = Counter(b for t in texts for b in _brute_features(t.encode(), [0] * fingerprints.BINS)[1])
    ranked = sorted(range(fingerprints.BINS), key=lambda k: (histogram[k], k))
    rank = {b: fingerprints.BINS if b < fingerprints.BINS // 8 else k for k, b in enumerate(ranked)}
    out = Counter()
    for k, r in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        f, g, h = (_brute_features(x.encode(), rank)[0] for x in (t, edited, nxt))
        out[r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), len(f), round(_brute_likeness(f, g), 9), round(_brute_likeness(f, h), 9)] += 1
    return out


def _counted(printed):
    """Features of a digest as printed."""
    last, _, filters = printed.partition(":")
    n = len(filters) // (fingerprints.BITS // 4)
    return max(0, n - 1) * fingerprints.PER_FILTER + int(last)


@pytest.mark.parametrize("kind", ["mixed", "one letter", "null ids", "one id"])
def test_fingerprints_as_brute_force(spark, monkeypatch, kind):
    texts = [_words(k, n) for k, n in enumerate((1, 3, 9, 20, 40, 90, 200, 700))] + [None, "", "a", "ab" * 9, "\n" * 70, "é# $ñ" * 30, _words(5, 90), _words(5, 90)]
    if kind == "one letter":
        texts = ["x. " * 100, "a" * 500, "plain prose without a window of its own " * 3, "", None]
    ids = {"null ids": [None] * len(texts), "one id": [7] * len(texts)}.get(kind, [None if k == 3 else k // 2 for k in range(len(texts))])
    table = spark.createDataFrame([(i, t, "mine", 1) for i, t in zip(ids, texts)], "doc_id long, text string, part string, h int").repartition(3)
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in table.select("doc_id", "text", F.xxhash64("text")).collect()]
    got = fingerprints.fingerprints(table, 4).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], _counted(r["fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == _brute_fingerprints(rows)
    same = {}
    for r in got:
        assert same.setdefault((r["n_chars"], r["fingerprint"]), r["n_chars"]) == r["n_chars"]


def test_fingerprints_edges(docs, rows, empty):
    got = fingerprints.fingerprints(docs, 5).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert min(r["near_edited"] for r in got if r["n_chars"] >= 128) > 0.2
    assert fingerprints.fingerprints(empty, 3).count() == 0


def test_fingerprints_take_long_texts_in_blocks(monkeypatch):
    texts = [_words(k, n).encode() for k, n in enumerate((30, 1, 400, 5, 60))]
    rank = fingerprints.ranks(fingerprints.entropy_histogram(texts))
    whole = fingerprints.features(texts, rank)
    monkeypatch.setattr(fingerprints, "BLOCK", 97)
    assert (fingerprints.ranks(fingerprints.entropy_histogram(texts)) == rank).all()
    for a, b in zip(whole, fingerprints.features(texts, rank)):
        assert a.tolist() == b.tolist()


def test_likeness_does_not_hang_on_size():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)).encode()
    rank = fingerprints.ranks(fingerprints.entropy_histogram([text]))
    for a, b in ((100, 110), (127, 129), (127, 200), (128, 140), (127, 256), (500, 1000)):
        one, two = (fingerprints.digest(f) for f in fingerprints.features([text[:a], text[:b]], rank))
        assert fingerprints.likeness(one, two) > 0.6


def test_likeness():
    rng = np.random.default_rng(6)
    a = [bytes(rng.integers(32, 127, 20_000).astype(np.uint8)) for _ in range(2)]
    rank = fingerprints.ranks(fingerprints.entropy_histogram(a))
    one, two, half = (fingerprints.digest(f) for f in fingerprints.features([*a, a[0][:10_000] + a[1][10_000:]], rank))
    assert fingerprints.likeness(one, one) == 1.0 and fingerprints.likeness(one, two) < 0.1
    assert 0.3 < fingerprints.likeness(one, half) < 0.7


# ---- pages --------------------------------------------------------------------------------------


def _page(article, menu="Menu", more=""):
    return f"<html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li>{menu}</li></ul></nav>{more}<article><h1>Head</h1>{article}</article><footer>&copy; me</footer></body></html>"


def test_pages(spark):
    raw = [
        (1, "http://h.org/a/1", _page("<p>One &amp; two</p><p>more<br>text")), (2, "http://h.org/a/2?x=1", _page("<p>Three</p><div class='comments'>nasty</div>")),
        (3, "http://H.org/b", None), (4, None, ""), (5, "http://o.org/", "<p>Share this</p><p>own words</p><p>Legal"), (6, "http://o.org/x", "<p>Share this</p><p>others</p><p>Legal"),
        (7, "http://q.org/y", "<p>cut off &am"), (8, "http://h.org/a/1", _page("<p>One &amp; two</p><p>more<br>text")), (8, "http://h.org/a/1", _page("<p>One &amp; two</p>")),
    ]
    table = spark.createDataFrame([(*r, 1, "k") for r in raw], "page_id long, url string, html string, part int, key string").repartition(3)
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(table, 4).collect())
    text = {1: "Head\nOne & two\nmore text", 2: "Head\nThree", 3: "", 4: "", 5: "own words", 6: "others", 7: "cut off &am"}
    want = Counter((k, v, len(v)) for k, v in text.items()) + Counter([(8, text[1], len(text[1])), (8, "Head\nOne & two", 14)])
    assert got == want
    assert pages.extract(table.limit(0), 4).count() == 0


def test_pages_copies_are_no_template(spark):
    same = "<p>Share this</p><p>an article at two addresses</p><p>Legal</p>"
    raw = [
        (1, "http://h.org/a", "<p>Share this</p><p>something else</p><p>Legal</p>"), (2, "http://h.org/b1", same), (3, "http://h.org/b1/print", same), (4, "http://h.org/b1/print", same),
        (5, "http://i.org/a", same), (6, "http://i.org/b", same), (7, "http://j.org/", "<main class='has-sidebar'><article class='post comments-open'><p>text</p></article></main>"),
    ]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(raw, "page_id long, url string, html string"), 1).collect()}
    article = "an article at two addresses"
    assert got == {1: "something else", 2: article, 3: article, 4: article} | dict.fromkeys((5, 6), f"Share this\n{article}\nLegal") | {7: "text"}


def _brute_differenced(raw):
    """Plain differencing, by trying every page of the host: the nearest shares the longest beginning of path, and stands
    next in the order of paths; of two, the later."""
    def place(r):
        rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", r[1] or "")
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0], r[1] or "", r[0]

    out = {}
    for r in raw:
        lines = [b.text for b in pages.blocks(r[2])]
        others = [o for o in raw if o is not r and place(o)[0] == place(r)[0]]
        if others:
            shared = lambda o: next((i for i, (x, y) in enumerate(zip(place(o)[1], place(r)[1])) if x != y), min(len(place(o)[1]), len(place(r)[1])))
            before, after = [o for o in others if place(o) < place(r)], [o for o in others if place(o) > place(r)]
            near = ([min(after, key=place)] if after else []) + ([max(before, key=place)] if before else [])
            best = max(near, key=shared)
            assert shared(best) == max(map(shared, others))
            gone = {i for i, _ in pages.common_lines(lines, [b.text for b in pages.blocks(best[2])])}
            lines = [x for i, x in enumerate(lines) if i not in gone]
        out[r[0]] = "\n".join(lines)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_pages_are_paired_with_the_nearest_url(spark, parts):
    rng = random.Random(11)
    raw = []
    for k in range(60):
        host = rng.choice(["a.org", "B.org", "c.net"])
        path = "/".join(rng.choice(["x", "yy", "news", "2024", "q"]) for _ in range(rng.randint(0, 4)))
        body = "".join(f"<p>{rng.choice(['Menu', 'Legal', 'Share', 'line %d' % rng.randrange(200)])}</p>" for _ in range(rng.randint(0, 9)))
        raw.append((k, rng.choice(["http://", "https://", ""]) + f"{host}/{path}{k % 7}" + rng.choice(["", "?p=1", "#top"]), body))
    table = spark.createDataFrame(raw, "page_id long, url string, html string").repartition(4)
    assert {r["page_id"]: r["text"] for r in pages.extract(table, parts, roles=False).collect()} == _brute_differenced(raw)


def test_common_lines_is_longest():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(pages.common_lines(a, b)) == table[-1][-1]


# ---- quality ------------------------------------------------------------------------------------


def test_quality_measures(docs, rows, empty):
    got = quality.judged(quality.measured(docs)).collect()
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + d for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for d in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {1, 6} <= {r["doc_id"] for r in kept.collect()}
    assert quality.judged(quality.measured(empty)).count() == 0


def test_quality_drops_what_stands_out(spark):
    good = [(k, _words(k, 120), "en", "s") for k in range(40)]
    odd = [(100, " ".join("###" + w for w in _words(7, 120).split()), "en", "s"), (101, " ".join("z" * 60 + w for w in _words(8, 120).split()), "en", "s")]
    table = spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.keep_good(table).collect()} == set(range(40))


def test_quality_cutoffs_follow_their_group(spark):
    """Symbols are common in one source and rare in the others; a source of a few rows takes its language's cutoffs."""
    rng = random.Random(3)
    rows = []
    for lang, source, n, marks in (("en", "code", 150, 30), ("en", "news", 150, 0), ("en", "few", 5, 0), ("de", "news", 20, 0), (None, None, 120, 4)):
        for _ in range(n):
            text = _words(len(rows), 100) + " |" * rng.randint(0, marks)
            rows.append((len(rows), text, lang, source, 1, "mine"))
    schema = "doc_id long, text string, lang string, source string, kept int, _words string"
    table = spark.createDataFrame(rows + [(9999, _words(1, 100) + " |" * 60, "en", "few", 0, "m"), (9998, _words(2, 100) + " |" * 28, "en", "news", 0, "m"), (9997, _words(3, 100) + " |" * 28, "en", "code", 0, "m")], schema)
    cuts = {(r["_lang"], r["_source"]): r["_symbols_per_word_high"] for r in quality.thresholds(quality.measured(table)).collect()}
    assert cuts["en", "news"] == 0 < cuts[None, None] < cuts["en", "code"]
    assert cuts["en", "few"] > 0 and cuts["de", "news"] > 0  # of English, and of the corpus
    kept = quality.keep_good(table)
    assert kept.columns == table.columns and kept.schema == table.schema
    got = {r["doc_id"]: r["_words"] for r in kept.collect()}
    assert 9997 in got and 9998 not in got and got[9997] == "m"
    assert quality.keep_good(table.limit(0)).count() == 0


# ---- personal data --------------------------------------------------------------------------------


def _brute_base(t):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("aZ@@..1234567890 -+()%_\né") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _brute_base(t)


def test_field_on_held_out_sentences():
    tagger = pii.Tagger(pii.default_field())
    held = pii.labelled_table(6, seed=4711)
    got = tagger.labels([w for w, _ in held])
    assert sum([pii.LABELS[i] for i in g] == want for g, (_, want) in zip(got, held)) / len(held) > 0.97


#: Sentences by hand, of none of the forms that the field is taught: text, and what it should mark.
BY_HAND = [
    ("please write to maria at posteo dot net for details", "maria at posteo dot net"), ("contact john.smith [at] company [dot] org today", "john.smith [at] company [dot] org"),
    ("call (212) 555-0187 after six", "(212) 555-0187"), ("tel. 030 555 7788 oder spaeter", "030 555 7788"), ('password = "a8f3k29dk3l10fj3m2nb48zz" in the file', "a8f3k29dk3l10fj3m2nb48zz"),
    ("my phone: 415-555-2671 thanks", "415-555-2671"), ("email: anna(at)web.net bitte", "anna(at)web.net"), ("write to anna at host dot com", "anna at host dot com"),
    ("api_key = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("Meet me at noon near the station and look at the dot com boom of 1999.", None),
    ("The password = must be changed every ninety days by the user", None), ("He will call you at 5 pm on Monday, phone first please.", None), ("See chapter 12, page 345-678 and table 9000 of 2019-2020.", None),
    ("token holders of the network vote on key proposals: secret ballots", None), ("write to the editor at the address below or contact the office", None), ("fax: see the back page, tel. not given", None),
    ("ISBN 0-306-40615-2 and order number 555-1234 were listed in 1987.", None), ("bearer of good news, the key = to success is patience", None), ("the score at the end was 21-17 at home and at dot away", None),
    ("Das Haus steht am Ende der Strasse, Telefon vorhanden, at dot com sagt er", None), ("#### | 33 | 44 | key value | secret santa", None), ("The population was 1234567890 in all and 987 654 3210 more", None),
]


def test_field_on_sentences_by_hand():
    got = pii.Tagger(pii.default_field()).spans([t for t, _ in BY_HAND])
    marked = [[t[a:b] for a, _, b in spans] for (t, _), spans in zip(BY_HAND, got)]
    right = sum(m == [want] for m, (_, want) in zip(marked, BY_HAND) if want)
    false = sum(x != want for m, (_, want) in zip(marked, BY_HAND) for x in m)
    assert right >= 8 and false <= 1, [(m, w) for m, (_, w) in zip(marked, BY_HAND) if m != [w] * bool(w)]


def _brute_added(field, text):
    """Spans of the field, word by word and path by path."""
    out, n = [], len(pii.LABELS)
    for line in re.finditer(r"[^\n]+", text):
        words = [(line.start() + m.start(), m.group()) for m in re.finditer(r"\S+", line.group())]
        if not words:
            continue
        own = [[[sum(field.w[k][f][y] for f in pii.features(pii.word_class(w))) for y in range(n)] for k in range(3)] for _, w in words]
        emit = [[own[t][0][y] + (own[t - 1][1][y] if t else 0) + (own[t + 1][2][y] if t + 1 < len(words) else 0) for y in range(n)] for t in range(len(words))]
        best = [(emit[0][y], [y]) for y in range(n)]
        for t in range(1, len(words)):
            best = [max((best[x][0] + field.pairs[x][y] + emit[t][y], best[x][1] + [y]) for x in range(n)) for y in range(n)]
        labels = max(best)[1]
        t = 0
        while t < len(words):
            y, end = labels[t], t
            while end + 1 < len(words) and labels[end + 1] == y:
                end += 1
            if y:
                a, b = words[t][0], words[end][0] + len(words[end][1])
                edge = {"secret": "\"'.,;:|#$%&*!?()[]<>=", "phone": "\"'.,;:|[]"}.get(pii.LABELS[y], "\"'.,;:|")
                a += len(text[a:b]) - len(text[a:b].lstrip(edge))
                b -= len(text[a:b]) - len(text[a:b].rstrip(edge))
                if b > a:
                    out.append((a, pii.KINDS.index(pii.LABELS[y]), b))
            t = end + 1
    return out


def test_added_spans_as_brute_force():
    field = pii.default_field()
    rng = random.Random(9)
    forms = [" ".join(w) for w, _ in pii.labelled_table(1, seed=12)] + [t for t, _ in BY_HAND] + ["x" * 300, "\t", "a@b.org at c dot com"]
    texts = ["\n".join(rng.sample(forms, rng.randint(0, 6))) for _ in range(60)] + [" ".join(rng.sample(forms, 40)), "", None]
    for t, (base, spans) in zip(texts, pii.all_spans(pii.Tagger(field), texts)):
        want = [s for s in _brute_added(field, t or "") if all(s[2] <= a or b <= s[0] for a, _, b in base)]
        assert spans == sorted(base + want) and base == _brute_base(t or "")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    pairs, emit = rng.normal(size=(4, 4)), rng.normal(size=(3, 5, 4))
    lengths = np.array([5, 4, 2])
    got = pii.viterbi(emit, pairs, lengths)
    import itertools

    for e, n, g in zip(emit, lengths, got):
        best = max(itertools.product(range(4), repeat=int(n)), key=lambda p: sum(e[t, x] for t, x in enumerate(p)) + sum(pairs[a, b] for a, b in zip(p, p[1:])))
        assert tuple(g[:n]) == best


def test_long_lines_are_decoded_whole():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 8, 9, 10, 40):
        pairs, emit = rng.normal(size=(4, 4)), rng.normal(size=(1, n, 4))
        want = pii.viterbi(emit, pairs, np.array([n]))[0]
        assert pii.viterbi_long(lambda a, b: emit[0, a:b], n, pairs, 4).tolist() == want.tolist()
    tagger = pii.Tagger(pii.default_field())
    said = " and so on ".join(" ".join(w) for w, labels in pii.labelled_table(2, seed=4711)[:12])
    n_said = len(said.split())
    short = pii.all_spans(tagger, ["word " * 20 + said])[0][1]
    assert len({k for _, k, _ in short}) >= 3
    for n in range(256 - n_said, 256):
        got = pii.all_spans(tagger, ["word " * n + said])[0][1]
        assert got == [(a + 5 * (n - 20), k, b + 5 * (n - 20)) for a, k, b in short]


def test_pii(spark, docs, rows, empty):
    secret = 'x\ntoken = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"### mail me@x.org or 10.0.0.300 and 10.0.0.3'
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(77, secret)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find(table).collect()}
    assert len(got) == len({r[0] for r in rows}) + 1
    r = got[77]
    base = _brute_base(secret)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 0)
    assert r["base_sha256"] == hashlib.sha256(pii.digest(base).encode()).hexdigest()
    a = secret.index("cb1a")
    assert r["spans"].split(",") == [f"secret:{a}:{a + 40}", *pii.digest(base).split(",")]
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and pii.redact(empty).count() == 0
    assert pii.masked(secret, sorted(base)) == secret.replace("me@x.org", "[EMAIL]").replace("and 10.0.0.3", "and [IP]")


def test_template_inside_an_article_goes_by_differencing():
    def page(k, extra=""):
        return pages.blocks(f"<main><h1>Title {k}</h1><p>Common line.</p><div class=x1><p>Ask the desk</p><ul><li>Print</ul></div><div><p>Own {k}</p><p>Common line.</p></div>{extra}</main>")

    own, one, two = page(1), page(2), page(3)
    want = "Title 1\nCommon line.\nOwn 1\nCommon line."
    assert pages.main_text(own, [one, two]) == want
    assert "Ask the desk" in pages.main_text(own, [one])  # one page tells no template from a line that two articles carry
    assert "Ask the desk" in pages.main_text(own, [own, one])  # a copy is no second page
    assert pages.main_text(own, [own, one, two]) == want
    assert pages.main_text(page(4, "<div>Kept 4</div>"), [one, two]).endswith("Kept 4")
