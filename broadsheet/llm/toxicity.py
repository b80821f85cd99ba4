"""Toxicity by a factorization machine over hashed terms.

Terms are the letter runs of a text, lower-cased, and the first six letters of longer ones, all
hashed; a text is the set of its terms. Terms
that tell the classes apart in the labelled sample keep a weight and a factor vector each, so the
score is logistic in b + sum w_i + the sum over pairs <v_i, v_j>: two terms that are harmless
alone can be toxic together. The pair sum costs no more than the single one.

The machine is fitted on the driver from at most SAMPLE labelled rows (those of least hashed
doc_id, outside the held-out quarter); of rows with the same whole set of terms and the same label, which only copies
are, one is used. Where several documents bear a labelled id, the one whose set of terms hashes least counts. Scoring runs over every whole text with the fitted table of selected
terms, of at most SAMPLE * 8 entries, in the tasks' closure.

Defined results: null, empty or wordless text: the score of the bias alone; no usable labels, or of one
class only: every score 0.0; null doc_id: held_out null-safe false; labels with null toxic or doc_id
are no labels; repeated labels count once each; an empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, sliced, table, trimmed

NAME = "op5_toxicity"
SQL = None
#: Labelled rows that the model may be fitted on.
SAMPLE = 12_000
THRESHOLD = 0.3
BUCKETS = 1 << 22
FACTORS, EPOCHS, SEED = 8, 15, 5
STEM = 6
TERM = re.compile(r"[^\W\d_]+")
#: White-space words whose terms a worker remembers.
KEPT = 400_000


def terms(word: str) -> list[int]:
    """The hashed terms of one white-space word: its letter runs, and the stems of long ones."""
    found = TERM.findall(word.lower())
    found += [t[:STEM] + "*" for t in found if len(t) > STEM]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in found]


@dataclass
class Machine:
    """A fitted factorization machine: hashed term -> row of w and v."""

    bias: float = -50.0
    rows: dict[int, int] = field(default_factory=dict)
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def raw(self, place: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """The logits of n texts; place[i] is a row that text doc[i] holds, each once."""
        out = self.bias + np.bincount(doc, self.w[place], n)
        for f in range(self.v.shape[1]):
            x = self.v[place, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def scores(self, place: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if self.bias == -50.0 and not self.rows:
            return np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(self.raw(place, doc, n), -35, 35)))


def telling(docs: list[np.ndarray], y: np.ndarray, least: int = 3, chi2: float = 12.0) -> np.ndarray:
    """Hashed terms whose presence and label are dependent: df >= least and chi-square >= chi2."""
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    seen, place = np.unique(np.concatenate(docs), return_inverse=True)
    n, pos = len(docs), y.sum()
    df = np.bincount(place).astype(float)
    both = np.bincount(place, y[doc].astype(float))
    expected = df * pos / n
    spread = expected * (1 - pos / n) * (1 - df / n) + 1e-9
    return seen[(df >= least) & ((both - expected) ** 2 / spread >= chi2)]


def fit(docs: list[np.ndarray], y: np.ndarray) -> Machine:
    """docs: the distinct hashed terms of each text. AdaGrad over shuffled batches, fixed seed."""
    if not len(docs) or y.min() == y.max():
        return Machine()
    kept = telling(docs, y)
    rows = {int(t): i for i, t in enumerate(kept)}
    place = []
    for d in docs:
        at = np.minimum(np.searchsorted(kept, d), max(0, len(kept) - 1))
        place.append(at[kept[at] == d] if len(kept) else at[:0])
    rng = np.random.default_rng(SEED)
    w, v, b = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)), float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(len(kept), 1e-2), np.full((len(kept), FACTORS), 1e-2), 1e-2
    rate, decay = 0.25, 2e-4
    sizes = np.array([len(x) for x in place])
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            n, counts = len(some), sizes[some]
            z, e = np.full(n, b), np.zeros(n)
            full = np.flatnonzero(counts)
            ps = np.concatenate([place[i] for i in some])
            ds = np.repeat(np.arange(n), counts)
            sums = np.zeros((n, FACTORS))
            if len(full):
                starts = (np.cumsum(counts) - counts)[full]
                sums[full] = np.add.reduceat(v[ps], starts)
                z += np.bincount(ds, w[ps] - 0.5 * (v[ps] ** 2).sum(1), n) + 0.5 * (sums**2).sum(1)
            e = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[some]
            gb += e.sum() ** 2
            b -= rate * e.sum() / np.sqrt(gb)
            if not len(full):
                continue
            by = np.argsort(ps, kind="stable")
            firsts = np.flatnonzero(np.concatenate(([True], ps[by][1:] != ps[by][:-1])))
            used = ps[by][firsts]
            dw = np.add.reduceat(e[ds][by], firsts) + decay * w[used] * n
            dv = np.add.reduceat((e[ds][:, None] * (sums[ds] - v[ps]))[by], firsts) + decay * 10 * v[used] * n
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.2 * dv / np.sqrt(gv[used])
    return Machine(b, rows, w, v)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most sample labelled rows outside the held-out quarter."""
    chosen = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)

    def bags(batches):
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for text in column_of(batch, "text"):
                bag: set[int] = set()
                for word in set((text or "").split()):
                    got = known.get(word)
                    if got is None:
                        if len(known) > KEPT:
                            known.clear()
                        got = known[word] = terms(word)
                    bag.update(got)
                out.append(np.array(sorted(bag), dtype="<i4").tobytes())
            doc_ids, toxic = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "toxic"))
            yield pa.record_batch([doc_ids, toxic, pa.array(out, pa.binary())], ["doc_id", "toxic", "bag"])

    bounded = F.broadcast(chosen.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")))  # at most sample rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(bounded, "doc_id")
    # one document for each labelled row, so that what reaches the driver is bounded by the sample
    bags_ = rows.mapInArrow(trimmed(bags), "doc_id long, toxic int, bag binary")
    least = bags_.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("bag"), "bag")).alias("k"))
    got = sorted(least.select("doc_id", "toxic", "k.bag").collect(), key=lambda r: (r["doc_id"], r["toxic"]))
    seen, docs_, y = set(), [], []
    for r in got:
        bag = np.frombuffer(r["bag"], dtype="<i4")
        key = (hashlib.sha256(bag).digest(), r["toxic"])
        if len(bag) and key not in seen:
            seen.add(key)
            docs_.append(bag)
            y.append(r["toxic"])
    del got, seen
    return fit(docs_, np.array(y))


class Scorer:
    """Scores texts; the terms of a white-space word are looked up once."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        rows, places, counts = self.machine.rows, [], []
        for text in texts:
            words, found = set((text or "").split()), set()
            new = words.difference(self.known)
            if new:
                if len(self.known) + len(new) > KEPT:
                    self.known = {}
                    new = words
                for word in new:
                    self.known[word] = tuple(rows[t] for t in terms(word) if t in rows)
            for got in map(self.known.__getitem__, words):
                if got:
                    found.update(got)
            places += sorted(found)
            counts.append(len(found))
        doc = np.repeat(np.arange(len(counts)), counts)
        return self.machine.scores(np.array(places, dtype=np.int64), doc, len(counts))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every text."""

    def scored(batches):
        scorer = Scorer(machine)
        for batch in sliced(batches):
            out = scorer(column_of(batch, "text"))
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(scored), "doc_id long, score double")


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score stays below threshold, with their columns."""
    machine, names = train(docs, labels), docs.columns

    def kept(batches):
        scorer = Scorer(machine)
        for batch in sliced(batches):
            yield batch.filter(pa.array(scorer(column_of(batch, "text")) < threshold))

    return docs.mapInArrow(trimmed(kept), docs.schema).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: a score for every document; the model has seen no held-out label."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
