"""Personal data: base patterns, and a linear-chain conditional random field that adds to them.

The base patterns settle emails, IPv4 addresses, cards and phone numbers of standard form. The
field labels white-space words from word-shape features of the word and its two neighbours and
adds spans that the patterns cannot see: credentials, spelled-out emails, phone numbers without a country code.
It is trained on the driver from labelled_table(), a few hundred sentences built by rule
from the forms in FORMS; decoding runs in numpy, step by step over all lines of a batch at once.
A word's share of the scores is computed once for each distinct word of a worker.

Nothing overrules the field but the base patterns: spans of the field that touch a base span are dropped. Lines are decoded whole:
those longer than STEPS words by themselves, with back pointers held for RUN words at a time.

Defined results: null or empty text: no spans; equal spans of several kinds: in the order of KINDS;
repeated rows: each by itself; null doc_id: kept as it is; an empty table: no rows. Other columns
are ignored by the query and kept by redact().
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, sliced, table, trimmed

NAME = "op10_pii"
SQL = None

#: Kinds in the order of their listing; the last is the field's own.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LABELS = ("O", "email", "phone", "secret")
#: Words above which a line is decoded by itself, and words whose back pointers it holds at a time.
STEPS, RUN = 256, 1 << 15
BUCKETS = 1 << 14
#: Distinct words that a worker remembers.
KEPT = 300_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from each @ so that long words cost no retries."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        else:
            last = at + 1  # no local part reaches over an @
        at = text.find("@", at + 1 if not found else last)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind as a place in KINDS, end), ascending."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field ------------------------------------------------------------------------------

#: The labelled forms. <w> a word, <hex> a credential, <d3> three digits; [kind ...] is labelled.
FORMS = """
<w> token = [secret "<hex>"] <w> <w>
<w> <w> api_key = [secret "<hex>"]
secret: [secret <hex>] <w>
password = [secret "<hex>"] <w> <w>
<w> key = [secret '<hex>'] <w>
<w> bearer [secret <hex>] <w>
call [phone (<d3>) <d3>-<d4>] <w> <w>
<w> phone: [phone <d3>-<d3>-<d4>] <w>
tel. [phone <d3> <d3> <d4>] <w>
<w> <w> mobile [phone (<d3>) <d3>-<d4>]
fax: [phone <d3>-<d3>-<d4>] <w>
<w> write to [email <w> at <w> dot com] <w>
mail [email <w> [at] <w> [dot] org] <w> <w>
email: [email <w>(at)<w>.net] <w>
<w> <w> contact [email <w> (at) <w> (dot) com]
<w> <w> <w> <w> <w> <w>
<w> <w>, <w> <w>. <W> <w>
<W> <w> at <w> dot <w> <w>
<W> <w> <w> <d4> <w> <d3> <w>
<w> | <w> | <w> | <w>. | <W>
<w>### <w>$$$ <w>*** <w>%%% <w>&&&
<w> <d4><d4><d4><d4> <w> <w>
<w> <d3>.<d3>.<d3>.<d3> <w>
<w> +1 (<d3>) <d3>-<d4> <w> <w>
<w> <w>@<w>.com <w> <w>
token <w> = <w> key <w> secret <w>
<w> <w> <d4>-<d3>-<d3> <w> number <d4>
call <w> phone <w> the <w> mail <w> password
to to to to to to to to to at at at at at dot dot dot
At At At At At at at at, at the at to dot
the at to the <w> at, <w> the, at <w>
mail at <w> <w> contact at the <w> at <w>
<W>, <W>, <W>, <W>, <W>, <w>; <w>; <w>
<w> <w> page <d3> <d4> <w> of <d3>
version <d3>.<d3> <w> license <d4> <w> http://<w>.com/<w>/<d3>
""".strip().splitlines()


def labelled_table(copies: int = 12, seed: int = 10) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each training sentence: every form, filled in `copies` times."""
    rng = np.random.default_rng(seed)

    def word() -> str:
        return "".join(rng.choice(list("etaoinshrdlcumwfgypbvkéüñ"), rng.integers(2, 12)))

    def fill(slot: str) -> str:
        if slot == "hex":
            letters = "0123456789abcdef" if rng.random() < 0.7 else "0123456789abcdefghijkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ"
            return "".join(rng.choice(list(letters), int(rng.choice([24, 32, 40, 40, 64]))))
        if slot[0] == "d":
            return "".join(map(str, rng.integers(0, 10, int(slot[1:]))))
        return word().capitalize() if slot == "W" else word()

    out = []
    for _ in range(copies):
        for form in FORMS:
            words_, labels = [], []
            marked = re.sub(r"\[(email|phone|secret) ((?:\[[a-z]+\]|[^\]])*)\]", lambda m: " ".join(f"\x01{m[1]}\x02{p}" for p in m[2].split()), form)
            for part in marked.split():
                kind, _, body = part[1:].partition("\x02") if part[0] == "\x01" else ("O", "", part)
                words_.append(re.sub(r"<(\w+)>", lambda m: fill(m[1]), body))
                labels.append(kind)
            out.append((words_, labels))
    return out


#: Words that the forms spell out; other words count by shape alone.
KEYWORDS = frozenset(re.findall(r"(?<![<\w])[a-z_]+(?![>\w])", re.sub(r"\[(?=(?:email|phone|secret) )\w+", "", "\n".join(FORMS))))
CLASSES = {i: "d" if chr(i) in "0123456789" else "x" if chr(i).islower() else "X" if chr(i).isupper() else "x" if chr(i).isalpha() else chr(i) for i in range(256)}
RUNS = re.compile(r"(.)\1+", re.S)
EDGES = "\"'.,;:()[]|"


def shape(word: str) -> str:
    """Upper case X, lower case x, digits d, runs as one; other characters as they are, runs as one."""
    return RUNS.sub(r"\1", word[:64].translate(CLASSES))[:12]


@functools.lru_cache(maxsize=1 << 16)
def _plain(title: bool, n: int) -> tuple:
    return ("X" * title + "x" * (n > title), n.bit_length(), 0, 0, False, "", "")


def word_class(word: str) -> tuple:
    """What the field sees of a white-space word: shape, size, digits, length of words with digits,
    long mixture of letters and digits, last character if no letter or digit, keyword."""
    if word.isalpha() and word not in KEYWORDS and len(word) <= 64 and (word.islower() or word.istitle()):
        return _plain(not word.islower(), len(word))
    bare = word.strip(EDGES)
    n, digits = min(len(bare), 64), len(re.findall("[0-9]", bare))
    low = bare.lower()
    last = word[-1:]
    return (
        shape(word), n.bit_length(), min(digits, 12), n if digits else 0,
        n >= 20 and 0 < digits < len(bare) and bare.isalnum(), "" if last.isalnum() else last, low if low in KEYWORDS else "",
    )


def features(seen: tuple) -> list[int]:
    """Hashed features of a word class."""
    return [zlib.crc32(f"{i}{x}".encode("utf-8", "surrogatepass")) % BUCKETS for i, x in enumerate(seen)]


class Field:
    """Weights of the conditional random field: of features of the word, the one before and the one after, and of label pairs."""

    def __init__(self):
        self.w = np.zeros((3, BUCKETS, len(LABELS)))
        self.pairs = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, seen: tuple) -> np.ndarray:
        """3 x labels: what a word of the class adds to its own place, the next and the one before."""
        return self.w[:, features(seen)].sum(1)


def _padded(rows: list[np.ndarray], width: int, fill) -> np.ndarray:
    out = np.full((len(rows), width, *rows[0].shape[1:]), fill, dtype=rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """Maximum likelihood by AdaGrad on the whole table; forward and backward sums run over all sentences at once."""
    field, L = Field(), len(LABELS)
    width = max(len(w) for w, _ in rows)
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws, _ in rows for w in ws}))}
    feats = [features(word_class(w)) for w in vocabulary]
    ids = _padded([np.array([vocabulary[w] for w in ws]) for ws, _ in rows], width, -1)
    gold = _padded([np.array([LABELS.index(x) for x in ls]) for _, ls in rows], width, 0)
    on = ids >= 0
    flat = np.concatenate([np.array(f) for f in feats])
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    g2w, g2p = np.full_like(field.w, 1e-6), np.full_like(field.pairs, 1e-6)
    n, rows_ = len(rows), np.arange(len(rows))
    last = on.sum(1) - 1
    for _ in range(rounds):
        table_ = np.zeros((3, len(feats), L))
        for k in range(3):
            np.add.at(table_[k], owner, field.w[k][flat])
        emit = _emissions(table_, ids)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, width):
            z = forward[:, t - 1, :, None] + field.pairs[None]
            m = z.max(1)
            forward[:, t] = np.where(on[:, t, None], m + np.log(np.exp(z - m[:, None]).sum(1)) + emit[:, t], forward[:, t - 1])
        end = forward[:, -1]
        logz = np.log(np.exp(end - end.max(1, keepdims=True)).sum(1)) + end.max(1)
        dp, gw_places = np.zeros_like(field.pairs), np.zeros_like(emit)
        for t in range(width - 2, -1, -1):
            z = field.pairs[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
            m = z.max(2)
            backward[:, t] = np.where(on[:, t + 1, None], m + np.log(np.exp(z - m[:, :, None]).sum(2)), backward[:, t + 1])
            both = np.exp(forward[:, t, :, None] + z - logz[:, None, None]) * on[:, t + 1, None, None]
            dp -= both.sum(0)
            np.add.at(dp, (gold[on[:, t + 1], t], gold[on[:, t + 1], t + 1]), 1)
        gw_places = -np.exp(forward + backward - logz[:, None, None])
        gw_places[rows_[:, None], np.arange(width)[None], gold] += 1
        gw_places *= on[..., None]
        for k, shift in ((0, 0), (1, 1), (2, -1)):
            g = np.zeros((len(feats), L))
            src = ids if not shift else (ids[:, :-1] if shift == 1 else ids[:, 1:])
            val = gw_places if not shift else (gw_places[:, 1:] if shift == 1 else gw_places[:, :-1])
            ok = src >= 0
            np.add.at(g, src[ok], val[ok])
            full = np.zeros_like(field.w[k])
            np.add.at(full, flat, g[owner])
            full = full / n - decay * field.w[k]
            g2w[k] += full**2
            field.w[k] += rate * full / np.sqrt(g2w[k])
        dp = dp / n - decay * field.pairs
        g2p += dp**2
        field.pairs += rate * dp / np.sqrt(g2p)
    return field


def _emissions(table_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores of each label at each place of padded lines; table_[k, word]: own, next, before."""
    on = (ids >= 0)[..., None]
    out = table_[0][ids] * on
    out[:, 1:] += table_[1][ids[:, :-1]] * on[:, :-1]
    out[:, :-1] += table_[2][ids[:, 1:]] * on[:, 1:]
    return out


def viterbi(emit: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest labels of padded lines, longest first."""
    n, width, L = emit.shape
    back = np.zeros((n, width, L), dtype=np.int8)
    score = emit[:, 0].copy()
    for t in range(1, width):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        z = score[:live, :, None] + pairs[None]
        best = z[:, 0]
        arg = np.zeros((live, L), dtype=np.int8)
        for k in range(1, L):
            more = z[:, k] > best
            best = np.where(more, z[:, k], best)
            arg[more] = k
        back[:live, t] = arg
        score[:live] = best + emit[:live, t]
    out = np.zeros((n, width), dtype=np.int8)
    now, rows_ = score.argmax(1).astype(np.int8), np.arange(n)
    for t in range(width - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        out[:live, t] = now[:live]
        if t:
            now[:live] = back[rows_[:live], t, now[:live]]
    return out


def viterbi_long(emit, n: int, pairs: np.ndarray, step: int) -> np.ndarray:
    """The likeliest labels of one line of n words; emit(a, b) gives the scores of words a to b.

    The first pass keeps the score before each run of `step` words; back pointers are made run by run, from the last.
    """
    score = emit(0, 1)[0].tolist()
    into = pairs.T.tolist()

    def run(score, a, b, back=None):
        for e in emit(a, b).tolist():
            ways = [[s + w for s, w in zip(score, column)] for column in into]
            best = [max(way) for way in ways]
            if back is not None:
                back.append([way.index(m) for way, m in zip(ways, best)])
            score = [m + x for m, x in zip(best, e)]
        return score

    starts = range(1, n, step)
    held = [score]
    for a in starts[:-1]:
        held.append(run(held[-1], a, a + step))
    out = np.zeros(n, dtype=np.int8)
    now = None
    for a, before in zip(reversed(starts), reversed(held)):
        back: list[list[int]] = []
        end = run(before, a, min(n, a + step), back)
        now = end.index(max(end)) if now is None else now
        for k in range(len(back) - 1, -1, -1):
            out[a + k] = now
            now = back[k][now]
    out[0] = score.index(max(score)) if now is None else now
    return out


class Tagger:
    """Spans of the field in many texts; remembers the scores of words."""

    def __init__(self, field: Field):
        self.field, self.known, self.classes = field, {}, {}
        self.rows = np.zeros((3, 0, len(LABELS)), dtype=np.float32)

    def _ids(self, lines: list[list[str]]) -> list[np.ndarray]:
        words = set().union(*lines)
        new = words.difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, words
        fresh = []
        for w in new:
            seen = word_class(w)
            at = self.classes.get(seen)
            if at is None:
                at = self.classes[seen] = len(self.classes)
                fresh.append(self.field.scores(seen))
            self.known[w] = at
        if fresh:
            self.rows = np.concatenate([self.rows, np.stack(fresh, axis=1).astype(np.float32)], axis=1)
        get = self.known.__getitem__
        return [np.fromiter(map(get, line), dtype=np.int32, count=len(line)) for line in lines]

    def labels(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The label of each word of each line."""
        out: list = [None] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        ids = self._ids(lines)
        pairs = self.field.pairs.astype(np.float32)
        at = 0
        while at < len(order):
            width = len(lines[order[at]])
            if width > STEPS:
                long = ids[order[at]]
                out[order[at]] = viterbi_long(lambda a, b, long=long: self._scores(long, a, b), width, pairs, RUN)
                at += 1
                continue
            some = order[at : at + max(64, 200_000 // max(1, width))]
            some = [i for i in some if len(lines[i]) * 2 >= width or width <= 4] or some[:1]
            at += len(some)
            if width:
                grid = _padded([ids[i] for i in some], width, -1)
                lengths = np.array([len(lines[i]) for i in some])
                got = viterbi(_emissions(self.rows, grid), pairs, lengths)
                for i, row in zip(some, got):
                    out[i] = row[: len(lines[i])]
            else:
                for i in some:
                    out[i] = np.zeros(0, dtype=np.int8)
        return out

    def _scores(self, ids: np.ndarray, a: int, b: int) -> np.ndarray:
        """Scores of words a to b of a line, with their neighbours' shares."""
        return _emissions(self.rows, ids[None, max(0, a - 1) : b + 1])[0, min(a, 1) :][: b - a]

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of each text, ascending."""
        lines, owner = [], []
        for k, text in enumerate(texts):
            for line in (text or "").split("\n"):
                if found := line.split():
                    lines.append(found)
                    owner.append(k)
        marked: dict[int, list[np.ndarray]] = {}
        got = self.labels(lines) if lines else []
        hit = {owner[i] for i, row in enumerate(got) if row.any()}
        for i, row in enumerate(got):
            if owner[i] in hit:
                marked.setdefault(owner[i], []).append(row)
        return [self._placed(t, np.concatenate(marked[k])) if k in marked else [] for k, t in enumerate(texts)]

    @staticmethod
    def _placed(text: str, labels: np.ndarray) -> list[tuple[int, int, int]]:
        out, at, before, line = [], 0, 0, 0
        for part in text.split("\n"):
            pos = line
            for word in part.split():
                pos = text.index(word, pos)
                label = int(labels[at])
                if label:
                    if out and before == label and out[-1][3] == line:
                        out[-1][2] = pos + len(word)
                    else:
                        out.append([pos, label, pos + len(word), line])
                before = label
                pos += len(word)
                at += 1
            line += len(part) + 1
        spans = []
        for a, label, b, _ in out:
            kind = KINDS.index(LABELS[label])
            edge = {"secret": "\"'.,;:|#$%&*!?()[]<>=", "phone": "\"'.,;:|[]"}.get(LABELS[label], "\"'.,;:|")
            while a < b and text[a] in edge:
                a += 1
            while b > a and text[b - 1] in edge:
                b -= 1
            if b > a:
                spans.append((a, kind, b))
        return spans


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def all_spans(tagger: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        added = [s for s in more if all(s[2] <= a or b <= s[0] for a, _, b in base)]
        out.append((base, sorted(base + added)))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def chunks(texts: list, size: int = 400_000):
    """Runs of texts of about so many characters."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t or "")
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of base spans, digest of base spans, all spans."""
    field = field or default_field()

    def found(batches):
        tagger = Tagger(field)
        for batch in sliced(batches):
            texts = column_of(batch, "text")
            got = [x for some in chunks(texts) for x in all_spans(tagger, some)]
            counts = [np.bincount([k for _, k, _ in base], minlength=5)[:4] if base else np.zeros(4, dtype=np.int64) for base, _ in got]
            counts = np.array(counts, dtype=np.int64).reshape(-1, 4)
            sha = [hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in got]
            cols = [batch.column(batch.schema.get_field_index("doc_id")), *[pa.array(np.ascontiguousarray(c)) for c in counts.T], pa.array(sha), pa.array([digest(s) for _, s in got], pa.string())]
            yield pa.record_batch(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        trimmed(found), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with every span, and spans that overlap as one, replaced by its first kind in brackets."""
    out, at, end = [], 0, -1
    for a, k, b in spans:
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = end = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with the spans of each text masked; n_chars follows where docs have it."""
    field, names = field or default_field(), docs.columns

    def cleaned(batches):
        tagger = Tagger(field)
        for batch in sliced(batches):
            texts = column_of(batch, "text")
            got = [x for some in chunks(texts) for x in all_spans(tagger, some)]
            texts = [masked(t, s) if s else t for t, (_, s) in zip(texts, got)]
            cols = [pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(i) for i, n in enumerate(batch.schema.names)]
            yield pa.record_batch(cols, batch.schema.names)

    out = docs.mapInArrow(trimmed(cleaned), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: spans of every whole text."""
    return find(table(spark, sf_dir, "documents"))
