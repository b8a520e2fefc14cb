"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

The patterns of ``base_spans`` find e-mail addresses, IP addresses, card and phone
numbers.  The field labels the words that could be such data at all: those with a
digit or an ``@``.  Other words are clamped to "none", which cuts the chain exactly
there, so that most documents need no inference.  Neighbouring words share a
potential, and so do distant words of a document that are equal, or alike, without
their punctuation.  Messages are passed along both for a fixed number of rounds
with damping.  Weights are fitted on a bounded sample of documents, labelled by the patterns.
Words outside any pattern's span whose label is likely enough become spans of
their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, small_batches

#: The kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000  # documents that the field is fitted on at most
FEATURES = 1024
LABELS = len(KINDS) + 1
ROUNDS = 8  # of message passing
EPOCHS = 40
SURE = 0.95  # marginal from which a word becomes a span
ALIKE = 8  # leading characters that alike words share

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long runs of letters cost nothing."""
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCALS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            at = done = m.end()
        else:
            at += 1


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers whose parts are at most 255: each chain of dotted numbers by fours, in one pass."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_part_ok, four)):
                    yield at, end
                at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' spans, in code points, by start and kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _digit.search(text):
        out += [(s, 1, e) for s, e in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


_digit = re.compile("[0-9]")
_active = re.compile("[0-9@]")


def shape(word: str) -> str:
    """The word with letters as a and digits as 9."""
    return re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word))


def runs(word: str) -> str:
    """The word's shape with equal characters in a row once."""
    return re.sub(r"(.)\1+", r"\1", shape(word))


def features(word: str, left: str, right: str) -> list[int]:
    own = shape(word)
    names = ("bias", f"shape {own}", f"runs {runs(word)}", f"length {min(len(word), 24)}", f"digits {min(sum(c.isdigit() for c in word), 20)}", f"dots {word.count('.')}", f"at {word.count('@')}", f"first {own[:1]}", f"left {runs(left)}", f"right {runs(right)}")
    return [_crc(n) % FEATURES for n in names]


class Words:
    """The words of a text that could be personal data, with their features and links."""

    def __init__(self, text: str) -> None:
        spans, words, left, right = [], [], [], []
        at = 0
        while m := _active.search(text, at):
            start = m.start()
            while start > at and text[start - 1] not in " \t\n\r\x0b\x0c":
                start -= 1
            end = _WORD.match(text, start).end()
            between = _WORD.findall(text, at, start)
            spans.append((start, end))
            words.append(text[start:end])
            left.append(between[-1] if between else words[-2] if len(words) > 1 else "")
            if len(words) > 1:
                right.append(between[0] if between else words[-1])
            at = end
        if words:
            after = _WORD.search(text, at)
            right.append(after[0] if after else "")
        self.spans = spans
        self.features = list(map(features, words, left, right))
        keys = [re.sub(r"[^0-9A-Za-z]", "", w).lower() for w in words]
        chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] == 1]
        skip = []
        for kind in (lambda k: k, lambda k: k[:ALIKE] if len(k) > ALIKE else ""):
            last: dict[str, int] = {}
            for i, k in enumerate(keys):
                key = kind(k)
                if key:
                    if key in last:
                        skip.append((last[key], i))
                    last[key] = i
        self.chain, self.skip = chain, sorted(set(skip) - set(chain))

    def labels(self, base: list[tuple[int, str, int]]) -> list[int]:
        return [KINDS.index(hit) + 1 if hit else 0 for hit in overlapping(self.spans, base)]


def overlapping(spans: list[tuple[int, int]], base: list[tuple[int, str, int]]) -> Iterator[str | None]:
    """Kind of the first base span that meets each of ``spans``, which follow each other; one walk for each kind."""
    of = {k: [(s, e) for s, kind, e in base if kind == k] for k in KINDS}
    place = dict.fromkeys(KINDS, 0)
    for s, e in spans:
        best = None
        for k, own in of.items():
            at = place[k]
            while at < len(own) and own[at][1] <= s:
                at += 1
            place[k] = at
            if at < len(own) and own[at][0] < e and (best is None or own[at][0] < best[0]):
                best = own[at][0], k
        yield best[1] if best else None


def _crc(name: str) -> int:
    from zlib import crc32

    return crc32(name.encode())


class Field:
    """Weights: word features by label, and potentials of neighbours and of skip links."""

    def __init__(self) -> None:
        self.word = np.zeros((FEATURES, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = np.zeros((LABELS, LABELS))

    def marginals(self, features: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beliefs of words (n, labels) and of links, after loopy message passing; messages are logarithms."""
        n = len(features)
        own = self.word[features].sum(axis=1)
        links = np.concatenate((chain, skip))
        m = len(links)
        kinds = ((slice(0, len(chain)), np.exp(self.chain)), (slice(len(chain), m), np.exp(self.skip)))
        ahead, back = np.zeros((m, LABELS)), np.zeros((m, LABELS))
        a, b = links[:, 0], links[:, 1]
        to = (np.concatenate((a, b))[:, None] * LABELS + np.arange(LABELS)).ravel()

        def total() -> np.ndarray:
            return own + np.bincount(to, np.concatenate((back, ahead)).ravel(), n * LABELS).reshape(n, LABELS)

        def sent(x: np.ndarray, over: int) -> np.ndarray:
            """Messages over the links' potentials, summed over their first (0) or second (1) word."""
            x = np.exp(x - x.max(axis=1, keepdims=True))
            out = np.log(np.concatenate([x[part] @ (table.T if over else table) for part, table in kinds]))
            return out - out.max(axis=1, keepdims=True)

        for _ in range(ROUNDS if m else 0):
            belief = total()
            to_b, to_a = sent(belief[a] - back, 0), sent(belief[b] - ahead, 1)
            ahead, back = 0.5 * (ahead + to_b), 0.5 * (back + to_a)
        belief = total()
        words = np.exp(belief - _log_sum(belief, 1)[:, None]) if n else belief
        if not m:
            return words, np.zeros((0, LABELS, LABELS)), links
        one, two = (np.exp(x - x.max(axis=1, keepdims=True)) for x in (belief[a] - back, belief[b] - ahead))
        pair = one[:, :, None] * two[:, None, :]
        for part, table in kinds:
            pair[part] *= table
        return words, pair / pair.sum(axis=(1, 2), keepdims=True), links

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        """Gradient ascent on the likelihood, with expectations from message passing (Adagrad, L2)."""
        if not documents:
            return
        features = np.concatenate([d[0] for d in documents])
        base = np.cumsum([0, *(len(d[0]) for d in documents)])
        chain = np.concatenate([d[1] + o for d, o in zip(documents, base)]).astype(int)
        skip = np.concatenate([d[2] + o for d, o in zip(documents, base)]).astype(int)
        truth = np.concatenate([d[3] for d in documents])
        n = len(truth)
        past = [np.full(w.shape, 1e-8) for w in (self.word, self.chain, self.skip)]
        for _ in range(epochs):
            words, pair, links = self.marginals(features, chain, skip)
            off = -words
            off[np.arange(n), truth] += 1
            grads = [np.zeros_like(w) for w in (self.word, self.chain, self.skip)]
            for k in range(LABELS):
                grads[0][:, k] = np.bincount(features.ravel(), np.repeat(off[:, k], features.shape[1]), FEATURES)
            for g, part, expected in ((grads[1], chain, pair[: len(chain)]), (grads[2], skip, pair[len(chain) :])):
                g += np.bincount(truth[part[:, 0]] * LABELS + truth[part[:, 1]], minlength=LABELS * LABELS).reshape(g.shape)
                g -= expected.sum(axis=0)
            for w, g, p in zip((self.word, self.chain, self.skip), grads, past):
                g -= 0.01 * n / FEATURES * w
                p += g * g
                w += 0.5 * g / np.sqrt(p)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _links(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, np.int64).reshape(-1, 2)


def added_spans(text: str, base: list[tuple[int, str, int]], field: Field, sure: float = SURE) -> list[tuple[int, str, int]]:
    """Spans that the field adds: likely words apart from all base spans, without outer punctuation."""
    if not _active.search(text):
        return []
    words = Words(text)
    marginal, _, _ = field.marginals(np.array(words.features, np.int64), _links(words.chain), _links(words.skip))
    likely = []
    for (s, e), k, p in zip(words.spans, marginal.argmax(axis=1).tolist(), marginal.max(axis=1).tolist()):
        if k and p >= sure:
            while s < e and text[s] in ".,;:!?()[]{}\"'<>":
                s += 1
            while e > s and text[e - 1] in ".,;:!?()[]{}\"'<>":
                e -= 1
            if s < e:
                likely.append((s, KINDS[k - 1], e))
    taken = overlapping([(s, e) for s, _, e in likely], base)
    return [x for x, hit in zip(likely, taken) if hit is None]


def fit_field(rows: DataFrame, sample: int = SAMPLE) -> Field:
    """Field fitted on at most ``sample`` whole documents (doc_id, t) with candidate words.

    They are chosen by a hash of id and text, and only hashes are put in order;
    the texts chosen are read after that.  Equal rows count once.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(key, Words(text), text) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            kind = pa.list_(pa.int32())
            flat = lambda values: pa.array([np.array(v, np.int32).ravel() for v in values], kind)
            cols = [flat(w.features for _, w, _ in got), flat(w.chain for _, w, _ in got), flat(w.skip for _, w, _ in got), flat(w.labels(base_spans(text)) for _, w, text in got)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in got], pa.int64()), *cols], ["h", "f", "c", "s", "y"])

    active = rows.where(F.col("t").rlike("[0-9@]")).select(F.xxhash64("doc_id", "t").alias("h"), "t")
    chosen = cut(active.select("h").distinct().orderBy("h").limit(sample))
    some = active.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])
    got = some.mapInArrow(prepare, "h long, f array<int>, c array<int>, s array<int>, y array<int>").toArrow().sort_by("h")
    documents = []
    for f, c, k, y in zip(*(got[name] for name in ("f", "c", "s", "y"))):
        f, c, k, y = (x.values.to_numpy().astype(np.int64) for x in (f, c, k, y))
        documents.append((f.reshape(len(y), -1), c.reshape(-1, 2), k.reshape(-1, 2), y))
    field = Field()
    field.fit(documents)
    return field


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Personal data in every text: the patterns' spans, and those that the field adds.

    Returns (doc_id, base, added, masked): lists of (kind, start, end) in code
    points, by start and kind, and the text with every span replaced by its kind
    in brackets (of overlapping ones the union, by the first kind).  Null texts
    count as empty and stay null in ``masked``.  Rows without an id and repeated
    rows are treated each on their own.  Very long texts are read whole, in time that
    grows with their length.  Spans that start together are in order of kind.  Other
    columns are not read, but for those of ``keep``, which come along unchanged;
    ``prefix`` goes before the names base, added and masked, for where they would
    clash.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = list(keep or [])
    fields = [f for k in keep for f in docs.schema.fields if f.name == k]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    field = spark.sparkContext.broadcast(fit_field(rows, sample))
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, added, masked = [], [], []
            for text_ in b.column(1).to_pylist():
                base = base_spans(text_ or "")
                more = added_spans(text_ or "", base, field.value)
                bases.append([{"kind": k, "start": s, "end": e} for s, k, e in base])
                added.append([{"kind": k, "start": s, "end": e} for s, k, e in more])
                masked.append(mask(text_, base + more) if text_ else text_)
            rest = b.columns[2:]
            yield pa.RecordBatch.from_arrays([b.column(0), *rest, pa.array(bases, kind), pa.array(added, kind), pa.array(masked, pa.string())], ["doc_id", *keep, *(prefix + n for n in ("base", "added", "masked"))])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields, *T._parse_datatype_string(f"`{prefix}base` {span}, `{prefix}added` {span}, `{prefix}masked` string").fields])
    carried = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"), *[F.col(f"`{k}`") for k in keep])
    return carried.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, str, int]]) -> str:
    out, at, open_ = [], 0, None
    for s, k, e in sorted(spans):
        if open_ and s < open_[1]:
            open_ = (open_[0], max(open_[1], e))
        else:
            if open_:
                at = open_[1]
            out.append(text[at:s])
            out.append(f"[{k.upper()}]")
            open_ = (s, e)
    if open_:
        at = open_[1]
    out.append(text[at:])
    return "".join(out)
