"""Language-model scoring by masked pseudo-likelihood.

A token is a word, known by a 64-bit hash whose low bits tell the word's ending.
Tokens fall into classes: the most frequent are classes of their own, the others
are classed by ending.  A window network, trained in numpy, predicts the class
of every token from the two tokens on either side (the nearer as classes, the
outer ones coarsely).  Within its class a token is predicted from the class on
its left and the class on its right: corpus counts of the token beside that
class, by absolute discounting with the token's share of its class below.  The
sum of all conditional log-probabilities scores a document.

The vocabulary is a table of all words of the corpus with their counts beside
each class; it is written to the shared folder, grows with the corpus, and is
joined with the words of documents.  Words that make up 1 / ``HEAD`` of the
corpus, of which there are ``HEAD`` at most, are looked up in the tasks instead,
so that no word has a large part of the join.

The network sees a window as four small numbers, so that for it the corpus is,
without loss, a table of counts of (context, class).  Tasks count their own
documents, counts are added up by a shuffle, and the network is fitted to the
table on the driver: every token of every document is trained on.  For scoring
the network is tabulated once over all contexts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, forget, small_batches
from .textkit import _U, text_blocks, word_hashes, word_spans

HEAD = 1 << 16  # words that are at least this part of all are looked up in tasks
ENDINGS = 24
FREQUENT = 24
CLASSES = ENDINGS + FREQUENT
EDGE = CLASSES  # class of what lies before and after a document
RIGHT = 64  # added to a class to the right, where those to the left are as they are
CELL = 127  # in place of a class: the count is of a context and class, not of a word
COARSE = 4  # outer tokens: edge, frequent, and two halves of the endings
NEAR_DIM, FAR_DIM, HIDDEN = 12, 4, 48
EPOCHS = 40
RATE = 0.01
DISCOUNT = 0.75  # taken off each count of a word beside a class
UNSEEN = 0.5  # added to each count of a word, and the count of a class's unknown words
HELD = 1 << 20  # tokens that a task counts at a time, and words that it sends at a time
MOST = (1 << 24) - 1  # count that has room below a class
NAMES = ["doc_id", "row", "n_tokens", "known", "w", "at", "l", "r"]  # rows of documents, and of words in them


def token_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Tokens of each text: hashes whose five low bits are the ending."""
    for _, raw, at in text_blocks(column):
        starts, ends, first = word_spans(raw, at)
        last = raw[ends - 1].astype(np.int64)
        second = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        ending = (last * 31 + second * 17) % ENDINGS
        token = (word_hashes(raw, starts, ends, True) & ~_U(31)).view(np.int64) | ending
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield token[a:b]


def _found(tokens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token in the sorted ``known``, and whether it is there."""
    if not len(known):
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return at, known[at] == tokens


def classes_of(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Class of every token: its place in the sorted ``frequent``, else its ending."""
    at, hit = _found(tokens, frequent)
    return np.where(hit, at, FREQUENT + (tokens & 31))


def _class_column(word: Column, frequent: np.ndarray) -> Column:
    out = (F.lit(FREQUENT) + word.bitwiseAND(F.lit(31))).cast("int")
    for i, t in enumerate(frequent.tolist()):
        out = F.when(word == F.lit(t), F.lit(i)).otherwise(out)
    return out


def beside(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes to the left and right of each token of a document."""
    wide = np.concatenate(([EDGE], classes, [EDGE]))
    return wide[: len(classes)], wide[2:]


def coarse(classes: np.ndarray) -> np.ndarray:
    return np.where(classes == EDGE, 0, np.where(classes < FREQUENT, 1, 2 + classes % 2))


def contexts(classes: np.ndarray) -> np.ndarray:
    """Number of each token's context in a document: outer left, left, right, outer right."""
    wide = np.concatenate(([EDGE, EDGE], classes, [EDGE, EDGE]))
    rough = coarse(wide)
    n = len(classes)
    side = CLASSES + 1
    return ((rough[:n] * side + wide[1 : n + 1]) * side + wide[3 : n + 3]) * COARSE + rough[4 : n + 4]


N_CONTEXTS = COARSE * (CLASSES + 1) ** 2 * COARSE


def _parts(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    side = CLASSES + 1
    return context // (COARSE * side * side), context // (COARSE * side) % side, context // COARSE % side, context % COARSE


class Network:
    """Embeddings of the four neighbours, a hidden tanh layer, and a softmax over classes."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        width = 2 * NEAR_DIM + 2 * FAR_DIM
        shape = {"l2": (COARSE, FAR_DIM), "l1": (CLASSES + 1, NEAR_DIM), "r1": (CLASSES + 1, NEAR_DIM), "r2": (COARSE, FAR_DIM), "w": (width, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, CLASSES), "c": (CLASSES,)}
        self.p = {k: rng.normal(0, 0.3 if len(s) < 2 or k in ("l2", "l1", "r1", "r2") else s[0] ** -0.5, s) for k, s in shape.items()}
        self.p["b"][:] = 0
        self.p["c"][:] = 0

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values and log-probabilities of the classes in each context."""
        x = np.concatenate([self.p[k][i] for k, i in zip(("l2", "l1", "r1", "r2"), _parts(context))], axis=1)
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        z = h @ self.p["v"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, table: np.ndarray, epochs: int = EPOCHS, batch: int = 2048) -> list[float]:
        """Adam on the counts (contexts, classes); the mean log-likelihood of each epoch."""
        seen = np.flatnonzero(table.sum(axis=1))
        if not len(seen):
            return []
        mean = table.sum() / -(-len(seen) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng = np.random.default_rng(11)
        history, t = [], 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            total = 0.0
            for at in np.array_split(rng.permutation(seen), -(-len(seen) // batch)):
                n = table[at] / mean
                x, h, logp = self.forward(at)
                total += float((n * logp).sum())
                dz = np.exp(logp) * n.sum(axis=1, keepdims=True) - n
                dh = (dz @ self.p["v"].T) * (1 - h * h)
                dx = dh @ self.p["w"].T
                g = {"v": h.T @ dz, "c": dz.sum(axis=0), "w": x.T @ dh, "b": dh.sum(axis=0)}
                lo = 0
                for k, i in zip(("l2", "l1", "r1", "r2"), _parts(at)):
                    size = self.p[k].shape[1]
                    g[k] = np.zeros_like(self.p[k])
                    np.add.at(g[k], i, dx[:, lo : lo + size])
                    lo += size
                t += 1
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    s[k] += 0.01 * (d * d - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
            history.append(total * mean / table.sum())
        return history

    def tabulated(self) -> np.ndarray:
        return np.concatenate([self.forward(at)[2].astype(np.float32) for at in np.array_split(np.arange(N_CONTEXTS), 16)])


@dataclass
class Model:
    frequent: np.ndarray  # tokens that are classes of their own, sorted
    words: DataFrame  # (w, n, beside): count of each word, and by class beside it the discounted share
    total: int  # tokens of the corpus
    below: np.ndarray  # (classes, classes beside) what discounts leave for shares without context
    scale: np.ndarray  # sum of a class's counts, each with UNSEEN, and of its unknown words
    network: Network

    def spread(self, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What a token's count, with UNSEEN, is multiplied by for the part of its probability without context."""
        return (self.below[c, left] + self.below[c, right + RIGHT]) / (2 * self.scale[c])

    def log_probabilities(self, tokens: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Conditional log-probability of each token of a document, by ``table`` or the network itself."""
        c = classes_of(tokens, self.frequent)
        at = contexts(c)
        by_class = table[at, c] if table is not None else self.network.forward(at)[2][np.arange(len(c)), c]
        known = {r.w: (r.n, r.beside) for r in self.words.where(F.col("w").isin(np.unique(tokens).tolist())).collect()}
        left, right = beside(c)
        rows = [known.get(t, (0, {})) for t in tokens.tolist()]
        seen = np.array([(b.get(x, 0.0) + b.get(y + RIGHT, 0.0)) / 2 for (_, b), x, y in zip(rows, left.tolist(), right.tolist())])
        return by_class + np.log(seen + self.spread(c, left, right) * (np.array([n for n, _ in rows]) + UNSEEN))


def _counts(docs: DataFrame, text: str, keys: Callable[[list[np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """Table (w, k, n): sums of the counts that ``keys`` makes of some documents' tokens, sorted by w, over all documents.

    A row on its way has all counts of a word in one number each, k above n; what meets in a group was added up before.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for w, k, n in keys(held):
                times = -(-n // MOST)
                if len(n) and times.max() > 1:  # of a document of very many words
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    w, k, n = np.repeat(w, times), np.repeat(k, times), np.minimum(np.repeat(n, times) - nth * MOST, MOST)
                new = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
                ends = np.append(new, len(w))
                pairs = (k.astype(np.int32) << 24 | n.astype(np.int32)).astype(np.int32)
                for at in range(0, len(new), 1 << 16):
                    last = min(at + (1 << 16), len(new))
                    lists = pa.ListArray.from_arrays(pa.array((ends[at : last + 1] - ends[at]).astype(np.int32)), pa.array(pairs[ends[at] : ends[last]]))
                    yield pa.RecordBatch.from_arrays([pa.array(w[new[at:last]].astype(np.int64)), lists], ["w", "pairs"])

        held, size = [], 0
        for b in batches:
            for tokens in token_lists(b.column(0)):
                if len(tokens):
                    held.append(tokens.copy())
                    size += len(tokens)
                if size > HELD:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    pairs = docs.select(text).mapInArrow(add, "w long, pairs array<int>").repartition("w").select("w", F.explode("pairs").alias("p"))
    return cut(pairs.groupBy("w", F.shiftright("p", 24).alias("k")).agg(F.sum(F.col("p").bitwiseAND(F.lit(MOST)).cast("long")).alias("n")))


def _alone(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    w, n = np.unique(np.concatenate(held), return_counts=True)
    yield w, np.zeros(len(w), np.int64), n


def train(docs: DataFrame, text: str = "text", epochs: int = EPOCHS) -> Model:
    """Model of all texts.  Its table of words has all of them; the driver gets the contexts' counts and at most HEAD words."""
    alone = _counts(docs, text, _alone)
    total = alone.agg(F.sum("n")).first()[0] or 0
    often = sorted(alone.where(F.col("n") * HEAD >= total).select("n", "w").collect(), key=lambda r: (-r.n, r.w))
    frequent = np.sort(np.array([r.w for r in often[:FREQUENT]], np.int64))
    forget(alone)

    def pairs(held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        c = [classes_of(t, frequent) for t in held]
        cell, n = np.unique(np.concatenate([contexts(x) * CLASSES + x for x in c]), return_counts=True)
        yield cell, np.full(len(cell), CELL), n
        words, place = np.unique(np.concatenate(held), return_inverse=True)
        sides = [beside(x) for x in c]
        both = [place * (2 * RIGHT) + np.concatenate([x[side] for x in sides]) + plus for side, plus in ((0, 0), (1, RIGHT))]
        key, n = np.unique(np.concatenate(both), return_counts=True)
        yield words[key // (2 * RIGHT)], key % (2 * RIGHT), n

    counts = _counts(docs, text, pairs)
    got = counts.where(F.col("k") == CELL).select("w", "n").toArrow()
    table = np.zeros(N_CONTEXTS * CLASSES, np.int64)
    table[got["w"].to_numpy()] = got["n"].to_numpy()
    table = table.reshape(N_CONTEXTS, CLASSES)
    network = Network()
    network.fit(table.astype(np.float64) if epochs else table, epochs)

    near = counts.where(F.col("k") != CELL).withColumn("c", _class_column(F.col("w"), frequent))
    sums = cut(near.groupBy("c", "k").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")))
    below = np.ones((CLASSES, 2 * RIGHT))
    for r in sums.collect():
        below[r.c, r.k] = DISCOUNT * r.kinds / r["all"]
    share = (F.col("n") - DISCOUNT) / F.col("all")
    words = near.join(F.broadcast(sums.select("c", "k", "all")), ["c", "k"]).groupBy("w", "c")
    words = words.agg(F.sum(F.when(F.col("k") < RIGHT, F.col("n")).otherwise(0)).alias("n"), F.map_from_entries(F.collect_list(F.struct("k", share.alias("share")))).alias("beside"))
    words = cut(words)
    forget(counts, sums)
    scale = np.full(CLASSES, UNSEEN)
    for r in words.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        scale[r.c] += r.n + UNSEEN * r.kinds
    return Model(frequent, words.drop("c"), total, below, scale, network)


def lm_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, head: int = HEAD) -> DataFrame:
    """Score every text by the pseudo-likelihood of its tokens under a model of all texts.

    Returns (doc_id, n_tokens, log_likelihood, mean_log_likelihood); the sum and
    mean of the conditional log-probabilities.  Null and empty texts, and those
    of white space only, have no tokens, sum 0 and a null mean.  Rows without an
    id and repeated rows are scored (and trained on) each on its own.  Very long texts are
    read whole.  Words that are 1 / ``head`` of the corpus are looked up in tasks,
    others by a join.  Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    got = model or train(docs, text)
    often = sorted(got.words.where(F.col("n") * head >= got.total).collect(), key=lambda r: r.w)
    known = np.array([r.w for r in often], np.int64)
    count = np.array([r.n for r in often], float)
    seen = np.zeros((len(often), 2 * RIGHT), np.float32)
    for i, r in enumerate(often):
        seen[i, list(r.beside)] = list(r.beside.values())
    shared = spark.sparkContext.broadcast((Model(got.frequent, None, got.total, got.below, got.scale, None), got.network.tabulated(), known, count, seen))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, table, known, count, seen = shared.value
        held, base, size = [], None, 0

        def words_of() -> Iterator[pa.RecordBatch]:
            """Rows of the words held: where each is, and the classes beside it there."""
            w, at, left, right = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(w, kind="stable")
            w, at, left, right = w[order], at[order], left[order], right[order]
            new = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            ends = np.append(new, len(w))
            for lo in range(0, len(new), 1 << 16):
                hi = min(lo + (1 << 16), len(new))
                offsets, part = pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), slice(ends[lo], ends[hi])
                none = [pa.nulls(hi - lo, k) for k in (pa.int64(), pa.int64(), pa.float64())]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[part].astype(k))) for x, k in ((at, np.int32), (left, np.int8), (right, np.int8))]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(np.full(hi - lo, base)), *none[1:], pa.array(w[new[lo:hi]]), *lists], NAMES)

        for b in batches:
            n, total = [], []
            for row, tokens in zip(b.column(2).to_numpy().tolist(), token_lists(b.column(1))):
                c = classes_of(tokens, plain.frequent)
                left, right = beside(c)
                at, hit = _found(tokens, known)
                at = at[hit]
                spread = plain.spread(c[hit], left[hit], right[hit])
                own = np.log((seen[at, left[hit]] + seen[at, right[hit] + RIGHT]) / 2 + spread * (count[at] + UNSEEN))
                n.append(len(tokens))
                total.append(float(table[contexts(c), c].sum(dtype=np.float64) + own.sum()))
                if not hit.all():
                    base = row if base is None else base
                    held.append((tokens[~hit], np.full(len(tokens) - len(at), row - base), left[~hit], right[~hit]))
                    size += len(held[-1][0])
                    if size > HELD:
                        yield from words_of()
                        held, base, size = [], None, 0
            none = [pa.nulls(len(n), k) for k in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(total, pa.float64()), *none], NAMES)
        if held:
            yield from words_of()

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the log-probabilities of joined words by row."""
        plain = shared.value[0]
        for b in batches:
            base, w, at, left, right, n, beside_ = (b.column(k) for k in range(7))
            times = np.diff(at.offsets.to_numpy())
            word = np.repeat(np.arange(b.num_rows), times)
            at, left, right = (x.flatten().to_numpy().astype(np.int64) for x in (at, left, right))
            entry = np.repeat(np.arange(b.num_rows), np.diff(beside_.offsets.to_numpy()))
            first, last = beside_.offsets[0].as_py(), beside_.offsets[-1].as_py()
            key = entry * (2 * RIGHT) + beside_.keys.to_numpy()[first:last]
            share = beside_.items.to_numpy()[first:last]
            order = np.argsort(key)
            key, share = np.append(key[order], -1), np.append(share[order], 0.0)

            def part(k: np.ndarray) -> np.ndarray:
                place = np.searchsorted(key[:-1], word * (2 * RIGHT) + k)
                return np.where(key[place] == word * (2 * RIGHT) + k, share[place], 0.0)

            spread = plain.spread(classes_of(w.to_numpy(), plain.frequent)[word], left, right)
            own = np.log((part(left) + part(right + RIGHT)) / 2 + spread * (n.fill_null(0).to_numpy()[word] + UNSEEN))
            rows, place = np.unique(base.to_numpy()[word] + at, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(place, own, len(rows)))], ["row", "tail"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.mapInArrow(score, "doc_id long, row long, n_tokens long, known double, w long, at array<int>, l array<tinyint>, r array<tinyint>"))
    tail = rows.where("w is not null").select("row", "w", "at", "l", "r").join(got.words.where(F.col("n") * head < got.total), "w", "left")
    tail = tail.select("row", "w", "at", "l", "r", "n", F.coalesce("beside", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))))
    tail = tail.mapInArrow(tails, "row long, tail double").groupBy("row").agg(F.sum("tail").alias("tail"))
    rows = rows.where("w is null")
    out = rows.drop("w", "at", "l", "r").join(tail, "row", "left").withColumn("log_likelihood", F.col("known") + F.coalesce("tail", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
