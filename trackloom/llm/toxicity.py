"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the five-letter heads of longer words; the vector space has
all terms of the examples.  Their document frequencies are those of all texts.
A term's weight is its inverse document frequency times how surely toxic
examples have it more often than others, and never nothing.  Examples lie in
blocks, similar ones together.  For each term the index has a posting list of
(example, weight), and for each block that the list meets the largest weight; the
lists of the most frequent terms are rows of a matrix, so that queries of a batch
share them.  A query visits the blocks of the largest upper bounds, then those
that may still hold an example as near as its k-th; what it finds is exact.
Neighbours vote by distance, and isotonic regression on the examples' own
left-out votes turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, release, small_batches
from .textkit import _U, factor, text_blocks, word_hashes

EXAMPLES = 3000  # of each label at most: the bound of the sample that the classifier is fitted on
CAUTION = 2.0  # standard errors that a term's log-odds among toxic examples count less
LEAST = 0.1  # added to what is left of them, the weight of terms that tell nothing
NEIGHBOURS = 16
BLOCK = 128  # examples in a block of the index
COMMON = 1024  # most frequent terms, whose posting lists are rows of a matrix
BATCH = 64  # queries that share a pass over it
BEST = 4  # blocks that a query visits first
HEAD = 5  # bytes of a word's head
THRESHOLD = 0.7

#: Bytes that are part of a word: ASCII letters and digits, and all of multi-byte characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the terms of each text, with repetitions."""
    for _, raw, at in text_blocks(column):
        inside = _LETTER[raw]
        before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
        cuts = at[(at > 0) & (at < len(raw))]
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) if len(raw) else inside.copy()
        after[cuts - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        whole = word_hashes(raw, starts, ends, True)
        long = np.flatnonzero(ends - starts > HEAD)
        heads = word_hashes(raw, starts[long], starts[long] + HEAD, True) ^ factor(1, 0)
        first = np.searchsorted(starts, at)
        cut_heads = np.searchsorted(starts[long], at)
        for i in range(len(at) - 1):
            yield np.concatenate((whole[first[i] : first[i + 1]], heads[cut_heads[i] : cut_heads[i + 1]]))


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of start, start + 1, … of ``n`` each, one range after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + n, n)


@dataclass
class Index:
    """Posting lists in order of term and example, and their parts that lie in one block."""

    vocabulary: np.ndarray  # hashes of the terms, sorted
    weight: np.ndarray  # of each term
    first: np.ndarray  # (terms + 1) first part of each term's list
    block: np.ndarray  # block of each part,
    most: np.ndarray  # its largest weight, rounded up,
    posting: np.ndarray  # (parts + 1) and its first posting
    example: np.ndarray  # example of each posting,
    value: np.ndarray  # and its weight there, in unit vectors
    row: np.ndarray  # of each term in the matrix of common terms, or -1; these have no parts
    dense: np.ndarray  # (common terms, examples and what fills the last block) weights
    dense_most: np.ndarray  # (common terms, blocks) largest weights, rounded up
    size: int  # examples

    @classmethod
    def of(cls, vocabulary: np.ndarray, weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], common: int = COMMON) -> Index:
        """Index of sparse unit ``vectors``: term numbers and values (kept in single precision) of each example."""
        size, terms = len(vectors), len(vocabulary)
        n = np.array([len(t) for t, _ in vectors], np.int64)
        example = np.repeat(np.arange(size, dtype=np.int32), n)
        term = np.concatenate([t for t, _ in vectors], dtype=np.int32, casting="same_kind") if vectors else np.zeros(0, np.int32)
        value = np.concatenate([v for _, v in vectors], dtype=np.float32, casting="same_kind") if vectors else np.zeros(0, np.float32)
        often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:common]
        row = np.full(terms, -1, np.int32)
        row[often] = np.arange(len(often))
        blocks = -(-size // BLOCK)
        dense = np.zeros((len(often), blocks * BLOCK), np.float32)
        at = row[term] >= 0
        dense[row[term[at]], example[at]] = value[at]
        dense_most = dense.reshape(len(often), blocks, BLOCK).max(axis=2) if size else np.zeros((len(often), 0), np.float32)
        term, example, value = term[~at], example[~at], value[~at]
        order = np.argsort(term, kind="stable")
        term, example, value = term[order], example[order], value[order]
        del order, at
        block = (example // BLOCK).astype(np.int16)
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(value, new) if len(new) else np.zeros(0, np.float32)
        first = np.searchsorted(term[new], np.arange(terms + 1))
        return cls(vocabulary, weight, first.astype(np.int32), block[new], most, np.append(new, len(term)).astype(np.int32), example, value, row, dense, dense_most, size)

    def vector(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of a text: numbers of those of its terms that examples have, and their weights."""
        if not len(self.vocabulary) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        terms, n = np.unique(terms, return_counts=True)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        return weighed(at[known], n[known], self.weight)

    def _sums(self, start: np.ndarray, n: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """Sums over ranges of postings, by example."""
        seen = _places(start, n)
        return np.bincount(self.example[seen], np.repeat(pull, n) * self.value[seen], self.size)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of largest cosine above 0, ties by position, and their cosines."""
        out = []
        for lo in range(0, len(queries), BATCH):
            some = queries[lo : lo + BATCH]
            shared = np.zeros((len(some), len(self.dense)), np.float32)
            for i, (t, w) in enumerate(some):
                hit = self.row[t] >= 0
                shared[i, self.row[t[hit]]] = w[hit]
            got, bounds = shared @ self.dense, shared @ self.dense_most
            out += [self._nearest(t, w, got[i, : self.size].astype(float), bounds[i].astype(float), k, without[lo + i] if without else -1) for i, (t, w) in enumerate(some)]
        return out

    def _nearest(self, t: np.ndarray, w: np.ndarray, got: np.ndarray, bound: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """``got`` and ``bound`` are what common terms add to examples and blocks, in single precision."""
        slack = 1e-5  # more than single precision takes off
        rare = self.row[t] < 0
        word, pull = t[rare], w[rare]
        lists, n = self.first[word], self.first[word + 1] - self.first[word]
        parts, each = _places(lists, n), np.repeat(pull, n)
        block = self.block[parts]
        bound = bound + np.bincount(block, each * self.most[parts], len(bound)) + slack
        # an example is no nearer than what common terms add to it
        least = np.partition(got, -k - 1)[-k - 1] - slack if len(got) > k else 0.0
        open_ = bound >= least
        rest = np.zeros(self.size)
        if 2 * int(open_.sum()) > len(bound):
            start = self.posting[lists]
            rest = self._sums(start, self.posting[lists + n] - start, pull)
        else:
            # first the blocks of the largest bounds, then those that may still hold one of the k
            best = np.zeros(len(bound), bool)
            best[np.argsort(-bound, kind="stable")[:BEST]] = True
            for now in (best, open_ & ~best):
                if now is not best:
                    seen = np.repeat(best, BLOCK)[: self.size]
                    near = np.where(seen, got + rest, 0.0)
                    least = max(least, np.partition(near, -k - 1)[-k - 1] - slack) if len(near) > k else least
                    now = now & (bound >= least)
                here = np.flatnonzero(now[block])
                start = self.posting[parts[here]]
                rest += self._sums(start, self.posting[parts[here] + 1] - start, each[here])
        near = got + rest
        if without >= 0:
            near[without] = 0
        least = max(least, np.partition(near, -k)[-k] - slack) if len(near) >= k else 0.0
        place = np.flatnonzero((near >= least) & (near > 0))
        # common terms once more, in double precision
        values = rest[place] + np.einsum("i,ij->j", w[~rare], self.dense[np.ix_(self.row[t[~rare]], place)].astype(float))
        best = np.lexsort((place, -values))[:k]
        best = best[values[best] > 0]
        return place[best], values[best]


def weighed(t: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(n)) * weight[t]
    return t, w / np.sqrt((w * w).sum()) if len(t) else w


@dataclass
class Model:
    index: Index
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray  # examples of the label in all labelled rows, per example of the sample

    def votes(self, texts: list[np.ndarray], without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For the terms of each text the share of toxic examples among the nearest, by distance (-1 if there are none), these and their cosines."""
        out = []
        for places, values in self.index.nearest([self.index.vector(x) for x in texts], NEIGHBOURS, without):
            pull = self.weight[places] / (1.05 - np.minimum(values, 1))
            out.append((float((pull * self.toxic[places]).sum() / pull.sum()) if len(places) else -1.0, places, values))
        return out


@dataclass
class Calibration:
    steps: np.ndarray  # votes
    rates: np.ndarray  # and their probabilities
    rest: float  # probability of a text without any term of the examples

    def score(self, vote: float) -> float:
        return self.rest if vote < 0 else float(np.interp(vote, self.steps, self.rates))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps and weighted rates that do not fall, smoothed by half a row of each label."""
    pools: list[list[float]] = []
    for v in np.unique(x).tolist():
        at = x == v
        pools.append([v, v, float((y * w)[at].sum()), float(w[at].sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    steps, rates = [], []
    for low, high, hit, all_ in pools:
        rate = (hit + 0.5) / (all_ + 1)
        steps += [low, high] if high > low else [low]
        rates += [rate, rate] if high > low else [rate]
    return np.array(steps), np.maximum.accumulate(rates)


def document_frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``texts`` (one column) each term of the sorted ``vocabulary`` is, and how many rows there are."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for b in batches:
            total[-1] += b.num_rows
            for terms in term_lists(b.column(0)):
                if len(known) and len(terms):
                    terms = np.unique(terms)
                    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                    total[at[known[at] == terms]] += 1
        k = np.flatnonzero(total)
        for at in range(0, len(k), 1 << 16):
            part = k[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["k", "n"])

    got = texts.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    shared.destroy()
    return out[:-1], int(out[-1])


def telling(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How much more often toxic examples have a term (a of n1, b of n0): a cautious estimate of the log-odds, at least LEAST."""
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    return LEAST + np.maximum(odds - CAUTION * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), 0)


def fit(examples: DataFrame, totals: dict[int, int], texts: DataFrame) -> tuple[Broadcast[Model], Calibration]:
    """Model of at most 2 * EXAMPLES rows (doc_id, toxic, t), of ``totals`` labelled rows by label; terms are counted in ``texts``.

    Tasks get the model once, for the votes that calibrate it and for those of all texts.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.unique(x, return_counts=True) for x in term_lists(b.column(2))]
            blobs = [pa.array([x[i].astype(k).tobytes() for x in lists], pa.binary()) for i, k in ((0, _U), (1, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *blobs], ["doc_id", "toxic", "term", "n"])

    got = examples.mapInArrow(bags, "doc_id long, toxic int, term binary, n binary").toArrow().sort_by("doc_id")
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(float)
    terms = [np.frombuffer(x.as_py(), _U) for x in got["term"]]
    counts = [np.frombuffer(x.as_py(), np.int32) for x in got["n"]]
    del got
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    # numbers of half the width, freed as soon as they have served: the driver is small
    vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, _U)
    numbers = [np.searchsorted(vocabulary, t).astype(np.int32) for t in terms]
    del terms
    a, b = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for t, y in zip(numbers, toxic):
        (a if y else b)[t] += 1
    df, n_texts = document_frequencies(texts, vocabulary)
    weight = (np.log((1 + n_texts) / (1 + df)) + 1) * telling(a, b, n1, n0)
    vectors = [(t, w.astype(np.float32)) for t, w in (weighed(t, n, weight) for t, n in zip(numbers, counts))]
    del numbers, counts
    # examples of the same heaviest term lie together
    order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i))
    index = Index.of(vocabulary, weight, [vectors[i] for i in order])
    ids, toxic = ids[order], toxic[order]
    each = np.where(toxic == 1, totals.get(1, 0) / max(n1, 1), totals.get(0, 0) / max(n0, 1))
    bare = np.array([not len(vectors[i][0]) for i in order], bool)
    del vectors
    hits, all_ = float((each * toxic)[bare].sum()), float(each[bare].sum())
    calibration = Calibration(np.array([0.0, 1.0]), np.array([0.0, 1.0]), (hits + 0.5) / (all_ + 1))
    shared = examples.sparkSession.sparkContext.broadcast(Model(index, ids, toxic, each))
    del index

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {d: i for i, d in enumerate(shared.value.ids.tolist())}
        for b in batches:
            votes = [v for v, *_ in shared.value.votes(list(term_lists(b.column(2))), [where[d] for d in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64())], ["doc_id", "vote"])

    votes = dict(zip(*examples.mapInArrow(left_out, "doc_id long, vote double").toArrow().to_pydict().values()))
    votes = np.array([votes[d] for d in ids.tolist()])
    at = votes >= 0
    if at.any():
        calibration.steps, calibration.rates = isotonic(votes[at], toxic[at], each[at])
    return shared, calibration


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, threshold: float = THRESHOLD, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Score every text for toxicity by its nearest labelled examples.

    ``labels`` has ``doc_id`` and 0/1 in ``label``; ``learn``, over its doc_id,
    says which rows may be learnt from (all).  At most ``examples`` of each label
    are taken, by a hash of their id; document frequencies are those of all texts.
    Returns (doc_id, score, predicted, evidence_ids, evidence_cosines) for every
    row of ``docs``: probability, whether it is ``threshold`` or more, and the
    examples that voted, nearest first, of equal cosine by their heaviest term and
    id.  Null and empty texts, and texts without any term of an example, get the
    rate of such examples.  Very long texts are read whole.  Null labels and labels
    of unknown or null ids teach nothing; an id with labels of both kinds counts as
    toxic, and of repeated rows of an example's id the smallest text counts.  Rows
    without a doc_id and repeated rows are scored each on its own.  Without
    examples every score is 0.5.  Other columns are not read, but for those of
    ``keep``, which come along unchanged; ``prefix`` goes before the operator's
    names (all but doc_id) where they would clash.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = list(keep or [])
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("toxic"))
    known = cut(known)
    totals = dict(known.groupBy("toxic").count().collect())
    some = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        some = part if some is None else some.unionByName(part)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    found = rows.join(F.broadcast(cut(some)), "doc_id").select("doc_id", "toxic", "t")
    found = cut(found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("t").alias("t")))
    model, calibration = fit(found, totals, rows.select("t"))
    release(spark)
    names = [prefix + n for n in ("score", "predicted", "evidence_ids", "evidence_cosines")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for lo in range(0, b.num_rows, BATCH):
                got += model.value.votes(list(term_lists(b.column(1).slice(lo, BATCH))))
            scores, who, near = [calibration.score(x[0]) for x in got], [model.value.ids[x[1]] for x in got], [x[2] for x in got]
            hit = [int(s >= threshold) for s in scores]
            made = [pa.array(scores, pa.float64()), pa.array(hit, pa.int32()), pa.array(who, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))]
            rest = iter(b.columns[2:])
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(1) if k == text else next(rest) for k in keep], *made], ["doc_id", *keep, *names])

    fields = [f for k in keep for f in docs.schema.fields if f.name == k]
    made = [T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())))]
    carried = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"), *[F.col(f"`{k}`") for k in keep if k != text])
    return carried.mapInArrow(score, T.StructType([T.StructField("doc_id", T.LongType()), *fields, *made]))
