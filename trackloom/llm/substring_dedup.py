"""Substring deduplication over a log-structured fingerprint index.

A window is ``width`` consecutive words.  Of the hashes of its ``gram``-word
shingles the smallest is its fingerprint (winnowing: equal windows have equal
fingerprints, and neighbouring windows mostly share one, so that the index is
a fifth of the windows).  The index is a log of immutable runs, each a table of
distinct fingerprints sorted within ranges.  A new batch of documents is
merge-joined with the runs and with itself; windows whose fingerprint occurs
elsewhere are verified by 128-bit hashes of their words, in the batch and in
the archived documents; then the batch's fingerprints become a run, and runs
are compacted before the next batch if there are more than ``fan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, forget, new_path, remove, small_batches, store
from .textkit import _U, run_hashes, shingle_hashes, text_blocks, word_hashes, word_spans

WIDTH = 13
GRAM = 5
FAN = 1  # runs; a batch that finds more has them compacted into one first
SMALL = 1_000_000  # ids (8 bytes each) up to which they are broadcast
COMBINE = 500_000  # window rows that a task combines at a time
MARKS = 16, 28  # bits, as powers of 2, of the Bloom filter of candidate fingerprints: sixteen for each within these bounds, 32 MB at most


def window_minima(words: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Fingerprint of each window: the smallest of its shingle hashes."""
    h = shingle_hashes(words, gram)
    span = width - gram + 1
    if len(h) < span:
        return np.zeros(0, _U)
    done = 1
    low = h
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    n = len(h) - span + 1
    return np.minimum(low[:n], low[span - done : span - done + n]) if span > done else low[:n]


def _per_text(column: pa.Array, hashed: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each text: its bytes, word starts and ends, and word hashes if asked for."""
    for _, raw, at in text_blocks(column):
        starts, ends, first = word_spans(raw, at)
        words = word_hashes(raw, starts, ends, False) if hashed else None
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield raw, starts[a:b], ends[a:b], words[a:b] if hashed else None


def window_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequence of each window that starts in ``at``, from two independent hashes of the words."""
    other = word_hashes(raw, starts, ends, False, 2)
    if 3 * len(at) > len(words):
        return shingle_hashes(words, width, 2)[at], shingle_hashes(other, width, 3)[at]
    place = at[:, None] + np.arange(width)
    return run_hashes(words[place], 2), run_hashes(other[place], 3)


def bitmap_of(values: DataFrame, column: str) -> np.ndarray:
    """Bloom filter, its size by the number of values within MARKS: two bits of each value, picked by its low and its high half."""
    bits = min(max((16 * values.count()).bit_length(), MARKS[0]), MARKS[1])
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    high = F.shiftrightunsigned(F.col(column), 64 - bits)
    places = values.select(F.explode(F.array(low, high)).alias("at")).select(F.shiftright("at", 15).alias("k"), F.bitmap_bit_position(F.col("at") + 1).alias("p"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in places.groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():
        out[r.k * 4096 : r.k * 4096 + 4096] = np.frombuffer(bytes(r.m), np.uint8)[:4096]
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    low, high = (values & _U((1 << bits) - 1)).astype(np.int64), (values >> _U(64 - bits)).astype(np.int64)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & (bitmap[high >> 3] >> (high & 7).astype(np.uint8)) & 1 != 0


def hits(bitmap: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Windows whose fingerprint is in the filter; neighbours mostly share one, which is looked up once."""
    if not len(low):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    found = in_bitmap(bitmap, low[new])
    return np.flatnonzero(np.repeat(found, np.diff(np.append(new, len(low)))))


class FingerprintIndex:
    """The log of runs in one folder, and the archive of documents that they describe."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, fan: int = FAN, path: str | None = None, small: int = SMALL) -> None:
        self.spark, self.width, self.gram, self.fan, self.small = spark, width, gram, fan, small
        self.path = path or new_path(spark, "fingerprints")
        self.runs: list[str] = []
        self.made = 0
        self.archive: DataFrame | None = None

    def _write_run(self, fingerprints: DataFrame) -> str:
        """A run of rows (fp, again): distinct fingerprints, and whether their batch has them in several documents."""
        self.made += 1
        run = f"{self.path}/run-{self.made:05d}"
        store(fingerprints.sortWithinPartitions("fp"), run)
        return run

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("fp long, again boolean").parquet(*runs)

    def compact(self) -> None:
        """Merge all runs into one sorted run of distinct fingerprints, and drop the old ones."""
        if len(self.runs) > 1:
            old = self.runs
            self.runs = [self._write_run(self._read(old).groupBy("fp").agg(F.lit(True).alias("again")))]
            for run in old:
                remove(self.spark, run)

    def drop(self) -> None:
        """Delete all runs; what ``add`` returned stays readable."""
        remove(self.spark, self.path)
        self.runs, self.archive = [], None

    def add(self, batch: DataFrame) -> DataFrame:
        """Deduplicate one batch (doc_id, t) against all before it and within it, and index it.

        Within a batch smaller ids come first.  Returns (doc_id, n_words,
        n_removed, kept) for each row; the texts are made when they are read.
        """
        width, gram = self.width, self.gram
        if len(self.runs) > self.fan:
            self.compact()

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fps, who, size = [], [], 0
            for b in batches:
                some = with_ids(b)
                for doc, (_, _, _, words) in zip(some.column(0).to_pylist(), _per_text(some.column(1))):
                    low = window_minima(words, width, gram)
                    if len(low):
                        fps.append(low[np.concatenate(([True], low[1:] != low[:-1]))])
                        who.append(np.full(len(fps[-1]), doc))
                        size += len(fps[-1])
                    if size > COMBINE:
                        yield first_and_last(fps, who)
                        fps, who, size = [], [], 0
            if fps:
                yield first_and_last(fps, who)

        seen = batch.mapInArrow(prints, "fp long, low long, high long").groupBy("fp").agg((F.min("low") != F.max("high")).alias("again"))
        run = self._write_run(seen)
        seen = self._read([run])
        twice = seen.where("again").select("fp")
        if self.runs:
            twice = twice.unionByName(seen.where("not again").join(self._read(self.runs).hint("merge"), "fp", "left_semi").select("fp"))
        twice = cut(twice)
        bitmap = self.spark.sparkContext.broadcast(bitmap_of(twice, "fp"))
        forget(twice)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple] = []
            size = 0
            for b in batches:
                some = with_ids(b)
                for doc, now, (raw, starts, ends, words) in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), _per_text(some.column(1))):
                    if len(hit := hits(bitmap.value, window_minima(words, width, gram))):
                        one, two = window_keys(raw, starts, ends, words, hit, width)
                        one, at = np.unique(one, return_index=True)
                        parts.append((one.view(np.int64), two[at].view(np.int64), np.full(len(one), doc), np.full(len(one), now)))
                        size += len(one)
                    if size > COMBINE:
                        yield combined(parts)
                        parts, size = [], 0
            if parts:
                yield combined(parts)

        texts = batch.select("doc_id", "t", F.lit(True).alias("new"))
        if self.archive is not None:
            texts = texts.unionByName(self.archive.select("doc_id", "t", F.lit(False).alias("new")))
        found = texts.mapInArrow(windows, "k1 long, k2 long, doc_id long, new boolean, sure boolean")
        kept = new_path(self.spark, "windows")
        store(found, kept)
        found = self.spark.read.schema(found.schema).parquet(kept)
        open_ = found.where("not sure")
        first = open_.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), (~F.min("new")).alias("old"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "low", "old")
        covered = open_.where("new").join(first, ["k1", "k2"]).where("old or low < doc_id").select("doc_id", "k1")
        covered = covered.unionByName(found.where("sure").select("doc_id", "k1"))
        lists = covered.groupBy("doc_id").agg(F.collect_set("k1").alias("gone"))

        touched = cut(lists)
        schema = "doc_id long, n_words long, n_removed long, kept string"

        def take_out(ids: pa.Array, texts: pa.Array, gone: pa.Array | None) -> Iterator[pa.RecordBatch]:
            n_words, n_removed, kept, row, size = [], [], [], 0, 0
            for i, (raw, starts, ends, words) in enumerate(_per_text(texts, gone is not None)):
                stay = np.ones(len(starts), bool)
                if gone is not None and gone[i].is_valid:
                    keys = gone[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
                    hit = np.flatnonzero(np.isin(shingle_hashes(words, width, 2), keys))
                    depth = np.zeros(len(starts) + 1, np.int64)
                    depth[hit] += 1
                    depth[hit + width] -= 1
                    stay = np.cumsum(depth[:-1]) == 0
                n_words.append(len(starts))
                n_removed.append(int((~stay).sum()))
                kept.append(kept_text(raw, starts[stay], ends[stay]))
                size += len(kept[-1])
                if size > 4 << 20 or i == len(texts) - 1:
                    done = pa.array(kept, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([ids.slice(row, len(kept)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), done], ["doc_id", "n_words", "n_removed", "kept"])
                    row += len(kept)
                    n_words, n_removed, kept, size = [], [], [], 0

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from take_out(b.column(0), b.column(1), None)

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from take_out(b.column(0), b.column(1), b.column(2))

        # only the texts of touched documents are moved; their ids are broadcast if they are few
        names = touched.select("doc_id")
        names = F.broadcast(names) if names.limit(self.small + 1).count() <= self.small else names
        whole = batch.join(names, "doc_id", "left_anti").select("doc_id", "t").mapInArrow(plain, schema)
        parts = batch.join(names, "doc_id", "left_semi").join(touched, "doc_id").select("doc_id", "t", "gone").mapInArrow(cleaned, schema)
        self.runs.append(run)
        remove(self.spark, kept)
        self.archive = batch if self.archive is None else self.archive.unionByName(batch)
        return whole.unionByName(parts)


def with_ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column(0).is_valid()) if batch.column(0).null_count else batch


def first_and_last(fps: list[np.ndarray], who: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct fingerprints with the smallest and largest id that have them."""
    fp, doc = np.concatenate(fps), np.concatenate(who)
    order = np.lexsort((doc, fp))
    fp, doc = fp[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    last = np.concatenate((new[1:], [len(fp)])) - 1
    return pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(doc[new]), pa.array(doc[last])], ["fp", "low", "high"])


def combined(parts: list[tuple]) -> pa.RecordBatch:
    """Window rows of some documents, combined: of each window one row stays open, archived or else of the
    smallest id; the batch's others are covered for sure, and archived others, or more of the same id, say nothing new."""
    k1, k2, doc, new = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((doc, new, k2, k1))
    k1, k2, doc, new = k1[order], k2[order], doc[order], new[order]
    same = np.concatenate(([False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])))
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(k1))))
    equal = same & (doc == doc[lead]) & new[lead]
    stay = ~same | new & ~equal
    sure = (same & new & ~equal)[stay]
    return pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in (k1, k2, doc, new)] + [pa.array(sure)], ["k1", "k2", "doc_id", "new", "sure"])


def kept_text(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    total = int(sizes.sum()) - 1
    to = np.cumsum(sizes) - sizes
    index = np.arange(total + 1) + np.repeat(starts - to, sizes)
    index[to[1:] - 1] = 0
    out = raw[np.minimum(index[:total], len(raw) - 1)].copy()
    out[to[1:] - 1] = 0x20
    return out.tobytes()


def substring_dedup(docs: DataFrame, batches: int = 3, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, small: int = SMALL) -> DataFrame:
    """Take out every word that a window covers which starts in a document of a smaller id too.

    The table goes through the index in ``batches`` ranges of ids, the smallest
    first; with more of them than FAN the runs are compacted on the way.  Returns
    (doc_id, n_words, n_removed, kept) for every row; other columns are not read.
    Null texts have no words.  Rows without a doc_id lose nothing and are nobody's
    source.  Rows that repeat an id are one document as sources, and each loses the
    windows that smaller ids hold.  Texts of fewer than ``width`` words lose
    nothing; very long ones are taken whole.  Empty tables stay empty.  Ids of up to
    ``small`` touched documents are broadcast, more are joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    marks = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(marks[: batches - 1]))
    index = FingerprintIndex(spark, width, gram, small=small)
    out: DataFrame | None = None
    for k in range(len(edges) + 1):
        part = rows
        if k > 0:
            part = part.where(F.col("doc_id") > edges[k - 1])
        if k < len(edges):
            part = part.where(F.col("doc_id") <= edges[k]) if k else part.where((F.col("doc_id") <= edges[k]) | F.col("doc_id").isNull())
        elif not k:
            part = rows
        done = index.add(part)
        out = done if out is None else out.unionByName(done)
    index.drop()
    return out
