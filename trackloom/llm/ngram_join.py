"""N-gram Jaccard self-join: rare-first prefix filtering, verified once per pair.

Texts become sets of word shingles.  A set's shingles are put in one global
order, rare ones first, and only its prefix is joined: two sets with Jaccard
similarity of ``num/den`` or more share a shingle of their prefixes.  Length,
positional and suffix filters drop most of what meets in a prefix; the rest is
verified on the whole sets.

Hot groups: equal sets are one node throughout.  In the groups of a prefix
shingle, a first round pairs each set with the group's smallest and with its
nearest neighbours only; links found that way join most of a large group of
near copies into one component.  A second round takes the groups that had more
to offer, in families dealt to bounded parts, and pairs sets of different
components only: whatever link remains has to be among these.  No link between components
is lost, and no group emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import cut, forget, release, small_batches
from .textkit import _U, mix, shingle_sets

WIDTH = 5
NUM, DEN = 80, 100
SKETCH_BITS = 20  # corpus counts of shingles, by the top bits of their hashes: 4 MB
CHUNKS = 256  # pieces in which tasks send them
MARKS = 23, 28  # bits, as powers of 2, of a bitmap of ids: a thousand for each id within these bounds, 32 MB at most
BITMAP = 1024  # bits of a set's parity bitmap
FEW = 16  # sets of like size in a prefix group that are paired all with all
NEAR = 2  # sets that the first round pairs each set of a larger one with, besides the smallest
PART = 4000  # sets of a family handled at a time in the second round
FIRST = 16  # sets that each set of a family is paired with at first; 64 times as many each further time
WHOLE = 40_000  # crowded sets up to which all of them count as one family
SMALL = 1_000_000  # ids (8 bytes each) up to which they are broadcast


def need(num: int, den: int, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Least intersection of sets of these sizes with Jaccard similarity num/den or more."""
    return -((-num * (nx + ny)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def set_ids(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Id of a set (its low ``bits`` bits), and 64 other bits that tell sets of the same id apart."""
    digest = blake2b(shingles.tobytes(), digest_size=16).digest()
    low = int.from_bytes(digest[:8], "little", signed=True)
    return low if bits == 64 else low & ((1 << bits) - 1), int.from_bytes(digest[8:], "little", signed=True)


def set_id(shingles: np.ndarray, shared: frozenset[int], bits: int = 64) -> int:
    """Id of a set; an id that different sets have is replaced by one made of both parts."""
    low, high = set_ids(shingles, bits)
    return low ^ high if low in shared else low


def parity(shingles: np.ndarray, bits: int = BITMAP) -> np.ndarray:
    """Bitmap in which each shingle flips one bit: bitmaps differ in no more bits than sets in shingles."""
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_counts(docs: DataFrame, text: str, width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all shingles of all texts, added up by the top bits of their hashes.

    2**bits numbers whatever the corpus.  Tasks send their sums in CHUNKS pieces,
    which are added up in two steps, so that no group grows with the tasks.
    """
    size = 1 << bits
    each = size // CHUNKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        held, n = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width, True):
                held.append((s >> _U(64 - bits)).astype(np.int64))
                n += len(s)
                if n > size:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        if total.any():
            part = int.from_bytes(blake2b(total.tobytes(), digest_size=4).digest(), "little") % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int64()), pa.array([part] * CHUNKS, pa.int64()), pa.array([total[k * each : (k + 1) * each].astype(np.int32).tobytes() for k in range(CHUNKS)], pa.binary())], ["k", "part", "n"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for one in group["n"].to_pylist():
            total += np.frombuffer(one, np.int32)
        top = np.iinfo(np.int32).max
        return pa.table({"k": group["k"][:1], "part": group["part"][:1], "n": pa.array([np.minimum(total, top).astype(np.int32).tobytes()], pa.binary())})

    schema = "k long, part long, n binary"
    sums = docs.select(text).mapInArrow(add, schema).groupBy("k", "part").applyInArrow(merge, schema).groupBy("k").applyInArrow(merge, schema)
    out = np.zeros(size, np.int32)
    for r in sums.collect():
        out[r.k * each : (r.k + 1) * each] = np.frombuffer(bytes(r.n), np.int32)
    return out


def rare_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles in the global order: by corpus count, then by mixed hash."""
    bits = len(counts).bit_length() - 1
    return shingles[np.lexsort((mix(shingles), counts[(shingles >> _U(64 - bits)).astype(np.int64)]))]


def prefixes(docs: DataFrame, doc_id: str, text: str, counts: np.ndarray, width: int, num: int, den: int, id_bits: int = 64) -> DataFrame:
    """Rows (doc_id, n, sid, tell, prefix, bits): size and both parts of the id of each text's set, its prefix and parity bitmap.

    A task gives the last two of equal sets once; further rows have nulls.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sizes, ids, tell, heads, bits = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width, True):
                n = len(s)
                sid = set_ids(s, id_bits) if n else (0, 0)
                sizes.append(n)
                ids.append(sid[0])
                tell.append(sid[1])
                if n == 0 or sid in seen:
                    heads.append(None)
                    bits.append(None)
                else:
                    seen.add(sid)
                    heads.append(rare_first(s, shared.value)[: prefix_length(n, num, den)].view(np.int64))
                    bits.append(parity(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(tell, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n", "sid", "tell", "prefix", "bits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(profile, "doc_id long, n long, sid long, tell long, prefix array<long>, bits array<long>")


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None = None, carry: int = 0) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Blocks of whole groups of equal column g (sorted input), without groups of one row.

    A group of more than ``limit`` rows comes in blocks of its own, each with the
    last ``carry`` rows of the one before; the flag says that it was cut so.
    """
    held: dict[str, np.ndarray] | None = None
    was_cut = False
    for batch in batches:
        x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
        if held is not None:
            x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
        g = x["g"]
        if not len(g):
            continue
        last = int(np.searchsorted(g, g[-1], side="left")) if (g[1:] >= g[:-1]).all() else len(g) - int(np.argmax(g[::-1] != g[-1]))
        same = g[1:] == g[:-1]
        keep = np.zeros(len(g), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[last:] = False
        if keep.any():
            yield {k: v[keep] for k, v in x.items()}, was_cut and last > 0
        if last > 0:
            was_cut = False
        held = {k: v[last:] for k, v in x.items()}
        if limit and len(held["g"]) > limit:
            yield held, True
            held = {k: v[-carry:] for k, v in held.items()}
            was_cut = True
    if held is not None and len(held["g"]) > 1:
        yield held, was_cut


def _passing(x: dict, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs (i, j), j no larger, may link: length and positional filter."""
    nx, ny = x["n"][i], x["n"][j]
    rest = np.minimum(nx - x["pos"][i], ny - x["pos"][j])
    return (den * ny >= num * nx) & (rest >= need(num, den, nx, ny)) & (x["sid"][j] != x["sid"][i])


def _pair_batch(x: dict, i: np.ndarray, j: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b, more): pairs, a the smaller set, then the crowded groups with a = b = 0."""
    a, b = x["sid"][j], x["sid"][i]
    zero, one = np.zeros(len(more), np.int64), np.zeros(len(a), np.int64)
    cols = [np.concatenate([a, zero]), np.concatenate([b, zero]), np.concatenate([one, more])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "more"])


def first_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of the first round, and the groups that have others (a = b = 0, more)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, was_cut in _groups(batches, 5 * PART, FEW):
            new = np.concatenate(([True], (x["g"][1:] != x["g"][:-1]) | (x["sid"][1:] != x["sid"][:-1])))
            x = {k: v[new] for k, v in x.items()}
            group = np.cumsum(np.concatenate(([False], x["g"][1:] != x["g"][:-1])))
            at = np.arange(len(group))
            far = np.int64(1) << 40
            low = np.searchsorted(group * far + x["n"] * den, group * far + x["n"] * num, side="left")
            over = (at - low > FEW) | was_cut
            left, right = [at], [low]
            for d in range(1, FEW + 1):
                i = at[d:][(group[d:] == group[:-d]) & (~over[d:] | (d <= NEAR))]
                left.append(i)
                right.append(i - d)
            i, j = np.concatenate(left), np.concatenate(right)
            ok = _passing(x, i, j, num, den)
            more = np.unique(x["g"][over])
            yield _pair_batch(x, i[ok], j[ok], more)

    return rows.repartition("g").sortWithinPartitions("g", "n", "sid").mapInArrow(emit, "a long, b long, more long")


def plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity bitmaps of ``sets`` (sid, n, bits) let link.

    Sets that differ in more shingles than a link allows mostly show it in their
    bitmaps, whose distance is a lower bound; so most of what shares a prefix
    shingle is told apart before whole sets are moved.
    """
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda total, k: total + k)
    least = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den) - F.lit(1e-9))
    return pairs.join(one, "a").join(two, "b").where(F.col("na") + F.col("nb") - differ >= 2 * least).select("a", "b")


def crowded_sets(sets: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows (sid, n, gs, ps, bits): the sets with prefix shingles among ``crowded``, these and their positions."""
    bitmap = sets.sparkSession.sparkContext.broadcast(marks(crowded, "g"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gs, ps, keep = [], [], []
            for head in b.column(2):
                g = head.values.to_numpy()
                hit = np.flatnonzero(marked(bitmap.value, g))
                keep.append(len(hit) > 0)
                if len(hit):
                    gs.append(g[hit])
                    ps.append(hit)
            some = b.filter(pa.array(keep, pa.bool_()))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(gs, kind), pa.array(ps, kind), some.column(3)], ["sid", "n", "gs", "ps", "bits"])

    return sets.select("sid", "n", "prefix", "bits").mapInArrow(pick, "sid long, n long, gs array<long>, ps array<long>, bits array<long>")


def second_pairs(rows: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """Candidate pairs across components c in the groups g, each two parts of a family of sets.

    Sets are ordered by size and id; each is paired with the first ``most`` sets
    before it, from place ``start`` on, that it may link with, each once however
    many prefix shingles they share.  Rows (a, b, g, stop): ``stop`` is the place
    to go on from if b has more of them, else null.
    """

    def emit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("n", "ascending"), ("sid", "ascending")])
        sid, n, c, part = (group[k].to_numpy() for k in ("sid", "n", "c", "part"))
        start = group["start"].to_numpy()
        own = bool(group["own"][0].as_py())
        m = len(sid)
        bits = group["bits"].combine_chunks().flatten().to_numpy().view(_U).reshape(m, -1)
        gs, ps = group["gs"].combine_chunks(), group["ps"].combine_chunks()
        who = np.repeat(np.arange(m), np.diff(gs.offsets.to_numpy()))
        token, pos = gs.flatten().to_numpy(), ps.flatten().to_numpy()
        order = np.lexsort((who, token))
        token, who, pos = token[order], who[order], pos[order]
        cuts = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1).tolist(), len(token)]
        found: list[np.ndarray] = []
        size = 0
        for s, e in zip(cuts[:-1], cuts[1:]):
            at = who[s:e]
            if e - s < 2 or (c[at] == c[at[0]]).all():
                continue
            x = {"n": n[at], "sid": sid[at], "pos": pos[s:e]}
            low = np.searchsorted(x["n"] * den, x["n"] * num, side="left")
            for i in np.flatnonzero(start[at] >= 0).tolist():
                j = np.arange(int(low[i]), i)
                j = j[(c[at[j]] != c[at[i]]) & ((part[at[j]] != part[at[i]]) | own) & (at[j] >= start[at[i]])]
                j = j[_passing(x, np.full(len(j), i), j, num, den)]
                if len(j):
                    differ = np.bitwise_count(bits[at[j]] ^ bits[at[i]]).sum(axis=1, dtype=np.int64)
                    j = j[x["n"][i] + x["n"][j] - differ >= 2 * need(num, den, x["n"][i], x["n"][j])]
                    found.append(at[i] * m + at[j])
                    size += len(j)
            if size > 1_000_000:
                found = [np.unique(np.concatenate(found))]
                size = 0
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        i, j = pairs // max(m, 1), pairs % max(m, 1)
        first = np.searchsorted(i, i)
        place = np.arange(len(i)) - first
        over = np.searchsorted(i, i, side="right") - first > most
        i, j, over = i[place < most], j[place < most], over[place < most]
        last = np.concatenate((i[1:] != i[:-1], [True])) if len(i) else over
        stop = pa.array(j + 1, mask=~(over & last))
        return pa.table({"a": sid[j], "b": sid[i], "g": np.full(len(i), group["g"][0].as_py()), "stop": stop})

    return rows.groupBy("g").applyInArrow(emit, "a long, b long, g long, stop long")


def families(rows: DataFrame) -> DataFrame:
    """``family`` of each set: sets that share a crowded shingle, directly or through others, have the same."""
    ties = rows.select(F.get("gs", F.lit(0)).alias("a"), F.explode("gs").alias("b")).distinct()
    label = components(ties).select(F.col("node").alias("__g"), F.col("component").alias("__family"))
    out = rows.withColumn("__g", F.get("gs", F.lit(0))).join(label, "__g", "left")
    return out.withColumn("family", F.coalesce("__family", "__g")).drop("__g", "__family")


def stars(label: DataFrame) -> DataFrame:
    """Links (a, b) of each node to the smallest of its component: the components of all links, by one link a node."""
    return label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Upper bound of the intersection of two sorted sets: split at y's middle, and again within."""
    if depth == 0 or len(y) < 8 or len(x) < 8:
        return min(len(x), len(y))
    mid = len(y) // 2
    cut_at = int(np.searchsorted(x, y[mid]))
    return suffix_bound(x[:cut_at], y[:mid], depth - 1) + suffix_bound(x[cut_at:], y[mid:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether 100 * intersection >= 80 * union, for 80/100, of two sorted sets."""
    least = int(need(num, den, len(x), len(y)))
    if suffix_bound(x, y) < least:
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return den * both >= num * (len(x) + len(y) - both)


def marks(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap with the bit of each value's low bits set, its size by the number of values within MARKS."""
    bits = min(max((1000 * ids.count()).bit_length(), MARKS[0]), MARKS[1])
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = ids.select((low / 32768).cast("long").alias("k"), F.bitmap_bit_position(low + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r.k * 4096 : r.k * 4096 + 4096] |= np.frombuffer(bytes(r.m), np.uint8)[:4096]
    return out


def marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.astype(np.int64) & (len(bitmap) * 8 - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 != 0


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, owners: DataFrame, shared: frozenset[int], width: int, num: int, den: int, small: int = SMALL, id_bits: int = 64) -> DataFrame:
    """The pairs (a, b) that link; sets are made again from the texts of ``owners`` (sid, rep)."""
    spark = docs.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    reps = cut(named.join(owners, "sid").select(F.col("rep").alias("doc_id")).distinct())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    bitmap = None
    if reps.limit(small + 1).count() <= small:
        rows = rows.join(F.broadcast(reps), "doc_id", "left_semi")
    else:
        bitmap = spark.sparkContext.broadcast(marks(reps, "doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            if bitmap is not None:
                ids = b.column(0)
                b = b.filter(pa.array(marked(bitmap.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)))
            sids, blobs = [], []
            for s in shingle_sets(b.column(1), width, True):
                sid = set_id(s, shared, id_bits)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], ["sid", "blob"])

    blobs = rows.mapInArrow(sets, "sid long, blob binary").join(named, "sid", "left_semi").dropDuplicates(["sid"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, _U), np.frombuffer(y, _U), num, den) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.select("a", "b").join(blobs.select(F.col("sid").alias("a"), F.col("blob").alias("x")), "a").join(blobs.select(F.col("sid").alias("b"), F.col("blob").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def ngram_jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, whole: int = WHOLE, small: int = SMALL, id_bits: int = 64) -> DataFrame:
    """Components of documents whose shingle sets have Jaccard similarity num/den or more.

    Returns (doc_id, n_shingles, component_id) for every row of ``docs``; other
    columns, whatever their names, are not read.  Null and empty texts have an
    empty set and link with nothing.  Rows without a doc_id are kept with a
    null component and link with nothing.  Repeated rows give repeated rows;
    texts with equal sets link.  An empty table gives an empty one.  Very long
    texts are taken whole, by one task each.  ``whole`` (crowded sets that count
    as one family), ``small`` (ids that are broadcast) and ``id_bits`` (of a set's
    id, before ids of different sets are told apart) change cost, not results.
    """
    small_batches(docs.sparkSession)
    counts = shingle_counts(docs, text, width)
    profile = cut(prefixes(docs, doc_id, text, counts, width, num, den, id_bits))
    known = profile.where("doc_id is not null and n > 0")
    owners = cut(known.groupBy("sid").agg(F.min("doc_id").alias("rep"), (F.min("tell") != F.max("tell")).alias("clash")))
    # about n * n / 2**65 ids of n sets: none below billions
    shared = frozenset(r.sid for r in owners.where("clash").select("sid").collect())
    if shared:
        profile = profile.withColumn("sid", F.when(F.col("sid").isin(*shared) & (F.col("n") > 0), F.col("sid").bitwiseXOR(F.col("tell"))).otherwise(F.col("sid")))
        known = profile.where("doc_id is not null and n > 0")
        owners = cut(known.groupBy("sid").agg(F.min("doc_id").alias("rep")))
    rows = known.where("prefix is not null").select("sid", "n", F.posexplode("prefix").alias("pos", "g")).select("g", "sid", "n", F.col("pos").cast("long").alias("pos"))
    found = cut(first_pairs(rows, num, den).distinct())
    release(docs.sparkSession)
    sets = known.where("prefix is not null").dropDuplicates(["sid"]).select("sid", "n", "bits")
    tried = found.where("a <> b").select("a", "b")
    pairs = cut(plausible(tried, sets, num, den))
    check = lambda p: verified(p, docs, doc_id, text, owners, shared, width, num, den, small, id_bits)
    edges = check(pairs)
    crowded = cut(found.where("a = b").select(F.col("more").alias("g")).distinct())
    release(docs.sparkSession)
    if crowded.limit(1).count():
        part = cut(crowded_sets(known.where("prefix is not null"), crowded).dropDuplicates(["sid"]))
        size = part.count()
        if size <= whole:
            kin = part.withColumns({"family": F.lit(0).cast("long"), "k": F.lit(-(-size // PART)).cast("long")})
        else:
            kin = families(part)
            kin = kin.join(kin.groupBy("family").agg(F.ceil(F.count("*") / F.lit(PART)).alias("k")), "family")
        dealt = kin.select("family", "sid", "n", "gs", "ps", "bits", "k", F.pmod(F.xxhash64("sid"), "k").alias("part"))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
        dealt = cut(dealt.select(F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "sid", "n", "gs", "ps", "bits", "part", (F.col("part") == F.col("other")).alias("own")))
        most, starts, label = FIRST, None, components(edges)
        while True:
            edges = stars(label)
            now = dealt.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("component", "sid"))
            now = now.withColumn("start", F.lit(0).cast("long")) if starts is None else now.join(starts, ["g", "sid"], "left").withColumn("start", F.coalesce("start", F.lit(-1).cast("long")))
            more = cut(second_pairs(now, most, num, den))
            late = more.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
            edges = cut(edges.unionByName(check(cut(late))))
            starts = cut(more.where("stop is not null").select("g", F.col("b").alias("sid"), F.col("stop").alias("start")))
            forget(more)
            release(docs.sparkSession)
            if not starts.limit(1).count():
                break
            label, most = components(edges), 64 * most
        forget(part, dealt)
    reps = edges.join(owners.select(F.col("sid").alias("a"), F.col("rep").alias("u")), "a").join(owners.select(F.col("sid").alias("b"), F.col("rep").alias("v")), "b")
    label = components(reps, "u", "v")
    forget(found, pairs)
    home = owners.join(label, owners.rep == label.node, "left").select("sid", F.coalesce("component", "rep").alias("home"))
    out = profile.join(home, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("home"))).otherwise(F.col("doc_id")).alias("component_id"))
