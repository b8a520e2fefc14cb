"""Benchmark decontamination: size-partitioned MinHash containment, in DataFrame functions only.

A test item is contained in a document if the document holds at least 80 % of
the item's distinct five-word shingles; an item of fewer words is one shingle of
its own width, and documents are shingled at that width too.  Items are partitioned by size.  Each
keeps the smallest hash values of its shingles, as many as may be missing plus
one for the largest size of its partition (at most all): a document that contains
the item has one of them, so that the search loses nothing, and a longer document
costs no more per word.  Documents with fewer shingles than the smallest item of
a partition needs are no candidates for it.  What is found is verified on the
shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

WIDTH = 5
NUM, DEN = 80, 100
SMALL = 200_000  # rows up to which a side is broadcast (16 to 100 bytes each); larger sides are shuffled


def words_of(text: Column) -> Column:
    """Lower-cased words, split at the six ASCII white-space characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, widths: list[int], make) -> Column:
    """``make`` of each run of as many words as one of ``widths`` says.

    Words are picked by index: a slice would copy the whole array each time.
    """

    def runs(width: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: make(*[F.get(words, i + k) for k in range(width)]))
        return F.when(F.size(words) >= width, each).otherwise(F.filter(F.array(make(words)), lambda _: F.lit(False)))

    return F.concat(*map(runs, widths)) if len(widths) > 1 else runs(widths[0])


def whole_or_shingles(words: Column, width: int, make) -> Column:
    """Shingles of an item: of fewer words than ``width`` their whole sequence is the one shingle."""
    return F.when(F.size(words) >= width, shingles_of(words, [width], make)).otherwise(F.filter(F.array(make(words)), lambda _: F.size(words) > 0))


def hashed(*words: Column) -> Column:
    """Hash of a run; an array hashes as its elements do one after the other."""
    return F.xxhash64(*words)


def joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _small(side: DataFrame, small: int) -> DataFrame:
    return F.broadcast(side) if side.limit(small + 1).count() <= small else side


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, small: int = SMALL) -> DataFrame:
    """Documents that contain test items, a row for each such pair.

    Returns (doc_id, item_id, n_item, n_found, containment): distinct shingles of
    the item, those of them in the document, and their ratio.  Null and empty
    texts and items are in nothing.  Rows without a doc_id or an item_id cannot
    be named and give no row.  Rows that repeat an id are looked at each on its
    own, and the pair has the best of them.  Items of equal text are all
    reported.  An item of fewer words than ``width`` is contained where its words
    follow each other, however long the document.  Very long texts are taken
    whole.  Other columns are not read; with an empty table there is no row.
    Sides of up to ``small`` rows are broadcast, larger ones shuffled.
    """
    # The words are a column of their own: inlined into the shingles' lambda, a text would be split once per shingle.
    found = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("w"))
    widths = sorted(r.m for r in found.select(F.least(F.size("w"), F.lit(width)).alias("m")).distinct().collect() if r.m) or [width]
    found = found.select("item_id", F.array_distinct(whole_or_shingles(F.col("w"), width, joined)).alias("s"))
    found = cut(found.where(F.size("s") > 0).distinct().select(F.monotonically_increasing_id().alias("k"), "item_id", "s", F.size("s").cast("long").alias("n_item"), F.floor(F.log2(F.size("s").cast("double"))).cast("int").alias("part")))
    least = lambda n: F.ceil(n * num / den)
    sizes = found.groupBy("part").agg(F.max("n_item").alias("most"), F.min(least(F.col("n_item"))).alias("floor"))
    sketch = found.join(F.broadcast(sizes), "part").select("k", "floor", F.array_sort(F.transform("s", lambda x: F.xxhash64(F.split(x, " ")))).alias("h"), (F.col("most") - least(F.col("most")) + 1).cast("int").alias("keep"))
    sketch = cut(sketch.select("floor", F.explode(F.slice("h", F.lit(1), F.col("keep"))).alias("h")).groupBy("h").agg(F.min("floor").alias("floor")))

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    keyed = rows.select("doc_id", F.xxhash64("t").alias("row"), words_of(F.col("t")).alias("w"))
    # explode would have the optimizer ask for size(shingles) > 0 below, in terms of the text, at a square of its cost.
    probes = keyed.select("doc_id", "row", shingles_of(F.col("w"), widths, hashed).alias("hs"))
    probes = probes.select("doc_id", "row", F.size("hs").alias("n"), F.explode_outer("hs").alias("h"))
    named = cut(probes.join(_small(sketch, small), "h").where("n >= floor").select("doc_id").distinct())
    again = rows.join(_small(named, small), "doc_id", "left_semi")
    exact = again.distinct().select("doc_id", F.xxhash64("t").alias("row"), words_of(F.col("t")).alias("w"))
    exact = exact.select("doc_id", "row", F.explode_outer(F.array_distinct(shingles_of(F.col("w"), widths, joined))).alias("g"))
    whole = cut(found.select("k", "item_id", "n_item", F.explode("s").alias("g")))
    pairs = exact.join(_small(whole, small), "g").groupBy("doc_id", "row", "k", "item_id", "n_item").agg(F.count("*").alias("n_found"))
    pairs = pairs.where(F.col("n_found") * den >= F.col("n_item") * num)
    out = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("c"), "n_item", "n_found")).alias("x"))
    return out.select("doc_id", "item_id", F.col("x.n_item").alias("n_item"), F.col("x.n_found").alias("n_found"), F.col("x.c").alias("containment"))
