"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` virtual slots, for good.  Only the map from
slots to shards changes: each version is a small table of (slot, shard), and
rebalancing edits the last version, moving as few slots as even sizes need.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, new_path

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record: its id and text decide, so that rows that share an id spread."""
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.crc32(F.coalesce(text, F.lit("")))), F.lit(slots)).cast("int")


@dataclass
class SlotMap:
    """Versions of the slot-to-shard map; ``moves`` counts the slots that each edit moved."""

    n_shards: int
    shard_of: list[int]
    version: int = 1
    moves: list[int] = field(default_factory=list)

    @classmethod
    def dealt(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        """The first version, before any size is known: slots in turn."""
        return cls(n_shards, [s % n_shards for s in range(slots)])

    def rebalanced(self, size: list[int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots move from the heaviest shard to the lightest until no move evens them.

        A move takes the slot nearest to half the difference, or exchanges two
        slots when no single one fits.  More shards start empty and are filled by
        the same moves; slots of dropped shards go to the lightest ones first.
        """
        n = n_shards or self.n_shards
        shard_of = list(self.shard_of)
        members: list[set[int]] = [set() for _ in range(n)]
        load = [0] * n
        homeless = []
        for slot, shard in enumerate(shard_of):
            if shard < n:
                members[shard].add(slot)
                load[shard] += size[slot]
            else:
                homeless.append(slot)
        heap = [(v, k) for k, v in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(homeless, key=lambda s: -size[s]):
            v, k = heapq.heappop(heap)
            shard_of[slot] = k
            members[k].add(slot)
            load[k] = v + size[slot]
            heapq.heappush(heap, (load[k], k))
        for _ in range(4 * len(shard_of)):
            high, low = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
            half = (load[high] - load[low]) / 2
            best = min((s for s in members[high] if 0 < size[s] < 2 * half), key=lambda s: (abs(size[s] - half), s), default=None)
            back = None
            if best is None or abs(size[best] - half) > half / 2:
                light = sorted((size[s], s) for s in members[low])
                for s in members[high]:
                    i = _near(light, size[s] - half)
                    if i is not None and 0 < size[s] - light[i][0] < 2 * half and (best is None or abs(size[s] - light[i][0] - half) < abs(size[best] - (size[back] if back is not None else 0) - half)):
                        best, back = s, light[i][1]
            if best is None:
                break
            for slot, a, b in ((best, high, low), (back, low, high)):
                if slot is not None:
                    members[a].remove(slot)
                    members[b].add(slot)
                    shard_of[slot] = b
                    load[a] -= size[slot]
                    load[b] += size[slot]
        moved = sum(x != y for x, y in zip(shard_of, self.shard_of))
        return SlotMap(n, shard_of, self.version + 1, [*self.moves, moved])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, s, k) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; older versions stay readable."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, n_shards: int, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        wanted = version or rows.agg(F.max("version")).first()[0]
        got = rows.where(F.col("version") == wanted).orderBy("virtual_slot").collect()
        return cls(n_shards, [r.shard for r in got], wanted)


def _near(light: list[tuple[int, int]], size: float) -> int | None:
    import bisect

    i = bisect.bisect_left(light, (size, -1))
    return min((j for j in (i - 1, i) if 0 <= j < len(light)), key=lambda j: abs(light[j][0] - size), default=None)


def shard(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Put every row into a shard, so that the shards' bytes are nearly equal.

    Bytes and rows are added up per virtual slot (``slots`` rows, whatever the
    table), the dealt map is edited by them, and both versions are stored under
    ``path``.  Returns (doc_id, size, text_crc32, virtual_slot, shard, slot);
    slot is the row's place in its shard, without gaps from 0.  Null texts have
    no bytes but the overhead; rows without an id are placed like others; equal
    rows take places next to each other; an empty table gives an empty one.
    Other columns are not read.
    """
    spark = docs.sparkSession
    i, t = F.col(doc_id), F.col(text)
    rows = docs.select(i.cast("long").alias("doc_id"), record_size(t).alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), virtual_slot(i, t, slots).alias("virtual_slot"))
    rows = cut(rows)
    bytes_of, rows_of = [0] * slots, [0] * slots
    for s, b, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        bytes_of[s], rows_of[s] = b, n
    where = path or new_path(spark, "slot-map")
    first = SlotMap.dealt(n_shards, slots)
    first.save(spark, where)
    now = first.rebalanced(bytes_of)
    now.save(spark, where)
    base, filled = [], [0] * n_shards
    for s, k in enumerate(now.shard_of):
        base.append((s, k, filled[k]))
        filled[k] += rows_of[s]
    places = spark.createDataFrame(base, "virtual_slot int, shard int, base long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(places), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))
