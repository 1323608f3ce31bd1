"""Sharding by fixed virtual slots, with DataFrame operations only.

Every record hashes into one of SLOTS slots; bytes are summed per slot; a versioned map gives each slot a shard and is edited
(slots move, records do not rehash) when shards are unequal or their number grows. Records of equal text share a slot, so
copies meet in one shard at every table size, unless the group alone outweighs a whole shard's fair share (total / shards):
such groups, fewer than there are shards, cannot stay together in shards of equal size and are dealt over all slots by id as
well.

What reaches the driver is a row per slot. Places within a shard come from a number within the slot plus the slot's offset,
so no window spans a shard.

Cases: a null text counts as an empty one (size 8, crc32 0). Null and repeated ids keep their rows; rows equal in id and text
take neighbouring places. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import cut, scratch

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map."""

    version: int
    shards: int
    of: tuple[int, ...]

    @staticmethod
    def fresh(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0: slots in turn."""
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def loads(self, weight: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.of):
            out[shard] += weight[slot]
        return out

    def rebalanced(self, weight: list[int], tolerance: float = 5e-4) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard, or change places, until their loads differ
        by the tolerance (a share of the mean) or nothing improves."""
        of, load = list(self.of), self.loads(weight)
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(of):
            held[shard].append(slot)
        mean = sum(load) / max(1, self.shards)
        for _ in range(4 * len(of)):
            hi, lo = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[hi] - load[lo]
            if gap <= tolerance * mean:
                break
            # a move of x changes the gap to |gap - 2x|
            moves = [(abs(gap - 2 * weight[a]), a, -1) for a in held[hi] if 0 < weight[a] < gap]
            best = min(moves, default=None)
            if best is None or best[0] > gap / 4:
                small = sorted(held[lo], key=lambda s: weight[s])
                for a in held[hi]:
                    want = weight[a] - gap / 2
                    i = _nearest(small, weight, want)
                    if i is not None and 0 < weight[a] - weight[small[i]] < gap:
                        best = min(filter(None, [best, (abs(gap - 2 * (weight[a] - weight[small[i]])), a, small[i])]))
            if best is None or best[0] >= gap:
                break
            _, a, b = best
            held[hi].remove(a)
            held[lo].append(a)
            of[a] = lo
            load[hi] -= weight[a]
            load[lo] += weight[a]
            if b >= 0:
                held[lo].remove(b)
                held[hi].append(b)
                of[b] = hi
                load[lo] -= weight[b]
                load[hi] += weight[b]
        return SlotMap(self.version + 1, self.shards, tuple(of))

    def grown(self, weight: list[int]) -> SlotMap:
        """The next version with one shard more: slots move into the new shard only, until it has its share."""
        of, load, new = list(self.of), [*self.loads(weight), 0], self.shards
        share = sum(load) / (self.shards + 1)
        for slot in sorted(range(len(of)), key=lambda s: (-weight[s], s)):
            if load[of[slot]] > share and load[new] + weight[slot] <= share:
                load[of[slot]] -= weight[slot]
                load[new] += weight[slot]
                of[slot] = new
        return SlotMap(self.version + 1, self.shards + 1, tuple(of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, slot, shard)."""
        rows = F.posexplode(_numbers(self.of))
        return spark.range(1).select(rows.alias("slot", "shard")).select(F.lit(self.version).alias("version"), "slot", F.col("shard").cast("int").alias("shard"))


def _nearest(small: list[int], weight: list[int], want: float) -> int | None:
    from bisect import bisect_left

    i = bisect_left(small, want, key=lambda s: weight[s])
    near = [k for k in (i - 1, i) if 0 <= k < len(small)]
    return min(near, key=lambda k: abs(weight[small[k]] - want), default=None)


def _numbers(values: tuple[int, ...] | list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default."""
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    of = {r["slot"]: r["shard"] for r in rows.where(F.col("version") == version).collect()}
    return SlotMap(version, max(of.values()) + 1, tuple(of[s] for s in range(len(of))))


def slotted(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record; the columns that it reads are cut once."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.xxhash64(raw).alias("h"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = rows.groupBy("h").agg(F.sum("size").alias("b")).where(F.col("b") * shards > total).select("h", F.lit(True).alias("heavy"))
    # fewer than `shards` groups can each exceed total / shards
    return rows.join(F.broadcast(heavy), "h", "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.pmod(F.when(F.col("heavy"), F.xxhash64("h", "doc_id")).otherwise(F.xxhash64("h")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def shard(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, before: SlotMap | None = None, store: str | None = None
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, map_version, shard, place): ``docs`` in shards of near equal bytes.

    before: the map to edit (a fresh one by default). store: a folder that gets the map's versions as Parquet. The result is
    written, all else is released.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(cut(_shard(docs, shards, id_col, text_col, slots, before, store)))


def _shard(docs: DataFrame, shards: int, id_col: str, text_col: str, slots: int, before: SlotMap | None, store: str | None) -> DataFrame:
    spark = docs.sparkSession
    rows = slotted(docs, shards, id_col, text_col, slots)
    per = {r["virtual_slot"]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    weight = [per[s]["b"] if s in per else 0 for s in range(slots)]
    first = before or SlotMap.fresh(shards, slots)
    edited = first.rebalanced(weight)
    if store:
        for one in [edited] if before else [first, edited]:
            one.frame(spark).write.mode("append").parquet(store)
    offset, filled = [0] * slots, [0] * edited.shards
    for s in range(slots):
        offset[s] = filled[edited.of[s]]
        filled[edited.of[s]] += per[s]["n"] if s in per else 0
    at = F.col("virtual_slot") + 1
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        "virtual_slot",
        F.lit(edited.version).alias("map_version"),
        F.element_at(_numbers(edited.of), at).cast("int").alias("shard"),
        (F.element_at(_numbers(offset), at) + number).cast("long").alias("place"),
    )
