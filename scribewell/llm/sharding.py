"""Sharding by fixed virtual slots and a versioned map of slots to shards.

A row's key is hashed into one of thousands of slots, for good. Bytes are summed up by slot, and the map that
gives each slot a shard is made from those sums; rebalancing edits the map, in a new version, and
moves no more slots than it must. A slot that is too long for a shard has several parts, each with a shard of its own; the map says how
many, and a hash of key and text which. The map's size is about the number of slots, whatever the data's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exists, new_path, written

SLOTS = 8192
#: A slot with over 1 / SPLIT of a shard's bytes is split into parts.
SPLIT = 8
#: An entry of the map is a part of a slot; slots that aren't split have part 0 of 1.
MAP = "slots int, shards int, slot long, part int, ways int, shard int, bytes long, version int"


@dataclass(frozen=True)
class SlotMap:
    """Which shard has each entry, and the bytes that it had when the map was made. Entry ``slot + slots * part`` is that part of that slot."""

    version: int
    shards: int
    shard_of: dict[int, int]
    bytes_of: dict[int, int]
    ways: dict[int, int]  # parts of the slots that are split
    slots: int = SLOTS

    @staticmethod
    def of(bytes_of: dict[int, int], shards: int, version: int = 1, ways: dict[int, int] | None = None, slots: int = SLOTS) -> SlotMap:
        """The longest entries first, each to the shard with the fewest bytes; ties to the smaller shard."""
        loads = [(0, s) for s in range(shards)]
        shard_of = {}
        for slot, size in sorted(bytes_of.items(), key=lambda x: (-x[1], x[0])):
            load, shard = heapq.heappop(loads)
            shard_of[slot] = shard
            heapq.heappush(loads, (load + size, shard))
        return SlotMap(version, shards, shard_of, dict(bytes_of), dict(ways or {}), slots)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in self.shard_of.items():
            out[shard] += self.bytes_of.get(slot, 0)
        return out

    def grown(self) -> SlotMap:
        """One more shard, which takes slots from the others until it has its share; no slot moves otherwise."""
        goal = sum(self.bytes_of.values()) / (self.shards + 1)
        loads = [*self.loads(), 0]
        moved = dict(self.shard_of)
        for slot, size in sorted(self.bytes_of.items(), key=lambda x: (-x[1], x[0])):
            shard = self.shard_of[slot]
            if loads[shard] - size >= goal * 0.999 and loads[-1] + size <= goal:
                moved[slot] = self.shards
                loads[shard] -= size
                loads[-1] += size
        return replace(self, version=self.version + 1, shards=self.shards + 1, shard_of=moved)

    def rebalanced(self, bytes_of: dict[int, int], tolerance: float = 0.01, ways: dict[int, int] | None = None) -> SlotMap:
        """For new sums: entries move from shards over the mean to those under it until all are near it; new ones go to the emptiest."""
        moved = {s: self.shard_of[s] for s in bytes_of if s in self.shard_of}
        now = replace(self, version=self.version + 1, shard_of=moved, bytes_of=dict(bytes_of), ways=dict(self.ways if ways is None else ways))
        loads = now.loads()
        for slot, size in sorted(((s, n) for s, n in bytes_of.items() if s not in moved), key=lambda x: (-x[1], x[0])):
            shard = min(range(self.shards), key=lambda s: (loads[s], s))
            moved[slot] = shard
            loads[shard] += size
        mean = sum(loads) / self.shards
        for slot, size in sorted(bytes_of.items(), key=lambda x: (-x[1], x[0])):
            a, b = moved[slot], min(range(self.shards), key=lambda s: (loads[s], s))
            if loads[a] > mean * (1 + tolerance) and loads[b] + size < loads[a]:
                moved[slot] = b
                loads[a] -= size
                loads[b] += size
        return now

    def rows(self) -> list[tuple]:
        at = [(e % self.slots, e // self.slots, e) for e in sorted(self.shard_of)]
        return [(self.slots, self.shards, slot, part, self.ways.get(slot, 1), self.shard_of[e], self.bytes_of.get(e, 0)) for slot, part, e in at]

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version; earlier versions stay readable, and a version that is there already is an error."""
        schema = MAP.rpartition(",")[0]
        spark.createDataFrame(self.rows(), schema).coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """That version, or the latest; None if there is none. A map has at most a row for each entry, so it is read by the driver."""
        if not exists(spark, path):
            return None
        table = spark.read.schema(MAP).parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.where(F.col("version") == version).collect()
        if not rows:
            return None
        slots = rows[0]["slots"]
        entry = lambda r: r["slot"] + slots * r["part"]
        return SlotMap(version, rows[0]["shards"], {entry(r): r["shard"] for r in rows}, {entry(r): r["bytes"] for r in rows}, {r["slot"]: r["ways"] for r in rows if r["ways"] > 1}, slots)


def slot_of(keys: Iterable[str | Column], slots: int = SLOTS) -> Column:
    """The virtual slot of a key; null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def slot_bytes(rows: DataFrame, slot: str, size: str) -> dict[int, int]:
    """Bytes by slot: at most as many rows as there are slots."""
    return {r[0]: r[1] for r in rows.groupBy(slot).agg(F.sum(size)).collect()}


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """A written table (key, size, text_crc32, virtual_slot, own, row): ``own`` is the hash of key and text that tells a part of a split slot.

    ``row`` is a number that a row keeps whenever the table is read.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long")
    rows = df.select(F.col(key).alias("key"), size.alias("size"), crc.alias("text_crc32"))
    return written(rows.withColumn("virtual_slot", slot_of(["key"], slots)).withColumn("own", F.xxhash64("key", "size", "text_crc32")).withColumn("row", F.monotonically_increasing_id()), "sizes")


def entered(base: DataFrame, ways: dict[int, int], most: float, slots: int) -> DataFrame:
    """``base`` with entry. Rows of one key and text are in one part of a split slot, but for those of which there are over ``most`` bytes: they can't be told apart, and are dealt to its parts in turn."""
    if not ways:
        return base.withColumn("entry", F.col("virtual_slot"))
    spark = base.sparkSession
    split = spark.createDataFrame(sorted(ways.items()), "virtual_slot long, ways long")
    parts = base.join(F.broadcast(split), "virtual_slot", "left")
    # no more than shards * SPLIT such groups
    many = parts.where(F.col("ways").isNotNull()).groupBy("own").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most).select("own", F.lit(True).alias("many"))
    turn = F.when(F.col("many"), F.xxhash64("own", "row")).otherwise(F.col("own"))
    part = F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(turn, F.col("ways")))
    return parts.join(F.broadcast(many), "own", "left").withColumn("entry", F.col("virtual_slot") + F.lit(slots).cast("long") * part).drop("ways", "many")


def mapped(base: DataFrame, shards: int, slots: int = SLOTS, old: SlotMap | None = None) -> SlotMap:
    """The map for the rows ``base``: a first one, or ``old`` in a new version, with more shards if there are to be more, and rebalanced.

    What ``old`` has split stays so, and slots that have grown get more parts. Fewer shards than ``old`` has are an error.
    """
    if old and (old.slots != slots or old.shards > shards):
        raise ValueError("the stored map has other slots, or more shards")
    sums = slot_bytes(base, "virtual_slot", "size")
    most = part_most(sums, shards)
    ways = {slot: wanted(int(-(-2 * n // most)), old.ways.get(slot, 1) if old else 1) for slot, n in sums.items() if n > most}
    ways = (old.ways if old else {}) | ways
    sums = slot_bytes(entered(base, ways, most / 2, slots), "entry", "size")
    if old is None:
        return SlotMap.of(sums, shards, ways=ways, slots=slots)
    grown = old
    while grown.shards < shards:
        grown = grown.grown()
    return replace(grown.rebalanced(sums, ways=ways), version=old.version + 1)


def wanted(ways: int, before: int) -> int:
    """``ways`` or more: so many times those ``before``, by doubling, that a row's part is its old one or a new one, and no other rows move."""
    if before == 1:
        return ways
    while before < ways:
        before *= 2
    return before


def part_most(sums: dict[int, int], shards: int) -> float:
    """Bytes from which on a slot is split."""
    return max(1.0, sum(sums.values()) / shards / SPLIT)


def placed(base: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``base`` with shard: rows are placed by the map and nothing else. A row whose entry the map doesn't have is in shard null."""
    spark = base.sparkSession
    most = part_most(slot_map.bytes_of, slot_map.shards)
    rows = entered(base, slot_map.ways, most / 2, slot_map.slots)
    shard_of = spark.createDataFrame(sorted(slot_map.shard_of.items()), "entry long, shard int")
    return rows.join(F.broadcast(shard_of), "entry", "left")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``key``, size, text_crc32, virtual_slot, shard, slot of every row of ``df``: bytes are near equal over the shards.

    The map is kept at ``map_path`` (by default a new one): where there is none, a first version is made of the bytes by slot; else the latest version is
    edited, so that few rows move. The new version is stored, and rows are placed by what is stored.
    ``size`` is the text's UTF-8 bytes plus 1 (null: 1; its CRC is that of no bytes, 0). ``slot`` numbers a shard's rows
    from 0 without gaps. Rows of equal or null keys share a virtual slot; one that has over 1 / SPLIT of a
    shard's bytes is split. Further columns are not read; repeated rows are each placed; an empty table gives an empty one.
    """
    spark = df.sparkSession
    base = sized(df, key, text, slots)
    path = map_path or new_path(spark, "slots")
    made = mapped(base, shards, slots, SlotMap.load(spark, path))
    if not made.shard_of:
        return numbered(base.withColumn("shard", F.lit(None).cast("int")), key)
    made.save(spark, path)
    return numbered(placed(base, SlotMap.load(spark, path, made.version)), key)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with slot, their number in their shard: the rows before their chunk of rows, and their number there."""
    rows = rows.withColumn("chunk", F.shiftright("row", 13))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    number = F.row_number().over(Window.partitionBy("chunk", "shard").orderBy("row"))
    out = rows.withColumn("number", number).join(counts, ["chunk", "shard"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "virtual_slot", "shard", (F.col("begin") + F.col("number") - 1).cast("long").alias("slot"))
