"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of virtual slots for good. Bytes are summed by slot, and a
stored, versioned map gives each slot's shard. Rebalancing edits the map: slots move, records keep their slots.
A run reads the newest version at its path. It writes the next one only if a shard has outgrown the mean by more
than ``SLACK``, or the number of shards has changed; of the slots only those move that this needs. The map has
one row a slot (``slots`` rows, a parameter), so the driver edits it and every task gets all of it.

Nulls: a null text has 0 bytes and the CRC of no bytes; a null id is hashed as empty text. Equal ids with
different texts have slots of their own, so that one id may hold many rows; identical rows share a slot unless they are more
than a slot's share of all bytes: then they spread over as many as they have shares. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veredas.llm.common import exists, pick, scratch_path, written

SLOTS = 8192
OVERHEAD = 8  # bytes of a record besides its text
LEAST_PART = 128  # bytes of equal rows that share a slot at least
SLACK = 0.01  # a shard may be over the mean by this much before a stored map is edited
SCHEMA = "version int, shards int, slot int, shard int, bytes long"


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, the shard of each slot."""

    version: int
    shards: int
    shard: tuple[int, ...]

    @classmethod
    def first(cls, slots: int, shards: int) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def loads(self, sizes: list[int]) -> list[int]:
        return _loads(sizes, list(self.shard), self.shards)

    def rebalanced(self, sizes: list[int], shards: int | None = None, slack: float = 0.0) -> SlotMap:
        """The next version: slots leave the shards that hold more than the mean, for the least loaded, until no pass lowers the fullest shard.

        The largest slots that fit go first, so that few slots move. A shard that is over the mean by no more than ``slack`` keeps its
        slots. Rebalancing the result again with the same sizes moves nothing.
        """
        shards = shards or self.shards
        at = self._pass(sizes, shards, list(self.shard), slack)
        while True:
            again = self._pass(sizes, shards, at, slack)
            if max(_loads(sizes, again, shards)) >= max(_loads(sizes, at, shards)):
                return SlotMap(self.version + 1, shards, tuple(at))
            at = again

    @staticmethod
    def _pass(sizes: list[int], shards: int, before: list[int], slack: float) -> list[int]:
        at = [s if s < shards else -1 for s in before]
        loads, own = [0] * shards, [[] for _ in range(shards)]
        loose = []
        for slot, s in enumerate(at):
            if s < 0:
                loose.append(slot)
            else:
                loads[s] += sizes[slot]
                own[s].append(slot)
        goal = sum(sizes) / shards
        for s in range(shards):
            if loads[s] <= (1 + slack) * goal:
                continue
            keep = sorted((x for x in own[s] if sizes[x]), key=lambda x: (-sizes[x], x))
            kept = []
            for slot in keep:  # the largest that fit leave; what stays is just above the mean
                if loads[s] - sizes[slot] >= goal:
                    loads[s] -= sizes[slot]
                    loose.append(slot)
                else:
                    kept.append(slot)
            while kept and loads[s] > goal:  # and then the smallest of it
                loads[s] -= sizes[kept[-1]]
                loose.append(kept.pop())
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda x: (-sizes[x], x)):
            load, s = heapq.heappop(heap)
            at[slot] = s
            heapq.heappush(heap, (load + sizes[slot], s))
        return at


def _loads(sizes: list[int], at: list[int], shards: int) -> list[int]:
    out = [0] * shards
    for slot, size in enumerate(sizes):
        out[at[slot]] += size
    return out


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, n: the distinct rows and how often each is there; as a table."""
    rows = pick(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    narrow = rows.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return written(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "rows")


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, n: distinct rows (from ``counted``) in their slots, with how many of them are there.

    Equal rows have one slot, but where they are more than a slot's share of all bytes, as many slots as they have shares.
    """
    total = rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    share = max(LEAST_PART, total // slots)
    parts = F.least(F.col("n"), F.ceil(F.col("size") * F.col("n") / share)).cast("int")
    cut = rows.withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.expr("n div parts + if(part < n % parts, 1, 0)")
    at = lambda *more: F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", *more), F.lit(slots))
    slot = F.when(F.col("part") == 0, at()).otherwise(at("part")).cast("int")
    return cut.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"), own.alias("n"))


def slot_sizes(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows by slot; at most ``slots`` sums come to the driver."""
    sizes, counts = [0] * slots, [0] * slots
    for slot, size, count in rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).collect():
        sizes[slot], counts[slot] = size, count
    return sizes, counts


def save_map(spark: SparkSession, path: str, m: SlotMap, sizes: list[int]) -> None:
    """Writes a version of the map, in a folder of its own: each slot's shard, and its bytes at the time.

    A version is written once. Another writer of the same version makes this one fail.
    """
    rows = [(m.version, m.shards, slot, shard, sizes[slot]) for slot, shard in enumerate(m.shard)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v{m.version:08d}")


def load_map(spark: SparkSession, path: str, slots: int = SLOTS, version: int | None = None) -> SlotMap | None:
    """One version, the newest if none is given; None if there is no map yet.

    A version that a lost driver left unfinished has fewer rows than slots and is passed over.
    """
    if not exists(spark, path):
        return None
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    whole = table.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()  # a row a version
    if any(r["last"] >= slots for r in whole):
        raise ValueError(f"the map at {path} has more than {slots} slots")
    known = [r["version"] for r in whole if r["n"] == slots and (version is None or r["version"] == version)]
    if not known:
        return None
    rows = table.filter(F.col("version") == max(known)).orderBy("slot").collect()  # a row a slot
    return SlotMap(max(known), rows[0]["shards"], tuple(r["shard"] for r in rows))


def edited_map(spark: SparkSession, path: str, sizes: list[int], shards: int, slack: float = SLACK) -> SlotMap:
    """The stored map if it still serves these sizes, else its next version, which is saved."""
    slots = len(sizes)
    old = load_map(spark, path, slots)
    if old is None:
        old = SlotMap.first(slots, shards)
        save_map(spark, path, old, sizes)
        slack = 0.0
    if old.shards == shards and max(old.loads(sizes)) <= (1 + slack) * sum(sizes) / shards:
        return old
    new = old.rebalanced(sizes, shards, slack)
    if new.shards == old.shards and max(new.loads(sizes)) >= max(old.loads(sizes)):  # no move helps: single slots are that large
        return old
    save_map(spark, path, new, sizes)
    return new


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None, slack: float = SLACK) -> DataFrame:
    """Every row with its shard, by the law ``bytes``: shards hold near equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard (null:
    that law has none), virtual_slot, map_version. The map's versions are kept at ``path``, and a later run on
    that path goes on from the newest. Narrow rows are shuffled twice, by row and by virtual slot; the map of ``slots`` rows is
    broadcast.
    """
    spark = docs.sparkSession
    rows = slotted(counted(docs), slots)
    sizes, counts = slot_sizes(rows, slots)
    m = edited_map(spark, path or scratch_path(spark, "slot-map"), sizes, shards, slack)
    place, told = [0] * shards, []
    for slot, s in enumerate(m.shard):  # a slot's rows lie together in its shard
        told.append((slot, s, place[s]))
        place[s] += counts[slot]
    slot_map = spark.createDataFrame(told, "virtual_slot int, shard int, first long")
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(slot_map), "virtual_slot")
    every = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return every.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("before") + F.col("copy")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).alias("map_version"),
    )
