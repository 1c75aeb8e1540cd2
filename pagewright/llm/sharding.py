"""Sharding through fixed virtual slots.

Records are hashed by id and text into thousands of virtual slots that never change; only the small slot-to-shard map is
edited. Bytes are added up for each slot; a slot that outweighs `HEAVY` of a shard is split by a second hash, of the record and its
row, so that even rows that repeat each other in everything spread. The map is stored as versions: the first deals slots
in turn, and each next one is an edit of the last that moves only what balance needs.

The law is `bytes`: sizes of shards are near equal, whatever ids and texts repeat; equal texts are not kept together.

Defined cases: a null text has size 8 and crc 0; a null doc_id hashes as the empty text; rows that repeat each other take
neighbouring positions, in slots that were split as many as meet there; an empty table gives an empty result and a map of
empty slots; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, pick, read, shared_dir

VIRTUAL_SLOTS = 8192
SHARDS = 24
#: Share of a shard's bytes or rows beyond which a slot of several rows is split.
HEAVY = 0.01


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; `assignment[slot]` is a shard. Slots behind the first `virtual_slots` are the
    pieces of split ones: `splits` has the first piece and the number of pieces by slot."""

    version: int
    shards: int
    assignment: tuple[int, ...]
    splits: tuple[tuple[int, int, int], ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        of = {first + k: slot for slot, first, pieces in self.splits for k in range(pieces)}
        rows = [(self.version, self.shards, slot, shard, of.get(slot)) for slot, shard in enumerate(self.assignment)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int, split_of int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Adds the version to a stored map; versions are never overwritten."""
        self.table(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The latest or a given version of a stored map: a few thousand rows, whatever the input."""
    rows = spark.read.parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    found = sorted(rows.where(F.col("version") == version).collect(), key=lambda r: r.vslot)
    pieces: dict[int, list[int]] = {}
    for r in found:
        if r.split_of is not None:
            pieces.setdefault(r.split_of, []).append(r.vslot)
    return SlotMap(version, found[0].shards, tuple(r.shard for r in found), tuple((slot, p[0], len(p)) for slot, p in sorted(pieces.items())))


def slotted(docs: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot and row (a number of its own) of every document; the text itself goes no further."""
    text = F.col("text")
    return pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), F.lit(virtual_slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    )


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each virtual slot: at most as many entries as there are slots, so the driver may hold them."""
    got = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r.vslot: (r.b, r.n) for r in got}


def heavy_slots(loads: dict[int, tuple[int, int]], shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS, heavy: float = HEAVY) -> tuple[tuple[int, int, int], ...]:
    """Slot, first piece and pieces of each slot with several rows that holds over `heavy` of a shard's bytes or rows; there are
    2 * shards / heavy pieces at most, and one more for each such slot."""
    sizes, rows = (sum(x[k] for x in loads.values()) * heavy / shards for k in (0, 1))
    first, found = virtual_slots, []
    for slot, (b, n) in sorted(loads.items()):
        pieces = min(n, max(-(-b // max(1, int(sizes))), -(-n // max(1, int(rows)))))
        if n > 1 and pieces > 1:
            found.append((slot, first, pieces))
            first += pieces
    return tuple(found)


def split(rows: DataFrame, splits: tuple[tuple[int, int, int], ...]) -> DataFrame:
    """The rows of split slots in their pieces."""
    if not splits:
        return rows
    parts = F.broadcast(rows.sparkSession.createDataFrame(list(splits), "vslot int, first int, pieces int"))
    piece = F.col("first") + F.pmod(F.xxhash64("vslot", "row"), F.col("pieces")).cast("int")
    return rows.join(parts, "vslot", "left").withColumn("vslot", F.coalesce(piece, "vslot")).drop("first", "pieces")


def dealt_in_turn(shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS, splits: tuple[tuple[int, int, int], ...] = ()) -> SlotMap:
    """First version of a map, before any loads are known."""
    return SlotMap(1, shards, tuple(slot % shards for slot in range(virtual_slots + sum(n for *_, n in splits))), splits)


def rebalance(old: SlotMap, loads: dict[int, tuple[int, int]], shards: int) -> SlotMap:
    """Next version of the map for `shards` shards, moving only what balance needs.

    Slots of removed shards go to the lightest ones. Then, while a slot of the heaviest shard fits into the lightest one
    with less difference than before, the largest such slot moves.
    """
    size = lambda slot: loads.get(slot, (0, 0))[0]
    members: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(old.assignment):
        (members[shard] if shard < shards else homeless).append(slot)
    held = [sum(map(size, m)) for m in members]
    for slot in sorted(homeless, key=lambda s: (-size(s), s)):
        to = min(range(shards), key=lambda s: (held[s], s))
        members[to].append(slot)
        held[to] += size(slot)
    for _ in range(len(old.assignment)):
        high = max(range(shards), key=lambda s: (held[s], -s))
        low = min(range(shards), key=lambda s: (held[s], s))
        gap = held[high] - held[low]
        fitting = [s for s in members[high] if 0 < size(s) < gap]
        if not fitting:
            break
        # Moving x turns the gap into |gap - 2x|: the best slot is the one nearest half the gap.
        slot = min(fitting, key=lambda s: (abs(gap - 2 * size(s)), s))
        members[high].remove(slot)
        members[low].append(slot)
        held[high] -= size(slot)
        held[low] += size(slot)
    assignment = [0] * len(old.assignment)
    for shard, slots in enumerate(members):
        for slot in slots:
            assignment[slot] = shard
    return SlotMap(old.version + 1, shards, tuple(assignment), old.splits)


def place(rows: DataFrame, slot_map: SlotMap, loads: dict[int, tuple[int, int]]) -> DataFrame:
    """Adds `shard` and `slot`, the gapless position within the shard, and the map's version.

    A shard's positions are laid out virtual slot by virtual slot: the start of each is a prefix sum over the map
    (bounded), and only the rank inside a virtual slot needs a window, which so has as many groups as there are slots.
    """
    spark = rows.sparkSession
    starts, following = [], [0] * slot_map.shards
    for vslot, shard in enumerate(slot_map.assignment):
        starts.append((vslot, shard, following[shard], slot_map.version))
        following[shard] += loads.get(vslot, (0, 0))[1]
    layout = F.broadcast(spark.createDataFrame(starts, "vslot int, shard int, start long, map_version int"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank.cast("long"))
        .join(layout, "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "vslot", "map_version")
    )


def shard(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Every document's place by the stored map at `path`, which is made and edited here where the loads ask for it."""
    spark = docs.sparkSession
    rows = materialize(slotted(docs), "slotted")
    splits = heavy_slots(slot_loads(rows), shards)
    rows = split(rows, splits)
    loads = slot_loads(rows)
    first = dealt_in_turn(shards, splits=splits)
    first.store(spark, path)
    rebalance(first, loads, shards).store(spark, path)
    return place(rows, stored_map(spark, path), loads)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pagewright/slot-map-{uuid.uuid4().hex}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )
