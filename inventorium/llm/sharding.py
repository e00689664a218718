"""Sharding over fixed virtual slots: records are hashed into thousands of slots, bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives; rebalancing edits the map, never the hash.

A record's slot is the hash of its text, so equal texts share one. A slot with more than a quarter of a shard's bytes or rows
(one text may hold a third of all) has several parts, and a record's part is the hash of its id. The map has a row for each
part of each slot, with the number of parts, so that a version alone says where a record lives; a later version may double a
slot's parts, which moves no record between the halves.

The law is ``bytes``: shards get nearly equal sums of sizes. Size: the UTF-8 bytes of the text (null: none) plus 8.
Defined results: null texts form one group; repeated rows get a row each, and rows that repeat both id and text stay together;
an empty table gives no rows. Other columns of the input are never looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, new_path, path_exists, table

#: Virtual slots, and parts of one slot at most. A slot's part is numbered slot + part * N_SLOTS.
N_SLOTS, MAX_PARTS = 4096, 1024
#: Rows of a shard that one task numbers, about.
NUMBERED_ROWS = 1 << 20


def slot_stats(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of each slot that has records; the driver gets a row for each slot and part."""
    rows = records.groupBy(slot).agg(F.sum(size).alias("b"), F.count("*").alias("n")).orderBy(slot).collect()
    return [(r[0], r.b, r.n) for r in rows]


def parts_of(stats: list[tuple[int, int, int]], n_shards: int, old: dict[int, int] | None = None) -> dict[int, int]:
    """The slots with several parts: enough, as a power of two, that none has over a quarter of a shard's bytes or rows, and no
    fewer than in the ``old`` version."""
    most_bytes, most_rows = sum(b for _, b, _ in stats) / n_shards / 4, sum(n for _, _, n in stats) / n_shards / 4
    out = dict(old or {})
    for slot, size, rows in stats:
        parts = out.get(slot, 1)
        while parts < MAX_PARTS and parts < rows and (size / parts > most_bytes or rows / parts > most_rows):
            parts *= 2
        if parts > 1:
            out[slot] = parts
    return out


def first_map(stats: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes."""
    shards = [(0, k) for k in range(n_shards)]
    out = {}
    for slot, size, _ in sorted(stats, key=lambda s: (-s[1], s[0])):
        held, k = heapq.heappop(shards)
        out[slot] = k
        heapq.heappush(shards, (held + size, k))
    return out


def edited_map(old: dict[int, int], stats: list[tuple[int, int, int]], n_shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The next version of a map: slots leave the fullest shard for the emptiest until they differ by ``tolerance`` of a fair
    share; slots that need not move stay. New slots go to the emptiest shard, and shards beyond ``n_shards`` are emptied."""
    size = {s: b for s, b, _ in stats}
    out = {s: k for s, k in old.items() if s in size and k < n_shards}
    held = [0] * n_shards
    members: list[set[int]] = [set() for _ in range(n_shards)]
    for s, k in out.items():
        held[k] += size[s]
        members[k].add(s)
    for s in sorted(size.keys() - out.keys(), key=lambda s: (-size[s], s)):
        k = min(range(n_shards), key=lambda k: (held[k], k))
        out[s] = k
        held[k] += size[s]
        members[k].add(s)
    fair = sum(size.values()) / n_shards
    for _ in range(4 * len(size)):
        full, empty = max(range(n_shards), key=lambda k: (held[k], -k)), min(range(n_shards), key=lambda k: (held[k], k))
        gap = held[full] - held[empty]
        fits = [s for s in members[full] if 0 < size[s] < gap]
        if gap <= tolerance * fair or not fits:
            break
        s = min(fits, key=lambda s: (abs(2 * size[s] - gap), s))
        out[s] = empty
        for k, sign in ((full, -1), (empty, 1)):
            held[k] += sign * size[s]
        members[full].discard(s)
        members[empty].add(s)
    return out


def save_map(spark, slot_map: dict[int, int], parts: dict[int, int], version: int, path: str) -> None:
    """Appends a version of the map; a reader takes the highest version or any earlier one."""
    rows = [(version, s, parts.get(s % N_SLOTS, 1), k) for s, k in slot_map.items()]
    spark.createDataFrame(rows, "version int, slot int, parts int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> tuple[dict[int, int], dict[int, int], int]:
    """(shard of each slot and part, slots with several parts, version)."""
    maps = spark.read.parquet(path)
    version = maps.agg(F.max("version").alias("v")).first().v if version is None else version
    rows = maps.where(F.col("version") == version).collect()
    return {r.slot: r.shard for r in rows}, {r.slot % N_SLOTS: r.parts for r in rows if r.parts > 1}, version


def virtual_slot(doc_id: Column, text: Column, parts: dict[int, int]) -> Column:
    """Where a record lives, from its id and text alone and the parts of a version of the map."""
    return _slot_of(F.pmod(F.xxhash64(text), F.lit(N_SLOTS)).cast("int"), doc_id, parts)


def _slot_of(home: Column | str, doc_id: Column | str, parts: dict[int, int]) -> Column:
    home = F.col(home) if isinstance(home, str) else home
    if not parts:
        return home
    of = F.coalesce(F.try_element_at(F.map_from_arrays(F.from_json(F.lit(str(list(parts))), "array<int>"), F.from_json(F.lit(str(list(parts.values()))), "array<int>")), home), F.lit(1))
    return (home + F.pmod(F.xxhash64(doc_id, F.lit("part")), of) * N_SLOTS).cast("int")


def shard_records(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, numbered_rows: int = NUMBERED_ROWS) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot (its place in the shard), grown_shard (null by this
    law), and the virtual slot and map version. If ``map_path`` has a map, its next version is edited from it.

    Places come from counts: each shard is dealt into buckets of about ``numbered_rows`` rows, rows are numbered in their bucket
    and start after the buckets before it, so that no task sees a shard or a slot whole."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(N_SLOTS)).cast("int").alias("home"),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = materialise(slim, "shard-records")
    old, parts, version = load_map(spark, map_path) if map_path and path_exists(spark, map_path) else ({}, {}, 0)
    homes = slot_stats(slim, "home")
    grown = parts_of(homes, n_shards, parts)
    for slot, now in grown.items():  # the new halves start where their records have lived
        for part in range(parts.get(slot, 1), now):
            if (was := old.get(slot + part % parts.get(slot, 1) * N_SLOTS)) is not None:
                old[slot + part * N_SLOTS] = was
    placed = slim.withColumn("virtual_slot", _slot_of("home", "doc_id", grown))
    stats = slot_stats(placed)
    slot_map = edited_map(old, stats, n_shards) if old else first_map(stats, n_shards)
    save_map(spark, slot_map, grown, version + 1, map_path or new_path(spark, "slot-map"))
    where = spark.createDataFrame([(s, slot_map[s]) for s, _, _ in stats], "virtual_slot int, shard int")
    total = sum(n for _, _, n in homes)
    buckets = max(1, -(-total // n_shards // numbered_rows))
    dealt = placed.join(F.broadcast(where), "virtual_slot").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))  # a row for each slot and part
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(counts.select("shard", "bucket", first.alias("first")), "shard-starts")  # a row for each million records
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row"))
    numbered = dealt.withColumn("nth", within).hint("shuffle_hash").join(starts.hint("shuffle_hash"), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version + 1).alias("map_version"))


def op2_sharding(spark, sf_dir):
    """All documents into 24 shards of nearly equal bytes."""
    return shard_records(table(spark, sf_dir, "documents"), 24)
