"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots. Every shard owns many virtual nodes on it, and a key belongs to the first virtual node
at or after its slot. No shard takes more than its capacity: keys that reach a full shard continue clockwise to the next
virtual node whose shard has room. Which keys continue is decided by their rank within their slot, so the walk needs only
the number of keys of each slot: a table bounded by the ring, whatever the input. Its outcome, runs of ranks per slot and
shard, is joined back to the keys, which Spark ranks chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_few_parts, listed, table, whole, written

RING_SLOTS = 1 << 16
VIRTUAL_NODES = 128
SEED = 17

RUNS = "run_slot int, from_rank bigint, to_rank bigint, shard int, base bigint"


def virtual_nodes(spark: SparkSession, shards: int, nodes: int = VIRTUAL_NODES, seed: int = SEED) -> list[tuple[int, int]]:
    """(ring slot, shard) of every virtual node in clockwise order; a shard's nodes depend on its number alone."""
    n = spark.range(shards * nodes).select((F.col("id") / nodes).cast("int").alias("shard"), F.pmod("id", F.lit(nodes)).alias("node"))
    placed = n.select(_slot(F.xxhash64(F.lit(seed), F.lit("node"), "shard", "node")).alias("slot"), "shard")
    return sorted((r.slot, r.shard) for r in placed.collect())


def _slot(h):
    return F.shiftrightunsigned(h, 48).cast("int")


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take: with no slack, counts at most one apart that add up to the total."""
    if slack:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (slot, first rank, end rank, shard, rows of the shard before) for the keys of each slot, in ring order.

    Virtual nodes of full shards are unlinked, so each step either finishes a slot or fills a shard.
    """
    n = len(nodes)
    after = list(range(n))  # the next node that may have room, at or after each

    def free(i: int) -> int:
        seen = []
        while True:
            i %= n
            if after[i] != i:
                seen.append(i)
                i = after[i]
            elif room[nodes[i][1]] <= 0:
                seen.append(i)
                after[i] = i + 1
                i += 1
            else:
                for k in seen:
                    after[k] = i
                return i

    used, runs, at = [0] * len(room), [], 0
    for slot in sorted(counts):
        while at < n and nodes[at][0] < slot:
            at += 1
        rank = 0
        while rank < counts[slot]:
            shard = nodes[free(at)][1]
            take = min(counts[slot] - rank, room[shard])
            runs.append((slot, rank, rank + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
            rank += take
    return runs


def _text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keyed(docs: DataFrame, row: Column) -> DataFrame:
    """row, key, size and text_crc32 of every row; a null text has size 8 and checksum 0."""
    size = (F.octet_length(_text(docs)) + 8).cast("bigint")
    return docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("key"), size.alias("size"), F.crc32(_text(docs).cast("binary")).alias("text_crc32"))


def shard_rows(keyed: DataFrame, shards: int, slack: float = 0.0, nodes: int = VIRTUAL_NODES, seed: int = SEED) -> DataFrame:
    """`keyed` (row, key, size, text_crc32) with ring_slot, shard and the slot there, counted from 0 without gaps.

    Rows are ranked within their ring slot in chunks: by a hash of key, size and checksum, then by the part of the table
    they are in. So a key with a third of all rows is ranked in many tasks, even if all its rows are equal; a chunk's first
    rank is the number of rows in the chunks before. Null keys share one place on the ring; rows equal in all three columns
    are interchangeable. An empty table gives no rows. Only the counts by ring slot come to the driver, and only the runs
    go back: at most 65,536 rows and one more a shard.
    """
    spark = keyed.sparkSession
    slot = _slot(F.xxhash64(F.lit(seed), F.lit("key"), "key"))
    chunk = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "size", "text_crc32"), 52).cast("int")
    placed = written(keyed.withColumns({"ring_slot": slot, "chunk": chunk, "part": F.spark_partition_id()}), "keys")
    by = ("ring_slot", "chunk", "part")
    chunks = placed.groupBy(*by).agg(F.count("*").alias("rows"))
    counts = {r.ring_slot: r.n for r in chunks.groupBy("ring_slot").agg(F.sum("rows").alias("n")).collect()}
    runs = walk(counts, virtual_nodes(spark, shards, nodes, seed), capacities(sum(counts.values()), shards, slack))
    before = F.sum("rows").over(Window.partitionBy("ring_slot").orderBy("chunk", "part")) - F.col("rows")
    starts = chunks.select(*by, before.alias("before"))
    in_chunk = Window.partitionBy(*by).orderBy(F.col("key").asc_nulls_first(), "size", "text_crc32")
    ranked = placed.withColumn("nth", F.row_number().over(in_chunk).cast("bigint") - 1).join(starts, list(by))
    run = F.broadcast(listed(spark, runs, RUNS, "runs").alias("run"))
    rank = F.col("before") + F.col("nth")
    found = ranked.join(run, (F.col("ring_slot") == F.col("run.run_slot")) & (rank >= F.col("from_rank")) & (rank < F.col("to_rank")))
    return found.select("row", "key", "size", "text_crc32", "ring_slot", "shard", (F.col("base") + rank - F.col("from_rank")).alias("slot"))


def documents_to_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and ring_slot for all rows, under the law `rows`: counts at most one apart.

    Other columns of `docs` are ignored.
    """
    x = shard_rows(_keyed(docs, F.lit(None).cast("int")), shards)
    return x.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "ring_slot")


def with_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All rows and columns of `docs` with size, text_crc32, shard and slot (columns of these names are replaced)."""
    own = ("size", "text_crc32", "shard", "slot")
    x = shard_rows(in_few_parts(_keyed(docs, whole(docs))), shards)
    return x.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in own], *own)


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 23."""
    return documents_to_shards(table(spark, sf_dir, "documents"))
