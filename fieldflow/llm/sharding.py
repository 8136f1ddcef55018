"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an offset and a step from its
name's digest. Shards take turns; each claims the first slot of its order that is still free, until the
table is full. Shares differ by at most one slot, and when a shard leaves or joins most slots keep their
shard. A document's slot is its identifier's digest modulo the table size.

The table has as many rows as it has slots, a parameter, so broadcasting it is bounded by that number.

Defined results: equal identifiers always share a shard; a null identifier is placed by its text's
digest, so documents without one spread out (null text: as empty); repeated rows go to the same shard;
no documents give no rows; further columns are handed through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldflow.llm import frames

SLOTS = 65_537  # prime, and over a hundred times the shards
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def lookup_table(shards=SHARDS, slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, so that every step visits all of them")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table = np.full(slots, -1, dtype=np.int32)
    claimed = 0
    while claimed < slots:
        for shard in range(len(shards)):
            slot = place[shard]
            while table[slot] >= 0:
                slot = (slot + step[shard]) % slots
            table[slot] = shard
            place[shard] = (slot + step[shard]) % slots
            claimed += 1
            if claimed == slots:
                break
    return table


def table_frame(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard), one row a slot."""
    table = lookup_table(shards, slots)
    return spark.createDataFrame([(s, int(t)) for s, t in enumerate(table)], "slot int, shard int")


def slot_of(doc_id, text, slots: int = SLOTS) -> F.Column:
    key = F.coalesce(F.concat(F.lit("id:"), doc_id.cast("string")), F.concat(F.lit("text:"), text), F.lit("text:"))
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard_plan(docs: DataFrame, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot and shard of every row."""
    picked = frames.pick(docs, doc_id="long", text="string")
    placed = picked.select("doc_id", slot_of(F.col("doc_id"), F.col("text"), slots).alias("slot"))
    return placed.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select("doc_id", "slot", "shard")


def assign_shards(docs: DataFrame, shards=SHARDS, slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """All columns of every row and its shard, as the last column ``name`` (underscores are added while it is taken)."""
    rows = frames.with_row(docs, doc_id="long", text="string")
    slot = slot_of(F.col("doc_id"), F.col("text"), slots).alias("slot")
    placed = rows.select("row", slot).join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot")
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    out = placed.select(*[F.col(f"row.c{i}") for i in range(len(docs.columns))], "shard")
    return out.toDF(*docs.columns, name)


def write_shards(docs: DataFrame, path: str, files_per_shard: int = 1, **options) -> None:
    """One folder per shard under ``path``; the rows of a shard are dealt over ``files_per_shard`` tasks."""
    placed = assign_shards(docs, **options)
    shard = placed.columns[-1]
    deal = F.floor(F.rand(7) * files_per_shard)
    shards = len(options.get("shards", SHARDS))
    placed.repartition(shards * files_per_shard, F.col(f"`{shard}`"), deal).write.partitionBy(shard).parquet(path)
