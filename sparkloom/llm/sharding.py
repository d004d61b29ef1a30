"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by (offset + j * skip) modulo the size; in
turns each shard claims its next free slot, until the table is full.  Shares differ by one slot at
most, and adding or losing a shard moves few slots.  A row's slot is its key's hash modulo the size,
and its shard is looked up there.

The table has ``SLOTS`` rows whatever the data, which bounds the broadcast.

Rows: a null key hashes like any other value and has one fixed shard; repeated keys share a shard;
an empty table gives an empty result.  Other columns pass through; where one is named slot or shard (in
either case), the output's name has an underscore after it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import free_name

SLOTS = 65537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the table's size must be a prime, and no less than the number of shards")
    at, skip = [], []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(d[:8], "big") % slots)
        skip.append(int.from_bytes(d[8:16], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot (int) and shard (string)."""
    shards = shards or shard_names()
    slot_name, shard_name = free_name(df, "slot"), free_name(df, "shard")
    table = lookup_table(shards, slots)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    places = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    slot = F.pmod(F.xxhash64(F.col(f"c{df.columns.index(key)}")), F.lit(slots)).cast("int")
    return plain.withColumn("slot", slot).join(F.broadcast(places), "slot").select(*plain.columns, "slot", "shard").toDF(*df.columns, slot_name, shard_name)
