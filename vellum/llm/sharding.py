"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has ``2 ** ring_bits`` cells. Each shard places ``vnodes`` virtual nodes on it, at cells its name
hashes to; a cell belongs to the first virtual node at or after it, clockwise. A key hashes to a cell. Loads
are bounded at the tightest bound that still holds all rows: of ``n`` rows, shard ``i`` takes
``n // shards``, and one more if ``i < n % shards``. Going round the ring, the keys of a cell fill its
shard; those that overflow continue clockwise to the next shard with room. So the counts are at most one
apart (law ``rows``), and only keys of overflowing cells leave their home.

Only the counts of cells (``2 ** ring_bits`` at most, whatever the input) reach the driver, which walks the
ring over them; the plan it returns says which ranks of a cell go to which shard. Rows are ranked within
their cell, so no task sorts more than about a ``2 ** -ring_bits`` share, and repeated ids share a cell: the
rank is spread by the text's hash as well, so that one id on a third of all rows makes no large cell.

Cases: null and empty texts have no bytes (size 1, crc 0); a very long text is one row, as loads are counts of rows; null
ids are hashed as a string of their own; rows that tie in digest and id differ in nothing that a result shows but
their size, by which they are ordered; repeated rows are interchangeable; an empty table gives an empty result; other
columns are ignored, or carried with ``carry``, which adds ``shard`` and ``slot`` only and replaces columns of those names.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of


def ring_owners(shards: int, vnodes: int, ring_bits: int) -> list[int]:
    """The shard of each cell of the ring."""
    cells = 1 << ring_bits
    if shards * vnodes > cells:
        raise ValueError("the ring has fewer cells than virtual nodes")
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int(hashlib.md5(f"shard-{s}/{v}".encode()).hexdigest()[:8], 16) % cells
            while cell in at:
                cell = (cell + 1) % cells
            at[cell] = s
    owners, owner = [0] * cells, at[min(at)]
    for cell in reversed(range(cells)):
        owner = at.get(cell, owner)
        owners[cell] = owner
    return owners


def place(counts: dict[int, int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Walks the ring: ``(cell, first rank, ranks, shard, first slot)``, in which overflow goes clockwise."""
    cells, used, plan = len(owners), [0] * len(quotas), []
    for cell in sorted(counts):
        left, rank, at = counts[cell], 0, cell
        while left:
            shard = owners[at % cells]
            if take := min(left, quotas[shard] - used[shard]):
                plan.append((cell, rank, take, shard, used[shard]))
                left, rank = left - take, rank + take
                used[shard] += take
            at += 1
    return plan


def ring_shards(docs: DataFrame, shards: int = 8, vnodes: int = 64, ring_bits: int = 12, carry: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each document; with ``carry`` the columns of ``docs`` and ``shard, slot``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    others = [c for c in docs.columns if c not in ("shard", "slot")] if carry else []
    text = text_of(docs)
    keys = docs.select(
        docs["doc_id"],
        F.struct(*[docs[c] for c in others]).alias("_row") if others else F.lit(None).alias("_row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws("/", F.coalesce(docs["doc_id"].cast("string"), F.lit("none")), F.xxhash64(text).cast("string")).cast("binary")).alias("_hash"),
    ).withColumn("_cell", F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") % (1 << ring_bits))
    counts = {r["_cell"]: r["n"] for r in keys.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    plan = place(counts, ring_owners(shards, vnodes, ring_bits), quotas)
    # cells + shards segments at most: a proven bound for the broadcast
    segment = "array<struct<_cell:bigint,first:bigint,ranks:bigint,shard:int,slot:bigint>>"
    table = json.dumps([dict(zip(("_cell", "first", "ranks", "shard", "slot"), x, strict=True)) for x in plan])
    segments = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), segment)))
    ranked = keys.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", "doc_id", "size")) - 1)
    s = F.broadcast(segments).alias("s")
    r = ranked.alias("r")
    on = (F.col("r._cell") == F.col("s._cell")) & (F.col("r._rank") >= F.col("s.first")) & (F.col("r._rank") < F.col("s.first") + F.col("s.ranks"))
    slot = (F.col("s.slot") + F.col("r._rank") - F.col("s.first")).alias("slot")
    placed = r.join(s, on)
    if carry:
        return placed.select(*[F.col(f"r._row.`{c}`") for c in others], "s.shard", slot)
    return placed.select("r.doc_id", "r.size", "r.text_crc32", F.lit("rows").alias("law"), "s.shard", slot, F.lit(None).cast("int").alias("grown_shard"))
