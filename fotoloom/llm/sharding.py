"""Shards by a weighted hash tree: region, rack, shard.

Shards are the leaves of a tree.  A node's draw for a document is the least of its children's draws;
a leaf draws ``-ln(u) / weight`` from a hash u of (doc_id, region, rack, shard).  So a node wins with
chance in proportion to the weight below it, and a document descends to the child with the least
draw at each level.  When a leaf is added, only its own draw is new: a document either stays where it
was or goes to the new leaf, and nothing moves between subtrees whose weights are unchanged.

The two trees (with and without one shard more) draw their 81 leaves one by one, as flat columns.
Sharing the 41 different draws was measured and is slower: 1.1 s instead of 0.7 s for the documents
of check_s, as an array of draws as well as in nested columns; flat columns compile best.

doc_id and the number of shards alone decide.  Null ids draw like the text "null".  Slots number the
rows of a shard from 0 by (doc_id, size, text_crc32); equal rows take neighbouring slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, numbered

SHARDS_A_RACK = 5
RACKS_A_REGION = 2


def tree(shards: int) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards; a new shard goes to the first place that is free."""
    out: dict[int, dict[int, list[int]]] = {}
    for s in range(shards):
        rack = s // SHARDS_A_RACK
        out.setdefault(rack // RACKS_A_REGION, {}).setdefault(rack, []).append(s)
    return out


def _leaf(region: int, rack: int, shard: int, weight: float) -> Column:
    """Draw and shard; a struct, so that ``least`` keeps both."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"{region}/{rack}/{shard}"))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.log(u) / weight).alias("draw"), F.lit(shard).alias("shard"))


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def placed(docs: DataFrame, shards: int, weights: dict[int, float] | None = None) -> DataFrame:
    """Adds ``shard`` by descending the tree, and ``grown_shard``, the place with one shard more."""
    weight = lambda s: (weights or {}).get(s, 1.0)
    for name, count in (("shard", shards), ("grown_shard", shards + 1)):
        levels = tree(count)
        leaves = {f"_{name}_{s}": _leaf(region, rack, s, weight(s)) for region, racks in levels.items() for rack, own in racks.items() for s in own}
        fresh = {k: v for k, v in leaves.items()}
        docs = docs.withColumns(fresh)
        racks = {f"_{name}_rack_{rack}": _least([F.col(f"_{name}_{s}") for s in own]) for racks in levels.values() for rack, own in racks.items()}
        docs = docs.withColumns(racks)
        regions = {f"_{name}_region_{region}": _least([F.col(f"_{name}_rack_{rack}") for rack in racks]) for region, racks in levels.items()}
        docs = docs.withColumns(regions).withColumn(name, _least([F.col(r) for r in regions])["shard"])
        docs = docs.drop(*fresh, *racks, *regions)
    return docs


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(as_bytes("text"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = placed(rows, shards).withColumn("law", F.lit("key"))
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
