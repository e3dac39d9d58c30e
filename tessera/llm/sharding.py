"""Sharding by a weighted hash tree: region, then rack, then shard.

Each row descends the tree and takes, at every node, the child with the shortest straw. A shard's straw is
ln(1/u) / weight, where u comes from a hash of the row's key and the shard; a node's is the shortest below it, which is
spread as if drawn for the node's whole weight. So a child wins in proportion to its weight, a change of one weight moves
rows only into or out of that shard, and, at any number of shards, one more takes rows only into itself (law `key`).
Straws drawn for each node apart would be fewer, but rows that a grown node wins would then spread over its old shards.

Nulls: a null key draws as the text 'null' apart from any id; a null text has size 1 (no bytes, plus 1).
Repeated rows: equal ids get equal shards, and a slot each. Ties of straws: the smaller shard. Very long texts: linear.
Empty input: no rows. Extra columns: ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

RACK_SHARDS, REGION_RACKS = 4, 2
#: Hex digits of a digest that make one draw: 52 bits, exact in a double.
DIGITS = 13
#: Parts of a shard that are numbered apart.
PARTS = 1024


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf holds its shard's number, any other node its children."""

    path: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """Shards in racks of RACK_SHARDS, racks in regions of REGION_RACKS; a node weighs what its shards weigh."""
    weights = weights or {}

    def group(nodes: list[Node], size: int, level: str) -> list[Node]:
        return [
            Node(f"{level}{i // size}", sum(n.weight for n in nodes[i : i + size]), tuple(nodes[i : i + size]))
            for i in range(0, len(nodes), size)
        ]

    leaves = [Node(f"shard{i}", float(weights.get(i, 1.0)), shard=i) for i in range(shards)]
    regions = group(group(leaves, RACK_SHARDS, "rack"), REGION_RACKS, "region")
    return Node("root", sum(r.weight for r in regions), tuple(regions))


def draw(key: Column, path: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(path), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")


def straw(key: Column, node: Node) -> Column:
    """struct<straw, shard>: the shortest straw below this node, and the shard that drew it."""
    if node.children:
        below = [straw(key, c) for c in node.children if c.weight > 0]
        return F.least(*below) if len(below) > 1 else below[0]
    ln = -F.log((draw(key, node.path) + 0.5) / float(16**DIGITS)) / node.weight
    return F.struct(ln.alias("straw"), F.lit(node.shard).alias("shard"))


def descend(key: Column, node: Node) -> Column:
    """The shard that the key reaches below this node."""
    return straw(key, node)["shard"]


def numbered(placed: DataFrame) -> DataFrame:
    """Adds slot, the rows' gapless numbers within each shard, in order of part, doc_id, size, text_crc32. Rows are numbered
    within (shard, part) and each part starts where the smaller parts of its shard end, so no task sees a whole shard."""
    sums = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = sums.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    local = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    return placed.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + local).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; only these few bytes a row are stored."""
    body, own = F.coalesce(F.col(text), F.lit("")), F.col(key)
    best = straw(own, tree(shards))
    placed = docs.select(
        own.alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        best.alias("best"),
        F.least(best, straw(own, Node(f"shard{shards}", 1.0, shard=shards))).alias("grown"),
        (draw(own, "part") % PARTS).cast("int").alias("part"),
    ).select("doc_id", "size", "text_crc32", F.col("best.shard").cast("int").alias("shard"), F.col("grown.shard").cast("int").alias("grown_shard"), "part")
    out = numbered(stored(placed, "sharding"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


_DRAW = "CAST('0x' || substr(md5({} || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)"
ORACLE_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_DRAW.format("'part'")} % {PARTS} AS part FROM documents),
s AS (SELECT rid, i, {_DRAW.format("'shard' || i")} AS u FROM d, range(17) AS r(i)),
b AS (SELECT rid, arg_max(i, (u, -i)) FILTER (i < 16) AS shard, arg_max(i, (u, -i)) AS grown FROM s GROUP BY rid),
k AS (SELECT list(v ORDER BY n) AS k FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n))),
x AS (SELECT t, hex(encode(t)) AS h FROM (SELECT DISTINCT t FROM d)),
y AS (SELECT t, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS y FROM x),
c AS (SELECT t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), y), lambda c, x: xor(k[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) AS crc FROM y, k)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, strlen(t), crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN b USING (rid) JOIN c USING (t)
"""
