"""Sharding: a hierarchical weighted hash tree, in built-in expressions only.

A row descends from the root over region and rack to a shard. At each level every
child draws an exponentially distributed number from a hash of the row's key and
the child's name, divided by the child's weight (the sum of the weights below
it); the least draw wins. A child's draw changes only with its own weight, so a
changed weight moves rows only into or out of the subtrees that contain it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabspark.llm.common import stored, table, text_bytes
from tabspark.llm.registry import query

#: Shards of the query and their layout: regions of RACKS racks of SHARDS_PER_RACK shards.
SHARDS, RACKS, SHARDS_PER_RACK = 16, 2, 4
#: Hex digits of the hash that number a shard's buckets: at most 65,536 of them.
BUCKET_DIGITS = 4
#: Copies of a row that are numbered at a time.
COPIES = 1 << 16
#: Hex digits of a draw; 52 bits are exact in a double.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def planned(shards: int = SHARDS, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> list[Leaf]:
    """Shards 0 to shards - 1 of equal weight, rack after rack and region after region."""
    return [Leaf(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own: no other subtree's weight changes, so rows only move into it."""
    shard = max(leaf.shard for leaf in leaves) + 1
    return [*leaves, Leaf(f"region+{shard}", f"rack+{shard}", shard, weight)]


def _tree(leaves: list[Leaf]) -> list:
    """[(region, weight, [(rack, weight, [(shard, weight)])])] in the order of the names."""
    alive = [leaf for leaf in leaves if leaf.weight > 0]
    if not alive or len({leaf.shard for leaf in alive}) < len(alive):
        raise ValueError("a tree needs shards of positive weight, each in one place")
    regions: dict = {}
    for leaf in alive:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append((leaf.shard, leaf.weight))
    out = []
    for region, racks in sorted(regions.items()):
        inner = [(rack, sum(w for _, w in shards), sorted(shards)) for rack, shards in sorted(racks.items())]
        out.append((region, sum(w for _, w, _ in inner), inner))
    return out


def _nodes(tree: list) -> Column:
    """The whole tree as one constant: nested arrays of (name, weight, children)."""
    def shards(rows):
        return F.array(*[F.struct(F.lit(str(s)).alias("name"), F.lit(float(w)).alias("weight"), F.lit(s).alias("shard")) for s, w in rows])

    def racks(rows):
        return F.array(*[F.struct(F.lit(r).alias("name"), F.lit(float(w)).alias("weight"), shards(below).alias("below")) for r, w, below in rows])

    return F.array(*[F.struct(F.lit(r).alias("name"), F.lit(float(w)).alias("weight"), racks(below).alias("below")) for r, w, below in tree])


def _draw(key: Column, path: Column, weight: Column) -> Column:
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", key, path)), 1, DRAW_DIGITS), 16, 10).cast("bigint")
    return -F.ln((hashed + F.lit(0.5)) / F.lit(float(16 ** DRAW_DIGITS))) / weight


def _winner(key: Column, path: Column, children: Column) -> Column:
    """The child with the least draw; ties, which a 52-bit draw hardly has, go to the smaller name."""
    return F.array_min(F.transform(children, lambda c: F.struct(
        _draw(key, F.concat_ws("/", path, c["name"]), c["weight"]).alias("draw"), c["name"].alias("name"), c.alias("node"))))["node"]


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda's argument isn't copied into the places that use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """(region, rack, shard) of a key. Draws hang on the names on the way down, never on places in the list."""
    def below_rack(key, region, rack):
        found = _winner(key, F.concat_ws("/", region["name"], rack["name"]), rack["below"])
        return F.struct(region["name"].alias("region"), rack["name"].alias("rack"), found["shard"].alias("shard"))

    def below_region(key, region):
        return _let(_winner(key, region["name"], region["below"]), lambda rack: below_rack(key, region, rack))

    root = _nodes(_tree(leaves))
    key = F.coalesce(key.cast("string"), F.lit("null"))
    return _let(key, lambda k: _let(_winner(k, F.lit(""), root), lambda region: below_region(k, region)))


def place(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", out: str = "place") -> DataFrame:
    """``docs`` with the column ``out`` = (region, rack, shard); row-local, without a shuffle.

    Only the key decides: rows with equal (also null) keys share a shard, whatever
    their texts. All columns stay; an existing column ``out`` is replaced.
    """
    return docs.withColumn(out, shard_of(F.col(f"`{key}`"), leaves))


def write_shards(docs: DataFrame, leaves: list[Leaf], path: str, key: str = "doc_id") -> None:
    """Writes all columns of ``docs`` as Parquet folders ``path``/_shard=N; tasks write what they read, nothing is shuffled."""
    place(docs, leaves, key, "_place").withColumn("_shard", F.col("_place.shard")).drop("_place").write.partitionBy("_shard").parquet(path)


def assign(docs: DataFrame, leaves: list[Leaf], more: list[Leaf] | None = None, digits: int = BUCKET_DIGITS,
           copies: int = COPIES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack) for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one (null: none), ``grown_shard`` the
    shard in the tree ``more``. ``slot`` numbers a shard's rows from 0 without
    gaps, by the MD5 of (doc_id, size, crc), then by these. Equal rows are counted
    before anything is shuffled and get neighbouring slots; rows with one doc_id
    and different texts lie in different buckets, so neither heaps up in a task.
    Null ids are a key like any other. An empty table gives no row; further
    columns are ignored. ``law`` is "key".
    """
    digest = docs.select(
        F.col("doc_id"), (F.octet_length(text_bytes()) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text_bytes()).alias("text_crc32"))
    groups = digest.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("doc_id")
    other = shard_of(key, more)["shard"] if more else F.lit(None).cast("int")
    hashed = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    groups = (groups.withColumn("place", shard_of(key, leaves)).withColumn("grown_shard", other).withColumn("hash", hashed)
              .select("doc_id", "size", "text_crc32", "n", "place.*", "grown_shard", "hash", F.substring("hash", 1, digits).alias("bucket")))
    groups = stored(groups, "groups")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (groups.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
               .select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("shard", "bucket").orderBy("hash", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = (groups.join(offsets, ["shard", "bucket"])
             .withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))))
    # a row's many copies are dealt out in pieces before they are numbered
    zero = F.lit(0).cast("bigint")
    pieces = (first.withColumn("piece", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / copies))))
              .repartition("hash", "piece"))
    numbered = pieces.withColumn("copy", F.explode(F.sequence(
        F.col("piece") * copies, F.least(F.col("n"), (F.col("piece") + 1) * copies) - 1)))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           (F.col("first") + F.col("copy")).alias("slot"), "grown_shard", "region", "rack")


def _sql() -> str:
    def crc_table() -> str:
        """The 256 entries of the byte-wise CRC-32, from its polynomial, as hex text."""
        out = []
        for c in range(256):
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            out.append(f"{c:08x}")
        return "".join(out)

    def values(tree):
        return ", ".join(f"('{r}', {rw}, '{k}', {kw}, {s}, {sw})" for r, rw, racks in tree for k, kw, shards in racks for s, sw in shards)

    def descent(name, tree):
        def draw(path, weight):
            return f"-ln((('0x' || substr(md5(k.key || '|' || {path}), 1, {DRAW_DIGITS}))::BIGINT + 0.5) / {16 ** DRAW_DIGITS}.0) / {weight}"
        return f"""
    {name}_t(region, rw, rack, kw, shard, sw) AS (VALUES {values(tree)}),
    {name}_r AS (SELECT k.key, arg_min(region, {draw("'/' || region", "rw")}) AS region FROM k, (SELECT DISTINCT region, rw FROM {name}_t) GROUP BY 1),
    {name}_k AS (SELECT k.key, k.region, arg_min(t.rack, {draw("k.region || '/' || t.rack", "kw")}) AS rack
                 FROM {name}_r k JOIN (SELECT DISTINCT region, rack, kw FROM {name}_t) t USING (region) GROUP BY 1, 2),
    {name}_s AS (SELECT k.key, k.region, k.rack, arg_min(t.shard, {draw("k.region || '/' || k.rack || '/' || t.shard", "sw")}) AS shard
                 FROM {name}_k k JOIN {name}_t t USING (region, rack) GROUP BY 1, 2, 3)"""

    leaves = planned()
    return f"""
    WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text FROM documents),
    c AS (SELECT doc_id, key, strlen(text) + 1 AS size,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
                lambda crc, b: xor(crc >> 8, ('0x' || substr('{crc_table()}', (8 * (xor(crc, b) & 255) + 1), 8))::BIGINT)), 4294967295::BIGINT) AS text_crc32
          FROM d),
    k AS (SELECT DISTINCT key FROM d), {descent("now", _tree(leaves))}, {descent("then", _tree(grown(leaves)))}
    SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
           row_number() OVER (PARTITION BY a.shard ORDER BY md5(key || '|' || size || '|' || text_crc32), doc_id, size, text_crc32) - 1 AS slot,
           b.shard::INTEGER AS grown_shard, a.region, a.rack
    FROM c JOIN now_s a USING (key) JOIN then_s b USING (key)"""


@query("op12_sharding", _sql())
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, and where they go with one more. The key decides, so equal texts need not meet."""
    leaves = planned()
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"), leaves, grown(leaves))
