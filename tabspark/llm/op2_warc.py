"""WARC archives: writing pages as records, and reading them back by boundary chains."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabspark.llm.common import stored, table, text_bytes
from tabspark.llm.registry import query
from tabspark.session import scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
GAP = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

#: A digest that at least one row in so many has is hot: there are at most so many, and they are broadcast.
HOT_DIGESTS = 1_000


def with_roles(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html).

    Of equal payloads of at least ``least_bytes`` those rows with the smallest
    page_id are responses, the others revisits. A null html is an empty payload;
    a row without page_id is a revisit where its group has a page_id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        text_bytes("html").alias("payload"))
    base = (base.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha2("payload", 256)))
    groups = stored(base.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
                    .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payload-groups")
    total = pages.count()
    hot = groups.where(F.col("n") * HOT_DIGESTS >= total).select(
        F.col("payload_digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    cold = groups.where(F.col("n") * HOT_DIGESTS < total).select(F.col("payload_digest").alias("key"), F.col("first").alias("cold_first"))
    joined = base.join(F.broadcast(hot), F.col("payload_digest") == F.col("hot_digest"), "left")
    # rows that need no look-up keep a key of their own, spread over all partitions
    alone = F.concat(F.lit("-"), F.pmod(F.xxhash64("page_id", "url"), F.lit(100_003)).cast("string"))
    needs = (F.col("payload_bytes") >= least_bytes) & F.col("hot_digest").isNull()
    joined = joined.withColumn("key", F.when(needs, F.col("payload_digest")).otherwise(alone)).join(cold, "key", "left")
    first = F.coalesce("hot_first", "cold_first")
    revisit = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, first).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(GAP))


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Writes the rows of ``with_roles`` as uncompressed archives; revisits carry no payload."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", _urn(F.col("page_id"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(_header("WARC-Refers-To", _urn(F.col("refers_to"))),
                                 _header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body).cast("string")), F.lit(GAP))
    # Spark's text writer puts the bytes of a string unchanged and the second line end after it.
    record = F.concat(head.cast("binary"), body, F.lit(GAP.encode()))
    (records.select(record.cast("string").alias("value")).write
     .option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, in file order inside each input split."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def _candidates(batches):
    """Of each split: its bytes, and for every magic where the chain that begins there leaves the split.

    Offsets are relative to the split's first piece; -1 ends a chain that hits
    no magic. ``last`` is the chain's last record in the split.
    """
    now, parts = None, []

    def out():
        size = np.concatenate([p[0] for p in parts])
        head = np.concatenate([p[1] for p in parts])
        body = np.concatenate([p[2] for p in parts])
        # a split that begins inside a file, too, begins with bytes after a magic
        ends = np.cumsum(size + len(MAGIC))
        at = ends - size - len(MAGIC) - len(MAGIC)
        after = np.where(body >= 0, at + len(MAGIC) + head + 2 * len(GAP) + body + 2 * len(GAP), -1)
        border = ends[-1] - len(MAGIC)
        here = np.searchsorted(at, after)
        jump, last = np.full(len(at), -1), at.copy()
        for i in range(len(at) - 1, -1, -1):
            if after[i] < 0:
                continue
            k = here[i]
            if k < len(at) and at[k] == after[i]:
                jump[i], last[i] = jump[k], last[k]
            elif after[i] >= border:
                jump[i] = after[i]
        return pd.DataFrame({"file": now[0], "block": now[1], "bytes": int(ends[-1]), "at": at, "jump": jump, "last": last})

    for b in batches:
        key = list(zip(b["file"], b["block"]))
        cuts = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1]] + [len(key)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if now is not None and key[x] != now:
                yield out()
                parts = []
            now = key[x]
            parts.append(tuple(b[c].to_numpy()[x:y] for c in ("size", "head", "body")))
    if parts:
        yield out()


def chains(spark: SparkSession, path: str) -> DataFrame:
    """One row per split: file, block, base offset, first true record in it and the one that reaches into it.

    Tasks propose (record, successor) offsets for every magic; inside a split
    they are contracted to the jump out of it. Pointer jumping from the start
    of each file, doubling the length of the jumps, finds the true ones: magics
    inside payloads are never reached.
    """
    head = F.substring_index("value", GAP + GAP, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1)
    whole = F.octet_length(head) < F.octet_length("value")
    found = stored(_pieces(spark, path).select(
        "file", "block", F.octet_length("value").cast("long").alias("size"), F.octet_length(head).cast("long").alias("head"),
        F.when(whole & (length != ""), length.cast("long")).otherwise(F.lit(-1)).alias("body"))
        .mapInPandas(_candidates, "file long, block long, bytes long, at long, jump long, last long"), "candidates")
    # one row per input split: at most the bytes of the archives over the split size
    order = Window.partitionBy("file").orderBy("block")
    splits = (found.groupBy("file", "block").agg(F.first("bytes").alias("bytes"))
              .withColumn("base", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("base", F.coalesce("base", F.lit(0))).select("file", "block", "base"))
    splits = stored(splits, "splits")
    nodes = found.join(F.broadcast(splits), ["file", "block"])
    # the first piece of a file follows no magic, so later offsets of the file count from its start
    nodes = nodes.select("file", "block", *[F.when(F.col(c) == -1, -1).otherwise(F.col(c) + F.col("base")).alias(c) if c == "jump"
                                            else (F.col(c) + F.col("base")).alias(c) for c in ("at", "jump", "last")])
    targets = nodes.where("jump >= 0").select("file", F.col("jump").alias("at")).distinct()
    jumps = stored(nodes.where("at >= 0").join(targets, ["file", "at"], "left_semi")
                   .union(nodes.where("at = 0")).distinct(), "jumps")
    step = jumps.where("jump > at").select("file", "at", "jump")
    reached = stored(jumps.where("at = 0").select("file", "at"), "reached")
    count = reached.count()
    while count:
        reached = stored(reached.union(reached.join(step, ["file", "at"]).select("file", F.col("jump").alias("at")))
                         .join(jumps.select("file", "at"), ["file", "at"], "left_semi").distinct(), "reached")
        more = reached.count()
        if more == count:
            break
        count = more
        onward = step.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        step = stored(step.join(onward, ["file", "jump"]).select("file", "at", F.col("far").alias("jump")), "step")
    entries = (jumps.join(reached, ["file", "at"]).groupBy("file", "block")
               .agg(F.min("at").alias("entry"), F.min_by("last", "at").alias("last")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return stored(splits.join(entries, ["file", "block"], "left")
                  .withColumn("owner", F.last("last", ignorenulls=True).over(before))
                  .select("file", "block", "base", "entry", "owner"), "chains")


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split(GAP):
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(urn: str | None):
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _record(data: bytes) -> dict:
    """Fields of one whole record without its magic."""
    head, _, rest = data.partition((GAP + GAP).encode())
    fields = _parse(head)
    payload = rest[:int(fields["content-length"])]
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"])
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return {"page_id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload": payload,
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": _number(fields.get("warc-refers-to"))}


def _size(data: bytes) -> int | None:
    """Bytes of a record that begins here, without its magic; None if its header is cut off."""
    head, gap, _ = data.partition((GAP + GAP).encode())
    return len(head) + 2 * len(GAP) + int(_parse(head)["content-length"]) + 2 * len(GAP) if gap else None


FIELDS = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filled(frame: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """With these columns; absent ones are null."""
    return frame.reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)


def _frame(records: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=FIELDS)
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = pd.array(out[c].tolist(), "Int64")
    return out


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The true records of the archives at ``path``; without ``payloads`` that column is null.

    Records that lie in several splits are put together from their fragments,
    one record at a time. Archives may be of any size; memory is bounded by the
    largest record. A file whose first bytes are no record gives nothing.
    """
    files = spark.read.format("binaryFile").load(path).select("length")
    if not files.limit(1).count():
        return spark.createDataFrame([], SCHEMA)
    # both passes must see the same splits, also when executors come and go meanwhile
    key, before = "spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        splits = chains(spark, path)
        pieces = _pieces(spark, path).join(F.broadcast(splits), ["file", "block"], "left")
        columns = [f for f in FIELDS if payloads or f != "payload"]

        def run(batches):
            now, at, whole, start, need, size, part = None, 0, [], None, 0, 0, []
            magic = MAGIC.encode()

            def tail():
                """An unfinished record, or none, as fragments."""
                return [{"file": now[0], "owner": start, "at": a, "piece": p} for a, p in part]

            for b in batches:
                rows, loose = [], []
                for value, file, block, base, entry, owner in zip(*(b[c] for c in ("value", "file", "block", "base", "entry", "owner"))):
                    if (file, block) != now:
                        loose += tail()
                        if pd.isna(base):
                            raise RuntimeError("the input splits changed between the two passes over the archives")
                        now, at = (file, block), int(base) - len(magic)
                        goal = None if pd.isna(entry) else int(entry)
                        start, need, size, part = None if pd.isna(owner) else int(owner), None, 0, []
                    if goal is not None and at == goal:
                        loose += tail()
                        start, need, size, part = at, _size(value), 0, []
                        goal = None if need is None else at + len(magic) + need
                    if start is not None:
                        part.append((at, value))
                        size += len(value) + (len(magic) if size else 0)
                        if need is not None and part[0][0] == start and size >= need:
                            rows.append(_record(magic.join(p for _, p in part)))
                            start, part = None, []
                    at += len(value) + len(magic)
                if rows:
                    yield _filled(_frame(rows)[columns], ALL)
                if loose:
                    yield _filled(pd.DataFrame(loose), ALL)
            if now is not None and part:
                yield _filled(pd.DataFrame(tail()), ALL)

        ordered = pieces.select(F.col("value").cast("binary").alias("value"), "file", "block", "base", "entry", "owner")
        out = stored(ordered.mapInPandas(run, SCHEMA + ", file long, owner long, at long, piece binary"), "records")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

    def join(batches):
        for b in batches:
            yield _filled(_frame([_record(MAGIC.encode().join(p)) for p in b["pieces"]])[columns], FIELDS)

    cut = (out.where(F.col("file").isNotNull()).groupBy("file", "owner")
           .agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("all"))
           .where(F.col("all")[0]["at"] == F.col("owner")).select(F.transform("all", lambda x: x["piece"]).alias("pieces")))
    return out.where(F.col("file").isNull()).select(*FIELDS).union(cut.mapInPandas(join, SCHEMA))


ALL = FIELDS + ["file", "owner", "at", "piece"]


@query("op2_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    g AS (SELECT *, octet_length(encode(html)) AS size, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
    FROM g""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(with_roles(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
