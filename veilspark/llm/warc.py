"""Deterministic sharded WARC archives.

Records are dealt into shards by ranges of their id and sorted within; each shard is
written by one task into gzip files (a member for each record) that roll at a
compressed size. Headers, record ids and digests are made anew from the content, so the
same pages give the same bytes. Files are written under temporary names, renamed when
they are whole, and count only once the manifest that lists them is committed.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import scratch, small, stored, table
from veilspark.llm.rows import MAX_BROADCAST_KEYS

#: Payloads of at least so many bytes are stored once; equal ones become revisits.
REVISIT_BYTES = 100
ROLL_BYTES = 32 << 20
#: Payload bytes that a shard is meant to hold.
SHARD_BYTES = 16 << 20
#: Ranges of ids whose sizes are added up to cut the shards: 16 for each shard, a million at most.
MAX_RANGES = 1_000_000
#: Parts that a range of more bytes than a shard is split into, again and again.
SPLIT = 1_024
#: Tasks that write, at most; each shard is written by one.
MAX_TASKS = 20_000
#: Shards among which pages without an id are dealt.
NAMELESS = 64
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, shard long, part int, records long, bytes long, sha256 string"
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_BATCH = 256


@contextmanager
def _batches(spark: SparkSession, rows: int = _BATCH):
    """Arrow batches of few rows for the jobs inside: pages are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}|{copy}')}>"


def _clean(value: str) -> str:
    """A header value: no line ends or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    whole = [*head, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return gzip.compress(_head(whole) + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _opening(name: str) -> bytes:
    block = b"software: deterministic archive writer\r\nformat: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return _member(fields, block)


def _page(row, copy: int, kind: str, refers_to: int | None) -> bytes:
    payload = row.payload or b""
    page = None if pd.isna(row.page_id) else int(row.page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(page, row.payload_digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(row.url) if isinstance(row.url, str) and row.url else f"urn:page:{page}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{row.payload_digest}"),
        ("X-Payload-Length", str(row.payload_bytes)),
    ]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _record_id(refers_to, row.payload_digest, 0)))
        if refers_to is not None:
            fields.append(("X-Refers-To-Page", str(refers_to)))
        return _member(fields, http)
    return _member(fields, http + payload)


class _Roller:
    """Files of one shard; a file is renamed to its name when it is whole.

    Every attempt has a folder of its own, so that one that is repeated meets no file of
    the one before; the manifest tells which attempt counts.
    """

    def __init__(self, folder: str, shard: int, roll_bytes: int, attempt: str):
        self.fs, self.path = arrow_fs.FileSystem.from_uri(folder)
        self.attempt = attempt
        self.shard, self.roll_bytes, self.part, self.out, self.done = shard, roll_bytes, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.roll_bytes:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self._put(_opening(self.name))
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            file = f"{self.attempt}/{self.name}"
            self.fs.create_dir(f"{self.path}/{self.attempt}", recursive=True)
            self.fs.move(self.temporary, f"{self.path}/{file}")
            self.done.append((file, self.shard, self.part, self.records, self.size, self.digest.hexdigest()))
            self.out, self.part = None, self.part + 1


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller, last, copy = None, None, 0
        attempt = f"attempt-{uuid.uuid4().hex}"
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if roller is None or roller.shard != row.shard:
                    if roller is not None:
                        roller.close()
                        found += roller.done
                    roller = _Roller(folder, int(row.shard), roll_bytes, attempt)
                page = None if pd.isna(row.page_id) else int(row.page_id)
                copy = copy + 1 if (page, row.payload_digest) == last else 0
                last = (page, row.payload_digest)
                kind, refers_to = row.record_type, None if pd.isna(row.first_id) else int(row.first_id)
                if copy and row.payload_bytes >= REVISIT_BYTES:
                    kind, refers_to = "revisit", refers_to if kind == "revisit" else page
                roller.add(_page(row, copy, kind, refers_to))
            if found:
                yield pd.DataFrame(found, columns=_columns(_MANIFEST))
        if roller is not None:
            roller.close()
            yield pd.DataFrame(roller.done, columns=_columns(_MANIFEST))

    return write


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _placed(pages: DataFrame, low: int, width: int, ranges: int, splits: list[tuple[DataFrame, int]]) -> DataFrame:
    """Pages with ``place``, an array that orders them: range of the id, part of a split range, part of that, ...

    A split has the places that it splits and the width of the parts in ids; width 0 splits
    the rows of one id by digest, as those without an id always are.
    """
    digest = F.conv(F.substring("payload_digest", 1, 12), 16, 10).cast("long")
    nameless = F.lit(ranges) + F.shiftright(digest, 48 - NAMELESS.bit_length() + 1)
    # Quotients of whole numbers: ids beyond 2^53 keep their order.
    first = F.when(F.col("page_id").isNull(), nameless).otherwise(F.expr(f"(page_id - {low}L) div {width}L")).cast("long")
    placed = pages.withColumns({"place": F.array(first), "rest": F.expr(f"(page_id - {low}L) % {width}L")})
    for crowded, own in splits:
        by_digest = F.shiftright(digest, 32)
        part = F.coalesce(F.expr(f"rest div {own}L"), by_digest) if own else by_digest
        parents = F.broadcast(crowded.select(F.col("place").alias("crowded")))  # fewer than there are shards
        placed = placed.join(parents, F.col("place") == F.col("crowded"), "left")
        deeper = F.when(F.col("crowded").isNotNull(), F.concat("place", F.array(part))).otherwise(F.col("place"))
        placed = placed.withColumns({"place": deeper, "rest": F.expr(f"rest % {own}L") if own else F.col("rest")}).drop("crowded")
    return placed.drop("rest")


def _shards(pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``s_place, shard`` of every place, by the running sum of their sizes; and the pages with their ``place``.

    Ranges of ids have equal widths and exact sums; one that holds more than a shard is
    split, and its parts, down to the rows of one id, which are split by digest. So ids
    that lie far apart are no reason for a large shard, and the same pages always fall into
    the same ones.
    """
    size = F.octet_length("payload")
    facts = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum(size).alias("bytes")).first()
    low, high = facts["low"] or 0, facts["high"] or 0
    ranges = max(1, min(MAX_RANGES, 16 * (-(-(facts["bytes"] or 0) // shard_bytes)), high - low + 1))
    width = -(-(high - low + 1) // ranges)
    slim, splits, own = pages.select("page_id", "payload_digest", size.alias("size")), [], width
    while True:
        sums = _placed(slim, low, width, ranges, splits).groupBy("place").agg(F.sum("size").alias("size"))
        sums = stored(sums, "warc-places")
        crowded = sums.where((F.size("place") == len(splits) + 1) & (F.col("size") > shard_bytes))
        if own == 0 or crowded.isEmpty():
            break
        own = 0 if own == 1 else -(-own // SPLIT)
        splits.append((crowded, own))
    running = F.expr("sum(size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")  # a row for each place
    shard = F.floor(F.coalesce(running, F.lit(0)) / F.lit(shard_bytes)).cast("long")
    shards = stored(sums.select(F.col("place").alias("s_place"), shard.alias("shard")), "warc-shards")
    return shards, _placed(pages, low, width, ranges, splits)


def write_warc(pages: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (``page_id, url, html``) and returns the manifest.

    The payload is the html in UTF-8, null is empty. Of equal payloads of at least
    ``REVISIT_BYTES`` the one with the smallest id is the response, the others revisit
    it; smaller ones are all responses. Of rows equal in id and payload the first is the
    response. Rows without an id come last and never are the response of a row with one;
    among themselves the first is. An empty table gives an empty manifest. Other columns
    are not written. ``folder`` is a URI that every executor can write to.
    """
    spark = pages.sparkSession
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.withColumn("payload_digest", F.sha2("payload", 256))
    keyed = keyed.withColumn("payload_bytes", F.octet_length("payload").cast("long"))

    groups = keyed.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
    groups = groups.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stored(groups.select(F.col("payload_digest").alias("g_digest"), "first_id"), "warc-groups")
    groups = F.broadcast(groups) if small(groups, MAX_BROADCAST_KEYS) else groups  # payloads stay where they are
    shards, placed = _shards(keyed, shard_bytes)

    typed = placed.join(groups, F.expr("payload_digest = g_digest"), "left").drop("g_digest")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    typed = typed.withColumn("payload", F.when(~revisit, F.col("payload")))  # a revisit has none
    dealt = typed.join(F.broadcast(shards), F.expr("place = s_place")).drop("place", "s_place")
    # A task for each shard, whatever the session shuffles to; beyond MAX_TASKS one writes several, one after the other.
    last = shards.agg(F.max("shard")).first()[0]
    n = min(MAX_TASKS, 1 + (last or 0))
    ordered = dealt.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int"))
    ordered = ordered.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "payload_digest", "url")

    data = f"{folder.rstrip('/')}/data-{uuid.uuid4().hex}"
    filesystem, path = arrow_fs.FileSystem.from_uri(data)
    filesystem.create_dir(path, recursive=True)
    with _batches(spark):
        written = ordered.mapInPandas(_writer(data, roll_bytes), _MANIFEST).withColumn("folder", F.lit(data))
        written.write.parquet(f"{folder.rstrip('/')}/manifest")  # the commit: a manifest is there whole or not at all
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_MANIFEST}, folder string").parquet(f"{folder.rstrip('/')}/manifest")


def _parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, one at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one was expected: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            fields[key.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"the block of {fields['warc-record-id']} differs from its digest")
        stream.read(4)
        yield fields, block


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder, file in zip(batch["folder"], batch["file"]):
            filesystem, path = arrow_fs.FileSystem.from_uri(f"{folder}/{file}")
            found = []
            with filesystem.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for fields, block in _parse(stream):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
                    page, other = (fields.get(k) for k in ("x-page-id", "x-refers-to-page"))
                    found.append((page and int(page), size, digest, kind, other and int(other), fields["warc-target-uri"]))
                    if len(found) >= 10_000:
                        yield _found(found)
                        found = []
            if found:
                yield _found(found)


def _found(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_columns(_ROWS))
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the committed archives; every block and payload is held against its digest."""
    files = read_manifest(spark, folder).select("folder", "file")
    # One file is one row: a task for each, read as a stream.
    n = max(1, min(MAX_TASKS, files.count()))
    order = F.row_number().over(Window.orderBy("folder", "file")) - 1  # the manifest's rows, one for each file
    return files.withColumn("task", F.pmod(order, F.lit(n))).repartitionById(n, "task").drop("task").mapInPandas(_reader, _ROWS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(COALESCE(html, ''))::BIGINT AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first_id,
    ROW_NUMBER() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS place
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM f
"""
