"""WARC archives: written with an index of byte ranges, deduplicated on the index alone, read back by coalesced ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, forget, shared_dir, table

#: The format's version, line ends and the profile that revisits name.
VERSION, END = "WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, record_id string, record_type string, url string, digest string, payload_bytes long, page string, refers_to string"


class Store:
    """Files under a URI, for tasks: local paths and file: as they are, other schemes as Arrow's file systems reach them."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.system, self.base = fs.FileSystem.from_uri(uri)
        self._name, self._file = None, None

    def create(self, name: str):
        self.system.create_dir(self.base, recursive=True)
        return self.system.open_output_stream(f"{self.base}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self._name:
            self._name, self._file = name, self.system.open_input_file(f"{self.base}/{name}")
        return self._file.read_at(length, offset)


def _head(first: str, fields: list[tuple[str, object]]) -> bytes:
    """A header block; line ends inside a value, which would begin another field, are percent-encoded, and fields without value left out."""
    lines = [first, *(f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "replace") + END + END


def _record(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own."""
    return gzip.compress(_head(VERSION, [*fields, ("Content-Length", len(block))]) + block + END + END, level, mtime=0)


def _named(kind: str, record: str, date: str, url: str | None, digest: str, page: str | None) -> list[tuple[str, object]]:
    return [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page)]


def _http(size: int) -> bytes:
    return _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])


def response(record: str, date: str, url: str | None, page: str | None, payload: bytes, level: int = 6) -> tuple[bytes, str]:
    """A response record with its payload, and the payload's SHA-256 in hex."""
    digest = hashlib.sha256(payload).hexdigest()
    fields = [*_named("response", record, date, url, digest, page), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, _http(len(payload)) + payload, level), digest


def revisit(record: str, date: str, url: str | None, page: str | None, digest: str, size: int, original: str, original_url: str | None, original_page: str | None, level: int = 6) -> bytes:
    """A record without payload that refers to one with an equal payload; its HTTP head tells the payload's size."""
    fields = [*_named("revisit", record, date, url, digest, page), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{original}>"), ("WARC-Refers-To-Target-URI", original_url), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", original_page), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, _http(size), level)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(member: bytes) -> dict[str, object]:
    """A record's fields by lower-case name, with payload (bytes), payload_bytes and digest (of the payload, or as a revisit tells them)."""
    raw = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = raw.partition(END + END)
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record where the index says")
    found: dict[str, object] = _fields(head)
    http, _, payload = rest[: int(found["content-length"])].partition(END + END)
    told = found.get("warc-payload-digest", "").removeprefix("sha256:")
    if found["warc-type"] == "revisit":
        return found | {"payload": None, "payload_bytes": int(_fields(http)["content-length"]), "digest": told, "intact": True}
    digest = hashlib.sha256(payload).hexdigest()
    return found | {"payload": payload, "payload_bytes": len(payload), "digest": digest, "intact": digest == told}


class _Out:
    """Archives that a task writes, each under a name that no other attempt uses; add() gives a record's (file, offset)."""

    def __init__(self, uri: str, roll: int, date: str):
        self.store, self.roll, self.date, self.file = Store(uri), roll, date, None

    def add(self, member: bytes) -> tuple[str, int]:
        if self.file is not None and self.at >= self.roll:
            self.close()
        if self.file is None:
            self.name = f"pages-{uuid.uuid4().hex}.warc.gz"
            self.file = self.store.create(self.name)
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: graphloom\r\nformat: WARC File Format 1.1\r\n", 6)
            self.file.write(info)
            self.at = len(info)
        place = self.name, self.at
        self.file.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])


def _spooled(uri: str, roll: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(uri, roll, date)
        for batch in batches:
            rows = []
            for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                record, body = uuid.uuid4().urn, payload.as_py()
                member, digest = response(record, date, url, page, body, level)
                rows.append((*out.add(member), len(member), record, "response", url, digest, len(body), page, None))
            if rows:
                yield _index_batch(rows)
        out.close()

    return run


def _ranges(batches: Iterator[pa.RecordBatch], gap: int, most: int) -> Iterator[tuple[str, int, int, list[dict]]]:
    """(file, start, end, rows): rows sorted by file and offset, in runs that one read fetches: neighbours no further apart than gap, most bytes together (a longer record alone)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            end = row["offset"] + row["length"]
            if held and (row["file"] != held[0]["file"] or row["offset"] - high > gap or max(high, end) - held[0]["offset"] > most):
                yield held[0]["file"], held[0]["offset"], high, held
                held = []
            high = max(high, end) if held else end
            held.append(row)
    if held:
        yield held[0]["file"], held[0]["offset"], high, held


def _members(store: Store, batches: Iterator[pa.RecordBatch], gap: int, most: int) -> Iterator[tuple[dict, bytes]]:
    for file, start, end, rows in _ranges(batches, gap, most):
        data = store.read(file, start, end - start)
        for row in rows:
            at = row["offset"] - start
            yield row, data[at : at + row["length"]]


def _deduplicated(source: str, uri: str, roll: int, date: str, level: int, gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = _Out(uri, roll, date), []
        for row, member in _members(Store(source), batches, gap, most):
            if row["original"] is not None:
                member = revisit(row["record_id"], date, row["url"], row["page"], row["digest"], row["payload_bytes"], row["original"], row["original_url"], row["original_page"], level)
            kind = "response" if row["original"] is None else "revisit"
            rows.append((*out.add(member), len(member), row["record_id"], kind, row["url"], row["digest"], row["payload_bytes"], row["page"], row["original"]))
            if len(rows) == 4096:
                yield _index_batch(rows)
                rows = []
        if rows:
            yield _index_batch(rows)
        out.close()

    return run


def in_reading_order(index: DataFrame, region: int = 8 << 20) -> DataFrame:
    """Index rows dealt by regions of an archive's bytes and sorted there by file and offset, as one task reads them.

    There is a task for about every region bytes that the rows name: index rows are short, and tasks measured by them would read archives by the GB."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return index.withColumn("_region", F.floor(F.col("offset") / region)).repartition(1 + total // region, "file", "_region").sortWithinPartitions("file", "offset").drop("_region")


def originals(index: DataFrame, least: int, order: str, hot: int = 50_000, most: int = 10_000) -> DataFrame:
    """index with original, original_url and original_page: of records with equal payloads of least bytes or more the first by order names itself to the others; null elsewhere.

    Only index rows move. Digests that one record alone has are left out of the join; those of over hot records, most of them at most, are
    broadcast, so that no payload's copies gather in one task."""
    first = F.min(F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("id"), "url", "file", "offset", "record_id", "page")).alias("f")
    firsts = index.filter(F.col("payload_bytes") >= least).groupBy(F.col("digest").alias("_key")).agg(first, F.count("*").alias("_n")).filter("_n > 1")
    firsts = firsts.select("_key", "_n", F.col("f.record_id").alias("_id"), F.col("f.url").alias("_url"), F.col("f.page").alias("_page"))
    named = lambda rows, tag: rows.select(*[F.col(c).alias(f"{c}{tag}") for c in ("_key", "_id", "_url", "_page")])
    frequent = firsts.filter(F.col("_n") > hot).orderBy(F.desc("_n"), "_key").limit(most)
    wide = F.broadcast(named(frequent, "1"))
    rest = named(firsts.join(F.broadcast(frequent.select("_key")), "_key", "left_anti"), "2")
    held = index.join(wide, (F.col("digest") == F.col("_key1")) & (F.col("payload_bytes") >= least), "left")
    key = F.when(F.col("_key1").isNull() & (F.col("payload_bytes") >= least), F.col("digest")).otherwise(F.col("record_id"))  # an own key where there is nothing to find
    held = held.withColumn("_own", key).join(rest, F.col("_own") == F.col("_key2"), "left")
    pick = lambda c: F.coalesce(f"{c}1", f"{c}2")
    other = pick("_id") != F.col("record_id")
    return held.select(*index.columns, *[F.when(other, pick(c)).alias(name) for c, name in (("_id", "original"), ("_url", "original_url"), ("_page", "original_page"))])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", roll: int = 1 << 30, level: int = 6, gap: int = 1 << 16, most: int = 4 << 20) -> DataFrame:
    """The index (INDEX) of the archives that path holds afterwards: a record of every row of pages, its payload body_col in UTF-8.

    Of records with equal payloads of at least least bytes, the one with the smallest id (null last; of several the smallest url, then any one)
    is a response and the others revisit it; all others are responses. A null body is an empty payload, a null id or url leaves its field out,
    line ends in a url are percent-encoded in the archive; repeated rows are records of their own; other columns are not read; no rows, no records.

    First every row is spooled as a response and its byte range, URL and digest indexed; then records that repeat are found on the index alone, and
    the archives are written by copying ranges of the spool, compressed as they are, and making revisits in the others' place. So payloads
    never go through a shuffle. An archive's name is its attempt's own and an index row is only there if its task was
    committed, so lost executors and second attempts leave files that no row names (see orphans()), never rows without bytes."""
    spark = pages.sparkSession
    bound_batches(spark)
    given = pages.select(F.col(f"`{id_col}`").cast("string").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{body_col}`"), F.lit("")).cast("binary").alias("payload"))
    spool = f"{path}/spool"
    given.mapInArrow(_spooled(f"{spool}/data", roll, date, level), INDEX).write.parquet(f"{spool}/index")
    kind = pages.schema[id_col].dataType.simpleString()
    index = spark.read.schema(INDEX).parquet(f"{spool}/index").withColumn("_order", F.col("page").cast(kind))
    marked = in_reading_order(originals(index, least, "_order").drop("_order"))
    marked.mapInArrow(_deduplicated(f"{spool}/data", f"{path}/data", roll, date, level, gap, most), INDEX).write.parquet(f"{path}/index")
    forget(spark, spool)
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def orphans(spark: SparkSession, path: str) -> DataFrame:
    """(file): archives under path that no row of the index names, left by attempts that were lost."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return there.join(spark.read.schema(INDEX).parquet(f"{path}/index").select("file").distinct(), "file", "left_anti")


def read_records(index: DataFrame, path: str, payload: bool = True, gap: int = 1 << 16, most: int = 4 << 20) -> DataFrame:
    """The records that index rows select, read from the archives under path: record_id, record_type, url, page, digest, payload_bytes, intact, refers_to, refers_page[, payload].

    Ranges are sorted and neighbours fetched by one read, at most gap bytes of others between them and most bytes at once. digest and payload_bytes are
    those of the bytes read; intact is whether the digest is the one that the record tells. A revisit has no payload (see
    resolved()) and what it tells of it. A row selected twice is read twice; an index row that points elsewhere is an error."""
    out = "record_id string, record_type string, url string, page string, digest string, payload_bytes long, intact boolean, refers_to string, refers_page string"
    kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.string(), pa.string()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            names = [f.split()[0] for f in out.split(", ")] + ["payload"] * payload
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for _, member in _members(Store(f"{path}/data"), batches, gap, most):
            r = parse(member)
            bare = lambda name, r=r: r[name][1:-1] if name in r else None
            rows.append((bare("warc-record-id"), r["warc-type"], r.get("warc-target-uri"), r.get("x-page-id"), r["digest"], r["payload_bytes"], r["intact"], bare("warc-refers-to"), r.get("x-refers-to-page-id"), *[r["payload"]] * payload))
            size += payload * len(r["payload"] or b"")
            if len(rows) == 4096 or size > most:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return in_reading_order(index.select("file", "offset", "length")).mapInArrow(run, out + ", payload binary" * payload)


def resolved(records: DataFrame) -> DataFrame:
    """records with the payload that revisits refer to, where that response is among them; null where it isn't."""
    held = records.filter("payload is not null").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    asked = records.filter("refers_to is not null").select(F.col("refers_to").alias("_id")).distinct()
    found = held.join(asked, "_id", "left_semi")
    return records.join(found, F.col("refers_to") == F.col("_id"), "left").select(*[c for c in records.columns if c != "payload"], F.coalesce("payload", "_payload").alias("payload"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back through the index."""
    pages, path = table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_records(write_archives(pages, path), path, payload=False)
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_page").cast("long").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER (ORDER BY page_id, url) AS r FROM pages),
f AS (SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id, r))
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND k > 1 THEN first END AS refers_to
FROM f
"""
