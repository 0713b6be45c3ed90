"""WARC archives: writing, reading back and resolving revisits.

Archives are real WARC/1.1 files: a warcinfo record, then the records, each a gzip member of its own, so that readers can seek. A task gathers members up
to ``ARCHIVE_BYTES`` and hands them over as one row, which Spark's text writer makes a file of its own: archives are bounded in bytes whatever
the payloads' sizes, go to any file system Spark can write to and are committed by task. Readers take one archive at a time and
unpack it record by record; blocks are cut by Content-Length, so payloads may hold any bytes.

``resolve_revisits`` shuffles headers alone: the response of each payload digest is an aggregate (partial before the
shuffle), and records look it up by a join in which hot digests are broadcast, so a payload that a third of all pages have is
no hot key. Decisions then go back to the archive that holds the record, one row per archive, and each
archive is rewritten with fresh headers. Up to ``BROADCAST_ROWS`` decisions are broadcast and archives stay where they are; beyond, the compressed archives are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import hot_join, map_arrow, materialize, seal, shared_dir, table

ARCHIVE_BYTES = 8 << 20  # compressed bytes of one archive; one record may be larger
GZIP_LEVEL = 3
MIN_BYTES = 0  # smaller payloads are never revisits
BROADCAST_ROWS = 200_000  # decisions of about 100 bytes
DATE = "2024-01-01T00:00:00Z"  # a parameter, so that reruns write equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
SLICE = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: str, uri: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join((kind, key, uri, payload_digest)))}>"


def header_value(x: str | None) -> str:
    """A value that fits on one header line."""
    return "".join(c if c.isprintable() else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in x or "").strip()


def written(fields: dict[str, str], block: bytes) -> bytes:
    """One record with the blank lines at its end."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"Content-Length: %d" % len(block) + END + block + END


def record(kind: str, key: str, uri: str, payload: bytes, payload_digest: str, length: int, date: str, refers: dict[str, str] | None = None, generation: str = "crawl") -> bytes:
    """One WARC record. A revisit keeps the HTTP header and drops the payload; ``generation`` sets the record's id apart from that of what it was made of."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(f"{generation} {kind}", key, uri, payload_digest),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "X-Record-Key": key,
        "X-Payload-Length": str(length),
        **(refers or {}),
        "Content-Type": "application/http;msgtype=response",
    }
    return written(fields, http + (payload if kind == "response" else b""))


def warcinfo(date: str, generation: str) -> bytes:
    """The record that begins an archive."""
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", generation, date, ""), "WARC-Date": date, "Content-Type": "application/warc-fields"}
    return written(fields, b"software: dayloom\r\nformat: WARC File Format 1.1\r\n")


def member(data: bytes) -> bytes:
    """Data as a gzip member that ends in a zero byte: that of its length or, from 16 MB on, that of an empty member behind it."""
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    packed = z.compress(data) + z.flush()
    return packed if packed[-1] == 0 else packed + member(b"")


def archives(records_: Iterator[bytes], date: str, generation: str, most: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Whole archives of up to ``most`` compressed bytes, or of one record that is larger."""
    head = member(warcinfo(date, generation))
    parts, held = [head], len(head)
    for r in records_:
        packed = member(r)
        if len(parts) > 1 and held + len(packed) > most:
            yield b"".join(parts)
            parts, held = [head], len(head)
        parts.append(packed)
        held += len(packed)
    if len(parts) > 1:
        yield b"".join(parts)


def members(archive: bytes) -> Iterator[bytes]:
    """The contents of an archive's gzip members, one at a time."""
    at, data = 0, memoryview(archive)
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(data[at : at + SLICE]))
            at = min(len(data), at + SLICE) - len(z.unused_data)
        if content := b"".join(out):
            yield content


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive but warcinfo, in order; a member may hold several."""
    for content in members(archive):
        at = 0
        while at < len(content):
            stop = content.index(END, at)
            lines = content[at:stop].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at} of a member")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            start = stop + len(END)
            end = start + int(headers["Content-Length"])
            if content[end : end + len(END)] != END:
                raise ValueError(f"record at byte {at} of a member does not end in blank lines")
            if headers["WARC-Type"] != "warcinfo":
                yield headers, content[start:end]
            at = end + len(END)


def _save(lines: DataFrame, path: str) -> str:
    """Write a frame of one binary column, a file a row. Spark casts the bytes to text as they are; the zero byte that all end in is its line separator."""
    last = F.octet_length("archive") - 1
    bare = lines.select(F.substring("archive", F.lit(1), last).cast("string"))
    bare.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def write_warc(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = DATE) -> str:
    """Write every row as a response record; a null payload is empty, a null key or uri an empty header. Repeated rows are written each, other
    columns play no part, and an empty table writes no archive.
    """
    held, at = seal(df)
    text = F.col(at[payload])
    rows = held.select(F.coalesce(F.col(at[key]).cast("string"), F.lit("")).alias("key"), F.col(at[uri]).cast("string").alias("uri"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("payload"))

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for k, u, p in zip(*batch.columns):
                p = p.as_py()
                yield record("response", header_value(k.as_py()), header_value(u.as_py()), p, digest(p), len(p), date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in archives(responses(batches), date, "crawl"):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    return _save(map_arrow(rows, run, "archive binary"), path)


HEADERS = {"archive": pa.string(), "place": pa.int64(), "kind": pa.string(), "key": pa.string(), "uri": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_key": pa.string(), "seen_digest": pa.string()}


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of every record under ``path``, warcinfo apart; seen_digest is computed from the payload, null where none is stored.

    Headers that are not there are null, and so is payload_bytes of a revisit that does not tell it. A folder without archives gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for i, (h, block) in enumerate(records(content.as_py())):
                    stored = h["WARC-Type"] == "response"
                    body = block[block.index(END) + len(END) :] if stored else b""
                    length = len(body) if stored else int(h["X-Payload-Length"]) if "X-Payload-Length" in h else None
                    told = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    seen = digest(body) if stored else None
                    rows.append((name, i, h["WARC-Type"], h.get("X-Record-Key"), h.get("WARC-Target-URI"), told or seen, length, h.get("X-Refers-To-Key"), seen))
                columns = list(zip(*rows)) or [()] * len(HEADERS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, HEADERS.values())], names=list(HEADERS))

    schema = ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in HEADERS.items())
    return map_arrow(_archives(spark, path), run, schema)


def decisions(headers: DataFrame, total: int, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(archive, place, refers_key, refers_uri) of the records that are to be revisits, of ``total`` in all.

    Of response records with equal payloads of at least ``min_bytes`` bytes, that with the largest key (as an integer; records without one
    are smaller, ties go by archive and place) stays a response. The others become revisits, and records that are revisits already refer to it;
    one whose original is not among the records is left as it is. Records without a digest are left alone; an empty table gives none.
    """
    rows = headers.where(F.col("payload_digest").isNotNull()).select("payload_digest", "archive", "place")
    mark = F.struct(F.expr("try_cast(key AS BIGINT)").alias("n"), "key", "archive", "place", "uri")
    whole = (F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)
    best = headers.where(F.col("payload_digest").isNotNull()).groupBy("payload_digest")
    best = best.agg(F.max(F.when(whole, mark)).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 AND best IS NOT NULL")
    met = hot_join(rows, best, "payload_digest", "n", total)
    met = met.where((F.col("archive") != F.col("best.archive")) | (F.col("place") != F.col("best.place")))
    return met.select("archive", "place", F.col("best.key").alias("refers_key"), F.col("best.uri").alias("refers_uri"))


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> str:
    """Rewrite the archives under ``source`` to ``target`` with duplicates as revisits; every record gets fresh headers.

    Records keep their date; ids are new, and revisits refer to the new ids. Payloads of any length pass through one at a time; archives without
    records write none.
    """
    headers = materialize(read_headers(spark, source).drop("seen_digest"))
    found = materialize(decisions(headers, headers.count(), min_bytes))
    per_archive = found.groupBy(F.col("archive").alias("path")).agg(F.collect_list(F.struct("place", "refers_key", "refers_uri")).alias("revisits"))
    if found.count() <= BROADCAST_ROWS:
        per_archive = F.broadcast(per_archive)
    joined = _archives(spark, source).join(per_archive, "path", "left").select("content", "revisits")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1)):
                to = {r["place"]: r for r in revisits.as_py() or []}
                for i, (h, block) in enumerate(records(content.as_py())):
                    stored = h["WARC-Type"] == "response"
                    body = block[block.index(END) + len(END) :] if stored else b""
                    name = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or digest(body)
                    length = len(body) if stored else int(h.get("X-Payload-Length", 0))
                    refers = None
                    if r := to.get(i):
                        key, uri = r["refers_key"] or "", r["refers_uri"] or ""
                        refers = {
                            "WARC-Profile": PROFILE,
                            "WARC-Refers-To": record_id("deduplicated response", key, uri, name),
                            "WARC-Refers-To-Target-URI": uri,
                            "WARC-Refers-To-Date": date,
                            "X-Refers-To-Key": key,
                        }
                    elif not stored:  # its original is elsewhere
                        refers = {k: v for k, v in h.items() if k.startswith(("WARC-Refers-To", "WARC-Profile", "X-Refers-To"))}
                    kind = "revisit" if r or not stored else "response"
                    yield record(kind, h.get("X-Record-Key", ""), h.get("WARC-Target-URI", ""), body, name, length, h.get("WARC-Date", date), refers, "deduplicated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in archives(rewritten(batches), date, "deduplicated"):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    return _save(map_arrow(joined, run, "archive binary"), target)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the deduplicated archives, as read back from them."""
    folder = shared_dir(spark)
    source = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{folder}/crawl")
    found = read_headers(spark, resolve_revisits(spark, source, f"{folder}/deduplicated"))
    return found.select(
        F.expr("try_cast(key AS BIGINT)").alias("page_id"),
        "payload_bytes",
        F.coalesce("seen_digest", "payload_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.expr("try_cast(refers_key AS BIGINT)").alias("refers_to"),
        F.col("uri").alias("target_uri"),
    )


QUERIES = {"op8_warc_revisits": op8_warc_revisits}
ORACLE_SQL = {
    "op8_warc_revisits": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best, CAST(CAST(from_hex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 160, 5), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
                   16 * CAST(bits[k + 1] = '1' AS INTEGER) + 8 * CAST(bits[k + 2] = '1' AS INTEGER) + 4 * CAST(bits[k + 3] = '1' AS INTEGER)
                   + 2 * CAST(bits[k + 4] = '1' AS INTEGER) + CAST(bits[k + 5] = '1' AS INTEGER) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to, url AS target_uri
        FROM m
    """
}
