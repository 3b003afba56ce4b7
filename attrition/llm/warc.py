"""WARC archives with revisit resolution.

The headers of all records are grouped by payload digest. Of equal payloads the
record with the largest page id stays a response; the others become revisit records
which name it. Archives are written by Spark's text writer: a record is
one string and the records' end (two line breaks) the line separator, so no
executor writes anywhere but to the given path. Reading back parses whole
files, which ``RECORDS_PER_FILE`` keeps small, by the records' lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

SALTS = 64
RECORDS_PER_FILE = 5_000
DATE = "2024-01-01T00:00:00Z"
FIELDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, payload binary")


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8: each 20 bits are 4 digits of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * i, 5), 16, 32), 4, "0")
                        for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to and refers_to_url of every row of ``pages`` (page_id, url, html).

    A null html is empty; payloads under ``min_bytes`` are never revisits. All
    rows that repeat the largest page id of a group are responses, and a null
    id is below all others. Other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"),
        "payload_digest": payload_digest(F.col("payload")),
        "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")})
    headers = rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id", "url")
    groups = headers.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("first")).where("n > 1")
    spread = groups.select("payload_digest", "first", F.explode(
        F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    got = rows.join(spread, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return got.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_to_url"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Values that would
    break a line or lose blanks go in base64 under the name with -Base64."""
    odd = value.rlike(r"[\x00-\x1F\x7F]|^\s|\s$")
    return F.when(value.isNull(), "").when(odd, F.concat(
        F.lit(f"\r\n{name}-Base64: "), F.regexp_replace(F.base64(value.cast("binary")), r"\s", ""))).otherwise(
        F.concat(F.lit(f"\r\n{name}: "), value))


def as_record(date: str = DATE) -> Column:
    """A resolved row as WARC record with fresh headers, without its end."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))), F.lit(f"\r\nWARC-Date: {date}"),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}"), _field("WARC-Refers-To", _record_id(F.col("refers_to"))),
            _field("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
            F.lit(f"\r\nWARC-Refers-To-Date: {date}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END), http, body)


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """Gzipped archives of the resolved rows below ``path``, which must be new."""
    resolved.select(as_record(date).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        if name.endswith("-Base64"):
            name, value = name[:-7], base64.b64decode(value).decode("utf-8")
        out[name] = value
    return out


def _page(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number not in ("", "null") else None


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of an archive, as FIELDS. Each is cut by its length, so that
    payloads may hold anything; a response's digest is taken from its payload anew."""
    data, at = gzip.decompress(archive), 0
    while at < len(data):
        if not data.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at byte {at}")
        head = data.index(END.encode(), at)
        h = _headers(data[at:head])
        start = head + len(END)
        at = start + int(h["Content-Length"])
        cut = data.index(END.encode(), start, at) + len(END)
        n_bytes = int(_headers(data[start:cut - len(END)])["Content-Length"])
        payload, digest = None, h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response":
            payload = data[cut:at]
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if own != digest or len(payload) != n_bytes:
                raise ValueError(f"damaged record {h['WARC-Record-ID']}")
        yield (_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), n_bytes, digest,
               h["WARC-Type"], _page(h.get("WARC-Refers-To")), payload)
        at += len(END)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, as FIELDS."""
    schema = FIELDS if payloads else FIELDS.rpartition(",")[0]
    names = [f.split()[0] for f in schema.split(", ")]

    def records(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = pd.DataFrame([r[:len(names)] for r in parse(bytes(content))], columns=names, dtype=object)
                yield rows

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(records, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(resolve(read_table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path, payloads=False)


# base 32 of 20 bits: 4 digits of the alphabet
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::BIGINT "
    f">> {15 - 5 * (i % 4)}) & 31)::INT, 1)" for i in range(32))
SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, url, strlen(payload) AS payload_bytes, {_B32} AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN g USING (payload_digest)
"""
