"""WARC archives: revisit-aware writing, and a reader that salvages damaged files.

Writing is one text write: a row is a record, the separator that WARC asks for after a record is
the line separator, so any filesystem Spark knows takes the files and a lost task is just rerun.
Records whose payloads are equal (same length and SHA-1) and at least `min_bytes` long are stored
once: the one with the largest id is the response, the others are revisits that name it.

Reading goes through a file from valid record to valid record. A record must have a version line,
headers, a length that fits, the closing blank lines and, where it states one, the right block
digest. After a failed check the reader looks for the next version line (or, in compressed files,
the next member) at which a whole record is valid, goes on from there, and logs the bytes between
as a quarantined gap with the reason. A damaged record costs itself and nothing behind it. Compressed
archives are written with one member per record. Of a foreign member that holds many records and is
broken, those before the damage whose blocks fit their digests are kept, with the reason "head of a
broken member"; the gap of the member's bytes is logged as well.

Edge cases: a null payload is empty; equal rows with the same largest id are all responses; a row
without an id is a response and nothing refers to it. Control characters and spaces of a url are
percent-encoded, a null url is left out. An empty table gives no records, an empty file no rows.
Extra columns are not archived. A file is read by one task, so the writer bounds files by bytes: records are written
by classes of size, each with as many to a file as `FILE_BYTES` hold, and the largest class one by one.
"""

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.scratch import materialize

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bounds what one task reads at a time, unless a single record is larger.
FILE_BYTES = 128 << 20
#: Largest payload of each class of records but the last, with its records per file.
CLASSES = [(1 << 14, FILE_BYTES >> 15), (1 << 18, FILE_BYTES >> 19), (1 << 22, FILE_BYTES >> 23)]
#: Largest table of repeated payloads that is sent to every executor, in rows of about 100 bytes.
BROADCAST_ROWS = 200_000
BATCH_BYTES = 8 << 20

RECORDS = (
    "path string, offset long, length long, kind string, reason string, record_type string, "
    "record_id string, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes long, payload binary"
)
COLUMNS = [x.split()[0] for x in RECORDS.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: 5 hex digits at a time are 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _class_of(size: Column) -> Column:
    """Place of the size in CLASSES, or behind them."""
    return F.size(F.filter(F.array(*(F.lit(most) for most, _ in CLASSES)), lambda most: most < size))


def with_types(df: DataFrame, record_id: str, payload: str, min_bytes: int = 0) -> tuple[DataFrame, list[int]]:
    """Adds payload (never null), payload_bytes, payload_digest, record_type and refers_to; with the
    classes of size that occur."""
    text = F.coalesce(F.col(payload), F.lit(""))
    full = df.select(
        F.col(record_id).alias("record_id"),
        *(F.col(c) for c in df.columns if c == "url"),
        text.alias("payload"),
        F.octet_length(text).cast("long").alias("payload_bytes"),
        base32_sha1(text.cast("binary")).alias("payload_digest"),
    )
    # Payloads stay where they are: only ids, sizes and digests are written and grouped, and few
    # groups repeat.
    digests = materialize(full.select("record_id", "payload_digest", "payload_bytes"), "warc-digests")
    found = digests.select(_class_of(F.col("payload_bytes")).alias("k")).distinct()
    heads = materialize(
        digests.filter((F.col("payload_bytes") >= min_bytes) & F.col("record_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("record_id").alias("head"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "warc-heads",
    )
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    refers = F.when(F.col("record_id") < F.col("head"), F.col("head"))
    typed = (
        full.join(heads, ["payload_digest", "payload_bytes"], "left")
        .withColumn("refers_to", refers)
        .withColumn("record_type", F.when(refers.isNotNull(), "revisit").otherwise("response"))
        .drop("head")
    )
    return typed, sorted(r.k for r in found.collect())


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))


def _clean(url: Column) -> Column:
    """A url can't break out of its header line."""
    safe = F.replace(url, F.lit("\r"), F.lit("%0D"))
    return F.replace(F.replace(safe, F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))


def write_warc(
    df: DataFrame,
    path: str,
    record_id: str = "page_id",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "none",
) -> None:
    """One record per row; payloads are text, stored as UTF-8. compression: none or gzip."""
    typed, classes = with_types(df, record_id, payload, min_bytes)
    block = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    digest = F.when(F.col("refers_to").isNull(), F.col("payload_digest")).otherwise(base32_sha1(F.lit("").cast("binary")))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{CRLF}{name}: "), value.cast("string"))

    lines = [
        F.lit("WARC/1.1"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", _urn(F.col("record_id"))),
        header("WARC-Date", F.lit(date)),
        header("Content-Type", F.lit("text/html")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), digest)),
        header("X-Payload-Length", F.col("payload_bytes")),
        F.when(F.col("refers_to").isNull(), "").otherwise(
            header("WARC-Refers-To", _urn(F.col("refers_to")))
        ),
        F.coalesce(header("WARC-Target-URI", _clean(F.col("url"))), F.lit("")) if "url" in df.columns else F.lit(""),
        header("Content-Length", F.octet_length(block)),
        F.lit(CRLF + CRLF),
        block,
    ]
    value, sep = F.concat(*lines), CRLF + CRLF
    if compression == "gzip":
        value, sep = _member_of(F.concat(value, F.lit(sep))), MEMBER_END
    elif compression != "none":
        raise ValueError(f"compression is none or gzip: {compression}")
    typed = typed.withColumn("value", value)
    typed.limit(0).select("value").write.mode("overwrite").text(path)
    per_file = [*(n for _, n in CLASSES), 1]
    for k in classes:
        part = typed.filter(_class_of(F.col("payload_bytes")) == k).select("value")
        part.write.option("lineSep", sep).option("maxRecordsPerFile", per_file[k]).text(f"{path}/class={k}")


#: The last byte of a member is the high byte of its content's length: zero below 16 MiB. It is the
#: line separator of compressed archives; behind a longer record stands a member without content.
MEMBER_END = "\0"


def _member_of(record: Column) -> Column:
    """One gzip member per record, without its last byte."""

    @F.pandas_udf("binary")
    def compress(text: pd.Series) -> pd.Series:
        def member(t: str) -> bytes:
            data = gzip.compress(t.encode(), mtime=0)
            return (data if data[-1:] == b"\0" else data + gzip.compress(b"", mtime=0))[:-1]

        return text.map(member)

    return compress(record).cast("string")


VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")


def _record(data: bytes, at: int) -> tuple[int, dict] | str:
    """End and headers of the valid record that starts here, or why there is none."""
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers have no end"
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if stop > len(data):
        return "block is cut off"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "block has another length"
    kind, _, wanted = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and wanted:
        if base64.b32encode(hashlib.sha1(data[start:stop]).digest()).decode() != wanted.upper():
            return "block digest differs"
    return stop + 4, headers | {"_start": start, "_stop": stop}


def _row(path: str, offset: int, length: int, data: bytes, headers: dict, payloads: bool) -> tuple:
    block = data[headers["_start"] : headers["_stop"]]

    def urn(name: str) -> str | None:
        value = headers.get(name)
        return value and value.removeprefix("<").removesuffix(">").removeprefix("urn:record:")

    digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
    size = headers.get("x-payload-length", "") if headers.get("warc-type") == "revisit" else ""
    if headers.get("warc-type") == "response" and not headers.get("content-type", "").startswith("application/http"):
        digest = None  # The block is the payload: digest what was read back.
    return (
        path,
        offset,
        length,
        "record",
        None,
        headers.get("warc-type"),
        urn("warc-record-id"),
        urn("warc-refers-to"),
        headers.get("warc-target-uri"),
        digest.upper() if digest else base64.b32encode(hashlib.sha1(block).digest()).decode(),
        int(size) if size.isascii() and size.isdigit() else len(block),
        block if payloads else None,
    )


def _gap(path: str, offset: int, length: int, reason: str) -> tuple:
    return (path, offset, length, "gap", reason, *[None] * 7)


def _next_record(data: bytes, at: int) -> int:
    """The next place at which a whole record is valid, or the end."""
    for version in VERSION.finditer(data, at):
        if not isinstance(_record(data, version.start()), str):
            return version.start()
    return len(data)


def _plain(path: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        found = _record(data, at)
        if isinstance(found, str):
            stop = _next_record(data, at + 1)
            yield _gap(path, at, stop - at, found)
            at = stop
        else:
            yield _row(path, at, found[0] - at, data, found[1], payloads)
            at = found[0]


MEMBER = b"\x1f\x8b\x08"


STEP = 1 << 16


def _member(data: bytes, at: int) -> tuple[int | None, bytes]:
    """End and content of the compressed member that starts here. Where a checksum or the format
    doesn't hold there is no end, and the content is what came out before."""
    stream, view, parts, pos = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not stream.eof and pos < len(data):
            parts.append(stream.decompress(view[pos : pos + STEP]))
            pos = min(pos + STEP, len(data))
    except zlib.error:
        # The step that failed gives nothing: again byte by byte up to the damage.
        again = zlib.decompressobj(31)
        parts = [again.decompress(view[at:pos])]
        for i in range(pos, min(pos + STEP, len(data))):
            try:
                parts.append(again.decompress(view[i : i + 1]))
            except zlib.error:
                break
    return (pos - len(stream.unused_data) if stream.eof else None), b"".join(parts)


def _head(path: str, content: bytes, payloads: bool) -> Iterator[tuple]:
    """Records of a broken member that are whole and state the digest of their block."""
    at = 0
    while at < len(content):
        found = _record(content, at)
        if isinstance(found, str) or "warc-block-digest" not in found[1]:
            at = _next_record(content, at + 1)
        else:
            yield _row(path, at, found[0] - at, content, found[1], payloads)
            at = found[0]


def _members(path: str, data: bytes, payloads: bool) -> Iterator[tuple]:
    """Offsets and lengths are those of the member; records of one member share them."""
    at = 0
    while at < len(data):
        end, content = _member(data, at) if data.startswith(MEMBER, at) else (None, b"")
        if end is None:
            stop = data.find(MEMBER, at + 1)
            while stop >= 0 and _member(data, stop)[0] is None:
                stop = data.find(MEMBER, stop + 1)
            stop = len(data) if stop < 0 else stop
            for row in _head(path, content, payloads):
                yield (path, at, stop - at, "record", "head of a broken member", *row[5:])
            yield _gap(path, at, stop - at, "no valid member")
            at = stop
        else:
            for row in _plain(path, content, payloads):
                yield (path, at, end - at, *row[3:])
            at = end


def salvage(path: str, data: bytes, payloads: bool = True) -> Iterator[tuple]:
    """Rows of one file, records and gaps in file order; together they cover every byte."""
    packed = data[:2] == MEMBER[:2] or (path.endswith(".gz") and not VERSION.match(data)) or (
        not VERSION.search(data) and MEMBER in data
    )
    return (_members if packed else _plain)(path, data, payloads)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files under a path; see `RECORDS` for the columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for row in salvage(name, bytes(data), payloads):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"payload_bytes": "Int64"})


def gaps(rows: DataFrame) -> DataFrame:
    """The quarantine log: path, offset, length and reason of every gap."""
    return rows.filter("kind = 'gap'").select("path", "offset", "length", "reason")
