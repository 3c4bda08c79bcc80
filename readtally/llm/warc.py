"""WARC archives: writing, reading and a merged index of captures.

Writing: each page becomes a WARC/1.1 record whose HTTP message carries the page in UTF-8. Of pages with equal payloads
the one with the smallest page_id is the response, the others are revisits that refer to it and repeat length and digest
of the payload, not the payload. Spark's text writer puts the records into gzip files in any store it can write, with
the blank lines that end a record as separator, under its commit protocol.

Reading: files are framed by Content-Length, so payloads may hold anything. Each file gives a run of index entries that
is sorted by URL key, time and page. Runs meet again in ranges of these; the shuffle keeps the order of what one task sends, so a range
receives sorted sections, and a loser tree merges these k sections. Where a section should come out of order, it is taken for
two. Ranges and rows inside them are in order, so the capture histories are ordered over all ranges; a URL with very many
captures spans several ranges. A merging task holds one range of about ``RANGE_ROWS`` narrow entries.

Edge cases: a null html is an empty payload; an empty payload is deduplicated like any other from ``least_bytes``
= 0 on; a null URL has an empty key; line breaks in URLs are percent-coded; repeated page rows give records of their own, and all
rows with the group's smallest page_id are responses. Pages without an id refer to nothing known and are referred to as
none. An empty table writes no record and reads none. A very long page is one record of one file, which is read whole by a task. Pages have no
capture time, so it is derived from page_id. Offsets are those in the uncompressed archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtally.llm.shared import shared_dir, small, stored

CRLF = "\r\n"
#: Bytes of pages in a file, on average, and most records.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 2_000
#: Index entries that a merging task holds, on average.
RANGE_ROWS = 200_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ENTRY = "page_id long, url_key string, capture_time string, record_type string, payload_bytes long, payload_digest string, refers_to long, run string, offset long, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its hexadecimal form: 5 digits are 20 bits are 4 letters."""
    code = lambda i: F.conv(F.substring(F.sha1(payload), i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda v, s: F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(F.array(*[code(i) for i in range(8)]), lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])), "")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page: value, the text of its WARC record without the closing blank lines."""
    html = F.coalesce("html", F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha1(html).alias("sha1"))
    groups = base.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("c"), F.min("page_id").alias("first"))
    groups = stored(groups.where("c > 1").select(F.unhex("sha1").alias("_sha1"), "first"), "payloads")
    base = base.join(small(groups), F.unhex("sha1") == F.col("_sha1"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("n"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), time),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    head_block = F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF), head)
    return base.select(F.concat(head_block, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    most = max(1, min(records_per_file, int(FILE_BYTES / max(mean, 1))))
    records(pages, least_bytes).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query, lower-cased; the scheme, a leading www and the fragment don't count."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    return (",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path.rstrip("/") or "/") + (f"?{u.query}" if u.query else "")).lower()


def frames(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, header fields and block of each record of an uncompressed archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin, n = end + 4, int(fields["Content-Length"])
        yield at, fields, view[begin : begin + n]
        at = begin + n + 4


def _page(name: str | None) -> int | None:
    value = (name or "none")[len("<urn:page:") : -1] if name else "none"
    return None if value == "none" else int(value)


def _gunzip(data: bytes) -> bytes:
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted run of index entries for each archive."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            run, rows = path.as_py().rsplit("/", 1)[-1], []
            for offset, fields, block in frames(_gunzip(content.as_py())):
                raw = bytes(block)
                cut = raw.index(b"\r\n\r\n")
                http = dict(x.split(": ", 1) for x in raw[:cut].decode().split(CRLF)[1:])
                payload, kind = raw[cut + 4 :], fields["WARC-Type"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http["Content-Length"])
                intact = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                rows.append((_page(fields["WARC-Record-ID"]), url_key(fields.get("WARC-Target-URI", "")), fields["WARC-Date"], kind, size, digest, _page(fields.get("WARC-Refers-To")), run, offset, intact))
            rows.sort(key=_place)
            if rows:
                yield _entries(rows)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [x.strip().split(" ")[0] for x in _ENTRY.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def loser_tree(runs: list[list], key) -> Iterator:
    """Merges sorted lists. Inner nodes hold the loser of the match below them; the winner of all is at the top, and
    replacing it replays only its own path."""
    k = len(runs)
    at = [0] * k
    keys = [(0, key(r[0]), i) if r else (1, None, i) for i, r in enumerate(runs)]
    less = lambda a, b: keys[a][0] < keys[b][0] or (keys[a][0] == keys[b][0] and (keys[a][0] == 1 or keys[a][1:] < keys[b][1:]))
    tree = [-1] * max(k, 1)
    for i in range(k):  # play every leaf up to the first empty node
        winner, node = i, (i + k) // 2
        while node > 0 and tree[node] >= 0:
            if less(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[node if node > 0 else 0] = winner
    while k:
        w = tree[0]
        if keys[w][0]:
            return
        yield runs[w][at[w]]
        at[w] += 1
        keys[w] = (0, key(runs[w][at[w]]), w) if at[w] < len(runs[w]) else (1, None, w)
        node = (w + k) // 2
        while node > 0:
            if less(tree[node], w):
                tree[node], w = w, tree[node]
            node //= 2
        tree[0] = w


def _place(row: tuple) -> tuple:
    return row[1], row[2], row[0] is not None, row[0] or 0, row[8]


def _sections(batches: Iterator[pa.RecordBatch]) -> list[list[tuple]]:
    """The rows of a range as sorted lists: those of one run, as far as they came in order."""
    done: list[list[tuple]] = []
    open_runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            run = open_runs.get(row[7])
            if run is None or _place(row) < _place(run[-1]):
                run = open_runs[row[7]] = []
                done.append(run)
            run.append(row)
    return done


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sections of a range merged by URL key, time and page."""
    out = []
    for row in loser_tree(_sections(batches), _place):
        out.append(row)
        if len(out) == 10_000:
            yield _entries(out)
            out = []
    if out:
        yield _entries(out)


def read(spark, path: str) -> DataFrame:
    """Index entries of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse, _ENTRY)


def checked(entries: DataFrame) -> DataFrame:
    """A revisit is intact only if a response of the page it refers to has its payload's length and digest."""
    responses = entries.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    same = F.col("refers_to").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    revisits = entries.where("record_type = 'revisit'").join(responses, same, "left")
    revisits = revisits.withColumn("intact", F.col("intact") & F.col("_digest").isNotNull())
    return entries.where("record_type <> 'revisit'").unionByName(revisits.select(entries.columns))


def capture_index(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Entries in the order of URL key, time and page over all partitions."""
    entries = stored(entries, "runs")
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // range_rows))
    return entries.repartitionByRange(n, "url_key", "capture_time", "page_id", "offset").mapInArrow(_merge, _ENTRY)


def op10(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    out = checked(capture_index(read(spark, path)))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


_VALUE = "CAST('0x' || substr(x, {at}, 5) AS INTEGER)"
_LETTERS = " || ".join(f"substr('{_BASE32}', (({_VALUE.format(at=5 * i + 1)} >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS intact
FROM p JOIN f USING (x)
"""
