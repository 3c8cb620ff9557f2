"""WARC archives: written and read back by Spark, and one ordered index of their captures by external merging.

Pages become WARC/1.1 records (a response with an HTTP block, or a revisit
without payload) in the files of a text table whose line separator is the
end-of-record mark.  Reading parses every archive by its Content-Length
headers into a run of captures sorted by URL key, timestamp and page.  The runs are written, split at common bounds
of the key (from a bounded sample of keys), and each range is merged from the runs' slices by a
tree of losers, so the ranges in turn are one globally ordered capture history.  The key holds the page, so a URL that
a third of all captures share is split over ranges too.

Cases: a null or empty html is an empty payload; a null url has no target URI and sorts first; a null page_id
is always a response; page_ids of any size and sign have a date and a place; URLs come back as they were; rows that repeat a page_id and its payload are written each and, as the
largest, are all responses; an empty table gives an empty result; other columns aren't archived.
"""

from __future__ import annotations

import hashlib
import math
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygeia.llm.common import Scratch, range_block, shuffle_partitions

#: Payloads shorter than this are always stored.
REVISIT_BYTES = 1000
#: About so many bytes of payload in an archive file.
ARCHIVE_BYTES = 32 << 20
EPOCH = 1_704_067_200  # 2024-01-01: captures are dated one second a page from here,
SPAN = 1_000_000_000  # and from here again after so many pages: any page_id has a date of four-digit year
RANGE_ROWS = 20_000
END = "\r\n\r\n"
WHOLE_URI = "X-Target-URI-Hex"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURE = ("key string, run string, place bigint, url_key string, timestamp string, page_id bigint, url string, "
            "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
            "offset bigint, length bigint, intact boolean")


def write_archives(pages: DataFrame, work: Scratch, name: str = "archives") -> str:
    """Writes one record per row of ``pages`` (page_id, url, html); returns the folder."""
    payload = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("html"))
    facts = work.table(p.select("page_id", F.octet_length("html").cast("bigint").alias("n"),
                                F.sha1(F.encode("html", "UTF-8")).alias("digest")), "digests")
    large = facts.where(F.col("n") >= REVISIT_BYTES)
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")) \
        .where("refers_to <> least").select("digest", "refers_to")
    # only pages that revisit another: the join below sees the written size of this table
    again = work.table(large.join(last, "digest").where("page_id <> refers_to")
                       .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")
    mean = facts.agg(F.coalesce(F.avg("n"), F.lit(1.0))).first()[0]
    digest = F.sha1(F.encode("html", "UTF-8"))
    r = p.withColumn("_sha1", digest).join(again, (F.col("page_id") == F.col("_page")) & (F.col("_sha1") == F.col("_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # a header can't hold a line end: such a URL stands escaped for readers, and whole in a header of its own
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    whole = F.when(F.col("url").rlike("[\r\n]"), F.concat(F.lit(f"{WHOLE_URI}: "), F.hex(F.encode("url", "UTF-8")), F.lit("\r\n")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.coalesce(whole, F.lit("")), F.lit("WARC-Date: "), when, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_sha1"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to"),
                                 F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END))
    path = work.path(name)
    (r.select(F.concat(head, block).alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (mean + 600)))).text(path))
    work.drop("digests")
    return path


def url_key(url: str | None) -> str:
    """Sorting form of a URL: host labels reversed, lower case, no scheme, default port, "www." or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    labels = ",".join(reversed(host.split(".")))
    tail = f":{port}" if port and port not in (80, 443) else ""
    return f"{labels}{tail}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def parse(content: bytes):
    """(headers, offset, length, payload) of each record of an archive."""
    at, n = 0, len(content)
    while at < n:
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = stop + 4
        end = start + int(head["Content-Length"])
        block = content[start:end]
        cut = block.index(b"\r\n\r\n") + 4
        size = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
        yield head, size, at, end - at, block[cut:]
        at = end + 4


def _runs(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for head, size, offset, length, payload in parse(content.as_py()):
                page = head["WARC-Record-ID"][len("<urn:page:"):-1]
                refers = head.get("WARC-Refers-To")
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                stored = head["WARC-Type"] == "response"
                uri = head.get("WARC-Target-URI")
                if WHOLE_URI in head:
                    uri = bytes.fromhex(head[WHOLE_URI]).decode()
                stamp = re.sub(r"\D", "", head["WARC-Date"])
                key = url_key(uri)
                rows.append((f"{key} {stamp} {(int(page) if page else 0) + 2**63:020d}", key, stamp, int(page) if page else None, uri,
                             size, digest, head["WARC-Type"], int(refers[len("<urn:page:"):-1]) if refers else None, offset,
                             length, not stored or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)))
            rows.sort(key=lambda r: r[0])
            name = path.rsplit("/", 1)[-1]
            cols = list(zip(*rows)) if rows else [()] * 12
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                     pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            c = [pa.array(x, t) for x, t in zip(cols, kinds)]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([c[0], pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), *c[1:]],
                                             names=[x.split()[0] for x in _CAPTURE.split(", ")])


def losers(runs: list[list[str]]):
    """(run, place) of all keys of sorted ``runs``, in order: a tree of losers, one comparison a level and step."""
    k = max(1, len(runs))
    at = [0] * len(runs)

    def less(a: int, b: int) -> bool:
        """Does run a's next key come before run b's (an ended run is last; equal keys by run)?"""
        if a < 0 or b < 0:
            return b < 0 <= a
        ra, rb = at[a] < len(runs[a]), at[b] < len(runs[b])
        if not (ra and rb):
            return ra and not rb
        return (runs[a][at[a]], a) < (runs[b][at[b]], b)

    size = 1 << (k - 1).bit_length()
    win = [0] * size + [i if i < len(runs) else -1 for i in range(size)]
    lost = [-1] * size
    for i in range(size - 1, 0, -1):
        a, b = win[2 * i], win[2 * i + 1]
        win[i], lost[i] = (b, a) if less(b, a) else (a, b)
    best = win[1]
    while best >= 0 and best < len(runs) and at[best] < len(runs[best]):
        yield best, at[best]
        at[best] += 1
        i = (size + best) // 2
        while i:
            if less(lost[i], best):
                best, lost[i] = lost[i], best
            i //= 2


def _merge(t: pa.Table) -> pa.Table:
    by: dict[str, list[int]] = {}
    place = t["place"].to_pylist()
    for row, run in enumerate(t["run"].to_pylist()):
        by.setdefault(run, []).append(row)
    keys = t["key"].to_pylist()
    rows = [sorted(r, key=place.__getitem__) for _, r in sorted(by.items())]
    order = [rows[run][i] for run, i in losers([[keys[i] for i in r] for r in rows])]
    merged = t.take(pa.array(order, pa.int64()))
    return merged.append_column("history", pa.array(range(len(order)), pa.int64()))


def capture_index(spark, path: str, work: Scratch) -> DataFrame:
    """One row per record of the archives in ``path``; (part, history) is the global order by key and timestamp."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = work.table(files.mapInArrow(_runs, _CAPTURE), "runs")
    n = runs.count()
    ranges = max(1, min(shuffle_partitions(spark), n), math.ceil(n / RANGE_ROWS))
    part = max(1, n // (100 * ranges))
    sample = sorted(r["key"] for r in runs.where(F.pmod(F.xxhash64("key", "run", "place"), F.lit(part)) == 0).select("key").collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    dealt = runs.withColumn("part", range_block("key", bounds, "string").cast("int"))
    return dealt.groupBy("part").applyInArrow(_merge, f"{_CAPTURE}, part int, history bigint")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns the merged capture index."""
    work = Scratch(pages.sparkSession, "warc")
    return capture_index(pages.sparkSession, write_archives(pages, work), work)
