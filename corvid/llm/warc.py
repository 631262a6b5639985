"""WARC archives with a merged capture index (operator 1).

Writing: payload digests decide, per group of equal payloads, which page is the
response; the others become revisit records that name it.  Each task streams
its records into gzip-member archives in the shared folder and sorts its index
entries into bounded runs by URL key and capture time.  Merging: the runs are
range-partitioned by (URL key, time, page, run, place in the run) and in each range a k-way loser tree
merges the slices of all runs, so the partitions in order hold the globally
ordered capture histories.  Reading: index entries are grouped by archive and
every record is read by its offset, unpacked, parsed and its digest checked.

The committed index names only archives of tasks that finished; a retried task
leaves at most an unnamed file.  A hot digest (copies) meets a join whose other
side has one row per digest, which adaptive execution splits; hosts and URLs
spread because time and page id are part of the range key.

Edge cases: a null html is the empty payload; a null URL has the empty key and
no target line; a null page_id is never referred to (a group of equal payloads
with null ids alone is all responses); rows that repeat the largest page_id are
all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import materialise, shared_path, shuffle_parts, small_batches, text_of

INDEX_SCHEMA = ("run string, pos long, urlkey string, captured long, page_id long, url string, "
                "record_type string, file string, offset long, length long")
RUN_ROWS = 50_000
FILE_BYTES = 512 << 20
MERGE_ROWS = 100_000

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels from the top level down, then the path;
    scheme, ``www.`` and fragment do not count."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             "WARC-Date: " + (_EPOCH + timedelta(seconds=captured)).strftime("%Y-%m-%dT%H:%M:%SZ"),
             f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of one record; the
    payload of a response is measured and its digest checked."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = warc["warc-record-id"][len("<urn:page:"):-1]
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "revisit":
        size, refers = int(_headers(http)["content-length"]), int(warc["warc-refers-to"][len("<urn:page:"):-1])
    else:
        size, refers = len(payload), None
        if digest_of(payload) != digest or len(rest) != int(warc["content-length"]) + 4:
            raise ValueError(f"record of page {page} is damaged")
    return (int(page) if page else None), size, digest, warc["warc-type"], refers


class LoserTree:
    """Merges sorted lists; each step replays one path of about log2(k) games."""

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:                       # first visit while the tree is built
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while True:
            top = self.losers[0]
            value = self.head[top]
            if value is None:
                return
            yield value
            self.head[top] = next(self.runs[top], None)
            self._replay(top)


def with_roles(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Add ``refers_to``: the largest page_id with the same payload, null where
    that is the row's own or the payload is below ``min_payload`` bytes."""
    body = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"),
                          F.octet_length("html").alias("size")) \
        .filter(F.col("size") >= min_payload).groupBy("digest") \
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "kept")
    # written first: adaptive execution can split a hot digest only where both
    # sides of the join come straight from a shuffle
    groups = materialise(groups, "payload-groups")
    joined = body.join(groups, "digest", "left")
    own = F.col("kept").isNull() | F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", "captured", F.when(~own, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   captured: str | None = None, min_payload: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives; return the committed index runs.

    ``captured`` names a column of epoch seconds; without one, captures are a
    second apart from 2020-01-01 in the order of their ids."""
    spark = pages.sparkSession
    small_batches(spark)
    root = folder or shared_path(spark, "warc")
    when = F.col(captured).cast("long") if captured else F.lit(1577836800) + F.pmod(F.col(id_col).cast("long"), F.lit(10 ** 9))
    rows = with_roles(pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        text_of(html_col).alias("html"), F.coalesce(when, F.lit(1577836800)).alias("captured")), min_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, path = pafs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        out, uri, at, files, runs, entries = None, "", 0, 0, 0, []

        def sorted_run() -> pa.RecordBatch:
            nonlocal runs, entries
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            name = f"{part:06d}-{runs:04d}-{attempt}"
            cols = [[name] * len(entries), list(range(len(entries))), *map(list, zip(*entries))]
            runs, entries = runs + 1, []
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                     pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                              [f.split()[0] for f in INDEX_SCHEMA.split(", ")])

        for batch in batches:
            for page, url, html, sec, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    uri, at = f"{root}/part-{part:06d}-{files:04d}-{attempt}.warc.gz", 0
                    out, files = pafs.FileSystem.from_uri(uri)[0].open_output_stream(
                        pafs.FileSystem.from_uri(uri)[1], compression=None), files + 1
                member = record(page, url, sec, html.encode("utf-8"), refers)
                out.write(member)
                entries.append((url_key(url), sec, page, url, "response" if refers is None else "revisit",
                                uri, at, len(member)))
                at += len(member)
            if len(entries) >= RUN_ROWS:
                yield sorted_run()
        if out:
            out.close()
        if entries:
            yield sorted_run()

    return materialise(rows.mapInArrow(run, INDEX_SCHEMA), "warc-runs")


def merge_index(runs: DataFrame) -> DataFrame:
    """Globally ordered capture histories from locally sorted runs: ``range``
    numbers the key ranges, ``place`` the entries in each."""
    spark = runs.sparkSession
    ranges = max(shuffle_parts(spark), -(-runs.count() // MERGE_ROWS))
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)                   # one range: about MERGE_ROWS slim entries
        if not held:
            return
        t = pa.Table.from_batches(held)
        run, pages = t["run"].to_pylist(), t["page_id"].to_pylist()
        keys = list(zip(t["urlkey"].to_pylist(), t["captured"].to_pylist(),
                        [p is not None for p in pages], [p or 0 for p in pages], range(len(run))))
        cuts = [0] + [i for i in range(1, len(run)) if run[i] != run[i - 1]] + [len(run)]
        order = [k[-1] for k in LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])])]
        n = len(order)
        t = t.take(order).append_column("range", pa.array([TaskContext.get().partitionId()] * n, pa.int32())) \
            .append_column("place", pa.array(range(n), pa.int64()))
        yield from t.combine_chunks().to_batches()

    # run and place in it spread entries of one key; the merge keeps their order too
    return runs.select(names).repartitionByRange(ranges, "urlkey", "captured", "page_id", "run", "pos") \
        .sortWithinPartitions("run", "pos").mapInArrow(merge, INDEX_SCHEMA + ", range int, place long")


def read_archives(index: DataFrame) -> DataFrame:
    """Read every indexed record back from its archive."""
    n = shuffle_parts(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None
        for batch in batches:
            out = []
            for file, offset, length, key in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    store, path = pafs.FileSystem.from_uri(file)
                    source, name = store.open_input_file(path), file
                out.append((*parse(source.read_at(length, offset)), key))
            cols = list(zip(*out)) if out else [[] for _ in range(6)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey"])

    # archives are of bounded size; offsets keep the entries of a large one apart
    step = F.floor(F.col("offset") / F.lit(64 << 20))
    return index.select("file", "offset", "length", "urlkey").repartition(n, "file", step) \
        .sortWithinPartitions("file", "offset") \
        .mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                         "refers_to long, urlkey string")


def oracle() -> str:
    """DuckDB SQL of the archives' contents over the table pages.  Five hexadecimal
    digits of a SHA-1 are four base32 characters."""
    chunk = "CAST('0x' || substr(sha1(payload), {at}, 5) AS BIGINT)"
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({chunk} >> {shift}) & 31) + 1 AS BIGINT), 1)"
    base32 = " || ".join(letter.format(chunk=chunk.format(at=5 * i + 1), shift=shift) for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH paid AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
told AS (SELECT page_id, octet_length(payload) AS payload_bytes, {base32} AS payload_digest,
                max(page_id) OVER (PARTITION BY payload) AS last_id FROM paid)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM told"""
