"""Operator 5, WARC archives with an external merge of their indexes.

Writing: a task buffers captures up to run_bytes, sorts them by URL key and timestamp and writes one .warc.gz (a gzip
member a record) and its index, a sorted run.  Merging: the key space is cut into ranges at quantiles of the runs' sampled
keys; for each range a task reads that slice of every run and merges the k slices with a loser tree, which gives capture
histories in global order.  Reading: records are fetched in index order; a range's records of one file lie together.

Payloads of at least min_revisit_bytes that are equal, by SHA-1, become one response, that of the largest id, and
revisit records that refer to it.
Merging and reading hold a piece of every run and some 16 MB of records at a time, so a very long payload costs its own
size and a long history no more than a short one.
Nulls: null html is an empty payload; a null url has an empty key and no target; rows with a null id revisit others but are
themselves referred to only as null.  Repeated rows get a record each, under one record id, which names the page; repeats of the largest id are all responses.
Payloads of exactly min_revisit_bytes count as long enough.  Captures of one key and time keep the order of their runs.
Other columns are not written.
Without a timestamp column the capture time is the epoch plus the id in seconds.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import read_blob, write_blob
from .scratch import broadcast_if_small, materialise, scratch_dir, shuffle_partitions

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
SAMPLE = 256
PIECE, PIECES = 1 << 20, 16 << 20
ID_SPACE, NULL_SPACE = 0x5EED0000_0000_4000, 0x5EED0000_0000_4001
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly URL: host labels reversed, lower case, then ')' and path and query; no scheme, user or fragment."""
    m = re.match(r"(?s)(?:[^:/?#]*://)?(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url or "")
    host = m[1].lower()
    return re.sub(r"[\x00-\x20]", "_", ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")) if host else ""


def stamp(seconds: int) -> str:
    return (EPOCH + timedelta(seconds=max(0, min(seconds, 253402300799)))).strftime("%Y%m%d%H%M%S")


def record_id(page: int | None) -> str:
    high, low = (NULL_SPACE, 0) if page is None else (ID_SPACE, page & (1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record[10:-1]).int
    low = value & (1 << 64) - 1
    return None if value >> 64 == NULL_SPACE else low - (1 << 64) if low >> 63 else low


def warc_record(page, url, seconds, payload: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    when = (EPOCH + timedelta(seconds=max(0, min(seconds, 253402300799)))).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises if a response's payload does not have the digest it names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise OSError("payload differs from its digest: " + fields["WARC-Record-ID"])
    return {
        "id": page_of(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
        "target_uri": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
    }


class LoserTree:
    """Merge of k sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)
        winner = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winner[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def __iter__(self):
        k = len(self.runs)
        while k and self.heads[self.losers[0]] is not None:
            top = self.losers[0]
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            node = (top + k) // 2
            while node:
                if self._before(self.losers[node], top):
                    self.losers[node], top = top, self.losers[node]
                node //= 2
            self.losers[0] = top


RUN = "archive string, run string, samples array<string>, offsets array<long>"


def write_archives(
    pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, ts_col: str | None, min_revisit_bytes: int, run_bytes: int
) -> DataFrame:
    """Write archives and runs in folder; the result, to be written, has a row for each run."""
    seconds = F.unix_seconds(F.col(ts_col).cast("timestamp")) if ts_col else F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(seconds, F.lit(0)).alias("seconds"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("response_id"), F.count("*").alias("n"))
    copies = materialise(copies.where("n > 1 and response_id is not null").select(F.col("digest").alias("copied"), "response_id"), "copied-payloads")
    rows = rows.join(broadcast_if_small(copies, 200_000), F.col("digest") == F.col("copied"), "left").drop("copied")

    def write(batches):
        held, size = [], 0

        def flush():
            held.sort(key=lambda x: x[:2])
            body, index, at = [], [], 0
            for key, ts, record in held:
                z = zlib.compressobj(1, wbits=31)
                data = z.compress(record) + z.flush()
                body.append(data)
                index.append((key, ts, at, len(data)))
                at += len(data)
            archive = write_blob(folder, b"".join(body), ".warc.gz")
            lines = [f"{key} {ts} {json.dumps({'filename': archive, 'offset': at, 'length': n})}\n".encode() for key, ts, at, n in index]
            run = write_blob(folder, b"".join(lines), ".cdxj")
            ends, samples, offsets = 0, [], []
            for i, line in enumerate(lines):
                if i % SAMPLE == 0:
                    samples.append(f"{index[i][0]} {index[i][1]}")
                    offsets.append(ends)
                ends += len(line)
            return pa.RecordBatch.from_pydict({"archive": [archive], "run": [run], "samples": [samples], "offsets": pa.array([[*offsets, ends]], pa.list_(pa.int64()))})

        for batch in batches:
            for page, url, s, data, digest, response in zip(*[c.to_pylist() for c in batch.columns]):
                revisit = response is not None and page != response
                record = warc_record(page, url, s, data, digest, revisit, response)
                held.append((url_key(url), stamp(s), record))
                size += len(record)
                if size >= run_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(write, RUN)


def merge_index(runs: DataFrame, parts: int) -> DataFrame:
    """(part, seq, url_key, timestamp, filename, offset, length): capture histories, ordered by part and seq."""
    samples = runs.select(F.explode("samples").alias("s")).repartitionByRange(parts, "s")
    cuts = samples.groupBy(F.spark_partition_id().alias("p")).agg(F.min("s").alias("s")).select("s")
    cuts = sorted(r[0] for r in cuts.collect())[1:]  # at most parts - 1 keys

    def slices(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for j in range(len(cuts) + 1):
                    # blocks that may hold keys from the cut before to the next; the merge drops what lies outside
                    a = max(bisect_left(r["samples"], cuts[j - 1]) - 1, 0) if j else 0
                    b = bisect_right(r["samples"], cuts[j]) if j < len(cuts) else len(r["samples"])
                    if b > a:
                        out.append((j, r["run"], r["offsets"][a], r["offsets"][b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, [pa.int32(), pa.string(), pa.int64(), pa.int64()])], names=["part", "run", "a", "b"])

    def merge(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = cuts[part - 1] if part else "", cuts[part] if part < len(cuts) else None

                def entries(s):
                    rest, at = b"", s["a"]
                    while at < s["b"]:  # a run's slice is read piece by piece
                        data = rest + read_blob(s["run"], at, min(PIECE, s["b"] - at))
                        at = min(at + PIECE, s["b"])
                        *lines, rest = data.split(b"\n")
                        for line in lines:
                            key, ts, place = line.decode().split(" ", 2)
                            if low <= f"{key} {ts}" and (high is None or f"{key} {ts}" < high):
                                yield key, ts, place

                rows = []
                for seq, (key, ts, place) in enumerate(LoserTree([entries(s) for s in sorted(found, key=lambda s: s["run"])])):
                    at = json.loads(place)
                    rows.append((part, seq, key, ts, at["filename"], at["offset"], at["length"]))
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], names=["part", "seq", "url_key", "timestamp", "filename", "offset", "length"])

    dealt = runs.select("run", "samples", "offsets").mapInArrow(slices, "part int, run string, a long, b long")
    grouped = dealt.groupBy("part").agg(F.collect_list(F.struct("run", "a", "b")).alias("slices"))
    return grouped.mapInArrow(merge, "part int, seq long, url_key string, timestamp string, filename string, offset long, length long")


def read_archives(index: DataFrame, id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """The records that a merged index names, in its order inside each of its partitions."""

    def read(batches):
        for batch in batches:
            # as many entries at a time as PIECES bytes of archive hold, and one at least
            ends = np.cumsum(batch.column(batch.schema.get_field_index("length")).to_numpy())
            a = 0
            while a < len(ends):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECES, "right")))
                yield records_of(batch.slice(a, b - a))
                a = b

    def records_of(batch):
        entries = batch.to_pylist()
        by_file: dict = {}
        for i, e in enumerate(entries):
            by_file.setdefault(e["filename"], []).append((e["offset"], e["length"], i))
        records: list = [None] * len(entries)
        for name, places in by_file.items():
            places.sort()
            k = 0
            while k < len(places):
                # records side by side are one read, up to PIECES bytes
                m, stop = k + 1, places[k][0] + places[k][1]
                while m < len(places) and places[m][0] <= stop + 65536 and stop - places[k][0] < PIECES:
                    stop = max(stop, places[m][0] + places[m][1])
                    m += 1
                data = read_blob(name, places[k][0], stop - places[k][0])
                for offset, length, i in places[k:m]:
                    records[i] = parse_record(zlib.decompress(data[offset - places[k][0] :][:length], wbits=31))
                    if not with_payload:
                        records[i]["payload"] = None
                k = m
        columns = {
            id_col: pa.array([r["id"] for r in records], pa.int64()),
            "payload_bytes": pa.array([r["payload_bytes"] for r in records], pa.int64()),
            "payload_digest": pa.array([r["payload_digest"] for r in records], pa.string()),
            "record_type": pa.array([r["record_type"] for r in records], pa.string()),
            "refers_to": pa.array([r["refers_to"] for r in records], pa.int64()),
            "url_key": batch.column(2),
            "timestamp": batch.column(3),
        }
        if with_payload:
            columns["payload"] = pa.array([r["payload"] for r in records], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    schema = f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string"
    dealt = index.repartitionByRange(shuffle_partitions(index.sparkSession), "part", "seq").sortWithinPartitions("part", "seq")
    return dealt.mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def archive(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ts_col: str | None = None,
    min_revisit_bytes: int = 1000,
    run_bytes: int = 32 << 20,
    with_payload: bool = False,
) -> DataFrame:
    """Write pages to archives in the shared scratch folder, merge the indexes and read the records back."""
    folder = scratch_dir(pages.sparkSession, "warc")
    runs = materialise(write_archives(pages, folder, id_col, url_col, html_col, ts_col, min_revisit_bytes, run_bytes), "warc-runs")
    index = materialise(merge_index(runs, shuffle_partitions(pages.sparkSession)), "warc-index")
    return read_archives(index, id_col, with_payload)
