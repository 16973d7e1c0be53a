"""WARC archives of pages, their locally sorted capture runs, and the external merge of the runs."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.common import fresh_path, read_parts, released, slices, staged
from cipherlake.llm.storage import AtomicFile, file_size, make_dir, open_file, read_file, write_file

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Keys from which the merge ranges are chosen; a bound on what the driver gathers.
SAMPLE = 10_000
#: Runs that one merge task reads at a time; more runs are merged in several levels.
FAN_IN = 256
#: Captures between two entries of a run's sparse index.
SPARSE = 256
ENTRY = "surt string, stamp string, page_id long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, no scheme, www label, port 80 or 443, or fragment; null and host-free URLs keep their text."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    where = ",".join(reversed(labels)) + ("" if port in (None, 80, 443) else f":{port}")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: str) -> str:
    """A header value in one line."""
    return " ".join((text or "").split())


def build_record(kind: str, page_id: int | None, url: str | None, when: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: HTTP head and, for a response, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    name = hashlib.md5(f"{page_id}|{url}|{digest}".encode()).hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>", f"WARC-Date: {when}", f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page-Id: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; raises where lengths or the digest of a response don't hold."""
    top, _, rest = data.partition(b"\r\n\r\n")
    pairs = lambda x: {k.strip().lower(): v.strip() for k, _, v in (y.partition(":") for y in x.decode("utf-8").split("\r\n")[1:])}
    warc = pairs(top)
    n = int(warc["content-length"])
    block = rest[:n]
    if not top.startswith(b"WARC/1.") or len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    http = pairs(http)
    if warc["warc-type"] == "response" and (len(payload) != int(http["content-length"]) or "sha1:" + payload_digest(payload) != warc["warc-payload-digest"]):
        raise ValueError("payload doesn't match its digest")
    return warc, http, payload


class LoserTree:
    """Merges k sorted iterators with about log2(k) comparisons an item: inner nodes hold losers, the root the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        self.winner = -1
        for i in range(self.k):
            self._play(i, True)

    def _before(self, i: int, j: int) -> bool:
        """Whether run i's head goes before run j's; an exhausted run goes last, ties by run."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, i: int, setup: bool) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if setup and self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner, False)


def _pack(entry: tuple) -> bytes:
    key, stamp, page, file, offset, length = entry
    parts = [key.encode(), stamp.encode(), b"" if page is None else str(page).encode(), file.encode()]
    body = struct.pack("<4I2q", *map(len, parts), offset, length) + b"".join(parts)
    return struct.pack("<I", len(body)) + body


def _unpack(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        a, b, c, d, offset, length = struct.unpack_from("<4I2q", data, at + 4)
        p = at + 4 + 32
        page = data[p + a + b : p + a + b + c]
        yield data[p : p + a].decode(), data[p + a : p + a + b].decode(), int(page) if page else None, data[p + a + b + c : p + a + b + c + d].decode(), offset, length
        at += 4 + n


def _stream(path: str, start: int, end: int, step: int = 1 << 16) -> Iterator[tuple]:
    """Entries in a byte range of a run, read block by block."""
    f, rest = open_file(path), b""
    f.seek(start)
    while start < end or rest:
        data = rest + f.read(min(step, end - start)) if start < end else rest
        start = min(end, start + step)
        cut = 0
        while cut + 4 <= len(data) and cut + 4 + struct.unpack_from("<I", data, cut)[0] <= len(data):
            cut += 4 + struct.unpack_from("<I", data, cut)[0]
        yield from _unpack(data[:cut])
        rest = data[cut:]
        if start >= end and rest and not cut:
            raise ValueError("a run ends inside an entry")
    f.close()


def _order(entry: tuple) -> tuple:
    key, stamp, page, file, offset, length = entry
    return key, stamp, page is not None, page or 0, file, offset, length


def _restore(t: tuple) -> tuple:
    return t[0], t[1], t[3] if t[2] else None, t[4], t[5], t[6]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """Writes a gzip member for each page into one archive a task, with the task's captures as a locally sorted run; returns (run, keys).

    pages has page_id, url, html. Of pages with equal payloads of at least min_bytes bytes, the one
    with the smallest page_id is written as response, the others as revisits of it.
    """
    captured = captured if captured is not None else F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315_360_000)))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            data = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in data], pa.int64()), pa.array([payload_digest(x) for x in data])], names=[*batch.schema.names, "payload_bytes", "digest"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.date_format(captured, "yyyyMMddHHmmss").alias("stamp"))
    rows = rows.mapInArrow(digests, "page_id long, url string, html string, stamp string, payload_bytes long, digest string")
    small = staged(rows.select("page_id", "payload_bytes", "digest"), "digests")
    firsts = small.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = small.join(firsts, ["digest", "payload_bytes"]).where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, out, entries = TaskContext.get().partitionId(), None, []
        for batch in (part for whole in batches for part in slices(whole, "html")):
            for page, url, html, stamp, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "stamp", "digest", "refers_to"))):
                out = out or AtomicFile(f"{folder}/captures-{run:06d}.warc.gz")
                when = datetime.strptime(stamp, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if stamp else "1970-01-01T00:00:00Z"
                data = gzip.compress(build_record("response" if first is None else "revisit", page, url, when, (html or "").encode("utf-8", "surrogatepass"), digest, first), 6, mtime=0)
                entries.append((surt(url), stamp or "", page, f"captures-{run:06d}.warc.gz", out.write(data), len(data)))
        if out is None:
            return
        out.close()
        entries.sort(key=_order)
        f, marks = AtomicFile(f"{folder}/run-{run:06d}"), []
        for i, e in enumerate(entries):
            at = f.write(_pack(e))
            if i % SPARSE == 0:
                marks.append((e, at))
        f.close()
        sparse = b"".join(_pack((e[0], e[1], e[2], e[3], e[4], at)) for e, at in marks)
        write_file(f"{folder}/sparse-{run:06d}", struct.pack("<q", f.size) + sparse)
        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([len(entries)], pa.int64()), pa.array([[e[0] for e, _ in marks]], pa.list_(pa.string()))], names=["run", "n", "keys"])

    # A fixed order in each task: a second attempt writes the same archive, run and index.
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "stamp", "digest", "refers_to").sortWithinPartitions("page_id", "digest", "url")
    return staged(rows.mapInArrow(released(write), "run int, n long, keys array<string>"), "runs")


def merge_runs(runs: DataFrame, folder: str, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """K-way loser-tree merge of the runs by (URL key, timestamp): (range, seq, surt, stamp, page_id, file, offset, length) in global order of (range, seq).

    Key ranges are cut at quantiles of at most SAMPLE keys of the runs' sparse indexes; each merge
    task owns a range of up to fan_in runs and streams them block by block, at every level. Each
    run's sparse index is read once, for all ranges. All captures of a key stay in a range.
    """
    spark = runs.sparkSession
    ids = [r.run for r in runs.select("run").orderBy("run").collect()]  # one small row a run
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = runs.select(F.explode("keys").alias("key"))
    total = keys.count()
    sample = sorted({r.key for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // SAMPLE)))) == 0).limit(SAMPLE).collect()})
    cuts = [sample[i] for i in sorted({len(sample) * i // parts for i in range(1, parts)} - {0})] if sample else []

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of each run that hold each range, from its sparse index (whole blocks; ends are filtered later)."""
        for batch in batches:
            for r in batch.column("run").to_pylist():
                data = read_file(f"{folder}/sparse-{r:06d}")
                (size,) = struct.unpack_from("<q", data)
                marks = list(_unpack(data[8:]))
                names, at = [m[0] for m in marks], [m[5] for m in marks]
                lo = [0 if p == 0 else max(0, bisect.bisect_left(names, cuts[p - 1]) - 1) for p in range(len(cuts) + 1)]
                hi = [len(at) if p == len(cuts) else bisect.bisect_left(names, cuts[p]) for p in range(len(cuts) + 1)]
                start, end = [at[x] if at else 0 for x in lo], [at[x] if x < len(at) else size for x in hi]
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(lo), pa.int32()), pa.array(range(len(lo)), pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["run", "range", "start", "end"])

    def inside(e: tuple, p: int) -> bool:
        return (p == 0 or e[0] >= cuts[p - 1]) and (p == len(cuts) or e[0] < cuts[p])

    def source(level: int, r: int, p: int, start: int, end: int) -> Iterator[tuple]:
        if level:
            path = f"{folder}/merge-{level:02d}-{r:06d}-{p:06d}"
            return (_order(e) for e in _stream(path, 0, file_size(path)))
        return (_order(e) for e in _stream(f"{folder}/run-{r:06d}", start, end) if inside(e, p))

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, p, members in zip(*(batch.column(c).to_pylist() for c in ("group", "range", "runs"))):
                    merged = map(_restore, LoserTree([source(level, m["run"], p, m["start"], m["end"]) for m in members]))
                    if not last:
                        f = AtomicFile(f"{folder}/merge-{level + 1:02d}-{group:06d}-{p:06d}")
                        for e in merged:
                            f.write(_pack(e))
                        f.close()
                        continue
                    seq, rows = 0, []
                    for e in merged:
                        rows.append((p, seq, *e))
                        seq += 1
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

        return run

    slices = staged(runs.select("run").repartition(read_parts(spark, 0)).mapInArrow(parts_of, "run int, range int, start long, end long"), "slices")
    level = 0
    while True:
        last = len(ids) <= fan_in
        group = {r: i // fan_in for i, r in enumerate(ids)}
        of = spark.createDataFrame(list(group.items()) or [], "run int, group int")  # a row a run
        # At most fan_in runs a group: what a task gets is bounded.
        tasks = slices.join(of, "run").groupBy("group", "range").agg(F.array_sort(F.collect_list(F.struct("run", "start", "end"))).alias("runs"))
        tasks = tasks.repartition(max(1, len(set(group.values())) * (len(cuts) + 1)), "group", "range")
        out = staged(tasks.mapInArrow(merge(level, last), f"range int, seq long, {ENTRY}"), "merged")
        if last:
            return out
        ids, level = sorted(set(group.values())), level + 1
        slices = spark.createDataFrame([(g, p) for g in ids for p in range(len(cuts) + 1)], "run int, range int").withColumns({"start": F.lit(0).cast("long"), "end": F.lit(0).cast("long")})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["range", "seq", "surt", "stamp", "page_id", "file", "offset", "length"])


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Reads the records of an index from the archives: page_id, url, stamp, payload_bytes, payload_digest, record_type, refers_to (and payload), range, seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            out = []
            for where, file, offset, length, part, seq in zip(*(batch.column(c).to_pylist() for c in ("stamp", "file", "offset", "length", "range", "seq"))):
                if file != name:
                    name, f = file, open_file(f"{folder}/{file}")
                f.seek(offset)
                warc, http, payload = parse_record(gzip.decompress(f.read(length)))
                kind = warc["warc-type"]
                page, first = warc.get("page-id"), warc.get("refers-to-page-id")
                out.append((int(page) if page else None, warc.get("warc-target-uri", ""), where, int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), kind, int(first) if first else None, part, seq, payload if kind == "response" else None))
            cols = list(zip(*out)) or [()] * 10
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 10 if with_payload else 9]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "stamp", "payload_bytes", "payload_digest", "record_type", "refers_to", "range", "seq", "payload"][: len(kinds)])

    schema = "page_id long, url string, stamp string, payload_bytes long, payload_digest string, record_type string, refers_to long, range int, seq long" + (", payload binary" if with_payload else "")
    # Neighbouring offsets of an archive stay together; archives of any size are dealt in parts, by the bytes to read.
    part = F.col("offset") - F.pmod("offset", F.lit(8 << 20))
    parts = read_parts(index.sparkSession, index.agg(F.sum("length")).first()[0] or 0)
    return index.select("range", "seq", "stamp", "file", "offset", "length").repartition(parts, F.col("file"), part).sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html, ...) as WARC archives, merges their capture runs and reads every record back by the merged index.

    A row a page: page_id, payload_bytes, payload_digest, record_type, refers_to, url, stamp, and
    range and seq, whose order is that of the capture histories (URL key, timestamp, page_id).
    Null html is an empty payload; a null page_id or url is kept, and such a page is always a
    response. Repeated rows keep a record each (rows with the smallest page_id of a payload are
    all responses). An empty table gives no rows; further columns, of whatever name, are ignored;
    html of any length is one record.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    index = merge_runs(write_archives(pages, folder, min_bytes), folder)
    return read_archives(index, folder)
