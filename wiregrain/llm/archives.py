"""WARC archives: writing with revisit records, reading back, and capture histories in global order.

Every row becomes one record; its payload is the UTF-8 text (null: empty). Of records with equal payloads of at least
``least_bytes`` bytes the one with the largest id is the response, the others revisit it; rows that share that id and
payload are all responses. Rows with a null id revisit like others; where a payload has only null ids, all are
responses. Line breaks in a URL are percent-encoded in its header; a null URL leaves the header out.

Archives are gzip-compressed WARC files that Spark's text writer commits, so a lost executor leaves no half file.
Each archive is sorted by URL key and time: it is one run of the index. The runs are merged by loser trees, one for each
range of keys; range and position together order all captures.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiregrain.llm.rows import require
from wiregrain.session import Scratch

#: Records of one archive file.
RECORDS_PER_FILE = 5000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits are four groups of eight digits."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _CONV32, _BASE32)


def url_key(url: Column) -> Column:
    """Sort-friendly URL: host labels from the right, then path and query; other strings in lower case."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^#]*)", 1)
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.when(host != "", surt).otherwise(F.lower(url)), F.lit(""))


def _header(name: str, value: Column) -> Column:
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, captured: Column | None = None) -> DataFrame:
    """Rows (id, url, payload, digest, bytes, stamp, winner): what goes into the archives.

    ``captured`` is the time of capture; tables without one get a second for each id from 2024 on.
    """
    moment = captured if captured is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("id"), F.lit(0)))
    rows = require(pages, key, url, payload).toDF("id", "url", "payload")
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit("")))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))
    winner = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("id").alias("winner"))
    return rows.join(winner, "digest", "left")


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write every row as a WARC record below ``path``; options as those of ``records``."""
    rows = records(pages, **columns)
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("winner")) & F.col("winner").isNotNull(), F.lit(False))
    block = F.when(~revisit, F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit("\r\n\r\n"), F.col("payload"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    value = F.concat(
        F.lit("WARC/1.0\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", urn("id")),
        _header("WARC-Date", F.col("stamp")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, urn("winner"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")).otherwise(""),
        _header("X-Payload-Length", F.col("bytes").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),  # the writer's line end completes the record
    )
    ordered = rows.sortWithinPartitions(url_key(F.col("url")), "stamp", "id")
    ordered.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_INDEX = "file string, seq long, offset long, length long, record_type string, page_id long, url string, stamp string, payload_digest string, payload_bytes long, refers_to long, intact boolean"


def _parse(content: bytes) -> Iterator[tuple]:
    """Records of an archive: offset and length in the unpacked file, then the fields of the index."""
    data, rest = b"", content
    while rest:  # members of a gzip file
        unpack = zlib.decompressobj(31)
        data += unpack.decompress(rest) + unpack.flush()
        rest = unpack.unused_data
    urn = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:body].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:] if x)
        end = body + int(head["Content-Length"])
        digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        intact = data[end : end + 4] == b"\r\n\r\n"
        if head["WARC-Type"] == "response":
            payload = data[data.index(b"\r\n\r\n", body) + 4 : end]
            intact &= base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == length
        yield at, end + 4 - at, head["WARC-Type"], urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Date"], digest, length, urn(head.get("WARC-Refers-To")), intact
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index of all archives below ``path``; ``intact`` tells whether payload and digest agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                rows = [(name, n, *r) for n, r in enumerate(_parse(batch.column(1)[i].as_py()))]
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, _INDEX)


_NAMES = [x.split(" ")[0] for x in _INDEX.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split(" ")[1]] for x in _INDEX.split(", ")]


class LoserTree:
    """Merges sorted iterators of tuples: each inner place keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while (item := self.head[self.winner]) is not None:
            yield item
            run = self.winner
            self.head[run] = next(self.runs[run], None)
            node = (run + self.size) // 2
            while node:
                if not self._less(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_runs(index: DataFrame, rows_per_range: int = 100_000, most_ranges: int = 10_000, sample_per_range: int = 20) -> DataFrame:
    """The index with ``url_key``, ``history_range`` and ``history_position``: the global order of all captures.

    Cut keys come from the captures with the smallest hashes, ``sample_per_range`` for each range. A key is URL, time,
    id, file and place in the file, so captures of one URL, however many, spread over ranges too.
    """
    index = index.withColumn("url_key", url_key(F.col("url")))
    place = [F.col("url_key"), F.col("stamp"), F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("page_id"), F.col("file"), F.col("seq")]
    ranges = min(most_ranges, -(-index.count() // rows_per_range))
    sample = index.select(*place, F.xxhash64("file", "seq").alias("h")).orderBy("h", "file", "seq").limit(ranges * sample_per_range)
    keys = sorted(tuple(r)[:5] for r in sample.collect())
    cuts = keys[sample_per_range - 1 : -1 : sample_per_range]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(cuts, r) for r in rows], pa.int64())], [*names, "history_range"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = [table.column(c).to_pylist() for c in names[:5]]
        runs: dict[str, list[tuple[int, int]]] = {}
        for i, (file, seq) in enumerate(zip(columns[3], columns[4], strict=True)):
            runs.setdefault(file, []).append((seq, i))
        for run in runs.values():
            run.sort()  # a run arrives in pieces; its own order is that of its archive
        sorted_runs = [((*(c[i] for c in columns), i) for _, i in run) for _, run in sorted(runs.items())]
        order = [item[-1] for item in LoserTree(sorted_runs)]
        return table.take(pa.array(order, pa.int64())).append_column("history_position", pa.array(range(len(order)), pa.int64()))

    place_of = index.select(*place)
    names = place_of.columns
    dealt = place_of.mapInArrow(deal, "url_key string, stamp string, page_id long, file string, seq long, history_range long")
    merged = dealt.groupBy("history_range").applyInArrow(merge, "url_key string, stamp string, page_id long, file string, seq long, history_range long, history_position long")
    return index.join(merged.select("file", "seq", "history_range", "history_position"), ["file", "seq"])


def capture_histories(pages: DataFrame, scratch: Scratch, **columns) -> DataFrame:
    """Write archives to the scratch folder, read them back and merge their index."""
    path = f"{scratch.path}/archives"
    write_archives(pages, path, **columns)
    return merge_runs(scratch.settle(read_archives(pages.sparkSession, path)))
