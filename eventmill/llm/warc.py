"""Web archives: WARC records written and read back by Spark, and a capture index merged from sorted runs.

Each record is a gzip member of its own, so that a reader can seek to the offset that the index
names. Tasks pack members into archives of about ``ARCHIVE_BYTES``, and an archive is one row of
Spark's text writer, whose line separator is an empty gzip member: archives go to any file system
that Spark writes to and are valid gzip files. A payload that an earlier page (by id) has too becomes
a revisit record, which keeps the HTTP headers and names the record it refers to.

Each task that reads archives gives one run of index entries sorted by URL key, time and page. Runs are dealt to ranges
of the keys (whose bounds Spark samples), and a loser tree merges the pieces of each range; the ranges
in their order are one globally ordered index, in which the captures of a URL stand together. The
ranges are of key, time, page and place, so one URL may spread over many of them.

Defined results: null html is an empty payload; a row without page id is a response and never an
original; rows with equal id and payload are all responses if theirs is the least id; a null URL has
no target line and an empty key; line breaks in a URL are archived as %0D and %0A. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, settings
from .url_rules import host

_END = "\r\n"
#: Captures are dated by page id from here on, as the tables hold no time.
FIRST_CAPTURE = "2024-01-01 00:00:00"
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Index entries of a range, about, and how many Spark samples for each range to find its bounds.
RANGE_ROWS = 50_000
SAMPLES = 100
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_READ = "target string, captured string, page_id long, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long"
_ENTRY = _READ.replace("target", "url_key")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four base-32 ones."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the last one on, then path and query, so that one site's URLs sort together."""
    rest = F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(host(url), r"\.")), ","), F.lit(")"), rest)


def revisits(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads that a smaller page id has. ``captures``: page_id, digest, bytes."""
    first = captures.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    first = scratch.keep(first.drop("n"), "originals")
    return captures.join(first, ["digest", "bytes"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _packer(limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archives, one to a row: the gzip members of records, one behind another."""
        members, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                members.append(_member(record.as_py()))
                size += len(members[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])

    return pack


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record for each row, packed into archives in ``folder``."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    payload = F.col("payload").cast("binary")
    source = source.withColumns({"digest": base32_sha1(payload), "bytes": F.octet_length(payload)})
    captures = scratch.keep(source.select("page_id", "digest", "bytes"), "captures")
    known = scratch.keep(revisits(captures, scratch), "revisits")
    again = F.col("refers_to").isNotNull()
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE).cast("timestamp")) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(_END * 2))
    head = F.concat_ws(
        "",
        F.lit("WARC/1.0" + _END),
        F.when(again, F.lit("WARC-Type: revisit" + _END + "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + _END)).otherwise(F.lit("WARC-Type: response" + _END)),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response" + _END),
        line("Content-Length", (F.octet_length(http.cast("binary")) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(_END),
        http,
    )
    record = F.concat(head, F.when(again, "").otherwise(F.col("payload")), F.lit(_END * 2))
    rows = source.join(known, ["page_id", "digest"], "left").select(record.cast("binary").alias("record"))
    packed = rows.mapInArrow(_packer(ARCHIVE_BYTES), "value binary").select(F.col("value").cast("string").alias("value"))
    # the separator is an empty gzip member, each byte as a character of Latin-1
    packed.write.option("lineSep", _member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(folder)


def _members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an archive."""
    view, at = memoryview(content), 0
    while at < len(view):
        reader, fed, out = zlib.decompressobj(31), at, []
        while not reader.eof:
            if fed >= len(view):
                raise ValueError(f"the gzip member at {at} has no end")
            piece = view[fed : fed + (1 << 16)]
            fed += len(piece)
            out.append(reader.decompress(piece))
        yield at, b"".join(out)
        at = fed - len(reader.unused_data)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and block of a record; its length, not a separator, tells where a block ends."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = (line.decode("utf-8").partition(":") for line in head.split(b"\r\n")[1:])
    headers = {name.lower(): value.strip() for name, _, value in lines}
    return headers, rest[: int(headers["content-length"])]


def _page_of(record_id: str | None) -> int | None:
    number = record_id.split(":")[2] if record_id else ""
    return int(number) if number else None


def _entries(path: str, content: bytes) -> Iterator[tuple]:
    for offset, data in _members(content):
        if not data:
            continue
        h, block = parse_record(data)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        if h["warc-type"] != "revisit" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
            raise ValueError(f"{path}, record at {offset}: the payload doesn't have the digest that its header names")
        yield (h.get("warc-target-uri"), h["warc-date"], _page_of(h["warc-record-id"]), digest, size, h["warc-type"], _page_of(h.get("warc-refers-to")), path.rpartition("/")[2], offset)


_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in fields.split(", "))])


def _columns(rows: list[tuple], fields: str) -> pa.Table:
    schema = _schema(fields)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            yield from _columns(list(_entries(path.as_py(), content.as_py())), _READ).to_batches()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of all records, payloads checked against their digests; only headers of the format are read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    rows = files.mapInArrow(_read_batches, _READ)
    return rows.select(url_key(F.col("target")).alias("url_key"), *(c for c in rows.columns if c != "target"))


class LoserTree:
    """Merges k sorted runs of tuples by their first part: inner nodes hold the losers of their matches, and a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i, fill=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _replay(self, i: int, fill: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and fill:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _key(row: tuple) -> tuple:
    return (row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8])


_MERGED = f"{_ENTRY}, part int, position int"


def sorted_runs(entries: DataFrame) -> DataFrame:
    """``entries`` with the run that each is in, one for each task that has read archives, and its number there.

    Spark sorts a task's entries, on disk if it has to, so that a run is as long as the task's share.
    """
    order = ["url_key", "captured", F.coalesce("page_id", F.lit(-1)), "archive", "offset"]
    runs = entries.select(*_NAMES).sortWithinPartitions(*order)
    return runs.withColumns({"run": F.spark_partition_id().cast("string"), "nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int")})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of all runs in one range, merged."""
    runs: dict[str, list[tuple]] = {}
    part = 0
    for batch in batches:
        for own, name, nth, *row in zip(*(batch.column(n).to_pylist() for n in ("part", "run", "nth", *_NAMES))):
            runs.setdefault(name, []).append((nth, tuple(row)))
            part = own
    pieces = [[row for _, row in sorted(run, key=lambda x: x[0])] for _, run in sorted(runs.items())]
    merged = LoserTree([((_key(row), row) for row in piece) for piece in pieces])
    if runs:
        yield from _columns([(*row, part, k) for k, (_, row) in enumerate(merged)], _MERGED).to_batches()


def merge_index(entries: DataFrame) -> DataFrame:
    """``entries`` with ``place``, their place in the global order by URL key, time and page."""
    scratch = Scratch(entries.sparkSession, "index")
    parts = max(1, -(-entries.count() // RANGE_ROWS))
    ranged = sorted_runs(entries).repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "offset").withColumn("part", F.spark_partition_id())
    with settings(entries.sparkSession, {"spark.sql.execution.rangeExchange.sampleSizePerPartition": str(SAMPLES)}):
        merged = scratch.keep(ranged.mapInArrow(_merge, _MERGED), "merged")
    # one row a range, so that a single window over them stays small
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return merged.join(scratch.keep(starts, "starts"), "part").select(*_NAMES, "part", (F.col("start") + F.col("position")).alias("place"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages``, read them back, and return the merged capture index."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archives"
    write_archives(pages, folder, scratch)
    entries = scratch.keep(read_archives(pages.sparkSession, folder), "entries")
    scratch.drop_others("archives", "entries")
    return merge_index(entries)
