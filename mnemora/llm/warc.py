"""WARC archives: written with an index, read back by sorted, coalesced byte ranges.

Write. Records with equal payload digests become one response, that with the smallest page_id, and revisits
of it. Each task writes its rows, sorted by page_id, URL and digest, as one archive of gzip members (a
record each) in the shared folder, under a name of its own until it is whole, and returns an index row per
record: archive, offset, length, URL and digest. Rows equal in all three are equal records, so a task that
runs again writes the same bytes to the same name. The index is kept as a Parquet table beside the archives.

Read. Index rows, selected by any filter, are dealt by archive and stretch of STRETCH bytes to as many
partitions as there are STRETCH bytes to read (the index alone is so small that Spark would put it into one
task), and sorted by offset; neighbours less than GAP bytes apart are read at once, READ bytes at most. Every
record is parsed and its payload's digest compared with the one it states.

Payload digests are bare upper-case base32 SHA-1 of the full payload. The payload's full length is also
stated in a revisit (field X-Full-Payload-Length), which has no payload itself.

Defined results. A null payload is as an empty one. Payloads shorter than least_bytes are all responses.
Rows that repeat the smallest page_id of a digest are all responses. A null URL has no field in its record;
white space and controls in a URL are written as %XX, and so is in a page_id of
any text all but letters, digits and _.-~. A null page_id has no record id; its row is a response
unless others share its digest, and then a revisit of the smallest id. Other columns are not read. An empty
table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm._shared import fresh_path
from mnemora.operators.joins import with_groups

GAP, READ, STRETCH = 1 << 16, 8 << 20, 16 << 20
_END = b"\r\n\r\n"
#: Every record has the same date: the table has none, and a task that runs again must write the same bytes.
_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    """A page's id as a name in a header: a text is written with %XX, so that none forges a field."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """One record, response or (if refers_to is given) revisit, as a gzip member."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = [] if url is None else ["WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url)]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        *target,
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Full-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + _END + block + _END) + member.flush()


def parse(member: bytes) -> dict:
    """The fields of one record, its payload, and whether the payload has the digest that the record states."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(_END)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(_END)[2]
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    name = lambda x: unquote(x[len("<urn:page:") : -1]) if x.startswith("<urn:page:") else None
    return {
        "page_id": name(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": int(fields["X-Full-Payload-Length"]) if revisit else len(payload),
        "payload_digest": sha1,
        "refers_to": name(fields["WARC-Refers-To"]) if revisit else None,
        "sound": revisit or digest(payload) == sha1,
    }


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Archives of pages (page_id, url, html) in a new folder of the shared one; the folder and the index."""
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    kind = dict(pages.dtypes)["page_id"]
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.coalesce(F.unhex(F.sha1(payload)), F.lit(b"")).alias("sha1"), F.octet_length(payload).alias("bytes"))
    firsts = rows.filter(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"))
    # copies of one payload go to as many tasks, and archives, as their bytes need
    whole = with_groups(rows, firsts, ["sha1", "bytes"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    whole = whole.select("page_id", "url", "payload", "sha1", refers.alias("refers_to")).sortWithinPartitions("page_id", "url", "sha1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.warc.gz"
        fs, base, out, at, temp = None, "", None, 0, ""
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    temp = f"{base}/_{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp, compression=None)
                index = []
                for page_id, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    sha1 = base64.b32encode(sha1).decode()
                    member = record(page_id, url, payload, sha1, refers)
                    out.write(member)
                    index.append((name, at, len(member), page_id, url, sha1, "response" if refers is None else "revisit"))
                    at += len(member)
                columns = list(zip(*index))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), batch.column(0), *(pa.array(c, pa.string()) for c in columns[4:])], ["archive", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()
        if out is not None:
            fs.move(temp, f"{base}/{name}")

    index = whole.mapInArrow(run, f"archive string, offset long, length long, page_id {kind}, url string, digest string, record_type string")
    index.write.parquet(f"{folder}/index")
    return folder, spark.read.schema(index.schema).parquet(f"{folder}/index")


def read(folder: str, selected: DataFrame, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """The records that the rows of selected, from the index, point to."""
    dealt = selected.select("archive", "offset", "length", F.expr(f"offset div {STRETCH}").alias("stretch"))
    much = selected.agg(F.sum("length")).first()[0] or 0
    dealt = dealt.repartition(much // STRETCH + 1, "archive", "stretch").sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "sound"] + ["payload"] * payloads
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = base = file = archive = None

        def fetch(group: list[tuple]) -> pa.RecordBatch:
            nonlocal fs, base, file, archive
            if fs is None:
                fs, base = pafs.FileSystem.from_uri(folder)
            if group[0][0] != archive:
                archive = group[0][0]
                file = fs.open_input_file(f"{base}/{archive}")
            start, end = group[0][1], max(o + n for _, o, n in group)
            data = file.read_at(end - start, start)
            found = [parse(data[o - start : o - start + n]) for _, o, n in group]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, types)], names)

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + GAP or row[1] + row[2] - group[0][1] > READ):
                    yield fetch(group)
                    group = []
                group.append(row)
        if group:
            yield fetch(group)

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, sound boolean" + ", payload binary" * payloads
    out = dealt.mapInArrow(run, schema)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, sound of every row, read from archives."""
    folder, index = write(pages, least_bytes=least_bytes)
    out = read(folder, index, dict(pages.dtypes)["page_id"], payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "sound")
