"""WARC archives: written with an index of offset, length, URL and digest; read by coalesced byte ranges of the index."""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import FREQUENT, discard, fresh_dir, mapped, sieve, spread_join, stored

_COLUMNS = ["archive", "offset", "length", "page_id", "url", "digest"]
INDEX = "archive string, offset long, length long, page_id long, url string, digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed, so that equal pages give equal archives.
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page: int | None, url: str | None, digest: str, block: bytes, more: str = "") -> bytes:
    target = f"WARC-Target-URI: {urllib.parse.quote(url, safe=_SAFE)}\r\n" if url else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{page}>\r\nWARC-Date: {DATE}\r\n{target}{more}WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def response(page: int | None, url: str | None, payload: bytes) -> bytes:
    """A response record, one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("response", page, url, sha1_base32(payload), http + payload)


def revisit(page: int | None, url: str | None, digest: str, refers_to: int) -> bytes:
    """A revisit record of the response with page id refers_to, without its payload."""
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:x-page:{refers_to}>\r\n"
    return _record("revisit", page, url, digest, b"HTTP/1.1 200 OK\r\n\r\n", more)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) and the payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


#: Names of stores that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs", "wasb": "abfs"}


def _filesystem(uri: str):
    """The file system of a URI with a scheme, and the path there; an error where Arrow has none for it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def shared_folder(spark: SparkSession, folder: str) -> str:
    """The folder as tasks must name it: made, and resolved, by the file system that Spark has for it (without a scheme the
    default one, mounts followed), so that archives lie where Spark's own tables do. A store that Arrow cannot open is an error
    before anything is written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    uri = store.resolvePath(at).toString()
    _filesystem(uri)
    return uri


def delete_archives(index: DataFrame) -> None:
    """Deletes the folder of the archives that write_archives() made for this index; the index is of no use any more."""
    spark = index.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(index.archives_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _hash(key) -> Column:
    return F.xxhash64(key)


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the index, itself written to the shared folder.

    The payload is the html as UTF-8, null as empty. Of rows with equal payloads (SHA-256 and length) of at least
    revisit_bytes bytes, that with the largest page_id is a response, the others are revisits of it; rows that repeat
    the largest page_id, and groups whose page_ids are all null, are responses.

    Digests and page_ids alone are shuffled to find payloads that repeat. A sieve of these tells each task which pages are
    single: it writes them where they lie. A second sieve, of the page that is the response of each, spares the others
    their payload: only what it lets through is compressed and shuffled, and the exact list decides. A payload that more
    than 1 row in 4096 has gets its response from a broadcast (there are at most 4096 of them).

    Each task streams its records into an archive of its own whose name is new for each attempt; the index names only
    archives of attempts that Spark committed, so a lost executor leaves at most files that nothing refers to; they go with
    the rest by delete_archives(). The URL keeps its printable ASCII in the record, the rest is percent-encoded; the index
    has it as it is.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, folder or fresh_dir(spark, "warc"))
    key = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", key.alias("key"))
    groups = keyed.groupBy("key").agg(F.max("page_id").alias("newest"), F.count("*").alias("rows")).where("rows > 1")
    repeated = stored(groups, "warc-repeated")
    n = repeated.count()
    total = keyed.count() if n else 0
    again = spark.sparkContext.broadcast(sieve(repeated.select(_hash("key").alias("hash")), n, each=32))
    kept = spark.sparkContext.broadcast(sieve(repeated.select(F.xxhash64("key", "newest").alias("hash")), n, each=32))

    def write(name_of: Callable[[], str]):
        """A function of (page, url, digest, record) lists that appends them to one archive and returns index columns."""
        fs, base = _filesystem(folder)
        state = {"sink": None, "at": 0, "name": name_of()}

        def put(page: list, url: list, digest: list, records: list[bytes]) -> pa.RecordBatch:
            if state["sink"] is None and records:
                fs.create_dir(base, recursive=True)
                state["sink"] = fs.open_output_stream(f"{base}/{state['name']}", compression=None)
            offsets, lengths = [], []
            for r in records:
                state["sink"].write(r)
                offsets.append(state["at"])
                lengths.append(len(r))
                state["at"] += len(r)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{state['name']}"] * len(page), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(digest, pa.string())], names=_COLUMNS)

        def close() -> None:
            if state["sink"]:
                state["sink"].close()

        return put, close

    new_name = lambda: f"{uuid.uuid4().hex}.warc.gz"
    told = "key string, digest string, n long, member binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows of single pages, which are written here; key and what else is needed of the others."""
        put, close = write(new_name)
        for batch in batches:
            h, own = (batch.column(i).to_numpy().view(np.uint64) for i in (4, 5))
            shared = np.zeros(len(h), bool)
            shared[again.value.passed(h)] = True
            response_too = np.zeros(len(h), bool)
            response_too[kept.value.passed(own)] = True
            page, url, keys = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for at in np.flatnonzero(~shared).tolist(), np.flatnonzero(shared).tolist():
                if not at:
                    continue
                raw = [(h or "").encode("utf-8", "surrogatepass") for h in batch.column(2).take(pa.array(at)).to_pylist()]
                digest = [sha1_base32(r) for r in raw]
                p, u, k = ([c[i] for i in at] for c in (page, url, keys))
                lone = not shared[at[0]]
                member = [response(x, y, r) if lone or p[j] is None or len(r) < revisit_bytes or response_too[i] else None for j, (i, x, y, r) in enumerate(zip(at, p, u, raw, strict=True))]
                if lone:
                    done, rest = put(p, u, digest, member), [pa.nulls(len(at), t) for t in (pa.string(), pa.string(), pa.int64(), pa.binary())]
                else:
                    empty = [pa.nulls(len(at), t) for t in (pa.string(), pa.int64(), pa.int64())]
                    done = pa.RecordBatch.from_arrays([*empty, pa.array(p, pa.int64()), pa.array(u, pa.string()), pa.nulls(len(at), pa.string())], names=_COLUMNS)
                    rest = [pa.array(k, pa.string()), pa.array(digest, pa.string()), pa.array([len(r) for r in raw], pa.int64()), pa.array(member, pa.binary())]
                yield pa.RecordBatch.from_arrays([*done.columns, *rest], names=[*_COLUMNS, "key", "sha1", "n", "member"])
        close()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put, close = write(new_name)
        for batch in batches:
            page, url, digest, member, refers = (batch.column(i).to_pylist() for i in range(5))
            yield put(page, url, digest, [m if r is None else revisit(p, u, d, r) for p, u, d, m, r in zip(page, url, digest, member, refers, strict=True)])
        close()

    hashes = keyed.select("*", _hash("key").alias("h"), F.xxhash64("key", "page_id").alias("own"))
    index = stored(mapped(hashes, first, f"{INDEX}, {told.replace('digest', 'sha1')}"), "warc-first")
    single = index.where("archive is not null").select(*_COLUMNS)
    if not n:
        discard(repeated)
        single.archives_at = folder
        return single
    open_ = index.where("archive is null").select("page_id", "url", "key", "sha1", "n", "member")
    newest = repeated.select("key", "newest")
    often = repeated.where(F.col("rows") > max(1.0, total / FREQUENT)).select("key", "newest")
    refers = F.when((F.col("n") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    decided = spread_join(open_, newest, "key", often).select("page_id", "url", "sha1", "member", refers.alias("refers_to"))
    more = stored(mapped(decided, second, INDEX), "warc-second")
    discard(repeated)
    both = single.unionByName(more)
    both.archives_at = folder
    return both


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, row numbers): reads for sorted (offset, length) rows; neighbours up to `gap` bytes apart share one
    read of up to `most` bytes (a longer record is read alone)."""
    held: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if held and (offset - end > gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset
        end = max(end, offset + length)
        held.append(i)
    if held:
        yield start, end, held


def read_records(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records that the index rows name: page_id, url, record_type, refers_to, payload_digest (of the bytes read; of
    the header for revisits), payload_bytes (null for revisits), payload (binary; null for revisits).

    Rows are dealt out by ranges of archive and offset; each task reads its ranges of an archive in order, neighbours
    with one read. An index without rows gives no rows. Rows that repeat are read for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archive, offset, length, _, url, _ = (batch.column(i).to_pylist() for i in range(6))
            first = 0
            while first < len(archive):
                last = first
                while last < len(archive) and archive[last] == archive[first]:
                    last += 1
                fs, path = _filesystem(archive[first])
                with fs.open_input_file(path) as f:
                    for start, end, rows in ranges(list(zip(offset[first:last], length[first:last], strict=True)), gap, most):
                        data = f.read_at(end - start, start)
                        out: list[list] = [[] for _ in range(7)]
                        for i in rows:
                            at = offset[first + i] - start
                            headers, payload = parse(data[at : at + length[first + i]])
                            full = headers["warc-type"] == "response"
                            page, refers = (headers.get(k, "None>")[12:-1] for k in ("warc-record-id", "warc-refers-to"))
                            values = (int(page) if page != "None" else None, url[first + i], headers["warc-type"], int(refers) if refers else None, sha1_base32(payload) if full else headers["warc-payload-digest"][5:], len(payload) if full else None, payload if full else None)
                            for column, value in zip(out, values, strict=True):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
                first = last

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = index.select("archive", "offset", "length", "page_id", "url", "digest")
    ordered = columns.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return mapped(ordered, run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """records without payload, payload_bytes of revisits taken from the response they refer to (null where there is none).
    Of responses that repeat a page_id and digest one counts; a response that very many refer to is broadcast."""
    plain = stored(records.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"), "warc-read")
    revisits = plain.where("refers_to is not null").withColumn("_at", F.concat_ws(":", "refers_to", "payload_digest")).drop("payload_bytes")
    sizes = plain.where("record_type = 'response'").groupBy(F.concat_ws(":", "page_id", "payload_digest").alias("_at")).agg(F.max("payload_bytes").alias("payload_bytes"))
    total = revisits.count()
    often = revisits.groupBy("_at").agg(F.count("*").alias("n")).where(F.col("n") > max(1.0, total / FREQUENT)).drop("n")
    found = spread_join(revisits, sizes, "_at", often.join(sizes, "_at"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.where("refers_to is null").select(*columns).unionByName(found.select(*columns))
