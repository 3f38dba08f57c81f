"""WARC archives with one Zstandard dictionary, embedded in every file.

File layout: a skippable frame that holds the dictionary, then one Zstandard
frame for each record, so any record can be read alone from its offset.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.shared import WholeFile, filesystem, pick, stored, work_dir

# Magic number of the dictionary's skippable frame and of a formatted dictionary.
DICT_FRAME = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"

READ_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
               "refers_to long, url string, file string, offset long")


def _sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(pages: DataFrame, dict_bytes: int = 64 << 10, sample_bytes: int = 4 << 20,
                     piece: int = 16 << 10) -> bytes:
    """Dictionary from a bounded sample of the records, trained in one task.

    A page enters the sample by a hash of its url and payload, at a rate that makes the
    sample ``sample_bytes`` in expectation; of a longer page one piece of ``piece``
    characters, at a place given by the same hash, is used.  Only the dictionary
    (at most ``dict_bytes``) reaches the driver.  Empty when there is too little
    data to train one; the archives then hold no dictionary frame.
    """
    size = F.least(F.length("html"), F.lit(piece))
    total = pages.agg(F.sum(size)).first()[0] or 0
    if not total:
        return b""
    spot = F.xxhash64("url", "html", F.lit("sample"))
    pieces = F.greatest(F.ceil(F.length("html") / piece), F.lit(1))
    sample = pages.where(F.pmod(spot, F.lit(1_000_000)) < min(1.0, sample_bytes / total) * 1_000_000).select(
        "page_id", "url", F.substr("html", (F.pmod(F.shiftright(spot, 20), pieces) * piece + 1).cast("int"), F.lit(piece)).alias("piece"))

    def train(batches):
        import pyarrow as pa
        import zstandard

        samples = []
        for b in batches:
            for page_id, url, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = piece.encode()
                samples.append(_record(page_id, url, data, _sha1_base32(data), len(data), page_id, "1970-01-01T00:00:00Z"))
        try:
            data = zstandard.train_dictionary(min(dict_bytes, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            data = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([data], pa.binary())})

    row = sample.repartition(1).mapInArrow(train, "dictionary binary").first()
    return b"" if row is None else bytes(row[0])


def _header(fields) -> bytes:
    clean = ((k, str(v).replace("\r", " ").replace("\n", " ")) for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def _record(page_id, url, payload, digest, size, first, date) -> bytes:
    """One record; ``payload`` is None for a revisit."""
    urn = lambda i: f"<urn:page:{i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", urn("none" if page_id is None else page_id)),
            ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if payload is None:
        head += [("WARC-Refers-To", urn("none" if first is None else first)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _header(head) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 3,
                   date: str = "1970-01-01T00:00:00Z", **sampling) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html); one row (file,
    records, bytes) for each archive.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the
    smallest page_id is a response and the others are revisits that name it; a null id
    counts as larger than any number.  Rows that repeat the smallest id are all responses.
    A null html is an empty payload; a null url leaves the header out.  Other columns of
    ``pages`` are ignored.  The payload goes through one shuffle, keyed by its digest as an
    ordinary join, so the rows of a digest that many pages share can be split; what is
    aggregated is one id for each digest and task.
    """
    pages = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit("")))
    data = train_dictionary(pages, **sampling)
    keyed = pages.withColumn("key", F.sha2("html", 256))
    first = keyed.select("key", "page_id").groupBy("key").agg(F.min("page_id").alias("first"))
    rows = keyed.join(first, "key").select("page_id", "url", "html", "first")

    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        name = f"pages-{TaskContext.get().partitionId():06d}.warc.zst"
        n = done = 0
        use = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
        press = zstandard.ZstdCompressor(level=level, **use)
        with WholeFile(f"{folder}/{name}") as out:
            if data:
                out.write(struct.pack("<II", DICT_FRAME, len(data)) + data)
                done = 8 + len(data)
            while head is not None:
                for page_id, url, html, first_id in zip(*(c.to_pylist() for c in head.columns), strict=True):
                    payload = html.encode()
                    again = len(payload) >= min_revisit_bytes and page_id != first_id
                    frame = press.compress(_record(page_id, url, None if again else payload, _sha1_base32(payload), len(payload), first_id, date))
                    out.write(frame)
                    n, done = n + 1, done + len(frame)
                head = next(batches, None)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([done], pa.int64())})

    return rows.mapInArrow(write, "file string, records long, bytes long")


def _frames(stream, step: int = 32 << 10):
    """(offset, decompressed frame) for each record of an archive."""
    import zstandard

    left, at = stream.read(8), 0
    use = {}
    if len(left) == 8 and struct.unpack("<I", left[:4])[0] == DICT_FRAME:
        data = stream.read(n := struct.unpack("<I", left[4:])[0])
        if data[:4] != DICT_MAGIC:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        use, left, at = {"dict_data": zstandard.ZstdCompressionDict(data)}, b"", 8 + n
    reader = zstandard.ZstdDecompressor(**use)
    while left or (left := stream.read(step)):
        one, out, start, size = reader.decompressobj(), [], at, 0
        while True:
            out.append(one.decompress(left))
            size += len(left)
            if one.eof:
                left = one.unused_data
                break
            if not (left := stream.read(step)):
                raise ValueError(f"the record at {start} is cut off")
        at = start + size - len(left)
        yield start, b"".join(out)


def _parse(record: bytes) -> dict:
    """Header fields, and ``payload`` for a response (checked against its digest)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(out["Content-Length"])]
    if out["WARC-Type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if f"sha1:{_sha1_base32(out['payload'])}" != out["WARC-Payload-Digest"]:
            raise ValueError(f"digest of {out['WARC-Record-ID']} does not fit its payload")
    return out


def _id(urn: str | None) -> int | None:
    found = None if urn is None else urn[len("<urn:page:"):-1]
    return None if found in (None, "none") else int(found)


def read_record(uri: str, offset: int) -> dict:
    """One record alone, by the offset that ``read_archives`` returns."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        head = f.read(8)
        lead = b""
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_FRAME:
            lead = head + f.read(struct.unpack("<I", head[4:])[0])
        f.seek(offset)

        class Joined:
            def read(self, n):
                nonlocal lead
                if lead:
                    out, lead = lead[:n], lead[n:]
                    return out
                return f.read(n)

        return _parse(next(_frames(Joined()))[1])


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of the archives named in ``files`` (column file), one task per file."""

    def read(batches):
        import pyarrow as pa

        names = [x.strip() for x in READ_SCHEMA.split(",")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in names])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = filesystem(f"{folder}/{name}")
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, record in _frames(stream):
                        r = _parse(record)
                        size = len(r["payload"]) if "payload" in r else int(r["X-Payload-Length"])
                        rows.append((_id(r["WARC-Record-ID"]), size, r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"],
                                     _id(r.get("WARC-Refers-To")), r.get("WARC-Target-URI"), name, offset))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.select("file").mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the archives into a new shared folder and read them back."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    files = stored(write_archives(pages, f"{folder}/archives", **options), f"{folder}/files")
    return read_archives(files.repartition(max(1, files.count())), f"{folder}/archives")
