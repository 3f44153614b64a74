"""WARC archives: writing, normalising whole-file gzip streams, and reading back by a sidecar index.

An archive compressed as one gzip stream can only be read from its start. ``normalise`` inflates such a stream once, piece by
piece, rewrites every record as a gzip member of its own, and writes beside the archive an index of JSON lines with each
record's id, offset, length, type and digest, so any record can be read alone. A plan may turn records into revisits meanwhile.

Archives are real files in the cluster's shared folder, reached from executors through ``pyarrow.fs``. A task names its files
anew at each attempt, and only the rows of the attempt that succeeded name the files that count, so a lost executor does no
harm. An archive is closed at ``ROLL_BYTES`` or ``ROLL_RECORDS``, so one task normalises a bounded archive.

Defined results: a null payload is empty; ids are percent-encoded, and come back as they were, a null and an empty one too; a null URL leaves out the target header, control characters in one are
percent-encoded. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is the
response (ties: the first written; null ids last) and the others revisit it. Empty tables give no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, written

REVISIT_BYTES = 100
ROLL_BYTES, ROLL_RECORDS = 64 << 20, 50_000
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _header(lines: list[tuple[str, str]], block: bytes) -> bytes:
    named = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{named}\r\n".encode() + block + b"\r\n\r\n"


def _urn(page_id: str | None) -> str:
    """The record id of a page, percent-encoded; a page without an id is ``urn:no-page``, one whose id is empty has nothing after the colon."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def response_record(page_id: str | None, url: str | None, payload: bytes) -> bytes:
    """A response record with an HTTP head and the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    lines += [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    return _header(lines, head + payload)


def revisit_record(response: dict[str, str], block: bytes, refers_to: str | None) -> bytes:
    """The same record without its payload, referring to the record that has it."""
    lines = [("WARC-Type", "revisit"), *[(k, v) for k, v in response.items() if k not in ("WARC-Type", "Content-Length")]]
    lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    return _header(lines, block[: block.index(b"\r\n\r\n") + 4])


def inflated(stream, piece: int = READ_BYTES) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, piece by piece."""
    machine = zlib.decompressobj(31)
    while data := stream.read(piece):
        while data:
            if out := machine.decompress(data, 4 * piece):
                yield out
            data = machine.unconsumed_tail
            if machine.eof:
                data = machine.unused_data
                machine = zlib.decompressobj(31)
    if out := machine.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC stream; memory is bounded by a piece and one record."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            first, *rest = held[at:end].decode("utf-8", "surrogateescape").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            header = dict(line.split(": ", 1) for line in rest)
            stop = end + 4 + int(header["Content-Length"])
            if len(held) < stop + 4:
                break
            yield header, bytes(held[end + 4 : stop])
            at = stop + 4
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Whole-file gzip archives of all rows; a row ``archive, seq, id, payload_bytes, payload_digest`` for each record."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    kind = rows.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, packer, path, held, seq = None, None, "", 0, 0
        for batch in batches:
            ids = batch.column(0).cast(pa.string()).to_pylist()
            names, seqs, sizes, digests = [], [], [], []
            for page_id, url, payload in zip(ids, batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = (payload.as_py() or "").encode()
                if out is not None and (held >= roll_bytes or seq >= ROLL_RECORDS):
                    out.write(packer.flush())
                    out.close()
                    out = None
                if out is None:
                    path, held, seq, packer = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    system, local = _open(path)
                    system.create_dir(local.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(local, compression=None)
                record = response_record(page_id, url, body)
                out.write(packer.compress(record))
                names.append(path)
                seqs.append(seq)
                sizes.append(len(body))
                digests.append(hashlib.sha256(body).hexdigest())
                held, seq = held + len(record), seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(seqs, type=pa.int32()), batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.string())], names=["archive", "seq", "id", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(packer.flush())
            out.close()

    return rows.mapInArrow(write, f"archive string, seq int, id {kind}, payload_bytes long, payload_digest string")


def revisit_plan(record_rows: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``archive, seq, revisit, refers_to`` for every record."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("archive"), F.col("seq"))
    able, small = record_rows.filter(F.col("payload_bytes") >= least_bytes), record_rows.filter(F.col("payload_bytes") < least_bytes)
    met = able.join(able.groupBy("payload_digest").agg(F.min(order).alias("first")), "payload_digest")
    revisit = (F.col("first.archive") != F.col("archive")) | (F.col("first.seq") != F.col("seq"))
    judged = met.select("archive", "seq", revisit.alias("revisit"), F.when(revisit, F.col("first.id")).cast("string").alias("refers_to"))
    return judged.union(small.select("archive", "seq", F.lit(False), F.lit(None).cast("string")))


def normalise(source: str, target: str, refers: dict[int, str | None]) -> int:
    """Rewrite one archive record by record, those in ``refers`` (by number) as revisits, with ``target + '.idx'``; their number."""
    system, local = _open(source)
    out_system, out_local = _open(target)
    out_system.create_dir(out_local.rpartition("/")[0], recursive=True)
    at = n = 0
    with system.open_input_stream(local, compression=None) as stream, out_system.open_output_stream(out_local, compression=None) as out, out_system.open_output_stream(f"{out_local}.idx", compression=None) as index:
        for n, (header, block) in enumerate(records(inflated(stream)), 1):
            if n - 1 in refers:
                record = revisit_record(header, block, refers[n - 1])
            else:
                record = _header([(k, v) for k, v in header.items() if k != "Content-Length"], block)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(record) + packer.flush()
            out.write(member)
            entry = {"id": header["WARC-Record-ID"], "offset": at, "length": len(member), "type": "revisit" if n - 1 in refers else header["WARC-Type"], "digest": header["WARC-Payload-Digest"]}
            index.write(json.dumps(entry).encode() + b"\n")
            at += len(member)
    return n


def normalise_archives(plan: DataFrame, folder: str) -> DataFrame:
    """``archive, records`` of the rewritten archives; one task an archive, which gets that archive's plan."""

    def rewrite(table: pa.Table) -> pa.Table:
        target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        chosen = table.filter(table["revisit"])
        refers = dict(zip(chosen["seq"].to_pylist(), chosen["refers_to"].to_pylist(), strict=True))
        n = normalise(table["archive"][0].as_py(), target, refers)
        return pa.table({"archive": pa.array([target]), "records": pa.array([n], type=pa.int64())})

    # by number, so that the small plan isn't gathered into a few tasks while the archives are large
    archives = max(1, plan.select("archive").distinct().count())
    return plan.repartition(archives, "archive").groupBy("archive").applyInArrow(rewrite, "archive string, records long")


def read_record(archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a normalised archive."""
    system, local = _open(archive)
    with system.open_input_file(local) as f:
        return next(records(iter([zlib.decompress(f.read_at(length, offset), 31)])))


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of normalised archives (column ``archive``), by their indexes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, local = _open(archive)
                with system.open_input_stream(f"{local}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with system.open_input_file(local) as f:
                    for e in entries:
                        header, block = next(records(iter([zlib.decompress(f.read_at(e["length"], e["offset"]), 31)])))
                        rows.append(_row(header, block, archive, e))
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    got = archives.select("archive").mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, offset long, length long")
    return got.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


_READ = pa.schema([("id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _named(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def _row(header: dict[str, str], block: bytes, archive: str, entry: dict) -> dict:
    """What a record says; a response's size and digest are those of the payload just read."""
    kind, digest, size = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha256:"), int(header["X-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
            raise ValueError(f"{archive}: the payload at {entry['offset']} isn't the one that was written")
    return {"id": _named(header["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _named(header.get("WARC-Refers-To")), "archive": archive, "offset": entry["offset"], "length": entry["length"]}


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all rows to monolithic archives, normalise them, and give the rewritten archives (``archive, records``)."""
    spark = pages.sparkSession
    record_rows = written(write_archives(pages, fresh_path(spark, "warc-whole"), id_col, url_col, payload_col, roll_bytes), "records")
    plan = written(revisit_plan(record_rows), "plan")
    return written(normalise_archives(plan, fresh_path(spark, "warc")), "archives")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to`` of every row, as read back from its archive."""
    archives = archive_pages(pages, id_col, url_col, payload_col, roll_bytes)
    spread = archives.repartition(max(1, archives.count()))
    return read_archives(spread, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
