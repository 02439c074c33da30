"""WARC archives: a writer with revisit records and a salvage reader.

:func:`write_warc` puts one record per row into ``.warc.gz`` files, one gzip
member per record, through Spark's own file writer, so that the archives may
lie in any store that Spark can write. Every row of the text sink is one gzip
member without its last byte, and the row separator is that byte: it is zero
for members below 16 MiB, and larger records end in an empty member to make
it so. :func:`read_warc` reads such archives, and also plain ones. A member or
record that fails its checks (gzip CRC, version line, length, end mark, block
digest) is not believed: the reader looks for the next member or version line
that passes, goes on from there, and logs the bytes in between as a gap. In a
member of several records those that pass are kept: after a failure the reader
looks for the next version line in the decompressed bytes, and a member that is
cut off or damaged is decompressed as far as it goes; its records count only
with a block digest that agrees. Records of one member share its place, and
gaps inside it are logged at that place.

Defined cases: a null payload counts as empty. Of records with equal payloads
the smallest id is the response and others revisit it; rows that repeat the
smallest id are responses too. Null ids are larger than any; payloads that only null ids have are all responses. Identical
payloads are told by their SHA-1, which is also the archive format's name for
them. No rows give archives without records. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import checkpointed, new_path, small_side, trimmed

FILE_BYTES, MOST_RECORDS = 64 << 20, 20_000
READ = "path string, kind string, at long, length long, reason string, record_id string, record_type string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one uncompressed WARC/1.1 record."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join(uri.split())}"] if uri and uri.strip() else []
    lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"] if revisit else []
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    lines += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose last byte is zero (see the module's text)."""
    out = gzip.compress(data, level, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", level, mtime=0)


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """Header fields, block and end of the record that begins at ``at``, or why it isn't one."""
    if data[at : at + 7] != b"WARC/1.":
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "no end of header"
    fields: dict[str, str] = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return "bad header line"
        fields[key.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        return "no length"
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no end of record"
    block = data[start:stop]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        return "block digest differs"
    return fields, block, stop + 4


STEP = 64


def _member_at(data: bytes, at: int) -> tuple[bytes, int, str, list[tuple[int, int]]]:
    """Decompressed bytes, end, what is wrong with the member, and for a damaged one how many bytes were out at which place."""
    # In growing pieces, as what is left over of a piece is copied.
    gz, parts, view, pos, step = zlib.decompressobj(31), [], memoryview(data), at, 1 << 12
    try:
        while pos < len(data) and not gz.eof:
            parts.append(gz.decompress(view[pos : pos + step]))
            pos, step = min(pos + step, len(data)), min(2 * step, 1 << 20)
        if gz.eof:
            return b"".join(parts), pos - len(gz.unused_data), "", []
        why = "member is cut off"
    except zlib.error as e:
        why = str(e)[:80]
    # Once more in small steps, and the step that fails byte by byte.
    gz, parts, n, places = zlib.decompressobj(31), [], 0, [(0, at)]
    pos, step = at, STEP
    before = gz.copy()
    while pos < len(data) and not gz.eof:
        try:
            some = gz.decompress(view[pos : pos + step])
        except zlib.error:
            if step == 1:
                break
            gz, step = before, 1
            continue
        if some:
            parts.append(some)
            n += len(some)
        pos = min(pos + step, len(data))
        places.append((n, pos))
        if step > 1 and pos < len(data):
            before = gz.copy()
    return b"".join(parts), pos, why, places


def _inside(inner: bytes, whole: bool) -> list[tuple[int, int, str, dict[str, str], bytes]]:
    """Start, end, reason (none for a record), header fields and block of all records and gaps of a member."""
    out: list[tuple[int, int, str, dict[str, str], bytes]] = []
    pos, bad, why = 0, None, ""
    while pos < len(inner):
        one = parsed(inner, pos)
        if not isinstance(one, str) and not whole and not one[0].get("warc-block-digest", "").startswith("sha1:"):
            one = "no digest in a damaged member"
        if isinstance(one, str):
            if bad is None:
                bad, why = pos, one
            pos = inner.find(b"WARC/1.", pos + 1)
            pos = len(inner) if pos < 0 else pos
            continue
        if bad is not None:
            out.append((bad, pos, why, {}, b""))
            bad = None
        out.append((pos, one[2], "", one[0], one[1]))
        pos = one[2]
    return out + ([(bad, len(inner), why, {}, b"")] if bad is not None else [])


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict[str, str], bytes]]:
    """kind (record or gap), offset, length, reason, header fields, block; in order and covering all bytes. All of a member have its offset and length."""
    at, bad, why = 0, None, ""
    ahead = {b"\x1f\x8b\x08": -1, b"WARC/1.": -1}

    def following(start: int) -> int:
        """Where the next member or version line may begin. Each place is looked for once."""
        for mark, place in ahead.items():
            if place < start:
                found = data.find(mark, start)
                ahead[mark] = len(data) if found < 0 else found
        return min(ahead.values())

    while at < len(data):
        damaged = ""
        found: list[tuple[int, int, str, dict[str, str], bytes]] = []
        if data[at : at + 3] == b"\x1f\x8b\x08":
            inner, stop, failed, places = _member_at(data, at)
            found = _inside(inner, not failed)
            kept = [x for x in found if not x[2]]
            if kept and failed:
                # The rest of the member, where the next one may begin, counts from the last record on.
                stop = max(p for n, p in places if n <= kept[-1][1])
                found, damaged = found[: found.index(kept[-1]) + 1], failed
                failed = ""
            elif found and not kept:
                failed = failed or found[0][2]
        else:
            one = parsed(data, at)
            failed, stop = (one, at) if isinstance(one, str) else ("", one[2])
            if not failed:
                found = [(0, 0, "", *one[:2])]
        if failed:
            if bad is None:
                bad, why = at, failed
            at = following(at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at - bad, why, {}, b""
            bad = None
        for first, last, reason, fields, block in found:
            yield ("gap", at, stop - at, f"bytes {first} to {last} of the member: {reason}", {}, b"") if reason else ("record", at, stop - at, "", fields, block)
        at = stop
        if damaged and at < len(data):
            bad, why = at, damaged
            at = following(at)
            bad = bad if at > bad else None
    if bad is not None:
        yield "gap", bad, len(data) - bad, why, {}, b""


def with_revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` with ``_kf_first``: the id that holds the row's payload, null if the row holds it itself."""
    digest = F.sha1(F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8"))
    keyed = pages.select(F.col(id_col).alias("_kf_id"), digest.alias("_kf_sha"))
    same = keyed.groupBy("_kf_sha").agg(F.min("_kf_id").alias("_kf_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = checkpointed(same)
    marked = pages.withColumn("_kf_sha", digest).join(small_side(same, 80 * same.count()), "_kf_sha", "left")
    return marked.drop("_kf_sha").withColumn("_kf_first", F.when(~F.col(id_col).eqNullSafe(F.col("_kf_first")), F.col("_kf_first")))


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", records_per_file: int | None = None) -> str:
    """Write a record per row below ``path`` (a new folder in the shared one by default) and return the path.

    An archive holds ``records_per_file`` records at most; by default so many that their payloads, at the table's mean size, have ``FILE_BYTES``.
    """
    path = path or new_path(pages.sparkSession, "warc")
    if records_per_file is None:
        mean = pages.agg(F.avg(F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))))).first()[0] or 0
        records_per_file = int(max(1, min(MOST_RECORDS, FILE_BYTES // (mean + 1024))))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["id"], b["uri"], b["payload"], b["first"], strict=True)
            yield pd.DataFrame({"value": [member(record(None if pd.isna(i) else int(i), u, (p or "").encode(), None if pd.isna(f) else int(f), not pd.isna(f)))[:-1] for i, u, p, f in rows]})

    rows = with_revisits(pages.select(id_col, uri_col, payload_col), id_col, payload_col)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("payload"), F.col("_kf_first").cast("string").alias("first"))
    members = rows.mapInPandas(trimmed(packed), "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def read_warc(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """A row per record and per gap of all archives below ``path``; see ``READ``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                out, held = [], 0
                for kind, at, length, reason, h, block in salvage(bytes(content)):
                    revisit = h.get("warc-type") == "revisit"
                    payload = block.partition(b"\r\n\r\n")[2] if h.get("warc-type") == "response" else None
                    size = len(payload) if payload is not None else number(h.get("x-payload-length"))
                    digest = base32_sha1(payload) if payload is not None else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    out.append((where, kind, at, length, reason or None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), number(h.get("x-page-id")), number(h.get("x-refers-to-page")) if revisit else None, size, digest, payload))
                    held += len(block)
                    if held > 8 << 20:
                        yield _frame(out, names)
                        out, held = [], 0
                if out:
                    yield _frame(out, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    return files.select("path", "content").mapInPandas(trimmed(rows), READ)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for name in ("at", "length", "page_id", "refers_to", "payload_bytes"):
        out[name] = pd.array([None if x is None else x for x in out[name]], dtype="Int64")
    return out
