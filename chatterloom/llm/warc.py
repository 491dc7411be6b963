r"""WARC archives: writing with revisit records, reading with a verified chain of boundaries.

Writing. Each page becomes one record. Of records with equal payloads of at
least ``least_revisit`` bytes, the one with the smallest id is a response and the
others are revisits, which name it and hold no payload. Only ids and digests are
grouped; pages are written where they are read. Spark's own text writer commits
the files (``\r\n\r\n`` ends a record), so lost tasks are redone, on any file system.

Reading. The magic may also stand inside a payload, so finding it proves nothing.
Tasks go over ranges of a file and emit, for every candidate with a well-formed
header, the offset of its successor; candidates that neither start the file nor
follow a record's end, and those whose successor is neither a record nor the end
of the file, go at once. A header may have any length: the headers of two
candidates never overlap, so all of them are searched in one pass. Inside a range, chains are followed on
the spot to the first offset beyond the range. Across ranges, pointer jumping
from offset 0 finds the entry of every range; a candidate is kept only if it lies
on the chain of its range's entry. Whatever was inside a payload is not. Reading
fails if the chain of a file ends before the file does, and resolving fails if a
revisit names a response that is not there; with ``strict=False`` the records
before the damage are given, and such revisits without ``payload_bytes``.

A file is one row of Spark's binary reader, read by one task, range after range,
and must fit it: the writer starts a new file every ``file_records`` records.
Larger records, in classes that grow sixteenfold, are written with as many fewer
to a file, so no file passes ``file_bytes`` but by a single record.

Defined cases: a null html is an empty payload, a null url an empty one; line
breaks in a url are percent-encoded; rows that repeat an id, and rows with a null
id, are responses unless a smaller id has the payload; an empty table gives an
empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.session import ship_package, written

MAGIC = b"WARC/1.1\r\n"  # fixed value of the format
GAP = "\r\n\r\n"
_MAGIC, _GAP = re.compile(re.escape(MAGIC)), re.compile(GAP.encode())
BROADCAST_ROWS = 200_000
RANGE_BYTES = 1 << 22


def write_archive(
    pages: DataFrame,
    folder: str,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_revisit: int = 100,
    file_records: int = 2048,
    file_bytes: int = 1 << 27,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Write ``pages`` as WARC files into ``folder``."""
    body = F.coalesce(F.col(html), F.lit(""))
    all_pages = pages.select(
        F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("html"),
        F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"),
    )
    slim = all_pages.filter(F.octet_length("html") >= least_revisit).select("id", "digest")
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    again = slim.join(first.drop("many"), "digest").filter("id > first").select("id", "digest", "first").distinct()
    again = written(again, "revisits")
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    marked = all_pages.join(F.broadcast(again) if few else again, ["id", "digest"], "left")

    is_again = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(is_again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_again, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("first"))),
        )).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_again, 0).otherwise(F.octet_length("html")).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(is_again, F.lit("")).otherwise(F.col("html")))
    # The most bytes of a record: line breaks in a url grow threefold, the rest of a header has about 500.
    most = F.octet_length("html").cast("bigint") + F.octet_length("url").cast("bigint") * 3 + 1024
    many, size_class = file_records, F.lit(0)
    while many > 1:
        size_class = size_class + F.when(most > file_bytes // many, 1).otherwise(0)
        many //= 16
    found = sorted(r[0] for r in all_pages.select(size_class.alias("c")).distinct().collect()) or [0]
    for c in found:
        rows = marked.filter(size_class == c).select(record.alias("value"))
        out = rows.write.mode("error" if c == found[0] else "append").option("lineSep", GAP)
        out.option("maxRecordsPerFile", max(1, file_records // 16**c)).text(folder)


def _field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*(.*?)\r?$", header)
    return found[1].decode("utf-8", "replace") if found else None


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


_SCHEMA = (
    "file string, offset long, range long, exit long, pre long, post long, record_type string, page_id long, uri string, "
    "refers_to long, header_digest string, payload_bytes long, payload_digest string"
)


def candidates_in(data: bytes | memoryview, low: int, high: int) -> list[dict]:
    """Records that may start in ``[low, high)``: their fields, the exit of their chain from
    the range, and an interval that holds the ``pre`` of every candidate whose chain passes here."""
    found, begin = {}, _MAGIC.search(data, low, high + len(MAGIC) - 1)
    while begin:
        at = begin.start()
        follows = at == 0 or data[max(at - 4, 0) : at] == b"\r\n\r\n"
        gap = _GAP.search(data, at) if follows else None
        header = bytes(data[at : gap.start()]) if gap else b""
        size = _field(header, b"Content-Length") or ""
        if size.isdigit():
            start, stop = gap.end(), gap.end() + int(size)
            next_ = stop + 4
            if data[stop:next_] == b"\r\n\r\n" and (next_ == len(data) or data[next_ : next_ + len(MAGIC)] == MAGIC):
                found[at] = {"offset": at, "next": next_, "header": header, "span": (start, stop)}
        begin = _MAGIC.search(data, at + 1, high + len(MAGIC) - 1)
    weight = dict.fromkeys(found, 1)
    for at, x in found.items():  # offsets ascend, and a successor lies after
        if x["next"] in found:
            weight[x["next"]] += weight[at]
    free, slot = 0, {}
    for at in reversed(found):
        x = found[at]
        if x["next"] in found:
            after = found[x["next"]]
            x["exit"], x["pre"] = after["exit"], slot[x["next"]]
            slot[x["next"]] += weight[at]
        else:
            x["exit"], x["pre"] = (x["next"] if x["next"] >= high else -1), free
            free += weight[at]
        slot[at], x["post"] = x["pre"] + 1, x["pre"] + weight[at]
    return list(found.values())


def read_archive(spark: SparkSession, folder: str, *, range_bytes: int = RANGE_BYTES, strict: bool = True) -> DataFrame:
    """``file, offset, record_type, page_id, uri, refers_to, payload_bytes, payload_digest`` of every
    record reachable from the start of its file; sizes and digests are those of the stored payload.
    A file with records that cannot be reached is an error unless ``strict`` is off."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                # The file stays where Arrow holds it; only headers are copied.
                path, data = batch.column(0)[r].as_py(), memoryview(batch.column(1)[r].as_buffer()).cast("B")
                for low in range(0, len(data), range_bytes):
                    rows = []
                    for x in candidates_in(data, low, min(low + range_bytes, len(data))):
                        payload, header = data[slice(*x["span"])], x["header"]
                        rows.append((
                            path, x["offset"], low // range_bytes, x["exit"], x["pre"], x["post"], _field(header, b"WARC-Type"),
                            _page(_field(header, b"WARC-Record-ID")), _field(header, b"WARC-Target-URI"),
                            _page(_field(header, b"WARC-Refers-To")), _field(header, b"WARC-Payload-Digest"),
                            len(payload), hashlib.sha256(payload).hexdigest(),
                        ))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = [c.strip().split()[0] for c in _SCHEMA.split(",")]
    kinds = [pa.int64() if c.strip().endswith("long") else pa.string() for c in _SCHEMA.split(",")]
    seen = written(files.select("path", "content").mapInArrow(scan, _SCHEMA), "candidates")
    entries = _entries(seen, files, range_bytes)
    if strict:  # the last record's exit is the length of its file
        ends = files.filter("length > 0").select(F.col("path").alias("file"), F.col("length").alias("at"))
        cut = ends.join(entries, ["file", "at"], "left_anti").first()
        if cut:
            raise ValueError(f"the records of {cut.file} do not reach its end")
    spot = entries.join(seen.select("file", F.col("offset").alias("at"), "range", F.col("pre").alias("entry")), ["file", "at"])
    kept = seen.join(spot.select("file", "range", "entry"), ["file", "range"]).filter("pre <= entry AND entry < post")
    return kept.select("file", "offset", "record_type", "page_id", "uri", "refers_to", "header_digest", "payload_bytes", "payload_digest")


def _entries(seen: DataFrame, files: DataFrame, range_bytes: int) -> DataFrame:
    """``file, at``: where the chain from the start of each file enters each range, by pointer jumping."""
    start = seen.filter("offset = 0").select("file", F.col("offset").alias("at"))
    jump = seen.filter("exit >= 0").select("file", F.col("offset").alias("at"), F.col("exit").alias("to"))
    doors = jump.select("file", F.col("to").alias("at")).unionByName(start).distinct()
    jump = written(jump.join(doors, ["file", "at"], "left_semi"), "jumps")
    reached = start
    longest = files.agg(F.max("length")).first()[0] or 0
    for round_ in range((longest // range_bytes + 1).bit_length()):  # the reached part of a chain doubles
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = written(reached.unionByName(further).distinct(), "reached")
        if round_ + 1 < (longest // range_bytes + 1).bit_length():
            twice = jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond")), ["file", "to"])
            jump = written(twice.select("file", "at", F.col("beyond").alias("to")), "jumps")
    return reached


def resolved(records: DataFrame, *, strict: bool = True) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; a revisit has the payload of its response.
    A revisit without its response is an error, or has no ``payload_bytes`` if ``strict`` is off."""
    given = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("size")
    )
    again = records.filter("record_type = 'revisit'").select(
        "page_id", "refers_to", F.substring_index("header_digest", ":", -1).alias("of")
    )
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    size = F.coalesce("size", lost.cast("bigint")) if strict else F.col("size")
    back = again.join(given.dropDuplicates(["refers_to", "of"]), ["refers_to", "of"], "left").select(
        "page_id", size.alias("payload_bytes"), F.col("of").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"
    )
    first = records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return first.unionByName(back)
