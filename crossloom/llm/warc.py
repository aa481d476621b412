"""WARC archives with revisit records: equal payloads are stored once, and other records refer to the stored one.

Headers (id, digest, URI) are stored and shuffled by digest: one row for each payload and task reaches a digest's
aggregate, so a payload that a third of all records share is no hot group; the join of headers with originals is a plain
equi-join, which AQE splits. Payloads meet its result by id and digest, so they never gather by digest. Archives are written by Spark's own text sink, whose line separator is the blank lines that
end a WARC record. So any store that Spark writes serves, and its commit protocol covers lost executors. A file holds
``RECORDS_PER_FILE`` records of up to ``LARGE`` bytes, or of larger ones so many that they have ``FILE_BYTES`` bytes at most; it is
compressed as a whole. Reading inflates a file piece by piece.

Cases: a null payload is an empty one. Of equal payloads of at least ``min_bytes`` bytes, the largest id is the
response; rows that repeat that id and payload are responses too. A null id is smaller than every other; if all
ids of a payload are null, its rows are responses. Payloads of any length that a Spark string takes are written whole. An empty table writes no records and reads back empty. Of the
input's other columns only the URL is read, where it is named; none of them clashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.runtime import materialise, prepare

RECORDS_PER_FILE = 2000
LARGE = 256 << 10
FILE_BYTES = 512 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "
_READ = "page_id long, record_type string, payload_digest string, refers_to long, target_uri string, payload_bytes long, payload string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1: five hex digits are four base32 digits."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(records: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = None) -> DataFrame:
    """id, payload, payload_bytes, payload_digest, record_type, refers_to, target_uri, refers_uri for each row; the URIs are those of the row
    and of its response, null without ``url_col``.

    Headers are stored once, shuffled by digest, and revisits joined there to their originals. Only what these joins find, a row for each
    revisit, meets the payloads again, by id and digest: no task gets the payloads of one digest."""
    url = F.regexp_replace(F.col(url_col), r"[\r\n]", "") if url_col else F.lit(None).cast("string")
    rows = records.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), url.alias("target_uri"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    headers = materialise(rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest", "target_uri"), "warc-headers")
    # Payloads found once (the bulk) need no join: only digests held twice or more are joined.
    originals = headers.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.max_by("target_uri", "page_id").alias("original_uri"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")
    revisits = headers.select("page_id", "payload_digest").join(originals, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    marks = revisits.dropDuplicates(["page_id", "payload_digest"]).withColumnsRenamed({"page_id": "_id", "payload_digest": "_digest"})
    joined = rows.join(marks, rows["page_id"].eqNullSafe(marks["_id"]) & (rows["payload_digest"] == marks["_digest"]), "left")
    revisit = F.col("original").isNotNull()
    return joined.select(
        F.col("page_id").alias(id_col), F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"), "target_uri", F.when(revisit, F.col("original_uri")).alias("refers_uri"),
    )


def write_archives(resolved: DataFrame, out: str, id_col: str = "page_id", records_per_file: int = RECORDS_PER_FILE, date: str | None = None) -> None:
    """Write gzip-compressed WARC files with fresh headers, dated ``date`` or now. A revisit's block holds the HTTP header only, and its
    WARC header names its response. A record's id follows from the row's, so rows that repeat an id share it."""
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), c), F.lit(""))
    own = F.col("record_type") == "response"
    now = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit(_END), F.coalesce("payload", F.lit("")))
    profile = F.when(~own, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), line("WARC-Record-ID", urn(F.col(id_col))), line("WARC-Date", now), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(~own, urn(F.col("refers_to")))), line("WARC-Refers-To-Target-URI", F.col("refers_uri")), line("WARC-Profile", profile),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(_END),
    )
    longest = resolved.agg(F.max("payload_bytes")).first()[0] or 0

    def write(rows: DataFrame, each: int, mode: str) -> None:
        rows.select(F.concat(head, block).alias("value")).write.mode(mode).option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", each).text(out)

    write(resolved.where(F.col("payload_bytes") <= LARGE) if longest > LARGE else resolved, records_per_file, "errorifexists")
    if longest > LARGE:
        write(resolved.where(F.col("payload_bytes") > LARGE), max(1, min(records_per_file, FILE_BYTES // longest)), "append")


def _inflated(blob: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """The content of a gzip file of one member or several, piece by piece."""
    inflate = zlib.decompressobj(31)
    for i in range(0, len(blob), piece):
        data = blob[i : i + piece]
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def _parse(pieces: Iterator[bytes], payloads: bool) -> Iterator[tuple]:
    """Records as rows of ``_READ``; of a record that is longer than what has been inflated, more pieces are fetched."""
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at:
            del held[:at]
            at = 0
        held += piece
        return True

    number = lambda x: None if x is None or x == "<urn:record:none>" else int(x[len("<urn:record:") : -1])
    while at < len(held) or more():
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("a WARC record is cut off")
                return
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        at = end + 4
        while len(held) < at + n + 4 and more():
            pass
        if len(held) < at + n:
            raise ValueError("a WARC record is cut off")
        body = held.find(b"\r\n\r\n", at, at + n) + 4
        length = next(int(x[16:]) for x in held[at:body].decode().split("\r\n") if x.startswith("Content-Length: "))
        own = fields["WARC-Type"] == "response"
        payload = held[body : at + n].decode() if payloads and own else None
        at += n + 4
        yield number(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), length, payload


def read_archives(spark: SparkSession, where: str, payloads: bool = True) -> DataFrame:
    """Records of gzip-compressed WARC files: page_id, record_type, payload_digest, refers_to, target_uri, payload_bytes (the full
    payload's, also of revisits), payload (of responses; null without ``payloads``)."""
    prepare(spark)
    schema = spark.createDataFrame([], _READ).schema

    def parse(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for r in _parse(_inflated(batch.column(0)[k].as_py()), payloads):
                    rows.append(r)
                    size += len(r[-1] or "")
                    if len(rows) == 500 or size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(where).select("content")
    return files.mapInArrow(parse, schema)


def read_resolved(spark: SparkSession, where: str) -> DataFrame:
    """All records with their full payloads: a revisit's is fetched from the response that it refers to."""
    records = read_archives(spark, where)
    responses = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(F.max("payload").alias("original"))
    revisits = records.where("record_type = 'revisit'").drop("payload")
    found = revisits.join(responses, F.col("payload_digest") == F.col("digest"), "left").withColumn("payload", F.col("original"))
    return records.where("record_type = 'response'").unionByName(found.drop("digest", "original"))
