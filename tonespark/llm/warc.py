"""Content-addressed WARC archives.

An archive is two tables: ``payloads`` has the bytes of each distinct payload once, under their SHA-256, and
``headers`` has every record's exact header block. Records are put together again by joins on the digest; what is read
under a digest is hashed again and must match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.llm.scratch import keep

CRLF = "\r\n"
_ID = "urn:tonespark:page:"
#: A field of our own: the page's url in base64, where it can't stand in a line.
EXACT_URI = "Tonespark-Exact-URI"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four runs of 40 bits, each as eight digits."""
    hexed = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _clean(text: Column) -> Column:
    """A header value in one line: CR and LF are percent-encoded."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<" + _ID), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to the archive at ``path``.

    Of records with equal payloads of at least ``min_bytes``, that with the smallest page_id is the response (of
    repeated rows, one; a null page_id comes last) and the others revisit it; smaller payloads are all responses. Null
    html is an empty payload, a null url an empty one; a url with CR or LF is written percent-encoded, and once more in
    base64 as it is. An empty table makes an empty archive; other columns are not read.
    """
    payload = payload_of(F.col("html"))
    index = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha2(payload, 256).alias("sha256"), base32_sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    index = keep(index, "warc-index")
    firsts = index.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"))
    firsts = keep(firsts.select("sha256", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")), "warc-firsts")
    joined = index.join(firsts, "sha256")
    revisit = (F.col("bytes") >= min_bytes) & (F.col("row") != F.col("first_row"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2)
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Target-URI", _clean(F.col("url"))),
        F.when(F.col("url") != _clean(F.col("url")), line(EXACT_URI, F.base64(F.col("url").cast("binary")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("first_page"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF), http,
    )
    joined.select("sha256", revisit.alias("revisit"), header.alias("header")).write.parquet(f"{path}/headers")
    # Each task keeps one of equal payloads before the shuffle, so that a payload of very many pages stays small.
    once = pages.select(payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    once.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload table; a payload that doesn't have its digest is an error."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("sha256")
    return stored.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("payload and digest differ")).cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The exact bytes of every record (``record``); of revisits, also what their payload's bytes give
    (revisited_bytes, revisited_digest).

    A response's block holds its payload; a revisit's payload is found under its digest.
    """
    headers = spark.read.schema("sha256 string, revisit boolean, header string").parquet(f"{path}/headers")
    stored = _payloads(spark, path)
    end, none = F.lit(CRLF * 2).cast("binary"), F.lit(None)
    whole = headers.where("not revisit").join(stored, "sha256").select(
        F.concat(F.col("header").cast("binary"), F.col("payload"), end).alias("record"), none.cast("long").alias("revisited_bytes"), none.cast("string").alias("revisited_digest")
    )
    facts = stored.select("sha256", F.octet_length("payload").cast("long").alias("revisited_bytes"), base32_sha1(F.col("payload")).alias("revisited_digest"))
    again = headers.where("revisit").join(facts, "sha256").select(F.concat(F.col("header").cast("binary"), end).alias("record"), "revisited_bytes", "revisited_digest")
    return whole.unionByName(again)


def _field(head: str, name: str) -> Column:
    """A field's value: lines end with CR LF, and nothing else ends one."""
    return F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to, read from the bytes of each record.

    Size and digest of a response's payload are taken from its block. A record is an error if its block isn't as long as
    its header says, or its payload doesn't have the length and digest that its headers name.
    """
    split = records.select("*", F.substring_index(F.col("record").cast("string"), CRLF * 2, 1).alias("head"))
    at = F.octet_length("head") + 5
    split = split.select("*", F.substr("record", at, F.octet_length("record") - at - 3).alias("block"), F.substr("record", F.octet_length("record") - 3, F.lit(4)).alias("tail"))
    split = split.select("*", F.substring_index(F.col("block").cast("string"), CRLF * 2, 1).alias("http"))
    page = lambda name: F.nullif(F.regexp_extract(_field("head", name), f"^<{_ID}(.*)>$", 1), F.lit("null")).cast("long")
    revisit, exact = _field("head", "WARC-Type") == "revisit", _field("head", EXACT_URI)
    payload = F.substr("block", F.octet_length("http") + 5, F.octet_length("block"))
    told = split.select(
        _field("head", "WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page_id"),
        F.when(exact != "", F.unbase64(exact).cast("string")).otherwise(_field("head", "WARC-Target-URI")).alias("url"),
        F.when(revisit, page("WARC-Refers-To")).alias("refers_to"),
        F.when(revisit, F.col("revisited_bytes")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("revisited_digest")).otherwise(base32_sha1(payload)).alias("payload_digest"),
        (
            (_field("head", "Content-Length").cast("long") == F.octet_length("block")) & (F.col("tail") == F.lit(CRLF * 2).cast("binary"))
            & (~revisit | (F.octet_length(payload) == 0))
        ).alias("framed"),
        F.substring(_field("head", "WARC-Payload-Digest"), 6, 32).alias("told_digest"), _field("http", "Content-Length").cast("long").alias("told_bytes"),
    )
    good = F.col("framed") & (F.col("told_digest") == F.col("payload_digest")) & (F.col("told_bytes") == F.col("payload_bytes"))
    digest = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("record contradicts its header")).cast("string"))
    return told.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
