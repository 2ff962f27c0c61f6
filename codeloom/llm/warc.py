"""Content-addressed WARC archive: payload bytes once per strong digest, exact record headers apart.

Two Parquet tables under one folder: ``payloads`` (SHA-256, bytes) holds every distinct payload once, ``records``
holds each record's header bytes and the digest of its payload. A record is rebuilt by joining the two and
writing header, block and the closing CRLFs; a revisit's block is empty, as its header says. Every payload is
hashed again when it is read, and a mismatch raises.

Only narrow digest rows meet in joins and in the choice of the response, and they are salted, so the records of a payload that a
third of all rows share are not one task's; equal payloads are reduced to one inside each task before they are shuffled.

Defined results: a null html is an empty payload; payloads under ``min_revisit`` bytes are always responses; of
equal payloads the largest page_id is the response (rows that repeat that page_id are responses too, and a null
page_id is below all others); rows that repeat a page_id, or have none, share a record id; CR and LF in a url are
percent-encoded in the header; a very long payload is read whole; an empty table gives an empty archive; other columns
are ignored. ``write_warc`` writes the archive as plain WARC files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import materialise, salted_join, shared_dir

MIN_REVISIT = 1000
#: Digests (130 bytes each) that are broadcast to the records; more are joined under salts.
SMALL_DIGESTS = 200_000
CRLF = "\r\n"


def _line(name: str, *parts) -> F.Column:
    return F.concat(F.lit(f"{name}: "), *parts, F.lit(CRLF))


def _uri(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(spark: SparkSession, pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``payloads`` and ``records`` of pages (page_id, url, html) under ``path``."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    source = pages.select("page_id", "url", payload.alias("payload"))
    hashed = source.withColumn("digest", F.sha2("payload", 256))
    hashed.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")

    keyed = hashed.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    owners = keyed.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    owners = materialise(spark, owners.select("digest", "owner"), "warc-owners")
    joined = salted_join(spark, keyed, owners, "digest", F.xxhash64("page_id", "url"), SMALL_DIGESTS, how="left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    uri = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uri(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _uri(F.col("owner"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(CRLF),
    )
    joined.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    return stored.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary")).alias("payload"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/records")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the exact bytes of each record."""
    is_response = F.decode("header", "UTF-8").contains("WARC-Type: response" + CRLF)
    block = F.when(is_response, F.col("payload")).otherwise(F.lit(b""))
    end = F.lit((CRLF + CRLF).encode())
    return _records(spark, path).join(_verified(spark, path), "digest").select("page_id", F.concat("header", block, end).alias("record"))


def write_warc(spark: SparkSession, path: str, out: str) -> None:
    """The archive's records as WARC files under ``out``. A record ends with two line ends, which are the sink's separator."""
    text = F.decode(F.substring("record", F.lit(1), F.octet_length("record") - 4), "UTF-8")
    reconstruct(spark, path).select(text.alias("value")).write.option("lineSep", CRLF + CRLF).text(out)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload as stored, record_type, refers_to."""
    facts = _verified(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    text = F.decode("header", "UTF-8")
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n", 1)
    heads = _records(spark, path).select("page_id", "digest", F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"))
    facts = materialise(spark, facts, "warc-facts")
    return salted_join(spark, heads, facts, "digest", F.xxhash64("page_id"), SMALL_DIGESTS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(spark: SparkSession, pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the archive in the shared folder and return its index as read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark, pages, path, min_revisit)
    return read_index(spark, path)
