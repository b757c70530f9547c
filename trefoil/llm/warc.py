"""WARC archives in which later copies of a payload are revisit records.

Writing never moves payloads that need not move. Headers alone (page, address,
digest, size) are shuffled by payload digest; the smallest page of a digest
becomes its response, every other header becomes a revisit record that refers to
it, and revisit records are written from headers only. Payloads are then read
once more and those of the responses are written.

Each archive is plain text of records. Every record begins with the version line
and a ``WARC-Warcinfo-ID`` that is drawn anew for each write. No payload can know
it, so the reader lets Spark split the files at that prefix, any number of tasks
per file, and then holds every record against its own ``Content-Length`` and
digest. A record that fails stops the job.

Defined cases: a null payload is empty; payloads under ``min_bytes`` are always
responses; null page ids come last when the smallest is sought and stay null;
repeated rows give one response and else revisits, or only responses if they are
small; a null address becomes an empty target. An empty table gives an archive
with the one information record.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.numbering import repeat_rows
from ..sources.shared import materialise, new_path

END = "\r\n"
MIN_BYTES = 100


def _record_id(kind: str, *parts: Column) -> Column:
    """A name-based identifier of the write, the page and the copy."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def _line(name: str, value: Column) -> Column:
    """One header line, absent where the value is null."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)))


def _prefix(run: str) -> str:
    return f"WARC/1.1{END}WARC-Warcinfo-ID: <urn:uuid:{run}>{END}"


def _record(run: str, date: str, kind: str, block: Column, *lines: Column) -> Column:
    return F.concat(
        F.lit(f"{_prefix(run)}WARC-Type: {kind}{END}WARC-Date: {date}{END}"), *lines,
        _line("Content-Length", F.octet_length(block)), F.lit(END), block,
    )


def _http(size: Column) -> Column:
    """Header block of the HTTP answer."""
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        size.cast("string"), F.lit(END + END),
    )


def _target(url: Column) -> Column:
    # A line break inside an address would end its header line.
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "")


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES,
) -> tuple[str, str]:
    """Write ``pages`` as archives; returns their folder and the identifier of the write."""
    spark = pages.sparkSession
    run, path = str(uuid.uuid4()), new_path(spark, "warc")
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page"), _target(F.col(url)).alias("url"), body.alias("body")
    ).withColumns({"digest": F.sha2(F.col("body"), 256), "size": F.octet_length("body").cast("long")})

    # Equal headers fold into one row with a count, before and after the shuffle by digest.
    headers = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size", "page", "url").agg(F.count(F.lit(1)).alias("copies"))
    headers = materialise(headers, "headers")
    rank = F.struct(F.col("page").isNull(), "page", "url")
    first = headers.groupBy("digest").agg(
        F.min(F.struct(rank.alias("rank"), "copies")).alias("first"), F.sum("copies").alias("total")
    ).where("total > 1")
    # Only digests that recur, each once; written, so that Spark knows their size and may split the other side.
    first = materialise(
        first.select("digest", F.col("first.rank.page").alias("first_page"), F.col("first.rank.url").alias("first_url"),
                     (F.col("first.copies") > 1).alias("folded")), "originals",
    )
    is_first = F.col("page").eqNullSafe(F.col("first_page")) & (F.col("url") == F.col("first_url"))

    def response_id(page, url, copy=F.lit(None)):
        # Only small responses may repeat; their copies are told apart.
        return _record_id(f"{run}r", page, url, F.col("digest"), copy)

    revisits = headers.join(first, "digest").withColumn("n", F.col("copies") - F.when(is_first, 1).otherwise(0))
    revisits = repeat_rows(revisits.select("page", "url", "digest", "size", "first_page", "first_url", "n"), "n")
    revisit_text = _record(
        run, date, "revisit", _http(F.col("size")),
        _line("WARC-Record-ID", _record_id(f"{run}v", F.col("page"), F.col("url"), F.monotonically_increasing_id())),
        _line("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"),
        _line("WARC-Refers-To", response_id(F.col("first_page"), F.col("first_url"))),
        _line("WARC-Refers-To-Target-URI", F.col("first_url")), F.lit(f"WARC-Refers-To-Date: {date}{END}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _line("X-Page-ID", F.col("page")), _line("X-Refers-To-Page-ID", F.col("first_page")),
    )

    def response_text(df, copy=F.lit(None)):
        return df.select(_record(
            run, date, "response", F.concat(_http(F.col("size")), "body"),
            _line("WARC-Record-ID", response_id(F.col("page"), F.col("url"), copy)),
            _line("WARC-Target-URI", F.col("url")),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            F.lit(f"Content-Type: application/http; msgtype=response{END}"), _line("X-Page-ID", F.col("page")),
        ).alias("value"))

    matched = rows.join(first, "digest", "left")
    alone = F.col("folded").isNull() | (F.col("size") < min_bytes)
    small_copy = F.when(F.col("size") < min_bytes, F.monotonically_increasing_id())
    responses = response_text(matched.where(alone | (is_first & ~F.col("folded"))), small_copy)
    # An original that itself is repeated is written once: its payload is folded by its key.
    folded = rows.join(first.where("folded"), "digest").where(is_first & (F.col("size") >= min_bytes))
    folded = folded.groupBy("digest", "size", "page", "url").agg(F.max("body").alias("body"))
    information = spark.range(1).select(F.concat(
        F.lit(f"{_prefix(run)}WARC-Type: warcinfo{END}WARC-Date: {date}{END}WARC-Record-ID: <urn:uuid:{run}>{END}"
              f"Content-Type: application/warc-fields{END}Content-Length: 18{END}{END}format: WARC/1.1{END}")
    ).alias("value"))
    for part in (information, responses, response_text(folded), revisits.select(revisit_text.alias("value"))):
        part.write.mode("append").option("lineSep", END + END).text(path)
    return path, run


def read_archives(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Records of archives written by ``write_archives``, one row per page record.

    Columns: ``page_id``, ``url``, ``record_type``, ``record_id``, ``refers_to``
    (page) and ``refers_to_id``, ``payload_digest``, ``payload_bytes`` and
    ``payload`` (null for revisits).
    """
    raw = spark.read.option("lineSep", _prefix(run)).text(path).where(F.col("value") != "")
    head = F.substring_index("value", END + END, 1)
    raw = raw.select(head.alias("head"), F.expr(f"substr(value, char_length(substring_index(value, '{END * 2}', 1)) + 5)").alias("rest"))
    field = lambda name: F.nullif(F.regexp_extract("head", f"(?m)^{name}: ([^\\r\\n]*)", 1), F.lit(""))
    records = raw.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
        field("X-Page-ID").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"), field("WARC-Refers-To").alias("refers_to_id"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("Content-Length").cast("long").alias("length"), "rest",
    ).where("record_type <> 'warcinfo'")
    # The block, without the two line ends after it.
    block = F.expr("substr(rest, 1, char_length(rest) - 4)")
    records = records.withColumn("block", block).withColumn("http", F.substring_index("block", END + END, 1))
    records = records.withColumns({
        "payload_bytes": F.regexp_extract("http", "(?m)^Content-Length: ([0-9]+)", 1).cast("long"),
        "payload": F.when(F.col("record_type") == "response", F.expr("substr(block, char_length(http) + 5)")),
    })
    sound = (F.octet_length("block") == F.col("length")) & (
        (F.col("record_type") == "revisit")
        | ((F.octet_length("payload") == F.col("payload_bytes")) & (F.sha2("payload", 256) == F.col("payload_digest")))
    )
    return records.withColumn(
        "record_type", F.when(F.coalesce(sound, F.lit(False)), F.col("record_type"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged WARC record "), F.coalesce("record_id", F.lit("?"))))),
    ).select("page_id", "url", "record_type", "record_id", "refers_to", "refers_to_id", "payload_digest", "payload_bytes", "payload")
