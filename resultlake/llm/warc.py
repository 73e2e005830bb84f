"""WARC archives: captures are written as linked records, and assembled again from their links.

A capture is three records: the request, the response (or a revisit, which has no payload and refers
to the response that holds an equal one) and metadata; the first and the last name the middle one in
``WARC-Concurrent-To``.  Archives are files of a Spark text table whose line separator is the blank
lines after a record.  They are read by Spark's text reader with the begin of a record as the
separator, from any store that Spark reads, a large uncompressed file in ranges, and no more than a
record is held at once.

A payload may itself hold the separator, and a range that begins within one may miss a piece (so
may a reader's buffer where a separator repeats its own begin, which this one doesn't).  Where a
file's pieces all have the length that their headers state, and add up to the file, they are its records, as each begins where the one before ends; every other file is read
by lines in order and cut by the stated lengths.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import small

END, BEGIN = "\r\n\r\n", "WARC/1."
#: The digits of base32, the content types of records, and the profile of revisits.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REQUEST, RESPONSE, FIELDS = "application/http; msgtype=request", "application/http; msgtype=response", "application/warc-fields"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Keys of links that are broadcast, the most frequent ones.
HOT_KEYS = 100_000
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a binary column's SHA-1 (160 bits: 32 digits, four to five hex digits)."""
    hexed = F.transform(F.array(F.sha1(payload)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.conv(F.substring(h, p * 5 + 1, F.lit(5)), 16, 10).cast("int")))
    digit = lambda v, by: F.substring(F.lit(BASE32), F.shiftright(v, by).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(F.get(hexed, 0), lambda v: F.concat(*(digit(v, by) for by in (15, 10, 5, 0)))), "")


def _record_id(kind: str, *of: Column) -> Column:
    """A name of a record that a repeated attempt gives again."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in of)))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null has none."""
    return F.concat_ws("\r\n", *(F.concat(F.lit(f"{name}: "), value) for name, value in fields))


def _record(kind: str, id_: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    size = F.octet_length(block).cast("string")
    return F.concat(_lines(("WARC-Type", F.lit(kind)), ("WARC-Record-ID", id_), *fields, ("Content-Length", size)), F.lit(END), block)


def _encoded(uri: Column) -> Column:
    """Control characters and blanks as a percent sign and two hex digits."""
    each = F.transform(F.split(uri, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(uri.rlike(r"[\x00-\x20\x7F]"), F.array_join(each, "")).otherwise(uri)


def hot_join(rows: DataFrame, known: DataFrame, on: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """``rows`` joined to ``known``, which has a row a key and its number of rows ``n``.

    The most frequent keys, HOT_KEYS at most, are broadcast, so that no task gets all rows of one;
    the others shuffle.  ``how``: inner or left.
    """
    step = F.floor(F.log2(n) * 4)
    total, least = 0, 1 << 30
    for s in known.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        total += s["rows"]
        if total > HOT_KEYS:
            break
        least = s["step"]
    else:  # all of them
        return rows.join(F.broadcast(known), on, how)
    hot = step >= least
    often = F.broadcast(known.where(hot))
    named = F.lit(True)
    for c in on:  # rows without a key meet nothing, and don't go to the task of one
        named = named & F.col(c).isNotNull()
    rest = rows.where(named).join(often.select(on), on, "left_anti")
    out = rows.join(often, on).unionByName(rest.join(known.where(~hot), on, how))
    return out if how == "inner" else out.unionByName(rows.where(~named), allowMissingColumns=True)


def planned(pages: DataFrame, least_bytes: int = 0, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, url, payload binary, digest, keeper struct): what each capture is written from.

    ``keeper``: of the captures with an equal payload of ``least_bytes`` or more the one with the
    largest (id, url), null for a payload that only one has.  Digests and ids are grouped,
    payloads don't move.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    group = F.when(F.octet_length("payload") >= least_bytes, F.col("digest"))
    same = rows.select(group.alias("group"), F.struct("id", "url").alias("of")).where("group IS NOT NULL")
    same = same.groupBy("group").agg(F.max("of").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    same = shared.stage(same, "warc-groups")
    return hot_join(rows.withColumn("group", group), same, ["group"], "left").select("id", "url", "payload", "digest", "keeper")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE, compression: str = "gzip", html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> str:
    """Writes three records for each row below ``folder``; returns the archive's own folder.

    Payload: the HTML in UTF-8 (null: empty).  Of equal payloads of ``least_bytes`` or more the one
    with the largest id (ties: largest URL) is the response, the others revisit it.  Control
    characters and blanks of URLs are percent-encoded; a null URL or id gives no header line.  Rows
    that repeat id, URL and payload give equal records each; an empty table gives an empty archive.
    ``compression``: gzip (a file is one member) or none.
    """
    at = f"{folder}/warc-{uuid.uuid4().hex}"
    rows = planned(pages, least_bytes, html_col, url_col, id_col)
    me = F.struct("id", "url")
    revisits = F.col("keeper").isNotNull() & ~me.eqNullSafe(F.col("keeper"))
    url = _encoded
    own = _record_id("capture", F.col("id"), F.col("url"), F.col("digest"))
    of = _record_id("capture", F.col("keeper.id"), F.col("keeper.url"), F.col("digest"))
    uri, when = ("WARC-Target-URI", url(F.col("url"))), ("WARC-Date", F.lit(date))
    host = F.regexp_extract(url(F.col("url")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url(F.col("url")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    asked = F.coalesce(asked, F.lit(f"GET / HTTP/1.1{END}"))
    answered = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    request = _record("request", _record_id("request", F.col("own")), asked, when, uri, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit(REQUEST)))
    full = _record("response", F.col("own"), F.concat(answered, F.col("payload").cast("string")), when, uri, digest, ("Content-Type", F.lit(RESPONSE)))
    again = _record("revisit", F.col("own"), answered, when, uri, digest, ("WARC-Refers-To", of), ("WARC-Refers-To-Target-URI", url(F.col("keeper.url"))), ("WARC-Profile", F.lit(SAME_PAYLOAD)), ("Content-Type", F.lit(RESPONSE)))
    told = F.concat(_lines(("page-id", F.col("id").cast("string")), ("fetched-bytes", F.octet_length("payload").cast("string"))), F.lit("\r\n"))
    metadata = _record("metadata", _record_id("metadata", F.col("own")), told, when, uri, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit(FIELDS)))
    records = rows.withColumn("own", own).select(F.explode(F.array(request, F.when(revisits, again).otherwise(full), metadata)).alias("record"))
    records.select(F.concat(F.lit(f"{BEGIN}1\r\n"), "record").alias("value")).write.option("lineSep", END).text(at, compression=compression)
    return at


# --- reading ---------------------------------------------------------------------------------


def _walk(batches):
    """Records of whole files from their lines in order: a block is as long as its header states."""
    now, head, body, size, want = None, None, [], 0, None
    for b in batches:
        out = []
        for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if file != now:
                now, head, want = file, None, None
            if want is not None:
                body.append(line + b"\n")
                size += len(line) + 1
            elif head is None:
                head = [line.removeprefix(BEGIN.encode())] if line.startswith(BEGIN.encode()) else None
            elif line.rstrip(b"\r"):
                head.append(line)
            else:
                body, size, want = [], 0, _stated(head)
            if want is not None and size >= want:
                out.append((file, b"\n".join(head).rstrip(b"\r") + END.encode() + b"".join(body)[:want] + END.encode()))
                head, want = None, None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([p for _, p in out], pa.binary())], ["file", "piece"])


def _stated(head: list[bytes]) -> int:
    for line in head:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return 0


def _field(name: str, head: str = "head") -> Column:
    """A header field's value by its name in any case; null where it has no line."""
    return F.nullif(F.trim(F.regexp_extract(head, f"(?im)^{name}:([^\\r\\n]*)", 1)), F.lit(""))


def _parsed(pieces: DataFrame) -> DataFrame:
    """With head, block and ``whole``, whether the block is as long as stated, instead of the piece."""
    end = F.instr("text", END)
    rows = pieces.withColumn("text", F.col("piece").cast("string")).withColumn("head", F.when(end > 0, F.substring(F.col("text"), F.lit(1), end - 1)).otherwise(F.col("text")))
    rows = rows.withColumn("from", F.octet_length("head") + len(END)).withColumn("stated", F.expr(r"try_cast(trim(regexp_extract(head, '(?im)^content-length:([^\\r\\n]*)', 1)) AS BIGINT)"))
    # a whole record is followed by blank lines; before a file's first record there is nothing
    left = F.octet_length("piece") - F.col("from")
    sound = (left == F.col("stated") + len(END)) & F.col("text").endswith(END)
    whole = F.coalesce(sound, F.lit(False)) | (F.octet_length("piece") == 0)
    block = F.substring(F.col("piece"), F.col("from") + 1, F.coalesce(F.col("stated"), F.lit(0)).cast("int"))
    return rows.select(*(c for c in pieces.columns if c != "piece"), "head", whole.alias("whole"), F.coalesce(block, F.lit(b"")).alias("block"))


FIELD_NAMES = {"id": "WARC-Record-ID", "type": "WARC-Type", "uri": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def _is_capture() -> Column:
    return F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False))


def _named(parsed: DataFrame) -> DataFrame:
    """With a record's header fields instead of its head."""
    concurrent = F.transform(F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:([^\r\n]*)"), F.lit(1)), lambda c: F.trim(c))
    return parsed.select(*(c for c in parsed.columns if c not in ("head", "block")), *(_field(name).alias(c) for c, name in FIELD_NAMES.items()), concurrent.alias("concurrent"), "block")


class Archive:
    """The records of an archive: any WARC 1.x files that Spark's text reader opens, compressed ones too.

    ``heads``: header fields of every record, staged, with the block of all but captures;
    ``records``: the same with every block, read again.
    """

    def __init__(self, spark: SparkSession, path: str):
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("from"), F.col("_metadata.file_block_length").alias("length")]
        raw = spark.read.option("lineSep", BEGIN).text(path).select(*place, F.col("value").cast("binary").alias("piece"))
        pieces = _named(_parsed(raw.select("file", F.octet_length("piece").alias("bytes"), (F.col("length") == F.col("size")).alias("one"), "size", "piece")))
        light = F.when(~_is_capture(), F.col("block"))
        kept = ["file", *FIELD_NAMES, "concurrent", "block"]
        heads = shared.stage(pieces.withColumn("block", light), "warc-heads")
        checked = heads.groupBy("file").agg(F.min("whole").alias("whole"), (F.sum("bytes") + (F.count("*") - 1) * len(BEGIN)).alias("sum"), F.max("size").alias("size"), F.min("one").alias("one"))
        broken = shared.stage(checked.where("NOT whole OR (NOT one AND sum <> size)").select("file"), "warc-broken")
        self.heads, self.records = heads.select(kept), pieces.select(kept)
        if not broken.isEmpty():
            listed = small(broken, HOT_KEYS)
            lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("line"))
            lines = lines.join(listed, "file", "left_semi").repartition("file").sortWithinPartitions("file", "from", "nth")
            mended = _named(_parsed(lines.select("file", "line").mapInArrow(_walk, "file string, piece binary"))).select(kept)
            self.heads = self.heads.join(listed, "file", "left_anti").unionByName(shared.stage(mended.withColumn("block", light), "warc-heads"))
            self.records = self.records.join(listed, "file", "left_anti").unionByName(mended)
        self.heads, self.records = self.heads.where("id IS NOT NULL"), self.records.where("id IS NOT NULL")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, type, uri, date, digest, refers_to, concurrent array, block) of an archive's records.

    Pieces without a record id (what precedes the first record) are none.
    """
    return Archive(spark, path).records


def _owners(links: DataFrame) -> DataFrame:
    """(id, owner): of each request and metadata record the capture that it belongs to.

    ``links`` (id, capture boolean, concurrent).  A link counts in either direction; a record without
    a link to a capture belongs to that of a record that it is linked to.  Of several the least name.
    """
    pairs = links.select("id", F.explode("concurrent").alias("other"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    heads = links.where("capture").select(F.col("id").alias("other")).distinct()
    direct = both.join(heads, "other").groupBy("id").agg(F.min("other").alias("owner"))
    over = both.join(direct.select(F.col("id").alias("other"), "owner"), "other").groupBy("id").agg(F.min("owner").alias("owner")).join(direct.select("id"), "id", "left_anti")
    return direct.unionByName(over)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(capture struct, payload, payload_bytes, payload_digest, http, requests array, metadata array): a nested row a capture.

    ``capture``: id, type (response or revisit), uri, date, digest and refers_to; ``payload``: bytes after
    the message's head (null for a revisit) with their number and base32 SHA-1, ``http``: that head;
    ``requests``, ``metadata``: structs (id, uri, date, block) in order of id, distinct.  A capture named
    by no other record has empty arrays; requests and metadata without a capture are left out.
    """
    archive = Archive(spark, path)
    heads = archive.heads.where("type IN ('request', 'metadata', 'response', 'revisit')")
    links = heads.select("id", _is_capture().alias("capture"), "concurrent")
    sides = heads.where(~_is_capture()).join(_owners(links), "id")
    about = F.struct("id", "uri", "date", "block")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, about)))
    sides = sides.groupBy("owner").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    main = archive.records.where(_is_capture()).withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    body = F.when(F.col("type") == "response", F.expr(f"substring(block, octet_length(http) + {len(END) + 1})"))
    main = main.select(F.struct("id", "type", "uri", "date", "digest", "refers_to").alias("capture"), body.alias("payload"), "http", F.col("id").alias("owner"))
    # before the join, so that a reader of these two alone doesn't move payloads
    main = main.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))))
    nested = main.join(sides, "owner", "left")
    filled = [F.coalesce(c, F.array().cast(sides.schema[c].dataType)).alias(c) for c in ("requests", "metadata")]
    return nested.select("capture", "payload", "payload_bytes", "payload_digest", "http", *filled)


def page_of(metadata: str = "metadata") -> Column:
    """The page id that a capture's first metadata record states."""
    block = F.get(F.col(metadata), 0)["block"].cast("string")
    return F.nullif(F.trim(F.regexp_extract(block, r"(?m)^page-id:([^\r\n]*)", 1)), F.lit(""))


def resolved(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, n_records) of ``captures``.

    Size and digest of a response are those of the payload that was read; a revisit has those of the
    response that it refers to, found by record id (its own header's where that is not there).
    """
    rows = found.select(
        F.col("capture.id").alias("id"), page_of().cast(id_type).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("target"), "capture.uri", (1 + F.size("requests") + F.size("metadata")).cast("bigint").alias("n_records"),
        F.regexp_replace("capture.digest", "^sha1:", "").alias("stated"),
    )
    rows = shared.stage(rows, "warc-captures")
    named = rows.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("n"))
    whole = rows.where("record_type = 'response'").select(F.col("id").alias("target"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")).dropDuplicates(["target"])
    known = shared.stage(named.join(whole, "target", "left"), "warc-targets")
    out = hot_join(rows, known, ["target"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "of_digest", "stated").alias("payload_digest"), "record_type", F.col("of").alias("refers_to"), "uri", "n_records")


_DIGITS = "list_transform(range(0, 32), lambda j: substr('" + BASE32 + "', CAST((CAST('0x' || substr(h, CAST((j // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - j % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1))"
#: The same rows from the table itself.
CAPTURES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string({_DIGITS}, '') AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, CAST(3 AS BIGINT) AS n_records FROM p
"""
