"""WARC archives: pages to records with revisits, and records back from archives by boundary-chain verification.

`write_warc` writes a record for each page through Spark's text writer. Of pages with equal payloads (by SHA-256) of at least
`least_bytes` bytes the one with the smallest id is a response; the others become revisit records without a body that
name it. The groups of equal payloads go to the pages by broadcast only up to BROADCAST_ROWS groups, beyond that by a join.

`read_warc` cannot trust the magic line, as payloads may hold it. It reads archives with that line as separator, so that
Spark splits large files and each line is a candidate record:
1. tasks emit, for each candidate whose header can be read, where its successor must begin; links that stay inside a split are
   followed there, so a candidate points to the first place outside its split. Offsets are relative to the split's first line;
   sums over the splits before it make them absolute.
2. pointer jumping from each file's start, doubling the links each round, retains what is reachable. A payload's own
   magic is never reached. A file whose chain doesn't end with it is an error, or left out with `damaged="skip"`.
3. a second reading goes from the verified entry of each split from record to record. Pieces of records that cross splits
   are gathered by record.
The tables between are small: a row for each candidate, then for each split.

Edge cases: null payloads are empty; null urls leave the header out; line breaks in urls become blanks; null ids come back as
null and count as largest; of repeated rows with the smallest id all are responses; columns besides these don't matter; empty
tables give archives without records; a payload must fit in one task.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pledgelens.llm.common import by_value, clean_text, materialise, scratch_dir

by_value(__name__)

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_ROWS = 1_000_000
#: Splits whose entries go to the tasks at once; more of them are read in several rounds.
SPLITS = 500_000
#: Digits of a content length; a payload may say anything.
LONGEST_LENGTH = 17


def base32_sha1(body: Column) -> Column:
    """The 160 bits of a SHA-1 as 32 base32 letters, each five bits out of five hex digits."""
    step = F.array(*map(F.lit, (32768, 1024, 32, 1)))

    def letters(h: Column) -> Column:
        def letter(i: Column) -> Column:
            five = F.conv(F.substr(h, (5 * F.floor(i / 4) + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
            return F.substr(F.lit(ALPHABET), (F.floor(five / F.element_at(step, i % 4 + 1)) % 32 + 1).cast("int"), F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    return F.transform(F.array(F.sha1(body)), letters)[0]


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def page_of(record: Column, kind: str) -> Column:
    """The id in a record id; null for the record of a null id and for null."""
    return F.regexp_extract(record, "^<urn:page:(.*)>$", 1).try_cast(kind)


def write_warc(pages: DataFrame, to: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", compression: str = "none") -> None:
    """Archives in the folder `to`, a record for each page."""
    body = clean_text(payload)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("size"))
    rows = rows.withColumn("same", F.when(F.col("size") >= least_bytes, F.sha2("body", 256)))
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = materialise(groups.where("n > 1 AND first IS NOT NULL").select("same", "first"))
    small = groups.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(groups) if small else groups, "same", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("body")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", record_id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("body")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END.decode()).option("compression", compression).text(to)


def parse_header(header: bytes) -> dict[str, str] | None:
    """Fields by lower-case name, None unless each line is a field and there is a content length that fits 64 bits."""
    fields = {}
    for line in header.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return fields if length.isascii() and length.isdecimal() and len(length) <= LONGEST_LENGTH else None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (the split's place) and value, what stands between two magic lines, in the order of the file."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _linked(lines: DataFrame) -> DataFrame:
    """For each split its length (at null), and for each candidate the place `hop` outside the split that its chain leads to."""
    header = F.substring_index("value", END.decode(), 1)
    size = F.octet_length("value").cast("long")
    rows = lines.select("file", "block", size.alias("size"), F.when(F.octet_length(header) < size, header.cast("binary")).alias("header"))

    def links(file: str, block: int, places: list[int], targets: list[int | None], length: int) -> pa.RecordBatch:
        hops, known = {}, set(places)
        for at, to in zip(reversed(places), reversed(targets)):
            # a successor inside the split must be a candidate that itself leads out
            hops[at] = hops.get(to) if to in known else to if to is not None and to >= length else None
        found = [(at, to) for at, to in hops.items() if to is not None]
        at, to = [None, *(a for a, _ in found)], [length, *(t for _, t in found)]
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(to, pa.int64())], ["file", "block", "at", "hop"])

    def run(batches):
        split, places, targets, length = None, [], [], 0
        for batch in batches:
            for file, block, size, header in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, block) != split:
                    if split is not None:
                        yield links(*split, places, targets, length)
                    split, places, targets, length = (file, block), [], [], 0
                if length or block:  # no magic stands before a file's first line
                    fields = parse_header(header) if header is not None else None
                    places.append(length)
                    targets.append(None if fields is None else length + len(header) + 2 * len(END) + int(fields["content-length"]) + len(MAGIC))
                length += size + len(MAGIC)
        if split is not None:
            yield links(*split, places, targets, length)

    return rows.mapInArrow(run, "file string, block long, at long, hop long")


def verified_entries(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """(file, block, entry): each split, and the place in it of the first record that is reachable from the file's start."""
    links = materialise(_linked(_lines(spark, path)))
    splits = links.where("at IS NULL").select("file", "block", F.col("hop").alias("length"))
    order = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("base", F.sum("length").over(order) - F.col("length"))
    splits = materialise(splits.withColumn("total", F.sum("length").over(Window.partitionBy("file"))))
    moved = links.where("at IS NOT NULL").join(splits.select("file", "block", "base"), ["file", "block"])
    moved = moved.select("file", "block", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("hop")).alias("hop"), "base")
    start = splits.where("block = 0").select("file", F.lit(len(MAGIC)).cast("long").alias("at"))
    # only places that some link leads to, and starts, can be entries
    targets = moved.select("file", F.col("hop").alias("at")).union(start).distinct()
    doors = materialise(moved.join(targets, ["file", "at"], "left_semi"))
    reached, jump = materialise(start), doors.select("file", "at", "hop")
    while not jump.isEmpty():
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("hop").alias("at"))
        reached = materialise(reached.union(ahead).distinct())
        onward = jump.select("file", F.col("at").alias("hop"), F.col("hop").alias("beyond"))
        jump = materialise(jump.join(onward, ["file", "hop"]).select("file", "at", F.col("beyond").alias("hop")))
    entries = doors.join(reached, ["file", "at"]).select("file", "block", (F.col("at") - F.col("base")).alias("entry"), "hop")
    out = materialise(splits.join(entries, ["file", "block"], "left"))
    # an archive without records has one split with an empty line
    ends = out.groupBy("file").agg(F.max("hop").alias("last"), F.max("total").alias("total"))
    broken = ends.where(f"coalesce(last, {len(MAGIC)}) <> total").select("file")
    if damaged == "raise" and (bad := broken.first()):
        raise ValueError(f"{bad['file']}: its records end before the file does")
    return out.join(broken, "file", "left_anti").select("file", "block", "entry")


FIELDS = "record_id string, record_type string, uri string, refers_to string, header_digest string, payload_bytes long, payload_digest string, payload binary"


def _record(raw: bytes, header: int, fields: dict[str, str], payloads: bool) -> tuple:
    block = raw[header + len(END) : len(raw) - len(END)]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(END)[2]
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    said = fields.get("warc-payload-digest")
    return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), said and said.rpartition(":")[2], len(block), digest, block if payloads else None)


def _records(lines: DataFrame, payloads: bool) -> DataFrame:
    """Whole records, and pieces of those that cross splits: `order` 0 for the end of one from before, 1 for the beginning of one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = lines.sparkSession.createDataFrame([], f"file string, block long, `order` int, piece binary, {FIELDS}").schema
    arrow = to_arrow_schema(schema)

    def walk(split: tuple[str, int, int | None], values):
        """The rows of one split's lines."""
        file, block, entry = split
        at, before, raw, need, header, fields = 0, [], None, 0, 0, {}
        for value in values:
            if raw is None and at == entry:
                raw = b""
            if raw is None:
                before += [MAGIC, value] if at or block else []
            else:
                if not raw:
                    header = value.find(END)
                    fields = parse_header(value[:header])
                    need = header + 2 * len(END) + int(fields["content-length"])
                    raw = [value]
                    have = len(value)
                else:
                    raw += [MAGIC, value]
                    have += len(MAGIC) + len(value)
                if have == need:
                    yield (file, block, None, None, *_record(b"".join(raw), header, fields, payloads))
                    raw = b""
            at += len(value) + len(MAGIC)
        if before:
            yield (file, block, 0, b"".join(before), *[None] * 8)
        if raw:
            yield (file, block, 1, b"".join(raw), *[None] * 8)

    def grouped(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for row in range(batch.num_rows):
                yield tuple(c[row].as_py() for c in columns)

    def run(batches):
        from itertools import groupby

        held, size = [], 0
        for split, rows in groupby(grouped(batches), key=lambda r: r[:3]):
            for made in walk(split, (r[3] for r in rows)):
                held.append(made)
                size += 200 + len(made[3] or b"") + len(made[-1] or b"")
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)

    return lines.mapInArrow(run, schema)


def _joined(pieces: DataFrame, payloads: bool) -> DataFrame:
    """The records whose pieces lie in several splits of a file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    order = Window.partitionBy("file").orderBy("block", "order")
    owner = F.last(F.when(F.col("order") == 1, F.col("block")), ignorenulls=True).over(order)
    parts = pieces.select("file", "block", "order", "piece", owner.alias("owner")).where("owner IS NOT NULL")
    whole = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "order", "piece"))).alias("parts"))
    raw = whole.select(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["piece"])).alias("raw"))
    schema = pieces.sparkSession.createDataFrame([], FIELDS).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for value in batch.column(0).to_pylist():
                header = value.find(END)
                fields = parse_header(value[:header])
                made = _record(value, header, fields, payloads)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow)], schema=arrow)

    return raw.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """A row for each record of the archives: its ids, type and digests, and with `payloads` its payload."""
    entries = verified_entries(spark, path, damaged)
    rounds, out = max(1, -(-entries.count() // SPLITS)), None
    names = [f.split()[0] for f in FIELDS.split(", ")]
    for k in range(rounds):
        own = F.pmod(F.xxhash64("file"), F.lit(rounds)) == k
        lines = _lines(spark, path).where(own).join(F.broadcast(entries.where(own)), ["file", "block"])
        read = materialise(_records(lines.select("file", "block", "entry", F.col("value").cast("binary")), payloads))
        part = read.where("`order` IS NULL").select(*names).unionByName(_joined(read.where("`order` IS NOT NULL"), payloads))
        out = part if out is None else out.unionByName(part)
    return out


def archive_dir(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return os.path.join(scratch_dir(spark), f"warc-{uuid.uuid4().hex}")


def page_records(records: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_matches: revisits get what their response holds."""
    mine = materialise(records.drop("payload"))
    said = materialise(mine.where("record_type = 'response'").select("record_id", "payload_bytes", "payload_digest").distinct())
    answers = said.select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("header_digest"), F.col("payload_bytes").alias("bytes"))
    seen = mine.where("record_type = 'revisit'").drop("payload_bytes").join(answers, ["refers_to", "header_digest"], "left")
    revisits = seen.select(page_of(F.col("record_id"), kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"), F.col("bytes").isNotNull().alias("digest_matches"))
    responses = mine.where("record_type = 'response'")
    first = responses.select(page_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"), (F.col("payload_digest") == F.col("header_digest")).alias("digest_matches"))
    return first.unionByName(revisits)
