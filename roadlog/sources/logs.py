"""Text logs: topic dumps, keyword logs, fixed-offset logs and console output.

Readers keep files splittable. Where the order of lines matters, a line's place is its split's byte
offset in the file and its number inside the split, so no file has to be read as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digits, unescape
from ..operators.ordered import Ordered

# fixed values: marks of the log formats
MARK = "CreateTime"
BODY_MARKS = {"Incoming BSM is not from Emergency Response Vehicle (ERV)": "<BasicSafetyMessage>", "Receive BSM": "<BasicSafetyMessage>"}
NEEDED_MARKS = {"Successfully forwarded message to cloud via curl": "<BSMRequest>", "Forwarding message to cloud via curl": "<BSMRequest>"}
REQUEST, PORTS, PORT_FIELD, ADDRESSING = "Received: BSMRequest", "44444|44445|44446", "v2xhub_port", "to|V2xHub|port"
RECEIVED, IGNORED, IDENTIFIED, SENT = f"{REQUEST} [{PORT_FIELD}=", "IGNORE already Processed BSM", "FER-14", "FER-15"


def read_lines(spark: SparkSession, path, **options) -> DataFrame:
    """Lines with file, block (byte offset of the split) and line (order inside the split)."""
    return spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def read_topic_dump(spark: SparkSession, path) -> DataFrame:
    """Records of a topic dump: the reader splits at the record mark, so a body may span lines."""
    records = spark.read.option("lineSep", MARK).text(path)
    return records.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))


def parse_topic_dump(records: DataFrame, schema: str, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of a topic dump; the text starts after the record mark (`:<ms> ... {json}`).

    created_ms is the digits of the second `:` field. Line breaks inside the body are removed. A text
    without a body is not a record (the head of a file).
    """
    text = F.regexp_replace(F.col(record), r"[\r\n]+\s*", "")
    body = F.regexp_extract(text, r"(?s)\{.*$", 0)
    created = digits(F.get(F.split(text, ":"), F.lit(1))).try_cast("long")
    rows = records.withColumn("created_ms", created).withColumn("body", body).where(F.col("body") != "")
    valid = F.json_object_keys("body").isNotNull()
    good = rows.where(valid).withColumn("message", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    return good.drop(record, "body"), rows.where(~valid).select(*[c for c in records.columns if c != record], "created_ms", "body")


def keyword_log(lines: DataFrame, file: str, order: list[str], text: str, keywords: list[str], next_line_titles: list[str]) -> DataFrame:
    """Lines `time ... - LEVEL: title: value` whose title equals a keyword (letter case ignored).

    For the listed titles the value is the next line of the file, or the last of its parts between colons that holds
    the mark of the title in `BODY_MARKS`. Lines of the titles in `NEEDED_MARKS` count only with that mark in their
    value. Returns file, order, time, title, value.
    """
    levels = ["INFO", "DEBUG", "ERROR"]
    part = F.get(F.split(F.trim(text), " - "), F.lit(1))
    fields = F.filter(F.transform(F.split(part, ":"), lambda x: F.trim(x)), lambda x: ~x.isin(levels))
    title, value = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    head = F.get(F.split(F.trim(text), " - "), F.lit(0))
    time = F.trim(F.regexp_replace(F.get(F.split(F.regexp_replace(head, r"\[", ""), r"\]"), F.lit(0)), r'["{}]|log|status:200', ""))
    t, tie = order[0], order[1:]
    o = Ordered.of(lines.select(file, *order, text), file, t, tie).next(__following=text)
    low = [k.strip().lower() for k in keywords]
    hit = o.df.where(F.lower(title).isin(low) & (F.size(fields) > 1))
    clean = lambda c: F.trim(F.regexp_replace(unescape(F.trim(c)), r'stream|["\n,]', ""))
    chosen = F.when(title.isin(next_line_titles), F.col("__following")).otherwise(value)
    out = hit.select(file, *order, time.alias("time"), title.alias("title"), clean(chosen).alias("value"))
    for name, mark in BODY_MARKS.items():
        if name in next_line_titles:
            parts = F.filter(F.split("value", ":"), _holding(mark))
            out = out.withColumn("value", F.when((F.col("title") == name) & (F.size(parts) > 0), F.element_at(parts, -1)).otherwise(F.col("value")))
    for name, mark in NEEDED_MARKS.items():
        out = out.where((F.col("title") != name) | F.col("value").contains(mark))
    return out


def _holding(mark: str):
    return lambda x: x.contains(mark)


def item_log(lines: DataFrame, keep: list[str], text: str, keyword: str) -> DataFrame:
    """Lines containing a keyword, as name-value rows of their `;`-separated items.

    An item is `k:v` or `a:k:v` (the first field is then a label); of the latter the words of `ADDRESSING` are
    taken out of the value, and a fourth field is the port where the item names one of the known ports. A received
    request yields its port and its id. Random suffixes after the last `_` of receiver names are removed.
    """
    part = F.get(F.split(F.trim(text), " - "), F.lit(1))
    time = F.get(F.split(F.trim(F.get(F.split(F.trim(text), " - "), F.lit(0))), r"\s+"), F.lit(1))
    hits = lines.where(F.lower(part).contains(keyword.strip().lower()))
    items = hits.select(*keep, time.alias("time"), F.posexplode(F.split(part, ";")).alias("place", "__item"))
    fields = F.transform(F.split(F.trim("__item"), ":"), lambda x: F.trim(x))
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    n = F.size(fields)
    after = lambda mark: lambda x: F.element_at(F.split(x, mark), 2)
    commas = F.split(F.trim("__item"), ",")
    ports = F.transform(F.filter(commas, _holding(f"{PORT_FIELD}=")), after(f"{PORT_FIELD}="))
    ids = F.transform(F.filter(commas, lambda x: x.contains("id=") & ~x.contains(f"{PORT_FIELD}=")), after("id="))
    request = F.concat(F.transform(ports, lambda v: pair(F.lit(PORT_FIELD), v)), F.transform(ids, lambda v: pair(F.lit(REQUEST), v)))
    plain = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    two = F.array(pair(plain(F.get(fields, F.lit(0))), F.get(fields, F.lit(1))))
    worded = F.regexp_replace(F.get(fields, F.lit(2)), ADDRESSING, "")
    three = F.array(pair(plain(F.get(fields, F.lit(1))), worded))
    port = F.when((n == 4) & F.col("__item").rlike(PORTS), F.array(pair(F.lit("port"), F.replace(F.get(fields, F.lit(3)), F.lit("!"), F.lit("")))))
    found = (F.when(F.col("__item").contains(RECEIVED), request).when(n == 2, two)
             .when(n >= 3, F.concat(three, F.coalesce(port, F.array().cast("array<struct<name:string,value:string>>")))))
    rows = items.select(*keep, "time", "place", F.inline(found))
    return rows.withColumn("value", F.when(F.col("name").contains("RSU_Names"), plain_names(F.col("value"))).otherwise(F.col("value")))


def cloud_counts(lines: DataFrame, by: list[str], text: str) -> DataFrame:
    """Requests received, ignored, used to find roadside units and sent on, and the units found, per group."""
    part = F.lower(F.get(F.split(F.trim(text), " - "), F.lit(1)))
    has = lambda mark: F.coalesce(part.contains(mark.lower()), F.lit(False))
    first = F.get(F.split(part, ";"), F.lit(0))
    number = F.when(has(IDENTIFIED), F.trim(F.element_at(F.split(first, ":"), -1)).try_cast("long"))
    return lines.groupBy(*by).agg(F.count_if(has(RECEIVED)).alias("n_received"), F.count_if(has(IGNORED)).alias("n_ignored"),
                                  F.count_if(has(IDENTIFIED)).alias("n_identified"), F.count_if(has(SENT)).alias("n_sent"),
                                  F.coalesce(F.sum(number), F.lit(0)).alias("n_units"))


def plain_names(text: Column) -> Column:
    """Names of a comma list without the part after their last underscore."""
    kept = F.filter(F.split(text, ","), lambda x: x != "")
    return F.concat_ws(",", F.transform(kept, lambda x: F.regexp_replace(x, "_[^_]*$", "")))


def fixed_fields(lines: DataFrame, keep: list[str], text: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Fields at fixed offsets, name=(first, end) counted from 0 with the end left out."""
    return lines.select(*keep, *[F.substring(F.col(text), a + 1, b - a).alias(n) for n, (a, b) in fields.items()])


def real_time_factors(text: DataFrame, keep: list[str], column: str) -> DataFrame:
    """All `Simulating: <n> ns ... RTF: <r>, ETC` pairs of console text: keep, sim_time_ns, rtf."""
    plain = F.regexp_replace(column, "\r", "\n")
    pattern = F.lit(r"Simulating: (\d+) ns[^\n]*?RTF: ([0-9.]+), ETC")
    pairs = F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("b"))
    rows = text.select(*keep, F.explode(pairs).alias("__p"))
    return rows.select(*keep, F.col("__p.a").cast("long").alias("sim_time_ns"), F.col("__p.b").cast("double").alias("rtf"))


def step_lines(lines: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`Simulation Time: N where current system time is: M` lines as sim_time and system_time."""
    pattern = r"Simulation Time: (\d+) where current system time is: (\d+)"
    rows = lines.where(F.col(text).rlike(pattern))
    return rows.select(*keep, F.regexp_extract(text, pattern, 1).cast("long").alias("sim_time"),
                       F.regexp_extract(text, pattern, 2).cast("long").alias("system_time"))
