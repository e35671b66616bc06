"""Strict loading of tab-separated lines, with the reason for every line that doesn't load."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field: quoted (marks inside are doubled), or plain text that doesn't start with a quote mark, or nothing.
FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^"\t][^\t]*+|'
WHOLE = rf"\A(?:\t(?:{FIELD})(?=\t|\z))*+\z"
ONE = rf"\t({FIELD})(?=\t|\z)"
BLANK = r"\A[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*+\z"
REASONS = ("quoting", "column_count", "invalid_value")


@dataclass(frozen=True)
class Feed:
    """Columns of a feed, in order, and what makes their values valid (a function of the array of values)."""

    name: str
    columns: tuple[str, ...]
    valid: callable = field(repr=False)


def small_number(text: Column) -> Column:
    """The value of ASCII digits below 2^31, else null."""
    value = F.when(text.rlike(r"\A[0-9]+\z"), F.regexp_replace(text, r"\A0+(?=[0-9])", ""))
    return F.when((F.length(value) <= 10) & (value.try_cast("bigint") < 2**31), value.try_cast("bigint"))


#: Tells records without an identifier apart (0 for all others).
UNNAMED = "__unnamed"


def records(lines: DataFrame, key: str = "record_id", line: str = "line", feed: str = "feed") -> DataFrame:
    """The records among the lines, each once: ``key``, ``feed``, __unnamed, __body (a tab before each field).

    Null lines, lines of only white space and lines that start with ``#`` are none; a carriage return at the end is taken off. Of
    deliveries of one ``key`` that differ, the least by feed and line counts. Without a ``key`` equal lines of a feed are one record.
    """
    rows = lines.where(F.col(line).isNotNull() & ~F.col(line).rlike(BLANK) & ~F.col(line).startswith("#"))
    body = F.concat(F.lit("\t"), F.regexp_replace(line, r"\r\z", ""))
    unnamed = F.when(F.col(key).isNull(), F.xxhash64(feed, line)).otherwise(F.lit(0).cast("long"))
    rows = rows.select(F.col(key), unnamed.alias(UNNAMED), F.struct(F.col(feed).alias("feed"), body.alias("body")).alias("__r"))
    return rows.groupBy(key, UNNAMED).agg(F.min("__r").alias("__r")).select(key, UNNAMED, F.col("__r.feed").alias(feed), F.col("__r.body").alias("__body"))


def fields_of(body: Column) -> Column:
    """array<string>: the values of a record, quote marks taken off."""
    bare = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.regexp_extract_all(body, F.lit(ONE), F.lit(1)), bare)


def strict_load(lines: DataFrame, feed: Feed, key: str = "record_id") -> DataFrame:
    """The conforming records of one feed: ``key`` and the feed's columns as text.

    A record conforms if its quoting is whole, it has as many fields as the feed has columns, and the values are valid.
    """
    return _conforming(records(lines.where(F.col("feed") == feed.name), key), feed).select(key, *[F.get("__v", F.lit(i)).alias(c) for i, c in enumerate(feed.columns)])


def _conforming(rows: DataFrame, feed: Feed) -> DataFrame:
    split = rows.where((F.col("feed") == feed.name) & F.col("__body").rlike(WHOLE)).withColumn("__v", fields_of(F.col("__body")))
    return split.where((F.size("__v") == len(feed.columns)) & F.coalesce(feed.valid(F.col("__v")), F.lit(False)))


def rejected(lines: DataFrame, feeds: list[Feed], key: str = "record_id") -> DataFrame:
    """``key`` and reason of each record that :func:`strict_load` leaves out, once.

    The loaded offsets are taken from those of all records, and only the remainder is diagnosed; the first of
    ``REASONS`` that holds is given. Records of a feed that isn't among ``feeds`` are not looked at. A record delivered
    twice counts once; those without an identifier each give a row of their own; an empty table gives no row.
    """
    rows = records(lines.where(F.col("feed").isin([f.name for f in feeds])), key)
    loaded = _conforming(rows, feeds[0]).select(key, UNNAMED)
    for f in feeds[1:]:
        loaded = loaded.unionByName(_conforming(rows, f).select(key, UNNAMED))
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"l.{key}")) & (F.col(f"r.{UNNAMED}") == F.col(f"l.{UNNAMED}"))
    rest = rows.alias("r").join(loaded.alias("l"), same, "left_anti")
    width = F.lit(None).cast("int")
    for f in feeds:
        width = F.when(F.col("feed") == f.name, F.lit(len(f.columns))).otherwise(width)
    n = F.size(fields_of(F.col("__body")))
    reason = F.when(~F.col("__body").rlike(WHOLE), REASONS[0]).when(n != width, REASONS[1]).otherwise(REASONS[2])
    return rest.select(key, reason.alias("reason"))


def _bam_name(v: Column) -> Column:
    name = F.get(v, F.lit(1))
    return name.rlike(r"(?s)\A.+\.bam\z") & ~name.rlike(r"[\s\p{Cntrl}\x{80}-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _blocks(v: Column) -> Column:
    start, end, count = (small_number(F.get(v, F.lit(i))) for i in (2, 3, 10))
    starts = F.regexp_replace(F.get(v, F.lit(12)), r",\z", "")
    items = F.when(starts == "", F.array().cast("array<string>")).otherwise(F.split(starts, ",", -1))
    return (start < end) & (F.size(items) == count) & F.forall(items, lambda x: small_number(x).isNotNull())


SAMPLES = Feed("sample_table", ("sample_name", "file_name", "sample_group"), _bam_name)
DOMAINS = Feed(
    "example_anno_domains",
    (
        "domain_id", "chrom", "chromstart", "chromend", "domain_name", "score", "strand", "thickstart", "thickend", "reserved",
        "blockcount", "blocksizes", "chromstarts", "name2", "cdsstartstat", "cdsendstat", "exonframes", "anno_type", "genename",
        "genename2", "genetype", "status", "annotationtype", "aa_position", "longname", "syns", "subcellloc", "comments",
        "uniprotid", "pmids",
    ),
    _blocks,
)
