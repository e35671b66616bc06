"""Several values packed in one text field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opens and closes the index of a placeholder. Where the text itself holds one of them, that character gets a placeholder too, so none can collide.
OPEN, CLOSE = "\ue000", "\ue001"
SPAN = rf"""("[^"]*"|'[^']*'|[{OPEN}{CLOSE}])"""
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: One punctuation mark (not a sign, a full stop or a quote mark) with the white space around it, or white space alone.
SEPARATOR = rf"{SPACE}*[,;|/:\\!?&#*~^_=@%$]{SPACE}*|{SPACE}+"
BEFORE = rf"^(?:{SPACE}|[\[({{<])++"
BEHIND = rf"^(?:{SPACE}|[\])}}>])++"


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used in there (the optimizer repeats what only columns name)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def packed_slots(text: Column) -> Column:
    """array<struct<slot string, quoted boolean>>: the slots of a packed field in order, empty ones included.

    Quoted spans become placeholders that hold their index, the rest is split at separators, and the spans come back by
    array lookup, without their marks, wherever in a slot they stood; quoted tells whether a slot has such a span. A
    separator at the very end opens no slot; an empty field has one empty slot, null stays null. A quote mark without its
    partner is plain text. The work is in proportion to the text.
    """
    head = F.regexp_replace(text, BEFORE, "")
    # from behind, as a pattern anchored at the end is tried at every place
    bare = F.when(head.rlike(rf"(?:{SPACE}|[\])}}>])\z"), F.reverse(F.regexp_replace(F.reverse(head), BEHIND, ""))).otherwise(head)
    return F.when(text.isNotNull(), let(bare, lambda b: F.when(b.rlike(f"[\"'{OPEN}{CLOSE}]"), _with_spans(b)).otherwise(_plain(b))))


def _cut(text: Column) -> Column:
    slots = F.split(text, SEPARATOR, -1)
    return let(slots, lambda x: F.when((F.size(x) > 1) & (F.try_element_at(x, F.lit(-1)) == ""), F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def _plain(bare: Column) -> Column:
    return F.transform(_cut(bare), lambda s: F.struct(s.alias("slot"), F.lit(False).alias("quoted")))


def _with_spans(bare: Column) -> Column:
    spans = F.regexp_extract_all(bare, F.lit(SPAN), F.lit(1))
    outside = F.transform(F.split(bare, SPAN, -1), lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), s)))
    slots = _cut(F.array_join(outside, ""))

    def piece(spans: Column, x: Column) -> Column:
        """A placeholder's span and what follows it."""
        span = F.get(spans, F.substring_index(x, CLOSE, 1).cast("int"))
        inner = F.when(F.length(span) > 1, F.substring(span, F.lit(2), F.length(span) - 2)).otherwise(span)
        return F.struct(F.concat(inner, F.substring_index(x, CLOSE, -1)).alias("slot"), (F.length(span) > 1).alias("quoted"))

    def restored(spans: Column, slot: Column) -> Column:
        first = F.struct(F.substring_index(slot, OPEN, 1).alias("slot"), F.lit(False).alias("quoted"))
        parts = F.split(slot, OPEN, -1)
        pieces = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: piece(spans, x))
        whole = let(pieces, lambda p: F.struct(F.concat(first["slot"], F.array_join(p["slot"], "")).alias("slot"), F.array_contains(p["quoted"], True).alias("quoted")))
        return F.when(slot.contains(OPEN), whole).otherwise(F.struct(slot.alias("slot"), F.lit(False).alias("quoted")))

    return let(F.struct(spans.alias("spans"), slots.alias("slots")), lambda r: F.transform(r["slots"], lambda s: restored(r["spans"], s)))


def integer_of(slot: Column) -> Column:
    """int64 that a slot of :func:`packed_slots` holds, else null; inside quote marks a comma groups digits, and white space around is left out."""
    bare = F.regexp_replace(F.regexp_replace(slot["slot"], rf"^{SPACE}++", ""), rf"{SPACE}++\z", "")
    quoted = F.regexp_replace(bare, "(?<=[0-9]),(?=[0-9])", "")
    return F.when(slot["quoted"], F.when(quoted.rlike(r"\A[+-]?[0-9]+\z"), quoted.try_cast("bigint"))).when(slot["slot"].rlike(r"\A[+-]?[0-9]+\z"), slot["slot"].try_cast("bigint"))


def packed_integers(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every integer packed in ``fields``: ``key``, field_name (lower case), slot_no from 1, item; each row once.

    Slots that are empty or hold no 64-bit integer keep their number and give no row, so do null fields. Repeated rows
    collapse before the shuffle, which moves the packed texts and not the exploded rows. A null key is kept as a key.
    Extra columns aren't read.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f.lower()).alias("field_name"), F.col(f).alias("__t")) for f in fields])).alias("__f")
    texts = df.select(F.col(key).alias("__key"), each).select("__key", "__f.*").where("__t is not null and __t != ''")
    texts = texts.groupBy("__key", "field_name").agg(F.collect_set("__t").alias("__t"))
    numbered = lambda t: F.transform(packed_slots(t), lambda s, i: F.struct((i + 1).alias("slot_no"), integer_of(s).alias("item")))
    found = F.filter(F.flatten(F.transform("__t", numbered)), lambda x: x["item"].isNotNull())
    # the slots of one text differ; of several texts they are made distinct as text, as structs would be compared in pairs
    coded = F.array_distinct(F.transform("__i", lambda x: F.concat_ws(":", x["slot_no"].cast("string"), x["item"].cast("string"))))
    apart = F.transform(coded, lambda s: F.struct(F.substring_index(s, ":", 1).cast("int").alias("slot_no"), F.substring_index(s, ":", -1).cast("bigint").alias("item")))
    rows = texts.select("__key", "field_name", F.size("__t").alias("__n"), found.alias("__i"))
    out = rows.select(F.col("__key").alias(key), "field_name", F.inline(F.when(F.col("__n") > 1, apart).otherwise(F.col("__i"))))
    return out.withColumn("slot_no", F.col("slot_no").cast("int"))
