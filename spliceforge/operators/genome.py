"""What a genome says about transcripts: splice motifs, bases behind the end, direct repeats, sequences and reading frames.

A genome is a table of overlapping tiles (name, tile_no, tile_start, seq), see :func:`spliceforge.sources.files.tiles`; places are joined to
their tile on (name, position div size). Places beyond a contig have no bases, contigs that the genome lacks none at all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceforge.functions import sequence as S
from spliceforge.functions.intervals import introns, to_genomic_position
from spliceforge.session import fresh, ship_package


def bases_at(rows: DataFrame, tiles: DataFrame, start: Column, length: Column, name: str, size: int) -> DataFrame:
    """Adds ``name``: the bases of contig ``chr`` from ``start`` on, at most as many as tiles overlap by; null without such a tile."""
    at, n, contig, no, tile_start, seq = fresh(rows.columns, "at", "n", "contig", "no", "tile_start", "seq")
    asked = rows.withColumns({at: start.cast("long"), n: length.cast("int")})
    known = tiles.select(F.col("name").alias(contig), F.col("tile_no").cast("long").alias(no), F.col("tile_start").alias(tile_start), F.col("seq").alias(seq))
    both = asked.join(known, (F.col("chr") == F.col(contig)) & (F.floor(F.col(at) / size) == F.col(no)), "left")
    return both.withColumn(name, F.substring(F.col(seq), (F.col(at) - F.col(tile_start) + 1).cast("int"), F.col(n))).select(*rows.columns, name)


def distinct_introns(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("chr", "strand", F.inline(introns(F.col("exons")))).distinct()


def intron_motifs(transcripts: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """chr, strand, donor, acceptor, motif (read on the strand) of the distinct introns."""
    return motifs_of(distinct_introns(transcripts), tiles, size)


def motifs_of(places: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """The same of introns that are given as distinct places. Tiles are read once, for the distinct places of two bases at either end."""
    ends = places.select("chr", F.explode(F.array(F.col("donor"), F.col("acceptor") - 2)).alias("__at")).distinct()
    two = bases_at(ends, tiles, F.col("__at"), F.lit(2), "__two", size)
    at = lambda side, pos: two.select("chr", F.col("__at").alias(pos), F.col("__two").alias(side))
    rows = places.withColumn("__behind", F.col("acceptor") - 2).join(at("__d", "donor"), ["chr", "donor"], "left").join(at("__a", "__behind"), ["chr", "__behind"], "left")
    four = F.concat("__d", "__a")
    return rows.select("chr", "strand", "donor", "acceptor", F.when(F.col("strand") == "-", S.reverse_complement(four)).otherwise(four).alias("motif"))


def intron_repeats(transcripts: DataFrame, tiles: DataFrame, size: int, delta: int = 15, max_mm: int = 2, wobble: int = 2) -> DataFrame:
    """chr, strand, donor, acceptor, repeat_length of the distinct introns: bases that agree around both ends, see :func:`repeat_length`."""
    ship_package(transcripts.sparkSession)
    side = delta + wobble

    @F.pandas_udf("int")
    def longest(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([S.repeat_length(x.ljust(2 * side, "N"), y.ljust(2 * side, "N"), delta, max_mm, wobble) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="Int32")

    rows = distinct_introns(transcripts).where((F.col("donor") >= side) & (F.col("acceptor") >= side))
    rows = bases_at(rows, tiles, F.col("donor") - side, F.lit(2 * side), "__d", size)
    rows = bases_at(rows, tiles, F.col("acceptor") - side, F.lit(2 * side), "__a", size)
    return rows.select("chr", "strand", "donor", "acceptor", longest("__d", "__a").alias("repeat_length"))


def downstream_a(transcripts: DataFrame, tiles: DataFrame, size: int, length: int = 30) -> DataFrame:
    """transcript_id, a_content: share of A in the ``length`` bases behind the end on the strand (of T before the start on the other)."""
    minus = F.col("strand") == "-"
    low = F.when(minus, F.greatest(F.col("tr_start") - length, F.lit(0))).otherwise(F.col("tr_end"))
    rows = transcripts.select("transcript_id", "chr", "strand", low.alias("__low"), F.when(minus, F.col("tr_start") - low).otherwise(length).alias("__n"))
    rows = bases_at(rows, tiles, F.col("__low"), F.col("__n"), "__b", size)
    share = F.when(minus, S.base_share(F.col("__b"), "T", length)).otherwise(S.base_share(F.col("__b"), "A", length))
    return rows.select("transcript_id", share.alias("a_content"))


def qc_metrics(transcripts: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """transcript_id, a_content, noncanonical: numbers (from 0) of the introns with another motif than GT..AG, in genomic order.

    ``transcripts``: transcript_id, chr, strand, exons, tr_start, tr_end. Motifs are looked up once for each distinct intron.
    """
    each = transcripts.select("transcript_id", "chr", "strand", F.posexplode(introns(F.col("exons"))).alias("no", "i")).select("transcript_id", "chr", "strand", "no", "i.*")
    odd = each.join(intron_motifs(transcripts, tiles, size).where(F.col("motif") != S.CANONICAL), ["chr", "strand", "donor", "acceptor"])
    odd = odd.groupBy("transcript_id").agg(F.sort_array(F.collect_list("no")).alias("noncanonical"))
    rows = downstream_a(transcripts, tiles, size).join(odd, "transcript_id", "left")
    return rows.withColumn("noncanonical", F.coalesce("noncanonical", F.array().cast("array<int>")))


def spliced_sequences(transcripts: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """transcript_id, seq: the joined exons as read on the strand. An exon takes its part of each tile that it lies over; transcripts with an
    exon that the genome doesn't hold whole give no row."""
    exons = transcripts.select("transcript_id", "chr", "strand", F.inline("exons"))
    parts = exons.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("tile_no"))
    parts = parts.join(tiles.select(F.col("name").alias("chr"), F.col("tile_no").cast("long").alias("tile_no"), "tile_start", "seq"), ["chr", "tile_no"])
    a, b = F.greatest("start", "tile_start"), F.least(F.col("end"), F.col("tile_start") + size)
    parts = parts.select("transcript_id", "strand", a.alias("at"), F.substring(F.col("seq"), (a - F.col("tile_start") + 1).cast("int"), (b - a).cast("int")).alias("bases"))
    whole = parts.groupBy("transcript_id").agg(F.max("strand").alias("strand"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "bases"))), lambda x: x["bases"]), "").alias("seq"))
    length = exons.groupBy("transcript_id").agg(F.sum(F.col("end") - F.col("start")).alias("__length"))
    whole = whole.join(length, "transcript_id").where(F.length("seq") == F.col("__length"))
    return whole.select("transcript_id", F.when(F.col("strand") == "-", S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def annotated_starts(transcripts: DataFrame, references: DataFrame) -> DataFrame:
    """transcript_id, starts (sorted array, on the transcript): where the start codons of reference transcripts of the gene lie on it.

    ``transcripts``: transcript_id, gene_id, strand, exons; ``references``: gene_id, strand, exons, cds (struct<start, end> on the genome, or
    null). The start has to lie in an exon, and the introns upstream of it to be the same. Both meet on (gene, introns
    upstream, start), so references that can't fit are never compared.
    """
    minus = F.col("strand") == "-"

    def upstream(exons: Column, at: Column) -> Column:
        text = lambda keep: F.array_join(F.transform(F.filter(introns(exons), keep), lambda i: F.concat_ws("-", i["donor"].cast("string"), i["acceptor"].cast("string"))), ",")
        return F.when(minus, text(lambda i: i["acceptor"] >= at)).otherwise(text(lambda i: i["donor"] <= at))

    init = F.when(minus, F.col("cds.end")).otherwise(F.col("cds.start"))
    ref = references.where("cds is not null").withColumn("init", init).select("gene_id", "strand", "init", upstream(F.col("exons"), F.col("init")).alias("path")).distinct()
    asked = transcripts.join(ref.select("gene_id", "init").distinct(), "gene_id").where(F.exists("exons", lambda x: (x["start"] <= F.col("init")) & (F.col("init") <= x["end"])))
    fit = asked.withColumn("path", upstream(F.col("exons"), F.col("init"))).join(ref.drop("strand"), ["gene_id", "init", "path"], "left_semi")
    before = F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.least(x["end"], F.col("init")) - x["start"], F.lit(0)))
    total = F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return fit.select("transcript_id", F.when(minus, total - before).otherwise(before).alias("s")).groupBy("transcript_id").agg(F.sort_array(F.collect_set("s")).alias("starts"))


ORF = "start int, end int, upstream int, annotated boolean, kozak double, testcode double"


def predict_orfs(transcripts: DataFrame, sequences: DataFrame, starts: DataFrame | None = None, min_len: int = 300, max_5utr: int = 500, min_kozak: float | None = None) -> DataFrame:
    """transcript_id, start, end (on the transcript), cds_start, cds_end (on the genome), utr5, cds, utr3 (lengths), upstream (start codons
    before), annotated, start_codon, stop_codon, kozak, testcode, nmd.

    An annotated start is preferred, else the first frame that is long enough and early enough is taken; transcripts without one give
    no row. nmd: the stop lies more than 55 bases before the last junction. ``starts``: see :func:`annotated_starts`.
    """
    ship_package(transcripts.sparkSession)

    @F.pandas_udf(ORF)
    def frames(seqs: pd.Series, known: pd.Series) -> pd.DataFrame:
        out = []
        for seq, at in zip(seqs, known):
            annotated = frozenset(map(int, at)) if at is not None else frozenset()
            f = S.best_frame(seq, min_len, max_5utr, annotated, min_kozak, S.KOZAK)
            out.append((None,) * 6 if f is None else (*f, f[0] in annotated, S.kozak_score(seq, f[0], S.KOZAK), S.testcode(seq[f[0] : f[1]])))
        types = {"start": "Int32", "end": "Int32", "upstream": "Int32", "annotated": "boolean", "kozak": "Float64", "testcode": "Float64"}
        return pd.DataFrame(out, columns=list(types)).astype(types)

    none = F.lit(None).cast("array<long>")
    rows = sequences.join(starts, "transcript_id", "left") if starts is not None else sequences.withColumn("starts", none)
    rows = rows.select("transcript_id", "seq", frames("seq", "starts").alias("f")).where("f.start is not null").select("transcript_id", "seq", "f.*")
    rows = rows.join(transcripts.select("transcript_id", "strand", "exons"), "transcript_id")
    total = F.length("seq")
    at = lambda p: to_genomic_position(F.col("exons"), F.col("strand"), p)
    minus = F.col("strand") == "-"
    last = F.when(minus, F.get("exons", F.lit(0))).otherwise(F.try_element_at("exons", F.lit(-1)))
    behind = total - (last["end"] - last["start"]) - F.col("end")
    return rows.select(
        "transcript_id", "start", "end", F.least(at(F.col("start")), at(F.col("end"))).alias("cds_start"), F.greatest(at(F.col("start")), at(F.col("end"))).alias("cds_end"),
        F.col("start").alias("utr5"), (F.col("end") - F.col("start")).alias("cds"), (total - F.col("end")).alias("utr3"), "upstream", "annotated",
        F.substring(F.col("seq"), F.col("start") + 1, F.lit(3)).alias("start_codon"), F.substring(F.col("seq"), F.col("end") - 2, F.lit(3)).alias("stop_codon"), "kozak", "testcode",
        ((F.size("exons") > 1) & (behind > S.NMD_DISTANCE)).alias("nmd"),
    )
