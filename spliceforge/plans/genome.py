"""Queries over transcripts and a genome. The tables hold none, so the longest sequence of a post, repeated, stands in for each contig
(shifted by 13 bases for each letter of the contig's name); it is cut into tiles where exons lie, and the operators see tiles only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceforge.functions import intervals as X
from spliceforge.functions import sequence as S
from spliceforge.operators import genome as G
from spliceforge.plans import model as M
from spliceforge.plans.structure import REF
from spliceforge.session import materialize, table

SIZE, OVERLAP, SHIFT = 4_096, 64, 13
#: Tiles for the two bases at splice sites alone.
SITE_SIZE = 256
COLUMNS = ("transcript_id", "gene_id", "chr", "strand", "exons", "tr_start", "tr_end", "category")


def genome_tiles(spark: SparkSession, d: str, transcripts: DataFrame) -> DataFrame:
    """Tiles of the places of exons and 64 bases around; the driver reads the one sequence."""
    x = transcripts.select("chr", F.inline("exons"))
    near = F.sequence(F.floor(F.greatest(F.col("start") - OVERLAP, F.lit(0)) / SIZE), F.floor((F.col("end") + OVERLAP) / SIZE))
    return _cut(spark, d, x.select("chr", F.explode(near).alias("tile_no")).distinct(), SIZE)


def _cut(spark: SparkSession, d: str, rows: DataFrame, size: int) -> DataFrame:
    """The tiles of ``size`` and 64 bases more that ``rows`` (chr, tile_no) name."""
    posts = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    seq = posts.agg(F.max_by("seq", F.struct(F.length("seq"), -F.col("doc_id"))).alias("seq")).first()["seq"] or "N"
    turned = F.pmod(F.col("tile_no") * size + F.length("chr") * SHIFT, F.lit(len(seq)))
    bases = F.substring(F.lit(seq * ((size + OVERLAP) // len(seq) + 2)), turned.cast("int") + 1, F.lit(size + OVERLAP))
    return rows.select(F.col("chr").alias("name"), "tile_no", (F.col("tile_no") * size).alias("tile_start"), bases.alias("seq"))


def _inputs(spark: SparkSession, d: str, only: str = "true") -> tuple[DataFrame, DataFrame]:
    rows = materialize(M.transcripts(spark, d).where(only).select(*COLUMNS), "genome-transcripts")
    return rows, materialize(genome_tiles(spark, d, rows), "genome-tiles")


def transcript_qc(spark: SparkSession, d: str) -> DataFrame:
    """Share of A behind each transcript's end, and its introns with another motif than GT..AG."""
    rows, tiles = _inputs(spark, d)
    qc = G.qc_metrics(rows, tiles, SIZE)
    return qc.select("transcript_id", F.round("a_content", 4).alias("a_content"), F.array_join("noncanonical", ",").alias("noncanonical"))


def transcript_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Length and MD5 of each transcript's sequence."""
    rows, tiles = _inputs(spark, d)
    seqs = G.spliced_sequences(rows, tiles, SIZE)
    return seqs.select("transcript_id", F.length("seq").alias("length"), F.md5(F.col("seq").cast("binary")).alias("md5"))


def transcript_orfs(spark: SparkSession, d: str) -> DataFrame:
    """The reading frame chosen for each transcript of a gene, on the transcript and on the genome, and whether it leads to decay."""
    rows, tiles = _inputs(spark, d, "gene_id is not null")
    return G.predict_orfs(rows, G.spliced_sequences(rows, tiles, SIZE), min_len=90)


def direct_repeat_hist(spark: SparkSession, d: str) -> DataFrame:
    """Distinct introns by the length of the direct repeat at their ends; kind: known (to a full splice match), novel canonical, novel noncanonical."""
    rows, tiles = _inputs(spark, d)
    key = ["chr", "strand", "donor", "acceptor"]
    known = G.distinct_introns(rows.where(REF)).withColumn("known", F.lit(True))
    both = G.intron_repeats(rows, tiles, SIZE).join(G.intron_motifs(rows, tiles, SIZE), key).join(known, key, "left")
    kind = F.when(F.col("known"), "known").when(F.col("motif") == "GTAG", "novel canonical").otherwise("novel noncanonical")
    return both.groupBy(kind.alias("kind"), "repeat_length").agg(F.count(F.lit(1)).alias("n"))


def transcript_tags(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """transcript_id, noncanonical, novel_introns: numbers (from 0) of the introns with another motif than GT..AG, and of those of which neither site is
    one of a full splice match of the gene. Transcripts with neither give no row.

    ``rows`` (written): transcript_id, gene_id, chr, strand, exons, category. Both are found for the distinct introns of genes, and joined to transcripts once.
    """
    place, at = ["gene_id", "chr", "strand", "donor", "acceptor"], ["chr", "strand", "donor", "acceptor"]
    each = rows.select("transcript_id", "gene_id", "chr", "strand", "category", F.posexplode(X.introns(F.col("exons"))).alias("no", "i")).select("transcript_id", "gene_id", "chr", "strand", "category", "no", "i.*")
    kinds = materialize(each.groupBy(*place).agg(F.max(F.coalesce(F.expr(REF), F.lit(False))).alias("ref")), "gene-introns")
    site = lambda side: kinds.where("ref").select("gene_id", "strand", side, F.lit(True).alias(f"{side}_known")).distinct()
    near = F.explode(F.array(F.floor(F.col("donor") / SITE_SIZE), F.floor((F.col("acceptor") - 2) / SITE_SIZE)))
    tiles = _cut(spark, d, kinds.select("chr", near.alias("tile_no")).distinct(), SITE_SIZE)
    motifs = G.motifs_of(kinds.select(*at).distinct(), tiles, SITE_SIZE)
    marked = kinds.join(site("donor"), ["gene_id", "strand", "donor"], "left").join(site("acceptor"), ["gene_id", "strand", "acceptor"], "left").join(motifs, at, "left")
    odd = F.coalesce(F.col("motif") != S.CANONICAL, F.lit(False))
    marked = marked.select(*place, odd.alias("odd"), (F.col("donor_known").isNull() & F.col("acceptor_known").isNull()).alias("novel")).where("odd or novel")
    pick = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("no"))))
    return each.drop("category").join(marked, place).groupBy("transcript_id").agg(pick("odd").alias("noncanonical"), pick("novel").alias("novel_introns"))


QUERIES = {f.__name__: f for f in (transcript_qc, transcript_sequences, transcript_orfs, direct_repeat_hist)}

GENOME_SQL = """
gseq as (select arg_max(seq, (length(seq), -doc_id)) as seq from (select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents where text is not null)),
gen as (select length(seq) as n, repeat(seq, 3 + (select max(e - s) from exons) // greatest(length(seq), 1)) as g from gseq),
mot0 as (select x.transcript_id, x.exon_no, t.strand, substr(g, (x.e + 13 * length(chr)) % n + 1, 2) || substr(g, (nxt - 2 + 13 * length(chr)) % n + 1, 2) as four
  from ex3 x join tr t using (transcript_id), gen where nxt is not null),
mot as (select transcript_id, cast(exon_no - 1 as int) as no, case when strand = '-' then reverse(translate(four, 'ACGT', 'TGCA')) else four end as motif from mot0),
nonc as (select transcript_id, list(no order by no) as noncanonical from mot where motif <> 'GTAG' group by 1)"""
_LOW = "greatest(tr_start - 30, 0)"
SQL = {
    "transcript_qc": f"""with {M.BASE}, {GENOME_SQL}
        select tr.transcript_id, round(length(regexp_replace(case when strand = '-' then substr(g, ({_LOW} + 13 * length(chr)) % n + 1, tr_start - {_LOW}) else substr(g, (tr_end + 13 * length(chr)) % n + 1, 30) end,
          case when strand = '-' then '[^T]' else '[^A]' end, '', 'g')) / 30, 4) as a_content, coalesce(array_to_string(noncanonical, ','), '') as noncanonical from tr left join nonc using (transcript_id), gen""",
    "transcript_sequences": f"""with {M.BASE}, {GENOME_SQL},
        sp as (select transcript_id, any_value(strand) as strand, string_agg(substr(g, (s + 13 * length(chr)) % n + 1, e - s), '' order by exon_no) as q from exons join tr using (transcript_id), gen group by 1)
        select transcript_id, cast(length(q) as int) as length, md5(case when strand = '-' then reverse(translate(q, 'ACGT', 'TGCA')) else q end) as md5 from sp""",
}
