"""The command line from SAM files to a catalog, a table, GTF and a test."""

import random

from spliceforge.__main__ import main
from spliceforge.sources import annotation
from tests.test_placement import sam


def test_from_reads_to_results(spark, tmp_path):
    r = random.Random(3)
    (tmp_path / "ref.gtf").write_text("".join(f'c\tx\texon\t{a + 1}\t{b}\t.\t+\t.\tgene_id "g"; transcript_id "t";\n' for a, b in [(100, 150), (220, 260), (330, 380), (450, 500)]))
    shares = {"a1": 0.9, "a2": 0.85, "b1": 0.2, "b2": 0.15}
    for s, share in shares.items():
        reads = [sam(f"{s}{i}", 100, "50M70N40M70N50M70N50M" if r.random() < share else "50M180N50M70N50M") for i in range(200)]
        (tmp_path / f"{s}.sam").write_text("\n".join(reads) + "\n")
    out = lambda n: str(tmp_path / n)
    main(["import", "--reference", out("ref.gtf"), "--out", out("cat"), "--sam", *[f"{s}={tmp_path}/{s}.sam" for s in shares], "--group", "a1=low", "a2=low", "b1=high", "b2=high"], spark)
    main(["table", "--catalog", out("cat"), "--out", out("t"), "--tpm"], spark)
    rows = spark.read.csv(out("t"), header=True, inferSchema=True).collect()
    assert len(rows) == 2 and all(sum(x[f"{s}_coverage"] for x in rows) == 200 and abs(sum(x[f"{s}_tpm"] for x in rows) - 1e6) < 1 for s in shares)
    main(["table", "--catalog", out("cat"), "--out", out("g"), "--by-group", "--query", "FSM"], spark)
    (row,) = spark.read.csv(out("g"), header=True, inferSchema=True).collect()
    assert row["low_sum_coverage"] > 300 > row["high_sum_coverage"]
    main(["gtf", "--catalog", out("cat"), "--out", out("gtf"), "--region", "c:0-1000"], spark)
    assert annotation.read_gtf(spark, out("gtf"))[1].count() == 2
    main(["test", "--catalog", out("cat"), "--out", out("d"), "--groups", "low", "high"], spark)
    (event,) = spark.read.csv(out("d"), header=True, inferSchema=True).where("event_type = 'ES'").collect()
    assert event["padj"] < 0.01 and event["psi_low"] > 0.8 > 0.3 > event["psi_high"] and (event["start"], event["end"]) == (150, 330)
