"""Sequence queries look at the whole text."""

from spliceforge.functions import sequence as S
from spliceforge.plans import annotation


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_beyond_the_first_bases(spark, tmp_path):
    text = "C" * 300 + "A" * 30 + "GT" + "C" * 46 + "AG" + "C" * 20
    d = documents(spark, tmp_path, [text])
    share = {(r["pos"], r["strand"]): r["a_share"] for r in annotation.all_a_content(spark, d).collect()}
    assert share[300, "+"] == 1 and share[0, "+"] == 0 and share[390, "-"] == 0
    assert {r["motif"]: r["n"] for r in annotation.all_splice_motifs(spark, d).collect()}["GTAG"] == 1
    got = {r["repeat_length"]: r["n"] for r in annotation.direct_repeats(spark, d).collect()}
    want = {}
    for p in range(17, len(text) - 50 - 16):
        k = min(15, S.repeat_length(text[p - 17 : p + 17], text[p + 33 : p + 67], 15, 2, 2))
        want[k] = want.get(k, 0) + 1
    assert got == want and sum(got.values()) == len(text) - 83
