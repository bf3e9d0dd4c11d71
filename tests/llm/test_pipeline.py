import random

from pyspark.sql import functions as F

import corpus_pipeline
from driftlens.llm.common import materialize


def test_stages_catch_what_is_planted(spark, tmp_path):
    rng = random.Random(9)
    stop = "the of and to in is that it".split()
    prose = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.4 else f"w{rng.randrange(10**5)}" for _ in range(n))
    item = " ".join(f"b{i}" for i in range(30))
    passage = " ".join(["the", *(f"p{i}" for i in range(60)), "of the and it is in to"])
    clean = {i: prose(120) for i in range(20)}
    docs = dict(clean)
    docs[20] = clean[3]  # a copy
    docs[21] = clean[4].replace(" the ", " a ", 1)  # a near copy
    docs[22] = prose(80) + " " + item + " " + prose(80)
    docs[23] = "JUNK!! " * 60
    docs[24], docs[25] = prose(60) + "\n" + passage, prose(60) + "\n" + passage
    docs[26], docs[27] = None, ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    df = spark.read.parquet(f"{path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = df.columns
        df = materialize(stage(spark, df, path), name)
        assert df.columns == columns
        left.append({r.doc_id: r for r in df.collect()})
    quality, lines, near, decon = left
    assert set(quality) == set(docs) - {23, 26, 27}
    assert 20 not in lines and lines[24].text == docs[24] and passage not in lines[25].text
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert 21 not in near and 22 in near and 22 not in decon
    assert set(clean) <= set(decon)
    packed = corpus_pipeline.run(spark, path)
    assert packed.select("doc_id").distinct().count() == len(decon)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
