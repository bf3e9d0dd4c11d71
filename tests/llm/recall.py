"""Recall of the near-duplicate search against all pairs, by band of similarity: python tests/llm/recall.py [documents.parquet]

Queries are the documents whose id is divisible by 100, held against all rows
by the alignment alone, where their lengths and shingles allow it at all.
Without a file, pairs of known similarity are planted among texts that share
long passages, so that their sketches lie in large buckets.
"""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[2]))

from driftlens.llm.common import workers_know  # noqa: E402
from driftlens.llm.omh import near_duplicates  # noqa: E402
from driftlens.llm.shingles import shingle_hashes, similar, word_hashes, words  # noqa: E402

BANDS = (0.8, 0.85, 0.9, 0.95, 1.0)


def shingles(text):
    return (shingle_hashes(word_hashes(words(text))) >> np.uint64(32)).astype("u4")


def band(a, b):
    """The highest of BANDS that the pair reaches; None below the first."""
    return max((t for t in BANDS if similar(a, b, t)), default=None)


def planted(n=400):
    rng = random.Random(1)
    own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passages, out = [own(140) for _ in range(4)], []
    for i in range(n):
        left = [*own(30), *passages[i % 4], *own(30)]
        right = list(left)
        for _ in range(rng.randint(0, 4)):
            right[rng.randrange(len(right))] = own(1)[0]
        out += [(100 * i, " ".join(left)), (100 * i + 1, " ".join(right))]
    return out


def main():
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    workers_know(spark)
    if len(sys.argv) > 1:
        df = spark.read.parquet(sys.argv[1]).select("doc_id", "text")
    else:
        df = spark.createDataFrame(planted(), "doc_id long, text string").repartition(16)
    label = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    queries = spark.sparkContext.broadcast([(r.doc_id, r.text) for r in df.filter("doc_id % 100 = 0").collect()])

    def against(batches):
        known = [(d, s, np.unique(s)) for d, s in ((d, shingles(t)) for d, t in queries.value) if len(s)]
        for frame in batches:
            found = []
            for key, text in zip(frame.doc_id, frame.text, strict=True):
                s = shingles(text)
                u = np.unique(s)
                for d, q, uq in known:
                    if d != key and min(len(s), len(q)) >= 0.8 * max(len(s), len(q)) > 0 and (level := band(q, s)):
                        found.append((d, key, level))
            yield frame.iloc[:0].assign(level=0.0)[["doc_id", "doc_id", "level"]].set_axis(["a", "b", "level"], axis=1) if not found else __import__("pandas").DataFrame(found, columns=["a", "b", "level"])

    pairs = df.repartition(32).mapInPandas(against, "a long, b long, level double").collect()
    there, met = Counter(r.level for r in pairs), Counter(r.level for r in pairs if label[r.a] == label[r.b])
    for level in BANDS:
        if there[level]:
            print(f"{level}: {met[level]} of {there[level]} pairs, {met[level] / there[level]:.4f}")


if __name__ == "__main__":
    main()
