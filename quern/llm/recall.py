"""python -m quern.llm.recall FOLDER [SEEDS]: which share of the best BM25 neighbours over all documents packing can find.

Brute force on one machine, for tables that fit into its memory: the postings of all documents, SEEDS seeds of at least 20 tokens
drawn by a hash, their ten best neighbours, and whether these lie in the seed's shard."""

from __future__ import annotations

import os
import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.llm import packing


def measure(spark: SparkSession, folder: str, seeds: int = 200) -> dict[str, float]:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    shard = {r.doc_id: r.shard_id for r in packing.pack_documents(docs).groupBy("doc_id").agg(F.min("shard_id").alias("shard_id")).toLocalIterator()}
    enc, names, every = packing.encoder(None), [], []
    for r in docs.toLocalIterator():
        names.append(r.doc_id)
        every.append(np.array([*enc.encode(r.text or ""), packing.END], "<u4"))
    stats, n = packing.stats_of(every), len(every)
    terms = [packing.terms_of(x) for x in every]
    doc = np.repeat(np.arange(n), [len(t) for t, _ in terms])
    term, often = (np.concatenate(c) for c in zip(*terms, strict=True))
    norm = packing.K1 * (1 - packing.B + packing.B * np.array([len(x) - 1 for x in every]) / stats.mean)
    weight = (stats.idf[term] * often * (packing.K1 + 1) / (often + norm[doc])).astype(np.float32)
    order = np.argsort(term, kind="stable")
    doc, weight, begin = doc[order], weight[order], np.searchsorted(term[order], np.arange(packing.FEATURES + 1))
    home = np.array([shard[x] for x in names])
    drawn = sorted((i for i in range(n) if len(every[i]) > 20), key=lambda i: packing.mix64(np.array([names[i]], np.uint64))[0])[:seeds]
    ten, one, mass = [], [], []
    for i in drawn:
        score = np.zeros(n, np.float32)
        for t in terms[i][0]:
            score[doc[begin[t] : begin[t + 1]]] += weight[begin[t] : begin[t + 1]]
        score[i] = 0
        best = np.argsort(-score, kind="stable")[:10]
        same = home[best] == home[i]
        ten.append(same.mean())
        one.append(same[0])
        mass.append(score[best][same].sum() / score[best].sum())
    return {"documents": n, "shards": len(set(home.tolist())), "of ten": float(np.mean(ten)), "of the best": float(np.mean(one)), "of their scores": float(np.mean(mass))}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", os.environ.get("PARTS", "12")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print({k: round(v, 4) for k, v in measure(session, sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 200).items()})
