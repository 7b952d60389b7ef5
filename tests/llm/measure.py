"""What the README says of results: python tests/llm/measure.py [FOLDER], over sf0.1 unless told otherwise.

Prints, for near-duplicates, the share of all pairs of documents by the Jaccard
similarity of their word sets (every pair is compared) that are in one group;
for the line field and the byte network, accuracy on documents that they
weren't trained on; for guess costs, how many values are secrets.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from polymere.llm import byte_cnn, guess_cost, line_crf, simhash_index  # noqa: E402
from polymere.llm.common import table  # noqa: E402


def near_duplicates(spark: SparkSession, folder: str) -> None:
    rows = table(spark, folder, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    ids = {r.doc_id: i for i, r in enumerate(rows)}
    kept = np.arange(len(rows))
    found = simhash_index.near_duplicates(table(spark, folder, "documents")).collect()
    for r in found:
        kept[ids[r.doc_id]] = ids[r.kept_id]
    numbers: dict[str, int] = {}
    sets = [np.array(sorted({numbers.setdefault(w, len(numbers)) for w in re.findall(r"\w+", r.text.lower())}), np.int64) for r in rows]
    postings = defaultdict(list)
    for i, s in enumerate(sets):
        for w in s.tolist():
            postings[w].append(i)
    lists = {w: np.array(p) for w, p in postings.items()}
    sizes = np.array([len(s) for s in sets])
    bands, least = Counter(), np.zeros(len(rows))
    joined = Counter()
    for i, s in enumerate(sets):
        if not len(s):
            continue
        both = np.bincount(np.concatenate([lists[w] for w in s.tolist()]), minlength=len(rows))
        j = both / (sizes[i] + sizes - both)
        j[i] = 0
        mine = (kept == kept[i]) & (np.arange(len(rows)) != i)
        least[i] = j[mine].max() if mine.any() else 0
        for k in np.flatnonzero(j[:i] >= 0.5).tolist():
            band = min(19, int(j[k] * 20)) / 20
            bands[band] += 1
            joined[band] += kept[k] == kept[i]
    print(f"near-duplicates: {len(found)} of {len(rows)} documents removed; {sum(least[ids[r.doc_id]] < 0.55 for r in found)} of them have no group member of similarity 0.55 or more")
    for b in sorted(bands):
        print(f"  similarity {b:.2f} and more: {joined[b]} of {bands[b]} pairs in one group")


def line_field(spark: SparkSession, folder: str) -> None:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = line_crf.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("label")), "doc_id").filter("quality is not null")
    for r in got.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~F.col("keep")).alias("rejected")).orderBy("label").collect():
        print(f"line field, fitted on even ids: of odd ids labelled {r[0]}, {r.rejected} of {r.n} rejected")


def languages(spark: SparkSession, folder: str) -> None:
    docs = table(spark, folder, "documents")
    net = byte_cnn.train(docs.filter("doc_id % 2 = 0"))
    rows = docs.filter("doc_id % 2 = 1 and lang is not null and text <> ''").select("text", "lang").toArrow()
    p, _ = byte_cnn.classify(net, rows.column("text").combine_chunks())
    right = sum(net.languages[i] == lang for i, lang in zip(p.argmax(axis=1).tolist(), rows.column("lang").to_pylist()))
    print(f"byte network, trained on even ids: {right} of {rows.num_rows} odd ids as declared")


def secrets(spark: SparkSession, folder: str) -> None:
    r = guess_cost.scan(table(spark, folder, "documents")).agg(F.count("*"), F.count_if("secret")).first()
    print(f"guess costs: {r[0]} values, {r[1]} of them secrets")


if __name__ == "__main__":
    at = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for part in (line_field, languages, secrets, near_duplicates):
        part(session, at)
