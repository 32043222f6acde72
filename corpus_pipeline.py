"""From raw documents to training batches: each stage is an operator of ``inodeatlas.llm``.

A stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the
next one's docs. All but the last return the columns of ``documents``:

1. language: texts that no learnt language explains go;
2. quality: texts that fail the base rules or the classifier go;
3. near copies: one document of each class stays;
4. repeats: passages that an earlier place has are cut out, texts left without a word go;
5. packing: bucket and batch of every document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inodeatlas.llm import buckets, langid, nearcopies, quality, suffixes
from inodeatlas.llm.common import prepare, stored, table


def language(spark, docs, sf_dir):
    model = langid.train(docs, F.lit(True))
    return langid.keep_known(docs, model)


def quality_rules(spark, docs, sf_dir):
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_copies(spark, docs, sf_dir):
    return nearcopies.keep_one(docs)


def repeats(spark, docs, sf_dir):
    return suffixes.remove_repeats(docs)


def packing(spark, docs, sf_dir):
    return buckets.pack(docs)


STAGES = [("language", language), ("quality", quality_rules), ("near copies", near_copies), ("repeats", repeats), ("packing", packing)]

# Learnt models, signatures and dynamic programming: tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, applied to ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
