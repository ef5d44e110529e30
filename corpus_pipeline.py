"""From raw documents to packed training bins, in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared folder and
gives the reread table to the next. All stages but the last keep the columns of ``documents``.

1. quality rules: texts that fail a base rule or look less like the trusted target than the raw corpus go;
2. quality classifier: texts whose lines are likelier bad go (trained on the labelled rows of the raw table);
3. n-gram Jaccard join: one text of each group of near copies stays;
4. benchmark decontamination: texts with a benchmark passage go;
5. best-fit packing: what is left is packed into bins; near copies have gone, so texts that differ in case or white space only are its clusters.

Defined results: null, empty and blank texts fail the first stage. Of repeated rows one stays in the third stage, as of near copies; repeated ids with
different texts are documents of their own. Columns besides id, text and source are carried through the filters and not read. Nulls in other columns change nothing, and
an empty table gives an empty result. Without labels, texts that pass the base rules are the trusted target and no classifier is learnt: all texts pass it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, line_crf, ngram_jaccard, packing, quality_rules
from folioflow.llm.common import read, shared_folder
from folioflow.llm.queries import trusted


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, quality_rules.weights(docs, trusted(spark, sf_dir)))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.good(docs, line_crf.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("best-fit packing", bins)]

#: DuckDB has neither the hashes nor the trained models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
