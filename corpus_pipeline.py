"""The corpus pipeline: stages over ``documents``, each written to the shared folder and read again before the next.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``, whatever other columns it has and whatever they are called.

Nulls and other cases, in every stage: an empty table gives an empty result, without labels or test items too;
texts of any length are read whole; rows that repeat one another are documents of their own until near
copies go; a null id is an id. What a stage makes of null and empty texts and of ties is said there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common
from tallyweave.llm.decontaminate import remove_passages
from tallyweave.llm.jaccard_join import one_of_each
from tallyweave.llm.mixing import Mix
from tallyweave.llm.token_store import token_output
from tallyweave.llm.toxicity import learn_toxicity, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; one without words has no evidence and stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_toxicity(docs, labels, common.fold(F.col("doc_id"), 4) != 2)
    return without_toxic(docs, model, threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, one stays.

    It is the one of the smallest id; of those with equal ids the one whose text has the smallest hash, and of rows that
    repeat one another any. Documents without words belong to no group and all stay.
    """
    return one_of_each(docs, width=5, percent=80)


def cut_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that share 10 words with a test item are cut out; documents that are mostly such passages go.

    Exactly half of the words is not mostly. Null texts stay null, and n_chars is that of the text left.
    """
    out = remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled within their shards.

    A null source is a source; null and empty texts are drawn like others and have no words. Repeated rows are drawn together.
    """
    return Mix(docs, weights=(5, 2, 1), cap=3.0).shuffled()


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of doc_id, and what each document's ids in them are.

    A null text holds the end id alone; equal ids stand in the order of a hash of their texts, null ids first.
    """
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", cut_test_items),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: A conditional random field and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
