"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept, on whole texts. All but the last
return the columns of documents, and columns of other names, whatever they are, go through unchanged. Tables without
rows give none.

Nulls and empties: null and empty texts and those without a letter have no language and go in the first stage. A null
lang is not learnt from, a null source is a source of its own in mixing and conflicts with nothing in packing. Rows with
a null id stay where a stage keeps one row of an id. Documents without words pass the mixing stage only if their source has whole copies.
Repeats and ties: repeated rows fare alike in the first two stages; of an id one row, the first by text, stays in the
third; ties of rank in mixing and of size in packing go by the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreline.llm import langid, mixing, packing, simhash, toxicity
from scoreline.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and has most of the words; the languages are those of the column lang."""
    return langid.keep_identified(docs, langid.train(docs))


def toxic_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learnt from the table labels, scores below the threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts whose five-word shingles are 0.8 similar or more; candidates by SimHash and MinHash."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat_rows(docs, mixing.mix_sources(docs))


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document, copies of the mix included, in sequences of fixed length."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("toxic_grammar", toxic_grammar),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_best_fit", pack_best_fit),
]

#: SQL can't express the models of the first two stages; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
