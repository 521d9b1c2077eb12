"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept. All but the last return the columns of documents; their result is written as
Parquet and read again as the next stage's docs.

Defined cases, in every stage: a null text is empty; a null lang, source or n_chars
changes nothing but that it is not learned from; rows without a doc_id are never held
out, never anybody's copy and stay or go by their text; extra columns are kept to the
last stage; an empty table gives an empty one; texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid, nearcopies, packing, quality
from quern.llm.common import crc32_is, read_table, written

#: Least language score with which a document stays; texts without a letter go. The score is about the share of the
#: letters that are in the language: halves of two languages score 0.5 or more, four mixed word by word 0.26 to
#: 0.43 at 200 words, and a text that is all in one language 0.5 at least, however short (the README has the counts).
LEAST_LANGUAGE_SCORE = 0.4


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on their labelled rows, scores 0.3 or more.

    An empty text is scored as any other; ties at 0.3 stay; repeated rows stay or go together;
    without a labelled row every document scores 0.5 and stays.
    """
    machine = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~crc32_is("doc_id", 5, 0))
    return quality.keep_good(docs, machine)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from these documents; those mixed of so many that none stands out go.

    Texts without a letter have none and go; of equal scores the language that sorts first counts;
    repeated rows stay or go together; without a row that has a lang every document goes.
    """
    return langid.keep_identified(docs, langid.fit(docs.filter(~crc32_is("doc_id", 4, 2))), LEAST_LANGUAGE_SCORE)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies: near fingerprints, or shingle sets 0.8 alike or more.

    Texts without a word are copies of each other; of rows with one doc_id the one whose text has
    the least hash stays; rows without a doc_id all stay.
    """
    return nearcopies.first_of_groups(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences.

    An empty text is its end token alone; repeated rows are packed as often as they are there.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", by_quality),
    ("language", by_language),
    ("near_duplicates", first_of_near_duplicates),
    ("packing", packed),
]

#: No stage but the last could be put in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
