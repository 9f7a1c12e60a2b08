"""A corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last
returns what its token table holds. Results of a stage are written and read again before the next one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import decontam, langid, mixing, near_dup, token_orc
from tallystone.llm.common import written
from tallystone.llm.queries import table, tokenizer_file


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, whatever their score; without a label to learn from, a profile of zeros stands for any language."""
    learned = langid.prototypes(docs) or {"any": np.zeros(langid.DIMENSIONS)}
    return langid.identified(docs, learned)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the smallest doc_id."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids as ORC, and what is read from it: doc_id, start, n_tokens, ids_crc32."""
    return token_orc.encode_and_read(docs, tokenizer_file())


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token-ID output", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs


#: Most stages can't be expressed in SQL.
ORACLE_SQL = None
