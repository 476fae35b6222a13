"""A training-data pipeline of five stages over the ``documents`` table.

Each stage works on all rows that its predecessor kept, returns the columns of documents (the
last one: packed pieces) and is written as Parquet before the next one reads it.  Rows are
never capped or sampled.  Null, empty and very long texts, repeated rows and empty tables have
the results that the operators define.
"""

from __future__ import annotations

import uuid

from idweave.llm import jaccard_join, language_id, packing, quality_rules, suffix_dedup
from idweave.llm.common import table
from idweave.sources.stored import shared_folder


def identify_language(spark, docs, sf_dir):
    """Documents whose language is known with a score of at least one half; the others go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def apply_quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def join_near_copies(spark, docs, sf_dir):
    """One document of each class of near copies: the one with the least id."""
    return jaccard_join.keep_representatives(docs)


def cut_repeats(spark, docs, sf_dir):
    """All documents, without the passages of over 50 words that occur again."""
    return suffix_dedup.remove_repeats(docs, rule=suffix_dedup.PASSAGES)


def pack(spark, docs, sf_dir):
    """Pieces of the remaining texts, packed into sequences of several lengths."""
    return packing.pack_texts(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: The models are trained and near copies are joined: SQL cannot express that.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other, each written to the session's shared checkpoint folder."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
