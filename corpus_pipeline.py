"""From raw documents to packed training sequences.

``STAGES`` are applied in order, each to what its predecessor kept: documents
whose language cannot be told go; of near-duplicates (by ``SHINGLE``-word
shingles) the one of smallest id stays; strings that an earlier document holds
are cut out of the texts (what is left of a code point that lost bytes goes,
too); sources are mixed to their target weights, so a document may come several
times or not at all; and the rest is packed into sequences. All but the last
return the columns of their input.

Extra columns are carried along to the last stage. Null, empty, repeated and
very long rows are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import language_id, minhash, mixing, packing, suffix_dedup
from folioscope.llm.common import read_table, written

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.representatives(docs, width=SHINGLE)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("source_mixing", mixing_to_weights),
    ("best_fit_packing", packed_sequences),
]

#: Kernel scores, near-duplicate components and token ids have no SQL form; the
#: stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
