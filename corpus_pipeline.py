"""A training-data pipeline: STAGES in order, each one's Parquet output being the next one's documents."""

from __future__ import annotations

import public_tokenizers

from metaloom.llm import byte_bpe, decontamination, near_dedup, pii, toxicity
from metaloom.llm.common import keep, table


def drop_toxic(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    return near_dedup.drop_copies(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark, docs, sf_dir):
    return pii.redact(docs)


def encode(spark, docs, sf_dir):
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("byte_bpe", encode),
]

#: A trained classifier, sketches and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
