"""The corpus pipeline: five operators one after the other over ``documents``, each result written and read again.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealscreen.llm.common import materialise, read
from dealscreen.llm.decontaminate import remove_contaminated
from dealscreen.llm.pieces import to_pieces
from dealscreen.llm.pii import replace_private
from dealscreen.llm.quality import keep_good
from dealscreen.llm.simhash import keep_one

STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one),
    ("benchmark decontamination", remove_contaminated),
    ("PII", replace_private),
    ("SentencePiece encoding", to_pieces),
]

#: Perplexities, fingerprints and sampled segmentations have no SQL form; the tests restate the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, materialise(docs) if i else docs, sf_dir)
    return docs
