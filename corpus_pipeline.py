"""From raw documents to a mixed, tokenized corpus, stage by stage.

Each stage takes the documents its predecessor kept, acts on all of them and
returns documents again; the last adds token ids. Between stages the documents
are written to the shared folder and read again, so a lost executor costs no
more than the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import jaccard, lines, mixing, pieces, toxicity
from shardloom.llm.common import read, settle

STAGES = [
    ("toxicity", toxicity.reject_toxic),
    ("line_dedup", lines.without_repeats),
    ("near_duplicates", jaccard.one_of_each),
    ("source_mix", mixing.mix_sources),
    ("pieces", pieces.tokens),
]

# A classifier, a sampled join and Newton steps have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
