"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``,
and returns a DataFrame; all but the last return those columns again.
"""

from __future__ import annotations

import functools

from factweave.llm.bpe_codec import encode_decode
from factweave.llm.jaccard_join import keep_one_of_each
from factweave.llm.mixing import expand_copies, mix_sources
from factweave.llm.personal_data import sanitise
from factweave.llm.quality_rules import keep_good
from factweave.llm.store import materialize, ship_package, stage_tables


def _stage(f):
    """The stage, after the tables of the stage before it are gone: ``docs`` has been written since."""

    @functools.wraps(f)
    def run(spark, docs, sf_dir):
        with stage_tables(spark):
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark, docs, sf_dir):
    """Rejected documents go: very short or repetitive ones, and those that learned rules reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return keep_one_of_each(docs, k=5, percent=80)


@_stage
def personal_data(spark, docs, sf_dir):
    """Identifiers, and terms that disclose them, are masked in the texts."""
    return sanitise(docs)


@_stage
def mixing(spark, docs, sf_dir):
    """Documents are taken as often as the mix of sources wants."""
    return expand_copies(docs, mix_sources(docs))


@_stage
def encoding(spark, docs, sf_dir):
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text, a row for each copy."""
    ship_package(spark)
    return encode_decode(docs, contents=("ids",)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixing),
    ("encoding", encoding),
]
#: The decision list, the tokenizer and connected components aren't expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; what each returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
