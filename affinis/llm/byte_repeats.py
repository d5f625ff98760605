"""Substring dedup by suffix arrays: bytes that a repeated window covers are removed.

A window is ``length`` bytes of one document. It is repeated if the same bytes also start in a
document with a smaller doc_id. Candidates are found by ``repeats``; the passages that need
comparing are dealt to shards. A shard's task builds the suffix array of its passages by linear grouping
construction (``suffix_structures.suffix_array``); windows that are equal are neighbours in it.

Defined results: a null text is empty; rows with one doc_id are not earlier than each other; a
null doc_id comes last; what is left of a text need not be valid UTF-8; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from affinis.llm.repeats import Plan, without_repeats
from affinis.llm.suffix_structures import array_classes


def dedup_bytes(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and ``kept``: the bytes left)."""
    gram = max(1, length * 2 // 5)
    plan = Plan(words=False, length=length, gram=gram, within=False, classes=array_classes, block_bytes=1 << 19)
    return without_repeats(docs, plan, with_text).withColumnRenamed("n_units", "n_bytes")
