"""Substring dedup by suffix automata: words that a repeated window covers are removed.

A window is ``length`` consecutive words of one document. It is repeated if its words also start
earlier: in a document with a smaller doc_id, or earlier in the same one. Candidates are found by
``repeats``; the passages that need comparing are the reference, dealt to shards. A shard's task
builds one suffix automaton over its reference and streams every passage through it; the matching
statistics give, for each place where at least ``length`` words match, the state that stands for
those words, and with it the earliest place they have.

Defined results: a null text has no words; rows with one doc_id are one document for the
order of starts; a null doc_id comes last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from affinis.llm.repeats import Plan, without_repeats
from affinis.llm.suffix_structures import automaton_classes


def dedup_words(docs: DataFrame, length: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and ``kept``: the words left, with spaces between)."""
    gram = max(1, length * 2 // 5)
    plan = Plan(words=True, length=length, gram=gram, within=True, classes=automaton_classes, block_bytes=2 << 20)
    found = without_repeats(docs, plan, with_text).withColumnRenamed("n_units", "n_words").drop("n_spans")
    return found.withColumn("kept", found.kept.cast("string")) if with_text else found
