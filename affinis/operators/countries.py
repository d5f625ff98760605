"""Countries by patterns of any number: an automaton over all patterns, applied to batches of texts.

The pattern table is written to the shared folder. Each task reads it in blocks of
``BLOCK_PATTERNS``, builds an Aho-Corasick automaton of a block and runs it over its texts; with
one block the automaton is kept. Neither the plan nor the driver holds a pattern.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from affinis.session import scratch_path

BLOCK_PATTERNS = 200_000


@lru_cache(maxsize=1 << 16)
def _in_word(char: str) -> bool:
    """Letters, marks, digits, letter-like numbers, connectors and joiners."""
    kind = unicodedata.category(char)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or char in "‌‍"


def _border(text: str, at: int) -> bool:
    """Whether a word begins or ends at the place."""
    return (at > 0 and _in_word(text[at - 1])) != (at < len(text) and _in_word(text[at]))


def _automaton(patterns: Iterable[tuple[str, str]]):
    from ahocorasick import Automaton

    owners: dict[str, set[str]] = {}
    for country, pattern in patterns:
        owners.setdefault(pattern, set()).add(country)
    found = Automaton()
    for pattern, countries in owners.items():
        found.add_word(pattern, (len(pattern), countries))
    found.make_automaton()
    return found


def _seen(automaton, text: str) -> set[str]:
    """Countries with a pattern between word borders; patterns may overlap and lie inside each other."""
    out: set[str] = set()
    for last, (size, countries) in automaton.iter(text):
        if not countries <= out and _border(text, last + 1 - size) and _border(text, last + 1):
            out |= countries
    return out


class _Automata:
    """Automata of the blocks of patterns in a folder; a single one is kept."""

    def __init__(self, folder: str, size: int) -> None:
        self.folder, self.size, self.kept = folder, size, None

    def __iter__(self) -> Iterator:
        import pyarrow.dataset as ds
        from pyarrow import fs

        if self.kept is not None:
            yield self.kept
            return
        files, root = fs.FileSystem.from_uri(self.folder)
        count, block, one = 0, [], None
        for batch in ds.dataset(root, filesystem=files, format="parquet").to_batches(columns=["country", "pattern"]):
            for pair in zip(batch.column("country").to_pylist(), batch.column("pattern").to_pylist()):
                block.append(pair)
                if len(block) == self.size:
                    count, one, block = count + 1, _automaton(block), []
                    yield one
        if block:
            count, one = count + 1, _automaton(block)
            yield one
        if count == 1:
            self.kept = one


def _tagged(folder: str, text_col: str, size: int):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        automata = _Automata(folder, size)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found: list[set[str]] = [set() for _ in texts]
            for automaton in automata:
                for own, text in zip(found, texts):
                    own |= _seen(automaton, text)
                    if "." in text:
                        own |= _seen(automaton, text.replace(".", ""))
            column = pa.array([sorted(own, key=str.encode) for own in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "countries"])

    return run


def with_countries(texts: DataFrame, patterns: DataFrame, text_col: str = "text", block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """``texts`` with ``countries``: sorted countries that have a pattern in the text or in its dot-free form.

    ``patterns`` has country and pattern, literal texts of any number; null and empty ones are left
    out. A null text has no countries.
    """
    folder = scratch_path(texts.sparkSession, "country-patterns")
    stored = patterns.select("country", "pattern").where("country is not null and pattern <> ''").distinct()
    stored.write.parquet(folder)
    schema = T.StructType([*texts.schema, T.StructField("countries", T.ArrayType(T.StringType()))])
    return texts.mapInArrow(_tagged(folder, text_col, block_patterns), schema)
