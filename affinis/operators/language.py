"""Language of a string from its letters and learned trigram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affinis.functions.text import NON_ASCII
from affinis.session import scratch_path

# A trigram of a text counts for this share of its rank in a language's profile.
RANK_WEIGHT = 1_000_000
# Bytes of text whose trigrams a task holds at a time, and bits of a character in the number of a trigram.
TEXT_BYTES, BITS = 1 << 20, 21

# --- fixed values: scripts that decide the language, and letters that split a script ---
SCRIPT_LANGUAGES = [("Hangul", "ko"), ("Han", "zh-cn"), ("Cyrillic", "ru"), ("Arabic", "ar")]
KANA = ["Hiragana", "Katakana"]
UKRAINIAN_LETTERS = "іїєґІЇЄҐ"
PERSIAN_LETTERS = "پچژگ"
VIETNAMESE_LETTERS = "ăđơưĂĐƠƯẠ-ỹ"


def _letters(c: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{cls}]+", ""))  # runs: a replacement for each character is many times slower


def script_language(c: Column) -> Column:
    """Language told by the script most letters belong to; null for Latin text.

    The scripts have no ASCII characters: all tests are on the others, taken out of the text once.
    """
    parts = F.struct(F.length(F.regexp_replace(c, r"\P{L}+", "")).alias("letters"), F.regexp_replace(c, r"[\x00-\x7F]+", "").alias("rest"))
    told = F.transform(F.array(parts), lambda p: _told(p["letters"], p["rest"]))
    return F.when(c.rlike(NON_ASCII), F.get(told, F.lit(0)))


def _told(letters: Column, c: Column) -> Column:
    kana = "".join(rf"\p{{Is{k}}}" for k in KANA)
    out = F.when(letters == 0, F.lit(None)).when(c.rlike(f"[{kana}]") & (_letters(c, kana + r"\p{IsHan}") * 2 >= letters), "ja")
    for script, lang in SCRIPT_LANGUAGES:
        most = _letters(c, rf"\p{{Is{script}}}") * 2 >= letters
        if lang == "ru":
            out = out.when(most & c.rlike(f"[{UKRAINIAN_LETTERS}]"), "uk")
        if lang == "ar":
            out = out.when(most & c.rlike(f"[{PERSIAN_LETTERS}]"), "fa")
        out = out.when(most, lang)
    return out.when(_letters(c, VIETNAMESE_LETTERS) * 10 >= letters, "vi")


def letters_only(c: Column) -> Column:
    """The letters of a text in lower case, words separated by one blank: its trigrams are all runs of three characters."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]+", " "))


def _pieces(batches, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``TEXT_BYTES`` of text, one row at least."""
    for batch in batches:
        number = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // TEXT_BYTES
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(low, high - low) for low, high in zip(edges, edges[1:]) if low < high)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every trigram of texts without line feeds; a null has none."""
    joined = "\n".join(t or "" for t in texts.to_pylist())
    signs = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = signs == ord("\n")
    if len(signs) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~(ends[:-2] | ends[1:-1] | ends[2:])
    return np.cumsum(ends)[:-2][inside], (signs[:-2] << 2 * BITS | signs[1:-1] << BITS | signs[2:])[inside]


def _spelled(grams: np.ndarray) -> pa.Array:
    signs = np.stack([grams >> 2 * BITS, grams >> BITS & (1 << BITS) - 1, grams & (1 << BITS) - 1], axis=1).astype(np.uint32)
    return pa.array(np.ascontiguousarray(signs).view("<U3").ravel(), pa.string())


def _counted(batches) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, "text"):
        row, grams = _grams(batch.column("text"))
        coded = batch.column("lang").dictionary_encode()
        lang = coded.indices.fill_null(-1).to_numpy()[row]
        for number in np.unique(lang).tolist():
            found, n = np.unique(grams[lang == number], return_counts=True)
            name = pa.repeat(coded.dictionary[number] if number >= 0 else pa.scalar(None, pa.string()), len(found))
            yield pa.RecordBatch.from_arrays([name.cast(pa.string()), _spelled(found), pa.array(n)], ["lang", "gram", "n"])


def fit_language_profiles(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """All trigrams of each language with their rank by frequency.

    Tasks count the trigrams of a piece of text at a time; the ranking sees distinct trigrams only.
    """
    flat = df.select(F.col(lang_col).cast("string").alias("lang"), letters_only(F.col(text_col)).alias("text"))
    counts = flat.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(w)).select("lang", "gram", "rank")


class _Profiles:
    """Stored profiles: for each trigram, in order of its number, the languages that have it with its weight there."""

    def __init__(self, folder: str) -> None:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        table = ds.dataset(root, filesystem=files, format="parquet").to_table()
        coded = table.column("lang").combine_chunks().dictionary_encode()
        number = _grams(table.column("gram").combine_chunks())[1]
        order = np.argsort(number, kind="stable")
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy()[order]
        self.weight = RANK_WEIGHT // table.column("rank").to_numpy()[order].astype(np.int64)
        self.grams, self.start, self.size = np.unique(number[order], return_index=True, return_counts=True)

    def sums(self, texts: pa.Array) -> pa.Array:
        """For each text the languages that have a trigram of it, with the sum of their weights over its distinct trigrams."""
        row, grams = _grams(texts)
        found, back = np.unique(grams, return_inverse=True)
        place = np.searchsorted(self.grams, found)
        place[place == len(self.grams)] = 0
        place = np.where(self.grams[place] == found, place, -1)[back] if len(self.grams) else np.full(len(grams), -1)
        row, place = row[place >= 0], place[place >= 0]
        row, place = np.divmod(np.unique(row * max(1, len(self.grams)) + place), max(1, len(self.grams)))
        sizes = self.size[place]
        entry = np.repeat(self.start[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cell = np.repeat(row, sizes) * max(1, len(self.langs)) + self.lang[entry]
        has = np.bincount(cell, minlength=len(texts) * len(self.langs))
        sums = np.bincount(cell, self.weight[entry], len(has)).astype(np.int64)  # whole numbers, exact below 2 ** 53
        at = np.flatnonzero(has)
        row, lang = np.divmod(at, max(1, len(self.langs)))
        pairs = pa.StructArray.from_arrays([self.langs.take(pa.array(lang)), pa.array(sums[at])], ["lang", "s"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), pairs)


@lru_cache(maxsize=2)
def _profiles(folder: str) -> _Profiles:
    """The stored profiles; a worker keeps them from task to task."""
    return _Profiles(folder)


def _scored(folder: str, schema: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, _profiles(folder).sums(batch.column("text"))], schema=schema)

    return run


def detect_language(df: DataFrame, id_col: str, text_col: str, profiles: DataFrame | None = None,
                    default: str = "en") -> DataFrame:
    """``id, lang`` per row: script first, then the profile sharing most weight, then ``default``.

    A text scores ``RANK_WEIGHT / rank``, in whole numbers, for each distinct
    trigram in it that a language has. Profiles are written to the shared folder and read by the tasks, so neither texts nor
    their trigrams are shuffled: a row's sums are, one for each language.
    """
    scripted = df.select(id_col, text_col, script_language(F.col(text_col)).alias("_script"))
    if profiles is None:
        return scripted.select(id_col, F.coalesce("_script", F.lit(default)).alias("lang"))
    folder = scratch_path(df.sparkSession, "language-profiles")
    known = profiles.filter(F.col("lang").isNotNull() & (F.length("gram") == 3) & ~F.col("gram").contains("\n"))
    known.select("lang", "gram", "rank").write.parquet(folder)
    open_text = F.when(F.col("_script").isNull(), letters_only(F.col(text_col)))
    asked = scripted.select(F.col(id_col).alias("id"), F.col("_script").alias("script"), open_text.alias("text"))
    pair = T.StructType([T.StructField("lang", T.StringType()), T.StructField("s", T.LongType())])
    schema = T.StructType([asked.schema["id"], asked.schema["script"], T.StructField("sums", T.ArrayType(pair))])
    found = asked.mapInArrow(_scored(folder, to_arrow_schema(schema)), schema)
    hits = found.select("id", "script", F.explode_outer("sums").alias("hit")).select("id", "script", "hit.*")
    sums = hits.groupBy("id", "lang").agg(F.first("script").alias("script"), F.sum("s").alias("s"))
    best = sums.groupBy("id").agg(
        F.first("script").alias("script"),
        F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("s")).alias("s"), F.col("lang").alias("lang")))).alias("b"),
    )
    return best.select(F.col("id").alias(id_col), F.coalesce("script", F.col("b.lang"), F.lit(default)).alias("lang"))
