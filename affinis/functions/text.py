"""Text expressions: folding, matching keys, country search, tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: transliterations that are not "base letter plus accent" ---
MULTI_LETTER_FOLDS = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "\u2026": "...", "\u2014": "--", "\u2015": "--",
}
SYMBOL_FOLDS = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3",
    "№": "No", "™": "tm", "℠": "sm", "℃": "C", "℡": "TEL",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
SINGLE_LETTER_FOLDS = {
    "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l",
    "Ħ": "H", "ħ": "h", "ı": "i", "Ŧ": "T", "ŧ": "t",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2044": "/",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
CYRILLIC_FOLDS = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "Io", "Ж": "Zh",
    "З": "Z", "И": "I", "Й": "I", "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O",
    "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U", "Ф": "F", "Х": "Kh", "Ц": "Ts",
    "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ъ": "'", "Ы": "Y", "Ь": "'", "Э": "E",
    "Ю": "Iu", "Я": "Ia", "І": "I", "Ї": "Yi", "Є": "Ie", "Ґ": "G",
}
GREEK_FOLDS = {
    "Α": "A", "Β": "B", "Γ": "G", "Δ": "D", "Ε": "E", "Ζ": "Z", "Η": "E", "Θ": "Th",
    "Ι": "I", "Κ": "K", "Λ": "L", "Μ": "M", "Ν": "N", "Ξ": "X", "Ο": "O", "Π": "P",
    "Ρ": "R", "Σ": "S", "ς": "s", "Τ": "T", "Υ": "U", "Φ": "Ph", "Χ": "Kh", "Ψ": "Ps",
    "Ω": "O",
}
# --- fixed values: abbreviations expanded before matching ---
ABBREVIATIONS = [("Univ.", "University"), ("Lab.", "Laboratory")]
ARMED_FORCES = [
    ("U.S. Army", "United States Army"),
    ("U.S. Navy", "United States Navy"),
    ("U.S. Air Force", "United States Air Force"),
]
# --- fixed values: the one special token of the tokenizer ---
UNKNOWN_TOKEN = "[UNK]"

NON_ASCII = r"[^\x00-\x7F]"


def _latin_folds() -> dict[str, str]:
    """Accented Latin letters whose decomposition starts with an ASCII letter."""
    folds = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            folds[chr(code)] = base
    return folds | SINGLE_LETTER_FOLDS


def _compatible_folds() -> dict[str, str]:
    """Full-width, raised, lowered, circled and letter-like forms of one ASCII character."""
    folds = {}
    for code in [*range(0x2070, 0x20A0), *range(0x2100, 0x2150), *range(0x2460, 0x24F0), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code))
        if len(base) == 1 and base.isascii():
            folds[chr(code)] = base
    return folds


def _script_folds() -> dict[str, str]:
    """Greek and Cyrillic letters in both cases, with and without accents."""
    base = GREEK_FOLDS | CYRILLIC_FOLDS
    folds = {**base, **{k.lower(): v.lower() for k, v in base.items()}}
    for code in [*range(0x0370, 0x0530), *range(0x1F00, 0x2000)]:
        letter = unicodedata.normalize("NFD", chr(code))[0]
        if letter in folds:
            folds.setdefault(chr(code), folds[letter])
    return folds


def _pairs(table: Mapping[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("old"), F.lit(v).alias("new")) for k, v in table.items()])


def ascii_fold(c: Column) -> Column:
    """Transliterate to ASCII. Letters of scripts without a rule are dropped.

    Texts that are plain ASCII already skip every table, and texts without a Greek or Cyrillic
    letter the replacements of those.
    """
    table = SYMBOL_FOLDS | _compatible_folds() | MULTI_LETTER_FOLDS | _latin_folds() | _script_folds()
    single = {k: v for k, v in table.items() if len(v) == 1}
    scripts = {k: v for k, v in table.items() if len(v) > 1 and "\u0370" <= k <= "\u052f"}
    others = {k: v for k, v in table.items() if len(v) > 1 and k not in scripts}
    # one range as the test: a class that lists letters is slower than the replacements it spares
    pairs = F.when(c.rlike("[\\u0370-\\u052F]"), _pairs(others | scripts)).otherwise(_pairs(others))
    spelled = F.aggregate(pairs, c, lambda text, pair: F.replace(text, pair.old, pair.new))
    folded = F.regexp_replace(F.translate(spelled, "".join(single), "".join(single.values())), NON_ASCII, "")
    return F.when(c.rlike(NON_ASCII), folded).otherwise(c)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ampersand(c: Column) -> Column:
    """`` & `` becomes `` and `` unless the text speaks of R&D."""
    return F.when(F.lower(c).contains("r&d"), c).otherwise(F.replace(c, F.lit(" & "), F.lit(" and ")))


def drop_country_suffix(c: Column, countries: Iterable[str]) -> Column:
    """When the text ends in ``(country)``, remove every ``(country)``."""
    names = sorted(set(countries))
    if not names:
        return c
    suffix = F.regexp_extract(c, r"(\((?:%s)\))\s*$" % "|".join(map(re.escape, names)), 1)
    return F.replace(c, suffix, F.lit(""))  # an empty suffix replaces nothing


def expand_and_strip(c: Column, armed_forces: bool) -> Column:
    for short, full in ABBREVIATIONS + (ARMED_FORCES if armed_forces else []):
        c = F.replace(c, F.lit(short), F.lit(full))
    return F.regexp_replace(c, "[^0-9a-zA-Z]", "")


def clean_match_text(c: Column, countries: Iterable[str] = (), armed_forces: bool = True) -> Column:
    """Key used for all name and place containment tests."""
    return expand_and_strip(ascii_fold(drop_country_suffix(ampersand(c), countries)), armed_forces)


def with_clean_text(df: DataFrame, col: str, out: str, countries: Iterable[str] = ()) -> DataFrame:
    """``clean_match_text`` in steps, so no step is evaluated twice on a row."""
    staged = df.withColumn(out, ampersand(F.col(col)))
    staged = staged.withColumn(out, drop_country_suffix(F.col(out), countries))
    return staged.withColumn(out, expand_and_strip(ascii_fold(F.col(out)), armed_forces=True))


def match_key(c: Column) -> Column:
    """Lower-case alphanumeric key of a generated string's alias."""
    return F.regexp_replace(F.lower(ascii_fold(ampersand(c))), "[^a-z0-9]", "")


def comma_parts(c: Column) -> Column:
    return F.size(F.split(c, ","))


def has_word(c: Column, words: Iterable[str]) -> Column:
    """One of the words (or phrases) stands between word boundaries."""
    return c.rlike(r"(?U)\b(?:%s)\b" % "|".join(map(re.escape, words)))


def id_from_url(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def one_line(c: Column) -> Column:
    """A text without line breaks, so that one line stays one record."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


# --------------------------------------------------------------------------
# Country search
# --------------------------------------------------------------------------
MAX_COUNTRY_PATTERNS = 20_000


def country_patterns(table: DataFrame) -> dict[str, list[str]]:
    """Read the ``country, pattern`` configuration table.

    Patterns become part of one regular expression, so they are needed as
    literals. The read stops with an error beyond ``MAX_COUNTRY_PATTERNS``.
    """
    rows = table.select("country", "pattern").distinct().limit(MAX_COUNTRY_PATTERNS + 1).collect()
    if len(rows) > MAX_COUNTRY_PATTERNS:
        raise ValueError(f"more than {MAX_COUNTRY_PATTERNS} country patterns")
    found: dict[str, list[str]] = {}
    for country, pattern in sorted(rows):
        found.setdefault(country, []).append(pattern)
    return found


def _prefix_free_levels(patterns: Iterable[str]) -> list[list[str]]:
    """Split patterns so that within a level none is a prefix of another."""
    levels: list[list[str]] = []
    for pattern in sorted(set(patterns), key=len):
        for level in levels:
            if not any(pattern.startswith(p) for p in level):
                level.append(pattern)
                break
        else:
            levels.append([pattern])
    return levels


def _found_patterns(text: Column, patterns: Iterable[str]) -> Column:
    """Every literal pattern that occurs between word boundaries.

    A look-ahead consumes nothing, so overlapping patterns are all seen; one
    pass per level handles patterns that start at the same place.
    """
    hits = [
        F.regexp_extract_all(text, F.lit(r"(?U)\b(?=(%s)\b)" % "|".join(map(re.escape, level))), F.lit(1))
        for level in _prefix_free_levels(patterns)
    ]
    return F.concat(*hits) if hits else F.array().cast("array<string>")


def countries_in_text(text: Column, patterns: Mapping[str, list[str]], regex: bool = False) -> Column:
    """Sorted countries with a pattern in the text or in its dot-free form.

    ``regex=True`` takes patterns as regular expressions, one test per country.
    """
    forms = [text, F.replace(text, F.lit("."), F.lit(""))]
    if regex:
        tests = []
        for country, terms in sorted(patterns.items()):
            if terms:
                rx = r"(?U)\b(?:%s)\b" % "|".join(terms)
                tests.append(F.when(forms[0].rlike(rx) | forms[1].rlike(rx), F.lit(country)))
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    owners: dict[str, list[str]] = {}
    for country, terms in sorted(patterns.items()):
        for term in terms:
            if term:
                owners.setdefault(term, []).append(country)
    if not owners:
        return F.array().cast("array<string>")
    lookup = F.create_map(*[
        part for term, who in owners.items()
        for part in (F.lit(term), F.array(*[F.lit(w) for w in who]))
    ])
    dotless = F.when(text.contains("."), _found_patterns(forms[1], owners)).otherwise(F.array().cast("array<string>"))
    hits = F.array_distinct(F.concat(_found_patterns(text, owners), dotless))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.element_at(lookup, p)))))


# --------------------------------------------------------------------------
# Tokens
# --------------------------------------------------------------------------
def word_tokens(c: Column) -> Column:
    """Lower-case folded words and punctuation runs, in order."""
    return F.regexp_extract_all(F.lower(ascii_fold(c)), F.lit(r"\w+|[^\w\s]+"), F.lit(0))


def index_words(c: Column) -> Column:
    """Distinct lower-case alphanumeric words of a text."""
    words = F.split(F.lower(ascii_fold(c)), "[^0-9a-z]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def index_ngrams(c: Column, n: int = 4) -> Column:
    """Distinct character n-grams of the lower-case alphanumeric text.

    Words are joined by one blank and padded, so grams see word edges.
    """
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(ascii_fold(c)), "[^0-9a-z]+", " "), F.lit(" "))
    return F.array_distinct(char_windows(flat, n))


def char_windows(c: Column, n: int) -> Column:
    """Every run of ``n`` characters. The look-ahead walks the text once."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))


def pad_truncate(tokens: Column, length: int = 128, pad: int = 0) -> Column:
    """First ``length`` ids, filled up with ``pad`` on the right."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)
