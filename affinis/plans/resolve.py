"""Whole inference: strings in, predictions for every string out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis import fixed_values as fixed
from affinis.functions.text import ascii_fold, comma_parts, countries_in_text, strip, with_clean_text
from affinis.operators import ensemble
from affinis.operators.gate import initial_gate
from affinis.operators.language import detect_language, script_language
from affinis.operators.relational import as_text
from affinis.operators.scoring import fit_score_index, score_texts
from affinis.operators.skew import skew_join
from affinis.session import materialize

Scorer = Callable[[DataFrame], DataFrame]


def distinct_texts(mentions: DataFrame, drop_short: bool = False) -> DataFrame:
    """Each string once, with its smallest mention id as ``text_id``.

    Copies are combined map-side, so a string with very many copies is cheap.
    """
    raw = as_text(F.col("affiliation_string")) if drop_short else F.col("affiliation_string").cast("string")
    rows = mentions.select("mention_id", raw.alias("raw")).filter(F.col("raw").isNotNull())
    texts = rows.groupBy("raw").agg(F.min("mention_id").alias("text_id"))
    return texts.filter(F.length("raw") > 2)


def describe_texts(texts: DataFrame, patterns: Mapping[str, list[str]], profiles: DataFrame | None = None,
                   country_regex: bool = False) -> DataFrame:
    """Add language, countries, number of comma parts and cleaned forms.

    ``country_regex`` takes the patterns as regular expressions.
    """
    flat = sorted({p for terms in patterns.values() for p in terms})
    out = with_clean_text(texts, "raw", "clean", flat)
    # most texts have no white space around them: those are not cleaned twice
    out = out.withColumn("_stripped", strip(F.col("raw"))).withColumn("_stripped", F.when(F.col("_stripped") != F.col("raw"), F.col("_stripped")))
    out = with_clean_text(out, "_stripped", "clean_stripped", flat).withColumn("clean_stripped", F.coalesce("clean_stripped", "clean"))
    out = out.drop("_stripped").withColumn("n_parts", comma_parts(F.col("raw")))
    out = out.withColumn("countries", countries_in_text(F.col("raw"), patterns, country_regex))
    if profiles is None:
        return out.withColumn("lang", F.coalesce(script_language(F.col("raw")), F.lit("en")))
    return out.join(detect_language(texts, "text_id", "raw", profiles), "text_id")


def gated_texts(mentions: DataFrame, patterns: Mapping[str, list[str]], departments: DataFrame, places: DataFrame,
                profiles: DataFrame | None = None, drop_short: bool = False, country_regex: bool = False) -> DataFrame:
    texts = describe_texts(distinct_texts(mentions, drop_short), patterns, profiles, country_regex)
    return initial_gate(texts, departments, places)


def index_scorer(indexes: Mapping[str, DataFrame]) -> Scorer:
    """Both built-in scorers over fitted term indexes."""
    def score(texts: DataFrame) -> DataFrame:
        basic, lang = (score_texts(texts, indexes[m], m) for m in ("basic", "lang"))
        return basic.unionByName(lang)
    return score


def fit_indexes(training: DataFrame, id_col: str = "inst_id", text_col: str = "text") -> dict[str, DataFrame]:
    return {m: fit_score_index(training, m, id_col, text_col) for m in ("basic", "lang")}


def resolve_affiliations(
    mentions: DataFrame,
    institutions: DataFrame,
    common_ids: DataFrame,
    scorer: Scorer,
    patterns: Mapping[str, list[str]],
    departments: DataFrame,
    places: DataFrame,
    merged: DataFrame | None = None,
    profiles: DataFrame | None = None,
    lang_thresh: float = fixed.THRESHOLD,
    basic_thresh: float = fixed.THRESHOLD,
    drop_short: bool = False,
    country_regex: bool = False,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """``mention_id, affiliation_string, predictions`` for every mention.

    Work is done per distinct string. Two results with several readers are
    written once to the shared folder: the gated strings and their scores.
    ``drop_short`` removes strings of up to two characters from the output and
    reads a missing string as the word ``None``; by default both stay with ``-1``.
    """
    texts = stage(gated_texts(mentions, patterns, departments, places, profiles, drop_short, country_regex), "texts")
    passed = texts.filter("gate")
    scores = stage(scorer(passed.select("text_id", ascii_fold(F.col("raw")).alias("text"))), "scores")
    flat = sorted({p for terms in patterns.values() for p in terms})
    context = ensemble.institution_context(institutions, common_ids, flat)
    candidates = ensemble.candidate_context(scores, passed, context)
    lists = ensemble.prediction_list(ensemble.predict(candidates, lang_thresh, basic_thresh), merged)
    by_text = texts.select("text_id", "raw").join(lists, "text_id").select("raw", "predictions")
    if drop_short:
        rows = mentions.withColumn("raw", as_text(F.col("affiliation_string"))).filter(F.length("raw") > 2)
    else:
        rows = mentions.withColumn("raw", F.col("affiliation_string").cast("string"))
    out = skew_join(rows, by_text, ["raw"], "left", spread=["mention_id"])
    return out.select(
        "mention_id", "affiliation_string",
        F.coalesce("predictions", ensemble.no_prediction()).alias("predictions"),
    )
