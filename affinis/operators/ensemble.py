"""From candidates of two scorers to final predictions.

All steps work on one table with a row per text and candidate institution (at
most 20 per scorer). It is partitioned by text once; every step after that is a
window over the text or a plain expression, so no further shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis import fixed_values as fixed
from affinis.functions.text import clean_match_text
from affinis.operators.gate import any_of
from affinis.operators.matching import contained_name, inside_any, inside_longer
from affinis.operators.skew import bounded_lookup, fits_in_tasks, salted_lookup



def by_text():
    return Window.partitionBy("text_id")


INSTITUTION_COLUMNS = [
    "inst_id", "display_name", "city", "country", "final_names", "is_common", "clean_display", "clean_city",
]


def institution_context(institutions: DataFrame, common_ids: DataFrame, countries=()) -> DataFrame:
    """Institution attributes the rules need, cleaned once per institution."""
    countries = list(countries)
    common = common_ids.select("inst_id").distinct().withColumn("is_common", F.lit(True))
    return institutions.join(common, "inst_id", "left").select(
        "inst_id", "display_name", "city", "country", "final_names",
        F.coalesce("is_common", F.lit(False)).alias("is_common"),
        clean_match_text(F.col("display_name"), countries).alias("clean_display"),
        clean_match_text(F.col("city"), countries).alias("clean_city"),
    )


def candidate_table(scores: DataFrame) -> DataFrame:
    """One row per text and institution with rank and score of either scorer; ``-1`` is dropped."""
    def of(model: str, col: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(col))).alias(f"{model}_{col}")
    return (
        scores.filter(F.col("inst_id") != -1).groupBy("text_id", "inst_id")
        .agg(*[of(m, c) for m in ("basic", "lang") for c in ("rank", "score")])
    )


def candidate_context(scores: DataFrame, texts: DataFrame, institutions: DataFrame) -> DataFrame:
    """Candidates with text and institution columns, ready for the rules."""
    described = texts.select("text_id", "raw", "clean", "clean_stripped", "countries")
    context = institutions.select(*INSTITUTION_COLUMNS)
    if fits_in_tasks(context):  # rows are dealt and sorted by text while they are narrow
        return candidate_table(scores).join(described, "text_id").join(F.broadcast(context), "inst_id", "left")
    return salted_lookup(candidate_table(scores), context, "inst_id", spread=["text_id"]).join(described, "text_id")


def _has_country() -> Column:
    return F.coalesce(F.col("country") != "", F.lit(False))


def country_found() -> Column:
    """The institution's country is among the countries of the text."""
    return F.coalesce(F.array_contains("countries", F.col("country")), F.lit(False))


def country_rerank(candidates: DataFrame, model: str) -> DataFrame:
    """Add the scorer's pick as ``{model}_pick`` struct ``(rank, inst_id, score)``.

    The best candidate, unless it has a country and the text names countries:
    then the best candidate whose country the text names, if there is one.
    """
    rank = F.col(f"{model}_rank")
    seen = rank.isNotNull()
    row = [rank.alias("rank"), F.col("inst_id"), F.col(f"{model}_score").alias("score")]
    best = F.min(F.when(seen, F.struct(*row, _has_country().alias("has_country")))).over(by_text())
    fitting = F.min(F.when(seen & country_found(), F.struct(*row))).over(by_text())
    out = candidates.withColumn("_best", best).withColumn("_fitting", fitting)
    plain = F.when(F.col("_best").isNotNull(), F.struct("_best.rank", "_best.inst_id", "_best.score"))
    use_fit = F.col("_best.has_country") & (F.size("countries") > 0) & F.col("_fitting").isNotNull()
    return out.withColumn(f"{model}_pick", F.when(use_fit, F.col("_fitting")).otherwise(plain)).drop("_best", "_fitting")


def combine_scorers(basic: Column, lang: Column, countries: Column, raw: Column,
                    lang_thresh: float = fixed.THRESHOLD, basic_thresh: float = fixed.THRESHOLD) -> Column:
    """The ensemble's pick as struct ``(inst_id, score, category)``; ``-1, 0.0, nothing`` if neither is sure."""
    def pick(of: Column, category: str) -> Column:
        return F.struct(of["inst_id"].cast("bigint").alias("inst_id"), of["score"].cast("double").alias("score"),
                        F.lit(category).alias("category"))
    second = (
        (basic["score"] > fixed.SECOND_THRESHOLD)
        & F.array_contains(countries, fixed.SECOND_COUNTRY)
        & raw.contains(fixed.SECOND_PHRASE)
    )
    none = F.struct(F.lit(-1).cast("bigint").alias("inst_id"), F.lit(0.0).alias("score"), F.lit("nothing").alias("category"))
    return (
        F.when(basic["inst_id"] == lang["inst_id"], pick(lang, "model_match"))
        .when(basic["score"] > basic_thresh, pick(basic, "basic_thresh"))
        .when(lang["score"] > lang_thresh, pick(lang, "lang_thresh"))
        .when(second, pick(basic, "basic_thresh_second"))
        .otherwise(none)
    )


def pick_candidates(candidates: DataFrame, lang_thresh: float = fixed.THRESHOLD,
                    basic_thresh: float = fixed.THRESHOLD) -> DataFrame:
    """Add ``pick``, the same for all rows of a text."""
    ranked = country_rerank(country_rerank(candidates, "basic"), "lang")
    pick = combine_scorers(F.col("basic_pick"), F.col("lang_pick"), F.col("countries"), F.col("raw"),
                           lang_thresh, basic_thresh)
    return ranked.withColumn("pick", pick).drop("basic_pick", "lang_pick")


def match_names(picked: DataFrame) -> DataFrame:
    """Add ``name``: the first name of a candidate found in the text, if its country allows the match."""
    allowed = (
        ~_has_country()
        | ((F.size("countries") == 0) & ~F.col("is_common"))
        | country_found()
    )
    found = contained_name(F.col("clean"), F.col("final_names"))
    return picked.withColumn("name", F.when((F.col("inst_id") != F.col("pick.inst_id")) & allowed, found))


def suppress_substrings(matched: DataFrame) -> DataFrame:
    """Clear ``name`` where it is inside a longer match or inside a name of the pick."""
    is_pick = F.col("inst_id") == F.col("pick.inst_id")
    seen = matched.withColumn("_names", F.collect_set("name").over(by_text())).withColumn(
        "_pick_names", F.first(F.when(is_pick, F.col("final_names")), ignorenulls=True).over(by_text())
    )
    covered = inside_longer(F.col("name"), F.col("_names")) | inside_any(F.col("name"), F.col("_pick_names"))
    kept = F.when(F.col("name").isNotNull() & ~covered, F.col("name"))
    return seen.withColumn("name", kept).drop("_names", "_pick_names")


def merge_predictions(matched: DataFrame) -> DataFrame:
    """Keep the pick (``pos`` 0) and the surviving matches (``pos`` 1) with score and category."""
    is_pick = F.col("inst_id") == F.col("pick.inst_id")
    return (
        matched.filter(is_pick | F.col("name").isNotNull())
        .withColumn("pos", F.when(is_pick, 0).otherwise(1))
        .withColumn("score", F.when(is_pick, F.col("pick.score")).otherwise(F.lit(fixed.STRING_MATCH_SCORE)))
        .withColumn("category", F.when(is_pick, F.col("pick.category")).otherwise("string_match"))
    )


def resolve_same_name(predictions: DataFrame) -> DataFrame:
    """Of several predictions with one display name keep those whose city is in the text, else the first."""
    city_hit = F.coalesce(F.col("clean").contains(F.col("clean_city")), F.lit(False))
    # a list per text, as a window by name would sort the rows with their texts once more
    seen = F.collect_list(F.struct("display_name", "_city", "pos", "inst_id")).over(by_text())
    marked = predictions.withColumn("_city", city_hit).withColumn("_seen", seen)
    same = F.filter("_seen", lambda x: x["display_name"].eqNullSafe(F.col("display_name")))
    first = F.array_min(F.transform(same, lambda x: F.struct(x["pos"].alias("pos"), x["inst_id"].alias("inst_id"))))
    is_first = (F.col("pos") == first["pos"]) & (F.col("inst_id") == first["inst_id"])
    # a single prediction of a name is always kept
    keep = (F.size(same) == 1) | F.when(F.exists(same, lambda x: x["_city"]), F.col("_city")).otherwise(is_first)
    return marked.filter(keep).drop("_city", "_seen")


def city_country_check() -> Column:
    """Country found in the text and city written in it."""
    return country_found() & F.coalesce(F.col("raw").contains(F.col("city")), F.lit(False))


def _starts(*words: str) -> Column:
    return F.coalesce(any_of(F.col("display_name").startswith(w) for w in words), F.lit(False))


def _name_in_text() -> Column:
    return F.coalesce(F.col("clean_stripped").contains(F.col("clean_display")), F.lit(False))


def department_check() -> Column:
    """True where a department-like institution is to be removed."""
    return _starts("Department of", "Department for") & ~(_name_in_text() & city_country_check())


def common_name_check() -> Column:
    """True where an institution with a shared name is to be removed.

    Counts refer to the rows of the text, so this runs before removals.
    """
    alone = F.count(F.lit(1)).over(by_text()) == 1
    others = F.max(~F.col("is_common")).over(by_text())
    department = _starts("Department of")
    academic = F.col("raw").contains("College") | F.col("raw").contains("University")
    exact = F.coalesce(F.col("clean_display") == F.col("clean_stripped"), F.lit(False))
    when_alone = exact | (department & (academic | ~_name_in_text()))
    when_mixed = F.when(department, academic | ~_name_in_text() | ~city_country_check()).otherwise(~country_found())
    return F.col("is_common") & F.when(alone, when_alone).when(others, when_mixed).otherwise(False)


def flag_removals(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("remove", department_check() | common_name_check())


def prediction_list(flagged: DataFrame, merged: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """``text_id, predictions`` of the rows that stay, merged ids replaced, pick first."""
    rows = flagged.filter(~F.col("remove")).select("text_id", "pos", "inst_id", "score", "category")
    if merged is not None:
        new = merged.select(F.col("old_id").alias("inst_id"), "new_id")
        rows = bounded_lookup(rows, new, "inst_id", spread=["text_id"])
    else:
        rows = rows.withColumn("new_id", F.lit(None).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct(
        "pos", "inst_id", F.coalesce("new_id", "inst_id").alias("out_id"), "score", "category"
    )))
    grouped = rows.groupBy("text_id").agg(ordered.alias("p"))
    lists = grouped.select("text_id", F.transform("p", lambda x: F.struct(
        x["out_id"].alias("inst_id"), x["score"].alias("score"), x["category"].alias("category")
    )).alias("predictions"))
    if not distinct:
        return lists
    first_of_id = F.filter("predictions", lambda x, i: F.array_position(
        F.transform("predictions", lambda y: y["inst_id"]), x["inst_id"]) == i + 1)
    return lists.withColumn("predictions", first_of_id)


def no_prediction() -> Column:
    return F.array(F.struct(F.lit(-1).cast("bigint").alias("inst_id"), F.lit(0.0).alias("score"),
                            F.lit("nothing").alias("category")))


def finalize_predictions(texts: DataFrame, flagged: DataFrame, merged: DataFrame | None = None,
                         distinct: bool = False) -> DataFrame:
    """Prediction list of every text, ``-1, 0.0, nothing`` where no row stays."""
    lists = prediction_list(flagged, merged, distinct)
    return texts.select("text_id").join(lists, "text_id", "left").withColumn(
        "predictions", F.coalesce("predictions", no_prediction())
    )


def predict(candidates: DataFrame, lang_thresh: float = fixed.THRESHOLD,
            basic_thresh: float = fixed.THRESHOLD) -> DataFrame:
    """All rules in order on a ``candidate_context`` table."""
    picked = pick_candidates(candidates, lang_thresh, basic_thresh)
    merged = merge_predictions(suppress_substrings(match_names(picked)))
    return flag_removals(resolve_same_name(merged))
