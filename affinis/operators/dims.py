"""Lookup tables from the institution registry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis import fixed_values as fixed
from affinis.functions.text import clean_match_text, id_from_url

MIN_NAME_LENGTH = 4  # names must be longer than this to be matched


# ------------------------------------------------------- registry columns --
def admin_region(address: Column, none_as_text: bool = False) -> Column:
    """First-level region of an address; null (or the word ``None``) when any level is missing."""
    name = address["geonames_city"]["geonames_admin1"]["name"]
    return F.coalesce(name, F.lit("None")) if none_as_text else name


def final_region(state: Column, region: Column) -> Column:
    return F.coalesce(state, region)


def nested_size(c: Column) -> Column:
    """Length of a list, 0 for a missing one."""
    return F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))


def first_type(types: Column) -> Column:
    return F.coalesce(F.try_element_at(types, F.lit(1)), F.lit(""))


def flatten_registry(registry: DataFrame, none_as_text: bool = False) -> DataFrame:
    """One flat row per registry record, place fields from its first address."""
    address = F.try_element_at("addresses", F.lit(1))
    region = admin_region(address, none_as_text)
    return registry.select(
        id_from_url(F.col("id")).alias("registry_id"),
        "name", "status",
        first_type(F.col("types")).alias("type"),
        "aliases", "acronyms", "labels", "relationships",
        address["city"].alias("city"),
        address["state"].alias("state"),
        region.alias("region"),
        final_region(address["state"], region).alias("final_state"),
        F.col("country.country_code").alias("country_code"),
        F.col("country.country_name").alias("country"),
        *[nested_size(F.col(c)).alias(f"{c}_len") for c in ("aliases", "acronyms", "labels", "addresses")],
    )


def explode_labels(registry: DataFrame, key: str) -> DataFrame:
    """One row per label with its language; records without labels vanish."""
    rows = registry.select(key, F.explode("labels").alias("l")).filter(F.col("l").isNotNull())
    return rows.select(key, F.col("l.label").alias("label"), F.col("l.iso639").alias("iso639"))


# ------------------------------------------------------------------ names --
def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def name_aliases(name: Column, aliases: Column, labels: Column) -> Column:
    """Name, aliases, and labels in languages that are not skipped."""
    kept = F.filter(labels, lambda x: ~F.coalesce(x["iso639"].isin(*fixed.SKIPPED_LABEL_LANGUAGES), F.lit(False)))
    return F.concat(F.array(name), _list(aliases), _list(F.transform(kept, lambda x: x["label"])))


def backwards_university(names: Column) -> Column:
    """Add ``X University`` for each ``University of X`` and the other way round."""
    def turned(n: Column) -> Column:
        return (
            F.when(n.rlike(r"^University of [^ ]*$"), F.regexp_replace(n, r"^University of ([^ ]*)$", "$1 University"))
            .when(n.rlike(r"^[^ ]* University$"), F.regexp_replace(n, r"^([^ ]*) University$", "University of $1"))
        )
    return F.concat(names, F.array_compact(F.transform(names, turned)))


def extra_known_names(names: Column) -> Column:
    out = None
    for known, extra in fixed.KNOWN_EXTRA_NAMES:
        hit, longer = F.array_contains(names, known), F.concat(names, F.array(F.lit(extra)))
        out = F.when(hit, longer) if out is None else out.when(hit, longer)
    return out.otherwise(names)


def _long_enough(names: Column) -> Column:
    return F.filter(names, lambda n: F.length(n) > MIN_NAME_LENGTH)


def exact_names(name: Column, aliases: Column, acronyms: Column, labels: Column,
                countries: Iterable[str] = (), skip_departments: bool = False) -> Column:
    """All cleaned names of an institution. ``labels`` is a list of label texts."""
    countries = list(countries)
    names = extra_known_names(F.concat(F.array(name), _list(aliases), _list(acronyms), _list(labels)))
    if skip_departments:
        names = F.filter(names, lambda n: ~n.startswith("Department of"))
    return _long_enough(F.transform(names, lambda n: clean_match_text(n, countries, armed_forces=False)))


def final_names(display_name: Column, exact: Column, extra: Column | None = None,
                countries: Iterable[str] = ()) -> Column:
    """Names used for matching: distinct, not banned, longest first."""
    own = F.array_compact(F.array(clean_match_text(display_name, countries, armed_forces=False)))
    names = F.concat(own, _list(exact), *([_list(extra)] if extra is not None else []))
    kept = F.array_except(_long_enough(F.array_distinct(names)), F.array(*[F.lit(b) for b in fixed.BANNED_NAMES]))
    by_length = F.array_sort(F.transform(kept, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.transform(by_length, lambda x: x["n"])


# ----------------------------------------------------------------- tables --
def successors_parents(registry: DataFrame) -> DataFrame:
    """Successor and parent ids of closed institutions with exactly one successor."""
    def related(kind: str) -> Column:
        hits = F.filter("relationships", lambda r: r["type"] == kind)
        return _list(F.transform(hits, lambda r: id_from_url(r["id"])))
    closed = registry.filter(F.col("status").isin(*fixed.CLOSED_STATES))
    found = closed.withColumn("successors", related("Successor")).withColumn("parents", related("Parent"))
    return found.filter(F.size("successors") == 1).withColumn("successor", F.col("successors")[0])


def institution_dim(flat: DataFrame, institutions: DataFrame, countries: Iterable[str] = ()) -> DataFrame:
    """The institution dictionary as a table: ``flat`` joined to ids, with cleaned names."""
    countries = list(countries)
    joined = flat.join(institutions, "registry_id", "inner")
    exact = exact_names(F.col("name"), F.col("aliases"), F.col("acronyms"),
                        F.transform("labels", lambda x: x["label"]), countries)
    return joined.select(
        F.col("affiliation_id").alias("inst_id"), "display_name", "city",
        F.col("final_state").alias("state"), "country",
        final_names(F.col("display_name"), exact, countries=countries).alias("final_names"),
        "registry_id", "type",
    )


def place_list(places: DataFrame, countries: Iterable[str] = (), first_only: bool = False) -> DataFrame:
    """Cleaned combinations of ``city``, ``state``, ``country``.

    ``first_only`` takes one row per city and country for the formats.
    """
    rows = places.select("city", "state", "country").distinct()
    if first_only:
        rows = rows.groupBy("city", "country").agg(F.min("state").alias("state"))
    state = F.when(F.col("state") != "", F.col("state"))
    formats = F.array(
        F.concat("city", "country"), F.concat("city", state, "country"), F.concat(state, "country"),
        F.col("country"), state,
    )
    text = rows.select(F.explode(formats).alias("t")).filter(F.col("t").isNotNull()).distinct()
    return text.select(clean_match_text(F.col("t"), countries, armed_forces=False).alias("clean_place")).distinct()


def country_terms(countries: DataFrame, map_col: str) -> DataFrame:
    """All patterns of a ``country -> patterns`` map column, distinct."""
    lists = countries.select(F.explode(F.map_values(map_col)).alias("p"))
    return lists.select(F.explode("p").alias("term")).distinct()


def department_terms(listed: DataFrame, col: str = "term") -> DataFrame:
    """Built-in department names together with a list."""
    builtin = listed.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in fixed.DEPARTMENTS])).alias("term")
    )
    return listed.select(F.col(col).alias("term")).union(builtin).distinct()
