"""Ensemble rules on hand-made candidates; expected values follow the rules' definition."""

import pytest
from pyspark.sql import functions as F

from affinis.operators import ensemble, evaluate
from affinis.operators.gate import initial_gate
from affinis.plans import resolve

# inst_id, display_name, city, country, final_names
INSTITUTIONS = [
    (1, "University A", "Paris", "France", ["UniversityA"]),
    (2, "University B", "Lyon", "France", ["UniversityB"]),
    (3, "Hospital A", "Paris", "France", ["HospitalofUniversityA", "HospitalA"]),
    (4, "Institute X", "Rome", "Italy", ["InstituteX"]),
    (5, "Institute X", "Milan", "Italy", ["InstituteX"]),
    (6, "Department of Y", "Rome", "Italy", ["DepartmentofY"]),
    (7, "Stateless Org", "Bern", None, ["StatelessOrg"]),
    (8, "Land Survey", "Wuhan", "China", ["LandSurvey"]),
]
COMMON = [4, 5, 6]


def run_all(spark, cases, **kw):
    """Predictions of all cases in one job; a case is ``(raw, countries, basic, lang)``."""
    inst = spark.createDataFrame(
        INSTITUTIONS, "inst_id bigint, display_name string, city string, country string, final_names array<string>")
    context = ensemble.institution_context(inst, spark.createDataFrame([(c,) for c in COMMON], "inst_id bigint"))
    rows = [(i, raw, countries) for i, (raw, countries, _, _) in enumerate(cases)]
    texts = spark.createDataFrame(rows, "text_id bigint, raw string, found array<string>")
    texts = resolve.describe_texts(texts, {}).withColumn("countries", F.col("found"))
    scores = [
        (i, model, rank + 1, inst_id, score)
        for i, (_, _, basic, lang) in enumerate(cases)
        for model, ranked in (("basic", basic), ("lang", lang))
        for rank, (inst_id, score) in enumerate(ranked)
    ]
    score = spark.createDataFrame(scores, "text_id bigint, model string, rank int, inst_id bigint, score double")
    flagged = ensemble.predict(ensemble.candidate_context(score, texts, context))
    out = ensemble.finalize_predictions(texts, flagged, **kw).collect()
    return [[(p.inst_id, p.score, p.category) for p in r.predictions] for r in sorted(out)]


NOTHING = [(-1, 0.0, "nothing")]


CASES = [
    ("zz", [], [(1, 0.5)], [(1, 0.4)], [(1, 0.4, "model_match")]),
    ("zz", [], [(1, 0.995)], [(2, 0.999)], [(1, 0.995, "basic_thresh")]),
    ("zz", [], [(1, 0.99)], [(2, 0.999)], [(2, 0.999, "lang_thresh")]),
    ("zz", [], [(1, 0.5)], [(2, 0.5)], NOTHING),
    ("Natural Resource", ["China"], [(8, 0.02)], [(2, 0.5)], [(8, 0.02, "basic_thresh_second")]),
    ("zz", [], [(-1, 0.999), (1, 0.6)], [(1, 0.5)], [(1, 0.5, "model_match")]),
    ("zz", ["Italy"], [(1, 0.995), (4, 0.1)], [(2, 0.5), (4, 0.3)], [(4, 0.3, "model_match")]),
    ("zz", ["Italy"], [(7, 0.995), (4, 0.1)], [(2, 0.5)], [(7, 0.995, "basic_thresh")]),
    # a match by name next to the pick, and instead of no pick
    ("University B, Lyon", ["France"], [(1, 0.995), (2, 0.1)], [(1, 0.9)], [(1, 0.9, "model_match"), (2, 0.95, "string_match")]),
    ("University B", [], [(1, 0.5), (2, 0.1)], [(7, 0.4)], [(2, 0.95, "string_match")]),
    ("University B", ["Italy"], [(1, 0.5), (2, 0.1)], [(7, 0.4)], NOTHING),
    ("Stateless Org", ["Italy"], [(1, 0.5), (7, 0.1)], [(2, 0.4)], [(7, 0.95, "string_match")]),
    ("Institute X", [], [(1, 0.5), (4, 0.1)], [(2, 0.4)], NOTHING),
    # shorter names inside longer ones
    ("Hospital of University A", ["France"], [(3, 0.5), (1, 0.4)], [(2, 0.4)], [(3, 0.95, "string_match")]),
    ("Hospital of University A", ["France"], [(3, 0.5), (1, 0.4)], [(3, 0.4)], [(3, 0.4, "model_match")]),
    # same display name: city decides, else the first stays
    ("Institute X, Milan, Italy", ["Italy"], [(1, 0.5), (4, 0.4), (5, 0.3)], [(2, 0.4)], [(5, 0.95, "string_match")]),
    ("Institute X, Italy", ["Italy"], [(1, 0.5), (5, 0.4), (4, 0.3)], [(2, 0.4)], [(4, 0.95, "string_match")]),
    # a match whose name the pick bears as well is not added
    ("Institute X, Milan, Italy", ["Italy"], [(4, 0.5), (5, 0.4)], [(4, 0.4)], [(4, 0.4, "model_match")]),
    # common names
    ("Institute X", [], [(4, 0.5)], [(4, 0.4)], NOTHING),
    ("Department of Y, Rome", ["Italy"], [(6, 0.5)], [(6, 0.4)], [(6, 0.4, "model_match")]),
    ("Department of Y, Rome, University", ["Italy"], [(6, 0.5)], [(6, 0.4)], NOTHING),
    ("Department of Y, Oslo", ["Italy"], [(6, 0.5)], [(6, 0.4)], NOTHING),
    ("Institute X, University B, Lyon", ["France", "Italy"], [(4, 0.5), (2, 0.4)], [(4, 0.4)],
     [(4, 0.4, "model_match"), (2, 0.95, "string_match")]),
    ("Institute X, Stateless Org", ["Spain"], [(4, 0.5), (7, 0.4)], [(4, 0.4)], [(7, 0.95, "string_match")]),
    # one scorer without candidates
    ("zz", [], [(1, 0.995)], [(-1, 1.0)], [(1, 0.995, "basic_thresh")]),
    ("zz", [], [(-1, 1.0)], [(-1, 1.0)], NOTHING),
]


def test_rules(spark):
    got = run_all(spark, [case[:4] for case in CASES])
    assert [(c[0], c[1], g) for c, g in zip(CASES, got)] == [(c[0], c[1], c[4]) for c in CASES]


def test_merged_ids(spark):
    merged = spark.createDataFrame([(1, 2)], "old_id bigint, new_id bigint")
    cases = [("University B, Lyon", ["France"], [(1, 0.995), (2, 0.1)], [(1, 0.9)])]
    assert [p[0] for p in run_all(spark, cases, merged=merged)[0]] == [2, 2]
    assert [p[0] for p in run_all(spark, cases, merged=merged, distinct=True)[0]] == [2]


def test_gate(spark):
    patterns = {"France": ["France"]}
    cases = {
        "University A, Paris": True, "北京大学 Beijing": True, "北京大学": False, "%9": False, "----": False, "Dept of Physics": False,
        "Dept of Physics, Paris": True, "Dept of Physics France": True, "Nursing & Midwifery": False, "Paris, France": False,
        "LIU Wei, ZHANG Li": False, "LIU Wei, University A": True, "Smith et al": False, "Smith et al.": True,
        "Smith et al  ": False, "LIUX": True, "Ministry of X": False, "    ": False, "398276": True,
    }
    mentions = spark.createDataFrame(list(enumerate(cases)), "mention_id bigint, affiliation_string string")
    departments = spark.createDataFrame([("Nursing & Midwifery",)], "term string")
    places = spark.createDataFrame([("ParisFrance",)], "clean_place string")
    texts = resolve.describe_texts(resolve.distinct_texts(mentions), patterns)
    got = {r.raw: r.gate for r in initial_gate(texts, departments, places).collect()}
    assert got == {k: v for k, v in cases.items() if len(k) > 2}


def test_whole_resolution_keeps_every_row(spark):
    rows = [(1, "University A, Paris, France"), (2, None), (3, "-1"), (4, "University A, Paris, France"), (5, "    ")]
    mentions = spark.createDataFrame(rows, "mention_id bigint, affiliation_string string")
    inst = spark.createDataFrame(INSTITUTIONS, "inst_id bigint, display_name string, city string, country string, final_names array<string>")
    training = inst.select("inst_id", F.concat_ws(", ", "display_name", "city", "country").alias("text"))
    none = spark.createDataFrame([], "term string")
    args = (inst, spark.createDataFrame([(c,) for c in COMMON], "inst_id bigint"),
            resolve.index_scorer(resolve.fit_indexes(training)), {"France": ["France"], "Italy": ["Italy"]},
            none, none.withColumnRenamed("term", "clean_place"))
    got = {r.mention_id: [(p.inst_id, p.category) for p in r.predictions]
           for r in resolve.resolve_affiliations(mentions, *args).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1] == got[4] == [(1, "model_match")]
    assert got[2] == got[3] == got[5] == [(-1, "nothing")]
    short = resolve.resolve_affiliations(mentions, *args, drop_short=True)
    assert sorted(r.mention_id for r in short.collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("labels, preds, expected", [
    ([-1], [-1], (0, 0, 1, 0)), ([-1], [1, 2], (0, 2, 0, 0)), ([1, 2], [-1], (0, 0, 0, 2)),
    ([1, 2], [2, 2, 3], (2, 1, 0, 1)), ([1], [1], (1, 0, 0, 0)),
])
def test_confusion(spark, labels, preds, expected):
    df = spark.createDataFrame([(labels, preds)], "l array<bigint>, p array<bigint>")
    assert tuple(df.select(evaluate.confusion_counts(F.col("l"), F.col("p")).alias("c")).collect()[0].c) == expected


def test_precision_without_predictions(spark):
    df = spark.createDataFrame([(0, 0, 1)], "tp bigint, fp bigint, fn bigint")
    assert tuple(evaluate.precision_recall(df).collect()[0]) == (None, 0.0)
