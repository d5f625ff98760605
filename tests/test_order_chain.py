"""The order texts' chain of rules: what it stores and how often rows move."""

import pytest

from affinis.operators import ensemble, evaluate, skew
from affinis.plans import catalog_resolve, resolve
from affinis.plans.bindings import Tables


@pytest.fixture
def tables(spark, tmp_path):
    """Three regions, nations and suppliers of each, and forty orders, some lines twice, some keys null."""
    rows = {
        "region": ("r_regionkey long, r_name string", [(i, f"REGION{i}") for i in range(3)]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(i, f"NATION_{i}", i % 3) for i in range(9)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double", [(i, f"Supplier#{i:03d}", i % 9, 1.0) for i in range(60)]),
        "lineitem": ("l_orderkey long, l_suppkey long", [(o, (o * k * 7) % 60) for o in range(40) for k in range(1, 13)] * 2 + [(None, 3), (4, None)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def test_scores_move_the_lines_once(tables, capsys):
    scores = catalog_resolve.order_scores(tables)
    scores.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") == 1, plan
    pairs = {(o, s) for o in range(40) for k in range(1, 13) for s in [(o * k * 7) % 60]}
    offered = {(o, x) for o, s in pairs for x in (s, s + 1 if s % 2 == 0 else s - 1)}
    kept = {(o, -1 if x % 17 == 16 else x) for o, x in offered}
    by_order = {o: len([1 for a, _ in kept if a == o]) for o in range(40)}
    got = [r for r in scores.collect() if r.text_id is not None and r.inst_id is not None]
    for model in ("basic", "lang"):
        ranks = {o: sorted(r["rank"] for r in got if r.model == model and r.text_id == o) for o in by_order if o != 4}
        assert ranks == {o: list(range(1, min(n, 20) + 1)) for o, n in by_order.items() if o != 4}
        assert {(r.text_id, r.inst_id) for r in got if r.model == model} <= kept


def test_candidates_with_their_texts_are_not_stored(tables):
    assert catalog_resolve.order_candidates(tables).count() > 0
    assert "order-candidates" not in tables._made


def test_texts_with_white_space_around_them_are_cleaned_by_themselves(spark):
    texts = [(1, "Univ. A & B (Chile)"), (2, " \u00a0Univ. A & B (Chile)\t"), (3, "x\u2003"), (4, None), (5, " ")]
    got = resolve.describe_texts(spark.createDataFrame(texts, "text_id long, raw string"), {"Chile": ["Chile"]})
    want = {1: ("UniversityAandB",) * 2, 2: ("UniversityAandB",) * 2, 3: ("x", "x"), 4: (None, None), 5: ("", "")}
    assert {r.text_id: (r.clean, r.clean_stripped) for r in got.collect()} == want


def test_rows_with_their_texts_are_not_moved_or_sorted(tables, capsys):
    """Institutions, few by a bounded count, come to the rows; all rules work in the order that the join by text left."""
    flagged = ensemble.flag_removals(ensemble.resolve_same_name(catalog_resolve.order_predictions(tables)))
    capsys.readouterr()
    flagged.explain()
    plan = capsys.readouterr().out
    lines = plan.splitlines()
    assert not [x for x in lines if "Sort [text_id" in x and "display_name" in x], plan
    assert "BroadcastHashJoin [inst_id" in plan and not [x for x in lines if "Exchange hashpartitioning(inst_id" in x and "_salt" in x], plan


def test_a_dimension_beyond_the_bound_is_salted(tables, monkeypatch):
    def rows():
        found = catalog_resolve.order_candidates(Tables(tables.spark, tables.path))
        return sorted(str(sorted(r.asDict().items())) for r in found.collect())

    few = rows()
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 59)
    assert few and rows() == few


def test_one_of_a_name_stays(spark):
    rows = [
        (1, "A", 0, 5, "xRomex", "Rome"), (1, "A", 1, 6, "xRomex", "Bern"), (1, "B", 1, 7, "xRomex", "Bern"),
        (2, "A", 1, 6, "x", "Rome"), (2, "A", 1, 5, "x", "Bern"), (2, None, 0, 9, "x", None), (2, None, 1, 4, "x", None),
        (3, None, 1, 8, "x", "y"), (3, "C", 0, 1, "xy", None),
    ]
    frame = spark.createDataFrame(rows, "text_id long, display_name string, pos int, inst_id long, clean string, clean_city string")
    got = sorted((r.text_id, r.inst_id) for r in ensemble.resolve_same_name(frame).collect())
    assert got == [(1, 5), (1, 7), (2, 5), (2, 9), (3, 1), (3, 8)]


def test_texts_are_made_where_their_lines_are(tables, spark, capsys):
    """Order texts are neither stored nor dealt again: lines are dealt by order, all else works in their tasks."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = ensemble.finalize_predictions(catalog_resolve.order_texts(tables), ensemble.flag_removals(ensemble.resolve_same_name(catalog_resolve.order_predictions(tables))))
        capsys.readouterr()
        frame.explain()
        dealt = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(text_id" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt), dealt
    assert not tables._made


def test_preview_looks_institutions_up_beside_each_other(spark, capsys, monkeypatch):
    scores = [(1, "basic", 1, 5, 0.5), (1, "lang", 1, 6, 0.25), (1, "lang", 2, 5, 0.125), (2, "basic", 1, -1, 1.0), (2, "lang", 1, None, 0.5), (None, "lang", 1, 7, 0.1)]
    institutions = [(5, "5", "A", "Rome", None), (6, "6", "B", None, "x"), (6, "6", "C", "Bern", "w"), (None, "n", "N", "N", "N")]
    frames = (spark.createDataFrame(scores, "text_id long, model string, rank int, inst_id long, score double"),
              spark.createDataFrame(institutions, "inst_id long, registry_id string, display_name string, city string, country string"))
    none, unknown = (None,) * 6, ("", "", "", "")
    five, six, seven = ("5", "A", "Rome", ""), ("6", "C", "Bern", "x"), unknown
    want = {
        (1, 1): ("5", 0.5, *five, "6", 0.25, *six), (1, 2): (*none, "5", 0.125, *five),
        (2, 1): ("-1", 1.0, *unknown, None, 0.5, *unknown), (None, 1): (*none, "7", 0.1, *seven),
    }
    for rows in (skew.BROADCAST_ROWS, 2):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
        found = evaluate.scorer_preview(*frames)
        assert {(r[0], r[1]): tuple(r)[2:] for r in found.collect()} == want
        capsys.readouterr()
        found.explain()
        plan = capsys.readouterr().out.splitlines()
        wide = [x for x in plan if "Exchange hashpartitioning(text_id" in x]
        assert wide and not [x for x in wide if "display_name" in x]
    assert found.columns == ["text_id", "rank", *[f"{m}_{c}" for m in ("basic", "lang") for c in ("pred", "score", "registry_id", "display_name", "city", "country")]]


def test_a_dimension_of_long_texts_is_not_held_by_every_task(spark, monkeypatch):
    dim = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text", "array('y') AS list")
    assert skew.fits_in_tasks(dim) and skew.fits_in_tasks(dim.limit(0))
    monkeypatch.setattr(skew, "BROADCAST_CHARACTERS", 50_000)
    assert not skew.fits_in_tasks(dim) and skew.fits_in_tasks(dim.select("id"))
