"""Labels of documents are counted where their text is dealt to."""

import re

from affinis.plans import catalog_tables
from affinis.plans.bindings import Tables


def test_one_shuffle_of_whole_texts(spark, tmp_path):
    rows = [(1, "a b a", "en"), (1, "a", "en"), (2, None, "en"), (None, "c c", None), (3, "", "de")]
    more = [(i, f"w{i}", "en") for i in range(10, 110)]
    spark.createDataFrame(rows + more, "doc_id long, text string, lang string").repartition(100).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog_tables.explode_labels(Tables(spark, str(tmp_path)))
    assert {tuple(r) for r in found.collect() if (r.doc_id or 0) < 10} == {(1, "a", "en", 3), (1, "b", "en", 1), (None, "c", None, 2), (3, "", "de", 1)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, \d+\)", plan) == ["doc_id"] and plan.count("Exchange") == 1
