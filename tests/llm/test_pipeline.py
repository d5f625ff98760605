"""The pipeline stage by stage, the registered queries, and what holds without the subpackage."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from affinis.llm import language_crf, queries
from affinis.llm.common import materialize, table
from tests.llm.plain import later_windows, sorted_rows
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_texts import plain_dedup, plain_encoding, plain_mix

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        kept = materialize(stage(spark, docs, SF), name)
        if name == "language_id":
            named = {r.doc_id: r.lang_pred for r in language_crf.language(docs).collect()}
            want = [r for r in before if named[r[0]] != "und"]
        elif name == "exact_duplicates":
            stays = {r[0] for r in plain_dedup(before) if r[3]}
            want = [r for r in before if r[0] in stays]
        elif name == "near_duplicates":
            stays = set(plain_kept([(r[0], r[1]) for r in before]))
            want = [r for r in before if r[0] in stays]
        elif name == "mixed_sources":
            times = {r[0]: r[4] // r[1] if r[1] else 0 for r in plain_mix(before)}
            want = [r for r in before for _ in range(times[r[0]])]
        else:
            ids, _ = plain_encoding([r[1] for r in before])
            want = [(r[0], r[3], len(i), i) for r, i in zip(before, ids)]
            assert kept.columns == ["doc_id", "source", "n_tokens", "ids"]
            assert sorted_rows(kept.collect()) == sorted_rows(want)
            break
        assert kept.columns == docs.columns
        assert Counter(rows_of(kept)) == Counter(want), name
        docs = kept
    run = corpus_pipeline.run(spark, SF)
    assert sorted_rows(run.collect()) == sorted_rows(kept.collect())


def test_byte_repeats_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted_rows(queries.op7_byte_repeats(spark, SF).collect()) == sorted_rows(later_windows(rows, 50, False))


def test_entry_without_the_subpackage(tmp_path):
    for part in ("affinis", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(ROOT / part) if part.endswith(".py") else None
    package = tmp_path / "affinis"
    package.mkdir()
    for p in (ROOT / "affinis").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    said = subprocess.run(
        [sys.executable, "-B", "-c", "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1_') for q in e.queries()))"],
        cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120,
    )
    assert said.returncode == 0, said.stderr
    count, has = said.stdout.split()
    assert int(count) >= 100 and has == "False"
