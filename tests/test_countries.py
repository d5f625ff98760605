"""Country patterns by an automaton against a plain search and against the column expression."""

import random
import re

from pyspark.sql import functions as F

from affinis.functions import text
from affinis.operators import countries


def tags(spark, texts, patterns, **more):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame(patterns, "country string, pattern string")
    return {r.id: r.countries for r in countries.with_countries(frame, table, **more).collect()}


def plain(words, patterns):
    """Words are ASCII, so a plain regular expression tells word borders."""
    forms = [words or "", (words or "").replace(".", "")]
    return sorted({c for c, p in patterns if c and p and any(re.search(r"(?<!\w)%s(?!\w)" % re.escape(p), f) for f in forms)})


def test_overlapping_and_nested_patterns(spark):
    patterns = [("A", "New York"), ("B", "York City"), ("C", "York"), ("D", "New York City"), ("E", "U.S"), ("F", "USA"), ("G", "ork"), ("C", "Yor"), ("H", "York"), ("I", ""), (None, "City"), ("J", None)]
    texts = ["New York City", "in U.S.A. now", "USA", "USAF", "Yorkshire, York", "cork", None, "", "York_1", "x.York.y"]
    got = tags(spark, texts, patterns)
    assert got[0] == ["A", "B", "C", "D", "H"] and got[2] == ["F"] and got[3] == [] and got[6] == []
    assert got == {i: plain(t, patterns) for i, t in enumerate(texts)}
    assert tags(spark, texts, []) == {i: [] for i in range(len(texts))}


def test_hundred_thousand_patterns(spark):
    dice = random.Random(1)
    names = ["".join(dice.choices("abcde", k=dice.randint(2, 9))) for _ in range(100_000)]
    patterns = [(f"c{n % 5000}", f"{name} {names[n - 1]}" if n % 3 == 0 else name) for n, name in enumerate(names)]
    texts = [" ".join(dice.choice(names) if dice.random() < 0.5 else f"z{dice.randrange(99)}" for _ in range(8)) for _ in range(200)]
    owners = {}
    for c, p in patterns:
        owners.setdefault(p, set()).add(c)
    want = {}
    for i, t in enumerate(texts):
        words = t.split()
        spans = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        want[i] = sorted(set().union(*(owners.get(s, set()) for s in spans)))
    assert tags(spark, texts, patterns) == want
    assert tags(spark, texts, patterns, block_patterns=30_000) == want


def test_same_as_the_column_expression(spark):
    patterns = {"Côte": ["Côte d'Ivoire", "Ivory Coast"], "한국": ["한국"], "UK": ["U.K.", "England"], "S": ["S. Marino"]}
    texts = ["Abidjan, Côte d'Ivoire", "서울 한국", "한국어", "London UK", "U.K., England", "S. Marino", "New England's", "naïveEngland", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.c or [] for r in frame.select("id", text.countries_in_text(F.col("text"), patterns).alias("c")).collect()}
    assert tags(spark, texts, [(c, p) for c, ps in patterns.items() for p in ps]) == want
