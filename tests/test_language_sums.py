"""Language by profiles: whole results without a shuffle of trigrams."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from affinis.operators import language


def plain(rows, profiles, default="en"):
    sums, seen = defaultdict(Counter), set()
    for doc, text in rows:
        seen.add(doc)
        flat = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        flat = " ".join(flat.split(" ")) if "  " not in flat else flat
        while "  " in flat:
            flat = flat.replace("  ", " ")
        for gram in {flat[i : i + 3] for i in range(len(flat) - 2)}:
            for lang, rank in profiles.get(gram, ()):
                sums[doc][lang] += 1_000_000 // rank
    return {d: min(sums[d], key=lambda x: (-sums[d][x], x)) if sums[d] else default for d in seen}


def test_profiles(spark, monkeypatch):
    """Pieces of a few texts, repeated ids, nulls, short texts and a profile without a language."""
    monkeypatch.setattr(language, "TEXT_BYTES", 200)
    dice = random.Random(2)
    words = {lang: ["".join(dice.choices(signs, k=4)) for _ in range(40)] for lang, signs in (("aa", "abcdé"), ("bb", "cdefø"), (None, "efgab"))}
    docs = [(i, " ".join(dice.choices(words[lang], k=12)), lang) for i, lang in enumerate(dice.choices([*words], k=90))]
    docs += [(1, "abcd, abcd", "bb"), (200, None, "aa"), (201, "a", "aa"), (202, "", None), (203, "zzzz 9", "aa")]
    df = spark.createDataFrame(docs, "id long, text string, lang string")
    counts = Counter()
    for _, text, lang in docs:
        flat = " ".join("".join(c if c.isalpha() else " " for c in text or "").split())
        for i in range(len(flat) - 2):
            counts[lang, flat[i : i + 3]] += 1
    found = {(r.lang, r.gram): r["rank"] for r in language.fit_language_profiles(df.filter("id <> 203"), "text", "lang").collect()}
    ranked, place = {}, Counter()
    for lang, gram in sorted((k for k in counts if "z" not in k[1]), key=lambda k: (str(k[0]), -counts[k], k[1].encode())):
        place[lang] += 1
        ranked[lang, gram] = place[lang]
    assert found == ranked
    stored = language.fit_language_profiles(df.filter("id <> 203"), "text", "lang")
    known = defaultdict(list)
    for (lang, gram), rank in ranked.items():
        if lang:
            known[gram].append((lang, rank))
    got = language.detect_language(df, "id", "text", stored)
    assert {r.id: r.lang for r in got.collect()} == plain([(d, t) for d, t, _ in docs], known)
    # texts and trigrams stay in their task: what is shuffled has a row for each row and language
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" not in plan


def test_script_on_what_is_not_ascii(spark):
    rows = [("Привет мир abc", "ru"), ("їжак живе тут", "uk"), ("大学 a", "zh-cn"), ("東京 の 大学", "ja"), ("서울 대학교", "ko"),
            ("plain ascii text", None), ("café and more letters", None), ("đại học ở đây", "vi"), ("جامعة", "ar"), ("دانشگاه پ", "fa"),
            ("12 – 34", None), (None, None), ("mostly latin letters and one Ж", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, text string")
    found = {r.id: r.lang for r in df.select("id", language.script_language(F.col("text")).alias("lang")).collect()}
    assert found == {i: lang for i, (_, lang) in enumerate(rows)}
