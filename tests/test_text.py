from pyspark.sql import functions as F

from affinis.functions import text
from affinis.operators.language import script_language
from affinis.sources.readers import parse_labels, read_gold, read_requests


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_fold(spark):
    got = values(spark, ["Zürich – Łódź", "Straße", "Œuvre Ærø", "Москва", "Αθήνα", "plain", None, "Nguyễn", "a b"], text.ascii_fold)
    assert got == ["Zurich - Lodz", "Strasse", "OEuvre AEro", "Moskva", "Athena", "plain", None, "Nguyen", "a b"]


def test_fold_of_compatible_forms(spark):
    got = values(spark, ["Ｕｎｉｖ．", "½ ™ № −", "ofﬁce", "x⁴ ①", "Ⓐ"], text.ascii_fold)
    assert got == ["Univ.", "1/2 tm No -", "office", "x4 1", "A"]


def test_clean(spark):
    got = values(
        spark,
        ["A & B", "R&D & Co", "Acme (France) (x) (France) ", "Acme (France) Ltd", "Univ. of X, Lab. Y", "U.S. Air Force",
         "%9$G23VG5^", "    ", "", None],
        lambda c: text.clean_match_text(c, ["France", "U.S."]),
    )
    assert got == ["AandB", "RDCo", "Acmex", "AcmeFranceLtd", "UniversityofXLaboratoryY", "UnitedStatesAirForce",
                   "9G23VG5", "", "", None]
    build = values(spark, ["U.S. Army Lab."], lambda c: text.clean_match_text(c, armed_forces=False))
    assert build == ["USArmyLaboratory"]


def test_staged_clean_is_the_same(spark):
    texts = ["A & B (France)", "Çelik Univ. & R&D", None, "  x (Peru)  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    staged = text.with_clean_text(df, "t", "v", ["France", "Peru"]).orderBy("i").collect()
    assert [r["v"] for r in staged] == values(spark, texts, lambda c: text.clean_match_text(c, ["France", "Peru"]))


def test_countries(spark):
    patterns = {"Guinea": ["Guinea"], "Papua New Guinea": ["Papua New Guinea", "PNG"], "USA": ["U.S.A", "USA"],
                "Guinea-Bissau": ["Guinea-Bissau", "Guinea Bissau"], "Niger": ["Niger"], "Nigeria": ["Nigeria"], "Nowhere": []}
    texts = ["Port Moresby, Papua New Guinea", "Lagos, Nigeria", "MIT, U.S.A., Cambridge", "Bissau, Guinea-Bissau", "Nigerian", ""]
    expected = [["Guinea", "Papua New Guinea"], ["Nigeria"], ["USA"], ["Guinea", "Guinea-Bissau"], [], []]
    assert values(spark, texts, lambda c: text.countries_in_text(c, patterns)) == expected
    as_regex = values(spark, ["Lagos, Nigeria", "Niamey, Niger", "x"],
                      lambda c: text.countries_in_text(c, {"N": ["Niger(?:ia)?"], "None": []}, regex=True))
    assert as_regex == [["N"], ["N"], []]


def test_match_key_and_parts(spark):
    assert values(spark, ["Ünï & Co. 7"], text.match_key) == ["uniandco7"]
    assert values(spark, ["", ",", "a,b,"], text.comma_parts) == [1, 2, 3]
    assert values(spark, ["\t x \n"], text.strip) == ["x"]
    assert values(spark, ["a\r\nb\nc"], text.one_line) == ["a b c"]
    assert values(spark, ["https://x.org/01abc"], text.id_from_url) == ["01abc"]


def test_tokens(spark):
    assert values(spark, ["Dép. of X, 12"], text.word_tokens) == [["dep", ".", "of", "x", ",", "12"]]
    assert values(spark, ["Ab, ab!"], text.index_words) == [["ab"]]
    assert values(spark, ["abc"], lambda c: text.index_ngrams(c, 4)) == [[" abc", "abc "]]
    assert values(spark, ["x"], lambda c: text.pad_truncate(F.array(F.lit(5), F.lit(6)), 3)) == [[5, 6, 0]]
    assert values(spark, ["x"], lambda c: text.pad_truncate(F.array(F.lit(5), F.lit(6)), 1)) == [[5]]


def test_script_language(spark):
    got = values(spark, ["北京大学", "서울대학교", "東京だいがく", "Москва", "Київський", "جامعة", "دانشگاه پچ", "Đại học Hà Nội", "Paris é", "123"],
                 script_language)
    assert got == ["zh-cn", "ko", "ja", "ru", "uk", "ar", "fa", "vi", None, None]


def test_labels_and_files(spark, tmp_path):
    assert values(spark, ["1||||22", "[3, 4]", "[-1]", ""], parse_labels) == [[1, 22], [3, 4], [-1], []]
    (tmp_path / "gold.tsv").write_text(
        "\tpaper_id\taffiliation_string\tlabels\tdataset\n0\tp12\tA; ; B\t7||||8\tgold_500\n1\tp13\tC\t[9]\tx\n")
    rows = read_gold(spark, str(tmp_path / "gold.tsv"), id_prefix=True).orderBy("paper_id").collect()
    assert [(r.paper_id, r.affiliation_string, r.labels, r.dataset) for r in rows] == [
        (12, "A; ; B", [7, 8], "gold_500"), (13, "C", [9], "x")]
    (tmp_path / "r.json").write_text('{"affiliation_string": 398276}\n{"affiliation_string": null}\n{"affiliation_string": "    "}\n')
    assert [r[0] for r in read_requests(spark, str(tmp_path / "r.json")).collect()] == ["398276", None, "    "]
