"""Queries for text functions, name matching, generated strings and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinis import fixed_values as fixed
from affinis.functions import text
from affinis.operators import countries, dims, features, language, matching, synth
from affinis.operators.evaluate import round_ratio as ratio
from affinis.operators.scoring import soft_max as to_shares
from affinis.plans.bindings import (
    SQL_MENTION, Tables, institution, listed, mention, query, sql_ampersand, sql_clean, sql_draw, sql_draw_int,
    sql_fold,
)
from affinis.plans.catalog_tables import SQL_TOKENS, supplier_places
from affinis.session import materialize
from affinis.sources.readers import parse_labels as labels_of


def nation_patterns(t: Tables) -> dict[str, list[str]]:
    """Nations as countries, each with its name as the one pattern."""
    return text.country_patterns(t.nation.select(F.col("n_name").alias("country"), F.col("n_name").alias("pattern")))


# ====================================================== containment joins ==
@query(f"""WITH {SQL_MENTION}, u AS (SELECT DISTINCT affiliation_string FROM mention)
SELECT affiliation_string, array_to_string(list_sort(list_distinct(list_intersect(
  regexp_extract_all(affiliation_string, '\\w+'), (SELECT list(n_name) FROM nation)))), '|') AS countries FROM u""")
def join_country_regex(t: Tables):
    texts = mention(t).select("affiliation_string").distinct()
    names = t.nation.select(F.col("n_name").alias("country"), F.col("n_name").alias("pattern"))
    return countries.with_countries(texts, names, "affiliation_string").select("affiliation_string", listed(F.col("countries")).alias("countries"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def join_contains(t: Tables):
    passages = t.benchmark.withColumnRenamed("text", "passage")
    return matching.join_contains(t.wide_documents, passages, "doc_id", "text", "item_id", "passage")


SQL_MATCHES = """m AS (SELECT DISTINCT l_orderkey AS text_id, l_suppkey AS inst_id,
  CASE WHEN l_linenumber % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def order_matches(t: Tables):
    """Part names per order as matched names; every other line has only the first word."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.split("p_name", " ")[0]).otherwise(F.col("p_name"))
    return rows.select(
        F.col("l_orderkey").alias("text_id"), F.col("l_suppkey").alias("inst_id"), name.alias("name")).distinct()


@query(f"""WITH {SQL_MATCHES} SELECT * FROM m WHERE NOT EXISTS (
  SELECT 1 FROM m o WHERE o.text_id = m.text_id AND contains(o.name, m.name) AND o.name <> m.name)""")
def anti_substring(t: Tables):
    return matching.anti_substring(order_matches(t))


@query(f"""WITH {SQL_MATCHES}, p AS (SELECT l_orderkey AS text_id, list(p_name) AS names FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 GROUP BY 1)
SELECT m.* FROM m LEFT JOIN p ON p.text_id = m.text_id
WHERE coalesce(len(list_filter(p.names, lambda x: contains(x, m.name))), 0) = 0""")
def anti_primary_name(t: Tables):
    first = t.lineitem.filter("l_linenumber = 1").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    names = first.groupBy(F.col("l_orderkey").alias("text_id")).agg(F.collect_list("p_name").alias("pick_names"))
    return matching.anti_primary_name(order_matches(t), names)


# ========================================================= text functions ==
@query(f"""SELECT 'd' || doc_id AS id, md5({sql_clean('text')}) AS clean FROM documents
UNION ALL SELECT 's' || s_suppkey, md5({sql_clean("(s_name || ' & U.S. Army Lab. (' || n_name || ') ')", countries=True)})
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def clean_match_text(t: Tables):
    docs = text.with_clean_text(t.wide_documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"), "text", "clean")
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        F.concat("s_name", F.lit(" & U.S. Army Lab. ("), "n_name", F.lit(") ")).alias("text"))
    named = text.with_clean_text(named, "text", "clean", list(nation_patterns(t)))
    return docs.union(named).select("id", F.md5("clean").alias("clean"))


@query(f"""SELECT p_partkey, {sql_clean("(p_name || ' & U.S. Navy Lab. Univ. ' || p_brand)", armed_forces=False)} AS clean
FROM part""")
def clean_match_text_build(t: Tables):
    name = F.concat("p_name", F.lit(" & U.S. Navy Lab. Univ. "), "p_brand")
    return t.part.select("p_partkey", text.clean_match_text(name, armed_forces=False).alias("clean"))


@query(f"""SELECT p_partkey, regexp_replace(lower({sql_fold('(' + sql_ampersand("(p_name || ' & ' || p_brand)") + ')')}),
  '[^a-z0-9]', '', 'g') AS match_key FROM part""")
def match_key(t: Tables):
    return t.part.select("p_partkey", text.match_key(F.concat_ws(" & ", "p_name", "p_brand")).alias("match_key"))


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def ascii_fold(t: Tables):
    return t.wide_documents.select("doc_id", F.md5(text.ascii_fold(F.col("text"))).alias("folded"))


@query("SELECT doc_id, CAST(len(string_split(text, ',')) AS INTEGER) AS parts FROM documents")
def comma_parts(t: Tables):
    return t.wide_documents.select("doc_id", text.comma_parts(F.col("text")).alias("parts"))


@query("""SELECT p_partkey, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'bolt') AS ends,
  contains(p_name, 'e') AS has FROM part""")
def prefix_suffix_tests(t: Tables):
    name = F.col("p_name")
    return t.part.select("p_partkey", name.startswith("red").alias("starts"), name.endswith("bolt").alias("ends"),
                         name.contains("e").alias("has"))


def sql_bounded(x: str, words: str) -> str:
    """Between Unicode word boundaries; SQL's own boundary knows ASCII only."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"regexp_matches({x}, '(?:^|{edge})(?:{words})(?:{edge}|$)')"


@query(f"""SELECT doc_id, {sql_bounded('upper(text)', 'LE|THE|DER')} AS surname, {sql_bounded('text', 'the of')} AS phrase
FROM documents""")
def regex_tests(t: Tables):
    return t.wide_documents.select(
        "doc_id", text.has_word(F.upper("text"), ["LE", "THE", "DER"]).alias("surname"),
        text.has_word(F.col("text"), ["the of"]).alias("phrase"))


SQL_NAMES = """n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'University of Oxford' WHEN 1 THEN 'Harvard University'
    WHEN 2 THEN 'University of ' || p_type ELSE p_brand || ' University' END AS name,
  [p_name || ' & ' || p_brand, p_type || ' Univ.'] AS aliases, [p_brand] AS acronyms, ['Lab. ' || p_name, 'Coastal'] AS labels
  FROM part)"""


def part_names(t: Tables):
    key = F.col("p_partkey") % 4
    name = (
        F.when(key == 0, "University of Oxford").when(key == 1, "Harvard University")
        .when(key == 2, F.concat(F.lit("University of "), "p_type")).otherwise(F.concat("p_brand", F.lit(" University")))
    )
    return t.part.select(
        "p_partkey", name.alias("name"),
        F.array(F.concat_ws(" & ", "p_name", "p_brand"), F.concat("p_type", F.lit(" Univ."))).alias("aliases"),
        F.array("p_brand").alias("acronyms"),
        F.array(F.concat(F.lit("Lab. "), "p_name"), F.lit("Coastal")).alias("labels"),
    )


SQL_EXTRA = """(CASE WHEN list_contains(l, 'Harvard University') THEN list_append(l, 'Harvard Medical School')
  WHEN list_contains(l, 'University of Oxford') THEN list_append(l, 'Oxford University') ELSE l END)"""


@query(f"""WITH {SQL_NAMES}, f AS (SELECT p_partkey, unnest(list_prepend(name, aliases)) AS x FROM n),
b AS (SELECT p_partkey, x FROM f UNION ALL
  SELECT p_partkey, CASE WHEN regexp_matches(x, '^University of [^ ]*$') THEN substr(x, 15) || ' University'
    WHEN regexp_matches(x, '^[^ ]* University$') THEN 'University of ' || split_part(x, ' ', 1) END FROM f)
SELECT p_partkey, string_agg(x, '|' ORDER BY x) AS names FROM b WHERE x IS NOT NULL GROUP BY 1""")
def backwards_university(t: Tables):
    names = dims.backwards_university(F.concat(F.array("name"), "aliases"))
    return part_names(t).select("p_partkey", listed(F.array_sort(names)).alias("names"))


@query(f"WITH {SQL_NAMES}, f AS (SELECT p_partkey, list_prepend(name, aliases) AS l FROM n) SELECT p_partkey, array_to_string({SQL_EXTRA}, '|') AS names FROM f")
def extra_known_names(t: Tables):
    names = dims.extra_known_names(F.concat(F.array("name"), "aliases"))
    return part_names(t).select("p_partkey", listed(names).alias("names"))


SQL_EXACT = f"""{SQL_NAMES}, f AS (SELECT p_partkey, name, list_concat([name], aliases, acronyms, labels) AS l FROM n),
e AS (SELECT p_partkey, name, list_filter(list_transform({SQL_EXTRA}, lambda x: {sql_clean('x', armed_forces=False)}),
  lambda x: length(x) > 4) AS exact FROM f)"""


@query(f"WITH {SQL_EXACT} SELECT p_partkey, array_to_string(exact, '|') AS names FROM e")
def exact_names(t: Tables):
    exact = dims.exact_names(F.col("name"), F.col("aliases"), F.col("acronyms"), F.col("labels"))
    return part_names(t).select("p_partkey", listed(exact).alias("names"))


@query(f"""WITH {SQL_EXACT}, d AS (SELECT p_partkey, unnest(list_append(exact, {sql_clean('name', armed_forces=False)})) AS x FROM e)
SELECT p_partkey, string_agg(x, '|' ORDER BY length(x) DESC, x) AS names FROM (SELECT DISTINCT * FROM d)
WHERE length(x) > 4 AND x NOT IN ('UniversityHospital', 'Coastal', 'Brunswick', 'Continental') GROUP BY 1""")
def final_names(t: Tables):
    exact = dims.exact_names(F.col("name"), F.col("aliases"), F.col("acronyms"), F.col("labels"))
    return part_names(t).select("p_partkey", listed(dims.final_names(F.col("name"), exact)).alias("names"))


@query("""SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_type ELSE '' END AS names
FROM part""")
def name_aliases(t: Tables):
    code = F.when(F.col("p_partkey") % 2 == 0, "fr").otherwise("ja")
    labels = F.array(F.struct(F.col("p_type").alias("label"), code.alias("iso639")))
    return t.part.select("p_partkey", listed(dims.name_aliases(F.col("p_name"), F.array("p_brand"), labels)).alias("names"))


SQL_VOCAB = f"""c AS (SELECT token, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS token FROM documents) GROUP BY 1
  ORDER BY n DESC, token LIMIT 3816),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS token_id FROM c),
pos AS (SELECT doc_id, unnest({SQL_TOKENS}) AS token, generate_subscripts({SQL_TOKENS}, 1) AS pos FROM documents),
ids AS (SELECT doc_id, pos, coalesce(token_id, 0) AS token_id FROM pos LEFT JOIN vocab USING (token))"""


def document_vocab(t: Tables):
    return features.token_vocab(features.term_frequency(t.wide_documents, "text"))


@query(f"""WITH {SQL_VOCAB} SELECT doc_id, string_agg(token_id, '|' ORDER BY pos) AS token_ids FROM ids GROUP BY 1""")
def encode_tokens(t: Tables):
    encoded = features.encode_tokens(t.wide_documents, document_vocab(t), "doc_id", "text")
    return encoded.select("doc_id", listed("token_ids").alias("token_ids"))


@query(f"""WITH {SQL_VOCAB} SELECT doc_id, string_agg(token_id, '|' ORDER BY pos) ||
  repeat('|0', greatest(128 - count(*), 0)) AS model_input FROM ids WHERE pos <= 128 GROUP BY 1""")
def pad_truncate(t: Tables):
    rows = features.model_input(t.wide_documents, document_vocab(t), "doc_id", "text")
    return rows.select("doc_id", listed("model_input").alias("model_input"))


@query("""SELECT o_orderkey, o_orderkey AS paper_id, o_custkey || '|' || o_orderkey AS labels FROM orders""")
def parse_labels(t: Tables):
    piped = F.concat_ws("||||", "o_custkey", "o_orderkey")
    listed_text = F.concat(F.lit("["), F.concat_ws(", ", "o_custkey", "o_orderkey"), F.lit("]"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, piped).otherwise(listed_text)
    paper = F.substring(F.concat(F.lit("p"), "o_orderkey"), 2, 100).try_cast("bigint")
    return t.orders.select("o_orderkey", paper.alias("paper_id"), listed(labels_of(raw)).alias("labels"))


@query("""SELECT event_id, '[' || user_id || ',' || (props->>'k') || ']' AS ids_json,
  user_id || '|' || (props->>'k') AS ids FROM events""")
def json_round_trip(t: Tables):
    k = F.from_json("props", "k bigint")["k"]
    as_json = t.events.select("event_id", F.to_json(F.array("user_id", k)).alias("ids_json"))
    return as_json.select("event_id", "ids_json", listed(F.from_json("ids_json", "array<bigint>")).alias("ids"))


@query("""SELECT lang, round(sum(toxic)::DOUBLE / nullif(sum(quality), 0), 3) AS share
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def round_ratio(t: Tables):
    sums = t.labels.join(t.wide_documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(
        F.sum("toxic").alias("a"), F.sum("quality").alias("b"))
    return sums.select("lang", ratio(F.col("a"), F.col("b")).alias("share"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, l_quantity / 50.0::DOUBLE AS s, l_linenumber, l_partkey FROM lineitem),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY l_orderkey)) AS e FROM s)
SELECT l_orderkey AS text_id, l_suppkey AS inst_id, l_partkey, l_linenumber,
  round(e / sum(e) OVER (PARTITION BY l_orderkey), 6) AS score FROM e""")
def soft_max(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("text_id"), F.col("l_suppkey").alias("inst_id"), "l_partkey", "l_linenumber",
        (F.col("l_quantity") / 50.0).alias("score"))
    return to_shares(rows)


# ======================================================= generated strings ==
@query("""SELECT p_partkey, f || ' ' || p_type AS prefix FROM part,
  (SELECT unnest(['Department of', 'Dep of', 'Dept of', 'Dep. of', 'Dept. of']) AS f)""")
def prefix_terms(t: Tables):
    rows = synth.expand_prefixes(t.part.select("p_partkey", "p_type"), "p_type", fixed.DEPARTMENT_FORMATS)
    return rows.select("p_partkey", "prefix")


SQL_SYNTH = f"""base AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS registry_id,
    CASE s_suppkey % 4 WHEN 0 THEN 'Education' WHEN 1 THEN 'Healthcare' WHEN 2 THEN 'Company' ELSE 'Archive' END AS type,
    CASE WHEN s_suppkey % 5 < 3 THEN n_name END AS city,
    CASE WHEN s_suppkey % 5 = 1 THEN 'St ' || n_name END AS state,
    CASE WHEN s_suppkey % 10 = 0 THEN n_name WHEN s_suppkey % 5 = 2 THEN NULL ELSE 'Région ' || n_name END AS region0,
    CASE WHEN s_suppkey % 5 < 4 THEN r_name END AS country,
    list_concat([s_name], CASE WHEN s_suppkey % 2 = 0 THEN ['Alias & ' || s_name] ELSE [] END,
      ['Münster ' || s_suppkey], CASE WHEN s_suppkey % 3 = 0 THEN ['S' || s_suppkey] ELSE [] END) AS aliases
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
folded AS (SELECT *, {sql_fold('region0')} AS region FROM base),
kinds AS (SELECT *, CASE
    WHEN state IS NULL AND region <> city AND country IS NOT NULL THEN 'region'
    WHEN state IS NOT NULL AND city IS NOT NULL AND country IS NOT NULL THEN 'state'
    WHEN city IS NOT NULL AND country IS NOT NULL THEN 'city'
    WHEN country IS NOT NULL THEN 'country' ELSE 'none' END AS kind FROM folded),
sets AS (SELECT *, CASE
    WHEN kind IN ('region', 'state') THEN
      [[city, coalesce(state, region), country], [city, country], [city, coalesce(state, region)], [country], [city],
       [coalesce(state, region)]]
    WHEN kind = 'city' THEN [[city, country], [country], [city]]
    WHEN kind = 'country' THEN [[country]] ELSE [] END AS sets,
  CASE type WHEN 'Education' THEN CASE kind WHEN 'region' THEN 5 WHEN 'state' THEN 3 WHEN 'city' THEN 3 WHEN 'country' THEN 4 ELSE 5 END
    WHEN 'Healthcare' THEN 3 WHEN 'Company' THEN CASE WHEN kind IN ('region', 'none') THEN 2 ELSE 1 END ELSE 0 END AS repeats
  FROM kinds),
suffixed AS (SELECT registry_id, type, repeats, aliases,
  list_concat(list_transform(sets, lambda s: ', ' || array_to_string(s, ', ')),
              list_transform(sets, lambda s: ' ' || array_to_string(s, ' ')), ['']) AS suffixes FROM sets),
alias_rows AS (SELECT registry_id, type, repeats, suffixes, unnest(aliases) AS alias0,
  generate_subscripts(aliases, 1) - 1 AS alias_no FROM suffixed),
suffix_rows AS (SELECT registry_id, type, repeats, alias_no, {sql_fold('(' + sql_ampersand('alias0') + ')')} AS alias,
  unnest(suffixes) AS suffix, generate_subscripts(suffixes, 1) - 1 AS suffix_no FROM alias_rows),
prefixes AS (SELECT type, prefix, row_number() OVER (PARTITION BY type ORDER BY prefix) - 1 AS prefix_no,
    count(*) OVER (PARTITION BY type) AS prefix_count
  FROM (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Education' WHEN 1 THEN 'Healthcare' ELSE 'Company' END AS type,
        'Dept. of ' || p_name AS prefix FROM part)),
drawn AS (SELECT s.*, f.form, rep FROM suffix_rows s, (SELECT unnest(['after', 'before']) AS form) f,
  (SELECT unnest(range(1, 6)) AS rep) r WHERE rep <= repeats),
with_prefix AS (SELECT d.*, p.prefix FROM drawn d
  JOIN (SELECT DISTINCT type, prefix_count FROM prefixes) c USING (type)
  JOIN prefixes p ON p.type = d.type
    AND p.prefix_no = {sql_draw_int(1, 'registry_id', 'alias_no', 'rep', 'form', 'suffix_no')} % c.prefix_count),
strings AS (
  SELECT registry_id, alias || suffix AS s FROM suffix_rows UNION ALL
  SELECT registry_id, CASE form WHEN 'after' THEN alias || ' ' || prefix ELSE prefix || ' ' || alias END || suffix FROM with_prefix)"""


def synth_places(t: Tables):
    """Suppliers with place fields set so that every kind of place occurs."""
    key = F.col("inst_id")
    label = lambda text_col, code: F.struct(text_col.alias("label"), F.lit(code).alias("iso639"))
    return institution(t).select(
        key.cast("string").alias("registry_id"),
        F.when(key % 4 == 0, "Education").when(key % 4 == 1, "Healthcare").when(key % 4 == 2, "Company")
        .otherwise("Archive").alias("type"),
        F.col("display_name").alias("name"),
        F.when(key % 2 == 0, F.array(F.concat(F.lit("Alias & "), "display_name"))).alias("aliases"),
        F.array(label(F.concat(F.lit("Münster "), key), "de"), label(F.col("display_name"), "ja")).alias("labels"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("S"), key))).alias("acronyms"),
        F.when(key % 5 < 3, F.col("country")).alias("city"),
        F.when(key % 5 == 1, F.concat(F.lit("St "), "country")).alias("state"),
        F.when(key % 10 == 0, F.col("country")).when(key % 5 != 2, F.concat(F.lit("Région "), "country")).alias("region"),
        F.when(key % 5 < 4, F.col("region")).alias("country"),
    )


@query(f"WITH {SQL_SYNTH} SELECT registry_id, s AS original_affiliation, count(*) AS n FROM strings GROUP BY 1, 2")
def synthetic_strings(t: Tables):
    kind = F.col("p_partkey") % 3
    prefixes = t.part.select(
        F.when(kind == 0, "Education").when(kind == 1, "Healthcare").otherwise("Company").alias("inst_type"),
        F.concat(F.lit("Dept. of "), "p_name").alias("prefix")).distinct()
    rows = synth.synthetic_strings(synth_places(t), prefixes)
    return rows.groupBy("registry_id", "original_affiliation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT s_suppkey AS place_id, s_name AS city, n_name AS region, r_name AS country FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT city || ', ' || country AS t FROM p ORDER BY {sql_draw(1, 'place_id')}, place_id LIMIT 1500),
b AS (SELECT city || ', ' || region || ', ' || country AS t FROM p ORDER BY {sql_draw(2, 'place_id')}, place_id LIMIT 1500)
SELECT t AS original_affiliation FROM a UNION SELECT t FROM b""")
def empty_place_strings(t: Tables):
    return synth.empty_place_strings(supplier_places(t))


# =============================================================== language ==
SQL_GRAMS = r"lower(regexp_replace(text, '[^\p{L}]+', ' ', 'g'))"


@query(f"""WITH flat AS (SELECT doc_id, doc_id % 2 AS half, lang, {SQL_GRAMS} AS f FROM documents),
g AS (SELECT doc_id, half, lang, unnest([substr(f, i::BIGINT, 3) FOR i IN range(1, greatest(length(f) - 2, 0) + 1)]) AS gram FROM flat),
p AS (SELECT 1 - half AS half, lang, gram, row_number() OVER (PARTITION BY half, lang ORDER BY count(*) DESC, gram) AS rank
  FROM g GROUP BY half, lang, gram),
s AS (SELECT doc_id, p.lang, sum(1000000 // rank) AS s FROM (SELECT DISTINCT doc_id, half, gram FROM g) JOIN p USING (half, gram) GROUP BY 1, 2),
b AS (SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
SELECT doc_id, coalesce(b.lang, 'en') AS lang FROM documents LEFT JOIN b USING (doc_id)""")
def detect_language(t: Tables):
    """Each half of the documents is scored with the profiles of the other, so no row's own label counts."""
    halves = [t.wide_documents.filter(F.col("doc_id") % 2 == half) for half in (0, 1)]
    profiles = [materialize(language.fit_language_profiles(h, "text", "lang"), "profiles") for h in halves]
    found = [language.detect_language(h, "doc_id", "text", p) for h, p in zip(halves, reversed(profiles))]
    return found[0].unionByName(found[1])
