"""Queries for gate, scorers, ensemble rules, whole resolution, evaluation and the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis import fixed_values as fixed
from affinis.functions.draws import draw_unit
from affinis.functions.text import clean_match_text, country_patterns, index_words
from affinis.operators import bayes, dims, ensemble, evaluate, linear, scoring
from affinis.operators.relational import common_name_ids
from affinis.operators.skew import bounded_lookup
from affinis.plans import resolve
from affinis.plans.bindings import (
    SQL_MENTION, Tables, institution, listed, mention, query, sql_clean, sql_draw_int, sql_ngrams, sql_words,
)
from affinis.session import materialize, scratch_path
from affinis.streaming import resolve_stream

# Thresholds that make every branch of the ensemble occur on drawn scores.
BASIC_THRESH, LANG_THRESH = 0.9, 0.8

# ------------------------------------------------- institutions with rules --
SQL_INST = f"""inst0 AS (
  SELECT s_suppkey AS inst_id,
    CASE WHEN s_suppkey % 10 = 0 THEN 'Department of ' || r_name WHEN s_suppkey % 10 IN (1, 2) THEN 'Institute ' || r_name
      ELSE s_name END AS display_name,
    CASE WHEN s_suppkey % 4 = 3 THEN r_name ELSE s_name END AS city,
    CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN n_nationkey = 7 THEN 'China' ELSE n_name END AS country,
    [s_name, n_name, r_name || ' ' || n_name] AS other_names
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
inst_names AS (SELECT inst_id, unnest(list_append(list_transform(other_names, lambda x: {sql_clean('x')}),
  {sql_clean('display_name')})) AS n FROM inst0),
inst AS (SELECT i.*, f.final_names, count(*) OVER (PARTITION BY display_name) > 1 AS is_common,
    {sql_clean('display_name')} AS clean_display, {sql_clean('city')} AS clean_city
  FROM inst0 i JOIN (SELECT inst_id, list(n ORDER BY length(n) DESC, n) AS final_names FROM
    (SELECT DISTINCT inst_id, n FROM inst_names WHERE length(n) > 4
     AND n NOT IN ('UniversityHospital', 'Coastal', 'Brunswick', 'Continental')) GROUP BY 1) f USING (inst_id))"""


def rule_institutions(t: Tables) -> DataFrame:
    """Suppliers as institutions: some share names, some are departments, some have no country."""
    key = F.col("inst_id")
    base = institution(t)
    exact = F.transform(
        F.array("display_name", "country", F.concat_ws(" ", "region", "country")), lambda n: clean_match_text(n))
    shown = (
        F.when(key % 10 == 0, F.concat(F.lit("Department of "), "region"))
        .when((key % 10).isin(1, 2), F.concat(F.lit("Institute "), "region")).otherwise(F.col("display_name"))
    )
    named = base.withColumn("exact", exact).withColumn("shown", shown)
    return named.select(
        key, F.col("shown").alias("display_name"),
        F.when(key % 4 == 3, F.col("region")).otherwise(F.col("display_name")).alias("city"),
        F.when(key % 13 == 0, F.lit(None)).when(F.col("country") == "NATION_7", fixed.SECOND_COUNTRY)
        .otherwise(F.col("country")).alias("country"),
        dims.final_names(F.col("shown"), F.col("exact")).alias("final_names"),
        key.cast("string").alias("registry_id"),
    )


def institution_context(t: Tables) -> DataFrame:
    inst = rule_institutions(t)
    return ensemble.institution_context(inst, common_name_ids(inst, ["display_name"], "inst_id"))


def patterns(t: Tables) -> dict[str, list[str]]:
    """Nations as countries; one of them bears the name the ensemble has a rule for."""
    nation = F.col("n_name")
    country = F.when(nation == "NATION_7", fixed.SECOND_COUNTRY).otherwise(nation)
    table = t.nation.select(country.alias("country"), F.explode(F.array_distinct(F.array(nation, country))).alias("pattern"))
    return country_patterns(table)


def sql_countries(x: str) -> str:
    return f"""list_sort(list_distinct(list_transform(list_intersect(regexp_extract_all({x}, '\\w+'),
      (SELECT list_append(list(n_name), 'China') FROM nation)), lambda c: CASE c WHEN 'NATION_7' THEN 'China' ELSE c END)))"""


# --------------------------------------------- order texts, drawn scores --
SQL_ORDERS = f"""{SQL_INST},
line AS (SELECT DISTINCT l_orderkey AS text_id, l_suppkey AS inst_id FROM lineitem),
offered AS (SELECT * FROM line UNION SELECT text_id, inst_id + CASE WHEN inst_id % 2 = 0 THEN 1 ELSE -1 END FROM line),
texts0 AS (SELECT text_id, string_agg(
      CASE WHEN text_id % 7 = 0 THEN display_name ELSE display_name || ', ' || city || coalesce(', ' || country, '') END,
      '; ' ORDER BY inst_id)
    || CASE WHEN text_id % 7 = 0 THEN '' WHEN text_id % 5 = 0 THEN ', Natural Resource' WHEN text_id % 5 = 1 THEN ' University' ELSE '' END AS raw
  FROM line JOIN inst0 USING (inst_id) GROUP BY text_id),
texts AS (SELECT text_id, raw, {sql_clean('raw')} AS clean, {sql_clean('raw')} AS clean_stripped, {sql_countries('raw')} AS countries
  FROM texts0),
draws AS (SELECT text_id, CASE WHEN inst_id % 17 = 16 THEN -1 ELSE inst_id END AS inst_id,
    max({sql_draw_int(1, 'text_id', 'inst_id')} / 4294967296.0::DOUBLE) AS b0,
    max({sql_draw_int(2, 'text_id', 'inst_id')} / 4294967296.0::DOUBLE) AS l0
  FROM offered GROUP BY 1, 2),
scored AS (SELECT text_id, inst_id, round(b0, 5) AS b,
    CASE WHEN text_id % 2 = 0 THEN round(round(b0, 5) - 0.00001, 5) ELSE round(l0, 5) END AS l FROM draws),
score AS (
  SELECT text_id, 'basic' AS model, CAST(row_number() OVER (PARTITION BY text_id ORDER BY b DESC, inst_id) AS INTEGER) AS rank,
    inst_id, b AS score FROM scored QUALIFY rank <= 20
  UNION ALL
  SELECT text_id, 'lang', CAST(row_number() OVER (PARTITION BY text_id ORDER BY l DESC, inst_id) AS INTEGER) AS rank, inst_id, l FROM scored QUALIFY rank <= 20)"""


def order_lines(t: Tables) -> DataFrame:
    """The suppliers of every order, dealt by order: what groups or joins by ``text_id`` next moves no row again.

    The number of tasks is given, as the narrow lines grow into texts and candidates within their task.
    """
    lines = t.lineitem.select(F.col("l_orderkey").alias("text_id"), F.col("l_suppkey").alias("inst_id"))
    tasks = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(tasks, "text_id").distinct()


def order_texts(t: Tables) -> DataFrame:
    """One text per order that names the suppliers of all its lines; not stored, as its readers work where the lines are."""
    key = F.col("text_id")
    inst = rule_institutions(t).select("inst_id", "display_name", "city", "country")
    piece = F.when(key % 7 == 0, F.col("display_name")).otherwise(
        F.concat(F.concat_ws(", ", "display_name", "city"), F.coalesce(F.concat(F.lit(", "), "country"), F.lit(""))))
    tail = (
        F.when(key % 7 == 0, "").when(key % 5 == 0, ", Natural Resource").when(key % 5 == 1, " University").otherwise("")
    )
    rows = bounded_lookup(order_lines(t), inst, "inst_id", "inner", ["text_id"]).select("text_id", "inst_id", piece.alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("inst_id", "piece"))), lambda x: x["piece"])
    texts = rows.groupBy("text_id").agg(pieces.alias("p"))
    raw = texts.select("text_id", F.concat(F.array_join("p", "; "), tail).alias("raw"))
    return resolve.describe_texts(raw, patterns(t))


def order_scores(t: Tables) -> DataFrame:
    """Every supplier of an order, and its neighbour as a distractor, with a drawn score per scorer; every other text agrees.

    Rows of an order stay in the task that ``order_lines`` gave them.
    """
    beside = F.when(F.col("inst_id") % 2 == 0, F.col("inst_id") + 1).otherwise(F.col("inst_id") - 1)
    offered = order_lines(t).select("text_id", F.explode(F.array("inst_id", beside)).alias("inst_id")).distinct()
    none = F.when(F.col("inst_id") % 17 == 16, F.lit(-1).cast("bigint")).otherwise(F.col("inst_id"))
    drawn = offered.select(
        "text_id", none.alias("inst_id"), draw_unit(1, "text_id", "inst_id").alias("b0"),
        draw_unit(2, "text_id", "inst_id").alias("l0"))
    one = drawn.groupBy("text_id", "inst_id").agg(F.round(F.max("b0"), 5).alias("b"), F.round(F.max("l0"), 5).alias("l0"))
    lang = F.when(F.col("text_id") % 2 == 0, F.round(F.col("b") - 0.00001, 5)).otherwise(F.col("l0"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("score")) for m, c in (("basic", F.col("b")), ("lang", lang))])
    scores = one.select("text_id", "inst_id", F.explode(models).alias("m")).select("text_id", "inst_id", "m.model", "m.score")
    return scoring.topk_candidates(scores, key=["text_id", "model"]).select("text_id", "model", "rank", "inst_id", "score")


def order_candidates(t: Tables) -> DataFrame:
    """Candidates with their context, for the one reader that a query has; they are not stored, as each carries its whole text."""
    return ensemble.candidate_context(order_scores(t), order_texts(t), institution_context(t))


# ------------------------------------------------------- the rules in SQL --
def sql_rules(basic: float, lang: float) -> str:
    """Rules over ``score``, ``texts`` and ``inst``, written as plain set queries."""
    def pick(m: str) -> str:
        return f"""{m}_agg AS (SELECT text_id, min(rank) AS top_rank,
    min(rank) FILTER (country <> '' AND list_contains(countries, country)) AS fit_rank,
    arg_min(coalesce(country, ''), rank) <> '' AND any_value(len(countries)) > 0 AS use_fit
  FROM score s JOIN texts USING (text_id) LEFT JOIN inst USING (inst_id) WHERE s.model = '{m}' AND s.inst_id <> -1 GROUP BY 1),
{m}_pick AS (SELECT a.text_id, s.rank, s.inst_id, s.score FROM {m}_agg a JOIN score s ON s.text_id = a.text_id AND s.model = '{m}'
    AND s.rank = CASE WHEN use_fit AND fit_rank IS NOT NULL THEN fit_rank ELSE top_rank END)"""
    return f"""{pick('basic')},
{pick('lang')},
pick AS (SELECT t.text_id,
    CASE WHEN b.inst_id = l.inst_id THEN l.inst_id WHEN b.score > {basic} THEN b.inst_id WHEN l.score > {lang} THEN l.inst_id
      WHEN b.score > 0.01 AND list_contains(countries, 'China') AND contains(raw, 'Natural Resource') THEN b.inst_id ELSE -1 END AS inst_id,
    CASE WHEN b.inst_id = l.inst_id THEN l.score WHEN b.score > {basic} THEN b.score WHEN l.score > {lang} THEN l.score
      WHEN b.score > 0.01 AND list_contains(countries, 'China') AND contains(raw, 'Natural Resource') THEN b.score ELSE 0.0 END AS score,
    CASE WHEN b.inst_id = l.inst_id THEN 'model_match' WHEN b.score > {basic} THEN 'basic_thresh' WHEN l.score > {lang} THEN 'lang_thresh'
      WHEN b.score > 0.01 AND list_contains(countries, 'China') AND contains(raw, 'Natural Resource') THEN 'basic_thresh_second'
      ELSE 'nothing' END AS category
  FROM texts t LEFT JOIN basic_pick b ON b.text_id = t.text_id LEFT JOIN lang_pick l ON l.text_id = t.text_id),
cand AS (SELECT DISTINCT s.text_id, s.inst_id FROM score s JOIN texts USING (text_id) WHERE s.inst_id <> -1),
matched AS (SELECT c.text_id, c.inst_id, list_filter(i.final_names, lambda n: contains(t.clean, n))[1] AS name
  FROM cand c JOIN texts t USING (text_id) JOIN pick p USING (text_id) JOIN inst i ON i.inst_id = c.inst_id
  WHERE c.inst_id <> p.inst_id AND (coalesce(i.country, '') = '' OR (len(t.countries) = 0 AND NOT i.is_common)
    OR list_contains(t.countries, i.country))),
hit AS (SELECT * FROM matched WHERE name IS NOT NULL),
kept AS (SELECT h.* FROM hit h
  WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.text_id = h.text_id AND contains(o.name, h.name) AND o.name <> h.name)
  AND NOT EXISTS (SELECT 1 FROM pick p JOIN (SELECT inst_id, unnest(final_names) AS n FROM inst) i ON i.inst_id = p.inst_id
    WHERE p.text_id = h.text_id AND contains(i.n, h.name))),
pred AS (SELECT text_id, inst_id, 0 AS pos, score, category FROM pick WHERE category <> 'nothing'
  UNION ALL SELECT text_id, inst_id, 1, 0.95, 'string_match' FROM kept),
named AS (SELECT p.*, i.display_name, i.city, i.country, i.is_common, i.clean_display,
    contains(t.clean, i.clean_city) AS city_hit, t.raw, t.clean_stripped,
    coalesce(list_contains(t.countries, i.country), false) AS country_hit
  FROM pred p JOIN inst i USING (inst_id) JOIN texts t USING (text_id)),
pred2 AS (SELECT * FROM named QUALIFY count(*) OVER (PARTITION BY text_id, display_name) = 1
  OR CASE WHEN bool_or(city_hit) OVER (PARTITION BY text_id, display_name) THEN city_hit
     ELSE row_number() OVER (PARTITION BY text_id, display_name ORDER BY pos, inst_id) = 1 END),
checked AS (SELECT *, country_hit AND contains(raw, city) AS place_hit, contains(clean_stripped, clean_display) AS name_hit,
    starts_with(display_name, 'Department of') AS dept, contains(raw, 'College') OR contains(raw, 'University') AS academic,
    count(*) OVER (PARTITION BY text_id) AS n, count(*) FILTER (NOT is_common) OVER (PARTITION BY text_id) AS n_plain FROM pred2),
flagged AS (SELECT *, (dept OR starts_with(display_name, 'Department for')) AND NOT (name_hit AND place_hit) AS by_department,
    is_common AND CASE WHEN n = 1 THEN clean_display = clean_stripped OR (dept AND (academic OR NOT name_hit))
      WHEN n_plain > 0 THEN CASE WHEN dept THEN academic OR NOT name_hit OR NOT place_hit ELSE NOT country_hit END
      ELSE false END AS by_common FROM checked),
final AS (SELECT text_id, string_agg(inst_id || ':' || printf('%.6f', score) || ':' || category, '|' ORDER BY pos, inst_id) AS predictions
  FROM flagged WHERE NOT by_department AND NOT by_common GROUP BY 1)"""


SQL_CHAIN = f"{SQL_ORDERS},\n{sql_rules(BASIC_THRESH, LANG_THRESH)}"


def shown(predictions: Column) -> Column:
    """Prediction list as text."""
    return F.array_join(F.transform(predictions, lambda p: F.concat_ws(
        ":", p["inst_id"].cast("string"), F.format_string("%.6f", p["score"]), p["category"])), "|")


def picked_orders(t: Tables) -> DataFrame:
    return ensemble.pick_candidates(order_candidates(t), LANG_THRESH, BASIC_THRESH)


# ================================================================= scorers ==
def sql_index(model: str, corpus: str = "mention") -> str:
    terms = sql_words if model == "basic" else sql_ngrams
    m = model
    return f"""{m}_tf AS (SELECT inst_id, term, count(*) AS tf FROM
    (SELECT inst_id, unnest({terms('affiliation_string')}) AS term FROM {corpus}) GROUP BY 1, 2),
{m}_n AS (SELECT count(DISTINCT inst_id) AS n FROM {corpus}),
{m}_df AS (SELECT term, count(*) AS df, round(ln((SELECT n FROM {m}_n)::DOUBLE / count(*)), 6) AS idf FROM {m}_tf GROUP BY 1
  HAVING count(*) < (SELECT n FROM {m}_n)),
{m}_w AS (SELECT inst_id, term, df, idf, (1 + ln(tf)) * idf AS raw FROM {m}_tf JOIN {m}_df USING (term)),
{m}_index AS (SELECT term, inst_id, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY inst_id)), 6) AS weight, idf, df FROM {m}_w)"""


def sql_cosine(model: str, texts: str) -> str:
    """``texts(text_id, txt)`` against the index of one scorer."""
    terms = sql_words if model == "basic" else sql_ngrams
    m = model
    return f"""{m}_terms AS (SELECT text_id, unnest({terms('txt')}) AS term FROM {texts}),
{m}_sums AS (SELECT text_id, inst_id, sum(weight * idf) AS p, sum(idf * idf / df) AS q FROM {m}_terms JOIN {m}_index USING (term) GROUP BY 1, 2),
{m}_cos AS (SELECT text_id, inst_id, round(p / sqrt(sum(q) OVER (PARTITION BY text_id)), 6) AS cos FROM {m}_sums)"""


def sql_shares(model: str) -> str:
    m = model
    return f"""{m}_top AS (SELECT *, CAST(row_number() OVER (PARTITION BY text_id ORDER BY cos DESC, inst_id) AS INTEGER) AS rank
  FROM {m}_cos QUALIFY rank <= 20),
{m}_e AS (SELECT *, exp(20.0::DOUBLE * (cos - max(cos) OVER (PARTITION BY text_id))) AS e FROM {m}_top),
{m}_score AS (SELECT text_id, '{m}' AS model, rank, inst_id, round(e / sum(e) OVER (PARTITION BY text_id), 6) AS score FROM {m}_e)"""


SQL_SUPPLIER_TEXT = """texts AS (SELECT min(mention_id) AS text_id, affiliation_string AS txt FROM mention GROUP BY 2)"""


def mention_texts(t: Tables) -> DataFrame:
    return mention(t).groupBy(F.col("affiliation_string").alias("text")).agg(F.min("mention_id").alias("text_id"))


def fitted(t: Tables, model: str) -> DataFrame:
    return materialize(scoring.fit_score_index(mention(t), model, "inst_id", "affiliation_string"), "index")


@query(f"WITH {SQL_MENTION}, {sql_index('basic')}, {sql_index('lang')} "
       "SELECT 'basic' AS model, * FROM basic_index UNION ALL SELECT 'lang', * FROM lang_index")
def fit_score_index(t: Tables):
    frames = [
        scoring.fit_score_index(mention(t), m, "inst_id", "affiliation_string").select(F.lit(m).alias("model"), "*")
        for m in ("basic", "lang")
    ]
    return frames[0].unionByName(frames[1])


@query(f"WITH {SQL_MENTION}, {SQL_SUPPLIER_TEXT}, {sql_index('basic')}, {sql_cosine('basic', 'texts')}, {sql_shares('basic')} "
       "SELECT * FROM basic_score")
def score_token(t: Tables):
    return scoring.score_texts(mention_texts(t), fitted(t, "basic"), "basic")


@query(f"WITH {SQL_MENTION}, {SQL_SUPPLIER_TEXT}, {sql_index('lang')}, {sql_cosine('lang', 'texts')}, {sql_shares('lang')} "
       "SELECT * FROM lang_score")
def score_ngram(t: Tables):
    return scoring.score_texts(mention_texts(t), fitted(t, "lang"), "lang")


@query(f"""WITH {SQL_MENTION}, {SQL_SUPPLIER_TEXT}, {sql_index('basic')}, {sql_cosine('basic', 'texts')}
SELECT text_id, inst_id, cos AS score, CAST(row_number() OVER (PARTITION BY text_id ORDER BY cos DESC, inst_id) AS INTEGER) AS rank
FROM basic_cos QUALIFY rank <= 20""")
def topk_candidates(t: Tables):
    return scoring.topk_candidates(scoring.term_scores(mention_texts(t), fitted(t, "basic"), "basic"))


@query(f"""WITH {SQL_MENTION}, {SQL_SUPPLIER_TEXT},
seen AS (SELECT inst_id, unnest({sql_words('affiliation_string')}) AS term FROM mention),
counts AS (SELECT inst_id, term, count(*) AS n FROM seen GROUP BY ALL),
classes AS (SELECT inst_id, sum(n) AS words FROM counts GROUP BY 1),
docs AS (SELECT inst_id, ln(count(*) + 1.0::DOUBLE) - ln((SELECT count(*) FROM mention) + (SELECT count(*) FROM classes)::DOUBLE) AS prior FROM mention GROUP BY 1),
size AS (SELECT count(DISTINCT term) AS v FROM counts),
term_of AS (SELECT text_id, unnest({sql_words('txt')}) AS term FROM texts),
terms AS (SELECT text_id, count(*) AS k FROM term_of GROUP BY 1),
gain AS (SELECT text_id, inst_id, sum(ln(n + 1.0::DOUBLE)) AS g FROM term_of JOIN counts USING (term) GROUP BY 1, 2),
logp AS (SELECT t.text_id, c.inst_id, prior + coalesce(g, 0) - k * ln(words + v::DOUBLE) AS l
  FROM terms t, classes c JOIN docs USING (inst_id), size LEFT JOIN gain g ON g.text_id = t.text_id AND g.inst_id = c.inst_id),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY text_id)) AS e FROM logp),
p AS (SELECT text_id, inst_id, round(e / sum(e) OVER (PARTITION BY text_id), 6) AS score FROM e)
SELECT text_id, 'external' AS model, CAST(row_number() OVER (PARTITION BY text_id ORDER BY score DESC, inst_id) AS INTEGER) AS rank, inst_id, score
FROM p QUALIFY rank <= 20""")
def score_external(t: Tables):
    """A naive Bayes classifier fitted on the labelled strings, stored, and applied as a model of one's own."""
    folder = bayes.fit(mention(t).select("inst_id", index_words(F.col("affiliation_string")).alias("words")))
    texts = mention_texts(t).select("text_id", index_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    texts = bayes.together(texts, folder)
    return scoring.score_external(texts, bayes.predictor(folder)(bayes.asked(F.col("words"))), "external")


@query(None)
def score_linear(t: Tables):
    """Logistic regression learned from all labelled strings in rounds, stored, and applied to every distinct string."""
    folder = linear.fit(mention(t).select("inst_id", index_words(F.col("affiliation_string")).alias("words")))
    texts = mention_texts(t).select("text_id", index_words(F.col("text")).alias("words"))
    return scoring.score_external(texts, linear.predictor(folder, 2)(linear.asked(F.col("words"))), "linear", 2)


# ========================================================== gate and rules ==
SQL_GATE_MENTION = f"""{SQL_MENTION},
gate_mention AS (SELECT mention_id, inst_id, CASE kind
    WHEN 0 THEN split_part(affiliation_string, ', ', 3) WHEN 1 THEN 'red bolt' WHEN 2 THEN 'Dep ' || split_part(affiliation_string, ', ', 1)
    WHEN 3 THEN 'ZHANG, ' || affiliation_string WHEN 4 THEN affiliation_string || ' et al ' WHEN 5 THEN 'LIU University, ' || affiliation_string
    WHEN 6 THEN NULL WHEN 7 THEN '- -' WHEN 8 THEN '中文大学' || inst_id WHEN 9 THEN 'Университет ' || inst_id
    WHEN 10 THEN '  Physics' ELSE affiliation_string END AS affiliation_string FROM mention),
texts0 AS (SELECT affiliation_string AS raw, min(mention_id) AS text_id FROM gate_mention
  WHERE length(affiliation_string) > 2 GROUP BY 1),
places AS (SELECT DISTINCT {sql_clean('n', armed_forces=False)} AS clean_place FROM (
  SELECT unnest([s_name || r_name, s_name || n_name || r_name, n_name || r_name, r_name, n_name]) AS n
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
departments AS (SELECT p_name AS term FROM part UNION SELECT unnest([{', '.join("'" + d + "'" for d in fixed.DEPARTMENTS)}])),
texts1 AS (SELECT text_id, raw, {sql_clean('raw')} AS clean, {sql_clean("trim(raw)")} AS clean_stripped, {sql_countries('raw')} AS countries,
  len(string_split(raw, ',')) AS n_parts,
  CASE WHEN regexp_matches(raw, '\\p{{Han}}') THEN 'zh-cn' WHEN regexp_matches(raw, '\\p{{Cyrillic}}') THEN 'ru' ELSE 'en' END AS lang
  FROM texts0),
gated AS (SELECT *, CASE WHEN lang IN ('zh-cn', 'ru') THEN false WHEN length(clean) <= 2 THEN false
  WHEN regexp_matches(raw, '^(Dep|School|Ministry)') AND n_parts < 2 AND len(countries) = 0 THEN false
  WHEN raw IN (SELECT term FROM departments) THEN false WHEN clean_stripped IN (SELECT clean_place FROM places) THEN false
  WHEN regexp_matches(raw, '\\b(LIANG|YANG|LIU|XIE|JIA|ZHANG)\\b') THEN
    regexp_matches(raw, 'Hospital|University|School|Academy|Institute|Ministry|Laboratory|College')
  WHEN regexp_matches(raw, '\\bet al\\b') THEN NOT ends_with(trim(raw), 'et al') ELSE true END AS gate FROM texts1)"""


def gate_mentions(t: Tables) -> DataFrame:
    """Mentions of which most kinds the gate knows occur."""
    kind, text = F.col("kind"), F.col("affiliation_string")
    changed = (
        F.when(kind == 0, F.split(text, ", ")[2]).when(kind == 1, "red bolt")
        .when(kind == 2, F.concat(F.lit("Dep "), F.split(text, ", ")[0]))
        .when(kind == 3, F.concat(F.lit("ZHANG, "), text)).when(kind == 4, F.concat(text, F.lit(" et al ")))
        .when(kind == 5, F.concat(F.lit("LIU University, "), text)).when(kind == 6, F.lit(None)).when(kind == 7, "- -")
        .when(kind == 8, F.concat(F.lit("中文大学"), "inst_id")).when(kind == 9, F.concat(F.lit("Университет "), "inst_id"))
        .when(kind == 10, "  Physics").otherwise(text)
    )
    return mention(t).select("mention_id", "inst_id", changed.alias("affiliation_string"))


def gate_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    places = dims.place_list(institution(t).select(
        F.col("display_name").alias("city"), F.col("country").alias("state"), F.col("region").alias("country")))
    return dims.department_terms(t.part.select(F.col("p_name").alias("term"))), places


@query(f"WITH {SQL_GATE_MENTION} SELECT text_id, raw, lang, array_to_string(countries, '|') AS countries, gate FROM gated")
def initial_gate(t: Tables):
    gated = resolve.gated_texts(gate_mentions(t), patterns(t), *gate_tables(t))
    return gated.select("text_id", "raw", "lang", listed("countries").alias("countries"), "gate")


@query(f"""WITH {SQL_CHAIN} SELECT 'basic' AS model, p.text_id, p.inst_id, p.score FROM basic_pick p JOIN texts USING (text_id)
UNION ALL SELECT 'lang', p.text_id, p.inst_id, p.score FROM lang_pick p JOIN texts USING (text_id)""")
def country_rerank(t: Tables):
    candidates = order_candidates(t)
    ranked = ensemble.country_rerank(ensemble.country_rerank(candidates, "basic"), "lang")
    picks = ranked.select("text_id", F.explode(F.array(
        F.struct(F.lit("basic").alias("model"), F.col("basic_pick").alias("p")),
        F.struct(F.lit("lang").alias("model"), F.col("lang_pick").alias("p")))).alias("x"))
    return picks.select("x.model", "text_id", "x.p.inst_id", "x.p.score").distinct()


@query(f"WITH {SQL_CHAIN} SELECT text_id, pick.inst_id, score, category FROM pick JOIN (SELECT DISTINCT text_id FROM cand) USING (text_id)")
def combine_scorers(t: Tables):
    return picked_orders(t).select("text_id", "pick.inst_id", "pick.score", "pick.category").distinct()


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, name FROM hit")
def match_names(t: Tables):
    return ensemble.match_names(picked_orders(t)).filter("name is not null").select("text_id", "inst_id", "name")


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, name FROM kept")
def suppress_substrings(t: Tables):
    kept = ensemble.suppress_substrings(ensemble.match_names(picked_orders(t)))
    return kept.filter("name is not null").select("text_id", "inst_id", "name")


def order_predictions(t: Tables) -> DataFrame:
    return ensemble.merge_predictions(ensemble.suppress_substrings(ensemble.match_names(picked_orders(t))))


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, CAST(pos AS INTEGER) AS pos, CAST(score AS DOUBLE) AS score, category FROM pred")
def merge_predictions(t: Tables):
    return order_predictions(t).select("text_id", "inst_id", "pos", "score", "category")


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, display_name FROM pred2")
def resolve_same_name(t: Tables):
    return ensemble.resolve_same_name(order_predictions(t)).select("text_id", "inst_id", "display_name")


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, place_hit FROM checked")
def city_country_check(t: Tables):
    rows = ensemble.resolve_same_name(order_predictions(t))
    return rows.select("text_id", "inst_id", ensemble.city_country_check().alias("place_hit"))


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, by_department FROM flagged")
def department_check(t: Tables):
    rows = ensemble.resolve_same_name(order_predictions(t))
    return rows.select("text_id", "inst_id", ensemble.department_check().alias("by_department"))


@query(f"WITH {SQL_CHAIN} SELECT text_id, inst_id, by_common FROM flagged")
def common_name_check(t: Tables):
    rows = ensemble.resolve_same_name(order_predictions(t))
    return rows.select("text_id", "inst_id", ensemble.common_name_check().alias("by_common"))


@query(f"""WITH {SQL_CHAIN}, remapped AS (SELECT *, CASE WHEN inst_id % 11 = 0 THEN inst_id + 1 ELSE inst_id END AS new_id FROM flagged),
done AS (SELECT text_id, string_agg(new_id || ':' || printf('%.6f', score) || ':' || category, '|' ORDER BY pos, inst_id) AS predictions
  FROM remapped WHERE NOT by_department AND NOT by_common GROUP BY 1)
SELECT text_id, coalesce(predictions, '-1:0.000000:nothing') AS predictions FROM texts LEFT JOIN done USING (text_id)""")
def finalize_predictions(t: Tables):
    flagged = ensemble.flag_removals(ensemble.resolve_same_name(order_predictions(t)))
    merged = t.supplier.filter("s_suppkey % 11 = 0").select(
        F.col("s_suppkey").alias("old_id"), (F.col("s_suppkey") + 1).alias("new_id"))
    done = ensemble.finalize_predictions(order_texts(t), flagged, merged)
    return done.select("text_id", shown(F.col("predictions")).alias("predictions"))


# ======================================================== whole resolution ==
SQL_RESOLVE = f"""{SQL_GATE_MENTION}, {SQL_INST},
texts AS (SELECT text_id, raw AS txt, raw, clean, clean_stripped, countries FROM gated WHERE gate),
{sql_index('basic')}, {sql_index('lang')}, {sql_cosine('basic', 'texts')}, {sql_cosine('lang', 'texts')},
{sql_shares('basic')}, {sql_shares('lang')},
score AS (SELECT * FROM basic_score UNION ALL SELECT * FROM lang_score),
{sql_rules(0.99, 0.99)}"""


def resolve_mentions(t: Tables, mentions: DataFrame) -> DataFrame:
    indexes = {m: fitted(t, m) for m in ("basic", "lang")}
    inst = rule_institutions(t)
    departments, places = gate_tables(t)
    return resolve.resolve_affiliations(
        mentions.select("mention_id", "affiliation_string"), inst, common_name_ids(inst, ["display_name"], "inst_id"),
        resolve.index_scorer(indexes), patterns(t), departments, places)


SQL_RESOLVED = f"""WITH {SQL_RESOLVE} SELECT m.mention_id, m.affiliation_string, coalesce(predictions, '-1:0.000000:nothing') AS predictions
FROM gate_mention m LEFT JOIN gated g ON g.raw = m.affiliation_string LEFT JOIN final f ON f.text_id = g.text_id"""


@query(SQL_RESOLVED)
def resolve_affiliations(t: Tables):
    out = resolve_mentions(t, gate_mentions(t))
    return out.select("mention_id", "affiliation_string", shown(F.col("predictions")).alias("predictions"))


# ============================================================== evaluation ==
SQL_EVAL = f"""{SQL_CHAIN},
items AS (SELECT t.text_id, coalesce(f.inst_id, -1) AS inst_id, coalesce(f.pos, 0) AS pos, coalesce(f.category, 'nothing') AS category
  FROM texts t LEFT JOIN (SELECT * FROM flagged WHERE NOT by_department AND NOT by_common) f USING (text_id)),
preds_all AS (SELECT text_id, list(inst_id ORDER BY pos, inst_id) AS preds FROM items GROUP BY 1),
preds_model AS (SELECT text_id, coalesce(list(inst_id ORDER BY pos, inst_id) FILTER (category <> 'string_match'), [-1]) AS preds FROM items GROUP BY 1),
gold AS (SELECT text_id, CASE WHEN text_id % 9 = 0 THEN [-1] ELSE list(inst_id ORDER BY inst_id) END AS labels,
  CASE text_id % 3 WHEN 0 THEN 'gold_easy' WHEN 1 THEN 'gold_hard' ELSE 'gold_random' END AS dataset
  FROM line GROUP BY text_id),
counts AS (SELECT v.variant, g.text_id, g.dataset,
  CASE WHEN labels[1] = -1 OR preds[1] = -1 THEN 0 ELSE len(list_filter(preds, lambda p: list_contains(labels, p))) END AS tp,
  CASE WHEN labels[1] = -1 AND preds[1] <> -1 THEN len(preds) WHEN labels[1] = -1 OR preds[1] = -1 THEN 0
    ELSE len(list_filter(preds, lambda p: NOT list_contains(labels, p))) END AS fp,
  CASE WHEN labels[1] = -1 AND preds[1] = -1 THEN 1::BIGINT ELSE 0 END AS tn,
  CASE WHEN labels[1] = -1 THEN 0 WHEN preds[1] = -1 THEN len(labels) ELSE len(list_filter(labels, lambda p: NOT list_contains(preds, p))) END AS fn
  FROM gold g JOIN (SELECT 'all' AS variant, * FROM preds_all UNION ALL SELECT 'model', * FROM preds_model) v USING (text_id))"""


def order_results(t: Tables) -> DataFrame:
    """Final predictions per order text next to its labels."""
    texts = order_texts(t)
    flagged = ensemble.flag_removals(ensemble.resolve_same_name(order_predictions(t)))
    results = ensemble.finalize_predictions(texts, flagged)
    key = F.col("text_id")
    gold = order_lines(t).groupBy("text_id").agg(F.array_sort(F.collect_list("inst_id")).alias("l"))
    labels = F.when(key % 9 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.col("l"))
    dataset = F.when(key % 3 == 0, "gold_easy").when(key % 3 == 1, "gold_hard").otherwise("gold_random")
    return gold.select("text_id", labels.alias("labels"), dataset.alias("dataset")).join(results, "text_id")


@query(f"""WITH {SQL_EVAL} SELECT text_id, array_to_string(a.preds, '|') AS preds_all, array_to_string(m.preds, '|') AS preds_model
FROM preds_all a JOIN preds_model m USING (text_id)""")
def split_predictions(t: Tables):
    rows = evaluate.split_predictions(order_results(t))
    return rows.select("text_id", listed("preds_all").alias("preds_all"), listed("preds_model").alias("preds_model"))


@query("""SELECT l_orderkey AS row_id, string_agg(coalesce(i || ' - ' || s_name, '-1 - None'), '|' ORDER BY i, s_name) AS names FROM (
  SELECT l_orderkey, l_suppkey AS i, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey + 3 = l_suppkey) GROUP BY 1""")
def display_names(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("ids"))
    names = t.supplier.select((F.col("s_suppkey") + 3).alias("inst_id"), F.col("s_name").alias("display_name"))
    return evaluate.display_names(rows, "ids", names, "row_id", "names").withColumn("names", listed("names"))


@query(f"WITH {SQL_EVAL} SELECT text_id, tp, fp, tn, fn FROM counts WHERE variant = 'all'")
def confusion_counts(t: Tables):
    rows = evaluate.split_predictions(order_results(t))
    counted = rows.select("text_id", evaluate.confusion_counts(F.col("labels"), F.col("preds_all")).alias("c"))
    return counted.select("text_id", "c.*")


@query(f"""WITH {SQL_EVAL} SELECT text_id, CAST(fp > 0 AS INTEGER) AS has_fp, CAST(fn > 0 AS INTEGER) AS has_fn, tp, fp, tn, fn
FROM counts WHERE variant = 'all'""")
def error_flags(t: Tables):
    rows = evaluate.split_predictions(order_results(t))
    counted = rows.withColumn("counts", evaluate.confusion_counts(F.col("labels"), F.col("preds_all")))
    return evaluate.error_flags(counted).select("text_id", "has_fp", "has_fn", "tp", "fp", "tn", "fn")


@query(f"""WITH {SQL_EVAL} SELECT variant, coalesce(dataset, 'any') AS dataset, round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0), 3) AS precision,
  round(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0), 3) AS recall FROM counts GROUP BY GROUPING SETS ((variant, dataset), (variant))""")
def precision_recall(t: Tables):
    rows = materialize(evaluate.split_predictions(order_results(t)).select("text_id", "dataset", "labels", "preds_all", "preds_model"), "eval")
    frames = []
    for variant, col in (("all", "preds_all"), ("model", "preds_model")):
        counted = rows.select("dataset", evaluate.confusion_counts(F.col("labels"), F.col(col)).alias("c")).select("dataset", "c.*")
        per_set = evaluate.precision_recall(counted, ["dataset"])
        overall = evaluate.precision_recall(counted).select(F.lit("any").alias("dataset"), "precision", "recall")
        frames.append(per_set.unionByName(overall).select(F.lit(variant).alias("variant"), "*"))
    return frames[0].unionByName(frames[1])


def sql_side(m: str) -> str:
    return f"""max(CASE WHEN model = '{m}' THEN CAST(inst_id AS VARCHAR) END) AS {m}_pred,
  max(CASE WHEN model = '{m}' THEN round(score, 5) END) AS {m}_score,
  max(CASE WHEN model = '{m}' THEN CASE WHEN display_name IS NULL THEN '' ELSE CAST(inst_id AS VARCHAR) END END) AS {m}_registry_id,
  max(CASE WHEN model = '{m}' THEN coalesce(display_name, '') END) AS {m}_display_name,
  max(CASE WHEN model = '{m}' THEN coalesce(city, '') END) AS {m}_city, max(CASE WHEN model = '{m}' THEN coalesce(country, '') END) AS {m}_country"""


@query(f"WITH {SQL_ORDERS} SELECT text_id, rank, {sql_side('basic')}, {sql_side('lang')} FROM score LEFT JOIN inst0 USING (inst_id) GROUP BY 1, 2")
def scorer_preview(t: Tables):
    return evaluate.scorer_preview(order_scores(t), rule_institutions(t))


# ================================================================== stream ==
@query(SQL_RESOLVED)
def stream_resolve(t: Tables):
    """Mentions as JSON files through the stream; the result equals the batch result."""
    root = scratch_path(t.spark, "stream")
    gate_mentions(t).select("mention_id", "affiliation_string").write.json(f"{root}/in", ignoreNullFields=False)
    indexes = {m: fitted(t, m) for m in ("basic", "lang")}
    inst = materialize(rule_institutions(t), "inst")
    common = materialize(common_name_ids(inst, ["display_name"], "inst_id"), "common")
    departments, places = (materialize(d, "terms") for d in gate_tables(t))
    nations = patterns(t)

    def run(batch: DataFrame) -> DataFrame:
        return resolve.resolve_affiliations(
            batch, inst, common, resolve.index_scorer(indexes), nations, departments, places)

    resolve_stream.stream_resolve(t.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", run, memory=f"{root}/known").awaitTermination()
    out = resolve_stream.read_resolved(t.spark, f"{root}/out")
    return out.select("mention_id", "affiliation_string", shown(F.col("predictions")).alias("predictions"))
