"""Queries for sources, sinks, projections, joins, aggregates, windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis import fixed_values as fixed
from affinis.functions import text
from affinis.operators import balance, dims, features, relational as rel, synth
from affinis.plans.bindings import (
    Tables, institution, listed, nation_region, query, sql_clean, sql_draw, sql_draw_int, sql_fold,
)
from affinis.session import scratch_path
from affinis.sources import readers, record_shards, writers

PROPS = T.StructType([T.StructField("k", T.LongType())])


# ================================================================ sources ==
@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_parquet(t: Tables):
    return readers.read_table(t.spark, f"{t.path}/supplier.parquet")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def scan_columns(t: Tables):
    return readers.read_table(t.spark, f"{t.path}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def scan_registry_json(t: Tables):
    """Records written as JSON arrays of about a thousand each, read back by byte ranges."""
    path, arrays = scratch_path(t.spark, "registry-arrays"), -(-t.events.count() // 1000)
    record = F.to_json(F.struct("event_id", F.from_json("props", PROPS).alias("props")))
    array = F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n "), F.lit("]")).alias("value")
    t.events.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(max(1, arrays)))).agg(array).select("value").write.text(path)
    rows = readers.read_json_array(t.spark, path, T.StructType([t.events.schema["event_id"], T.StructField("props", PROPS)]))
    return rows.select("event_id", F.col("props.k").alias("k"))


@query("SELECT DISTINCT unnest(string_split(text, chr(10))) AS term FROM documents")
def scan_term_list(t: Tables):
    return readers.terms_from_text(t.documents, "text")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_delimited(t: Tables):
    path = scratch_path(t.spark, "nation-tsv")
    t.nation.write.csv(path, sep="\t", header=True)
    return readers.read_delimited(t.spark, path, t.nation.schema, ["n_nationkey", "n_name"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 3 = 1 THEN c_name END AS affiliation_string FROM customer""")
def scan_request_json(t: Tables):
    # a third of the records hold a number, a third a text, a third a null
    record = (
        F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.struct(F.col("c_custkey").alias("affiliation_string"))))
        .when(F.col("c_custkey") % 3 == 1, F.to_json(F.struct(F.col("c_name").alias("affiliation_string"))))
        .otherwise('{"affiliation_string":null}')
    )
    return t.customer.select("c_custkey", readers.request_from_json(record).alias("affiliation_string"))


# ================================================================== sinks ==
@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sink_parquet(t: Tables):
    path = scratch_path(t.spark, "orders")
    writers.write_table(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return t.spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def sink_parquet_overwrite(t: Tables):
    path = scratch_path(t.spark, "orders")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    writers.write_table(rows.drop("o_orderstatus"), path)
    writers.write_table(rows.filter("o_orderstatus = 'F'").drop("o_orderstatus"), path, overwrite=True,
                        rows_per_file=5_000_000)
    return t.spark.read.parquet(path)


@query(r"SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS line, count(*) AS n FROM documents GROUP BY 1")
def sink_text_corpus(t: Tables):
    path = scratch_path(t.spark, "corpus")
    writers.write_text_corpus(t.documents, "text", path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINE_SPLIT = f"""split AS (
  SELECT {', '.join(LINE_KEY)}, {sql_draw(1, *LINE_KEY)} AS h,
         CASE WHEN {sql_draw_int(1, *LINE_KEY)} / 4294967296.0 < 0.985 THEN 'train' ELSE 'val' END AS split
  FROM lineitem),
indexed AS (
  SELECT {', '.join(LINE_KEY)}, split,
         row_number() OVER (PARTITION BY split ORDER BY h, {', '.join(LINE_KEY)}) - 1 AS idx
  FROM split)"""


def line_shards(t: Tables, rows_per_shard: int = 1000):
    rows = balance.train_val_split(t.lineitem.select(*LINE_KEY), LINE_KEY)
    return features.shard_rows(rows, LINE_KEY, rows_per_shard, within=["split"])


@query(f"""WITH {SQL_LINE_SPLIT}
SELECT split, CAST(idx // 1000 AS INTEGER) AS shard, count(*) AS n, min(idx) AS first_idx,
       CAST(sum(l_partkey) AS BIGINT) AS part_sum
FROM indexed GROUP BY 1, 2""")
def sink_shards(t: Tables):
    path = scratch_path(t.spark, "shards")
    writers.write_shards(line_shards(t), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("split", F.col("shard").cast("int").alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.sum("l_partkey").alias("part_sum")
    )


@query(f"""WITH {SQL_LINE_SPLIT}
SELECT split || '/' || (idx // 1000) AS shard, idx, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS features FROM indexed""")
def sink_record_shards(t: Tables):
    """Shards of binary records, written and read back."""
    path = scratch_path(t.spark, "records")
    shard = F.concat_ws("/", "split", F.col("shard").cast("int"))
    rows = line_shards(t).select(shard.alias("shard"), "idx", F.array(*[F.col(c).cast("bigint") for c in LINE_KEY]).alias("features"))
    record_shards.write_records(rows, path)
    back = record_shards.read_shards(t.spark, path, "shard string, idx bigint, features array<bigint>")
    return back.select("shard", "idx", listed("features").alias("features"))


@query(f"""WITH {SQL_LINE_SPLIT}
SELECT split, idx // 512 AS batch, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS part_sum
FROM indexed GROUP BY 1, 2 HAVING count(*) = 512""")
def read_shards_batched(t: Tables):
    path = scratch_path(t.spark, "shards")
    writers.write_shards(line_shards(t), path)
    batches = features.full_batches(t.spark.read.parquet(path), within=["split"])
    return batches.groupBy("split", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("part_sum")
    )


def order_parts(t: Tables):
    """Part keys per order as prediction lists (an order holds at most seven lines per line number)."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.array_sort(F.collect_list("l_partkey")).alias("ids")
    )


@query("""SELECT l_orderkey AS row_id, '[' || string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) || ']' AS ids
FROM lineitem GROUP BY 1""")
def sink_csv_results(t: Tables):
    path = scratch_path(t.spark, "results")
    writers.write_csv_results(order_parts(t), path)
    return t.spark.read.schema("row_id bigint, ids string").csv(path, header=True, escape='"')


@query("""WITH p AS (SELECT '{"affiliation_id":[' || string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)
  || ']}' AS record FROM lineitem GROUP BY l_orderkey)
SELECT record, count(*) AS n FROM p GROUP BY 1""")
def sink_json_predictions(t: Tables):
    path = scratch_path(t.spark, "predictions")
    writers.write_json_predictions(order_parts(t), "ids", path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("record")).agg(F.count(F.lit(1)).alias("n"))


# ============================================ projections and filters ==
@query("SELECT p_partkey, nullif(p_brand, 'Brand#1') AS brand FROM part WHERE nullif(p_brand, 'Brand#1') <> ''")
def filter_has_id(t: Tables):
    rows = t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("brand"))
    return rel.filter_has_id(rows, "brand")


@query("""SELECT doc_id, line FROM (SELECT doc_id, trim(line) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(line) > 2""")
def clean_rows(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rel.clean_rows(lines, "line")


@query("""WITH s AS (SELECT doc_id, coalesce(nullif(word, 'the'), 'None') AS word
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents))
SELECT doc_id, word, count(*) AS n FROM s WHERE length(word) > 2 GROUP BY 1, 2""")
def filter_min_len(t: Tables):
    words = t.wide_documents.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    kept = rel.filter_min_len(words.withColumn("word", F.nullif("word", F.lit("the"))), "word")
    return kept.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text FROM documents WHERE length(text) < 500")
def filter_max_len(t: Tables):
    return rel.filter_max_len(t.documents.select("doc_id", "text"), "text")


@query("""SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'P')
UNION ALL SELECT 'document', doc_id FROM documents WHERE lang NOT IN ('fr', 'de')""")
def filter_in_set(t: Tables):
    orders = rel.filter_in_set(t.orders, "o_orderstatus", ["F", "P"])
    docs = rel.filter_in_set(t.documents, "lang", ["fr", "de"], keep=False)
    return orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).union(
        docs.select(F.lit("document"), "doc_id")
    )


@query("""SELECT 'e' || event_id AS registry_id, event_type AS type, CAST(props->>'k' AS VARCHAR) AS city,
  'http://x.org/' || user_id AS country, CASE WHEN user_id % 2 = 0 THEN event_type END AS state,
  CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS aliases_len FROM events""")
def flatten_registry(t: Tables):
    none = F.lit(None).cast("string")
    address = F.struct(
        F.from_json("props", PROPS)["k"].cast("string").alias("city"),
        F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("state"),
        F.struct(F.struct(none.alias("name")).alias("geonames_admin1")).alias("geonames_city"),
    )
    no_list = F.array().cast("array<string>")
    registry = t.events.select(
        F.concat(F.lit("https://registry.example/e"), "event_id").alias("id"), F.lit("n").alias("name"),
        F.lit("active").alias("status"), F.array("event_type", F.lit("other")).alias("types"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.array("event_type", "props")).alias("aliases"),
        no_list.alias("acronyms"), F.array(F.struct(none.alias("label"), none.alias("iso639"))).alias("labels"),
        F.array(address).alias("addresses"),
        F.struct(none.alias("country_code"), F.concat(F.lit("http://x.org/"), "user_id").alias("country_name")).alias("country"),
        F.array(F.struct(none.alias("type"), none.alias("id"))).alias("relationships"),
    )
    flat = dims.flatten_registry(registry)
    return flat.select("registry_id", "type", "city", "country", "state", F.col("aliases_len").cast("bigint").alias("aliases_len"))


@query("""SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS words,
  CAST(CASE WHEN lang = 'fr' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS lines FROM documents""")
def nested_sizes(t: Tables):
    lines = F.when(F.col("lang") != "fr", F.split("text", "\n"))
    return t.documents.select(
        "doc_id", dims.nested_size(F.split("text", " ")).cast("bigint").alias("words"),
        dims.nested_size(lines).cast("bigint").alias("lines"),
    )


@query("""SELECT event_id, CASE WHEN CAST(props->>'k' AS BIGINT) % 2 = 0 THEN props->>'k' END AS region,
  CASE WHEN CAST(props->>'k' AS BIGINT) % 2 = 0 THEN props->>'k' ELSE 'None' END AS region_text FROM events""")
def admin_region(t: Tables):
    k = F.from_json("props", PROPS)["k"]
    inner = F.struct(k.cast("string").alias("name"))
    address = F.struct(F.when(k % 2 == 0, F.struct(inner.alias("geonames_admin1"))).alias("geonames_city"))
    rows = t.events.select("event_id", address.alias("a"))
    return rows.select(
        "event_id", dims.admin_region(F.col("a")).alias("region"), dims.admin_region(F.col("a"), True).alias("region_text")
    )


@query("""SELECT n_name, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS state
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey + 1""")
def final_region(t: Tables):
    # the shifted key leaves nations without a region
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey") + 1, "left")
    state = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return rows.select("n_name", dims.final_region(state, F.col("r_name")).alias("state"))


@query("SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def id_from_url(t: Tables):
    return t.pages.select("page_id", text.id_from_url(F.col("url")).alias("tail"))


@query("""SELECT doc_id, label, lang AS iso639, count(*) AS n
FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS label FROM documents WHERE text IS NOT NULL)
GROUP BY ALL""")
def explode_labels(t: Tables):
    labels = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("label"), F.col("lang").alias("iso639")))
    # texts are dealt by id while each is one row; labels are counted in that task
    texts = t.documents.filter("text is not null").select("doc_id", "text", "lang").repartition("doc_id")
    rows = texts.select("doc_id", labels.alias("labels"))
    return dims.explode_labels(rows, "doc_id").groupBy("doc_id", "label", "iso639").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, unnest([s_name || ', ' || n_name, s_name || ' ' || n_name, s_name]) AS original_affiliation
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def explode_strings(t: Tables):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = F.array(*[
        F.array(F.concat("s_name", F.lit(sep), "n_name"), F.lower("s_name")) for sep in (", ", " ")
    ], F.array("s_name", F.lower("s_name")))
    return rel.explode_strings(rows, "s_suppkey", pairs)


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0")
def drop_null_rows(t: Tables):
    key = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))
    rows = t.customer.join(t.orders, key == F.col("o_custkey"), "left")
    return rel.drop_null_rows(rows.select("c_custkey", "o_orderkey"), ["o_orderkey"])


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'gold_easy' WHEN 'error' THEN 'gold_hard' ELSE event_type END
  AS dataset FROM events""")
def relabel_values(t: Tables):
    # event types stand in for the data set names that get replaced
    names = {"click": "gold_1000", "error": "gold_500"}
    rows = t.events.select("event_id", F.col("event_type").alias("dataset")).replace(names, subset=["dataset"])
    return rel.relabel_values(rows, "dataset", fixed.DATASET_NAMES)


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN '-1' ELSE CAST(c_custkey AS VARCHAR) END AS ids,
  TRY_CAST(o_orderpriority AS BIGINT) AS priority_id
FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END""")
def cast_fill(t: Tables):
    key = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    rows = t.orders.join(t.customer, key == F.col("c_custkey"), "left")
    ids = F.when(F.col("c_custkey").isNotNull(), F.array("c_custkey"))
    return rows.select(
        "o_orderkey", listed(rel.fill_missing_ids(ids)).alias("ids"),
        F.col("o_orderpriority").try_cast("bigint").alias("priority_id"),
    )


# ================================================================== joins ==
@query("""SELECT DISTINCT o_custkey AS affiliation_id, o_orderpriority AS original_affiliation FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def join_known_ids(t: Tables):
    history = t.orders.select(F.col("o_custkey").alias("affiliation_id"), F.col("o_orderpriority").alias("original_affiliation"))
    known = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("affiliation_id"))
    return rel.join_known_ids(history, known, "affiliation_id")


@query("SELECT s_nationkey AS nation_id, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_registry(t: Tables):
    registry = t.supplier.select(F.col("s_nationkey").alias("nation_id"), "s_name")
    return rel.join_registry(registry, t.nation.select(F.col("n_nationkey").alias("nation_id"), "n_name"), "nation_id")


@query("""SELECT c_custkey + 7 AS id, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey + 7""")
def join_left_names(t: Tables):
    return rel.join_left_names(
        t.customer.select((F.col("c_custkey") + 7).alias("id"), "c_name"),
        t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey"), "id",
    )


@query("""WITH u AS (SELECT CASE WHEN lang = 'de' THEN text || ' ' ELSE text END AS text, min(doc_id) AS first_id FROM documents GROUP BY 1)
SELECT doc_id, md5(d.text) AS text_key, coalesce(CAST(first_id AS VARCHAR), '-1') AS ids
FROM documents d LEFT JOIN u ON d.text = u.text""")
def join_back_predictions(t: Tables):
    docs = t.documents.select("doc_id", "text")
    # texts of one language are changed, so that they find no prediction
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    unique = rel.dedupe_pick(t.documents.select(changed.alias("text"), "doc_id"), ["text"], "doc_id")
    preds = unique.select("text", F.array("doc_id").alias("ids"))
    out = rel.join_back_predictions(docs, preds, "text", "ids", "doc_id")
    return out.select("doc_id", F.md5("text").alias("text_key"), listed("ids").alias("ids"))


@query("SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)")
def join_natural_gold(t: Tables):
    return rel.join_shared(t.labels, t.documents.select("doc_id", "lang"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey AS inst_id, s_name AS display_name FROM lineitem
LEFT JOIN supplier ON l_suppkey = s_suppkey + 3""")
def lookup_institution(t: Tables):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("inst_id"))
    inst = t.supplier.select((F.col("s_suppkey") + 3).alias("inst_id"), F.col("s_name").alias("display_name"))
    return rel.lookup_institution(facts, inst, spread=["l_orderkey", "l_linenumber"])


SQL_TRAIN_VOCAB = f"""train AS (SELECT DISTINCT o_custkey AS inst_id FROM orders
  WHERE {sql_draw_int(1, "o_orderkey")} / 4294967296.0 < 0.5),
vocab AS (SELECT inst_id, row_number() OVER (ORDER BY {sql_draw(1, "inst_id")}, inst_id) AS label FROM train
  UNION ALL SELECT -1, 0)"""


def train_vocab(t: Tables):
    split = balance.train_val_split(t.orders.select("o_orderkey", F.col("o_custkey").alias("inst_id")), ["o_orderkey"], 0.5)
    return features.label_index(split.filter("split = 'train'"))


@query(f"WITH {SQL_TRAIN_VOCAB} SELECT o_orderkey, o_custkey AS inst_id, label FROM orders LEFT JOIN vocab ON o_custkey = inst_id")
def lookup_vocab(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("inst_id"))
    return features.encode_labels(rows, train_vocab(t), "inst_id", spread=["o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN l_partkey + 1 ELSE l_partkey END AS part_id
FROM lineitem""")
def remap_merged(t: Tables):
    merged = t.part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 1).alias("new_id"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_id"))
    return rel.remap_merged(rows, merged, "part_id", spread=["l_orderkey", "l_linenumber"])


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS registry_id,
  coalesce(string_agg(DISTINCT s_name, '|' ORDER BY s_name), '') AS extra_names
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN supplier ON s_nationkey = CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END GROUP BY 1""")
def lookup_successor_names(t: Tables):
    old = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))
    successors = t.nation.select(F.col("n_regionkey").cast("string").alias("registry_id"), old.alias("old_id"))
    names = t.supplier.select(F.col("s_nationkey").alias("old_id"), F.col("s_name").alias("name"))
    ids = t.region.select(F.col("r_regionkey").cast("string").alias("registry_id"))
    return rel.lookup_successor_names(ids, successors, names).withColumn("extra_names", listed("extra_names"))


# ============================================================ aggregates ==
@query("SELECT md5(text) AS text_key, lang, count(lang) AS n FROM documents GROUP BY text, lang")
def dedupe_count(t: Tables):
    return rel.dedupe_count(t.documents, "text", "lang").select(F.md5("text").alias("text_key"), "lang", "n")


@query("""SELECT 'lineitem' AS table_name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'documents', count(*) FROM documents""")
def count_rows(t: Tables):
    out = None
    for name in ("lineitem", "orders", "documents"):
        rows = getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT count(DISTINCT l_suppkey) AS institutions, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def distinct_ids(t: Tables):
    return t.lineitem.agg(F.count_distinct("l_suppkey").alias("institutions"), F.count_distinct("l_orderkey").alias("orders"))


@query("""SELECT p_partkey FROM part WHERE (p_name, p_brand, p_type) IN
  (SELECT (p_name, p_brand, p_type) FROM part GROUP BY p_name, p_brand, p_type HAVING count(*) > 1)""")
def common_names(t: Tables):
    return rel.common_name_ids(t.part, ["p_name", "p_brand", "p_type"], "p_partkey")


@query("SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), '|' ORDER BY n_nationkey) AS old_ids FROM nation GROUP BY 1")
def group_list(t: Tables):
    return rel.group_list(t.nation, "n_regionkey", "n_nationkey", "old_ids").withColumn("old_ids", listed("old_ids"))


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def dedupe_rows(t: Tables):
    return t.orders.select("o_custkey", "o_orderpriority").distinct()


@query("""SELECT doc_id, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_first(t: Tables):
    docs = t.documents.select("doc_id", "lang", "source", "text")
    return rel.dedupe_first(docs, ["text"], ["doc_id"]).drop("text")


@query(f"""WITH p AS (SELECT DISTINCT s_name AS city, n_name AS state, r_name AS country FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT unnest([city || country, city || state || country, state || country, country, state]) AS t FROM p)
SELECT DISTINCT {sql_clean('t', armed_forces=False)} AS clean_place FROM f""")
def place_list(t: Tables):
    rows = institution(t).select(
        F.col("display_name").alias("city"), F.col("country").alias("state"), F.col("region").alias("country"))
    return dims.place_list(rows)


@query("""SELECT DISTINCT n_name AS term FROM nation UNION SELECT DISTINCT r_name FROM region""")
def country_terms(t: Tables):
    per_region = nation_region(t).groupBy("r_name").agg(F.collect_list("n_name").alias("nations"))
    maps = per_region.select(F.create_map(
        F.col("r_name"), F.concat(F.array("r_name"), "nations")).alias("patterns"))
    return dims.country_terms(maps, "patterns")


@query(f"""SELECT p_type || ' ' || p_name AS term FROM part UNION SELECT unnest([{', '.join("'" + d + "'" for d in fixed.DEPARTMENTS)}])""")
def department_terms(t: Tables):
    return dims.department_terms(t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("term")))


@query("""WITH r AS (SELECT CAST(n_nationkey AS VARCHAR) AS registry_id, n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 3 <> 2)
SELECT registry_id, CAST(n_regionkey AS VARCHAR) AS successor, CAST(n_nationkey + 1 AS VARCHAR) AS parents
FROM r WHERE n_nationkey % 3 = 0""")
def successors_parents(t: Tables):
    key = F.col("n_nationkey")
    def link(kind: str, c):
        return F.struct(F.lit(kind).alias("type"), F.concat(F.lit("https://registry.example/"), c.cast("string")).alias("id"))
    links = F.array(
        link("Successor", F.col("n_regionkey")), link("Parent", key + 1), link("Related", key + 2))
    two = F.concat(links, F.array(link("Successor", key + 3)))
    registry = t.nation.select(
        key.cast("string").alias("registry_id"),
        F.when(key % 3 == 2, "active").when(key % 2 == 0, "inactive").otherwise("withdrawn").alias("status"),
        F.when(key % 3 == 0, links).otherwise(two).alias("relationships"),
    )
    return dims.successors_parents(registry).select("registry_id", "successor", listed("parents").alias("parents"))


SQL_TOKENS = f"regexp_extract_all(lower({sql_fold('text')}), '\\w+|[^\\w\\s]+')"


@query(f"""SELECT token, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS token FROM documents)
GROUP BY 1 ORDER BY n DESC, token LIMIT 3816""")
def term_frequency(t: Tables):
    return features.term_frequency(t.wide_documents, "text")


# =============================================================== windows ==
@query("SELECT o_orderkey, o_custkey, count(o_custkey) OVER (PARTITION BY o_custkey) AS id_count FROM orders")
def window_id_count(t: Tables):
    return rel.id_count(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", spread=["o_orderkey"])


@query(f"""WITH c AS (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS id_count,
  {sql_draw_int(20, "o_orderkey")} / 4294967296.0::DOUBLE AS random_prob FROM orders)
SELECT o_orderkey, id_count, round(random_prob, 9) AS random_prob,
  round(1 - (id_count - 50) / (3500000 - 50)::DOUBLE, 9) AS scaled_count,
  round(random_prob * (1 - (id_count - 50) / (3500000 - 50)::DOUBLE), 9) AS final_prob FROM c""")
def scaled_probability(t: Tables):
    out = balance.scaled_probability(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"])
    return out.select("o_orderkey", "id_count", *[F.round(c, 9).alias(c) for c in ("random_prob", "scaled_count", "final_prob")])


SQL_ORDER_TEXT = "o AS (SELECT o_custkey AS id, o_orderpriority || '|' || o_orderkey AS t FROM orders)"


def order_text(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("id"), F.concat_ws("|", "o_orderpriority", "o_orderkey").alias("t"))


@query(f"""WITH {SQL_ORDER_TEXT}, r AS (SELECT id, t,
  row_number() OVER (PARTITION BY id ORDER BY {sql_draw(20, 'id', 't')}, t) AS rn FROM o)
SELECT id, t, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 15""")
def window_random_rank(t: Tables):
    return balance.random_rank(order_text(t), "id", "t", 15)


SQL_CLOCK = f"-ln(1 - {sql_draw_int(20, *LINE_KEY)} / 4294967296.0::DOUBLE) / (l_linenumber * l_linenumber)"


@query(f"""WITH r AS (SELECT {', '.join(LINE_KEY)},
  row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_CLOCK}, {', '.join(LINE_KEY)}) AS rn FROM lineitem)
SELECT {', '.join(LINE_KEY)}, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 75""")
def weighted_sample(t: Tables):
    rows = t.lineitem.select(*LINE_KEY).withColumn("weight", F.col("l_linenumber") * F.col("l_linenumber"))
    return balance.weighted_sample(rows, "l_suppkey", "weight", 75, LINE_KEY).drop("weight")


@query("""SELECT l_orderkey AS text_id, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS first_fit FROM lineitem
JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1""")
def window_first_candidate(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).filter("p_size > 10")
    rows = rows.withColumnRenamed("l_orderkey", "text_id")
    return rel.first_candidate(rows, "text_id", ["l_linenumber", "l_partkey"], "l_partkey", "first_fit")


@query("""SELECT l_orderkey AS text_id, l_linenumber, p_name AS display_name, l_partkey,
  count(*) OVER (PARTITION BY l_orderkey, p_name) AS same_name FROM lineitem JOIN part ON l_partkey = p_partkey""")
def window_name_count(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("text_id"), "l_linenumber", F.col("p_name").alias("display_name"), "l_partkey")
    return rel.name_count(rows, ["text_id", "display_name"], "same_name", spread=["l_linenumber", "l_partkey"])


@query(f"""WITH r AS (SELECT {', '.join(LINE_KEY)}, row_number() OVER (ORDER BY {sql_draw(1, *LINE_KEY)}, {', '.join(LINE_KEY)}) - 1 AS idx
FROM lineitem) SELECT *, lpad(CAST(idx // 1000 AS VARCHAR), greatest(length(CAST(idx // 1000 AS VARCHAR)), 4)::INT, '0') AS shard FROM r""")
def shard_index(t: Tables):
    return features.shard_rows(t.lineitem.select(*LINE_KEY), LINE_KEY, 1000)


@query(f"WITH {SQL_TRAIN_VOCAB} SELECT inst_id, label FROM vocab")
def label_index(t: Tables):
    return train_vocab(t)


# ============================================= sorts, sampling, set queries ==
@query(f"""SELECT doc_id, source FROM documents ORDER BY {sql_draw(1, 'doc_id')}, doc_id LIMIT 50""")
def random_n(t: Tables):
    return balance.random_n(t.documents.select("doc_id", "source"), 50, ["doc_id"])


SQL_BALANCE = f"""{SQL_ORDER_TEXT},
k AS (SELECT id, count(*) AS k FROM o GROUP BY id),
r AS (SELECT o.id, t, k, row_number() OVER (PARTITION BY o.id ORDER BY {sql_draw(20, 'o.id', 't')}, t) AS rn
      FROM o JOIN k ON o.id = k.id),
draws AS (SELECT id, k, unnest(range(1, 10 - k + 1)) AS i FROM k WHERE k < 10),
extra AS (SELECT r.id, r.t FROM (SELECT id, {sql_draw_int(20, 'id', 'i')} % k + 1 AS rn FROM draws) d
          JOIN r ON r.id = d.id AND r.rn = d.rn)"""


@query(f"WITH {SQL_BALANCE} SELECT t, id FROM r WHERE k < 10 UNION ALL SELECT t, id FROM extra")
def upsample_replace(t: Tables):
    return balance.upsample_replace(order_text(t), "id", "t", 10).drop("copy_no")


@query("""WITH known AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'),
hist AS (SELECT DISTINCT o_custkey AS id, trim(o_orderpriority || ' ' || o_orderkey) AS t FROM orders
         WHERE o_custkey IN (SELECT id FROM known)),
synth AS (SELECT c_custkey AS id, c_name AS t FROM customer WHERE c_mktsegment <> 'BUILDING'),
o AS (SELECT id, t FROM hist UNION SELECT id, t FROM synth),""" + SQL_BALANCE.split(",\n", 1)[1] + """
SELECT t AS original_affiliation, id AS affiliation_id, count(*) AS copies FROM
 (SELECT t, id FROM r WHERE k < 10 OR rn <= 15 UNION ALL SELECT t, id FROM extra) GROUP BY 1, 2""")
def balanced_training_set(t: Tables):
    return balanced_orders(t).groupBy("original_affiliation", "affiliation_id").agg(F.count(F.lit(1)).alias("copies"))


def balanced_orders(t: Tables):
    """Order texts per customer as history, customer names as synthetic strings."""
    history = t.orders.select(
        F.concat(F.lit(" "), F.concat_ws(" ", "o_orderpriority", "o_orderkey"), F.lit("  ")).alias("original_affiliation"),
        F.col("o_custkey").alias("affiliation_id"),
    )
    synthetic = t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_name").alias("original_affiliation"), F.col("c_custkey").alias("affiliation_id"))
    return balance.balanced_training_set(history, synthetic, n=10, extra=5)


@query(f"""SELECT doc_id, CASE WHEN {sql_draw_int(1, 'doc_id')} / 4294967296.0 < 0.985 THEN 'train' ELSE 'val' END AS split
FROM documents""")
def train_val_split(t: Tables):
    return balance.train_val_split(t.documents.select("doc_id"), ["doc_id"])


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def head_rows(t: Tables):
    return t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey").limit(5)


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_positional(t: Tables):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rel.union_rows(customers, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("""SELECT doc_id, lang AS dataset FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY
  CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) = 1""")
def union_gold(t: Tables):
    docs = t.documents.select("doc_id", "text", F.col("lang").alias("dataset"))
    sets = [docs.filter(F.col("dataset") == lang) for lang in ("es", "de", "fr")]
    sets.append(docs.filter(~F.col("dataset").isin("es", "de", "fr")))
    return rel.union_gold(sets, "text", ["doc_id"]).drop("text")


@query(f"""WITH p AS (SELECT s_suppkey AS place_id, s_name AS city, n_name AS region, r_name AS country FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT city || ', ' || country AS t FROM p ORDER BY {sql_draw(1, 'place_id')}, place_id LIMIT 1500),
b AS (SELECT city || ', ' || region || ', ' || country AS t FROM p ORDER BY {sql_draw(2, 'place_id')}, place_id LIMIT 1500)
SELECT t AS original_affiliation FROM a UNION SELECT t FROM b""")
def union_empty_places(t: Tables):
    places = supplier_places(t)
    short = synth.place_sample(places, ["city", "country"], synth.EMPTY_PLACES, 1)
    return rel.union_distinct(short, synth.place_sample(places, ["city", "region", "country"], synth.EMPTY_PLACES, 2))


def supplier_places(t: Tables):
    return institution(t).select(
        F.col("inst_id").alias("place_id"), F.col("display_name").alias("city"),
        F.col("country").alias("region"), F.col("region").alias("country"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(string_split(text, ' '), string_split(lower(text), ' ')))), '|')
  AS words FROM documents""")
def array_union_distinct(t: Tables):
    both = rel.array_union_distinct(F.split("text", " "), F.split(F.lower("text"), " "))
    return t.wide_documents.select("doc_id", listed(both).alias("words"))
