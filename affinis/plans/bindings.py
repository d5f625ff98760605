"""Driver tables in the roles of the engine's tables, for Spark and for SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.text import ARMED_FORCES
from affinis.session import materialize
from affinis.sources.readers import read_table, spread


class Tables:
    """``tables.orders`` reads ``orders.parquet`` of one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A result with several readers within a query: written to the shared folder when first asked for."""
        if name not in self._made:
            self._made[name] = materialize(make(), name)
        return self._made[name]

    @property
    def wide_documents(self) -> DataFrame:
        """Documents for costly text work; one file of few row groups is spread over the cores."""
        return spread(self.documents, "doc_id")

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None):
    """Register ``fn(tables)`` under its own name with the SQL that checks it."""
    def add(fn: Callable[[Tables], DataFrame]):
        CATALOG[fn.__name__] = Query(lambda spark, path: fn(Tables(spark, path)), sql)
        return fn
    return add


def listed(c: Column | str, sep: str = "|") -> Column:
    """A list as text, so results compare the same in every engine."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), sep)


# ----------------------------------------------------------- institutions --
SQL_INSTITUTION = """institution AS (
  SELECT s_suppkey AS inst_id, s_name AS display_name, n_name AS country, r_name AS region,
         s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def nation_region(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))


def institution(t: Tables) -> DataFrame:
    dim = t.supplier.join(nation_region(t), F.col("s_nationkey") == F.col("n_nationkey"))
    return dim.select(
        F.col("s_suppkey").alias("inst_id"), F.col("s_name").alias("display_name"),
        F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"),
    )


# --------------------------------------------------------------- mentions --
SQL_MENTION = """mention AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS mention_id, l_partkey % 16 AS kind,
         p_name || ' ' || p_type || ' ' || p_brand || ', ' || s_name || ', ' || n_name AS affiliation_string,
         l_suppkey AS inst_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def mention(t: Tables) -> DataFrame:
    """Line items as labelled strings: ``part, supplier, nation`` text with the supplier as label."""
    supplier = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = (
        spread(t.lineitem.select(*LINE_COLUMNS), *LINE_COLUMNS).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    # line numbers repeat within an order, so part and supplier are part of the id
    return rows.select(
        F.concat_ws("-", *LINE_COLUMNS).alias("mention_id"), (F.col("l_partkey") % 16).alias("kind"),
        F.concat(F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.lit(", "), "s_name", F.lit(", "), "n_name")
        .alias("affiliation_string"),
        F.col("l_suppkey").alias("inst_id"),
    )


# ------------------------------------------------------- SQL text helpers --
def sql_fold(x: str) -> str:
    return rf"regexp_replace(replace(strip_accents({x}), 'ß', 'ss'), '[^\x00-\x7F]', '', 'g')"


def sql_ampersand(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'r&d') THEN {x} ELSE replace({x}, ' & ', ' and ') END"


def sql_drop_suffix(x: str) -> str:
    """Nations play the countries: one pattern of all their names."""
    pattern = "'(\\((?:' || (SELECT string_agg(n_name, '|') FROM nation) || ')\\))\\s*$'"
    return f"replace({x}, regexp_extract({x}, {pattern}, 1), '')"


def sql_clean(x: str, countries: bool = False, armed_forces: bool = True) -> str:
    out = sql_ampersand(x)
    if countries:
        out = sql_drop_suffix(f"({out})")
    out = f"replace(replace({sql_fold(f'({out})')}, 'Univ.', 'University'), 'Lab.', 'Laboratory')"
    if armed_forces:
        for short, full in ARMED_FORCES:
            out = f"replace({out}, '{short}', '{full}')"
    return f"regexp_replace({out}, '[^0-9a-zA-Z]', '', 'g')"


def sql_draw(seed: int, *parts: str) -> str:
    return f"md5(concat_ws('|', {seed}, {', '.join(parts)}))"


def sql_draw_int(seed: int, *parts: str) -> str:
    return f"('0x' || substr({sql_draw(seed, *parts)}, 1, 8))::BIGINT"


def sql_words(x: str) -> str:
    words = f"regexp_split_to_array(lower({sql_fold(x)}), '[^0-9a-z]+')"
    return f"list_distinct(list_filter({words}, lambda w: w <> ''))"


def sql_windows(flat: str, n: int) -> str:
    return f"list_distinct([substr({flat}, i::BIGINT, {n}) FOR i IN range(1, greatest(length({flat}) - {n - 1}, 0) + 1)])"


def sql_ngrams(x: str, n: int = 4) -> str:
    return sql_windows(f"(' ' || regexp_replace(lower({sql_fold(x)}), '[^0-9a-z]+', ' ', 'g') || ' ')", n)
