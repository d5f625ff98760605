"""Two independent scorers: word weights and character n-gram weights.

A scorer learns which terms point to which institution (tf-idf, one unit
vector per institution) and scores a text by the weights of its distinct terms.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from affinis.fixed_values import TOP_CANDIDATES
from affinis.functions.text import index_ngrams, index_words
from affinis.operators.skew import salted_lookup
from affinis.session import materialize, scratch_path

MODEL_OUTPUT = T.StructType([
    T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType())),
])
TERMS = {"basic": index_words, "lang": index_ngrams}
DECIMALS = 6
SHARPNESS = 20.0
# Index entries and institutions of a block, distinct texts of a part, and texts scored at a time.
INDEX_BLOCK_ROWS = 1_000_000
BLOCK_INSTITUTIONS = 20_000
TEXT_PART_ROWS = 20_000
SCORE_TEXTS = 256
# Index entries a worker keeps, and sums of a text and an institution it holds at a time.
KEPT_ROWS = 2_000_000
DENSE_CELLS = 1_000_000
# A term is rare if at most one of so many institutions of a block has it.
RARE = 50


def text_terms(df: DataFrame, model: str, text_col: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(TERMS[model](F.col(text_col))).alias("term"))


def fit_score_index(training: DataFrame, model: str, id_col: str = "inst_id", text_col: str = "text") -> DataFrame:
    """``term, inst_id, weight, idf, df`` learned from labelled texts.

    ``weight`` is ``(1 + ln tf) * ln(N / df)`` scaled to length 1 per institution.
    Terms that every institution shares weigh nothing and are left out; all
    others are kept, however many institutions they have.
    """
    # training sets hold copies by design: each text is cut into terms once
    texts = training.groupBy(F.col(id_col).alias("inst_id"), text_col).agg(F.count(F.lit(1)).alias("copies"))
    tf = materialize(
        text_terms(texts, model, text_col, "inst_id", "copies").groupBy("inst_id", "term").agg(F.sum("copies").alias("tf")), "tf"
    )
    institutions = training.agg(F.count_distinct(id_col)).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") < institutions).select(
        "term", "df", F.round(F.log(institutions / F.col("df")), DECIMALS).alias("idf")
    )
    # A shared term has one row per institution in tf, so frequent terms are split.
    weighted = materialize(
        salted_lookup(tf, df, "term", "inner", spread=["inst_id"]).withColumn("raw", (1 + F.log("tf")) * F.col("idf")), "weighted"
    )
    norms = weighted.groupBy("inst_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return salted_lookup(weighted, norms, "inst_id", "inner", spread=["term"]).select(
        "term", "inst_id", F.round(F.col("raw") / F.col("norm"), DECIMALS).alias("weight"), "idf", "df"
    )


class IndexBlock:
    """One block of an index in order of the term: weights of institutions, dense for terms that many of them have."""

    def __init__(self, table: pa.Table) -> None:
        term, inst, weight, idf, df = (table.column(c).to_numpy() for c in ("term", "inst_id", "weight", "idf", "df"))
        self.institutions, self.at = np.unique(inst, return_inverse=True)
        self.terms, self.start, self.size = np.unique(term, return_index=True, return_counts=True)
        self.idf, self.value = idf[self.start], weight * idf
        self.share = self.idf**2 * self.size / df[self.start]
        many = self.size * 4 >= len(self.institutions)  # so the dense part has at most four times the entries
        self.dense_row = np.where(many, np.cumsum(many) - 1, -1)
        self.dense = np.zeros((int(many.sum()), len(self.institutions)))
        entry_term = np.repeat(np.arange(len(self.terms)), self.size)
        kept = many[entry_term]
        self.dense[self.dense_row[entry_term[kept]], self.at[kept]] = self.value[kept]

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``weight * idf`` of ``n`` texts with all institutions, and each text's share of its squared length."""
        text, place = self.known(text, term)
        return self._sums(text, place, n), np.bincount(text, self.share[place], n)

    def _sums(self, text: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.institutions)))
        dense = self.dense_row[place] >= 0
        used, back = np.unique(self.dense_row[place[dense]], return_inverse=True)
        if len(used):
            has = np.zeros((n, len(used)))
            has[text[dense], back] = 1
            out = has @ self.dense[used]
        rows, sparse = text[~dense], place[~dense]
        sizes = self.size[sparse]
        entry = np.repeat(self.start[sparse] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cell = np.repeat(rows, sizes) * len(self.institutions) + self.at[entry]
        out += np.bincount(cell, self.value[entry], n * len(self.institutions)).reshape(n, -1)
        return out

    @cached_property
    def top(self) -> np.ndarray:
        """The largest value of each term."""
        return np.maximum.reduceat(self.value, self.start) if len(self.start) else np.empty(0)

    @cached_property
    def cells(self) -> np.ndarray:
        """Number of each entry's term and institution in one, in order."""
        return np.repeat(np.arange(len(self.terms)), self.size) * len(self.institutions) + self.at

    def known(self, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts and places of the terms that the block has."""
        if not len(self.terms):
            return text[:0], np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        has = self.terms[place] == term
        return text[has], place[has]

    def _named(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, institution, sum) of all that the terms have entries for, in order."""
        sizes = self.size[place]
        entry = np.repeat(self.start[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cell, back = np.unique(np.repeat(text, sizes) * len(self.institutions) + self.at[entry], return_inverse=True)
        return *np.divmod(cell, len(self.institutions)), np.bincount(back, self.value[entry], len(cell))

    def best(self, text: np.ndarray, place: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, institution, sum) of what can be among the ``k`` best rounded scores of each text, ties by id.

        Texts come as the places of their terms. Terms of few institutions are added up first: where the others
        together can't bring any further institution among the ``k`` best, only those found so far are looked up in
        them. All other texts are compared with every institution.
        """
        count, n = len(self.institutions), len(length)
        rare = self.size[place] * RARE <= count
        more = np.bincount(text[~rare], self.top[place[~rare]], n)  # what the frequent terms add at most
        row, col, found = self._named(text[rare], place[rare])
        floor = _kth(row, _level(found, length[row], -1), n, k)
        settled = (more == 0) | (_level(more, length, 1) < floor)
        can = settled[row] & (_level(found + more[row], length[row], 1) >= floor[row])
        row, col, found = row[can], col[can], found[can]
        sizes = np.bincount(text[~rare], minlength=n)
        ends, each = np.cumsum(sizes), sizes[row]
        asked = place[~rare][np.repeat(ends[row] - np.cumsum(each), each) + np.arange(each.sum())] * count + np.repeat(col, each)
        at = np.minimum(np.searchsorted(self.cells, asked), len(self.cells) - 1)
        found = found + np.bincount(np.repeat(np.arange(len(row)), each), np.where(self.cells[at] == asked, self.value[at], 0.0), len(row))
        out = [_leading(row, col, found, length, k)]
        open_ = np.flatnonzero(~settled)
        number = np.full(n, -1)
        step = max(1, DENSE_CELLS // count)
        for low in range(0, len(open_), step):
            part = open_[low : low + step]
            number[part] = np.arange(len(part))
            own = number[text] >= 0
            sums = self._sums(number[text[own]], place[own], len(part))
            number[part] = -1
            behind = np.arange(count - 1, -1, -1)  # columns are in order of the id
            key = np.where(sums > 0, _level(sums, length[part, None], -1) * count + behind, -1)
            last = np.partition(key, count - k, axis=1)[:, count - k] if count > k else np.zeros(len(part))
            r, c = np.nonzero((sums > 0) & (_level(sums, length[part, None], 1) * count + behind >= np.maximum(last, 0)[:, None]))
            out.append((part[r], c, sums[r, c]))
        row, col, found = map(np.concatenate, zip(*out))
        return row, self.institutions[col], found


def _level(sums: np.ndarray, length: np.ndarray | float, way: int) -> np.ndarray:
    """The rounded score in units of its last decimal: at least (``way`` -1) or at most (1) what ``_rounded`` makes of it."""
    return np.floor(sums / length * 10.0**DECIMALS + 0.5 + way * 1e-5).astype(np.int64)


def _rounded(x: np.ndarray) -> np.ndarray:
    """``x`` to ``DECIMALS``, half up by its shortest decimal form, as Spark rounds."""
    low, high = _level(x, 1.0, -1), _level(x, 1.0, 1)
    out = low / 10.0**DECIMALS
    for at in np.flatnonzero(low != high):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP))
    return out


def _kth(row: np.ndarray, level: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k``-th highest level of each of ``n`` texts, -1 for those with fewer."""
    order = np.lexsort((-level, row))
    row, level = row[order], level[order]
    at = np.searchsorted(row, np.arange(n)) + k - 1
    has = at < np.searchsorted(row, np.arange(n), "right")
    out = np.full(n, -1)
    out[has] = level[at[has]]
    return out


def _leading(row: np.ndarray, col: np.ndarray, sums: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each text by level and id, and what rounding could lift among them."""
    low = _level(sums, length[row], -1)
    order = np.lexsort((col, -low, row))
    row, col, sums, low = row[order], col[order], sums[order], low[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (sums > 0) & ((rank < k) | ((_level(sums, length[row], 1) > low) & (_level(sums, length[row], 1) >= _kth(row, low, len(length), k)[row])))
    return row[kept], col[kept], sums[kept]


class StoredIndex:
    """The blocks of an index in the shared folder. A worker keeps what it read last, up to ``KEPT_ROWS`` entries."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.folder = folder
        self.files, self.root = fs.FileSystem.from_uri(folder)
        found = self.files.get_file_info(fs.FileSelector(self.root))
        self.names = sorted(f.base_name for f in found if f.base_name.startswith("block="))
        self.kept: dict[int, IndexBlock] = {}

    def __getitem__(self, number: int) -> IndexBlock:
        import pyarrow.dataset as ds

        if number not in self.kept:
            table = ds.dataset(f"{self.root}/{self.names[number]}", filesystem=self.files, format="parquet").to_table()
            block = IndexBlock(table.sort_by([("term", "ascending"), ("inst_id", "ascending")]))
            while self.kept and sum(len(b.value) for b in self.kept.values()) + len(block.value) > KEPT_ROWS:
                del self.kept[next(iter(self.kept))]
            self.kept[number] = block
        return self.kept[number]

    def best(self, sizes: np.ndarray, flat: np.ndarray, k: int) -> tuple:
        """Of texts, given as the numbers of their terms and all terms: (text, institution, sum), squared lengths, and
        the numbers of blocks with a common term and of blocks scored.

        With several blocks the sum of a block's largest values of a text's terms bounds what it can reach. Every text
        is scored in the block of its highest bound first. Its k-th best there is a floor: blocks below it are skipped.
        """
        n = len(sizes)
        text, starts = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
        bounds, q = np.zeros((len(self.names), n)), np.zeros(n)
        for number in range(len(self.names)):
            block = self[number]
            has, place = block.known(text, flat)
            bounds[number] = np.bincount(has, block.top[place], n)
            q += np.bincount(has, block.share[place], n)
        length, scored, floor = np.sqrt(np.where(q > 0, q, 1)), np.zeros(n, np.int64), np.full(n, -1)
        first = bounds.argmax(axis=0) if len(self.names) else np.zeros(n, np.int64)
        out = []
        for turn in (0, 1):
            for number in range(len(self.names)):
                reach = bounds[number] > 0
                rows = np.flatnonzero(reach & ((first == number) if turn == 0 else (first != number) & (_level(bounds[number], length, 1) >= floor)))
                scored[rows] += 1
                for low in range(0, len(rows), SCORE_TEXTS):
                    part = rows[low : low + SCORE_TEXTS]
                    own = sizes[part]
                    terms = flat[np.repeat(starts[part] - np.cumsum(own) + own, own) + np.arange(own.sum())]
                    row, inst, sums = self[number].best(*self[number].known(np.repeat(np.arange(len(part)), own), terms), length[part], k)
                    out.append((part[row], inst, sums))
            if turn == 0 and out and len(self.names) > 1:
                row, _, sums = map(np.concatenate, zip(*out))
                floor = _kth(row, _level(sums, length[row], -1), n, k)
        found = tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return found, q, (bounds > 0).sum(axis=0), scored


_open: list[StoredIndex] = []


def _opened(folder: str) -> StoredIndex:
    """The stored index; a worker keeps it from task to task."""
    if not _open or _open[0].folder != folder:
        _open[:] = [StoredIndex(folder)]
    return _open[0]


def _scorer(folder: str, k: int, part_rows: int, schema: pa.Schema):
    """Rows of text_id and term hashes to rows with the institutions that can be among a text's ``k`` best."""

    def score(texts: pa.Table):
        lists = texts.column("terms").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        (row, inst, sums), q, pairs, scored = _opened(folder).best(sizes, lists.flatten().to_numpy(), k)
        scores = _rounded(sums / np.sqrt(q)[row])
        order = np.lexsort((inst, -scores, row))
        row, inst, scores = row[order], inst[order], scores[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row[first], minlength=len(sizes)))), pa.int32())
        labels, values = (pa.ListArray.from_arrays(ends, pa.array(x[first])) for x in (inst, scores))
        columns = [texts.column("text_id").combine_chunks(), labels, values, pa.array(pairs), pa.array(scored)]
        return pa.Table.from_arrays(columns, ["text_id", "labels", "scores", "pairs", "scored"]).cast(schema).to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= part_rows:
                yield from score(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from score(pa.Table.from_batches(held))

    return run


def _blocks(index: DataFrame, blocks: int, limit: int) -> DataFrame:
    """``index`` with ``block``: institutions of one kind stand together, ``limit`` of them at most.

    The kind of an institution is the term that weighs most, over all who have it, of those that at most ``limit`` have.
    """
    shared = F.struct(F.col("df") <= limit, F.col("weight") * F.col("idf") * F.col("df"), F.col("term"))
    heaviest = index.groupBy("inst_id").agg(F.max_by("term", F.when(F.col("df") > 1, shared)).alias("_kind"))
    heaviest = heaviest.withColumn("_kind", F.coalesce("_kind", F.col("inst_id").cast("string")))
    sizes = heaviest.groupBy("_kind").agg(F.ceil(F.count(F.lit(1)) / limit).alias("_parts"))
    part = F.pmod(F.xxhash64("inst_id"), F.col("_parts"))
    placed = salted_lookup(heaviest, sizes, "_kind", "inner", spread=["inst_id"])
    placed = placed.select("inst_id", F.pmod(F.xxhash64("_kind", part), F.lit(blocks)).cast("int").alias("block"))
    return salted_lookup(index, placed, "inst_id", "inner", spread=["term"])


def _ranked(texts: DataFrame, index: DataFrame, model: str, text_col: str, k: int, report: dict | None = None) -> DataFrame:
    """``text_id, labels, scores``: the ``k`` best institutions of a text and their cosines, in order of the rank.

    The index is cut into blocks of institutions that lie in the shared folder. A task reads them one
    after the other and meets each with its texts, ``TEXT_PART_ROWS`` at a time, so texts are dealt once and neither
    copies of the index nor scores of a text are shuffled. With several blocks, a text meets only
    those whose bound reaches its ``k``-th best so far (``StoredIndex.best``); ``report`` then gets the
    numbers of ``pairs`` of a text and a block with a common term, and of those ``scored``. No term is left out.
    """
    rows, institutions = index.agg(F.count(F.lit(1)), F.count_distinct("inst_id")).first()
    blocks = max(1, -(-rows // INDEX_BLOCK_ROWS), -(-institutions // BLOCK_INSTITUTIONS))
    limit = max(1, BLOCK_INSTITUTIONS // 8)
    placed = index.withColumn("block", F.lit(0)) if blocks == 1 else _blocks(index, blocks, limit)
    placed = placed.select(
        F.col("block").cast("int").alias("block"), F.xxhash64("term").alias("term"), F.col("inst_id").cast("bigint").alias("inst_id"), "weight", "idf", "df"
    )
    folder = scratch_path(texts.sparkSession, "index-blocks")
    placed.repartition("block").write.partitionBy("block").parquet(folder)
    spark = texts.sparkSession
    # work on a text is costly for its bytes: the number of tasks is given, or Spark would join the small ones
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.select("text_id", text_col).repartition(tasks, "text_id")
    asked = dealt.select("text_id", F.transform(TERMS[model](F.col(text_col)), lambda term: F.xxhash64(term)).alias("terms")).filter(F.size("terms") > 0)
    schema = T.StructType([
        asked.schema["text_id"], T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("pairs", T.LongType()), T.StructField("scored", T.LongType()),
    ])
    found = asked.mapInArrow(_scorer(folder, k, TEXT_PART_ROWS, to_arrow_schema(schema)), schema)
    if report is not None:
        found = materialize(found, "found")
        report.update(found.agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored")).first().asDict())
    return found.select("text_id", "labels", "scores")


def term_scores(texts: DataFrame, index: DataFrame, model: str, text_col: str = "text", k: int = TOP_CANDIDATES,
                report: dict | None = None) -> DataFrame:
    """``text_id, inst_id, score``: the cosine of each text with its ``k`` best institutions (see ``_ranked``).

    ``text_id`` tells the rows of ``texts`` apart.
    """
    rows = _ranked(texts, index, model, text_col, k, report).select("text_id", F.explode(F.arrays_zip("labels", "scores")).alias("c"))
    return rows.select("text_id", F.col("c.labels").alias("inst_id"), F.col("c.scores").alias("score"))


def soft_max(scores: DataFrame, sharpness: float = 1.0, key: str = "text_id", col: str = "score") -> DataFrame:
    """Scores of one text to probabilities."""
    w = Window.partitionBy(key)
    shifted = scores.withColumn("_e", F.exp(sharpness * (F.col(col) - F.max(col).over(w))))
    return shifted.withColumn(col, F.round(F.col("_e") / F.sum("_e").over(w), DECIMALS)).drop("_e")


def topk_candidates(scores: DataFrame, k: int = TOP_CANDIDATES, key: str | list[str] = "text_id") -> DataFrame:
    """The ``k`` best institutions per text (or per other key), ties by id."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "inst_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_texts(texts: DataFrame, index: DataFrame, model: str, text_col: str = "text",
                k: int = TOP_CANDIDATES, sharpness: float | None = SHARPNESS) -> DataFrame:
    """``text_id, model, rank, inst_id, score`` for the top ``k``.

    Ranks follow the cosine; with ``sharpness`` the score is its soft-max share
    among the ``k``.
    """
    ranked = _ranked(texts, index, model, text_col, k)
    score = F.col("c.scores")
    if sharpness:  # ``soft_max`` of a list, whose first score is the highest
        top = F.get("scores", F.lit(0))
        total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(sharpness * (s - top)))
        ranked = ranked.select("*", top.alias("top"), total.alias("total"))
        score = F.round(F.exp(sharpness * (score - F.col("top"))) / F.col("total"), DECIMALS)
    rows = ranked.select("*", F.posexplode(F.arrays_zip("labels", "scores")).alias("place", "c"))
    return rows.select("text_id", F.lit(model).alias("model"), (F.col("place") + 1).alias("rank"), F.col("c.labels").alias("inst_id"), score.alias("score"))


def score_external(texts: DataFrame, predict: Column, model: str, k: int = TOP_CANDIDATES) -> DataFrame:
    """Scores of a model of your own.

    ``predict`` is a struct column of two equally long lists, ``labels`` and
    ``scores``, per text; a ``predict_batch_udf`` with return type
    ``MODEL_OUTPUT`` gives one in Arrow batches (``bayes.predictor`` is one). Labels
    whose score is null or NaN stand for nothing and are left out.
    """
    rows = texts.select("text_id", predict.alias("p")).select(
        "text_id", F.explode(F.arrays_zip("p.labels", "p.scores")).alias("c")
    ).select("text_id", F.col("c.labels").alias("inst_id"), F.col("c.scores").alias("score")).filter("score is not null and not isnan(score)")
    return topk_candidates(rows, k).select("text_id", F.lit(model).alias("model"), "rank", "inst_id", "score")
