"""Exact top-k search by inner product: a Voronoi kNN join.

Queries are grouped by their nearest pivot. Of each group only a summary is used to bound what
it can need: its pivot p and its radius U, the largest distance of a query from p. For a query q
of the group and any vector x, the score q.x lies within U * |x| of p.x. The (k + 1)-th largest
of the lower ends over all data is a floor under every query's k-th score, so a vector is sent to
the group only if its upper end reaches that floor. Inside a group, blocks of queries meet blocks
of the vectors sent there, solved as one matrix product; blocks bound what a task holds, so a
group with a third of the queries, or one very common vector, is only more blocks. Pivots are a
bounded sample of the queries; they shape the groups, never the result.

Defined results: vectors that are null, or hold null or non-finite components, take no part.
Vectors of different lengths have no score with each other; the driver holds one entry for each
length and pivot. Equal rows count once; all rows with the query's vec_id are its own. A row
without a vec_id is a candidate, last among ties, but no query. Scores beyond a long end at its
limits. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import materialize

#: Queries for each pivot and the most pivots; rows of a block of queries and of data.
PIVOT_QUERIES, PIVOTS = 512, 256
QUERY_BLOCK, DATA_BLOCK = 1024, 32_768
STRIP = 2048
LAST = 2**63 - 1  # stands for a missing vec_id, after all others


def _quantised(scale: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column("embedding")
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            flat = np.clip(flat, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            packed, norms, dims = [], [], []
            for start, end in zip(np.append(0, ends[:-1]), ends):
                v = flat[start:end]
                packed.append(v.astype(np.min_scalar_type(-int(np.abs(v.astype(np.float64)).max(initial=0)) - 1)).tobytes() if len(v) else b"")
                norms.append(float(np.sqrt((v.astype(np.float64) ** 2).sum())))
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())],
                ["vec_id", "dim", "vector", "norm"],
            )

    return run


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim, vector (floor of ``scale`` times each component, packed in the fewest bytes) and its norm."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), number.alias("embedding"))
    return rows.mapInArrow(_quantised(scale), "vec_id long, dim int, vector binary, norm double").dropDuplicates(["vec_id", "dim", "vector"])


def _matrix(packed: list[bytes], dim: int):
    """The rows of packed vectors of one length, as 64-bit integers."""
    import numpy as np

    out = np.zeros((len(packed), dim), np.int64)
    for width in {len(v) for v in packed} if dim else ():
        at = [i for i, v in enumerate(packed) if len(v) == width]
        kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[width // dim]
        out[at] = np.frombuffer(b"".join(packed[i] for i in at), kind).reshape(-1, dim)
    return out


def _scores(queries, data):
    """Inner products of all rows, as exact longs."""
    import numpy as np

    def most(a):
        return int(np.abs(a.astype(np.float64)).max(initial=0)) + 1

    bound = most(queries) * most(data) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return queries @ data.T
    return np.clip(queries.astype(object) @ data.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def _blocks(batches: Iterable) -> Iterator:
    """(dim, batch, rows of it) for each length in each batch."""
    import numpy as np

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            yield int(dim), batch, np.flatnonzero(dims == dim)


def _nearest(pivots: dict):
    """The nearest pivot of each query and its distance; without pivots of its length, the origin."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for dim, batch, at in _blocks(batches):
            rows = batch.take(pa.array(at))
            x = _matrix(rows.column("vector").to_pylist(), dim).astype(np.float64)
            p = pivots.get(dim, np.zeros((1, dim)))
            squares = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1))
            group = squares.argmin(1)
            distance = np.sqrt(((x - p[group]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(group.astype(np.int32)), pa.array(distance)], [*rows.schema.names, "cell", "distance"]
            )

    return run


def _ends(vectors, norms, pivot, radius):
    """Lower and upper end of the scores that the group's queries can have; widened for rounding."""
    import numpy as np

    middle = vectors @ pivot
    slack = radius * norms
    slack = slack + 1e-9 * (np.abs(middle) + slack) + 1e-6
    return middle - slack, middle + slack


def _floors(groups: dict, depth: int):
    """The ``depth`` largest lower ends for each group, over a task's vectors."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: dict = {}
        for dim, batch, at in _blocks(batches):
            rows = batch.take(pa.array(at))
            x, norms = _matrix(rows.column("vector").to_pylist(), dim).astype(np.float64), rows.column("norm").to_numpy()
            for cell, (pivot, radius, _) in groups.get(dim, {}).items():
                both = np.append(best.get((dim, cell), []), _ends(x, norms, pivot, radius)[0])
                best[dim, cell] = np.sort(both)[-depth:]
        for (dim, cell), low in best.items():
            n = len(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * n, pa.int32()), pa.array([cell] * n, pa.int32()), pa.array(low)], ["dim", "cell", "low"]
            )

    return run


def _sent(groups: dict, floors: dict, blocks: int):
    """A row for each vector and each block of queries that can need it."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for dim, batch, at in _blocks(batches):
            rows = batch.take(pa.array(at))
            x, norms = _matrix(rows.column("vector").to_pylist(), dim).astype(np.float64), rows.column("norm").to_numpy()
            for cell, (pivot, radius, parts) in groups.get(dim, {}).items():
                needed = np.flatnonzero(_ends(x, norms, pivot, radius)[1] >= floors.get((dim, cell), -np.inf))
                if not len(needed):
                    continue
                kept = rows.take(pa.array(needed))
                n = len(needed)
                for part in range(parts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, cell, np.int32)), pa.array(np.full(n, part, np.int32)),
                            kept.column("block"), kept.column("vec_id"), kept.column("vector"),
                        ],
                        ["dim", "cell", "part", "block", "vec_id", "vector"],
                    )

    return run


def _solve(k: int):
    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "query", "vec_id", "score"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        dim = key[0].as_py()
        query_ids, packed = left.column("vec_id").to_numpy(), left.column("vector").to_pylist()
        order = right.column("vec_id").fill_null(LAST).to_numpy()
        by_id = np.argsort(order, kind="stable")
        ids = order[by_id]
        data_packed = right.column("vector").to_pylist()
        queries, data = _matrix(packed, dim), _matrix([data_packed[i] for i in by_id], dim)
        out = [[], [], [], []]
        for start in range(0, len(packed), 64):
            strip = slice(start, start + 64)
            kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids[strip])
            for low in range(0, len(ids), STRIP):
                scores = _scores(queries[strip], data[low : low + STRIP])
                near = ids[low : low + STRIP]
                for row, own in enumerate(query_ids[strip]):
                    s, i = np.append(kept[row][0], scores[row]), np.append(kept[row][1], near)
                    floor = kept[row][0][-1] if len(kept[row][0]) == k else -(2**63)
                    pick = np.flatnonzero((s >= floor) & (i != own))
                    s, i = s[pick], i[pick]
                    if len(s) > 4 * k:  # all that reach the k-th score, ties too
                        pick = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        s, i = s[pick], i[pick]
                    best = np.lexsort((i, -s))[:k]
                    kept[row] = s[best], i[best]
            for row, (s, i) in enumerate(kept):
                out[0] += [query_ids[start + row]] * len(s)
                out[1] += [packed[start + row]] * len(s)
                out[2] += [None if v == LAST else v for v in i.tolist()]
                out[3] += s.tolist()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every query, ties to the smaller vec_id."""
    import numpy as np

    vectors = materialize(quantised(embeddings, scale), "knn-vectors")
    queries = vectors.where(is_query & F.col("vec_id").isNotNull())
    rows = vectors.count()
    wanted = max(1, min(PIVOTS, -(-queries.count() // PIVOT_QUERIES)))
    copies = vectors.groupBy("vec_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    depth = k + copies  # so many are enough even without the query's own rows

    sample: dict[int, list] = {}
    for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(wanted).select("dim", "vector").collect():
        sample.setdefault(r.dim, []).append(bytes(r.vector))
    pivots = {dim: np.unique(_matrix(packed, dim), axis=0).astype(np.float64) for dim, packed in sample.items()}

    celled = materialize(queries.mapInArrow(_nearest(pivots), "vec_id long, dim int, vector binary, norm double, cell int, distance double"), "knn-queries")
    groups: dict[int, dict] = {}
    for r in celled.groupBy("dim", "cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        pivot = pivots.get(r.dim, np.zeros((1, r.dim)))[r.cell]
        groups.setdefault(r.dim, {})[r.cell] = (pivot, r.radius, -(-r.n // QUERY_BLOCK))

    lows = vectors.mapInArrow(_floors(groups, depth), "dim int, cell int, low double")
    place = F.row_number().over(Window.partitionBy("dim", "cell").orderBy(F.desc("low")))
    floors = {(r.dim, r.cell): r.low for r in lows.withColumn("place", place).where(F.col("place") <= depth).where(F.col("place") == depth).collect()}

    blocks = max(1, -(-rows // DATA_BLOCK))
    keys = ["dim", "cell", "part", "block"]
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block")
    sent = vectors.select("*", block).mapInArrow(
        _sent(groups, floors, blocks), "dim int, cell int, part int, block int, vec_id long, vector binary"
    )
    parts = F.create_map(*[x for d, g in groups.items() for c, v in g.items() for x in (F.lit(f"{d},{c}"), F.lit(v[2]))]) if groups else None
    asked = celled.select(
        "dim", "cell", "vec_id", "vector",
        (F.pmod(F.xxhash64("vec_id", "vector"), parts[F.concat_ws(",", "dim", "cell")]) if groups else F.lit(0)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    found = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solve(k), "query_id long, query binary, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
