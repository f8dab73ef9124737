"""Exact and approximate inner-product retrieval over vector tables: blocked search, an inverted file, hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import materialize

#: Items of a block; queries of one (500 best of each take 131 MB); bytes of the scores that a task holds at a time.
BLOCK_ITEMS, BLOCK_QUERIES, SCORE_BYTES = 1 << 14, 1 << 14, 32 << 20

SCORED = "query_id long, item_id long, score double"
NAMES = ["query_id", "item_id", "score"]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _queries(queries: DataFrame, *more: str) -> DataFrame:
    skip = F.col("skip") if "skip" in queries.columns else F.expr("cast(array() as array<bigint>)")
    others = [(F.col(c) if c in queries.columns else F.lit(None)).cast("long").alias(c) for c in more]
    return queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), skip.alias("skip"), *others)


def _items(items: DataFrame) -> DataFrame:
    return items.where("vector is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("vector").cast("array<double>").alias("vector"))


def _stream_scorer(k: int, digits: int, packed: bool = False, admit=None):
    """Rows (row, kind, cell, id, vector, skip, wanted) in that order, a block's queries before all items by ascending
    id: the items pass by, batch by batch, and only the block's queries and their k best so far are held.  With
    `admit` only the pairs that it admits are compared; items may then come by cells."""

    def best(block, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray) -> None:
        names, found, skips, wanted, top, of_top, live, asks = block
        rows = max(1, SCORE_BYTES // (8 * (len(ids) + k)))
        place = None if admit is None else admit.places(vectors, cells)
        for lo in range(0, len(names), rows):
            scores = np.round(found[lo : lo + rows] @ vectors.T, digits)
            if admit is not None:
                np.copyto(scores, -np.inf, where=~admit.pairs(found[lo : lo + rows], asks[lo : lo + rows], place))
            for q, skip in enumerate(skips[lo : lo + rows]):
                if skip is not None and len(skip):
                    scores[q, np.isin(ids, skip)] = -np.inf
            # by id, later items have larger ones, so an equal score doesn't replace one of k
            better = np.greater if admit is None else np.greater_equal
            least_of = np.maximum(top[lo : lo + rows, -1:], np.finfo(float).min) if admit is not None else top[lo : lo + rows, -1:]
            for q in np.flatnonzero(live[lo : lo + rows] & better(scores, least_of).any(1)):
                at = lo + q
                new = np.flatnonzero(better(scores[q], top[at, -1]) & np.isfinite(scores[q]))
                if not len(new):
                    continue
                if len(new) > k:
                    least = np.partition(scores[q, new], -k)[-k]
                    new = new[scores[q, new] >= least]
                both, names_of = np.concatenate([top[at], scores[q, new]]), np.concatenate([of_top[at], ids[new]])
                order = (np.argsort(-both, kind="stable") if admit is None else np.lexsort((names_of, -both)))[:k]
                top[at], of_top[at] = both[order], names_of[order]

    def rows_of(block):
        names, _, _, wanted, top, of_top, *_ = block
        for lo in range(0, len(names), 256) if packed else ():
            found = [(n, i[np.isfinite(t)]) for n, i, t in zip(names[lo : lo + 256], of_top[lo : lo + 256], top[lo : lo + 256], strict=True) if np.isfinite(t[0])]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))], names=["query_id", "items"])
        for lo in () if packed else range(0, len(names), 256):
            keep = np.isfinite(top[lo : lo + 256])
            if wanted is not None:
                keep &= of_top[lo : lo + 256] == wanted[lo : lo + 256, None]
            q, place = np.nonzero(keep)
            columns = (names[lo + q], of_top[lo + q, place], top[lo + q, place], (place + 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*NAMES, "rank"])

    def run(batches):
        row, waiting, block = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows, kinds = (table.column(c).to_numpy() for c in ("row", "kind"))
            cuts = np.flatnonzero((np.diff(rows) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if lo == hi:
                    continue
                part = table.slice(lo, hi - lo)
                if rows[lo] != row:
                    if block is not None:
                        yield from rows_of(block)
                    row, waiting, block = rows[lo], [], None
                if kinds[lo] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    queries = pa.concat_tables(waiting)
                    found, n = matrix(queries.column("vector")), queries.num_rows
                    skips = [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in queries.column("skip")]
                    want = queries.column("wanted")
                    wanted = None if want.null_count == n else want.to_numpy(zero_copy_only=False)
                    live = np.einsum("ij,ij->i", found, found) > 0
                    block, waiting = (queries.column("id").to_numpy(), found, skips, wanted, np.full((n, k), -np.inf), np.zeros((n, k), np.int64), live, admit and admit.asks(found)), []
                if block is not None:
                    best(block, part.column("id").to_numpy(), matrix(part.column("vector")), part.column("cell").to_numpy())
        if block is not None:
            yield from rows_of(block)

    return run


def _block_scorer(k: int, digits: int, packed: bool = False, admit=None):
    """The same for a block of queries and items that are few enough to be held together."""
    stream = _stream_scorer(k, digits, packed, admit)
    columns = [("query_id", pa.int64()), ("items", pa.list_(pa.int64()))] if packed else list(zip([*NAMES, "rank"], (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        n, missing = items.num_rows, {"skip": pa.list_(pa.int64()), "wanted": pa.int64()}
        items = items.sort_by([("cell", "ascending"), ("id", "ascending")])
        for name, kind in missing.items():
            items = items.append_column(name, pa.nulls(n, kind))
        found = list(stream([*queries.to_batches(), *items.select(queries.column_names).to_batches()])) if n and queries.num_rows else []
        return pa.Table.from_batches(found, pa.schema(columns))

    return run


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, block_items: int | None = None, block_queries: int | None = None, packed: bool = False, admit=None) -> DataFrame:
    """query_id, item_id, score, rank (packed: query_id and the array items, in order): the k items of largest inner product per query.

    queries(query_id, vector) without a vector, or with a zero one, get no rows; so do
    items(item_id, vector) without one.  A column `skip` of queries lists items that a
    query doesn't want; with a column `wanted` only the row of that item is given, if it is
    among the k.  Scores are rounded, ties go to the smaller id.

    Queries are dealt into blocks by hash.  Items of one block meet them in a cogroup; more pass
    through every query block's task in batches, which keeps the k best per query.  Either way lists
    are final where they arise and are not shuffled, the driver holds nothing but the counts.  `admit` says
    which pairs are compared (Hashed, Probed), for items with a column `cell` by that.
    """
    result = "query_id long, items array<bigint>" if packed else SCORED + ", rank long"
    live = _queries(queries, "wanted")
    cell = (F.col("cell") if "cell" in items.columns else F.lit(0)).cast("long").alias("cell")
    known = items.where("vector is not null").select(cell, F.col("item_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    n_items, n_queries = known.count(), live.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-n_queries // (block_queries or BLOCK_QUERIES)), min(cores, -(-n_queries // 256)))
    row = F.pmod(F.xxhash64("query_id"), F.lit(down))
    q = live.select(row.alias("row"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cell"), F.col("query_id").alias("id"), "vector", "skip", "wanted")
    i = known.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("row"), F.lit(1).alias("kind"), "cell", "id", "vector")
    if n_items <= (block_items or BLOCK_ITEMS):
        return q.groupBy("row").cogroup(i.groupBy("row")).applyInArrow(_block_scorer(k, digits, packed, admit), result)
    both = q.unionByName(i, allowMissingColumns=True).repartition(down, "row").sortWithinPartitions("row", "kind", "cell", "id")
    return both.mapInArrow(_stream_scorer(k, digits, packed, admit), result)


# An inverted file: centroids learnt by rounds of k-means, items listed by their nearest
# centroid, a query compared with the lists of the centroids that it is nearest to.

#: Cells: CELL_FACTOR times the root of the number of items, at most MOST_CELLS (their centroids are broadcast, 32 MB of 64 dimensions).
CELL_FACTOR, MOST_CELLS = 4, 1 << 16
#: Up to so many items meet the queries in a cogroup; more pass by, ordered by their lists.
LIST_ITEMS = 1 << 14


def _nearest(centroids, probes: int):
    """(id, cell, place) of the `probes` centroids of largest inner product, and the vector."""

    def run(batches):
        c = centroids.value
        for batch in batches:
            vectors = matrix(batch.column(1))
            if not len(vectors):
                continue
            rows = max(1, SCORE_BYTES // (8 * len(c)))
            best = []
            for lo in range(0, len(vectors), rows):
                score = vectors[lo : lo + rows] @ c.T
                top = np.argpartition(-score, min(probes, len(c)) - 1, axis=1)[:, :probes]
                best.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1))
            cells = np.concatenate(best)
            at = np.repeat(np.arange(len(cells)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cells.ravel()), pa.array(np.tile(np.arange(cells.shape[1]), len(cells)))], names=["id", "cell", "place"])

    return run


def _placed(centroids):
    """Items with their vectors and the cell of the nearest centroid."""

    def run(batches):
        c = centroids.value
        rows = max(1, SCORE_BYTES // (8 * len(c)))
        for batch in batches:
            vectors = matrix(batch.column(1))
            cells = [(vectors[lo : lo + rows] @ c.T).argmax(1) for lo in range(0, len(vectors), rows)]
            if cells:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(cells))], names=["item_id", "vector", "cell"])

    return run


class Probed:
    """Admits the items of the `probes` cells whose centroids are nearest to a query."""

    def __init__(self, centroids, probes: int):
        self.centroids, self.probes = centroids, probes

    def asks(self, found: np.ndarray) -> np.ndarray:
        """The inner product with the last centroid that is probed."""
        c = self.centroids.value
        n, rows = min(self.probes, len(c)), max(1, SCORE_BYTES // (8 * len(c)))
        return np.concatenate([np.partition(found[lo : lo + rows] @ c.T, -n, axis=1)[:, -n] for lo in range(0, len(found), rows)])

    def places(self, vectors: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that occur, and each item's number among them."""
        return np.unique(cells, return_inverse=True)

    def pairs(self, found: np.ndarray, asks: np.ndarray, place: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own, number = place
        return (found @ self.centroids.value[own].T >= asks[:, None] - 1e-9)[:, number]


def _cell_sums(centroids):
    """Per cell the sum and number of the vectors whose nearest centroid it is."""

    def run(batches):
        c = centroids.value
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0))
            rows = max(1, SCORE_BYTES // (8 * len(c)))
            for lo in range(0, len(vectors), rows):
                own = vectors[lo : lo + rows]
                cell = (own @ c.T).argmax(1)
                np.add.at(total, cell, own)
                n += np.bincount(cell, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class VectorIndex:
    """lists(item_id, vector, cell) in the shared folder, and unit centroids."""

    def __init__(self, lists: DataFrame, centroids: np.ndarray, n_items: int):
        self.lists, self.centroids, self.n_items = lists, centroids, n_items
        self.shared = lists.sparkSession.sparkContext.broadcast(centroids) if len(centroids) else None

    @classmethod
    def build(cls, items: DataFrame, cells: int | None = None, rounds: int = 8, seed: int = 7) -> VectorIndex:
        """Spherical k-means over all items from `cells` hashed ones; an empty cell keeps its centroid."""
        spark = items.sparkSession
        whole = materialize(_items(items), "items-to-index")
        n = whole.count()
        if not n:
            return cls(spark.createDataFrame([], "item_id long, vector array<double>, cell long"), np.zeros((0, 0)), 0)
        cells = min(n, MOST_CELLS, cells or max(1, int(CELL_FACTOR * n**0.5)))
        first = whole.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(cells).toArrow()  # bounded by MOST_CELLS
        centroids = _unit(matrix(first.column("vector")))
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(centroids)
            sums = whole.select("vector").mapInArrow(_cell_sums(shared), "cell long, n long, total array<double>").select("cell", F.posexplode("total").alias("d", "x")).groupBy("cell", "d").agg(F.sum("x").alias("x"))
            table = sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("total")).toArrow()  # a row per cell
            moved = centroids.copy()
            moved[table.column("cell").to_numpy()] = matrix(table.column("total"))
            moved, before = _unit(moved), centroids
            centroids = np.where((np.linalg.norm(moved, axis=1) > 0)[:, None], moved, before)
            shared.destroy()
            if np.abs(centroids - before).max() < 1e-9:
                break
        index = cls(whole, centroids, n)
        index.lists = materialize(whole.select("item_id", "vector").mapInArrow(_placed(index.shared), "item_id long, vector array<double>, cell long"), "inverted-lists")
        return index

    def top_k(self, queries: DataFrame, k: int, probes: int, digits: int = 6, packed: bool = False) -> DataFrame:
        """As exact_top_k, among the items of the `probes` lists whose centroids have the largest inner product with the
        query.  The lists pass by each block of queries, so neither pairs nor found rows are shuffled."""
        return exact_top_k(queries, self.lists, k, digits, block_items=LIST_ITEMS, packed=packed, admit=Probed(self.shared, probes) if self.n_items else None)

    def compared(self, queries: DataFrame, probes: int) -> float:
        """The share of all (query, item) pairs that a search compares."""
        live = _queries(queries)
        cells = live.select("query_id", "vector").mapInArrow(_nearest(self.shared, probes), "id long, cell long, place long")
        pairs = cells.join(self.lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").agg(F.sum("n")).first()[0] or 0
        return pairs / max(1, self.n_items * live.count())

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.97, sample: int = 256) -> int:
        """The least number of probes (by halving steps) with which `sample` queries, the first by hash,
        find the share `recall` of what exact search finds for them."""
        few = materialize(_queries(queries).orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "tried-queries")
        exact = materialize(exact_top_k(few, self.lists, k).select("query_id", "item_id"), "tried-exact")
        n = exact.count()
        # the place of each exact neighbour's cell in its query's order says how many probes find it
        cell = self.lists.select("item_id", "cell")
        order = few.select("query_id", "vector").mapInArrow(_nearest(self.shared, len(self.centroids)), "id long, cell long, place long").select(F.col("id").alias("query_id"), "cell", "place")
        places = exact.join(cell, "item_id").join(order, ["query_id", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row per cell
        total = 0
        for r in places:
            total += r["n"]
            if total >= recall * n:
                return r["place"] + 1
        return max(1, len(self.centroids))


def _buckets(vectors: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """Each table's bucket of a vector, and those of which the sign nearest to its plane differs, one of the
    `probes` nearest at a time."""
    tables, bits, _ = planes.shape
    weight = 1 << np.arange(bits)
    side = (vectors @ planes.reshape(tables * bits, -1).T).reshape(len(vectors), tables, bits)
    own = ((side > 0) * weight).sum(2) + (np.arange(tables) << bits)
    if not probes:
        return own
    near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, : min(probes, bits)]
    return np.concatenate([own[:, :, None], own[:, :, None] ^ weight[near]], axis=2).reshape(len(vectors), -1)


class Hashed:
    """Admits the items in one of a query's buckets."""

    def __init__(self, planes: np.ndarray, probes: int):
        self.planes, self.probes = planes, probes

    def asks(self, found: np.ndarray) -> np.ndarray:
        tables, bits, _ = self.planes.shape
        wanted = np.zeros((len(found), tables << bits), bool)
        wanted[np.arange(len(found))[:, None], _buckets(found, self.planes, self.probes)] = True
        return wanted

    def places(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The items' buckets, a row per table."""
        return _buckets(vectors, self.planes, 0).T

    def pairs(self, found: np.ndarray, asks: np.ndarray, place: np.ndarray) -> np.ndarray:
        # a bit per query: a bucket's queries are a few bytes, which its items take together
        asked = np.packbits(asks.T, axis=1)
        out = asked[place[0]]
        for own in place[1:]:
            out |= asked[own]
        return np.unpackbits(out, axis=1, count=len(found)).view(bool).T


def lsh_top_k(queries: DataFrame, items: DataFrame, k: int, tables: int = 24, bits: int = 6, seed: int = 7, digits: int = 6, probes: int = 4, packed: bool = False) -> DataFrame:
    """Approximate top k by random hyperplanes: query and item are compared if they agree
    in all signs of one of the tables, or in all but one of the query's `probes` signs that
    are nearest to change.  Same columns as exact_top_k, through whose blocks the items pass, so
    that pairs are no rows."""
    first = items.where("vector is not null").select(F.size("vector").alias("d")).first()
    planes = np.random.default_rng(seed).standard_normal((tables, bits, first["d"] if first else 1))
    return exact_top_k(queries, items, k, digits, packed=packed, admit=Hashed(planes, probes))
