"""Ranked lexical search: exact maximum inner products by sparse ball trees.

A document is a sparse vector of integer impacts, one a term, a query one of
integer term weights; the score is their inner product. Tasks cut the documents
they read into trees of a bounded size. A tree is split at the median between
two far documents down to leaves of LEAF documents. The terms' space is cut into
subspaces of SPAN terms; each node has, per subspace, the centroid of its
documents and the radius of the ball around it that holds them all. No document
of a node scores more than

    sum over terms of weight * centroid + sum over subspaces of |weights| * radius

which follows from Cauchy-Schwarz in each subspace. The sum is rounded up by
more than its floating-point error can be, so a node is passed over only if
none of its documents can enter the result. Nodes are taken best bound first,
and a query's search in a tree ends when the best bound left is under its k-th
score so far, which it takes along from tree to tree. Leaves are scored in whole
numbers.

Queries are a stated set. They are cut into blocks of at most BLOCK_QUERIES with
BLOCK_TERMS distinct terms (or one longer query), a block is searched against all
rows, and what is sent to tasks is that block. Only terms of the block's queries make
coordinates; the statistics cover all documents and all their terms. Documents
aren't shuffled: tasks return their best k of each query.

Null texts, of documents or queries, have no term; such documents count in no
statistic and queries without terms have no rows. A null id of a document is a
result like others, after all ids of the same score. Repeated documents are
ranked each. Queries are rows: a repeated one has its own ranks, under its id.
Texts are read in stretches of a megabyte of words. Other columns of the inputs
aren't read, so they can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.common import cut_lineage, spread_scan, texts_of
from strandwise.llm.terms import word_lists

#: Distinct terms of a block of queries.
BLOCK_TERMS = 8192
#: Queries of a block.
BLOCK_QUERIES = 4096
#: Documents of a leaf, of a tree at most, and terms of a subspace.
LEAF = 8
TREE_DOCS = 4096
SPAN = 4
#: Numbers that the centroids of a tree may take; more terms make smaller trees.
TREE_CELLS = 8 << 20
#: Non-zero coordinates of a tree, beyond which it takes no further document.
TREE_ENTRIES = 4 << 20


def term_counts(text: bytes) -> Counter:
    counts: Counter = Counter()
    for words in word_lists(text):
        counts.update(words)
    return counts


def _query_terms(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """`_id, _terms`: the distinct terms of each query."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(term_counts(t)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["_id", "_terms"]
            )

    kind = queries.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_terms", T.ArrayType(T.BinaryType()))])
    return queries.select(id_col, text).mapInArrow(terms, schema)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """Query ids, their terms by number, and the numbers, a block at a time."""
    ids: list = []
    rows: list[list[int]] = []
    numbers: dict[bytes, int] = {}
    for row in queries.toLocalIterator():
        terms = [bytes(t) for t in row["_terms"]]
        if not terms:
            continue
        width = len(numbers) + sum(t not in numbers for t in terms)
        if rows and (width > BLOCK_TERMS or len(rows) >= BLOCK_QUERIES):
            yield ids, rows, numbers
            ids, rows, numbers = [], [], {}
        ids.append(row["_id"])
        rows.append([numbers.setdefault(t, len(numbers)) for t in terms])
    if rows:
        yield ids, rows, numbers


def term_vectors(docs: DataFrame, id_col: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """`_id, _n, _terms, _counts`: all terms of each document counted, those with a number listed."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            sizes, terms, tfs, offsets = [], [], [], [0]
            for t in texts_of(batch.column(1)):
                counts = term_counts(t)
                sizes.append(counts.total())
                own = sorted((known[w], c) for w, c in counts.items() if w in known)
                terms.extend(x for x, _ in own)
                tfs.extend(c for _, c in own)
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_n", "_terms", "_counts"])

    kind = docs.schema[id_col].dataType
    ddl = T.StructType.fromDDL("_n BIGINT, _terms ARRAY<INT>, _counts ARRAY<BIGINT>")
    schema = T.StructType([T.StructField("_id", kind), *ddl.fields])
    return spread_scan(docs.select(id_col, text)).mapInArrow(counted, schema)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, n: int, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impacts of one document's terms, falling with its length."""
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class BallTree:
    """A tree over sparse vectors, given as rows of entries (term, impact)."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, span: int = SPAN):
        self.span, self.width = span, width
        self.rows = np.arange(len(starts) - 1)
        self.starts, self.terms, self.values = starts, terms, values
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left and right child (0: a leaf)
        self.centroids: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self._grow(0, len(self.rows))
        self.centroid, self.radius = np.array(self.centroids), np.array(self.radii)
        self.centroids, self.radii = [], []

    def _ball(self, first: int, end: int) -> None:
        a, b = self.starts[first], self.starts[end]
        terms, x, count = self.terms[a:b], self.values[a:b].astype(np.float64), end - first
        c = np.bincount(terms, x, self.width) / count
        groups = -(-self.width // self.span)
        mass = np.bincount(np.arange(self.width) // self.span, c * c, groups)
        # Squared distance to the centroid in each (row, subspace) that has entries; |c|^2 elsewhere.
        row = np.repeat(np.arange(count), np.diff(self.starts[first : end + 1]))
        key = row * groups + terms // self.span
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        group = key[begins] % groups
        far = np.zeros(groups)
        if len(begins):
            squares = np.add.reduceat(x * x, begins)
            apart = squares - 2 * np.add.reduceat(x * c[terms], begins) + mass[group]
            # More than the rounding error of any of these sums.
            np.maximum.at(far, group, apart + 1e-9 * (squares + mass[group]))
        far = np.where(np.bincount(group, minlength=groups) < count, np.maximum(far, mass * (1 + 1e-9)), far)
        self.centroids.append(c)
        self.radii.append(np.sqrt(np.maximum(far, 0)))

    def _order(self, first: int, end: int, order: np.ndarray) -> None:
        """Put the rows of a node into another order."""
        a, b = self.starts[first], self.starts[end]
        sizes = np.diff(self.starts[first : end + 1])[order]
        begins = self.starts[first:end][order]
        at = np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(b - a)
        self.terms[a:b], self.values[a:b] = self.terms[at], self.values[at]
        self.starts[first + 1 : end + 1] = a + np.cumsum(sizes)
        self.rows[first:end] = self.rows[first:end][order]

    def _distances(self, first: int, end: int, to: np.ndarray) -> np.ndarray:
        """Squared distances to a dense vector, less its own square."""
        a, b = self.starts[first], self.starts[end]
        x = self.values[a:b].astype(np.float64)
        return np.add.reduceat(x * x - 2 * x * to[self.terms[a:b]], self.starts[first:end] - a)

    def _dense(self, row: int) -> np.ndarray:
        a, b = self.starts[row], self.starts[row + 1]
        return np.bincount(self.terms[a:b], self.values[a:b], self.width)

    def _grow(self, first: int, end: int) -> int:
        node = len(self.nodes)
        self.nodes.append((first, end, 0, 0))
        self._ball(first, end)
        if end - first > LEAF:
            one = self._dense(first + int(np.argmax(self._distances(first, end, self.centroids[node]))))
            to_one = self._distances(first, end, one)
            other = self._dense(first + int(np.argmax(to_one)))
            self._order(first, end, np.argsort(to_one - self._distances(first, end, other), kind="stable"))
            middle = (first + end) // 2
            left = self._grow(first, middle)
            self.nodes[node] = (first, end, left, self._grow(middle, end))
        return node

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node, a number that no inner product of its rows exceeds."""
        groups, at = np.unique(terms // self.span, return_inverse=True)
        norms = np.sqrt(np.bincount(at, weights * weights))
        bound = self.centroid[:, terms] @ weights + self.radius[:, groups] @ norms
        return bound * (1 + 1e-9) + 1

    def scores(self, node: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of a leaf; `dense` holds a weight by term."""
        first, end, _, _ = self.nodes[node]
        a, b = self.starts[first], self.starts[end]
        products = dense[self.terms[a:b]] * self.values[a:b]
        return self.rows[first:end], np.add.reduceat(products, self.starts[first:end] - a)

    def search(self, query: Best, dense: np.ndarray) -> int:
        """Add the best rows to `query`, best bound first; the number of rows scored."""
        bound = self.bounds(query.terms, query.weights)
        queue, scored = [(-bound[0], 0)], 0
        while queue and -queue[0][0] >= query.least:
            _, node = heappop(queue)
            _, _, left, right = self.nodes[node]
            if left:
                for child in (left, right):
                    heappush(queue, (-min(bound[child], bound[node]), child))
                continue
            rows, scores = self.scores(node, dense)
            scored += len(rows)
            for i in np.flatnonzero(scores >= query.least):
                query.add(int(scores[i]), int(rows[i]))
        return scored


class Best:
    """A query with its k best documents so far; scores above 0 only."""

    def __init__(self, terms: list[int], weights: np.ndarray, k: int):
        self.terms, self.k = np.array(terms, np.int64), k
        self.weights = weights[self.terms].astype(np.float64)
        self.found: list[tuple] = []  # (-score, id is null, id)
        self.least = 1
        self.ids: Sequence = ()

    def add(self, score: int, row: int) -> None:
        key = self.ids[row]
        self.found.append((-score, key is None, 0 if key is None else key))
        self.found.sort()
        del self.found[self.k :]
        if len(self.found) == self.k:
            self.least = -self.found[-1][0]


def _trees(batches: Iterator[pa.RecordBatch], width: int, n_docs: int, n_terms: int) -> Iterator[tuple[list, BallTree]]:
    """Trees over the documents of a task, with their ids; documents without a coordinate score 0."""
    most = max(LEAF, min(TREE_DOCS, TREE_CELLS // width * LEAF // 4))
    ids, sizes, terms, values, entries = [], [], [], [], 0

    def tree() -> tuple[list, BallTree]:
        starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        return ids, BallTree(starts, np.concatenate(terms), np.concatenate(values), width)

    for batch in batches:
        own = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))
        for key, n, term, count in own:
            term, count = term.values.to_numpy(), count.values.to_numpy()
            if not len(term):
                continue
            ids.append(key)
            sizes.append(len(term))
            terms.append(term.astype(np.int64))
            values.append(impacts(count, n, n_docs, n_terms))
            entries += len(term)
            if len(ids) >= most or entries >= TREE_ENTRIES:
                yield tree()
                ids, sizes, terms, values, entries = [], [], [], [], 0
    if ids:
        yield tree()


def _search(spark: SparkSession, vectors: DataFrame, rows: list[list[int]], numbers: dict[bytes, int], k: int, tally) -> DataFrame:
    """`_query` (place in the block), `_id`, `_score`: the best k of each task."""
    total = vectors.agg(F.count(F.when(F.col("_n") > 0, 1)), F.sum("_n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    held = vectors.select(F.explode("_terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = np.full(len(numbers), term_weight(n_docs, 0), np.int64)
    for row in held.collect():  # a row a term of the block at most
        weights[row["t"]] = term_weight(n_docs, row["df"])
    sent = spark.sparkContext.broadcast((rows, weights))
    kind = vectors.schema["_id"].dataType
    schema = T.StructType(
        [T.StructField("_query", T.IntegerType()), T.StructField("_id", kind), T.StructField("_score", T.LongType())]
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows, weights = sent.value
        queries = [Best(terms, weights, k) for terms in rows]
        dense = np.zeros(len(weights), np.int64)
        for ids, tree in _trees(batches, len(weights), n_docs, n_terms):
            scored = 0
            for query in queries:
                query.ids = ids
                dense[query.terms] = weights[query.terms]
                scored += tree.search(query, dense)
                dense[query.terms] = 0
            if tally is not None:
                tally.add(np.array([scored, len(ids) * len(queries)]))
        out = [(i, None if null else key, -score) for i, q in enumerate(queries) for score, null, key in q.found]
        arrow = to_arrow_schema(schema)
        columns = [pa.array([r[j] for r in out], arrow.field(j).type) for j in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return vectors.mapInArrow(best, schema)


def top_documents(
    docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text", k: int = 10, tally=None
) -> DataFrame:
    """`query_id, rank, id, score`: the k best documents of each query, equal scores by ascending id.

    `tally`, an accumulator of arrays, gets the numbers of pairs that were
    scored and of pairs in all. Each block of queries reads the documents once.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType, queries.schema[query_id].dataType
    out = None
    for ids, rows, numbers in _blocks(cut_lineage(_query_terms(queries, query_id, text))):
        vectors = cut_lineage(term_vectors(docs, doc_id, text, numbers))
        found = _search(spark, vectors, rows, numbers, k, tally)
        order = Window.partitionBy("_query").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        schema = T.StructType([T.StructField("_query", T.IntegerType()), T.StructField("query_id", kinds[1])])
        names = spark.createDataFrame(list(enumerate(ids)), schema)
        part = ranked.join(names, "_query").select(
            "query_id", "rank", F.col("_id").alias("id"), F.col("_score").alias("score")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        fields = [("query_id", kinds[1]), ("rank", T.IntegerType()), ("id", kinds[0]), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
    return out
