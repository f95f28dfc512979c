"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Entries are searched through a geometric near-neighbour access tree (GNAT). A node holds split
points; every other point below it belongs to the child of its nearest split point, and the node
knows, for each child and split point, the range of distances between them. A query at distance d
from a split point, with its best entry so far at r, can only find something as near in a child
whose range meets [d - r, d + r]; the others are left out with all they hold.

Coordinates are integers, so distances between squares are exact. Only the test of ranges uses
roots; these are widened by far more than their rounding, and a child at equal distance is never
left out, so ties are decided on integers, for the lower entry.

Training passes over the vectors once a round; what leaves a task is one sum per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkmill.llm.common import by_value, free_name, same, staged

by_value(__name__)

#: Split points of a node; a node with so many points or fewer has no children.
DEGREE = 24
#: Roots are compared with this relative allowance; their rounding errors are near 2^-53.
SLACK = 2.0 ** -40

SUMS = "part int, entry int, n long, sums array<long>"
CODES = "vec_id long, label {label}, code string, error long"


def _bound(queries: np.ndarray, points: np.ndarray) -> int:
    """No squared distance, nor a term of one, is larger."""
    if not queries.size or not points.size:
        return 0
    widest = 2 * max(int(queries.max()), -int(queries.min()), int(points.max()), -int(points.min()))
    return queries.shape[1] * widest * widest


def squares(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all queries to a few points, as integers."""
    if not queries.size or not points.size:
        return np.zeros((len(queries), len(points)), np.int64)
    bound = _bound(queries, points)
    if bound < 1 << 53:  # every term and sum is a whole number that doubles hold exactly
        q, p = queries.astype(np.float64), points.astype(np.float64)
        return ((q * q).sum(1)[:, None] - 2 * (q @ p.T) + (p * p).sum(1)).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("components are too large for squared distances in 64 bits")
    return np.stack([((queries - p) ** 2).sum(1) for p in points], axis=1)


class Gnat:
    """Tree over the rows of an integer matrix."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._node(np.arange(len(points)))

    def _node(self, members: np.ndarray) -> tuple:
        """(split points, children or None, nearest and farthest distance of each child from each split point)."""
        if len(members) <= DEGREE:
            return members, None, None, None
        # Each split point is the one farthest from those before it.
        splits = [0]
        nearest = squares(self.points[members], self.points[members[:1]])[:, 0]
        if not nearest.any():  # equal points: the lowest index stands for all
            return members[:1], None, None, None
        while len(splits) < DEGREE:
            splits.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squares(self.points[members], self.points[members[splits[-1:]]])[:, 0])
        own = np.unique(splits)
        rest = np.delete(members, own)
        chosen = members[own]
        away = squares(self.points[rest], self.points[chosen])
        owner = away.argmin(1)
        children, low, high = [], np.zeros((len(own), len(own))), np.zeros((len(own), len(own)))
        for j in range(len(own)):
            mine = owner == j
            children.append(self._node(rest[mine]) if mine.any() else None)
            if mine.any():
                low[j], high[j] = np.sqrt(away[mine].min(0)), np.sqrt(away[mine].max(0))
        return chosen, children, low, high

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the index of the nearest point, lowest on ties, and its squared distance."""
        where = np.zeros(len(queries), np.int64)
        if not len(queries):
            return where, where
        points = self.points
        if _bound(queries, points) < 1 << 53:
            # Whole numbers in doubles: products are fast, sums and comparisons stay exact.
            q, p = queries.astype(np.float64), points.astype(np.float64)
            q_norm, p_norm, best = (q * q).sum(1), (p * p).sum(1), np.full(len(queries), np.inf)

            def away(rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
                out = q[rows] @ p[chosen].T
                out *= -2
                out += q_norm[rows, None]
                out += p_norm[chosen]
                return out
        else:
            best = np.full(len(queries), np.iinfo(np.int64).max)

            def away(rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
                return squares(queries[rows], points[chosen])

        self._search(self.root, away, np.arange(len(queries)), best, where)
        return where, best.astype(np.int64)

    def _search(self, node: tuple, distances, rows: np.ndarray, best: np.ndarray, where: np.ndarray) -> None:
        chosen, children, low, high = node
        away = distances(rows, chosen)
        first = away.argmin(1)  # members ascend, so this is the lowest index among equals
        found, index = away[np.arange(len(rows)), first], chosen[first]
        better = (found < best[rows]) | ((found == best[rows]) & (index < where[rows]))
        best[rows[better]], where[rows[better]] = found[better], index[better]
        if children is None:
            return
        away, radius = np.sqrt(away), np.sqrt(found)
        for nearest_first in (True, False):
            for j, child in enumerate(children):
                if child is None:
                    continue
                asked = np.flatnonzero((first == j) == nearest_first)
                # The child's own split point and the one nearest to the query decide; testing the others costs more than it saves.
                own, near, r, by = away[asked, j], radius[asked], np.sqrt(best[rows[asked]]), first[asked]
                allowance = (own + near + r + high[j].max()) * SLACK
                out = (own - r > high[j, j] + allowance) | (near + r < low[j, by] - allowance) | (near - r > high[j, by] + allowance)
                asked = asked[~out]
                if len(asked):
                    self._search(child, distances, rows[asked], best, where)


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, width)


def integer_vectors(
    vectors: DataFrame, parts: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> DataFrame:
    """(vec_id, label, point): components floor(scale * x), with zeros behind up to a multiple of ``parts``.

    Rows go whose vector is null or holds a null, NaN or infinite component.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    point = F.transform(x, lambda v: F.floor(v * float(scale)).cast("long"))
    spare = F.pmod(-F.size(point), F.lit(parts))
    label: Column = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), F.concat(point, F.array_repeat(F.lit(0).cast("long"), spare)).alias("point"),
    )


def first_points(points: DataFrame, entries: int = 256) -> np.ndarray:
    """Points of the smallest ids (equal ids: by components; null ids last), all as long as the first."""
    rows = points.select("vec_id", "point").orderBy(F.col("vec_id").asc_nulls_last(), "point")
    first = rows.limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    width = len(first[0].point)
    held = rows.where(F.size("point") == width).limit(entries).collect()
    return np.array([r.point for r in held], np.int64).reshape(len(held), width)


def train_codebooks(points: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks, as integers by (part, entry, position), after so many rounds of assigning and averaging.

    A round reads the points once; a task sends one sum for each part and entry it has met, and
    the driver receives parts * entries rows. Entries without points stay as they are.
    """
    start = first_points(points, entries)
    if not len(start):
        return np.zeros((parts, 0, 0), np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    points = points.where(F.size("point") == parts * width).select("point")
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            trees = [Gnat(b) for b in books]
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                matrix = _matrix(batch.column(0), parts, width)
                for p, tree in enumerate(trees):
                    entry, _ = tree.nearest(matrix[:, p])
                    order = np.argsort(entry, kind="stable")
                    met, begin = np.unique(entry[order], return_index=True)
                    if len(met):
                        n[p, met] += np.diff(np.append(begin, len(order)))
                        total[p, met] += np.add.reduceat(matrix[order, p], begin, axis=0)
            part, entry = np.nonzero(n)
            if len(part):
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64())),
                ], names=["part", "entry", "n", "sums"])

        met = points.mapInArrow(sums, SUMS).groupBy("part", "entry").agg(F.sum("n"), *(F.sum(F.col("sums")[i]) for i in range(width)))
        books = books.copy()
        for part, entry, n, *total in met.collect():
            books[part, entry] = [t // n for t in total]
    return books


def coded(points: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): entry numbers in hexadecimal, two digits a part, and the summed squared distance."""
    parts, entries, width = books.shape
    names = [f"{i:02x}" for i in range(max(entries, 1))]
    schema = CODES.format(label=points.schema["label"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            matrix = _matrix(batch.column(2), parts, width)
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for p, tree in enumerate(trees):
                entry, away = tree.nearest(matrix[:, p])
                code += np.array(names, object)[entry]
                error += away
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return points.where(F.size("point") == parts * width).select("vec_id", "label", "point").mapInArrow(run, schema)


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, code, error) and the codebooks they refer to.

    Vectors that are null or hold a null or non-finite component go. Vectors shorter or longer than
    that of the smallest kept id belong to another space and go as well; a length that is no
    multiple of ``parts`` is filled with zeros. Ids may be null or repeat, every row gets its code;
    with fewer vectors than entries there are fewer entries, an empty table gives no rows. Squared
    distances must fit 64 bits, else an error says so. The driver holds the codebooks, parts *
    entries rows whatever the table.
    """
    points = staged(integer_vectors(vectors, parts, scale, id_col, vector_col, label_col), "vectors")
    books = train_codebooks(points, parts, entries, rounds)
    return staged(coded(points, books), "codes"), books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error sums over equal labels, nulls together.

    Labels are summed before they meet the rows; the sums are one row a label.
    """
    other = free_name(codes.columns, "label_of")
    sums = codes.groupBy(F.col("label").alias(other)).agg(F.sum("error").alias("label_error"))
    joined = codes.join(sums, same([F.col("label")], [F.col(other)]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
