"""Approximate nearest neighbours: a k-means tree searched best bin first.

The top of the tree is fitted on a sample of at most ``SAMPLE`` vectors and
broadcast; a leaf with more than ``SPLIT`` vectors gets a tree of its own, fitted
in Spark on about ``INNER`` of its vectors and never sent to the driver. Every
vector is filed under a leaf of a leaf. A query walks a tree through a priority
queue ordered by its distance to the nodes' centres, so leaves come nearest first.
How many it visits is calibrated at either level: ``CALIBRATE`` queries are answered
by brute force over all vectors, and the visits widen until ``RECALL`` of their true
neighbours lie in visited leaves. Equal vectors are one entry that carries its
smallest ids; more could never be among the k nearest.

Leaves next to each other in the tree make up cells of about ``LOAD`` vectors, and a
query goes to a cell once, with the leaves that it visits there. Cells are cut by
their own vectors and dealt out by their own queries, so one of any size is spread
over tasks and copied no oftener than it is asked for.

Defined results: vectors that are null, zero, hold a null or non-finite
component or differ in length from the commonest kind take no part; ties go to
the smaller id; rows that repeat an id with one vector are one candidate, with
several vectors they are candidates and queries of their own, and the nearest of
an id counts; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint

SAMPLE, CALIBRATE, RECALL, BRANCH, LOAD = 20_000, 128, 0.95, 8, 4096
#: Leaves of a tree to the root of the number of its vectors.
LEAVES = 4
#: Vectors above which a leaf is split again, and those that its tree is fitted on.
SPLIT, INNER = 4096, 2048
SEED = 42


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * (x @ centres.T)
        own = far.argmin(1)
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
    return own


def fit(x: np.ndarray, leaves: int) -> dict:
    """A k-means tree of about ``leaves`` leaves over distinct vectors, as plain arrays.

    Node ``i`` has centre ``centres[i]`` and ``number[i]`` children from ``first[i]``
    on; without any it is leaf ``leaf[i]``, which got ``rows[leaf[i]]`` of the vectors.
    """
    rng = np.random.default_rng(SEED)
    most = max(1, -(-len(x) // max(1, leaves)))
    centres, first, number, leaf, rows = [x.mean(0)], [0], [0], [-1], []
    work = [(0, np.arange(len(x)))]
    while work:
        node, inside = work.pop()
        own = _kmeans(x[inside], min(BRANCH, len(inside)), rng) if len(inside) > most else None
        if own is None or (own == own[0]).all():
            leaf[node] = len(rows)
            rows.append(len(inside))
            continue
        first[node] = len(centres)
        for j in np.unique(own):
            work.append((len(centres), inside[own == j]))
            centres.append(x[inside[own == j]].mean(0))
            first.append(0)
            number.append(0)
            leaf.append(-1)
        number[node] = len(centres) - first[node]
    return {"centres": np.array(centres), "first": np.array(first), "number": np.array(number), "leaf": np.array(leaf), "rows": np.array(rows)}


def file_under(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of every vector: the nearest child, down the tree."""
    out, work = np.empty(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
    while work:
        node, rows = work.pop()
        a, n = int(tree["first"][node]), int(tree["number"][node])
        if not n:
            out[rows] = tree["leaf"][node]
            continue
        c = tree["centres"][a : a + n]
        own = ((c**2).sum(1) - 2 * (x[rows] @ c.T)).argmin(1)
        work += [(a + j, rows[own == j]) for j in range(n) if (own == j).any()]
    return out


def best_bins(tree: dict, q: np.ndarray, visits: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
    """The leaves of a query, best bin first: ``visits`` of them and ``least`` rows in all."""
    centres, first, number, leaf = tree["centres"], tree["first"], tree["number"], tree["leaf"]
    queue, found, held = [(0.0, 0)], [], 0
    while queue and (len(found) < visits or held < least):
        _, node = heapq.heappop(queue)
        n = int(number[node])
        if not n:
            found.append(int(leaf[node]))
            held += int(rows[found[-1]]) if rows is not None else 0
            continue
        a = int(first[node])
        for j, d in enumerate(((centres[a : a + n] - q) ** 2).sum(1).tolist()):
            heapq.heappush(queue, (d, a + j))
    return found


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, distance) of the k nearest vectors and all that tie with the last.

    Products find the candidates, with room for rounding; differences measure them.
    """
    a, b, c = [], [], []
    k, squares = min(k, len(x)), (x**2).sum(1)
    for s in range(0, len(q), max(1, (1 << 20) // max(1, len(x)))):
        part = q[s : s + max(1, (1 << 20) // max(1, len(x)))]
        own = (part**2).sum(1)[:, None]
        d = own + squares - 2 * (part @ x.T)
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero(d <= last + 1e-12 * (own + squares.max()))
        exact = np.sqrt(((part[i] - x[j]) ** 2).sum(1))
        # Rows come in order, so each query's candidates are a run; those up to its k-th are left.
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        kth = np.array([np.partition(e, k - 1)[k - 1] for e in np.split(exact, starts[1:])])
        near = exact <= kth[np.cumsum(np.r_[False, i[1:] != i[:-1]])]
        a.append(i[near] + s)
        b.append(j[near])
        c.append(exact[near])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


FOUND = "query_id long, vec_id long, score double"
ROUTED = "query_id long, q array<double>, cell long, bins array<long>, leaf long"
FILED = "v array<double>, ids array<long>, leaf long, cell long, bin long"
#: The cells of a leaf that is split are numbered from here on.
WITHIN = 1 << 20


def _split(filed: DataFrame, counts: DataFrame, dim: int, split: int) -> DataFrame:
    """``(leaf, tree)`` for every leaf of more than ``split`` vectors."""
    big = counts.filter(F.col("count") > split)
    # A hash picks about ``INNER`` vectors of each leaf, so no task holds more, however large the leaf.
    some = filed.join(big, "leaf").filter(F.pmod(F.xxhash64("v", F.lit(SEED)), F.col("count")) < INNER)

    def one(table: pa.Table) -> pa.Table:
        x, count = _matrix(table.column("v"), dim), table.column("count")[0].as_py()
        tree = fit(x, max(1, min(int(LEAVES * count**0.5), len(x) // 4)))
        tree["cells"] = np.arange(len(tree["rows"])) * max(1, -(-count // LOAD)) // len(tree["rows"])
        return pa.table({"leaf": pa.array([table.column("leaf")[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return checkpoint(some.select("leaf", "count", "v").groupBy("leaf").applyInArrow(one, "leaf long, tree binary"))


def _dealt(rows: DataFrame, trees: DataFrame, load: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` by leaf in parts of about ``load``, and the trees once for each part."""
    sizes = rows.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / load).cast("int").alias("parts"))
    sizes = checkpoint(sizes)
    dealt = rows.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64(rows.columns[0]), F.col("parts")).cast("int")).drop("parts")
    copies = trees.join(sizes, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt, copies


def search(vectors: DataFrame, every: int = 100, k: int = 10, split: int = SPLIT, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    raw = raw.filter(F.col("vec_id").isNotNull() & F.coalesce(whole & F.exists("v", lambda x: x != 0), F.lit(False)))
    shape = raw.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = shape["n"]
    # -0.0 and 0.0 are one value.
    raw = raw.filter(F.size("v") == dim).withColumn("v", F.transform("v", lambda x: x + 0.0))
    # Equal vectors are one entry with its k + 1 smallest ids; the window keeps no more per task.
    by = Window.partitionBy("v").orderBy("vec_id")
    few = raw.distinct().withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    entries = checkpoint(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()

    picked = entries.orderBy(F.xxhash64("v")).limit(sample).select("v").toArrow()
    points = _matrix(picked.column("v"), dim)
    # Plain arrays, so executors need no copy of this package.
    tree = spark.sparkContext.broadcast(fit(points, max(1, min(int(LEAVES * total**0.5), len(points) // 4))))
    leaves = len(tree.value["rows"])

    def file(batches):
        for b in batches:
            own = file_under(tree.value, _matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), pa.array(own)], ["v", "ids", "leaf"])

    filed = checkpoint(entries.mapInArrow(file, "v array<double>, ids array<long>, leaf long"))
    counts = checkpoint(filed.groupBy("leaf").count())
    held = np.zeros(leaves, dtype=np.int64)
    for r in counts.collect():  # a row a leaf of the top, sample / 4 at most
        held[r["leaf"]] = r["count"]
    trees = _split(filed, counts, dim, split) if held.max() > split else None
    # Leaves are numbered down the tree, so those of a cell are near each other.
    whole = np.where(held > split, 0, held)
    cell = (np.cumsum(whole) - whole) // LOAD
    numbers = spark.createDataFrame([(n, int(c)) for n, c in enumerate(cell)], "leaf long, cell long")
    cells = filed.join(F.broadcast(numbers), "leaf").select("v", "ids", "leaf", "cell", F.col("leaf").alias("bin"))
    if trees is not None:
        cells = checkpoint(_file_inner(cells, trees, dim))

    queries = raw.filter(F.col("vec_id") % every == 0).distinct()
    true, sampled = _true_places(cells, queries, tree.value, dim, k)
    visits = _quantile([place for _, place, _, _ in true]) + 1

    def route(batches):
        """Each query to every cell that it visits, and to every leaf with a tree of its own."""
        for b in batches:
            rows, at, bins, split_leaf = [], [], [], []
            for i, q in enumerate(_matrix(b.column("v"), dim)):
                by: dict[int, list[int]] = {}
                for leaf in best_bins(tree.value, q, visits, held, 4 * k + 1):
                    if held[leaf] > split:
                        rows.append(i), at.append(None), bins.append([]), split_leaf.append(leaf)
                    else:
                        by.setdefault(int(cell[leaf]), []).append(leaf)
                for c, leaves in by.items():
                    rows.append(i), at.append(c), bins.append(leaves), split_leaf.append(None)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(taken), b.column("v").take(taken), pa.array(at, pa.int64()), pa.array(bins, pa.list_(pa.int64())), pa.array(split_leaf, pa.int64())],
                ["query_id", "q", "cell", "bins", "leaf"],
            )

    routed = checkpoint(queries.mapInArrow(route, ROUTED))
    if trees is not None:
        routed = checkpoint(_route_inner(routed, trees, dim, _inner_visits(sampled, true, visits, trees), 4 * k + 1))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        names, ids = left.column("query_id").to_numpy(), right.column("ids").to_pylist()
        q, x, own = _matrix(left.column("q"), dim), _matrix(right.column("v"), dim), right.column("bin").to_numpy()
        asked: dict[int, list[int]] = {}
        for row, bins in enumerate(left.column("bins").to_pylist()):
            for n in bins:
                asked.setdefault(n, []).append(row)
        order = np.argsort(own, kind="stable")
        kinds, starts = np.unique(own[order], return_index=True)
        out = []
        for n, rows in zip(kinds.tolist(), np.split(order, starts[1:])):
            if n in asked:
                who = np.array(asked[n])
                i, j, d = nearest(q[who], x[rows], k + 1)
                out += [(names[who[a]], v, s) for a, b, s in zip(i.tolist(), rows[j].tolist(), d.tolist()) for v in ids[b] if v != names[who[a]]]
        out.sort(key=lambda x: (x[0], x[2], x[1]))
        kept, last, n = [], None, 0
        for x in out:
            n = n + 1 if x[0] == last else 0
            last = x[0]
            if n < k:
                kept.append(x)
        if not kept:
            return none
        a, b, c = zip(*kept)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    # A cell is cut by its own vectors and dealt by its own queries.
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).join(routed.groupBy("cell").agg(F.count("*").alias("asked")), "cell")
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / (4 * LOAD))).cast("int")
    sizes = checkpoint(sizes.select("cell", cut("n").alias("parts"), cut("asked").alias("deals")))
    placed = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    placed = placed.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("cell", "part", "deal", "v", "ids", "bin")
    routed = routed.join(sizes, "cell").withColumn("deal", F.pmod(F.xxhash64("query_id"), F.col("deals")).cast("int"))
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "deal", "query_id", "q", "bins")
    key = ["cell", "part", "deal"]
    found = routed.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(block, FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # An id counts once, at its nearest; every cell has given its k nearest.
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _file_inner(filed: DataFrame, trees: DataFrame, dim: int) -> DataFrame:
    """``filed`` with cell and bin by the tree of their leaf, where it has one."""
    big = filed.join(trees.select("leaf"), "leaf", "left_semi").select("v", "ids", "leaf")
    rows, copies = _dealt(big, trees, LOAD)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = pickle.loads(right.column("tree")[0].as_py())
        own = file_under(tree, _matrix(left.column("v"), dim))
        cell = (left.column("leaf").to_numpy() + 1) * WITHIN + tree["cells"][own]
        return left.select(["v", "ids", "leaf"]).append_column("cell", pa.array(cell, pa.int64())).append_column("bin", pa.array(own, pa.int64()))

    inner = rows.groupBy("leaf", "part").cogroup(copies.groupBy("leaf", "part")).applyInArrow(one, FILED)
    return inner.unionByName(filed.join(trees.select("leaf"), "leaf", "left_anti"))


def _route_inner(routed: DataFrame, trees: DataFrame, dim: int, visits: int, least: int) -> DataFrame:
    """``routed`` with the cells and bins that a query visits within leaves that have a tree."""
    rows, copies = _dealt(routed.filter("cell is null").select("query_id", "q", "leaf"), trees, LOAD)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, leaf = pickle.loads(right.column("tree")[0].as_py()), right.column("leaf")[0].as_py()
        at, cells, bins = [], [], []
        for i, q in enumerate(_matrix(left.column("q"), dim)):
            by: dict[int, list[int]] = {}
            # The vectors that the tree was fitted on lie in its leaves, so these hold ``least`` at least.
            for own in best_bins(tree, q, visits, tree["rows"], least):
                by.setdefault(int(tree["cells"][own]), []).append(own)
            for cell, found in by.items():
                at.append(i), cells.append((leaf + 1) * WITHIN + cell), bins.append(found)
        taken = left.select(["query_id", "q"]).take(pa.array(at, pa.int64()))
        taken = taken.append_column("cell", pa.array(cells, pa.int64())).append_column("bins", pa.array(bins, pa.list_(pa.int64())))
        return taken.append_column("leaf", pa.array([leaf] * len(at), pa.int64()))

    inner = rows.groupBy("leaf", "part").cogroup(copies.groupBy("leaf", "part")).applyInArrow(one, ROUTED)
    return inner.unionByName(routed.filter("cell is not null"))


def _true_places(cells: DataFrame, queries: DataFrame, tree: dict, dim: int, k: int) -> tuple[list[tuple], np.ndarray]:
    """For a few queries, (query, place of the leaf in its order, leaf, bin) of each true neighbour; and the queries."""
    some = queries.orderBy(F.xxhash64("vec_id")).limit(CALIBRATE).select("v").toArrow()
    if not some.num_rows:
        return [], np.empty((0, dim))
    q = _matrix(some.column("v"), dim)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                i, j, d = nearest(q, _matrix(b.column("v"), dim), k + 1)
                leaf, own = (b.column(c).to_numpy()[j] for c in ("leaf", "bin"))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(leaf), pa.array(own), pa.array(d)], ["i", "leaf", "bin", "d"])

    near = cells.select("v", "leaf", "bin").mapInArrow(scan, "i long, leaf long, bin long, d double")
    by = Window.partitionBy("i").orderBy("d", "leaf", "bin")
    rows = near.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1).collect()  # k + 1 a query
    leaves = len(tree["rows"])
    place = [{leaf: n for n, leaf in enumerate(best_bins(tree, x, leaves))} for x in q]
    return [(r["i"], place[r["i"]][r["leaf"]], r["leaf"], r["bin"]) for r in rows], q


def _quantile(ranks: list[int]) -> int:
    """The rank up to which ``RECALL`` of all lie."""
    ranks = sorted(ranks) or [0]
    return ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))]


def _inner_visits(q: np.ndarray, true: list[tuple], visits: int, trees: DataFrame) -> int:
    """Leaves to visit within a leaf so that ``RECALL`` of the true neighbours in visited leaves are met."""
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i, place, leaf, sub in true:
        if place < visits:
            wanted.setdefault(leaf, []).append((i, sub))

    def one(table: pa.Table) -> pa.Table:
        tree, out = pickle.loads(table.column("tree")[0].as_py()), []
        for i, sub in wanted.get(table.column("leaf")[0].as_py(), ()):
            out.append(best_bins(tree, q[i], len(tree["rows"])).index(sub))
        return pa.table({"place": pa.array(out, pa.int64())})

    if not wanted:
        return 1
    asked = trees.filter(F.col("leaf").isin(list(wanted)))
    return _quantile([r["place"] for r in asked.groupBy("leaf").applyInArrow(one, "place long").collect()]) + 1
