"""Approximate nearest neighbours by NN-descent and greedy graph search.

Index: equal vectors are one node. First lists come from sorting the nodes by the signs of random
hyperplanes and comparing runs of neighbours in that order. Then NN-descent rounds follow (Dong et al.
2011): every node introduces its neighbours and a sample of those that list it to each other, and lists
keep the nearest. A round is a chain of joins on node ids; candidates that cannot enter a list are
dropped where they are found. Only pairs with a member that is new to a list are compared.

Search: all queries walk the graph at once. Each hop joins the nearest unexpanded nodes of every query
with their links and computes exact distances, until the nearest ``BEAM`` nodes of every query are all
expanded, however many hops that takes. A query that ends with fewer results than there are candidates
is scanned exactly against all rows, in blocks of ``BLOCK`` queries.

Every vector is indexed. Links are compared on vectors in single precision, less the mean of all and
divided by the largest magnitude, so that neither size nor offset makes different vectors equal.
Results are Euclidean distances, in double precision on the original numbers.

Skew: a group of equal vectors gives one node and its ten smallest ids; how often a node is listed is
counted with partial sums and sampled down before links are gathered, as NN-descent prescribes.

Edge cases: null or zero vectors, those that hold null or non-finite numbers, and those not of the most
common length take no part, as neither queries nor candidates; rows with a null id likewise; ties go to
the smaller id; an id on several rows counts once (least vector); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, read_table, width

LINKS, TREES, RUN, ROUNDS = 32, 6, 160, 10
BEAM, EXPAND, TOP, BLOCK = 160, 28, 10, 2_000


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list<float> column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def units(column: pa.Array) -> np.ndarray:
    """Rows of a column of single-precision numbers as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def squared(x: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of a small matrix."""
    x = x.astype(np.float64)  # differences of near rows far from the origin would be lost
    s = (x * x).sum(1)
    return np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)


def compact(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, unit): vectors less their mean, by the largest magnitude, in single precision as bytes.
    The statistics are one number and ``dim`` rows."""
    top = nodes.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    scale = float(top or 1.0)
    means = nodes.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x") / F.lit(scale)).alias("m")).collect()
    mean = np.zeros(dim)
    for r in means:
        mean[r["at"]] = r["m"]

    def run(batches):
        for batch in batches:
            x = (matrix(batch.column(1)) / scale - mean).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "unit"])

    return nodes.select("id", "vector").mapInArrow(run, "id long, unit binary")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array<float or double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0))
    return rows


def first_lists(unit: DataFrame, dim: int) -> DataFrame:
    """(id, nbr, d) from runs of neighbours in several sorted orders."""
    spark = unit.sparkSession
    out = None
    for tree in range(TREES):
        planes = np.random.default_rng(100 + tree).normal(size=(dim, 16))

        def code(batches, planes=planes):
            for batch in batches:
                bits = units(batch.column(1)) @ planes > 0
                # Gray order: neighbouring codes differ in few bits.
                value = np.zeros(len(bits), np.int64)
                for j in range(bits.shape[1]):
                    value = value * 2 + (bits[:, j] ^ (value & 1).astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column(0), batch.column(1)], ["code", "id", "unit"])

        def compare(batches):
            held, rows = [], 0

            def lists(table):
                ids, x = table.column("id").to_numpy(), units(table.column("unit"))
                for s in range(0, len(ids), RUN):
                    e = min(s + RUN, len(ids))
                    s = max(0, min(s, e - RUN))
                    d = squared(x[s:e])
                    np.fill_diagonal(d, np.inf)
                    k = min(LINKS, e - s - 1)
                    if k < 1:
                        continue
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    own = np.repeat(ids[s:e], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[s:e][near.ravel()]), pa.array(np.take_along_axis(d, near, 1).ravel().astype(np.float32))], ["id", "nbr", "d"])

            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= 64 * RUN:
                    yield from lists(pa.Table.from_batches(held))
                    held, rows = [], 0
            if rows:
                yield from lists(pa.Table.from_batches(held))

        coded = unit.select("id", "unit").mapInArrow(code, "code long, id long, unit binary")
        found = coded.repartitionByRange(width(spark), "code", "id").sortWithinPartitions("code", "id").mapInArrow(compare, "id long, nbr long, d float")
        out = found if out is None else out.unionByName(found)
    return out


def top_links(pairs: DataFrame) -> DataFrame:
    """The nearest LINKS of each id from (id, nbr, d, fresh); an old link stays old."""
    single = pairs.groupBy("id", "nbr").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    lists = single.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "nbr", "fresh"))), 1, LINKS).alias("links"))
    return lists


def exploded(graph: DataFrame) -> DataFrame:
    return graph.select("id", F.explode("links").alias("l")).select("id", "l.nbr", "l.d", "l.fresh")


def reverse_sample(edges: DataFrame, most: int, seed: int) -> DataFrame:
    """Edges turned round, with about ``most`` for each id: a hub's are sampled by hash."""
    turned = edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "fresh")
    degree = turned.groupBy("id").agg(F.count("*").alias("n"))
    lot = F.pmod(F.xxhash64("id", "nbr", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    return turned.join(degree, "id").filter(lot * F.col("n") < most).select("id", "nbr", "fresh")


def introduce(graph: DataFrame, unit: DataFrame, seed: int) -> DataFrame:
    """One NN-descent round: (id, nbr, d) that would enter the list of id."""
    edges = exploded(graph)
    met = edges.select("id", "nbr", "fresh").unionByName(reverse_sample(edges, LINKS, seed)).groupBy("id", "nbr").agg(F.max("fresh").alias("fresh"))
    last = F.element_at("links", -1)
    full = F.size("links") >= LINKS
    known = unit.join(graph, "id").select(F.col("id").alias("nbr"), "unit", F.when(full, last["d"]).otherwise(F.lit(float("inf")).cast("float")).alias("worst"), F.when(full, last["nbr"]).otherwise(F.lit(2**62)).alias("worst_id"))
    gathered = met.join(known, "nbr").select("id", "nbr", "fresh", "unit", "worst", "worst_id")

    def local_join(batches):
        rest: pa.Table | None = None

        def solve(table: pa.Table):
            own, ids, fresh = (table.column(c).to_numpy() for c in ("id", "nbr", "fresh"))
            x, worst, worst_id = units(table.column("unit")), table.column("worst").to_numpy(), table.column("worst_id").to_numpy()
            heads = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
            a_out, b_out, d_out = [], [], []
            for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(own)], strict=True):
                if e - s < 2 or not fresh[s:e].any():
                    continue
                d = squared(x[s:e])
                ok = (fresh[s:e, None] | fresh[None, s:e]) & ((d < worst[s:e, None]) | (d == worst[s:e, None]) & (ids[None, s:e] < worst_id[s:e, None]))
                np.fill_diagonal(ok, False)
                i, j = np.nonzero(ok)
                a_out.append(ids[s + i])
                b_out.append(ids[s + j])
                d_out.append(d[i, j])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out)), pa.array(np.concatenate(d_out).astype(np.float32))], ["id", "nbr", "d"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            own = table.column("id").to_numpy()
            whole = int(np.searchsorted(own, own[-1])) if len(own) else 0
            if whole:
                yield from solve(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield from solve(rest)

    return gathered.repartition("id").sortWithinPartitions("id").mapInArrow(local_join, "id long, nbr long, d float")


def build_graph(nodes: DataFrame, dim: int, staging: Staging, rounds: int = ROUNDS, until: float = 0.01) -> DataFrame:
    """(id, links): rounds go on until fewer than ``until`` of all links are new."""
    unit = staging.put(compact(nodes, dim), "unit")
    graph = staging.put(top_links(first_lists(unit, dim).withColumn("fresh", F.lit(True))), "graph-0")
    n = unit.count()
    for turn in range(1, rounds + 1):
        offers = introduce(graph, unit, turn).withColumn("fresh", F.lit(True))
        old = exploded(graph).withColumn("fresh", F.lit(False))
        fresh = staging.put(top_links(old.unionByName(offers)), f"graph-{turn}")
        staging.drop(f"graph-{turn - 1}")
        graph = fresh
        changed = graph.select(F.sum(F.size(F.filter("links", lambda l: l["fresh"])))).first()[0] or 0
        if changed <= until * n * LINKS:
            break
    staging.drop("unit")
    return graph


def distances(pairs: DataFrame) -> DataFrame:
    """(q, node, d) of rows with q, node, vector and query vector, in double precision."""

    def run(batches):
        for batch in batches:
            x, y = matrix(batch.column(2)), matrix(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((x - y) ** 2).sum(1)))], ["q", "node", "d"])

    return pairs.select("q", "node", "vector", "query").mapInArrow(run, "q long, node long, d double")


def exact_scan(queries: DataFrame, vectors: DataFrame, top: int, staging: Staging) -> DataFrame:
    """(q, node, d): the nearest ``top`` rows of every query (q, query), by scanning all rows for one
    block of ``BLOCK`` queries after the other; for the few queries whose walk came short, and to
    measure recall. The driver holds one block at a time, and every block's result is written."""
    kind = "q long, node long, d double"
    out = queries.sparkSession.createDataFrame([], kind)
    turn, rest = 0, queries
    while block := rest.orderBy("q").limit(BLOCK).collect():
        turn, rest = turn + 1, queries.filter(F.col("q") > block[-1]["q"])
        ids = np.array([r["q"] for r in block])
        points = np.array([r["query"] for r in block], np.float64)

        def scan(batches, ids=ids, points=points):
            for batch in batches:
                node, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                for b in range(0, len(node), 500):
                    part, names = x[b : b + 500], node[b : b + 500]
                    for q, point in zip(ids, points, strict=True):
                        d = np.sqrt(((part - point) ** 2).sum(1))
                        take = np.lexsort((names, d))[: top + 1]
                        take = take[names[take] != q][:top]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), q)), pa.array(names[take]), pa.array(d[take])], ["q", "node", "d"])

        found = vectors.select("id", "vector").mapInArrow(scan, kind)
        w = Window.partitionBy("q").orderBy("d", "node")
        best = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")
        out = out.unionByName(staging.put(best, f"scan-{turn}"))
    return out


def walk(graph: DataFrame, nodes: DataFrame, queries: DataFrame, staging: Staging) -> DataFrame:
    """(q, node, d): the nearest ``BEAM`` nodes that each of the queries (q, start, query) came by.

    A beam's rows are done once they were expanded; those marked ``now`` are next. What was measured is
    written once, hop by hop, and only looked up afterwards.
    """
    edges = exploded(graph)
    links = staging.put(edges.select("id", "nbr").unionByName(reverse_sample(edges, 2 * LINKS, 0).select("id", "nbr")).distinct(), "links")
    vectors = nodes.select(F.col("id").alias("node"), "vector")
    asked = queries.select("q", "query")
    near, rest = Window.partitionBy("q").orderBy("d", "node"), Window.partitionBy("q", "done").orderBy("d", "node")
    begin = queries.select("q", F.col("start").alias("node"), F.lit(0.0).alias("d"))
    seen = [begin.select("q", "node")]
    beam = staging.put(begin.withColumn("done", F.lit(False)).withColumn("now", F.lit(True)), "beam-0")
    hop = 0
    while beam.filter("now").limit(1).count():
        hop += 1
        met = beam.filter("now").join(links.withColumnRenamed("id", "node"), "node").select("q", F.col("nbr").alias("node")).distinct()
        fresh = met.join(reduce(DataFrame.unionByName, seen), ["q", "node"], "left_anti")
        measured = staging.put(distances(fresh.join(vectors, "node").join(asked, "q")), f"seen-{hop}")
        seen.append(measured.select("q", "node"))
        every = beam.select("q", "node", "d", (F.col("done") | F.col("now")).alias("done")).unionByName(measured.withColumn("done", F.lit(False)))
        best = every.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= BEAM)
        best = best.select("q", "node", "d", "done", (~F.col("done") & (F.row_number().over(rest) <= EXPAND)).alias("now"))
        beam = staging.put(best, f"beam-{hop}")
        staging.drop(f"beam-{hop - 1}")
    return beam.select("q", "node", "d")


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, staging: Staging | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found rows of every row for which ``is_query``."""
    spark = vectors.sparkSession
    staging = staging or Staging(spark, "neighbours")
    rows = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = staging.put(rows, "rows")
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dim = common["size"] if common else 0
    rows = rows.filter(F.size("vector") == dim)
    nodes = staging.put(rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "nodes")
    of = staging.put(rows.join(nodes.select("vector", F.col("id").alias("node")), "vector").select("id", "node"), "of")
    # The smallest ids of each group of equal vectors; one more, as a query is not its own result.
    w = Window.partitionBy("node").orderBy("id")
    members = of.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1).drop("r")
    asked = rows.filter(is_query(F.col("id"))).select(F.col("id").alias("q"), F.col("vector").alias("query")).join(of.select(F.col("id").alias("q"), F.col("node").alias("start")), "q")
    asked = staging.put(asked, "asked")
    graph = build_graph(nodes, dim, staging)
    found = walk(graph, nodes, asked, staging)
    by = Window.partitionBy("q").orderBy("d", "node")
    short = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= top + 1).drop("r")
    results = short.join(members, "node").filter("id != q").select("q", F.col("id").alias("node"), "d")
    results = staging.put(results, "results")
    enough = min(top, max(rows.count() - 1, 0))
    lacking = staging.put(asked.select("q", "query").join(results.groupBy("q").count().filter(F.col("count") >= enough), "q", "left_anti"), "lacking")
    if enough and lacking.limit(1).count():
        results = results.unionByName(exact_scan(lacking, rows, top, staging)).distinct()
    ranked = results.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= top)
    ranked = staging.put(ranked.select(F.col("q").alias("query_id"), "rank", F.col("node").alias("vec_id"), F.col("d").alias("score")), "ranked")
    staging.clear("ranked")
    return ranked


def op10(spark, sf_dir):
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
