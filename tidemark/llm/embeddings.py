"""Operator 3: near-duplicate embeddings by NN-descent over different vectors, with an audit and exact threshold edges."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

log = logging.getLogger(__name__)

#: Neighbours in a list, rows that one comparison takes together, and what a code's cosine may miss the true one by.
NEIGHBOURS = 8
CHUNK = 128
SLACK = 0.02
#: Orderings that start the graph, rounds of neighbours-of-neighbours joins, vectors of each sample of the audit, what the
#: ids that it asks about are divisible by, the sides of its blocks, and its least recall.
ORDERINGS = 6
ROUNDS = 2
AUDITED = 200
ASKED, ASKED_BLOCK, ROW_BLOCK = 50, 512, 4096
RECALL = 0.99
#: Members of a component that one block of the exact comparison takes.
BLOCK = 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by their largest component first, so that squares neither over- nor underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(dim: int, seed: int, bits: int = 24) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits)).astype(np.float32)


def _vectors(column: pa.Array, dim: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as doubles) for each dimension in a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    edge = np.concatenate(([0], np.cumsum(dim)))
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        yield rows, flat[edge[rows][:, None] + np.arange(d)]


def _top(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row, itself left out."""
    n = len(sim)
    np.fill_diagonal(sim, -np.inf)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    col = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(n), k), col.ravel()


EDGE = "u bigint, v bigint, sim float"


def _chunked(keys: list[str], k: int, least: float | None = None):
    """Compare runs of rows (keys..., cid, code) with equal keys, CHUNK at a time; emit each row's k nearest.

    With ``least`` rows have a comp too, and only neighbours of another comp, at least that alike, count.
    """

    def emit(cid: np.ndarray, codes: np.ndarray, comp: np.ndarray | None) -> pa.RecordBatch:
        x = codes.astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        sim = x @ x.T
        if comp is not None:
            sim[comp[:, None] == comp] = -np.inf
        row, col = _top(sim, k)
        if comp is not None:
            passing = sim[row, col] >= least
            row, col = row[passing], col[passing]
        return pa.RecordBatch.from_arrays([pa.array(cid[row]), pa.array(cid[col]), pa.array(sim[row, col].astype(np.float32))], ["u", "v", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            yield from work(held, False)
            held = held.slice(work.rest)
        if held is not None:
            yield from work(held, True)

    class Work:
        rest = 0

        def __call__(self, table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            n = table.num_rows
            new = np.ones(n, bool)
            change = np.zeros(max(n - 1, 0), bool)
            for key in keys:
                x = table[key].to_numpy()
                change |= x[1:] != x[:-1]
            new[1:] = change
            starts = np.append(np.flatnonzero(new), n)
            cid, raw = table["cid"].to_numpy(), table["code"].combine_chunks()
            comp = None if least is None else table["comp"].to_numpy()
            size = np.asarray(pa.compute.binary_length(raw).to_numpy(zero_copy_only=False))
            at = 0
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if hi == n and not last and n - lo < 4 * CHUNK:
                    break  # may go on in the next batch
                cuts = np.linspace(lo, hi, -(-(hi - lo) // CHUNK) + 1).astype(int)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if b - a > 1:
                        codes = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.int8).reshape(b - a, int(size[a]))
                        yield emit(cid[a:b], codes, None if comp is None else comp[a:b])
                at = hi
            self.rest = at

    work = Work()
    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each u."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    lists = best.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False), 1, k).alias("list"))
    return lists.select("u", F.explode("list").alias("e")).select("u", "e.v", "e.sim")


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, i, j, b, cid, n, vec) of one block of a component after another -> links and a spanning forest."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cid, n, b = t["cid"].to_numpy(), t["n"].to_numpy(), t["b"].to_numpy()
        i, j = int(t["i"][0].as_py()), int(t["j"][0].as_py())
        x = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64).reshape(len(cid), -1)
        x = _unit(x)
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        near = x[left] @ x[right].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(cid), np.int64)
        links[left] += near @ n[right]
        if i != j:
            links[right] += near.T @ n[left]
        # labels spread over the block's links until they stand; a star to each label's vector is a forest
        label = np.arange(len(cid))
        while True:
            was = label.copy()
            big = len(cid)
            low = np.where(near, label[right][None, :], big).min(axis=1, initial=big)
            label[left] = np.minimum(label[left], low)
            low = np.where(near, label[left][:, None], big).min(axis=0, initial=big)
            label[right] = np.minimum(label[right], low)
            if (was == label).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(cid[label]), pa.array(links)], ["a", "b", "links"])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        comp, i, j = (batch.column(k).to_numpy() for k in ("comp", "i", "j"))
        new = np.ones(batch.num_rows, bool)
        new[1:] = (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.append(np.flatnonzero(new), batch.num_rows)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = (comp[a], i[a], j[a])
            if key != now and held:
                yield from compare(pa.Table.from_batches(held))
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from compare(pa.Table.from_batches(held))


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: links to other rows of the same label by cosine >= threshold.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing:
    n_links 0, component_id their own id.  Equal vectors of a label are one class; n_links counts a class' rows.
    component_id is the smallest non-null id reachable; rows may repeat; extra columns are ignored; an empty table
    gives no rows.  Vectors of different lengths never link.

    1. Random sign orderings put alike vectors next to each other; stretches of them start the neighbour lists.
    2. Rounds of neighbours-of-neighbours joins refine the lists (on 8-bit codes).
    3. The passing edges, with some slack, give components.  A list whose last entry still passes is saturated and may
       hide links, to its own component as to others.  Saturated vectors are ordered anew and look for neighbours of
       other components only, which join the components, until an ordering's rounds find none.
    4. An audit compares all vectors whose id is divisible by 50, and bounded samples of those in components and of the
       saturated ones, with all of their label; if fewer than 99 % of a sample's links lie inside components, more
       orderings follow (at most twice), and if that is not enough each label is taken for one component.  The recall
       is logged.
    5. Each component is compared in blocks with the whole vectors in double precision.  Only counts and spanning
       forests leave a block.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vec = F.col(vector_col).cast("array<double>")
    good = F.col(label_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"), F.coalesce(good, F.lit(False)).alias("good"))
    base = written(base, "vectors")
    classes = base.where("good").groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.coalesce(F.max(F.expr(f"pmod(try_cast(id as bigint), {ASKED}) = 0")), F.lit(False)).alias("asked"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), F.xxhash64("label", F.size("vec")).alias("grp"), "label", "vec", "n", "rep", "asked"), "classes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(dim):
                continue
            codes = np.empty(len(dim), object)
            for at, x in _vectors(batch.column("vec"), dim):
                q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
                for r, c in zip(at.tolist(), q):
                    codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("grp"), pa.array(list(codes), pa.binary())], ["cid", "grp", "code"])

    codes = written(classes.select("cid", "grp", "vec").mapInArrow(encode, "cid bigint, grp bigint, code binary"), "codes")

    def order(seeds: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column("code").to_pylist()
                dim = np.array([len(r) for r in raw], np.int64)
                for seed in seeds:
                    sign = np.zeros(len(raw), np.int64)
                    for d in np.unique(dim):
                        at = np.flatnonzero(dim == d)
                        x = np.frombuffer(b"".join([raw[k] for k in at]), np.int8).reshape(len(at), d).astype(np.float32)
                        bits = x @ _planes(int(d), seed) > 0
                        sign[at] = bits @ (1 << np.arange(bits.shape[1] - 1, -1, -1))
                    rest = [c for c in batch.schema.names if c != "grp"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), seed)), batch.column("grp"), pa.array(sign), *[batch.column(c) for c in rest]], ["tree", "grp", "sign", *rest])

        return run

    def start(seeds: list[int], frame: DataFrame = codes, least: float | None = None) -> DataFrame:
        schema = "tree bigint, grp bigint, sign bigint, cid bigint, code binary" + ", comp bigint" * (least is not None)
        keyed = frame.mapInArrow(order(seeds), schema).withColumn("mix", F.xxhash64("cid", "tree"))
        keys = ["tree", "grp", "sign", "mix"]
        return keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_chunked(["tree", "grp"], NEIGHBOURS, least), EDGE)

    def descend(graph: DataFrame) -> DataFrame:
        both = graph.select(F.col("u").alias("pivot"), F.col("v").alias("member")).union(graph.select("v", "u")).distinct()
        joined = both.join(codes, F.col("member") == F.col("cid")).select("pivot", "cid", "code")
        near = joined.repartition(parts, "pivot").sortWithinPartitions("pivot", "cid").mapInArrow(_chunked(["pivot"], NEIGHBOURS // 2), EDGE)
        return written(_nearest(graph.union(near), NEIGHBOURS), "graph")

    def outward(found: DataFrame, saturated: DataFrame, seeds: int) -> tuple[DataFrame, int]:
        """found, joined by passing edges between saturated vectors of different components; and the next seed."""
        dense = written(codes.join(saturated, "cid"), "dense")
        while not dense.isEmpty():
            placed = dense.join(found, F.col("cid") == F.col("node")).select("grp", "cid", "code", F.col("component").alias("comp"))
            across = written(start(list(range(seeds, seeds + ORDERINGS)), placed, threshold - SLACK), "across")
            seeds += ORDERINGS
            if across.isEmpty():
                break
            edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
            found = written(components(edges.union(across.select("u", "v"))), "found")
        return found, seeds

    graph, seeds, tries = None, 0, 0
    while True:
        begun = start(list(range(seeds, seeds + ORDERINGS)))
        seeds += ORDERINGS
        graph = written(_nearest(begun if graph is None else graph.union(begun), NEIGHBOURS), "graph")
        for _ in range(ROUNDS):
            graph = descend(graph)
        passing = graph.where(F.col("sim") >= threshold - SLACK)
        found = written(components(passing.select(F.col("u").alias("a"), F.col("v").alias("b"))), "found")
        saturated = passing.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= NEIGHBOURS).select(F.col("u").alias("cid"))
        found, seeds = outward(found, saturated, seeds)
        tries += 1
        recall = min(_recall(classes, found, threshold, parts), _audit(classes, found, saturated, threshold))
        log.info("recall %.4f of the links of asked and sampled vectors after %d orderings", recall, seeds)
        if recall >= RECALL:
            break
        if tries == 3:
            whole = classes.groupBy("grp").agg(F.min("cid").alias("component"))
            found = classes.join(whole, "grp").select(F.col("cid").alias("node"), "component")
            break

    named = classes.join(found, F.col("cid") == F.col("node")).select(F.col("component").alias("comp"), "cid", "n", "vec")
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    placed = named.join(sizes.withColumnRenamed("component", "comp"), "comp").withColumn("b", F.pmod(F.xxhash64("cid", F.lit("block")), "nb"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1))).select("comp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "cid", "n", "vec")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edge = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([flat[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], batch.schema.names)

    schema = "comp bigint, i bigint, j bigint, b bigint, cid bigint, n bigint, vec binary"
    dealt = dealt.mapInArrow(raw, schema).repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cid")
    exact = written(dealt.mapInArrow(lambda b: _blocks(b, threshold), "a bigint, b bigint, links bigint"), "exact")
    links = exact.groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(exact.where("a <> b"))
    own = classes.join(joined, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("component", "cid").alias("comp"), "label", "vec", "n", "rep")
    least = own.groupBy("comp").agg(F.min("rep").alias("component_id"))
    facts = written(own.join(least, "comp").join(links, F.col("cid") == F.col("a"), "left").select(F.col("label").alias("l"), F.col("vec").alias("x"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "facts")
    done = base.where("good").join(facts, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("x"))).select("id", "n_links", "component_id")
    alone = base.where("not good").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    every = done.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _recall(classes: DataFrame, found: DataFrame, threshold: float, parts: int) -> float:
    """Share of the links of all asked vectors that lie inside a component: they against their label, in blocks."""
    placed = classes.join(found, F.col("cid") == F.col("node"), "left").select("cid", "grp", "asked", F.coalesce("component", -F.col("cid") - 1).alias("comp"), "vec")
    sizes = placed.groupBy("grp").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("rows"), F.ceil(F.count_if("asked") / ASKED_BLOCK).alias("asks")).where("asks > 0")
    both = placed.join(sizes, "grp")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)
    asking = both.where("asked").select("grp", F.pmod(F.xxhash64("cid"), "asks").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("asking"), "cid", "comp", "vec")
    asked = both.select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("asks") - 1)).alias("i"), F.pmod(F.xxhash64("cid", F.lit("row")), "rows").alias("j"), F.lit(False).alias("asking"), "cid", "comp", "vec")
    dealt = asking.unionByName(asked).repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def compare(t: pa.Table) -> pa.RecordBatch:
        cid, comp, asking = t["cid"].to_numpy(), t["comp"].to_numpy(), t["asking"].to_numpy()
        x = _unit(t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cid), -1))
        near = x[asking] @ x[~asking].T >= threshold
        near &= cid[asking][:, None] != cid[~asking]
        hit = near & (comp[asking][:, None] == comp[~asking])
        return pa.RecordBatch.from_arrays([pa.array([int(near.sum())]), pa.array([int(hit.sum())])], ["links", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            i, j, g = (batch.column(k).to_numpy() for k in ("i", "j", "grp"))
            new = np.ones(batch.num_rows, bool)
            new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (g[1:] != g[:-1])
            cuts = np.append(np.flatnonzero(new), batch.num_rows)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                key = (g[a], i[a], j[a])
                if key != now and held:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield compare(pa.Table.from_batches(held))

    got = dealt.mapInArrow(run, "links bigint, hits bigint").agg(F.sum("links").alias("links"), F.sum("hits").alias("hits")).first()
    return got.hits / got.links if got.links else 1.0


def _audit(classes: DataFrame, found: DataFrame, saturated: DataFrame, threshold: float) -> float:
    """Share of the links of sampled vectors, found by brute force, that lie inside a component.

    At most AUDITED vectors each are sampled of those in components and of the saturated ones; the least share counts.
    """

    def sample(ids: DataFrame) -> set[int]:
        return {r.cid for r in ids.orderBy(F.xxhash64("cid", F.lit("audit"))).limit(AUDITED).collect()}

    samples = [sample(x) for x in (found.select(F.col("node").alias("cid")), saturated)]
    picked = classes.where(F.col("cid").isin(sorted(set().union(*samples)))).select("cid", "grp", "vec").collect()
    groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r.grp for r in picked}:
        mine = [r for r in picked if r.grp == g]
        x = np.array([r.vec for r in mine])
        groups[g] = np.array([r.cid for r in mine]), _unit(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, grp = batch.column("cid").to_numpy(), batch.column("grp").to_numpy()
            dim = pa.compute.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, x in _vectors(batch.column("vec"), dim):
                for g in np.unique(grp[rows]):
                    if g in groups:
                        mine = rows[grp[rows] == g]
                        y = x[grp[rows] == g]
                        near = _unit(y) @ groups[g][1].T >= threshold
                        a, b = np.nonzero(near)
                        a, b = cid[mine][a], groups[g][0][b]
                        keep = a != b
                        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["x", "y"])

    links = classes.select("cid", "grp", "vec").mapInArrow(run, "x bigint, y bigint")
    f, g = found.select(F.col("node").alias("x"), F.col("component").alias("cx")), found.select(F.col("node").alias("y"), F.col("component").alias("cy"))
    got = links.join(f, "x", "left").join(g, "y", "left").groupBy("y").agg(F.count("*").alias("all"), F.count_if(F.col("cx") == F.col("cy")).alias("hit")).collect()
    every = [(sum(r.hit for r in got if r.y in s), sum(r.all for r in got if r.y in s)) for s in samples]
    return min(hit / n if n else 1.0 for hit, n in every)
