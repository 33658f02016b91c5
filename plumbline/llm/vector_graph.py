"""Near copies among embeddings by a flat graph over overlapping cluster shards.

Centroids are fitted on a bounded sample; every vector goes to its nearest few shards. In each shard the graph joins a
vector to robustly pruned neighbours; the adjacency lists that a vector got in its shards are united. Every vector is
then searched in its shards: a greedy walk from the medoid, then expansion over all vectors inside the range. Pairs
found are confirmed by cosine in double precision. Recall is audited against all vectors for queries chosen by hash alone,
and the search is widened if it falls short. Shards too large for one task are compared in blocks, exactly; so are all
vectors if the widest search falls short too, or if the audit meets too few links to tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.plans.materialize import materialize

THRESHOLD = 0.9
#: The centroid fit: vectors a shard aims at, sampled vectors at most, centroids at most.
SHARD, SAMPLE, MOST_CENTROIDS = 2_500, 20_000, 2_048
#: Members of a shard that one task takes; larger shards are compared in blocks of half of it.
LARGEST_SHARD = 12_000
#: Candidates before pruning, edges after it, edges back beside them, slack of the pruning rule (on 1 - cosine, the
#: square of 1.41 on distances), and random edges.
CANDIDATES, DEGREE, BACK, ALPHA, FAR = 64, 24, 12, 2.0, 4
#: Shards a vector enters, nodes the walk keeps, and how far below the threshold the expansion goes on.
OVERLAP, BEAM, SLACK = 2, 48, 0.08
#: Queries of the audit and the recall below which the search is widened.
AUDITED, LEAST_RECALL, TRIES = 256, 0.97, 3
#: Links an audit must meet unless it asks all vectors, the queries it may grow to for that, and numbers they may hold.
LEAST_MET, MOST_AUDITED, AUDITED_NUMBERS = 64, 4_096, 4_000_000

_ERROR = 1e-5  # of single-precision cosines


def unit(values) -> np.ndarray | None:
    """A vector of length one in double precision; None if it cannot link with anything."""
    if values is None:
        return None
    x = np.array([np.nan if v is None else v for v in values] if isinstance(values, list) else values, dtype=np.float64)
    if not x.size or not np.isfinite(x).all():
        return None
    largest = np.abs(x).max()
    if largest == 0:
        return None
    x = x / largest  # neither very large nor very small components overflow
    return x / np.sqrt(x @ x)


def _unit_udf():
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([unit(v) for v in batch], dtype=object)

    return F.pandas_udf(units, "array<double>")


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means with a fixed start."""
    chosen = sample[np.random.default_rng(1).choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ chosen.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(chosen)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        chosen = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], chosen)
    return chosen


def _sharder(centroids: dict[int, np.ndarray], overlap: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            values, ends = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            rows, names = [], []
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.stack([values[ends[i] : ends[i + 1]] for i in own])
                c = centroids[int(size)]
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, : min(overlap, len(c))]
                rows.append(np.repeat(own, near.shape[1]))
                names += [f"{size}-{j}" for j in near.ravel()]
            take = pa.array(np.concatenate(rows) if rows else np.array([], dtype=np.int64))
            columns = [batch.column(0).take(take), vectors.take(take), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "unit", "shard"])

    return shard


def _sorted_members(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("node", kind="stable").reset_index(drop=True)


def build_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row of unit vectors (places, -1 where there are fewer): robustly pruned, with edges back and a few random ones."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    edges = np.full((n, DEGREE + BACK + FAR), -1, dtype=np.int32)
    if width <= 0:
        return edges
    for start in range(0, n, 512):
        rows = np.arange(start, min(start + 512, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        between = np.matmul(x[near], x[near].transpose(0, 2, 1))
        alive = np.ones(near.shape, dtype=bool)
        at = np.arange(len(rows))
        for k in range(min(DEGREE, width)):
            left = alive.any(axis=1)
            if not left.any():
                break
            best = alive.argmax(axis=1)
            edges[rows[left], k] = near[at, best][left]
            alive &= ~(ALPHA * (1 - between[at, best]) <= 1 - own)
            alive[at, best] = False
    source, column = np.nonzero(edges[:, :DEGREE] >= 0)
    target = edges[source, column]
    order = np.lexsort((column, target))  # the closest pruned edges come back first
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    edges[target[rank < BACK], DEGREE + rank[rank < BACK]] = source[rank < BACK]
    random = np.random.default_rng(n).integers(0, n, (n, FAR))
    edges[:, DEGREE + BACK :] = np.where(random == np.arange(n)[:, None], -1, random)
    return edges


def _graph_of_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = _sorted_members(frame)
    edges = build_graph(np.stack(frame["unit"].to_numpy()).astype(np.float32))
    nodes = frame["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "near": [nodes[e[e >= 0]] for e in edges]})


def search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, query: int, least: float, beam: int) -> np.ndarray:
    """Places whose cosine with row ``query`` is ``least`` or more: a greedy walk, then expansion inside the range."""
    q = x[query]
    seen = np.zeros(len(x), dtype=bool)
    seen[starts] = True
    ids, sims = starts, x[starts] @ q
    done = np.zeros(len(ids), dtype=bool)
    found, found_sims = [ids], [sims]
    while True:
        ready = np.flatnonzero(~done)
        if not len(ready):
            break
        picked = ready[np.argsort(-sims[ready], kind="stable")[:8]]
        done[picked] = True
        near = edges[ids[picked]].ravel()
        near = np.unique(near[near >= 0])
        near = near[~seen[near]]
        if len(near):
            seen[near] = True
            own = x[near] @ q
            found.append(near), found_sims.append(own)
            ids, sims, done = np.r_[ids, near], np.r_[sims, own], np.r_[done, np.zeros(len(near), dtype=bool)]
            if len(ids) > beam:
                keep = np.argpartition(-sims, beam - 1)[:beam]
                ids, sims, done = ids[keep], sims[keep], done[keep]
    ids, sims = np.concatenate(found), np.concatenate(found_sims)
    edge = ids[sims >= least - SLACK]
    hits = [ids[sims >= least]]
    while len(edge):
        near = edges[edge].ravel()
        near = np.unique(near[near >= 0])
        near = near[~seen[near]]
        seen[near] = True
        own = x[near] @ q
        hits.append(near[own >= least])
        edge = near[own >= least - SLACK]
    return np.concatenate(hits)


def _searcher(threshold: float, beam: int):
    def search_shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _sorted_members(frame)
        nodes, exact = frame["node"].to_numpy(), np.stack(frame["unit"].to_numpy())
        x = exact.astype(np.float32)
        lists = frame["near"].to_numpy()
        edges = np.full((len(nodes), max(1, max(map(len, lists)))), -1, dtype=np.int32)
        for i, near in enumerate(lists):  # neighbours that are members of this shard
            at = np.searchsorted(nodes, near)
            at = at[(at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == near)]
            edges[i, : len(at)] = at
        medoid = int((x @ x.mean(axis=0)).argmax())
        found, whose = [], []
        for i in range(len(nodes)):
            hits = search(x, edges, np.unique([medoid, i]), i, threshold - _ERROR, beam)
            hits = hits[(exact[hits] @ exact[i] >= threshold) & (nodes[hits] != nodes[i])]
            found.append(nodes[hits]), whose.append(np.full(len(hits), nodes[i]))
        return pd.DataFrame({"u": np.concatenate(whose), "v": np.concatenate(found)})

    return search_shard


def _blocks(threshold: float):
    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []})
        a, b = np.stack(left["unit"].to_numpy()), np.stack(right["unit"].to_numpy())
        i, j = np.nonzero(a @ b.T >= threshold)
        u, v = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    return compare


def _large_shards(members: DataFrame, counts: DataFrame, threshold: float, link: str, above: int = LARGEST_SHARD) -> DataFrame:
    """Pairs inside shards of more than ``above`` members: every block of members meets every other once."""
    half = LARGEST_SHARD // 2
    large = counts.where(F.col("n") > above).select("shard", F.ceil(F.col("n") / half).cast("int").alias("blocks"))
    own = members.join(large, "shard").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = materialize(own, "large-shards")
    again = own.sparkSession.read.schema(own.schema).parquet(*own.inputFiles())
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.withColumn("l", F.col("b")).withColumn("r", every)
    right = again.withColumn("r", F.col("b")).withColumn("l", every)
    keys = ["shard", "l", "r"]
    left, right = (side.where("l <= r").select("node", "unit", *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_blocks(threshold), link)


def audit(nodes: DataFrame, links: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED) -> tuple[int, int]:
    """Links found and links there for the ``queries`` nodes of smallest hash, whatever was found; those nodes meet all others."""
    chosen = nodes.withColumn("h", F.xxhash64("node")).orderBy("h", "node").limit(queries).collect()
    by_size: dict[int, tuple[list, list]] = {}
    for node, x in {r.node: r.unit for r in chosen}.items():
        own = by_size.setdefault(len(x), ([], []))
        own[0].append(node), own[1].append(x)
    sides = {size: (np.array(ids), np.array(xs)) for size, (ids, xs) in by_size.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, xs = sides.get(len(x.values), (None, None))
                if ids is not None:
                    hits = ids[(xs @ x.values.to_numpy() >= threshold) & (ids != node)]
                    us += hits.tolist()
                    vs += [node] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(us, batch.column(0).type), pa.array(vs, batch.column(0).type)], names=["u", "v"])

    kind = nodes.schema["node"].dataType.simpleString()
    true = nodes.select("node", "unit").mapInArrow(near, f"u {kind}, v {kind}").distinct()
    met = true.join(links.withColumn("hit", F.lit(1)), ["u", "v"], "left").agg(F.count("hit"), F.count("*")).first()
    return met[0], met[1]


def _recalled(nodes: DataFrame, links: DataFrame, threshold: float) -> bool | None:
    """Whether the audit finds recall enough; None if it cannot tell. Queries grow until they meet enough links."""
    total, longest = nodes.agg(F.count("*"), F.max(F.size("unit"))).first()
    most = min(MOST_AUDITED, max(AUDITED, AUDITED_NUMBERS // (longest or 1)))
    queries = AUDITED
    while True:
        hit, there = audit(nodes, links, threshold, queries)
        if hit < LEAST_RECALL * there:
            return False
        if there >= LEAST_MET or queries >= total:
            return True
        if queries >= most:
            return None
        queries = min(4 * queries, most)


def _both(found: DataFrame) -> DataFrame:
    found = materialize(found, "found")
    return materialize(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links u, v in both directions, every vector compared with every other of its length."""
    kind = nodes.schema["node"].dataType.simpleString()
    members = nodes.withColumn("shard", F.size("unit").cast("string"))
    counts = materialize(members.groupBy("shard").agg(F.count("*").alias("n")), "lengths")
    return _both(_large_shards(members, counts, threshold, f"u {kind}, v {kind}", 0))


def _links(nodes: DataFrame, threshold: float, overlap: int, beam: int) -> DataFrame:
    """Links u, v in both directions between nodes (node, unit)."""
    spark = nodes.sparkSession
    kind = nodes.schema["node"].dataType.simpleString()
    sizes = {r.d: r.n for r in nodes.groupBy(F.size("unit").alias("d")).agg(F.count("*").alias("n")).collect()}
    centroids = {}
    for d, n in sizes.items():
        bound = max(1, min(SAMPLE, 64_000_000 // (8 * d)))
        hashed = nodes.where(F.size("unit") == d).withColumn("h", F.xxhash64("node"))
        share = F.pmod("h", F.lit(1 << 20)) < F.lit(min(1 << 20, 1 + 2 * bound * (1 << 20) // n))
        sample = hashed.where(share).orderBy("h").limit(bound).select("unit").collect()
        k = max(1, min(MOST_CENTROIDS, round(n / SHARD)))
        centroids[d] = fit_centroids(np.array([r.unit for r in sample]), k)
    members = materialize(nodes.mapInArrow(_sharder(centroids, overlap), f"node {kind}, unit array<double>, shard string"), "members")
    counts = materialize(members.groupBy("shard").agg(F.count("*").alias("n")), "shards")
    small = members.join(counts.where(F.col("n") <= LARGEST_SHARD).select("shard"), "shard")
    graph = small.groupBy("shard").applyInPandas(_graph_of_shard, f"node {kind}, near array<{kind}>")
    graph = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = materialize(graph, "graph")
    link = f"u {kind}, v {kind}"
    found = small.join(graph, "node").groupBy("shard").applyInPandas(_searcher(threshold, beam), link)
    if not counts.where(F.col("n") > LARGEST_SHARD).isEmpty():
        found = found.unionByName(_large_shards(members, counts, threshold, link))
    return _both(found)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` needs vec_id and embedding; other columns, labels too, are not read. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are one
    node and link with each other. Rows with a null vec_id link with nothing and have no component. Rows that repeat a
    vec_id are one node, however often they stand there. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", _unit_udf()(F.col("embedding")).alias("unit"), F.xxhash64("embedding").alias("hash"))
    rows = materialize(rows, "units")
    live = rows.where("unit is not null and vec_id is not null")
    classes = live.groupBy("hash", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("members"))
    classes = materialize(classes, "vector-classes")
    nodes = classes.select("node", "unit").dropDuplicates(["node"])
    overlap, beam = OVERLAP, BEAM
    for attempt in range(TRIES):
        links = _links(nodes, threshold, overlap, beam)
        recalled = _recalled(nodes, links, threshold)
        if recalled is not False:
            break
        overlap, beam = overlap + 1, 2 * beam
    if not recalled:
        links = _all_links(nodes, threshold)
    sizes = classes.groupBy("node").agg(F.sum("members").alias("members"))
    linked = links.join(sizes.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.sum("members").alias("others"))
    group = components(links)
    facts = sizes.join(linked.withColumnRenamed("u", "node"), "node", "left").join(group, "node", "left").select(
        "node", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    placed = live.join(classes.select("hash", "unit", "node"), ["hash", "unit"]).join(facts, "node")
    found = placed.select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE clean AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS rid FROM embeddings
), live AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM clean
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM live a JOIN live b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reached(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), least AS (SELECT u, min(v) AS v FROM reached GROUP BY u), counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(v, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(v, vec_id)) AS kept
FROM clean LEFT JOIN counted ON u = vec_id LEFT JOIN least ON least.u = vec_id
"""
