"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, merged.

Distinct vectors are dealt to shards of about SHARD_ROWS by a hash; each shard's graph is one row of flat arrays
(unit vectors, identifiers, neighbours by layer). Searches take blocks of queries against every shard: a shard's graph reaches one
task, followed by the blocks, which stream through it. Each graph is walked from the top layer down with a beam, and the shards' best
are merged by exact cosine in double precision.

Equal vectors stand in the graph once, with their `k + 1` smallest identifiers: with ties going to the smaller
identifier no other can be among a query's k nearest, so a vector shared by any number of rows costs one place.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as queries or
candidates. Vectors of another length never meet. Repeated identifiers count as one row per distinct vector; null ones take no part. Fewer
candidates than k give fewer rows. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.scratch import materialize

SHARD_ROWS, BLOCK_ROWS = 4096, 512
#: Neighbours per node above the lowest layer (twice as many there), beam while building and while searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 48, 96
_BATCH = 128
#: Blocks of queries that make another copy of a graph worth its way.
BLOCKS_A_COPY = 4


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in step: ids and distances [queries, beam], nearest first, -1 and inf where fewer are found."""
    n = len(queries)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes absent neighbours
    seen[:, -1] = True
    seen[rows[:, 0], entry] = True
    ids = np.full((n, beam), -1)
    far = np.full((n, beam), np.inf)
    ids[:, 0], far[:, 0] = entry, 1 - np.einsum("nd,nd->n", queries, x[entry])
    done = np.ones((n, beam), bool)
    done[:, 0] = False
    active = np.arange(n)
    while len(active):
        a = active[:, None]
        pick = np.argmax(~done[active], axis=1)  # the nearest not yet expanded
        done[active, pick] = True
        near = links[ids[active, pick]]
        fresh = ~seen[a, near]
        seen[a, near] = True
        d = np.where(fresh, 1 - np.einsum("nd,nkd->nk", queries[active], x[near]), np.inf)
        all_d = np.concatenate([far[active], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_d, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), order, 1)
        active = active[~(done[active] | ~np.isfinite(far[active])).all(axis=1)]
    return np.where(np.isfinite(far), ids, -1), far


def spread_out(x: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Per row, up to `most` of the candidates (nearest first): each nearer to the row's vector than to any one taken; then the nearest others."""
    n, k = ids.shape
    v = x[np.maximum(ids, 0)]
    apart = 1 - v @ v.transpose(0, 2, 1)
    taken = np.zeros((n, k), bool)
    closest = np.full((n, k), np.inf)
    for j in range(k):
        ok = (far[:, j] < closest[:, j]) & (ids[:, j] >= 0) & (taken.sum(axis=1) < most)
        taken[:, j] = ok
        closest = np.where(ok[:, None], np.minimum(closest, apart[:, j]), closest)
    rank = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, rank, 1)


def build(x: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Neighbour arrays from the lowest layer up, for unit vectors in order of falling level. -1: no neighbour."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.sort(np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(int), 6))[::-1]
    layers: list[np.ndarray] = []
    for l in range(int(level[0]), -1, -1):
        size = int((level >= l).sum())
        most = LINKS * (2 if l == 0 else 1)
        links = np.full((n, most), -1)
        at = 1
        while at < size:
            new = np.arange(at, min(size, at + min(_BATCH, at)))
            entry = descend(x, layers, x[new], np.minimum(new, at) * 0)
            entry = np.where(entry < at, entry, 0)
            ids, far = beam_search(x, links, x[new], entry, BUILD_BEAM)
            chosen = spread_out(x, ids[:, : 2 * LINKS], far[:, : 2 * LINKS], LINKS)
            links[new, : chosen.shape[1]] = chosen
            _link_back(x, links, new, chosen)
            at += len(new)
        layers.insert(0, links)
    return layers


def descend(x: np.ndarray, above: list[np.ndarray], queries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Where to enter a layer: the nearest node found in each layer above it, from the top."""
    for links in reversed(above):
        entry = beam_search(x, links, queries, entry, 4)[0][:, 0]
    return entry


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse of each new link; a full list is chosen anew among its old and new members."""
    to, frm = chosen.ravel(), np.repeat(new, chosen.shape[1])
    frm, to = frm[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    added = np.full((len(nodes), int(count.max(initial=1))), -1)
    added[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
    ids = np.concatenate([links[nodes], added], axis=1)
    far = np.where(ids >= 0, 1 - np.einsum("nd,nkd->nk", x[nodes], x[np.maximum(ids, 0)]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    full = (ids >= 0).sum(axis=1) > links.shape[1]
    links[nodes[~full]] = ids[~full, : links.shape[1]]
    if full.any():
        links[nodes[full]] = spread_out(x, ids[full], far[full], links.shape[1])


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def _tamed(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two (which rounds nothing off), so that their largest components lie in [0.5, 1) and squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, int]]:
    """A row per shard with its graph, and the number of shards by vector length."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__v")).distinct()
    same = Window.partitionBy("__v").orderBy("__id")
    rows = rows.withColumn("__r", F.row_number().over(same)).where(F.col("__r") <= k + 1)
    rows = rows.groupBy("__v").agg(F.array_sort(F.collect_list("__id")).alias("__ids"))
    rows = materialize(rows.withColumn("__dim", F.size("__v")), "hnsw-vectors")
    shards = {r["__dim"]: -(-r["n"] // SHARD_ROWS) for r in rows.groupBy("__dim").agg(F.count("*").alias("n")).collect()}
    if not shards:
        shards = {0: 1}
    of_dim = F.element_at(F.create_map(*(F.lit(v) for pair in shards.items() for v in pair)), F.col("__dim"))
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64("__v"), of_dim).cast("int"))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__ids", key=lambda s: s.map(lambda v: v[0]))
        order = np.random.default_rng(3).permutation(len(pdf))
        exact = np.array(pdf["__v"].tolist())[order]
        ids = np.full((len(pdf), k + 1), -1, np.int64)
        for i, v in enumerate(np.array(pdf["__ids"], dtype=object)[order]):
            ids[i, : len(v)] = v
        known = (ids >= 0) | (np.arange(k + 1) < np.array([len(v) for v in np.array(pdf["__ids"], dtype=object)[order]])[:, None])
        layers = build(_unit(exact))
        flat = np.concatenate([layer.astype(np.int32).ravel() for layer in layers])
        ends = np.cumsum([0, *(layer.size for layer in layers)]).tolist()
        return pd.DataFrame({"__dim": [int(pdf["__dim"].iloc[0])], "__shard": [int(pdf["__shard"].iloc[0])], "ids": [ids.tobytes()], "known": [known.tobytes()], "vectors": [exact.tobytes()], "links": [flat.tobytes()], "ends": [ends]})

    out = rows.groupBy("__dim", "__shard").applyInPandas(graph, "__dim int, __shard int, ids binary, known binary, vectors binary, links binary, ends array<int>")
    return materialize(out, "hnsw-index"), shards


def _searched(graph: tuple, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one graph for each query."""
    x, layers, ids, known, exact, norm = graph
    u, q = _unit(q), _tamed(q)
    entry = descend(x, layers[1:], u, np.zeros(len(u), int))
    found, _ = beam_search(x, layers[0], u, entry, SEARCH_BEAM)
    at = np.maximum(found, 0)
    score = np.einsum("nd,nkd->nk", q, exact[at]) / (np.sqrt(np.einsum("nd,nd->n", q, q))[:, None] * norm[at])
    owner = np.broadcast_to(q_ids[:, None, None], (*found.shape, ids.shape[1]))
    near = ids[at]
    valid = (found >= 0)[:, :, None] & known[at] & (near != owner)
    out = pd.DataFrame({"query_id": owner[valid], "vec_id": near[valid], "score": np.broadcast_to(score[:, :, None], near.shape)[valid]})
    return out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable").groupby("query_id", sort=False).head(k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank (from 1): query_id, rank, vec_id, score (cosine); a query's own identifier is no candidate."""
    graphs, shards = index(vectors, k, id_col, vector_col)
    queries = vectors.where(is_query & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"))
    queries = queries.withColumn("__dim", F.size("__v")).distinct()
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    blocks = queries.groupBy("__dim", F.pmod(F.xxhash64("__id"), F.lit(n_blocks)).alias("__block")).agg(F.collect_list(F.struct("__id", "__v")).alias("__queries"))
    of_dim = F.element_at(F.create_map(*(F.lit(v) for pair in shards.items() for v in pair)), F.col("__dim"))
    blocks = blocks.withColumn("__shard", F.explode(F.sequence(F.lit(0), of_dim - 1)))
    # Salts give several tasks a copy of a graph where there are more tasks than shards; each takes its part of the blocks.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(tasks // max(sum(shards.values()), 1), -(-n_blocks // BLOCKS_A_COPY)))
    blocks = blocks.withColumn("__salt", F.pmod("__block", F.lit(salts)).cast("int"))
    copies = graphs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("__first", F.lit(0))
    met = copies.unionByName(blocks.drop("__block").withColumn("__first", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("__dim", "__shard", "__salt").sortWithinPartitions("__dim", "__shard", "__salt", "__first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if r["__first"] == 0:
                    exact = np.frombuffer(r["vectors"]).reshape(-1, r["__dim"])
                    ids = np.frombuffer(r["ids"], np.int64).reshape(len(exact), -1)
                    known = np.frombuffer(r["known"], bool).reshape(len(exact), -1)
                    flat = np.frombuffer(r["links"], np.int32)
                    layers = [flat[a:b].reshape(len(exact), -1) for a, b in pairwise(r["ends"])]
                    x, exact = _unit(exact), _tamed(exact)
                    graph = x, layers, ids, known, exact, np.sqrt(np.einsum("nd,nd->n", exact, exact))
                else:
                    q_ids = np.array([q["__id"] for q in r["__queries"]])
                    yield _searched(graph, q_ids, np.array([np.asarray(q["__v"], float) for q in r["__queries"]]), k)

    best = met.mapInPandas(run, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
