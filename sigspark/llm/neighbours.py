"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched with a beam.

Equal vectors are one node, with their smallest ids: no query can need more of them than it returns. Nodes are dealt to shards by a hash. In a
shard, inner products become distances by one more coordinate that gives all vectors the same length. Nodes are inserted in
batches: a greedy search of the graph so far proposes each one's neighbours; of these, nearest first, one is kept unless a kept
one is nearer to it by the factor RELAXED; kept edges are also drawn back, and lists that grow too long are pruned the same way. What a search from
the entry wouldn't reach is linked at the end, so every row can be found. Each query is searched in every shard; what is found is scored
in double precision on the original vectors and merged.

Shards, and blocks of queries, have in the order of the root of the number of nodes: a task holds one shard and one block, each at most MOST_BYTES.

Defined results: rows without vec_id, and vectors that are null, zero, or hold null or non-finite components, take no part, nor do those whose length isn't the commonest
one (of equally common ones the longest). Ties go to the smaller vec_id. Rows that repeat in vec_id and vector count once; of rows that share a
vec_id only, each is searched for itself, and is a candidate for the other. With fewer candidates than asked for, all are returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, store

#: Nodes that a search keeps at once in building, and at least in searching.
BEAM, QUERY_BEAM = 96, 160
#: Out-edges of a node after pruning, and before a list is pruned anew.
DEGREE, SLACK = 32, 48
#: Edges that only link what would be out of reach.
SPARE = 4
RELAXED = 1.2
#: Nodes or queries inserted or searched at once.
BATCH = 256
#: A shard has this times the root of the number of nodes, but no more bytes than MOST_BYTES.
ROOTS, MOST_BYTES = 32, 1 << 28


def _search(x: np.ndarray, out: np.ndarray, q: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `width` nodes that a beam search from the start meets, for each query: ids (-1: none) and inner products."""
    b = len(q)
    ids, sims, todo = np.full((b, width), -1, dtype=np.int32), np.full((b, width), -np.inf, dtype=np.float32), np.zeros((b, width), dtype=bool)
    ids[:, 0], sims[:, 0], todo[:, 0] = start, q @ x[start], True
    final_ids, final_sims, live = ids.copy(), sims.copy(), np.arange(b)
    while True:
        at = np.where(todo, sims, -np.inf).argmax(axis=1)
        rows = np.arange(len(live))
        alive = todo[rows, at]
        if not alive.all():
            final_ids[live[~alive]], final_sims[live[~alive]] = ids[~alive], sims[~alive]
            if not alive.any():
                return final_ids, final_sims
            ids, sims, todo, live, at, q = ids[alive], sims[alive], todo[alive], live[alive], at[alive], q[alive]
            rows = np.arange(len(live))
        todo[rows, at] = False
        near = out[ids[rows, at]]
        sim = np.matmul(x[near], q[:, :, None])[:, :, 0]
        sim[(near < 0) | (sim <= sims.min(axis=1)[:, None])] = -np.inf
        new = np.flatnonzero((sim > -np.inf).any(axis=1))
        near, sim = near[new], sim[new]
        sim[(near[:, :, None] == ids[new][:, None, :]).any(axis=2)] = -np.inf
        both = np.concatenate([sims[new], sim], axis=1)
        top = np.argpartition(-both, width - 1, axis=1)[:, :width]
        sims[new] = np.take_along_axis(both, top, axis=1)
        ids[new] = np.take_along_axis(np.concatenate([ids[new], near], axis=1), top, axis=1)
        todo[new] = np.take_along_axis(np.concatenate([todo[new], sim > -np.inf], axis=1), top, axis=1)


def _pruned(x: np.ndarray, length: float, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Robust pruning of candidate lists (-1: none), given their inner products with the node; all vectors have the same squared length."""
    left = (ids >= 0) & (sims > -np.inf)
    cand = x[ids]
    far = RELAXED**2 * (length - np.matmul(cand, cand.transpose(0, 2, 1)))
    own, rows = length - sims, np.arange(len(ids))
    kept = np.full((len(ids), DEGREE), -1, dtype=np.int32)
    for k in range(DEGREE):
        at = np.where(left, sims, -np.inf).argmax(axis=1)
        ok = left[rows, at]
        if not ok.any():
            break
        kept[:, k] = np.where(ok, ids[rows, at], -1)
        left &= (far[rows, at] > own) | ~ok[:, None]
        left[rows, at] = False
    return kept


def _packed(lists: np.ndarray) -> np.ndarray:
    """Entries that aren't -1 first."""
    return np.take_along_axis(lists, np.argsort(lists < 0, axis=1, kind="stable"), axis=1)


def _drawn_back(x: np.ndarray, length: float, out: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    sim = np.einsum("ed,ed->e", x[source], x[target])
    order = np.lexsort((source, -sim, target))
    source, target = source[order], target[order]
    who, first, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, count)
    new = np.full((len(who), DEGREE), -1, dtype=np.int32)
    new[np.repeat(np.arange(len(who)), count)[rank < DEGREE], rank[rank < DEGREE]] = source[rank < DEGREE]
    own = out[who, :SLACK]
    new[(new[:, :, None] == own[:, None, :]).any(axis=2)] = -1
    lists = _packed(np.concatenate([own, new], axis=1))
    full = (lists >= 0).sum(axis=1) > SLACK
    for at in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // BATCH) or 1):
        if len(at):
            c = lists[at]
            lists[at, :DEGREE] = _pruned(x, length, c, np.where(c >= 0, np.matmul(x[c], x[who[at]][:, :, None])[:, :, 0], -np.inf))
            lists[at, DEGREE:] = -1
    out[who, :SLACK] = lists[:, :SLACK]


def _reached(out: np.ndarray, start: int) -> np.ndarray:
    seen, edge = np.zeros(len(out), dtype=bool), np.array([start])
    seen[start] = True
    while len(edge):
        new = np.unique(out[edge])
        edge = new[(new >= 0) & ~seen[new]]
        seen[edge] = True
    return seen


def index(v: np.ndarray, seed: int = 44) -> tuple[np.ndarray, int]:
    """The graph of rows v, as a matrix of out-edges (-1: none), and its entry."""
    norms = np.einsum("nd,nd->n", v, v)
    length = float(norms.max())
    x = np.hstack([v, np.sqrt(np.maximum(length - norms, 0))[:, None]]).astype(np.float32)
    out = np.full((len(x), SLACK + SPARE), -1, dtype=np.int32)
    start = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(len(x))
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < len(order):
        batch = order[at : at + min(BATCH, max(1, at // 4))]
        ids, sims = _search(x, out[:, :SLACK], x[batch], start, BEAM)
        kept = _pruned(x, length, ids, sims)
        out[batch, :DEGREE] = kept
        own, place = np.nonzero(kept >= 0)
        _drawn_back(x, length, out, batch[own], kept[own, place])
        at += len(batch)
    while not (seen := _reached(out, start)).all():
        for u in np.flatnonzero(~seen)[:BATCH]:
            spare = seen & (out[:, -1] < 0)
            hosts = np.flatnonzero(spare)
            host = hosts[(x[hosts] @ x[u]).argmax()]
            out[host, SLACK + int((out[host, SLACK:] >= 0).sum())] = u
            seen |= _reached(out, int(u))
    return out, start


def _built(rows: pa.Table) -> pa.Table:
    rows = rows.take(pa.array(np.argsort([i[0].as_py() for i in rows["ids"]], kind="stable")))
    v = np.concatenate([x.values.to_numpy() for x in rows["v"]]).reshape(rows.num_rows, -1)
    out, start = index(v)
    edges = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel(), pa.int32()), out.shape[1]).cast(pa.list_(pa.int32()))
    return pa.table({"shard": rows["shard"], "node": pa.array(np.arange(rows.num_rows), pa.int32()), "v": rows["v"].cast(pa.list_(pa.float64())), "ids": rows["ids"].cast(pa.list_(pa.int64())), "out": edges, "entry": pa.array(np.arange(rows.num_rows) == start)})


def _found(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(graph: pa.Table, queries: pa.Table) -> pa.Table:
        if not graph.num_rows or not queries.num_rows:
            return schema.empty_table()
        graph = graph.take(pa.array(np.argsort(graph["node"].to_numpy())))
        matrix = lambda t, c: np.concatenate([a.flatten().to_numpy() for a in t[c].chunks]).reshape(t.num_rows, -1)
        v, out, q = matrix(graph, "v"), matrix(graph, "out"), matrix(queries, "v")
        members, start = graph["ids"].to_pylist(), int(np.argmax(graph["entry"].to_numpy()))
        query_id, own = queries["query_id"].to_pylist(), queries["own"].to_pylist()
        x, made = v.astype(np.float32), []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            nodes, _ = _search(x, out, part.astype(np.float32), start, max(QUERY_BEAM, 2 * k))
            score = np.where(nodes >= 0, np.einsum("bnd,bd->bn", v[nodes], part), -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")
            for i, places in enumerate(order):
                who, hits, last = query_id[at + i], [], -math.inf
                for node, s in zip(nodes[i, places].tolist(), score[i, places].tolist(), strict=True):
                    if node < 0 or (len(hits) >= k and s < last):
                        break
                    hits += [(-s, m) for m in members[node] if m != who or not np.array_equal(v[node], part[i])]
                    last = s
                made += [(who, own[at + i], m, -s) for s, m in sorted(hits)[:k]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 4, schema.types, strict=True)], schema=schema)

    return run


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double") + F.lit(0.0))  # -0 becomes 0
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & F.exists(v, lambda c: c != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    length = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size(vector) == (length["d"] if length else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def graph_of(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """(shard, node, v, ids, out, entry) of rows (vec_id, v): a graph per shard; ids are the k + 1 smallest of a vector."""
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rank") <= k + 1)  # limited before the shuffle too
    nodes = ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))  # k + 1 at most
    dealt = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")
    return dealt.groupBy("shard").applyInArrow(_built, "shard int, node int, v array<double>, ids array<long>, out array<int>, entry boolean")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of largest inner product that the search finds, but for the query's own row."""
    used = usable(rows, vector)
    asked = store(usable(queries, vector).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("own"), "v"), "neighbours-queries")
    n, d = used.select(F.count("*"), F.max(F.size("v"))).first()
    size = max(1, min(ROOTS * math.isqrt(n) + 1, MOST_BYTES // (8 * (d or 1) + 4 * (SLACK + SPARE))))
    shards, blocks = -(-n // size) or 1, -(-asked.count() // size) or 1
    graph = store(graph_of(used, shards, k), "neighbours-graph")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = graph.withColumn("block", every(blocks)).groupBy("shard", "block")
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "own"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards)).groupBy("shard", "block")
    hits = left.cogroup(right).applyInArrow(_found(k), "query_id long, own long, vec_id long, score double")
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    out = store(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    discard(asked, graph)
    return out
