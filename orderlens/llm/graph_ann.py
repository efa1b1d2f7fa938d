"""Approximate nearest neighbours by inner product: robust-pruned directed graphs.

Equal vectors are one node, which carries the ``k + 1`` smallest rows of its copies: no more of
them can appear in a result, so a vector that a third of all rows share costs one node.
Nodes are dealt to shards of about ``shard_rows`` by a hash.  Each shard becomes a Vamana graph
(Subramanya et al. 2019): points are inserted in growing batches, a greedy beam search from
the medoid proposes neighbours, and robust pruning keeps an edge only if no kept neighbour is
closer to the candidate by the factor ``alpha``; edges are added in reverse and lists that
overflow are pruned again.  Largest inner product becomes nearest distance through one
extra coordinate that gives all of a shard's points the same norm.

Graphs are stored, so a lost executor or another block of queries does not build them
again.  Every block of queries visits every shard with a beam search; candidates are scored
in double precision on the original vectors, and the best k per query over all shards remain.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, as queries or candidates; vectors of different lengths are never
compared; a query's own row is no candidate, but other rows with its id or its vector are;
ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import checkpoint_table

SHARD_ROWS = 16_384
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 128
QUERY_BLOCK = 16_384


class Graph:
    """A pruned directed graph over points (float32 rows); lists are padded with -1."""

    def __init__(self, points, degree: int, alpha: float, beam: int):
        import numpy as np

        self.np, self.x = np, points
        self.norm = np.einsum("ij,ij->i", points, points)
        self.degree, self.alpha, self.beam = degree, alpha, beam
        n = len(points)
        self.slack = degree + degree // 2
        self.adj = np.full((n, self.slack), -1, dtype=np.int32)
        self.deg = np.zeros(n, dtype=np.int32)
        self.start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0

    def search(self, queries, beam: int, visited: bool = False):
        """Beam search of all queries at once: (ids, squared distances) of each query's beam in
        ascending distance, -1 where the graph has fewer; optionally the expanded ids too."""
        np = self.np
        b = len(queries)
        ids = np.full((b, beam), -1, dtype=np.int32)
        dist = np.full((b, beam), np.inf, dtype=np.float32)
        open_ = np.zeros((b, beam), dtype=bool)
        ids[:, 0] = self.start
        qn = np.einsum("ij,ij->i", queries, queries)
        dist[:, 0] = qn + self.norm[self.start] - 2 * (queries @ self.x[self.start])
        open_[:, 0] = True
        met = np.zeros((b, len(self.x)), dtype=bool)  # a distance is computed once per query and node
        met[:, self.start] = True
        flat = met.reshape(-1)
        seen: list = []
        live = np.arange(b)
        while len(live):
            o = open_[live]
            has = o.any(axis=1)
            live = live[has]
            if not len(live):
                break
            at = o[has].argmax(axis=1)  # beams are sorted, so the first open entry is the nearest
            node = ids[live, at]
            open_[live, at] = False
            if visited:
                seen.append((live, node, dist[live, at]))
            nbr = self.adj.take(node, axis=0)
            fresh = (nbr >= 0) & ~flat.take(live[:, None] * len(self.x) + nbr)
            moved = fresh.any(axis=1)
            who, nbr, fresh = live[moved], nbr[moved], fresh[moved]
            r, c = np.nonzero(fresh)
            q, new = who[r], nbr[r, c]
            met[q, new] = True
            d = np.full(nbr.shape, np.inf, dtype=np.float32)
            inner = np.einsum("nd,nd->n", self.x.take(new, axis=0), queries.take(q, axis=0))
            d[r, c] = qn[q] + self.norm[new] - 2 * inner
            all_d = np.concatenate([dist[who], d], axis=1)
            pick = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            pick += np.arange(len(who))[:, None] * all_d.shape[1]
            near = all_d.take(pick)
            dist[who] = near
            ids[who] = np.where(np.isinf(near), -1, np.concatenate([ids[who], nbr], axis=1).take(pick))
            open_[who] = np.concatenate([open_[who], fresh], axis=1).take(pick) & ~np.isinf(near)
        return (ids, dist, seen) if visited else (ids, dist)

    def prune(self, nodes, cand):
        """Robust pruning: out-lists (padded, at most ``degree``) for nodes from their candidate
        ids (padded with -1, no repeats within a row)."""
        np = self.np
        out = np.full((len(nodes), self.slack), -1, dtype=np.int32)
        x = self.x[cand]
        norm = self.norm[cand]
        own = norm + self.norm[nodes][:, None] - 2 * np.einsum("bcd,bd->bc", x, self.x[nodes])
        alive = (cand >= 0) & (cand != nodes[:, None])
        a2 = self.alpha**2  # squared distances
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            best = np.where(alive, own, np.inf).argmin(axis=1)
            ok = alive[rows, best]
            if not ok.any():
                break
            out[ok, k] = cand[rows[ok], best[ok]]
            # by picks, not for all pairs: a batch of small products would keep BLAS threads spinning
            between = norm + norm[rows, best][:, None] - 2 * np.einsum("bcd,bd->bc", x, x[rows, best])
            alive &= a2 * between > own
            alive[rows, best] = False
        return out

    def build(self, batch: int = 512):
        """Insert all points, in batches that at most double the graph."""
        np = self.np
        n = len(self.x)
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32)
        lo = 1
        while lo < n:
            hi = min(n, lo + min(lo, batch))
            self._insert(order[lo:hi])
            lo = hi
        for lo in range(0, n, batch):
            over = np.arange(lo, min(n, lo + batch))
            over = over[self.deg[over] > self.degree]
            if len(over):
                self._set(over, self.prune(over, self.adj[over]))
        return self

    def _set(self, nodes, lists) -> None:
        self.adj[nodes] = lists
        self.deg[nodes] = (lists >= 0).sum(axis=1)

    def _insert(self, nodes) -> None:
        np = self.np
        _, _, seen = self.search(self.x[nodes], self.beam, visited=True)
        # candidates: everything expanded on the way, which the final beam is part of
        extra: list[list[int]] = [[] for _ in nodes]
        for live, node, _ in seen:
            for q, v in zip(live.tolist(), node.tolist()):
                extra[q].append(v)
        cand = np.full((len(nodes), max(map(len, extra))), -1, dtype=np.int32)
        for q, vs in enumerate(extra):
            cand[q, : len(vs)] = vs
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        self._set(nodes, self.prune(nodes, cand))
        # reverse edges, grouped by their source
        src = np.repeat(nodes, self.slack)
        dst = self.adj[nodes].ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        fits = self.deg[heads] + count <= self.slack
        for h, f, c in zip(heads[fits].tolist(), first[fits].tolist(), count[fits].tolist()):
            at = self.deg[h]
            self.adj[h, at : at + c] = src[f : f + c]
            self.deg[h] = at + c
        full = np.flatnonzero(~fits)
        for lo in range(0, len(full), 128):
            some = full[lo : lo + 128]
            width = int((self.deg[heads[some]] + count[some]).max())
            cand = np.full((len(some), width), -1, dtype=np.int32)
            for row, k in enumerate(some.tolist()):
                h, d = heads[k], self.deg[heads[k]]
                cand[row, :d] = self.adj[h, :d]
                cand[row, d : d + count[k]] = src[first[k] : first[k] + count[k]]
            self._set(heads[some], self.prune(heads[some], cand))


def _vector_type(frame: DataFrame) -> str:
    """Type that holds the vectors ``v`` as they are: floats stay floats, other numbers are doubles."""
    return "array<float>" if frame.schema["v"].dataType.elementType.typeName() == "float" else "array<double>"


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row_no, vec_id, v): rows whose vector can be compared, as a stored table, so that row
    numbers stay what they are."""
    v = F.col(vector_col).cast("array<double>")
    fine = (
        F.col(vector_col).isNotNull()
        & (F.size(vector_col) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0)
    )
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(fine, F.lit(False)).alias("ok"))
    return checkpoint_table(
        rows.filter("ok").select(F.monotonically_increasing_id().alias("row_no"), "vec_id", "v"), "vectors"
    )


def distinct_nodes(rows: DataFrame, k: int) -> DataFrame:
    """(v, copies): distinct vectors with the k + 1 smallest (vec_id, row_no) of their rows.
    The rank filter is applied before the exchange as well, so a hot vector stays small."""
    w = Window.partitionBy("v").orderBy("vec_id", "row_no")
    some = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1)
    return some.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row_no"))).alias("copies"))


def build_index(
    nodes: DataFrame,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    alpha: float = ALPHA,
    beam: int = BUILD_BEAM,
) -> DataFrame:
    """(dim, shard, pos, v, copies, out): the stored graphs; ``out`` holds positions in the shard."""
    stored = checkpoint_table(nodes.withColumn("dim", F.size("v")), "ann-nodes")
    sizes = stored.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    # one row per vector length
    dealt = stored.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), "shards").cast("int"))
    kind = _vector_type(stored)
    schema = (
        f"dim int, shard int, pos int, v {kind}, copies array<struct<vec_id:long,row_no:long>>, out array<int>"
    )

    def build(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("key", ignore_index=True)
        x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
        graph = Graph(_same_norm(x), degree, alpha, beam).build()
        return pd.DataFrame(
            {
                "dim": pdf["dim"], "shard": pdf["shard"], "pos": np.arange(len(pdf)), "v": pdf["v"],
                "copies": pdf["copies"], "out": [a[:d] for a, d in zip(graph.adj, graph.deg)],
            }
        )

    graphs = (
        dealt.select("dim", "shard", F.col("v").cast(kind).alias("v"), "copies", F.xxhash64("v").alias("key"))
        .groupBy("dim", "shard")
        .applyInPandas(build, schema)
    )
    return checkpoint_table(graphs, "ann-graphs")


def _same_norm(x):
    """Points with one more coordinate, all of the norm of the longest."""
    import numpy as np

    norm = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)


def search_index(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    degree: int = DEGREE,
    beam: int = SEARCH_BEAM,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (row_no, vec_id, v): k best per query."""
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // query_block))
    shards = index.select("dim", "shard").distinct()
    # Queries visit every shard of their length, block by block; graphs go once to each block.
    asked = (
        queries.select("row_no", "vec_id", F.col("v").cast(_vector_type(queries)).alias("v"), F.size("v").alias("dim"))
        .withColumn("block", F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int"))
        .join(F.broadcast(shards.groupBy("dim").agg(F.collect_set("shard").alias("shards"))), "dim")
        .select("dim", F.explode("shards").alias("shard"), "block", "row_no", "vec_id", "v")
    )
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(nodes, qs):
        import numpy as np
        import pandas as pd

        empty = pd.DataFrame({"row_no": [], "query_id": [], "vec_id": [], "cand_row": [], "score": []})
        if not len(nodes) or not len(qs):
            return empty
        nodes = nodes.sort_values("pos", ignore_index=True)
        exact = np.stack(nodes["v"].to_numpy()).astype(np.float64)
        graph = Graph(_same_norm(exact.astype(np.float32)), degree, 1.0, beam)
        for at, out in enumerate(nodes["out"]):
            graph.adj[at, : len(out)] = out
        copies = nodes["copies"].tolist()
        out = []
        for lo in range(0, len(qs), 512):
            part = qs.iloc[lo : lo + 512]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            padded = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
            ids, _ = graph.search(padded, max(beam, k + 1))
            scores = np.einsum("bkd,bd->bk", exact[ids], q)
            scores[ids < 0] = -np.inf
            for row, (own, name) in enumerate(zip(part["row_no"], part["vec_id"])):
                found = []
                floor = -np.inf
                for s, node in sorted(zip(scores[row].tolist(), ids[row].tolist()), reverse=True):
                    if node < 0 or (len(found) >= k and s < floor):
                        break
                    found += [(s, c["vec_id"], c["row_no"]) for c in copies[node] if c["row_no"] != own]
                    floor = s
                found.sort(key=lambda f: (-f[0], f[1], f[2]))
                out += [(own, name, v, r, s) for s, v, r in found[:k]]
        return pd.DataFrame(out, columns=empty.columns) if out else empty

    found = (
        asked.groupBy("dim", "shard", "block")
        .cogroup(graphs.groupBy("dim", "shard", "block"))
        .applyInPandas(
            lambda qs, nodes: search(nodes, qs), "row_no long, query_id long, vec_id long, cand_row long, score double"
        )
    )
    w = Window.partitionBy("row_no").orderBy(F.desc("score"), "vec_id", "cand_row")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_neighbours(
    table: DataFrame,
    query_filter: str,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that match ``query_filter`` (over vec_id), the
    ``k`` rows found with the largest inner product."""
    rows = usable_vectors(table, id_col, vector_col)
    index = build_index(distinct_nodes(rows, k), shard_rows, degree)
    return search_index(index, rows.filter(query_filter), k, degree, beam)
