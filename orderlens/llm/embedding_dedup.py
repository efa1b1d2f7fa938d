"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

Codes (RaBitQ, Gao and Long 2024).  A unit vector o is padded to D dimensions and rotated at random;
its code is the signs of the result, which name the corner x of the cube nearest to it.  Beside
the code stands the correction factor a = <o, x>.  For another unit vector q, rotated alike,
<q, x> / a is an unbiased estimate of <o, q>: with s = <o, q> it strays from s by about
sqrt(1 - s^2) * f, f = sqrt((1 - a^2) / (a^2 (D - 1))).  So with ``SIGMAS`` of these around it
an estimate says that a pair links, that it does not, or that its exact cosine is needed.

* Equal vectors fall together in one aggregation; all later steps see distinct vectors with
  the number of their rows.
* Candidates: ``bands`` of sign bits of further rotations.  Two vectors at the limit share a
  band of k bits with probability p^k, so the number of bands follows from k and ``MISS``, the
  probability that such a pair shares none; k grows with the table, so that a bucket of
  unlike vectors holds about ``BUCKET`` of them.  Inside a bucket codes are compared by differing
  bits, up to a number that a linked pair exceeds with probability below ``MISS``.  A bucket
  yields a spanning forest of its candidates, never the pairs.  A bucket of more than
  ``CELL_ROWS`` rows is dealt to a grid of cells in which every two of its rows meet.
* Connected candidates form groups, and all links lie inside groups.  Groups are compared
  whole: small ones bundled, large ones as tiles of ``TILE`` by ``TILE`` vectors in which every two meet
  once.  In a tile the estimates decide, undecided pairs are recomputed from the original
  values in double precision, and a tile returns its rows' numbers of links and a spanning
  forest.  So a hot group costs memory by the tile, and rows out in proportion to rows in.

Links at or above the limit are exact but for the stated probabilities (MISS per pair and
step at the limit itself, less above it; SIGMAS per estimate, about 2e-9).

Defined results: a vector that is null, empty, zero or holds null or non-finite components links
with nothing and is a component of its own; vectors link only with those of equal length;
equal vectors link with each other; rows of one id are rows of their own, and a component is
named by the smallest non-null id in it (null if it has none); kept is whether a row's id
names its component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.components import connected_components
from orderlens.session import checkpoint_table

COSINE = 0.95
SIGMAS = 6.0
MISS = 1e-6
BUCKET = 512
CODE_BITS = 128
CELL_ROWS = 16_384
TILE = 4096
BROADCAST_ROWS = 1_000_000
SEED = 20_240_521


def code_bits(dim: int) -> int:
    """Bits of a code: the power of two that holds the vector, ``CODE_BITS`` at least."""
    return max(CODE_BITS, 1 << (dim - 1).bit_length())


@lru_cache(maxsize=64)
def _signs(bits: int, number: int):
    import numpy as np

    rng = np.random.default_rng([SEED, bits, number])
    return rng.choice(np.array([-1.0, 1.0]), size=(3, bits))


def rotate(units, number: int):
    """Random rotation ``number`` of vectors (rows), padded to ``code_bits``: three rounds of
    random signs and a Walsh-Hadamard transform."""
    import numpy as np

    n, dim = units.shape
    bits = code_bits(dim)
    out = np.zeros((n, bits))
    out[:, :dim] = units
    for signs in _signs(bits, number):
        out *= signs
        h = 1
        while h < bits:
            pairs = out.reshape(n, bits // (2 * h), 2, h)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, bits)
            h *= 2
        out /= math.sqrt(bits)
    return out


def units_of(values):
    """Rows scaled to length one in double precision."""
    import numpy as np

    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def encode(units):
    """(codes as packed bytes, correction factors) of unit vectors."""
    import numpy as np

    turned = rotate(units, 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])


def estimates(codes, factors, turned):
    """Unbiased estimates of the inner products of coded vectors (rows) and rotated ones (columns)."""
    import numpy as np

    bits = turned.shape[1]
    corners = np.unpackbits(codes, axis=1).astype(np.float32) * np.float32(2) - np.float32(1)
    return (corners @ turned.T.astype(np.float32)) / (factors[:, None] * math.sqrt(bits)).astype(np.float32)


def confidence(factors, bits: int, cosine: float):
    """(refuse, accept) per coded vector: estimates below ``refuse`` mean no link, above ``accept`` a
    link, at ``SIGMAS`` standard deviations."""
    import numpy as np

    spread = SIGMAS * np.sqrt(np.maximum(1 - factors**2, 0) / (factors**2 * (bits - 1)))
    off = math.sqrt(1 - cosine * cosine)
    # the largest estimate that a pair below the limit can reach
    peak = 1 / np.sqrt(1 + spread**2)
    accept = np.where(peak < cosine, np.sqrt(1 + spread**2), cosine + spread * off)
    return cosine - spread * off - 1e-4, accept + 1e-4


def band_plan(n: int, cosine: float) -> tuple[int, int]:
    """(bits of a band, number of bands) for a table of n distinct vectors."""
    k = max(0, min(40, round(math.log2(max(n, 1) / BUCKET))))
    if k == 0:
        return 0, 1
    share = (1 - math.acos(cosine) / math.pi) ** k
    return k, math.ceil(math.log(MISS) / math.log1p(-share))


@lru_cache(maxsize=16)
def most_bits(bits: int, cosine: float) -> int:
    """Differing bits of two codes that a linked pair exceeds with probability below MISS."""
    p = math.acos(cosine) / math.pi
    tail, k = 0.0, bits
    while k > 0:
        log = math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p)
        tail += math.exp(log)
        if tail > MISS:
            return k
        k -= 1
    return 0


class Forest:
    """A spanning forest of links between numbered rows."""

    def __init__(self, n: int):
        import numpy as np

        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, row: int, linked) -> None:
        """Links of a row with the rows ``linked``."""
        import numpy as np

        label, own = self.label, self.label[row]
        labels = label[linked]
        other = labels != own
        if other.any():
            groups, at = np.unique(labels[other], return_index=True)
            self.edges += [(row, int(x)) for x in linked[other][at]]
            label[np.isin(label, groups)] = own


def _vectors(column):
    """(row positions, values as doubles) for each length in an Arrow list column."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    lengths = np.diff(column.offsets.to_numpy())
    flat, start = column.flatten().to_numpy().astype(np.float64), np.append(0, np.cumsum(lengths))
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, flat[start[at][:, None] + np.arange(dim)]


def usable(vectors: str) -> F.Column:
    """Whether a vector takes part."""
    return F.expr(
        f"coalesce({vectors} IS NOT NULL AND forall({vectors}, x -> x IS NOT NULL AND NOT isnan(x) "
        f"AND abs(x) < double('infinity')) AND exists({vectors}, x -> x <> 0), false)"
    )


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, h1, h2, low, rows, v, dim, code, factor), stored: distinct vectors with their codes."""
    import pyarrow as pa

    merged = (
        rows.filter("h1 IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"), F.any_value("v").alias("v"))
        .withColumn("node", F.monotonically_increasing_id())
    )

    def run(batches):
        import numpy as np

        for batch in batches:
            dim = np.zeros(batch.num_rows, dtype=np.int32)
            codes, factors = [b""] * batch.num_rows, np.zeros(batch.num_rows)
            for at, values in _vectors(batch.column("v")):
                packed, factors[at] = encode(units_of(values))
                dim[at] = values.shape[1]
                for i, code in zip(at, packed):
                    codes[i] = code.tobytes()
            columns = [*batch.columns, pa.array(dim), pa.array(codes, pa.binary()), pa.array(factors)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "dim", "code", "factor"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in merged.schema.fields)
    return checkpoint_table(merged.mapInArrow(run, f"{fields}, dim int, code binary, factor double"), "vectors")


def band_rows(nodes: DataFrame, k: int, bands: int) -> DataFrame:
    """(dim, key, node, code): a row per vector and band."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                node, dims = batch.column("node").to_numpy(), batch.column("dim")
                code = batch.column("code")
                for at, values in _vectors(batch.column("v")):
                    units, bits = units_of(values), code_bits(values.shape[1])
                    turns = -(-k * bands // bits)
                    signs = np.concatenate([rotate(units, 1 + t) > 0 for t in range(turns)], axis=1) if k else None
                    where = pa.array(at)
                    for band in range(bands):
                        key = np.full(len(at), band << k, dtype=np.int64)
                        for j in range(k):
                            key += signs[:, band * k + j].astype(np.int64) << j
                        yield pa.RecordBatch.from_arrays(
                            [dims.take(where), pa.array(key), pa.array(node[at]), code.take(where)], ["dim", "key", "node", "code"]
                        )

    return nodes.select("node", "dim", "v", "code").mapInArrow(run, "dim int, key long, node long, code binary")


def small_side(df: DataFrame) -> DataFrame:
    """A broadcast hint for a stored table of few rows, the table itself beyond ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def dealt(rows: DataFrame, keys: list[str], cell_rows: int, both_ways: bool) -> DataFrame:
    """``rows`` with cells, r, c and home: groups of the keys with more than ``cell_rows`` rows as a
    grid of cells by cells, all others as one.

    Every two rows of a group meet in a cell, one of them at home in it, or in (r, r) both.
    ``both_ways``: only cells with r <= c, where a home's meeting with a guest serves both.
    """
    # at most one row for every cell_rows rows
    sizes = checkpoint_table(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
        .select(*keys, F.ceil(F.col("n") / cell_rows).cast("int").alias("cells")),
        "hot-groups",
    )
    marked = rows.join(small_side(sizes), keys, "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    marked = marked.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    others = "r < own" if both_ways else "r <> own"
    homes = "sequence(own, cells - 1)" if both_ways else "sequence(0, cells - 1)"
    grid = (
        "CASE WHEN cells = 1 THEN array(struct(0 AS r, 0 AS c, true AS home)) ELSE concat("
        f"transform({homes}, c -> struct(own AS r, c AS c, true AS home)),"
        f"transform(filter(sequence(0, cells - 1), r -> {others}), r -> struct(r AS r, own AS c, false AS home))) END"
    )
    return marked.select(*rows.columns, "cells", F.explode(F.expr(grid)).alias("_cell")).select(
        *rows.columns, "cells", "_cell.r", "_cell.c", "_cell.home"
    )


def candidate_edges(nodes: DataFrame, cosine: float, cell_rows: int) -> DataFrame:
    """Edges (a, b) between distinct vectors that connect exactly what the candidates connect."""
    import pyarrow as pa

    k, bands = band_plan(nodes.count(), cosine)
    spread = dealt(band_rows(nodes, k, bands), ["dim", "key"], cell_rows, both_ways=False)

    def link(table):
        import numpy as np

        node = table.column("node").to_numpy()
        n, bits = len(node), code_bits(table.column("dim")[0].as_py())
        code = table.column("code").combine_chunks()
        words = np.frombuffer(code.buffers()[2], dtype=np.uint8)[code.offset * bits // 8 :][: n * bits // 8]
        words = words.reshape(n, -1).view(np.uint64)
        homes, most = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False)), most_bits(bits, cosine)
        forest = Forest(n)
        step = max(1, 4_000_000 // max(n, 1))
        for lo in range(0, len(homes), step):
            block = homes[lo : lo + step]
            apart = np.zeros((len(block), n), dtype=np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[block, w][:, None] ^ words[None, :, w])
            close = apart <= most
            for i in np.flatnonzero(close.sum(axis=1) > 1):
                forest.add(int(block[i]), np.flatnonzero(close[i]))
        a, b = zip(*forest.edges) if forest.edges else ((), ())
        return pa.table({"a": pa.array(node[list(a)], pa.int64()), "b": pa.array(node[list(b)], pa.int64())})

    return spread.groupBy("dim", "key", "r", "c").applyInArrow(link, "a long, b long")


def _decide(units, codes, factors, turned, lo: int, hi: int, first: int, cosine: float):
    """Links of rows lo..hi with the rows from ``first`` on, as a matrix."""
    import numpy as np

    found = estimates(codes[lo:hi], factors[lo:hi], turned[first:])
    refuse, accept = confidence(factors[lo:hi], turned.shape[1], cosine)
    linked = found >= accept[:, None].astype(np.float32)
    unsure = (found >= refuse[:, None].astype(np.float32)) & ~linked
    count = int(unsure.sum())
    if 8 * count > unsure.size:  # most pairs need it: one product gives them all
        linked |= unsure & (units[lo:hi] @ units[first:].T >= cosine)
    elif count:
        i, j = np.nonzero(unsure)
        for at in range(0, count, 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            linked[a, b] = np.einsum("ij,ij->i", units[lo + a], units[first + b]) >= cosine
    return linked


def compare(units, codes, factors, weights, n_homes: int, forest: Forest, cosine: float):
    """Links of a tile: the first ``n_homes`` rows with the others, or with each other where
    there are no others.  Returns each row's number of linked rows, copies counted."""
    import numpy as np

    n = len(units)
    counts = np.zeros(n, dtype=np.int64)
    turned = rotate(units, 0)
    inner = n_homes == n
    step = max(1, 2_000_000 // max(n, 1))
    for lo in range(0, n_homes, step):
        hi = min(lo + step, n_homes)
        first = lo if inner else n_homes
        linked = _decide(units, codes, factors, turned, lo, hi, first, cosine)
        if inner:
            linked &= np.arange(first, n)[None, :] > np.arange(lo, hi)[:, None]
        counts[lo:hi] += linked @ weights[first:]
        counts[first:] += weights[lo:hi] @ linked
        for i in np.flatnonzero(linked.any(axis=1)):
            forest.add(lo + int(i), first + np.flatnonzero(linked[i]))
    return counts


def group_links(nodes: DataFrame, groups: DataFrame, cosine: float, tile: int) -> DataFrame:
    """(node, other, n), stored: rows without ``other`` sum up to a vector's number of links, the rest
    are edges that connect what the links connect."""
    import pyarrow as pa

    members = nodes.select("node", "dim", "rows", "v", "code", "factor").join(groups, "node")
    spread = dealt(members, ["root"], tile, both_ways=True)
    # whole small groups share bundles of about a tile; a tile of a large group stands alone
    bundles = F.lit(max(1, groups.count() // tile))
    large = F.col("cells") > 1
    spread = spread.withColumn("one", F.when(large, F.col("root"))).withColumn(
        "bundle", F.when(~large, F.pmod(F.xxhash64("root"), bundles))
    )

    def link(table):
        import numpy as np

        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        order = np.lexsort((~home, root))
        node, root, home = node[order], root[order], home[order]
        weights, factors = table.column("rows").to_numpy()[order], table.column("factor").to_numpy()[order]
        ((_, values),) = _vectors(table.column("v"))
        units = units_of(values)[order]
        code = table.column("code").combine_chunks().to_pylist()
        codes = np.frombuffer(b"".join(code[i] for i in order), dtype=np.uint8).reshape(len(order), -1)
        out_node, out_other, out_n = [], [], []
        starts = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(root))
        for a, b in zip(starts, starts[1:]):
            forest = Forest(b - a)
            counts = compare(units[a:b], codes[a:b], factors[a:b], weights[a:b], int(home[a:b].sum()), forest, cosine)
            at = np.flatnonzero(counts)
            out_node += node[a:b][at].tolist()
            out_other += [None] * len(at)
            out_n += counts[at].tolist()
            for x, y in forest.edges:
                out_node.append(int(node[a + x]))
                out_other.append(int(node[a + y]))
                out_n.append(0)
        kinds = pa.int64()
        return pa.table({"node": pa.array(out_node, kinds), "other": pa.array(out_other, kinds), "n": pa.array(out_n, kinds)})

    return checkpoint_table(
        spread.drop("cells").groupBy("dim", "bundle", "one", "r", "c").applyInArrow(link, "node long, other long, n long"), "vector-links"
    )


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    cell_rows: int = CELL_ROWS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept)."""
    source = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    ok = usable("v")
    rows = source.select(
        "id", "v", F.when(ok, F.xxhash64("v")).alias("h1"), F.when(ok, F.xxhash64(F.lit("second identity"), "v")).alias("h2")
    )
    nodes = distinct_vectors(rows)
    groups = checkpoint_table(connected_components(candidate_edges(nodes, cosine, cell_rows)), "vector-groups")
    links = group_links(nodes, groups, cosine, tile)
    sums = links.filter("other IS NULL").groupBy("node").agg(F.sum("n").alias("linked"))
    roots = connected_components(links.filter("other IS NOT NULL").select("node", "other"))
    placed = (
        nodes.select("node", "h1", "h2", "low", "rows")
        .join(sums, "node", "left")
        .join(roots, "node", "left")
        .select("h1", "h2", "low", "rows", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"))
    )
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lows, "root").select("h1", "h2", (F.col("rows") - 1 + F.col("linked")).alias("n_links"), "component_id")
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
