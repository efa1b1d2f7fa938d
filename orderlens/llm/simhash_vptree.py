"""SimHash near-duplicates: exact Hamming links by vantage-point trees.

Fingerprints.  Texts are lower-cased (A-Z), cut into words and word shingles; a bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes.

Links.  Two fingerprints link at ``max_bits`` or fewer differing bits.  Copies share a
fingerprint, so the search runs over distinct fingerprints.  In the full 64-bit space the
distances of unrelated fingerprints crowd around 32, and a radius of 4 prunes next to
nothing.  So the bits are split into ``blocks`` ranges: of a linked pair, one range differs in
at most ``max_bits // blocks`` bits.  The Hamming distance on a range is a metric of its own,
and each range gets a vantage-point tree with that smaller radius:

* an inner node has a vantage value and a median distance; a fingerprint lives on the side
  of the median on which its own distance falls, down to one home shard (leaf);
* it also visits each side that its ball can reach by the triangle bound, so that
  shards next to a boundary see it as a guest;
* in a shard, homes are compared with homes and guests over all 64 bits, so the pairs are
  exact.

The trees are fitted on a bounded sample (``SAMPLE`` fingerprints, by hash) and grow until a
leaf is expected to hold ``LEAF_ROWS`` homes; every fingerprint is routed through them.  A shard
with more rows than ``CELL_ROWS`` is split into a grid of cells, homes by homes' hash and guests
by theirs, so no task holds an unbounded group and no pair is lost.  A cell returns a
spanning forest of its links (fewer edges than rows), never all pairs of a dense group;
components are joined from those forests, which keeps every link's effect.

Defined results: a null text, and one without words, has fingerprint zero and links like any
other; rows with the same id are judged one by one and the component's id is the smallest
non-null id in it (null if it has none); an empty table gives an empty result; other
columns are ignored, or kept by :func:`deduplicate_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.components import connected_components
from orderlens.session import checkpoint_table

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 3
SEED = 42
SAMPLE = 16_384
LEAF_ROWS = 1024
CELL_ROWS = 65_536
BROADCAST_ROWS = 1_000_000


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as an unsigned integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        first = [0, *ends[:-1].tolist()]
        last = (ends - 1).tolist()
        n = len(words) - shingle + 1
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[:n], last[shingle - 1 :])]
    bits = np.zeros(64, dtype=np.int64)
    array = np.array(hashes, dtype="<u8")
    for lo in range(0, len(array), 65_536):
        part = array[lo : lo + 65_536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(array), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per input row, fp as a signed long."""
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((simhash(t.as_py() or "", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp long")


@dataclass
class VantageTree:
    """A tree over the values of one bit range; children below zero are leaves."""

    shift: int
    mask: int
    radius: int
    vantage: list[int] = field(default_factory=list)
    median: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    leaves: int = 0

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def fit(self, values, most: float, rng) -> int:
        """Grow a subtree for sampled values and return its root; a node with at most
        ``most`` of them, or with no median that splits them, becomes a leaf."""
        import numpy as np

        if len(values) <= most:
            return self._leaf()
        best = None
        for v in rng.choice(values, size=min(8, len(values)), replace=False):
            d = np.bitwise_count(values ^ v).astype(int)
            m = int(np.median(d))
            if d.max() <= m:
                m -= 1
            inner = int((d <= m).sum())
            both = int(((d > m - self.radius) & (d <= m + self.radius)).sum())
            cost = max(inner, len(d) - inner) + both
            if 0 < inner < len(d) and (best is None or cost < best[0]):
                best = (cost, int(v), m, d <= m)
        if best is None:
            return self._leaf()
        node = len(self.vantage)
        self.vantage.append(best[1])
        self.median.append(best[2])
        self.inside.append(0)
        self.outside.append(0)
        self.inside[node] = self.fit(values[best[3]], most, rng)
        self.outside[node] = self.fit(values[~best[3]], most, rng)
        return node

    def route(self, fps, root: int):
        """(row, leaf number, is home) of every shard that the fingerprints live in or reach."""
        import numpy as np

        value = (fps >> np.uint64(self.shift)) & np.uint64(self.mask)
        vantage = np.array([*self.vantage, 0], dtype=np.uint64)
        median, inside, outside = (np.array([*a, 0], dtype=np.int64) for a in (self.median, self.inside, self.outside))
        row = np.arange(len(fps))
        node = np.full(len(fps), root)
        home = np.ones(len(fps), dtype=bool)
        done = []
        while len(row):
            leaf = node < 0
            done.append((row[leaf], -node[leaf] - 1, home[leaf]))
            row, node, home = row[~leaf], node[~leaf], home[~leaf]
            d = np.bitwise_count(value[row] ^ vantage[node]).astype(np.int64)
            m = median[node]
            near, go_in, go_out = d <= m, d <= m + self.radius, d > m - self.radius
            row, node, home = (
                np.concatenate([row[go_in], row[go_out]]),
                np.concatenate([inside[node[go_in]], outside[node[go_out]]]),
                np.concatenate([(home & near)[go_in], (home & ~near)[go_out]]),
            )
        return tuple(np.concatenate(c) for c in zip(*done))


def fit_forest(sample, n_total: int, max_bits: int, blocks: int, leaf_rows: int) -> list[tuple[VantageTree, int, int]]:
    """(tree, root, number of its first shard) per bit range."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    forest, first = [], 0
    for lo, hi in zip(cuts, cuts[1:]):
        tree = VantageTree(lo, (1 << (hi - lo)) - 1, max_bits // blocks)
        values = (sample >> np.uint64(lo)) & np.uint64(tree.mask)
        root = tree.fit(values, max(1.0, leaf_rows * len(sample) / max(n_total, 1)), rng)
        forest.append((tree, root, first))
        first += tree.leaves
    return forest


def link_forest(fps, home, max_bits: int):
    """Edges (positions a, b) of a spanning forest of the links between homes and all rows."""
    import numpy as np

    n = len(fps)
    label = np.arange(n)
    edges: list[tuple[int, int]] = []
    homes = np.flatnonzero(home)
    step = max(1, 2_000_000 // max(n, 1))
    for lo in range(0, len(homes), step):
        block = homes[lo : lo + step]
        close = np.bitwise_count(fps[block][:, None] ^ fps[None, :]) <= max_bits
        for k in np.flatnonzero(close.sum(axis=1) > 1):
            h, found = block[k], np.flatnonzero(close[k])
            groups, where = np.unique(label[found], return_index=True)
            if len(groups) == 1:
                continue
            for g, at in zip(groups, where):
                if g != label[h]:
                    edges.append((h, found[at]))
            label[np.isin(label, groups)] = groups[0]
    return edges


def linked_pairs(
    distinct: DataFrame,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    leaf_rows: int = LEAF_ROWS,
    cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE,
) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly what the
    links connect."""
    import numpy as np
    import pyarrow as pa

    n_total = distinct.count()
    picked = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    sample = np.array([r.fp for r in picked], dtype=np.int64).view(np.uint64)
    forest = fit_forest(sample, n_total, max_bits, blocks, leaf_rows)

    def route(batches):
        for batch in batches:
            signed = batch.column(0).to_numpy()
            fps = signed.view(np.uint64)
            for lo in range(0, len(fps), 8192):
                for tree, root, first in forest:
                    row, leaf, home = tree.route(fps[lo : lo + 8192], root)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((leaf + first).astype(np.int32)), pa.array(signed[lo + row]), pa.array(home)],
                        ["shard", "fp", "home"],
                    )

    routed = checkpoint_table(distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean"), "shards")
    # One row per shard: at most as many as the sample allows, so broadcasting is bounded.
    sides = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "cells", F.ceil(F.col("n") / cell_rows).cast("int")
    )
    spread = (
        routed.join(F.broadcast(sides.select("shard", "cells")), "shard")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
        # a home meets every column of its grid row; every row (homes too) meets every grid row
        .withColumn(
            "cell",
            F.explode(
                F.expr(
                    "CASE WHEN cells = 1 THEN array(struct(0 AS r, 0 AS c, home AS home)) "
                    "WHEN home THEN array_union("
                    "transform(sequence(0, cells - 1), c -> struct(own AS r, c AS c, true AS home)),"
                    "transform(filter(sequence(0, cells - 1), r -> r <> own), r -> struct(r AS r, own AS c, false AS home)))"
                    " ELSE transform(sequence(0, cells - 1), r -> struct(r AS r, own AS c, false AS home)) END"
                )
            ),
        )
        .select("shard", F.col("cell.r").alias("r"), F.col("cell.c").alias("c"), "fp", F.col("cell.home").alias("home"))
    )

    def links(pdf):
        import pandas as pd

        signed = pdf["fp"].to_numpy()
        edges = link_forest(signed.view(np.uint64), pdf["home"].to_numpy(), max_bits)
        a, b = zip(*edges) if edges else ((), ())
        return pd.DataFrame({"a": signed[list(a)], "b": signed[list(b)]}, dtype=np.int64)

    return spread.groupBy("shard", "r", "c").applyInPandas(links, "a long, b long")


def _placed(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    shingle: int,
    max_bits: int,
    blocks: int,
    leaf_rows: int,
    cell_rows: int,
    sample_rows: int,
) -> DataFrame:
    """(id, fp, root, component_id) per input row; root is the component's smallest fingerprint
    (ids may repeat, so they do not name components)."""
    rows = checkpoint_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = checkpoint_table(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    edges = linked_pairs(distinct, max_bits, blocks, leaf_rows, cell_rows, sample_rows)
    roots = connected_components(edges)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = placed.select("fp", "root").join(lows, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    leaf_rows: int = LEAF_ROWS,
    cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE,
) -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component_id)."""
    rows = _placed(docs, id_col, text_col, shingle, max_bits, blocks, leaf_rows, cell_rows, sample_rows)
    return rows.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (null last), in the
    input's columns.  Of rows that repeat its id within the component one stays."""
    found = checkpoint_table(
        _placed(docs, "doc_id", "text", SHINGLE, MAX_BITS, BLOCKS, LEAF_ROWS, CELL_ROWS, SAMPLE), "near-duplicates"
    )
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("k"))
    per_id = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    marked = checkpoint_table(
        keep.join(per_id, F.col("k.id").eqNullSafe(per_id["id"])).select(
            F.col("k.id").alias("k_id"), F.col("k.fp").alias("k_fp"), "n"
        ),
        "kept-ids",
    )
    plain = marked.filter("n = 1 AND k_id IS NOT NULL").select(F.col("k_id").alias("doc_id"))
    if plain.count() <= BROADCAST_ROWS:  # ids alone, 8 bytes each; beyond that a shuffle join
        plain = F.broadcast(plain)
    out = docs.join(plain, "doc_id", "left_semi").select(*docs.columns)
    repeated = marked.filter("n > 1 OR k_id IS NULL").select("k_id", "k_fp").distinct()
    if not repeated.isEmpty():
        # Ids that do not name one row: find the rows by id and fingerprint, then keep one each.
        rows = docs.join(repeated.select("k_id").distinct(), docs.doc_id.eqNullSafe(F.col("k_id")), "left_semi")
        out = out.unionByName(_one_row_each(rows, repeated))
    return out


def _one_row_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One of ``rows`` for each (k_id, k_fp)."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    columns = rows.columns

    def run(batches):
        import numpy as np

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            fps = np.array([simhash(t.as_py() or "") for t in texts], dtype=np.uint64)
            yield batch.append_column("__fp", pa.array(fps.view(np.int64)))

    with_fp = rows.mapInArrow(run, StructType([*rows.schema.fields]).add("__fp", LongType()))
    hit = with_fp.join(ids, with_fp.doc_id.eqNullSafe(ids.k_id) & (with_fp["__fp"] == ids.k_fp), "left_semi")
    firsts = hit.groupBy("doc_id", "__fp").agg(F.min(F.struct(*[hit[c] for c in columns])).alias("__row"))
    return firsts.select(*[F.col("__row").getField(c).alias(c) for c in columns])
