"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time evaluation.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased.  Scores
are whole numbers: a term's weight falls with the number of documents that hold it, its
occurrences saturate and are measured against the document's length.

* The items are the queries.  They are worked in blocks of about ``BLOCK_TERMS`` (item, term)
  pairs, and only a block's terms and document frequencies pass through the driver.
* One pass over the documents counts terms and stores, per document, its length and the
  occurrences of the block's terms.  The corpus counts (documents, terms, document
  frequencies) are sums over that table, partial sums first.
* Every task cuts its documents into shards of at most ``SHARD_DOCS`` documents and
  ``SHARD_POSTINGS`` postings, inverts a shard into lists ordered by document, and evaluates
  all queries on it:

  - the short lists of a query are summed term at a time into accumulators;
  - the accumulators become one more list, bounded by the largest of them, beside the long
    lists and their own bounds;
  - the lists are walked document at a time, one window of documents after the other.  Lists
    whose bounds together stay below the k-th best score so far cannot bring up a new
    document: they are only probed, from the largest bound on, for documents that can still
    reach that score, and skipped altogether when none can.

  The best k of a query and its k-th score are carried from shard to shard of a task, so a
  task returns at most k rows a query, and one window over these picks the final ranks.

Defined results: a null text has no terms and its document counts for nothing; every row of
the items is a query of its own, also when rows repeat; a null or wordless item finds nothing;
equal scores go by id, null ids last; rows with one id are documents of their own; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import checkpoint_table

TOP = 10
BLOCK_TERMS = 1_000_000
SHARD_DOCS = 65_536
SHARD_POSTINGS = 8_000_000
WINDOW_DOCS = 8192
# Accumulators may hold this share of a shard's documents.
SHORT_SHARE = 0.25

# Every ASCII character that is no digit or letter becomes a blank, A-Z become a-z.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(q, item_id, terms): the distinct terms of every item; q numbers the rows."""
    import pyarrow as pa

    source = items.select(
        F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")
    )

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            terms = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("item_id"), terms], ["q", "item_id", "terms"])

    kind = source.schema["item_id"].dataType.simpleString()
    return checkpoint_table(source.mapInArrow(run, f"q long, item_id {kind}, terms array<binary>"), "item-terms")


def document_postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term: its number of terms, and numbers
    and occurrences of its terms from the vocabulary."""
    import pyarrow as pa

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keep, ns, terms, tfs = [], [], [], []
                for i, text in enumerate(part.column("text")):
                    words = terms_of(text.as_py())
                    if words:
                        held = [(vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary]
                        keep.append(i)
                        ns.append(len(words))
                        terms.append([t for t, _ in held])
                        tfs.append([c for _, c in held])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(keep, pa.int64())),
                        pa.array(ns, pa.int64()),
                        pa.array(terms, pa.list_(pa.int32())),
                        pa.array(tfs, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "terms", "tfs"],
                )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<long>")


def corpus_counts(postings: DataFrame, n_terms: int):
    """(documents, terms with repeats, document frequency per term number)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["term", "df"])

    n_docs, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, dtype=np.int64)
    for row in postings.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    return n_docs, length, df


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def id_order(value):
    """Sort key of ids, null last."""
    return (True, 0) if value is None else (False, value)


class Shard:
    """The inverted lists of some documents, ordered by id (null last)."""

    def __init__(self, ids, n, ends, terms, tfs, weights, n_docs: int, length: int):
        import numpy as np

        order = sorted(range(len(ids)), key=lambda i: id_order(ids[i]))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
            n = n.astype(object)  # beyond 64 bits: Python's integers
        m = (10 + (90 * n * n_docs) // length).astype(np.int64)
        counts = np.diff(ends)
        doc = np.repeat(place, counts)
        score = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts)))
        by = np.lexsort((doc, terms))
        self.doc, self.score = doc[by], score[by]
        self.terms, first = np.unique(terms[by], return_index=True)
        self.ends = np.append(first, len(by))
        self.bounds = np.maximum.reduceat(self.score, first) if len(first) else np.zeros(0, dtype=np.int64)

    def lists(self, query):
        """(documents, scores, bound) of the query's terms here, shortest first."""
        import numpy as np

        at = np.searchsorted(self.terms, query)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == query)] if len(self.terms) else at[:0]
        found = [(self.doc[self.ends[i] : self.ends[i + 1]], self.score[self.ends[i] : self.ends[i + 1]], int(self.bounds[i])) for i in at]
        return sorted(found, key=lambda x: len(x[0]))


def accumulate(lists, n_docs: int):
    """Term at a time: one list with the summed scores of several."""
    import numpy as np

    total = np.zeros(n_docs, dtype=np.int64)
    for doc, score, _ in lists:  # a list holds a document once
        total[doc] += score
    doc = np.flatnonzero(total)
    score = total[doc]
    return doc, score, int(score.max()) if len(score) else 0


def evaluate(shard: Shard, query, k: int, floor: int):
    """(places, scores) of documents that hold the shard's best k with a score of at least
    ``floor``, ties by place: best first, at most k."""
    import numpy as np

    n_docs, lists = len(shard.ids), shard.lists(query)
    taken, room = 0, SHORT_SHARE * n_docs
    while taken < len(lists) and len(lists[taken][0]) <= room:
        room -= len(lists[taken][0])
        taken += 1
    short, walked = lists[:taken], lists[taken:]
    threshold = max(floor, 1)
    if short:
        sums = accumulate(short, n_docs)
        walked.append(sums)
        if len(sums[1]) >= k:  # long lists only add to these
            threshold = max(threshold, int(np.partition(sums[1], -k)[-k]))
    walked.sort(key=lambda x: x[2])
    reach = np.cumsum([0, *(bound for _, _, bound in walked)])
    best = np.zeros(0, dtype=np.int64)
    best_score = np.zeros(0, dtype=np.int64)
    for low in range(0, n_docs, WINDOW_DOCS):
        high = min(low + WINDOW_DOCS, n_docs)
        # lists before ``first`` cannot lift a document to the threshold by themselves
        first = int(np.searchsorted(reach, threshold, side="left")) - 1
        if first >= len(walked):
            break
        total = np.zeros(high - low, dtype=np.int64)
        for doc, score, _ in walked[first:]:
            a, b = np.searchsorted(doc, (low, high))
            total[doc[a:b] - low] += score[a:b]
        near = np.flatnonzero(total)
        have = total[near]
        near += low
        for j in range(first - 1, -1, -1):
            able = have + reach[j + 1] >= threshold
            near, have = near[able], have[able]
            if not len(near):
                break
            doc, score, _ = walked[j]
            at = np.minimum(np.searchsorted(doc, near), len(doc) - 1)
            have = have + np.where(doc[at] == near, score[at], 0)
        good = have >= threshold
        best, best_score = np.append(best, near[good]), np.append(best_score, have[good])
        if len(best) > k:
            top = np.lexsort((best, -best_score))[:k]
            best, best_score = best[top], best_score[top]
        if len(best) == k:
            threshold = max(threshold, int(best_score.min()))
    top = np.lexsort((best, -best_score))
    return best[top], best_score[top]


def best_documents(postings: DataFrame, queries: dict[int, list[int]], weights, n_docs: int, length: int, k: int) -> DataFrame:
    """(q, id, score): at most k rows a query and task, every final one among them."""
    import numpy as np
    import pyarrow as pa

    kind = postings.schema["id"].dataType.simpleString()
    asked = [(q, np.array(sorted(terms), dtype=np.int32)) for q, terms in queries.items()]

    def shards(batches):
        held, docs, size = [], 0, 0
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                batch = whole.slice(lo, 4096)
                lo += 4096
                n = len(batch.column("terms").flatten())
                if held and (docs + batch.num_rows > SHARD_DOCS or size + n > SHARD_POSTINGS):
                    yield held
                    held, docs, size = [], 0, 0
                held.append(batch)
                docs, size = docs + batch.num_rows, size + n
        if held:
            yield held

    def run(batches):
        best: dict[int, list] = {}
        id_type = None
        for held in shards(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            id_type = table.schema.field("id").type
            terms = table.column("terms").combine_chunks()
            tfs = table.column("tfs").combine_chunks()
            shard = Shard(
                table.column("id").to_pylist(),
                table.column("n").to_numpy(),
                terms.offsets.to_numpy() - terms.offsets[0].as_py(),
                terms.flatten().to_numpy(),
                tfs.flatten().to_numpy(),
                weights,
                n_docs,
                length,
            )
            for q, query in asked:
                had = best.get(q, [])
                place, score = evaluate(shard, query, k, had[-1][0] if len(had) == k else 1)
                if len(place):
                    both = had + [(s, shard.ids[p]) for p, s in zip(place.tolist(), score.tolist())]
                    best[q] = sorted(both, key=lambda x: (-x[0], *id_order(x[1])))[:k]
        rows = [(q, i, s) for q, found in best.items() for s, i in found]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(i, id_type), pa.array(s, pa.int64())], ["q", "id", "score"]
            )

    return postings.mapInArrow(run, f"q long, id {kind}, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, best first."""
    import numpy as np

    asked = item_terms(items, item_col, item_text_col)
    n_blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    found = None
    for b in range(n_blocks):
        # bounded by the block: about block_terms short rows
        block = asked.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).select("q", "terms").collect()
        numbers: dict[bytes, int] = {}
        queries = {r.q: [numbers.setdefault(bytes(t), len(numbers)) for t in r.terms] for r in block if r.terms}
        postings = checkpoint_table(document_postings(docs, numbers, id_col, text_col), "postings")
        n_docs, length, df = corpus_counts(postings, len(numbers))
        weights = np.array([term_weight(n_docs, int(d)) for d in df], dtype=np.int64)
        hits = best_documents(postings, queries, weights, n_docs, max(length, 1), k)
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select(
        F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )


LEXICAL_SEARCH_SQL = r"""
WITH word AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), doc AS (
  SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM word WHERE len(terms) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM doc
), item AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT q, item_id, unnest(terms) AS term FROM item
), posting AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, corpus GROUP BY term, nd
), scored AS (
  SELECT q, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl))))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term), corpus
  GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
