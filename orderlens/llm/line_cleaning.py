"""Line-first cleaning: judge every line by punctuation, navigation and boilerplate rules,
remove the failing ones, then reject documents that lose too much of their text.

Only DataFrame expressions, row by row: no shuffle, no Python on the executors.  A document
is one row, so no group can grow.  Repeated word windows are found in the row as well: a
64-bit hash per five-word window, and only documents in which a hash recurs sort them.

Base counts (of the whole text; words are runs of characters other than blanks, ``\\t``,
``\\n``, ``\\v``, ``\\f`` and ``\\r``): n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words.  ``base_failed``: fewer than 10 words, or over 20 % of them in repeated
windows.

A line with words fails when

* punctuation: it has more than one mark (``MARKS``) for every two words;
* navigation: it has two or more separators (``SEPARATORS``), one for every four words at
  least; or it has at most three words, does not end like a sentence and stands in a run of
  three such lines or more (a heading stays; a line without words ends a run);
* boilerplate: it has at most 25 words and one of the phrases of ``BOILERPLATE``, which name what
  a page asks for ("accept cookies", "copyright 2020"), not words of prose ("cookie", "copyright").

``kept``: not ``base_failed``, and the removed lines hold at most half of the word
characters.

Defined results: a null text counts as a text without words (not kept); rows are judged one
by one, so repeated rows and null or repeated ids give a row each; an empty table gives an
empty result; extra columns are ignored, or kept by :func:`clean_documents`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.5
MARKS = r"[!#*$%&|<>=~^_{}\\]"
SEPARATORS = r"[|»›•·]"
SENTENCE_END = r"[.!?:;,…\"')\]»。！？][\x20\x09-\x0D]*$"
BOILERPLATE = (
    r"(?i)all rights reserved|privacy policy|terms of (use|service)"
    r"|(accept|allow|use|uses|using|these|our|all) cookies|cookie (policy|settings|notice|consent|preferences)"
    r"|copyright (©|\(c\)|[0-9]{4})|(©|\(c\)) ?[0-9]{4}|click here|read more"
    r"|subscribe (now|today|here|to (our|the|this|my) (newsletter|channel|feed|blog|updates|mailing list))"
    r"|(sign (in|up)|log ?in) (now|here|today|with|or|to (your|our|continue|view|comment))"
    r"|enable javascript|lorem ipsum|powered by"
)
SHORT_WORDS = 3
SHORT_RUN = 3
PHRASE_WORDS = 25


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


def word_characters(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, BLANK + "+", "")).cast("long")


def _in_run(i: Column) -> Column:
    """True if line ``i`` stands in a run of at least ``SHORT_RUN`` short lines (column _short)."""
    short = lambda k: F.coalesce(F.get("_short", i + k), F.lit(False))
    runs = [[k for k in range(first, first + SHORT_RUN) if k] for first in range(1 - SHORT_RUN, 1)]
    return short(0) & reduce(or_, [reduce(and_, [short(k) for k in run]) for run in runs])


def _line_fails(line: Column, i: Column) -> Column:
    """True for line ``i`` (words counted in _n) if it has words and breaks a rule."""
    words = F.get("_n", i)
    separators = _count(line, SEPARATORS)
    punctuation = 2 * _count(line, MARKS) > words
    navigation = _in_run(i) | ((separators >= 2) & (4 * separators >= words))
    boilerplate = (words <= PHRASE_WORDS) & line.rlike(BOILERPLATE)
    return (words > 0) & (punctuation | navigation | boilerplate)


def _with_line_counts(frame: DataFrame) -> DataFrame:
    """Add _lines, _n (words of each, counted once) and _short (few words, no end of a sentence)."""
    frame = frame.withColumn("_lines", F.split("text", "\n")).withColumn("_n", F.transform("_lines", lambda x: _count(x, WORD)))
    few = lambda i: F.get("_n", i).between(1, SHORT_WORDS)
    return frame.withColumn("_short", F.transform("_lines", lambda x, i: few(i) & ~x.rlike(SENTENCE_END)))


def _repeat_words(frame: DataFrame, words: str) -> DataFrame:
    """Add _repeat: words inside windows that occur twice or more in the row's array."""
    hashes = (
        f"CASE WHEN size({words}) >= {WINDOW} THEN transform(sequence(0, size({words}) - {WINDOW}), "
        f"i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(WINDOW))})) ELSE array() END"
    )
    order = (
        "CASE WHEN size(array_distinct(_hash)) < size(_hash) THEN "
        "array_sort(transform(_hash, (h, i) -> struct(h AS h, i AS i))) END"
    )
    repeated = (
        "sort_array(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h "
        "OR x.h = get(_sorted, k + 1).h), x -> x.i))"
    )
    covered = (
        "coalesce(aggregate(transform(_at, (p, k) -> "
        f"CAST(least({WINDOW}, coalesce(get(_at, k + 1) - p, {WINDOW})) AS BIGINT)), 0L, (a, b) -> a + b), 0L)"
    )
    return (
        frame.withColumn("_hash", F.expr(hashes))
        .withColumn("_sorted", F.expr(order))
        .withColumn("_at", F.expr(repeated))
        .withColumn("_repeat", F.expr(covered))
    )


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """One row per input row: (id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, clean_text).  ``carry`` adds the input row as the
    struct ``source``."""
    extra = [F.struct(*[docs[c] for c in docs.columns]).alias("source")] if carry else []
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    # Trimmed by characters: a pattern anchored at the end starts again at every blank of a run.
    frame = base.withColumn("_body", F.btrim("text", F.lit(BLANKS))).withColumn(
        "_words", F.expr(f"CASE WHEN _body = '' THEN CAST(array() AS array<string>) ELSE split(_body, r'{BLANK}+') END")
    )
    frame = _repeat_words(frame, "_words")
    frame = _with_line_counts(frame)
    frame = (
        frame.withColumn("_with_words", F.filter("_lines", lambda x, i: F.get("_n", i) > 0))
        .withColumn("clean_text", F.array_join(F.filter("_lines", lambda x, i: ~_line_fails(x, i)), "\n"))
        .withColumn("word_chars", word_characters(F.col("text")))
        .withColumn("_clean_chars", word_characters(F.col("clean_text")))
    )
    frame = frame.select(
        F.col("id").alias(id_col),
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("_with_words") - F.size(F.array_distinct("_with_words"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        "_clean_chars",
        "clean_text",
        # A row number keeps filters on the verdict above this projection: pushed below, they
        # would repeat the arrays' expressions once per element.
        F.monotonically_increasing_id().alias("_row"),
        *(["source"] if carry else []),
    )
    failed = (F.col("_row") >= 0) & ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    lost = F.col("word_chars") - F.col("_clean_chars")
    return (
        frame.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (lost <= MAX_LOSS * F.col("word_chars")))
        .drop("_clean_chars", "_row")
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed, in the input's columns; n_chars
    (where present) follows the text."""
    kept = clean_lines(docs, carry=True).filter("kept")
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("clean_text").alias(c))
        elif c == "n_chars":
            out.append(F.length("clean_text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("source").getField(c).alias(c))
    return kept.select(*out)


LINE_CLEANING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, unnest(range(0, len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
win2 AS (SELECT doc_id, i, words[i + 1 : i + 5] AS win FROM win),
dup AS (SELECT doc_id, i FROM win2 QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
gap AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS g FROM dup),
rep AS (SELECT doc_id, sum(g) AS n FROM gap GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM w),
f AS (SELECT doc_id, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             len(regexp_extract_all(line, '[!#*$%&|<>=~^_{}\\]')) AS marks,
             len(regexp_extract_all(line, '[|»›•·]')) AS seps FROM l),
s AS (SELECT *, n BETWEEN 1 AND 3 AND NOT regexp_matches(line, '[.!?:;,…"'')\]»。！？][\x20\x09-\x0D]*$') AS short FROM f),
r AS (SELECT *, coalesce(lag(short) OVER o, false) AS b1, coalesce(lag(short, 2) OVER o, false) AS b2,
             coalesce(lead(short) OVER o, false) AS a1, coalesce(lead(short, 2) OVER o, false) AS a2
      FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
j AS (SELECT *, n > 0 AND (2 * marks > n OR (seps >= 2 AND 4 * seps >= n)
        OR (short AND ((b1 AND b2) OR (b1 AND a1) OR (a1 AND a2)))
        OR (n <= 25 AND regexp_matches(line, '(?i)all rights reserved|privacy policy|terms of (use|service)|(accept|allow|use|uses|using|these|our|all) cookies|cookie (policy|settings|notice|consent|preferences)|copyright (©|\(c\)|[0-9]{4})|(©|\(c\)) ?[0-9]{4}|click here|read more|subscribe (now|today|here|to (our|the|this|my) (newsletter|channel|feed|blog|updates|mailing list))|(sign (in|up)|log ?in) (now|here|today|with|or|to (your|our|continue|view|comment))|enable javascript|lorem ipsum|powered by'))) AS fails FROM r),
c AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
             coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (fails), 0) AS lost
      FROM j GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(c.n_dup_lines AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, c.lost
      FROM w JOIN c USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5 * word_chars AS kept
FROM b
"""
