"""Near-duplicate lines by a segment-partition edit join, in DataFrame expressions only.

Two lines belong together when they are equal, or when both have at least ``min_chars``
characters and either at most ``max_edits`` edits between them or at most :func:`word_limit`
changed words (added, dropped or replaced), a limit that grows with the shorter line's number
of words; classes are the transitive closure.

* Equal lines fall together in one aggregation; all later steps see distinct lines.
* Every distinct line is cut into ``max_edits + 1`` even segments.  A pair within the limit
  agrees in one segment, up to a shift bounded by the segment's number and the difference
  of lengths (Pass-Join, Li et al. 2011).  Index rows carry a hash of (length, segment number,
  segment); probe rows the same for the substrings that can match segments of lines 0 to
  ``max_edits`` shorter.  Rows are two numbers, so the exchange is far smaller than the text.
* Keys with more than ``HOT_KEY`` rows (a prefix or phrase that many lines share) are split by a second
  segment: what is left of two linked lines without the shared substring is within the limit, so it
  shares a segment in turn.
* Lines of 2 * RUN + 1 words and more are also cut into words, of which one more than the limit are
  keys: the longest ones, in an order that all lines share.  A pair within the limit leaves at most
  the limit of either line's words unmatched, so it shares one of them -- at places, and distances
  from the end, that differ by the limit at most, where a line does not repeat the word: only such rows
  meet.  One edit touches two words at most, so lines of ``settled`` words and more need no segments
  of characters.  Hot keys are split by classes of lengths and by places, and a line probes its own
  class and the next lower one.
* Keys under which only one line stands are dropped behind their exchange.  Texts are
  fetched for the remaining lines alone.
* The tables between the steps are deleted, and the shuffle files of each step removed, as soon
  as the last step that reads them has ended.
* Inside a key a pair is first held against its character counts (an edit changes them by at
  most two) or its words' parities (a changed word flips two at most); pairs that pass are held
  against more parities, the more the wider the word limit is, before texts are fetched.  Lines of a hot segment are first compared with one of them, their head,
  lines with the same two longest words with several; lines that heads within the limit connect are
  not paired again.
* Survivors are verified by banded bit-parallel edit distance (Hyyrö 2003): the band of
  2 * limit + 1 diagonals is one integer, a step is a few bit operations.  Word pairs are compared
  with every word written as one character of 20 bits of its hash, without what both begin and end
  with.  As SQL has to look up each diagonal of a row, pairs with a limit of more than ``WIDEST``
  words go to Spark's own banded Levenshtein distance.

Defined results: a null text has no lines; only lines with a word count, compared without
blanks at their ends; rows equal in id and text are one document and get the same marks;
null ids sort first; an empty table gives an empty result; extra columns are ignored, or kept
by :func:`drop_repeated_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.components import connected_components
from orderlens.session import StepTables, checkpoint_table

MAX_EDITS = 2
MIN_CHARS = 20
MIN_WORDS = 3
# Unchanged words in a row that a pair within the word limit must share.
RUN = 9
# Rows from which a key is split: of a segment, and of a word.
HOT_KEY = 64
HOT_WORDS = 1024
# A word among a line's words is one positive long: 6 bits of length, the hash, the place.
WORD_BITS = 33
POSITION_BITS = 24
# Ratio of the lengths of neighbouring classes; more than any two lengths within the word limit.
STEP = 1.25
# Widest word limit that the bit-parallel distance verifies (30 would fit a long).
WIDEST = 4
# Widest word limit with 64 parities of words; beyond it there are four longs of them, or one for
# every eight words of the limit, as changed words that share a parity hide each other.
NARROW = 2
# Heads of a group that a line is compared with.
HEADS = 8
BROADCAST_ROWS = 1_000_000
BLANKS = " \t\x0b\x0c\r"
# Characters whose counts are compared before an edit distance is computed.
COUNTED = "etaoinsrhdlucmfpgwybvkxjqz .,0123456789"


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, line_no, line, h1, h2): lines with a word; th tells texts of one id apart,
    (h1, h2) is the line's 128-bit identity."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = source.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return (
        lines.select("id", "th", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line"))
        .filter("line <> ''")
        .withColumn("h1", F.xxhash64("line"))
        .withColumn("h2", F.xxhash64(F.lit("second identity"), "line"))
    )


def _segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """SQL for the start (from 0) and size of segment ``i`` (from 1) of ``parts``."""
    base, extra = f"({length} div {parts})", f"({length} % {parts})"
    return (
        f"({i - 1} * {base} + greatest(0, {i - 1} - ({parts} - {extra})))",
        f"({base} + CASE WHEN {i} > {parts} - {extra} THEN 1 ELSE 0 END)",
    )


def key_rows(distinct: DataFrame, max_edits: int, within: str = "") -> DataFrame:
    """(key, probe, h1, spot): index and probe rows of distinct lines (h1, line, n); spot holds the
    start of the substring (upper half) and its size.  ``within``: a column that keys are made
    part of; such lines are the rests of lines that share the key ``within``, and a row of a
    probing rest (column probe) is a probe."""
    parts, rows = max_edits + 1, []
    before = f"{within}, " if within else ""
    for less in range(max_edits + 1):
        length = f"n{less}"
        for i in range(1, parts + 1):
            start, size = _segment(length, i, parts)
            low = max(-(i - 1), less - (parts - i))
            high = min(i - 1, less + (parts - i))
            for shift in range(low, high + 1):
                # the aligned substring of the line's own length is its index row
                probe = "true" if less or shift else "probe" if within else "false"
                text = f"substring(line, CAST({start} + {shift + 1} AS INT), CAST({size} AS INT))"
                spot = f"shiftleft(CAST({start} + {shift} AS BIGINT), 32) + CAST({size} AS BIGINT)"
                key = f"xxhash64({before}CAST({length} AS INT), {i}, {text})"
                rows.append(f"struct({key} AS key, {probe} AS probe, {spot} AS spot)")
    lengths = [f"n - {less} AS n{less}" for less in range(max_edits + 1)]
    kept = [within, "probe"] if within else []
    cut = distinct.selectExpr("h1", "line", *kept, *lengths)
    return cut.selectExpr("h1", f"inline(array({', '.join(rows)}))").select("key", "probe", "h1", "spot")


def _met(rows: DataFrame) -> DataFrame:
    """The rows of keys under which an index row and another row stand, with their number."""
    from pyspark.sql import Window

    by_key = Window.partitionBy("key")
    counted = rows.withColumn("rows", F.count(F.lit(1)).over(by_key)).withColumn(
        "indexed", F.count(F.when(~F.col("probe"), 1)).over(by_key)
    )
    return counted.filter("rows > 1 AND indexed > 0").drop("indexed")


def split_hot_keys(shared: DataFrame, lines: DataFrame, max_edits: int, hot_key: int, steps: StepTables) -> DataFrame:
    """``shared`` with the rows of keys with more than ``hot_key`` rows dealt to keys of a second segment.

    Of a pair that meets under a key and is within the limit, what stands before and behind the
    shared substrings is within the limit, too, so these rests share a segment in turn."""
    hot = shared.filter(F.col("rows") > hot_key)
    if hot.isEmpty():
        return shared.drop("spot")
    wanted = steps.store(hot.select("h1").distinct(), "line-ids")
    texts = lines.select("h1", "line").join(_bounded(wanted), "h1", "left_semi")
    rest = "concat(substring(line, 1, CAST(shiftright(spot, 32) AS INT)), substring(line, CAST(shiftright(spot, 32) + (spot & 4294967295L) + 1 AS INT)))"
    rests = hot.join(texts, "h1").selectExpr("h1", "key AS outer", "probe", f"{rest} AS line").withColumn("n", F.length("line"))
    split = _met(key_rows(rests, max_edits, "outer"))
    return shared.filter(F.col("rows") <= hot_key).unionByName(split).drop("spot")


def words_of(line: str) -> Column:
    """The words of a line: split at blanks, and behind every character from U+2E80 on, as
    scripts written without blanks begin there."""
    wide = F.regexp_replace(line, r"([\x{2E80}-\x{10FFFF}])", "$1 ")
    return F.split(F.when(F.octet_length(line) == F.length(line), F.col(line)).otherwise(wide), " ")


def word_limit(words: str) -> str:
    """SQL for the number of changed words allowed in a line of ``words`` words."""
    return f"greatest(0, ({words} - {RUN}) div {RUN + 1})"


def settled(max_edits: int) -> int:
    """Words from which on a pair within ``max_edits`` edits must share one of the words of :func:`word_key_rows`."""
    return RUN * (max_edits + 1) + 2 * max_edits


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_ranked_words(lines: DataFrame, max_edits: int) -> DataFrame:
    """``lines`` with m, g, s0, where they have 2 * RUN + 1 words and more (else NULL): the number of
    words, the longest ones, and 64 parities of the numbers of words by hash; s holds more parities of
    the same kind where the word limit is beyond ``NARROW``, a power of two of longs.

    Words are ordered by length, then hash, the same way in every line; an element of g holds
    length, hash and place.  There are two more than the limit (at least four), as many as keys
    and one to tell whether the last key is repeated."""
    low = (1 << POSITION_BITS) - 1
    rank = (
        f"shiftleft(CAST(63 - least(length(w), 63) AS BIGINT), {WORD_BITS + POSITION_BITS}) "
        f"| shiftleft(xxhash64(w) & {(1 << WORD_BITS) - 1}L, {POSITION_BITS})"
    )
    ranked = f"sort_array(transform(words, (w, i) -> ({rank}) | least(CAST(i AS BIGINT), {low}L)))"
    sketch = f"aggregate(g, 0L, (s, x) -> s ^ shiftleft(1L, CAST(shiftright(x, {POSITION_BITS}) & 63 AS INT)))"
    wider = f"CAST(greatest(4, pow(2, ceil(log2({word_limit('m')} / 8)))) AS INT)"
    # bits in order, so that one pass fills part after part
    bits = f"sort_array(transform(g, x -> shiftright(x, {POSITION_BITS}) & (64L * parts - 1)))"
    step = (
        "CASE WHEN shiftright(x, 6) = p.part THEN struct(p.done AS done, p.part AS part, p.now ^ shiftleft(1L, CAST(x & 63 AS INT)) AS now) "
        "ELSE struct(concat(p.done, array(p.now), array_repeat(0L, CAST(shiftright(x, 6) - p.part - 1 AS INT))) AS done, "
        "shiftright(x, 6) AS part, shiftleft(1L, CAST(x & 63 AS INT)) AS now) END"
    )
    ended = "concat(p.done, array(p.now), array_repeat(0L, CAST(parts - p.part - 1 AS INT)))"
    filled = f"aggregate({bits}, struct(CAST(array() AS array<bigint>) AS done, 0L AS part, 0L AS now), (p, x) -> {step}, p -> {ended})"
    wide = f"CASE WHEN g IS NOT NULL AND {word_limit('m')} > {NARROW} THEN {_let(wider, 'parts', filled)} END"
    words = lines.withColumn("words", words_of("line"))
    ranked_lines = words.selectExpr(*lines.columns, "size(words) AS m", f"CASE WHEN size(words) >= {2 * RUN + 1} THEN {ranked} END AS g")
    return ranked_lines.selectExpr(*lines.columns, "m", f"slice(g, 1, CAST(greatest(4, {_taken(max_edits)} + 1) AS INT)) AS g", f"{sketch} AS s0", f"{wide} AS s")


def _taken(max_edits: int) -> str:
    """SQL for the number of a line's words that are keys: one more than its limit.  Two edits of
    characters change four words; lines that segments do not cover take that many."""
    return (
        f"(1 + CASE WHEN m >= {settled(max_edits) - 2 * max_edits} THEN greatest({2 * max_edits}, {word_limit('m')}) "
        f"ELSE {word_limit('m')} END)"
    )


def word_key_rows(ranked: DataFrame, max_edits: int, *kept: str) -> DataFrame:
    """(key, h1, m, pos, s0, kept): one more than the word limit of each line's words, the longest first.

    A pair within the limit leaves at most that many words of either line unmatched, so the first
    matched word in the common order stands among the first limit + 1 of both: threshold-plus-one
    pieces, of which one is shared.  Long words are rare ones.  ``pos`` is the word's place, -1 if the
    line repeats it: places of a matched word differ by the limit at most."""
    low = (1 << POSITION_BITS) - 1
    word, same = f"shiftright(x, {POSITION_BITS})", f"shiftright(get(g, i {{}} 1), {POSITION_BITS})"
    repeated = f"coalesce({word} = {same.format('-')}, false) OR coalesce({word} = {same.format('+')}, false)"
    rows = f"transform(g, (x, i) -> struct({word} AS key, CASE WHEN {repeated} THEN -1 ELSE CAST(x & {low}L AS INT) END AS pos))"
    out = ranked.filter("g IS NOT NULL").selectExpr(
        "h1", "m", "s0", *kept, f"inline(array_distinct(slice({rows}, 1, CAST({_taken(max_edits)} AS INT))))"
    )
    return out.select("key", "h1", "m", "pos", "s0", *kept)


def _alike(x: str, y: str, max_edits: int) -> str:
    """SQL for 'lengths and parities allow a link': a changed word flips two parities at most, an edit
    of a character three, as it joins or parts two words at most."""
    limit, flips, longer = word_limit(f"least({x}.m, {y}.m)"), f"bit_count({x}.s0 ^ {y}.s0)", f"abs({x}.m - {y}.m)"
    return f"({longer} <= {limit} AND {flips} <= 2 * {limit} OR {longer} <= {max_edits} AND {flips} <= {3 * max_edits})"


def _few_flips(x: str, y: str, max_edits: int) -> str:
    """SQL for 'the parities s allow a link'; their limits are such that two edits count as changed words."""

    def folded(s: str, other: str) -> str:
        """SQL for s with as many parities as the other one, if that has half as many."""
        half = f"size({s}) div 2"
        return f"CASE WHEN size({s}) > size({other}) THEN zip_with(slice({s}, 1, {half}), slice({s}, {half} + 1, {half}), (p, q) -> p ^ q) ELSE {s} END"

    # lengths within the limit are less than a factor of two apart
    flips = f"aggregate(zip_with({folded(f'{x}.s', f'{y}.s')}, {folded(f'{y}.s', f'{x}.s')}, (p, q) -> bit_count(p ^ q)), 0, (n, k) -> n + k)"
    return f"{flips} <= greatest({3 * max_edits}, 2 * {word_limit(f'least({x}.m, {y}.m)')})"


def _like_pairs(lines: DataFrame, pairs: DataFrame, max_edits: int, steps: StepTables) -> DataFrame:
    """The stored pairs (a, b) of h1 without those that the parities s tell apart.  They are too wide for
    the rows of keys, and far smaller than the texts."""
    wanted = steps.store(pairs.selectExpr("explode(array(a, b)) AS h1").distinct(), "line-ids")
    found = lines.filter("s IS NOT NULL").select("h1", "m", "s").join(_bounded(wanted), "h1", "left_semi")
    sides = [found.select(F.col("h1").alias(c), F.struct("m", "s").alias(x)) for c, x in (("a", "x"), ("b", "y"))]
    both = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
    return steps.store(both.filter(f"x IS NULL OR y IS NULL OR {_few_flips('x', 'y', max_edits)}").select("a", "b"), "like-pairs")


def leading_lines(ranked: DataFrame, max_edits: int, steps: StepTables) -> tuple[DataFrame, DataFrame]:
    """(checked pairs, (h1, led)): most copies of a line share its two longest words, or the next two.
    Under these each line is compared with ``HEADS`` heads, the least of as many parts.  ``led`` names
    what lines and heads within the limit connect."""
    word = f"shiftright(g[{{}}], {POSITION_BITS})"
    pair = [f"xxhash64({word.format(k)}, {word.format(k + 1)}, {k})" for k in (0, 2)]
    rows = ranked.filter("g IS NOT NULL").selectExpr("h1", "m", "s0", f"explode(array({', '.join(pair)})) AS key")
    rows = rows.select("key", F.struct("h1", "m", "s0").alias("x"))
    heads = rows.groupBy("key", F.expr(f"pmod(x.h1, {HEADS})").alias("part")).agg(F.expr("min_by(x, x.h1)").alias("y"))
    met = rows.join(heads, "key").filter(f"x.h1 <> y.h1 AND {_alike('x', 'y', max_edits)}")
    near = _checked(ranked, met.selectExpr("least(x.h1, y.h1) AS a", "greatest(x.h1, y.h1) AS b"), max_edits, steps)
    groups = connected_components(near.select("a", "b"))
    return near, steps.store(groups.selectExpr("node AS h1", "root AS led"), "led-lines")


def banded_distance_within(a: str, b: str, t: str) -> str:
    """SQL for 'at most t edits between the arrays a and b, a not shorter', for a t that varies by
    row, at most ``WIDEST``: the recurrence of :func:`edit_distance_within`, its band of 2 t + 1
    diagonals in one long."""
    top, mask = f"shiftleft(1L, 2 * {t})", f"(shiftleft(1L, 2 * {t} + 1) - 1L)"
    match = (
        f"aggregate(sequence(0, 2 * {t}), 0L, "
        f"(m, k) -> m | CASE WHEN get({a}, i - {t} + k) = c THEN shiftleft(1L, k) ELSE 0L END)"
    )
    steps = f"transform({b}, (c, i) -> struct({match} AS x, i AS i))"
    d0 = f"((((s.x & p.vp) + p.vp) ^ p.vp | s.x | p.vn) & {mask})"
    hp, hn, half = f"((p.vn | ~(d | p.vp)) & {mask})", "(d & p.vp)", "shiftright(d, 1)"
    row = f"shiftright({top}, 1 + s.i - (size({a}) - {t}))"
    move = (
        f"CASE WHEN s.i < size({a}) - {t} THEN CASE WHEN (d & {top}) = 0 THEN 1 ELSE 0 END "
        f"ELSE CASE WHEN ({hp} & {row}) <> 0 THEN 1 ELSE 0 END - CASE WHEN ({hn} & {row}) <> 0 THEN 1 ELSE 0 END END"
    )
    after = f"struct(({hn} | (~({half} | {hp}) & {mask})) AS vp, ({half} & {hp}) AS vn, p.dist + {move} AS dist)"
    start = f"struct(({mask} & ~(shiftleft(1L, {t}) - 1L)) AS vp, 0L AS vn, least({t}, size({a})) AS dist)"
    return (
        f"(size({a}) - size({b}) <= {t} AND aggregate({steps}, {start}, (p, s) -> {_let(d0, 'd', after)}, p -> p.dist) <= {t})"
    )


def unlike_middles(pairs: DataFrame, v: str, w: str) -> DataFrame:
    """``pairs`` with the arrays v and w cut by what both begin and end with: columns _long, _short."""

    def shared(x: str, y: str) -> str:
        """SQL for the number of equal elements that x and y begin with."""
        return f"coalesce(nullif(array_position(zip_with({x}, {y}, (p, q) -> p <=> q), false), 0) - 1, size({x}))"

    kept = [c for c in pairs.columns if c not in (v, w)]
    cut = pairs.selectExpr(*kept, v, w, f"CAST({shared(v, w)} AS INT) AS _head")
    # ids keep the projections apart, so that each is computed once per row
    cut = cut.withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0")
    cut = cut.selectExpr(*kept, *(f"slice({x}, _head + 1, size({x})) AS {x}" for x in (v, w)))
    cut = cut.selectExpr("*", f"CAST({shared(f'reverse({v})', f'reverse({w})')} AS INT) AS _tail")
    cut = cut.withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0")
    ends = [f"slice({x}, 1, size({x}) - _tail) AS {x}" for x in (v, w)]
    return cut.selectExpr(*kept, *ends).selectExpr(
        *kept,
        f"CASE WHEN size({v}) >= size({w}) THEN {v} ELSE {w} END AS _long",
        f"CASE WHEN size({v}) >= size({w}) THEN {w} ELSE {v} END AS _short",
        "monotonically_increasing_id() AS _row",
    )


def edit_distance_within(a: str, b: str, max_edits: int) -> str:
    """SQL for 'at most max_edits edits between the array columns a and b of characters, a not
    shorter', by the banded bit-parallel recurrence.

    Bit k of step i stands for row i - max_edits + k of the distance matrix.  ``dist`` follows
    the band's lower diagonal to the last row of a, then that row.
    """
    t, w = max_edits, 2 * max_edits + 1
    mask, top = (1 << w) - 1, 1 << (w - 1)
    match = " | ".join(
        f"(CASE WHEN get({a}, i - {t} + {k}) = c THEN {1 << k}L ELSE 0L END)" for k in range(w)
    )
    steps = f"transform({b}, (c, i) -> struct({match} AS x, i AS i))"
    d0 = "(((((s.x & p.vp) + p.vp) ^ p.vp) | s.x | p.vn) & {m}L)".format(m=mask)
    hp = f"((p.vn | ~({d0} | p.vp)) & {mask}L)"
    hn = f"({d0} & p.vp)"
    half = f"shiftright({d0}, 1)"
    row = f"shiftright({top}L, CAST(1 + s.i - (size({a}) - {t}) AS INT))"
    move = (
        f"CASE WHEN s.i < size({a}) - {t} THEN CASE WHEN ({d0} & {top}L) = 0 THEN 1 ELSE 0 END "
        f"ELSE CASE WHEN ({hp} & {row}) <> 0 THEN 1 ELSE 0 END - CASE WHEN ({hn} & {row}) <> 0 THEN 1 ELSE 0 END END"
    )
    start = sum(1 << k for k in range(t, w))
    return (
        f"(size({a}) - size({b}) <= {t} AND aggregate({steps}, "
        f"struct({start}L AS vp, 0L AS vn, {t} AS dist), (p, s) -> struct("
        f"({hn} | (~({half} | {hp}) & {mask}L)) AS vp, ({half} & {hp}) AS vn, p.dist + {move} AS dist), "
        f"p -> p.dist) <= {t})"
    )


def verified(pairs: DataFrame, a: str, b: str, max_edits: int) -> DataFrame:
    """The rows whose strings a and b are at most ``max_edits`` edits apart."""
    longer = f"length({a}) >= length({b})"
    chars = pairs.select(
        *pairs.columns,
        F.expr(f"split(CASE WHEN {longer} THEN {a} ELSE {b} END, '')").alias("_long"),
        F.expr(f"split(CASE WHEN {longer} THEN {b} ELSE {a} END, '')").alias("_short"),
        # keeps the filter above this projection, so a string is split once, not once per step
        F.monotonically_increasing_id().alias("_row"),
    )
    near = F.expr(edit_distance_within("_long", "_short", max_edits))
    return chars.filter((F.col("_row") >= 0) & near).select(*pairs.columns)


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint for a stored table of at most BROADCAST_ROWS narrow rows; beyond that
    the table as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(lines: DataFrame, pairs: DataFrame, steps: StepTables) -> DataFrame:
    """(h1, h2, line, n, m, coded), stored: the lines whose h1 is in the stored pairs (a, b), their
    numbers of characters and words, and the words as characters of 20 bits of their hash."""
    wanted = steps.store(pairs.selectExpr("explode(array(a, b)) AS h1").distinct(), "line-ids")
    found = lines.select("h1", "h2", "line").join(_bounded(wanted), "h1", "left_semi")
    code = "decode(unhex(lpad(hex((xxhash64(w) & 1048575) + 65536), 8, '0')), 'UTF-32')"
    written = f"array_join(transform(words, w -> {code}), '') AS coded"
    coded = found.withColumn("words", words_of("line")).selectExpr("h1", "h2", "line", "length(line) AS n", "size(words) AS m", written)
    return steps.store(coded, "line-texts")


def _checked(lines: DataFrame, pairs: DataFrame, max_edits: int, steps: StepTables, *used: DataFrame) -> DataFrame:
    """(a, b, ida, idb), stored: the pairs (a, b) of h1 whose lines are within either limit.  The
    tables ``used`` are read for the pairs alone and dropped then."""
    with StepTables() as own:
        pairs = own.store(pairs.distinct(), "line-pairs")
        steps.drop(*used)
        pairs = _like_pairs(lines, pairs, max_edits, own)
        texts = _texts(lines, pairs, own)
        sides = [
            texts.select(F.col("h1").alias(x), F.struct("h1", "h2").alias(f"id{x}"), *[F.col(c).alias(c + x) for c in ("n", "m", "coded")])
            for x in "ab"
        ]
        both = pairs.join(sides[0], "a").join(sides[1], "b").withColumn("t", F.expr(f"CAST({word_limit('least(ma, mb)')} AS INT)"))
        ids = ["a", "b", "ida", "idb"]
        wide = "(abs(ma - mb) <= t AND levenshtein(codeda, codedb, t) >= 0)"
        # beyond WIDEST, two edits of characters are within the word limit, too
        arrays = [f"CASE WHEN t <= {WIDEST} THEN split(coded{x}, '') END AS {v}" for x, v in zip("ab", "vw")]
        coded = both.selectExpr(*ids, "na", "nb", "t", f"CASE WHEN t > {WIDEST} THEN {wide} END AS wide", *arrays)
        middles = unlike_middles(coded.filter("coalesce(wide, true)"), "v", "w")
        banded = banded_distance_within("_long", "_short", "t")
        checks = own.store(
            middles.selectExpr(*ids, "na", "nb", "_row", f"CASE WHEN wide THEN true ELSE {banded} END AS near"), "word-checks"
        )
        few = checks.filter(f"NOT near AND abs(na - nb) <= {max_edits}").select(*ids)
        for x in "ab":
            few = few.join(texts.select(F.col("h1").alias(x), F.col("line").alias(f"line{x}")), x)
        few = verified(few, "linea", "lineb", max_edits).select(*ids)
        found = checks.filter("near").select(*ids)
        return steps.store(found.unionByName(few), "near-lines")


def reworded_lines(ranked: DataFrame, max_edits: int, hot_key: int, steps: StepTables) -> DataFrame:
    """Edges (a, b) between identities of the stored lines (see :func:`with_ranked_words`) that share one
    of their longest words and are within the word limit or ``max_edits`` edits, enough to connect
    every such pair."""
    from pyspark.sql import Window

    near_head, groups = leading_lines(ranked, max_edits, steps)
    led = ranked.select("h1", "m", "g", "s0").join(_bounded(groups), "h1", "left")
    counted = word_key_rows(led, max_edits, "led").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("key")))
    shared = steps.store(counted.filter("rows > 1"), "word-keys")
    apart = "NOT coalesce(x.led = y.led, false)"  # else heads connect them already
    limit = f"greatest({2 * max_edits}, {word_limit('least(x.m, y.m)')})"
    shift = "CASE WHEN x.pos < 0 OR y.pos < 0 THEN 0 ELSE x.pos - y.pos END"
    close = f"x.h1 <> y.h1 AND {apart} AND {_alike('x', 'y', max_edits)} AND abs({shift}) + abs((x.m - y.m) - ({shift})) <= {limit}"

    few = shared.filter(F.col("rows") <= hot_key).drop("rows")
    pairs = few.alias("x").join(few.alias("y"), F.expr(f"x.key = y.key AND x.h1 < y.h1 AND {close}"))
    # Classes of lengths: of a pair within the limit one line is in the other's class or the next.
    # A hot key's parts, by class c: r = 0 words that stand once, by cells of places as wide as the
    # largest limit in the class; r = 1 repeated words, whose places say nothing; r = 2 once more
    # those that stand once, for repeated ones to meet.
    hot = shared.filter(F.col("rows") > hot_key).drop("rows").withColumn("cls", F.expr(f"CAST(floor(ln(m) / ln({STEP}D)) AS INT)"))

    def cell(c: str, step: int) -> str:
        width = f"greatest({2 * max_edits}, {word_limit(f'CAST(ceil(pow({STEP}D, {c} + 1)) AS INT)')})"
        return f"struct({c} AS c, pos div {width} + {step} AS p, 0 AS r)"

    def either(c: str, r: int) -> str:
        return f"struct({c} AS c, 0L AS p, {r} AS r)"

    def parts(once: list[str], repeated: list[str]) -> DataFrame:
        return hot.selectExpr("*", f"explode(CASE WHEN pos < 0 THEN array({', '.join(repeated)}) ELSE array({', '.join(once)}) END) AS part")

    probed = ("cls", "(cls - 1)")
    homes = parts([cell("cls", 0), either("cls", 2)], [either("cls", 1)])
    guests = parts(
        [cell(c, step) for c in probed for step in (-1, 0, 1)] + [either(c, 1) for c in probed],
        [either(c, r) for c in probed for r in (1, 2)],
    )
    more = guests.alias("x").join(
        homes.alias("y"),
        F.expr(f"x.key = y.key AND x.part = y.part AND (x.cls > y.cls OR x.cls = y.cls AND x.h1 < y.h1) AND {close}"),
    )
    met = pairs.selectExpr("x.h1 AS a", "y.h1 AS b").unionByName(
        more.selectExpr("least(x.h1, y.h1) AS a", "greatest(x.h1, y.h1) AS b")
    )
    near = _checked(ranked, met, max_edits, steps, shared, groups)
    return near.unionByName(near_head).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def similar_lines(
    lines: DataFrame,
    steps: StepTables,
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    hot_key: int = HOT_KEY,
    changed_words: bool = True,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """Edges (a, b) between identities (structs of h1, h2) of lines within the limits, enough
    of them to connect every such pair; without ``changed_words`` max_edits alone counts.  They read
    the tables of ``steps``."""
    if min_chars < 2 * (max_edits + 1):
        raise ValueError("min_chars must be at least twice the number of segments")
    distinct = lines.filter(F.length("line") >= min_chars).select("h1", "h2", "line").distinct().withColumn("n", F.length("line"))
    distinct = steps.store(with_ranked_words(distinct, max_edits) if changed_words else distinct, "lines")
    reworded, all_lines = None, distinct
    if changed_words:
        reworded = reworded_lines(distinct, max_edits, hot_words, steps)
        distinct = distinct.filter(F.col("m") < settled(max_edits))
    met = steps.store(_met(key_rows(distinct, max_edits)), "line-keys")
    shared = steps.store(split_hot_keys(met, all_lines, max_edits, hot_key, steps), "split-keys")
    steps.drop(met)
    wanted = steps.store(shared.select("h1").distinct(), "line-ids")
    counts = [f"length(line) - length(replace(line, '{c}', ''))" for c in COUNTED]
    texts = steps.store(
        all_lines.join(_bounded(wanted), "h1", "left_semi").selectExpr("h1", "h2", "line", "length(line) AS n", f"array({', '.join(counts)}) AS counts"),
        "line-texts",
    )
    steps.drop(all_lines)
    rows = shared.join(texts, "h1").select("key", "probe", F.struct("h1", "h2").alias("id"), "line", "n", "counts", "rows")
    hot = rows.filter(F.col("rows") > hot_key)
    heads = hot.groupBy("key").agg(F.min_by(F.struct("id", "line"), "id").alias("head"))
    led = hot.join(heads, "key").select("key", "probe", "id", F.col("head.id").alias("head"), "line", F.col("head.line").alias("first"))
    near_head = steps.store(
        verified(led.filter("id <> head"), "line", "first", max_edits).select("key", "probe", "id", "head"), "hot-lines"
    )
    marks = near_head.select("key", "probe", "id").distinct().withColumn("led", F.lit(True))
    rows = rows.join(marks, ["key", "probe", "id"], "left").withColumn("led", F.coalesce("led", F.lit(False)))
    x, y = rows.filter("NOT probe").alias("x"), rows.alias("y")
    apart = " + ".join(f"abs(x.counts[{k}] - y.counts[{k}])" for k in range(len(COUNTED)))
    pairs = x.join(
        y,
        F.expr(
            "x.key = y.key AND x.id <> y.id AND (y.probe OR x.id < y.id) AND NOT (x.led AND y.led) "
            f"AND abs(x.n - y.n) <= {max_edits} AND {apart} <= {2 * max_edits}"
        ),
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.line").alias("p"), F.col("y.line").alias("q"))
    linked = verified(pairs.dropDuplicates(["a", "b"]), "p", "q", max_edits).select("a", "b")
    linked = linked.unionByName(near_head.select(F.col("id").alias("a"), F.col("head").alias("b")))
    return (linked if reworded is None else linked.unionByName(reworded)).distinct()


def line_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    hot_key: int = HOT_KEY,
    changed_words: bool = True,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """One row per line with a word: (id, th, line_no, n_words, class_doc_id, class_line_no,
    n_copies, first); the class is named by its first line in order of id, text hash, line."""
    lines = document_lines(docs, id_col, text_col)
    with StepTables() as steps:
        edges = similar_lines(lines, steps, max_edits, min_chars, hot_key, changed_words, hot_words)
        roots = checkpoint_table(connected_components(edges), "line-roots")
    names = roots.select("node.h1", "node.h2", F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2"))
    classed = (
        lines.select(
            "id", "th", "line_no", F.size(F.split("line", r"[\x20\x09-\x0D]+")).alias("n_words"), "h1", "h2"
        )
        .join(_bounded(names), ["h1", "h2"], "left")
        .select(
            "id", "th", "line_no", "n_words", F.coalesce("r1", "h1").alias("c1"), F.coalesce("r2", "h2").alias("c2")
        )
    )
    firsts = (
        classed.groupBy("c1", "c2")
        .agg(F.min(F.struct("id", "th", "line_no")).alias("head"), F.count(F.lit(1)).alias("n_copies"))
        .filter("n_copies > 1")
    )
    out = classed.join(firsts, ["c1", "c2"], "left")
    here = F.struct("id", "th", "line_no")
    return out.select(
        F.col("id").alias(id_col),
        "th",
        "line_no",
        "n_words",
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_doc_id"),
        F.coalesce("head.line_no", "line_no").alias("class_line_no"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("head").isNull() | here.eqNullSafe(F.col("head"))).alias("first"),
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """All documents, in the input's columns, without the lines of ``min_words`` words or more
    that repeat an earlier line of the corpus; n_chars (where present) follows the text."""
    marked = line_classes(docs, **options).filter(~F.col("first") & (F.col("n_words") >= min_words))
    drops = checkpoint_table(
        marked.groupBy(F.col("doc_id").alias("__line_id"), F.col("th").alias("__line_th")).agg(
            F.collect_set("line_no").alias("__line_drop")
        ),
        "line-drops",
    )
    size = drops.agg(F.sum(F.size("__line_drop"))).first()[0] or 0
    side = F.broadcast(drops) if size <= BROADCAST_ROWS else drops
    joined = docs.join(side, docs.doc_id.eqNullSafe(F.col("__line_id")) & (F.xxhash64(docs.text) == F.col("__line_th")), "left")
    joined = joined.withColumn("__line_lines", F.when(F.col("__line_drop").isNotNull(), F.split("text", "\n")))
    text = F.expr(
        "CASE WHEN __line_drop IS NULL THEN text ELSE array_join(transform("
        "array_except(sequence(0, size(__line_lines) - 1), __line_drop), i -> get(__line_lines, i)), '\n') END"
    )
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("__line_drop").isNull(), docs[c]).otherwise(F.length(text).cast(kind)).alias(c))
        else:
            out.append(docs[c])
    return joined.select(*out)
