"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read, shuffles_removed_after_use
from pricegrid.session import materialise, written

#: hashed cells of the rarity table, one byte each; its size does not depend on the data
CELL_BITS = 20
#: lines link when DOWN * intersection >= UP * union of their words
UP, DOWN = 4, 5


#: lines up to this number are broadcast (id and number each) to pick out those whose sets are compared
MOST_LINES = 1_000_000

#: leaders of the classes of like size in a long list, and the fewest classes that get one
LEADERS, LEAST_LED = 4, 4
#: rarity from which a token's list is taken for long: 32 occurrences in its cell
HOT_RANK = 20
#: long lists in which a class looks for leaders: those of its rarest hot tokens
LED_BY = 8
#: tokens from which a set has 128 parity bits instead of 64
WIDE_FROM = 80
#: bit of an index entry that is shut, above the place of the token
SHUT = 1 << 31


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(
        F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("line_no", "line"))


def _pieces(text: Column) -> Column:
    """The words of a text without line feeds, with empty strings where white space meets white space. Splits at one
    character need no regular expression. Replacing is dear: it is for texts that hold such a character."""
    plain, odd = text, F.lit(False)
    for space in "\t\x0b\x0c\r":
        plain, odd = F.replace(plain, F.lit(space), F.lit(" ")), odd | F.contains(text, F.lit(space))
    return F.split(F.when(odd, plain).otherwise(text), " ")


def _with_words(lines: DataFrame) -> DataFrame:
    """Lines with a word. The condition is on the text, so that no token is computed for it."""
    return lines.where(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")


def _parity(tokens: Column) -> Column:
    """64 bits, each the parity of the number of tokens that fall on it."""
    one, last = F.lit(1).cast("long"), F.lit(63).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(
        F.call_function("shiftleft", one, t.bitwiseAND(last).cast("int"))))


def _half_parity(tokens: Column) -> Column:
    """The parity bits of about half of the tokens; with those of all tokens they make 128 bits."""
    return _parity(F.filter(tokens, lambda t: t.bitwiseAND(F.lit(64).cast("long")) != 0))


def _cell(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - CELL_BITS).cast("int")


def _rarity(docs: DataFrame, text: str) -> bytes:
    """For each cell the rarity of its words: 0 for a word that occurs once, then four steps for each doubling of the
    count of all. It never ranks a word rarer than it is. The driver gets one number for eight cells."""
    bodies = docs.select(F.array_join(F.split(F.lower(F.col(text)), "\n"), " ").alias("body"))
    words = bodies.select(F.explode(_pieces(F.col("body"))).alias("word")).where("word <> ''")
    cells = words.groupBy(_cell(F.xxhash64("word")).alias("cell")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rank = F.least(F.ceil(4 * F.log2(F.col("c").cast("double"))), F.lit(127))
    eights = cells.withColumn("rank", rank.cast("long")).groupBy(F.shiftright("cell", 3).alias("eight")).agg(
        F.sum(F.expr("shiftleft(rank, 8 * (cell & 7))")).alias("ranks"))
    ranks = bytearray(1 << CELL_BITS)
    for row in eights.collect():
        ranks[8 * row["eight"]:8 * row["eight"] + 8] = row["ranks"].to_bytes(8, "little")
    return bytes(ranks)


def _overlap(a: Column, b: Column) -> Column:
    """Smallest intersection of linked sets of these sizes, as a ceiling in whole numbers."""
    return F.floor(((a + b) * UP + (UP + DOWN - 1)) / F.lit(UP + DOWN)).cast("int")


def line_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: ``doc_id, line_no`` (from 0), ``n_tokens`` and ``kept``.

    Lines are the text between line feeds; a line's tokens are its distinct lower-cased words. A line is removed when
    an earlier line, by (doc_id, line_no) and whether it stays itself or not, has a Jaccard similarity of UP / DOWN or
    more with it. Null and empty texts have no lines. Null ids come first in the order. Rows that share an id, or have
    none, count as one document: lines with the same number in it are judged together and do not remove each other.
    An empty table gives no rows; other columns are not looked at. Words are compared by 64-bit hashes.

    1. Every token is counted; a table of fixed size keeps the rarity by hashed cell. Any order gives the same
       result; the rarer the first tokens, the shorter the lists.
    2. Lines with equal sets form a class, known by its first line; all its others are removed at once, so copies
       of a line take part in the join once.
    3. Classes that share one of their rarest tokens (prefix filter), whose sizes allow the threshold (length filter)
       and whose places of the token leave enough of both (positional filter) are candidates, unless 64 parity bits (128 of
       long sets) differ in more places than linked sets have tokens apart (no true pair is lost to that). Tokens that occur once
       are not indexed. An entry carries the place of its class's first line. Hot tokens are split by adaptive execution.
    4. Long lists are first compared with a few leaders each, a class in a few of its lists. A class that links with an
       earlier leader is gone and asks no further, so a large group of near copies costs pairs in proportion to its size; it
       stays in the lists as an earlier line for others. All other classes are then compared with every earlier entry of all
       their lists.
    5. Candidates are verified on their whole sets, computed again from the texts of these lines only.
    """
    with shuffles_removed_after_use(docs.sparkSession):
        keyed, classes, gone = _judge(docs, doc_id, text)
    first = F.struct("doc_id", "line_no")
    judged = classes.select("h1", "h2", "n", "first").join(gone, "first", "left").select(
        "h1", "h2", "n", "first", F.col("gone").isNull().alias("stays"))
    return keyed.select("doc_id", "line_no", "n", "h1", "h2").join(judged, ["h1", "h2", "n"]).select(
        "doc_id", "line_no", F.col("n").alias("n_tokens"),
        (F.col("stays") & first.eqNullSafe(F.col("first"))).alias("kept"))


def _judge(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines with the key of their set, the classes of equal sets, and the first lines of the classes that go."""
    ranks = F.lit(_rarity(docs, text))
    first = F.struct("doc_id", "line_no")

    def ranked(h: Column) -> Column:
        rank = F.ascii(F.substring(ranks, _cell(h) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    once, hot = F.lit(1 << 56), F.lit(HOT_RANK << 56)  # tokens below the first occur in one line only
    length = F.col("n") - F.ceil(F.col("n") * UP / F.lit(DOWN)).cast("int") + 1
    keyed = written(
        _with_words(_lines(docs, doc_id, text))
        .select("doc_id", "line_no", F.sort_array(F.transform(_hashed(F.col("line")), ranked)).alias("sorted"))
        .withColumn("n", F.size("sorted"))
        .select("doc_id", "line_no", "n", F.xxhash64("sorted").alias("h1"), F.hash("sorted").alias("h2"),
                _parity(F.col("sorted")).alias("parity"),
                F.when(F.col("n") >= WIDE_FROM, _half_parity(F.col("sorted"))).alias("half"),
                F.slice("sorted", F.lit(1), length).alias("head"))
        # an index entry needs half of a token's bits: others that share them only add candidates
        .withColumn("prefix", F.transform(F.filter("head", lambda t: t >= once), lambda t: F.hash(t)))
        .withColumn("skipped", F.size("head") - F.size("prefix"))
        .withColumn("n_hot", F.size(F.filter("head", lambda t: t >= hot))).drop("head"))
    # equal sets have equal prefixes
    classes = written(
        keyed.groupBy("h1", "h2", "n").agg(
            F.min(first).alias("first"),
            *[F.first(c).alias(c) for c in ("parity", "half", "prefix", "skipped", "n_hot")]))

    led = _verified(docs, doc_id, text, _leader_pairs(classes))
    rest = _verified(docs, doc_id, text, _pairs(classes, led))
    gone = materialise(led.unionByName(rest))
    return keyed, classes, _small(gone)


def _hashed(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.transform(_pieces(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _small(rows: DataFrame) -> DataFrame:
    """To be broadcast when counted to be few."""
    return F.broadcast(rows) if rows.count() <= MOST_LINES else rows


def _postings(classes: DataFrame, tokens: Column, before: Column) -> DataFrame:
    """Index entries of ``tokens``, which stand after ``before`` others of the prefix: the token, the place of the class's
    first line, and size and place of the token in ``n_at``. A shut entry can be the earlier line of a pair, not the later
    one: its place is beyond any size."""
    at = F.col("i") + F.col("before") + F.when(F.col("shut"), F.lit(SHUT)).otherwise(F.lit(0).cast("long"))
    return classes.select("first.*", "parity", "half", "n", "shut", (F.col("skipped") + before).alias("before"),
                          F.posexplode(tokens).alias("i", "token")).select(
        "token", "doc_id", "line_no", "parity", "half", (F.shiftleft(F.col("n").cast("long"), 32) + at).alias("n_at"))


def _place(entry: str) -> Column:
    return F.struct(F.col(f"{entry}.doc_id").alias("doc_id"), F.col(f"{entry}.line_no").alias("line_no"))


def _near(a: str, b: str) -> Column:
    """The filters of length, place and parity for an earlier entry ``a`` and a later one ``b`` that is not shut, the
    cheapest first. No condition is on one of them only: pushed down, it would cost a second shuffle of the entries."""
    n_a, n_b = (F.shiftright(f"{c}.n_at", 32).cast("int") for c in (a, b))
    at_a, at_b = (F.col(f"{c}.n_at").bitwiseAND(F.lit(most)) for c, most in ((a, SHUT - 1), (b, 2 * SHUT - 1)))
    bits, half = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("parity", "half"))
    most_apart = n_a + n_b - 2 * _overlap(n_a, n_b)
    return (((UP + DOWN) * F.bit_count(bits) <= (DOWN - UP) * (n_a + n_b))
            & (DOWN * F.least(n_a, n_b) >= UP * F.greatest(n_a, n_b))
            & (F.least(n_a - at_a, n_b - at_b) >= _overlap(n_a, n_b))
            & (F.bit_count(bits) <= most_apart)
            & F.coalesce(F.bit_count(half) + F.bit_count(bits.bitwiseXOR(half)) <= most_apart, F.lit(True))
            & (_place(a) < _place(b)))


def _leader_pairs(classes: DataFrame) -> DataFrame:
    """Candidates of a class with the leaders of its long lists only.

    Classes of like size (up to a quarter more) in the list of a frequent token are dealt into LEADERS parts by hash; the
    first class of a part that holds LEAST_LED or more leads. Their number per list is fixed, so the pairs grow with the entries.
    """
    colder = F.size("prefix") - F.col("n_hot")
    # sets of one size find each other by the first of these tokens only
    most = F.col("n") - _overlap(F.col("n"), F.col("n")) + 1 - F.col("skipped") - colder
    led_by = F.slice("prefix", colder + 1, F.least(F.greatest(most, F.lit(0)), F.lit(LED_BY)))
    hot = _postings(classes.where("n_hot > 0").withColumn("shut", F.lit(False)), led_by, colder).withColumn(
        "size", F.floor(3 * F.log2(F.shiftright("n_at", 32).cast("double"))).cast("int"))
    part = F.pmod(F.hash("doc_id", "line_no"), F.lit(LEADERS))
    leaders = materialise(
        hot.groupBy("token", "size", part.alias("part"))
        .agg(F.min(F.struct("doc_id", "line_no", "parity", "half", "n_at")).alias("a"), F.count(F.lit(1)).alias("led"))
        .where(F.col("led") >= LEAST_LED).select(F.col("token").alias("of"), F.col("size").alias("of_size"), "a"))
    return materialise(
        hot.alias("b").join(_small(leaders), (F.col("token") == F.col("of")) & (F.col("size") == F.col("of_size")) & _near("a", "b"))
        .select(_place("a").alias("early"), _place("b").alias("late")).distinct())


def _pairs(classes: DataFrame, gone: DataFrame) -> DataFrame:
    """All candidates whose later class is not ``gone`` already."""
    marked = classes.join(_small(gone), "first", "left").withColumn("shut", F.col("gone").isNotNull())
    postings = _postings(marked, F.col("prefix"), F.lit(0))
    return materialise(
        postings.alias("a").join(postings.alias("b"), (F.col("a.token") == F.col("b.token")) & _near("a", "b"))
        .select(_place("a").alias("early"), _place("b").alias("late")).distinct())


def _verified(docs: DataFrame, doc_id: str, text: str, pairs: DataFrame) -> DataFrame:
    """The later lines of the pairs whose whole sets link. Only texts that hold a line of a pair are cut into lines."""
    wanted = materialise(
        pairs.select(F.col("early").alias("w")).unionByName(pairs.select(F.col("late").alias("w"))).distinct())
    holders = wanted.select(F.col("w.doc_id").alias("holder")).distinct()
    if wanted.count() <= MOST_LINES:
        wanted, holders = F.broadcast(wanted), F.broadcast(holders)
    place = F.struct("doc_id", "line_no")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(
        holders, F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    sets = materialise(
        _with_words(_lines(texts, "id", "body")).join(wanted, place.eqNullSafe(F.col("w")), "left_semi")
        .select(place.alias("w"), _hashed(F.col("line")).alias("tokens")).distinct())
    early, late = sets.alias("early"), sets.alias("late")
    common = F.size(F.array_intersect("early.tokens", "late.tokens"))
    return materialise(
        pairs.alias("p").join(early, F.col("p.early").eqNullSafe(F.col("early.w")))
        .join(late, F.col("p.late").eqNullSafe(F.col("late.w")))
        .where(common >= _overlap(F.size("early.tokens"), F.size("late.tokens")))
        .select(F.col("p.late").alias("first")).distinct().withColumn("gone", F.lit(True)))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that ``line_matches`` removes; lines without a word stay, null texts stay null."""
    gone = line_matches(docs, doc_id, text).where("NOT kept").groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_set("line_no").alias("gone"))
    # the row as one value: no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"))
    body = F.col("row").getField(text)
    numbered = F.transform(F.split(body, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.transform(F.filter(numbered, lambda x: ~F.array_contains("gone", x["i"])), lambda x: x["line"])
    left = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(kept, "\n"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("of")), "left")
    return joined.select(*[(left if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM s),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(
    [x FOR x IN regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+') IF x <> ''])) AS ts FROM l),
k AS (SELECT doc_id, line_no, ts, len(ts) AS n, row_number() OVER (PARTITION BY ts ORDER BY doc_id, line_no) AS nth
    FROM t WHERE len(ts) > 0),
c AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS id FROM k WHERE nth = 1),
w AS MATERIALIZED (SELECT id, n, unnest(ts) AS tok FROM c),
f AS (SELECT tok, count(*) AS df FROM w GROUP BY tok),
o AS (SELECT id, n, w.tok, row_number() OVER (PARTITION BY id ORDER BY df, w.tok) AS pos FROM w JOIN f USING (tok)),
p AS MATERIALIZED (SELECT * FROM o WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.tok = b.tok AND a.id < b.id
    AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT b FROM q JOIN c x ON x.id = a JOIN c y ON y.id = b
    WHERE 9 * len(list_intersect(x.ts, y.ts)) >= 4 * (x.n + y.n))
SELECT k.doc_id, k.line_no::INT AS line_no, k.n::INT AS n_tokens, k.nth = 1 AND g.b IS NULL AS kept
FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.line_no = c.line_no LEFT JOIN g ON g.b = c.id"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_matches(read(spark, sf, "documents"))
