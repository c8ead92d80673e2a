"""Removal of lines that resemble an earlier line, by an exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW, SPACE, SPACE_CHARS, bound, packed
from lectern.session import stage

SHINGLE = 5
#: Jaccard similarity of at least 4/5, kept as whole numbers so that no rounding decides.
OVER, UNDER = 4, 5
COUNTERS = 1 << 18  # of the rarity sketch
FILTER = 1 << 20  # cells of the filter on documents
BITMAP, CELLS = 1 << 15, 1 << 26  # bits of one bitmap and of all, in the filter on set ids: 8 MB
SIZE = (1 << 20) - 1  # bits of a set id that hold its size, so that sizes can be compared before sets are
NO_ID = (1 << 63) - 1
LOW = (1 << 32) - 1
KEY = ("doc_id", "h", "line")


def windows(words: Column) -> Column:
    """64-bit hashes of the shingles of five words of a line, from a hash of each word; of a shorter line the hash of all its words."""
    def of(hashes):
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - SHINGLE, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))  # a missing word changes no hash

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def line_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the whole text), line (number from 0), n, d1, d2, tokens (distinct; case aside): lines with a word.

    d1 and d2 are hashes of 64 bits with seeds of their own, which together tell sets apart: of the words where there is one token, of the
    tokens elsewhere. Fewer than `OVER` tokens are alike only if equal, so these are hashed in a fixed order; larger sets meet by their tokens.
    The stored tokens are the upper 32 bits, for the order, the prefix and the count of what two sets share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(F.lower(text), "\n")).alias("line", "value"))
    rows = rows.where(F.col("value").rlike(r"[^\x20\x09-\x0D]"))
    split = F.split(F.trim(F.col("value"), F.lit(SPACE_CHARS)), SPACE + "+")
    sets = rows.select(*KEY, bound(split, lambda t: F.struct(F.array_distinct(windows(t)).alias("hashes"), F.xxhash64(F.lit(1), F.slice(t, 1, SHINGLE)).alias("only"))).alias("s"))
    sets = sets.select(*KEY, F.size("s.hashes").alias("n"), "s.only", F.when(F.size("s.hashes") < OVER, F.sort_array("s.hashes")).otherwise(F.col("s.hashes")).alias("hashes"))
    d2 = F.when(F.col("n") == 1, F.col("only")).otherwise(F.xxhash64(F.lit(1), F.col("hashes")))
    return sets.select(*KEY, "n", F.xxhash64("hashes").alias("d1"), d2.alias("d2"), F.transform("hashes", lambda x: F.shiftright(x, 32).cast("int")).alias("tokens"))


def rarity(sets: DataFrame) -> bytes:
    """A count sketch of all tokens with a fixed number of counters, each a byte on a logarithmic scale. It only orders tokens,
    which decides the cost and never the result."""
    cell = F.col("token").bitwiseAND(F.lit(COUNTERS - 1)).alias("cell")
    counts = sets.select(F.explode("tokens").alias("token")).groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(127), F.floor(F.log2(F.col("n").cast("double")) * 3) + 2).cast("int")
    table = bytearray(b"\1" * COUNTERS)
    for row in counts.select("cell", level.alias("level")).collect():  # a number per cell, `COUNTERS` rows at most
        table[row["cell"]] = row["level"]
    return bytes(table)


def _signed(x: Column) -> Column:
    return F.when(x > LOW >> 1, x - (LOW + 1)).otherwise(x).cast("int")


def set_id(d1: Column, n: Column) -> Column:
    """Part of the digest and the size. Sets that share an id by chance are verified one by one."""
    return d1.bitwiseAND(F.lit(~SIZE)).bitwiseOR(F.least(n, F.lit(SIZE)).cast("long"))


def _near_in_size(a: Column, b: Column) -> Column:
    n, m = a.bitwiseAND(F.lit(SIZE)), b.bitwiseAND(F.lit(SIZE))
    return (n == SIZE) | (m == SIZE) | _alike(F.least(n, m), n, m)


def prefix(tokens: Column, n: Column, counters: bytes) -> Column:
    """The rarest tokens of a set, as many as a set of any size at the least similarity must share one of: n - ceil(4n/5) + 1."""
    table = F.lit(counters)

    def ranked(token):
        level = F.ascii(F.substring(table, token.bitwiseAND(F.lit(COUNTERS - 1)) + 1, F.lit(1)).cast("string"))
        return F.coalesce(F.shiftleft(level.cast("long"), 32).bitwiseOR(token.cast("long").bitwiseAND(F.lit(LOW))), F.lit(0).cast("long"))

    length = n - F.expr(f"({OVER} * n + {UNDER - 1}) DIV {UNDER}").cast("int") + 1
    return F.transform(F.slice(F.sort_array(F.transform(tokens, ranked)), F.lit(1), length), lambda x: _signed(x.bitwiseAND(F.lit(LOW))))


def _alike(overlap, n, m):
    return (OVER + UNDER) * overlap >= OVER * (n + m)


def _cell() -> Column:
    return F.pmod(F.shiftright("id", 20), F.lit(CELLS))


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose id is among `ids`, as far as a filter of `CELLS` bits can tell; its bitmaps, 2048 at most, are sent to every task."""
    bits = ids.select(_cell().alias("cell")).select(F.floor(F.col("cell") / BITMAP).alias("bitmap"), (F.col("cell") % BITMAP).alias("place"))
    bits = stage(bits.groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits")), "line-cells")
    some = sets.withColumn("id", set_id(F.col("d1"), F.col("n"))).withColumn("cell", _cell())
    some = some.withColumn("bitmap", F.floor(F.col("cell") / BITMAP)).withColumn("place", (F.col("cell") % BITMAP).cast("int")).join(F.broadcast(bits), "bitmap")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return some.where(F.call_function("shiftright", byte, F.col("place").bitwiseAND(7)).bitwiseAND(1) == 1).drop("cell", "bitmap", "place", "bits")


def parity(tokens: Column, half: int) -> Column:
    """Half of a bitmap of 128 bits, in which each token turns one over: two sets differ in as many tokens as their bitmaps do in bits, or in more."""
    mine = lambda x: F.when(x.bitwiseAND(F.lit(64)) == 64 * half, F.call_function("shiftleft", F.lit(1).cast("long"), x)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(mine(x)))


def _marks(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """id, first, p0, p1: the earliest line and the bitmap of each of `ids`; nulls where sets share the id by chance, which then pass every filter."""
    some = _among(sets, ids).select("id", "d1", "d2", F.struct(*KEY).alias("key"), *[parity(F.col("tokens"), i).alias(f"p{i}") for i in (0, 1)])
    ones = some.groupBy("id").agg(F.min("key").alias("key"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)], F.min("p0").alias("p0"), F.min("p1").alias("p1"))
    one = (F.col("min_d1") == F.col("max_d1")) & (F.col("min_d2") == F.col("max_d2"))
    return ones.select("id", *[F.when(one, F.col(c)).alias(name) for c, name in (("key", "first"), ("p0", "p0"), ("p1", "p1"))])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """d1, d2, id of the later set of each pair (a, b) of ids that is alike. Only sets that pass the filter on ids are shuffled."""
    pairs = stage(pairs, "line-pairs")
    some = _among(sets, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    some = some.groupBy("d1", "d2").agg(F.min(F.struct(*KEY)).alias("key"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    some = some.withColumn("id", set_id(F.col("d1"), F.col("n")))
    left, right = (some.select(*[F.col(c).alias(f"{side}_{c}") for c in some.columns]) for side in ("a", "b"))
    both = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    both = both.where(_alike(F.least("a_n", "b_n"), F.col("a_n"), F.col("b_n")))
    alike = both.where(_alike(F.size(F.array_intersect("a_tokens", "b_tokens")), F.col("a_n"), F.col("b_n")))
    later = F.col("a_key") > F.col("b_key")
    return alike.select(F.when(later, F.col("a_d1")).otherwise(F.col("b_d1")).alias("d1"), F.when(later, F.col("a_d2")).otherwise(F.col("b_d2")).alias("d2"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, line of every line whose set of shingles has a Jaccard similarity of 0.8 or more with that of an earlier line.

    Earlier is by doc_id, then the text's hash, then the line number, over the whole table; matched lines count too. Lines with the same
    tokens in the same order, or in any order if there are fewer than four, collapse to the first one. Sets that are alike share a token among the rarest of each (prefix), which have
    similar sizes (length) and enough tokens left behind the shared one (position). Of each token's sets, all first meet one head, which
    settles groups of near copies at a row per set; only sets still without a match meet the others, and of these only
    the earlier ones whose bitmaps (`parity`) differ in no more bits than the sets may differ in tokens.
    """
    sets = stage(line_sets(docs, id_col, text_col), "line-sets")
    ranked = sets.select(*KEY, "d1", "d2", "n", prefix(F.col("tokens"), F.col("n"), rarity(sets)).alias("prefix"))
    firsts = ranked.groupBy("d1", "d2").agg(F.min(F.struct(*KEY)).alias("key"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    firsts = stage(firsts, "line-firsts")

    # The one large shuffle has a token, an id that tells the size, and a position.
    posted = firsts.where(f"n >= {OVER}").select(F.posexplode("prefix").alias("pos", "token"), set_id(F.col("d1"), F.col("n")).alias("id"))
    posted = posted.select("token", "id", "pos").repartition("token")
    # The set with the fewest rarer tokens has least of its own beside what it shares, so most near copies of it are alike to it.
    heads = posted.groupBy("token").agg(F.min(F.struct("pos", "id"))["id"].alias("head"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("token", "head")
    met = stage(posted.join(heads.hint("shuffle_hash"), "token"), "line-met")

    settled = stage(_verified(met.where(F.col("id") != F.col("head")).where(_near_in_size(F.col("id"), F.col("head"))).select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct(), sets), "line-settled")
    shared = firsts.groupBy(set_id(F.col("d1"), F.col("n")).alias("id")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")  # next to never
    marked = met.join(stage(_marks(sets, met.select("id").distinct()), "line-marks"), "id")
    open_ = marked.join(settled.select("id").distinct().join(shared, "id", "left_anti"), "id", "left_anti")

    def side(df, name):
        return df.select("token", F.col("id").alias(name), F.col("id").bitwiseAND(F.lit(SIZE)).alias(f"{name}_n"), *[F.col(c).alias(f"{name}_{c}") for c in ("pos", "first", "p0", "p1")])

    pairs = side(open_, "a").join(side(marked, "b"), "token").where("a <> b")
    pairs = pairs.where(F.coalesce(F.col("a_first") > F.col("b_first"), F.lit(True)))  # what b matches later on, it matches as an open set itself
    pairs = pairs.where(_near_in_size(F.col("a"), F.col("b")))
    most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    huge = (F.col("a_n") == SIZE) | (F.col("b_n") == SIZE)
    unlike = F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))) + F.bit_count(F.col("a_p1").bitwiseXOR(F.col("b_p1")))
    pairs = pairs.where(huge | F.coalesce((OVER + UNDER) * unlike <= (UNDER - OVER) * (F.col("a_n") + F.col("b_n")), F.lit(True)))
    pairs = pairs.where(huge | _alike(most, F.col("a_n"), F.col("b_n"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    gone = stage(settled.union(_verified(pairs, sets)).select("d1", "d2").distinct(), "line-gone")

    verdict = firsts.select("d1", "d2", "key").join(gone.withColumn("gone", F.lit(True)), ["d1", "d2"], "left")
    lines = sets.select(*KEY, "d1", "d2").join(verdict, ["d1", "d2"])
    return lines.where(F.coalesce("gone", F.lit(False)) | (F.struct(*KEY) != F.col("key"))).select(*KEY)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with the lines of `repeated` taken out of the text; `count` names a further column for their number.

    Lines end at \\n only; lines without a word never go. Every row stays, if only with an empty text. A null text
    stays null; a null id comes after every other; rows that repeat an id and a text come out alike, other rows with that id
    are documents of their own; an empty table gives no rows; other columns, whatever their names, stay as they are.
    """
    gone = repeated(docs, id_col=id_col, text_col=text_col).groupBy("doc_id").agg(F.collect_set(F.struct("h", "line")).alias("gone"))
    gone = stage(gone, "line-numbers")
    rows = packed(docs, F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"))
    # Documents that lose nothing pass by, as far as a filter of fixed size can tell, and are not shuffled.
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).alias("cell")
    cells = F.broadcast(stage(gone.select(cell).distinct(), "line-cells"))
    rows = rows.select("*", cell)
    untouched = rows.join(cells, "cell", "left_anti").select(ROW, "doc_id", "h", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    touched = rows.join(cells, "cell", "left_semi").join(gone, "doc_id", "left").select(ROW, "doc_id", "h", "gone")
    joined = untouched.union(touched).withColumn("numbers", F.transform(F.filter("gone", lambda g: g["h"] == F.col("h")), lambda g: g["line"]))

    def kept(text):
        def of(lines):
            numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("numbers"))
            return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

        return bound(F.split(text, "\n"), of)

    text = F.col(ROW)[text_col]
    new = F.when(text.isNull() | F.col("numbers").isNull() | (F.size("numbers") == 0), text).otherwise(kept(text))
    done = joined.select(ROW, new.alias("new"), F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("count"))
    columns = [F.col("new" if c == text_col else f"{ROW}.`{c}`").alias(c) for c in docs.columns if c != count]
    return done.select(*columns, *([F.col("count").alias(count)] if count else []))
