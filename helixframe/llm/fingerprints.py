"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to
a wide vector, and the fingerprint of a text is the sum of these vectors, lane
by lane, modulo powers of two:

* ``EXACT`` lanes modulo 2**32, the words of the paragraph's SHA-256: equal
  fingerprints mean equal multisets of paragraphs;
* ``NEAR`` lanes modulo 2**16: each pair of neighbouring words of the
  paragraph adds 1 or -1 to one lane, both chosen by the pair's CRC-32.  The
  squared length of the difference of two fingerprints estimates how many
  pairs the texts do not share.

Sums do not depend on the order of paragraphs, and paragraphs are inserted or
deleted by adding or subtracting the fingerprint of what comes or goes, without
the rest of the text.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import store

EXACT, NEAR = 8, 128
EXACT_BITS, NEAR_BITS = 32, 16


def entries(text: Column) -> Column:
    """What the paragraphs of a text add, as an array of longs.

    An exact lane's word comes as ``(lane + 1) << 32 | word``; a pair of
    neighbouring words (or the only word) as its near lane, plus ``NEAR`` if it
    counts -1.
    """
    read = F.transform(F.split(text, "\n"), lambda p: F.struct(F.sha2(p, 256).alias("d"), F.split(p, " ").alias("w")))

    def added(p: Column) -> Column:
        exact = F.array(*(F.conv(F.substring(p["d"], 8 * k + 1, 8), 16, 10).cast("long") + F.lit((k + 1) << 32) for k in range(EXACT)))
        n = F.size(p["w"])
        second = F.when(n > 1, F.slice(p["w"], F.lit(2), F.greatest(n - 1, F.lit(1)))).otherwise(F.array(F.lit("")))
        pairs = F.zip_with(F.slice(p["w"], F.lit(1), F.greatest(n - 1, F.lit(1))), second, lambda a, b: F.crc32(F.concat(a, F.lit(" "), b)) % (2 * NEAR))
        return F.concat(exact, pairs)

    return F.flatten(F.transform(read, added))


def _lane(entry: Column) -> Column:
    return F.when(entry < 2 * NEAR, EXACT + entry % NEAR).otherwise(F.shiftright(entry, 32) - 1).cast("int")


def _value(entry: Column) -> Column:
    return F.when(entry < NEAR, 1).when(entry < 2 * NEAR, -1).otherwise(entry.bitwiseAND(F.lit((1 << 32) - 1)))


def lanes(parts: DataFrame, keys: list[str], weights: dict[str, Column]) -> DataFrame:
    """``keys`` and, for each name of ``weights``, the lanes of the texts of ``parts`` (keys, text, ...) summed with that weight.

    A weight tells how often a part is inserted (negative: deleted).  The part
    with a weight of 1 in the first place brings all lanes along.  If ``parts``
    is dealt by ``keys``, nothing is shuffled.
    """
    zeros = F.array(*(F.lit((k + 1) << 32) for k in range(EXACT + NEAR)))
    listed = F.concat(entries(F.col("text")), F.when(next(iter(weights.values())) == 1, zeros).otherwise(F.slice(zeros, 1, 0)))
    named = parts.select(*keys, *(w.alias(f"_{n}") for n, w in weights.items()), F.explode(listed).alias("_entry"))
    value = [F.sum(F.col(f"_{n}") * _value(F.col("_entry"))).alias(n) for n in weights]
    each = named.groupBy(*keys, _lane(F.col("_entry")).alias("_lane")).agg(*value)
    modulus = F.when(F.col("_lane") < EXACT, F.lit(1 << EXACT_BITS)).otherwise(F.lit(1 << NEAR_BITS))
    each = each.select(*keys, "_lane", *(F.pmod(F.col(n), modulus).alias(n) for n in weights))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_lane", *weights))).alias("_all"))
    return rows.select(*keys, *(F.col(f"_all.{n}").alias(n) for n in weights))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of two texts together, or with ``sign`` -1 of what is left of the first without the second."""
    return F.zip_with(F.transform(a, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), b,
                      lambda p, y: F.pmod(p["x"] + sign * y, F.when(p["k"] < EXACT, F.lit(1 << EXACT_BITS)).otherwise(F.lit(1 << NEAR_BITS))))


def as_text(vector: Column) -> Column:
    """The fingerprint as lower-case hexadecimal digits, eight a exact lane and four a near lane."""
    return F.lower(F.concat_ws("", F.transform(vector, lambda x, k: F.lpad(F.hex(x), F.when(k < EXACT, EXACT_BITS // 4).otherwise(NEAR_BITS // 4), F.lit("0")))))


def _length(lanes: Column) -> Column:
    """Squared length of near lanes, taken as numbers around zero."""
    half = F.lit(1 << (NEAR_BITS - 1))
    around = F.transform(lanes, lambda x: (F.pmod(x + half, F.lit(1 << NEAR_BITS)) - half).cast("long"))
    return F.aggregate(around, F.lit(0).cast("long"), lambda s, x: s + x * x)


def near(vector: Column) -> Column:
    """The near lanes."""
    return F.slice(vector, EXACT + 1, NEAR).cast("array<int>")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 by two vectors' near lanes: 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0; equal lanes give 1.

    It estimates the share of word pairs that both texts have; with 128 lanes
    the error of |a - b|^2 is about an eighth of it.
    """
    apart = _length(F.zip_with(a, b, lambda x, y: x - y))
    return F.when(apart == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / (_length(a) + _length(b))))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row of ``docs``, dealt by a hash of id and text; equal rows give one row.

    A null text is empty and has one empty paragraph, as an empty text has.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    own = parts.groupBy("id", "mark").agg(F.any_value("text").alias("text"))
    return lanes(own, ["id", "mark"], {"v": F.lit(1)}).select(F.col("id").alias(id_col), as_text(F.col("v")).alias("fingerprint"))


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (k1, k2, id, n, times) with the keys of the row after it and the keys and ``n`` of the row before it.

    The order is that of id (nulls first) and k2; after the last comes the
    first.  Rows are range-sorted once; windows run within ranges, and only the
    first and last row of each range meet.
    """
    order = [F.asc_nulls_first("id"), F.asc("k2")]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = store(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "fingerprint-order")
    me = F.struct("k1", "k2", "n")
    ends = placed.groupBy("part").agg(F.min_by(me, "row").alias("head"), F.max_by(me, "row").alias("foot"))
    # one row a range
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("head").over(line), F.first("head").over(whole)).alias("then"),
                       F.coalesce(F.lag("foot").over(line), F.last("foot").over(whole)).alias("before"))
    inside = Window.partitionBy("part").orderBy("row")
    out = placed.select("*", F.lead(me).over(inside).alias("next"), F.lag(me).over(inside).alias("prev")).join(F.broadcast(ends), "part")
    out = out.withColumns({"next": F.coalesce("next", "then"), "prev": F.coalesce("prev", "before")})
    return out.select("k1", "k2", "id", "n", "times", F.col("next.k1").alias("next1"), F.col("next.k2").alias("next2"),
                      F.col("prev.k1").alias("prev1"), F.col("prev.k2").alias("prev2"), F.col("prev.n").alias("prev_n"))


def edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are.

    The edited text has its last quarter (of code points, rounded down)
    replaced by as many first code points of the next document in ascending id,
    or all it has; after the last document comes the first.  Its fingerprint is
    the text's without the paragraphs from the first changed one on, with those
    that stand there now.

    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty.  Null ids come first; rows
    of one id are ordered by a hash of the text; rows equal in both are one
    document and get equal rows.  A single document is its own next.  An empty
    table gives no rows.  Other columns are not read.  Texts are shuffled once,
    by the hash of id and text, so no id is hot.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    k2 = F.xxhash64(F.col("id").isNull(), F.col("text"))
    keyed = rows.select(F.coalesce(F.xxhash64("id"), F.lit(0)).alias("k1"), k2.alias("k2"), "id", "text")
    light = keyed.groupBy("k1", "k2", "id").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("times"))
    order = store(neighbours(light), "fingerprint-next")
    own = keyed.groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    own = own.join(order.select("k1", "k2", "n", "prev1", "prev2", "prev_n").hint("merge"), ["k1", "k2"])
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int")
    sent = own.select(F.col("prev1").alias("k1"), F.col("prev2").alias("k2"), F.substring("text", F.lit(1), quarter("prev_n")).alias("tail"))
    wide = own.join(sent.hint("merge"), ["k1", "k2"])
    wide = wide.select("k1", "k2", "text", "tail", quarter("n").alias("q"), F.substring("text", F.lit(1), F.col("n") - quarter("n")).alias("head"))
    stem = F.substring_index("head", "\n", -1)
    part = lambda own, edited, text: F.struct(F.lit(own).alias("own"), F.lit(edited).alias("edited"), text.alias("text"))
    gone = F.concat(stem, F.substring("text", F.length("head") + 1, F.col("q")))
    parts = F.explode(F.array(part(1, 1, F.col("text")), part(0, -1, gone), part(0, 1, F.concat(stem, "tail")))).alias("part")
    parts = wide.select("k1", "k2", F.unhex(F.sha2(F.concat("head", "tail"), 256)).alias("sha"), parts).select("k1", "k2", "sha", "part.*")
    table = store(lanes(parts, ["k1", "k2", "sha"], {"v": F.col("own"), "e": F.col("edited")}), "fingerprints")
    after = table.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), near(F.col("v")).alias("w"))
    order = order.select("k1", "k2", "id", "n", "times", "next1", "next2").join(after.hint("merge"), ["next1", "next2"])
    both = table.join(order.hint("merge"), ["k1", "k2"])
    both = both.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return both.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("v")).alias("fingerprint"),
                       as_text(F.col("e")).alias("edited_fingerprint"), likeness(near(F.col("v")), near(F.col("e"))).alias("near_edited"), likeness(near(F.col("v")), F.col("w")).alias("near_next"))
