"""One-permutation MinHash in DataFrame functions alone.

Every shingle of ``WORDS`` words is hashed once; the upper bits choose one of ``BINS`` bins and each bin keeps its least
hash. An empty bin takes the value of the non-empty bin that comes first in an order drawn for it by a hash of the two
bins, which is optimal densification with the draws made without replacement. The low eight bits of each bin's hash are
stored, and likeness is the share of equal bytes corrected for bytes that agree by chance.

Cases: a null text counts as empty; a text without words has an empty fingerprint, alike (1) to another such and unlike
(0) to all others; fewer words than a shingle make one shingle; repeated rows of one id and text stand at one place of
the order and get equal results; rows of one id with different texts are ordered by their hash; null ids come last; the
only document is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlace.session import materialize

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Entries of one range in which the documents' order is laid out, about, and ranges at most.
RANGE_ROWS, MAX_RANGES = 200_000, 4096
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word shingles of ``text``, an empty array where there is no word."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    tokens = F.split(trimmed, "[ \\t\\n\\x0B\\x0C\\r]+")
    each = let(
        F.transform(tokens, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) <= words, F.array(F.xxhash64(h))).otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(-1, words - 1)]))),
    )
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(each)


def bin_bytes(hashes: Column) -> Column:
    """One byte (0 to 255) per bin; an empty array for no hashes."""

    def least_of_bins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(F.get(s, i - 1)) != _bin(x)))

    def masks(p: Column) -> Column:
        half = lambda high: F.aggregate(p, F.lit(0).cast("long"), lambda m, x: F.when((_bin(x) >= 64) == F.lit(high), m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), _bin(x).bitwiseAND(63)))).otherwise(m))
        return F.struct(half(False).alias("lo"), half(True).alias("hi"))

    def empty_bins(m: Column) -> Column:
        word = lambda j: F.when(j < 64, m["lo"]).otherwise(m["hi"])
        return F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.call_function("shiftrightunsigned", word(j), j.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 0)

    def filled(p: Column) -> Column:
        own = F.transform(p, lambda x: _bin(x) * 256 + x.bitwiseAND(255).cast("int"))
        drawn = lambda e: F.array_min(F.transform(p, lambda x: F.xxhash64(e, _bin(x)).bitwiseAND(~255).bitwiseOR(x.bitwiseAND(255)))).bitwiseAND(255).cast("int")
        taken = F.when(F.size(p) < BINS, let(masks(p), lambda m: F.transform(empty_bins(m), lambda e: e * 256 + drawn(e)))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.sort_array(F.concat(own, taken)), lambda v: v.bitwiseAND(255))

    dense = let(let(F.sort_array(hashes), least_of_bins), filled)
    return F.when(F.size(hashes) == 0, F.array().cast("array<int>")).otherwise(dense)


def fingerprint_bytes(text: Column, words: int = WORDS) -> Column:
    return let(shingle_hashes(text, words), bin_bytes)


def packed(bins: Column) -> Column:
    """The bins' bytes as hexadecimal digits."""
    return F.array_join(F.transform(bins, lambda v: F.lower(F.lpad(F.hex(v), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two rows of bin bytes: E = J + (1 - J) / 256 solved for J."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t)) / F.lit(float(BINS))
    chance = 1.0 / 256
    j = F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(j)


def unpacked(hexes: Column) -> Column:
    """Two-digit strings of a packed fingerprint, which are as good as its bytes to compare."""
    return F.when(F.length(hexes) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(hexes, i * 2 + 1, F.lit(2))))


def neighbours(entries: DataFrame) -> DataFrame:
    """(key, next_key) in descending order of ``key``; the last one's next is the first.

    Keys are laid out in ranges by quantiles of the id; a range's last key is followed by the next range's first one.
    """
    n = entries.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cuts = entries.agg(F.percentile_approx("key.doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(cuts))]) if ranges > 1 and cuts else F.array().cast("array<bigint>")
    placed = entries.withColumn("range", F.when(F.col("key.doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("key.doc_id")))))
    inside = placed.withColumn("next_key", F.lead("key").over(Window.partitionBy("range").orderBy(F.desc("key"))))
    # At most MAX_RANGES + 1 rows from here to the join.
    tops = placed.groupBy("range").agg(F.max("key").alias("top"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = tops.select("range", F.coalesce(F.lead("top").over(order), F.first("top").over(whole)).alias("after"))
    return inside.join(F.broadcast(following), "range").select("key", F.coalesce("next_key", "after").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likeness to the edited text and to the next document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    # The scan below reads all texts, but only their hashes and lengths are shuffled.
    entries = rows.groupBy("doc_id", "th").agg(F.max(F.char_length("text")).alias("n")).select(F.struct("doc_id", "th").alias("key"), "n")
    entries = materialize(entries, "entries")
    follows = materialize(neighbours(entries), "follows")
    before = entries.join(follows, "key").select(F.col("next_key").alias("key"), F.col("key").alias("prev_key"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    plan = before.join(follows, "key")
    # One set of plain columns carries the null-safe key through both joins and the window, so texts are shuffled once
    # and only the heads that the previous documents need are shuffled again.
    parts = lambda c, p: [F.coalesce(c["doc_id"], F.lit(0)).alias(f"{p}id"), c["doc_id"].isNull().alias(f"{p}null"), c["th"].alias(f"{p}th")]
    plan = plan.select(*parts(F.col("key"), "e"), "prev_key", "need", "next_key")
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("kid"), F.col("doc_id").isNull().alias("knull"), F.col("th").alias("kth"), "text")
    same = lambda p: (F.col("kid") == F.col(f"{p}id")) & (F.col("knull") == F.col(f"{p}null")) & (F.col("kth") == F.col(f"{p}th"))
    placed = keyed.join(plan.hint("shuffle_merge"), same("e"))
    once = placed.withColumn("nth", F.row_number().over(Window.partitionBy("kid", "knull", "kth").orderBy("need"))).where("nth = 1")
    heads = once.select(*parts(F.col("prev_key"), "p"), F.expr("substring(text, 1, need)").alias("head"))
    both = placed.join(heads.hint("shuffle_merge"), same("p")).withColumns({"doc_id": F.when(~F.col("knull"), F.col("kid")), "th": F.col("kth")})
    n = F.char_length("text")
    both = both.select("doc_id", "th", "next_key", "text", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.col("head")).alias("edited"))
    printed = both.select("doc_id", "th", "next_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(fingerprint_bytes(F.col("text"))).alias("fingerprint"), packed(fingerprint_bytes(F.col("edited"))).alias("edited_fingerprint"))
    printed = materialize(printed, "prints")
    theirs = printed.groupBy(F.col("doc_id").alias("n_id"), F.col("th").alias("n_th")).agg(F.max("fingerprint").alias("next_print"))
    out = printed.join(theirs, F.col("next_key.doc_id").eqNullSafe(F.col("n_id")) & (F.col("next_key.th") == F.col("n_th")))
    alike = lambda a, b: let(F.struct(unpacked(F.col(a)).alias("a"), unpacked(F.col(b)).alias("b")), lambda s: likeness(s["a"], s["b"]))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("fingerprint", "edited_fingerprint").alias("near_edited"), alike("fingerprint", "next_print").alias("near_next"))
