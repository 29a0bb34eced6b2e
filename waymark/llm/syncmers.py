"""Document fingerprints from closed syncmers, in DataFrame expressions only.

Of a text's windows of K words those are anchors whose smallest inner run of S words (by
hash) stands first or last. Whether a window is one depends on its own words alone, so an
edit moves or changes only the anchors that touch it. A fingerprint keeps every place of every
anchor, about two of five windows; two fingerprints are compared by the anchors they share,
equal hashes paired in the order of their places, in chains of one shift. Words are runs without
white space; in scripts that write none every character is a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import stored

#: Words of a window, and of the inner runs whose smallest decides (runs of two words, windows of a whole number of them).
K, S = 6, 2
#: Scripts that write no spaces between words: each of their characters is a word.
UNSPACED = "".join(f"\\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Yi"))
#: Document ids of a group that looks up its next documents together: 2 ** GROUP_BITS; then the bits of each level above.
GROUP_BITS, LEVEL_BITS = 8, (28, 44)
#: Groups up to which the list of their last documents is broadcast (16 bytes each).
MAX_BROADCAST_GROUPS = 500_000

#: Rows of one id from which they are dealt out by a hash of their columns, copies counted instead of dealt.
HOT_ROWS = 4_096
#: Bits of that hash.
BUCKET_BITS = 12

_LEAST = -(2**63)


def words_of(text: str) -> str:
    """SQL of a text's words: runs without white space, cut around and between the characters of UNSPACED scripts."""
    own = UNSPACED.replace("\\", "\\\\")
    return f"if({text} rlike '[{own}]', regexp_extract_all({text}, '[{own}]|[^\\\\s{own}]+', 0), filter(split({text}, '\\\\s+'), w -> w <> ''))"


def anchors_of(text: str) -> str:
    """SQL of a text's anchors, array<struct<h bigint, p int>>: every place of every hash, by hash, then place.

    A text with words but without a syncmer (as any of fewer than K) has one anchor, the hash of all of them.
    """
    last = K - S  # place of the last inner run in a window
    middle = ", ".join(f"r[i + {k}]" for k in range(1, last))
    chosen = f"filter(sequence(0, size(w) - {K}), i -> least(r[i], r[i + {last}]) <= least({middle}))"
    hashed = f"transform({chosen}, i -> struct(xxhash64({', '.join(f'r[i + {k}]' for k in range(0, K - 1, S))}) as h, i as p))"
    whole = "array(struct(aggregate(w, 0L, (a, x) -> xxhash64(a, x)) as h, 0 as p))"
    made = (
        f"transform(array(transform({words_of(text)}, w -> xxhash64(w))), w -> "
        f"case when size(w) = 0 then array() when size(w) < {K} then {whole} "
        f"else transform(transform(array(transform(w, (x, i) -> xxhash64(x, w[least(i + 1, size(w) - 1)]))), r -> {hashed}), x -> if(size(x) = 0, {whole}, x))[0] end)[0]"
    )
    return f"sort_array({made})"


def fingerprint_text(anchors: str) -> str:
    """SQL of the fingerprint as text: hash (hexadecimal) and place of each anchor, by hash; empty without words."""
    return f"array_join(transform({anchors}, x -> concat(lower(hex(x.h)), ':', x.p)), ' ')"


def likeness(a: str, b: str) -> str:
    """SQL of the likeness of two arrays of anchors, 0 to 1.

    A hash's first place in a is paired with its first in b, the second with the second, and so
    on; what one has more often stays alone. Of the pairs, in the order of their places in a, those
    count whose shift is that of the one before or after (one of them, if none is), over all
    anchors that either holds: what was inserted or cut out splits a copy into chains, each with a
    shift of its own. Equal fingerprints are 1 (a text with words has one that isn't empty), one
    without anchors against another 0. Both arrays are merged by hash and the pairs sorted by
    place, so the work is n log n in the anchors.
    """

    def sided(x: str, k: int) -> str:
        """The anchors with the number of their place among those of one hash, found from where each hash begins."""
        begins = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[greatest(i - 1, 0)].h <> s[i].h)"
        numbered = f"transform(slice(s, b + 1, coalesce(get(f, j + 1), size(s)) - b), (e, o) -> struct(e.h as h, o as o, {k} as k, e.p as p))"
        return f"transform(array({x}), s -> transform(array({begins}), f -> flatten(transform(f, (b, j) -> {numbered})))[0])[0]"

    # a hash and number stand once in each array, so equal neighbours are one of either
    shared = "transform(filter(sequence(0, size(m) - 2), i -> m[i].h = m[i + 1].h and m[i].o = m[i + 1].o), i -> struct(m[i].p as p, m[i + 1].p - m[i].p as d))"
    chained = "size(filter(s, (x, i) -> (i > 0 and s[greatest(i - 1, 0)].d = x.d) or (i + 1 < size(s) and s[least(i + 1, size(s) - 1)].d = x.d)))"
    return (
        f"case when {a} = {b} then 1D when size({a}) = 0 or size({b}) = 0 then 0D else "
        f"transform(array(sort_array(concat({sided(a, 0)}, {sided(b, 1)}))), m -> transform(array(sort_array({shared})), s -> "
        f"if(size(s) = 0, 0D, cast(greatest({chained}, 1) as double) / (size(m) - size(s))))[0])[0] end"
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, anchors, fingerprint) of every whole text; null counts as empty. Narrow: no shuffle, no Python.

    Equal texts have equal fingerprints; a text without words has no anchors and an empty one.
    One row per input row; other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.selectExpr("doc_id", f"{anchors_of('text')} as anchors").selectExpr("doc_id", "anchors", f"{fingerprint_text('anchors')} as fingerprint")


def _last_of_groups(ids: DataFrame) -> DataFrame:
    """(host, guest): for each group of ids the largest id below it (below the least group: the largest of all).

    ids holds one column "key". Largest ids of groups go up a tree of fixed bits, so a window
    holds 2 ** 20 rows at most, however the ids are spread.
    """
    below = lambda by: Window.partitionBy(*by).orderBy(F.desc("node"))
    level = ids.groupBy(F.shiftright("key", GROUP_BITS).alias("node")).agg(F.max("key").alias("largest"))
    levels, shift = [level], GROUP_BITS
    for bits in LEVEL_BITS:
        levels.append(levels[-1].groupBy(F.shiftright("node", bits - shift).alias("node")).agg(F.max("largest").alias("largest")))
        shift = bits
    top = levels[-1].withColumn("below", F.coalesce(F.lead("largest").over(below([F.lit(1)])), F.first("largest").over(below([F.lit(1)]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    shifts = [GROUP_BITS, *LEVEL_BITS]
    for k in range(len(levels) - 2, -1, -1):
        here = levels[k].withColumn("up", F.shiftright("node", shifts[k + 1] - shifts[k]))
        here = here.withColumn("inside", F.lead("largest").over(below(["up"])))
        above = top.select(F.col("node").alias("up"), F.col("below").alias("outside"))
        top = here.join(above, "up").select("node", "largest", F.coalesce("inside", "outside").alias("below"))
    return top.select(F.col("node").alias("host"), F.col("below").alias("guest"))


def _hot_groups(rows: DataFrame, hosts: DataFrame, hot: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and hosts where some ids have very many rows: groups that hold such an id are cut by id and, for it, by bucket.

    Rows get host (three columns) and copies, rows of a hot id that are equal become one; hosts
    name, for every group, the id and bucket that follow it.
    """
    small = F.broadcast if hot.count() <= MAX_BROADCAST_GROUPS else lambda x: x  # there are no more groups of hot ids than hot ids
    few = small(hot)
    majors = hot.select(F.shiftright("key", GROUP_BITS).alias("major")).distinct()
    own = [c for c in rows.columns]
    equal = rows.join(few, "key", "left_semi").groupBy(*own).agg(F.count("*").alias("copies")).withColumn("bucket", F.shiftright("place", 64 - BUCKET_BITS))
    rest = rows.join(few, "key", "left_anti").withColumns({"copies": F.lit(1).cast("long"), "bucket": F.lit(0).cast("long")})
    both = equal.select(*own, "copies", "bucket").unionByName(rest).withColumn("major", F.shiftright("key", GROUP_BITS))
    both = both.join(small(majors.withColumn("cut", F.lit(True))), "major", "left").withColumn("part", F.when(F.col("cut"), F.col("key"))).drop("cut")

    groups = stored(both.filter("part is not null").select("major", "part", "bucket").distinct(), "next-parts")
    starts = groups.join(few.select(F.col("key").alias("part")), "part").groupBy(F.col("part").alias("guest")).agg(F.min("bucket").alias("guest_bucket"))
    after = hosts.select(F.col("host").alias("major"), "guest").join(starts, "guest", "left").withColumn("guest_bucket", F.coalesce("guest_bucket", F.lit(0).cast("long")))
    order = Window.partitionBy("major").orderBy(F.desc("part"), "bucket")  # at most an id's buckets for each of a group's ids
    inner = groups.withColumn("inside", F.lead(F.struct("part", "bucket")).over(order)).join(after, "major")
    cut = inner.select("major", "part", "bucket", F.coalesce("inside.part", "guest").alias("guest"), F.coalesce("inside.bucket", "guest_bucket").alias("guest_bucket"))
    whole = after.join(majors, "major", "left_anti").select("major", F.lit(None).cast("long").alias("part"), F.lit(0).cast("long").alias("bucket"), "guest", "guest_bucket")
    return both, stored(cut.unionByName(whole), "next-groups")


def with_next(df: DataFrame, columns: list[str], derived: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """id, columns and derived columns (name: SQL over columns) of df and, for each, next_<column>: its value in the next document by descending id (after the last: the first).

    A null id comes last; rows of one id follow each other in the order of a hash of the columns,
    then of the columns. Rows are shuffled once, by groups of ids, before the derived columns are
    made; each group also gets the document that follows its last one. That list is broadcast while
    it is small, else joined. An id (or none) that very many rows share is cut into groups by the
    hash, and rows of it that are equal are counted, so no task gets all of them.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    hosts = stored(_last_of_groups(df.select(key.alias("key"))), "next-groups")
    hot = stored(df.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select("key"), "next-hot")
    rows = df.select(key.alias("key"), id_col, *columns).withColumn("place", F.xxhash64(*columns))
    if hot.isEmpty():
        rows = rows.withColumns({"major": F.shiftright("key", GROUP_BITS), "part": F.lit(None).cast("long"), "bucket": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
        hosts = hosts.select(F.col("host").alias("major"), F.lit(None).cast("long").alias("part"), F.lit(0).cast("long").alias("bucket"), "guest", F.lit(0).cast("long").alias("guest_bucket"))
    else:
        rows, hosts = _hot_groups(rows, hosts, hot, columns)
    small = hosts.count() <= MAX_BROADCAST_GROUPS
    own = ["key", id_col, *columns, "place", "copies"]
    to = hosts.select(F.col("major").alias("to_major"), F.col("part").alias("to_part"), F.col("bucket").alias("to_bucket"), "guest", "guest_bucket")
    guests = rows.join(F.broadcast(to) if small else to, (F.col("key") == F.col("guest")) & (F.col("bucket") == F.col("guest_bucket")))
    guests = guests.select(*own, F.col("to_major").alias("major"), F.col("to_part").alias("part"), F.col("to_bucket").alias("bucket"), F.lit(True).alias("guest"))
    both = rows.select(*own, "major", "part", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    host = ["major", "part", "bucket"]
    both = both.repartition(*host).selectExpr("*", *[f"{sql} as {name}" for name, sql in derived.items()])
    order = Window.partitionBy(*host).orderBy("guest", F.desc("key"), "place", *columns)
    every = [*columns, *derived]
    after = [F.lead(c).over(order).alias(f"next_{c}") for c in every]
    out = both.select(id_col, *every, "copies", "guest", *after).filter(~F.col("guest")).drop("guest")
    if hot.isEmpty():
        return out.drop("copies")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))  # a copy is followed by the next one, the last by the next document
    return out.select(id_col, *every, *[F.when(F.col("copy") < F.col("copies"), F.col(c)).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in every])


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document, by descending id, after the last the first. near_edited and
    near_next are the likeness of a text's fingerprint to the edited text's and to the next
    document's. Null texts count as empty; one row per input row; an empty table gives an empty
    result; other columns are ignored. One shuffle of the texts, no Python.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, ["text"], {"anchors": anchors_of("text")})
    rows = rows.selectExpr("doc_id", "cast(length(text) as bigint) as n_chars", "anchors", "next_anchors", "concat(substring(text, 1, length(text) - length(text) div 2), substring(next_text, 1, length(text) div 2)) as edited")
    rows = rows.selectExpr("doc_id", "n_chars", "anchors", "next_anchors", "sha2(encode(edited, 'UTF-8'), 256) as edited_sha256", f"{anchors_of('edited')} as edited_anchors")
    return rows.selectExpr(
        "doc_id", "n_chars", "edited_sha256",
        f"{fingerprint_text('anchors')} as fingerprint", f"{fingerprint_text('edited_anchors')} as edited_fingerprint",
        f"{likeness('anchors', 'edited_anchors')} as near_edited", f"{likeness('anchors', 'next_anchors')} as near_next",
    )
