"""Mixing sources to target weights by hierarchical budgets, in DataFrame expressions only.

Weights go down a tree of domain, language and source. Every node shares its budget among its
children by weight; a child that can't use its share (all its documents, as often as epochs
allow) leaves the rest to its siblings, and only what a whole subtree can't use goes back to
the node above. A leaf takes its documents in seeded random order: whole epochs first, then a
prefix of the next one, up to its budget of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import stored

#: Hexadecimal digits of the order hash that make a leaf's buckets: 4,096.
BUCKET_DIGITS = 3
#: Names of nodes without a value.
UNKNOWN = "unknown"


def count_tokens(text: Column) -> Column:
    """Words of a text: runs without 09-0D and 20 (hexadecimal); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, id_text: Column) -> Column:
    """A document's place in an epoch: md5 of seed, epoch and id, as hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_text, F.lit(""))).cast("binary"))


def _fill(nodes: DataFrame, parents: list[str], child: str, budgets: DataFrame | None, total: Column | None) -> DataFrame:
    """Budgets of the children of every parent: water-filling by weight under each child's capacity.

    With children in order of capacity / weight, the first ones take all their capacity while
    that is under what their weight is due of what is left; from then on all get their due.
    """
    if budgets is not None:
        nodes = nodes.join(budgets, parents)
        total = F.col("budget")
    order = Window.partitionBy(*parents, F.lit(1)).orderBy(F.col("capacity") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*parents, F.lit(1))
    nodes = nodes.withColumn("left", total - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level at the first child that isn't filled holds for all after it
    nodes = nodes.withColumn("level", F.col("left") / F.col("weights")).withColumn("full", F.col("capacity") <= F.col("level") * F.col("weight"))
    nodes = nodes.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("weight"), F.col(child), F.col("level").alias("level")))).over(everyone)["level"])
    share = F.when(F.col("level").isNull() | (F.col("capacity") <= F.col("level") * F.col("weight")), F.col("capacity").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return nodes.select(*parents, child, share.alias("budget"))


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens).

    weights has, under "domain", "lang" and "source", weights by name; a name without one
    weighs 1, one of 0 or less gets nothing. Budgets are whole tokens, rounded down.
    """

    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for name, value in weights.get(level, {}).items():
            out = F.when(F.col(level) == name, F.lit(float(value))).otherwise(out)
        return out

    for level in ("domain", "lang", "source"):
        leaves = leaves.filter(weight(level) > 0)
    sized = leaves.withColumn("capacity", F.col("tokens") * max_epochs).filter("capacity > 0")
    by_lang = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    top = _fill(by_domain.withColumn("weight", weight("domain")), [], "domain", None, F.lit(float(budget)))
    middle = _fill(by_lang.withColumn("weight", weight("lang")), ["domain"], "lang", top, None)
    bottom = _fill(sized.withColumn("weight", weight("source")).select("domain", "lang", "source", "capacity", "weight"), ["domain", "lang"], "source", middle, None)
    return leaves.join(bottom, ["domain", "lang", "source"]).select("domain", "lang", "source", "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


LEAF = ["domain", "lang", "source"]


def _leaf_columns(domain: Column | None, lang_col: str, source_col: str) -> list[Column]:
    given = (domain if domain is not None else F.lit(None), F.col(lang_col), F.col(source_col))
    return [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(name) for name, c in zip(LEAF, given, strict=True)]


def sizes(df: DataFrame, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of every document with a word, written to the shared folder.

    Null, empty and blank texts have no row; a null domain, language or source is "unknown"; null and
    repeated ids keep a row each; an empty table gives an empty one; other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), *_leaf_columns(domain, lang_col, source_col), count_tokens(F.col(text_col)).alias("n_tokens"))
    return stored(rows.filter("n_tokens > 0"), "mix-sizes")


def mix_plan(rows: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, float]], seed: int = 17) -> DataFrame:
    """(domain, lang, source, epochs, cut): how often a leaf takes all its documents, and the order hash that ends its prefix of the epoch after those.

    rows are those of sizes(). The prefix is found by 4,096 hash buckets of a leaf: sums of whole
    buckets, then single documents of the one bucket in which the budget ends.
    """
    leaves = stored(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, int(total * budget_share), max_epochs, weights)
    plan = plan.withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = stored(plan.select(*LEAF, "epochs", "rest"), "mix-plan")

    hashed = rows.join(plan.filter("rest > 0"), LEAF).select(*LEAF, "rest", "n_tokens", order_hash(seed, F.col("epochs"), F.col("doc_id").cast("string")).alias("hash"))
    hashed = hashed.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    sums = hashed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("in_bucket").over(upto) - F.col("in_bucket"))
    ends = stored(sums.filter("before < rest").groupBy(*LEAF).agg(F.max("bucket").alias("bucket"), F.max("before").alias("before")), "mix-ends")

    edge = hashed.join(ends, [*LEAF, "bucket"]).groupBy(*LEAF, "rest", "before", "bucket", "hash").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*LEAF).orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("passed", F.col("before") + F.sum("tokens").over(upto) - F.col("tokens"))
    cuts = edge.groupBy(*LEAF).agg(F.coalesce(F.min(F.when(F.col("passed") >= F.col("rest"), F.col("hash"))), F.concat(F.max("bucket"), F.lit("g"))).alias("cut"))
    return stored(plan.join(cuts, LEAF, "left").select(*LEAF, "epochs", F.coalesce("cut", F.lit("")).alias("cut")), "mix-cuts")


def mix_documents(rows: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, in_prefix) of every document that is taken.

    rows are those of sizes(), plan that of mix_plan(). A leaf with more budget than tokens takes
    each document once for every whole epoch; of the next epoch it takes the documents before
    which less than the rest of its budget has passed, in the order of a seeded hash, so it
    passes its budget by less than one document. copies counts how often a document is taken,
    in_prefix whether the last time was in that prefix. Null domain, language or source is
    "unknown"; documents without words are never taken; repeated rows are documents of their
    own, and rows of one id (or without one) are taken or left together; an empty table gives
    an empty result; other columns are ignored.

    Leaves are summed before they are shuffled and no task holds a leaf, however large; texts
    are read once and never shuffled.
    """
    taken = rows.join(plan, LEAF).withColumn("in_prefix", order_hash(seed, F.col("epochs"), F.col("doc_id").cast("string")) < F.col("cut"))
    return taken.withColumn("copies", F.col("epochs") + F.col("in_prefix").cast("long")).filter("copies > 0").select("doc_id", *LEAF, "n_tokens", "copies", "in_prefix")


def mixed_rows(df: DataFrame, plan: DataFrame, seed: int = 17, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df, all columns, as often as the plan takes them.

    Texts without words are never taken; a leaf that the plan doesn't know isn't either; rows of one
    id (or none) in a leaf are taken or left together; ties of the order hash fall on one side of
    the cut; columns of df may have any names; an empty table gives an empty one.
    """
    own = [F.struct(F.col(c)).alias(f"own{k}") for k, c in enumerate(df.columns)]  # names in df can't clash with the plan's
    rows = df.filter(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")).select(*own, F.col(id_col).cast("string").alias("id_text"), *_leaf_columns(domain, lang_col, source_col))
    taken = rows.join(plan, LEAF).withColumn("copies", F.col("epochs") + (order_hash(seed, F.col("epochs"), F.col("id_text")) < F.col("cut")).cast("long"))
    taken = taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col(f"own{k}")[c].alias(c) for k, c in enumerate(df.columns)])
