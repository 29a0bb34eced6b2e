"""URL filters by association rules.

A URL's scheme, host parts, path segments and query keys are tokens. FP-growth mines the
token combinations of labelled URLs; rules from a combination to "unwanted" that are
confident and supported enough, and surer than any shorter one they contain, block the URLs
that hold all their tokens, found through an inverted index from each rule's rarest token.
Written rules on hosts and paths stand above the mined ones.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from waymark.llm._common import stored

#: Written rules: host, path, verdict. One fits its host and all subdomains if the URL's path starts with its own.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: Least share of labelled URLs, and least number, that a combination stands in.
MIN_SUPPORT = 0.002
MIN_COUNT = 10
#: Least share of unwanted URLs among those that hold a combination.
MIN_CONFIDENCE = 0.8
#: Rules up to which their index goes to every executor; more are joined as a table.
MAX_BROADCAST_RULES = 150_000

_UNWANTED = "label:unwanted"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end, A-Z lower-cased; empty for null or without "://"."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without "://"."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host suffixes and words, path segments (numbers as #), query keys."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "[?]([^#]*)", 1)
    parts = F.split(host, "[.]")
    words = F.split(host, "[^a-z0-9\\x{80}-\\x{10FFFF}]+")
    segments = F.split(F.regexp_replace(F.lower(path), "[0-9]+", "#"), "/")
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    named = [
        F.array(F.concat(F.lit("site:"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "."))),
        F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(segments, lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x)),
        F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("key:"), x)),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*named)))


@dataclass
class MinedRules:
    """Mined rules as a table, and the frequent tokens.

    Tokens that stand in the same labelled pages are one class, named by the first of them:
    classes has a class's tokens by its name, rows the labelled pages of each token. table has
    (tokens: names of classes, sorted; confidence; support; anchor: the class of the fewest
    labelled pages, ties to the first name); a URL holds a rule if it holds a token of each class.
    """

    table: DataFrame | None = None
    n: int = 0
    classes: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    @property
    def rules(self) -> list[tuple[frozenset, float, float]]:
        """All rules written out for each token of their classes, for reports on few of them: by number of tokens, confidence, tokens."""
        found = self.table.select("tokens", "confidence", "support").collect() if self.n else []
        out = [(frozenset(each), r.confidence, r.support) for r in found for each in product(*(self.classes[t] for t in r.tokens))]
        return sorted(out, key=lambda r: (len(r[0]), -r[1], sorted(r[0])))

    def names(self) -> dict[str, str]:
        """The class of each frequent token."""
        return {t: name for name, tokens in self.classes.items() for t in tokens}


class RuleIndex:
    """Rules by their anchor, for URLs as lists of tokens."""

    def __init__(self, rules: list[Row], names: dict[str, str]):
        self.names, self.rules = names, [(r.tokens, r.confidence) for r in rules]
        index = defaultdict(list)
        for k, r in enumerate(rules):
            index[r.anchor].append(k)
        self.index = dict(index)

    def best(self, tokens: list[str]) -> tuple[float, list[str]] | None:
        """The surest rule that the tokens hold, as confidence and tokens (ties: fewer tokens, then the first); None if they hold none."""
        first: dict[str, str] = {}
        for t in tokens:
            name = self.names.get(t)
            if name is not None and (name not in first or t < first[name]):
                first[name] = t
        hit = [self.rules[k] for name in first for k in self.index.get(name, ()) if all(t in first for t in self.rules[k][0])]
        found = min(((-sure, len(own), sorted(first[t] for t in own)) for own, sure in hit), default=None)
        return None if found is None else (-found[0], found[2])


def mine(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id") -> MinedRules:
    """Mine rules from the labelled pages: those whose id has a row in labels.

    A page is unwanted if any of its label rows is toxic or not of quality; null labels don't
    count. Every labelled page is a transaction of all its tokens. Of frequent tokens that stand
    in the same labelled pages one is mined for all, so that tokens that always come together
    don't multiply combinations. A combination stands in MIN_SUPPORT of the pages and in MIN_COUNT
    pages at least, together with the label; all rules that are confident enough count, however
    many they are and whatever their length. A rule stays if it is surer than every rule on a part
    of its tokens. The rules stay a table; only the frequent tokens come to the driver, at most a
    page's tokens / support of them. Without labelled pages there are no rules; null ids and URLs
    don't count, repeated pages count each.
    """
    bad = labels.select(F.col(label_id_col).alias("id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")).filter("id is not null")
    bad = bad.groupBy("id").agg(F.max("bad").alias("bad"))
    known = pages.select(F.col(page_col).alias("id"), url_tokens(F.col(url_col)).alias("tokens")).join(bad, "id")
    items = known.select("id", F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(_UNWANTED)))).otherwise(F.col("tokens")).alias("items")).filter(F.size("items") > 0).persist()
    try:
        n = items.count()
        support = max(MIN_SUPPORT, MIN_COUNT / n) if n else 2
        if support > 1:
            return MinedRules()
        classes, rows = _classes(items, support * n)
        rest = [t for first, tokens in classes.items() for t in tokens if t != first]
        mined = items.select((F.array_except("items", F.array(*map(F.lit, rest))) if rest else F.col("items")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=MIN_CONFIDENCE).fit(mined)
        sets = model.freqItemsets.filter(F.array_contains("items", _UNWANTED)).select(F.array_sort(F.array_except("items", F.array(F.lit(_UNWANTED)))).alias("tokens")).filter(F.size("tokens") > 0)
        rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == _UNWANTED)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
        found = stored(sets.join(rules, "tokens", "left").withColumn("size", F.size("tokens")), "url-sets")
    finally:
        items.unpersist()
    kept = _surer(found)
    counted = F.create_map(*[F.lit(x) for name in classes for x in (name, rows[name])]) if classes else F.create_map().cast("map<string,int>")
    order = F.array_min(F.transform("tokens", lambda t: F.struct(counted[t].alias("n"), t.alias("t"))))
    table = stored(kept.select("tokens", "confidence", "support", order["t"].alias("anchor")), "url-rules")
    return MinedRules(table, table.count(), classes, rows)


def _surer(sets: DataFrame) -> DataFrame:
    """Of combinations (tokens, confidence: null where that isn't enough, support, size) the rules surer than every rule on a part of their tokens.

    By size: the surest rule on any part of a combination is that of the parts that lack one token,
    or on a part of these. All parts of a combination are there, as they are at least as frequent.
    """
    largest = sets.agg(F.max("size")).first()[0] or 0
    below, kept = None, None
    for size in range(1, largest + 1):
        here = sets.filter(F.col("size") == size).drop("size")
        if below is None:
            here = here.withColumn("best", F.lit(None).cast("double"))
        else:
            parts = here.select("tokens", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("gone")).select("tokens", F.expr("filter(tokens, (t, i) -> i <> gone)").alias("part"))
            best = parts.join(below.select(F.col("tokens").alias("part"), F.greatest("confidence", "best").alias("sure")), "part").groupBy("tokens").agg(F.max("sure").alias("best"))
            here = here.join(best, "tokens", "left")
        below = stored(here, "url-sets")
        own = below.filter(F.col("confidence").isNotNull() & (F.col("best").isNull() | (F.col("confidence") > F.col("best")))).drop("best")
        kept = own if kept is None else kept.unionByName(own)
    return kept if kept is not None else sets.filter(F.col("confidence").isNotNull()).drop("size")


def _classes(items: DataFrame, least: float) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Tokens of at least so many rows, by the first of those that stand in exactly the same rows (by the sum of the rows' hashes); and the number of rows of each."""
    rows = items.select(F.xxhash64("id", "items").cast("decimal(20,0)").alias("row"), F.explode("items").alias("token")).filter(F.col("token") != _UNWANTED)
    often = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).filter(F.col("n") >= least - 1e-6)
    same = often.groupBy("n", "rows").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select("n", "tokens").collect()
    return {r.tokens[0]: r.tokens for r in same}, {t: r.n for r in same for t in r.tokens}


def written_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int | None = None) -> Column:
    """The longest written rule that fits, as host and path in one (or its verdict if what is 2); null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):  # the last one added is asked first
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        chosen = F.when(fits, F.lit(rule[2] if what == 2 else rule[0] + rule[1])).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, mined: MinedRules, rules: list[tuple[str, str, str]] = RULES, page_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) for every page.

    rule is the longest written rule that fits (null if none does); verdict is its word, else
    "block" if a mined rule's tokens are all in the URL, else "allow". mined_rule (tokens
    joined by blanks) and confidence name the surest mined rule, null without one; of equally sure
    ones that with fewer tokens, then the first. A null URL or one without "://" has an empty host
    and path and is allowed; repeated rows stay; an empty table gives an empty result; other columns
    are ignored. Up to MAX_BROADCAST_RULES rules there is no shuffle; beyond, distinct URLs meet the
    table of rules by their anchors, with the same result.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(page_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens"))
    rows = rows.select("page_id", "host", "path", written_rule(F.col("host"), F.col("path"), rules).alias("rule"), written_rule(F.col("host"), F.col("path"), rules, 2).alias("verdict"), "tokens")
    kind = pages.schema[page_col].dataType.simpleString()
    if mined.n > MAX_BROADCAST_RULES:
        return _judged_by_join(rows, mined)
    index = RuleIndex(mined.table.collect() if mined.n else [], mined.names())
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            best = [known.best(t) for t in batch.column(5).to_pylist()]
            verdict = [v or ("block" if b is not None else "allow") for v, b in zip(batch.column(4).to_pylist(), best, strict=True)]
            named = [None if b is None else " ".join(b[1]) for b in best]
            sure = [None if b is None else b[0] for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(named, pa.string()), pa.array(sure, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, mined_rule string, confidence double")


def _judged_by_join(rows: DataFrame, mined: MinedRules) -> DataFrame:
    """judge() of rows (page_id, host, path, rule, verdict, tokens) where the rules are too many to send: lists of tokens, each once, look their rules up."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(mined.names().items()), "token string, name string")  # the frequent tokens
    lists = rows.select("tokens").distinct()
    held = lists.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(names), "token").groupBy("tokens", "name").agg(F.min("token").alias("token"))
    held = held.groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("name", "token"))).alias("first"))
    rules = mined.table.select("anchor", F.col("tokens").alias("own"), "confidence")
    hits = held.select("tokens", "first", F.explode(F.map_keys("first")).alias("anchor")).join(rules, "anchor").filter(F.size(F.array_except("own", F.map_keys("first"))) == 0)
    hits = hits.select("tokens", "confidence", F.array_sort(F.transform("own", lambda t: F.element_at("first", t))).alias("named"))
    best = hits.groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("unsure"), F.size("named").alias("n"), "named")).alias("best"))
    out = rows.join(best, "tokens", "left")
    verdict = F.coalesce("verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.array_join("best.named", " ").alias("mined_rule"), (-F.col("best.unsure")).alias("confidence"))
