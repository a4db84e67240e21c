"""URL filtering by mined association rules, below a short list of fixed rules.

Spark's FP-growth mines combinations of URL tokens from labelled pages. Rules whose consequent is "bad" and that
pass the support and confidence bounds are kept, indexed by one of their tokens, and matched by an equi-join of the
page's tokens with that index. Everything is DataFrame work.

Defined results: a null url or one without "://" has an empty host and path, no token but its scheme mark, and the
verdict of the mined rules on no tokens: allow. Repeated pages get a row each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.common import written

BAD = "y:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class FixedRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
FIXED_RULES = (
    FixedRule("block", "com", "/en/"),
    FixedRule("allow", "example.com", "/en/7"),
    FixedRule("allow", "net", "/de/"),
    FixedRule("block", "example.net", "/de/8"),
    FixedRule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host, host labels, path words (digits as one token) and query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("u:"), F.coalesce(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit(""))))
    return F.array_distinct(F.concat(scheme, F.array(F.concat(F.lit("h:"), host)), F.transform(labels, lambda x: F.concat(F.lit("l:"), x)), words, keys))


def fixed_rule(host: Column, path: Column, rules: tuple[FixedRule, ...] = FIXED_RULES) -> Column:
    """The longest fixed rule that fits, as struct(name, verdict); null if none does."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def token_classes(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(labelled (tokens, bad) as (items, bad), classes (item, members)): of tokens that are in the same rows one stands for all; those in fewer than `least` bad rows, or in all rows, go.

    Two sets of rows count as the same if their sizes and two sums of 64-bit
    hashes of their rows agree.
    """
    rows = written(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    mark = lambda salt: F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)"))
    tokens = rows.select("row", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    sets = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("one"), mark(2).alias("two"), F.count_if("bad").alias("n_bad")).where((F.col("n_bad") >= least) & (F.col("n") < n))
    classes = written(sets.groupBy("n", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.element_at("members", 1).alias("item"), "members"))
    items = tokens.join(classes.select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    return rows.join(items, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad"), classes


def with_members(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Each rule once for every choice of a member for each of its items."""
    named = rules.withColumn("rule", F.monotonically_increasing_id())
    members = named.select("rule", F.posexplode("antecedent").alias("at", "item")).join(classes, "item").groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("at", "members"))).alias("m"))
    start = F.array(F.array().cast("array<string>"))
    chosen = F.aggregate("m", start, lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(x["members"], lambda t: F.array_append(a, t)))))
    return named.join(members, "rule").select(F.explode(chosen).alias("antecedent"), "confidence", "support", "lift").withColumn("antecedent", F.array_sort("antecedent"))


def short_rules(baskets: DataFrame, n: int, least: int) -> DataFrame:
    """(antecedent, n_all, n_bad) of single items and of pairs."""
    ordered = baskets.select(F.array_sort("items").alias("items"), "bad")
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.array(x, y))))
    sets = F.concat(F.transform("items", lambda x: F.array(x)), pairs)
    return ordered.select(F.explode(sets).alias("antecedent"), "bad").groupBy("antecedent").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("bad").alias("n_bad")).where(F.col("n_bad") >= least)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, min_count: int = 10, min_lift: float = 1.2, widest: int | None = None) -> DataFrame:
    """Rules (antecedent, confidence, support, lift) from rows (tokens array<string>, bad boolean); a rule that a more general one covers is pruned.

    Lift is a rule's confidence over the share of bad rows: where nearly all is bad, a combination as bad as the rest tells nothing.

    A combination has to be in the share min_support of the rows, as bad ones, and in min_count rows. Before mining, tokens that are in the same rows become one item, so that a
    long shared path is one, and those of all rows, whose lift is 1, go; a rule then holds for each token that an item stands for. min_lift is above 1. Items that are a rule
    alone cover all that holds them and are not mined further. FP-growth then lists all frequent combinations of the rest, of any length, whatever the widest row has. Only a caller
    that names `widest` has antecedents of up to two items counted instead, where a row keeps more items than that.
    """
    n = labelled.count()
    none = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double, lift double")
    if not n:
        return none
    least = max(min_count, math.ceil(min_support * n - 1e-9))
    baskets, classes = token_classes(labelled, least)
    baskets = written(baskets)
    seen = baskets.agg(F.max(F.size("items")).alias("widest"), F.count_if("bad").alias("bad")).head()
    if least > n or not seen["bad"] or not seen["widest"]:
        return none
    share = F.col("n_bad") / F.col("n_all")
    measures = share.alias("confidence"), (F.col("n_bad") / n).alias("support"), (share / (seen["bad"] / n)).alias("lift")
    strong = (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)
    single = baskets.select(F.explode("items").alias("item"), "bad").groupBy("item").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("bad").alias("n_bad"))
    alone = written(single.select(F.array("item").alias("antecedent"), *measures).where(strong))
    known = alone.agg(F.collect_list(F.element_at("antecedent", 1)).alias("known"))
    rest = written(baskets.crossJoin(F.broadcast(known)).select(F.array_except("items", "known").alias("items"), "bad"))
    if widest is not None and seen["widest"] > widest:
        found = short_rules(rest, n, least).select("antecedent", *measures).where(strong)
    else:
        items = rest.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items)
        found = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support", "lift")
    rules = written(alone.unionByName(found))
    general = rules.select(F.col("antecedent").alias("wider"))
    covered = (F.size("wider") < F.size("antecedent")) & (F.size(F.array_except("wider", "antecedent")) == 0)
    # every wider rule holds the first token of its own antecedent
    keyed = rules.withColumn("key", F.explode("antecedent")).join(general.withColumn("key", F.element_at("wider", 1)), "key").where(covered)
    return with_members(written(rules.join(keyed.select("antecedent").distinct(), "antecedent", "left_anti")), classes)


def matching_pages(pages: DataFrame, rules: DataFrame, key: str = "k") -> DataFrame:
    """Keys of pages (key, tokens) that hold all tokens of some rule, through an index from a rule's first token."""
    index = rules.select(F.element_at("antecedent", 1).alias("token"), "antecedent")
    posted = pages.select(key, "tokens", F.explode("tokens").alias("token"))
    hit = posted.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.select(key).distinct()


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.7, min_count: int = 10, min_lift: float = 1.2) -> DataFrame:
    """One row per page: id, host, path, fixed rule or null, verdict.

    A page is labelled through the number in its path, which is the document that it shows (its html holds that
    document's beginning); it is bad if that document's quality is 0. With no labelled page, no rule is mined and the fixed rules alone block.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    base = base.withColumn("tokens", url_tokens(F.col("_url"), F.col("host"), F.col("path"))).withColumn("k", F.struct(F.col(id_col).alias("id"), F.xxhash64("_url").alias("h")))
    shown = base.select("tokens", F.try_to_number(F.nullif(F.regexp_extract("path", r"/([0-9]{1,18})(?![0-9])", 1), F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rules = mine_rules(shown.join(known, "doc_id").select("tokens", (F.col("quality") == 0).alias("bad")), min_support, min_confidence, min_count, min_lift)
    blocked = matching_pages(base, rules).withColumn("mined", F.lit(True))
    fixed = fixed_rule(F.col("host"), F.col("path"))
    return (
        base.join(blocked, "k", "left")
        .withColumn("fixed", fixed)
        .select(
            F.col(id_col),
            "host",
            "path",
            F.col("fixed.name").alias("rule"),
            F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"),
            F.coalesce("mined", F.lit(False)).alias("mined_rule"),
        )
    )
