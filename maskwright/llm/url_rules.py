"""URL filtering: fixed host and path rules first, then association rules mined by FP-growth from labelled pages.

A page is labelled through the document whose number its url ends in: bad if
that document is toxic or of low quality. Only DataFrame operations and the
JVM's FP-growth run here.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import stored

#: Fixed values: (host, path prefix, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """What is between :// and the next /, ? or #, A-Z in lower case; empty without ://, and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://, and for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    hits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array_compact(F.array(*hits)))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels by level, path segments by place (numbers as #), and whether it has a query, its keys and a fragment."""
    labels = F.reverse(F.split(host, r"\."))
    levels = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    segments = F.transform(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"\d+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.split(x, "=").getItem(0)))
    flags = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([^:]*)://", 1))), F.when(url.contains("#"), F.lit("fragment")))
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(levels, F.array()), F.coalesce(segments, F.array()), F.coalesce(keys, F.array()), flags)))


def transactions(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, items and the number at the path's end; null urls give empty host and path and no items of theirs."""
    url = F.col("url")
    p = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    hit = rule_verdict(F.col("host"), F.col("path"))
    p = p.withColumn("hit", hit).withColumn("items", F.when(url.isNull(), F.array().cast("array<string>")).otherwise(tokens(F.col("host"), F.col("path"), url)))
    return p.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"), "items", F.regexp_extract("path", r"(\d+)[^/\d]*/?$", 1).try_cast("long").alias("doc_id"))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.2, min_pages: int = 5) -> DataFrame:
    """(antecedent, confidence, lift, support) of the association rules `tokens -> bad`, pruned.

    Tokens of the same labelled pages, such as the segments of a shared folder, are mined as one, and a rule of such tokens then stands for one rule for each of them: the same rules as of all tokens, without all their subsets. The support is a share of all labelled pages, so at most 1 / min_support rules share no page and the number of rules doesn't grow with the input; where that share is less than min_pages pages, so many are asked for, as one page proves nothing of others. A rule goes if a more general one is at least as confident. Labels met twice count once for each page; none, or no page labelled, gives no rules.
    """
    seen = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    baskets = stored(pages.join(seen, "doc_id").select(F.monotonically_increasing_id().alias("basket"), F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    if baskets.filter(F.array_contains("items", BAD)).isEmpty():
        return pages.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, lift double, support double")
    n = baskets.count()
    min_support = min(1.0, max(min_support, min_pages / n))
    same = stored(_same_pages(baskets, min_support * n), "same-tokens")
    spare = same.agg(F.flatten(F.collect_list(F.slice("tokens", F.lit(2), F.size("tokens")))).alias("spare"))
    merged = baskets.crossJoin(spare).select(F.array_except("items", "spare").alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(merged).associationRules
    rules = rules.filter((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support")
    rules = stored(rules, "rules")
    general = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).select("item", F.col("antecedent").alias("less"), F.col("confidence").alias("sure"))
    beaten = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(general, "item").filter((F.size("less") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0)).select("antecedent").distinct()
    kept = rules.join(beaten, "antecedent", "left_anti").crossJoin(same.agg(F.map_from_entries(F.collect_list(F.struct(F.element_at("tokens", 1), "tokens"))).alias("same")))
    ways = F.aggregate("antecedent", F.array(F.array().cast("array<string>")), lambda ways, x: F.flatten(F.transform(ways, lambda w: F.transform(F.coalesce(F.try_element_at("same", x), F.array(x)), lambda y: F.concat(w, F.array(y))))))
    return stored(kept.select(F.explode(ways).alias("antecedent"), "confidence", "lift", "support").withColumn("antecedent", F.array_sort("antecedent")), "rules")


def _same_pages(baskets: DataFrame, least: float) -> DataFrame:
    """(tokens): each two or more tokens that exactly the same baskets have, at least `least` of these, sorted."""
    items = baskets.select("basket", F.explode("items").alias("item")).filter(F.col("item") != BAD)
    codes = [F.bit_xor(F.xxhash64("basket", F.lit(k))).alias(f"code{k}") for k in (0, 1)]
    return items.groupBy("item").agg(F.count("*").alias("n"), *codes).filter(F.col("n") >= least).groupBy("n", "code0", "code1").agg(F.array_sort(F.collect_list("item")).alias("tokens")).filter(F.size("tokens") > 1).select("tokens")


def judge_pages(pages: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: a fixed rule decides where one fits, else a page is blocked if a mined rule matches.

    The rules' inverted index posts a rule under the rarest of its tokens; a page's tokens look it up, and the rule's other tokens are then tested. Repeated rows keep their own rows; null urls are allowed unless a rule says otherwise.
    """
    t = transactions(pages)
    rules = mine_rules(t, labels, **limits)
    often = t.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    wanted = rules.select(F.explode("antecedent").alias("item")).distinct()
    often = often.join(wanted, "item")
    index = rules.select("antecedent", F.explode("antecedent").alias("item")).join(often, "item").groupBy("antecedent").agg(F.min(F.struct("n", "item")).alias("key")).groupBy(F.col("key.item").alias("item")).agg(F.collect_list("antecedent").alias("rules"))
    index = stored(index, "rule-index")
    # a few rules: each distinct set of tokens is judged once
    sets = t.filter("rule is null").select(F.array_sort("items").alias("items")).distinct()
    matched = sets.select("items", F.explode("items").alias("item")).join(index, "item").filter(F.exists("rules", lambda r: F.size(F.array_except(r, F.col("items"))) == 0)).select("items").distinct().withColumn("matched", F.lit(True)).withColumn("same", F.array_sort("items")).select(F.xxhash64("items").alias("code"), "same", "matched")
    rows = t.select("page_id", "host", "path", "rule", "ruled", F.array_sort("items").alias("same")).withColumn("code", F.xxhash64("same"))
    rows = rows.join(matched, ["code", "same"], "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("matched"), "block").otherwise("allow")).alias("verdict"))
