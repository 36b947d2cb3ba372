"""URL filters: curated host and path rules first, then association rules mined by FP-growth.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there to ?, # or the end; a null url or
one without :// has both empty. A curated rule (host, path, action) fits its host and all subdomains if the path starts
with the rule's; the longest wins. Other urls are judged by mined rules {tokens} -> verdict, found in the token sets of
labelled urls: the most confident one that fits decides, ties by verdict and then tokens; without any, the url is
allowed.

Mining is FP-growth's pattern growth on weighted distinct transactions: patterns grow by one token at a time, rarest
tokens first, over their conditional bases. A pattern goes on only if some verdict has the support, no token of it
follows from its others (then a shorter pattern holds the same urls) and its urls don't all have one verdict (then no
longer one is more confident). That loses no rule and bounds what one common url of many tokens brings forth, where
plain FP-growth makes all subsets of it. Rules are pruned by support, confidence, confidence above the verdict's share,
and shorter rules at least as confident. They are mined on seven tenths of the labelled urls, by hash, and stay if on the
other three they reach the confidence and are significant: the lower bound of their confidence (Wilson's, one-sided, at
ALPHA over the number of mined rules) lies above the verdict's share. So labels that have nothing to do with the urls bring
no rule, but in one case in 1 / ALPHA.

Curated rules are looked up by host suffix and mined ones by their rarest token, so each url meets few of them. All
work is done once for each distinct url, however long. Labels: null ids and verdicts are ignored, repeated ones each
count. Repeated rows get equal results; no labels, too few of them or an empty table: no mined rules.

To the driver come one row a verdict and the frequent tokens, at most tokens a url / support of them.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import BROADCAST_IDS, drop, materialize

SUPPORT, CONFIDENCE, LIFT, ALPHA = 0.005, 0.6, 1.0, 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host and path."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url_col, pattern, 1), F.lit(""))
    return urls.withColumns({"host": F.translate(part("://([^/?#]*)"), UPPER, LOWER), "path": part("://[^/?#]*([^?#]*)")})


def tokens() -> Column:
    """The token set of a url with host and path: scheme, host labels, top level, path segments, file type, query names."""
    host = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host:"), x))
    top = F.array(F.concat(F.lit("top:"), F.substring_index("host", ".", -1)))
    segment = F.filter(F.split("path", "/"), lambda x: x != "")
    segment = F.transform(segment, lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", ""), "[0-9]+", "0")))
    kind = F.array(F.concat(F.lit("type:"), F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)))
    query = F.transform(F.regexp_extract_all("url", F.lit("[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.substring_index("url", "://", 1)))
    return F.array_distinct(F.concat(scheme, host, top, segment, kind, query))


def curated(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(url, rule, action) of the longest rule that fits, for urls that have one."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, a, h + p) for h, p, a in rules], "suffix string, prefix string, action string, rule string")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    hits = urls.select("url", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix").where("startswith(path, prefix)")
    return hits.groupBy("url").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule")).alias("r")).select("url", "r.rule", "r.action")


RULES = "rule_id long, items array<string>, verdict string, confidence double, support double, key string"


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(rule_id, items, verdict, confidence, support, key) from rows (items, verdict); key is the rarest item."""
    spark = labelled.sparkSession
    rows = materialize(labelled.where("verdict is not null").groupBy(F.array_sort(F.array_distinct("items")).alias("items"), "verdict").count(), "labelled")
    shares = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.sum("count").alias("n")).collect()}
    verdicts, total = sorted(shares), sum(shares.values())
    least, cs = support * total, [f"c{i}" for i in range(len(verdicts))]
    if not total:
        return spark.createDataFrame([], RULES)
    add = [F.sum(c).alias(c) for c in cs]
    all_, most = reduce(Column.__add__, map(F.col, cs)), F.greatest(*cs, F.lit(0))
    sets = rows.groupBy("items").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("count")).otherwise(0)).alias(c) for v, c in zip(verdicts, cs)))
    sets = materialize(sets.withColumn("tid", F.monotonically_increasing_id()), "transactions")
    tokens = sets.select(F.explode("items").alias("item"), *cs).groupBy("item").agg(*add).where(most >= least).select("item", all_.alias("n")).collect()
    names = [r["item"] for r in sorted(tokens, key=lambda r: (r["n"], r["item"]))]
    ranks = F.broadcast(spark.createDataFrame(list(enumerate(names)), "rank int, item string"))
    base = sets.select("tid", F.explode("items").alias("item"), *cs).join(ranks, "item").groupBy("tid", *cs).agg(F.sort_array(F.collect_list("rank")).alias("tail"))
    base = materialize(base.groupBy("tail").agg(*add).withColumn("pattern", F.array().cast("array<int>")), "base")
    best = [f"b{i}" for i in range(len(cs))]
    grown = spark.createDataFrame([([], total, *(shares[v] / total for v in verdicts))], ", ".join(["sub array<int>", "held long", *(f"{b} double" for b in best)]))
    found, spent, size = [], [rows, sets], 0
    while True:
        size += 1
        longer = base.select(*cs, F.col("pattern").alias("p"), "tail", F.posexplode("tail").alias("at", "x"))
        longer = longer.select(F.concat("p", F.array("x")).alias("pattern"), F.slice("tail", F.col("at") + 2, F.size("tail")).alias("tail"), *cs)
        counted = materialize(longer.groupBy("pattern").agg(*add).where(most >= least), "counted")
        parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("without")).withColumn("sub", F.expr("filter(pattern, (x, i) -> i <> without)"))
        whole = parts.join(grown, "sub").groupBy("pattern", *cs).agg(F.count("*").alias("subs"), F.min("held").alias("least_held"), *(F.max(b).alias(b) for b in best))
        whole = whole.withColumn("held", all_).where((F.col("subs") == size) & (F.col("held") < F.col("least_held")))
        whole = materialize(whole.select("pattern", "held", *cs, *best), "patterns")
        spent += [counted, whole]
        for v, c, b in zip(verdicts, cs, best):
            sure = F.col(c) / F.col("held")
            found.append(whole.where((F.col(c) >= least) & (sure >= confidence) & (sure >= lift * shares[v] / total) & (sure > F.col(b))).select("pattern", F.lit(v).alias("verdict"), sure.alias("confidence"), (F.col(c) / total).alias("support")))
        open_ = whole.where(most < F.col("held"))
        n = open_.count()
        if not n:
            break
        grown = open_.select(F.col("pattern").alias("sub"), "held", *(F.greatest(b, F.col(c) / F.col("held")).alias(b) for b, c in zip(best, cs)))
        going = open_.select("pattern")
        old, base = base, longer.where(F.size("tail") > 0).join(F.broadcast(going) if n <= BROADCAST_IDS else going, "pattern", "left_semi").groupBy("pattern", "tail").agg(*add)
        base = materialize(base, "base")
        drop(old)
    rules = reduce(DataFrame.union, found)
    named = F.transform("pattern", lambda i: F.element_at(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), i + 1))
    rules = rules.select(F.array_sort(named).alias("items"), "verdict", "confidence", "support", F.element_at(named, 1).alias("key"))
    rules = materialize(rules.select(F.xxhash64("items", "verdict").alias("rule_id"), "items", "verdict", "confidence", "support", "key"), "mined")
    drop(base, *spent)
    return rules


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of urls (with items) by each rule that fits them, with r, the rule."""
    r = rules.select("key", F.struct("confidence", "verdict", F.array_join("items", " ").alias("text"), "rule_id").alias("r"), F.col("items").alias("need"))
    return urls.withColumn("key", F.explode("items")).join(r, "key").where(F.size(F.array_except("need", "items")) == 0).drop("key", "need")


def lower_bound(right: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share of which `right` of n trials are seen."""
    p = right / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def confirmed(rules: DataFrame, apart: DataFrame, confidence: float, alpha: float = ALPHA) -> DataFrame:
    """The rules that reach the confidence, and significantly more than their verdict's share, on rows (items, verdict) they
    weren't mined from."""
    z = NormalDist().inv_cdf(1 - alpha / max(2, rules.count()))
    apart = materialize(apart.where("verdict is not null").groupBy("items", F.col("verdict").alias("truth")).count(), "apart")
    counts = {r["truth"]: r["n"] for r in apart.groupBy("truth").agg(F.sum("count").alias("n")).collect()}
    share = F.broadcast(apart.sparkSession.createDataFrame([(v, n / sum(counts.values())) for v, n in counts.items()], "verdict string, share double"))
    seen = fitting(apart, rules).groupBy("r.rule_id", "r.verdict").agg(F.sum(F.when(F.col("truth") == F.col("r.verdict"), F.col("count")).otherwise(0)).alias("right"), F.sum("count").alias("n"))
    sure = (F.col("right") / F.col("n") >= confidence) & (lower_bound(F.col("right"), F.col("n"), z) > F.col("share"))
    good = seen.join(share, "verdict").where(sure).select("rule_id")
    return materialize(rules.join(good, "rule_id", "left_semi"), "confirmed")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", **bounds) -> DataFrame:
    """id, host, path, rule (null without one), verdict and mined_rule: one row per row of pages.

    labels: (id, verdict) for some pages; the urls of these train the miner.
    """
    urls = materialize(parsed(pages.select(F.col(url_col).alias("url")).where("url is not null").distinct()).withColumn("items", tokens()), "urls")
    truth = labels.join(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "id").join(urls, "url").select("url", "items", "verdict")
    truth = materialize(truth.select("items", "verdict", (F.pmod(F.xxhash64("url"), F.lit(10)) < 7).alias("fit")), "truth")
    mined = confirmed(mine(truth.where("fit"), **bounds), truth.where("not fit"), bounds.get("confidence", CONFIDENCE))
    hits = fitting(urls.select("url", "items"), mined).groupBy("url").agg(F.max("r").alias("m"))
    listed = curated(urls, rules)
    done = urls.select("url", "host", "path").join(listed, "url", "left").join(hits, "url", "left")
    done = done.select("url", "host", "path", "rule", F.coalesce("action", "m.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("m.text")).alias("mined_rule"))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).join(done, "url", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "mined_rule")
