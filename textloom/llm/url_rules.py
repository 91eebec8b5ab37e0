"""URL filter by association rules (operator 12).

Labelled URLs become sets of tokens with the label as one more item. FP-growth
finds the combinations that occur often enough; rules that lead from tokens to
the label `block` stay if they are confident enough and no shorter rule is as
confident. A rule is posted under its rarest token only, so a URL meets few
rules, each of which is then compared as a set. Listed host rules go first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, free_name, staged

BLOCK, ALLOW = "block", "allow"
RULES = "tokens array<string>, confidence double, support double"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest of some `host/path` rules that fits, or null: its host or a subdomain of it, and a path that starts with the rule's. Of equally long ones the first counts."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last that fits is outermost
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """The distinct words of a URL in order, those of the host as `h:word`, later ones as `p:word`; numbers count as 0. Empty for a null."""

    def words(text: Column, kind: str) -> Column:
        found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.transform(found, lambda w: F.concat(F.lit(kind), F.when(F.regexp_like(w, F.lit("^[0-9]+$")), "0").otherwise(w)))

    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(words(host_of(url), "h:"), words(rest, "p:"))))


def mine(labelled: DataFrame, scratch: Scratch, min_support: float = 0.01, min_count: int = 10, min_confidence: float = 0.5, max_share: float = 0.9) -> DataFrame:
    """Rules (tokens, confidence, support) that lead to `block`, from rows of `tokens, bad`.

    A combination must occur, together with `block`, in `min_support` of all
    labelled URLs and in `min_count` of them. Tokens that more than `max_share`
    of them hold tell nothing apart and are left out. A rule goes if a rule
    with some of its tokens is at least as confident.
    """
    spark = labelled.sparkSession
    rows = scratch.staged(labelled, "labelled-urls")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RULES)
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    common = [r["token"] for r in counts.where(F.col("count") > max_share * n).collect()]  # fewer than tokens a URL has on average / max_share
    kept = F.array_except("tokens", F.array(*map(F.lit, common)).cast("array<string>"))
    items = rows.select(F.when(F.col("bad"), F.concat(kept, F.array(F.lit("label:" + BLOCK)))).otherwise(kept).alias("items"))
    share = min(1.0, max(min_support, min_count / n))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit("label:" + BLOCK)))
    rules = scratch.staged(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    postings = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("_of"), F.col("confidence").alias("_confidence"))
    own = rules.select(F.explode("tokens").alias("token"), "tokens", "confidence").join(postings, "token")
    shorter = own.where("size(_of) < size(tokens) AND _confidence >= confidence").groupBy("tokens", "_of").agg(F.count("*").alias("n")).where("n = size(_of)")
    return scratch.staged(rules.join(shorter.select("tokens").distinct(), "tokens", "left_anti"), "kept-rules")


def matches(sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """The best rule of each token set (key, tokens) that one fits: the most confident, then the best supported, then the shortest, then the first.

    `counts` (token, count) tells which token of a rule is the rarest.
    """
    rarest = Window.partitionBy("tokens").orderBy(F.coalesce("count", F.lit(0)), "token")
    index = rules.withColumn("token", F.explode("tokens")).join(counts, "token", "left").withColumn("_i", F.row_number().over(rarest)).where("_i = 1")
    index = index.select("token", F.col("tokens").alias("_rule"), "confidence", "support")
    met = sets.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("_rule", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("_rule").alias("n"), F.col("_rule").alias("pattern")))
    return met.groupBy("key").agg(best.alias("b")).select("key", "b.pattern", (-F.col("b.c")).alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], url: str = "url", page_id: str = "page_id", **mining) -> DataFrame:
    """Each page with host, path, the listed rule that decides, and a verdict.

    `labels` (id, bad) says of some pages whether they should go; a page with
    several labels is bad if one of them says so, and a null tells nothing.
    Where no listed rule fits, a page is blocked if a mined rule does and else
    allowed; `pattern` and `confidence` are that rule's. A null url, or one
    without `://`, has an empty host and path and no tokens. Pages of equal
    tokens are judged once, and only (key, url) travels; very long urls are
    taken whole. Repeated rows give a row each; other columns are kept, and a
    result whose name is taken gets underscores before it. An empty table has
    no rows, and without labels nothing is mined.
    """
    names = pages.columns
    inner = [f"c{i}" for i in range(len(names))]
    own = dict(zip(names, inner, strict=True))
    rows = pages.toDF(*inner)
    host, path = host_of(F.col(own[url])), path_of(F.col(own[url]))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    said = labels.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    with Scratch(pages.sparkSession) as scratch:
        known = rows.select(F.col(own[page_id]).cast("long").alias("id"), tokens_of(F.col(own[url])).alias("tokens")).join(said, "id").select("tokens", "bad")
        mined = mine(known, scratch, **mining)
        keyed = rows.withColumn("key", F.when(F.col("listed").isNull(), F.sha2(F.array_join(tokens_of(F.col(own[url])), " "), 256)))
        open_rows = keyed.where("key IS NOT NULL")
        sets = open_rows.groupBy("key").agg(F.first(tokens_of(F.col(own[url]))).alias("tokens"))  # equal keys have equal tokens
        sets = scratch.staged(sets, "token-sets")
        counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count()
        hits = scratch.staged(matches(sets, mined, counts), "hits")
        found = open_rows.join(hits, "key", "left").unionByName(keyed.where("key IS NULL"), allowMissingColumns=True)
        verdict = F.when(F.col("listed").isNotNull(), F.col("listed.verdict")).when(F.col("pattern").isNotNull(), BLOCK).otherwise(ALLOW)
        made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("listed.rule"), "verdict": verdict, "pattern": F.array_join("pattern", " "), "confidence": F.col("confidence")}
        out = found.select(*inner, *(c.alias("_" + k) for k, c in made.items()))
        return staged(out, "judged").toDF(*names, *(free_name(k, names) for k in made))
