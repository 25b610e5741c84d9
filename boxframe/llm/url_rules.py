"""URL filtering by given host rules and mined association rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import LOWER, UPPER, checkpointed

#: The item that stands for a bad label in the mined baskets.
BAD = "@bad"
#: Words in a host's name that make it bad, for training, where no given rule says anything: no table labels URLs.
SEED_WORDS = ("spam", "casino", "adult", "pills", "bets", "ads")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    Rules are ("block" or "allow", host and path start, like ``com/en/``); a
    rule fits its host and all subdomains. ``rules`` is a short given list;
    of equal length, the first wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct marked tokens of a URL: host parts and their words, top domain, first and other path parts, query keys, scheme.

    Numbers in a path are one token, since each by itself says little; what
    they begin with is another.
    """
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    marked = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    words = F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.split(x, "-")).otherwise(F.expr("cast(array() as array<string>)"))))
    pieces = F.split(p, "/")
    plain = lambda x: F.regexp_replace(x, r"[0-9]+", "#")
    query = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    found = F.concat(
        marked("host:", F.filter(labels, lambda x, i: i < F.size(labels) - 1)),
        marked("word:", words),
        marked("top:", F.slice(labels, -1, 1)),
        marked("first:", F.transform(F.slice(pieces, 2, 1), plain)),
        marked("path:", F.transform(F.slice(pieces, F.lit(3), F.greatest(F.size(pieces) - 2, F.lit(0))), plain)),
        marked("digit:", F.transform(pieces, lambda x: F.regexp_extract(x, "^[0-9]", 0))),
        marked("query:", query),
        marked("scheme:", F.array(scheme)),
    )
    return F.array_distinct(F.coalesce(found, F.expr("cast(array() as array<string>)")))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.95, min_rows: int = 5) -> DataFrame:
    """(antecedent, confidence, support) of rules "these tokens, so bad" from ``labelled`` (url, bad boolean).

    Spark's FP-growth counts token sets over all rows. Kept are sets with at
    least the given share of the rows (and ``min_rows`` rows) together with a
    bad label, of which at least ``min_confidence`` are bad; a rule that holds
    a shorter one is pruned, so what is left is small however many rows there
    are. Empty if no row is bad.
    """
    baskets = labelled.filter("url is not null").select(F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.expr("cast(array() as array<string>)"))).alias("items"))
    baskets = checkpointed(baskets)
    n = baskets.count()
    none = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    if not n or not baskets.filter(F.array_contains("items", BAD)).limit(1).count():
        return none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), minConfidence=min_confidence).fit(baskets)
    rules = checkpointed(model.associationRules.filter(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # A shorter rule's tokens are all in a longer one's: they meet on the shorter one's first token.
    short = rules.select(F.col("antecedent").alias("part"), F.col("antecedent")[0].alias("first"))
    longer = rules.select("antecedent", F.explode("antecedent").alias("first"))
    held = longer.join(short, "first").filter((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)).select("antecedent").distinct()
    return rules.join(held, "antecedent", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, antecedent, confidence): for each distinct URL that any rule fits, the most confident rule.

    The inverted index files each rule under its rarest token, by how many
    rules hold it and then by name; a URL looks up its own tokens and checks
    the rest of each rule found.
    """
    held = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    common = held.groupBy("token").agg(F.count("*").alias("rules"))
    index = held.join(common, "token").groupBy("antecedent", "confidence").agg(F.min(F.struct("rules", "token")).alias("m")).select("antecedent", "confidence", F.col("m.token").alias("token"))
    own = urls.filter("url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    looked = own.withColumn("token", F.explode("tokens")).join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = looked.groupBy("url").agg(F.max(F.struct("confidence", "antecedent")).alias("m"))
    return best.select("url", F.col("m.antecedent").alias("antecedent"), F.col("m.confidence").alias("confidence"))


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame, url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.95) -> DataFrame:
    """``df`` with host, path, rule, verdict, and the mined rule's antecedent and confidence.

    The longest given rule that fits decides; else a URL that a mined rule
    fits is blocked and any other allowed. Mined rules are matched once for
    each distinct URL and joined back, so a URL of very many rows costs one
    match.

    Defined cases: null URLs and those without ``://`` have empty host and
    path, no given rule, and are allowed unless a mined rule fits; an empty
    table gives an empty result; without bad labels nothing is mined; columns
    named like those added are replaced.
    """
    added = ("host", "path", "rule", "verdict", "antecedent", "confidence")
    kept = [c for c in df.columns if c not in added]
    url = F.col(url_col)
    rule, verdict = host_rule(host(url), path(url), rules)
    mined = matches(df.filter(verdict.isNull()).select(url.alias("url")), mine(labelled, min_support, min_confidence))
    mined = mined.select(F.col("url").alias("__url"), F.col("antecedent").alias("__antecedent"), F.col("confidence").alias("__confidence"))
    judged = df.select(*kept, host(url).alias("__host"), path(url).alias("__path"), rule.alias("__rule"), verdict.alias("__verdict"))
    judged = judged.join(mined, (url == F.col("__url")) & F.col("__verdict").isNull(), "left")
    verdict = F.coalesce("__verdict", F.when(F.col("__antecedent").isNotNull(), "block").otherwise("allow"))
    return judged.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__antecedent").alias("antecedent"), F.col("__confidence").alias("confidence"))


def seed_labels(df: DataFrame, url_col: str = "url", words: Sequence[str] = SEED_WORDS) -> DataFrame:
    """(url, bad): a URL is bad if a part of its host, or a word of one, is among ``words``."""
    found = F.split(host(F.col(url_col)), r"[.\-]")
    return df.select(F.col(url_col).alias("url"), F.coalesce(F.arrays_overlap(found, F.array(*map(F.lit, words))), F.lit(False)).alias("bad"))


def rule_labels(df: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", words: Sequence[str] = SEED_WORDS) -> DataFrame:
    """(url, bad): a URL is bad by ``seed_labels``, or where the given rule that fits blocks.

    Rules are given by host and path start, tokens are parts of both, so what
    is mined from the rules are combinations of tokens.
    """
    url = F.col("url")
    _, verdict = host_rule(host(url), path(url), rules)
    return seed_labels(df, url_col, words).select("url", (F.col("bad") | F.coalesce(verdict == "block", F.lit(False))).alias("bad"))
