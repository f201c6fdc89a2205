"""URL filtering: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the rules indexed under them by a hash join; only those rules' regular expressions
run, and those of rules without a token on every URL.  Everything is Spark SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A list of at most this many rules is broadcast; a longer one is joined by a shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs whose ``host + path`` matches ``regex``; ``tokens`` are whole tokens of any match.

    ``rank`` orders matching rules (the greatest wins, then the earlier one); ``fallback`` rules decide
    only where no other rule matches.
    """

    verdict: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    fallback: bool = False


def host_rule(verdict: str, name: str) -> Rule:
    """A rule such as ``example.com/en/``: the host and its subdomains, and paths starting so."""
    host, slash, path = name.partition("/")
    whole = re.findall(r"[A-Za-z0-9]+(?![A-Za-z0-9]|$)", name) if not name.endswith("/") else re.findall(r"[A-Za-z0-9]+", name)
    return Rule(verdict, name, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole), len(name))


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for hosts or paths that have ``word`` as a whole token; it only decides by default."""
    return Rule(verdict, f"*{word}*", rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", (word,), 0, True)


HOST_RULES = [
    host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"), host_rule("block", "net/fr/"),
]
#: The method's own rules, for URLs without another one.
WORDS = ["casino", "porn", "torrent", "viagra", "xxx"]
DEFAULT_RULES = [*HOST_RULES, *(word_rule("block", w) for w in WORDS)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty if the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge_urls(pages: DataFrame, rules: list[Rule] = DEFAULT_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    The winning rule's verdict holds; where none matches, a fallback rule's, else ``default``.  ``rule``
    is null unless a rule that is no fallback matched.  Null ids and repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("key", F.concat("host", "path")).where("key <> ''").select("page_id", "key").distinct()
    tokens = keyed.select("page_id", "key", F.explode(F.array_distinct(F.split("key", "[^A-Za-z0-9]+"))).alias("token"))
    table = spark.createDataFrame(
        [(n, r.verdict, r.name, r.regex, list(r.tokens), r.rank, r.fallback) for n, r in enumerate(rules)],
        "no int, verdict string, name string, regex string, literals array<string>, rank int, fallback boolean",
    )
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    literals = table.select("no", F.explode("literals").alias("token"))
    seen = tokens.join(small(literals.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = literals.join(seen, "token", "left").groupBy("no").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")
    )
    index = table.drop("literals").join(rarest, "no")
    fits = tokens.join(small(index), "token").where("key rlike regex").drop("token")
    if any(not r.tokens for r in rules):  # they have no token to be found by: every key is tried
        fits = fits.unionByName(keyed.join(small(table.where("size(literals) = 0").drop("literals")), F.expr("key rlike regex")))
    won = fits.groupBy("page_id", "key").agg(
        F.max_by(F.when(~F.col("fallback"), F.struct("name", "verdict")), F.when(~F.col("fallback"), F.struct("rank", -F.col("no")))).alias("own"),
        F.max_by(F.when(F.col("fallback"), F.col("verdict")), F.when(F.col("fallback"), -F.col("no"))).alias("other"),
    )
    return (
        urls.withColumn("key", F.concat("host", "path")).alias("u")
        .join(won.alias("w"), F.col("u.page_id").eqNullSafe(F.col("w.page_id")) & (F.col("u.key") == F.col("w.key")), "left")
        .select("u.page_id", "u.host", "u.path", F.col("own.name").alias("rule"), F.coalesce("own.verdict", "other", F.lit(default)).alias("verdict"))
    )
