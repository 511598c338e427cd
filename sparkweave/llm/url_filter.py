"""URL filter: allow and block rules, then exact membership of a host list through a Bloom filter cascade.

The cascade follows the certificate-revocation construction: level 1 encodes the listed keys, level 2 those keys
of the complete universe that level 1 passes wrongly, level 3 the listed keys that level 2 passes, and so on until
nothing passes wrongly. As every key that can be asked is in the universe, the answer is exact. The first level's
size follows the ratio of listed to other keys, the further ones take 6 bits a key. A level is one row of a small
table that the plan reads by a scalar subquery, so that a page is judged by a projection, without a join, at any size
of the list.

Rules: a rule is host + path; it fits its host and all subdomains of it if the url's path starts with the rule's
path; the longest rule that fits wins. Everything is built-in SQL functions.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
cascade as any other key. Repeated rows are judged alike, each on its own. An empty table gives an empty result,
an empty list an empty cascade that lists nothing. Extra columns of the input are not carried, so they can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm import bloom
from sparkweave.llm.common import lower_ascii, stage_table

#: (verdict, rule) of the production list.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[bloom.Bloom, ...] = field(default=())

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe from which the cascade was built."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels, 1))):
            out = F.when(level.passes(key), out).otherwise(F.lit(i % 2 == 0))
        return out


def build_cascade(universe: DataFrame) -> Cascade:
    """universe: (key, listed), each key once."""
    levels: list[bloom.Bloom] = []
    sides = {True: universe.filter("listed").select("key"), False: universe.filter("NOT listed").select("key")}
    left = {side: keys.count() for side, keys in sides.items()}
    side, rate = True, min(0.5, max(1e-4, 0.7 * left[True] / max(1, left[False])))
    for seed in range(1, MAX_LEVELS + 1):
        if left[side] == 0:
            return Cascade(tuple(levels))
        levels.append(bloom.build(sides[side], bloom.bits_for(left[side], rate), seed))
        sides[not side] = sides[not side].filter(levels[-1].passes(F.col("key")))
        side, rate = not side, bloom.RATE
        left[side] = sides[side].count()
    raise ValueError("the cascade doesn't converge: the universe holds a key on both sides")


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, listed, verdict) of every row of pages. listed: hosts to block, in column ``host``.

    The universe is every host of pages; hosts of the list that no page has can't be asked and are left out.
    """
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = parts.select(F.col("host").alias("key")).distinct()
    marks = listed.select(F.col("host").alias("key"), F.lit(True).alias("on")).distinct()
    universe = stage_table(hosts.join(marks, "key", "left").select("key", F.coalesce("on", F.lit(False)).alias("listed")), "url-universe")
    judged = parts.withColumn("listed", build_cascade(universe).contains(F.col("host")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, method).alias("verdict"))


def tracking_hosts(pages: DataFrame, url: str = "url", share: float = 0.25) -> DataFrame:
    """The host list of the query: hosts of which a share of urls, or more, carries a campaign tag (utm_source)."""
    tagged = F.coalesce(F.col(url), F.lit("")).contains("utm_source=").cast("int")
    by = pages.select(host_of(F.col(url)).alias("host"), tagged.alias("t")).groupBy("host").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    return by.filter((F.col("t") > 0) & (F.col("t") >= F.lit(share) * F.col("n"))).select("host")
