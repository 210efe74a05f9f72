"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that any matching url must hold. The index
files each rule under the one of its tokens that the fewest rules share; a url's own tokens fetch the
candidate rules, and only those run their expression. Built-in functions only: no Python on executors.

Rules come in two layers. Address rules (host and path) decide first, the longest one wins (ties: the
smaller name). Where none fits, pattern rules decide: an allowing one beats a blocking one; without any
the default verdict holds. Up to LITERAL_RULES rules the index is a literal in the plan and no row
moves; beyond, the index is a table: tokens that it doesn't have are dropped by a broadcast set of its
tokens while there are at most BROADCAST_TOKENS of them, and what is left of the distinct urls meets it
on the token and a salt, so that a token which every url has is not one task's.

A null url, or one without ``://``, has an empty host and path and gets the default verdict unless a
rule without tokens matches the empty address. Repeated rows are judged alike; extra columns are kept
by ``judge`` (but for host, path, rule and verdict, which are its own) and very long urls need no other rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import free_name

LITERAL_RULES = 2_000
#: Tokens of a large index that are broadcast (about 20 bytes each), and shares that a token's urls are dealt to.
BROADCAST_TOKENS, SALTS = 1_000_000, 64
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    #: 0: address rule; 1: pattern rule.
    layer: int = 1


def address_rule(verdict: str, address: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the url's path starts with the path."""
    whole = re.findall(rf"(?<![a-z0-9]){_TOKEN}(?=[^a-z0-9])", address)
    return Rule(address, verdict, r"^(?:[^/?#]*\.)?" + java_quoted(address), tuple(whole), 0)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression over host, path and the rest; ``tokens``: whole lower-case tokens of any match."""
    return Rule(pattern, verdict, pattern, tokens, 1)


def java_quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def index(rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; rules without one under the empty token, which every url has."""
    shared = Counter(t for r in rules for t in set(r.tokens))
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (shared[t], -len(t), t), default=""), []).append(r)
    return out


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and host with all that follows it."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(after, "^[^/?#]*([\\s\\S]*)", 1))


def tokens_of(subject: str) -> Column:
    """The distinct tokens of an address, with the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(subject), F.lit(_TOKEN), F.lit(0))))


_RULE = "struct<name:string,verdict:string,pattern:string,layer:int>"


def best(matches: Column) -> Column:
    """The deciding rule of an array of matching ones."""
    rank = lambda r: F.struct((-r["layer"]).alias("a"), F.when(r["layer"] == 0, F.length(r["name"])).otherwise((r["verdict"] == "allow").cast("int")).alias("b"))

    def later(a: Column, b: Column) -> Column:
        x, y = rank(a), rank(b)
        return F.when(x > y, -1).when(x < y, 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)

    return F.try_element_at(F.array_sort(matches, later), F.lit(1))


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (of an address rule, else null) and verdict."""
    host, path, whole = address(F.col(url))
    subject = free_name(df, "subject_")
    df = df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), subject: F.coalesce(whole, F.lit(""))})
    decided = free_name(df, "best_")
    tokens = tokens_of(subject)
    filed = index(rules)
    if not rules:
        df = df.withColumn(decided, F.lit(None).cast(_RULE))
    elif len(rules) <= LITERAL_RULES:
        table = F.create_map(*[x for t, rs in filed.items() for x in (F.lit(t), F.array(*[literal(r) for r in rs]))])
        keys = F.array(*[F.lit(t) for t in filed])
        # only tokens that the index has are looked up
        fetched = F.flatten(F.transform(F.array_intersect(tokens, keys), lambda t: F.element_at(table, t)))
        found = free_name(df, "found_")
        df = df.withColumn(found, fetched).withColumn(decided, best(F.filter(found, lambda r: F.regexp(F.col(subject), r["pattern"])))).drop(found)
    else:
        spark = df.sparkSession
        rows = [(t, r.name, r.verdict, r.pattern, r.layer) for t, rs in filed.items() for r in rs]
        table = spark.createDataFrame(rows, "token string, name string, verdict string, pattern string, layer int")
        subjects = df.select(F.col(subject).alias("subject")).distinct()
        mine = subjects.select("subject", F.explode(tokens_of("subject")).alias("token"))
        if len(filed) <= BROADCAST_TOKENS:
            mine = mine.join(F.broadcast(table.select("token").distinct()), "token", "left_semi")
        mine = mine.withColumn("salt", F.pmod(F.xxhash64("subject"), F.lit(SALTS)))
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = mine.join(salted.hint("merge"), ["token", "salt"]).where("regexp_like(subject, pattern)")
        made = found.groupBy("subject").agg(best(F.collect_set(F.struct("name", "verdict", "pattern", "layer"))).alias(decided)).withColumnRenamed("subject", subject)
        df = df.join(made, subject, "left")
    of = lambda name: F.col(f"`{decided}`.{name}")
    return df.withColumns({"rule": F.when(of("layer") == 0, of("name")).cast(T.StringType()), "verdict": F.coalesce(of("verdict"), F.lit(default))}).drop(subject, decided)


def literal(r: Rule) -> Column:
    return F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.layer).alias("layer"))
