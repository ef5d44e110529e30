"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule (verdict, host, path) fits its host and all subdomains, if the url's path starts with the rule's. The longest
rule (host and path together) wins; of equally long ones the longer host, then ``block``. Without a rule the
url is searched, in one pass over host, path and the rest, for all vocabulary terms that stand between
characters other than a-z and 0-9. A strict term weighs 1, a soft term less; distinct terms add up, and a
weight of 1 rejects: one strict hit or several distinct soft ones. The vocabulary is a table of term and weight (``vocabulary_of``); the one given here holds
customary English terms of five kinds of unwanted sites, chosen by hand from general knowledge and from no list.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and is allowed. Repeated
rows stay. Nothing is shuffled, so a host that holds a third of all urls costs nothing extra. Extra columns are not read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import ascii_lower, only

#: Term and weight.
STRICT = (
    "blowjob", "camgirls", "camsex", "creampie", "cumshot", "escorts", "fetish", "gangbang", "hardcore-sex", "hentai", "milf", "onlyfans-leak", "porn", "porno", "pornhub", "sexcam", "sexshop", "webcam-sex", "xnxx", "xvideos", "xxx",
    "online-casino", "slot-online", "sportsbook", "togel",
    "cialis", "levitra", "tramadol", "viagra", "buy-followers", "link-farm", "spam-farm",
    "cracked-apk", "keygen", "malware", "nulled", "phishing", "ransomware", "warez",
)
SOFT = (
    "adult", "dating", "erotic", "escort", "nude", "nudes", "sex", "sexy", "bet", "bets", "betting", "casino", "gambling", "poker", "roulette", "win",
    "ads", "cheap", "farm", "free", "loan", "payday", "pharmacy", "pills", "spam", "track", "cracked", "botnet", "exploit",
)
FAINT = ("affiliate", "bingo", "bonus", "coupon", "crack", "deal", "discount", "download", "jackpot", "loans", "lottery", "offer", "promo", "replica", "serial", "singles", "slots", "torrent", "tracker", "winner")
VOCABULARY = {t: 1.0 for t in STRICT} | {t: 0.5 for t in SOFT} | {t: 0.25 for t in FAINT}
#: A vocabulary is held by the driver and each task: so many terms at most.
MAX_TERMS = 1_000_000
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def automaton(vocabulary: dict[str, float]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for term in vocabulary:
        machine.add_word(term, term)
    machine.make_automaton()
    return machine


def vocabulary_of(table: DataFrame, term_col: str = "term", weight_col: str = "weight") -> dict[str, float]:
    """The vocabulary that a table holds: terms in lower case, of a repeated term the largest weight; rows with a null or an empty term are left out."""
    terms = only(table, term_col, weight_col).toDF("term", "weight").where("term <> '' and weight is not null")
    terms = terms.groupBy(ascii_lower(F.col("term")).alias("term")).agg(F.max("weight").cast("double").alias("weight"))
    if terms.count() > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return {r.term: r.weight for r in terms.collect()}


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and (text[at].isascii() and text[at].isalnum()))


def terms_in(machine: ahocorasick.Automaton, text: str) -> set[str]:
    """Distinct terms of the (lower-cased) text that stand between boundaries."""
    if not len(machine):
        return set()
    return {term for end, term in machine.iter(text) if _edge(text, end + 1) and _edge(text, end - len(term))}


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None) -> DataFrame:
    """id, url, host, path, rule (host and path, or null), terms (distinct vocabulary hits), weight, verdict."""
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    host, path = F.col("host"), F.col("path")
    rule = verdict = None
    for said, h, p in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    if rule is None:
        rule = verdict = F.lit(None).cast("string")

    def run(batches):
        machine = automaton(vocabulary)
        for batch in batches:
            hits = [sorted(terms_in(machine, t)) if t else [] for t in batch.column("search").to_pylist()]
            columns = [batch.column(n) for n in ("id", "url", "host", "path", "rule", "said")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pa.string())), pa.array([sum(vocabulary[t] for t in h) for h in hits], pa.float64())], ["id", "url", "host", "path", "rule", "said", "terms", "weight"])

    rows = only(pages, id_col, url_col).toDF("id", "url")
    kind = rows.schema["id"]
    url = F.col("url")
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url), "search": ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1))})
    rows = rows.withColumns({"rule": rule, "said": verdict})
    schema = StructType([kind, *[StructField(c, StringType()) for c in ("url", "host", "path", "rule", "said")], StructField("terms", ArrayType(StringType())), StructField("weight", DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", "terms", "weight", F.coalesce("said", F.when(F.col("weight") >= 1, "block").otherwise("allow")).alias("verdict"))
