"""URL filter: site rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import table

# The rules (verdict, host, path) of the contract.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# The vocabulary. One strict term, or SOFT_LIMIT different soft ones, block a url.
STRICT = (
    "casino porn porno pornhub xxx viagra cialis jackpot payday-loan free-bets cheap-pills escort escorts warez keygen torrentz hentai camgirls livesex sexcam sexshop onlyfans-leak "
    "slots roulette blackjack baccarat sportsbook bookmaker betting gambling crack-download serialz replica-watches fake-passport buy-followers get-rich-quick penis-enlargement "
    "gluecksspiel spielautomaten spielcasino sexkontakte erotikchat wettbonus pornofilme kredit-ohne-schufa "
    "jeux-dargent machines-a-sous paris-sportifs rencontres-coquines pret-sans-justificatif plan-cul "
    "apuestas tragaperras ruleta videos-porno prestamo-inmediato sexo-gratis chicas-webcam"
).split()
SOFT = (
    "free win winner bets bet cheap pills ads adserver track tracker adult loan loans bonus deal deals click clickbait promo poker prize lottery lotto bingo dating singles hookup nude nudes sexy hot-girls "
    "discount coupon affiliate referral popunder popup sponsor sponsored banner doubleclick pharmacy pills-online weight-loss miracle crypto-profit forex binary-options mlm giveaway sweepstakes spam "
    "gratis gewinn gewinnspiel billig rabatt kredit wetten angebot werbung partnersuche "
    "gratuit gagner gagnant loterie credit-rapide promotion publicite rencontre "
    "ganar premio loteria barato oferta credito publicidad citas"
).split()
SOFT_LIMIT = 2
ESCAPE = "%[0-9a-f]{2}"


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def hits(url: str, found: ahocorasick.Automaton) -> tuple[int, int]:
    """Different strict and soft terms that stand in ``url`` with no letter or digit beside them."""
    seen = set()
    for last, (term, is_strict) in found.iter(url):
        first = last - len(term) + 1
        if (first and url[first - 1].isascii() and url[first - 1].isalnum()) or (last + 1 < len(url) and url[last + 1].isascii() and url[last + 1].isalnum()):
            continue
        seen.add((is_strict, term))
    n_strict = sum(is_strict for is_strict, _ in seen)
    return n_strict, len(seen) - n_strict


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def vocabulary(terms: DataFrame, most: int = 100_000) -> tuple[list[str], list[str]]:
    """The strict and the soft terms of a table ``terms(term, weight)``: weight 1 or more is strict, less is soft, 0
    and null is none. A vocabulary goes to every task, so one of more than ``most`` terms is an error."""
    rows = terms.filter(F.col("weight") > 0).select(lower_ascii(F.col("term")).alias("term"), "weight").filter("term <> ''").groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return [r["term"] for r in rows if r["weight"] >= 1], [r["term"] for r in rows if r["weight"] < 1]


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft of every row of ``pages(page_id, url, ...)``.

    Terms (``vocabulary`` reads them from a table) count once each, where no ASCII letter or digit stands beside
    them; an escape such as ``%20`` parts words. A null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by its
    words alone (null: allow). Repeated rows are judged each for itself; further columns are ignored; an
    empty table gives an empty result. One pass over the rows, no shuffle, memory of one batch.
    """

    @F.pandas_udf("n_strict int, n_soft int")
    def count_terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(tuple(strict), tuple(soft))
        for urls in batches:
            yield pd.DataFrame([hits(u or "", found) for u in urls], columns=["n_strict", "n_soft"], dtype="int32")

    url = F.coalesce(F.col("url"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select(
        "page_id",
        lower_ascii(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
        count_terms(F.regexp_replace(lower_ascii(url), ESCAPE, " ")).alias("terms"),
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, action).otherwise(verdict)
    by_words = F.when((F.col("terms.n_strict") >= 1) | (F.col("terms.n_soft") >= soft_limit), "block").otherwise("allow")
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_words).alias("verdict"), "terms.n_strict", "terms.n_soft")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_sql() -> str:
    def count(terms):
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)

    fits = [(a, h, p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for _, h, p, f in fits)
    verdict = " ".join(f"WHEN {f} THEN '{a}'" for a, _, _, f in fits)
    return f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(translate(coalesce(url, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{ESCAPE}', ' ', 'g') AS u FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
             CAST({count(STRICT)} AS INTEGER) AS n_strict, CAST({count(SOFT)} AS INTEGER) AS n_soft FROM s)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM p"""
