"""URL rules and empirical-Bayes host reputation, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``allow`` or ``block`` for a host with its subdomains, where the path starts as the rule's does."""

    verdict: str
    text: str


RULES: tuple[Rule, ...] = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)

#: Labels that form a public suffix together with a country code of two letters after them; all other suffixes have one label.
SECOND_LEVEL: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _two_labels(second: Sequence[str]) -> str:
    return rf"(?:{'|'.join(second)})\.[a-z][a-z]"


def suffix_of(host: Column, second: Sequence[str] = SECOND_LEVEL) -> Column:
    """The last label of a host, or the last two if they are a public suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.rlike(f"^{_two_labels(second)}$"), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, second: Sequence[str] = SECOND_LEVEL) -> Column:
    """The registered domain: the suffix with the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.rlike(f"^{_two_labels(second)}$"), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equally long ones the first in order of text."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        own, slash, rest = r.text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _strength(children: DataFrame) -> DataFrame:
    """One row: how many outcomes a prior counts for, by moments of the good shares (n, good) among siblings.

    The variance between children beyond the binomial one gives the correlation within a child,
    held between 0.001 and 0.5; the strength is (1 - r) / r.
    """
    s = children.where("n > 0").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("t"),
        F.sum("good").alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("gg"),
    )
    p = F.col("g") / F.col("t")
    q = p * (1 - p)
    between = F.col("gg") - F.col("t") * p * p
    spread = F.col("t") - F.col("nn") / F.col("t") - (F.col("k") - 1)
    r = F.try_divide(between - (F.col("k") - 1) * q, spread * q)
    r = F.least(F.greatest(F.when((F.col("t") > 0) & (F.col("k") > 1), r), F.lit(0.001)), F.lit(0.5))
    return s.select(((1 - F.coalesce(r, F.lit(0.5))) / F.coalesce(r, F.lit(0.5))).alias("strength"))


def host_reputation(outcomes: DataFrame, second: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """``host, domain, n, good, alpha, beta`` of each host in ``outcomes`` (host, n, good: rows may repeat a host).

    Beta-binomial posteriors from the top down: all pages, suffix, registered domain, host. The
    posterior mean above is the prior mean below, its strength comes from the spread among the
    children of that level. A host without labelled pages keeps its domain's mean. Without any
    labelled page, each prior mean is 1/2. Null hosts count as the empty host.
    """
    hosts = outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"))
    hosts = hosts.select("*", domain_of(F.col("host"), second).alias("domain"), suffix_of(F.col("host"), second).alias("suffix"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = tops.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    posterior = lambda prior, strength: (F.col("good") + F.col(prior) * F.col(strength)) / (F.col("n") + F.col(strength))
    # Each of these has one row, whatever the input.
    tops = tops.join(F.broadcast(whole), how="cross").join(F.broadcast(_strength(tops)), how="cross").select("suffix", posterior("prior", "strength").alias("prior"))
    domains = domains.join(tops, "suffix").join(F.broadcast(_strength(domains)), how="cross").select("suffix", "domain", posterior("prior", "strength").alias("prior"))
    return (
        hosts.join(domains, ["suffix", "domain"])
        .join(F.broadcast(_strength(hosts)), how="cross")
        .select("host", "domain", "n", "good", (F.col("good") + F.col("prior") * F.col("strength")).alias("alpha"), (F.col("n") - F.col("good") + (1 - F.col("prior")) * F.col("strength")).alias("beta"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, least_good: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, registered_domain, reputation`` of each page.

    ``outcomes`` (``page_id, good``: 1 or 0) labels some pages; a page with several labels counts
    with each, and nulls don't count. The longest rule that fits decides; else a page is blocked if
    the upper bound (``z`` deviations over the mean) of its host's posterior share of good pages
    lies under ``least_good``, so that a host is only blocked on evidence. Null urls have an empty
    host and path. Repeated pages are judged each; other columns are left out.
    """
    url = F.col(url_col)
    pages = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    known = host_reputation(pages.select("page_id", "host").join(labels, "page_id", "left").select("host", "n", "good"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    upper = mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return pages.join(known, "host").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(upper < least_good, "block").otherwise("allow")).alias("verdict"),
        F.col("domain").alias("registered_domain"),
        F.round(mean, 6).alias("reputation"),
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """``page_id, good``: a labelled page is good if its quality is 1 and it isn't toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull() | (F.col("toxic") == 1), 0).alias("good"))


def rules_sql(rules: Sequence[Rule] = RULES) -> tuple[str, str]:
    """``matching_rule`` as SQL expressions over ``host`` and ``path``."""
    text = verdict = ""
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        own, slash, rest = r.text.partition("/")
        fits = f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}') THEN"
        text, verdict = f"{text} {fits} '{r.text}'", f"{verdict} {fits} '{r.verdict}'"
    return f"CASE{text} END", f"CASE{verdict} END"


def oracle_sql(rules: Sequence[Rule] = RULES, second: Sequence[str] = SECOND_LEVEL, least_good: float = 0.5, z: float = 1.645) -> str:
    """``judge_urls`` over pages and labels in DuckDB's SQL."""
    text, verdict = rules_sql(rules)
    cut = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
    strength = lambda t: f"""(SELECT (1 - r) / r FROM (SELECT coalesce(least(greatest(CASE WHEN t > 0 AND k > 1 THEN CASE WHEN (t - nn / t - (k - 1)) * (g / t) * (1 - g / t) = 0 THEN NULL
        ELSE (gg - t * (g / t) * (g / t) - (k - 1) * (g / t) * (1 - g / t)) / ((t - nn / t - (k - 1)) * (g / t) * (1 - g / t)) END END, 0.001), 0.5), 0.5) AS r
        FROM (SELECT count(*) k, sum(n)::double t, sum(good)::double g, sum(n::double * n) nn, sum(good::double * good / n) gg FROM {t} WHERE n > 0)))"""  # noqa: E731
    return f"""
    WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    l AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 WHEN quality IS NOT NULL OR toxic = 1 THEN 0 END AS good FROM labels),
    o AS (SELECT page_id, count(*) AS n, sum(good) AS good FROM l WHERE page_id IS NOT NULL AND good IS NOT NULL GROUP BY page_id),
    h AS (SELECT host, sum(coalesce(n, 0))::double AS n, sum(coalesce(good, 0))::double AS good,
                 CASE WHEN regexp_full_match({cut(2)}, '{_two_labels(second)}') THEN {cut(3)} ELSE {cut(2)} END AS domain,
                 CASE WHEN regexp_full_match({cut(2)}, '{_two_labels(second)}') THEN {cut(2)} ELSE {cut(1)} END AS suffix
          FROM p LEFT JOIN o USING (page_id) GROUP BY host),
    d AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM h GROUP BY suffix, domain),
    s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY suffix),
    w AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior FROM s),
    k AS (SELECT {strength("s")} AS ks, {strength("d")} AS kd, {strength("h")} AS kh),
    sp AS (SELECT suffix, (good + w.prior * ks) / (n + ks) AS prior FROM s, w, k),
    dp AS (SELECT suffix, domain, (good + sp.prior * kd) / (n + kd) AS prior FROM d JOIN sp USING (suffix), k),
    hp AS (SELECT host, h.domain, good + dp.prior * kh AS a, n - good + (1 - dp.prior) * kh AS b FROM h JOIN dp USING (suffix, domain), k),
    m AS (SELECT p.*, domain, a / (a + b) AS mean, a / (a + b) + {z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) AS upper FROM p JOIN hp USING (host))
    SELECT page_id, host, path, {text} AS rule, coalesce({verdict}, CASE WHEN upper < {least_good} THEN 'block' ELSE 'allow' END) AS verdict,
           domain AS registered_domain, round(mean, 6) AS reputation FROM m"""
