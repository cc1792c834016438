"""URL filters: hand-written rules first, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, materialize

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A table of hosts or domains up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_HOSTS = 20_000
#: Second-level labels under which names are registered, as in example.co.uk.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Words of a host or path that mark a page as spam or adult content.
SPAM_WORDS = """
adult bet bets betting bingo bonus camgirls casino casinos cialis escort escorts gambling jackpot loans lottery payday penis pharmacy
pills poker porn porno replica roulette sex sexy slots viagra warez xxx
""".split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found["rule"], found["verdict"]


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host name; an address or single label is its own."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    second = F.element_at(labels, -2).isin(SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2) & (n > 2)
    k = F.when(second, 3).otherwise(2)
    whole = (n < 2) | host.rlike(r"^[0-9.]+$")
    domain = F.when(whole, host).otherwise(F.array_join(F.slice(labels, -F.least(k, n), F.least(k, n)), "."))
    suffix = F.when(whole, host).otherwise(F.array_join(F.slice(labels, -F.least(k - 1, n), F.least(k - 1, n)), "."))
    return domain, suffix


def junk_outcome(html: Column) -> Column:
    """1 if a page's visible text is mostly junk, 0 if not, null without any text.

    Tags, scripts and styles are cut (one that isn't closed runs to the end); junk is runs of symbols, cell
    separators and words in capitals with exclamation marks. Takes time in proportion to the page.
    """
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", " "), r"<[^<>]*+>|&(amp|lt|gt|quot);", " ")
    words = F.regexp_count(visible, F.lit(r"[^\x20\x09-\x0D]+"))
    bad = F.regexp_count(visible, F.lit(r"[#$%*!&|]{2,}|(?<= )\|(?= )"))
    return F.when(words > 0, F.when(bad > 0.2 * words, 1).otherwise(0))


def spam_words(host: Column, path: Column, words: Sequence[str] = SPAM_WORDS) -> Column:
    """Whether one of the words stands in host or path between anything but letters."""
    return F.concat(host, F.lit("/"), F.lower(path)).rlike(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])")


def page_outcome(host: Column, path: Column, html: Column) -> Column:
    """A page's outcome where no labels are at hand: 1 with a spam word in its url or mostly junk in its text, else 0;
    null if it has neither such a word nor text."""
    return F.when(spam_words(host, path), 1).otherwise(junk_outcome(html))


def host_reputation(outcomes: DataFrame, strength: float = 20.0, z: float = 1.645) -> DataFrame:
    """Posterior of the share of bad pages, one row per host.

    outcomes: host, domain, suffix, bad (0 or 1, null if unlabelled; such a row only makes
    its host known). Each level is a beta prior for the next: the overall rate for suffixes, a
    suffix's posterior mean for its domains, a domain's for its hosts, each worth as many
    pages as the method of moments finds in the spread of the level's rates (between 1 and
    100 times ``strength``; ``strength`` where there is none to see). Labelled pages are
    counted per host before any shuffle, so a host with a third of all pages is a few rows.

    Returns host, domain, suffix, pages, n, bad, mean, low, high: the host's rows, those labelled, the
    posterior mean and its bounds at ``z`` standard deviations, within 0 and 1.
    """
    hosts = materialize(outcomes.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = F.col("n"), F.col("bad")
    overall = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("m")).first()["m"]
    overall = 0.5 if overall is None else float(overall)

    def worth(level: DataFrame) -> float:
        """Prior pages: m (1 - m) / (variance of the rates beyond chance), less 1."""
        seen = level.where("n > 1").withColumn("rate", bad / n)
        row = seen.agg(F.count("*").alias("k"), F.avg((F.col("rate") - overall) ** 2).alias("v"), F.avg(overall * (1 - overall) / n).alias("chance")).first()
        if row["k"] < 3:
            return strength
        beyond = row["v"] - row["chance"]
        return min(100 * strength, max(1.0, overall * (1 - overall) / beyond - 1)) if beyond > 0 else 100 * strength

    s1, s2, s3 = worth(suffixes), worth(domains), worth(hosts)
    by_suffix = suffixes.select("suffix", ((bad + s1 * overall) / (n + s1)).alias("m1"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", ((bad + s2 * F.col("m1")) / (n + s2)).alias("m2"))
    a, b = bad + s3 * F.col("m2"), n - bad + s3 * (1 - F.col("m2"))
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(by_domain, ["domain", "suffix"]).select("host", "domain", "suffix", "pages", "n", "bad", mean.alias("mean"), F.greatest(mean - z * sd, F.lit(0.0)).alias("low"), F.least(mean + z * sd, F.lit(1.0)).alias("high"))


def judge_urls(pages: DataFrame, outcome: Column | None = None, rules: Sequence[tuple[str, str, str]] = RULES, most_bad: float = 0.5, strength: float = 20.0, z: float = 1.645) -> DataFrame:
    """Add host, path, rule, verdict and the host's posterior (bad_mean, bad_low) to pages.

    pages: url (null counts as no url) and any other columns. ``outcome`` gives a page's
    labelled outcome, 1 bad, 0 good, null unlabelled; by default ``page_outcome`` takes it from url and the column html.
    A rule's verdict holds where one fits; elsewhere a host is blocked if the
    lower bound of its share of bad pages is above ``most_bad``, and allowed if not: one bad page isn't enough
    where its domain and suffix are fair, and a host with few pages of a bad domain is blocked. Equal
    rows get equal verdicts; no pages give no rows.
    """
    host, path = url_parts(F.col("url"))
    outcome = page_outcome(host, path, F.col("html")) if outcome is None else outcome
    parts = pages.select(*[c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "bad_mean", "bad_low"}], host.alias("host"), path.alias("path"))
    domain, suffix = registered_domain(F.col("host"))
    outcomes = pages.select(host.alias("host"), outcome.alias("bad")).withColumns({"domain": domain, "suffix": suffix})
    known = materialize(host_reputation(outcomes, strength, z), "reputation")
    hosts, rows = known.agg(F.count("*"), F.sum("pages")).first()
    right = known.select("host", F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"), F.col("pages").alias("_pages"))
    joined = parts.join(F.broadcast(right.drop("_pages")), "host") if hosts <= BROADCAST_HOSTS else join_counted(parts, right, ["host"], "_pages", rows, "inner")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return joined.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad_low") > most_bad, "block").otherwise("allow")))
