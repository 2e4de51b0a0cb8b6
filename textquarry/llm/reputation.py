"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. Bad rates are shrunk through
beta-binomial priors: the whole to the suffix, the suffix to the registered
domain, the domain to the host. How strongly a level is pulled to its parent is
fitted by moments on all rows (the overdispersion of children around parents).
A host is blocked if the lower bound of its posterior bad rate passes a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

# Public suffixes of two labels that are known here; all others have one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, under a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(rules: tuple[Rule, ...], host: Column, path: Column, give) -> Column:
    """``give(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(give(r))).otherwise(out)
    return out


def domain_and_suffix(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (user and port aside); an address or bare name stands for both."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    parts = F.split(name, r"\.")
    plain = name.rlike(r"^[0-9.]*$|:") | (F.size(parts) < 2)
    last2 = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
    last3 = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3))
    two = last2.isin(*two_label)
    return F.when(plain, name).when(two, last3).otherwise(last2), F.when(plain, name).when(two, last2).otherwise(F.element_at(parts, -1))


def strength(children: DataFrame) -> float:
    """Prior strength from children with n, bad and the parent's mean m, by moments; one row leaves the cluster."""
    spread = F.col("n") * F.col("m") * (1 - F.col("m"))
    row = children.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("room")
    ).first()
    rho = row["over"] / row["room"] if row["room"] else 0.0
    rho = min(max(rho, 0.01), 0.5)
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad (one row a host) -> also bad_rate and bad_rate_low, the posterior's mean and lower bound.

    Hosts without outcomes (n = 0) get their domain's posterior mean with the fitted strength.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = settle(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "reputation-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)

    def posterior(df: DataFrame, keep: list[str], name: str) -> DataFrame:
        kappa = F.lit(strength(df))
        mean = (kappa * F.col("m") + F.col("bad")) / (kappa + F.col("n"))
        return df.select(*keep, mean.alias(name), (kappa + F.col("n")).alias("mass"))

    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    by_suffix = hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(root))
    by_suffix = posterior(by_suffix, ["suffix"], "m").drop("mass")
    by_domain = hosts.groupBy("domain", "suffix").agg(*sums).join(by_suffix, "suffix")
    by_domain = posterior(by_domain, ["domain", "suffix"], "m").drop("mass")
    by_host = hosts.join(by_domain, ["domain", "suffix"])
    out = posterior(by_host, ["host", "n", "bad"], "bad_rate")
    sd = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("mass") + 1))
    return out.withColumn("bad_rate_low", F.greatest(F.col("bad_rate") - z * sd, F.lit(0.0))).drop("mass")


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """A verdict on every row of ``pages`` (page_id, url).

    ``outcomes`` has page_id and bad (0, 1 or null); a page with several counts as bad if one of them is.
    Null or malformed url: empty host and path, judged by the reputation of the empty host.
    Null page_id: no outcome. Repeated rows: each is judged, and each counts for its host.
    Urls of any length are read whole; of rules of equal length the first by its text counts. Other columns are ignored.
    Empty pages: no rows. Without outcomes every rate is the prior.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).drop("url")
    seen = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = judged.select("page_id", "host").join(seen, "page_id", "left").groupBy("host")
    hosts = hosts.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rates = host_reputation(hosts, z)
    h, p = F.col("host"), F.col("path")
    out = judged.join(rates, "host", "left")
    verdict = F.coalesce(matched(rules, h, p, lambda r: r.verdict), F.when(F.col("bad_rate_low") > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", matched(rules, h, p, lambda r: r.text).alias("rule"), verdict.alias("verdict"), F.col("n").alias("labelled"), "bad_rate", "bad_rate_low")
