"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled pages are bad or not.  With a beta-binomial model on three levels, the rate
of a suffix is drawn around the overall rate, that of a registered domain around its
suffix's, that of a host around its domain's:

    mean_child = (bad + M * mean_parent) / (n + M)

M, the strength of a level's prior, is fitted by moments from how much more the
groups' rates vary than chance makes them (Kleinman): with d_i = bad_i - n_i mu_i,

    rho = (sum d_i^2 / n_i - sum mu_i (1 - mu_i)) / sum (n_i - 1) mu_i (1 - mu_i),   M = 1 / rho - 1.

A host's posterior is Beta(a, b); the host is blocked if its lower bound, mean - z *
sd, is above ``lift`` times the overall rate, or above ``limit`` whatever that rate is: it
has to be credibly worse than the web at large, and a host with little evidence is
blocked only if its domain and suffix are that bad.  A rule that fits (host and
subdomains, path beginning) decides before the method, the longest one first, then the
one with the longer host, then by name.

Hosts are grouped without user part, port and trailing dots.  An IP address is its own
domain and suffix.  A suffix is the longest of ``suffixes`` that the host ends in, else its
last label; a domain is one label more.

Counts are partial sums before each shuffle.  Of hosts with more than a 1024th of the
pages there are at most 1024; those are broadcast, and the rest is joined by a shuffle
in which no host is that frequent.

Edge cases: a null url or one without :// has an empty host and path, and the empty host
has a reputation like any other.  Null outcomes aren't labels.  Without any label the
overall rate is 1/2, and nothing is blocked but by rules.  Repeated pages are judged one
by one and count each time in their host's rows.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import cut, prepare

#: Rules of the registered query, (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Common suffixes of several labels, a default for the ``suffixes`` that callers take from the public list.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "ad.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "re.kr",
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "edu.hk", "org.hk", "com.tw", "edu.tw", "org.tw", "com.sg", "edu.sg",
    "ac.in", "co.in", "edu.in", "gov.in", "net.in", "org.in", "co.id", "or.id", "com.my", "com.ph", "co.th", "in.th", "com.vn", "edu.vn",
    "com.br", "edu.br", "gov.br", "net.br", "org.br", "com.ar", "com.mx", "org.mx", "com.co", "com.pe", "com.ve",
    "ac.za", "co.za", "gov.za", "org.za", "co.ke", "com.ng", "com.eg", "ac.il", "co.il", "org.il", "com.tr", "edu.tr", "gov.tr", "org.tr", "com.sa", "com.ua", "com.pl", "edu.pl", "net.pl", "org.pl", "co.at", "or.at", "gouv.fr",
)


@dataclass(frozen=True)
class Params:
    z: float = 0.6745  # the lower bound is passed with a probability of 0.75
    lift: float = 1.0
    limit: float = 0.5
    least_strength: float = 2.0
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare_of(host: Column) -> Column:
    """The host without user part, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:[^\]:]*)?$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^\[.*\]$|^[0-9]+(\.[0-9]+){3}$")


def suffix_of(bare: Column, suffixes=SUFFIXES) -> Column:
    """The longest listed suffix, else the last label; of an address all of it."""
    found = F.substring_index(bare, ".", -1)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        last = F.substring_index(bare, ".", -n)
        found = F.when(last.isin(*(x for x in suffixes if x.count(".") + 1 == n)), last).otherwise(found)
    return F.when(_is_address(bare), bare).otherwise(found)


def domain_of(bare: Column, suffix: Column) -> Column:
    """One label more than the suffix, or the suffix itself where there is none."""
    rest = bare.substr(F.lit(1), F.length(bare) - F.length(suffix) - 1)
    own = F.concat_ws(".", F.substring_index(rest, ".", -1), suffix)
    return F.when(_is_address(bare) | (F.length(bare) <= F.length(suffix)), suffix).otherwise(own)


def grouped(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """``hosts`` with the domain and suffix that they belong to."""
    named = hosts.withColumn("_bare", bare_of(F.col("host")))
    named = named.withColumn("_suffix", suffix_of(F.col("_bare"), suffixes))
    return named.withColumns({"domain": domain_of(F.col("_bare"), F.col("_suffix")), "suffix": F.col("_suffix")}).drop("_bare", "_suffix")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, p: Params) -> float:
    """Moment estimate of a level's M from rows (n, bad, mu); three sums reach the driver."""
    spread = F.col("mu") * (1 - F.col("mu"))
    labelled = groups.where("n > 0")
    got = labelled.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mu"), 2) / F.col("n")), F.sum(spread), F.sum((F.col("n") - 1) * spread)).first()
    if not got[2]:
        return p.most_strength
    rho = (got[0] - got[1]) / got[2]
    return min(p.most_strength, max(p.least_strength, 1 / rho - 1)) if rho > 0 else p.most_strength


def reputation(hosts: DataFrame, params: Params | None = None, suffixes=SUFFIXES) -> DataFrame:
    """host, n, bad, posterior mean, its lower bound and whether that is too high, from a row (host, n, bad) for each host."""
    p = params or Params()
    hosts = cut(grouped(hosts.select("host", "n", "bad"), suffixes))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    shrunk = lambda m: (F.col("bad") + m * F.col("mu")) / (F.col("n") + m)
    level = suffixes.withColumn("mu", F.lit(overall))
    m_suffix = _strength(level, p)
    means = level.select("suffix", shrunk(m_suffix).alias("mu"))
    level = cut(domains.join(means, "suffix"))
    m_domain = _strength(level, p)
    means = level.select("domain", "suffix", shrunk(m_domain).alias("mu"))
    level = cut(hosts.join(means, ["domain", "suffix"]))
    m_host = _strength(level, p)
    a, b = F.col("bad") + m_host * F.col("mu"), F.col("n") - F.col("bad") + m_host * (1 - F.col("mu"))
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    bound = mean - p.z * sd
    return level.select("host", "n", "bad", mean.alias("bad_rate"), bound.alias("lower_bound"), (bound > min(p.limit, p.lift * overall)).alias("too_bad"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, params: Params | None = None, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and lower_bound of every page.

    ``outcomes``: page_id and bad (boolean) of labelled pages; repeated ones count once, as bad if any is.
    """
    p = params or Params()
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    told = rows.select("page_id", "host").join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    zero = F.lit(0).cast("long")
    hosts = cut(sizes.join(told, "host", "left").select("host", "pages", F.coalesce("n", zero).alias("n"), F.coalesce("bad", zero).alias("bad")))
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    judged = cut(reputation(hosts, p, suffixes).join(hosts.select("host", "pages"), "host"))
    hot = F.broadcast(judged.where(F.col("pages") > total / 1024))
    cold = judged.where(F.col("pages") <= total / 1024)
    rest = rows.join(hot.select("host"), "host", "left_anti").join(cold, "host")
    both = rows.join(hot, "host").unionByName(rest)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("too_bad"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "lower_bound")
