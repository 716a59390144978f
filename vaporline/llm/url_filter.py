"""URL filtering by stated rules and by mined association rules.

Stated rules (host, path, verdict) decide first. They also are the labels from which
Spark's FP-growth mines combinations of URL tokens: a combination becomes a rule if it
is frequent enough together with a verdict among the labelled URLs and if, of those that
have it, enough have that verdict. URLs without a label say nothing of either. A rule
that a shorter one implies is pruned. The rest judge the other URLs by an inverted index
from each rule's rarest token.

A URL has at most TOKENS tokens, one of each field below, so there are at most
2**TOKENS / min_support frequent combinations, whatever the data: the rules that reach
the driver and the workers are bounded.

Defined results: a null URL, or one without "://", has an empty host and path and no
tokens, no stated rule fits it and the default verdict holds; repeated rows give
repeated results; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporline.llm.common import ready, settle

#: Fields of a URL that make its tokens: end of the host, last two and first label,
#: whole host, first folder, last suffix, name of the first parameter.
FIELDS = ("tld", "domain", "label", "host", "folder", "suffix", "key")
TOKENS = len(FIELDS)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
VERDICT = "verdict="


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host with its subdomains and all paths that start so."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    support: int
    confidence: float

    def rank(self) -> tuple:
        return (-self.confidence, -self.support, len(self.tokens), self.tokens, self.verdict)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), empty), F.coalesce(path, empty)


def stated(host: Column, path: Column, rules: list[HostRule]) -> tuple[Column, Column]:
    """The longest stated rule that fits, as text, and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A URL's tokens, each its field's name and value."""
    labels = F.split(host, r"\.")
    values = {
        "tld": F.element_at(labels, -1),
        "domain": F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))),
        "label": F.element_at(labels, 1),
        "host": host,
        "folder": F.regexp_extract(path, r"^/([^/]+)/", 1),
        "suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
        "key": F.regexp_extract(url, r"^[^?#]*\?([^=&#]+)", 1),
    }
    made = F.array(*[F.when((host != "") & (values[f] != ""), F.concat(F.lit(f + "="), values[f])) for f in FIELDS])
    return F.array_compact(made)


def described(pages: DataFrame, rules: list[HostRule], id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path, rule, stated, tokens)"""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), *[c.alias(n) for c, n in zip(host_and_path(url), ("host", "path"), strict=True)])
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("stated"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[MinedRule]:
    """Rules from rows (tokens, stated), where stated is a verdict or null; rows with null
    count among all that have a combination, so ``judge`` gives none."""
    from pyspark.ml.fpm import FPGrowth

    items = labelled.select(F.array_compact(F.array_append("tokens", F.concat(F.lit(VERDICT), F.col("stated")))).alias("items")).where(F.size("items") > 0)
    if items.isEmpty():
        return []
    frequent = FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets
    is_verdict = F.filter("items", lambda i: i.startswith(VERDICT))
    frequent = settle(frequent.select(F.array_sort(F.filter("items", lambda i: ~i.startswith(VERDICT))).alias("tokens"), F.get(is_verdict, F.lit(0)).alias("verdict"), "freq"))
    alone = frequent.where("verdict IS NULL").select("tokens", F.col("freq").alias("every"))
    strong = frequent.where("verdict IS NOT NULL AND size(tokens) > 0").join(alone, "tokens").where(F.col("freq") >= min_confidence * F.col("every"))
    found = [MinedRule(tuple(r.tokens), r.verdict.removeprefix(VERDICT), r.freq, r.freq / r.every) for r in strong.collect()]
    return pruned(found)


def pruned(rules: list[MinedRule]) -> list[MinedRule]:
    """Without rules whose verdict a rule of fewer of the same tokens gives with no
    less confidence."""
    kept: dict[tuple[frozenset, str], MinedRule] = {}
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.rank())):
        whole = frozenset(rule.tokens)
        smaller = (kept.get((part, rule.verdict)) for part in subsets(whole))
        if not any(s is not None and s.confidence >= rule.confidence for s in smaller):
            kept[whole, rule.verdict] = rule
    return sorted(kept.values(), key=MinedRule.rank)


def subsets(whole: frozenset) -> Iterator[frozenset]:
    each = sorted(whole)
    for bits in range(1, (1 << len(each)) - 1):
        yield frozenset(t for i, t in enumerate(each) if bits >> i & 1)


class Index:
    """An inverted index over mined rules: each is filed under its rarest token."""

    def __init__(self, rules: list[MinedRule]):
        often: dict[str, int] = {}
        for rule in rules:
            for t in rule.tokens:
                often[t] = often.get(t, 0) + 1
        self.under: dict[str, list[tuple[int, frozenset, str]]] = {}
        for n, rule in enumerate(sorted(rules, key=MinedRule.rank)):
            rarest = min(rule.tokens, key=lambda t: (often[t], t))
            self.under.setdefault(rarest, []).append((n, frozenset(rule.tokens), rule.verdict))

    def verdict(self, found: list[str], default: str) -> str:
        """The verdict of the first rule by rank whose tokens all are there."""
        have, best = set(found), None
        for t in have:
            for n, need, verdict in self.under.get(t, ()):
                if best is not None and n >= best[0]:
                    break
                if need <= have:
                    best = (n, verdict)
                    break
        return best[1] if best else default


def judge(pages: DataFrame, rules: list[HostRule], *, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT, mined: list[MinedRule] | None = None) -> DataFrame:
    """One row a page: page_id, host, path, rule (the stated one or null), verdict.

    Mining reads the URL column once, judging once more; nothing but FP-growth's own
    shuffles moves."""
    ready(pages.sparkSession)
    rows = described(pages, rules, id_col, url_col)
    found = mine(rows.where("stated IS NOT NULL").select("tokens", "stated"), min_support=min_support, min_confidence=min_confidence) if mined is None else mined
    index = Index(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, host, path, rule, said, have = batch.columns
            verdicts = [s or index.verdict(t, default) for s, t in zip(said.to_pylist(), have.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([page, host, path, rule, pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
