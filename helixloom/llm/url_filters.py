"""Verdicts on URLs by rules that are indexed by their rarest literal token.

A rule is a regular expression over host and path with the tokens (runs of
``[a-z0-9]``, lower-cased) that every URL it fits must have whole. Of these the
one that fewest URLs have, counted over all of them, is the rule's key. A URL's
tokens fetch the rules under them, and only those run their expressions; a rule
without such a token is tried on every URL.

Site rules name a host, with its subdomains, and a prefix of the path; the
longest that fits wins. Where none fits, patterns decide: an allowing one over
a blocking one, and without any the URL is allowed.

URLs stay where they are read: one pass counts tokens (its result is at most a
row for each token of the rules), one judges. Rules are configuration, at most
``MAX_RULES`` of them, and are sent to the tasks.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no site rule, and is judged by the patterns, which an empty text doesn't
fit, so it is allowed; repeated rows give repeated rows; very long URLs are read
whole; extra columns, whatever their names, are ignored; an empty table gives
an empty one. Of site rules equally long the one with the longer host wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What stands for a boundary in a pattern: a letter that is in no token, or an end.
SEPARATOR = r"(?:[^a-z0-9]|\A|\Z)"
#: Words of hosts and paths that mark unwanted sites.
UNWANTED = ("casino", "bets", "pills", "ads", "track")


class Rule(NamedTuple):
    name: str  #: as written, such as ``net/es/``
    allow: bool
    regex: str  #: searched in host and path; patterns see them lower-cased
    tokens: tuple[str, ...]  #: whole in every URL that fits
    site: bool
    rank: tuple[int, int]  #: of site rules, higher wins


def site_rule(host: str, path: str, allow: bool) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    host = host.translate(LOWER)
    whole = TOKEN.findall(host)
    # the path's last token may go on in the URL, unless a separator ends it
    inner = path.translate(LOWER)
    found = list(TOKEN.finditer(inner))
    whole += [m[0] for m in found if m.end() < len(inner)]
    regex = rf"\A(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(path)}"
    return Rule(host + path, allow, regex, tuple(dict.fromkeys(whole)), True, (len(host + path), len(host)))


def pattern_rule(pattern: str, allow: bool) -> Rule:
    """Letters stand for themselves in either case, ``*`` for any text, ``^``
    for a separator or an end, ``||`` in front for the start of a host's name."""
    text = pattern.translate(LOWER)
    anchored, body = text.startswith("||"), text.removeprefix("||")
    regex = r"\A(?:[^/]*\.)?" if anchored else ""
    regex += "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body)
    ended = lambda i: i < len(body) and body[i] != "*"
    begun = lambda i: body[i - 1] != "*" if i else anchored
    tokens = [m[0] for m in TOKEN.finditer(body) if begun(m.start()) and ended(m.end())]
    return Rule(pattern, allow, regex, tuple(dict.fromkeys(tokens)), False, (0, 0))


def unwanted(words: Iterable[str] = UNWANTED) -> list[Rule]:
    return [pattern_rule(f"^{w}^", False) for w in words]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs (host, path) have each token of the rules."""
    asked = sorted({t for r in rules for t in r.tokens})
    if not asked:
        return {}
    table = urls.sparkSession.createDataFrame([(t,) for t in asked], "token string")
    whole = F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    met = tokens.join(F.broadcast(table), "token").groupBy("token").count()  # a row for each token of the rules at most
    return {t: 0 for t in asked} | {r["token"]: r["count"] for r in met.collect()}


def indexed(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers under their rarest token (the first of equals by name),
    and those of rules without one."""
    under: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            under.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return under, always


class Judge:
    """Holds the index in a task; expressions are compiled when first asked."""

    def __init__(self, rules: list[Rule], under: dict[str, list[int]], always: list[int]):
        self.rules, self.under, self.always = rules, under, always
        self.compiled: dict[int, re.Pattern] = {}
        self.tried = 0

    def fits(self, i: int, text: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].regex, re.S)
        self.tried += 1
        return self.compiled[i].search(text) is not None

    def __call__(self, host: str, path: str) -> tuple[str | None, bool, str | None]:
        """The site rule that wins or None, the verdict, and the rule or
        pattern that gave it."""
        text = host + path
        low = text.translate(LOWER)
        asked = list(self.always)
        for token in set(TOKEN.findall(low)):
            asked += self.under.get(token, ())
        site, allows, blocks = None, [], []
        for i in asked:
            r = self.rules[i]
            if r.site:
                if (site is None or (r.rank, -i) > (site[0].rank, -site[1])) and self.fits(i, text):
                    site = (r, i)
            elif self.fits(i, low):
                (allows if r.allow else blocks).append(i)
        if site:
            return site[0].name, site[0].allow, site[0].name
        first = min(allows or blocks, default=None)
        return None, bool(allows) or not blocks, None if first is None else self.rules[first].name


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, by): ``rule`` is the site rule that
    won, ``by`` that or the pattern that decided."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rows = pages.select(F.col(key).cast("long").alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    under, always = indexed(rules, token_counts(rows.select("host", "path"), rules))
    sent = pages.sparkSession.sparkContext.broadcast((rules, under, always))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = Judge(*sent.value)
        for batch in batches:
            found = [said(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array(["allow" if x[1] else "block" for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[key, "host", "path", "rule", "verdict", "by"])

    return rows.mapInArrow(run, f"{key} bigint, host string, path string, rule string, verdict string, `by` string")
