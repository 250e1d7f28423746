"""Weighted URL vocabulary (operator 3).

An Aho-Corasick automaton finds strict and soft terms in the lower-cased url.
A term counts where no letter or digit of any script stands on either side of it. One strict
term, or ``soft_hits`` distinct soft terms, blocks the url. Rules of host and
path come first: the longest rule that fits decides.

Nulls and edges: a null url, or one without ``://``, has an empty host and
path, fits no rule and is searched as it is (null: as empty). Repeated rows are
judged alike. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One of these is enough: pornography, gambling, malware and piracy, drugs and forgeries, spam. Phrases match with the separators that urls give them.
STRICT = (
    "adult", "bdsm", "bukkake", "camgirl", "camgirls", "erotic", "erotica", "escort", "escorts", "fetish", "hentai", "milf", "nsfw", "nude",
    "nudes", "porn", "porno", "pornos", "pornstar", "pornstars", "sex", "sexcam", "sexcams", "sexy", "striptease", "webcamsex", "xxx",
    "baccarat", "betting", "blackjack", "bookmaker", "bookmakers", "casino", "gambling", "poker", "roulette", "sportsbook",
    "keygen", "keygens", "keylogger", "malware", "nulled", "phishing", "ransomware", "spyware", "torrent", "torrents", "warez",
    "ambien", "cialis", "levitra", "oxycontin", "phentermine", "tramadol", "viagra", "xanax",
    "linkfarm", "ponzi", "spam", "spammer", "sugar-daddy", "fake-id", "fake-ids", "replica-watches", "essay-mill", "payday-loan", "payday-loans",
)
#: Several distinct ones are needed: selling, tracking, dating, easy money, downloads.
SOFT = (
    "ad", "ads", "adserver", "advert", "adverts", "affiliate", "affiliates", "banner", "banners", "clickbait", "click", "doubleclick", "popup", "popups", "sponsor",
    "sponsored", "track", "tracker", "tracking", "utm",
    "bargain", "bargains", "cashback", "cheap", "clearance", "coupon", "coupons", "deal", "deals", "discount", "discounts", "free", "freebie", "freebies",
    "promo", "voucher", "vouchers", "wholesale",
    "bet", "bets", "bonus", "crypto", "earn", "forex", "giveaway", "loan", "loans", "lottery", "lucky", "prize", "prizes",
    "spin", "sweepstakes", "win", "winner", "winners",
    "babes", "dating", "flirt", "hookup", "lingerie", "singles", "teen", "teens", "webcam",
    "crack", "farm", "hack", "hacks", "pharmacy", "pills", "proxy", "ringtones", "weight-loss",
    "backlinks", "botnet", "cracked", "doorway", "hardcore", "jackpot", "scam", "slots", "steroids", "trojan",
)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_hits: int = 2
    rules: tuple[tuple[str, str], ...] = field(default=RULES)


@cache
def _automaton(v: Vocabulary):
    import ahocorasick

    a = ahocorasick.Automaton()
    for strict, terms in ((False, v.soft), (True, v.strict)):
        for term in terms:
            a.add_word(term, (term, strict))
    a.make_automaton()
    return a


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")


def term_hits(url: str, v: Vocabulary) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of the url, at word boundaries."""
    s = url.translate(_UPPER)
    hits: tuple[set[str], set[str]] = set(), set()
    for end, (term, strict) in _automaton(v).iter(s):
        start = end - len(term) + 1
        if not (start and _ALNUM.match(s[start - 1])) and not _ALNUM.match(s[end + 1 : end + 2]):
            hits[0 if strict else 1].add(term)
    return hits


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host and the path; empty for a url without a scheme."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_UPPER), m[2]


def rule_of(host: str, path: str, v: Vocabulary) -> tuple[str | None, str | None]:
    """The longest rule that fits, with its verdict."""
    best: tuple[str | None, str | None] = None, None
    for rule, verdict in v.rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(rule) > len(best[0] or ""):
            best = rule, verdict
    return best


def _judged(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for url in batch.column("url").to_pylist():
            host, path = host_and_path(url)
            rule, verdict = rule_of(host, path, v)
            strict, soft = term_hits(url or "", v)
            verdict = verdict or ("block" if strict or len(soft) >= v.soft_hits else "allow")
            for column, x in zip(out, (host, path, rule, verdict, len(strict), len(soft))):
                column.append(x)
        types = [pa.string()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), *(pa.array(x, t) for x, t in zip(out, types))],
            names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"],
        )


def judge_urls(pages: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms) of every row."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(
        partial(_judged, v=v),
        "page_id long, host string, path string, rule string, verdict string, strict_terms long, soft_terms long",
    )


def oracle(v: Vocabulary = Vocabulary()) -> str:
    """DuckDB SQL for the same rows."""
    quote = lambda t: t.replace(".", r"\.").replace("-", r"\-")
    hit = lambda t: f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){quote(t)}($|[^\\p{{L}}\\p{{N}}])')::BIGINT"
    parts = [(r, verdict, *r.split("/", 1)) for r, verdict in v.rules]
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))" for _, _, h, p in parts]
    order = sorted(range(len(parts)), key=lambda k: -len(parts[k][0]))
    rule = "CASE " + " ".join(f"WHEN {fits[k]} THEN '{parts[k][0]}'" for k in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{x}'" for r, x, _, _ in parts)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH split AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS u,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (
  SELECT page_id, host, path, {rule} AS rule,
    {" + ".join(map(hit, v.strict))} AS strict_terms, {" + ".join(map(hit, v.soft))} AS soft_terms FROM parts)
SELECT page_id, host, path, rule,
  {verdict} WHEN strict_terms >= 1 OR soft_terms >= {v.soft_hits} THEN 'block' ELSE 'allow' END AS verdict,
  strict_terms, soft_terms FROM ruled"""
