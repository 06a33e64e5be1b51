"""URL filters: rules, and logistic regression on hashed character n-grams (operator 1).

Host and path are cut out natively. A rule (host and path, allow or block) fits its host and all
subdomains where the path starts with the rule's; the longest that fits decides. Elsewhere the model
does: character n-grams of host and path, hashed to a fixed number of buckets apart from each other,
trained from a small labelled table of URLs in numpy. The weights (2 ** BITS numbers, a fixed size)
travel with the function; no shuffle is needed.

Edge cases: a null URL or one without ``://`` has empty host and path, no rule, and the verdict of
the model for empty strings; a URL without path fits no rule, since a rule's path is at least ``/``;
equally long rules (ties) are decided by their order in the list; repeated rows are judged alike; URLs
of any length are read whole; an empty table gives an empty one; other columns pass through, and those
named like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.llm.common import map_text, own_names, plain_names, quoted

BITS = 14
SIZES = (2, 3, 4, 5)

# The rules (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# The labelled URL table (1: block).
LABELLED = (
    ("https://en.example.org/wiki/Byte", 0), ("https://docs.example.org/3/library/json.html", 0), ("https://www.example.edu/courses/algebra/", 0),
    ("https://news.example.org/science/2024/telescope", 0), ("http://blog.example.net/travel/alps.html", 0), ("https://shop.example.net/books/history", 0),
    ("https://city.example.gov/services/library", 0), ("https://m.example.org/sport/results", 0), ("https://forum.example.net/thread/gardening", 0),
    ("https://journal.example.edu/articles/2021/17", 0), ("https://recipes.example.net/bread/rye", 0), ("https://weather.example.org/forecast/north", 0),
    ("https://museum.example.org/en/exhibitions", 0), ("https://code.example.org/project/readme", 0), ("https://music.example.net/albums/1999", 0),
    ("https://www.example.org/de/impressum", 0), ("https://data.example.gov/tables/census", 0), ("https://health.example.org/advice/sleep", 0),
    ("https://school.example.edu/timetable", 0), ("https://maps.example.net/en/route", 0), ("https://law.example.org/cases/77", 0), ("https://blog.example.org/en/12.html", 0),
    ("http://free-casino.example.net/win/bonus", 1), ("https://casino-slots.example.org/play", 1), ("https://cheap-pills.example.net/buy-now", 1),
    ("http://spam-mails.example.org/click?id=7", 1), ("https://ads.example.net/banner/300x250", 1), ("https://ad-server.example.org/track?uid=1", 1),
    ("https://tracker.example.net/pixel.gif", 1), ("https://xxx-videos.example.org/hot", 1), ("http://adult-chat.example.net/live", 1),
    ("https://malware-download.example.org/setup.exe", 1), ("http://phishing-login.example.net/bank/verify", 1), ("https://seo-links.example.org/backlinks", 1),
    ("https://link-farm.example.net/page/1", 1), ("http://content-farm.example.org/top10", 1), ("https://clickbait.example.net/you-wont-believe", 1),
    ("https://porn.example.org/free", 1), ("https://replica-watches.example.net/sale", 1), ("https://win-prizes.example.org/lottery", 1),
    ("http://torrent-crack.example.net/keygen", 1), ("https://spam-farm.example.org/de/1.html", 1), ("https://ads-track.example.net/en/2", 1), ("https://bet-poker.example.org/bonus", 1),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(h: Column, p: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for name, r in sorted(enumerate(rules), key=lambda x: (len(x[1][1]), -x[0])):
        name, r = r
        at = r.index("/")
        fits = ((h == r[:at]) | F.endswith(h, F.lit("." + r[:at]))) & F.startswith(p, F.lit(r[at:]))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def grams(h: bytes, p: bytes) -> np.ndarray:
    """Buckets of the character n-grams of host and path, each with its ends marked; host and path are told apart by the seed."""
    out = []
    for part, seed in ((b"^" + h + b"$", 1), (b"^" + p + b"$", 2)):
        if part.isascii():
            out += [zlib.crc32(part[i : i + n], seed) for n in SIZES for i in range(max(0, len(part) - n + 1))]
        else:
            chars = part.decode("utf-8", "replace")
            out += [zlib.crc32(chars[i : i + n].encode(), seed) for n in SIZES for i in range(max(0, len(chars) - n + 1))]
    return np.array(out, np.int64) & ((1 << BITS) - 1)


def split(url: str) -> tuple[bytes, bytes]:
    _, mark, rest = url.partition("://")
    if not mark:
        return b"", b""
    at = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    tail = rest[at:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:at].translate(lower).encode(), tail[:end].encode()


class UrlModel:
    """Logistic regression; a URL's n-grams weigh 1/sqrt(n) each."""

    def __init__(self) -> None:
        self.weight = np.zeros(1 << BITS, np.float32)
        self.bias = 0.0

    def train(self, table: Sequence[tuple[str, int]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4, seed: int = 1) -> UrlModel:
        rng = np.random.default_rng(seed)
        x = [grams(*split(u)) for u, _ in table]
        for epoch in range(epochs):
            for i in rng.permutation(len(table)):
                scale = 1 / np.sqrt(max(1, len(x[i])))
                z = float(self.weight[x[i]].sum() * scale + self.bias)
                g = 1 / (1 + np.exp(-z)) - table[i][1]
                lr = rate / (1 + 0.05 * epoch)
                np.add.at(self.weight, x[i], np.float32(-lr * g * scale))
                self.weight *= 1 - lr * decay
                self.bias -= 0.1 * lr * g
        return self

    def probability(self, hosts: Sequence[bytes], paths: Sequence[bytes]) -> np.ndarray:
        x = [grams(h, p) for h, p in zip(hosts, paths, strict=True)]
        z = np.array([self.weight[g].sum() / np.sqrt(max(1, len(g))) for g in x]) + self.bias
        return 1 / (1 + np.exp(-z))


def judge(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Append host, path, rule, verdict and block_probability; the model scores every URL, a rule overrides it."""
    model = model or UrlModel().train(LABELLED)
    outputs = ("host", "path", "rule", "verdict", "block_probability")
    stay = [c for c in (pages.columns if keep is None else keep) if c.lower() not in outputs]
    url = quoted(url_col).cast("string")

    def run(lines):
        at = [n if n >= 0 else len(line) for line in lines for n in (line.find(b"/"),)]
        return (pa.array(model.probability([line[:n] for line, n in zip(lines, at, strict=True)], [line[n:] for line, n in zip(lines, at, strict=True)]), pa.float64()),)

    cut = plain_names(pages, stay, host(url).alias("host"), path(url).alias("path"))
    # no host holds a slash, and a path is empty or begins with one, so joined they can be told apart
    lines = cut.withColumn("line", F.concat("host", "path"))
    scored = map_text(lines, "line", [("p", T.DoubleType(), pa.float64())], run, cut.columns)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("p") >= threshold, "block").otherwise("allow")
    return own_names(scored, stay, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), F.col("p").alias("block_probability"))
