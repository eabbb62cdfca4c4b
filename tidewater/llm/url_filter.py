"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: from there up to `?`, `#` or end. A null URL,
or one without `://`, has both empty, fits no rule, and gets the model's verdict on empty fields. A rule fits its host and
all subdomains of it where the path starts with the rule's path; the longest rule wins. Repeated rows each get a row, null
ids stay null, an empty table gives an empty result, and other columns are ignored, whatever their names. Rules of one length that
fit alike: the later in order of their text. Long URLs are scored whole; a null or empty one scores by its empty fields.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path, verdict) of the rules.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

# The labelled URLs that the model is trained on.
BLOCKED = """
http://casino-win.test/slots https://www.casino-royal.test/play http://best-casino.test/bonus/7 https://m.casino-win.invalid/en/12
http://free-bets.test/odds https://www.sport-bets.test/free/3 http://m.free-bets.invalid/de/77.html https://betting-tips.test/win
http://cheap-pills.test/order https://www.pills-online.test/buy/9 http://blog.cheap-pills.invalid/fr/81 https://cheap-meds.test/pharmacy
http://adult-x.test/video https://www.adult-chat.test/cam/5 http://blog.adult-x.invalid/es/440 https://xxx-tube.test/free
http://spam-farm.test/page https://www.spam-links.test/seo/2 http://m.spam-farm.invalid/en/9 https://link-farm.test/backlinks
http://ads-track.test/click https://pixel.ads-track.invalid/en/31 http://www.track-ads.test/banner https://ad-server.test/impression
https://www.win-prize.test/claim http://fast-loan.test/apply http://crypto-double.test/invest https://replica-watch.test/sale
""".split()
ALLOWED = """
http://www.weather.test/today https://blog.garden.test/roses/3 http://m.theatre.invalid/en/12 https://history-club.test/castles
http://museum.test/open https://www.library.test/books/7 http://blog.travel-notes.invalid/de/77.html https://recipes.test/soup
http://university.test/courses https://www.hospital.test/visit/9 http://blog.knitting.invalid/fr/81 https://news-desk.test/world
http://city-council.test/minutes https://www.cycling.test/forum/5 http://m.astronomy.invalid/es/440 https://open-source.test/docs
http://mathematics.test/proof https://www.street-maps.test/maps/2 http://m.physics.invalid/en/9 https://hand-made.test/crafts
http://railway.test/timetable https://www.choir.test/en/31 http://orchestra.test/music https://mountain.test/trail
https://www.bakery.test/fr/501?page=2 http://blog.chess.test/en/16 http://archive.invalid/de/3#top https://m.nature.test/es/18/
https://www.science.test/fr/5 http://school.invalid/en/66.html https://blog.painting.test/de/104 http://farming.test/es/7
""".split()

BITS, GRAMS = 18, (3, 4, 5)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where there is no `://`. Only the first `://` counts."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    tail = F.coalesce(F.substr(url, F.length(rest) + 4), F.lit(""))
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a longer rule overrides
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def slots(host: str, path: str) -> list[int]:
    """Hashed n-grams, each once: a URL that repeats one is no surer."""
    out = set()
    for tag, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32((tag + text[i : i + n]).encode("utf-8", "surrogatepass")) >> (32 - BITS) for i in range(len(text) - n + 1))
    return sorted(out)


def split_url(url: str) -> tuple[str, str]:
    tail = url.split("://", 1)[1] if "://" in url else ""
    cut = min([tail.find(c) for c in "/?#" if c in tail] or [len(tail)])
    path = tail[cut:]
    return tail[:cut].lower(), path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


@cache
def model(rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias, by full gradient descent on the labelled table."""
    rows = [(np.array(slots(*split_url(u))), y) for y, urls in ((1.0, BLOCKED), (0.0, ALLOWED)) for u in urls]
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        g, gb = ridge * w, 0.0
        for s, y in rows:
            e = 1 / (1 + np.exp(-(w[s].sum() / np.sqrt(max(len(s), 1)) + b))) - y
            g[s] += e / np.sqrt(max(len(s), 1)) / len(rows) * 4
            gb += e / len(rows)
        w, b = w - rate * 8 * g, b - rate * gb
    return w, b


def filter_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict, score (the model's probability that the URL is to be blocked)."""
    w, b = model()
    used = np.flatnonzero(w)
    weights = pages.sparkSession.sparkContext.broadcast((used, w[used].astype("f4"), b))  # as many as the labelled table has n-grams

    @F.pandas_udf("double")
    def blocked(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        at, value, bias = weights.value
        dense = np.zeros(1 << BITS)
        dense[at] = value
        out = []
        for h, p in zip(hosts, paths, strict=True):
            s = slots(h, p)
            out.append(1 / (1 + np.exp(-(dense[s].sum() / np.sqrt(max(len(s), 1)) + bias))))
        return pd.Series(out, dtype="float64")

    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("_ruled"), blocked("host", "path").alias("score"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
