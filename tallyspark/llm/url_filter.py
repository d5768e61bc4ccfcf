"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is (host, path prefix, block or allow); it fits its host and all subdomains where the path begins with the
prefix; of the rules that fit, the one with the most characters wins (a block in a tie). Where none fits, the model decides. It is fitted
once, on the driver, on a small labelled table (the one below, or the caller's); the model is a fixed
number of weights. N-grams of 3 to 5 characters are taken from ``host`` between ``^`` and ``$`` and from ``path``, the two kinds hashed apart.

A null url, or one without ``://``, has an empty host and path and no rule; the model sees no n-grams and its bias decides
(allow, as most of the table is). Very long urls are read whole. Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The small labelled table, from common knowledge of what blocklists name (their usual categories) and what people read: site names made of a
#: topic and a second word, by the rule in ``labelled``.
BLOCK_TOPICS = {
    "gambling": "casino poker roulette jackpot bingo betting slots lottery baccarat wager".split(),
    "adult": "porn adult xxx sex escort nude camgirl fetish erotic webcam-girls".split(),
    "drugs": "viagra cialis pharmacy pills steroids tramadol weightloss diet-pills meds painkiller".split(),
    "money": "payday loans quick-cash forex get-rich bitcoin-doubler debt credit-fix investment-scam refinance".split(),
    "piracy": "warez torrent crack keygen serials nulled cracked-games pirate free-movies streams-hd".split(),
    "ads": "ads adserver banner popunder clicks tracker tracking affiliate pixel adclick".split(),
    "spam": "spam backlinks link-exchange doorway seo-boost traffic-bot replica fake-watches clickbait malware".split(),
}
BLOCK_SECOND = "online free cheap best hot win bonus deals 24 now".split()
KEEP_TOPICS = {
    "public": "library museum council university school hospital archive court parliament fire-brigade".split(),
    "nature": "garden weather forest river mountain birds ocean geology astronomy seeds".split(),
    "home": "recipes baking knitting woodwork furniture kitchen parenting painting pottery repair".split(),
    "culture": "theatre novels poetry orchestra film-review history philosophy language letters gallery".split(),
    "science": "physics chemistry biology medicine statistics mathematics genetics climate robotics software".split(),
    "places": "travel railway harbour village market maps bridges castles hiking island".split(),
    "sport": "football cycling swimming chess rowing athletics tennis climbing running skating".split(),
}
KEEP_SECOND = "journal notes club society review daily house world guide group".split()
#: Names that mean nothing, as most hosts are: syllables put together by a rule.
SYLLABLES = "ba re lo ti nu ka ve mi so du fa li no ter an ing or es al en ur ath on is".split()


def labelled() -> list[tuple[str, str, int, str]]:
    """(host, path, 1 to block, name): the table, the name telling which rows stand and fall together in a held-out test.

    Each topic alone and with two second words before or after it, and names without meaning to keep; subdomains, endings,
    languages and page numbers are dealt alike to both classes, so that only names tell them apart.
    """
    names: list[tuple[str, int]] = []
    for topics, second, y in ((BLOCK_TOPICS, BLOCK_SECOND, 1), (KEEP_TOPICS, KEEP_SECOND, 0)):
        for i, topic in enumerate(t for some in topics.values() for t in some):
            names += [(topic, y), (f"{topic}-{second[i % 10]}", y), (f"{second[(i + 3) % 10]}-{topic}", y)]
    n = len(SYLLABLES)
    names += [("".join(SYLLABLES[(7 * i + k * (3 + i // n)) % n] for k in range(2 + i % 3)), 0) for i in range(240)]
    out = []
    for i, (name, y) in enumerate(names):
        for j, sub in enumerate(("", "www.", "m.")):
            host = f"{sub}{name}.{'example.' * (i % 2)}{('com', 'org', 'net', 'info')[(i // 2 + j) % 4]}"
            out.append((host, f"/{('en', 'de', 'fr', 'es')[(i + j) % 4]}/{(37 * i + 251 * j) % 1000}", y, name))
    return out


def grams(host: str, path: str, size: int) -> np.ndarray:
    """Hashed n-grams, each once."""
    found = set()
    for kind, s in (("h", f"^{host}$" if host else ""), ("p", path)):
        for n in (3, 4, 5):
            found.update(zlib.crc32(f"{kind}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % size for i in range(len(s) - n + 1))
    return np.fromiter(found, np.int64, len(found))


class UrlModel:
    """Logistic regression on hashed n-grams: a fixed number of weights. rows: (host, path, 1 to block, ...)."""

    def __init__(self, rows: list[tuple], size: int = 1 << 16, ridge: float = 0.002, rounds: int = 300, rate: float = 0.3):
        self.size = size
        cells = [grams(r[0], r[1], size) for r in rows]
        y = np.array([r[2] for r in rows], dtype=np.float64)
        columns = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.int64)
        n = np.array([len(c) for c in cells], np.int64)
        row, column = np.repeat(np.arange(len(rows)), n), np.searchsorted(columns, np.concatenate([*cells, np.zeros(0, np.int64)]))
        value = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
        w, b = np.zeros(len(columns)), 0.0
        for _ in range(rounds):
            s = 1 / (1 + np.exp(-(np.bincount(row, value * w[column], len(rows)) + b)))
            w -= rate * (np.bincount(column, value * (s - y)[row], len(columns)) / max(1, len(rows)) * 50 + ridge * w)
            b -= rate * (s - y).sum() / max(1, len(rows))
        self.bias, self.weights = b, np.zeros(size, np.float32)
        self.weights[columns] = w

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that each url should be blocked; each distinct one is worked out once."""
        at: dict[tuple[str, str], int] = {}
        which = [at.setdefault(u, len(at)) for u in zip(hosts, paths)]
        cells = [grams(h, p, self.size) for h, p in at]
        n = np.array([len(c) for c in cells], np.int64)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[np.concatenate([*cells, np.zeros(0, np.int64)])], len(n))
        return (1 / (1 + np.exp(-(sums / np.sqrt(np.maximum(n, 1)) + self.bias))))[which] if at else np.zeros(0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written host + path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):  # later ones stand further out and win
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rows: list[tuple] | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and block_score, the model's probability that the url should be blocked, null where a rule decides."""
    model = UrlModel(labelled() if rows is None else rows)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series, rule: pd.Series) -> pd.Series:
        out, free = np.full(len(host), np.nan), rule.isna().to_numpy()
        out[free] = model.scores(host[free].tolist(), path[free].tolist())
        return pd.Series(out)

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    url = F.col("url").cast("string")
    known = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = known.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    known = known.withColumn("block_score", F.nanvl(score("host", "path", "rule"), F.lit(None).cast("double")))
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return known.select("page_id", "host", "path", "rule", F.coalesce("fixed", own).alias("verdict"), "block_score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"))
