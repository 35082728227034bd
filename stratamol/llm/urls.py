"""URL filters: host and path rules, else logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small table of labelled URLs; its weights have a fixed size and go to the tasks
with the code.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import _BYTE, mix
from .common import text_slices

#: Rules as (host/path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: The labelled table's words. Unwanted: the categories of public block lists (gambling, medicines, adult, loans and prizes,
#: piracy, malware, advertising). Wanted: institutions and subjects. Names are made of two words, or one, by rule.
UNWANTED = (
    "casino", "poker", "roulette", "blackjack", "jackpot", "slots", "bingo", "lotto", "betting", "bets", "pills", "viagra", "cialis", "steroids", "pharma", "weightloss",
    "adult", "erotic", "nude", "escort", "webcam", "xxx", "porn", "sexy", "payday", "loans", "forex", "crypto", "prizes", "giveaway", "warez", "torrent", "keygen",
    "cracked", "malware", "phishing", "spam", "spyware", "ads", "adserver", "banners", "popunder", "clicks", "affiliate", "replica", "cheap", "freebie", "discount",
)
WANTED = (
    "library", "museum", "science", "archive", "weather", "garden", "recipes", "history", "travel", "school", "journal", "college", "council", "health", "music", "books",
    "maps", "sports", "hospital", "parliament", "research", "theatre", "cinema", "church", "bakery", "cycling", "railway", "energy", "ocean", "forest", "village", "chess",
    "letters", "photo", "physics", "biology", "poetry", "gallery", "harbour", "kitchen", "language", "lawyers", "market", "mountain", "orchestra", "painting", "radio",
)
TAILS = ("online", "world", "club", "shop", "zone", "daily", "network", "hub", "point", "centre", "house", "team", "plus", "now", "guide", "today")
STARTS, VOWELS, ENDS = ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "st", "tr", "pl", "th", "sh"), ("a", "e", "i", "o", "u", "ea", "io"), ("", "n", "r", "l", "s", "nd", "th")
FORMS = ("https://{}.org/en/{}", "http://www.{}.com/{}.html", "https://blog.{}.net/fr/{}?page=2&ref=x", "http://m.{}.info/es/{}/", "https://{}.co.uk/de/{}#top", "http://{}.example.com/{}", "https://www.{}.example.org/a/{}")
#: Names of each word, and invented names for each of these.
NAMES, INVENTED = 5, 6
SIZES, BUCKETS = (3, 4, 5), 1 << 16


def labelled_names() -> list[tuple[str, str, int]]:
    """(name, its word, 1 for block): words alone and with a tail, and invented names of two or three syllables."""
    out = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for k, word in enumerate(words):
            ends = ["", *(("-", "")[j % 2] + TAILS[(7 * k + 3 * j) % len(TAILS)] for j in range(NAMES - 1))]
            out += [(word + e, word, label) for e in ends]
    for k in range(INVENTED * len(WANTED)):
        at, name = k, ""
        for _ in range(2 + k % 2):
            at = (at * 1103515245 + 12345) % (1 << 31)
            name += STARTS[(at >> 16) % len(STARTS)] + VOWELS[(at >> 9) % len(VOWELS)] + ENDS[(at >> 4) % len(ENDS)]
        out.append((name, name, 0))
    return out


def labelled_urls(names=None) -> list[tuple[str, int]]:
    """The labelled table, two URLs for each name: 1 for block."""
    names = labelled_names() if names is None else names
    return [(FORMS[(k + j) % len(FORMS)].format(name, 100 + 37 * k), label) for k, (name, _, label) in enumerate(names) for j in (0, 3)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty where there is no "://"."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    stop = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:stop]


def features(data: np.ndarray, offsets: np.ndarray):
    """(text index, bucket) of every character n-gram; texts are byte strings."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out_d, out_b = [], []
    b = _BYTE[data]
    h = np.zeros(len(b), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + b[n - 1 :]
        if n in SIZES:
            own = doc[:m] == doc[n - 1 :]
            out_d.append(doc[:m][own])
            out_b.append((mix(h[own] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_d), np.concatenate(out_b)


_DIGITS = str.maketrans("0123456789", "0" * 10)


def _text(host: str, path: str) -> str:
    """What n-grams are taken of; digits count alike."""
    return f"^{host}${path}$".translate(_DIGITS)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, data, offsets) -> np.ndarray:
        n = len(offsets) - 1
        d, b = features(data, offsets)
        grams = np.maximum(1, np.bincount(d, minlength=n))
        return np.bincount(d, self.weights[b], n) / np.sqrt(grams) + self.bias


def train(labelled: list[tuple[str, int]], steps: int = 200, rate: float = 0.5, l2: float = 1e-5) -> Model:
    """Full-batch AdaGrad on the log loss; n-gram counts are scaled by the root of their number. Without rows every score
    is the same, below one half; one label only gives a model of this label."""
    texts = [_text(*split_url(u)) for u, _ in labelled]
    y = np.array([v for _, v in labelled], float)
    if not len(y):
        return Model(np.zeros(BUCKETS), -1.0)
    _, _, data, offsets = next(iter(text_slices(pa.array(texts), 1 << 30)))
    d, b = features(data, offsets)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(d, minlength=len(y))))
    w, bias = np.zeros(BUCKETS), 0.0
    seen, seen_bias = np.full(BUCKETS, 1e-12), 1e-12
    for _ in range(steps):
        z = np.bincount(d, w[b], len(y)) * scale + bias
        err = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.bincount(b, (err * scale)[d], BUCKETS) + l2 * w
        seen, seen_bias = seen + g * g, seen_bias + err.sum() ** 2
        w -= rate * g / np.sqrt(seen)
        bias -= rate * err.sum() / np.sqrt(seen_bias)
    return Model(w, bias)


@lru_cache(4)
def default_model() -> Model:
    return train(labelled_urls())


def url_parts(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, upper, lower), path


def url_filter(pages: DataFrame, rules=RULES, model: Model | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of each row; score is the model's probability of block.

    Of the rules that fit the longest decides, else the model: block at the threshold or above. A null url, or one without
    "://", has empty host and path and no rule. Rows are treated one by one: repeated rows give repeated results; other
    columns, whatever their names, are ignored; an empty table gives an empty result."""
    model = model or default_model()
    by_length = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    verdicts = dict(rules)
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = url_parts(F.coalesce(F.col(url_col), F.lit("")))
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule = F.lit(None).cast("string")
    for r, _ in reversed(by_length):
        h, p = r.split("/", 1)
        rule = F.when(((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(f"/{p}")), r).otherwise(rule)
    d = d.withColumn("rule", rule)

    def run(batches):
        for batch in batches:
            hosts, paths, fit = (batch.column(k).to_pylist() for k in (1, 2, 3))
            texts = pa.array([_text(h, p) for h, p in zip(hosts, paths, strict=True)], pa.string())
            scores = [1 / (1 + np.exp(-model.logits(data, offsets))) for _, _, data, offsets in text_slices(texts)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            verdict = [verdicts[r] if r else "block" if s >= threshold else "allow" for r, s in zip(fit, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "score", "verdict"])

    return d.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, score double, verdict string")
