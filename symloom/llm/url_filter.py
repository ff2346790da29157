"""Operator 9: URL verdicts by host rules, and gradient-boosted trees where no rule fits.

A rule is (host, path, verdict) and fits its host and all subdomains where the
URL's path starts with the rule's; the longest wins, of equal length the smaller.
The trees learn from URLs that a rule decides, a bounded sample of them, on
lexical features only: lengths, depth, digit ratio, entropy, parameter counts and
statistics of host suffixes. They are regression trees on the gradients of the
logistic loss, over quantile bins, and judge every other URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged on its features (those of an empty text for null);
repeated rows are judged alike; without any labelled URL every verdict of the
method is allow; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Labelled URLs at most, in expectation, that the trees are fitted on.
SAMPLE = 20_000
#: Parts of the labelled URLs; equal URLs are in one.
FOLDS = 5
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


class Rules:
    """Looks a host's suffixes up, so a list of any length costs a few lookups a URL."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((-len(host + path), host + path, path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        while host:
            for rule in self.by_host.get(host, ()):
                if path.startswith(rule[2]) and (best is None or rule < best):
                    best = rule
            host = host.partition(".")[2]
        return (best[1], best[3]) if best else (None, None)


def _entropy(s: str) -> float:
    n = np.array(list(Counter(s).values()), float)
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum()) if len(n) else 0.0


class Suffixes:
    """Smoothed shares of blocked URLs, and log counts, by the last one and two labels of the host and the first path segment."""

    def __init__(self, split: list[tuple[str, str]], y: np.ndarray):
        self.mean = float(y.mean()) if len(y) else 0.0
        self.sums: dict[str, list[float]] = {}
        for (host, path), v in zip(split, y):
            for s in self._keys(host, path):
                got = self.sums.setdefault(s, [0.0, 0.0])
                got[0] += 1
                got[1] += v

    @staticmethod
    def _keys(host: str, path: str) -> list[str]:
        labels = host.split(".")
        return [*(f"{k}:" + ".".join(labels[-k:]) for k in (1, 2)), "/" + path[1:].partition("/")[0]]

    def __call__(self, host: str, path: str) -> list[float]:
        out = []
        for s in self._keys(host, path):
            n, v = self.sums.get(s, (0.0, 0.0))
            out += [(v + 20 * self.mean) / (n + 20), float(np.log1p(n))]
        return out


def features(url: str | None, host: str, path: str, suffixes: Suffixes) -> list[float]:
    """Lexical features of one URL."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    segments = [s for s in path.split("/") if s]
    last = segments[-1] if segments else ""
    digits = sum(c in "0123456789" for c in url)
    return [
        len(url), len(host), len(path), len(query), len(segments), host.count("."), digits / max(1, len(url)),
        sum(c in "0123456789" for c in last), sum(c in "0123456789" for c in host), _entropy(url), _entropy(host), _entropy(path),
        query.count("&") + (query != ""), query.count("="), url.count("-") + url.count("_"), url.count("%"), float("#" in url),
        float(url.startswith("https://")), float(path.endswith("/")), len(last), float("." in last), max(map(len, host.split("."))),
        *suffixes(host, path),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 20, l2: float = 1.0):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.rate, self.trees = rate, []
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        b, s = self._bins(x), np.full(len(x), self.base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-s))
            tree: list = []
            s = s + rate * self._grow(tree, b, q - y, q * (1 - q), np.arange(len(x)), depth, least, l2, bins)
            self.trees.append(tree)
            if len(tree) == 1:
                break

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, tree: list, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, l2: float, bins: int) -> np.ndarray:
        """Appends the nodes (feature, bin, left, right, value) for rows; returns the values by row of b."""
        out, me = np.zeros(len(b)), len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append([-1, 0, 0, 0, -total_g / (total_h + l2)])
        best, how = 1e-6, None
        if depth and len(rows) >= 2 * least:
            for j in range(b.shape[1]):
                n, sg, sh = (np.bincount(b[rows, j], w, bins + 1).cumsum() for w in (None, g[rows], h[rows]))
                ok = (n >= least) & (n <= len(rows) - least)
                gain = sg**2 / (sh + l2) + (total_g - sg) ** 2 / (total_h - sh + l2) - total_g**2 / (total_h + l2)
                k = int(np.argmax(np.where(ok, gain, -1)))
                if ok[k] and gain[k] > best:
                    best, how = gain[k], (j, k)
        if how is None:
            out[rows] = tree[me][4]
            return out
        left = b[rows, how[0]] <= how[1]
        for side, sub in ((2, rows[left]), (3, rows[~left])):
            tree[me][side] = len(tree)
            out += self._grow(tree, b, g, h, sub, depth - 1, least, l2, bins)
        tree[me][:2] = how
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of 1."""
        b, s = self._bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            f, k, l, r, v = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), int)
            while (f[at] >= 0).any():
                inner = f[at] >= 0
                go = b[np.arange(len(x)), np.maximum(f[at], 0)] <= k[at]
                at = np.where(inner, np.where(go, l[at], r[at]), at)
            s += self.rate * v[at]
        return 1 / (1 + np.exp(-s))


def fit(urls: list[str], labels: list[int]) -> tuple[Suffixes, Trees | None]:
    """The model for labelled URLs (1: block)."""
    y = np.array(labels, float)
    split = [parts(u) for u in urls]
    suffixes = Suffixes(split, y)
    if not len(y):
        return suffixes, None
    # A row's suffix statistics are those of the other folds, so its own label is in none of its features.
    fold = np.array([zlib.crc32(u.encode("utf-8", "replace")) % FOLDS for u in urls])
    x = np.zeros((len(y), len(features("", "", "", suffixes))))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        others = Suffixes([split[i] for i in rest], y[rest])
        for i in np.flatnonzero(fold == k):
            x[i] = features(urls[i], *split[i], others)
    return suffixes, Trees(x, y)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' share for block; null without a model) for each row of pages."""
    known = Rules(rules)
    urls = pages.select(F.col("page_id").cast("string"), "url")  # pandas has no null integers

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [known.find(*parts(u))[1] for u in pdf.url]
            yield pd.DataFrame({"url": pdf.url, "verdict": got}).dropna()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [parts(u) for u in pdf.url]
            found = [known.find(h, p) for h, p in split]
            score = [None] * len(pdf)
            if trees and len(pdf):
                score = trees.score(np.array([features(u, h, p, suffixes) for u, (h, p) in zip(pdf.url, split)], float))
            said = [v or ("block" if s is not None and s >= least else "allow") for (_, v), s in zip(found, score)]
            yield pd.DataFrame({"page_id": pdf.page_id, "host": [h for h, _ in split], "path": [p for _, p in split], "rule": [r for r, _ in found], "verdict": said, "score": score})

    ids = urls.withColumn("u", F.pmod(F.xxhash64(F.lit(5), "page_id", "url"), F.lit(1 << 30)))
    n = max(1, urls.count())
    taken = ids.where(F.col("u") < F.lit(int(min(1.0, sample / n) * (1 << 30)))).select("url")
    got = sorted(map(tuple, taken.mapInPandas(label, "url string, verdict string").collect()))
    suffixes, trees = fit([u for u, _ in got], [int(v == "block") for _, v in got])
    out = urls.mapInPandas(run, "page_id string, host string, path string, rule string, verdict string, score double")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
