"""URL verdicts: rules first, else logistic regression on hashed character n-grams of host and path (operator 4)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_table import labelled_urls

BITS, SIZES = 16, (3, 4, 5)
#: Rules: verdict, host (it and all its subdomains) and path prefix.  The longest that fits wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (from there to a query or fragment); empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: F.Column, path: F.Column, rules: tuple = RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule's name (host and path prefix) and verdict; nulls if none fits."""
    name = verdict = F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def ngram_slots(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all texts (each between marks), text by text for each n, and the text of each."""
    flat = np.frombuffer(b"".join([b"\x02" + t + b"\x03\0\0\0\0" for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 6 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    slots, owners = [], []
    for n in SIZES:
        h, count = np.full(max(0, len(flat) - n + 1), n, np.uint64), max(0, len(flat) - n + 1)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + flat[j : count + j] + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        real = (flat[:count] > 0) & (flat[n - 1 :] > 0)  # none begins in the zeros after a text and ends in the next
        slots.append((h[real] >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(owner[:count][real])
    return np.concatenate(slots), np.concatenate(owners)


class UrlModel:
    """Logistic regression; a text's features are its n-grams' counts over the root of their number."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits, self.w, self.c = bits, np.zeros(1 << bits), 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        slots, owner = ngram_slots(texts, self.bits)
        n = np.bincount(owner, minlength=len(texts))
        return np.bincount(owner, self.w[slots], len(texts)) / np.sqrt(np.maximum(n, 1)) + self.c

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 1e-5) -> UrlModel:
        """Full-batch gradient steps on the cross-entropy, each weight's by the root of its squared gradients so far (rare n-grams count)."""
        slots, owner = ngram_slots(texts, self.bits)
        used, place = np.unique(slots, return_inverse=True)
        share = (1 / np.sqrt(np.bincount(owner, minlength=len(texts))))[owner]
        w, past, past_c = np.zeros(len(used)), np.full(len(used), 1e-12), 1e-12
        for _ in range(steps):
            err = 1 / (1 + np.exp(-np.bincount(owner, w[place] * share, len(texts)) - self.c)) - labels
            g, g_c = np.bincount(place, err[owner] * share, len(used)) / len(texts) + decay * w, err.mean()
            past, past_c = past + g * g, past_c + g_c * g_c
            w -= rate * g / np.sqrt(past)
            self.c -= rate * g_c / np.sqrt(past_c)
        self.w[used] = w
        return self


def key_of(host: str, path: str) -> bytes:
    return f"{host}{path}".encode()


def train(labelled: Iterable[tuple[str, int]] | None = None, bits: int = BITS) -> UrlModel:
    """A model from a small labelled table (on the driver); by default the one that ``url_table`` makes."""
    texts, y = [], []
    for url, label in labelled or labelled_urls():
        rest = url.partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        texts.append(key_of(host.lower(), slash + path))
        y.append(label)
    return UrlModel(bits).fit(texts, np.array(y))


def train_table(table: DataFrame, url_col: str = "url", label_col: str = "label", most: int = 100_000, bits: int = BITS) -> UrlModel:
    """A model from a table of labelled URLs (1 for block), which must be small: over ``most`` rows are refused."""
    rows = table.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(url_col, label_col).limit(most + 1).collect()
    if not 0 < len(rows) <= most:
        raise ValueError(f"1 to {most} labelled URLs are needed")
    return train([(r[0], r[1]) for r in sorted(rows)], bits)


def judge(pages: DataFrame, model: UrlModel | None = None, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``score`` (of the model; null where a rule decides) and ``verdict`` of every row.

    A null url, or one without ``://``, has empty host and path, fits no rule and is scored as an empty text.  Null ids and
    repeated rows are kept; other columns are not read.  Only rows without a rule reach the model.
    """
    model = model or train()

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        # half a megabyte of weights, sent with the task whatever the input
        texts = [key_of(h, p) if h is not None else b"" for h, p in zip(host, path)]
        return pd.Series(1 / (1 + np.exp(-model.logits(texts)))) if texts else pd.Series([], dtype=float)

    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": name, "said": verdict})
    open_ = F.col("rule").isNull()
    scored = ruled.withColumn("score", score(F.when(open_, F.col("host")), F.when(open_, F.col("path")))).withColumn("score", F.when(open_, F.col("score")))
    decided = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", "score", decided.alias("verdict"))
