"""Quality rules with risk-controlled cutoffs (operator 6).

Base statistics come from whole texts.  On top, each rule rejects a document whose ratio passes a cutoff; the cutoffs are
chosen on labelled good documents so that, with the stated confidence over all strata together, at most ``RISK`` of a
stratum's good documents are rejected.  One sequence a stratum lowers the cutoffs of all rules together; its steps are tested from the
mildest on with the exact binomial tail (the Clopper-Pearson bound), each as a whole, and testing stops at the first that fails,
so neither steps nor rules need a further correction.  Strata share the error by Bonferroni.

Strata with too few labelled good documents for any certificate (436, where four share the error) are one more group, the pool, which takes in the
smallest of the others until it has enough.  Its risk is that of its strata taken together; the others keep cutoffs of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, filter_rows, map_rows, sent

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rules, each a ratio that is large in bad documents, and the cutoffs tried, from the mildest.
RULES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "dup_lines": "n_dup_lines / nullif(n_words, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
    "long_words": "word_chars / nullif(n_words, 0) / 100",
}
CUTOFFS = tuple(round(0.95 * 0.9**i, 6) for i in range(48))
#: Largest share of a stratum's good documents that all rules together may reject, and the chance that this fails anywhere.
RISK, ERROR = 0.01, 0.05
#: A sequence begins with the first of ``CUTOFFS`` in all rules; a rule's cutoff falls no further than this place.  Set by hand to what prose
#: doesn't come near (a third as many repeated lines as words, half of all words in repeated windows, 17 characters a word) and
#: computed from no table: symbols alone have no such place, so they decide where a sequence ends.
LAST = {"symbols": len(CUTOFFS) - 1, "dup_lines": 10, "repeats": 5, "long_words": 16}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics_of(text: str | None) -> tuple[int, int, int, int, int]:
    """``STATS`` of one whole text; zeros for null and empty ones."""
    if not text:
        return 0, 0, 0, 0, 0
    found = text.encode().split()
    n = len(found)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(" \t\n\v\f\r"):
                seen.add(line)
    return n, chars, symbols, dup, repeated_words(found)


def repeated_words(found: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more."""
    n = len(found) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in found], np.int64, len(found))
    key = ids[:n]
    for i in range(1, width):  # exact: numbers of shorter windows stay below the text's length
        key = key * len(number) + ids[i : n + i]
        if i < width - 1:
            key = np.unique(key, return_inverse=True)[1]
            if len(number) * n > 2**62:
                raise OverflowError("a text of so many words can't be numbered")
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(found), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``id_col``, ``stratum`` and ``STATS`` of every row."""
    kind = docs.schema[id_col].dataType

    def make():
        def stats(columns: list[list]) -> list[list]:
            keys, strata, texts = columns
            rows = [statistics_of(t) for t in texts]
            return [keys, strata, *([r[i] for r in rows] for i in range(len(STATS)))]

        return stats

    schema = f"{id_col} {kind.simpleString()}, stratum string, " + ", ".join(f"{s} bigint" for s in STATS)
    frame = docs.select(id_col, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text_col)
    return map_rows(frame, [id_col, "stratum", text_col], schema, make, [to_arrow_type(kind), pa.string(), *[pa.int64()] * len(STATS)])


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose_cutoffs(counts: list[int], risk: float = RISK, error: float = ERROR) -> dict[str, float]:
    """A group's cutoffs by rule after the last certified step; none if even the first can't be certified.

    counts: good documents by the number of steps (0 to all) that reject them by any rule.
    """
    n, chosen = sum(counts), {}
    rejected = np.cumsum(counts[::-1])[::-1]  # documents that at least so many steps reject
    for step in range(len(CUTOFFS)):
        hit = int(rejected[len(CUTOFFS) - step])  # cutoffs fall: what this step rejects all that follow do
        if hit > risk * n or binomial_tail(hit, n, risk) > error:
            break
        chosen = {rule: CUTOFFS[min(step, LAST[rule])] for rule in RULES}
    return chosen


def groups_of(sizes: dict[str, int], risk: float = RISK, error: float = ERROR) -> tuple[list[str], list[str], list[str]]:
    """Strata with a certificate of their own, those without, and the strata whose documents make the latters' pool.

    As many strata as possible stand alone, where the error is shared by these and, if any stratum is left, the pool.
    """
    by_size = sorted(sizes, key=lambda s: (-sizes[s], s))
    least = lambda alone: math.log(error / (alone + (alone < len(sizes)))) / math.log1p(-risk)
    m = max((m for m, s in enumerate(by_size, 1) if sizes[s] >= least(m)), default=0)
    alone, left = by_size[:m], by_size[m:]
    pool = list(left)
    while left and len(pool) < len(by_size) and sum(sizes[s] for s in pool) < least(m):
        pool.append(by_size[-len(pool) - 1])
    return alone, left, pool


def good_ids(labels: DataFrame, id_col: str) -> DataFrame:
    """Ids whose labels are all 1."""
    return labels.groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1").select(id_col)


def certified(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id") -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from all labelled good documents that the base rules let pass.

    Only counts per stratum and step reach the driver.  Strata without labelled good documents have no cutoffs.
    """
    passed = [F.expr(" + ".join(f"int(coalesce({value} > {c}D, false))" for c in CUTOFFS)).alias(rule) for rule, value in RULES.items()]
    held = stats.where(~base_failed()).join(good_ids(labels, id_col), id_col, "left_semi").select("stratum", *passed)
    # cutoffs fall: a ratio over so many is over them from that place of the end on
    steps = F.greatest(*[F.when(F.col(rule) >= len(CUTOFFS) - LAST[rule], F.col(rule)).otherwise(0) for rule in RULES])
    counts: dict[str, list[int]] = {}
    for r in held.groupBy("stratum", steps.alias("steps")).count().collect():
        counts.setdefault(r["stratum"], [0] * (len(CUTOFFS) + 1))[r["steps"]] = r["count"]
    alone, left, pool = groups_of({s: sum(c) for s, c in counts.items()}, risk, error)
    share = error / max(1, len(alone) + bool(left))
    chosen = {(s, rule): cutoff for s in alone for rule, cutoff in choose_cutoffs(counts[s], risk, share).items()}
    together = choose_cutoffs([sum(c) for c in zip(*(counts[s] for s in pool))], risk, share) if left else {}
    return chosen | {(s, rule): cutoff for s in left for rule, cutoff in together.items()}


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Every row's ``id_col``, ``STATS``, ``base_failed``, ``failed_rules`` and ``kept``.

    Null and empty texts have no words and fail the base rules.  A null stratum is one of its own.  Repeated rows are judged
    alike.  Without labels, or with too few even in the pool, only the base rules apply.  Other columns are not read.
    """
    stats = cut(document_statistics(docs, id_col, text_col, stratum_col), "quality-stats")
    chosen = certified(stats, labels, risk, error, id_col)
    rows = [(s, *(chosen.get((s, rule)) for rule in RULES)) for s in sorted({s for s, _ in chosen})]
    limits = docs.sparkSession.createDataFrame(rows, "stratum string, " + ", ".join(f"{rule} double" for rule in RULES))
    over = [F.when(F.expr(value) > F.col(f"limits.{rule}"), F.lit(rule)) for rule, value in RULES.items()]
    judged = stats.join(limits.alias("limits"), "stratum", "left").withColumns({"base_failed": base_failed(), "failed_rules": F.array_compact(F.array(*over))})
    return judged.select(id_col, *STATS, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def passes(stats: tuple[int, ...], limits: dict[str, float]) -> bool:
    """The verdict on one document's ``STATS``, as ``judge`` gives it."""
    n, chars, symbols, dup, repeats = stats
    if n < MIN_WORDS or 100 * repeats > 50 * n:
        return False
    values = {"symbols": symbols / chars, "dup_lines": dup / n, "repeats": repeats / n, "long_words": chars / n / 100}
    return not any(values[rule] > cutoff for rule, cutoff in limits.items())


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns.

    Labelled good texts are read for the cutoffs, then all for the verdicts, instead of being shuffled to meet verdicts by id.
    """
    good = sent(good_ids(labels, id_col))
    stats = cut(document_statistics(docs.join(good, id_col, "left_semi"), id_col, text_col, stratum_col), "quality-stats")
    limits: dict[str, dict[str, float]] = {}
    for (stratum, rule), cutoff in certified(stats, labels, risk, error, id_col).items():
        limits.setdefault(stratum, {})[rule] = cutoff

    def make():
        def keep(columns: list[list]) -> list[bool]:
            return [passes(statistics_of(t), limits.get("" if s is None else str(s), {})) for t, s in zip(*columns)]

        return keep

    return filter_rows(docs, [text_col, stratum_col], make)
