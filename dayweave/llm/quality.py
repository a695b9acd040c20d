"""Quality rules on documents, and verdicts on the hosts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dayweave.llm.text import SPACES, WORD, let, word_count
from dayweave.sources import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
# Documents that the prior of hosts counts for at least.
LEAST_PRIOR = 1.0
WINDOW = 3


def n_symbols(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def word_chars(text: str) -> Column:
    """Code points inside words."""
    kept = F.length(text) - F.coalesce(F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")), F.lit(0))
    return F.coalesce(kept, F.lit(0)).cast("long")


def n_dup_lines(text: str) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: str) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    The windows of a text are sorted with their positions, so equal ones stand side by side;
    n log n for a text of n words, without comparing all windows with each other.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def windows(w):
        starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)))
        at = lambda i, k: F.element_at(w, i + k)
        return F.sort_array(
            F.transform(
                F.coalesce(starts, F.array().cast("array<int>")),
                lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("gram"), i.alias("at")),
            )
        )

    def repeated(s):
        same = lambda i, j: F.element_at(s, i)["gram"] == F.element_at(s, j)["gram"]
        n = F.size(s)
        found = F.filter(
            s,
            lambda x, j: F.when(j > 0, same(F.greatest(j, F.lit(1)), j + 1)).otherwise(False)
            | F.when(j + 1 < n, same(j + 1, F.least(j + 2, n))).otherwise(False),
        )
        covered = F.flatten(F.transform(found, lambda x: F.sequence(x["at"], x["at"] + (WINDOW - 1))))
        return F.size(F.array_distinct(covered))

    return let(let(words, windows), repeated).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """The columns of `docs` and what the rules on a single document count and decide.

    A missing or empty text has no words and fails; ties do not arise, as each document is
    judged alone, repeated rows alike. Columns of `docs` with the names of counts are replaced.
    """
    counted = docs.withColumns(
        {
            "n_words": word_count("text"),
            "word_chars": word_chars("text"),
            "n_symbols": n_symbols("text"),
            "n_dup_lines": n_dup_lines(F.col("text")),
            "n_repeat_words": n_repeat_words(F.col("text")),
        }
    )
    return counted.withColumn("base_failed", _fails(F.col("n_words"), F.col("n_repeat_words")))


def _fails(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def host_rates(judged: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """Per host the failure rate of its documents, shrunk towards the mean of all hosts.

    The beta prior is fitted to the hosts' own counts by moments: with pooled rate m and
    between-host correlation r, its weight is 1/r - 1 documents. Where hosts differ no more
    than chance explains, r is 0 and every host gets the pooled rate. Documents without a host
    belong to none and are not counted. Empty input gives no host.
    """
    by_host = (
        judged.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    )
    by_host = materialize(by_host, "hosts")
    n, bad = F.col("n_docs"), F.col("n_failed")
    # One row of sums, whatever the number of hosts.
    s = by_host.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(n).alias("docs"),
        F.sum(bad).alias("failed"),
        F.sum(n.cast("double") * n).alias("squares"),
        F.sum(bad.cast("double") * bad / n).alias("rates"),
    ).first()
    mean = s["failed"] / s["docs"] if s["docs"] else 0.0
    weight = _prior_weight(s, mean)
    if weight is None:
        rate = F.lit(float(mean))
    else:
        rate = (bad + weight * mean) / (n + weight)
    return by_host.withColumn("rate", rate)


def _prior_weight(s, mean: float) -> float | None:
    """Documents the prior counts for; None means that it outweighs any host."""
    spread = mean * (1 - mean)
    if s["hosts"] < 2 or spread == 0:
        return None
    excess = (s["rates"] - s["docs"] * mean * mean) / spread - (s["hosts"] - 1)
    scale = s["docs"] - s["squares"] / s["docs"] - (s["hosts"] - 1)
    if excess <= 0 or scale <= 0:
        return None
    return max(scale / excess - 1, LEAST_PRIOR)


def judge(docs: DataFrame, columns: list[str], host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """`columns` of every document with the rules' counts, `base_failed` and `kept`.

    A document is kept if it passes the rules itself and its host does not fail them in more
    than `max_rate` of its documents by the shrunk rate. Documents without a host are judged
    alone. Only counts travel: texts are read once, and the narrow table they give is written
    and used for the hosts and for the join of their verdicts back.
    """
    wanted = list(dict.fromkeys([*columns, host]))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = materialize(base_rules(docs).select(*[c for c in wanted if c not in counts], *counts), "rules")
    bad = _bad_hosts(base, host, max_rate, "base_failed")
    joined = base.join(bad, base[host] == F.col("__host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad")


def _bad_hosts(judged: DataFrame, host: str, max_rate: float, failed: str) -> DataFrame:
    bad = host_rates(judged, host, failed).where(F.col("rate") > max_rate)
    return bad.select(F.col(host).alias("__host"), F.lit(True).alias("__bad"))


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that the rules and their hosts' verdicts keep, with the columns of `docs`.

    The rules run over every text twice, once for the hosts and once for the documents: texts are
    neither written nor, unless the bad hosts are many, shuffled.

    A missing or empty text has no words and goes; a text of any length is judged whole. A row
    without a host is judged alone. Repeated rows are judged each, alike, and a rate of exactly
    `max_rate` keeps the host. An empty table gives none; all columns are kept, whatever their names.
    """
    failed = _fails(word_count("text"), n_repeat_words(F.col("text")))
    bad = _bad_hosts(docs.select(host, failed.alias("__failed")), host, max_rate, "__failed")
    passed = docs.where(~failed)
    return passed.join(bad, passed[host] == F.col("__host"), "left_anti")
