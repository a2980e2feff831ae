"""Quality rules of documents and of their hosts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from geostat_spark.llm.text import SPACES, words
from geostat_spark.session import cut

WINDOW = 5
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every document.

    Repeated windows are found by sorting (hash, place) pairs, so a text of n words costs n log n. What a lambda
    reads besides its element is a column of an earlier projection: an expression there would be evaluated anew
    for every element."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.col(host).alias("host"), whole.alias("whole"))
    rows = rows.withColumn("words", words(F.col("whole")))
    lines = F.filter(F.split("whole", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    at = F.sequence(F.lit(0), F.size("words") - WINDOW)
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]))
    rows = rows.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("whole", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("whole") - F.char_length(F.translate("whole", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") > WINDOW, windows).alias("windows"),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    places = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("places", F.when(again, places)).drop("windows")
    at_place = lambda j: F.get(F.col("places"), j)["h"]
    twice = F.filter(
        "places",
        lambda x, j: F.coalesce(at_place(j - 1) == x["h"], F.lit(False)) | F.coalesce(at_place(j + 1) == x["h"], F.lit(False)),
    )
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("places")
    steps = F.transform(
        "starts", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - s, F.lit(WINDOW)))
    )
    return rows.select(
        "id", "host", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).alias("n_repeat_words"),
    )


# Each rule's failures are whole-number comparisons of the measures, so that any engine agrees on them.
RULES = {
    "short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "same_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repetitive")


def host_verdicts(measured: DataFrame, rules: Mapping[str, str] = RULES, most: float = 0.5, least_strength: float = 10.0) -> DataFrame:
    """(host, n_docs, one shrunken failure rate per rule, rejected): a row per host.

    A rule's rates over hosts give a beta prior by moments: mean m of all documents and strength
    ``m (1 - m) / v - 1`` from the variance v of the hosts' rates weighted by their documents, at least
    ``least_strength``. A host's rate is that of its own documents and the prior's together, so a host of few
    documents stays near the mean. A host is rejected when a rate is above ``most``."""
    failures = [F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in rules.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *failures)
    hosts = cut(hosts)
    spread = []
    for name in rules:
        rate = F.col(name) / F.col("n_docs")
        spread += [F.sum(name).alias(f"{name}_all"), F.sum(F.col("n_docs") * rate * rate).alias(f"{name}_square")]
    prior = hosts.agg(F.sum("n_docs").alias("all_docs"), *spread).first()  # one row, whatever the data's size
    rates = []
    for name in rules:
        mean = (prior[f"{name}_all"] or 0) / (prior["all_docs"] or 1)
        variance = (prior[f"{name}_square"] or 0) / (prior["all_docs"] or 1) - mean * mean
        strength = max(least_strength, mean * (1 - mean) / variance - 1) if variance > 1e-12 else least_strength
        rates.append(((F.col(name) + strength * mean) / (F.col("n_docs") + strength)).alias(f"{name}_rate"))
    rated = hosts.select("host", "n_docs", *rates)
    worst = F.greatest(*[F.col(f"{name}_rate") for name in rules])
    return rated.withColumn("rejected", worst > most)


def host_quality(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", rules: Mapping[str, str] = RULES, most: float = 0.5
) -> DataFrame:
    """One row per document: the id, the measures, ``base_failed``, ``host_rejected``, ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of them in repeated five-word windows. ``kept`` is
    false for these and for documents of a rejected host (``host_verdicts``).

    Null, empty and blank texts have no words and fail. A null host is a host of its own. Null ids and repeated
    rows are documents of their own. Other columns are ignored. No rows give no rows."""
    measured = cut(measures(docs, id, text, host))
    verdicts = cut(host_verdicts(measured, rules, most).select(F.col("host").alias("_host"), "rejected"))
    base = F.expr(" or ".join(f"({RULES[name]})" for name in BASE))
    return measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.col("rejected").alias("host_rejected"), (~base & ~F.col("rejected")).alias("kept"),
    )
