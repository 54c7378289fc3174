"""The language of web pages, by Bayesian fusion of evidence.

For each language l the log posterior of a page adds up

- the log likelihood of its visible text: hashed byte n-grams of the training texts, counted by language over all of them;
- log P(language declared in the markup | l), the first declaration of the page wherever it stands;
- log P(address suffix | l): the last label of the host, and a language-like first part of the path;
- the log of the prior of its host, smoothed by that of its domain, that by its suffix, and that by all pages.

The tables of the last three are sums of text posteriors over groups of pages, each page counted by its share in each
language, so a host with very many pages is summed in the tasks before the shuffle. A page's own share is taken out of its
prior. Table rows travel to pages by joins that adaptive execution can split.

A null or empty text, address or declaration says nothing: its likelihood is the same for all languages. Training rows with a
null language do not train. Repeated rows stay and count each. Pages without any evidence get the most likely language of all
pages; ties go to the smaller name. Without languages to learn from, the language is null. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loglark.llm.text import utf8
from loglark.session import materialize

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Overlapping n-grams say the same several times, so their sum counts by this much.
TEXT_WEIGHT = 1 / 3
#: The text posterior that is summed up for the tables is kept from certainty by this share.
DOUBT = 0.01
#: Pages that a wider group counts as much as, in the prior of a narrower one.
STRENGTH = 4.0
#: More languages than this are not told apart; training rows of more raise an error.
MOST_LANGUAGES = 256
_PIECE = 1 << 18

_HIDDEN = re.compile(rb"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def visible(html: bytes) -> bytes:
    """The text of a page, without markup, scripts and comments."""
    return _HIDDEN.sub(b" ", html)


def _buckets(text: bytes) -> Iterator[np.ndarray]:
    line = b" " + b" ".join(text.lower().split()) + b" "
    if len(line) == 2:
        return
    for at in range(0, len(line), _PIECE):
        codes = np.frombuffer(line, np.uint8, min(len(line) - at, _PIECE + max(ORDERS) - 1), at).astype(np.uint32)
        key = codes
        for n in ORDERS:
            if n > 1:
                key = key[: len(codes) - n + 1] | codes[n - 1 :] << np.uint32(8 * (n - 1))
            mixed = (key + np.uint32(n)) * np.uint32(0x9E3779B1)
            yield (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - 15)


def counts_by_language(texts: DataFrame, languages: list[str], lang_col: str, text_col: str) -> np.ndarray:
    """Occurrences of each bucket by language, over all rows."""
    place = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for found in _buckets(text):
                    total[place[lang]] += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([total[k].tobytes() for k in used], pa.binary())],
                names=["lang", "data"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(*(c.to_pylist() for c in batch.columns)):
                total[lang] = total.get(lang, 0) + np.frombuffer(data, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
                names=["lang", "data"],
            )

    known = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col), utf8(F.col(text_col)))
    parts = known.mapInArrow(count, "lang int, data binary")
    # Added up in a few tasks first, so the last ones get a row for each of those; salted, as there are few languages.
    salted = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("lang", "salt").drop("salt")
    rows = salted.mapInArrow(add, "lang int, data binary").repartition("lang").mapInArrow(add, "lang int, data binary")
    out = np.zeros((len(languages), BUCKETS), np.int64)
    for row in rows.collect():  # BUCKETS counts for each language
        out[row.lang] = np.frombuffer(row.data, np.int64)
    return out


def _likelihood(weights: np.ndarray, spark, html: Column) -> Column:
    shared = spark.sparkContext.broadcast(weights)  # BUCKETS by MOST_LANGUAGES values at most

    @F.arrow_udf(ArrayType(DoubleType()))
    def likelihood(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for pages in parts:
            out = np.zeros((len(pages), table.shape[1]))
            for k, page in enumerate(pages):
                for found in _buckets(visible(page.as_py())):
                    out[k] += np.bincount(found, minlength=BUCKETS) @ table
            offsets = np.arange(len(pages) + 1, dtype=np.int32) * table.shape[1]
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel() * TEXT_WEIGHT))

    return likelihood(utf8(html))


def _posterior(log_weights: Column) -> Column:
    """Probabilities in proportion to the exponentials."""
    top = F.array_max(log_weights)
    raised = F.transform(log_weights, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The sum of the shares of the pages of each group, as an array, with groups of a null key left out."""
    found = rows
    for key in keys:
        found = found.where(F.col(key).isNotNull())
    return found.groupBy(*keys).agg(F.array(*[F.sum(F.get("share", F.lit(k))) for k in range(n)]).alias("_sum"))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(pages: DataFrame, training: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
             lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(page_id, language, probability, text_language, declared, host) for every page."""
    spark = pages.sparkSession
    found = training.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().orderBy(lang_col).limit(MOST_LANGUAGES + 1)
    languages = [r[0] for r in found.collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn from")
    markup = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    part = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#-]|$)", 1))
    labels = F.split(host, r"\.")
    address = pages.select(
        F.col(page_id).alias("page_id"), F.nullif(F.lower(markup), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."), F.lit("")).alias("domain"),
        F.nullif(F.element_at(labels, -1), F.lit("")).alias("suffix"),
        F.when(host != "", F.concat_ws("/", F.element_at(labels, -1), part)).alias("hint"), F.col(html).alias("_html"),
    )
    n = len(languages)
    if not n:
        none = F.lit(None)
        return address.select("page_id", none.cast("string").alias("language"), none.cast("double").alias("probability"),
                              none.cast("string").alias("text_language"), "declared", "host")
    counts = counts_by_language(training, languages, lang_col, text_col)
    weights = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T.copy()
    rows = address.withColumn("ll", _likelihood(weights, spark, F.col("_html"))).drop("_html")
    rows = materialize(rows, "language-text")
    rows = rows.withColumn("share", F.transform(_posterior(F.col("ll")), lambda p: p * (1 - DOUBT) + DOUBT / n))
    whole = rows.agg(F.array(*[F.coalesce(F.sum(F.get("share", F.lit(k))), F.lit(0.0)) for k in range(n)])).first()[0]
    total = sum(whole)
    prior = [(w + 1) / (total + n) for w in whole]

    # P(declared | l) and P(hint | l), each with one more kind that was not seen.
    for key in ("declared", "hint"):
        table = materialize(_sums(rows, [key], n), f"language-{key}")
        kinds = table.count() + 1
        of_all = table.agg(F.array(*[F.coalesce(F.sum(F.get("_sum", F.lit(k))), F.lit(0.0)) for k in range(n)])).first()[0]
        log_p = F.transform(
            F.arrays_zip(F.col("_sum").alias("s"), F.array(*[F.lit(float(t)) for t in of_all]).alias("t")),
            lambda z: F.log((z["s"] + 0.5) / (z["t"] + 0.5 * kinds)),
        )
        rows = rows.join(table.select(key, log_p.alias(f"ll_{key}")), key, "left")
    nothing = F.array(*[F.lit(0.0)] * n)
    estimate = F.array(*[F.lit(p) for p in prior])
    for key in ("suffix", "domain", "host"):
        table = _sums(rows, [key], n).withColumnRenamed("_sum", f"sum_{key}")
        rows = rows.join(table, key, "left")
        # Without the page itself: its text counts already.
        others = F.zip_with(F.col(f"sum_{key}"), F.col("share"), lambda s, own: F.greatest(s - own, F.lit(0.0)))
        others = F.coalesce(others, nothing)
        rows = rows.withColumn(f"p_{key}", _smoothed(others, estimate))
        estimate = F.col(f"p_{key}")
    log_post = _plus(F.col("ll"), F.transform("p_host", lambda p: F.log(p)))
    for key in ("declared", "hint"):
        log_post = _plus(log_post, F.coalesce(F.col(f"ll_{key}"), nothing))
    rows = rows.withColumn("post", _posterior(log_post))
    names = F.array(*[F.lit(x) for x in languages])

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return rows.select(
        "page_id", best(F.col("post")).alias("language"), F.array_max("post").alias("probability"),
        F.when(F.array_max("ll") > F.array_min("ll"), best(F.col("ll"))).alias("text_language"), "declared", "host",
    )


def _smoothed(others: Column, wider: Column) -> Column:
    total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(others, wider, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))
