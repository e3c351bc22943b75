"""Language identification by Bayesian fusion of evidence.

A text's likelihoods come from letter trigrams of its words. They are combined with the language that the markup declares
and with priors of the host, smoothed over the hierarchy address suffix, domain, host. How far declarations can be trusted
and all priors come from grouped aggregations over all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, column_list, documents, released, small_batches, written

#: Labelled documents of each language that the text model is fitted on, at most (those of smallest hash of doc_id).
FIT_DOCS = 500
#: A text counts as so many words at most, as words of one text aren't independent.
FULL_WORDS = 30
#: Pseudo-counts by which a level of hosts leans on the level above.
LEAN = 10.0
#: Rows whose best language is less probable than this are rejected.
LEAST = 0.5
#: So many ids are sent to all executors; more are joined by a shuffle.
SENT_ROWS = 1 << 21
#: Words whose likelihoods a worker keeps, at most.
_KEPT = 100_000

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _trigrams(word: bytes) -> list[str]:
    w = f"^{word.decode('utf-8', 'replace').lower()}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for lang, data in zip(column_list(batch, "lang"), column_bytes(batch, "text"), strict=True):
            for word, n in Counter(data.translate(_TABLE).split()).items():
                for g in _trigrams(word):
                    total[lang, g] += n
    rows = [(lang, g, n) for (lang, g), n in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])


class TextModel:
    """Log-likelihoods of words under each language, relative to their mean."""

    def __init__(self, counts: list[tuple[str, str, int]]) -> None:
        self.languages = sorted({r[0] for r in counts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        table: dict[str, np.ndarray] = {}
        for lang, gram, n in counts:
            table.setdefault(gram, np.zeros(len(at)))[at[lang]] = n
        sums = sum(table.values()) if table else np.zeros(0)
        grams = max(len(table), 1)
        self.weights = {g: np.log((c + 0.1) / (sums + 0.1 * grams)) for g, c in table.items()}
        self.weights = {g: w - w.mean() for g, w in self.weights.items()}
        self.forget()

    def forget(self) -> None:
        """Drops the words that are kept; done at the end of each task, as idle workers stay alive."""
        self.kept: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(self.languages)))

    def _word(self, word: bytes) -> np.ndarray:
        out = np.zeros(len(self.languages))
        for g in _trigrams(word):
            if (w := self.weights.get(g)) is not None:
                out += w
        return out

    def evidence(self, data: bytes) -> tuple[np.ndarray, int]:
        """Summed log-likelihoods, as of FULL_WORDS words at most, and the number of words."""
        words = data.translate(_TABLE).split()
        if not words or not self.languages:
            return np.zeros(len(self.languages)), len(words)
        at = list(map(self.kept.get, words))
        if None in at:
            if len(self.kept) > _KEPT:
                self.kept, self.rows = {}, self.rows[:0]
            fresh = [w for w in dict.fromkeys(words) if w not in self.kept]
            self.kept.update((w, len(self.rows) + i) for i, w in enumerate(fresh))
            self._grow(np.array([self._word(w) for w in fresh]))
            at = list(map(self.kept.__getitem__, words))
        sums = self.rows[np.array(at)].sum(0)
        return sums * (min(len(words), FULL_WORDS) / len(words)), len(words)

    def _grow(self, more: np.ndarray) -> None:
        """Appends rows in an array that doubles, so that single words don't copy it."""
        n, k = len(self.rows), len(more)
        base = self.rows.base if self.rows.base is not None else self.rows
        if len(base) < n + k:
            base = np.zeros((2 * (n + k), self.rows.shape[1]))
            base[:n] = self.rows
        base[n : n + k] = more
        self.rows = base[: n + k]


def fitted(docs: DataFrame, fit_docs: int = FIT_DOCS) -> TextModel:
    """The text model from labelled documents (their column lang), at most fit_docs of each language; all languages count."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = written(labelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fit_docs).select("doc_id", "lang"))
    few = chosen.count() <= SENT_ROWS
    texts = documents(docs).join(F.broadcast(chosen) if few else chosen, "doc_id").select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return TextModel(sorted(tuple(r) for r in counts.collect()))


def _score(model: Broadcast):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from released(rows(batches))
        finally:
            model.value.forget()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.evidence(x) for x in column_bytes(batch, "text")]
            at = batch.schema.get_field_index("text")
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int64())], [*names, "evidence", "n_words"])

    return of


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _sums(column: str, k: int) -> Column:
    return F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(k)))


def fused(rows: DataFrame, model: TextModel, lean: float = LEAN) -> DataFrame:
    """row_id, lang (null if rejected), confidence, declared, host and n_words.

    rows has row_id, text, declared, suffix, domain and host; null evidence is a value of its own. A row without words has
    no text evidence; without a text model, all rows are rejected.
    """
    languages, k = model.languages, len(model.languages)
    if not k:
        return rows.select("row_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "declared", "host", F.lit(0).cast("long").alias("n_words"))
    fields = [F.col("row_id"), F.col("text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("declared", "suffix", "domain", "host"))]
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["row_id"]
    scored = written(small_batches(rows).select(*fields).mapInArrow(_score(sent), f"row_id {kind}, declared string, suffix string, domain string, host string, evidence array<double>, n_words long"))
    soft = scored.withColumn("q", _softmax(F.col("evidence")))

    totals = soft.where("n_words > 0").agg(_sums("q", k).alias("s"), F.count("*").alias("n")).first()
    everywhere = [(x + 1.0) / (totals["n"] + k) for x in (totals["s"] if totals["n"] else [0.0] * k)]
    world = F.array(*map(F.lit, everywhere))
    of_declared = soft.where("n_words > 0").groupBy("declared").agg(_sums("q", k).alias("s"))
    kinds = max(of_declared.count(), 1)
    language_sums = F.array(*(F.lit(x * totals["n"] + 0.5 * kinds) for x in everywhere))
    trust = of_declared.select("declared", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.log((F.get("s", i) + 0.5) / F.get(language_sums, i))).alias("trust"))

    counted = soft.where("n_words > 0").groupBy("suffix", "domain", "host").agg(_sums("q", k).alias("s"), F.count("*").alias("n"))
    domains = counted.groupBy("suffix", "domain").agg(_sums("s", k).alias("s"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(_sums("s", k).alias("s"), F.sum("n").alias("n"))

    def leaning(above: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.get("s", i) + lean * F.get(above, i)) / (F.col("n") + lean))

    suffixes = suffixes.select("suffix", leaning(world).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").withColumn("p_domain", leaning(F.col("p_suffix"))).select("suffix", "domain", "p_domain")
    hosts = counted.join(domains, ["suffix", "domain"]).withColumn("prior", leaning(F.col("p_domain"))).select("suffix", "domain", "host", "prior")

    out = scored.join(hosts, ["suffix", "domain", "host"], "left").join(trust, "declared", "left")
    zero = F.array(*(F.lit(0.0) for _ in languages))
    logs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("evidence", i) + F.get(F.coalesce("trust", zero), i) + F.log(F.get(F.coalesce("prior", world), i)))
    out = out.withColumn("p", _softmax(logs)).withColumn("confidence", F.array_max("p"))
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("p", F.col("confidence")).cast("int"))
    known = (F.col("n_words") > 0) & (F.col("confidence") >= LEAST)
    return out.select("row_id", F.when(known, best).alias("lang"), "confidence", "declared", "host", "n_words")


def page_rows(pages: DataFrame) -> DataFrame:
    """The fused columns of web pages: text without scripts, styles and tags, declared language, and the address."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1>|<!--.*?-->", " "), r"<[^>]*+>|&[A-Za-z0-9#]++;", " ")
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    return pages.select(
        F.col("page_id").cast("long").alias("row_id"), text.alias("text"), F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
        F.get(labels, F.size(labels) - 1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), host.alias("host"))


def document_rows(docs: DataFrame, row_id: Column) -> DataFrame:
    """The same of documents: their own lang is the declared language, their source stands for the host."""
    source = F.col("source").cast("string")
    return docs.select(row_id.alias("row_id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), source.alias("host"))


def identified_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, declared, host and n_words of each page; equal rows give a row each.

    Null urls and html are empty: no host, no words, no language (lang is null). Of languages with the same probability the
    first in alphabetical order wins. Whole pages are read, however long. An empty table gives no rows; without a labelled
    document all languages are null.
    """
    return fused(page_rows(pages), fitted(docs)).withColumnRenamed("row_id", "page_id")


def accepted(docs: DataFrame) -> DataFrame:
    """docs (all columns, of any names) without rows that have no words or no probable language.

    Null and empty texts go. Rows that agree in doc_id and text share their fate. A null source is a host of its own, a
    null lang no declaration. Where no row has a lang, languages can't be told apart, and all rows with words stay.
    """
    model = fitted(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False)))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    refused = fused(document_rows(docs, key), model).where("lang is null")
    gone = written(refused.select(F.col("row_id").alias("__refused")).distinct())
    few = gone.count() <= SENT_ROWS
    return docs.join(F.broadcast(gone) if few else gone, key == F.col("__refused"), "left_anti")
