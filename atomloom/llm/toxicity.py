"""Toxicity as a severity grade: cumulative-link ordinal regression over sparse text features.

One weight for each term is shared by all thresholds: P(grade >= k) = sigmoid(w . x - c_k), with
ascending cuts c_k. The expected severity is the sum of these over k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import materialise, valid_text
from atomloom.llm.words import slices, split_words

#: Bound on the labelled rows that a model is fitted on, by the order of a hash of doc_id.
SAMPLE_ROWS = 20_000
MAX_TERMS = 4096
MIN_TERM_DOCUMENTS = 5
MIN_Z = 4.0
#: A toxic document's grade, by how many terms it holds that mark toxic documents: below 3, below 8, more.
GRADE_STEPS = (3, 8)
GRADES = len(GRADE_STEPS) + 2
MARKER_RATIO = 20.0
RIDGE = 1e-4
STEPS = 400
#: Lengths in code points of the beginnings of words that are features.
PREFIXES = (3, 4, 5, 6, 7)
_TRIM = ".,;:!?|\"'()[]{}<>*#$%&-_"


@dataclass(frozen=True)
class OrdinalModel:
    """``weights`` by term, and the ascending cuts between grades; without cuts nothing is toxic."""

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, by row."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - score[:, None], -500, 500)))


def features(words: pa.Array) -> Iterator[pa.DictionaryArray]:
    """The features of each of ``words``, kind by kind: the word itself, and each of its beginnings with a ``*`` behind.

    Words count with A-Z in lower case and without marks at their ends; null where there is none.
    Languages that inflect or compound vary a word's end, so beginnings find what whole words miss.
    """
    words = pc.utf8_trim(pc.ascii_lower(words), _TRIM)
    length = pc.utf8_length(words)
    yield pc.if_else(pc.greater(length, 0), words, pa.scalar(None, pa.string())).dictionary_encode()
    for n in PREFIXES:
        begun = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), "*", "")
        yield pc.if_else(pc.greater_equal(length, n), begun, pa.scalar(None, pa.string())).dictionary_encode()


def held_once(texts: pa.Array, wanted: pa.Array | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Which features each of ``texts`` holds, kind by kind: (text, feature), once each, and the names of features.

    With ``wanted``, only those, numbered by their place in it.
    """
    offsets, index, words = split_words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for kind in features(words):
        names = kind.dictionary
        number = pc.fill_null(kind.indices, -1).to_numpy().astype(np.int64)
        if wanted is not None:
            place = np.append(pc.fill_null(pc.index_in(names, value_set=wanted), -1).to_numpy().astype(np.int64), -1)
            names, number = wanted, place[number]
        own = number[index]
        hit = own >= 0
        pairs = np.unique(text[hit] * max(1, len(names)) + own[hit])
        yield pairs // max(1, len(names)), pairs % max(1, len(names)), names


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_terms: int, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by gradient steps with adapted rates on the mean log-likelihood, less a ridge on the weights.

    Each row lists the terms it holds. Cuts are a first one and positive gaps, so they ascend.
    """
    row = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    term = np.array([t for r in rows for t in r], np.int64)
    above = (grades[:, None] > np.arange(n_grades - 1)[None, :]).mean(axis=0)
    cuts = -np.log(np.clip(above, 1e-4, 1 - 1e-4) / (1 - np.clip(above, 1e-4, 1 - 1e-4)))
    theta = np.concatenate((np.zeros(n_terms), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, gaps = theta[:n_terms], np.exp(theta[n_terms + 1 :])
        cuts = np.concatenate(([-np.inf], theta[n_terms] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        score = np.bincount(row, w[term], minlength=len(rows))
        # P(grade = k) = F(c_k+1 - s) - F(c_k - s), of which these are the ends' values and slopes.
        upper, lower = (1 / (1 + np.exp(-np.clip(cuts[grades + i] - score, -500, 500))) for i in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_cut = (np.bincount(grades, d_up, minlength=n_grades)[:-1] - np.bincount(grades, d_low, minlength=n_grades)[1:]) / len(rows)
        d_w = np.bincount(term, (d_low - d_up)[row], minlength=n_terms) / len(rows) - RIDGE * w
        d_gap = np.cumsum(d_cut[::-1])[::-1][1:] * gaps
        gradient = np.concatenate((d_w, [d_cut.sum()], d_gap))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += 0.1 * (1 - 0.9 * step / STEPS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:n_terms], theta[n_terms] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n_terms + 1 :]))))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents that hold each term, n, and the toxic ones of them, t, and as many of half 1: one row for each slice."""
    for batch in slices(batches):
        toxic, half = (batch.column(c).to_numpy().astype(np.int64) for c in ("toxic", "half"))
        for text, term, names in held_once(batch.column("text")):
            counts = (np.bincount(term, w, minlength=len(names)).astype(np.int64) for w in (None, toxic[text], half[text], (toxic * half)[text]))
            yield pa.record_batch([names, *map(pa.array, counts)], names=["term", "n", "t", "n1", "t1"])


def _indexer(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        for batch in slices(batches):
            held = np.sort(np.concatenate([text * max(1, len(terms)) + term for text, term, _ in held_once(batch.column("text"), wanted)]))
            ends = np.searchsorted(held, np.arange(batch.num_rows + 1) * max(1, len(terms)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((held % max(1, len(terms))).astype(np.int32)))
            yield pa.record_batch([batch.column("toxic"), batch.column("half"), lists], names=["toxic", "half", "held"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> OrdinalModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1; other values and nulls are left out).

    Labels say toxic or not, so severity is a proxy: a toxic document's grade is by how many marker
    terms it holds, terms at least MARKER_RATIO times as frequent among toxic documents. Markers
    are taken from the half of the sample that the document is not in, so that no document's
    grade comes from its own label. At most ``sample_rows`` labelled rows are read, chosen by a
    hash of doc_id, and at most ``max_terms`` terms kept, those whose frequency differs most
    between the classes. Repeated texts count once, repeated labels of a doc_id as the largest.
    Where either class is missing, the model has no terms or cuts.
    """
    chosen = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", valid_text("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["text", "toxic"])
    sample = materialise(sample.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")), "toxic-sample")
    sizes = {(r["toxic"], r["half"]): r["count"] for r in sample.groupBy("toxic", "half").count().collect()}
    of = lambda toxic, half: sizes.get((toxic, half), 0)
    n_not, n_toxic = (of(x, 0) + of(x, 1) for x in (0, 1))
    if not n_not or not n_toxic:
        return OrdinalModel({}, ())
    counts = sample.mapInArrow(_term_rows, "term string, n long, t long, n1 long, t1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "t", "n1", "t1")))

    def ratio(n: Column, t: Column, others: int, toxic: int) -> tuple[Column, Column]:
        return (t + 0.5) / (toxic + 1.0), (n - t + 0.5) / (others + 1.0)

    n, t, n1, t1 = map(F.col, ("n", "t", "n1", "t1"))
    p, q = ratio(n, t, n_not, n_toxic)
    (p0, q0), (p1, q1) = ratio(n - n1, t - t1, of(0, 0), of(1, 0)), ratio(n1, t1, of(0, 1), of(1, 1))
    pooled = (n + 1.0) / (n_not + n_toxic + 2.0)
    z = (p - q) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(0.999))) * (1.0 / n_toxic + 1.0 / n_not))
    best = counts.filter(n >= MIN_TERM_DOCUMENTS).select("term", z.alias("z"), F.array(p0 / q0, p1 / q1).alias("ratios")).filter(F.abs("z") >= MIN_Z)
    kept = best.orderBy(F.desc(F.abs("z")), "term").limit(max_terms).collect()
    terms = [r["term"] for r in kept]
    markers = np.array([[r["z"] > 0 and x >= MARKER_RATIO for x in r["ratios"]] for r in kept], bool).reshape(-1, 2)
    rows = sample.mapInArrow(_indexer(terms), "toxic int, half int, held array<int>").collect()  # no more than sample_rows
    held = [sorted(r["held"]) for r in rows]
    hits = np.array([markers[h, 1 - r["half"]].sum() for h, r in zip(held, rows)])
    grades = np.array([r["toxic"] for r in rows]) * (1 + sum(hits >= step for step in GRADE_STEPS))
    weights, cuts = fit_ordinal(held, grades, len(terms))
    return OrdinalModel(dict(zip(terms, map(float, weights))), tuple(map(float, cuts)))


def _scorer(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = pa.array(list(model.weights), pa.string()), np.array(list(model.weights.values()), float)
        for batch in slices(batches):
            score = np.zeros(batch.num_rows)
            if model.cuts:
                for text, term, _ in held_once(batch.column("text"), wanted):
                    score += np.bincount(text, weights[term], minlength=batch.num_rows)
                p = model.at_least(score)
            else:
                p = np.zeros((batch.num_rows, 1))
            own = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1), pa.int64())]
            yield pa.record_batch([batch.column("doc_id"), *own], names=["doc_id", "expected_severity", "p_toxic", "grade"])

    return run


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Severity of each row of ``docs`` (doc_id, text; others are ignored).

    Returns doc_id, expected_severity (0 to the highest grade), p_toxic (of grade 1 or more) and
    grade (the highest that is at least as likely as not). Null and empty texts hold no terms.
    Bytes that are no UTF-8 count as U+FFFD. Repeated rows are graded each, alike. An empty table gives an empty one. Nothing is shuffled;
    the model, at most MAX_TERMS terms, travels with the task.
    """
    return docs.select("doc_id", valid_text("text")).mapInArrow(_scorer(model), "doc_id long, expected_severity double, p_toxic double, grade long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    graded = grade(docs, model)
    return graded.select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), F.round("p_toxic", 6).alias("p_toxic"), "grade", (F.col("grade") > 0).alias("toxic"))
