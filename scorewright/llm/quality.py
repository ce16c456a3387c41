"""Quality of documents as ordered grades: a cumulative-link regression on hashed words."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import slices

BITS = 18
#: The grades of labelled documents, worst first, and how many labelled documents a fit uses at most.
GRADES, FIT_ROWS = ("toxic", "poor", "good"), 8000
#: A document counts as its share of each feature times this.
SCALE = 30.0
#: Least probability of the best grade for a document to stay.
LEAST_GOOD = 0.4
#: Words without weight that each document gets besides, so that few words say little.
PRIOR_WORDS = 8
#: Features that a step of the fit works on at once.
PART = 1 << 18
#: Words kept with their scores in a Python worker.
MEMO_WORDS = 400_000
MARKS = ".,!?;:*$%&#|\"'()[]{}<>-"


class Model(NamedTuple):
    """Shared weights of hashed features, and the thresholds between neighbouring grades."""

    weights: np.ndarray
    thresholds: np.ndarray


def word_features(word: str) -> tuple[int, int, int]:
    """Places of a word in lower case without marks, of its beginning, and of its shape (case, digits and closing marks)."""
    bare = word.strip(MARKS)
    low = bare.lower()
    case = "A" if len(bare) > 1 and bare == bare.upper() != bare.lower() else "a"
    shape = f"{case}{'0' if any(c.isdigit() for c in bare) else ''}{word[len(word.rstrip(MARKS)) :][:4]}{'' if bare else '_'}"
    place = lambda text: xxhash.xxh32_intdigest(text.encode(), 5) & ((1 << BITS) - 1)
    return place("w" + low), place("p" + low[:5]), place("s" + shape)


REPEAT = xxhash.xxh32_intdigest(b"repeated", 5) & ((1 << BITS) - 1)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and where each text's words begin (one more than texts)."""
    parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    coded = pc.dictionary_encode(parts.flatten())
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])


def _counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its features and their shares (times SCALE)."""
    words, codes, bounds = _words(texts)
    places = np.array([word_features(w) for w in words], np.int64).reshape(-1, 3)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = codes[a:b]
        again = int(np.count_nonzero(own[1:] == own[:-1]))
        hit, n = np.unique(np.concatenate([places[own].ravel(), np.full(again, REPEAT)]), return_counts=True)
        yield hit.astype(np.int32), (SCALE * n / (b - a + PRIOR_WORDS)).astype(np.float32)


def fit(rows: Iterable[tuple[int, np.ndarray, np.ndarray]], grades: int = len(GRADES), steps: int = 200, rate: float = 0.2, ridge: float = 0.03) -> Model:
    """Fits the cumulative-link model P(grade > k) = sigmoid(score - threshold k), rare grades weighing more (by the root of their counts).

    rows: (grade, features, shares). A feature must occur in three documents. No rows give a model without an
    opinion.
    """
    weights, thresholds = np.zeros(1 << BITS), np.linspace(-1, 1, grades - 1)
    rows = list(rows)
    if not rows:
        return Model(weights, thresholds)
    y = np.array([r[0] for r in rows])
    where, share = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    n = len(rows)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r[1]) for r in rows])
    rows.clear()  # features are held once
    common = np.bincount(where, minlength=1 << BITS) >= min(3, n)
    keep = common[where]
    names = np.flatnonzero(common)
    where = (np.cumsum(common) - 1).astype(np.int32)[where[keep]]
    share, doc = share[keep], doc[keep]
    parts = [slice(*x) for x in itertools.pairwise([*range(0, len(where), PART), len(where)])]
    each = np.maximum(1, np.bincount(y, minlength=grades))[y] ** -0.5
    each /= each.sum()
    w, t = np.zeros(len(names)), thresholds.copy()
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        score = np.zeros(n)
        for part in parts:  # added up in the same order as in one go
            np.add.at(score, doc[part], share[part] * w[where[part]])
        # P(Y = k) = tail(k - 1) - tail(k), tails falling from one to zero.
        tails = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        slopes = tails * (1 - tails)
        at = np.arange(n)
        p = np.maximum(tails[at, y] - tails[at, y + 1], 1e-9)
        up, down = slopes[at, y] / p, slopes[at, y + 1] / p
        by_score = -each * (up - down)
        g_w = np.zeros(len(w))
        for part in parts:
            np.add.at(g_w, where[part], share[part] * by_score[doc[part]])
        g_w += ridge * w / len(w) ** 0.5
        g_t = np.array([(each * (up * (y == k + 1) - down * (y == k))).sum() for k in range(grades - 1)])
        for value, g, i, lr in ((w, g_w, 0, rate), (t, g_t, 2, rate)):
            moments[i] += 0.1 * (g - moments[i])
            moments[i + 1] += 0.01 * (g * g - moments[i + 1])
            value -= lr * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-5)
        t.sort()
    weights[names] = w
    return Model(weights, t)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model from documents with labels (doc_id, quality, toxic): grade 0 for toxic ones, else 1 or 2 by quality.

    At most `fit_rows` labelled documents are used, those whose ids have the least hashes; they are the only rows
    that come to the driver, a partition at a time. Labels with nulls don't count; of an id's several texts the one
    with the least hash does.
    """
    graded = labels.dropna(subset=["doc_id", "quality", "toxic"]).select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            found = list(_counts(batch.column(text_column)))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["grade", "places", "shares"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column)).join(F.broadcast(chosen), "doc_id")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = rows.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64(text).alias("hash"), text.alias("text"))).alias("one")).select("grade", F.col("one.text").alias(text_column))  # one text of a repeated id
    found = rows.mapInArrow(run, "grade int, places binary, shares binary").toLocalIterator(prefetchPartitions=True)
    return fit((r.grade, np.frombuffer(r.places, np.int32), np.frombuffer(r.shares, np.float32)) for r in sorted(found))


SCORES = ["expected_grade", "p_above_toxic", "p_good"]


def score(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """df with expected_grade (0 to 2) and the tail probabilities p_above_toxic and p_good; columns so named are replaced.

    Whole texts count. A text without known words (null and empty ones too) gets the model's middle score of zero;
    repeated rows score alike; an empty table stays empty.
    """
    kept = df.drop(*SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        weights = model.weights.tolist()
        for batch in slices(batches, text_column):
            words, codes, bounds = _words(batch.column(text_column))
            if len(memo) > MEMO_WORDS:
                memo.clear()
            each = np.empty(len(words))
            for i, word in enumerate(words):
                if (value := memo.get(word)) is None:
                    value = sum(weights[p] for p in word_features(word))
                    if len(word) <= 64:
                        memo[word] = value
                each[i] = value
            value = each[codes]
            value[1:] += weights[REPEAT] * ((codes[1:] == codes[:-1]) & ~np.isin(np.arange(1, len(codes)), bounds))
            total = np.concatenate([[0], np.cumsum(value)])
            score = SCALE * (total[bounds[1:]] - total[bounds[:-1]]) / (np.diff(bounds) + PRIOR_WORDS)
            tails = 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds[None, :], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (tails.sum(axis=1), np.ascontiguousarray(tails[:, 0]), np.ascontiguousarray(tails[:, -1])))], names=[*batch.schema.names, *SCORES])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.DoubleType()) for c in SCORES)])
    return kept.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, least_good: float = LEAST_GOOD, least_above_toxic: float = 0.5, text_column: str = "text") -> DataFrame:
    """The documents whose tail probabilities reach the thresholds, with the columns they came with."""
    return score(docs, model, text_column).where((F.col("p_good") >= least_good) & (F.col("p_above_toxic") >= least_above_toxic)).select(docs.columns)
