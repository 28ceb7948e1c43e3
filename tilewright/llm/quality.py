"""Quality classifier: supervised subword embeddings.

A word has the vectors of its hashed self and of its hashed character 3- and 4-grams (with word
boundaries), averaged. One more vector, of an index that no n-gram can hash to, stands for the
2-grams of a word and itself: a word that repeats the one before it counts once more with it. A
document is the average of its words; a softmax over the classes follows. Vectors and output weights
are learned by minibatch stochastic gradient descent in numpy, on at most ``sample`` labelled
documents of together at most ``sample_chars`` characters, taken in the order of a hash of their ids
(the documented bounds, held before anything leaves the tasks; every document is scored, on its
whole text).

Null and empty texts have the average zero, so their score is what the biases give. Labels that are null,
and labels without a document, are not used; contradicting labels of a document count as the lowest,
and of the texts of a repeated doc_id the least is learned from. Very long texts are scored as they
are, and learned from if they fit within ``sample_chars``.
Without any labels the score is 0.5. Repeated rows, null ids and extra columns are scored or passed
through row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.ngrams import grams
from tilewright.llm.tokens import pieces_of
from tilewright.session import table

BITS = 16
DIM = 8
ORDERS = (3, 4)
SAMPLE = 4000
SAMPLE_CHARS = 100_000_000
THRESHOLD = 0.3
FOLDS = 5
CACHE = 200_000
REPEAT = 1 << BITS  # the index of a repeated word, after those of the n-grams


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of the features of each word."""
    owner, bucket = grams([f"<{w}>" for w in words], ORDERS, BITS)
    own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for w in words], np.int64)
    return np.concatenate([owner, np.arange(len(words))]), np.concatenate([bucket, own])


@dataclass
class Model:
    """Logits of each bucket (vectors times output weights), and the biases."""

    logits: np.ndarray
    bias: np.ndarray


def train(texts: list[str], labels: list[int], classes: int = 2, epochs: int = 4, rate: float = 0.6, batch: int = 16, seed: int = 7) -> Model:
    """Stochastic gradient descent over documents as sparse averages of bucket vectors."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (REPEAT + 1, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    docs = []
    for text in texts:
        words = (text or "").split()
        names, counts = np.unique(words, return_counts=True) if words else (np.empty(0, str), np.empty(0))
        repeats = sum(map(eq, words, words[1:]))
        owner, bucket = word_features([str(w) for w in names])
        share = counts[owner] / np.bincount(owner, minlength=len(names))[owner] if len(owner) else np.empty(0)
        bucket, share = np.append(bucket, REPEAT), np.append(share, repeats)
        some, at = np.unique(bucket, return_inverse=True)
        weight = np.bincount(at, share) / max(1, len(words) + repeats)
        docs.append((some, weight.astype(np.float32)))
    y = np.eye(classes, dtype=np.float32)[np.asarray(labels, np.int64)]
    steps, total, done = None, epochs * max(1, len(docs)), 0
    for _ in range(epochs):
        steps = rng.permutation(len(docs))
        for at in range(0, len(steps), batch):
            these = steps[at : at + batch]
            rows = np.concatenate([docs[i][0] for i in these])
            weight = np.concatenate([docs[i][1] for i in these])
            ends = np.cumsum([0, *(len(docs[i][0]) for i in these)])[:-1]
            mean = np.add.reduceat(vectors[rows] * weight[:, None], ends, axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad = p - y[these]
            lr = np.float32(rate * (1 - done / total))
            back = grad @ out.T
            out -= lr * mean.T @ grad
            bias -= lr * 0.1 * grad.sum(0)
            of = np.repeat(np.arange(len(these)), [len(docs[i][0]) for i in these])
            np.add.at(vectors, rows, -lr * 8 * weight[:, None] * back[of])
            done += len(these)
    return Model((vectors @ out).astype(np.float64), bias.astype(np.float64))


class Scorer:
    """Class probabilities of whole texts; keeps the logits of up to CACHE words."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.rows = np.zeros((CACHE + 1, len(model.bias)))

    def _learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > CACHE:
            self.place.clear()
            if len(words) > CACHE:
                self.rows = np.zeros((len(words) + 1, len(self.model.bias)))
        new = [w for w in words if w not in self.place]
        if not new:
            return
        owner, bucket = word_features(new)
        at = len(self.place)
        size = np.bincount(owner, minlength=len(new))
        for c in range(len(self.model.bias)):
            self.rows[at : at + len(new), c] = np.bincount(owner, self.model.logits[bucket, c], len(new)) / size
        self.place.update(zip(new, range(at, at + len(new))))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out, get = np.empty((len(texts), len(self.model.bias))), self.place.__getitem__
        split, seen, start = [], set(), 0
        for i, text in enumerate(texts):
            split.append(words := (text or "").split())
            seen.update(words)
            if len(seen) < CACHE // 4 and i + 1 < len(texts):
                continue
            self._learn(seen if len(self.place) + len(seen) > CACHE else seen.difference(self.place))
            for k, words in enumerate(split, start):
                repeats = sum(map(eq, words, words[1:]))
                at = np.fromiter(map(get, words), np.int64, len(words))
                z = self.rows[at].sum(0) + repeats * self.model.logits[REPEAT]
                out[k] = z / max(1, len(words) + repeats)
            split, seen, start = [], set(), i + 1
        z = out + self.model.bias
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return p / p.sum(1, keepdims=True)


def remainder(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for null ids, which are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a document is in the fold that is never learned from; so are those of null id."""
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(True)).alias("held_out")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Learns ``labels.quality`` from documents outside fold 0, at most ``sample`` of them and ``sample_chars`` characters."""
    known = labels.where(F.col("quality").isNotNull() & (remainder("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one text for each of at most ``sample`` ids; rows that repeat an id meet in their tasks first
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = texts.withColumn("_upto", upto).where(F.col("_upto") <= sample_chars).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("doc_id")
    return train([t if isinstance(t, str) else "" for t in rows["text"]], rows["quality"].astype(int).clip(0, 1).tolist())


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score: the probability of class 1 for every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches):
        scorer = Scorer(model)
        for whole in batches:
            for batch in pieces_of(whole):
                found = scorer(batch.column(1).to_pylist())[:, 1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score at least the threshold, all columns as they are."""
    if model is None:
        return docs

    def run(batches):
        scorer = Scorer(model)
        for whole in batches:
            for batch in pieces_of(whole):
                found = scorer(batch.column("text").to_pylist())[:, 1]
                yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: quality of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out("doc_id", FOLDS, 0), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
