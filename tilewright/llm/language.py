"""Language identification by nearest centroids.

A text is the TF-IDF vector of the hashed character 1-, 2- and 3-grams of its lower-cased words
(letters only), normalised to length one. Each language has several centroids, found by spherical
k-means over its training texts, since its texts differ by kind. Training texts nearer to another
language's mean than to that of their own are set aside first: their labels are doubtful. The language of the centroid of the largest cosine is
predicted; a text whose distance to it is beyond what training texts show is marked as rejected. Short
texts have few n-grams and lie far from all centroids, so they are judged less strictly than long ones.

Training takes up to about ``per_language`` documents of each language by a hash of their ids, at
most ``sample`` of all languages and ``sample_chars`` characters (the documented bounds, held before
anything leaves the tasks) from outside the held-out fold, one text of each doc_id and language;
every document is classified, on its whole text.

Texts that are null or hold no letter are ``und`` with score 0 and rejected, as is everything if
nothing could be learned. Equal cosines go to the first language in order. Null langs are not
learned from. Repeated rows, null ids and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.ngrams import grams
from tilewright.llm.quality import held_out as in_fold
from tilewright.llm.quality import remainder
from tilewright.llm.tokens import pieces_of
from tilewright.session import table, written

BITS = 12
ORDERS = (1, 2, 3)
CENTROIDS = 4
PER_LANGUAGE = 600
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
SAMPLE = 20_000
SAMPLE_CHARS = 100_000_000
#: A text is rejected below this part of the lowest cosine among nearly all training texts.
MARGIN = 0.4
#: From so many letters on it has to reach this part of the lowest cosine among nearly all training texts of that length.
LONG = 64
LONG_MARGIN = 0.6
STEP = 1 << 18
_OTHER = re.compile(r"[\W\d_]+")


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, one row a text; long texts are counted in steps."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    ahead = max(ORDERS) - 1
    batch: list[tuple[int, str]] = []

    def add() -> None:
        if not batch:
            return
        of = np.array([i for i, _ in batch])
        for n in ORDERS:  # what begins in the step counts in it
            owner, bucket = grams([s[: STEP + n - 1] for _, s in batch], (n,), BITS)
            cell = of[owner] * (1 << BITS) + bucket
            low = int(of.min()) << BITS
            found = np.bincount(cell - low)
            out.reshape(-1)[low : low + len(found)] += found
        batch.clear()

    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), STEP):
            batch.append((i, text[at : at + STEP + ahead]))
            held += len(batch[-1][1])
            if held >= STEP:
                add()
                held = 0
    add()
    return out


def letters_of(text: str) -> str:
    """The words of a text, lower-cased, each with a space on either side."""
    return _OTHER.sub(" ", f" {text.lower()} ")


def n_letters(letters: str) -> int:
    return len(letters) - letters.count(" ")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, for each centroid
    long_least: float = 0.0  # the same for texts of LONG letters or more, whatever the centroid


def vectors(texts: list[str], idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    return _weighed([letters_of(t) for t in texts], idf)


def _weighed(letters: list[str], idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    found = counts(letters)
    if idf is None:
        idf = (np.log((1 + len(letters)) / (1 + (found > 0).sum(0))) + 1).astype(np.float32)
    found = np.log1p(found) * idf
    norm = np.sqrt((found * found).sum(1, keepdims=True))
    return found / np.where(norm > 0, norm, 1), idf


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (near == c).any():
                mean = x[near == c].mean(0)
                centre[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centre


def train(texts: list[str], langs: list[str], centroids: int = CENTROIDS, seed: int = 11) -> Model | None:
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    x, idf = vectors(texts)
    sizes = np.array([n_letters(letters_of(t)) for t in texts])
    langs = np.asarray(langs)
    every = np.unique(langs)
    own = np.searchsorted(every, langs)
    sure = np.ones(len(langs), bool)
    for _ in range(5):
        means = np.stack([x[sure & (own == c)].mean(0) for c in range(len(every))])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        agrees = (x @ means.T).argmax(1) == own
        # a language of which nothing would be left keeps what it had
        lost = ~np.isin(own, own[agrees])
        if (sure == (agrees | (lost & sure))).all():
            break
        sure = agrees | (lost & sure)
    x, langs = x[sure], langs[sure]
    names, centres = [], []
    for lang in sorted(set(langs.tolist())):
        found = _clusters(x[langs == lang], centroids, rng)
        names += [lang] * len(found)
        centres.append(found)
    centre = np.concatenate(centres)
    best = x @ centre.T
    near = best.argmax(1)
    floor = np.quantile(best.max(1), 0.002)
    least = np.array([min(floor, best[near == c, c].min()) if (near == c).any() else floor for c in range(len(centre))])
    long = best.max(1)[sizes[sure] >= LONG]
    long_least = LONG_MARGIN * float(np.quantile(long, 0.002)) if len(long) else 0.0
    return Model(names, idf, centre.astype(np.float32), MARGIN * least, long_least)


def fit(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    lang: str = "lang",
    sample: int = SAMPLE,
    sample_chars: int = SAMPLE_CHARS,
) -> Model | None:
    """Learns from about ``per_language`` documents of each language outside the held-out fold."""
    learned = F.col(lang).isNotNull() & F.coalesce(remainder("doc_id", folds) != held_out, F.lit(False))
    known = docs.where(learned).select("doc_id", F.col(lang).alias("lang"), "text")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("_n")), "languages")  # a table, so Spark knows its size
    each = min(per_language, sample / max(1, sizes.count()))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < F.lit(1_000_000.0) * each / F.col("_n")
    texts = known.join(sizes, "lang").where(chance).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    few = texts.orderBy(F.xxhash64("doc_id", F.lit("order")), "lang", "doc_id").limit(2 * sample)
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id", F.lit("order")), "lang", "doc_id"))
    rows = few.withColumn("_upto", upto).where(F.col("_upto") <= sample_chars).select("doc_id", "lang", "text").toPandas()
    rows = rows[np.array([has_letter(t) for t in rows["text"]], bool)].sort_values(["lang", "doc_id"])
    return train(rows["text"].tolist(), rows["lang"].tolist())


def classify(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    letters = np.array([has_letter(t) for t in texts], bool)
    langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~letters
    if model is None:
        return langs, score, np.ones(len(texts), bool)
    some = np.flatnonzero(letters)
    for at in range(0, len(some), 128):
        these = some[at : at + 128]
        letters = [letters_of(texts[i]) for i in these]
        x, _ = _weighed(letters, model.idf)
        cosine = x @ model.centroids.T
        near = cosine.argmax(1)
        best = cosine[np.arange(len(these)), near]
        score[these] = np.clip(best, 0, 1)
        long = np.array([n_letters(s) for s in letters]) >= LONG
        rejected[these] = (best < model.least[near]) | (long & (best < model.long_least))
        for i, c in zip(these, near):
            langs[i] = model.langs[c]
    return langs, score, rejected


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                langs, score, rejected = classify(model, batch.column(1).to_pylist())
                columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose text is near a known language, all columns as they are."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                yield batch.filter(pa.array(~classify(model, batch.column("text").to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT), "lang_pred", "score", "rejected")
