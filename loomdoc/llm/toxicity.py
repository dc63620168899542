"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions over the
words of a text; each later model also gets the probabilities that the earlier
ones give. While training, those come out of fold: a document's come from models
that were fitted without it. The last category decides, at the threshold that gives
the best F1 over out-of-fold predictions.

The models are fitted on the driver over a bounded sample of labelled rows
(``max_train_rows``, the first by a hash of their ids, as far as their words have
``max_train_bytes`` together), with a bounded number of words each
(``max_words``); repeated rows are dropped before they are sent. Every document is scored by its whole text, in
one pass over the table without a shuffle.

A word is a run of ASCII letters and digits and of characters beyond ASCII,
lower-cased in ASCII. Words and their first four and five bytes are features,
present or not, so that inflected forms that were never labelled are known, too.

Defined cases: a null or empty text has no words and gets the models' base
rates; labels with a null aren't used; of several labels of an id the largest
counts; if no label or only one class is there, a category's model is that base
rate and nothing is rejected; an empty table gives an empty result; repeated rows
get equal scores; filtering keeps all columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, tidy, tidy_driver, whole

#: name, and the SQL of its 0/1 label over the table of labels; the chain's order
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: Of the table by which features are counted.
SLOT_BITS = 22
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").lower().translate(WORD_BYTES).split())


def features(words: set[bytes]) -> set[bytes]:
    """Words and beginnings of words; these end in an asterisk, which no word has."""
    starts = {w[:5] for w in words if len(w) > 3}
    return words | {w + b"*" for w in starts if len(w) == 5} | {w[:4] + b"*" for w in starts}


def words_of(text: str | None) -> set[bytes]:
    """A text's features."""
    return features(plain_words(text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Log-odds: bias + the weights of present words + those of earlier categories' probabilities."""

    bias: float
    words: dict[bytes, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)

    def odds(self, words: set[bytes], earlier: list[float]) -> float:
        get = self.words.get
        return self.bias + sum(get(w, 0.0) for w in words & self.words.keys()) + sum(a * b for a, b in zip(self.earlier, earlier, strict=False))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    threshold: float

    def odds(self, text: str | None) -> list[float]:
        words, out, earlier = words_of(text), [], []
        for model in self.models:
            out.append(model.odds(words, earlier))
            earlier.append(float(sigmoid(out[-1])))
        return out


class Bags:
    """Texts' features as pairs of (text, feature number), for features in three texts or more. Goes over texts twice, one at a time,
    and keeps numbers only: features are counted by a hash first, and most, which are rare, never get a name."""

    def __init__(self, texts: Iterable[set[bytes]]):
        counts = np.zeros(1 << SLOT_BITS, np.uint16)
        for t in texts:
            at = np.unique(np.fromiter((zlib.crc32(w) & (1 << SLOT_BITS) - 1 for w in t), np.int64, len(t)))
            counts[at] = np.minimum(counts[at], 2) + 1
        often = (counts >= 3).tobytes()
        number: dict[bytes, int] = {}
        mask = (1 << SLOT_BITS) - 1
        rows = [np.array([number.setdefault(w, len(number)) for w in t if often[zlib.crc32(w) & mask]], np.int32) for t in texts]
        self.n = len(rows)
        feature = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        keep = np.bincount(feature, minlength=len(number)) >= 3
        self.names = [w for w, o in zip(number, keep.tolist(), strict=True) if o]
        kept = keep[feature]
        self.text, self.feature = self.text[kept], (np.cumsum(keep, dtype=np.int32) - 1)[feature[kept]]

    def odds(self, model: Linear, earlier: np.ndarray) -> np.ndarray:
        weight = np.array([model.words.get(w, 0.0) for w in self.names] or [0.0])
        out = model.bias + np.bincount(self.text, weight[self.feature], self.n)
        return out + earlier @ np.array(model.earlier[: earlier.shape[1]]) if model.earlier else out


def fit_linear(bags: Bags, rows: np.ndarray, earlier: np.ndarray, y: np.ndarray, max_words: int, l2: float = 0.5, steps: int = 150) -> Linear:
    """Logistic regression with an L2 penalty, by accelerated gradient steps, over the features that tell the classes of rows (a mask) apart most."""
    target = y[rows]
    n, ones = len(target), float(target.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0
    if not 0 < ones < n:
        return Linear(base)
    mine = rows[bags.text]
    text, feature = bags.text[mine], bags.feature[mine]
    in1 = np.bincount(feature, y[text], len(bags.names))
    both = np.bincount(feature, minlength=len(bags.names))
    share = both / n
    z = (in1 / ones - (both - in1) / (n - ones)) / np.sqrt(np.maximum(share * (1 - share), 0.5 / n) * (1 / ones + 1 / (n - ones)))
    chosen = np.lexsort((np.arange(len(z)), -np.abs(z)))[:max_words]
    place = np.full(len(bags.names), -1)
    place[chosen] = np.arange(len(chosen))
    row_of = np.cumsum(rows) - 1
    x = np.zeros((n, len(chosen) + earlier.shape[1] + 1), np.float32)
    hit = place[feature] >= 0
    x[row_of[text[hit]], place[feature[hit]]] = 1
    x[:, len(chosen) : -1] = earlier[rows]
    x[:, -1] = 1
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(np.linalg.norm(x.T @ (x @ v))) + l2)
    penalty = np.full(x.shape[1], l2, np.float32)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = base
    ahead = w.copy()
    for i in range(steps):
        new = ahead - rate * (x.T @ (sigmoid(x @ ahead) - target).astype(np.float32) + penalty * ahead)
        ahead = new + (i / (i + 3)) * (new - w)
        w = new
    return Linear(float(w[-1]), {bags.names[f]: float(w[j]) for j, f in enumerate(chosen)}, [float(k) for k in w[len(chosen) : -1]])


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Log-odds with the best F1, halfway to the next value below; infinite if a class is missing."""
    if not len(y) or not 0 < y.sum() < len(y):
        return float("inf")
    order = np.argsort(-odds, kind="stable")
    s, hits = odds[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


class Features:
    """The features of bags of words, made anew each time that they are gone through."""

    def __init__(self, bags: list[bytes]):
        self.bags = bags

    def __iter__(self) -> Iterator[set[bytes]]:
        return (features(set(bytes(b).split())) for b in self.bags)


def fit_chain(texts: Iterable[set[bytes]], labels: np.ndarray, folds: np.ndarray, names: list[str], max_words: int) -> Chain:
    bags = Bags(texts)
    earlier = np.zeros((bags.n, 0), np.float32)
    models: list[Linear] = []
    y, odds = np.zeros(0), np.zeros(0)
    for j in range(len(names)):
        y = labels[:, j].astype(np.float32)
        odds = np.zeros(bags.n, np.float32)
        for k in np.unique(folds):
            out = folds == k
            odds[out] = bags.odds(fit_linear(bags, ~out, earlier, y, max_words), earlier)[out]
        models.append(fit_linear(bags, np.ones(bags.n, bool), earlier, y, max_words))
        earlier = np.column_stack([earlier, sigmoid(odds)]).astype(np.float32)
    return Chain(names, models, best_threshold(odds, y))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, max_train_rows: int = 6000, max_train_bytes: int = 64 << 20, max_words: int = 300, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain, from at most max_train_rows labelled rows. Of an id's several texts the one with the least words, as bytes, counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), *[F.expr(sql).cast("int").alias(f"label_{name}") for name, sql in categories]).dropna()
    known = known.groupBy("label_id").agg(*[F.max(f"label_{name}").alias(f"label_{name}") for name, _ in categories])
    known = known.withColumn("place", F.xxhash64("label_id")).orderBy("place").limit(max_train_rows)
    # max_train_rows small rows: bounded, so broadcast
    rows = docs.select(col(docs, id_col).cast("long").alias("label_id"), whole(col(docs, text_col)).alias("text")).join(F.broadcast(known), "label_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text = batch.column(names.index("text"))
            bag = [b" ".join(sorted(plain_words(t.as_py()))) for t in text]
            keep = [n for n in names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(n)) for n in keep] + [pa.array(bag, pa.binary())], [*keep, "bag"])

    columns = [f"label_{name}" for name, _ in categories]
    fields = "label_id long, " + ", ".join(f"{c} int" for c in columns) + ", place long, bag binary"
    found = rows.select("label_id", *columns, "place", "text").mapInArrow(bags, fields)
    once = found.groupBy("label_id", *columns, "place").agg(F.min("bag").alias("bag"))  # max_train_rows rows
    so_far = F.sum(F.octet_length("bag").cast("long")).over(Window.orderBy("place", "label_id").rowsBetween(Window.unboundedPreceding, 0))
    pdf: pd.DataFrame = once.withColumn("so_far", so_far).where(F.col("so_far") <= max_train_bytes).drop("so_far").toPandas()
    tidy_driver(docs.sparkSession)  # before the models take their memory
    pdf = pdf.sort_values(["place", "label_id"], ignore_index=True)
    chain = fit_chain(Features(pdf["bag"].tolist()), pdf[columns].to_numpy(), (pdf["place"].to_numpy() % folds), [n for n, _ in categories], max_words)
    del pdf
    tidy()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, kept, toxic, and p_<category> for each category."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # max_words words a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for batch in batches:
            odds = np.array([c.odds(t.as_py()) for t in batch.column(1)]).reshape(-1, len(c.names))
            toxic = odds[:, -1] > c.threshold
            p = sigmoid(odds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(~toxic), pa.array(toxic)] + [pa.array(p[:, j]) for j in range(len(c.names))], ["doc_id", "kept", "toxic", *[f"p_{n}" for n in c.names]])

    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), whole(col(docs, text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, kept boolean, toxic boolean, " + ", ".join(f"p_{n} double" for n in chain.names))


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs without the rows that the chain rejects, all columns; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf("boolean")
    def rejected(texts: pa.Array) -> pa.Array:
        c = model.value
        return pa.array([c.odds(t.as_py())[-1] > c.threshold for t in texts], pa.bool_())

    (flag,) = fresh(docs, "rejected")
    return docs.withColumn(flag, rejected(whole(col(docs, text_col)))).where(~F.col(flag)).drop(flag)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))
