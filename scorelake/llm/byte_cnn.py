"""Language identification by a convolutional network over bytes, in numpy.

Filters of several widths run over the bytes of a window of fixed length; each filter's highest response (max pooling) is an input of one softmax layer.
A filter of width w is w tables of one number per byte, so a response is a sum of w look-ups. A text is cut into
consecutive windows that cover it whole, the last padded; windows of many texts go through the network together, and a
text's probabilities are its windows' averaged by their bytes.

Training: windows of at most ``per_language`` labelled documents a language, the first by a keyed hash of their id, one window each at a hashed place;
at most ``most_languages`` languages (more fail). That is the only bounded sample; it is collected and fitted on the driver with
Adam. Gradients pass through the places of the maxima only.

Defined cases: a text that is null, empty or without a letter is ``und`` at score 0, as is every text if no labelled document with a
letter is left to learn from. Null languages are not learned from. Repeated rows and rows without an id are predicted like others. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, small_batches, text_of

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class ByteCNN:
    """``tables[i]`` has shape (width, 256, filters); pad bytes are zero."""

    def __init__(self, classes: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, window: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.widths, self.filters, self.window = classes, widths, filters, window
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths]
        self.biases = [np.zeros(filters, np.float32) for _ in widths]
        self.out = rng.normal(0, 0.1, (len(widths) * filters, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def responses(self, windows: np.ndarray, i: int) -> np.ndarray:
        """(windows, places, filters) of the filters of the i-th width."""
        width, places = self.widths[i], windows.shape[1] - self.widths[i] + 1
        total = self.tables[i][0].take(windows[:, :places], axis=0)
        for k in range(1, width):
            total += self.tables[i][k].take(windows[:, k:k + places], axis=0)
        return total

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        tops = [np.maximum(self.responses(windows, i).max(axis=1) + self.biases[i], 0) for i in range(len(self.widths))]
        return np.concatenate(tops, axis=1)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        scores = pooled @ self.out + self.out_bias
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        rng, weights = np.random.default_rng(seed), [*self.tables, *self.biases, self.out, self.out_bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        counts = np.bincount(labels, minlength=len(self.classes)).clip(1)
        weight = (len(labels) / (len(self.classes) * counts))[labels].astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                x, step = windows[pick].astype(np.intp), step + 1
                tops, places = [], []
                for i in range(len(self.widths)):
                    r = self.responses(x, i)
                    best = r.argmax(axis=1)
                    places.append(best)
                    tops.append(np.take_along_axis(r, best[:, None], axis=1)[:, 0] + self.biases[i])
                raw = np.concatenate(tops, axis=1)
                hidden = np.maximum(raw, 0)
                error = self.softmax(hidden)
                error[np.arange(len(pick)), labels[pick]] -= 1
                error *= weight[pick, None] / len(pick)
                back = (error @ self.out.T) * (raw > 0)
                grads: list[np.ndarray] = []
                rows, filters = np.arange(len(pick))[:, None], np.arange(self.filters)[None, :]
                for i, width in enumerate(self.widths):
                    g, table = back[:, i * self.filters:(i + 1) * self.filters], np.zeros_like(self.tables[i])
                    for k in range(width):
                        np.add.at(table[k], (x[rows, places[i] + k], np.broadcast_to(filters, places[i].shape)), g)
                    grads.append(table)
                grads += [back[:, i * self.filters:(i + 1) * self.filters].sum(axis=0) for i in range(len(self.widths))]
                grads += [hidden.T @ error + 1e-4 * self.out, error.sum(axis=0)]
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self

    def probabilities(self, texts: list[bytes], together: int = 64) -> np.ndarray:
        """(texts, classes); a text without bytes gets zeros."""
        out = np.zeros((len(texts), len(self.classes)))
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // self.window)
        owner = np.repeat(np.arange(len(texts)), counts)
        rows = np.zeros((int(counts.sum()), self.window), np.uint8)
        at = 0
        for t, n in zip(texts, counts.tolist()):
            rows[at:at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            at += n
        for a in range(0, len(rows), together):
            part = rows[a:a + together].astype(np.intp)
            share = (rows[a:a + together] != 0).sum(axis=1)
            np.add.at(out, owner[a:a + together], self.softmax(self.pooled(part)) * share[:, None])
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def training_windows(labelled: DataFrame, window: int = 256, per_language: int = 1500, most_languages: int = 200, seed: int = 5) -> DataFrame:
    """(lang, piece) of the sample: the rows with the smallest keyed hashes of each language.

    Counts by language and leading 16 bits of the hash tell how far the sample reaches; only rows up to there are ranked, so
    a dominant language sends little more than its sample.
    """
    key = F.xxhash64(F.lit(seed), col("doc_id"))
    text = text_of()
    start = F.pmod(key, F.greatest(F.length(text) - window, F.lit(1))) + 1
    slim = labelled.where(col("lang").isNotNull()).select(
        col("lang").cast("string").alias("lang"), key.alias("key"), F.shiftrightunsigned(key, 48).cast("int").alias("lead"),
        text.substr(start.cast("int"), F.lit(window)).alias("piece")).where(r"piece rlike r'\p{L}'")
    upto = F.sum("rows").over(Window.partitionBy("lang").orderBy("lead"))
    leads = slim.groupBy("lang", "lead").agg(F.count(F.lit(1)).alias("rows")).withColumn("upto", upto)
    reach = leads.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= per_language, F.col("lead"))), F.max("lead")).alias("last"))
    bounds = reach.limit(most_languages + 1).collect()
    if len(bounds) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    near = F.lit(False)
    for row in bounds:
        near = near | ((F.col("lang") == row["lang"]) & (F.col("lead") <= row["last"]))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 1), "key", "piece")
    return slim.where(near).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("lang", "piece")


def train(labelled: DataFrame, per_language: int = 1500, most_languages: int = 200, **options) -> ByteCNN | None:
    rows = training_windows(labelled, per_language=per_language, most_languages=most_languages).toPandas().sort_values(["lang", "piece"])
    classes = sorted(rows["lang"].unique().tolist())
    if not classes:
        return None
    model = ByteCNN(classes, **options)
    windows = np.zeros((len(rows), model.window), np.uint8)
    for row, piece in zip(windows, rows["piece"]):
        data = piece.encode("utf-8", "surrogatepass")[: model.window]
        row[: len(data)] = np.frombuffer(data, np.uint8)
    return model.fit(windows, np.searchsorted(classes, rows["lang"].to_numpy(dtype=object)) if len(classes) > 1 else np.zeros(len(rows), np.int64))


def predicted(text: Column, model: ByteCNN | None) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        data = [t.encode("utf-8", "surrogatepass") if t and LETTER.search(t) else b"" for t in texts]
        shares = model.probabilities(data)
        best = shares.argmax(axis=1)
        known = [bool(d) for d in data]
        return pd.DataFrame({
            "lang_pred": [model.classes[b] if k else UNKNOWN for b, k in zip(best, known)],
            "score": [float(min(1.0, s[b])) if k else 0.0 for s, b, k in zip(shares, best, known)]})

    return of(text)


def language_query(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.where(remainder != 1).select("doc_id", "text", "lang"))
    out = docs.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
