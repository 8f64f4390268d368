"""Toxicity by two Kneser-Ney models of characters, one of toxic and one of ordinary documents.

Words are lowered byte strings with a border before and after. A byte is predicted from at most `ORDER` - 1 bytes of its word. Both
classes use absolute discounting and interpolate with one shared lower order, the pooled continuation counts (how many contexts
a short n-gram follows), so an expression that a class never saw falls back on the same counts. A word's log-likelihood ratio is
the sum over its bytes. A document is described by its length-normalised ratio, the largest ratio of a word, whole and per
byte, and its length; a logistic curve, fitted on labelled documents that the models did not see, turns these into a score.

Training uses at most about `SAMPLE` labelled rows (picked by a hash of doc_id), so models are bounded and can be sent to all
tasks. Scoring reads every whole text.

Defined cases: null and wordless texts get features of 0; rows of one doc_id are each scored; a label that is null is none, and of
several labels of a doc_id the largest counts; with no toxic or no ordinary training row the score is the share of toxic rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwell.llm import scan

ORDER, SAMPLE, FOLDS, CUT = 6, 60_000, 5, 0.3
_U = np.uint64
_FLUSH = 1_500_000


class Grams:
    """Distinct words of a piece and the n-grams of each: `word` per gram, `gram` and `context` keys, `low` (last three bytes)."""

    def __init__(self, texts: pa.Array):
        w = scan.Words(texts, scan.PUNCTUATION)
        self.rows, self.text = w.rows, w.text
        _, first, self.word_of = np.unique(w.hash, return_index=True, return_inverse=True)
        begin, end = w.begin[first], w.end[first]
        self.words = len(first)
        size = end - begin + 1  # the border before a word, then its bytes
        at = np.cumsum(size) - size
        data = np.full(int(size.sum()) + 1, 0x20, np.uint8)
        owner = np.repeat(np.arange(self.words), size)
        offset = np.arange(len(owner)) - at[owner]
        inside = offset > 0
        data[:-1][inside] = w.data[(begin[owner] + offset - 1)[inside]]
        # positions 1.. are predicted: bytes, and the next word's border as this word's end
        i = np.arange(1, len(data))
        self.word = owner if len(owner) else np.zeros(0, np.int64)
        start = np.maximum(at[self.word], i - ORDER + 1) if len(owner) else i
        self.gram = scan.span_hashes(data, start, i + 1)
        self.context = scan.span_hashes(data, start, i)
        wide = data.astype(np.int64)
        before = np.where(i - 2 >= at[self.word], wide[np.maximum(i - 2, 0)], 0) if len(owner) else i
        self.low = (before << 16) + (wide[i - 1] << 8) + wide[i]
        self.length = size


def _counted(batches):
    """Rows (gram, context, low, c0, c1): in how many texts of each class a gram occurs."""
    held, n = [], 0

    def merged():
        gram, context, low, c0, c1 = (np.concatenate(x) for x in zip(*held, strict=True))
        gram, first, back = np.unique(gram, return_index=True, return_inverse=True)
        total = [np.bincount(back, weights=c, minlength=len(gram)).astype(np.int64) for c in (c0, c1)]
        return gram, context[first], low[first], *total

    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].view(np.int64)), *map(pa.array, x[2:])], ["gram", "context", "low", "c0", "c1"])

    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for first, texts in scan.chunks(batch.column(0)):
            g = Grams(texts)
            if not g.words:
                continue
            # each (text, word) once, then its grams; a gram counts once a text
            pair = np.unique(g.text * g.words + g.word_of)
            row, word = pair // g.words, pair % g.words
            cuts = np.searchsorted(g.word, np.arange(g.words + 1))
            size = np.diff(cuts)[word]
            source = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cuts[word], size)
            distinct, at, back = np.unique(g.gram, return_index=True, return_inverse=True)
            seen = np.unique(np.repeat(row, size) * len(distinct) + back[source])
            label = y[first + seen // len(distinct)] > 0
            k = seen % len(distinct)
            held.append((distinct, g.context[at], g.low[at], np.bincount(k[~label], minlength=len(distinct)), np.bincount(k[label], minlength=len(distinct))))
            n += len(distinct)
            if n > _FLUSH:
                held = [merged()]
                if len(held[0][0]) > _FLUSH // 2:
                    yield batch_of(held[0])
                    held = []
                n = sum(len(x[0]) for x in held)
    if held:
        yield batch_of(merged())


class Model:
    """Log-likelihood ratios (toxic to ordinary) of all grams of the training texts; one that none of them has gets the ratio 0."""

    def __init__(self, table: pa.Table):
        gram, context = (table.column(c).to_numpy().view(np.uint64) for c in ("gram", "context"))
        low, counts = table.column("low").to_numpy(), [table.column(c).to_numpy().astype(np.float64) for c in ("c0", "c1")]
        keys, of = np.unique(context, return_inverse=True)
        # shared lower order: continuation counts of three bytes given two, interpolated with those of one byte
        three, of_three, k3 = np.unique(low, return_inverse=True, return_counts=True)
        two, of_two = np.unique(three >> 8, return_inverse=True)
        n2, types = np.bincount(of_two, weights=k3), np.bincount(of_two)
        one = np.bincount(three & 255, weights=k3, minlength=256) + 0.5
        d = self._discount(k3.astype(np.float64))
        shared = (np.maximum(k3 - d, 0) + d * types[of_two] * (one / one.sum())[three & 255]) / n2[of_two]
        logs = []
        for c in counts:
            d = self._discount(c)
            total, kinds = np.bincount(of, weights=c, minlength=len(keys)), np.bincount(of, weights=c > 0, minlength=len(keys))
            back = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.where(total[of] > 0, np.maximum(c - d, 0) / np.maximum(total[of], 1), 0) + back[of] * shared[of_three]))
        order = np.argsort(gram)
        self.gram, self.of_gram = gram[order], (logs[1] - logs[0])[order].astype(np.float32)

    @staticmethod
    def _discount(c: np.ndarray) -> float:
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        return float(min(0.95, max(0.05, n1 / (n1 + 2 * n2)))) if n1 else 0.5

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x), np.float32)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, values[at], 0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: ratio per byte, largest ratio of a word, largest ratio per byte of a word, log of the length."""
        g = Grams(texts)
        if not g.words:
            return np.zeros((g.rows, 4))
        order = np.argsort(g.gram)  # sorted probes are found several times faster
        value = self._find(self.gram, self.of_gram, g.gram[order])
        ratio = np.bincount(g.word[order], weights=value, minlength=g.words)
        each, size = ratio[g.word_of], g.length[g.word_of]
        out = np.zeros((g.rows, 4))
        n = np.bincount(g.text, weights=size, minlength=g.rows)
        out[:, 0] = np.bincount(g.text, weights=each, minlength=g.rows) / np.maximum(n, 1)
        for j, x in ((1, each), (2, each / size)):
            out[:, j] = -np.inf
            np.maximum.at(out[:, j], g.text, x)
        out[n == 0] = 0
        out[:, 3] = np.log1p(n)
        return out


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x[:, 1] * x[:, 3], x[:, 0] * x[:, 3], np.maximum(x[:, 1], 0) ** 2, np.ones(len(x))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients of a ridge logistic regression, by Newton steps."""
    x = _expand(x)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale == 0] = 0, 1
    x, b = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame):
    """Function from an array of texts to scores, learned from labelled docs (doc_id, text) that are not held out."""
    marked = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    share = min(1.0, SAMPLE / max(1, n))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    # at most about SAMPLE rows of two numbers: small enough for every task
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(FOLDS)))
    counted = known.filter("fold > 0").select("text", "toxic").mapInArrow(_counted, "gram bigint, context bigint, low bigint, c0 bigint, c1 bigint")
    table = counted.groupBy("gram").agg(F.first("context").alias("context"), F.first("low").alias("low"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    model = Model(table)

    def described(batches):
        for batch in batches:
            y = batch.column(1)
            for first, texts in scan.chunks(batch.column(0)):
                f = model.features(texts)
                yield pa.RecordBatch.from_arrays([y.slice(first, len(texts)), *(pa.array(f[:, j]) for j in range(4))], ["toxic", "a", "b", "c", "d"])

    rows = known.filter("fold = 0").select("text", "toxic").mapInArrow(described, "toxic int, a double, b double, c double, d double").toArrow()
    y = rows.column("toxic").to_numpy() > 0
    if y.all() or not y.any():
        level = float(y.mean()) if len(y) else 0.0
        return lambda texts: np.full(len(texts), level)
    mean, scale, b = logistic(np.column_stack([rows.column(c).to_numpy() for c in "abcd"]), y.astype(float))
    return lambda texts: 1 / (1 + np.exp(-np.clip((_expand(model.features(texts)) - mean) / scale @ b, -35, 35)))


def scored(docs: DataFrame, labels: DataFrame, name: str = "toxic_score") -> DataFrame:
    """docs with all its columns and `name`, a double from 0 to 1, in place of a column of that name."""
    docs = docs.drop(name)
    predict = fit(docs, labels)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first, texts in scan.chunks(batch.column(place)):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(predict(texts))], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
