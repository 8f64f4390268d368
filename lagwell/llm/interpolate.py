"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), with b the bucket (power of two) of the context's count c(v).
The weights of each bucket are learned by expectation-maximisation on held-out counts: for every training document, events
are weighed by the counts that remain when the document's own are deleted.

Documents are dealt to blocks of about `BLOCK` bytes by a hash. A block sends its distinct n-grams with its training counts,
packed and cut by key range, to count buckets; a bucket adds them and answers each block in the order it was asked. So what
is shuffled is distinct n-grams per block, a frequent word is one entry per block, and no table of n-grams meets
in one task or on the driver. The driver sees N, V and a histogram of held-out events whose number of cells is bounded.

Defined cases: null and empty texts have the end token alone; a null doc_id counts as training; rows of equal id are each
scored and each counted; with no training documents all counts are 0 and the uniform estimate remains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.llm import scan
from lagwell.llm.stage import discard, staged

BLOCK, ENTRIES, ROUNDS = 3_000_000, 2_000_000, 60
_U = np.uint64
_END, _START = _U(0x5BF03635D1E7A9C3), _U(0xA24BAED4963EE407)
#: Key bytes of a unigram and of a bigram that are sent besides the bucket number.
_WIDTH = (8, 5)


class Events:
    """Tokens of a block's texts in order: key, context key, text; and the distinct keys of both orders with inverses."""

    def __init__(self, texts: pa.Array):
        keys, rows = [], []
        for first, piece in scan.chunks(texts):
            w = scan.Words(piece)
            at = w.first[1:]
            keys.append(np.insert(w.hash, at, _END))
            rows.append(np.insert(w.text, at, np.arange(w.rows)) + first)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.text = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.context = np.concatenate([np.full(1, _START), self.key[:-1]])[: len(self.key)]
        self.context[np.flatnonzero(np.diff(self.text, prepend=-1))] = _START
        pair = scan.mix(self.context * _U(scan.BASE) + self.key)
        self.one, self.of_one = np.unique(self.key, return_inverse=True)
        self.two, self.of_two = np.unique(pair, return_inverse=True)
        # a context's count is its word's; the start counts as often as the end
        word = np.where(self.context == _START, _END, self.context)
        self.of_context = np.searchsorted(self.one, word)

    def own(self, index: np.ndarray, size: int) -> np.ndarray:
        """How often each event's key, given by index, occurs in the event's own text."""
        pair = self.text * size + index
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        return count[back]


def _small(x: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if x.max(initial=0) <= np.iinfo(k).max)
    return np.uint8([kind().itemsize]).tobytes() + x.astype(kind).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[blob[0]], offset=1).astype(np.int64)


def _ask(bits: int):
    def run(table):
        e = Events(table.column("text").combine_chunks())
        train = ~table.column("held_out").to_numpy(zero_copy_only=False)[e.text]
        out = {"bucket": list(range(1 << bits)), "block": [table.column("block")[0].as_py()] * (1 << bits)}
        for name, width, key, back in (("one", _WIDTH[0], e.one, e.of_one), ("two", _WIDTH[1], e.two, e.of_two)):
            count = np.bincount(back, weights=train, minlength=len(key)).astype(np.int64)
            cuts = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            planes = (key << _U(bits)).view(np.uint8).reshape(-1, 8)[:, 8 - width :].T[::-1]
            out[f"k{name}"] = [planes[:, i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            out[f"c{name}"] = [_small(count[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(out)

    return run


def _answer(table):
    """Adds the counts of a bucket and returns them to its blocks."""
    out = {"bucket": table.column("bucket"), "block": table.column("block")}
    stats = []
    for name, width in (("one", _WIDTH[0]), ("two", _WIDTH[1])):
        keys, counts, sizes = [], [], []
        for k, c in zip(table.column(f"k{name}").to_pylist(), table.column(f"c{name}").to_pylist(), strict=True):
            n = len(k) // width
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(k, np.uint8).reshape(width, n)[::-1].T if n else wide[:, :width]
            keys.append(wide.view(np.uint64).ravel())
            counts.append(_wide(c))
            sizes.append(n)
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        given = total[back]
        ends = np.cumsum(sizes)
        out[name] = [_small(given[b - n : b]) for n, b in zip(sizes, ends.tolist(), strict=True)]
        stats.append((int(total.sum()), int((total > 0).sum())))
    first = [True] + [False] * (len(table) - 1)
    out["tokens"] = [stats[0][0] if x else 0 for x in first]
    out["types"] = [stats[0][1] if x else 0 for x in first]
    return pa.table(out)


def _counts(answers: pa.Table, e: Events) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(v, w) and c(v) of each event from the block's answers."""
    answers = answers.sort_by("bucket")
    one, two = (np.concatenate([_wide(x) for x in answers.column(c).to_pylist()]) for c in ("one", "two"))
    return one[e.of_one], two[e.of_two], one[e.of_context]


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(context, 0) + 1)).astype(np.int64)


_STEP = 4  # cells per factor of two in the histogram of held-out events


def _histogram(total: int):
    def run(docs, answers):
        e = Events(docs.column("text").combine_chunks())
        w, vw, v = _counts(answers, e)
        keep = ~docs.column("held_out").to_numpy(zero_copy_only=False)[e.text]
        w = (w - e.own(e.of_one, len(e.one)))[keep]
        vw = (vw - e.own(e.of_two, len(e.two)))[keep]
        v = (v - e.own(e.of_context, len(e.one) + 1))[keep]
        b = bucket_of(v)

        def cell(p):
            return np.where(p > 0, np.round(-_STEP * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)

        code = (b * 4096 + cell(np.where(v > 0, np.minimum(vw, v) / np.maximum(v, 1), 0))) * 4096 + cell(w / max(total, 1))
        code, n = np.unique(code + 4097, return_counts=True)
        return pa.table({"code": code, "n": n})

    return run


def weights(code: np.ndarray, n: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bucket, 3: bigram, unigram, uniform) by expectation-maximisation on the histogram."""
    code = code - 4097
    low = (code + 1) % 4096 - 1
    mid = ((code - low) // 4096 + 1) % 4096 - 1
    bucket = ((code - low) // 4096 - mid) // 4096
    p = np.stack([np.where(mid >= 0, 2.0 ** (-mid / _STEP), 0), np.where(low >= 0, 2.0 ** (-low / _STEP), 0), np.full(len(code), 1 / (types + 1))], axis=1)
    out = np.tile([0.3, 0.6, 0.1], (65, 1))
    out[0] = [0, 0.9, 0.1]
    for _ in range(rounds):
        part = out[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        total = np.zeros_like(out)
        np.add.at(total, bucket, part)
        seen = total.sum(axis=1) > 0
        out[seen] = total[seen] / total[seen].sum(axis=1, keepdims=True)
    # no event may become impossible; unseen buckets keep the start values
    floor = np.where(np.arange(65)[:, None] == 0, [0, 1e-4, 1e-4], [1e-4, 1e-4, 1e-4])
    out = np.maximum(out, floor)
    return out / out.sum(axis=1, keepdims=True)


def _score(total: int, types: int, mixed: np.ndarray):
    def run(docs, answers):
        texts = docs.column("text").combine_chunks()
        e = Events(texts)
        w, vw, v = _counts(answers, e)
        rows = len(texts)
        base = np.log10((w + 1) / (total + types + 1))
        lam = mixed[bucket_of(v)]
        p = lam[:, 0] * np.where(v > 0, vw / np.maximum(v, 1), 0) + lam[:, 1] * w / max(total, 1) + lam[:, 2] / (types + 1)
        add = lambda x: np.bincount(e.text, weights=x, minlength=rows)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": add(np.ones(len(w))).astype(np.int64),
            "n_known": add(w > 0).astype(np.int64), "train_tokens": np.full(rows, total), "base_score": add(base), "score": add(np.log10(p)),
        })

    return run


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    bits = max(3, int(np.ceil(np.log2(max(1, size / 5 / ENTRIES)))))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    rows = rows.select("doc_id", "text", F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    asked = rows.groupBy("block").applyInArrow(_ask(bits), "bucket bigint, block bigint, kone binary, cone binary, ktwo binary, ctwo binary")
    answers = staged(asked.groupBy("bucket").applyInArrow(_answer, "bucket bigint, block bigint, one binary, two binary, tokens bigint, types bigint"))
    total, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    both = rows.groupBy("block").cogroup(answers.groupBy("block"))
    counted = staged(both.applyInArrow(_histogram(total), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))
    cells = counted.toArrow()  # at most a bounded number of cells
    discard(counted)
    mixed = weights(cells.column("code").to_numpy(), cells.column("n").to_numpy(), types)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(total, types, mixed), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
