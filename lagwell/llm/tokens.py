"""Token ids of a public tokenizer in a compact file format.

Texts are dealt out and sorted by doc_id, encoded, and kept as shards of about `SHARD` ids. The ids of all shards are
counted; each id is then written as its rank by falling frequency in 1 to 4 bytes, lowest byte first, and the byte counts
stand apart as 2-bit codes, four to a control byte. Decoding looks the control bytes up in a 256 x 4 table of lengths.

The files are Parquet tables in the given folder (so any store that Spark writes to will do): `ranks` (rank, id) and
`shards` (part, seq, doc_ids, counts, start in its part, control, data). A corpus position is the part's base plus that.

Encoding splits texts only where the tokenizer's own pre-tokenizer must split them (after a Latin letter before an
ASCII character that is no letter, before ASCII white space that follows an ASCII mark, and before one space that an ASCII
mark follows), so that each distinct piece is encoded once per task; tests compare this with encoding whole texts.

Defined cases: a null text is empty and has the end id alone; null doc_ids sort first; equal doc_ids are ordered by their
texts' hash; special-token strings in a text are ordinary text; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.llm import scan
from lagwell.llm.stage import discard, shared_folder, staged

SHARD, CACHE = 1 << 20, 1_200_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)  # printable ASCII without the space
_MARK[0x21:0x7F] = True


class Encoder:
    """Encodes batches of texts; distinct pieces are remembered, at most `CACHE` of them, in arrays sorted by their hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _places(self, keys: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and count, in self.ids, of sorted distinct keys; new pieces are encoded first."""
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        to = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[to < len(self.keys)] = self.keys[to[to < len(self.keys)]] == keys[to < len(self.keys)]
        if not known.all():
            raw, new = data.tobytes(), np.flatnonzero(~known)
            ids, sizes = self._encoded([raw[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            while len(self.ids) < self.used + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.at = np.insert(self.at, to[new], self.used + np.cumsum(sizes) - sizes)
            self.size, self.keys = np.insert(self.size, to[new], sizes), np.insert(self.keys, to[new], keys[new])
            self.used += len(ids)
            to = np.searchsorted(self.keys, keys)
        return self.at[to], self.size[to]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each text's closed by id 0, and their counts."""
        data, begins = scan.flat(texts, scan.AS_IS)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        prev, here = data[:-1], data[1:]
        after = np.append(data[2:], 0x20)
        lead = np.append(np.uint8(0), data[:-1])
        letter = _LETTER[data] | (data >= 0xC3) & (data <= 0xC5)  # two-byte letters: U+00C0 to U+017F but for two signs
        letter |= (lead >= 0xC3) & (lead <= 0xC5) & ~((lead == 0xC3) & ((data == 0x97) | (data == 0xB7)))
        letter[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        cut = letter[:-1] & ~letter[1:] & (here < 0x80)
        cut |= _MARK[prev] & scan.SPACE[here]
        cut |= ~scan.SPACE[prev] & (here == 0x20) & _MARK[after]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = cut
        edge[begins] = True
        edge[begins[1:] - 1] = True  # the space that flat() puts after each text is a piece of its own, and left out
        begin = np.flatnonzero(edge[:-1])
        end = np.append(begin[1:], len(data))
        inside = np.ones(len(data), bool)
        inside[begins[1:] - 1] = False
        keep = inside[begin]
        begin, end = begin[keep], end[keep]
        keys, first, back = np.unique(scan.span_hashes(data, begin, end), return_index=True, return_inverse=True)
        at, size = self._places(keys, first, begin, end, data)
        piece_len, piece_at = size[back], at[back]
        text = np.searchsorted(begins, begin, side="right") - 1
        counts = np.bincount(text, weights=piece_len, minlength=len(begins) - 1).astype(np.int64) + 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.uint32)
        place = np.ones(len(out), bool)
        place[ends - 1] = False
        run = np.cumsum(piece_len)
        source = np.arange(int(run[-1]) if len(run) else 0) + np.repeat(piece_at - run + piece_len, piece_len)
        out[place] = self.ids[source]
        return out, counts


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker; its pieces serve all tasks of the worker."""
    return Encoder(path)


_RAW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _encode(path: str):
    def run(batches):
        from pyspark import TaskContext

        encode, part, seq, at = encoder(path), TaskContext.get().partitionId(), 0, 0
        held: list = []

        def shard():
            n = sum(len(x[2]) for x in held)
            ids = np.concatenate([x[2] for x in held])
            kind = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "doc_ids": [[y for x in held for y in x[0].to_pylist()]], "counts": [np.concatenate([x[1] for x in held]).tolist()],
                 "start": [at], "n": [n], "ids": [np.uint8([kind().itemsize]).tobytes() + ids.astype(kind).tobytes()]}, schema=_RAW)

        for batch in batches:
            for first, texts in scan.chunks(batch.column(1)):
                ids, counts = encode(texts)
                held.append((batch.column(0).slice(first, len(texts)), counts, ids))
                if sum(len(x[2]) for x in held) >= SHARD:
                    yield shard()
                    at, seq, held = at + sum(len(x[2]) for x in held), seq + 1, []
        if held:
            yield shard()

    return run


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, {2: np.uint16, 4: np.uint32}[blob[0]], offset=1)


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            n = np.bincount(_ids(blob))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[: len(n)] += n
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "k"])


#: Byte counts of four values by control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    return (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def write(docs: DataFrame, folder: str, tokenizer: str) -> None:
    """Writes docs (doc_id, text) in ascending doc_id order to a new folder."""
    spark = docs.sparkSession
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("x"))
    dealt = dealt.repartitionByRange("doc_id", "x").sortWithinPartitions("doc_id", "x").select("doc_id", "text")
    kinds = "part bigint, seq bigint, doc_ids array<bigint>, counts array<bigint>, start bigint, n bigint"
    raw = staged(dealt.mapInArrow(_encode(tokenizer), kinds + ", ids binary"), compression="zstd")
    counted = raw.select("ids").mapInArrow(_count, "id bigint, k bigint").groupBy("id").agg(F.sum("k").alias("k"))
    order = [r.id for r in counted.orderBy(F.desc("k"), "id").collect()]  # at most the vocabulary
    spark.createDataFrame(list(enumerate(order)), "rank bigint, id bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))

    def recode(batches):
        for batch in batches:
            packed = [pack(rank[_ids(x)]) for x in batch.column("ids").to_pylist()]
            cols = [batch.column(i) for i in range(6)] + [pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:6], "control", "data"])

    raw.mapInArrow(recode, kinds + ", control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/shards")
    discard(raw)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian 32 bit)."""
    shards = spark.read.parquet(f"{folder}/shards")
    ids = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per written part
    bases, at = {}, 0
    for r in parts:
        bases[r.part], at = at, at + r.n

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values = ids[unpack(row["control"], row["data"], row["n"])]
                ends = np.cumsum(row["counts"])
                raw = values.tobytes()
                cut = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - row["counts"] + row["start"] + bases[row["part"]]), pa.array(row["counts"], pa.int64()),
                     pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return shards.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes docs to a folder (a new one in the shared folder by default) and reads them back without the ids."""
    import uuid

    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer)
    return read(docs.sparkSession, folder).drop("ids")
