"""Spelling variants: words one edit apart, found over permuterm rotations, and each word's more frequent form.

1. Runs of letters are counted: tasks scan bytes with numpy and count exact strings, the counts are added by word.
2. Each word is closed by a terminator and all its rotations are taken. The rotation that ends with the character at place i is what
   an edit at that place leaves (its prefix) and the character that is edited. So words that differ by a replaced character share a
   prefix with different last characters, and a word that lacks the character has that prefix as a whole rotation.
3. Rotations are dealt by prefix and sorted; equal prefixes stand together, one row per last character. A group has no more rows
   than the alphabet has letters, so no group is large however frequent a word is. A scan emits per row how many
   neighbours the group gives it and the best of them, never the pairs.
4. A character inside a run of equal ones can be deleted at several places with one result, so only the first place of a
   run meets whole rotations: each neighbour is met once, and counts add up without a distinct.
5. A word's form is its neighbour of largest count, where that is at least `RATIO` times the word's own. Counts grow along
   forms, so there are no cycles; roots are found by pointer doubling, whose rounds are the logarithm of the longest chain.

Defined cases: null and empty texts have no words; a null doc_id is hashed as an empty string; repeated rows count again; a letter run of
any length is one word; a word without neighbours has n_near 0, no form and itself as root; ties of count go
to the smallest word in code-point order; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.llm import scan
from lagwell.llm.stage import discard, staged

LENGTH, OCCURRENCES, RATIO, DROP = 5, 3, 2, 97
#: Bytes of text that a task counts at once, and bytes of a run above which it is hashed alone.
PIECE, WIDE = 1 << 22, 64
_U = np.uint32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=_U)
    for _ in range(8):
        out = np.where(out & _U(1), (out >> _U(1)) ^ _U(0xEDB88320), out >> _U(1))
    return out


_TABLE = _crc_table()


def run_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of data, carried on from the CRC in start."""
    order = np.argsort(-size, kind="stable")
    at, width = begin[order], size[order]
    crc = start[order] ^ _U(0xFFFFFFFF)
    wide = int(np.searchsorted(-width, -WIDE))
    for k in range(int(width[wide]) if wide < len(width) else 0):
        live = slice(wide, int(np.searchsorted(-width, -k)))
        crc[live] = _TABLE[(crc[live] ^ data[at[live] + k]) & _U(255)] ^ (crc[live] >> _U(8))
    out = np.empty_like(crc)
    out[order] = crc ^ _U(0xFFFFFFFF)
    for i in order[:wide]:
        out[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]].tobytes(), int(start[i]))
    return out


def counted_runs(ids: list[str], texts: pa.Array, drop: int = DROP, length: int = LENGTH) -> pa.StructArray:
    """Distinct words of at least `length` code points in the texts with their counts."""
    data, begins = scan.flat(texts)
    lead = data == 0xC3  # of U+00C0 to U+00FF in UTF-8
    inside = (data >= 0x61) & (data <= 0x7A) | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin
    row = np.searchsorted(begins, begin, "right") - 1
    start = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), _U, len(ids))
    crc = run_hashes(data, begin, size, start[row])
    more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    points = size - (more[end] - more[begin])
    changed = crc % _U(drop) == 0
    kept = ~changed & (points >= length)
    body = data[inside][np.repeat(kept, size)]
    offsets = np.concatenate([[0], np.cumsum(size[kept])])
    words = pa.StringArray.from_buffers(int(kept.sum()), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
    short = []
    for i in np.flatnonzero(changed & (points > length)):
        word = data[begin[i] : end[i]].tobytes().decode()
        at = int(crc[i]) % len(word)
        short.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([words, pa.array(short, pa.string())]).value_counts()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts with at least `OCCURRENCES` occurrences."""

    def run(batches):
        for batch in batches:
            for first, texts in scan.chunks(batch.column(1), PIECE):
                ids = [i or "" for i in batch.column(0).slice(first, len(texts)).to_pylist()]
                words = counted_runs(ids, texts)
                yield pa.RecordBatch.from_arrays([words.field("values"), words.field("counts")], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string"), "text").filter("text <> ''").mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def rotations(words: DataFrame) -> DataFrame:
    """Rows (prefix, char, n, first): rotations without their last character, and whole rotations with an empty one."""
    rest = "concat(substring(word, i + 1), '$', substring(word, 1, i - 1))"
    char = "substring(word, i, 1)"
    ends = f"transform(sequence(1, char_length(word)), i -> struct({rest} AS prefix, {char} AS char, i = 1 OR {char} <> substring(word, i - 1, 1) AS first))"
    whole = "transform(sequence(0, char_length(word)), i -> struct(concat(substring(word, i + 1), '$', substring(word, 1, i)) AS prefix, '' AS char, true AS first))"
    return words.select("n", F.explode(F.expr(f"concat({ends}, {whole})")).alias("r")).select("r.prefix", "r.char", "n", "r.first")


_MET = pa.schema([("prefix", pa.string()), ("char", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("best", pa.string())])


def _best(group: np.ndarray, n: np.ndarray, char: np.ndarray, groups: int):
    """Per group the rows of the largest and the second count (smallest character on ties); -1 where there is none."""
    order = np.lexsort((char, -n, group))
    first = np.searchsorted(group[order], np.arange(groups + 1))
    one = np.where(np.diff(first) > 0, order[np.minimum(first[:-1], max(len(order) - 1, 0))] if len(order) else -1, -1)
    two = np.where(np.diff(first) > 1, order[np.minimum(first[:-1] + 1, max(len(order) - 1, 0))] if len(order) else -1, -1)
    return one, two, np.diff(first)


def met(rows: pa.Table) -> pa.RecordBatch:
    """Neighbours inside whole groups of equal prefixes: per row their number and the best, once for either kind of edit."""
    prefix, n = rows.column("prefix").combine_chunks(), rows.column("n").to_numpy()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = ~pa.compute.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(fresh) - 1
    groups = int(group[-1]) + 1
    char = np.array(rows.column("char").to_pylist(), dtype=np.str_)
    part = char != ""
    out = []

    def emit(at, k, best):
        out.append((at, k, n[best], best))

    own = np.flatnonzero(part)
    one, two, size = _best(group[own], n[own], char[own], groups)
    mate = own[size[group[own]] > 1]
    top = own[one[group[mate]]]
    emit(mate, size[group[mate]] - 1, np.where(top == mate, own[two[group[mate]]], top))
    lacks = np.full(groups, -1)  # the word that is the prefix itself
    lacks[group[~part]] = np.flatnonzero(~part)
    able = np.flatnonzero(part & rows.column("first").to_numpy(zero_copy_only=False))
    able = able[lacks[group[able]] >= 0]
    emit(able, np.ones(len(able), np.int64), lacks[group[able]])
    one, _, size = _best(group[able], n[able], char[able], groups)
    has = np.flatnonzero(size > 0)
    emit(lacks[has], size[has], able[one[has]])
    at, k, count, best = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([prefix.take(pa.array(at)), pa.array(char[at].tolist(), pa.string()), pa.array(k), pa.array(count), pa.array(char[best].tolist(), pa.string())], schema=_MET)


def _scan(batches):
    """Walks sorted rotations; a group that a batch leaves open is carried over."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        prefix = rows.column("prefix").combine_chunks()
        same = pa.compute.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        cut = len(rows) - 1
        while cut and same[cut - 1]:
            cut -= 1
        held = rows.slice(cut)
        shared = np.zeros(cut, bool)  # rows with a neighbour of equal prefix
        shared[1:] |= same[: max(cut - 1, 0)]
        shared[:-1] |= same[: max(cut - 1, 0)]
        if shared.any():
            yield met(rows.slice(0, cut).filter(pa.array(shared)))
    if held is not None and len(held) > 1:
        yield met(held)


def neighbours(words: DataFrame) -> DataFrame:
    """Per word with a word one edit apart: word, n_near, near (the one of largest count) and near_n."""
    # few short prefixes, but one row for every last character: sorted groups are small in every task
    rows = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    found = rows.mapInArrow(_scan, "prefix string, char string, k bigint, n bigint, best string")
    word = lambda c: F.expr(f"concat(substring_index(prefix, '$', -1), {c}, substring_index(prefix, '$', 1))")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("near")))
    out = found.select(word("char").alias("word"), "k", "n", word("best").alias("near"))
    return out.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the end of each chain of forms, by pointer doubling."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = new
        if not new.filter("moved").head(1):
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Per word of docs (doc_id, text): word, form, root, n, n_near, form_n."""
    words = staged(word_counts(docs))
    near = neighbours(words)
    form = F.when(F.col("near_n") >= RATIO * F.col("n"), F.col("near"))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n"))
    rows = staged(rows)
    discard(words)
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
