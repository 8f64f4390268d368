"""N-gram Jaccard join with grouped prefixes.

1. Each text's distinct word n-gram hashes are its set; texts of equal sets become one vertex, named by
   a hash of the set; a component gets its smallest doc_id at the end.
2. Which n-grams are shared: tasks send their distinct n-gram hashes, packed in blocks, to hash buckets; a bucket returns
   (n-gram, block, set) rows for hashes seen in two sets. An n-gram frequent inside a block is sent as one mark, and its rows
   pass straight through, so a passage that a third of all documents hold costs a bucket one entry per block.
3. The sets' shared n-grams are ordered by frequency, rare first; n-grams of one set alone come before them. Only n-grams
   in the first n - ceil(0.75 n) + 1 places can be the first common one of a similar pair, so only these are joined.
4. Sets of identical prefix and size form one group. Group pairs that share a prefix n-gram are filtered by size and by
   position, then expanded to members, whose whole sets are intersected.
5. Large clusters of near copies don't make all pairs: first each group is verified against a few leading groups per n-gram,
   and only pairs whose sides still lie in different components are made after that, all of them. Links inside
   a component can't change it.

Defined cases: null or wordless texts have an empty set, link with nothing and are their own component; texts with fewer
words than n have their whole sequence as the only n-gram; a row with a null doc_id keeps its row and a null component; rows
of one doc_id take the component of their own text; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.llm import scan
from lagwell.llm.stage import components, discard, staged

WORDS = 5
#: Hashes a bucket should hold, hashes in a block, and leaders each n-gram list is verified against.
BUCKET, BLOCK, LEADERS = 1_000_000, 700_000, 3
_U = np.uint64
_LOW = 40


def row_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, ordered by row and hash."""
    row, g = scan.ngrams(scan.Words(texts), n, short=True)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[keep], g[keep]


def set_keys(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and order-free 64-bit hash of each row's set."""
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(scan.mix(g + _U(scan.BASE)), out=total[1:])
    first = np.searchsorted(row, np.arange(rows + 1))
    return np.diff(first), scan.mix(total[first[1:]] - total[first[:-1]])


def sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, size and s (hash) of each row's n-gram set, and the text's hash."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in scan.chunks(batch.column(1)):
                row, g = row_sets(texts, n)
                size, key = set_keys(row, g, len(texts))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(size, pa.int64()), pa.array(key.view(np.int64)), batch.column(2).slice(first, len(texts))], ["doc_id", "n", "s", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, n bigint, s bigint, text_hash bigint")


def _packed(n: int, bits: int):
    """mapInArrow function: rows (bucket, block, blob) of packed hashes, and, as bucket rows without blob, the block's sets."""

    def block_rows(block: int, row: np.ndarray, g: np.ndarray, size: np.ndarray, key: np.ndarray):
        _, keep = np.unique(key, return_index=True)  # equal sets of a block are sent once
        slot = np.full(len(key), -1)
        slot[keep] = np.arange(len(keep))
        slot[size == 0] = -1
        inside = slot[row] >= 0
        slot_of, g = slot[row][inside].astype(np.uint16), g[inside]
        order = np.argsort(g, kind="stable")
        slot_of, g = slot_of[order], g[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        group = np.cumsum(fresh) - 1
        common = np.bincount(group, minlength=1)[group] > 1 if len(g) else np.zeros(0, bool)
        bucket = (g >> _U(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        live = keep[size[keep] > 0]
        out = {"bucket": [], "block": [], "blob": [], "slot": [], "n": [], "s": []}
        for b in range(1 << bits):
            i, j = cuts[b], cuts[b + 1]
            if i == j:
                continue
            one, many = ~common[i:j], common[i:j]
            low = (g[i:j] & _U((1 << _LOW) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
            blob = b"".join([np.int64([one.sum()]).tobytes(), low[one].T.tobytes(), slot_of[i:j][one].tobytes(), low[many].T.tobytes(), slot_of[i:j][many].tobytes()])
            for k, v in (("bucket", b), ("block", block), ("blob", blob), ("slot", None), ("n", None), ("s", None)):
                out[k].append(v)
        for x in live:
            for k, v in (("bucket", int(slot[x]) % (1 << bits)), ("block", block), ("blob", None), ("slot", int(slot[x])), ("n", int(size[x])), ("s", int(key[x].view(np.int64)))):
                out[k].append(v)
        return pa.RecordBatch.from_pydict(out, schema=_PACKED)

    def run(batches):
        import os
        from pyspark import TaskContext

        # the block number needs to be unique and the same if the task runs again
        part, count = TaskContext.get().partitionId(), 0
        held, rows, hashes = [], 0, 0

        def flush():
            row = np.concatenate([r + o for r, _, _, _, o in held])
            parts = [np.concatenate([x[i] for x in held]) for i in (1, 2, 3)]
            return block_rows((part << 20) + count, row, *parts)

        for batch in batches:
            for _, texts in scan.chunks(batch.column(0)):
                row, g = row_sets(texts, n)
                held.append((row, g, *set_keys(row, g, len(texts)), rows))
                rows, hashes = rows + len(texts), hashes + len(g)
                if hashes >= BLOCK or rows > 40_000:
                    yield flush()
                    held, rows, hashes, count = [], 0, 0, count + 1
        if held:
            yield flush()

    return run


_PACKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("blob", pa.binary()), ("slot", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])
_SHARED = pa.schema([("token", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("s", pa.int64())])


def _planes(blob: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    out = np.zeros((count, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8, 5 * count, at).reshape(5, count).T
    return out.view(np.int64).ravel(), at + 5 * count


def _shared(batches):
    """Rows (token, place) of hashes that two sets of the bucket hold, and the rows (place, n, s) of sets, passed through."""

    def rows(token, place):
        for i in range(0, len(token), 100_000):
            t = token[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(place[i : i + 100_000]), pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64())], schema=_SHARED)

    tokens, places, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        own = batch.filter(pa.compute.is_valid(batch.column("slot")))
        if len(own):
            place = (own.column("block").to_numpy(zero_copy_only=False) << 16) + own.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(place), own.column("n"), own.column("s")], schema=_SHARED)
        for bucket, block, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "blob")), strict=True):
            if blob is None:
                continue
            one = int(np.frombuffer(blob, np.int64, 1)[0])
            low, at = _planes(blob, 8, one)
            slot = np.frombuffer(blob, np.uint16, one, at)
            tokens.append(low + (bucket << _LOW))
            places.append(slot.astype(np.int64) + (block << 16))
            many = (len(blob) - at - 2 * one) // 7
            low, at = _planes(blob, at + 2 * one, many)
            slot = np.frombuffer(blob, np.uint16, many, at).astype(np.int64)
            yield from rows(low + (bucket << _LOW), slot + (block << 16))
            marks.append(np.unique(low + (bucket << _LOW)))
    token, place, mark = map(np.concatenate, (tokens, places, marks))
    every = np.sort(np.concatenate([token, mark]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    if len(twice):
        found = np.minimum(np.searchsorted(twice, token), len(twice) - 1)
        keep = twice[found] == token
        yield from rows(token[keep], place[keep])


def shared_grams(docs: DataFrame, total: int, n: int = WORDS) -> DataFrame:
    """Per distinct set with a prefix n-gram that another set holds: s, n and its shared n-grams, rare first."""
    bits = max(3, int(np.ceil(np.log2(max(1, total / BUCKET)))))
    blobs = docs.select("text").mapInArrow(_packed(n, bits), "bucket bigint, block bigint, blob binary, slot bigint, n bigint, s bigint")
    rows = staged(blobs.repartition(1 << bits, "bucket").mapInArrow(_shared, "token bigint, place bigint, n bigint, s bigint"))
    places = rows.filter("token IS NULL").groupBy("s", "n").agg(F.min("place").alias("place"))
    pairs = rows.filter("token IS NOT NULL").select("token", "place")
    often = pairs.groupBy("token").agg(F.count("*").alias("df"))
    lists = pairs.join(often, "token").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    out = staged(lists.join(places, "place").select("s", "n", F.expr("t.token").alias("tokens")).filter("n - size(tokens) < n - ceil(0.75 * n) + 1"))
    discard(rows)
    return out


def linked(edges: DataFrame, whole: DataFrame) -> DataFrame:
    """The candidate pairs (a, b of vid) whose whole sets reach the similarity; whole: vid, n, tokens."""
    x, y = (whole.select(F.col("vid").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab")
    met = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(x, "a").join(y, "b")
    return met.filter("7 * size(array_intersect(ta, tb)) >= 3 * (na + nb)").select("a", "b")


def near_duplicates(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    return grouped(docs, n).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, text_hash and c, which names the component where ids repeat (null: an empty set)."""
    each = staged(sets(docs, n))
    named = each.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s", "n").agg(F.min("doc_id").alias("least")).withColumn("vid", F.xxhash64("s", "n"))
    total = named.agg(F.sum("n")).first()[0] or 0
    grams = shared_grams(docs.filter("doc_id IS NOT NULL"), total, n)
    whole = staged(grams.join(named, ["s", "n"]).select("vid", "n", "tokens"))
    discard(grams)
    own = "n - size(tokens)"
    first = whole.withColumn("prefix", F.expr(f"slice(tokens, 1, cast(n - ceil(0.75 * n) + 1 - ({own}) as int))"))
    first = first.withColumn("g", F.when(F.expr(f"{own} > 0"), F.col("vid")).otherwise(F.xxhash64("n", "prefix")))
    first = staged(first.select("vid", "n", "g", F.expr(own).alias("own"), "prefix"))
    groups = first.groupBy("g", "n").agg(F.min("vid").alias("gid"), F.min_by("own", "vid").alias("own"), F.min_by("prefix", "vid").alias("prefix"))
    members = staged(first.join(groups.select("g", "n", "gid"), ["g", "n"]).select("gid", "vid"))
    entries = groups.select("gid", "n", "own", F.posexplode("prefix").alias("at", "token")).select("token", "gid", "n", "own", (F.col("own") + F.col("at")).alias("pos"))
    entries = staged(entries)
    discard(first)
    # leaders: members against the group's first, groups against one leading group per n-gram and seed
    lead = members.filter("gid <> vid").select(F.col("gid").alias("a"), F.col("vid").alias("b"))
    for seed in range(LEADERS):
        # the first leader has the fewest n-grams of its own, so it is nearest to what the texts of a cluster share
        rank = F.struct(F.lit(0.0) if seed else F.col("own") / F.col("n"), F.xxhash64(F.lit(seed), "gid"))
        top = entries.groupBy("token").agg(F.min_by("gid", rank).alias("a"), F.min_by("n", rank).alias("m"), F.count("*").alias("k")).filter("k > 1")
        met = entries.join(top, "token").filter("a <> gid AND 3 * n <= 4 * m AND 3 * m <= 4 * n")
        lead = lead.unionByName(met.select("a", F.col("gid").alias("b")))
    links = staged(linked(lead, whole))
    label = staged(components(links))
    parts = members.join(label.withColumnRenamed("v", "vid"), "vid", "left").withColumn("c", F.coalesce("c", "vid"))
    sub = staged(parts.groupBy("gid", "c").agg(F.collect_list("vid").alias("vids")))
    # the rest: all group pairs with a common prefix n-gram whose sides lie in different components
    listed = entries.drop("own").join(sub.select("gid", "c"), "gid")
    sizes = listed.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("c", "k").alias("main"), F.count("*").alias("cs")).filter("cs > 1")
    mixed = staged(listed.join(sizes, "token"))
    discard(entries, members, label)
    x = mixed.filter("c <> main").select("token", F.col("gid").alias("g1"), F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    y = mixed.select("token", F.col("gid").alias("g2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    able = "c1 <> c2 AND 3 * n1 <= 4 * n2 AND 3 * n2 <= 4 * n1 AND 7 * least(n1 - p1, n2 - p2) >= 3 * (n1 + n2)"
    pairs = x.join(y, "token").filter(able).select("g1", "c1", "g2", "c2").distinct()
    p1, p2 = (sub.select(F.col("gid").alias(f"g{i}"), F.col("c").alias(f"c{i}"), F.col("vids").alias(f"v{i}")) for i in (1, 2))
    rest = pairs.join(p1, ["g1", "c1"]).join(p2, ["g2", "c2"]).select(F.explode("v1").alias("a"), "v2").select("a", F.explode("v2").alias("b"))
    more = staged(linked(rest, whole))
    discard(mixed, sub, whole)
    label = components(links.unionByName(more))
    out = named.join(label.withColumnRenamed("v", "vid"), "vid", "left").select("s", "n", "least", F.coalesce("c", "vid").alias("c"))
    out = out.drop("least").join(out.groupBy("c").agg(F.min("least").alias("component_id")), "c")
    joined = each.filter("n > 0").join(out, ["s", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "text_hash", "c")
    alone = each.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("bigint").alias("c"))
    return joined.unionByName(alone).withColumnRenamed("n", "n_shingles")
