"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each text becomes an array of word hashes. Of its k-gram hashes the minimum of every w consecutive ones is kept; any span
of k + w - 1 = `window` words that a document shares with a benchmark item therefore leaves an equal fingerprint on both
sides. Equal fingerprints are joined and each hit is extended word by word in both directions; runs of at least `window`
words count. Items shorter than the window are joined on the hash of their whole word sequence.

The benchmark's fingerprints are broadcast only when they are counted to be under `BROADCAST_BYTES`; otherwise plain
(document, fingerprint) rows are joined first and only documents with a hit are read again.

Defined cases: a null text has no words; items without words match nothing; repeated documents or items each count (equal
item ids once); rows with equal doc_id and text share one result and each keeps its row; a null doc_id is a value.

explode_outer is used on purpose: for explode() the optimizer infers a size filter and pushes it under the projections,
which would evaluate the whole fingerprint expression once more per element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagwell.llm.stage import staged

WINDOW, KGRAM = 13, 6
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(c: str) -> str:
    """SQL: array of words, only A-Z lowered; ASCII texts take the faster built-in lower()."""
    low = f"if(octet_length({c}) = char_length({c}), lower({c}), translate({c}, '{UPPER}', '{LOWER}'))"
    return f"coalesce(array_remove(split({low}, '{GAPS}', -1), ''), cast(array() as array<string>))"


def hashes(c: str) -> str:
    return f"transform({words(c)}, x -> xxhash64(x))"


def grams(h: str, k: int) -> str:
    """SQL: hash of every k consecutive elements of array h."""
    args = ", ".join(f"{h}[i + {j}]" if j else f"{h}[i]" for j in range(k))
    return f"if(size({h}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({h}) - {k}), i -> xxhash64({k}, {args})))"


def minima(g: str, w: int) -> str:
    """SQL: distinct minima of every w consecutive elements of array g."""
    return f"if(size({g}) < {w}, cast(array() as array<bigint>), array_distinct(transform(sequence(1, size({g}) - {w - 1}), i -> array_min(slice({g}, i, {w})))))"


def _prints(df: DataFrame, window: int, k: int, lengths: list[int]) -> DataFrame:
    """Adds the fingerprints f: winnowed k-grams and, for every short item length, all grams of that length."""
    df = df.withColumn("g", F.expr(grams("h", k))).withColumn("f", F.expr(minima("g", window - k + 1)))
    if lengths:
        df = df.withColumn("f", F.expr("concat(f, " + ", ".join(f"array_distinct({grams('h', n)})" for n in lengths) + ")"))
    return df


def intervals(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = KGRAM) -> DataFrame:
    """(key columns of docs, item_id, begin, end): word runs that docs share with items. docs: key..., text; items: item_id, text."""
    keys = [c for c in docs.columns if c != "text"]
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), F.expr(hashes("text")).alias("item")).filter("size(item) > 0")
    lengths = sorted(r[0] for r in bench.filter(F.size("item") < window).select(F.size("item")).distinct().collect())
    long_ = _prints(bench.filter(F.size("item") >= window).withColumnRenamed("item", "h"), window, k, [])
    long_ = long_.select("item_id", F.col("h").alias("item"), F.expr("explode_outer(f)").alias("f"), "g")
    long_ = long_.select("item_id", "item", "f", F.lit(k).alias("n"), F.expr("explode_outer(filter(sequence(0, size(g) - 1), i -> g[i] = f))").alias("q"))
    short = None
    for n in lengths:
        one = bench.filter(F.size("item") == n).select("item_id", "item", F.expr(f"{grams('item', n)}[0]").alias("f"), F.lit(n).alias("n"), F.lit(0).alias("q"))
        short = one if short is None else short.unionByName(one)
    marks = long_ if short is None else long_.unionByName(short)
    size = marks.select(F.sum(F.size("item") * 8 + 96)).first()[0] or 0

    def exploded(df: DataFrame) -> DataFrame:
        return _prints(df.withColumn("h", F.expr(hashes("text"))).drop("text"), window, k, lengths).withColumn("f", F.explode_outer("f"))

    if size <= BROADCAST_BYTES:
        hits = exploded(docs).join(F.broadcast(marks), "f")
    else:
        met = exploded(docs).select(*keys, "f").join(marks.select("f").distinct(), "f", "left_semi").select(*keys).distinct()
        again = docs.alias("d").join(met.alias("m"), [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys], "left_semi")
        hits = exploded(again).join(marks, "f")
    other = [n for n in lengths if n != k]
    whole = "CASE n " + " ".join(f"WHEN {n} THEN {grams('h', n)}" for n in other) + " ELSE g END" if other else "g"
    hits = hits.select(*keys, "item_id", "item", "h", "q", F.expr(f"explode_outer(filter(transform({whole}, (x, i) -> if(x = f, i, -1)), i -> i >= 0))").alias("p"))
    run = F.explode_outer(F.expr(f"filter(array({_run()}), z -> z.end - z.begin + 1 >= {window} OR z.end - z.begin + 1 = size(item))")).alias("z")
    return hits.select(*keys, "item_id", run).filter("z IS NOT NULL").select(*keys, "item_id", "z.begin", "z.end")


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _run() -> str:
    """SQL: begin and end, in document words, of the run of equal words around document word p and item word q.

    The item begins at document word d = p - q; a is its first word inside the document, m the words both have from there;
    run bounds are the nearest unequal words to the left and right of the hit.
    """
    body = _let("l", "if(array_position(reverse(slice(eq, 1, q - v.a)), false) = 0, 0L, q - v.a - array_position(reverse(slice(eq, 1, q - v.a)), false) + 1)",
           _let("r", "if(array_position(slice(eq, q - v.a + 1, v.m - q + v.a), false) = 0, v.m - 1L, q - v.a + array_position(slice(eq, q - v.a + 1, v.m - q + v.a), false) - 2)",
           "if(eq[q - v.a], named_struct('begin', p - q + v.a + l, 'end', p - q + v.a + r), named_struct('begin', 0L, 'end', -2L))"))
    body = _let("eq", "zip_with(slice(item, v.a + 1, v.m), slice(h, v.a + p - q + 1, v.m), (x, y) -> x = y)", body)
    return _let("v", "named_struct('a', greatest(0, q - p), 'm', least(size(item), size(h) - p + q) - greatest(0, q - p))", body)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = KGRAM, share: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. docs: doc_id, text; items: item_id, text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__x"), "text")
    found = staged(intervals(keyed, items, window, k).distinct())  # read twice below
    key = ["doc_id", "__x"]
    before = Window.partitionBy(*key).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select(*key, "begin", "end").distinct().withColumn("from", F.greatest("begin", F.coalesce(F.max("end").over(before) + 1, "begin")))
    hit = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from") + 1)).alias("n_hit"))
    named = found.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = hit.alias("h").join(named.alias("n"), [F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]).select("h.*", "items")
    rows = keyed.select(*key, F.expr(f"cast(size({words('text')}) as bigint)").alias("n_words"))
    out = rows.alias("r").join(both.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left")
    items_ = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "r.doc_id", F.col("r.__x").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
