"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by (source, language, topic). Raking multiplies the cells by factors until the three margins have their
target shares. As no document is kept twice, the probabilities p of keeping are raked under the bound p <= 1, so that the kept
tokens have the target shares. They can do so only in a share that leaves the values that gain enough tokens: without a
wanted share it is the largest one found, at most `SHARE`; with a wanted share, values too small for their target are kept whole and
the others share the rest in proportion to their targets. Values below `MINOR` of the tokens are treated so in both cases.
The draw is a hash of doc_id, so it is the same in every run. Targets are given per value or, by
default, as the natural share to a power below 1, normalised: small sources gain, large ones lose.

The cells are as many as the combinations of values that occur. Up to `CELLS` of them are raked on the driver; more are
raked as a table, with the same results.

Defined cases: null source or language is the value "", null or empty text has the topic "empty" and one token; targets of values
that don't occur are left out and the others scaled up; an occurring value without target gets no weight; repeated doc_ids share
a draw; a null doc_id draws as the text "".
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.llm.stage import staged

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
CELLS, ROUNDS, SHARE = 100_000, 30, 0.9
#: Without a wanted share: values below this part of the tokens don't hold the others back; how far a kept share may be off its target
#: (relative), and by what factor the share is lowered, and how far, while one is further off.
MINOR, OFF, LOWER, LEAST = 1e-3, 0.01, 0.95, 0.01


def described(docs: DataFrame) -> DataFrame:
    """docs with `__source`, `__lang`, `__topic`, `__tokens` (words, at least one) from its columns and whole text."""
    text = "coalesce(text, '')"
    digits, chars = f"char_length({text}) - char_length(translate({text}, '0123456789', ''))", f"char_length({text})"
    lines = f"{chars} - char_length(replace({text}, '\\n', ''))"
    topic = f"CASE WHEN {chars} = 0 THEN 'empty' WHEN 20 * ({digits}) >= {chars} THEN 'numbers' WHEN 60 * ({lines}) >= {chars} THEN 'lines' ELSE 'prose' END"
    return docs.withColumns({
        "__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__topic": F.expr(topic),
        "__tokens": F.expr(f"greatest(1L, cast(size(array_remove(split({text}, r'[\\x20\\x09-\\x0D]+', -1), '')) as bigint))"),
    })


def _targets(shares: dict[str, float], given: dict[str, float] | None, power: float) -> dict[str, float]:
    raw = {k: given.get(k, 0.0) for k in shares} if given else {k: v**power for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else shares


def rake(tokens: np.ndarray, values: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Factors per cell; values and targets: per dimension the cells' value numbers and the values' target shares."""
    factor = np.ones(len(tokens))
    for _ in range(rounds):
        for v, t in zip(values, targets, strict=True):
            now = np.bincount(v, weights=tokens * factor, minlength=len(t)) / tokens.sum()
            factor = factor * np.where(now > 0, t / np.where(now > 0, now, 1), 0)[v]
    return factor


def _level(kept, share: float) -> float:
    """k for which kept(k), the expected share of kept tokens, is the wanted one, by bisection of its logarithm."""
    low, high = 1e-9, 1e9
    for _ in range(60):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if kept(mid) < share else (low, mid)
    return high


def reachable(natural: np.ndarray, wanted: np.ndarray, share: float) -> np.ndarray:
    """Target shares of the kept tokens: a value that is too small for its target at this share is kept whole, the others scale up."""
    most, held = natural / share, np.zeros(len(wanted), bool)
    while True:
        rest = wanted[~held].sum()
        scale = (1 - most[held].sum()) / rest if rest > 0 else 0.0
        over = ~held & (wanted * scale > most * (1 + 1e-12))
        if not over.any():
            return np.where(held, most, wanted * scale)
        held |= over


def bounded(tokens: np.ndarray, values: list[np.ndarray], wanted: list[np.ndarray], share: float, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities per cell, raked under p <= 1: cells at 1 are held there and the rest takes up what they lack."""
    p, total = np.full(len(tokens), share), tokens.sum()
    for _ in range(rounds):
        for v, t in zip(values, wanted, strict=True):
            now = np.bincount(v, weights=tokens * np.minimum(1, p), minlength=len(t)) / total
            held = np.bincount(v, weights=tokens * (p >= 1), minlength=len(t)) / total
            p = np.minimum(p * _step(now, held, t * share)[v], 1e12)
    return np.minimum(1, p)


def _step(now: np.ndarray, held: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Factor for each value's cells; both forms approach the wanted sum from one side only."""
    free = now - held
    grow = np.where(free > 1e-15, (want - held) / np.where(free > 1e-15, free, 1), 1.0)
    return np.where(want > now, np.maximum(grow, 1.0), np.where(now > 0, want / np.where(now > 0, now, 1), 0.0))


def _shares(natural: list[np.ndarray], wanted: list[np.ndarray]) -> float:
    """The largest share, at most `SHARE`, that every value of at least `MINOR` of the tokens can meet its target in."""
    return min([SHARE, *(float(x) for n, t in zip(natural, wanted, strict=True) for x in (n / np.where(t > 0, t, 1))[(t > 0) & (n >= MINOR)])])


def probabilities(docs: DataFrame, targets: dict | None = None, share: float | None = None, most: int = CELLS) -> DataFrame:
    """(__source, __lang, __topic, tokens, factor, p) of every cell of described docs."""
    spark, names, targets = docs.sparkSession, [f"__{d}" for d in DIMENSIONS], targets or {}
    cells = staged(docs.groupBy(*names).agg(F.sum("__tokens").alias("tokens")))
    if cells.count() > most:
        return _large(cells, names, targets, share)
    rows = cells.orderBy(*names).toPandas()
    if not len(rows):
        return cells.withColumns({"factor": F.lit(1.0), "p": F.lit(1.0)})
    tokens, values, wanted, natural = rows["tokens"].to_numpy(float), [], [], []
    for d, c in zip(DIMENSIONS, names, strict=True):
        kinds, v = np.unique(rows[c].to_numpy(str), return_inverse=True)
        n = np.bincount(v, weights=tokens) / tokens.sum()
        t = _targets(dict(zip(kinds.tolist(), n.tolist(), strict=True)), targets.get(d), POWERS[d])
        values.append(v), natural.append(n), wanted.append(np.array([t[k] for k in kinds.tolist()]))
    rows["factor"] = rake(tokens, values, wanted)
    reach = tokens[rows["factor"].to_numpy() > 0].sum() / tokens.sum()
    now = min(_shares(natural, wanted) if share is None else share, reach)
    while True:
        met = [reachable(n, t, now) for n, t in zip(natural, wanted, strict=True)]
        p = bounded(tokens, values, met, now)
        kept = tokens * p / (tokens * p).sum()
        off = max(float((np.abs(np.bincount(v, weights=kept, minlength=len(t)) - t) / np.maximum(t, MINOR)).max()) for v, t in zip(values, met, strict=True))
        if share is not None or off <= OFF or now < LEAST:
            break
        now *= LOWER
    k = _level(lambda k: float((tokens * np.minimum(1, k * p)).sum() / tokens.sum()), now)
    rows["p"] = np.minimum(1, k * p)
    return F.broadcast(spark.createDataFrame(rows))  # at most `most` cells


def _large(cells: DataFrame, names: list[str], targets: dict, share: float | None) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("factor", F.lit(1.0))
    wanted = {}
    for d, c in zip(DIMENSIONS, names, strict=True):
        t = cells.groupBy(c).agg((F.sum("tokens") / total).alias("s"))
        given = targets.get(d)
        raw = F.pow("s", F.lit(POWERS[d])) if not given else F.coalesce(F.create_map([F.lit(x) for kv in given.items() for x in kv])[F.col(c)], F.lit(0.0))
        t = staged(t.withColumn("t", raw))
        wanted[c] = t.withColumn("t", F.col("t") / t.agg(F.sum("t")).first()[0]).select(c, "s", "t")
    for _ in range(ROUNDS):
        for c in names:
            sums = now.groupBy(c).agg((F.sum(F.col("tokens") * F.col("factor")) / total).alias("now"))
            step = sums.join(wanted[c], c).select(c, F.when(F.col("now") > 0, F.col("t") / F.col("now")).otherwise(0.0).alias("step"))
            now = now.join(step, c).withColumn("factor", F.col("factor") * F.col("step")).drop("step")
        now = staged(now)
    level = share
    if share is None:
        lows = [t.filter(f"t > 0 AND s >= {MINOR}").agg(F.min(F.col("s") / F.col("t"))).first()[0] for t in wanted.values()]
        level = min([SHARE, *(x for x in lows if x is not None)])
    level = min(level, now.agg(F.sum(F.when(F.col("factor") > 0, F.col("tokens")).otherwise(0))).first()[0] / total)
    while True:
        met = {c: staged(_reachable(t, level)) for c, t in wanted.items()}
        out = _bounded(now, names, met, level, total)
        kept = out.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0]
        off = max(out.groupBy(c).agg((F.sum(F.col("tokens") * F.col("p")) / kept).alias("now")).join(met[c], c)
                  .agg(F.max(F.abs(F.col("now") - F.col("t")) / F.greatest("t", F.lit(MINOR)))).first()[0] for c in names)
        if share is not None or off <= OFF or level < LEAST:
            break
        level *= LOWER
    k = _level(lambda k: out.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), k * F.col("p")))).first()[0] / total, level)
    return out.withColumn("p", F.least(F.lit(1.0), F.lit(k) * F.col("p")))


def _reachable(t: DataFrame, share: float) -> DataFrame:
    """`reachable` as a table of a value, its natural share s and its target t."""
    scale, bound = 1.0, 0
    while True:
        over = F.col("t") * F.lit(scale) * (1 - 1e-12) > F.col("s") / share
        held, rest, n = t.agg(F.sum(F.when(over, F.col("s") / share).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("t"))), F.count(F.when(over, 1))).first()
        if n == bound:
            return t.withColumn("t", F.least(F.col("s") / share, F.col("t") * F.lit(scale)))
        scale, bound = ((1 - held) / rest if rest > 0 else scale), n


def _bounded(cells: DataFrame, names: list[str], wanted: dict, share: float, total: float) -> DataFrame:
    """`bounded` as a table."""
    now = cells.withColumn("p", F.lit(share))
    for _ in range(ROUNDS):
        for c in names:
            tokens = F.col("tokens") / total
            sums = now.groupBy(c).agg(F.sum(tokens * F.least(F.lit(1.0), "p")).alias("now"), F.sum(F.when(F.col("p") >= 1, tokens).otherwise(0.0)).alias("held"))
            sums = sums.join(wanted[c], c).withColumns({"want": F.col("t") * share, "free": F.col("now") - F.col("held")})
            grow = F.when(F.col("free") > 1e-15, F.greatest(F.lit(1.0), (F.col("want") - F.col("held")) / F.col("free"))).otherwise(1.0)
            step = F.when(F.col("want") > F.col("now"), grow).when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0)
            now = now.join(sums.select(c, step.alias("step")), c).withColumn("p", F.least(F.lit(1e12), F.col("p") * F.col("step"))).drop("step")
        now = staged(now)
    return now.withColumn("p", F.least(F.lit(1.0), "p"))


def mixed(docs: DataFrame, targets: dict | None = None, share: float | None = None, most: int = CELLS) -> DataFrame:
    """docs with all its columns and topic, tokens, factor, p, draw and kept (each prefixed `mix_`, in place of columns of these names)."""
    kept = [c for c in docs.columns if c not in ("mix_topic", "mix_tokens", "mix_factor", "mix_p", "mix_draw", "mix_kept")]
    # the row travels as one struct, so that none of its names meets those of the tables it is joined with
    rows = described(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), "doc_id", "text", "source", "lang"))
    cells = probabilities(rows, targets, share, most).select(*[f"__{d}" for d in DIMENSIONS], F.col("factor").alias("mix_factor"), F.col("p").alias("mix_p"))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = rows.join(cells, [f"__{d}" for d in DIMENSIONS])
    return out.select(
        "__row.*", F.col("__topic").alias("mix_topic"), F.col("__tokens").alias("mix_tokens"), "mix_factor", "mix_p",
        draw.alias("mix_draw"), (draw < F.col("mix_p")).alias("mix_kept"),
    )
