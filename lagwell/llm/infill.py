"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix at unit ends and put in another order.

One `fullmatch` of (unit)* of the regex library keeps every repetition of its group, so `ends(1)` gives the number of units and
the offset of each possible cut. Two hash numbers choose the cuts, a third whether the text changes, a fourth the order:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle        plain: the text

A text that holds a marker stays plain, so `restored` finds the markers of an output without doubt and rebuilds the exact text.

Defined cases: null and empty texts are plain with 0 units; a null doc_id is hashed as an empty string; rows of one doc_id are cut by
the same hash numbers, each over its own text; texts are matched whole, and those of over `LONG` code points in several
matches that follow one another, as a match keeps about 450 bytes per repetition; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwell.llm import scan

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
#: Code points that one match takes at most, and repetitions that each match of a longer text takes.
LONG, REPEATS = 1 << 22, 1 << 17


def unit_ends(text: str, unit: str = LINES, long: int = LONG, repeats: int = REPEATS) -> list[int]:
    """Offsets at which the units of text end, from left to right."""
    if len(text) <= long:
        found = regex.fullmatch(f"({unit})*", text)
        if found is None:
            raise ValueError("the units must cover every text")
        return found.ends(1)
    some, out, at = regex.compile(f"({unit}){{1,{repeats}}}"), [], 0
    while at < len(text):
        found = some.match(text, at)
        if found is None or found.end() == at:
            raise ValueError("the units must cover every text")
        out += found.ends(1)
        at = found.end()
    return out


def hash_numbers(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(text: str, doc_id: str, seed: int, rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text; lengths are null where it stays plain."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = hash_numbers(seed, doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    begin, end = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if h4 % 100 < spm:
        return n, "spm", begin, end - begin, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", begin, end - begin, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    rate: texts of a hundred that change; spm: of those, how many of a hundred put the suffix first.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [docs.schema["doc_id"].dataType, T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(batches):
        for batch in batches:
            for first, texts in scan.chunks(batch.column(2)):
                ids = batch.column(1).slice(first, len(texts)).to_pylist()
                rows = [rearranged(t or "", i or "", seed, rate, spm, unit) for t, i in zip(texts.to_pylist(), ids, strict=True)]
                cells = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                cells[-1] = cells[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *cells], names)

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def restored(output: str = "output", form: str = "form"):
    """Column: the exact text, rebuilt from the two columns alone."""
    size = len(PREFIX)
    first, second = f"locate('<S>', {output}, {size + 1})", f"locate('<P>', {output}, {size + 1})"
    last = f"locate('<M>', {output}, {size + 1})"
    part = lambda a, b: f"substring({output}, {a}, {b} - ({a}))"
    middle = f"substring({output}, {last} + {size})"
    psm = f"concat({part(size + 1, first)}, {middle}, {part(f'{first} + {size}', last)})"
    spm = f"concat({part(f'{second} + {size}', last)}, {middle}, {part(size + 1, second)})"
    return F.expr(f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END")
