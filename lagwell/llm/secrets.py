"""Secrets in texts: keyword automaton, anchored patterns at its hits, checksums inside the finds.

1. Every kind of secret names keywords that each of its matches starts with. One Aho-Corasick automaton over the keywords of all
   kinds reads each text once.
2. The kind's pattern is tried only where a keyword begins, anchored there; a find uses up its text for its kind, whether it is accepted or not.
   As no keyword of a kind lies inside another, hits come in order, so the finds of a kind are the leftmost ones
   that do not overlap.
3. A kind may check its finds: by length, or by the checksum that the secret itself carries.

The keywords of hexadecimal runs are all runs of `HEX` digits: ordinary words hold few of them, and the first one of a run is
where the run begins. Keywords in either case stand in the automaton in every spelling, so offsets are those of the text itself.

Kinds: `assign`, `access` and `hex` are judged by length; those in `CHECKED` by an embedded CRC-32 in base 62 (github, npm) or a
Bech32 checksum (age, nsec), so that strings of the right look but wrong sum are left out. Kinds are looked for apart from each
other and may share text.

Defined cases: null and empty texts have no spans; texts are read whole; repeated rows are each reported; a null doc_id is kept;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwell.llm import scan

HEX = 4
# fixed values: digits of base 62 in the order the token issuers use, Bech32 digits and generator
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_in_base62(find: re.Match) -> bool:
    """Forty characters: a prefix of four, thirty, and the CRC-32 of those thirty in six digits of base 62."""
    token = find.group()
    if len(token) != 40:
        return False
    crc = zlib.crc32(token[4:34].encode())
    return token[34:] == "".join(BASE62[crc // 62**k % 62] for k in range(5, -1, -1))


def bech32_holds(token: str, mark: int) -> bool:
    """Whether the Bech32 checksum of a token holds, whose separator 1 stands at offset mark."""
    values = [BECH32.find(c) for c in token[mark + 1 :]]
    if -1 in values:
        return False
    human = token[:mark].encode()
    sum_ = 1
    for v in [*(c >> 5 for c in human), 0, *(c & 31 for c in human), *values]:
        top = sum_ >> 25
        sum_ = (sum_ & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            sum_ ^= g if top >> i & 1 else 0
    return sum_ == 1


def any_case(*words: str) -> tuple[str, ...]:
    """Every spelling of the words in small and capital ASCII letters."""
    return tuple("".join(x) for w in words for x in product(*(sorted({c, c.upper()}) for c in w)))


def either(word: str) -> str:
    """Pattern of a word whose ASCII letters may be of either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    """Finds of `pattern`, each of which starts with one of `keywords`, that `accept` takes."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    accept: Callable[[re.Match], bool]

    def __post_init__(self):
        few = sorted({len(k) for k in self.keywords})
        known = set(self.keywords)
        if any(k[i : i + n] in known for k in known for n in few if n < len(k) for i in range(len(k) - n + 1)):
            raise ValueError(f"{self.name}: a keyword lies inside another")


NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = "(" + "|".join(map(either, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Kind("assign", any_case(*NAMES), ASSIGN, lambda m: len(m.group(2)) >= 6),
    Kind("access", ("AKIA",), "AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    Kind("hex", tuple(f"{i:0{HEX}x}" for i in range(16**HEX)), "[0-9a-f]+", lambda m: len(m.group()) >= 24),
)
CHECKED = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[A-Za-z0-9]+", crc_in_base62),
    Kind("npm", ("npm_",), "npm_[A-Za-z0-9]+", crc_in_base62),
    Kind("age", ("AGE-SECRET-KEY-1",), "AGE-SECRET-KEY-1[A-Z0-9]+", lambda m: len(m.group()) == 74 and bech32_holds(m.group().lower(), 15)),
    Kind("nsec", ("nsec1",), "nsec1[a-z0-9]+", lambda m: len(m.group()) == 63 and bech32_holds(m.group(), 4)),
)
KINDS = BASE + CHECKED


class Scanner:
    """Aho-Corasick automaton of the keywords of all kinds, and their patterns; it is built once per task."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        import ahocorasick

        self.kinds, self.patterns = kinds, [re.compile(k.pattern) for k in kinds]
        self.hits = ahocorasick.Automaton()
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                self.hits.add_word(word, (*self.hits.get(word, ()), (i, len(word))))
        self.hits.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, place of the kind, end) of the accepted finds, by begin and then by kind."""
        done, out = [0] * len(self.kinds), []
        for last, owners in self.hits.iter(text):
            for i, size in owners:
                begin = last - size + 1
                if begin >= done[i] and (m := self.patterns[i].match(text, begin)):
                    done[i] = m.end()
                    if self.kinds[i].accept(m):
                        out.append((begin, i, m.end()))
        return sorted(out)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("secret", T.StringType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))


def found(docs: DataFrame, kinds: tuple[Kind, ...] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and spans, an array of (kind, begin, end in code points, secret) by begin, then kind."""

    def run(batches):
        use = KINDS if kinds is None else kinds  # the default is imported by the worker, not sent to it
        spans = Scanner(use)
        for batch in batches:
            for first, texts in scan.chunks(batch.column(1)):
                rows = [[(use[i].name, b, e, t[b:e]) for b, i, e in spans(t)] if t else [] for t in texts.to_pylist()]
                rows = [[dict(zip(("kind", "begin", "end", "secret"), x, strict=True)) for x in r] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(rows, _SPAN)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("spans", SPAN)]))


def listed(spans_: str = "spans", kinds: tuple[str, ...] | None = None):
    """Column: kind:begin:end of the spans, of the named kinds alone where given, joined by commas."""
    kept = spans_ if kinds is None else f"filter({spans_}, x -> x.kind IN ({', '.join(repr(k) for k in kinds)}))"
    return F.expr(f"array_join(transform({kept}, x -> concat_ws(':', x.kind, x.begin, x.end)), ',')")
