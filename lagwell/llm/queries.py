"""Registered queries of the training-data operators and, where SQL can say it, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.llm import cells, chat, decontaminate, infill, interpolate, jaccard, kneser, mincut, mixing, secrets, spelling, tokens, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_chat_format(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.from_table(table(spark, d, "conversations"))
    probe = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    extra = chat.from_json_records(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(probe).alias("record")), "record")
    df = chat.read_back(chat.render(rows.unionByName(extra.select("conv_id", "turns"))))
    loss = "array_join(loss_texts, '')"
    return df.select(
        "conv_id", F.expr("cast(size(turns_read) as bigint)").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns_read, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.expr(f"cast(char_length({loss}) as bigint)").alias("loss_chars"), F.expr(f"sha2({loss}, 256)").alias("loss_sha256"),
        F.expr("cast(char_length(formatted) as bigint)").alias("formatted_chars"),
    )


def _added(c: str) -> str:
    counts = [f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in (*chat.CONTROL, chat.ESCAPE)]
    return f"length({c}) + " + " + ".join(counts)


ORACLES["op1_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(20 + {_added('role')} + {_added('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query
def op2_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark")).drop("text_hash")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op2_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS g
  FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(p) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n.n, p, array_to_string(list_slice(w, p, p + n.n - 1), ' ') AS g
  FROM d, n, unnest(range(1, greatest(1, CAST(len(w) - n.n + 2 AS BIGINT)))) AS u(p)),
h AS (SELECT DISTINCT doc_id, item_id, dw.n, p FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
s AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(p, p + n)) AS u(x) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""


@query
def op8_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, d, "documents"))


ORACLES["op8_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') AS g
  FROM d, unnest(range(1, greatest(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT)))) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v AND r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id"""


@query
def op5_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return cells.near_duplicates(table(spark, d, "embeddings"))


ORACLES["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS m FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.95),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v AND r.c < l.y)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, m.c AS component_id, m.c = v.vec_id AS kept
FROM v JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = v.vec_id"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op6_token_binary(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_table(table(spark, d, "documents"), tokenizer_path())


@query
def op7_lm_interpolation(spark: SparkSession, d: str) -> DataFrame:
    return interpolate.score(table(spark, d, "documents"))


@query
def op4_html_mincut(spark: SparkSession, d: str) -> DataFrame:
    return mincut.extract(table(spark, d, "pages"))


@query
def op9_warc_derivatives(spark: SparkSession, d: str) -> DataFrame:
    """All pages as responses, their derivatives written as gzip members and read back."""
    made = warc.parsed(warc.archived(table(spark, d, "pages")))
    value = lambda name: F.expr(f"filter(headers, h -> h.name = '{name}')[0].value")
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", value("WARC-Date").alias("warc_date"), value("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        value("WARC-Source-Content-Type").alias("source_content_type"), value("WARC-Block-Digest").alias("block_digest"), value("Content-Type").alias("content_type"),
        value("Content-Length").cast("long").alias("content_length"), F.decode("block", "utf-8").alias("content"),
    )


@query
def op3_toxicity_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    df = kneser.scored(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return df.select("doc_id", kneser.held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= kneser.CUT).cast("int").alias("predicted"))


@query
def op10_mix_to_targets(spark: SparkSession, d: str) -> DataFrame:
    df = mixing.mixed(table(spark, d, "documents"))
    return df.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_factor", "mix_p", "mix_draw", "mix_kept")


@query
def op11_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    df = secrets.found(table(spark, d, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    base = secrets.listed("spans", ("assign", "access", "hex"))
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def _found(kind: str, at: int, pattern: str, test: str) -> str:
    """Finds of one kind by the lengths of what lies between them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {at} AS place, x, start, start + length(x) AS stop FROM (
  SELECT doc_id, hits[i] AS x, CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS BIGINT) AS start
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')),
    unnest(range(1, len(hits) + 1)) AS u(i)) WHERE {test}"""


_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CRC_BITS = "list_transform(range(240), lambda k: CAST((ord(substr(x, CAST(5 + k // 8 AS BIGINT), 1)) >> (k % 8)) & 1 AS BIGINT))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CRC_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CRC_HOLDS = f"length(x) = 40 AND substr(x, 35) = list_aggregate(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda p: substr('{_BASE62}', CAST(({_CRC}) // p % 62 + 1 AS BIGINT), 1)), 'string_agg', '')"


def _bech32(text: str, human: str) -> str:
    data = f"list_transform(range(1, length({text}) - {len(human)}), lambda k: CAST(strpos('qpzry9x8gf2tvdw0s3jn54khce6mua7l', substr({text}, CAST({len(human) + 1} + k AS BIGINT), 1)) - 1 AS BIGINT))"
    head = [ord(c) >> 5 for c in human] + [0] + [ord(c) & 31 for c in human]
    step = "xor((c & 33554431) << 5, v)"
    for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
        step = f"xor({step}, {g} * ((c >> {25 + i}) & 1))"
    values = f"list_concat([{', '.join(f'CAST({v} AS BIGINT)' for v in [1, *head])}], {data})"
    return f"NOT list_contains({data}, -1) AND list_reduce({values}, lambda c, v: {step}) = 1"


ORACLES["op11_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_found('assign', 0, _ASSIGN, "length(regexp_extract(x, '" + _ASSIGN + "', 2)) >= 6")}
UNION ALL {_found('access', 1, 'AKIA[A-Z0-9]+', 'length(x) >= 20')}
UNION ALL {_found('hex', 2, '[0-9a-f]+', 'length(x) >= 24')}
UNION ALL {_found('github', 3, 'gh[pousr]_[A-Za-z0-9]+', _CRC_HOLDS)}
UNION ALL {_found('npm', 4, 'npm_[A-Za-z0-9]+', _CRC_HOLDS)}
UNION ALL {_found('age', 5, 'AGE-SECRET-KEY-1[A-Z0-9]+', 'length(x) = 74 AND ' + _bech32('lower(x)', 'age-secret-key-'))}
UNION ALL {_found('nsec', 6, 'nsec1[a-z0-9]+', 'length(x) = 63 AND ' + _bech32('x', 'nsec'))}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS every FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


@query
def op12_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    df = infill.transformed(table(spark, d, "documents"))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
  CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS o FROM d),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""


@query
def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS steps
  FROM range(256) AS r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
k AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) AS h FROM k, crc),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM c, unnest(range(1, length(word) + 1)) AS u(i)),
p AS (SELECT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT e.word, c.word, c.n FROM e JOIN c ON e.cut = c.word UNION SELECT c.word, e.word, e.n FROM e JOIN c ON e.cut = c.word),
b AS (SELECT word, count(*) AS k, max(n) AS m FROM p GROUP BY word),
f AS (SELECT p.word, min(p.near) AS near, any_value(p.n) AS m FROM p JOIN b ON p.word = b.word AND p.n = b.m GROUP BY p.word),
s AS (SELECT c.word, c.n, coalesce(b.k, 0) AS n_near, CASE WHEN f.m >= 2 * c.n THEN f.near END AS form, CASE WHEN f.m >= 2 * c.n THEN f.m END AS form_n
  FROM c LEFT JOIN b ON b.word = c.word LEFT JOIN f ON f.word = c.word),
g AS (SELECT word, word AS top, 0 AS step FROM s UNION ALL SELECT g.word, s.form, step + 1 FROM g JOIN s ON s.word = g.top WHERE s.form IS NOT NULL),
z AS (SELECT word, arg_max(top, step) AS root FROM g GROUP BY word)
SELECT s.word, form, root, n, n_near, form_n FROM s JOIN z ON z.word = s.word"""
