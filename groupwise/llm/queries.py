"""Registered queries of this subpackage: each applies one operator with production parameters to its whole table.

``SQL`` holds DuckDB statements with the same rows where SQL can express the operator; the others are tested by brute force, exact
round trips or held-out accuracy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, langid, line_dedup, merkle, mixing, ngram_join, packing, pivots, ranked_search, secret_scan, toxicity
from .common import crc_bucket, map_rows, text_of

TOXIC_FOLDS, TOXIC_HELD_OUT = 5, 0
LANG_FOLDS, LANG_HELD_OUT = 3, 1
QUERY_STEP = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def toxicity_model(spark: SparkSession, sf: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf, "labels").where(crc_bucket("doc_id", TOXIC_FOLDS) != TOXIC_HELD_OUT)
    return toxicity.train(docs, labels)


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = toxicity.score(docs, toxicity_model(spark, sf, docs))
    held = (crc_bucket("doc_id", TOXIC_FOLDS) == TOXIC_HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "score", "predicted", F.size("spans").alias("n_spans"))


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, f'{{"conversations": [{{"from": "human", "value": {_json(said)}}}, {{"from": "gpt", "value": {_json(said)}}}]}}')],
        "conv_id bigint, record string",
    )
    records = chat.records_of(table(spark, sf, "conversations"), mixed=True).unionByName(extra)
    return chat.digests(chat.format_records(records))


def _json(text: str) -> str:
    import json

    return json.dumps(text)


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_ann(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Only the token capacity binds: as many documents and as much attention as a full sequence can have are allowed."""
    packed = packing.pack_documents(table(spark, sf, "documents"), tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    clean = line_dedup.dedup_lines(docs)
    lines = F.size(F.split(text_of("text"), "\n", -1)).cast("bigint")
    gone = F.aggregate("deleted_runs", F.lit(0), lambda n, r: n + r["hi"] - r["lo"] + 1).cast("bigint")
    runs = F.array_join(F.transform("deleted_runs", lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), ",")
    return clean.select(
        "doc_id", gone.alias("n_deleted"), runs.alias("deleted"), F.sha2(text_of("text"), 256).alias("clean_sha256"), lines.alias("n_left")
    )


def op9_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fold = crc_bucket("doc_id", LANG_FOLDS)
    model = langid.train(docs, docs.where(fold != LANG_HELD_OUT))
    return langid.predict(docs, model).select("doc_id", (fold == LANG_HELD_OUT).alias("held_out"), "lang_pred", "score")


def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, base, spans in rows:
            said = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in part) for part in (base, spans)]
            n = [sum(s["kind"] == k for s in base) for k in secret_scan.KINDS]
            yield doc, *n, hashlib.sha256(said[0].encode()).hexdigest(), said[1]

    found = secret_scan.find_secrets(table(spark, sf, "documents"))
    return map_rows(found, digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op11_pivot_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf, "embeddings"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document (by its checksum) comes back without its line ends; the others as they were."""
    without = F.translate(F.col("text").cast("string"), "\n", "")
    tampered = F.when(crc_bucket("doc_id", 2) == 0, without).otherwise(F.col("text").cast("string"))
    again = merkle.leaf_hash([tampered if c == "text" else F.col(c) for c in merkle.FIELDS])
    proved = merkle.prove_all(table(spark, sf, "documents"), again=again)
    folded = merkle.fold(F.col("again"), F.col("proof"))
    digests = proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_chat_format,
        op3_ngram_join,
        op4_ann,
        op5_exact_dedup,
        op6_packing,
        op7_mixing,
        op8_line_dedup,
        op9_langid,
        op10_secret_scan,
        op11_pivot_dedup,
        op12_merkle,
        op13_ranked_search,
        pipeline,
    )
}

WORDS = r"[^\x20\x09-\x0D]+"

_OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS body,
    length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) AS head FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(body + head + 14)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

_OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r AS (SELECT a AS node, a AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT node, min(reached) AS least FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id"""

_OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_OP7 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT AS h FROM documents),
s AS (
  SELECT source, source_size, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (SELECT *, 3 * source_size / w AS level FROM s),
l AS (
  SELECT x.level, ((SELECT sum(size) FROM d) - coalesce(sum(3 * y.source_size) FILTER (WHERE y.level < x.level), 0))::DOUBLE
    / sum(y.w) FILTER (WHERE y.level >= x.level) AS l FROM (SELECT DISTINCT level FROM r) x CROSS JOIN r y GROUP BY x.level),
t AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, (SELECT arg_min(l, level) FROM l WHERE l <= level * (1 + 1e-12)) * w) AS target FROM r),
q AS (
  SELECT d.*, t.source_size, t.target, coalesce('s' || d.source, 'n') AS s,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, sent + e * source_size AS upto FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS e)),
o AS (SELECT sum(size) - (SELECT coalesce(sum(size), 0) FROM e WHERE upto <= target) AS room FROM d),
c AS (
  SELECT *, sum(size) OVER (ORDER BY upto::DOUBLE / target, h, s, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM e WHERE target > 0 AND upto > target),
k AS (
  SELECT doc_id, h, s FROM e WHERE upto <= target UNION ALL SELECT doc_id, h, s FROM c WHERE used <= (SELECT room FROM o)),
n AS (SELECT doc_id, h, s, count(*) AS n FROM k GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.n, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM q.doc_id AND n.h = q.h AND n.s = q.s"""

_OP8 = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
units AS (
  SELECT doc_id, i, line, j, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS s
  FROM (SELECT *, unnest(range(1, ceil(len(regexp_extract_all(line, '{WORDS}')) / 25.0)::INT + 1)) AS j FROM lines)),
grams AS (
  SELECT a.doc_id, a.s, a.i AS lo, c.i AS hi, md5(a.line) || a.j || ':' || md5(b.line) || b.j || ':' || md5(c.line) || c.j AS g
  FROM units a JOIN units b ON b.doc_id = a.doc_id AND b.s = a.s + 1 JOIN units c ON c.doc_id = a.doc_id AND c.s = a.s + 2),
later AS (
  SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM grams) WHERE k > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later x ON x.doc_id = l.doc_id AND l.i BETWEEN x.lo AND x.hi),
runs AS (
  SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS deleted, sum(hi - lo + 1)::BIGINT AS n_deleted
  FROM (SELECT doc_id, min(i) AS lo, max(i) AS hi FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone)
        GROUP BY doc_id, island) GROUP BY doc_id),
stay AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS clean, count(*) AS n_left
  FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(r.n_deleted, 0)::BIGINT AS n_deleted, coalesce(r.deleted, '') AS deleted,
  sha256(coalesce(s.clean, '')) AS clean_sha256, coalesce(s.n_left, 1)::BIGINT AS n_left
FROM documents d LEFT JOIN runs r USING (doc_id) LEFT JOIN stay s USING (doc_id)"""

_OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT a AS node, a AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT node, min(reached) AS least FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.least, e.vec_id) AS component_id, coalesce(m.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.node = e.vec_id"""


def _merkle_sql(levels: int = 10) -> str:
    """Trees of at most ``3 ** levels`` leaves; every level folds runs of three where more than one node remains."""

    def tree(name: str, key: str) -> list[str]:
        part, run = (f"PARTITION BY {key}", f"PARTITION BY {key}, pos // 3")
        out = []
        for k in range(levels):
            out.append(
                f"{name}s{k} AS (SELECT {key}, pos, h, count(*) OVER ({part}) > 1 AS more,"
                f" coalesce(string_agg(h, '') OVER ({run} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') OVER ({run} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
            )
            out.append(
                f"{name}{k + 1} AS (SELECT {key}, pos // 3 AS pos, CASE WHEN bool_or(more) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h"
                f" FROM {name}s{k} GROUP BY {key}, pos // 3)"
            )
        return out

    def climb(first: str, tree_name: str, key: str, pos: str) -> list[str]:
        out, before = [], first
        for k in range(levels):
            step = "CASE WHEN s.more THEN sha256(s.l || c.{0} || s.r) ELSE c.{0} END AS {0}"
            out.append(
                f"{first}{tree_name}{k} AS (SELECT c.* REPLACE ({step.format('h')}, {step.format('t')}, c.proof || CASE WHEN s.more THEN s.l || s.r ELSE '' END AS proof)"
                f" FROM {before} c JOIN {tree_name}s{k} s ON s.{key} = c.{key} AND s.pos = c.{pos} // {3**k})"
            )
            before = f"{first}{tree_name}{k}"
        return out

    frame = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    last = levels - 1
    parts = [
        # the checksum's table by its rule; the last xor of the checksum turns its lowest bit, so that bit is 1 here where 2 divides it
        "tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],"
        " lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))",
        "crc AS (SELECT d.*, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
        " lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])) & 1 AS low FROM documents d CROSS JOIN tab)",
        f"leaf AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({frame} || coalesce(strlen(text) || ':' || text, '-')) AS h,"
        f" CASE WHEN low = 1 THEN replace(text, chr(10), '') ELSE text END AS again, {frame} AS frame FROM crc)",
        "placed AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, h AS leaf, h,"
        " sha256(frame || coalesce(strlen(again) || ':' || again, '-')) AS t, '' AS proof, 0 AS one FROM leaf)",
        "a0 AS (SELECT tree, pos, h FROM placed)",
        *tree("a", "tree"),
        f"b0 AS (SELECT 0 AS one, tree AS pos, h FROM a{levels})",
        *tree("b", "one"),
        *climb("placed", "a", "tree", "pos"),
        f"up AS (SELECT *, h AS subroot FROM placeda{last})",
        *climb("up", "b", "one", "tree"),
    ]
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT doc_id, leaf, subroot, (SELECT h FROM b%d) AS root, sha256(proof) AS proof_sha256, t AS folded_root, t = (SELECT h FROM b%d) AS verified FROM upb%d"
        % (levels, levels, last)
    )


_OP13 = r"""
WITH dt AS (
  SELECT doc_id, unnest(t) AS t, len(t) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE text IS NOT NULL)),
it AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2),
c AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS len FROM dt),
tf AS (SELECT doc_id, t, n, count(*) AS tf FROM dt GROUP BY 1, 2, 3),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf CROSS JOIN c GROUP BY t, docs),
s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))))::BIGINT AS score
  FROM it JOIN tf USING (t) JOIN w USING (t) CROSS JOIN c GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

SQL: dict[str, str] = {
    "op2_chat_format": _OP2,
    "op3_ngram_join": _OP3,
    "op5_exact_dedup": _OP5,
    "op7_mixing": _OP7,
    "op8_line_dedup": _OP8,
    "op11_pivot_dedup": _OP11,
    "op12_merkle": _merkle_sql(),
    "op13_ranked_search": _OP13,
}
