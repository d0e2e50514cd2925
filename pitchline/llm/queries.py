"""The operators' queries: production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm import (bm25_search, chat_collapse, context_tree, exact_dedup, mixing, ngram_join, periodic_runs, perplexity, piece_lattice,
                           shards, token_files, toxicity, vector_codes)
from pitchline.llm.common import crc_bucket, joined_totals, staged, table
from pitchline.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.judged(docs, drop=("text",))


@query
def op4_class_conditional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = crc_bucket("doc_id", toxicity.Fit().folds) == 0
    return toxicity.scored(docs, model, drop=("text",)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op1_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digests(spark, path)


@query
def op5_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"))


@query
def op8_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query
def op9_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.rendered(table(spark, sf_dir, "conversations"))


@query
def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards.write(docs, path)
    return shards.read(spark, path, docs).select(
        "doc_id", shards.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES["op9_snapshot_collapse"] = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
    FROM conversations),
lists AS (
    SELECT conv_id, count(*) AS n_turns, list(role || chr(31) || text ORDER BY place) AS said,
        list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) ORDER BY place) AS shown
    FROM turns GROUP BY conv_id),
kept AS (
    SELECT * FROM lists a
    WHERE NOT EXISTS (SELECT 1 FROM lists b WHERE b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)
      AND NOT EXISTS (SELECT 1 FROM lists b WHERE b.conv_id < a.conv_id AND b.said = a.said)),
parts AS (SELECT *, unnest(range(0, (n_turns - 1) // 256 + 1)) AS part FROM kept)
SELECT conv_id, n_turns, CAST(part AS INTEGER) AS part,
    array_to_string(shown[CAST(part * 256 + 1 AS BIGINT):CAST(part * 256 + 256 AS BIGINT)], '') AS text
FROM parts"""


@query
def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_lattice.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), drop=("text",))


@query
def op7_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).drop("text_key")


ORACLES["op7_minhash_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
grams AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS class_id,
    coalesce((SELECT count(*) FROM pairs p WHERE p.x = d.doc_id), 0) AS n_links
FROM documents d"""


@query
def op6_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_search.search_all(docs, docs.filter(F.col("doc_id") % 100 == 0))


ORACLES["op6_block_max_wand"] = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
facts AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
flat AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM words),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM flat GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (
    SELECT q.doc_id AS query_id, t.doc_id,
        round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * q.tf * 2.2 * t.tf / (t.tf + 1.2 * (0.25 + 0.75 * t.size / mean))), 6) AS score
    FROM tf q JOIN df USING (term) JOIN tf t USING (term), facts
    WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, t.doc_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""


@query
def op11_two_pass_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.marked(docs, drop=("text",))


ORACLES["op11_two_pass_bloom"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def planted_words(doc_id, text: bytes) -> list[bytes]:
    """The words of the contract: in one text of ten, those from one place on become periodic."""
    words = text.split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = periodic_runs.found(docs, drop=("text",), words_of=planted_words)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-best.less * 1000 div best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


ORACLES["op12_suffix_tree_runs"] = r"""
WITH given AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
        xor(list_reduce(list_prepend(4294967295, flatten(list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
            lambda d: d <> ''), lambda d: [CAST(ord(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h
    FROM documents),
placed AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
texts AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
        ELSE w END AS w FROM placed),
keyed AS (SELECT row_number() OVER () AS k, * FROM texts),
grams AS (
    SELECT k, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(0, n - 5), lambda i: array_to_string(w[i + 1:i + 6], ' '))) AS gram
    FROM keyed WHERE n >= 12),
pairs AS (SELECT x.k, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.k = y.k AND x.gram = y.gram AND y.i > x.i),
islands AS (
    SELECT k, q, min(i) AS start, count(*) + 5 + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM pairs) GROUP BY k, q, island),
runs AS (
    SELECT k, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY k, start, length),
packed AS (
    SELECT k, count(*) AS n_runs, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY k),
gone AS (SELECT k, list(DISTINCT i) AS gone FROM (SELECT k, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
    best.l * 1000 // best.p AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
        ELSE array_to_string(list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]), ' ') END) AS collapsed_sha256
FROM keyed LEFT JOIN packed USING (k) LEFT JOIN gone USING (k)"""


@query
def op13_hilbert_block_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), drop=("embedding",))
    books = hashlib.sha256(",".join(map(str, codes.books.ravel().tolist())).encode()).hexdigest()
    rows = staged(codes.rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "vector-codes")
    labels = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    return joined_totals(rows, staged(labels, "vector-labels"), "key", "size", rows.count()).select(
        "vec_id", "code", "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def _codes_sql(rounds: int) -> str:
    """Rounds of assignment and floored means as one table each."""
    assigned = """
a{r} AS MATERIALIZED (
    SELECT k, part, min({{'d': d, 'e': entry}}) AS best
    FROM (SELECT k, part, entry, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM v JOIN c{r} USING (part, pos) GROUP BY k, part, entry)
    GROUP BY k, part)"""
    refined = """
m{r} AS (SELECT part, best.e AS entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (k, part) GROUP BY ALL),
c{s} AS MATERIALIZED (
    SELECT part, entry, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y
    FROM c{r} LEFT JOIN m{r} USING (part, entry, pos))"""
    steps = []
    for r in range(rounds):
        steps += [assigned.format(r=r), refined.format(r=r, s=r + 1)]
    return """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, * FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
    SELECT k, i // (len(embedding) // 8) AS part, i % (len(embedding) // 8) AS pos, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 4096) AS BIGINT) AS x
    FROM (SELECT k, embedding, unnest(range(0, len(embedding))) AS i FROM kept)),
c0 AS (SELECT part, k - 1 AS entry, pos, x AS y FROM v WHERE k <= 16),""" + ",".join(steps) + "," + assigned.format(r=rounds) + f""",
codes AS (
    SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY k),
books AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (k), books"""


ORACLES["op13_hilbert_block_codes"] = _codes_sql(vector_codes.Plan().rounds)
