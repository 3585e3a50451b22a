"""The corpus queries over the given tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.kdtree import top_inner_products
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.onebit import nearest_cosine
from gridloom.llm.packing import pack, token_pieces
from gridloom.llm.suffix_dedup import repeated_bytes
from gridloom.llm import bpe_lexicon, collocations, conversations, piece_fst, ppm, quality, toxicity
from gridloom.session import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file stands."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


LINE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT doc_id, i, line, k IN (SELECT k FROM bad) AS drop FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", LINE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(token_pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")), "pieces")
    return pack(pieces)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    out = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
       doc_id <= coalesce(least, doc_id) AS kept
FROM sets LEFT JOIN found USING (doc_id)
"""


@query("op7_minhash_near_dedup", NEAR_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


REPEAT_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS new FROM again),
islands AS (SELECT doc_id, i, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM islands GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept, max(b) AS last
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op1_suffix_array_dedup", REPEAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir))


USABLE_SQL = """
usable AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""

TOP_SQL = f"""
WITH {USABLE_SQL}, whole AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x)) AS v FROM usable),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
           FROM whole q JOIN whole r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query("op4_exact_top_k", TOP_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_inner_products(rows, rows.where("vec_id % 50 = 0"))


@query("op6_one_bit_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_cosine(rows, rows.where("vec_id % 50 = 0"))


@query("op10_sentencepiece_fst")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics_table(documents(spark, sf_dir))
    held_out = toxicity.remainder(F.col("doc_id"), 4) == 2
    model = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    out = quality.score(stats, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_ppm_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.remainder(F.col("doc_id"), 10) == 0
    out = ppm.score(documents(spark, sf_dir), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository top; it imports this module's settings

    return corpus_pipeline.run(spark, sf_dir)


TURN_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS k FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
            FROM drawn WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM damaged),
rows AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS r,
                lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
faults AS (SELECT *, blank OR again AS must, CASE WHEN cut THEN 5 ELSE 0 END AS p FROM rows),
sizes AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
                 count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated,
                 count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
-- costs to go before row i + 1 from the states: nothing yet, system, user, assistant
togo AS (
  SELECT conv_id, n AS i, [0, 10, 5, 0] AS v FROM sizes
  UNION ALL
  SELECT conv_id, i, [least(w[1], 5 + w[3], 10 + w[4]), least(w[2], 5 + w[3], 10 + w[4]), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])] FROM (
    SELECT f.conv_id, f.i - 1 AS i, CASE WHEN must THEN list_transform(v, lambda x: x + 2) ELSE [
      least(2 + v[1], 1 + p + v[3], CASE r WHEN 's' THEN p + v[2] WHEN 'u' THEN p + v[3] ELSE 999999 END), least(2 + v[2], 1 + p + v[3], CASE r WHEN 'u' THEN p + v[3] ELSE 999999 END),
      least(2 + v[3], 1 + p + v[4], CASE r WHEN 'a' THEN p + v[4] ELSE 999999 END), least(2 + v[4], 1 + p + v[3], CASE r WHEN 'u' THEN p + v[3] ELSE 999999 END)] END AS w
    FROM togo t JOIN faults f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i)),
steps AS MATERIALIZED (SELECT a.conv_id, a.i, a.v AS now, b.v AS next, f.must, f.p, f.r, f.role, f.text FROM togo a
  LEFT JOIN togo b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i + 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM sizes
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND r = 's' THEN 2 ELSE to_q END, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, given || ':') WHEN 'R' THEN list_append(lines, given || ':' || text) ELSE list_append(lines, role || ':' || text) END
  FROM (SELECT w.*, s.r, s.role, s.text, CASE w.q WHEN 3 THEN 4 ELSE 3 END AS to_q, CASE w.q WHEN 3 THEN 'assistant' ELSE 'user' END AS given,
          CASE WHEN s.next IS NOT NULL AND 2 + s.next[w.q] = s.now[w.q] THEN 'D' WHEN 5 + s.now[CASE w.q WHEN 3 THEN 4 ELSE 3 END] = s.now[w.q] THEN 'I'
               WHEN s.next IS NULL THEN NULL
               WHEN (s.r = 's' AND w.q = 1 AND s.p + s.next[2] = s.now[w.q]) OR (s.r = 'u' AND w.q <> 3 AND s.p + s.next[3] = s.now[w.q])
                 OR (s.r = 'a' AND w.q = 3 AND s.p + s.next[4] = s.now[w.q]) THEN 'K' ELSE 'R' END AS edit
        FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i)
  WHERE edit IS NOT NULL),
ended AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id),
found AS (SELECT s.*, t.v[1] AS cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256 FROM sizes s
  JOIN togo t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = 0 JOIN ended e ON e.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_conversation_repair", TURN_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.digest(rows)


PHRASE_SQL = r"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, w FROM (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents)),
one AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
two AS (SELECT lang, x, y, x || ' ' || y AS p, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces)) GROUP BY ALL),
three AS (SELECT lang, x, y, z, x || ' ' || y || ' ' || z AS p, count(*) AS f
          FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM pieces)) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.p AS phrase, t.f AS a, l.f AS l, r.f AS r, 1 AS k FROM two t JOIN one l ON l.lang = t.lang AND l.p = t.x JOIN one r ON r.lang = t.lang AND r.p = t.y WHERE t.f >= 10
    AND NOT EXISTS (SELECT 1 FROM three h WHERE h.lang = t.lang AND ((h.x = t.x AND h.y = t.y) OR (h.y = t.x AND h.z = t.y)) AND 100 * h.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, t.p, t.f, l.f, r.f, 1 FROM three t JOIN one l ON l.lang = t.lang AND l.p = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.p, t.f, l.f, r.f, 2 FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.p = t.z),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


@query("op13_bpe_transducer")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = bpe_lexicon.build(docs, tokenizer_path("byte_bpe_50k.json"))
    coded = bpe_lexicon.decode(bpe_lexicon.encode(docs, lexicon), lexicon)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
