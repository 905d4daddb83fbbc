"""Registered queries of the corpus operators and the SQL texts they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import decontaminate, embedding_dups, html_text, merkle, piece_sampling, quality, secret_scan, simhash, substring_dups, token_counts, toxicity, warc, whitening
from touchline.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc", """
WITH given AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
hashed AS (SELECT page_id, t, octet_length(encode(t)) AS n, sha1(t) AS h FROM given),
firsts AS (SELECT t, min(page_id) AS first_id FROM given GROUP BY t)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (t)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    read = warc.read_archives(spark, folder).filter(F.col("record_type").isin("response", "revisit"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_embedding_near_dups", """
WITH RECURSIVE given AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
good AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM given
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
unit AS (SELECT vec_id, v, n FROM good WHERE n > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a), roots AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: Public vocabulary of the token counts and its end-of-document number.
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), RANKS_FILE, END_OF_DOCUMENT).select("doc_id", "n_tokens", "ordinal", "start")


_WORD = r"[^\x20\x09-\x0D]+"


@query("op6_substring_dedup", rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM places),
firsts AS (SELECT t, min(doc_id) AS first_id FROM windows GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (t) WHERE first_id < doc_id),
marks AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(coalesce(gone, []), x)), lambda x: w[x]) AS k FROM words LEFT JOIN marks USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dups.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op7_simhash_near_dups")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Public model of the sampled segmentations.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query("op8_piece_sampling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_sampling.sample(table(spark, sf_dir, "documents"), MODEL_FILE, decoded=True)
    return found.select("doc_id", "rank", F.size("pieces").cast("long").alias("n_pieces"), "log_prob", "perturbed", "inclusion", F.xxhash64("pieces").alias("pieces_hash"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=~toxicity.held_out())
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"), F.to_json("passages").alias("passages"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op11_html_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _sql_field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = " || ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars")))


@query("op13_merkle_manifest", f"""
WITH RECURSIVE hashed AS (SELECT doc_id, source, sha256({_PLAIN} || {_sql_field('text')}) AS leaf, sha256({_PLAIN} || {_sql_field(_LOWERED)}) AS lowered,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM documents),
rows_ AS (SELECT *, coalesce(crc % 5 = 0, false) AS hit, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS size FROM hashed),
level AS (SELECT 0 AS lvl, tree, place, size, leaf AS digest FROM rows_
  UNION ALL SELECT lvl + 1, tree, place // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM level WHERE size > 1 GROUP BY lvl, tree, place // 16, size),
tops AS (SELECT tree, digest, count(*) OVER () AS n FROM level WHERE size = 1),
up AS (SELECT 0 AS lvl, tree AS place, n AS size, digest FROM tops
  UNION ALL SELECT lvl + 1, place // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE size > 1 GROUP BY lvl, place // 16, size),
root AS (SELECT digest AS root FROM up WHERE size = 1),
inner_sides AS (SELECT lvl, tree, place, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM level WHERE size > 1 WINDOW run AS (PARTITION BY lvl, tree, place // 16 ORDER BY place)),
outer_sides AS (SELECT lvl, place, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM up WHERE size > 1 WINDOW run AS (PARTITION BY lvl, place // 16 ORDER BY place)),
path AS (SELECT k.tree, k.place, s.lvl, s.l, s.r FROM rows_ k JOIN inner_sides s ON s.tree = k.tree AND s.place = k.place // (16 ** s.lvl)::BIGINT
  UNION ALL SELECT k.tree, k.place, 100 + s.lvl, s.l, s.r FROM rows_ k JOIN outer_sides s ON s.place = k.tree // (16 ** s.lvl)::BIGINT),
steps AS (SELECT *, row_number() OVER (PARTITION BY tree, place ORDER BY lvl) AS step FROM path),
proofs AS (SELECT tree, place, string_agg(l || r, '' ORDER BY lvl) AS proof, max(step) AS n_steps FROM steps GROUP BY tree, place),
fold AS (SELECT tree, place, 0::BIGINT AS step, CASE WHEN hit THEN lowered ELSE leaf END AS digest FROM rows_
  UNION ALL SELECT f.tree, f.place, s.step, sha256(s.l || f.digest || s.r) FROM fold f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.step = f.step + 1)
SELECT k.doc_id, k.leaf, t.digest AS subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root.root AS verified
FROM rows_ k JOIN tops t ON t.tree = k.tree CROSS JOIN root LEFT JOIN proofs p ON p.tree = k.tree AND p.place = k.place
JOIN fold f ON f.tree = k.tree AND f.place = k.place AND f.step = coalesce(p.n_steps, 0)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))
