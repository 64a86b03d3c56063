"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, langid, linededup, manifest, media, merkle, mixing, ngram_join, packing, pii, quality, tokencount, tokenfile
from .common import count_words, fold_remainder, lower_ascii, materialise, read, scratch_dir


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; each document is a member of its own source only."""
    docs = read(spark, sf_dir, "documents").select("doc_id", count_words(F.col("text")).alias("size"), F.array("source").alias("sources"))
    rows, quotas = mixing.mix_sources(docs)
    return rows.join(quotas, rows["pattern"] == quotas["source_key"]).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. Null ids count as held out; null and empty texts are scored as
    empty; repeated rows score alike."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    out = quality.classify(docs, labels, metadata=["n_chars"], threshold=0.3)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; a row for each, repeated ones and null ids included."""
    out = pii.find_personal_data(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; null and empty texts are one end id, repeated rows packed each."""
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without frequent lines; a row for each, repeated ones and null ids included."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, rn, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rn) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id, rn
"""


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back; null ids come first, ties by text."""
    path = scratch_dir(spark, "token-files") + "/orc"
    tokenfile.write_token_files(tokenfile.encode_sorted(read(spark, sf_dir, "documents")), path)
    return tokenfile.describe_files(tokenfile.read_token_files(spark, path))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edits; null ids come first, ties by text."""
    out = merkle.fingerprint_with_next(read(spark, sf_dir, "documents"), tail=4, with_texts=False)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changed")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; null ids have a null component."""
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), n=5, percent=75)


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.reached = links.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; null ids count as held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 4) == 2, F.lit(True))
    out = langid.identify(docs, docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page of its lines and a figure that refers to its payload by digest.
    The pages are parsed to ordered items, digest joins bring what the stored payloads hold, and the
    figure's place in the aligned sequence gives the row. Rows with a null id keep theirs."""
    path = scratch_dir(spark, "media") + "/store"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    media.encode_payloads(docs).select("digest", "media").filter("media IS NOT NULL").write.option("compression", "zstd").parquet(path)
    payloads = materialise(media.read_payloads(spark.read.schema("digest string, media binary").parquet(path)), "payloads")
    digest, caption = media.payload_digest(F.col("text")), F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("n_bytes"), digest.alias("digest"))
    pages = media.sequences(docs.select(key.alias("page"), media.document_page(F.col("text"), digest, caption).alias("html"))).drop("html")
    light = materialise(pages.withColumn("sequence", media.without_texts(F.col("sequence"))), "sequences")
    aligned = media.align(light, media.resolve(light, payloads, "page"), "page")
    at = F.array_position(F.transform("sequence", lambda x: x["kind"]), F.lit("image")).cast("int")
    rows = aligned.withColumn("at", at).withColumns({"m": F.get("media", F.col("at") - 1), "item": F.get("sequence", F.col("at") - 1)})
    return rows.select("page.doc_id", "page.n_bytes", "m.payload_bytes", "m.payload_sha256", "m.tail_crc32", "m.media_bytes", "m.media_sha256", "m.feature",
                       F.col("item.pos").alias("position"), F.col("item.caption").alias("caption"), F.size("sequence").alias("n_items"), F.aggregate("sequence", F.lit(0).cast("long"), lambda a, x: a + x["n_chars"]).alias("sequence_chars"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against each other source of its language, and its terms against the language's."""
    return divergence.audit_sources(read(spark, sf_dir, "documents"), min_docs=3, top=200)


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rn, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rn) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p
      FROM size g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (x.n + 1)) // (y.n + v.v) AS p
          FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM size GROUP BY lang) y USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (((p.p - w.p) * (p.p - w.p)) // w.p)::BIGINT
  FROM p JOIN whole w ON w.lang = p.lang AND w.term = p.term WHERE p.n > 0 AND p.p > w.p)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; a row for each, null texts, repeated rows and null ids included."""
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), limit=1024)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and check of all documents; where 5 divides the crc32 of the id, the text is
    tampered with. A null id is never tampered with and comes first in its source."""
    docs = read(spark, sf_dir, "documents")
    touched = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    tampered = F.when(touched, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return manifest.verify(manifest.build(docs, tampered=tampered))


OP13_SQL = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS id, *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
         lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
d AS (
  SELECT id, doc_id, coalesce('+' || source, '!') AS s,
         sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                       coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                       coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 5 = 0
                       THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-'))) AS other
  FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
tree(s, level, i, digest, n) AS (
  SELECT s, 0, i, leaf, count(*) OVER (PARTITION BY s) FROM leaves
  UNION ALL
  SELECT s, level + 1, j, digest, count(*) OVER (PARTITION BY s) FROM (
    SELECT s, level, i // 16 AS j, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM tree WHERE n > 1 GROUP BY s, level, i // 16)),
subroots AS (SELECT s, digest, row_number() OVER (ORDER BY encode(s)) - 1 AS i FROM tree WHERE n = 1),
over(level, i, digest, n) AS (
  SELECT 0, i, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, j, digest, count(*) OVER () FROM (
    SELECT level, i // 16 AS j, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM over WHERE n > 1 GROUP BY level, i // 16)),
fold(id, s, level, i, digest, proof) AS (
  SELECT id, s, 0, i, other, '' FROM leaves
  UNION ALL
  SELECT f.id, f.s, f.level + 1, f.i // 16, sha256(string_agg(CASE WHEN m.i = f.i THEN f.digest ELSE m.digest END, '' ORDER BY m.i)),
         f.proof || coalesce(string_agg(m.digest, '' ORDER BY m.i) FILTER (WHERE m.i <> f.i), '')
  FROM fold f JOIN tree m ON m.s = f.s AND m.level = f.level AND m.i // 16 = f.i // 16 WHERE m.n > 1 GROUP BY f.id, f.s, f.level, f.i, f.digest, f.proof),
sourced AS (SELECT f.* FROM fold f JOIN tree t ON t.s = f.s AND t.level = f.level AND t.n = 1),
higher(id, level, i, digest, proof) AS (
  SELECT id, 0, sub.i, f.digest, f.proof FROM sourced f JOIN subroots sub ON sub.s = f.s
  UNION ALL
  SELECT f.id, f.level + 1, f.i // 16, sha256(string_agg(CASE WHEN m.i = f.i THEN f.digest ELSE m.digest END, '' ORDER BY m.i)),
         f.proof || coalesce(string_agg(m.digest, '' ORDER BY m.i) FILTER (WHERE m.i <> f.i), '')
  FROM higher f JOIN over m ON m.level = f.level AND m.i // 16 = f.i // 16 WHERE m.n > 1 GROUP BY f.id, f.level, f.i, f.digest, f.proof),
root AS (SELECT digest FROM over WHERE n = 1),
ends AS (SELECT id, digest, proof FROM higher WHERE level = (SELECT max(level) FROM over))
SELECT l.doc_id, l.leaf, sub.digest AS subroot, root.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = root.digest AS verified
FROM leaves l JOIN subroots sub ON sub.s = l.s JOIN ends e ON e.id = l.id, root
"""


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_quality_fm": op2_quality_fm,
        "op3_contextual_pii": op3_contextual_pii,
        "op4_pack_windows": op4_pack_windows,
        "op5_line_dedup": op5_line_dedup,
        "op6_token_orc": op6_token_orc,
        "op7_merkle_fingerprint": op7_merkle_fingerprint,
        "op8_ngram_join": op8_ngram_join,
        "op9_language_id": op9_language_id,
        "op10_media_sequences": op10_media_sequences,
        "op11_source_divergence": op11_source_divergence,
        "op12_token_counts": op12_token_counts,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op8_ngram_join": OP8_SQL, "op11_source_divergence": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
