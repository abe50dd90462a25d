"""The registered corpus queries: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.catalog.inputs import Registry
from barwright.llm import common, infill, lm_score, merkle, mixing, ngram_join, quality_model, quality_rules, secret_scan, segment, sharding, simhash, spotsigs, warc

REGISTRY = Registry()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    common.ship_package(spark)
    return common.table(spark, d, name)


@REGISTRY.query("op1_simhash_near_dedup")
def op1(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.components(table(spark, d, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@REGISTRY.query("op6_spotsigs_fingerprints")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def _crc32_sql(text: str) -> str:
    tab = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    codes = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor({tab}[1 + (xor(c, b) & 255)], c >> 8)))"


_CRC32 = """WITH step AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8))) AS text_crc32
  FROM documents, step)"""


@REGISTRY.query(
    "op7_rendezvous_sharding",
    f"""{_CRC32},
draws AS (SELECT doc_id, s, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || s), 1, 13))::BIGINT AS u FROM (SELECT DISTINCT doc_id FROM documents), range(17) AS r(s)),
won AS (SELECT doc_id, arg_max(s, u) FILTER (WHERE s < 16) AS shard, arg_max(s, u) AS grown_shard FROM draws GROUP BY doc_id)
SELECT z.doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(z.doc_id::VARCHAR, '')), 1, 15), z.doc_id, size, text_crc32) - 1 AS slot
FROM sized z JOIN won w ON z.doc_id IS NOT DISTINCT FROM w.doc_id""",
)
def op7(spark: SparkSession, d: str) -> DataFrame:
    placed = sharding.place(table(spark, d, "documents"), [1.0] * 16, [1.0] * 17).withColumnRenamed("id", "doc_id")
    return placed.withColumn("law", F.lit("key"))


@REGISTRY.query("op10_quality_rules")
def op10(spark: SparkSession, d: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, d, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged.select(F.col("id").alias("doc_id"), *names)


@REGISTRY.query("op5_quality_classifier")
def op5(spark: SparkSession, d: str) -> DataFrame:
    described = quality_model.describe(table(spark, d, "documents"), "doc_id", "text", quality_model.held_out_fold().alias("held_out"))
    model = quality_model.fit(described.where("NOT held_out"), table(spark, d, "labels"))
    scored = described.select(F.col("id").alias("doc_id"), "held_out", quality_model.score_column(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@REGISTRY.query("op8_source_mixing")
def op8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


@REGISTRY.query(
    "op9_warc_archives",
    """WITH payload AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT hex, max(page_id) AS keep FROM payload GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS intact
FROM payload JOIN last USING (hex)""",
)
def op9(spark: SparkSession, d: str) -> DataFrame:
    records = warc.read_archive(warc.write_archive(table(spark, d, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@REGISTRY.query("op2_sentencepiece_n_best")
def op2(spark: SparkSession, d: str) -> DataFrame:
    coded = segment.encode_documents(table(spark, d, "documents"), with_ids=False)
    best = [F.get("scores", i).alias(f"score_{i + 1}") for i in range(3)]
    others = [F.get("n_best_sha256", i).alias(f"ids_sha256_{i + 1}") for i in range(1, 3)]
    return coded.select(F.col("id").alias("doc_id"), "n_pieces", *best, "ids_sha256", *others, "round_trip")


@REGISTRY.query("op4_lattice_lm_scores")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score_documents(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@REGISTRY.query("op3_secret_scan")
def op3(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
        F.size("added").cast("long").alias("n_format"),
    )


@REGISTRY.query(
    "op11_infill_examples",
    """WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, text, n, ('0x' || d[1:8])::BIGINT % (n + 1) AS a, ('0x' || d[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || d[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, least(a, b) AS p, abs(a - b) AS m, text[:least(a, b)] AS prefix, text[least(a, b) + 1:greatest(a, b)] AS middle, text[greatest(a, b) + 1:] AS suffix FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN m END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || CASE WHEN p = 0 THEN '' ELSE prefix END || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || CASE WHEN p = 0 THEN '' ELSE prefix END || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
)
def op11(spark: SparkSession, d: str) -> DataFrame:
    made = infill.transform(table(spark, d, "documents"))
    restored = infill.restore_column(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restored, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@REGISTRY.query(
    "op12_ngram_jaccard_join",
    r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, n, hash(sh) AS sh FROM (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS i FROM items a JOIN items b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
half AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (total - i)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1) r USING (doc_id)""",
)
def op12(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.components(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


@REGISTRY.query(
    "op13_merkle_manifest",
    f"""WITH RECURSIVE leaves AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS altered, {{crc}} % 5 = 0 AS touched FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
nodes(level, tree, pos, digest, n) AS (SELECT 0, tree, pos, leaf, n FROM placed
  UNION ALL SELECT level + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 16, n),
subroots AS (SELECT tree, level, digest, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(level, pos, digest, n) AS (SELECT 0, tree, digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY level, pos // 16, n),
every AS (SELECT tree, level, pos, digest, n FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.level + u.level, u.pos, u.digest, u.n FROM subroots s, upper u WHERE u.n > 1),
spots AS (SELECT p.tree, p.pos AS leaf_pos, e.level, CASE WHEN e.level < s.level THEN p.pos // (16 ** e.level)::BIGINT ELSE p.tree // (16 ** (e.level - s.level))::BIGINT END AS at
  FROM placed p JOIN subroots s USING (tree) JOIN (SELECT DISTINCT tree, level FROM every) e USING (tree)),
steps AS (SELECT s.tree, s.leaf_pos, s.level, coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (WHERE e.pos < s.at), '') AS before,
    coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (WHERE e.pos > s.at), '') AS after
  FROM spots s JOIN every e ON e.tree = s.tree AND e.level = s.level AND e.pos // 16 = s.at // 16 GROUP BY ALL),
proofs AS (SELECT tree, leaf_pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof, count(*) AS height FROM steps GROUP BY ALL),
folded(tree, pos, level, digest) AS (SELECT tree, pos, 0, CASE WHEN touched THEN altered ELSE leaf END FROM placed
  UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(s.before || f.digest || s.after) FROM folded f JOIN steps s ON s.tree = f.tree AND s.leaf_pos = f.pos AND s.level = f.level)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM upper WHERE n = 1) r LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_pos = p.pos
JOIN folded f ON f.tree = p.tree AND f.pos = p.pos AND f.level = coalesce(q.height, 0)""".replace("{crc}", _crc32_sql("coalesce(doc_id::VARCHAR, '')")),
)
def op13(spark: SparkSession, d: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = common.id_remainder(F.col("doc_id"), 5) == 0
    rows = merkle.manifest(table(spark, d, "documents"), {"text": F.when(touched, lowered).otherwise(F.col("text"))})
    out = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("path"), F.col("presented")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
