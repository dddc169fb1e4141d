"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance_sampling, line_dedup, merkle_manifest, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, spherical_filters, substring_dedup, token_histogram, topk_search
from .common import cut, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.by_document(substring_dedup.passages(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram.suffix_sums(cut(token_histogram.histogram(table(spark, sf_dir, "documents"))))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


MIX_WEIGHTS = [{"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 1}, {}]


def MIX_LEVELS() -> list:
    return [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), MIX_LEVELS(), MIX_WEIGHTS, (3, 5), max_epochs=2, seed=7)
    return taken.select("doc_id", F.col("g0").alias("domain"), F.col("g1").alias("lang"), F.col("g2").alias("source"), "tokens", "epoch")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered, where = merkle_manifest.tampering()
    return merkle_manifest.prove(merkle_manifest.leaves(table(spark, sf_dir, "documents"), tampered=tampered, where=where))


def op12_spherical_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shared(nodes: str, parent: str, key: str, weights: dict[str, int]) -> str:
    """SQL of one level: the budget b of siblings by weight, the full ones first."""
    weight = "CASE " + key + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"
    over = f"PARTITION BY {parent} ORDER BY need, {key} NULLS FIRST ROWS BETWEEN"
    return f"""SELECT *, CASE WHEN is_full THEN cap WHEN open > 0 THEN least((b - taken)::HUGEINT * w // open, cap) ELSE 0 END::BIGINT AS budget FROM (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0) AS taken, sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {parent}) AS open FROM (
    SELECT *, w > 0 AND cap::HUGEINT * wr <= (b - before)::HUGEINT * w AS is_full FROM (
      SELECT *, coalesce(sum(cap) OVER ({over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER ({over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM (
        SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END AS need FROM (SELECT *, {weight} AS w FROM ({nodes}))))))"""


_MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4) AS g0, lang AS g1, source AS g2,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS t FROM documents
), leaf AS (SELECT g0, g1, g2, sum(t)::BIGINT AS supply, 2 * sum(t)::BIGINT AS cap FROM d GROUP BY ALL),
b0 AS ({_shared("SELECT g0, sum(cap) AS cap, (SELECT sum(supply) FROM leaf) * 3 // 5 AS b FROM leaf GROUP BY g0", "1", "g0", MIX_WEIGHTS[0])}),
b1 AS ({_shared("SELECT l.g0, l.g1, sum(l.cap) AS cap, any_value(b0.budget) AS b FROM leaf l JOIN b0 USING (g0) GROUP BY l.g0, l.g1", "g0", "g1", MIX_WEIGHTS[1])}),
b2 AS ({_shared("SELECT l.g0, l.g1, l.g2, l.supply, l.cap, b1.budget AS b FROM leaf l JOIN b1 USING (g0, g1)", "g0, g1", "g2", MIX_WEIGHTS[2])}),
plan AS (SELECT g0, g1, g2, CASE WHEN supply > 0 THEN budget // supply ELSE 1 END AS epochs, budget - CASE WHEN supply > 0 THEN budget // supply ELSE 1 END * supply AS room FROM b2),
placed AS (SELECT d.*, epochs, room, sum(t) OVER (PARTITION BY g0, g1, g2 ORDER BY md5('7:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null'))) AS upto FROM d JOIN plan USING (g0, g1, g2))
SELECT doc_id, g0 AS domain, g1 AS lang, g2 AS source, t AS tokens, epoch::INTEGER AS epoch
FROM (SELECT *, unnest(range(epochs + CASE WHEN room > 0 AND upto <= room THEN 1 ELSE 0 END)) AS epoch FROM placed)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(values: str) -> str:
    """SQL of the CTE crc (v, crc): the CRC-32 of each of some distinct strings v."""
    nibble = "(instr('0123456789ABCDEF', substr(x, {}, 1)) - 1)"
    byte = f"(16 * {nibble.format('2 * i + 1')} + {nibble.format('2 * i + 2')})"
    entry = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
    return f"""crc_table AS (SELECT list({entry} ORDER BY i) AS entries FROM range(256) r(i)),
crc AS (SELECT v, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: {byte}), lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS crc
        FROM (SELECT DISTINCT v, hex(encode(v)) AS x FROM ({values})), crc_table)"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, nodes: str) -> str:
    """SQL of the CTE of all nodes (tree, level, pos, n, digest) above some (tree, pos, n, digest)."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, n, digest FROM {nodes} UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n)"""


def _siblings(nodes: str, rows: str, first: str) -> str:
    """SQL of the steps (id, step, lft, rgt) of rows (id, tree, pos) in the tree of nodes; step numbers begin at first."""
    return f"""SELECT r.id, {first} + s.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < r.pos // (8 ** s.level)::BIGINT), '') AS lft,
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > r.pos // (8 ** s.level)::BIGINT), '') AS rgt
  FROM {rows} r JOIN {nodes} s ON s.tree = r.tree AND s.n > 1 AND s.pos // 8 = r.pos // (8 ** s.level)::BIGINT // 8 GROUP BY r.id, s.level"""


_MERKLE_SQL = f"""
WITH RECURSIVE {_crc("SELECT doc_id::VARCHAR AS v FROM documents WHERE doc_id IS NOT NULL")},
leaf AS (SELECT row_number() OVER () AS id, * FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, {_leaf("text")} AS digest,
                CASE WHEN crc % 3 = 0 THEN {_leaf(_LOWER.format("text"))} END AS changed FROM documents LEFT JOIN crc ON v = doc_id::VARCHAR)),
spot AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
{_tree("lower_tree", "spot")},
subroots AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, digest FROM lower_tree WHERE n = 1),
{_tree("upper_tree", "subroots")},
within AS ({_siblings("lower_tree", "spot", "0")}),
tops AS (SELECT spot.id, '' AS tree, subroots.pos, subroots.digest AS subroot FROM spot JOIN subroots ON subroots.name = spot.tree),
above AS ({_siblings("upper_tree", "tops", "100")}),
steps AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY step) AS k, lft, rgt FROM (FROM within UNION ALL FROM above)),
fold AS (SELECT id, 0 AS k, coalesce(changed, digest) AS node FROM spot UNION ALL SELECT fold.id, steps.k, sha256(lft || node || rgt) FROM fold JOIN steps ON steps.id = fold.id AND steps.k = fold.k + 1),
ends AS (SELECT id, max_by(node, k) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM steps GROUP BY id)
SELECT doc_id, spot.digest AS leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM spot JOIN tops USING (id) JOIN ends USING (id) LEFT JOIN proofs USING (id), (SELECT digest AS root FROM upper_tree WHERE n = 1)"""

_WORD_LIST = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RESAMPLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORD_LIST.format("text")} AS words FROM documents),
dw AS (SELECT id, unnest(words) AS v FROM d), bw AS (SELECT unnest({_WORD_LIST.format("text")}) AS v FROM benchmark),
{_crc("SELECT v FROM dw UNION SELECT v FROM bw")},
s AS (SELECT crc % 10000 AS b, count(*) AS s FROM dw JOIN crc USING (v) GROUP BY ALL), t AS (SELECT crc % 10000 AS b, count(*) AS t FROM bw JOIN crc USING (v) GROUP BY ALL),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000))::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
weights AS (SELECT id, sum(g)::BIGINT AS weight FROM dw JOIN crc USING (v) JOIN gain ON b = crc % 10000 GROUP BY id),
scored AS (SELECT d.id, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (id)),
drawn AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM drawn) THEN r END AS rank FROM scored LEFT JOIN drawn USING (id)"""

_CAPS_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
           AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fit
  FROM embeddings
), links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND a.fit AND b.fit WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a AS id, min(vec_id) AS component_id FROM reached JOIN v ON v.id = reached.b GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.id) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN least USING (id)"""

QUERIES = {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_quality_rules, op4_topk_search, op5_pii, op6_minhash, op7_token_histogram, op8_quality_classifier, op9_line_dedup, op10_mixing, op11_merkle_manifest, op12_spherical_filters, op13_importance_resampling)}

ORACLES = {
    "op11_merkle_manifest": _MERKLE_SQL,
    "op12_spherical_filters": _CAPS_SQL,
    "op13_importance_resampling": _RESAMPLE_SQL,
    "op10_mixing": _MIX_SQL,
    "op4_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.z, r.z), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, line, pos, lower_key AS key FROM (
    SELECT doc_id, line, pos,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, c.key IS NULL OR l.doc_id = c.last AS stays FROM lines l LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
