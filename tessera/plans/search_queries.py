"""Queries of full-text search, with the same rankings in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import testgraph as t
from tessera.operators import search, stored, text
from tessera.plans.registry import query
from tessera.session import stored as once

_U = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_A = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def _ranked_sql(base: str, fields: dict[str, str], terms: list[str], weights: dict[str, float], mode: str, words: str = _U) -> str:
    """CTEs up to `ranked` (doc, score); base is a CTE with doc and the fields' texts."""
    parts = " UNION ALL ".join(f"SELECT doc, {weights.get(f, 1.0)}::DOUBLE AS w, unnest({words.format(x)}) AS term FROM {base}" for f, x in fields.items())
    names = ", ".join(f"('{x}')" for x in terms)
    hit = "starts_with(tok.term, q.term)" if mode == "prefix" else "tok.term = q.term"
    whole = f" HAVING count(*) = {len(terms)}" if mode == "all" else ""
    return f"""tok AS ({parts}), q AS (SELECT unnest([{', '.join(f"'{x}'" for x in terms)}]) AS term),
len AS (SELECT b.doc, count(tok.doc) AS n FROM (SELECT doc FROM {base}) b LEFT JOIN tok ON tok.doc = b.doc GROUP BY b.doc),
hits AS (SELECT tok.doc, q.term, sum(w) AS f FROM tok JOIN q ON {hit} GROUP BY tok.doc, q.term),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term), st AS (SELECT count(*) AS total, avg(n) AS av FROM len),
ranked AS (SELECT h.doc, sum(greatest(1e-6, ln((total - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / av))) AS score FROM hits h JOIN df USING (term) JOIN len USING (doc), st GROUP BY h.doc{whole})""" if names else ""


def _documents(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def _content_blocks(spark, sf_dir):
    """The content index in blocks, written by the first query that reads it."""
    save = lambda path: stored.save_blocks(search.content_index(_documents(spark, sf_dir)), path)
    return stored.Blocks.load(spark, once(spark, sf_dir, "content", save))


def _document_grams(spark, sf_dir):
    save = lambda path: stored.save_trigrams(_documents(spark, sf_dir), ["text"], path)
    return stored.Trigrams.load(spark, once(spark, sf_dir, "grams", save))


_DOCS = "docs AS (SELECT doc_id AS doc, left(text, 51200) AS text FROM documents)"


@query(f"WITH {_DOCS}, tok AS (SELECT doc, unnest({_A.format('text')}) AS term FROM docs) SELECT term, count(DISTINCT doc) AS df, count(*) AS tf FROM tok GROUP BY term")
def s13_content_index(spark, sf_dir):
    ix = search.content_index(_documents(spark, sf_dir))
    return ix.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("text").alias("tf"))


_TERMS = ["all", "rights"]
_SNIP = f"regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') IN ({', '.join(map(repr, _TERMS))})"


@query(f"""WITH {_DOCS}, {_ranked_sql('docs', {'text': 'text'}, _TERMS, {}, 'all', _A)},
s AS (SELECT r.doc, score, list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> '') AS w FROM ranked r JOIN (SELECT doc_id AS doc, text FROM documents) d USING (doc)),
p AS (SELECT *, greatest(0, coalesce(list_position(list_transform(w, lambda x: {_SNIP}), true), 0) - 21) AS skip_n FROM s)
SELECT doc, round(score, 6) AS score, CASE WHEN skip_n > 0 THEN '...' ELSE '' END || array_to_string(list_transform(w[skip_n + 1 : skip_n + 40], lambda x: CASE WHEN {_SNIP} THEN '>>>' || x || '<<<' ELSE x END), ' ') || CASE WHEN len(w) > skip_n + 40 THEN '...' ELSE '' END AS snippet
FROM p ORDER BY score DESC, doc LIMIT 200""")
def t4_content_search(spark, sf_dir):
    return stored.search_content(_documents(spark, sf_dir), _content_blocks(spark, sf_dir), "allRights").select("doc", F.round("score", 6).alias("score"), "snippet")


def _counts(mode: str, terms: list[str]) -> str:
    return f"SELECT '{mode}' AS mode, count(*) AS n, round(sum(score), 4) AS total FROM (WITH {_DOCS}, {_ranked_sql('docs', {'text': 'text'}, terms, {}, mode, _A)} SELECT * FROM ranked)"


@query(" UNION ALL ".join(_counts(m, x) for m, x in (("all", ["the", "license"]), ("any", ["license", "password"]), ("prefix", ["licen", "passw"]))))
def p14_match_forms(spark, sf_dir):
    ix = search.content_index(_documents(spark, sf_dir))
    one = lambda m, x: search.ranked(ix, x, mode=m).agg(F.lit(m).alias("mode"), F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))
    return one("all", ["the", "license"]).unionAll(one("any", ["license", "password"])).unionAll(one("prefix", ["licen", "passw"])).select("mode", "n", "total")


_NOTES = "notes AS (SELECT doc_id AS doc, text, source, lang FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_NOTES}, {_ranked_sql('notes', {'content': 'text', 'category': 'source', 'tags': 'lang'}, ['license', 'en'], search.NOTE_WEIGHTS, 'any')} SELECT doc, round(score, 6) AS score FROM ranked")
def t5_note_search(spark, sf_dir):
    notes = _documents(spark, sf_dir).join(t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc")), "doc")
    fields = {"content": search.unicode_words(F.col("text")), "category": search.unicode_words(F.col("source")), "tags": search.unicode_words(F.col("lang"))}
    path = once(spark, sf_dir, "notes", lambda path: stored.save_blocks(search.index(notes, fields), path))
    return stored.scored(stored.Blocks.load(spark, path), ["license", "en"], search.NOTE_WEIGHTS, "any").select("doc", F.round("score", 6).alias("score"))


_DECISIONS = "dec AS (SELECT conv_id * 1000 + turn AS doc, role, text FROM conversations)"


@query(f"WITH {_DECISIONS}, {_ranked_sql('dec', {'title': 'role', 'description': 'text'}, ['user', 'please'], search.DECISION_WEIGHTS, 'any')} SELECT doc, round(score, 6) AS score FROM ranked")
def t6_decision_search(spark, sf_dir):
    d = t.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "role", "text")
    ix = search.index(d, {"title": search.unicode_words(F.col("role")), "description": search.unicode_words(F.col("text"))})
    return search.ranked(ix, ["user", "please"], search.DECISION_WEIGHTS, "any").select("doc", F.round("score", 6).alias("score"))


@query(f"WITH ch AS (SELECT p_partkey AS doc, p_brand, p_name, p_type FROM part), {_ranked_sql('ch', {'path': 'p_brand', 'summary': 'p_name', 'symbols': 'p_type'}, ['bra', 'sma'], search.CHANGE_WEIGHTS, 'prefix')} SELECT doc, round(score, 6) AS score FROM ranked")
def t7_change_search(spark, sf_dir):
    d = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), "p_brand", "p_name", "p_type")
    ix = search.index(d, {"path": search.unicode_words(F.col("p_brand")), "summary": search.unicode_words(F.col("p_name")), "symbols": search.unicode_words(F.col("p_type"))})
    return search.ranked(ix, ["bra", "sma"], search.CHANGE_WEIGHTS, "prefix").select("doc", F.round("score", 6).alias("score"))


_FIELDS = {"name": "name", "qualifiedName": "qualifiedName", "signature": "signature"}


def _symbols_sql(terms: list[str], q: str, exact: str, limit: int) -> str:
    has = lambda c: f"contains(lower({c}), '{q}')"
    return f"""WITH {t.CTES}, nd AS (SELECT id AS doc, name, qualifiedName, signature FROM nodes), {_ranked_sql('nd', _FIELDS, terms, search.SYMBOL_WEIGHTS, 'all')}
SELECT n.doc AS id, CASE WHEN n.name = '{exact}' THEN 0 WHEN {has('n.name')} THEN 1 WHEN {has('n.qualifiedName')} THEN 2 WHEN {has('n.signature')} OR r.score IS NOT NULL THEN 3 ELSE 4 END AS bonus, round(coalesce(r.score, 0), 6) AS score
FROM nd n LEFT JOIN ranked r USING (doc) WHERE r.score IS NOT NULL OR {has('n.name')} OR {has('n.qualifiedName')} OR {has('n.signature')} ORDER BY bonus, coalesce(r.score, 0) DESC, n.name, id LIMIT {limit}"""


def _symbol_index(spark, sf_dir):
    return search.symbol_index(t.nodes(spark, sf_dir), stemmed=False)


def _symbol_blocks(spark, sf_dir):
    return stored.Blocks.load(spark, once(spark, sf_dir, "symbols", lambda path: stored.save_blocks(_symbol_index(spark, sf_dir), path)))


def _symbol_grams(spark, sf_dir):
    save = lambda path: stored.save_trigrams(t.nodes(spark, sf_dir).withColumnRenamed("id", "doc"), ["name", "qualifiedName", "signature"], path)
    return stored.Trigrams.load(spark, once(spark, sf_dir, "symbol-grams", save))


@query(_symbols_sql(["customer", "000000007"], "customer#000000007", "Customer#000000007", 40))
def t1_symbol_search(spark, sf_dir):
    return search.search_symbols(t.nodes(spark, sf_dir), _symbol_blocks(spark, sf_dir), "Customer#000000007", grams=_symbol_grams(spark, sf_dir)).select("id", "bonus", F.round("score", 6).alias("score"))


@query(f"WITH {t.CTES} SELECT id FROM nodes WHERE contains(lower(name), 'zzz') OR contains(lower(qualifiedName), 'zzz') OR contains(lower(signature), 'zzz') OR contains(lower(name), 'asia') OR contains(lower(qualifiedName), 'asia') OR contains(lower(signature), 'asia') ORDER BY name, id LIMIT 40")
def t1_fuzzy_search(spark, sf_dir):
    return search.search_symbols(t.nodes(spark, sf_dir), _symbol_blocks(spark, sf_dir), "zzz asia", grams=_symbol_grams(spark, sf_dir)).select("id")


@query(f"WITH {t.CTES}, nd AS (SELECT id AS doc, name, qualifiedName, signature FROM nodes), {_ranked_sql('nd', _FIELDS, ['go', 'lib'], {}, 'all')} SELECT doc AS id, r.doc IS NOT NULL AS by_words, contains(lower(nd.qualifiedName), '.go') AS by_text FROM nd LEFT JOIN ranked r USING (doc) WHERE r.doc IS NOT NULL OR contains(lower(nd.qualifiedName), '.go')")
def u1_words_or_text(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).withColumnRenamed("id", "doc")
    by_words = stored.scored(_symbol_blocks(spark, sf_dir), ["go", "lib"]).select(F.col("doc").alias("id"), F.lit(1).alias("words"), F.lit(0).alias("text"))
    by_text = stored.containing(_symbol_grams(spark, sf_dir), nodes, ["qualifiedName"], ".go").select(F.col("doc").alias("id"), F.lit(0), F.lit(1))
    both = by_words.unionAll(by_text).groupBy("id").agg(F.max("words").alias("words"), F.max("text").alias("text"))
    return both.select("id", (F.col("words") == 1).alias("by_words"), (F.col("text") == 1).alias("by_text"))


@query(f"WITH {t.CTES} SELECT id, md5(concat_ws(' ', name, name, name, qualifiedName, qualifiedName, signature, '', regexp_replace(filePath, '[/\\\\]', ' ', 'g'))) AS text FROM nodes")
def t10_node_text(spark, sf_dir):
    n = t.nodes(spark, sf_dir)
    return n.select("id", F.md5(search.node_text(n).cast("binary")).alias("text"))


_PARTS = f"pt AS (SELECT p_partkey AS doc, unnest({_U.format('p_name || chr(32) || p_type')}) AS term FROM part), c AS (SELECT doc, term, count(*) AS tf FROM pt GROUP BY ALL), l AS (SELECT doc, count(*) AS n FROM pt GROUP BY doc), w AS (SELECT c.doc, c.term, tf / n * (ln((SELECT count(*) FROM l) / (1 + count(*) OVER (PARTITION BY c.term))) + 1) AS w FROM c JOIN l USING (doc)), v AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w)"


@query(f"WITH {_PARTS} SELECT b.doc, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b ON a.term = b.term AND a.doc = 7 AND b.doc <> 7 GROUP BY b.doc ORDER BY sum(a.w * b.w) DESC, b.doc LIMIT 10")
def t12_tf_idf_cosine(spark, sf_dir):
    d = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return search.most_similar(search.tf_idf(search.index(d, {"text": search.unicode_words(F.col("text"))})), 7).select("doc", F.round("score", 6).alias("score"))


_REL = "CASE WHEN lower(name) = 'order77' THEN 100 WHEN contains(lower(name), 'order77') THEN 50 WHEN contains(lower(qualifiedName), 'order77') THEN 40 ELSE 0 END + CASE WHEN contains(lower(filePath), 'order77') THEN 20 ELSE 0 END + CASE WHEN contains(lower(name), 'order77') THEN 10 ELSE 0 END + CASE WHEN contains(lower(qualifiedName), 'order77') THEN 8 ELSE 0 END + CASE WHEN contains(lower(filePath), 'order77') THEN 5 ELSE 0 END"


@query(f"WITH {t.CTES} SELECT id, {_REL} AS points FROM nodes WHERE {_REL} > 0")
def t15_relevance(spark, sf_dir):
    n = t.nodes(spark, sf_dir)
    return n.select("id", search.relevance(n, "Order77").alias("points")).where("points > 0")


_SEM = f"sem AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, count(*)::DOUBLE AS score FROM (SELECT sourceId AS id FROM edges UNION ALL SELECT targetId FROM edges) GROUP BY id ORDER BY score DESC, id LIMIT 10))"
_KEY = "kw AS (SELECT id, row_number() OVER (ORDER BY name, id) AS rank FROM (SELECT id, name FROM nodes WHERE contains(lower(name), 'order77') ORDER BY name = 'order77' DESC, name, id LIMIT 6))"


def _lists(spark, sf_dir):
    nodes, edges = t.nodes(spark, sf_dir), t.edges(spark, sf_dir)
    kw = nodes.where(F.contains(F.lower("name"), F.lit("order77"))).orderBy(F.desc(F.col("name") == "order77"), "name", "id").limit(6)
    ends = edges.select(F.col("sourceId").alias("id")).unionAll(edges.select("targetId")).groupBy("id").agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(10)
    return search.with_rank(kw, F.col("name"), F.col("id")).select("id", "rank"), search.with_rank(ends, F.desc("score"), F.col("id")).select("id", "rank")


@query(f"WITH {t.CTES}, {_SEM}, {_KEY}, b AS (SELECT id, 0 AS list, rank FROM kw UNION ALL SELECT id, 1, rank FROM sem WHERE id NOT IN (SELECT id FROM kw)) SELECT id, list, rank::INTEGER AS rank FROM b ORDER BY list, rank, id LIMIT 12")
def u4_hybrid_merge(spark, sf_dir):
    return search.merged(*_lists(spark, sf_dir), "id", 12)


_SMART = _symbols_sql(["order77"], "order77", "order77", 5)


@query(f"""WITH h AS ({_SMART}), r AS (SELECT id, row_number() OVER (ORDER BY bonus, score DESC, id) AS rank FROM h), g AS (WITH {t.CTES} SELECT e.targetId AS id, n.name FROM edges e JOIN nodes n ON n.id = e.sourceId WHERE e.type = 'calls' AND e.targetId IN (SELECT id FROM h))
SELECT r.id, coalesce((SELECT count(*) FROM g WHERE g.id = r.id), 0)::BIGINT AS n_callers, coalesce((SELECT array_to_string((list_sort(list_distinct(list(name))))[1:8], ', ') FROM g WHERE g.id = r.id), '') AS callers FROM r""")
def t13_smart_search(spark, sf_dir):
    nodes, edges = t.nodes(spark, sf_dir), t.edges(spark, sf_dir)
    return search.smart_search(nodes, edges, _symbol_blocks(spark, sf_dir), "order77", mode="keyword", limit=5, grams=_symbol_grams(spark, sf_dir)).select("id", "n_callers", "callers")


@query(f"WITH {t.CTES}, a AS (SELECT id, 0 AS list FROM (SELECT id FROM nodes WHERE name = 'order1') UNION ALL (SELECT id, 1 FROM (SELECT id, name FROM nodes WHERE contains(lower(name), 'asia') ORDER BY name, id LIMIT 10))) SELECT id, min(list)::INTEGER AS list FROM a GROUP BY id ORDER BY list, id LIMIT 20")
def t14_alias_search(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir)
    rules = spark.createDataFrame([("alias", "Order1", "asia"), ("alias", "other", "europe"), ("convention", "order1", "x")], "kind string, term string, target string")
    find = lambda q: nodes.where(F.contains(F.lower("name"), F.lit(q))).orderBy("name", "id").limit(10)
    return search.with_aliases(nodes.where("name = 'order1'"), rules, "order1", find, 20)


_T16 = f"""WITH {t.CTES}, m AS (SELECT * FROM nodes WHERE id IN ('o:1', 'p:1', 'p:2')), i AS (SELECT id AS own FROM m)
SELECT 'symbols' AS section, count(*) AS n FROM m UNION ALL SELECT 'calls', (SELECT count(*) FROM edges JOIN i ON targetId = own WHERE type = 'calls') + (SELECT count(*) FROM edges JOIN i ON sourceId = own WHERE type = 'calls')
UNION ALL SELECT 'code', sum(least(endLine, startLine + 35) + 3 - greatest(1, startLine - 3) + 1)::BIGINT FROM m
UNION ALL SELECT 'related', count(*) FROM edges e JOIN i ON e.sourceId = own JOIN nodes n ON n.id = e.targetId WHERE e.type IN ('inherits', 'implements', 'uses') AND n.type IN ('class', 'interface', 'type_alias', 'enum')
UNION ALL SELECT 'changes', count(*) FROM events WHERE '/lib/' || event_type IN (SELECT filePath FROM m)"""


@query(_T16)
def t16_context_for_symbols(spark, sf_dir):
    nodes, edges = t.nodes(spark, sf_dir), t.edges(spark, sf_dir)
    ids = spark.createDataFrame([("o:1",), ("p:1",), ("p:2",)], "id string")
    lines = nodes.where(F.col("id").isin("o:1", "p:1", "p:2")).select(F.col("filePath").alias("doc")).distinct().select("doc", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("line_no")).withColumn("line", F.lit("x"))
    changes = t.table(spark, sf_dir, "events").select(F.concat(F.lit("/lib/"), "event_type").alias("file"), "ts")
    parts = search.context_for(nodes, edges, lines, changes, ids)
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("section"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out.select("section", "n")


@query(f"WITH d AS (SELECT p_partkey AS doc, p_name AS name FROM part) SELECT doc, array_to_string({_A.format('name')}, ' ') AS words FROM d")
def t3_words(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.array_join(search.unicode_words(F.col("p_name")), " ").alias("words"))


@query("SELECT p_partkey AS doc, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_type || p_brand, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([0-9]+)', ' \\1 ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2), ' ') AS words FROM part")
def t8_code_tokens(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.array_join(text.code_tokens(F.concat("p_type", "p_brand")), " ").alias("words"))


# --- through stored structures

_TOP = f"WITH {_DOCS}, {_ranked_sql('docs', {'text': 'text'}, ['the', 'license'], {}, 'any', _A)} SELECT doc, round(score, 6) AS score FROM ranked ORDER BY score DESC, doc LIMIT 25"


@query(_TOP.replace("SELECT doc, round(score, 6) AS score FROM ranked ORDER BY score DESC", "SELECT doc, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC"))
def t2_best_of_blocks(spark, sf_dir):
    return stored.top_k(_content_blocks(spark, sf_dir), ["the", "license"], 25, mode="any").select("doc", F.round("score", 6).alias("score"))


_LINE = "l AS (SELECT doc_id AS doc, generate_subscripts(a, 1) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_LINE} SELECT doc, line_no::INTEGER AS line_no, line, len(regexp_extract_all(line, '(?:MIT|Apache) License'))::INTEGER AS n_matches FROM l WHERE regexp_matches(line, '(?:MIT|Apache) License')")
def p12_grep_by_trigrams(spark, sf_dir):
    return stored.grep(_document_grams(spark, sf_dir), _documents(spark, sf_dir), "(?:MIT|Apache) License")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id AS doc, md5(text) AS text FROM documents WHERE contains({_FOLD.format('text')}, 'mit license')")
def p2_contains_by_trigrams(spark, sf_dir):
    return stored.containing(_document_grams(spark, sf_dir), _documents(spark, sf_dir), ["text"], "MIT License").select("doc", F.md5(F.col("text").cast("binary")).alias("text"))


@query()
def t3_stemmed_search(spark, sf_dir):
    """Notes by the stems of their words; tests stem all words of a table by hand."""
    notes = _documents(spark, sf_dir).select("doc", F.col("text").alias("content"), F.col("source").alias("category"), F.array("lang").alias("tags"))
    path = once(spark, sf_dir, "stems", lambda path: stored.save_blocks(search.note_index(notes), path))
    ix = stored.Blocks.load(spark, path, stemmed=True)
    return stored.top_k(ix, ["licensing", "permissions", "granted"], 50, search.NOTE_WEIGHTS, "any").select("doc", F.round("score", 6).alias("score"))
