"""Retrieval, vectors, chunks, personal data and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import text as T
from tidegraph.operators import resolution, retrieval, vectors
from tidegraph.plans.scratch import materialise
from tidegraph.sources import documents as docs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SP = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
ASKED = [(1, "harbour tug collision"), (2, "fire pump fire drill"), (3, "radar mast"), (4, "no such word")]
ASKED_SQL = "(VALUES (1, 'harbour'), (1, 'tug'), (1, 'collision'), (2, 'fire'), (2, 'pump'), (2, 'fire'), (2, 'drill'), (3, 'radar'), (3, 'mast'), (4, 'no'), (4, 'such'), (4, 'word')) q0(query_id, term)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, text string")


BM25 = f"""
w AS (SELECT doc_id AS id, [x for x in string_split_regex(lower(text), '{SP}') if x <> ''] AS w FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS mean FROM w),
q AS (SELECT query_id, term, count(*) AS qn FROM {ASKED_SQL} GROUP BY 1, 2),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT query_id, id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS raw FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2),
bm AS (SELECT query_id, id, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM raw),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm)"""


def _found(spark: SparkSession, d: str) -> retrieval.Occurrences:
    return retrieval.occurrences(_docs(spark, d), _asked(spark))


def _bm25(found: retrieval.Occurrences, k: int) -> DataFrame:
    scored = retrieval.bm25(None, None, None, found).withColumn("score", F.round("score", 9)).drop("rank")
    return retrieval._ranked(scored, k)


@query(f"WITH {BM25} SELECT query_id, id, round(score, 5) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(_found(spark, d), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


VECTORS = "(SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL)"
NEAR = f"""
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM {VECTORS} a, {VECTORS} b WHERE a.vec_id % 100 = 0),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


def _near(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100, against all."""
    v = _vectors(spark, d)
    found = vectors.search_many(v, v.where("id % 100 = 0"), k + 5).withColumn("score", F.round("score", 6)).drop("rank")
    return retrieval._ranked(found, k)


@query(f"WITH {NEAR} SELECT query_id, id, round(score, 4) AS score FROM sr WHERE rank <= 10")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 10).select("query_id", "id", F.round("score", 4).alias("score"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 4) AS score FROM embeddings WHERE label = 2 AND list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 1000")
def vector_filtered_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.where("id = 7").first()["embedding"]
    kept = v.withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string"))).where(vectors.where_equal("metadata", {"label": 2}))
    return vectors.search(kept, q, 1000, least=0.1).select("id", F.round("score", 4).alias("score"))


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 5) AS scaled FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    other = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("e2"))
    c = T.cosine(F.col("embedding"), F.col("e2"))
    return v.join(other, "id").select("id", F.round(c, 5).alias("score"), F.round(T.similarity_score(c, "cosine"), 5).alias("scaled"))


@query("SELECT count(*) AS vectors, count_if(label = 99) AS replaced FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 99 FROM embeddings WHERE vec_id % 3 = 0) WHERE vec_id % 7 <> 0")
def vector_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    new = v.where("id % 3 = 0").withColumn("label", F.lit(99))
    left = vectors.delete(vectors.upsert(v, new), v.where("id % 7 = 0"))
    return left.agg(F.count("*").alias("vectors"), F.count_if(F.col("label") == 99).alias("replaced"))


@query("SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m FROM (SELECT count(*) AS n, count_if(length(concat_ws(' ', title, content)) >= 20) AS m FROM kg_documents)")
def rows_to_embed(spark: SparkSession, d: str) -> DataFrame:
    k = spark.read.parquet(f"{d}/kg_documents.parquet").withColumn("vector", F.lit(None).cast("array<double>"))
    return k.agg(F.count("*").cast("int").alias("n")).withColumn("m", F.lit(vectors.to_embed(k, ["title", "content"], "vector").count()))


FUSED = f"""
l AS (SELECT query_id, id, score, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT query_id, id, score, rank FROM tf2 WHERE rank <= 30),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)"""
#: The second ranking: documents by number of query words, the shortest first.
SECOND = "tf2 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, sum(tf)::DOUBLE / max(dl) AS score FROM tf JOIN q USING (term) GROUP BY 1, 2))"


@query(f"WITH {BM25}, {SECOND}, {FUSED} SELECT query_id, id, score, rank FROM fr WHERE rank <= 10")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    o = _found(spark, d)
    found = retrieval.hybrid(lambda k: retrieval.density(o, k), lambda k: _bm25(o, k), 10)
    return found.select("query_id", "id", "score", "rank")


@query(f"WITH {BM25}, c AS (SELECT *, rank - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM bmr WHERE rank <= 20) SELECT query_id, id, round(least(1.0, round(score, 9) * 1.1 * (1 - 0.5 * i / n)), 5) AS score FROM c WHERE i < 8")
def rerank_boost(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.boost(_bm25(_found(spark, d), 20), 8).select("query_id", "id", F.round("score", 5).alias("score"))


@query(
    f"WITH {NEAR}, top AS (SELECT * FROM sr WHERE rank <= 10), rel AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0), "
    "j AS (SELECT r.query_id, any_value(n) AS n, count(*) AS r, count(t.id) AS h, min(t.rank) AS first FROM rel r LEFT JOIN top t ON t.query_id = r.query_id AND t.id = r.id JOIN (SELECT query_id, count(*) AS n FROM top GROUP BY 1) c ON c.query_id = r.query_id GROUP BY 1) "
    "SELECT query_id, round(h / n, 4) AS precision, round(h / r, 4) AS recall, round(CASE WHEN h > 0 THEN 2 * (h / n) * (h / r) / (h / n + h / r) ELSE 0 END, 4) AS f1, round(coalesce(1 / first, 0), 4) AS mrr FROM j"
)
def retrieval_measures(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    rel = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label").join(v.select("id", "label"), "label").select("query_id", "id")
    return retrieval.measures(_near(spark, d, 10), rel)


@query()
def compare_retrievers(spark: SparkSession, d: str) -> DataFrame:
    o = _found(spark, d)
    rel = materialise(o.rows.join(o.terms, "term").groupBy("query_id", "id").agg(F.sum("qn").alias("n")).where("n >= 2").select("query_id", "id"), "relevant")
    a = retrieval.mean_measures(retrieval.measures(_bm25(o, 10), rel)).withColumn("retriever", F.lit("bm25"))
    b = retrieval.mean_measures(retrieval.measures(retrieval.density(o, 10), rel)).withColumn("retriever", F.lit("density"))
    return a.unionByName(b)


def _index_sql(name: str, table: str, text: str, no: int) -> str:
    """Scores of one index, the best ten per query."""
    sql = BM25.replace("FROM documents WHERE text IS NOT NULL", f"FROM {table}").replace("lower(text)", f"lower({text})")
    return f"SELECT query_id, {no} AS \"index\", CAST(id AS VARCHAR) AS id, score FROM (WITH {sql} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM bm) WHERE rank <= 10"


@query(
    f"SELECT query_id, \"index\", id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_index_sql('title', 'kg_documents', chr(39) * 2 + ' || coalesce(title, ' + chr(39) * 2 + ')', 0)} UNION ALL {_index_sql('text', 'documents', 'coalesce(text, ' + chr(39) * 2 + ')', 1)})) WHERE rank <= 30"
)
def multi_index_search(spark: SparkSession, d: str) -> DataFrame:
    k = spark.read.parquet(f"{d}/kg_documents.parquet")
    a = retrieval.field_index(k, "doc_id", ["title"], "title")
    b = retrieval.field_index(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", ["text"], "text")
    return retrieval.multi_index([a, b], _asked(spark)).select("query_id", "index", "id", F.round("score", 5).alias("score"))


@query()
def entity_graph_retrieval(spark: SparkSession, d: str) -> DataFrame:
    chunks = _docs(spark, d)
    found = retrieval.extract_entities(chunks)
    links = retrieval.co_occurrences(chunks, found)
    names = found.groupBy("name").agg(F.countDistinct("id").alias("n")).orderBy(F.col("n").desc(), "name").limit(3).select(F.lit(1).alias("query_id"), "name")
    kinds = spark.createDataFrame([(1, "SeaArea")], "query_id int, kind string")
    return retrieval.dual(names, kinds, found, links).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query()
def entity_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    chunks = _docs(spark, d)
    found = retrieval.extract_entities(chunks)
    return retrieval.entity_graph(found, retrieval.co_occurrences(chunks, found))[0]


@query("SELECT doc_id AS id, list_transform(range(0, 8), lambda i: round(v[i + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5)) AS head FROM (SELECT doc_id, list_transform(range(0, 64), lambda i: ('0x' || sha256(text)[(2 * i) % 64 + 1 : (2 * i) % 64 + 2])::INT / 255 - 0.5) AS v FROM documents WHERE text IS NOT NULL)")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    v = _docs(spark, d).where("text IS NOT NULL").select("id", T.hash_embedding(F.col("text")).alias("v"))
    return v.select("id", F.transform(F.slice("v", 1, 8), lambda x: F.round(x, 5)).alias("head"))


MERGED = (
    "WITH RECURSIVE p AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if trim(x, ' ') <> ''] AS parts FROM documents WHERE text IS NOT NULL), "
    "f(doc_id, parts, i, cur, done) AS (SELECT doc_id, parts, 1, parts[1], 0 FROM p WHERE len(parts) > 0 UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN length(cur) + 1 + length(parts[i + 1]) <= 512 THEN cur || chr(10) || parts[i + 1] ELSE parts[i + 1] END, CASE WHEN length(cur) + 1 + length(parts[i + 1]) <= 512 THEN done ELSE done + 1 END FROM f WHERE i < len(parts)), "
    "c AS (SELECT doc_id AS id, done AS chunk, max(length(cur)) AS size FROM f GROUP BY 1, 2)"
)


@query(f"{MERGED} SELECT id, chunk, size FROM c")
def chunks_merged(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).where("text IS NOT NULL").select("id", F.posexplode(T.chunk_merge(F.col("text"), "\n")).alias("chunk", "content"))
    return c.select("id", "chunk", F.length("content").alias("size"))


@query(f"{MERGED}, o(id, chunk, size) AS (SELECT id, chunk, size FROM c WHERE chunk = 0 UNION ALL SELECT c.id, c.chunk, CASE WHEN least(o.size, 50) + c.size <= 512 THEN least(o.size, 50) + c.size ELSE c.size END FROM o JOIN c ON c.id = o.id AND c.chunk = o.chunk + 1) SELECT id || '_' || chunk AS chunk_id, size FROM o")
def chunks_with_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).where("text IS NOT NULL").select("id", F.posexplode(T.chunk_overlap(T.chunk_merge(F.col("text"), "\n"))).alias("chunk", "content"))
    return c.select(F.concat_ws("_", "id", "chunk").alias("chunk_id"), F.length("content").alias("size"))


# The texts hold no personal data, so both sides append some that is derived from the key.
SAMPLE = "(coalesce(text, '') || ' mail a' || doc_id || '@x.co.kr tel 010-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '-1234 id 900101-1' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || ' end')"


def _personal(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pad = lambda n: F.lpad((i % 10**n).cast("string"), n, "0")
    added = F.concat(F.coalesce("text", F.lit("")), F.lit(" mail a"), i, F.lit("@x.co.kr tel 010-"), pad(4), F.lit("-1234 id 900101-1"), pad(6), F.lit(" end"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", added.alias("text"))


#: Letters and digits of other scripts stand for one word character, since the engine at hand ends words at them.
PLAIN = f"regexp_replace({SAMPLE}, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM]', '_', 'g')"
PII_SQL = ", ".join(f"len(regexp_extract_all({PLAIN}, '{rx}')) AS {kind}" for kind, rx in T.PERSONAL.items())


@query(f"SELECT doc_id, {PII_SQL} FROM documents")
def personal_data_counts(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", *T.personal_counts(F.col("text")))


@query("SELECT doc_id, regexp_replace(%s, '%s', '[REDACTED]', 'g') AS text FROM documents" % (SAMPLE, "|".join(f"(?:{rx})" for rx in T.PERSONAL.values())))
def personal_data_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", T.redact(F.col("text")).alias("text"))


SPANS_SQL = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, regexp_extract_all(t, '{rx}') AS v, string_split_regex(t, '{rx}') AS p FROM t" for kind, rx in T.PERSONAL.items())


@query(
    f"WITH t AS (SELECT doc_id, {PLAIN} AS t FROM documents), f AS ({SPANS_SQL}), i AS (SELECT doc_id, kind, v, p, unnest(range(1, len(v) + 1)) AS i FROM f), "
    "g AS (SELECT doc_id, kind, v[i] AS value, CAST(list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in v[1:i - 1]]), 0) AS INT) AS start FROM i) SELECT doc_id, kind, value, start, CAST(start + length(value) AS INT) AS stop FROM g"
)
def personal_data_spans(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("doc_id", F.explode(T.personal_spans("text")).alias("s")).select("doc_id", "s.*")


SUFFIX_SQL = "co\\.?\\s*,?\\s*ltd\\.?|ltd\\.?|inc\\.?|corp\\.?|corporation|company|주식회사|㈜|\\(주\\)"
NORM = f"trim(regexp_replace(regexp_replace(lower(trim(name_en, ' ')), '\\s*(?:{SUFFIX_SQL})\\s*$', ''), '\\s+', ' ', 'g'), ' ')"


@query(f"SELECT org_id, {NORM} AS norm FROM organizations WHERE name_en IS NOT NULL")
def names_normalised(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/organizations.parquet").where("name_en IS NOT NULL")
    return o.select("org_id", T.entity_name(F.col("name_en")).alias("norm"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised names; ``names_normalised`` tells which organisations bear them."""
    return spark.read.parquet(f"{d}/organizations.parquet").select(T.entity_name(F.col("name_en")).alias("norm")).where("norm <> ''").distinct()


NAMES = f"n AS (SELECT DISTINCT {NORM} AS norm FROM organizations WHERE name_en IS NOT NULL AND {NORM} <> '')"
#: The engine at hand compares bytes, so letters beyond ASCII stand as capitals and control characters, which the names don't have.
SPARE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || " + " || ".join(f"chr({i})" for i in range(1, 32))
ONE_BYTE = f"f AS (SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS c FROM (SELECT unnest(string_split(norm, '')) AS c FROM n) WHERE NOT regexp_full_match(c, '[\\x00-\\x7F]')), m AS (SELECT norm, translate(norm, f.c, {SPARE}) AS t FROM n, f)"
LEVENSHTEIN = "1 - levenshtein(x.t, y.t)::DOUBLE / greatest(length(x.t), length(y.t))"


@query(f"WITH {NAMES}, {ONE_BYTE} SELECT x.norm AS a, y.norm AS b, round({LEVENSHTEIN} + 1e-9, 5) AS score FROM m x JOIN m y ON x.norm < y.norm WHERE {LEVENSHTEIN} >= 0.85::DOUBLE - 1e-9")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct names whose similarity is 0.85 or more."""
    return resolution.close_by_edits(_names(spark, d), 0.85).select("a", "b", F.round(F.col("score") + 1e-9, 5).alias("score"))


GRAMS = (
    "g AS (SELECT norm, gram, count(*) AS n FROM (SELECT norm, unnest([substr(norm, i, 3) for i in range(1, length(norm) - 1)]) AS gram FROM n) GROUP BY ALL), w AS (SELECT norm, sqrt(sum(n * n)) AS w FROM g GROUP BY 1), "
    "c AS (SELECT x.norm AS a, y.norm AS b, sum(x.n * y.n) / (any_value(v.w) * any_value(u.w)) AS score FROM g x JOIN g y ON x.gram = y.gram AND x.norm < y.norm JOIN w v ON v.norm = x.norm JOIN w u ON u.norm = y.norm GROUP BY 1, 2)"
)


@query(f"WITH {NAMES}, {GRAMS} SELECT a, b, round(score + 1e-9, 5) AS score FROM c WHERE score >= 0.8 - 1e-9")
def trigram_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct names whose trigram cosine is 0.8 or more."""
    return resolution.close_by_trigrams(_names(spark, d), 0.8).select("a", "b", F.round(F.col("score") + 1e-9, 5).alias("score"))


def _close(spark: SparkSession, d: str) -> DataFrame:
    return resolution.close_by_either(_names(spark, d), 0.85, 0.8)


@query()  # the engine at hand floors half transpositions, so tests compare with a plain computation
def jaro_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Jaro similarity of all pairs that edits or trigrams find."""
    jaro = F.pandas_udf(lambda x, y: __import__("pandas").Series([T.jaro(u, v) for u, v in zip(x, y)], dtype="float64"), "double")
    return _close(spark, d).select("a", "b", F.round(jaro("a", "b") + 1e-9, 4).alias("score"))


@query()
def fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    scored = _close(spark, d).withColumn("grams", resolution.trigram_cosine("a", "b"))
    return scored.select("a", "b", F.round(T.fuzzy_similarity("a", "b"), 5).alias("fuzzy"), F.round(T.jaro_winkler_similarity("a", "b"), 5).alias("jaro_winkler"), F.round(resolution.hybrid("a", "b", "grams"), 5).alias("hybrid"))


@query(f"WITH {NAMES}, {ONE_BYTE}, {GRAMS}, h AS (SELECT x.norm AS a, y.norm AS b, 0.6::DOUBLE * ({LEVENSHTEIN}) + 0.4::DOUBLE * coalesce(c.score, 0) AS score FROM m x JOIN m y ON x.norm < y.norm LEFT JOIN c ON c.a = x.norm AND c.b = y.norm) SELECT a, b, round(score + 1e-9, 5) AS score FROM h WHERE score >= 0.85::DOUBLE - 1e-9")
def hybrid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct names whose weighted similarity is 0.85 or more."""
    n = _names(spark, d)
    found = resolution.hybrid_pairs(n, 0.85)
    return found.select("a", "b", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query()
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/organizations.parquet").where("name_en <> ''").select(F.col("org_id").alias("id"), F.col("name_en").alias("name"))
    return resolution.resolve(o)


@query("SELECT doc_id AS id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\\p{L}\\p{Nd} .,!?;:()\\n\\t-]'))::DOUBLE / length(text) ELSE 0 END, 5) AS share FROM documents WHERE text IS NOT NULL")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text IS NOT NULL").select("id", F.round(T.meaningful_share(F.col("text")), 5).alias("share"))


@query("SELECT doc_id, trim(regexp_replace(text, '%s', ' ', 'g'), ' ') AS text FROM documents WHERE text IS NOT NULL" % SP)
def whitespace_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text IS NOT NULL").select(F.col("id").alias("doc_id"), T.normal_space(F.col("text")).alias("text"))


@query("SELECT doc_id, list_sort(list(DISTINCT k)) AS links FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./?=&_-]+')) AS k FROM documents) GROUP BY 1")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    return docs.links(_docs(spark, d), "id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.array_sort(F.collect_set("link")).alias("links"))


@query("SELECT doc_id, CASE regexp_extract(lower(source), '\\.([a-z0-9]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'csv' THEN 'csv' WHEN 'pdf' THEN 'pdf' WHEN 'hwp' THEN 'hwp' WHEN 'docx' THEN 'docx' WHEN 'pptx' THEN 'pptx' ELSE 'text' END AS kind FROM kg_documents")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/kg_documents.parquet").select("doc_id", docs.kind_of(F.col("source")).alias("kind"))


HTML = "'<h1>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h1>' || coalesce(content, '')"
STRIP = f"regexp_replace(regexp_replace(regexp_replace({HTML}, '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)\\s*>', '', 'g'), '(?i)</(?:p|div|br|li|tr|h[1-6]|table|section|article|ul|ol)\\s*>|<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(html_unescape, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$', '', 'g') AS text FROM (SELECT doc_id, replace(replace(replace({STRIP}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS html_unescape FROM kg_documents WHERE title IS NOT NULL)")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of all titles, escaped, and contents, as they are."""
    k = spark.read.parquet(f"{d}/kg_documents.parquet").where("title IS NOT NULL")
    title = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return k.select("doc_id", docs.html_text(F.concat(F.lit("<h1>"), title, F.lit("</h1>"), F.coalesce("content", F.lit("")))).alias("text"))


# Names, relations and questions ----------------------------------------------------------------------

from tidegraph.operators import language  # noqa: E402
from tidegraph.plans.compile import compile_query  # noqa: E402
from tidegraph.plans.graph import trade_graph  # noqa: E402

WORDS = [("radar", "equipment"), ("fire pump", "equipment"), ("harbour master", "role"), ("harbour", "place")]
WORDS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in WORDS) + ") t(term, kind)"


FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id AS id, term, (length(text) - length(replace({FOLDED}, term, ''))) // length(term) AS n FROM documents, {WORDS_SQL} WHERE contains({FOLDED}, term)")
def dictionary_tags(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame(WORDS, "term string, kind string")
    return language.tag(_docs(spark, d), entries, longest=False).groupBy("id", "term").agg(F.count("*").alias("n"))


@query()
def dictionary_tags_longest(spark: SparkSession, d: str) -> DataFrame:
    return language.tag(_docs(spark, d), spark.createDataFrame(WORDS, "term string, kind string"))


KEYWORDS = [("radar", "Radar", "MENTIONS", 0.8), ("fire pump", "FirePump", "MENTIONS", 0.7), ("pump", "FirePump", "MENTIONS", 0.6), ("towing tank", "TowingTank", "TESTED_AT", 0.85)]


@query("SELECT doc_id AS id, target, relation, max(c) AS confidence FROM documents, (VALUES ('radar', 'Radar', 'MENTIONS', 0.8::DOUBLE), ('fire pump', 'FirePump', 'MENTIONS', 0.7::DOUBLE), ('pump', 'FirePump', 'MENTIONS', 0.6::DOUBLE), ('towing tank', 'TowingTank', 'TESTED_AT', 0.85::DOUBLE)) k(w, target, relation, c) WHERE contains(lower(text), w) GROUP BY 1, 2, 3")
def keyword_relations(spark: SparkSession, d: str) -> DataFrame:
    k = spark.createDataFrame(KEYWORDS, "keyword string, target string, relation string, confidence double")
    return language.keyword_relations(_docs(spark, d), k).select("id", "target", "relation", "confidence")


@query("SELECT source_id AS id, count(DISTINCT target_name) AS mentioned, count(DISTINCT target_name) FILTER (lower(target_name) IN (SELECT lower(x) FROM (SELECT unnest([name, name_en]) AS x FROM organizations) WHERE x IS NOT NULL)) AS known FROM extracted_relations WHERE target_type = 'Organization' AND source_id IS NOT NULL AND target_name IS NOT NULL GROUP BY 1")
def mentions_verified(spark: SparkSession, d: str) -> DataFrame:
    """All mentions held against both names of the organisations."""
    m = spark.read.parquet(f"{d}/extracted_relations.parquet").where("target_type = 'Organization' AND source_id IS NOT NULL AND target_name IS NOT NULL")
    v = spark.read.parquet(f"{d}/organizations.parquet").select(F.explode(F.array("name", "name_en")).alias("name")).where("name IS NOT NULL")
    return language.verify_mentions(m.select(F.col("source_id").alias("id"), F.col("target_name").alias("name")), v).select("id", "mentioned", "known")


TERMS = language.Terms(
    labels={"customer": "Customer", "고객": "Customer", "nation": "Nation", "supplier": "Supplier"},
    links={"orders": ("PLACED", "Order", "outgoing"), "in a nation": ("IN_NATION", "Nation", "outgoing")},
    properties={"balance": "c_acctbal", "잔액": "c_acctbal"},
    values={"building": ("c_mktsegment", "BUILDING")},
)


@query("SELECT count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def question_count(spark: SparkSession, d: str) -> DataFrame:
    return compile_query(trade_graph(spark, d), language.parse_question("How many building customers have a balance over 5000?", TERMS).query)


@query("SELECT avg(c_acctbal) AS value FROM customer WHERE c_mktsegment = 'BUILDING'")
def question_average(spark: SparkSession, d: str) -> DataFrame:
    return compile_query(trade_graph(spark, d), language.parse_question("What is the average balance of building customers?", TERMS).query)


@query("SELECT round(avg(h::DOUBLE), 4) AS recall, count(*) AS questions FROM (SELECT source_id AS question, round(count_if(target_type <> 'Topic') / count(*), 4) AS h FROM (SELECT DISTINCT source_id, target_name, target_type FROM extracted_relations WHERE source_id IS NOT NULL AND target_name IS NOT NULL) GROUP BY 1)")
def component_recall(spark: SparkSession, d: str) -> DataFrame:
    """Findings stand in for the parts of questions: all are expected, topics are not got."""
    r = spark.read.parquet(f"{d}/extracted_relations.parquet").where("source_id IS NOT NULL AND target_name IS NOT NULL")
    part = F.struct("target_name", "target_type").alias("part")
    scored = language.component_recall(r.select(F.col("source_id").alias("question"), part), r.where("target_type <> 'Topic'").select(F.col("source_id").alias("question"), part))
    return scored.agg(F.round(F.avg("recall"), 4).alias("recall"), F.count("*").alias("questions"))


@query()
def best_name_matches(spark: SparkSession, d: str) -> DataFrame:
    """For the names in findings the organisations they may mean, best first."""
    asked = spark.read.parquet(f"{d}/extracted_relations.parquet").where("target_type = 'Organization' AND target_name IS NOT NULL").select(F.col("target_name").alias("name")).distinct()
    known = spark.read.parquet(f"{d}/organizations.parquet").where("name_en <> ''").select(F.col("name_en").alias("name")).distinct()
    return resolution.best_matches(asked, known, most=3)
