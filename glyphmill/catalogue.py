"""The engine's operators as queries over the driver's tables, each with its DuckDB SQL.

The tables hold no source code, so documents and pages are viewed as code units: see
``units_docs`` and ``units_pages``. Scanners run on the source strings in ``SOURCES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import ids, paths, text, vectors
from glyphmill.functions.embed import SketchEmbedder, with_embedding
from glyphmill.functions.text import ACCENTED, BASES, query_phrases
from glyphmill.operators import changes, fusion, lexical, repomap, similarity
from glyphmill.operators.extraction import extract_units
from glyphmill.plans import search as searching
from glyphmill.schema import FIELD_WEIGHTS, SearchConfig

MODEL = "stored"
CONTENT = {"content": 1.0}
QUERIES = [(1, "hation"), (2, "the hation"), (3, "of_the"), (4, "supported?"), (5, "ENTRE des"), (6, "thesened heention")]
VECTORS = (0, 7, 42)
# A fixed time for staleness checks.
NOW = "2024-01-30 00:00:00"
SOURCES = [
    ("src/lib.rs", "rust", "/// A point.\npub struct Point { x: i32 }\n\nimpl Point {\n    /// Its norm.\n    pub fn norm(&self) -> i32 { self.x }\n    fn raw(&self) -> &str { \"{\" }\n}\n\npub trait Shape {\n    fn area(&self) -> f64;\n    fn twice(&self) -> f64 { 2.0 * self.area() }\n}\n\nfn hidden() {}\n\npub fn broken() {\n"),
    ("web/app.ts", "typescript", "/**\n * A client.\n */\nexport class Client {\n  private secret(): void {}\n  public async get(path: string): Promise<string> {\n    return `${path}/}`;\n  }\n  constructor(readonly base: string) {}\n}\nexport type Id = string | number;\nexport interface Options { deep: boolean }\nexport const limit = 3;\nexport function run(o: Options): Id { return 1; }\n"),
    ("Core/Job.cs", "csharp", "namespace Core\n{\n    /// <summary>\n    /// A job.\n    /// </summary>\n    public class Job\n    {\n        public string Name { get; set; } = \"}\";\n        private int n;\n        public Job() {}\n        public int Run(int times) => times * n;\n        public enum State { On, Off }\n    }\n    public interface IJob { int Run(int times); }\n}\n"),
]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _units(rows: DataFrame) -> DataFrame:
    columns = {"kind": F.lit("function"), "doc": F.lit(None).cast("string"), "parent": F.lit(None).cast("string"), "language": F.lit("text"), "line_start": F.lit(1), "line_end": F.lit(1)}
    return rows.withColumns(columns).withColumn("id", ids.code_unit_id())


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that documents alone give, derived before any join, so that a join moves texts only for those who read them."""
    return _table(spark, sf, "documents").select(
        F.col("doc_id").alias("rowid"),
        F.lit("docs").alias("repo_id"),
        F.col("lang").alias("branch"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"),
        F.col("source").alias("name"),
        F.substring("text", 1, 80).alias("signature"),
        F.col("text").alias("content"),
        ids.content_hash(F.col("text")).alias("file_hash"),
    )


def units_docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as units of repository ``docs``, branch by language, with vectors by equal id."""
    docs, stored = _documents(spark, sf), _table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = F.when(F.col("embedding").isNotNull(), MODEL).otherwise("").alias("embedding_model")
    joined = docs.join(stored, docs.rowid == stored.vec_id, "left")
    return _units(joined.select("rowid", "repo_id", "branch", "file_path", "name", "signature", "content", "embedding", model, "file_hash"))


def texts_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``units_docs`` without their vectors, for searches of words: no text is shuffled to meet a vector.

    A join with vectors changes the rows only where some share an id, so just such ids are joined, as often as they occur; they are sent
    to every task.
    """
    docs, given = _documents(spark, sf), _table(spark, sf, "embeddings").where("vec_id is not null")
    several = given.groupBy("vec_id").count().where("count > 1")
    again = several.select("vec_id", F.explode(F.array_repeat(F.lit(True), F.col("count").cast("int"))).alias("again"))
    return _units(docs.join(F.broadcast(again), docs.rowid == again.vec_id, "left").drop("vec_id", "again"))


def units_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages as units: the path of the address, the title as name, the address as signature."""
    pages = _table(spark, sf, "pages")
    address = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return _units(
        pages.select(
            F.col("page_id").alias("rowid"),
            F.lit("pages").alias("repo_id"),
            F.lit("main").alias("branch"),
            F.regexp_replace(address, "/$", "").alias("file_path"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"),
            F.col("url").alias("signature"),
            F.regexp_replace("html", "<[^>]*>", " ").alias("content"),
            F.lit(None).cast("array<float>").alias("embedding"),
            F.lit("").alias("embedding_model"),
            ids.content_hash(F.col("html")).alias("file_hash"),
        )
    )


def units_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """``units_pages`` named by the first identifier of their titles."""
    return units_pages(spark, sf).withColumn("name", F.regexp_extract("name", "([A-Za-z0-9_]+)", 1))


_KEY = "sha256(concat_ws(chr(31), repo_id, branch, file_path, name, kind, line_start::VARCHAR))"
_REST = "'function' AS kind, NULL::VARCHAR AS doc, NULL::VARCHAR AS parent, 'text' AS language, 1::INTEGER AS line_start, 1::INTEGER AS line_end"
SQL_DOCS = f"""u0 AS (
  SELECT d.doc_id AS rowid, 'docs' AS repo_id, d.lang AS branch, d.source || '/' || d.doc_id::VARCHAR AS file_path, d.source AS name,
    substr(d.text, 1, 80) AS signature, d.text AS content, e.embedding, CASE WHEN e.embedding IS NOT NULL THEN '{MODEL}' ELSE '' END AS embedding_model,
    sha256(d.text) AS file_hash, {_REST}
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
), units AS (SELECT *, {_KEY} AS id FROM u0)"""
SQL_PAGES = f"""u0 AS (
  SELECT page_id AS rowid, 'pages' AS repo_id, 'main' AS branch,
    regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '') AS file_path,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, url AS signature, regexp_replace(html, '<[^>]*>', ' ', 'g') AS content,
    NULL::FLOAT[] AS embedding, '' AS embedding_model, sha256(html) AS file_hash, {_REST}
  FROM pages
), units AS (SELECT *, {_KEY} AS id FROM u0)"""
SQL_SYMBOLS = SQL_PAGES.replace("regexp_extract(html, '<title>([^<]*)</title>', 1) AS name", "regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '([A-Za-z0-9_]+)', 1) AS name")
SQL_VECTORS = f"query_vectors AS (SELECT vec_id AS query_id, embedding AS query_vector FROM embeddings WHERE vec_id IN {VECTORS})"


def _sql_tokens(column: str) -> str:
    return rf"coalesce(regexp_extract_all(translate(lower({column}), '{ACCENTED}', '{BASES}'), '[\p{{L}}\p{{N}}]+'), [])"


def sql_bm25(queries: list[tuple[int, str]], weights: dict[str, float]) -> str:
    """CTEs from ``units`` to scored(query_id, rowid, bm25)."""
    terms = [(q, p, o, t, len(ph), len(query_phrases(s))) for q, s in queries for p, ph in enumerate(query_phrases(s)) for o, t in enumerate(ph)]
    values = ", ".join(f"({q}, {p}, {o}, '{t}', {n}, {m})" for q, p, o, t, n, m in terms)
    fields = " UNION ALL ".join(f"SELECT rowid, '{f}' AS field, {w}::DOUBLE AS weight, {_sql_tokens(f)} AS found FROM units" for f, w in weights.items())
    return f"""terms AS (
  SELECT * FROM (VALUES {values}) v(query_id, phrase_id, shift, token, n_tokens, n_phrases)
), fields AS MATERIALIZED ({fields}), lengths AS (
  SELECT rowid, sum(len(found))::BIGINT AS n_tok FROM fields GROUP BY rowid
), stats AS (
  SELECT count(*) AS n_docs, avg(n_tok) AS avg_len FROM lengths
), flat AS (
  SELECT rowid, field, weight, unnest(found) AS token, unnest(range(len(found))) AS pos FROM fields
), starts AS (
  SELECT t.query_id, t.phrase_id, f.rowid, f.field, f.weight, t.n_tokens, t.n_phrases, f.pos - t.shift AS start, count(*) AS met
  FROM flat f JOIN terms t ON f.token = t.token GROUP BY ALL
), freqs AS (
  SELECT query_id, phrase_id, rowid, n_phrases, sum(weight) AS freq FROM starts WHERE met = n_tokens GROUP BY ALL
), counted AS (
  SELECT f.*, count(*) OVER (PARTITION BY query_id, phrase_id) AS n_rows, l.n_tok FROM freqs f JOIN lengths l USING (rowid)
), parts AS (
  SELECT *, CASE WHEN ln((n_docs - n_rows + 0.5::DOUBLE) / (n_rows + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - n_rows + 0.5::DOUBLE) / (n_rows + 0.5::DOUBLE)) END
    * freq * (1.2::DOUBLE + 1) / (freq + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n_tok / avg_len)) AS part FROM counted, stats
), scored AS (
  SELECT query_id, rowid, round(-sum(part), 10) AS bm25 FROM parts GROUP BY query_id, rowid, n_phrases HAVING count(*) = n_phrases
)"""


def _sql_top(source: str, order: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rk FROM {source} QUALIFY rk <= {k}"


def _fts_sql(units: str, queries: list[tuple[int, str]], weights: dict[str, float], k: int, where: str = "true") -> str:
    return f"WITH {units}, {sql_bm25(queries, weights)}, hits AS (SELECT s.* FROM scored s JOIN units u USING (rowid) WHERE {where})\nSELECT query_id::BIGINT AS query_id, rowid, round(bm25, 6) AS bm25, rk FROM ({_sql_top('hits', 'bm25, rowid', k)})"


def _sql_cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "embeddings").where(F.col("vec_id").isin(*VECTORS))
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _second_version(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """documents as (path, hash) now and as they were: without every tenth, every seventh altered, some new."""
    docs = _table(spark, sf, "documents")
    before = docs.select(F.col("doc_id").cast("string").alias("path"), ids.content_hash(F.col("text")).alias("hash"))
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = docs.where(F.col("doc_id") % 10 != 0).select(F.col("doc_id").cast("string").alias("path"), ids.content_hash(altered).alias("hash"))
    new = docs.where(F.col("doc_id") % 10 == 3).select((F.col("doc_id") + 1_000_000).cast("string").alias("path"), ids.content_hash(F.col("text")).alias("hash"))
    return kept.unionByName(new), before


SQL_DIFF = """before AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents),
now AS (
  SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT (doc_id + 1000000)::VARCHAR, sha256(text) FROM documents WHERE doc_id % 10 = 3
), diff AS (
  SELECT coalesce(n.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.hash <> b.hash THEN 'modified' END AS change_type
  FROM now n FULL JOIN before b ON n.path = b.path
)"""


def _new_units(units: DataFrame) -> DataFrame:
    """A batch for upserts: every third unit again, every sixth with other content, some with vectors, some new."""
    given = F.when(F.col("rowid") % 4 == 0, F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))
    again = units.where(F.col("rowid") % 3 == 0).withColumn("content", F.when(F.col("rowid") % 6 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("embedding", given).withColumn("embedding_model", F.lit(""))
    new = units.where(F.col("rowid") % 10 == 1).withColumn("file_path", F.concat(F.lit("new/"), "file_path")).withColumn("embedding", given).withColumn("rowid", F.col("rowid") + 1_000_000).withColumn("embedding_model", F.lit(""))
    return again.unionByName(new)


SQL_NEW = """fresh AS (
  SELECT * REPLACE (CASE WHEN rowid % 6 = 0 THEN content || '!' ELSE content END AS content, CASE WHEN rowid % 4 = 0 THEN [1.0, 2.0]::FLOAT[] END AS embedding, '' AS embedding_model) FROM units WHERE rowid % 3 = 0
  UNION ALL BY NAME
  SELECT * REPLACE ('new/' || file_path AS file_path, CASE WHEN rowid % 4 = 0 THEN [1.0, 2.0]::FLOAT[] END AS embedding, '' AS embedding_model, rowid + 1000000 AS rowid) FROM units WHERE rowid % 10 = 1
)"""


def _sql_upsert(old: str) -> str:
    key = " AND ".join(f"a.{k} = b.{k}" for k in ("repo_id", "branch", "file_path", "name", "kind", "line_start"))
    return f"""merged AS (
  SELECT coalesce(a.rowid, b.rowid) AS rowid, coalesce(b.file_path, a.file_path) AS file_path, coalesce(b.branch, a.branch) AS branch, coalesce(b.content, a.content) AS content,
    CASE WHEN a.rowid IS NULL THEN b.embedding
      WHEN b.rowid IS NULL THEN a.embedding
      WHEN a.signature <> b.signature OR a.doc IS DISTINCT FROM b.doc OR a.content <> b.content THEN NULL
      ELSE coalesce(b.embedding, a.embedding) END AS embedding,
    CASE WHEN a.rowid IS NULL THEN CASE WHEN b.embedding IS NULL THEN '' ELSE 'unknown' END
      WHEN b.rowid IS NULL THEN a.embedding_model
      WHEN a.signature <> b.signature OR a.doc IS DISTINCT FROM b.doc OR a.content <> b.content THEN ''
      WHEN b.embedding IS NOT NULL THEN 'unknown' ELSE a.embedding_model END AS embedding_model
  FROM {old} a FULL JOIN fresh b ON {key}
)"""


_SHOWN = ("rowid", "file_path", "branch", "embedding_model")


def _shown(units: DataFrame) -> DataFrame:
    return units.select(*_SHOWN, F.md5(F.col("content").cast("binary")).alias("content_md5"), F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("dimension"))


SQL_SHOWN = "rowid, file_path, branch, embedding_model, md5(content) AS content_md5, coalesce(len(embedding), -1)::BIGINT AS dimension"


def _file_records(units: DataFrame) -> DataFrame:
    """One record a file; the time is fixed."""
    return units.groupBy("repo_id", "branch", "file_path").agg(F.min("file_hash").alias("file_hash"), F.count(F.lit(1)).cast("int").alias("chunk_count")).withColumn("indexed_at", F.lit(NOW).cast("timestamp"))


def _deleted(units: DataFrame) -> DataFrame:
    return units.where(F.col("rowid") % 5 == 0).select("repo_id", "branch", "file_path")


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    """events as index metadata: one row a user, of the user's last event."""
    last = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = _table(spark, sf, "events").withColumn("rn", F.row_number().over(last)).where("rn = 1")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "indexing").otherwise("ready")
    return rows.select("user_id", status.alias("status"), F.col("ts").cast("timestamp").alias("last_indexed_at"), F.when(F.col("event_id") % 3 != 0, F.md5(F.col("user_id").cast("string"))).alias("commit"), F.when(F.col("event_id") % 4 != 0, F.md5(F.col("event_type"))).alias("seen"))


def _hits(spark: SparkSession, sf: str, k: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = texts_docs(spark, sf)
    fts = lexical.search_fts(units, [(0, "hation"), (7, "the thing"), (42, "of_the")], k, weights=FIELD_WEIGHTS)
    return units, fts, similarity.search_vector(units_docs(spark, sf), _query_vectors(spark, sf), k)


def _sql_hits(k: int = 30) -> str:
    return f"""{SQL_DOCS}, {sql_bm25([(0, "hation"), (7, "the thing"), (42, "of_the")], FIELD_WEIGHTS)}, {SQL_VECTORS},
fts AS ({_sql_top('scored', 'bm25, rowid', k)}),
cosines AS (SELECT q.query_id, u.rowid, round({_sql_cosine('u.embedding', 'q.query_vector')}, 6) AS score FROM units u, query_vectors q WHERE u.embedding IS NOT NULL),
near AS ({_sql_top('cosines', 'score DESC, rowid', k)}),
hits AS (SELECT query_id, rowid, rk, 'fts' AS origin FROM fts UNION ALL SELECT query_id, rowid, rk, 'vector' FROM near),
fused AS (
  SELECT query_id, rowid, sum(CASE WHEN origin = 'fts' THEN 1.0::DOUBLE / (60 + rk) ELSE 0 END) AS fts_score, sum(CASE WHEN origin = 'vector' THEN 1.0::DOUBLE / (60 + rk) ELSE 0 END) AS vector_score,
    CASE WHEN count(DISTINCT origin) = 2 THEN 'hybrid' ELSE max(origin) END AS match_type FROM hits GROUP BY query_id, rowid
), ordered AS (
  SELECT f.*, fts_score + vector_score AS combined, CASE WHEN match_type = 'hybrid' THEN 2 ELSE 1 END AS mr, u.file_path, u.name, u.line_start, u.signature, u.content, u.kind FROM fused f JOIN units u USING (rowid)
)"""


_ORDER = "mr DESC, line_start, file_path, name, rowid"
_FUSED = "query_id, rowid, round(fts_score, 6) AS fts_score, round(vector_score, 6) AS vector_score, round(combined, 6) AS combined, match_type"


def _fused_columns(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "rowid", *[F.round(c, 6).alias(c) for c in ("fts_score", "vector_score", "combined")], "match_type", "rk")


def _q_hybrid(spark, sf):
    units, fts, near = _hits(spark, sf)
    return _fused_columns(fusion.top_fused(fusion.fuse(fts, near), units, 10))


def _q_hybrid_single(spark, sf):
    return _q_hybrid(spark, sf).where("query_id = 0").drop("query_id")


def _q_match_types(spark, sf):
    _, fts, near = _hits(spark, sf)
    return fusion.fuse(fts, near).groupBy("query_id", "match_type").agg(F.count(F.lit(1)).alias("n"))


def _q_shaping(spark, sf):
    units, fts, near = _hits(spark, sf)
    ranked = fusion.top_fused(fusion.fuse(fts, near), units, 30)
    shaped = fusion.shape_results(ranked, SearchConfig(limit=8, min_score=0.3))
    return shaped.select("query_id", "rk", "rowid", "path", "line", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"), "score", "match_type")


_SNIPPET = r"CASE WHEN content = '' THEN content ELSE array_to_string(list_slice(string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n'), 1, 7), chr(10)) END"


def _q_vector(spark, sf, k=10):
    return similarity.search_vector(units_docs(spark, sf), _query_vectors(spark, sf), k)


SQL_VECTOR = f"WITH {SQL_DOCS}, {SQL_VECTORS}, cosines AS (SELECT q.query_id, u.rowid, round({_sql_cosine('u.embedding', 'q.query_vector')}, 6) AS score FROM units u, query_vectors q WHERE u.embedding IS NOT NULL)\n"


def _every_50th(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """embeddings as units, and every row whose id is divisible by 50 as a query."""
    rows = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding")
    return rows, rows.where("rowid % 50 = 0").select(F.col("rowid").alias("query_id"), F.col("embedding").alias("query_vector"))


def _q_vector_batch(spark, sf):
    rows, queries = _every_50th(spark, sf)
    return similarity.search_vector(rows, queries, 10)


def _q_vector_index(spark, sf):
    rows, queries = _every_50th(spark, sf)
    index = similarity.VectorIndex.fit(rows)
    return index.search(index.assign(rows), queries, 10)


def _q_probe(spark, sf):
    """Whether each of some branches (two of which do not exist) has symbols."""
    asked = spark.createDataFrame([(b,) for b in PROBED], "branch string")
    there = units_docs(spark, sf).select("branch").distinct().withColumn("found", F.lit(True))
    return asked.join(there, "branch", "left").select("branch", F.coalesce("found", F.lit(False)).alias("has_symbols"))


PROBED = ("de", "en", "fr", "no such branch", "")


def _q_per_label(spark, sf):
    rows, query = _table(spark, sf, "embeddings"), _query_vectors(spark, sf)
    scored = rows.join(F.broadcast(query), F.size("query_vector") >= 0).select("query_id", "vec_id", "label", F.round(vectors.cosine_similarity(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    order = Window.partitionBy("query_id", "label").orderBy(F.col("score").desc(), F.col("vec_id"))
    return scored.withColumn("rk", F.row_number().over(order)).where("rk <= 3")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("bm25", F.round("bm25", 6))


def _q_fts_scores(spark, sf):
    hits = _rounded(lexical.search_fts(texts_docs(spark, sf), QUERIES, 20, weights=CONTENT))
    return hits.select("query_id", "rowid", F.round(lexical.fts_score(F.col("bm25")), 6).alias("score"), F.round(lexical.reference_fts_score(F.col("bm25")), 6).alias("reference_score"))


def _q_mode(spark, sf, fts: bool):
    units = texts_docs(spark, sf) if fts else units_docs(spark, sf)
    config = SearchConfig(limit=5, use_fts=fts, use_vector=not fts)
    shaped = searching.search_many(units, [(0, "hation"), (7, "the thing"), (42, "of_the")], config, query_vectors=_query_vectors(spark, sf))
    return shaped.select("query_id", "rk", "rowid", "score", "match_type")


def _sql_mode(fts: bool) -> str:
    source = "SELECT query_id, rowid, abs(bm25) / (1 + abs(bm25)) AS s, 'fts' AS match_type FROM fts" if fts else "SELECT query_id, rowid, score AS s, 'vector' AS match_type FROM near"
    return f"""WITH {_sql_hits(15)}, modal AS ({source}), scaled AS (
  SELECT query_id, rowid, match_type, round(CASE WHEN greatest(max(s) OVER (PARTITION BY query_id), 0) > 0 THEN s / greatest(max(s) OVER (PARTITION BY query_id), 0) ELSE 0 END, 6) AS score FROM modal
), kept AS (SELECT s.*, u.line_start, u.file_path, u.name FROM scaled s JOIN units u USING (rowid) WHERE score >= 0)
SELECT query_id::BIGINT AS query_id, rowid, score, match_type, rk FROM ({_sql_top('kept', 'score DESC, line_start, file_path, name, rowid', 5)})"""


def _q_map(spark, sf, prefix=None):
    built = repomap.modules(repomap.located(units_symbols(spark, sf), "pages", prefix))
    return built.select("module", "name", F.array_join("files", ",").alias("files"), F.size("symbols").cast("long").alias("n_symbols"), F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("symbols"))


_MODULE = "CASE WHEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(file_path, '^(.*)/[^/]*$', 1) END"


def _sql_located(where: str = "true") -> str:
    return f"{SQL_SYMBOLS}, located AS (SELECT *, {_MODULE} AS module, list_last(string_split({_MODULE}, '/')) AS label, list_last(string_split(file_path, '/')) AS file FROM units WHERE {where})"


def _sql_map(where: str = "true") -> str:
    return f"""WITH {_sql_located(where)}
SELECT module, first(label) AS name, array_to_string(list_sort(list_distinct(list(file))), ',') AS files, count(*)::BIGINT AS n_symbols,
  string_agg(name, ',' ORDER BY file_path, line_start, name, kind, signature) AS symbols FROM located GROUP BY module"""


def _q_hints(spark, sf):
    units = repomap.located(units_symbols(spark, sf).where("name <> ''"), "pages")
    return repomap.dependency_hints(units).groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("dep")), ",").alias("depends_on"))


SQL_HINTS = f"""WITH {_sql_located("name <> ''")}, used AS (
  SELECT DISTINCT module, unnest(regexp_extract_all(signature || ' ' || content, '[A-Za-z0-9_]+')) AS word FROM located
), deps AS (SELECT DISTINCT u.module, d.label FROM used u JOIN (SELECT DISTINCT name, module, label FROM located) d ON u.word = d.name WHERE d.module <> u.module)
SELECT module, string_agg(label, ',' ORDER BY label) AS depends_on FROM (SELECT DISTINCT module, label FROM deps) GROUP BY module"""


def _q_upsert(spark, sf):
    units = units_docs(spark, sf)
    return _shown(changes.upsert_units(units, _new_units(units)))


def _q_incremental(spark, sf):
    units = units_docs(spark, sf)
    new = _new_units(units)
    return _shown(changes.apply_changes(units, _file_records(units), _deleted(units), new, _file_records(new))[0])


def _q_incremental_files(spark, sf):
    units = units_docs(spark, sf)
    new = _new_units(units)
    files = changes.apply_changes(units, _file_records(units), _deleted(units), new, _file_records(new))[1]
    return files.select("branch", "file_path", "file_hash", "chunk_count")


_KEPT = "kept AS (SELECT * FROM units WHERE (repo_id, branch, file_path) NOT IN (SELECT (repo_id, branch, file_path) FROM units WHERE rowid % 5 = 0))"


def _q_update_embeddings(spark, sf):
    units = units_docs(spark, sf)
    updates = units.where(F.col("embedding").isNull() & (F.col("rowid") % 2 == 1)).select("id", F.array(F.col("rowid").cast("float")).alias("embedding"))
    return _shown(changes.update_embeddings(units, updates, "other"))


def _q_stale(spark, sf):
    rows = _metadata(spark, sf)
    return rows.select("user_id", changes.needs_refresh(F.col("status"), F.col("last_indexed_at"), F.col("commit"), F.col("seen"), F.lit(NOW).cast("timestamp"), 60 * 24).alias("stale"))


def _q_extract(language: str):
    def run(spark, sf):
        rows = [(p, lang, bytearray(src.encode())) for p, lang, src in SOURCES if lang == language]
        return extract_units(spark.createDataFrame(rows, "file_path string, language string, content binary"))

    return run


# What the sources hold: name, kind, signature, doc, parent, first and last line, and the begin and end of the content.
_EXPECTED = {
    "rust": [
        ("Point", "struct", "pub struct Point", "A point.", None, 2, 2, "pub struct Point", "x: i32 }"),
        ("norm", "method", "pub fn norm(&self) -> i32", "Its norm.", "Point", 6, 6, "pub fn norm", "self.x }"),
        ("raw", "method", "fn raw(&self) -> &str", None, "Point", 7, 7, "fn raw", '"{" }'),
        ("Shape", "trait", "pub trait Shape", None, None, 10, 13, "pub trait Shape", "self.area() }\n}"),
        ("area", "method", "fn area(&self) -> f64", None, "Shape", 11, 11, "fn area", "f64;"),
    ],
    "typescript": [
        ("Client", "class", "class Client", "A client.", None, 4, 10, "class Client", "base: string) {}\n}"),
        ("get", "method", "public async get(path: string): Promise<string>", None, "Client", 6, 8, "public async get", "`;\n  }"),
        ("constructor", "method", "constructor(readonly base: string)", None, "Client", 9, 9, "constructor", "{}"),
        ("Id", "constant", "type Id", None, None, 11, 11, "type Id", "number;"),
        ("Options", "interface", "interface Options", None, None, 12, 12, "interface Options", "boolean }"),
        ("run", "function", "function run(o: Options): Id", None, None, 14, 14, "function run", "1; }"),
    ],
    "csharp": [
        ("Job", "class", "public class Job", "A job.", None, 6, 13, "public class Job", "On, Off }\n    }"),
        ("Name", "constant", "public string Name", None, "Job", 8, 8, "public string Name", '"}";'),
        ("Run", "method", "public int Run(int times)", None, "Job", 11, 11, "public int Run", "times * n;"),
        ("State", "enum", "public enum State", None, "Job", 12, 12, "public enum State", "Off }"),
        ("IJob", "interface", "public interface IJob", None, None, 14, 14, "public interface IJob", "times); }"),
    ],
}


def _sql_extract(language: str) -> str:
    ((path, source),) = [(p, src) for p, lang, src in SOURCES if lang == language]
    quoted = lambda x: "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"
    rows = []
    for place, (name, kind, signature, doc, parent, first, last, begin, end) in enumerate(_EXPECTED[language]):
        at = source.index(begin)
        content = source[at : source.index(end, at) + len(end)]
        rows.append(f"({', '.join(quoted(x) for x in (path, language, name, kind, signature, doc, content, parent))}, {first}::INTEGER, {last}::INTEGER, {place}::INTEGER)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(file_path, language, name, kind, signature, doc, content, parent, line_start, line_end, position)"


def _q_sketch(spark, sf):
    docs = _table(spark, sf, "documents")
    made = with_embedding(docs.select("doc_id", "text"), SketchEmbedder(), F.col("text"))
    return made.select("doc_id", F.element_at("embedding", 1).cast("long").alias("n_bytes"), F.element_at("embedding", 4).cast("long").alias("has_pub"))


def _q_stream(spark, sf):
    from glyphmill.streaming.ingest import ingest_available

    return ingest_available(spark, _table(spark, sf, "documents").schema, f"{sf}/documents.parquet")


def _q_events(spark, sf):
    rows = _table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _q_paths(spark, sf):
    extension = F.element_at(F.array(*[F.lit(x) for x in (".rs", ".ts", ".tsx", ".cs", ".md", "")]), (F.col("page_id") % 6 + 1).cast("int"))
    made = units_pages(spark, sf).select(F.col("rowid").alias("page_id"), "file_path").withColumn("path", F.concat(F.when(F.col("page_id") % 7 == 0, "build/").otherwise("src/"), F.col("file_path"), extension))
    return made.select("page_id", paths.language_of(F.col("path")).alias("language"), paths.in_excluded_directory(F.col("path")).alias("excluded"))


def _q_sizes(spark, sf):
    raw = F.when(F.col("doc_id") % 9 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\0"))).otherwise(F.col("text").cast("binary"))
    rows = _table(spark, sf, "documents").select("doc_id", raw.alias("content"))
    return rows.where((F.length("content") <= 8000) & ~paths.has_nul(F.col("content"))).select("doc_id", F.length("content").cast("long").alias("size"))


def _q_timestamps(spark, sf):
    """Times of events as RFC 3339 texts: in UTC, with an offset, and without one (which is no such text: -1)."""
    ts = F.col("ts").cast("timestamp")
    shown = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(shown, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(shown, F.lit("+02:00"))).otherwise(shown)
    return _table(spark, sf, "events").select("event_id", F.coalesce(F.unix_seconds(text.parse_timestamp(given)), F.lit(-1)).alias("seconds"))


Query = Callable[[SparkSession, str], DataFrame]


def _entries() -> dict[str, tuple[Query, str | None]]:
    docs_fts = lambda queries, where=None, weights=CONTENT, k=10: lambda s, sf: _rounded(lexical.search_fts(texts_docs(s, sf), queries, k, F.expr(where) if where else None, weights))
    one, both, phrase = [(1, "hation")], [(2, "the hation")], [(3, "of_the")]
    return {
        "bm25_single_term_topk": (docs_fts(one), _fts_sql(SQL_DOCS, one, CONTENT, 10)),
        "bm25_multi_term_and": (docs_fts(both), _fts_sql(SQL_DOCS, both, CONTENT, 10)),
        "bm25_phrase": (docs_fts(phrase), _fts_sql(SQL_DOCS, phrase, CONTENT, 10)),
        "bm25_batch": (docs_fts(QUERIES), _fts_sql(SQL_DOCS, QUERIES, CONTENT, 10)),
        "bm25_weighted_fields": (lambda s, sf: _rounded(lexical.search_fts(units_pages(s, sf), QUERIES, 10)), _fts_sql(SQL_PAGES, QUERIES, FIELD_WEIGHTS, 10)),
        "bm25_branch_filter_global_stats": (docs_fts([(5, "entre des")], "branch = 'fr'"), _fts_sql(SQL_DOCS, [(5, "entre des")], CONTENT, 10, "branch = 'fr'")),
        "fts_score_normalize": (_q_fts_scores, f"SELECT query_id, rowid, round(abs(bm25) / (1 + abs(bm25)), 6) AS score, round(1 / (1 + abs(bm25)), 6) AS reference_score FROM ({_fts_sql(SQL_DOCS, QUERIES, CONTENT, 20)})"),
        "corpus_stats": (
            lambda s, sf: lexical.corpus_stats(texts_docs(s, sf), CONTENT).select("n_docs", "total_tokens", F.round("avg_len", 6).alias("avg_len")),
            f"WITH {SQL_DOCS} SELECT count(*) AS n_docs, sum(len({_sql_tokens('content')}))::BIGINT AS total_tokens, round(avg(len({_sql_tokens('content')})), 6) AS avg_len FROM units",
        ),
        "term_document_frequency": (
            lambda s, sf: lexical.document_frequency(texts_docs(s, sf), CONTENT),
            f"WITH {SQL_DOCS}, flat AS (SELECT rowid, unnest({_sql_tokens('content')}) AS token FROM units) SELECT token, count(DISTINCT rowid) AS n_docs, count(*) AS n_occurrences FROM flat GROUP BY token",
        ),
        "sanitize_query_phrases": (
            lambda s, sf: _table(s, sf, "benchmark").select("item_id", text.sanitized_column(F.col("text")).alias("phrases")),
            r"""SELECT item_id, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: '"' || replace(x, '"', '""') || '"'), ' ') END AS phrases FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)""",
        ),
        "single_line_text": (
            lambda s, sf: _table(s, sf, "documents").select("doc_id", F.md5(text.single_line(F.col("text")).cast("binary")).alias("line_md5")),
            r"SELECT doc_id, md5(regexp_replace(trim(text), '\s+', ' ', 'g')) AS line_md5 FROM documents",
        ),
        "parse_timestamps": (_q_timestamps, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch(ts)::BIGINT WHEN 1 THEN epoch(ts)::BIGINT - 7200 ELSE -1 END AS seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)"),
        "vector_cosine_topk": (_q_vector, SQL_VECTOR + f"SELECT query_id, rowid, score, rk FROM ({_sql_top('cosines', 'score DESC, rowid', 10)})"),
        "vector_topk_batch": (
            _q_vector_batch,
            f"WITH cosines AS (SELECT q.vec_id AS query_id, u.vec_id AS rowid, round({_sql_cosine('u.embedding', 'q.embedding')}, 6) AS score FROM embeddings u, embeddings q WHERE q.vec_id % 50 = 0 AND u.embedding IS NOT NULL) "
            f"SELECT query_id, rowid, score, rk FROM ({_sql_top('cosines', 'score DESC, rowid', 10)})",
        ),
        "vector_index_topk": (_q_vector_index, None),
        "vector_distance_score": (
            lambda s, sf: _q_vector(s, sf, 25).select("query_id", "rowid", F.round(vectors.distance_score(1 - F.col("score")), 6).alias("score")),
            SQL_VECTOR + f"SELECT query_id, rowid, round(1 / (1 + greatest(1 - score, 0)), 6) AS score FROM ({_sql_top('cosines', 'score DESC, rowid', 25)})",
        ),
        "vector_l2_normalize": (
            lambda s, sf: _table(s, sf, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalized(F.col("embedding"))).alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x")),
            "SELECT vec_id, unnest(range(len(embedding))) AS at, round(unnest(list_transform(embedding::DOUBLE[], lambda x: x / n)), 6) AS x FROM (SELECT vec_id, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
        ),
        "vector_topk_per_label": (_q_per_label, f"WITH {SQL_VECTORS}, s AS (SELECT query_id, vec_id, label, round({_sql_cosine('embedding', 'query_vector')}, 6) AS score FROM embeddings, query_vectors) SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id)::INTEGER AS rk FROM s QUALIFY rk <= 3"),
        "hybrid_rrf": (_q_hybrid_single, f"WITH {_sql_hits()} SELECT * EXCLUDE (query_id) FROM (SELECT {_FUSED}, rk FROM ({_sql_top('ordered', 'combined DESC, ' + _ORDER, 10)})) WHERE query_id = 0"),
        "hybrid_rrf_batch": (_q_hybrid, f"WITH {_sql_hits()} SELECT {_FUSED}, rk FROM ({_sql_top('ordered', 'combined DESC, ' + _ORDER, 10)})"),
        "hybrid_match_type_counts": (_q_match_types, f"WITH {_sql_hits()} SELECT query_id, match_type, count(*) AS n FROM fused GROUP BY query_id, match_type"),
        "hybrid_blank_query": (
            lambda s, sf: searching.hybrid(units_docs(s, sf), [(q, "   ") for q in VECTORS], _query_vectors(s, sf), SearchConfig(limit=5)).select("query_id", "rowid", "match_type", "rk"),
            SQL_VECTOR + f"SELECT query_id, rowid, 'vector' AS match_type, rk FROM ({_sql_top('cosines', 'score DESC, rowid', 5)})",
        ),
        "search_result_shaping": (
            _q_shaping,
            f"WITH {_sql_hits()}, best AS ({_sql_top('ordered', 'combined DESC, ' + _ORDER, 30)}), scaled AS (SELECT * EXCLUDE (rk), round(combined / max(combined) OVER (PARTITION BY query_id), 6) AS score FROM best), kept AS (SELECT * FROM scaled WHERE score >= 0.3) "
            f"SELECT query_id, rk, rowid, file_path AS path, line_start AS line, md5({_SNIPPET}) AS snippet_md5, score, match_type FROM ({_sql_top('kept', 'score DESC, ' + _ORDER, 8)})",
        ),
        "mode_lexical_only": (lambda s, sf: _q_mode(s, sf, True), _sql_mode(True)),
        "mode_vector_only": (lambda s, sf: _q_mode(s, sf, False), _sql_mode(False)),
        "repomap_modules": (_q_map, _sql_map()),
        "repomap_filter_prefix": (lambda s, sf: _q_map(s, sf, "spam-farm.example.org"), _sql_map("file_path = 'spam-farm.example.org' OR starts_with(file_path, 'spam-farm.example.org/')")),
        "repomap_dependency_hints": (_q_hints, SQL_HINTS),
        "symbol_locations": (lambda s, sf: repomap.symbol_locations(repomap.located(units_symbols(s, sf), "pages")), f"WITH {_sql_located()} SELECT DISTINCT name, module, label FROM located"),
        "upsert_code_units": (_q_upsert, f"WITH {SQL_DOCS}, {SQL_NEW}, {_sql_upsert('units')} SELECT {SQL_SHOWN} FROM merged"),
        "replace_branch": (
            lambda s, sf: _shown(changes.replace_branch(units_docs(s, sf), units_docs(s, sf).where("branch = 'fr' and rowid % 2 = 0"), "docs", "fr")),
            f"WITH {SQL_DOCS} SELECT {SQL_SHOWN} FROM units WHERE branch <> 'fr' OR rowid % 2 = 0",
        ),
        "delete_by_file": (lambda s, sf: _shown(changes.delete_files(units_docs(s, sf), _deleted(units_docs(s, sf)))), f"WITH {SQL_DOCS}, {_KEPT} SELECT {SQL_SHOWN} FROM kept"),
        "incremental_apply": (_q_incremental, f"WITH {SQL_DOCS}, {_KEPT}, {SQL_NEW}, {_sql_upsert('kept')} SELECT {SQL_SHOWN} FROM merged"),
        "incremental_file_records": (
            _q_incremental_files,
            f"WITH {SQL_DOCS}, {_KEPT}, {SQL_NEW}, nf AS (SELECT branch, file_path, min(file_hash) AS file_hash, count(*)::INTEGER AS chunk_count FROM fresh GROUP BY ALL), kf AS (SELECT branch, file_path, min(file_hash) AS file_hash, count(*)::INTEGER AS chunk_count FROM kept GROUP BY ALL) "
            "SELECT * FROM nf UNION ALL SELECT * FROM kf WHERE (branch, file_path) NOT IN (SELECT (branch, file_path) FROM nf)",
        ),
        "changeset_hash_diff": (lambda s, sf: changes.hash_diff(*_second_version(s, sf)), f"WITH {SQL_DIFF} SELECT path, change_type FROM diff WHERE change_type IS NOT NULL"),
        "changeset_counts": (
            lambda s, sf: changes.hash_diff(*_second_version(s, sf)).groupBy("change_type").agg(F.count(F.lit(1)).alias("n")),
            f"WITH {SQL_DIFF} SELECT change_type, count(*) AS n FROM diff WHERE change_type IS NOT NULL GROUP BY change_type",
        ),
        "pending_embeddings": (
            lambda s, sf: changes.pending_embeddings(units_docs(s, sf), MODEL).select("rowid", "id", F.md5(F.col("embedding_text").cast("binary")).alias("text_md5")),
            f"WITH {SQL_DOCS} SELECT rowid, id, md5(signature || ' ' || content) AS text_md5 FROM units WHERE embedding IS NULL OR embedding_model <> '{MODEL}'",
        ),
        "update_embeddings": (
            _q_update_embeddings,
            f"WITH {SQL_DOCS}, set_ AS (SELECT * REPLACE (CASE WHEN embedding IS NULL AND rowid % 2 = 1 THEN [rowid::FLOAT] ELSE embedding END AS embedding, CASE WHEN embedding IS NULL AND rowid % 2 = 1 THEN 'other' ELSE embedding_model END AS embedding_model) FROM units) SELECT {SQL_SHOWN} FROM set_",
        ),
        "has_symbols": (
            lambda s, sf: units_docs(s, sf).groupBy("branch").agg(F.count(F.lit(1)).alias("n")).select("branch", (F.col("n") > 0).alias("has_symbols")),
            f"WITH {SQL_DOCS} SELECT branch, count(*) > 0 AS has_symbols FROM units GROUP BY branch",
        ),
        "has_symbols_probe": (
            _q_probe,
            f"SELECT branch, branch IN (SELECT lang FROM documents) AS has_symbols FROM (VALUES {', '.join(f'({b!r})' for b in PROBED)}) t(branch)",
        ),
        "list_branches": (lambda s, sf: units_docs(s, sf).select("repo_id", "branch").distinct(), f"WITH {SQL_DOCS} SELECT DISTINCT repo_id, branch FROM units"),
        "all_symbols": (
            lambda s, sf: units_docs(s, sf).where("branch = 'de'").select("file_path", "line_start", "name", "kind", "signature").orderBy("file_path", "line_start", "name"),
            f"WITH {SQL_DOCS} SELECT file_path, line_start, name, kind, signature FROM units WHERE branch = 'de'",
        ),
        "index_stats_by_language": (
            lambda s, sf: changes.language_counts(units_docs(s, sf).withColumn("language", F.col("branch"))),
            "SELECT lang AS language, count(*) AS n_symbols, count(DISTINCT source || '/' || doc_id::VARCHAR) AS n_files FROM documents GROUP BY lang",
        ),
        "index_stats": (
            lambda s, sf: changes.index_stats(_file_records(units_docs(s, sf))),
            f"WITH {SQL_DOCS} SELECT repo_id, branch, count(DISTINCT file_path) AS file_count, count(*)::BIGINT AS symbol_count FROM units GROUP BY repo_id, branch",
        ),
        "content_hash_dedup": (
            lambda s, sf: _table(s, sf, "documents").groupBy(ids.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")),
            "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
        ),
        "code_unit_ids": (lambda s, sf: units_pages(s, sf).select("rowid", "id"), f"WITH {SQL_PAGES} SELECT rowid, id FROM units"),
        "language_from_path": (
            _q_paths,
            f"WITH {SQL_PAGES} SELECT rowid AS page_id, CASE rowid % 6 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'csharp' END AS language, rowid % 7 = 0 AS excluded FROM units",
        ),
        "size_and_binary_filter": (_q_sizes, "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents WHERE doc_id % 9 <> 0 AND strlen(text) <= 8000"),
        "staleness_check": (
            _q_stale,
            f"WITH last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, CASE WHEN event_type IN ('error', 'signup') THEN true WHEN TIMESTAMP '{NOW}' - ts < INTERVAL 1440 MINUTE THEN false "
            "ELSE coalesce(CASE WHEN event_id % 3 <> 0 THEN md5(user_id::VARCHAR) END <> CASE WHEN event_id % 4 <> 0 THEN md5(event_type) END, false) END AS stale FROM last",
        ),
        "extract_rust": (_q_extract("rust"), _sql_extract("rust")),
        "extract_ts": (_q_extract("typescript"), _sql_extract("typescript")),
        "extract_csharp": (_q_extract("csharp"), _sql_extract("csharp")),
        "fake_embedder": (_q_sketch, "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, contains(text, 'pub')::BIGINT AS has_pub FROM documents"),
        "stream_ingest_foreachbatch": (_q_stream, "SELECT count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_hashes FROM documents"),
        "event_windows": (_q_events, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    }


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
