"""Operators on small frames: search semantics, fusion, shaping, upserts, vectors, text."""

from __future__ import annotations

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import ids, paths, text, vectors
from glyphmill.functions.embed import OnnxEmbedder, SketchEmbedder, with_embedding
from glyphmill.functions.extract import extract
from glyphmill.operators import changes, fusion, lexical, similarity
from glyphmill.operators.extraction import extract_rows
from glyphmill.plans.search import search, search_many
from glyphmill.schema import CODE_UNITS, EmbeddingError, SearchConfig
from glyphmill.sources.store import Store


def unit(rowid, name, content="", doc=None, embedding=None, branch="main", path=None, model="", line=1, signature=None):
    embedding = None if embedding is None else [float(x) for x in embedding]
    signature = f"pub fn {name}()" if signature is None else signature
    return (rowid, f"id{rowid}", "repo", branch, path or f"src/{name}.rs", name, "function", signature, doc, content, None, "rust", line, line + 2, embedding, model, "h")


def frame(spark, rows):
    return spark.createDataFrame(rows, CODE_UNITS)


CORPUS = [
    unit(1, "token_refresh", "refreshes the token", "Documentation for token_refresh"), unit(2, "other", "calls token_refresh now", None), unit(3, "supports", "supported languages (supported)", "is it supported?"),
    unit(4, "naïve", "Élan vital", None), unit(5, "empty", "", None), unit(6, "token", "refresh the token and token again", "token refresh"), unit(7, "far", "refresh then token", None, branch="side"),
]


@pytest.mark.parametrize("query", ["token_refresh", "token refresh", "supported?", "languages (supported)", '"supported"', "elan", "NAIVE", "the token", "?? token", "nothing_here"])
def test_lexical_equals_sqlite(spark, query):
    """The same hits, order and scores as SQLite's own full-text index."""
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(name, signature, doc, content)")
    base.executemany("INSERT INTO t(rowid, name, signature, doc, content) VALUES (?, ?, ?, ?, ?)", [(u[0], u[5], u[7], u[8] or "", u[9]) for u in CORPUS])
    want = base.execute("SELECT rowid, bm25(t, 6, 3, 2, 1) AS s FROM t WHERE t MATCH ? ORDER BY s, rowid", (text.sanitized(query),)).fetchall()
    got = lexical.search_fts(frame(spark, CORPUS), [(0, query)], 10).orderBy("rk").collect()
    assert [r["rowid"] for r in got] == [w[0] for w in want]
    assert all(math.isclose(r["bm25"], w[1], abs_tol=1e-6) for r, w in zip(got, want))


def test_sanitizer():
    assert text.sanitized('say "hello"') == '"say" """hello"""' and text.sanitized(" \t ") is None
    assert text.query_phrases("foo* (bar) -baz ??") == [["foo"], ["bar"], ["baz"]] and text.query_phrases("a_b") == [["a", "b"]]


def test_vector_search_and_errors(spark):
    rows = frame(spark, [unit(1, "alpha", embedding=[1.0, 0, 0, 0]), unit(2, "beta", embedding=[0.0, 1, 0, 0]), unit(3, "gamma", embedding=[0.8, 0.2, 0, 0]), unit(4, "none")])
    queries = similarity.query_vectors(spark, [(0, [1.0, 0, 0, 0])])
    assert [r["rowid"] for r in similarity.search_vector(rows, queries, 3).orderBy("rk").collect()] == [1, 3, 2]
    assert similarity.search_vector(rows, queries, 0).count() == 0
    near = similarity.search_vector_buckets(rows, queries, 2, 4, bits=2, tables=8).orderBy("rk").collect()
    assert near[0]["rowid"] == 1
    with pytest.raises(Exception, match="dimension mismatch"):
        similarity.search_vector(rows, similarity.query_vectors(spark, [(0, [1.0])]), 3).collect()


def test_vector_functions():
    assert vectors.decode_embedding(vectors.encode_embedding([1, 2.5, -3, 4.25])) == [1, 2.5, -3, 4.25]
    for bad in (lambda: vectors.encode_embedding([]), lambda: vectors.decode_embedding(b"abc")):
        with pytest.raises(EmbeddingError):
            bad()
    pooled = vectors.mean_pool(np.array([[3.0, 4.0], [9.0, 9.0]]), np.array([1, 0]))
    assert np.allclose(pooled, [0.6, 0.8]) and not vectors.mean_pool(np.ones((2, 2)), np.zeros(2)).any()


HYBRID = [
    unit(1, "authenticate_user", "authenticate user by password", embedding=[1.0, 0, 0, 0]), unit(2, "lexical", "authenticate user in text", embedding=[0.0, 1, 0, 0]), unit(3, "nearby", "nothing alike", embedding=[0.95, 0.05, 0, 0]),
]


class Fixed:
    dimension, model_name = 4, "fixed"

    def embed_batch(self, texts):
        return [[1.0, 0.0, 0.0, 0.0] for _ in texts]


class Broken(Fixed):
    def embed_batch(self, texts):
        raise RuntimeError("no model")


def test_hybrid_order_and_modes(spark):
    rows = frame(spark, HYBRID)
    got = search(rows, "authenticate user", SearchConfig(limit=3), Fixed()).collect()
    assert [r["rowid"] for r in got][0] == 1 and got[0]["match_type"] == "hybrid" and got[0]["score"] == 1.0 and got[1]["score"] < 1
    assert {r["match_type"] for r in search(rows, "   ", SearchConfig(limit=3), Fixed()).collect()} == {"vector"}
    assert {r["match_type"] for r in search(rows, "authenticate", SearchConfig(), Broken()).collect()} == {"fts"}
    assert {r["match_type"] for r in search(rows, "authenticate", SearchConfig()).collect()} == {"fts"}
    for config in (SearchConfig(limit=0), SearchConfig(use_fts=False, use_vector=False), SearchConfig(use_fts=False)):
        assert search(rows, "authenticate", config, Broken()).count() == 0
    assert [r["rowid"] for r in search(rows, "authenticate", SearchConfig(limit=1, min_score=0.99), Fixed()).collect()] == [1]
    both = search_many(rows, [(1, "authenticate"), (2, "alike")], SearchConfig(limit=2), Fixed()).collect()
    assert {r["query_id"] for r in both} == {1, 2}


def test_normalization_of_negative_scores(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, -0.5)], "id int, s double")
    assert [r[0] for r in rows.select(fusion.normalized(F.col("s"), F.lit(0.5))).collect()] == [1.0, -1.0]
    assert [r[0] for r in rows.select(fusion.normalized(F.col("s"), F.lit(-0.5))).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("changed", [False, True])
@pytest.mark.parametrize("given", [False, True])
@pytest.mark.parametrize("had", [False, True])
def test_upsert_table(spark, changed, given, had):
    old = frame(spark, [unit(1, "a", "x", embedding=[1.0] if had else None, model="m" if had else "")])
    new = frame(spark, [unit(9, "a", "y" if changed else "x", embedding=[2.0] if given else None), unit(10, "b", "z", embedding=[3.0] if given else None)])
    first, second = sorted(changes.upsert_units(old, new).collect(), key=lambda r: r["name"])
    kept = ([1.0], "m") if had else (None, "")
    assert (first["embedding"], first["embedding_model"]) == ((None, "") if changed else ([2.0], "unknown") if given else kept)
    assert (second["embedding"], second["embedding_model"]) == (([3.0], "unknown") if given else (None, ""))
    assert first["rowid"] == 1 and first["content"] == ("y" if changed else "x")


def test_pending_and_embedding_text(spark):
    rows = frame(spark, [unit(1, "a", "x", "doc", [1.0], model="unknown"), unit(2, "b", "y", "", [1.0], model="m"), unit(3, "c", "z")])
    assert {r["rowid"]: r["embedding_text"] for r in changes.pending_embeddings(rows, "m").collect()} == {1: "pub fn a() doc x", 3: "pub fn c() z"}
    made = with_embedding(spark.createDataFrame([("pub é\n",)], "t string"), SketchEmbedder(), F.col("t")).first()["embedding"]
    assert made == [7.0, float(sum("pub é\n".encode())), 1.0, 1.0]


def test_snippet_and_paths(spark):
    contents = ["", "one", "a\nb\n", "\n".join("abcdefghij"), "a\r\nb", "\n"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k int, c string")
    got = [r[0] for r in rows.orderBy("k").select(text.snippet(F.col("c"))).collect()]
    assert got == ["", "one", "a\nb", "a\nb\nc\nd\ne\nf\ng", "a\nb", ""]
    p = spark.createDataFrame([("lib.rs",), ("a/b/x.tsx",), ("a.b/Makefile",), ("x.d.ts",)], "p string")
    assert [tuple(r) for r in p.select(paths.language_of(F.col("p")), paths.module_path(F.col("p")), paths.module_name(paths.module_path(F.col("p")), "root")).collect()] == [("rust", ".", "root"), ("typescript", "a/b", "b"), (None, "a.b", "a.b"), ("typescript", ".", "root")]
    assert paths.normalized_filter(" /src\\x/ ") == "src/x" and paths.normalized_filter(" . ") is None
    assert ids.path_segment("--my repo!") == "my-repo" and ids.path_segment("??") == "repo"
    raw = spark.createDataFrame([(bytearray(b"\x10\x01"),), (bytearray(b"a\0"),), (bytearray(b"a" * 9000 + b"\0"),)], "c binary")
    assert [r[0] for r in raw.select(paths.has_nul(F.col("c"))).collect()] == [False, True, False]


def test_hash_diff(spark):
    now, before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string"), spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, hash string")
    assert sorted(map(tuple, changes.hash_diff(now, before).collect())) == [("a", "added"), ("c", "modified"), ("d", "deleted")]


def test_store_isolates_branches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.migrate() == [1, 2] and store.migrate() == [1, 2]
    empty = spark.createDataFrame([], "repo_id string, branch string, file_path string, file_hash string, chunk_count int, indexed_at timestamp")
    for branch in ("main", "fix/one"):
        store.replace_branch("repo", branch, frame(spark, [unit(1, "a", branch, branch=branch)]), empty, store.metadata_frame("repo", branch))
    store.upsert_units("repo", "main", frame(spark, [unit(2, "b", "new")]))
    assert store.units("repo", "main").count() == 2 and store.units("repo", "fix/one").count() == 1 and store.units().count() == 3
    assert store.branches("repo") == ["fix/one", "main"] and store.has_symbols("repo", "main")
    store.update_embeddings("repo", "main", spark.createDataFrame([("id1", [1.0, 2.0])], "id string, embedding array<float>"), "m")
    assert store.pending("repo", "main", "m").count() == 1
    store.set_status("repo", "main", "failed", "why")
    assert store.metadata_row("repo", "main")["last_error"] == "why"
    store.set_status("repo", "main", "ready")
    row = store.metadata_row("repo", "main")
    assert row["last_error"] is None and row["last_indexed_at"] is not None
    store.delete_branch("repo", "main")
    assert store.branches("repo") == ["fix/one"] and not store.has_symbols("repo", "main") and store.vacuum() >= 0
    assert store.units("repo", "fix/one").count() == 1


RUST = '''//! Crate.
/* outer /* inner */ pub fn ghost() {} */
#[derive(Debug)]
pub struct Tuple(u8, String);
pub(crate) struct Inner { x: u8 }
pub struct Gen<'a, T: Into<u8>> where T: Copy { s: &'a str, c: [T; 2] }

impl<'a, T: Into<u8>> Gen<'a, T> where T: Copy {
    /// Text with { braces.
    fn quoted(&self) -> &str { r#"}" {"# }
    pub async fn chars(&self) -> char { '{' }
}
impl fmt::Display for Tuple { fn fmt(&self) -> impl Sized { "\\"}" } }
mod deep { pub fn nested() -> [u8; 4] { [0; 4] } fn p() { pub enum Local { A } } }
pub trait T { const N: u8; fn need(&self); fn given(&self) {} }
pub const fn k() -> u8 { 1 }
pub fn broken() {
'''
TS = '''/**
 * Client docs.
 */
export default class Client<T> extends Base {
  static count = 0;
  private hidden(): void { const s = "}"; }
  protected alike() {}
  #secret() {}
  get size(): number { return `${this.a ? "{" : `}`}`.length; }
  async *walk(a: { b: number }): AsyncGenerator<{ x: 1 }> { yield /[}]/ as any; }
  shape(): { w: number } { return { w: 1 }; }
  arrow = () => { return 1; };
  over(x: string): void;
  over(x: any) {}
}
export type Union =
  | "a"
  | "b";
export type Obj = { a: number };
export enum E { A }
export const c = 1;
export abstract class Abs {}
class Own { run() {} }
export async function go(f: (x: number) => void = () => {}): Promise<void> {}
'''
CS = '''using System;
namespace N {
  class Hidden { public class Shown { public void M() {} } }
  public struct S { public void Not() {} public enum Deep { A } }
  /// <summary>Things.</summary>
  public sealed class C<T> : Base where T : class {
    public const int K = 1;
    public event Action E;
    public C(int x) : base(x) {}
    public string this[int i] { get { return "}"; } }
    public List<int> P { get; } = new();
    public int Q => 3;
    public override string ToString() => $"{P}}}";
    public T Get<U>(U u) where U : new() { return @"""}"; }
    internal void No() {}
    public class Nested { public void X() {} }
    public enum State { On }
  }
}
'''


@pytest.mark.parametrize(("language", "source", "want"), [
    ("rust", RUST, ["Tuple:struct", "Gen:struct", "quoted:method", "chars:method", "fmt:method", "nested:function", "Local:enum", "T:trait", "need:method", "k:function"]),
    ("typescript", TS, ["Client:class", "#secret:method", "size:method", "walk:method", "shape:method", "over:method", "Union:constant", "Obj:constant", "go:function"]),
    ("csharp", CS, ["Shown:class", "M:method", "Deep:enum", "C:class", "P:constant", "Q:constant", "ToString:method", "Get:method", "State:enum"]),
])
def test_extraction_edge_cases(language, source, want):
    found = extract(source.encode(), language)
    assert [f"{u.name}:{u.kind}" for u in found] == want
    by_name = {u.name: u for u in found}
    if language == "rust":
        assert by_name["quoted"].parent == "Gen<'a, T>" and by_name["fmt"].parent == "Tuple" and by_name["quoted"].doc == "Text with { braces."
        assert by_name["Tuple"].signature == "pub struct Tuple(u8, String)" and by_name["need"].signature == "fn need(&self)"
    if language == "typescript":
        assert by_name["Client"].doc == "Client docs." and by_name["Union"].signature == "type Union" and by_name["go"].signature == "async function go(f: (x: number) => void = () =>"
    if language == "csharp":
        assert by_name["C"].doc == "Things." and by_name["Q"].signature == "public int Q"


def test_extraction_quarantines_bad_files(spark):
    rows = spark.createDataFrame([("ok.rs", "rust", bytearray(b"pub fn a() {}")), ("bad.rs", "rust", bytearray(b"\xff")), ("none.rs", "rust", None)], "file_path string, language string, content binary")
    got = {(r["file_path"], r["name"], r["error"] is None) for r in extract_rows(rows).collect()}
    assert got == {("ok.rs", "a", True), ("bad.rs", None, False)}


def test_many_query_vectors_are_searched_in_blocks(spark, monkeypatch):
    from glyphmill.operators import similarity

    units = spark.createDataFrame([(k, f"n{k}", [float(k % 7), float(k % 5), 1.0]) for k in range(30)] + [(99, "none", None)], "rowid long, name string, embedding array<float>")
    queries = similarity.query_vectors(spark, [(q, [float(q), 1.0, 2.0]) for q in range(11)])
    want = sorted(map(tuple, similarity.search_vector(units, queries, 4).collect()))
    monkeypatch.setattr(similarity, "BROADCAST_QUERIES", 4)
    assert sorted(map(tuple, similarity.search_vector(units, queries, 4).collect())) == want and len(want) == 44


def test_stored_index_equals_search_of_texts(spark):
    rows = frame(spark, CORPUS)
    queries = [(k, q) for k, q in enumerate(["token_refresh", "token refresh", "supported?", "elan", "nothing_here", "the token"])]
    index = lexical.build_index(rows)
    want = sorted(map(tuple, lexical.search_fts(rows, queries, 10).collect()))
    assert sorted(map(tuple, lexical.search_index(index, queries, 10).collect())) == want != []
    side = lexical.search_index(index, queries, 10, rows.where("branch = 'side'")).collect()
    assert sorted(map(tuple, side)) == sorted(map(tuple, lexical.search_fts(rows, queries, 10, F.col("branch") == "side").collect()))
    plan = lexical.search_fts(rows, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition" in plan and "count(1) windowspecdefinition" not in plan


@pytest.mark.parametrize("clustered", [True, False])
def test_vector_index_recall(spark, clustered):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 32))
    points = rng.normal(size=(1500, 32)) * (0.4 if clustered else 1) + (centers[rng.integers(0, 20, 1500)] if clustered else 0)
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(9999, None)], "rowid long, embedding array<float>")
    queries = rows.where("rowid % 50 = 0").selectExpr("rowid as query_id", "embedding as query_vector")
    index = similarity.VectorIndex.fit(rows)
    assert index.assign(rows).count() == 1500 and (index.probes < len(index.centers) or not clustered)
    exact = {(r["query_id"], r["rowid"]) for r in similarity.search_vector(rows, queries, 10).collect()}
    found = {(r["query_id"], r["rowid"]) for r in index.search(index.assign(rows), queries, 10).collect()}
    assert len(exact) == 300 and len(exact & found) / len(exact) >= 0.9
    assert similarity.VectorIndex.fit(rows.limit(0)).assign(rows.limit(0)).count() == 0


def test_vector_index_search_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 8)).astype(np.float32)
    points[100:160], points[160] = points[7], 0
    odd = [(900, None), (901, [float("nan")] * 8), (902, [float("inf")] * 8)]
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + odd, "rowid long, embedding array<float>")
    queries = rows.where("rowid % 20 = 0 or rowid in (7, 160, 901)").selectExpr("rowid as query_id", "embedding as query_vector")
    index = similarity.VectorIndex.fit(rows, most_lists=6)
    assigned = index.assign(rows)
    unit = points / np.maximum(np.sqrt((points.astype(float) ** 2).sum(axis=1, keepdims=True)), 1e-30)
    of = (unit @ index.centers.T).argmax(axis=1)
    want = set()
    for q in sorted({*range(0, 400, 20), 7, 160}):
        near = np.argsort(-(unit[q] @ index.centers.T), kind="stable")[:2]
        found = sorted((-round(float(unit[r] @ unit[q]), 6) + 0.0, r) for r in range(400) if of[r] in near)[:5]
        want |= {(q, r, rk) for rk, (_, r) in enumerate(found, 1)}
    got = lambda: {(r["query_id"], r["rowid"], r["rk"]) for r in index.search(assigned, queries, 5, probes=2).collect()}
    assert got() == want
    monkeypatch.setattr(similarity, "INDEX_QUERIES", 6)
    monkeypatch.setattr(similarity, "PRODUCT", 50)
    found = index.search(assigned, queries, 5, probes=2)
    # A join of rows and queries would make a row of every pair: too many of them for a larger table.
    assert got() == want and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert index.search(assigned, queries.limit(0), 5).count() == index.search(assigned, queries, 0).count() == 0


def test_vector_index_sample_is_bounded_before_its_sort(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as rowid", "array(cast(id as float)) as embedding")
    monkeypatch.setattr(similarity, "INDEX_SAMPLE", 100)
    want = rows.orderBy(F.xxhash64("rowid"), "rowid").limit(100).collect()
    assert similarity._sampled(rows).column("rowid").to_pylist() == [r["rowid"] for r in want]


def test_publishing_is_exclusive(spark, tmp_path):
    first, second = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    first.migrate()
    path = f"{first.base}/_manifests/7.json"
    assert first._claim(f"{path}.claim") and not second._claim(f"{path}.claim") and not second._write_new(path, {})
    assert [r["version"] for r in first.migrations().orderBy("version").collect()] == [1, 2]
    files = spark.createDataFrame([("repo", "main", p, "h", 1, None) for p in ("b", "a", "c")], "repo_id string, branch string, file_path string, file_hash string, chunk_count int, indexed_at timestamp")
    other = Store(spark, str(tmp_path / "t"))
    other.replace_branch("repo", "main", frame(spark, CORPUS[:6]), files, other.metadata_frame("repo", "main"))
    assert [r["file_path"] for r in other.indexed_files("repo", "main").collect()] == ["a", "b", "c"]
    before = other._current()[1]["branches"]
    other.set_status("repo", "main", "failed", "x")
    other.update_embeddings("repo", "main", spark.createDataFrame([("id1", [1.0])], "id string, embedding array<float>"), "m")
    (old,), (new,) = before.values(), other._current()[1]["branches"].values()
    # Only the changed tables have new versions, and the index stays while the texts do.
    assert [n for n in old if old[n] != new[n]] == ["code_units", "index_metadata"]
    queries = [(0, "token")]
    assert sorted(map(tuple, lexical.search_index(other.index(), queries, 10).collect())) == sorted(map(tuple, lexical.search_fts(other.units(), queries, 10).collect()))
    assert other.vacuum() == 0 and other.vacuum(young=0) == 0
    other._write(f"{other.base}/data/repo/main/unpublished", {"code_units": frame(spark, CORPUS[:1])})
    assert other.vacuum() == 0 and other.vacuum(young=0) == 1


def test_parsed_timestamps(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250+02:00", "2024-01-02t03:04:05z", "2024-13-02T03:04:05Z", "yesterday", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in rows.orderBy("k").select(F.unix_millis(text.parse_timestamp(F.col("t")))).collect()]
    assert got == [1704164645000, 1704157445250, 1704164645000, None, None, None]


def test_macro_bodies_hold_no_items():
    source = "macro_rules! make { ($x:ident) => { pub fn inside() {} } }\nthread_local! { pub static A: u8 = 1; }\nlazy! [ pub struct No; ];\nfn f() { if a != (b) { g!(pub fn no() {}) } }\npub fn after() { let v = vec![1, 2]; }\n"
    assert [u.name for u in extract(source.encode(), "rust")] == ["after"]


def _field(number: int, value: int | bytes | str) -> bytes:
    """One field of a protobuf message: a number, or the bytes of a text or of another message."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def _lookup_model(vectors: np.ndarray) -> bytes:
    """An ONNX model of one step: input_ids (int64, texts by tokens) to their rows of ``vectors``."""

    def value(name, kind, dims):
        shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    weights = b"".join(_field(1, n) for n in vectors.shape) + _field(2, 1) + _field(8, "vectors") + _field(9, vectors.astype("<f4").tobytes())
    node = _field(1, "vectors") + _field(1, "input_ids") + _field(2, "out") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "lookup") + _field(5, weights) + _field(11, value("input_ids", 7, ["texts", "tokens"])) + _field(12, value("out", 1, ["texts", "tokens", vectors.shape[1]]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_onnx_embedder_runs_a_local_model(spark, tmp_path):
    """Means of the token vectors under the mask, of length 1; long texts are cut at max_tokens, texts without tokens give zeros."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = np.random.default_rng(2).normal(size=(4, 3)).astype(np.float32)
    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "c": 3}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(f"{tmp_path}/tokenizer.json")
    (tmp_path / "model.onnx").write_bytes(_lookup_model(table))
    embedder = OnnxEmbedder(f"{tmp_path}/model.onnx", f"{tmp_path}/tokenizer.json", dimension=3, max_tokens=4)
    cases = {"a b": [1, 2], "c": [3], "a a b zz c c c": [1, 1, 2, 0], "": []}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").repartition(2)
    for text_, vector in with_embedding(rows, embedder, F.col("text")).collect():
        mean = table[cases[text_]].astype(float).mean(axis=0) if cases[text_] else np.zeros(3)
        assert vector == pytest.approx((mean / (np.linalg.norm(mean) or 1)).tolist(), abs=1e-6)
    assert embedder.embed_batch(["", ""]) == [[0.0] * 3] * 2 and embedder.embed_batch([]) == []
