"""Every ``queries()`` entry for the graph and job operators, with its DuckDB counterpart.

The registered tables stand in for code tables: documents for files, parts for symbols, line items for
relationships, customers and orders for classes and methods, events for jobs and their logs. Each query builds those
views and applies the operators of ``codeloom.operators`` and ``codeloom.functions`` to whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import chunks, vectors
from codeloom.functions import identity as ident
from codeloom.operators import graph, jobs, ranking
from codeloom.plans import made_code
from codeloom.schemas import JOBS, extraction
from codeloom.session import shared_folder, stored, table
from codeloom.storage.snapshot import SnapshotStore
from codeloom.storage.vector_index import VectorIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# ---------------------------------------------------------------- views


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a path whose extension, directories and suffix vary with the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".ts", ".TSX", ".go", ".md", "_test.go", ".d.ts")]), (F.col("doc_id") % 7 + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("src", "node_modules", "lib/dist", "pkg.egg-info", ".git/x")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", "text", F.concat(top, F.lit("/"), "source", F.lit("/f"), F.col("doc_id"), ext).alias("path"))


_PATHS_SQL = """paths AS (SELECT doc_id, text, (['src','node_modules','lib/dist','pkg.egg-info','.git/x'])[(doc_id % 5 + 1)::INT] || '/' || source || '/f' || doc_id
 || (['.py','.ts','.TSX','.go','.md','_test.go','.d.ts'])[(doc_id % 7 + 1)::INT] AS path FROM documents)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("function", "method", "class", "variable", "module")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("n"), F.col("p_partkey"))
    path = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/f"), F.col("p_size"), F.lit(".py"))
    with_kind = p.select("*", kind.alias("kind"), name.alias("name"), path.alias("file_path"))
    return with_kind.withColumn("id", ident.moniker(F.lit("python"), F.lit("tpch"), "file_path", ident.descriptor("kind", "name", F.concat(F.lit("C"), F.col("p_size")))))


_SYMBOLS_SQL = """s0 AS (SELECT *, (['function','method','class','variable','module'])[(p_partkey % 5 + 1)::INT] AS kind, 'n' || p_partkey AS name,
 'src/' || replace(p_brand, '#', '_') || '/f' || p_size || '.py' AS file_path FROM part),
symbols AS (SELECT *, 'loom python tpch ' || replace(file_path, ' ', '%20') || ' ' || CASE kind WHEN 'method' THEN 'C' || p_size || '#' || name || '().' WHEN 'function' THEN name || '().'
 WHEN 'class' THEN name || '#' WHEN 'variable' THEN name || '.' ELSE name || '/' END AS id FROM s0)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished, running and queued jobs."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for x in ("view", "succeeded", "click", "queued", "signup", "running", "purchase", "cancelled", "error", "failed")])
    return e.select(
        F.concat(F.lit("j"), F.col("event_id")).alias("id"), F.concat(F.lit("https://git.example/u/r"), F.col("user_id") % 50, F.lit(".git")).alias("repo_url"), F.element_at(status, F.col("event_type")).alias("status"),
        F.get_json_object("props", "$.k").cast("long").alias("embedding_total_tokens"), F.round("value", 4).alias("embedding_estimated_cost_usd"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "props", "ts", "event_id", "user_id",
    )


_JOBS_SQL = """jobs AS (SELECT 'j' || event_id AS id, 'https://git.example/u/r' || (user_id % 50) || '.git' AS repo_url,
 CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'cancelled' WHEN 'error' THEN 'failed' END AS status,
 json_extract_string(props, '$.k')::BIGINT AS embedding_total_tokens, round(value, 4) AS embedding_estimated_cost_usd, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, props, ts, event_id, user_id FROM events)"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines of one job per user."""
    e = table(spark, sf_dir, "events")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("ValueError: code "), F.col("event_id")))
        .when(F.col("event_type") == "click", F.concat(F.lit('  File "x.py", line '), F.col("event_id")))
        .when(F.col("event_type") == "signup", F.lit("   "))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("tokens: "), F.col("event_id"), F.lit(" cost: $"), (F.col("event_id") % 97).cast("string"), F.lit(".5")))
        .otherwise(F.lit("Traceback (most recent call last):"))
    )
    source = F.when(F.col("event_type") == "purchase", "stdout").otherwise("stderr")
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("job_id"), F.col("event_id").alias("seq"), source.alias("source"), line.alias("line"))


_LOGS_SQL = """logs AS (SELECT 'u' || user_id AS job_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'stdout' ELSE 'stderr' END AS source,
 CASE event_type WHEN 'error' THEN 'ValueError: code ' || event_id WHEN 'click' THEN '  File "x.py", line ' || event_id WHEN 'signup' THEN '   '
 WHEN 'purchase' THEN 'tokens: ' || event_id || ' cost: $' || (event_id % 97) || '.5' ELSE 'Traceback (most recent call last):' END AS line FROM events)"""


def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as part -> supplier relationships, a third unresolved, with some ends that do not exist."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("calls", "extends", "imports")]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("source_id"), kind.alias("kind"), (F.col("l_orderkey") % 3 != 0).alias("is_resolved"),
        F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.lit("s"), F.col("l_suppkey"))).alias("target_id"), F.concat(F.lit("t"), F.col("l_suppkey")).alias("target_name"), "l_orderkey", "l_linenumber", "l_quantity",
    )


_RELATIONSHIPS_SQL = """rels AS (SELECT 'p' || l_partkey AS source_id, (['calls','extends','imports'])[(l_linenumber % 3 + 1)::INT] AS kind, l_orderkey % 3 <> 0 AS is_resolved,
 CASE WHEN l_orderkey % 5 <> 0 THEN 's' || l_suppkey END AS target_id, 't' || l_suppkey AS target_name, l_orderkey, l_linenumber, l_quantity FROM lineitem)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and every supplier that is not divisible by four."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.lit("a").alias("repo_name"))
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 4 != 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit("b").alias("repo_name"))
    return parts.union(suppliers)


_NODES_SQL = """nodes AS (SELECT 'p' || p_partkey AS id, 'a' AS repo_name FROM part UNION ALL SELECT 's' || s_suppkey, 'b' FROM supplier WHERE s_suppkey % 4 <> 0)"""
_EDGES_SQL = """edges AS (SELECT DISTINCT source_id AS src, upper(kind) AS label, target_id AS dst FROM rels WHERE is_resolved AND target_id IS NOT NULL
 AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes))"""


# ---------------------------------------------------------------- identity


@query(
    "flagship",
    """WITH f AS (SELECT doc_id, 'loom python corpus src/' || source || '/' || doc_id || '.py src/' || source || '/' || doc_id || '/' AS moniker, 'sha256:' || sha256(text) AS body_hash FROM documents),
q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT moniker, body_hash, round(1 - list_inner_product(e, q) / sqrt(list_inner_product(e, e) * list_inner_product(q, q)), 6) AS dist FROM v JOIN f ON vec_id = doc_id, q ORDER BY dist, moniker LIMIT 10""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: module moniker and content hash of the ten nearest vectors to vector 0."""
    docs = table(spark, sf_dir, "documents")
    vecs = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id"), F.lit(".py"))
    named = docs.select("doc_id", path.alias("path")).withColumn("moniker", ident.moniker(ident.language_of("path"), F.lit("corpus"), "path", ident.descriptor(F.lit("module"), ident.module_path("path"))))
    asked = vecs.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = vecs.join(named, vecs.vec_id == named.doc_id).crossJoin(F.broadcast(asked.limit(1)))
    ten = near.select("doc_id", "moniker", F.round(vectors.cosine_distance("embedding", "q"), 6).alias("dist")).orderBy("dist", "moniker").limit(10)
    # Texts are read for the ten only, and none is shuffled.
    found = docs.select("doc_id", "text").join(F.broadcast(ten), "doc_id")
    return found.select("moniker", ident.content_hash("text").alias("body_hash"), "dist").orderBy("dist", "moniker").limit(10)


@query("moniker_build", f"WITH {_SYMBOLS_SQL} SELECT p_partkey, kind, id FROM symbols")
def moniker_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).select("p_partkey", "kind", "id")


@query("moniker_parse", f"WITH {_SYMBOLS_SQL} SELECT p_partkey, 'loom' AS scheme, 'python' AS language, 'tpch' AS repo_name, file_path, split_part(id, ' ', 5) AS descriptor FROM symbols")
def moniker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).select("p_partkey", ident.parse_strict("id").alias("m")).select("p_partkey", "m.*")


@query("descriptor_kind", f"WITH {_SYMBOLS_SQL} SELECT p_partkey, split_part(id, ' ', 5) AS descriptor, kind FROM symbols")
def descriptor_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _symbols(spark, sf_dir).select("p_partkey", ident.parse("id")["descriptor"].alias("descriptor"))
    return d.select("p_partkey", "descriptor", ident.descriptor_kind("descriptor").alias("kind"))


@query("moniker_valid", f"WITH {_SYMBOLS_SQL} SELECT p_partkey, p_partkey % 4 = 0 AS valid FROM symbols")
def moniker_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four monikers are spoilt: another scheme, no descriptor, an unknown end."""
    s = _symbols(spark, sf_dir)
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("id")).when(k == 1, F.concat(F.lit("x"), "id")).when(k == 2, F.regexp_replace("id", " [^ ]*$", "")).otherwise(F.concat("id", F.lit("!")))
    return s.select("p_partkey", ident.is_moniker(text).alias("valid"))


_URLS_SQL = """urls AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'git@git.example:org/r' || page_id || '.git' WHEN 1 THEN 'https://git.example/org/r.' || page_id || '/' WHEN 2 THEN ' ssh://git@git.example/org/r_' || page_id
 WHEN 3 THEN 'ftp://git.example/r' || page_id ELSE url END AS u FROM pages)"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("page_id") % 5, F.col("page_id")
    u = (
        F.when(k == 0, F.concat(F.lit("git@git.example:org/r"), i, F.lit(".git")))
        .when(k == 1, F.concat(F.lit("https://git.example/org/r."), i, F.lit("/")))
        .when(k == 2, F.concat(F.lit(" ssh://git@git.example/org/r_"), i))
        .when(k == 3, F.concat(F.lit("ftp://git.example/r"), i))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", u.alias("u"))


@query(
    "repo_name",
    f"""WITH {_URLS_SQL}, t AS (SELECT page_id, regexp_replace(trim(u), '/+$', '') AS b FROM urls),
c AS (SELECT page_id, CASE WHEN contains(b, ':') AND NOT regexp_matches(b, '^(https?|ssh)://') THEN regexp_replace(b, '^[^:]*:', '') ELSE regexp_replace(b, '^(ssh|https?)://', '') END AS b FROM t)
SELECT page_id, regexp_replace(CASE WHEN contains(b, '/') THEN string_split(regexp_replace(b, '^[^/]*/', ''), '/')[-1] ELSE b END, '\\.git$', '') AS name FROM c""",
)
def repo_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", ident.repo_name("u").alias("name"))


@query(
    "repo_slug",
    f"""WITH {_URLS_SQL} SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(string_split(regexp_replace(trim(u), '/+$', ''), '/')[-1], '\\.git$', ''), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), ''), 'repo') AS slug FROM urls""",
)
def repo_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", ident.repo_slug("u").alias("slug"))


@query("git_url_filter", f"WITH {_URLS_SQL} SELECT page_id, u FROM urls WHERE regexp_matches(trim(u), '^(https?|git|ssh)://.+') OR regexp_matches(trim(u), '^git@.+:.+\\.git$')")
def git_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).where(ident.is_git_url("u"))


@query(
    "lang_detect",
    f"""WITH {_PATHS_SQL} SELECT doc_id, path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' END AS language FROM paths""",
)
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", "path", ident.language_of("path").alias("language"))


@query(
    "path_exclude",
    f"""WITH {_PATHS_SQL} SELECT doc_id, path FROM paths WHERE NOT list_has_any(string_split(path, '/')[:-2], ['.git','__pycache__','.venv','venv','node_modules','.mypy_cache','.pytest_cache','dist','build','testdata'])
 AND len(list_filter(string_split(path, '/')[:-2], lambda d: ends_with(d, '.egg-info'))) = 0 AND NOT ends_with(path, '_test.go')""",
)
def path_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~ident.is_excluded("path")).select("doc_id", "path")


@query(
    "gitignore",
    f"""WITH {_PATHS_SQL} SELECT doc_id, path FROM paths WHERE NOT ((regexp_matches(path, '\\.md$') OR regexp_matches(path, '(^|/)node_modules/') OR regexp_matches(path, '^lib/dist/') OR regexp_matches(path, '^src/src3/f[0-9]+5\\.go$'))
 AND NOT regexp_matches(path, '(^|/)f[0-9]*0\\.md$') OR regexp_matches(path, '(^|/)node_modules/') OR regexp_matches(path, '^lib/dist/'))""",
)
def gitignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a root ignore file with a negation leaves."""
    from codeloom.sources.gitignore import Rules

    rules = Rules({"": ["*.md", "!f*0.md", "node_modules/", "/lib/dist", "/src/src3/f*5.go"]})
    return _paths(spark, sf_dir).where(~rules.column("path")).select("doc_id", "path")


@query("module_path", f"WITH {_PATHS_SQL} SELECT doc_id, regexp_replace(path, '\\.[^./]*$', '') AS module, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.') AS qualified FROM paths")
def module_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", ident.module_path("path").alias("module"), ident.module_name("path").alias("qualified"))


@query("bare_target", f"WITH {_SYMBOLS_SQL} SELECT p_partkey, rtrim(string_split(id, ' ')[-1], '().') AS target FROM symbols")
def bare_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).select("p_partkey", ident.bare_target("id").alias("target"))


_NAMES_SQL = """names AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '__' || p_partkey || '__' WHEN 1 THEN '_' || p_name WHEN 2 THEN upper(p_name) ELSE p_name END AS n FROM part)"""


@query(
    "name_predicates",
    f"""WITH {_NAMES_SQL} SELECT p_partkey, n, CASE WHEN starts_with(n, '__') AND ends_with(n, '__') THEN 'public' WHEN starts_with(n, '_') THEN 'private' ELSE 'public' END AS py_visibility,
 CASE WHEN regexp_matches(n, '^\\p{{Lu}}') THEN 'public' ELSE 'internal' END AS go_visibility, NOT starts_with(n, '_') OR ends_with(n, '__') AND starts_with(n, '__') AS exported, n = upper(n) AND n <> lower(n) AS constant FROM names""",
)
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("__"), F.col("p_partkey"), F.lit("__"))).when(k == 1, F.concat(F.lit("_"), n)).when(k == 2, F.upper(n)).otherwise(n)
    d = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return d.select("p_partkey", "n", ident.visibility("n").alias("py_visibility"), ident.visibility("n", "go").alias("go_visibility"), ident.is_exported("n").alias("exported"), ident.is_constant_name("n").alias("constant"))


@query("body_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS body_hash FROM documents")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ident.content_hash("text").alias("body_hash"))


@query("byte_slice", "SELECT doc_id, substr(text, (doc_id % 17 + 1)::INT, 40) AS piece FROM documents WHERE strlen(text) = length(text)")
def byte_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_only = table(spark, sf_dir, "documents").where(F.octet_length("text") == F.char_length("text"))
    start = F.col("doc_id") % 17
    return ascii_only.select("doc_id", ident.byte_slice("text", start, start + 40).alias("piece"))


@query("byte_slice_all")
def byte_slice_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same slice of every document. SQL slices characters, so ``byte_slice`` is bound to texts where both agree;
    tests hold this one against Python."""
    start = F.col("doc_id") % 17
    return table(spark, sf_dir, "documents").select("doc_id", ident.byte_slice("text", start, start + 40).alias("piece"))


# ---------------------------------------------------------------- projections and filters


@query("embeddable_filter", f"WITH {_SYMBOLS_SQL} SELECT id, kind FROM symbols WHERE kind IN ('function', 'class', 'method')")
def embeddable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.embeddable(_symbols(spark, sf_dir)).select("id", "kind")


@query(
    "graph_projection",
    f"""WITH {_SYMBOLS_SQL} SELECT id, kind, substr(repeat(p_type || '. ', 40), 1, 500) AS docstring, CASE WHEN kind = 'class' THEN p_brand || ', ' || p_type END AS base_classes,
 CASE WHEN p_size % 2 = 0 THEN 'def ' || name || '()' END AS signature, p_size AS line_start FROM symbols""",
)
def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    null = lambda t: F.lit(None).cast(t)
    wide = s.select(
        "id", "kind", "name", F.lit("q").alias("qualified_name"), "file_path", F.struct(F.col("p_size").alias("line_start"), F.col("p_size").alias("line_end")).alias("location"), null("string").alias("body_hash"),
        F.lit("python").alias("language"), ident.visibility("name").alias("visibility"), ident.is_exported("name").alias("is_exported"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("def "), "name", F.lit("()"))).otherwise("").alias("signature"), null("string").alias("return_type"),
        F.repeat(F.concat("p_type", F.lit(". ")), 40).alias("docstring"), null("boolean").alias("is_async"), null("int").alias("complexity"),
        F.when(F.col("kind") == "class", F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("base_classes"), null("boolean").alias("is_abstract"), null("string").alias("enclosing_class_id"),
        null("boolean").alias("is_static"), null("boolean").alias("is_constructor"), null("string").alias("receiver_kind"), null("string").alias("type_annotation"), null("boolean").alias("is_constant"), F.lit("tpch").alias("repo_name"),
    )
    return graph.node_properties(wide).select("id", "kind", "docstring", "base_classes", "signature", "line_start")


@query("edge_filter", f"WITH {_RELATIONSHIPS_SQL} SELECT l_orderkey, l_linenumber, source_id, target_id FROM rels WHERE is_resolved AND target_id IS NOT NULL")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved(_relationships(spark, sf_dir)).select("l_orderkey", "l_linenumber", "source_id", "target_id")


@query("null_strip", "SELECT p_partkey, to_json(map_from_entries([x for x in [('brand', CASE WHEN p_partkey % 2 = 0 THEN p_brand END), ('type', CASE WHEN p_partkey % 3 = 0 THEN p_type END), ('size', p_size::VARCHAR)] if x[2] IS NOT NULL])) AS props FROM part")
def null_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("type"), F.col("p_size").alias("size"))
    return p.select("p_partkey", F.to_json(graph.property_map(p, ["brand", "type", "size"])).alias("props"))


@query("finished_jobs", f"WITH {_JOBS_SQL} SELECT id, status FROM jobs WHERE status IN ('succeeded', 'failed', 'cancelled')")
def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).where(jobs.is_finished()).select("id", "status")


@query("array_heads", "SELECT conv_id, list(role ORDER BY turn)[:3] AS head, greatest(count(*) - 3, 0)::BIGINT AS more FROM conversations GROUP BY conv_id")
def array_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("enclosing_class_id"), F.col("turn").alias("ord"), "role")
    ids = c.select(F.col("enclosing_class_id").alias("id")).distinct()
    return graph.class_methods(ids, c, "role", shown=3).select(F.col("id").alias("conv_id"), F.col("methods").alias("head"), "more")


# ---------------------------------------------------------------- joins


@query(
    "go_method_link",
    """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'f' || o_orderkey ELSE 'p.T' || (o_custkey % 100) || '.m' || o_orderkey END AS q, CASE WHEN o_orderkey % 11 = 0 THEN 'given' END AS e FROM orders),
t AS (SELECT 'p.T' || (c_custkey % 80) AS o, arg_max('c' || c_custkey, c_custkey) AS t FROM customer GROUP BY 1)
SELECT o_orderkey, q AS qualified_name, coalesce(e, CASE WHEN len(string_split(q, '.')) >= 3 THEN t END) AS enclosing_class_id FROM m LEFT JOIN t ON t.o = regexp_replace(q, '\\.[^.]*$', '')""",
)
def go_method_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types share names, so the last one counts; some methods are linked already, some names are too short."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("f"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("p.T"), F.col("o_custkey") % 100, F.lit(".m"), F.col("o_orderkey")))
    methods = o.select("o_orderkey", name.alias("qualified_name"), F.when(F.col("o_orderkey") % 11 == 0, "given").alias("enclosing_class_id"))
    types = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("p.T"), F.col("c_custkey") % 80).alias("qualified_name"), F.col("c_custkey").alias("ord"))
    return graph.link_methods(methods, types).select("o_orderkey", "qualified_name", "enclosing_class_id")


@query("class_methods", "SELECT c_custkey AS id, coalesce((list('m' || o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL))[:30], []) AS methods, greatest(count(o_orderkey) - 30, 0)::BIGINT AS more FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def class_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    methods = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("enclosing_class_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("m"), F.col("o_orderkey")).alias("text"))
    return graph.class_methods(classes, methods, "text")


@query("call_list", "SELECT l_suppkey::VARCHAR AS source_id, list_sort(list(DISTINCT 'n' || l_partkey))[:20] AS calls, greatest(count(DISTINCT l_partkey) - 20, 0)::BIGINT AS more FROM lineitem GROUP BY 1")
def call_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    named = li.select(F.col("l_suppkey").cast("string").alias("source_id"), F.lit("calls").alias("kind"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("n"), F.col("l_partkey"))).alias("target_name"), F.concat(F.lit("loom python r p n"), F.col("l_partkey"), F.lit("().")).alias("target_id"))
    return graph.call_lists(named)


@query("embedding_ids", "SELECT 'v' || vec_id AS moniker, row_number() OVER (ORDER BY 'v' || vec_id) - 1 AS embedding_id FROM embeddings")
def embedding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense_ids(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("moniker")), "moniker")


_DIFF_SQL = """old AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4),
d AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM old o FULL JOIN new n ON o.id = n.id)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    old = d.where("id % 10 != 3").select("id", F.sha2("text", 256).alias("body_hash"))
    new = d.where("id % 10 != 4").select("id", F.sha2(F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("body_hash"))
    return graph.diff(old, new)


@query("diff_status", f"WITH {_DIFF_SQL} SELECT id, status FROM d")
def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query("diff_counts", f"WITH {_DIFF_SQL} SELECT count_if(status = 'added')::BIGINT AS added, count_if(status = 'updated')::BIGINT AS updated, count_if(status = 'deleted')::BIGINT AS deleted, count_if(status = 'unchanged')::BIGINT AS skipped FROM d")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.diff_counts(_diff(spark, sf_dir))


@query("change_ratio", f"WITH {_DIFF_SQL}, c AS (SELECT count(*) AS changed FROM d WHERE status <> 'unchanged'), n AS (SELECT count(*) AS indexable FROM new) SELECT changed, indexable, changed / indexable AS ratio, indexable >= 2 AND changed / indexable > 0.5 AS full_index FROM c, n")
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diff(spark, sf_dir)
    return graph.change_ratio(d.where("status != 'unchanged'"), d.where("status != 'deleted'"))


@query("affected_relationships", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def affected_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), "l_linenumber", "l_partkey")
    changed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return graph.affected(rels, changed).select(F.col("source_id").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("edge_write", f"WITH {_RELATIONSHIPS_SQL}, {_NODES_SQL}, {_EDGES_SQL} SELECT src, label, dst FROM edges")
def edge_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.write_edges(_nodes(spark, sf_dir), _relationships(spark, sf_dir))


@query("skipped_unresolved", f"WITH {_RELATIONSHIPS_SQL} SELECT count_if(NOT is_resolved OR target_id IS NULL)::BIGINT AS skipped FROM rels")
def skipped_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.skipped_relationships(_relationships(spark, sf_dir))


@query("repo_scope", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def repo_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one repository (region) by way of their group (nation)."""
    region = table(spark, sf_dir, "region").where("r_name = 'ASIA'")
    nations = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("one_hop", f"WITH {_RELATIONSHIPS_SQL}, {_NODES_SQL}, {_EDGES_SQL} SELECT src, dst FROM edges WHERE label = 'CALLS' AND ends_with(src, '7')")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.one_hop(nodes, graph.write_edges(nodes, _relationships(spark, sf_dir)), "CALLS", F.col("id").endswith("7"))


# ---------------------------------------------------------------- DML as DataFrames

_UPSERT_SQL = """old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey AS id, 'new ' || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'X' END AS seg FROM customer WHERE c_custkey % 5 = 0)"""


@query("symbol_upsert", f"WITH {_UPSERT_SQL} SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.seg, o.seg) AS seg FROM old o FULL JOIN new n ON o.id = n.id")
def symbol_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.where("id % 5 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"), F.when(F.col("id") % 2 == 0, "X").alias("seg"))
    return graph.upsert(c.where("id % 3 != 0"), new, "id")


@query("vector_upsert", "SELECT 'v' || vec_id AS moniker, CASE WHEN vec_id % 4 = 0 THEN 1.0 ELSE round(embedding[1]::DOUBLE, 6) END AS x FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 3 <> 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id")).alias("moniker"), "embedding")
    new = v.where("vec_id % 4 = 0").select("moniker", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    out = graph.upsert(v.where("vec_id % 3 != 0").select("moniker", "embedding"), new, "moniker", keep_old_values=False)
    return out.select("moniker", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("vector_delete", "SELECT 'v' || vec_id AS moniker FROM embeddings WHERE vec_id % 6 <> 0")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id")).alias("moniker"))
    return graph.without(v, v.where("vec_id % 6 = 0"), "moniker", "moniker").select("moniker")


@query(
    "replace_repo",
    f"""WITH {_RELATIONSHIPS_SQL}, {_NODES_SQL}, {_EDGES_SQL}, kept AS (SELECT id, repo_name FROM nodes WHERE repo_name <> 'b'), fresh AS (SELECT 's' || s_suppkey AS id, 'b' AS repo_name FROM supplier WHERE s_suppkey % 8 = 1),
now AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
SELECT DISTINCT source_id AS src, upper(kind) AS label, target_id AS dst FROM rels WHERE is_resolved AND target_id IN (SELECT id FROM fresh) AND source_id IN (SELECT id FROM now)""",
)
def replace_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository b is replaced by fewer suppliers; edges to those that are gone go with them."""
    nodes, rels = _nodes(spark, sf_dir), _relationships(spark, sf_dir)
    fresh = table(spark, sf_dir, "supplier").where("s_suppkey % 8 = 1").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit("b").alias("repo_name"))
    return graph.replace_repository(nodes, graph.write_edges(nodes, rels), fresh, rels, "b")[1]


@query("detach_delete", f"WITH {_RELATIONSHIPS_SQL}, {_NODES_SQL}, {_EDGES_SQL} SELECT src, label, dst FROM edges WHERE NOT ends_with(src, '3') AND NOT ends_with(dst, '3')")
def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.detach_delete(nodes, graph.write_edges(nodes, _relationships(spark, sf_dir)), nodes.where(F.col("id").endswith("3")))[1].select("src", "label", "dst")


@query("delete_outbound", f"WITH {_RELATIONSHIPS_SQL}, {_NODES_SQL}, {_EDGES_SQL} SELECT src, label, dst FROM edges WHERE NOT ends_with(src, '5')")
def delete_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.without(graph.write_edges(nodes, _relationships(spark, sf_dir)), nodes.where(F.col("id").endswith("5")), "src").select("src", "label", "dst")


# ---------------------------------------------------------------- vectors

_TOPK_SQL = """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT 'v' || vec_id AS moniker, round(1 - list_inner_product(e, q) / sqrt(list_inner_product(e, e) * list_inner_product(q, q)), 6) AS dist FROM v, q {} ORDER BY dist, moniker LIMIT 10"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("moniker"), "embedding", "label", "vec_id")
    return v, v.where("vec_id = 7").select(F.col("embedding").alias("q"))


@query("vector_topk", _TOPK_SQL.format(""))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return ranking.top_k(v, q).withColumn("dist", F.round("dist", 6))


@query("vector_topk_filtered", _TOPK_SQL.format("WHERE label = 3"))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return ranking.top_k(v.where("label = 3"), q).withColumn("dist", F.round("dist", 6))


#: 32 tables of four sign planes each; tests hold their recall against brute force.
LSH_PLANES = np.random.default_rng(11).normal(size=(32, 4, 64)).round(6).tolist()


@query("vector_topk_lsh")
def vector_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: only rows that share a code with the query in one of the tables are ranked."""
    v, q = _vectors(spark, sf_dir)
    return ranking.top_k_lsh(v, q, LSH_PLANES).withColumn("dist", F.round("dist", 6))


@query("vector_topk_index", _TOPK_SQL.format(""))
def vector_topk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the stored index of a snapshot of all vectors; tests hold its recall against the exact search."""
    v, q = _vectors(spark, sf_dir)
    store = SnapshotStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    store.commit("all", {"embeddings": v.select("moniker", "embedding", F.current_timestamp().alias("indexed_at"), F.lit("all").alias("repo_name"))})
    index = VectorIndex(store)
    index.build(cell_rows=64)
    asked = q.first()
    if asked is None:
        return ranking.top_k(v, q).withColumn("dist", F.round("dist", 6))
    return index.search([float(x) for x in asked["q"]]).withColumn("dist", F.round("dist", 6))


@query("fixture_embed")
def fixture_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture vectors of all documents; tests hold them against NumPy."""
    return table(spark, sf_dir, "documents").select("doc_id", vectors.FixtureEmbedder().column("text").alias("embedding"))


# ---------------------------------------------------------------- aggregates


@query("language_counts", "SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts_by(table(spark, sf_dir, "documents"), "lang")


@query("kind_counts", f"WITH {_SYMBOLS_SQL} SELECT kind, count(*)::BIGINT AS n FROM symbols GROUP BY kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts_by(_symbols(spark, sf_dir), "kind")


@query("duplicate_monikers", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_monikers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("token_cost", f"WITH {_JOBS_SQL} SELECT id, round(embedding_total_tokens::DOUBLE * 1000 / 1e6 * CASE user_id % 3 WHEN 1 THEN 0.13 ELSE 0.02 END, 8) AS cost FROM jobs")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("user_id") % 3 == 0, "text-embedding-3-small").when(F.col("user_id") % 3 == 1, "text-embedding-3-large").otherwise("another")
    return _jobs(spark, sf_dir).select("id", vectors.token_cost(F.col("embedding_total_tokens") * 1000, vectors.rate(model)).alias("cost"))


@query("cost_summary", f"WITH {_JOBS_SQL} SELECT count(*)::BIGINT AS jobs, coalesce(sum(embedding_total_tokens), 0)::BIGINT AS total_tokens, round(coalesce(sum(embedding_estimated_cost_usd), 0), 4) AS total_cost_usd FROM jobs WHERE status = 'succeeded'")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cost_summary(_jobs(spark, sf_dir)).withColumn("total_cost_usd", F.round("total_cost_usd", 4))


@query("cost_by_repo", f"WITH {_JOBS_SQL} SELECT repo_url, count(*)::BIGINT AS jobs, coalesce(sum(embedding_total_tokens), 0)::BIGINT AS total_tokens, round(coalesce(sum(embedding_estimated_cost_usd), 0), 4) AS total_cost_usd FROM jobs WHERE status = 'succeeded' GROUP BY 1")
def cost_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cost_by_repo(_jobs(spark, sf_dir)).withColumn("total_cost_usd", F.round("total_cost_usd", 4))


@query("last_log_value", f"WITH {_LOGS_SQL} SELECT job_id, arg_max(regexp_extract(line, 'tokens: ([0-9]+)', 1), seq)::BIGINT AS total_tokens, arg_max(regexp_extract(line, 'cost: \\$([0-9.]+)', 1), seq)::DOUBLE AS cost_usd FROM logs WHERE source = 'stdout' GROUP BY 1")
def last_log_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.usage(_logs(spark, sf_dir))


@query("failure_detail", f"""WITH {_LOGS_SQL} SELECT job_id, arg_max(trim(line), seq) AS error_detail FROM logs WHERE source = 'stderr' AND trim(line) <> '' AND NOT starts_with(trim(line), 'File "') AND NOT starts_with(trim(line), 'Traceback ') AND NOT starts_with(trim(line), '^') GROUP BY 1""")
def failure_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.failure_detail(_logs(spark, sf_dir))


@query("log_tail", f"WITH {_LOGS_SQL} SELECT job_id, seq, source, line FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 2")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.log_tail(_logs(spark, sf_dir), 2)


@query("log_tail_default", f"WITH {_LOGS_SQL} SELECT job_id, seq, source, line FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 10000")
def log_tail_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own number of lines."""
    return jobs.log_tail(_logs(spark, sf_dir))


@query("summary_counts", "SELECT o_custkey, count(*)::INT AS symbols, 0 AS relationships, count(*)::INT AS files, 0 AS failed_files, count(*)::BIGINT AS embeddings FROM orders GROUP BY 1")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exported graph per customer, its orders as symbols and files."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("symbols"))
    g = o.select("o_custkey", "symbols", F.array().alias("relationships"), F.col("symbols").alias("files"), F.lit(None).cast("array<string>").alias("failed_files"), F.struct(F.size("symbols").cast("long").alias("count")).alias("embeddings"))
    return jobs.summary_counts(g, "o_custkey")


# ---------------------------------------------------------------- ranking, order and sets


@query("queue_position", f"WITH {_JOBS_SQL} SELECT id, row_number() OVER (ORDER BY created_at, id)::INT AS queue_position FROM jobs WHERE status = 'queued'")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_positions(_jobs(spark, sf_dir))


@query("latest_jobs", f"WITH {_JOBS_SQL} SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_jobs(_jobs(spark, sf_dir)).select("id", "status", "created_at")


@query("job_record", f"""WITH {_JOBS_SQL} SELECT id, repo_url AS "repoUrl", status, false AS "replace", CASE WHEN event_id % 3 <> 0 THEN embedding_total_tokens END AS symbols, embedding_total_tokens AS "embeddingTotalTokens", created_at AS "createdAt" FROM jobs""")
def job_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the summaries is broken JSON."""
    j = _jobs(spark, sf_dir)
    summary = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.col("embedding_total_tokens").alias("symbol_count")))).otherwise("{broken")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in JOBS.fields if f.name not in (*j.columns, "summary_json")]
    out = jobs.record(j.select("*", *missing, summary.alias("summary_json")))
    return out.select("id", "repoUrl", "status", "replace", F.col("summary.symbol_count").alias("symbols"), "embeddingTotalTokens", "createdAt")


@query("job_duration", "SELECT event_id, round(date_diff('microsecond', ts, ts + INTERVAL 1 SECOND * (event_id % 1000)) / 1e6, 3) AS seconds, format('${:.6f}', (event_id % 1000) / 8.0) AS cost FROM events")
def job_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 1000)").alias("finished"))
    return e.select("event_id", jobs.duration_seconds("ts", "finished").alias("seconds"), jobs.usd(F.col("event_id") % 1000 / 8.0).alias("cost"))


@query("first_wins", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranking.first_by(li, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]).drop("l_extendedprice")


@query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")])


@query(
    "set_ops",
    """WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT 'only_old' AS part, id FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'both', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'any', id FROM (SELECT id FROM a UNION SELECT id FROM b)""",
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    a, b = (o.where(F.col("o_orderstatus") == s).select("id") for s in "OF")
    named = lambda name, df: df.select(F.lit(name).alias("part"), "id")
    return named("only_old", b.subtract(a)).union(named("both", a.intersect(b))).union(named("any", a.union(b).distinct()))


@query("export_order", f"""WITH {_RELATIONSHIPS_SQL} SELECT row_number() OVER (ORDER BY source_id, coalesce(target_name, ''), coalesce(target_id, ''), l_orderkey, l_linenumber, l_quantity) - 1 AS place, source_id, target_name, target_id FROM rels""")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships numbered in export order; the tie-breaks make the key unique enough for equal rows to be equal."""
    rels = _relationships(spark, sf_dir)
    key = F.struct("source_id", F.coalesce("target_name", F.lit("")).alias("a"), F.coalesce("target_id", F.lit("")).alias("b"), "l_orderkey", "l_linenumber", "l_quantity")
    return ranking.dense_ids(rels.withColumn("_key", key), "_key", "place").select("place", "source_id", "target_name", "target_id")


# ---------------------------------------------------------------- chunks


@query(
    "class_chunk",
    """WITH m AS (SELECT o_custkey, 'm' || o_orderkey || '(x: ' || o_orderstatus || ') -> int' AS sig, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
g AS (SELECT o_custkey, string_agg('  ' || sig, chr(10) ORDER BY r) FILTER (r <= 30) || CASE WHEN any_value(n) > 30 THEN chr(10) || '  ... (' || (any_value(n) - 30) || ' more)' ELSE '' END AS block FROM m GROUP BY 1)
SELECT c_custkey, 'Class: q.' || c_name || chr(10) || 'File: src/c.py' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Extends: ' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'Docstring: about ' || c_name ELSE '' END
 || coalesce(chr(10) || 'Methods:' || chr(10) || block, '') AS chunk FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
)
def class_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    classes = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("q."), "c_name").alias("qualified_name"), F.lit("src/c.py").alias("file_path"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).alias("base_classes"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("about "), "c_name")).alias("docstring"))
    param = lambda n, t: F.struct(n.alias("name"), t.alias("type_annotation"))
    params = F.array(param(F.lit("self"), F.lit(None).cast("string")), param(F.lit("x"), F.col("o_orderstatus")))
    methods = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("enclosing_class_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("m"), F.col("o_orderkey")).alias("name"), params.alias("parameters"), F.lit(False).alias("is_async"), F.lit("int").alias("return_type"))
    lists = graph.class_methods(classes, methods, chunks.method_line())
    return classes.join(lists, "id").select(F.col("id").alias("c_custkey"), chunks.class_chunk().alias("chunk"))


# ---------------------------------------------------------------- extraction, on code made from the tables


#: Made files that one task parses at most, on average.
FILES_A_TASK = 5_000


def _code(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """One file per customer; its name and segment vary the code. Parsing is the work, and the table may be one file, so its rows
    are dealt to more tasks the more there are, before they become code."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    c = c.repartition(max(1, spark.sparkContext.defaultParallelism, -(-c.count() // FILES_A_TASK)))
    template, ext = made_code.TEMPLATES[language]
    text = F.replace(F.replace(F.lit(template), F.lit("@K"), F.col("c_custkey").cast("string")), F.lit("@S"), F.initcap("c_mktsegment"))
    path = F.concat(F.lit("src/f"), F.col("c_custkey"), F.lit(ext))
    return c.select(F.lit("made").alias("repo_name"), path.alias("path"), F.lit(language).alias("language"), text.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


def _extracted(language: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from codeloom.extract import udtf

        wanted = extraction(symbols=("id", "kind", "qualified_name", "location", "body_hash", "signature", "complexity"))
        symbols = udtf.symbols_of(udtf.extract(_code(spark, sf_dir, language), wanted=wanted))
        return symbols.select("id", "kind", "qualified_name", "location.byte_start", "location.byte_end", "body_hash", "signature", "complexity")

    run.__doc__ = f"Symbols of one made {language} file per customer."
    return run


for _language in made_code.TEMPLATES:
    query(f"extract_{_language}", made_code.symbols_sql(_language))(_extracted(_language))


@query("function_chunk", made_code.chunks_sql())
def function_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of everything embeddable in the made Python files."""
    from codeloom.extract import udtf

    wanted = extraction(symbols=chunks.SYMBOL_FIELDS, relationships=chunks.RELATIONSHIP_FIELDS)
    extracted = stored(udtf.extract(_code(spark, sf_dir, "python"), wanted=wanted), "extracted")  # read by several branches
    return chunks.build(udtf.symbols_of(extracted), udtf.relationships_of(extracted))


@query("graph_json", made_code.relationships_sql())
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of the made Python files as the export orders them."""
    from codeloom.extract import udtf
    from codeloom.plans.export import ordered_relationships

    shown = ("source_id", "kind", "is_resolved", "target_id", "target_name")
    extracted = udtf.extract(_code(spark, sf_dir, "python"), wanted=extraction(relationships=(*shown, "file_path", "ord")))
    return ordered_relationships(stored(udtf.relationships_of(extracted), "relationships")).select(*shown)
