"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType()}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """``name TYPE`` pairs; a type that is not in _TYPES is one of the nested ones. Needs no session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES.get(kind) or nested[kind]) for name, kind in pairs])


LOCATION = _struct("line_start INT, line_end INT, byte_start INT, byte_end INT, column_start INT, column_end INT")
PARAMETER = _struct("name STRING, type_annotation STRING, default_value STRING, is_variadic BOOLEAN, is_keyword_variadic BOOLEAN")
METADATA = _struct("import_source STRING, alias STRING, call_form STRING, receiver STRING, import_form STRING, re_export BOOLEAN, embedding_kind STRING")
_NESTED = {"LOCATION": LOCATION, "METADATA": METADATA, "PARAMETERS": T.ArrayType(PARAMETER), "STRINGS": T.ArrayType(T.StringType()), "FLOATS": T.ArrayType(T.FloatType())}

SYMBOLS = _struct(
    "id STRING, kind STRING, name STRING, qualified_name STRING, repo_name STRING, file_path STRING, location LOCATION, body_hash STRING, "
    "language STRING, visibility STRING, is_exported BOOLEAN, signature STRING, parameters PARAMETERS, return_type STRING, docstring STRING, "
    "decorators STRINGS, is_async BOOLEAN, complexity INT, base_classes STRINGS, is_abstract BOOLEAN, enclosing_class_id STRING, "
    "is_static BOOLEAN, is_constructor BOOLEAN, receiver_kind STRING, type_annotation STRING, is_constant BOOLEAN, meta_hash STRING, "
    "symbol_text STRING, ord BIGINT",
    **_NESTED,
)
RELATIONSHIPS = _struct(
    "source_id STRING, kind STRING, is_resolved BOOLEAN, target_id STRING, target_name STRING, location LOCATION, metadata METADATA, "
    "repo_name STRING, file_path STRING, ord BIGINT",
    **_NESTED,
)
FILES = _struct("path STRING, language STRING, size_bytes BIGINT, hash STRING, repo_name STRING")
FAILED_FILES = _struct("path STRING, error STRING, repo_name STRING")
REPOSITORIES = _struct("name STRING, url STRING, commit_sha STRING, indexed_at TIMESTAMP")
EDGES = _struct("src STRING, label STRING, dst STRING, repo_name STRING")
EMBEDDINGS = _struct("moniker STRING, embedding FLOATS, indexed_at TIMESTAMP, repo_name STRING", **_NESTED)
CHUNK_VECTORS = _struct("digest STRING, embedding FLOATS", **_NESTED)
CHANGED_FILES = _struct("path STRING, status STRING")
JOBS = _struct(
    "id STRING, repo_url STRING, replace BOOLEAN, status STRING, queue_position INT, started_at STRING, finished_at STRING, exit_code INT, "
    "clone_path STRING, output_path STRING, error STRING, error_detail STRING, summary_json STRING, embedding_prompt_tokens BIGINT, "
    "embedding_total_tokens BIGINT, embedding_estimated_cost_usd DOUBLE, pid INT, created_at STRING"
)
JOB_LOGS = _struct("job_id STRING, seq BIGINT, source STRING, line STRING, ts STRING")

#: What an extractor returns for one file.
EXTRACTION = T.StructType(
    [
        *_struct("repo_name STRING, path STRING, language STRING, status STRING, error STRING, size_bytes BIGINT, hash STRING").fields,
        T.StructField("symbols", T.ArrayType(SYMBOLS)),
        T.StructField("relationships", T.ArrayType(RELATIONSHIPS)),
    ]
)


def extraction(**fields: Sequence[str]) -> T.StructType:
    """The part of EXTRACTION that has the named fields of symbols, of relationships or of both, for readers of no more."""
    part = lambda name: T.StructType([f for f in EXTRACTION[name].dataType.elementType if f.name in fields[name]])
    return T.StructType([T.StructField(name, T.ArrayType(part(name))) for name in fields])


VISIBILITIES = ("public", "private", "protected", "internal")
RELATION_KINDS = ("calls", "extends", "implements", "imports", "contains", "references", "returns_type", "parameter_type")
SYMBOL_KINDS = ("function", "class", "method", "variable", "module")
EMBEDDABLE_KINDS = ("function", "class", "method")
