"""Extractors as table-generating functions over files; one row per file goes in and comes out, with nested rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.extract import go_source, python_source, typescript_source
from codeloom.extract.model import Extraction, sha256
from codeloom.schemas import EXTRACTION
from codeloom.session import ship

Extractor = Callable[[str, bytes, str], Extraction]
#: Extractors by language; a plug-in is another entry.
REGISTRY: dict[str, Extractor] = {"python": python_source.extract, "typescript": typescript_source.extract, "go": go_source.extract}

#: Files whose rows are handed over together.
FILES_AT_ONCE = 50


def extract_one(repo: str, path: str, language: str, content: bytes | None, error: str | None, registry: dict[str, Extractor]) -> dict:
    """The EXTRACTION row of one file; whatever an extractor raises becomes the row's error. A file of which parts could not be
    read has the status partial, and its error tells which."""
    row = {"repo_name": repo, "path": path, "language": language, "status": "failed", "error": error, "size_bytes": None, "hash": None, "symbols": [], "relationships": []}
    if content is None:
        return row
    row |= {"size_bytes": len(content), "hash": sha256(content)}
    try:
        found = registry[language](path, content, repo)
    except Exception as e:  # noqa: BLE001  one file must not end the run
        return row | {"error": f"{type(e).__name__}: {e}"}
    return row | {"status": "partial" if found.left_out else "ok", "error": found.left_out, "symbols": found.symbols, "relationships": found.relationships}


def extract(files: DataFrame, registry: dict[str, Extractor] | None = None, wanted: T.StructType = EXTRACTION) -> DataFrame:
    """EXTRACTION rows of files (repo_name, path, language, content, error), or the wanted part of them; languages without an
    extractor are left out."""
    ship(files.sparkSession)
    known = registry or REGISTRY
    schema = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                some = batch.slice(at, FILES_AT_ONCE).to_pylist()
                yield pa.RecordBatch.from_pylist([extract_one(r["repo_name"], r["path"], r["language"], r["content"], r["error"], known) for r in some], schema=schema)

    usable = files.where(F.col("language").isin(*known)).select("repo_name", "path", "language", "content", "error")
    return usable.mapInArrow(run, wanted)


def symbols_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("symbols").alias("s")).select("s.*")


def relationships_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("relationships").alias("r")).select("r.*")


def files_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("status in ('ok', 'partial')").select("path", "language", "size_bytes", "hash", "repo_name")


def failures_of(extracted: DataFrame) -> DataFrame:
    return extracted.where("status = 'failed'").select("path", "error", "repo_name")


def partial_of(extracted: DataFrame) -> DataFrame:
    """Files that are in the result with a part left out."""
    return extracted.where("status = 'partial'").select("path", F.col("error").alias("left_out"), "repo_name")


def register_udtf(spark: SparkSession, name: str = "extract_symbols") -> None:
    """SQL: SELECT * FROM extract_symbols('repo', 'a/b.py', 'python', content)."""
    from pyspark.sql.functions import udtf

    ship(spark)

    @udtf(returnType="id string, kind string, name string, qualified_name string, file_path string, body_hash string")
    class ExtractSymbols:
        def eval(self, repo: str, path: str, language: str, content: bytes):
            row = extract_one(repo, path, language, bytes(content), None, REGISTRY)
            for s in row["symbols"]:
                yield s["id"], s["kind"], s["name"], s["qualified_name"], s["file_path"], s["body_hash"]

    spark.udtf.register(name, ExtractSymbols)
