"""Monikers, names, paths and hashes as Column expressions.

A moniker is ``scheme language repository path descriptor``, single-spaced; spaces inside a path are percent-encoded, so
a moniker always splits back into its five parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "loom"

#: Languages by lower-cased file extension.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
#: Directories that are never walked, and file suffixes that are never read.
EXCLUDED_DIRS = (".git", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache", "dist", "build", "testdata")
EXCLUDED_DIR_SUFFIX = ".egg-info"
EXCLUDED_SUFFIXES = ("_test.go",)
#: How descriptors of each kind end.
SUFFIXES = {"function": "().", "method": "().", "class": "#", "variable": ".", "module": "/"}
ARTIFACTS = ("graph.json", "embeddings.npy", "embeddings_index.json")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def descriptor(kind: Column | str, name: Column | str, class_name: Column | str | None = None) -> Column:
    kind, name = _col(kind), _col(name)
    owner = F.lit(None).cast("string") if class_name is None else _col(class_name)
    return (
        F.when(kind == "method", F.concat(owner, F.lit("#"), name, F.lit("().")))
        .when(kind == "function", F.concat(name, F.lit("().")))
        .when(kind == "class", F.concat(name, F.lit("#")))
        .when(kind == "variable", F.concat(name, F.lit(".")))
        .when(kind == "module", F.concat(name, F.lit("/")))
    )


def moniker(language: Column | str, repo: Column | str, path: Column | str, desc: Column, scheme: str = SCHEME) -> Column:
    safe = lambda c: F.replace(_col(c), F.lit(" "), F.lit("%20"))
    return F.concat_ws(" ", F.lit(scheme), _col(language), safe(repo), safe(path), safe(desc))


def parse(m: Column | str, scheme: str = SCHEME) -> Column:
    """Struct of the five parts; null where the text has fewer or another scheme."""
    parts = F.split(_col(m), " ", 5)
    names = ("scheme", "language", "repo_name", "file_path", "descriptor")
    return F.when((F.size(parts) == 5) & (F.get(parts, F.lit(0)) == scheme), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def parse_strict(m: Column | str, scheme: str = SCHEME) -> Column:
    """As ``parse``, but a malformed moniker fails the query."""
    parsed = parse(m, scheme)
    wrong = F.raise_error(F.concat(F.lit("not a moniker: "), F.coalesce(_col(m), F.lit("null"))))
    return F.when(parsed.isNull(), wrong.cast(f"struct<scheme:string,language:string,repo_name:string,file_path:string,descriptor:string>")).otherwise(parsed)


def descriptor_kind(desc: Column | str) -> Column:
    """Kind that a descriptor's end implies; null for an unknown end."""
    d = _col(desc)
    return (
        F.when(d.endswith("()."), F.when(d.contains("#"), "method").otherwise("function"))
        .when(d.endswith("#"), "class")
        .when(d.endswith("/"), "module")
        .when(d.endswith("."), "variable")
    )


def is_moniker(m: Column | str, scheme: str = SCHEME) -> Column:
    parsed = parse(m, scheme)
    return F.coalesce(parsed.isNotNull() & descriptor_kind(parsed["descriptor"]).isNotNull(), F.lit(False))


def repo_name(url: Column | str) -> Column:
    """Short name of a repository from any usual form of its URL."""
    bare = F.regexp_replace(F.trim(_col(url)), "/+$", "")
    scp = bare.contains(":") & ~bare.rlike("^(https?|ssh)://")
    bare = F.when(scp, F.regexp_replace(bare, "^[^:]*:", "")).otherwise(F.regexp_replace(bare, "^(ssh|https?)://", ""))
    bare = F.when(bare.contains("/"), F.substring_index(F.regexp_replace(bare, "^[^/]*/", ""), "/", -1)).otherwise(bare)
    return F.regexp_replace(bare, r"\.git$", "")


def repo_slug(url: Column | str) -> Column:
    """A name that is safe in a path: letters and digits of any script, ``-`` and ``_``; empty becomes ``repo``."""
    last = F.substring_index(F.regexp_replace(F.trim(_col(url)), "/+$", ""), "/", -1)
    slug = F.regexp_replace(F.regexp_replace(last, r"\.git$", ""), r"[^\p{L}\p{N}_-]", "-")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("repo"))


def is_git_url(url: Column | str) -> Column:
    t = F.trim(_col(url))
    return t.rlike("^(https?|git|ssh)://.+") | t.rlike(r"^git@.+:.+\.git$")


def language_of(path: Column | str) -> Column:
    """Language by extension, null where it is unknown."""
    ext = F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def is_excluded(path: Column | str) -> Column:
    """Whether a file lies in an excluded directory or has an excluded suffix."""
    dirs = F.slice(F.split(_col(path), "/"), 1, F.greatest(F.size(F.split(_col(path), "/")) - 1, F.lit(0)))
    in_dir = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])) | F.exists(dirs, lambda d: d.endswith(EXCLUDED_DIR_SUFFIX))
    suffix = F.lit(False)
    for s in EXCLUDED_SUFFIXES:
        suffix = suffix | _col(path).endswith(s)
    return in_dir | suffix


def module_path(path: Column | str) -> Column:
    """Path without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(_col(path), r"(?<=[^/])\.[^./]*$", "")


def module_name(path: Column | str) -> Column:
    return F.translate(module_path(path), "/", ".")


def content_hash(content: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(content).cast("binary"), 256))


def byte_slice(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Bytes [start, end) of the content as UTF-8 text; what a range cuts out of a character becomes U+FFFD."""
    start, end = _col(start).cast("int"), _col(end).cast("int")
    return F.make_valid_utf8(F.substring(_col(content).cast("binary"), start + 1, F.greatest(end - start, F.lit(0))).cast("string"))


def bare_target(target_id: Column | str) -> Column:
    """Name in a resolved target: the last token without the marks of its descriptor at the end."""
    return F.regexp_replace(F.element_at(F.split(_col(target_id), " "), -1), r"[().]+$", "")


def is_dunder(name: Column | str) -> Column:
    return _col(name).startswith("__") & _col(name).endswith("__")


def visibility(name: Column | str, language: str = "python") -> Column:
    n = _col(name)
    if language == "go":
        return F.when(n.rlike(r"^\p{Lu}"), "public").otherwise("internal")
    return F.when(is_dunder(n), "public").when(n.startswith("_"), "private").otherwise("public")


def is_exported(name: Column | str) -> Column:
    return ~_col(name).startswith("_") | is_dunder(name)


def is_constant_name(name: Column | str) -> Column:
    """All cased letters are capitals, and there is one at least."""
    n = _col(name)
    return (n == F.upper(n)) & (n != F.lower(n))


def is_artifact(name: Column | str) -> Column:
    return _col(name).isin(*ARTIFACTS)
