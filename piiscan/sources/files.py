"""Scanning a directory tree: listing, exclusion, routing, size gate, decoding."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import file_name, file_type
from ..operators.classify import scan_documents
from ..operators.patterns import PatternSpec
from ..session import small_side

# --- Fixed values: skipped names, readable file types ---------------------------------------------

DEFAULT_EXCLUDES = [
    "node_modules",
    ".git",
    "__pycache__",
    "venv",
    ".venv",
    ".env",
    ".tox",
    ".pytest_cache",
    ".mypy_cache",
    "dist",
    "build",
    "*.egg-info",
]

TEXT_EXTENSIONS = [
    # text
    ".txt", ".text", ".log", ".md", ".markdown", ".rst",
    # data
    ".csv", ".tsv", ".json", ".jsonl", ".yaml", ".yml", ".xml", ".html", ".htm",
    # code
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".php",
    ".sql", ".sh", ".bash", ".ps1", ".bat", ".cmd",
    # configuration
    ".ini", ".cfg", ".conf", ".config", ".env", ".properties", ".toml",
]

#: Formats whose parsed parts arrive as tables (see ``sources.assemble``).
PARSED_EXTENSIONS = {
    ".docx": "document",
    ".xlsx": "sheet",
    ".xlsm": "sheet",
    ".pdf": "paged",
    ".pptx": "slides",
    ".msg": "message",
    ".rtf": "rtf",
    ".eml": "message",
}

def supported_extensions() -> list[str]:
    return sorted(set(TEXT_EXTENSIONS) | set(PARSED_EXTENSIONS))


def extension(path: Column) -> Column:
    """Lower-case suffix; a dotfile's whole name counts as one."""
    name, suffix = file_name(path), F.lower(file_type(path))
    return F.when((suffix == "") & name.startswith("."), F.lower(name)).otherwise(suffix)


def format_kind(path: Column) -> Column:
    """``text``, the kind of a parsed format, or null for unsupported types."""
    pairs = [x for e in TEXT_EXTENSIONS for x in (F.lit(e), F.lit("text"))]
    pairs += [F.lit(x) for kv in PARSED_EXTENSIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_excluded(relative_path: Column, patterns: list[str] | None = None) -> Column:
    """Any component contains a pattern, or ends with it when the pattern starts with ``*``."""
    patterns = patterns or DEFAULT_EXCLUDES

    def hit(part: Column) -> Column:
        tests = [part.endswith(p[1:]) if p.startswith("*") else part.contains(p) for p in patterns]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    return F.exists(F.split(relative_path, "/"), hit)


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else Latin-1; line ends become ``\\n``; a byte-order mark stays."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def size_error(size: Column, max_bytes: int | None) -> Column:
    if max_bytes is None:
        return F.lit(None).cast("string")
    mb = 1024 * 1024
    return F.when(
        size > max_bytes,
        F.format_string("File too large (%.1f MB > %.0f MB limit)", size / F.lit(float(mb)), F.lit(max_bytes / mb)),
    )


def type_error(path: Column) -> Column:
    suffix = file_type(path)
    return F.when(
        format_kind(path).isNull(),
        F.concat(F.lit("Unsupported file type: "), F.when(suffix != "", suffix).otherwise("(no extension)")),
    )


def _root_uri(spark: SparkSession, root: str) -> tuple[str, str]:
    """Absolute URI of the root, and ``missing`` / ``file`` / ``dir``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return root, "missing"
    status = fs.getFileStatus(path)
    return status.getPath().toString(), "dir" if status.isDirectory() else "file"


def read_documents(
    spark: SparkSession,
    root: str,
    exclude: list[str] | None = None,
    max_bytes: int | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Path, size, time, decoded text or error of every readable file under a root.

    Exclusion, type and size tests use file metadata, which prunes files from the listing before any
    content is read. There is no size limit unless one is given. A root that is a single file is scanned whatever its name; a missing root gives
    one error row. The content of files with a parsed format is never read: their text is taken from ``parts`` (path, text), the
    output of ``sources.assemble`` for the same paths, and a file without parts is reported as an error.
    Spark's file index leaves out empty files and names starting with ``.`` or ``_``.
    """
    uri, kind = _root_uri(spark, root)
    if kind == "missing":
        return spark.sql(
            "SELECT CAST(:p AS STRING) path, CAST(0 AS BIGINT) size_bytes, CAST(NULL AS TIMESTAMP) modified,"
            " CAST(NULL AS STRING) text, concat('Cannot access file: ', :p) error",
            args={"p": root},
        )
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    meta = F.col("_metadata.file_path")
    listing = reader.load(uri)
    if kind == "dir":
        prefix = len(quote(uri.rstrip("/"), safe="/:")) + 1
        relative = F.url_decode(F.replace(F.substr(meta, F.lit(prefix + 1)), F.lit("+"), F.lit("%2B")))
        listing = listing.filter(~is_excluded(relative, exclude) & format_kind(relative).isNotNull())
    size = F.col("_metadata.file_size")
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    about = [path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    none = F.lit(None).cast("string")
    kind_of = F.coalesce(format_kind(F.url_decode(F.replace(meta, F.lit("+"), F.lit("%2B")))), F.lit("none"))
    fits = F.lit(True) if max_bytes is None else size <= max_bytes
    texts = listing.filter(fits & (kind_of == "text")).select(*about, decode_text(F.col("content")).alias("text"), none.alias("error"))
    # the other branches read metadata only
    unread = listing.filter(fits & (kind_of != "text")).select(*about, type_error(path).alias("error"), extension(path).alias("_suffix"))
    if parts is not None:
        unread = unread.join(small_side(parts.select("path", "text")), "path", "left")
    else:
        unread = unread.withColumn("text", none)
    missing = F.when(F.col("text").isNull(), F.concat(F.lit("Extraction failed: no parts for "), "_suffix"))
    unread = unread.withColumn("error", F.coalesce("error", missing)).drop("_suffix")
    found = texts.unionByName(unread)
    if max_bytes is None:
        return found
    return found.unionByName(listing.filter(~fits).select(*about, none.alias("text"), size_error(size, max_bytes).alias("error")))


def scan_directory(
    spark: SparkSession,
    root: str,
    exclude: list[str] | None = None,
    max_bytes: int | None = None,
    patterns: list[PatternSpec] | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """File results of a directory tree. Bad files become rows with an error; the scan never aborts."""
    return scan_documents(read_documents(spark, root, exclude, max_bytes, parts), patterns=patterns)
