"""Text of statements as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .scalars import trim

def by_line() -> WindowSpec:
    """The lines of a document in order."""
    return Window.partitionBy("doc_id").orderBy("line_no")


def so_far() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def line_array(text: Column, ends: str = "\n") -> Column:
    """The trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, ends), lambda x: trim(x)), lambda x: x != "")


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def normalize_text(text: Column) -> Column:
    """Line ends as \\n, lines trimmed, empty ones left out."""
    return F.array_join(line_array(text, r"\r\n|\r|\n"), "\n")


def literal_strings(content: Column) -> Column:
    """Text of the uncompressed ( ... ) Tj literals of a file's bytes, one a line. Possessive, so that a long literal takes no stack."""
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"\(([^\\)]*+(?:\\.[^\\)]*+)*+)\)\s*Tj"), F.lit(1))
    plain = F.transform(found, _unescape)
    return F.array_join(F.filter(plain, lambda x: x != ""), "\n")


def _unescape(x: Column) -> Column:
    for mark, sign in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        x = F.replace(x, F.lit(mark), F.lit(sign))
    return trim(x)


def text_or_fallback(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, content) with text, normalised, or else that of the literals; error where both are empty."""
    own = F.nullif(normalize_text(F.coalesce("text", F.lit(""))), F.lit(""))
    other = F.nullif(normalize_text(literal_strings(F.coalesce("content", F.lit(b"")))), F.lit(""))
    out = docs.withColumn("text", F.coalesce(own, other))
    return out.withColumn("error_code", F.when(F.col("text").isNull(), F.lit("PDF_TEXT_EXTRACTION_FAILED")))


def explode_lines(docs: DataFrame, lines: Column | None = None) -> DataFrame:
    """(doc_id, line_no, line) of docs (doc_id, text); a document without lines has one row with null line."""
    lines = line_array(F.coalesce("text", F.lit(""))) if lines is None else lines
    return docs.select("doc_id", F.posexplode_outer(lines).alias("line_no", "line"))


def first_of(value: Column) -> Column:
    """The value of the document's first line that has one."""
    return F.min(F.when(value.isNotNull(), F.struct("line_no", value.alias("v")))).over(Window.partitionBy("doc_id"))["v"]
