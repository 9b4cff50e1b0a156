"""Text rules of the jobs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output formats, limits and marks that published results must show.
HOST = "https://github.com/"
NONE_FOUND = "None found"
SNIPPET_CHARS = 5000
README_CHARS = 3000
README_SAMPLE_CHARS = 2000
CELL_CHARS = 30000
CELL_MARK = "\n... (truncated)"
LANGUAGE_QUALIFIER = "language:python"
MAX_PATTERNS = 5

# Fixed value: the white space that Python's str.strip drops.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends; `trim` alone would drop spaces only."""
    return F.btrim(text, F.lit(BLANKS))


def concat_skipping_nulls(*parts: Column) -> Column:
    """CONCAT as PostgreSQL has it: a null part counts as empty."""
    return F.concat_ws("", *parts)


def report_commit_url(repo_url: Column, commit_hash: Column) -> Column:
    return concat_skipping_nulls(repo_url, F.lit("/commit/"), commit_hash)


def commit_url(repo_name: Column, sha: Column) -> Column:
    """Null when there is no commit."""
    return F.concat(F.lit(HOST), repo_name, F.lit("/commit/"), sha)


def repo_url(repo_name: Column) -> Column:
    return F.concat(F.lit(HOST), repo_name)


def file_url(repo_name: Column, file_path: Column) -> Column:
    return F.concat(F.lit(HOST), repo_name, F.lit("/blob/HEAD/"), file_path)


def entry_line(repo_name: Column, stars: Column, url: Column) -> Column:
    """One line of the summary cell."""
    return F.concat(
        F.coalesce(repo_name, F.lit("Unknown")),
        F.lit(" ("),
        F.coalesce(stars, F.lit(0)).cast("string"),
        F.lit(" stars) | "),
        F.coalesce(url, F.lit("")),
    )


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def head(text: Column, chars: int) -> Column:
    """The first `chars` code points."""
    return F.substring(text, 1, chars)


def snippet(text: Column) -> Column:
    """The part of a file that a result shows. Matching reads the whole file."""
    return head(text, SNIPPET_CHARS)


def readme_sample(text: Column) -> Column:
    return head(head(empty_if_null(text), README_CHARS), README_SAMPLE_CHARS)


def detail_cell(text: Column) -> Column:
    """Cut a text that is too long for a cell and say so."""
    return F.when(
        F.length(text) > CELL_CHARS, F.concat(head(text, CELL_CHARS), F.lit(CELL_MARK))
    ).otherwise(text)


def utf8_or_empty(content: Column) -> Column:
    """Bytes as text; one bad byte makes the whole value empty."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))


def is_yes(answer: Column) -> Column:
    """A verdict counts as yes only if it is exactly that word. Null stays null."""
    return F.upper(strip(answer)) == F.lit("YES")


def is_flagged(answer: Column) -> Column:
    """Scanner verdict: without an answer the repository is not a scanner."""
    return F.coalesce(is_yes(answer), F.lit(False))


def is_accepted(answer: Column) -> Column:
    """Similarity verdict: without an answer the candidate is accepted."""
    return F.coalesce(is_yes(answer), F.lit(True))


def qualified(pattern: Column) -> Column:
    """Add the language qualifier unless the pattern has it in any case."""
    return F.when(F.lower(pattern).contains(LANGUAGE_QUALIFIER), pattern).otherwise(
        F.concat(pattern, F.lit(f" {LANGUAGE_QUALIFIER}"))
    )


def unfenced(text: Column, lines: Column) -> Column:
    """The inside of a fenced block of more than two lines; any other text as it is.

    `text` is stripped and `lines` are its lines. The first and last line go whatever the
    last one holds, then a leading `json`.
    """
    inside = F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n")
    fenced = text.startswith("```") & (F.size(lines) > 2)
    label = F.lit("json")
    return (
        F.when(fenced & inside.startswith(label), strip(F.substr(inside, F.lit(5))))
        .when(fenced, inside)
        .otherwise(text)
    )


def listed_text(pair: Column) -> Column:
    """Text of one list item, given as its JSON `text` and its typed `value`.

    The variant tells null, true and false from strings that look the same.
    """
    kind = F.schema_of_variant(pair["value"])
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(pair["text"]))
        .otherwise(pair["text"])
    )
