"""Classification and chunking of specification files, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it, as a Java character class.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Word characters of attribute names.
_NAME = r"[\p{L}\p{N}_-]"

# Where files of each dimension are found, first match first.
REQUIREMENT_FILES = [("solution-requirements.md", "solution-requirements"), ("data-requirements.md", "data-requirements"), ("business-rules.md", "business-rules")]
FOLDERS = [
    ("documents/01-context-and-requirements", "context-and-requirements"),
    ("documents/02-quality-attributes", "quality-attributes"),
    ("documents/03-constraints", "constraints"),
    ("documents/04-architecture-diagrams", "architecture-diagrams"),
    ("documents/05-infrastructure-costs", "infrastructure-costs"),
    ("documents/06-architectural-decisions", "architectural-decisions"),
    ("documents/07-risks-and-technical-debts", "risks-and-technical-debts"),
    ("/processes/", "processes"),
]
MANIFEST_FILE = "kb-manifest.yaml"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slug(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*\z", "")


def dimension(path: Column) -> Column:
    """Dimension of a file by its path; null if no rule matches."""
    required = path.contains("requirements/")
    rules = [(required & (basename(path) == name), code) for name, code in REQUIREMENT_FILES] + [(path.contains(folder), code) for folder, code in FOLDERS]
    return F.coalesce(*[F.when(test, F.lit(code)) for test, code in rules])


def business_function(path: Column) -> Column:
    """Slug of the business function that a file belongs to, or null."""
    return F.nullif(F.regexp_extract(path, r"requirements/(business-fct-[^/]+)/", 1), F.lit(""))


def kind(path: Column) -> Column:
    """decision_record, risk or document, by the file name."""
    name = basename(path)
    # (?iu) folds case as Python does, \p{Nd} is its digit class
    return F.when(name.rlike(r"(?iu)ADR-\p{Nd}+"), "decision_record").when(name.rlike(r"(?iu)RISK-\p{Nd}+"), "risk").otherwise("document")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where inner lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attribute_entries(text: Column) -> Column:
    """(key, value) of each attribute line ``:key: value``, the last of each key, in order of those.

    Sorting by key brings the lines of a key together, so that a long text
    costs no more than its lines' sort.
    """
    pattern = rf"(?dm)^:({_NAME}+):[ \t]*(.*)$"
    part = lambda m, k: F.regexp_extract(m, pattern, k)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(part(m, 1).alias("key"), i.alias("i"), strip(part(m, 2)).alias("value")))
    last = lambda by_key: F.filter(by_key, lambda p, i: F.coalesce(F.get(by_key, i + 1)["key"] != p["key"], F.lit(True)))
    in_order = F.array_sort(F.transform(_bound(F.array_sort(found), last), lambda p: F.struct(p["i"].alias("i"), p["key"].alias("key"), p["value"].alias("value"))))
    return F.transform(in_order, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))


def attributes(text: Column) -> Column:
    """Attribute lines of a text as a map."""
    return F.map_from_entries(attribute_entries(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def chunks(text: Column, size: int = 200, overlap: int = 40) -> Column:
    """Overlapping windows of words; the last one reaches the end. No words, no chunks."""
    step = max(1, size - overlap)

    def windows(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < F.size(w)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return _bound(words(text), windows)


def decode_utf8(content: Column) -> Column:
    """Bytes as text, malformed parts replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
