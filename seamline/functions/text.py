"""String functions over columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions.numeric import nan_to_null


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lit_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression mentioned inside an array lambda is evaluated again for every
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(text: Column, keep_digits: bool = False) -> Column:
    """Lower case, blanks and dashes to underscores, everything else dropped."""
    allowed = "[^a-z0-9_]" if keep_digits else "[^a-z_]"
    return F.regexp_replace(F.translate(F.lower(text), " -", "__"), allowed, "")


def sheet_number(sheet_name: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(fixed.SHEET_NUMBERS), sheet_name), F.lit("00"))


def sheet_theme(sheet_name: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(fixed.SHEET_THEMES), sheet_name), F.lit("Unknown"))


def metric_key(sheet_name: Column, title: Column, keep_digits: bool = False) -> Column:
    return F.concat(sheet_number(sheet_name), F.lit("_"), slug(title, keep_digits))


def feature_name(key: Column) -> Column:
    return F.concat(F.lit("f_"), key)


def weight_name(key: Column, horizon: Column) -> Column:
    return F.concat(F.lit("w_"), key, F.lit("_"), horizon)


def score_name(sub_industry: Column, horizon: Column) -> Column:
    return F.concat(F.lit("s_"), slug(sub_industry), F.lit("_"), horizon)


def dataset_name(source: Column, topic: Column) -> Column:
    return F.concat(F.lit("raw_"), slug(source), F.lit("_"), slug(topic))


def is_valid_name(name: Column, kind: str) -> Column:
    return name.rlike(fixed.NAME_PATTERNS[kind])


def parse_name(name: Column, kind: str, fields: list[str]) -> Column:
    """Struct of the captured parts, NULL where the pattern does not match."""
    pattern = fixed.NAME_PATTERNS[kind]
    parts = [F.regexp_extract(name, pattern, i + 1).alias(f) for i, f in enumerate(fields)]
    return F.when(name.rlike(pattern), F.struct(*parts))


def strip_prefix(name: Column, prefix: str, replacement: str = "") -> Column:
    return F.regexp_replace(name, f"^{prefix}", replacement)


def safe_number(text: Column, dtype: str, default=None) -> Column:
    """Number from a cell that may carry a bracketed note."""
    bare = F.trim(F.regexp_replace(text, r"\(.*?\)", ""))
    number = F.nullif(bare, F.lit("")).try_cast(dtype)
    if dtype == "double":
        number = nan_to_null(number)
    return F.coalesce(number, F.lit(default).cast(dtype))


def flag_from_text(text: Column, words=("true", "yes", "1", "y")) -> Column:
    return F.lower(text).isin(*words)


def clean_lines(text: Column) -> Column:
    """Trim every line, drop the blank ones and squeeze runs of spaces."""
    blanks = F.lit(fixed.BLANK_CHARACTERS)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, blanks)), lambda x: x != "")
    return F.regexp_replace(F.array_join(lines, "\n"), " {2,}", " ")


def _is_heading(line: Column) -> Column:
    has_letter = F.lower(line) != F.upper(line)
    capitals = has_letter & (F.upper(line) == line)
    numbered = line.rlike(r"^\p{Nd}") & (F.instr(F.substring(line, 1, 10), ".") > 0)
    return (F.length(line) < 100) & (capitals | numbered)


def markdown(text: Column, title: Column, source: Column, pages: Column) -> Column:
    """Markdown rendering of cleaned text.

    Headings end a paragraph block, so each line carries the separator that
    belongs to it and the lines are simply joined.
    """
    bare = lambda x: F.btrim(x, F.lit(" -"))
    is_break = lambda x: x.startswith("--- Page") | x.startswith("--- Table") | _is_heading(x)

    def render(lines: Column) -> Column:
        return F.transform(
            lines,
            lambda x, i: F.when(x.startswith("--- Page"), F.concat(F.lit("## "), bare(x), F.lit("\n\n")))
            .when(x.startswith("--- Table"), F.concat(F.lit("### "), bare(x), F.lit("\n\n")))
            .when(_is_heading(x), F.concat(F.lit("### "), x, F.lit("\n\n")))
            .when(
                (i + 1 == F.size(lines)) | is_break(F.coalesce(F.get(lines, i + 1), F.lit(""))),
                F.concat(x, F.lit("\n\n")),
            )
            .otherwise(F.concat(x, F.lit("\n"))),
        )

    rendered = bind(F.split(text, "\n"), render)
    head = F.concat(
        F.lit("# "), F.coalesce(title, F.lit("Document")), F.lit("\n\n"),
        F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("**Source:** "), source, F.lit("\n"))).otherwise(""),
        F.when(F.coalesce(pages, F.lit(0)) != 0, F.concat(F.lit("**Pages:** "), pages.cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("\n---\n\n"),
    )
    return F.concat(head, F.array_join(rendered, ""))


def table_row(*cells: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def references(text: Column) -> Column:
    """Array of (type, values) for each reference pattern found in the text."""
    found = [
        F.struct(
            F.lit(kind).alias("type"),
            F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1 if "(" in pattern else 0)).alias("values"),
        )
        for kind, pattern in fixed.REFERENCE_PATTERNS.items()
    ]
    return F.filter(F.array(*found), lambda x: F.size(x["values"]) > 0)


def _contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def intent(message: Column) -> Column:
    low = F.lower(message)
    out = None
    for name, words in fixed.INTENT_KEYWORDS.items():
        out = F.when(_contains_any(low, words), name) if out is None else out.when(_contains_any(low, words), name)
    return out.otherwise("general")


def topics(message: Column) -> Column:
    low = F.lower(message)
    return F.array_compact(F.array(*[F.when(low.contains(k), t) for k, t in fixed.TOPIC_KEYWORDS.items()]))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def title_case(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "_", " "))


def formula_variables(formula: Column) -> Column:
    """Distinct identifiers of a formula that are not functions, sorted."""
    words = F.regexp_extract_all(formula, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(words), lit_array(fixed.FORMULA_FUNCTIONS)))


def citation_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[Source:"))


def score_label(sheet_name: Column) -> Column:
    out = None
    for prefix, label in fixed.SCORE_NAME_BY_PREFIX.items():
        hit = sheet_name.startswith(prefix)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(sheet_name)


def first_capture(text: Column, patterns: list[str]) -> Column:
    """First non-empty trimmed capture of several candidate patterns."""
    return F.coalesce(
        *[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    )
