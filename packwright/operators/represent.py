"""Representations: the target in full, and the evidence raw or as numbered snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions import text as X

# The marks of a pack.
TARGET_HEAD = "=== TARGET FUNCTION ==="
RAW_HEAD = "\n=== CONTEXT (selected functions, raw source) ==="
SNIPPET_HEAD = "\n=== CONTEXT (selected functions, reduced to their relevant lines) ==="
SNIPPET_NOTE = "Original line numbers are preserved; '...' marks elided lines."
ELISION = "      ..."
LINE_BREAKS = "\r\n|[\n\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def source_lines(source: Column) -> Column:
    """The lines of a text; a line break at its end opens no further line."""
    return let(F.split(source, LINE_BREAKS, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def snippet(source: Column, line: Column, keep_lines: Column) -> Column:
    """The first, last and kept rows with their numbers, and a mark in each gap.

    Without kept rows the whole source, stripped. Rows are counted from the function's
    start and numbered from the symbol's line.
    """

    def numbered(lines: Column, rows: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            text = F.format_string("%6d| %s", line + r, X.rstrip(F.get(lines, r)))
            gap = (i > 0) & (r > F.get(rows, i - 1) + 1)
            return F.when(gap, F.concat(F.lit(ELISION + "\n"), text)).otherwise(text)

        return F.array_join(F.transform(rows, one), "\n")

    def kept(lines: Column) -> Column:
        last = F.size(lines) - 1
        rows = F.array_sort(F.array_distinct(F.concat(keep_lines, F.array(F.lit(0), last))))
        return let(F.filter(rows, lambda r: (r >= 0) & (r <= last)), lambda rows: numbered(lines, rows))

    nothing = F.size(F.coalesce(keep_lines, F.array().cast("array<int>"))) == 0
    return F.when(nothing, X.strip(source)).otherwise(let(source_lines(source), kept))


def block(place: Column, item: Column, body: Column) -> Column:
    return F.concat(
        F.lit("[EVIDENCE E"), place.cast("string"), F.lit("]\nfile: "), item["file"], F.lit("\nfunction: "), item["name"],
        F.lit("\nline: "), item["line"].cast("string"), F.lit("\n\n"), body, F.lit("\n[/EVIDENCE]"),
    )


def _pack(target: Column, evidence: Column, heads: list[str], body) -> Column:
    blocks = F.transform(evidence, lambda e, i: block(i + 1, e, body(e)))
    context = F.concat(F.array(*[F.lit(h) for h in heads]), blocks)
    parts = F.when(F.size(evidence) > 0, context).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit(TARGET_HEAD), X.strip(target)), parts), "\n")


def render_raw(target: Column, evidence: Column) -> Column:
    """evidence: an array of structs (file, name, line, source) in order."""
    return _pack(target, evidence, [RAW_HEAD], lambda e: X.strip(e["source"]))


def render_snippets(target: Column, evidence: Column) -> Column:
    """evidence as above, with keep_lines."""
    return _pack(target, evidence, [SNIPPET_HEAD, SNIPPET_NOTE], lambda e: snippet(e["source"], e["line"], e["keep_lines"]))


REPRESENTATIONS = {"R0": render_raw, "R1": render_snippets}


def gather_evidence(kept: DataFrame, index: DataFrame) -> DataFrame:
    """(sample_id, evidence): the kept functions with their sources, in order.

    Sources join only now, for what the budget kept.
    """
    full = kept.select("sample_id", "pos", "worktree", "name", "file", "line", "tokens").join(index.select("worktree", "name", "source", "keep_lines"), ["worktree", "name"])
    item = F.struct("pos", "file", "name", "line", "source", "keep_lines", "tokens")
    return full.groupBy("sample_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
