"""Scalar column functions: cleaning, counting, naming and verdicts. No Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a Unicode-aware strip takes off, as a regex class.
SPACE_CLASS = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# The factor of the word-based token estimate, and the verdict codes.
TOKENS_PER_WORD = 1.3
VULNERABLE, SAFE, UNREADABLE = 1, 0, -1


def strip(text: Column) -> Column:
    """Take white space off both ends, every kind that Unicode knows."""
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+\\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+\\z", "")


def clean_body(body: Column) -> Column:
    """A function body without the language tag of a code fence, stripped.

    The tag counts only at the very start: white space before it keeps it as text.
    """
    return strip(F.regexp_replace(body, r"\A(?i:c|cpp|cxx|h)\n", ""))


def guess_function_name(body: Column) -> Column:
    """The identifier right before the first parenthesis ahead of the first brace."""
    found = F.regexp_extract(F.substring_index(body, "{", 1), r"([A-Za-z_](?U:\w)*)(?U:\s)*\(", 1)
    return F.nullif(found, F.lit(""))


def words(text: Column) -> Column:
    """The pieces between white space of any kind."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    """The estimate by words, for where no vocabulary file is at hand."""
    return F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int")


def extract_verdict(reply: Column) -> Column:
    """1 vulnerable, 0 safe, -1 unreadable, by the first letter of the reply."""
    first = F.upper(F.substring(strip(reply), 1, 1))
    return F.when(first == "V", VULNERABLE).when(first == "S", SAFE).otherwise(UNREADABLE)


def verdict_label(prediction: Column) -> Column:
    return F.when(prediction == VULNERABLE, "VULN").when(prediction == SAFE, "SAFE").otherwise("??")


def correctness_mark(prediction: Column, label: Column) -> Column:
    return F.when(prediction == UNREADABLE, "??").when(prediction == label, "OK").otherwise("FAIL")


def cell_id(selector: Column, representation: Column, budget: Column, backend: Column) -> Column:
    return F.format_string("%s_%s_b%d_%s", selector, representation, budget.cast("int"), backend)


def sample_set_id(sample_ids: Column) -> Column:
    """An aggregate: 12 hex digits of the ids' SHA-256, sorted, repeats included."""
    return F.substring(F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list(sample_ids)), "\n"), "UTF-8"), 256), 1, 12)


def code_tokens(code: Column) -> Column:
    """Identifier-aware tokens: cut at non-alphanumerics and at camel-case humps, lower."""
    humps = F.regexp_replace(code, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda t: t != "")


def relative_path(path: Column, root: Column) -> Column:
    """A path below the root without it; any other path as it is."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)
