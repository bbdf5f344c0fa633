"""The final translation in a model's response, as a cascade of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers, and how lines of commentary begin.
OPEN, CLOSE, PLACEHOLDER = "<<<TRANSLATION>>>", "<<<END_TRANSLATION>>>", "FINAL_TRANSLATION_HERE"
SPACE, BREAK = r"[\s\x1c-\x1f]", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
COMMENTARY = r"(?iU)^\s*(?:[-*]\s+|\d+[.)]\s+|notes?\s*:|based\s+on\b|to\s+translate\b|therefore\b|combining\b|putting\s+it\s+together\b|sentence\s+structure\b|grammar(?:atical)?\b|according\s+to\b)"
LABEL = r"(?iU)^(final\s+)?translation\s*:\s*"
SHORT = 180


def strip(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def is_commentary(line: Column) -> Column:
    return line.rlike(COMMENTARY) | F.contains(line, F.lit("**")) | F.contains(line, F.lit("->"))


def clean_lines(text: Column) -> Column:
    """Lines without markers, placeholders, labels and quotes; empty ones go."""
    lines = F.transform(F.split(text, BREAK), strip)
    real = F.filter(lines, lambda x: (x != OPEN) & (x != CLOSE) & ~x.rlike(rf"(?iU)^{PLACEHOLDER}[:\-\s]*$"))
    return F.filter(F.transform(real, lambda x: F.btrim(F.regexp_replace(x, LABEL, ""), F.lit("`\"' "))), lambda x: x != "")


def _text(lines: Column) -> Column:
    return F.nullif(strip(F.array_join(lines, "\n")), F.lit(""))


def extract_translation(response: Column, target: str | None = None) -> Column:
    """Closed markers, open marker, last label, fallback line, then the whole text; the first that has text."""
    r = F.coalesce(response, F.lit(""))
    part = lambda rule: _text(clean_lines(F.regexp_extract(r, rule, 1)))
    labels = F.regexp_extract_all(r, F.lit(r"(?imdU)^(?:final\s+translation|translation)\s*:\s*(.+)$"), F.lit(1))
    label = _text(clean_lines(F.when(F.size(labels) > 0, F.element_at(labels, -1)).otherwise("")))
    raw = F.filter(F.split(r, BREAK), lambda x: (strip(x) != "") & ~F.contains(x, F.lit(OPEN)) & ~F.contains(x, F.lit(CLOSE)) & ~F.contains(x, F.lit(PLACEHOLDER)))
    bare = F.flatten(F.transform(raw, lambda x: clean_lines(F.btrim(F.regexp_replace(x, r"(?U)^\s*(?:[-*]\s+|\d+[.)]\s+)", ""), F.lit("`\"' ")))))
    lines = F.filter(F.transform(bare, strip), lambda x: (x != "") & ~is_commentary(x))
    georgian = lambda x: F.regexp_count(x, F.lit("[Ⴀ-ჿ]"))
    short = F.filter(lines, lambda x: F.length(x) <= SHORT)
    if target in ("mingrelian", "georgian"):
        fit = F.filter(short, lambda x: (georgian(x) > 0) & (F.regexp_count(x, F.lit("[A-Za-z]")) <= F.greatest(F.lit(2), F.floor(georgian(x) / 2))))
    elif target == "english":
        fit = F.filter(short, lambda x: georgian(x) == 0)
    else:
        fit = F.filter(short, lambda x: F.lit(False))
    last = F.when(F.size(fit) > 0, F.element_at(fit, -1)).when((F.size(lines) > 0) & (F.length(F.try_element_at(lines, F.lit(-1))) <= SHORT), F.try_element_at(lines, F.lit(-1)))
    return F.coalesce(part(rf"(?sU){OPEN}\s*(.*?)\s*{CLOSE}"), part(rf"(?sU){OPEN}\s*(.*)$"), label, last, strip(r))
