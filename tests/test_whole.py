"""Extraction and figurative senses on every row, against plain versions that follow the rules line by line."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from glossweave.functions import extract, text
from glossweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
OPEN, CLOSE = "<<<TRANSLATION>>>", "<<<END_TRANSLATION>>>"
ODD = [
    None, "", " \n\t", "plain", "'quoted'", "a\nb\n\n c ", "`x`\r\n\"y\"", "- bullet\n1. one\nNotes: n\nlast line", "a -> b\n**bold**", "გამარჯობა\nhello", "გამარჯობა abc\n- hello", "x" * 181,
    "x" * 181 + "\nshort\n" + "y" * 200, "Translation: one\ntext\nFinal  translation:\n`two`", "Translation:\n", f"{OPEN}{CLOSE}\nafter", f"{OPEN}\nFINAL_TRANSLATION_HERE: -\n{CLOSE}\nrest", f"{OPEN} 'a'\n\n`b` {CLOSE} c",
    f"x {OPEN}\nTranslation: 'q'", "a\u2028b\x85c", "a\x0bb\x1ec", "\u00a0padded\u2003", "'\tx", "translation:\u00a0a\u2003b", "1)\u00a0item", "a\u2028b\u2029c", "Based on this\nit is", "'\t'\n\"", "- \"Translation: z\"",
]


def clean(s):
    out = []
    for x in (y.strip() for y in s.splitlines()):
        if x and x not in (OPEN, CLOSE) and not re.fullmatch(r"(?i)FINAL_TRANSLATION_HERE[:\-\s]*", x):
            out.append(re.sub(r"(?i)^(final\s+)?translation\s*:\s*", "", x).strip("`\"' "))
    return "\n".join(filter(None, out)).strip()


def fallback(s, target):
    words = r"notes?\s*:|based\s+on\b|to\s+translate\b|therefore\b|combining\b|putting\s+it\s+together\b|sentence\s+structure\b|grammar(atical)?\b|according\s+to\b"
    lines = [x for x in s.splitlines() if x.strip() and not any(m in x for m in (OPEN, CLOSE, "FINAL_TRANSLATION_HERE"))]
    lines = [clean(re.sub(r"^\s*([-*]\s+|\d+[.)]\s+)", "", x).strip("`\"' ")) for x in lines]
    lines = [x for x in lines if x and not re.match(rf"(?i)\s*([-*]\s+|\d+[.)]\s+|{words})", x) and "**" not in x and "->" not in x]
    for x in reversed(lines):
        own, latin = len(re.findall("[Ⴀ-ჿ]", x)), len(re.findall("[A-Za-z]", x))
        if len(x) <= 180 and (target == "english" and not own or target in ("georgian", "mingrelian") and own and latin <= max(2, own // 2)):
            return x
    return lines[-1] if lines and len(lines[-1]) <= 180 else ""


def plain_extract(s, target):
    s = s or ""
    for rule in (rf"(?s){OPEN}\s*(.*?)\s*{CLOSE}", rf"(?s){OPEN}\s*(.*)$"):
        if (m := re.search(rule, s)) and clean(m[1]):
            return clean(m[1])
    labels = re.findall(r"(?im)^(?:final\s+translation|translation)\s*:\s*(.+)$", s)
    return labels and clean(labels[-1]) or fallback(s, target) or s.strip()


def wrap(turn, s):
    return [f"Notes: x\n{OPEN}\n{s}\n{CLOSE} y", f"z {OPEN} {s}", f"Based on a\nFinal translation: {s}"][turn % 3]


def gloss(s):
    s = re.sub(r"\s+", " ", s).strip(" ;,\n\t")
    return re.sub(r"\s+\d+\.$", "", re.sub(r"^\d+\.\s*", "", s)).strip(" ;,\n\t")


def plain_split(s, marker=" the "):
    at = s.lower().find(marker)
    return (gloss(s), None) if at < 0 else (gloss(s[:at]), gloss(s[at + len(marker) :]) or None)


@pytest.mark.parametrize("target", ["english", "georgian", None])
def test_extract_odd_responses(spark, target):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, r string")
    got = {r.i: r.e for r in rows.select("i", extract.extract_translation(F.col("r"), target).alias("e")).collect()}
    assert got == {i: plain_extract(x, target) for i, x in enumerate(ODD)}


def test_extract_every_row(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = collections.Counter((r.conv_id, r.turn, r.extracted) for r in QUERIES["extract_translation"](spark, SF).collect())
    assert sum(got.values()) == len(rows)
    assert got == collections.Counter((r.conv_id, r.turn, plain_extract(wrap(r.turn, r.text or ""), "english")) for r in rows)


def test_figurative_every_line(spark):
    odd = ["", "no marker", "1. one the two 2.", "a\u00a0 the  b;,", " the ", "3.\u00a0x THE y\u00a04.", "At The end the rest", "a\u00a0\u2003b the c\u00a0"]
    x = spark.createDataFrame(list(enumerate(odd)), "i int, g string")
    assert {r.i: tuple(r.f) for r in x.select("i", text.figurative_split(F.col("g"), [" the "]).alias("f")).collect()} == {i: plain_split(g) for i, g in enumerate(odd)}
    want = collections.Counter((r.doc_id, *plain_split(g)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for g in (r.text or "").split("\n"))
    assert collections.Counter(tuple(r) for r in QUERIES["figurative_split"](spark, SF).collect()) == want
