"""Text scalars as column expressions: normalising, word search, stems, glosses, script counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD_CHAR = r"[\p{L}\p{N}_]"
#: Words that carry no meaning of their own.
STOP_WORDS = {
    "english": "a an the am are is was were be been being i me my you your he she it we they our their this that these those in on at to of for from and or".split(),
    "georgian": "მე ჩემი ჩემს ჩემმა ვარ არის არიან იყო იყოს ეს ესეც ის მას მასაც შენ თქვენ ჩვენ".split(),
}
#: Markers of figurative senses.
FIGURATIVE = {"ru": ["переносное значение", "перен."], "ka": ["გადატანილი მნიშვნელობით", "გადატ."]}
#: Preverbs, two letters before one.
PREVERBS = ["გა", "გო", "გე", "და", "დო", "წა", "მე", "მო", "შე", "ა", "ო", "ე"]
#: Case endings, those that may carry an emphatic vowel, such vowels, plural marks, and vowels.
CASE_ENDINGS = ["იშე", "შე", "იშა", "შა", "იშ", "შ", "იშოთ", "შოთ", "ით", "ოთ", "ო", "თ", "კ", "ს", "ც"]
EMPHATIC_ENDINGS = ["კ", "ს", "ც", "იშ", "შ", "ით", "თ", "ოთ", "ო", "იშოთ", "შოთ"]
EMPHATIC, PLURALS, VOWELS = ["ი", "ჷ", "უ"], ["ეფ", "ენ", "ემ"], "აეიოუჷ"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = "“”„’"


def compact(c: Column) -> Column:
    """Null as empty; outer white space off, inner runs to one space."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def strip_space(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    return F.lower(compact(c))


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscores, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"{WORD_CHAR}+"), F.lit(0)), F.lower)


def word_pattern(word: Column, standalone: bool) -> Column:
    """Up to two characters literally, else characters with punctuation allowed between them; (?iu)."""
    quoted = F.transform(F.split(word, ""), lambda ch: F.concat(F.lit("\\Q"), ch, F.lit("\\E")))
    body = F.when(F.length(word) <= 2, F.concat(F.lit("\\Q"), word, F.lit("\\E"))).otherwise(F.array_join(quoted, r"[^\p{L}\p{N}_\s]*"))
    return F.concat(F.lit(rf"(?iu)(?<!{WORD_CHAR})"), body, F.lit(rf"(?!{WORD_CHAR})")) if standalone else F.concat(F.lit("(?iu)"), body)


def is_standalone_match(text: Column, word: Column) -> Column:
    w = compact(word)
    return F.coalesce((w != "") & F.regexp_like(text, word_pattern(w, True)), F.lit(False))


def is_substring_match(text: Column, word: Column) -> Column:
    w = compact(word)
    return F.coalesce((w != "") & (F.contains(text, w) | F.regexp_like(text, word_pattern(w, False))), F.lit(False))


def is_low_value(word: Column, language: str, count: Column) -> Column:
    return (count > 1) & F.lower(word).isin(STOP_WORDS.get(language, []))


def strip_token(word: Column, quotes: bool = True) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION + (QUOTES if quotes else "")))


def english_variants(word: Column) -> Column:
    """The token, its lower case, and its likely singulars, each once, in order."""
    w = F.btrim(word, F.lit(PUNCTUATION + QUOTES))
    low = F.lower(w)
    n = F.length(low)
    possessive = F.when(low.endswith("'s") & (n > 2), F.substring(low, F.lit(1), n - 2))
    plural = F.when(low.endswith("ies") & (n > 4), F.concat(F.substring(low, F.lit(1), n - 3), F.lit("y"))).when(low.endswith("s") & (n > 3) & ~low.endswith("ss"), F.substring(low, F.lit(1), n - 1))
    return F.filter(F.array_distinct(F.array_compact(F.array(w, low, possessive, plural))), lambda x: F.btrim(x) != "")


def georgian_variants(word: Column) -> Column:
    w = F.btrim(word, F.lit(PUNCTUATION + QUOTES))
    n = F.length(w)
    out = [w]
    for ending, least in (("ები", 4), ("ში", 3)):
        stem = F.when(w.endswith(ending) & (n > least), F.substring(w, F.lit(1), n - len(ending)))
        out += [stem, F.concat(stem, F.lit("ი"))]
    return F.filter(F.array_distinct(F.array_compact(F.array(*out))), lambda x: F.btrim(x) != "")


def suffix_strip(word: Column, endings: list[str], least: int = 3, vowels: str = VOWELS, plurals: list[str] = PLURALS, nominative: str = "ი") -> Column:
    """Candidate stems after the first ending that fits, longest first: for a consonant stem with the nominative before
    without; then likewise without a plural mark."""
    ends = sorted(set(endings), key=lambda e: (-len(e), e))
    hit = F.try_element_at(F.filter(F.array(*map(F.lit, ends)), lambda e: F.endswith(word, e) & (F.length(word) - F.length(e) >= least)), F.lit(1))
    stem = F.substring(word, F.lit(1), F.length(word) - F.length(hit))

    def forms(s: Column) -> list[Column]:
        consonant = ~F.substring(s, -1, 1).isin(list(vowels))
        return [F.when(consonant, F.concat(s, F.lit(nominative))), s]

    out = forms(stem)
    for p in plurals:
        base = F.when(stem.endswith(p) & (F.length(stem) >= len(p) + least), F.substring(stem, F.lit(1), F.length(stem) - len(p)))
        out += forms(base)
    return F.filter(F.array_distinct(F.array_compact(F.array(*out))), lambda x: x != word)


def case_strip(word: Column) -> Column:
    """suffix_strip for words of four letters and more in Mkhedruli."""
    endings, w = CASE_ENDINGS + [e + v for e in EMPHATIC_ENDINGS for v in EMPHATIC], F.trim(word)
    return F.when((F.length(w) >= 4) & w.rlike("[ა-ჿ]"), suffix_strip(w, endings)).otherwise(F.array().cast("array<string>"))


def preverb_strip(word: Column, preverbs: list[str] = PREVERBS, least: int = 5) -> Column:
    """The word without its first preverb, where three letters or more stay; null if none fits."""
    rule = "|".join(sorted(preverbs, key=lambda p: -len(p)))
    stem = F.regexp_extract(word, rf"^(?:{rule})(.{{3,}})$", 1)
    return F.when(F.length(word) >= least, F.nullif(stem, F.lit("")))


def gloss_segment(c: Column) -> Column:
    edge = F.lit(" ;,\n\t")
    x = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), edge)
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"(?U)^\d+\.\s*", ""), r"(?U)\s+\d+\.$", ""), edge)


def figurative_split(c: Column, markers: list[str]) -> Column:
    """struct(primary, secondary): parted at the earliest marker; secondary null without one or when empty."""
    low = F.lower(c)
    found = [F.struct(F.when(F.locate(m, low) > 0, F.locate(m, low)).alias("at"), F.lit(-len(m)).alias("n")) for m in markers]
    first = F.array_min(F.filter(F.array(*found), lambda s: s["at"].isNotNull()))
    tail = F.substring(c, first["at"] - first["n"], F.length(c))
    primary = F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first["at"] - 1))
    return F.struct(gloss_segment(primary).alias("primary"), F.when(first.isNotNull(), F.nullif(gloss_segment(tail), F.lit(""))).alias("secondary"))


def dictionary_entry(mingrelian: Column, russian: Column, georgian: Column) -> Column:
    """The lines of a four-column dictionary's entry: each language's primary and figurative meaning, where there is one."""
    lines = [F.concat(F.lit("Mingrelian: "), F.coalesce(mingrelian, F.lit("")))]
    for name, c, code in (("Russian", russian, "ru"), ("Georgian", georgian, "ka")):
        split = figurative_split(c, FIGURATIVE[code])
        lines.append(F.when(split["primary"] != "", F.concat(F.lit(f"{name} primary meaning: "), split["primary"])))
        lines.append(F.concat(F.lit(f"{name} secondary figurative meaning: "), split["secondary"]))
    return F.concat_ws("\n", *lines)


def bridge_gloss(russian: Column, georgian: Column, target: str | None) -> Column:
    """struct(gloss, language): the primary meaning to translate by: Russian first for English, else Georgian first."""
    order = [("ru", russian), ("ka", georgian)] if target == "english" else [("ka", georgian), ("ru", russian)]
    found = [F.when(p != "", F.struct(p.alias("gloss"), F.lit(code).alias("language"))) for code, c in order for p in [figurative_split(c, FIGURATIVE[code])["primary"]]]
    return F.coalesce(*found, F.struct(F.lit("").alias("gloss"), F.lit("").alias("language")))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Texts of these characters alone are composed as they are.
COMPOSED = r"^[\x{0}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{10a0}-\x{10ff}\x{2010}-\x{201f}]*$"


def composed(rows: DataFrame, column: str) -> DataFrame:
    """rows with column in Unicode's composed form (NFC), in one pass. Only texts that may change leave the JVM."""
    safe = F.coalesce(F.col(column).rlike(COMPOSED), F.lit(True))
    return rows.withColumn(column, F.coalesce(F.when(safe, F.col(column)), _nfc(F.when(~safe, F.col(column)))))


def clean_visitor_id(c: Column) -> Column:
    x = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), x)


def script_counts(c: Column) -> dict[str, Column]:
    return {"mkhedruli": F.regexp_count(c, F.lit("[ა-ჿ]")), "latin": F.regexp_count(c, F.lit("[A-Za-z]")), "cyrillic": F.regexp_count(c, F.lit("[Ѐ-ӿ]"))}


def script_gate(c: Column, target: str) -> Column:
    """Only the target's script, at most two filled lines, no wrapper label."""
    n = script_counts(c)
    script = (n["latin"] > 0) & (n["mkhedruli"] == 0) if target == "english" else (n["mkhedruli"] > 0) & (n["latin"] == 0)
    lines = F.size(F.filter(F.split(F.btrim(c, F.lit(" \n\t\r")), "\n+"), lambda x: x != ""))
    wrapper = c.rlike(r"(?i)(?:^|\s)(?:translation|translated|output|answer|final)(?:\s|:|$)")
    return script & (n["cyrillic"] == 0) & (lines <= 2) & ~wrapper


def coverage_tokens(c: Column, target: str = "english") -> Column:
    """Lower-cased letters and digits, joining marks removed first; Mingrelian words lose one final vowel. For text that is
    composed(), as coverage() and signatures() make it."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[-‐‑‒–—=·•]", "")
    t = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(t, lambda w: F.regexp_replace(w, "(?<=.)[აეიოუჷ]$", "")) if target == "mingrelian" else t
