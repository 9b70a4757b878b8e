"""Column expressions over text: words, sentences, entities, quantities, keys and labels."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and limits that decide results.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were "
    "will with which what who how when where why does do did can should must may our your their than then "
    "there these those also into over per after before about most latest recent current new newest"
).split()
VERBS = (
    "fell rose decreased increased reduced recovered processed affects affected is are was were "
    "be been may have has had should must shall will tightened mailed expected"
).split()
ENTITY_PATTERNS = {
    "campaign": r"\b[0-9]{2}V-?[0-9]{3}(?:[0-9]{3})?\b",
    "part_number": r"\b[0-9]{2}-[0-9]{4}\b|\b[0-9]{7,10}\b|\b[A-Z][0-9]{5,}\b",
    "model": r"\b[A-Z]{1,4}-?[0-9]{1,4}[A-Z]?\b",
    "year": r"\b(?:19|20)[0-9]{2}\b",
}
QUANTITY = r"(?i)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)\s?(Nm|bar|km|kWh|percent|%|tonnes|hours|cubic metres|degrees|kg|mm)\b"
EMAIL, IBAN, PHONE = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\b[A-Z]{2}[0-9]{2}(?:\s?[A-Z0-9]{4}){3,7}\b", r"\+?[0-9][0-9\s/-]{8,}[0-9]"
MULTI_HOP = r"(?i)\b(which|what)\b.*\b(part|parts|fit|fits|need)\b.*\b(recall|campaign|affected)\b|\b(affected by|related to|linked to)\b"
TEMPORAL = r"(?i)\b(latest|most recent|current|newest|this year|last year)\b"
EXPERIENCE = r"(?i)\b(last time|previously|before|lesson|learned|again)\b"
PAGE_NUMBER_KEYS = ("#", "page #", "page # of #", "# / #", "- # -")
BLANK, WORD_END = r"[\t\n\f\r ]", r"(?!\w)"  # what \s means in SQL, and \b after a word
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # what SQL trims
WORD, SENTENCE_END, TOKEN_CHARS = r"[\p{L}\p{N}]+", r"(?<=[.!?])\s+|\n+", 4


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def bounded(pattern: str) -> str:
    """A pattern for Spark whose \\b is SQL's: between ASCII word characters and all others."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, one-character words included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: F.length(w) > 1)


def content_words(text: Column) -> Column:
    stop = strings(STOP_WORDS)
    return F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))


def bigrams(ws: Column) -> Column:
    return F.when(F.size(ws) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b))
    )


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) > 3) & ~s.startswith("|---"))


def normalized_entity(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def entities(text: Column) -> Column:
    """Sorted normalised campaigns, part numbers, models and years."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(bounded(p)), 0) for p in ENTITY_PATTERNS.values()))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, normalized_entity), lambda e: F.length(e) >= 3)))


def quantities(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(bounded(QUANTITY)), 0)


def estimated_tokens(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / TOKEN_CHARS))).cast("long")


def dedup_key(text: Column) -> Column:
    """SHA-1 of the text in lower case with single spaces."""
    return F.sha1(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")).cast("binary"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def snippet(text: Column, width: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def family(document: Column) -> Column:
    return F.regexp_replace(document, "[0-9]+", "*")


def redacted(text: Column) -> Column:
    out = text
    for pattern, label in ((EMAIL, "<email>"), (IBAN, "<iban>"), (PHONE, "<phone>")):
        out = F.regexp_replace(out, bounded(pattern), label)
    return out


def boilerplate_key(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[0-9]+", "#"))


def rounded(value: Column, digits: int) -> Column:
    """Round as SQL does: the scaled binary number half away from zero, where F.round() rounds its decimal digits."""
    return F.round(value.cast("double") * 10.0**digits) / 10.0**digits


def ocr_quality(text: Column) -> Column:
    """Share of characters in plausible words and numbers."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda t: F.length(t) > 0)
    good = F.filter(parts, lambda t: t.rlike(r"""^[(\["']?\p{L}{3,}[)\]"'.,;:!?]*\z""") | t.rlike(r"^[0-9]+([.,:/-][0-9]+)*[.,;:]?\z"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, t: n + F.length(t))
    return F.when(total(parts) == 0, 0.0).otherwise(total(good) / total(parts))


def markdown_table(rows: Column) -> Column:
    """A pipe table from an array of rows; short rows are padded to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cells = lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.concat(cells(r), F.array_repeat(F.lit(""), width - F.size(r))), "|"), F.lit("|"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")


def citation(document: Column, page: Column) -> Column:
    return F.when(page.isNull(), document).otherwise(F.concat(document, F.lit(" p."), page.cast("string")))


def where_label(page_start: Column, page_end: Column, record: Column, source_format: Column) -> Column:
    pages = F.when(page_start == page_end, F.concat(F.lit("p."), page_start.cast("string"))).otherwise(F.concat(F.lit("p."), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.when(page_start.isNotNull(), pages).when(source_format.isin("text", "pdf-text"), "text").otherwise(F.concat(F.lit("row "), record.cast("string")))


def safe_key(raw: Column) -> Column:
    """URL-safe base64 of a key, or its SHA-256 where that is longer than 1000 characters."""
    coded = F.translate(F.base64(raw.cast("binary")), "+/\r\n", "-_")
    return F.when(F.length(coded) <= 1000, coded).otherwise(F.sha2(raw.cast("binary"), 256))


def pdf_date(value: Column) -> Column:
    """ISO date of D:YYYYMMDD..., null if malformed."""
    digits = F.substring(F.regexp_replace(value, "^D:", ""), 1, 8)
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(digits.rlike("^[0-9]{8}$"), iso.try_cast("date").cast("string"))


def routes(question: Column) -> Column:
    """The memories to ask, in order of trust."""
    has = F.size(entities(question)) > 0
    return (
        F.when(question.rlike(bounded(MULTI_HOP)) & has, strings(["graph", "facts", "semantic"])).when(question.rlike(bounded(TEMPORAL)), strings(["facts", "fresh"]))
        .when(question.rlike(bounded(EXPERIENCE)), strings(["episodic", "semantic"])).when(has, strings(["facts", "semantic"])).otherwise(strings(["semantic"]))
    )


def salience(sentence: Column, goal: Column) -> Column:
    shared = lambda f: F.size(F.array_intersect(f(goal), f(sentence)))
    return shared(content_words) + 2 * shared(entities) + F.when(F.size(quantities(sentence)) > 0, 1.5).otherwise(0.0)


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression for lower-case text."""
    out, k = "", 0
    glob = glob.lower()
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            k = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c)
        k += 1
    return f"^{out}$"


def normalized_line(line: Column) -> Column:
    """NFKC without soft hyphens, with single spaces; Spark has no such function, so pandas does it."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).replace("\u00ad", ""))

    return F.trim(F.regexp_replace(nfkc(line), "[ \\t\u00a0]+", " "))


def color_hex(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(value.cast("long"))), 6, "0"))


def duration_days(value: Column, default: int = 365) -> Column:
    """Days of an ISO duration P<n>D."""
    n = F.regexp_extract(value, "^P([0-9]+)D$", 1)
    return F.when(F.length(n) > 0, n.try_cast("long")).otherwise(default)


def tenant_name(prefix: str, team: Column, kind: Column, limit: int = 128) -> Column:
    """A table name for a tenant: lower case, other characters as dashes, at most limit long."""
    clean = F.trim(F.regexp_replace(F.lower(team), "[^a-z0-9-]+", "-"), F.lit("-"))
    return F.substring(F.concat_ws("-", F.lit(prefix), clean, kind), 1, limit)


def observation_line(t: Column, source: Column, text: Column) -> Column:
    return F.concat(F.lit("[t"), t.cast("string"), F.lit("] "), source, F.lit(": "), text)


def needs_ocr(native_chars: Column, coverage: Column, min_chars: int = 40, min_image: float = 0.3) -> Column:
    """A page with little text and much image."""
    return (native_chars < min_chars) & (coverage >= min_image)
