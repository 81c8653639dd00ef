"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a secret, in order, and what takes its place.
SECRETS = [
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_SECRET]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b", "Bearer [REDACTED_SECRET]"),
    (r"""(?i)\b(api[_-]?key|token|secret|password)\b(\s*[:=]\s*)(["']?)[^\s"']{8,}""", "$1$2$3[REDACTED_SECRET]"),
]
#: Kinds of PLC addresses by vendor, in order of trial.
IEC = [("DI", r"%IX\d+(?:\.\d+)?"), ("DO", r"%QX\d+(?:\.\d+)?"), ("AI", r"%I[WDL]\d+"), ("AO", r"%Q[WDL]\d+"), ("Memory", r"%M[XWDL]\d+(?:\.\d+)?")]
SIEMENS = [
    ("DB", r"DB\d+\.DB[XBWD]\d+(?:\.\d+)?"), ("DI", r"I\d+\.\d+"), ("DO", r"Q\d+\.\d+"), ("AI", r"(?:PIW|AIW|IW|ID|IL)\d+"),
    ("AO", r"(?:PQW|AQW|QW|QD|QL)\d+"), ("Memory", r"M\d+\.\d+|M[BWDL]?\d+"),
]
MITSUBISHI = [("DI", r"X[0-9A-F]+"), ("DO", r"Y[0-9A-F]+"), ("Memory", r"(?:M|L|B)[0-9A-F]+"), ("Data Register", r"(?:D|W|R|ZR)\d+")]
#: Words that name a category of signal, the first category first, and its severity.
CATEGORIES = {
    "SAFETY": ("red", ["SAFETY", "ESTOP", "E_STOP", "EMERGENCY", "SAFE"]),
    "FAULT": ("red", ["FAULT", "ERROR", "TRIP"]),
    "ALARM": ("orange", ["ALARM", "ALM"]),
    "INTERLOCK": ("yellow", ["INTERLOCK", "PERMISSIVE", "INHIBIT", "BLOCK"]),
    "WARNING": ("blue", ["WARNING", "WARN"]),
}
CJK = r"[\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3100}-\x{318f}\x{31a0}-\x{31bf}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a960}-\x{a97f}\x{ac00}-\x{d7ff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}]"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, needle: str, before: int = 48, after: int = 96) -> Column:
    """The first match with some characters on either side, white space collapsed; null without a match."""

    def cut(x: Column) -> Column:
        start = F.greatest(x["at"] - before, F.lit(1))
        stop = x["at"] + len(needle) + after
        out = F.concat(
            F.when(start > 1, F.lit("... ")).otherwise(F.lit("")), F.substr(x["flat"], start, stop - start),
            F.when(stop <= F.length(x["flat"]), F.lit(" ...")).otherwise(F.lit("")),
        )
        return F.when(x["at"] > 0, out)

    # Each step once a row, and a text in which not even the single words of the needle stand is not collapsed.
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    found = once(collapse(text), lambda flat: once(F.struct(flat.alias("flat"), F.locate(needle.lower(), F.lower(flat)).alias("at")), cut))
    maybe = reduce(lambda x, y: x & y, [F.contains(F.lower(text), F.lit(w)) for w in needle.lower().split()], F.lit(True))
    return F.when(maybe, found)


def find_all(text: str, needle: str) -> list[int]:
    """Places of all matches that do not overlap."""
    out, at = [], text.find(needle)
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + len(needle))
    return out


def comparable(text: Column) -> Column:
    """A text in lower case of the same length: the one letter whose lower case is longer (İ) is taken as i."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def occurrences(text: Column, needle: str) -> Column:
    """Places (from 0) of all matches that do not overlap, whatever their case; places are those of the text itself.

    A pandas function, as a fold of columns copies the list of places at each match.
    """
    low = needle.lower()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: find_all(x, low), na_action="ignore")

    return found(comparable(text))


def redact(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def fingerprint(domain: str, value: Column) -> Column:
    """SHA-1 of a versioned prefix, the domain and the value, separated by NUL."""
    return F.sha1(F.concat(F.lit(f"file-line-v1\0{domain}\0"), value))


def effective_line(line: Column) -> Column:
    """A line with white space collapsed; null if it has at most 3 bytes, or no letter, digit or underscore."""
    flat = collapse(line)
    return F.when((F.octet_length(flat) > 3) & F.rlike(flat, F.lit(r"[\p{L}\p{N}_]")), flat)


def truncate_middle(text: Column, most: int, marker: str = "…") -> Column:
    """At most ``most`` characters of a text: its ends, with a marker and the number left out between."""
    half = most // 2
    gone = F.length(text) - 2 * half
    short = F.concat(F.substr(text, F.lit(1), F.lit(half)), F.lit(marker), gone.cast("string"), F.lit(f" chars truncated{marker}"), F.right(text, F.lit(half)))
    return F.when(F.length(text) <= most, text).otherwise(short)


def head_tail(text: Column, cap: int) -> Column:
    """Struct of the first and last half of ``cap`` bytes and how many were left out between."""
    raw, half = F.encode(text, "UTF-8"), cap // 2
    n = F.octet_length(text)
    over = n > cap
    return F.struct(
        F.when(over, F.substr(raw, F.lit(1), F.lit(half))).otherwise(raw).alias("head"),
        F.when(over, F.substr(raw, n - (cap - half) + 1, F.lit(cap - half))).alias("tail"),
        F.when(over, n - cap).otherwise(0).cast("long").alias("omitted"),
    )


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def render(template: str, **columns: str) -> Column:
    """``{name}`` is a column's text (null: empty); ``{{`` and ``}}`` are braces. Unknown names stay."""
    parts, i = [], 0
    while i < len(template):
        if template[i : i + 2] in ("{{", "}}"):
            parts.append(F.lit(template[i]))
            i += 2
        elif template[i] == "{" and (j := template.find("}", i)) > 0 and template[i + 1 : j] in columns:
            parts.append(F.coalesce(F.col(columns[template[i + 1 : j]]).cast("string"), F.lit("")))
            i = j + 1
        else:
            parts.append(F.lit(template[i]))
            i += 1
    return F.concat(*parts)


def epoch_millis(x: Column) -> Column:
    """Seconds or milliseconds as milliseconds, told apart by size."""
    return F.when(x < 1577836800000, x * 1000).otherwise(x)


def classify_address(address: Column) -> Column:
    """Struct of vendor and io_type of a PLC address; the most distinct notation is tried first."""
    value = F.upper(F.regexp_replace(address, r"\s+", ""))
    out = F.struct(F.lit("Unknown").alias("vendor"), F.lit("Unknown").alias("io_type"))
    for vendor, rules in reversed([("Beckhoff/CODESYS", IEC), ("Siemens", SIEMENS), ("Mitsubishi", MITSUBISHI)]):
        for kind, pattern in reversed(rules):
            hit = F.rlike(value, F.lit(f"^(?:{pattern})$"))
            out = F.when(hit, F.struct(F.lit(vendor).alias("vendor"), F.lit(kind).alias("io_type"))).otherwise(out)
    return out


def category(text: Column) -> Column:
    """Struct of category and severity of the first category with a word in the text; null if there is none."""
    up, out = F.upper(text), None
    for name, (severity, words) in CATEGORIES.items():
        hit = F.rlike(up, F.lit("|".join(words)))
        mine = F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"))
        out = F.when(hit, mine) if out is None else out.when(hit, mine)
    return out


def script_tag(text: Column) -> Column:
    latin, cjk = F.rlike(text, F.lit("[A-Za-z]")), F.rlike(text, F.lit(CJK))
    other = F.rlike(F.regexp_replace(F.regexp_replace(text, "[A-Za-z]+", ""), CJK, ""), F.lit(r"\p{L}"))
    n = latin.cast("int") + cjk.cast("int") + other.cast("int")
    return F.when(n == 0, "none").when(n > 1, "mixed").when(latin, "ascii_latin").when(cjk, "cjk").otherwise("other")


def slug(text: Column, most: int = 60) -> Column:
    return F.substr(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(1), F.lit(most))


#: Names that say nothing, with any digits behind.
GENERIC = ["tag", "var", "variable", "temp", "tmp", "data", "value", "test", "newtag", "newvariable", "unnamed", "signal", "flag"]


def naming_issues(name: Column) -> Column:
    """What is wrong with an identifier, as an array of rule names."""
    return F.array_compact(F.array(
        F.when(~F.rlike(name, F.lit("^[A-Za-z][A-Za-z0-9_]*$")), F.lit("format")),
        F.when(F.rlike(name, F.lit("^_|_$|__")), F.lit("underscores")),
        F.when(F.rlike(F.lower(name), F.lit(f"^({'|'.join(GENERIC)})[0-9]*$")), F.lit("generic")),
        F.when(F.length(name) < 2, F.lit("short")),
    ))


def usage(total_in: Column, cached: Column, out: Column) -> Column:
    """Struct of tokens that were not cached, and these with those put out."""
    fresh = F.greatest(total_in - F.greatest(cached, F.lit(0)), F.lit(0))
    return F.struct(fresh.alias("non_cached"), (fresh + F.greatest(out, F.lit(0))).alias("blended"))


def percent_left(used: Column, window: int, baseline: int = 12000) -> Column:
    """Share of a context window that remains beyond a baseline, rounded, from 0 to 100."""
    if window <= baseline:
        return F.lit(0)
    left = (F.lit(window - baseline) - F.greatest(used - baseline, F.lit(0))) * 100.0 / (window - baseline)
    return F.round(F.least(F.greatest(left, F.lit(0.0)), F.lit(100.0))).cast("long")


def citations(text: Column, tag: str = "citation") -> Column:
    """Contents of all closed ``<tag>`` blocks."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(x))


def without_tags(text: Column, tag: str) -> Column:
    """Text outside the blocks of a tag; one never closed reaches to the end."""
    return F.regexp_replace(text, f"(?s)<{tag}[^>]*>.*?(?:</{tag}>|$)", "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def fuzzy(text: Column, needle: str) -> Column:
    """Struct of ``places`` (from 0) of the needle's characters in order, whatever their case, each the first after the one before,
    and ``score``: what they span beyond the needle's length, less 100 for a match from the start (smaller is better).

    Null for a null text or without a match; an empty needle matches everything, with no places and the worst score. A fold of
    ``locate`` over the needle. The one letter whose lower case is two characters (İ) has both of them at its own place.
    """
    letters = [c for x in needle for c in x.lower()]
    none = F.array().cast("array<int>")
    if not letters:
        return F.when(text.isNotNull(), F.struct(none.alias("places"), F.lit(2**31 - 1).alias("score")))

    def following(low: Column) -> Callable[[Column, Column], Column]:
        last = lambda at: F.coalesce(F.get(at, F.size(at) - 1), F.lit(0))
        found = lambda at, c: once(F.call_function("locate", c, low, last(at) + 1), lambda p: F.when(p > 0, F.array_append(at, p)))
        return lambda at, c: F.when(at.isNotNull(), found(at, c))

    def scored(m: Column) -> Column:
        at, own = m["at"], m["own"]
        places = F.when(own.isNull(), F.transform(at, lambda p: p - 1)).otherwise(F.array_distinct(F.transform(at, lambda p: F.get(own, p - 1))))
        start = F.when(own.isNull(), at[0] - 1).otherwise(F.array_position(own, F.get(own, at[0] - 1)).cast("int") - 1)
        score = F.greatest(F.get(at, F.size(at) - 1) - start - len(letters), F.lit(0)) - F.when(start == 0, 100).otherwise(0)
        return F.when(at.isNotNull(), F.struct(places.alias("places"), score.alias("score")))

    # Only a text with İ has characters that stand at other places once it is in lower case.
    each = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.when(F.substr(text, i + 1, F.lit(1)) == "İ", F.array(i, i)).otherwise(F.array(i)))
    own = F.when(F.contains(text, F.lit("İ")), F.flatten(each))
    low = F.lower(F.translate(text, "Σ", "σ"))
    at = once(low, lambda x: F.aggregate(F.array(*map(F.lit, letters)), F.when(text.isNotNull(), none), following(x)))
    return once(F.struct(at.alias("at"), own.alias("own")), scored)


#: Digits of short hashes, and which addresses an engineering tool imports.
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
IMPORTABLE = r"(?:[IQM]\d+\.\d+|(?:PIW|PQW|AIW|AQW|IW|QW|ID|QD|IL|QL|MB|MW|MD|ML)\d+|DB\d+\.DB[XBWD]\d+(?:\.\d+)?)"


def project_name(stem: Column) -> Column:
    """A short project name from a file's stem: its first run of letters, digits and single hyphens or underscores, up to a part
    that names a list; never empty, never begun by a digit, at most 40 characters."""
    run = F.regexp_extract(stem, r"^[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*", 0)
    name = F.regexp_replace(F.when(run != "", run).otherwise(stem), r"(?is)_(?:PLC|IO|EPLAN)(?:_.*|$)", "")
    name = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    name = F.when(F.coalesce(name, F.lit("")) == "", "PROJECT").otherwise(name)
    return F.substr(F.when(F.rlike(name, F.lit("^[0-9]")), F.concat(F.lit("P_"), name)).otherwise(name), F.lit(1), F.lit(40))


def logical_address(address: Column) -> Column:
    """An address as the tool writes it: in capitals without spaces, with a percent sign where it can be imported."""
    a = F.replace(F.upper(F.trim(F.coalesce(address, F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(F.rlike(a, F.lit(f"^{IMPORTABLE}$")), F.concat(F.lit("%"), a)).otherwise(a)


def tag_type(io_type: Column, address: Column) -> Column:
    """The data type of a tag by its kind and address; empty if neither tells."""
    a = logical_address(address)
    starts = lambda p: F.rlike(a, F.lit("^" + p))
    memory = F.when(starts(r"%M\d+\.\d+"), "Bool").when(starts("%MB"), "Byte").when(starts("%MW"), "Word").when(starts("%M[DL]"), "DWord").otherwise("")
    db = F.when(F.contains(a, F.lit(".DBX")), "Bool").when(F.contains(a, F.lit(".DBB")), "Byte").when(F.contains(a, F.lit(".DBW")), "Word").when(F.contains(a, F.lit(".DBD")), "DWord").otherwise("")
    bit = io_type.isin("DI", "DO") | starts(r"%[IQM]\d+\.\d+$")
    word = F.when(starts("%[IQ][DL]"), "DInt").otherwise("Int")
    return F.when(bit, "Bool").when(io_type.isin("AI", "AO"), word).when(io_type == "Memory", memory).when(io_type == "DB", db).otherwise("")


def tag_name(project: Column, address: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(address, "^%+", ""), "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.substr(F.concat(project, F.lit("_"), F.when(name == "", "TAG").otherwise(name)), F.lit(1), F.lit(120))


def short_hash(seed: Column, digits: int = 4) -> Column:
    """The last ``digits`` digits of a number to the base 62."""
    place = lambda k: F.pmod(F.floor(seed / 62**k), F.lit(62)).cast("int") + 1
    return F.concat(*[F.substr(F.lit(BASE62), place(k), F.lit(1)) for k in range(digits - 1, -1, -1)])


def file_stem(id: Column, at: Column, slug: Column, most: int = 60) -> Column:
    """Time, short hash and slug of a summary's file name. The hash is of the last 32 bits of a UUID, or of the bytes of another
    id, summed in base 31."""
    uuid = F.rlike(id, F.lit("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))
    tail = F.conv(F.right(id, F.lit(8)), 16, 10).cast("long")
    codes = F.transform(F.split(F.hex(F.encode(id, "UTF-8")), "(?<=\\G..)"), lambda x: F.coalesce(F.conv(x, 16, 10).cast("long"), F.lit(0)))
    summed = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32)))
    name = F.regexp_replace(F.substr(F.regexp_replace(F.lower(slug), "[^a-z0-9]", "_"), F.lit(1), F.lit(most)), "_+$", "")
    head = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), short_hash(F.when(uuid, tail).otherwise(summed)))
    return F.when(F.coalesce(name, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("-"), name))
