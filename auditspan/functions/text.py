"""String, array and JSON expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Characters that str.strip()/str.split() treat as blank.
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
          "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
BLANK_RUN = "[" + BLANKS + "]+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def uni(pattern: str) -> str:
    """Unicode-aware ``\\w``, ``\\s`` and ``\\b``."""
    return "(?U)" + pattern


def any_of(alternatives) -> str:
    """One case-insensitive pattern from a list of alternatives."""
    return "(?iU)" + "|".join(alternatives)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match, NULL when absent or empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def lookup(c: Column, mapping: dict, default=None) -> Column:
    """Small constant map as a CASE expression (stays in generated code)."""
    branches = list(mapping.items())
    out = F.when(c == F.lit(branches[0][0]), F.lit(branches[0][1]))
    for key, value in branches[1:]:
        out = out.when(c == F.lit(key), F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def indent(c: Column) -> Column:
    return F.length(c) - F.length(lstrip(c))


def collapse(c: Column) -> Column:
    """Trim and turn every run of blanks into one space."""
    return F.regexp_replace(strip(c), BLANK_RUN, " ")


def lines_of(content: Column) -> Column:
    """Content as an array of lines, universal newlines, no trailing empty line."""
    parts = F.split(content, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "",
                  F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_window(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, inclusive, clamped) of an array."""
    lo = F.greatest(first, F.lit(1))
    hi = F.least(last, F.size(lines))
    return F.when(hi >= lo, F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0)))) \
        .otherwise(F.array().cast("array<string>"))


def numbered(lines: Column, first: Column, cap: int | None = None) -> Column:
    """``n: text`` rows joined by newlines, the first row numbered *first*."""
    out = F.array_join(
        F.transform(lines, lambda t, i: F.concat((i + first).cast("string"), F.lit(": "), t)),
        "\n")
    return out if cap is None else F.substring(out, 1, cap)


def matches(c: Column, pattern: str) -> Column:
    """Distinct trimmed matches in order of appearance.

    Plain ASCII text gives the same matches without the (slow) Unicode classes.
    """
    plain = pattern.replace("(?iU)", "(?i)", 1).replace("(?U)", "", 1)
    found = F.when(F.length(c) == F.octet_length(c),
                   F.regexp_extract_all(c, F.lit(plain), F.lit(0))) \
        .otherwise(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def snippet_probes(snippet: Column) -> Column:
    """The three longest distinctive lines of a quoted snippet."""
    rows = F.transform(
        lines_of(F.coalesce(snippet, F.lit(""))),
        lambda t: collapse(F.regexp_replace(t, uni(r"^\s*\d+\s*[:|]\s?"), "")))
    kept = F.filter(rows, lambda s: (F.length(s) >= 8) & ~s.contains("...")
                    & ~s.contains("\u2026") & ~s.rlike(uni(r"^[\W_]+$")))
    ranked = F.array_sort(F.transform(
        kept, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    return F.transform(F.slice(ranked, 1, 3), lambda x: x["s"])


def strip_html(c: Column) -> Column:
    out = F.regexp_replace(c, "<[^>]+>", "")
    out = F.replace(F.replace(out, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<"))
    return strip(F.coalesce(out, F.lit("")))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                      ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truncate(c: Column, n: int) -> Column:
    return F.substring(c.cast("string"), 1, n)


def safe_int(c: Column) -> Column:
    return c.try_cast("int")


def slug(c: Column, default: str = "client") -> Column:
    body = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(blank_to_null(F.substring(body, 1, 120)), F.lit(default))


def body_hash(body: Column) -> Column:
    return F.substring(F.sha2(body.cast("binary"), 256), 1, 16)


def json_text_length(c: Column) -> Column:
    """Length of the text once encoded as an ASCII JSON string."""
    c = F.coalesce(c, F.lit(""))
    # counted by their matches: few characters are escaped, so few are touched
    short = F.regexp_count(c, F.lit(r'["\\\n\r\t\x08\f]'))
    long_ = F.regexp_count(c, F.lit(r"[^\x08\x09\x0a\x0c\x0d\x20-\x7e]"))
    astral = F.regexp_count(c, F.lit(r"[^\x{0}-\x{ffff}]"))
    return F.length(c) + 2 + short + 5 * long_ + 6 * astral


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / F.lit(fixed.CHARS_PER_TOKEN)).cast("bigint")


def compact_count(n: Column) -> Column:
    """1234 -> 1.2K, 1234567 -> 1.23M (integer arithmetic, halves up)."""
    def shown(unit: int, digits: int, mark: str) -> Column:
        scale = 10 ** digits
        parts = F.floor((n + unit // scale // 2) / (unit // scale)).cast("bigint")
        return F.concat(F.floor(parts / scale).cast("string"), F.lit("."),
                        F.lpad((parts % scale).cast("string"), digits, "0"), F.lit(mark))
    return (F.when(n >= 1_000_000, shown(1_000_000, 2, "M"))
            .when(n >= 1_000, shown(1_000, 1, "K")).otherwise(n.cast("string")))


def tolerant_json(c: Column) -> Column:
    """JSON object text inside a chatty answer, ``{}`` when there is none."""
    body = strip(F.regexp_replace(
        F.coalesce(c, F.lit("")), r"(?is)<(think|thinking|reasoning)>.*?</\1>", ""))
    tail = strip(F.substring_index(body, "</think>", -1))
    first_end = F.locate("</think>", body)
    body = F.when(first_end > 0, strip(F.substr(body, first_end + 8))).otherwise(tail)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", strip(fenced)).otherwise(body)
    start = F.locate("{", body)
    last = F.length(body) - F.locate("}", F.reverse(body)) + 1
    outer = F.when((start > 0) & (start < last), F.substr(body, start, last - start + 1))

    def valid(x: Column) -> Column:
        return F.try_parse_json(x).isNotNull()

    return (F.when(body == "", F.lit("{}")).when(valid(body), body)
            .when(valid(outer), outer).otherwise(F.lit("{}")))


def error_cause(message: Column, status: Column | None = None) -> Column:
    """Cause label of a model or HTTP error; the first matching cause wins."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for cause, codes, words in fixed.ERROR_CAUSES:
        hit = contains_any(low, words)
        if codes and status is not None:
            hit = F.coalesce(status.isin(*codes), F.lit(False)) | hit
        out = F.when(hit, F.lit(cause)) if out is None else out.when(hit, F.lit(cause))
    return out.otherwise(F.lit("unknown"))


def context_window(model: Column) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for hint, size in fixed.CONTEXT_WINDOWS:
        hit = low.contains(hint)
        out = F.when(hit, F.lit(size)) if out is None else out.when(hit, F.lit(size))
    return out.otherwise(F.lit(fixed.DEFAULT_CONTEXT_WINDOW))


def batch_budget(window: Column, reasoning: Column, stated: Column | None = None,
                 explicit: Column | None = None) -> Column:
    """Input tokens one batch may hold.

    *stated* is a window declared by a profile (reserve kept proportionate),
    *explicit* an operator override; both may be NULL per row.
    """
    reserve = F.when(reasoning, F.lit(fixed.OUTPUT_RESERVE_REASONING)) \
        .otherwise(F.lit(fixed.OUTPUT_RESERVE_NORMAL))
    guessed = F.greatest(window - reserve - fixed.PROMPT_OVERHEAD_TOKENS, F.lit(20_000))
    out = guessed
    if explicit is not None:
        out = F.when(explicit.isNotNull() & ~explicit.isin(80_000, 150_000), explicit) \
            .otherwise(out)
    if stated is not None:
        kept = F.least(reserve, F.floor(stated / 4))
        out = F.when(F.coalesce(stated, F.lit(0)) > 0, F.greatest(
            stated - kept - fixed.PROMPT_OVERHEAD_TOKENS, F.lit(2_000))).otherwise(out)
    return out.cast("bigint")


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(
        F.lower(k).isin(*fixed.SENSITIVE_HEADERS), F.lit("<redacted>")).otherwise(v))


def missing_headers(headers: Column, base_url: Column) -> Column:
    """Names of wanted security headers absent from a response."""
    present = F.transform(F.map_keys(headers), F.lower)
    wanted = [F.when(~F.array_contains(present, k), F.lit(name))
              for k, name in fixed.WANTED_HEADERS.items()]
    wanted.append(F.when(base_url.startswith("https://")
                         & ~F.array_contains(present, "strict-transport-security"),
                         F.lit("Strict-Transport-Security")))
    return F.array_compact(F.array(*wanted))


def missing_cookie_flags(cookie: Column) -> Column:
    low = F.lower(F.coalesce(cookie, F.lit("")))
    absent = F.array_compact(F.array(*[
        F.when(~low.contains(token), F.lit(name)) for name, token in fixed.COOKIE_FLAGS]))
    return F.when(low != "", absent).otherwise(F.array().cast("array<string>"))


def error_disclosure(status: Column, body: Column) -> Column:
    """Evidence around a server-error signature in a 5xx body, else NULL."""
    around = r"(?s).{0,60}" + uni(fixed.SERVER_ERROR) + r".{0,60}"
    return F.when((status >= 500) & body.rlike(fixed.SERVER_ERROR),
                  F.substring(strip(F.regexp_extract(body, around, 0)), 1, 300))


def database_error(body: Column) -> Column:
    return F.coalesce(body.rlike(fixed.DATABASE_ERROR), F.lit(False))
