"""Scalar functions whose results follow pandas and Python rather than Spark's defaults."""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even on the binary value, as numpy does; null and NaN stay."""
    scale = float(10**digits)
    return F.rint(_c(c).cast("double") * scale) / scale


def divide(a: Column | str, b: Column | str, otherwise: Column | None = None, *, by_zero: str = "null") -> Column:
    """Quotient; where the divisor is zero or either side null, ``otherwise`` (null by default).

    ``by_zero="float"`` divides by zero as data frames do: infinite with the dividend's sign, NaN for 0 / 0.
    """
    q = F.try_divide(_c(a), _c(b))
    if by_zero == "float":
        top = _c(a).cast("double")
        q = F.when((_c(b) == 0) & top.isNotNull(), F.when((top == 0) | F.isnan(top), F.lit(float("nan"))).otherwise(F.signum(top) * F.lit(float("inf")))).otherwise(q)
    elif by_zero != "null":
        raise ValueError(f"by_zero: {by_zero!r}")
    return q if otherwise is None else F.coalesce(q, otherwise)


def equals(c: Column | str, value) -> Column:
    """Equality that is False on null."""
    return _c(c).eqNullSafe(F.lit(value))


def flag(condition: Column) -> Column:
    """A comparison that is False where it would be null."""
    return F.coalesce(condition, F.lit(False))


def where(value: Column | str, condition: Column, otherwise) -> Column:
    """The value where the condition holds, else ``otherwise`` (also where the condition is null)."""
    return F.when(condition, _c(value)).otherwise(F.lit(otherwise))


def clip_lower(c: Column | str, least) -> Column:
    """At least ``least``; null stays null."""
    return F.when(_c(c).isNotNull(), F.greatest(_c(c), F.lit(least)))


def band(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step whose threshold is reached; null is ``otherwise``."""
    out = F.lit(otherwise)
    for threshold, label in sorted(steps, key=lambda s: s[0]):
        out = F.when(_c(c) >= threshold, F.lit(label)).otherwise(out)
    return out


def map_values(c: Column | str, table: Mapping[str, float]) -> Column:
    """Dictionary lookup; null where the key is null or missing."""
    if not table:
        return F.lit(None)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(c))


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; a null rule does not hold."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def title_case(c: Column | str) -> Column:
    """Every run of letters starts upper case and goes on in lower case (``x-ray`` -> ``X-Ray``)."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), "")


def slug(c: Column | str) -> Column:
    """Lower case; every run of other characters than letters and digits becomes one ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def slug_each(c: Column | str) -> Column:
    """Lower case; every single other character becomes a ``_``."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}]", "_")


def basename(path: Column | str) -> Column:
    """What follows the last ``/``."""
    return F.element_at(F.split(_c(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last ``.`` of the base name and what follows; empty without one or where the name starts with it."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def null_if_nan(c: Column | str) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(_c(c)), _c(c))


# --- parsing and printing of quantities -----------------------------------------------------------

# Unit letters and what they stand for, and the mark of an unknown quantity.
BINARY_UNITS = {"": 1, "K": 2**10, "M": 2**20, "G": 2**30, "T": 2**40}
TIME_UNITS = {"m": 60, "h": 3600, "d": 86400}
MEMORY_UNITS = {"Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40, "M": 10**6, "G": 10**9}
UNKNOWN = "—"


def _unit(c: Column, table: Mapping[str, int]) -> Column:
    return map_values(c, table).cast("double")


def parse_size(c: Column | str) -> Column:
    """Bytes of ``10``, ``4 KB``, ``1.5G``, ``2g`` (binary multiples); null where it is no size."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$"
    number, unit = F.regexp_extract(_c(c), pattern, 1), F.upper(F.regexp_extract(_c(c), pattern, 2))
    return F.when(_c(c).rlike(pattern), F.floor(number.try_cast("double") * _unit(unit, BINARY_UNITS)).cast("bigint"))


def parse_duration(c: Column | str) -> Column:
    """Seconds of ``5m``, ``2h``, ``7d``; null where it is no duration."""
    pattern = r"^\s*(\d+)([mhd])\s*$"
    return F.when(_c(c).rlike(pattern), (F.regexp_extract(_c(c), pattern, 1).try_cast("double") * _unit(F.regexp_extract(_c(c), pattern, 2), TIME_UNITS)).cast("bigint"))


def parse_memory_gb(c: Column | str) -> Column:
    """Whole GiB, rounded up and at least 1 where positive, of ``512Mi``, ``4Gi``, ``2Ti``, ``100G`` (decimal); 0 for null, null where it is no amount."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(Gi|Mi|G|M|Ti|Ki)\s*$"
    gib = F.regexp_extract(_c(c), pattern, 1).try_cast("double") * (_unit(F.regexp_extract(_c(c), pattern, 2), MEMORY_UNITS) / 2.0**30)
    return F.when(_c(c).isNull(), F.lit(0).cast("bigint")).when(_c(c).rlike(pattern), F.ceil(gib).cast("bigint"))


def human_bytes(c: Column | str) -> Column:
    """``512 B``, ``1.5 KB``, ... ``2.0 TB`` by multiples of 1024; below zero counts as zero, null is a dash."""
    v = F.greatest(_c(c).cast("bigint"), F.lit(0)).cast("double")
    shown = lambda size, unit: F.concat(F.format_string("%.1f", round_half_even(v / float(size), 1)), F.lit(f" {unit}"))
    out = shown(2**40, "TB")
    for unit, size in (("GB", 2**30), ("MB", 2**20), ("KB", 2**10)):
        out = F.when(v < size * 1024, shown(size, unit)).otherwise(out)
    out = F.when(v < 1024, F.concat(F.format_string("%d", v.cast("bigint")), F.lit(" B"))).otherwise(out)
    return F.when(_c(c).isNull(), F.lit(UNKNOWN)).otherwise(out)


def human_duration(c: Column | str) -> Column:
    """``4.2s`` below ten seconds, ``12s``, ``2m 14s``, ``8h 03m 12s``; below zero counts as zero, null is a dash.

    The last part is rounded by itself, half to even, so it can read 60.
    """
    v = F.greatest(_c(c).cast("double"), F.lit(0.0))
    minutes, hours = F.floor(v / 60), F.floor(v / 3600)
    of_hour = F.floor((v - hours * 3600) / 60)
    whole = lambda x: F.rint(x).cast("bigint")
    return (
        F.when(_c(c).isNull(), F.lit(UNKNOWN))
        .when(v < 10, F.concat(F.format_string("%.1f", round_half_even(v, 1)), F.lit("s")))
        .when(v < 60, F.format_string("%ds", whole(v)))
        .when(v < 3600, F.format_string("%dm %02ds", minutes, whole(v - minutes * 60)))
        .otherwise(F.format_string("%dh %02dm %02ds", hours, of_hour, whole(v - hours * 3600 - of_hour * 60)))
    )


def human_age(seconds: Column | str) -> Column:
    """``59s``, ``4m``, ``23h``, ``12d``, rounded down; below zero counts as zero, null is a hyphen."""
    v = F.greatest(F.floor(_c(seconds).cast("double")), F.lit(0)).cast("bigint")
    out = F.format_string("%dd", F.floor(v / 86400))
    for below, size, letter in ((86400, 3600, "h"), (3600, 60, "m"), (60, 1, "s")):
        out = F.when(v < below, F.format_string(f"%d{letter}", F.floor(v / size))).otherwise(out)
    return F.when(_c(seconds).isNull(), "-").otherwise(out)


def human_time(c: Column | str) -> Column:
    """``2026-04-18 14:32:07 UTC`` of a timestamp without zone; null is a dash."""
    return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit(UNKNOWN))


def thousands(c: Column | str) -> Column:
    """Whole number with commas; null is a dash."""
    return F.coalesce(F.format_number(_c(c).cast("bigint"), 0), F.lit(UNKNOWN))


def iso_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of an ISO text; without offset it is UTC, null where it is no time."""
    text = _c(c)
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two moments in microseconds, at least 0; null where one is unknown."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest((end - start) / F.lit(1e6), F.lit(0.0)))


def last_segment(c: Column | str, separator: str = ".") -> Column:
    """What follows the last separator; ``unknown`` for null and empty texts."""
    return F.when(_c(c).isNull() | (_c(c) == ""), "unknown").otherwise(F.substring_index(_c(c), separator, -1))


def looks_like_flag(c: Column | str) -> Column:
    """An option rather than a value: it starts with ``-``, but is neither ``-`` nor a number."""
    return _c(c).startswith("-") & (_c(c) != "-") & _c(c).try_cast("double").isNull()


# Classes of errors by what they say about a failed step.
FAILURE_CLASSES = {
    "CycleError": "cycle_detected",
    "ModuleNotFoundError": "import_error",
    "ImportError": "import_error",
    "CodecError": "serialization_error",
    "ShellTaskError": "shell_command_error",
    "NotebookTaskError": "shell_command_error",
    "IsADirectoryError": "invalid_path",
    "NotADirectoryError": "invalid_path",
    "PermissionError": "invalid_path",
}


def failure_kind(error: Column | str, message: Column | str) -> Column:
    """Kind of a failure from the error's class and message; what no rule names is the user's code, null too."""
    name = F.coalesce(_c(error), F.lit(""))
    low = F.lower(name)
    missing = F.when(_c(message).contains("did not create"), "output_validation_error").otherwise("missing_input")
    by_name = F.when(low.contains("env") | low.contains("container"), "env_mismatch").when(low.contains("cache"), "cache_error").otherwise("user_code_error")
    return F.coalesce(map_values(name, FAILURE_CLASSES), F.when(name == "FileNotFoundError", missing).otherwise(by_name))


# --- retries, resources, addresses ----------------------------------------------------------------


def backoff(base: Column, factor: Column, attempt: Column, most: Column) -> Column:
    """``min(base * factor ** (attempt - 1), most)`` seconds before a retry."""
    return F.least(base * F.pow(factor, attempt - 1), most)


def escalate(memory_gb: Column, factor: Column, attempt: Column, budget_gb: Column) -> Column:
    """Memory of a later attempt: ``ceil(memory * factor ** attempt)``, within the budget."""
    return F.least(F.ceil(memory_gb * F.pow(factor, attempt)).cast("bigint"), budget_gb)


def glob_to_regex(pattern: str) -> str:
    """A regular expression for ``*``, ``?`` and ``[...]`` patterns."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[^" + inside[1:] + "]" if inside.startswith("!") else "[" + inside + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


# Sub-kinds of path outputs by kind of asset and suffix.
SUB_KINDS = {
    "table": {".csv": "csv", ".tsv": "tsv"},
    "fig": {".png": "png", ".svg": "svg", ".html": "html", ".htm": "html"},
}


def sub_kind(kind: Column | str, path: Column | str) -> Column:
    """Sub-kind of a path kept as an asset of a kind; null where the kind does not take such a path."""
    known = {f"{k}|{suf}": name for k, table in SUB_KINDS.items() for suf, name in table.items()}
    return map_values(F.concat_ws("|", _c(kind), F.lower(suffix(path))), known)


def html_table_row(*cells: Column) -> Column:
    """A table row with its cells escaped; null cells are empty."""
    out = [F.lit("<tr>")]
    for c in cells:
        text = F.coalesce(c.cast("string"), F.lit(""))
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(safe))
        out += [F.lit("<td>"), text, F.lit("</td>")]
    return F.concat(*out, F.lit("</tr>"))


def byte_window(c: Column | str, start: Column | int, n: int) -> Column:
    """``n`` bytes of a text or binary from the zero-based position ``start``; shorter at the end."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.call_function("substring", _c(c).cast("binary"), (at + 1).cast("int"), F.lit(n))


def first_glob(c: Column | str, patterns: Mapping[str, str]) -> Column:
    """The value of the pattern that matches: an equal name first, then the first pattern in order; else null."""
    exact = [(_c(c) == p, v) for p, v in patterns.items()]
    globs = [(_c(c).rlike(glob_to_regex(p)), v) for p, v in patterns.items()]
    out = F.lit(None).cast("string")
    for condition, value in reversed([*exact, *globs]):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def parse_uri(c: Column | str) -> Column:
    """struct(scheme, bucket, namespace, key) of ``s3://b/k``, ``gs://b/k`` and ``oci://b@ns/k``; null where it is none."""
    pattern = r"^(s3|gs|oci)://([^/@]+)(?:@([^/]+))?/?(.*)$"
    part = lambda i: F.regexp_extract(_c(c), pattern, i)
    return F.when(_c(c).rlike(pattern), F.struct(part(1).alias("scheme"), part(2).alias("bucket"), F.nullif(part(3), F.lit("")).alias("namespace"), part(4).alias("key")))


def access_mode(explicit: Column, task: Column, pattern: Column, size: Column, default: Column, large: int = 2 * 2**30, available: Column | None = None) -> Column:
    """How a remote input is read: the reference's own mode, the task's, a pattern's, streaming from ``large`` bytes on, the default; without the streaming driver it is staged."""
    mode = F.coalesce(explicit, task, pattern, F.when(size >= large, F.lit("stream")), default)
    return mode if available is None else F.when((mode == "stream") & ~available, F.lit("stage")).otherwise(mode)


def redact(c: Column | str, secrets: Sequence[str], mask: str = "[redacted]") -> Column:
    """Every known secret replaced, longer ones first; empty secrets are ignored."""
    out = _c(c)
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(s), F.lit(mask))
    return out


def merge_maps(first: Column | str, second: Column | str) -> Column:
    """The entries of both maps; of equal keys the second map's value counts. A null map is empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(_c(first), empty), F.coalesce(_c(second), empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def redact_map(c: Column | str, keys: Sequence[str], secrets: Sequence[str] = (), mask: str = "[redacted]") -> Column:
    """Values of the named keys replaced whole, known secrets in the others."""
    return F.transform_values(_c(c), lambda k, v: F.when(k.isin(*keys), F.lit(mask)).otherwise(redact(v, secrets, mask)) if keys else redact(v, secrets, mask))


def canonical_map(c: Column | str) -> Column:
    """A map as JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(c)))))


def line_count(c: Column | str) -> Column:
    """Lines by newline; a last line without newline counts; empty text has none."""
    text = _c(c)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).when(text.endswith("\n"), breaks).otherwise(breaks + 1)


def fingerprint(*parts: Column) -> Column:
    """sha256 over the parts; null and the empty string differ, and so do values of neighbouring parts."""
    tagged = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat(*tagged), 256)


def closest(c: Column | str, names: Sequence[str], most: int = 3, cutoff: float = 0.4) -> Column:
    """Up to ``most`` of the names that resemble a text, best first, by edit distance over the longer length; null for null."""
    text = _c(c)
    scored = F.array(*[F.struct((1 - divide(F.levenshtein(text, F.lit(n)).cast("double"), F.greatest(F.length(text), F.lit(len(n))).cast("double"), F.lit(0.0))).alias("s"), F.lit(n).alias("n")) for n in names])
    near = F.filter(scored, lambda x: x["s"] >= cutoff)
    ranked = F.array_sort(near, lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
    return F.when(text.isNotNull(), F.transform(F.slice(ranked, 1, most), lambda x: x["n"]))


def close_matches(c: Column | str, names: Sequence[str], most: int = 3, cutoff: float = 0.4) -> Column:
    """The same by Python's ``difflib``, whose measure no built-in expression has; for tables of distinct names."""
    known = list(names)

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else difflib.get_close_matches(t, known, most, cutoff))

    return find(_c(c))
