"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
VARIANT = r"-(thinking|xhigh|high|medium|low|max|agent)$"


# ---- models ---------------------------------------------------------------------------------------------------------


# What is cut off model ids, and the families of models that are shown by name.
DATED = [r"-[0-9]{8}$", r"^anthropic\.", r"@[0-9]{8}$"]
FAMILY = r"^claude-(opus|sonnet|haiku|fable|mythos)-([0-9]+)(?:-([0-9]+))?$"


def normalize_model(model: Column) -> Column:
    """Without the date suffix, the ``anthropic.`` prefix and the ``@date`` suffix; null is ``unknown``."""
    out = F.coalesce(model, F.lit("unknown"))
    for pattern in DATED:
        out = F.regexp_replace(out, pattern, "")
    return out


def display_model(model: Column) -> Column:
    """``claude-opus-4-8`` is ``Opus 4.8``; other ids stay."""
    m = normalize_model(model)
    family, major, minor = (F.regexp_extract(m, FAMILY, i) for i in (1, 2, 3))
    shown = F.concat(F.initcap(family), F.lit(" "), major, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise(""))
    return F.when(family != "", shown).otherwise(m)


def agent_model(model: Column) -> Column:
    """The last path segment without an effort suffix, aliases resolved."""
    out = F.regexp_replace(F.substring_index(F.lower(model), "/", -1), VARIANT, "")
    return F.when(out == "gemini-3-flash", "gemini-3-flash-preview").otherwise(out)


def is_free(model: Column) -> Column:
    return F.regexp_like(model, F.lit(r"(?i)(:free|-free)\z"))


# ---- time -----------------------------------------------------------------------------------------------------------


def at_millis(ms: Column, tz: str = "UTC") -> Column:
    """Wall time in the zone."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), tz)


def day_key(ms: Column, tz: str = "UTC") -> Column:
    return F.date_format(at_millis(ms, tz), "yyyy-MM-dd")


def hour_of(ms: Column, tz: str = "UTC") -> Column:
    return F.hour(at_millis(ms, tz))


def parse_timestamp(text: Column) -> Column:
    """Epoch milliseconds of an ISO time, null if it is none; without an offset it is in the session's zone."""
    return F.unix_millis(F.try_to_timestamp(F.when(F.length(text) > 0, text)))


def zone_label(minutes: Column, name: str = "local") -> Column:
    """``local (UTC+03:00)`` from an offset in minutes."""
    size = F.abs(minutes)
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.lit(f"{name} (UTC"), sign, F.format_string("%02d:%02d", F.floor(size / 60), size % 60), F.lit(")"))


def duration_text(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600)
    rest = F.format_string("%02d:%02d", F.floor(seconds % 3600 / 60), F.floor(seconds % 60))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), rest)).otherwise(rest)


# ---- numbers as scripts see them ----------------------------------------------------------------------------------------


def js_round(x: Column) -> Column:
    """Half goes up."""
    return F.floor(x + F.lit(0.5)).cast("double")


def js_number_text(x: Column) -> Column:
    """A double as a script prints it: whole numbers up to 21 digits plainly, small and large ones with an exponent."""
    text = F.abs(x).cast("string")  # 1.0E10, 123.456 and the like
    mantissa, exponent = F.substring_index(text, "E", 1), F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    all_digits = F.replace(mantissa, F.lit("."), F.lit(""))
    lead = F.length(all_digits) - F.length(F.ltrim(all_digits, F.lit("0")))
    digits = F.trim(all_digits, F.lit("0"))
    n, k = F.length(whole) + exponent - lead, F.length(digits)
    sign = F.when(x < 0, "-").otherwise("")
    power = n - 1
    size = F.abs(x)
    # Most numbers need none of this: whole ones are their digits filled up with zeros, and neither very small nor large ones are spelled plainly.
    filled = F.concat(sign, text.cast("decimal(22,0)").cast("string"))
    shown = (
        F.when((k <= n) & (n <= 21), F.concat(digits, F.repeat(F.lit("0"), n - k)))
        .when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
        .otherwise(
            F.concat(
                F.substring(digits, 1, 1),
                F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(""),
                F.when(power < 0, "e-").otherwise("e+"),
                F.abs(power).cast("string"),
            )
        )
    )
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when(x == 0, "0")
        .when((size < 2.0**53) & (size == F.floor(size)), x.cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), x.cast("double").cast("string"))
        .when((size < 1e21) & (size >= 2.0**53), filled)
        .otherwise(F.concat(sign, shown))
    )


def js_to_number(text: Column) -> Column:
    """A text as a number: blank is 0, 0x 0o 0b prefixes, NaN if it is none."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = F.when(s == "", 0.0)
    for prefix, radix, digits in (("0[xX]", 16, "[0-9a-fA-F]+"), ("0[oO]", 8, "[0-7]+"), ("0[bB]", 2, "[01]+")):
        out = out.when(F.regexp_like(s, F.lit(f"^{prefix}{digits}$")), F.conv(F.substring(s, 3, 1000), radix, 10).cast("double"))
    out = out.when(s.isin("Infinity", "+Infinity"), float("inf")).when(s == "-Infinity", float("-inf"))
    number = F.regexp_like(s, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    return out.when(number, s.try_cast("double")).otherwise(float("nan"))


# ---- paths ----------------------------------------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def extension(path: Column) -> Column:
    """From the last point of the file name, or '' (a point at the very end is none)."""
    return F.regexp_extract(file_name(path), r"\.[^.]+$", 0)


def extension_text(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", "[no extension]").otherwise(ext)


def decode_uri(text: Column) -> Column:
    """Percent escapes decoded as UTF-8, null if malformed; a plus sign stays."""
    bad = F.regexp_like(text, F.lit("%(?![0-9a-fA-F]{2})"))
    return F.when(~bad, F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))


def uri_to_path(uri: Column) -> Column:
    """``file:///`` URIs as paths, with back-slashes after a drive letter; others stay."""
    p = decode_uri(F.substring(uri, 9, 1 << 20))
    path = F.when(F.regexp_like(p, F.lit("^[a-zA-Z]:")), F.replace(p, F.lit("/"), F.lit("\\"))).otherwise(F.concat(F.lit("/"), p))
    return F.when(F.startswith(uri, F.lit("file:///")), path).otherwise(uri)


def windows_path(path: Column) -> Column:
    """Lower-case comparison key: ``/d/x`` and ``/mnt/d/x`` are ``d:\\x``; ``.`` and ``..`` resolved; no end separator."""
    p = F.replace(F.trim(path), F.lit("/"), F.lit("\\"))
    p = F.regexp_replace(p, r"^\\([A-Za-z])\\", r"$1:\\")
    p = F.lower(F.regexp_replace(p, r"(?i)^\\mnt\\([a-z])\\", r"$1:\\"))
    rooted = F.regexp_like(p, F.lit(r"^\\"))
    parts = F.filter(F.split(p, r"\\+", -1), lambda s: (s != "") & (s != "."))
    up = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1))))).otherwise(
        F.concat(acc, F.array(s))
    )
    clean = F.aggregate(parts, F.array().cast("array<string>"), up)
    joined = F.array_join(F.when(F.exists(parts, lambda s: s == ".."), clean).otherwise(parts), "\\")
    return F.when(rooted, F.concat(F.lit("\\"), joined)).otherwise(joined)


# ---- text for people ----------------------------------------------------------------------------------------------------


def token_text(n: Column) -> Column:
    """1.23B, 4.6M, 12.0K or the number."""
    n = n.cast("double")
    return (
        F.when(n >= 1e9, F.concat(F.format_string("%.2f", n / 1e9), F.lit("B")))
        .when(n >= 1e6, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 1e3, F.concat(F.format_string("%.1f", n / 1e3), F.lit("K")))
        .otherwise(F.format_string("%.0f", F.signum(n) * F.floor(F.abs(n) + 0.5)))
    )


def number_text(x: Column) -> Column:
    return F.when(x.isNull(), DASH).otherwise(F.format_number(F.round(x.cast("double")), 0))


def signed_text(x: Column) -> Column:
    size = F.format_number(F.round(F.abs(x.cast("double"))), 0)
    return F.when(x.isNull(), DASH).when(size == "0", "0").when(x > 0, F.concat(F.lit("+"), size)).otherwise(F.concat(F.lit("-"), size))


def currency_text(x: Column) -> Column:
    return F.when(x.isNull(), DASH).otherwise(F.concat(F.lit("$"), F.format_number(F.round(x.cast("double"), 2), 2)))


def signed_currency_text(x: Column) -> Column:
    size = F.concat(F.lit("$"), F.format_number(F.round(F.abs(x.cast("double")), 2), 2))
    return F.when(x.isNull(), DASH).when(x > 0, F.concat(F.lit("+"), size)).when(x < 0, F.concat(F.lit("-"), size)).otherwise("$0.00")


def percent_text(x: Column) -> Column:
    size = F.format_string("%.1f%%", F.abs(x.cast("double")) * 100)
    return F.when(x.isNull(), DASH).when(size == "0.0%", size).when(x > 0, F.concat(F.lit("+"), size)).otherwise(F.concat(F.lit("-"), size))


def cost_text(sessions: Column, cost: Column, partial: Column) -> Column:
    shown = F.concat(F.lit("$"), F.format_number(F.round(cost, 2), 2), F.when(partial, "*").otherwise(""))
    return F.when((sessions == 0) | ((cost == 0) & partial), DASH).otherwise(shown)


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&#38;"))
    for c in '<>"':
        out = F.replace(out, F.lit(c), F.lit(f"&#{ord(c)};"))
    return out


def csv_cell(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def formula_guard(text: Column) -> Column:
    """A leading apostrophe before what a spreadsheet takes for a formula."""
    return F.when(F.regexp_like(text, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), text)).otherwise(text)


def display_name(value: Column, names: dict[str, str]) -> Column:
    """A fixed map of names; other values stay."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(pairs, value), value)


# What enumeration names are shown as.
ENUM_NAMES = {
    "SourceOnly": "Source Code Only",
    "SourceAndConfiguration": "Source Code + Configuration",
    "AllText": "All Text Files",
    "SourceCode": "Source Code",
    "Configuration": "Configuration",
    "DocumentationText": "Documentation / Text",
}
