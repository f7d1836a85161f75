"""Scalar functions over Columns: strings, dates, clocks, URLs, names, JSON-ish values."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_str(value: Column, most: int = 255) -> Column:
    """Trimmed and cut; null and spelled-out nothing become the empty string."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(v).isin("none", "null", "n/a"), "").otherwise(F.substring(v, 1, most))


def parse_date(value: Column) -> Column:
    """A date from ISO text with or without a time, or one of four other forms; null otherwise.

    A form is tried only where its separators stand, as a form that fails costs many times one that fits.
    """
    v = F.trim(value)
    third = F.substring(v, 3, 1)
    has = lambda sign: F.contains(v, F.lit(sign)) & (third != sign)
    tried = [F.when(has("-"), F.try_to_date(F.substring_index(v, "T", 1), "yyyy-MM-dd"))]
    forms = {"dd-MMM-yyyy": third == "-", "dd/MM/yyyy": third == "/", "yyyy/MM/dd": has("/"), "MMM d, yyyy": F.contains(v, F.lit(","))}
    tried += [F.when(fits, F.try_to_date(v, form)) for form, fits in forms.items()]
    return F.coalesce(*tried)


def parse_money(value: Column) -> Column:
    """``$20,000,000`` as decimal(18,2); null if it is no number."""
    return F.regexp_replace(F.trim(value), "[,$]", "").try_cast("decimal(18,2)")


_CLOCK = r"(?i)(\d{1,2})\s*[:.]?\s*(\d{2})?\s*(am|pm)?"


def clock_minutes(value: Column) -> Column:
    """``17:00``, ``1700``, ``17.00``, ``5:00 PM`` as minutes of the day; null if it is no clock."""
    part = lambda i: F.nullif(F.regexp_extract(value, _CLOCK, i), F.lit(""))
    hour, minute = part(1).cast("int"), F.coalesce(part(2).cast("int"), F.lit(0))
    half = F.lower(F.coalesce(part(3), F.lit("")))
    full = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(hour.isNotNull() & full.between(0, 23) & minute.between(0, 59), full * 60 + minute)


def deadline_instant(date: Column, minutes: Column, zone: Column) -> Column:
    """Local date and clock in a zone as a UTC instant; no clock: 23:59; no zone: 23:59 UTC."""
    clock = F.when(zone.isNull(), 23 * 60 + 59).otherwise(F.coalesce(minutes, F.lit(23 * 60 + 59)))
    local = date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), clock)
    return F.to_utc_timestamp(local, F.coalesce(zone, F.lit("UTC")))


def backoff_seconds(attempt: Column, base: int, most: int) -> Column:
    """``base`` doubled for each attempt after the first, up to ``most``."""
    return F.least(base * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(16))), F.lit(float(most))).cast("long")


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; the rest as it is."""
    bare = F.substring_index(F.trim(url), "#", 1)
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def url_key(url: Column) -> Column:
    return F.sha2(normal_url(url), 256)


def direct_url(url: Column) -> Column:
    """Share links of the document hosts as links that serve the file."""
    file_id = F.regexp_extract(url, r"drive\.google\.com/file/d/([\w-]+)", 1)
    kind, doc = (F.regexp_extract(url, r"docs\.google\.com/(document|spreadsheets|presentation)/d/([\w-]+)", i) for i in (1, 2))
    form = F.create_map(*[F.lit(x) for x in ("document", "docx", "spreadsheets", "xlsx", "presentation", "pdf")])[kind]
    opened = F.regexp_extract(url, r"google\.com/open\?(?:.*&)?id=([\w-]+)", 1)
    get = F.lit("https://drive.google.com/uc?export=download&id=")
    return (
        F.when(file_id != "", F.concat(get, file_id))
        .when(doc != "", F.concat(F.lit("https://docs.google.com/"), kind, F.lit("/d/"), doc, F.lit("/export?format="), form))
        .when(opened != "", F.concat(get, opened))
        .otherwise(url)
    )


def fetchable(url: Column) -> Column:
    """A web address with a public-looking host.

    What stands before an at sign is no host.  Names without a dot, addresses of private, shared, local and
    multicast networks, IPv6 literals, and numbers (decimal, octal, hexadecimal or short forms of an
    address) don't count.
    """
    authority = F.lower(F.regexp_extract(F.trim(url), r"^(?i:https?)://([^/\\?#]+)", 1))
    host = F.regexp_replace(F.regexp_replace(F.substring_index(authority, "@", -1), r":\d*$", ""), r"\.$", "")
    private = host.rlike(
        r"^(127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\.|(^|\.)localhost$|\.(local|internal)$"
    )
    numeric = host.rlike(r"^[0-9a-fx.]*$") & host.rlike(r"^(0x|\d)") & ~host.rlike(r"^([1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    odd = ~host.rlike(r"^[\p{L}\p{N}_.-]+$")
    return F.coalesce((host != "") & F.contains(host, F.lit(".")) & ~private & ~numeric & ~odd, F.lit(False))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def fold_name(name: Column) -> Column:
    """A person's name for comparison: letters alone, apostrophes gone, two spellings unified."""
    low = F.regexp_replace(F.lower(name), "['’ʻʼ`]", "")
    letters = F.trim(F.regexp_replace(low, "[^\\p{L}]+", " "))
    return F.regexp_replace(F.regexp_replace(letters, "kh", "x"), "ph", "f")


def derived_email(name: Column, domain: str, particles: tuple[str, ...] = ("de", "van", "von", "bin", "al")) -> Column:
    """Initial and last name at a domain; null for a single word."""
    parts = F.filter(F.split(fold_name(name), " "), lambda p: ~p.isin(*particles) & (p != ""))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    return F.when(F.size(parts) >= 2, F.concat(F.substring(first, 1, 1), last, F.lit(f"@{domain}")))


def accepted_language(header: Column, supported: list[str], default: str) -> Column:
    """Best supported language of an Accept-Language header: highest q, then first named."""

    def item(part: Column, i: Column) -> Column:
        tag = F.lower(F.trim(F.substring_index(F.substring_index(part, ";", 1), "-", 1)))
        q = F.coalesce(F.nullif(F.regexp_extract(part, r"q\s*=\s*([\d.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0))
        return F.struct(q.alias("q"), (-i).alias("at"), tag.alias("tag"))

    ranked = F.filter(F.transform(F.split(header, ","), item), lambda x: x["tag"].isin(*supported) & (x["q"] > 0))
    return F.coalesce(F.array_max(ranked)["tag"], F.lit(default))


def days_until(instant: Column, now: Column, zone: str) -> Column:
    """Calendar days in a zone."""
    return F.datediff(F.from_utc_timestamp(instant, zone), F.from_utc_timestamp(now, zone))


def relative_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "no date").when(days < 0, "closed").when(days == 0, "today").when(days == 1, "tomorrow")
        .otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
    )


def cache_key(question: Column, *scope: Column) -> Column:
    """Question folded to words, with its scope, as a hash."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower(question), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("|", folded, *[F.coalesce(s, F.lit("")) for s in scope]), 256)


def valid_citations(cited: Column, n: Column) -> Column:
    """Ascending distinct positions from 1 to n."""
    return F.array_sort(F.array_distinct(F.filter(cited, lambda i: i.between(1, n))))


def content_hash(*columns: str) -> Column:
    """SHA-256 over the columns in name order, with null told apart from empty."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def currency_once(value: Column) -> Column:
    """``EUR (EUR)`` as ``EUR``."""
    return F.regexp_replace(F.trim(value), r"(?i)^(.*?)\s*\(\1\)$", "$1")


def hedged_blank(value: Column) -> Column:
    """Answers that say nothing become empty."""
    v = F.trim(value)
    hedge = r"(?i)^(unknown|not (found|available|stated|specified)|n/?a|none|-+)\b.*|.*\b(could not|unable to) (find|determine)\b.*"
    return F.when(v.rlike(hedge), "").otherwise(v)


def labelled(columns: list[Column]) -> Column:
    """First label that is not blank."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.trim(c), F.lit("")) for c in columns])


#: Fixed value: the namespace of passage ids.
POINTS = uuid.uuid5(uuid.NAMESPACE_URL, "passages")


def point_id(source_key: Column, position: Column) -> Column:
    """A stable id of a passage: the version-5 UUID of its source and position; the same on every run."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINTS.hex)), F.encode(F.concat_ws("|", source_key, position), "UTF-8")))
    kind = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(kind, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Host and paths of personal profiles.
PROFILE_HOST, PROFILE_PATHS = "linkedin.com", ("in", "pub")


def profile_url(raw: Column) -> Column:
    """struct<url, problem>: the one form of a personal profile link; empty for empty.

    A missing scheme is added, only prefix and slug stay, in lower case.  A host with user details or of
    another site, and a path that names no person, are problems.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    whole = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    authority = F.lower(F.regexp_extract(whole, r"^[^:]*://([^/?#]*)", 1))
    host = F.substring_index(authority, ":", 1)
    parts = F.filter(F.split(F.regexp_extract(whole, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    prefix, slug_ = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))
    problem = (
        F.when(text == "", "").when(F.contains(authority, F.lit("@")), "address").when((host != PROFILE_HOST) & ~host.endswith(f".{PROFILE_HOST}"), "host")
        .when(slug_.isNull() | ~prefix.isin(*PROFILE_PATHS), "person").otherwise("")
    )
    url = F.when((problem == "") & (text != ""), F.concat(F.lit(f"https://www.{PROFILE_HOST}/"), prefix, F.lit("/"), slug_)).otherwise("")
    return F.struct(url.alias("url"), problem.alias("problem"))


def author_url(name: Column, base: str) -> Column:
    """The author page of a name: initial of the first name, first and last name; empty for one word.

    Words keep their letters a-z; single letters don't count.
    """
    parts = F.transform(F.split(F.trim(F.coalesce(name, F.lit(""))), r"[\s,]+"), lambda p: F.regexp_replace(F.lower(p), "[^a-z]", ""))
    words = F.filter(parts, lambda w: F.length(w) > 1)
    first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
    return F.when(F.size(words) >= 2, F.concat(F.lit(f"{base}/"), F.substring(first, 1, 1), F.lit("/"), first, F.lit("-"), last)).otherwise("")


def names_of(items: Column) -> Column:
    """array<string> of a JSON list of objects with ``Name`` or ``name``, or of plain values; blanks go, anything else is empty."""
    each = F.from_json(items, "array<string>")
    name = lambda x: F.coalesce(F.nullif(F.get_json_object(x, "$.Name"), F.lit("")), F.get_json_object(x, "$.name"), F.when(~x.startswith("{"), x))
    return F.filter(F.transform(F.coalesce(each, F.array().cast("array<string>")), lambda x: clean_str(name(x), 10_000)), lambda n: n != "")


def json_list(raw: Column) -> Column:
    """array<string> of a JSON list; empty for null, bad JSON and anything that is no list."""
    return F.filter(F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def draft_value(raw: Column) -> Column:
    """struct<kind, value> of what a person typed: boolean, number, text, or nothing.

    Separators of thousands go from numbers; yes and no are booleans.
    """
    v = F.trim(F.coalesce(raw, F.lit("")))
    plain = F.regexp_replace(v, r"(?<=\d)[, \u00a0](?=\d{3}(\D|$))", "")
    low = F.lower(v)
    kind = F.when(v == "", "none").when(low.isin("true", "false", "yes", "no"), "boolean").when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), "number").otherwise("text")
    value = F.when(kind == "boolean", F.when(low.isin("true", "yes"), "true").otherwise("false")).when(kind == "number", plain).when(kind == "text", v)
    return F.struct(kind.alias("kind"), value.alias("value"))


def report_number(title: Column) -> Column:
    """A report number such as ESRSA02670 in a title, in upper case; empty without one."""
    return F.upper(F.regexp_extract(F.coalesce(title, F.lit("")), r"(?i)\b(ESRS[A-Z]?\d{3,})\b", 1))


def message(catalogue: dict[str, dict[str, str]], code: Column, language: Column, params: Column, default: str = "en") -> Column:
    """A message of a catalogue (code -> language -> template) with ``{name}`` filled from a map column.

    A missing language falls back to the default, an unknown code is null, and a placeholder without a
    value leaves the template as it is.
    """
    flat = [F.lit(x) for code_, texts in catalogue.items() for lang, t in texts.items() for x in (f"{code_}|{lang}", t)]
    table = F.create_map(*flat)
    template = F.coalesce(table[F.concat(code, F.lit("|"), F.coalesce(language, F.lit(default)))], table[F.concat(code, F.lit(f"|{default}"))])
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))
    filled = F.aggregate(names, template, lambda t, n: F.replace(t, F.concat(F.lit("{"), n, F.lit("}")), params[n]))
    return F.coalesce(filled, template)
