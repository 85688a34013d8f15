"""Value formats as predicates on string and number Columns, JVM-side and total."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that each format accepts, and the ranges of the number formats.
#: All that ECMAScript takes for white space, inside a character class.
SPACE = r"\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LOOSE_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9a-f]{1,4}"


def _ipv6() -> str:
    """All compressed forms by the number of groups before `::`, with a dotted quad as the last two groups."""
    forms = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{_V4}"]
    for n in range(8):
        before = rf"{_H}(?::{_H}){{{n - 1}}}" if n else ""
        forms.append(rf"{before}::(?:{_H}(?::{_H}){{0,{6 - n}}})?" if n < 7 else rf"{before}::")
        if n <= 5:
            forms.append(rf"{before}::(?:{_H}:){{0,{5 - n}}}{_V4}")
    return rf"(?i)\s*(?:{'|'.join(forms)})(?:%.+)?\s*"


_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_UNRESERVED = r"a-z0-9\-._~"
_SUB = r"!$&'()*+,;="
_HEX = "%[0-9a-f]{2}"
_PCHAR = rf"(?:[{_UNRESERVED}{_SUB}:@]|{_HEX})"
_HOST = rf"(?:\[(?:{_ipv6()[4:]}|v[0-9a-f]+\.[{_UNRESERVED}{_SUB}:]+)\]|(?:[{_UNRESERVED}{_SUB}]|{_HEX})*+)"
_HIER = rf"(?://(?:(?:[{_UNRESERVED}{_SUB}:]|{_HEX})*@)?{_HOST}(?::\d*)?(?:/{_PCHAR}*+)*+|/(?:{_PCHAR}++(?:/{_PCHAR}*+)*+)?|{_PCHAR}++(?:/{_PCHAR}*+)*+|)"
_TAIL = rf"(?:\?(?:{_PCHAR}|[/?])*+)?(?:#(?:{_PCHAR}|[/?])*+)?"
_ICHAR = rf"(?:[{_UNRESERVED}{_SUB}:@\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF]|{_HEX})"
_VARIABLE = r"(?:[a-z0-9_]|%[0-9a-f]{2})+(?::[1-9][0-9]{0,3}|\*)?"
_URI_REF = r"(?i)(?:(?:[a-z][a-z0-9+-.]*:)?/?/)?(?:[^\\\s#][^\s#]*)?(?:#[^\\\s]*)?"
PATTERNS: dict[str, str] = {
    "alpha": "[a-zA-Z]+",
    "alphanumeric": "[a-zA-Z0-9]+",
    "numeric": "[0-9]+",
    "hexadecimal": "[a-fA-F0-9]+",
    "color": "(?i)#(?:[0-9a-f]{3}){1,2}",
    "uuid": "(?i)(?:urn:uuid:)?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    "guid": r"(?i)\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    "identifier": r"[_a-zA-Z]+\w{0,30}",
    "html-identifier": r"[A-Za-z]+[\w\-:.]{0,30}",
    "css-identifier": r"-?[_a-zA-Z]+[\w-]{0,30}",
    "mac": r"[0-9A-Fa-f]{2}([:-]?)[0-9A-Fa-f]{2}(?:(?:\1|\.)[0-9A-Fa-f]{2}[:-]?[0-9A-Fa-f]{2}){2}",
    "ipv4": rf"(?:{_LOOSE_OCTET}\.){{3}}{_LOOSE_OCTET}",
    "ipv6": _ipv6(),
    "hostname": rf"(?i){_LABEL}(?:\.{_LABEL})*+",
    "url": r"(?i)[(http(s)?):/(www\.)?\w\-/=#%&.]{2,}\.[a-z]{2,}[\w\-/=#%&.?]*",
    "uri": r"(?i)[a-z][a-z0-9+-.]*:(?:/?/)?[^\s]*",
    "uri--full": rf"(?i)[a-z][a-z0-9+\-.]*:{_HIER}{_TAIL}",
    "uri-reference": _URI_REF,
    "uri-reference--full": rf"(?i)(?:[a-z][a-z0-9+\-.]*:)?{_HIER}{_TAIL}",
    "uri-template": rf"(?i)(?:[^\x00-\x20\"'<>%\\^`{{|}}]|%[0-9a-f]{{2}}|\{{[+#./;?&=,!@|]?{_VARIABLE}(?:,{_VARIABLE})*\}})*+",
    "iri": rf"(?i)[a-z][a-z0-9+\-.]*:(?://)?(?:{_ICHAR}|[/\[\]])*+(?:\?(?:{_ICHAR}|[/?\uE000-\uF8FF])*+)?(?:#(?:{_ICHAR}|[/?])*+)?",
    "iri-reference": _URI_REF,
    "json-pointer": r"(?:/(?:[^~/]|~0|~1)*+)*+",
    "json-pointer-uri-fragment": r"(?i)#(?:/(?:[a-z0-9_\-.!$&'()*+,;:=@]|%[0-9a-f]{2}|~0|~1)*+)*+",
    "relative-json-pointer": r"(?:0|[1-9][0-9]*)(?:#|(?:/(?:[^~/]|~0|~1)*+)*+)",
    "email": rf"(?i)[a-z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*",
    "email--full": r"(?i)[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?",
    "idn-email": r"[^@]+@[^@]+\.[^@]+",
    "isbn10": r"(?i)ISBN(?:-10)?:? *(?=\d{1,5}([ -]?)\d{1,7}\1?\d{1,6}\1?\d)(?:\d\1*){9}[\dX]",
    "isbn13": r"(?i)ISBN(?:-13)?:? *97[89]([ -]?)(?=\d{1,5}\1?\d{1,7}\1?\d{1,6}\1?\d)(?:\d\1*){9}\d",
    "base64": r"(?:[a-zA-Z0-9+/]{4})*+(?:|[a-zA-Z0-9+/]{3}=|[a-zA-Z0-9+/]{2}==|[a-zA-Z0-9+/]===)",
}
#: A web address with a public host: user, an address outside the private ranges or a name with a top domain, port, path.
_NO_SPACE, _NAME = rf"[^{SPACE}\x0B]", r"[a-z0-9\u00A1-\uFFFF]"
_PUBLIC = r"(?!(?:10|127)(?:\.\d{1,3}){3})(?!(?:169\.254|192\.168)(?:\.\d{1,3}){2})(?!172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})(?:[1-9]\d?|1\d\d|2[01]\d|22[0-3])(?:\.(?:1?\d{1,2}|2[0-4]\d|25[0-5])){2}\.(?:[1-9]\d?|1\d\d|2[0-4]\d|25[0-4])"
_LABELS = rf"{_NAME}++(?:-{_NAME}++)*+"
URL_FULL = rf"(?i)(?:https?|ftp)://(?:{_NO_SPACE}+(?::{_NO_SPACE}*)?@)?(?:{_PUBLIC}|{_LABELS}(?:\.{_LABELS})*?\.[a-z\u00A1-\uFFFF]{{2,}})(?::\d{{2,5}})?(?:/{_NO_SPACE}*)?"
#: Found anywhere from the start on, not over the whole string; an IBAN has to be followed by a dollar sign.
IBAN = r"(?i)\A[A-Z]{2}[ '+\\-]?[0-9]{2}(?=(?:[ '+\\-]?[A-Z0-9]){9,30}\$)(?:[ '+\\-]?[A-Z0-9]{3,5}){2,7}(?:[ '+\\-]?[A-Z0-9]{1,3})?\$"
#: A host name in its ASCII form; at least one dot.
ACE_HOST = r"(?!-)(?:xn--)?[a-zA-Z0-9][a-zA-Z0-9-_]{0,61}[a-zA-Z0-9]?\.(?!-)(?:xn--)?(?:[a-zA-Z0-9-]{1,50}|[a-zA-Z0-9-]{1,30}\.[a-zA-Z]{2,})"
PATTERNS |= {"url--full": PATTERNS["url"], "byte": PATTERNS["base64"]}
INTEGERS: dict[str, tuple[int, int]] = {
    "int8": (-(1 << 7), (1 << 7) - 1),
    "uint8": (0, (1 << 8) - 1),
    "int16": (-(1 << 15), (1 << 15) - 1),
    "uint16": (0, (1 << 16) - 1),
    "int32": (-(1 << 31), (1 << 31) - 1),
    "uint32": (0, (1 << 32) - 1),
    "int64": (1 - (1 << 53), (1 << 53) - 1),
    "uint64": (0, (1 << 53) - 1),
}
FLOATS: dict[str, float] = {"float16": 65504.0, "float32": 3.4028234663852886e38, "float": 3.4028234663852886e38, "float64": 1.7976931348623157e308, "double": 1.7976931348623157e308}
DATE, TIME = r"(\d{4})-([01]\d)-([0-3]\d)[zZ]?", r"(\d\d):(\d\d):(\d\d)(\.\d{1,6})?([zZ]|[+-]\d\d:\d\d)"


def whole(s: Column, pattern: str) -> Column:
    """Whether the whole string matches; false for null."""
    return F.coalesce(s.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def _java(owner: str, method: str, *args: Column) -> Column:
    """What a static Java method returns, as text; null where it throws."""
    return F.call_function("try_reflect", F.lit(owner), F.lit(method), *args)


def is_regex(s: Column) -> Column:
    """Whether the text compiles as a pattern, by Java's syntax; false for null."""
    return F.coalesce(_java("java.util.regex.Pattern", "matches", s, F.lit("")).isNotNull(), F.lit(False))


def is_idn_hostname(s: Column) -> Column:
    """A host name whose ASCII form, by IDNA, has at least one dot."""
    ascii_form = F.when(s.rlike(r"\A[\x00-\x7F]*\z"), s).otherwise(_java("java.net.IDN", "toASCII", s))
    return whole(ascii_form, ACE_HOST)


def countries() -> list[str]:
    """Two-letter country codes of ISO 3166, by the platform's list, and XK."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("country2 needs a running session")
    return sorted({"XK", *context._jvm.java.util.Locale.getISOCountries()})


def is_url_full(s: Column) -> Column:
    """A whole address with a public host."""
    return whole(s, URL_FULL)


def is_country(s: Column) -> Column:
    """Starts with a two-letter country code, in any case."""
    return F.coalesce(F.upper(F.substring(s, 1, 2)).isin(*countries()), F.lit(False))


def is_date(s: Column) -> Column:
    """Full date by RFC 3339, with an optional trailing z."""
    part = lambda k: F.regexp_extract(s, rf"\A{DATE}\z", k).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(whole(s, DATE) & month.between(1, 12) & (day >= 1) & (day <= days), F.lit(False))


def is_time(s: Column) -> Column:
    """Time with a zone by RFC 3339; 60 seconds at 23:59 only."""
    part = lambda k: F.regexp_extract(s, rf"\A{TIME}\z", k)
    hour, minute, second, zone = part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int"), part(5)
    inside = (hour <= 23) & (minute <= 59) & (second <= 59) | (hour == 23) & (minute == 59) & (second == 60)
    zoned = F.lower(zone).eqNullSafe("z") | (F.substring(zone, 2, 2).try_cast("int") <= 23) & (F.substring(zone, 5, 2).try_cast("int") <= 59)
    return F.coalesce(whole(s, TIME) & inside & zoned, F.lit(False))


def is_date_time(s: Column) -> Column:
    parts = F.split(s, r"[tT\s]", -1)
    return F.coalesce((F.size(parts) == 2) & is_date(F.get(parts, F.lit(0))) & is_time(F.get(parts, F.lit(1))), F.lit(False))


def instant(s: Column, kind: str) -> Column:
    """The instant that a date, time or date-time text names, or null."""
    full = {"date": F.concat(F.substring(s, 1, 10), F.lit("T00:00:00Z")), "time": F.concat(F.lit("1970-01-01T"), F.upper(s)), "date-time": F.regexp_replace(F.upper(s), r"\s", "T")}[kind]
    return F.when(DATES[kind](s), full.try_cast("timestamp"))


DATES: dict[str, Callable[[Column], Column]] = {"date": is_date, "time": is_time, "date-time": is_date_time}


def strings() -> dict[str, Callable[[Column], Column]]:
    """The string formats, each a predicate on a string Column."""

    def by(pattern: str) -> Callable[[Column], Column]:
        return lambda s: whole(s, pattern)

    found = {name: by(pattern) for name, pattern in PATTERNS.items()}
    found["uri"] = lambda s: whole(s, PATTERNS["uri"]) & F.coalesce(s.rlike("[/:]"), F.lit(False))
    found["uri--full"] = lambda s: whole(s, PATTERNS["uri--full"]) & F.coalesce(s.rlike("[/:]"), F.lit(False))
    found["country2"] = is_country
    found["iban"] = lambda s: F.coalesce(s.rlike(IBAN), F.lit(False))
    found["hostname"] = lambda s: whole(s, PATTERNS["hostname"]) & (F.length(s) <= 255)
    found["uppercase"] = lambda s: F.coalesce(s == F.upper(s), F.lit(False))
    found["lowercase"] = lambda s: F.coalesce(s == F.lower(s), F.lit(False))
    return found


#: Formats that call into Java. Spark takes such calls for non-deterministic, so they stand in projections and filters only.
REFLECTED: dict[str, Callable[[Column], Column]] = {"regex": is_regex, "idn-hostname": is_idn_hostname}


def in_range(number: Column, name: str) -> Column:
    """Whether a number lies within a number format."""
    if name in INTEGERS:
        low, high = INTEGERS[name]
        test = (number == F.floor(number)) & number.between(float(low), float(high))
    else:
        test = ~F.isnan(number) & (F.abs(number) <= FLOATS[name])
    return F.coalesce(test, F.lit(False))


NAMES = frozenset({*PATTERNS, "uppercase", "lowercase", "country2", "iban", *REFLECTED, *INTEGERS, *FLOATS, *DATES})
