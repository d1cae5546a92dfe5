"""Scalar expressions; each takes and returns columns and stays inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.contract import UUID_PATTERN

#: Fixed value: the DNS namespace of name-based UUIDs.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
ISO_PATTERN = rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}}|\d{{4}}-W\d{{2}}(?:-\d)?|\d{{4}}W\d{{2}}\d?)(?:[\s\S]{_TIME}(?:Z|[+-]{_TIME})?)?$"


def is_missing(c: Column, floating: bool = False) -> Column:
    """Null, or NaN where the column can hold it."""
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def is_uuid(c: Column) -> Column:
    return c.cast("string").rlike("(?i)" + UUID_PATTERN)


def is_iso_datetime(c: Column) -> Column:
    """Whether a text is an ISO 8601 date or date-time with a real calendar or week date, time of day and offset."""
    text = c.cast("string")
    compact = text.rlike(r"^\d{8}")
    date = F.when(compact, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(F.substring(text, 1, 10))
    week = text.rlike(r"^\d{4}-?W")
    year = F.substring(text, 1, 4).try_cast("int")
    # A year has 53 weeks if it ends on a Thursday or the year before ends on a Wednesday.
    ends_on = lambda y: (y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)) % 7
    weeks = F.when((ends_on(year) == 4) | (ends_on(year - 1) == 3), "53").otherwise("52")
    week_day = F.regexp_extract(text, r"^\d{4}-?W\d{2}-?(\d)?(?:\D|$|\d{2})", 1)
    week_ok = F.regexp_extract(text, r"^\d{4}-?W(\d{2})", 1).between(F.lit("01"), weeks) & week_day.isin("", "1", "2", "3", "4", "5", "6", "7")
    after_week = F.regexp_extract(text, r"^\d{4}-?W\d{2}(?:-?\d)?+[\s\S](.*)$", 1)
    rest = F.when(compact, F.substring(text, 10, 100)).when(week, after_week).otherwise(F.substring(text, 12, 100))

    parts = lambda said: [F.coalesce(F.substring(F.replace(said, F.lit(":"), F.lit("")), i, 2).try_cast("int"), F.lit(0)) for i in (1, 3, 5)]
    hour, minute, second = parts(F.regexp_replace(rest, r"(Z|[+-].*)$", ""))
    hours, minutes, seconds = parts(F.regexp_extract(rest, r"[+-](.*)$", 1))
    clocks = (hour <= 23) & (minute <= 59) & (second <= 59) & (hours * 3600 + minutes * 60 + seconds < 86_400)
    real = F.when(week, week_ok).otherwise(F.try_to_date(date, "yyyy-MM-dd").isNotNull())
    return text.rlike(ISO_PATTERN) & F.coalesce((year > 0) & real & clocks, F.lit(False))


def iso_from_postgres(c: Column) -> Column:
    """A Postgres timestamp text as ISO 8601: T for the blank, a full offset; what would not be ISO stays as it is."""
    out = F.regexp_replace(F.regexp_replace(c, r"^(\S+) ", "$1T"), r"([+-]\d{2})$", "$1:00")
    return F.when(is_iso_datetime(out), out).otherwise(c)


def semver(c: Column) -> Column:
    """A version of three parts: padded with zeros, cut after the third; null and empty are 1.0.0."""
    parts = F.split(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("1.0.0")), r"\.")
    return F.array_join(F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), 1, 3), ".")


def clamp01(c: Column, default: float = 0.9) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(default))))


def lookup(mapping: dict[str, str], key: Column, default: str | None = None) -> Column:
    """A map literal's value for the key, else the default."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def prompt_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(10), F.floor(chars / 4)).cast("long")


def completion_tokens(prompt: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(prompt / 5)).cast("long")


def token_cost(prompt: Column, completion: Column, per_prompt: float = 0.003, per_completion: float = 0.015) -> Column:
    return F.round(prompt / 1000 * per_prompt + completion / 1000 * per_completion, 6)


def two_digits(c: Column) -> Column:
    """A number with two decimals as C and Python print it: the exact binary value is rounded, a tie to the even digit.

    format_string rounds the shortest decimal text of a double, half up, so that 0.125 and 1.005 differ by a digit.
    """
    x = F.abs(c.cast("double"))
    whole = F.floor(x)
    part, unit = x - whole, float(1 << 60)  # exact; below 2^-8 a fraction may lose bits, where it rounds as any small one
    cents = (part * unit).cast("long").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    rest = cents % F.lit(1 << 60).cast("decimal(20,0)")
    down = ((cents - rest) / F.lit(1 << 60).cast("decimal(20,0)")).cast("long")
    half = F.lit(1 << 59).cast("decimal(20,0)")
    up = (rest > half) | (rest == half) & (down % 2 == 1)
    total = whole * 100 + down + up.cast("long")
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    said = F.concat(sign, F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    return F.when(x < 1e12, said).otherwise(F.format_string("%.2f", c))


def node_path(node_id: Column) -> Column:
    """The absolute path in a node id such as kind:/a/b.py:12; null unless it is absolute with a suffix."""
    path = F.regexp_extract(node_id, r"^[^:]*:(/[^:]*)(?::[^:]*)?$", 1)
    return F.when(path.rlike(r"/[^/]*[^/.][^/]*\.[^/.]+$") | path.rlike(r"/[^/.]+\.[^/.]+$"), path)


def normalized(c: Column) -> Column:
    """Lower case without - and _, for loose name matches."""
    return F.translate(F.lower(c), "-_", "")


def keyword_hits(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)))


def tokens(text: Column) -> Column:
    """Runs of a to z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def common_prefix(low: Column, high: Column) -> Column:
    """The leading path parts that the least and the greatest path share, and so all between them."""
    a, b = F.split(low, "/"), F.split(high, "/")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, F.size(same).cast("long"))
    return F.array_join(F.slice(a, F.lit(1), n.cast("int")), "/")
