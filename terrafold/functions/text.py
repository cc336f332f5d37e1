"""Names, labels and small formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.operators.match import basename, stem

__all__ = ["basename", "stem"]


def gcp_role(c: Column) -> Column:
    """control, check or marker; anything else is control."""
    w = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z]", "")
    return F.when(w.rlike(r"^(check|chk|cp|validation)"), "check").when(w.rlike(r"^(marker|tie|tp)"), "marker").otherwise("control")


def file_safe(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; runs of anything else become one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def numbered(label: Column, n: Column) -> Column:
    """The label, and from the second on 'label (n)'."""
    return F.when(n <= 1, label).otherwise(F.concat(label, F.lit(" ("), n.cast("string"), F.lit(")")))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(plural or singular + "s"))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def format_bytes(n: Column) -> Column:
    """Powers of 1024 with one decimal from KB on."""
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def frame_timestamp(t: Column) -> Column:
    """m:ss.mmm of seconds."""
    ms = F.floor(t * 1000 + 0.5).cast("bigint")
    return F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def tag_number(c: Column) -> Column:
    """A number or a fraction such as 1/120; null otherwise."""
    part = F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$", 1)
    under = F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$", 2)
    return F.when(part != "", F.try_divide(part.try_cast("double"), under.try_cast("double"))).otherwise(F.trim(c).try_cast("double"))


def roll_and_number(c: Column) -> tuple[Column, Column]:
    """Leading letters and digits up to a separator, and the last number of a name."""
    s = stem(c)
    return F.regexp_extract(s, r"^(.*?)[-_ ]?\d+$", 1), F.regexp_extract(s, r"(\d+)$", 1).try_cast("int")


def exif_seconds(c: Column, sub: Column) -> Column:
    """'YYYY:MM:DD HH:MM:SS' and the digits of the sub-second to seconds; null if malformed."""
    whole = F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.unix_micros(whole) / 1e6 + F.coalesce(F.concat(F.lit("0."), sub).try_cast("double"), F.lit(0.0))


#: Fixed value: the largest image id of a pair.
MAX_ID = 2147483647


def pair_id(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("bigint") * MAX_ID + F.greatest(a, b)


def ids_of_pair(p: Column) -> tuple[Column, Column]:
    low = F.floor((p - p % MAX_ID) / MAX_ID).cast("bigint")
    return low, (p % MAX_ID).cast("bigint")


def node_key(level: Column, x: Column, y: Column, z: Column) -> Column:
    return F.concat_ws("-", *[c.cast("string") for c in (level, x, y, z)])


def contains_words(name: Column, typed: str) -> Column:
    """The name holds every typed word, whatever the case."""
    out = F.lit(True)
    for w in typed.lower().split():
        out = out & F.lower(name).contains(w)
    return out


def crs_search(records, query: str, limit: int = 12):
    """Exact code, then prefix, then every word of the name (records: code, name)."""
    code, name = F.col("code").cast("string"), F.lower("name")
    rank = F.when(code == query.strip(), 0).when(code.startswith(query.strip()), 1).when(name.startswith(query.lower().strip()), 2).when(contains_words(F.col("name"), query), 3)
    return records.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.col("code").cast("int")).limit(limit)
