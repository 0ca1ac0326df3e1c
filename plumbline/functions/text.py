"""Column expressions over text, dates and identifiers. Unless said otherwise null behaves as the empty text."""

from __future__ import annotations

import contextlib
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.steps import small_batches


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """White space of any kind collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)[\s\x1c-\x1f]+", " "))


def _composed(c: Column, compatible: bool) -> Column:
    """Unicode composition by the library that Spark has for collations, in the JVM; plain ASCII is left as it is. Its Unicode
    version is Spark's, a little newer than Python's."""
    c = blank(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(compatible)))


def nfkc(c: Column) -> Column:
    """NFKC and trim."""
    return F.trim(_composed(c, True))


def nfc_key(c: Column) -> Column:
    """NFC and clean: the form that record hashes are built on."""
    return clean(_composed(c, False))


def pick(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the cleaned parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *(clean(p) for p in parts)), 256), 1, 16)


def pseudonym(salt: str, *identities: Column) -> Column:
    """A salted alias of the first identity at hand."""
    return F.concat(F.lit("用户-"), F.substring(stable_id(F.lit(salt), F.coalesce(F.nullif(pick(*identities), F.lit("")), F.lit("anonymous"))), 1, 8))


def source_record_id(given: Column, *parts: Column) -> Column:
    """An upstream id where there is one, else sha256: and the hash of the parts in NFC with white space collapsed, so that
    composed and decomposed letters give one id. No user name belongs here."""
    return F.coalesce(F.nullif(blank(given), F.lit("")), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *(nfc_key(p) for p in parts)), 256)))


# Fixed formats: how replies, counts and dates are written in the sources.
REPLY = r"(?U)^回复\s+[^:：]+\s*[:：]\s*"
COUNT = r"(\d+(?:\.\d+)?)\s*([万千kK]?)"
CLOCK = r"(?U)\b(\d{1,2}:\d{2})\b"
NUMERIC_DAY = r"(?:(\d{4})[./-])?(\d{1,2})[./-](\d{1,2})"
CHINESE_DAY = r"(\d{1,2})月(\d{1,2})日"
AGO = r"\d+\s*(?:分钟|小时)前"
TODAY, YESTERDAY, DAY_BEFORE = "今天", "昨天", "前天"
# End of the fixed formats.


def cleaned_reply(c: Column) -> Column:
    """Text without a leading `回复 name:`."""
    return F.regexp_replace(F.trim(blank(c)), REPLY, "")


def parse_count(c: Column) -> Column:
    """A count as shown: 1,234, 1.2万, 3千 or 3k, cut to a whole number; 0 where there is none."""
    text = F.replace(clean(c), F.lit(","), F.lit(""))
    number = F.regexp_extract(text, COUNT, 1).try_cast("double")
    unit = F.regexp_extract(text, COUNT, 2)
    factor = F.when(unit == "万", 10000).when(unit.isin("千", "k", "K"), 1000).otherwise(1)
    return F.coalesce((number * factor).cast("long"), F.lit(0))


def star(c: Column) -> Column:
    """A rating as whole number, cut towards zero; null where it is no number."""
    return blank(c).try_cast("double").try_cast("int")


def post_info(c: Column) -> tuple[Column, Column, Column]:
    """Displayed date, region and device of `date | region | device ...`."""
    parts = F.transform(F.split(blank(c), r"\|"), lambda p: F.trim(p))
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.array_join(F.slice(parts, 3, 1 << 20), " | ")


def displayed_date(c: Column, collected: Column) -> tuple[Column, Column]:
    """(date, time text) of a date as an app shows it, relative to the day of collection.

    Minutes or hours ago and 今天 are that day, 昨天 and 前天 one and two days before; then [year]month-day with . / or -,
    then M月D日; without a year it is the collection's, or the year before if the month is later than the collection's.
    A day that does not exist, or anything else, gives a null date.
    """
    head = F.trim(F.substring_index(blank(c), "|", 1))
    time = F.regexp_extract(head, CLOCK, 1)

    def day(year: Column, month: Column, date: Column) -> Column:
        month, date = month.try_cast("int"), date.try_cast("int")
        back = F.when(month > F.month(collected), 1).otherwise(0)
        full = F.coalesce(F.nullif(year, F.lit("")).try_cast("int"), F.year(collected) - back)
        return F.try_make_timestamp(full, month, date, F.lit(0), F.lit(0), F.lit(0)).cast("date")

    found = (
        F.when(head.rlike(AGO) | head.startswith(TODAY), collected)
        .when(head.startswith(YESTERDAY), F.date_sub(collected, 1))
        .when(head.startswith(DAY_BEFORE), F.date_sub(collected, 2))
        .when(head.rlike(NUMERIC_DAY), day(*(F.regexp_extract(head, NUMERIC_DAY, i) for i in (1, 2, 3))))
        .when(head.rlike(CHINESE_DAY), day(F.lit(""), *(F.regexp_extract(head, CHINESE_DAY, i) for i in (1, 2))))
    )
    return found, time


#: A time of day with an optional zone, as ISO writes it (fixed format).
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d{1,6})?)?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?"


def iso_date(c: Column) -> Column:
    """The date of an ISO date or date-time, null where the date does not exist or what follows it is no time of day."""
    return F.when(blank(c).rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]{_TIME})?\z"), F.substring(c, 1, 10).try_cast("date"))


@functools.cache
def _gbk_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point up to U+FFFF: whether GBK has it, and whether as two bytes."""
    table = np.zeros((2, 1 << 16), bool)
    for k in range(1 << 16):
        try:
            n = len(chr(k).encode("gbk"))
        except UnicodeEncodeError:
            continue
        table[:, k] = True, n == 2
    return table[0], table[1]


def _repaired(t: str) -> str:
    """One text with each run of GBK characters read as UTF-8 again where that is valid."""
    has_gbk, wide = _gbk_classes()
    points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    inside = has_gbk[low] & (points < 1 << 16)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(t[at:a])
        piece, at = t[a:b], b
        if wide[low[a:b]].any():  # ASCII alone reads the same
            with contextlib.suppress(UnicodeDecodeError):
                piece = piece.encode("gbk").decode("utf-8")
        out.append(piece)
    out.append(t[at:])
    return "".join(out)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was once read as GBK: each longest run of GBK characters is turned back where that gives valid UTF-8.
    Plain ASCII is not looked at; in other texts only runs with a two-byte character are decoded. A text at a time, in batches
    of about 4 MB where the session sets no bound (steps.small_batches)."""
    small_batches(SparkSession.active())

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((t and _repaired(t).replace("\r\n", "\n").strip() for t in (x.as_py() for x in texts)), pa.string())

    c = blank(c)
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.trim(F.replace(c, F.lit("\r\n"), F.lit("\n")))).otherwise(run(F.when(~plain, c)))


def casefold(c: Column) -> Column:
    """A form that is equal for texts which differ in case alone: upper, then lower case, so that ß and SS, ﬁ and FI meet;
    the dotless i keeps apart from i. In the JVM, unlike a folding in Python. (The optimizer takes lower(upper(x)) for
    lower(x), so the translation back stands between the two.)"""
    kept = F.translate(blank(c), "\u0131", "\ue000")
    return F.lower(F.translate(F.upper(kept), "\ue000", "\u0131"))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(blank(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
