"""Month arithmetic, free-text months, date ranges and stated experience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze

# Markers of an open end, the first year taken as real, number words, plausibility bound.
CURRENT_MARKERS = ("present", "current", "currently", "now", "ongoing", "till date", "to date")
MIN_YEAR = 1970
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "twelve": 12, "fifteen": 15, "twenty": 20,
}
MAX_MONTHS = 40 * 12

# Patterns of months, dates, ranges, quantities and their context.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
              "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
TEXT_DATE = rf"\b(?:{MONTH_NAME}\b\.?\s*,?\s*(?:19|20)\d{{2}}|(?:0?[1-9]|1[0-2])\s*[/.]\s*(?:19|20)\d{{2}}|(?:19|20)\d{{2}})(?!\d)"
OPEN_END = r"(?:till\s+date|to\s+date|till\s+now|till\s+present|present|currently|current|now|ongoing|today|date)\b"
RANGE = rf"(?i)({TEXT_DATE})\s*(?:[–—-]|\bto\b|\buntil\b|\btill\b)\s*(?:({TEXT_DATE})|({OPEN_END}))"
UNIT = "(?:years?|yrs?|months?|mos?)"
QUANTITY = r"\d+(?:\.\d+)?|" + "|".join(NUMBER_WORDS)
MENTION = (rf"(?i)\b({QUANTITY})\s*({UNIT})?\s*(?:\+|plus)?\s*"
           rf"(?:(?:-|–|—|to)\s*({QUANTITY})\s*(?:\+|plus)?\s*)?({UNIT})\b")
CUE = r"(?i)experience|\bexp\b|background|track record|hands-on|proven"
NOT_BEFORE = r"(?i)(?:last|past)\s*$"
NOT_AFTER = r"(?i)^\s*(?:ago|in business|of history)"
PREFERRED = r"(?i)preferred|nice to have|good to have|bonus|a plus|desirable|ideally|added advantage|advantage"
ENTRY_LEVEL = r"(?i)\bfreshers?\b|entry[- ]level|no (?:prior |previous )?experience (?:is )?(?:required|needed|necessary)"


def parse_month(text: Column, is_end: bool, today: Column) -> Column:
    """First day of the month a free text names; null when it names none from 1970 on.

    Reads 'Jun 2021', 'June, 2021', '2021-06', '06/2021', '2021' (January).  An
    open-end marker is today for an end and nothing for a start.
    """
    t = F.lower(F.trim(text))
    year = F.regexp_extract(t, r"(?<!\d)(\d{4})(?!\d)", 1)
    name = F.regexp_extract(t, rf"\b{MONTH_NAME}\b", 0)
    by_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(name, 1, 3))
    ahead = F.regexp_extract(t, r"(?<!\d)(\d{1,2})\s*[/.-]\s*\d{4}(?!\d)", 1)
    behind = F.regexp_extract(t, r"(?<!\d)\d{4}\s*[/.-]\s*(\d{1,2})(?!\d)", 1)
    number = F.coalesce(F.nullif(ahead, F.lit("")), F.nullif(behind, F.lit(""))).try_cast("int")
    month = F.when(name != "", by_name.cast("int")).otherwise(F.coalesce(number, F.lit(1)))
    y = F.nullif(year, F.lit("")).try_cast("int")
    found = F.when((y >= MIN_YEAR) & month.between(1, 12), F.make_date(y, month, F.lit(1)))
    return F.when(t.isin(*CURRENT_MARKERS), today if is_end else F.lit(None).cast("date")).otherwise(found)


def quantity(token: Column) -> Column:
    """A number or a number word as double."""
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    t = F.lower(token)
    return F.coalesce(F.try_element_at(words, t).cast("double"), t.try_cast("double"))


def quantity_months(value: Column, unit: Column) -> Column:
    """Value and unit in months, half-even."""
    return F.bround(value * F.when(F.lower(unit).startswith("y"), 12).otherwise(1)).cast("int")


def whole_years(months: Column) -> Column:
    return F.bround(months / 12).cast("int")


def format_months(months: Column) -> Column:
    """'2 yrs 6 mos', '1 yr', '0 mos'; null stays null."""
    y, m = F.floor(months / 12), months % 12
    part = lambda n, one, many: F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many)))
    text = F.concat_ws(" ", part(y, " yr", " yrs"), part(m, " mo", " mos"))
    return F.when(months.isNull(), None).when(months == 0, "0 mos").otherwise(text)


def find_ranges(text: Column) -> Column:
    """array<struct<start, end>> of the date ranges in a text; an open end reads 'Present'.

    One pass over the text finds the ranges; only the short matches are taken apart.
    """
    part = lambda x, k: squeeze(F.regexp_extract(x, RANGE, k))
    return F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(0)), lambda x: F.struct(
        part(x, 1).alias("start"), F.when(F.regexp_extract(x, RANGE, 3) != "", "Present").otherwise(part(x, 2)).alias("end")))


def find_mentions(text: Column) -> Column:
    """array<struct<min_months, max_months, text, preferred>> of the experience a job text asks for.

    Matches are marked by two control characters and the text is split there,
    so every match sits at an odd place with its context on both sides.  The
    context comes from the ends of the neighbouring parts, and whether a line
    speaks of a preference is found once per line, so the work is linear in
    the text, however many matches it has.
    """

    def views(marked: Column) -> Column:
        lines, parts = F.split(marked, "\n"), F.split(marked, "[\u0001\u0002]")
        none = F.array().cast("array<int>")
        times = lambda x, mark: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
        line_of = lambda mark: F.flatten(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit(mark)), F.array_repeat(i, times(x, mark))).otherwise(none)))
        plain = lambda x: F.when(F.contains(x, F.lit("\u0001")) | F.contains(x, F.lit("\u0002")), F.translate(x, "\u0001\u0002", "")).otherwise(x)
        return F.struct(parts.alias("parts"), F.transform(parts, lambda p: F.right(p, F.lit(50))).alias("ends"), F.transform(parts, lambda p: F.left(p, F.lit(80))).alias("starts"),
                        F.transform(lines, plain).alias("lines"), F.transform(lines, lambda x: F.contains(x, F.lit("\u0001"))).alias("asked"), line_of("\u0001").alias("first"), line_of("\u0002").alias("last"))

    def led(v: Column, i: Column, line: Column) -> Column:
        """The line behind a short line before it."""
        return let(F.trim(F.get(v["lines"], i - 1)), lambda prev: F.concat(F.when(F.length(prev).between(1, 40), F.concat(prev, F.lit(" "))).otherwise(""), line))

    def context(v: Column, preferred: Column, k: Column) -> Column:
        i = 2 * k + 1
        # a match has three characters at least, so 36 parts hold 50 and 56 hold 80
        low = F.greatest(F.lit(0), i - 36)
        after = F.left(F.array_join(F.slice(v["starts"], i + 2, F.lit(56)), ""), F.lit(80))
        a, b = F.get(v["first"], k), F.get(v["last"], k)
        across = led(v, a, F.array_join(F.slice(v["lines"], a + 1, b - a + 1), "\n")).rlike(PREFERRED)
        return F.struct(F.get(v["parts"], i).alias("m"), F.right(F.array_join(F.slice(v["ends"], low + 1, i - low), ""), F.lit(50)).alias("before"),
                        F.get(F.split(after, "\n\n"), F.lit(0)).alias("after"), F.when(a == b, F.get(preferred, a)).otherwise(across).alias("preferred"))

    def read(c: Column) -> Column:
        g = lambda k: F.nullif(F.regexp_extract(c["m"], MENTION, k), F.lit(""))
        lo = quantity_months(quantity(g(1)), F.coalesce(g(2), g(4)))
        hi = quantity_months(quantity(g(3)), g(4))
        return F.struct(lo.alias("min_months"), F.when(hi >= lo, hi).alias("max_months"), F.trim(c["m"]).alias("text"), c["preferred"].alias("preferred"))

    def real(c: Column) -> Column:
        window = F.regexp_replace(F.concat_ws(" ", c["before"], c["m"], c["after"]), "\n", " ")
        return window.rlike(CUE) & ~c["before"].rlike(NOT_BEFORE) & ~c["after"].rlike(NOT_AFTER)

    def all_of(v: Column) -> Column:
        n = F.size(v["first"])
        preferred = F.transform(v["lines"], lambda x, i: F.when(F.get(v["asked"], i), led(v, i, x).rlike(PREFERRED)))
        found = let(preferred, lambda flags: F.transform(F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda k: context(v, flags, k)), real), read))
        none = F.array().cast("array<struct<min_months:int,max_months:int,text:string,preferred:boolean>>")
        return F.when(n > 0, found).otherwise(none)

    plain = F.translate(text, "\u0001\u0002", "  ")
    found = let(let(F.regexp_replace(plain, MENTION, "\u0001$0\u0002"), views), all_of)
    return F.filter(found, lambda x: x["min_months"] <= MAX_MONTHS)
