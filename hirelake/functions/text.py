"""Text hygiene as column functions; each works on the whole text of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Encoding artefacts and their repair, in this order.
ARTEFACTS = (
    ("(cid:127)", " "), ("â†’", "→"), ("â€“", "–"), ("â€”", "—"),
    ("â€˜", "‘"), ("â€™", "’"), ("â€œ", "“"),
    ("â€•", "•"), ("â€", "”"), ("\ufeff", ""), ("\u00a0", " "),
)
# Words that lead a category, words that make them part of a name, and bare header words.
STRUCTURAL_LEADERS = ("cloud", "languages", "backend", "frontend", "databases", "database", "devops", "frameworks",
                      "libraries", "tools")
GENERIC_HEADS = ("computing", "development", "infrastructure", "native", "platform", "platforms", "services",
                 "engineering", "architecture", "systems")
HEADER_WORDS = ("languages", "language", "frontend", "front-end", "backend", "back-end", "cloud", "devops", "databases",
                "database", "tools", "framework", "frameworks", "libraries", "skills", "technologies", "stack", "platforms")
# Patterns of leading dates, bullets, page numbers.
LEADING_DATE = (r"(?i)^\s*(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+)?(?:19|20)\d{2}"
                r"(?:\s*(?:[–—-]|to)\s*(?:present|current|now|(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
                r"[a-z]*\.?\s+)?(?:19|20)\d{2}))?\s*")
PROSE_BULLET = r"^\s*(\(cid:\d+\)|[-*•●–>])\s*"
ITEM_BULLET = (r"^\s*(?:(?:[•‣⁃■▪▫●○◦·-]|\(cid:\d+\))\s*"
               r"|(?:[-*–—]|\d{1,2}[.)])\s+)")
LIST_BULLET = r"^\s*([-*•●–>]|\d+[.)])\s+"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?$"
MAX_BASE_WORDS = 4


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def unlines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def squeeze(c: Column) -> Column:
    """One blank for each run of white space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def in_sorted(known: Column, value: Column) -> Column:
    """Whether an ascending array holds the value, by halving."""
    n = F.size(known)
    halves = F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int") - 1, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2.0), b).cast("int"))
    at = F.aggregate(halves, F.lit(0), lambda low, h: F.when((low + h <= n) & (F.get(known, low + h - 1) <= value), low + h).otherwise(low))
    return F.when(n > 0, F.coalesce(F.get(known, at - 1) == value, F.lit(False))).otherwise(False)


def clean_text(text: Column) -> Column:
    """Repair encoding artefacts, collapse blanks, keep at most one blank line in a row."""
    for old, new in ARTEFACTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_dates(text: Column) -> Column:
    """Drop the date range in front of each line, and lines that hold nothing else."""
    out = F.transform(lines_of(text), lambda x: strip(F.regexp_replace(x, LEADING_DATE, "")))
    return unlines(F.filter(out, lambda x: x != ""))


def strip_bullets(text: Column) -> Column:
    """Drop bullet glyphs and blank lines, keep the sentences."""
    kept = F.filter(lines_of(F.coalesce(text, F.lit(""))), lambda x: strip(x) != "")
    return unlines(F.transform(kept, lambda x: strip(F.regexp_replace(x, PROSE_BULLET, ""))))


def clean_bullets(text: Column) -> Column:
    """Unify bullets to '- ', remove zero-width characters, drop empty bullets and page numbers."""

    def one(x: Column) -> Column:
        return squeeze(F.regexp_replace(F.replace(x, F.lit("\u00a0"), F.lit(" ")), "[\u200b\u200c\u200d\ufeff]", ""))

    def bullet(x: Column) -> Column:
        rest = strip(F.regexp_replace(x, ITEM_BULLET, ""))
        return F.when(~x.rlike(ITEM_BULLET), x).when(rest == "", "").when(x.rlike(r"^\d"), x).otherwise(F.concat(F.lit("- "), rest))

    out = F.transform(F.transform(lines_of(F.coalesce(text, F.lit(""))), one), bullet)
    return strip(unlines(F.filter(out, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))))


_GROUP = r"([^()\n,:|]+?)\s*\(([^()]*)\)"


def _expand_once(text: Column) -> Column:
    """Expand every innermost ``base (a, b)`` group of a lower-case text once.

    The groups are marked, the text is split at the marks, and each group is
    rewritten by itself.
    """
    # the look-behind only saves time: the first match of a run always starts where the run starts
    parts = F.split(F.regexp_replace(text, r"(?<![^()\n,:|])" + _GROUP, "\u0001$0\u0002"), "[\u0001\u0002]")

    def parsed(p: Column) -> Column:
        raw = F.regexp_extract(p, rf"^{_GROUP}$", 1)
        return F.struct(
            F.regexp_extract(raw, r"^\s*", 0).alias("lead"), strip(raw).alias("base"), words(raw).alias("w"),
            F.filter(F.transform(F.split(F.regexp_extract(p, rf"^{_GROUP}$", 2), "[,;|]"), strip), lambda x: x != "").alias("items"))

    def expanded(p: Column, g: Column) -> Column:
        w = g["w"]
        leader = F.get(w, F.lit(0)).isin(*STRUCTURAL_LEADERS) & (F.size(w) > 1) & ~F.get(w, F.lit(1)).isin(*GENERIC_HEADS)
        base = F.when(leader, F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " ")).otherwise(g["base"])
        skip = (F.size(w) == 0) | (F.size(w) > MAX_BASE_WORDS) | g["base"].rlike(r"[.!?]\s") | (F.size(g["items"]) == 0)
        new = let(base, lambda b: F.array_join(F.concat(F.array(b), F.transform(g["items"], lambda x: F.concat_ws(" ", b, x))), ", "))
        return F.when(skip, p).otherwise(F.concat(g["lead"], new))

    def rewrite(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, p).otherwise(let(parsed(p), lambda g: expanded(p, g)))

    return F.when(F.contains(text, F.lit("(")), F.array_join(F.transform(parts, rewrite), "")).otherwise(text)


def _nesting(text: Column) -> Column:
    """Deepest nesting of parentheses."""
    def step(s: Column, p: Column) -> Column:
        now = F.greatest(F.lit(0), s["now"] + F.when(p == "(", 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(text, F.lit("([()])"), F.lit(1)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def expand_parens(text: Column) -> Column:
    """Lower-case and turn ``x (a, b)`` into ``x, x a, x b``; long or prose bases stay.

    Each round removes one nesting level; the text's own depth gives the number
    of rounds, so the fixed point is reached whatever the depth.
    """
    plain = F.translate(F.lower(text), "\u0001\u0002", "  ")
    out = F.replace(F.regexp_replace(plain, r"\(\s*cid:127\s*\)", ", "), F.lit("\u2022"), F.lit(", "))
    rounds = lambda x: F.when(_nesting(x) > 0, F.sequence(F.lit(1), _nesting(x))).otherwise(F.array().cast("array<int>"))
    return let(out, lambda x: F.aggregate(rounds(x), x, lambda s, _: _expand_once(s)))


def strip_labels(text: Column) -> Column:
    """Drop category labels: 'tools:' lines, 'cloud: aws' prefixes, and bare headers above a skill list."""
    raw = F.transform(lines_of(text), strip)

    def labelled(raw_lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            nxt = F.coalesce(F.get(raw_lines, i + 1), F.lit(""))
            w = F.split(x, r"\s*&\s*|\s+")
            bare = (~x.rlike("[,|/:]") & (F.size(w) <= 4) & F.forall(w, lambda v: F.lower(v).isin(*HEADER_WORDS))
                    & (nxt != "") & (nxt.rlike("[,|]") | (F.size(words(nxt)) > 1)))
            rest = strip(F.regexp_replace(x, r"^[^:]*:", ""))
            prefix = strip(F.regexp_extract(x, r"^([^:]*):", 1))
            colon = F.when(rest == "", "").when(prefix != "", rest).otherwise(x)
            return F.when(bare, "").when(x.contains(":"), colon).otherwise(x)

        return F.filter(F.transform(raw_lines, one), lambda x: x != "")

    return unlines(let(raw, labelled))


def normalize_heading(text: Column) -> Column:
    """Canonical heading: plain quotes, ' & ' spaced, blanks collapsed, no trailing colon, lower case."""
    t = F.translate(F.coalesce(text, F.lit("")), "\u2019\u2018\u00a0", "'' ")
    t = squeeze(F.regexp_replace(t, r"\s*&\s*", " & "))
    return F.lower(F.trim(F.regexp_replace(t, r":+$", "")))


def compact_heading(text: Column) -> Column:
    """Letters and digits only, so letter-spaced and glued headings compare equal."""
    return F.regexp_replace(normalize_heading(text), "[^a-z0-9]", "")


def file_stem(name: Column) -> Column:
    """Lower-case file name without extension and without a copy mark like ' (2)'."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"\s*\(\d+\)$", ""))


def eval_normalize(text: Column) -> Column:
    """Plain quotes and dashes, no leading bullet, blanks collapsed, no trailing colon, lower case."""
    t = F.translate(F.coalesce(text, F.lit("")), "’‘“”–—", "''\"\"--")
    t = F.regexp_replace(t, r"^\s*(?:\(cid:\d+\)|[-*•●>]|\d{1,2}[.)](?=\s))\s*", "")
    return F.trim(F.regexp_replace(F.lower(squeeze(t)), ":+$", ""))


def format_label(value: Column) -> Column:
    """'full_time' -> 'Full time'."""
    t = F.replace(value, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


# Stored extension per verified content type.
EXTENSIONS = {"application/pdf": ".pdf",
              "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
              "image/png": ".png", "image/jpeg": ".jpg", "image/webp": ".webp"}


def safe_extension(name: Column, content_type: Column) -> Column:
    """Extension by verified type, else the name's own when it is a known one, else empty."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    own = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.coalesce(F.try_element_at(table, content_type), F.when(own.isin(*EXTENSIONS.values()), own), F.lit(""))


def safe_file_name(name: Column) -> Column:
    """ASCII name for a response header."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("file")), "[\r\n]", ""), "[^A-Za-z0-9._-]", "_")
    return F.when(t == "", "file").otherwise(t)
