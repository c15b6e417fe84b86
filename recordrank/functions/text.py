"""Normalising and parsing of text, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def listed(c: Column) -> Column:
    """The value, or null for an empty text or the sentinel."""
    return F.when(~F.trim(c).isin("", V.NOT_LISTED), c)


def normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(*parts: Column) -> Column:
    """A record's id: letters and digits of the parts, at most 80."""
    return F.substring(normalise(F.concat_ws("", *parts)), 1, 80)


def title_key(title: Column) -> Column:
    t = F.lower(title)
    for pattern in (r"\b20\d{2}\b", r"\bbatch\s*\d+\b", r"\bbatch\s*[ivxlcdm]+\b"):
        t = F.regexp_replace(t, pattern, "")
    words = F.regexp_extract_all(t, F.lit("([a-z]+)"))
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(V.TITLE_STOP)), "")


def clean(c: Column) -> Column:
    """For an export: one line, empty for null and the sentinel."""
    return F.trim(F.regexp_replace(F.coalesce(listed(c), F.lit("")), "[\r\n]", " "))


def domain(url: Column) -> Column:
    return F.array_join(F.slice(F.split(url, "/"), 1, 3), "/")


def first_in(text: Column, words: list[str]) -> Column:
    """The first word, in the list's order, that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])


def all_in(text: Column, words: list[str]) -> Column:
    """The words that the text contains, in the list's order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def any_in(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def grade_tries(text: Column) -> list[Column]:
    """The number of each pattern's first match; the first in 2.0 to 4.0 is the required grade."""
    return [F.replace(matched(text, p), F.lit(","), F.lit(".")).try_cast("decimal(3,2)") for p in V.GRADE_PATTERNS]


def grade_phrase(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?:{V.GRADE_PHRASES})"), F.lit(False))


#: A month in an address.
URL_MONTH = r"/(\d{2})/(20\d{2})/"


def groups(text: Column, pattern: str) -> Column:
    """The groups of the first match, or null where the pattern does not match."""
    n = pattern.replace("(?:", "").replace("\\(", "").count("(")
    return F.when(text.rlike(f"(?i){pattern}"), F.array(*[F.regexp_extract(text, f"(?i){pattern}", i + 1) for i in range(n)]))


def url_deadline(found: Column) -> Column:
    """The month's end for the groups of ``URL_MONTH``."""
    month, year = found[0].cast("int"), found[1].cast("int")
    return F.when(month.between(1, 12) & year.between(2024, 2030), F.last_day(F.try_to_date(F.concat(found[1], F.lit("-"), found[0], F.lit("-01")), "yyyy-MM-dd")))


def text_deadline(found: list[Column]) -> Column:
    """The date of the first pattern that matches, from all patterns' groups; null when that date does not exist."""
    months = F.create_map(*[F.lit(x) for kv in V.MONTHS.items() for x in kv])
    out = F
    for g, (_, kind) in zip(found, V.DEADLINE_PATTERNS):
        y, m, d = (g[0], g[1], g[2]) if kind == "ymd" else (g[2], F.try_element_at(months, F.lower(g[1])).cast("string"), g[0])
        day = F.try_to_date(F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        out = out.when(g.isNotNull(), day)
    return out


def company_type(name: Column, known: Column | None = None) -> Column:
    """The kind of a company by its name, unless it is known."""
    low = F.coalesce(F.lower(name), F.lit(""))
    kind = F.when(any_in(low, V.STATE_OWNED), "BUMN").when(any_in(low, V.MULTINATIONAL), "Multinasional").otherwise("Swasta")
    return kind if known is None else F.coalesce(listed(known), kind)


def feed_title(title: Column) -> tuple[Column, Column]:
    """Title and company of a feed's title ``title - company - site``."""
    parts = F.split(title, " - ", -1)
    n = F.size(parts)
    return F.when(n >= 2, parts[0]).otherwise(title), F.when(n >= 3, F.element_at(parts, -2)).when(n == 2, F.element_at(parts, -1))


def company_of_title(title: Column) -> Column:
    """A company named in a title: a firm after an at sign, a dash or one of two prepositions, a group, or a name of several words after a dash."""
    return F.coalesce(*[F.nullif(F.regexp_replace(F.trim(matched(title, p)), "[.,]+$", ""), F.lit("")) for p in V.COMPANY_IN_TITLE])


def company_of_body(body: Column, chars: int = 2000) -> Column:
    """A firm or a bank named in the first characters of a page's body, but for names that are known to be none."""
    start = F.substring(body, 1, chars)
    found = [F.regexp_replace(F.trim(F.nullif(F.regexp_extract(start, p, 0), F.lit(""))), "[.,]+$", "") for p in V.COMPANY_IN_BODY]
    return F.coalesce(*[F.when(~f.isin(V.NOT_COMPANIES), f) for f in found])


def joined_fields(columns: list[str], fields: list[str]) -> Column:
    """The texts of those fields that a table has, without missing ones."""
    return F.concat_ws(" ", *[listed(F.col(c)) for c in fields if c in columns])


def industry_of(why: Column) -> Column:
    """The industry named in an explanation's text."""
    return F.nullif(F.trim(F.regexp_extract(why, r"Industry match:\s([^;]+)", 1)), F.lit(""))


def parts(text: Column, separator: str = ";") -> Column:
    """The parts of a joined text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, separator), F.trim), lambda x: x != "")


def grade_mark(status: Column) -> Column:
    """A message's mark for a grade status."""
    return F.when(status.isin("Meets GPA", "Priority GPA Match", "No GPA Listed"), "ok").when(F.contains(status, F.lit("Slight")), "warn").when(F.contains(status, F.lit("High")), "bad").otherwise("note")


def deadline_label(status: Column, days: Column) -> Column:
    return F.when(status == "Expired", "Expired").when(days.isNotNull(), F.concat(days.cast("string"), F.lit("d left"))).otherwise(status)


def document_variant(title: Column, rules: list[tuple[str, list[str], str]], default: str, language: Column | None = None) -> Column:
    """The document to send with an application: that of the first rule that holds."""
    low, out = F.coalesce(F.lower(title), F.lit("")), F
    for kind, words, variant in rules:
        if kind == "language":
            holds = F.lit(False) if language is None else F.coalesce(language.isin(words), F.lit(False))
        elif kind == "any":
            holds = any_in(low, words)
        else:
            holds = ~F.exists(F.array(*[F.lit(w) for w in words]), lambda w: ~low.contains(w))
        out = out.when(holds, variant)
    return out.otherwise(default)


_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
#: References without which a text would be read as markup.
MARKUP = ("&lt;", "&gt;", "&amp;")


def unescaped(c: Column, names: Iterable[str] = tuple(_NAMED)) -> Column:
    """Common character references, or those of ``names``, as text; ``&amp;`` comes last."""
    for name in names:
        c = F.replace(c, F.lit(name), F.lit(_NAMED[name]))
    return c


def city(text: Column) -> Column:
    return F.initcap(first_in(F.lower(text), V.CITIES))


def plain(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def heading(html: Column, names: Iterable[str] = tuple(_NAMED)) -> Column:
    """The text of a page's first heading, its character references decoded as by ``unescaped``."""
    return unescaped(F.trim(plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))), names)


def title_of(heading: Column, link_title: Column) -> Column:
    """A posting's title: its page's first heading, else the text of the link that led there."""
    return F.coalesce(F.nullif(F.trim(heading), F.lit("")), link_title)


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.substring(text, 1, size), F.lit("...")))


def company_stem(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i)\b(pt|tbk|cv|ltd|inc|group|corp|corporation|indonesia|persero)\b\.?", ""))
