"""String functions whose edge cases follow Python's: strip, spans of all matches, sections' text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as p


def strip(c: Column) -> Column:
    """Without white space of any kind around."""
    return F.btrim(c, F.lit(p.ANY_SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(p.ANY_SPACES))


def running_sums(numbers: Column) -> Column:
    """Sums of an array's numbers up to each place, by doubling: n log n steps and no growing copy."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d < F.size(numbers))
    return F.aggregate(steps, numbers, lambda sums, d: F.transform(sums, lambda x, i: x + F.when(i >= d, F.get(sums, i - d)).otherwise(0)))


def spans(text: Column, pattern: str) -> Column:
    """array of (start, end, hit) of all matches, in code points.

    Gaps between matches and the matches alternate, so running lengths give the
    places; texts without a match skip all but the test.
    """
    rx = _java(pattern)
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    found = F.struct(F.split(text, rx, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("hits"))
    # lambda variables hold the matches and the sums: they are computed once, not once a match
    lengths = lambda s: F.transform(s["hits"], lambda h, i: F.length(F.get(s["gaps"], i)) + F.length(h))
    placed = F.transform(
        F.array(found),
        lambda s: F.get(
            F.transform(
                F.transform(F.array(lengths(s)), running_sums),
                lambda ends: F.transform(s["hits"], lambda h, i: F.struct((F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"))),
            ),
            F.lit(0),
        ),
    )
    return F.when(text.rlike(rx), F.get(placed, F.lit(0))).otherwise(none)


def _java(pattern: str) -> str:
    """Line ends are line feeds only, as in Python."""
    return f"(?d){pattern}" if pattern.startswith("(?") and "m" in pattern[: pattern.index(")")] else pattern


def has(text: Column, pattern: str) -> Column:
    return text.rlike(_java(pattern))


def first_group(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match; null if there is none."""
    return F.when(has(text, pattern), F.regexp_extract(text, _java(pattern), group))


def part_of(item: Column) -> Column:
    """Part number of an item number, 0 if unknown."""
    from .. import dims

    lookup = F.create_map(*[F.lit(x) for n, part, _ in dims.ITEMS for x in (n, part)])
    return F.coalesce(F.try_element_at(lookup, item), F.lit(0))


def roman(n: Column) -> Column:
    return F.when(n.between(1, 4), F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV")]), F.greatest(F.least(n, F.lit(4)), F.lit(1)))).otherwise(n.cast("string"))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def excerpt(c: Column, most: int = 1500) -> Column:
    return F.struct(F.substring(c, 1, most).alias("excerpt"), (F.length(c) > most).alias("truncated"))


def shorten(c: Column, most: int = 240) -> Column:
    """One line, cut with three dots."""
    line = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most), F.lit("...")))


def bleed_trimmed(text: Column) -> Column:
    """Without the next section that ran on into this one: cut at the second ``Item N.`` and then at a part header past place 100."""
    second = F.get(spans(text, p.BLEED), F.lit(1))["start"]
    cut = F.when(second.isNull(), text).otherwise(rstrip(F.substring(text, F.lit(1), second)))
    # the cut text is held in a one-element array, so that it is computed once
    return F.get(F.transform(F.array(cut), _at_part_header), F.lit(0))


def _at_part_header(t: Column) -> Column:
    at = F.length(F.get(F.split(t, p.PART_HEADER, 2), F.lit(0)))
    return F.when(has(t, p.PART_HEADER) & (at > 100), rstrip(F.substring(t, F.lit(1), at))).otherwise(t)


def section_title(text: Column, item: Column) -> Column:
    """Title of a section text that starts with ``Item N``, for the row's own item number."""
    head = F.regexp_replace(F.replace(text, F.lit(p.NBSP), F.lit(" ")), f"\\A{p.ANY_SPACE}+", "")
    number = F.concat(F.lit("\\Q"), item, F.lit("\\E"))
    wide = F.concat(F.lit("(?i)\\Aitem\\s+"), number, F.lit(f"\\.?\\s*[-{p.DASH}:.]?\\s*([^\\n]{{0,120}}?)\\s\\s"))
    prefix = F.concat(F.lit("(?i)\\Aitem\\s+"), number, F.lit("\\.?\\s*"))
    line = F.get(F.split(head, "\n", 2), F.lit(0))
    return F.when(F.regexp_like(head, wide), strip(F.call_function("regexp_extract", head, wide, F.lit(1)))).otherwise(strip(F.substring(F.regexp_replace(line, prefix, F.lit("")), 1, 80)))


def looks_asset_backed(raw_text: Column) -> Column:
    head = F.lower(F.substring(raw_text, 1, 20000))
    return F.contains(head, F.lit("regulation ab")) | head.rlike(p.REGULATION_AB)
