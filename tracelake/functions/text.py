"""Text and path functions as columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|\r|\n"


def lines(text: Column) -> Column:
    """Lines without terminators. A final terminator opens no further line; null and empty text have none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def split_lines(text: Column, empty_last_line: bool = False) -> Column:
    """Lines that keep their terminators; the last one has none. An empty last line counts only if asked for."""
    found = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(r"[^\r\n]*(?:\r?\n|\r)"), F.lit(0))
    last = F.element_at(found, -1)
    head = F.slice(found, F.lit(1), F.size(found) - 1)
    cut = F.concat(head, F.array(F.substring(last, F.lit(1), F.length(last) - 1)))
    return cut if empty_last_line else F.when(last == "\n", head).otherwise(cut)


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def nonblank_count(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: ~is_blank(x))).cast("long")


def numbered(text: Column) -> Column:
    """``n: line`` of every line, from one."""
    return F.transform(lines(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))


def padded_number(n: Column) -> Column:
    """``n:`` filled to width five; longer numbers are left whole."""
    label = F.concat(n.cast("string"), F.lit(":"))
    return F.when(F.length(label) < 5, F.rpad(label, 5, " ")).otherwise(label)


def regularize(text: Column, kind: str = "code") -> Column:
    """Unix line ends, no zero-width spaces; in documents adjoining inline formulas are parted."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r?\n|\r", "\n"), "\u200b", "")
    return F.regexp_replace(out, r"(?<=\S)\$\$(?=\S)", r"\$ \$") if kind == "doc" else out


def formulas(text: Column, compat: bool = False) -> Column:
    """Formulas of a text, trimmed: ``$x$`` inline, ``$$ x $$`` display.

    By default display formulas are matched first. ``compat`` matches inline ones first, so ``$$x$$`` yields two
    empty display formulas.
    """
    inline, display = r"\$(.*?)\$", r"\$\$(.*?)\$\$"
    first, second = (inline, display) if compat else (display, inline)
    pattern = F.lit(f"(?s){first}|{second}")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1 if compat else 2)).alias("i"),
        F.regexp_extract_all(text, pattern, F.lit(2 if compat else 1)).alias("d"),
    )

    def strip(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")

    return F.transform(
        pairs,
        lambda p: F.when(p["i"] != "", F.concat(F.lit("$"), strip(p["i"]), F.lit("$"))).otherwise(
            F.concat(F.lit("$$ "), strip(p["d"]), F.lit(" $$"))
        ),
    )


def row_map(headers: Column, cells: Column) -> Column:
    """Header to cell, as far as both go; of equal headers the last wins."""
    n = F.least(F.size(headers), F.size(cells))
    pairs = F.zip_with(F.slice(headers, F.lit(1), n), F.slice(cells, F.lit(1), n), lambda h, c: F.struct(h.alias("key"), c.alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def stem_last_dot(name: Column) -> Column:
    """Name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", "")


def stem_first_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def normalize_path(path: Column) -> Column:
    """One kind of separator, no runs of it, exactly one at the end; backslash if the path has any."""
    windows = path.contains("\\")
    one = F.when(windows, F.regexp_replace(path, r"[\\/]+", r"\\")).otherwise(F.regexp_replace(path, "/+", "/"))
    full = F.concat(F.regexp_replace(one, r"[\\/]$", ""), F.when(windows, F.lit("\\")).otherwise(F.lit("/")))
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(full)


def folder_name(path: Column) -> Column:
    """Last part of a path, whatever separators and however many stand at its end."""
    return F.regexp_extract(path, r"([^\\/]*)[\\/]*$", 1)


def inside(path: Column, root: Column) -> Column:
    """Whether a path lies in a folder: equal, or the folder and a separator are its beginning, without ``..`` parts."""
    base = F.regexp_replace(root, "/+$", "")
    return ((path == base) | F.startswith(path, F.concat(base, F.lit("/")))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def relative_time(past: Column, now: Column) -> Column:
    """Age in words. The wording and its limits."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(past)
    minutes, hours, days = (F.floor(seconds / n).cast("long") for n in (60, 3600, 86400))
    months = F.floor(days / 30).cast("long")
    return (
        F.when(seconds < 60, F.lit("刚刚"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("分钟前")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("小时前")))
        .when(days == 1, F.lit("昨天"))
        .when(days < 30, F.concat(days.cast("string"), F.lit("天前")))
        .when(months < 12, F.concat(months.cast("string"), F.lit("个月前")))
        .otherwise(F.concat(F.floor(months / 12).cast("long").cast("string"), F.lit("年前")))
    )


def slice_ranges(source: Column, ranges: Column) -> Column:
    """Parts of a text by half-open character ranges (start, end): distinct, by start, joined by newline."""
    ordered = F.array_sort(F.array_distinct(ranges))
    return F.array_join(F.transform(ordered, lambda r: F.substring(source, r["start"] + 1, r["end"] - r["start"])), "\n")


def clean_latex(text: Column) -> Column:
    """Spacing debris out, blank runs to one empty line, trimmed."""
    out = F.regexp_replace(text, r"\\kern-\\nulldelimiterspace|kern\{2pt\}", "")

    def column_types(m: Column) -> Column:
        """``{*{3}{c}}`` -> ``{ccc}``"""
        n = F.regexp_extract(m, r"\{\*\{(\d{1,3})\}", 1).cast("int")
        return F.concat(F.lit("\\begin{array}{"), F.repeat(F.regexp_extract(m, r"\}\{(\w+)\}\}$", 1), n), F.lit("}"))

    repeated = r"\\begin\{array\}\{\*\{\d{1,3}\}\{\w+\}\}"
    found = F.regexp_extract_all(out, F.lit(repeated), F.lit(0))
    between = F.split(out, repeated, -1)
    pieces = F.zip_with(between, F.transform(found, column_types), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), r"\n{2,}", "\n\n"))
