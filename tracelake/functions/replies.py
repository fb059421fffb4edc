"""Language-model replies to typed columns, without Python: intervals and reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "array<array<int>>"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def related_intervals(reply: Column, tolerant: bool = True) -> Column:
    """Intervals of a reply: an object with ``related_code``, a list, either in a fence, else all its integers.

    A reply of bare integers, or with any element that is no pair, has no intervals: null. ``tolerant`` accepts
    commas before closing brackets.
    """

    def parse(body: Column) -> Column:
        body = F.regexp_replace(body, r",\s*([\]}])", "$1") if tolerant else body
        # A list stands for an object that holds it, so every reply is parsed once.
        whole = F.when(body.startswith("["), F.concat(F.lit('{"related_code": '), body, F.lit("}"))).otherwise(body)
        return F.from_json(whole, f"related_code {PAIRS}")["related_code"]

    def checked(found: Column) -> Column:
        return F.when(F.forall(found, lambda p: p.isNotNull() & (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()), found)

    # What stands between fences, where it is an object; else the whole reply.
    parts = F.transform(F.split(reply, "```", -1), lambda x: _strip(F.regexp_replace(x, "^json", "")))
    fenced = F.filter(parts, lambda x, i: (i % 2 == 1) & x.startswith("{"))
    body = F.when(reply.contains("```"), F.coalesce(F.get(fenced, F.lit(0)), _strip(reply))).otherwise(_strip(reply))
    return once(once(body, parse), checked)


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def integers(reply: Column) -> Column:
    """Last resort of a reply that is no JSON: every whole number in it."""
    return F.transform(F.regexp_extract_all(reply, F.lit(r"(?U)\b\d+\b"), F.lit(0)), lambda x: x.try_cast("bigint"))


#: Marker, titles and wording of reviews.
END_OF_REVIEW = "===== 审查分析过程结束 ====="
REVIEW_TITLE, ISSUES_TITLE = "审查分析过程", "问题单"
ISSUE = r"(?s)在\[.*?\]的\[.*?\]处，程序实现是.*?，而需求是.*?，实现与需求不一致，原因是.*?。"
NO_ISSUES = "未能解析出问题单"


def review(reply: Column) -> Column:
    """``STRUCT<review_process, issues>``: by the end marker, else by both titles, else by issue sentences, else whole."""

    def pair(process: Column, issues: Column) -> Column:
        return F.struct(process.alias("review_process"), issues.alias("issues"))

    def piece(text: Column, by: str, k: int) -> Column:
        return F.get(F.split(text, rf"\Q{by}\E", -1), F.lit(k))

    after = _strip(piece(reply, END_OF_REVIEW, 1))
    at = F.instr(after, ISSUES_TITLE)
    after = F.when(at > 0, _strip(F.substring(after, at + len(ISSUES_TITLE), F.length(after)))).otherwise(after)
    section = piece(reply, REVIEW_TITLE, 1)
    titled = F.when(
        section.contains(ISSUES_TITLE), pair(_strip(piece(section, ISSUES_TITLE, 0)), _strip(piece(section, ISSUES_TITLE, 1)))
    ).otherwise(pair(section, F.lit("")))
    sentences = F.regexp_extract_all(reply, F.lit(ISSUE), F.lit(0))
    before = F.substring(reply, F.lit(1), F.instr(reply, sentences[0]) - 1)
    return (
        F.when(reply.contains(END_OF_REVIEW), pair(_strip(piece(reply, END_OF_REVIEW, 0)), after))
        .when(reply.contains(REVIEW_TITLE) & reply.contains(ISSUES_TITLE), titled)
        .when(F.size(sentences) > 0, pair(_strip(before), F.array_join(sentences, "\n")))
        .when(reply.isNotNull(), pair(reply, F.lit(NO_ISSUES)))
    )
