"""Column functions over text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sign of a refused answer, and phrases that tell of missing material.
SENTINEL = "INSUFFICIENT_CONTEXT"
REFUSALS = (
    "insufficient_context", "没有找到足够", "资料中没有", "资料未提及", "资料未说明", "未说明", "未给出", "没有提及",
    "未提及", "未提到", "没有提到", "无法回答", "无法从提供", "不足以回答", "没有相关信息", "不涉及",
)
#: Fixed value: signs that are written without blanks between words.
CJK = r"\u4e00-\u9fff"
#: Fixed value: a citation, in half- or full-width brackets.
CITATION = r"(?U)[\[【]\s*来源\s*[:：]\s*(?<file>[^\[\]【】\s]+?)\s*第\s*(?<page>\d+)\s*页\s*[\]】]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(t) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(t), r"(?U)^\s+|\s+$", "")


def newlines(t) -> Column:
    return F.regexp_replace(_c(t), r"\r\n?", "\n")


def collapse_blanks(t) -> Column:
    return F.regexp_replace(_c(t), "[ \t ]+", " ")


def content_id(t) -> Column:
    """First 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(_c(t).cast("binary")), 1, 16)


def words(t) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(_c(t), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _bigrams(run) -> Column:
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens(t) -> Column:
    """The built-in tokenizer: words(), with runs of CJK signs as overlapping pairs of signs.

    Any other function of a text column to an array of strings can stand in its place, for the index
    and for questions alike.
    """
    plain = words(t)
    parts = lambda w: F.flatten(F.transform(F.regexp_extract_all(w, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0)), lambda r: F.when(r.rlike(f"^[{CJK}]"), _bigrams(r)).otherwise(F.array(r))))
    return F.when(_c(t).rlike(f"[{CJK}]"), F.flatten(F.transform(plain, parts))).otherwise(plain)


def basename(path, default: str = "unknown") -> Column:
    return F.coalesce(F.element_at(F.split(_c(path), "/"), -1), F.lit(default))


def page_of(label, page) -> Column:
    """The label, else the page number from one, else unknown."""
    return F.coalesce(_c(label).cast("string"), (_c(page) + 1).cast("string"), F.lit("unknown"))


def normal_page(page) -> Column:
    p = F.trim(_c(page))
    return F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(p)


def is_body(t) -> Column:
    """Running text rather than a table of contents or a fragment."""
    return ~F.contains(_c(t), F.lit("....")) & (F.length(strip(t)) >= 150)


def has_any(t, words, ignore_case: bool = False) -> Column:
    text = F.lower(_c(t)) if ignore_case else _c(t)
    return F.exists(_c(words), lambda w: F.contains(text, F.lower(w) if ignore_case else w))


def snippet(t, n: int = 60) -> Column:
    return F.substring(F.replace(_c(t), F.lit("\n"), F.lit(" ")), 1, n)


def is_refusal(t) -> Column:
    return F.contains(F.upper(F.substring(F.coalesce(_c(t), F.lit("")), 1, 40)), F.lit(SENTINEL))


def refusal_state(t) -> Column:
    """Struct (refused, partial_gap) by where a phrase stands and how long the answer is."""
    s = strip(F.coalesce(_c(t), F.lit("")))
    holds = lambda x: F.greatest(*[F.contains(F.lower(x), F.lit(p)) for p in REFUSALS])
    gap = holds(s)
    state = lambda refused, partial: F.struct(F.lit(refused).alias("refused"), partial.alias("partial_gap"))
    sentinel = F.contains(F.lower(F.substring(s, 1, 40)), F.lit(SENTINEL.lower()))
    return F.when(sentinel | (gap & (F.length(s) < 100)), state(True, F.lit(False))).when(holds(F.substring(s, 1, 30)), state(True, gap)).otherwise(state(False, gap))


def verdict(t) -> Column:
    """Struct (verdict, reason) of a judge's reply: the first sign decides, the reason follows a bar or the first sign."""
    s = strip(F.coalesce(_c(t), F.lit("")))
    yes = F.substring(s, 1, 1).isin("是", "Y", "y", "1") | F.lower(s).rlike("^(yes|true)")
    after_bar = strip(F.regexp_extract(s, r"(?s)^[^|]*\|(.*)$", 1))
    rest = strip(F.regexp_replace(F.substring(s, 2, 1 << 30), "^[：:，, ]+", ""))
    reason = F.when(F.contains(s, F.lit("|")), after_bar).otherwise(rest)
    return F.struct((yes & (s != "")).alias("verdict"), F.when(s == "", "(empty reply)").otherwise(F.substring(reason, 1, 40)).alias("reason"))


def claims(t) -> Column:
    """Struct (total, supported, score, parse_failed) of the JSON between the first and last brace."""
    body = F.regexp_extract(F.coalesce(_c(t), F.lit("")), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "claims array<struct<claim:string,supported:boolean,reason:string>>")["claims"]
    kept = F.filter(parsed, lambda c: c.isNotNull())
    total, held = F.size(kept).cast("long"), F.size(F.filter(kept, lambda c: c["supported"])).cast("long")
    failed = parsed.isNull()
    none = F.lit(None).cast("double")
    return F.struct(F.when(failed, 0).otherwise(total).cast("long").alias("total"), F.when(failed, 0).otherwise(held).cast("long").alias("supported"), F.when(failed | (total == 0), none).otherwise(held / total).alias("score"), failed.alias("parse_failed"))


def citations(t) -> Column:
    """Array of (file, page) in order, repeats kept."""
    text = F.coalesce(_c(t), F.lit(""))
    files = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.transform(F.arrays_zip(files.alias("f"), pages.alias("p")), lambda x: F.struct(x["f"].alias("file"), normal_page(x["p"]).alias("page")))


def citation_report(t, keys) -> Column:
    """Struct (count, valid, invalid, validity, has_citation, cited_sources); validity is null without citations."""
    found, known = citations(t), _c(keys)
    good = F.filter(found, lambda x: F.array_contains(known, x))
    n = F.size(found).cast("long")
    return F.struct(
        n.alias("count"), F.size(good).cast("long").alias("valid"), F.filter(found, lambda x: ~F.array_contains(known, x)).alias("invalid"),
        F.when(n > 0, F.size(good) / n).alias("validity"), (n > 0).alias("has_citation"), F.array_sort(F.array_distinct(F.transform(good, lambda x: x["file"]))).alias("cited_sources"),
    )


def cache_key(*parts) -> Column:
    """Twenty hex digits over parts joined by NUL; a null part counts as empty."""
    return F.substring(F.sha1(F.concat_ws("\0", *[F.coalesce(_c(p), F.lit("")) for p in parts]).cast("binary")), 1, 20)


def ratio(num, den) -> Column:
    """num / den, zero where there is nothing to divide by."""
    return F.when(_c(den) == 0, 0.0).otherwise(F.coalesce(_c(num) / _c(den), F.lit(0.0)))


def entry(m, key: str, default: str) -> Column:
    """An entry of a map, or the default."""
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(default))


def merged(a, b) -> Column:
    """Two maps as one; entries of the second win, and a null map is an empty one."""
    first, second = F.coalesce(_c(a), F.create_map().cast("map<string,string>")), F.coalesce(_c(b), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
