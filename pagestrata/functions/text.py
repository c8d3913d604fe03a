"""Title and text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions import fixed

MIN_TITLE, CAP, PREVIEW = 15, 8_000, 160


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units, which the title gates count."""
    return F.octet_length(F.encode(s, "UTF-16BE")) / 2


def any_of(s: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (s.rlike(p) for p in patterns))


def tidy(title: Column) -> Column:
    """Without an unread count in front; white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\(\d+\)\s*", ""), r"[\s ]+", " "))


def tail(title: Column) -> Column:
    """The part after the last separator, lower case; null if there is none or it has not 1 to 40 characters."""
    parts = F.split(title, fixed.SEPARATOR)
    last = F.trim(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & utf16_length(last).between(1, 40), F.lower(last))


def strip_suffix(title: Column, suffixes: Column) -> Column:
    """Drops up to three trailing parts that are in ``suffixes``, while at least eight characters remain."""
    step = lambda t: F.trim(F.array_join(F.slice(F.split(t, fixed.SEPARATOR), F.lit(1), F.size(F.split(t, fixed.SEPARATOR)) - 1), " - "))
    known = lambda t: (F.size(F.split(t, fixed.SEPARATOR)) > 1) & F.array_contains(suffixes, F.lower(F.trim(F.element_at(F.split(t, fixed.SEPARATOR), -1))))
    start = F.struct(title.alias("t"), F.lit(True).alias("on"))

    def once(s: Column, _: Column) -> Column:
        shorter = F.when(s["on"] & known(s["t"]), step(s["t"])).otherwise("")
        ok = utf16_length(shorter) >= 8
        return F.struct(F.when(ok, shorter).otherwise(s["t"]).alias("t"), (s["on"] & ok).alias("on"))

    return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, once, lambda s: s["t"])


def is_bare_url(title: Column) -> Column:
    return (utf16_length(title) >= 30) & title.rlike("^[!-~]+$") & (title.rlike(r"(?i)^(https?://)?[a-z0-9-]+(\.[a-z0-9-]+)+/") | title.rlike("[?&=%]") | title.rlike(r"(?i)^[a-f0-9]{16,}\.[a-z0-9]{2,5}$"))


def is_junk(title: Column, original: Column) -> Column:
    t, raw = F.trim(title), F.trim(original)
    exact = any_of(t, fixed.JUNK_EXACT) & ((t == raw) | any_of(raw, fixed.JUNK_EXACT))
    return (t == "") | exact | any_of(t, fixed.JUNK_STRONG) | is_bare_url(t) | ((utf16_length(t) <= 40) & any_of(t, fixed.JUNK_PREFIX))


def cap(text: Column, most: int = CAP) -> Column:
    """Collapsed white space, cut at ``most``: at the last space if that lies beyond nine tenths."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))

    def shortened(cut: Column) -> Column:
        at = most - F.locate(" ", F.reverse(cut))
        return F.when(F.contains(cut, F.lit(" ")) & (at > most * 0.9), F.substring(cut, F.lit(1), at.cast("int"))).otherwise(cut)

    return let(flat, lambda flat: F.when(F.length(flat) <= most, flat).otherwise(let(F.substring(flat, 1, most), shortened)))


def terms(text: Column) -> Column:
    """Label terms: words of two characters and a letter at least; of unspaced scripts, short runs whole and longer ones as pairs."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(fixed.TERM_RUN), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    one = lambda r: F.when(~r.rlike(fixed.UNSPACED), F.when(((F.length(r) >= 2) | (utf16_length(r) >= 2)) & r.rlike(r"\p{L}"), F.array(r)).otherwise(F.array().cast("array<string>"))).when(F.length(r) <= 3, F.array(r)).otherwise(pairs(r))
    return F.flatten(F.transform(runs, one))


def phrases(words: Column, longest: int = 4) -> Column:
    """Words and runs of up to ``longest`` words; a run may not begin or end with a stopword."""
    stop = F.array(*map(F.lit, fixed.BOUNDARY_STOPWORDS.split()))
    out = [words]
    for n in range(2, longest + 1):
        spans = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), _slicer(words, n))).otherwise(F.array().cast("array<array<string>>"))
        kept = F.filter(spans, lambda s: ~F.array_contains(stop, F.element_at(s, 1)) & ~F.array_contains(stop, F.element_at(s, -1)))
        out.append(F.transform(kept, lambda s: F.array_join(s, " ")))
    return F.concat(*out)


def _slicer(words: Column, n: int):
    return lambda i: F.slice(words, i, F.lit(n))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quality(text: Column, page_length: Column) -> Column:
    """How much an extracted text looks like prose: a struct with its counts, ratios, score and verdict."""

    def counted(t: Column) -> Column:
        sample = F.substring(t, 1, 2000)
        latin = (F.length(sample) > 0) & (F.regexp_count(sample, F.lit("[A-Za-z]")) / F.length(sample) > 0.3)
        return F.struct(
            utf16_length(t).cast("long").alias("chars"), F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)).alias("words"), F.regexp_count(t, F.lit(fixed.TERMINATOR)).alias("ends"),
            F.regexp_count(t, F.lit(fixed.IDEOGRAPHIC)).alias("signs"), latin.alias("latin"), (~t.rlike(fixed.NO_TERMINATORS)).alias("uses_ends"))

    def measured(c: Column) -> Column:
        words = c["words"]
        stop = F.array(*map(F.lit, fixed.PROSE_STOPWORDS.split()))
        # Without such signs in the text no word has one.
        plain = F.when(c["signs"] == 0, F.size(words)).otherwise(F.size(F.filter(words, lambda w: ~w.rlike(fixed.IDEOGRAPHIC))))
        sets = let(F.array_distinct(words), lambda u: F.struct(F.size(u).alias("unique"), F.size(F.array_intersect(u, stop)).alias("stops")))
        return F.struct(*(c[k].alias(k) for k in ("chars", "ends", "latin", "uses_ends")), F.size(words).alias("words"), (c["signs"] + plain).alias("units"), sets.alias("sets"))

    def rated(m: Column) -> Column:
        unique, stops = m["sets"]["unique"], m["sets"]["stops"]
        ratio = F.when(m["latin"], F.when(unique > 0, stops / unique).otherwise(0.0))
        per_100 = F.when(m["units"] > 0, m["ends"] / m["units"] * 100).otherwise(0.0)
        parts = [(F.lit(0.35), F.least(F.lit(1.0), m["units"] / 250)), (F.when(ratio.isNotNull(), 0.4).otherwise(0.0), F.coalesce(F.least(F.lit(1.0), ratio / 0.3), F.lit(0.0))), (F.when(m["uses_ends"], 0.25).otherwise(0.0), F.least(F.lit(1.0), per_100 / 4))]
        score = F.round(sum((w * v for w, v in parts), F.lit(0.0)) / sum((w for w, _ in parts), F.lit(0.0)), 3)
        return F.struct(m.alias("m"), ratio.alias("ratio"), per_100.alias("per_100"), score.alias("score"), F.when(m["words"] > 0, unique / m["words"]).otherwise(0.0).alias("types"))

    def judged(r: Column) -> Column:
        m, score = r["m"], r["score"]
        poor = ((m["units"] >= 115) & (m["ends"] == 0) & m["uses_ends"]) | (m["units"] < 65) | (score < 0.35)
        return F.struct(
            m["chars"].alias("chars"), F.round(F.when(page_length > 0, F.least(F.lit(1.0), m["chars"] / page_length)).otherwise(0.0), 3).alias("coverage"), F.round(r["ratio"], 3).alias("stopword_ratio"),
            F.round(r["per_100"], 1).alias("terminators_per_100"), F.round(r["types"], 3).alias("type_token_ratio"),
            m["units"].cast("long").alias("units"), score.alias("score"), F.when(poor, "poor").when(score < 0.6, "weak").otherwise("good").alias("verdict"))

    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c "))
    return let(t, lambda t: let(counted(t), lambda c: let(measured(c), lambda m: let(rated(m), judged))))


def ladder(candidates: list[tuple[int, Column]], page_length: Column) -> Column:
    """Of (tier, text) in order, the first that isn't poor, else the best score, else an empty text of the last tier."""
    made = F.filter(F.array(*(F.struct(F.lit(tier).alias("tier"), cap(text).alias("text")) for tier, text in candidates)), lambda c: c["text"] != "")
    last = candidates[-1][0]

    def chosen(judged: Column, page_length: Column) -> Column:
        best = F.element_at(F.array_sort(judged, lambda a, b: F.when(a["quality"]["score"] > b["quality"]["score"], -1).when(a["quality"]["score"] < b["quality"]["score"], 1).otherwise(a["tier"] - b["tier"])), 1)
        good = F.get(F.filter(judged, lambda c: c["quality"]["verdict"] != "poor"), F.lit(0))
        empty = F.struct(F.lit(last).alias("tier"), F.lit("").alias("text"), quality(F.lit(""), page_length).alias("quality"))
        return F.when(F.size(judged) == 0, empty).otherwise(F.coalesce(good, best))

    # The page's length and the candidates' qualities are each computed once, not wherever they are looked at.
    judged = lambda n: F.transform(made, lambda c: F.struct(c["tier"].alias("tier"), c["text"].alias("text"), quality(c["text"], n).alias("quality")))
    return let(page_length, lambda n: let(judged(n), lambda j: chosen(j, n)))


def html_text(html: Column) -> Column:
    """The text of an HTML fragment: no scripts, styles or comments; entities of markup resolved."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)</(p|div|h[1-6]|li|ul|tr|article|section)>|<br\s*/?>", "\n"), r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(bare)


def html_title(html: Column) -> Column:
    return html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_article(html: Column) -> Column:
    return html_text(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1))


def html_meta(html: Column, name: str) -> Column:
    return html_text(F.regexp_extract(html, rf'(?is)<meta\s+(?:name|property)="{name}"\s+content="([^"]*)"', 1))


def rungs(html: Column, u: Column) -> list[tuple[int, Column]]:
    """The ladder's candidates: article text; title and descriptions; host and path words."""
    meta = F.filter(F.array(html_title(html), html_meta(html, "description"), html_meta(html, "og:description")), lambda x: F.trim(x) != "")
    words = F.filter(F.split(u["path"], r"[/\-_.]+"), lambda w: w.rlike("(?i)^[a-z0-9]{2,}$"))
    return [(2, html_article(html)), (3, F.array_join(meta, ". ")), (4, F.array_join(F.concat(F.array(F.regexp_replace(u["host"], r"^www\.", "")), words), " "))]
