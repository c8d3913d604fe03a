"""URL functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions import fixed

_WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*):(?:(//)(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::(\d*))?(?=[/?#]|$))?([^?#]*)(\?[^#]*)?(#.*)?$"


def parts(url: Column) -> Column:
    """(scheme, host, port, path, query, fragment) of a URL; null where it can't be parsed. Scheme and host are lower case."""
    clean = F.regexp_replace(F.trim(url), r"[\t\n\r]", "")
    part = lambda i: F.regexp_extract(clean, _WHOLE, i)
    scheme, host, port = F.lower(part(1)), F.lower(part(3)), part(4)
    web = scheme.isin("http", "https")
    bad = ~clean.rlike(_WHOLE) | (web & ((host == "") | host.rlike(r"[\s<>^|%\\]"))) | (F.length(port) > 5)
    path = F.when(web & (part(5) == ""), "/").otherwise(part(5))
    return F.when(~bad, F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), path.alias("path"), part(6).alias("query"), part(7).alias("fragment")))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def domain(u: Column) -> Column:
    """Of parsed parts: the host without www.; '' where there are none."""
    return F.coalesce(bare_host(u["host"]), F.lit(""))


def params(query: Column) -> Column:
    """Decoded (key, value, i) of a query string, in order."""
    raw = F.filter(F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&"), lambda p: p != "")
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    return F.transform(raw, lambda p, i: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), i.alias("i"), decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("value")))


def _joined(kept: Column) -> Column:
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def normalize(u: Column) -> Column:
    """The identity of a page: no user, fragment or tracking parameters; the rest sorted by key; no www., default port or final slash."""
    query = _joined(F.array_sort(F.filter(params(u["query"]), lambda p: ~p["key"].rlike(fixed.TRACKING))))
    port = F.when((u["port"] == "") | ((u["scheme"] == "http") & (u["port"] == "80")) | ((u["scheme"] == "https") & (u["port"] == "443")), "").otherwise(F.concat(F.lit(":"), u["port"]))
    short = F.when(F.length(u["path"]) > 1, F.regexp_replace(u["path"], "/$", "")).otherwise(u["path"])
    return F.concat(u["scheme"], F.lit("://"), bare_host(u["host"]), port, short, query)


def stable_search(query: Column) -> Column:
    """A query string without playback positions, in its order."""
    return _joined(F.filter(params(query), lambda p: ~p["key"].rlike(fixed.PLAYBACK)))


def navigation_key(u: Column) -> Column:
    """What tells one page from another while it is read: path, stable query, hash route."""
    return F.concat(u["path"], stable_search(u["query"]), F.when(u["fragment"].startswith("#/"), u["fragment"]).otherwise(""))


def is_local(host: Column) -> Column:
    return host.rlike(fixed.LOCAL_HOST)


def is_search_page(u: Column) -> Column:
    """A search engine's own pages, and any site's pages with a query key below a search segment."""
    keyed = F.exists(params(u["query"]), lambda p: F.lower(p["key"]).isin(*fixed.QUERY_KEYS))
    engine = bare_host(u["host"]).rlike(fixed.ENGINE_HOST) & (u["path"].isin("/", "") | u["path"].rlike(fixed.ENGINE_PATH) | keyed)
    return engine | (keyed & F.arrays_overlap(F.split(F.lower(u["path"]), "/"), F.array(*map(F.lit, fixed.RESULT_SEGMENTS))))


def sensitive(u: Column) -> Column:
    """The first category whose sites hold the URL, or null. A trailing dot marks a label, a slash a path prefix."""
    host = bare_host(u["host"])
    groups = list(fixed.SENSITIVE.items())
    out = F.when(host.rlike(fixed.CORPORATE_HOST), "corporate")
    for category, names in reversed(groups):
        names = names.split()
        labels, paths, hosts = ([n for n in names if n.endswith(".")], [n for n in names if "/" in n], [n for n in names if not n.endswith(".") and "/" not in n])
        quoted = lambda xs: "|".join(x.replace(".", r"\.") for x in xs)
        hit = host.rlike(rf"(^|\.)({quoted(hosts)})$")
        if labels:
            hit |= host.rlike(rf"(^|\.)({quoted(labels)})")
        for p in paths:
            hit |= F.concat(host, F.lower(u["path"])).startswith(p)
        out = F.when(hit, category).otherwise(out)
    return out


def page_format(u: Column) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(fixed.FORMAT_PATHS):
        out = F.when(u["path"].rlike(pattern), name).otherwise(out)
    for pattern, name in reversed(fixed.FORMAT_HOSTS):
        out = F.when(u["host"].rlike(pattern), name).otherwise(out)
    return F.when(u.isNull(), "other").otherwise(out)


def is_opaque(word: Column) -> Column:
    return word.rlike("^[0-9]+$") | word.rlike("(?i)^[a-f0-9]{8,}$") | word.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") | ((F.length(word) >= 10) & word.rlike("[0-9]") & ~word.rlike("(?i)[aeiou]"))


def path_words(url: Column) -> Column:
    """(words, path_only): the speaking words of a URL, and those that aren't labels of its host."""
    u = parts(F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url)))
    decoded = lambda s: F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)
    host = F.coalesce(u["host"], F.lit(""))
    text = F.when(u.isNull(), url).otherwise(F.concat_ws(" ", host, decoded(u["path"]), decoded(u["query"])))
    stop = F.array(*map(F.lit, fixed.PATH_STOPWORDS.split()))
    raw = F.filter(F.split(F.regexp_replace(text, r"\+", " "), r"[/\-_.?&=#%,:;()\[\]{}'\"\s]+"), lambda w: (F.length(w) >= 3) & w.rlike("(?i)[a-z]") & ~is_opaque(w) & ~F.array_contains(stop, F.lower(w)))
    first = F.transform(raw, F.lower)
    uniq = F.filter(F.transform(raw, lambda w, i: F.struct(w.alias("w"), (F.array_position(first, F.lower(w)) == i + 1).alias("first"))), lambda x: x["first"])
    labels = F.split(host, r"[.\-]")
    split = F.flatten(F.transform(uniq, lambda x: F.transform(F.split(x["w"], "(?<=[a-z])(?=[A-Z])"), lambda p: F.struct(F.lower(p).alias("p"), F.array_contains(labels, F.lower(x["w"])).alias("own")))))
    kept = F.filter(split, lambda x: (F.length(x["p"]) >= 3) & ~F.array_contains(stop, x["p"]))
    return F.struct(F.transform(kept, lambda x: x["p"]).alias("words"), F.transform(F.filter(kept, lambda x: ~x["own"]), lambda x: x["p"]).alias("path_only"))


def hash_id(text: Column) -> Column:
    """16 hex digits: two 32-bit multiply-xor hashes over the UTF-16 code units."""
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int") - 1), lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(hexed) > 0, units).otherwise(F.array().cast("array<long>"))

    def fold(start: int, factor: int) -> Column:
        low = lambda h, c: h.bitwiseXOR(c)
        # The factor in two halves: the product of two 32-bit numbers may overflow.
        times = lambda x: (x * (factor & 0xFFFF) + ((x * (factor >> 16)) % (1 << 16)) * (1 << 16)) % (1 << 32)
        return F.aggregate(units, F.lit(start).cast("long"), lambda h, c: times(low(h, c)))

    return F.concat(*(F.lpad(F.lower(F.hex(fold(s, f))), 8, "0") for s, f in ((0x811C9DC5, 0x01000193), (0x01000193, 0x85EBCA6B))))


def favicon(url: Column, size: int = 32) -> Column:
    return F.concat(F.lit("/_favicon/?pageUrl="), F.regexp_replace(F.url_encode(url), r"\+", "%20"), F.lit(f"&size={size}"))
