"""Text functions as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: The characters that count as Chinese, Japanese or Korean.
CJK = "\u3400-\u9fff"
#: White space of any script, as a pattern, and its characters.
SPACE = "(?U)[\\s\\x1c-\\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column) -> Column:
    """Runs of white space of any script as one space."""
    return F.regexp_replace(c, SPACE + "+", " ")


def compact_text(c: Column, most: int = 1200) -> Column:
    """White space collapsed, trimmed, cut to `most` characters."""
    return F.substring(F.trim(collapsed(c)), 1, most)


def record_id(c: Column) -> Column:
    """The first 20 hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 20)


def _bounded(words: str) -> str:
    """A pattern of the words between characters that are neither Latin letters nor digits."""
    return "(?<![a-z0-9])" + words + "(?![a-z0-9])"


def term_hit(text: Column, term: str) -> Column:
    """Whether a term occurs: plain Latin terms stand alone, with any inner spaces; others count anywhere. An empty one never does."""
    term = str(term or "").strip().casefold()
    if not term:
        return F.lit(False)
    low = F.lower(F.coalesce(text, F.lit("")))
    if re.fullmatch(r"[a-z0-9 ._\-/]+", term):
        return low.rlike(_bounded((SPACE + "+").join(map(re.escape, term.split(" ")))))
    return F.contains(low, F.lit(term))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms occurs."""
    out = F.lit(False)
    for term in terms:
        out = out | term_hit(text, term)
    return out


def has_alias(text: Column, alias: str) -> Column:
    """Whether an alias of two characters or more occurs in a lower-case text; one with Latin letters must stand alone."""
    alias = alias.strip().lower()
    if len(alias) < 2:
        return F.lit(False)
    return text.rlike(_bounded(re.escape(alias))) if re.search("[a-z]", alias) else F.contains(text, F.lit(alias))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{CJK}]")


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms, as given, that occur anywhere in the text in any case of letters, in the order given. Blank ones never do."""
    known = [t for t in dict.fromkeys(map(str, terms)) if t.strip()]
    if not known:
        return F.array().cast("array<string>")
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(t.lower().strip()).alias("low")) for t in known))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.transform(F.filter(pairs, lambda t: F.contains(low, t["low"])), lambda t: t["term"]))


def latin_tokens(text: Column, stop: list[str] = []) -> Column:
    """Distinct lower-case tokens of three characters or more without the stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9'\\-]{2,}"), F.lit(0))), F.array(*map(F.lit, stop)).cast("array<string>"))


def severity_label(text: Column, rules: list[tuple[str, int, str]] = fixed.SEVERITIES, least: str = "low") -> Column:
    """The label of the first pattern that matches, in any case of letters."""
    out = F.lit(least)
    for label, _, pattern in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def severity(text: Column, patterns: list[tuple[str, int]] = [(p, n) for _, n, p in fixed.SEVERITIES], least: int = 25) -> Column:
    """The score of the first pattern that matches."""
    out = F.lit(least)
    for pattern, score in reversed(patterns):
        out = F.when(F.lower(text).rlike(pattern), score).otherwise(out)
    return out


def normalize_text(text: Column) -> Column:
    """Lower case; URLs and everything but Latin letters, digits, CJK and a few signs become spaces."""
    bare = F.regexp_replace(F.lower(text), f"https?://{SPACE.replace('[', '[^')}+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"[^a-z0-9{CJK}%$€£¥]+", " "), " +", " "))


def cjk_tokens(text: Column) -> Column:
    """Of each run of two or more CJK characters: the run if it has at most four, and its 2- and 3-grams."""
    grams = lambda run, n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    whole = lambda run: F.when(F.length(run) <= 4, F.array(run)).otherwise(F.array().cast("array<string>"))
    runs = F.regexp_extract_all(text, F.lit(rf"[{CJK}]{{2,}}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: F.concat(whole(run), grams(run, 2), grams(run, 3)))))


def concept_tokens(text: Column, concepts: dict[str, str] = fixed.CONCEPTS, whole: bool = True) -> Column:
    """Tokens that the concepts' phrases in a lower-case text stand for; with `whole` also the text's own tokens of that vocabulary."""
    empty = F.array().cast("array<string>")
    if not concepts:
        return empty
    table = F.array(*(F.struct(F.lit(p).alias("p"), F.array(*map(F.lit, t.split())).alias("t")) for p, t in concepts.items()))
    found = F.flatten(F.transform(F.filter(table, lambda c: F.contains(text, c["p"])), lambda c: c["t"]))
    own = F.array_intersect(latin_tokens(text), F.array(*map(F.lit, sorted({t for v in concepts.values() for t in v.split()})))) if whole else empty
    return F.array_distinct(F.concat(own, found))


def text_tokens(text: Column, stop: list[str] = fixed.STOP_WORDS, concepts: dict[str, str] = fixed.CONCEPTS) -> Column:
    """Latin and CJK tokens, and those that phrases of the other language stand for."""
    return F.array_union(F.array_union(latin_tokens(text, stop), cjk_tokens(text)), concept_tokens(text, concepts, whole=False))


def category(text: Column, rules: list[tuple[str, str]] = fixed.CATEGORIES, other: str = fixed.OTHER_CATEGORY) -> Column:
    """The name of the first rule whose pattern occurs."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def first_of(*columns: Column) -> Column:
    """The first value, as a string, that is neither null nor an empty string, list or map."""
    held = lambda c: F.when(~c.cast("string").isin("", "[]", "{}"), c.cast("string"))
    return F.coalesce(*map(held, columns))


def to_int(c: Column) -> Column:
    """The whole part of a number; of a string the number left after all but digits, points and minus signs are gone; 0 if there is none."""
    bare = F.when(F.typeof(c) == "string", F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "")).otherwise(c.cast("string"))
    return F.coalesce(bare.try_cast("double").try_cast("bigint"), F.lit(0))


def parse_time(c: Column) -> Column:
    """A timestamp from ISO text or a mail date, UTC where no zone is given; null for anything else."""
    bare = F.regexp_replace(F.trim(c.cast("string")), "^[A-Za-z]{3},\\s*", "")
    forms = (F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy"))
    return F.coalesce(F.try_to_timestamp(bare), *forms)


def iso_time(c: Column) -> Column:
    """A timestamp from epoch seconds, epoch milliseconds (above 1e12) or ISO text; null for anything else."""
    number = c.cast("string").try_cast("double")
    return F.when(number.isNull(), F.try_to_timestamp(c.cast("string"))).when(number > 1e12, F.timestamp_millis(number.cast("bigint"))).otherwise(F.timestamp_seconds(number))


def _first_spellings(words: Column, bare: Callable[[Column], Column]) -> Column:
    """The words without empty ones, of those that are alike when bare the first, in order. Work grows as of sorting."""

    def told(held: Column) -> Column:
        keyed = F.sort_array(F.transform(held, lambda x, i: F.struct(bare(x).alias("k"), i.alias("i"))))
        firsts = let(keyed, lambda s: F.filter(s, lambda p, j: ~F.coalesce(F.get(s, j - 1)["k"] == p["k"], F.lit(False))))
        return F.transform(F.sort_array(F.transform(firsts, lambda p: p["i"])), lambda i: F.get(held, i))

    return let(F.filter(words, lambda x: x != ""), told)


def split_keywords(c: Column, ends: str = SPACES, inner: str = SPACE) -> Column:
    """Comma-separated words, stripped, without empty ones; of spellings that differ in case or inner spaces alone the first.

    ends: characters that are stripped. inner: pattern of what counts as inner space.
    """
    return _first_spellings(F.transform(F.split(c, ","), lambda x: F.btrim(x, F.lit(ends))), lambda x: F.lower(F.regexp_replace(x, inner + "+", " ")))


def merge_terms(*lists: Column) -> Column:
    """The stripped terms of all lists in order, without null and empty ones; of spellings that differ in case alone the first."""
    none = F.array().cast("array<string>")
    words = F.flatten(F.array(*(F.coalesce(c, none) for c in lists)))
    return _first_spellings(F.transform(words, lambda x: stripped(F.coalesce(x, F.lit("")))), F.lower)


def host(url: Column) -> Column:
    """Lower-case network location, with any port, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def publisher_family(name: Column, platform: Column, url: Column, families: dict[str, list[str]] = {}) -> Column:
    """The first family with a pattern in the name, else platform:author, else the host, else the name in one word, else unknown."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    where = F.lower(F.trim(F.coalesce(platform, F.lit(""))))
    word = lambda c, signs: F.substring(F.regexp_replace(c, signs, "-"), 1, 80)
    author = F.concat(where, F.lit(":"), word(F.when(low == "", "unknown").otherwise(low), "\\s+"))
    plain = F.coalesce(F.nullif(host(url), F.lit("")), F.nullif(word(low, "[^\\p{L}\\p{N}_]+"), F.lit("")), F.lit("unknown"))
    out = F.when(where != "", author).otherwise(plain)
    for family, patterns in reversed(families.items()):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.contains(low, F.lit(p.lower()))
        out = F.when(hit, family.lower()).otherwise(out)
    return out


def canonical_url(url: Column, tracking: list[str] = fixed.TRACKING) -> Column:
    """Scheme and host in small letters, no fragment, no tracking parameters, no repeated or last slashes in the path.

    What remains of the query is decoded and encoded again. An address without a scheme (//host/path) gets https; a text without a host is only stripped.
    """
    bare = stripped(url)
    bare = F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).otherwise(bare)
    part = lambda i: F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    path = F.regexp_replace(F.regexp_replace(part(3), "/{2,}", "/"), "/+$", "")
    pair = lambda p: F.array(F.regexp_extract(p, "^([^=]*)", 1), F.regexp_extract(p, "^[^=]*=(.*)$", 1))
    again = lambda c: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    said = F.filter(F.split(part(4), "&"), lambda p: p != "")
    kept = F.filter(F.transform(said, pair), lambda p: ~F.lower(F.coalesce(F.try_url_decode(p[0]), p[0])).isin(tracking))
    query = F.array_join(F.transform(kept, lambda p: F.concat(again(p[0]), F.lit("="), again(p[1]))), "&")
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(2) == "", bare).otherwise(whole)


def event_text(title: Column, text: Column, snippet: Column) -> Column:
    """The first of the three that is not empty, trimmed."""
    return F.trim(F.coalesce(*(F.nullif(c, F.lit("")) for c in (title, text, snippet)), F.lit("")))


def event_id(title: Column, first_seen: Column) -> Column:
    """20 hex digits from the normalized title and the day first seen."""
    return record_id(F.concat(normalize_text(title), F.date_format(first_seen, "yyyy-MM-dd")))


def cache_key(text: Column, target: Column) -> Column:
    """The key of a translation: a hash of the target language and the text."""
    return F.sha2(F.concat(target, F.lit("\0"), text), 256)


def exception_line(log: Column, starts: list[str] = fixed.EXCEPTIONS, most: int = 700) -> Column:
    """The last line that begins like an exception, else the last line with anything in it, else nothing."""
    lines = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    told = F.filter(lines, lambda x: x.rlike("^(" + "|".join(map(re.escape, starts)) + ")"))
    return F.substring(F.coalesce(F.try_element_at(told, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit("")), 1, most)


def json_array(answer: Column, schema: str) -> Column:
    """The JSON array between the first [ and the last ] of a text, code fences and all else around it ignored; null if it does not parse."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), schema)


def decoded(c: Column) -> Column:
    """The common character references of a text replaced by what they stand for."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def page_text(html: Column) -> Column:
    """The text of simple HTML: tags and scripts gone, common references decoded, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(out), "\\s+", " "))


def absolute_url(base: Column, href: Column) -> Column:
    """The address that a link of a page stands for, with . and .. in its path resolved."""
    part = lambda c, i: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):(//[^/?#]*)?([^?#]*)", i)
    link = F.trim(href)
    root, here = F.concat(part(base, 1), F.lit(":"), part(base, 2)), part(base, 3)
    path, rest = F.regexp_extract(link, "^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(here, "^(.*/)", 1), path))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    steps = F.aggregate(F.split(F.regexp_replace(whole, r"/(\.\.?)$", "/$1/"), "/"), F.array().cast("array<string>"), step)
    flat = F.when(whole.contains("/."), F.array_join(steps, "/")).otherwise(whole)
    joined = F.when(path == "", F.concat(root, here, F.when(rest.startswith("?"), rest).otherwise(F.concat(F.regexp_extract(base, r"(\?[^#]*)", 1), rest)))).otherwise(F.concat(root, flat, rest))
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link)).otherwise(joined)


def scrub(c: Column, pattern: str) -> Column:
    """Matches of a secret's pattern blotted out."""
    return F.regexp_replace(c, pattern, "***")
