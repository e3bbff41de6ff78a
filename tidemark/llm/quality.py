"""Quality rules by distribution divergence, in built-in column expressions only.

Each text gives two histograms: characters by class, and hits of a language's commonest words. One pass over all
documents sums them into a reference for each known language (a row a language, so what the driver holds is
bounded by the parameter). A text is compared with the references by Jensen-Shannon distance, in bits; the
nearest reference counts, so a wrong or missing language code does no harm. A test applies only from a least
length on, since short histograms are noise; and the test of words not to a text whose code names a language without
common words here, as its distance to the others says nothing.

A text without any common word lies at 0.335 to 0.359 from the references, as the bin of other words outweighs the
rest. The most_word below that is fitted on the labels of sf0.1 with even doc_id that pass the base rules: the least
multiple of 0.01 at which no good document is lost.

Null and empty texts have no words and fail the base rule. Very long texts are judged whole. Repeated rows get the same verdict each. An empty
table gives an empty result. No reference for any language (none of the known codes occurs): only the base rule
decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_text, cut

#: Frequent function words of each language code.
COMMON_WORDS = {
    "en": "the of and to in is that for on with as was".split(),
    "fr": "le de la les et des un une du que est dans".split(),
    "de": "der die und das den von zu mit ist nicht ein auf".split(),
    "es": "el que y en los del se las por con una su".split(),
}
#: Character classes as regular expressions; what is left over (small letters, mostly) is the last class.
CLASSES = (r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\x22()-]", r"[#*$%&|<>]", r"[^\x00-\x7F]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column, k: int = 8) -> Column:
    """Words that lie in a k-word window found twice or more in the list."""
    rolled = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
    hashes = F.when(F.size(words) > k, let(F.transform(words, lambda w: F.xxhash64(w)), rolled)).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        told = lambda s: F.filter(s, lambda p, j: (F.get(s, j - 1)["h"] == p["h"]) | F.coalesce(F.get(s, j + 1)["h"] == p["h"], F.lit(False)))
        found = F.sort_array(F.transform(let(pairs, told), lambda p: p["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(found, first, step, lambda a: a["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("bigint")


def class_histogram(text: Column) -> Column:
    counts = [F.length(text) - F.length(F.regexp_replace(text, c + "+", "")) for c in CLASSES]
    return let(F.array(*counts), lambda a: F.concat(a, F.array(F.length(text) - F.aggregate(a, F.lit(0), lambda x, y: x + y)))).cast("array<double>")


def word_histogram(words: Column, vocabulary: list[str]) -> Column:
    """Occurrences of each word of the vocabulary, then of all other words. ASCII punctuation around words is ignored."""
    bare = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))))
    hits = F.filter(bare, lambda w: w.isin(vocabulary))
    joined = F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" "))
    counts = lambda s: F.array(*((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in vocabulary))
    other = F.array((F.size(words) - F.size(hits)).cast("double"))
    return F.concat(let(joined, counts), other)


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts and a reference, 0..1; null if either is all zero."""
    whole = float(sum(q))
    if whole <= 0:
        return F.lit(None).cast("double")
    ref = F.array(*(F.lit(x / whole) for x in q))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    term = lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2)
    return let(total(p), lambda t: F.when(t > 0, F.sqrt(F.greatest(total(F.zip_with(p, ref, lambda x, y: term(x / t, y))) / 2, F.lit(0.0)))))


def measures(common: dict[str, list[str]] = COMMON_WORDS, text_col: str = "text", lang_col: str = "lang") -> Column:
    """A struct of counts and both histograms of a text."""
    vocabulary = list(dict.fromkeys(w for ws in common.values() for w in ws))
    text = as_text(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def facts(words: Column, chars: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            (F.length(text).cast("double") - chars[2]).cast("bigint").alias("word_chars"),
            chars[4].cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.when(F.col(lang_col).isin(list(common)), F.col(lang_col)).alias("lang"),
            F.coalesce(~F.col(lang_col).isin(list(common)), F.lit(False)).alias("foreign"),
            chars.alias("chars"),
            word_histogram(words, vocabulary).alias("words"),
        )

    return let(words_of(text), lambda w: let(class_histogram(text), lambda c: facts(w, c)))


def histograms(common: dict[str, list[str]] = COMMON_WORDS, text_col: str = "text", lang_col: str = "lang") -> Column:
    """A struct of what the references need of a text, without the other counts."""
    vocabulary = list(dict.fromkeys(w for ws in common.values() for w in ws))
    text = as_text(text_col)
    words = let(words_of(text), lambda w: word_histogram(w, vocabulary))
    return F.struct(F.when(F.col(lang_col).isin(list(common)), F.col(lang_col)).alias("lang"), class_histogram(text).alias("chars"), words.alias("words"))


def references(measured: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> list[tuple[list[float], list[float]]]:
    """Summed histograms of all documents of each known language."""
    part = measured.select("_facts.lang", "_facts.chars", "_facts.words")
    sizes = len(CLASSES) + 1, len({w for ws in common.values() for w in ws}) + 1
    sums = [[F.sum(F.get(c, F.lit(i))) for i in range(n)] for c, n in zip(("chars", "words"), sizes)]
    rows = part.groupBy("lang").agg(F.array(*sums[0]).alias("c"), F.array(*sums[1]).alias("w")).collect()  # one row a known language
    return [(r["c"], r["w"]) for r in sorted((r for r in rows if r["lang"] is not None), key=lambda r: r["lang"])]


def verdict(
    facts: Column, refs: list[tuple[list[float], list[float]]], most_class: float = 0.3, most_word: float = 0.29, least_chars: int = 300, least_words: int = 60, min_words: int = 20, most_repeat: int = 30
) -> Column:
    """A struct of base_failed, class_distance, word_distance (null where no test applies) and kept."""
    nearest = lambda hist, k: F.array_min(F.array(*(js_distance(hist, r[k]) for r in refs))) if refs else F.lit(None).cast("double")
    n = facts["n_words"]
    failed = (n < min_words) | (100 * facts["n_repeat_words"] > most_repeat * n)
    by_class = F.when(F.aggregate(facts["chars"], F.lit(0.0), lambda x, y: x + y) >= least_chars, nearest(facts["chars"], 0))
    by_word = F.when((n >= least_words) & ~facts["foreign"], nearest(facts["words"], 1))

    def told(c: Column, w: Column) -> Column:
        far = F.coalesce(c > most_class, F.lit(False)) | F.coalesce(w > most_word, F.lit(False))
        return F.struct(failed.alias("base_failed"), c.alias("class_distance"), w.alias("word_distance"), (~failed & ~far).alias("kept"))

    return let(by_class, lambda c: let(by_word, lambda w: told(c, w)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The facts and verdict of each row, beside its id. Texts are read once: what is kept between are numbers."""
    measured = cut(docs.select(F.col(id_col), measures(text_col=text_col, lang_col=lang_col).alias("_facts")))
    told = measured.withColumn("_told", verdict(F.col("_facts"), references(measured)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return told.select(id_col, *(F.col(f"_facts.{c}").alias(c) for c in names), *(F.col(f"_told.{c}").alias(c) for c in ("base_failed", "kept", "class_distance", "word_distance")))


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns of the input.

    Texts are read twice, for the references and for the verdicts, so that none is copied or shuffled. The
    verdict is one expression: a column in between would be computed once for each use when the filter moves.
    """
    facts = measures(text_col=text_col, lang_col=lang_col)
    refs = references(docs.select(histograms(text_col=text_col, lang_col=lang_col).alias("_facts")))
    return docs.filter(let(facts, lambda f: verdict(f, refs)["kept"]))
