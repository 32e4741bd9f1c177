"""Text functions: plain text of a page, syllables, reading ease, shingles, Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# References that are decoded by name.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def replace_spans(text: Column, pattern: str, end: str, by: str) -> Column:
    """Replaces what begins and ends as pattern says, where each match ends at the first place of
    end. Behind the last end nothing can match, and no start there scans the rest of the text, so
    this takes time in proportion to the text, however many starts have no end."""

    def ended(x: Column) -> Column:
        return let(F.regexp_extract(x, f"(?is)^.*{end}", 0), lambda head: F.concat(F.regexp_replace(head, pattern, by), F.substr(x, F.length(head) + 1)))

    return let(text, ended)


def without_tags(html: Column, by: str = " ") -> Column:
    return replace_spans(html, "<[^>]+>", ">", by)


def without_scripts(html: Column, by: str = " ") -> Column:
    return replace_spans(html, "(?is)<script.*?</script>", "</script>", by)


def plain(html: Column) -> Column:
    """Text without scripts, styles and tags; a few references decoded, the others blank."""
    out = replace_spans(without_scripts(html), "(?is)<style.*?</style>", "</style>", " ")
    out = without_tags(out)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"&(?:#\d+|\w+);", " ")
    return F.trim(F.regexp_replace(out, r"\s\s+|[\t-\r]", " "))  # a single space stays as it is


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it (Catalyst inlines plain
    columns into each use, also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent e; one for words of one or two letters."""

    def count(w: Column) -> Column:
        groups = F.regexp_count(w, F.lit("[aeiouy]+"))
        silent = w.endswith("e") & ~w.endswith("le")
        return F.when(F.length(w) <= 2, 1).otherwise(F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0)))

    return let(F.regexp_replace(F.lower(word), "[^a-z]", ""), count)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def all_syllables(text: Column) -> Column:
    """The sum of syllables() over the words of a text."""
    return word_count(text) + _more_syllables(text)


def _more_syllables(text: Column) -> Column:
    """all_syllables() less the words, by counts over the whole text: vowel groups of words of three
    letters or more, less their silent e, but one for a word at least."""
    count = lambda t, rx: F.regexp_count(t, F.lit(rx))
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]", "")

    def long(t: Column) -> Column:
        silent = count(t, "(?<!l)e(?![a-z])")
        none = count(t, "(?<![a-z])[b-df-hj-np-tv-xz]{3,}(?![a-z])")
        only_silent = count(t, "(?<![a-z])[b-df-hj-np-tv-xz]*(?:[aeiouy]+|[b-df-hjkmnp-tv-xz])e(?![a-z])")
        return count(t, "[aeiouy]+") - silent + none + only_silent - count(t, "[a-z]+")

    return let(F.regexp_replace(letters, "(?<![a-z])[a-z]{1,2}(?![a-z])", ""), long)


def reading_ease(text: Column, n: Column | None = None) -> Column:
    """Flesch reading ease from 0 to 100; 100 without words or sentences. n: the text's words,
    where they are counted already."""
    counts = F.struct((word_count(text) if n is None else n).alias("n"), _more_syllables(text).alias("more"), F.regexp_count(text, F.lit("[^.!? ][^.!?]*")).alias("sentences"))
    score = lambda k: F.lit(206.835) - F.lit(1.015) * F.try_divide(k["n"], k["sentences"]) - F.lit(84.6) * F.try_divide(k["n"] + k["more"], k["n"])
    ease = lambda k: F.when((k["n"] == 0) | (k["sentences"] == 0), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score(k))))
    return let(counts, ease)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of words of more than two characters; single words where there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
    own = F.filter(F.split(text, " "), lambda x: F.length(x) > 2)
    return let(own, lambda w: F.array_distinct(F.when(F.size(w) >= size, runs(w)).otherwise(w)))


def shingle_hashes(text: Column, size: int = 3) -> Column:
    """shingles() as hashes, made of the words where they stand: no run is joined to a string."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    own = F.filter(F.split(text, " "), lambda x: F.length(x) > 2)
    return let(own, lambda w: F.array_distinct(F.when(F.size(w) >= size, runs(w)).otherwise(F.transform(w, lambda x: F.xxhash64(x)))))


def jaccard(a: Column, b: Column) -> Column:
    common, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(common, total))


def shared_snippet(a: Column, b: Column, size: int = 100) -> Column:
    """The longest run of a's words that b has too, cut to size characters."""
    state = F.struct(F.lit("").alias("best"), F.lit("").alias("now"))

    def longest(there: Column) -> Column:
        def step(s: Column, w: Column) -> Column:
            now = F.when(F.array_contains(there, w), F.when(s["now"] == "", w).otherwise(F.concat(s["now"], F.lit(" "), w))).otherwise("")
            return let(now, lambda n: F.struct(F.when(F.length(n) > F.length(s["best"]), n).otherwise(s["best"]).alias("best"), n.alias("now")))

        return F.aggregate(F.split(a, " "), state, step)["best"]

    shown = lambda best: F.when(F.length(best) > size, F.concat(F.substring(best, 1, size), F.lit("..."))).when(best == "", "(similar structure detected)").otherwise(best)
    return let(let(F.split(b, " "), longest), shown)


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")
