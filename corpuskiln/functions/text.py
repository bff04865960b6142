"""Text functions as Column expressions: words, sentences, n-grams, ratios, list forms, keys, prompts.

Every function takes and gives Columns and stays in the JVM.  Patterns and word lists that results depend on are fixed
values, kept together in ``constants``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


#: Unicode's white space, which ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once; within conditions Spark makes an expression again for each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends; what is between isn't searched."""
    return F.trim(x, F.lit(WHITE))


def words(x: Column, keep_case: bool = False) -> Column:
    return F.regexp_extract_all(x if keep_case else F.lower(x), F.lit(K.WORD), F.lit(0))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(K.WORD))


def alpha_tokens(x: Column) -> Column:
    """Distinct runs of a to z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)))


def token_key(x: Column) -> Column:
    """Equal for equal sets of alpha tokens."""
    return F.array_join(F.array_sort(alpha_tokens(x)), " ")


def normalize_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", " ")


def normalize_display(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def sentences(x: Column) -> Column:
    """Lower-case sentences between runs of . ! ?, blank ones dropped."""
    return F.filter(F.transform(F.split(x, "[.!?]+"), lambda s: F.lower(strip(s))), lambda s: s != "")


def split_sentences(x: Column) -> Column:
    """Sentences with their marks."""
    return F.filter(F.transform(F.split(strip(x), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def is_clean_story_span(x: Column, parts: Column | None = None) -> Column:
    """``parts`` are its sentences with their marks, where they are known."""
    parts = split_sentences(x) if parts is None else parts
    return strip(x).rlike(r"[.!?]$") & (F.size(parts) >= 2) & F.forall(parts, lambda s: s.rlike(r"^[\p{Lu}\p{Nd}]"))


def ascii_ratio(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\x00-\x7F]", "")) / F.nullif(F.length(x), F.lit(0))


def printable_ratio(x: Column) -> Column:
    return F.length(F.regexp_replace(x, K.UNPRINTABLE, "")) / F.nullif(F.length(x), F.lit(0))


def printable_ascii_ok(x: Column) -> Column:
    return F.coalesce((printable_ratio(x) >= 0.98) & (ascii_ratio(x) >= 0.90), F.lit(False))


def repeated_sentence(x: Column, least_words: int = 0) -> Column:
    """Any sentence (of so many words at least) twice."""
    s = sentences(x)
    if least_words:
        s = F.filter(F.transform(s, lambda v: F.regexp_replace(v, r"\s+", " ")), lambda v: F.size(F.split(v, " ")) >= least_words)
    return once(s, lambda v: F.size(v) != F.size(F.array_distinct(v)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces; none if there are fewer."""
    last = F.size(tokens) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def most_frequent(items: Column) -> Column:
    """How often the most frequent item occurs: the longest run of the sorted 64-bit hashes."""
    return F.aggregate(
        F.sort_array(F.transform(items, lambda v: F.xxhash64(v))),
        F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda s, v: F.struct(
            v.alias("last"),
            F.when(v == s["last"], s["run"] + 1).otherwise(1).alias("run"),
            F.greatest(s["most"], F.when(v == s["last"], s["run"] + 1).otherwise(1)).alias("most"),
        ),
        lambda s: s["most"],
    )


def repeats_ngram(tokens: Column, sizes: tuple[int, ...], times: int, least: int) -> Column:
    """Some n-gram of the sizes occurs so many times, in at least so many tokens.

    What occurs so often does so with its first tokens alone, so the least size decides.  N-grams are known by 64-bit
    hashes of their tokens; of the sorted ones, equal ones that far apart tell.
    """
    n = min(sizes)
    if least < n:
        raise ValueError("least must not be below the sizes")
    upto = lambda last: F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    grams = F.transform(upto(F.size(tokens) - n), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(n)]))

    def held(grams: Column) -> Column:
        enough = F.size(grams) - F.size(F.array_distinct(grams)) >= times - 1
        if times == 2:
            return enough
        apart = lambda x: F.zip_with(x, F.slice(x, times, F.greatest(F.size(x), F.lit(1))), lambda a, b: a == b)
        return F.when(enough, F.coalesce(F.array_contains(once(F.sort_array(grams), apart), True), F.lit(False))).otherwise(False)

    return F.when(F.size(tokens) >= least, once(grams, held)).otherwise(False)


def obvious_loop(tokens: Column) -> Column:
    return repeats_ngram(tokens, (2, 3, 4), 5, 12)


def teacher_loop(tokens: Column) -> Column:
    return repeats_ngram(tokens, (3, 4, 5), 3, 10)


def answer_loop(tokens: Column) -> Column:
    """A 5-gram twice in ten words or more, or the last ten words twice over in forty or more."""
    n = F.size(tokens)
    tail = F.when(n >= 40, F.slice(tokens, n - 9, 10) == F.slice(tokens, n - 19, 10)).otherwise(False)
    return repeats_ngram(tokens, (5,), 2, 10) | tail


def unique_ratio(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) / F.nullif(F.size(tokens), F.lit(0))


def weird_nonword(x: Column, triple: bool = False) -> Column:
    """A letter run of 14 or more, or with five consonants in a row; with triple, or one consonant three times."""
    pattern = r"[A-Za-z]{14,}|(?i)[bcdfghjklmnpqrstvwxyz]{5,}"
    return x.rlike(pattern + (r"|([bcdfghjklmnpqrstvwxyz])\1\1" if triple else ""))


def starts_like_story(x: Column) -> Column:
    low = F.lower(strip(x))
    return _any([low.startswith(p) for p in K.STORY_OPENERS])


def story_in_opening(x: Column, chars: int = 120) -> Column:
    low = F.lower(F.substring(x, 1, chars))
    return _any([F.contains(low, F.lit(p)) for p in K.STORY_OPENERS])


def as_an_ai(x: Column, bounded: bool = False) -> Column:
    return x.rlike(r"(?i)\bas an AI\b") if bounded else F.contains(F.lower(x), F.lit("as an ai"))


def chatty_opener(x: Column) -> Column:
    return x.rlike(r"(?i)^\s*(sure!?|of course!?|certainly!?)\b")


def blocked_term(x: Column) -> Column:
    # a search for each term is quicker than the pattern, which only texts with one go through
    return has_cue(x, list(K.BLOCKED_TERMS)) & x.rlike(r"(?i)\b(" + "|".join(K.BLOCKED_TERMS) + r")\b")


def has_term(x: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(alpha_tokens(x), F.array(*map(F.lit, terms)))


def has_url(x: Column) -> Column:
    return x.rlike(r"(?i)https?://|www\.")


def markdown_table(x: Column) -> Column:
    return F.contains(x, F.lit("|")) & x.rlike(r"\|\s*-{3,}\s*\|")


def pipe_row(x: Column) -> Column:
    return x.rlike(r"\|.*\|.*\|")


def list_markers(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?m)^\s*(?:[-*]|\d+[.)])\s+"))


def _parts(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"[;\n]"), lambda s: strip(s) != ""))


def is_list(x: Column) -> Column:
    """Two markers; or two parts at ; or line ends, where there are any; or two commas."""
    return F.when(list_markers(x) >= 2, True).when(x.rlike(r"[;\n]"), _parts(x) >= 2).otherwise(F.regexp_count(x, F.lit(",")) >= 2)


def list_items(x: Column) -> Column:
    """How many items: two markers or more; else two parts or more at ; or line ends; else commas and one, from two commas on; else 0."""
    commas = F.regexp_count(x, F.lit(","))
    return F.when(list_markers(x) >= 2, list_markers(x)).when(_parts(x) >= 2, _parts(x)).when(commas >= 2, commas + 1).otherwise(0)


def long_words(x: Column, letters: int = 12) -> Column:
    return F.size(F.filter(words(x), lambda w: F.length(w) >= letters))


def digits(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\p{Nd}"))


def chat_prompt(instruction: Column, given: Column) -> Column:
    body = F.when(strip(F.coalesce(given, F.lit(""))) != "", F.concat(strip(instruction), F.lit("\n\n"), strip(given))).otherwise(strip(instruction))
    return F.concat(F.lit(K.USER + "\n"), body, F.lit("\n\n" + K.ASSISTANT + "\n"))


def pair_hash(instruction: Column, output: Column) -> Column:
    return F.sha2(F.concat(normalize_key(instruction), F.lit("\n"), normalize_key(output)), 256)


def output_hash(output: Column) -> Column:
    return F.sha2(normalize_key(output), 256)


def fingerprint(*parts: Column) -> Column:
    return F.concat_ws("\n", *[normalize_key(F.coalesce(p, F.lit(""))) for p in parts])


def trailing_number(x: Column) -> Column:
    """The number at the end of an id; 10^12 if there is none."""
    return F.coalesce(F.expr("try_cast(1 AS BIGINT)") * F.regexp_extract(x, r"(\d{1,18})$", 1).try_cast("bigint"), F.lit(10**12))


def shingles(x: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the key, found in one pass; a shorter one stands for itself."""
    key = normalize_key(x)
    runs = F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(key) <= n, F.filter(F.array(key), lambda s: s != "")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def names(x: Column) -> Column:
    """Capitalised words of three letters or more but for common ones."""
    runs = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike("^[A-Z][a-z]{2,}$") & ~w.isin(*K.NOT_NAMES))


def opening(x: Column, n: int, least: int = 1) -> Column:
    """The first n words (all, if there are fewer), or null if there are fewer than ``least``; the text is searched up to them only."""
    gap = r"[^A-Za-z]*+"
    word = K.WORD.replace("(?:", "(?:", 1)
    head = F.regexp_extract(F.lower(x), f"^(?s:{gap}(?:{word}{gap}){{0,{n}}})", 0)
    w = words(head)
    return F.when(F.size(w) >= least, F.array_join(w, " "))


def has_cue(x: Column, cues: list[str]) -> Column:
    """Any of the cues as a substring, in any case."""
    return once(F.lower(x), lambda low: _any([F.contains(low, F.lit(c)) for c in cues]))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
