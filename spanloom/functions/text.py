"""Text normalisation and similarity as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of marks, stretching and byte order mark that normalisation drops; of Unicode's white space; of presentation forms.
MARK_RANGES = ((0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED), (0x0640, 0x0640), (0xFEFF, 0xFEFF))
SPACE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
FORM_RANGES = ((0xFB50, 0xFDFF), (0xFE70, 0xFEFC))
#: Letter variants and what they fold to.
FOLDED, FOLDS = "\u0623\u0625\u0622\u0671\u0629\u0649", "\u0627\u0627\u0627\u0627\u0647\u064a"


def one_of(ranges: tuple[tuple[int, int], ...]) -> str:
    """A character class, in a form that Java's and RE2's patterns share."""
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


MARKS, SPACES, FORMS = one_of(MARK_RANGES), one_of(SPACE_RANGES) + "+", one_of(FORM_RANGES)


@lru_cache(maxsize=1)
def presentation_forms() -> dict[str, str]:
    """Letters of the presentation-form blocks and what they stand for, by Unicode's compatibility mapping."""
    every = [chr(c) for a, b in FORM_RANGES for c in range(a, b + 1)]
    return {c: n for c in every if unicodedata.category(c) != "Cn" and (n := unicodedata.normalize("NFKC", c)) != c}


def expanded(text: Column) -> Column:
    """Presentation forms as plain letters; texts without any aren't taken apart."""
    table = F.create_map(*(F.lit(x) for pair in presentation_forms().items() for x in pair))
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.when(text.rlike(FORMS), F.array_join(letters, "")).otherwise(text)


def normalize(text: Column, forms: bool = True) -> Column:
    """Without marks, letter variants folded, white space single and trimmed; null stays null."""
    plain = F.regexp_replace(expanded(text) if forms else text, MARKS, "")
    return F.trim(F.regexp_replace(F.translate(plain, FOLDED, FOLDS), SPACES, " "))


def words(text: Column) -> Column:
    """Words of a normalised text; none for null or empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; empty against anything else 0."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(1.0)).when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def sum_ratio(a: Column, b: Column) -> Column:
    """The summed lengths less the edit distance, over the summed lengths; 1 if both are empty."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.levenshtein(a, b)) / total)


def _windows(short: Column, long: Column, stride: Column, score) -> Column:
    last = F.char_length(long) - F.char_length(short)
    return F.array_max(F.transform(F.sequence(F.lit(0), last, stride), lambda i: score(short, F.substr(long, i + 1, F.char_length(short)))))


def fragment_score(query: Column, target: Column) -> Column:
    """Best ratio of the shorter text against windows of the longer one, a quarter of its length apart."""
    swap = F.char_length(query) > F.char_length(target)
    short, long = F.when(swap, target).otherwise(query), F.when(swap, query).otherwise(target)
    stride = F.greatest(F.floor(F.char_length(short) / 4).cast("int"), F.lit(1))
    return F.when((F.char_length(query) == 0) | (F.char_length(target) == 0), F.lit(0.0)).otherwise(_windows(short, long, stride, ratio))


def partial_ratio(short: Column, long: Column) -> Column:
    """Best sum_ratio of the shorter text against all windows of the longer one."""
    swap = F.char_length(short) > F.char_length(long)
    a, b = F.when(swap, long).otherwise(short), F.when(swap, short).otherwise(long)
    return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0)).otherwise(_windows(a, b, F.lit(1), sum_ratio))


def text_score(decoded: Column, verse: Column) -> Column:
    return 0.55 * ratio(decoded, verse) + 0.45 * fragment_score(decoded, verse)


def ngrams(text: Column, n: int) -> Column:
    """The distinct character n-grams (n of 2 or 3); a shorter text has none. Characters are zipped, so the work grows with the text's length."""
    chars = F.split(text, "")
    count = F.greatest(F.char_length(text) - (n - 1), F.lit(0))
    grams = F.slice(chars, F.lit(1), count)
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k), count), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.coalesce(grams, F.array().cast("array<string>")))


def short_query_boost(query: Column, text: Column, first_word: Column) -> Column:
    """Best sum_ratio of a short query without spaces against the beginning of a text without spaces, six characters longer at most, and against its first word."""
    prefix = sum_ratio(query, F.substr(text, F.lit(1), F.char_length(query) + 6))
    word = F.when(F.char_length(first_word) > 0, sum_ratio(query, first_word)).otherwise(0.0)
    return F.when(F.char_length(text) > 0, F.greatest(prefix, word)).otherwise(0.0)


def suffix_prefix_score(query: Column, text: Column) -> Column:
    """Best sum_ratio of the query without its first one to four words (half of them at most) against as many words that the text begins with."""
    q, t = F.split(query, " "), F.split(text, " ")
    most = F.least(F.floor(F.size(q) / 2).cast("int"), F.lit(4))
    score = lambda k: sum_ratio(F.array_join(F.slice(q, k + 1, F.size(q)), " "), F.array_join(F.slice(t, 1, F.size(q) - k), " "))
    return F.when((F.size(q) >= 2) & (F.size(t) >= 2), F.array_max(F.transform(F.sequence(F.lit(1), most), score))).otherwise(0.0)


def prefix_ratio(query: Column, text: Column) -> Column:
    """sum_ratio of as many first words of both as the shorter has."""
    q, t = words(query), words(text)
    n = F.least(F.size(q), F.size(t))
    return F.when(n > 0, sum_ratio(F.array_join(F.slice(q, F.lit(1), n), " "), F.array_join(F.slice(t, F.lit(1), n), " "))).otherwise(0.0)


def words_match(a: Column, b: Column, threshold: float = 0.7) -> Column:
    return (a == b) | ((F.char_length(a) > 2) & (F.char_length(b) > 2) & (sum_ratio(a, b) >= threshold))


def word_status(similarity: Column) -> Column:
    return F.when(similarity >= 0.8, "match").when(similarity >= 0.5, "near").otherwise("mismatch")


def verdict(f1: Column) -> Column:
    return F.when(f1 >= 0.9, "excellent").when(f1 >= 0.75, "good").when(f1 >= 0.55, "fair").otherwise("poor")


def ref_key(chapter: Column, first: Column, last: Column | None = None) -> Column:
    """chapter:first, or chapter:first-last for a longer span."""
    one = F.concat_ws(":", chapter.cast("string"), first.cast("string"))
    return one if last is None else F.when(last.isNull() | (last == first), one).otherwise(F.concat(one, F.lit("-"), last.cast("string")))


def parse_ref(ref: Column) -> Column:
    """struct(chapter, first, last) of a ref key; parts that aren't numbers are null."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(ref, r"^(\d{1,9}):(\d{1,9})(?:-(\d{1,9}))?$", i), F.lit("")), F.lit("999999999")).cast("int")
    return F.struct(part(1).alias("chapter"), part(2).alias("first"), F.coalesce(part(3), part(2)).alias("last"))


def word_slice(text: Column, first: Column, last: Column) -> Column:
    """Words first to last, both included and clamped; without them the whole text."""
    w = words(F.trim(F.regexp_replace(text, SPACES, " ")))
    a = F.greatest(F.coalesce(first, F.lit(0)), F.lit(0))
    b = F.least(F.coalesce(last, F.size(w) - 1), F.size(w) - 1)
    return F.when(first.isNull() & last.isNull(), text).otherwise(F.array_join(F.slice(w, a + 1, F.greatest(b - a + 1, F.lit(0))), " "))


def soften(word: Column) -> Column:
    """Without long vowels."""
    return F.translate(word, "اوىيء", "")


def round4(value: Column) -> Column:
    return F.floor(value * 1e4 + 0.5) / 1e4


def log_add_exp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); minus infinity adds nothing."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def is_continuation(previous: Column, following: Column) -> Column:
    """Whether a ref follows another: up to 3 verses on, or the first 3 of the next chapter; true if either can't be read."""
    a, b = parse_ref(previous), parse_ref(following)
    ahead = b["first"] - a["last"]
    follows = ((b["chapter"] == a["chapter"]) & ahead.between(0, 3)) | ((b["chapter"] == a["chapter"] + 1) & (b["first"] <= 3))
    return F.coalesce(follows, F.lit(True))


def is_next(previous: Column, following: Column) -> Column:
    """The stricter rule: 1 to 3 verses on in the same chapter; false if either can't be read."""
    a, b = parse_ref(previous), parse_ref(following)
    return F.coalesce((b["chapter"] == a["chapter"]) & (b["first"] - a["last"]).between(1, 3), F.lit(False))


def file_range(name: Column) -> Column:
    """struct(chapter, first, last) of a clip's file name, null if it has another form."""
    part = lambda i: F.regexp_extract(name, r"(?i)corpus_(\d{3})_(\d{3})_(\d{3})\.wav", i)
    return F.when(part(1) != "", F.struct(*(part(i).cast("int").alias(n) for i, n in ((1, "chapter"), (2, "first"), (3, "last")))))


def order_statistics(values: Column) -> Column:
    """struct(median, p90): the upper median and the value at round(0.9 (n - 1)), of a non-empty array; null for an empty one."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ordered, i.cast("int"))
    return F.when(n > 0, F.struct(at(F.floor(n / 2)).alias("median"), at(F.floor((n - 1) * 0.9 + 0.5)).alias("p90")))


def rms(samples: Column) -> Column:
    return F.when(F.size(samples) > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))).otherwise(0.0)


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, F.abs)).cast("double"), F.lit(0.0))


def strided_rms(samples: Column, most: int = 512) -> Column:
    """Root mean square of every step-th sample, so that about most of them are taken."""
    step = F.greatest(F.lit(1), F.floor(F.size(samples) / most).cast("int"))
    return rms(F.filter(samples, lambda x, i: i % step == 0))


def seconds(samples: Column, rate: int = 16_000) -> Column:
    return samples / float(rate)


def source_label(*parts: Column) -> Column:
    """The parts that aren't empty, between middle dots."""
    return F.concat_ws(" \u00b7 ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


#: Names that languages had before.
FORMER_LANGUAGES = {"zh": "chinese", "en": "english", "simplifiedChinese": "chinese"}


def language_id(value: Column, known: list[str], former: dict[str, str] | None = None) -> Column:
    """struct(id, known) of a stored language: former names give way to today's, unknown ones stay as they are; null for an empty one."""
    table = F.create_map(*(F.lit(x) for pair in (FORMER_LANGUAGES if former is None else former).items() for x in pair))
    trimmed = F.nullif(F.trim(value), F.lit(""))
    now = F.coalesce(F.try_element_at(table, trimmed), trimmed)
    return F.when(now.isNotNull(), F.struct(now.alias("id"), now.isin(*known).alias("known")))


def match_label(matches: Column, status: Column) -> Column:
    """What a record's matches are called: its only verse, the first and last of a chapter, or how many, and whether they are sure. matches have chapter and verse."""
    n, first, last = F.size(matches), F.get(matches, F.lit(0)), F.element_at(matches, -1)
    one = ref_key(first["chapter"], first["verse"])
    same = F.forall(matches, lambda m: m["chapter"] == first["chapter"])
    span = ref_key(first["chapter"], F.array_min(F.transform(matches, lambda m: m["verse"])), F.array_max(F.transform(matches, lambda m: m["verse"])))
    name = F.when(n == 1, one).when(same, span).otherwise(F.concat(one, F.lit(" +"), (n - 1).cast("string")))
    return F.when(n == 0, "no match").otherwise(F.concat(name, F.when(status == "confirmed", "").otherwise(F.concat(F.lit(" ("), status, F.lit(")")))))


def shortened(text: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis if it is longer."""
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(most))), F.lit("\u2026"))).otherwise(text)
