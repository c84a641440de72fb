"""Tokens, n-grams and text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that never count as terms.
ENGLISH = """a about above after again against all also am an and any are as at be because been before being below between both but by can
cannot did do does doing done down during each else few for from further had has have having he her here hers herself him himself his how
i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same
she should so some such than that the their theirs they them themselves then there these this those through to too under until up us very
was we were what when where which while who whom why will with would you your yours yourself yourselves""".split()
POLISH = """aby ach ale albo ani aż bez bo bowiem być był była było były będzie będą byśmy cały co ci ciebie cię czy czyli dla dlaczego
dlatego gdy gdyby gdyż gdzie go ich im iż ja jak jako jego jej jest jestem jesteśmy jeszcze jeśli już każdy kiedy kilka kto która które
którego której który którzy ku lecz lub ma mają mam mi mnie mogą może można mój mu na nad nam nas nasze nie niego niej nim niż o od ona one
oni ono oraz oto po pod ponieważ potem przez przy się skąd sobie są ta tak także tam te tego tej ten teraz też tu tutaj twoja twój u w wam
wasz więc wszystko z za ze zatem że żeby żaden żadna żadne żadnego żadnej""".split()
MAX_TOKEN_CHARS, MAX_GRAM = 40, 3

STOPWORDS = [*ENGLISH, *POLISH]
STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits of the composed text, without stopwords and overlong ones."""
    words = F.regexp_extract_all(F.lower(nfc(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    return F.filter(words, lambda w: (F.char_length(w) <= MAX_TOKEN_CHARS) & ~w.isin(STOPWORDS))


def nfc(text: Column) -> Column:
    """Composed Unicode form, by the ICU library that Spark's collations use.  Characters below U+0300 compose with
    nothing, so only texts with others are looked at."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), composed).otherwise(text)


def grams(token_array: Column, most: int = MAX_GRAM) -> Column:
    """1..most-grams, space-joined, in order of start and length."""
    n = F.size(token_array)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(token_array, i, k), " "))))


def is_keyword(term: Column) -> Column:
    """Every word has a letter and two characters, and one is long enough to mean something."""
    words = F.filter(F.split(term, r"\s+"), lambda w: w != "")
    letters = lambda w: F.char_length(F.regexp_replace(w, r"\P{L}", ""))
    fit = F.forall(words, lambda w: (letters(w) > 0) & (F.char_length(w) >= 2))
    return (F.size(words) > 0) & fit & F.exists(words, lambda w: (letters(w) >= 3) | ((F.char_length(w) >= 3) & (letters(w) >= 2)))


def collapse(text: Column) -> Column:
    """Unicode white space runs become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[\s\p{Z}\x85]+", " "))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something is cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def cut_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes of UTF-8 and an ellipsis, where there are more; a character is not cut in two."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(F.regexp_replace(head, "\ufffd$", ""), F.lit("…"))).otherwise(text)


def printable(text: Column) -> Column:
    """Without control and format characters, but for newline and tab."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]|\p{Cf}", "")


def tenths(share: Column) -> Column:
    """100 * share with one decimal, halves up."""
    return F.floor(share * 1000 + 0.5) / 10
