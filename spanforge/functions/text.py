"""String scalars: normal forms, word edges, attached suffixes, scripts, hashes.

Offsets are half-open, zero-based and count Unicode code points, as Spark's ``length``,
``substring`` and ``locate`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the apostrophes in use, and the case and plural suffixes, as text
APOSTROPHES = "'ʼʻ‘’`´"
LATIN_SUFFIXES = ("lardagi", "laridan", "larining", "lariga", "larida", "lardan", "larni", "larga", "larda", "ning", "dagi", "dan", "ga", "ni", "da", "lar")
CYRILLIC_SUFFIXES = ("лардаги", "ларидан", "ларининг", "ларига", "ларида", "лардан", "ларни", "ларга", "ларда", "нинг", "даги", "дан", "га", "ни", "да", "лар")
SUFFIXES = LATIN_SUFFIXES + CYRILLIC_SUFFIXES
WORD = r"\p{L}\p{N}'ʼʻ‘’`´\-‑"
#: what Python's ``str.isspace`` calls white space, as the inside of a character class
WHITE = "\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
QUOTES = "«»\"“”()[]{}"


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """The half-open slice [start, end)."""
    return F.substring(text, start + 1, end - start)


def fold_apostrophes(text: Column) -> Column:
    """Every apostrophe as U+0027; the length stays."""
    return F.translate(text, APOSTROPHES[1:], "'" * (len(APOSTROPHES) - 1))


def normalize_text(text: Column) -> Column:
    """Folded apostrophes, lower case (with ss for sharp s), single blanks, no outer blanks."""
    folded = F.replace(F.lower(fold_apostrophes(text)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, f"[{WHITE}]+", " "))


def record_hash(source: Column, key: Column, text: Column) -> Column:
    """``sv`` and the SHA-1 of source, key and text on lines of their own."""
    return F.concat(F.lit("sv"), F.sha1(F.concat_ws("\n", source, key.cast("string"), text)))


def is_word_char(c: Column) -> Column:
    return c.rlike(f"^[{WORD}]$")


def mid_token(text: Column, at: Column) -> Column:
    """True if word characters stand on both sides of offset ``at``."""
    return F.when((at > 0) & (at < F.length(text)), is_word_char(F.substring(text, at, F.lit(1))) & is_word_char(F.substring(text, at + 1, F.lit(1)))).otherwise(False)


def _run_before(text: Column, at: Column, inside: str, reach: int) -> Column:
    """How many characters of the class ``inside`` stand right before offset ``at``.

    Most runs are short, so a window of ``reach`` characters is tried first. It is read
    backwards, so that the pattern is tried at one place only.
    """
    back = lambda some: F.length(F.regexp_extract(F.reverse(some), f"^[{inside}]*+", 0))
    near = back(F.substring(text, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))))
    return F.when(near < reach, near).otherwise(back(F.substring(text, F.lit(1), at)))


def _run_after(text: Column, at: Column, inside: str, reach: int) -> Column:
    near = F.length(F.regexp_extract(F.substring(text, at + 1, F.lit(reach)), f"^[{inside}]*+", 0))
    return F.when(near < reach, near).otherwise(F.length(F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^[{inside}]*+", 0)))


#: the least size of a page
PAGE = 64


def page_size(text: Column) -> Column:
    """Characters a page: no run of word characters, nor of blanks and tabs, is longer than a page."""
    long_ = F.regexp_extract_all(text, F.lit(f"[{WORD}]{{{PAGE},}}+|[ \\t]{{{PAGE},}}+"), F.lit(0))
    return F.greatest(F.array_max(F.transform(long_, lambda x: F.length(x))), F.lit(PAGE))


def pages(text: Column, size: Column) -> Column:
    """The stretches of ``size`` characters that make up a text."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))


def expand_to_word_edges(text: Column, start: Column, end: Column, reach: int = 256) -> Column:
    """struct(start, end) grown through word characters on both sides, however long the word is."""
    n = F.length(text)
    s = F.greatest(F.least(start, n), F.lit(0))
    e = F.greatest(F.least(end, n), s)
    return F.struct((s - _run_before(text, s, WORD, reach)).alias("start"), (e + _run_after(text, e, WORD, reach)).alias("end"))


def attached_suffix(rest: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The longest suffix (an apostrophe may come first) that ``rest`` starts with, else ''.

    No letter may follow it; the original case is kept.
    """
    best = "|".join(sorted(suffixes, key=lambda x: (-len(x), x)))
    return F.regexp_extract(rest, rf"(?iu)^[{APOSTROPHES}]?(?:{best})(?!\p{{L}})", 0)


def rewrite_span_end(text: Column, start: Column, end: Column, suffixes: tuple[str, ...] = SUFFIXES, reach: int = 32) -> Column:
    """struct(end, matched, reason) with the end moved over an attached suffix.

    reason: invalid, eos, space, quote, punct, none or extended.
    """
    after = F.substring(text, end + 1, F.lit(reach))
    nxt = F.substring(text, end + 1, F.lit(1))
    last = F.substring(text, end, F.lit(1))
    matched = attached_suffix(after, suffixes)
    reason = (
        F.when((start < 0) | (end <= start) | (end > F.length(text)), "invalid")
        .when(end == F.length(text), "eos")
        .when(nxt.rlike(f"^[{WHITE}]$"), "space")
        .when(F.instr(F.lit(QUOTES), nxt) > 0, "quote")
        .when(~is_word_char(last), "punct")
        .when(matched == "", "none")
        .otherwise("extended")
    )
    def placed(why: Column) -> Column:
        hit = why == "extended"
        return F.struct(F.when(hit, end + F.length(matched)).otherwise(end).alias("end"), F.when(hit, matched).otherwise("").alias("matched"), why.alias("reason"))

    # as the one element of an array the reason is worked out once, wherever it is used
    return F.get(F.transform(F.array(reason), placed), F.lit(0))


def attach_suffix(text: Column, start: Column, end: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The end of a span, moved over an attached suffix; spans that do not fit the text stay."""
    return rewrite_span_end(text, start, end, suffixes)["end"]


def surface_suffix(surface: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix that a one-word surface ends with, after over two characters of which the last is a letter or an apostrophe; else ''.

    The longest suffix that fits is taken: the one after the shortest stem.
    """
    best = "|".join(sorted(suffixes, key=lambda x: (-len(x), x)))
    return F.coalesce(F.regexp_extract(F.lower(F.trim(surface)), rf"^[^ ]{{2,}}?[\p{{L}}'ʼʻ‘’]({best})$", 1), F.lit(""))


def script_of(text: Column) -> Column:
    latin, cyrillic = text.rlike("[A-Za-zÀ-ÿ]"), text.rlike("[Ѐ-ӿ]")
    return F.when(latin & cyrillic, "mixed").when(latin, "latin").when(cyrillic, "cyrillic").otherwise("other")


#: the same, one by one
WHITES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def word_count(text: Column) -> Column:
    """Words between white space; a split at one character needs no pattern, and is several times as fast as counting matches."""
    parts = F.split(F.translate(text, WHITES, " " * len(WHITES)), " ", -1)
    return F.when(text.isNotNull(), F.size(F.array_remove(parts, "")))


def all_hits(text: Column, needle: Column, before: str = "") -> Column:
    """Offsets of all hits of ``needle``, overlapping ones too, in ascending order.

    The text is split before each hit, so one pass finds them in texts of any length;
    offsets are the running lengths of the pieces. ``before`` is a look-behind.
    """
    quoted = F.concat(F.lit(before + r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["hits"], F.array(acc["at"])).alias("hits"))
    hits = F.aggregate(F.split(text, quoted, -1), begin, step, lambda acc: acc["hits"])
    # the first piece is a hit only if the text starts with one
    hits = F.when(F.startswith(text, needle), hits).otherwise(F.slice(hits, F.lit(2), F.greatest(F.size(hits), F.lit(1))))
    return F.when((F.length(needle) > 0) & F.contains(text, needle), hits).otherwise(F.array().cast("array<int>"))


def word_starts(text: Column, needle: Column) -> Column:
    """Offsets of all hits of ``needle`` that no letter precedes."""
    return all_hits(text, needle, r"(?<!\p{L})")


def locate_mention(text: Column, mention: Column) -> Column:
    """struct(tier, starts): exact hits, else with folded apostrophes, else in lower case too."""
    exact = word_starts(text, mention)
    folded = word_starts(fold_apostrophes(text), fold_apostrophes(mention))
    lower = word_starts(F.lower(fold_apostrophes(text)), F.lower(fold_apostrophes(mention)))
    tier = F.when(F.size(exact) > 0, "exact").when(F.size(folded) > 0, "apostrophe").when(F.size(lower) > 0, "casefold").otherwise("none")
    return F.struct(tier.alias("tier"), F.when(F.size(exact) > 0, exact).when(F.size(folded) > 0, folded).otherwise(lower).alias("starts"))


def tag_type(tag: Column) -> Column:
    """The type of a BIO-like tag in upper case; null for O."""
    kind = F.upper(F.element_at(F.split(F.translate(tag, "_", "-"), "-"), -1))
    return F.when(kind != "O", kind)


def label_signature(labels: Column) -> Column:
    """Sorted distinct labels joined by ``+``, or EMPTY."""
    joined = F.array_join(F.array_sort(F.array_distinct(labels)), "+")
    return F.when(F.coalesce(joined, F.lit("")) == "", "EMPTY").otherwise(joined)


def escape_label_value(value: Column) -> Column:
    """Escapes of the text exposition format: backslash, newline, quote."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def neighbour_word(text: Column, start: Column, end: Column, side: str, reach: int = 64) -> Column:
    """struct(start, end) of the word next to a span across blanks and tabs only, or null.

    A window of ``reach`` characters is tried first, on the left read backwards; only if gap
    and word fill it, all of the text on that side is looked through.
    """
    if side == "right":
        near, far = F.substring(text, end + 1, F.lit(reach)), F.substring(text, end + 1, F.length(text))
    else:
        near, far = F.reverse(F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))), F.reverse(F.substring(text, F.lit(1), start))
    beside = F.when((F.length(near) == reach) & near.rlike(rf"^[ \t]*+[{WORD}]*+\z"), far).otherwise(near)

    def placed(x: Column) -> Column:
        gap, size = F.length(x) - F.length(F.ltrim(x)), F.length(F.ltrim(x))
        word = F.struct((end + gap).alias("start"), (end + gap + size).alias("end")) if side == "right" else F.struct((start - gap - size).alias("start"), (start - gap).alias("end"))
        return F.when(size > 0, word)

    # as the one element of an array gap and word are looked up once, wherever they are used
    found = F.translate(F.regexp_extract(beside, rf"^[ \t]++[{WORD}]+", 0), "\t", " ")
    return F.get(F.transform(F.array(found), placed), F.lit(0))


def words_in(text: Column, start: Column, end: Column) -> Column:
    """array of struct(start, end): the words inside a span."""
    parts = F.regexp_extract_all(slice_text(text, start, end), F.lit(f"[{WORD}]+|[^{WORD}]+"), 0)
    begin = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        to = (acc["at"] + F.length(x)).cast("int")
        return F.struct(to.alias("at"), F.when(x.rlike(f"^[{WORD}]"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), to.alias("end"))))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, begin, step, lambda acc: acc["found"])


def tensor_bucket(key: Column) -> Column:
    """What a checkpoint's tensor is for, by its dotted name."""
    name = F.replace(key, F.lit("/"), F.lit("."))
    parts = F.split(name, "\\.")
    return (
        F.when(F.array_contains(parts, "pooler"), "drop_pooler")
        .when(F.array_contains(parts, "_weight"), "drop_duplicate_buffer")
        .when(name.startswith("generator"), "drop_generator")
        .when(name.rlike(r"(^|\.)(lm_head|cls\.|lm_predictions|mask_predictions)"), "drop_lm_head")
        .when(name.rlike(r"(^|\.)generator"), "drop_generator")
        .when(F.array_contains(parts, "classifier"), "reinit_classifier")
        .otherwise("transfer_encoder")
    )


def starts_with_any(surface: Column, names: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda p: F.startswith(F.lower(surface), p))
