"""Text measures as native expressions; word lists are parameters."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read; null for null where ``use`` gives that."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def strip_fillers(text: Column, fillers: Sequence[str]) -> Column:
    """Without the filler strings (longest first, one after another), blanks collapsed."""
    for f in sorted(fillers, key=len, reverse=True):
        text = F.replace(text, F.lit(f), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams in order of first appearance; none for shorter texts."""
    def joined(chars: Column) -> Column:
        grams = chars
        for k in range(1, n):  # a place in a text costs its length to find, so neighbours in the array are joined instead
            grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))

    return F.when(F.length(text) >= n, once(F.split(text, ""), joined)).otherwise(F.array().cast("array<string>"))


def clean_ngrams(text: Column, n: int, stop: str) -> Column:
    """``char_ngrams`` of a text without zero-width characters, blanks and punctuation; n-grams of characters in ``stop`` alone
    are left out. Texts that need it should be in Unicode form NFKC."""
    clean = F.regexp_replace(text, r"[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]", "")
    clean = F.regexp_replace(clean, r"[\s,\x{ff0c}\x{3002}\x{ff01}\x{ff1f}\x{3001}\x{ff1b}\x{ff1a}\x{201c}\x{201d}\x{2018}\x{2019}()\[\]\x{3010}\x{3011}-]+", "")
    return F.filter(once(clean, lambda c: char_ngrams(c, n)), lambda g: F.length(F.translate(g, stop, "")) > 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def set_cosine(a: Column, b: Column, least: int = 1) -> Column:
    """Shared elements over the geometric mean of the sizes; zero if fewer than ``least`` are shared."""
    size, shared = F.sqrt(F.size(a).cast("double") * F.size(b)), F.size(F.array_intersect(a, b))
    return F.when((shared >= least) & (size > 0), shared / size).otherwise(0.0)


def keywords(text: Column, stop: Sequence[str], least: int = 2) -> Column:
    """Distinct words of ``least`` characters or more that aren't stop words, in order."""
    return F.array_except(F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= least)), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def char_overlap(a: Column, b: Column, most: int = 3) -> Column:
    """Length of the longest common substring up to ``most``, over ``most``."""
    out = F.lit(0.0)
    for k in range(1, most + 1):
        out = F.when(F.exists(char_ngrams(a, k), lambda g: F.contains(b, g)), k / most).otherwise(out)
    return out


def title_similarity(a: Column, b: Column, stop: Sequence[str]) -> Column:
    """1 for equal titles, .85 if one holds the other, else .5 Jaccard + .2 length ratio + .3 character overlap."""
    ka, kb = keywords(a, stop), keywords(b, stop)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    mixed = F.lit(0.5) * jaccard(ka, kb) + F.lit(0.2) * ratio + F.lit(0.3) * char_overlap(a, b)
    held = F.contains(a, b) | F.contains(b, a)
    return F.when(a == b, 1.0).when(held, 0.85).when((F.size(ka) == 0) | (F.size(kb) == 0), 0.0).otherwise(mixed)


def estimate_tokens(text: Column) -> Column:
    """Two per ideograph and 0.3 per other character, rounded down."""
    ideographs = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.floor((ideographs * 20 + (F.length(text) - ideographs) * 3) / 10)


def length_score(text: Column) -> Column:
    """1 for 20 to 80 characters (blanks and line feeds aside), falling to .7 at 10 and 120 and on to .2 beyond."""
    return once(F.length(F.translate(text, " \n", "")), _length_score)


def _length_score(n: Column) -> Column:
    low, high = F.lit(0.2), F.lit(0.2)
    ladder = F.when(n.between(20, 80), 1.0).when(n.between(10, 19), 0.7 + 0.3 * (n - 10) / 10).when(n.between(81, 120), 0.7 + 0.3 * (120 - n) / 40)
    return ladder.when(n < 10, F.greatest(low, n / 10 * 0.5)).otherwise(F.greatest(high, F.lit(120) / n * 0.5))


def diversity_score(text: Column) -> Column:
    """Distinct letters, digits and ideographs over all of them, stretched from .3 to .7; zero without any."""
    plain = [F.lit(c) for c in string.ascii_letters + string.digits]

    def score(clean: Column) -> Column:
        ideographs = F.regexp_replace(clean, "[a-zA-Z0-9]+", "")
        others = once(ideographs, lambda x: F.when(x == "", 0).otherwise(F.size(F.array_distinct(F.split(x, "")))))
        different = sum((F.contains(clean, c).cast("int") for c in plain), others)
        ratio = F.when(F.length(clean) > 0, different / F.length(clean))
        return once(ratio, lambda r: F.when(r.isNull() & clean.isNotNull(), 0.0).when(r >= 0.3, F.least(F.lit(1.0), (r - 0.3) / 0.4)).otherwise(r))

    return once(F.regexp_replace(text, r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9]+", ""), score)


def keyword_score(text: Column, pattern: str) -> Column:
    """.3, and .05 for each match up to .25."""
    return 0.3 + F.least(F.lit(0.25), 0.05 * F.regexp_count(text, F.lit(pattern)))


def local_score(text: Column, energy: Column, pattern: str) -> Column:
    """The mean of the four scores; very short texts have fixed ones. Between .3 and 1."""
    short = F.length(F.trim(text)) < 5
    or_ = lambda value, score: F.when(short, value).otherwise(score)
    mean = (or_(0.6, length_score(text)) + energy_score(energy) + or_(0.5, diversity_score(text)) + or_(0.4, keyword_score(text, pattern))) / 4
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), mean))


def file_name(name: Column) -> Column:
    """Without characters that file systems refuse; blanks become underscores."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", "_")


def fallback_title(title: Column, text: Column, most: int = 30) -> Column:
    """``title``, or the beginning of ``text`` with dots if it is longer."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), cut)


def starts_with_any(text: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.startswith(F.trim(text), F.lit(m))
    return out


def ends_sentence(text: Column, marks: str = ".!?") -> Column:
    """Whether the last character (blanks aside) is one of ``marks``."""
    return F.right(F.trim(text), F.lit(1)).isin(list(marks))


def speaker_of(text: Column) -> Column:
    """``name`` of a leading ``name:``; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*([\p{L}\p{N}_ ]{1,20}):", 1), F.lit(""))


def squeeze_repeats(text: Column) -> Column:
    """Runs of one character (three or more) cut to one."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1")


def corrected(text: Column, replaced: Mapping[str, str], least: float = 0.55) -> Column:
    """``text``, ``confidence`` of a line after literal replacements and squeezed repeats.

    If less than ``least`` of the longer text is left in length the line stays as it was. Confidence: 1 for a line that no
    rule changes, .9 if replacements alone do, .75 if repeats do, .8 for a correction that was taken back.
    """
    new = text
    for wrong, right in replaced.items():
        new = F.replace(new, F.lit(wrong), F.lit(right))
    squeezed = squeeze_repeats(new)
    like = F.least(F.length(text), F.length(squeezed)) / F.greatest(F.length(text), F.length(squeezed), F.lit(1))
    back = like < least
    confidence = F.when(squeezed == text, 1.0).when(back, 0.8).when(squeezed != new, 0.75).otherwise(0.9)
    return F.struct(F.when(back, text).otherwise(squeezed).alias("text"), confidence.alias("confidence"))


def windowed_words(text: Column, keep: int, sizes: Sequence[int], stop: Sequence[str] = (), most: int | None = None) -> Column:
    """Words of up to ``keep`` characters, and of longer ones all windows of the given sizes, by place and then size;
    distinct, in order, without stop words, at most ``most``."""

    def windows(w: Column) -> Column:
        at = lambda i: F.filter(F.array(*[F.when(i + n - 1 <= F.length(w), F.substr(w, i, F.lit(n))) for n in sizes]), lambda x: x.isNotNull())
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(w) - min(sizes) + 1), at))

    parts = F.transform(F.array_distinct(words(text)), lambda w: F.when(F.length(w) <= keep, F.array(w)).otherwise(windows(w)))
    out = F.array_distinct(F.flatten(parts))
    if stop:
        out = F.array_except(out, F.array(*[F.lit(x) for x in stop]))
    return out if most is None else F.slice(out, 1, most)


def keywords_or_pairs(text: Column, stop: Sequence[str], least: int = 2) -> Column:
    """``keywords``, or the bigrams of the text without blanks if it has none."""
    found = keywords(text, stop, least)
    return F.when(F.size(found) > 0, found).otherwise(char_ngrams(F.regexp_replace(F.lower(text), r"\s", ""), 2))


def candidate_words(text: Column, signatures: Sequence[str]) -> Column:
    """Signatures that the text holds, once each, words of two or more characters, and the bigrams of those of four or more."""
    hits = F.filter(F.array(*[F.lit(x) for x in signatures]).cast("array<string>"), lambda x: F.contains(text, x))
    long = F.filter(words(text), lambda w: F.length(w) >= 2)
    pairs = F.flatten(F.transform(F.filter(long, lambda w: F.length(w) >= 4), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))))
    return F.concat(hits, long, pairs)


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def energy_score(energy: Column) -> Column:
    """1 for a normalised energy of .3 to .7, less beyond down to .2; .5 if it is unknown."""
    outside = F.when(energy < 0.3, energy / 0.3 * 0.7).otherwise((1 - energy) / 0.3 * 0.7)
    return F.when(energy.isNull(), 0.5).when(energy.between(0.3, 0.7), 1.0).otherwise(F.greatest(F.lit(0.2), outside))


def duration_score(seconds: Column, length: Column | None = None) -> Column:
    """7 to 9 for 30 to 120 s (best at 60), 5 to 7 below, 6 to 5.5 above; with ``length``, .5 more over 50 characters and
    .5 less under 20."""
    base = F.when(seconds.between(30, 120), 7 + (1 - F.abs(seconds - 60) / 60) * 2).when(seconds < 30, 5 + seconds / 30 * 2)
    base = base.otherwise(6 - F.least((seconds - 120) / 120, F.lit(0.5)))
    return base if length is None else base + F.when(length > 50, 0.5).when(length < 20, -0.5).otherwise(0.0)


def two_places(score: Column, places: int = 2) -> Column:
    """Rounded half up as a decimal, so that engines agree."""
    return F.round(score.cast("decimal(18,6)"), places).cast("double")


def finish_title(title: Column, pad: Column, least: int, most: int, replaced: Mapping[str, str] | None = None, marks: str = ",.;!?") -> Column:
    """A title with some words ``replaced``, padded by ``pad`` if shorter than ``least`` characters; a longer one than ``most``
    is cut at its last punctuation mark before that, or there."""
    for word, other in (replaced or {}).items():
        title = F.replace(title, F.lit(word), F.lit(other))
    full = F.when(F.length(title) < least, F.concat(title, F.lit(" "), pad)).otherwise(title)
    head = F.left(full, F.lit(most))
    at_mark = F.regexp_extract(head, rf"(?s)^(.*)[{marks}][^{marks}]*$", 1)
    return F.trim(F.when(F.length(full) <= most, full).when(F.length(at_mark) > 0, at_mark).otherwise(head))


def head_and_tail(lines: Column, head: int, tail: int, mark: str = "[...]") -> Column:
    """The first ``head`` and the last ``tail`` elements with a mark between if any are left out."""
    n = F.size(lines)
    return F.when(n <= head + tail, lines).otherwise(F.concat(F.slice(lines, 1, head), F.array(F.lit(mark)), F.slice(lines, -tail, tail)))
