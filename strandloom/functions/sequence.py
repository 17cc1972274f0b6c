"""Nucleotide sequence functions as Column builders. All stay in the JVM; none needs Python workers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC alphabet and what each letter stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "W": "AT", "S": "CG",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def _letter_for(bases: str) -> str:
    return next(k for k, v in IUPAC.items() if set(v) == set(bases))


PARTNER = {k: _letter_for("".join(_COMPLEMENT[b] for b in v)) for k, v in IUPAC.items()}
_FROM = "".join(PARTNER) + "".join(PARTNER).lower()
_TO = "".join(PARTNER.values()) + "".join(PARTNER.values()).lower()


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    """Case is kept; letters outside the alphabet stay."""
    src, dst = (_FROM.replace("T", "U").replace("t", "u"), _TO.replace("T", "U").replace("t", "u")) if rna else (_FROM, _TO)
    return F.reverse(F.translate(seq, src, dst))


def count_letters(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def weighted_count(seq: Column, bases: str) -> Column:
    """How many of the bases seq holds, an ambiguous letter counting by its share."""
    classes: dict[Fraction, str] = defaultdict(str)
    for letter, own in IUPAC.items():
        if share := Fraction(len(set(own) & set(bases)), len(own)):
            classes[share] += letter + letter.lower()
    total = F.lit(0.0)
    for share, letters in sorted(classes.items(), reverse=True):
        total = total + count_letters(seq, letters) * F.lit(share.numerator / share.denominator)
    return total


def base_frequency(seq: Column, bases: str) -> Column:
    """Share of the bases, 0 to 1; null for an empty sequence."""
    return F.try_divide(weighted_count(seq, bases), F.length(seq))


def gc_percent(seq: Column) -> Column:
    return base_frequency(seq, "CG") * 100


def letters(seq: Column) -> Column:
    """Characters as an array; empty for an empty sequence."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def base_share(letter: Column, base: str) -> Column:
    """How much of one letter is the base: 1, 1/2, 1/3, 1/4 or 0."""
    up = F.upper(letter)
    out = None
    for k, own in IUPAC.items():
        if base in own:
            out = F.when(up == k, 1.0 / len(own)) if out is None else out.when(up == k, 1.0 / len(own))
    return out.otherwise(0.0)


def longest_run(seq: Column, base: str) -> Column:
    """Longest run of letters that may be the base, each letter adding its share."""
    start = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best"))

    def step(state: Column, letter: Column) -> Column:
        share = base_share(letter, base)
        now = F.when(share > 0, state["now"] + share).otherwise(0.0)
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(letters(seq), start, step, lambda s: s["best"])


def longest_homopolymer(seq: Column) -> Column:
    return F.greatest(*(longest_run(seq, b) for b in "ACGT"))


def proximal_g(seq: Column, side: Column) -> Column:
    """Share of G in the letter next to the PAM: the last for side '>', the first for '<'."""
    return base_share(F.when(side == ">", F.right(seq, F.lit(1))).otherwise(F.left(seq, F.lit(1))), "G")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(first: Column, last: Column) -> Column:
    """first to last; empty if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def windows(seq: Column, width: int | Column, step: int = 1) -> Column:
    """Full windows as (start from 0, text)."""
    width = F.lit(width) if isinstance(width, int) else width
    starts = F.filter(positions(F.lit(0), F.length(seq) - width), lambda i: i % step == 0)
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(seq, i + 1, width).alias("text")))


def case_rule(seq: Column, mode: str) -> Column:
    """Whether a sequence's letter case is accepted: ignore, upper-only, lower-only, mixed-lower (some lower), mixed-upper (some upper), mixed-only (both)."""
    lower, upper = seq.rlike("[a-z]"), seq.rlike("[A-Z]")
    rules = {
        "ignore": F.lit(True), "upper-only": ~lower, "lower-only": ~upper,
        "mixed-lower": lower, "mixed-upper": upper, "mixed-only": lower & upper,
    }
    return rules[mode]


def is_ambiguous(seq: Column) -> Column:
    return seq.rlike("[^ACGTacgt]")


def disambiguate(seq: Column) -> Column:
    """All concrete sequences, in alphabetical order of their bases. Grows with the product of the letters' sizes."""
    def options(letter: Column) -> Column:
        out = None
        for k, own in IUPAC.items():
            for letter_case, bases in ((k, own), (k.lower(), own.lower())):
                value = F.array(*(F.lit(b) for b in bases))
                out = F.when(letter == letter_case, value) if out is None else out.when(letter == letter_case, value)
        return out.otherwise(F.array(letter))

    grow = lambda have, letter: F.flatten(F.transform(have, lambda h: F.transform(options(letter), lambda b: F.concat(h, b))))
    return F.aggregate(letters(seq), F.array(F.lit("")), grow)


def mismatch_positions(a: Column, b: Column) -> Column:
    """Places from 1, over the shorter length, where a and b differ."""
    n = F.least(F.length(a), F.length(b))
    return F.filter(positions(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))


def hamming(a: Column, b: Column) -> Column:
    return F.size(mismatch_positions(a, b))


def hamming_of(a: Column, b: Column, length: int) -> Column:
    """hamming() of two sequences of a known length, as one generated expression."""
    out = F.lit(0)
    for i in range(1, length + 1):
        out = out + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int")
    return out


def matching_prefix(a: Column, b: Column) -> Column:
    """Length of the common start; letters match if their IUPAC sets meet and N doesn't absorb: exact letters only."""
    places = mismatch_positions(a, b)
    return F.when(F.size(places) > 0, places[0] - 1).otherwise(F.least(F.length(a), F.length(b)))


def matching_suffix(a: Column, b: Column) -> Column:
    return matching_prefix(F.reverse(a), F.reverse(b))


def three_prime_complement(a: Column, b: Column, most: int = 5) -> Column:
    """Longest 3' end, up to `most` letters, of either that lies in the other's reverse complement."""
    out = None
    for n in range(most, 0, -1):
        hit = F.contains(reverse_complement(b), F.right(a, F.lit(n))) | F.contains(reverse_complement(a), F.right(b, F.lit(n)))
        hit = hit & (F.length(a) >= n) & (F.length(b) >= n)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(0)


def is_palindrome(seq: Column) -> Column:
    return F.upper(seq) == F.upper(reverse_complement(seq))


def class_pattern(seq: str, any_letter: bool = True) -> str:
    """A regular expression for an IUPAC string, runs of one letter shortened to a repeat count; '.' matches anything."""
    out, at = [], 0
    while at < len(seq):
        end = at
        while end < len(seq) and seq[end] == seq[at]:
            end += 1
        letter = seq[at]
        own = IUPAC.get(letter.upper(), letter)
        if letter == "." and any_letter:
            body = "."
        elif len(own) == 1:
            body = own
        else:
            body = f"[{own}]"
        out.append(body + (f"{{{end - at}}}" if end - at > 1 else ""))
        at = end
    return "".join(out)


def find_all(seq: Column, query: str | Column) -> Column:
    """Starts from 0 of all exact, overlapping hits, ignoring case."""
    query = F.lit(query) if isinstance(query, str) else query
    up, q = F.upper(seq), F.upper(query)
    return F.filter(positions(F.lit(0), F.length(seq) - F.length(query)), lambda i: F.substring(up, i + 1, F.length(query)) == q)


def slug(text: Column, lower: bool = False, decimal: str = "!", space: str = "_", other: str = "+") -> Column:
    """Path-safe text: letters, digits, '-' and '_' stay; a dot, a space and anything else have stand-ins."""
    # the stand-ins come in through control characters, so that one can't be taken for another
    marked = F.regexp_replace(F.translate(text, ". ", "\x01\x02"), "[^A-Za-z0-9_\\-\x01\x02]", "\x03")
    out = F.translate(marked, "\x01\x02\x03", decimal + space + other)
    return F.lower(out) if lower else out


def justify(left: Column, right: Column, width: int = 140) -> Column:
    """left and right at the two edges of a line. If they don't fit, left ends in dots; with a right of over half the line, both are cut to less than
    half of it, with dots between them."""
    half = width // 2 - 1
    fits = F.length(left) + F.length(right) < width
    halves = F.concat(F.left(left, F.lit(half)), F.lit("." * (width - 2 * half)), F.right(right, F.lit(half)))
    room = F.lit(width) - F.length(right) - 3
    # a negative room counts from left's end, as slices do
    cut = F.when(room >= 0, F.left(left, room)).otherwise(F.left(left, F.greatest(F.length(left) + room, F.lit(0))))
    return F.when(fits, F.concat(left, F.lpad(right, width - F.length(left), " "))).when(F.length(right) > half, halves).otherwise(F.concat(cut, F.lit("..."), right))


def justify_split(left: Column, right: Column, width: int = 140, split: int | None = None) -> Column:
    """left and right at the two edges of a line. If they don't fit, left is cut at the column `split` (half the line), a space and three
    dots follow, and right's end fills the rest."""
    split = width // 2 if split is None else max(0, min(split, width))
    fits = F.length(left) + F.length(right) < width
    shown = F.left(left, F.lit(split))
    head = F.concat(shown, F.lit(" ..."))
    room = F.greatest(F.lit(width) - F.length(head), F.lit(0))
    tail = F.right(right, room)
    over = F.concat(head, F.lpad(tail, room, " "))
    return F.when(fits, F.concat(left, F.lpad(right, width - F.length(left), " "))).otherwise(over)


# Characters that GFF3 text writes as percent codes, beside those up to the space.
GFF_RESERVED = "\"%&'(),;=[\\]\x7f"


def _hex(c: int) -> str:
    """Two hex digits: of signs in upper case, of controls in lower case."""
    return f"%{c:02x}" if c < 33 else f"%{c:02X}"


def gff_encode(text: Column) -> Column:
    """Text with percent codes for the space, controls and reserved signs."""
    text = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in [chr(i) for i in range(33)] + [c for c in GFF_RESERVED if c != "%"]:
        text = F.replace(text, F.lit(c), F.lit(_hex(ord(c))))
    return text


def gff_decode(text: Column) -> Column:
    """Percent codes of two digits or upper-case letters as their characters; others stay, so codes of some controls do too. One pass from
    the left: what a code gives is no part of another code."""
    parts = F.split(text, "%")

    def piece(x: Column) -> Column:
        code = F.left(x, F.lit(2))
        return F.when(x.rlike("^[0-9A-F]{2}"), F.concat(F.decode(F.unhex(code), "ISO-8859-1"), F.substring(x, F.lit(3), F.length(x)))).otherwise(F.concat(F.lit("%"), x))

    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))


def strand_flip(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


# Letters and their forms turned by half a circle.
UPRIGHT = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
TURNED = "ɐqɔpǝɟɓɥᴉſʞ┐ɯuodbɹsʇnʌʍxʎzⱯʚƆpƎℲϑHIſʞ˥WNOԀÕᴚS┴ՈΛMXʎZ"


def upside_down(text: Column) -> Column:
    """Text turned by half a circle."""
    return F.reverse(F.translate(text, UPRIGHT, TURNED))


def has_right_match(a: Column, b: Column, length: int) -> Column:
    """1 if so many last letters agree, else 0."""
    return F.when(matching_suffix(a, b) >= length, 1).otherwise(0)


def flattened(nested: Column, remove_null: bool = False) -> Column:
    out = F.flatten(nested)
    return F.array_compact(out) if remove_null else out
