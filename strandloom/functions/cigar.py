"""CIGAR strings and SAM flags as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.sequence import letters

TOKEN = "([0-9]*)([MIDNSHP=X])"
# Operations that advance along the query and along the subject.
ON_QUERY, ON_SUBJECT = "MISP=X", "MDSP=X"
# The twelve SAM flag bits in order and the letters that stand for them.
SAM_BITS = "pPuUrR12sfdS"


def tokens(cigar: Column) -> Column:
    """Array of (n, op); a missing count is 1."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]*[MIDNSHP=X]"), F.lit(0))
    n = lambda t: F.left(t, F.length(t) - 1)
    return F.transform(parts, lambda t: F.struct(F.when(n(t) == "", 1).otherwise(n(t).cast("int")).alias("n"), F.right(t, F.lit(1)).alias("op")))


def op_total(cigar: Column, ops: str) -> Column:
    """Sum of the counts of the operations."""
    kept = F.filter(tokens(cigar), lambda t: F.contains(F.lit(ops), t["op"]))
    return F.aggregate(kept, F.lit(0), lambda s, t: s + t["n"])


def query_length(cigar: Column) -> Column:
    return op_total(cigar, ON_QUERY)


def subject_length(cigar: Column) -> Column:
    return op_total(cigar, ON_SUBJECT)


def query_span(cigar: Column) -> Column:
    """(start, end) on the query; a leading hard clip moves the start."""
    first = F.get(tokens(cigar), F.lit(0))
    start = F.when(first["op"] == "H", first["n"]).otherwise(0)
    return F.struct(start.alias("start"), (start + query_length(cigar)).alias("end"))


def expand(cigar: Column) -> Column:
    """One letter for each step."""
    return F.array_join(F.transform(tokens(cigar), lambda t: F.repeat(t["op"], t["n"])), "")


def collapse(steps: Column, abbreviate: bool = False) -> Column:
    """Run-length form of a string of steps; abbreviate leaves counts of 1 out."""
    runs = F.regexp_extract_all(steps, F.lit("(.)\\1*"), F.lit(0))
    count = lambda r: F.when(F.lit(abbreviate) & (F.length(r) == 1), F.lit("")).otherwise(F.length(r).cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(count(r), F.left(r, F.lit(1)))), "")


def reverse_cigar(cigar: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(cigar, F.lit("[0-9]*[MIDNSHP=X]"), F.lit(0))), "")


_KINDS = {"matches": "=", "mismatches": "X", "insertions": "I", "deletions": "D"}


def errors(cigar: Column) -> Column:
    """(matches, mismatches, insertions, deletions, errors) of a cigar of =, X, I and D, in one pass."""
    start = F.struct(*(F.lit(0).alias(k) for k in _KINDS))
    step = lambda s, t: F.struct(*((s[k] + F.when(t["op"] == op, t["n"]).otherwise(0)).alias(k) for k, op in _KINDS.items()))
    done = lambda s: F.struct(*(s[k].alias(k) for k in _KINDS), (s["mismatches"] + s["insertions"] + s["deletions"]).alias("errors"))
    return F.aggregate(tokens(cigar), start, step, done)


def from_alignment(query: Column, subject: Column, specific: bool = True) -> Column:
    """Steps of two gapped strings of one length; null if the lengths differ. A gap in the subject is an insertion."""
    same = F.lit("=" if specific else "M")
    other = F.lit("X" if specific else "M")
    step = lambda a, b: F.when(a == "-", "D").when(b == "-", "I").when(a == b, same).otherwise(other)
    steps = F.array_join(F.zip_with(letters(query), letters(subject), step), "")
    return F.when(F.length(query) == F.length(subject), steps)


def specify(cigar: Column, query: Column, subject: Column) -> Column:
    """Steps of a cigar with each M as = or X, from the ungapped strings; S moves along both."""
    start = F.struct(F.lit(1).alias("q"), F.lit(1).alias("s"), F.lit("").alias("out"))

    def step(state: Column, op: Column) -> Column:
        equal = F.substring(query, state["q"], F.lit(1)) == F.substring(subject, state["s"], F.lit(1))
        said = F.when(op == "M", F.when(equal, "=").otherwise("X")).otherwise(op)
        on_q, on_s = F.contains(F.lit(ON_QUERY), op).cast("int"), F.contains(F.lit(ON_SUBJECT), op).cast("int")
        return F.struct((state["q"] + on_q).alias("q"), (state["s"] + on_s).alias("s"), F.concat(state["out"], said).alias("out"))

    steps = F.filter(F.split(expand(cigar), ""), lambda c: c != "")
    return F.aggregate(steps, start, step, lambda s: s["out"])


def cigar_score(cigar: Column, match: float, mismatch: float, insertion: float, deletion: float) -> Column:
    weights = dict(zip(_KINDS.values(), (match, mismatch, insertion, deletion), strict=True))
    each = F.create_map(*(F.lit(x) for op, w in weights.items() for x in (op, float(w))))
    return F.aggregate(tokens(cigar), F.lit(0.0), lambda s, t: s + t["n"] * F.coalesce(F.try_element_at(each, t["op"]), F.lit(0.0)))


def strand(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(16) != 0, "-").otherwise("+")


def flag_letters(flags: Column) -> Column:
    """The letters of the set bits, in the bits' order."""
    return F.concat(*(F.when(flags.bitwiseAND(1 << i) != 0, c).otherwise("") for i, c in enumerate(SAM_BITS)))
