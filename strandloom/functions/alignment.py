"""Alignments that have no expression form, as Arrow-batched UDFs over short sequences."""

from __future__ import annotations

import difflib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from strandloom.functions.sequence import IUPAC



def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_INT, _TEXT = IntegerType(), StringType()
RESULT = _struct(score=DoubleType(), query=_TEXT, subject=_TEXT, substitutions=_INT, insertions=_INT, deletions=_INT, errors=_INT)


def pair_score(a: str, b: str, match: float = 1.0, transition: float = -1.0, transversion: float = -1.2) -> float:
    """Mean score of two letters over what they stand for."""
    kinds = ({"A", "G"}, {"C", "T"})
    one = [match if x == y else transition if {x, y} in kinds else transversion for x in IUPAC.get(a.upper(), a) for y in IUPAC.get(b.upper(), b)]
    return sum(one) / len(one)


#: Cells of one run of align_all().
_CELLS = 20_000_000


def align(a: str, b: str, open_gap: float = -4.0, extend: float = -2.0) -> tuple:
    """align_all() of one pair."""
    return align_all([(a, b)], open_gap, extend)[0]


def align_all(pairs: list[tuple[str, str]], open_gap: float = -4.0, extend: float = -2.0) -> list[tuple]:
    """(score, gapped texts, substitutions, insertions, deletions, errors) of global alignments with one matrix: a gap costs `extend` where the
    neighbour's own best step was a gap of that kind, else `open_gap`. On ties a pair goes before a deletion, a deletion before an insertion. Each
    cell is worked out for all pairs at once; pairs of like lengths go together, some of them at a time."""
    out: list[tuple] = [()] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        size = lambda k: (len(pairs[k][0]) + 1) * (max(len(pairs[order[at]][1]), len(pairs[k][1])) + 1)  # noqa: B023, E731
        end = at + 1
        while end < len(order) and (end + 1 - at) * size(order[end]) <= _CELLS:
            end += 1
        own = order[at:end]
        for k, found in zip(own, _aligned([pairs[k] for k in own], open_gap, extend), strict=True):
            out[k] = found
        at = end
    return out


def _aligned(pairs: list[tuple[str, str]], open_gap: float, extend: float) -> list[tuple]:
    letters = sorted({c for a, b in pairs for c in a + b})
    number = {c: i for i, c in enumerate(letters)}
    scores = np.array([[pair_score(x, y) for y in letters] for x in letters]).reshape(len(letters), len(letters))
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    code = lambda texts, width: np.array([[number[c] for c in t] + [0] * (width - len(t)) for t in texts], np.int32).reshape(len(texts), width)
    x, y = code([a for a, _ in pairs], n), code([b for _, b in pairs], m)
    pair, deletion, insertion = 1, 2, 3
    best = np.zeros((n + 1, m + 1, len(pairs)))
    step = np.zeros((n + 1, m + 1, len(pairs)), np.int8)
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            now, kind = np.full(len(pairs), -np.inf), np.zeros(len(pairs), np.int8)
            if i and j:
                now, kind = best[i - 1, j - 1] + scores[x[:, i - 1], y[:, j - 1]], np.full(len(pairs), pair, np.int8)
            for on, di, dj, mark in ((i, 1, 0, deletion), (j, 0, 1, insertion)):
                if on:
                    other = best[i - di, j - dj] + np.where(step[i - di, j - dj] == mark, extend, open_gap)
                    better = other > now
                    now, kind = np.where(better, other, now), np.where(better, mark, kind)
            best[i, j], step[i, j] = now, kind
    out = []
    for k, (a, b) in enumerate(pairs):
        i, j, top, bottom = len(a), len(b), [], []
        count = dict.fromkeys("SID", 0)
        while i or j:
            kind = step[i, j, k]
            u, v = a[i - 1] if kind != insertion else "-", b[j - 1] if kind != deletion else "-"
            count["S" if kind == pair else "D" if kind == deletion else "I"] += kind != pair or u != v
            top.append(u)
            bottom.append(v)
            i, j = i - (kind != insertion), j - (kind != deletion)
        out.append((float(best[len(a), len(b), k]), "".join(top[::-1]), "".join(bottom[::-1]), count["S"], count["I"], count["D"], sum(count.values())))
    return out


@F.pandas_udf(RESULT)
def global_alignment(query: pd.Series, subject: pd.Series) -> pd.DataFrame:
    pairs = list(zip(query, subject, strict=True))
    own = list(dict.fromkeys(p for p in pairs if None not in p))
    done = dict(zip(own, align_all(own), strict=True))
    return pd.DataFrame([done.get(p, (None,) * 7) for p in pairs], columns=RESULT.names)


def pam_identity(pams: list[str]):
    """A UDF: the best of the motif's PAMs for a sequence, 0 to 100 between the worst and the best score that it could have."""
    @F.pandas_udf(DoubleType())
    def score(pam: pd.Series) -> pd.Series:
        own = [p for p in dict.fromkeys(pam) if p is not None]
        best = dict.fromkeys(own, -float("inf"))
        for m in pams:
            columns = [[pair_score(c, x) for x in "ACGT"] for c in m]
            low, high = sum(map(min, columns)), sum(map(max, columns))
            for p, found in zip(own, align_all([(m, p) for p in own]), strict=True):
                best[p] = max(best[p], (found[0] - low) / (high - low) * 100)
        return pam.map(best.get)

    return score


@F.pandas_udf(_struct(a=_INT, b=_INT, size=_INT))
def longest_common_substring(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(first, second, strict=True):
        m = difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).find_longest_match()
        rows.append((m.a, m.b, m.size))
    return pd.DataFrame(rows, columns=["a", "b", "size"])


def split_errors(seq: str, spacer: str, pam: str, side: str) -> tuple[int, int, int, int, str, str]:
    """The split of a sequence into spacer and PAM with the fewest edits: (errors, deletions, insertions, substitutions, spacer, pam)."""
    fits = lambda c, m: m == "." or c.upper() in IUPAC.get(m.upper(), m)

    def edits(text: str, motif: str) -> tuple[int, int, int, int]:
        row = [(j, j, 0, 0) for j in range(len(motif) + 1)]
        for i, c in enumerate(text, 1):
            new = [(i, 0, i, 0)]
            for j, m in enumerate(motif, 1):
                pair = row[j - 1] if fits(c, m) else tuple(a + b for a, b in zip(row[j - 1], (1, 0, 0, 1), strict=True))
                less = tuple(a + b for a, b in zip(new[j - 1], (1, 1, 0, 0), strict=True))
                more = tuple(a + b for a, b in zip(row[j], (1, 0, 1, 0), strict=True))
                new.append(min(pair, less, more))
            row = new
        return row[-1]

    best = None
    for cut in range(len(seq) + 1):
        s, p = (seq[:cut], seq[cut:]) if side == ">" else (seq[cut:], seq[:cut])
        total = tuple(a + b for a, b in zip(edits(s, spacer), edits(p, pam), strict=True))
        if best is None or (*total[:1], edits(p, pam)[0], *total[1:]) < best[0]:
            best = ((*total[:1], edits(p, pam)[0], *total[1:]), (*total, s, p))
    return best[1]


def best_motif(motifs: list):
    """A UDF: of the parsed motifs the one that a sequence fits with the fewest edits, ties by deletions, insertions, substitutions and order."""
    @F.pandas_udf(_struct(motif=_TEXT, errors=_INT, spacer=_TEXT, pam=_TEXT))
    def choose(seq: pd.Series) -> pd.DataFrame:
        def one(s: str) -> tuple:
            found = [(*split_errors(s, sp, p, m.side), m.text) for m in motifs for sp in m.spacers for p in m.pams]
            e = min(found, key=lambda f: f[:4])
            return e[6], e[0], e[4], e[5]

        return pd.DataFrame([one(s) for s in seq], columns=["motif", "errors", "spacer", "pam"])

    return choose


def common_region(first: str, second: str, start: int = 600, step: int = 100, least: int = 200) -> tuple[int, int, int]:
    """(start in first, start in second, size) of a shared stretch of at least `least` letters, looked for in ever longer prefixes."""
    size = start
    while True:
        a, b = first[:size], second[:size]
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        if m.size >= least or (len(a) == len(first) and len(b) == len(second)):
            return m.a, m.b, m.size
        size += step


def label_track(labels: list[str], lengths: list[int]) -> str:
    """Labels over stretches of the given lengths, each between bars; one that doesn't fit is cut."""
    out = []
    for text, n in zip(labels, lengths, strict=True):
        out.append("" if n <= 0 else "│" if n == 1 else "┌" + text[: n - 2].center(n - 2, "─") + "┐")
    return "".join(out)


def fuzzy_search(patterns: list[str]):
    """A UDF: whether a text holds a match of any pattern, which may allow errors as in `(?:ACGT){e<=1}`; case doesn't count."""
    @F.pandas_udf(BooleanType())
    def search(text: pd.Series) -> pd.Series:
        import regex

        compiled = regex.compile("|".join(patterns), flags=regex.IGNORECASE | regex.ENHANCEMATCH)
        return text.map(lambda t: t is not None and compiled.search(t) is not None).astype(bool)

    return search


_COUNTS = _struct(substitutions=_INT, insertions=_INT, deletions=_INT)


@F.pandas_udf(_COUNTS)
def error_counts(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Substitutions, insertions and deletions of the best match of the first text, as a pattern, at the start of the second."""
    import regex

    def one(a: str, b: str) -> tuple:
        return (None,) * 3 if a is None or b is None else regex.match(f"(?:{a}){{e}}", b, flags=regex.BESTMATCH | regex.IGNORECASE).fuzzy_counts

    return pd.DataFrame([one(a, b) for a, b in zip(first, second, strict=True)], columns=_COUNTS.names)


def identity(first: str, second: str, least: float = 0.8) -> float:
    """1 less the errors of the shorter text against the longer one, as a pattern with IUPAC letters, over the longer one's length; 0 with more errors
    than `least` allows. Of equally long texts the one with the longer pattern is the pattern."""
    import regex

    from strandloom.functions.sequence import class_pattern
    from strandloom.functions.words import fuzzy_pattern

    if len(first) == len(second):
        shorter, longer = (first, second) if len(class_pattern(first)) < len(class_pattern(second)) else (second, first)
    else:
        shorter, longer = sorted((first, second), key=len)
    if not longer:
        return 0.0
    pattern = fuzzy_pattern(longer, None, None, None, int(len(longer) * max(0, min(1, 1 - least))))
    m = regex.match(pattern, shorter, flags=regex.IGNORECASE | regex.BESTMATCH)
    return (len(longer) - sum(m.fuzzy_counts)) / len(longer) if m else 0.0


@F.pandas_udf(DoubleType())
def percent_identity(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else identity(a, b) for a, b in zip(first, second, strict=True)], dtype=float)


def match_cigar(text: str, pattern: str, errors: int, specific: bool = False, abbreviated: bool = False) -> str | None:
    """The cigar of the best match of an IUPAC pattern in a text, with up to so many errors, from its own traceback over the matched letters;
    None without a match."""
    import regex

    from strandloom.functions.sequence import class_pattern

    m = regex.search(f"(?:{class_pattern(pattern)}){{e<={errors}}}", text, flags=regex.IGNORECASE | regex.BESTMATCH)
    if m is None:
        return None
    a, b = pattern, m[0]
    fits = lambda x, y: y.upper() in IUPAC.get(x.upper(), x) or x == "."
    cost = [[(i + j, "D" if i else "I") for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = fits(a[i - 1], b[j - 1])
            cost[i][j] = min((cost[i - 1][j - 1][0] + (not same), "=" if same else "X"), (cost[i - 1][j][0] + 1, "D"), (cost[i][j - 1][0] + 1, "I"), key=lambda x: x[0])
    i, j, steps = len(a), len(b), ""
    while i or j:
        step = cost[i][j][1]
        steps = (step if specific or step in "DI" else "M") + steps
        i, j = i - (step in "=XD"), j - (step in "=XI")
    runs = [(len(list(g)), k) for k, g in itertools.groupby(steps)]
    return "".join(("" if abbreviated and n == 1 else str(n)) + k for n, k in runs)


def label_rows(labels: list[str], lengths: list[int], names: list[str], rows: list[str]) -> str:
    """A track of labels over named rows of letters."""
    width = max((len(n) for n in names), default=0)
    return "\n".join([" " * (width + 1) + label_track(labels, lengths), *(f"{n:>{width}} {r}" for n, r in zip(names, rows, strict=True))])


def donor_tracks(upstream: str, insert: str, downstream: str, targets: list[tuple[str, int]]) -> str:
    """A donor's arms and insert as a track, its letters, and the targets on it, each at its place."""
    whole = upstream + insert + downstream
    track = label_track(["us", "insert", "ds"], [len(upstream), len(insert), len(downstream)])
    return "\n".join([track, whole, *(" " * at + text for text, at in targets)])
