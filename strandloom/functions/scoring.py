"""Guide scores as Column builders, and the registry that says what each score is for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions.statistics import algorithm_weight, parse_weight

# Mismatch weights of the Hsu-Zhang score, positions 1 to 20.
HSU_ZHANG = [0.0, 0.0, 0.014, 0.0, 0.0, 0.395, 0.317, 0.0, 0.389, 0.079, 0.445, 0.508, 0.613, 0.851, 0.732, 0.828, 0.615, 0.804, 0.685, 0.583]

# PAM factors of the CFD score for the PAM's last two letters.
CFD_PAM = {
    "AA": 0.0, "AC": 0.0, "AG": 0.259259259, "AT": 0.0, "CA": 0.0, "CC": 0.0, "CG": 0.107142857, "CT": 0.0,
    "GA": 0.069444444, "GC": 0.022222222, "GG": 1.0, "GT": 0.016129032, "TA": 0.0, "TC": 0.0, "TG": 0.038961039, "TT": 0.0,
}

# Position weights of the Housden score; rows are positions 1 to 20, columns A, C, G, T.
HOUSDEN = [
    [0.4979, 0.4979, 0.7918, 0.6699], [0.7959, 0.6869, 0.4461, 0.5485], [0.7553, 0.8528, 0.4851, 0.275], [0.6569, 0.7643, 0.4461, 0.5972],
    [0.9481, 0.5325, 0.3417, 0.6212], [0.7147, 0.3417, 0.6869, 0.7555], [0.437, 0.3417, 0.2417, 1.0], [0.6212, 0.7643, 0.5485, 0.5131],
    [0.9077, 0.6434, 0.0947, 0.8608], [1.0, 0.0092, 0.9256, 0.7553], [0.1957, 0.9331, 0.5325, 0.6569], [0.7959, 0.5325, 0.8308, 0.3417],
    [0.6212, 0.7272, 0.1255, 1.0], [0.8912, 0.9708, 0.7918, 0.016], [1.0, 0.2905, 0.2544, 0.9146], [0.5485, 0.7272, 0.4461, 0.7555],
    [0.9942, 0.2957, 0.4979, 0.2906], [0.5485, 0.7918, 0.6212, 0.4979], [0.455, 0.6434, 0.7918, 0.5485], [1.0, 0.5062, 0.4461, 0.5131],
]

# Features of the Doench-2014 score in a 30-letter context: position from 0, letters, weight.
DOENCH_2014 = [
    (1, "G", -0.2753771), (2, "A", -0.3238875), (2, "C", 0.17212887), (3, "C", -0.1006662), (4, "C", -0.2018029), (4, "G", 0.24595663),
    (5, "A", 0.03644004), (5, "C", 0.09837684), (6, "C", -0.7411813), (6, "G", -0.3932644), (11, "A", -0.466099), (14, "A", 0.08537695),
    (14, "C", -0.013814), (15, "A", 0.27262051), (15, "C", -0.1190226), (15, "T", -0.2859442), (16, "A", 0.09745459), (16, "G", -0.1755462),
    (17, "C", -0.3457955), (17, "G", -0.6780964), (18, "A", 0.22508903), (18, "C", -0.5077941), (19, "G", -0.4173736), (19, "T", -0.054307),
    (20, "G", 0.37989937), (20, "T", -0.0907126), (21, "C", 0.05782332), (21, "T", -0.5305673), (22, "T", -0.8770074), (23, "C", -0.8762358),
    (23, "G", 0.27891626), (23, "T", -0.4031022), (24, "A", -0.0773007), (24, "C", 0.28793562), (24, "T", -0.2216372), (27, "G", -0.6890167),
    (27, "T", 0.11787758), (28, "C", -0.1604453), (29, "G", 0.38634258), (1, "GT", -0.6257787), (4, "GC", 0.30004332), (5, "AA", -0.8348362),
    (5, "TA", 0.76062777), (6, "GG", -0.4908167), (11, "GG", -1.5169074), (11, "TA", 0.7092612), (11, "TC", 0.49629861), (11, "TT", -0.5868739),
    (12, "GG", -0.3345637), (13, "GA", 0.76384993), (13, "GC", -0.5370252), (16, "TG", -0.7981461), (18, "GG", -0.6668087), (18, "TC", 0.35318325),
    (19, "CC", 0.74807209), (19, "TG", -0.3672668), (20, "AC", 0.56820913), (20, "CG", 0.32907207), (20, "GA", -0.8364568), (20, "GG", -0.7822076),
    (21, "TC", -1.029693), (22, "CG", 0.85619782), (22, "CT", -0.4632077), (23, "AA", -0.5794924), (23, "AG", 0.64907554), (24, "AG", -0.0773007),
    (24, "CG", 0.28793562), (24, "TG", -0.2216372), (26, "GT", 0.11787758), (28, "GG", -0.69774),
]
DOENCH_2014_BASE, DOENCH_2014_LOW_GC, DOENCH_2014_HIGH_GC = 0.59763615, -0.2026259, -0.1665878

# Features of the CRISPRscan score in a 35-letter context: position from 1, letters, weight.
CRISPRSCAN = [
    (1, "G", -0.029693709), (4, "A", -0.042153521), (4, "G", -0.005448869), (9, "C", 0.002449224), (9, "G", 0.114600681), (10, "G", 0.067739182),
    (11, "A", -0.018287292), (11, "G", 0.020929039), (12, "A", 0.011633235), (12, "G", 0.027591138), (13, "A", 0.017628924), (13, "T", 0.035445171),
    (13, "G", 0.061360905), (13, "C", 0.069495944), (14, "A", -0.018487229), (14, "G", 0.025116714), (15, "A", -0.010595296), (15, "C", -0.000477727),
    (15, "G", 0.051129717), (16, "C", -0.021638609), (16, "G", 0.037970942), (17, "G", 0.01549378), (18, "A", -0.033820432), (18, "G", 0.016457816),
    (19, "A", -0.015576499), (19, "G", 0.017916844), (20, "C", 0.015089514), (20, "G", 0.033957008), (21, "T", -0.068730497), (21, "C", 0.034262921),
    (22, "T", 0.013224035), (22, "A", 0.031930909), (22, "C", 0.03763162), (22, "G", 0.10114438), (23, "T", -0.001422243), (24, "T", -0.011996172),
    (24, "A", 0.037466478), (24, "C", 0.052972314), (24, "G", 0.105488325), (25, "C", -0.031648353), (25, "A", 0.010506405), (26, "C", -0.000368973),
    (26, "G", 0.036146649), (27, "T", -0.000280845), (27, "A", 0.019126815), (27, "C", 0.079933922), (27, "G", 0.085151052), (30, "G", -0.046315914),
    (30, "C", -0.013182733), (30, "T", 0.017263162), (31, "C", -0.030715556), (31, "A", 0.00158975), (32, "A", 0.012435231), (32, "G", 0.03071249),
    (34, "T", -0.017647692), (34, "G", -0.014167123), (35, "A", 0.048596259), (3, "TG", 0.022949996), (3, "GC", 0.024681785), (9, "GG", -0.00157799),
    (9, "GC", 0.054171402), (10, "AA", -0.016905415), (10, "GG", 0.026802158), (10, "AG", 0.063717093), (11, "GT", 0.053678436), (12, "GG", 0.041883009),
    (13, "TT", -0.08618771), (13, "GG", 0.074355848), (15, "TG", 0.053372822), (17, "TT", 0.03492881), (18, "AA", -0.097377097), (18, "TT", -0.094424075),
    (18, "GT", 0.002391744), (18, "TG", 0.045908991), (20, "GA", 0.009740799), (21, "CC", 0.088919601), (23, "TG", -0.066388075), (23, "AG", -0.054338456),
    (23, "CC", 0.095072286), (23, "GT", 0.106718563), (24, "GT", 0.060952114), (24, "CA", 0.06221937), (25, "GC", -0.073453609), (25, "GG", 0.111559441),
    (26, "CT", -0.084264893), (30, "CA", 0.057759851), (31, "GA", -0.01227989), (31, "TG", 0.048136812), (31, "GT", 0.07342535), (34, "AG", -0.041935908),
    (34, "GA", -0.037797707),
]
CRISPRSCAN_BASE = 0.183930943629

# CRISPRater features: first and last position from 1 in the 20-letter spacer, letters, weight; and the offset.
CRISPRATER = [
    (4, 13, "CG", 0.14177385), (20, 20, "G", 0.06966514), (3, 3, "AT", 0.04216254), (12, 12, "AG", 0.03303432), (6, 6, "G", 0.02355430),
    (4, 4, "AT", -0.04746424), (18, 18, "AG", -0.04878001), (5, 5, "AC", -0.06981921), (14, 14, "G", -0.07087756), (15, 15, "A", -0.08160700),
]
CRISPRATER_BASE = 0.6505037


def linear(a: Column, b: Column) -> Column:
    """100 less the share of each differing or overhanging position, later ones weighing more."""
    n = F.greatest(F.length(a), F.length(b))
    differ = F.filter(S.positions(F.lit(1), n), lambda i: (i > F.least(F.length(a), F.length(b))) | (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    lost = F.aggregate(differ, F.lit(0).cast("long"), lambda s, i: s + i)
    return F.when(n == 0, 100.0).otherwise(100.0 - 100.0 * lost / (n * (n + 1) / 2))


def hsu_zhang(a: Column, b: Column) -> Column:
    """Mismatch score of the last 20 letters, right-aligned: weights, mean distance of mismatches, and their number."""
    a, b = F.right(a, F.lit(20)), F.right(b, F.lit(20))
    n = F.least(F.length(a), F.length(b))
    places = S.mismatch_positions(F.right(a, n), F.right(b, n))
    table = F.array(*(F.lit(1 - w) for w in HSU_ZHANG))
    one = F.aggregate(places, F.lit(1.0), lambda s, i: s * F.element_at(table, i - n - 1))
    k = F.size(places)
    mean = (F.element_at(places, -1) - F.element_at(places, 1)) / (k - 1)
    two = F.when(k < 2, 1.0).otherwise(1 / ((19 - mean) / 19.0 * 4 + 1))
    return one * two * F.when(k == 0, 1.0).otherwise(1 / (k * k).cast("double")) * 100


def cfd(on: Column, off: Column, pam: Column, mismatch: dict[str, float]) -> Column:
    """CFD as the program computes it: only mismatches of U in the guide count, under the intended PAM. mismatch has
    keys such as 'rU:dC,20' and is read from a file. Letters other than A, C, G, T, or a PAM of another kind, give 0."""
    a, b = (F.upper(F.right(x, F.lit(20))) for x in (on, off))
    n = F.least(F.length(a), F.length(b))
    a, b = F.right(a, n), F.right(b, n)
    table = F.create_map(*(F.lit(x) for k, v in sorted(mismatch.items()) for x in (k, float(v))))
    factor = lambda i: F.try_element_at(table, F.concat(F.lit("rU:d"), S.reverse_complement(F.substring(b, i, F.lit(1))), F.lit(","), (i + 20 - n).cast("string")))
    hit = F.filter(S.mismatch_positions(a, b), lambda i: F.substring(a, i, F.lit(1)) == "T")
    pams = F.create_map(*(F.lit(x) for k, v in CFD_PAM.items() for x in (k, v)))
    p = F.coalesce(F.try_element_at(pams, F.upper(F.right(pam, F.lit(2)))), F.lit(0.0))
    plain = ~S.is_ambiguous(on) & ~S.is_ambiguous(off)
    return F.when(plain, F.aggregate(hit, F.lit(1.0), lambda s, i: s * factor(i)) * p * 100).otherwise(0.0)


def housden(seq: Column) -> Column:
    """-log10 of the product of position weights of the last 20 letters; 0 with any ambiguous letter."""
    s = F.upper(F.right(seq, F.lit(20)))
    n = F.length(s)
    table = F.array(*(F.lit(w) for row in HOUSDEN for w in row))
    weight = lambda i: F.element_at(table, (i + 20 - n - 1) * 4 + F.instr(F.lit("ACGT"), F.substring(s, i, F.lit(1))))
    whole = F.aggregate(F.transform(S.positions(F.lit(1), n), weight), F.lit(1.0), lambda a, b: a * b)
    return F.when(S.is_ambiguous(s), 0.0).otherwise(-F.log10(whole))


def context(seq: Column, pam: Column, upstream: Column, downstream: Column, before: int, total: int, missing: str) -> Column:
    """`total` letters around the start of the PAM, which stands at `before`; what isn't known is `missing`."""
    left = F.right(F.concat(F.lit(missing * before), upstream, seq), F.lit(before))
    return F.left(F.concat(left, pam, downstream, F.lit(missing * total)), F.lit(total))


def _feature_sum(text: Column, features: list[tuple[int, str, float]], base: int) -> Column:
    """Sum of the weights of the features that the text has, in the features' order."""
    rows = F.array(*(F.struct(F.lit(p - base + 1).alias("p"), F.lit(m).alias("m"), F.lit(float(w)).alias("w")) for p, m, w in features))
    return F.aggregate(F.filter(rows, lambda r: F.substring(text, r["p"], F.length(r["m"])) == r["m"]), F.lit(0.0), lambda s, r: s + r["w"])


def doench_2014(seq: Column, pam: Column, upstream: Column, downstream: Column) -> Column:
    text = context(seq, pam, upstream, downstream, 24, 30, "-")
    gc = S.count_letters(F.substring(text, 5, 20), "GC")
    penalty = F.abs(10 - gc) * F.when(gc <= 10, DOENCH_2014_LOW_GC).otherwise(DOENCH_2014_HIGH_GC)
    return 100 / (1 + F.exp(-(DOENCH_2014_BASE + penalty + _feature_sum(text, DOENCH_2014, 0))))


def crisprscan(seq: Column, pam: Column, upstream: Column, downstream: Column) -> Column:
    text = context(seq, pam, upstream, downstream, 26, 35, "-")
    return 100 * (CRISPRSCAN_BASE + _feature_sum(text, CRISPRSCAN, 1))


def crisprater(upstream: Column, seq: Column) -> Column:
    text = F.right(F.concat(F.lit("N" * 20), upstream, seq), F.lit(20))
    out = F.lit(CRISPRATER_BASE)
    for first, last, bases, w in CRISPRATER:
        out = out + S.base_frequency(F.substring(text, first, last - first + 1), bases) * w
    return out * 100


def azimuth_query(seq: Column, pam: Column, upstream: Column, downstream: Column) -> Column:
    """The 30 letters that the model takes."""
    return context(seq, pam, upstream, downstream, 24, 30, "N")


def cpf1_query(spacer: Column, pam: Column, upstream: Column, downstream: Column) -> Column:
    """The 34 letters that the model takes: 8 up to the end of the PAM, then the spacer."""
    left = F.right(F.concat(F.lit("N" * 8), upstream, pam), F.lit(8))
    return F.left(F.concat(left, spacer, downstream, F.lit("N" * 34)), F.lit(34))


def position_percent(start: Column, feature_start: Column, feature_end: Column, strand: Column) -> Column:
    """How far along a feature a place is, in the feature's own direction."""
    share = (start - feature_start) / (feature_end - feature_start) * 100
    return F.when(strand == "-", 100 - share).otherwise(share)


@dataclass(frozen=True)
class Score:
    """kind: single, paired or batched; roles: prefilter, postfilter, on, off; the range that passes; default; weight."""

    name: str
    kind: str
    roles: tuple[str, ...]
    least: float
    most: float
    default: float | None = None
    weight: str = ""


REGISTRY = [
    Score("GC", "single", ("prefilter",), 25, 75),
    Score("PolyT", "single", ("prefilter",), 0, 4.5),
    Score("Homopolymer", "single", ("prefilter",), 0, 4.5),
    Score("ProximalG", "single", ("prefilter",), 0, 1),
    Score("PAM-Identity", "single", ("postfilter",), 75, 100),
    Score("Housden", "single", ("on", "off"), 0, 13),
    Score("Doench-2014", "single", ("on", "off"), 1, 100),
    Score("Moreno-Mateos", "single", ("on", "off"), 1, 100),
    Score("CRISPRater", "single", ("on", "off"), 1, 100, 100, "66+1.22"),
    Score("Substitutions", "paired", ("postfilter",), 0, 5, 0),
    Score("Insertions", "paired", ("postfilter",), 0, 2, 0),
    Score("Deletions", "paired", ("postfilter",), 0, 2, 0),
    Score("Errors", "paired", ("postfilter",), 0, 5, 0),
    Score("CFD", "paired", ("off",), 1, 100, 100, "40+1.2"),
    Score("Hsu-Zhang", "paired", ("off",), 0.1, 100, 100, "90+1.8"),
    Score("Linear", "paired", ("off",), 75, 100, 100),
    Score("Azimuth", "batched", ("on",), 1, 100, None, "52+1.17"),
    Score("DeepCpf1", "batched", ("on",), 1, 150, None, "60+1.08"),
]


def registered_weight(name: str, x: Column) -> Column:
    return algorithm_weight(x, parse_weight(next(s.weight for s in REGISTRY if s.name == name)))
