"""Nearest-neighbour thermodynamics of DNA duplexes (unified parameters, SantaLucia 1998) as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import sequence as S

# Enthalpy (kcal/mol) and entropy (cal/mol/K) of neighbouring pairs; the reverse complement has the same.
STACKS = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
}
END_GC, END_AT, SYMMETRY, GAS = (0.1, -2.8), (2.3, 4.1), (0.0, -1.4), 1.987


def _adder(table: Column):
    return lambda total, pair: total + F.try_element_at(table, pair)


def duplex(seq: Column, sodium: float = 0.05, concentration: float = 2.5e-7, temperature: float = 25.0) -> Column:
    """(dh, ds, dg, tm) of a sequence with its perfect complement. Letters other than A, C, G, T give null."""
    up = F.upper(seq)
    turn = str.maketrans("ACGT", "TGCA")
    both = STACKS | {k.translate(turn)[::-1]: v for k, v in STACKS.items()}
    steps = F.transform(S.positions(F.lit(1), F.length(up) - 1), lambda i: F.substring(up, i, F.lit(2)))
    tables = [F.create_map(*(F.lit(x) for k, v in sorted(both.items()) for x in (k, v[i]))) for i in (0, 1)]
    ends = [F.left(up, F.lit(1)), F.right(up, F.lit(1))]
    palindrome = S.is_palindrome(seq)
    total = []
    for i in (0, 1):
        x = F.aggregate(steps, F.lit(0.0), _adder(tables[i]))
        for e in ends:
            x = x + F.when(e.isin("G", "C"), END_GC[i]).otherwise(END_AT[i])
        total.append(x + F.when(palindrome, SYMMETRY[i]).otherwise(0.0))
    dh, ds = total[0], total[1] + 0.368 * (F.length(seq) - 1) * math.log(sodium)
    dg = dh - (temperature + 273.15) * ds / 1000
    tm = 1000 * dh / (ds + GAS * F.when(palindrome, math.log(concentration)).otherwise(math.log(concentration / 4))) - 273.15
    return F.struct(dh.alias("dh"), ds.alias("ds"), dg.alias("dg"), tm.alias("tm"))


def dimer_dg(a: Column, b: Column, temperature: float = 25.0, sodium: float = 0.05) -> Column:
    """Lowest free energy of an ungapped run of pairs between a and b; 0 without two neighbouring pairs."""
    x, y = F.upper(a), F.reverse(F.upper(b))
    turn = str.maketrans("ACGT", "TGCA")
    both = STACKS | {k.translate(turn)[::-1]: v for k, v in STACKS.items()}
    energy = {k: h - (temperature + 273.15) * (s + 0.368 * math.log(sodium)) / 1000 for k, (h, s) in both.items()}
    table = F.create_map(*(F.lit(v) for k in sorted(energy) for v in (k, energy[k])))
    start = END_GC[0] - (temperature + 273.15) * END_GC[1] / 1000

    def at_shift(d: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            two = F.substring(x, i, F.lit(2))
            pairs = (i + 1 <= F.length(x)) & (i - d >= 1) & (i - d + 1 <= F.length(y)) & (F.translate(two, "ACGT", "TGCA") == F.substring(y, i - d, F.lit(2)))
            now = F.when(pairs, s["now"] + F.coalesce(F.try_element_at(table, two), F.lit(0.0))).otherwise(0.0)
            return F.struct(now.alias("now"), F.least(s["best"], now).alias("best"))

        return F.aggregate(S.positions(F.lit(1), F.length(x) - 1), F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best")), step, lambda s: s["best"])

    low = F.array_min(F.transform(S.positions(2 - F.length(y), F.length(x) - 2), at_shift))
    return F.when(low < 0, low + 2 * start).otherwise(0.0)
