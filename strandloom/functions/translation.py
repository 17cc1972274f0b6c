"""Codons to amino acids, by any genetic code."""

from __future__ import annotations

from pyspark.sql import functions as F

# The standard genetic code, codons in the order T, C, A, G of each base.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(seq, code: str = STANDARD_CODE):
    """Amino acids of one frame; a codon with a letter other than A, C, G, T is X; a last part of a codon is left out."""
    acids = F.create_map(*(F.lit(x) for i, a in enumerate(code) for x in ("TCAG"[i // 16] + "TCAG"[i // 4 % 4] + "TCAG"[i % 4], a)))
    codons = F.regexp_extract_all(seq, F.lit("..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(acids, c), F.lit("X"))), "")
