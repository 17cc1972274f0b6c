"""Repair templates: parts of a contig around a feature, with an insert between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.windows import cut


def part(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end] from 0; places before the start are left out."""
    low = F.greatest(start, F.lit(0))
    return F.substring(seq, low + 1, F.greatest(end - low, F.lit(0)))


#: Letters of a word that one array of words has at most.
_STEP = 5


def with_words(rows: DataFrame, length: str, name: str) -> DataFrame:
    """A row for each word of A, C, G, T of the length that a column tells. Long words come up in steps, so that no row holds many."""
    digit = lambda i, k: F.substring(F.lit("ACGT"), (F.floor(i / F.pow(F.lit(4), k)) % 4 + 1).cast("int"), F.lit(1))
    word = lambda i, n: F.array_join(F.transform(S.positions(F.lit(1), n), lambda k: digit(i, n - k)), "")
    grown = rows.withColumn(name, F.lit("")).withColumn("__left", F.col(length).cast("int"))
    longest = rows.agg(F.max(length)).first()[0] or 0
    for _ in range(-(-int(longest) // _STEP)):
        now = F.least(F.col("__left"), F.lit(_STEP))
        grown = grown.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4), now).cast("long") - 1)))
        grown = grown.withColumn(name, F.concat(name, word(F.col("__i"), now))).withColumn("__left", F.col("__left") - now).drop("__i")
    return grown.drop("__left")


def centred(features: DataFrame, insert: Column, length: int) -> DataFrame:
    """features (with seq of their contig) with donor, us_start and ds_end: the insert in the middle of `length` letters."""
    n = F.length(insert)
    up = length - F.floor(F.lit(length) / 2) - F.ceil(n / 2)  # letters before: ceil(length / 2) - ceil(n / 2)
    down = F.floor(F.lit(length) / 2) - F.floor(n / 2)
    us, ds = (F.col("start") - up.cast("int")), (F.col("end") + down.cast("int"))
    donor = F.concat(part(F.col("seq"), us, F.col("start")), insert, part(F.col("seq"), F.col("end"), ds))
    return features.withColumns({"us_start": us, "ds_end": ds, "donor": donor})


def mintag(features: DataFrame, up: tuple[int, int], down: tuple[int, int], total: tuple[int, int], inserts: tuple[int, int], trims: tuple[tuple[int, int], tuple[int, int]] = ((0, 0), (0, 0))) -> DataFrame:
    """Every donor with arms, trims and insert lengths in the given ranges, a row for each insert of that length.

    Grows with 4^insert length; negative lengths are refused.
    """
    if inserts[0] < 0:
        raise ValueError("insert lengths go from 0")
    span = lambda r: F.explode(F.sequence(F.lit(r[0]), F.lit(r[1])))
    # what donors can hold of a contig is cut out once for each feature
    base = F.greatest(F.col("start") - (up[1] + trims[0][1]), F.lit(0))
    near = cut(F.col("seq"), base, F.greatest(F.col("end") + down[1] + trims[1][1] - base, F.lit(0)))
    rows = features.withColumns({"__base": base, "__near": near})
    rows = rows.withColumn("us_trim", span(trims[0])).withColumn("ds_trim", span(trims[1])).withColumn("us_hom", span(up)).withColumn("ds_hom", span(down)).withColumn("n", span(inserts))
    rows = with_words(rows.where((F.col("us_hom") + F.col("ds_hom") + F.col("n")).between(*total)), "n", "insert")
    s, e = F.col("start") - F.col("us_trim"), F.col("end") + F.col("ds_trim")
    own = lambda a, b: part(F.col("__near"), a - F.col("__base"), b - F.col("__base"))
    upstream, downstream = own(s - F.col("us_hom"), s), own(e, e + F.col("ds_hom"))
    return rows.withColumns({"donor": F.concat(upstream, "insert", downstream), "up_n": F.length(upstream)}).drop("__base", "__near")


def over_junction(start: Column, end: Column, up: Column, insert: Column) -> Column:
    """Whether a target at [start, end) of a donor touches the insert or the junction."""
    return ~((end < up) | (start >= up + F.length(insert)))


def reversion(features: DataFrame, least: int, most: int, middle: Column | None = None) -> DataFrame:
    """Donors that put a feature back: arms of up to `most` letters, the parts between the derived and the parent feature, and the parent
    feature's own sequence or a replacement. Needs parent_start and parent_end."""
    seq, c = F.col("seq"), F.col
    arm_up = part(seq, F.greatest(c("start") - most, F.lit(0)), c("start"))
    core = middle if middle is not None else part(seq, c("parent_start"), c("parent_end"))
    between = (part(seq, c("start"), c("parent_start")), core, part(seq, c("parent_end"), c("end")))
    return features.withColumn("donor", F.concat(arm_up, *between, part(seq, c("end"), c("end") + most)))


def gap_rank(us_end: Column, ds_start: Column, insert: Column) -> Column:
    """What donors are ranked by: insert length and the gap between the arms."""
    return F.length(insert) + ds_start - us_end


def format_bounds(mode: str, fs: Column, fe: Column, ts: Column, te: Column, pad: int, least: int) -> Column:
    """(start, end) of a feature widened to hold a target, in one of five layouts; then made at least `least` long."""
    reach = F.greatest(te - fs, fe - ts)
    low, high = F.least(fs, ts), F.greatest(te, fe)
    at_feature, at_target = low == fs, low == ts
    if mode == "center_feature":
        s, e = fe - reach - pad, fs + reach + pad
    elif mode == "center_target":
        s, e = te - reach - pad, ts + reach + pad
    elif mode == "center_both":
        s, e = low - pad, high + pad
    else:
        first = at_feature if mode == "justify_feature" else at_target
        s, e = F.when(first, low).otherwise(low - pad), F.when(first, high + pad).otherwise(high)
    short = F.greatest(F.lit(least) - (e - s), F.lit(0))
    if mode.startswith("center"):
        half = F.floor((short + 1) / 2).cast("int")
        return F.struct((s - half).alias("start"), (e + half).alias("end"))
    stays = s == (fs if mode == "justify_feature" else ts)
    # justify_target moves the start inwards, as the program does
    moved = s - short if mode == "justify_feature" else s + short
    return F.struct(F.when(stays, s).otherwise(moved).alias("start"), F.when(stays, e + short).otherwise(e).alias("end"))


def splits(seq: Column, least: int = 1) -> Column:
    """All (left, right) of a donor with both at least so long."""
    cuts = S.positions(F.lit(max(least, 0)), F.length(seq) - least)
    return F.transform(cuts, lambda i: F.struct(F.left(seq, i).alias("left"), F.substring(seq, i + 1, F.length(seq)).alias("right")))


def spanned(donors: DataFrame, motif: str) -> DataFrame:
    """donors (donor, up_n, tag, ...) with t_strand and spacer, a row for each target that spans the whole tag, which starts at up_n.

    Whether one does is told by the tag and what a longer alternative of the motif could take of the letters beside it, so each distinct such
    text is searched once.
    """
    from strandloom.functions.motif import parse
    from strandloom.operators.target_finder import find_targets

    n, up = F.length("tag"), F.col("up_n")
    more = F.greatest(F.lit(parse(motif).longest) - n, F.lit(0))
    off = F.least(up, more)
    made = donors.withColumns({"__off": off, "__n": n, "__text": F.substring("donor", up - off + 1, off + n + more)})
    texts = made.select(F.struct("__text", "__off", "__n").alias("contig"), F.col("__text").alias("seq")).distinct()
    found = find_targets(texts, [motif]).where((F.col("start") == F.col("contig.__off")) & (F.col("end") == F.col("contig.__off") + F.col("contig.__n")))
    return made.join(found.select("contig.*", F.col("strand").alias("t_strand"), "spacer"), ["__text", "__off", "__n"]).drop("__text", "__off", "__n")


def spanning_tag(features: DataFrame, motif: str, length: int, samples: int = 100) -> DataFrame:
    """Donors whose insert is an instance of the motif, kept where a target spans the whole insert. Instances are decided by their number."""
    from strandloom.functions.motif import random_instance
    from strandloom.operators.target_finder import find_targets

    tags = F.explode(F.array(*(F.lit(random_instance(motif, k)) for k in range(samples))))
    made = centred(features.withColumn("tag", tags), F.col("tag"), length)
    made = made.withColumn("up_n", F.length(part(F.col("seq"), F.col("us_start"), F.col("start")))).withColumn("key", F.concat_ws(":", "feature", "tag"))
    found = find_targets(made.select(F.col("key").alias("contig"), F.col("donor").alias("seq")), [motif]).select(F.col("contig").alias("key"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), "spacer")
    return made.join(found, "key").where((F.col("t_start") == F.col("up_n")) & (F.col("t_end") == F.col("up_n") + F.length("tag"))).drop("key", "seq")
