"""In-silico recombination: donors replace what lies between their arms, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.windows import cut, windows
from strandloom.session import materialise


def flank_pairs(hits: DataFrame, donors: DataFrame, edge: int = 3, most_expect: float = 1e-3, least_length: int = 35) -> DataFrame:
    """(donor, contig, l, r): the one hit at each edge of a donor on a contig; pairs with more or fewer are left out.

    hits: (query, subject, q_start, q_end, s_start, s_end, evalue, length); donors: (donor, seq).
    """
    good = hits.where((F.col("evalue") <= most_expect) & (F.col("length") >= least_length)).join(donors.select(F.col("donor").alias("query"), F.length("seq").alias("n")), "query")
    left = F.col("q_start") < edge
    right = ~left & (F.col("q_end") > F.col("n") - edge)
    hit = F.struct("q_start", "q_end", "s_start", "s_end")
    both = good.groupBy(F.col("query").alias("donor"), F.col("subject").alias("contig")).agg(
        F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.max(F.when(left, hit)).alias("l"), F.max(F.when(right, hit)).alias("r"),
    )
    return both.where("nl = 1 and nr = 1").select("donor", "contig", "l", "r")


def whole_hits(hits: DataFrame, donors: DataFrame, edge: int = 3) -> DataFrame:
    """(query, subject, q_start, q_end): the one hit that reaches both edges of a donor on a contig; pairs with more are left out."""
    full = hits.join(donors.select(F.col("donor").alias("query"), F.length("seq").alias("n")), "query").where((F.col("q_start") < edge) & (F.col("q_end") > F.col("n") - edge))
    one = full.groupBy("query", "subject").agg(F.min("q_start").alias("q_start"), F.min("q_end").alias("q_end"), F.count("*").alias("k"))
    return one.where("k = 1").drop("k")


def edits(pairs: DataFrame, donors: DataFrame) -> DataFrame:
    """(contig, donor, start, end, insert): what each donor takes out of the contig and puts in."""
    insert = F.expr("substring(seq, l.q_end + 1, greatest(r.q_start - l.q_end, 0))")
    return pairs.join(donors, "donor").select("contig", "donor", F.col("l.s_end").alias("start"), F.greatest(F.col("r.s_start"), F.col("l.s_end")).alias("end"), insert.alias("insert"))


def apply_edits(contigs: DataFrame, changes: DataFrame) -> DataFrame:
    """contigs (contig, seq) with the changes made and their names added; of overlapping changes the leftmost counts."""
    change = F.struct("start", "end", "insert", "donor")
    per = changes.groupBy("contig").agg(F.array_sort(F.collect_list(change)).alias("changes"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit("").alias("names"))

    def step(s, c):
        fits = c["start"] >= s["at"]
        piece = F.concat(s["out"], F.substring(F.col("seq"), s["at"] + 1, c["start"] - s["at"]), c["insert"])
        return F.struct(F.when(fits, c["end"]).otherwise(s["at"]).alias("at"), F.when(fits, piece).otherwise(s["out"]).alias("out"), F.when(fits, F.concat(s["names"], F.lit("-"), c["donor"])).otherwise(s["names"]).alias("names"))

    done = F.aggregate("changes", start, step)
    rows = contigs.join(per, "contig", "left").withColumn("done", F.when(F.col("changes").isNotNull(), done))
    seq = F.when(F.col("done").isNull(), F.col("seq")).otherwise(F.concat(F.col("done.out"), F.expr("substring(seq, done.at + 1)")))
    return rows.select(F.concat("contig", F.coalesce(F.col("done.names"), F.lit(""))).alias("contig"), seq.alias("seq"))


def exact_arms(contigs: DataFrame, donors: DataFrame, arm: int = 35) -> DataFrame:
    """Hits of both arms of each donor by equality of their outer `arm` letters, extended inwards as far as they match, on the plus strand."""
    n = F.length("seq")
    d = donors.where(n >= 2 * arm)
    ends = d.select("donor", F.col("seq").alias("dseq"), F.lit(True).alias("left"), F.left("seq", F.lit(arm)).alias("key")).unionByName(d.select("donor", F.col("seq").alias("dseq"), F.lit(False).alias("left"), F.right("seq", F.lit(arm)).alias("key")))
    w = windows(contigs.select("contig", "seq"), arm).withColumnRenamed("window", "key")
    met = w.join(ends, "key").join(contigs.select("contig", "seq"), "contig")  # a donor's arms have few hits
    fwd = S.matching_prefix(F.col("dseq"), cut(F.col("seq"), F.col("i"), F.length("dseq")))
    back_from = cut(F.col("seq"), F.greatest(F.col("i") + arm - F.length("dseq"), F.lit(0)), F.least(F.length("dseq"), F.col("i") + arm))
    back = S.matching_suffix(F.col("dseq"), back_from)
    size, m = F.when(F.col("left"), fwd).otherwise(back), F.length("dseq")
    q0 = F.when(F.col("left"), 0).otherwise(m - size)
    s0 = F.when(F.col("left"), F.col("i")).otherwise(F.col("i") + arm - size)
    return met.select(F.col("donor").alias("query"), F.col("contig").alias("subject"), q0.alias("q_start"), (q0 + size).alias("q_end"), s0.alias("s_start"), (s0 + size).alias("s_end"), F.lit(0.0).alias("evalue"), size.alias("length"))


def recombine(contigs: DataFrame, rounds: list[DataFrame], arm: int = 35) -> list[DataFrame]:
    """The contigs before the first round and after each one. Rounds follow each other; each is written to the shared folder."""
    out = [contigs]
    for donors in rounds:
        pairs = flank_pairs(exact_arms(out[-1], donors, arm), donors, least_length=arm)
        out.append(materialise(apply_edits(out[-1], edits(pairs, donors)), "round"))
    return out
