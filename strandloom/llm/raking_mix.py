"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Topics are learned from the corpus, or taken from a column. Learned topics have an anchor each: the words of four letters or more that most
documents hold, among those that at most an eighth and at least a 200th of all documents hold, as others tell no topic. A document's
topic is the anchor that it holds most often; one without anchors is of topic 'other'.

Token counts of the cells (source, language, topic) are raked in turn to target marginals: each sweep scales the cells of
every source, then of every language, then of every topic to its target, until all marginals are met or MOST_SWEEPS are done, as targets may
contradict each other where cells are empty. A document's sampling probability is its
cell's ratio r of raked weight to observed tokens times a factor f, at most 1. f is the one at which the expected tokens of the
sample are the share `keep` of all: so cells keep their calibrated odds to each other, and a cell whose target is more than it has is
taken whole. A document is drawn if a hash of its id, as a number in [0, 1), is under its probability.

Targets are tempered: a value's share is its observed share to the power `temper`, normalised. Cells are few next to
documents; they are written after every few sweeps, so plans stay short. As cells taken whole can't grow, the sample's expected marginals
differ from the targets there; marginals() reports both.

Defined results: null sources and languages are values of their own, '(none)'; a null or empty text has no tokens,
its cell's probability applies, and a cell without tokens has probability 0; rows that repeat an id share its draw; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.sequence import let
from strandloom.session import drop_tables, materialise

#: Columns of the cells, in the order of raking.
SIDES = ("source", "lang", "topic")
TEMPER, KEEP = 0.7, 0.5
#: Sweeps until cells are written and looked at, sweeps at most, and how near to their targets all marginals must be.
SWEEPS_A_JOB, MOST_SWEEPS, NEAR = 6, 24, 1e-12
#: Learned topics; an anchor is in a share of the documents between these (one in so many), and has so many letters at least.
TOPICS, RARE, MOST_RARE, LETTERS = 12, 8, 200, 4
#: Words are first counted in so many groups.
GROUPS = 1 << 18
OTHER = "other"
#: Up to this many cells are a broadcast, of some 2 MB; more are joined by shuffle, each in so many parts.
BROADCAST_CELLS, PARTS = 20_000, 64


def tokens(text: Column) -> Column:
    """Words by single spaces, in which a run of n spaces counts as n."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def learn_topics(df: DataFrame, text: str = "text", topics: int = TOPICS) -> list[str]:
    """The anchors, most frequent first; ties go to the word that sorts first. A word can't be in more documents than all words of its group stand in all
    texts, so words are counted by themselves only in groups that reach an anchor's least count; groups are at most GROUPS rows."""
    n = df.count()
    group = F.pmod(F.xxhash64("w"), F.lit(GROUPS)).cast("int")
    words = lambda own: df.select(F.explode(own).alias("w")).where(F.length("w") >= LETTERS).withColumn("g", group)
    split = F.split(df[text], " ")
    heavy = materialise(words(split).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") * MOST_RARE >= n).select("g"), "groups")
    often = words(F.array_distinct(split)).join(F.broadcast(heavy), "g", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    found = often.where((F.col("n") * RARE <= n) & (F.col("n") * MOST_RARE >= n)).orderBy(F.desc("n"), "w").limit(topics).collect()
    drop_tables(heavy)
    return [r.w for r in found]


def topic(text: Column, words: list[str]) -> Column:
    """The word that the text holds most often between spaces, the first of equals; 'other' without any."""
    order = F.create_map(*(F.lit(x) for i, w in enumerate(words) for x in (w, i)))

    def best(own: Column) -> Column:
        often = lambda w: F.struct((-F.size(F.filter(own, lambda x: x == w))).alias("n"), F.try_element_at(order, w).alias("k"), w.alias("w"))
        return F.array_min(F.transform(F.array_intersect(own, F.array(*(F.lit(w) for w in words))), often))["w"]

    return F.coalesce(let(F.split(F.coalesce(text, F.lit("")), " "), best), F.lit(OTHER))


def unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sides(df: DataFrame, anchors: list[str], key: str, text: str, topic_column: str | None) -> tuple[DataFrame, dict[str, str]]:
    """df with the cell of each row in added columns, and their names."""
    name = {s: unused(df, f"__{s}") for s in (*SIDES, "tokens")}
    value = lambda c: F.coalesce(df[c].cast("string"), F.lit("(none)"))
    out = df.withColumns({name["source"]: value("source"), name["lang"]: value("lang"), name["tokens"]: tokens(df[text])})
    if topic_column:
        return out.withColumn(name["topic"], value(topic_column)), name
    return out.withColumn(name["topic"], topic(df[text], anchors) if anchors else F.lit(OTHER)), name


def rake(cells: DataFrame, temper: float = TEMPER, most_sweeps: int = MOST_SWEEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) with target shares t_<side>, raked weight w and ratio r = w / tokens."""
    cells = cells.where("tokens > 0").withColumn("tokens", F.col("tokens").cast("double"))
    each = cells.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("value"), "tokens") for s in SIDES))).alias("x")).select("x.*")
    sums = each.groupBy("side", "value").agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("p")).groupBy("side").agg(F.sum("p").alias("p")).collect()
    whole = {r.side: r.p for r in sums}  # three numbers
    over = {s: Window.partitionBy(s) for s in SIDES}
    w = cells.withColumns({f"t_{s}": F.pow(F.sum("tokens").over(over[s]), F.lit(temper)) / F.lit(whole.get(s, 1.0)) for s in SIDES}).withColumn("w", F.col("tokens"))
    for done in range(1, most_sweeps + 1):
        for s in SIDES:
            w = w.withColumn("w", F.col("w") * F.col(f"t_{s}") / F.sum("w").over(over[s]))
        if done % SWEEPS_A_JOB == 0 or done == most_sweeps:
            w = materialise(w, "raked")
            off = [w.groupBy(s).agg((F.sum("w") / F.min(f"t_{s}") - 1).alias("x")).agg(F.max(F.abs("x")).alias("x")) for s in SIDES[:-1]]
            if all((x.first().x or 0.0) <= NEAR for x in off):
                break
    return w.withColumn("r", F.col("w") / F.col("tokens"))


def probabilities(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, probability) of the cells. The factor starts as if no cell were taken whole; cells whose ratio times the factor
    reaches 1 are, and the others share what is left, until no more cells are. It only grows, so this ends."""
    factor, taken = 0.0, -1
    while True:
        full = F.col("r") * factor >= 1
        x = raked.agg(F.count_if(full).alias("n"), F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens"))).alias("t"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if x.n == taken or not x.w:
            break
        factor, taken = max(factor, (keep * x["all"] - (x.t or 0.0)) / x.w), x.n
    return raked.select(*SIDES, F.round(F.least(F.col("r") * factor, F.lit(1.0)), 9).alias("probability"))


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", temper: float = TEMPER, keep: float = KEEP, topics: int = TOPICS,
    topic_column: str | None = None, keep_all_columns: bool = False,
) -> DataFrame:
    """(key, source, lang, topic, n_tokens, probability, sampled) for each row; keep_all_columns: df's sampled rows instead."""
    anchors = [] if topic_column else learn_topics(df, text, topics)
    rows, name = sides(df, anchors, key, text, topic_column)
    cells = materialise(rows.groupBy(*(F.col(name[s]).alias(s) for s in SIDES)).agg(F.sum(name["tokens"]).alias("tokens")), "cells")
    chance, drawn, part = (unused(rows, x) for x in ("__probability", "__drawn", "__part"))
    odds = probabilities(rake(cells, temper), keep).select(*(F.col(s).alias(name[s]) for s in SIDES), F.col("probability").alias(chance))
    odds = materialise(odds, "odds")
    on = [name[s] for s in SIDES]
    if odds.count() <= BROADCAST_CELLS:
        out = rows.join(F.broadcast(odds), on, "left")
    else:
        # a large cell's rows are dealt to many tasks
        salted = odds.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        out = rows.withColumn(part, F.pmod(F.xxhash64(key, F.length(text)), F.lit(PARTS)).cast("int")).join(salted.hint("merge"), [*on, part], "left")
    out = out.withColumn(chance, F.coalesce(chance, F.lit(0.0))).withColumn(drawn, draw(F.col(key)) < F.col(chance))
    if keep_all_columns:
        return out.where(drawn).select(*df.columns)
    return out.select(key, *(F.col(name[s]).alias(s) for s in SIDES), F.col(name["tokens"]).alias("n_tokens"), F.col(chance).alias("probability"), F.col(drawn).alias("sampled"))


def marginals(mixed: DataFrame, temper: float = TEMPER) -> DataFrame:
    """(side, value, observed, target, expected): shares of the tokens of each source, language and topic in mix()'s rows: of all, as aimed at,
    and in the sample on average."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in SIDES))).alias("x")
    sums = mixed.select(each, F.col("n_tokens").cast("double").alias("n"), (F.col("n_tokens") * F.col("probability")).alias("e"))
    sums = sums.groupBy("x.side", "x.value").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).where("n > 0")
    whole = sums.groupBy("side").agg(F.sum("n").alias("all_n"), F.sum(F.pow("n", F.lit(temper))).alias("all_t"), F.sum("e").alias("all_e"))  # three rows
    return sums.join(F.broadcast(whole), "side").select("side", "value", (F.col("n") / F.col("all_n")).alias("observed"), (F.pow("n", F.lit(temper)) / F.col("all_t")).alias("target"), (F.col("e") / F.col("all_e")).alias("expected"))
