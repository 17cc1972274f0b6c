"""Text formats as expressions, written by Spark's own text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import positions


def wrapped(seq: Column, columns: int = 80) -> Column:
    """seq in lines of so many letters."""
    return F.regexp_replace(F.regexp_replace(seq, "(.{%d})" % columns, "$1\n"), "\n$", "")


def fasta_text(name: Column, seq: Column, info: Column | None = None, columns: int = 80) -> Column:
    head = F.concat(F.lit(">"), name) if info is None else F.concat(F.lit(">"), name, F.when(F.length(info) > 0, F.concat(F.lit(" "), info)).otherwise(""))
    return F.concat(head, F.lit("\n"), wrapped(seq, columns))


def fastq_text(name: Column, seq: Column, quality: str = "I") -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit(quality), F.length(seq)))


def location_text(feature: Column, contig: Column, strand: Column, start: Column, end: Column, sep: str = ":") -> Column:
    return F.concat_ws(sep, feature, contig, strand, F.concat(start.cast("string"), F.lit(".."), end.cast("string")))


def target_text(spacer: Column, pam: Column, side: Column) -> Column:
    return F.when(side == ">", F.concat(spacer, F.lit(">"), pam)).otherwise(F.concat(pam, F.lit("<"), spacer))


def origin_text(seq: Column) -> Column:
    """GenBank sequence lines: a number, then six groups of ten letters."""
    def line(i: Column) -> Column:
        part = F.substring(seq, i + 1, F.lit(60))
        groups = F.transform(F.filter(positions(F.lit(0), F.lit(5)), lambda k: k * 10 < F.length(part)), lambda k: F.substring(part, k * 10 + 1, F.lit(10)))
        return F.concat(F.lpad((i + 1).cast("string"), 9, " "), F.lit(" "), F.array_join(groups, " "))

    return F.array_join(F.transform(F.filter(positions(F.lit(0), F.length(seq) - 1), lambda i: i % 60 == 0), line), "\n")


def genbank_text(name: Column, seq: Column, annotations: Column, date: str = "01-JAN-2000") -> Column:
    """A GenBank record; annotations is an array of (type, start, end, strand, label), 0-based half-open."""
    head = F.concat(F.lit("LOCUS       "), F.rpad(name, 16, " "), F.lit(" "), F.lpad(F.length(seq).cast("string"), 11, " "), F.lit(f" bp    DNA     linear   UNK {date}\n"))

    def feature(a: Column) -> Column:
        span = F.concat((a["start"] + 1).cast("string"), F.lit(".."), a["end"].cast("string"))
        place = F.when(a["strand"] == "-", F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
        return F.concat(F.lit("     "), F.rpad(a["type"], 16, " "), place, F.lit('\n                     /label="'), a["label"], F.lit('"\n'))

    body = F.array_join(F.transform(annotations, feature), "")
    return F.concat(head, F.lit("FEATURES             Location/Qualifiers\n"), body, F.lit("ORIGIN\n"), origin_text(seq), F.lit("\n//"))


def write_text(df: DataFrame, text: Column, path: str) -> None:
    df.select(text.alias("value")).write.text(path)


def scored_spacer_text(name: Column, spacer: Column, pam: Column, fields: dict[str, Column]) -> Column:
    """A FASTA record of a spacer whose header tells motif, counts, scores, weight and rank, whatever is given, and the PAM."""
    said = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit(">"), F.concat_ws(" ", name, *said, F.concat(F.lit("pam="), pam)), F.lit("\n"), spacer)


def donor_place_text(feature: Column, contig: Column, strand: Column, segments: Column, sep: str = ":") -> Column:
    """feature:contig:strand:start..end:insert:start..end; segments is an array of the parts' texts."""
    return F.concat_ws(sep, feature, contig, strand, segments)


def donor_text(name: Column, seq: Column, spacers: Column, places: Column, fields: dict[str, Column] | None = None) -> Column:
    """A FASTA record of a donor: number of spacers, other fields as far as they are known, and its places in order."""
    said = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in (fields or {}).items()]
    return F.concat(F.lit(">"), F.concat_ws(" ", name, F.concat(F.lit("spacers="), spacers.cast("string")), *said, F.array_sort(places)), F.lit("\n"), seq)


def alignment_text(name: Column, rows: Column, marks: Column, consensus: Column) -> Column:
    """A multiple alignment as text: its rows (name, seq), then marks of conservation and the consensus below them, all behind names of one width."""
    width = F.array_max(F.transform(rows, lambda r: F.length(r["name"])))
    line = lambda n, t: F.concat(F.rpad(n, width, " "), F.lit(" "), t)
    return F.concat(name, F.lit("\n"), F.array_join(F.transform(rows, lambda r: line(r["name"], r["seq"])), "\n"), F.lit("\n"), line(F.lit(""), marks), F.lit("\n"), line(F.lit(""), consensus))
