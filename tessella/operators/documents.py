"""Reports as ordered lines: tables, lists and headings rendered where their rows are.

A report is a list of sections. Every section gives rows of (place in the section, line); a line's place in
the report is (section, place), so a report of any length is written in order without passing one task,
and read back by file name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.canonical import round_half_even

LINES = "section int, place bigint, line string"


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, rounded on its exact binary value; '' for null and what isn't finite."""
    v = value.cast("double")
    text = round_half_even(v, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) >= 1e21), "").otherwise(text)


def code(value: Column) -> Column:
    """A value in back quotes."""
    return F.concat(F.lit("`"), F.coalesce(value.cast("string"), F.lit("")), F.lit("`"))


def plain(value: Column, absent: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(absent))


class Section:
    """A heading and what stands under it."""

    def lines(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


class Text(Section):
    """Fixed lines."""

    def __init__(self, *lines: str):
        self.fixed = lines

    def lines(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.fixed)), "place bigint, line string")


class Table(Section):
    """A table under a heading: ``cells`` maps column titles to text Columns over ``rows``, in ``order``, a
    numeric column from 0 on. With ``when_bad`` a row for which it isn't null has that text in its second cell and empty ones
    behind it."""

    def __init__(self, heading: str, rows: DataFrame, order: str, cells: dict[str, Column], when_bad: Column | None = None):
        self.heading, self.rows, self.order, self.cells, self.when_bad = heading, rows, order, cells, when_bad

    def lines(self, spark: SparkSession) -> DataFrame:
        titles = list(self.cells)
        head = [f"## {self.heading}", "", "| " + " | ".join(titles) + " |", "|" + "---|" * len(titles)]
        safe = [F.replace(F.regexp_replace(c, "[\\r\\n]+", " "), F.lit("|"), F.lit("\\|")) for c in self.cells.values()]
        row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        line = row(safe)
        if self.when_bad is not None:
            line = F.when(self.when_bad.isNotNull(), row([safe[0], self.when_bad, *[F.lit("")] * (len(safe) - 2)])).otherwise(line)
        body = self.rows.select((F.col(self.order) + len(head)).cast("long").alias("place"), line.alias("line"))
        tail = spark.createDataFrame([(1 << 62, "")], "place bigint, line string")
        return Text(*head).lines(spark).unionByName(body).unionByName(tail)


class Bullets(Section):
    """A list under a heading, in ``order``."""

    def __init__(self, heading: str, rows: DataFrame, order: str, text: Column):
        self.heading, self.rows, self.order, self.text = heading, rows, order, text

    def lines(self, spark: SparkSession) -> DataFrame:
        body = self.rows.select((F.col(self.order) + 2).cast("long").alias("place"), F.concat(F.lit("- "), self.text).alias("line"))
        tail = spark.createDataFrame([(1 << 62, "")], "place bigint, line string")
        return Text(f"## {self.heading}", "").lines(spark).unionByName(body).unionByName(tail)


def render(spark: SparkSession, sections: Sequence[Section]) -> DataFrame:
    """(section, place, line) of a whole report."""
    parts = [s.lines(spark).select(F.lit(k).cast("int").alias("section"), "place", "line") for k, s in enumerate(sections)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LINES)


def write(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """The lines as text files that give the report when read by name."""
    parts = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "section", "place").sortWithinPartitions("section", "place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


#: Titles and formats of the measures of a gate report: column, decimals.
MEASURES = (
    ("SR", "sample_rate", 0), ("dur (s)", "duration", 2), ("RMS dBFS", "rms_dbfs", 2), ("LUFS", "lufs", 1), ("TP dBTP", "true_peak_dbtp", 1), ("E4-8k%", "band_energy_4k_8k", 3),
    ("E8-12k%", "band_energy_8k_12k", 3), ("flatness", "spectral_flatness", 3), ("crest", "spectral_crest", 1), ("entropy", "spectral_entropy", 3), ("Δ2-9k", "temporal_delta_2k_9k", 3),
)


def gate_report(spark: SparkSession, title: str, facts: Sequence[tuple[str, str]], cases: DataFrame, measures: DataFrame, order: str = "_ord") -> DataFrame:
    """The report of a gate: its facts, a row for each case, and the measures of each sample, or why it has
    none. ``cases`` has backend, kind, output, status, wall_seconds, error, reason; ``measures`` sample, error and the
    columns of MEASURES."""
    note = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.col("reason"), F.lit(""))
    rows = {"Backend": plain(F.col("backend")), "Case": plain(F.col("kind")), "Output": code(F.col("output")), "Status": plain(F.col("status"), "?"), "Wall (s)": fixed(F.col("wall_seconds"), 1), "Notes": note}
    numbers = {"Sample": code(F.col("sample")), **{name: fixed(F.col(c), digits) for name, c, digits in MEASURES}}
    bad = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("error: "), "error"))
    return render(spark, [Text(f"# Gate report — {title}", "", *(f"- {k}: {v}" for k, v in facts), ""), Table("Case results", cases, order, rows), Table("Objective metrics", measures, order, numbers, when_bad=bad)])


def pairs_report(spark: SparkSession, title: str, facts: Sequence[tuple[str, str]], pairs: DataFrame, cases: DataFrame, variance: DataFrame, order: str = "_ord") -> DataFrame:
    """The report of a paired experiment: its pairs with both cells, its cases, and the recordings whose
    earlier ratings differ. ``pairs`` has pair_id, text_id, seed and the case ids ``left`` and ``right``; ``cases`` case_id,
    prompt_id, seed, status, retry_count, duration_s, output_sha256, reused_from; ``variance`` output_sha256, case_ids, divergent."""

    def side(name: str) -> DataFrame:
        tag = F.when(F.col("reused_from").isNotNull(), "reuse").otherwise("new")
        good = F.concat(tag, F.lit(" `"), F.substring("output_sha256", 1, 10), F.lit("` "), plain(F.col("duration_s")), F.lit("s"))
        return cases.select(F.col("case_id").alias(name), F.when(F.col("status") == "ok", good).otherwise(F.col("status")).alias(f"{name}_cell"))

    joined = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    first = {"pair": plain(F.col("pair_id")), "text": plain(F.col("text_id")), "seed": plain(F.col("seed")), "P0 cell": plain(F.col("left_cell"), "None"), "P2 cell": plain(F.col("right_cell"), "None")}
    second = {"case": plain(F.col("case_id")), "prompt": plain(F.col("prompt_id")), "seed": plain(F.col("seed")), "status": plain(F.col("status")), "retry": plain(F.col("retry_count"), "-"), "dur": plain(F.col("duration_s"), "-"), "sha": code(F.substring("output_sha256", 1, 10))}
    differ = F.concat(code(F.substring("output_sha256", 1, 12)), F.lit(": "), F.array_join("case_ids", ", "), F.lit(" differ in "), F.array_join("divergent", ", "))
    return render(spark, [Text(f"# {title}", "", *(f"- {k}: {v}" for k, v in facts), ""), Table("Pairs", joined, order, first), Table("Cases", cases, order, second), Bullets("Context variance", variance, order, differ)])
