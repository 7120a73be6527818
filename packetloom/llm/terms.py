"""How often every term occurs, in how many records, and which terms are too rare or too common to be useful.

A record's terms are counted inside its own row, so no shuffle is needed to tell occurrences from records; the counts of
terms are combined by hash before the only shuffle and summed after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.plans.staging import stage

#: White space that may stand around a term: ASCII controls and the Unicode spaces. Fixed values.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trimmed(term: Column) -> Column:
    return F.btrim(term, F.lit(SPACES))


#: Fields whose totals are broadcast; of more, Spark chooses the join, and splits a field that holds most terms.
MOST_FIELDS = 100_000


def per_record(records: DataFrame) -> DataFrame:
    """field and counts ARRAY<STRUCT<term, n>> of each record that has terms: a record's terms are sorted and its runs
    counted, so a record of very many terms takes no more than their sorting."""
    clean = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), trimmed), lambda t: t != "")
    some = records.select("field", F.array_sort(clean).alias("t")).where(F.size("t") > 0)
    # columns of their own: inside a function of elements an expression would be computed for each of them
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = some.select("field", "t", starts.alias("s"))
    return runs.select("field", F.transform("s", lambda p, j: F.struct(F.get("t", p).alias("term"), (F.coalesce(F.get("s", j + 1), F.size("t")) - p).alias("n"))).alias("counts"))


def term_counts(records: DataFrame) -> DataFrame:
    """field, term, n_occurrences, n_records, n_with_terms (records of the field that have any term).

    records has field STRING, terms ARRAY<STRING>, one row a record. White space around a term doesn't count, letter
    case does; null and blank terms are none. Null or empty lists have no term; a null field is none.
    """
    # a mark of each record goes along, so that terms and records are counted by one scan and one shuffle
    marked = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("n"))), F.col("counts"))
    summed = per_record(records.where(F.col("field").isNotNull())).select("field", F.explode(marked).alias("x")).groupBy("field", "x.term").agg(F.sum("x.n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    counts = stage(summed, "terms")
    fields = counts.where(F.col("term").isNull()).select("field", F.col("n_records").alias("n_with_terms"))
    few = fields.limit(MOST_FIELDS + 1).count() <= MOST_FIELDS
    return counts.where(F.col("term").isNotNull()).join(F.broadcast(fields) if few else fields, "field")


def mark_terms(counts: DataFrame, rare: int = 2, common: tuple[int, int] = (1, 2)) -> DataFrame:
    """counts with mark: rare (at most `rare` records), common (more than the share of records with terms), or null.

    A term that is both, which needs a field of very few records, has a row for each mark.
    """
    num, den = common
    is_common = F.col("n_records") * den > F.col("n_with_terms") * num
    marks = F.filter(F.array(F.when(F.col("n_records") <= rare, F.lit("rare")), F.when(is_common, F.lit("common"))), lambda m: m.isNotNull())
    return counts.withColumn("mark", F.explode_outer(marks))
