"""A1-A3: the loan CSV as the reference ships it (header row, first column a
row index), renamed to engine names, with a row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# CSV header -> engine column (both spellings of the age header).
CSV_TO_ENGINE = {
    "SeriousDlqin2yrs": "is_default",
    "RevolvingUtilizationOfUnsecuredLines": "revolving_util",
    "age": "age",
    "Age": "age",
    "NumberOfTime30-59DaysPastDueNotWorse": "late_30_59",
    "DebtRatio": "debt_ratio",
    "MonthlyIncome": "monthly_income",
    "NumberOfOpenCreditLinesAndLoans": "open_credit_lines",
    "NumberOfTimes90DaysLate": "late_90_plus",
    "NumberRealEstateLoansOrLines": "real_estate_loans",
    "NumberOfTime60-89DaysPastDueNotWorse": "late_60_89",
    "NumberOfDependents": "num_dependents",
}

# CSV column order and the Spark types the engine expects (FIXTURES F1).
CSV_SCHEMA = T.StructType([
    T.StructField("_c0", T.LongType(), True),
    T.StructField("SeriousDlqin2yrs", T.LongType(), True),
    T.StructField("RevolvingUtilizationOfUnsecuredLines", T.DoubleType(), True),
    T.StructField("age", T.LongType(), True),
    T.StructField("NumberOfTime30-59DaysPastDueNotWorse", T.LongType(), True),
    T.StructField("DebtRatio", T.DoubleType(), True),
    T.StructField("MonthlyIncome", T.DoubleType(), True),
    T.StructField("NumberOfOpenCreditLinesAndLoans", T.LongType(), True),
    T.StructField("NumberOfTimes90DaysLate", T.LongType(), True),
    T.StructField("NumberRealEstateLoansOrLines", T.LongType(), True),
    T.StructField("NumberOfTime60-89DaysPastDueNotWorse", T.LongType(), True),
    T.StructField("NumberOfDependents", T.DoubleType(), True),
])


def read_loans(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """A1: CSV scan with an explicit schema (no inference pass), matched to
    the header by name, so columns may be missing or in any order. ``NA`` is
    NULL; any other value that does not fit its type is an error."""
    types = {f.name.lower(): f.dataType for f in schema.fields}
    header = spark.read.csv(path, header=True).columns
    found = T.StructType([T.StructField(c, types.get(c.lower(), T.StringType()), True) for c in header])
    return spark.read.csv(path, header=True, schema=found, enforceSchema=True, nullValue="NA", mode="FAILFAST")


def rename_loans(df: DataFrame) -> DataFrame:
    """A2: CSV headers -> engine names. Only headers present are renamed;
    Spark resolves names case-insensitively, so ``Age`` and ``age`` both map."""
    present = {c for c in df.columns}
    mapping = {src: dst for src, dst in CSV_TO_ENGINE.items() if src in present and src != dst}
    return df.withColumnsRenamed(mapping) if mapping else df


#: What a field holds that has no value.
NULL_FIELDS = ("", "NA")


def parse_loan_lines(lines: DataFrame, header: Sequence[str], schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """A1: CSV lines (column ``line``) to typed columns, named by ``header``
    and typed by ``schema`` (names it lacks are strings), with ``_reasons``:
    why the line cannot be a row, one entry a fault, empty for a good line.

    A fault is another number of fields than the header has, or a value that
    does not fit its column's type; the columns of such values are NULL.
    Nothing is dropped, and other columns of ``lines`` are kept."""
    types = {f.name.lower(): f.dataType for f in schema.fields}
    fields = [f"f{i}" for i in range(len(header))]
    as_text = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, "broken"]])
    csv = F.from_csv("line", as_text.simpleString()[7:-1].replace(":", " "), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    # one row a line: filters are not moved below a generator, so each line is
    # parsed once and not again for every field that a filter or a column reads
    tags = [f"_csv_{f}" for f in as_text.names]
    parsed = lines.select("*", F.inline(F.array(csv)).alias(*tags))
    typed, reasons = [], [F.when(F.col("_csv_broken").isNotNull(), f"not {len(header)} fields")]
    for name, field in zip(header, fields):
        text, want = F.col(f"_csv_{field}"), types.get(name.lower(), T.StringType())
        text = F.when(~text.isin(*NULL_FIELDS), text)
        value = text if isinstance(want, T.StringType) else text.try_cast(want)
        typed.append(value.alias(name))
        reasons.append(F.when(text.isNotNull() & value.isNull(), F.concat(
            F.lit(f"{name}: "), text, F.lit(f" is no {want.simpleString()}"))))
    return parsed.select(*typed, *lines.columns, F.array_compact(F.array(*reasons)).alias("_reasons"))


def split_good_and_rejected(parsed: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """A1: (rows without a fault, rejects as ``(*keep, line, reason)``) of
    ``parse_loan_lines``: every line is in one of the two."""
    good = parsed.filter(F.size("_reasons") == 0).drop("_reasons", "line")
    return good, parsed.filter(F.size("_reasons") > 0).select(*keep, "line", F.array_join("_reasons", "; ").alias("reason"))


def scan_loans(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """A1 and A3: (good rows, rejects) of the CSV files below ``path``.

    A bad line does not fail the load: it goes to the rejects with its file
    and the reason. Both hold ``row_id`` (``with_row_ids``: the line's number
    over all files, the header not counted). The header is the first file's;
    lines equal to it and empty lines are no data. Records are one line each."""
    header = spark.read.csv(path, header=True).columns
    first = spark.read.text(path).first()
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    lines = lines.filter((F.col("line") != F.lit(first.value if first else "")) & (F.trim("line") != ""))
    numbered = with_row_ids(lines, also=("file",))
    return split_good_and_rejected(parse_loan_lines(numbered, header, schema), "row_id", "file")


def with_row_ids(df: DataFrame, out: str = "row_id", also: Sequence[str] = ()) -> DataFrame:
    """A3: ``df``, a scan of files (filters may follow it), with the number of
    each row in the order of file path and place in the file, from 0.

    Unlike ``monotonically_increasing_id`` the number depends neither on how
    splits are dealt to tasks nor on their size, so a recomputed partition and
    a scan with other settings give the same ids. Each row's file and split
    come from the scan's hidden metadata; one narrow pass counts the rows of
    each split, a prefix over the splits (a row for each, so one task) gives
    the first number, and the number within the split comes from the scan's
    own running id. ``also`` may name ``file`` to keep the path."""
    from_scan = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                          F.monotonically_increasing_id().alias("_mid"))
    splits = from_scan.groupBy("_file", "_start").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    if _splits_at_most(df) <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return from_scan.join(offsets, ["_file", "_start"]).select(
        (F.col("_off") + F.col("_mid")).alias(out), *[F.col("_file").alias(c) for c in also], *df.columns)


#: Most splits whose offsets (two numbers and a path each) are broadcast.
MAX_BROADCAST_SPLITS = 100_000


def _splits_at_most(scan: DataFrame) -> int:
    """A bound of the number of splits of a scan: whole files, and pieces of a
    full split's size, of which a task reads one."""
    return len(scan.inputFiles()) + scan.rdd.getNumPartitions()


def with_customer_id(df: DataFrame, index_col: str = "_c0") -> DataFrame:
    """A3: the row key. Taken from the CSV index column when present (+0, as
    the index), else the row's number in its files (``with_row_ids``)."""
    if index_col in df.columns:
        return df.withColumnRenamed(index_col, "customer_id")
    if not df.inputFiles():
        # rows that come from no file have no place in one
        return df.select(F.monotonically_increasing_id().alias("customer_id"), "*")
    return with_row_ids(df, "customer_id")


def load_loans_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1-A3 in one call: the ``raw_loans`` table from the reference's CSV;
    a line that does not fit is an error."""
    return with_customer_id(rename_loans(read_loans(spark, path)))


def ingest_loans_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1-A3 in one call: (``raw_loans``, the rejected lines with reasons)."""
    good, rejects = scan_loans(spark, path)
    good = rename_loans(good.drop("file"))
    if "_c0" in good.columns:
        return with_customer_id(good.drop("row_id")), rejects
    return good.select(F.col("row_id").alias("customer_id"), *[c for c in good.columns if c != "row_id"]), rejects
