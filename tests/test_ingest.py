"""CSV ingest with rejected lines (A1) and row numbers of file scans (A3)."""

import pytest
from pyspark.sql import functions as F

from riskweave.sources.loans import (CSV_SCHEMA, ingest_loans_csv, load_loans_csv, parse_loan_lines,
                                     split_good_and_rejected, with_row_ids)

HEADER = ",".join(["" if f.name == "_c0" else f.name for f in CSV_SCHEMA.fields])


def _line(i, age="40", income="9120.5"):
    return f"{i},0,0.5,{age},0,0.8,{income},4,0,1,0,2"


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "loans"
    out.mkdir()
    for part in range(3):
        lines = [_line(part * 1000 + i) for i in range(1000)]
        lines[7] = _line(part * 1000 + 7, age="forty")
        lines[9] = lines[9] + ",1"
        lines[11] = "12,0"
        lines[13] = _line("x", income="much")
        lines[15] = _line(part * 1000 + 15, income="NA")
        lines[17] = ""
        (out / f"part-{part}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    return str(out)


def test_bad_lines_are_rejected_with_reasons(spark, folder):
    loans, rejects = ingest_loans_csv(spark, folder)
    good, bad = loans.collect(), rejects.collect()
    assert len(good) == 3 * 995 and len(bad) == 3 * 4
    assert {r.reason for r in bad} == {"age: forty is no bigint", "not 12 fields", "_c0: x is no bigint; MonthlyIncome: much is no double"}
    assert sum(r.reason == "not 12 fields" for r in bad) == 6 and all(r.file.endswith(".csv") for r in bad)
    by_id = {r.customer_id: r for r in good}
    assert by_id[15].monthly_income is None and by_id[16].monthly_income == 9120.5 and by_id[16].age == 40
    assert loans.dtypes[0] == ("customer_id", "bigint")
    with pytest.raises(Exception):
        load_loans_csv(spark, folder).collect()


def test_empty_files_and_no_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n")
    loans, rejects = ingest_loans_csv(spark, str(tmp_path))
    assert loans.collect() == [] and rejects.collect() == []
    (tmp_path / "b.csv").write_text(HEADER + "\n" + _line(1) + "\n")
    loans, rejects = ingest_loans_csv(spark, str(tmp_path))
    assert loans.count() == 1 and rejects.isEmpty()


def test_row_numbers_do_not_depend_on_the_partitioning(spark, folder):
    def numbered():
        lines = spark.read.text(folder).filter(F.col("value") != HEADER)
        return {(r.row_id, r.value, r.file) for r in with_row_ids(lines, also=("file",)).collect()}

    want = numbered()
    assert sorted(i for i, _, _ in want) == list(range(3000))
    assert [v for _, v, _ in sorted(want)][:3] == [_line(0), _line(1), _line(2)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("5000", "17000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert spark.read.text(folder).rdd.getNumPartitions() > 6
            assert numbered() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_recomputed_partition_keeps_its_ids(spark, folder):
    lines = spark.read.text(folder)
    one = with_row_ids(lines).persist()
    first = {(r.row_id, r.value) for r in one.collect()}
    one.unpersist(blocking=True)
    assert {(r.row_id, r.value) for r in with_row_ids(lines).repartition(5).collect()} == first


def test_parquet_rows_are_numbered_in_file_order(spark, tmp_path):
    spark.range(0, 5000, numPartitions=4).write.parquet(str(tmp_path / "t"))
    got = with_row_ids(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted((r.row_id, r.id) for r in got) == [(i, i) for i in range(5000)]


def test_each_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(0, _line(1)), (1, _line(2, age="old")), (2, "3,0"), (3, None), (4, '4,0,0.5,"41",0,0.8,NA,4,0,1,0,2')],
                                  "place long, line string")
    parsed = parse_loan_lines(lines, [f.name for f in CSV_SCHEMA.fields])
    good, rejects = split_good_and_rejected(parsed, "place")
    for out in (good, rejects):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert sorted((r.place, r._c0, r.age, r.MonthlyIncome) for r in good.collect() if r._c0) == [(0, 1, 40, 9120.5), (4, 4, 41, None)]
    assert [r.place for r in good.collect() if r._c0 is None] == [3]
    assert sorted((r.place, r.reason) for r in rejects.collect()) == [(1, "age: old is no bigint"), (2, "not 12 fields")]
