from jobs import nightly_reports
from tillwise.session import scratch_path


def test_nightly_job_writes_reports(spark):
    out = scratch_path(spark, "nightly")
    written = nightly_reports.main(["--data", "/root/testdata/sf0.001", "--out", out,
                                    "--as-of", "2001-08-01",
                                    "--only", "revenue_by_category,daily_summary,low_stock_alerts"])
    assert set(written) == {"revenue_by_category", "daily_summary", "low_stock_alerts"}
    assert spark.read.parquet(written["revenue_by_category"]).count() == 6
    assert spark.read.parquet(written["daily_summary"]).count() == 1
