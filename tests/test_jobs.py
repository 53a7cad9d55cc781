from tillroll import jobs
from tillroll.sources import tables
from tillroll.sources.retail import raw_transactions


def test_all_jobs_write_their_results(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    raw_transactions(spark, "/root/testdata/sf0.001").write.parquet(raw)
    jobs.clean(spark, raw, out)
    sources = {"profile": raw, "reports": f"{out}/transactions", "clusters": f"{out}/transactions"}
    for name, job in jobs.JOBS.items():
        if name not in ("clean", "append"):
            job(spark, sources.get(name, f"{out}/sales"), f"{out}/{name}")
            assert all(any(folder.glob("part-*")) for folder in (tmp_path / "out" / name).iterdir())
    assert spark.read.csv(f"{out}/reports/revenue_by_country", header=True).count() > 0


def test_appending_to_a_cleaned_table(spark, tmp_path):
    lines = raw_transactions(spark, "/root/testdata/sf0.001")
    for part, chosen in (("a", "Quantity % 2 = 0"), ("b", "Quantity % 2 != 0 OR Quantity < 0")):
        tables.write_result(lines.filter(chosen), str(tmp_path / part))
    lines.write.parquet(str(tmp_path / "raw"))
    jobs.clean(spark, str(tmp_path / "raw"), str(tmp_path / "whole"))
    jobs.clean(spark, str(tmp_path / "a"), str(tmp_path / "grown"), "csv")
    jobs.append(spark, str(tmp_path / "b"), str(tmp_path / "grown"), "csv")
    for name in ("transactions", "sales"):
        whole, grown = (tables.read_transactions(spark, str(tmp_path / f / name)) for f in ("whole", "grown"))
        assert grown.count() == whole.count() > 0
        assert grown.exceptAll(whole).isEmpty() and whole.exceptAll(grown).isEmpty()
