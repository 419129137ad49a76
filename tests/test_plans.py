"""Plan checks: column pruning reaches the parquet scan; the cleaning plan stays linear in size;
the exact-k split has no window over a whole stratum."""

from glossa.plans import registered as R

SF = "/root/testdata/sf0.001"


def _plan(df, kind="executedPlan"):
    qe = df._jdf.queryExecution()
    return (qe.executedPlan() if kind == "executedPlan" else qe.optimizedPlan()).toString()


def test_scan_prunes_columns(spark):
    plan = _plan(R.QUERIES["clean_paragraphs"](spark, SF))
    scans = [ln for ln in plan.splitlines() if "ReadSchema" in ln or "FileScan" in ln]
    assert scans and all("n_chars" not in ln and "source" not in ln for ln in scans)


def test_cleaning_plan_is_linear(spark):
    from glossa.sources import corpus as C
    df = C.clean_corpus(R.paragraphs(spark, SF))
    assert len(_plan(df, "optimizedPlan")) < 60_000  # without the step barriers it exceeded 500k


def test_split_windows_only_on_small_inputs(spark):
    from glossa.operators import sampling as S
    df = S.stratified_split(R.cleaned(spark, SF).withColumn("label", R.F.col("lang")), ["doc_id", "pos"], "label")
    plan = _plan(df)
    # windows are partitioned by (label, bucket) for the edge rows or run over the small count table
    for ln in plan.splitlines():
        if "Window [" in ln and "row_number" in ln:
            assert "_b" in ln
