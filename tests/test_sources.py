"""Loads and source checks: times of a load, columns that a check reads."""

from glossa.plans import registered as R
from glossa.sources import corpus as C

SF = "/root/testdata/sf0.001"


def test_a_load_has_its_times(spark):
    docs = C.documents(spark, SF)
    loaded, manifest = C.load_languages(spark, docs, ["en", "de", "xx"], 7, output_dir="out")
    rows = {r.language: r for r in manifest.collect()}
    assert {k: (r.loaded_samples, r.status) for k, r in rows.items()} == {"en": (7, "completed"), "de": (7, "completed"), "xx": (0, "failed")}
    assert all("T" in r.started_at <= r.finished_at for r in rows.values()) and rows["xx"].error and rows["en"].output_path == "out/en.txt"
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, C.quota_load(docs, 7, ["en", "de", "xx"]).collect()))


def test_the_source_check_reads_no_text(spark):
    df = R.QUERIES["missing_sources"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in plan and "text" not in plan
    assert {r.lang for r in df.collect()} == {"ru", "ja", "zh-cn"}


def test_threads_ship_the_package_once():
    import time
    from concurrent.futures import ThreadPoolExecutor
    from types import SimpleNamespace

    from glossa.session import ship_package
    shipped = []
    context = SimpleNamespace(_jsc=object(), addPyFile=lambda path: (time.sleep(0.2), shipped.append(path)))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(ship_package, [SimpleNamespace(sparkContext=context)] * 4))
    assert len(shipped) == 1
