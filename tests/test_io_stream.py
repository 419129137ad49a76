"""Sinks round-trip; streaming equals batch; language id learns the tables' languages."""

import os
import tempfile
from urllib.parse import unquote

from pyspark.sql import functions as F

from glossa.operators import langid as LID
from glossa.plans import registered as R
from glossa.sources import corpus as C
from glossa.sources import io as IO
from glossa.streaming import ingest as SI

SF = "/root/testdata/sf0.001"


def test_corpus_text_roundtrip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("en", "first one"), ("en", " second "), ("de", "dritte")], "lang string, text string")
    IO.write_corpus_text(df, os.path.join(d, "c"), ["lang"])
    back = IO.read_corpus_text(spark, os.path.join(d, "c")).withColumn("lang", F.regexp_extract("path", "lang=([^/]+)", 1))
    got = sorted((r.lang, r.text) for r in back.collect())
    assert got == [("de", "dritte"), ("en", "first one"), ("en", "second")]


def test_corpus_files_keep_every_fragment(spark, tmp_path):
    """A bad byte costs that byte alone; files without a blank line have a fragment a line."""
    (tmp_path / "bad.txt").write_bytes("erste ü".encode() + b"\xff\n\n" + b"zweite\xc3 x\n")
    (tmp_path / "lines.txt").write_bytes(b"a\r\nb\n\x0bc")
    (tmp_path / "crlf.txt").write_bytes(b"one\r\ntwo\r\n\r\nthree")
    (tmp_path / "single.txt").write_bytes(b"x\ny\n\n")
    (tmp_path / "empty.txt").write_bytes(b" \n\n\n\n ")
    got = {}
    for r in IO.read_corpus_text(spark, str(tmp_path)).orderBy("path", "block", "pos").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.text)
    assert got == {"bad.txt": ["erste ü", "zweite x"], "lines.txt": ["a", "b", "c"], "crlf.txt": ["one\ntwo", "three"], "single.txt": ["x\ny"]}


def test_large_files_of_either_kind_are_read_by_many_tasks(spark, tmp_path):
    """Against the rule on the whole text: blank lines if there are any, else line breaks."""
    kinds = {"lines": "\n".join(f"line {i} ü\x0bsecond" for i in range(20_000)), "blank": "\n\n".join(f"one {i}\ntwo" for i in range(20_000)),
             "first [1] a%20b": "\n" + "\n".join(f"x{i}" for i in range(50)), "late": "a\nb\n" * 9000 + "\n", "old": "p\r\rq\rr", "none": "", "nl": "\n",
             "two": "\n\nz\ny", "crlf": "u\r\nv\r\n"}
    for name, text in kinds.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = IO.read_corpus_text(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).orderBy("path", "block", "pos").collect()
        by_line = IO.files_without_blank_line(spark, str(tmp_path))
        splits = lambda only: IO._corpus_lines(spark, str(tmp_path), only=only).rdd.getNumPartitions()
        mine = F.col("path").isin(by_line)
        assert max(splits(mine), splits(~mine)) < splits(None)  # the files of the other kind aren't read
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {unquote(f.rsplit("/", 1)[1])[:-4] for f in by_line} == {"crlf", "first [1] a%20b", "lines", "nl"}
    got, tasks = {}, {}
    for r in rows:
        name = unquote(r.path.rsplit("/", 1)[1])[:-4]
        got.setdefault(name, []).append(r.text)
        tasks.setdefault(name, set()).add((r.task, r.block))
    want = {}
    for name in kinds:
        text = (tmp_path / f"{name}.txt").read_text(encoding="utf-8", errors="ignore")
        parts = text.split("\n\n") if "\n\n" in text else text.splitlines()
        want[name] = [p.strip() for p in parts if p.strip()]
    assert got == {k: v for k, v in want.items() if v}
    assert len(tasks["lines"]) > 3 and len(tasks["blank"]) > 3


def test_ledger_lists_broken_runs(spark, tmp_path):
    for name, files in {"run_1": {"status.json": '{"status": "completed", "message": "m", "updated_at": "t"}', "config.json": '{"language": "de"}'},
                        "run_2": {"status.json": "{broken"}, "run_3": {"log.txt": "x"}}.items():
        (tmp_path / "runs" / name).mkdir(parents=True)
        for f, text in files.items():
            (tmp_path / "runs" / name / f).write_text(text)
    led = IO.run_ledger(spark, f"{tmp_path}/runs").collect()
    assert [(r.run_id, r.status, r.message, r.language) for r in led] == [
        ("run_3", "unknown", "", ""), ("run_2", "unknown", "", ""), ("run_1", "completed", "m", "de")]


def test_saving_a_tokenizer_again_replaces_it(spark, tmp_path):
    v = spark.createDataFrame([(0, "<unk>"), (1, "a")], "id int, piece string")
    for method in ("bpe", "bpe", "wordpiece"):
        IO.save_tokenizer(v, None, str(tmp_path), "run1", method, 100)
    assert spark.read.parquet(f"{tmp_path}/vocab").groupBy("method").count().collect().__len__() == 2
    assert spark.read.parquet(f"{tmp_path}/vocab").count() == 4


def test_safe_readers(spark):
    from glossa.sources.io import STATUS_SCHEMA
    assert IO.read_csv_safely(spark, "/nonexistent/x.csv", STATUS_SCHEMA).count() == 0
    assert IO.read_json(spark, "/nonexistent/x.json", STATUS_SCHEMA).count() == 0


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp()
    SI.run_clean_stream(spark, SF, f"{d}/sink", f"{d}/state", "de")
    s = spark.read.parquet(f"{d}/sink").select("doc_id", "pos", "label", "text")
    b = R.labelled(spark, SF).select("doc_id", "pos", "label", "text")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_quota_is_idempotent(spark):
    d = tempfile.mkdtemp()
    SI.run_quota_stream(spark, SF, f"{d}/sink", f"{d}/state", 7)
    got = spark.read.parquet(f"{d}/sink").groupBy("lang").count().collect()
    assert all(r["count"] == 7 for r in got) and len(got) == 4


def test_stream_stops_when_all_quotas_are_full(spark):
    """Later files are never read: one of them is no Parquet file at all, and the result is that of the first ones."""
    import os
    d = tempfile.mkdtemp()
    os.makedirs(f"{d}/in")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IN ('en', 'de')").select("doc_id", "lang", "text")
    for i in range(12):  # in the order of their times
        docs.filter(F.col("doc_id") % 12 == i).coalesce(1).write.parquet(f"{d}/part{i}")
        name = next(f for f in os.listdir(f"{d}/part{i}") if f.endswith(".parquet"))
        target = f"{d}/in/documents-{i:02d}.parquet"
        os.link(f"{d}/part{i}/{name}", target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    with open(f"{d}/in/documents-11.parquet.new", "wb") as f:
        f.write(b"PAR1 broken PAR1")
    os.replace(f"{d}/in/documents-11.parquet.new", f"{d}/in/documents-11.parquet")
    os.utime(f"{d}/in/documents-11.parquet", (1_700_000_100, 1_700_000_100))
    schema = docs.schema
    from unittest import mock
    with mock.patch.object(SI, "document_stream", lambda s, folder, glob: s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)):
        SI.run_quota_stream(spark, f"{d}/in", f"{d}/sink", f"{d}/state", 5, ["en", "de"])
    got = spark.read.parquet(f"{d}/sink")
    assert {r.lang: r.n for r in got.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"en": 5, "de": 5}
    assert len([x for x in os.listdir(f"{d}/sink") if x.startswith("batch_id=")]) < 11


def test_langid_accuracy(spark):
    c = R.cleaned(spark, "/root/testdata/sf0.01").withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    train, held = c.filter("_h >= '4'"), c.filter("_h < '4'")
    model = LID.train(train)
    pred = LID.predict(model, held, ["doc_id", "pos"])
    joined = LID.predict(model, held, ["doc_id", "pos"], max_rows=10)  # too large a model to broadcast
    assert pred.exceptAll(joined).count() == 0
    j = held.join(pred, ["doc_id", "pos"])
    acc = j.filter(F.col("lang") == F.col("predicted")).count() / j.count()
    assert acc > 0.9


def test_table_sinks(spark):
    from glossa.sources.io import STATUS_SCHEMA
    d = tempfile.mkdtemp()
    t = spark.createDataFrame([("r1", "completed", "", "2026-01-01T00:00:00")], STATUS_SCHEMA)
    IO.write_table_csv(t, f"{d}/t.csv")
    back = IO.read_csv_safely(spark, f"{d}/t.csv", STATUS_SCHEMA).collect()
    assert back == [t.collect()[0].asDict() | {"message": None}] or [r.asDict() for r in back] == [
        t.collect()[0].asDict() | {"message": None}]  # an empty CSV field reads back as missing
    IO.write_json(t, f"{d}/run_1/status.json")
    led = IO.run_ledger(spark, d).collect()
    assert [(r.run_id, r.status, r.language) for r in led] == [("run_1", "completed", "")]
    snap = IO.snapshot_corpus(spark.createDataFrame([("a\nb",)], "text string"), f"{d}/run")
    assert spark.read.parquet(snap).count() == 1
    assert [r.line for r in IO.trainer_lines(spark.read.parquet(snap)).collect()] == ["a b"]
    v = spark.createDataFrame([(0, "<unk>"), (1, "a")], "id int, piece string")
    p = IO.save_tokenizer(v, None, f"{d}/tok", "run1", "bpe", 100)
    assert spark.read.parquet(f"{d}/tok/vocab").filter("method = 'bpe' AND vocab_size = 100").count() == 2 and p


def test_streams_read_a_table_in_part_files(spark, tmp_path):
    """A table may be a folder of part files, as Spark writes it; the streams found none there."""
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", f"paragraph number {i}\n\nand another one of {i}") for i in range(40)], "doc_id long, lang string, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in/documents.parquet")
    SI.run_clean_stream(spark, f"{tmp_path}/in", f"{tmp_path}/sink", f"{tmp_path}/state", "de")
    got = spark.read.parquet(f"{tmp_path}/sink").select("doc_id", "pos", "label", "text")
    want = R.labelled(spark, f"{tmp_path}/in").select("doc_id", "pos", "label", "text")
    assert got.count() == 80 and got.exceptAll(want).count() == 0
    SI.run_quota_stream(spark, f"{tmp_path}/in", f"{tmp_path}/sink2", f"{tmp_path}/state2", 3, ["en", "de"])
    assert {r["lang"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/sink2").groupBy("lang").count().collect()} == {"en": 3, "de": 3}


def test_langid_counts_every_gram(spark):
    """Against plain slicing; a character beyond U+FFFF is one character (it gave grams of half a character), a null lang its own group."""
    from collections import Counter
    rows = [("de", " Straße  und\tWeg "), ("de", "a😀b"), ("en", ""), (None, "xy"), ("ja", "".join(chr(0x4E00 + i) for i in range(300))), ("en", None)]
    got = {(r.lang, r.gram): r["count"] for r in LID.gram_counts(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = Counter()
    for lang, text in rows:
        t = f" {' '.join(text.lower().split())} " if text is not None else ""
        want.update((lang, t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    assert got == want
    assert all(len(r.gram) <= 3 for r in LID.train(spark.createDataFrame(rows[:2], "lang string, text string")).collect())


def test_repeated_documents_are_labelled_once_each(spark, tmp_path):
    """A prediction is a row for each text, whatever its keys; the queries joined them by (doc_id, pos), which squared repeated rows."""
    from glossa.operators import langid as LID
    from glossa.plans import registered as R
    said = {"en": "the house and the garden of the king number", "de": "das Haus und der Garten und die Tiere Nummer"}
    rows = [(i, lang, f"{said[lang]} {i}") for i in range(60) for lang in [("en", "de")[i % 2]] for _ in range(1 + i % 3)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, held = R._langid_sides(spark, str(tmp_path))
    want = {r.lang: r["count"] for r in held.groupBy("lang").count().collect()}
    assert sum(want.values()) > held.select("doc_id").distinct().count()
    assert {(r.lang, r.label): r.n_texts for r in R.q_label_by_classifier(spark, str(tmp_path)).collect()} == {(k, k): n for k, n in want.items()}
    assert {(r.lang, r.predicted): r.n_texts for r in R.q_langid_accuracy(spark, str(tmp_path)).collect()} == {(k, k): n for k, n in want.items()}
    train, held = R._langid_sides(spark, str(tmp_path))
    model = LID.train(train)
    for max_rows in (10, 1 << 20):  # joined, broadcast
        assert {(r.lang, r.predicted): r["count"] for r in LID.predict(model, held, ["lang"], max_rows=max_rows).groupBy("lang", "predicted").count().collect()} == {
            (k, k): n for k, n in want.items()}
