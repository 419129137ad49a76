import hashlib
import random

from glossa.llm import line_dedup as L
from glossa.llm import quality_rules as Q

from .helpers import ODD_TEXTS, clashing, empty_docs

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def line_docs():
    rng = random.Random(2)
    shared = ["This boilerplate line is shared by many documents, cookies", "É" * 39 + "x", "É" * 38 + "x", "  Short line "]
    out = list(ODD_TEXTS)
    for d in range(40):
        lines = [rng.choice([rng.choice(shared), rng.choice(shared).upper(), f"own line {d} " + "z" * 40, ""]) + rng.choice(["", " ", "\t\r"])
                 for _ in range(rng.randrange(6))]
        out.append((100 + d, "\n".join(lines)))
    return out + [(None, shared[0]), (105, shared[0] + "\nagain")]


def test_line_dedup_matches_brute_force(spark):
    rows = line_docs()
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(k := key(line)) >= 40 and doc is not None:
                held.setdefault(k, set()).add(doc)
    drop = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == doc]
        want.append((str(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), n_lines="x", h=1, line_doc=2, LINE_DROPS=3)
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "h", "line_doc", "LINE_DROPS", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == sorted(want)
    assert sum(w[2] for w in want) > 20
    assert L.dedup_lines(empty_docs(spark)).collect() == []


def brute_stats(text):
    text = text or ""
    spaced = "".join(" " if c in WS else c for c in text)
    words = [w for w in spaced.split(" ") if w]
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(WS):
            dups += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(cover)


def rule_docs():
    rng = random.Random(6)
    out = [(d, t[:3000] if t else t) for d, t in ODD_TEXTS]
    for d in range(60):
        words = [rng.choice(["alpha", "beta", "ga", "delta", "eps", "zeta", "a"]) for _ in range(rng.randrange(60))]
        out.append((100 + d, rng.choice([" ", "\n", " \t", "\r\n"]).join(words) + rng.choice(["", "\n", " # $ | <"])))
    return out + [(300, "AN ENTIRELY UPPER CASE TEXT OF WORDS THAT NEVER REPEAT THEMSELVES HERE"),
                  (301, "ordinary prose about many things that a reader would like to keep in the corpus, surely"),
                  (302, "1 22 333 4444 55555 666666 7777777 88 999 1010 1111 1212"), (303, " ".join(f"wow{i}!!" for i in "abcdefghijkl"))]


def test_base_statistics_match_brute_force(spark):
    rows = rule_docs()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), n_words="x", kept="y", s=1, quality_stats=2)
    out = Q.apply_rules(docs).collect()
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out)
    assert got == sorted(str((d, *brute_stats(t))) for d, t in rows)
    by = {r.doc_id: r for r in out}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
    assert by[301].kept and not any(by[k].kept for k in (300, 302, 303))
    assert all(r.kept == (not r.base_failed and r.rejected_by is None) for r in out)


def test_order_changes_work_never_verdicts(spark):
    docs = spark.createDataFrame(rule_docs(), "doc_id long, text string")
    a = sorted((str(r.doc_id), r.kept) for r in Q.apply_rules(docs).collect())
    b = sorted((str(r.doc_id), r.kept) for r in Q.apply_rules(docs, list(reversed(Q.RULES)), sample_rows=5).collect())
    assert a == b


def test_cascade_orders_by_rejections_per_cost(spark):
    from pyspark.sql import functions as F
    never = Q.Rule("never", lambda t, s: F.lit(False))
    always = Q.Rule("always", lambda t, s: F.lit(True))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(50)], "doc_id long, text string")
    assert [r.name for r in Q.plan_cascade(docs, [never, always])] == ["always", "never"]
    assert {r.rejected_by for r in Q.apply_rules(docs, [never, always]).collect()} == {"always"}


def test_native_plan_and_empty_table(spark):
    docs = spark.createDataFrame(rule_docs(), "doc_id long, text string")
    plan = Q.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert Q.apply_rules(empty_docs(spark)).collect() == []


def test_digest_of_query_columns():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_rows_of_one_id_have_lists_of_their_own(spark):
    """A third of all rows share one id, as many have none: no list holds the keys of more than one text."""
    common = [f"a line that many documents of this table do share, number {i:03d}" for i in range(60)]
    rows = [(i, "\n".join(common)) for i in range(6)] + [(77, f"{common[i % 60]}\nown {i}") for i in range(60)] + [(None, f"{common[i % 60]}\nnone {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lists = L.dropped_keys(docs).filter("doc IS NULL OR doc = 77").collect()
    assert max(len(r.drops) for r in lists) == 1 and len(lists) == 60  # 77 is the largest id of every line
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(docs).collect())
    assert got == sorted([(str(i), "", 60, 60) for i in range(6)] + [("77", f"{common[i % 60]}\nown {i}", 2, 0) for i in range(60)]
                         + [("None", f"none {i}", 2, 1) for i in range(60)])
