import json
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions import numeric, text
from loomspark.operators import audit, evaluation, filings, inspection, links, registry, retrieval, routing, runstats, tools, traces
from loomspark.sources import files
from loomspark.streaming import logs


def test_chain_finds_tampering(spark):
    lines = list(audit.chained([{"ts": "t", "session_id": "s", "kind": "intent", "payload": {"n": i, "é": 1.5}} for i in range(6)]))
    check = lambda x: audit.verify_lines(spark.createDataFrame(list(enumerate(x)), "line_no long, value string")).first()
    assert tuple(check(lines)) == (True, None)
    assert tuple(check([lines[0].replace('"n": 0', '"n": 9'), *lines[1:]])) == (False, 0)
    assert tuple(check([*lines[:2], *lines[3:]])) == (False, 3)
    assert tuple(check([*lines[:2], "not json", *lines[3:]])) == (False, 2)


def test_text_log_verifies_every_line(spark):
    rows = spark.range(0, 900, 3).select("id", F.concat(F.lit("p"), F.col("id")).alias("p"))
    log = audit.text_log(rows, "id", F.col("p"), width=64)
    assert sorted(r.line_no for r in log.collect()) == list(range(300))
    ask = lambda n: audit.verify(log.withColumn("digest", F.sha2(F.when(F.col("line_no") == n, F.lit("x")).otherwise(F.col("payload")), 256))).first()
    assert tuple(ask(-1)) == (True, None) and tuple(ask(257)) == (False, 257)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "intro\n# Findings\nbody\n## Recommendation\nmore"), (2, "\n\n".join("x" * 1040 for _ in range(3))), (3, "  \n "), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.section, len(r.text)) for r in retrieval.chunks(docs).orderBy("doc_id", "chunk_ix").collect()]
    assert got[:3] == [(1, "", 5), (1, "Findings", 4), (1, "Recommendation", 4)]
    assert got[3:] == [(2, "", 1040), (2, "", 1342), (2, "", 1342)]


def test_search_renders_the_best_chunk(spark):
    docs = spark.createDataFrame([(1, "pump seal"), (2, "vessel V-2301 shell"), (3, "valve")], "doc_id long, text string")
    assert tools.kb_search(docs, "V-2301", 1).first()[0].startswith("[2 — ]\nvessel")


def test_inspection_report(spark, tmp_path):
    head = "**t-min (retirement limit, per design calc DC-1):** 7.4 mm\n\n| Grid | Location | 2019-03-06 | 2024-11-18 | Loss |\n|---|---|---|---|---|\n"
    (tmp_path / "R1.md").write_text(head + "| S6 | Shell bottom | 10.9 | 9.4 | 1.5 |\n| S7 | Shell bottom, mid | 10.6 | 8.9 | 1.7 |\n\nInterval between surveys: 5.70 years.\n")
    rated = inspection.rates(inspection.parse(files.markdown_folder(spark, str(tmp_path))))
    f = inspection.facts(rated).first()
    assert (f.doc_id, f.governing, f.max_loss_grid, f.grids) == ("R1", "S7", "S7", 2)
    assert (f.rate, f.life, f.next_interval) == (0.2982, 5.0302, 2.5151)
    assert inspection.violations(rated, inspection.facts(rated)).count() == 0
    thin = rated.withColumn("t_min", F.lit(9.0))
    thin = inspection.rates(thin)
    assert {(r.rule, r.grid) for r in inspection.violations(thin, inspection.facts(thin)).collect()} == {("below t-min", "S7"), ("life", "S7")}


def test_statement(spark):
    filler = "words of a statement without figures\n" * 30
    body = filler + "Revenue 20,988 03 19,000.00\nOther income 38.03 12.00\nTotal Income (I+II) 21,026.06 19,012.00 7.77"
    docs = spark.createDataFrame([(1, body), (2, "Statement of results\nTotal income 200.00 150.00"), (3, filler + "5.00\nTotal income 10.00 9.00"), (4, None), (5, filler + "Total income 1.00")], "doc_id long, text string")
    rows = filings.lines(docs)
    sums = {r.doc_id: [] for r in docs.collect()}
    for r in filings.totals(rows).collect():
        sums[r.doc_id].append((r.ord, r.total))
    assert sorted(sums[1]) == [(0, 2102606), (1, 1901200), (2, 777)] and sorted(sums[2]) == [(0, 20000), (1, 15000)] and sums[5] == []
    got = {(r.doc_id, r.total): (r.a, r.b) for r in filings.two_sum(filings.line_figures(rows), filings.totals(rows)).collect()}
    # the second statement has no figures before its totals, the third only one
    assert got == {(1, 2102606): (2098803, 3803), (1, 1901200): (1900000, 1200), (1, 777): (None, None)}
    done = {r.doc_id: (r.checks_run, r.checks_passed, r.verdict) for r in filings.reconciled(docs).collect()}
    assert done == {1: (3, 2, "text+facts"), 2: (0, 0, "scanned"), 3: (0, 0, "text-only"), 4: (0, 0, "scanned"), 5: (0, 0, "text-only")}


def test_statements_are_checked_within_their_rows(spark):
    """Lines, figures and totals in odd places: as the joins of ``two_sum`` have it, but with nothing shuffled."""
    pad = "no figures in these words. " * 40
    far = [f"Item {i}.50 {'x' * 30}" for i in range(45)]
    texts = [
        f"{pad}\n100.00 50.00\nTotal Income (I+II) 150.00 151.00", f"TOTAL INCOME 1.00 2.00\n{pad}", f"{pad}\n15.00\nTotal income 30.00 15.00", f"{pad}\n15.00 15.00\ntotal income 30.00 15.00 7.00",
        f"{pad}\nRegd. Office 100.00\n(100.00) 60 00\n40,00\ntotal income 100.00 total income 60.00", "\n".join([*far, "Total Income 3.00 46.00", pad, "total income 88.00 (9.00)"]),
        f"{pad}\n31.03.2021 2021 1,23,456.78 1234567890123\nTotal income (see note 12 below) 1,23,456.78 5", "short", None, f"{pad}\n5 0.00\nTotal Income 5.00 (5.00)\n0.01 4.99\nTotal Income 10 5", f"{pad}\r\n1.00 2.00\r\nTotal Income 3.00 4.00\r\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = filings.lines(docs.where(F.length("text") >= 1000))
    want = {i: (0, 0) for i in range(len(texts))}
    for r in filings.two_sum(filings.line_figures(rows), filings.totals(rows)).collect():
        run, passed = want[r.doc_id]
        want[r.doc_id] = (run + 1, passed + (r.a is not None))
    done = filings.reconciled(docs)
    assert {r.doc_id: (r.checks_run, r.checks_passed) for r in done.collect()} == want
    assert want[0] == (2, 1) and want[2] == (0, 0) and want[3] == (3, 1) and sum(passed for _, passed in want.values()) >= 6
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_markdown_checks_within_the_row(spark):
    body = "no figures in these words. " * 40 + "\n\n  Half year ENDED 30.09.2020  \n \nRow 100.00 50.00\nTotal Income (I+II) 150.00 151.00 "
    docs = spark.createDataFrame([(1, body, "a.pdf"), (2, "\n\n", None), (3, None, "b")], "doc_id long, text string, source string")
    own = filings.markdown(docs, notes=("n",))
    got = {r.doc_id: r.markdown for r in own.collect()}
    assert got == {r.doc_id: r.markdown for r in filings.markdown(docs, filings.reconciled(docs), notes=("n",)).collect()}
    assert got[1].startswith("# Financial Results — Half Year Ended 30.09.2020\n\n> Source: a.pdf\n> n\n") and "(1/2 identity" in got[1] and "(0/0 identity" in got[2]
    assert "Join" not in own._jdf.queryExecution().executedPlan().toString()


def test_verdicts_are_rolled_up_in_one_shuffle(spark):
    pad = "no figures in these words. " * 40
    docs = spark.createDataFrame([(1, f"{pad}\n100.00 50.00\nTotal Income 150.00 151.00"), (2, f"{pad}\n1.00 2.00\nTotal Income 7.00 8.00"), (3, None), (4, pad)], "doc_id long, text string")
    rolled = filings.roll_up(filings.reconciled(docs))
    assert {tuple(r) for r in rolled.collect()} == {("text+facts", 1, 2, 1, 1), ("text-only", 2, 2, 0, 1), ("scanned", 1, 0, 0, 0)}
    plan = rolled._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_checks_read_figures_in_passes_over_the_text(spark):
    """Not line by line and figure by figure; with the marks of the passes, dates, years, long numbers and addresses in the text."""
    pad = "no figures in these words. " * 40
    texts = [
        f"{pad}\n=5;3~2.00=;\n~1 =(2.00)\nTotal Income = 8 ; 7.00~10.00", f"{pad}\n12 34\n00\nTOTAL INCOME(I+II)12 34 12;total income 12.34", f"{pad}\n2021 (1999) 20,21 31.03. 21 1.2.20 1,2,3,4,5,6,7,8,9,0,1,2,3 123456789012 0\ntotal income 123456789012 2.00",
        f"{pad}\nCIN: 5 total income 5 6\n5\n1\nKarnatakA total income 5 6\n5\ntotal income Karnataka 5 10\ntotal income 10 5", f"= 5 5\n{pad}\n" + "x\n" * 37 + "total income 10 5\n\ntotal income 10 5", f"{pad}\n5\r12\x0b34 9,, 9.\x1c7)\ntotal income\t( 12 345 )5.12 14.12 18",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = filings.lines(docs)
    want = {i: [0, 0] for i in range(len(texts))}
    for r in filings.two_sum(filings.line_figures(rows), filings.totals(rows)).collect():
        want[r.doc_id][0] += 1
        want[r.doc_id][1] += r.a is not None
    done = filings.reconciled(docs)
    assert {r.doc_id: [r.checks_run, r.checks_passed] for r in done.collect()} == want
    assert all(run for run, _ in want.values()) and sum(passed for _, passed in want.values()) >= 6
    assert "regexp_extract_all" not in done._jdf.queryExecution().executedPlan().toString()


def test_cents_of_figures(spark):
    odd = ["(1,234.56)", "-12", "12 34", "1,23,4", "12.3", "(5", "7)", "1999", "20-21", "(2021)", "31.03.2021", "1.2.20", "31.03. 21", "123456789012", "1234567890123", "1,2,3,4,5,6,7,8,9,0,1,2", "1 9 99", "(-3.10)", "9,,", "0.00", "x", "Mangaluru 5", "CIN:5", "a\t5\t67 8"]
    texts = odd + [f"{a} {b}" for a in odd for b in odd]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.explode(text.figures(F.col("t"))).alias("f"))
    got = rows.select("f", text.figure_cents(F.col("f")).alias("a"), (text.repaired_number(F.col("f")) * 100).cast("long").alias("b")).collect()
    assert len(got) > 500 and all(r.a == r.b for r in got)
    digits = lambda x: "".join(c for c in x if c.isdigit())
    date, year = re.compile(r"\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2,4}"), re.compile(r"(19|20)\d{2}")
    address = lambda x: any(m in x.lower() for m in text.ADDRESS_MARKERS)
    want = [f for x in texts if not address(x) for f in re.findall(text.FIGURE, x) if not date.search(f) and not year.fullmatch(digits(f)) and len(digits(f)) <= 12]
    assert sorted(r.f for r in got) == sorted(want)


def test_numbers(spark):
    cases = {
        "20,988 03": 20988.03, "28.785 92": 28785.92, "3,818,05": 3818.05, "(481.45)": -481.45, "-": None, "—": None, "1234": 1234.0, "-5.00": 5.0, "x": None, "": None, ".05": 0.05,
        "1-234.50": 123450.0, "9" * 19: float("9" * 19), "1" * 40: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.repaired_number(F.col("s")).cast("double").alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_formulas_and_calls():
    assert round(tools.calc("remaining_life(8.9, 7.4, .2982)"), 3) == 5.030
    assert round(tools.calc("corrosion_rate(10.6, 8.9, years=5.70)"), 4) == 0.2982
    assert tools.calc("next_interval(40)") == 10.0 and tools.calc(" (1 + 2) * 3 / min(9, 4) ") == 2.25
    assert tools.split_call("f(a(1, 2), b=[3, 4])") == ("f", ["a(1, 2)"], {"b": "[3, 4]"})
    assert "substituted: (8.9 - 7.4) / 0.2982" in tools.calc_answer("remaining_life(8.9, 7.4, .2982)")
    assert "NOTE" in tools.calc_answer("remaining_life(7.0, 7.4, .2982)")
    for bad, why in (
        ("remaining_life(8.9, 7.4, 0)", "positive"), ("remaining_life(8.9)", "needs t_min, corrosion_rate"), ("next_interval(x=1)", "no parameter 'x'"), ("nothing(1)", "no formula"), ("f(", "not a call"),
        ("next_interval(__import__('os'))", "not a number"), ("required_thickness(100, 1, 1, 1)", "stress"),
    ):
        with pytest.raises(ValueError, match=why):
            tools.calc(bad)


def test_guards(spark):
    schema = {"properties": {"n": {"type": "integer", "description": "how many"}, "mode": {"type": "string", "enum": ["a"]}, "list": {"type": "array"}}, "required": ["n"]}
    told = lambda args: tools.argument_problem(schema, args)
    assert told({"n": 1}) is None and told({"n": 1, "list": "x"}) is None
    assert told({}) == "missing required parameter 'n'. how many"
    assert told({"n": 1, "x": 2}) == "unknown parameter(s) ['x']. Allowed: ['list', 'mode', 'n']"
    assert told({"n": True}) == "parameter 'n' must be integer, got boolean"
    assert told({"n": "1"}) == "parameter 'n' must be integer, got str"
    assert told({"n": 1, "mode": "b"}) == "parameter 'mode' must be one of ['a'], got 'b'"
    assert told({"n": 1, "list": [1]}) == "parameter 'list' must be array, got list"
    assert tools.jailed("a/../b.txt") == "b.txt"
    for bad in ("/etc/passwd", "../x", "C:\\x", "a/../../b", ""):
        with pytest.raises(ValueError):
            tools.jailed(bad)
    df = spark.createDataFrame([("127.0.0.1",), ("8.8.8.8",), ("nonsense",), (None,)], "a string")
    assert [r[0] for r in df.select(tools.local_address("a")).collect()] == [True, False, False, False]
    assert tools.json_object('so: {"a": "x\ny"} ok') == {"a": "x\ny"}
    bad = spark.createDataFrame([("1+1",), ("__class__",), ("import os",), ("",)], "e string").select(tools.expression_problem(F.col("e")))
    assert [r[0] for r in bad.collect()] == [None, "dunder", "banned word", "empty"]


def test_links(spark):
    page = "https://Host.example/docs/page.html?x=1"
    cases = {
        "a.html": "https://Host.example/docs/a.html", "/b": "https://Host.example/b", "../c": "https://Host.example/c", "?q=2": "https://Host.example/docs/page.html?q=2", "//evil.com/q": None,
        "HTTPS://host.example/d": "https://host.example/d", "https://host.example.evil/e": None, "http://host.example/f": None, "#top": None, "mailto:x@y": None, " javascript:x": None, "": None,
        "/x/LOGIN": None, "/y.PDF": "https://Host.example/y.PDF", "other": None,
    }
    rows = spark.createDataFrame([(i, page, 0, h) for i, h in enumerate(cases)], "page_id int, url string, ord int, href string")
    got = {r.href: r.target for r in links.in_scope(rows, "docs/a|/[b-d]$|q=2").collect()}
    assert got == {h: t for h, t in cases.items() if t}
    bare = spark.createDataFrame([(1, "https://h.example", "x"), (2, "https://h.example/A b/c.pdf?z", "y")], "page_id int, url string, html string")
    assert [r.file for r in links.manifest(bare).orderBy("page_id").collect()] == ["index.html", "a-b-c-pdf.html"]
    with_type = links.manifest(bare.withColumn("content_type", F.lit("application/PDF")))
    assert {r.file for r in with_type.collect()} == {"index.pdf", "a-b-c-pdf.pdf"}


def test_registry(spark, tmp_path):
    (tmp_path / "models.yaml").write_text("profile: small\nfallback: a\nmodels:\n" + "".join(f"  - {{id: {i}, backend: local, ref: 'r:{i}', device: {d}, vram_gb: {v}, max_ctx: 4096, routes: [qa], requires_tools: [calc], priority: {p}}}\n" for i, d, v, p in (
        ("b", "gpu", 42.0, 1), ("a", "gpu", 3.0, 5), ("a", "gpu", 90.0, 1), ("b", "cpu", 50.0, 9))))
    (tmp_path / "profiles").mkdir()
    (tmp_path / "profiles" / "small.yaml").write_text("id: small\nvram_budget_gb: 5.2\n")
    models, profiles, profile, fallback = files.registry(spark, str(tmp_path / "models.yaml"), str(tmp_path / "profiles"))
    judged = registry.verdicts(models, profiles, profile)
    assert [r.reason for r in judged.orderBy("ord").collect()] == ["claims 42.0 GB, profile 'small' budget is 5.2 GB", None, "duplicate id", None]
    kept = registry.accepted(judged, fallback)
    assert {(r.ref, r.max_ctx, tuple(r.requires_tools)) for r in kept.collect()} == {("r:a", 4096, ("calc",)), ("r:b", 4096, ("calc",))}
    for bad, why in ((judged.where("id = 'x'"), "every model"), (judged.where("id = 'b'"), "fallback")):
        with pytest.raises(ValueError, match=why):
            registry.accepted(bad, fallback)


def test_decision_without_rival(spark):
    asked = spark.createDataFrame([("Hi", [], "qa", 0.5, None, None, "m", None, None, False, 8192, [])], "prompt string, files array<string>, first string, first_score double, second string, second_score double, model_id string, resident string, override string, used_fallback boolean, max_ctx int, requires_tools array<string>")
    assert routing.decisions(asked).first()["decision"] == "qa (0.50) · image absent · 0.5k ctx · -> m [cold start]"


def test_scorers(spark):
    rows = [(1, "pump seal leaks", "pump"), (2, "pump shaft seal", "pump"), (3, "vessel wall loss", "vessel"), (4, "vessel shell wall", "vessel")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    lexical = routing.lexical_scorer(docs, "label")
    asked = spark.createDataFrame([(9, "the pump seal"), (8, "")], "doc_id long, text string")
    best = lambda s: {r.id: r.predicted for r in routing.best_label(s).collect()}
    assert best(lexical(asked)) == {9: "pump"}
    assert best(routing.hybrid_scorer(lexical, lambda d: None, lexical)(asked)) == {9: "pump"}
    loo = best(routing.lexical_loo(docs, "label"))
    assert loo == {1: "pump", 2: "pump", 3: "vessel", 4: "vessel"}
    with pytest.raises(ValueError, match="one text"):
        routing.lexical_loo(docs.where("doc_id < 4"), "label")


def test_verdicts(spark):
    df = spark.createDataFrame([("\n\t", None), ("it is 5.05", 5.0), ("x", 5.0)], "a string, t double")
    empty = F.array().cast("array<string>")
    assert [r[0] for r in df.select(evaluation.answer_verdict(F.col("a"), F.col("t"), empty, empty)).collect()] == ["failed", "correct", "failed"]
    said = spark.createDataFrame([("5.0 then Stopped: cap",), ("5.1",), ("limit Exceeded",), ("7",)], "a string")
    assert [r[0] for r in said.select(evaluation.trial_verdict(F.col("a"), F.lit(5.0294))).collect()] == ["failed", "correct", "unsafe", "wrong"]


def test_files(spark, tmp_path):
    log = tmp_path / "big.jsonl"
    log.write_text("".join(f'{{"prompt": "p{i}", "task_type": "t"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.exemplars(spark, str(log)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.ord, r.prompt) for r in rows] == [(i, f"p{i}") for i in range(5000)]
    root = tmp_path / "ws"
    (root / "sub").mkdir(parents=True)
    (root / "a.PNG").write_bytes(b"x" * 10)
    (root / "sub" / "b.tiff").write_bytes(b"y" * 50)
    (root / "c.gif").write_bytes(b"z")
    got, bad = files.attachments(spark, str(root), ["a.PNG", "sub/b.tiff", "none.png", "../d.png", "c.gif"], most=20)
    assert [r.length for r in got.collect()] == [10]
    assert sorted(r.problem for r in bad.collect()) == ["50B exceeds 20B cap", "no such file", "path leaves the root"]
    assert files.attachments(spark, str(root))[0].count() == 2
    assert files.write_text(spark, str(root), "out/n.txt", "é" * 9, limit=5) == 10 and (root / "out" / "n.txt").read_text() == "é" * 5
    assert files.jailed_file(spark, str(root), "out/n.txt").first()[0] == "é" * 5
    (root / "way").symlink_to(tmp_path)
    with pytest.raises(ValueError, match="leaves"):
        files.jailed_file(spark, str(root), " way/big.jsonl")
    (root / "way").unlink()
    assert [r.path.rsplit("/", 1)[1] for r in files.nearby(spark, str(root), 2).collect()] == ["a.PNG", "c.gif"]
    assert files.settings(str(tmp_path / "none.yaml"), {"host": "127.0.0.1"}) == {"host": "127.0.0.1"}
    for body, why in (("host: 10.0.0.1", "this machine"), ("odd: 1", "unknown"), ("- a", "mapping")):
        (tmp_path / "s.yaml").write_text(body)
        with pytest.raises(ValueError, match=why):
            files.settings(str(tmp_path / "s.yaml"), {"host": "127.0.0.1"})
    for path in ("data/.env", "x/secrets/y"):
        with pytest.raises(ValueError, match="staged"):
            files.staged([path])
    for name, done in (("r1", True), ("r2", False)):
        run = tmp_path / "runs" / name
        run.mkdir(parents=True)
        (run / "config.json").write_text('{"model": "m"}')
        if done:
            (run / "summary.json").write_text('{"status": "done"}')
            (run / "metrics.jsonl").write_text('{"t": 1.0, "step": 1, "loss": 2.5, "vram_gb": 4.0}\n{"t": 2.0, "step": 2, "loss": 2.0}\n')
    found = runstats.run_index(*files.run_folders(spark, str(tmp_path / "runs"))).collect()
    assert [(r.run_id, r.status, r.last_loss, r.peak_gb) for r in found] == [("r2", "running", None, 0.0), ("r1", "done", 2.0, 4.0)]
    files.write_jsonl(spark.createDataFrame([(1, "f")], "a int, _family string"), str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set")).columns == ["a"]
    files.write_document(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "doc"))
    assert files.json_documents(spark, str(tmp_path / "doc")).first()["b"] == "x"
    (tmp_path / "t.jsonl").write_text('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}\n')
    assert [tuple(r) for r in files.traces(spark, str(tmp_path / "t.jsonl")).collect()] == [(0, 0, "user", "q"), (0, 1, "assistant", "a")]


def test_paged_documents(spark, tmp_path):
    """A reader whose pages are the lines of a file; one page of each can't be read."""
    for name, lines in (("long", ["x" * 100] * 80), ("scan", ["", "a", "", "never read " * 50]), ("none", [" "])):
        (tmp_path / f"{name}.pdf").write_text("\n".join(lines))

    def reader(body):
        for i, line in enumerate(body.decode().split("\n") if body else []):
            yield lambda i=i, line=line: line if i != 1 else line[1000]

    got = {r.doc_id: (len(r.text), r.pages, r.scanned) for r in files.paged_documents(spark, str(tmp_path), ".pdf", reader).collect()}
    assert got == {"long": (59 * 100 + 59, 60, False), "scan": (2, 3, True), "none": (1, 1, True)}


def test_tools(spark):
    assert tools.TOOLS["calc"](spark, "next_interval(4)").first()[0].endswith("2.0000 years")
    docs = spark.createDataFrame([(1, "# T\n\n- **a** b\nplain")], "doc_id long, text string")
    got = [(r.kind, [(x.run, x.bold) for x in r.runs]) for r in tools.TOOLS["doc_write"](docs).orderBy("line").collect()]
    assert got == [("h1", [("T", False)]), ("bullet", [("a", True), (" b", False)]), ("text", [("plain", False)])]
    seen = spark.createDataFrame([(1, json.dumps([{"rec_texts": ["a", "b"], "rec_scores": [0.5, 1.0]}])), (2, json.dumps([[[[0, 0], ["c", 0.9]], "odd"]])), (3, "[]"), (4, None)], "doc_id long, result string")
    out = {r.doc_id: (r.text, r.lines, r.confidence) for r in tools.TOOLS["ocr_read"](seen).collect()}
    assert out == {1: ("a\nb", 2, 0.75), 2: ("c", 1, 0.9), 3: ("", 0, None), 4: ("", 0, None)}


def test_families(spark):
    facts = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("fact "), "id").alias("fact"))
    make = lambda word: lambda d: d.select(F.col("trace").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit(word), "fact").alias("text"))
    got = traces.composed(facts, [("a", make("A "), 0.7), ("b", make("B "), 0.3)], 100)
    assert {r.family: r["count"] for r in got.groupBy("family").count().collect()} == {"a": 70, "b": 30}
    assert got.where("text LIKE 'A fact%'").count() == 70
    assert traces.retained(100, 95) is None and "80 of 100" in traces.retained(100, 80)
    with pytest.raises(ValueError, match="none"):
        traces.retained(5, 0)
    row = spark.range(1).select(traces.is_prefix(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))).alias("p"), traces.encoded(F.array(F.lit(1)), F.array(F.struct(F.lit(5).alias("start"), F.lit(6).alias("end"))), 9).alias("n")).first()
    assert tuple(row) == (True, None)


@pytest.mark.parametrize("n", [32, 96, 453, 1000])
def test_stride(spark, n):
    got = [r[0] for r in traces.strided(spark.range(453).withColumnRenamed("id", "k"), "k", n).orderBy("k").collect()]
    assert len(got) == min(n, 453) and len(set(got)) == len(got) and got[-1] > 0.8 * 453


def test_text(spark):
    row = spark.range(1).select(
        text.modality(F.array(F.lit("a.PDF"), F.lit("b.jpg"))).alias("m"), text.slug(F.lit("--A b/C--"), 4).alias("s"), text.duration(F.lit(3725.0)).alias("d"),
        text.comma_list(F.lit(" a, ,b")).alias("c"), text.html_escape(F.lit('<a & "b">')).alias("h"), numeric.next_due(F.to_date(F.lit("2024-11-18")), F.lit(5.0)).alias("n"),
    ).first()
    assert tuple(row) == ("mixed", "a-b-", "1h 02m", ["a", "b"], "&lt;a &amp; &quot;b&quot;&gt;", "2027-05")
    lengths = spark.createDataFrame([(45.0,), (0.0,), (-3.0,), (None,), (float("nan"),), (0.4,), (3725.9,)], "s double").select(text.duration(F.col("s")))
    assert [r[0] for r in lengths.collect()] == ["0m 45s", "--", "--", "--", "--", "0m 00s", "1h 02m"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("#head\n\n2024-01-01 10:00:00 DROP TCP 10.0.0.1 8.8.8.8 5000 443 - SEND\n2024-01-01 10:00:01 DROP TCP 1 2 3 4 - RECEIVE\nshort DROP\n")
    (folder / "b.log").write_text("2024-01-01 10:00:02 DROP UDP 10.0.0.1 1.1.1.1 5000 53 - SEND\n2024-01-01 10:00:02 ALLOW UDP 1 2 3 4 - SEND\n")
    total = logs.running_total(logs.drops(logs.log_stream(spark, str(folder))))
    q = total.writeStream.outputMode("complete").format("memory").queryName("drops").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("drops").first()["total"] == 2
    seen = []
    q = logs.pushed(logs.drops(logs.log_stream(spark, str(folder))), seen.append, lambda: spark.createDataFrame([(i, f"l{i}") for i in range(20)], "line_no long, value string"), once=True)
    q.awaitTermination(60)
    assert seen[-1]["total"] == 2 and [d["dst"] for d in seen[-1]["drops"]] == ["1.1.1.1", "8.8.8.8"] and seen[-1]["audit"] == [f"l{i}" for i in range(5, 20)]


def test_chained_sink(spark, tmp_path):
    log = tmp_path / "audit.jsonl"
    sink = logs.append_chain(str(log), "q")
    batch = lambda k: spark.createDataFrame([(json.dumps({"ts": "t", "session_id": "s", "kind": "k", "payload": {"b": k}}),)], "value string")
    for k in (0, 1, 1):  # the last is a replay
        sink(batch(k), k)
    assert len(log.read_text().splitlines()) == 2
    # a batch that broke off after its first bytes is written anew
    state = json.loads((tmp_path / "audit.jsonl.state").read_text())
    (tmp_path / "audit.jsonl.state").write_text(json.dumps({**state, "writing": True}))
    log.write_text(log.read_text() + '{"half')
    logs.append_chain(str(log), "q")(batch(2), 2)
    assert audit.verify_lines(files.numbered_lines(spark, str(log))).first()["ok"] and len(log.read_text().splitlines()) == 3
    (tmp_path / "audit.jsonl.state").unlink()
    logs.append_chain(str(log), "other")(batch(3), 0)
    assert audit.verify_lines(files.numbered_lines(spark, str(log))).first()["ok"] and len(log.read_text().splitlines()) == 4
    log.write_text(log.read_text() + "x\n")
    with pytest.raises(RuntimeError):
        sink(spark.createDataFrame([("{}",)], "value string"), 9)


def test_run_states(spark, tmp_path):
    folder = tmp_path / "runs"
    rows = [("a", i, "step", 10) for i in range(3)] + [("a", 3, "final", 5), ("a", 4, "step", 9)] + [("b", i, "step", 1) for i in range(20, 0, -1)] + [("c", 1, "step", 5000), ("c", 2, "step", 2000), ("c", 3, "step", 1)]
    spark.createDataFrame(rows, "run_id string, n long, kind string, tokens long").coalesce(1).write.json(str(folder))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        stream = spark.readStream.schema("run_id string, n long, kind string, tokens long").json(str(folder))
        q = logs.run_states(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
        q.awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.run_id: (r.steps, r.tokens, r.status) for r in spark.table("states").collect()} == {"a": (3, 35, "final"), "b": (12, 12, "halted"), "c": (2, 7000, "halted")}


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a", 1.0), ("2024-01-01 10:55:00", "a", 2.0), ("2024-01-01 11:01:00", "b", 4.0), ("2024-01-01 15:00:00", "a", 9.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "ev"))
    want = {tuple(r) for r in logs.tumbling(df).collect()}
    q = logs.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.table("hours").collect()}
    # the last window is still open when the stream ends
    assert got == {r for r in want if r[0].hour < 15} and len(got) == 2
