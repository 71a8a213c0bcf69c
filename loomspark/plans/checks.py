"""Queries of routing decisions, statements, inspections, evaluation, tools and links, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import numeric, text
from loomspark.functions.numeric import fixed
from loomspark.operators import evaluation, filings, inspection, links, registry, routing, tools, traces
from loomspark.plans import queries as q
from loomspark.plans.base import query, t
from loomspark.streaming import logs

four = lambda x: f"CAST(CAST({x} AS DECIMAL(30,4)) AS DOUBLE)"
six = lambda x: f"CAST(CAST({x} AS DECIMAL(30,6)) AS DOUBLE)"

# -- routing --------------------------------------------------------------------------------------

FILES = "CASE doc_id % 5 WHEN 1 THEN ['a.png'] WHEN 2 THEN ['a.pdf', 'b.JPG'] WHEN 3 THEN ['notes.txt', 'x.pdf'] WHEN 4 THEN ['notes.txt'] ELSE [] END"
MODALITY = "CASE doc_id % 5 WHEN 1 THEN 'image' WHEN 2 THEN 'mixed' WHEN 3 THEN 'pdf' ELSE 'text' END"
PROMPT = """CASE doc_id % 7 WHEN 0 THEN 'Run this script and show the output: ' WHEN 1 THEN 'run this python script, it crashes on: ' WHEN 2 THEN 'Put it in an Excel sheet: '
  WHEN 3 THEN 'Write a word document on ' ELSE '' END || coalesce(text, '')"""
ALLOWED = rf"""
p AS (SELECT doc_id, {PROMPT} AS prompt, {MODALITY} AS modality FROM documents),
c AS (SELECT *, regexp_matches(prompt, '(?i)\b(run|execute|debug|traceback)\b') AND regexp_matches(prompt, '(?i)\b(script|code|program|python|snippet|function|pytest|unit tests?|stack trace)\b') AS code FROM p),
al AS (SELECT *, CASE WHEN modality <> 'text' THEN 'scan_understanding,drawing_qa,handwriting'
  WHEN code AND regexp_matches(prompt, '(?i)\b(fix|fixed|repair|debug|broken|breaks|crash(es|ed)?|bug|wrong|error|fails?|failing|hangs?|patch|correct)\b') THEN 'code_fix,code_write' WHEN code THEN 'code_write'
  WHEN regexp_matches(prompt, '(?i)\.xlsx\b|\bexcel\b|\bspreadsheet\b') THEN 'spreadsheet' WHEN regexp_matches(prompt, '(?i)\.docx\b|\bword document\b') THEN 'approval_note,summarize' END AS allowed FROM c)"""


def _prompts(spark, d):
    k = F.col("doc_id")
    pick = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    files = F.when(k % 5 == 1, pick("a.png")).when(k % 5 == 2, pick("a.pdf", "b.JPG")).when(k % 5 == 3, pick("notes.txt", "x.pdf")).when(k % 5 == 4, pick("notes.txt")).otherwise(pick())
    starts = ["Run this script and show the output: ", "run this python script, it crashes on: ", "Put it in an Excel sheet: ", "Write a word document on "]
    start = F.lit("")
    for i, x in enumerate(starts):
        start = F.when(k % 7 == i, x).otherwise(start)
    return t(spark, d, "documents").select("doc_id", F.concat(start, F.coalesce("text", F.lit(""))).alias("prompt"), files.alias("files"))


@query(f"WITH {ALLOWED} SELECT doc_id, sha256(prompt) AS prompt, modality, allowed FROM al")
def override_rules(spark, d):
    """P3, F20, U8 on the documents as prompts."""
    asked = _prompts(spark, d)
    out = routing.overrides(asked.select(F.concat(F.col("prompt"), F.lit("\u0001"), F.col("doc_id")).alias("prompt"), "files"))
    parts = F.split("prompt", "\u0001")
    return out.select(parts[1].cast("long").alias("doc_id"), F.sha2(parts[0], 256).alias("prompt"), "modality", F.array_join("allowed", ",").alias("allowed"))


#: A model for each part of the table: most brands come up more than once, so ids repeat.
MODELS_SQL = """mo AS (SELECT p_partkey::INT AS ord, p_brand || '-' || p_size AS id, CASE WHEN p_size % 4 = 0 THEN 'cpu' ELSE 'gpu' END AS device, p_retailprice / 250 AS vram_gb,
  ['r' || p_size % 10, 'r' || p_partkey % 30] AS routes, (p_partkey % 5)::INT AS priority FROM part),
v0 AS (SELECT *, device = 'gpu' AND vram_gb > 5.2::DOUBLE AS over FROM mo),
v AS (SELECT *, CASE WHEN ord > min(ord) FILTER (NOT over) OVER (PARTITION BY id) THEN 'duplicate id'
  WHEN over THEN 'claims ' || vram_gb || ' GB, profile ''small'' budget is 5.2 GB' END AS reason FROM v0)"""


def _models(spark, d):
    p = t(spark, d, "part")
    models = p.select(
        F.col("p_partkey").cast("int").alias("ord"), F.concat("p_brand", F.lit("-"), "p_size").alias("id"), F.when(F.col("p_size") % 4 == 0, "cpu").otherwise("gpu").alias("device"),
        (F.col("p_retailprice") / 250).alias("vram_gb"), F.array(F.concat(F.lit("r"), F.col("p_size") % 10), F.concat(F.lit("r"), F.col("p_partkey") % 30)).alias("routes"), (F.col("p_partkey") % 5).cast("int").alias("priority"),
    )
    return registry.verdicts(models, spark.createDataFrame([("small", 5.2), ("large", 80.0)], "id string, budget_gb double"), "small")


@query(f"WITH {MODELS_SQL} SELECT ord, id, reason IS NULL AS accepted, reason = 'duplicate id' AS duplicate FROM v")
def registry_filter(spark, d):
    return _models(spark, d).select("ord", "id", F.col("reason").isNull().alias("accepted"), (F.col("reason") == "duplicate id").alias("duplicate"))


ROUTED = """o AS (SELECT unnest(routes) AS task, * EXCLUDE routes FROM v WHERE reason IS NULL),
rb AS (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY priority, vram_gb, ord) AS r FROM o),
rs AS (SELECT t.task, coalesce(rb.id, 'small') AS model_id, rb.id IS NULL AS used_fallback FROM (SELECT 'r' || unnest(range(40)) AS task) t LEFT JOIN rb ON rb.task = t.task AND r = 1)"""


def _resolved(spark, d):
    tasks = spark.range(40).select(F.concat(F.lit("r"), "id").alias("task"))
    return registry.resolve(_models(spark, d).where("reason is null"), tasks, "small")


@query(f"WITH {MODELS_SQL}, {ROUTED} SELECT * FROM rs")
def registry_resolve(spark, d):
    return _resolved(spark, d)


TOP2 = f"""{q.CENT}, tr AS (SELECT id, label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM ds),
tw AS (SELECT id, max(label) FILTER (r = 1) AS f, max(score) FILTER (r = 1) AS fs, max(label) FILTER (r = 2) AS s, max(score) FILTER (r = 2) AS ss FROM tr WHERE r <= 2 GROUP BY id)"""


@query(rf"""WITH {MODELS_SQL}, {ROUTED}, {TOP2}, al AS (SELECT doc_id, {PROMPT} AS prompt, {MODALITY} AS modality, {FILES} AS files FROM documents),
rx AS (SELECT al.*, 'r' || (f + 3 * (doc_id % 12)) AS first, fs, 'r' || s AS second, ss, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE model_id END AS resident, model_id, used_fallback,
  (length(prompt) // 4 + 512 + coalesce(list_sum(list_transform(files, lambda a: CASE WHEN lower(a) LIKE '%.pdf' THEN 768 ELSE 1024 END)), 0))::BIGINT AS ctx FROM al JOIN tw ON tw.id = doc_id JOIN rs ON rs.task = 'r' || (f + 3 * (doc_id % 12))),
n AS (SELECT *, concat_ws('; ', CASE WHEN doc_id % 4 = 0 THEN 'asked for' END, CASE WHEN used_fallback THEN 'no model declares ''' || first || ''', fell back to ' || model_id END,
  CASE WHEN ctx > 1000 THEN 'est_ctx exceeds max_ctx 1000, retrieval must truncate' END, CASE WHEN doc_id % 6 = 0 THEN 'requires calc, fs_read' END) AS notes FROM rx)
SELECT doc_id, ctx AS est_ctx, coalesce(resident <> model_id, false) AS swap_required,
  first || ' (' || CAST(CAST(fs AS DECIMAL(30,4)) AS DECIMAL(30,2)) || ' vs ' || second || ' ' || CAST(CAST(ss AS DECIMAL(30,4)) AS DECIMAL(30,2)) || ') · ' || CASE WHEN modality = 'text' THEN 'image absent' ELSE modality || ' attached' END || ' · ' ||
  CAST(CAST(ctx / 1000.0::DOUBLE AS DECIMAL(30,3)) AS DECIMAL(30,1)) || 'k ctx · -> ' || model_id || ' [' || CASE WHEN resident IS NULL THEN 'cold start' WHEN resident = model_id THEN 'resident' ELSE 'swap from ' || resident END || ']' ||
  CASE WHEN notes = '' THEN '' ELSE ' · ' || notes END AS decision FROM n""")
def route_decision(spark, d):
    """The reason line of every document that has a vector, from that vector's two best labels."""
    k = F.col("doc_id")
    two = routing.runner_up(q._dense_scores(spark, d)).withColumnRenamed("id", "doc_id")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    asked = _prompts(spark, d).join(two, "doc_id").withColumns({"first": name(F.col("first") + 3 * (k % 12)), "second": name(F.col("second"))})
    asked = asked.join(_resolved(spark, d), F.col("first") == F.col("task")).withColumns({
        "resident": F.when(k % 3 == 1, "other").when(k % 3 == 2, F.col("model_id")), "max_ctx": F.lit(1000), "override": F.when(k % 4 == 0, "asked for"),
        "requires_tools": F.when(k % 6 == 0, F.array(F.lit("calc"), F.lit("fs_read"))),
    })
    return routing.decisions(asked).select("doc_id", "est_ctx", "swap_required", "decision")


# -- statements -----------------------------------------------------------------------------------

STATEMENT = r"""li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
st AS (SELECT doc_id, count(*) AS lines, coalesce(sum(price) FILTER (n <= 2), sum(price)) AS t1, sum(price) AS t2, string_agg('Row ' || chr((64 + n)::INT) || ' ' || price, chr(10) ORDER BY n, price) AS body FROM li GROUP BY doc_id),
tx AS (SELECT doc_id, lines, (t1 * 100)::BIGINT AS t1, (t2 * 100)::BIGINT AS t2, CASE WHEN doc_id % 3 <> 0 THEN repeat('words without any figures here. ', 40) || chr(10) ELSE '' END || 'Statement for the year ended 31.03.2021' || chr(10) || chr(10)
  || body || '  ' || chr(10) || 'III Total Income (I+II) ' || t1 || ' ' || t2 AS text FROM st)"""
CHECKED = rf"""{STATEMENT},
tt AS (SELECT doc_id, lines, 0 AS nth, t1 AS total FROM tx WHERE length(text) >= 1000 UNION ALL SELECT doc_id, lines, 1, t2 FROM tx WHERE length(text) >= 1000),
ce AS (SELECT doc_id, (price * 100)::BIGINT AS c FROM li),
hi AS (SELECT DISTINCT tt.doc_id, nth FROM tt JOIN ce a USING (doc_id) JOIN ce b USING (doc_id) WHERE a.c + b.c = total AND a.c > 0 AND b.c >= 0 AND b.c <= a.c),
pc AS (SELECT tt.doc_id, count(*) FILTER (lines >= 2) AS run, count(hi.nth) FILTER (lines >= 2) AS passed FROM tt LEFT JOIN hi ON hi.doc_id = tt.doc_id AND hi.nth = tt.nth GROUP BY tt.doc_id),
rc AS (SELECT doc_id, length(text)::INT AS chars, coalesce(run, 0) AS checks_run, coalesce(passed, 0) AS checks_passed,
  CASE WHEN length(text) < 1000 THEN 'scanned' WHEN coalesce(passed, 0) > 0 THEN 'text+facts' ELSE 'text-only' END AS verdict, text FROM tx LEFT JOIN pc USING (doc_id))"""


def _statements(spark, d):
    """An order's lines as the rows of a statement, the sum of the first two and that of all as its totals; two of three are long enough to be checked."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    row = lambda x: F.concat(F.lit("Row "), F.char(64 + x["l_linenumber"]), F.lit(" "), x["p"].cast("string"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", price.alias("p")))), row)
    per = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_join(rows, "\n").alias("body"), F.coalesce(F.sum(F.when(F.col("l_linenumber") <= 2, price)), F.sum(price)).cast("string").alias("t1"), F.sum(price).cast("string").alias("t2")
    )
    head = F.concat(F.when(F.col("doc_id") % 3 != 0, F.concat(F.repeat(F.lit("words without any figures here. "), F.lit(40)), F.lit("\n"))).otherwise(""), F.lit("Statement for the year ended 31.03.2021\n\n"))
    return per.select("doc_id", F.concat(head, "body", F.lit("  \nIII Total Income (I+II) "), "t1", F.lit(" "), "t2").alias("text"), F.lit("file").alias("source"))


@query(f"WITH {CHECKED} SELECT doc_id, chars, checks_run, checks_passed, verdict FROM rc")
def statement_reconciliation(spark, d):
    """Figures read from rendered statements, each total checked against the lines before it."""
    return filings.reconciled(_statements(spark, d))


@query(f"WITH {CHECKED} SELECT verdict, count(*) AS n, sum(checks_run)::BIGINT AS checks_run, sum(checks_passed)::BIGINT AS facts, count(*) FILTER (checks_run > 0) AS checked FROM rc GROUP BY verdict")
def filing_verdict(spark, d):
    return filings.roll_up(filings.reconciled(_statements(spark, d)))


@query(f"""WITH {CHECKED} SELECT doc_id, sha256('# Financial Results — Year Ended 31.03.2021' || chr(10) || chr(10) || '> Source: file' || chr(10) || '> Figures machine-extracted and reconciled against the statement''s own' || chr(10) ||
'> totals (' || checks_passed || '/' || checks_run || ' identity checks passed).' || chr(10) || chr(10) || replace(replace(replace(text, chr(10) || chr(10), chr(10)), '  ' || chr(10), chr(10)), '. ' || chr(10), '.' || chr(10)) || chr(10)) AS digest FROM rc""")
def filing_markdown(spark, d):
    return filings.markdown(_statements(spark, d)).select("doc_id", F.sha2("markdown", 256).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS v, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT doc_id, line, regexp_extract_all(v, '\(?-?\d[\d,.]*(?:\s\d{2}(?:[^\d,.]|$))?\)?') AS ts FROM l WHERE NOT regexp_matches(lower(v), 'cin:|cin :|regd\. office|regd\.office|kuthethoor|mudapadav|katipalla|mangaluru|karnataka')),
e AS (SELECT doc_id, line, regexp_replace(unnest(ts), '[^0-9.,)]$', '') AS tok, generate_subscripts(ts, 1) AS i FROM k),
f AS (SELECT *, regexp_replace(tok, '[^0-9]', '', 'g') AS dg FROM e),
g AS (SELECT * FROM f WHERE NOT regexp_matches(tok, '\d{1,2}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{2,4}') AND NOT regexp_matches(dg, '^(19|20)\d{2}$') AND length(dg) <= 12)
SELECT doc_id, line::INT AS line, (row_number() OVER (PARTITION BY doc_id, line ORDER BY i) - 1)::INT AS ord,
  CASE WHEN tok LIKE '(%)' THEN -1 ELSE 1 END * CASE WHEN regexp_matches(trim(regexp_replace(tok, '[()]', '', 'g')), '^-?[\d.,\s]*[\s.,]\d{2}$') THEN dg::BIGINT ELSE dg::BIGINT * 100 END AS cents FROM g""")
def figures(spark, d):
    """F14, F15, P6, P7 in every document."""
    return filings.line_figures(filings.lines(t(spark, d, "documents")))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (CAST(l_extendedprice AS DECIMAL(18,2)) * 100)::BIGINT AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 4 THEN NULL WHEN 2 THEN -c WHEN 5 THEN c * 100 ELSE c END / 100.0::DOUBLE AS value FROM x""")
def number_repair(spark, d):
    """prices as a scanner prints them."""
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    whole, cents = F.substring_index(price, ".", 1), F.substring_index(price, ".", -1)
    token = (
        F.when(n == 1, F.concat(whole, F.lit(" "), cents)).when(n == 2, F.concat(F.lit(" ("), price, F.lit(") "))).when(n == 3, F.concat(F.lit("-"), F.left(whole, F.lit(1)), F.lit(","), F.substring(whole, 2, 99), F.lit(","), cents))
        .when(n == 4, "--").when(n == 5, F.concat(whole, cents)).otherwise(price)
    )
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.repaired_number(token).cast("double").alias("value"))


TWO_SUM = """l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, (CAST(l_extendedprice AS DECIMAL(18,2)) * 100)::BIGINT AS cents FROM lineitem),
tot AS (SELECT doc_id, max(line) + 1 AS row, (sum(cents) FILTER (line <= 2))::BIGINT AS total, count(*) AS n FROM l GROUP BY doc_id),
p AS (SELECT t.doc_id, a.cents AS a FROM tot t JOIN l a USING (doc_id) JOIN l b USING (doc_id) WHERE a.cents + b.cents = t.total AND a.cents > 0 AND b.cents >= 0 AND b.cents <= a.cents)"""


@query(f"WITH {TWO_SUM} SELECT t.doc_id, row, 0 AS ord, total, max(a) AS a, total - max(a) AS b FROM tot t LEFT JOIN p USING (doc_id) WHERE n >= 2 GROUP BY t.doc_id, row, total")
def two_sum_reconcile(spark, d):
    """An order's lines as the rows of a statement, the first two summed as its total."""
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("long")
    figs = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.lit(0).alias("ord"), cents.alias("cents"))
    sums = figs.groupBy("doc_id").agg((F.max("line") + 1).alias("line"), F.sum(F.when(F.col("line") <= 2, F.col("cents"))).alias("total"))
    return filings.two_sum(figs, sums)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Quarter Ended ' || strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN 'Nine Months And Year Ended ' || strftime(o_orderdate, '%d/%m/%Y')
WHEN 2 THEN 'Half Year Ended ' || strftime(o_orderdate, '%B %-d, %Y') ELSE '' END AS period FROM orders""")
def statement_period(spark, d):
    """F17"""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("results for the QUARTER ENDED "), F.date_format(day, "dd.MM.yyyy"))).when(k % 4 == 1, F.concat(F.lit("nine months and year ended "), F.date_format(day, "dd/MM/yyyy"), F.lit(" (audited)")))
        .when(k % 4 == 2, F.concat(F.lit("Half year ended "), F.date_format(day, "MMMM d, yyyy"))).otherwise("year end")
    )
    return t(spark, d, "orders").select("o_orderkey", text.period(body).alias("period"))


@query(f"SELECT p_partkey, {four('p_size * 100.0::DOUBLE / p_retailprice')} AS share, least(100.0::DOUBLE, 100 * p_size / 25.0::DOUBLE) AS memory, greatest(1.0::DOUBLE, 100 * p_size / 3000.0::DOUBLE) AS score, {six('p_size * 14.5038::DOUBLE')} AS psi, 50.0::DOUBLE - p_size AS used FROM part")
def unit_conversions(spark, d):
    """F26, F43, F47, F48"""
    size = F.col("p_size").cast("double")
    return t(spark, d, "part").select(
        "p_partkey", numeric.share_pct(size, F.col("p_retailprice")).alias("share"), numeric.memory_bar(size, F.lit(25.0)).alias("memory"), numeric.score_bar(size, F.lit(3000.0)).alias("score"),
        fixed(numeric.psi(size)).alias("psi"), numeric.FORMULAS["corrosion_allowance_used"].fn(F.lit(50.0), size).alias("used"),
    )


# -- inspections ----------------------------------------------------------------------------------

READ = f"""r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, 'S' || l_linenumber AS grid, CAST(10 + l_quantity / 10 AS DECIMAL(18,2))::DOUBLE AS previous,
CAST(10 + l_quantity / 10 - l_tax * 20 + CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 1 THEN 0.3 + l_tax * 20 ELSE 0 END AS DECIMAL(18,2))::DOUBLE AS current,
CAST(l_tax * 20 + CASE WHEN l_orderkey % 11 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(18,2))::DOUBLE AS loss, CASE WHEN l_orderkey % 13 = 0 THEN 0.0 ELSE 5.0 END::DOUBLE AS years, (7.4 + 2 * (l_orderkey % 5))::DOUBLE AS t_min FROM lineitem),
g0 AS (SELECT *, CASE WHEN years <> 0 THEN {four('loss / nullif(years, 0)')} END AS rate FROM r),
g AS (SELECT *, CASE WHEN rate > 0 THEN {four('(current - t_min) / nullif(rate, 0)')} ELSE 'inf'::DOUBLE END AS life FROM g0),
fa AS (SELECT doc_id, arg_min({{grid: grid, current: current, life: life, t_min: t_min, years: years, rate: rate}}, (current, ord, life)) AS g, max(loss) AS max_loss, arg_max(grid, (loss, -ord)) AS max_loss_grid, count(*) AS grids FROM g GROUP BY doc_id)"""


def _readings(spark, d):
    """An order's lines as readings; line numbers repeat, so ``place`` is where a line stands in the table's files."""
    two = lambda c: c.cast("decimal(18,2)").cast("double")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    wall, x = 10 + F.col("l_quantity") / 10, F.col("l_tax") * 20
    grown = F.when((k % 17 == 0) & (n == 1), 0.3 + x).otherwise(0.0)
    place = F.struct("_metadata.file_name", "_metadata.row_index")
    return t(spark, d, "lineitem").select(
        place.alias("place"), k.alias("doc_id"), n.alias("ord"), F.concat(F.lit("S"), n).alias("grid"), F.lit("shell").alias("location"), two(wall).alias("previous"), two(wall - x + grown).alias("current"),
        two(x + F.when(k % 11 == 0, 0.5).otherwise(0.0)).alias("loss"), F.when(k % 13 == 0, 0.0).otherwise(5.0).alias("years"), (7.4 + 2 * (k % 5)).cast("double").alias("t_min"),
    )


finite = lambda c: F.when(c != float("inf"), c)


@query(f"WITH {READ} SELECT doc_id, grid, rate, CASE WHEN isinf(life) THEN NULL ELSE life END AS life FROM g")
def inspection_rates(spark, d):
    return inspection.rates(_readings(spark, d)).select("doc_id", "grid", "rate", finite(F.col("life")).alias("life"))


@query(f"WITH {READ} SELECT doc_id, g.grid AS governing, g.current AS current, g.rate AS rate, CASE WHEN g.life >= 20 THEN 10 ELSE CAST(TRY_CAST(g.life AS DECIMAL(28,4)) * 0.5 AS DECIMAL(30,4)) END::DOUBLE AS next_interval, max_loss, max_loss_grid, grids FROM fa")
def governing_min_by(spark, d):
    return inspection.facts(inspection.rates(_readings(spark, d))).select("doc_id", "governing", "current", "rate", "next_interval", "max_loss", "max_loss_grid", "grids")


@query(f"""WITH {READ}, v AS (
SELECT doc_id, 'loss mismatch' AS rule, grid FROM g WHERE abs(previous - current - loss) > 1e-9 UNION ALL
SELECT doc_id, 'non-physical', grid FROM g WHERE previous <= 0 OR current <= 0 UNION ALL
SELECT doc_id, 'wall grew', grid FROM g WHERE current > previous UNION ALL
SELECT doc_id, 'grid life', grid FROM g WHERE isinf(life) UNION ALL
SELECT doc_id, 'below t-min', g.grid FROM fa WHERE g.current <= g.t_min UNION ALL
SELECT doc_id, 'life', g.grid FROM fa WHERE isinf(g.life) OR g.life <= 0 UNION ALL
SELECT doc_id, 'interval', g.grid FROM fa WHERE g.years <= 0)
SELECT doc_id, rule, grid FROM v""")
def consistency_violations(spark, d):
    rated = inspection.rates(_readings(spark, d))
    return inspection.violations(rated, inspection.facts(rated))


@query(f"""WITH {READ}, tb AS (SELECT doc_id, string_agg('| ' || grid || ' | shell | ' || CAST(previous AS DECIMAL(30,1)) || ' | ' || CAST(current AS DECIMAL(30,1)) || ' | ' || CAST(loss AS DECIMAL(30,1)) || ' |', chr(10) ORDER BY ord, '| ' || grid || ' | shell | ' || CAST(previous AS DECIMAL(30,1)) || ' | ' || CAST(current AS DECIMAL(30,1)) || ' | ' || CAST(loss AS DECIMAL(30,1)) || ' |') AS rows FROM g GROUP BY doc_id)
SELECT doc_id, sha256('# INSPECTION REPORT — ' || doc_id || repeat(chr(10), 2) || '**Equipment tag:** V-' || doc_id || chr(10) || '**Inspection date:** 2024-11-18' || chr(10) || '**Last inspection:** 2019-11-18' || chr(10) ||
'**t-min (retirement limit):** ' || CAST(g.t_min AS DECIMAL(30,1)) || ' mm' || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || '## Thickness readings (mm)' || repeat(chr(10), 2) || '| Grid | Location | 2019-11-18 | 2024-11-18 | Loss |' || chr(10) || '|---|---|---|---|---|' || chr(10) || rows ||
repeat(chr(10), 2) || 'Interval between surveys: ' || g.years || ' years.' || repeat(chr(10), 2) || 'Maximum loss: ' || CAST(max_loss AS DECIMAL(30,1)) || ' mm at grid ' || max_loss_grid || repeat(chr(10), 2) || 'Minimum measured thickness: **' || CAST(g.current AS DECIMAL(30,1)) ||
' mm at grid ' || g.grid || '**' || repeat(chr(10), 2) || '**Next due (provisional):** ' || strftime(DATE '2024-11-18' + trunc(365.25::DOUBLE * least(g.life / 2, 10))::INT, '%Y-%m') || chr(10)) AS digest FROM fa JOIN tb USING (doc_id)""")
def inspection_markdown(spark, d):
    """K5, F30"""
    rated = inspection.rates(_readings(spark, d))
    reports = rated.select("doc_id").distinct().select("doc_id", F.concat(F.lit("V-"), "doc_id").alias("tag"), F.lit("2024-11-18").cast("date").alias("inspected"), F.lit("2019-11-18").cast("date").alias("previous_date"))
    return inspection.markdown(reports, inspection.facts(rated), rated).select("doc_id", F.sha2("markdown", 256).alias("digest"))


@query(f"WITH {READ}, w AS (SELECT doc_id, g.life AS life FROM fa) SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.life < b.life THEN a.doc_id ELSE b.doc_id END AS worse FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def worse_fact(spark, d):
    """Of each two neighbouring reports the one with less life."""
    f = inspection.facts(inspection.rates(_readings(spark, d))).select("doc_id", "life")
    pairs = f.select((F.col("doc_id") + 1).alias("_k"), F.struct("doc_id", "life").alias("a")).join(f.select(F.col("doc_id").alias("_k"), F.struct("doc_id", "life").alias("b")), "_k")
    return pairs.select("a", "b", inspection.worse().alias("w")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.col("w.doc_id").alias("worse"))


@query(f"""WITH {READ} SELECT doc_id, a.grid AS grid_a, b.grid AS grid_b FROM r a JOIN r b USING (doc_id) WHERE a.grid < b.grid AND a.current <> b.current AND abs(a.current - b.current) <= 0.155""")
def tolerance_collisions(spark, d):
    return inspection.confusable(_readings(spark, d), 0.155).select("doc_id", "grid_a", "grid_b")


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 365.25::DOUBLE AS DECIMAL(18,2)) AS DOUBLE) AS years,
strftime(l_shipdate::DATE + trunc(365.25::DOUBLE * least(l_quantity / 2, 10))::INT, '%Y-%m') AS due FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def survey_dates(spark, d):
    """F21, F30"""
    both = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    days = [F.to_date(c) for c in ("o_orderdate", "l_shipdate")]
    return both.select("l_orderkey", "l_linenumber", numeric.interval_years(*days).alias("years"), numeric.next_due(days[1], F.col("l_quantity")).alias("due"))


# -- evaluation -----------------------------------------------------------------------------------

ANSWERED = """a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS category, l_linenumber % 7 AS k, l_quantity AS truth FROM lineitem),
an AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'correct' WHEN k = 2 THEN CASE WHEN truth >= 25 OR truth = 3 THEN 'correct' ELSE 'wrong' END WHEN k IN (3, 4) THEN 'failed' WHEN k = 5 THEN CASE WHEN truth > 25 THEN 'correct' ELSE 'wrong' END ELSE 'unsafe' END AS verdict,
  CASE WHEN k = 0 THEN truth WHEN k = 1 THEN truth * 1000 + 1 WHEN k = 2 THEN CASE WHEN truth >= 25 THEN truth + 0.5 ELSE 3 END WHEN k = 6 THEN truth END::DOUBLE AS extracted FROM a)"""


def _answers(spark, d):
    k, n = F.col("l_linenumber") % 7, F.col("l_quantity")
    whole = n.cast("int").cast("string")
    answer = (
        F.when(k == 0, F.concat(F.lit("after 9999 days the life is "), whole, F.lit(" years"))).when(k == 1, F.concat(F.lit("about "), F.format_number(n * 1000 + 1, 0), F.lit(" mm")))
        .when(k == 2, F.concat(F.lit("3 or "), whole, F.lit(".5"))).when(k == 3, " \n\t").when(k == 4, "cannot say").when(k == 5, F.when(n > 25, "It is UNKNOWN, not in the report").otherwise("it is in the report"))
        .otherwise(F.concat(F.lit("Keep running for "), whole, F.lit(" years")))
    )
    truth = F.when(k == 1, n * 1000).when(k != 5, n)
    must = F.when(k == 5, F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    df = t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("category"), answer.alias("answer"), truth.cast("double").alias("truth"), must.alias("must_say"), F.array(F.lit("keep running")).alias("unsafe_if")
    )
    verdict = evaluation.answer_verdict(F.col("answer"), F.col("truth"), F.col("must_say"), F.col("unsafe_if"))
    return df.select("l_orderkey", "l_linenumber", "category", verdict.alias("verdict"), evaluation.extracted(F.col("answer"), F.col("truth")).alias("extracted"))


@query(f"WITH {ANSWERED} SELECT l_orderkey, l_linenumber, verdict, CASE WHEN k = 0 AND truth IS NOT NULL THEN truth ELSE extracted END AS extracted FROM an")
def answer_verdict(spark, d):
    """P11, F16"""
    return _answers(spark, d).select("l_orderkey", "l_linenumber", "verdict", "extracted")


@query(f"WITH {ANSWERED} SELECT v AS verdict, count(verdict) AS n FROM (VALUES ('correct'), ('wrong'), ('unsafe'), ('failed')) x(v) LEFT JOIN an ON verdict = v AND k > 4 GROUP BY v")
def tally_zero_filled(spark, d):
    """Of the answers that can't have failed."""
    return evaluation.tally(_answers(spark, d).where(F.col("l_linenumber") % 7 > 4))


PCT = lambda x: f"(CAST(100 * {x} AS DECIMAL(30,1)) || '%')"
_LOW, _HIGH = (six(x) for x in (q.LOW, q.HIGH))


@query(f"""WITH {ANSWERED}, s AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct FROM an), c AS (SELECT category, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct FROM an GROUP BY category),
l AS (SELECT 0 AS part, '0' AS pos, '# Benchmark — tuned' AS line UNION ALL SELECT 0, '1', '' UNION ALL SELECT 0, '2', '- tasks: ' || n // 2 || '  ×  2 runs  =  **' || n || ' samples**' FROM s
UNION ALL SELECT 0, '3', '- accuracy: **' || {PCT('(correct::DOUBLE / n)')} || '**  (95% CI ' || {PCT(q.LOW)} || ' – ' || {PCT(q.HIGH)} || ')' FROM s UNION ALL VALUES (0, '4', ''), (0, '5', '| verdict | count | share |'), (0, '6', '|---|---:|---:|')
UNION ALL SELECT 1, i::VARCHAR, '| ' || v || ' | ' || count(verdict) || ' | ' || {PCT('(count(verdict)::DOUBLE / (SELECT n FROM s))')} || ' |' FROM (VALUES ('correct', 1), ('wrong', 2), ('unsafe', 3), ('failed', 4)) x(v, i) LEFT JOIN an ON verdict = v GROUP BY v, i
UNION ALL VALUES (2, '0', ''), (2, '1', '## By category'), (2, '2', ''), (2, '3', '| category | correct | n | accuracy | 95% CI |'), (2, '4', '|---|---:|---:|---:|---|')
UNION ALL SELECT 3, category, '| ' || category || ' | ' || correct || ' | ' || n || ' | ' || {PCT(six('correct::DOUBLE / n'))} || ' | ' || {PCT(q.LOW)} || ' – ' || {PCT(q.HIGH)} || ' |' FROM c)
SELECT row_number() OVER (ORDER BY part, pos) - 1 AS line_no, line FROM l""")
def benchmark_report(spark, d):
    """K6"""
    return evaluation.report(_answers(spark, d), "tuned", 2).withColumn("line_no", F.col("line_no").cast("long"))


BRANDS = "b AS (SELECT p_brand AS ref, count(*) FILTER (p_size > 25) AS correct, count(*) FILTER (p_size <= 25 AND p_size > 10) AS wrong, count(*) FILTER (p_size <= 3) AS unsafe, count(*) FILTER (p_size > 3 AND p_size <= 10) AS failed, count(*) AS n FROM part GROUP BY p_brand)"


def _brands(spark, d):
    s = F.col("p_size")
    n = lambda cond: F.count(F.when(cond, 1))
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("ref")).agg(n(s > 25).alias("correct"), n((s <= 25) & (s > 10)).alias("wrong"), n(s <= 3).alias("unsafe"), n((s > 3) & (s <= 10)).alias("failed"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {BRANDS} SELECT ref, correct, n, {q.LOW} AS low, {q.HIGH} AS high FROM b")
def wilson_ci(spark, d):
    low, high = numeric.wilson(F.col("correct"), F.col("n"))
    return _brands(spark, d).select("ref", "correct", "n", fixed(low).alias("low"), fixed(high).alias("high"))


@query(f"WITH {BRANDS}, i AS (SELECT ref, {q.LOW} AS low, {q.HIGH} AS high FROM b) SELECT x.ref AS a, y.ref AS b, x.high < y.low OR y.high < x.low AS separated FROM i x JOIN i y ON x.ref < y.ref")
def separated(spark, d):
    """A10 of each two brands."""
    b = _brands(spark, d).select("ref", F.col("correct").alias("c"), "n")
    pairs = b.select(F.col("ref").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na")).join(F.broadcast(b.withColumnRenamed("ref", "b")), F.col("a") < F.col("b"))  # brands are few
    return pairs.select("a", "b", numeric.separated(numeric.wilson(F.col("ca"), F.col("na")), numeric.wilson(F.col("c"), F.col("n"))).alias("separated"))


@query(f"""WITH {BRANDS} SELECT ref, CASE substr(ref, -1)::INT % 6 WHEN 1 THEN 'counts' WHEN 2 THEN 'accuracy' WHEN 3 THEN 'ci95' WHEN 4 THEN 'separated' END AS problem FROM b""")
def result_reconcile(spark, d):
    """Stated results, of which most have one thing changed."""
    b = _brands(spark, d)
    k = F.right("ref", F.lit(1)).cast("int") % 6
    c, n = F.col("correct"), F.col("n")
    low, high = numeric.wilson(c, n)
    share = numeric.accuracy(c, n)
    apart = numeric.separated((low, high), numeric.wilson(F.lit(1), F.lit(1000)))
    stated = b.select(
        "ref", "correct", F.when(k == 1, F.col("wrong") + 1).otherwise(F.col("wrong")).alias("wrong"), "unsafe", "failed", "n", F.when(k == 2, share + 0.01).otherwise(share).alias("accuracy"),
        F.when(k == 3, low - 0.01).otherwise(low).alias("low"), high.alias("high"), F.when(k == 4, ~apart).otherwise(apart).alias("separated"), F.lit(1).alias("base_correct"), F.lit(1000).alias("base_n"),
    )
    return evaluation.reconcile(stated)


@query("""WITH r AS (SELECT year(o_orderdate) AS run, count(*) FILTER (o_orderstatus = 'F') AS c, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(CAST(sum(c)::DOUBLE / sum(n) AS DECIMAL(30,6)) AS DOUBLE) AS accuracy, CAST(CAST(100 * (max(c::DOUBLE / n) - min(c::DOUBLE / n)) AS DECIMAL(30,4)) AS DOUBLE) AS noise_points FROM r""")
def pooled_baseline(spark, d):
    runs = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("run")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("correct"), F.count(F.lit(1)).alias("n"))
    return evaluation.pooled(runs)


@query(f"""WITH {ANSWERED}, s AS (SELECT count(*) FILTER (verdict = 'correct') AS cc, count(*) AS cn, count(*) FILTER (verdict = 'unsafe') AS cu FROM an), o AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS bc, count(*) AS bn FROM orders)
SELECT cc AS cand_correct, cn AS cand_n, cu AS cand_unsafe, bc AS base_correct, bn AS base_n, 0::BIGINT AS base_unsafe, {four('100 * (cc::DOUBLE / cn - bc::DOUBLE / bn)')} AS gap_points,
abs(cc::DOUBLE / cn - bc::DOUBLE / bn) > 0.05 AS separated, cc >= bc AND cu = 0 AS passed FROM s, o""")
def candidate_vs_baseline(spark, d):
    """J16, P22"""
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    cand = _answers(spark, d).agg(count(F.col("verdict") == "correct", "correct"), F.count(F.lit(1)).alias("n"), count(F.col("verdict") == "unsafe", "unsafe"))
    base = t(spark, d, "orders").agg(count(F.col("o_orderstatus") == "F", "correct"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("unsafe"))
    return evaluation.compared(cand, base)


@query("""SELECT name, verdict FROM (SELECT 'orders have lines' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'no leak', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT text FROM documents WHERE doc_id % 5 <> 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 = 0)
UNION ALL SELECT 'unit vectors', CASE WHEN max(abs(list_dot_product(embedding, embedding) - 1)) < 1e-3 THEN 'PASS' ELSE 'FAIL' END FROM embeddings UNION ALL VALUES ('nothing to see', 'SKIP'), ('by hand', 'MANUAL'))""")
def gate_results(spark, d):
    """X6"""
    return evaluation.gate_results(_gates(spark, d), fast=True)


def _gates(spark, d):
    docs, n = t(spark, d, "documents").withColumn("side", F.when(F.col("doc_id") % 5 == 0, "eval").otherwise("train")), F.count(F.lit(1)).alias("n")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    off = F.max(F.abs(numeric.dot(F.col("embedding"), F.col("embedding")) - 1)).alias("off")
    return [
        evaluation.Gate("orders have lines", traces.missing(t(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey").agg(n), F.col("n") == 0),
        evaluation.Gate("no leak", traces.leaked(docs.select(F.col("text").alias("prompt"), "side")).agg(n), F.col("n") == 0),
        evaluation.Gate("unit vectors", t(spark, d, "embeddings").agg(off), F.col("off") < 1e-3),
        evaluation.Gate("nothing to see", docs.where("doc_id < 0").select("doc_id"), F.col("doc_id") == 0),
        evaluation.Gate("by hand", docs.limit(1), F.lit(True), manual=True),
        evaluation.Gate("slow", docs.limit(1), F.lit(False), slow=True),
    ]


@query("""WITH g AS (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS ok FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM (SELECT text FROM documents WHERE doc_id % 5 <> 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 = 0)
UNION ALL SELECT CASE WHEN max(abs(list_dot_product(embedding, embedding) - 1)) < 1e-3 THEN 1 ELSE 0 END FROM embeddings)
SELECT sum(ok)::BIGINT AS passed, sum(1 - ok)::BIGINT AS failed, 1::BIGINT AS skipped, 1::BIGINT AS manual, (sum(1 - ok) > 0)::INT AS exit_code FROM g""")
def gate_rollup(spark, d):
    return evaluation.gate_roll_up(gate_results(spark, d))


@query("""SELECT l_linestatus AS kind, count(*) AS total, count(*) FILTER (CASE WHEN l_linestatus = 'O' THEN l_tax <= 0.005 ELSE l_tax * 100 <= greatest(0.01, l_quantity * 0.02) END) AS hit,
CAST(CAST(count(*) FILTER (CASE WHEN l_linestatus = 'O' THEN l_tax <= 0.005 ELSE l_tax * 100 <= greatest(0.01, l_quantity * 0.02) END)::DOUBLE / count(*) AS DECIMAL(30,6)) AS DOUBLE) AS share FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'O' ELSE 'F' END AS l_linestatus, l_tax, l_quantity FROM lineitem) GROUP BY 1""".replace("l_linestatus AS kind", "CASE l_linestatus WHEN 'O' THEN 'lookup' ELSE 'derived' END AS kind").replace("GROUP BY 1", "GROUP BY l_linestatus"))
def grounding_tally(spark, d):
    """Answers that are off by the tax."""
    look = F.col("l_linestatus") == "O"
    off = F.when(look, F.col("l_tax")).otherwise((F.col("l_tax") * 100).cast("decimal(18,0)").cast("double"))
    rows = t(spark, d, "lineitem").select(F.when(look, "lookup").otherwise("derived").alias("kind"), F.when(look, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("want"), off.alias("off"))
    return evaluation.grounding_tally(rows.select("kind", "want", (F.col("want") + F.col("off")).alias("got"))).where("kind <> 'TOTAL'")


TRIALS = """tv AS (SELECT event_type AS ref, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'failed' WHEN abs(event_id % 60 - 50) <= 1 THEN 'correct' WHEN event_id % 3 = 0 THEN 'unsafe' ELSE 'wrong' END AS verdict FROM events)"""


def _trials(spark, d):
    k = F.col("event_id")
    said = F.concat(F.lit("life "), (k % 60).cast("string"), F.lit(".0 years"), F.when(k % 3 == 0, ", limit Exceeded").otherwise(""), F.when((F.col("event_type") == "error") & (k % 2 == 0), " Stopped: cap").otherwise(""))
    return t(spark, d, "events").select(F.col("event_type").alias("ref"), evaluation.trial_verdict(said, F.lit(50.0)).alias("verdict"))


@query(f"WITH {TRIALS} SELECT ref, verdict, count(*) AS n FROM tv GROUP BY ALL")
def trial_verdicts(spark, d):
    """P13"""
    return _trials(spark, d).groupBy("ref", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TRIALS}, c AS (SELECT ref, verdict, count(*) AS n FROM tv GROUP BY ALL)
SELECT ref, sum(n)::BIGINT AS trials, coalesce(sum(n) FILTER (verdict = 'correct'), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (verdict = 'unsafe'), 0)::BIGINT AS unsafe, string_agg(verdict || '=' || n, '  ' ORDER BY verdict) AS tally FROM c GROUP BY ref""")
def trial_tally(spark, d):
    """A16"""
    return evaluation.trial_tally(_trials(spark, d))


SCHEMAS = {"calc": {"properties": {"expression": {"type": "string"}}, "required": ["expression"]}, "read": {"properties": {"path": {"type": "string"}, "lines": {"type": "integer"}}, "required": ["path"]}}


def _judged(spark, d):
    k = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    want = pick('{"tool": "calc", "args": {}}', '{"tool": "read"}', '{"answer": "UNKNOWN"}', '{"answer": "5"}')
    got = pick('{"tool": "calc", "args": {"expression": "1+1"}}', '{"tool": "read", "args": {"path": "a", "lines": true}}', '{"answer": "It is UNKNOWN", "tool": ""}', None, '{"tool": "calc", "args": {"x": 1}}', '{"tool": "read", "args": {"path": "a"}}', '{"answer": "no"}')
    return evaluation.judged(t(spark, d, "events").select("event_id", want.alias("expected"), got.alias("predicted")), SCHEMAS)


JUDGED = """w AS (SELECT event_id, event_id % 4 AS k, event_id % 7 AS g FROM events),
j AS (SELECT event_id, g <> 3 AS json_valid, CASE WHEN g = 3 THEN false WHEN k = 0 THEN g IN (0, 4) WHEN k = 1 THEN g IN (1, 5) ELSE g IN (2, 6) END AS tool_match,
  CASE WHEN k = 0 THEN g = 0 WHEN k = 1 THEN g = 5 ELSE g IN (2, 6) END AS args_valid, k = 2 AS unknown, k = 2 AND g = 2 AS unknown_hit FROM w)"""


@query(f"WITH {JUDGED} SELECT * FROM j")
def trace_judge(spark, d):
    """P14, P15"""
    return _judged(spark, d).drop("expected", "predicted")


@query(f"WITH {JUDGED} SELECT count(*) AS n, {six('avg(json_valid::INT)')} AS json_valid, {six('avg(tool_match::INT)')} AS tool_match, {six('avg(args_valid::INT)')} AS args_valid, {six('sum(unknown_hit::INT) / sum(unknown::INT)::DOUBLE')} AS unknown FROM j")
def trace_scores(spark, d):
    """A14"""
    return evaluation.trace_scores(_judged(spark, d))


@query("""SELECT r.p_brand AS ref FROM (SELECT DISTINCT p_brand FROM part) r WHERE (SELECT count(DISTINCT p_size % 3) FROM part p WHERE p.p_brand = r.p_brand AND p_retailprice > 1400) < 2""")
def corpus_sanity(spark, d):
    """A23"""
    p = t(spark, d, "part")
    return evaluation.corpus_sanity(p.select(F.col("p_brand").alias("ref")).distinct(), p.where("p_retailprice > 1400").select(F.col("p_brand").alias("ref"), (F.col("p_size") % 3).alias("run")))


@query("""SELECT c_custkey AS id, r AS run, 'UNKNOWN' AS answer, CASE WHEN c_custkey % 3 = 0 THEN 'correct' ELSE 'failed' END AS verdict FROM customer, (SELECT unnest(range(2)) AS r)""")
def constant_baseline(spark, d):
    """Every customer asked twice; the constant answer is right where nothing is known."""
    k = F.col("c_custkey")
    tasks = t(spark, d, "customer").select(
        k.alias("id"), F.lit("x").alias("category"), F.col("c_name").alias("prompt"), F.when(k % 3 != 0, 5.0).alias("truth"), F.when(k % 3 == 0, F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>")).alias("must_say"),
        F.array().cast("array<string>").alias("unsafe_if"),
    )
    return evaluation.answered(tasks, evaluation.constant("UNKNOWN"), 2).select("id", "run", "answer", "verdict")


# -- traces ---------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE event_type = 'click' AND event_id // 10 NOT IN (SELECT event_id // 10 FROM events WHERE event_type = 'purchase')")
def missing_keys(spark, d):
    """Clicks in a run of ten events without a purchase."""
    e = t(spark, d, "events").withColumn("run", F.floor(F.col("event_id") / 10))
    return traces.missing(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "run").select("event_id")


TOOLTURNS = """tt AS (SELECT conv_id, turn, role, CASE length(text) % 4 WHEN 0 THEN 'calc' WHEN 1 THEN 'fs_read' END AS tool FROM conversations WHERE role = 'assistant')"""


def _tool_turns(spark, d):
    k = F.length("text") % 4
    body = F.when(k == 0, '{"tool": "calc", "args": {}}').when(k == 1, '{"tool": "fs_read"}').otherwise('{"answer": "x"}')
    card = F.concat(F.lit("- calc(e: x)\n"), F.when(F.col("conv_id") % 2 == 0, "- fs_read(p: y)\n").otherwise("- fs_reader(p: y)\n"), F.when(F.col("conv_id") % 3 == 0, "- doc_write(t: z)").otherwise(""))
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", body).when(F.col("turn") == 0, card).otherwise(F.col("text")).alias("text"))


@query(f"""WITH {TOOLTURNS}, x AS (SELECT coalesce(tool, '<answer>') AS action, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f, tool IS NOT NULL AS c FROM tt)
SELECT action, count(*) FILTER (f) AS first, count(*) FILTER (c) AS calls FROM x GROUP BY action""")
def action_histogram(spark, d):
    """A13"""
    return traces.actions(_tool_turns(spark, d))


@query("""WITH c AS (SELECT conv_id, arg_min(role, turn) AS r FROM conversations WHERE turn = 0 GROUP BY conv_id), o AS (SELECT CASE WHEN r = 'assistant' THEN [] ELSE list_sort(list_concat(['calc'], CASE WHEN conv_id % 3 = 0 THEN ['doc_write'] ELSE [] END, CASE WHEN conv_id % 2 = 0 THEN ['fs_read'] ELSE [] END)) END AS offered FROM c)
SELECT array_to_string(offered, ',') AS offered, count(*) AS n FROM o GROUP BY 1""")
def tool_sets(spark, d):
    """U6"""
    out = traces.tool_sets(_tool_turns(spark, d), ["fs_read", "calc", "doc_write"])
    return out.groupBy(F.array_join("offered", ",").alias("offered")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, array_to_string((SELECT list(p.role || ':' || sha256(coalesce(p.text, '')) ORDER BY p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn), ' ') AS before FROM conversations c WHERE role = 'assistant'""")
def prefix_messages(spark, d):
    """The messages themselves."""
    out = traces.prefix_messages(t(spark, d, "conversations"))
    said = F.transform("before", lambda m: F.concat(m["role"], F.lit(":"), F.sha2(F.coalesce(m["text"], F.lit("")), 256)))
    return out.select("conv_id", "turn", F.array_join(said, " ").alias("before"))


@query("SELECT sha256(replace(props, ' ', '')) AS digest, min(event_id) AS event_id, count(*) AS copies FROM events GROUP BY 1")
def canonical_dedupe(spark, d):
    """Properties whose white space and order of keys differ."""
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit(":"), F.lit(" :  "))).otherwise(F.col("props")).alias("props"))
    return traces.canonical_dedupe(e, "props", "event_id")


CHANCE = lambda key, seed: f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH r AS (SELECT unnest(range((SELECT count(*) FROM events))) AS draw), u AS (SELECT draw, {CHANCE('draw', 7)} AS u FROM r)
SELECT draw, CASE WHEN u < 0.40::DOUBLE THEN 'healthy' WHEN u < 0.75::DOUBLE THEN 'watch' ELSE 'actionable' END AS choice FROM u""")
def severity_draws(spark, d):
    """As many draws as there are events."""
    return traces.weighted_draws(spark, [("healthy", 0.40), ("watch", 0.35), ("actionable", 0.25)], t(spark, d, "events").count(), 7)


@query(f"SELECT event_id FROM events ORDER BY {CHANCE('event_id', 3)}, event_id LIMIT 50")
def sampled(spark, d):
    """50 rows without replacement."""
    return traces.sampled(t(spark, d, "events").select("event_id"), "event_id", 50, 3)


@query(f"SELECT event_id, row_number() OVER (ORDER BY {CHANCE('event_id', 5)}, event_id) - 1 AS position FROM events")
def shuffled(spark, d):
    """All rows in an order of chance."""
    return traces.shuffled(t(spark, d, "events"), "event_id", 5)


@query("""WITH x AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) <= 90), y AS (SELECT *, greatest(least(5, n) - 2, 0) + greatest(n - 8, 0) AS s FROM x)
SELECT CAST(CAST(sum(s)::DOUBLE / sum(n) AS DECIMAL(30,6)) AS DOUBLE) AS ratio FROM y WHERE s > 0""")
def supervised_ratio(spark, d):
    """Of each user's events the third to fifth and all from the ninth on are supervised; users with over 90 are left out."""
    rows = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("ids", F.sequence(F.lit(0), F.col("n") - 1))
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(8).alias("start"), F.col("n").alias("end")))
    labels = rows.select(traces.encoded(F.col("ids"), spans, 90).alias("labels")).where("labels IS NOT NULL")
    return traces.supervised_ratio(labels).select(fixed(F.col("ratio")).alias("ratio"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id % 10 AS batch, max(n) AS w FROM n GROUP BY 1)
SELECT user_id, w::INT AS width, n::INT AS ones, (w - n)::INT AS pads FROM n JOIN w ON batch = user_id % 10""")
def collated(spark, d):
    """F40"""
    rows = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n")).select("user_id", (F.col("user_id") % 10).alias("batch"), F.sequence(F.lit(1), F.col("n")).alias("ids"))
    out = traces.collated(rows.withColumn("labels", F.col("ids")), "batch", 0)
    same = (F.size("ids") == F.size("labels")) & (F.size("ids") == F.size("mask"))
    return out.select("user_id", F.when(same, F.size("ids")).alias("width"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("ones"), F.size(F.filter("ids", lambda x: x == 0)).alias("pads"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' / ' || '100' WHEN 1 THEN p_size || '% - 3.5' ELSE NULL END AS expr FROM part""")
def finqa_infix(spark, d):
    """F41"""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    program = (
        F.when(k % 4 == 0, F.concat(F.lit("divide("), s, F.lit(", const_100), "))).when(k % 4 == 1, F.concat(F.lit("subtract("), s, F.lit("%, 3.5)"))).when(k % 4 == 2, F.concat(F.lit("add("), s, F.lit(", #0)"))).otherwise(F.concat(F.lit("table_max("), s, F.lit(", 2)")))
    )
    return t(spark, d, "part").select("p_partkey", traces.infix(program).alias("expr"))


# -- tools and texts ------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'missing required parameter ''path''. where' WHEN 1 THEN 'unknown parameter(s) [''a'', ''b'']. Allowed: [''mode'', ''n'', ''path'']'
WHEN 2 THEN 'parameter ''n'' must be integer, got boolean' WHEN 3 THEN 'parameter ''n'' must be integer, got str' WHEN 4 THEN 'parameter ''mode'' must be one of [''r'', ''w''], got ''x''' WHEN 5 THEN 'arguments must be an object' END AS problem FROM events""")
def argument_problems(spark, d):
    """P15"""
    schema = '{"properties": {"path": {"type": "string", "description": "where"}, "n": {"type": "integer"}, "mode": {"type": "array", "enum": ["r", "w"]}}, "required": ["path"]}'
    args = ["{}", '{"path": "p", "b": 1, "a": 2}', '{"path": "p", "n": true}', '{"path": "p", "n": "1"}', '{"path": "p", "mode": "x"}', "[]", '{"path": "p", "n": 3, "mode": "w"}', '{"path": "p"}']
    k = (F.col("event_id") % len(args) + 1).cast("int")
    return t(spark, d, "events").select("event_id", tools.argument_problems(F.lit(schema), F.element_at(F.array(*map(F.lit, args)), k)).alias("problem"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN user_id % 256 = 168 WHEN 3 THEN true WHEN 4 THEN false ELSE false END AS local FROM events")
def local_addresses(spark, d):
    """P18"""
    k, u = F.col("event_id") % 6, F.col("user_id") % 256
    b = u.cast("string")
    address = F.when(k == 0, F.concat(F.lit("127.0.0."), b)).when(k == 1, F.concat(F.lit("10."), b, F.lit(".1.1"))).when(k == 2, F.concat(F.lit("192."), b, F.lit(".1.1"))).when(k == 3, F.lit("fe80::1")).when(k == 4, F.concat(F.lit("8.8."), b, F.lit(".8")))
    return t(spark, d, "events").select("event_id", tools.local_address(address).alias("local"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'too long' WHEN 2 THEN 'dunder' WHEN 3 THEN 'banned word' WHEN 4 THEN 'banned word' END AS problem FROM events""")
def expression_guard(spark, d):
    """P19"""
    k = (F.col("event_id") % 7 + 1).cast("int")
    forms = F.array(F.lit("  "), F.concat(F.col("user_id").cast("string"), F.repeat(F.lit("+1"), F.lit(300))), F.lit("a.__class__"), F.lit("GetAttr(x)"), F.lit("eval(1)"), F.concat(F.lit("2*"), F.col("user_id").cast("string")), F.lit("evaluate(1)"))
    return t(spark, d, "events").select("event_id", tools.expression_problem(F.element_at(forms, k)).alias("problem"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN printf('(%g - %g) / %g', p_size / 8.0::DOUBLE, 1.5::DOUBLE, 5.7::DOUBLE) WHEN 1 THEN printf('min(%g / 2, 10)', p_retailprice::DOUBLE) END AS substituted FROM part""")
def formula_substitution(spark, d):
    """F27, F28"""
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("double")
    call = (
        F.when(k == 0, F.concat(F.lit(" corrosion_rate("), (s / 8).cast("string"), F.lit(", years=5.70, t_current=(1 + 2) / 2)"))).when(k == 1, F.concat(F.lit("next_interval("), F.col("p_retailprice").cast("string"), F.lit(")"))).otherwise("next_interval(1, x=2)")
    )
    return t(spark, d, "part").select("p_partkey", tools.substitutions(call).alias("substituted"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS repaired FROM events")
def json_repair(spark, d):
    """F31"""
    k = F.col("event_id") % 3
    said = F.when(k == 0, "props").when(k == 1, "so: ")
    raw = F.when(k == 0, F.concat(F.lit("  "), "props")).when(k == 1, F.concat(F.lit("so: ```"), F.replace("props", F.lit("{"), F.lit("{\n")), F.lit("``` ok"))).otherwise(F.concat(F.lit("["), "props"))
    del said
    return t(spark, d, "events").select("event_id", tools.repaired_json(F.when(k == 2, "no object").otherwise(raw)).alias("repaired"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'exit 1' || chr(10) || event_type WHEN 2 THEN 'the tool failed' ELSE 'the tool failed' || chr(10) || event_type END AS seen,
'- ' || event_type || '(k: a, p: b)' || CASE WHEN event_id % 2 = 0 THEN ' [needs human approval]' ELSE '' END || chr(10) || '  does it' AS card FROM events""")
def observations(spark, d):
    """F32, F42"""
    k = F.col("event_id") % 4
    label = F.when(k == 1, " exit 1 ").when(k == 3, "")
    body = F.when(k == 0, F.col("event_type")).when(k == 2, " \n ").otherwise(F.concat(F.lit("\n"), "event_type", F.lit(" ")))
    params = F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("about")) for a, b in (("k", "a"), ("p", "b"))])
    return t(spark, d, "events").select("event_id", tools.observation(k == 0, label, body).alias("seen"), tools.tool_card(F.col("event_type"), params, F.lit("does it"), F.col("event_id") % 2 == 0).alias("card"))


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '--' WHEN event_id >= 3600 THEN event_id // 3600 || 'h ' || lpad((event_id % 3600 // 60)::VARCHAR, 2, '0') || 'm' ELSE event_id // 60 || 'm ' || lpad((event_id % 60)::VARCHAR, 2, '0') || 's' END AS took,
strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS at FROM events""")
def durations(spark, d):
    """F36, F44"""
    k = F.col("event_id")
    left = F.when(k % 100 == 0, -k.cast("double")).when(k % 50 == 0, F.lit(float("nan"))).otherwise(k + 0.7)
    return t(spark, d, "events").select("event_id", text.duration(left).alias("took"), text.iso_utc(F.col("ts")).alias("at"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, len(list_filter(list_transform(string_split(html, ','), lambda x: trim(x)), lambda x: x <> ''))::INT AS parts FROM pages""")
def html_escape(spark, d):
    """F45, F46"""
    return t(spark, d, "pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("escaped"), F.size(text.comma_list(F.col("html"))).alias("parts"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS v, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT doc_id, line, line % 4 AS k, trim(replace(v, '*', ''), E' \\n\\t\\r') AS v FROM l WHERE length(trim(replace(v, '*', ''), E' \\n\\t\\r')) > 0)
SELECT doc_id, line::INT AS line, CASE k WHEN 0 THEN 'h2' WHEN 1 THEN 'bullet' WHEN 2 THEN 'h1' ELSE 'text' END AS kind, sha256(CASE k WHEN 3 THEN v || '/true/ tail/false' ELSE v || '/false' END) AS runs FROM k""")
def document_lines(spark, d):
    """Lines marked as headings, items and bold text."""
    rows = filings.lines(t(spark, d, "documents")).withColumn("v", text.strip(F.replace("value", F.lit("*"), F.lit("")))).where("v <> ''")
    k = F.col("line") % 4
    marked = F.when(k == 0, F.concat(F.lit("## "), "v")).when(k == 1, F.concat(F.lit("* "), "v")).when(k == 2, F.concat(F.lit("# "), "v")).otherwise(F.concat(F.lit("**"), "v", F.lit("** tail")))
    body = F.when(k == 3, marked).otherwise(F.col("v"))
    runs = F.array_join(F.transform(text.bold_runs(body), lambda r: F.concat(r["run"], F.lit("/"), r["bold"].cast("string"))), "/")
    return rows.select("doc_id", "line", text.line_kind(marked).alias("kind"), F.sha2(runs, 256).alias("runs"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN list_transform(range(0, 6), lambda i: i * 5.0::DOUBLE) ELSE [7.0::DOUBLE] END AS ticks FROM part""")
def nice_ticks(spark, d):
    """of 0 to 20, and of a range without width."""
    odd = F.col("p_size") % 2 != 0
    low, high = F.when(odd, 7.0).otherwise(0.0), F.when(odd, 7.0).otherwise(F.lit(25.0) - (F.col("p_size") % 4) / 10)
    return t(spark, d, "part").select("p_partkey", numeric.nice_ticks(low, high, 5).alias("ticks"))


@query(f"SELECT vec_id, {six('sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS before, {six('1')} AS after FROM embeddings")
def l2_normalised(spark, d):
    """F3"""
    v = t(spark, d, "embeddings").select("vec_id", "embedding", numeric.l2(F.transform("embedding", lambda x: x * 3)).alias("unit"))
    norm = lambda c: F.sqrt(numeric.dot(F.col(c), F.col(c)))
    return v.select("vec_id", fixed(norm("embedding")).alias("before"), fixed(norm("unit")).alias("after"))


@query("""WITH x AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, '203.0.113.' || (event_id % 250) AS dst FROM events WHERE event_type = 'error' AND event_id % 7 <> 0) SELECT ts, 'TCP' AS proto, dst, '443' AS dport FROM x ORDER BY ts DESC, dst LIMIT 40""")
def newest_drops(spark, d):
    """T8"""
    return logs.newest(q._drops(spark, d))


# -- links ----------------------------------------------------------------------------------------

SCOPE = r"""h AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages), e AS (SELECT page_id, url, unnest(h) AS href, (generate_subscripts(h, 1) - 1)::INT AS ord FROM h),
rt AS (SELECT page_id, ord, href, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href WHEN href LIKE '%://%' THEN href ELSE regexp_replace(url, '[^/]*$', '') || href END AS target, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS host FROM e
  WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:)')),
sc AS (SELECT page_id, ord, href, target FROM rt WHERE regexp_extract(target, '^([a-z]+://[^/]+)', 1) = host AND NOT regexp_matches(target, '(?i)(purchase|buy|cart|checkout|login|signin|register|payment)'))"""


def _scoped(spark, d):
    return links.in_scope(links.hrefs(t(spark, d, "pages")), "/")


@query(f"WITH {SCOPE} SELECT page_id, ord, href, target FROM sc")
def link_scope(spark, d):
    """All links in scope."""
    return _scoped(spark, d).drop("url")


@query(f"WITH {SCOPE}, f AS (SELECT target, min({{p: page_id, o: ord}}) AS w FROM sc GROUP BY target) SELECT target, w.p AS page_id, w.o AS ord FROM f ORDER BY w LIMIT 40")
def link_targets(spark, d):
    """The first 40."""
    return links.targets(_scoped(spark, d))
