"""Operators against hand-written cases, and a sample of the registered queries against DuckDB."""

import datetime as dt
from decimal import Decimal

import compare
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import definitions as D
from tallyforge.operators import layout, locate, scope, transform
from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.mark.parametrize("name", ["A1_total_spend", "A4_spend_by_month", "A8_cost_report", "A10_latency_percentiles", "A11_cost_slices", "O2_keyset_document_date", "A6_summary_by_outcome", "W1_step_durations", "W3_current_extraction", "J5_candidates", "J8_grant_changes", "S6_ingest_against_table", "T3_retry_with_backoff", "A17_field_tally", "J13_accuracy_deltas", "C1_coerce", "C3d_sum_equals", "P10_scoped_join", "P8_outcome_map", "C28_price_calls", "T11_gate_at_cap", "P20_problem_assignment", "C17_correct", "C17_refusals", "C25_publish", "T10_failed_attempts"])
def test_query_equals_oracle(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert compare.differences(got, compare.answer(compare.connect(SF), registry.ORACLE_SQL[name])) == ""


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def coerce(spark, definition, *answers):
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string")
    made = rows.select("k", D.process_expr(definition, F.try_parse_json("a"), dt.date(2026, 1, 1)).alias("p")).orderBy("k").collect()
    return [(r.p["values"], list(r.p.errors)) for r in made]


def test_coercion_never_fails(spark):
    d = D.Definition("t", {"total": D.Field("money"), "day": D.Field("date"), "n": D.Field("integer"), "ok": D.Field("boolean"), "lines": D.Field("list", items={"amount": D.Field("money")})})
    a, b, c, e = coerce(
        spark, d,
        '{"total": "7,15", "day": "2026-05-14", "n": 3, "ok": true, "lines": [{"amount": "1.5"}, 4], "more": 1}',
        '{"total": "€5", "day": "20260514", "n": "3", "ok": "true", "lines": {}}',
        "[1]", '{"total": 10.123, "lines": []}',
    )
    assert a[0].total == Decimal("7.1500") and a[0].day == dt.date(2026, 5, 14) and a[0].n == 3 and a[0].ok is True
    assert [x.amount for x in a[0].lines] == [Decimal("1.5000"), None] and a[1] == ["lines[1]: expected an object, got int"]
    assert b[0].total is None and b[0].lines is None and len(b[1]) == 5
    assert b[1][0] == "total: expected an amount like '1234.56' or '1234,56', got '€5'" and b[1][2] == "n: expected an integer, got '3'"
    assert c[0].total is None and c[1] == ["expected an object, got list"]
    assert e[0].total == Decimal("10.1230") and e[1] == []


def test_definition_is_checked():
    with pytest.raises(ValueError):
        D.Definition("t", {"a": D.Field("money")}, rules=(D.Rule("positive", "b"),))
    with pytest.raises(ValueError):
        D.Definition("t", {"a": D.Field("string")}, canonical=D.Canonical(amount="a"))


def test_rows_pair_names_with_amounts():
    block = lambda t, x, y: {"text": t, "bbox": [x, y, x + 10 * len(t), y + 20], "page": 1, "polygon": None}
    text = layout.rows_of([block("bread", 0, 0), block("milk", 0, 40), block("1.00", 300, 3), block("2.00", 300, 42), block(" ", 0, 80)])
    assert [line.split() for line in text.split("\n")] == [["bread", "1.00"], ["milk", "2.00"]]
    assert layout.rows_of([]) == "" and layout.rows_of(None) == ""


def test_locate_reads_numbers_and_dates():
    assert locate.number_readings("1.234,56") == locate.number_readings("1,234.56") == {Decimal("1234.56")}
    assert locate.number_readings("1,234") == {Decimal(1234), Decimal("1.234")}
    assert locate.date_readings("24 Oct 2026")[0][2] == {dt.date(2026, 10, 24)}
    assert [d for *_, d in locate.date_readings("12 May 2026 13 de jun de 25 Oct 24, 2026")] == [{dt.date(2026, 5, 12)}, {dt.date(2025, 6, 13)}, {dt.date(2026, 10, 24)}]
    assert [x for *_, x in locate.printed_numbers(locate.tokens_of("EUR -12.50 on 1.234,56, a-5"))] == ["-12.50", "1.234,56", "5"]
    assert locate.date_readings("03/04/26")[0][2] == {dt.date(2026, 4, 3), dt.date(2026, 3, 4)}


def test_transform_host_contains_its_child():
    good = "import sys\nfrom decimal import Decimal\nseen = []\ndef transform(data):\n    seen.append(1)\n    print('x')\n    sys.__stdout__.write('junk')\n    return {'x': Decimal(data['x']) + len(seen)}\n"
    host = transform.TransformHost(good)
    assert host.run({"x": "1.10"}) == {"ok": {"x": "2.1"}} == host.run({"x": "1.10"})  # nothing stays from one document to the next
    host.close()
    gone = transform.TransformHost("import os\ndef transform(data):\n    os._exit(3)\n")
    assert "ended" in gone.run({})["error"]
    gone.close()
    slow = transform.TransformHost("def transform(data):\n    while True: pass\n", seconds=0.5)
    assert "timed out" in slow.run({})["error"]
    slow.close()
    with pytest.raises(ValueError):
        transform.check_source("def transform(a, b): return {}")


def test_locate_picks_the_labelled_line():
    word = lambda t, x, y: {"text": t, "bbox": [x, y, x + 10 * len(t), y + 20], "page": 1}
    blocks = [word("12.50", 300, 100), word("TOTAL", 0, 203), word("12.50", 300, 200), word("12.50", 300, 300), word("Shop 5", 0, 20), word("Pen", 0, 400), word("3.25", 300, 402)]
    fields = {"total": D.Field("money"), "vendor": D.Field("string"), "items": D.Field("list", items={"name": D.Field("string"), "amount": D.Field("money")})}
    data = {"total": "12.5", "vendor": "shop  5", "items": [{"name": "pen", "amount": "3.25"}, {"name": "none", "amount": "9"}]}
    found = locate.locate(fields, data, blocks, [{"page": 1, "width": 1000, "height": 1000}])
    assert [round(x, 3) for x in found["total"]["box"]] == [0.296, 0.196, 0.354, 0.224]
    assert [round(x, 3) for x in found["items.0"]["box"]] == [0.0, 0.396, 0.344, 0.426] and "items.1" not in found and found["vendor"]["page"] == 1
    assert locate.locate(fields, data, blocks, []) == locate.locate(fields, data, None, None) == {}


def test_every_status_has_an_outcome():
    from tallyforge.operators import listing
    from tallyforge.sources import views

    assert set(listing.OUTCOMES) == set(views.STATUSES) and set(listing.OUTCOMES.values()) == set(listing.OUTCOME_ORDER)


def test_scope_fails_closed(spark):
    rows = spark.createDataFrame([("1", 1), ("2", 2)], "organisation_id string, x int")
    with pytest.raises(scope.ScopeError):
        scope.ScopedTables({"documents": rows}, None)
    mine = scope.ScopedTables({"documents": rows}, scope.Scope("1"))
    assert [r.x for r in mine.table("documents").collect()] == [1]
    with pytest.raises(Exception):
        mine.checked("documents", rows).collect()


def test_pipeline_streams(spark, tmp_path):
    from tallyforge.streaming import pipeline

    d = D.Definition("receipt", {"vendor": D.Field("string"), "total": D.Field("money")}, matches=D.Matchers(keywords=("total",)), rules=(D.Rule("required", "vendor"),), canonical=D.Canonical(amount="total", counterparty="vendor"))
    rows = [(1, "o", "TOTAL 5", '{"vendor": "a", "total": "5.00"}'), (2, "o", "TOTAL 6", '{"total": "6.00"}'), (3, "o", "nothing", "{}"), (4, "o", None, None)]
    schema = "document_id long, organisation_id string, full_text string, answer_json string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    pipeline.recognise(spark, f"{tmp_path}/in", schema, lambda b: b, f"{tmp_path}/ocr", f"{tmp_path}/c1").awaitTermination()
    pipeline.extract(spark, f"{tmp_path}/ocr", schema + ", status string, batch int", d, lambda b: b, dt.date(2026, 1, 1), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    got = {r.document_id: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "committed", 2: "needs_review", 3: "unsupported"}


def test_geometry_reads_whole_documents(spark, tmp_path):
    texts = ["", "one two", " ".join(f"w{k}" for k in range(199)), "\n".join(f"w{k}" for k in range(457))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: {r.doc_id: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    words = {k: t.split() for k, t in enumerate(texts)}
    def grid(ws):
        out = []
        for at in range(0, len(ws), 10):
            line = ""
            for i, w in enumerate(ws[at : at + 10]):
                line = (line.ljust(max(round(100 * i / 9), len(line) + 2)) if i else "") + w
            out.append(line)
        return "\n".join(out)

    assert {k: r.rows for k, r in got("C6_layout_rows").items()} == {k: grid(w) for k, w in words.items()}
    assert {k: r.block_count for k, r in got("C35_ocr_view").items()} == {k: len(w) for k, w in words.items()}
    assert {k: r.blocks for k, r in got("S15_blocks_json").items()} == {k: len(w) for k, w in words.items()}
    assert {k: r.extracted for k, r in got("C5_extraction_text").items()} == {k: grid(w) or texts[k] for k, w in words.items()}
    assert {k: r.confidence for k, r in got("A22_mean_confidence").items()} == {k: 0.9 if w else None for k, w in words.items()}
    medians = {r.document_id: (r.line_height, r.char_width) for r in registry.QUERIES["A23_layout_medians"](spark, str(tmp_path)).collect()}
    assert medians == {k: (20.0, 9.0) for k, w in words.items() if w}


def test_each_answer_value_is_looked_at_once(spark):
    """A kind that is spelled out again in every branch makes coercion hundreds of times slower."""
    d = D.Definition("d", {"a": D.Field("string"), "b": D.Field("money"), "c": D.Field("date"), "e": D.Field("integer"), "f": D.Field("list", items={"g": D.Field("money")})})
    rows = spark.createDataFrame([("{}",)], "answer string").select(D.coerce_expr(d, F.try_parse_json("answer")).alias("c"))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("schema_of_variant(") == 8  # the answer, five fields, an entry and its item


def test_coercing_some_fields_gives_the_same_values(spark):
    from tallyforge.plans.documents_flow import RECEIPT, coerced

    answers = ['{"vendor":3,"total":"1,5","items":[{"amount":2},7],"quantity":4}', '{"quantity":5.0,"items":[]}', "[1]", "{", None]
    rows = spark.createDataFrame(list(enumerate(answers)), "document_id long, answer string")
    whole = {r.document_id: r.c["values"] for r in coerced(rows).collect()}
    for name in RECEIPT.fields:
        assert {r.document_id: r.c["values"][name] for r in coerced(rows, name).collect()} == {k: v[name] for k, v in whole.items()}


def test_transforms_that_leave_nothing_share_a_process():
    code = "from decimal import Decimal\nseen = []\ndef transform(data):\n    seen.append(1)\n    if data['x'] == 'slow':\n        while True: pass\n    print('x')\n    return {'x': str(1 / Decimal(data['x'])), 'n': len(seen)}\n"
    host = transform.TransformHost(code, seconds=0.5)
    given = ['{"x": "4"}', '{"x": "slow"}', '{"x": "0"}'] + ['{"x": "2"}'] * 600
    shared = host.run_all(given)
    pid = host.child.pid
    assert host.run_all(given[2:]) == shared[2:] and host.child.pid == pid
    host.close()
    forked = transform.TransformHost(code, seconds=0.5)
    forked.shared = False
    assert host.shared and forked.run_all(given[:20]) == shared[:20] and len(shared) == len(given)
    forked.close()
    for line in ("import sys", "from decimal import getcontext", "getattr(data, 'x')", "(x for x in []).gi_frame", "transform.seen = 1", "global g", "data.__class__", "open('x')", "class A: pass"):
        assert not transform.leaves_nothing(f"def transform(data):\n    {line}\n    return {{}}\n"), line


def test_values_without_messages_are_the_same(spark):
    fields = {"a": D.Field("string"), "b": D.Field("money"), "b_kind": D.Field("date"), "c": D.Field("integer"), "e": D.Field("number"), "f": D.Field("boolean"), "answer": D.Field("list", items={"g": D.Field("money"), "h": D.Field("list", items={"i": D.Field("date")})})}
    d = D.Definition("d", fields)
    odd = ["null", "true", '"true"', "5", "5.0", "-0", '"1,5"', '" 7.25 "', '"1.234"', "12345678901234567890", "1e400", '"2026-02-30"', '"2024-02-29"', '""', "[]", "{}", "[1]", '[null,{"g":2},{"g":"x","h":[{"i":"2024-01-01"},3]},"g",{"h":{}}]', '{"g":1}']
    answers = [None, "", "{", "[1]", "7", "null", '"a"', "[[]]", '{"B":1}'] + ['{"%s":%s}' % (n, x) for n in fields for x in odd]
    rows = spark.createDataFrame(list(enumerate(answers)), "k int, answer string")
    whole = {r.k: r.c["values"] for r in rows.select("k", D.coerce_expr(d, F.try_parse_json("answer")).alias("c")).collect()}
    assert {r.k: r["values"] for r in D.coerce_frame(rows, d, F.try_parse_json("answer")).collect()} == whole


@pytest.mark.parametrize(("name", "in_lambdas"), [("C13_ledger_reasons", 0), ("C13_to_ledger", 2), ("C3b_positive", 0)])
def test_single_values_are_not_coerced_in_lambdas(spark, name, in_lambdas):
    """Lambdas are interpreted; only a list's entries need them."""
    frame = registry.QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(") > in_lambdas == plan.count("schemaOfVariant(lambda")
    assert compare.differences(frame.toPandas(), compare.answer(compare.connect(SF), registry.ORACLE_SQL[name])) == ""
