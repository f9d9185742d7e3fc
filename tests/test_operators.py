"""Operators on small hand-made inputs, and against brute force under skew."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import discovery, graph, grid, narrative, ordered
from gridloom.operators.quantiles import exact_quantiles
from gridloom.plans.blobs import document_bytes, text_cell, workbook_bytes
from gridloom.sources import delimited, documents, files, sinks, workbook

CELLS = (
    "sheet string, row int, col int, address string, value string, value_type string, formula string, "
    "number_format string, bold boolean, merged_anchor boolean"
)


def sheet(spark, *cells):
    rows = []
    for address, value, formula, *flags in cells:
        col, row = ord(address[0]) - 64, int(address[1:])
        kind = "number" if formula or (value or "").replace(".", "").isdigit() else "text"
        rows.append(("Sheet1", row, col, f"Sheet1!{address}", value, kind, formula, None, "bold" in flags, "merged" in flags))
    return spark.createDataFrame(rows, CELLS)


def test_cell_roles(spark):
    cells = sheet(
        spark, ("A1", "Amount", None), ("B1", "100", None), ("C1", None, "=B1*2"), ("D1", None, "=C1+10"),
        ("A3", "Section Header", None, "bold", "merged"),
    )
    roles = {r["address"][7:]: r["role"] for r in grid.classified(cells)[0].collect()}
    assert roles == {"A1": "label", "B1": "input", "C1": "intermediate", "D1": "output", "A3": "structural"}


def _two_chains(spark):
    return sheet(
        spark, ("B1", "5", None), ("C1", None, "=B1*2"), ("D1", None, "=C1+1"), ("F1", "3", None), ("G1", None, "=F1+2")
    )


def test_edges(spark):
    edges = {(r["source"][7:], r["target"][7:]) for r in grid.edge_list(_two_chains(spark)).collect()}
    assert edges == {("B1", "C1"), ("C1", "D1"), ("F1", "G1")}


def test_depth_and_clusters(spark):
    cells = _two_chains(spark)
    edges = grid.edge_list(cells)
    depth = {r["address"][7:]: r["depth"] for r in graph.topological_depth(cells, edges).collect()}
    assert depth == {"B1": 0, "C1": 1, "D1": 2, "F1": 0, "G1": 1}
    groups = {}
    for r in graph.components(cells, edges).collect():
        groups.setdefault(r["cluster"], set()).add(r["address"][7:])
    assert sorted(map(sorted, groups.values())) == [["B1", "C1", "D1"], ["F1", "G1"]]


def test_unsupported(spark):
    df = spark.createDataFrame([("=INDIRECT(B1)",), ("=SUM(A1)",)], "formula string")
    assert [r["function"] for r in graph.unsupported(df, "formula", ("INDIRECT", "OFFSET")).collect()] == ["INDIRECT"]


def test_large_range_links_filled_cells_only(spark):
    cells = sheet(spark, ("A1", "1", None), ("A900", "2", None), ("C1", None, "=SUM(A1:B5000)"))
    assert {r["source"] for r in grid.edge_list(cells).collect()} == {"Sheet1!A1", "Sheet1!A900"}


def test_components_with_a_hub_against_union_find(spark):
    rng = random.Random(3)
    pairs = [("hub", f"n{i}") for i in range(200)] + [(f"m{rng.randrange(150)}", f"m{rng.randrange(150)}") for _ in range(110)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(60)]
    names = sorted({x for p in pairs for x in p} | {"alone"})
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(n,) for n in names], "address string")
    edges = spark.createDataFrame(pairs, "source string, target string").distinct()
    got = {r["address"]: r["cluster"] for r in graph.components(nodes, edges).collect()}
    assert got == {n: find(n) for n in names}


def test_cycles_and_their_descendants_have_no_depth(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "address string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "e")], "source string, target string")
    depth = graph.topological_depth(nodes, edges)
    assert {r["address"]: r["depth"] for r in depth.collect()} == {"a": 0, "e": 1, "f": 0}
    assert {r["address"] for r in graph.cycle_nodes(nodes, depth).collect()} == {"b", "c", "d"}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, so that it spans several chunks."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", i, rng.choice([None, None, rng.randrange(50)])) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, at int, v int")


def _by_group(rows):
    groups = {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((at, v))
    return groups


def test_ordered_operators_under_skew(skewed):
    rows, df = skewed
    order = [F.col("at")]
    number = {r["at"]: r["n"] for r in ordered.running_number(df, ["g"], order, "n", chunks=7).collect()}
    last = {r["at"]: r["l"] for r in ordered.carry_last(df, ["g"], order, F.col("v"), "l", chunks=7).collect()}
    before = {r["at"]: r["p"] for r in ordered.previous_value(df, ["g"], order, F.col("v"), "p", chunks=7).collect()}
    upto = {r["at"]: r["s"] for r in ordered.running_sum(df, ["g"], order, F.coalesce("v", F.lit(0)), "s", chunks=7).collect()}
    for items in _by_group(rows).values():
        seen, total, previous = None, 0, None
        for n, (at, v) in enumerate(items, 1):
            seen = v if v is not None else seen
            total += v or 0
            assert (number[at], last[at], before[at], upto[at]) == (n, seen, previous, total)
            previous = v


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    table = sorted({rng.randrange(1000) for _ in range(60)})
    asked = [rng.choice([500, rng.randrange(-10, 1010)]) for _ in range(400)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(asked)], "i int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in table], "k int, v string")
    low = {r["i"]: r["found_key"] for r in ordered.asof_lookup(left, right, "k", "v").collect()}
    high = {r["i"]: r["found_key"] for r in ordered.asof_lookup(left, right, "k", "v", forward=True).collect()}
    for i, k in enumerate(asked):
        assert low[i] == max((t for t in table if t <= k), default=None)
        assert high[i] == min((t for t in table if t >= k), default=None)


def test_exact_quantiles(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, 0.0, rng.gauss(0, 1), 1e12 * rng.random()]) for _ in range(2001)]
    df = spark.createDataFrame([(v, None) for v in values], "x double, empty double")
    got = exact_quantiles(df, ["x", "empty"], [0.0, 0.1, 0.25, 0.5, 0.99, 1.0])
    ordered_values = sorted(values)
    for (column, p), value in got.items():
        at = (len(values) - 1) * p
        low, high = ordered_values[int(at)], ordered_values[min(int(at) + 1, len(values) - 1)]
        assert column == "x" and value == pytest.approx(low + (high - low) * (at - int(at)))


MESSY = [
    ["Sales 2024", "", "", ""], ["", "", "", ""], ["Fecha", "Cantidad", "Comment", ""], ["2024-01-01", "5", "", " "],
    ["North region", "", "", ""], ["2024-01-02", "7", "", ""], ["Fecha", "Cantidad", "Comment", ""], ["2024-01-03", "1", "", ""],
    ["Grand total", "13", "", ""], ["", "", "", ""], ["Figures are preliminary and may still be corrected", "", "", ""],
]


def messy(spark):
    rows = [("s", i, cells) for i, cells in enumerate(MESSY, 1)]
    rows += [("none", 1, ["1", "2"]), ("none", 2, ["3", "4"])]
    return spark.createDataFrame(rows, "sheet string, row_idx bigint, cells array<string>")


def test_row_kinds(spark):
    kinds = {r["row_idx"]: r["kind"] for r in discovery.classify_rows(messy(spark)).filter("sheet = 's'").collect()}
    assert [kinds[i] for i in range(1, 12)] == [
        "title", "blank", "header", "data", "section", "data", "repeated_header", "data", "total", "blank", "footnote",
    ]
    assert {r["kind"] for r in discovery.classify_rows(messy(spark)).filter("sheet = 'none'").collect()} == {"data"}


def test_extract_and_stack(spark):
    table = discovery.stack_records(discovery.extract_table(messy(spark)), ["date", "quantity"])
    rows = sorted((r["_source_row"], r["date"], r["quantity"]) for r in table.filter("_source_sheet = 's'").collect())
    assert rows == [(4, "2024-01-01", "5"), (6, "2024-01-02", "7"), (8, "2024-01-03", "1")]


def test_sheet_clusters_against_brute_force(spark):
    rng = random.Random(6)
    sheets = {f"s{i}": {n: rng.choice("ab") for n in rng.sample("pqrstuv", rng.randint(2, 5))} for i in range(40)}
    rows = [(s, n, t) for s, cols in sheets.items() for n, t in cols.items()]

    def alike(a, b):
        shared = set(a) & set(b)
        same = sum(a[n] == b[n] for n in shared)
        return abs(len(a) - len(b)) <= 2 and len(shared) >= 0.5 * max(len(a), len(b)) and same >= 0.7 * len(shared)

    parent = {s: s for s in sheets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sheets:
        for b in sheets:
            if alike(sheets[a], sheets[b]):
                parent[find(a)] = find(b)
    got = {r["sheet"]: r["cluster"] for r in discovery.sheet_clusters(spark.createDataFrame(rows, "sheet string, name string, type string")).collect()}
    for a in sheets:
        for b in sheets:
            assert (got[a] == got[b]) == (find(a) == find(b)), (a, b)


def test_stack_keeps_every_row(spark):
    a, b = spark.range(7).withColumn("x", F.lit("1")), spark.range(5).withColumn("y", F.lit("2"))
    out = discovery.stack_sheets({"a": a, "b": b}, {"a": [F.col("id")], "b": [F.col("id")]})
    assert out.count() == 12
    assert set(out.columns) == {"id", "x", "y", "_source_row", "_source_sheet"}


NOTES = """Q1 Planning
Attendees: Alice, Bob

Alice: We need to finalize the budget.
Bob: I disagree.

DECISIONS:
- Budget review deferred to Friday

ACTION ITEMS:
- Alice: R&D proposal by Thursday (no owner for consolidation)
- Bob: Marketing report by Wednesday
- Carol: Schedule Friday meeting

OPEN QUESTIONS:
- Who owns the budget?""".split("\n")


def test_notes(spark):
    lines = spark.createDataFrame([("n", i, t) for i, t in enumerate(NOTES)], "doc string, line_no int, text string")
    bullets = narrative.section_lines(lines, "doc")
    counts = {r["section"]: r["count"] for r in bullets.groupBy("section").count().collect()}
    assert counts == {"DECISIONS": 1, "ACTION ITEMS": 3, "OPEN QUESTIONS": 1}
    items = [(r["owner"], r["deadline"]) for r in narrative.action_items(bullets).orderBy("line_no").collect()]
    assert items == [("Alice", "Thursday"), ("Bob", "Wednesday"), ("Carol", None)]
    assert {r["speaker"] for r in narrative.speaker_turns(lines).collect()} == {"Attendees", "Alice", "Bob"}


def test_workbook(spark, tmp_path):
    sheets = {
        "One & two": [
            f'<row r="1">{text_cell("A1", "Töt<al", 1)}<c r="B1" s="2"><v>0.5</v></c><c r="AA1" s="3"><v>45292</v></c></row>',
            '<row r="2"><c r="A2"><f>B1*2</f><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"/></row>',
        ],
        "Empty": [],
    }
    (tmp_path / "book.xlsx").write_bytes(workbook_bytes(sheets, merged="A1:B1"))
    blobs = spark.read.format("binaryFile").load(str(tmp_path / "book.xlsx"))
    cells = workbook.read_workbook_cells(blobs)
    got = {r["address"]: r for r in cells.collect()}
    assert set(got) == {f"One & two!{a}" for a in ("A1", "B1", "AA1", "A2", "B2")}
    assert (got["One & two!A1"]["value"], got["One & two!A1"]["bold"], got["One & two!A1"]["merged_anchor"]) == ("Töt<al", True, True)
    assert (got["One & two!AA1"]["value"], got["One & two!AA1"]["value_type"], got["One & two!AA1"]["col"]) == ("2024-01-01 00:00:00", "date", 27)
    assert got["One & two!B1"]["number_format"] == "0%"
    assert got["One & two!A2"]["formula"] == "=B1*2"
    typed = {r["address"]: r["value"] for r in workbook.inputs_only(cells).collect()}
    assert typed["One & two!A2"] == "" and typed["One & two!B2"] == "True"


def test_docx_and_text_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(document_bytes("First\n\n  \nSecond & last"))
    found = documents.read_docx_paragraphs(spark.read.format("binaryFile").load(str(tmp_path / "a.docx")))
    assert [r["text"] for r in found.orderBy("para_no").collect()] == ["First", "Second & last"]
    (tmp_path / "b.txt").write_bytes(b"one\r\n\n  two \nbad \xff byte\n")
    lines = documents.text_lines(documents.read_texts(spark, str(tmp_path / "b.txt")), "file")
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["one", "", "  two ", "bad � byte"]
    assert [r["line"] for r in documents.preview(lines, markdown=True).orderBy("line_no").collect()] == ["one", "two", "bad � byte"]


def test_delimited_rows_keep_file_order(spark, tmp_path):
    body = "\n".join(['a;b;c', '1;"x;y";3', "", "4;5", '6;7;8;9', 'say "";;z'])
    (tmp_path / "t.csv").write_text(body + "\n")
    rows = delimited.read_delimited(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r["cells"] for r in rows] == [["a", "b", "c"], ["1", "x;y", "3"], ["4", "5", None], ['say ""', "", "z"]]
    assert [r["row_idx"] for r in rows] == [1, 2, 3, 4]


def test_file_types(spark, tmp_path):
    for name in ("a.CSV", "b.md", "c.exe", "noext"):
        (tmp_path / name).write_text("x")
    registry = files.file_registry(spark, str(tmp_path))
    assert {r["name"]: r["file_type"] for r in registry.collect()} == {"a.CSV": "csv", "b.md": "markdown", "c.exe": None, "noext": None}
    assert files.rejected(registry).count() == 2


def test_warehouse_counts_what_it_wrote(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, v double")
    target = str(tmp_path / "t")
    assert sinks.write_warehouse(df, target, truncate=True) == 2
    assert sinks.write_warehouse(df, target) == 2
    assert spark.read.parquet(target).filter("v IS NULL").count() == 2


def test_report_layout(spark):
    rows = [("r", "sales", i, f"H{i}", f"D{i}", "m", 1.5, 12.34 if i == 1 else None, "I") for i in range(1, 8)]
    df = spark.createDataFrame(
        rows, "report string, domain string, place int, headline string, detail string, metric string, value double, delta_percent double, implication string"
    )
    text = [r["line"] for r in sinks.report_lines(df).orderBy("line_no").collect()]
    assert text[:2] == ["Analysis Report", "Domain: sales"]
    assert text[7:11] == ["1. H1", "   D1", "   Implication: I", ""]
    assert sum(line.startswith("• ") for line in text) == 7 and "6. H6" not in text
    assert "  Change: 12.3%" in text and sum(line.startswith("  Change") for line in text) == 1
    markdown = [r["line"] for r in sinks.report_lines(df, markdown=True).orderBy("line_no").collect()]
    assert markdown[0] == "# Analysis Report" and "### H7" in markdown


@pytest.mark.parametrize("last", [999, 1000, 1001, 100_000])
def test_ranges_follow_one_rule_at_every_size(spark, last):
    cells = sheet(
        spark, ("A1", "1", None), ("A7", "2", None), ("A999", "3", None), ("B5", "4", None), ("C1", None, f"=SUM(A1:A{last})"),
        ("D1", None, "=A500"), ("E1", None, f"=SUM(A2:B{last})"),
    )
    edges = {(r["source"][7:], r["target"][7:]) for r in grid.edge_list(cells).collect()}
    assert edges == {
        ("A1", "C1"), ("A7", "C1"), ("A999", "C1"), ("A500", "D1"), ("A7", "E1"), ("A999", "E1"), ("B5", "E1"),
    }


def test_whole_columns_rows_and_defined_names(spark):
    cells = sheet(
        spark, ("A1", "1", None), ("A90000", "2", None), ("B3", "4", None), ("C3", None, "=SUM(A:B)"), ("D9", None, "=MAX($3:$3)"),
        ("E1", None, "=Rate*2+SUM(Sales)"), ("F1", None, "=LOG10(A1)"),
    )
    names = spark.createDataFrame([("rate", "Sheet1!$B$3"), ("Sales", "'Sheet1'!$A:$A"), ("unused", "Sheet1!A1")], "name string, ref string")
    found = {}
    for r in grid.edge_list(cells, names).collect():
        found.setdefault(r["target"][7:], set()).add(r["source"][7:])
    assert found == {"C3": {"A1", "A90000", "B3"}, "D9": {"B3", "C3"}, "E1": {"A1", "A90000", "B3"}, "F1": {"A1"}}


def test_range_members_against_brute_force(spark):
    rng = random.Random(6)
    spots = {(rng.randint(1, 400), rng.randint(1, 40)) for _ in range(600)}
    cells = [(f"S{k}", r, c, f"S{k}!{r},{c}") for k in (1, 2) for r, c in spots]
    refs, want = [], set()
    for i in range(150):
        r1, c1 = rng.randint(1, 400), rng.randint(1, 40)
        r2, c2 = (rng.randint(r1, 420), rng.randint(c1, 45)) if i % 3 else (rng.choice([r1, 1_048_576]), 16_384)
        refs.append((f"t{i}", f"ref{i}", f"S{i % 2 + 1}", r1, r2, c1, c2))
        want |= {(f"t{i}", a) for s, r, c, a in cells if s == f"S{i % 2 + 1}" and r1 <= r <= r2 and c1 <= c <= c2}
    got = grid.range_members(
        spark.createDataFrame(refs, "target string, ref string, ref_sheet string, r1 int, r2 int, c1 int, c2 int"),
        spark.createDataFrame(cells, "sheet string, row int, col int, address string"),
    )
    rows = [(r["target"], r["source"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def _longest(nodes, edges):
    """Depths by plain relaxation; nodes on or below a cycle are left out."""
    parents = {n: [] for n in nodes}
    for s, t in edges:
        parents[t].append(s)
    depth = {}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            if n not in depth and all(p in depth for p in parents[n]):
                depth[n] = max((depth[p] + 1 for p in parents[n]), default=0)
                changed = True
    return depth


def test_depths_of_random_graphs(spark):
    rng = random.Random(9)
    for size, links, back in ((30, 40, 0), (60, 90, 3), (40, 39, 1)):
        nodes = [f"n{i:02d}" for i in range(size)]
        edges = set()
        while len(edges) < links:
            a, b = sorted(rng.sample(range(size), 2))
            edges.add((nodes[a], nodes[b]))
        for _ in range(back):
            a, b = sorted(rng.sample(range(size), 2))
            edges.add((nodes[b], nodes[a]))
        got = graph.topological_depth(
            spark.createDataFrame([(n,) for n in nodes], "address string"), spark.createDataFrame(sorted(edges), "source string, target string")
        )
        rows = got.collect()
        assert len(rows) == len({r["address"] for r in rows})
        assert {r["address"]: r["depth"] for r in rows} == _longest(nodes, edges)


def test_depth_of_a_long_running_total(spark):
    """B(n) = B(n-1) + A(n) over 20,000 rows, then a sum of both columns."""
    n = 20_000
    rows = spark.range(1, n + 1)
    nodes = rows.select(F.concat(F.lit("A"), "id").alias("address")).union(rows.select(F.concat(F.lit("B"), "id"))).union(
        spark.createDataFrame([("T",)], "address string")
    )
    below = lambda c: F.concat(F.lit(c), "id")
    edges = (
        rows.select(below("A").alias("source"), below("B").alias("target"))
        .union(rows.filter(f"id < {n}").select(below("B"), F.concat(F.lit("B"), (F.col("id") + 1).cast("string"))))
        .union(rows.select(below("B"), F.lit("T")))
    )
    depth = {r["address"]: r["depth"] for r in graph.topological_depth(nodes, edges).collect()}
    assert len(depth) == 2 * n + 1 and depth["T"] == n + 1
    assert all(depth[f"B{i}"] == i and depth[f"A{i}"] == 0 for i in range(1, n + 1))


def test_quantiles_of_odd_values(spark):
    inf, top = float("inf"), 1.7e308
    df = spark.createDataFrame(
        [(1.0, -top), (2.0, top), (inf, 0.0), (float("nan"), 5e-324), (None, 1.0), (-inf, None), (3.0, inf)], "a double, b double"
    )
    got = exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0])
    assert [got["a", p] for p in (0.0, 0.5, 1.0)] == [1.0, 2.0, 3.0]
    assert [got["b", p] for p in (0.0, 0.5, 1.0)] == [-top, 5e-324, top]
    tiny = spark.createDataFrame([(0.0,), (5e-324,), (1e-323,)], "a double")
    assert exact_quantiles(tiny, ["a"], [0.5])["a", 0.5] == 5e-324


def test_delimited_encodings_breaks_and_long_lines(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("name;city\nJosé;Köln\n".encode("latin-1"))
    (tmp_path / "marked.csv").write_bytes("﻿name,city\né,x\n".encode())
    (tmp_path / "breaks.csv").write_text('a,b,c\n1,"line one\nline, ""two""\n\nend",3\n4,"5 in",6\n7,5" pipe,8\n')
    (tmp_path / "long.csv").write_text("a|b\n" + "x" * 1_000_000 + "|y\n" + "|".join(["z"] * 30_000) + "\n" + '"' + "q|" * 100_000 + '"|w\n')
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,x\n')
    late = "é".encode() * 2047 + b"a"
    (tmp_path / "late.csv").write_bytes(b"x,y\n" + late + "é,1\n".encode())
    found = {}
    for r in delimited.read_delimited(spark, str(tmp_path)).orderBy("row_idx").collect():
        found.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["cells"])
    assert found["latin.csv"] == [["name", "city"], ["José", "Köln"]]
    assert found["marked.csv"] == [["name", "city"], ["é", "x"]]
    assert found["breaks.csv"] == [["a", "b", "c"], ["1", 'line one\nline, "two"\n\nend', "3"], ["4", "5 in", "6"], ["7", '5" pipe', "8"]]
    assert [len(r[0]) for r in found["long.csv"]] == [1, 1_000_000, 200_000]
    assert found["open.csv"] == [["a", "b"], ["1", '"never closed'], ["2", "x"]]
    assert found["late.csv"][1] == ["é" * 2047 + "aé", "1"]
    skipped = delimited.skipped_records(spark, str(tmp_path)).collect()
    assert [(r["file"].rsplit("/", 1)[-1], len(r["cells"])) for r in skipped] == [("long.csv", 30_000)]
    blob = spark.read.format("binaryFile").load(str(tmp_path / "late.csv"))
    assert blob.select(delimited.detect_encoding(F.col("content"))).first()[0] == "utf-8"


def test_workbook_shared_formulas_and_missing_places(spark):
    rows = [
        '<row r="1"><c r="A1"><v>1</v></c><c r="B1"><f t="shared" ref="B1:B3" si="0">A1*$C$1+SUM(D:D)&amp;"A1"</f><v>0</v></c></row>',
        '<row><c><v>2</v></c><c><f t="shared" si="0"/><v>0</v></c></row>',
        '<row r="3"><c r="B3"><f t="shared" si="0"/><v>0</v></c><c><v>9</v></c></row>',
    ]
    blobs = spark.createDataFrame([("s.xlsx", workbook_bytes({"S": rows}))], "path string, content binary")
    cells = {r["address"]: (r["value"], r["formula"]) for r in workbook.read_workbook_cells(blobs).collect()}
    assert cells == {
        "S!A1": ("1", None), "S!B1": ("0", '=A1*$C$1+SUM(D:D)&"A1"'), "S!A2": ("2", None), "S!B2": ("0", '=A2*$C$1+SUM(D:D)&"A1"'),
        "S!B3": ("0", '=A3*$C$1+SUM(D:D)&"A1"'), "S!C3": ("9", None),
    }
    assert workbook.shifted("A1+'My A1'!B$2+$A:B+3:$4+LOG10(X1)", 2, 1) == "B3+'My A1'!C$2+$A:C+5:$4+LOG10(Y3)"
    assert workbook.shifted("A1", -1, 0) == "#REF!"


def test_large_sheet_is_read_in_bounded_memory(spark):
    import resource

    n = 150_000
    rows = [f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(1, n + 1)]
    content = workbook_bytes({"S": rows}, merged="A1:B1")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    count = sum(1 for _ in workbook._cells("x", content))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert count == 2 * n and grown < 60


def test_components_shrink_round_by_round(spark, monkeypatch):
    # A path of 600 places in shuffled order: what is left to link gets less each round, and one component comes out.
    sizes, written = [], graph._written
    monkeypatch.setattr(graph, "_written", lambda pairs, label: sizes.append(written(pairs, label)) or sizes[-1])
    order = random.Random(5).sample(range(600), 600)
    nodes = spark.createDataFrame([(f"p{i:03}",) for i in range(601)], "address string")
    edges = spark.createDataFrame([(f"p{a:03}", f"p{b:03}") for a, b in zip(order, order[1:])], "source string, target string")
    got = {r["address"]: r["cluster"] for r in graph.components(nodes, edges).collect()}
    assert got == {f"p{i:03}": "p000" for i in range(600)} | {"p600": "p600"}
    assert sum(n for _, n in sizes) <= 4 * sizes[0][1]


def test_roles_with_known_edges_do_not_parse_formulas_again(spark, monkeypatch):
    cells = _two_chains(spark)
    edges = grid.edge_list(cells)
    expected = {(r["address"], r["role"]) for r in grid.classified(cells)[0].collect()}
    monkeypatch.setattr(grid, "edge_list", None)
    assert {(r["address"], r["role"]) for r in grid.classified(cells, edges)[0].collect()} == expected


def test_only_groups_at_the_ends_of_chunks_are_carried(spark, monkeypatch):
    # 300 groups of 5 rows and one of 400 that spans chunks; what is joined back is at most a row a chunk.
    sizes, per_key = [], ordered.per_key
    monkeypatch.setattr(ordered, "per_key", lambda df: sizes.append(per_key(df)) or sizes[-1])
    rows = [(f"g{i:03}", n, n if n % 5 == 0 else None) for i in range(300) for n in range(5)]
    rows += [("g150x", n, n if n % 90 == 0 else None) for n in range(400)] + [(None, n, n if n == 1 else None) for n in range(3)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    got = {(r["g"], r["n"]): r["c"] for r in ordered.carry_last(df, ["g"], [F.col("n")], F.col("v"), "c", chunks=8).collect()}
    expected, last = {}, None
    for g, n, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last = v if n == 0 else last if v is None else v
        expected[g, n] = last
    assert got == expected
    numbered = ordered.running_number(df, ["g"], [F.col("n")], "k", chunks=8).collect()
    assert all(r["k"] == r["n"] + 1 for r in numbered)
    assert all(s.count() <= 8 for s in sizes)


def test_types_test_each_distinct_value_once(spark):
    from gridloom.operators import profile

    rows = spark.createDataFrame([("1", " ")] * 50 + [("2.5", "yes")] * 30 + [(None, "no")] * 20, "a string, b string")
    tested = profile.conformance(rows, ["a", "b"])
    got = {r["column"]: (r["filled"], r["ints"], r["numbers"], r["flags"], r["longest"]) for r in tested.collect()}
    assert got == {"a": (80, 50, 80, 50, 3), "b": (50, 0, 0, 50, 3)}
    counts = profile.value_counts(rows, ["a", "b"])
    assert profile.infer_types(rows, ["a", "b"], counts).collect() == profile.infer_types(rows, ["a", "b"]).collect()


def _written_tables(spark):
    import os

    from gridloom.session import _scratch_folder

    folder = _scratch_folder(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_components_and_depth_leave_only_what_they_hand_out(spark):
    """Rounds that are over are deleted, and the frames handed out can be read more than once."""
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "address string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(50) if i % 10 != 9], "source string, target string")
    before = _written_tables(spark)
    found = graph.components(nodes, edges)
    left = _written_tables(spark) - before
    assert len(left) == 1 and not any(t.startswith("pairs") for t in left)
    expected = {f"n{i:03}": f"n{i // 10 * 10:03}" if i < 50 else f"n{i:03}" for i in range(60)}
    for _ in range(2):
        assert {r["address"]: r["cluster"] for r in found.collect()} == expected
    before = _written_tables(spark)
    depth = graph.topological_depth(nodes, edges)
    assert sorted(t.split("-")[0] for t in _written_tables(spark) - before) == ["depth", "links"]
    for _ in range(2):
        assert {r["address"]: r["depth"] for r in depth.collect()} == {f"n{i:03}": i % 10 if i < 50 else 0 for i in range(60)}


def test_what_led_to_a_shared_table_is_deleted(spark, tmp_path):
    from gridloom.plans.registry import Loader
    from gridloom.session import cut_lineage, discard, keep, passing_tables

    load = Loader(spark, str(tmp_path))
    before = _written_tables(spark)

    def outer():
        inner = load.shared("inner-table", lambda: cut_lineage(spark.range(9), "passing"))
        with passing_tables(spark):
            dropped, kept = cut_lineage(inner, "dropped"), keep(cut_lineage(inner, "handed-up"))
            assert dropped.count() == 9
            discard(cut_lineage(inner, "discarded"))
        assert kept.count() == 9
        return inner.join(kept, "id")

    shared = load.shared("outer-table", outer)
    assert sorted(t.split("-")[0] for t in _written_tables(spark) - before) == ["inner", "outer"]
    assert shared.count() == 9 and load.shared("inner-table", outer).count() == 9
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_neighbours_and_labels_across_tiles(spark):
    """Every place of a block that spans several tiles, against plain Python."""
    draw = random.Random(5)
    kinds = {(r, c): draw.choice(["label", "input", "output", "static", "structural", None]) for r in range(1, 21) for c in range(1, 19)}
    rows = [("s", r, c, f"s!{r}.{c}", f" v{r}.{c} ", k) for (r, c), k in kinds.items() if k]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, address string, value string, role string")
    live = ("input", "output", "intermediate")
    ways = {"right": (0, 1), "left": (0, -1), "below": (1, 0), "above": (-1, 0)}
    expected = sorted(
        (f"s!{r}.{c}", f"s!{r + dr}.{c + dc}", way) for (r, c), k in kinds.items() if k == "label"
        for way, (dr, dc) in ways.items() if kinds.get((r + dr, c + dc)) in live
    )
    found = grid.neighbour_join(cells).collect()
    assert sorted((x["address"], x["neighbour"], x["direction"]) for x in found) == expected

    def nearest(r, c):
        for at in [(r, x) for x in range(c, 0, -1)] + [(y, c) for y in range(r, 0, -1)]:
            if kinds.get(at) in ("label", "structural"):
                return f"v{at[0]}.{at[1]}"

    got = {x["address"]: x["label"] for x in grid.nearest_label(cells).collect()}
    assert got == {f"s!{r}.{c}": nearest(r, c) for (r, c), k in kinds.items() if k in live}
    plain = cells.withColumn("value_type", F.lit("text")).replace({"label": "static", "structural": "other"}, subset=["role"])
    marked = {x["address"] for x in grid.label_cells(plain).filter("role = 'label'").collect()}
    beside = {f"s!{r}.{c}" for (r, c), k in kinds.items() if k in ("label", "static")
              and any(kinds.get((r + dr, c + dc)) in live for dr, dc in ways.values())}
    assert marked == beside


def test_many_different_places_are_still_members(spark, monkeypatch):
    monkeypatch.setattr(grid, "_FEW_PLACES", 3)
    cells = sheet(spark, *[(f"A{i}", str(i), None) for i in range(1, 9)], ("C1", None, "=SUM(A1:A8)"), ("C2", None, "=SUM(A7:A9)+A8"))
    edges = [(r["source"][7:], r["target"][7:]) for r in grid.edge_list(cells).collect()]
    assert sorted(edges) == sorted([(f"A{i}", "C1") for i in range(1, 9)] + [("A7", "C2"), ("A8", "C2")])


def test_base_roles_in_slices_are_those_of_one_pass(spark, monkeypatch):
    cells = sheet(
        spark, ("A1", "Amount", None), ("B1", "100", None), ("C1", None, "=B1*2+Z9+Other!D4"), ("D1", None, "=C1+10"),
        ("A3", "Section Header", None, "bold", "merged"),
    )
    edges = grid.edge_list(cells).cache()
    columns = ["address", "sheet", "row", "col", "value_type", "role"]
    whole = sorted(tuple(r) for r in grid.classified(cells, edges)[0].select(*columns).collect())
    assert {(a, r) for a, *_, r in whole if a.endswith(("Z9", "D4"))} == {("Sheet1!Z9", "input"), ("Other!D4", "input")}
    monkeypatch.setattr(grid, "_SLICE_EDGES", 2)
    assert sorted(tuple(r) for r in grid.classified(cells, edges)[0].select(*columns).collect()) == whole
