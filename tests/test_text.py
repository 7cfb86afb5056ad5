"""Parser goldens, the loader's rules and the command line."""

import pytest

from deltaweave import report
from deltaweave.__main__ import main
from deltaweave.plans.query_graph import QueryError, parse_query
from deltaweave.sources.text import InputError, default_label, load_dataset, parse_records, read_lines, write_graph


def records(spark, tmp_path, text, stream):
    (tmp_path / "f").write_bytes(text.encode())
    return [(r.line, r.kind, r.op if r.kind == "edge" else None, r.u and int(r.u), r.v and int(r.v), r.label if r.label is None else int(r.label)) for r in parse_records(read_lines(spark, str(tmp_path / "f")), stream).orderBy("line").collect()]


def test_stream_lines(spark, tmp_path):
    text = "# c\n\n  \t\r\n%x\ne 5 5\ne -3 -4\n+e -3 -4\n-e -3 -4\ne -3 4\ne -0 -1\ne 1 2 x\ne 1 2 7 junk\ne 1\nt 3 2\n-v 9\n+v 3 4\nv 3\n-e 8 9 1\r\n\te  1\t 2 \nzz"
    got = records(spark, tmp_path, text, True)
    kinds = {line: kind for line, kind, *_ in got}
    assert [kinds[i] for i in (8, 9, 10, 13, 14, 17, 20)] == ["malformed"] * 7
    assert kinds[15] == "ignored" and kinds[16] == "vertex" and kinds[5] == "edge"
    edges = {line: x for line, kind, *x in got if kind == "edge"}
    assert edges[6] == edges[7] == ["D", 2, 3, None]
    assert edges[11] == ["I", 1, 2, None] and edges[12] == ["I", 1, 2, 7]
    assert edges[18] == ["D", 8, 9, 1] and edges[19] == ["I", 1, 2, None]


def test_graph_lines(spark, tmp_path):
    big = "9" * 38
    got = records(spark, tmp_path, f"t 3 2\nv 1 2\ne 1 {big}\ne 1 {big}0\n+e 1 2\nv 1 x\ne 1 2 12345678901234567890", False)
    assert [k for _, k, *_ in got] == ["hint", "vertex", "edge", "malformed", "malformed", "malformed", "edge"]
    assert got[2][4] == int(big) and got[6][5] is None


def test_query_rules():
    q = parse_query("t 2 1\nv 1 2\nv 1 3\n# c\nv 2 4\ne 2 1 9\ne 1 2 8\n")
    assert q.labels == [3, 4] and q.edges == {(0, 1): 9} and q.labelled
    assert parse_query("e 1 2\ne 2 1", directed=True).edges == {(0, 1): None, (1, 0): None}
    for bad in ("", "v 1 1", "e 0 0", "x 1", "e 1 2\ne 3 4", "e 1", "v 1", "v a 1\ne a 1", "\n".join(f"e {i} {i + 1}" for i in range(32))):
        with pytest.raises(QueryError):
            parse_query(bad)
    shape = parse_query("v 1 0\nv 2 0\nv 3 1\ne 1 2\ne 2 3").shape()
    assert shape == {"vertices": 3, "edges": 2, "max_degree": 2, "diameter": 2, "labels": 2}


def test_default_label():
    assert default_label([1, 2], [5], 7) == 7 and default_label([3], [5], None) == 3
    assert default_label([], [5, 5], None) == 5 and default_label([], [5, 6], None) == 0 and default_label([1, 2], [5], None) == 0


GRAPH = "t 4 3\nv 1 0\nv 2 0\nv 1 1\ne 1 2 9\ne 2 1 4\ne 2 3\ne 3 3\n"
STREAM = "v 3 0\nv 4 0\ne 1 3\ne 1 3 5\n-e 2 3\ne 3 4\n-e 7 8\ne 4 4\n-v 1\nv 2 5\n"
QUERY = "v 1 0\nv 2 0\nv 3 0\ne 1 2\ne 2 3\ne 1 3\n"


def write(tmp_path, **texts):
    for k, v in texts.items():
        (tmp_path / k).write_text(v)
    return [str(tmp_path / k) for k in texts]


def test_dataset(spark, tmp_path):
    g, s = write(tmp_path, g=GRAPH, s=STREAM)
    d = load_dataset(spark, g, s, QUERY)
    assert {r.id: r.label for r in d.vertices.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 7: 0, 8: 0}
    assert d.report["nodes"] == 3 and d.report["edges"] == 4 and d.report["relabel_ignored"] == 2 and d.report["initial_edges"] == 2
    assert (d.report["insertions"], d.report["deletions"], d.report["stream_self_loops"]) == (3, 2, 1)
    deltas, summary = report.run(d)
    assert summary["dm_pos"] == 6 and summary["dm_neg"] == 6 and summary["noop"] == 2 and summary["complete"]
    assert [r.delta for r in deltas.orderBy("seq").collect()] == [6, 0, 6, 0, 0]
    assert "6 added, 6 deleted" in report.short(d, summary, g, "q") and "dm_pos=6" in report.result_line(d, summary)
    assert "label 0: 6 vertices" in report.dataset_report(d) and "anchor" in report.plan_report(d)
    assert report.result_frame(spark, d, summary).first()["dm_pos"] == 6


def test_wide_ids(spark, tmp_path):
    big = 10**37
    g, s = write(tmp_path, g=f"e {big} 1\ne 1 2\n", s=f"e 2 {big}\n")
    _, summary = report.run(load_dataset(spark, g, s, "e 1 2\ne 2 3\ne 1 3"))
    assert summary["dm_pos"] == 6


def test_too_many_malformed_lines(spark, tmp_path):
    g, s = write(tmp_path, g="x\n" * 101 + "e 1 2\n" * 100, s="e 1 2\n")
    with pytest.raises(InputError):
        load_dataset(spark, g, s, QUERY)
    g, s = write(tmp_path, g="x\n" * 101 + "e 1 2\n" * 2000, s="e 1 2\n")
    load_dataset(spark, g, s, QUERY)


def test_command_line_and_writer(spark, tmp_path, capsys):
    g, s, q = write(tmp_path, g=GRAPH, s=STREAM, q=QUERY)
    assert main(["--graph", g, "--stream", s, "--query", q, "--verbose", "--name", "n", "--out", str(tmp_path / "o")]) == 0
    out = capsys.readouterr().out
    assert "Matches found  : 6 added, 6 deleted" in out and "RESULT " in out
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
    assert main(["--graph", g, "--stream", s, "--query", q, "--batch", "3", "--out", str(tmp_path / "b")]) == 0
    assert sum(r.delta for r in spark.read.parquet(str(tmp_path / "b" / "deltas")).collect()) == 12
    d = load_dataset(spark, g, s, QUERY)
    write_graph(d.vertices, d.log.where("seq = 0"), str(tmp_path / "w"))
    again = load_dataset(spark, str(tmp_path / "w"), s, QUERY)
    assert report.run(again)[1]["dm_pos"] == 6


def test_time_limit_gives_lower_bounds(spark, tmp_path):
    g, s = write(tmp_path, g=GRAPH, s=STREAM)
    _, summary = report.run(load_dataset(spark, g, s, QUERY), time_limit=0.0)
    assert summary["dm_pos"] <= 6


def test_rare_first_order_gives_the_same_deltas(spark, tmp_path):
    from deltaweave.plans.match_plan import RARE_FIRST, RI

    (tmp_path / "g").write_text("v 0 0\nv 1 1\nv 2 2\nv 3 2\ne 0 1\ne 1 2\n")
    (tmp_path / "s").write_text("e 0 2\ne 0 3\ne 1 3\n-e 0 1\n")
    got = []
    for kind in (RI, RARE_FIRST):
        data = load_dataset(spark, str(tmp_path / "g"), str(tmp_path / "s"), "v 0 0\nv 1 1\nv 2 2\ne 0 1\ne 1 2\ne 0 2\n")
        got.append(sorted(tuple(r) for r in report.run(data, kind=kind)[0].collect()))
    assert got[0] == got[1] and any(r[2] for r in got[0])
