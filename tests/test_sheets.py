"""Workbooks: headers and blank columns of all sheets in two queries."""

import pytest

from shelfpulse.sources import sheets as SH


def _book(tmp_path):
    (tmp_path / "a.csv").write_text(" id ,city,, note ,City\n1,x,zz,,p\n , ,, ,\n2,,,,q\n")
    (tmp_path / "b.csv").write_text('"k,1","say ""hi"""\n"a,b",7\n007,\n')
    (tmp_path / "c.csv").write_text("only,headers\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e").mkdir()
    for n in (1, 2):
        (tmp_path / "e" / f"part-{n}.csv").write_text(f"x,y\n{n},{n * 10}\n")
    return {n: str(tmp_path / (f"{n}.csv" if n != "e" else "e")) for n in "abcde"}


def test_sheets_of_a_workbook(spark, tmp_path):
    got = SH.read_sheets(spark, _book(tmp_path))
    assert got["a"].columns == ["id", "city", "City4"]
    assert sorted(map(tuple, got["a"].collect())) == [("1", "x", "p"), ("2", None, "q")]
    assert got["b"].columns == ["k,1", 'say "hi"'] and sorted(map(tuple, got["b"].collect()), key=str) == [("007", None), ("a,b", "7")]
    assert got["c"].columns == [] and got["d"].columns == []
    assert sorted(map(tuple, got["e"].collect())) == [("1", "10"), ("2", "20")]
    assert SH.read_sheets(spark, {}) == {}
    both = SH.union_sheets({n: got[n] for n in "ae"})
    assert both.columns == ["id", "city", "City4", "sheet", "x", "y"] and both.count() == 4


def test_two_queries_for_all_sheets(spark, tmp_path, monkeypatch):
    paths = _book(tmp_path)
    frame = type(spark.range(1))
    ran, collect = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: ran.append(df) or collect(df))
    for action in ("first", "head", "count", "toPandas"):
        monkeypatch.setattr(frame, action, lambda *a, **k: pytest.fail("another query ran"))
    for wanted in ("a", "ab", "abce"):
        ran.clear()
        SH.read_sheets(spark, {n: paths[n] for n in wanted})
        assert len(ran) == 2


def test_files_of_a_sheet_share_a_header(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "s" / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        SH.read_sheet(spark, str(tmp_path / "s"))
