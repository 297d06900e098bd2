"""HTML extraction: nesting, entities, short rows, open elements."""

import datetime as dt

from shelfpulse.sources import pages as PG


def dates(spark, html, **kw):
    df = spark.createDataFrame([(html, 7)], "html string, id int")
    return sorted((r["date"], r["name"]) for r in PG.extract_table_rows(df, 2024, **kw).collect())


def table(rows, head="<th>March 2024</th><th>x</th>"):
    return f"<table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>"


def test_short_and_empty_rows_are_skipped(spark):
    rows = "<tr></tr><tr><td>4</td></tr><tr><th>5</th><td>one</td></tr><tr><td>6</td><td>Holi</td><td>more</td></tr>"
    assert dates(spark, table(rows)) == [(dt.date(2024, 3, 6), "Holi")]


def test_entities_comments_and_scripts(spark):
    rows = "<tr><td>1&nbsp;Fri</td><td>Foo &amp; <b>Bar</b> &#233;<!-- no --><script>var x = '<td>';</script></td></tr>"
    assert dates(spark, table(rows)) == [(dt.date(2024, 3, 1), "Foo & Bar é")]


def test_nested_tables_are_text_of_the_cell_and_tables_of_their_own(spark):
    inner = table("<tr><td>9</td><td>inner</td></tr>", "<th>May</th>")
    got = dates(spark, table(f"<tr><td>2</td><td>outer {inner}</td></tr><tr><td>3</td><td>next</td></tr>"))
    assert got == [(dt.date(2024, 3, 2), "outer May 9 inner"), (dt.date(2024, 3, 3), "next"), (dt.date(2024, 5, 9), "inner")]


def test_open_cells_and_rows_end_where_the_next_start(spark):
    assert dates(spark, table("<tr><td>2<td>a<tr><td>3<td>b")) == [(dt.date(2024, 3, 2), "a"), (dt.date(2024, 3, 3), "b")]
    assert dates(spark, "<table><thead><tr><th>June<tbody><tr><td>30<td>cut off") == [(dt.date(2024, 6, 30), "cut off")]


def test_month_argument_header_and_odd_days(spark):
    html = table("<tr><td>31</td><td>x</td></tr><tr><td>32</td><td>no</td></tr><tr><td>1st</td><td>no</td></tr><tr><td></td><td>no</td></tr>")
    html += table("<tr><td>31</td><td>no such day</td></tr><tr><td>30</td><td>y</td></tr>", "<th> April </th>")
    html += "<table><tbody><tr><td>1</td><td>no header</td></tr></tbody></table><table><tr><td>1</td><td>no body</td></tr></table>"
    assert dates(spark, html) == [(dt.date(2024, 3, 31), "x"), (dt.date(2024, 4, 30), "y")]
    assert dates(spark, html, month=4) == [(dt.date(2024, 4, 30), "y")]


def test_day_cells(spark):
    html = ('<td class="a single-day b" data-date="2024-01-02"><div><div class="x dayCal"> New <b>Year</b> </div></div><div class="dayCal">Second</div>'
            '<div class="dayCal"> </div><div class="Calendar">no</div></td><td class="single-day"><div class="dayCal">no date</div></td>'
            '<td class="not-single-day" data-date="2024-01-03"><div class="dayCal">other class</div></td>'
            '<td class="single-day" data-date="soon"><div class="dayCal">no date</div></td><div class="dayCal">outside</div>'
            '<td class="single-day" data-date="2024-02-29"><div class="fullCal">leap')
    df = spark.createDataFrame([(html, 7), (None, 8), ("", 9)], "html string, id int")
    got = sorted((r["id"], r["date"], r["name"]) for r in PG.extract_day_cells(df, keep=["id"]).collect())
    assert got == [(7, dt.date(2024, 1, 2), "New Year"), (7, dt.date(2024, 1, 2), "Second"), (7, dt.date(2024, 2, 29), "leap")]


def test_stray_end_tags_and_empty_tables(spark):
    html = "</table></td><table></table><table><thead></thead><tbody></tbody></table></tr>" + table("<tr><td>1</td></p><td>a</i></td></tr>")
    df = spark.createDataFrame([(html,)], "html string")
    assert [(r["table_no"], r["cells"]) for r in PG.table_rows(df).collect()] == [(2, ["1", "a"])]
    assert PG.table_rows(spark.createDataFrame([], "html string")).collect() == []
