from odd_tables import ROWS, documents

from salmoura.llm import line_dedup


def by_row(df, **options):
    return sorted((tuple(r) for r in line_dedup.cleaned(df, **options).select("_0", "__text", "__lines", "__dropped").collect()), key=str)


def test_lines_on_many_pages_of_a_site_go(spark):
    rows = [(i, f"Menu \nown {i}\n\nrare {i // 2}\n Menu", "a") for i in range(40)]
    rows += [(100 + i, f"Menu\nother {i}", f"b{i}") for i in range(3)] + [(200 + i, "copy of one page\nMenu", "a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {i: (t, n, d) for i, t, n, d in by_row(df)}
    assert found[5] == ("own 5\n\nrare 2", 5, 2)
    assert found[101] == ("Menu\nother 1", 2, 0)      # one page on its site
    assert found[200] == ("copy of one page", 2, 1)   # thirty fetches are one page
    assert {i: t for i, (t, *_) in found.items() if i in (0, 1)} == {0: "own 0\n\nrare 0", 1: "own 1\n\nrare 0"}


def test_odd_rows(spark):
    df = documents(spark)
    found = by_row(df, percent=50)
    assert len(found) == len(ROWS)
    by_id = {i: (t, n, d) for i, t, n, d in found}
    assert by_id[3] == (None, 0, 0) and by_id[4] == ("", 1, 0) and by_id[8] == ("my own words here", 3, 2)
    cleaned = line_dedup.without_boilerplate(df, percent=50)
    assert cleaned.columns == df.columns and dict(cleaned.dtypes) == dict(df.dtypes)
    row = cleaned.filter("doc_id = 8").first()
    assert row["n_chars"] == len("my own words here") and row["_site"] == "x"
    assert cleaned.filter("doc_id = 7").first()["n_chars"] == 9  # untouched texts keep what was given
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0
