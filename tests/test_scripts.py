"""SQL scripts."""

from kelpline.sources.scripts import run_script, statements


def test_semicolons_in_text_and_comments_end_nothing(spark, tmp_path):
    script = "-- first; not a statement\nSELECT 'a;b' AS x, 4 / 2 - 1 AS y /* ; */;\n\nSELECT `c;d` FROM VALUES (1) t(`c;d`) ;;"
    assert len(statements(script)) == 2 and statements("-- only\n;") == []
    (tmp_path / "s.sql").write_text(script)
    first, second = run_script(spark, str(tmp_path / "s.sql"))
    assert tuple(first.first()) == ("a;b", 1.0) and second.first()[0] == 1
