import __spark_entry__


def test_names_agree():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    assert "metrics" in names


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
