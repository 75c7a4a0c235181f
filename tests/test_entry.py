import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_pointer_file_rejected(spark, tmp_path):
    from crease.sources.deliveries import DataUnavailableError, reject_pointer_file
    p = tmp_path / "balls.csv"
    p.write_text("  Version https://git-LFS.github.com/spec/v1\noid sha256:abc\nsize 1\n")
    with pytest.raises(DataUnavailableError):
        reject_pointer_file(spark, str(p))
