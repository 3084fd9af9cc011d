import os

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name,lacking,column", [("browse_themes_of_department", "departments", "department_code"), ("browse_subdomains", "domains", "slug"), ("browse_faculty_page", "domains", "slug")])
def test_a_node_that_the_tables_lack_has_no_rows(spark, tmp_path, name, lacking, column):
    for t in ("papers", "thematic_areas", "domains", "subdomains", "departments"):
        if t != lacking:
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SF}/{lacking}.parquet").where(f"lower({column}) NOT IN ('pp01', 'applied-photonics-and-slope-design')").write.parquet(str(tmp_path / f"{lacking}.parquet"))
    got, kept = entry.queries()[name](spark, str(tmp_path)), entry.queries()[name](spark, SF)
    want = duck(str(tmp_path)).sql(entry.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall()) and not got.count()
    assert got.dtypes == kept.dtypes and kept.count()
