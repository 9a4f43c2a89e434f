import os

from brindle.llm import common


def test_tables_are_written_to_the_shared_folder_and_cleaned(spark):
    work = common.Written(spark, "t")
    d = work.table(spark.range(5), "five")
    at = d.written_at.removeprefix("file:")
    assert at.startswith(common.shared_dir(spark).removeprefix("file:")) and os.path.isdir(at) and d.count() == 5
    work.drop(d)
    assert not os.path.exists(at)
    kept = work.table(spark.range(2), "two").written_at.removeprefix("file:")
    common.clean(spark)
    assert not os.path.exists(kept)
