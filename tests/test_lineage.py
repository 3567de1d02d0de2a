import os

from postloom.plans.lineage import _own_folder, cut, drop_cuts


def test_cut_and_drop(spark):
    df = cut(spark.range(7))
    folder = _own_folder(spark).removeprefix("file:")
    assert df.count() == 7 and os.listdir(folder)
    drop_cuts(spark)
    assert not os.path.exists(folder)
    assert cut(spark.range(3)).count() == 3
