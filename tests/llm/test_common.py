"""What the operators share."""

import threading

import pytest

from strainframe.llm.common import cleared, written


def test_cleared_deletes_what_its_own_block_wrote(spark):
    before = written(spark.range(3), "before")
    with cleared(spark):
        own = written(spark.range(4), "own")
        other = []
        thread = threading.Thread(target=lambda: other.append(written(spark.range(5), "other")))
        thread.start()
        thread.join()
        with cleared(spark):
            inner = written(spark.range(6), "inner")
        with pytest.raises(Exception):
            inner.count()
        assert own.count() == 4
    with pytest.raises(Exception):
        own.count()
    assert (before.count(), other[0].count()) == (3, 5)
