from __future__ import annotations

from pathlib import Path

from cloakwork.session import release, scratch_dir, stored


def test_stored_tables_can_be_released(spark):
    kept = stored(spark.range(3), "numbers")
    place = Path(scratch_dir(spark, "other").removeprefix("file:")).parent
    assert kept.count() == 3 and list(place.glob("numbers-*"))
    release(spark)
    assert not list(place.glob("numbers-*"))
