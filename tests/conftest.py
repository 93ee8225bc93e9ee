import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roundhouse import Dims, get_spark  # noqa: E402
from roundhouse.dims import Unit  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        # small data would otherwise end up in one partition, and nothing would cross a slice edge
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    session = get_spark("tests", "local[4]", conf)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def dims():
    return Dims(
        units={
            "U1": Unit(1, ("TraitA",)),
            "U2": Unit(2, ("TraitA", "TraitB")),
            "U3": Unit(3, ("TraitA",)),
            "U4": Unit(4, ("TraitB",)),
            "U5": Unit(None, ()),
        },
        traits={"TraitA": (2, 4), "TraitB": (1, 3)},
        emblems={"EmblemA": "TraitA", "EmblemB": "TraitB"},
        items=("Item1", "Item2", "Item3"),
        patches=(("P2", 2000), ("P1", 1000)),
    )
