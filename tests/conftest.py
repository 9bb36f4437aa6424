import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gradeweave.schema import SCORE_SCHEMA  # noqa: E402
from gradeweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores="8", shuffle_partitions=4, scratch=str(tmp_path_factory.mktemp("scratch")))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def scores_of(spark):
    """Scores from dicts; what is not given is one senior's oral score of one term."""

    def build(rows):
        from decimal import Decimal

        full = []
        for i, r in enumerate(rows, 1):
            first, last = r.get("first"), r.get("last")
            full.append((
                r.get("ord", i * 10000 + 9), first, last,
                r.get("id", f"{first or ''} {last or ''}"),
                r.get("semester", "Spring 2019"), r.get("sort", "20191"),
                r.get("standing", "4 - Senior"), r.get("emphasis", "Generalist"),
                r.get("name", "Oral"), Decimal(str(r.get("score", 4))),
            ))
        return spark.createDataFrame(full, SCORE_SCHEMA)

    return build
