from __future__ import annotations

import csv
import io
import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


def published(heading: str) -> list[dict[str, str]]:
    """Rows of the CSV block under a heading of FIXTURES.md."""
    text = open(os.path.join(ROOT, "FIXTURES.md"), encoding="utf-8").read()
    part = text.split(f"### {heading}", 1)[1]
    block = re.search(r"```csv\n(.*?)```", part, re.S).group(1)
    return list(csv.DictReader(io.StringIO(block)))


@pytest.fixture(scope="session")
def golden():
    return published
