"""The training-text queries where workers have no copy of the package."""

import sys
from pathlib import Path

from symbolake.llm.queries import QUERIES

sys.path.insert(0, str(Path(__file__).parent.parent))
import bare_workers  # noqa: E402


def test_run_without_the_package(data, tmp_path):
    bare_workers.run("symbolake.llm.queries", list(QUERIES), data, tmp_path)
