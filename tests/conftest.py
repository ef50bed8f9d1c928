from __future__ import annotations

import os

import pytest

from refload.operators.tables import Warehouse
from refload.session import build_session, new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session()


@pytest.fixture
def warehouse(spark):
    root = new_folder(spark, "test")
    tag = root.rsplit("-", 1)[1]
    return Warehouse(spark, root, f"ref_{tag}", f"bkp_{tag}").prepare()


@pytest.fixture
def write_file(tmp_path):
    def write(name: str, content: str | bytes) -> str:
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return os.fspath(path)

    return write
