"""The queries of this subpackage run and have their columns; nothing outside imports the subpackage."""

import re
from pathlib import Path

import pytest

from citeloom.llm import queries

COLUMNS = {
    "p1_found": ["author_id_a", "author_id_b"],
    "p2_found": ["first_row_id", "field_name", "row_id"],
    "p4_found": ["first_row_id", "row_id"],
    "p6_found": ["entry_id", "cand_id"],
    "p7_found": ["block_id", "sent_no", "end_off"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "begin_off", "end_off", "pii_type"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, data_dir):
    df = queries.QUERIES[name](spark, data_dir)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    assert df.count() > 0


def test_nothing_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "citeloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"citeloom\.llm|from \.+llm", p.read_text()), p
