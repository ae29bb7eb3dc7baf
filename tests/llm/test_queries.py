"""The p queries on the smallest tables: columns, SQL where there is any, and independence of the rest of the library."""

import os
import re

import pytest

from citeloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["train_qid", "eval_qid"], "p2_found": ["pubkey"], "p3_found": ["run_id", "qid", "docid"], "p4_found": ["vec_id_a", "vec_id_b"], "p5_found": ["qid", "lang"],
    "p6_found": ["qid", "defect"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs(spark, name):
    df = Q.queries()[name](spark, DATA)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p7_ids":
            assert len(set(rows)) == len(rows)
    if name in Q.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
        found = con.execute(Q.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(Q.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"citeloom\.llm|from \.+llm", open(os.path.join(folder, f)).read()), f
