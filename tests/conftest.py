import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, app_name="graphloom-tests")
    yield s
    s.stop()


def edges_df(spark, rows):
    """rows: (edge_id, src, tgt[, type[, confidence]])"""
    full = []
    for r in rows:
        eid, s, t = r[:3]
        typ = r[3] if len(r) > 3 else "CALLS"
        conf = r[4] if len(r) > 4 else "deterministic"
        full.append((eid, s, t, typ, conf, ""))
    return spark.createDataFrame(
        full, "edge_id string, source_node_id string, target_node_id string, type string, "
              "confidence string, evidence string")


def nodes_df(spark, ids):
    return spark.createDataFrame([(i, "x", "f") for i in ids],
                                 "node_id string, chunk_type string, source_file string")
