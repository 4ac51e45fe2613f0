"""Paths of nodes as an Arrow array."""

import pyarrow as pa

from tracelake.sources import flow


def test_paths_become_lists_of_steps_without_dictionaries():
    paths = [[], [(0, "true"), (3, "case")], [], [(1, "false")]]
    got = flow._path_array(paths)
    assert got.to_pylist() == [[{"node": n, "branch": b} for n, b in p] for p in paths]
    assert got.type.value_type == pa.struct([("node", pa.int32()), ("branch", pa.string())]) and len(flow._path_array([])) == 0
