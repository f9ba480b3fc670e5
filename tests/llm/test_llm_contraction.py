"""Contraction of a chunk of edges against a plain union-find."""

import numpy as np

from tracewell.llm.components import least_reachable


def by_union_find(edges):
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent if top(x) != x}


def test_least_reachable():
    random = np.random.default_rng(1)
    for _ in range(200):
        edges = random.integers(-20, 20, (random.integers(0, 40), 2))
        edges = edges[edges[:, 0] != edges[:, 1]]
        node, root = least_reachable(edges[:, 0], edges[:, 1])
        assert dict(zip(node.tolist(), root.tolist())) == by_union_find(edges.tolist())


def test_least_reachable_of_a_long_path():
    path = np.random.default_rng(2).permutation(20_001)
    node, root = least_reachable(path[1:], path[:-1])
    assert len(node) == 20_000 and not root.any()
