import random

from tidegraph.operators import algorithms as A
from tidegraph.queries import algorithms as Q


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def test_louvain_ends_where_no_vertex_gains(spark):
    rng = random.Random(5)
    pairs = {(f"v{i:02}", f"v{(i + 1) % 40:02}") for i in range(40)} | {tuple(f"v{x:02}" for x in sorted(rng.sample(range(40), 2))) for _ in range(20)}
    at = {r.id: r.community for r in A.distributed_louvain(edges(spark, pairs), levels=1).collect()}
    m = len(pairs)
    degree = {v: sum(v in p for p in pairs) for v in at}
    for v, own in at.items():
        near = {c: sum(1 for p in pairs if v in p and p[0] != p[1] and at[p[1] if p[0] == v else p[0]] == c) for c in set(at.values())}
        gain = {c: n - degree[v] * sum(degree[x] for x in at if at[x] == c and x != v) / (2 * m) for c, n in near.items()}
        assert max(gain.values()) <= gain[own] + 1e-6


def test_registered_with_the_defaults(spark, monkeypatch):
    chain = edges(spark, [(f"v{i:02}", f"v{i + 1:02}") for i in range(30)])
    monkeypatch.setattr(Q, "_match", lambda spark, d: chain)
    rows = lambda df: {tuple(r) for r in df.select("id", "community").collect()}
    assert rows(Q.label_propagation_full(spark, "")) == rows(A.label_propagation(chain)) != rows(Q.label_propagation(spark, ""))
    assert rows(Q.louvain_communities(spark, "")) == rows(A.louvain(chain))


def modularity(pairs, at):
    m, degree, inside = len(pairs), {}, 0
    for a, b in pairs:
        inside += at[a] == at[b]
        for v in (a, b):
            degree[v] = degree.get(v, 0) + 1
    whole = {}
    for v, k in degree.items():
        whole[at[v]] = whole.get(at[v], 0) + k
    return inside / m - sum((k / (2 * m)) ** 2 for k in whole.values())


def test_parts_of_any_size_are_done_alike(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample([f"{g}{i:02}" for i in range(12)], 2))) for g in "abcdef" for _ in range(30)} | {("a00", "b00"), ("b01", "c01"), ("d02", "e02")} | {("x1", "x2"), ("y", "y")})
    df = edges(spark, pairs)
    local = {r.id: r.community for r in A.louvain(df).collect()}
    mixed = {r.id: r.community for r in A.louvain(df, local_edges=100).collect()}
    spread = {r.id: r.community for r in A.distributed_louvain(df).collect()}
    assert set(local) == set(mixed) == set(spread) == {v for p in pairs for v in p}
    scores = [modularity(pairs, x) for x in (local, mixed, spread)]
    assert min(scores) > 0.9 * max(scores) > 0.6
    assert all(v >= c and local[c] == c for v, c in local.items()) and local["x1"] == local["x2"] == "x1" and local["y"] == "y"
    assert A.louvain(df.limit(0)).count() == 0
