import random
from collections import defaultdict

from tessella.operators import communities


def plain_modularity(edges, label, resolution=1.0):
    k, inner, total = defaultdict(float), 0.0, 2.0 * sum(w for *_, w in edges)
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
        inner += 2 * w * (label[a] == label[b])
    return inner / total - resolution * sum(x * x for x in k.values()) / total**2


def plain_communities(edges, resolution=1.0):
    """One node after the other to its best community, then the same on what they make up, until nothing moves."""
    label, total = {}, 2.0 * sum(w for *_, w in edges)
    graph, group = defaultdict(lambda: defaultdict(float)), {}
    for a, b, w in edges:
        graph[a][b] += w
        graph[b][a] += w
    members = {v: {v} for v in graph}
    while True:
        label, k = {v: v for v in graph}, {v: sum(e.values()) for v, e in graph.items()}
        sums, went = dict(k), True
        any_went = False
        while went:
            went = False
            for v in sorted(graph):
                reach = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        reach[label[u]] += w
                sums[label[v]] -= k[v]
                best = max([label[v], *sorted(reach)], key=lambda c: reach[c] - resolution * k[v] * sums[c] / total)
                if reach[best] - resolution * k[v] * sums[best] / total <= reach[label[v]] - resolution * k[v] * sums[label[v]] / total + 1e-12:
                    best = label[v]
                went |= best != label[v]
                any_went |= best != label[v]
                label[v] = best
                sums[best] += k[v]
        group = {s: label[v] for v, ss in members.items() for s in ss}
        if not any_went:
            return group
        above, joined = defaultdict(lambda: defaultdict(float)), defaultdict(set)
        for v, e in graph.items():
            joined[label[v]] |= members[v]
            for u, w in e.items():
                above[label[v]][label[u]] += w
        graph, members = above, joined


def planted(rng, groups, size, inside, outside):
    return [(a, b, float(rng.randint(1, 5))) for a in range(groups * size) for b in range(a + 1, groups * size) if rng.random() < (inside if a // size == b // size else outside)]


def connected(edges, members):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a in members and b in members:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [min(members)]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v]
    return seen == members


def test_planted_groups_and_modularity(spark):
    rng = random.Random(2)
    for groups, size, inside, outside, resolution in [(5, 12, 0.7, 0.02, 1.0), (4, 20, 0.3, 0.06, 1.2)]:
        edges = planted(rng, groups, size, inside, outside)
        df = spark.createDataFrame(edges, "src long, dst long, weight double")
        found = communities.communities(df, resolution)
        label = {r["sample"]: r["cluster"] for r in found.collect()}
        ours, plain = plain_modularity(edges, label, resolution), plain_modularity(edges, plain_communities(edges, resolution), resolution)
        assert ours >= plain - 0.002
        row = communities.modularity(df, found, resolution).first()
        assert abs(row["modularity"] - ours) < 1e-9 and row["communities"] == len(set(label.values()))
        members = defaultdict(set)
        for s, c in label.items():
            members[c].add(s)
        assert all(connected(edges, m) for m in members.values())
        assert [min(members[c]) for c in sorted(members)] == sorted(min(m) for m in members.values())
        if outside < 0.05:
            assert sorted(map(sorted, members.values())) == [list(range(g * size, (g + 1) * size)) for g in range(groups)]


def test_equal_seeds_give_equal_partitions(spark):
    edges = planted(random.Random(8), 3, 10, 0.5, 0.1)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    again = spark.createDataFrame([(b, a, w) for a, b, w in reversed(edges)], "src long, dst long, weight double").repartition(7)
    assert sorted(communities.communities(df, seed=3).collect()) == sorted(communities.communities(again, seed=3).collect())


def test_two_parts_loops_and_no_edges(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (3, 4, 2.0), (4, 4, 9.0)], "src long, dst long, weight double")
    assert sorted(map(tuple, communities.communities(df).collect())) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert communities.communities(df.limit(0)).count() == 0
    assert communities.modularity(df.limit(0), df.select(df.src.alias("sample"), df.dst.alias("cluster"))).first()["modularity"] is None
