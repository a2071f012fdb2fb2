"""Partition queries against step-by-step versions over arrays, a scene at a time, and label against label."""

import math
import zlib
from collections import deque

import numpy as np
import pytest

from lithomesh.operators import cut_pursuit, linkage, supervoxels, voxel_graph, voxels
from lithomesh.plans import catalog
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
NAMES = ["pid", "x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "label"]


@pytest.fixture(scope="module")
def scenes(spark):
    frame = catalog.points(spark, SF).toPandas().sort_values("pid")
    return {s: {n: own[n].to_numpy() for n in NAMES} | {"xyz": own[["x", "y", "z"]].to_numpy(), "rgb": own[["r", "g", "b"]].to_numpy(), "n": own[["nx", "ny", "nz"]].to_numpy()} for s, own in frame.groupby("scene_id")}


def found(spark, name):
    out = {}
    for r in catalog.QUERIES[name](spark, SF).collect():
        out.setdefault(r.scene_id, {})[r.pid] = r.label
    return out


def same_parts(got, pid, label, unlabelled=-1):
    """Whether two partitions are equal up to the names of their parts."""
    one = {}
    for p, b in zip(pid.tolist(), label):
        a = got[p]
        assert (a == unlabelled) == (b == unlabelled)
        one.setdefault(a, set()).add(b)
    assert all(len(x) == 1 for x in one.values()) and len({min(x) for x in one.values()}) == len(one)
    assert len(got) == len(pid)


def distances(xyz):
    return np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))


def nearest(xyz, k):
    """Indices of the k nearest other points, ties by index."""
    d = distances(xyz)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def both_ways(near):
    out = [set() for _ in near]
    for i, own in enumerate(near):
        for j in own.tolist():
            out[i].add(j)
            out[j].add(i)
    return [sorted(x) for x in out]


def spectrum(points, normalised=True):
    c = np.cov(points.T, bias=True) * (1 if normalised else len(points))
    values, vectors = np.linalg.eigh(c)
    return np.maximum(values[::-1], 0), vectors[:, ::-1].T


def test_refined_labels(spark, scenes):
    got = found(spark, "refined_labels")
    for s, p in scenes.items():
        near = both_ways(nearest(p["xyz"], catalog.NEAR))
        label = np.where(p["pid"] % 7 == 0, p["label"], -1).tolist()
        moved = True
        while moved:
            moved = False
            for i in range(len(label)):
                votes = [label[j] for j in near[i] if label[j] != -1]
                if label[i] == -1 and votes:
                    label[i], moved = min(sorted(set(votes)), key=lambda x: -votes.count(x)), True
        top = max(label) + 1
        assert got[s] == {i: (top if x == -1 else x) for i, x in zip(p["pid"].tolist(), label)}


def test_grown_scene(spark, scenes):
    got = found(spark, "grown_scene")
    for s, p in scenes.items():
        near = nearest(p["xyz"], catalog.NEAR)
        shape = [spectrum(p["xyz"][[i, *near[i]]]) for i in range(len(near))]
        flat = np.array([v[2] / (v.sum() + 1e-12) for v, _ in shape]).round(12)  # points of one neighbourhood tie
        normal = np.array([v[2] for _, v in shape])
        edges, limit = both_ways(near), np.quantile(flat, 0.5)
        label, region = {}, 0
        for start in sorted(range(len(flat)), key=lambda i: (flat[i], i)):
            if start in label:
                continue
            label[start], queue = region, deque([start])
            while queue:
                at = queue.popleft()
                for j in edges[at]:
                    if j not in label and abs(normal[j] @ normal[at]) >= math.cos(math.radians(15)):
                        label[j] = region
                        if flat[j] <= limit:
                            queue.append(j)
            region += 1
        same_parts(got[s], p["pid"], [label[i] for i in range(len(flat))])


def grid(xyz, size):
    """Voxel of each point, as tuples."""
    return [tuple(x) for x in np.floor((xyz - xyz.min(0)) / size).astype(int).tolist()]


def test_neighbourhood_normals(spark, scenes):
    cells = voxels.last_point(catalog.points(spark, SF), 0.2)
    got = {(r.scene_id, r.ix, r.iy, r.iz): (r.nx, r.ny, r.nz) for r in voxels.neighbourhood_normals(cells, voxels.neighbour_voxels(cells)).collect()}
    compared = 0
    for s, p in scenes.items():
        at = {c: p["xyz"][i] for i, c in enumerate(grid(p["xyz"], 0.2))}
        touch = lambda c: [o for o in at if o != c and max(abs(a - b) for a, b in zip(c, o)) <= 1]  # noqa: B023, E731
        for c in at:
            ways = [c, *touch(c), *(o for b in touch(c) for o in touch(b))]
            if len(ways) < 3:
                assert (s, *c) not in got
                continue
            values, vectors = spectrum(np.array([at[w] for w in ways]))
            if len(set(ways)) < 3:
                assert (s, *c) not in got
            elif values[1] - values[2] > 1e-6:  # else it hangs on the last digits
                n = vectors[2] if vectors[2] @ at[c] <= 0 else -vectors[2]
                assert np.allclose(got[(s, *c)], n, atol=1e-6)
                compared += 1
    assert compared > 100


def grow(cells, pos, col, normal, start, rounds, weights):
    """Simultaneous rounds: each voxel to the best offer of the supervoxels on it and around it."""
    w_normal, w_colour, w_space, seed = weights
    label, d = dict(start), {c: 0.0 for c in start}
    touch = {c: [o for o in cells if o != c and max(abs(a - b) for a, b in zip(c, o)) <= 1] for c in cells}
    for _ in range(rounds):
        centre = means(label, pos, col, normal)
        cost = lambda c, x: (1 - abs(normal[c] @ centre[x][2])) * w_normal + np.linalg.norm(col[c] - centre[x][1]) / 255 * w_colour + np.linalg.norm(pos[c] - centre[x][0]) / seed * w_space  # noqa: B023, E731
        after, after_d = {}, {}
        for c in cells:
            offers = {label[o] for o in [c, *touch[c]] if o in label}
            best = min(((cost(c, x), x) for x in offers), default=None)
            own = cost(c, label[c]) if c in label else None
            if best and best[0] < (math.inf if own is None else own):
                after_d[c], after[c] = best
            elif c in label:
                after[c], after_d[c] = label[c], own
        label, d = after, after_d
    return label, d


def means(label, pos, col, normal):
    out = {}
    for x in set(label.values()):
        own = [c for c in label if label[c] == x]
        n = sum(normal[c] for c in own)
        out[x] = np.mean([pos[c] for c in own], 0), np.mean([col[c] for c in own], 0), n / np.linalg.norm(n) if np.linalg.norm(n) else n
    return out


def brute_supervoxels(p, res, seed, colour, spatial, normal_weight, refinements):
    voxel = grid(p["xyz"], res)
    last = {c: i for i, c in enumerate(voxel)}
    cells = list(last)
    pos, col = {c: p["xyz"][i] for c, i in last.items()}, {c: p["rgb"][i] for c, i in last.items()}
    sums = {c: sum(p["n"][i] for i, o in enumerate(voxel) if o == c) for c in cells}
    normal = {c: n / np.linalg.norm(n) for c, n in sums.items()}
    xyz, vid = np.array([pos[c] for c in cells]), np.array([p["pid"][last[c]] for c in cells])
    low = xyz.min(0)
    chosen = set()
    for s in sorted(set(grid(xyz, seed))):
        centre = low + (np.array(s) + 0.5) * seed
        chosen.add(min(range(len(cells)), key=lambda i: (np.linalg.norm(xyz[i] - centre), vid[i])))  # noqa: B023
    least = 0.05 * math.pi * (seed / 2) ** 2 / res**2
    seeds = sorted((i for i in chosen if (np.linalg.norm(xyz - xyz[i], axis=1) <= seed / 2).sum() > least), key=lambda i: vid[i])
    rounds = max(1, int(1.8 * seed / res) - 1)
    weights = (normal_weight, colour, spatial, seed)
    label, _ = grow(cells, pos, col, normal, {cells[i]: k + 1 for k, i in enumerate(seeds)}, rounds, weights)
    for _ in range(refinements):
        refined = dict(normal)
        for c in label:
            touch = lambda c: [o for o in label if o != c and label[o] == label[c] and max(abs(a - b) for a, b in zip(c, o)) <= 1]  # noqa: B023, E731
            ways = [c, *touch(c), *(o for b in touch(c) for o in touch(b))]
            if len(ways) >= 3:
                values, vectors = spectrum(np.array([pos[w] for w in ways]))
                if values[1] - values[2] > 1e-9 * values.sum():
                    refined[c] = vectors[2] if vectors[2] @ pos[c] <= 0 else -vectors[2]
        normal = refined
        centre = means(label, pos, col, normal)
        again = {}
        for x, (mid, _, _) in centre.items():
            again[min((c for c in label if label[c] == x), key=lambda c: (((pos[c] - mid) ** 2).sum(), p["pid"][last[c]]))] = x  # noqa: B023
        label, _ = grow(cells, pos, col, normal, again, rounds, weights)
    return [label.get(c, 0) for c in voxel]


def test_supervoxels(spark, scenes):
    got = found(spark, "supervoxels")
    for s, p in scenes.items():
        assert [got[s][i] for i in p["pid"].tolist()] == brute_supervoxels(p, 0.05, 0.2, 0.2, 0.2, 0.6, 1)


@pytest.mark.parametrize("refinements", [0, 2])
def test_supervoxels_on_a_sheet(spark, refinements):
    """A wavy sheet, on which each voxel touches many, so that refined normals are unique."""
    rng = np.random.default_rng(12)
    n = 700
    xy = rng.random((n, 2))
    xyz = np.column_stack([xy, 0.3 * np.sin(4 * xy[:, 0]) + 0.03 * rng.normal(size=n)]) + [0, 0, 2]
    normal = rng.normal(size=(n, 3)) + [0, 0, 2]
    p = {"pid": np.arange(n), "xyz": xyz, "rgb": np.floor(255 * rng.random((n, 3))), "n": normal / np.linalg.norm(normal, axis=1, keepdims=True)}
    rows = [("s", i, *map(float, (*p["xyz"][i], *p["rgb"][i], *p["n"][i]))) for i in range(n)]
    frame = spark.createDataFrame(rows, "scene_id string, pid long, " + ", ".join(f"{c} double" for c in NAMES[1:10]))
    got = {r.pid: r.label for r in supervoxels.supervoxels(frame, 0.07, 0.25, 0.2, 0.4, 1.0, refinements).collect()}
    want = brute_supervoxels(p, 0.07, 0.25, 0.2, 0.4, 1.0, refinements)
    assert len(set(want)) > 10
    assert [got[i] for i in range(n)] == want


def eight(values, order):
    """Shape features of eigenvalues over their length."""
    size = np.linalg.norm(values)
    if not size:
        return np.zeros(8)
    a, b, c = values / size
    known = {
        "linearity": (a - b) / a, "planarity": (b - c) / a, "scattering": c / a, "curvature": c / (a + b + c), "anisotropy": (a - c) / a if b > 0 else 0.0,
        "entropy": -(a * math.log(a) + b * math.log(b) + c * math.log(c)) if a * b * c > 0 else 0.0, "eigensum": a + b + c, "omnivariance": (a * b * c) ** (1 / 3),
    }
    return np.array([known[x] for x in order])


def cut_graph(members, centre, adjacent, normalised, order, eigen_from, weight, convexity):
    """Cluster of each node: cuts of all neighbourhoods, mutual members, the rest to the most similar neighbour, components."""
    n = len(members)
    mean = np.array([m.mean(0) for m in members])
    eigen, normal = np.zeros((n, 8)), np.zeros((n, 3))
    for i, m in enumerate(members):
        if len(m) >= 4:
            values, vectors = spectrum(m, normalised)
            eigen[i], normal[i] = eight(values, order), vectors[2] * (-1 if vectors[2][2] < 0 else 1)

    def weigh(i, j):
        d = voxel_graph.pair_distances(mean[i], mean[j], normal[i], normal[j], eigen[i], eigen[j], eigen_from)
        return voxel_graph.similarity(d, (0.2,) * 5, weight, convexity)

    linked = set()
    for u in range(n):
        own = np.array([u, *sorted(adjacent[u])])
        m = len(own)
        i, j = np.divmod(np.arange(m * m), m)
        w = weigh(own[i], own[j])
        w[i == j] = 0
        linked |= {(u, int(v)) for v in own[voxel_graph.cut(w.reshape(m, m), 0.3)] if v != u}
    edges = {(u, v) for u, v in linked if (v, u) in linked}
    joined = {u for u, _ in edges}
    for u in range(n):
        if u not in joined and adjacent[u]:
            some = [v for v in sorted(adjacent[u]) if v in joined]
            if some:
                edges.add((u, some[int(np.argmax(weigh(np.full(len(some), u), np.array(some))))]))
    label = list(range(n))
    for _ in range(n):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_voxel_graph(spark, scenes):
    got = found(spark, "voxel_graph")
    for s, p in scenes.items():
        voxel = grid(p["xyz"], catalog.CELL)
        cells = sorted(set(voxel))
        members = [p["xyz"][[i for i, c in enumerate(voxel) if c == cell]] for cell in cells]
        centre = p["xyz"].min(0) + (np.array(cells) + 0.5) * catalog.CELL
        d = distances(centre)
        adjacent = [[j for j in range(len(cells)) if j != i and d[i, j] <= 0.3] for i in range(len(cells))]
        label = cut_graph(members, centre, adjacent, False, voxel_graph.VOXEL_FEATURES, 4, 2.0, True)
        same_parts(got[s], p["pid"], [label[cells.index(c)] for c in voxel])


def test_supervoxel_graph(spark, scenes):
    got = found(spark, "supervoxel_graph")
    for s, p in scenes.items():
        own = brute_supervoxels(p, 0.05, 0.2, 0.2, 0.2, 0.6, 0)
        names = sorted(set(own) - {0})
        members = [p["xyz"][[i for i, x in enumerate(own) if x == name]] for name in names]
        centre = np.array([m.mean(0) for m in members])
        d = distances(centre)
        adjacent = [[j for j in range(len(names)) if j != i and d[i, j] <= 0.3] for i in range(len(names))]
        label = cut_graph(members, centre, adjacent, True, voxel_graph.SUPERVOXEL_FEATURES, 0, 1.0, False)
        same_parts(got[s], p["pid"], [label[names.index(x)] if x else -1 for x in own])


def test_pairwise_linkage(spark, scenes):
    got = found(spark, "pairwise_linkage")
    for s, p in scenes.items():
        xyz, n = p["xyz"], len(p["pid"])
        near = nearest(xyz, 10)
        shape = [spectrum(xyz[[i, *near[i]]]) for i in range(n)]
        flat = np.array([v[2] / (v.sum() + 1e-12) for v, _ in shape])
        normal = np.array([v[2] for _, v in shape])
        normal *= np.where(np.take_along_axis(normal, np.abs(normal).argmax(1)[:, None], 1) < 0, -1, 1)
        friends = [{int(j) for j in near[i] if i in near[j]} for i in range(n)]
        parent = {}
        for i in range(n):
            some = [(math.acos(min(1.0, abs(normal[i] @ normal[j]))), j) for j in friends[i] if flat[j] < flat[i]]
            if some:
                parent[i] = min(some)[1]
        centres = deque(i for i in range(n) if i not in parent and flat[i] < flat.mean() + flat.std())
        clusters = []
        while centres:
            top = centres.popleft()
            own = [top]
            for at in own:
                for child in (i for i in range(n) if parent.get(i) == at):
                    (own if normal[top] @ normal[child] > math.cos(math.radians(30)) else centres).append(child)
            if len(own) >= 3:
                clusters.append(own)
        if not clusters:
            assert set(got[s].values()) == {0}
            continue
        fits = [linkage.robust_plane(xyz[sorted(own)], k) for k, own in enumerate(clusters)]
        inside = [np.array(sorted(own))[fit[3]] for own, fit in zip(clusters, fits)]
        owner = {int(i): k for k, own in enumerate(inside) for i in own}
        shared = {}
        for i, a in owner.items():
            for j in friends[i]:
                if j in owner and owner[j] != a:
                    shared.setdefault((a, owner[j]), set()).add(j)
        order = sorted(range(len(clusters)), key=lambda k: (-len(inside[k]), k))
        least = np.array([fits[k][2] for k in order])
        middle = np.sort(least)[len(least) // 2]
        spread = 1.4826 * np.sort(np.abs(least - middle))[len(least) // 2]
        share = np.clip((least - middle) / (2.5 * spread), 0, 1) if spread > 0 else (least > middle) * 1.0
        limit = dict(zip(order, math.radians(10) + share * (math.radians(90) - math.radians(10))))
        patch = {}
        for top in order:
            if top in patch:
                continue
            patch[top], queue = top, deque([top])
            while queue:
                at = queue.popleft()
                for other in order:
                    if other not in patch and len(shared.get((at, other), ())) >= 3 and math.acos(min(1.0, abs(fits[top][1] @ fits[other][1]))) < min(limit[at], limit[top]):
                        patch[other] = top
                        queue.append(other)
        label = [-1] * n
        for k, own in enumerate(clusters):
            for i in own:
                label[i] = patch[k]
        same_parts(got[s], p["pid"], label)


def test_cut_pursuit(spark, scenes):
    """The query's graph and features, made anew, and the partition of them; each part is connected and no merge of two touching parts lowers the energy."""
    got = found(spark, "cut_pursuit")
    for s, p in scenes.items():
        near = nearest(p["xyz"], 10)
        pairs = {(i, int(j)) for i, own in enumerate(near) for j in own[:5]}
        pairs = sorted((i, j) for i, j in pairs if i < j or (j, i) not in pairs)
        u, v = np.array(pairs).T
        length = np.linalg.norm(p["xyz"][u] - p["xyz"][v], axis=1)
        weight = 1 / (1 + length / length.mean())
        x = []
        for i, own in enumerate(near):
            values, vectors = spectrum(p["xyz"][[i, *own]])
            a, b, c = np.sqrt(values)
            up = (values[:, None] * np.abs(vectors)).sum(0)
            x.append([(a - b) / a, (b - c) / a, c / a, 2 * up[2] / np.linalg.norm(up), *p["rgb"][i]])
        run = cut_pursuit.Pursuit(np.array(x), np.ones(len(x)), u, v, weight, 0.07, cut_pursuit.SPEEDS[2], 1, 0, 1.0, zlib.crc32(s.encode()))
        want = run.run()
        same_parts(got[s], p["pid"], want.tolist())
        assert run.energy(want) <= run.energy(np.zeros(len(x), int))
