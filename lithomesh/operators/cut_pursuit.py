"""Piecewise-constant approximation of features on a graph by cut pursuit.

Components are split in two by alternating two centres and a minimum cut, cut
edges become active, and components are merged where that lowers the energy
``sum fidelity + strength * weight of active edges``. Each step needs the whole
graph of a scene and depends on the one before, so a scene is one task; scenes
run side by side. Random choices are seeded by scene.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithomesh.plans.session import prepare_workers

SCENE = "scene_id"


@dataclass(frozen=True)
class Speed:
    """How hard a run tries."""

    flow_steps: int
    kmeans_rounds: int
    kmeans_restarts: int
    rounds: int
    merges: bool
    stop: float


#: The presets 0 to 4.
SPEEDS = (Speed(4, 8, 5, 20, True, 0.001), Speed(3, 5, 2, 10, True, 0.01), Speed(2, 5, 1, 5, True, 0.05), Speed(1, 3, 1, 5, False, 0.1), Speed(3, 5, 10, 15, True, 0.05))


class Squares:
    """Half the weighted squared distance from a component's mean."""

    saturates = True

    def __init__(self, x: np.ndarray, w: np.ndarray, smoothing: float = 0.0):
        self.x, self.w = x, w

    def value(self, nodes: np.ndarray) -> np.ndarray:
        total = self.w[nodes].sum()
        return self.w[nodes] @ self.x[nodes] / total if total > 0 else self.x[nodes].mean(0)

    def cost(self, nodes: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 0.5 * self.w[nodes] * ((self.x[nodes] - value) ** 2).sum(1)

    def centres(self, nodes: np.ndarray, rng, speed: Speed) -> np.ndarray:
        """Two centres by k-means with spread-out seeds; the best of the restarts."""
        x, w = self.x[nodes], self.w[nodes]
        best, least = None, np.inf
        for _ in range(speed.kmeans_restarts):
            first = x[rng.integers(len(x))]
            far = w * ((x - first) ** 2).sum(1)
            if far.sum() <= 0:
                return np.stack([first, first])
            pair = np.stack([first, x[rng.choice(len(x), p=far / far.sum())]])
            for _ in range(speed.kmeans_rounds):
                d = ((x[:, None, :] - pair[None]) ** 2).sum(2)
                side = d.argmin(1)
                for k in (0, 1):
                    mine = side == k
                    if w[mine].sum() > 0:
                        pair[k] = w[mine] @ x[mine] / w[mine].sum()
            energy = (w * ((x[:, None, :] - pair[None]) ** 2).sum(2).min(1)).sum()
            if energy < least:
                best, least = pair, energy
        return best


class DecayingSquares(Squares):
    """Squares whose pull fades with every split round; components are never taken for settled."""

    saturates = False


class Linear(Squares):
    """Weighted cost of a label, features being costs of labels; a component's value is its cheapest label."""

    def value(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(self.x.shape[1])
        out[(self.w[nodes] @ self.x[nodes]).argmin()] = 1.0
        return out

    def cost(self, nodes: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.w[nodes] * (self.x[nodes] @ value)

    def centres(self, nodes: np.ndarray, rng, speed: Speed) -> np.ndarray:
        """The two labels that are cheapest for most nodes."""
        votes = np.bincount(self.x[nodes].argmin(1), weights=self.w[nodes], minlength=self.x.shape[1])
        return np.eye(self.x.shape[1])[np.argsort(-votes, kind="stable")[:2]]


class Divergence(Squares):
    """Weighted Kullback-Leibler divergence of smoothed distributions from a component's mean."""

    def __init__(self, x: np.ndarray, w: np.ndarray, smoothing: float = 0.05):
        super().__init__(x, w)
        self.smoothing = smoothing

    def _smooth(self, x: np.ndarray) -> np.ndarray:
        return self.smoothing / self.x.shape[1] + (1 - self.smoothing) * x

    def cost(self, nodes: np.ndarray, value: np.ndarray) -> np.ndarray:
        p, q = self._smooth(self.x[nodes]), self._smooth(value)
        return self.w[nodes] * (p * (np.log(p) - np.log(q))).sum(1)


def fidelity(kind: float):
    """0 linear, 1 squares, between them and -1 divergence with that smoothing, 2 squares with decay, others squares."""
    if kind == 0:
        return Linear, 0.0
    if 0 < kind < 1:
        return Divergence, kind
    if kind == -1:
        return Divergence, 0.05
    return (DecayingSquares if kind == 2 else Squares), 0.0


def minimum_cut(pull: np.ndarray, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Side (True: second) of each node that minimises the pulls paid and the undirected weights cut.

    A node with positive pull pays it on the second side, one with negative pull on
    the first. Blocking flows on levels from the source (Dinic), with plain lists.
    """
    n = len(pull)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, p in enumerate(pull.tolist()):
        if p > 0:
            arc(s, i, p, 0.0)
        elif p < 0:
            arc(i, t, -p, 0.0)
    for a, b, w in zip(u.tolist(), v.tolist(), weight.tolist()):
        if w > 0:
            arc(a, b, w, w)
    tiny = 1e-12 * (1 + float(np.abs(pull).sum()))
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([x < 0 for x in level[:n]])
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def _components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component number of each node, in order of first nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        new = new[label]
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1]


class Pursuit:
    """One scene's nodes (features, weights) and undirected edges."""

    def __init__(self, x, w, u, v, weight, strength: float, speed: Speed, kind: float = 1, cutoff: int = 0, decay: float = 1.0, seed: int = 1):
        model, smoothing = fidelity(kind)
        self.fit = model(np.asarray(x, float), np.asarray(w, float), smoothing)
        self.n, self.u, self.v = len(x), np.asarray(u, int), np.asarray(v, int)
        # each edge stands for both directions
        self.weight = np.asarray(weight, float) * strength
        self.speed, self.cutoff, self.decay = speed, cutoff, decay
        self.rng = np.random.default_rng(seed)
        self.active = np.zeros(len(self.u), bool)

    def _groups(self, label: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(label, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if self.n else []

    def energy(self, label: np.ndarray) -> float:
        total = sum(float(self.fit.cost(g, self.fit.value(g)).sum()) for g in self._groups(label))
        return total + float(self.weight[label[self.u] != label[self.v]].sum())

    def _split(self, nodes: np.ndarray, local: np.ndarray, edges: np.ndarray, scale: float) -> np.ndarray:
        pair = self.fit.centres(nodes, self.rng, self.speed)
        side = np.zeros(len(nodes), bool)
        for step in range(self.speed.flow_steps):
            pull = scale * (self.fit.cost(nodes, pair[1]) - self.fit.cost(nodes, pair[0]))
            side = minimum_cut(pull, local[self.u[edges]], local[self.v[edges]], self.weight[edges])
            if side.all() or not side.any() or step == self.speed.flow_steps - 1:
                break
            pair = np.stack([self.fit.value(nodes[~side]), self.fit.value(nodes[side])])
        return side

    def _merge(self, label: np.ndarray, forced: bool) -> tuple[np.ndarray, bool]:
        """Merge neighbouring components by falling gain, each once; ``forced`` merges small ones whatever the gain."""
        groups = self._groups(label)
        sizes = np.array([len(g) for g in groups])
        values = [self.fit.value(g) for g in groups]
        own = [float(self.fit.cost(g, x).sum()) for g, x in zip(groups, values)]
        a, b = label[self.u], label[self.v]
        apart = a != b
        pairs, at = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)])[apart], axis=0, return_inverse=True)
        border = np.bincount(at.ravel(), weights=self.weight[apart], minlength=len(pairs))
        gains = []
        for (p, q), cut in zip(pairs.tolist(), border.tolist()):
            if forced and min(sizes[p], sizes[q]) >= self.cutoff:
                continue
            both = np.concatenate([groups[p], groups[q]])
            gain = own[p] + own[q] - float(self.fit.cost(both, self.fit.value(both)).sum()) + cut
            if gain > 0 or forced:
                gains.append((-gain, p, q))
        done: set[int] = set()
        for _, p, q in sorted(gains):
            if p not in done and q not in done:
                label = np.where(label == q, p, label)
                done |= {p, q}
        return np.unique(label, return_inverse=True)[1], bool(done)

    def run(self) -> np.ndarray:
        """Component of each node."""
        label = _components(self.n, self.u, self.v)
        settled: set[int] = set()  # by first node
        energy = start = self.energy(label)
        local = np.zeros(self.n, int)
        scale = 1.0
        for _ in range(self.speed.rounds):
            cut_any = False
            for nodes in self._groups(label):
                if len(nodes) < 2 or int(nodes[0]) in settled:
                    continue
                local[nodes] = np.arange(len(nodes))
                inside = np.flatnonzero((label[self.u] == label[nodes[0]]) & (label[self.v] == label[nodes[0]]))
                side = self._split(nodes, local, inside, scale)
                if side.all() or not side.any():
                    if self.fit.saturates:
                        settled.add(int(nodes[0]))
                    continue
                cut = side[local[self.u[inside]]] != side[local[self.v[inside]]]
                self.active[inside[cut]] = True
                cut_any = True
            scale *= self.decay
            if not cut_any:
                break
            kept = ~self.active
            label = _components(self.n, self.u[kept], self.v[kept])
            if self.speed.merges:
                merging = True
                while merging:
                    label, merging = self._merge(label, False)
                self.active = label[self.u] != label[self.v]
            now = self.energy(label)
            if energy - now < self.speed.stop * max(start, 1e-300):
                energy = now
                break
            energy = now
            settled &= {int(g[0]) for g in self._groups(label)}
        for _ in range(51 if self.cutoff else 0):
            label, merged = self._merge(label, True)
            if not merged:
                break
        return label


def _scene(strength: float, speed: Speed, kind: float, cutoff: int, decay: float):
    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):  # edges of a scene without nodes
            return pd.DataFrame({"scene_id": pd.Series(dtype=str), "pid": pd.Series(dtype="int64"), "label": pd.Series(dtype="int64")})
        nodes = nodes.sort_values("pid")
        pid = nodes["pid"].to_numpy()
        x = np.vstack(nodes["features"].to_numpy())
        edges = edges.sort_values(["src", "dst"])
        u, v = np.searchsorted(pid, edges["src"].to_numpy()), np.searchsorted(pid, edges["dst"].to_numpy())
        scene = str(nodes["scene_id"].iloc[0])
        found = Pursuit(x, nodes["weight"].to_numpy(), u, v, edges["weight"].to_numpy(), strength, speed, kind, cutoff, decay, zlib.crc32(scene.encode())).run()
        return pd.DataFrame({"scene_id": scene, "pid": pid, "label": found.astype(np.int64)})

    return run


def cut_pursuit(nodes: DataFrame, edges: DataFrame, strength: float = 0.07, cutoff: int = 0, fidelity_kind: float = 1, weight_decay: float = 1.0, speed: int = 4) -> DataFrame:
    """(scene_id, pid, label) from nodes (scene_id, pid, features, and perhaps weight) and edges (scene_id, src, dst, weight), each edge once."""
    prepare_workers(nodes.sparkSession)
    weight = F.col("weight").cast("double") if "weight" in nodes.columns else F.lit(1.0)
    own = nodes.select(SCENE, F.col("pid").cast("long").alias("pid"), F.col("features").cast("array<double>").alias("features"), weight.alias("weight"))
    graph = edges.select(SCENE, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return own.groupBy(SCENE).cogroup(graph.groupBy(SCENE)).applyInPandas(_scene(strength, SPEEDS[speed], fidelity_kind, cutoff, weight_decay), "scene_id string, pid long, label long")


def partition_points(points: DataFrame, k_adjacency: int = 15, k_shape: int = 45, strength: float = 0.07, weight_strength: float = 1.0, cutoff: int = 0, speed: int = 2, neighbours: DataFrame | None = None) -> DataFrame:
    """(scene_id, pid, label): nearest-neighbour graph, shape features and colour, edge weights, then cut pursuit.

    ``neighbours`` (scene_id, src, dst, dist, rank) replace the search, as for a mesh.
    """
    from lithomesh.operators.edges import edge_weights, without_reverse
    from lithomesh.operators.features import graph_features, point_features
    from lithomesh.operators.neighbours import knn
    from lithomesh.plans.storage import materialise

    near = materialise(neighbours if neighbours is not None else knn(points, points, max(k_adjacency, k_shape)), "pursuit-neighbours")
    graph = edge_weights(without_reverse(near.filter(F.col("rank") <= k_adjacency).select(SCENE, "src", "dst", "dist")), weight_strength)
    shape = point_features(points, near.filter(F.col("rank") <= k_shape)).fillna(0.0)
    return cut_pursuit(graph_features(shape, points), graph, strength, cutoff, speed=speed)
