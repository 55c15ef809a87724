"""Most similar vectors for every vector: a hierarchical k-means tree with best-bin-first traversal.

1. Vectors are scaled to unit length and equal ones folded into classes, so copies never meet each other as pairs.
2. A tree is fitted on a bounded, hash-ordered sample (``sample_size``): nodes are split by k-means until a leaf stands
   for at most ``LEAF`` vectors, so dense regions get more leaves. It goes to every worker; ``MAX_LEAVES`` bounds it.
3. Every vector is put into its leaf. Leaves in tree order are packed into shards of at most ``SHARD`` vectors; a
   leaf larger than that is spread over several shards, all of which a visitor visits. Shards are files in the shared
   folder.
4. Calibration: the true neighbours of ``PROBES`` sampled vectors are found by comparing them with all vectors; the
   leaf visits are the least that reach ``RECALL`` of them.
5. Every vector walks the tree best bin first. Vectors of a shard walk together: which leaves a priority queue would
   give them is read off the nearness of the branches on the way (``Tree.reach``), without keeping a queue for each.
6. A task takes up to ``VISITORS`` vectors of one shard, reads the shards their leaves are in and compares each leaf
   with its visitors, so neither vectors nor partial results are shuffled.

Defined results
* null, empty, all-zero, non-finite and differently sized embeddings (another size than the commonest) have no
  neighbours; null ids are left out;
* direction counts, length does not; repeated rows count once; an id with several embeddings has each looked up and
  keeps its best k;
* copies are neighbours with similarity 1; equal similarities are ordered by the smaller id, and which of several
  equally similar vectors that are no copies takes the last place is left open; a vector is not its own neighbour;
* fewer than k other vectors give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.operators.skew import hot_of, salted_join
from passagemill.session import cut_lineage, release, scratch_path

K, BRANCHES, LEAF, SHARD = 10, 8, 384, 16_384
#: The tree's leaves, and the vectors and bytes of the sample it is fitted on, at most.
MAX_LEAVES, MAX_SAMPLE, SAMPLE_BYTES = 65_536, 1_000_000, 128 << 20
#: Vectors that walk side by side, and those that read off their leaves together.
SLICE, TOGETHER = 2048, 96
PROBES, RECALL = 256, 0.97
#: Visitors of one shard looked up in one task, at most.
VISITORS = 16_384


def sample_size(n: int, dim: int) -> int:
    """Vectors the tree is fitted on: all up to 20,000, then a tenth, at most MAX_SAMPLE and SAMPLE_BYTES of them."""
    return min(n, max(20_000, min(n // 10, MAX_SAMPLE)), max(1, SAMPLE_BYTES // (4 * dim)))


class Room:
    """Memory for the large arrays of a step, used again in the next: fresh pages cost more than what is done with them."""

    held: Room

    def __init__(self) -> None:
        self.flat: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: type = np.float32) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.flat or self.flat[name].size < size:
            self.flat[name] = np.empty(size + size // 2, dtype=dtype)
        return self.flat[name][:size].reshape(shape)


Room.held = Room()


class Tree:
    """Hierarchical k-means tree over unit vectors. Node 0 is the root; leaves are numbered in tree order."""

    def __init__(self, x: np.ndarray, stands_for: float, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        self.leaf_of: list[int] = [-1]
        centres: list[np.ndarray] = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1], dtype=np.float32)]
        self.leaves = 0
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            parts = self._split(x, rows, branches, rng) if len(rows) * stands_for > leaf and len(rows) > branches and self.leaves + len(stack) < MAX_LEAVES else []
            if len(parts) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in parts:
                self.children[node].append(len(self.children))
                self.children.append([])
                self.leaf_of.append(-1)
                centres.append(centre)
            stack += reversed([(c, own) for c, (_, own) in zip(self.children[node], parts)])
        self.centres = np.array(centres, dtype=np.float32)
        self.pack()

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
        y = x[rows]
        c = y[rng.choice(len(y), k, replace=False)]
        for _ in range(rounds):
            of = (y @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            sums = (of == np.arange(k)[:, None]).astype(np.float32) @ y
            n = np.bincount(of, minlength=k)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        of = (y @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        return [(c[j], rows[of == j]) for j in range(k) if (of == j).any()]

    def pack(self) -> None:
        """Children and centres as arrays, so that a step of many walks is one gather and one product."""
        width = max(1, max(map(len, self.children)))
        self.kids = np.full((len(self.children), width), -1, dtype=np.int32)
        for node, own in enumerate(self.children):
            self.kids[node, : len(own)] = own
        self.leaf = np.array(self.leaf_of, dtype=np.int32)
        self.half = 0.5 * (self.centres * self.centres).sum(axis=1)
        self.fan = (self.kids >= 0).sum(axis=1)
        self.below = (self.leaf >= 0).astype(np.int64)
        for node in reversed(range(len(self.children))):  # children come after their parents
            if self.children[node]:
                self.below[node] = self.below[self.children[node]].sum()

    def _near(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Nearness of each vector to the children of its own node only; larger is nearer, -inf where there is no child.

        Up to a constant of the vector it is half the negative squared distance, so nodes of all depths compare.
        """
        kids = self.kids[nodes]
        near = np.einsum("rkd,rd->rk", self.centres[kids], x) - self.half[kids]
        near[kids < 0] = -np.inf
        return near

    def walk(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` leaves of every vector (rows; -1 where there are no more), best bin first.

        Each vector goes down to a leaf by the nearest child, puts the branches it leaves behind into its priority queue,
        and goes on from the best of them. The vectors walk side by side; distances are computed to the children of the
        nodes they pass and to no others, so the work per vector grows with the visits and the depth of the tree.
        """
        n, width = len(x), self.kids.shape[1]
        out = np.full((n, visits), -1, dtype=np.int32)
        queue_near, queue_node = np.full((n, 1), -np.inf, dtype=np.float32), np.zeros((n, 1), dtype=np.int32)
        node, alive, rows = np.zeros(n, dtype=np.int32), np.ones(n, dtype=bool), np.arange(n)
        for v in range(visits):
            if v:
                best = queue_near.argmax(axis=1)
                node, alive = queue_node[rows, best].copy(), queue_near[rows, best] > -np.inf
                queue_near[rows, best] = -np.inf
                if not alive.any():
                    break
            new_near, new_node = [queue_near], [queue_node]
            while True:
                down = np.flatnonzero(alive & (self.kids[node, 0] >= 0))
                if not len(down):
                    break
                at = node[down]
                near = self._near(x[down], at)
                best = near.argmax(axis=1)
                node[down] = self.kids[at, best]
                near[np.arange(len(down)), best] = -np.inf
                left_near, left_node = np.full((n, width), -np.inf, dtype=np.float32), np.zeros((n, width), dtype=np.int32)
                left_near[down], left_node[down] = near, self.kids[at]
                new_near.append(left_near)
                new_node.append(left_node)
            out[:, v] = np.where(alive, self.leaf[node], -1)
            queue_near, queue_node = np.concatenate(new_near, axis=1), np.concatenate(new_node, axis=1)
            keep = visits - v - 1  # no more branches than leaves still to visit can be taken from the queue
            if keep < queue_near.shape[1] and keep:
                top = np.argpartition(-queue_near, keep - 1, axis=1)[:, :keep]
                queue_near, queue_node = np.take_along_axis(queue_near, top, axis=1), np.take_along_axis(queue_node, top, axis=1)
        return out

    def reach(self, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, and the key of each of them (rows) for every vector (columns): the ``visits`` largest keys of a vector are its walk.

        A walk enters a branch when its nearness is the best in the queue, and from each branch it enters goes down to one
        leaf. A branch is thus entered before another if the worst nearness on the way to it, of the branches entered there,
        is better than that of the other: that worst is the key of its leaf. Leaves with one key, whose way is through the
        same worst branch, are reached together. Only branches that hold one of the ``visits`` best leaves of some of the
        vectors are opened, beyond those first ones that find a bound: vectors near each other should be given together.
        """
        n, room, turn = len(x), Room.held, 0
        nodes, keys = np.zeros(1, dtype=np.int64), np.full((1, n), np.inf, dtype=np.float32)
        across, bound, rounds = np.ascontiguousarray(x.T), None, 0
        while True:
            inner = self.fan[nodes] > 0
            opened = nodes[:0]
            if bound is None and rounds < 12:
                order = np.argsort(-keys.mean(axis=1), kind="stable")
                first = order[: np.searchsorted(np.cumsum(self.below[nodes[order]]), 1.25 * visits) + 1]
                opened = first[inner[first]]
                rounds += 1
            if not len(opened):
                bound = _nth(keys, visits, room)
                kept = np.flatnonzero(np.greater_equal(keys, bound, out=room("kept", keys.shape, bool)).any(axis=1))
                turn = 1 - turn
                nodes, keys, inner = nodes[kept], np.take(keys, kept, axis=0, out=room(f"keys{turn}", (len(kept), n)), mode="clip"), inner[kept]
                opened = np.flatnonzero(inner)
                if not len(opened):
                    return self.leaf[nodes], keys
            kids = self.kids[nodes[opened]]
            flat, shape = kids.ravel(), (*kids.shape, n)
            centres = np.take(self.centres, flat, axis=0, out=room("centres", (len(flat), x.shape[1])), mode="clip")
            near = np.matmul(centres, across, out=room("near", (len(flat), n)))
            near -= self.half[flat][:, None]
            near[flat < 0] = -np.inf
            near = near.reshape(shape)
            above = np.take(keys, opened, axis=0, out=room("above", (len(opened), n)), mode="clip")[:, None, :]
            most = np.max(near, axis=1, keepdims=True, out=room("most", (len(opened), 1, n)))
            best = np.equal(near, most, out=room("best", shape, bool))
            np.minimum(near, above, out=near)
            np.copyto(near, above, where=best)
            rest = np.ones(len(nodes), dtype=bool)
            rest[opened] = False
            rest, real, turn = np.flatnonzero(rest), np.flatnonzero(flat >= 0), 1 - turn
            nodes, old = np.concatenate([nodes[rest], flat[real]]), keys
            keys = room(f"keys{turn}", (len(nodes), n))
            np.take(old, rest, axis=0, out=keys[: len(rest)], mode="clip")
            np.take(near.reshape(-1, n), real, axis=0, out=keys[len(rest) :], mode="clip")

    def visited(self, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, and for every vector which of them its walk has reached when it has come to ``visits`` of them."""
        leaves, keys = self.reach(x, visits)
        return leaves, (keys >= _nth(keys, visits, Room.held)).T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector: the first one of its walk, ``SLICE`` vectors at a time."""
        return np.concatenate([self.walk(x[a : a + SLICE], 1)[:, 0] for a in range(0, len(x), SLICE)]) if len(x) else np.zeros(0, dtype=np.int32)


def _nth(keys: np.ndarray, n: int, room: Room) -> np.ndarray:
    """The n-th largest of every column, or less than all where there are no more than n."""
    if len(keys) <= n:
        return np.full(keys.shape[1], -np.inf, dtype=keys.dtype)
    rows = room("rows", keys.shape[::-1])
    rows[:] = keys.T
    rows.partition(len(keys) - n, axis=1)
    return rows[:, len(keys) - n].copy()


def _unit(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    """Unit vectors (float32) of a fixed-width binary column."""
    return _vectors(batch.column(column), dim)


def _vectors(values: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        return np.concatenate([np.zeros((0, dim), dtype=np.float32), *(_vectors(c, dim) for c in values.chunks)])
    if not len(values):
        return np.zeros((0, dim), dtype=np.float32)
    values = values.cast(pa.large_binary())
    start = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset]
    return np.frombuffer(values.buffers()[2], dtype=np.float32, count=len(values) * dim, offset=int(start)).reshape(-1, dim)


def unit_vectors(chunks: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: each usable vector scaled to unit length, as bytes of float32."""
    schema = pa.schema([("id", pa.string()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1)
            if isinstance(values, pa.ChunkedArray):
                values = values.combine_chunks()
            flat = np.asarray(values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, dim)
            norm = np.sqrt((flat * flat).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = (flat[ok] / norm[ok][:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, good in zip(ids, ok) if good], pa.string()), pa.array([v.tobytes() for v in unit], pa.binary())], schema=schema)

    usable = chunks.where(F.col(id_col).isNotNull() & (F.size(F.col(vec_col)) == dim) & ~F.exists(F.col(vec_col), lambda v: v.isNull()))
    return usable.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, "id string, vec binary").distinct()


class Index:
    """The tree, the number of leaves to visit, which shards hold a leaf, and the folder the shards are in."""

    def __init__(self, tree: Tree, dim: int, visits: int, shards: list[list[int]], recall: float) -> None:
        self.tree, self.dim, self.visits, self.shards, self.recall = tree, dim, visits, shards, recall
        self.path, self.parts = "", []


class Shard:
    """One shard: vectors in the order of their leaves, and the ids of the class of each."""

    def __init__(self, index: Index, number: int) -> None:
        where, path = fs.FileSystem.from_uri(index.path)
        files = sorted(f.path for f in where.get_file_info(fs.FileSelector(f"{path}/shard={number}")) if f.path.endswith(".parquet"))
        table = pa.concat_tables([pq.ParquetFile(where.open_input_file(f)).read() for f in files])
        leaf = table.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        if len(files) > 1:
            table, leaf = table.take(order), leaf[order]
        self.leaf, self.vectors, self.copies = leaf, _vectors(table.column("vec"), index.dim), table.column("n").to_numpy()
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        self.ids, self.at = ids.flatten(), ids.offsets.to_numpy() - ids.offsets[0].as_py()


def pack(sizes: list[int], shard: int = SHARD) -> list[list[int]]:
    """The shards of every leaf: consecutive leaves share one while they fit, a larger leaf has several of its own."""
    out: list[list[int]] = []
    at, room = 0, shard
    for n in sizes:
        if n > shard:
            if room < shard:
                at += 1
            parts = ceil(n / shard)
            out.append(list(range(at, at + parts)))
            at, room = at + parts, shard
        else:
            if n > room:
                at, room = at + 1, shard
            out.append([at])
            room -= n
    return out


def true_neighbours(vectors: DataFrame, probes: list[tuple[str, bytes]], dim: int, k: int) -> list[tuple[str, str, int]]:
    """(probe, neighbour, leaf of the neighbour): the exact k best of a bounded number of probes among all vectors."""
    q = np.frombuffer(b"".join(v for _, v in probes), dtype=np.float32).reshape(-1, dim)
    names = [i for i, _ in probes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, str, int]]] = [[] for _ in names]
        for batch in batches:
            ids, leaves = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            if not ids:
                continue
            s = q @ _unit(batch, 1, dim).T
            for r in range(len(names)):
                top = np.argpartition(-s[r], k)[: k + 1] if s.shape[1] > k + 1 else range(s.shape[1])
                best[r] = heapq.nlargest(k, best[r] + [(float(s[r, j]), ids[j], leaves[j]) for j in top if ids[j] != names[r]])
        rows = [(names[r], i, leaf, s) for r, own in enumerate(best) for s, i, leaf in own]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], names=["probe", "id", "leaf", "sim"])

    found = vectors.select("id", "vec", "leaf").mapInArrow(scan, "probe string, id string, leaf int, sim double")
    w = Window.partitionBy("probe").orderBy(F.desc("sim"), "id")
    return [(r[0], r[1], r[2]) for r in found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("probe", "id", "leaf").collect()]


def build(vectors: DataFrame, dim: int, k: int = K, recall: float = RECALL) -> Index | None:
    """The calibrated index of the classes of equal vectors (id, vec, n, ids), with its shards written."""
    n = vectors.count()
    if n < 2:
        return None
    size, mark = sample_size(n, dim), F.xxhash64("id", F.lit(11))
    # the sample are the least hashes, so of a large table only those that can be among them are sorted
    few = size + 10 * ceil(size**0.5) + 100
    low = vectors.where(mark < F.lit(int(2**64 * (few / n)) - 2**63)) if 2 * few < n else vectors
    by_hash = low.select("id", "vec").orderBy(mark, "id").limit(size).toArrow()
    if by_hash.num_rows < size:
        by_hash = vectors.select("id", "vec").orderBy(mark, "id").limit(size).toArrow()
    x = _vectors(by_hash.column("vec"), dim)
    probes = [(r["id"], r["vec"]) for r in by_hash.slice(0, PROBES).to_pylist()]
    del by_hash
    tree = Tree(x, n / len(x))
    x = x[: len(probes)].copy()
    held = vectors.sparkSession.sparkContext.broadcast(tree)
    schema = pa.schema([("id", pa.string()), ("vec", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(pa.string())), ("leaf", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, schema)), pa.array(held.value.assign(_unit(batch, 1, dim)))], schema=schema)

    placed = cut_lineage(vectors.select("id", "vec", "n", "ids").mapInArrow(assign, "id string, vec binary, n long, ids array<string>, leaf int"))
    counts = dict(placed.groupBy("leaf").count().collect())  # one row a leaf, at most MAX_LEAVES
    shards = pack([counts.get(i, 0) for i in range(tree.leaves)])
    truth: dict[str, list[int]] = {}
    for p, _, leaf in true_neighbours(placed, probes, dim, k):
        truth.setdefault(p, []).append(leaf)
    # the place in a probe's walk of the leaf of each of its true neighbours
    places = []
    for a in range(0, len(probes), 32):
        leaves, keys = tree.reach(x[a : a + 32], tree.leaves)
        column = np.empty(tree.leaves, dtype=np.int64)
        column[leaves] = np.arange(len(leaves))
        places += [int((own > own[column[leaf]]).sum()) for (i, _), own in zip(probes[a : a + 32], keys.T) for leaf in truth.get(i, ())]
    ranks = np.sort(places)
    visits = int(ranks[max(0, ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else 1
    index = Index(tree, dim, visits, shards, float((ranks < visits).mean()) if len(ranks) else 1.0)

    several = {leaf: own for leaf, own in enumerate(shards) if len(own) > 1}
    first = np.array([own[0] for own in shards], dtype=np.int32)

    def house(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column(4).to_numpy()
            shard = first[leaf]
            for r in np.flatnonzero(np.isin(leaf, list(several))) if several else ():
                own = several[int(leaf[r])]
                shard[r] = own[hash_of(batch.column(0)[int(r)].as_py()) % len(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shard)], names=["vec", "n", "ids", "leaf", "shard"])

    index.path = scratch_path(vectors.sparkSession, "shards")
    housed = placed.mapInArrow(house, "vec binary, n long, ids array<string>, leaf int, shard int")
    housed.repartition("shard").sortWithinPartitions("shard", "leaf").write.partitionBy("shard").parquet(index.path)
    filled = vectors.sparkSession.read.parquet(index.path).groupBy("shard").count().collect()
    release(placed)
    # enough parts for all cores
    most = min(VISITORS, max(512, ceil(n / (4 * vectors.sparkSession.sparkContext.defaultParallelism))))
    for shard, rows in sorted(filled):
        cuts = [rows * i // ceil(rows / most) for i in range(ceil(rows / most) + 1)]
        index.parts += [(shard, a, b) for a, b in zip(cuts, cuts[1:])]
    return index


def look_up(index: Index, part: int, k: int, least: float) -> tuple[list[Shard], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's vectors: (shards read; row in the first of them, and shard, row and similarity of its up to k best)."""
    number, lo, hi = index.parts[part]
    own = Shard(index, number)
    mine = lo + np.flatnonzero(own.copies[lo:hi] <= k)  # more copies than k have each other
    q, n = own.vectors[mine], len(mine)
    # which vectors visit a leaf, one bit each
    wanted = np.zeros((index.tree.leaves, ceil(n / 8)), dtype=np.uint8)
    for a in range(0, n, TOGETHER):
        leaves, visited = index.tree.visited(q[a : a + TOGETHER], index.visits)
        bits = np.packbits(visited, axis=0)
        wanted[leaves, a // 8 : a // 8 + len(bits)] = bits.T
    visits: dict[int, int] = {}
    for leaf in np.flatnonzero(wanted.any(axis=1)):
        for s in index.shards[leaf]:
            visits[s] = visits.get(s, 0) + int(np.bitwise_count(wanted[leaf]).sum())
    top_s, top_i = np.full((n, 3 * k), -2.0, dtype=np.float32), np.full((n, 3 * k), -1, dtype=np.int64)
    held, worst = np.zeros(n, dtype=np.int64), np.full(n, -2.0, dtype=np.float32)
    read: list[Shard] = []
    room = Room.held
    for s in sorted(visits, key=lambda s: (s != number, -visits[s])):
        home = own if s == number else Shard(index, s)
        for leaf in np.unique(home.leaf):
            at, end = np.searchsorted(home.leaf, [leaf, leaf + 1])
            who = np.flatnonzero(np.unpackbits(wanted[leaf], count=n))
            for a in range(at, end, 2048):
                x = home.vectors[a : min(end, a + 2048)]
                for b in range(0, len(who), 1024):
                    v = who[b : b + 1024]
                    shape = len(v), len(x)
                    sim = np.matmul(np.take(q, v, axis=0, out=room("visitors", (len(v), q.shape[1])), mode="clip"), x.T, out=room("sim", shape))
                    if home is own:
                        self_at = mine[v] - a
                        inside = np.flatnonzero((self_at >= 0) & (self_at < len(x)))
                        sim[inside, self_at[inside]] = -2.0
                    hit = np.flatnonzero(np.greater(sim, worst[v][:, None], out=room("hit", shape, bool)))
                    if not len(hit):
                        continue
                    row, column = hit // len(x), hit % len(x)
                    many = np.bincount(row, minlength=len(v))
                    if many.max() > k:  # the k best of those with more
                        heavy = np.flatnonzero(many > k)
                        cut = np.argpartition(-sim[heavy], k - 1, axis=1)[:, :k]
                        light = many[row] <= k
                        row, column = np.concatenate([row[light], np.repeat(heavy, k)]), np.concatenate([column[light], cut.ravel()])
                        by = np.argsort(row, kind="stable")
                        row, column = row[by], column[by]
                        many = np.minimum(many, k)
                    # behind the k best so far there is room for 2 k more; when k have come they are sorted in
                    place = k + held[v][row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
                    top_s[v[row], place], top_i[v[row], place] = sim[row, column], (len(read) << 32) + a + column
                    held[v] += many
                    full = v[held[v] >= k]
                    if len(full):
                        _sort_in(top_s, top_i, full, k)
                        held[full], worst[full] = 0, top_s[full, :k].min(axis=1)
        home.vectors = home.vectors if home is own else None
        read.append(home)
    _sort_in(top_s, top_i, np.arange(n), k)
    row, place = np.nonzero(top_s[:, :k] >= max(least, -1.5))
    found = top_i[row, place]
    return read, mine[row], found >> 32, found & 0xFFFFFFFF, top_s[row, place]


def _sort_in(top_s: np.ndarray, top_i: np.ndarray, rows: np.ndarray, k: int) -> None:
    """The k best of the rows to their front, and the room behind them free."""
    s, i = top_s[rows], top_i[rows]
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    top_s[rows, :k], top_i[rows, :k] = np.take_along_axis(s, best, axis=1), np.take_along_axis(i, best, axis=1)
    top_s[rows, k:] = -2.0


def nearest(spark: SparkSession, index: Index, k: int = K, least: float = -2.0) -> DataFrame:
    """id, neighbour, similarity: the ids of the k best classes of every class of at most k ids, of ``least`` or more."""
    held = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                read, who, shard, row, sim = look_up(ix, part, k, least)
                if not len(who):
                    continue
                base = np.cumsum([0] + [len(s.ids) for s in read])
                starts, size = np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
                for s, home in enumerate(read):
                    here = np.flatnonzero(shard == s)
                    starts[here] = base[s] + home.at[row[here]]
                    size[here] = home.at[row[here] + 1] - home.at[row[here]]
                # every id of the one with every id of the other
                own = read[0].at[who + 1] - read[0].at[who]
                pair = np.repeat(np.arange(len(row)), own * size)
                nth = np.arange(len(pair)) - np.repeat(np.cumsum(own * size) - own * size, own * size)
                left, right = read[0].at[who[pair]] + nth // size[pair], starts[pair] + nth % size[pair]
                ids = pa.concat_arrays([s.ids for s in read])
                out = pa.table({"id": ids.take(pa.array(left)), "neighbour": ids.take(pa.array(right)), "similarity": pa.array(sim[pair].astype(np.float64))})
                yield from out.to_batches(max_chunksize=50_000)

    return spark.range(0, len(index.parts), 1, len(index.parts)).mapInArrow(run, "id string, neighbour string, similarity double")


def hash_of(text: str) -> int:
    """A hash that is equal in every worker."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def neighbours(chunks: DataFrame, k: int = K, id_col: str = "chunk_id", vec_col: str = "embedding", dim: int | None = None, recall: float = RECALL, least: float = -2.0) -> DataFrame:
    """id, neighbour, similarity, rank: the k most similar of every id; of these only the ones of ``least`` or more."""
    spark = chunks.sparkSession
    empty = spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    if dim is None:
        common = chunks.where(F.size(F.col(vec_col)) > 0).groupBy(F.size(F.col(vec_col)).alias("d")).count().orderBy(F.desc("count"), "d").first()
        if common is None:
            return empty
        dim = common["d"]
    members = unit_vectors(chunks, dim, id_col, vec_col)
    # classes of equal vectors, named by their smallest id and the vector, as an id may have several; of each class the
    # k + 1 smallest ids can be anyone's neighbours
    classes = members.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).select(F.concat_ws("\0", "first", F.md5("vec")).alias("cls"), "vec", "first", "n")
    classes = cut_lineage(classes)
    copied = classes.where("n > 1").select("vec", "cls", "n")
    copies = cut_lineage(salted_join(members, copied, "vec", hot_of(copied, "vec", "n"), F.col("id")).select("cls", "n", "id"))
    w = Window.partitionBy("cls").orderBy("id")
    # Catalyst keeps the first k + 1 of a class before the shuffle
    head = copies.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    alone = classes.where("n = 1").select(F.col("cls").alias("id"), "vec", "n", F.array("first").alias("ids"))
    index = build(alone.unionByName(copied.join(head, "cls").select(F.col("cls").alias("id"), "vec", "n", "ids")), dim, k, recall)
    # copies of a class with more than k members have each other; those of smaller ones have their fellows and the
    # neighbours of their class
    every = salted_join(copies.select("cls", "id"), head, "cls", hot_of(copied, "cls", "n"), F.col("id")).select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("similarity"))
    if index is not None:
        every = every.unionByName(nearest(spark, index, k, least))
    # one shuffle by id serves both steps
    every = every.where((F.col("id") != F.col("neighbour")) & (F.col("similarity") >= least)).repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)
