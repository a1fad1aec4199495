"""Embedding near-duplicates with a hierarchical navigable small-world graph for each shard.

Exact copies of a vector are one class. Classes are dealt by hash into shards of at most SHARD vectors and about
SHARD_BYTES; a task builds a shard's graph, audits its recall against brute force on points that have links (its own
and some of all shards), widens the beam until the audit passes, and writes the graph to the shared folder. Every
class then queries every shard of its length, in blocks that load each graph once. What is found is verified by cosine
in double precision. A query whose beam is full of links is compared with the whole shard, so no number of partners is
a limit; so are all queries of a shard whose audit fails even at full width, as its graph is disconnected. Queries
with few links return them; others return how many they have, and a spanning forest. Links become components, and
copies follow their class.

All steps run for many queries at once in numpy: beams advance side by side.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stored
from .graph import components
from .sstable import open_folder, sweep

SHARD, SHARD_BYTES = 65_536, 64 << 20
LINKS, BUILD_BEAM, FIRST_BEAM = 16, 48, 32
AUDITED, RECALL = 256, 0.995
#: Vectors of all shards that every audit asks for, and how many have to have links.
FOREIGN = 512
#: Vectors of a block of queries, and queries that an audit compares with a whole shard at once.
BLOCK, TILE = 8192, 256
#: Slack for single precision; double precision decides afterwards.
SLACK = 1e-3


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x at length one in single precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _choose(sims: np.ndarray, ids: np.ndarray, vecs: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates: up to `most` ids (-1 for none), near ones that aren't nearer to one already chosen first."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    held = vecs[np.maximum(ids, 0)]
    between = np.matmul(held, held.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, dtype=bool)
    for k in range(ids.shape[1]):
        nearest = np.where(chosen[:, :k], between[:, k, :k], -2.0).max(axis=1) if k else np.full(len(ids), -2.0)
        chosen[:, k] = (ids[:, k] >= 0) & (sims[:, k] > nearest) & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    first = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(np.where(ids >= 0, ids, -1), first, 1)


class Graph:
    """vecs: unit vectors in single precision. Points are renumbered by level, highest first; `order` gives their rows."""

    def __init__(self, vecs: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> None:
        self.vecs, self.order, self.levels = vecs, order, levels

    @classmethod
    def build(cls, vecs: np.ndarray, seed: int = 11) -> Graph:
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(len(vecs))) / math.log(LINKS)).astype(int), 12)
        order = np.lexsort((rng.permutation(len(vecs)), -height))
        self = cls(vecs[order], order, [])
        sizes = [int((height >= h).sum()) for h in range(int(height.max()) + 1)]
        for h in range(len(sizes) - 1, -1, -1):
            self.levels.insert(0, np.full((sizes[h], LINKS if h else 2 * LINKS), -1, dtype=np.int32))
            at = 0
            while at < sizes[h]:
                to = min(sizes[h], at + min(1024, max(32, at)))
                self._insert(at, to)
                at = to
        return self

    def _insert(self, at: int, to: int) -> None:
        """Points at..to join the lowest level built so far."""
        q, level = self.vecs[at:to], self.levels[0]
        inner = q @ q.T
        np.fill_diagonal(inner, -2.0)
        k = min(LINKS, to - at - 1)
        near = np.argpartition(-inner, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((to - at, 0), dtype=np.int64)
        ids, sims = near + at, np.take_along_axis(inner, near, 1)
        if at:
            got, s = self._beam(0, q, self._entries(q, 1, at), BUILD_BEAM)
            ids, sims = np.hstack([got, ids]), np.hstack([s, sims])
        if not ids.shape[1]:
            return
        level[at:to, :LINKS] = _pad(_choose(sims, ids, self.vecs, LINKS), LINKS)
        b, j = np.nonzero(level[at:to] >= 0)
        to_, from_ = level[at:to][b, j].astype(np.int64), b + at
        keep = ~((to_ >= at) & (level[to_] == from_[:, None]).any(axis=1))  # within the batch both may have chosen the other
        to_, from_ = to_[keep], from_[keep]
        s = np.einsum("ij,ij->i", self.vecs[to_], self.vecs[from_])
        o = np.lexsort((-s, to_))
        to_, from_ = to_[o], from_[o]
        heads, first, n = np.unique(to_, return_index=True, return_counts=True)
        place = np.arange(len(to_)) - np.repeat(first, n)
        width = level.shape[1]
        for i in range(0, len(heads), 2048):
            some = heads[i : i + 2048]
            lo, hi = first[i], first[i + len(some) - 1] + n[i + len(some) - 1]
            ok = place[lo:hi] < 2 * width
            extra = np.full((len(some), min(int(n[i : i + len(some)].max()), 2 * width)), -1, dtype=np.int64)
            extra[np.searchsorted(some, to_[lo:hi][ok]), place[lo:hi][ok]] = from_[lo:hi][ok]
            both = np.hstack([level[some].astype(np.int64), extra])
            full = (both >= 0).sum(1) > width
            loose = ~full
            if loose.any():
                pick = np.argsort(both[loose] < 0, axis=1, kind="stable")[:, :width]
                level[some[loose]] = _pad(np.take_along_axis(both[loose], pick, 1), width)
            if full.any():
                c = both[full]
                s = np.einsum("ij,ikj->ik", self.vecs[some[full]], self.vecs[np.maximum(c, 0)])
                level[some[full]] = _pad(_choose(np.where(c >= 0, s, -2.0), c, self.vecs, width), width)

    def _entries(self, q: np.ndarray, down_to: int, limit: int | None = None) -> np.ndarray:
        """The nearest point found on level down_to, coming from the top; 0 where it is not below `limit`."""
        at = np.zeros(len(q), dtype=np.int64)
        for h in range(len(self.levels) - 1, down_to - 1, -1):
            at = self._beam(h, q, at, 4)[0][:, 0]
        return at if limit is None else np.where(at < limit, at, 0)

    def _beam(self, h: int, q: np.ndarray, entry: np.ndarray, beam: int, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities, best first, -1 and -2 where there are fewer than beam."""
        level, n = self.levels[h], len(self.levels[h])
        rows = max(1, 48_000_000 // n)
        if len(q) > rows:
            got = [self._beam(h, q[i : i + rows], entry[i : i + rows], beam, ahead) for i in range(0, len(q), rows)]
            return np.vstack([g[0] for g in got]), np.vstack([g[1] for g in got])
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -2.0, dtype=np.float32)
        done = np.zeros((len(q), beam), dtype=bool)
        seen = np.zeros((len(q), n), dtype=bool)
        ids[:, 0], sims[:, 0] = entry, np.einsum("ij,ij->i", q, self.vecs[entry])
        seen[np.arange(len(q)), entry] = True
        active = np.arange(len(q))
        ahead = min(ahead, beam)
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), -3.0, sims[active])
            pick = np.argpartition(-open_, ahead - 1, axis=1)[:, :ahead] if beam > ahead else np.tile(np.arange(beam), (len(active), 1))
            valid = np.take_along_axis(open_, pick, 1) > -3.0
            some = valid.any(axis=1)
            active, pick, valid = active[some], pick[some], valid[some]
            if not len(active):
                break
            done[active[:, None], pick] |= valid
            near = level[ids[active[:, None], pick]]
            near[~valid] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(new)
            new[r, c] = ~seen[active[r], near[r, c]]
            r, c = np.nonzero(new)
            points = near[r, c]
            seen[active[r], points] = True
            s = np.full(near.shape, -2.0, dtype=np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[active[r]], self.vecs[points])
            all_s = np.hstack([sims[active], s])
            all_i = np.hstack([ids[active], np.where(new, near, -1)])
            all_d = np.hstack([done[active], np.zeros(near.shape, dtype=bool)])
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[active], ids[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_d))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and row number of the points found at similarity `least` or more, and the queries whose beam is full of such, which are left out."""
        n = len(self.vecs)
        beam = min(beam, n)
        ids, sims = self._beam(0, q, self._entries(q, 1), beam)
        full = (sims[:, -1] >= least) & (beam < n)
        r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
        return r, self.order[ids[r, c]], np.flatnonzero(full)

    def _asked(self, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries (own: the point that each is, or -1) the first AUDITED with links other than to themselves, and these links."""
        asked, rows, points, linked = [], [], [], 0
        for i in range(0, len(q), TILE):
            near = q[i : i + TILE] @ self.vecs.T >= least
            mine = np.flatnonzero(own[i : i + TILE] >= 0)
            near[mine, own[i + mine]] = False
            r, c = np.nonzero(near)
            has, at = np.unique(r, return_inverse=True)
            asked.append(i + has)
            rows.append(at + linked)
            points.append(self.order[c])
            linked += len(has)
            if linked >= AUDITED:
                break
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asked, rows, points))

    def audit(self, least: float, foreign: np.ndarray | None = None) -> tuple[int, float, int]:
        """The beam with which recall passes, that recall, and how many links it is of; beam 0 if none does, not even one as wide as the shard.

        Points, and vectors of other shards (foreign), are compared with the whole shard until AUDITED of each have links
        other than to themselves, or all have been; recall is the lesser of that over links and the mean over queries,
        and full beams count as found, as such queries are compared with the whole shard. Without links it is 1.
        """
        n = len(self.vecs)
        some = np.random.default_rng(3).permutation(n)
        asked, rows, points = self._asked(self.vecs[some], some, least)
        q = self.vecs[some[asked]]
        if foreign is not None and len(foreign):
            more, r, p = self._asked(foreign, np.full(len(foreign), -1), least)
            q, rows, points = np.vstack([q, foreign[more]]), np.concatenate([rows, r + len(asked)]), np.concatenate([points, p])
        if not len(rows):
            return FIRST_BEAM, 1.0, 0
        true = rows * n + points
        each, beam = np.bincount(rows, minlength=len(q)), FIRST_BEAM
        while True:
            a, b, full = self.within(q, least, beam)
            hit = np.isin(true, a * n + b) | np.isin(rows, full)
            recall = min(float(hit.mean()), float((np.bincount(rows[hit], minlength=len(q)) / each).mean()))
            if recall >= RECALL:
                return beam, recall, len(true)
            if beam >= n:
                return 0, recall, len(true)
            beam *= 2


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.full((len(x), width - x.shape[1]), -1, dtype=x.dtype)])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of x with rows of y, in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x.astype(np.float64), y.astype(np.float64)))
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def classes(vectors: DataFrame) -> DataFrame:
    """Vectors that can link, one row for each different one: node (least vec_id), n (how many), dim, v, and h1, h2, which tell it from others."""
    v = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    good = vectors.where(F.coalesce(fit, F.lit(False))).select("vec_id", v.alias("v"), *_name(v))
    return good.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("dim", F.size("v"))


def _name(v):
    return F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2")


def shard_size(dim: int) -> int:
    return max(1, min(SHARD, max(4096, SHARD_BYTES // (8 * dim))))


FOUND = "kind int, a long, b long, a_shard long, b_shard long, a_n long, b_n long"
PAIR, COUNT, EDGE = 0, 1, 2


def _unit64(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def dense_links(raw: np.ndarray, at: np.ndarray, node: np.ndarray, other_raw: np.ndarray, other: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows `at` of raw against all other_raw in double precision: the weight of the links of each, and edges (row, other) that span what they link."""
    counts, edges = np.zeros(len(at), np.int64), []
    points, label = _unit64(other_raw), np.arange(len(other))
    step = max(1, 4_000_000 // max(1, len(other)))
    for i in range(0, len(at), step):
        rows = at[i : i + step]
        sims = _unit64(raw[rows]) @ points.T
        near = sims >= least
        r, c = np.nonzero(np.abs(sims - least) < 1e-9)  # at the very threshold the quotient decides
        near[r, c] = cosine(raw[rows[r]], other_raw[c]) >= least if len(r) else False
        near &= node[rows][:, None] != other[None, :]
        for k, row in enumerate(rows.tolist()):
            counts[i + k] = weight[near[k]].sum()
            groups, first = np.unique(label[near[k]], return_index=True)
            edges += [(row, p) for p in np.flatnonzero(near[k])[first].tolist()]
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
    return counts, edges


def found_links(reps: DataFrame, least: float) -> tuple[DataFrame, list[dict]]:
    """reps: node, n, dim, v. Rows of FOUND, and a record of each shard's audit (dim, shard, size, beam, recall, links).

    A PAIR is a link that a found in b's shard, among few; a COUNT is the weight of all the links that a has in a shard
    (b_shard, b_n), where it has many; an EDGE joins what such links join.
    """
    spark = reps.sparkSession
    folder = fresh_path(spark, "graphs")
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    shard = F.lit(0)
    for dim, n in sizes.items():
        shard = F.when(F.col("dim") == dim, F.pmod(F.xxhash64("node"), F.lit(-(-n // shard_size(dim))))).otherwise(shard)
    dealt = reps.select("node", "n", "dim", "v", shard.cast("long").alias("shard"))
    some = dealt.select("node", "dim", "v").orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(FOREIGN).collect()
    foreign = {d: unit(np.array([r["v"] for r in some if r["dim"] == d])) for d in {r["dim"] for r in some}}
    names = {d: {r["node"] for r in some if r["dim"] == d} for d in foreign}
    listed = {d: [r["node"] for r in some if r["dim"] == d] for d in foreign}

    def build(t: pa.Table) -> pa.Table:
        dim, number = t["dim"][0].as_py(), t["shard"][0].as_py()
        node = t["node"].to_numpy()
        by = np.argsort(node, kind="stable")
        raw = _matrix(t["v"])[by]
        g = Graph.build(unit(raw))
        mine = names.get(dim, set()).intersection(node.tolist())
        beam, recall, links = g.audit(least - SLACK, foreign[dim][[x not in mine for x in listed[dim]]] if dim in foreign else None)
        fs, at = open_folder(folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{at}/{name}") as f:
            out = io.BytesIO()
            np.savez(out, node=node[by], n=t["n"].to_numpy()[by], raw=raw, order=g.order, **{f"level{i}": x for i, x in enumerate(g.levels)})
            f.write(out.getbuffer())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([number], pa.int64()), "name": [name], "size": pa.array([len(node)], pa.int64()), "beam": pa.array([beam], pa.int64()), "recall": [recall], "links": pa.array([links], pa.int64())})

    made = [r.asDict() for r in dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, name string, size long, beam long, recall double, links long").collect()]
    sweep(folder, {s["name"] for s in made})

    def load(name: str):
        fs, at = open_folder(f"{folder}/{name}")
        with fs.open_input_file(at) as f:
            z = np.load(io.BytesIO(f.read()))
            return z["node"], z["n"], z["raw"], Graph(unit(z["raw"])[z["order"]], z["order"], [z[f"level{i}"] for i in range(sum(k.startswith("level") for k in z.files))])

    def query(batches):
        held, size = [], 0  # a task's block of queries, so that a graph is loaded once for it
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield from ask(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from ask(pa.Table.from_batches(held))

    def ask(t: pa.Table):
        dims = t["dim"].to_numpy()
        for s in made:
            if not (dims == s["dim"]).any():
                continue
            mine = t.filter(pa.array(dims == s["dim"]))
            node, n, home = (mine[c].to_numpy() for c in ("node", "n", "shard"))
            raw = _matrix(mine["v"])
            q = unit(raw)
            other, weight, other_raw, g = load(s["name"])
            x, y, full = g.within(q, least - SLACK, s["beam"]) if s["beam"] else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(q)))
            ok = node[x] != other[y]
            x, y = x[ok], y[ok]
            ok = cosine(raw[x], other_raw[y]) >= least if len(x) else np.zeros(0, bool)
            x, y = x[ok], y[ok]
            yield rows(PAIR, node[x], other[y], home[x], s["shard"], n[x], weight[y])
            counts, edges = dense_links(raw, full, node, other_raw, other, weight, least)
            yield rows(COUNT, node[full], node[full], home[full], s["shard"], n[full], counts)
            e = np.array(edges, dtype=np.int64).reshape(-1, 2)
            yield rows(EDGE, node[e[:, 0]], other[e[:, 1]], home[e[:, 0]], s["shard"], n[e[:, 0]], weight[e[:, 1]])

    def rows(kind, a, b, a_shard, b_shard, a_n, b_n):
        cols = (a, b, a_shard, np.full(len(a), b_shard), a_n, b_n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), *(pa.array(c, pa.int64()) for c in cols)], ["kind", "a", "b", "a_shard", "b_shard", "a_n", "b_n"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) // BLOCK))
    return dealt.repartition(parts, "node").mapInArrow(query, FOUND), made


def link_counts(found: DataFrame) -> DataFrame:
    """found: of found_links. a, others: the weight of the links of each node that has some; a link that only one side found counts for both."""
    counted = found.where(F.col("kind") == COUNT).select("a", "b_shard", "b_n")
    pairs = found.where(F.col("kind") == PAIR)
    both = pairs.select("a", "b", "b_shard", "b_n").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_shard").alias("b_shard"), F.col("a_n").alias("b_n"))).distinct()
    few = both.join(counted, ["a", "b_shard"], "left_anti").select("a", "b_n")
    return few.union(counted.select("a", "b_n")).groupBy("a").agg(F.sum("b_n").alias("others"))


def near_duplicates(vectors: DataFrame, least: float = 0.9, audits: list[dict] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    Rows link when their cosine in double precision is `least` or more. Embeddings that are null, empty, zero, or hold
    null or non-finite components link with nothing; vectors of different lengths don't link with each other; a row
    with a null vec_id takes no part and gets 0, null and false. Rows with the same vec_id are rows of their own that
    share a name. Other columns are ignored; no rows give no rows. audits, if given, gets a record of each shard's audit.
    """
    v = F.col("embedding").cast("array<double>")
    reps = stored(classes(vectors), "vectors")
    links, made = found_links(reps, least)
    if audits is not None:
        audits += made
    found = stored(links, "links")
    groups = components(found.where(F.col("kind") != COUNT).select("a", "b")).withColumnRenamed("node", "a")
    final = reps.join(link_counts(found), F.col("node") == F.col("a"), "left").drop("a").join(groups, F.col("node") == F.col("a"), "left")
    final = final.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("group"))
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *_name(v)).join(final, ["h1", "h2"], "left")
    inside = F.col("vec_id").isNotNull()
    group = F.when(inside, F.coalesce("group", "vec_id"))
    return named.select("vec_id", F.when(inside, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(group == F.col("vec_id"), F.lit(False)).alias("kept"))
