"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 9).

Equal vectors are one node.  Nodes lie in parts of about ``PART_NODES``, each a row of numpy blobs; every step is a Spark join of
parts with the messages sent to them.  Vectors (in bytes) lie apart from neighbour lists, which alone are rewritten in each round,
and numbers are sent as byte planes, compressed.

* start: hyperplanes put nodes into blocks, some levels at a time: each block's planes are fitted in a task of its own, on a sample
  of that block, so neither the driver nor any task sees a sample that grows with the table.  Random splits divide a block down to
  leaves of ``LEAF`` nodes, and neighbours are compared within leaves;
* descent: a node and those that list it introduce their best neighbours to each other (neighbours of neighbours); rounds go on
  until few lists change;
* search: each query's beam asks the parts of unseen neighbours for their similarity and, where it is good enough, for their
  lists, until the best of the beam are all expanded.

The candidates found are scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, packed, unpacked

NEIGHBOURS, LISTED, PART_NODES = 32, 16, 4096
#: Blocks' target size, how often nodes are dealt to blocks, splits of each block, and nodes of a leaf.
BLOCK, TREES, SPLITS, LEAF = 16_384, 2, 8, 256
#: Planes are fitted to twice this many sampled vectors a block to be made, and blocks are divided by this many planes deep at once.
SAMPLE, STEP = 32, 6
#: Nodes so near to a plane lie on it: one vector's product differs in its last bits from batch to batch.
ON_PLANE = 1e-5
BEAM, EXPANDED, QUERY_NODES = 160, 24, 128
STABLE = 0.02  # descent ends once a round changes a smaller share of all list entries
NONE = -1

BASE = "part bigint, ids binary, vectors binary"
PLANES = "part bigint, normals binary, middles binary"
STATE = "part bigint, ids binary, near binary, sims binary, fresh binary, worst binary, changed bigint"
MESSAGE = "part bigint, sender bigint, a binary, b binary, sims binary, fresh binary"


def _types(schema: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "bigint" else pa.binary()) for n, t in (f.split() for f in schema.split(", "))])


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = _types(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(fields), fields.types)], schema=fields)


def each_row(run: Callable[[dict], list[tuple]], schema: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of rows as one of batches, a row at a time."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from table_of(run(batch.slice(i, 1).to_pylist()[0]), schema).to_batches()

    return over


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(parts)).astype(np.int64)


def by_part(ids: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that the ids lie in, and where."""
    p = part_of(ids, parts)
    order = np.argsort(p, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
        if len(at):
            yield int(p[at[0]]), at


def in_bytes(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to bytes, each by its own largest component."""
    return np.round(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def unit(data: bytes | np.ndarray, dim: int) -> np.ndarray:
    x = np.frombuffer(data, np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def halves(x: np.ndarray) -> bytes:
    """Similarities in 16 bits; bytes count them finer than that."""
    return x.astype(np.float16).tobytes()


def from_halves(data: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float16).astype(np.float32)


def numbers(data: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpacked, data)])


class State:
    """A part's lists as arrays."""

    def __init__(self, row: dict, k: int) -> None:
        self.part, self.ids = row["part"], unpacked(row["ids"])
        n = len(self.ids)
        self.near = unpacked(row["near"]).reshape(n, k) if row["near"] else np.full((n, k), NONE)
        self.sims = from_halves([row["sims"]]).reshape(n, k) if row["sims"] else np.full((n, k), -np.inf, np.float32)
        self.fresh = np.frombuffer(row["fresh"], bool).reshape(n, k) if row["fresh"] else np.zeros((n, k), bool)

    def row(self, changed: int) -> tuple:
        return self.part, packed(self.ids), packed(self.near.ravel()), halves(self.sims), self.fresh.tobytes(), halves(self.sims[:, -1]), changed


def best_per_owner(owner: np.ndarray, other: np.ndarray, sims: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar distinct others of each owner (0..n-1), as (n, k) arrays with NONE at the end."""
    order = np.lexsort((other, owner))
    owner, other, sims = owner[order], other[order], sims[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sims = owner[keep], other[keep], sims[keep]
    order = np.lexsort((other, -sims, owner))
    owner, other, sims = owner[order], other[order], sims[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    top = rank < k
    near, best = np.full((n, k), NONE), np.full((n, k), -np.inf, np.float32)
    near[owner[top], rank[top]], best[owner[top], rank[top]] = other[top], sims[top]
    return near, best


def merged(k: int, listed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's lists and pairs proposed to it -> the better lists, with what is new in them."""

    def run(states: pa.Table, messages: pa.Table) -> pa.Table:
        if not states.num_rows:
            return table_of([], STATE)
        s = State(states.to_pylist()[0], k)
        at, b, sims = np.searchsorted(s.ids, numbers(messages["a"].to_pylist())), numbers(messages["b"].to_pylist()), from_halves(messages["sims"].to_pylist())
        better = sims > s.sims[at, -1]
        at, b, sims = at[better], b[better], sims[better]
        held = s.near != NONE
        owner = np.concatenate([np.nonzero(held)[0], at])
        near, best = best_per_owner(owner, np.concatenate([s.near[held], b]), np.concatenate([s.sims[held], sims]), len(s.ids), k)
        # entries that were in the list and had their turn aren't fresh; lists are short, so compare all with all, some rows at a time
        past = np.where(s.fresh & ~first_of(held & s.fresh, listed), NONE - 1, s.near)
        known = np.zeros(near.shape, bool)
        for i in range(0, len(near), 1024):
            known[i : i + 1024] = (near[i : i + 1024, :, None] == past[i : i + 1024, None, :]).any(axis=2)
        s.near, s.sims, s.fresh = near, best, (near != NONE) & ~known
        return table_of([s.row(int(s.fresh.sum()))], STATE)

    return run


def proposals(a: np.ndarray, b: np.ndarray, sims: np.ndarray, parts: int) -> list[tuple]:
    return [(p, 0, packed(a[at]), packed(b[at]), halves(sims[at]), None) for p, at in by_part(a, parts)]


# -- start ---------------------------------------------------------------


def drawn(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each id, the same on every run."""
    h = (ids.astype(np.int64).view(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.float64) / 2.0**32


def right(shade: np.ndarray, middle: float, ids: np.ndarray, salt: int) -> np.ndarray:
    """Which nodes lie beyond a plane; those on it, such as vectors alike in bytes, are dealt out to both sides."""
    return np.where(np.abs(shade - middle) < ON_PLANE, drawn(ids, salt) < 0.5, shade > middle)


def fit_planes(ids: np.ndarray, x: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and middles of a tree of hyperplanes in heap order; each splits its part of the sample in halves."""
    rng, normals, middles, rows = np.random.default_rng(seed), [], [], {1: np.arange(len(x))}
    for node in range(1, 1 << depth):
        own = rows.pop(node)
        normal = rng.normal(size=x.shape[1]).astype(np.float32)
        shade = x[own] @ normal
        middle = np.float32(np.partition(shade, len(shade) // 2)[len(shade) // 2]) if len(own) else np.float32(0)
        far = right(shade, middle, ids[own], node)
        rows[2 * node], rows[2 * node + 1] = own[~far], own[far]
        normals.append(normal)
        middles.append(middle)
    return np.array(normals, np.float32), np.array(middles, np.float32)


def leaves(ids: np.ndarray, x: np.ndarray, normals: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """The heap number of each node's leaf."""
    node = np.ones(len(x), np.int64)
    while len(node) and node[0] <= len(middles):
        new = np.empty_like(node)
        for v in np.unique(node):
            own = np.flatnonzero(node == v)
            new[own] = 2 * v + right(x[own] @ normals[v - 1], middles[v - 1], ids[own], int(v))
        node = new
    return node


def sampled(share: float) -> Callable[[dict], list[tuple]]:
    def run(row: dict) -> list[tuple]:
        ids = unpacked(row["ids"])
        some = drawn(ids, row["part"] + (1 << 40)) < share
        small = np.frombuffer(row["vectors"], np.int8).reshape(len(ids), -1)
        return [(row["part"], packed(ids[some]), small[some].tobytes())] if some.any() else []

    return run


def fitted(depth: int, dim: int) -> Callable[[pa.Table], pa.Table]:
    """A block's sample -> its planes."""

    def run(rows: pa.Table) -> pa.Table:
        part, ids = rows["part"][0].as_py(), numbers(rows["ids"].to_pylist())
        order = np.argsort(ids)
        normals, middles = fit_planes(ids[order], unit(b"".join(rows["vectors"].to_pylist()), dim)[order], depth, part)
        return table_of([(part, normals.tobytes(), middles.tobytes())], PLANES)

    return run


def dealt(trees: int, depth: int, dim: int) -> Callable[[dict], list[tuple]]:
    """Nodes of a block with its planes -> a row per block below it; a block without a sample, so with few nodes, stays whole."""

    def run(row: dict) -> list[tuple]:
        if row["normals"] is None:
            return [(row["part"], row["ids"], row["vectors"])]
        ids, small = unpacked(row["ids"]), np.frombuffer(row["vectors"], np.int8).reshape(-1, dim)
        leaf = leaves(ids, unit(row["vectors"], dim), np.frombuffer(row["normals"], np.float32).reshape(-1, dim), np.frombuffer(row["middles"], np.float32))
        above, tree = divmod(row["part"], trees)
        out = []
        for v in np.unique(leaf):
            own = np.flatnonzero(leaf == v)
            below = (above << depth) + int(v) - (1 << depth)
            out.append((below * trees + tree, packed(ids[own]), small[own].tobytes()))
        return out

    return run


def random_leaves(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows divided in halves by random directions until no part has over ``leaf``."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        order = own[np.argsort(x[own] @ rng.normal(size=x.shape[1]).astype(np.float32), kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def compared(k: int, leaf: int, splits: int, parts: int, dim: int) -> Callable[[pa.Table], pa.Table]:
    """One block -> the best pairs within its leaves, to their owners' parts."""

    def run(block: pa.Table) -> pa.Table:
        ids, x = numbers(block["ids"].to_pylist()), unit(b"".join(block["vectors"].to_pylist()), dim)
        rng, near, best = np.random.default_rng(block["part"][0].as_py()), None, None
        for _ in range(splits if len(ids) > leaf else 1):
            owner, other, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            if near is not None:
                held = near != NONE
                owner, other, sims = [np.nonzero(held)[0]], [near[held]], [best[held]]
            for own in random_leaves(x, leaf, rng):
                most = min(k, len(own) - 1)
                if most > 0:
                    s = x[own] @ x[own].T
                    np.fill_diagonal(s, -np.inf)
                    top = np.argpartition(-s, most - 1, axis=1)[:, :most]
                    owner.append(np.repeat(own, most))
                    other.append(own[top].ravel())
                    sims.append(np.take_along_axis(s, top, axis=1).ravel())
            near, best = best_per_owner(*map(np.concatenate, (owner, other, sims)), len(ids), k)
        held = near != NONE
        return table_of(proposals(ids[np.nonzero(held)[0]], ids[near[held]], best[held], parts), MESSAGE)

    return run


# -- descent -------------------------------------------------------------


def first_of(chosen: np.ndarray, listed: int) -> np.ndarray:
    """The first ``listed`` chosen entries of each list (lists begin with the most similar)."""
    return chosen & (np.cumsum(chosen, axis=1) <= listed)


def introduced(k: int, listed: int, parts: int) -> Callable[[dict], list[tuple]]:
    """Each list's best fresh and old entries to the listed nodes' parts: who lists them, the best of this part's for each."""

    def run(row: dict) -> list[tuple]:
        s, rows = State(row, k), []
        held = s.near != NONE
        for old, chosen in enumerate((held & s.fresh, held & ~s.fresh)):
            i, j = np.nonzero(first_of(chosen, listed))
            other, sims = s.near[i, j], s.sims[i, j]
            nodes, place = np.unique(other, return_inverse=True)
            best, likeness = best_per_owner(place, s.ids[i], sims, len(nodes), listed)
            some = best != NONE
            target, who, sims = nodes[np.nonzero(some)[0]], best[some], likeness[some]
            rows += [(p, old, packed(target[at]), packed(who[at]), halves(sims[at]), None) for p, at in by_part(target, parts)]
        return rows

    return run


def gathered(k: int, listed: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's lists and who lists its nodes -> for each node up to ``listed`` fresh and as many old members, and requests for
    the members' vectors.  Rows with a sender of -1 are the part's own; the others go to the members' parts."""

    def run(states: pa.Table, messages: pa.Table) -> pa.Table:
        if not states.num_rows:
            return table_of([], MESSAGE)
        s, members = State(states.to_pylist()[0], k), []
        held, sent = s.near != NONE, messages.to_pylist()
        for old, chosen in enumerate((held & s.fresh, held & ~s.fresh)):
            chosen, mine = first_of(chosen, listed), [m for m in sent if m["sender"] == old]
            owner = np.concatenate([np.nonzero(chosen)[0], np.searchsorted(s.ids, numbers(m["a"] for m in mine))])
            other, sims = np.concatenate([s.near[chosen], numbers(m["b"] for m in mine)]), np.concatenate([s.sims[chosen], from_halves(m["sims"] for m in mine)])
            members.append(best_per_owner(owner, other, sims, len(s.ids), listed)[0])
        new, old = members
        busy = (new != NONE).any(axis=1)  # others introduce nobody new
        new, old = new[busy], old[busy]
        rows = [(s.part, -1, packed(new.ravel()), packed(old.ravel()), None, None)]
        wanted = np.unique(np.concatenate([new.ravel(), old.ravel()]))
        wanted = wanted[wanted != NONE]
        rows += [(p, s.part, packed(wanted[at]), None, None, None) for p, at in by_part(wanted, parts)]
        return table_of(rows, MESSAGE)

    return run


def answered(dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's vectors (with ``worst``, the least similarity in each list) and requests -> those of the nodes asked for."""

    def run(base: pa.Table, messages: pa.Table) -> pa.Table:
        if not base.num_rows:
            return table_of([], MESSAGE)
        own, rows = base.to_pylist()[0], []
        ids, small, worst = unpacked(own["ids"]), np.frombuffer(own["vectors"], np.int8).reshape(-1, dim), np.frombuffer(own["worst"], np.float16)
        for m in messages.to_pylist():
            at = np.searchsorted(ids, unpacked(m["a"]))
            rows.append((m["sender"], 0, m["a"], small[at].tobytes(), worst[at].tobytes(), None))
        return table_of(rows, MESSAGE)

    return run


def met(k: int, listed: int, parts: int, dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's members and their vectors -> pairs of a fresh member with any other that may improve a list, the best of each node."""

    def run(lists: pa.Table, replies: pa.Table) -> pa.Table:
        if not lists.num_rows or not replies.num_rows:
            return table_of([], MESSAGE)
        own = lists.to_pylist()[0]
        new, old = (unpacked(own[c]).reshape(-1, listed) for c in ("a", "b"))
        ids = numbers(replies["a"].to_pylist())
        order = np.argsort(ids)
        ids, x = ids[order], unit(b"".join(replies["b"].to_pylist()), dim)[order]
        worst = from_halves(replies["sims"].to_pylist())[order]
        owner, other, likeness = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for i in range(0, len(new), 512):
            both = np.concatenate([new[i : i + 512], old[i : i + 512]], axis=1)
            none = both == NONE
            at = np.minimum(np.searchsorted(ids, both), len(ids) - 1)
            v = x[at]
            sims = np.matmul(v[:, :listed], v.transpose(0, 2, 1))
            limit = np.where(none, np.inf, worst[at])
            sims[none[:, :listed, None] | none[:, None, :] | (both[:, :listed, None] == both[:, None, :])] = -np.inf
            for gain, flip in ((sims > limit[:, :listed, None], False), (sims > limit[:, None, :], True)):
                c, l, r = np.nonzero(gain)
                pair = (at[c, l], at[c, r])
                owner.append(pair[flip])
                other.append(pair[not flip])
                likeness.append(sims[c, l, r])
        near, best = best_per_owner(*map(np.concatenate, (owner, other, likeness)), len(ids), k)
        held = near != NONE
        return table_of(proposals(ids[np.nonzero(held)[0]], ids[near[held]], best[held], parts), MESSAGE)

    return run


def joined(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(f, schema)


def one_row(dim: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        ids, small = numbers(rows["ids"].to_pylist()), np.frombuffer(b"".join(rows["vectors"].to_pylist()), np.int8).reshape(-1, dim)
        order = np.argsort(ids)
        return table_of([(rows["part"][0].as_py(), packed(ids[order]), small[order].tobytes())], BASE)

    return run


def node_vectors(nodes: DataFrame, dim: int, parts: int) -> DataFrame:
    """Nodes (``node`` long, ``vector`` array<double>) -> a row per part."""

    def parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).flatten()).reshape(-1, dim)
            small = in_bytes(x / np.abs(x).max(axis=1, keepdims=True)) if len(x) else np.zeros((0, dim), np.int8)
            yield from table_of([(p, packed(ids[at]), small[at].tobytes()) for p, at in by_part(ids, parts)], BASE).to_batches()

    return nodes.select("node", "vector").mapInArrow(parted, BASE).groupBy("part").applyInArrow(one_row(dim), BASE)


def blocks_of(base: DataFrame, count: int, dim: int, block: int = BLOCK, trees: int = TREES) -> tuple[DataFrame, list[DataFrame]]:
    """Every node with its vector in a block of about ``block`` nodes of each tree, some rows a block; and the tables written on the way.

    A block's number is that of its heap node times the trees, plus the tree's.  Blocks are divided ``STEP`` planes deep at a time;
    between two such steps a block's rows are put together to some of about ``PART_NODES`` nodes.
    """
    depth, made = max(0, int(np.ceil(np.log2(max(1, count) / block)))), []
    trees = trees if depth else 1
    rows = base.select(F.explode(F.array(*(F.lit(trees + t).cast("bigint") for t in range(trees)))).alias("part"), "ids", "vectors")
    for above in range(0, depth, STEP):
        more = min(STEP, depth - above)
        if above:
            pieces = max(1, -(-count // (PART_NODES << above)))
            rows = cut(rows.groupBy("part", F.pmod(F.xxhash64("ids"), F.lit(pieces)).alias("piece")).applyInArrow(one_row(dim), BASE), "ann-dealt")
            made.append(rows)
        share = min(1.0, 2 * SAMPLE * 2 ** (above + more) / max(1, count))
        planes = cut(rows.mapInArrow(each_row(sampled(share), BASE), BASE).groupBy("part").applyInArrow(fitted(more, dim), PLANES), "ann-planes")
        made.append(planes)
        rows = rows.join(planes, "part", "left").mapInArrow(each_row(dealt(trees, more, dim), BASE), BASE)
    return rows, made


def start_lists(base: DataFrame, count: int, dim: int, k: int, parts: int, block: int = BLOCK, trees: int = TREES, splits: int = SPLITS, leaf: int = LEAF) -> DataFrame:
    """Every node's first list."""
    blocks, made = blocks_of(base, count, dim, block, trees)
    blank = base.select("part", "ids", *(F.lit(None).cast(t).alias(c) for c, t in (("near", "binary"), ("sims", "binary"), ("fresh", "binary"), ("worst", "binary"), ("changed", "bigint"))))
    pairs = blocks.groupBy("part").applyInArrow(compared(k, leaf, splits, parts, dim), MESSAGE)
    lists = cut(joined(blank, pairs, merged(k, k), STATE), "ann-lists")
    drop_cut(base.sparkSession, made)
    return lists


def descend(base: DataFrame, lists: DataFrame, dim: int, k: int, listed: int, parts: int) -> DataFrame:
    """The lists after one round."""
    members = cut(joined(lists, lists.mapInArrow(each_row(introduced(k, listed, parts), MESSAGE), MESSAGE), gathered(k, listed, parts), MESSAGE), "ann-members")
    known = base.join(lists.select("part", "worst"), "part")
    vectors = joined(known, members.where("sender >= 0"), answered(dim), MESSAGE)
    found = joined(members.where("sender < 0"), vectors, met(k, listed, parts, dim), MESSAGE)
    better = cut(joined(lists, found, merged(k, listed), STATE), "ann-lists")
    drop_cut(base.sparkSession, [lists, members])
    return better


def build_graph(nodes: DataFrame, count: int, dim: int, k: int = NEIGHBOURS, listed: int = LISTED, part_nodes: int = PART_NODES, **start: int) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (``node`` long, ``vector`` array<double>) -> vectors and neighbour lists by part, and the number of parts."""
    parts = max(1, -(-count // part_nodes))
    base = cut(node_vectors(nodes, dim, parts), "ann-base")
    lists = start_lists(base, count, dim, k, parts, **start)
    while True:
        lists = descend(base, lists, dim, k, listed, parts)
        if (lists.agg(F.sum("changed")).first()[0] or 0) <= STABLE * count * k:
            return base, lists, parts


# -- search --------------------------------------------------------------


def both_ways(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's vectors with lists, and who lists its nodes -> ``ids``, ``vectors`` and lists of 2 k nodes, its own and then those."""

    def run(own: pa.Table, messages: pa.Table) -> pa.Table:
        row, sent = own.to_pylist()[0], messages.to_pylist()
        s = State(row, k)
        owner, other = np.searchsorted(s.ids, numbers(m["a"] for m in sent)), numbers(m["b"] for m in sent)
        fresh = ~(s.near[owner] == other[:, None]).any(axis=1)
        back, _ = best_per_owner(owner[fresh], other[fresh], from_halves(m["sims"] for m in sent)[fresh], len(s.ids), k)
        return table_of([(s.part, row["ids"], row["vectors"], packed(np.concatenate([s.near, back], axis=1).ravel()))], INDEX)

    return run


INDEX = "part bigint, ids binary, vectors binary, near binary"
BEAMS = "part bigint, queries binary, nodes binary, vectors binary, ids binary, sims binary, done binary, near binary, seen binary, sizes binary, open bigint"


class Beams:
    """A query part's row as arrays: each query's best nodes so far, the lists of those not expanded yet, and all nodes it has seen."""

    def __init__(self, row: dict, dim: int, k: int, beam: int) -> None:
        self.part = row["part"]
        self.queries, self.nodes = unpacked(row["queries"]), unpacked(row["nodes"])
        n = len(self.queries)
        self.small = np.frombuffer(row["vectors"], np.int8).reshape(n, dim)
        self.ids = unpacked(row["ids"]).reshape(n, beam)
        self.sims = np.frombuffer(row["sims"], np.float32).reshape(n, beam).copy()
        self.done = np.frombuffer(row["done"], bool).reshape(n, beam).copy()
        self.near = unpacked(row["near"]).reshape(n, beam, k)
        gaps, sizes = unpacked(row["seen"]), unpacked(row["sizes"])
        self.seen = [np.cumsum(x) for x in np.split(gaps, np.cumsum(sizes)[:-1])]

    def row(self, open_: int) -> tuple:
        gaps, sizes = np.concatenate([np.diff(x, prepend=0) for x in self.seen]), np.array([len(x) for x in self.seen], np.int64)
        near = np.where(self.done[:, :, None], NONE, self.near)
        return self.part, packed(self.queries), packed(self.nodes), self.small.tobytes(), packed(self.ids.ravel()), self.sims.tobytes(), self.done.tobytes(), packed(near.ravel()), packed(gaps), packed(sizes), open_


def wishes(s: Beams, expanded: int) -> Iterator[np.ndarray]:
    """For each query the unseen neighbours of its best unexpanded nodes; on an empty beam its own node."""
    for q in range(len(s.queries)):
        if s.ids[q, 0] == NONE:
            yield np.setdiff1d(s.nodes[q : q + 1], s.seen[q])
            continue
        at = np.flatnonzero(~s.done[q] & (s.ids[q] != NONE))[:expanded]
        near = s.near[q, at].ravel()
        yield np.setdiff1d(near[near != NONE], s.seen[q])


def asked(k: int, dim: int, beam: int, expanded: int, parts: int) -> Callable[[dict], list[tuple]]:
    """Each query's next unexpanded nodes -> their unseen neighbours, asked of the parts that hold them."""

    def run(row: dict) -> list[tuple]:
        s, wanted = Beams(row, dim, k, beam), []
        wanted = list(wishes(s, expanded))
        number, ids = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted)
        rows = []
        for p, at in by_part(ids, parts):
            who, where = np.unique(number[at], return_inverse=True)
            rows.append((p, s.part, packed(np.concatenate([ids[at], where])), packed(who), s.sims[who, -1].tobytes(), s.small[who].tobytes()))
        return rows

    return run


def replied(k: int, dim: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A graph part and questions -> similarities, and the lists of nodes that enter the asking beam."""

    def run(index: pa.Table, messages: pa.Table) -> pa.Table:
        if not index.num_rows or not messages.num_rows:
            return table_of([], MESSAGE)
        own, rows = index.to_pylist()[0], []
        node, vectors = unpacked(own["ids"]), unit(own["vectors"], dim)
        near = unpacked(own["near"]).reshape(len(node), k)
        for m in messages.to_pylist():
            ids, where = unpacked(m["a"]).reshape(2, -1)
            who, worst, x = unpacked(m["b"]), np.frombuffer(m["sims"], np.float32), unit(m["fresh"], dim)
            at = np.searchsorted(node, ids)
            sims = np.einsum("ij,ij->i", vectors[at], x[where])
            good = sims > worst[where]
            rows.append((m["sender"], 0, packed(np.concatenate([ids[good], who[where][good]])), packed(near[at[good]].ravel()), sims[good].tobytes(), None))
        return table_of(rows, MESSAGE)

    return run


def advanced(k: int, dim: int, beam: int, expanded: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Beams and replies -> the next beams, and how many queries still have something to expand."""

    def run(beams: pa.Table, messages: pa.Table) -> pa.Table:
        s = Beams(beams.to_pylist()[0], dim, k, beam)
        s.seen = [np.union1d(a, w) for a, w in zip(s.seen, wishes(s, expanded))]
        for q in range(len(s.queries)):
            s.done[q, np.flatnonzero(~s.done[q] & (s.ids[q] != NONE))[:expanded]] = True
        both = [unpacked(x).reshape(2, -1) for x in messages["a"].to_pylist()]
        ids, number = np.concatenate(both, axis=1) if both else np.zeros((2, 0), np.int64)
        sims = np.frombuffer(b"".join(messages["sims"].to_pylist()), np.float32)
        near = numbers(messages["b"].to_pylist()).reshape(-1, k)
        order = np.argsort(number, kind="stable")
        edges = np.searchsorted(number[order], np.arange(len(s.queries) + 1))
        for q, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b:
                continue
            at = order[a:b]
            all_ids, all_sims = np.concatenate([s.ids[q], ids[at]]), np.concatenate([s.sims[q], sims[at]])
            all_done, all_near = np.concatenate([s.done[q], np.zeros(b - a, bool)]), np.concatenate([s.near[q], near[at]])
            top = np.lexsort((all_ids, -all_sims))[:beam]
            s.ids[q], s.sims[q], s.done[q], s.near[q] = all_ids[top], all_sims[top], all_done[top], all_near[top]
        still = int(((s.ids != NONE) & ~s.done).any(axis=1).sum())
        return table_of([s.row(still)], BEAMS)

    return run


def search(base: DataFrame, lists: DataFrame, parts: int, queries: DataFrame, count: int, dim: int, top: int, k: int = NEIGHBOURS, beam: int = BEAM, expanded: int = EXPANDED) -> DataFrame:
    """Queries (``query_id``, ``node`` to enter the graph at, ``vector``) -> ``query_id``, ``node`` of the ``top`` nodes found.

    A query enters at its own node; that node is expanded like any other and may be among those found.
    """
    groups = max(1, -(-count // QUERY_NODES))
    spark = base.sparkSession

    def start(rows: pa.Table) -> pa.Table:
        queries = rows["query_id"].to_numpy()
        order = np.argsort(queries, kind="stable")
        n, x = len(queries), np.array(rows["vector"].combine_chunks().flatten()).reshape(-1, dim)
        small = in_bytes(x / np.abs(x).max(axis=1, keepdims=True))[order]
        ids, near, zero = packed(np.full(n * beam, NONE)), packed(np.full(n * beam * k, NONE)), packed(np.zeros(n, np.int64))
        blank = (ids, np.full((n, beam), -np.inf, np.float32).tobytes(), np.zeros((n, beam), bool).tobytes(), near, packed(np.zeros(0, np.int64)), zero)
        return table_of([(rows["part"][0].as_py(), packed(queries[order]), packed(rows["node"].to_numpy()[order]), small.tobytes(), *blank, n)], BEAMS)

    vectors = lists.join(base.select("part", "vectors"), "part")
    index, k = cut(joined(vectors, lists.mapInArrow(each_row(introduced(k, k, parts), MESSAGE), MESSAGE), both_ways(k), INDEX), "ann-index"), 2 * k
    spread = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part"), "query_id", "node", "vector")
    beams = cut(spread.groupBy("part").applyInArrow(start, BEAMS), "ann-beams")
    while (beams.agg(F.sum("open")).first()[0] or 0) > 0:
        asking = beams.where("open > 0").mapInArrow(each_row(asked(k, dim, beam, expanded, parts), MESSAGE), MESSAGE)
        onward = cut(joined(beams, joined(index, asking, replied(k, dim), MESSAGE), advanced(k, dim, beam, expanded), BEAMS), "ann-beams")
        drop_cut(spark, [beams])
        beams = onward

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Beams(row, dim, k, beam)
                ids = s.ids[:, :top]
                held = ids != NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(s.queries[:, None], ids.shape)[held]), pa.array(ids[held])], names=["query_id", "node"])

    answer = cut(beams.mapInArrow(found, "query_id bigint, node bigint"), "ann-found")
    drop_cut(spark, [index, beams])
    return answer


# -- the operator --------------------------------------------------------


def usable(vector: F.Column) -> F.Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def scaled(vector: str) -> F.Column:
    """The vector over the power of two below its largest component: the same direction bit for bit, with squares that can be added up."""
    largest = F.array_max(F.transform(vector, F.abs))
    return F.transform(vector, lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(largest))))


def cosine(a: str, b: str) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, is_query: F.Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **sizes: int) -> DataFrame:
    """The ``top`` nearest other rows of each query row, by cosine: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Ties go to the smaller id.  Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id.  A cosine needs vectors of one length, so each length is searched by itself.  Rows with equal vectors are one
    node of the graph; the ``top`` + 1 smallest ids of each are all that an answer can hold.  An id is answered once: a query
    id with several vectors searches with one of them (of the most components, then the least), and a candidate's counts by its
    nearest vector.  Fewer ids than ``top``: all of them.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asking = rows.withColumnRenamed("vec_id", "query_id").where(is_query).groupBy("query_id").agg(F.max_by("vector", F.struct(F.size("vector"), F.transform("vector", lambda x: -x))).alias("vector"))
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    found = [_nearest(rows.where(F.size("vector") == n), asking.where(F.size("vector") == n), n, top, **sizes) for n in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    answer = found[0]
    for other in found[1:]:
        answer = answer.unionByName(other)
    return answer


def _nearest(rows: DataFrame, asking: DataFrame, dim: int, top: int, **sizes: int) -> DataFrame:
    k, spark = sizes.get("k", NEIGHBOURS), rows.sparkSession
    rows = rows.withColumn("code", F.xxhash64("vector"))
    # numbers are written with the rows, so every later step reads the same ones
    nodes = cut(rows.groupBy("code", "vector").agg(F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    count = nodes.count()
    base, lists, parts = build_graph(nodes, count, dim, **sizes)
    queries = cut(asking.withColumn("code", F.xxhash64("vector")).join(nodes, ["code", "vector"]).select("query_id", "node", "vector"), "ann-queries")
    found = search(base, lists, parts, queries, queries.count(), dim, 8 * top, k=k)
    drop_cut(spark, [base, lists])
    pairs = found.join(nodes.select("node", "code", F.col("vector").alias("there")), "node").join(queries.select("query_id", F.col("vector").alias("here")), "query_id")
    scored = pairs.withColumns({"a": scaled("here"), "b": scaled("there")}).select("query_id", "code", F.col("there").alias("vector"), cosine("a", "b").alias("score"))
    ranked = rows.groupBy("code", "vector", "vec_id").agg(F.count("*").alias("copies")).withColumn("place", F.row_number().over(Window.partitionBy("code", "vector").orderBy("vec_id"))).where(F.col("place") <= top + 1)
    each = scored.join(ranked.select("code", "vector", "vec_id"), ["code", "vector"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
