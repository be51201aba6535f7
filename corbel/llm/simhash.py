"""Near-duplicates by SimHash fingerprints in a distributed vantage-point tree.

A bounded sample shapes the tree: a node holds a vantage fingerprint and a median distance, its leaves are shards.
Every fingerprint is at home in one shard and a guest in each shard whose region its ball of ``radius`` touches
(triangle bound), so two fingerprints within ``radius`` always meet. A shard is cut into a grid of tasks by its
counted size, and each task joins its part with a vantage-point recursion in arrays. Tasks emit spanning links only,
never all pairs of a group; connected components are then formed over all tasks' links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, clearing, free_name, give_back, lean, slices, stable, without
from .components import components

SEED = 42


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``words`` lower-cased words, repeats included; all words together if they are fewer."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(x), seed) for x in zip(*(w[i:] for i in range(words)))], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp, shingles)``: the 64-bit SimHash and the number of shingles; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            fps, sizes = [], []
            for text in as_bytes(batch.column("t")):
                h = shingle_hashes(text, words)
                fps.append(np.uint64(fingerprint(h)).view(np.int64))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())], ["id", "fp", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(lean(run), "id long, fp long, shingles long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of rows of lanes; broadcasts."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class Tree:
    """The shard level of the tree: nested tuples (vantage, median, inner, outer), a leaf being its number."""

    def __init__(self, sample: np.ndarray, radius: int, depth: int, most_overlap: float = 0.8):
        self.radius, self.leaves, self.most_overlap = radius, 0, most_overlap
        self.root = self._grow(sample, depth, np.random.default_rng(SEED))

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        best = None
        if depth and len(points) >= 32:
            for v in points[rng.choice(len(points), 6, replace=False)]:
                d = distance(points, v)
                mu = int(np.median(d))
                if (d <= mu).all():
                    continue
                overlap = float(((d > mu - self.radius) & (d <= mu + self.radius)).mean())
                if best is None or overlap < best[0]:
                    best = (overlap, v, mu, d)
        if best is None or best[0] > self.most_overlap:  # triangle bounds would prune nothing here
            self.leaves += 1
            return self.leaves - 1
        _, v, mu, d = best
        return v, mu, self._grow(points[d <= mu], depth - 1, rng), self._grow(points[d > mu], depth - 1, rng)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of a row, leaf, and whether the row is at home there."""
        rows, leaves, homes = [], [], []

        def down(node, at: np.ndarray, home: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                rows.append(at)
                leaves.append(np.full(len(at), node))
                homes.append(home)
                return
            v, mu, inner, outer = node
            d = distance(fps[at], v)
            near, far = d <= mu + self.radius, d > mu - self.radius
            down(inner, at[near], home[near] & (d[near] <= mu))
            down(outer, at[far], home[far] & (d[far] > mu))

        down(self.root, np.arange(len(fps)), np.ones(len(fps), bool))
        return (np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def close_pairs(homes: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 128, block: int = 1 << 21):
    """Yields (query, homes' indices, distances) for each query row and tree leaf with homes within ``radius``."""
    rng = np.random.default_rng(SEED)

    def down(h: np.ndarray, q: np.ndarray, tries: int):
        if not len(h) or not len(q):
            return
        if len(h) > leaf and tries:
            v = homes[h[rng.integers(len(h))]]
            dh = distance(homes[h], v)
            mu = int(np.median(dh))
            dq = distance(queries[q], v)
            near, far = dq <= mu + radius, dq > mu - radius
            if (dh <= mu).all() or near.mean() + far.mean() > 1.8:
                yield from down(h, q, tries - 1)
                return
            yield from down(h[dh <= mu], q[near], 4)
            yield from down(h[dh > mu], q[far], 4)
            return
        step = max(1, block // len(h))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            d = np.bitwise_count(queries[part][:, None, 0] ^ homes[h][None, :, 0]).astype(np.int16)
            for k in range(1, homes.shape[1]):
                d += np.bitwise_count(queries[part][:, None, k] ^ homes[h][None, :, k])
            hit = d <= radius
            for i in np.flatnonzero(hit.any(1)):
                js = np.flatnonzero(hit[i])
                yield part[i], h[js], d[i, js]

    yield from down(np.arange(len(homes)), np.arange(len(queries)), 4)


class Forest:
    """Union-find over positions; ``find`` takes an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = self.up[y]

    def join(self, a: int, b: int) -> bool:
        a, b = (int(self.find(np.array([x]))[0]) for x in (a, b))
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(ids: np.ndarray, fps: np.ndarray, home: np.ndarray, query: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what the homes and queries of one task link, as few as it takes."""
    at_home, at_query = np.flatnonzero(home), np.flatnonzero(query)
    forest, out = Forest(len(ids)), []
    for q, hs, ds in close_pairs(fps[at_home], fps[at_query], radius):
        q, hs = int(at_query[q]), at_home[hs]
        other = ids[hs] != ids[q]
        hs, ds = hs[other], ds[other]
        while len(hs):
            free = forest.find(hs) != forest.find(np.array([q]))[0]
            hs, ds = hs[free], ds[free]
            if len(hs):
                j = int(hs[np.argmin(ds)])
                forest.join(q, j)
                out.append((int(ids[q]), int(ids[j])))
    return out


def near_links(points: DataFrame, radius: int, shards: int | None = None, sample: int = 4096, cell: int = 400_000) -> DataFrame:
    """Spanning links ``(u, v)`` of ``points(id, fp)`` within ``radius`` bits.

    ``points`` must be stable (read twice) with distinct ids. ``shards``: leaves, 64 or one for each 250,000 points. ``sample``: rows that
    shape the tree, at most about so many, or 64 a leaf. ``cell``: homes and queries of one task at most about so many.
    """
    n = points.count()
    lanes = points.select(F.size("fp").alias("k")).first() if n else None
    if lanes is None:
        return points.sparkSession.createDataFrame([], "u long, v long")
    shards = shards or max(64, 1 << math.ceil(math.log2(max(1, n / 250_000))))
    sample = max(sample, 64 * shards)
    share = min(1.0, sample / n)
    rows = points.where((F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("fp").limit(2 * sample).toArrow()
    tree = Tree(_lanes(rows.column("fp"), lanes["k"]), radius, int(math.log2(shards)))

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tree.route(_lanes(batch.column("fp"), lanes["k"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, queries = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
        for batch in batches:
            _, leaf, home = places(batch)
            homes += np.bincount(leaf[home], minlength=tree.leaves)
            queries += np.bincount(leaf, minlength=tree.leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tree.leaves)), pa.array(homes), pa.array(queries)], ["leaf", "h", "q"])

    # one row a leaf: how many parts its homes and its queries are cut into
    rows_of, columns_of = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for x in points.select("fp").mapInArrow(count, "leaf long, h long, q long").groupBy("leaf").agg(F.sum("h").alias("h"), F.sum("q").alias("q")).where("h > 0 and q > 1").collect():
        rows_of[x["leaf"]], columns_of[x["leaf"]] = math.ceil(x["h"] / cell), math.ceil(x["q"] / cell)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A leaf is a grid of cells: a home goes to its row of cells, a query to its column; where both meet it has both roles."""
        for batch in batches:
            at, leaf, home = places(batch)
            used = rows_of[leaf] > 0
            at, leaf, home = at[used], leaf[used], home[used]
            key = batch.column("id").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            a, c = rows_of[leaf], columns_of[leaf]
            row, column = (key % a.astype(np.uint64)).astype(np.int64), (key % c.astype(np.uint64)).astype(np.int64)
            q = np.repeat(np.arange(len(at)), a)  # a query in every row of its column
            i = np.arange(len(q)) - np.repeat(np.cumsum(a) - a, a)
            h = np.repeat(np.flatnonzero(home), c[home])  # a home in every column of its row, but the one it queries
            j = np.arange(len(h)) - np.repeat(np.cumsum(c[home]) - c[home], c[home])
            h, j = h[j != column[h]], j[j != column[h]]
            place = np.concatenate([i * c[q] + column[q], row[h] * c[h] + j])
            role = np.concatenate([2 + (home[q] & (i == row[q])), np.ones(len(h), np.int64)]).astype(np.int8)
            take = pa.array(at[np.concatenate([q, h])])
            if len(take):
                cells = [pa.array(leaf[np.concatenate([q, h])] << 24 | place), pa.array(role), batch.column("id").take(take), batch.column("fp").take(take)]
                yield pa.RecordBatch.from_arrays(cells, ["cell", "role", "id", "fp"])

    def join(part: pa.Table) -> pa.Table:
        ids, role = part.column("id").to_numpy(), part.column("role").to_numpy()
        out = spanning_links(ids, _lanes(part.column("fp"), lanes["k"]), (role & 1) > 0, (role & 2) > 0, radius)
        give_back()
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return points.select("id", "fp").mapInArrow(spread, "cell long, role byte, id long, fp array<long>").groupBy("cell").applyInArrow(join, "u long, v long")


def _lanes(column: pa.Array, k: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).view(np.uint64).reshape(-1, k)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Every row's id with its SimHash and the smallest id reachable over links of at most ``radius`` bits.

    Returns ``(doc_id, fingerprint, component_id)``. Null, empty and blank texts have fingerprint zero and link like
    any other. Rows that repeat an id keep their own rows; a null id gets a null component unless others share its
    fingerprint. An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    fps = stable(fingerprints(docs, id_col, text_col, words).select("id", "fp"))
    nodes = stable(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    # a fingerprint's number of its own: the smallest id of several fingerprints can be the same where ids repeat
    points = nodes.select(F.col("fp").alias("id"), F.array("fp").alias("fp"))
    comp = components(near_links(points, radius))
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SLOTS = 1 << 16


def _rarity(texts: DataFrame) -> np.ndarray:
    """The place of each of 65,536 slots (the high bits of shingles' hashes) by how many shingles of all texts fall into it: what is common stands out from the even rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount((np.asarray(batch.column("hashes").flatten()).view(np.uint64) >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "n"])

    rows = texts.select("hashes").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    place = np.zeros(SLOTS, np.uint64)
    place[np.argsort(out, kind="stable")] = np.arange(SLOTS, dtype=np.uint64)
    return place


def _met(token: np.ndarray, size: np.ndarray, node: np.ndarray, fp: np.ndarray, hot: np.ndarray, similarity: float, bits: int) -> tuple[list[int], list[int]]:
    """Links that span what rows sorted by token and size may link: rows of one token are compared at distance 1, 2, ... all at once; hot rows with their neighbours only."""
    names, own = np.unique(node, return_inverse=True)
    up, us, vs, at, k = np.arange(len(names)), [], [], np.arange(len(token)), 1
    while True:
        at = at[at + k < len(token)]
        at = at[(token[at] == token[at + k]) & ((k == 1) | ~hot[at])]
        if not len(at):
            return us, vs
        near = (np.bitwise_count(fp[at] ^ fp[at + k]) <= bits) | (size[at] < 32) | hot[at]
        take = at[near & (size[at] >= similarity * size[at + k] - 1e-9)]
        a, b = own[take], own[take + k]
        apart = up[a] != up[b]  # what is connected already needs no further link
        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
            p, q = x, y
            while up[p] != p:
                p = up[p]
            while up[q] != q:
                q = up[q]
            if p != q:
                up[max(p, q)] = min(p, q)
                us.append(int(min(names[x], names[y])))
                vs.append(int(max(names[x], names[y])))
        while (up[up] != up).any():
            up = up[up]
        k += 1


def prefix_links(texts: DataFrame, similarity: float, bits: int = 25, most: int = 1024) -> DataFrame:
    """``(u, v)`` that connect what of stable ``texts(node, fp, size, hashes)`` may have that Jaccard similarity; equal texts may be among them, empty sets have no link.

    Of two such sets ordered alike, rare elements first, the first ``size - ceil(similarity * size) + 1`` elements have one in common. Texts that share such an
    element meet, in order of size, if their sizes allow the similarity and, from 32 shingles on, their SimHashes differ in ``bits`` bits
    at most (at a similarity of 0.8 the mean is 10 of 64, and more than 25 has odds of about 2 in a million). Only spanning links go on, so no group is paired off. An
    element that over ``most`` texts share chains them instead, whatever their SimHashes, in one pass; as each of them has many more elements, it is a small part of all rows.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_rarity(texts))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, nodes = batch.column("hashes"), batch.column("node").to_numpy()
            flat, cuts = np.asarray(sets.flatten()), np.concatenate([[0], np.cumsum(np.diff(sets.offsets.to_numpy()))])
            code = flat.view(np.uint64)
            rank = sent.value[(code >> np.uint64(48)).astype(np.int64)] << np.uint64(48) | code & np.uint64((1 << 48) - 1)  # an order of all hashes, without ties
            sizes = np.diff(cuts)
            keep = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
            first = [np.argpartition(rank[a:b], k - 1)[:k] + a if k < b - a else np.arange(a, b) for a, b, k in zip(cuts, cuts[1:], keep)]
            take = np.concatenate([*first, np.zeros(0, np.int64)]).astype(np.int64)
            cells = [pa.array(flat[take]), pa.array(np.repeat(sizes, keep).astype(np.int32)), pa.array(np.repeat(nodes, keep)), pa.array(np.repeat(batch.column("fp").to_numpy(), keep))]
            yield pa.RecordBatch.from_arrays(cells, ["token", "size", "node", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chained = ("token", "size", "node", "fp"), None
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            token, size, node, fp = rows
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            hot = np.repeat(np.diff(cuts) > most, np.diff(cuts)) | (token == chained if chained is not None else False)
            u, v = _met(token, size, node, fp.view(np.uint64), hot, similarity, bits)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, names)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # where the token that may go on begins
            if last:
                yield links([x[:last] for x in rows])
                chained = chained if rows[0][-1] == chained else None
            held = [x[last:] for x in rows]
            if len(held[0]) > most:
                chained = held[0][0]
                yield links(held)
                held = [x[-1:] for x in held]
        if len(held[0]):
            yield links(held)

    rows = texts.select("node", "fp", "hashes").mapInArrow(lean(prefix), "token long, size int, node long, fp long")
    return rows.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(lean(meet), "u long, v long").distinct()


def similar_links(nodes: DataFrame, similarity: float, part: int = 2 << 20) -> DataFrame:
    """Links ``(u, v)`` of ``nodes(node, component, size, hashes)`` (stable) that span, in each component, what has that Jaccard similarity; all are verified.

    A component is first compared with one of its own, native and in parallel; who is similar to that one is connected. Only the rest is
    compared with all, in cells of about ``part`` shingles of either side, so a component of any size is spread over tasks.
    """
    sums = nodes.groupBy("component").agg(F.sum("size").alias("shingles"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("hub"))
    big = stable(sums.where(F.col("shingles") > part))
    n_big = big.count()
    rows = nodes.join(F.broadcast(big) if n_big <= 100_000 else big, "component", "left") if n_big else nodes.withColumn("hub", F.lit(None).cast("long"))
    role = lambda k: F.lit(k).cast("byte").alias("role")
    cells = rows.where("hub is null").select("node", "component", "hashes", F.lit(0).alias("i"), F.lit(0).alias("j"), role(3))
    direct = None
    if n_big:
        theirs = rows.where("hub is not null")
        hubs = theirs.where("node = hub").select("component", F.col("hashes").alias("hub_hashes"))
        met = theirs.join(hubs, "component")
        both = F.size(F.array_intersect("hashes", "hub_hashes"))
        near = (F.col("node") == F.col("hub")) | (both >= F.lit(similarity) * (F.size("hashes") + F.size("hub_hashes") - both) - 1e-9)
        met = stable(met.select("node", "component", "hub", "size", "shingles", "hashes", near.alias("near")))
        direct = met.where("near and node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"))
        # cells of the large components: all as homes, the rest as queries
        rest = met.groupBy("component").agg(F.sum(F.when(~F.col("near"), F.col("size"))).alias("left")).where("left > 0").select("component", F.ceil(F.col("left") / part).cast("int").alias("b"))
        far = met.join(rest, "component").withColumn("a", F.ceil(F.col("shingles") / part).cast("int"))
        cut = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")
        home = far.select("node", "component", "hashes", cut(F.col("a")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), role(1))
        query = far.where(~F.col("near")).select("node", "component", "hashes", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), cut(F.col("b")).alias("j"), role(2))
        cells = cells.unionByName(home).unionByName(query)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> pa.RecordBatch:
            u, v = _spanning([x.column("node") for x in held], [x.column("hashes") for x in held], [x.column("role") for x in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("component", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and key != tuple(keys[a]):
                        yield done()
                        held = []
                    key = tuple(keys[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()

    found = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node", "role").mapInArrow(lean(compare), "u long, v long")
    return found if direct is None else direct.unionByName(found)


def _spanning(nodes: list[pa.Array], sets: list[pa.ListArray], roles: list[pa.Array], similarity: float) -> tuple[list[int], list[int]]:
    """Verified links of one cell: queries are counted against an index of the homes; a query that its cell's first has reached already is skipped."""
    node, role = (np.concatenate([x.to_numpy() for x in xs]) for xs in (nodes, roles))
    size = np.concatenate([np.diff(x.offsets.to_numpy()) for x in sets]).astype(np.int64)
    flat, cuts = np.concatenate([np.asarray(x.flatten()) for x in sets]), np.concatenate([[0], np.cumsum(size)])
    homes, queries = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(homes) or not len(queries) or len(node) < 2:
        return [], []
    owner = np.repeat(np.arange(len(node), dtype=np.int32), size)
    at_home = np.flatnonzero((role[owner] & 1) > 0)
    at_home = at_home[np.argsort(flat[at_home], kind="stable")]
    index, owner = flat[at_home], owner[at_home]
    forest, us, vs = Forest(len(node)), [], []
    alone = bool((role == 3).all())  # homes and queries are the same
    for q in queries:
        if alone and q != queries[0] and forest.find(np.array([q]))[0] == forest.find(queries[:1])[0]:
            continue  # links to the first one's group are found from the other side
        own = flat[cuts[q] : cuts[q + 1]]
        lo, hi = np.searchsorted(index, own), np.searchsorted(index, own, "right")
        n = hi - lo
        take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[take], minlength=len(node))
        hit = np.flatnonzero((both >= similarity * (size[q] + size - both) - 1e-9) & (both > 0) & (node != node[q]))
        for j in hit.tolist():
            if forest.join(int(q), j):
                us.append(min(int(node[q]), int(node[j])))
                vs.append(max(int(node[q]), int(node[j])))
    return us, vs


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, radius: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """``(id, name, key)`` of every row, and ``(key, component, group_id)`` of every word sequence; both stable. Everything else that was written on the way is deleted."""

    def sketch(batches):
        for batch in slices(batches, "t"):
            keys, fps, sizes, sets = [], [], [], []
            for text in as_bytes(batch.column("t")):
                u = np.unique(shingle_hashes(text, words))
                keys.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
                fps.append(np.uint64(fingerprint(u)).view(np.int64))
                sizes.append(len(u))
                sets.append(u.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("name"), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "name", "key", "fp", "size", "hashes"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), row_name(F.col(id_col), F.col(text_col)).alias("name"), F.col(text_col).cast("string").alias("t"))
    with clearing(docs.sparkSession) as keep:
        rows = source.mapInArrow(lean(sketch), "id long, name string, key binary, fp long, size long, hashes array<long>")
        rows = stable(rows.withColumn("node", F.monotonically_increasing_id()))  # a number of each row's own, as ids may repeat
        # a text is known by its first row
        same = keep(rows.groupBy("key").agg(F.min("node").alias("node"), F.min("id").alias("rep")))
        texts = rows.where("size > 0").select("node", "fp", "size", "hashes")
        prints = stable(texts.groupBy("fp").agg(F.min("node").alias("id")))
        alike = texts.select("fp", "node").join(prints, "fp").where("node <> id").select(F.col("id").alias("u"), F.col("node").alias("v"))
        tree = near_links(prints.select("id", F.array("fp").alias("fp")), radius)
        maybe = components(prefix_links(texts, similarity, bits).unionByName(alike).unionByName(tree))
        # of rows with the same text one goes on, and only if another text may be like it
        maybe = stable(maybe.join(same.select("node"), "node", "left_semi"))
        several = maybe.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        maybe = stable(maybe.join(several, "component", "left_semi"))
        linked = keep(texts.select("node", "size", "hashes").join(F.broadcast(maybe) if maybe.count() <= 500_000 else maybe, "node"))
        slim = keep(rows.select("id", "name", "key"))
    with clearing(docs.sparkSession) as keep:
        comp = components(similar_links(linked, similarity))
        named = same.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        lowest = named.groupBy("component").agg(F.min("rep").alias("group_id"))
        return slim, keep(named.join(lowest, "component").select("key", "component", "group_id"))


def row_name(doc_id: Column, text: Column) -> Column:
    """A row by its id and text: rows of one name are equal but for other columns."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3, bits: int = 25) -> DataFrame:
    """``(doc_id, group_id)`` for every row; rows belong together if their word sequences are equal (A-Z as a-z), or along chains of texts with a
    Jaccard similarity of at least ``similarity`` over the sets of their shingles of ``words`` words.

    Candidates are texts whose SimHashes lie within ``radius`` bits, found in the vantage-point tree, and, as a SimHash can be further off, texts that
    share a rare shingle of their prefixes (``prefix_links``), which a similar pair escapes with odds of about 2 in a million, and none of under 32 shingles; with ``bits`` 64 none escapes, at the cost of more candidates. The sets, hashes of 64 bits, decide on every link. Null, empty and
    blank texts are one group. The smallest id names a group, null if it has only null ids; texts of any length are taken whole; rows that
    repeat stay rows; other columns are not read, an empty table gives an empty one.
    """
    rows, named = _grouped(docs, id_col, text_col, words, similarity, radius, bits)
    return rows.select("id", "key").join(named, "key").select(F.col("id").alias("doc_id"), "group_id")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3, bits: int = 25) -> DataFrame:
    """``docs`` with one row of each group of ``duplicate_groups``: that of the smallest id, null last; of several texts under this id the first by hash, and of
    rows repeated with id and text any one."""
    rows, named = _grouped(docs, id_col, text_col, words, similarity, radius, bits)
    by = rows.groupBy("name").agg(F.first("id").alias("id"), F.first("key").alias("key"), F.count("*").alias("n")).join(named.select("key", "component"), "key")
    by = stable(by)
    stay = by.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name"))["name"].alias("stay"))
    by = stable(by.join(stay, "component").select("name", (F.col("name") == F.col("stay")).alias("stays"), "n"))
    name = row_name(F.col(id_col), F.col(text_col))
    out = without(docs, name, by.where("not stays").select("name"))
    again = by.where("stays and n > 1").select("name")
    if again.count() == 0:
        return out
    column = free_name(docs.columns, "_name")
    once = out.withColumn(column, name).join(again.withColumnRenamed("name", column), column, "left_semi").dropDuplicates([column]).drop(column)
    return without(out, name, again).unionByName(once)
