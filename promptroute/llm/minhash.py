"""Near duplicates by weighted Jaccard similarity of shingle multisets: BagMinHash, bands, exact check.

Texts of one multiset of shingles are one node, whatever their number.  Nodes that agree in a band of their
signatures share a bucket.  In a bucket, every node is first checked against a hub, which joins copies to their original
without looking at all pairs.  What is still apart in a bucket is then compared block by block, by signature and,
where that makes it likely, on the texts.  A link is only ever made by the exact similarity of two whole texts.

A null text is an empty text; empty texts are alike and like no other text.  A text of fewer than five words has one
shingle.  A null id is kept, and a class has the null id only if no member has another.  Repeated rows stay rows
of the result; an empty table gives an empty one.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.llm.components import components
from promptroute.llm.frames import arrow_schema, field, free, map_columns, texts
from promptroute.llm.shingles import mix, shingles
from promptroute.session import materialise

#: Least weighted Jaccard similarity of near duplicates.
SIMILARITY = 0.8
#: Bands of a signature and components of a band.  A pair at 0.8 is in no common bucket once in 2.5 million.
BANDS, ROWS = 28, 4
COMPONENTS = BANDS * ROWS
#: Share of agreeing components from which a pair is checked, over five deviations below ``SIMILARITY``: of pairs at 0.8
#: fewer have less than share no band.
LIKELY = 0.58
#: Nodes of a block in what is compared after the hubs.
BLOCK = 512


def signatures(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures of multisets (hashes, counts): a row of 16-bit components for each.

    An element of weight w owns a Poisson process over the weights [0, w), cut into the blocks [0, 1), [1, 2),
    [2, 4), [4, 8) ...; a block of size r has points at rate r.  A point in the last, partly owned block is placed among
    the block's unit weights by halving the block again and again, a bit of its hash for each halving, and
    counts if it falls below w.  So of two weights, the points of the smaller are among those of the
    larger.  A component is the id of the first point that falls to it, and two texts agree in it
    with the probability of their weighted Jaccard similarity.
    Points are drawn in ascending order and only up to a time by which each component should have one;
    the time is doubled for the few texts where one has none.
    """
    out = np.zeros((len(texts), COMPONENTS), np.uint16)
    totals = np.array([int(c.sum()) for _, c in texts])
    todo = np.flatnonzero(totals)
    limits = COMPONENTS * (np.log(COMPONENTS) + 4) / np.maximum(totals, 1)
    while len(todo):
        best = np.full(len(todo) * COMPONENTS, np.inf)
        times, places, ids = _points([texts[i] for i in todo], limits[todo])
        np.minimum.at(best, places, times)
        first = times == best[places]
        names = np.zeros(len(best), np.uint16)
        names[places[first]] = ids[first]
        full = np.isfinite(best).reshape(-1, COMPONENTS).all(axis=1)
        out[todo[full]] = names.reshape(-1, COMPONENTS)[full]
        todo = todo[~full]
        limits[todo] *= 2
    return out


def _points(texts: list, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, component (those of the i-th text follow after i times COMPONENTS) and id of all points in time."""
    hashes = np.concatenate([h for h, _ in texts])
    counts = np.concatenate([c for _, c in texts])
    owner = np.repeat(np.arange(len(texts)), [len(h) for h, _ in texts])
    seeds, owners, lows, owned, low, block = [hashes], [owner], [np.zeros(len(owner))], [counts], 1, 0
    while (more := counts > low).any():
        block += 1
        seeds.append(mix(hashes[more] + np.uint64(block)))
        owners.append(owner[more])
        lows.append(np.full(int(more.sum()), float(low)))
        owned.append(counts[more] - low)
        low *= 2
    seed, owner = np.concatenate(seeds), np.concatenate(owners)
    rate, own = np.maximum(np.concatenate(lows), 1), np.concatenate(owned)
    at, limit, step = np.zeros(len(seed)), limits[owner], np.uint64(0)
    found: list[tuple] = []
    while len(seed):
        step += np.uint64(1)
        drawn = mix(seed ^ mix(np.array([step]))[0])
        at = at - np.log(((drawn >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / rate
        early = np.flatnonzero(at <= limit)
        seed, owner, rate, own, at, limit = (x[early] for x in (seed, owner, rate, own, at, limit))
        drawn = mix(drawn[early])
        level = np.floor((drawn >> np.uint64(32)) * 2.0**-32 * rate)
        taken = np.flatnonzero(level < own)
        drawn = drawn[taken]
        place = ((drawn & np.uint64(0xFFFFFFFF)) % np.uint64(COMPONENTS)).astype(np.int64)
        ids = (mix(drawn + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)
        found.append((at[taken], owner[taken] * COMPONENTS + place, ids))
    return tuple(np.concatenate(x) for x in zip(*found))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets; of two empty ones 1."""
    both = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (both - shared) if both else 1.0


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, a hash of its text, a key of its shingle multiset, and its signature by bands."""
    rows = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
    )
    fields = [field("text_key", "binary"), field("bands", "array<long>")]

    def make():
        def sketch(batch):
            keys, bands = [], []
            sets: list = []

            def flush() -> None:
                packed = signatures(sets).view(np.int64) if sets else ()
                bands.extend(row.tolist() for row in packed)
                sets.clear()

            held = 0
            for value in texts(batch, "text"):
                sets.append(shingles(value))
                keys.append(content_key(*sets[-1]))
                held += len(sets[-1][0])
                if held > 300_000 or len(sets) >= 256:
                    flush()
                    held = 0
            flush()
            return [keys, bands]

        return sketch

    return map_columns(rows, fields, make).drop("text")


def content_key(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sixteen bytes that are equal for equal multisets."""
    if not len(hashes):
        return bytes(16)
    weights = counts.astype(np.uint64)
    sums = [mix(hashes + np.uint64(k)) for k in (1, 2)]
    return b"".join(int((mix(x * weights + weights)).sum()).to_bytes(8, "little") for x in sums)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``key``, ``text_hash`` (xxhash64 of the text), ``class_key``, ``class_id`` and ``class_size``.

    Rows are of one class if links join them: shingle multisets of a weighted Jaccard similarity of ``SIMILARITY``
    or more.  ``class_id`` is the smallest ``key`` of the class, ``class_key`` names it even if no member has one.
    """
    rows = materialise(_sketches(docs, key, text), "sketches")
    members = materialise(
        rows.groupBy("text_key", "bands").agg(F.min(F.struct("id", "text_hash")).alias("first")), "texts"
    )
    buckets = _buckets(members)
    if buckets.isEmpty():
        roots = buckets.select(F.col("node"), F.col("node").alias("root"))
    else:
        roots = _roots(docs, key, text, members, buckets)
    classed = rows.select("id", "text_hash", "text_key").join(
        roots.select(F.col("node").alias("text_key"), "root"), "text_key", "left"
    ).select("id", "text_hash", F.coalesce("root", "text_key").alias("root"))
    classed = materialise(classed, "classed")
    classes = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return classed.join(classes, "root").select(
        F.col("id").alias(key), "text_hash", F.col("root").alias("class_key"), "class_id", "class_size"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of near duplicates, as it is: the one with the smallest ``key``.

    Of rows that are equal in key and text, any one stays.
    """
    found = near_duplicates(docs, key, text)
    first = found.groupBy("class_key").agg(F.min(F.struct(key, "text_hash")).alias("one"))
    row, hash_ = free(docs, "_row", "_hash")
    stays = first.select(F.xxhash64(f"one.{key}", "one.text_hash").alias(row), F.col("one.text_hash").alias(hash_))
    hashed = docs.withColumn(hash_, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    hashed = hashed.withColumn(row, F.xxhash64(F.col(key), F.col(hash_)))
    kept = hashed.join(stays, [row, hash_], "left_semi").dropDuplicates([row, hash_])
    return kept.select(*docs.columns)


def _buckets(members: DataFrame) -> DataFrame:
    """``bucket``, ``band``, ``n`` (texts) and ``node`` of all buckets with several; of those with the same texts the first."""
    rows = members.select(
        F.col("text_key").alias("node"), F.posexplode("bands").alias("band", "value")
    ).select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    several = rows.groupBy("bucket", "band").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node") % 1_000_003).alias("s")
    ).where("n > 1")
    once = several.groupBy("n", "x", "s").agg(F.min(F.struct("band", "bucket"))["bucket"].alias("bucket"))
    return materialise(rows.join(once.select("bucket", "n"), "bucket"), "buckets")


def _roots(docs: DataFrame, key: str, text: str, members: DataFrame, buckets: DataFrame) -> DataFrame:
    """The smallest node of the class of every node that is linked to another."""
    # Hubs are texts in many and large buckets, as the original of many copies is.
    weight = buckets.groupBy("node").agg(F.sum("n").alias("weight"))
    nodes = materialise(
        weight.join(members, F.col("node") == F.col("text_key")).select("node", "weight", "first", "bands"), "nodes"
    )
    contents = materialise(_contents(docs, key, text, nodes), "contents")
    links = materialise(_verified(_hub_pairs(buckets, nodes), contents), "links")
    roots = None if links.isEmpty() else components(links)
    found = materialise(_rest_links(buckets, nodes, contents, roots), "links")
    if not found.isEmpty():
        roots = components(links.union(found))
    return buckets.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def _contents(docs: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """The text of every node, from one row that has it."""
    wanted = nodes.select("node", F.col("first.id").alias("id"), F.col("first.text_hash").alias("h"))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.xxhash64("_text") == F.col("h"))
    return rows.join(wanted, same).select("node", F.col("_text").alias("text")).dropDuplicates(["node"])


def _hub_pairs(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each text with the hub that it shares most buckets with; a bucket's hub is its weightiest text."""
    ranked = buckets.join(nodes.select("node", "weight"), "node")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("hub"))
    pairs = buckets.join(hubs, "bucket").where(F.col("node") != F.col("hub.node"))
    shared = pairs.groupBy(F.col("node").alias("a"), "hub").agg(F.count("*").alias("shared"))
    best = shared.groupBy("a").agg(F.max(F.struct("shared", "hub")).alias("best"))
    return best.select("a", F.col("best.hub.node").alias("b"))


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs whose texts are similar indeed."""
    both = pairs.join(contents.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        contents.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        known: dict[bytes, tuple] = {}

        def of(node: bytes, value: str) -> tuple:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingles(value)
            return known[node]

        def check(batch):
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            return [[similarity(of(a, x), of(b, y)) for a, b, x, y in zip(*columns)]]

        return check

    judged = map_columns(both, [field("similarity", "double")], make)
    return judged.where(F.col("similarity") >= SIMILARITY).select("a", "b")


def _rest_links(
    buckets: DataFrame, nodes: DataFrame, contents: DataFrame, roots: DataFrame | None
) -> DataFrame:
    """Links between texts that share a bucket but no class yet.

    Of a bucket, the texts outside its largest class are compared with all its texts, block by block: by
    signature first, and on the texts where they are likely to be similar.  A pair is looked at in the first band that it
    shares.  A text needs one link to a class, so no more than that leave a task.
    """
    rows = buckets
    if roots is not None:
        rows = rows.join(roots, "node", "left")
    root = F.col("node") if roots is None else F.coalesce("root", "node")
    rows = rows.withColumn("root", root)
    classes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("bucket").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("classes"),
        F.sum("n").alias("size"), F.max("n").alias("most"),
    ).where("classes > 1").select(
        "bucket", "main", F.ceil(F.col("size") / BLOCK).alias("blocks"),
        F.ceil((F.col("size") - F.col("most")) / BLOCK).alias("queries"))
    held = nodes.select("node", "bands").join(contents, "node")
    rows = rows.join(mixed, "bucket").join(held, "node")
    shown = ["bucket", "band", "node", "root", "bands", "text"]
    everyone = rows.select(
        *shown, F.pmod(F.xxhash64("node"), F.col("blocks")).alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("i"), F.lit(False).alias("asks"))
    asking = rows.where(F.col("root") != F.col("main")).select(
        *shown, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("queries")).alias("i"), F.lit(True).alias("asks"))
    kinds = arrow_schema("a binary, b binary")

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        asks, band = cell.column("asks").to_numpy(), cell.column("band")[0].as_py()
        bands = np.stack(cell.column("bands").to_numpy())
        parts = bands.view(np.uint16)
        node, text = cell.column("node").to_pylist(), cell.column("text")
        numbers = {r: k for k, r in enumerate(set(cell.column("root").to_pylist()))}
        root = np.array([numbers[r] for r in cell.column("root").to_pylist()])
        known: dict[bytes, tuple] = {}

        def of(k: int) -> tuple:
            if node[k] not in known:
                known[node[k]] = shingles(text[k].as_py())
            return known[node[k]]

        everyone, a, b = np.flatnonzero(~asks), [], []
        for q in np.flatnonzero(asks).tolist():
            other = everyone[root[everyone] != root[q]]
            other = other[(bands[other] == bands[q]).argmax(axis=1) == band]
            agreed = (parts[other] == parts[q]).sum(axis=1)
            likely = np.flatnonzero(agreed >= LIKELY * COMPONENTS)
            met: set[int] = set()
            for k in other[likely[np.argsort(-agreed[likely], kind="stable")]].tolist():
                if root[k] not in met and similarity(of(q), of(k)) >= SIMILARITY:
                    met.add(root[k])
                    a.append(node[q])
                    b.append(node[k])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=kinds)

    cells = everyone.unionByName(asking)
    return cells.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")
