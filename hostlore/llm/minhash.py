"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. *Sketch.* Each distinct word shingle is hashed in rounds: round i throws it into one of t coordinates, and a coordinate
   keeps its smallest value of the first round that reached it. Rounds go on until every coordinate is filled; from
   round t on, round t + j throws everything into coordinate j, so all are filled for certain. Agreeing coordinates are as
   concentrated around the Jaccard similarity as t independent minima, at about the cost of one.
2. *Classes.* Documents with equal shingle sets meet by a fingerprint; only the smallest doc_id of a class goes on.
3. *Banding.* Coordinates in bands of ``ROWS`` give bucket keys. A similarity of 0.8 meets in one of the 32 buckets but
   for a chance of 5e-8.
4. *Verification.* A bucket never lists its pairs. First its smallest document is compared with each other one.
   Documents that are then in one component need no further comparison, so only buckets that still hold several
   components go on. There, each document outside the bucket's first component proposes its ``PARTNERS`` best partners in
   other components by sketch, each pair in the first bucket they share. Sizes and sketches drop hopeless pairs; whole
   texts decide. A document that had more partners than it could propose, and is still outside, is then compared with
   everything of the bucket on whole sets, in bounded tiles that give back only the links that join components.
5. *Components* come from minimum labels with pointer jumping, as joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import byte_list, join_weighted, mix64, releasing, table, text_groups, written

SHINGLE = 2
PERCENT = 80
COORDINATES = 128
ROWS = 4
#: Partners that a document proposes in a block of a bucket; where it has more, whole sets of all are compared.
PARTNERS = 4
#: Buckets are compared in blocks of about so many documents, and so many shingles.
BLOCK = 1000
BLOCK_SHINGLES = 1 << 20
#: Partners of a document that are compared with it in one group; with more, it has several groups and a copy of its text in each.
TOGETHER = 1 << 12
#: Columns of the incidence matrices that a tile multiplies at once.
COLUMNS = 2048
#: Pairs whose sketches agree less are dropped: four standard deviations under the threshold.
MARGIN = 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
TOP = np.uint64(56)


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; one for a text of fewer words, none without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, h.size - size + 1)
    out = np.full(n, np.uint64(min(size, h.size)))
    for k in range(min(size, h.size)):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each nonempty set. t is a power of two."""
    out = np.full((len(sets), t), EMPTY)
    flat = out.ravel()
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    shift = np.uint64(64 - int(t).bit_length() + 1)
    for i in range(2 * t):
        if not items.size:
            break
        x = mix64(items + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bin_ = (x >> shift).astype(np.int64) if i < t else np.full(x.size, i - t)
        value = np.uint64(min(i, 254)) << TOP | (x & ((np.uint64(1) << TOP) - np.uint64(1)))
        np.minimum.at(flat, owner * t + bin_, value)
        open_ = (out == EMPTY).any(axis=1)
        go = open_[owner]
        owner, items = owner[go], items[go]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of the bands of each sketch."""
    parts = sketch.reshape(len(sketch), sketch.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for k in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


SKETCHED = "doc_id long, n_shingles long, print binary, sketch binary, bands array<long>"


def sketch_documents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Set size, fingerprint of the set, low bytes of the sketch and bucket keys of each row."""

    @releasing
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 1, 1 << 20):
            sets = [shingle_set(t, size) for t in texts]
            rows = sketches([s for s in sets if s.size])
            full = [s.size > 0 for s in sets]
            bands, low = iter(band_keys(rows)), iter((rows & np.uint64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([s.size for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in sets], pa.binary()),
                    pa.array([next(low).tobytes() if f else None for f in full], pa.binary()),
                    pa.array([next(bands) if f else None for f in full], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "print", "sketch", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, SKETCHED)


def agreeing(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity; ``known`` has doc_id, n_shingles, sketch.

    ``pairs`` is a written table, read three times. Any number of pairs may have the same b: sketches of such are broadcast.
    """
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5

    @releasing
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(byte_list(batch.column(k))), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def own(side: str) -> DataFrame:
        return known.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))

    leaders = written(own("b").join(pairs.groupBy("b").agg(F.count("*").alias("n")), "b"), "leaders")
    pairs = join_weighted(pairs, leaders, "b", "n").join(own("a"), "a")
    fit = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return fit.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long")


TILE = ["band", "block", "ask_block"]


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles out of batches that are sorted by tile; a tile may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        tile = np.stack([rows.column(k).to_numpy() for k in TILE])
        cut = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1).tolist()]
        yield from (rows.slice(lo, hi - lo) for lo, hi in zip(cut[:-1], cut[1:], strict=True))
        held = rows.slice(cut[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def proposals(live: DataFrame, known: DataFrame, percent: int, partners: int) -> DataFrame:
    """The best ``partners`` of each asking document in each block of its buckets: (band, block, ask_block, ask, other, more).

    A tile is one block of targets and one of asking documents, so about two ``BLOCK`` rows whatever the bucket. Asking
    documents fill as many blocks as their share of the bucket needs: where m of n ask, about 2mn / ``BLOCK`` rows are made.
    ``live``: (band, nth, doc_id, label, asks, blocks): the bucket, the number of its band, and into how many blocks it
    falls. ``more`` tells that a document had further ones.
    """
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5

    def tile(rows: pa.Table) -> pa.RecordBatch:
        asks, ids, labels, sizes = (rows.column(k).to_numpy() for k in ("asks", "doc_id", "label", "n_shingles"))
        nth = rows.column("nth")[0].as_py()
        sketch = np.frombuffer(b"".join(byte_list(rows.column("sketch"))), np.uint8).reshape(-1, COORDINATES)
        keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sketch), -1)
        ask, other, more, there = [], [], [], np.flatnonzero(~asks)
        for lo in range(0, len(me := np.flatnonzero(asks)), 128):
            own = me[lo : lo + 128]
            share = (sketch[own, None] == sketch[None, there]).mean(axis=2)
            fit = 100 * np.minimum(sizes[own, None], sizes[there]) >= percent * np.maximum(sizes[own, None], sizes[there])
            share[~fit | (labels[own, None] == labels[there]) | (share < least)] = 0
            u, v = np.nonzero(share)
            met = (keys[own[u], :nth] == keys[there[v], :nth]).any(axis=1)  # in the bucket of an earlier band
            share[u[met], v[met]] = 0
            for i in np.flatnonzero(share.any(axis=1)):
                best = np.argsort(-share[i], kind="stable")[: partners + 1]
                best = best[share[i, best] > 0]
                found = ids[there[best[:partners]]].tolist()
                ask += [int(ids[own[i]])] * len(found)
                other += found
                more += [best.size > partners] * len(found)
        place = [pa.array([rows.column(k)[0].as_py()] * len(ask), rows.schema.field(k).type) for k in TILE]
        return pa.RecordBatch.from_arrays(
            [*place, pa.array(ask, pa.int64()), pa.array(other, pa.int64()), pa.array(more, pa.bool_())], names=[*TILE, "ask", "other", "more"]
        )

    @releasing
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(tile, by_tile(batches))

    def placed(blocks: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    share = F.ceil(F.first("blocks") * F.count_if("asks") / F.count("*")).cast("int").alias("ask_blocks")
    asked = written(live.groupBy("band").agg(F.count("*").alias("n"), share).where("ask_blocks > 0"), "asked")
    live = join_weighted(live.select("band", "nth", "doc_id", "label", "asks", "blocks"), asked, "band", "n")
    targets = live.withColumns({"block": placed("blocks"), "asks": F.lit(False)}).withColumn("ask_block", every("ask_blocks"))
    asking = live.where("asks").withColumn("ask_block", placed("ask_blocks")).withColumn("block", every("blocks"))
    own = known.select("doc_id", "n_shingles", "sketch", "bands")
    rows = targets.unionByName(asking).join(own, "doc_id").select(*TILE, "nth", "asks", "doc_id", "label", "n_shingles", "sketch", "bands")
    return rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(propose, "band long, block int, ask_block int, ask long, other long, more boolean")


def set_links(mine: list[np.ndarray], theirs: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one set of each list with the similarity: intersections as products of incidence matrices."""
    size_m, size_t = (np.array([x.size for x in side], np.int64) for side in (mine, theirs))
    flat_m, flat_t = np.concatenate(mine), np.concatenate(theirs)
    shared = np.intersect1d(flat_m, flat_t)
    common = np.zeros((len(mine), len(theirs)), np.float32)

    def cells(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, flat), max(0, shared.size - 1))
        on = shared[at] == flat if shared.size else np.zeros(flat.size, bool)
        order = np.argsort(at[on], kind="stable")
        return np.repeat(np.arange(sizes.size), sizes)[on][order], at[on][order]

    (row_m, at_m), (row_t, at_t) = cells(flat_m, size_m), cells(flat_t, size_t)
    for lo in range(0, shared.size, COLUMNS):
        sides = []
        for row, at, n in ((row_m, at_m, len(mine)), (row_t, at_t, len(theirs))):
            a, b = np.searchsorted(at, (lo, lo + COLUMNS))
            side = np.zeros((n, COLUMNS), np.float32)
            side[row[a:b], at[a:b] - lo] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    common = common.astype(np.int64)
    return np.nonzero(100 * common >= percent * (size_m[:, None] + size_t - common))


def joining(labels: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of links between components, some that join all that they join: positions of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out, (_, first) = [], np.unique(np.stack([labels, others]), axis=1, return_index=True)
    for i in first.tolist():
        a, b = find(int(labels[i])), find(int(others[i]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(i)
    return np.array(out, np.int64)


def tile_links(asking: DataFrame, live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, from comparing whole sets of ``asking`` documents with a block of their bucket.

    ``asking``: (band, block, ask_block, doc_id), ``live``: (band, blocks, doc_id, label), ``sets``: (doc_id, items).
    A tile has about two blocks of documents and gives at most one link less than it has components.
    """

    @releasing
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_tile(batches):
            asks, ids, labels = (rows.column(k).to_numpy() for k in ("asks", "doc_id", "label"))
            items = [np.frombuffer(x, np.uint64) for x in byte_list(rows.column("items"))]
            me, there = np.flatnonzero(asks), np.flatnonzero(~asks)
            if me.size and there.size:
                u, v = set_links([items[i] for i in me], [items[i] for i in there], percent)
                u, v = me[u], there[v]
                apart = labels[u] != labels[v]
                u, v = u[apart], v[apart]
                keep = joining(labels[u], labels[v]) if u.size else u
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.maximum(ids[u[keep]], ids[v[keep]])), pa.array(np.minimum(ids[u[keep]], ids[v[keep]]))], names=["a", "b"]
                )

    place = live.select("band", "doc_id", "label", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    targets = place.join(asking.select(*TILE).distinct(), ["band", "block"]).withColumn("asks", F.lit(False))
    mine = asking.join(place.select("band", "doc_id", "label"), ["band", "doc_id"]).withColumn("asks", F.lit(True))
    columns = [*TILE, "asks", "doc_id", "label"]
    rows = targets.select(columns).unionByName(mine.select(columns)).join(sets, "doc_id").select(*columns, "items")
    return rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(compare, "a long, b long")


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, items): the shingle hashes of each row."""

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([shingle_set(t, size).tobytes() for t in texts], pa.binary())],
                names=["doc_id", "items"],
            )

    return texts.select("doc_id", "text").mapInArrow(cut, "doc_id long, items binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have the similarity. ``pairs`` is a written table, read three times.

    A group has one text of b, once and in front, and about ``TOGETHER`` of its partners at most, so a document may be the b
    of any number of pairs. Where a doc_id has several texts, one pair of them is enough.
    """

    @releasing
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for part, texts in text_groups(batches, 2):
            keep = []
            for a, text in zip(part.column("a").to_pylist(), texts, strict=True):
                items = shingle_set(text, size)
                if a is None:
                    own = items
                    keep.append(False)
                else:
                    common = np.intersect1d(items, own, assume_unique=True).size
                    keep.append(100 * common >= percent * (items.size + own.size - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    group = ["b", "version", "part"]
    parts = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int"))
    versions = texts.select(F.col("doc_id").alias("b"), F.xxhash64("text").alias("version"), "text")
    leaders = written(versions.drop("text").join(parts, "b").distinct(), "leaders")
    partners = join_weighted(pairs, leaders, "b", "n").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    partners = partners.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select(*group, "a", "text")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = versions.join(leaders, ["b", "version"]).select("b", "version", every.alias("part"), F.lit(None).cast("long").alias("a"), "text")
    rows = partners.unionByName(first).repartition(*group).sortWithinPartitions(*group, "a")
    return rows.select("a", "b", "text").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of an edge (a, b) reaches. A written table."""
    both = written(
        edges.select(F.col("a").alias("u"), F.col("b").alias("id")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("id"))
        ).where("u <> id"),
        "edges",
    )
    labels = written(
        both.groupBy(F.col("u").alias("id")).agg(F.min("id").alias("m"), F.count("*").alias("n")).select(
            "id", "n", F.least("id", "m").alias("label")
        ),
        "labels",
    )
    while True:
        near = join_weighted(both, labels, "id", "n").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("m"))
        now = written(labels.join(near, "id").select("id", "n", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")), "labels")
        if not now.where("moved").limit(1).count():
            return now.select("id", "label")
        labels = now.drop("moved")
        roots = labels.groupBy(F.col("label").alias("root")).agg(F.count("*").alias("k"))
        steps = written(
            roots.join(labels.select(F.col("id").alias("root"), F.col("label").alias("up")), "root").where("up < root").select(
                F.col("root").alias("label"), "up", "k"
            ),
            "jumps",
        )
        if steps.limit(1).count():
            jumped = join_weighted(labels, steps, "label", "k").select("id", F.col("up"))
            labels = written(labels.join(jumped, "id", "left").select("id", "n", F.coalesce("up", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, partners: int = PARTNERS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    A document's set is its distinct shingles of ``size`` words (A-Z in lower case, split at ASCII blanks), the whole
    sequence when there are fewer words. Links need an intersection of ``percent`` per cent of the union or more;
    ``component_id`` is the smallest doc_id reachable. Null and empty texts link with nothing. Rows that
    repeat a doc_id share its links; a null doc_id has a null component and is kept. Other columns are not read.
    """
    sketched = written(sketch_documents(docs, size), "sketches")
    known = sketched.where("doc_id is not null and print is not null")
    groups = written(known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    copies = written(
        join_weighted(known.select("doc_id", "print"), groups, "print", "n").where("doc_id <> rep").select(
            F.col("doc_id").alias("a"), F.col("rep").alias("b")
        ),
        "copy-links",
    )
    first = known.join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")

    rows = first.dropDuplicates(["doc_id", "print"]).select("doc_id", "n_shingles", F.posexplode("bands").alias("nth", "band"))
    buckets = written(rows.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(join_weighted(rows, buckets, "band", "n").select("band", "nth", "doc_id", "n_shingles", "leader"), "members")
    met = members.select("doc_id").distinct()
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(met, "doc_id", "left_semi"), "texts")
    known = written(first.dropDuplicates(["doc_id", "print"]).select("doc_id", "n_shingles", "sketch", "bands").join(met, "doc_id", "left_semi"), "known")

    def labelled(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components: (band, nth, doc_id, n_shingles, label, asks, blocks)."""
        of = members.join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left").select(
            "band", "nth", "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label")
        )
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        mixed = of.groupBy("band").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), blocks.alias("blocks")
        ).where("low < high")
        mixed = written(mixed.select("band", "low", "n", "blocks"), "mixed")
        return written(
            join_weighted(of, mixed, "band", "n").select(
                "band", "nth", "doc_id", "n_shingles", "label", (F.col("label") > F.col("low")).alias("asks"), "blocks"
            ),
            "live",
        )

    met_leaders = members.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = written(agreeing(written(met_leaders, "met"), known, percent), "pairs")
    links = copies.unionByName(written(verified(pairs, texts, percent, size), "links"))
    live = labelled(components(links))
    found = written(proposals(live, known, percent, partners), "proposals")
    ends = F.greatest("ask", "other").alias("a"), F.least("ask", "other").alias("b")
    fresh = found.select(*ends, "ask").groupBy("a", "b").agg(F.min("ask").alias("ask")).join(pairs, ["a", "b"], "left_anti")
    # many documents may propose the same one, which is then the b of their pairs
    fresh = written(fresh.select(F.col("ask").alias("a"), F.when(F.col("ask") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b")), "fresh")
    links = links.unionByName(written(verified(fresh, texts, percent, size), "links"))
    labels = components(links)
    # who could not propose all partners and is still outside the first component of the bucket
    cut_off = found.where("more").select("band", "block", F.col("ask").alias("doc_id")).distinct()
    if cut_off.limit(1).count():
        now = labelled(labels)
        outside = written(cut_off.join(now.where("asks").select("band", "doc_id", "n_shingles"), ["band", "doc_id"]), "outside")
        # fewer ask now than did propose, so they are placed anew; their whole sets bound a block too
        places = outside.groupBy("band", "block").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
        blocks = F.ceil(F.greatest(F.max("n") / BLOCK, F.max("items") / BLOCK_SHINGLES)).cast("int")
        places = written(places.groupBy("band").agg(F.sum("n").alias("n"), blocks.alias("blocks")), "places")
        ask_block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("ask_block")
        outside = join_weighted(outside, places, "band", "n").select("band", "block", ask_block, "doc_id")
        place = now.select("doc_id", "band", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
        wanted = place.join(outside.select("band", "block").distinct(), ["band", "block"]).select("doc_id").unionByName(outside.select("doc_id")).distinct()
        sets = written(whole_sets(texts.join(wanted, "doc_id", "left_semi"), size), "sets")
        labels = components(links.unionByName(written(tile_links(outside, now, sets, percent), "links")))
    out = sketched.select("doc_id", "n_shingles").join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 1, len(w))], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS lo FROM e UNION SELECT e.b, lo FROM reach JOIN e ON reach.id = e.a WHERE lo < e.b),
comp AS (SELECT id, min(lo) AS lo FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(lo, d.doc_id) AS component_id, coalesce(lo, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id
"""
