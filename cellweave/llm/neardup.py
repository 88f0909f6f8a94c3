"""MinHash near-dedup (operator 4) with tensored banding and exact verification.

A document is the set of its distinct word shingles (A-Z lower-cased words). Two collections, A and
B, of ``tables`` band hashes each are computed, a band hash of ``rows`` minhashes. A table key joins
band i of A with band j of B: 2 * tables * rows minhashes serve tables ** 2 tables of 2 * rows
minhashes. A pair of similarity s meets in some table with probability (1 - (1 - s^rows)^tables)^2,
0.9999 at the threshold 0.8 for the default of 14 bands of 3.

The work, in order:

1. Documents with equal sets fall into one class under its smallest id; only classes go on.
2. A key (i, j) can only be shared by classes that share band i and band j. Bands that a class
   shares with no other are dropped first, so a class without near copies makes few keys or none.
3. A round: every key elects a leader (by another order, if there are more rounds) and every class proposes one
   link, to the leader it meets most among those of other components. Proposals are verified on the
   full sets and the components updated; keys whose classes are all in one component are done. So a
   group of copies costs a link a member and not a pair of members.
4. For keys that still join several components the remaining links are found by the edits of each
   set against a core, and verified (see ``settled``); no pair is left out for the size of its group.

Links follow 100 * intersection >= 100 * threshold * union on full 64-bit shingle sets.

Defined cases: texts without words (null, empty) have empty sets and link with nothing; fewer words
than a shingle make one shingle of them all; a row without id has no component and stays; rows that
repeat an id are judged by their own text, and an id that stands for several texts joins their
components; extra columns play no part; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, raw_texts, stored, window_hashes, word_hashes

TABLES, ROWS = 14, 3
ROUNDS = 1
#: Classes of partners in ``settled`` have lacks within this part of their size.
STEPS = 36
#: Keys that the rows of a bunch are dealt out over.
SPREAD = 16


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    _, _, words = word_hashes(raw.lower())
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else np.empty(0, dtype=np.uint64)


def text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n, None], base[n:, None] | np.uint64(1)


def bands(hashes: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """2 * tables band hashes: the first half is collection A, the second B."""
    flips, factors = seeds(2 * tables * rows)
    least = np.full(len(flips), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[None, at : at + 4096] ^ flips) * factors).min(axis=1), out=least)
    out = np.arange(1, 2 * tables + 1, dtype=np.uint64)
    for row in least.reshape(2 * tables, rows).T:
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + row)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def described(docs: DataFrame, width: int, tables: int, rows: int) -> DataFrame:
    """(doc_id, n, c1, c2, t, bands): set size, 128-bit hash of the set, hash of the text and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, whole, sketches = [], [], [], []
            for raw in raw_texts(batch):
                own = shingles(raw, width)
                sizes.append(len(own))
                sums.append(xxhash.xxh3_128_digest(own.tobytes()))
                whole.append(text_hash(raw))
                sketches.append(bands(own, tables, rows).tobytes() if len(own) else None)
            keys = np.frombuffer(b"".join(sums), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(whole, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "n", "c1", "c2", "t", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, c1 long, c2 long, t long, bands binary")


def table_keys(classes: DataFrame, tables: int) -> DataFrame:
    """(key, rep) of the tensored tables, for bands that some other class shares."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype="<i8")
                rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), 2 * tables)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(rep), pa.array(np.tile(np.arange(2 * tables, dtype=np.int32), batch.num_rows))], ["half", "rep", "i"])

    rows = stored(classes.select("rep", "bands").mapInArrow(halves, "half long, rep long, i int"), "near-halves")
    shared = rows.groupBy("half").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("half")
    masks = rows.join(shared, "half").groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))

    def tensored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype="<u8").reshape(-1, 2 * tables)
                has = (part.column("mask").to_numpy()[:, None] >> np.arange(2 * tables)) & 1 == 1
                keys = mix64(every[:, :tables, None] * np.uint64(0x9FB21C651E98DF25) + every[:, None, tables:])
                doc, i, j = np.nonzero(has[:, :tables, None] & has[:, None, tables:])
                yield pa.RecordBatch.from_arrays([pa.array(keys[doc, i, j].view(np.int64)), pa.array(part.column("rep").to_numpy()[doc])], ["key", "rep"])

    return classes.select("rep", "bands").join(masks, "rep").mapInArrow(tensored, "key long, rep long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for nodes with an edge (a, b).

    Alternating large-star and small-star steps until the edges are stars; each step is two joins and
    its result is written, so lineage stays short and no task holds a node's neighbours.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", narrow=True)
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(down, "u")
        small = pairs.select("u", F.col("m").alias("v")).unionByName(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = stored(small, "links", narrow=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no node has edges both ways: labels are final."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def measured(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, na, nb, common): set sizes and exact intersection of each pair. texts: (rep, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, held = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            sizes = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for i, (one, two) in enumerate(zip(batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist(), strict=True)):
                if last != two:
                    last, held = two, shingles(unpack(two), width)
                own = shingles(unpack(one), width)
                sizes[i] = len(own), len(held), len(np.intersect1d(own, held, assume_unique=True))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c) for c in sizes.T)], ["a", "b", "na", "nb", "common"])

    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("packed_a")), "a")
    both = one.join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("packed_b")), "b")
    return both.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long, na long, nb long, common long")


def alike(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full sets are similar."""
    return measured(pairs, texts, width).where(alike(percent)).select("a", "b").distinct()


def by_bunch(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the facts of their bunch (one row a bunch); a bunch's rows are dealt out over SPREAD keys."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SPREAD)).cast("int")).join(salted, ["bunch", "salt"], how).drop("salt")


def member_shingles(members: DataFrame, width: int) -> DataFrame:
    """(bunch, size, s): a row for each shingle of each set of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingles(unpack(p), width).view(np.int64) for p in part.column("packed").to_pylist()]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([part.column("bunch").take(rows), part.column("size").take(rows), pa.array(np.concatenate(sets))], ["bunch", "size", "s"])

    return members.select("bunch", "size", "packed").mapInArrow(run, "bunch long, size long, s long")


def member_edits(members: DataFrame, width: int) -> DataFrame:
    """(bunch, rep, t, n, edits): set size and symmetric difference with the core of the bunch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, edits = [], []
                for packed, core in zip(part.column("packed").to_pylist(), part.column("core"), strict=True):
                    own = shingles(unpack(packed), width).view(np.int64)
                    sizes.append(len(own))
                    edits.append(np.setxor1d(own, core.values.to_numpy() if core.is_valid else own[:0], assume_unique=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("bunch", "rep", "t")), pa.array(sizes, pa.int64()), pa.array(edits, pa.list_(pa.int64()))], ["bunch", "rep", "t", "n", "edits"])

    return members.select("bunch", "rep", "t", "packed", "core").mapInArrow(run, "bunch long, rep long, t long, n long, edits array<long>")


def class_hashes(bunch: int, bands: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return mix64(mix64(mix64(np.full(len(bands), bunch).view(np.uint64)) + bands.view(np.uint64)) + steps.view(np.uint64))


def prefix_keys(members: DataFrame, whole: int) -> DataFrame:
    """(m, looks, rep, label): under m stand a pair of classes and one of the rarest edits that a member
    must share with a partner of the other class. Members that are away look for partners."""
    fields = ("band", "step", "low", "top", "away")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            found: list[tuple[np.ndarray, bool, int, int]] = []
            size = 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("bunch", "rep", "label", "lack", "band", "step", "away")), batch.column("own"), batch.column("classes"), strict=True)
            for bunch, rep, label, lack, band, step, away, own, classes in rows:
                if bunch not in tables:
                    if len(tables) > 1000:
                        tables.clear()
                    table = np.array([[c[k] for k in fields] for c in classes.as_py()], dtype=np.int64).T
                    tables[bunch] = (*table, class_hashes(bunch, np.ascontiguousarray(table[0]), np.ascontiguousarray(table[1])))
                bands, steps, low, top, some_away, hashes = tables[bunch]
                own = own.values.to_numpy().view(np.uint64)
                need = np.maximum(1, -((-lack - low) // (2 * whole)))
                fits = (need <= np.minimum(len(own), top)) & (np.abs(bands - band) <= 1)
                here = hashes[(bands == band) & (steps == step)]
                for looks in (True, False) if away else (False,):
                    at = np.flatnonzero(fits if looks else fits & (some_away == 1))
                    if len(at):
                        lengths = len(own) - need[at] + 1
                        pair = here * np.uint64(3) + hashes[at] if looks else hashes[at] * np.uint64(3) + here
                        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                        found.append((mix64(own[place] ^ np.repeat(mix64(pair), lengths)), looks, rep, label))
                        size += len(place)
                if size > 200_000:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

    def batch_of(found: list[tuple[np.ndarray, bool, int, int]]) -> pa.RecordBatch:
        keys, *others = zip(*found, strict=True)
        lengths = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(np.array(c), lengths)) for c in others)], ["m", "looks", "rep", "label"])

    return members.select("bunch", "rep", "label", "lack", "band", "step", "away", "own", "classes").mapInArrow(run, "m long, looks boolean, rep long, label long")


def settled(open_: DataFrame, texts: DataFrame, edges: DataFrame, width: int, percent: int) -> DataFrame:
    """All links among classes that share an open key, without comparing each pair.

    open_: (key, rep, label, lead) of keys that still join several components. texts has a row a class; an
    id that is the smallest of several classes has each of its sets looked at for itself. Classes that are
    joined by open keys form bunches, so every pair in question is inside one. With the core C of a bunch,
    the shingles that more than half of its sets have, the edits of a set are its symmetric difference
    with C, and x and y differ by |X| + |Y| - 2 |X & Y| shingles, X and Y being their edits. They are
    linked if that is at most r (n_x + n_y) with r = (100 - percent) / (100 + percent). So with the
    lack of a set, |X| - r n_x, they are linked without any edit in common if their lacks sum to 0 or
    less, and otherwise need as many edits in common as half of that sum.

    The first kind is found by the set that lacks least, the heart of the bunch: whoever is so linked with
    anyone is so linked with the heart. For the second kind a pair must share one of the rarest edits
    of both, counting as many as the edits needed leave over (a prefix filter on edits); what is
    needed depends on both lacks, so sets are classed by size and lack, and the prefix is cut for
    each class of partners. Of two members in different components one at least is away from the
    heart's, so only those that are away look for partners. Candidates are verified.
    """
    bunches = components(open_.where(F.col("rep") != F.col("lead.rep")).select(F.col("rep").alias("a"), F.col("lead.rep").alias("b"))).withColumnsRenamed({"node": "rep", "label": "bunch"})
    members = stored(bunches.join(texts.select("rep", "t"), "rep"), "near-open", narrow=True)
    sizes = members.groupBy("bunch").agg(F.count(F.lit(1)).alias("size"))
    packed = stored(by_bunch(members, sizes).join(texts, ["rep", "t"]), "near-open")
    whole, part = 100 + percent, 100 - percent
    core = member_shingles(packed, width).groupBy("bunch", "size", "s").agg(F.count(F.lit(1)).alias("df")).where("2 * df > size")
    core = stored(core.groupBy("bunch").agg(F.sort_array(F.collect_list("s")).alias("core")), "near-open")
    found = stored(member_edits(by_bunch(packed, core, "left"), width).withColumn("lack", whole * F.size("edits") - part * F.col("n")), "near-edits")

    heart = stored(found.groupBy("bunch").agg(F.min_by("rep", F.struct("lack", "rep")).alias("heart"), F.min("lack").alias("least")), "near-open", narrow=True)
    known = stored(components(edges).withColumnRenamed("node", "rep"), "near-labels", narrow=True)
    near = by_bunch(found.select("bunch", "rep", "lack"), heart).where((F.col("lack") + F.col("least") <= 0) & (F.col("rep") != F.col("heart")))
    near = near.join(known, "rep", "left").join(known.withColumnsRenamed({"rep": "heart", "label": "home"}), "heart", "left")
    near = near.where(F.coalesce("label", "rep") != F.coalesce("home", "heart")).select(F.col("rep").alias("a"), F.col("heart").alias("b")).distinct()
    edges = edges.unionByName(stored(verified(near, texts, width, percent), "near-links"))
    labels = stored(components(edges).withColumnRenamed("node", "rep"), "near-labels", narrow=True)

    shared = found.select("bunch", "rep", "t", F.explode("edits").alias("s"))
    often = shared.groupBy("bunch", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = shared.join(often, ["bunch", "s"]).groupBy("rep", "t").agg(F.sort_array(F.collect_list(F.struct("df", "s")))["s"].alias("own"))
    home = heart.join(labels.withColumnRenamed("rep", "heart"), "heart", "left").select("bunch", F.coalesce("label", "heart").alias("home"))
    now = by_bunch(found.drop("edits").join(own, ["rep", "t"]).join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), home)
    # linked sets differ in size by a factor of 100 / percent at most, so by one band at most
    wide = max(1.25, (100 / percent) ** 2)
    band = F.floor(F.log("n") / math.log(wide))
    step = F.floor(F.col("lack") * STEPS / (whole * F.pow(F.lit(wide), "band")))
    now = now.withColumn("band", band).withColumn("step", step).withColumn("away", F.col("label") != F.col("home")).drop("home")
    now = stored(now, "near-open")
    classes = now.groupBy("bunch", "band", "step").agg(F.min("lack").alias("low"), F.max(F.size("own")).cast("long").alias("top"), F.max(F.col("away").cast("long")).alias("away"))
    classes = classes.groupBy("bunch").agg(F.collect_list(F.struct("band", "step", "low", "top", "away")).alias("classes"), F.max("away").alias("any"))
    keys = stored(prefix_keys(by_bunch(now, classes.where("any = 1").drop("any")), whole), "near-keys")
    looking = keys.where("looks").select("m", F.col("rep").alias("x"), F.col("label").alias("label_x"))
    looked = keys.where("not looks").select("m", F.col("rep").alias("y"), F.col("label").alias("label_y"))
    pairs = looking.join(looked, "m").where(F.col("label_x") != F.col("label_y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return edges.unionByName(verified(pairs, texts, width, percent))


def packed_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, t, packed): one compressed text a class, whatever rows repeat its id. classes: (rep, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raws = raw_texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_hash(raw) for raw in raws], pa.int64()), pa.array([pack(raw) for raw in raws], pa.binary())], ["rep", "t", "packed"])

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rep long, t long, packed binary")
    return small.join(classes, ["rep", "t"], "left_semi").groupBy("rep", "t").agg(F.first("packed").alias("packed"))


def link_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int, tables: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, label) of the classes that are linked with another."""
    keys = stored(table_keys(classes, tables), "near-keys")
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    texts, edges, labels = None, None, None
    for turn in range(rounds + 1):
        if labels is None:
            own = keys.select("key", "rep", F.col("rep").alias("label"))
        else:
            own = keys.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        order = F.xxhash64(F.lit(turn), "rep") if turn else F.col("rep")
        led = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("rep", "label"), order).alias("lead")).where("lo < hi")
        open_ = stored(own.join(led.select("key", "lead"), "key"), "near-open")
        keys = open_.select("key", "rep")
        if open_.isEmpty():
            break
        if texts is None:
            texts = stored(packed_texts(docs, classes.select("rep", "t").join(open_.select("rep").distinct(), "rep", "left_semi")), "near-texts")
        if turn < rounds:
            meets = open_.where(F.col("label") != F.col("lead.label")).groupBy("rep", F.col("lead.rep").alias("led")).agg(F.count(F.lit(1)).alias("n"))
            pairs = meets.groupBy(F.col("rep").alias("a")).agg(F.max_by("led", F.struct("n", -F.col("led"))).alias("b"))
            good = stored(verified(pairs, texts, width, percent), "near-links")
            edges = good if edges is None else edges.unionByName(good)
        else:
            edges = stored(settled(open_, texts, none if edges is None else edges, width, percent), "near-links")
        labels = components(edges)
    return labels if labels is not None else docs.sparkSession.createDataFrame([], "node long, label long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tables: int = TABLES, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    bounded_batches(docs.sparkSession)
    base = stored(described(docs, width, tables, rows), "near-documents")
    classes = base.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").cast("long").alias("rep"), F.first("bands").alias("bands"), F.min_by("t", "doc_id").alias("t"))
    classes = stored(classes, "near-classes")
    labels = link_classes(docs, classes, width, percent, tables, rounds)
    named = classes.select("c1", "c2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("label", "rep").alias("component_id"))
    full = base.where("n > 0 and doc_id is not null").select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", "n", "component_id")
    rest = base.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").cast("long").alias("component_id"))
    return full.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
