"""N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one class. Two sets that link must share one of their rarest
shingles: of a set's shingles, rarest first, so many at the front that a partner can't lack them all.
Those are a class's signatures; shingles that no other class has come first of all, so a set with too
many of them signs nothing. Classes that share a signature are partitioned into groups of similar
documents around hubs; the matrix holds each group's token union. A query is bounded by its overlap
with the union, and only groups that qualify are opened and verified.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, small_batches, table, thrifty
from .components import connected_components
from .shared import Dealing, chunk_of, dealing, mix, on_files, packed, parts_in, shared_among, slot_of, unpacked, write_shared

U = np.uint64
#: Members of a group.
GROUP = 128


class Shingler:
    """Distinct shingles of texts, hashed to 64 bits and sorted. Remembers no words: hashing one takes less than looking it up among very many."""

    def __init__(self, words: int) -> None:
        self.words = words

    def many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        own = [(t or b"").lower().split() for t in texts]
        h = np.fromiter((xxhash.xxh64_intdigest(w) for ws in own for w in ws), U, sum(map(len, own)))
        k, none, out, at = self.words, np.zeros(0, U), [], 0
        runs = np.full(max(0, len(h) - k + 1), k, U)
        for j in range(k):
            runs = mix(runs * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]) if len(runs) else runs
        for ws in own:
            n = len(ws)
            if n >= k:
                made = np.sort(runs[at : at + n - k + 1])
                out.append(made[np.concatenate([[True], made[1:] != made[:-1]])])
            elif n:
                whole = np.full(1, n, U)
                for j in range(n):
                    whole = mix(whole * U(0x9E3779B97F4A7C15) + h[at + j : at + j + 1])
                out.append(whole)
            else:
                out.append(none)
            at += n
        return out

    def __call__(self, text: bytes | None) -> np.ndarray:
        return self.many([text])[0]


def size_classes(least: int, most: int = 1 << 40) -> list[int]:
    """Where the classes of set sizes begin; the first holds the sizes that link with equal sets only."""
    start = 100 // (100 - least) if least < 100 else most
    out = [1]
    while start < most:
        out.append(start)
        start = max(start + 1, math.ceil(start * 2**0.5))
    return out


def signatures(tokens: np.ndarray, full: int, rare: int, least: int, sizes: list[int]) -> np.ndarray:
    """Signatures of a set of `full` shingles from those that others share, rarest first; `rare` more are its own.

    A partner has `least` percent of the set's shingles, so it shares one of the first
    full - ceil(least * full / 100) + 1 of them, its own included. A signature holds the class of sizes
    too: a set signs for its own class, and for the next if it can link with the smallest set there.
    """
    front = tokens[: max(0, full - -(-least * full // 100) + 1 - rare)]
    k = int(np.searchsorted(sizes, full, "right")) - 1
    classes = [k] * (k > 0) + [k + 1] * (100 * full >= least * sizes[k + 1])
    return np.concatenate([mix(front ^ mix(np.full(1, c, U))) for c in classes]) if classes else front[:0]


def long_of(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def class_key(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(shingles.tobytes(), seed)
    return int(np.array(h >> 64, U).view(np.int64)), int(np.array(h & (1 << 64) - 1, U).view(np.int64))


def texts_in(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, list, list, list]]:
    """(chunk, slot, ids, hashes, texts) of a part of a chunk."""
    for chunk, slot, (ids, of, texts) in parts_in(batches, most):
        yield chunk, slot, ids, of, texts


def classify(rows: DataFrame, words: int, least: int, seed: int, deal: Dealing) -> DataFrame:
    """doc_id, of, n_shingles, cls, check, signs: cls is the class of the shingle set, null for an empty one; signs are its signatures.

    A first pass finds the shingles that two classes have, and how common each is.
    """
    sizes, buckets = size_classes(least), deal.buckets

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        shingle = Shingler(words)
        for chunk, slot, _, _, texts in texts_in(batches, deal.part):
            sets = shingle.many(texts)
            keys = np.array([class_key(s, seed)[0] if len(s) else 0 for s in sets], np.int64)
            yield chunk, slot, np.concatenate(sets), np.repeat(keys, [len(s) for s in sets])

    side = write_shared(rows, owned, buckets, buckets, "shared-shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for chunk, slot, ids, of, texts in texts_in(batches, deal.part):
            sets = shingle.many(texts)
            keys = [class_key(s, seed) if len(s) else (None, None) for s in sets]
            full = np.array([len(s) for s in sets])
            flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), full)
            some, level = shared_among(side, slot, chunk, flat, buckets)
            order = np.lexsort((flat[some], level, row[some]))
            tokens = flat[some[order]]
            cut = np.searchsorted(row[some], np.arange(len(sets) + 1))
            made = [signatures(tokens[cut[i] : cut[i + 1]], int(full[i]), int(full[i] - cut[i + 1] + cut[i]), least, sizes) for i in range(len(sets))]
            ends = np.cumsum([0, *map(len, made)])
            signs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), long_of(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(of, pa.int64()), pa.array(full, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), signs], names=["doc_id", "of", "n_shingles", "cls", "check", "signs"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(thrifty(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, of long, n_shingles long, cls long, check long, signs array<long>")


def repeated_signs(known: DataFrame) -> DataFrame:
    """sign, cls: distinct within a chunk of the classified rows, for signatures that two classes have, or few more. Those of one class alone never become rows."""
    deal = dealing(known)
    buckets = slots = deal.buckets
    rows = known.where("size(signs) > 0").select("cls", "signs", chunk_of(max(deal.rows, 4096)).alias("chunk")).withColumn("slot", slot_of("chunk", slots))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for batch in batches:
            chunk, slot, cls = (batch.column(c).to_numpy() for c in ("chunk", "slot", "cls"))
            signs = batch.column("signs")
            flat, count = signs.flatten().to_numpy(zero_copy_only=False).view(U), signs.value_lengths().to_numpy()
            owner, of = np.repeat(cls, count), np.repeat(chunk, count)
            for c in dict.fromkeys(chunk.tolist()):
                mine = of == c
                yield c, int(slot[np.flatnonzero(chunk == c)[0]]), flat[mine], owner[mine]

    side = write_shared(rows, chunks, buckets, slots, "shared-signs")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slot, sign, owner in chunks(batches):
            some = shared_among(side, slot, chunk, sign, buckets)[0]
            pairs = np.unique(np.stack([sign[some].view(np.int64), owner[some]]), axis=1) if len(some) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["sign", "cls"])

    return rows.mapInArrow(thrifty(pick), "sign long, cls long").distinct()


def overlap_links(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


class Sets:
    """Shingle sets of classes by key, the last few kept."""

    def __init__(self, words: int, most: int = 64) -> None:
        self.shingle, self.most, self.kept = Shingler(words), most, OrderedDict()

    def get(self, key: int, text: bytes) -> np.ndarray:
        if key not in self.kept:
            self.kept[key] = self.shingle(text)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[key]


def verify_stars(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """Of pairs (cls, hub), those that link, as edges (a, b)."""
    with_hub = pairs.join(texts.withColumnRenamed("text", "text_a"), "cls").join(texts.select(F.col("cls").alias("hub"), F.col("text").alias("text_b")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs, shingle = Sets(words), Shingler(words)
        for batch in batches:
            a, b = batch.column("cls").to_pylist(), batch.column("hub").to_pylist()
            tb = batch.column("text_b").cast(pa.binary())
            own = shingle.many(batch.column("text_a").cast(pa.binary()).to_pylist())
            ok = [overlap_links(own[i], hubs.get(b[i], tb[i].as_py()), least) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, ok, strict=True) if k], pa.int64()), pa.array([x for x, k in zip(b, ok, strict=True) if k], pa.int64())], names=["a", "b"])

    return with_hub.select("cls", "hub", "text_a", "text_b").mapInArrow(thrifty(run), "a long, b long")


class Group:
    """A group's row of the token-group matrix, and its members once it is opened."""

    def __init__(self, classes: list[int], sets: list[np.ndarray]) -> None:
        self.classes, self.flat = np.array(classes, np.int64), np.concatenate(sets)
        self.lengths = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.union = np.unique(self.flat)

    def linked(self, own: np.ndarray, least: int) -> np.ndarray:
        """Classes of the members that link with a set; none if the set's overlap with the union is too small for any."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        if 100 * int((self.union[at] == own).sum()) < least * len(own):
            return self.classes[:0]
        at = np.minimum(np.searchsorted(own, self.flat), len(own) - 1)
        both = np.add.reduceat((own[at] == self.flat).astype(np.int64), self.starts)
        return self.classes[100 * both >= least * (len(own) + self.lengths - both)]


def shingle_prints(texts: DataFrame, words: int) -> DataFrame:
    """cls, prints from (cls, text): the upper halves of the shingles' hashes, in rising order and packed. Two shingles with one half count as two that overlap, so a bound made of them never falls short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = shingle.many(batch.column("text").cast(pa.binary()).to_pylist())
            prints = [(s >> U(32)).astype(np.uint32) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([packed(p, np.zeros(len(p), np.uint8)) for p in prints], pa.binary())], names=["cls", "prints"])

    return texts.select("cls", "text").mapInArrow(thrifty(run), "cls long, prints binary")


def token_unions(groups: DataFrame, prints: DataFrame) -> DataFrame:
    """The token-group matrix: fam, block, tokens (the union of the members' prints, packed), from groups (cls, fam, block) of at most about GROUP members."""

    def run(group: pa.Table) -> pa.Table:
        every = np.unique(np.concatenate([unpacked(p, np.uint32, np.uint8)[0] for p in group.column("prints").to_pylist()]))
        return pa.Table.from_arrays([group.column("fam")[:1], group.column("block")[:1], pa.array([packed(every, np.zeros(len(every), np.uint8))], pa.binary())], names=["fam", "block", "tokens"])

    held = groups.join(prints, "cls").select("fam", "block", "prints")
    return held.groupBy("fam", "block").applyInArrow(run, "fam long, block int, tokens binary")


def salted(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked (query, star, fam, block) with a salt, and each group's number of salts, so that a group which very many ask is dealt over tasks."""
    salts = materialize(asked.groupBy("fam", "block").agg(F.ceil(F.count("*") / (2 * GROUP)).cast("int").alias("salts")), "salts")
    return asked.join(broadcast_if_small(salts), ["fam", "block"]).withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")).drop("salts"), salts


def over_salts(rows: DataFrame, salts: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_small(salts), ["fam", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


KEY = ["fam", "block", "salt"]


def qualifying(asked: DataFrame, prints: DataFrame, unions: DataFrame, least: int) -> DataFrame:
    """Of asked (query, star, fam, block), the rows whose query overlaps with the group's union in `least` percent of its own shingles: without, no member can link. No text moves."""
    queries, salts = salted(asked)
    queries = queries.join(prints.withColumnRenamed("cls", "query"), "query").select(*KEY, F.lit(1).alias("ord"), "query", "star", "prints")
    rows = over_salts(unions, salts).select(*KEY, F.lit(0).alias("ord"), F.lit(0).cast("long").alias("query"), F.lit(0).cast("long").alias("star"), F.col("tokens").alias("prints")).union(queries)
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = np.zeros(0, np.uint32)
        for batch in batches:
            keep = []
            for i, (order, data) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("prints").to_pylist(), strict=True)):
                own = unpacked(data, np.uint32, np.uint8)[0]
                if not order:
                    union = own
                    continue
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                if 100 * int((union[at] == own).sum()) >= least * len(own):
                    keep.append(i)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(c) for c in ("query", "star", "fam", "block")], names=["query", "star", "fam", "block"])

    return dealt.mapInArrow(thrifty(run), "query long, star long, fam long, block int")


def open_groups(asked: DataFrame, groups: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """Links (a, b) between the queries of asked (query, star, fam, block), which qualify, and members (cls, star, fam, block) of their groups.

    A group that many queries ask is dealt over salts. All links are found; of those, each place gives
    out the ones that join stars which were apart there, which keeps the components and not a row for
    each pair.
    """
    queries, salts = salted(asked)
    queries = queries.select(*KEY, F.lit(1).alias("ord"), F.col("query").alias("cls"), "star")
    members = over_salts(groups, salts).select(*KEY, F.lit(0).alias("ord"), "cls", "star")
    rows = members.union(queries).join(texts, "cls")
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "ord").select(*KEY, "ord", "cls", "star", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, now = Shingler(words), None
        held: tuple[list[int], list[np.ndarray]] = ([], [])
        group: Group | None = None
        star_of: dict[int, int] = {}
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            a, b = [], []
            keys, order, cls = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)), batch.column("ord").to_pylist(), batch.column("cls").to_pylist()
            star = batch.column("star").to_pylist()
            sets = shingle.many(batch.column("text").cast(pa.binary()).to_pylist())
            for i, own in enumerate(sets):
                if keys[i] != now:
                    now, held, group = keys[i], ([], []), None
                    star_of.clear()
                    above.clear()
                if not order[i]:
                    held[0].append(cls[i])
                    held[1].append(own)
                    star_of[cls[i]] = star[i]
                    continue
                group = group or (Group(*held) if held[0] else None)
                for other in group.linked(own, least).tolist() if group else ():
                    x, y = root(star[i]), root(star_of[other])
                    if x != y:
                        above[x] = y
                        a.append(cls[i])
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return dealt.mapInArrow(thrifty(run), "a long, b long")


def joined_groups(asking: DataFrame, groups: DataFrame, texts: DataFrame, links: DataFrame, found: DataFrame, words: int, least: int) -> DataFrame:
    """Components (node, component) with the links through groups: asking (query, fam, blocks), groups (cls, fam, block), links and the components they make so far.

    In the first round a query asks one group of a family, in the next three more, then twelve; who asks
    which first is dealt by hash. Groups all of whose members are in the query's component by then
    aren't asked. The rounds go on until every query has asked every group but those, so no link that
    joins components is lost.
    """
    prints = materialize(shingle_prints(texts.join(groups.select("cls").union(asking.select(F.col("query").alias("cls"))).distinct(), "cls"), words), "prints")
    unions = materialize(token_unions(groups, prints), "unions")
    most = asking.agg(F.max("blocks")).first()[0]
    first, end = 0, 1
    while first < most:
        star = found.select(F.col("node").alias("cls"), "component")
        held = materialize(groups.join(star, "cls", "left").select("cls", "fam", "block", F.coalesce("component", "cls").alias("star")), "held")
        sides = held.groupBy("fam", "block").agg(F.min("star").alias("one"), F.max("star").alias("two"))
        turns = asking.where(F.col("blocks") > first).withColumn("turn", F.explode(F.sequence(F.lit(first), F.least(F.lit(end), F.col("blocks")) - 1)))
        turns = turns.select("query", "fam", F.pmod(F.xxhash64("query", "fam") + F.col("turn"), F.col("blocks")).cast("int").alias("block"))
        own = turns.join(star.withColumnRenamed("cls", "query"), "query", "left").withColumn("star", F.coalesce("component", "query"))
        asked = own.join(sides, ["fam", "block"]).where("one <> two or one <> star").select("query", "star", "fam", "block")
        now = materialize(qualifying(materialize(asked, "asked"), prints, unions, least), "qualifying")
        if not now.isEmpty():
            opened = materialize(open_groups(now, held, texts, words, least), "opened")
            if not opened.isEmpty():
                links = materialize(links.union(opened), "links")
                found = materialize(connected_components(links), "components")
        first, end = end, 4 * end
    return found


def jaccard_components(docs: DataFrame, words: int = 3, least: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, of, n_shingles, component_id of every row: the smallest doc_id reachable by links of Jaccard >= least / 100.

    Words part at ASCII white space, A-Z in lower case; a text with fewer words than a shingle has its
    whole sequence as one, and one without words, or null, is empty and links with nothing. Rows with
    equal sets, repeated rows among them, are one class. A null doc_id is never the smallest. No link
    between different sets is lost: pairs of classes that stay in different components after their hubs
    were compared are found by shared signatures again, and verified through the matrix.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    named = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text")]
    docs, named = on_files(docs, *named)
    deal = dealing(docs)
    rows = docs.select(*named, chunk_of(deal.rows).alias("chunk")).withColumn("slot", slot_of("chunk", deal.slots)).select("chunk", "slot", "doc_id", "of", "text")
    seed = 0
    while True:
        known = materialize(classify(rows, words, least, seed, deal), "classes")
        reps = known.where("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "of")).alias("rep"), F.min("check").alias("x"), F.max("check").alias("y"), F.min("n_shingles").alias("n"), F.max("n_shingles").alias("m"))
        if reps.where("x <> y or n <> m").isEmpty():
            break
        seed += 1  # two sets met in 64 bits: hash anew

    # classes that share a signature, and as hub of each the one that shares most
    signs = materialize(repeated_signs(known), "repeated")
    shared = materialize(signs.groupBy("sign").agg(F.min("cls").alias("one"), F.max("cls").alias("two"), F.count("*").alias("size")).where("one <> two").select("sign", "size"), "signs")
    members = materialize(signs.join(broadcast_if_small(shared), "sign"), "members")
    degrees = materialize(members.groupBy("cls").agg(F.sum("size").alias("degree")), "degrees")
    hubs = materialize(members.join(broadcast_if_small(degrees), "cls").groupBy("sign").agg(F.max(F.struct("degree", "cls")).alias("top")).select("sign", F.col("top.cls").alias("hub")), "hubs")
    pairs = materialize(members.join(broadcast_if_small(hubs), "sign").where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("times")), "pairs")
    wanted = pairs.select("cls").union(pairs.select("hub")).distinct()
    chosen = materialize(reps.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.of").alias("rep_of")).join(wanted, "cls"), "chosen")
    texts = materialize(rows.join(broadcast_if_small(chosen), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("of") == F.col("rep_of"))).select("cls", "text").dropDuplicates(["cls"]), "texts")
    stars = materialize(verify_stars(pairs.select("cls", "hub"), texts, words, least), "stars")
    inside = materialize(connected_components(stars), "star-groups")

    # signatures whose classes are still apart: their classes, grouped by the hub they share most with
    placed = members.select("sign", "cls").join(inside.withColumnRenamed("node", "cls"), "cls", "left").select("sign", "cls", F.coalesce("component", "cls").alias("star"))
    torn = materialize(placed.groupBy("sign").agg(F.min("star").alias("one"), F.max("star").alias("two")).where("one <> two").select("sign"), "torn")
    family = pairs.groupBy("cls").agg(F.max(F.struct("times", "hub")).alias("top")).select("cls", F.col("top.hub").alias("hub"))
    rest = materialize(placed.join(broadcast_if_small(torn), "sign").join(family, "cls", "left").select("sign", "cls", "star", F.coalesce("hub", "cls").alias("fam")), "rest")
    held = rest.select("cls", "fam", "star").distinct()
    blocks = materialize(held.groupBy("fam").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")), "blocks")
    placed_in = held.join(broadcast_if_small(blocks), "fam")
    groups = materialize(placed_in.select("cls", "fam", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")), "groups")
    lowest = materialize(rest.groupBy("sign", "fam").agg(F.min("star").alias("low")), "lowest")
    asking = rest.select("sign", F.col("cls").alias("query"), "star").join(lowest, "sign").where("low < star").select("query", "fam").distinct()
    asking = materialize(asking.join(broadcast_if_small(blocks), "fam"), "asking")
    found = inside
    if not asking.isEmpty():
        found = joined_groups(asking, groups, texts, stars, inside, words, least)
    named = materialize(known.where("cls is not null").select("doc_id", "of", "n_shingles", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "of", "n_shingles", F.coalesce("component", "cls").alias("label")), "named")
    first = materialize(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "firsts")
    full = named.join(first, "label").select("doc_id", "of", "n_shingles", "component_id")
    return full.unionByName(known.where("cls is null").select("doc_id", "of", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest doc_id. Rows of empty texts or null ids all stay, as they link with nothing or can't be told apart."""
    names = docs.columns
    found = jaccard_components(docs, words, least)
    gone = materialize(found.where((F.col("component_id") != F.col("doc_id"))).select("doc_id", "of").distinct(), "near-duplicates")
    mine = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.xxhash64("text").alias("now"))
    own = F.col(f"k{names.index('doc_id')}")
    return mine.join(broadcast_if_small(gone), (own == F.col("doc_id")) & (F.col("now") == F.col("of")), "left_anti").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def op6_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: The same for DuckDB, by counting common shingles of all pairs that share one.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * common >= 90 * (x.n_shingles + y.n_shingles - common)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, l.b FROM reach r JOIN l ON r.seen = l.a)
SELECT n.doc_id, n.n_shingles, min(r.seen) AS component_id FROM n JOIN reach r ON r.node = n.doc_id GROUP BY 1, 2
"""
