"""Language-model scores from a log-frequency Bloom filter.

Counts of word pairs are quantised on a log scale and kept in a Bloom filter, one entry per level: a
pair's count is read by probing level after level until one is missing. Exact counts of single words
give the base distribution. Corpus counts go through buckets by hash and come back to chunks of
documents; nothing but the filter is broadcast, and that only under a size bound. Beyond it, chunks
send their pairs to the filter's shards instead, which gives the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SideTable, crc_bucket, small_batches, stored_bytes, table
from .shared import Dealing, chunk_of, dealing, grouped, mix, on_files, packed, parts_in, slot_of, unpacked

U = np.uint64
#: Hash of the end of a text, which is a token that no word equals.
END_HASH = 0x656E64206F662074


@dataclass(frozen=True)
class LanguageModelOptions:
    """least_count is the smallest count of a pair that the filter keeps; bits and probes are the filter's per entry; weight and trust shape the interpolation: weight * c / (c + trust) for a context seen c times."""

    least_count: int = 2
    bits: int = 12
    probes: int = 6
    weight: float = 0.5
    trust: float = 50.0
    add: float = 0.1
    broadcast_bytes: int = 64 << 20


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) ^ mix(after + U(0x632BE59BD9B4E019)))


class Words:
    """64-bit hashes of texts' words, each text with its end; remembers words up to a bound."""

    def __init__(self, most: int = 400_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def many(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts in a row, and how many each text has."""
        own = [(t or b"").lower().split() for t in texts]
        flat = [w for ws in own for w in ws]
        if len(self.known) > self.most:
            self.known.clear()
        try:
            hashes = np.fromiter(map(self.known.__getitem__, flat), U, len(flat))
        except KeyError:
            for w in set(flat).difference(self.known):
                self.known[w] = xxhash.xxh64_intdigest(w)
            hashes = np.fromiter(map(self.known.__getitem__, flat), U, len(flat))
        sizes = np.array([len(ws) + 1 for ws in own], np.int64)
        out = np.full(int(sizes.sum()), END_HASH, U)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes) - 1] = False
        out[inside] = hashes
        return out, sizes


def pairs_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pair that ends at each token; the first of a text follows an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = END_HASH
    return pair_hash(before, tokens)


def code_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and fingerprint of a hash in 64 bits: all that the filter sees of a pair."""
    return (hashes % U(buckets)) << U(32) | hashes >> U(32)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


class Filter:
    """A log-frequency Bloom filter in shards: bits of all shards in a row, and where each begins."""

    def __init__(self, shards: list[bytes], probes: int, least_count: int) -> None:
        self.sizes = np.array([max(1, len(s)) * 8 for s in shards], U)
        self.first = np.concatenate([[0], np.cumsum([max(1, len(s)) for s in shards])[:-1]]).astype(U) * U(8)
        self.bits = np.frombuffer(b"".join(s or b"\0" for s in shards), np.uint8)
        self.probes, self.least = probes, least_count

    @staticmethod
    def walk(fingerprints: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a level begin, and their step; both are still to be taken modulo a shard's size."""
        start = mix(fingerprints.astype(U) + U(0x9E3779B97F4A7C15 * level % (1 << 64)))
        return start, mix(start) | U(1)

    @classmethod
    def shard(cls, fingerprints: np.ndarray, counts: np.ndarray, options: LanguageModelOptions) -> bytes:
        kept = counts >= options.least_count
        fingerprints, counts = fingerprints[kept], counts[kept]
        levels = quantised(counts, options.least_count)
        n = int(levels.sum())
        size = -(-n * options.bits // 64) * 64
        if not n:
            return b""
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max()) + 1):
            start, step = cls.walk(fingerprints[levels >= level], level)
            for _ in range(options.probes):
                bits[(start % U(size)).astype(np.int64)] = True
                start += step
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each pair: probes go on until one level is missing."""
        shard = (hashes % U(len(self.sizes))).astype(np.int64)
        return self.probed(hashes >> U(32), self.sizes[shard], self.first[shard])

    def probed(self, prints: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.int64)
        alive, level = np.arange(len(prints)), 1
        while len(alive):
            start, step = self.walk(prints[alive], level)
            own, base = size[alive], first[alive]
            for _ in range(self.probes):
                at = start % own + base
                hit = ((self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).astype(bool)
                start += step
                if not hit.all():
                    alive, start, step, own, base = (x[hit] for x in (alive, start, step, own, base))
            out[alive] = level
            level += 1
        return out


def quantised(counts: np.ndarray, least: int) -> np.ndarray:
    """1 + floor(log2(count / least))."""
    return 1 + np.floor(np.log2(np.maximum(counts, 1) / least) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The smallest count of each level, so that a context's quantised counts never exceed it; 0 for none."""
    return np.where(levels > 0, least * 2.0 ** (levels - 1), 0.0)


def score_texts(docs: DataFrame, options: LanguageModelOptions = LanguageModelOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text by a model of the rows whose crc32(id) mod 10 is not 0.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text is empty
    and has the end token alone; a null id counts as empty text for the split (held out). Repeated rows
    are learned from and scored each for itself. Without training rows, train_tokens is 0 and all
    tokens are unknown. A very long text is a part of a chunk by itself. Other columns of docs don't
    take part.
    """
    spark = docs.sparkSession
    small_batches(spark, 1024)
    kind = docs.schema[id_col].dataType
    docs, named = on_files(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_bucket(F.col(id_col), 10) == 0).alias("held_out"))
    deal = dealing(docs)
    rows = docs.select(*named, chunk_of(deal.rows).alias("chunk")).withColumn("slot", slot_of("chunk", deal.slots)).select("chunk", "slot", "doc_id", "held_out", "text")
    shared, serve = None, stored_bytes(docs) > options.broadcast_bytes  # a filter may take as many bytes as its table
    while True:
        side = SideTable.write(counted(rows, deal, serve, options), "lm", deal.slots)
        model = spark.read.schema("chunk long, bucket long, data binary, tokens long, distinct long, slot long").parquet(side.path).where("slot < 0")
        n, v, size = (int(x or 0) for x in model.agg(F.sum("tokens"), F.sum("distinct"), F.sum(F.octet_length("data"))).first())
        if serve:
            break
        if size <= options.broadcast_bytes:
            found = {r["chunk"]: r["data"] for r in model.where("data is not null").select("chunk", "data").collect()}
            shared = spark.sparkContext.broadcast([found.get(b, b"") for b in range(deal.buckets)])
            break
        serve = True  # larger than expected: count anew, and let the shards answer
    floor, buckets = n + options.add * (v + 1), deal.buckets
    usual = usual_level(options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact counts of a part's words from the answers, levels of its pairs from the filter or the answers."""
        words = Words()
        filter_ = Filter(shared.value, options.probes, options.least_count) if shared is not None else None
        now, known = None, None
        for chunk, slot, (ids, held, texts) in parts_in(batches, deal.part):
            if (chunk, slot) != now:
                now, known = (chunk, slot), Answers(side.rows(slot, chunk), buckets)
            tokens, sizes = words.many(texts)
            first = np.cumsum(sizes) - sizes
            every, place = np.unique(tokens, return_inverse=True)
            count = known.count(every)[place]
            context = np.empty_like(count)
            context[1:] = count[:-1]
            context[first] = known.count(np.array([END_HASH], U))[0]
            if filter_ is not None:
                every, place = np.unique(pairs_of(tokens, sizes), return_inverse=True)
                levels = filter_.levels(every)[place]
            else:
                every, place = np.unique(code_of(pairs_of(tokens, sizes), buckets), return_inverse=True)
                levels = known.level(every, usual)[place]
            base = (count + options.add) / floor
            weight = options.weight * context / (context + options.trust)
            seen = np.minimum(count_of(levels, options.least_count) / np.maximum(context, 1), 1.0)
            p = weight * seen + (1 - weight) * base
            columns = [pa.array(ids, arrow_kind), pa.array(held), pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(len(sizes), n, np.int64)), pa.array(np.add.reduceat(np.log10(base), first)), pa.array(np.add.reduceat(np.log10(p), first))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    arrow_kind = to_arrow_type(kind)
    return rows.mapInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def usual_level(options: LanguageModelOptions) -> int:
    """The level that a shard doesn't send back: what most pairs have."""
    return 1 if options.least_count == 1 else 0


def counted(rows: DataFrame, deal: Dealing, serve: bool, options: LanguageModelOptions) -> DataFrame:
    """slot, chunk, bucket, data, tokens, distinct: what the corpus knows of each chunk's words, and the filter.

    A chunk's words come back with their training counts. Slots below 0 hold, by bucket in the place of
    the chunk, the shards of the filter and the sums of words. With serve, shards stay where they are
    made: pairs of rows that aren't learned from are sent too, and each chunk gets the levels of its
    pairs other than the usual one.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words and pairs of a chunk with their training counts, by bucket; pairs' buckets come after words'."""
        words = Words()
        for chunk, slot, (_, held, texts) in parts_in(batches, deal.part):
            tokens, sizes = words.many(texts)
            trained = np.repeat(~np.array(held, bool), sizes)
            keys, counts = summed(tokens, trained)
            own = (keys % U(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cut = np.searchsorted(own[order], np.arange(buckets + 1))
            out = [(int(b), chunk, slot, packed(keys[order[cut[b] : cut[b + 1]]], counts[order[cut[b] : cut[b + 1]]].astype(np.uint32))) for b in np.flatnonzero(cut[1:] > cut[:-1])]
            code = code_of(pairs_of(tokens, sizes), buckets)
            learned, times = np.unique(code[trained], return_counts=True)
            if serve:
                asked = np.unique(code[~trained])
                learned, times = np.concatenate([learned, asked]), np.concatenate([times, np.zeros(len(asked), np.int64)])
                order = np.argsort(learned, kind="stable")
                learned, times = learned[order], times[order]
            cut = np.searchsorted(learned, np.arange(buckets + 1, dtype=U) << U(32))
            prints, times = learned.astype(np.uint32), times.astype(np.uint32)
            out += [(buckets + int(b), chunk, slot, packed(prints[cut[b] : cut[b + 1]], times[cut[b] : cut[b + 1]])) for b in np.flatnonzero(cut[1:] > cut[:-1])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "chunk", "slot", "counts"])

    def total(group: pa.Table) -> pa.Table:
        """A bucket's sums, back to the chunks that asked."""
        bucket = group.column("bucket")[0].as_py()
        of_pairs = bucket >= buckets
        sent = [unpacked(k, np.uint32 if of_pairs else U, np.uint32) for k in group.column("counts").to_pylist()]
        every, sums = summed(np.concatenate([k for k, _ in sent]), np.concatenate([n for _, n in sent]))
        own = bucket - buckets if of_pairs else bucket
        home = -1 - own % slots
        asked = list(zip(group.column("slot").to_pylist(), group.column("chunk").to_pylist(), (k for k, _ in sent), strict=True))
        out: list[tuple] = []
        if of_pairs:
            shard = Filter.shard(every, sums, options)
            out.append((home, own, bucket, shard, 0, 0))
            levels = Filter([shard], options.probes, options.least_count).levels(every.astype(U) << U(32)) if serve else sums
            for slot, chunk, k in asked if serve else ():
                said = levels[np.searchsorted(every, k)]
                out.append((slot, chunk, bucket, packed(k[said != usual], said[said != usual].astype(np.uint8)), 0, 0))
        else:
            out.append((home, own, bucket, None, int(sums.sum()), int((sums > 0).sum())))
            same = every[1:] >> U(32) == every[:-1] >> U(32)  # words that half a hash doesn't tell apart
            alone = ~(np.append(same, False) | np.append(False, same))
            for slot, chunk, k in asked:
                at = np.searchsorted(every, k)
                one, more = at[alone[at]], at[~alone[at]]
                out.append((slot, chunk, bucket, packed((every[one] >> U(32)).astype(np.uint32), sums[one]), 0, 0))
                if len(more):
                    out.append((slot, chunk, bucket + 2 * buckets, packed(every[more], sums[more]), 0, 0))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["slot", "chunk", "bucket", "data", "tokens", "distinct"])

    usual, buckets, slots = usual_level(options), deal.buckets, deal.slots
    sent = rows.mapInArrow(gather, "bucket long, chunk long, slot long, counts binary")
    return grouped(sent, deal.tasks).applyInArrow(total, "slot long, chunk long, bucket long, data binary, tokens long, distinct long")


class Answers:
    """What came back to a chunk: its words' training counts, and levels of its pairs."""

    def __init__(self, said: pa.Table, buckets: int) -> None:
        words, whole, pairs = ([(np.zeros(0, U), np.zeros(0, kind))] for kind in (np.int64, np.int64, np.uint8))
        for bucket, data in zip(said.column("bucket").to_pylist(), said.column("data").to_pylist(), strict=True):
            if bucket >= 2 * buckets:
                whole.append(unpacked(data, U, np.int64))
            else:
                keys, values = unpacked(data, np.uint32, np.int64 if bucket < buckets else np.uint8)
                (words if bucket < buckets else pairs).append((keys.astype(U) | U(bucket % buckets) << U(32), values))
        self.buckets = buckets
        self.words, self.whole, self.pairs = map(self.sorted, (words, whole, pairs))

    @staticmethod
    def sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        return keys[order], values[order]

    @staticmethod
    def find(known: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, other: int) -> np.ndarray:
        keys, values = known
        if not len(keys):
            return np.full(len(wanted), other, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other).astype(np.int64)

    def count(self, words: np.ndarray) -> np.ndarray:
        found = self.find(self.words, code_of(words, self.buckets), 0)
        return np.maximum(found, self.find(self.whole, words, 0)) if len(self.whole[0]) else found

    def level(self, codes: np.ndarray, usual: int) -> np.ndarray:
        return self.find(self.pairs, codes, usual)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Scores by a filter that keeps all pairs, those seen once too."""
    return score_texts(table(spark, sf_dir, "documents"), LanguageModelOptions(least_count=1))
