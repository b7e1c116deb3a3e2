"""Removal of byte strings that repeat across documents, by maximal repeats of a suffix array.

Every window of 50 bytes names an anchor, the least hash of the 20-byte strings in it, so equal windows
name equal anchors. Anchors that only one document has are dropped; around the others, the windows with
one anchor make a segment. Segments with one anchor meet in one bucket, whose enhanced suffix array is
scanned with a stack for intervals of a common prefix; those whose left extensions differ are the
maximal repeats, and each comes with all its occurrences. Texts stay where they are read: only anchors
and repeated segments move, and what a chunk of documents needs to know comes back to it as a file in
the shared folder. Segments are told apart by a hash only where their bytes have been compared: should
two with one hash differ, all is hashed anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SideTable, small_batches, table
from .shared import Dealing, Gather, chunk_of, dealing, grouped, mix, on_files, parts_in, shared_among, slot_of, write_shared

U = np.uint64
#: Bytes of a string that counts, and of an anchor.
LENGTH, ANCHOR = 50, 20
LAST = np.iinfo(np.int64).max


def anchor_hashes(data: bytes, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place; as many as fit."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = np.full(n, size, U)
    for at in [*range(0, size - 8, 8), size - 8]:
        h = mix(h * U(0x9E3779B97F4A7C15) + words[at : at + n])
    return h


def least_of_windows(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments_of(text: bytes, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first byte, end) of runs of windows with one anchor; a run is cut after as many windows as an anchor can have."""
    width = length - size + 1
    if len(text) < length:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    named = least_of_windows(anchor_hashes(text, size), width)
    change = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    ends = np.append(change[1:], len(named))
    extra = (ends - change - 1) // width
    if extra.any():
        first = np.repeat(change, extra + 1)
        order = np.arange(len(first)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
        change = first + order * width
        ends = np.append(change[1:], len(named))
    return named[change], change, ends + length - 1


class Chunk:
    """The documents of a chunk with their segments."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.ids, self.texts = ids, texts
        found = [segments_of(t) for t in texts]
        self.anchor, self.first, self.end = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        self.row = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        self.base = np.cumsum([0, *map(len, texts)])[:-1]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def where(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some segments, one to a row of a matrix filled up with zeros, and their lengths."""
        start, n = self.base[self.row[rows]] + self.first[rows], self.end[rows] - self.first[rows]
        wide = 2 * LENGTH - ANCHOR
        at = start[:, None] + np.arange(wide)
        inside = np.arange(wide) < n[:, None]
        return np.where(inside, self.bytes[np.minimum(at, max(len(self.bytes) - 1, 0))], 0).astype(np.uint8), n


def row_hash(rows: np.ndarray, n: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each row of a byte matrix (a multiple of 8 wide), with its length."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = mix(n.astype(U) + U(seed))
    for j in range(words.shape[1]):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[:, j])
    return h


def documents_in(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, list, list[int], list[bytes]]]:
    """(chunk, slot, ids as they are, ids for comparison, texts) of a part of a chunk."""
    for chunk, slot, (ids, texts) in parts_in(batches, most):
        yield chunk, slot, ids, [LAST if i is None else i for i in ids], [t or b"" for t in texts]


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(5, "little") + pa.compress(data, codec="zstd", asbytes=True)


def widened(data: bytes) -> bytes:
    return pa.decompress(data[5:], decompressed_size=int.from_bytes(data[:5], "little"), codec="zstd", asbytes=True)


def suffix_intervals(rows: np.ndarray, n: np.ndarray, doc: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, least doc) of `suffix_groups`."""
    return suffix_groups(rows, n, doc, least)[:4]


def suffix_groups(rows: np.ndarray, n: np.ndarray, doc: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of `least` bytes or more in the rows of a byte matrix, with all occurrences: (row, start, length, least doc, number of the repeat) of each.

    Suffixes with at least that many bytes are sorted, and the common prefixes of neighbours found. A
    stack goes over them; as an interval of a common prefix closes, its occurrences' left bytes are
    compared: if all have the same, the repeat is part of a longer one with the same occurrences.
    """
    windows = np.maximum(n - least + 1, 0)
    row = np.repeat(np.arange(len(n)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    wide = rows.shape[1]
    at = start[:, None] + np.arange(wide)
    left = n[row] - start
    suffix = np.where(np.arange(wide) < left[:, None], rows[row[:, None], np.minimum(at, wide - 1)], 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(suffix).view(f"S{wide}").ravel(), kind="stable")
    suffix, row, start, left = suffix[order], row[order], start[order], left[order]
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide) if len(row) > 1 else np.zeros(0, np.int64)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    before = np.where(start > 0, rows[row, np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(row)))
    owner = doc[row]
    out: list[tuple[np.ndarray, int, int]] = []
    lcp = common.tolist() + [0]
    stack: list[list] = []  # common prefix, first suffix, left byte that all share or None, least doc
    lefts, owners = before.tolist(), owner.tolist()
    for i, here in enumerate(lcp):
        lead, same, smallest = i, lefts[i], owners[i]
        while stack and stack[-1][0] > here:
            depth, lead, shared, low = stack.pop()
            same = shared if shared == same else None
            smallest = min(smallest, low)
            if same is None:
                out.append((lead, i + 1, depth, smallest))
        if here >= least:
            if stack and stack[-1][0] == here:
                top = stack[-1]
                top[2] = top[2] if top[2] == same else None
                top[3] = min(top[3], smallest)
            else:
                stack.append([here, lead, same, smallest])
        elif stack:
            raise AssertionError("an interval is left open")
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    lead, end, depth, low = (np.array(x, np.int64) for x in zip(*out, strict=True))
    size = end - lead
    which = np.repeat(lead, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return row[which], start[which], np.repeat(depth, size), np.repeat(low, size), np.repeat(np.arange(len(lead)), size)


#: What a chunk learns of a segment: its hash, the least document of a repeat in it, where that begins and ends, and which repeat it is.
STRETCH = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "u1"), ("end", "u1")])
MEMBER = np.dtype([*STRETCH.descr, ("group", "<i8")])


def repeats_in(rows: np.ndarray, n: np.ndarray, doc: np.ndarray, many: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, least doc, group) of the maximal repeats in distinct segments; doc is each one's least document, many whether it has several.

    A segment of several documents is a repeat of its own, a leaf of the suffix tree with both ends open,
    unless it lies in others of its anchor: then it is an interval. Where an anchor has one segment,
    that leaf is its whole interval tree, so no array is built.
    """
    _, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[place] > 1)
    order = mixed[np.argsort(anchor[mixed], kind="stable")]
    leaf = many.copy()
    parts, groups, begin = [], 0, 0
    while begin < len(order):  # anchors stay together
        end = min(begin + 8192, len(order))
        while end < len(order) and anchor[order[end]] == anchor[order[end - 1]]:
            end += 1
        own = order[begin:end]
        r, s, length, low, group = suffix_groups(rows[own], n[own], doc[own])
        leaf[own[r[(s == 0) & (length == n[own][r])]]] = False
        parts.append((own[r], s, s + length, low, groups + group))
        groups += int(group[-1]) + 1 if len(group) else 0
        begin = end
    leaves = np.flatnonzero(leaf)
    parts.append((leaves, np.zeros(len(leaves), np.int64), n[leaves], doc[leaves], groups + np.arange(len(leaves))))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(5))


class Learned:
    """Repeated segments of a stored table, and what each chunk learned of its own, as files in the shared folder."""

    def __init__(self, rows: DataFrame, deal: Dealing, members: bool) -> None:
        """With members, chunks learn of every repeat that their segments are in; else, of those that an earlier document has."""
        self.deal, self.kind = deal, MEMBER if members else STRETCH
        self.known = write_shared(rows, anchors_of(deal.part), deal.buckets, deal.slots, "anchors")
        self.seed = 0
        while True:
            sent = rows.mapInArrow(self.send(), "bucket long, chunk long, slot long, anchors binary, docs binary, lengths binary, data binary")
            self.side = SideTable.write(grouped(sent, deal.tasks).applyInArrow(self.answer(), "slot long, chunk long, bucket long, data binary"), "stretches", deal.slots)
            if rows.sparkSession.read.schema("slot long").parquet(self.side.path).where("slot < 0").isEmpty():
                break
            self.seed += 1

    def candidates(self, c: Chunk, chunk: int, slot: int) -> np.ndarray:
        """The chunk's segments whose anchors several documents have."""
        return shared_among(self.known, slot, chunk, c.anchor, self.deal.buckets)[0]

    def send(self):
        deal, seed, candidates = self.deal, self.seed, self.candidates

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distinct repeated segments of a part of a chunk with their least document, by bucket; a second document too, where there is one."""
            for chunk, slot, _, ids, texts in documents_in(batches, deal.part):
                c = Chunk(ids, texts)
                some = candidates(c, chunk, slot)
                if not len(some):
                    continue
                data, n = c.where(some)
                key, doc, anchor = row_hash(data, n, seed), np.array(ids, np.int64)[c.row[some]], c.anchor[some]
                order = np.lexsort((doc, key, anchor % U(deal.buckets)))
                new = starts_of(order, anchor, key, data, n)
                # of equal segments the least document, and the last if it is another: enough to tell whether there are several
                first = order[new | (np.append(new[1:], True) & (doc[order] != first_of_run(doc[order], new)))]
                bucket = (anchor[first] % U(deal.buckets)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(deal.buckets + 1))
                out = []
                for b in np.flatnonzero(cut[1:] > cut[:-1]):
                    own = first[cut[b] : cut[b + 1]]
                    inside = np.arange(data.shape[1]) < n[own][:, None]
                    out.append((b, chunk, slot, anchor[own].tobytes(), squeezed(doc[own].astype(np.int64).tobytes()), n[own].astype(np.uint8).tobytes(), squeezed(data[own][inside].tobytes())))
                kinds = (pa.int64(),) * 3 + (pa.binary(),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "chunk", "slot", "anchors", "docs", "lengths", "data"])

        return segments

    def answer(self):
        seed, kind = self.seed, self.kind

        def stretches(group: pa.Table) -> pa.Table:
            """For each chunk that sent them, the repeats that its segments are in."""
            anchor = [np.frombuffer(x, U) for x in group.column("anchors").to_pylist()]
            doc = np.concatenate([np.frombuffer(widened(x), np.int64) for x in group.column("docs").to_pylist()])
            n = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("lengths").to_pylist()]).astype(np.int64)
            flat = np.frombuffer(b"".join(map(widened, group.column("data").to_pylist())), np.uint8)
            wide = 2 * LENGTH - ANCHOR
            data = np.zeros((len(n), wide), np.uint8)
            data[np.arange(wide) < n[:, None]] = flat
            sizes = [len(a) for a in anchor]
            anchor = np.concatenate(anchor)
            key = row_hash(data, n, seed)
            order = np.lexsort((doc, key, anchor))
            new = starts_of(order, anchor, key, data, n)
            names = ["slot", "chunk", "bucket", "data"]
            if (new & np.append(False, key[order][1:] == key[order][:-1]) & np.append(False, anchor[order][1:] == anchor[order][:-1])).any():
                return pa.Table.from_pydict({"slot": [-1], "chunk": [0], "bucket": [0], "data": [b""]})  # two segments met in 64 bits
            which = np.empty(len(n), np.int64)
            which[order] = np.cumsum(new) - 1
            first = order[new]
            many = np.add.reduceat((doc[order] != doc[first][which[order]]).astype(np.int64), np.flatnonzero(new)) > 0
            row, start, end, low, number = repeats_in(data[first], n[first], doc[first], many, anchor[first])
            by = np.lexsort((low, row))
            row, start, end, low, number = row[by], start[by], end[by], low[by], number[by]
            cut = np.searchsorted(row, np.arange(len(first) + 1))
            latest = np.full(len(first), np.iinfo(np.int64).min)
            np.maximum.at(latest, which, doc)
            begin, out = 0, []
            for slot, chunk, bucket, size_ in zip(*(group.column(c).to_pylist() for c in ("slot", "chunk", "bucket")), sizes, strict=True):
                mine = np.unique(which[begin : begin + size_])
                begin += size_
                count = cut[mine + 1] - cut[mine]
                at = np.repeat(cut[mine], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                own = np.repeat(mine, count)
                if kind is STRETCH:  # only what some document of the segment comes after
                    late = low[at] < latest[own]
                    at, own = at[late], own[late]
                made = np.empty(len(at), kind)
                made["key"], made["doc"], made["start"], made["end"] = key[first][own], low[at], start[at], end[at]
                if kind is MEMBER:
                    made["group"] = number[at] + (bucket << 40)
                out.append((slot, chunk, bucket, squeezed(made.tobytes())))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return stretches

    def members(self, c: Chunk, chunk: int, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's segments in repeats, and what is known of each: one entry for each segment and repeat."""
        some = self.candidates(c, chunk, slot)
        if not len(some):
            return some, np.empty(0, self.kind)
        raw = b"".join(map(widened, self.side.rows(slot, chunk).column("data").to_pylist()))
        have = np.frombuffer(raw, self.kind)
        order = np.argsort(np.ascontiguousarray(have["key"]))
        have = have[order]
        keys = np.ascontiguousarray(have["key"])
        data, n = c.where(some)
        key = row_hash(data, n, self.seed)
        lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
        count = hi - lo
        which = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(some, count), have[which]


def first_of_run(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each place, the value where its run begins."""
    return values[new][np.cumsum(new) - 1]


def starts_of(order: np.ndarray, anchor: np.ndarray, key: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where, in this order, another segment begins: another anchor, hash, or, byte by byte, content."""
    a, k, d, m = anchor[order], key[order], data[order], n[order]
    return np.concatenate([[True], (a[1:] != a[:-1]) | (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (d[1:] != d[:-1]).any(axis=1)])


def anchors_of(most: int) -> Gather:
    """The anchors of each part of a chunk, and whose they are."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for chunk, slot, _, ids, texts in documents_in(batches, most):
            c = Chunk(ids, texts)
            yield chunk, slot, c.anchor, np.array(ids, np.int64)[c.row]

    return gather


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Dealing]:
    small_batches(docs.sparkSession, 1024)
    docs, named = on_files(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    deal = dealing(docs)
    rows = docs.select(*named, chunk_of(deal.rows).alias("chunk")).withColumn("slot", slot_of("chunk", deal.slots))
    return rows.select("chunk", "slot", "doc_id", "text"), deal


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of 50 bytes or more with all their occurrences: repeat (a number), doc_id, start, length, first_doc.

    Repeats are maximal within segments, the up to 80 bytes whose windows name one anchor; a longer copy
    is a chain of repeats that overlap. Every occurrence is given, in the smallest document, first_doc,
    too; but in a text that repeats itself within 20 bytes, runs of one anchor are cut, and occurrences
    that lie across a cut come in two parts. A repeat has occurrences in two documents, or two in one whose segment others share.
    Null and short texts have none; a null doc_id counts as the largest (first_doc is null where no
    other has it). Rows with one id are one document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, deal = _rows(docs, id_col, text_col)
    learned = Learned(rows, deal, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slot, shown, ids, texts in documents_in(batches, deal.part):
            c = Chunk(ids, texts)
            segment, known = learned.members(c, chunk, slot)
            row, start = c.row[segment], c.first[segment] + known["start"]
            length = known["end"].astype(np.int64) - known["start"]
            first = pa.array(known["doc"], mask=known["doc"] == LAST).cast(arrow_id)
            found = np.unique(np.stack([known["group"], row, start, length, np.arange(len(row))])[:4], axis=1, return_index=True)[1] if len(row) else np.zeros(0, np.int64)
            made = [pa.array(known["group"][found]), pa.array(shown, arrow_id).take(pa.array(row[found])), pa.array(start[found].astype(np.int64)), pa.array(length[found]), first.take(pa.array(found))]
            yield pa.RecordBatch.from_arrays(made, names=["repeat", "doc_id", "start", "length", "first_doc"])

    arrow_id = pa.int32() if kind == "int" else pa.int64()
    return rows.mapInArrow(run, f"repeat long, doc_id {kind}, start long, length long, first_doc {kind}")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans, kept of every row: maximal runs of removed bytes (start, end), and the other bytes in a row.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are
    judged on the input. A null text is empty; texts under 50 bytes keep all; a very long text is worked
    on by itself. A null doc_id counts as larger than any other; rows with one id never remove from each
    other, so repeated rows are treated alike. doc_id must be a whole number. Other columns of docs
    don't take part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, deal = _rows(docs, id_col, text_col)
    learned = Learned(rows, deal, False)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, slot, shown, ids, texts in documents_in(batches, deal.part):
            c = Chunk(ids, texts)
            gone = np.zeros(len(c.bytes) + 1, np.int32)
            segment, known = learned.members(c, chunk, slot)
            late = known["doc"] < np.array(ids, np.int64)[c.row[segment]]
            segment, known = segment[late], known[late]
            at = c.base[c.row[segment]] + c.first[segment]
            np.add.at(gone, at + known["start"], 1)
            np.add.at(gone, at + known["end"], -1)
            removed = np.cumsum(gone[:-1]) > 0
            spans, kept = [], []
            for i, text in enumerate(texts):
                mask = removed[c.base[i] : c.base[i] + len(text)]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if len(edge) else text)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(shown, arrow_id), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    arrow_id = pa.int32() if kind == "int" else pa.int64()
    return rows.mapInArrow(apply, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op10_query(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same for DuckDB, over the hexadecimal form of every window.
OP10_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM t)),
f AS (SELECT w, min(doc_id) AS least FROM g GROUP BY w HAVING count(*) > 1),
c AS (SELECT g.doc_id, g.p FROM g JOIN f ON g.w = f.w WHERE f.least < g.doc_id),
r AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT e.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(t.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail FROM e JOIN t ON t.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
