"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so however large the corpus, its lengths are a table of
at most `capacity` counts. That table is packed on the driver by branch-and-bound, which says whether
fewer sequences are impossible; rows then find their place by their rank among the rows of their
length.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialize, small_batches, table, thrifty

CAPACITY, END = 4096, 1
#: Bytes of text whose words a worker holds at once.
PART_BYTES = 1 << 20
#: Nodes that a dive may open for one filling; nodes of fillings that the exact search may open in all; bins it takes on at once.
FILL_NODES, SEARCH_NODES, SEARCH_BINS = 400, 200_000, 64
#: Groups of bins that are searched in vain before the packing of more than SEARCH_BINS stands; distinct lengths add to them.
TRIES = 12
#: A vocabulary's rules under which words are split before they are encoded: lower case, then letters in a row, single digits, what an apostrophe adds, other signs in a row.
SPLIT_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The same split of words, each ended by BREAK, in lower case and without a character of STRANGE: ASCII and the letters of Latin-1, on which Python agrees with those rules.
LETTERS, BREAK = "a-zß-öø-ÿ", "\n"
PIECES = re.compile(rf"[{LETTERS}]+|[0-9]|{BREAK}|'(?:s|t|re|ve|m|ll|d)|[^\t-\r 0-9{LETTERS}]+")
STRANGE = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


class WordTokenizer:
    """Token ids of whole texts, word by word: the vocabulary's rules never reach across white space, so words that recur are encoded once.

    Where the rules are SPLIT_RULES, they don't reach across the pieces of a word either, and pieces, of which
    there are far fewer, take the place of words: str for bytes. Words with a special token or a strange character stay whole.
    """

    def __init__(self, path: str, most_words: int = 350_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [x.content.encode() for x in added]
        #: A symbol with one id of its own parts words that are encoded together. Words with it, or with a special token, go alone.
        self.mark, self.mark_id = next(((c, ids[0]) for c in "¦§¶†•★" if len(ids := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1), ("", -1))
        self.alone = self.special + [self.mark.encode()] * bool(self.mark)
        #: For pieces: the same merges without the rules that are done with, and which ids end a piece.
        self.merges = None
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and follows(path, SPLIT_RULES) and all(x.special and not x.normalized for x in added) and all(c in vocabulary and c + suffix in vocabulary for c in pre_tokenizers.ByteLevel.alphabet()):
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.reset()

    def reset(self) -> None:
        self.place: dict[bytes | str, int] = {BREAK: 0}  # of no id
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def encoded(self, words: list[bytes], together: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, in a row, and how many each has."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        made = self.tokenizer.encode_batch_fast([f" {self.mark} ".join([*(w.decode("utf-8", "replace") for w in g), ""]) if together > 1 else g[0].decode("utf-8", "replace") for g in groups], add_special_tokens=False)
        flat = [e.ids for e in made]
        ids = np.fromiter(itertools.chain.from_iterable(flat), np.uint32, sum(map(len, flat)))
        if together == 1:
            return ids, np.fromiter(map(len, flat), np.int64, len(flat))
        ends = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def encoded_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces."""
        made = self.merges.encode_batch_fast([" ".join(pieces[i : i + 256]) for i in range(0, len(pieces), 256)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in made])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def learn(self, new: list[bytes | str]) -> None:
        if pieces := [x for x in new if isinstance(x, str)]:
            self.remember(pieces, *self.encoded_pieces(pieces))
            new = [x for x in new if isinstance(x, bytes)]
        odd, every = [] if self.mark else new, b" ".join(new)
        if self.mark and any(x in every for x in self.alone):
            odd = [w for w in new if any(x in w for x in self.alone)]
            new = list(dict.fromkeys(new).keys() - set(odd))
        for words, together in ((odd, 1), (new, 256)) if self.mark else ((odd, 1),):
            if words:
                self.remember(words, *self.encoded(words, together))

    def remember(self, words: list[bytes] | list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.place)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(words) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first : first + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[first : first + len(words)] = counts
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.used += len(flat)

    def parts(self, words: bytes) -> list[bytes | str]:
        """The pieces of words that BREAK ends, or the words as they are; after each word BREAK."""
        if self.merges is not None:
            plain = words.decode("utf-8", "replace")
            if not STRANGE.search(plain) and not any(x in words for x in self.special):
                return PIECES.findall(plain.lower())
        out: list[bytes | str] = []
        for word in words.split(BREAK.encode())[:-1]:
            plain = word.decode("utf-8", "replace")
            if self.merges is None or STRANGE.search(plain) or any(x in word for x in self.special):
                out += (word, BREAK) if word else (BREAK,)
            else:
                out += PIECES.findall(plain.lower() + BREAK)
        return out

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text. Arrow splits the texts and finds the distinct words, so that Python sees each of those once."""
        if len(self.place) > self.most:  # what was learned first tends to be what is frequent
            kept = self.most // 2
            self.place = dict(itertools.islice(self.place.items(), kept))
            self.used = int(self.start[kept - 1] + self.count[kept - 1])
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
        words = split.values.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), BREAK)[0]
        parts = self.parts(distinct.as_buffer().to_pybytes() + BREAK.encode() if len(words.dictionary) else b"")
        at = np.fromiter(map(self.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [parts[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self.place.__getitem__, unknown), np.int64, len(unknown))
        ids, ends = gathered(self.ids, self.start[at], self.count[at])
        ends = ends[at == 0]  # of distinct words
        count = np.diff(ends, prepend=0)
        which = words.indices.to_numpy()
        ids, ends = gathered(ids, (ends - count)[which], count[which])
        begin = 0
        for end in np.concatenate([[0], ends])[split.offsets.to_numpy()[1:]].tolist():
            yield ids[begin:end]
            begin = end


def gathered(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, one after the other, and where each ends."""
    ends = np.cumsum(count)
    return values[np.repeat(start - (ends - count), count) + np.arange(int(count.sum()))], ends


def follows(path: str, rules: dict) -> bool:
    """Whether a vocabulary's file states these rules."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    return all(stated.get(k) == v for k, v in rules.items())


def parted(texts: list[bytes], most: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The texts in order, in parts of so many bytes at most; a longer text goes alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


@kept
@functools.lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per process, so that what a task has learned serves the next, and the next packing; tasks of other operators let it go."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit).

    A document is its text's ids and then the end id; a null text counts as empty. Only documents over
    the capacity are cut, at its multiples.
    """
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows: list[tuple] = []
            where: list[int] = []
            for i, ids in enumerate(itertools.chain.from_iterable(map(tokenizer.encode, parted(texts)))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    data = ids[start : start + capacity].tobytes()
                    rows.append((piece, start, len(data) // 4, zlib.crc32(data), data if keep_ids else b""))
                    where.append(i)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            made = [batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(made[: 5 + keep_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(thrifty(run, word_tokenizer), schema)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound from below: items over half need a bin each, and small ones what room those leave (for each limit of small)."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in {0, *(n for n in lengths if 2 * n <= capacity)}:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = [(n, c) for n, c in counts.items() if capacity - k >= n and 2 * n > capacity]
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        m = sum(c for _, c in middle)
        room = m * capacity - sum(n * c for n, c in middle)
        best = max(best, large + m + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, on equal bins at once."""
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Filling, int]] = []

    def put(filling: Filling, room: int, times: int) -> None:
        if not room:
            done.append((filling, times))
            return
        if room not in open_:
            bisect.insort(rooms, room)
        open_.setdefault(room, []).append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                times = left // each
                put(((length, each),), capacity - each * length, times)
                left -= each * times
                continue
            room = rooms[at]
            filling, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            used = min(times, left)
            if used < times:
                put(filling, room, times - used)
            same = filling[-1][0] == length
            put((*filling[: -1 if same else None], (length, filling[-1][1] + 1 if same else 1)), room - length, used)
            left -= used
    return done + [x for group in open_.values() for x in group]


def dominated(taken: dict[int, int], counts: dict[int, int], lengths: list[int], room: int) -> bool:
    """Whether some items of a filling could make way for a longer one, or for none, that is left out and still fits.

    If so, swapping them with it makes the other bin no fuller, so a packing with the swapped filling
    is as good. Sums of items under a length are bits of a number: one shift finds any in a range.
    """
    sums, rising, k = 1, sorted(taken), 0
    for y in lengths:
        if counts[y] <= taken.get(y, 0):
            continue
        while k < len(rising) and rising[k] < y:
            for _ in range(taken[rising[k]]):
                sums |= sums << rising[k]
            k += 1
        if y <= room:
            return True
        low = y - room  # 1 or more
        if (sums >> low) & ((1 << (room + 1)) - 1):
            return True
    return False


class Spent(Exception):
    """The nodes of a search are used up."""


class Nodes:
    """How many nodes a search may still open."""

    def __init__(self, most: int) -> None:
        self.left = most

    def open(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise Spent


def fillings(counts: dict[int, int], lengths: list[int], room: int, nodes: Nodes, most_waste: int | None = None, first_full: bool = False) -> list[Filling]:
    """Undominated fillings of a room that waste no more than stated, least waste first; with first_full, those up to the first without waste. Raises Spent if there are too many."""
    found: list[tuple[int, Filling]] = []
    most_waste = room if most_waste is None else most_waste
    below = list(itertools.accumulate((n * counts[n] for n in lengths), initial=0))

    def dive(room: int, upto: int, taken: dict[int, int]) -> bool:
        nodes.open()
        at = min(upto, bisect.bisect_right(lengths, room))
        if room - below[at] > most_waste:
            return False
        while at:
            at -= 1
            n = lengths[at]
            for times in range(min(counts[n], room // n), 0, -1):
                taken[n] = times
                if dive(room - n * times, at, taken):
                    return True
                del taken[n]
        if room <= most_waste and not dominated(taken, counts, lengths, room):
            found.append((room, tuple(sorted(taken.items(), reverse=True))))
            return first_full and not room
        return False

    try:
        dive(room, len(lengths), {})
    except Spent:
        if not (first_full and found):
            raise
    found.sort(key=lambda x: (x[0], [(-n, -c) for n, c in x[1]]))
    return [f for _, f in found]


def greedy_filling(counts: dict[int, int], lengths: list[int], room: int) -> Filling:
    """The longest that fits, again and again."""
    taken: dict[int, int] = {}
    for n in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        if times := min(counts[n], room // n):
            taken[n] = times
            room -= n * times
    return tuple(sorted(taken.items(), reverse=True))


def with_longest(filling: Filling, longest: int) -> dict[int, int]:
    whole = dict(filling)
    whole[longest] = whole.get(longest, 0) + 1
    return whole


def wasted(whole: dict[int, int], capacity: int) -> int:
    return capacity - sum(n * c for n, c in whole.items())


def take(left: dict[int, int], lengths: list[int], whole: dict[int, int], times: int) -> None:
    for n, c in whole.items():
        left[n] -= c * times
        if not left[n]:
            del left[n]
            lengths.pop(bisect.bisect_left(lengths, n))


def dive_bins(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """A packing by first choices: around the longest item left, the best filling that a few nodes find, as often as the counts allow."""
    left, lengths, made = dict(counts), sorted(counts), []
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        try:
            rest = fillings(left, lengths, capacity - longest, Nodes(FILL_NODES), first_full=True)[0]
        except Spent:
            rest = greedy_filling(left, lengths, capacity - longest)
        left[longest] += 1
        whole = with_longest(rest, longest)
        times = min(left[n] // c for n, c in whole.items())
        made.append((tuple(sorted(whole.items(), reverse=True)), times))
        take(left, lengths, whole, times)
    return made


def complete_bins(counts: dict[int, int], capacity: int, fewest: int, nodes: Nodes) -> tuple[list[Filling] | None, bool]:
    """A packing of fewer than `fewest` bins, the fewest there is if the second value says so; None if none was found.

    Depth first: the longest item left opens a bin, and its undominated fillings are the branches, least
    waste first. With fewest - 1 bins there is only so much waste; a branch that wastes more is left,
    and so is one whose bins and least number of bins for what is left don't beat the incumbent.
    """
    total, bound = sum(n * c for n, c in counts.items()), least_bins(counts, capacity)
    left, best = dict(counts), None
    path: list[dict[int, int]] = []
    waste = 0

    def branches() -> Iterator[dict[int, int]]:
        longest = max(left)
        left[longest] -= 1
        try:
            found = fillings(left, sorted(left), capacity - longest, nodes, (fewest - 1) * capacity - total - waste)
        finally:
            left[longest] += 1
        return iter([with_longest(f, longest) for f in found])

    if bound >= fewest:
        return None, True
    try:
        stack = [branches()]
        while stack:
            whole = next(stack[-1], None)
            if whole is not None and waste + wasted(whole, capacity) <= (fewest - 1) * capacity - total:
                waste += wasted(whole, capacity)
                path.append(whole)
                for n, c in whole.items():
                    left[n] -= c
                    if not left[n]:
                        del left[n]
                if left and len(path) + least_bins(left, capacity) < fewest:
                    stack.append(branches())
                    continue
                if not left:  # the waste allowed makes these fewer bins
                    best, fewest = [tuple(sorted(w.items(), reverse=True)) for w in path], len(path)
                    if fewest == bound:
                        return best, True
            elif whole is None:
                stack.pop()
                if not path:
                    break
            else:
                continue
            whole = path.pop()
            waste -= wasted(whole, capacity)
            for n, c in whole.items():
                left[n] = left.get(n, 0) + c
        return best, True
    except Spent:
        return best, False


@dataclass(frozen=True)
class Packing:
    """Fillings with the times each is used; the bound that no packing can beat; whether these bins are proved to be the fewest."""

    bins: list[tuple[Filling, int]]
    bound: int
    proved: bool

    @property
    def number(self) -> int:
        return sum(times for _, times in self.bins)


def merged(bins: list[tuple[Filling, int]]) -> list[tuple[Filling, int]]:
    """Equal fillings together, fullest first."""
    times: dict[Filling, int] = {}
    for filling, n in bins:
        times[filling] = times.get(filling, 0) + n
    return sorted(times.items(), key=lambda b: (-sum(n * c for n, c in b[0]), b[0]))


def regrouped(bins: list[tuple[Filling, int]], capacity: int, rng: random.Random | None) -> tuple[list[tuple[Filling, int]], list[tuple[Filling, int]]]:
    """SEARCH_BINS bins, and the others: the most wasteful, or with a generator half of them from those and half from anywhere, no filling more than a few times."""
    order = sorted(range(len(bins)), key=lambda i: (-wasted(dict(bins[i][0]), capacity), i))
    if rng is not None:
        wasteful = order[: max(SEARCH_BINS, len(order) // 2)]
        order = rng.sample(wasteful, min(SEARCH_BINS // 2, len(wasteful)))
        others = [i for i in range(len(bins)) if i not in set(order)]
        order += rng.sample(others, len(others))
    group, rest, room = [], [], SEARCH_BINS
    for i in order:
        filling, times = bins[i]
        some = min(times, room, SEARCH_BINS if rng is None else 4)
        room -= some
        group += [(filling, some)] * bool(some)
        rest += [(filling, times - some)] * bool(times - some)
    return group, rest


def search(counts: dict[int, int], capacity: int = CAPACITY, most_nodes: int = SEARCH_NODES) -> Packing:
    """Pack the lengths into the fewest bins: best fit and a dive are the incumbents, then bins are completed by branch-and-bound.

    Up to SEARCH_BINS bins are searched whole: unless the nodes run out, the result is the optimum. Of
    more bins, groups of so many are searched anew, the most wasteful first and then others with them,
    again and again: tries that save nothing grow with the number of distinct lengths. The result is then
    proved only where it meets the bound. Nodes and tries bound the search, never what is packed.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    if not counts:
        return Packing([], 0, True)
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must be from 1 to the capacity")
    bound = least_bins(counts, capacity)

    def number(made: list[tuple[Filling, int]]) -> int:
        return sum(m for _, m in made)

    best = best_fit(counts, capacity)
    if number(best) > bound:
        best = min(best, dive_bins(counts, capacity), key=number)
    if number(best) == bound:
        return Packing(best, bound, True)
    whole, proved = number(best) <= SEARCH_BINS, False
    if whole:
        found, proved = complete_bins(counts, capacity, number(best), Nodes(most_nodes))
        best = best if found is None else [(f, 1) for f in found]
        return Packing(best, bound, number(best) == bound or proved)
    # of more bins, groups of SEARCH_BINS are completed anew, as long as that saves bins or tries are left
    rng, tries = random.Random(0), TRIES + len(counts) // 4
    each, failed = max(1, most_nodes // 8), 0
    while number(best) > bound and failed < tries:
        group, rest = regrouped(best, capacity, rng if failed else None)
        part: dict[int, int] = {}
        for filling, times in group:
            for n, c in filling:
                part[n] = part.get(n, 0) + c * times
        # no bin can go where the group's waste is less than one
        hopeless = number(group) * capacity - sum(n * c for n, c in part.items()) < capacity or least_bins(part, capacity) >= number(group)
        found = None if hopeless else complete_bins(part, capacity, number(group), Nodes(each))[0]
        best = best if found is None else merged(rest + [(f, 1) for f in found])
        failed = failed + 1 if found is None else 0
    return Packing(best, bound, number(best) == bound or whole and proved)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """The fillings of `search` with the times each is used."""
    return search(counts, capacity).bins


def slots(packing: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """Where the rows of each length go, by rank: (length, first rank, first bin, items of that length in a bin, offset)."""
    out, used, first = [], {}, 0
    for filling, times in packing:
        offset = 0
        for length, each in filling:
            out.append((length, used.get(length, 0), first, each, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        first += times
    out.sort()
    return dict(zip(("length", "rank", "bin", "each", "offset"), np.array(out, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to materialized pieces (doc_id, piece, length, ids_crc32, ...), and `proved`: whether fewer sequences are impossible.

    Ranks come from windows over (length, salt); lengths that many rows share get so many salts that
    no window holds more than about a thousandth of the rows (64 to a million), so neither a hot
    length nor a large group of copies meets in one task. Rows that are equal in all columns may trade
    places, which changes nothing. An empty table stays empty.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(hist.values())
    each = min(max(total // 1024, 64), 1_000_000)
    salts = spark.createDataFrame([(n, -(-c // each)) for n, c in sorted(hist.items())], "of_length long, salts long")  # at most `capacity` rows
    order = ["doc_id", "piece", "ids_crc32"]
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("of_length")).withColumn("salt", F.pmod(F.xxhash64(*order), F.col("salts"))).drop("of_length", "salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    ranked = salted.withColumn("own", own).join(parts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    packing = search(hist, capacity)
    shared = spark.sparkContext.broadcast(slots(packing.bins))
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        lead = np.searchsorted(s["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows = length == n
                at[rows] = lead[n] + np.searchsorted(s["rank"][lead[n] : lead[n + 1]], rank[rows], "right") - 1
            inside = rank - s["rank"][at]
            made = [s["bin"][at] + inside // s["each"][at], s["offset"][at] + inside % s["each"][at] * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x, pa.int64()) for x in made)], names=[*columns, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*columns, "rank").mapInArrow(thrifty(run, word_tokenizer), schema).withColumn("proved", F.lit(packing.proved))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False, **columns: str) -> DataFrame:
    """Pieces of docs with their sequence and offset. Repeated rows are packed each for itself; a null text is the end id alone; other columns of docs don't take part."""
    return pack(materialize(tokenize(docs, tokenizer_path, capacity, end, keep_ids, **columns), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with keep_ids: sequence_id, ids (binary), documents; at most `capacity` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.col("parts.doc_id").alias("documents"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "proved")
