"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

A merge list decides how far the text to the right of a place can still change whether that place is a token boundary.
A rule (u, v) fails to join at a place only when the last symbols of v were taken by an earlier rule (t, w), t being a
symbol on the right edge of v's derivation; that rule may in turn be undone by a still earlier one.  Ranks fall along
such a chain, so it ends, and its longest length in bytes is the *sufficient lookahead* (after Berglund and van der
Merwe, "Formalizing BPE Tokenization", 2023).  ``ByteBPE.lookahead`` computes it from the merge list in one pass.  The
transducer holds a window of that many bytes beyond what it emits; tokens that end before the window are final.

No rule joins across the end of a pre-token, so that end makes all before it stable at once, however near; the lookahead
is what decides inside a pre-token.  ``Transducer.run`` moves such a window over each text and is the only place that
emits tokens.  Runs that end within a window are merged many at a time, and the ids of short ones are remembered, up to
a fixed number; a run that outgrows the window is read on through ``ByteBPE.stream``.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

from mixlens.llm.pretokens import INNER_SPACE, SLICE, byte_level_pattern, slices
from mixlens.llm.shingles import _of_byte, _power, mix

#: Entries that each half of a worker's memo of finished parts holds before it becomes the older half, bytes of a
#: pre-token that is merged in bulk, and characters of windows that are worked on together.
MEMO_ENTRIES, SHORT, TOGETHER = 300_000, 64, 600_000
#: ASCII punctuation and symbols: a run of them after letters is one pre-token.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


_sure = mix(_of_byte)


@cache
def byte_symbols() -> dict[str, int]:
    """The published byte-to-character table: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level merge list with its ids."""

    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int], end: str = "") -> None:
        symbols, self.end = byte_symbols(), end
        self.vocab, self.added = vocab, added
        self.byte_id = [0] * 256
        for char, byte in symbols.items():
            self.byte_id[byte] = vocab[char]
        self.last_id = [vocab[c + end] for c, _ in sorted(symbols.items(), key=lambda x: x[1])] if end else self.byte_id
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: left id << 20 | right id -> rank << 20 | joined id
        self.join = {}
        for rank, (a, b) in enumerate(pairs):
            self.join.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.bytes_of = {i: bytes(symbols[c] for c in (t.removesuffix(end) if end else t)) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]

    @classmethod
    def from_json(cls, raw: bytes) -> ByteBPE:
        j = json.loads(raw)
        added = {t["content"]: t["id"] for t in j["added_tokens"]}
        return cls(j["model"]["vocab"], j["model"]["merges"], added, j["model"]["end_of_word_suffix"] or "")

    @property
    def lookahead(self) -> int:
        """Bytes beyond a place after which no text can change the tokens that end there."""
        if not hasattr(self, "_lookahead"):
            right: dict[int, int] = {c: b for _, b, c in self.pairs}
            reach: dict[int, int] = {}
            most = 0
            for a, b, _ in self.pairs:
                own, t = 0, b
                while t is not None:
                    own = max(own, reach.get(t, 0))
                    t = right.get(t)
                own += len(self.bytes_of[b])
                reach[a] = max(reach.get(a, 0), own)
                most = max(most, own)
            self._lookahead = most + max(map(len, self.bytes_of.values()))
        return self._lookahead

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge list to a short run of symbols."""
        get, none = self.join.get, 1 << 60
        while len(ids) > 1:
            found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
            low = min(found)
            if low == none:
                break
            at = found.index(low)
            ids[at : at + 2] = (low & 0xFFFFF,)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long run, in n log n."""
        n, get = len(ids), self.join.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r >> 20, i, r & 0xFFFFF, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r >> 20, i, r & 0xFFFFF, new, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, (r >> 20, h, r & 0xFFFFF, ids[h], new))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes | Iterable[bytes], block: int = 4096) -> Iterator[list[int]]:
        """Token ids of one pre-token, in lists, each as soon as it is stable.  Memory: a window of the lookahead plus
        two blocks, whatever the length of ``data``.  With an end-of-word suffix the last byte differs, which is known
        only at the end, so the window stays open until then."""
        held, hold, at = b"", self.lookahead + block, 0
        for more in [data] if isinstance(data, bytes) else data:
            held = held[at:] + more
            at = 0
            while len(held) - at > hold:
                end, stable = at, []
                for x in self.merge_long([self.byte_id[b] for b in held[at : at + hold]]):
                    if end + len(self.bytes_of[x]) > at + block:
                        break
                    end += len(self.bytes_of[x])
                    stable.append(x)
                at = end
                yield stable
        if len(held) > at:
            ids = [self.byte_id[b] for b in held[at:]]
            ids[-1] = self.last_id[held[-1]]
            yield self.merge(ids) if len(ids) <= SHORT else self.merge_long(ids)


class PairTable:
    """The merge list as an open-addressing table that numpy can search for many pairs at once."""

    BITS = 18

    def __init__(self, join: dict[int, int]) -> None:
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NONE, np.int64)
        self.joined = np.zeros(max(v >> 20 for v in join.values()) + 1, np.int64)
        for key, value in join.items():
            at = self.place(key)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.ranks[at] = key, value >> 20
            self.joined[value >> 20] = value & 0xFFFFF

    def place(self, key):
        return ((key * 0x9E3779B1) >> 13 ^ key) & ((1 << self.BITS) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = self.place(key)
        out = np.where((found := self.keys[at]) == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


#: A rank that no rule has.
NONE = 1 << 28


def merge_many(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short runs of symbols at once, one join a run and round, runs that are done leaving.  Returns the ids
    of all runs in order and their numbers."""
    counts, who = lengths.copy(), np.arange(len(lengths))
    done_ids: list[np.ndarray] = []
    done_who: list[np.ndarray] = []
    n = lengths.copy()
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(n) - 1] = True
    ranks = np.full(len(symbols), NONE, np.int64)
    if len(symbols) > 1:
        ranks[:-1] = np.where(last[:-1], NONE, table.rank(symbols[:-1], symbols[1:]))
    while len(who):
        starts = np.cumsum(n) - n
        low = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), starts)
        live = (low >> 32) < NONE
        if np.count_nonzero(live) <= 0.75 * len(who):
            member = np.repeat(live, n)
            done_ids.append(symbols[~member])
            done_who.append(np.repeat(who[~live], n[~live]))
            counts[who[~live]] = n[~live]
            moved = np.cumsum(member) - 1
            symbols, ranks, last, who, n, low = symbols[member], ranks[member], last[member], who[live], n[live], low[live]
            at, live = moved[low & 0xFFFFFFFF], live[live]
        else:
            at = (low & 0xFFFFFFFF)[live]
        if not len(who):
            break
        symbols[at] = table.joined[low[live] >> 32]
        last[at] |= last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        at = (np.cumsum(keep) - 1)[at]
        symbols, ranks, last = symbols[keep], ranks[keep], last[keep]
        n[live] -= 1
        ranks[at] = NONE
        inner = at[~last[at]]
        ranks[inner] = table.rank(symbols[inner], symbols[inner + 1])
        inner = at[at > 0]
        inner = inner[~last[inner - 1]]
        ranks[inner - 1] = table.rank(symbols[inner - 1], symbols[inner])
    ids, whose = np.concatenate([*done_ids, np.zeros(0, np.int64)]), np.concatenate([*done_who, np.zeros(0, np.int64)])
    return ids[np.argsort(whose, kind="stable")], counts


class Engine:
    """Ids of many distinct pre-tokens at once."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe, self.table = bpe, PairTable(bpe.join)
        self.first, self.last = np.array(bpe.byte_id, np.int64), np.array(bpe.last_id, np.int64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For non-empty words of at most SHORT bytes: all ids, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, ends = self.first[data], np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return merge_many(self.table, symbols, lengths)


def ragged(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` values from ``at`` on, one after the other."""
    return values[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Memo:
    """Ids of finished parts by 128 bits of their bytes: sorted tables, each more than twice as large as the next."""

    def __init__(self) -> None:
        self.tables: list[tuple[np.ndarray, ...]] = []
        self.ids, self.used, self.size = np.zeros(1 << 16, np.uint32), 0, 0

    def look(self, key: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each key, the number -1 where it isn't held."""
        at, n = np.zeros(len(key), np.int64), np.full(len(key), -1, np.int64)
        for keys, sures, places, numbers in self.tables:
            open_ = np.flatnonzero(n < 0)
            found = np.minimum(np.searchsorted(keys, key[open_]), len(keys) - 1)
            hit = (keys[found] == key[open_]) & (sures[found] == sure[open_])
            at[open_[hit]], n[open_[hit]] = places[found[hit]], numbers[found[hit]]
        return at, n

    def add(self, key: np.ndarray, sure: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Keys (ascending) that aren't held, with their ids one after the other."""
        if not len(key):
            return
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        new = (key, sure, self.used + np.cumsum(n) - n, n)
        self.used, self.size = self.used + len(ids), self.size + len(key)
        while self.tables and len(self.tables[-1][0]) <= 2 * len(new[0]):
            both = [np.concatenate(x) for x in zip(self.tables.pop(), new, strict=True)]
            order = np.argsort(both[0], kind="stable")
            new = tuple(x[order] for x in both)
        self.tables.append(new)


class Transducer:
    """Whole texts to ids, packed as little-endian unsigned 32-bit integers, a window at a time."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe, self.engine = bpe, Engine(bpe)
        self.pattern = byte_level_pattern()
        self.find, self.added = self.pattern.findall, added_pattern(bpe.added)
        #: What was met since the memo last turned, and what was met before.
        self.memo, self.older = Memo(), Memo()
        #: Tokens that have left the window, and windows that a run outgrew.
        self.emitted = self.outgrown = 0

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts that are whole pre-tokens, and how many each has.  A space and letters are one pre-token; with
        ASCII marks after them two; what is neither is left to the pattern."""
        words: dict[str, int] = {}
        number = lambda w: words.setdefault(w, len(words))
        held, count = [], []
        for part in parts:
            base = part.rstrip(MARKS)
            if base[1:].isalpha() and base[0] == " ":
                held.append(number(base))
                if base is not part and len(base) < len(part):
                    held.append(number(part[len(base) :]))
                    count.append(2)
                else:
                    count.append(1)
            else:
                found = self.find(part)
                held.extend(map(number, found))
                count.append(len(found))
        data = [w.encode() for w in words]
        short = np.array([len(d) <= SHORT for d in data], bool)
        runs = [d for d in data if len(d) <= SHORT]
        ids, n = self.engine(runs) if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        size, place = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        size[short], place[short] = n, np.cumsum(n) - n
        for k in np.flatnonzero(~short).tolist():
            long = [x for more in self.bpe.stream(data[k]) for x in more]
            place[k], size[k] = len(ids), len(long)
            ids = np.concatenate([ids, np.array(long, np.int64)])
        held, count = np.array(held, np.int64), np.array(count, np.int64)
        total = np.concatenate([[0], np.cumsum(size[held])])
        ends = np.cumsum(count)
        return ragged(ids, place[held], size[held]).astype(np.uint32), total[ends] - total[ends - count]

    def _merge_windows(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of windows that begin and end with a pre-token.  A window is cut into parts that are whole pre-tokens,
        at its spaces or, where spaces stand beside white space, at its pre-tokens; equal parts are looked up or learnt
        once.  The memo has two halves: a full one becomes the older, and of that one what is met again moves to the new."""
        if not pieces:
            return []
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [b""] * len(pieces)
        size = np.array([len(r) for r in raw], np.int64)
        piece_at = np.cumsum(size) - size
        first = data == 32
        first[piece_at[size > 0]] = True
        for k, piece in enumerate(pieces):
            if INNER_SPACE.search(piece):
                own = first[piece_at[k] : piece_at[k] + size[k]]
                own[:] = False
                own[np.cumsum([0, *(len(w.encode()) for w in self.find(piece)[:-1])])] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        power, inverse = _power(len(data) + 1)
        keys = []
        for table in (_of_byte, _sure):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * power[: len(data)], out=sums[1:])
            keys.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
        key, which, whose = np.unique(keys[0], return_index=True, return_inverse=True)
        sure = keys[1][which]
        if not np.array_equal(sure[whose], keys[1]):  # two parts under one key: each for itself
            which, whose = np.arange(len(start)), np.arange(len(start))
            at, n, held = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64), None
        else:
            at, n = self.memo.look(key, sure)
            held = self.memo.ids
        lost = np.flatnonzero(n < 0)
        new_n = np.zeros(0, np.int64)
        new_ids = np.zeros(0, np.uint32)
        if len(lost):
            old_at, old_n = self.older.look(key[lost], sure[lost]) if held is not None else (np.zeros(len(lost), np.int64), np.full(len(lost), -1, np.int64))
            fresh = np.flatnonzero(old_n < 0)
            whole = data.tobytes()
            ids, count = self._learn([whole[a:b].decode() for a, b in zip(start[which[lost[fresh]]].tolist(), end[which[lost[fresh]]].tolist(), strict=True)])
            place, new_n = old_at.copy(), old_n.copy()
            place[fresh], new_n[fresh] = self.older.used + np.cumsum(count) - count, count
            new_ids = ragged(np.concatenate([self.older.ids[: self.older.used], ids]), place, new_n)
            if held is not None:
                self.memo.add(key[lost], sure[lost], new_ids, new_n)
        own_at = at.copy()
        source = np.concatenate([new_ids, held[: self.memo.used]]) if held is not None else new_ids
        own_at += len(new_ids)
        own_at[lost] = np.cumsum(new_n) - new_n
        n[lost] = new_n
        out = ragged(source, own_at[whose], n[whose]).astype("<u4").tobytes()
        bound = 4 * np.concatenate([[0], np.cumsum(n[whose])])
        cut = bound[np.searchsorted(start, np.append(piece_at, len(data)))].tolist()
        if self.memo.size >= MEMO_ENTRIES:
            self.older, self.memo = self.memo, Memo()
        return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def windows(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """The windows of a text in order: start, end, and the id of an added token, or -1 for a run that outgrows the
        window, or None."""
        for start, end, special in sections(text, self.added, self.bpe.added):
            for a, b in slices(text, start, end):
                if b - a <= 2 * SLICE:
                    yield a, b, None
                    continue
                at = a
                while at < b:  # no safe cut in sight: pre-token by pre-token
                    stop = at
                    while stop < b and (m := self.pattern.match(text, stop, b)) and m.end() - at <= SLICE:
                        stop = m.end()
                    if stop > at:
                        yield at, stop, None
                    if stop < b and m.end() - stop > SLICE:
                        yield stop, m.end(), -1
                        stop = m.end()
                    at = stop
            if special is not None:
                yield end, end, special

    def run(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """Number of the text and packed ids, in order, as they become stable: windows of TOGETHER characters in all are
        held at a time, however many or long the texts."""
        held: list[tuple[int, str | int]] = []
        size = 0

        def settle() -> Iterator[tuple[int, bytes]]:
            done = iter(self._merge_windows([w for _, w in held if isinstance(w, str)]))
            for k, w in held:
                packed = next(done) if isinstance(w, str) else array("I", [w]).tobytes()
                self.emitted += len(packed) // 4
                yield k, packed

        for k, text in enumerate(texts):
            for a, b, what in self.windows(text or ""):
                if what == -1:
                    yield from settle()
                    held, size = [], 0
                    self.outgrown += 1
                    for ids in self.bpe.stream(text[c : min(c + 4096, b)].encode() for c in range(a, b, 4096)):
                        self.emitted += len(ids)
                        yield k, array("I", ids).tobytes()
                    continue
                held.append((k, text[a:b] if what is None else what))
                size += b - a
                if size >= TOGETHER:
                    yield from settle()
                    held, size = [], 0
        yield from settle()

    def encode(self, text: str | None) -> bytes:
        return b"".join(packed for _, packed in self.run([text]))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        for k, packed in self.run(texts):
            out[k].append(packed)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def added_pattern(added: dict[str, int]) -> re.Pattern | None:
    """The added tokens, of those that begin at a place the longest first."""
    return re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None


def sections(text: str, pattern: re.Pattern | None, added: dict[str, int]) -> Iterator[tuple[int, int, int | None]]:
    """Start and end of what lies between added tokens, each with the id of the token that follows it (None after the
    last), in one scan."""
    at = 0
    for m in pattern.finditer(text) if pattern else ():
        yield at, m.start(), added[m[0]]
        at = m.end()
    yield at, len(text), None


class Decoder:
    """Ids to text, a block at a time: an incremental UTF-8 machine that holds at most three bytes between blocks and
    replaces what isn't UTF-8 by U+FFFD."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bytes_of = bpe.table
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes, last: bool = False) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


_loaded: dict[int, Transducer] = {}


def worker_transducer(raw: bytes) -> Transducer:
    """One transducer a worker process and vocabulary file."""
    if hash(raw) not in _loaded:
        _loaded[hash(raw)] = Transducer(ByteBPE.from_json(raw))
    return _loaded[hash(raw)]
