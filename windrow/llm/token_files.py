"""Token ids of whole texts in compressed files: Re-Pair grammars over blocks in ascending doc_id order.

Rows are range-partitioned and sorted by doc_id; each task encodes its texts in blocks of bounded size, a block being
the shard that one grammar covers. Each round replaces the most frequent pairs of neighbouring ids, all at once and
without overlap, by nonterminals, until no pair stands twice; no rule holds the end id, so every document remains a
run of its own. A block stores

    magic "RPG2", bits of a symbol (uint8), counts (rules, symbols, documents: uint32, ids: uint64), little-endian,
    steps between the left sides of the rules (2 n for n, 2 n - 1 for -n), expansion lengths of the rules, symbols of
    each document, each number in groups of seven bits,
    right sides of the rules, symbols, each run in the bits of a symbol and from a byte of its own

With the expansion lengths any document or id is found and decoded without the rest of the
block. Blocks are rows of Parquet files in the shared folder, so that writing commits as a whole and survives lost
executors; each row also says how many ids its task wrote before it, so that reading needs no shuffle of blocks.

Texts are cut as the tokenizer's own byte-level pattern cuts them, all texts of a slice at once; kinds of characters are
asked of the tokenizer. Each distinct piece is encoded once (and kept in a bounded table, found by a hash and compared
in full). With a tokenizer that cuts otherwise, texts are encoded whole.

Cases: null and empty texts are the end id alone; special strings in a text are ordinary text; repeated rows are
written each; rows of one id stand in the order of their texts' hashes and texts; null ids come first; very long texts
fill a block of their own; an empty table writes an empty file; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import id_text, mix64, offsets, slices
from windrow.session import materialise

HEAD = struct.Struct("<4sBIIIQ")
MAGIC = b"RPG2"
BLOCK_CHARS = 4_000_000
#: Texts are cut and looked up together up to so many characters.
SLICE_CHARS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Fixed values of the byte-level pattern: endings that an apostrophe takes with it.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: A text that shows whether a tokenizer cuts by the byte-level pattern.
PROBE = "I'll say: it's  they've \n\n 'tis rock'n'roll, don't\t 42 x7y \u00e9t\u00e9 !?'s 'sam'm ''d\r\n  end  "


class Encoder:
    """The tokenizers library, asked once for each distinct piece that its pattern cuts."""

    def __init__(self, path: str, most: int = 800_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.most = most
        self.power, self.inverse = np.ones(0, np.uint64), np.ones(0, np.uint64)
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        newline = self._ask(["\n"])[0]
        self.newline = newline[0]
        self.cuts = len(newline) == 1 and self._cuts()
        self._forget()

    def _cuts(self) -> bool:
        """Whether the tokenizer cuts PROBE as the pattern does."""
        if self.tokenizer.pre_tokenizer is None or self.tokenizer.normalizer is not None:
            return False
        points = _points(PROBE)
        begin = self._begins(points, np.array([0, len(points)])).tolist()
        return [tuple(x) for _, x in self.tokenizer.pre_tokenizer.pre_tokenize_str(PROBE)] == list(zip(begin, [*begin[1:], len(PROBE)], strict=True))

    def _forget(self) -> None:
        """An empty table: hashes of pieces by open addressing; where their characters and ids lie, and their uses."""
        bits = max(12, (4 * self.most).bit_length())
        self.shift, self.key, self.slot = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.n = 0
        self.hashes = np.zeros(1 << 16, np.uint64)
        self.starts, self.sizes, self.begins, self.lengths, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(5))
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.chars, self.held = np.zeros(1 << 18, np.uint32), 0

    def _add(self, h: np.ndarray, lengths: np.ndarray, points: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        at, n = self.n, len(h)
        while at + n > len(self.starts):
            names = ("hashes", "starts", "sizes", "begins", "lengths", "uses")
            for name in names:
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + len(points) > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        new = slice(at, at + n)
        self.hashes[new], self.sizes[new], self.lengths[new] = h, sizes, lengths
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.begins[new] = self.held + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.chars[self.held : self.held + len(points)] = points
        self.used, self.held, self.n = self.used + len(ids), self.held + len(points), at + n
        left, spot = np.arange(at, at + n, dtype=np.int32), (h >> self.shift).astype(np.int64)
        while len(left):
            free = self.slot[spot] < 0
            self.slot[spot[free]] = left[free]  # of those that meet the last one stays
            self.key[spot[free]] = self.hashes[self.slot[spot[free]]]
            out = self.slot[spot] != left
            left, spot = left[out], (spot[out] + 1) & (len(self.slot) - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Where the table holds each hash, or -1."""
        spot = (h >> self.shift).astype(np.int64)
        place = self.slot[spot]
        open_ = np.flatnonzero((place >= 0) & (self.key[spot] != h))
        while len(open_):
            spot[open_] = (spot[open_] + 1) & (len(self.slot) - 1)
            place[open_] = self.slot[spot[open_]]
            open_ = open_[(place[open_] >= 0) & (self.key[spot[open_]] != h[open_])]
        return place

    def _shrink(self) -> None:
        """Keep only the pieces that were used twice or more, most used first, up to half of the table."""
        kept = np.flatnonzero(self.uses[: self.n] > 1)
        kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most // 2]])
        (ids, at), (points, ends) = _runs(self.flat, self.starts[kept], self.sizes[kept]), _runs(self.chars, self.begins[kept], self.lengths[kept])
        h = self.hashes[kept]
        self._forget()
        self._add(h, np.diff(ends), points, np.diff(at), ids)

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_kinds(self, points: np.ndarray) -> None:
        """A character is of the kind of those with which it makes one piece."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in np.unique(points).tolist():
            same = (kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(before + chr(c))) == 1)
            self.kind[c] = next(same, SPACE)

    def _begins(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of all texts begin: runs of one kind, with one space before them; of more blanks before a run
        the last is a piece by itself unless it is that space; an apostrophe that begins a piece takes its ending."""
        kind = self.kind[points]
        new = np.flatnonzero(kind == UNKNOWN)
        if len(new):
            self._learn_kinds(points[new])
            kind = self.kind[points]
        n = len(points)
        fresh = np.zeros(n + 1, bool)
        fresh[at] = True
        begin = np.ones(n + 3, bool)
        begin[1:n] = (kind[1:] != kind[:-1]) | fresh[1:n]
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
        begin[after - 1] = True
        begin[after[points[after - 1] == 32]] = False
        mark = np.flatnonzero(points == 39)
        mark = mark[begin[mark] & ~fresh[mark + 1]]
        mark = mark[kind[mark + 1] == LETTER]
        one = points[mark + 1]
        two = np.where(fresh[np.minimum(mark + 2, n)], 0, points[np.minimum(mark + 2, n - 1)])
        for ending in ENDINGS:
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            begin[mark[hit] + 1] = False
            begin[mark[hit] + 1 + len(ending)] = True
        return np.flatnonzero(begin[:n])

    def _hash(self, points: np.ndarray, begin: np.ndarray, long: np.ndarray) -> np.ndarray:
        """A 64-bit number a piece, from sums of characters times powers of one odd number."""
        if len(self.power) <= len(points):
            grow = 2 * len(points) + 1024
            base = 0x9E3779B97F4A7C15
            self.power, self.inverse = (np.full(grow, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            self.power[0] = self.inverse[0] = 1
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.power[: len(points)], out=total[1:])
        return mix64((total[begin + long] - total[begin]) * self.inverse[begin] + long.astype(np.uint64))

    def _learn(self, words: list[str], groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of new pieces, group by group: those with a space before them many to a text, as each
        begins with a spaced id; others many to a text with a line break before each; blanks alone."""
        sizes, ids = [], []
        for group, before in zip(groups[:2], ("", "\n"), strict=True):
            named = [before + words[i] for i in group.tolist()]
            found = self._ask(["".join(named[i : i + 250]) for i in range(0, len(named), 250)])
            flat = np.fromiter(chain.from_iterable(found), np.int32)
            first = flat == self.newline if before else self.spaced[flat]
            many = np.diff(np.append(np.flatnonzero(first), len(flat)))
            if len(many) != len(group) or len(flat) and not first[0]:
                raise ValueError("the tokenizer does not encode pieces by themselves")
            sizes.append(many - 1 if before else many)
            ids.append(flat[~first] if before else flat)
        alone = self._ask([words[i] for i in groups[2].tolist()])
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        ids.append(np.fromiter(chain.from_iterable(alone), np.int32))
        return np.concatenate(sizes), np.concatenate(ids)

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the starts of the texts."""
        if not self.cuts:
            found = self._ask(texts)
            return np.fromiter(chain.from_iterable(found), np.int32), offsets(map(len, found))
        if self.n > self.most:
            self._shrink()
        joined = "".join(texts)
        points, at = _points(joined), offsets(map(len, texts))
        if not joined:
            return np.zeros(0, np.int32), at
        begin = self._begins(points, at)
        long = np.diff(np.append(begin, len(points)))
        h = self._hash(points, begin, long)
        place = self._find(h)
        gaps = np.flatnonzero(place < 0)
        if len(gaps):
            new, first, which = np.unique(h[gaps], return_index=True, return_inverse=True)
            first = gaps[first]
            a, b = begin[first], begin[first] + long[first]
            words = [joined[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            blank = self.kind[points[b - 1]] == SPACE
            spaced = (points[a] == 32) & ~blank
            groups = [np.flatnonzero(g) for g in (spaced, ~spaced & ~blank, blank)]
            order = np.concatenate(groups)
            sizes, ids = self._learn(words, groups)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place[gaps] = self.n + rank[which]
            self._add(new[order], long[first[order]], _runs(points, a[order], (b - a)[order])[0], sizes, ids)
        uses = np.bincount(place, minlength=self.n)
        self.uses[: self.n] += uses
        out, ends = _runs(self.flat, self.starts[place], self.sizes[place])
        ends = ends[np.searchsorted(begin, at)]
        wrong = np.flatnonzero(self.lengths[place] != long)
        if not len(wrong):
            other = np.flatnonzero(_runs(self.chars, self.begins[place], long)[0] != points)
            wrong = np.searchsorted(begin, other, side="right") - 1
        if len(wrong):  # two pieces of one hash: nothing of this slice is taken from the table
            found = self._ask(texts)
            return np.fromiter(chain.from_iterable(found), np.int32), offsets(map(len, found))
        return out, ends

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and the starts of the texts."""
        ids, sizes, first, held = [], [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= SLICE_CHARS or i + 1 == len(texts):
                own, at = self._slice(texts[first : i + 1])
                ids.append(own)
                sizes.append(np.diff(at))
                first, held = i + 1, 0
        at = offsets(np.concatenate(sizes)) if sizes else np.zeros(1, np.int64)
        out = np.full(int(at[-1]) + len(texts), end, np.int32)
        mask = np.ones(len(out), bool)
        mask[at[1:] + np.arange(len(texts))] = False
        out[mask] = np.concatenate(ids) if ids else []
        return out, at + np.arange(len(texts) + 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` one after another, and their starts."""
    at = offsets(sizes)
    return flat[np.arange(int(at[-1])) + np.repeat(starts - at[:-1], sizes)], at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- grammar --------------------------------------------------------------------------------------------------


#: Codes of pairs hold the right side in so many bits, and the left side above them.
WIDE = 31


def _tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each stands."""
    ordered = np.sort(codes)
    edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return ordered[edge], np.diff(np.append(edge, len(ordered)))


def _apart(same: np.ndarray) -> np.ndarray:
    """Of the places of pairs of one id every second one of a run, from its start, so that none overlaps another."""
    if not len(same):
        return same
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(same) > 1]), same, 0))
    return same[(same - begin) % 2 == 0]


def _among(codes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The place of each code in ``chosen`` (in order), or -1: by one look at a table of hashes, and by search where two of
    the chosen met there."""
    bits = max(8, (8 * len(chosen)).bit_length())
    odd, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)

    def hashed(x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * odd >> shift).view(np.int64)

    table, met = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
    own = hashed(chosen)
    table[own] = np.arange(len(chosen))
    met[own[table[own] != np.arange(len(chosen))]] = True
    spot = hashed(codes)
    k = table[spot]
    miss = chosen[k] != codes
    k[miss] = -1
    again = np.flatnonzero(miss & met[spot])
    found = np.minimum(np.searchsorted(chosen, codes[again]), len(chosen) - 1)
    hit = chosen[found] == codes[again]
    k[again[hit]] = found[hit]
    return k


def _choose(codes: np.ndarray, times: np.ndarray, least: int, size: int) -> np.ndarray:
    """Pairs that stand ``least`` times, of which none overlaps another: every symbol takes the side (or, in a pair of one
    symbol, both) that it has in the most frequent pair that holds it, and what fits these sides is chosen too."""
    often = np.flatnonzero(times >= least)
    codes = codes[often[np.argsort(-times[often], kind="stable")]]
    a, b = codes >> WIDE, codes & (1 << WIDE) - 1
    role, chosen = np.zeros(size, np.uint8), []
    while len(codes):
        rank = np.arange(len(codes))
        lefts, rights = np.full(size, len(codes)), np.full(size, len(codes))
        lefts[a[::-1]], rights[b[::-1]] = rank[::-1], rank[::-1]  # of several the first stays
        twin = a == b
        ok = np.where(twin, (lefts[a] == rank) & (rights[a] == rank), (lefts[a] < rights[a]) & (rights[b] < lefts[b]))
        chosen.append(codes[ok])
        role[a[ok]] |= 1
        role[b[ok]] |= 2
        rest = ~ok & np.where(twin, role[a] == 0, (role[a] < 2) & (role[b] & 1 == 0))
        codes, a, b = codes[rest], a[rest], b[rest]
    return np.sort(np.concatenate(chosen))


def compress(ids: np.ndarray, end: int, base: int, least: int = 2, share: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, and the left and right sides of the rules; rule k is symbol base + k.

    Rounds go on until no pair stands ``least`` times; each takes pairs that stand at least ``share`` times as often as
    the most frequent one. Pairs are counted in full once, then only around what a round replaced: a pair of known
    symbols never gains. Pairs of one id are counted anew, as they overlap in runs."""
    seq = ids.astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def pair(at: np.ndarray) -> np.ndarray:
        return (seq[at] << WIDE) + seq[at + 1]

    def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of two ids that stand ``least`` times, how often, and where a pair of one id is. Sides may be changed."""
        inner, same = a != end, a == b
        twin = np.flatnonzero(same & inner)
        inner &= b != end
        inner &= ~same
        a <<= WIDE
        a += b
        found, n = _tally(a[inner])
        often = n >= least
        return found[often], n[often], twin

    known, times, twin = counted(seq[:-1].copy(), seq[1:])
    made = 0
    while True:
        twins = _apart(twin)
        same, often = _tally(pair(twins))
        codes, n = np.concatenate([known, same]), np.concatenate([times, often])
        best = int(n.max(initial=0))
        if best < least:
            break
        chosen = _choose(codes, n, max(least, int(best * share)), base + made)
        a, b = chosen >> WIDE, chosen & (1 << WIDE) - 1
        role = np.zeros(base + made, np.uint8)
        role[a] |= 1
        role[b] |= 2
        part = role.take(seq)
        spot = np.flatnonzero((part[:-1] & part[1:] >> 1 & 1).view(bool))
        code = pair(spot)
        k = _among(code, chosen)
        hit = k >= 0
        spot, k = spot[hit], k[hit]
        if (a == b).any():
            hit = (a != b)[k] | np.isin(spot, twins, assume_unique=True)
            spot, k = spot[hit], k[hit]
        joint = np.append(np.diff(spot) == 2, False)  # the pair after it is the pair before the next
        before, after = spot[~np.append(False, joint[:-1])] - 1, spot + 1
        around = np.concatenate([before[before >= 0], after[after < len(seq) - 1]])
        gone, lost = _tally(pair(around))
        gone, lost = np.concatenate([gone, chosen]), np.concatenate([lost, np.bincount(k, minlength=len(chosen))])
        if len(known):
            at = np.minimum(np.searchsorted(known, gone), len(known) - 1)
            hit = known[at] == gone
            np.subtract.at(times, at[hit], lost[hit])
        seq[spot] = base + made + k
        keep = np.ones(len(seq), bool)
        keep[spot + 1] = False
        seq = seq[keep]
        twin -= np.searchsorted(spot, twin)  # a place at or behind the right side of a pair moves
        spot -= np.arange(len(spot))
        before = spot[~np.append(False, joint[:-1])] - 1
        around = np.concatenate([before[before >= 0], spot[spot < len(seq) - 1]])
        fresh, n, new = counted(seq[around], seq[around + 1])
        twin = twin[twin < len(seq) - 1]
        twin = twin[seq[twin] == seq[twin + 1]]  # of no end ids: those never come anew
        twin = np.concatenate([twin, around[new]])
        twin.sort()
        twin = twin[np.diff(twin, prepend=-1) > 0]
        still = times >= least
        known, times = np.concatenate([known[still], fresh]), np.concatenate([times[still], n])
        order = np.argsort(known, kind="stable")
        known, times = known[order], times[order]
        left.append(a)
        right.append(b)
        made += len(chosen)
    return seq, np.concatenate(left), np.concatenate(right)


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids below each rule; a rule only names rules before it."""
    length = np.ones(base + len(left), np.int64)
    done = 0
    while done < len(left):  # rules up to the first that names one not done yet
        late = np.maximum(left[done:], right[done:]) >= base + done
        upto = done + (int(np.argmax(late)) if late.any() else len(late))
        length[base + done : base + upto] = length[left[done:upto]] + length[right[done:upto]]
        done = upto
    return length[base:]


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int, length: np.ndarray | None = None) -> np.ndarray:
    """Ids of a run of symbols: each nonterminal gives its sides the places that their lengths say, level by level."""
    below = np.concatenate([np.ones(base, np.int64), expansion_lengths(left, right, base) if length is None else length])
    at = offsets(below[symbols])
    out = np.empty(int(at[-1]), np.int64)
    seq, at = symbols.astype(np.int64), at[:-1]
    while len(seq):
        plain = seq < base
        out[at[plain]] = seq[plain]
        rule, at = seq[~plain] - base, at[~plain]
        seq = np.concatenate([left[rule], right[rule]])
        at = np.concatenate([at, at + below[left[rule]]])
    return out


def _packed(x: np.ndarray, bits: int) -> bytes:
    """Numbers in ``bits`` bits each, highest bit first, from a new byte."""
    out = []
    for at in range(0, len(x), 1 << 18):  # a multiple of 8 numbers ends with a byte
        rows = np.unpackbits(x[at : at + (1 << 18)].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
        out.append(np.packbits(rows).tobytes())
    return b"".join(out)


def _unpacked(raw: bytes, spot: int, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` numbers of ``bits`` bits from the ``first`` one of a run that begins at byte ``spot``."""
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 17):
        many = min(1 << 17, n - at)
        begin = (first + at) * bits
        bytes_ = np.frombuffer(raw, np.uint8, ((begin % 8) + many * bits + 7) // 8, spot + begin // 8)
        rows = np.zeros((many, 32), np.uint8)
        rows[:, 32 - bits :] = np.unpackbits(bytes_)[begin % 8 : begin % 8 + many * bits].reshape(many, bits)
        out[at : at + many] = np.packbits(rows).view(">u4")
    return out


def _varied(x: np.ndarray) -> bytes:
    """Numbers in as few groups of seven bits as each takes, lowest first; all but the last have the high bit."""
    many = np.ones(len(x), np.int64)
    for k in range(1, 5):
        many += x >> 7 * k > 0
    at = offsets(many)
    step = np.arange(int(at[-1])) - np.repeat(at[:-1], many)
    return (np.repeat(x, many) >> 7 * step & 127 | (step + 1 < np.repeat(many, many)) * 128).astype(np.uint8).tobytes()


def _single(raw: bytes, spot: int, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers from byte ``spot``, and the byte after them."""
    bytes_ = np.frombuffer(raw, np.uint8, min(5 * n, len(raw) - spot), spot)
    last = np.flatnonzero(bytes_ < 128)[:n]
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    size = int(last[-1]) + 1 if n else 0
    step = np.arange(size) - np.repeat(first, last + 1 - first)
    return np.add.reduceat((bytes_[:size] & 127).astype(np.int64) << 7 * step, first) if n else np.zeros(0, np.int64), spot + size


def pack(ids: np.ndarray, at: np.ndarray, end: int, base: int) -> bytes:
    """A block of documents whose ids lie one after another, starting at ``at``."""
    symbols, left, right = compress(ids, end, base)
    length = expansion_lengths(left, right, base)
    below = np.concatenate([np.ones(base, np.int64), length])
    places = offsets(below[symbols])
    starts = np.searchsorted(places, at)
    bits = (base + len(left)).bit_length()
    step = np.diff(left, prepend=0)
    step = np.where(step < 0, -2 * step - 1, 2 * step)  # rules of a round stand in the order of their left sides
    head = HEAD.pack(MAGIC, bits, len(left), len(symbols), len(at) - 1, len(ids))
    return head + _varied(step) + _varied(length) + _varied(np.diff(starts)) + _packed(right, bits) + _packed(symbols, bits)


class Block:
    """A packed block, read in place."""

    def __init__(self, raw: bytes, base: int) -> None:
        magic, self.bits, rules, self.n_symbols, self.n_docs, self.n_ids = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        self.raw, self.base = raw, base
        step, spot = _single(raw, HEAD.size, rules)
        self.left = np.cumsum(np.where(step % 2, -(step + 1) // 2, step // 2))
        self.length, spot = _single(raw, spot, rules)
        sizes, spot = _single(raw, spot, self.n_docs)
        self.starts = offsets(sizes)
        self.right = _unpacked(raw, spot, self.bits, 0, rules)
        self.spot = spot + (self.bits * rules + 7) // 8

    def symbols(self, a: int = 0, b: int | None = None) -> np.ndarray:
        return _unpacked(self.raw, self.spot, self.bits, a, (self.n_symbols if b is None else b) - a)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, without touching the symbols of the others."""
        return expand(self.symbols(int(self.starts[i]), int(self.starts[i + 1])), self.left, self.right, self.base, self.length)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and the starts of the documents, from the expansion lengths."""
        symbols = self.symbols()
        below = np.concatenate([np.ones(self.base, np.int64), self.length])
        return expand(symbols, self.left, self.right, self.base, self.length), offsets(below[symbols])[self.starts]


# -- files ----------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str | None = None, end: int = 2, base: int = 50_257) -> DataFrame:
    """Blocks in ascending doc_id order: part, block, before (ids of the part's blocks before it), n_ids, doc_ids, payload.

    Written, and read from the files."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = pa.schema(
            [*((c, pa.int64()) for c in ("part", "block", "before", "n_ids")), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())]
        )
        number = before = 0
        for ids, texts in _joined(slices(batches, BLOCK_CHARS)):
            tokens, at = encoder(path).encode(texts, end)
            yield pa.record_batch([[part], [number], [before], [len(tokens)], [ids], [pack(tokens, at, end, base)]], schema=kind)
            number, before = number + 1, before + len(tokens)

    keyed = id_text(docs).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part long, block long, before long, n_ids long, doc_ids array<long>, payload binary"), "tokens")


def _joined(pieces: Iterator[tuple[list, list[str]]]) -> Iterator[tuple[list, list[str]]]:
    """Pieces of small Arrow batches put together up to a block's size."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for i, t in pieces:
        size = sum(map(len, t))
        if ids and held + size > BLOCK_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids, texts, held = ids + i, texts + t, held + size
    if ids:
        yield ids, texts


def read(blocks: DataFrame, base: int = 50_257) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row a task
    earlier, total = [], 0
    for p, n in parts:
        earlier.append((p, total))
        total += n
    table = blocks.sparkSession.createDataFrame(earlier or [(0, 0)], "p long, earlier long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, at = Block(batch.column(2)[row].as_py(), base).all()
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = batch.column(0)[row].as_py() + at[:-1]
                columns = [batch.column(1)[row].values, pa.array(start), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(table), F.col("part") == F.col("p"))
    placed = placed.select((F.col("earlier") + F.col("before")).alias("at"), "doc_ids", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
