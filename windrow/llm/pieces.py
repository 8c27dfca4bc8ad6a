"""SentencePiece segmentation and decoding over the piece lattice of a public model, with the N best segmentations.

Each place between characters is a node, each piece of the vocabulary that a run of characters spells is an edge;
characters no piece spells are one edge of their byte pieces. A forward Viterbi pass gives every node the best score of
reaching it; a backward A* search from the end, which adds that score as its heuristic, is exact, so segmentations come
out in descending order of score. No piece crosses from a character to a following space mark, so a text's lattice is a
chain of its words' lattices: each distinct word is searched once (and kept in a bounded table), and the N best of the
text are the best sums over the few words with the smallest loss for their second choice.

The model stores merge ranks, not probabilities, so a piece of rank r scores -ln(1 + r) (Zipf), to nine digits; byte
pieces score as the last rank, ten lower, each.

Text is escaped as the model's identity normaliser does: a mark in front, spaces as marks. A mark that the text itself
holds is spelled by bytes, so decoding always restores the text.

Cases: null texts encode as empty; words of any length take time in proportion to it, and ties go to the path found first; the empty text has one segmentation, without pieces, of score 0; texts with fewer
segmentations than asked for return those there are; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import pairwise, repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from windrow.llm.common import id_text, offsets, slices

MARK = "▁"
#: Stands for a mark that the text itself holds while words are cut; no valid text holds it.
LITERAL = "\udc01"
#: Words of fewer characters are segmented together, so many at a time.
LONG, TOGETHER = 200, 15_000
#: Scores are whole numbers of this part of 1, so that sums are exact in any order and ties are ties.
UNIT = 1_000_000_000
#: Below any score; the loss of a word without a second segmentation.
LOW, NONE = -(1 << 62), 1 << 61


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces and scores of a model, and N-best search over words."""

    def __init__(self, path: str, n_best: int = 4, most: int = 200_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.n_best, self.most = n_best, most
        self.ids: dict[str, tuple[int, int]] = {}
        self.bytes_of = [0] * 256
        self.text_of: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"{piece!r} crosses from a character to a space mark; words of this model are no chain")
                self.ids[piece] = (i, round(-log(1 + min(-model.get_score(i), size)) * UNIT))
                self.text_of[i] = piece.replace(MARK, " ").encode()
        #: Pieces and all their beginnings: a run of characters that is not in it begins no piece.
        self.begun: dict[str, tuple[int, int] | None] = {}
        for piece, hit in self.ids.items():
            for n in range(1, len(piece)):
                self.begun.setdefault(piece[:n], None)
            self.begun[piece] = hit
        #: Neighbours that some piece holds; between any others every segmentation has a boundary.
        self.joined = {x + y for piece in self.ids for x, y in pairwise(piece)}
        self.byte_score = round((-log(1 + size) - 10) * UNIT)
        self._index()
        self._forget()

    def _index(self) -> None:
        """The beginnings as arrays: a node each, found from the node before it and the code of a character."""
        node = {run: i for i, run in enumerate(sorted(self.begun), 1)}
        letters = sorted({run[-1] for run in node})
        self.wide = len(letters) + 1
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.wide)
        keys = np.array([node.get(run[:-1], 0) * self.wide + self.code[ord(run[-1])] for run in node], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], order + 1
        self.root = np.zeros(self.wide, np.int64)
        self.root[self.keys[self.keys < self.wide]] = self.child[self.keys < self.wide]
        hits = [self.begun[run] or (-1, 0) for run in node]
        self.leaf, self.worth = np.array([-1, *(h[0] for h in hits)], np.int64), np.array([0, *(h[1] for h in hits)], np.int64)
        self.longest = max(map(len, node), default=0)
        self.byte_ends = offsets(map(len, self.text_of))
        self.byte_flat = np.frombuffer(b"".join(self.text_of), np.uint8)

    def _forget(self) -> None:
        """An empty table of words: where their ids lie, best scores, losses of their second choices, uses."""
        self.slot: dict[str, int] = {}
        self.parts: dict[str, tuple[list[int], int, int]] = {}
        self.choices: dict[str, tuple[list[tuple[int, np.ndarray]], bool]] = {}
        self.starts, self.sizes, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.score, self.loss = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        at, n = len(self.slot), len(words)
        while at + n > len(self.starts):
            self.starts, self.sizes, self.uses, self.score, self.loss = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses, self.score, self.loss)
            )
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.slot.update(zip(words, range(at, at + n), strict=True))
        self.sizes[at : at + n], self.score[at : at + n], self.loss[at : at + n] = sizes, score, loss
        self.starts[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _spread(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their places, and the starts of the words in them."""
        long = self.sizes[place]
        at = offsets(long)
        return self.flat[np.arange(int(at[-1])) + np.repeat(self.starts[place] - at[:-1], long)], at

    def _shrink(self) -> None:
        """Keep only the words that were used twice or more, most used first, up to half of the table."""
        names, uses = list(self.slot), self.uses[: len(self.slot)]
        kept = np.flatnonzero(uses > 1)
        kept = kept[np.argsort(-uses[kept], kind="stable")[: self.most // 2]]
        ids, at = self._spread(kept)
        score, loss = self.score[kept], self.loss[kept]
        self._forget()
        self._add([names[k] for k in kept.tolist()], np.diff(at), ids, score, loss)

    def _raw(self, char: str) -> bytes:
        return (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """For each end, the edges that reach it: start, ids, score."""
        begun, n = self.begun, len(word)
        found: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            for b in range(a + 1, n + 1):
                run = word[a:b]
                if run not in begun:
                    break
                hit = begun[run]
                if hit is not None:
                    found[b].append((a, (hit[0],), hit[1]))
            if word[a] not in self.ids:
                raw = self._raw(word[a])
                found[a + 1].append((a, tuple(self.bytes_of[x] for x in raw), self.byte_score * len(raw)))
        return found

    def search(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a word, best first. Of equal ones the path that is nearest to the start goes on, so
        that a long word with many equal choices takes as many steps as it has pieces."""
        edges = self.edges(word)
        best = [0] + [LOW] * len(word)
        for b in range(1, len(word) + 1):
            best[b] = max(best[a] + s for a, _, s in edges[b])
        heap: list[tuple[int, int, int, int, tuple | None]] = [(0, len(word), 0, 0, None)]
        out: list[tuple[int, tuple[int, ...]]] = []
        turn = 0
        while heap and len(out) < n:
            _, b, _, tail, link = heapq.heappop(heap)
            if b == 0:
                ids: list[int] = []
                while link is not None:
                    ids += link[0]
                    link = link[1]
                out.append((tail, tuple(ids)))
                continue
            for a, piece, s in edges[b]:
                turn += 1
                heapq.heappush(heap, (-(best[a] + s + tail), a, turn, s + tail, (piece, link)))
        return out

    def words(self, text: str) -> list[str]:
        """The words of the escaped text, each with the marks before it; only the first mark is left unwritten."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, marks = [], ""
        for part in parts[:-1]:
            if part:
                out.append(marks + part)
                marks = ""
            else:
                marks += MARK
        return [*out, marks + parts[-1]]

    def best_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best segmentations of many words: numbers of ids, all ids, scores, and what the second best lose, which is
        the least loss of a path that takes an edge off the best one, from forward and backward Viterbi scores.

        All words take each step together: the n-th places of all of them, or the ends of all edges as long."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        code, at = self.code[point], offsets(n)
        word = np.repeat(np.arange(len(words)), n)
        last, first = at[1:][word], at[:-1][word]
        node_of = np.arange(len(point)) + word  # a node before each character, and one after the last of a word

        pos, now = np.arange(len(point)), self.root[code]
        single = self.leaf[now] >= 0
        starts, sizes, ids, worth = [], [], [], []
        for size in range(1, self.longest + 1):
            hit = self.leaf[now] >= 0
            starts.append(pos[hit])
            sizes.append(np.full(len(starts[-1]), size))
            ids.append(self.leaf[now[hit]])
            worth.append(self.worth[now[hit]])
            more = (now > 0) & (pos + size < last[pos])
            pos, now = pos[more], now[more]
            if not len(pos):
                break
            key = now * self.wide + code[pos + size]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            pos, now = pos[hit], self.child[spot[hit]]
        spelled = np.flatnonzero(~single)  # by bytes
        long = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        start = np.concatenate([*starts, spelled])
        size = np.concatenate([*sizes, np.ones(len(spelled), np.int64)])
        own = np.concatenate([*ids, -1 - spelled])
        worth = np.concatenate([*worth, self.byte_score * long[spelled]])

        a, b, rel = node_of[start], node_of[start] + size, start - first[start]
        nodes = len(point) + len(words)
        longest = int(n.max(initial=0))

        def steps(turn: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Edges in order of turn and node; bounds of the turns, and of the nodes in them and their numbers."""
            key = turn * nodes + node
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
            bounds = np.searchsorted(key, np.arange(longest + 2) * nodes)
            return order, bounds, begin, np.searchsorted(begin, bounds), np.diff(np.append(begin, len(key)))

        forth, back = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        order, bounds, begin, inner, many = steps(rel + size, b)
        from_, to, gain = a[order], b[order], worth[order]
        for t in range(1, longest + 1):
            i, j, x, y = bounds[t], bounds[t + 1], inner[t], inner[t + 1]
            score = forth[from_[i:j]] + gain[i:j]
            top = np.maximum.reduceat(score, begin[x:y] - i)
            forth[to[begin[x:y]]] = top
            hit = np.flatnonzero(score == np.repeat(top, many[x:y]))[::-1] + i
            back[to[hit]] = order[hit]  # of equal ones the first
        rest = np.zeros(nodes, np.int64)
        order, bounds, begin, inner, _ = steps(rel, a)
        from_, to, gain = a[order], b[order], worth[order]
        for t in range(longest - 1, -1, -1):
            i, j, x, y = bounds[t], bounds[t + 1], inner[t], inner[t + 1]
            rest[from_[begin[x:y]]] = np.maximum.reduceat(rest[to[i:j]] + gain[i:j], begin[x:y] - i)

        head, end = at[:-1] + np.arange(len(words)), at[1:] + np.arange(len(words))
        on, spot = np.zeros(len(a), bool), end.copy()
        live = np.flatnonzero(spot > head)
        while len(live):
            edge = back[spot[live]]
            on[edge] = True
            spot[live] = a[edge]
            live = live[spot[live] > head[live]]
        off = np.flatnonzero(~on)
        second = np.full(len(words), LOW)
        np.maximum.at(second, word[start[off]], forth[a[off]] + worth[off] + rest[b[off]])
        path = np.flatnonzero(on)
        path = path[np.argsort(start[path])]
        times = np.where(own[path] < 0, long[start[path]], 1)
        out = np.repeat(own[path], times)
        raw = np.flatnonzero(own[path] < 0)
        if len(raw):
            chars = [chr(c) for c in point[start[path[raw]]].tolist()]
            out[out < 0] = [self.bytes_of[x] for c in chars for x in self._raw(c)]
        counts = np.bincount(word[start[path]], times, len(words)).astype(np.int64)
        return counts, out, forth[end], np.minimum(forth[end] - second, NONE)

    def first(self, word: str) -> tuple[list[int], int, int]:
        """``best_of`` one long word, character by character."""
        begun, n = self.begun, len(word)
        forth, back = [0] + [LOW] * n, [0] * (n + 1)
        how: list[tuple[int, ...]] = [()] * (n + 1)
        edges: list[tuple[int, int, int]] = []
        for a in range(n):
            here = forth[a]
            for b in range(a + 1, n + 1):
                run = word[a:b]
                if run not in begun:
                    break
                hit = begun[run]
                if hit is not None:
                    edges.append((a, b, hit[1]))
                    if here + hit[1] > forth[b]:
                        forth[b], back[b], how[b] = here + hit[1], a, (hit[0],)
            if word[a] not in self.ids:
                raw = self._raw(word[a])
                s = self.byte_score * len(raw)
                edges.append((a, a + 1, s))
                if here + s > forth[a + 1]:
                    forth[a + 1], back[a + 1], how[a + 1] = here + s, a, tuple(self.bytes_of[x] for x in raw)
        taken, b = [], n
        while b:
            taken.append((back[b], b))
            b = back[b]
        path, rest, second = set(taken), [LOW] * n + [0], LOW
        for a, b, s in reversed(edges):
            tail = s + rest[b]
            if tail > rest[a]:
                rest[a] = tail
            if forth[a] + tail > second and (a, b) not in path:
                second = forth[a] + tail
        return [i for _, b in reversed(taken) for i in how[b]], forth[n], min(forth[n] - second, NONE)

    def chain(self, word: str) -> tuple[list[int], int, int]:
        """``first`` of a word, cut where no piece can cross; its parts are kept, as words share them."""
        joined = self.joined
        cuts = [i for i, (x, y) in enumerate(pairwise(word), 1) if x + y not in joined]
        if not cuts:
            return self.first(word)
        ids: list[int] = []
        score, loss = 0, NONE
        for a, b in pairwise([0, *cuts, len(word)]):
            part = word[a:b]
            hit = self.parts.get(part)
            if hit is None:
                if len(self.parts) > self.most:
                    self.parts.clear()
                hit = self.parts[part] = self.first(part)
            ids += hit[0]
            score += hit[1]
            loss = min(loss, hit[2])
        return ids, score, loss

    def places(self, words: list[str]) -> np.ndarray:
        """Where the table holds each word; new words are segmented first, the short ones together."""
        if len(self.slot) > self.most:
            self._shrink()
        place = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(place < 0)
        if len(gaps):
            missing = [words[i] for i in gaps.tolist()]
            new = list(dict.fromkeys(missing))
            short = [w for w in new if len(w) < LONG]
            for at in range(0, len(short), TOGETHER):
                some = short[at : at + TOGETHER]
                self._add(some, *self.best_of([MARK + w for w in some]))
            for w in new:
                if len(w) >= LONG:
                    ids, score, loss = self.chain(MARK + w)
                    self._add([w], np.array([len(ids)]), np.array(ids, np.int32), np.array([score]), np.array([loss]))
            place[gaps] = np.fromiter(map(self.slot.__getitem__, missing), np.int64, len(missing))
        self.uses[: len(self.slot)] += np.bincount(place, minlength=len(self.slot))
        return place

    def options(self, word: str, own: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], bool]:
        """The N best of a word, its own ids first: loss and ids; whether all spell the word."""
        hit = self.choices.get(word)
        if hit is None:
            found = self.search(MARK + word, self.n_best)
            mine = tuple(own.tolist())
            best = found[0][0]
            found = [(0, own), *((best - s, np.array(ids, np.int32)) for s, ids in found if ids != mine)][: self.n_best]
            spelled = (MARK + word).replace(MARK, " ").replace(LITERAL, MARK).encode("utf-8", "surrogatepass")
            hit = found, all(b"".join(map(self.text_of.__getitem__, ids.tolist())) == spelled for _, ids in found)
            if len(word) < LONG:
                if len(self.choices) > self.most // 4:
                    self.choices.clear()
                self.choices[word] = hit
        return hit

    def plans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[list[tuple[float, list]], bool]]]:
        """Ids of the best segmentations of all texts and the starts of the texts in them; for each text its N best, by
        score and by what each puts for runs of those ids (start, end, ids), and whether all these spell their words."""
        cut = [self.words(t) for t in texts]
        at = offsets(map(len, cut))
        place = self.places([w for ws in cut for w in ws])
        ids, ends = self._spread(place)
        total = np.concatenate([[0], np.cumsum(self.score[place])])
        score, loss = (total[at[1:]] - total[at[:-1]]).tolist(), self.loss[place]
        out = []
        for i in range(len(texts)):
            a, b = at[i], at[i + 1]
            losses = loss[a:b]
            few = min(self.n_best - 1, b - a)
            near = np.argpartition(losses, few - 1)[:few] if few else np.zeros(0, np.int64)
            near = np.sort(near[losses[near] < NONE]).tolist()
            combined: list[tuple[int, tuple[int, ...]]] = [(0, ())]
            options, right = [], True
            for j in near:
                found, same = self.options(cut[i][j], ids[ends[a + j] : ends[a + j + 1]].copy())
                options.append(found)
                right &= same
                combined = sorted((less + x[0], (*pick, c)) for less, pick in combined for c, x in enumerate(found))[: self.n_best]
            plans = []
            for less, pick in combined:
                swaps = [(int(ends[a + j]), int(ends[a + j + 1]), options[k][c][1]) for k, (j, c) in enumerate(zip(near, pick, strict=True)) if c]
                plans.append(((score[i] - less) / UNIT, swaps))
            out.append((plans, right))
        return ids, ends[at], out

    def encode(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its N best segmentations: score, ids."""
        ids, at, found = self.plans(texts)
        for (plans, _), a, b in zip(found, at[:-1], at[1:], strict=True):
            yield [(score, np.concatenate([*pieced(ids, a, b, swaps)])) for score, swaps in plans]

    def spells(self, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the ids of each text decode to it, all texts at once."""
        sizes = np.diff(self.byte_ends)[ids]
        ends = offsets(sizes)
        got = self.byte_flat[np.arange(int(ends[-1])) + np.repeat(self.byte_ends[ids] - ends[:-1], sizes)]
        want = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        runs, same = ends[at], offsets(map(len, want))
        if np.array_equal(runs, same) and got.tobytes() == b"".join(want):
            return np.ones(len(texts), bool)
        return np.array([got[a:b].tobytes() == w for a, b, w in zip(runs[:-1], runs[1:], want, strict=True)], bool)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation: its bytes without the mark in front."""
        return b"".join(map(self.text_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def pieced(ids: np.ndarray, a: int, b: int, swaps: list[tuple[int, int, np.ndarray]]) -> Iterator[np.ndarray]:
    """Runs of ids from a to b with others in place of some."""
    for begin, end, other in swaps:
        yield ids[a:begin]
        yield other
        a = end
    yield ids[a:b]


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, n_best: int) -> Lattice:
    if (path, n_best) not in _LATTICES:
        _LATTICES[path, n_best] = Lattice(path, n_best)
    return _LATTICES[path, n_best]


def segment(docs: DataFrame, path: str | None = None, n_best: int = 4) -> DataFrame:
    """doc_id, ids of the best segmentation and its score, number and scores of the N best, their joint crc, round_trip."""
    path = path or default_model()
    kind = pa.schema(
        [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("scores", pa.list_(pa.float64())), ("nbest_crc32", pa.int64()), ("round_trip", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, n_best)
        for names, texts in slices(batches, 1_000_000):
            ids, at, found = model.plans(texts)
            ids = ids.astype("<i4", copy=False)
            scores, crcs = [], []
            for (plans, _), a, b in zip(found, at[:-1].tolist(), at[1:].tolist(), strict=True):
                crc = 0
                for _, swaps in plans:
                    for part in pieced(ids, a, b, swaps):
                        crc = zlib.crc32(part, crc)
                scores.append([s for s, _ in plans])
                crcs.append(crc)
            same = model.spells(ids, at, texts) & np.array([right for _, right in found], bool)
            best = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            columns = [pa.array(names, pa.int64()), best, pa.array([s[0] for s in scores], pa.float64()), pa.array(scores, kind.field("scores").type)]
            yield pa.record_batch([*columns, pa.array(crcs, pa.int64()), pa.array(same)], schema=kind)
        lattice(path, n_best)._forget()  # the worker lives on, and other stages need its memory

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, score double, scores array<double>, nbest_crc32 long, round_trip boolean")
