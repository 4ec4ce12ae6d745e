"""SentencePiece encoding and decoding with N-best segmentation.

A text is prefixed with a space, spaces become U+2581, and the lattice has an edge for each piece of the vocabulary at
each place, and for each character without a piece an edge that stands for its UTF-8 bytes. A path's score is the sum
of its pieces' unigram log probabilities. The vocabulary's file is a BPE model, whose own scores are merge ranks and no
log probabilities; they are not summed. fitted() counts the pieces of the library's BPE segmentation of all given texts
and takes log probabilities from these counts, so best paths are those of a unigram model with this vocabulary, as the
library finds them with the same scores, and not those of BPE merges. A forward Viterbi pass gives the best score from the start to every place; it is the exact
remaining cost for a backward A* search, which therefore yields paths in order of their scores.

No piece holds certain pairs of characters, so none crosses the place between them, and the lattice falls into
segments there. Distinct segments are worked on once a Python worker, in arrays: best path, and the gap to the second
best. Short ones are known by 64-bit hashes (two that are remembered at a time share one with negligible probability),
so that texts are cut and looked up in arrays, too. The n best paths of a text can differ from the best one only in the n - 1 segments of least gap, so the A* search
is over the chain of these segments' lattices; what loses more than the greatest of these gaps is not among the n best
and is not put in the queue. Ties go to the path whose last pieces are longer.

Nulls: a null or empty text has no pieces and decodes to the empty text. U+2581 in a text decodes to a space, as it
does in the library. Repeated rows are each encoded; texts are encoded whole.
"""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections.abc import Callable, Iterator, Mapping
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, packed, table, unpacked

MARK = "▁"
#: Alternatives returned beside the best path; characters up to which a segment is worked on in arrays, and is known by its hash; segments, and their characters, that a worker remembers.
ALTERNATIVES, SHORT, HASHED, REMEMBER, REMEMBER_CHARS = 3, 24, 64, 200_000, 1 << 22
#: Characters of the lattices that a worker remembers, a few hundred bytes each, and the longest segment it remembers them of.
LATTICES, LONG = 1 << 17, 1000
#: Segments that the library is given at once by a task that fits scores.
FIT = 20_000
#: Characters of texts that are cut into segments at once.
CHUNK = 1 << 20
#: What an unknown character costs beyond the least score of a piece, as in the library.
PENALTY = 10.0
#: Scores at or below this mark pieces that segmentation does not use, single characters without another piece excepted.
NEVER = -1e8


class Model:
    """The pieces, scores and byte pieces of a model file, picklable."""

    def __init__(self, pieces: list[tuple[int, str, float]], names: list[str], bytes_: list[int]):
        """pieces: id, text and score of the normal ones; names: the text of every id; bytes_: the ids of the byte pieces."""
        self.pieces = {p: (i, s) for i, p, s in pieces}
        self.names, self.bytes = names, bytes_
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, _, s in pieces if s > NEVER) - PENALTY
        self.key = uuid.uuid4().hex
        pairs = sorted({p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)})
        # hashes of the pairs of characters in a row that some piece holds
        self.pairs = np.unique(self._pair(*(np.array([ord(x[i]) for x in pairs], dtype=np.uint32) for i in (0, 1))))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)) >> np.uint32(12)

    @cached_property
    def joined(self) -> np.ndarray:
        """By hash of a pair: whether a piece can hold it. Pairs that share a hash with such a one are not cut, which is as right."""
        out = np.zeros(1 << 20, dtype=bool)
        out[self.pairs] = True
        return out

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        names = [p.id_to_piece(i) for i in range(n)]
        other = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) or (p.get_score(i) <= NEVER and len(names[i]) > 1)
        at = {names[i]: i for i in range(n) if p.is_byte(i)}
        return cls([(i, names[i], p.get_score(i)) for i in range(n) if not other(i)], names, [at[f"<0x{b:02X}>"] for b in range(256)])

    def unigram(self, counts: Mapping[int, int]) -> Model:
        """The same pieces scored by the log of their share of counts, by id. The piece of rank r counts 1 / r more, so none has no share; floats are single, as in the library."""
        ids = sorted((i, p) for p, (i, _) in self.pieces.items())
        n = np.array([counts.get(i, 0) + 1 / r for r, (i, _) in enumerate(ids, 1)])
        scores = np.log(n / n.sum()).astype(np.float32).astype(float).tolist()
        return Model([(i, p, s) for (i, p), s in zip(ids, scores, strict=True)], self.names, self.bytes)

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        return [known[0]] if known else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def edges(self, s: str, j: int) -> list[tuple[int, float]]:
        """The (start, score) of the lattice's edges that end at place j, longest first. They are looked up as needed, so a long segment has no lattice in memory."""
        get, out = self.pieces.get, []
        for i in range(max(0, j - self.longest), j):
            known = get(s[i:j])
            if known:
                out.append((i, known[1]))
        if s[j - 1] not in self.pieces:
            out.append((j - 1, self.unknown))
        return out

    def forward(self, s: str) -> array:
        """The Viterbi score of each place."""
        best = array("d", [0.0])
        for j in range(1, len(s) + 1):
            best.append(max(best[i] + x for i, x in self.edges(s, j)))
        return best

    def best(self, s: str) -> tuple[list[int], float, float]:
        """The ids and score of the best path, and the gap to the second best."""
        first, second, back = array("d", [0.0]), array("d", [-np.inf]), array("l", [0])
        for j in range(1, len(s) + 1):
            one, two, start = -np.inf, -np.inf, 0
            for i, x in self.edges(s, j):
                c = first[i] + x
                if c > one:
                    two, one, start = max(one, second[i] + x), c, i
                else:
                    two = max(two, c)
            first.append(one)
            second.append(two)
            back.append(start)
        cut = [len(s)]
        while cut[-1]:
            cut.append(back[cut[-1]])
        return self.cut_ids(s, cut[::-1]), first[-1], first[-1] - second[-1]

    def cut_ids(self, s: str, cut: list[int]) -> list[int]:
        return [k for a, b in zip(cut[:-1], cut[1:], strict=True) for k in self.ids(s[a:b])]

    def nbest(self, segments: list[str], n: int, known: _Lattices | None = None, loss: float = np.inf) -> list[tuple[float, list[list[int]]]]:
        """The n best paths through the segments' lattices in a row: score, and the places of each segment's cuts.

        known remembers lattices. loss: a difference of scores from the best path that none of the n exceeds.
        """
        known = _Lattices(self) if known is None else known
        scores, edges = zip(*map(known.of, segments), strict=True)
        before = np.concatenate(([0.0], np.cumsum([b[-1] for b in scores]))).tolist()
        last, least = len(segments) - 1, before[-1] - loss - 1e-6
        # priority: score of the best whole path; of equal ones the latest put in, which has the longest last piece
        heap, turn = [(-before[-1], 0, last, len(segments[last]), 0.0, None)], 0
        out = []
        while heap and len(out) < n:
            _, _, k, j, g, path = heapq.heappop(heap)
            if j == 0:
                if k == 0:
                    cuts: list[list[int]] = [[0] for _ in segments]
                    while path:
                        (seg, end), path = path
                        cuts[seg].append(end)
                    out.append((g, cuts))
                    continue
                k, j = k - 1, len(segments[k - 1])
            best = scores[k]
            for i, x in edges[k][j - 1] if edges[k] else reversed(self.edges(segments[k], j)):
                whole = before[k] + best[i] + x + g
                if whole >= least:
                    turn -= 1
                    heapq.heappush(heap, (-whole, turn, k, i, g + x, ((k, j), path)))
        return out


class _Lattices:
    """Forward scores of the segments met so far, and for each place the edges that end there, shortest first."""

    def __init__(self, model: Model):
        self.model, self.known, self.chars = model, {}, 0

    def of(self, s: str) -> tuple[array, list[list[tuple[int, float]]] | None]:
        """A segment too long to be remembered has no list of edges."""
        if len(s) > LONG:
            return self.model.forward(s), None
        if s not in self.known:
            if self.chars + len(s) > LATTICES:
                self.known, self.chars = {}, 0
            self.known[s] = self.model.forward(s), [self.model.edges(s, j)[::-1] for j in range(1, len(s) + 1)]
            self.chars += len(s)
        return self.known[s]


_BASE = 0x9E3779B97F4A7C15


def _stepped(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The hashes of strings of hashes h, each with one more character."""
    h = (h + chars + np.uint64(1)) * np.uint64(_BASE)
    h ^= h >> np.uint64(29)
    return h


class _Cut:
    """The segments of texts in a row: bounds, the places where they begin and end; lengths; hashes, of short ones; and of_text, those that each text begins and ends with."""

    def __init__(self, model: Model, texts: list[str]):
        self.all = "".join([MARK + t for t in texts if t]).replace(" ", MARK)
        chars = np.frombuffer(self.all.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text_bounds = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        cut = np.ones(len(chars) + 1, dtype=bool)
        cut[1:-1] = ~model.joined[model._pair(chars[:-1], chars[1:])]
        cut[text_bounds] = True
        self.bounds = np.flatnonzero(cut)
        self.of_text = np.searchsorted(self.bounds, text_bounds)
        self.lengths = np.diff(self.bounds)
        self.hashes = np.zeros(len(self.lengths), dtype=np.uint64)
        live, chars = np.flatnonzero(self.lengths <= HASHED), chars.astype(np.uint64)
        for k in range(HASHED):
            self.hashes[live] = _stepped(self.hashes[live], chars[self.bounds[live] + k])
            live = live[self.lengths[live] > k + 1]

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, k: int) -> str:
        return self.all[self.bounds[k] : self.bounds[k + 1]]


class _Index:
    """Numbers for distinct segments, from 0 on."""

    def __init__(self):
        self.hashes = np.zeros(0, dtype=np.uint64)
        # by a hash's first bits: the number of one segment that has them; others are in rest, by hash, or by text if they are long
        self.slots = np.full(1 << 20, -1, dtype=np.int32)
        self.rest: dict[int | str, int] = {}

    def numbers(self, cut: _Cut) -> tuple[np.ndarray, list[str]]:
        """The number of each segment of cut, and the new segments in the order of their numbers."""
        if not len(cut):
            return np.zeros(0, dtype=np.int64), []
        slot = (cut.hashes >> np.uint64(44)).astype(np.int64)
        out, short = self.slots[slot].astype(np.int64), cut.lengths <= HASHED
        known = short & (out >= 0)
        known[known] = self.hashes[out[known]] == cut.hashes[known]
        new, first = [], len(self.hashes)
        open_ = np.flatnonzero(short & ~known)
        hashes, at, inverse = np.unique(cut.hashes[open_], return_index=True, return_inverse=True)
        numbers = np.array([self.rest.get(h, -1) for h in hashes.tolist()], dtype=np.int64)
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = first + np.arange(len(fresh))
        new += [cut[k] for k in open_[at[fresh]].tolist()]
        out[open_] = numbers[inverse]
        slot = (hashes[fresh] >> np.uint64(44)).astype(np.int64)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = numbers[fresh[free]]
        lost = self.slots[slot] != numbers[fresh]
        self.rest.update(zip(hashes[fresh[lost]].tolist(), numbers[fresh[lost]].tolist(), strict=True))
        for k in np.flatnonzero(~short).tolist():
            s = cut[k]
            if s not in self.rest:
                self.rest[s] = first + len(new)
                new.append(s)
            out[k] = self.rest[s]
        own = np.zeros(len(new), dtype=np.uint64)  # no slot leads to a long segment
        own[: len(fresh)] = hashes[fresh]
        self.hashes = np.concatenate((self.hashes, own))
        return out, new


class _Memory:
    """Best ids, score and gap of the segments met so far."""

    def __init__(self, model: Model):
        self.model, self.lattices = model, _Lattices(model)
        hashes, starts = {}, set()
        for p, known in model.pieces.items():
            *shorter, whole = self._hashes(p)
            hashes[whole] = known
            starts.update(shorter)
        if len(hashes) < len(model.pieces):
            raise ValueError("two pieces have one hash")
        self.keys = np.array(sorted(hashes), dtype=np.uint64)
        self.key_ids = np.array([hashes[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.key_scores = np.array([hashes[k][1] for k in self.keys.tolist()])
        self.maybe, self.longer = np.zeros(1 << 20, dtype=bool), np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.longer[np.fromiter(starts, dtype=np.uint64, count=len(starts)) >> np.uint64(44)] = True
        self.known = np.array(sorted(ord(p) for p in model.pieces if len(p) == 1), dtype=np.uint32)
        self.clear()

    #: The memory of this Python worker, which serves one task after another.
    last: _Memory | None = None

    @classmethod
    def of(cls, model: Model) -> _Memory:
        if cls.last is None or cls.last.model.key != model.key:
            cls.last = None
            cls.last = cls(model)
        return cls.last

    @classmethod
    def _hashes(cls, piece: str) -> list[int]:
        """The hashes of piece's first character, first two characters and so on."""
        h, out = 0, []
        for c in piece:
            h = ((h + ord(c) + 1) * _BASE) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
            out.append(h)
        return out

    def clear(self) -> None:
        self.index, self.chars = _Index(), 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.begin, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.scores, self.gaps = np.zeros(0), np.zeros(0)

    def numbers(self, cut: _Cut) -> np.ndarray:
        """The number of each segment of cut, new ones being worked on first."""
        if len(self.begin) > REMEMBER or self.chars > REMEMBER_CHARS:
            self.clear()
        out, new = self.index.numbers(cut)
        if new:
            self._learn(new)
        return out

    def _short(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """Of short segments, longest first, whose characters all have pieces: ids, one after another; how many; score; and gap."""
        n, sizes = len(segments), np.array([len(s) for s in segments])
        length = int(sizes[0])
        # a row of these arrays is a place, a column a segment; what lies beyond a segment's end does not reach back
        chars = np.zeros((n, length), dtype=np.uint64)
        chars[np.arange(length)[None, :] < sizes[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        chars = chars.T.copy()
        best = np.full((length + 1, n), -np.inf)
        second, back, piece = best.copy(), np.zeros((length + 1, n), dtype=np.int16), np.zeros((length + 1, n), dtype=np.int32)
        best[0] = 0
        # all edges out of a place are known once those into it are
        for i in range(length):
            m = int(np.searchsorted(-sizes, -i))  # longer than i
            h, live = np.zeros(m, dtype=np.uint64), None
            for j in range(i + 1, min(length, i + self.model.longest) + 1):
                h = _stepped(h, chars[j - 1][:m] if live is None else chars[j - 1][live])
                slot = h >> np.uint64(44)
                rows = np.flatnonzero(self.maybe[slot])
                at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                found = self.keys[at] == h[rows]
                rows, at = rows[found], at[found]
                if len(rows):
                    rows = rows if live is None else live[rows]
                    c1, c2 = best[i][rows] + self.key_scores[at], second[i][rows] + self.key_scores[at]
                    b1, b2 = best[j][rows], second[j][rows]
                    better = c1 > b1
                    second[j][rows] = np.maximum(np.minimum(b1, c1), np.where(better, c2, b2))
                    up, a = rows[better], at[better]
                    best[j][up], back[j][up], piece[j][up] = c1[better], i, self.key_ids[a]
                # segments where a longer piece may start
                more = np.flatnonzero(self.longer[slot] & (sizes[:m] > j if live is None else sizes[live] > j))
                if not len(more):
                    break
                if len(more) < m:
                    h, live = h[more], more if live is None else live[more]
        ids = np.zeros((n, length), dtype=np.int32)
        count, place, every = np.zeros(n, dtype=np.int64), sizes.copy(), np.arange(n)
        live = every
        while len(live):
            ids[live, count[live]] = piece[place[live], live]
            count[live] += 1
            place[live] = back[place[live], live]
            live = live[place[live] > 0]
        inside = np.arange(length)[None, :] < count[:, None]
        turned = np.maximum(count[:, None] - 1 - np.arange(length)[None, :], 0)
        score = best[sizes, every]
        return np.take_along_axis(ids, turned, axis=1)[inside], count, score, score - second[sizes, every]

    def _learn(self, new: list[str]) -> None:
        first, n = len(self.begin), len(new)
        self.chars += sum(map(len, new))
        self.begin, self.sizes = (np.concatenate((x, np.zeros(n, dtype=np.int64))) for x in (self.begin, self.sizes))
        self.scores, self.gaps = (np.concatenate((x, np.zeros(n))) for x in (self.scores, self.gaps))
        flat, end = [self.flat], len(self.flat)
        lengths = np.array([len(s) for s in new])
        at = np.flatnonzero(lengths <= SHORT)
        at = at[np.argsort(-lengths[at], kind="stable")]
        chars = np.frombuffer("".join([new[k] for k in at.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        odd = np.concatenate(([0], np.cumsum(~np.isin(chars, self.known))))
        ends = np.cumsum(lengths[at])
        fine = at[odd[ends] == odd[ends - lengths[at]]]
        for k in range(0, len(fine), 20_000):
            part = fine[k : k + 20_000]
            ids, sizes, scores, gaps = self._short([new[k] for k in part.tolist()])
            flat.append(ids)
            self.begin[first + part] = end + np.cumsum(sizes) - sizes
            self.sizes[first + part], self.scores[first + part], self.gaps[first + part] = sizes, scores, gaps
            end += len(ids)
        for k in np.setdiff1d(np.arange(n), fine).tolist():
            ids, self.scores[first + k], self.gaps[first + k] = self.model.best(new[k])
            flat.append(np.array(ids, dtype=np.int32))
            self.begin[first + k], self.sizes[first + k] = end, len(ids)
            end += len(ids)
        self.flat = np.concatenate(flat)


_CHANGE = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALTERNATIVE = pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))])
ENCODED = "ids array<int>, score double, alternatives array<struct<score: double, changes: array<struct<at: int, drop: int, ids: array<int>>>>>"


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def encoded(df: DataFrame, model: Model, text: str = "text", alternatives: int = ALTERNATIVES) -> DataFrame:
    """df with ids and score of the best path, and alternatives, the next best ones: score, and what to change in ids.

    A change drops so many ids from a place of the best path's ids and puts others there. df must not have these columns.
    """
    return df.mapInArrow(_encoder(df.columns, model, text, alternatives), f"{_ddl(df)}, {ENCODED}")


def decoded(df: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of the pieces in ids. df must not have this column."""
    return df.mapInArrow(_decoder(df.columns, model, ids), f"{_ddl(df)}, decoded string")


def recoded(df: DataFrame, model: Model, text: str = "text", alternatives: int = ALTERNATIVES) -> DataFrame:
    """df encoded, and its ids decoded again: encoded() and decoded() in one Python worker, so that ids do not pass through Spark between them."""
    encode = _encoder(df.columns, model, text, alternatives)
    decode = _decoder([*df.columns, "ids", "score", "alternatives"], model, "ids")
    return df.mapInArrow(lambda batches: decode(encode(batches)), f"{_ddl(df)}, {ENCODED}, decoded string")


def _encoder(names: list[str], model: Model, text: str, alternatives: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory.of(model)
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                texts, first = _some(batch[text], done), done
                done += len(texts)
                cut = _Cut(model, texts)
                at = memory.numbers(cut)
                n, gaps = memory.sizes[at], memory.gaps[at]
                ends = np.cumsum(n)
                values = memory.flat[np.repeat(memory.begin[at] - (ends - n), n) + np.arange(int(n.sum()))]
                offsets = np.concatenate(([0], ends))[cut.of_text]
                scores, others = [], []
                for a, b, start in zip(cut.of_text[:-1].tolist(), cut.of_text[1:].tolist(), offsets[:-1].tolist(), strict=True):
                    scores.append(float(memory.scores[at[a:b]].sum()))
                    others.append(self_alternatives(cut, a, gaps[a:b], ends[a:b] - start, n[a:b], scores[-1], memory.lattices) if b > a else [])
                part = batch.slice(first, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), lists, pa.array(scores), pa.array(others, pa.list_(_ALTERNATIVE))], [*names, "ids", "score", "alternatives"])
        give_back()  # the worker lives on beside tasks of other stages

    def self_alternatives(cut, first, gaps, ends, sizes, score, lattices):
        if not alternatives:
            return []
        k = min(alternatives, len(gaps))
        near = np.lexsort((np.arange(len(gaps)), gaps))[:k] if len(gaps) <= 64 else None
        if near is None:
            edge = np.partition(gaps, k - 1)[k - 1]
            near = np.flatnonzero(gaps <= edge)
            near = near[np.lexsort((near, gaps[near]))][:k]
        near = np.sort(near[np.isfinite(gaps[near])])
        if not len(near):
            return []
        in_row = [cut[first + i] for i in near.tolist()]
        # one path a segment differs there alone and loses its gap
        loss = float(gaps[near].max()) if len(near) == alternatives else np.inf
        paths = model.nbest(in_row, alternatives + 1, lattices, loss)
        out = []
        for g, cuts in paths[1:]:
            changes = []
            for i, s, c, top in zip(near.tolist(), in_row, cuts, paths[0][1], strict=True):
                if c != top:
                    changes.append({"at": int(ends[i] - sizes[i]), "drop": int(sizes[i]), "ids": model.cut_ids(s, c)})
            out.append({"score": score + (g - paths[0][0]), "changes": changes})
        return out

    return run


def _some(column: pa.Array, first: int) -> list[str]:
    """Texts of a column from one on, about CHUNK characters of them."""
    texts, size = [], 0
    while first + len(texts) < len(column) and (size < CHUNK or not texts):
        texts.append(column[first + len(texts)].as_py() or "")
        size += len(texts[-1])
    return texts


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _decoder(names: list[str], model: Model, ids: str) -> Batches:
    of_byte = {i: b for b, i in enumerate(model.bytes)}
    text_of = [bytes([of_byte[i]]) if i in of_byte else n.replace(MARK, " ").encode() for i, n in enumerate(model.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array(text_of, pa.large_binary())
        for batch in batches:
            column = batch[ids]
            # the bytes of all pieces in a row, cut where each list ends
            taken = texts.take(column.flatten())
            edges = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            cuts = edges[np.concatenate(([0], ends)).astype(np.int64)].tolist() if len(taken) else [0] * (batch.num_rows + 1)
            data = memoryview(taken.buffers()[2] or b"")
            out = [bytes(data[x:y]).removeprefix(b" ").decode("utf-8", "replace") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(out, pa.string())], [*names, "decoded"])

    return run


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_model() -> Model:
    """The vocabulary with scores by merge rank alone: the piece of rank r has a share in proportion to 1 / r."""
    return Model.load(vocabulary_file()).unigram({})


def bpe_counts(segments: Mapping[str, int], bpe) -> np.ndarray:
    """How often each id is in the BPE segmentations of segments, each of which counts so many times; bpe adds no prefix. No merge crosses segments."""
    texts, out = list(segments), np.zeros(bpe.vocab_size(), dtype=np.int64)
    for at in range(0, len(texts), FIT):
        part = texts[at : at + FIT]
        times = np.fromiter(map(segments.__getitem__, part), dtype=np.int64, count=len(part))
        ids = bpe.encode(part, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64)
        out += np.bincount(flat, np.repeat(times, [len(x) for x in ids]), len(out)).astype(np.int64)
    return out


def fitted(docs: DataFrame, text: str = "text") -> Model:
    """The vocabulary with log probabilities fitted to all texts of docs. What comes to the driver is one count a piece at most."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, spec = default_model(), pb.ModelProto()
    with open(vocabulary_file(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.add_dummy_prefix = False
    proto = spec.SerializeToString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        bpe = SentencePieceProcessor(model_proto=proto)
        total = np.zeros(bpe.vocab_size(), dtype=np.int64)
        index, held, counts, chars = _Index(), [], np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                texts = _some(batch[0], done)
                done += len(texts)
                numbers, new = index.numbers(_Cut(model, texts))
                held += new
                counts = np.bincount(numbers, minlength=len(held)) + np.pad(counts, (0, len(held) - len(counts)))
                chars += sum(map(len, new))
                if len(held) > REMEMBER or chars > REMEMBER_CHARS:
                    total += bpe_counts(dict(zip(held, counts.tolist(), strict=True)), bpe)
                    index, held, counts, chars = _Index(), [], np.zeros(0, dtype=np.int64), 0
        if held:
            total += bpe_counts(dict(zip(held, counts.tolist(), strict=True)), bpe)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["id", "n"])
        del index, held, counts
        give_back()

    counts = docs.select(text).mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return model.unigram({r["id"]: r["n"] for r in counts.collect()})


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the three next best segmentations, and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs)
    out = recoded(docs, model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.col("score").alias("best_score"),
        F.transform("alternatives", lambda a: a["score"]).alias("next_scores"),
        F.to_json("alternatives").alias("next_changes"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids of their best segmentation instead of their text, its next best ones, and whether the ids decode to the text.

    ids, n_pieces, score, next_scores, next_changes and round_trip replace columns of docs with these names.
    """
    model = fitted(docs)
    out = recoded(packed(docs, "text"), model)
    own = [c for c in docs.columns if c not in ("text", "ids", "n_pieces", "score", "next_scores", "next_changes", "round_trip")]
    return out.select(
        *unpacked(own),
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        "score",
        F.transform("alternatives", lambda a: a["score"]).alias("next_scores"),
        F.to_json("alternatives").alias("next_changes"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
