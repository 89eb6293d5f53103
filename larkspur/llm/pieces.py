"""SentencePiece encoding and decoding by a max-plus parallel scan.

The ids are those of the vocabulary's own library, whose pieces were made by merges. A merge encoding is the one
segmentation in which every two neighbouring pieces fit: the merges of their joined characters give these two pieces
back. So a way through a text weighs 0 if all its neighbours fit and minus infinity if any do not, and exactly one way
has weight 0; nothing hangs on where a text is cut. Spaces are written as the vocabulary's mark and a mark is put before
the text, without any other normalisation; characters outside the vocabulary become byte pieces. The mark itself, where
a text has it, becomes bytes too (the library takes it for a space), so that decoding gives the text back exactly.

Where two characters stand next to each other in no piece, whatever pieces meet there fit: above all before a mark that
follows another character, at the end of a line, and where a word meets punctuation. A text is cut at such places into
units, and a unit's encoding is worked out once and remembered (a bounded number of units).

A text of more than `giant` characters is split into chunks of `chunk` characters at any place. The states at a boundary
are the pieces that may lie over it or end at it. Each chunk yields the matrix of weights from each state at its start
to each state at its end; the matrices are combined associatively in a tree, which gives the states at all boundaries,
and then each chunk is traced back by itself. All ways of a chunk go through the starts of its words, so its matrix is the
product of that of its first characters and that of its last ones, and what lies between is encoded by units; only where
a chunk has no such place (a script without spaces) do the ways of all states run through it. A text's ids are the same
for every size of chunks.

Defined results: null text counts as empty and has no pieces; repeated rows encode alike; an empty table gives an empty
table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import by_batch, id_text, table, written

GIANT, CHUNK, MEMORY, LONG, GO = 65536, 16384, 600_000, 48, 128
GROUP = 4  # chunks worked on at once
SLOTS = 22  # bits of the table of remembered pairs: 40 MB
MARK, OTHER = "▁", "￿"
_NONE = float("-inf")
_SIGNS = "!-@\\[-`{-~"  # of a pattern: the ASCII characters besides letters, space and controls
_sign, _word_start = re.compile(f"[{_SIGNS}]"), re.compile(f"(?<!{MARK}){MARK}")


class Vocabulary:
    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[str] = [""] * n
        self.score: dict[str, float] = {}
        self.raw: list[bytes] = [b""] * n
        self.byte = [0] * 256
        plain = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                plain.append(i)
                self.text[i] = piece
                self.score[piece] = model.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        #: Scores that several merged pieces have: their merges are told apart by place.
        self.tied = {x for x, n in Counter(self.score.values()).items() if n > 1}
        self.left: dict[int, list[tuple[str, float, float]]] = {}
        self.right: dict[int, list[tuple[str, float, float]]] = {}
        self.matcher = ahocorasick.Automaton()
        self.longest, self.cuts = 1, True
        for i in plain:
            piece = self.text[i]
            # A piece that its own merges don't give never occurs.
            if (made := self.merged(piece))[0] == [piece]:
                self.matcher.add_word(piece, len(piece) << 16 | i)
                self.longest = max(self.longest, len(piece))
                self.cuts &= MARK not in piece.lstrip(MARK)
                self.left[i], self.right[i] = self._edge(piece, made[1], 0), self._edge(piece, made[1], 1)
        self.matcher.make_automaton()
        inner = {self.text[i][k : k + 2] for i in self.left for k in range(len(self.text[i]) - 1)}
        #: Units: of a text with spaces for marks.
        self.unit = re.compile(" +[^ ]*")
        if not any("\n" in x or (_sign.match(x[1]) and x[0] != MARK and not _sign.match(x[0])) for x in inner):
            self.unit = re.compile(rf"\n+| +(?:[^ \n{_SIGNS}]+|[{_SIGNS}][^ \n]*)?|[{_SIGNS}][^ \n]*|[^ \n{_SIGNS}]+")
        self.unknown, self.start = n, n + 1
        self.width = n + 2
        self.keys = np.full(1 << SLOTS, -1)
        self.known = np.zeros(1 << SLOTS, bool)
        self.held: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """The pieces that merging gives, and the two parts of each merged piece: the highest score first, of equal ones the leftmost."""
        symbols, parts, score = list(text), {}, self.score.get
        while True:
            found = [score(x + y, _NONE) for x, y in zip(symbols, symbols[1:])]
            best = max(found, default=_NONE)
            if best == _NONE:
                return symbols, parts
            at = found.index(best)
            new = symbols[at] + symbols[at + 1]
            parts[new] = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = [new]

    def _edge(self, piece: str, parts: dict[str, tuple[str, str]], side: int) -> list[tuple[str, float, float]]:
        """What stands at an edge of a piece while it is merged: symbol, when it is there, when it is merged on (time: minus the score)."""

        def made(x: str) -> float:
            return max(-self.score[x], *map(made, parts[x])) if x in parts else -np.inf

        out, until = [], np.inf
        while True:
            since = made(piece)
            out.append((piece, since, until))
            if piece not in parts:
                return out
            until, piece = since, parts[piece][side]

    def fit(self, a: int, b: int) -> bool:
        """Whether pieces a and b may be neighbours: no symbol at the end of a is merged with one at the start of b before either is merged on."""
        if self.start in (a, b) or self.unknown in (a, b):
            return True
        score = self.score
        for x, since_x, until_x in self.right[a]:
            for y, since_y, until_y in self.left[b]:
                if (s := score.get(x + y)) is not None:
                    if s in self.tied:
                        return self.merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
                    at = max(-s, since_x, since_y)
                    if at < until_x and at <= until_y:
                        return False
        return True

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fit() of many pairs; the pairs of late are remembered. a may be -1, which fits nothing."""
        key = a * self.width + b
        slot = (key * 0x9E3779B97F4A7C1).view(np.uint64) >> np.uint64(64 - SLOTS)
        missed = self.keys[slot] != key
        out = self.known[slot] & (a >= 0)
        missed &= a >= 0
        if missed.any():
            new, at = np.unique(key[missed], return_inverse=True)
            found = np.fromiter((self.fit(*divmod(k, self.width)) for k in new.tolist()), bool, len(new))
            out[missed] = found[at]
            to = (new * 0x9E3779B97F4A7C1).view(np.uint64) >> np.uint64(64 - SLOTS)
            _, first = np.unique(to, return_index=True)
            self.keys[to[first]], self.known[to[first]] = new[first], found[first]
        return out

    def arcs(self, units: list[str]):
        """Unit, start, end, piece of every arc, by end and then by unit."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        text = "\n".join(units) + "\n"
        found = np.fromiter(itertools.chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2)
        last, length, piece = found[:, 0], found[:, 1] >> 16, found[:, 1] & 0xFFFF
        first = np.concatenate([[0], np.cumsum(size + 1)])
        none = np.ones(len(text), bool)
        none[last[length == 1]] = False
        none[first[1:] - 1] = False
        if none.any():
            none = np.flatnonzero(none)
            last, length, piece = (np.concatenate(x) for x in ((last, none), (length, np.ones_like(none)), (piece, np.full_like(none, self.unknown))))
            order = np.argsort(last, kind="stable")
            last, length, piece = last[order], length[order], piece[order]
        unit = np.repeat(np.arange(len(units)), size + 1)[last]
        end = last - first[unit] + 1
        order = np.argsort(end, kind="stable")
        unit, end = unit[order], end[order]
        return unit, end - length[order], end, piece[order], size

    def ways(self, arcs, entry: np.ndarray, before: np.ndarray, lanes: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Forward from place `entry` after piece `before` of each unit and lane: last[unit, place, lane], the one piece that the way of weight 0 ends with (-1: no way), and its arc."""
        unit, start, end, piece, size = arcs
        width = int(max(end.max(initial=0), entry.max(initial=0))) + 1
        last, by = (np.full((len(size), width, lanes), -1, np.int64) for _ in range(2))
        u, lane = np.divmod(np.arange(entry.size), lanes)
        there = before.ravel() >= 0
        last[u[there], entry.ravel()[there], lane[there]] = before.ravel()[there]
        arc = np.searchsorted(end, np.arange(1, width + 1))
        for e in range(1, width):
            lo, hi = arc[e - 1], arc[e]
            if lo == hi:
                continue
            prev = last[unit[lo:hi], start[lo:hi]]
            if lanes == 1:
                hit = np.flatnonzero(self.fits(prev[:, 0], piece[lo:hi])) + lo
                last[unit[hit], e, 0], by[unit[hit], e, 0] = piece[hit], hit
                continue
            k, lane = np.nonzero(prev >= 0)
            good = self.fits(prev[k, lane], piece[lo + k])
            k, lane = lo + k[good], lane[good]
            last[unit[k], e, lane], by[unit[k], e, lane] = piece[k], k
        return last, by

    def best(self, units: list[str]):
        """The pieces of each unit: pieces and starts, unit after unit, and how many each unit has."""
        arcs = self.arcs(units)
        n = len(units)
        _, by = self.ways(arcs, np.zeros((n, 1), np.int64), np.full((n, 1), self.start))
        return self._back(arcs, by[:, :, 0], np.zeros(n, np.int64), arcs[4].copy())

    def _back(self, arcs, by: np.ndarray, entry: np.ndarray, at: np.ndarray):
        """Back from the places `at` to `entry`, all units at once."""
        start, piece = arcs[1], arcs[3]
        going, steps = np.flatnonzero(at > entry), []
        while len(going):
            a = by[going, at[going]]
            steps.append((going, a))
            at[going] = start[a]
            going = going[at[going] > entry[going]]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        who, path = (np.concatenate(x) for x in zip(*steps[::-1]))
        path = path[np.argsort(who, kind="stable")]
        return piece[path], start[path], np.bincount(who, minlength=len(at))

    def _states(self, arcs, unit: int, at: int) -> np.ndarray:
        """Numbers of the arcs that start before a place of a unit and end there or later: the states of a boundary, in order."""
        own, start, end, piece, _ = arcs
        k = np.flatnonzero((own == unit) & (start < at) & (end >= at) & (end < at + self.longest))
        return k[np.lexsort((piece[k], end[k], start[k]))]

    def chunk_states(self, arcs, lead: list[int], body: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each chunk (lead characters before it, body of its own, as many as longest - 1 after it) the states at its start (None of a text's start) and end."""
        return [(self._states(arcs, u, n) if n else np.zeros(0, np.int64), self._states(arcs, u, n + m)) for u, (n, m) in enumerate(zip(lead, body))]

    def transfer(self, parts: list[str], lead: list[int], body: list[int]) -> list[np.ndarray]:
        """Weights from each state at a chunk's start to each at its end: 0 or minus infinity. The start of a text is one state."""
        arcs = unit, start, end, piece, _ = self.arcs(parts)
        states = self.chunk_states(arcs, lead, body)
        lanes = max(1, *(len(x) for x, _ in states))
        entry, before = np.zeros((len(parts), lanes), np.int64), np.full((len(parts), lanes), -1)
        for u, (x, _) in enumerate(states):
            if lead[u]:
                entry[u, : len(x)], before[u, : len(x)] = end[x], piece[x]
            else:
                before[u, 0] = self.start
        _, by = self.ways(self._inside(arcs, lead, body), entry, before, lanes)
        out = []
        for u, (x, y) in enumerate(states):
            m = np.full((len(x) if lead[u] else 1, len(y)), -np.inf)
            for j, k in enumerate(y.tolist()):
                if lead[u] and start[k] < lead[u]:
                    m[x == k, j] = 0  # a piece over the whole chunk
                else:
                    lane = np.flatnonzero(self._numbers_inside[by[u, end[k], : len(m)]] == k) if end[k] < by.shape[1] else []
                    m[lane, j] = 0
            out.append(m)
        return out

    def _inside(self, arcs, lead: list[int], body: list[int]):
        """The arcs that start in a chunk's body."""
        unit, start, end, piece, size = arcs
        lo = np.array(lead)
        at = np.flatnonzero((start >= lo[unit]) & (start < (lo + np.array(body))[unit]))
        self._numbers_inside = np.append(at, -1)  # number -1 is no arc
        return unit[at], start[at], end[at], piece[at], size

    def trace(self, parts: list[str], lead: list[int], body: list[int], enter: list[int], leave: list[int | None]):
        """The pieces that start in each chunk's body, on the way between two of its states (None: to its last character); as best() gives them."""
        arcs = self.arcs(parts)
        states = self.chunk_states(arcs, lead, body)
        entry, before, goal = (np.zeros(len(parts), np.int64) for _ in range(3))
        for u, (x, y) in enumerate(states):
            entry[u], before[u] = (arcs[2][x[enter[u]]], arcs[3][x[enter[u]]]) if lead[u] else (0, self.start)
            if leave[u] is None:
                goal[u] = lead[u] + body[u]
            else:
                k = y[leave[u]]
                goal[u] = arcs[2][k] if arcs[1][k] >= lead[u] else entry[u]
        inside = self._inside(arcs, lead, body)
        _, by = self.ways(inside, entry[:, None], before[:, None])
        return self._back(inside, by[:, :, 0], entry, goal)

    def numbers(self, found, originals: list[str]) -> list[bytes]:
        """found: what best() or trace() returns for units whose characters are those of the originals."""
        piece, start, count = found
        at = np.concatenate([[0], np.cumsum(count)])
        data, ends = piece.astype("<u4").tobytes(), (4 * at).tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:])]
        for k in np.unique(np.searchsorted(at, np.flatnonzero(piece == self.unknown), side="right") - 1).tolist():
            own: list[int] = []
            for p, i in zip(piece[at[k] : at[k + 1]].tolist(), start[at[k] : at[k + 1]].tolist()):
                own += [self.byte[b] for b in originals[k][i].encode("utf-8", "surrogatepass")] if p == self.unknown else [p]
            out[k] = np.array(own, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Numbers of four bytes each, lowest first; texts of any length, each as one chunk."""
        cut = [self._units(t) for t in texts]
        words = dict.fromkeys(itertools.chain.from_iterable(cut))
        if len(self.held) > MEMORY // 2:  # the units of late stay for another round
            self.held, self.before = {}, self.held
        held, before, new = self.held, self.before, []
        over: dict[str, bytes] = {}
        for w in words:
            if w not in held:
                if (x := before.get(w)) is not None:
                    held[w] = x
                else:
                    new.append(w)
        new.sort(key=len)
        at = 0
        while at < len(new):
            n = max(1, min(10_000, 2_000_000 // (len(new[at]) + 16)))
            some = [w for w in new[at : at + n] if len(w) <= 2 * len(new[at]) + 16]
            to = [w.replace(MARK, OTHER).replace(" ", MARK) for w in some]
            found = dict(zip(some, self.numbers(self.best(to), some)))
            (held if len(some[-1]) <= LONG else over).update(found)
            at += len(some)
        if over:
            return [b"".join([held.get(w) or over[w] for w in ws]) for ws in cut]
        return [b"".join([held[w] for w in ws]) for ws in cut]

    def _units(self, text: str) -> list[str]:
        """The units, with a space where the mark goes; the first one has the mark put before the text."""
        if not text:
            return []
        return self.unit.findall(" " + text) if self.cuts else [" " + text]

    def legs(self, part: str, lead: int, body: int) -> tuple[int, int] | None:
        """Places in a chunk's body where a word starts: the first that no piece from before reaches over, and the last."""
        if not self.cuts or not (m := _word_start.search(part, lead + self.longest, lead + body)):
            return None
        last = part.rfind(MARK, m.start(), lead + body)
        while part[last - 1] == MARK and last > m.start():
            last = part.rfind(MARK, m.start(), last)
        return m.start(), last

    def matrices(self, parts: list[str], lead: list[int], body: list[int]) -> list[np.ndarray]:
        """transfer(), by way of the words' starts where a chunk has any."""
        cut = [self.legs(*x) for x in zip(parts, lead, body)]
        out: list[np.ndarray | None] = [None] * len(parts)
        whole, short = [k for k, x in enumerate(cut) if not x], [k for k, x in enumerate(cut) if x]
        for i in range(0, len(whole), GROUP):
            some = whole[i : i + GROUP]
            for k, m in zip(some, self.transfer([parts[k] for k in some], [lead[k] for k in some], [body[k] for k in some])):
                out[k] = m
        if short:
            heads = self.transfer([parts[k][: cut[k][0]] for k in short], [lead[k] for k in short], [cut[k][0] - lead[k] for k in short])
            tails = self.transfer([parts[k][cut[k][1] :] for k in short], [0] * len(short), [lead[k] + body[k] - cut[k][1] for k in short])
            for k, head, tail in zip(short, heads, tails):
                out[k] = head.max(axis=1)[:, None] + tail
        return out

    def traced(self, parts: list[str], lead: list[int], body: list[int], enter: list[int], leave: list[int]) -> list[bytes]:
        """The ids of the pieces that start in each chunk's body. parts: as they are in the text, with spaces."""
        marked = [_marked(x) for x in parts]
        cut = [self.legs(*x) for x in zip(marked, lead, body)]
        out = [b""] * len(parts)
        whole, short = [k for k, x in enumerate(cut) if not x], [k for k, x in enumerate(cut) if x]
        for i in range(0, len(whole), GROUP):
            some = whole[i : i + GROUP]
            found = self.trace([marked[k] for k in some], *([x[k] for k in some] for x in (lead, body, enter, leave)))
            for k, x in zip(some, self.numbers(found, [parts[k] for k in some])):
                out[k] = x
        if short:
            first, last = ([cut[k][side] for k in short] for side in (0, 1))
            heads = self.trace([marked[k][:a] for k, a in zip(short, first)], [lead[k] for k in short], [a - lead[k] for k, a in zip(short, first)], [enter[k] for k in short], [None] * len(short))
            tails = self.trace([marked[k][z:] for k, z in zip(short, last)], [0] * len(short), [lead[k] + body[k] - z for k, z in zip(short, last)], [0] * len(short), [leave[k] for k in short])
            between = self.encode([parts[k][a + 1 : z] for k, a, z in zip(short, first, last)])
            heads, tails = self.numbers(heads, [parts[k] for k in short]), self.numbers(tails, [parts[k][z:] for k, z in zip(short, last)])
            for k, *x in zip(short, heads, between, tails):
                out[k] = b"".join(x)
        return out

    def decode(self, numbers: bytes) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(numbers, "<u4").tolist()]).decode("utf-8", "surrogatepass")[1:]


def padded(matrices: list[np.ndarray]) -> np.ndarray:
    """Square matrices of one size; what is added weighs minus infinity."""
    n = max(max(m.shape) for m in matrices)
    return np.stack([np.pad(m, ((0, n - m.shape[0]), (0, n - m.shape[1])), constant_values=-np.inf) for m in matrices])


def scan(matrices: np.ndarray) -> np.ndarray:
    """States at the n + 1 boundaries of the best way through n transfer matrices, from state 0 to the best last one."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        pairs = len(m) // 2
        done = [(m[i : min(i + 64, 2 * pairs) : 2, :, :, None] + m[i + 1 : min(i + 64, 2 * pairs) : 2, None]).max(axis=2) for i in range(0, 2 * pairs, 64)]
        levels.append(np.concatenate([*done, m[2 * pairs :]]))
    states = np.array([0, levels[-1][0, 0].argmax()])
    for m in reversed(levels[:-1]):
        pairs = len(m) // 2
        new = np.zeros(len(m) + 1, np.int64)
        new[::2][: len(states) - len(m) % 2] = states[: len(states) - len(m) % 2]
        new[-1] = states[-1]
        k = np.arange(pairs)
        new[1 : 2 * pairs : 2] = (m[0 : 2 * pairs : 2][k, states[:pairs]] + m[1 : 2 * pairs : 2][k, :, states[1 : pairs + 1]]).argmax(axis=1)
        states = new
    return states


_vocabularies: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """One per worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _marked(text: str) -> str:
    return text.replace(MARK, OTHER).replace(" ", MARK)


def encoded(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (four bytes each, lowest first)."""
    spark = docs.sparkSession

    def whole(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        v, seen = state
        texts = batch.column("text").to_pylist()
        small = [t if len(t) <= giant else "" for t in texts]
        ids = [x for i in range(0, len(small), GO) for x in v.encode(small[i : i + GO])]
        rows = []
        for doc, text, found in zip(batch.column("doc_id").to_pylist(), texts, ids):
            uid = TaskContext.get().partitionId() << 40 | seen[0]
            seen[0] += 1
            if len(text) <= giant:
                rows.append((uid, doc, 0, 1, found, None, 0, 0))
                continue
            text = " " + text
            n = -(-len(text) // chunk)
            for k in range(n):
                lead = min(v.longest, k * chunk)
                rows.append((uid, doc, k, n, None, text[k * chunk - lead : (k + 1) * chunk + v.longest - 1], lead, min(chunk, len(text) - k * chunk)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["uid", "doc_id", "chunk", "chunks", "ids", "part", "lead", "body"])

    first = written(by_batch(id_text(docs), whole, "uid long, doc_id long, chunk int, chunks int, ids binary, part string, lead int, body int", lambda: (vocabulary(path), [0])), "pieces-first")
    large = first.where("part IS NOT NULL")
    if large.isEmpty():
        return first.select("doc_id", "ids")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def matrices(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        parts, lead, body = ([_marked(t) for t in batch.column("part").to_pylist()], *(batch.column(c).to_pylist() for c in ("lead", "body")))
        found = v.matrices(parts, lead, body)
        names = ["uid", "chunk", "rows", "matrix"]
        return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), pa.array([len(m) for m in found], pa.int32()), pa.array([(m == 0).tobytes() for m in found], pa.binary())], names)

    def boundaries(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for uid, own in zip(batch.column("uid").to_pylist(), batch.column("own").to_pylist()):
            open_ways = (np.frombuffer(r["matrix"], bool).reshape(r["rows"], -1) for r in sorted(own, key=lambda r: r["chunk"]))
            states = scan(padded([np.where(m, 0.0, -np.inf) for m in open_ways])).tolist()
            out += [(uid, k, *x) for k, x in enumerate(zip(states, states[1:]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["uid", "chunk", "entry", "leave"])

    def trace(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("part", "lead", "body", "entry", "leave")]
        ids = v.traced(*columns)
        return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("chunk"), pa.array(ids, pa.binary())], ["uid", "doc_id", "chunk", "ids"])

    setup = lambda: vocabulary(path)
    dealt = large.select("uid", "chunk", "part", "lead", "body").repartition(tasks, "uid", "chunk")
    # A document's matrices number as its chunks, and it is itself one row.
    per_doc = by_batch(dealt, matrices, "uid long, chunk int, rows int, matrix binary", setup).groupBy("uid").agg(F.collect_list(F.struct("chunk", "rows", "matrix")).alias("own"))
    states = written(by_batch(per_doc, boundaries, "uid long, chunk int, entry int, leave int"), "pieces-states")
    traced = by_batch(large.join(states, ["uid", "chunk"]).select("uid", "doc_id", "chunk", "part", "lead", "body", "entry", "leave"), trace, "uid long, doc_id long, chunk int, ids binary", setup)
    joined = traced.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("own"))
    # The parts' numbers in order, put together as hexadecimal digits of bytes.
    giants = joined.select("doc_id", F.unhex(F.concat_ws("", F.transform("own", lambda r: F.hex(r["ids"])))).alias("ids"))
    return first.where("part IS NULL").select("doc_id", "ids").union(giants)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, ids; null ids as no pieces."""

    def run(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return by_batch(ids.select("doc_id", "ids"), run, "doc_id long, text string", lambda: vocabulary(path))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 (of the text that decoding gives)."""

    def run(batch: pa.RecordBatch, v: Vocabulary) -> pa.RecordBatch:
        ids = batch.column("ids").to_pylist()
        columns = [pa.array([len(x) // 4 for x in ids]), pa.array([zlib.crc32(x) for x in ids]), pa.array([hashlib.sha256(v.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return by_batch(encoded(docs, path), run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string", lambda: vocabulary(path))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
