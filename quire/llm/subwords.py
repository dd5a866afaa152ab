"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

A text's lattice has an edge for every vocabulary piece that matches at a place; a segmentation is a path. No piece crosses
a word's beginning or a line feed, so the lattice is a chain of small unit lattices, and one table of units serves a task.
Backward sums over a unit's paths give, for each place, the exact log mass of all ways to finish: the heuristic of the
search, and the chance of each edge.

Gumbel top-k: the search holds sets of paths, each with the largest perturbed log-probability in it as its key. The best set
is opened along one path drawn in proportion to mass, which keeps the key; the paths that leave it at each place form sets
whose keys are Gumbel variables of their mass, truncated at the key. So the k best come out in order, all distinct, exactly
as if every path of the lattice had been perturbed. The key of the best set left over is the threshold of inclusion scores:
``1 - exp(-exp(log_prob - threshold))``. All noise comes from the row's key, so results don't depend on partitions.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import fresh
from quire.llm.textkit import mix, tidy

#: A unit begins at each run of spaces; a line feed, and the character that stands for a space, are units of their own.
UNIT = re.compile(" +[^ \n▁]*|[^ \n▁]+|\n|▁")
#: So do runs of letters and digits, and of other characters, in vocabularies without pieces of both.
LETTER = "0-9A-Za-zÀ-ÖØ-öø-ɏͰ-῿"
FINE_UNIT = re.compile(f" *[{LETTER}]+| *[^{LETTER} \n▁]+| +|\n|▁")
SPACE = "▁"
#: Kinds of characters: a space, one that is a unit of its own, a letter, any other.
BLANK, LONE, LETTERS, REST = range(4)
#: Stands for a text's own ▁; past the last code point.
ESCAPED = 0x110000
#: Units of a task's table; beyond it the most frequent quarter stays. Some 400 bytes each.
UNITS_KEPT = 250_000
#: Units that a worker keeps from one task to the next.
UNITS_BETWEEN = 80_000
#: Log mass, against a row's whole mass, below which sets of paths are not told from none: far under double precision.
NONE_LEFT = -80.0
#: Characters that are worked on at once; more take memory and save no time.
CHUNK_CHARS = 250_000
#: Leading bits of a hash that say where to look for it.
SLOT_BITS = 17
_ONE = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _further(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of spans that are one code point longer."""
    h = (h ^ points) * _ONE
    return h ^ (h >> np.uint64(29))


class Index(dict):
    """Numbers of units; one that is not there gets the next number and is noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n


class Units:
    """The unit lattices of one model, as flat arrays of edges, unit by unit. Edges of a state are in one run, from likely to unlikely;
    a state is named by the first of them."""

    def __init__(self, path: str, theta: float) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.theta = theta
        ids = range(self.model.get_piece_size())
        plain = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.pieces = {self.model.id_to_piece(i): i for i in plain}
        self.bytes = {self.model.id_to_piece(i): i for i in ids if self.model.is_byte(i)}
        # The bytes that each id stands for.
        spelled = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for i in ids:
            if self.model.is_control(i) or self.model.is_unknown(i):
                spelled[i] = self.model.decode([i]).encode()
        self.spelled = pa.array(spelled, pa.large_binary())
        score = np.array([self.model.get_score(i) for i in ids])
        ranks = bool(np.all(score[plain] <= 0) and np.all(score[plain] == np.round(score[plain])))
        # A merge list has ranks for scores: the chance of a piece then falls as one over its rank.
        self.weight = theta * (-np.log(2 - np.maximum(score, -len(score))) if ranks else score)
        self.byte_weight = float(self.weight[plain].min())
        # Beginnings of pieces by the hash of their code points (64 bits, for some ten thousands), by length, and the piece
        # that each one is, or -1.
        self.longest = max(map(len, self.pieces))
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            own = sorted({p[:n] for p in self.pieces if len(p) >= n})
            points, h = _points("".join(own)), np.zeros(len(own), dtype=np.uint64)
            for i in range(n):
                h = _further(h, points[i::n])
            order = np.argsort(h)
            h = h[order]
            # Where each run of leading bits begins: most hold one hash or none.
            slots = np.searchsorted(h >> np.uint64(64 - SLOT_BITS), np.arange(1 << SLOT_BITS, dtype=np.uint64)).astype(np.int32)
            self.by_length.append((h, np.array([self.pieces.get(p, -1) for p in own], dtype=np.int32)[order], np.minimum(slots, len(h) - 1)))
        mixed = re.compile(f"[{LETTER}][^{LETTER}]|[^{LETTER}▁][{LETTER}]")
        self.unit = UNIT if any(mixed.search(p) for p in self.pieces) else FINE_UNIT
        # The same rule by pairs of neighbours: kinds of code points (all past the last one are of its kind), and which of two begins one.
        letter = re.compile(f"[{LETTER}]")
        self.kinds = np.array([LETTERS if self.unit is UNIT or letter.match(chr(c)) else REST for c in range(ord(SPACE) + 2)], dtype=np.uint8)
        self.kinds[[ord(" "), ord("\n"), ord(SPACE)]] = BLANK, LONE, LONE
        self.breaks = np.array([b == LONE or a not in (b, BLANK) for a in range(4) for b in range(4)])
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.room: dict[str, np.ndarray] = {}
        self.extra: list[list[int]] = []  # characters outside the vocabulary, as byte pieces
        self.extra_of: dict[int, int] = {}
        self.seen = np.empty(0, dtype=np.int64)
        self.state = np.empty(0, dtype=np.int64)  # where each unit begins
        self.to, self.piece = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.cum, self.logp = np.empty(0, dtype=np.float32), np.empty(0, dtype=np.float32)
        self.best_at, self.best = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32)

    def _append(self, name: str, new: np.ndarray) -> None:
        """Add to one of the flat arrays, in room for half as much again, so that chunks don't copy the whole table each."""
        old, room = getattr(self, name), self.room.get(name)
        n = len(old)
        if room is None or old.base is not room or len(room) < n + len(new):
            room = self.room[name] = np.empty((n + len(new)) * 3 // 2, dtype=old.dtype)
            room[:n] = old
        room[n : n + len(new)] = new
        setattr(self, name, room[: n + len(new)])

    def as_bytes(self, c: str) -> list[int]:
        return [self.bytes[f"<0x{b:02X}>"] for b in c.encode()]

    def lookup(self, units: list[str]) -> np.ndarray:
        """Numbers of the units; new ones enter the table."""
        out = self._numbers(units)
        self.seen += np.bincount(out, minlength=len(self.seen))
        return out

    def _numbers(self, units: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.index.__getitem__, units), dtype=np.int64, count=len(units))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._add(new)
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, each text after a space, and where each text's begin (with the end of the last). Only
        different units are made strings and looked up."""
        text = "".join([" " + t for t in texts if t])
        cuts = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        if not text:
            return np.empty(0, dtype=np.int64), cuts
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kind = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        begins = np.empty(len(points), dtype=bool)
        begins[1:] = self.breaks[kind[:-1] * 4 + kind[1:]]
        begins[cuts[:-1][np.diff(cuts) > 0]] = True
        first = np.flatnonzero(begins)
        raw, at = text.encode(), np.append(first, len(points))
        if len(raw) > len(points):
            size = np.ones(len(points), dtype=np.uint8)
            for least in (0x80, 0x800, 0x10000):
                size += points >= least
            at = np.concatenate(([0], np.cumsum(np.add.reduceat(size, first, dtype=np.int64))))
        units = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(raw)).dictionary_encode()
        codes = units.indices.to_numpy()
        numbers = self._numbers(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.seen[numbers] += np.bincount(codes, minlength=len(numbers))
        return numbers[codes], np.searchsorted(first, cuts)

    def shrink(self, most: int) -> None:
        """Keep the most frequent units only. What a unit's lattice holds doesn't depend on the others."""
        if len(self.index) <= most:
            return
        keep = np.sort(np.argpartition(-self.seen, most)[:most])
        names = list(self.index)
        self.index = Index()
        self.index.update((names[i], n) for n, i in enumerate(keep.tolist()))
        lo = self.state[keep]
        edges = np.append(self.state, len(self.to))[keep + 1] - lo
        new_lo = np.cumsum(edges) - edges
        moved = np.repeat(lo - new_lo, edges)
        e = moved + np.arange(len(moved))
        to = self.to[e]
        self.to = np.where(to < 0, to, to - moved).astype(np.int32)
        self.piece, self.cum, self.logp = self.piece[e], self.cum[e], self.logp[e]
        n = self.best_at[keep + 1] - self.best_at[keep]
        new_at = np.concatenate(([0], np.cumsum(n)))
        self.best = self.best[np.repeat(self.best_at[keep] - new_at[:-1], n) + np.arange(n.sum())]
        self.best_at, self.state, self.seen = new_at, new_lo, self.seen[keep]
        self.room.clear()

    def _best(self, new: list[str]) -> list[list[int]]:
        """The model's own segmentation of each unit."""
        shown = [u[1:] if u[0] == " " else "\n" + u for u in new]
        out = self.model.encode(shown, num_threads=1)
        for i, u in enumerate(new):
            if u == SPACE:
                out[i] = self.as_bytes(u)
            elif u[0] != " ":
                out[i] = out[i][2:]
            elif u == " ":
                out[i] = [self.pieces[SPACE]]
        return out

    def _add(self, new: list[str]) -> None:
        best = self._best(new)
        self._append("best_at", self.best_at[-1] + np.cumsum([len(b) for b in best]))
        self._append("best", np.fromiter(itertools.chain.from_iterable(best), dtype=np.int32))
        table, edges = len(self.weight), len(self.to)
        # All units' characters in one row, each unit with one more place for its end.
        points = _points("".join(new).replace(" ", SPACE))
        sizes = np.array([len(u) for u in new], dtype=np.int64)
        points[[int(sizes[:i].sum()) for i, u in enumerate(new) if u == SPACE]] = ESCAPED
        first = np.cumsum(sizes + 1) - (sizes + 1)
        place = np.arange(len(points)) + np.repeat(np.arange(len(new)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters to the unit's end
        base = len(points) + len(new)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, pieces, log weights, by length
        at, h = np.arange(len(points)), np.zeros(len(points), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            h = _further(h, points[at + n - 1])
            hashes, ids, slots = self.by_length[n - 1]
            i = slots[h >> np.uint64(64 - SLOT_BITS)]
            before = np.flatnonzero(hashes[i] < h)
            while len(before := before[i[before] + 1 < len(hashes)]):
                i[before] += 1
                before = before[hashes[i[before]] < h[before]]
            begun = hashes[i] == h
            of = np.where(begun, ids[i], -1)
            src, of = (at[hit], of[hit]) if not (hit := of >= 0).all() else (at, of)
            w = self.weight[of]
            if n == 1:
                odd = np.flatnonzero(~hit)
                extra = [self._extra(int(c)) for c in points[at[odd]]]
                src, of = np.concatenate((src, at[odd])), np.concatenate((of, np.array(extra, dtype=np.int32) + table))
                w = np.concatenate((w, [self.byte_weight * len(self.extra[x]) for x in extra]))
            found.append((place[src], of.astype(np.int32), w))
            at, h = at[begun], h[begun]
        counts = np.zeros(base, dtype=np.int64)
        for src, _, _ in found:
            counts[src] += 1
        begin = np.cumsum(counts) - counts
        total = int(counts.sum())
        piece, dst, w = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int64), np.empty(total)
        free = begin.copy()
        for n in range(self.longest, 0, -1):  # longer pieces are likelier, and are tried first
            src, of, weight = found[n - 1]
            i = free[src]
            piece[i], dst[i], w[i] = of, src + n, weight
            free[src] += 1
        # Backward sums, for all units at once: places by their distance from the unit's end.
        ends = np.repeat(first + sizes, sizes + 1)
        distance = ends - np.arange(base)
        # The way by single characters bounds a unit's mass from below; where that is too small for doubles, logs are summed.
        single = np.zeros(base)
        single[found[0][0]] = found[0][2]
        deep = np.repeat(np.add.reduceat(single, first) < -600.0, sizes + 1)
        beta = np.zeros(base)
        for part, logs in ((np.flatnonzero(~deep), False), (np.flatnonzero(deep), True)):
            if not len(part):
                continue
            order = part[np.argsort(distance[part], kind="stable")]
            n = counts[order]
            at_edge = np.concatenate(([0], np.cumsum(n)))
            e = np.repeat(begin[order] - at_edge[:-1], n) + np.arange(at_edge[-1])
            weights, to = w[e] if logs else np.exp(w[e]), dst[e]
            beta[order] = 0.0 if logs else 1.0
            cuts = np.searchsorted(distance[order], np.arange(1, int(distance[order[-1]]) + 2)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                start, x = at_edge[lo:hi] - at_edge[lo], weights[at_edge[lo] : at_edge[hi]]
                x = x + beta[to[at_edge[lo] : at_edge[hi]]] if logs else x * beta[to[at_edge[lo] : at_edge[hi]]]
                if logs:
                    top = np.maximum.reduceat(x, start)
                    beta[order[lo:hi]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n[lo:hi])), start))
                else:
                    beta[order[lo:hi]] = np.add.reduceat(x, start)
            if not logs:
                beta[part] = np.log(beta[part])
        src = np.repeat(np.arange(base), counts)
        logp = np.minimum(w + beta[dst] - beta[src], 0.0)
        logp[begin[counts == 1]] = 0.0  # rounding gives no mass to leaving a state by an edge that it doesn't have
        cum = np.exp(logp)
        more = np.flatnonzero(counts > 1)
        for k in range(1, int(counts.max())):  # state by state, so that sums don't depend on what else is in the table
            more = more[counts[more] > k]
            cum[begin[more] + k] += cum[begin[more] + k - 1]
        cum[(begin + counts - 1)[counts > 0]] = 2.0  # rounding never passes a state's last edge
        self._append("state", begin[first] + edges)
        self._append("seen", np.zeros(len(new), dtype=np.int64))
        self._append("to", np.where(dst == ends[dst], -1, begin[dst] + edges))
        self._append("piece", piece)
        self._append("cum", cum)
        self._append("logp", logp)

    def _extra(self, point: int) -> int:
        """The number, among those after the vocabulary, of a character that is written as bytes."""
        if point not in self.extra_of:
            self.extra_of[point] = len(self.extra)
            self.extra.append(self.as_bytes(SPACE if point == ESCAPED else chr(point)))
        return self.extra_of[point]

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids for a row of units, and how many each has."""
        n = self.best_at[units + 1] - self.best_at[units]
        at = np.repeat(self.best_at[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.best[at], n

    def draw(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each state to its unit's end, drawn in proportion to mass: edges in order, and how many each has."""
        active, e, steps = np.arange(len(states)), states.astype(np.int64), []
        n = np.empty(len(states), dtype=np.int64)
        while len(active):
            u = uniform(keys, len(steps))
            open_ = np.flatnonzero(self.cum[e] < u)
            at, u = e[open_], u[open_]
            while len(open_):
                at += 1
                more = self.cum[at] < u
                e[open_] = at
                open_, at, u = open_[more], at[more], u[more]
            steps.append((active, e))
            to = self.to[e]
            n[active] = len(steps)
            go = np.flatnonzero(to >= 0)
            active, keys, e = active[go], keys[go], to[go].astype(np.int64)
        at = np.cumsum(n) - n
        out = np.empty(n.sum(), dtype=np.int64)
        for i, (a, e) in enumerate(steps):
            out[at[a] + i] = e
        return out, n

    def ids(self, edges: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids along paths that lie one after the other, and how many each path has; ``n``: how many edges it has."""
        of, table = self.piece[edges], len(self.weight)
        odd = np.flatnonzero(of >= table)
        if not len(odd):
            return of, n
        size = np.ones(len(of), dtype=np.int64)
        extra = [self.extra[x] for x in (of[odd] - table).tolist()]
        size[odd] = [len(x) for x in extra]
        ends = np.cumsum(size)
        out = np.repeat(of, size)
        first = ends[odd] - size[odd]
        for i, x in zip(first.tolist(), extra, strict=True):
            out[i : i + len(x)] = x
        return out, np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))])

    def spells(self, ids: np.ndarray, cuts: list[int], texts: list[str]) -> list[bool]:
        """Whether ids ``cuts[i]`` to ``cuts[i + 1]`` decode to text ``i``. The space before each text is compared as well."""
        _, at, data = self.spelled.take(pa.array(ids)).buffers()
        at = np.frombuffer(at, dtype=np.int64)[cuts].tolist()
        return [bytes(data[a:z]) == (" " + t if t else "").encode() for a, z, t in zip(at[:-1], at[1:], texts, strict=True)]


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers within (0, 1) from counters."""
    x = mix(keys + np.uint64((step + 1) * int(_ONE) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def mix_one(x: int) -> int:
    """:func:`mix` of one number."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 33)


def uniform_one(key: int, step: int) -> float:
    """:func:`uniform` of one key."""
    return float((mix_one(key + (step + 1) * int(_ONE)) >> 11) + 0.5) * 2.0**-53


def _below(phi: np.ndarray, u: np.ndarray, limit: float | np.ndarray) -> np.ndarray:
    """Gumbel variables of log mass ``phi``, truncated at ``limit``."""
    g = phi - np.log(-np.log(u))
    return -np.logaddexp(-g, -limit)


class Search:
    """The sets of paths of one row, as far as they are open. ``base`` is the row's key."""

    def __init__(self, units: Units, base: np.uint64) -> None:
        self.units, self.base = units, base
        self.paths: list[tuple[np.ndarray, float, float]] = []  # edges, log probability, perturbed
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []  # of each path: place keys, log mass before each place
        self.gone: dict[tuple[int, int], list[int]] = {}

    def best(self) -> tuple[int, int, float]:
        """Path, place and key of the best set left."""
        tops = [(float(k.max()), r) for r, (k, _) in enumerate(self.sets) if len(k)]
        value, r = max(tops, default=(-np.inf, 0), key=lambda x: (x[0], -x[1]))
        return r, int(self.sets[r][0].argmax()) if value > -np.inf else 0, value

    def leave(self, r: int, place: int, value: float) -> int:
        """The edge, other than those already taken, by which the best path of a set leaves path ``r``; the set keeps the rest."""
        units, (edges, _, _) = self.units, self.paths[r]
        taken = self.gone.setdefault((r, place), [int(edges[place])])
        first = int(edges[place])
        while first and units.cum[first - 1] < 2.0:
            first -= 1
        last = first
        while units.cum[last] < 2.0:
            last += 1
        rest = [e for e in range(first, last + 1) if e not in taken]
        p = np.cumsum(np.exp(units.logp[rest]))
        key = mix_one(int(self.base) + place)
        u = uniform_one(key, 5000 + len(self.paths))
        e = rest[min(int(np.searchsorted(p, u * p[-1])), len(rest) - 1)]
        taken.append(e)
        keys, before = self.sets[r]
        left = [x for x in rest if x != e]
        keys[place] = -np.inf
        if left:
            phi = before[place] + np.logaddexp.reduce(units.logp[left])
            keys[place] = _below(phi, uniform_one(key, 9000 + len(self.paths)), value)
        return e


def opened(units: Units, searches: list[Search], paths: list[np.ndarray], fresh: list[int], values: list[float]) -> None:
    """Add a path to each search. From place ``fresh`` on, leaving the path is a new set of paths; its key is a Gumbel
    variable of its mass, truncated at the path's value. Places that next to no mass reaches have no sets."""
    sizes = np.array([len(p) for p in paths])
    begin = np.cumsum(sizes) - sizes
    cost = -units.logp[np.concatenate(paths)].astype(np.float64)
    run = np.empty(len(cost))
    reached = np.empty(len(paths), dtype=np.int64)
    for i, (a, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):  # row by row: sums don't depend on the rows around
        np.cumsum(cost[a : a + n], out=run[a : a + n])
        reached[i] = run[a : a + n].searchsorted(-NONE_LEFT) + 1
    reached = np.minimum(np.maximum(reached, fresh), sizes)
    cuts = np.concatenate(([0], np.cumsum(reached)))
    row = np.repeat(np.arange(len(paths)), reached)
    place = np.arange(len(row)) - cuts[row]
    near = begin[row] + place
    lead, before_near = -cost[near], cost[near] - run[near]
    base = np.array([s.base for s in searches], dtype=np.uint64)[row]
    turn = len(searches[0].paths)
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = before_near + np.log(-np.expm1(lead))
        phi[place < np.array(fresh)[row]] = -np.inf
        u = uniform(mix(base + place.astype(np.uint64) * _ONE), 1000 + turn)
        keys = np.where(np.isneginf(phi), -np.inf, _below(phi, u, np.array(values)[row]))
    total = -run[begin + sizes - 1]
    for s, path, p, v, a, z in zip(searches, paths, total.tolist(), values, cuts[:-1], cuts[1:], strict=True):
        s.paths.append((path, p, v))
        s.sets.append((keys[a:z].copy(), before_near[a:z]))


def sample(units: Units, rows: list[np.ndarray], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each row of units, up to k distinct segmentations: ids, log probability, log of the inclusion score."""
    searches = [Search(units, key) for key in keys]
    # What is to be drawn in this round: row, edges so far, state within a unit (or -1), units left, fresh place, value.
    todo = [(i, np.empty(0, dtype=np.int64), -1, rows[i], 0, float(-np.log(-np.log(uniform(keys[i : i + 1], 0)[0])))) for i in range(len(rows)) if len(rows[i])]
    for turn in range(k):
        if not todo:
            break
        starts, places, cuts = [], [], [0]
        for i, _, state, left, _, _ in todo:
            if state >= 0:
                starts.append(np.array([state]))
            starts.append(units.state[left])
            places.append(np.arange(len(rows[i]) - len(left) + 2 - (state >= 0), len(rows[i]) + 2, dtype=np.uint64))
            cuts.append(cuts[-1] + len(places[-1]))
        owner = np.repeat(keys[[x[0] for x in todo]], np.diff(cuts))
        edges, n = units.draw(np.concatenate(starts), mix(owner + np.concatenate(places) * _ONE) + np.uint64(turn << 32))
        ends = np.concatenate(([0], np.cumsum(n)))
        paths = [np.concatenate((x[1], edges[ends[a] : ends[z]])) for x, a, z in zip(todo, cuts[:-1], cuts[1:], strict=True)]
        opened(units, [searches[x[0]] for x in todo], paths, [x[4] for x in todo], [x[5] for x in todo])
        if turn + 1 == k:
            break
        todo, before = [], todo
        for i in (x[0] for x in before):
            s = searches[i]
            r, place, value = s.best()
            if value == -np.inf:
                continue
            path = s.paths[r][0]
            e = s.leave(r, place, value)
            done = int((units.to[path[:place]] < 0).sum())  # units that end before the place
            state = int(units.to[e])
            todo.append((i, np.append(path[:place], e), state, rows[i][done + 1 :], place + 1, value))
    edges = [x[0] for s in searches for x in s.paths]
    if not edges:
        return [[] for _ in searches]
    ids, n = units.ids(np.concatenate(edges), np.array([len(x) for x in edges]))
    ends = np.cumsum(n).tolist()
    each = (ids[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True))
    out = []
    for s in searches:
        threshold = s.best()[2] if s.paths else -np.inf
        scores = []
        for _, logp, _ in s.paths:
            gap = logp - threshold
            scores.append((next(each), logp, 0.0 if gap > 6 else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))))
        out.append(scores)
    return out


@lru_cache(maxsize=1)
def units_of(path: str, theta: float) -> Units:
    return Units(path, theta)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about ``CHUNK_CHARS``."""
    first, texts, total = 0, [], 0
    for i, value in enumerate(batch.column(1)):
        texts.append(value.as_py() or "")
        total += len(texts[-1])
        if total >= CHUNK_CHARS:
            yield first, texts
            first, texts, total = i + 1, [], 0
    if texts:
        yield first, texts


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, theta: float = 1.0, path: str | None = None, units_kept: int = UNITS_KEPT) -> DataFrame:
    """``<id>, ids, round_trip, samples`` for every row: the model's segmentation of the whole text, whether decoding it gives
    the text again, and ``k`` distinct sampled ones (``ids, log_prob, log_inclusion``), from the largest perturbed down.

    A null or empty text has no pieces and no samples; a text with fewer than ``k`` segmentations has them all. Texts of any
    length are read whole, and an empty table gives no rows. Segmentations that tie in probability are told apart by their noise. A text that
    holds the character that stands for a space has it as bytes, so that it comes back. Noise is seeded by the id: repeated
    rows and rows with one id and text get the same samples. ``theta`` sharpens (above 1) or flattens the distribution.
    ``path`` is a model file that executors can open. ``units_kept`` bounds a worker's memory at the cost of time, not the results.
    Other columns are not read.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    sampled = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.empty(0), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = units_of(path, theta)
        for batch in batches:
            for first, texts in _rows(batch):
                if len(units.index) > units_kept:
                    units.shrink(units_kept // 4)
                every, cuts = units.split(texts)
                rows = [every[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                ids, n = units.encode(every)
                ends = np.concatenate(([0], np.cumsum(n)))[cuts]
                same = units.spells(ids, ends, texts)
                best = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                keys = mix(batch.column(2).slice(first, len(texts)).to_numpy().view(np.uint64))
                drawn = sample(units, rows, keys, k)
                flat = [x for s in drawn for x in s]
                at = np.cumsum([0, *map(len, drawn)]).astype(np.int32)
                parts = pa.StructArray.from_arrays([lists([x[0] for x in flat]), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64())], fields=list(sampled))
                columns = [batch.column(0).slice(first, len(texts)), best, pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(at), parts)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "round_trip", "samples"])
        units.shrink(min(UNITS_BETWEEN, units_kept // 2))

    kind = docs.schema[id_col].dataType.simpleString()
    seeded = docs.select(id_col, F.col(text_col), F.xxhash64(id_col).alias(*fresh(docs, "seed")))
    return seeded.mapInArrow(tidy(run), f"`{id_col}` {kind}, ids array<int>, round_trip boolean, samples array<struct<ids:array<int>,log_prob:double,log_inclusion:double>>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``<id>, text`` from ids; null ids give the empty text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = units_of(path, 1.0).model
        for batch in batches:
            texts = model.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
