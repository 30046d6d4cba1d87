"""Secret scan: rules for known kinds, learned grammars for what looks alike.

Three kinds are found by rule (``assign``, ``access``, ``hex``; leftmost, not
overlapping within a kind). Their values are labelled credentials, from which
grammars are inferred: a kind's distinct values make a prefix tree, whose
states are merged where their outgoing and ending frequencies agree within
Hoeffding bounds, all the way down (state merging of red and blue states). The
result is a deterministic probabilistic automaton. Every other run of
credential characters is a candidate: its log likelihood under each kind's
automaton is set against that under ordinary runs' byte pairs. Where the
difference makes up for ``LEAST_ODDS`` and a character's share of it is half of
what all but 1 % of the labelled values have (short runs spend more on their
ends), the run is reported as ``like_<kind>``. Spans found by rule always stay; candidates that touch one
are left out.

Grammars are fitted on at most ``max_train`` distinct values a kind and
``max_ordinary`` ordinary runs, those of least hash over all texts, of 256
bytes at most; a kind with fewer than ``LEAST_VALUES`` gets none. Whole texts are scanned in
slices, rows where they lie: only these samples are shuffled, and the
automata (a few states each) go to all tasks. Offsets count code points, ends
are exclusive. Null and empty texts have no spans; repeated rows give repeated
rows; an empty table gives no rows and no grammar. Columns are carried in a
struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import saved
from .textbuf import BYTE_VALUES, buffer_of, pieces, prefix, returning, slices, window_hash, words

# fixed values: what the rules look for; their classes and letters are ASCII
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_LENGTH = {"assign": 8, "access": 16, "hex": 32}
KINDS = tuple(LEAST_LENGTH)
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

ORDINARY = "ordinary"
MAX_TRAIN = 2000
MAX_ORDINARY = 20_000
MAX_LENGTH = 256
LEAST_VALUES = 30
LEAST_RUN = 8
LEAST_ODDS = math.log(1e6)
QUANTILE = 0.01
MARGIN = 0.5
BACK_OFF = 20
ALPHA = 0.05
SLICE = 512 << 10
LONG_RUN = 512

RUN = np.zeros(256, bool)
RUN[list(ALPHABET)] = True
IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True
INNER = RUN & ~np.isin(np.arange(256), list(b"+/_.=-"))


# -- rules ----------------------------------------------------------------
def _rows_with(data: bytes, offs: np.ndarray, needles: Sequence[bytes]) -> set[int]:
    """Rows in which a needle stands (it may cross rows; that only costs a look)."""
    rows = set()
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offs, at, "right")) - 1
            rows.add(row)
            at = data.find(needle, int(offs[row + 1]))
    return rows


def _rows_with_hex(buf: np.ndarray, offs: np.ndarray) -> set[int]:
    """Rows with 16 aligned hex digits in a row; a run of 32 has such a block."""
    rows, step = set(), SLICE // 16 * 16
    for at in range(0, len(buf), step):
        part = buf[at:at + step]
        blocks = IS_HEX[part[:len(part) // 16 * 16]].reshape(-1, 16).all(1)
        rows.update((np.searchsorted(offs, at + np.flatnonzero(blocks) * 16, "right") - 1).tolist())
    return rows


def by_rule(buf: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """row -> (start, kind, end, value start, value end), ascending, in places of ``buf``."""
    data, found = buf.tobytes(), {}

    def look(row: int, kind: int, pattern: re.Pattern, group: int) -> None:
        for m in pattern.finditer(data, int(offs[row]), int(offs[row + 1])):
            if m.end(group) - m.start(group) >= LEAST_LENGTH[KINDS[kind]]:
                found.setdefault(row, []).append((m.start(), kind, m.end(), m.start(group), m.end(group)))

    for row in _rows_with(data.lower(), offs, KEYWORDS):
        look(row, 0, ASSIGN, 2)
    for row in _rows_with(data, offs, (b"AKIA",)):
        look(row, 1, ACCESS, 0)
    for row in _rows_with_hex(buf, offs):
        look(row, 2, HEX, 0)
    return {row: sorted(spans) for row, spans in found.items()}


def candidates(buf: np.ndarray, offs: np.ndarray, found: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(slice, starts, ends, row, place of the slice) of runs of 8 and more
    characters, without marks at their ends, that touch no span found by rule."""
    at, row_of = pieces(buf, offs, RUN, SLICE)
    taken = np.array(sorted((s, e) for spans in found.values() for s, _, e, _, _ in spans), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    for i, j in slices(at, SLICE):
        base = int(at[i])
        part = buf[base:at[j]]
        s, e, piece = words(part, at[i:j + 1] - base, RUN)
        keep = e - s >= LEAST_RUN
        s, e, piece = s[keep], e[keep], piece[keep]
        places = np.flatnonzero(INNER[part])
        if not len(places) or not len(s):
            continue
        first = places[np.minimum(np.searchsorted(places, s), len(places) - 1)]
        last = places[np.searchsorted(places, e) - 1] + 1
        keep = (first >= s) & (last <= e) & (last - first >= LEAST_RUN)
        s, e, piece = first[keep], last[keep], piece[keep]
        if len(taken):  # a span that begins before a run's end reaches into it
            k = np.searchsorted(taken[:, 0], base + e, "left")
            keep = (k == 0) | (reach[np.maximum(k, 1) - 1] <= base + s)
            s, e, piece = s[keep], e[keep], piece[keep]
        yield part, s, e, row_of[i + piece], base


# -- inference ------------------------------------------------------------
class Tree:
    """Counts of a prefix tree: visits, ends, and children by byte."""

    def __init__(self, values: Sequence[bytes]):
        self.visits, self.ends, self.to, self.n = [0], [0], [{}], [{}]
        for value in values:
            at = 0
            self.visits[0] += 1
            for b in value:
                if b not in self.to[at]:
                    self.to[at][b] = len(self.to)
                    for column, empty in ((self.visits, 0), (self.ends, 0), (self.to, {}), (self.n, {})):
                        column.append(empty)
                self.n[at][b] = self.n[at].get(b, 0) + 1
                at = self.to[at][b]
                self.visits[at] += 1
            self.ends[at] += 1

    def compatible(self, a: int, b: int, width: float) -> bool:
        """Whether a and b, and all below, end and go on alike within the bounds."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self.visits[a], self.visits[b]
            bound = width * (na ** -0.5 + nb ** -0.5)
            if bound >= 1 or a == b:  # no frequencies can differ by more
                continue
            if abs(self.ends[a] / na - self.ends[b] / nb) >= bound:
                return False
            for c in self.n[a].keys() | self.n[b].keys():
                if abs(self.n[a].get(c, 0) / na - self.n[b].get(c, 0) / nb) >= bound:
                    return False
                if c in self.to[a] and c in self.to[b]:
                    stack.append((self.to[a][c], self.to[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """The tree below b is counted into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.n[b].items():
                self.n[a][c] = self.n[a].get(c, 0) + n
                if c in self.to[a]:
                    stack.append((self.to[a][c], self.to[b][c]))
                else:
                    self.to[a][c] = self.to[b][c]

    def merged(self, alpha: float = ALPHA) -> list[int]:
        """Merge until every transition of the returned states leads to one of them."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            known = set(red)
            blue = [(-self.visits[t], r, c) for k, r in enumerate(red) for c, t in self.to[r].items() if t not in known]
            if not blue:
                return red
            _, parent, c = min(blue)  # the best known first
            state = self.to[parent][c]
            for r in red:
                if self.compatible(r, state, width):
                    self.to[parent][c] = r
                    self.fold(r, state)
                    break
            else:
                red.append(state)


@dataclass
class Automaton:
    """Transitions and log probabilities by state and byte; a missing one ends in
    the last state, which has none."""
    to: np.ndarray
    cost: np.ndarray
    end: np.ndarray
    least: float = 0.0

    @classmethod
    def infer(cls, values: Sequence[bytes], alpha: float = ALPHA) -> Automaton:
        tree = Tree(values)
        states = tree.merged(alpha)
        place = {s: k for k, s in enumerate(states)}
        dead = len(states)
        to, cost = np.full((dead + 1, 256), dead, np.int32), np.full((dead + 1, 256), -np.inf, np.float32)
        end = np.full(dead + 1, -np.inf)
        for s, k in place.items():
            for c, n in tree.n[s].items():
                to[k, c], cost[k, c] = place[tree.to[s][c]], math.log(n / tree.visits[s])
            if tree.ends[s]:
                end[k] = math.log(tree.ends[s] / tree.visits[s])
        return cls(to, cost, end)

    def score(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log likelihood of each run, all runs a byte a step; -inf where a
        transition is missing."""
        out = np.full(len(starts), -np.inf)
        size = ends - starts
        for k in np.flatnonzero(size > LONG_RUN):
            out[k] = self._one(buf[starts[k]:ends[k]])
        who = np.flatnonzero(size <= LONG_RUN)
        who = who[np.argsort(size[who], kind="stable")]  # the shortest leave at the front
        state, total, pos = np.zeros(len(who), np.int32), np.zeros(len(who)), 0
        while len(who):
            done = int(np.searchsorted(size[who], pos, "right"))
            out[who[:done]] = total[:done] + self.end[state[:done]]
            live = done + np.flatnonzero(total[done:] > -np.inf)
            who, state, total = who[live], state[live], total[live]
            b = buf[starts[who] + pos]
            total += self.cost[state, b]
            state = self.to[state, b]
            pos += 1
        return out

    def _one(self, run: np.ndarray) -> float:
        state, total, dead = 0, 0.0, len(self.end) - 1
        for b in run.tolist():
            total += float(self.cost[state, b])
            state = int(self.to[state, b])
            if state == dead:
                return -math.inf
        return total + float(self.end[state])


def byte_pairs(values: Sequence[bytes]) -> Automaton:
    """Ordinary runs: which byte follows which, backed off to single bytes. State 0 is the
    begin, state 1 + k follows the alphabet's k-th byte."""
    symbols = np.array(list(ALPHABET))
    index = np.zeros(256, np.int64)
    index[symbols] = np.arange(len(symbols))
    n = len(symbols)
    count = np.zeros((n + 1, n + 1))  # the last column: the end
    for value in values:
        row = index[np.frombuffer(value, np.uint8)]
        np.add.at(count, (np.concatenate(([0], row + 1)), np.append(row, n)), 1)
    single = (count.sum(0) + 0.5) / (count.sum() + 0.5 * (n + 1))
    p = np.log((count + BACK_OFF * single) / (count.sum(1, keepdims=True) + BACK_OFF))
    dead = n + 1
    to, cost = np.full((n + 2, 256), dead, np.int32), np.full((n + 2, 256), -np.inf, np.float32)
    to[:dead, symbols], cost[:dead, symbols] = np.arange(1, n + 1), p[:, :n]
    return Automaton(to, cost, np.append(p[:, n], -np.inf))


def run_buffer(values: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(values), np.uint8), ends - [len(v) for v in values], ends


# -- over documents -------------------------------------------------------
def labelled(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """(kind, h, value): the distinct values of least hash in all texts,
    ``max_train`` of each kind and ``max_ordinary`` ordinary runs."""
    most = {**dict.fromkeys(KINDS, max_train), ORDINARY: max_ordinary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[int, bytes]] = {k: {} for k in (*KINDS, ORDINARY)}

        def thin(kind: str, slack: int = 1) -> None:
            if len(least[kind]) > slack * most[kind]:
                least[kind] = dict(sorted(least[kind].items())[:most[kind]])

        for batch in batches:
            buf, offs = buffer_of(batch.column(0))
            found = by_rule(buf, offs)
            for spans in found.values():
                for _, kind, _, s, e in spans:
                    if e - s <= MAX_LENGTH:
                        value = buf[s:e].tobytes()
                        least[KINDS[kind]][int.from_bytes(hashlib.blake2b(value, digest_size=8).digest()) >> 1] = value
            for kind in KINDS:
                thin(kind, 2)
            for part, s, e, _, _ in candidates(buf, offs, found):
                keep = e - s <= MAX_LENGTH
                s, e = s[keep], e[keep]
                h, first = np.unique(window_hash(prefix(BYTE_VALUES[part]), s, e) >> np.uint64(1), return_index=True)
                for k, at in zip(h[:max_ordinary].tolist(), first[:max_ordinary].tolist()):
                    least[ORDINARY].setdefault(k, part[s[at]:e[at]].tobytes())
                thin(ORDINARY, 2)
        for kind in least:
            thin(kind)
            got = list(least[kind].items())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(got)), pa.array([h for h, _ in got], pa.int64()),
                                                  pa.array([v for _, v in got], pa.binary())], names=["kind", "h", "value"])

    values = docs.select(F.col(text_col).alias("t")).mapInArrow(returning(run), "kind string, h long, value binary").dropDuplicates(["kind", "h"])
    values = saved(values)  # read once for each kind
    out = None
    for kind in (*KINDS, ORDINARY):
        part = values.where(F.col("kind") == kind).orderBy("h").limit(most[kind])
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "h", "value")


@dataclass
class Grammar:
    kinds: dict[str, Automaton]
    ordinary: Automaton

    def odds(self, kind: str, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
        return self.kinds[kind].score(buf, starts, ends) - ordinary

    def alike(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each run, the kind it is alike (-1: none); the likeliest of several."""
        best, kind = np.full(len(starts), -np.inf), np.full(len(starts), -1)
        if not len(starts) or not self.kinds:
            return kind
        ordinary = self.ordinary.score(buf, starts, ends)
        for k, name in enumerate(KINDS):
            if name in self.kinds:
                odds = self.odds(name, buf, starts, ends, ordinary)
                good = (odds >= LEAST_ODDS) & (odds >= self.kinds[name].least * (ends - starts)) & (odds > best)
                best[good], kind[good] = odds[good], k
        return kind


def fit_values(values: dict[str, list[bytes]]) -> Grammar:
    """A grammar from labelled values; half of a kind's values infer its
    automaton, the other half set what a character's share must reach."""
    ordinary = byte_pairs(values.get(ORDINARY, []))
    kinds = {}
    for kind in KINDS:
        got = sorted(values.get(kind, []))
        if len(got) < LEAST_VALUES:
            continue
        automaton = Automaton.infer(got[::2])
        buf, s, e = run_buffer(got[1::2])
        share = (automaton.score(buf, s, e) - ordinary.score(buf, s, e)) / (e - s)
        share = share[np.isfinite(share)]
        if len(share):
            automaton.least = MARGIN * max(float(np.quantile(share, QUANTILE)), 0.0)
            kinds[kind] = automaton
    return Grammar(kinds, ordinary)


def fit(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN, max_ordinary: int = MAX_ORDINARY) -> Grammar:
    """Infer the grammars in one task from the bounded samples of ``labelled``."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[str, list[bytes]] = {}
        for batch in batches:
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                values.setdefault(kind, []).append(value)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_values(values))], pa.binary())], names=["grammar"])

    got = labelled(docs, text_col, max_train, max_ordinary).coalesce(1).mapInArrow(returning(run), "grammar binary").collect()  # one row
    return pickle.loads(got[0].grammar) if got else fit_values({})


NAMES = (*KINDS, *(f"like_{k}" for k in KINDS))


def scan(docs: DataFrame, grammar: Grammar, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and spans (array of kind, start, end in code points, by
    start, then kind) of every row."""
    df = docs.select(F.struct(*carry).alias("r"), F.col(text_col).alias("t"))
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([df.schema.fields[0], T.StructField("spans", T.ArrayType(item))])
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            found = by_rule(buf, offs)
            spans = {row: [(s, k, e) for s, k, e, _, _ in got] for row, got in found.items()}
            for part, s, e, row, base in candidates(buf, offs, found):
                kind = shared.value.alike(part, s, e)
                for at in np.flatnonzero(kind >= 0):
                    spans.setdefault(int(row[at]), []).append((int(s[at]) + base, int(kind[at]) + len(KINDS), int(e[at]) + base))
            size = np.zeros(batch.num_rows, np.int32)
            kinds, starts, ends = [], [], []
            for row in sorted(spans):
                got = sorted(spans[row])
                size[row] = len(got)
                place = code_points(buf, int(offs[row]), sorted({p for s, _, e in got for p in (s, e)}))
                kinds += [NAMES[k] for _, k, _ in got]
                starts += [place[s] for s, _, _ in got]
                ends += [place[e] for _, _, e in got]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["r", "spans"])

    return df.mapInArrow(returning(run), schema).select("r.*", "spans")


def code_points(buf: np.ndarray, begin: int, places: Sequence[int]) -> dict[int, int]:
    """Of ascending byte places, the code points since ``begin``."""
    out, at, n = {}, begin, 0
    for p in places:
        n += int(np.count_nonzero((buf[at:p] & 0xC0) != 0x80))
        out[p], at = n, p
    return out
