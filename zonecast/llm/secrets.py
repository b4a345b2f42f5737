"""Secret scans with one combined deterministic automaton.

All rules' expressions become one non-deterministic automaton, then by subset construction
and minimisation a transition array over bytes. One pass of that array over a batch of texts
says where some rule ends a match. Only there the span is found: a rule's reversed automaton
gives the leftmost start, its forward automaton the furthest end, so spans are those of a
leftmost, longest, non-overlapping search for each rule.

Texts are scanned in many lanes at once. A lane starts behind a byte after which every state
of the automaton is its start (a line end, for instance), so lanes are independent and a
match is never cut.

Defined results for odd input: a null or empty text has no spans; repeated rows each keep
their row; an empty table gives an empty result; other columns aren't read. Offsets are code
points, the end exclusive. Rules work on ASCII bytes, which never occur inside a longer
UTF-8 sequence. A rule must be able to accept no later than any rule match that starts inside
it, which holds where only its last part repeats without bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as _c, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from zonecast.llm.batches import pieces, utf8

LANES = 8192
FEW_LANES = 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what a match must also have (bytes, and bytes after a lead).

    ``tail`` is an expression of what belongs to the span behind a match, over line ends too,
    where no rule's own match may go; it is looked for at found matches only.
    """

    kind: str
    pattern: str
    least: int = 0
    lead: str = ""
    tail: str = ""


# a line's end, also as JSON escapes it, with the blanks around it; and the lines of a private key: headers, its body, its END mark
_LINE = r"(?:[ \t]*(?:[\r\n]|\\n|\\r))++[ \t]*+"
_KEY_LINES = rf"(?:{_LINE}(?:Proc-Type|DEK-Info):[A-Za-z0-9 ,:.-]*)*(?:{_LINE}[A-Za-z0-9+/=]++(?=[ \t]*(?:[\r\n]|\\|\Z)))*(?:{_LINE}-----END [A-Z ]*PRIVATE KEY-----)?"

# The three base kinds, in the order that the result lists them.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         6, r"""[^:=]*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same spans as runs of which those under 24 are dropped
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=_KEY_LINES),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
)


# ---------------------------------------------------------------- automata

class _Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, parsed, a: int, fold: bool) -> int:
        """Add a parsed expression behind state a; its last state."""
        for op, arg in parsed:
            if op is _c.LITERAL:
                a = self._step(a, {arg}, fold)
            elif op is _c.IN:
                a = self._step(a, _members(arg), fold)
            elif op is _c.SUBPATTERN:
                a = self.build(arg[3], a, fold or bool(arg[1] & re.IGNORECASE))
            elif op is _c.BRANCH:
                end = self.state()
                for part in arg[1]:
                    self.empty[self.build(part, a, fold)].append(end)
                a = end
            elif op is _c.MAX_REPEAT:
                least, most, part = arg
                for _ in range(least):
                    a = self.build(part, a, fold)
                if most is _c.MAXREPEAT:
                    loop = self.state()
                    self.empty[a].append(loop)
                    self.empty[self.build(part, loop, fold)].append(loop)
                    a = loop
                else:
                    end = self.state()
                    self.empty[a].append(end)
                    for _ in range(most - least):
                        a = self.build(part, a, fold)
                        self.empty[a].append(end)
                    a = end
            else:
                raise ValueError(f"rules may not use {op}")
        return a

    def _step(self, a: int, chars: set[int], fold: bool) -> int:
        if fold:
            chars = {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())}
        if max(chars) > 127:
            raise ValueError("rules are ASCII")
        b = self.state()
        self.edges[a].append((frozenset(chars), b))
        return b

    def reversed(self, start: int, end: int) -> tuple["_Nfa", int, int]:
        back = _Nfa()
        for _ in self.edges:
            back.state()
        for a, out in enumerate(self.edges):
            for chars, b in out:
                back.edges[b].append((chars, a))
            for b in self.empty[a]:
                back.empty[b].append(a)
        return back, end, start


def _members(items) -> set[int]:
    out: set[int] = set()
    for op, arg in items:
        if op is _c.LITERAL:
            out.add(arg)
        elif op is _c.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"rules may not use {op} in a set")
    return out


@dataclass(frozen=True)
class Dfa:
    """step[state * 256 + byte] is the next state times 256; accepts[state] is a bit mask of rules."""

    step: np.ndarray
    accepts: np.ndarray
    start: int
    first_accepting: int  # accepting states come last
    dead: int             # from it nothing is accepted; -1 if there is none


def determinise(nfa: _Nfa, starts: list[int], ends: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction, then minimisation. ends: last state -> rule bit. anywhere: a match may start at each byte."""

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for b in nfa.empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    first = closure(starts)
    number, subsets, rows = {first: 0}, [first], []
    for at in subsets:  # grows while it is walked
        targets: dict[int, set[int]] = {}
        for a in at:
            for chars, b in nfa.edges[a]:
                for c in chars:
                    targets.setdefault(c, set()).add(b)
        row = np.zeros(256, np.int32)
        made: dict[frozenset, int] = {}
        for c in range(256):
            key = frozenset(targets.get(c, ()))
            if key not in made:
                to = closure(key | first) if anywhere else closure(key)
                if to not in number:
                    number[to] = len(subsets)
                    subsets.append(to)
                made[key] = number[to]
            row[c] = made[key]
        rows.append(row)
    accepts = np.array([sum(1 << k for k in {ends[s] for s in x if s in ends}) for x in subsets], np.int64)
    return _minimal(np.array(rows), accepts)


def _minimal(step: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Merge states that no text tells apart (partition refinement), accepting ones numbered last."""
    cls = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([cls, cls[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == cls.max():
            break
        cls = finer
    n = int(cls.max()) + 1
    one = np.zeros(n, np.int64)
    one[cls] = np.arange(len(cls))
    order = np.argsort(accepts[one] != 0, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new_step, new_accepts = place[cls[step[one[order]]]], accepts[one[order]]
    plain = int((new_accepts == 0).sum())
    sinks = [s for s in range(plain) if (new_step[s] == s).all()]
    return Dfa((new_step * 256).astype(np.int32).ravel(), new_accepts, int(place[cls[0]]), plain, sinks[0] if sinks else -1)


class Scanner:
    """The combined automaton of some rules, and each rule's forward and reversed one."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, nfa, starts, ends = rules, _Nfa(), [], {}
        self.forward, self.backward = [], []
        for k, rule in enumerate(rules):
            start = nfa.state()
            end = nfa.build(_parser.parse(rule.pattern), start, False)
            nfa.edges[end], nfa.empty[end] = [], []  # the pass needs only where a match can first end
            starts.append(start)
            ends[end] = k
            own = _Nfa()
            a = own.state()
            b = own.build(_parser.parse(rule.pattern), a, False)
            self.forward.append(determinise(own, [a], {b: 0}, False))
            back, ra, rb = own.reversed(a, b)
            self.backward.append(determinise(back, [ra], {rb: 0}, False))
        self.leads = [re.compile(r.lead.encode()) for r in rules]
        self.tails = [re.compile(r.tail.encode()) for r in rules]
        self.dfa = determinise(nfa, starts, ends, True)
        step = self.dfa.step.reshape(-1, 256)
        self.resets = (step == self.dfa.start * 256).all(axis=0)  # bytes after which every state is the start
        self._rows = None

    # -- the byte pass

    def hits(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions just behind a byte at which some rule ends a match, in order, and the rules' bits."""
        n = len(buf)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stops = np.flatnonzero(self.resets[buf]) + 1
        nominal = np.arange(1, max(1, min(LANES, n // 128))) * n // max(1, min(LANES, n // 128))
        at = np.searchsorted(stops, nominal)
        cuts = np.unique(np.concatenate([[0], stops[at[at < len(stops)]], [n]]))
        starts, lengths = cuts[:-1], np.diff(cuts)
        order = np.argsort(-lengths, kind="stable")
        pos, lengths = starts[order].astype(np.int64), lengths[order]
        state = np.full(len(pos), self.dfa.start * 256, np.int32)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), side="left")  # lanes longer than t
        step, limit, found, bits = self.dfa.step, self.dfa.first_accepting * 256, [], []
        for t in range(int(lengths[0])):
            a = int(active[t])
            if a < FEW_LANES:
                for i in range(a):
                    self._walk(buf, int(pos[i]), int(pos[i] + lengths[i] - t), int(state[i]), found, bits)
                break
            if a < len(pos):
                pos, state = pos[:a], state[:a]
            state = step[state + buf[pos]]
            pos += 1
            there = np.flatnonzero(state >= limit)
            if len(there):
                found.append(pos[there])
                bits.append(self.dfa.accepts[state[there] >> 8])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, bits = np.concatenate(found), np.concatenate(bits)
        order = np.argsort(found, kind="stable")
        return found[order], bits[order]

    def _walk(self, buf, at: int, end: int, state: int, found: list, bits: list) -> None:
        """One lane alone, byte by byte: for what is left of a long stretch without a reset."""
        if self._rows is None:
            self._rows = [(r >> 8).tolist() for r in self.dfa.step.reshape(-1, 256)]
        rows, limit, s, own, states = self._rows, self.dfa.first_accepting, state >> 8, [], []
        for i, b in enumerate(buf[at:end].tobytes(), at + 1):
            s = rows[s][b]
            if s >= limit:
                own.append(i)
                states.append(s)
        if own:
            found.append(np.array(own, np.int64))
            bits.append(self.dfa.accepts[states])

    @staticmethod
    def _longest(dfa: Dfa, data, at: int, end: int, way: int) -> int:
        """The furthest position at which the automaton accepts, from at towards end; -1 if none."""
        step, s, last = dfa.step, dfa.start, -1
        while at != end:
            s = int(step[s * 256 + data[at if way > 0 else at - 1]]) >> 8
            at += way
            if s >= dfa.first_accepting:
                last = at
            elif s == dfa.dead:
                break
        return last

    # -- texts

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each UTF-8 text its spans (start, rule number, end) in order, in code points."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = b"\n".join(texts)
        if not self.resets[10]:
            raise ValueError("no rule may match a line end")
        ends = np.cumsum([len(t) + 1 for t in texts])
        positions, bits = self.hits(np.frombuffer(joined, np.uint8))
        doc_of = np.searchsorted(ends, positions - 1, side="right")
        for i in np.unique(doc_of):
            lo, hi = np.searchsorted(doc_of, [i, i + 1])
            base = int(ends[i]) - len(texts[i]) - 1
            out[i] = self._resolve(texts[i], positions[lo:hi] - base, bits[lo:hi])
        return out

    def _resolve(self, text: bytes, positions: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
        found = []
        for k, rule in enumerate(self.rules):
            done = 0
            for at in positions[(bits >> k) & 1 == 1].tolist():
                start = self._longest(self.backward[k], text, at, done, -1) if at > done else -1
                if start < 0:  # it starts inside the last match
                    continue
                end = self._longest(self.forward[k], text, start, len(text), 1)
                if rule.tail:
                    end = self.tails[k].match(text, end).end()
                done = end
                lead = self.leads[k].match(text, start, end).end() - start if rule.lead else 0
                if end - start - lead >= rule.least:
                    found.append((start, k, end))
        found.sort()
        if text.isascii() or not found:
            return found
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return [(int(points[a]), k, int(points[b])) for a, k, b in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The rules' scanner, compiled once in a process."""
    return Scanner(rules)


# ---------------------------------------------------------------- frames

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rule", T.IntegerType()),
                     T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans): each document's secrets by start, then in the rules' order."""
    docs = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(SPAN))])

    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # under 2 MB, whatever the data

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            found = compiled.value.spans(utf8(batch.column(text_col)))
            spans = [[{"kind": rules[k].kind, "rule": k, "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(spans, _ARROW_SPAN)], [id_col, "spans"])

    return docs.mapInArrow(scan, schema)


def masked(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each secret replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{rules[k].kind} removed]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns, secrets in the text replaced and the length column kept true for changed texts."""

    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            raw = utf8(batch.column(text_col))
            columns, names = list(batch.columns), batch.schema.names
            at = names.index(text_col)
            changed = {i: masked(raw[i].decode(), x, rules) for i, x in enumerate(compiled.value.spans(raw)) if x}
            if changed:
                texts = batch.column(at).to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if length_col in names:
                    j = names.index(length_col)
                    lengths = batch.column(j).to_pylist()
                    for i, t in changed.items():
                        lengths[i] = len(t)
                    columns[j] = pa.array(lengths, batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)
