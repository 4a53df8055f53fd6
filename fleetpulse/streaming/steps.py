"""What happens in order of arrival, one row at a time: the steps that batches replay and streams follow.

A step reads rows (ms, ord, *columns) of one key and keeps a typed state between them.  ``start`` gives the state of a
key that is new or was silent for longer than the idle time, ``add`` takes a row and returns the next state with the rows
to report, ``end`` reports what is open when a key falls silent.  States hold what an open window, stack or call needs and
nothing else; ``replay`` and ``follow`` (module ``stateful``) own order, lateness, silence and expiry.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values of the collectors: frame window and stall limit in ms, keys of a metric or log window, its length in ms.
FRAME_WINDOW_MS, STALL_MS, WINDOW_KEYS, WINDOW_MS = 1000, 700, 2048, 5000

Row, State, Out = tuple, tuple, list[tuple]


class Step:
    """columns: what a row holds after (ms, ord); state, output: schemas (output without the key)."""

    columns: list[str] = []
    state = ""
    output = ""

    def start(self) -> State:
        raise NotImplementedError

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        raise NotImplementedError

    def end(self, state: State) -> Out:
        return []


class Frames(Step):
    """A window closes at the first frame FRAME_WINDOW_MS after its start, or on another screen."""

    columns = ["screen", "duration_ms", "is_jank"]
    state = "screen string, start_ms bigint, last_ms bigint, jank bigint, durations array<bigint>"
    output = "screen string, start_ms bigint, window_ms bigint, frames bigint, jank bigint, p50_ms bigint, p95_ms bigint, p99_ms bigint, max_ms bigint"

    def start(self) -> State:
        return None, 0, 0, 0, []

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, _, screen, duration, jank = row
        out = []
        if state[4] and (state[0] != screen or ms - state[1] >= FRAME_WINDOW_MS):
            out, state = [self._closed(state, ms)], self.start()
        if not state[4]:
            state = (screen, ms, ms, 0, [])
        return (screen, state[1], ms, state[3] + bool(jank), [*state[4], int(duration)]), out

    def end(self, state: State) -> Out:
        return [self._closed(state, state[2])] if state[4] else []

    @staticmethod
    def _closed(state: State, ms: int) -> tuple:
        d = sorted(state[4])
        at = lambda p: d[(len(d) - 1) * p // 100]
        return state[0], state[1], max(1, ms - state[1]), len(d), state[3], at(50), at(95), at(99), d[-1]


class Calls(Step):
    """A stack of methods.  An exit of the top one is an edge from the method below it.  Any other exit is a
    mismatch, which never guesses an edge: frames from the method's own on go, all frames if it isn't there."""

    columns = ["op", "method_id"]
    state = "methods array<bigint>, starts array<bigint>"
    output = "at_ms bigint, caller bigint, callee bigint, took_ms bigint, mismatch boolean"

    def start(self) -> State:
        return [], []

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, _, op, method = row
        methods, starts = list(state[0]), list(state[1])
        if op == "enter":
            return ([*methods, method], [*starts, ms]), []
        if methods and methods[-1] == method:
            out = [(ms, methods[-2], method, max(0, ms - starts[-1]), False)] if len(methods) > 1 else []
            return (methods[:-1], starts[:-1]), out
        at = max((i for i, m in enumerate(methods) if m == method), default=0)
        return (methods[:at], starts[:at]), [(ms, None, method, None, True)]


class HttpCalls(Step):
    """Phases of one call (phase, part, key, bytes, failed) to its row at the first end of phase ``call``.

    Attempts of DNS and connections pair first in, first out by phase and key.  What comes after the end is ignored; a call
    that falls silent without an end is reported as lost.
    """

    columns = ["phase", "part", "key", "bytes", "failed"]
    state = "start_ms bigint, first_byte bigint, bytes bigint, attempts bigint, dns_ms bigint, connect_ms bigint, failed boolean, ended boolean, waiting array<struct<phase:string,part:string,key:string,ms:bigint>>"
    output = "start_ms bigint, duration_ms bigint, dns_ms bigint, connect_ms bigint, ttfb_ms bigint, bytes bigint, attempts bigint, single_attempt boolean, failed boolean, lost boolean"

    def start(self) -> State:
        return None, None, None, 0, 0, 0, False, False, []

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, _, phase, part, key, size, failed = row
        start, first, total, attempts, dns, connect, bad, ended, waiting = state
        if ended:
            return state, []
        start = ms if start is None else start
        total = total if size is None else (total or 0) + size
        bad = bool(bad or failed)
        if phase == "first_byte":
            first = ms if first is None else first
        if phase in ("dns", "connect"):
            attempts += phase == "connect" and part == "start"
            waiting = [tuple(w) for w in waiting]
            other = next((w for w in waiting if w[0] == phase and w[2] == key and w[1] != part), None)
            if other:
                waiting.remove(other)
                took = max(0, ms - other[3]) if part == "end" else 0  # an end before its start took no time
                dns, connect = dns + took * (phase == "dns"), connect + took * (phase == "connect")
            else:
                waiting.append((phase, part, key, ms))
        ended = phase == "call" and part == "end"
        state = (start, first, total, attempts, dns, connect, bad, ended, [] if ended else waiting)
        return state, [self._row(state, ms - start, False)] if ended else []

    def end(self, state: State) -> Out:
        return [] if state[7] or state[0] is None else [self._row(state, None, True)]

    @staticmethod
    def _row(state: State, took: int | None, lost: bool) -> tuple:
        start, first, total, attempts, dns, connect, bad, _, _ = state
        return start, took, dns, connect, 0 if first is None else max(0, first - start), total, attempts, attempts <= 1, bad, lost


class Stalls(Step):
    """Gaps between heartbeats of ``least_ms`` at least, reported at the beat that ends them."""

    state = "beat_ms bigint"
    output = "start_ms bigint, duration_ms bigint"

    def __init__(self, least_ms: int = STALL_MS) -> None:
        self.least_ms = least_ms

    def start(self) -> State:
        return (None,)

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        before, ms = state[0], row[0]
        return (ms,), [(before, ms - before)] if before is not None and ms - before >= self.least_ms else []


class Dispatches(Step):
    """Start and end lines in pairs of ``least_ms`` at least; a start replaces an open one."""

    columns = ["line"]
    state = "start_ms bigint, line string"
    output = "start_ms bigint, duration_ms bigint, target string"

    def __init__(self, least_ms: int = 16) -> None:
        self.least_ms = least_ms

    def start(self) -> State:
        return None, None

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, _, line = row
        line = line or ""
        if line.startswith(">>>>> Dispatching"):
            return (ms, line), []
        if not line.startswith("<<<<< Finished") or state[0] is None:
            return state, []
        took = max(0, ms - state[0])
        name = state[1].partition(" to ")[2]
        for mark in "}{:":
            name = name.partition(mark)[0]
        return self.start(), [(state[0], took, name.strip() or "unknown")] if took >= self.least_ms else []


@dataclass
class Samples(Step):
    """Samples that differ from the last kept one: a number by its limit at least, a mark at all, a flag when it is
    set, or any after ``every_ms``."""

    limits: dict[str, int]
    marks: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    every_ms: int = 60_000

    state = "kept_ms bigint, numbers array<bigint>, marks array<string>"

    @property
    def columns(self) -> list[str]:
        return [*self.limits, *self.marks, *self.flags]

    @property
    def output(self) -> str:
        return ", ".join(["ms bigint", "ord bigint", *[f"{c} bigint" for c in self.limits], *[f"{c} string" for c in self.marks], *[f"{c} boolean" for c in self.flags]])

    def start(self) -> State:
        return None, [], []

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        n = 2 + len(self.limits)
        numbers, marks, flags = [x or 0 for x in row[2:n]], [None if x is None else str(x) for x in row[n:n + len(self.marks)]], row[n + len(self.marks):]
        kept, old, were = state
        moved = kept is None or row[0] - kept >= self.every_ms or any(flags) or list(were) != marks or any(abs(a - b) >= least for a, b, least in zip(numbers, old, self.limits.values()))
        return ((row[0], numbers, marks), [(row[0], row[1], *row[2:n], *marks, *map(bool, flags))]) if moved else (state, [])


class Scopes(Step):
    """Flow and step after each start, step or end; an end restores what its start replaced."""

    columns = ["op", "name"]
    state = "flow string, step string, flows array<string>, steps array<string>"
    output = "ms bigint, op string, flow string, step string"

    def start(self) -> State:
        return "", "", [], []

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, _, op, name = row
        flow, step, flows, steps = state[0], state[1], list(state[2]), list(state[3])
        if op == "start":
            flow, step, flows, steps = name, "", [*flows, flow], [*steps, step]
        elif op == "step":
            step = name
        elif flows:
            flow, step = flows.pop(), steps.pop()
        return (flow, step, flows, steps), [(ms, op, flow, step)]


@dataclass
class CappedWindows(Step):
    """Sums of the first ``keys`` keys of each window, in order of first sight; what other keys bring, and values
    below 0, is counted in a row whose key is null."""

    keys: int = WINDOW_KEYS
    window_ms: int = WINDOW_MS

    columns = ["key", "value"]
    state = "window_ms bigint, keys array<string>, sums array<bigint>, counts array<bigint>, tops array<bigint>, lost bigint, invalid bigint"
    output = "window_ms bigint, key string, sum bigint, count bigint, max bigint, lost bigint, invalid bigint"

    def start(self) -> State:
        return None, [], [], [], [], 0, 0

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, _, key, value = row
        window = ms // self.window_ms * self.window_ms
        out = []
        if state[0] != window:
            out, state = self.end(state), (window, *self.start()[1:])
        _, names, sums, counts, tops, lost, invalid = state
        if value < 0:
            return (*state[:6], invalid + 1), out
        names, sums, counts, tops = list(names), list(sums), list(counts), list(tops)
        if key not in names:
            if len(names) >= self.keys:
                return (*state[:5], lost + 1, invalid), out
            names, sums, counts, tops = [*names, key], [*sums, 0], [*counts, 0], [*tops, value]
        i = names.index(key)
        sums[i], counts[i], tops[i] = sums[i] + value, counts[i] + 1, max(tops[i], value)
        return (window, names, sums, counts, tops, lost, invalid), out

    def end(self, state: State) -> Out:
        window, names, sums, counts, tops, lost, invalid = state
        out = [(window, *x, 0, 0) for x in zip(names, sums, counts, tops)]
        return [*out, (window, None, 0, 0, None, lost, invalid)] if lost or invalid else out


@dataclass
class Deltas(Step):
    """Growth of cumulative counters since the sample before, 0 after a reset; the first sample reports nothing."""

    counters: list[str]

    state = "at_ms bigint, values array<bigint>"

    @property
    def columns(self) -> list[str]:
        return self.counters

    @property
    def output(self) -> str:
        return ", ".join(["ms bigint", "ord bigint", "elapsed_ms bigint", *[f"d_{c} bigint" for c in self.counters]])

    def start(self) -> State:
        return None, []

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        ms, ord_, *values = row
        grown = [(ms, ord_, max(1, ms - state[0]), *[max(0, b - a) for a, b in zip(state[1], values)])] if state[0] is not None else []
        return (ms, list(values)), grown


class Changes(Step):
    """The context's values, reported when they differ from the ones before."""

    columns = ["context"]
    state = "context string, seen boolean"
    output = "ms bigint, ord bigint, context string"

    def start(self) -> State:
        return None, False

    def add(self, state: State, row: Row) -> tuple[State, Out]:
        same = state[1] and state[0] == row[2]
        return (row[2], True), [] if same else [(row[0], row[1], row[2])]
