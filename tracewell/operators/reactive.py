"""Reactive scenarios: states whose triggers watch a key's events, with deadlines.

A scenario has start, states, and if given deadline (after a key's first event),
most_events (that may be watched at once) and since (entry or start).  A state has on, its transitions, and
if given deadline (after its entry) and visits.  A transition has id, when (a
trigger), goto (a state) or finish (an outcome), and if given priority, max_uses
and consume (false: the events that it used stay for others).  Times are numbers
in one unit.

Triggers see the events since their state's entry, or with since = start all that
no transition has consumed:
("event", kind), ("all", *triggers), ("any", *triggers), ("sequence",
*triggers), each after the one before, and ("repeat", kind, least, most).

A decision is made in two steps: `propose` looks only, `commit` changes the state.
Outcomes: a transition's own; ambiguous_match where several of the least priority
match; predicate_timeout and scenario_deadline; capture_incomplete for an event
that comes out of time order, more events than a state may watch, or a state
visited too often; cancelled and target_lost for the inputs @cancel and @lost.
A deadline of a state that has been left is void.  Of inputs of one time, control
inputs come first, then deadlines, then events.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

CONTROL = {"@cancel": "cancelled", "@lost": "target_lost"}


def matched(trigger: tuple, seen: list, after: int = -1) -> tuple[int, set[int]] | None:
    """(last, used): the number of the event by which a trigger holds, and those that it needs; of seen (number, kind) after one."""
    what, *parts = trigger
    if what == "event":
        n = next((n for n, kind in seen if n > after and kind == parts[0]), None)
        return None if n is None else (n, {n})
    if what == "repeat":
        own = [n for n, kind in seen if n > after and kind == parts[0]]
        return (own[parts[1] - 1], set(own)) if parts[1] <= len(own) <= parts[2] else None
    if what == "sequence":
        used: set[int] = set()
        for part in parts:
            found = matched(part, seen, after)
            if found is None:
                return None
            after, used = found[0], used | found[1]
        return after, used
    every = [matched(part, seen, after) for part in parts]
    if what == "any":
        return min((x for x in every if x), key=lambda x: x[0], default=None)
    return None if None in every else (max(x[0] for x in every), set().union(*(x[1] for x in every)))


class Reactor:
    """One key's run of a scenario, as batches and streams use it; its state is plain JSON."""

    def __init__(self, scenario: dict, state: dict | None = None):
        self.scenario = scenario
        self.s = state or {"at": scenario["start"], "n": 0, "seen": [], "uses": {}, "visits": {scenario["start"]: 1}, "began": None, "entered": None, "last": None, "outcome": None}

    @property
    def here(self) -> dict:
        return self.scenario["states"][self.s["at"]]

    def deadline(self) -> tuple[int, str] | None:
        """The next deadline and what it means; of equal ones the state's."""
        s = self.s
        if s["outcome"] or s["began"] is None:
            return None
        own = [(s["entered"] + self.here["deadline"], 0, "predicate_timeout")] if self.here.get("deadline") is not None else []
        own += [(s["began"] + self.scenario["deadline"], 1, "scenario_deadline")] if self.scenario.get("deadline") is not None else []
        return (min(own)[0], min(own)[2]) if own else None

    def _end(self, outcome: str) -> tuple:
        self.s |= {"outcome": outcome, "seen": []}
        return "finished", None, self.s["at"], outcome

    def until(self, at: int) -> list[tuple]:
        """The deadline that fires up to a time, as (decision, transition, state, outcome)."""
        due = self.deadline()
        return [self._end(due[1])] if due and due[0] <= at else []

    def propose(self) -> tuple[str, dict | None, set[int]]:
        """What the events seen lead to: waiting, ambiguous_match or a transition and the events that it uses."""
        found = []
        for move in self.here.get("on", []):
            if self.s["uses"].get(move["id"], 0) < move.get("max_uses", 1 << 62) and (hit := matched(move["when"], self.s["seen"])):
                found.append((move.get("priority", 0), move, hit[1]))
        least = [x for x in found if x[0] == min(f[0] for f in found)]
        if not least:
            return "waiting", None, set()
        return ("ambiguous_match", None, set()) if len(least) > 1 else ("proposal", least[0][1], least[0][2])

    def commit(self, move: dict, used: set[int], at: int) -> tuple:
        """Carry a proposal out."""
        s = self.s
        if "finish" not in move:
            visits = s["visits"].get(move["goto"], 0) + 1
            if visits > self.scenario["states"][move["goto"]].get("visits", 1 << 62):
                return self._end("capture_incomplete")
            s["visits"][move["goto"]] = visits
        s["uses"][move["id"]] = s["uses"].get(move["id"], 0) + 1
        if "finish" in move:
            return ("finished", move["id"], s["at"], self._end(move["finish"])[3])
        keep = self.scenario.get("since", "entry") == "start"
        s["seen"] = [x for x in s["seen"] if x[0] not in used or not move.get("consume", True)] if keep else []
        s |= {"at": move["goto"], "entered": at}
        return "moved", move["id"], s["at"], None

    def step(self, at: int, kind: str) -> list[tuple]:
        """Decisions of an input, a deadline before it included: (of the input, decision, transition, state, outcome)."""
        s = self.s
        if s["outcome"]:
            return [(True, "already_finished", None, s["at"], s["outcome"])]
        if s["last"] is not None and at < s["last"]:
            return [(True, *self._end("capture_incomplete"))]
        if s["began"] is None:
            s |= {"began": at, "entered": at}
        if kind in CONTROL and not (self.deadline() and self.deadline()[0] < at):
            return [(True, *self._end(CONTROL[kind]))]
        if fired := self.until(at):
            return [(False, *fired[0]), *self.step(at, kind)]
        s |= {"last": at, "n": s["n"] + 1}
        s["seen"].append((s["n"], kind))
        if len(s["seen"]) > self.scenario.get("most_events", 1 << 62):
            return [(True, *self._end("capture_incomplete"))]
        what, move, used = self.propose()
        if what == "waiting":
            return [(True, "waiting", None, s["at"], None)]
        return [(True, *(self._end(what) if move is None else self.commit(move, used, at)))]


DECIDED = [("decision", "string"), ("transition", "string"), ("state", "string"), ("outcome", "string")]


def _schema(events: DataFrame, key: str, event: str) -> T.StructType:
    schema = events.select(key, event).schema
    for name, kind in DECIDED:
        schema = schema.add(name, kind)
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def react(events: DataFrame, key: str, order: list[str], at: str, event: str, kind: str, scenario: dict, end: int | None = None) -> DataFrame:
    """key, event, decision, transition, state and outcome of every input of each key in its order, and of deadlines (event is null).

    end: a time up to which deadlines still fire after a key's last input.  A
    partition's sorted rows stream through one reactor at a time.
    """
    schema = _schema(events, key, event)

    def run(frames):
        import pandas as pd

        now, own, columns = None, None, schema.names
        for frame in frames:
            out = []
            for k, i, t, what in zip(frame["__key"], frame["__event"], frame["__at"], frame["__kind"], strict=True):
                if now is None or k != own:
                    if now is not None and end is not None:
                        out += [(own, None, *x) for x in now.until(end)]
                    now, own = Reactor(scenario), k
                out += [(k, i if mine else None, *x) for mine, *x in now.step(int(t), what)]
            yield pd.DataFrame(out, columns=columns).astype({event: "Int64"} if isinstance(schema[event].dataType, T.LongType) else {})
        if now is not None and end is not None and (left := now.until(end)):
            yield pd.DataFrame([(own, None, *x) for x in left], columns=columns).astype({event: "Int64"} if isinstance(schema[event].dataType, T.LongType) else {})

    first = F.col(kind).isin(*CONTROL).cast("int")  # control inputs of a time come first
    names = [F.col(key).alias("__key"), F.col(event).alias("__event"), F.col(at).alias("__at"), F.col(kind).alias("__kind")]
    ranked = events.where(F.col(key).isNotNull()).select(*names, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], (-first).alias("__first"))
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = ranked.repartition("__key").sortWithinPartitions("__key", keys[0], "__first", *keys[1:])
    return dealt.select("__key", "__event", "__at", "__kind").mapInPandas(run, schema)


def react_stream(events: DataFrame, key: str, order: list[str], time: str, event: str, kind: str, scenario: dict, delay: str = "0 seconds") -> DataFrame:
    """As react, for a stream: the state is kept between micro-batches and deadlines are event-time timers.

    Times are microseconds.  A micro-batch is a mailbox that is read in order; a
    timer that the watermark has passed fires without a further event.
    """
    schema = _schema(events, key, event)

    def run(name, frames, state):
        import pandas as pd

        now, out = Reactor(scenario, json.loads(state.get[0]) if state.exists else None), []
        if state.hasTimedOut:
            out += [(name[0], None, *x) for x in now.until(state.getCurrentWatermarkMs() * 1000)]
        else:
            rows = pd.concat(list(frames))
            rows = rows.assign(__first=~rows["__kind"].isin(list(CONTROL))).sort_values([order[0], "__first", *order[1:]], kind="stable")
            for i, t, what in zip(rows["__event"], rows["__at"], rows["__kind"], strict=True):
                out += [(name[0], i if mine else None, *x) for mine, *x in now.step(int(t), what)]
        state.update((json.dumps(now.s),))
        if due := now.deadline():
            state.setTimeoutTimestamp(max(-(-due[0] // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=schema.names).astype({event: "Int64"} if isinstance(schema[event].dataType, T.LongType) else {})

    own = events.withWatermark(time, delay)
    at = F.unix_micros(F.col(time)).alias("__at")
    own = own.select(F.col(key), F.col(event).alias("__event"), at, F.col(kind).alias("__kind"), *dict.fromkeys([time, *order]))
    return own.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
