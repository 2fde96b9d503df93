"""The whole life of sessions as one state: touches, requests to end, placements, and news of pools and
instances, in event time.

The key is a shard of a pool, so that news of a pool or an instance meets the sessions it concerns
and a crowded pool is many keys. Rows wait in cells of a minute until the watermark has passed the
cell; then they are worked off in order, together with the clocks that run out in it. So the
changes do not depend on how rows are cut into batches.
"""

import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from poolwatch.values import IDLE_MARK_MINUTES, ZERO_IDLE_MINUTES

LIFE_OUTPUT = (
    "namespace string, pool string, session string, changed_at timestamp, step int, state string, reason string, "
    "assigned_instance string, endpoint string, created_at timestamp, last_activity_at timestamp"
)
# Kinds of row, in the order in which those of one moment count.
POOL, INSTANCE, SNAPSHOT, RECORD, OUTLOOK, TOUCH, END = range(7)
_MINUTE = 60_000_000
_NEVER = -(1 << 62)
# As numpy holds a missing time.
_NOT_A_TIME = -(1 << 63)
_HELD, _NEW = ("Active", "Idle"), ("", "Pending")
_FIELDS = ("session", "kind", "seq", "user_name", "state", "instance", "endpoint", "minutes", "flag", "reason")
_TIMES = ("ts", "created_at", "last_activity_at")
_SESSION = ("user_name", "state", "instance", "endpoint", "created", "last", "cell")


class SessionLife(StatefulProcessor):
    """States of a session: new, held (active or idle), ended; an ended one is forgotten.

    What a shard holds is one value, read and written whole, and the rows that arrive are noted unread until
    its one timer, the next cell's, runs out: a call to the state store costs far more than a session.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.arrived = handle.getListState("arrived", "events string")
        self.shard = handle.getValueState("shard", "held string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wait(initialState)

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            self._wait(part)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # All cells the watermark has passed, in order: working one off may note clocks in another.
        self.passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.out = []
        self._read()
        self.open = sorted({c for state in (self.waiting, self.clocks) for c in state if self._has_passed(c)})
        while self.open:
            self._work_off(heapq.heappop(self.open))
        self._write()
        yield self._frame(key, self.out)

    def _read(self) -> None:
        # A pool nobody has told of is gone.
        nothing = [False, ZERO_IDLE_MINUTES, [], [], [], []]
        self.known, self.minutes, instances, sessions, clocks, waiting = json.loads(self.shard.get()[0]) if self.shard.exists() else nothing
        self.instances, self.sessions, self.clocks, self.waiting = set(instances), dict(sessions), dict(clocks), dict(waiting)
        for (text,) in self.arrived.get():
            for cell, events in json.loads(text):
                self.waiting.setdefault(cell, []).extend(events)
        self.arrived.clear()
        self.held = None

    def _write(self) -> None:
        held = [self.known, self.minutes, list(self.instances), *[list(d.items()) for d in (self.sessions, self.clocks, self.waiting)]]
        self.shard.update((json.dumps(held),))
        if cells := [*self.clocks, *self.waiting]:
            self.handle.registerTimer((min(cells) + 1) * _MINUTE // 1000)

    def _has_passed(self, cell) -> bool:
        return (cell + 1) * _MINUTE <= self.passed

    def _work_off(self, cell) -> None:
        self.due, self.cell, self.now = [], cell, cell * _MINUTE
        for name in self.clocks.pop(cell, ()):
            one = self._session(name)
            if one and one["cell"] == cell:
                heapq.heappush(self.due, (cell * _MINUTE, name))
        events = (dict(zip((*_FIELDS, *_TIMES), values)) for values in self.waiting.pop(cell, ()))
        for event in sorted(events, key=lambda e: (e["ts"], e["kind"], e["seq"] or 0, e["session"] or "")):
            self._clocks_before(event["ts"])
            self.now = event["ts"]
            self._apply(event)
        self._clocks_before((cell + 1) * _MINUTE)

    def close(self) -> None:
        pass

    def _wait(self, rows: pd.DataFrame) -> None:
        times = {c: rows[c].astype("datetime64[us]").astype("int64").where(rows[c].notna(), _NEVER).tolist() for c in _TIMES}
        plain = {c: rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in _FIELDS}
        cells = {}
        for ts, *values in zip(times["ts"], *plain.values(), *times.values()):
            cells.setdefault(ts // _MINUTE, []).append(values)
        if cells:
            self.arrived.appendList([(json.dumps(list(cells.items()), default=int),)])
            self.handle.registerTimer((min(cells) + 1) * _MINUTE // 1000)

    def _session(self, name):
        return dict(zip(_SESSION, self.sessions[name])) if name in self.sessions else None

    def _put(self, name, one) -> None:
        self.sessions[name] = list(one.values())
        if self.held is not None and one["state"] in _HELD:
            self.held.setdefault(one["instance"], {})[name] = None

    def _held_by(self, instance) -> list:
        """Sessions an instance holds. They are looked up, as a failed machine may take many instances with it; the
        first look notes those of all instances, and one that has left since may still be among them."""
        if self.held is None:
            self.held = {}
            for name in self.sessions:
                one = self._session(name)
                if one["state"] in _HELD:
                    self.held.setdefault(one["instance"], {})[name] = None
        return list(self.held.pop(instance, ()))

    def _end_of_wait(self, one):
        """When the clock of a held session runs out next, and what it becomes then."""
        if one["state"] not in _HELD or one["last"] == _NEVER:
            return None
        idle, end = (one["last"] + m * _MINUTE for m in (IDLE_MARK_MINUTES, self.minutes))
        return (idle, "Idle") if one["state"] == "Active" and idle < end else (end, "Terminating")

    def _set_clock(self, name, one) -> None:
        """Note the session in the cell of its clock, unless it is noted in an earlier one already."""
        wait = self._end_of_wait(one)
        cell = max(wait[0] // _MINUTE, self.cell) if wait else None
        if cell is None or one["cell"] != _NEVER and one["cell"] <= cell:
            return
        one["cell"] = cell
        if cell == self.cell:
            heapq.heappush(self.due, (max(wait[0], self.now), name))
            return
        if self._has_passed(cell) and cell not in self.clocks and cell not in self.open:
            heapq.heappush(self.open, cell)
        self.clocks.setdefault(cell, []).append(name)

    def _clocks_before(self, now) -> None:
        """Clocks that ran out strictly before `now`; those of later cells are noted there. What is in `due` is no
        later than the clock of its session."""
        while self.due and self.due[0][0] < now:
            _, name = heapq.heappop(self.due)
            one = self._session(name)
            wait = self._end_of_wait(one) if one else None
            if wait and wait[0] // _MINUTE <= self.cell and wait[0] >= now:
                heapq.heappush(self.due, (wait[0], name))
                continue
            if one:
                one["cell"] = _NEVER
                if wait and wait[0] // _MINUTE <= self.cell:
                    # A clock that news has put back runs out with the news.
                    self._change(name, one, max(wait[0], self.now), wait[1], "idle_mark" if wait[1] == "Idle" else "idle_timeout")
                else:
                    self._set_clock(name, one)
                    self._put(name, one)

    def _change(self, name, one, ts, state, reason) -> None:
        one["state"] = state
        self._tell(name, one, ts, reason)
        if state == "Terminating":
            one["state"] = "Terminated"
            self._tell(name, one, ts, "closing")
        if one["state"] in ("Terminated", "Failed"):
            self.sessions.pop(name, None)
        else:
            self._set_clock(name, one)
            self._put(name, one)

    def _tell(self, name, one, ts, reason) -> None:
        self.out.append((name, ts, len(self.out), one["state"], reason, one["instance"], one["endpoint"], one["created"], one["last"]))

    def _all(self) -> list:
        return list(self.sessions)

    def _apply(self, e) -> None:
        getattr(self, ("_pool", "_instance", "_snapshot", "_record", "_outlook", "_touch", "_end")[e["kind"]])(e, e["ts"])

    def _pool(self, e, ts) -> None:
        """News of the pool: whether it is there, and its idle timeout."""
        was = self.known, self.minutes
        self.known, self.minutes = bool(e["flag"]), int(e["minutes"] or ZERO_IDLE_MINUTES)
        for name in self._all() if was != (self.known, self.minutes) else ():
            one = self._session(name)
            if not self.known:
                held = one["state"] in _HELD
                self._change(name, one, ts, "Terminated" if held else "Failed", "pool_deleted" if held else "pool_missing")
            else:
                self._set_clock(name, one)
                self._put(name, one)

    def _instance(self, e, ts) -> None:
        """News of an instance: only a ready one keeps its sessions."""
        if e["flag"]:
            self.instances.add(e["instance"])
            return
        self.instances.discard(e["instance"])
        for name in self._held_by(e["instance"]):
            one = self._session(name)
            if one and one["state"] in _HELD and one["instance"] == e["instance"]:
                self._lose(name, one, ts)

    def _lose(self, name, one, ts) -> None:
        one["instance"] = one["endpoint"] = ""
        self._change(name, one, ts, "Pending", "instance_lost")

    def _snapshot(self, e, ts) -> None:
        """A session as a snapshot has it, looked at as at any tick: the first rule that fits."""
        one = {
            "user_name": e["user_name"], "state": e["state"] or "", "instance": e["instance"] or "", "endpoint": e["endpoint"] or "",
            "created": e["created_at"], "last": e["last_activity_at"], "cell": _NEVER,
        }
        name = e["session"]
        if one["state"] in _NEW and not self.known:
            self._change(name, one, ts, "Failed", "pool_missing")
        elif one["state"] in _NEW:
            self._put(name, one)
        elif one["state"] == "Terminating":
            self._change(name, one, ts, "Terminated", "closing")
        elif one["state"] in _HELD:
            past = lambda minutes: one["last"] != _NEVER and one["last"] + minutes * _MINUTE < ts
            if not self.known:
                self._change(name, one, ts, "Terminated", "pool_deleted")
            elif one["instance"] not in self.instances:
                self._lose(name, one, ts)
            elif past(self.minutes):
                self._change(name, one, ts, "Terminating", "idle_timeout")
            elif one["state"] == "Active" and past(IDLE_MARK_MINUTES):
                self._change(name, one, ts, "Idle", "idle_mark")
            else:
                self._set_clock(name, one)
                self._put(name, one)

    def _record(self, e, ts) -> None:
        """A new session somebody asked for."""
        if e["session"] not in self.sessions:
            self._snapshot(e | {"state": "", "created_at": _NEVER, "last_activity_at": _NEVER}, ts)

    def _outlook(self, e, ts) -> None:
        """The verdict on a new session: refused, or placed on an instance."""
        one = self._session(e["session"])
        if one is None or one["state"] not in _NEW:
            return
        if e["instance"] is None:
            self._change(e["session"], one, ts, "Failed", e["reason"])
        else:
            one |= {"instance": e["instance"], "endpoint": e["endpoint"] or "", "created": ts, "last": ts}
            self._change(e["session"], one, ts, "Active", "placed")

    def _touch(self, e, ts) -> None:
        one = self._session(e["session"])
        if one is not None and ts > one["last"]:
            one["last"] = ts
            if one["state"] == "Idle":
                self._change(e["session"], one, ts, "Active", "touched")
            else:
                self._set_clock(e["session"], one)
                self._put(e["session"], one)

    def _end(self, e, ts) -> None:
        """Only the owner may end a session."""
        one = self._session(e["session"])
        if one is not None and one["user_name"] is not None and one["user_name"] == e["user_name"]:
            self._change(e["session"], one, ts, "Terminating", "ended_by_owner")

    @staticmethod
    def _frame(key, out) -> pd.DataFrame:
        names = ("session", "changed_at", "step", "state", "reason", "assigned_instance", "endpoint", "created_at", "last_activity_at")
        columns = dict(zip(names, zip(*out))) if out else {n: () for n in names}
        made = {"namespace": pd.Series([key[0]] * len(out), dtype="object"), "pool": pd.Series([key[1]] * len(out), dtype="object")}
        for name, values in columns.items():
            if name in ("changed_at", "created_at", "last_activity_at"):
                # Not by way of floats: pandas then multiplies what it left unset where a time is missing, which may overflow.
                at = np.array(values, dtype="int64")
                made[name] = pd.Series(np.where(at == _NEVER, _NOT_A_TIME, at).view("datetime64[us]"))
            else:
                made[name] = pd.Series(values, dtype="int32" if name == "step" else "object")
        return pd.DataFrame(made)
