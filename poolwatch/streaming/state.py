"""State that outlives a micro-batch: clocks of sessions and start requests."""

import json

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from poolwatch.values import IDLE_MARK_MINUTES

STATE_OUTPUT = "namespace string, pool string, session string, changed_at timestamp, state string, reason string"
START_OUTPUT = "namespace string, session string, ts timestamp, wait_seconds bigint, outcome string"
# What a change of state means to a start request, and the request itself.
OPEN, OK, FAILED, NO_ENDPOINT, ASKED = 0, 1, 2, 3, 4
_OUTCOMES = {OK: "ok", FAILED: "failed", NO_ENDPOINT: "no_endpoint"}
_MINUTE = 60_000_000


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _passed(timerValues, expiredTimerInfo) -> int:
    """The last millisecond whose timers run out now, so that one timer does for all of a shard."""
    return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)


class SessionClock(StatefulProcessor):
    """Active while touched, idle after the idle mark, closing after the pool's timeout.

    A gap as long as a limit does not pass it. Touches are kept as the first and last of each
    minute, which no limit can tell apart from all of them, so a busy session stays small. The key is a
    shard of the sessions, whose clocks are one value with one timer, the next that runs out: a call to the
    state store costs far more than a session.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.clocks = handle.getValueState("clocks", "sessions string")

    def handleInputRows(self, key, rows, timerValues):
        touches, minutes = {}, {}
        for part in rows:
            names = zip(*[part[c].tolist() for c in ("namespace", "pool", "session")])
            for name, at, limit in zip(names, _micros(part["ts"]).tolist(), part["idle_minutes"].tolist()):
                cells = touches.setdefault(name, {})
                first, newest = cells.get(at // _MINUTE, (at, at))
                cells[at // _MINUTE] = min(first, at), max(newest, at)
                minutes[name] = int(limit)
        out, clocks = [], self._held()
        for name, cells in touches.items():
            last, _, phase = clocks.get(name, (None, None, None))
            for first, newest in sorted(cells.values()):
                if last is None:
                    out.append((*name, first, "Active", "opened"))
                elif first > last:
                    gone = self._gone(last, first, minutes[name], phase)
                    out.extend((*name, *g) for g in gone)
                    phase = gone[-1][1] if gone else phase
                    if phase != "Active":
                        out.append((*name, first, "Active", "touched" if phase == "Idle" else "opened"))
                phase, last = "Active", newest if last is None else max(newest, last)
            clocks[name] = last, minutes[name], phase
        self._hold(clocks, min(t for name in touches for t in self._timers(*clocks[name][:2])))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, clocks, out, wake = _passed(timerValues, expiredTimerInfo), self._held(), [], None
        for name, (last, minutes, phase) in list(clocks.items()):
            timers = self._timers(last, minutes)
            due = [t for t in timers if t <= passed]
            gone = self._gone(last, due[-1] * 1000, minutes, phase) if due else []
            out.extend((*name, *g) for g in gone)
            if gone and gone[-1][1] == "Terminating":
                del clocks[name]
                continue
            if gone:
                clocks[name] = last, minutes, gone[-1][1]
            if len(due) < len(timers):
                wake = min(wake or timers[-1], timers[len(due)])
        self._hold(clocks, wake)
        yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _gone(last, now, minutes, phase):
        """Changes between the last touch and `now` that have not come out yet."""
        idle, end = last + IDLE_MARK_MINUTES * _MINUTE, last + minutes * _MINUTE
        out = []
        if phase == "Active" and idle < now and idle < end:
            out.append((idle, "Idle", "idle_mark"))
        if end < now:
            out.append((end, "Terminating", "idle_timeout"))
        return out

    @staticmethod
    def _timers(last, minutes):
        """The first millisecond past each limit."""
        return sorted({(last + m * _MINUTE) // 1000 + 1 for m in (IDLE_MARK_MINUTES, minutes)})

    def _held(self) -> dict:
        """Last touch, timeout and phase of each session."""
        return {tuple(name): clock for name, clock in (json.loads(self.clocks.get()[0]) if self.clocks.exists() else [])}

    def _hold(self, clocks, wake) -> None:
        if clocks:
            self.clocks.update((json.dumps(list(clocks.items())),))
        else:
            self.clocks.clear()
        if wake is not None:
            self.handle.registerTimer(wake)

    @staticmethod
    def _frame(out) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "namespace": pd.Series([o[0] for o in out], dtype="object"),
                "pool": pd.Series([o[1] for o in out], dtype="object"),
                "session": pd.Series([o[2] for o in out], dtype="object"),
                "changed_at": pd.to_datetime(pd.Series([o[3] for o in out], dtype="int64"), unit="us"),
                "state": pd.Series([o[4] for o in out], dtype="object"),
                "reason": pd.Series([o[5] for o in out], dtype="object"),
            }
        )


class StartClock(StatefulProcessor):
    """Start requests of sessions and their state changes, kept until a request is decided.

    Changes that no open or coming request can ask about are dropped, but for the last of each session. The
    key is a shard of the sessions: rows of a batch are noted as one value, and one timer, the next that
    runs out, works off all that the watermark has passed.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.arrived = handle.getListState("arrived", "sessions string")
        self.held = handle.getValueState("held", "sessions string")

    def handleInputRows(self, key, rows, timerValues):
        found, wake = {}, None
        for part in rows:
            names = zip(part["namespace"].tolist(), part["session"].tolist())
            for name, ts, kind, seq, budget in zip(
                names, _micros(part["ts"]).tolist(), part["kind"].tolist(), part["seq"].tolist(), part["budget"].tolist()
            ):
                asked, changes = found.setdefault(name, ([], []))
                due = ts + budget * 1_000_000 if kind == ASKED else ts
                if kind == ASKED:
                    asked.append((ts, due))
                else:
                    changes.append((ts, seq, kind))
                wake = due if wake is None else min(wake, due)
        self.arrived.appendList([(self._written(found),)])
        self.handle.registerTimer(wake // 1000 + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, watermark = _passed(timerValues, expiredTimerInfo), timerValues.getCurrentWatermarkInMs() * 1000
        sessions = self._read(self.held.get()[0]) if self.held.exists() else {}
        for (text,) in self.arrived.get():
            for name, (asked, changes) in self._read(text).items():
                has = sessions.setdefault(name, ([], []))
                has[0].extend(asked)
                has[1].extend(changes)
        self.arrived.clear()
        out, left, wakes = [], {}, []
        for name, (asked, changes) in sessions.items():
            changes.sort()
            out += [(*name, *self._decided(ts, due, changes)) for ts, due in sorted(asked) if due // 1000 < passed]
            open_ = [a for a in asked if a[1] // 1000 >= passed]
            kept = self._kept(changes, open_, watermark)
            left[name] = open_, kept
            wakes += [due for _, due in open_] + [c[0] for c in kept[-1:] if c[0] // 1000 >= passed]
        self.held.update((self._written(left),))
        if wakes:
            self.handle.registerTimer(min(wakes) // 1000 + 1)
        yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _written(sessions) -> str:
        return json.dumps(list(sessions.items()))

    @staticmethod
    def _read(text) -> dict:
        """Requests (time, latest answer) and changes (time, place, kind) of each session."""
        return {tuple(name): (list(map(tuple, asked)), list(map(tuple, changes))) for name, (asked, changes) in json.loads(text)}

    @staticmethod
    def _kept(changes, asked, watermark) -> list[tuple]:
        """The changes, in order, from the last one before the first request that is open or may still come."""
        first = min([watermark, *[a[0] for a in asked]])
        before = [i for i, c in enumerate(changes) if c[0] <= first]
        return changes[before[-1] :] if before else changes

    @staticmethod
    def _decided(ts, due, changes) -> tuple:
        held = [c for c in changes if c[0] <= ts]
        if held and held[-1][2] != OPEN:
            return ts, 0, _OUTCOMES[held[-1][2]]
        # The last change of a moment stands.
        last = {c[0]: c[2] for c in changes if ts < c[0] <= due}
        for at, kind in sorted(last.items()):
            if kind != OPEN:
                return ts, (at - ts) // 1_000_000, _OUTCOMES[kind]
        return ts, None, "timeout"

    @staticmethod
    def _frame(out) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "namespace": pd.Series([o[0] for o in out], dtype="object"),
                "session": pd.Series([o[1] for o in out], dtype="object"),
                "ts": pd.to_datetime(pd.Series([o[2] for o in out], dtype="int64"), unit="us"),
                "wait_seconds": pd.Series([o[3] for o in out], dtype="Int64"),
                "outcome": pd.Series([o[4] for o in out], dtype="object"),
            }
        )
