"""State that expires: leases on entities and presence in files, with their evictions as rows.

Both go by the time of the events, not by the clock: what has expired follows from the
watermark alone, so batches of any size, restarts and repeated events give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, us long, seq long, agent long, outcome string, holder long, expires_us long"


class Lease:
    """Who holds an entity, until when (microseconds)."""

    def __init__(self, holder: int | None = None, expires: int | None = None) -> None:
        self.holder, self.expires = holder, expires

    def lapse(self, us: int) -> tuple[Any, ...] | None:
        """The row of a lease that has ended by ``us``, if there is one."""
        if self.holder is None or self.expires > us:
            return None
        row = (self.expires, None, self.holder, "expired", None, None)
        self.holder = self.expires = None
        return row

    def take(self, us: int, seq: int, agent: int, action: str, ttl: int) -> tuple[Any, ...]:
        """The row of an event of an agent."""
        own = self.holder == agent
        if action == "claim" and self.holder is None:
            outcome, self.holder, self.expires = "granted", agent, us + ttl
        elif own and action in ("claim", "renew"):
            outcome, self.expires = "renewed", us + ttl
        elif own and action == "release":
            outcome, self.holder, self.expires = "released", None, None
        else:
            outcome = "refused" if action == "claim" else "ignored"
        return us, seq, agent, outcome, self.holder, self.expires


def leases(events: DataFrame, ttl: str, late: str) -> DataFrame:
    """Exclusive claims that end by themselves: key, at, seq, agent, outcome, holder and expires_at after the event.

    events: key string, at timestamp, seq long (unique in a key), agent long, action (claim, renew, release).  A claim of
    a free key is granted for ``ttl``; the holder's claims and renewals begin the time anew; others are refused or
    ignored.  A lease that ends gives a row of its own (expired, without seq) at its end, before an event of that moment.

    An event is decided, in order of (at, seq), once the watermark (``late`` behind the newest event, in milliseconds) has
    passed it, and a lease ends likewise.  What arrives at or behind the watermark is dropped, repeated events count once.  Till then it waits in the state, which holds a
    key's events of a trigger's files and of the time ``late``.  Rows without key, at, seq or agent are left out.
    """
    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, expires, kept = state.get if state.exists else (None, None, "[]")
        lease, waiting = Lease(holder, expires), {e[1]: tuple(e) for e in json.loads(kept)}
        if not state.hasTimedOut:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    waiting.setdefault(int(r.seq), (int(r.us), int(r.seq), int(r.agent), r.action, int(r.ttl)))
        now, rows = state.getCurrentWatermarkMs() * 1000, []
        due = sorted(e for e in waiting.values() if e[0] < now)
        for event in due:
            rows += [lease.lapse(event[0]), lease.take(*event)]
            del waiting[event[1]]
        rows = [(key[0], *r) for r in (*rows, lease.lapse(now - 1)) if r]
        if waiting or lease.holder is not None:
            state.update((lease.holder, lease.expires, json.dumps(sorted(waiting.values()))))
            ends = [e[0] for e in waiting.values()] + ([lease.expires] if lease.holder is not None else [])
            state.setTimeoutTimestamp(min(ends) // 1000)
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(rows, columns=["key", "us", "seq", "agent", "outcome", "holder", "expires_us"])
        yield frame.astype({c: "Int64" for c in ("us", "seq", "agent", "holder", "expires_us")})

    length = F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {ttl}")).alias("ttl")
    whole = events.filter("key IS NOT NULL AND at IS NOT NULL AND seq IS NOT NULL AND agent IS NOT NULL").withWatermark("at", late)
    rows = whole.select("key", "at", F.unix_micros("at").alias("us"), "seq", "agent", F.coalesce("action", F.lit("")).alias("action"), length)
    out = rows.groupBy("key").applyInPandasWithState(step, _OUT, "holder long, expires long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_micros("us").alias("at"), "seq", "agent", "outcome", "holder", F.timestamp_micros("expires_us").alias("expires_at"))


def presence(events: DataFrame, ttl: str, late: str, *keys: str) -> DataFrame:
    """Spells of presence that are over: keys, begin, last_seen, signs, gone_at (``ttl`` after the last sign of life).

    events: keys and at.  A spell is a row once the watermark has reached its end; signs before that make it longer.
    """
    spells = events.filter("at IS NOT NULL").withWatermark("at", late).groupBy(F.session_window("at", ttl).alias("spell"), *keys)
    found = spells.agg(F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("signs"))
    return found.select(*keys, F.col("spell.start").alias("begin"), "last_seen", "signs", F.col("spell.end").alias("gone_at"))
