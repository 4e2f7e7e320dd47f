"""Streams with typed state and timers per key.

State lies entry by entry in the state store: a batch reads and writes the entries it needs, never a whole
history. Event-time timers forget or report a key when the watermark passes its end, whether or not a row comes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from timedspark.operators.fold import grouped_fold
from timedspark.operators.selection import Admission
from timedspark.operators.stage import stage

TOKEN_RESULT = "token STRING, at_ms BIGINT, outcome STRING"
LEASE_RESULT = "owner BIGINT, last_ms BIGINT, stale_ms BIGINT"
CHUNK_RESULT = "job_id BIGINT, chunk_index BIGINT, sha256 STRING, outcome STRING"
PICK_RESULT = "media_id BIGINT, section BIGINT, seq BIGINT, final_start BIGINT, final_end BIGINT, score BIGINT, in_order BOOLEAN"
#: Fields of a waiting candidate, in the order they are worked.
ITEM = ("section", "rank", "seq", "allowance", "target", "start_ms", "end_ms", "final_start", "final_end")
DAY_MS = 86_400_000
#: Rows of `admit_in_batches`: how far a recording is, its accepted spans, deferred and waiting candidates, closed sections; and picks.
PLACE, SPAN, DEFERRED, WAITING, SHUT, PICK = range(6)
OPEN_SELECTION = "media_id BIGINT, kind INT, " + ", ".join(f"{f} BIGINT" for f in ITEM) + ", last BOOLEAN"


def on_event_time(stream: DataFrame, at_ms: str, late: str) -> DataFrame:
    """Add the watermark of a column of epoch milliseconds."""
    return stream.withColumn("__at", F.timestamp_millis(at_ms)).withWatermark("__at", late)


class Tokens(StatefulProcessor):
    """One-time tokens. State: when the token ends and whether it was used; a timer at its end forgets it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", "until BIGINT, used BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = held = self.token.get()
        for row in sorted(rows, key=lambda r: (r.at_ms, r.kind)):
            if row.kind == "issue":
                held = (row.at_ms + row.ttl_ms, False)
                continue
            if held is None or row.at_ms >= held[0]:
                outcome = "expired"
            else:
                outcome = "used" if held[1] else "accepted"
                held = (held[0], True)
            yield Row(token=key[0], at_ms=row.at_ms, outcome=outcome)
        if held is not None and held != before:
            self.token.update(tuple(held))
            if before is None or before[0] != held[0]:
                if before is not None:
                    self.handle.deleteTimer(before[0])
                self.handle.registerTimer(held[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.token.clear()
        return iter(())

    def close(self) -> None:
        pass


def consume_tokens(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One-time tokens: rows (token, kind issue|use, at_ms, ttl_ms); each use is accepted, used or expired.

    Rows of one batch are taken in time order; a row older than the watermark is dropped. A token is forgotten when
    the watermark passes its end; a later use is expired either way.
    """
    return on_event_time(stream, "at_ms", late).groupBy("token").transformWithState(Tokens(), TOKEN_RESULT, "append", "EventTime")


class Leases(StatefulProcessor):
    """Owners that must be heard of. State: the last beat; a timer at the end of the lease reports the owner and forgets it."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()
        before = last = held[0] if held else None
        for at in sorted(r.at_ms for r in rows):
            if last is not None and at - last > self.limit:
                yield Row(owner=key[0], last_ms=last, stale_ms=last + self.limit)
            last = at if last is None else max(last, at)
        if last != before:
            self.last.update((last,))
            if before is not None:
                self.handle.deleteTimer(before + self.limit)
            self.handle.registerTimer(last + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held:
            self.last.clear()
            yield Row(owner=key[0], last_ms=held[0], stale_ms=held[0] + self.limit)

    def close(self) -> None:
        pass


def stale_owners(beats: DataFrame, limit_ms: int, late: str = "10 minutes") -> DataFrame:
    """Owners that fell silent: rows (owner, at_ms) in, one row (owner, last_ms, stale_ms) for each silence longer than `limit_ms`.

    The report comes when the watermark passes the end of the lease, without any further row of that owner; a
    later beat begins a new lease.
    """
    return on_event_time(beats, "at_ms", late).groupBy("owner").transformWithState(Leases(limit_ms), LEASE_RESULT, "append", "EventTime")


class Chunks(StatefulProcessor):
    """Chunks of an upload. State: a list of (chunk, digest), an entry each, which the store forgets after its time to live."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle) -> None:
        self.arrived = handle.getListState("arrived", "chunk_index BIGINT, sha256 STRING", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, fresh = dict(map(tuple, self.arrived.get())), []
        for row in sorted(rows, key=lambda r: r.arrival):
            if row.chunk_index in known:
                outcome = "repeat" if known[row.chunk_index] == row.sha256 else "conflict"
            else:
                known[row.chunk_index] = row.sha256
                fresh.append((row.chunk_index, row.sha256))
                outcome = "complete" if len(known) == row.total else "stored"
            yield Row(job_id=key[0], chunk_index=row.chunk_index, sha256=row.sha256, outcome=outcome)
        if fresh:
            self.arrived.appendList(fresh)

    def close(self) -> None:
        pass


def chunk_intake(stream: DataFrame, keep_ms: int = DAY_MS) -> DataFrame:
    """Upload chunks in any order: (job_id, chunk_index, sha256, total, arrival).

    The first copy of a chunk is stored, an equal one is a repeat, another one a conflict; the chunk that completes
    the upload reports it once. A chunk is known for `keep_ms` of the machine's time after it came (an upload has at
    most a few dozen chunks); then the store drops its entry, and with the last one the upload.
    """
    return stream.groupBy("job_id").transformWithState(Chunks(keep_ms), CHUNK_RESULT, "append", "ProcessingTime")


class Sections(StatefulProcessor):
    """Live admission. State: a word on how far it is, accepted spans, deferred candidates, waiting candidates and closed sections, an entry each."""

    def init(self, handle) -> None:
        fields = ", ".join(f"{f} BIGINT" for f in ITEM)
        self.place = handle.getValueState("place", "next BIGINT, done BOOLEAN")
        self.spans = handle.getListState("spans", "begin BIGINT, end BIGINT")
        self.deferred = handle.getListState("deferred", fields)
        self.waiting = handle.getMapState("waiting", fields, "here BOOLEAN")
        self.shut = handle.getMapState("shut", "section BIGINT", "last BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        following, done = self.place.get() or (0, False)
        if done:
            return
        for row in rows:
            if row.section < following:
                continue
            if row.seq >= 0:
                self.waiting.updateValue((row.section, -row.score, *(row[f] for f in ITEM[2:])), (True,))
            elif not self.shut.containsKey((row.section,)) or row.last:
                self.shut.updateValue((row.section,), (bool(row.last),))
        if not self.shut.containsKey((following,)):
            return
        spans = [tuple(s) for s in self.spans.get()]
        admission, known, put_off = Admission(list(spans)), len(spans), []
        shut = {s[0]: v[0] for s, v in self.shut.iterator()}
        items: dict[int, list[tuple]] = {}
        for item in self.waiting.keys():
            items.setdefault(item[0], []).append(tuple(item))
        while following in shut and not done:
            for item in sorted(items.get(following, [])):
                outcome = admission.offer(following, item[3], item[4], *item[5:])
                if outcome == "accepted":
                    yield self.pick(key, item, True)
                elif outcome == "deferred":
                    put_off.append(item)
                self.waiting.removeKey(item)
            self.shut.removeKey((following,))
            done = shut[following]
            following += 1
        if done:
            for item in sorted([*map(tuple, self.deferred.get()), *put_off], key=lambda i: (i[1], i[0], i[2:])):
                if len(admission.spans) < item[4] and admission.take(*item[5:]) == "accepted":
                    yield self.pick(key, item, False)
            for state in (self.spans, self.deferred, self.waiting, self.shut):
                state.clear()
        else:
            if put_off:
                self.deferred.appendList(put_off)
            if admission.spans[known:]:
                self.spans.appendList(admission.spans[known:])
        self.place.update((following, done))

    @staticmethod
    def pick(key, item: tuple, live: bool) -> Row:
        return Row(media_id=key[0], section=item[0], seq=item[2], final_start=item[7], final_end=item[8], score=-item[1], in_order=live)

    def close(self) -> None:
        pass


def admit_incrementally(stream: DataFrame) -> DataFrame:
    """Live form of `admit_by_section`: picks come out before later sections arrive.

    Rows carry the candidate columns plus `arrival`; per recording and section one row with `seq` -1 closes the
    section, `last` marks the final one. Sections are worked in order; early ones wait in the state. When the last
    section is done, deferred candidates fill what is left. Exact repeats of a row change nothing. A finished
    recording is remembered by one word.
    """
    return stream.groupBy("media_id").transformWithState(Sections(), PICK_RESULT, "append", "None")


def _work_sections(rows: Iterable[tuple]) -> Iterator[tuple]:
    """What `Sections` does, for all that one recording has in a batch: rows of `OPEN_SELECTION` by kind in, picks and what is carried out."""
    following, done = 0, False
    admission, put_off, waiting, shut = Admission(), [], set(), {}
    for media_id, kind, *item, last in rows:
        if kind == PLACE:
            following, done = item[0], last
        elif done:
            continue
        elif kind == SPAN:
            admission.spans.append((item[7], item[8]))
        elif kind == DEFERRED:
            put_off.append(tuple(item))
        elif item[0] >= following and kind == WAITING:
            waiting.add(tuple(item))
        elif item[0] >= following:
            shut[item[0]] = shut.get(item[0], False) or bool(last)
    sections: dict[int, list[tuple]] = {}
    for item in waiting:
        sections.setdefault(item[0], []).append(item)
    closed = done
    while following in shut and not done:
        for item in sorted(sections.pop(following, [])):
            outcome = admission.offer(following, item[3], item[4], *item[5:])
            if outcome == "accepted":
                yield media_id, PICK, *item, True
            elif outcome == "deferred":
                put_off.append(item)
        done = shut.pop(following)
        following += 1
    yield media_id, PLACE, following, *[None] * 8, done
    if not done:
        yield from ((media_id, SPAN, *[None] * 7, *span, None) for span in admission.spans)
        yield from ((media_id, DEFERRED, *item, None) for item in put_off)
        yield from ((media_id, WAITING, *item, None) for items in sections.values() for item in items)
        yield from ((media_id, SHUT, section, *[None] * 8, last) for section, last in shut.items())
    elif not closed:
        for item in sorted(put_off, key=lambda i: (i[1], i[0], i[2:])):
            if len(admission.spans) < item[4] and admission.take(*item[5:]) == "accepted":
                yield media_id, PICK, *item, False


def admit_in_batches(batch: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `admit_incrementally` says, for many recordings at once: (picks, rows to carry to the next batch).

    One shuffle by recording and a sorted pass; a recording's open sections, accepted spans and deferred candidates are
    rows of the carried table (`OPEN_SELECTION`), not entries that a state store is asked for one by one.
    """
    kind = F.when(F.col("seq") >= 0, WAITING).otherwise(SHUT)
    told = batch.withColumn("rank", -F.col("score")).select("media_id", kind.alias("kind"), *ITEM, "last")
    found = stage(grouped_fold(told.unionByName(carried), ["media_id"], ["kind"], _work_sections, OPEN_SELECTION))
    picks = found.filter(F.col("kind") == PICK).select(
        "media_id", "section", "seq", "final_start", "final_end", (-F.col("rank")).alias("score"), F.col("last").alias("in_order"))
    return picks, found.filter(F.col("kind") != PICK)
