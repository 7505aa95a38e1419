"""Stateful streaming: the album state machine, throttled marks, late feedback and idle pages."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..limits import IDLE_SECONDS, LATE_SECONDS, MAX_PAGES_PER_ALBUM, MAX_SHOTS_PER_PAGE, PENDING_STATES, TOKEN_TOUCH_SECONDS, WAIT_SECONDS
from ..session import work_folder  # noqa: F401 - the streams' callers take it from here
from .oplog import run_outcomes

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OP_COLUMNS = ("seq", "us", "kind", "page_id", "shot_id", "sha", "gen", "pages")

TRANSITIONS = StructType([
    StructField("album_id", LongType()), StructField("seq", LongType()), StructField("us", LongType()), StructField("page_id", StringType()),
    StructField("event", StringType()), StructField("state", StringType()),
])
_OP = StructType([StructField(c, LongType() if c in ("seq", "us", "gen") else StringType()) for c in OP_COLUMNS])
_PAGE = StructType([
    StructField("position", IntegerType()), StructField("state", StringType()), StructField("gen", LongType()), StructField("run_gen", LongType()),
    StructField("changed_us", LongType()), StructField("ready_us", LongType()), StructField("shots", IntegerType()), StructField("first_us", LongType()),
    StructField("claim_gen", LongType()), StructField("held", StringType()),
])
_FIELDS = [f.name for f in _PAGE.fields]
_ALBUM = StructType([StructField("page_size", StringType()), StructField("pdf_stale", BooleanType())])
_MARK = StructType([StructField("us", LongType()), StructField("seq", LongType())])


class InOrder(StatefulProcessor):
    """A key's rows in the order of their times (``us``, then ``seq``), once the watermark says that no earlier one can come.

    Rows wait in list state until then; a timer wakes the key when the first of them, or something that falls due
    by itself, can go on, so nothing waits for the key's next row. A row that comes after its time has been
    worked on is given to ``late``. Spark itself drops (and counts) rows older than its watermark, which stays
    ``late_ms`` behind the release of rows for that reason.
    """

    row: StructType

    def __init__(self, late_seconds: float):
        self.late_ms = int(late_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.mark = handle.getValueState("mark", _MARK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A trigger's rows of one key, bounded by the source's files-per-trigger setting.
        names = [f.name for f in self.row.fields]
        new = [tuple(None if x is None or x != x else x for x in r) for pdf in rows for r in pdf[names].itertuples(index=False)]
        yield self._go_on(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._go_on(key, [], timerValues)

    def close(self) -> None:
        pass

    def _go_on(self, key, new: list[tuple], timerValues) -> pd.DataFrame:
        names = [f.name for f in self.row.fields]
        self.out: list[tuple] = []
        self.known = self.mark.exists()  # a key without a mark has no state at all: a call less for each
        mark = tuple(self.mark.get()) if self.known else (-(1 << 62), -1)
        clock = max(timerValues.getCurrentWatermarkInMs(), 0)
        limit = (clock + self.late_ms) * 1000 if clock else -(1 << 62)
        self.load()
        waited = [tuple(w) for w in self.waiting.get()] if self.known else []
        ops = [SimpleNamespace(**dict(zip(names, r))) for r in [*waited, *new]]
        ops.sort(key=lambda o: (o.us, o.seq))
        at = 0
        while True:
            op = ops[at] if at < len(ops) and ops[at].us <= limit else None
            due = self.due()
            if due is not None and due <= limit and (op is None or due <= op.us):
                mark = max(mark, (due, -1))
                self.us = mark[0]
                self.ripe()
            elif op is not None:
                at += 1
                if (op.us, op.seq) < mark:
                    self.late(op)
                else:
                    mark = (op.us, op.seq)
                    self.us = op.us
                    self.apply(op)
            else:
                break
        self.save()
        self.mark.update(mark)
        if at < len(ops):
            self.waiting.put([tuple(getattr(o, n) for n in names) for o in ops[at:]])
        elif waited:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()) if self.known else ():
            self.handle.deleteTimer(timer)
        due = self.due()
        wake = min((x for x in (due, ops[at].us if at < len(ops) else None) if x is not None), default=None)
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000) - self.late_ms, clock + 1))
        return pd.DataFrame([(key[0], *r) for r in self.out], columns=[f.name for f in self.result.fields])


class AlbumState(InOrder):
    """One album's pages and shots, from its operations in order.

    An album holds at most 500 pages of 25 shots, so its state is small; pages are read once a batch, each with its
    shots (``held``, as JSON), and written once if they have changed. Idle pages become ready at their due time, by a timer if no operation comes.
    An operation that comes after later ones were worked on is reported as ``late`` and changes nothing.
    """

    row, result = _OP, TRANSITIONS

    def __init__(self, idle_seconds: float = IDLE_SECONDS, late_seconds: float = LATE_SECONDS):
        super().__init__(late_seconds)
        self.idle_us = int(idle_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.page_state = handle.getMapState("pages", StructType([StructField("page_id", StringType())]), _PAGE)
        self.album = handle.getValueState("album", _ALBUM)

    def load(self) -> None:
        self.before = {k[0]: tuple(v) for k, v in self.page_state.iterator()} if self.known else {}
        self.pages = {k: dict(zip(_FIELDS, v)) for k, v in self.before.items()}
        self.page_of: dict[str, str] = {}  # of each shot
        for pid, p in self.pages.items():
            p["held"] = dict(json.loads(p["held"]))
            self.page_of.update(dict.fromkeys(p["held"], pid))
        self.exists = self.known and self.album.exists()
        self.size, self.stale = self.album_before = tuple(self.album.get()) if self.exists else (None, False)
        self.existed = self.exists
        self.dues: list[tuple[int, str]] = []
        for pid in self.pages:
            self._wait(pid)

    def save(self) -> None:
        for pid in self.before.keys() - self.pages.keys():
            self.page_state.removeKey((pid,))
        for pid, p in self.pages.items():
            now = tuple(json.dumps(list(p[f].items())) if f == "held" else p[f] for f in _FIELDS)
            if self.before.get(pid) != now:
                self.page_state.updateValue((pid,), now)
        if self.exists:
            if not self.existed or self.album_before != (self.size, self.stale):
                self.album.update((self.size, self.stale))
        elif self.existed:
            self.album.clear()

    def apply(self, op) -> None:
        self.seq = op.seq
        getattr(self, "_" + op.kind.lower())(op)

    def late(self, op) -> None:
        self.out.append((op.seq, op.us, op.page_id, "late", None))

    def _is_due(self, due: int, pid: str) -> bool:
        p = self.pages.get(pid)
        return self.size is not None and p is not None and p["state"] == "changed" and p["shots"] > 0 and p["changed_us"] + self.idle_us == due

    def due(self) -> int | None:
        """When the next page has been idle for long enough; what no longer holds leaves the index here."""
        while self.dues and not self._is_due(*self.dues[0]):
            heapq.heappop(self.dues)
        return self.dues[0][0] if self.dues else None

    def ripe(self) -> None:
        self.seq = None  # no operation, only time
        self._ready(heapq.heappop(self.dues)[1])

    # Helpers -------------------------------------------------------------

    def _emit(self, page: str | None, event: str) -> None:
        self.out.append((self.seq, self.us, page, event, self.pages[page]["state"] if page in self.pages else None))

    def _wait(self, pid: str) -> None:
        p = self.pages[pid]
        if p["state"] == "changed" and p["changed_us"] is not None:
            heapq.heappush(self.dues, (p["changed_us"] + self.idle_us, pid))

    def _touch(self, pid: str) -> None:
        p = self.pages[pid]
        p["gen"], p["changed_us"] = p["gen"] + 1, self.us
        if p["state"] != "processing":
            p["state"] = "changed"
        self._wait(pid)

    def _ready(self, pid: str) -> None:
        p = self.pages[pid]
        p["ready_us"] = self.us
        if p["state"] == "changed":
            p["state"] = "ready"
            self._emit(pid, "ready")

    def _page(self, position: int) -> dict:
        return dict(position=position, state="changed", gen=0, run_gen=None, changed_us=None, ready_us=None, shots=0, first_us=None, claim_gen=None, held={})

    def _ensure_page(self, pid: str) -> bool:
        if pid in self.pages:
            return True
        if len(self.pages) >= MAX_PAGES_PER_ALBUM:
            self._emit(pid, "refused_pages")
            return False
        self.pages[pid] = self._page(max((p["position"] for p in self.pages.values()), default=0) + 1)
        return True

    def _hold(self, pid: str, shot: str, sha: str | None) -> None:
        self.page_of[shot] = pid
        self.pages[pid]["held"][shot] = sha
        self.pages[pid]["shots"] += 1

    def _let_go(self, shot: str) -> str | None:
        """The shot leaves its page; its hash."""
        page = self.pages[self.page_of.pop(shot)]
        page["shots"] -= 1
        return page["held"].pop(shot)

    def _arrived(self, pid: str) -> None:
        self._touch(pid)
        p = self.pages[pid]
        p["first_us"] = self.us if p["first_us"] is None else p["first_us"]

    def _emptied(self, pid: str) -> None:
        self.stale = True
        self._emit(pid, "emptied")

    # Operations ----------------------------------------------------------

    def _put_shot(self, op) -> None:
        if op.shot_id in self.page_of:
            same = self.pages[self.page_of[op.shot_id]]["held"][op.shot_id] == op.sha
            self._emit(op.page_id, "repeat" if same else "conflict")
            return
        if not self._ensure_page(op.page_id):
            return
        if self.pages[op.page_id]["shots"] >= MAX_SHOTS_PER_PAGE:
            self._emit(op.page_id, "refused_shots")
            return
        self.exists = True  # an album begins with its first shot, without a size
        self._hold(op.page_id, op.shot_id, op.sha)
        self._arrived(op.page_id)
        self._emit(op.page_id, "stored")

    def _delete_shot(self, op) -> None:
        """Only from the page named: a shot that has moved on meanwhile stays."""
        if op.shot_id not in self.page_of or self.page_of[op.shot_id] != op.page_id:
            return
        self._let_go(op.shot_id)
        self._touch(op.page_id)
        if self.pages[op.page_id]["shots"] == 0:
            self._emptied(op.page_id)
        self._emit(op.page_id, "deleted")

    def _delete_page(self, op) -> None:
        gone = self.pages.pop(op.page_id, None)
        if gone is None:
            return
        for shot in gone["held"]:
            del self.page_of[shot]
        self.stale = True
        self._emit(op.page_id, "page_deleted")

    def _delete_album(self, op) -> None:
        if not self.exists:
            return
        self.pages.clear()
        self.page_of.clear()
        self.exists, self.size, self.stale = False, None, False
        self._emit(None, "album_deleted")

    def _move_shots(self, op) -> None:
        """``shot_id`` lists the shots, comma-separated. All that are elsewhere in the album move, or none if the page can't hold them.

        A refused move leaves nothing behind, nor a page that it would have made.
        """
        fresh = op.page_id not in self.pages
        if not self.exists or not self._ensure_page(op.page_id):
            return
        there = [s for s in dict.fromkeys((op.shot_id or "").split(",")) if s and s in self.page_of]
        moves = {s: self.page_of[s] for s in there if self.page_of[s] != op.page_id}
        if self.pages[op.page_id]["shots"] + len(moves) > MAX_SHOTS_PER_PAGE:
            if fresh:
                del self.pages[op.page_id]
            self._emit(op.page_id, "refused_shots")
            return
        if not moves:
            return
        for shot in moves:
            self._hold(op.page_id, shot, self._let_go(shot))
        sources = sorted(set(moves.values()))
        for source in sources:
            self._touch(source)
        self._arrived(op.page_id)
        for source in sources:
            if self.pages[source]["shots"] > 0:
                self._ready(source)
            else:
                self._emptied(source)
        self._emit(op.page_id, "moved")

    def _album_meta(self, op) -> None:
        listed = [p for p in (op.pages or "").split(",") if p]
        if len(set(listed)) < len(listed):
            self._emit(None, "refused_repeat")
            return
        before = sorted(self.pages, key=lambda p: self.pages[p]["position"])
        left_out = [p for p in before if p not in set(listed) and self.pages[p]["shots"] > 0]
        order = listed + sorted(left_out, key=lambda p: (self.pages[p]["first_us"] or 0, self.pages[p]["position"]))
        if len(order) > MAX_PAGES_PER_ALBUM:
            self._emit(None, "refused_pages")
            return
        new = [p for p in order if p not in self.pages]
        for p in set(before) - set(order):
            del self.pages[p]
        for at, p in enumerate(order, 1):
            self.pages.setdefault(p, self._page(at))["position"] = at
        existed, self.exists = self.exists, True
        if isinstance(op.sha, str) and op.sha != self.size:  # metadata carries the page size in place of a hash
            self.size = op.sha
            for p in self.pages if existed else ():  # also where a put made the album, which has no size until now
                if self.pages[p]["shots"] > 0:
                    self._touch(p)
        if new:
            last = max(self.pages[p]["position"] for p in new)
            for p, v in self.pages.items():
                if v["position"] < last and v["shots"] > 0 and (v["state"] == "changed" or (v["state"] == "processing" and v["gen"] != v["run_gen"])):
                    self._ready(p)
        self.stale = self.stale or (existed and before != order)
        self._emit(None, "meta")

    def _claim(self, op) -> None:
        p = self.pages.get(op.page_id)
        if p and p["state"] == "ready" and p["shots"] > 0 and self.size is not None:
            p["state"], p["run_gen"], p["claim_gen"], p["ready_us"] = "processing", p["gen"], p["gen"], None
            self._emit(op.page_id, "processing")

    def _run_end(self, op) -> None:
        """``sha`` is the run's output, empty for none; a run without output failed. ``gen`` is its claim's (0: the last claim's).

        The page's generation decides, also after a recovery that put the page back: only a page that is not there is ``gone``.
        """
        p = self.pages.get(op.page_id)
        claimed = op.gen if op.gen else p and p["claim_gen"]
        if p is None or claimed is None:
            self._emit(op.page_id, "gone")
            return
        moved, output = p["gen"] != claimed, bool(op.sha)
        p["state"] = ("ready" if p["ready_us"] else "changed") if moved else ("done" if output else "failed")
        p["run_gen"] = None
        self._wait(op.page_id)
        self.stale = self.stale or p["shots"] > 0
        self._emit(op.page_id, "adopted" if output and p["shots"] > 0 else "failed" if not output and p["shots"] > 0 and not moved else "discarded")
        self._assemble()

    def _recover(self, op) -> None:
        for pid, p in self.pages.items():
            if p["state"] == "processing":
                p["state"], p["run_gen"] = "changed", None
                self._wait(pid)
                self._emit(pid, "recovered")

    def _tick(self, op) -> None:
        self._assemble()

    def _assemble(self) -> None:
        pending = any(p["state"] in PENDING_STATES and p["shots"] > 0 for p in self.pages.values())
        if self.stale and self.size is not None and not pending:
            self.stale = False
            self._emit(None, "assemble")


def timed(rows: DataFrame, wait_seconds: float, late_seconds: float) -> DataFrame:
    """``rows`` with a watermark on their times (``us``) for ``InOrder``: it waits for rows up to ``wait_seconds`` out of order."""
    ms = int((wait_seconds + late_seconds) * 1000)
    return rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", f"{ms} milliseconds")


def album_transitions(op: DataFrame, idle_seconds: float = IDLE_SECONDS, wait_seconds: float = WAIT_SECONDS, late_seconds: float = LATE_SECONDS) -> DataFrame:
    """Transitions of every album's pages from a stream of operations (album_id and ``OP_COLUMNS``), in any order within ``wait_seconds``.

    Operations up to ``late_seconds`` older than that are reported as ``late`` if later ones were worked on already.
    """
    rows = timed(op.select("album_id", *OP_COLUMNS), wait_seconds, late_seconds)
    return rows.groupBy("album_id").transformWithStateInPandas(AlbumState(idle_seconds, late_seconds), TRANSITIONS, "append", "eventTime")


class NewlyWarned(InOrder):
    """Pages of an album that are warned at a poll and were not at the poll before; nothing is new at the first.

    Rows are (us, seq, poll, page_id), one for each warned page of a poll, or one without a page. A poll is complete
    at its ``until_us``. What was warned last is forgotten after ``keep_seconds``: the next poll counts as a first.
    """

    row = StructType([StructField("us", LongType()), StructField("seq", LongType()), StructField("poll", LongType()), StructField("until_us", LongType()), StructField("page_id", StringType())])
    result = StructType([StructField("album_id", LongType()), StructField("poll", LongType()), StructField("page_id", StringType())])

    def __init__(self, keep_seconds: float, late_seconds: float):
        super().__init__(late_seconds)
        self.keep_us = int(keep_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        warned = StructType([StructField("poll", LongType()), StructField("until_us", LongType()), StructField("pages", StringType())])
        self.now_state, self.last_state = handle.getValueState("now", warned), handle.getValueState("last", warned)

    def load(self) -> None:
        def of(state):
            if not state.exists():
                return None
            poll, until, pages = state.get()
            return poll, until, set(filter(None, pages.split(",")))

        self.now, self.last = of(self.now_state), of(self.last_state)

    def save(self) -> None:
        for state, value in ((self.now_state, self.now), (self.last_state, self.last)):
            if value is None:
                state.clear()
            else:
                state.update((value[0], value[1], ",".join(sorted(value[2]))))

    def apply(self, row) -> None:
        if self.now is None or self.now[0] != row.poll:
            self._complete()
            self.now = (row.poll, row.until_us, set())
        if row.page_id is not None:
            self.now[2].add(row.page_id)

    def late(self, row) -> None:
        """A poll that is over stays as it was seen."""

    def due(self) -> int | None:
        if self.now is not None:
            return self.now[1]
        return None if self.last is None else self.last[1] + self.keep_us

    def ripe(self) -> None:
        if self.now is not None:
            self._complete()
        else:
            self.last = None

    def _complete(self) -> None:
        if self.now is not None:
            poll, until, pages = self.now
            if self.last is not None and until - self.last[1] <= self.keep_us:
                self.out += [(poll, p) for p in sorted(pages - self.last[2])]
            self.last, self.now = self.now, None


def newly_warned(rows: DataFrame, keep_seconds: float, wait_seconds: float = WAIT_SECONDS, late_seconds: float = LATE_SECONDS) -> DataFrame:
    """(album_id, poll, page_id) newly warned, from a stream of polls (album_id and the columns of ``NewlyWarned.row``); pages have no comma in their ids."""
    rows = timed(rows.select("album_id", *[f.name for f in NewlyWarned.row.fields]), wait_seconds, late_seconds)
    return rows.groupBy("album_id").transformWithStateInPandas(NewlyWarned(keep_seconds, late_seconds), NewlyWarned.result, "append", "eventTime")


def run_results(claims: DataFrame, ends: DataFrame, within_seconds: float, wait_seconds: float = WAIT_SECONDS) -> DataFrame:
    """Claims and run ends joined as streams: ``outcome`` and the page's next state, one row a run.

    ``claims`` has (run, claimed_at, gen, page_gen, has_shots, ready_at), ``ends`` (run, ended_at, output, error). An
    end belongs to the claim of its run at most ``within_seconds`` before it. An end without one is ``gone``; a claim
    without one is ``abandoned`` as soon as the watermark says that none can come.
    """
    ms = int(within_seconds * 1000)
    delay = f"{int(wait_seconds * 1000)} milliseconds"
    c, e = claims.withWatermark("claimed_at", delay), ends.withColumnRenamed("run", "_run").withWatermark("ended_at", delay)
    near = (F.col("run") == F.col("_run")) & (F.col("ended_at") >= F.col("claimed_at")) & (F.col("ended_at") <= F.col("claimed_at") + F.expr(f"INTERVAL {ms / 1000} SECONDS"))
    j = run_outcomes(c.join(e, near, "full_outer"))
    alone = F.col("_run").isNull()
    back = F.when(F.col("ready_at").isNotNull(), "ready").otherwise("changed")
    return j.select(
        F.coalesce("run", "_run").alias("run"), "claimed_at", "ended_at", F.when(alone, "abandoned").when(F.col("run").isNull(), "gone").otherwise(F.col("outcome")).alias("outcome"),
        F.when(alone, back).when(F.col("run").isNotNull(), F.col("next_state")).alias("next_state"),
    )


class Throttle(StatefulProcessor):
    """Lets one event of a key through, then none for a period."""

    def __init__(self, seconds: float = TOKEN_TOUCH_SECONDS):
        self.us = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        times = sorted(t for pdf in rows for t in pdf["us"].tolist())
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t in times:
            if last is None or t - last >= self.us:
                out.append((key[0], t))
                last = t
        if out:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["token", "us"])

    def close(self) -> None:
        pass


def touched_tokens(uses: DataFrame, seconds: float = TOKEN_TOUCH_SECONDS) -> DataFrame:
    """``last used`` marks of tokens, at most one per token and period; ``uses`` is (token, us)."""
    return uses.groupBy("token").transformWithStateInPandas(Throttle(seconds), StructType([StructField("token", StringType()), StructField("us", LongType())]), "append", "none")


class LatestFeedback(StatefulProcessor):
    """Keeps the newest feedback of a page; a row asked for before the stored one is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", StructType([StructField("us", LongType()), StructField("state", StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["seq"])
        at, state = self.stored.get() if self.stored.exists() else (None, None)
        out = []
        for r in batch.itertuples(index=False):
            if at is None or r.us >= at:
                at, state = int(r.us), r.state
                out.append((key[0], at, state))
        if out:
            self.stored.update((at, state))
        yield pd.DataFrame(out, columns=["page_id", "us", "state"])

    def close(self) -> None:
        pass


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Accepted feedback rows in order; ``feedback`` is (page_id, seq, us, state)."""
    schema = StructType([StructField("page_id", LongType()), StructField("us", LongType()), StructField("state", StringType())])
    return feedback.groupBy("page_id").transformWithStateInPandas(LatestFeedback(), schema, "append", "none")


def idle_sessions(op: DataFrame, keys: list[str], idle_seconds: float, wait_seconds: float = WAIT_SECONDS) -> DataFrame:
    """Idle stretches as session windows, each once the watermark has passed its end, so that state is dropped.

    Times are whole milliseconds, so a gap one millisecond short closes on the exact period.
    """
    ms = int(idle_seconds * 1000) - 1
    ts = F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint"))
    rows = op.withColumn("ts", ts).withWatermark("ts", f"{int(wait_seconds * 1000)} milliseconds")
    return rows.groupBy(*keys, F.session_window("ts", f"{ms} milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.max("ts").alias("last_change"))


def open_sessions(spark: SparkSession, keys: list[str], checkpoint: str) -> DataFrame:
    """The idle stretches that ``idle_sessions`` had still open when its stream stopped, read from its state."""
    v = F.col("value")
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(*[v[k].alias(k) for k in keys], v["session_window"].alias("w"), v["count"].alias("changes"), v["max"].alias("last_change"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into a Parquet table; a restart goes on from ``checkpoint``.

    The state store is set for this stream alone: it takes the session's settings as they are when it starts.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
