"""Requests and the decisions on them as keyed state: rows wait as Arrow frames by groups of requests, and are decided as columns.

A group's rows are looked through when a request's time is over, at most once every WAKE of event time: what is decided goes
out, requests whose time isn't over stay, and decisions stay that can still count for one of them or for a request that may
still come. So state lies on disk, a task holds one group's rows, and no call is made for a single request.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from attestry.streaming.ordered import Waiting

#: Stands for null in a column of long.
NONE = -(1 << 63)
#: Milliseconds of event time.
WAKE = 3_600_000
FIELDS = {"request": "string", "at": "long", "asked": "boolean", "low": "long", "high": "long", "deadline_s": "long", "approver": "string", "decision": "string", "seq": "long"}


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, the same for equal ones; -1 for null."""
    return values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _first(rows: pa.Table, due: np.ndarray) -> pd.DataFrame:
    """place (of a request of due in rows), row (of a decision in rows): the first decision of each approver in a request's time, in order.

    Of one time and seq a rejection comes first.
    """
    column = lambda c: rows[c].to_numpy()
    asked, codes, at, seq = column("asked").astype(bool), _codes(rows["request"]), column("at"), column("seq")
    told = np.flatnonzero(~asked)
    met = pd.DataFrame({"code": codes[due], "place": due}).merge(pd.DataFrame({"code": codes[told], "row": told}), on="code")
    place, row = met["place"].to_numpy(), met["row"].to_numpy()
    in_time = (at[row] >= column("low")[place]) & (at[row] <= column("high")[place])
    place, row = place[in_time], row[in_time]
    texts = rows["decision"].take(pa.array(row)).to_pandas()
    order = np.lexsort((texts.fillna("").rank(method="dense"), (texts != "reject").to_numpy(), seq[row], at[row], place))
    found = pd.DataFrame({"place": place[order], "approver": _codes(rows["approver"])[row[order]], "row": row[order]})
    return found.drop_duplicates(["place", "approver"])[["place", "row"]]


class Decided(Waiting):
    """Rows: see FIELDS. low, high: of a request the first and last microsecond of a decision that counts; low of a decision: the last microsecond of a request it can count for."""

    names, kinds = list(FIELDS), tuple(FIELDS.values())

    def __init__(self, threshold: int):
        self.threshold = threshold

    def _at(self, micros: int | None) -> int | None:
        """The next full WAKE after a time."""
        return None if micros is None else -(-(micros // 1000 + 1) // WAKE) * WAKE

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ends = []
        for f in self._came(rows):
            ends += [pc.min(f["high"].filter(f["asked"])).as_py(), pc.max(f["low"].filter(pc.invert(f["asked"]))).as_py()]
        soonest = min((e for e in ends if e is not None), default=None)
        self._wake(None if soonest is None else max(self._at(soonest), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.wakes.clear()
        known = list(self.waiting.get())
        if not known:
            return
        rows = pa.concat_tables([self._taken(n) for n, *_ in known]).combine_chunks()
        asked, low, high = rows["asked"].to_numpy().astype(bool), rows["low"].to_numpy(), rows["high"].to_numpy()
        over = asked & (high < 1000 * mark)
        due, open_ = np.flatnonzero(over), np.flatnonzero(asked & ~over)
        if len(due):
            yield self._told(rows, due)
        stays = (asked & ~over) | (~asked & (low >= 1000 * mark))
        if len(open_):
            stays[_first(rows, open_)["row"].to_numpy()] = True
        rest = rows.filter(pa.array(stays))
        wait = self._cut(1 + max(n for n, *_ in known), rest)
        self.waiting.put(wait) if wait else self.waiting.clear()
        if len(open_) or len(rest):
            self._wake(max(self._at(int(high[open_].min() if len(open_) else low[stays].max())), mark + 1))

    def _told(self, rows: pa.Table, due: np.ndarray) -> pd.DataFrame:
        found = _first(rows, due)
        texts = rows["decision"].take(pa.array(found["row"].to_numpy())).to_pandas()
        no, yes = (texts == "reject").to_numpy(), (texts == "approve").to_numpy()
        count = pd.Series(yes).groupby(found["place"].to_numpy()).cumsum().to_numpy()
        ends = found.assign(no=no)[no | (count >= self.threshold)].drop_duplicates("place")
        at = np.searchsorted(due, ends["place"].to_numpy())
        status, seq = np.full(len(due), "expired", object), np.full(len(due), NONE)
        status[at] = np.where(ends["no"], "rejected", "approved")
        seq[at] = rows["seq"].to_numpy()[ends["row"].to_numpy()]
        own = rows.select(["request", "at", "deadline_s"]).take(pa.array(due)).to_pandas()
        return own.assign(status=status, seq=seq).drop_duplicates(["request", "at", "deadline_s"])[["request", "deadline_s", "status", "seq"]]
