"""Answer streams without Markdown, split at citation markers; what is undecided waits in keyed state.

An answer arrives in deltas (answer_id, seq, text, last). `Splitter` takes text as it comes and keeps only what the next
delta may still change: a marker that isn't complete, an open span, a single star, blanks that a punctuation mark may
swallow. So its events are the same for every way to cut a text. `events` runs it with transformWithState: a map state
holds deltas that came before their turn, a value state the splitter; the last delta, or a timer once an answer has been
silent for long enough, ends the answer.

Fixed rules: backticks go and what stands between two of them stays as it is; two stars open and close bold text; other
stars go, but for single ones inside bold text; marks and spaces that open a heading go; spaces before the punctuation
marks below go; [CITE:kind:value] with kind edge, chunk or page, or [CITE:value] for a node, is an event, with or without
backticks around it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Punctuation before which no space stays (fixed value).
CJK_MARKS = "。，、；：！？''（）【】《》…"
_BLANKS_BEFORE = re.compile(rf" +([{re.escape(CJK_MARKS)}])")
_BODY = r"\[CITE:(edge:|chunk:|page:)?(\S+?)\]"
_MARK = re.compile(rf"`\[CITE:(edge:|chunk:|page:)?([^\s\]]+)\]`|{_BODY}")
#: A text's end that may turn into a marker.
_OPEN = re.compile(r"(?:`(?:\[(?:C(?:I(?:T(?:E(?::\S*)?)?)?)?)?)?|\[(?:C(?:I(?:T(?:E(?::\S*)?)?)?)?)?)\Z")


class Cleaner:
    """Drops Markdown from text that arrives in pieces. mode: plain, heading, tick (in backticks) or bold."""

    KEPT = ("mode", "star", "span", "fresh", "blank")

    def __init__(self) -> None:
        self.mode, self.star, self.span, self.fresh, self.blank = "plain", False, "", True, ""

    def _release(self, text: str) -> str:
        out = []
        for c in text:
            if c in " \t":
                self.blank += c
            else:
                out.append((self.blank.rstrip(" ") if c in CJK_MARKS else self.blank) + c)
                self.blank = ""
        return "".join(out)

    def _close(self) -> str:
        if self.span:
            self.fresh = self.span[-1] in "\r\n"
        out, self.span, self.mode = self._release(self.span), "", "plain"
        return out

    def _next(self, c: str) -> str:
        if self.mode == "heading" and c not in "# ":
            self.mode = "plain"
        star, self.star = self.star, False
        if self.mode == "tick":
            if c == "`":
                return self._close()
            self.span += c
        elif self.mode == "bold":
            if c == "*":
                if star:
                    return self._close()
                self.star = True
            else:
                self.span += ("*" if star else "") + c
        elif self.mode == "plain":
            if c == "`":
                self.mode = "tick"
            elif c == "*":
                if star:
                    self.mode = "bold"
                self.star = not star
            elif c == "#" and self.fresh:
                self.mode, self.fresh = "heading", False
            else:
                self.fresh = c in "\r\n"
                return self._release(c)
        return ""

    def feed(self, text: str) -> str:
        return "".join(map(self._next, text))

    def flush(self) -> str:
        """What is left when the text has ended; an open span comes without its marks."""
        rest = re.sub(" {2,}", " ", self.span)
        text = rest if rest and rest[0] in CJK_MARKS else self.blank + rest
        self.__init__()
        return _BLANKS_BEFORE.sub(r"\1", text)


def cleaned(text: str) -> str:
    """A whole answer, with the final pass over it."""
    c = Cleaner()
    text = re.sub(r"\*+", "", (c.feed(text) + c.flush()).replace("`", ""))
    return _BLANKS_BEFORE.sub(r"\1", re.sub(" {2,}", " ", text))


class Splitter:
    """Events of an answer that arrives in pieces: (place, kind, value), where place counts the citations so far.

    kind is `message` (a piece of the text of that place), or edge, chunk, page, node (the citation that ends the place).
    """

    def __init__(self, kept: str | None = None) -> None:
        self.cleaner, self.held, self.place = Cleaner(), "", 0
        if kept:
            state = json.loads(kept)
            self.held, self.place = state["held"], state["place"]
            for name in Cleaner.KEPT:
                setattr(self.cleaner, name, state[name])

    def kept(self) -> str:
        return json.dumps({"held": self.held, "place": self.place} | {name: getattr(self.cleaner, name) for name in Cleaner.KEPT})

    def _say(self, text: str) -> list[tuple[int, str, str]]:
        return [(self.place, "message", text)] if text else []

    def feed(self, text: str, last: bool = False) -> list[tuple[int, str, str]]:
        text, out, at = self.held + text, [], 0
        while m := _MARK.search(text, at):
            start = m.start()
            if not last and m.end() == len(text) and m[2] is None and start > at and text[start - 1] == "`":
                break  # a backtick may follow and make it a wrapped marker
            out += self._say(self.cleaner.feed(text[at:start]))
            kind, value = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
            out.append((self.place, kind[:-1] if kind else "node", value))
            self.place += 1
            at = m.end()
        hold = None if last else _OPEN.search(text, at)
        end = hold.start() if hold else len(text)
        out += self._say(self.cleaner.feed(text[at:end]))
        self.held = text[end:]
        if last:
            out += self._say(self.cleaner.flush())
        return out


class AnswerEvents(StatefulProcessor):
    """Deltas (answer_id, seq from 0, text, last, ms) in, events (answer_id, seq, place, kind, value) out."""

    def __init__(self, silent_ms: int) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "seq long", "text string, last boolean")
        self.now = handle.getValueState("now", "seq long, kept string")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["answer_id", "seq", "place", "kind", "value"])

    def _end(self) -> None:
        self.now.clear()
        self.early.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, kept = self.now.get() if self.now.exists() else (0, None)
        newest = 0
        for frame in rows:
            for r in frame.itertuples(index=False):
                newest = max(newest, int(r.ms))
                if r.seq >= seq:
                    self.early.updateValue((int(r.seq),), (r.text or "", bool(r.last)))
        splitter, out, ended = Splitter(kept), [], False
        while not ended and self.early.containsKey((seq,)):
            text, ended = self.early.getValue((seq,))
            self.early.removeKey((seq,))
            out += [(seq, *e) for e in splitter.feed(text, ended)]
            seq += 1
        if ended:
            self._end()
        else:
            self.now.update((seq, splitter.kept()))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.silent_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The answer has been silent: deltas that wait are taken in order, gaps or not, and the rest is flushed."""
        seq, kept = self.now.get()
        splitter, out = Splitter(kept), []
        for (n,), (text, _) in sorted(self.early.iterator()):
            out += [(n, *e) for e in splitter.feed(text)]
            seq = n + 1
        out += [(seq, *e) for e in splitter.feed("", True)]
        self._end()
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def answer_events(deltas: DataFrame, late: str = "1 minute", silent_seconds: int = 120) -> DataFrame:
    """Streaming deltas (answer_id long, seq long, text, last boolean, at timestamp) to events. Needs the RocksDB state store."""
    rows = deltas.select("answer_id", "seq", "text", "last", "at").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("answer_id").transformWithStateInPandas(AnswerEvents(silent_seconds * 1000), "answer_id long, seq long, place long, kind string, value string", "Append", "EventTime")
