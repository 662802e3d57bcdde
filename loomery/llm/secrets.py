"""Secrets found by one deterministic automaton for all rules.

The heads of all rules become one minimal automaton over bytes (see ``automaton``), which reads every byte of a text
once. Where a rule's head ends, its reversed automaton finds the start, and its own automaton reads on to the longest
end. What such a scan read is remembered: a later scan of the same rule that comes to the same state at the same byte ends
as the first did, so a text takes time in proportion to its length even where heads stand close and their ends fail.
Matches of one rule don't overlap: a head inside the match before it is part of that match. A rule's shortest length
is tested on the match, which counts as read even when it fails.

Cases: a null text is the empty text (no spans). Very long texts are scanned whole. Repeated rows each get their row;
other columns are dropped. Any bytes outside ASCII belong to no rule. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import automaton, spill, textkit


class Rule(NamedTuple):
    kind: str
    head: str  # how a match begins; the joint automaton looks for this
    rest: str  # what may follow, as often as it likes or as written
    least: int = 1  # characters of the match, or of the value after the first : or = if ``value``
    any_case: bool = False
    value: bool = False


# The three base rules come first, in the order that ties follow.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", "[A-Za-z0-9+/_.=-]*", 12, any_case=True, value=True),
    Rule("access", "AKIA[A-Z0-9]", "[A-Z0-9]*", 18),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]*", 16),
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]*", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9]", "[A-Za-z0-9-]*", 20),
    Rule("google", "AIza[A-Za-z0-9_-]", "[A-Za-z0-9_-]*", 39),
    Rule("stripe", "sk_live_[A-Za-z0-9]", "[A-Za-z0-9]*", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]", r"[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    # The body goes, too, as long lines of base64 where the end is missing.
    Rule("pem", "-----BEGIN ", r"[A-Z ]*PRIVATE KEY-----([\x20\x09-\x0D]*[A-Za-z0-9+/=]{20,})*([\x20\x09-\x0D]*[A-Za-z0-9+/=]*[\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----)?"),
)
BASE = ("assign", "access", "hex")


class _Trail(NamedTuple):
    """The states of one scan from ``start`` on, and where its longest match ends."""

    start: int
    states: list[list]
    best: int


class Scanner:
    """Lists in place of arrays: a state is the list of its next states, with the rules it accepts in place 256."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], rules: tuple[Rule, ...]):
        self.rules = rules
        self.all, *each = [self._linked(*t) for t in tables]
        self.ahead, self.back = each[: len(rules)], each[len(rules) :]

    @staticmethod
    def _linked(moves: np.ndarray, accept: np.ndarray) -> list:
        states: list[list] = [[] for _ in accept]
        for state, row, bits in zip(states, moves.tolist(), accept.tolist(), strict=True):
            state.extend(states[q] for q in row)
            state.append(bits)
        # a state that no byte leaves and that accepts nothing is the end of an anchored scan
        for state in states:
            state.append(not state[256] and all(x is state for x in state[:256]))
        return states[0]

    @staticmethod
    def _longest(state: list, data: bytes) -> int:
        best = 0
        for k, b in enumerate(data, 1):
            state = state[b]
            if state[256]:
                best = k
            elif state[257]:
                break
        return best

    @staticmethod
    def _end(state: list, data: bytes, start: int, trails: list[_Trail]) -> int:
        """Where the longest match from ``start`` ends, or ``start``."""
        trails[:] = [t for t in trails if t.start + len(t.states) > start]
        best, states = start, []
        for at in range(start, len(data)):
            state = state[data[at]]
            if state[256]:
                best = at + 1
            elif state[257]:
                break
            for t in trails:
                if t.start <= at < t.start + len(t.states) and t.states[at - t.start] is state:  # from here on as before
                    return max(best, t.best) if t.best > at else best
            states.append(state)
        trails.append(_Trail(start, states, best))  # in a place where trails meet none, states differ: few stay
        return best

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start and then rule."""
        data = text.encode("utf-8", "surrogatepass")
        hits, state, was = [], self.all, 0
        for at, b in enumerate(data):
            state = state[b]
            if state[256] != was:
                if new := state[256] & ~was:
                    hits.append((at + 1, new))
                was = state[256]
        if not hits:
            return []
        spans, free = [], [0] * len(self.rules)
        trails: list[list[_Trail]] = [[] for _ in self.rules]
        for stop, bits in hits:
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and stop > free[k]:
                    size = self._longest(self.back[k], memoryview(data)[stop - 1 :: -1])
                    start = stop - size
                    if start < free[k]:
                        continue
                    end = self._end(self.ahead[k], data, start, trails[k])
                    if end == start:  # the head alone
                        continue
                    free[k] = end
                    found = data[start:end]
                    if rule.value:
                        cut = min(x for x in (found.find(b":"), found.find(b"=")) if x >= 0)
                        found = found[cut + 1 :].lstrip(b" ")
                        found = found[found[:1] in (b'"', b"'") :]
                    if len(found) >= rule.least:
                        spans.append((start, k, end))
        if len(data) != len(text):
            heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
            place = lambda i: int(heads[i - 1]) if i else 0
            spans = [(place(s), k, place(e)) for s, k, e in spans]
        return sorted(spans)


def build(rules: tuple[Rule, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Transition arrays: all rules together anywhere, then each rule from its start, then each reversed."""
    nodes = [automaton.parse(r.head, r.any_case) for r in rules]
    whole = [automaton.parse(r.head + r.rest, r.any_case) for r in rules]
    return [automaton.compile_rules(nodes, True), *(automaton.compile_rules([n], False) for n in whole), *(automaton.compile_rules([automaton.reverse(n)], False) for n in nodes)]


_ready: dict[tuple[Rule, ...], Scanner] = {}
SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row the key and ``spans``: kind, start and end (code points, end exclusive), by start and order of rules."""
    spark = df.sparkSession
    spill.small_batches(spark)
    rows = textkit.one_text_column(df, key, text=text)
    return rows.mapInArrow(_scan(spark, rules, False), f"k {rows.schema[key].dataType.simpleString()}, {SPANS}").withColumnRenamed("k", key)


def _scan(spark, rules: tuple[Rule, ...], redact: bool):
    tables = spark.sparkContext.broadcast(build(rules))  # bounded by the rules, not by the data
    names = [r.kind for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules not in _ready:
            _ready[rules] = Scanner(tables.value, rules)
        scan = _ready[rules].scan
        for batch in textkit.batches(given):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [scan(t or "") for t in texts]
            if redact:
                clean = [_masked(t, spans, names) if spans else t for t, spans in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(clean, pa.string())], batch.schema.names)
            else:
                spans = [[{"kind": names[k], "start": s, "end": e} for s, k, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["k", "spans"])

    return run


def _masked(text: str, spans: list[tuple[int, int, int]], names: list[str]) -> str:
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{names[k]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; in ``text`` each span, or group of overlapping spans, gives way to its kind in brackets."""
    spark = df.sparkSession
    spill.small_batches(spark)
    names = [c for c in df.columns if c != text]
    rows = df.select(*names, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(_scan(spark, rules, True), rows.schema).select(*df.columns)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
