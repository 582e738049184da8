"""Chat formatting from an event log.

A log row is an event of a message: ``delta`` appends text, ``edit`` replaces ``cut`` characters from ``at`` on, and
``regenerate`` throws away what was streamed so far.  The log is range-sorted by conversation, message and sequence
number: all events of a message meet in one partition, while a long conversation is cut over as many partitions as it
fills.  One streaming pass folds the events into final messages and renders them.

Rendering: ``### Role:`` line, escaped text, ``</turn>``.  A backslash stands before every backslash and before every
control string inside texts and roles, so a text can neither open nor close a turn and is read back unchanged.

Output rows are pieces of conversations of about ``PIECE`` characters that end at a turn; ``whole`` says that a piece is
the entire conversation.  ``loss`` lists the spans (code points in the piece) of assistant texts.

Defined cases: null texts, roles and deltas are empty; null conversations form one conversation and null turns come
first; messages with the same turn stand by role, then by the hash of their text, then in log order; repeated rows stay
separate turns; a conversation without messages does not appear; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lakegauge.llm.arrow import importable
from lakegauge.sources.work import written

CHUNK = 2000
PIECE = 1 << 20
END = "</turn>"
HEAD = "### "
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(END, "\\" + END).replace(HEAD, "\\" + HEAD)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text stands in it."""
    head = f"{HEAD}{escape(role).replace(chr(10), chr(92) + chr(10))}:\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


LOG = ["conv", "turn", "role", "tie", "message", "seq", "kind", "text", "at", "cut"]


def log_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """An event log as a chat service would have written it: texts streamed in deltas of ``chunk`` characters, a false
    start and a regeneration before each assistant text, a slip and its edit in each other text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("message"), text.alias("all"))
    event = lambda kind, t, at=0, cut=0: F.struct(F.lit(kind).alias("kind"), t.alias("text"), F.lit(at).cast("bigint").alias("at"), F.lit(cut).cast("bigint").alias("cut"))
    deltas = F.transform(F.sequence(F.lit(0), F.greatest(F.length("all") - 1, F.lit(0)), F.lit(chunk)),
                         lambda i: event("delta", F.substring(F.col("all"), i + 1, F.lit(chunk))))
    false_start = F.array(event("delta", F.lit("…")), event("regenerate", F.lit("")))
    slip = F.array(event("delta", F.lit("#")))
    mended = F.array(event("edit", F.lit(""), 0, 1))
    events = F.when(F.col("role") == "assistant", F.concat(false_start, deltas)).otherwise(F.concat(slip, deltas, mended))
    return rows.select("conv", "turn", "role", "tie", "message", F.posexplode(events).alias("seq", "e")).select(
        "conv", "turn", "role", "tie", "message", "seq", "e.*")


def fold(events) -> str:
    parts: list[str] = []
    for kind, text, at, cut in events:
        if kind == "delta":
            parts.append(text or "")
        elif kind == "regenerate":
            parts = []
        elif kind == "edit":
            whole = "".join(parts)
            at = min(max(at or 0, 0), len(whole))
            parts = [whole[:at], text or "", whole[at + max(cut or 0, 0):]]
        else:
            raise ValueError(f"unknown event {kind}")
    return "".join(parts)


class _Pieces:
    """Folds sorted events into pieces of conversations."""

    def __init__(self):
        self.conv, self.open, self.parts, self.loss, self.size, self.turns, self.k = None, False, [], [], 0, 0, 0
        self.message, self.events, self.out = None, [], []

    def add(self, conv, role, message, event):
        if message != self.message or not self.open or conv != self.conv:
            self.close_message()
            if not self.open or conv != self.conv:
                self.flush(True)
                self.conv, self.open, self.k = conv, True, 0
            elif self.size >= PIECE:
                self.flush(False)
            self.message, self.role = message, role or ""
        self.events.append(event)

    def close_message(self):
        if self.events:
            text, a, b = render_turn(self.role, fold(self.events))
            if self.role == "assistant":
                self.loss.append({"start": self.size + a, "end": self.size + b})
            self.parts.append(text)
            self.size += len(text)
            self.turns += 1
            self.events = []

    def flush(self, last: bool):
        if self.parts:
            self.out.append((self.conv, TaskContext.get().partitionId(), self.k, last and self.k == 0, self.turns, "".join(self.parts), self.loss))
            self.k += 1
        self.parts, self.loss, self.size, self.turns = [], [], 0, 0


def render(log: DataFrame) -> DataFrame:
    """Pieces: conv, part, k, whole, n_turns, formatted, loss."""
    kind = log.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part bigint, k bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
    order = ["conv", "turn", "role", "tie", "message"]

    def run(batches):
        # a partition cannot know whether its first and last conversations lie in others too: neither counts as whole
        pieces, first = _Pieces(), None

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

        names = ["conv", "part", "k", "whole", "n_turns", "formatted", "loss"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), span]
            for conv, role, message, *event in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                pieces.add(conv, role, message, event)
            out, pieces.out = pieces.out, []
            if out:
                if first is None:
                    first = (out[0][0],)
                yield rows([(c, p, k, w and c != first[0], n, f, x) for c, p, k, w, n, f, x in out])
        if types is not None:
            pieces.close_message()
            pieces.flush(False)
            if pieces.out:
                yield rows(pieces.out)

    return (importable(log).repartitionByRange(*order).sortWithinPartitions(*order, "seq")
            .select("conv", "role", "message", "kind", "text", "at", "cut").mapInArrow(run, schema))


def format_conversations(conversations: DataFrame, **columns) -> DataFrame:
    return render(log_of(conversations, **columns))


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces alone: counts and digests of turns and of text under the loss mask."""
    kind = pieces.schema["conv"].dataType.simpleString()
    facts = "conv {0}, part bigint, k bigint, whole boolean, n_turns bigint, turns binary, loss_chars bigint, loss binary, formatted_chars bigint".format(kind)
    results = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for formatted, loss, whole in zip(*[batch.column(i).to_pylist() for i in (5, 6, 3)]):
                turns = parse(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                masked = "".join(unescape(formatted[s["start"]:s["end"]]) for s in loss)
                under = masked.encode()
                if whole:  # nothing will be added: the digests are enough
                    said, under = hashlib.sha256(said).digest(), hashlib.sha256(under).digest()
                for c, v in zip(cols, (len(turns), said, len(masked), under, len(formatted))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))],
                names=["conv", "part", "k", "whole", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"])

    def combine(batches):
        state = None

        def done():
            conv, n, a, m, b, f = state
            return conv, n, a.hexdigest(), m, b.hexdigest(), f

        def rows(out, conv):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                              names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        conv_type = None
        for batch in batches:
            conv_type, out = batch.schema.field(0).type, []
            for conv, n, turns, m, loss, f in zip(*[batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7, 8)]):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n; state[3] += m; state[5] += f
                state[2].update(turns); state[4].update(loss)
            if out:
                yield rows(out, conv_type)
        if state is not None:
            yield rows([done()], conv_type)

    parts = written(pieces.mapInArrow(read, facts), "turns")
    whole = parts.filter("whole").select("conv", "n_turns", F.lower(F.hex("turns")).alias("turns_sha256"), "loss_chars",
                                         F.lower(F.hex("loss")).alias("loss_sha256"), "formatted_chars")
    # conversations that lie across partitions: their pieces only, streamed in order
    cut = parts.filter("not whole").repartition("conv").sortWithinPartitions("conv", "part", "k").mapInArrow(combine, results)
    return whole.unionByName(cut)


def op8_chat(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    found = read_back(format_conversations(rows.unionByName(extra)))
    return found.withColumnRenamed("conv", "conv_id")


ORACLE = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ') as safe from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### ' || role || ':' || chr(10) || safe || '</turn>' || chr(10)))::bigint as formatted_chars
from e group by conv_id
"""
