"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Each turn gives three segments: opening marker, text, closing marker. Only an assistant's text bears loss. Control
strings of the template inside texts are broken by a backslash after their first character, and backslashes are doubled;
``unescaped`` undoes both. The machine never stops a conversation: a turn that no transition allows is marked, and so is a
conversation that does not end on an answer.

A conversation of any length is streamed through one task (the digest of a conversation is sequential by nature), sorted
by Spark, so its turns are never held together.

Edge cases: null text is empty; null or unknown roles are kept by name inside a generic marker; equal (conv_id, turn)
rows are ordered by role, then text; a null conv_id is one conversation; no rows, no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    markers: dict = field(default_factory=lambda: {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")})
    other: tuple = ("[ROLE {}] ", " [/ROLE]")
    loss: frozenset = frozenset({"assistant"})
    control: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE", "[/ROLE]")
    #: state -> role -> next state; what is missing is not allowed.
    machine: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "asked"},
            "system": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    final: frozenset = frozenset({"answered"})


TEMPLATE = Template()


def escaped(text: str, t: Template = TEMPLATE) -> str:
    pattern = r"\\|" + "|".join(re.escape(c) for c in sorted(t.control, key=len, reverse=True))
    return re.sub(pattern, lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _markers(role: str | None, t: Template) -> tuple[str, str]:
    if role in t.markers:
        return t.markers[role]
    return t.other[0].format("-" if role is None else "x" + role.encode().hex()), t.other[1]


def _format(t: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, no = object(), "start", 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("conv_id", "turn_no", "part", "text", "loss", "allowed", "final")}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                fresh = conv != current
                if fresh:
                    current, state, no = conv, "start", 0
                after = t.machine.get(state, {}).get(role)
                allowed = after is not None
                # after an error the machine goes on from the state that the role leads to elsewhere
                state = after or next((m[role] for m in t.machine.values() if role in m), state)
                opening, closing = _markers(role, t)
                for part, piece in enumerate((t.begin * fresh + opening, escaped(text or "", t), closing)):
                    for name, value in zip(out, (conv, no, part, piece, part == 1 and role in t.loss, allowed, state in t.final), strict=True):
                        out[name].append(value)
                no += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), types, strict=True)], names=list(out))

    return run


def format_conversations(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments in order: conv_id, turn_no (from 0), part (0 to 2), text, loss, allowed (by the machine), final (whether
    the state after the turn may be the last). A conversation's segments put together are its formatted text."""
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.mapInArrow(_format(template), "conv_id long, turn_no long, part int, text string, loss boolean, allowed boolean, final boolean")


class _Reader:
    """Reads a formatted conversation back, piece by piece."""

    def __init__(self, t: Template) -> None:
        self.t, self.buffer, self.fresh = t, "", True
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.loss_chars = 0
        self.allowed, self.final = True, False
        self.openings = {opening: (role, closing) for role, (opening, closing) in t.markers.items()}
        a, b = (re.escape(x) for x in t.other[0].split("{}"))
        self.generic = re.compile(f"{a}(-|x[0-9a-f]*){b}")

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = unescaped(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.buffer += text
        while self.turn():
            pass

    def turn(self) -> bool:
        """Takes one complete turn off the buffer."""
        b = self.buffer
        at = len(self.t.begin) if self.fresh else 0
        if self.fresh and not b.startswith(self.t.begin):
            return False
        found = next(((role, len(o), closing) for o, (role, closing) in self.openings.items() if b.startswith(o, at)), None)
        if not found and (m := self.generic.match(b, at)):
            found = (None if m[1] == "-" else bytes.fromhex(m[1][1:]).decode(), m.end() - at, self.t.other[1])
        if not found:
            return False
        role, skip, closing = found
        end = b.find(closing, at + skip)
        if end < 0:
            return False
        text = unescaped(b[at + skip : end])
        self.turns.update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n, self.fresh, self.buffer = self.n + 1, False, b[end + len(closing) :]
        return True


def _read(t: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = object(), None
        done: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [[x[0] for x in done], *([getattr(x[1], a) if not callable(a) else a(x[1]) for x in done] for a in ("n", lambda r: r.turns.hexdigest(), "loss_chars", lambda r: r.loss.hexdigest(), "chars", lambda r: r.allowed and r.final))]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "well_formed"])
            done.clear()

        for batch in batches:
            for conv, text, loss, allowed, final in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "allowed", "final")), strict=True):
                if conv != current:
                    if reader:
                        done.append((current, reader))
                    current, reader = conv, _Reader(t)
                reader.feed(text, loss)
                reader.allowed, reader.final = reader.allowed and allowed, final
            if len(done) >= 1000:
                yield from flush()
        if reader:
            done.append((current, reader))
        yield from flush()

    return run


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Parses formatted conversations; ``segments`` as ``format_conversations`` gives them (its order is kept)."""
    return segments.mapInArrow(_read(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, well_formed boolean")


def op4(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS no, lag(role) OVER w AS before,
         length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE|\[/ROLE\]'))
         + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 16 + CASE WHEN role IS NULL THEN 1 ELSE 1 + 2 * strlen(role) END END AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
), s AS (
  SELECT *, CASE WHEN no = 1 THEN role IN ('system', 'user')
                 WHEN before = 'system' THEN role = 'user'
                 WHEN before IN ('user', 'tool') THEN role IN ('assistant', 'tool')
                 WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE false END AS allowed
  FROM o
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars,
       coalesce(bool_and(coalesce(allowed, false)), false) AND arg_max(coalesce(role, ''), no) = 'assistant' AS well_formed
FROM s GROUP BY conv_id
"""
