"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Successive turn
prefixes are rendered, every one of them, and consecutive outputs compared: where an output begins with the one
before, what it adds is the span of the new turn; where it doesn't, the template rewrites its
history, which is reported with the number of turns at which it first does. Within a turn's span the
text is located by rendering the prefix once more with a character in its place that no turn has. Where
history is rewritten, spans are those of the last output, found by rendering it once more for each turn.

Nothing short of all prefixes tells that a black box never rewrites, so a conversation of n turns
takes 2n renderings of its prefixes: time in proportion to the square of its length, and room for two
outputs. Conversations are independent and are dealt out by id; a task holds one conversation's turns and output at most,
whatever its number of rows.

Conversations with nulls: a null role or text is empty, a null
turn sorts first, ties sort by role and text, and a null id is one conversation of its own.
Repeated rows are turns of their own. An empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")

Turn = tuple[str, str]


def escaped(text: str) -> str:
    r"""No control string is left: a backslash goes into every `<|`, and one more into `<\|`."""
    return _OPEN.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def chatml(turns: list[Turn]) -> str:
    """Roles and texts come escaped."""
    return "".join([f"{START}{role}\n{text}{END}\n" for role, text in turns])


def read_chatml(output: str) -> Iterator[Turn]:
    """The turns of an output, by its control strings alone."""
    at = 0
    while at < len(output):
        stop = output.index(END, at)
        role, _, text = output[at + len(START) : stop].partition("\n")
        yield unescaped_role(role), unescaped(text)
        at = stop + len(END) + 1


def _same(x: str) -> str:
    return x


@dataclass(frozen=True)
class Template:
    """render: the black box. What roles and texts are escaped with before it, and texts read back with; read: the
    turns of an output, if the template has control strings to tell them by (else they are read by their spans)."""

    render: Callable[[list[Turn]], str]
    escape_role: Callable[[str], str] = _same
    escape: Callable[[str], str] = _same
    unescape: Callable[[str], str] = _same
    read: Callable[[str], Iterator[Turn]] | None = None


CHATML = Template(chatml, escaped_role, escaped, unescaped, read_chatml)


@dataclass
class Rendered:
    """The output; for each turn the span of what it adds and of its text (code points; both empty where the output
    doesn't have the text as it is); the number of turns at which the template first rewrites its history, or 0."""

    text: str
    spans: list[tuple[int, int]]
    inner: list[tuple[int, int]]
    rewrites: int


def _absent(turns: list[Turn]) -> str:
    """A character that no turn has."""
    used = set().union(*(set(x) for t in turns for x in t))
    return next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)


def _located(output: str, probed: str, probe: str, text: str, since: int) -> tuple[int, int] | None:
    """Where the text stands in the output: where the probe does in the output that has it in the text's place."""
    at = probed.find(probe, since)
    return (at, at + len(text)) if at >= 0 and output.startswith(text, at) else None


def render(turns: list[Turn], template: Callable[[list[Turn]], str] = chatml) -> Rendered:
    """Renders a conversation turn by turn and locates its turns."""
    probe = _absent(turns)
    before, spans, inner, rewrites = template([]), [], [], 0
    for k, (role, text) in enumerate(turns):
        output = template(turns[: k + 1])
        if not output.startswith(before):
            rewrites = rewrites or k + 1
        elif not rewrites:
            spans.append((len(before), len(output)))
            probed = template([*turns[:k], (role, probe)])
            inner.append(_located(output, probed, probe, text, len(before)) or (len(before), len(before)))
        before = output
    if rewrites:  # spans hold for the last output
        inner, at = [], 0
        for k, (role, text) in enumerate(turns):
            probed = template([*turns[:k], (role, probe), *turns[k + 1 :]])
            inner.append(_located(before, probed, probe, text, 0) or (at, at))
            at = inner[-1][1]
        spans = list(inner)
    return Rendered(before, spans, inner, rewrites)


def formatted(conversations: DataFrame, texts: bool = True, template: Template | Callable[[list[Turn]], str] = CHATML, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, digests read back from the output,
    formatted_chars, rewrites (the number of turns at which history is first rewritten, or 0), and (texts) the output, the turns' spans and the
    loss spans. A template that is a mere function gets roles and texts as they are."""
    box = template if isinstance(template, Template) else Template(template)
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType
    own = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    pairs = "array<struct<start:bigint,end:bigint>>"
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites bigint" + (f", formatted string, turn_spans {pairs}, loss_spans {pairs}" if texts else "")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        ready = 0
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"] + ["formatted", "turn_spans", "loss_spans"] * texts
        made: pa.Schema | None = None

        def close(key, turns: list[Turn]) -> None:
            nonlocal ready
            safe = [(box.escape_role(r), box.escape(t)) for r, t in turns]
            got, mask = render(safe, box.render), [r in loss_roles for r, _ in turns]
            texts_of = [box.unescape(got.text[a:b]) for a, b in got.inner]
            whole, loss, n, loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text in box.read(got.text) if box.read else zip((r for r, _ in turns), texts_of, strict=True):
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for text, masked in zip(texts_of, mask, strict=True):
                if masked:
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    loss_chars += len(text)
            row = {"conv_id": key, "n_turns": n, "turns_sha256": whole.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(got.text), "rewrites": got.rewrites}
            if texts:
                row |= {"formatted": got.text, "turn_spans": [{"start": a, "end": b} for a, b in got.spans], "loss_spans": [{"start": a, "end": b} for (a, b), m in zip(got.inner, mask, strict=True) if m]}
                ready += len(got.text)
            out.append(row)

        def flush() -> pa.RecordBatch:
            nonlocal ready
            batch = pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in out], schema=made)
            out.clear()
            ready = 0
            return batch

        now, turns, began = None, [], False
        for b in batches:
            if made is None:
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string(), spans, spans] * texts
                made = pa.schema(list(zip(names, types, strict=True)))
            for key, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if began and key != now:
                    close(now, turns)
                    turns = []
                    if len(out) >= 2000 or ready > 8 << 20:
                        yield flush()
                began, now = True, key
                turns.append((role, text))
        if began:
            close(now, turns)
        if out:
            yield flush()

    return own.mapInArrow(fold, schema)
