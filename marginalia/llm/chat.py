r"""Chat formatting in budgeted windows.

A conversation is read turn by turn, in order, from a partition sorted by conversation
and turn, so memory is bounded by a window and not by the conversation. Prefix sums of
turn tokens choose turn-aligned windows: each takes as many new turns as its budget
holds, after the system turn, which every window retains, and up to ``history`` earlier
turns, which it repeats. The loss mask covers the text of each assistant turn once, in
the window where the turn is new; repeated targets are masked out.

Template: ``<s>`` opens a window, ``[INST]role\n`` a turn, ``[/INST]`` ends it, ``</s>``
closes the window. Inside texts and roles every control string gets a backslash after
its first character and every backslash is doubled, so a control string can only come
from the template and the text can be read back exactly.

Defined results: null texts and roles are empty; a null turn sorts before all others and
equal turns by role and text, repeated rows staying; null conv_ids form a conversation;
a turn over the budget has a window of its own, uncut; no rows give no windows. A system
turn is the first turn of a conversation if its role is ``system``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_texts, tokenizer_path

BUDGET = 2048
HISTORY = 2
#: Control strings of this template and of other common ones.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))) + r"|\\")
_TURN = re.compile(r"\[INST\]([^\n]*)\n(.*?)\[/INST\]", re.S)

WINDOWS = (
    "conv_id long, window int, formatted string, loss array<struct<start:int,end:int>>, "
    "repeated array<boolean>, tokens long"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    """As a text, with a backslash and n for a newline; no control string has n there."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {None: "", "\\": "\\", "n": "\n"}[m[1]], role)


class Turn:
    __slots__ = ("role", "text", "tokens")

    def __init__(self, role: str, text: str, tokens: int):
        self.role, self.text, self.tokens = role, text, tokens


def render(turns: list[Turn], repeated: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and its loss spans, in code points."""
    out, at, loss = ["<s>"], 3, []
    for turn, again in zip(turns, repeated, strict=True):
        head, body = f"[INST]{escape_role(turn.role)}\n", escape(turn.text)
        if turn.role == "assistant" and not again:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "[/INST]"]
        at += len(head) + len(body) + 7
    return "".join([*out, "</s>"]), loss


def windows_of(turns, budget: int = BUDGET, history: int = HISTORY):
    """Windows of one conversation, from an iterator of turns: (turns, repeated, tokens).

    ``sums`` holds prefix sums over the turns still needed: the history and those that
    wait. A window of new turns i to j costs the system turn and sums[j] - sums[h], where
    h is the first repeated turn; repeats give way when they would keep the next turn out.
    """
    system: Turn | None = None
    held: list[Turn] = []  # history, then waiting turns
    sums = [0]
    done = 0  # turns of ``held`` that are history
    first = True

    def close(until: int):
        """The window whose new turns are held[done:until]."""
        room = budget - (system.tokens if system else 0)
        start = max(0, done - history)
        while start < done and sums[until] - sums[start] > room:
            start += 1
        lead = [system] if system else []
        again = [not first] * len(lead) + [True] * (done - start) + [False] * (until - done)
        return lead + held[start:until], again, sum(t.tokens for t in lead) + sums[until] - sums[start]

    for turn in turns:
        if first and not held and system is None and turn.role == "system":
            system = turn
            continue
        held.append(turn)
        sums.append(sums[-1] + turn.tokens)
        room = budget - (system.tokens if system else 0)
        # The last of these prefixes that fits in the room is the window's end.
        if sums[-1] - sums[done] > room:
            until = max(int(np.searchsorted(sums, sums[done] + room, side="right")) - 1, done + 1)
            yield close(until)
            first = False
            keep = max(0, until - history)
            held, done = held[keep:], until - keep
            sums = [0, *np.cumsum([t.tokens for t in held]).tolist()]
    while done < len(held) or (first and system):
        room = budget - (system.tokens if system else 0)
        until = max(int(np.searchsorted(sums, sums[done] + room, side="right")) - 1, min(done + 1, len(held)))
        yield close(until)
        first, done = False, until


def read_back(formatted: str, loss, repeated) -> list[tuple[str, str, bool, str]]:
    """Per turn of a window: role, text, whether it repeats, and its text under the mask."""
    masked = {s["start"]: formatted[s["start"] : s["end"]] for s in loss}
    out = []
    for m, again in zip(_TURN.finditer(formatted), repeated, strict=True):
        out.append((unescape_role(m[1]), unescape(m[2]), again, unescape(masked.get(m.start(2), ""))))
    return out


def format_windows(conversations: DataFrame, path: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation; those of one stand together and in order."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    ordered = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches):
        import itertools

        import pyarrow as pa

        from marginalia.llm.bpe import codec

        def rows():
            encode = codec(path).encode
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    own = batch.slice(at, 500).to_pydict()
                    for conv, role, text, ids in zip(own["conv_id"], own["role"], own["text"], encode(own["text"]), strict=True):
                        yield conv, Turn(role, text, len(ids) // 4)

        ready: list[dict] = []
        size = 0
        schema = pa.schema([
            ("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ("repeated", pa.list_(pa.bool_())), ("tokens", pa.int64()),
        ])
        for conv, own in itertools.groupby(rows(), key=lambda r: r[0]):
            for k, (turns, again, tokens) in enumerate(windows_of((t for _, t in own), budget, history)):
                text, loss = render(turns, again)
                spans = [{"start": a, "end": b} for a, b in loss]
                ready.append({"conv_id": conv, "window": k, "formatted": text, "loss": spans, "repeated": again, "tokens": tokens})
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return map_texts(ordered.select("conv_id", "role", "text"), run, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back: one row per conversation.

    ``windows`` must be as :func:`format_windows` gives them; running digests need one
    window at a time.
    """

    def run(batches):
        import itertools

        import pyarrow as pa

        rows = ((r["conv_id"], r) for batch in batches for at in range(0, batch.num_rows, 100) for r in batch.slice(at, 100).to_pylist())
        ready: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def batch_of(ready):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names=names
            )

        for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = k = 0
            for _, w in own:
                k, chars = k + 1, chars + len(w["formatted"])
                for role, text, again, masked in read_back(w["formatted"], w["loss"], w["repeated"]):
                    if not again:
                        n += 1
                        turns.update(f"{role}\n{text}\n".encode())
                    loss_chars += len(masked)
                    loss.update(masked.encode())
            ready.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, k))
            if len(ready) >= 10_000:
                yield batch_of(ready)
                ready = []
        if ready:
            yield batch_of(ready)

    return map_texts(
        windows, run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_windows long",
    )
