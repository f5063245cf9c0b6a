r"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered; where one
output is the beginning of the next, what was added is the new turn's span; where it isn't, the template rewrites history, which is
reported and no span after that place is told. Inside a span the text's place is found by rendering the turn once more with a marker for
its text; a template that drops or mangles a text loses the marker, and that turn has no place.

The template here writes <s>role: user as [INST] text [/INST], assistant as <s> text </s>, any other role as [TURN role] text [/TURN]. Inside texts and roles a backslash is put
before every backslash and before every sign that begins one of these control strings, so the output can be read back exactly.

Defined cases: null text and null role are empty; turns are ordered by turn (null first), then role, then text; repeated rows are turns
of their own; a null conv_id is a conversation of its own; other columns are not read. Where the template rewrites history (``rewrites``) or
loses a marker (``n_unplaced`` turns), the spans and contents concerned are null and the loss mask has the other assistants' texts only, so
no control string or foreign text is ever under it; callers drop or mend such conversations by these two columns. A conversation is rendered in one task, a
prefix at a time, so the copying of its text grows with its turns times its length; escaping and searching grow with its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "[TURN ", "[/TURN]")
_ESCAPED = re.compile(r"\\|(?=\[/?INST\]|</?s>|\[TURN |\[/TURN\])|\]")
_MARK = "\ue000"


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(maxsize=2048)
def _rendered(role: str, text: str) -> str:
    """One turn; remembered, as the same turns are rendered with every longer prefix."""
    t = escape(text)
    return f"[INST]{t}[/INST]" if role == "user" else f"<s>{t}</s>" if role == "assistant" else f"[TURN {escape(role)}]{t}[/TURN]"


def render(turns: list[Turn]) -> str:
    return "".join([_rendered(role, text) for role, text in turns])


_TURN = re.compile(r"\[INST\](?P<user>(?:[^\\]|\\.)*?)\[/INST\]|<s>(?P<assistant>(?:[^\\]|\\.)*?)</s>|\[TURN (?P<role>(?:[^\\]|\\.)*?)\](?P<other>(?:[^\\]|\\.)*?)\[/TURN\]", re.S)


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of render()."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        kind = next(k for k in ("user", "assistant", "other") if m[k] is not None)
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


@dataclass
class Rendered:
    formatted: str
    spans: list[tuple[int, int] | None]  # of each turn with its control strings
    contents: list[tuple[int, int] | None]  # of each turn's text
    rewrites: bool  # an earlier output isn't the beginning of a later one


def render_incrementally(turns: list[Turn], template: Template = render) -> Rendered:
    before, spans, contents, rewrites = template([]) if turns else "", [], [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not rewrites and not now.startswith(before):
            # what was told so far is of an output that is gone
            rewrites, spans, contents = True, [None] * (k - 1), [None] * (k - 1)
        n, mark = len(before), _MARK
        before = now
        if rewrites:
            spans.append(None)
            contents.append(None)
            continue
        while now.find(mark, n) >= 0:
            mark += _MARK
        probe = template([*turns[: k - 1], (turns[k - 1][0], mark)])
        head = probe.find(mark, n)
        tail = len(probe) - head - len(mark)
        same = head >= 0 and probe[:head] == now[:head] and probe[head + len(mark) :] == now[len(now) - tail :] and head <= len(now) - tail
        spans.append((n, len(now)))
        contents.append((head, len(now) - tail) if same else None)
    return Rendered(before, spans, contents, rewrites)


def format_chats(conversations: DataFrame, template: Template = render) -> DataFrame:
    """conv_id, formatted, spans, contents, roles, loss_spans (the texts of assistants), rewrites, n_unplaced (turns whose text has no place): a row for each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    span = "array<struct<start:long,stop:long>>"

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = lambda s: [None if x is None else {"start": x[0], "stop": x[1]} for x in s]
        for b in batches:
            rows = []
            for conv, roles, texts in zip(b["conv_id"], b["roles"], b["texts"]):
                r = render_incrementally(list(zip(roles, texts)), template)
                loss = [c for c, role in zip(r.contents, roles) if role == "assistant" and c]
                rows.append((conv, r.formatted, pairs(r.spans), pairs(r.contents), list(roles), pairs(loss), r.rewrites, r.contents.count(None)))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "spans", "contents", "roles", "loss_spans", "rewrites", "n_unplaced"])
            yield out.astype({"conv_id": "Int64"})

    return chats.mapInPandas(formatted, f"conv_id long, formatted string, spans {span}, contents {span}, roles array<string>, loss_spans {span}, rewrites boolean, n_unplaced long")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites, n_unplaced: read back from the formatted text and its mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digests(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = []
        for t, spans in zip(text, loss):
            turns, masked = read_back(t), [unescape(t[s["start"] : s["stop"]]) for s in spans]
            told = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode("utf-8", "replace")).hexdigest()
            rows.append((len(turns), told, sum(map(len, masked)), hashlib.sha256("".join(masked).encode("utf-8", "replace")).hexdigest(), len(t)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", digests("formatted", "loss_spans").alias("d"), "rewrites", "n_unplaced").select("conv_id", "d.*", "rewrites", "n_unplaced")
