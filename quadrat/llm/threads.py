"""Chat formatting: quoted passages linked to the messages they come from.

A line's quote level is the number of > signs it begins with, blanks between
them allowed. Runs of lines of one level are passages; a passage is split into
sentences, which are normalised (lower case, words only, so that wrapping and
punctuation don't matter) and hashed. Spark joins the hashes of quoted sentences
to those of the unquoted text of earlier messages of the same conversation. The
message with the most matching sentences, the latest of several, is what the
passage quotes, and the lowest level that is linked names the message replied
to. A message that links to nothing replies to the one before it. Quotes and
the lines that introduce them ("... wrote:") are then removed, and a
conversation's messages are put in reply order: each message, then its replies
by turn, each followed by its own.

Only hashes of 8 bytes a sentence are joined, and only (turn, message replied to) is
gathered by conversation; texts are shuffled once, by message, so a conversation of
any length is spread. A sentence that q messages of a conversation quote and s
earlier ones hold makes up to q * s votes, counted before and after the shuffle.

Defined results: rows with a null conv_id or turn belong to no conversation and
are left out; a null text stays null, quotes nothing and is quoted by nothing; a
message of quotes alone has an empty text; a first message replies to nothing, that
is null; a very long text is one message; of messages with equally many matching
sentences the latest is the one quoted; repeated rows are one message; of rows that
share conv_id and turn but differ the smallest by role and text stays; an empty table
has no conversations; extra columns, whatever their names, aren't carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = re.compile(r"[ \t]*>")
_MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_INTRO = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|écrit|escribió)\b[^\n]{0,40}:[ \t]*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
_WORD = re.compile(r"\w+")


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines of one quote level, introductions left out."""
    out: list[tuple[int, list[str]]] = []
    lines = text.split("\n")
    levels = []
    for line in lines:
        m = _MARKS.match(line)
        levels.append(m[1].count(">") if m else 0)
    for k, line in enumerate(lines):
        level = levels[k]
        body = line[_MARKS.match(line).end() :] if level else line
        if k + 1 < len(lines) and levels[k + 1] > level and _INTRO.search(body):
            continue
        if level and not body.strip():
            continue
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(body)) for level, body in out]


def sentences(text: str) -> list[int]:
    """Hashes of the normalised sentences of a passage, in order."""
    out = []
    for s in _SENTENCE.split(" ".join(text.split())):
        words = _WORD.findall(s.lower())
        if words:
            out.append(xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63))
    return out


def split(text: str) -> tuple[str, list[int], list[tuple[int, int]]]:
    """The text without quotes, its sentences, and (level, sentence) of what it quotes."""
    if not (text[:1] in "> \t" and _QUOTED.match(text)) and "\n" not in text or ">" not in text:
        return text, sentences(text), []
    own, quoted = [], []
    for level, body in passages(text):
        if level:
            quoted += [(level, s) for s in sentences(body)]
        else:
            own.append(body.strip("\n"))
    if not quoted:
        return text, sentences(text), []
    mine = "\n".join(own).strip()
    return mine, sentences(mine), quoted


@F.arrow_udf(T.StructType().add("own", T.ArrayType(T.LongType())).add("quoted", T.ArrayType(T.StructType().add("level", T.LongType()).add("s", T.LongType()))))
def _hashes(texts: pa.Array) -> pa.Array:
    quoted = pa.list_(pa.struct([("level", pa.int64()), ("s", pa.int64())]))
    got = [("", [], []) if t is None else split(t) for t in texts.to_pylist()]
    own = pa.array([g[1] for g in got], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([own, pa.array([[{"level": a, "s": b} for a, b in g[2]] for g in got], quoted)], ["own", "quoted"])


@F.arrow_udf(T.StringType())
def _without_quotes(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else split(t)[0] for t in texts.to_pylist()], pa.string())


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of messages that quote earlier ones. messages: conv_id, turn, text."""
    h = messages.where("text is not null").select("conv_id", "turn", _hashes("text").alias("h"))
    quoted = h.select("conv_id", "turn", F.explode("h.quoted").alias("q")).groupBy("conv_id", "turn", "q.level", "q.s").agg(F.count("*").alias("c"))
    own = h.select("conv_id", F.col("turn").alias("source"), F.explode(F.array_distinct("h.own")).alias("s"))
    votes = quoted.join(own, ["conv_id", "s"]).where("source < turn").groupBy("conv_id", "turn", "level", "source").agg(F.sum("c").alias("n"))
    best = votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("n", "source")).alias("b"))
    return best.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "b.source")).alias("r")).select("conv_id", "turn", F.col("r.source").alias("reply_to"))


def reply_order(turns: list[int], reply_to: list[int | None]) -> list[tuple[int, int | None, int]]:
    """(index, message replied to, depth) in reply order; turns are ascending and distinct."""
    at = {t: k for k, t in enumerate(turns)}
    parent = [at[r] if r is not None else k - 1 for k, r in enumerate(reply_to)]
    children: list[list[int]] = [[] for _ in turns]
    depth = [0] * len(turns)
    for k, p in enumerate(parent):
        if p >= 0:
            children[p].append(k)
            depth[k] = depth[p] + 1
    out, stack = [], [0] if turns else []
    while stack:
        k = stack.pop()
        out.append((k, turns[parent[k]] if parent[k] >= 0 else None, depth[k]))
        stack += reversed(children[k])
    return out


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, reply_to, depth, text) of each message, `position` counting in reply order from 0 in each conversation."""
    base = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("conv_id is not null and turn is not null")
    one = W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    base = base.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k")
    linked = base.select("conv_id", "turn").join(links(base.select("conv_id", "turn", "text")), ["conv_id", "turn"], "left")
    grouped = linked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "reply_to"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [x["turn"] for x in m]
                rows += [(conv, turns[k], pos, to, depth) for pos, (k, to, depth) in enumerate(reply_order(turns, [x["reply_to"] for x in m]))]
            names = ["conv_id", "turn", "position", "reply_to", "depth"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names)

    order = grouped.mapInArrow(run, "conv_id long, turn long, position long, reply_to long, depth long")
    out = base.join(order, ["conv_id", "turn"])
    return out.select("conv_id", "position", "turn", "role", "reply_to", "depth", _without_quotes("text").alias("text"))


def rendered(ordered: DataFrame, end: str = "<|end|>") -> DataFrame:
    """(conv_id, chat): each conversation as one string of role headers and texts; a null text is empty."""
    part = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit(f"{end}\n"))
    m = F.sort_array(F.collect_list(F.struct("position", part.alias("p"))))
    return ordered.groupBy("conv_id").agg(F.array_join(F.transform(m, lambda x: x["p"]), "").alias("chat"))
