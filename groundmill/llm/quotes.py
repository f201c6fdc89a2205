"""Chat formatting by quotation linking.

Lines led by ``>`` are quotes, one level per sign.  Consecutive quoted lines of one level are a passage;
passages and their lines are normalised and hashed, and a join on the hash finds the message they were
written in: as a whole text, paragraph or line, or, for a passage or its paragraph, as any run of words.
Rolling hashes of the lengths that occur tell which runs are worth a hash.  Messages point at the message they reply to, so conversations are ordered by thread, and
their texts keep no quotes.  A thread's order is the walk through its replies, each answer after what it answers: the
list of steps down and up the replies is ranked by pointer jumping, so no thread is gathered in one task.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.llm._store import cut, release

_LEVEL = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
#: Signs of a normalised passage below which it links to nothing.
LEAST = 8
#: Base of the rolling hash and its inverse modulo 2^64, and bits of a slot of the table that says which hashes occur in
#: quotes; each hash has two slots.
BASE, TABLE = 0x9E3779B97F4A7C15, 24
INVERSE = pow(BASE, -1, 1 << 64)
#: A line such as "On Monday, Ann wrote:" goes with the quote below it.
_LEAD = re.compile(r"^.{0,200}\b(?:wrote|writes|said|écrit|schrieb|escribió)\s*:\s*$", re.I)


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def key(text: str) -> str | None:
    """The hash of a normalised passage; None if it is too short to tell messages apart."""
    x = normal(text)
    return hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=16).hexdigest() if len(x) >= LEAST else None


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its quoted passages as (level, passage), outermost level 1."""
    own, passages = [], []
    level, block = 0, []
    for line in [*text.split("\n"), None]:
        m = _LEVEL.match(line) if line is not None else None
        now = m.group(1).count(">") if m else 0
        if level and (line is None or now != level):
            passages.append((level, "\n".join(block)))
            block = []
        if now:
            if not level:
                while own and not own[-1].strip():
                    own.pop()
                if own and _LEAD.match(own[-1]):
                    own.pop()
            block.append(line[m.end() :])
        elif line is not None:
            own.append(line)
        level = now
    return ("\n".join(own).strip("\n") if passages else text), [p for p in passages if p[1].strip()]


def _hashes(text: str) -> list[str]:
    """Hashes of a whole text, its paragraphs and its lines."""
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    return list(dict.fromkeys(h for p in parts if (h := key(p))))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n + 1, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))


def _slots(codes: np.ndarray, n: int) -> np.ndarray:
    """The table's two slots of each run of ``n`` words as one number, by a rolling hash."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(BASE, len(codes))[1:])])
    x = (sums[n:] - sums[:-n]) * _powers(INVERSE, len(codes))[: len(codes) - n + 1] + np.uint64(n)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - 2 * TABLE)).astype(np.int64)


def _runs(passage: str) -> list[tuple[str, int, int]]:
    """(hash, words, slot) of a passage and its paragraphs, to be found as runs of words."""
    out = {}
    for part in (passage, *re.split(r"\n\s*\n", passage)):
        words = part.lower().split()
        if h := key(part):
            out["r" + h] = (len(words), int(_slots(_codes(words), len(words))[0]))
    return [(h, *x) for h, x in out.items()]


def _found(sent):
    """The hashes of a message's parts, and of its runs of words whose slots occur in quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, table = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bodies = part.column(2).to_pylist()
                hashes = [set(_hashes(t)) for t in bodies]
                words, owner = [], []
                for k, t in enumerate(bodies):
                    more = t.lower().split()
                    words += more
                    owner += [k] * len(more)
                codes, owner = _codes(words), np.array(owner, np.int64)
                for n in lengths:
                    if n <= len(words):
                        slots = _slots(codes, n)
                        hit = np.flatnonzero(table[slots >> TABLE] & table[slots & ((1 << TABLE) - 1)] & (owner[: len(words) - n + 1] == owner[n - 1 :]))
                        for p in hit.tolist():
                            if h := key(" ".join(words[p : p + n])):
                                hashes[owner[p]].add("r" + h)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sorted(x) for x in hashes], pa.list_(pa.string()))], ["conv_id", "turn", "own"])

    return run


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string()), ("words", pa.int32()), ("slot", pa.int64())]))
    for b in batches:
        clean, quotes, count = [], [], []
        for t in b.column(0).to_pylist():
            body, passages = parse(t or "")
            clean.append(body)
            parts = [(n, h, None, None) for n, p in passages for h in _hashes(p)]
            count.append(len(parts))
            parts += [(n, *x) for n, p in passages for x in _runs(p)]
            quotes.append([dict(zip(("level", "hash", "words", "slot"), x, strict=True)) for x in parts])
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(clean, pa.string()), pa.array(quotes, kind), pa.array(count, pa.int64())], [*b.schema.names[1:], "body", "quotes", "n_quotes"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: (conv_id, turn, role, body, n_quotes, reply_conv, reply_turn, linked, thread_turn, depth,
    position).

    ``body`` is the text without quotes, ``n_quotes`` counts its quotes' different parts.  A quote occurs where
    its words stand in a row, however wrapped.  The quote of the least level that occurs in an earlier message of the same
    conversation, else in any other message, names the message replied to (the least turn, then the
    least conversation); without one it is the turn before, if there is such a row.  ``linked`` tells
    which.  ``thread_turn`` is the conversation's message that the chain of replies starts from, and
    ``position`` the message's place in that thread, from 0: each reply comes after what it answers and what was answered
    there before it, replies to one message by turn.  Null texts count as
    empty; messages with a null conversation or turn keep their row without links; repeated rows are
    kept each.  Originals are reduced to one row per hash (and conversation) before the join, so a
    message that is repeated a million times is found, not multiplied; of other conversations the two
    least are kept.
    """
    base = messages.select(
        F.col(text_col).alias("text"), F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role")
    )
    kind = "conv_id long, turn long, role string, body string, quotes array<struct<level:int,hash:string,words:int,slot:bigint>>, n_quotes long"
    parsed = cut(base.mapInArrow(_parsed, kind), "messages")
    quoted = parsed.where("conv_id is not null and turn is not null and size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.words", "q.slot").distinct()
    quoted = cut(quoted, "quotes")
    slot = F.explode(F.array(F.shiftright("slot", TABLE), F.col("slot").bitwiseAND(F.lit((1 << TABLE) - 1))))
    words = quoted.where("slot is not null").select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    got = words.toPandas()  # at most 2^18 words of 64 slots
    packed = np.zeros(1 << (TABLE - 6), np.int64)
    packed[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    table = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
    lengths = sorted(r[0] for r in quoted.where("words is not null").select("words").distinct().collect())
    bodies = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", "body")
    sent = messages.sparkSession.sparkContext.broadcast((lengths, table))
    own = bodies.mapInArrow(_found(sent), "conv_id long, turn long, own array<string>").select("conv_id", "turn", F.explode("own").alias("hash"))
    own = own.join(quoted.select("hash").distinct(), "hash", "left_semi")
    here = own.groupBy("hash", "conv_id").agg(F.min("turn").alias("source"))
    near = quoted.join(here, ["hash", "conv_id"]).where("source < turn").select("conv_id", "turn", "level", F.lit(0).alias("far"), F.col("source").alias("reply_turn"), F.col("conv_id").alias("reply_conv"))
    first = F.row_number().over(W.partitionBy("hash").orderBy("source", "conv_id"))
    least = here.withColumn("n", first).where("n <= 2").select("hash", F.struct(F.col("source").alias("turn"), "conv_id").alias("source"))  # one of two is another conversation
    far = quoted.join(least, "hash").where("source.conv_id <> conv_id").select("conv_id", "turn", "level", F.lit(1).alias("far"), F.col("source.turn").alias("reply_turn"), F.col("source.conv_id").alias("reply_conv"))
    replies = near.unionByName(far).groupBy("conv_id", "turn").agg(F.min(F.struct("far", "level", "reply_turn", "reply_conv")).alias("r"))
    places = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = places.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has"))
    nodes = places.join(replies, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("r").isNotNull().alias("linked"),
        F.coalesce("r.reply_conv", F.when(F.col("has"), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("r.reply_turn", F.when(F.col("has"), F.col("turn") - 1)).alias("reply_turn"),
    )
    nodes = _ordered(cut(_threads(nodes), "threads"))
    return parsed.join(nodes, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", "reply_conv", "reply_turn",
        F.coalesce("linked", F.lit(False)).alias("linked"), "thread_turn", "depth", "position",
    )


def _threads(nodes: DataFrame) -> DataFrame:
    """Add thread_turn and depth by pointer jumping over the replies within a conversation.

    Replies point at smaller turns, so there are no cycles; the rounds grow with the logarithm of the
    longest chain.
    """
    inside = (F.col("reply_conv") == F.col("conv_id")) & (F.col("reply_turn") < F.col("turn"))
    names = ["conv_id", "turn", "linked", "reply_conv", "reply_turn", "up", "depth", "top"]
    state = nodes.withColumn("up", F.when(inside, F.col("reply_turn"))).withColumn("depth", F.col("up").isNotNull().cast("long")).withColumn("top", F.coalesce("up", "turn"))
    state = cut(state.select(*names), "threads")
    while state.where("up is not null").limit(1).count():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("top").alias("above"))
        moved = state.where("up is not null").join(above, ["conv_id", "up"]).select(
            "conv_id", "turn", "linked", "reply_conv", "reply_turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("above").alias("top")
        )
        found = cut(state.where("up is null").select(*names).unionByName(moved), "threads")  # only messages under way take part in the join
        release(state)
        state = found
    return state.select("conv_id", "turn", "linked", "reply_conv", "reply_turn", F.col("top").alias("thread_turn"), "depth")


def _ordered(nodes: DataFrame) -> DataFrame:
    """Add position: how many messages come before in the walk through the thread's replies.

    A message is a step down (weight 1) and a step up (0).  Down leads to the first reply's down, or to its own up; up
    leads to the next reply's down of the same message, or to that message's up.  The weights from a step to the walk's
    end are summed by doubling; a message's place is the thread's size less that sum.
    """
    inside = (F.col("reply_conv") == F.col("conv_id")) & (F.col("reply_turn") < F.col("turn"))
    tree = nodes.select("conv_id", "thread_turn", "turn", F.when(inside, F.col("reply_turn")).alias("parent"))
    later = F.lead("turn").over(W.partitionBy("conv_id", "parent").orderBy("turn"))
    sibling = tree.where("parent is not null").withColumn("later", later).unionByName(tree.where("parent is null").withColumn("later", F.lit(None).cast("long")))
    child = tree.where("parent is not null").groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    both = sibling.join(child, ["conv_id", "turn"], "left")
    step = lambda turn, up: F.when(turn.isNotNull(), F.struct(turn.alias("turn"), F.lit(up).alias("up")))
    down = both.select("conv_id", "turn", F.lit(0).alias("up"), F.coalesce(step(F.col("child"), 0), step(F.col("turn"), 1)).alias("next"), F.lit(1).cast("long").alias("sum"))
    up = both.select("conv_id", "turn", F.lit(1).alias("up"), F.coalesce(step(F.col("later"), 0), step(F.col("parent"), 1)).alias("next"), F.lit(0).cast("long").alias("sum"))
    state = cut(down.unionByName(up), "walk")
    while not state.where("next is not null").isEmpty():
        ahead = state.select("conv_id", F.struct("turn", "up").alias("next"), F.col("next").alias("after"), F.col("sum").alias("more"))
        moved = state.where("next is not null").join(ahead, ["conv_id", "next"]).select("conv_id", "turn", "up", F.col("after").alias("next"), (F.col("sum") + F.col("more")).alias("sum"))
        found = cut(state.where("next is null").unionByName(moved), "walk")
        release(state)
        state = found
    size = tree.groupBy("conv_id", "thread_turn").agg(F.count("*").alias("size"))
    left = state.where("up = 0").select("conv_id", "turn", "sum")
    return nodes.join(left, ["conv_id", "turn"]).join(size, ["conv_id", "thread_turn"]).withColumn("position", F.col("size") - F.col("sum")).drop("sum", "size")


def conversations(linked: DataFrame, most: int = 512) -> DataFrame:
    """Training rows: (conv_id, thread_turn, part, messages) with ``messages`` an array of (role, body) in reply order.

    A thread of more than ``most`` messages goes on in the next part, so a row is bounded.  Repeated messages follow each
    other; messages without a conversation or turn are in none.
    """
    own = linked.where("position is not null").withColumn("part", F.floor(F.col("position") / most))
    rows = own.groupBy("conv_id", "thread_turn", "part").agg(F.array_sort(F.collect_list(F.struct("position", "role", "body"))).alias("m"))
    return rows.select("conv_id", "thread_turn", "part", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["body"].alias("body"))).alias("messages"))


def with_quotes(messages: DataFrame, every: int = 3) -> DataFrame:
    """Messages that quote: each ``every``-th one, by a hash of its place, gets the first sentence of the message two turns
    before it as a quote, for tables whose messages hold none."""
    earlier = messages.groupBy(F.col("conv_id"), (F.col("turn") + 2).alias("turn")).agg(F.min("text").alias("_earlier"))
    quote = F.regexp_extract("_earlier", r"^[^.!?\n]*[.!?]?", 0)
    picked = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(every)) == 0) & (F.length(quote) >= LEAST)
    held = messages.join(earlier, ["conv_id", "turn"], "left")
    return held.withColumn("text", F.when(picked, F.concat(F.lit("> "), quote, F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))).select(*messages.columns)
